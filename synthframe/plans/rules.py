"""Queries of rules, roll-ups, transformation steps and conditional draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import hash_pick_sql
from ..operators import clean, features, infer, metrics, profile, sample, transform
from .evaluating import _MARGINS, _PAIRS, _cont
from .registry import query, rounded, table


def _union(parts) -> str:
    return " union all ".join(parts)


_KINDS = {"p_partkey": "whole", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "whole", "p_retailprice": "float", "two": "whole", "few": "float", "yes_no": "text"}
_PART = "(select p_partkey, p_name, p_brand, p_type, p_size, p_retailprice, cast(p_partkey % 2 as bigint) two, cast(p_partkey % 7 as double) few, case when p_partkey % 3 = 0 then 'yes' when p_partkey % 3 = 1 then 'no' end yes_no from part)"


def _parts(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice", (k % 2).alias("two"), (k % 7).cast("double").alias("few"), F.when(k % 3 == 0, "yes").when(k % 3 == 1, "no").alias("yes_no")
    )


@query(
    f"""with f as ({_union(f"select '{c}' col, '{k}' kind, count(distinct {c}) v, count(distinct {c}) + (count({c}) < count(*))::int d from {_PART}" for c, k in _KINDS.items())})
select col as "column", 'typed' as rule, case when kind = 'text' and d = 2 then 'binary' when kind = 'text' then 'categorical' when kind = 'whole' and d = 2 then 'binary' when kind = 'whole' and d between 3 and 25 then 'categorical' else 'numeric' end as role from f
union all select col, 'few_whole', case when kind = 'text' or (kind = 'whole' and v between 2 and 25) then 'categorical' else 'numeric' end from f
union all select col, 'few_any', case when kind = 'text' or v between 2 and 20 then 'categorical' else 'numeric' end from f"""
)
def role_rules(spark, sf_dir):
    return infer.roles_by_rules(_parts(spark, sf_dir))


@query(
    f"""with f as ({_union(f"select '{c}' target, '{k}' kind, count(*) n, count(distinct {c}) v from {_PART}" for c, k in _KINDS.items())}),
c as (select *, case when v <= 2 then 'binclass' else 'multiclass' end k from f)
select target, 'type' as rule, case when kind <> 'text' then 'regression' when v = 2 then 'binclass' else 'multiclass' end as task from c
union all select target, 'few', case when kind <> 'text' and v > 20 then 'regression' else k end from c
union all select target, 'share', case when kind = 'float' or (kind = 'whole' and v > greatest(20.0, 0.05 * n)) then 'regression' else k end from c"""
)
def task_rules(spark, sf_dir):
    return infer.tasks_by_rules(_parts(spark, sf_dir), list(_KINDS))


_TABLES = {
    "nation": ("n_nationkey, n_name, n_regionkey", 2, 1),
    "customer": ("c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment", 3, 2),
    "events": ("event_id, user_id, event_type, case when event_id % 7 = 0 then null else value end", 3, 1),
}


def _tables(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    return {"nation": table(spark, sf_dir, "nation"), "customer": table(spark, sf_dir, "customer"), "events": events}


@query(
    "with t as ("
    + _union(
        f"""select '{t}' as "table", count(*) n_rows, {len(c.split(', '))} n_columns, {x} n_numeric, {y} n_categorical, {' + '.join(f'(count(*) - count({e}))' for e in c.split(', '))} n_missing from {t}"""
        for t, (c, x, y) in _TABLES.items()
    )
    + """) select coalesce("table", 'ALL') as "table", """
    + ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in ("n_rows", "n_columns", "n_numeric", "n_categorical", "n_missing"))
    + """ from t group by rollup("table")"""
)
def table_totals(spark, sf_dir):
    return profile.table_totals(_tables(spark, sf_dir))


@query(
    """with c as (select table_name, column_name, case when table_name = 'events' and column_name = 'value' then 'v' else column_name end as name, lower(data_type) t from information_schema.columns
where table_name in ('nation', 'customer') or (table_name = 'events' and column_name in ('event_id', 'user_id', 'event_type', 'value'))),
r as (select 'dtype' kind, case t when 'varchar' then 'string' when 'integer' then 'int' else t end as name from c
union all select 'category', case when name like 'n\\_%' escape '\\' then 'nation' when name like 'c\\_%' escape '\\' then 'customer' when name like 'event%' then 'event' else 'other' end from c)
select kind, name, count(*) n_columns from r group by all"""
)
def type_rollup(spark, sf_dir):
    return profile.type_rollup(_tables(spark, sf_dir), {"n_": "nation", "c_": "customer", "event": "event"})


_IDS = "select case when event_id % 5 = 0 then [] when event_id % 5 = 1 then [user_id % 3] else [user_id % 3, 3 + event_id % 4] end ids from events"
_SEGMENTS = {"num_segments": "len(ids)"} | {f"seg_{i}": f"list_contains(ids, {i})::int" for i in range(7)} | {f"seg_hash_{k}": f"len(list_filter(ids, lambda x: x % 4 = {k}))" for k in range(4)}


@query(_union(f"select '{n}' as feature, round(avg({e}), 6) as mean, cast(max({e}) as bigint) as max, cast(sum({e}) as bigint) as total, round(count(*) filter ({e} > 0) * 100.0 / count(*), 6) as nonzero_pct from ({_IDS})" for n, e in _SEGMENTS.items()))
def segment_report(spark, sf_dir):
    one, two = F.col("user_id") % 3, F.col("event_id") % 4 + 3
    ids = F.when(F.col("event_id") % 5 == 0, "[]").when(F.col("event_id") % 5 == 1, F.concat(F.lit("["), one, F.lit("]"))).otherwise(F.concat(F.lit("["), one, F.lit(", "), two, F.lit("]")))
    rows = table(spark, sf_dir, "events").select(ids.alias("ids"))
    return rounded(profile.segment_report(features.segment_features(rows, ["ids"], top=7, bins=4)))


_RAW = "case when event_id % 4 = 0 then 'n/a' when event_id % 4 = 1 then cast(user_id as varchar) when event_id % 4 = 2 then cast(user_id as varchar) || '.75' end"


@query(f"select event_id, coalesce(cast(trunc(try_cast({_RAW} as double)) as bigint), 0) as whole, try_cast({_RAW} as double) as part from events")
def cast_parsed(spark, sf_dir):
    k, u = F.col("event_id") % 4, F.col("user_id").cast("string")
    raw = F.when(k == 0, "n/a").when(k == 1, u).when(k == 2, F.concat(u, F.lit(".75")))
    rows = table(spark, sf_dir, "events").select("event_id", raw.alias("whole"), raw.alias("part"))
    return clean.cast_parsed(rows, {"whole": "bigint", "part": "double"})


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_orderkey % 6 <> 0")
def labelled_valid_rows(spark, sf_dir):
    price = F.when(F.col("o_orderkey") % 6 != 0, F.col("o_totalprice")).otherwise(F.when(F.col("o_orderkey") % 12 == 0, float("nan")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", price.alias("o_totalprice"), "o_orderstatus")
    return clean.drop_invalid(clean.labelled_rows(rows, "o_orderstatus", "F"), ["o_totalprice"])


@query("select * from orders")
def recombine_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    blocks = clean.split_blocks(rows, "o_orderkey", {"numeric": ["o_custkey"], "categorical": ["o_orderpriority", "o_orderstatus", "o_orderdate"], "target": ["o_totalprice"]})
    return clean.recombine(list(blocks.values()), "o_orderkey", rows.columns)


_SPLIT = "case when o_orderkey % 5 = 0 then 'test' else 'train' end"


@query(
    f"""with o as (select o_orderkey, {_SPLIT} split, case when o_orderkey % 7 <> 0 then o_custkey end x, case when o_orderkey % 11 <> 0 then o_orderpriority end p, o_totalprice y from orders),
a as (select o_orderkey, split, coalesce(x, (select avg(x) from o where split = 'train')) x, coalesce(p, (select p from o where split = 'train' and p is not null group by p order by count(*) desc, p limit 1)) p, y from o),
r as (select p from a where split = 'train' group by p having count(*) >= round((select count(*) from a where split = 'train') * 0.19)),
b as (select o_orderkey, split, x, case when p in (select p from r) then p else '__rare__' end p, y from a),
l as (select p, row_number() over (order by p) - 1 code from (select distinct p from b where split = 'train'))
select o_orderkey, split, round((x - (select avg(x) from b where split = 'train')) / (select stddev_pop(x) from b where split = 'train'), 6) + 0.0 as x,
cast(coalesce(code, (select max(code) + 1 from l)) as int) as p, round((y - (select avg(y) from b where split = 'train')) / (select stddev_pop(y) from b where split = 'train'), 6) + 0.0 as y
from b left join l using (p)"""
)
def transform_steps(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 5 == 0, "test").otherwise("train").alias("split"), F.when(k % 7 != 0, F.col("o_custkey")).alias("x"), F.when(k % 11 != 0, F.col("o_orderpriority")).alias("p"), F.col("o_totalprice").alias("y")
    )
    steps = transform.Transformations(normalization="standard", missing_numbers="mean", missing_categories="mode", rare_share=0.19, encoding="code")
    return rounded(transform.transform_table(rows, ["x"], ["p"], "y", "regression", steps)[0])


_SCORED = "(select case when o_orderkey % 5 = 0 then 'test' else 'train' end part, o_totalprice y, o_totalprice * 0.9 + 100 p, o_orderstatus s, case when o_orderkey % 3 = 0 then 'F' else o_orderstatus end q from orders)"


@query(f"select part, 'rmse' as metric, round(-sqrt(avg((y - p) * (y - p))), 4) as score from {_SCORED} group by part union all select part, 'accuracy', round(avg((s = q)::int), 4) from {_SCORED} group by part")
def part_scores(spark, sf_dir):
    k, y = F.col("o_orderkey"), F.col("o_totalprice")
    rows = table(spark, sf_dir, "orders").select(F.when(k % 5 == 0, "test").otherwise("train").alias("part"), y.alias("y"), (y * 0.9 + 100).alias("p"), F.col("o_orderstatus").alias("s"), F.when(k % 3 == 0, "F").otherwise(F.col("o_orderstatus")).alias("q"))
    return rounded(metrics.score_parts(rows, "part", "y", "p", "regression").union(metrics.score_parts(rows, "part", "s", "q", "classes")), 4)


@query(
    """with r as (select event_type model, user_id % 3 <> 0 and event_type <> (select min(event_type) from events) success, value duration from events),
b as (select model, count(*) n_runs, round(avg(success::int), 6) success_rate, round(avg(duration) filter (success), 6) duration from r group by model)
select *, case when duration is not null then cast(row_number() over (order by duration nulls last, model) as int) end as rank from b"""
)
def run_ranking(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    first = events.agg(F.min("event_type").alias("_first"))
    runs = events.join(F.broadcast(first), F.lit(True)).select(F.col("event_type").alias("model"), ((F.col("user_id") % 3 != 0) & (F.col("event_type") != F.col("_first"))).alias("success"), F.col("value").alias("duration"))
    return rounded(metrics.rank_runs(runs))


@query(
    """select true as columns_match, cast(4 as bigint) as types_preserved, count(*) as n_real, count(*) filter (c_custkey % 2 = 0) as n_synthetic, count(*) filter (c_custkey % 10 < 8) as n_train,
round(count(*) filter (c_custkey % 10 < 8) / count(*), 6) as train_ratio, cast(2 as bigint) as n_categorical from customer"""
)
def table_quality(spark, sf_dir):
    real = table(spark, sf_dir, "customer")
    synthetic = real.where("c_custkey % 2 = 0").withColumn("c_nationkey", F.col("c_nationkey").cast("double"))
    return rounded(metrics.table_quality(real, synthetic, real.where("c_custkey % 10 < 8")))


_SEGS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_TRIAL = f"case when (c_custkey + t) % 3 = 0 then c_mktsegment else [{', '.join(repr(s) for s in _SEGS)}][1 + (c_custkey * 7 + t * t) % 5] end"


@query(
    f"""with t as (select c_custkey k, c_mktsegment truth from customer), v as (select c_custkey k, {_TRIAL} v from customer, range(7) r(t)),
c as (select distinct truth v from t), n as (select k, v, count(*) / 7.0 p from v group by all),
g as (select t.k, c.v, t.truth = c.v y, coalesce(p, 0) p from t, c left join n on n.k = t.k and n.v = c.v),
b as (select k, arg_min(v, (-p, v)) v from g group by k), s as (select p, count(*) filter (y) pos, count(*) filter (not y) neg from g group by p),
w as (select pos, neg, sum(neg) over (order by p) - neg / 2.0 below from s)
select round((select avg((b.v = t.truth)::int) from b join t using (k)), 6) as micro_f1, round(sum(pos * below) / (sum(pos) * sum(neg)), 6) as micro_auc from w"""
)
def imputation_scores(spark, sf_dir):
    real = table(spark, sf_dir, "customer")
    t, k = F.explode(F.sequence(F.lit(0), F.lit(6))).alias("t"), F.col("c_custkey")
    other = F.get(F.array(*[F.lit(s) for s in _SEGS]), ((k * 7 + F.col("t") * F.col("t")) % 5).cast("int"))
    trials = real.select("c_custkey", "c_mktsegment", t).select("c_custkey", F.when((k + F.col("t")) % 3 == 0, F.col("c_mktsegment")).otherwise(other).alias("c_mktsegment"))
    return rounded(metrics.imputation_scores(real, trials, "c_custkey", "c_mktsegment"))


@query(
    f"""with recursive c as ({_cont(_PAIRS)}), {_MARGINS}, mi as (select a, b, sum(n / nn * ln(n * nn / (na * nb))) v from m group by a, b), e as (select a, b, v from mi union all select b, a, v from mi),
o(l) as (select [(select a from (select a, sum(v) s from e group by a) order by s desc limit 1)] union all
select list_append(l, nxt) from (select l, (select e.b from e where list_contains(o.l, e.a) and not list_contains(o.l, e.b) order by e.v desc limit 1) nxt from o) where nxt is not null)
select cast(i as int) as place, l[i] as name from (select l from o order by len(l) desc limit 1), range(1, 4) r(i)"""
)
def dependency_order(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    names = list(dict.fromkeys(c for p in _PAIRS for c in p))
    order = metrics.dependency_order(metrics.mutual_information(rows, names), names)
    return spark.createDataFrame([(k + 1, c) for k, c in enumerate(order)], "place int, name string")


@query(f"with c as (select *, row_number() over (order by c_custkey) - 1 i from customer) select r.id as sample_id, c_custkey from range(2000) r(id) join c on i = {hash_pick_sql('r.id', seed=5)} % (select count(*) from customer)")
def bootstrap_rows(spark, sf_dir):
    return sample.bootstrap(table(spark, sf_dir, "customer").select("c_custkey"), 2000, ["c_custkey"], 5)


@query(f"with n as (select n_name, row_number() over (order by n_name) - 1 i from nation) select r.id as sample_id, n_name from range(70) r(id) join n on i = case when r.id < 25 then r.id else {hash_pick_sql('r.id', seed=3)} % 25 end")
def pad_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_name")
    return sample.pad(rows, table(spark, sf_dir, "customer").select(F.col("c_name").alias("n_name")), 70, ["n_name"], 3)


_LAID = "select col, value, n, sum(n) over (partition by col order by value nulls first) as hi, sum(n) over (partition by col) as total from ({})"


@query(
    f"with b as ({_LAID.format('select 1 as col, case when c_nationkey > 3 then c_name end as value, count(*) n from customer group by all')}) "
    f"select r.id as sample_id, value from range(3000) r(id) join b on {hash_pick_sql('r.id', seed=9)} % total >= hi - n and {hash_pick_sql('r.id', seed=9)} % total < hi"
)
def empirical_draw(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.when(F.col("c_nationkey") > 3, F.col("c_name")).alias("v"))
    return sample.empirical_draw(rows, "v", 3000, 9)


_COND = "select '{0}' as col, cast({0} as varchar) as value, count(*) n from customer group by all"


@query(
    f"with b as ({_LAID.format(_union(_COND.format(c) for c in ('c_mktsegment', 'c_nationkey')))}), "
    f"d as (select id, case when {hash_pick_sql('id', seed=4)} % 2 = 0 then 'c_mktsegment' else 'c_nationkey' end as col, {hash_pick_sql('id', seed=5)} as pick from range(2000) r(id)) "
    """select id as sample_id, col as "column", value from d join b using (col) where pick % total >= hi - n and pick % total < hi"""
)
def condition_vectors(spark, sf_dir):
    return sample.condition_vectors(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"], 2000, 4)


@query(
    f"""with i as (select 'c_mktsegment' as col, c_mktsegment as value, c_custkey from customer union all select 'c_nationkey', cast(c_nationkey as varchar), c_custkey from customer),
n as (select *, row_number() over (partition by col, value order by c_custkey) - 1 as at, count(*) over (partition by col, value) as k, row_number() over (partition by col order by value, c_custkey) - 1 as anywhere from i),
q as (select id, case when id % 2 = 0 then 'c_mktsegment' else 'c_nationkey' end as col, case when id % 2 = 1 then cast(id % 29 as varchar) when id % 10 = 0 then 'BUILDING' else 'MACHINERY' end as value, {hash_pick_sql('id', seed=6)} as pick from range(1000) r(id))
select id as sample_id, true as matched, c_custkey from q join n on n.col = q.col and n.value = q.value and n.at = pick % k
union all select id, false, c_custkey from q join n on n.col = 'c_mktsegment' and n.anywhere = pick % (select count(*) from customer) where not exists (select 1 from i where i.col = q.col and i.value = q.value)"""
)
def rows_for_conditions(spark, sf_dir):
    k = F.col("id")
    asked = spark.range(1000).select(
        k.alias("sample_id"), F.when(k % 2 == 0, "c_mktsegment").otherwise("c_nationkey").alias("column"), F.when(k % 2 == 1, (k % 29).cast("string")).when(k % 10 == 0, "BUILDING").otherwise("MACHINERY").alias("value")
    )
    return sample.rows_for_conditions(table(spark, sf_dir, "customer"), asked, ["c_mktsegment", "c_nationkey"], "c_custkey", 6).select("sample_id", "matched", "c_custkey")

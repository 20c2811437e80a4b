"""Queries of metrics, splits, samples and neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import hash_fraction_sql
from ..operators import clean, metrics, neighbors, profile, sample, split
from ..sources import files
from .registry import query, rounded, table

_COLS = ("l_returnflag", "l_linestatus", "l_linenumber")
_PAIRS = [(a, b) for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]]


def _cont(pairs, src="lineitem"):
    return " union all ".join(f"select '{a}' a, '{b}' b, cast({a} as varchar) va, cast({b} as varchar) vb, count(*) n from {src} group by all" for a, b in pairs)


_MARGINS = "m as (select *, sum(n) over (partition by a, b, va)::double na, sum(n) over (partition by a, b, vb)::double nb, sum(n) over (partition by a, b)::double nn from c)"


@query(f"with c as ({_cont(_PAIRS)}), {_MARGINS} select a, b, round(sum(n / nn * ln(n * nn / (na * nb))), 8) + 0.0 as mi from m group by a, b")
def mutual_information(spark, sf_dir):
    return rounded(metrics.mutual_information(table(spark, sf_dir, "lineitem"), _COLS), 8)


@query(f"with c as ({_cont(_PAIRS + [(b, a) for a, b in _PAIRS])}), {_MARGINS}, h as (select a, b, sum(n / nn * ln(nn / na)) own, sum(n / nn * ln(nb / n)) given from m group by a, b) select a, b, round((own - given) / own, 8) + 0.0 as u from h")
def theils_u(spark, sf_dir):
    return rounded(metrics.theils_u(table(spark, sf_dir, "lineitem"), _COLS), 8)


def _eta(c, x):
    return f"""select '{c}' category, '{x}' number, round(sum(n * (m - g) * (m - g)) / max(t), 6) + 0.0 eta2 from (select count(*) n, avg({x}) m from lineitem group by {c}), (select avg({x}) g, var_pop({x}) * count(*) t from lineitem)"""


@query(" union all ".join(_eta(c, x) for c in ("l_returnflag", "l_linestatus") for x in ("l_quantity", "l_extendedprice")))
def correlation_ratio(spark, sf_dir):
    return rounded(metrics.correlation_ratio(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"]))


_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_NPAIRS = [(a, b) for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]]


def _corr(src):
    return " union all ".join(f"select '{a}' a, '{b}' b, corr({a}, {b}) r from {src}" for a, b in _NPAIRS)


@query(f"select a, b, round(r, 8) + 0.0 as r from ({_corr('lineitem')})")
def pearson_matrix(spark, sf_dir):
    return rounded(metrics.pearson_matrix(table(spark, sf_dir, "lineitem"), _NUM), 8)


_EVEN, _ODD = "(select * from lineitem where l_orderkey % 2 = 0)", "(select * from lineitem where l_orderkey % 2 = 1)"


def _halves(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return df.where("l_orderkey % 2 = 0"), df.where("l_orderkey % 2 = 1")


@query(f"with x as ({_corr(_EVEN)}), y as ({_corr(_ODD)}) select round(sqrt(sum(pow(x.r - y.r, 2))), 8) as gap from x join y using (a, b)")
def corr_l2_gap(spark, sf_dir):
    even, odd = _halves(spark, sf_dir)
    return rounded(metrics.matrix_gap(metrics.pearson_matrix(even, _NUM), metrics.pearson_matrix(odd, _NUM), ["a", "b"], "r"), 8)


def _cdf(cols):
    src = " union all ".join(f"select '{c}' col, cast({c} as double) x, cast(l_orderkey % 2 = 0 as int) r, cast(l_orderkey % 2 = 1 as int) s from lineitem" for c in cols)
    return f"""with u as ({src}), g as (select col, x, sum(r) r, sum(s) s from u group by all),
w as (select col, x, lead(x) over (partition by col order by x) nx, sum(r) over (partition by col order by x) / sum(r) over (partition by col) fr, sum(s) over (partition by col order by x) / sum(s) over (partition by col) fs from g)"""


@query(_cdf(("l_quantity", "l_extendedprice")) + """ select col as "column", round(sum(abs(fr - fs) * (coalesce(nx, x) - x)), 4) wasserstein from w group by col""")
def wasserstein(spark, sf_dir):
    return rounded(metrics.wasserstein(*_halves(spark, sf_dir), ["l_quantity", "l_extendedprice"]), 4)


@query(_cdf(("l_quantity", "l_discount")) + """ select col as "column", round(1 - max(abs(fr - fs)), 8) score from w group by col""")
def ks_complement(spark, sf_dir):
    return rounded(metrics.ks_complement(*_halves(spark, sf_dir), ["l_quantity", "l_discount"]), 8)


def _hist(cols):
    src = " union all ".join(f"select '{c}' col, cast({c} as varchar) v, cast(l_orderkey % 2 = 0 as int) r, cast(l_orderkey % 2 = 1 as int) s from lineitem" for c in cols)
    return f"with u as ({src}), g as (select col, v, sum(r) r, sum(s) s from u group by all), h as (select col, r / sum(r) over (partition by col) p, s / sum(s) over (partition by col) q from g)"


@query(_hist(_COLS) + """ select col as "column", round(sqrt(greatest(0, sum(case when p > 0 then p * ln(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * ln(q / ((p + q) / 2)) else 0 end) / 2)), 6) js from h group by col""")
def js_histogram(spark, sf_dir):
    return rounded(metrics.jensen_shannon(*_halves(spark, sf_dir), _COLS))


@query(_hist(_COLS) + """ select col as "column", round(1 - sum(abs(p - q)) / 2, 8) score from h group by col""")
def tv_complement(spark, sf_dir):
    return rounded(metrics.tv_complement(*_halves(spark, sf_dir), _COLS), 8)


@query("""with s as (select 'm' || l_linenumber model, l_returnflag col, avg(case when l_linenumber = 7 and l_returnflag = 'A' then null else l_quantity end) score from lineitem group by all),
r as (select model, case when score is null then 3 else row_number() over (partition by col order by score nulls first, model) end r from s) select model, round(avg(r), 6) as mean_rank from r group by model""")
def model_rank(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("model"), F.col("l_returnflag").alias("column"), F.when(~((F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "A")), F.col("l_quantity")).alias("score"))
    return rounded(metrics.rank_models(df))


_PRED = "(select l_returnflag y, case when l_quantity < 15 then 'A' when l_quantity < 30 then 'N' else 'R' end p, cast(l_returnflag = 'R' as int) b, l_extendedprice + l_quantity s from lineitem)"
_REPORT = f"""with c as (select y, p, count(*) n from {_PRED} group by all), t as (select y as class, sum(n) support, sum(case when y = p then n else 0 end) hit from c group by y), k as (select p as class, sum(n) claimed from c group by p),
r as (select class, cast(support as bigint) support, hit / claimed as prec, hit / support as rec, 2.0 * hit / (claimed + support) as f1 from t join k using (class))"""


def _predicted(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("y"), F.when(q < 15, "A").when(q < 30, "N").otherwise("R").alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("b"), (F.col("l_extendedprice") + q).alias("s"), "l_extendedprice", "l_quantity")


@query(_REPORT + " select class, support, round(prec, 6) as precision, round(rec, 6) as recall, round(f1, 6) as f1 from r")
def classification_report(spark, sf_dir):
    return rounded(metrics.classification_report(_predicted(spark, sf_dir), "y", "p"))


@query(_REPORT + " select round(sum(rec * support) / sum(support), 6) as accuracy, round(avg(f1), 6) as macro_f1 from r")
def classification_scores(spark, sf_dir):
    return rounded(metrics.classification_scores(_predicted(spark, sf_dir), "y", "p"))


@query(f"with g as (select s, sum(b) p, sum(1 - b) n from {_PRED} group by s), w as (select p, n, sum(n) over (order by s) cn, sum(p) over () tp, sum(n) over () tn from g) select round(sum(p * (cn - n / 2)) / max(tp * tn), 8) as auc from w")
def roc_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(_predicted(spark, sf_dir), "b", "s"), 8)


@query("with p as (select l_extendedprice y, l_quantity * 1500 p from lineitem) select round(sqrt(avg(pow(y - p, 2))), 4) rmse, round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)), 6) r2 from p")
def rmse_r2(spark, sf_dir):
    df = metrics.regression_scores(table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_quantity") * 1500), "l_extendedprice", "p")
    return df.select(F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"))


@query('select l_returnflag, l_linenumber, count(l_quantity) as "count", round(avg(l_quantity), 6) as mean, round(stddev_pop(l_quantity), 6) as std from lineitem group by all')
def seeds_report(spark, sf_dir):
    return rounded(metrics.seeds_report(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linenumber"], "l_quantity"))


_VEC = "select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) e from embeddings where embedding is not null"
_L2 = "sqrt(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: pow(a.e[i] - b.e[i], 2))))"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


@query(f"with v as ({_VEC}), d as (select a.vec_id id, min({_L2}) distance from v a, v b where a.vec_id % 3 = 0 and b.vec_id % 3 <> 0 group by 1) select id, round(distance, 6) as distance from d")
def dcr_min_l2(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return rounded(neighbors.distance_to_closest(v.where("vec_id % 3 = 0"), v.where("vec_id % 3 <> 0"), id_column="vec_id", vector="embedding"))


@query(f"with v as ({_VEC}), d as (select a.vec_id id, min({_L2}) distance from v a, v b where a.vec_id % 3 = 0 and b.vec_id % 3 <> 0 group by 1) select round(avg(distance), 6) as mean, round(var_samp(distance), 6) as variance from d")
def dcr_summary(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return rounded(neighbors.closest_summary(neighbors.distance_to_closest(v.where("vec_id % 3 = 0"), v.where("vec_id % 3 <> 0"), id_column="vec_id", vector="embedding")))


@query(f"""with v as ({_VEC}), d as (select a.vec_id id, b.vec_id near_id, {_L2} distance from v a join v b on a.label = b.label and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by id order by distance, near_id) rank from d) select id, near_id, round(distance, 6) as distance, cast(rank as int) as rank from r where rank <= 3""")
def knn_within_class(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return rounded(neighbors.nearest(v, v, 3, id_column="vec_id", vector="embedding", label="label", exclude_self=True))


@query(f"with v as ({_VEC}) select a.vec_id id, arg_min(b.label, {_L2}) as target from v a, v b where a.vec_id % 10 = 1 and b.vec_id % 10 <> 1 group by 1")
def nn_target(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return neighbors.neighbor_target(v.where("vec_id % 10 = 1"), v.where("vec_id % 10 <> 1"), "label", id_column="vec_id", vector="embedding")


@query(f"with v as ({_VEC}), d as (select a.vec_id id, a.label = b.label same, {_L2} d from v a, v b where a.vec_id % 10 = 1 and b.vec_id % 10 <> 1) select id, round(min(d) + sum(case when same then d else 0 end) / (count(*) filter (same) + 1e-6), 6) as energy from d group by id")
def pfgen_energy(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return rounded(neighbors.energy(v.where("vec_id % 10 = 1"), v.where("vec_id % 10 <> 1"), id_column="vec_id", vector="embedding", label="label"))


_H = hash_fraction_sql


@query(f"select c_custkey, case when {_H('c_custkey', seed=42)} < 0.8 then 'train' else 'test' end as split from customer")
def hash_split(spark, sf_dir):
    return split.hash_split(table(spark, sf_dir, "customer"), ["c_custkey"]).select("c_custkey", "split")


@query(f"""with h as (select c_custkey, row_number() over (partition by c_mktsegment order by {_H('c_custkey', seed=42)}, c_custkey) r, count(*) over (partition by c_mktsegment) n from customer)
select c_custkey, case when n = 1 or r <= greatest(1, least(n - 1, floor(n * 0.8))) then 'train' else 'test' end as split from h""")
def stratified_split(spark, sf_dir):
    return split.stratified_split(table(spark, sf_dir, "customer"), ["c_mktsegment"], ["c_custkey"]).select("c_custkey", "split")


@query(f"""with h as (select c_custkey, {_H('c_custkey', seed=42)} h, row_number() over (partition by c_mktsegment order by {_H('c_custkey', seed=42)}, c_custkey) a, row_number() over (partition by c_nationkey order by {_H('c_custkey', seed=42)}, c_custkey) b from customer)
select c_custkey, case when a = 1 or b = 1 or h < 0.8 then 'train' else 'test' end as split from h""")
def category_preserving_split(spark, sf_dir):
    return split.category_preserving_split(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"], ["c_custkey"]).select("c_custkey", "split")


@query("select c_custkey, case when row_number() over (order by c_custkey) <= greatest(cast(floor(0.9 * (select count(*) from customer)) as bigint), (select count(*) from customer) - 1) then 'train' else 'test' end as split from customer")
def head_split(spark, sf_dir):
    return split.head_split(table(spark, sf_dir, "customer"), ["c_custkey"]).select("c_custkey", "split")


@query("select o_orderkey, cast(ntile(16) over (order by o_orderkey) as int) as shard from orders")
def teacher_shards(spark, sf_dir):
    return split.even_shards(table(spark, sf_dir, "orders"), ["o_orderkey"], 16).select("o_orderkey", "shard")


@query(f"""with p as (select o_orderkey, case when o_orderkey % 10 < 6 then 'train' when o_orderkey % 10 < 8 then 'val' else 'test' end s, o_orderstatus from orders),
h as (select o_orderkey, row_number() over (partition by o_orderstatus order by {_H('o_orderkey', seed=777)}, o_orderkey) r, count(*) over (partition by o_orderstatus) n from p where s <> 'test')
select o_orderkey, case when r <= greatest(1, least(n - 1, floor(n * 0.8))) then 'train' else 'val' end as split from h union all select o_orderkey, s from p where s = 'test'""")
def resplit_validation(spark, sf_dir):
    m = F.col("o_orderkey") % 10
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.when(m < 6, "train").when(m < 8, "val").otherwise("test").alias("split"))
    return split.resplit_validation(df, "o_orderstatus", ["o_orderkey"]).select("o_orderkey", "split")


@query(f"select c_custkey from customer order by {_H('c_custkey', seed=0)}, c_custkey limit (select least(cast(floor(count(*) * 0.1) as int), 1000) from customer)")
def subsample(spark, sf_dir):
    return split.subsample(table(spark, sf_dir, "customer"), ["c_custkey"], 0.1).select("c_custkey")


@query("with n as (select c_custkey, row_number() over (order by c_custkey) - 1 i from customer) select k as sample_id, c_custkey from range(4000) r(k) join n on i = k % (select count(*) from customer)")
def identity_cycle(spark, sf_dir):
    return sample.cycle(table(spark, sf_dir, "customer").select("c_custkey"), 4000, ["c_custkey"])


@query("select c_mktsegment as class, count(*) n_real, cast(floor(count(*) * 1.5) as bigint) n_target from customer group by 1")
def smote_targets(spark, sf_dir):
    return sample.smote_targets(table(spark, sf_dir, "customer"), "c_mktsegment", 0.5)


@query("select c_custkey, 'BUILDING' as c_mktsegment, cast(7 as int) as c_nationkey from customer")
def condition_overwrite(spark, sf_dir):
    return sample.overwrite(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), {"c_mktsegment": "BUILDING", "c_nationkey": 7})


@query("""with c as (select 'c_mktsegment' col, c_mktsegment as value, count(*) n from customer group by 2 union all select 'c_nationkey', cast(c_nationkey as varchar), count(*) from customer group by 2)
select col as "column", value, round(n / sum(n) over (partition by col), 8) as share from c""")
def condition_frequencies(spark, sf_dir):
    return rounded(sample.condition_frequencies(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"]), 8)


_VOTES = "(select vec_id, t, cast((vec_id * 7 + t * t + label) % 10 < 6 as int) vote from embeddings, range(10) r(t))"


def _votes(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("t"))
    return v.select("vec_id", ((F.col("vec_id") * 7 + F.col("t") * F.col("t") + F.col("label")) % 10 < 6).cast("int").alias("vote"))


@query(f"select vec_id, cast(sum(vote) as double) n_yes, cast(sum(vote) > 5 as int) as label from {_VOTES} group by 1")
def pate_votes(spark, sf_dir):
    return metrics.pate_votes(_votes(spark, sf_dir), "vec_id", "vote", 10)


@query(f"""with v as (select vec_id, sum(vote) y from {_VOTES} group by 1), q as (select (2 + 0.1 * abs(2 * y - 10)) / (4 * exp(0.1 * abs(2 * y - 10))) q from v), l as (select unnest([1, 2, 4, 8]) l)
select cast(l as int) as l, round(sum(least(2 * 0.1 * 0.1 * l * (l + 1), coalesce(case when q * exp(0.2) < 1 then ln((1 - q) * pow((1 - q) / (1 - q * exp(0.2)), l) + q * exp(0.2 * l)) end, 2 * 0.1 * 0.1 * l * (l + 1)))), 6) as alpha from q, l group by l""")
def moments_accountant(spark, sf_dir):
    votes = metrics.pate_votes(_votes(spark, sf_dir), "vec_id", "vote", 10)
    return rounded(metrics.moments_accountant(votes, "n_yes", 10, 0.1, [1, 2, 4, 8]))


@query(f"with c as ({_cont(_PAIRS)}) select a, b, va, vb, n, round(n / sum(n) over (partition by a, b), 8) as share from c")
def marginals_2way(spark, sf_dir):
    return rounded(metrics.marginals(table(spark, sf_dir, "lineitem"), _COLS), 8)


@query(f"""with c as ({_cont(_PAIRS)}), {_MARGINS}, mi as (select a, b, sum(n / nn * ln(n * nn / (na * nb))) v from m group by a, b), e as (select a, b, v from mi union all select b, a, v from mi),
f as (select b from e where a = 'l_returnflag' order by v desc limit 1), r as (select x.b c from e x where x.a = 'l_returnflag' and x.b <> (select b from f))
select cast(null as varchar) as parent, 'l_returnflag' as child union all select 'l_returnflag', (select b from f)
union all select (select a from e where b = (select c from r) and a in ('l_returnflag', (select b from f)) order by v desc limit 1), (select c from r)""")
def chow_liu_edges(spark, sf_dir):
    tree = metrics.maximum_spanning_tree(metrics.mutual_information(table(spark, sf_dir, "lineitem"), _COLS), list(_COLS))
    return spark.createDataFrame(tree, "parent string, child string")


@query("select n_nationkey, cast(floor((row_number() over (order by n_nationkey) - 1) / 10) as bigint) as chunk from nation")
def chunked_scan(spark, sf_dir):
    return files.chunk_ids(table(spark, sf_dir, "nation"), 10, ["n_nationkey"]).select("n_nationkey", "chunk")


@query("select s_suppkey as id, s_acctbal as balance, cast(null as varchar) as segment from supplier union all select c_custkey, c_acctbal, c_mktsegment from customer")
def union_by_name(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    b = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True).select("id", "balance", "segment")


@query("select c_acctbal, c_custkey, c_mktsegment, c_nationkey from customer")
def column_reorder(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return clean.reorder(df, ["c_acctbal", "c_custkey"], ["c_mktsegment"], ["c_nationkey"])[0]


@query("select 'l_returnflag' as \"column\", l_returnflag as value, count(*) as n, round(count(*) / (select count(*) from lineitem), 8) as share from lineitem group by 2")
def value_counts(spark, sf_dir):
    return rounded(profile.value_counts(table(spark, sf_dir, "lineitem"), ["l_returnflag"]), 8)

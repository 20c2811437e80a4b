"""Queries of profiles, role inference and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, infer, profile
from .registry import query, rounded, table

_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_CAT = ("l_returnflag", "l_linestatus")


def _union(parts) -> str:
    return " union all ".join(parts)


@query(
    _union(
        f"""select '{c}' as "column", count({c}) as n, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, round(min({c}), 6) as "min", round(max({c}), 6) as "max",
        round(quantile_cont({c}, 0.5), 6) as median, round(quantile_cont({c}, 0.25), 6) as q25, round(quantile_cont({c}, 0.75), 6) as q75, count(*) filter ({c} = 0) as zeros, round(count(*) filter ({c} = 0) * 100.0 / count({c}), 6) as zero_pct from lineitem"""
        for c in _NUM
    )
)
def profile_numeric(spark, sf_dir):
    return rounded(profile.numeric_profile(table(spark, sf_dir, "lineitem").select(*_NUM)))


@query(
    f"""with p as ({_union(f"select avg({c}) m, stddev_samp({c}) s from lineitem" for c in _NUM)})
select count(*) n_columns, count(*) filter (abs(m) < 0.1 and abs(s - 1) < 0.1) n_standardized, round(avg(m), 6) mean_of_means, round(avg(s), 6) mean_of_stds from p"""
)
def profile_standardized(spark, sf_dir):
    return rounded(profile.standardized_summary(profile.numeric_profile(table(spark, sf_dir, "lineitem").select(*_NUM))))


@query(
    f"""with v as ({_union(f"select '{c}' as col, cast({c} as varchar) as value from orders" for c in ("o_orderstatus", "o_orderpriority"))}),
c as (select col, value, count(*) n from v where value is not null group by all),
r as (select *, n / sum(n) over (partition by col) as share, row_number() over (partition by col order by n desc, value) as rank from c)
select col as "column", value, n, round(cast(share as double), 6) as share, cast(rank as int) as rank from r where rank <= 10"""
)
def profile_categorical_topk(spark, sf_dir):
    return rounded(profile.top_values(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], 10))


@query(
    f"""with v as ({_union(f"select '{c}' as col, cast({c} as varchar) as value from orders" for c in ("o_orderstatus", "o_orderpriority"))}),
c as (select col, value, count(*) n from v group by all)
select col as "column", count(*) n_values, arg_min(value, (-n, value)) most, max(n) most_n, arg_min(value, (n, value)) least, min(n) least_n from c group by col"""
)
def profile_extremes(spark, sf_dir):
    return profile.extreme_values(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


_EV = ("event_id", "user_id", "event_type", "v")
_EVENTS = "(select event_id, user_id, event_type, case when event_id % 7 = 0 then null else value end v from events)"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))


@query(_union(f"""select '{c}' as "column", count(*) n_rows, count(*) - count({c}) n_null, round((count(*) - count({c})) * 100.0 / count(*), 6) null_pct, count(distinct {c}) n_distinct from {_EVENTS}""" for c in _EV))
def profile_nulls(spark, sf_dir):
    return rounded(profile.null_profile(_events(spark, sf_dir)))


@query("""select * from (values ('bigint', cast(2 as bigint)), ('string', cast(1 as bigint)), ('double', cast(1 as bigint))) t(dtype, n_columns)""")
def dtype_histogram(spark, sf_dir):
    return profile.dtype_histogram(_events(spark, sf_dir))


@query(
    f"""select count(*) n_rows, cast(4 as bigint) n_columns, cast(3 as bigint) n_numeric, cast(1 as bigint) n_categorical, round((count(*) - count(v)) * 100.0 / (count(*) * 4), 6) missing_pct,
cast((count(distinct event_id) > 0.8 * count(*))::int + (count(distinct user_id) > 0.8 * count(*))::int + (count(distinct event_type) > 0.8 * count(*))::int + (count(distinct v) > 0.8 * count(*))::int as bigint) n_high_cardinality from {_EVENTS}"""
)
def dataset_stats(spark, sf_dir):
    return rounded(profile.dataset_stats(_events(spark, sf_dir)))


@query(
    """select 'p_size' as "column", cast(min(p_size) as double) as "min", cast(max(p_size) as double) as "max", cast(null as bigint) as n_categories, 'numeric' as kind from part
union all select 'p_retailprice', min(p_retailprice), max(p_retailprice), null, 'numeric' from part
union all select 'p_brand', null, null, count(distinct p_brand), 'categorical' from part
union all select 'p_type', null, null, count(distinct p_type), 'categorical' from part"""
)
def column_info(spark, sf_dir):
    return profile.column_info(table(spark, sf_dir, "part").select("p_size", "p_retailprice", "p_brand", "p_type"))


_ROLE = {"c_custkey": True, "c_nationkey": True, "c_acctbal": True, "c_mktsegment": False, "c_name": False}


@query(
    "with f as ("
    + _union(
        f"""select '{c}' as col, count(*) n_rows, count(distinct {c}) + max(({c} is null)::int) n_distinct, {str(num).lower()} is_number, {f'bool_and({c} % 1 = 0)' if num else 'false'} all_integer, avg((try_cast(cast({c} as varchar) as double) is not null)::int) number_share from customer"""
        for c, num in _ROLE.items()
    )
    + """) select col as "column", n_rows, cast(n_distinct as bigint) n_distinct, is_number, all_integer, round(number_share, 6) number_share,
case when n_distinct <= 2 then 'binary' when not is_number then 'categorical' when all_integer and n_distinct <= 25 then 'categorical' else 'numeric' end role_cardinality,
case when number_share > 0.7 then 'numeric' else 'categorical' end role_parse from f"""
)
def role_inference(spark, sf_dir):
    return rounded(infer.infer_roles(table(spark, sf_dir, "customer").select(*_ROLE)))


def _task(target, numeric, src):
    return f"""select '{target}' as target, count({target}) n_rows, count(distinct {target}) n_classes, case when count(distinct {target}) <= 2 then 'binclass'
when {str(not numeric).lower()} or (count(distinct {target}) <= 20 and count(distinct {target}) < 0.05 * count({target})) then 'multiclass' else 'regression' end task from {src}"""


@query(_union([_task("l_returnflag", False, "lineitem"), _task("l_linestatus", False, "lineitem"), _task("l_linenumber", True, "lineitem"), _task("l_extendedprice", True, "lineitem")]))
def task_type(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    out = infer.task_type(df, "l_returnflag")
    for c in ("l_linestatus", "l_linenumber", "l_extendedprice"):
        out = out.union(infer.task_type(df, c))
    return out


@query(_union(f"""select '{c}' as "column", count(*) n_rows, count(distinct {c}) n_distinct, count(distinct {c}) >= 0.95 * count(*) or count(distinct {c}) >= 5000 id_like from part""" for c in ("p_name", "p_brand", "p_type")))
def id_like_columns(spark, sf_dir):
    return infer.id_like_columns(table(spark, sf_dir, "part"))


@query(_union(f"""select '{c}' as "column", cast(count(distinct {e}) + max(({e} is null)::int) as bigint) n_distinct, count(distinct {e}) + max(({e} is null)::int) <= 1 is_constant from orders""" for c, e in (("o_orderstatus", "o_orderstatus"), ("one", "1"), ("none", "cast(null as int)"), ("half", "case when o_orderkey % 2 = 0 then 5 end"))))
def constant_columns(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderstatus", F.lit(1).alias("one"), F.lit(None).cast("int").alias("none"), F.when(F.col("o_orderkey") % 2 == 0, 5).alias("half"))
    return infer.constant_columns(df)


@query(_union(f"""select '{c}' as "column", count(distinct {c}) n_distinct, count(distinct {c}) < 0.1 * count(*) as_category from part""" for c in ("p_name", "p_brand", "p_type")))
def categorical_strings(spark, sf_dir):
    return infer.categorical_strings(table(spark, sf_dir, "part"))


@query("""select distinct 'p_name' as "column", p_name as value from part a where p_partkey % 7 = 0 and not exists (select 1 from part b where b.p_partkey % 50 = 1 and b.p_name = a.p_name)
union all select distinct 'p_brand', p_brand from part a where p_partkey % 7 = 0 and not exists (select 1 from part b where b.p_partkey % 50 = 1 and b.p_brand = a.p_brand)""")
def unseen_categories(spark, sf_dir):
    """Two parts of the table stand for training and test rows."""
    df = table(spark, sf_dir, "part")
    return infer.unseen_categories(df.where("p_partkey % 50 = 1"), df.where("p_partkey % 7 = 0"), ["p_name", "p_brand"])


def _down(c, old):
    if old == "double":
        return f"""select '{c}' as "column", 'double' as old, 'float' as "new" """
    if old == "string":
        return f"""select '{c}', 'string', case when count(distinct {c}) < 0.5 * count(*) then 'category' else 'string' end from orders"""
    return f"""select '{c}', '{old}', case when min({c}) > -128 and max({c}) < 127 then 'tinyint' when min({c}) > -32768 and max({c}) < 32767 then 'smallint' when min({c}) > -2147483648 and max({c}) < 2147483647 then 'int' else '{old}' end from orders"""


@query(_union([_down("o_totalprice", "double"), _down("o_orderkey", "bigint"), _down("o_custkey", "bigint"), _down("o_orderstatus", "string"), _down("o_orderpriority", "string")]))
def dtype_downcast(spark, sf_dir):
    return infer.downcast_types(table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


_GAPPY = "(select event_id, case when event_id % 5 <> 0 then value end value, case when event_id % 11 <> 0 then event_type end event_type from events)"


def _gappy(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"))


_MODE = f"(select event_type from {_GAPPY} where event_type is not null group by 1 order by count(*) desc, event_type limit 1)"


@query(f"""select event_id, round(coalesce(value, (select avg(value) from {_GAPPY})), 6) as value, coalesce(event_type, {_MODE}) as event_type from {_GAPPY}""")
def impute_mean_mode(spark, sf_dir):
    df = _gappy(spark, sf_dir)
    return rounded(clean.impute_from(df, df, "mean", "mode", ["value", "event_type"]))


@query(f"""select event_id, round(coalesce(value, (select avg(value) from {_GAPPY} where event_id % 10 < 8)), 6) as value from {_GAPPY}""")
def impute_train_mean(spark, sf_dir):
    df = _gappy(spark, sf_dir).drop("event_type")
    return rounded(clean.impute_from(df, df.where("event_id % 10 < 8"), "mean", None, ["value"]))


@query(f"""select event_id, round(coalesce(value, (select quantile_cont(value, 0.5) from {_GAPPY})), 6) as value, coalesce(event_type, 'Unknown') as event_type from {_GAPPY}""")
def impute_median_unknown(spark, sf_dir):
    df = _gappy(spark, sf_dir)
    return rounded(clean.impute_from(df, df, "median", "Unknown", ["value", "event_type"]))


@query(f"""select event_id, coalesce(value, 0.0) as value from {_GAPPY}""")
def impute_zero(spark, sf_dir):
    df = _gappy(spark, sf_dir).drop("event_type")
    return clean.impute_from(df, df, "zero", None, ["value"])


@query("""with t as (select event_id, try_cast(case when event_id % 3 = 0 then 'n/a' else cast(event_id % 100 as varchar) end as double) x from events)
select event_id, round(coalesce(x, (select avg(x) from t)), 6) as x from t""")
def coerce_then_mean(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "n/a").otherwise((F.col("event_id") % 100).cast("string")).alias("x"))
    df = clean.coerce_numeric(df, ["x"])
    return rounded(clean.impute_from(df, df, "mean", None, ["x"]))


@query("select o_orderkey, case when o_orderpriority = '5-LOW' then null else o_orderpriority end o_orderpriority from orders")
def sentinel_to_null(spark, sf_dir):
    return clean.sentinels_to_null(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), {"o_orderpriority": "5-LOW"})


@query(f"select * from {_GAPPY} where value is not null and event_type is not null")
def drop_any_null(spark, sf_dir):
    return clean.drop_any_null(_gappy(spark, sf_dir))


@query("select p_partkey, p_type from part where p_type in (select p_type from part group by 1 having count(*) >= 14)")
def rare_class_filter(spark, sf_dir):
    return clean.drop_rare_classes(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", 13)


@query("select event_id, event_type from events where event_id % 13 <> 0")
def drop_empty(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    keep = F.col("event_id") % 13 != 0
    return clean.drop_empty(df.select(F.when(keep, F.col("event_id")).alias("event_id"), F.when(keep, F.col("event_type")).alias("event_type"), F.lit(None).cast("double").alias("nothing")))


@query("select cast(event_id as varchar) as a, event_type as b, cast(user_id as varchar) as c from events where event_id % 4 <> 0")
def parse_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    lines = e.select(F.concat_ws(",", F.col("event_id").cast("string"), "event_type", F.when(F.col("event_id") % 4 != 0, F.col("user_id").cast("string"))).alias("line"))
    f = F.col("fields")
    return clean.parse_rows(lines, "line", 3).select(f[0].alias("a"), f[1].alias("b"), f[2].alias("c"))


@query("select l_orderkey, l_linenumber, case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as flag from lineitem")
def onehot_argmax(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[(F.col("l_returnflag") == v).cast("double").alias(f"flag_{v}") for v in "ANR"])
    return clean.argmax_label(df, ["flag_A", "flag_N", "flag_R"], "flag").withColumn("flag", F.col("flag").cast("int"))

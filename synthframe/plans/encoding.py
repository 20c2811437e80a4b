"""Queries of encoders, decoders and feature engineering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import normal_quantile_sql
from ..operators import encode, features, metrics, sample
from .registry import query, rounded, table

def _minmax(c: str) -> str:
    return f"round((cast({c} as double) - min({c}) over ()) / case when max({c}) over () = min({c}) over () then 1 else max({c}) over () - min({c}) over () end, 6)"


@query(f"""select {_minmax('l_quantity')} as l_quantity_scaled, {_minmax('l_extendedprice')} as l_extendedprice_scaled, {_minmax('l_discount')} as l_discount_scaled,
{', '.join(f"cast(l_returnflag = '{v}' as int)::double as l_returnflag_{v}" for v in 'ANR')}, {', '.join(f"cast(l_linestatus = '{v}' as int)::double as l_linestatus_{v}" for v in 'FO')} from lineitem""")
def default_encode(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    return rounded(encode.encode(df, encode.fit_plan(df)))


@query("select l_orderkey, round(l_quantity, 6) as l_quantity, round(l_extendedprice, 6) as l_extendedprice, l_returnflag, l_linestatus from lineitem")
def default_decode_roundtrip(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    plan = encode.fit_plan(df)
    return rounded(encode.decode(encode.encode(df, plan), plan))


@query(f"""select {_minmax('c_custkey')} as c_custkey_scaled, case when c_custkey % 9 = 0 then -1.0 else cast(dense_rank() over (partition by c_custkey % 9 = 0 order by c_name) - 1 as double) end as c_name_code,
{', '.join(f"cast(c_mktsegment = '{v}' as int)::double as c_mktsegment_{v}" for v in ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'))} from customer""")
def many_levels_encode(spark, sf_dir):
    df = _names(spark, sf_dir)
    return rounded(encode.encode(df, encode.fit_plan(df, wide=100)))


@query("select c_custkey, case when c_custkey % 9 <> 0 then c_name end as c_name, c_mktsegment from customer")
def many_levels_decode(spark, sf_dir):
    df = _names(spark, sf_dir)
    plan = encode.fit_plan(df, wide=100)
    return encode.decode(encode.encode(df, plan), plan)


def _names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_name")).alias("c_name"), "c_mktsegment")


@query("""with v as (select 'o_orderstatus' col, cast(o_orderstatus as varchar) as value from orders union all select 'o_orderpriority', o_orderpriority from orders),
c as (select col, value, count(*) n from v group by all)
select col as "column", value, n, round(n / sum(n) over (partition by col), 6) as share, cast(row_number() over (partition by col order by value) - 1 as int) level_index,
cast(row_number() over (partition by col order by n desc, value) as int) frequency_rank from c""")
def empirical_dist(spark, sf_dir):
    return rounded(encode.empirical_distribution(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], nulls=True))


@query("""select p_partkey, case when p_partkey % 10 = 0 then -1 else cast(dense_rank() over (partition by p_partkey % 10 = 0 order by p_brand) - 1 as int) end as code from part""")
def label_codes(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 != 0, F.col("p_brand")).alias("b"))
    return encode.label_codes(df, "b", "code").select("p_partkey", "code")


@query("""with l as (select distinct p_name v from part where p_partkey % 40 = 3), c as (select v, row_number() over (order by v) - 1 code from l)
select p_partkey, cast(coalesce(code, (select max(code) + 1 from c)) as int) as code from part left join c on v = p_name""")
def ordinal_unseen(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return encode.label_codes(df, "p_name", "code", fit_on=df.where("p_partkey % 40 = 3"), unseen="next").select("p_partkey", "code")


@query("""with l as (select p_brand v, cast(row_number() over (order by p_brand) - 1 as int) code from (select distinct p_brand from part))
select p_partkey, l.v as brand from part, l where l.code = least((select max(code) from l), cast(round_even((p_partkey % 40) * 0.9, 0) as int))""")
def decode_clip(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    coded = df.select("p_partkey", ((F.col("p_partkey") % 40) * F.lit(0.9)).alias("code"))
    return encode.decode_codes(coded, "code", encode.level_table(df, "p_brand"), "brand").select("p_partkey", "brand")


@query("""with c as (select p_size, count(*) freq from part group by 1) select p_partkey, freq, cast(d - 1 as int) as code from part join (select p_size, freq, dense_rank() over (order by freq) d from c) using (p_size)""")
def freq_label_encode(spark, sf_dir):
    return encode.frequency_codes(table(spark, sf_dir, "part"), "p_size", "code").select("p_partkey", "freq", "code")


@query("select o_orderkey, round((sum(o_totalprice) over (partition by o_orderpriority) - o_totalprice) / (count(*) over (partition by o_orderpriority) - 1), 4) as loo from orders")
def loo_target_encode(spark, sf_dir):
    return rounded(encode.target_encode_loo(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", "loo").select("o_orderkey", "loo"), 4)


@query("select p_partkey, case when count(*) over (partition by p_size) >= round((select count(*) from part) * 0.02) then cast(p_size as varchar) else '__rare__' end as p_size from part")
def rare_collapse(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("p_size"))
    return encode.collapse_rare(df, "p_size", 0.02)


@query("select o_orderkey, round((o_totalprice - avg(o_totalprice) over ()) / stddev_pop(o_totalprice) over (), 6) + 0.0 as z from orders")
def zscore_pop(spark, sf_dir):
    return rounded(encode.zscore(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]).select("o_orderkey", F.col("o_totalprice_z").alias("z")))


_KNOTS = "quantile_cont(l_quantity, [" + ", ".join(f"{k}/10.0" for k in range(11)) + "])"
_U = """with k as (select {k} q from {src}), p as (select {id}, {c} x, q, len(list_filter(q, lambda e: e < {c})) b, len(list_filter(q, lambda e: e <= {c})) u from {src}, k),
t as (select {id}, case when x is null then null when u > b then (b + u - 1) / 20.0 when b = 0 then 0 when b = 11 then 1 else (b - 1 + (x - q[b]) / (q[b + 1] - q[b])) / 10.0 end u from p)"""


@query(_U.format(k=_KNOTS, src="lineitem", id="l_orderkey, l_linenumber, l_partkey", c="l_quantity") + " select l_orderkey, l_linenumber, l_partkey, round(cast(u as double), 6) u from t")
def quantile_uniform(spark, sf_dir):
    df = encode.quantile_transform(table(spark, sf_dir, "lineitem"), "l_quantity", 11)
    return rounded(df.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity_u").alias("u")))


@query(
    _U.format(k=_KNOTS.replace("l_quantity", "o_totalprice"), src="orders", id="o_orderkey", c="o_totalprice")
    + f", w as (select o_orderkey, greatest(1e-7::double, least(1 - 1e-7::double, cast(u as double))) p from t) select o_orderkey, round({normal_quantile_sql('p')}, 4) + 0.0 as g from w"
)
def gaussian_quantile(spark, sf_dir):
    df = encode.quantile_transform(table(spark, sf_dir, "orders"), "o_totalprice", 11, normal=True)
    return rounded(df.select("o_orderkey", F.col("o_totalprice_g").alias("g")), 4)


@query("""with c as (select l_discount v, count(*) n from lineitem group by 1), s as (select v, row_number() over (order by n desc, v) code from c where n > 0.09 * (select count(*) from lineitem))
select l_orderkey, l_linenumber, l_partkey, l_discount, cast(coalesce(code, 0) as int) as spike from lineitem left join s on v = l_discount""")
def spike_columns(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount")
    return encode.spike_codes(df, "l_discount", 0.09).withColumnRenamed("l_discount_spike", "spike")


@query("select l_orderkey, l_linenumber, l_partkey, l_discount from lineitem")
def spike_restore(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount")
    spikes = encode.spike_values(df, "l_discount", 0.09)
    coded = encode.spike_codes(df, "l_discount", 0.09).withColumn("l_discount", F.when(F.col("l_discount_spike") == 0, F.col("l_discount")).otherwise(-1.0))
    return encode.restore_spikes(coded, "l_discount", spikes).select(*df.columns)


@query("select o_orderkey, cast(greatest(0, least(14, ceil((o_totalprice - min(o_totalprice) over ()) / ((max(o_totalprice) over () - min(o_totalprice) over ()) / 15)) - 1)) as int) as bin from orders")
def cut_bins(spark, sf_dir):
    return encode.cut_bins(table(spark, sf_dir, "orders"), "o_totalprice", 15).select("o_orderkey", F.col("o_totalprice_bin").alias("bin"))


_EDGES = "(select list_sort(list_distinct(quantile_cont({c}, [" + ", ".join(f"{k}/10.0" for k in range(11)) + "]))) e from {t})"


@query(f"with k as {_EDGES.format(c='p_retailprice', t='part')} select p_partkey, cast(len(list_filter(e[2:len(e) - 1], lambda x: x < p_retailprice)) as int) as bin from part, k")
def mi_bins(spark, sf_dir):
    return encode.quantile_bins(table(spark, sf_dir, "part"), "p_retailprice", 10).select("p_partkey", F.col("p_retailprice_bin").alias("bin"))


@query("""with o as (select distinct p_retailprice x from part where p_partkey % 17 = 0), a as (select p_partkey, p_retailprice + 0.3 y from part)
select p_partkey, round(arg_min(x, (abs(y - x), x)), 6) as price from a, o group by p_partkey""")
def snap_to_observed(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    moved = part.select("p_partkey", (F.col("p_retailprice") + 0.3).alias("price"))
    seen = part.where("p_partkey % 17 = 0").select(F.col("p_retailprice").alias("price"))
    return rounded(encode.snap_to_observed(moved, "price", seen))


@query("""select event_id, cast(hour(ts) as int) as "hour", round(sin(2 * pi() * hour(ts) / 24), 6) + 0.0 hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) + 0.0 hour_cos, cast(isodow(ts) - 1 as int) as dow,
round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) + 0.0 dow_sin, round(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) + 0.0 dow_cos, cast(isodow(ts) >= 6 as int) is_weekend, cast(month(ts) as int) as "month" from events""")
def time_features(spark, sf_dir):
    names = ["hour", "hour_sin", "hour_cos", "dow", "dow_sin", "dow_cos", "is_weekend", "month"]
    return rounded(features.time_features(table(spark, sf_dir, "events"), "ts").select("event_id", *names))


@query("""with b as (select event_id, case when event_id % 50 = 0 then 'unknown' when lower(event_type) like '%app%' or event_id % 3 = 0 then 'app' else 'web' end bucket from events)
select event_id, case when count(*) over (partition by bucket) < 300 then '<<OTHER>>' else bucket end as site_bucket from b""")
def site_bucket(spark, sf_dir):
    site = F.when(F.col("event_id") % 50 == 0, None).when(F.col("event_id") % 3 == 0, F.concat(F.lit("My-Mobile."), "event_type")).otherwise(F.col("event_type"))
    return features.site_bucket(table(spark, sf_dir, "events").select("event_id", site.alias("site")), "site", 300).select("event_id", "site_bucket")


def _segments(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    one = F.when(F.col("event_id") % 9 == 0, "[]").when(F.col("event_id") % 9 == 1, "[1, oops").otherwise(F.format_string("[%d, %d]", F.col("event_id") % 7, F.col("user_id") % 11))
    two = F.when(F.col("event_id") % 5 == 0, None).otherwise(F.format_string("[%d]", F.col("user_id") % 13 + 5))
    return e.select("event_id", one.alias("a"), two.alias("b"))


@query(
    """with s as (select event_id, list_concat(case when event_id % 9 in (0, 1) then [] else [event_id % 7, user_id % 11] end, case when event_id % 5 = 0 then [] else [user_id % 13 + 5] end) ids from events),
c as (select id from (select unnest(ids) id from s) group by id order by count(*) desc, id limit 3)
select event_id, cast(len(ids) as int) num_segments, cast(len(list_intersect(ids, (select list(id) from c))) as int) top_hits, """
    + ", ".join(f"cast(len(list_filter(ids, lambda x: x % 4 = {k})) as int) as seg_hash_{k}" for k in range(4))
    + " from s"
)
def segment_multihot(spark, sf_dir):
    df = features.segment_features(_segments(spark, sf_dir), ["a", "b"], top=3, bins=4)
    hot = [c for c in df.columns if c.startswith("seg_") and not c.startswith("seg_hash")]
    return df.select("event_id", "num_segments", sum((F.col(c) for c in hot), F.lit(0)).alias("top_hits"), *[f"seg_hash_{k}" for k in range(4)])


@query("""with v as (select p_partkey, case when p_partkey % 12 = 0 then null else cast(p_size as varchar) end s from part), c as (select s from v where s is not null group by s having count(*) >= 36)
select p_partkey, case when s is null then 'na' when s in (select s from c) then s else '<<OTHER>>' end as s from v""")
def vocab_other(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 12 != 0, F.col("p_size").cast("string")).alias("s"))
    return features.vocabulary_column(df, "s", 36).select("p_partkey", "s")


_PARTS = "select l_orderkey, l_linenumber, l_partkey, l_extendedprice t, l_quantity a, l_discount b, l_tax c from lineitem"


@query(f"""with p as ({_PARTS}), w as (select *, case when a + b + c = 0 then 1e-8 else a + b + c end s from p),
g as (select *, ln(a / s + 1e-8) la, ln(b / s + 1e-8) lb, ln(c / s + 1e-8) lc from w)
select l_orderkey, l_linenumber, l_partkey, round(ln(1 + t), 6) log_t, round(la - avg(la) over (), 6) + 0.0 cost_clr_a, round(lb - avg(lb) over (), 6) + 0.0 cost_clr_b, round(lc - avg(lc) over (), 6) + 0.0 cost_clr_c from g""")
def cost_clr(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice t", "l_quantity a", "l_discount b", "l_tax c")
    return rounded(features.cost_shares(df, "t", ["a", "b", "c"]).drop("t", "a", "b", "c"))


@query(f"""with p as ({_PARTS}), w as (select *, case when a + b + c = 0 then 1e-8 else a + b + c end s from p),
g as (select *, ln(a / s + 1e-8) la, ln(b / s + 1e-8) lb, ln(c / s + 1e-8) lc from w)
select l_orderkey, l_linenumber, l_partkey, round(la - (la + lb + lc) / 3, 6) + 0.0 cost_clr_a, round(lb - (la + lb + lc) / 3, 6) + 0.0 cost_clr_b from g""")
def cost_clr_row(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice t", "l_quantity a", "l_discount b", "l_tax c")
    return rounded(features.cost_shares(df, "t", ["a", "b", "c"], "row").select("l_orderkey", "l_linenumber", "l_partkey", "cost_clr_a", "cost_clr_b"))


@query("""with c as (select o_orderkey, c_acctbal, o_totalprice, (o_orderkey % 101) / 100.0::double r from orders join customer on o_custkey = c_custkey),
f as (select *, ln(greatest(1e-7, least(1 - 1e-7, r)) / (1 - greatest(1e-7, least(1 - 1e-7, r)))) lr, ln(1 + o_totalprice) lp from c)
select o_orderkey, round((c_acctbal - avg(c_acctbal) over ()) / (stddev_samp(c_acctbal) over () + 1e-8), 5) + 0.0 c_acctbal,
round((lp - avg(lp) over ()) / (stddev_samp(lp) over () + 1e-8), 5) + 0.0 o_totalprice, round((lr - avg(lr) over ()) / (stddev_samp(lr) over () + 1e-8), 5) + 0.0 r from f""")
def numeric_auto_transform(spark, sf_dir):
    df = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    df = df.select("o_orderkey", "c_acctbal", "o_totalprice", ((F.col("o_orderkey") % 101) / 100.0).alias("r"))
    return rounded(features.auto_transform(df, ["c_acctbal", "o_totalprice", "r"]), 5)


@query("select c_custkey, cast(c_nationkey as varchar) || '_' || c_mktsegment as stratum from customer")
def stratify_key(spark, sf_dir):
    return features.stratify_key(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"]).select("c_custkey", "stratum")


@query("select event_type as a, cast(user_id as varchar) as b, '' || event_id as c from events")
def parse_generated(spark, sf_dir):
    text = F.concat(F.lit("```csv\na,b,c\n"), "event_type", F.lit(" , "), F.col("user_id").cast("string"), F.lit(","), F.col("event_id").cast("string"), F.lit(",extra\n```"))
    return features.parse_generated_rows(table(spark, sf_dir, "events").select(text.alias("t")), "t", ["a", "b", "c"])


@query("""with d as (select c_custkey, c_acctbal, c_nationkey, c_mktsegment from customer), n as (select *, row_number() over (order by c_custkey) - 1 i from d),
s as (select c_acctbal from n join range(2500) r(k) on i = k % (select count(*) from n)),
u as (select c_acctbal x, 1 a, 0 b from d union all select c_acctbal, 0, 1 from s), g as (select x, sum(a) a, sum(b) b from u group by x),
w as (select x, lead(x) over (order by x) nx, sum(a) over (order by x) / sum(a) over () fa, sum(b) over (order by x) / sum(b) over () fb from g)
select 'c_acctbal' as "column", round(sum(abs(fa - fb) * (coalesce(nx, x) - x)), 4) as wasserstein from w""")
def encode_sample_decode_fidelity(spark, sf_dir):
    """Encode, draw 2500 rows in order, decode, and compare: the whole life of a synthetic table."""
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    plan = encode.fit_plan(df.drop("c_custkey"))
    drawn = sample.cycle(df, 2500, ["c_custkey"])
    decoded = encode.decode(encode.encode(drawn, plan), plan)
    return rounded(metrics.wasserstein(df, decoded, ["c_acctbal"]), 4)

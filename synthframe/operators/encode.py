"""Encoders and decoders. Fitting is an aggregate that gives a small plan; encoding is a projection from literals, or a
join where a column has many levels."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import normal_quantile
from ..functions.ordered import with_row_number
from ..session import cut, discard
from .infer import roles_by_type
from .profile import value_counts

#: Levels up to which a column gets a block of 0/1 columns; beyond that its levels are a table and it gets a code by a join.
LITERAL_LEVELS = 500


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


@dataclass
class ColumnPlan:
    name: str
    dtype: str
    role: str
    low: float | None = None
    high: float | None = None
    levels: list[str] = field(default_factory=list)
    shares: list[float] = field(default_factory=list)
    table: str | None = None  # where the value, code rows of a coded column lie


@dataclass
class TablePlan:
    """How a table is encoded: enough to encode rows and to restore names, order and types."""

    columns: list[ColumnPlan]

    def to_json(self) -> str:
        return json.dumps([asdict(c) for c in self.columns])

    @staticmethod
    def from_json(text: str) -> TablePlan:
        return TablePlan([ColumnPlan(**c) for c in json.loads(text)])

    @property
    def encoded_names(self) -> list[str]:
        single = {"numeric": "scaled", "coded": "code"}
        return [n for c in self.columns for n in ([f"{c.name}_{single[c.role]}"] if c.role in single else [f"{c.name}_{v}" for v in c.levels])]


def fit_plan(df: DataFrame, boolean_is_numeric: bool = False, wide: int = LITERAL_LEVELS) -> TablePlan:
    """Min and max of numeric columns, sorted levels and their shares of the others: two aggregates over the table.

    Columns of more than `wide` levels are coded: their levels stay a table in the shared folder, so the plan and what
    reaches the driver are bounded by columns times `wide`."""
    roles, types = roles_by_type(df, boolean_is_numeric), dict(df.dtypes)
    numbers = [c for c in df.columns if roles[c] == "numeric"]
    others = [c for c in df.columns if roles[c] != "numeric"]
    row = df.agg(*[F.struct(F.min(_q(c)).cast("double"), F.max(_q(c)).cast("double")).alias(c) for c in numbers]).first() if numbers else {}
    levels: dict[str, list] = {c: [] for c in others}
    coded: dict[str, ColumnPlan] = {}
    if others:
        counts = cut(value_counts(df, others), "levels")
        many = {r["column"]: r["count"] for r in counts.groupBy("column").count().where(F.col("count") > wide).collect()}
        for r in counts.where(~F.col("column").isin(*many or [""])).collect():
            levels[r["column"]].append((r["value"], r["share"]))
        for c, n in many.items():
            known = cut(with_row_number(counts.where(F.col("column") == c).select("value"), ["value"], "code"), "codes")
            coded[c] = ColumnPlan(c, types[c], "coded", 0.0, float(n - 1), table=known._cut_path)
        discard(counts)
    plans = []
    for c in df.columns:
        if roles[c] == "numeric":
            plans.append(ColumnPlan(c, types[c], "numeric", row[c][0], row[c][1]))
        elif c in coded:
            plans.append(coded[c])
        else:
            known = sorted(levels[c])
            plans.append(ColumnPlan(c, types[c], "categorical", levels=[v for v, _ in known], shares=[s for _, s in known]))
    return TablePlan(plans)


def scale_minmax(c: str, low: float | None, high: float | None) -> Column:
    """(x - low) / (high - low); a constant column gives 0."""
    span = (high - low) if low is not None and high != low else 1.0
    return (_q(c).cast("double") - F.lit(low if low is not None else 0.0)) / F.lit(float(span))


def encode(df: DataFrame, plan: TablePlan) -> DataFrame:
    """<column>_scaled for numbers, <column>_<level> for each sorted level of the others (an unknown level is all zero),
    <column>_code for those of many levels (an unknown one is -1)."""
    out = []
    for k, p in enumerate(plan.columns):
        if p.role == "numeric":
            out.append(scale_minmax(p.name, p.low, p.high).alias(f"{p.name}_scaled"))
        elif p.role == "coded":
            known = df.sparkSession.read.parquet(p.table).select(F.col("value").alias(f"_value{k}"), F.col("code").alias(f"_code{k}"))
            df = df.join(known, _q(p.name).cast("string") == F.col(f"_value{k}"), "left")
            out.append(F.coalesce(F.col(f"_code{k}").cast("double"), F.lit(-1.0)).alias(f"{p.name}_code"))
        else:
            out += [F.coalesce((_q(p.name).cast("string") == v).cast("double"), F.lit(0.0)).alias(f"{p.name}_{v}") for v in p.levels]
    return df.select(*out)


def decode(df: DataFrame, plan: TablePlan, nulls: bool = True) -> DataFrame:
    """The inverse of encode, in the source's order and types: numbers unscaled (whole types rounded half to even), the
    first maximum of a block its level; a block of zeros is NULL. Codes are rounded and clipped to the known ones; a
    negative one is NULL (with nulls=False the first level)."""
    out = []
    for k, p in enumerate(plan.columns):
        if p.role == "numeric":
            span = p.high - p.low if p.low is not None and p.high != p.low else 1.0
            x = _q(f"{p.name}_scaled") * F.lit(float(span)) + F.lit(p.low if p.low is not None else 0.0)
            out.append(restore_type(x, p.dtype).alias(p.name))
        elif p.role == "coded":
            known = df.sparkSession.read.parquet(p.table).select(F.col("value").alias(f"_value{k}"), F.col("code").alias(f"_code{k}"))
            code = F.least(F.lit(p.high), F.rint(_q(f"{p.name}_code")))
            df = df.join(known, (code if nulls else F.greatest(F.lit(0.0), code)).cast("long") == F.col(f"_code{k}"), "left")
            out.append(F.col(f"_value{k}").cast(p.dtype).alias(p.name))
        elif not p.levels:
            out.append(F.lit(None).cast(p.dtype).alias(p.name))
        else:
            block = F.array(*[_q(f"{p.name}_{v}") for v in p.levels])
            level = F.element_at(F.array(*[F.lit(v) for v in p.levels]), F.array_position(block, F.array_max(block)).cast("int"))
            out.append((F.when(F.array_max(block) > 0, level) if nulls else level).cast(p.dtype).alias(p.name))
    return df.select(*out)


def restore_type(x: Column, dtype: str) -> Column:
    """Whole types: rounded half to even; booleans: above one half; others: cast."""
    if dtype in ("tinyint", "smallint", "int", "bigint"):
        return F.rint(x).cast(dtype)
    return (x > 0.5) if dtype == "boolean" else x.cast(dtype)


def empirical_distribution(df: DataFrame, columns: Sequence[str], nulls: bool = False) -> DataFrame:
    """column, value, n, share, level_index (0-based, sorted, NULL last), frequency_rank (1-based)."""
    counts = value_counts(df, list(columns), keep_nulls=nulls)
    return counts.withColumn("level_index", F.row_number().over(Window.partitionBy("column").orderBy(F.col("value").asc_nulls_last())) - 1).withColumn(
        "frequency_rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    )


def level_table(df: DataFrame, column: str) -> DataFrame:
    """value, code: sorted distinct non-null levels, 0-based."""
    levels = df.select(_q(column).alias("value")).where("value is not null").distinct()
    return with_row_number(levels, ["value"], "code").select("value", F.col("code").cast("int").alias("code"))


def label_codes(df: DataFrame, column: str, name: str | None = None, fit_on: DataFrame | None = None, unseen: str = "null") -> DataFrame:
    """df with the 0-based code of the sorted level; NULL is -1. Levels that fit_on lacks: NULL code, or with
    unseen='next' one past the last code."""
    levels = level_table(fit_on if fit_on is not None else df, column)
    name = name or f"{column}_code"
    coded = df.join(levels.withColumnRenamed("code", "_code"), _q(column) == F.col("value"), "left").drop("value")
    other = F.lit(None).cast("int")
    if unseen == "next":
        top = levels.agg(F.coalesce(F.max("code") + 1, F.lit(0)).alias("_next"))
        coded = coded.join(F.broadcast(top), F.lit(True))  # one row
        other = F.col("_next")
    return coded.withColumn(name, F.when(_q(column).isNull(), -1).otherwise(F.coalesce("_code", other))).drop("_code", "_next")


def decode_codes(df: DataFrame, code: str, levels: DataFrame, name: str) -> DataFrame:
    """Rounds, clips to the known codes and looks the level up; a negative code is NULL."""
    top = levels.agg(F.max("code").alias("_top"))
    rows = df.join(F.broadcast(top), F.lit(True)).withColumn("_k", F.least(F.col("_top"), F.rint(_q(code)).cast("int")))
    return rows.join(levels.select(F.col("code").alias("_k"), F.col("value").alias(name)), "_k", "left").drop("_k", "_top")


def frequency_codes(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """df with freq (rows of the value) and the 0-based code of that count among the distinct counts, ascending."""
    counts = df.groupBy(_q(column).alias("_v")).agg(F.count("*").alias("freq"))
    codes = counts.select("freq").distinct().withColumn(name or f"{column}_code", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("freq")) - 1)
    return df.join(counts.join(codes, "freq"), _q(column).eqNullSafe(F.col("_v"))).drop("_v")


def zscore(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None, sample: bool = False) -> DataFrame:
    """<column>_z with the population (or sample) deviation; NULL gives 0, the mean."""
    std = F.stddev_samp if sample else F.stddev_pop
    row = (fit_on if fit_on is not None else df).agg(*[F.struct(F.avg(_q(c)), std(_q(c))).alias(c) for c in columns]).first()
    return df.withColumns({f"{c}_z": F.coalesce((_q(c) - F.lit(row[c][0])) / F.lit(row[c][1] or 1.0), F.lit(0.0)) for c in columns})


def quantile_knots(df: DataFrame, column: str, n: int) -> list[float]:
    grid = F.array(*[F.lit(k / (n - 1)) for k in range(n)])
    return df.agg(F.percentile(_q(column).cast("double"), grid)).first()[0] or []


def uniform_from_knots(x: Column, knots: Sequence[float]) -> Column:
    """Piecewise-linear position of x among the knots, 0 to 1; equal knots take the middle of their positions."""
    n = len(knots)
    a = F.array(*[F.lit(float(k)) for k in knots])
    below, upto = F.size(F.filter(a, lambda k: k < x)), F.size(F.filter(a, lambda k: k <= x))
    left = F.get(a, below - 1)
    right = F.get(a, below)
    between = (below - 1 + (x - left) / (right - left)) / (n - 1)
    level = (below + upto - 1) / F.lit(2.0 * (n - 1))
    return F.when(x.isNull(), None).when(upto > below, level).when(below == 0, 0.0).when(below == n, 1.0).otherwise(between)


def quantile_transform(df: DataFrame, column: str, n: int | None = None, normal: bool = False, fit_on: DataFrame | None = None) -> DataFrame:
    """<column>_u in [0, 1], and with normal also <column>_g, the normal quantile of u clipped to [1e-7, 1 - 1e-7].

    n knots, by default max(min(rows / 30, 1000), 10)."""
    source = fit_on if fit_on is not None else df
    if n is None:
        n = max(min(source.count() // 30, 1000), 10)
    out = df.withColumn(f"{column}_u", uniform_from_knots(_q(column).cast("double"), quantile_knots(source, column, n)))
    if normal:
        out = out.withColumn("_p", F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col(f"{column}_u")))).withColumn(f"{column}_g", normal_quantile("_p")).drop("_p")
    return out


def inverse_quantile(u: Column, knots: Sequence[float]) -> Column:
    a, n = F.array(*[F.lit(float(k)) for k in knots]), len(knots)
    at = u * (n - 1)
    k = F.least(F.floor(at), F.lit(n - 2)).cast("int")
    return F.get(a, k) + (at - k) * (F.get(a, k + 1) - F.get(a, k))


def target_encode_loo(df: DataFrame, column: str, target: str, name: str | None = None) -> DataFrame:
    """Leave-one-out mean of the target: (sum - y) / (count - 1) over the row's category; NULL for a category's only row."""
    stats = df.groupBy(_q(column).alias("_v")).agg(F.sum(_q(target).cast("double")).alias("_s"), F.count("*").alias("_n"))
    value = F.when(F.col("_n") > 1, (F.col("_s") - _q(target)) / (F.col("_n") - 1))
    return df.join(stats, _q(column).eqNullSafe(F.col("_v"))).withColumn(name or f"{column}_loo", value).drop("_v", "_s", "_n")


def collapse_rare(df: DataFrame, column: str, share: float, token: str = "__rare__", fit_on: DataFrame | None = None) -> DataFrame:
    """Values with fewer rows than round(n * share) in the fit split become the token."""
    source = fit_on if fit_on is not None else df
    least = round(source.count() * share)
    kept = source.groupBy(_q(column).alias("_v")).count().where(F.col("count") >= least).select("_v")
    return df.join(kept, _q(column) == F.col("_v"), "left").withColumn(column, F.when(_q(column).isNull(), None).otherwise(F.coalesce("_v", F.lit(token)))).drop("_v")


def spike_values(df: DataFrame, column: str, share: float = 0.01) -> DataFrame:
    """value, n, code: values that more than a share of the rows has, by frequency from 1 (ties to the smaller value)."""
    n = df.count()
    counts = df.where(_q(column).isNotNull()).groupBy(_q(column).alias("value")).agg(F.count("*").alias("n")).where(F.col("n") > share * n)  # 1 / share rows at most
    return counts.withColumn("code", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "value")))


def spike_codes(df: DataFrame, column: str, share: float = 0.01) -> DataFrame:
    """df with <column>_spike: the code of the row's spike value, 0 for none."""
    spikes = spike_values(df, column, share).select(F.col("value").alias("_v"), F.col("code").alias(f"{column}_spike"))
    return df.join(F.broadcast(spikes), _q(column) == F.col("_v"), "left").drop("_v").fillna({f"{column}_spike": 0})


def restore_spikes(df: DataFrame, column: str, spikes: DataFrame) -> DataFrame:
    """Rows with a spike code get the spike's value back; the code goes."""
    known = spikes.select(F.col("value").alias("_v"), F.col("code").alias(f"{column}_spike"))
    return df.join(F.broadcast(known), f"{column}_spike", "left").withColumn(column, F.coalesce("_v", _q(column))).drop("_v", f"{column}_spike")


def cut_bins(df: DataFrame, column: str, bins: int = 15) -> DataFrame:
    """<column>_bin: equal-width right-closed bins, 0-based; the lowest value belongs to the first; NULL gives 0."""
    low, high = df.agg(F.min(_q(column)).cast("double"), F.max(_q(column)).cast("double")).first()
    width = ((high - low) / bins if low is not None and high > low else 1.0) or 1.0
    k = F.ceil((_q(column).cast("double") - F.lit(low or 0.0)) / F.lit(width)) - 1
    return df.withColumn(f"{column}_bin", F.coalesce(F.greatest(F.lit(0), F.least(F.lit(bins - 1), k)).cast("int"), F.lit(0)))


def quantile_bins(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """<column>_bin: how many distinct inner quantile edges lie below the value; two edges or fewer give 0."""
    edges = sorted(set(quantile_knots(df, column, bins + 1)))
    inner = F.array(*[F.lit(float(e)) for e in edges[1:-1]])
    if len(edges) <= 2:
        return df.withColumn(f"{column}_bin", F.lit(0))
    return df.withColumn(f"{column}_bin", F.when(_q(column).isNull(), -1).otherwise(F.size(F.filter(inner, lambda e: e < _q(column).cast("double")))))


def snap_to_observed(df: DataFrame, column: str, observed: DataFrame) -> DataFrame:
    """Each value becomes the nearest observed one, the smaller on a tie.

    Both sides are sorted together by range, and each range looks to its last observed value below and first above."""
    obs = observed.select(_q(column).cast("double").alias("x")).where("x is not null").distinct().select("x", F.lit(1).alias("seen"), F.lit(None).cast("string").alias("row"))
    ids = cut(df.withColumn("_row", F.expr("uuid()")), "snap")
    asked = ids.select(_q(column).cast("double").alias("x"), F.lit(0).alias("seen"), F.col("_row").alias("row")).where("x is not null")
    both = cut(obs.union(asked).repartitionByRange("x").withColumn("part", F.spark_partition_id()), "snap-ranges")
    ends = both.where("seen = 1").groupBy("part").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    parts = both.select("part").distinct().join(ends, "part", "left")
    order = Window.orderBy("part")  # one row a range
    parts = parts.select(
        "part",
        F.last("hi", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first("lo", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )
    local = Window.partitionBy("part").orderBy("x")
    value = F.when(F.col("seen") == 1, F.col("x"))
    near = both.join(parts, "part").select(
        "row",
        "x",
        "seen",
        F.coalesce(F.last(value, True).over(local.rangeBetween(Window.unboundedPreceding, Window.currentRow)), "before").alias("below"),
        F.coalesce(F.first(value, True).over(local.rangeBetween(Window.currentRow, Window.unboundedFollowing)), "after").alias("above"),
    )
    snapped = near.where("seen = 0").select("row", F.expr("case when below is null then above when above is null then below when x - below <= above - x then below else above end").alias("_near"))
    return ids.join(snapped, F.col("_row") == F.col("row"), "left").withColumn(column, F.col("_near")).drop("row", "_row", "_near")

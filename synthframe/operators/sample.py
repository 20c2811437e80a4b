"""Drawing rows: exactly n of them, from a seed, without a random row order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash_fraction, hash_pick
from ..functions.ordered import running_sums, with_row_number
from ..session import cut
from .profile import value_counts

#: Slots of a weighted table that are made in one go, so that no row holds a longer list.
SLOTS = 4096


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _numbered(df: DataFrame, order: Sequence[str]) -> tuple[DataFrame, int]:
    rows = cut(with_row_number(df, list(order), "_row"), "numbered")
    return rows, rows.count()


def cycle(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """Exactly n rows: df in order, again and again; sample_id counts from 0."""
    rows, size = _numbered(df, order)
    ids = df.sparkSession.range(n).select(F.col("id").alias("sample_id"), F.pmod(F.col("id"), F.lit(max(size, 1))).alias("_row"))
    return ids.join(rows, "_row").drop("_row")


def bootstrap(df: DataFrame, n: int, order: Sequence[str], seed: int = 0) -> DataFrame:
    """Exactly n rows with replacement; draw i of a seed is always the same row."""
    rows, size = _numbered(df, order)
    pick = F.pmod(hash_pick("id", seed=seed), F.lit(max(size, 1)))
    ids = df.sparkSession.range(n).select(F.col("id").alias("sample_id"), pick.alias("_row"))
    return ids.join(rows, "_row").drop("_row")


def pad(synthetic: DataFrame, real: DataFrame, n: int, order: Sequence[str], seed: int = 0) -> DataFrame:
    """Exactly n rows: the first n of synthetic, or all of them and draws from them with replacement. Without any, draws
    from real; without those, none. sample_id counts from 0."""
    rows, size = _numbered(synthetic, order)
    if not size:
        return bootstrap(real.select(*[_q(c) for c in synthetic.columns]), n, order, seed)
    pick = F.when(F.col("id") < size, F.col("id")).otherwise(F.pmod(hash_pick("id", seed=seed), F.lit(size)))
    ids = synthetic.sparkSession.range(n).select(F.col("id").alias("sample_id"), pick.alias("_row"))
    return ids.join(rows, "_row").drop("_row")


def pick_examples(df: DataFrame, k: int, key: Sequence[str], seed: int = 0) -> DataFrame:
    """k rows without replacement: those with the smallest hashes of their keys."""
    return df.withColumn("_h", F.xxhash64(F.lit(seed), *[_q(c) for c in key])).orderBy("_h", *[_q(c) for c in key]).limit(k).drop("_h")


def uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) from the seed and the parts: independent over parts, the same on every run."""
    return (F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 53)) + 0.5) / F.lit(float(1 << 53))


def standard_normal(seed: int, *parts: Column) -> Column:
    u, v = uniform(seed, *parts), uniform(seed + 1_000_003, *parts)
    return F.sqrt(-2 * F.ln(u)) * F.cos(F.lit(6.283185307179586) * v)


def draw_category(shares: Sequence[tuple[object, float]], u: Column) -> Column:
    """The value whose cumulated share first exceeds u; for short lists of literals."""
    total, out, acc = sum(s for _, s in shares) or 1.0, None, 0.0
    for value, share in shares[:-1]:
        acc += share / total
        out = F.when(u < acc, F.lit(value)) if out is None else out.when(u < acc, F.lit(value))
    last = F.lit(shares[-1][0]) if shares else F.lit(None)
    return last if out is None else out.otherwise(last)


def weighted_slots(weights: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(sizes, slots) of a table of by, value, n (a whole number above 0) and further columns; (by, value) is unique.

    A group's counts are laid end to end in the order of value and cut into as many equal slots as it has values; a value is
    a row in each slot that it touches. That is at most three rows a value on average, however the counts are spread, and a
    draw meets three at most in the mean, so finding its value is a join on equality."""
    by = list(by)
    sizes = weights.groupBy(*by).agg(F.sum("n").cast("long").alias("_total"), F.count("*").alias("_k"))
    sizes = sizes.select(*by, "_total", F.expr("(_total + _k - 1) div _k").alias("_width"))
    laid = running_sums(weights, "value", ["n"], by).drop("next_value", "total_n").join(sizes.drop("_total"), by)
    laid = laid.withColumn("_hi", F.col("cum_n").cast("long")).withColumn("_lo", (F.col("cum_n") - F.col("n")).cast("long"))
    wide = laid.withColumn("_some", F.explode(F.expr(f"sequence(_lo div (_width * {SLOTS}), (_hi - 1) div (_width * {SLOTS}))")))
    first, last = f"greatest(_lo, _some * _width * {SLOTS})", f"least(_hi, (_some + 1) * _width * {SLOTS}) - 1"
    return sizes, wide.withColumn("_slot", F.explode(F.expr(f"sequence(({first}) div _width, ({last}) div _width)"))).drop("_some", "_width", "cum_n", "n")


def draw_weighted(draws: DataFrame, sizes: DataFrame, slots: DataFrame, by: Sequence[str]) -> DataFrame:
    """draws (with by and _pick, a hash_pick) and the value that the pick falls on, by the counts of its group. Draws of a
    group without values are left out."""
    at = draws.join(sizes, list(by)).withColumn("_at", F.pmod("_pick", "_total")).withColumn("_slot", F.expr("_at div _width"))
    hit = at.join(slots, [*by, "_slot"]).where((F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi")))
    return hit.drop("_pick", "_total", "_width", "_at", "_slot", "_lo", "_hi")


def empirical_draw(df: DataFrame, column: str, n: int, seed: int = 0) -> DataFrame:
    """sample_id, value (as text): n draws from a column's values (NULL is one); none from an empty table."""
    sizes, slots = weighted_slots(value_counts(df, [column], keep_nulls=True).drop("share"), ["column"])
    draws = df.sparkSession.range(n).select(F.col("id").alias("sample_id"), F.lit(column).alias("column"), hash_pick("id", seed=seed).alias("_pick"))
    return draw_weighted(draws, sizes, slots, ["column"]).select("sample_id", "value")


def overwrite(df: DataFrame, condition: Mapping[str, object]) -> DataFrame:
    """Conditioning by constants, in the column's own type; unknown columns are an error."""
    types = dict(df.dtypes)
    if missing := set(condition) - set(types):
        raise ValueError(f"no columns {sorted(missing)}")
    return df.withColumns({c: F.lit(v).cast(types[c]) for c, v in condition.items()})


def edit_condition(row: DataFrame, intervention: Mapping[str, object]) -> dict:
    """The non-null cells of the first row, with the intervention over them."""
    first = row.first()
    return {c: v for c, v in (first.asDict() if first else {}).items() if v is not None} | dict(intervention)


def smote_targets(df: DataFrame, target: str, fraction: float = 1.0, total: int | None = None) -> DataFrame:
    """class, n_real, n_target: (1 + fraction) * n rows of each class, or its share of a total, rounded down."""
    counts = df.groupBy(_q(target).alias("class")).agg(F.count("*").alias("n_real"))
    if total is not None:
        whole = Window.partitionBy(F.lit(0))
        return counts.withColumn("n_target", F.floor(F.col("n_real") * F.lit(float(total)) / F.sum("n_real").over(whole)).cast("long"))
    return counts.withColumn("n_target", F.floor(F.col("n_real") * F.lit(1.0 + fraction)).cast("long"))


def condition_frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, value, share: category frequencies, at least one each, normalised within the column."""
    counts = value_counts(df, list(columns))
    return counts.select("column", "value", (F.greatest("n", F.lit(1)) / F.sum(F.greatest("n", F.lit(1))).over(Window.partitionBy("column"))).alias("share"))


def condition_vectors(df: DataFrame, columns: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """sample_id, column, value: a column chosen evenly, then one of its categories by frequency. A column of NULLs gives none."""
    sizes, slots = weighted_slots(value_counts(df, list(columns)).drop("share"), ["column"])
    chosen = F.element_at(F.array(*[F.lit(c) for c in columns]), (F.pmod(hash_pick("id", seed=seed), F.lit(len(columns))) + 1).cast("int"))
    draws = df.sparkSession.range(n).select(F.col("id").alias("sample_id"), chosen.alias("column"), hash_pick("id", seed=seed + 1).alias("_pick"))
    return draw_weighted(draws, sizes, slots, ["column"]).select("sample_id", "column", "value")


def rows_for_conditions(df: DataFrame, conditions: DataFrame, columns: Sequence[str], key: str, seed: int = 0) -> DataFrame:
    """sample_id, matched and the columns of a row that meets the condition (sample_id, column, value as text): any of them
    evenly. Where no row does, matched is false and the row is any of the table. key is unique and not null.

    The index numbers a row once a column, by column, value and key in one order over ranges; a category is a stretch of it."""
    long = df.select(F.col(f"`{key}`").alias("_key"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _q(c).cast("string").alias("value")) for c in columns])).alias("c")).select("_key", "c.*")
    index = cut(with_row_number(long, ["column", "value", "_key"], "_spot"), "index")
    spans = index.groupBy("column", "value").agg(F.min("_spot").alias("_from"), F.count("*").alias("_n"))
    whole = index.where(F.col("column") == min(columns)).agg(F.min("_spot").alias("_whole_from"), F.count("*").alias("_whole_n"))
    asked = conditions.select("sample_id", "column", "value", hash_pick("sample_id", seed=seed).alias("_pick"))
    found = asked.join(spans, ["column", "value"], "left").join(F.broadcast(whole), F.lit(True))  # one row
    start, n = F.coalesce("_from", "_whole_from"), F.coalesce("_n", "_whole_n")
    at = found.where(n > 0).select("sample_id", F.col("_n").isNotNull().alias("matched"), (start + F.pmod("_pick", n)).alias("_spot"))
    return at.join(index.select("_spot", "_key"), "_spot").join(df, F.col("_key") == _q(key)).drop("_spot", "_key")


def in_train(df: DataFrame, key: Sequence[str], share: float = 0.8, seed: int = 42) -> DataFrame:
    return df.where(hash_fraction(*key, seed=seed) < share)

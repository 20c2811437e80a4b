"""Splits that depend on row keys only: the same rows always land in the same split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash_fraction
from ..functions.ordered import with_row_number
from .infer import task_type


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def hash_split(df: DataFrame, key: Sequence[str], share: float = 0.8, seed: int = 42, name: str = "split") -> DataFrame:
    """df with 'train' for about a share of the rows, else 'test'. No shuffle."""
    return df.withColumn(name, F.when(hash_fraction(*key, seed=seed) < share, "train").otherwise("test"))


def stratified_split(df: DataFrame, strata: Sequence[str], key: Sequence[str], share: float = 0.8, seed: int = 42, name: str = "split") -> DataFrame:
    """Within each stratum the rows with the smallest hashes, floor(n * share) of them but one at least and all but one at
    most, are 'train'; strata with a single row go to train.

    A stratum's cut is found from hash buckets: counts per bucket give the bucket that holds the cut, and only its rows are
    ranked, so a stratum of any size is never one task."""
    buckets = 4096
    rows = df.withColumn("_h", hash_fraction(*key, seed=seed)).withColumn("_b", F.floor(F.col("_h") * buckets).cast("int"))
    on = [F.col(f"`{c}`") for c in strata]
    named = rows.withColumn("_s", F.struct(*on))
    per = named.groupBy("_s", "_b").agg(F.count("*").alias("_n"))
    over = Window.partitionBy("_s").orderBy("_b")  # buckets, not rows
    per = per.select(
        "_s",
        "_b",
        F.coalesce(F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        "_n",
        F.sum("_n").over(Window.partitionBy("_s")).alias("_all"),
    )
    take = F.when(F.col("_all") == 1, 1).otherwise(F.greatest(F.lit(1), F.least(F.col("_all") - 1, F.floor(F.col("_all") * share))))
    per = per.withColumn("_left", take - F.col("_before")).select("_s", "_b", "_left", "_n")
    joined = named.join(per.withColumnsRenamed({"_s": "_t", "_b": "_c"}), F.col("_s").eqNullSafe(F.col("_t")) & (F.col("_b") == F.col("_c")))
    at_cut = (F.col("_left") > 0) & (F.col("_left") < F.col("_n"))
    rank = F.row_number().over(Window.partitionBy("_s", "_b", at_cut).orderBy("_h", *[_q(k) for k in key]))
    train = F.when(~at_cut, F.col("_left") > 0).otherwise(rank <= F.col("_left"))
    return joined.withColumn(name, F.when(train, "train").otherwise("test")).select(*df.columns, name)


def category_preserving_split(df: DataFrame, categories: Sequence[str], key: Sequence[str], share: float = 0.8, seed: int = 42, name: str = "split") -> DataFrame:
    """A hash split in which the first row (by hash) of each level of each column is in train, so train misses no level."""
    rows = df.withColumn("_h", hash_fraction(*key, seed=seed)).withColumn("_k", F.struct(*[_q(k) for k in key]))
    firsts = None
    for c in categories:
        f = rows.groupBy(_q(c)).agg(F.min(F.struct("_h", "_k")).alias("m")).select(F.col("m._k").alias("_first"))
        firsts = f if firsts is None else firsts.union(f)
    marked = rows.join(firsts.distinct(), F.col("_k").eqNullSafe(F.col("_first")), "left")
    return marked.withColumn(name, F.when(F.col("_first").isNotNull() | (F.col("_h") < share), "train").otherwise("test")).select(*df.columns, name)


def head_split(df: DataFrame, order: Sequence[str], share: float = 0.9, name: str = "split") -> DataFrame:
    """The first max(int(share * n), n - 1) rows are train."""
    n = df.count()
    cut = max(int(share * n), n - 1)
    return with_row_number(df, list(order), "_i").withColumn(name, F.when(F.col("_i") < cut, "train").otherwise("test")).drop("_i")


def resplit_validation(df: DataFrame, target: str, key: Sequence[str], split: str = "split", share: float = 0.8, seed: int = 777) -> DataFrame:
    """train and val rows are dealt anew, by stratum for a classification target; other rows keep their split."""
    pool = df.where(F.col(split).isin("train", "val"))
    task = task_type(pool, target).first()["task"]
    pool = pool.drop(split)
    new = hash_split(pool, key, share, seed, split) if task == "regression" else stratified_split(pool, [target], key, share, seed, split)
    new = new.withColumn(split, F.when(F.col(split) == "test", "val").otherwise("train"))
    return new.unionByName(df.where(~F.col(split).isin("train", "val")))


def even_shards(df: DataFrame, order: Sequence[str], shards: int | None = None, name: str = "shard") -> DataFrame:
    """1-based shards of consecutive rows; sizes differ by one at most, the first ones are larger. By default n / 1000 + 1."""
    n = df.count()
    p = shards or n // 1000 + 1
    base, extra = divmod(n, p)
    i = F.col("_i")
    large = extra * (base + 1)
    shard = F.when(i < large, F.floor(i / F.lit(base + 1))).otherwise(F.floor((i - large) / F.lit(max(base, 1))) + extra) + 1
    return with_row_number(df, list(order), "_i").withColumn(name, shard.cast("int")).drop("_i")


def subsample(df: DataFrame, key: Sequence[str], share: float, most: int = 1000, seed: int = 0) -> DataFrame:
    """min(int(n * share), most) rows, those with the smallest hashes."""
    n = min(int(df.count() * share), most)
    return df.withColumn("_h", hash_fraction(*key, seed=seed)).orderBy("_h", *[_q(k) for k in key]).limit(n).drop("_h")

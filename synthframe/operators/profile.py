"""Profiles: one wide aggregate over the table, unpivoted to a row per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame, booleans: bool = False) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) or (booleans and isinstance(f.dataType, T.BooleanType))]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def column_facts(df: DataFrame, facts: dict[str, callable], columns: list[str] | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """A row per column, from one aggregate: facts maps a result name to a function of the column's name."""
    columns = columns or df.columns
    types = types or {}
    aggregates = [F.struct(F.lit(c).alias("column"), *[fn(c).cast(types.get(name, "double")).alias(name) for name, fn in facts.items()]) for c in columns]
    return df.agg(F.array(*aggregates).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def distinct_count(c: str, nulls: bool = False) -> Column:
    """Distinct values; with nulls, NULL is one of them."""
    n = F.count_distinct(_q(c))
    return n + F.max(_q(c).isNull().cast("int")) if nulls else n


def numeric_profile(df: DataFrame, columns: list[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """column, n, mean, std (sample), min, max, median, q25, q75, zeros, zero_pct of numeric columns.

    Quantiles are exact (linear interpolation) by default, which keeps a column's distinct values in memory; `accuracy`
    takes a bounded sketch instead."""
    columns = columns or numeric_columns(df)

    shares = (0.25, 0.5, 0.75)

    def quantile(p: float):
        at, k = F.array(*map(F.lit, shares)), shares.index(p)  # one aggregate for all three
        return lambda c: (F.percentile_approx(_q(c), at, accuracy) if accuracy else F.percentile(_q(c).cast("double"), at))[k]

    facts = {
        "n": lambda c: F.count(_q(c)),
        "mean": lambda c: F.avg(_q(c)),
        "std": lambda c: F.stddev_samp(_q(c)),
        "min": lambda c: F.min(_q(c)),
        "max": lambda c: F.max(_q(c)),
        "median": quantile(0.5),
        "q25": quantile(0.25),
        "q75": quantile(0.75),
        "zeros": lambda c: F.count_if(_q(c) == 0),
        "zero_pct": lambda c: F.try_divide(F.count_if(_q(c) == 0) * 100.0, F.count(_q(c))),
    }
    return column_facts(df, facts, columns, {"n": "long", "zeros": "long"})


def standardized_summary(profile: DataFrame) -> DataFrame:
    """Of a numeric profile: columns, those that look standardized (|mean| < 0.1 and |std - 1| < 0.1), mean of means and of stds."""
    looks = (F.abs("mean") < 0.1) & (F.abs(F.col("std") - 1) < 0.1)
    return profile.agg(F.count("*").alias("n_columns"), F.count_if(looks).alias("n_standardized"), F.avg("mean").alias("mean_of_means"), F.avg("std").alias("mean_of_stds"))


def null_profile(df: DataFrame) -> DataFrame:
    """column, n_rows, n_null, null_pct, n_distinct of all columns."""
    plain = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    facts = {
        "n_rows": lambda c: F.count(F.lit(1)),
        "n_null": lambda c: F.count_if(_q(c).isNull()),
        "null_pct": lambda c: F.avg(_q(c).isNull().cast("double")) * 100,
        "n_distinct": distinct_count,
    }
    return column_facts(df, facts, plain, {"n_rows": "long", "n_null": "long", "n_distinct": "long"})


def values_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value (as text): a row for each cell; the shuffle that follows is by value, after partial counts."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), _q(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("r")).select("r.*")


def value_counts(df: DataFrame, columns: list[str], keep_nulls: bool = False) -> DataFrame:
    """column, value, n, share (of the column's counted rows)."""
    counts = values_long(df, columns)
    counts = (counts if keep_nulls else counts.where("value is not null")).groupBy("column", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("column")))


def top_values(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """column, value, n, share, rank: the k most frequent values, ties to the smaller value."""
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return value_counts(df, columns).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def extreme_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_values, most, most_n, least, least_n; ties to the smaller value. Counts are reduced, never ranked."""
    counts = value_counts(df, columns)
    return counts.groupBy("column").agg(
        F.count("*").alias("n_values"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("most"),
        F.max("n").alias("most_n"),
        F.min_by("value", F.struct("n", "value")).alias("least"),
        F.min("n").alias("least_n"),
    )


def dtype_histogram(df: DataFrame) -> DataFrame:
    """dtype, n_columns, from the schema alone."""
    spark = df.sparkSession
    return spark.createDataFrame([(t,) for _, t in df.dtypes], "dtype string").groupBy("dtype").agg(F.count("*").alias("n_columns"))


def dataset_stats(df: DataFrame, high: float = 0.8, first: int = 10) -> DataFrame:
    """n_rows, n_columns, n_numeric, n_categorical, missing_pct (of cells), n_high_cardinality (among the first columns)."""
    missing = sum((F.count_if(_q(c).isNull()) for c in df.columns), F.lit(0))
    many = sum(((F.count_distinct(_q(c)) > high * F.count(F.lit(1))).cast("int") for c in df.columns[:first]), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.lit(len(numeric_columns(df))).cast("long").alias("n_numeric"),
        F.lit(len(string_columns(df))).cast("long").alias("n_categorical"),
        F.try_divide(missing * 100.0, F.count(F.lit(1)) * len(df.columns)).alias("missing_pct"),
        many.cast("long").alias("n_high_cardinality"),
    )


def select_models(stats: dict) -> list[str]:
    """Model names that suit a table of this size, cheapest first."""
    rows, columns = stats["n_rows"], stats["n_columns"]
    chosen = ["identity", "marginals"]
    if columns <= 100:
        chosen += ["gaussian_copula", "bayesian_network"]
    if rows <= 10_000_000 and columns <= 50:
        chosen += ["smote", "cart"]
    return chosen if rows >= 50 else ["identity"]


def prompt_statistics(df: DataFrame, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """(numeric profile, k most frequent values of each string column): what a prompt tells about a table."""
    return numeric_profile(df), top_values(df, string_columns(df), k)


def column_info(df: DataFrame) -> DataFrame:
    """column, kind, min and max of numeric columns, n_categories of the others."""
    numbers = set(numeric_columns(df))
    facts = {
        "min": lambda c: F.min(_q(c)) if c in numbers else F.lit(None),
        "max": lambda c: F.max(_q(c)) if c in numbers else F.lit(None),
        "n_categories": lambda c: F.lit(None) if c in numbers else F.count_distinct(_q(c)),
    }
    kinds = F.when(F.col("column").isin(sorted(numbers)), "numeric").otherwise("categorical")
    return column_facts(df, facts, None, {"n_categories": "long"}).withColumn("kind", kinds)


def table_totals(tables: dict[str, DataFrame]) -> DataFrame:
    """table, n_rows, n_columns, n_numeric, n_categorical, n_missing of each table, and their sums as the table 'ALL'."""
    parts = []
    for name, df in tables.items():
        missing = sum((F.count_if(_q(c).isNull()) for c in df.columns), F.lit(0))
        facts = (len(df.columns), len(numeric_columns(df)), len(string_columns(df)))
        parts.append(df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n_rows"), *[F.lit(v).cast("long").alias(k) for k, v in zip(("n_columns", "n_numeric", "n_categorical"), facts)], missing.cast("long").alias("n_missing")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    sums = ("n_rows", "n_columns", "n_numeric", "n_categorical", "n_missing")
    return rows.rollup("table").agg(*[F.sum(c).alias(c) for c in sums]).fillna({"table": "ALL"})


def type_rollup(tables: dict[str, DataFrame], categories: dict[str, str] | None = None) -> DataFrame:
    """kind (dtype or category), name, n_columns over all tables, from their schemas alone. A column's category is that of
    the first prefix in categories that its name starts with, else 'other'."""
    spark = next(iter(tables.values())).sparkSession
    rows = [("dtype", t) for df in tables.values() for _, t in df.dtypes]
    rows += [("category", next((v for k, v in (categories or {}).items() if c.startswith(k)), "other")) for df in tables.values() for c in df.columns]
    return spark.createDataFrame(rows, "kind string, name string").groupBy("kind", "name").agg(F.count("*").alias("n_columns"))


def segment_report(df: DataFrame) -> DataFrame:
    """feature, mean, max, total, nonzero_pct of the columns that segment_features makes: activation rates of seg_<id>,
    loads of seg_hash_<k>, segments a row. One aggregate; a table without rows gives NULLs."""
    names = [c for c in df.columns if c == "num_segments" or c.startswith("seg_")]
    facts = {
        "mean": lambda c: F.avg(_q(c)),
        "max": lambda c: F.max(_q(c)),
        "total": lambda c: F.sum(_q(c)),
        "nonzero_pct": lambda c: F.avg((_q(c) > 0).cast("double")) * 100,
    }
    return column_facts(df, facts, names, {"max": "long", "total": "long"}).withColumnRenamed("column", "feature")

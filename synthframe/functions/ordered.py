"""Running sums and row numbers over a whole table without a one-task window.

A window without PARTITION BY puts all rows into one task. Here the table is range-partitioned by the order, each range
sums its own rows, and only one number per range goes through a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    return cut(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)),
        "ranged",
    )


def running_sums(df: DataFrame, order: str, sums: list[str], by: list[str] = ()) -> DataFrame:
    """df with cum_<s> for each of sums (rows up to and including this one, within `by`), and next_<order>, total_<s>.

    (by, order) has to be unique."""
    by = list(by)
    rows = _ranged(df, [*by, order])
    parts = rows.groupBy(*by, "_range").agg(F.min(order).alias("_first"), *[F.sum(s).alias(f"_sum_{s}") for s in sums])
    over = Window.partitionBy(*by).orderBy("_range") if by else Window.orderBy("_range")  # one row a range
    before, whole = over.rowsBetween(Window.unboundedPreceding, -1), (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1)))
    parts = parts.select(
        *by,
        "_range",
        F.lead("_first").over(over).alias("_after"),
        *[F.coalesce(F.sum(f"_sum_{s}").over(before), F.lit(0)).alias(f"_before_{s}") for s in sums],
        *[F.sum(f"_sum_{s}").over(whole).alias(f"total_{s}") for s in sums],
    )
    local = Window.partitionBy(*by, "_range").orderBy(order)
    return (
        rows.join(parts, [*by, "_range"])
        .select(
            *[c for c in df.columns],
            F.coalesce(F.lead(order).over(local), "_after").alias(f"next_{order}"),
            *[(F.sum(s).over(local.rowsBetween(Window.unboundedPreceding, 0)) + F.col(f"_before_{s}")).alias(f"cum_{s}") for s in sums],
            *[f"total_{s}" for s in sums],
        )
    )


def with_row_number(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """df with its row number from 0 in the given order."""
    rows = _ranged(df, order)
    counts = rows.groupBy("_range").count()
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    counts = counts.select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(counts, "_range").withColumn(name, F.col("_before") + local).drop("_at", "_range", "_before")

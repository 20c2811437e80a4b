from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import with_row_number
from ..operators.encode import restore_type
from ..operators.neighbors import nearest
from ..operators.profile import numeric_columns
from ..operators.sample import uniform
from ..session import cut
from .base import Synthesizer, register


class Smote(Synthesizer):
    """Rows between a row and one of its k nearest neighbours of the same class (numbers standardised): numbers are
    interpolated, other columns take the value of one of the two. Classes keep their shares; without numbers, or for a
    class of one row, rows are drawn as they are. For a regression the classes are the target's values up to and above its
    median, and the target is interpolated like the other numbers.

    Neighbours among all rows are looked for when rows are drawn, for the rows that are drawn."""

    def __init__(self, seed: int = 0, target: str | None = None, k: int = 5, edge: float = 0.0, regression: bool = False):
        super().__init__(seed)
        self.target, self.k, self.edge, self.regression = target, k, edge, regression

    def _fit(self, df: DataFrame) -> None:
        target = self.target or df.columns[-1]
        self.state["target"] = target
        numbers = [c for c in numeric_columns(df) if c != target or self.regression]
        self.state["numbers"] = numbers
        rows = cut(with_row_number(df, df.columns, "_row"), "smote")
        self.tables["rows"] = rows
        self.state["n"] = rows.count()
        if not numbers:
            return
        row = rows.agg(*[F.struct(F.avg(f"`{c}`"), F.stddev_pop(f"`{c}`")).alias(c) for c in numbers]).first()
        z = F.array(*[F.coalesce((F.col(f"`{c}`") - F.lit(row[c][0])) / F.lit(row[c][1] or 1.0), F.lit(0.0)) for c in numbers])
        own = F.col(f"`{target}`")
        if self.regression:
            own = own > F.lit(rows.agg(F.percentile(own.cast("double"), F.lit(0.5))).first()[0])
        self.tables["points"] = rows.select("_row", z.alias("z"), F.coalesce(own.cast("string"), F.lit("")).alias("c"))

    def _sample(self, n: int, seed: int) -> DataFrame:
        rows = self.tables["rows"]
        draws = self.spark.range(n).select("id", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(self.state["n"], 1))).alias("_row"))
        own = draws.join(rows, "_row")
        if "points" not in self.tables:
            return own
        points = self.tables["points"]
        drawn = points.join(draws.select("_row").distinct(), "_row", "left_semi")
        near = cut(nearest(drawn, points, self.k, id_column="_row", vector="z", label="c", exclude_self=True).select("id", "near_id", "rank"), "near")
        many = near.withColumn("of", F.max("rank").over(Window.partitionBy("id"))).withColumnsRenamed({"id": "_row"})
        turn = draws.join(many, "_row").where(F.col("rank") == F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.col("of")) + 1).select("id", "near_id")
        other = rows.select(F.col("_row").alias("near_id"), *[F.col(f"`{c}`").alias(f"_b_{c}") for c in self.state["columns"]])
        both = own.join(turn, "id", "left").join(other, "near_id", "left")
        step = F.lit(self.edge / 2) + uniform(seed + 2, F.col("id")) * F.lit(1 - self.edge)
        out = []
        for c in self.state["columns"]:
            a, b = F.col(f"`{c}`"), F.coalesce(F.col(f"`_b_{c}`"), F.col(f"`{c}`"))
            if c in self.state["numbers"]:
                out.append(restore_type(a + step * (b - a), self.state["types"][c]).alias(c))
            else:
                out.append(F.when(uniform(seed + 3, F.col("id"), F.lit(c)) < step, b).otherwise(a).alias(c))
        return both.select(*out)


register("smote", Smote)

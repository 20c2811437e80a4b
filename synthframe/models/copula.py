"""Marginals, alone or joined by a Gaussian copula. Drawing is a projection over range(n), and a join for each text column of
very many values: no Python."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import normal_quantile
from ..operators.encode import inverse_quantile, quantile_knots, restore_type, uniform_from_knots
from ..operators.profile import numeric_columns, value_counts
from ..operators.sample import draw_category, standard_normal, uniform, weighted_slots
from ..session import cut, discard
from .base import Synthesizer, register


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function (Zelen and Severo's approximation, error below 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


class IndependentMarginals(Synthesizer):
    """Each column for itself: numbers by interpolated quantiles, others by their levels' shares; NULLs by theirs.

    A text column of up to `levels` values is literals in the plan; one of more keeps them all as a table that draws are
    joined with."""

    def __init__(self, seed: int = 0, knots: int = 101, levels: int = 500):
        super().__init__(seed)
        self.knots, self.levels = knots, levels

    def _fit(self, df: DataFrame) -> None:
        numbers = numeric_columns(df)
        others = [c for c in df.columns if c not in numbers]
        n = max(df.count(), 1)
        nulls = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns]).first()
        self.state["nulls"] = {c: (nulls[c] or 0) / n for c in df.columns}
        self.state["quantiles"] = {c: quantile_knots(df, c, self.knots) for c in numbers}
        shares: dict[str, list] = {c: [] for c in others}
        self.state["wide"] = {}
        if others:
            counts = cut(value_counts(df, others), "levels")
            many = [r["column"] for r in counts.groupBy("column").count().where(F.col("count") > self.levels).collect()]
            for r in counts.where(~F.col("column").isin(*many or [""])).collect():
                shares[r["column"]].append([r["value"], r["share"]])
            for c in many:
                k = df.columns.index(c)
                sizes, slots = weighted_slots(counts.where(F.col("column") == c).drop("share"), ["column"])
                facts = sizes.first()
                self.state["wide"][c] = [k, facts["_total"], facts["_width"]]
                self.tables[f"wide{k}"] = cut(slots.drop("column"), "slots")
            discard(counts)
        self.state["shares"] = {c: sorted(v) for c, v in shares.items()}

    def _draw(self, c: str, u: Column, seed: int) -> Column:
        kind = self.state["types"][c]
        if c in self.state["quantiles"]:
            q = self.state["quantiles"][c]
            value = restore_type(inverse_quantile(u, q), kind) if q else F.lit(None).cast(kind)
        elif c in self.state["wide"]:
            value = F.col(f"_value{self.state['wide'][c][0]}").cast(kind)
        else:
            shares = self.state["shares"][c]
            value = draw_category([tuple(s) for s in shares], u).cast(kind) if shares else F.lit(None).cast(kind)
        gone = self.state["nulls"][c]
        return F.when(uniform(seed + 17, F.col("id"), F.lit(c)) >= gone, value) if gone else value

    def _drawn(self, rows: DataFrame, u: dict[str, Column], seed: int) -> DataFrame:
        """rows (with id) as the table's columns, each drawn at its u; a value of a wide column is found by its slot."""
        for c, (k, total, width) in self.state["wide"].items():
            slots = self.tables[f"wide{k}"].select(F.col("_slot").alias(f"_slot{k}"), F.col("_lo").alias(f"_lo{k}"), F.col("_hi").alias(f"_hi{k}"), F.col("value").alias(f"_value{k}"))
            at = F.least(F.floor(u[c] * F.lit(total)), F.lit(total - 1)).cast("long")
            rows = rows.withColumn(f"_at{k}", at).withColumn(f"_slot{k}", F.expr(f"_at{k} div {width}")).join(slots, f"_slot{k}").where(f"_at{k} >= _lo{k} and _at{k} < _hi{k}")
        return rows.select(*[self._draw(c, u[c], seed).alias(c) for c in self.state["columns"]])

    def _sample(self, n: int, seed: int) -> DataFrame:
        return self._drawn(self.spark.range(n), {c: uniform(seed, F.col("id"), F.lit(c)) for c in self.state["columns"]}, seed)


class GaussianCopula(IndependentMarginals):
    """Marginals whose normal scores have the table's correlations. A text level's score is the middle of its share."""

    def _score(self, c: str) -> Column:
        x = F.col(f"`{c}`")
        if c in self.state["quantiles"]:
            q = self.state["quantiles"][c]
            u = uniform_from_knots(x.cast("double"), q) if q else F.lit(0.5)
        elif c in self.state["wide"]:
            u = F.col(f"_mid{self.state['wide'][c][0]}")
        else:
            u, acc = F.lit(None).cast("double"), 0.0
            total = sum(s for _, s in self.state["shares"][c]) or 1.0
            for value, share in self.state["shares"][c]:
                u = F.when(x.cast("string") == F.lit(value), acc + share / total / 2).otherwise(u)
                acc += share / total
        p = F.coalesce(F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), u)), F.lit(0.5))
        return p

    def _fit(self, df: DataFrame) -> None:
        super()._fit(df)
        names = self.state["columns"]
        for c, (k, total, width) in self.state["wide"].items():
            once = self.tables[f"wide{k}"].where(F.expr(f"_slot = _lo div {width}"))  # a row a value
            mids = once.select(F.col("value").alias(f"_value{k}"), ((F.col("_lo") + F.col("_hi")) / (2.0 * total)).alias(f"_mid{k}"))
            df = df.join(mids, F.col(f"`{c}`").cast("string") == F.col(f"_value{k}"), "left")
        scored = df.select(*[self._score(c).alias(f"p{k}") for k, c in enumerate(names)])
        scored = scored.select(*[normal_quantile(f"p{k}").alias(f"z{k}") for k in range(len(names))])
        vectors = VectorAssembler(inputCols=scored.columns, outputCol="v").transform(scored).select("v")
        r = np.nan_to_num(Correlation.corr(vectors, "v").first()[0].toArray(), nan=0.0) if len(names) > 1 else np.eye(1)
        np.fill_diagonal(r, 1.0)
        w, v = np.linalg.eigh((r + r.T) / 2)
        r = (v * np.maximum(w, 1e-6)) @ v.T
        d = np.sqrt(np.diag(r))
        self.state["cholesky"] = np.linalg.cholesky(r / d[:, None] / d[None, :] + 1e-9 * np.eye(len(r))).tolist()

    def _sample(self, n: int, seed: int) -> DataFrame:
        names, low = self.state["columns"], self.state["cholesky"]
        rows = self.spark.range(n).select("id", *[standard_normal(seed + 101 * k, F.col("id"), F.lit(k)).alias(f"e{k}") for k in range(len(names))])
        mixed = rows.select("id", *[sum((F.col(f"e{j}") * float(low[k][j]) for j in range(k + 1)), F.lit(0.0)).alias(f"z{k}") for k in range(len(names))])
        return self._drawn(mixed, {c: normal_cdf(F.col(f"z{k}")) for k, c in enumerate(names)}, seed)


register("marginals", IndependentMarginals)
register("gaussian_copula", GaussianCopula)


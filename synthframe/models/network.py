"""A Bayesian network over a maximum-spanning tree of mutual information, plain or with noisy counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.metrics import maximum_spanning_tree, mutual_information
from ..operators.sample import uniform
from ..session import cut
from .base import Discretizer, Synthesizer, register


class BayesianNetwork(Synthesizer):
    """Each column depends on one other (Chow-Liu). Conditional tables are counts; rows are drawn parents first, each
    step a join with one row per parent value that holds its children's cumulated shares (as many as the child has levels)."""

    def __init__(self, seed: int = 0, bins: int = 20):
        super().__init__(seed)
        self.bins = bins

    def _counts(self, binned: DataFrame, parent: str | None, child: str) -> DataFrame:
        up = F.col(f"`{parent}`") if parent else F.lit("")
        return binned.groupBy(up.alias("up"), F.col(f"`{child}`").alias("value")).agg(F.count("*").cast("double").alias("n"))

    def _fit(self, df: DataFrame) -> None:
        names = self.state["columns"]
        d = Discretizer.fit(df, self.bins)
        self.state["edges"] = d.edges
        binned = cut(d.encode(df), "binned")
        mi = mutual_information(binned, names) if len(names) > 1 else None
        self.state["tree"] = maximum_spanning_tree(mi, names) if mi is not None else [(None, names[0])]
        for k, (parent, child) in enumerate(self.state["tree"]):
            counts = self._counts(binned, parent, child)
            whole = Window.partitionBy("up")
            shares = counts.withColumn("cum", F.sum("n").over(whole.orderBy(F.col("value").asc_nulls_last())) / F.sum("n").over(whole))
            self.tables[f"cpt{k}"] = cut(shares.groupBy("up").agg(F.array_sort(F.collect_list(F.struct("cum", "value"))).alias("options")), "cpt")

    def _sample(self, n: int, seed: int) -> DataFrame:
        rows = self.spark.range(n)
        for k, (parent, child) in enumerate(self.state["tree"]):
            cpt = self.tables[f"cpt{k}"]
            up = F.col(f"`{parent}`") if parent else F.lit("")
            u = uniform(seed + k, F.col("id"))
            rows = rows.withColumn("_u", u).join(cpt, up.eqNullSafe(F.col("up")), "left")
            pick = F.coalesce(F.get(F.filter("options", lambda o: o["cum"] > F.col("_u")), F.lit(0)), F.element_at("options", -1))
            rows = rows.withColumn(child, pick["value"]).drop("_u", "up", "options")
        d = Discretizer(self.state["edges"], self.state["types"])
        return rows.select(*[d.decode(c, F.col(f"`{c}`"), uniform(seed + 1000, F.col("id"), F.lit(c))).alias(c) for c in self.state["columns"]])


class PrivateMarginals(BayesianNetwork):
    """The network with Laplace noise of scale columns / epsilon on its counts. The tree and the bins' edges are taken
    from the data as they are, so this is a noise-protected release of marginals, not a formal privacy guarantee."""

    def __init__(self, seed: int = 0, bins: int = 20, epsilon: float = 1.0):
        super().__init__(seed, bins)
        self.epsilon = epsilon

    def _counts(self, binned: DataFrame, parent: str | None, child: str) -> DataFrame:
        counts = super()._counts(binned, parent, child)
        u = uniform(self.seed + 31, F.lit(child), "up", "value") - 0.5
        noise = -F.signum(u) * F.ln(1 - 2 * F.abs(u)) * len(self.state["columns"]) / self.epsilon
        return counts.withColumn("n", F.greatest(F.lit(1e-3), F.col("n") + noise))


register("bayesian_network", BayesianNetwork)
register("private_marginals", PrivateMarginals)

"""A chain of decision trees: each column is drawn from the leaf that the columns before it lead to."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash_pick
from ..operators.encode import label_codes, level_table
from ..operators.metrics import dependency_order, mutual_information
from ..operators.profile import numeric_columns
from ..operators.sample import draw_weighted, uniform, weighted_slots
from ..session import cut
from .base import Discretizer, Synthesizer, register


class CartChain(Synthesizer):
    """Columns in order of their mutual information; the first is drawn from its own values, each later one from the values
    that the training rows in its tree's leaf have. Leaf values are kept as counts, so a leaf of any size is a few rows."""

    def __init__(self, seed: int = 0, depth: int = 8, least: int = 5, levels: int = 100):
        super().__init__(seed)
        self.depth, self.least, self.levels = depth, least, levels

    def _fit(self, df: DataFrame) -> None:
        names, numbers = self.state["columns"], set(numeric_columns(df))
        binned = Discretizer.fit(df, 10).encode(df)
        self.state["order"] = dependency_order(mutual_information(binned, names), names) if len(names) > 1 else names
        coded = df
        for k, c in enumerate(names):
            if c in numbers:
                coded = coded.withColumn(f"_x{k}", F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)))
            else:
                self.tables[f"levels{k}"] = cut(level_table(df, c), "levels")
                coded = label_codes(coded, c, f"_x{k}").withColumn(f"_x{k}", F.col(f"_x{k}").cast("double") + 1)
        coded = cut(coded, "coded")
        self.trees = {}
        for at, c in enumerate(self.state["order"]):
            leafed = coded.withColumn("_leaf", F.lit(0.0))
            if at:
                inputs = [f"_x{names.index(o)}" for o in self.state["order"][:at]]
                y = f"_x{names.index(c)}"
                features = VectorAssembler(inputCols=inputs, outputCol="_f").transform(coded)
                numeric = c in numbers or coded.agg(F.max(y)).first()[0] > self.levels
                kind = DecisionTreeRegressor if numeric else DecisionTreeClassifier
                tree = kind(featuresCol="_f", labelCol=y, leafCol="_leaf", maxDepth=self.depth, minInstancesPerNode=self.least, seed=self.seed).fit(features)
                self.trees[c] = tree
                leafed = tree.transform(features)
            counts = leafed.groupBy("_leaf", F.col(f"`{c}`").alias("value"), F.col(f"_x{names.index(c)}").alias("x")).agg(F.count("*").alias("n"))
            sizes, slots = weighted_slots(cut(self._leaf_counts(counts, c), "counts"), ["_leaf"])
            self.tables[f"size{at}"], self.tables[f"leaf{at}"] = cut(sizes, "size"), cut(slots, "leaf")

    def _leaf_counts(self, counts: DataFrame, column: str) -> DataFrame:
        return counts

    def _sample(self, n: int, seed: int) -> DataFrame:
        names, order = self.state["columns"], self.state["order"]
        rows = self.spark.range(n)
        for at, c in enumerate(order):
            if at:
                inputs = [f"_x{names.index(o)}" for o in order[:at]]
                kept = rows.columns
                rows = self.trees[c].transform(VectorAssembler(inputCols=inputs, outputCol="_f").transform(rows)).select(*[f"`{k}`" for k in kept], "_leaf")
            else:
                rows = rows.withColumn("_leaf", F.lit(0.0))
            leaf = self.tables[f"leaf{at}"].withColumnsRenamed({"value": "_value", "x": f"_x{names.index(c)}"})
            drawn = draw_weighted(rows.withColumn("_pick", hash_pick("id", seed=seed + at)), self.tables[f"size{at}"], leaf, ["_leaf"])
            rows = cut(drawn.drop("_leaf").withColumnRenamed("_value", c).fillna({f"_x{names.index(c)}": 0.0}), "chain")
        return rows

    def save(self, folder: str) -> None:
        self.state["regressed"] = sorted(c for c, tree in self.trees.items() if isinstance(tree, DecisionTreeRegressionModel))
        super().save(folder)
        for c, tree in self.trees.items():
            tree.write().overwrite().save(f"{folder}/tree{self.state['columns'].index(c)}")

    def load_parts(self, folder: str) -> None:
        self.trees = {}
        for c in self.state["order"][1:]:
            kind = DecisionTreeRegressionModel if c in self.state["regressed"] else DecisionTreeClassificationModel
            self.trees[c] = kind.load(f"{folder}/tree{self.state['columns'].index(c)}")


class PrivateCartChain(CartChain):
    """Leaf counts get Laplace noise of scale columns / epsilon, and values whose noisy count falls below one are gone,
    unless a leaf would be empty. The trees' splits are taken from the data as they are: no formal guarantee."""

    def __init__(self, seed: int = 0, depth: int = 6, least: int = 20, levels: int = 100, epsilon: float = 1.0):
        super().__init__(seed, depth, least, levels)
        self.epsilon = epsilon

    def _leaf_counts(self, counts: DataFrame, column: str) -> DataFrame:
        u = uniform(self.seed + 53, F.lit(column), "_leaf", "x") - 0.5
        noisy = counts.withColumn("n", F.col("n").cast("double") - F.signum(u) * F.ln(1 - 2 * F.abs(u)) * len(self.state["columns"]) / self.epsilon)
        most = F.max("n").over(Window.partitionBy("_leaf"))
        return noisy.withColumn("_most", most).where((F.col("n") >= 1) | (F.col("n") == F.col("_most"))).withColumn("n", F.greatest(F.lit(1), F.rint("n").cast("long"))).drop("_most")


register("cart", CartChain)
register("private_cart", PrivateCartChain)

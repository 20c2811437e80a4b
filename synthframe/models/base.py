"""The models' common life: fit, sample, condition, edit, save and load."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.encode import quantile_knots, restore_type
from ..operators.profile import numeric_columns
from ..operators.sample import edit_condition, overwrite
from ..sources.files import read_json, write_json

_MODELS: dict[str, type[Synthesizer]] = {}


def register(name: str, cls: type[Synthesizer]) -> None:
    """Add a model of one's own under a name."""
    if not (isinstance(cls, type) and issubclass(cls, Synthesizer)):
        raise TypeError(f"{cls!r} is no Synthesizer")
    _MODELS[name.lower()] = cls
    cls.name = name.lower()


def registered() -> list[str]:
    return sorted(_MODELS)


def create(name: str, **parameters) -> Synthesizer:
    try:
        return _MODELS[name.lower()](**parameters)
    except KeyError:
        raise ValueError(f"unknown model {name!r}; there are {', '.join(registered())}") from None


class Synthesizer:
    """state holds what a fitted model has learned, in JSON; tables names DataFrames it keeps besides."""

    name = ""

    def __init__(self, seed: int = 0):
        self.seed = seed
        self.state: dict = {}
        self.tables: dict[str, DataFrame] = {}
        self.spark: SparkSession | None = None

    def fit(self, df: DataFrame) -> Synthesizer:
        if not df.columns:
            raise ValueError("a table without columns can't be fitted")
        self.spark = df.sparkSession
        self.state = {"columns": df.columns, "types": dict(df.dtypes)}
        self._fit(df)
        return self

    def sample(self, n: int, condition: Mapping | None = None, seed: int | None = None) -> DataFrame:
        """Exactly n rows; the same seed gives the same rows. A condition sets columns to constants."""
        if not self.state:
            raise RuntimeError("fit the model first")
        rows = self._sample(n, self.seed if seed is None else seed).select(*[f"`{c}`" for c in self.state["columns"]])
        return overwrite(rows, condition) if condition else rows

    def edit(self, row: DataFrame, intervention: Mapping, n: int = 1) -> DataFrame:
        """n rows like the given one, with an intervention."""
        return self.sample(n, edit_condition(row, intervention))

    def finetune(self, df: DataFrame) -> Synthesizer:
        return self.fit(df)

    def save(self, folder: str) -> None:
        write_json(self.spark, f"{folder}/model.json", {"model": self.name, "seed": self.seed, "state": self.state, "tables": sorted(self.tables), "parameters": self.parameters()})
        for name, t in self.tables.items():
            t.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")

    def load_parts(self, folder: str) -> None:
        """What a model keeps beside its state and tables."""

    def parameters(self) -> dict:
        return {k: v for k, v in vars(self).items() if k not in ("state", "tables", "spark") and isinstance(v, (int, float, str, bool, type(None)))}

    def _fit(self, df: DataFrame) -> None:
        raise NotImplementedError

    def _sample(self, n: int, seed: int) -> DataFrame:
        raise NotImplementedError


def load_model(spark: SparkSession, folder: str) -> Synthesizer:
    facts = read_json(spark, f"{folder}/model.json")
    model = create(facts["model"], **facts["parameters"])
    model.spark, model.state = spark, facts["state"]
    model.tables = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in facts["tables"]}
    model.load_parts(folder)
    return model


def to_json(state: dict) -> str:
    return json.dumps(state, sort_keys=True, default=str)


class Discretizer:
    """Numbers as quantile bins and back: a bin's value is drawn evenly between its edges. Text stays as it is."""

    def __init__(self, edges: dict[str, list[float]], types: dict[str, str]):
        self.edges, self.types = edges, types

    @staticmethod
    def fit(df: DataFrame, bins: int = 20) -> Discretizer:
        return Discretizer({c: sorted(set(quantile_knots(df, c, bins + 1))) for c in numeric_columns(df)}, dict(df.dtypes))

    def encode(self, df: DataFrame) -> DataFrame:
        return df.select(*[self._bin(c).alias(c) for c in df.columns])

    def _bin(self, c: str) -> Column:
        if c not in self.edges:
            return F.col(f"`{c}`").cast("string")
        inner = F.array(*[F.lit(float(e)) for e in self.edges[c][1:-1]]) if len(self.edges[c]) > 2 else F.array().cast("array<double>")
        x = F.col(f"`{c}`").cast("double")
        return F.when(x.isNotNull(), F.size(F.filter(inner, lambda e: e < x))).cast("string")

    def decode(self, c: str, value: Column, u: Column) -> Column:
        if c not in self.edges:
            return value.cast(self.types[c])
        edges = [float(e) for e in self.edges[c]] or [0.0]
        low = F.get(F.array(*[F.lit(e) for e in edges]), value.cast("int"))
        high = F.get(F.array(*[F.lit(e) for e in [*edges[1:], edges[-1]]]), value.cast("int"))
        return restore_type(low + u * (high - low), self.types[c])

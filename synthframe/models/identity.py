from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.sample import bootstrap, cycle
from ..session import cut
from .base import Synthesizer, register


class Identity(Synthesizer):
    """The training rows themselves: in order and again from the start, or drawn with replacement."""

    def __init__(self, seed: int = 0, resample: bool = False):
        super().__init__(seed)
        self.resample = resample

    def _fit(self, df: DataFrame) -> None:
        self.tables["rows"] = cut(df, "identity")

    def _sample(self, n: int, seed: int) -> DataFrame:
        rows, order = self.tables["rows"], self.state["columns"]
        return (bootstrap(rows, n, order, seed) if self.resample else cycle(rows, n, order)).drop("sample_id")


register("identity", Identity)

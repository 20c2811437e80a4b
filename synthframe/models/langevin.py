from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import with_row_number
from ..operators.encode import restore_type
from ..operators.neighbors import BLOCK, _waves
from ..operators.profile import numeric_columns
from ..operators.sample import bootstrap
from ..session import cut, ship
from .base import Synthesizer, register


def _meet(x: np.ndarray, classes: list, state: dict, wave) -> None:
    """Add a wave of training rows to the state: the nearest row so far, and the sum of unit vectors from rows of one's class."""
    ids, rows, row_classes = wave
    codes = {v: k for k, v in enumerate(dict.fromkeys(row_classes))}
    coded, own = np.array([codes[v] for v in row_classes]), np.array([codes.get(v, -1) for v in classes], np.int64)
    norm = (rows * rows).sum(1)
    for k in range(0, len(x), BLOCK):
        part = slice(k, k + BLOCK)
        y = x[part]
        total = (y * y).sum(1)[:, None] + norm[None, :]
        d = np.maximum(total - 2 * (y @ rows.T), 0)
        r, t = np.nonzero(d < 1e-9 * total)  # cancelled: worked out from differences
        d[r, t] = ((y[r] - rows[t]) ** 2).sum(1)
        d = np.sqrt(d)
        at = d.argmin(1)
        least, near_id = d[np.arange(len(y)), at], ids[at]
        better = (least < state["least"][part]) | ((least == state["least"][part]) & (near_id < state["near_id"][part]))
        for name, value in (("least", least), ("near_id", near_id), ("near", rows[at])):
            state[name][part][better] = value[better]
        if state["classed"]:
            same = coded[None, :] == own[part, None]
            weight = np.divide(same, d, out=np.zeros_like(d), where=d > 1e-12)
            state["pull"][part] += y * weight.sum(1)[:, None] - weight @ rows
            state["same_n"][part] += same.sum(1)


def _gradient(x: np.ndarray, state: dict) -> np.ndarray:
    """Of the energy: the distance to the nearest training row plus the mean distance to those of one's class."""
    away = x - state["near"]
    return away / np.maximum(np.linalg.norm(away, axis=1), 1e-12)[:, None] + state["pull"] / (state["same_n"] + 1e-6)[:, None]


def _fresh(n: int, width: int, classed: bool) -> dict:
    return {"least": np.full(n, np.inf), "near_id": np.full(n, np.iinfo(np.int64).max), "near": np.zeros((n, width)), "pull": np.zeros((n, width)), "same_n": np.zeros(n, np.int64), "classed": classed}


_STATE = "sample_id long, x array<double>, c string, least double, near_id long, near array<double>, pull array<double>, same_n long"


def _advance(wave, first: int, last: int, opens: bool, steps: int, size: float, noise: float, seed: int, classed: bool):
    """Steps first to last - 1 against a wave. A step's first wave moves the rows by what the step before has gathered."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, classes = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            x = np.array(batch.column(1).to_pylist(), float).reshape(len(ids), -1)
            state = {k: np.array(batch.column(k).to_pylist()) for k in ("least", "near_id", "near", "pull", "same_n")} | {"classed": classed}
            draws = np.stack([np.random.default_rng([seed & 0xFFFFFFFF, int(i)]).normal(size=(steps + 1, x.shape[1])) for i in ids]) if opens else None
            for s in range(first, last):
                if opens:
                    x = x - size * _gradient(x, state) + np.sqrt(2 * size) * noise * draws[:, s] if s else x + noise * draws[:, 0]
                    state = _fresh(len(ids), x.shape[1], classed)
                _meet(x, classes, state, wave.value)
            vectors = pa.list_(pa.float64())
            columns = [pa.array(ids), pa.array(list(x), vectors), batch.column(2), pa.array(state["least"]), pa.array(state["near_id"]), pa.array(list(state["near"]), vectors), pa.array(list(state["pull"]), vectors), pa.array(state["same_n"])]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


class LangevinSampler(Synthesizer):
    """Bootstrap rows whose (standardised) numbers are moved by stochastic gradient Langevin steps on an energy over all
    training rows: the distance to the nearest, plus the mean distance to those with the drawn row's target (not where the
    target is a number). The target is then that of the nearest training row; other columns stay as drawn.

    `target` names a column, the last one unless given. Training rows come in waves; if there are several, each step and
    wave is a job."""

    def __init__(self, seed: int = 0, steps: int = 25, size: float = 0.02, noise: float = 0.01, target: str | None = None):
        super().__init__(seed)
        self.steps, self.size, self.noise, self.target = steps, size, noise, target

    def _fit(self, df: DataFrame) -> None:
        target = self.target or df.columns[-1]
        if target not in df.columns:
            raise ValueError(f"no column {target!r} for a target")
        numbers = [c for c in numeric_columns(df) if c != target]
        self.state |= {"numbers": numbers, "target": target, "classed": target not in numeric_columns(df)}
        self.tables["rows"] = cut(df, "langevin")
        if numbers:
            row = df.agg(*[F.struct(F.avg(f"`{c}`"), F.stddev_pop(f"`{c}`")).alias(c) for c in numbers]).first()
            self.state["scale"] = [[row[c][0] or 0.0, row[c][1] or 1.0] for c in numbers]

    def _sample(self, n: int, seed: int) -> DataFrame:
        ship(self.spark)
        rows, numbers, target = self.tables["rows"], self.state["numbers"], self.state["target"]
        drawn = bootstrap(rows, n, self.state["columns"], seed)
        if not numbers:
            return drawn
        drawn = cut(drawn, "drawn")
        moved, base = self._moved(drawn, rows, seed)
        if moved is None:
            return drawn
        found = moved.join(base.select(F.col("_id").alias("near_id"), F.col(f"`{target}`").alias("_target")), "near_id")
        both = drawn.join(found.select("sample_id", F.col("x").alias("_x"), "_target"), "sample_id")

        def column(c: str):
            if c == target:
                return F.col("_target")
            if c not in numbers:
                return F.col(f"`{c}`")
            k = numbers.index(c)
            mean, deviation = self.state["scale"][k]
            return restore_type(F.col("_x")[k] * F.lit(deviation) + F.lit(mean), self.state["types"][c])

        return both.select(*[column(c).alias(c) for c in self.state["columns"]])

    def _moved(self, drawn: DataFrame, rows: DataFrame, seed: int):
        """(drawn rows after all steps with their nearest training row's id, the training rows with ids)"""
        numbers, classed = self.state["numbers"], self.state["classed"]
        scaled = F.array(*[(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) - F.lit(m)) / F.lit(d) for c, (m, d) in zip(numbers, self.state["scale"], strict=True)])
        label = F.col(f"`{self.state['target']}`").cast("string") if classed else F.lit(None).cast("string")
        base = cut(with_row_number(rows, self.state["columns"], "_id"), "numbered")
        waved = cut(base.select(F.col("_id").alias("id"), scaled.alias("v"), label.alias("c")), "base")
        zero = F.array_repeat(F.lit(0.0), len(numbers))
        state = drawn.select("sample_id", scaled.alias("x"), label.alias("c"), F.lit(0.0).alias("least"), F.lit(0).cast("long").alias("near_id"), zero.alias("near"), zero.alias("pull"), F.lit(0).cast("long").alias("same_n"))

        def meet(wave, first: int, last: int, opens: bool) -> DataFrame:
            sent = self.spark.sparkContext.broadcast(wave)
            after = cut(state.mapInArrow(_advance(sent, first, last, opens, self.steps, self.size, self.noise, seed, classed), _STATE), "moved")
            sent.destroy()
            return after

        waves = _waves(waved, 1)
        head = list(itertools.islice(waves, 2))
        if len(head) < 2:
            return (meet(head[0], 0, self.steps + 1, True) if head else None), base
        for s in range(self.steps + 1):
            for k, wave in enumerate(_waves(waved, 1)):
                state = meet(wave, s, s + 1, k == 0)
        return state, base


register("langevin", LangevinSampler)

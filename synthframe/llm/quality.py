"""Quality classifier: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

Random Fourier features (cosines of random projections) stand for a Gaussian kernel over a document's statistics, so
kernel ridge regression is a linear fit: each partition sums its own part of the normal equations, and only the sums
meet. A fold of the labelled rows that the fit hasn't seen turns raw scores into probabilities by isotonic regression.
Labels are joined to texts as a bounded broadcast, so neither fit nor scoring moves a text."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import SLICE_ROWS, map_columns, read, serve, texts_of

#: Labelled rows that the model is fitted on, about, at most (16 bytes each when broadcast), and partitions of their sums.
LABEL_ROWS, FIT_PARTITIONS = 50_000, 16
#: Random features, kernel width in standard deviations of a statistic, ridge penalty a row, seed.
FEATURES, WIDTH, RIDGE, SEED = 256, 3.0, 1e-4, 20240229
#: Digits of a raw score.
DIGITS = 9

STATISTICS = 16
_BYTES = np.arange(256)
_UPPER, _LOWER, _DIGIT = (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 97) & (_BYTES <= 122), (_BYTES >= 48) & (_BYTES <= 57)
_SPACE, _HIGH = np.isin(_BYTES, [9, 10, 11, 12, 13, 32]), _BYTES >= 128
_STOP = np.isin(_BYTES, list(b".,;:?'-"))
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _HIGH | _STOP)
_CLASSES = np.column_stack((_UPPER, _DIGIT, _SPACE, _HIGH, _STOP, _SYMBOL)).astype(np.float64)


def statistics(text: str | None) -> list[float]:
    """What the score sees of a whole text; all zero for an empty one."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * STATISTICS
    n, size = len(words), len(data)
    shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASSES / size
    lines = data.split(b"\n")
    sentences = data.split(b". ")
    pairs = max(1, n - 1)
    return [
        np.log1p(size),
        np.log1p(n),
        size / n,
        *shares,
        len(set(words)) / n,
        len(set(zip(words, words[1:], strict=False))) / pairs,
        sum(map(eq, words, words[1:])) / pairs,
        sum(map(bytes.isupper, words)) / n,
        len(set(lines)) / len(lines),
        len(set(sentences)) / len(sentences),
        len(zlib.compress(data, 1)) / size,
    ]


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # raw scores
    levels: np.ndarray  # calibrated, rising

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(raw_scores(x, self.mean, self.scale, self.weights), self.knots, self.levels), 0.0, 1.0)


def raw_scores(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rounded, so that equal texts score equally in batches of any size."""
    return np.round(features((x - mean) / scale) @ weights, DIGITS)


def features(z: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    rng = np.random.default_rng(SEED)
    w = rng.normal(0, 1 / WIDTH, (z.shape[1], FEATURES))
    b = rng.uniform(0, 2 * np.pi, FEATURES)
    return np.column_stack((np.sqrt(2 / FEATURES) * np.cos(np.clip(z, -8, 8) @ w + b), np.ones(len(z))))


def isotonic(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (raw score, calibrated probability) at the blocks' means, rising. Equal scores are one block."""
    values, at, rows = np.unique(raw, return_inverse=True, return_counts=True)
    blocks: list[list[float]] = []  # sum of raw, sum of labels, rows
    for r, y, n in zip(values.tolist(), np.bincount(at, label).tolist(), rows.tolist(), strict=True):
        blocks.append([r * n, y, float(n)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    total = np.array(blocks)
    return total[:, 0] / total[:, 2], total[:, 1] / total[:, 2]


def _rows(column) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(-1, STATISTICS)


def _sums(model):
    """For mapInArrow: a partition's part of the normal equations (without a model: of the moments)."""

    def run(batches):
        total = None
        for batch in batches:
            x, y = _rows(batch.column(0)), batch.column(1).to_numpy().astype(np.float64)
            z = np.column_stack((np.ones(len(x)), x, x * x)) if model is None else features((x - model[0]) / model[1])
            part = (z.sum(0),) if model is None else (z.T @ z, z.T @ y)
            total = part if total is None else tuple(a + b for a, b in zip(total, part, strict=True))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([t.ravel() for t in total]).tobytes()])], names=["sums"])

    return run


def _total(rows: DataFrame, model) -> np.ndarray:
    parts = [np.frombuffer(r["sums"]) for r in rows.mapInArrow(_sums(model), "sums binary").collect()]  # FIT_PARTITIONS rows
    return np.sum(sorted(parts, key=bytes), axis=0) if parts else np.empty(0)


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = LABEL_ROWS) -> QualityModel | None:
    """Fit on labelled rows whose crc32(doc_id as text) mod 5 is not 0; remainder 1 calibrates. None without rows to learn from.

    Repeated labels of a doc_id count once (the highest); null labels and ids don't count."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).where(fold != 0)
    n = known.count()
    if not n:
        return None
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, rows / n))) if n > rows else known
    labelled = texts_of(docs).join(F.broadcast(chosen), "doc_id").select("text", "quality", fold.alias("fold"), F.xxhash64("doc_id").alias("h"))

    def make():
        return lambda c: {"x": [statistics(t) for t in c["text"]], "y": c["quality"], "fold": c["fold"], "h": c["h"]}

    data = cut(map_columns(labelled, make, "x array<double>, y int, fold long, h long").repartition(FIT_PARTITIONS, "h"), "labelled")
    fit = data.where("fold <> 1").select("x", "y")
    sums = _total(fit, None)
    if not len(sums) or sums[0] < 2:
        return None
    mean = sums[1 : 1 + STATISTICS] / sums[0]
    scale = np.sqrt(np.maximum(sums[1 + STATISTICS :] / sums[0] - mean**2, 0))
    scale = np.where(scale > 1e-9, scale, 1.0)
    both = _total(fit, (mean, scale))
    k = FEATURES + 1
    weights = np.linalg.solve(both[: k * k].reshape(k, k) + RIDGE * sums[0] * np.eye(k), both[k * k :])
    held = data.where("fold = 1").select("x", "y").toPandas()  # a quarter of the bounded sample
    if not len(held):
        return QualityModel(mean, scale, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    raw = raw_scores(np.array(held["x"].tolist()), mean, scale, weights)
    return QualityModel(mean, scale, weights, *isotonic(raw, held["y"].to_numpy(np.float64)))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold) of every row.

    A null text is scored as an empty one; a null doc_id isn't held out; repeated rows get equal scores; without labels
    every score is 0.5. Labels, lang, source and doc_id are no inputs of a score; other columns are not read."""
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels))

    def make():
        serve("quality")
        own = model.value

        def fn(cols: dict) -> dict:
            x = np.array([statistics(t) for t in cols["text"]]).reshape(-1, STATISTICS)
            return {"doc_id": cols["doc_id"], "score": own.score(x) if own else np.full(len(x), 0.5)}

        return fn

    scored = map_columns(texts_of(docs), make, "doc_id long, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs, with all its columns, without the rows that the classifier rejects.

    A row whose score is the threshold stays. A null text is scored as an empty one, by which both stay or go; repeated
    rows do so together; rows without a doc_id are scored like others. Without labels to learn from all rows stay."""
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels))
    at = docs.columns.index("text")

    def run(batches):
        serve("quality")
        own = model.value
        for whole in batches:
            for first in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(first, SLICE_ROWS)
                if own:
                    x = np.array([statistics(t) for t in batch.column(at).to_pylist()]).reshape(-1, STATISTICS)
                    batch = batch.filter(pa.array(own.score(x) >= threshold))
                yield batch

    return docs.mapInArrow(run, docs.schema)


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), 0.3)

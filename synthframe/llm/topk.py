"""Exact top-k search by a three-phase uniform threshold.

Vectors lie in cells of a coarse clustering, in order, so a block of neighbouring rows is compact and the range of each of
its dimensions bounds what any of its items can score. A vector's dimensions are cut into lists, and an item's score is the
sum of its entries in them. Phase one gathers, per query, the local k best scores of the few cells nearest to it; the k-th
best of those is a safe cutoff. Phase two sends the cutoffs back: blocks whose lists' bounds add up to less are skipped,
and of the others only items are collected that have an entry of at least cutoff / lists in some list. Phase three
resolves those exactly, from the entries at hand. A task keeps the k best a query; tasks' lists meet in a tree. Queries
travel in waves of a fixed size, and each wave's result is written out, so broadcasts are bounded however many there are."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import read
from .vector_dedup import spherical_kmeans
from .vectors import matrices, vectors_of

#: Lists that dimensions are cut into, queries of a wave (32 MB of 64 dimensions), queries handled side by side.
LISTS, WAVE, SIDE = 4, 1 << 16, 1024
#: Rows of a block at most; vectors that cells are trained on, about, at most; rows a cell, about; cells at most.
BLOCK, SAMPLE, CELL, CELLS = 1024, 16_384, 2048, 256
#: Results that a task holds before it cuts them back to the k best a query; branches that tasks' lists meet in first.
HELD, BRANCHES = 1 << 20, 64


@dataclass
class Wave:
    """The queries of one length: ids in order, integer vectors, the cells that phase one looks at, and the cutoffs."""

    ids: np.ndarray
    q: np.ndarray
    near: np.ndarray
    least: np.ndarray


def _blocks(batches):
    """(cell, ids, integer matrix) of rows that come sorted by cell."""
    for batch in batches:
        cells, ids = batch.column(2).to_numpy(), batch.column(0).to_numpy()
        for rows, x in matrices(batch, 1):
            own = cells[rows]
            starts = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]))
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                for k in range(a, b, BLOCK):
                    part = slice(k, min(k + BLOCK, b))
                    yield int(own[a]), ids[rows[part]], np.floor(64 * x[part])


def _cuts(n: int) -> list[slice]:
    edges = np.linspace(0, n, min(LISTS, n) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def entries(q: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """Products list by list: through doubles where these are exact, else as 64-bit integers, else as whole numbers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most >= 2**53:
        whole = np.int64 if most < 2**62 else object
        q, x = (m.astype(np.int64) if whole is np.int64 else np.array([[int(v) for v in r] for r in m.tolist()], object).reshape(m.shape) for m in (q, x))
    return [q[:, c] @ x[:, c].T for c in _cuts(q.shape[1])]


def scores(parts: list[np.ndarray]) -> np.ndarray:
    """Sums of the entries; what a 64-bit integer doesn't hold is its largest or smallest."""
    total = sum(parts)
    return np.clip(total, -(2**63) + 1, 2**63 - 1) if total.dtype == object else total


def bounds(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """What no item of the block exceeds, for each query: the lists' bounds from the ranges of the dimensions, summed."""
    with np.errstate(over="ignore", invalid="ignore"):
        most = np.maximum(q, 0) @ x.max(0) + np.minimum(q, 0) @ x.min(0)
    room = np.abs(most) * 1e-9 + 1  # for rounding
    return np.where(np.isfinite(most), most + room, np.inf)


class Best:
    """The k best results of each query that a task has seen: score descending, then vec_id."""

    def __init__(self, k: int):
        self.k, self.parts, self.held = k, [], 0

    def add(self, query: np.ndarray, item: np.ndarray, score: np.ndarray) -> bool:
        """True if the results have been cut back."""
        self.parts.append((query, item, score.astype(np.int64)))
        self.held += len(query)
        if self.held < HELD:
            return False
        self.result()
        return True

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return (np.empty(0, np.int64),) * 3
        query, item, score = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((item, -score, query))
        query, item, score = query[order], item[order], score[order]
        first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
        keep = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query)))) < self.k
        self.parts = [(query[keep], item[keep], score[keep])]
        # a query with many equal results keeps k, so what is held is bounded by queries, not by rows
        self.held = 0
        return self.parts[0]


def scan(blocks, waves: dict[int, Wave], k: int, near: bool, skipped: list | None = None):
    """The local k best of each query of each length: (query ids, item ids, scores).

    near: phase one, only blocks of a query's near cells, without cutoff. Else phases two and three: blocks whose bound
    reaches the cutoff, and of those the items with an entry of cutoff / lists."""
    best = {n: Best(k) for n in waves}
    least = {n: w.least.copy() for n, w in waves.items()}
    for cell, ids, x in blocks:
        n = x.shape[1]
        if n not in waves:
            continue
        wave = waves[n]
        use = wave.near[:, cell] if near else bounds(wave.q, x) >= least[n]
        which = np.flatnonzero(use)
        if skipped is not None:
            skipped.append(len(use) - len(which))
        for a in range(0, len(which), SIDE):
            at = which[a : a + SIDE]
            t = np.full(len(at), -np.inf) if near else least[n][at]
            parts = entries(wave.q[at], x)
            score = scores(parts)
            enough = score >= t[:, None]
            if not near:
                entry = np.zeros(enough.shape, bool)
                for p in parts:
                    entry |= p >= (t / len(parts))[:, None] - 1e-9 * np.abs(t)[:, None]
                enough &= entry
            enough &= wave.ids[at][:, None] != ids[None, :]
            if enough.shape[1] > k:  # ties to the smaller id: only what can be among the block's k best
                held = np.where(enough, score, -(2**63) + 1 if score.dtype == object else -np.inf) if score.dtype != np.int64 else np.where(enough, score, -(2**63) + 1)
                enough &= score >= np.partition(held, held.shape[1] - k, 1)[:, held.shape[1] - k][:, None]
            r, i = np.nonzero(enough)
            if len(r) and best[n].add(at[r], ids[i], score[r, i]) and not near:
                query, _, kept = best[n].result()
                full = np.flatnonzero(np.bincount(query, minlength=len(wave.ids)) == k)
                last = np.searchsorted(query, full, "right") - 1
                least[n][full] = np.maximum(least[n][full], kept[last])
    for n, wave in waves.items():
        query, item, score = best[n].result()
        yield wave.ids[query], item, score


def _scan(waves, k: int, near: bool):
    """For mapInArrow."""

    def run(batches):
        for query, item, score in scan(_blocks(batches), waves.value, k, near):
            if len(query):
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(item), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def _k_best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their rank, through a tree of two levels."""
    order = [F.desc("score"), "vec_id"]
    some = Window.partitionBy("query_id", "branch").orderBy(*order)
    found = found.withColumn("branch", F.pmod(F.spark_partition_id(), F.lit(BRANCHES))).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    return found.drop("branch").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def _centres(rows: DataFrame) -> dict[int, np.ndarray]:
    """Cells' unit centroids by vector length, from a bounded sample; they change only speed."""
    n = rows.count()
    share = int((1 << 20) * min(1.0, SAMPLE / max(n, 1)))
    sample = rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 20)) < share).select("vec_id", "v").toPandas().sort_values("vec_id")
    found = {}
    for dim, group in sample.groupby(sample["v"].map(len)):
        x = np.array(group["v"].tolist(), np.float64)
        size = np.linalg.norm(x, axis=1)
        x = x[(size > 0) & np.isfinite(size)] / size[(size > 0) & np.isfinite(size)][:, None]
        if len(x):
            found[dim] = spherical_kmeans(x, max(1, min(CELLS, len(x) // 4, n // CELL)))
    return found


def _near(q: np.ndarray, centre: np.ndarray | None, cells: np.ndarray, k: int) -> np.ndarray:
    """Which cells phase one looks at for each query: the nearest ones until they hold more than k rows."""
    if centre is None:
        return np.ones((len(q), len(cells)), bool)
    order = np.argsort(-(q @ centre.T), 1, kind="stable")
    rows = np.cumsum(cells[order], 1)
    near = np.zeros((len(q), len(cells)), bool)
    np.put_along_axis(near, order, rows - cells[order] <= k, 1)
    return near


def _assign(centres):
    """For mapInArrow: vec_id, v and the cell of each row."""

    def run(batches):
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int32)
            for rows, x in matrices(batch, 1):
                if (centre := centres.value.get(x.shape[1])) is not None:
                    scale = np.abs(x).max(1)
                    cell[rows] = (x / np.where(scale > 0, scale, 1)[:, None] @ centre.T).argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell)], names=["vec_id", "v", "cell"])

    return run


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products of floor(64 * x), all if there
    are fewer, ties to the smaller vec_id. Rows with a query's vec_id are its own and don't count.

    Null vectors, and such with null or non-finite components, take no part, neither do null ids nor components whose 64-fold
    a double doesn't hold; scores beyond 64 bits are the largest or smallest 64-bit number. Vectors of another length than
    the query's don't meet it. Rows that repeat a vec_id are candidates of their own; a query with several vectors is the
    smallest of them. Inputs need vec_id and embedding (arrays of numbers); other columns are not read."""
    spark = vectors.sparkSession
    sc = spark.sparkContext
    held = "vec_id is not null and forall(v, x -> abs(x) < 2.8e306D)"
    usable = cut(vectors_of(vectors).where(held), "vectors")
    centres = _centres(usable)
    told = sc.broadcast(centres)
    placed = usable.mapInArrow(_assign(told), "vec_id long, v array<double>, cell int")
    rows = cut(placed.repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id"), "cells")
    sizes = {(r["dim"], r["cell"]): r["count"] for r in rows.groupBy(F.size("v").alias("dim"), "cell").count().collect()} if centres else {}  # CELLS rows a length
    asked = cut(vectors_of(queries).where(held).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    waves = max(1, -(-asked.count() * 10 // (9 * WAVE)))
    parts = []
    for w in range(waves):
        mine = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == w).toPandas()
        packed = {}
        for n, group in mine.groupby(mine["v"].map(len)):
            group = group.sort_values("vec_id")
            q, centre = np.floor(64 * np.array(group["v"].tolist(), np.float64)), centres.get(n)
            cells = np.array([sizes.get((n, c), 0) for c in range(1 if centre is None else len(centre))])
            packed[n] = Wave(group["vec_id"].to_numpy(np.int64), q, _near(q, centre, cells, k), np.full(len(q), -np.inf))
        first = sc.broadcast(packed)
        schema = "query_id long, vec_id long, score long"
        last = _k_best(rows.mapInArrow(_scan(first, k, True), schema), k).where(F.col("rank") == k).select("query_id", "score").toPandas()  # a number for each query of the wave
        cutoff = last.set_index("query_id")["score"]
        for wave in packed.values():
            wave.least = cutoff.reindex(wave.ids).to_numpy(np.float64, na_value=-np.inf)
        second = sc.broadcast(packed)
        parts.append(cut(_k_best(rows.mapInArrow(_scan(second, k, False), schema), k), "top"))
        first.destroy()
        second.destroy()
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_exact_top_k(spark, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings")
    return exact_top_k(table, table.where("vec_id % 20 = 0"), 20)


ORACLE = {
    "op5_exact_top_k": """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) e from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) as bigint) score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0 and len(q.e) = len(c.e)
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
select query_id, cast(rank as int) rank, vec_id, score from r where rank <= 20
"""
}

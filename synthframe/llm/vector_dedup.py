"""Embedding near-dedup: spherical k-means cells, blocked cosine products inside a cell, one representative a group.

Cells come from a bounded sample; every vector is assigned. A vector enters its nearest cell and those nearly as near, so
pairs over a border still meet; a pair that meets in several cells counts in the smallest one. Within a cell and label,
vectors fall into blocks, and a task gets two blocks: no cell, however crowded, is one task, and pairs never become rows,
only each vector's number of links and a spanning forest."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .common import connected_components, read, spanning_roots
from .vectors import matrices, vectors_of

#: Vectors that k-means is trained on, about, at most; vectors a cell, about; cells at most (2 MB of 64 dimensions).
SAMPLE, CELL, CELLS, ROUNDS, SEED = 20_000, 512, 4096, 12, 7
#: Cells a vector enters, at most, and the loss of cosine to the nearest centroid up to which it does.
NEAR, MARGIN = 4, 0.12
#: Vectors in a block: 1/16 of the cell within these bounds.
BLOCK = (128, 2048)


def spherical_kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids of unit vectors; an empty cell starts again from the vector that fits its centroid worst."""
    rng = np.random.default_rng(SEED)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        close = x @ centre.T
        own = close.argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1)
        lost = np.flatnonzero(norm == 0)
        if len(lost):
            total[lost] = x[np.argsort(close.max(1), kind="stable")[: len(lost)]]
            norm[lost] = 1
        centre = total / norm[:, None]
    return centre


def _assign(centres):
    """For mapInArrow: a row for each cell that a vector enters."""

    def run(batches):
        for batch in batches:
            ids, labels = batch.column(0), batch.column(2)
            for rows, x in matrices(batch, 1):
                size = np.linalg.norm(x, axis=1)
                scale = np.abs(x).max(axis=1)  # norms of very large or small vectors leave the range of doubles
                odd = (scale > 0) & ((size == 0) | ~np.isfinite(size))
                x[odd] /= scale[odd, None]
                keep = scale > 0
                rows, x = rows[keep], x[keep]
                if not len(rows):
                    continue
                centre = centres.value.get(x.shape[1])
                close = x / np.linalg.norm(x, axis=1)[:, None] @ centre.T if centre is not None else np.zeros((len(x), 1))
                m = min(NEAR, close.shape[1])
                near = np.argsort(-close, 1, kind="stable")[:, :m]
                use = np.take_along_axis(close, near, 1) >= close.max(1)[:, None] - MARGIN
                cells = np.where(use, near, -1)
                who, which = np.nonzero(use)
                at = pa.array(rows[who])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cells[who, which].astype(np.int32)),
                        pa.array(np.full(len(who), x.shape[1], np.int32)),
                        labels.take(at),
                        ids.take(at),
                        pa.array([c.tobytes() for c in cells.astype(np.int32)[who]]),
                        pa.array([v.tobytes() for v in x[who]]),
                    ],
                    names=["cell", "dim", "label", "vec_id", "cells", "v"],
                )

    return run


def _block_links(threshold: float):
    """For applyInPandas: the links between two blocks of a cell -> links and a smaller linked vector, for each vector with links."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cell, i, j = key[0], key[3], key[4]
        one = i == j
        left, right = (rows, rows) if one else (rows[rows["b"] == i], rows[rows["b"] == j])
        empty = pd.DataFrame({"vec_id": [], "links": [], "root": []}, dtype="int64")
        if not len(left) or not len(right):
            return empty
        x, y = (np.frombuffer(b"".join(p["v"]), np.float64).reshape(len(p), -1) for p in (left, right))
        close = x @ y.T
        close /= np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None, :]
        a, b = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        linked = (close >= threshold) & (a[:, None] != b[None, :])
        row, col = np.nonzero(linked)
        if not len(row):
            return empty
        p, q = (np.frombuffer(b"".join(s["cells"]), np.int32).reshape(len(s), -1) for s in (left, right))
        for first in range(0, len(row), 1 << 18):  # the pair counts in the smallest cell that both are in
            r, c = row[first : first + (1 << 18)], col[first : first + (1 << 18)]
            both = np.where((p[r][:, :, None] == q[c][:, None, :]).any(2) & (p[r] >= 0), p[r], np.iinfo(np.int32).max)
            linked[r, c] = both.min(1) == cell
        if one:
            ids, square, links = a, linked, linked.sum(1)
        else:
            ids = np.concatenate((a, b))
            square = np.zeros((len(ids), len(ids)), bool)
            square[: len(a), len(a) :] = linked
            square |= square.T
            links = square.sum(1)
        root = spanning_roots(square)
        some = links > 0
        return pd.DataFrame({"vec_id": ids[some], "links": links[some], "root": ids[root[some]]})

    return run


def embedding_near_dedup(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id (smallest vec_id reachable over links), kept (vec_id = component_id), one row per vector.

    Vectors of equal, non-null label and equal length link when their cosine in double precision is at least threshold.
    Null and zero vectors, and such with null or non-finite components, link with nothing and are kept. Rows that repeat
    a vec_id are one node, don't link with each other, and share the sum of their links. A null vec_id stays a row
    without links or component. Links found are exact; which pairs meet is a matter of cells (see README for the recall)."""
    spark = vectors.sparkSession
    usable = vectors_of(vectors, "label").where("vec_id is not null and label is not null")
    n = usable.count()
    share = int((1 << 20) * min(1.0, SAMPLE / max(n, 1)))
    sample = usable.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share).select("vec_id", "v").toPandas().sort_values("vec_id")
    centres = {}
    for dim, group in sample.groupby(sample["v"].map(len)):
        x = np.array(group["v"].tolist(), np.float64)
        size = np.linalg.norm(x, axis=1)
        x = x[(size > 0) & np.isfinite(size)] / size[(size > 0) & np.isfinite(size)][:, None]
        if len(x):
            centres[dim] = spherical_kmeans(x, max(1, min(CELLS, len(x) // 4, n // CELL)))
    schema = T.StructType(
        [T.StructField("cell", T.IntegerType()), T.StructField("dim", T.IntegerType()), T.StructField("label", vectors.schema["label"].dataType), T.StructField("vec_id", T.LongType())]
        + [T.StructField("cells", T.BinaryType()), T.StructField("v", T.BinaryType())]
    )
    assigned = usable.select("vec_id", "v", "label").mapInArrow(_assign(spark.sparkContext.broadcast(centres)), schema)
    key = ["cell", "dim", "label"]
    low, high = BLOCK
    crowd = assigned.groupBy(*key).count().where("count > 1")
    crowd = crowd.select(*key, F.expr(f"cast(ceil(count / greatest({low}, least({high}, count div 16))) as int)").alias("blocks"))
    tasks = (
        assigned.join(crowd, key)
        .withColumn("b", F.expr("cast(pmod(xxhash64(vec_id), blocks) as int)"))
        .withColumn("o", F.expr("explode(sequence(0, blocks - 1))"))
        .select(*key, F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "vec_id", "cells", "v")
    )
    found = cut(tasks.groupBy(*key, "i", "j").applyInPandas(_block_links(threshold), "vec_id long, links long, root long"), "links")
    links = found.groupBy("vec_id").agg(F.sum("links").alias("n"))
    components = connected_components(found.select(F.col("vec_id").alias("src"), F.col("root").alias("dst")))
    component = F.coalesce("component", "vec_id")
    return (
        vectors.select(vectors["vec_id"].cast("long").alias("vec_id"))
        .join(links, "vec_id", "left")
        .join(components.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
    )


def op9_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(read(spark, sf_dir, "embeddings"), 0.93)


ORACLE = {
    "op9_embedding_dedup": """
with v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) e from embeddings
  where embedding is not null and label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), u as (select *, sqrt(list_dot_product(e, e)) n from v where list_dot_product(e, e) > 0),
links as (select a.vec_id s, b.vec_id t from u a join u b on a.label = b.label and a.vec_id <> b.vec_id where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
reach as (
  with recursive r(s, t) as (select vec_id, vec_id from embeddings union select r.s, l.t from r join links l on l.s = r.t)
  select s, min(t) c from r group by 1
), n as (select s, count(*) n from links group by 1)
select e.vec_id, cast(coalesce(n.n, 0) as bigint) n_links, reach.c component_id, e.vec_id = reach.c kept
from embeddings e left join n on n.s = e.vec_id left join reach on reach.s = e.vec_id
"""
}

"""What the operators share: reading tables, Arrow-batched maps, connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut, discard, ship

#: Rows that Python holds as objects at a time, whatever the size of an Arrow batch, and bytes of texts.
SLICE_ROWS, SLICE_BYTES = 1024, 1 << 22


#: A worker's caches by operator, and the operator that the worker served last.
_caches: dict[str, dict] = {}
_served = ""


def worker_cache(operator: str, cache: dict) -> dict:
    """Name a worker's cache that goes when the worker serves another operator."""
    _caches[operator] = cache
    return cache


def serve(operator: str) -> None:
    """To be called where a task begins: workers outlive operators, so what others have cached goes, and its memory with it."""
    global _served
    if operator != _served:
        _served = operator
        for name, cache in _caches.items():
            if name != operator:
                cache.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # freed memory goes back to the system where there is a way to ask for it
            ctypes.CDLL(None).malloc_trim(0)


_BATCH_ROWS, _BATCH_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession):
    """Queries planned in here hand Python SLICE_ROWS rows and SLICE_BYTES bytes at a time: whole batches of texts take tens
    of MB in the executor and again in the worker."""
    before = {k: spark.conf.get(k, None) for k in (_BATCH_ROWS, _BATCH_BYTES)}
    spark.conf.set(_BATCH_ROWS, str(SLICE_ROWS))
    spark.conf.set(_BATCH_BYTES, str(SLICE_BYTES))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id and text alone: other columns, whatever their names, stay out of the way."""
    ship(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def byte_slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose strings of a column have `most` bytes, or that are one row."""
    texts = batch.column(column)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(ends, int(ends[start]) + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def small_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of SLICE_ROWS rows at most, and of SLICE_BYTES in the text column, if there is one."""
    for start in range(0, batch.num_rows, SLICE_ROWS):
        part = batch.slice(start, SLICE_ROWS)
        if "text" in part.schema.names:
            yield from byte_slices(part, part.schema.names.index("text"), SLICE_BYTES)
        else:
            yield part


def map_columns(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow over slices: make() runs once a task; what it returns turns {column: list} into {column: list or array}."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        fn = make()
        for batch in batches:
            for part in small_slices(batch):
                out = fn({name: part.column(k).to_pylist() for k, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def spanning_roots(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix: the smallest index that each row reaches. Each row is read once."""
    n = len(linked)
    root = np.full(n, -1, np.int64)
    for first in range(n):
        if root[first] >= 0:
            continue
        root[first] = first
        frontier = np.array([first])
        while len(frontier):
            fresh = linked[frontier].any(axis=0) & (root < 0)
            frontier = np.flatnonzero(fresh)
            root[frontier] = first
    return root


#: Keys that `spread_join` broadcasts, at most.
HOT_KEYS = 4096


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left joined (inner or left) with right, a table with one row a key and `rows`, the key's rows in left.

    Keys with more than 1 / HOT_KEYS of all rows can be HOT_KEYS at most: their side is broadcast and their rows stay where
    they are. The others meet by a shuffle in which no key is large."""
    total = right.agg(F.sum("rows")).first()[0] or 0
    crowded = F.col("rows") * HOT_KEYS > total
    hot = F.broadcast(right.where(crowded))
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right.where(~crowded), on, how)
    met = left.join(hot, on)
    return met.unionByName(rest)


def sorted_runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """The rows of each key, of batches that come sorted by their first n_keys columns (whole numbers, not null)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(k).to_numpy() for k in range(n_keys)])
        starts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)])).tolist()
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(keys[a].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(src, dst) -> (node, component), component the smallest node reachable; only nodes with an edge appear.

    Alternating large-star and small-star rounds: neighbourhoods are only ever reduced to their minimum, so a hub of any
    degree is never gathered; its join rows can be split by the skew join. Each round is a table in the shared folder,
    and only a row count and a checksum come to the driver."""
    e = cut(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(),
        "edges",
    )
    seen = None
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")  # so that a hub's rows can be split
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        before = e
        e = cut(small, "edges")
        discard(before, least)
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

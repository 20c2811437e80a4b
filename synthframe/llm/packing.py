"""Best-fit packing with Martello-Toth dominance reduction.

A packing only depends on how many pieces there are of each length, so the plan is made on that histogram (at most
`capacity` rows, however many documents): first the reduction fixes sets that provably dominate every other set with
the same longest piece, then best-fit-decreasing packs what is left, length by length, many equal bins at a time. The
plan is a table of runs (pieces of one length -> bins of one pattern); pieces find theirs by rank within their length,
which comes from per-task counts and their running sums, so no length is ever gathered or sorted in one task.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import byte_slices, read, serve, texts_of
from .word_tokens import GROUP, ids_bytes, piece_tables, vocabulary


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Martello-Toth reduction on a histogram: (sets fixed, each with its number of bins), and the counts that remain.

    For the longest piece j of a bin, with room = capacity - j, a set dominates all others when everything that could
    stand beside j fits into what the set holds beside it:
    - nothing fits beside j: {j};
    - a piece of exactly `room` exists: {j, k} (any other company of j fits into k's place);
    - no two pieces fit together beside j: {j, the longest that fits};
    - no three fit together, and the best two that fit are no longer than the longest one that fits, k: {j, k}.
    Fixing a set changes what is left, so rounds go on until none fixes anything."""
    counts = {k: n for k, n in counts.items() if n > 0}
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...], times: int) -> None:
        fixed.append((lengths, times))
        for x, n in Counter(lengths).items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]

    def pair_times(j: int, k: int) -> int:
        return counts[j] // 2 if j == k else min(counts[j], counts[k])

    for j in sorted(counts, reverse=True):  # exact fits dominate whatever else is left
        k = capacity - j
        if j >= k and j in counts and k in counts and (times := pair_times(j, k)):
            take((j, k), times)
    changed = True
    while changed:
        changed = False
        for j in sorted(counts, reverse=True):
            while j in counts:
                room = capacity - j
                lengths = sorted(counts)
                at = bisect.bisect_right(lengths, room)
                fits = [x for x in lengths[:at] if counts[x] - (x == j) > 0]
                if not fits:
                    take((j,), counts[j])
                    changed = True
                    break
                k = fits[-1]
                least = [x for x in fits[:3] for _ in range(min(3, counts[x] - (x == j)))][:3]
                two = len(least) > 1 and least[0] + least[1] <= room
                three = len(least) > 2 and sum(least) <= room
                if two and (three or k < _best_pair(fits, {x: counts[x] - (x == j) for x in fits}, room)):
                    break
                take((j, k), pair_times(j, k))  # what fits only shrinks, so the reason holds for each of these pairs
                changed = True
        if not changed:
            break
    return fixed, counts


def _best_pair(lengths: list[int], counts: dict[int, int], room: int) -> int:
    """The largest sum of two pieces within room; 0 if there is none."""
    best, hi = 0, len(lengths) - 1
    for lo in range(len(lengths)):
        while hi >= lo and (lengths[lo] + lengths[hi] > room or (hi == lo and counts[lengths[lo]] < 2)):
            hi -= 1
        if hi < lo:
            break
        best = max(best, lengths[lo] + lengths[hi])
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit-decreasing on a histogram: bins as ([(length, how many)], number of such bins).

    What piece-by-piece best fit does: the fullest bin that still has room takes the next piece, again and again until it
    has no room for that length; then the next bin. Equal bins are handled together."""
    open_bins: dict[int, list[tuple[tuple, int]]] = {}
    rooms: list[int] = []

    def put(room: int, content: tuple, n: int) -> None:
        if n:
            if room not in open_bins:
                bisect.insort(rooms, room)
            open_bins.setdefault(room, []).append((content, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                content, n = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
            else:
                room, content, n = capacity, (), -(-left // (capacity // length))
            q = room // length
            full = min(n, left // q)
            put(room - q * length, ((length, q), content), full)
            left -= full * q
            if full < n and left:
                put(room - left * length, ((length, left), content), 1)
                n, left = n - 1, 0
            put(room, content, n - full)
    out = []
    for groups in open_bins.values():
        for content, n in groups:
            parts = []
            while content:
                part, content = content
                parts.append(part)
            if parts:
                out.append((parts[::-1], n))
    return out


def plan(counts: dict[int, int], capacity: int) -> tuple[dict[str, np.ndarray], int]:
    """Runs in the order (length, first rank): pieces of a run fill `each` places of every bin from `bin` on, at `offset`; and the number of bins."""
    fixed, rest = reduce_instance(counts, capacity)
    bins = [([(x, n) for x, n in sorted(Counter(lengths).items(), reverse=True)], times) for lengths, times in fixed] + best_fit(rest, capacity)
    used: Counter = Counter()
    runs, total = [], 0
    for parts, times in bins:
        offset = 0
        for length, each in parts:
            runs.append((length, used[length], total, each, offset))
            used[length] += each * times
            offset += length * each
        total += times
    if used != Counter(counts):
        raise AssertionError("the plan does not use every piece once")
    base, at = {}, 0
    for length in sorted(counts):
        base[length], at = at, at + counts[length]
    rows = sorted((base[a] + b, a, c, d, e) for a, b, c, d, e in runs)
    return dict(zip(("first", "length", "bin", "each", "offset"), np.array(rows, np.int64).reshape(-1, 5).T, strict=True)) | {"base": base}, total


def _cut_pieces(table, capacity: int, end_id: int):
    end = ids_bytes([end_id])

    def run(batches):
        serve("word_tokens")
        own, seen = table(), Counter()
        task = np.random.SeedSequence().entropy % (1 << 62)  # names this run of the task; only one run's rows are kept
        for whole in batches:
            for batch in byte_slices(whole, 1, GROUP):
                counts, ids = own.ids(batch.column(1))
                data, at = memoryview(ids).cast("B"), 0
                out: dict = {k: [] for k in ("row", "piece", "start", "length", "ids_crc32", "local")}
                for row, n in enumerate(counts.tolist()):
                    for k, start in enumerate(range(0, n + 1, capacity)):
                        length = min(capacity, n + 1 - start)
                        crc = zlib.crc32(data[4 * (at + start) : 4 * (at + min(start + length, n))])
                        if start + length > n:
                            crc = zlib.crc32(end, crc)
                        for name, x in zip(out, (row, k, start, length, crc, seen[length]), strict=True):
                            out[name].append(x)
                        seen[length] += 1
                    at += n
                rows = out.pop("row")
                columns = [pa.array(v, pa.int32() if k == "piece" else pa.int64()) for k, v in out.items()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns, pa.array([task] * len(rows), pa.int64())], names=["doc_id", *out, "task"])

    return run


def best_fit_packing(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (gapless from 0 in each sequence).

    A document is its token ids, then end_id; only longer ones than capacity are cut, into pieces of capacity. A null or
    empty text is the end id alone, so every row gives a piece; repeated or null ids are documents of their own. Other
    columns are not read; an empty table gives an empty result."""
    spark = docs.sparkSession
    docs = texts_of(docs)
    table = piece_tables(docs, path)
    cutted = cut(
        docs.mapInArrow(_cut_pieces(table, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long, local long, task long"),
        "pieces",
    )
    per_task = cutted.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    runs = spark.sparkContext.broadcast(plan(counts, capacity)[0])  # as many as patterns, which the lengths bound
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = per_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")

    def place(batches):
        r = runs.value
        lengths = np.array(sorted(r["base"]), np.int64)
        bases = np.array([r["base"][x] for x in lengths.tolist()], np.int64)
        for batch in batches:
            c = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            length = c["length"].to_numpy()
            slot = bases[np.searchsorted(lengths, length)] + c["before"].to_numpy() + c["local"].to_numpy()
            at = np.searchsorted(r["first"], slot, "right") - 1
            step = slot - r["first"][at]
            each = r["each"][at]
            extra = [pa.array(r["bin"][at] + step // each), pa.array(r["offset"][at] + step % each * length)]
            kept = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([*(c[k] for k in kept), *extra], names=[*kept, "sequence_id", "offset"])

    return cutted.join(ranks, ["length", "task"]).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return best_fit_packing(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 4096, 1)

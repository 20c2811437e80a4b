"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is that of their hashes; it is cut into fragments, so each document's n-gram set falls into
segments. Sets that link differ in at most D n-grams, D following from their size; cut into more than D fragments they
have a segment in common, so equal segments find all candidates (see `segment_plan` for short segments). Documents with
a segment in common gather in the group of that segment's smallest document, its pivot.

Overlaps are counted fragment by fragment: a task holds one global fragment of a pivot's set and counts what each member
has of it, and the partial overlaps are summed per pair. A group takes two such rounds, one row a member each: against its
pivot, and against the member nearest to it. What links to them is one component. Jaccard distance is a metric, so members
with too different distances to the two can't link; only members that neither round has placed meet those within reach,
in blocks of bounded size. Pairs never become rows; blocks return a spanning forest of their links, and star rounds join all.

Work that follows the data: a segment's signature stands for several n-grams, so about a sixth of the n-grams' number is
dealt out at 0.9, frequent passages don't make groups, and whole sets travel only for documents with a segment in
common. Equal sets are one class from the start, so copies cost one narrow row each.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, discard
from .common import connected_components, map_columns, read, serve, small_batches, small_slices, sorted_runs, spanning_roots, spread_join, texts_of, worker_cache

#: Words whose hashes a worker keeps.
WORDS = 150_000
#: Equal segments that linked sets have beyond the one that is needed, as a rule.
SURPLUS = 8
#: Global fragments of the order that partial overlaps are counted by.
FRAGMENTS = 4
#: Members that a task compares with a pivot's fragment; unplaced members, members and n-grams in a block.
CHUNK, OPEN, BLOCK_GRAMS = 1024, 1024, 2_000_000
#: n-grams that are turned into a matrix at a time.
COLUMNS = 4096
#: Bits of the filter that says which documents' sets are built (8 MB when broadcast). Beyond some ten million such
#: documents more sets are built than needed; the join after it is exact.
FILTER_BITS = 1 << 26
#: Nodes of classes whose smallest doc_id has several texts.
_EXTRA = 1 << 62


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = worker_cache("ngram_join", _WordHash())
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams; with fewer words the whole sequence is one; none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = _mix(out * _ODD[1] + h[j : len(h) - k + 1 + j] * _ODD[0])
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


@cache
def _level_start(i: int, percent: int) -> int:
    """Least set size of level i. Linked sets are at most one level apart, as a level's sizes differ by as much as theirs may,
    and by a half from 85 percent on."""
    if i == 0:
        return 1
    last = _level_start(i - 1, percent)
    return max(last + 1, last * 3 // 2 if percent >= 85 else -(-last * 100 // percent))


@cache
def segment_plan(level: int, percent: int) -> tuple[int, int, int]:
    """(fragments, differences at most, n-grams below which a segment is weak) for sets that meet at this level.

    With |A & B| <= r (the level's largest size), 100 |A & B| >= percent |A | B| leaves r (100 - percent) / percent
    differences at most, so at least fragments - differences segments are equal. Weak segments say little and aren't
    used, unless a set has at least that many: if all equal segments are weak, they are so in both sets, and both sets use
    theirs. Spare fragments make that rare (about one set in a thousand), never wrong; SURPLUS more of them allow each set
    to leave out its most crowded segments (see `signatures`)."""
    weak = 2 if percent >= 85 else 1
    least, most = _level_start(level, percent), _level_start(level + 1, percent) - 1
    differ = most * (100 - percent) // percent
    spare = 1
    while spare < most:
        fragments = differ + spare
        mean = least / fragments
        expect = fragments * math.exp(-mean) * (1 + mean * (weak - 1))
        if expect + 3 * math.sqrt(expect) + 1 + SURPLUS < spare:
            break
        spare += 1 + spare // 50
    return differ + spare, differ, weak


def signatures(grams: np.ndarray, percent: int) -> tuple[list[np.ndarray], list[int]]:
    """The set's segment signatures at its level and at the one below if a partner may be there, and for each of the two
    how many may be left out.

    Of `spare` equal segments at least, those that are weak are so in both sets; with w weak ones here, spare - w usable
    ones are equal. If each of two sets leaves out less than half of that number, whichever, one is left in both."""
    n, out, spared = len(grams), [], []
    level = 0
    while n and _level_start(level + 1, percent) <= n:
        level += 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(grams + _ODD[3]))))
    for at in (level, level - 1):
        fragments, differ, weak = segment_plan(at, percent) if n and at >= 0 else (0, 0, 0)
        if not differ or (at < level and -(-percent * n // 100) >= _level_start(level, percent)):  # without differences only equal sets link
            out.append(np.empty(0, np.uint64))
            spared.append(0)
            continue
        number = ((grams >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
        ends = np.searchsorted(number, np.arange(fragments + 1, dtype=np.uint64))
        size = np.diff(ends)
        use = size >= weak
        equal = fragments - differ - int((~use).sum())
        if equal <= 0:
            use[:] = True
        where = np.flatnonzero(use)
        segment = sums[ends[where + 1]] - sums[ends[where]]
        tag = where.astype(np.uint64) * _ODD[1] + size[where].astype(np.uint64) * _ODD[2] + np.uint64(at + 1)
        out.append(_mix(_mix(tag) + segment * _ODD[0]))
        spared.append(max(0, (equal - 1) // 2))
    return out, spared


def _key(grams: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None


def _signed(n: int, percent: int):
    """For map_columns: n-gram count, class key and segment signatures of each document."""

    def make():
        serve("ngram_join")

        def fn(cols: dict) -> dict:
            sets = [gram_set(t, n) for t in cols["text"]]
            found = [signatures(s, percent) for s in sets]
            return {
                "doc_id": cols["doc_id"],
                "n_shingles": [len(s) for s in sets],
                "key": [_key(s) for s in sets],
                "segments": [np.concatenate(f).view(np.int64) for f, _ in found],
                "spared": [[len(f[0]), *t] for f, t in found],
            }

        return fn

    return make


def _filter_of(table: DataFrame, hashes):
    """A broadcast filter of fixed size that holds all the hashes, and a few others."""
    bit = F.explode(F.array(F.pmod(hashes, F.lit(FILTER_BITS)), F.pmod(F.shiftright(hashes, 32), F.lit(FILTER_BITS))))
    found = table.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toArrow()  # FILTER_BITS / 64 rows at most
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return table.sparkSession.sparkContext.broadcast(words)


def _passes(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    a, b = hashes % FILTER_BITS, (hashes >> 32) % FILTER_BITS
    return ((words[a >> 6] >> (a & 63)) & (words[b >> 6] >> (b & 63)) & 1) == 1


def _shared_segments(words):
    """For mapInArrow: (d, level, spared, segment) of the segments that pass the filter; level tells a set's two apart."""

    def run(batches):
        serve("ngram_join")
        for batch in batches:
            lists = batch.column(1)
            segments, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            keep = np.flatnonzero(_passes(words.value, segments))
            row = np.searchsorted(ends - ends[0], keep, "right") - 1
            spared = batch.column(2).flatten().to_numpy().reshape(-1, 3)[row]
            below = (keep - (ends - ends[0])[row] >= spared[:, 0]).astype(np.int32)
            most = np.where(below == 1, spared[:, 2], spared[:, 1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(below), pa.array(most), pa.array(segments[keep])], names=["d", "level", "spared", "segment"])

    return run


def _gram_sets(n: int, words):
    """For mapInArrow: key and n-gram set, by global fragment, of the documents that pass the filter."""
    edges = np.array([(k << 64) // FRAGMENTS for k in range(1, FRAGMENTS)], np.uint64)

    def run(batches):
        serve("ngram_join")
        bits = words.value
        for batch in batches:
            for rows in small_slices(batch.filter(pa.array(_passes(bits, batch.column(2).to_numpy())))):
                sets = [gram_set(t, n) for t in rows.column(1).to_pylist()]
                cuts = [np.split(s, np.searchsorted(s, edges)) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([[p.tobytes() for p in c] for c in cuts], pa.list_(pa.binary()))],
                    names=["doc_id", "key", "n", "parts"],
                )

    return run


def with_sets(docs: DataFrame, rows: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """rows (with d), each with n and parts, the n-gram set of its class by global fragment.

    Sets are made anew each time they are needed, for the documents in rows only: they are larger than the texts."""
    wanted = cut(rows.join(classes.select("d", F.col("rep").alias("doc_id"), "key"), "d"), "wanted")
    texts = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    sets = texts.mapInArrow(_gram_sets(n, _filter_of(wanted, F.xxhash64("doc_id"))), "doc_id long, key binary, n long, parts array<binary>")
    sets = sets.groupBy("doc_id", "key").agg(F.first("n").alias("n"), F.first("parts").alias("parts"))  # repeated rows
    return sets.join(wanted, ["doc_id", "key"]).drop("doc_id", "key")


def _partial_overlaps(batches):
    """For mapInArrow over rows by (p, f, chunk), the pivot first: what each member has of the pivot's fragment."""
    serve("ngram_join")
    at, mine, size = None, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        p, f, chunk, member, d, n = (batch.column(k).to_numpy() for k in range(6))
        grams = batch.column(6)
        ends = np.frombuffer(grams.buffers()[1], np.int32)[grams.offset : grams.offset + len(grams) + 1] // 8
        data = np.frombuffer(grams.buffers()[2] or b"", np.uint64, count=ends[-1]) if ends[-1] else np.empty(0, np.uint64)
        new = np.flatnonzero((p[1:] != p[:-1]) | (f[1:] != f[:-1]) | (chunk[1:] != chunk[:-1])) + 1
        starts = np.concatenate(([0], new))
        common, pn = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        for a, b in zip(starts.tolist(), [*new.tolist(), len(p)], strict=True):
            key = (p[a], f[a], chunk[a])
            if key != at:
                at, mine, size = key, None, 0
            if not member[a]:
                mine, size = data[ends[a] : ends[a + 1]].copy(), n[a]
                a += 1
            pn[a:b] = size
            if mine is None or not len(mine) or a == b:
                continue
            theirs = data[ends[a] : ends[b]]
            where = np.searchsorted(mine, theirs)
            where[where == len(mine)] = 0
            total = np.concatenate(([0], np.cumsum(mine[where] == theirs)))
            common[a:b] = total[ends[a + 1 : b + 1] - ends[a]] - total[ends[a:b] - ends[a]]
        keep = (member == 1) & ((common > 0) | (f == 0))
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (p, pn, d, n, common)], names=["p", "pn", "d", "n", "common"])


def measure(docs: DataFrame, pairs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """pairs (p, d, chunk) -> p, d, n (the size of d), linked, far (Jaccard distance), band (distance in units of that up
    to which sets link): partial overlaps of each global fragment, summed per pair."""
    both = pairs.select("p", "chunk", F.lit(1).alias("member"), "d").union(pairs.select("p", "chunk").distinct().select("p", "chunk", F.lit(0), "p"))
    rows = with_sets(docs, both, classes, n).select("p", "chunk", "member", "d", "n", F.posexplode("parts").alias("f", "grams")).where("f = 0 or length(grams) > 0")
    dealt = rows.select("p", "f", "chunk", "member", "d", "n", "grams").repartition("p", "f", "chunk").sortWithinPartitions("p", "f", "chunk", "member")
    counted = dealt.mapInArrow(_partial_overlaps, "p long, pn long, d long, n long, common long").groupBy("p", "d")
    summed = counted.agg(F.max("pn").alias("pn"), F.max("n").alias("n"), F.sum("common").alias("common")).withColumn("all", F.expr("pn + n - common"))
    return summed.select("p", "d", "n", F.expr(f"100 * common >= {percent} * all").alias("linked"), F.expr("(all - common) / all").alias("far"), F.expr(f"cast(100 * (all - common) div ({100 - percent} * all) as int)").alias("band"))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Overlap sizes of all pairs, of one fragment's segments."""
    sets = [*left, *right]
    size = np.array([len(s) for s in sets])
    total = np.zeros((len(left), len(right)), np.float32)
    for part in _incidence(np.concatenate(sets), np.repeat(np.arange(len(sets)), size), len(sets)):
        total += part[: len(left)] @ part[len(left) :].T
    return total.astype(np.int64)


def _incidence(grams: np.ndarray, owner: np.ndarray, n_sets: int):
    """Incidence matrices, set by n-gram, of consecutive runs of the order; n-grams of a single set drop out."""
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    new = np.concatenate(([True], grams[1:] != grams[:-1])) if len(grams) else np.empty(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1 if len(grams) else new
    column, owner = column[shared], owner[shared]
    if not len(column):
        return
    column = np.cumsum(np.concatenate(([0], column[1:] != column[:-1])))
    for first in range(0, column[-1] + 1, COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS))
        out = np.zeros((n_sets, column[b - 1] - first + 1), np.float32)
        out[owner[a:b], column[a:b] - first] = 1
        yield out


def _block_links(percent: int):
    """For mapInArrow over rows by block: members not yet placed against members -> a spanning forest of their links."""

    def run(batches):
        serve("ngram_join")
        for rows in sorted_runs(batches, 5):
            member, d, n, parts = (rows.column(k) for k in ("member", "d", "n", "parts"))
            member, d, n = member.to_numpy(), d.to_numpy(), n.to_numpy()
            few, many = np.flatnonzero(member == 0), np.flatnonzero(member == 1)
            if not len(few) or not len(many):
                continue
            sets = parts.to_pylist()
            common = sum(overlaps([np.frombuffer(sets[k][f], np.uint64) for k in few], [np.frombuffer(sets[k][f], np.uint64) for k in many]) for f in range(FRAGMENTS))
            linked = 100 * common >= percent * (n[few][:, None] + n[many][None, :] - common)
            near, place = np.unique(np.concatenate((d[few], d[many])), return_inverse=True)
            square = np.zeros((len(near), len(near)), bool)
            r, c = np.nonzero(linked)
            square[place[r], place[len(few) + c]] = True
            square |= square.T
            root = spanning_roots(square)
            apart = root != np.arange(len(root))
            if apart.any():
                yield pa.RecordBatch.from_arrays([pa.array(near[root[apart]]), pa.array(near[apart])], names=["src", "dst"])

    return run


def _links(docs: DataFrame, star: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """(src, dst) that span every component of links between documents of a group; star: (p, d, chunk)."""
    first = cut(measure(docs, star, classes, n, percent), "first")
    near = F.min(F.struct("far", "d", "linked"))
    groups = first.groupBy("p").agg(F.count("*").alias("rows"), F.sum((~F.col("linked")).cast("long")).alias("open"), near.alias("near"))
    groups = cut(groups.where("open > 0 and rows > 1").select("p", "rows", F.col("near.d").alias("b"), F.col("near.linked").alias("joined")), "groups")
    members = cut(spread_join(first, groups, ["p"]).where("d <> b"), "group_members")
    chunk = F.expr(f"pmod(xxhash64(d), 1 + rows div {CHUNK})")
    again = members.select(F.col("b").alias("p"), "d", chunk.alias("chunk")).groupBy("p", "d").agg(F.min("chunk").alias("chunk"))
    second = cut(measure(docs, again, classes, n, percent), "second")
    both = members.join(second.select(F.col("p").alias("b"), "d", F.col("linked").alias("also"), F.col("band").alias("band2")), ["b", "d"])
    placed = cut(both.select("p", "d", "n", "band", "band2", F.expr("not (also or (joined and linked))").alias("open")), "placed")
    # sets link only if their bands differ by one at most, so such pairs share one of the cells that each row enters: that
    # of the smaller band of the two in each direction
    reach = F.explode(F.array(*[F.struct((F.col("band") - i).alias("i"), (F.col("band2") - j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    entered = placed.select("p", "d", "n", "open", "band", "band2", reach.alias("at")).select("p", "at.i", "at.j", "d", "n", "open", "band", "band2")
    cells = entered.groupBy("p", "i", "j").agg(F.min("band").alias("low"), F.min("band2").alias("low2"), F.count("*").alias("rows"), F.sum("n").alias("grams"), F.sum(F.expr("cast(open as long)")).alias("few"), F.sum(F.expr("if(open, n, 0)")).alias("few_grams"))
    size = "cast(greatest(ceil({} / {}), ceil({} / {})) as int)"
    cells = cut(
        cells.where("few > 0 and rows > 1 and low = i and low2 = j").select("p", "i", "j", "rows", F.expr(size.format("few", OPEN, "few_grams", BLOCK_GRAMS)).alias("q"), F.expr(size.format("rows", CHUNK, "grams", BLOCK_GRAMS)).alias("c")),
        "cells",
    )
    met = spread_join(entered, cells, ["p", "i", "j"])
    block = ["p", "i", "j", "at_q", "at_c"]
    few = met.where("open").select("p", "i", "j", F.expr("pmod(xxhash64(d), q)").alias("at_q"), F.explode(F.expr("sequence(0, c - 1)")).alias("at_c"), F.lit(0).alias("member"), "d")
    many = met.select("p", "i", "j", F.explode(F.expr("sequence(0, q - 1)")).alias("at_q"), F.expr("pmod(xxhash64(d, 1), c)").alias("at_c"), F.lit(1).alias("member"), "d")
    blocks = few.select(*[F.col(k).cast("long") for k in block], "member", "d").union(many.select(*[F.col(k).cast("long") for k in block], "member", "d"))
    dealt = with_sets(docs, blocks, classes, n).select(*block, "member", "d", "n", "parts").repartition(*block).sortWithinPartitions(*block)
    rest = dealt.mapInArrow(_block_links(percent), "src long, dst long")
    linked = [t.where("linked").select(F.col("p").alias("src"), F.col("d").alias("dst")) for t in (first, second)]
    return linked[0].union(linked[1]).union(rest)


def ngram_jaccard_join(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links).

    Two documents link when 100 * |A & B| >= percent * |A | B| over their distinct word n-grams (A-Z lower-cased, words
    split at ASCII white space). Null or wordless texts have no n-grams and link with nothing. Rows with the same doc_id
    are one node, whatever their texts: each text links for it. A null doc_id stays a row of its own: its component is
    that of its copies with an id, or null. Other columns of docs are not read; an empty table gives an empty result."""
    with small_batches(docs.sparkSession):
        return _joined(texts_of(docs), n, percent)


def _joined(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """All steps in Python run in here; what is returned reads tables only."""
    wide = cut(map_columns(docs, _signed(n, percent), "doc_id long, n_shingles long, key binary, segments array<long>, spared array<long>"), "wide")
    signed = cut(wide.drop("segments", "spared"), "signed")
    code = F.xxhash64("key")
    many = signed.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.min(code).alias("a"), F.max(code).alias("b"))  # a null key has a code of its own
    mixed = cut(many.where("a <> b").select("doc_id", "rows"), "mixed")
    classes = wide.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"), F.first("segments").alias("segments"), F.first("spared").alias("spared"))
    node = F.when(F.col("several"), F.monotonically_increasing_id() + F.lit(_EXTRA)).otherwise(F.col("rep"))
    classes = classes.join(mixed.select(F.col("doc_id").alias("rep"), F.lit(True).alias("several")), "rep", "left")
    nodes = cut(classes.select("key", "rep", "rows", node.alias("d"), "segments", "spared"), "nodes")
    discard(wide)
    classes = cut(nodes.drop("segments", "spared"), "classes")
    listed = nodes.where("d is not null").select("d", "segments", "spared")
    crowds = listed.select("d", F.explode("segments").alias("segment")).groupBy("segment").agg(F.count("*").alias("rows")).where("rows > 1")
    crowds = cut(crowds, "crowds")
    postings = listed.mapInArrow(_shared_segments(_filter_of(crowds, F.col("segment"))), "d long, level int, spared long, segment long")
    postings = spread_join(postings, crowds, ["segment"])
    by_crowd = Window.partitionBy("d", "level").orderBy(F.desc("rows"), "segment")  # one set's segments
    postings = cut(postings.withColumn("at", F.row_number().over(by_crowd)).where("at > spared").select("d", "segment"), "postings")
    pivots = cut(postings.groupBy("segment").agg(F.min("d").alias("p"), F.count("*").alias("rows")).where("rows > 1"), "pivots")
    star = spread_join(postings, pivots, ["segment"]).where("d <> p").select("p", "d", F.expr(f"pmod(xxhash64(d), 1 + rows div {CHUNK})").alias("chunk"))
    star = cut(star.groupBy("p", "d").agg(F.min("chunk").alias("chunk")), "star")
    discard(nodes, crowds, postings, pivots)
    named = signed.where("key is not null").select("doc_id", "key").join(mixed.select("doc_id"), "doc_id").distinct()
    edges = named.join(classes.select("key", "d"), "key").select(F.col("doc_id").alias("src"), F.col("d").alias("dst"))
    components = cut(connected_components(_links(docs, star, classes, n, percent).union(edges)), "components")
    discard(star)
    lowest = components.withColumnRenamed("node", "d")
    found = cut(classes.select("key", "rows", "d").join(lowest, "d", "left").select("key", "rows", F.coalesce("component", "d").alias("component_id")), "found")
    worded = spread_join(signed.where("key is not null").select("doc_id", "n_shingles", "key"), found, ["key"])
    wordless = signed.where("key is null").select("doc_id", "n_shingles")
    own = mixed.join(components.withColumnRenamed("node", "doc_id"), "doc_id")
    wordless = spread_join(wordless, own, ["doc_id"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return worded.select("doc_id", "n_shingles", "component_id").union(wordless)


def op8_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(read(spark, sf_dir, "documents"), 3, 90)


_SQL = r"""
with words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w
  from documents
), grams as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) g
  from words
), sizes as (select doc_id, count(*) n from grams group by 1),
links as (
  select a.doc_id s, b.doc_id t from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id
  join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
  where 10 * x.n >= 9 * y.n and 10 * y.n >= 9 * x.n
  group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 90 * (x.n + y.n - count(*))
), reach as (
  with recursive r(s, t) as (select doc_id, doc_id from documents union select r.s, l.t from r join links l on l.s = r.t)
  select s, min(t) c from r group by 1
)
select d.doc_id, cast(coalesce(n, 0) as bigint) n_shingles, cast(c as bigint) component_id
from documents d left join sizes using (doc_id) left join reach on reach.s = d.doc_id
"""
ORACLE = {"op8_ngram_join": _SQL}

"""Token counts and ids of a word-level BPE, by a map-side two-tier lookup.

The tokenizer cuts lower-cased text into pre-tokens (words, single digits, runs of marks) that merges never cross, so a
text's tokens are those of its pre-tokens one after another. Tier one is a compact table of the corpus's frequent
pre-tokens: each task counts its texts' pieces in a bounded counter, the counters are merged in a tree (one record a
task), and the table of the most frequent is broadcast. What it lacks is encoded by the library, a batch at a time, and
kept in the worker's own cache. No pre-token is ever shuffled.

A batch of texts is one buffer. It is cut at white space without making strings, equal pieces are found by Arrow's
dictionary encoding, and only distinct pieces are taken apart and looked up; counts and ids then follow by index.
"""

from __future__ import annotations

import os
import re
from itertools import compress, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, read, serve, texts_of, worker_cache

#: Entries of tier one (1 MB when broadcast), and longest pre-token kept in either tier. They change only speed.
TIER_ONE, LONGEST = 1 << 15, 64
#: Entries that a task's counter is cut back to when twice as many are in it; its record has as many at most (1 MB).
COUNTED = 1 << 15
#: Records that reach the driver, at most.
LAST_RECORDS = 16
#: Entries of a worker's cache (about 150 MB), cut back to the first half when full; bytes handled at a time.
CACHE, GROUP = 1_000_000, 1 << 24
#: Words that the library gets as one text.
JOINED = 256

# The mark of a word's last token, and the tokenizer's classes within Latin-1.
END_OF_WORD = "</w>"
_LETTER, _NUMBER, _BLANK = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
#: The tokenizer's pre-tokens of lower-cased Latin-1 text, and line ends as marks between pieces.
PRE_TOKEN = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[{_NUMBER}]|[^{_BLANK}{_LETTER}{_NUMBER}]+|\n")
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])

_loaded: dict[str, object] = worker_cache("word_tokens", {})


def tokenizer(path: str):
    """The library's tokenizer, loaded once a worker."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def white_space_pieces(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """All pieces between white space (ASCII) of all texts, and each text's number of pieces."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends -= ends[0]
    keep = ~_SPACES[data]
    begins = keep.copy()
    begins[1:] &= ~keep[:-1]
    inner = ends[:-1][np.diff(ends) > 0]
    begins[inner] = keep[inner]  # a text's first byte begins a piece whatever is before it
    at = np.flatnonzero(begins)
    kept = np.cumsum(keep, dtype=np.int32)
    offsets = np.append(kept[at] - 1, kept[-1] if len(kept) else 0).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[keep])])
    return pieces, np.diff(np.searchsorted(at, ends))


def take_apart(pieces: list[str]) -> tuple[list[str], np.ndarray]:
    """Strings whose tokens, one after another, are the pieces', and where each piece's end.

    Beyond Latin-1 a piece stays whole, since the tokenizer normalises it first."""
    whole = {} if _latin("".join(pieces)) else {k: p for k, p in enumerate(pieces) if not _latin(p)}
    found = PRE_TOKEN.findall("\n".join(["" if k in whole else p for k, p in enumerate(pieces)] if whole else pieces).lower() + "\n") if pieces else []
    ends = np.flatnonzero(np.fromiter(map("\n".__eq__, found), bool, len(found)))
    for k, p in whole.items():
        found[ends[k]] = p
    own = np.ones(len(found), bool)
    own[ends] = False
    own[ends[list(whole)]] = True  # there the piece has taken the mark's place
    return list(compress(found, own.tolist())), np.cumsum(own, dtype=np.int32)[ends]


class Encoder:
    """Ids of many pre-tokens at once. Words of Latin-1 go to the library JOINED at a time, separated by blanks, and are told
    apart by the mark that ends a word's last token; everything else goes by itself."""

    def __init__(self, path: str):
        vocabulary = tokenizer(path).get_vocab()
        self.batch = tokenizer(path).encode_batch_fast
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith(END_OF_WORD)]] = True

    def encode(self, parts: list[str]) -> list[bytes]:
        """Each part's ids as bytes."""
        alone = [k for k, p in enumerate(parts) if "<|" in p or not _latin(p)]
        apart = set(alone)
        joined = [p for k, p in enumerate(parts) if k not in apart] if alone else parts
        texts = [" ".join(joined[a : a + JOINED]) for a in range(0, len(joined), JOINED)]
        ids = np.array([i for e in self.batch(texts, add_special_tokens=False) for i in e.ids], "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(joined):
            raise AssertionError("a pre-token isn't one word of the tokenizer")
        data, ends = ids.tobytes(), (4 * ends).tolist()
        found = [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
        if not alone:
            return found
        rest = iter(found)
        more = iter(self.batch([parts[k] for k in alone], add_special_tokens=False))
        return [ids_bytes(next(more).ids) if k in apart else next(rest) for k in range(len(parts))]


def _before(x: np.ndarray, sums: int = 1) -> np.ndarray:
    """0 and the running sums of x (or x itself), as 32-bit numbers: a batch of texts has fewer tokens than that."""
    out = np.zeros(len(x) + 1, np.int32)
    out[1:] = np.cumsum(x, dtype=np.int32) if sums else x
    return out


class PieceTable:
    """pre-token -> its ids as bytes: tier one, which stays as it is, and the worker's cache, which takes what is new."""

    def __init__(self, path: str, first: dict[str, bytes]):
        self.first, self.cache, self.path, self.encoder = len(first), dict(first), path, Encoder(path)

    def ids(self, texts: pa.StringArray, whole: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Each text's number of tokens, and if asked for all texts' ids one after another; a null text counts as empty.

        Special strings are matched by exact case before all else and may hold anything, so a text that may have one
        goes to the library as it is."""
        texts = pc.fill_null(texts, "")
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(special), "", texts) if special.any() else texts
        pieces, per_text = white_space_pieces(plain)
        coded = pieces.dictionary_encode()
        values, ends = self._values(coded.dictionary.to_pylist())
        index = coded.indices.to_numpy()
        size = np.fromiter(map(len, values), np.int32, len(values)) >> 2
        first = _before(size)[_before(ends, 0)]  # where each distinct piece's ids begin
        length = np.diff(first)[index]
        before = _before(length)
        at = np.concatenate(([0], np.cumsum(per_text)))
        counts = np.diff(before[at]).astype(np.int64)
        ids = None
        if whole:
            flat = np.frombuffer(b"".join(values), "<u4")
            where = np.repeat(first[index] - before[:-1], length)
            where += np.arange(before[-1], dtype=np.int32)
            ids = flat.take(where)
        if special.any():
            rows = np.flatnonzero(special)
            own = [np.array(e.ids, "<u4") for e in tokenizer(self.path).encode_batch_fast([texts[int(k)].as_py() for k in rows], add_special_tokens=False)]
            if whole:
                ids = np.insert(ids, np.repeat(np.concatenate(([0], np.cumsum(counts)))[rows], [len(o) for o in own]), np.concatenate(own))
            counts[rows] = [len(o) for o in own]
        return counts, ids

    def _values(self, pieces: list[str]) -> tuple[list[bytes], np.ndarray]:
        """The ids of the pieces' pre-tokens, and where each piece's end among them."""
        parts, ends = take_apart(pieces)
        cache = self.cache
        values = list(map(cache.get, parts))
        holes = [k for k, v in enumerate(values) if v is None]
        if holes:
            new = list({parts[k] for k in holes})
            found = dict(zip(new, self.encoder.encode(new), strict=True))
            for k in holes:
                values[k] = found[parts[k]]
            cache.update((p, v) for p, v in found.items() if len(p) <= LONGEST)
            if len(cache) > CACHE + self.first:  # the first half holds tier one and, as a rule, the more frequent ones
                self.cache = dict(islice(cache.items(), self.first + CACHE // 2))
        return values, ends


def ids_bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def _summed(tables: list[pa.Table], most: int) -> pa.Table:
    """words, counts of all tables; without the rare ones if there are more than `most`."""
    total = pa.concat_tables(tables).group_by("words").aggregate([("counts", "sum")]).rename_columns(["words", "counts"])
    if total.num_rows > most:
        total = total.take(pc.select_k_unstable(total, most, [("counts", "descending"), ("words", "ascending")]))
    return total


def _record(total: pa.Table) -> pa.RecordBatch:
    words, counts = total.column("words").combine_chunks(), total.column("counts").combine_chunks()
    ends = pa.array([0, total.num_rows], pa.int32())
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, counts)], names=["words", "counts"])


_EMPTY = pa.table({"words": pa.array([], pa.string()), "counts": pa.array([], pa.int64())})


def _count_pieces(batches):
    """For mapInArrow: the frequent pre-tokens of a task's texts, as one record. Pieces between white space are counted
    and taken apart at the end."""
    serve("word_tokens")
    total = _EMPTY
    for batch in batches:
        for part in byte_slices(batch, 0, GROUP):
            pieces, _ = white_space_pieces(pc.fill_null(part.column(0), ""))
            seen = pieces.value_counts()
            seen = pa.table({"words": seen.field("values"), "counts": seen.field("counts")})
            total = _summed([total, seen], COUNTED)
    parts, ends = take_apart(total.column("words").to_pylist())
    counts = np.repeat(total.column("counts").to_numpy(), np.diff(np.concatenate(([0], ends))))
    found = _summed([pa.table({"words": pa.array(parts, pa.string()), "counts": pa.array(counts, pa.int64())})], COUNTED)
    yield _record(found.filter(pc.less_equal(pc.utf8_length(found.column("words")), LONGEST)))


def _merge(batches):
    """For mapInArrow: records -> one record."""
    total = _EMPTY
    for batch in batches:
        for k in range(batch.num_rows):
            total = _summed([total, pa.table({"words": batch.column(0)[k].values, "counts": batch.column(1)[k].values})], COUNTED)
    yield _record(total)


def frequent_pre_tokens(docs: DataFrame, most: int = TIER_ONE) -> list[str]:
    """The most frequent pre-tokens of all texts: per-task bounded counters, merged in a tree."""
    schema = "words array<string>, counts array<long>"
    records = docs.select("text").mapInArrow(_count_pieces, schema)
    records = records.repartition(F.xxhash64("words")).mapInArrow(_merge, schema).repartition(LAST_RECORDS).mapInArrow(_merge, schema)
    last = [pa.table({"words": pa.array(r["words"], pa.string()), "counts": pa.array(r["counts"], pa.int64())}) for r in records.collect()]  # LAST_RECORDS rows
    total = _summed([_EMPTY, *last], COUNTED).sort_by([("counts", "descending"), ("words", "ascending")])
    return [w for w in total.column("words").to_pylist()[:most] if "<|" not in w]


def piece_tables(docs: DataFrame, path: str):
    """A function that gives a worker its table; the broadcast holds tier one: pre-tokens, and each one's ids as bytes."""
    words = frequent_pre_tokens(docs)
    tier = docs.sparkSession.sparkContext.broadcast((words, Encoder(path).encode(words)))

    def table() -> PieceTable:
        if path not in _tables or _tables[path][0] is not tier:
            _tables[path] = (tier, PieceTable(path, dict(zip(*tier.value, strict=True))))
        return _tables[path][1]

    return table


#: A worker's tables; they live as long as the worker, over many tasks.
_tables: dict = {}


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every whole text; a null text counts as empty.

    No begin, end or added special tokens; special strings inside a text become their special token, as the library does
    by default. One row per input row, repeated or null ids included; other columns are not read."""
    docs = texts_of(docs)
    table = piece_tables(docs, path)

    def run(batches):
        serve("word_tokens")
        own = table()
        for whole in batches:
            for batch in byte_slices(whole, 1, GROUP):
                n, _ = own.ids(batch.column(1), False)
                size = pc.cast(pc.fill_null(pc.binary_length(batch.column(1)), 0), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2048)

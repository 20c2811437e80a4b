"""Byte-level BPE by a lazily determinised transducer, and decoding by an incremental UTF-8 state machine.

A sequence of tokens is what BPE makes of its bytes just when every token comes out of BPE whole and every neighbouring
pair does. So encoding is a nondeterministic transducer: a hypothesis holds its last whole token and a place in the
trie of tokens for the one under way. `Transducer` determinises it on demand: a state is the set of live hypotheses, a
step gives the next state and the one token that ends at this byte if the text does. What was read is decided as soon
as one hypothesis is left, so output follows after a lookahead that the vocabulary bounds, by walking back over the
tokens that ended where the next ones begin. States and steps are remembered: known ground costs one lookup a byte.

Ids travel packed, as 32-bit integers in bytes; their decimals and the bytes they stand for are gathered from tables.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_columns, read, texts_of
from .word_tokens import vocabulary

#: States of the determinised transducer before it starts afresh, pre-tokens that a worker keeps, the longest kept, and
#: bytes held back at most until the next decided place. Pairs of tokens, and moves of the decoder, that are remembered.
#: Ids that are spelled out at a time.
STATES, CACHE, LONGEST, FLUSH = 200_000, 500_000, 64, 256
PAIRS, MOVES = 1_000_000, 500_000
SPELLED = 1 << 16
_NEVER = 1 << 60
#: A hypothesis is one number: its last whole token (-1: none), then the place in the trie in so many bits.
_PLACE = 32
_PLACES = (1 << _PLACE) - 1


class Transducer:
    """bytes -> ids, for one vocabulary {bytes: rank}. `encode` is exact for any bytes; feeding is one byte at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.tokens = ranks, {r: b for b, r in ranks.items()}
        self.halves = {r: self._halve(b) for b, r in ranks.items()}
        self.spines: tuple[dict, dict] = ({}, {})
        self.fit: dict[int, bool] = {}
        self.child: dict[int, int] = {}
        self.whole: list[int] = [-1]  # by place: the token that ends there
        self.inner: list[bool] = [False]
        for token, rank in ranks.items():
            if len(token) > 1 and self.halves[rank] is None:
                continue  # merges never make it
            at = 0
            for b in token:
                key = at << 8 | b
                self.inner[at] = True
                if key not in self.child:
                    self.child[key] = len(self.inner)
                    self.whole.append(-1)
                    self.inner.append(False)
                at = self.child[key]
            self.whole[at] = rank
        self._forget()

    def _forget(self) -> None:
        start = (-1 << _PLACE,)
        self.states, self.ids, self.step = [start], {start: 0}, {}
        self.ends = [-1]  # by state: the token that ends there, the last one of its hypothesis without a token under way

    def _halve(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens whose merge gives this one; None for a byte and for what merges never give."""
        parts, limit = [token[k : k + 1] for k in range(len(token))], self.ranks[token]
        while len(parts) > 2:
            rank, k = min((self.ranks.get(a + b, _NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank >= limit:
                return None
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None

    def _spine(self, token: int, side: int) -> list[int]:
        """The tokens that hold the token's last (side 1) or first (0) byte, from the byte to the token itself."""
        found = self.spines[side].get(token)
        if found is None:
            halves = self.halves[token]
            found = self.spines[side][token] = ([*self._spine(halves[side], side), token] if halves else [token])
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens apart: no merge over their border comes before those that use its sides up."""
        key = left << _PLACE | right
        if key not in self.fit:
            if len(self.fit) >= PAIRS:
                self.fit.clear()
            a, b, i, j, apart = self._spine(left, 1), self._spine(right, 0), 0, 0, True
            while True:
                after_a = a[i + 1] if i + 1 < len(a) else _NEVER
                after_b = b[j + 1] if j + 1 < len(b) else _NEVER
                over = self.ranks.get(self.tokens[a[i]] + self.tokens[b[j]], _NEVER)
                if over < after_a and over <= after_b and over < _NEVER:
                    apart = False
                    break
                if after_a == after_b == _NEVER:
                    break
                if after_a <= after_b:
                    i += 1
                else:
                    j += 1
            self.fit[key] = apart
        return self.fit[key]

    def _make_step(self, state: int, byte: int) -> int:
        """States are numbered in steps of 256, so that a state and a byte add up to a key."""
        live, ending = [], -1
        child, whole, inner, fit = self.child.get, self.whole, self.inner, self.fit.get
        for hypothesis in self.states[state >> 8]:
            node = child((hypothesis & _PLACES) << 8 | byte)
            if node is None:
                continue
            last = hypothesis >> _PLACE
            if inner[node]:
                live.append(last << _PLACE | node)
            if ending < 0 and whole[node] >= 0:  # a prefix has one tokenization, so the first token that fits is the one
                token = whole[node]
                if last < 0:
                    ending = token
                else:
                    apart = fit(last << _PLACE | token)
                    if self.fits(last, token) if apart is None else apart:
                        ending = token
        if ending < 0:
            raise ValueError(f"byte {byte} is no token of the vocabulary")
        live.append(ending << _PLACE)
        key = tuple(live)
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.states) << 8
            self.states.append(key)
            self.ends.append(ending)
        self.step[state | byte] = to
        return to

    def _walk_back(self, path: list[int]) -> list[int]:
        out, at, ends, tokens = [], len(path), self.ends, self.tokens
        while at:
            token = ends[path[at - 1] >> 8]
            out.append(token)
            at -= len(tokens[token])
        out.reverse()
        return out

    def encode(self, data: bytes) -> list[int]:
        if len(self.states) > STATES:
            self._forget()
        out: list[int] = []
        path: list[int] = []
        state, get, go = 0, self.step.get, path.append
        for byte in data[:FLUSH]:
            state = get(state | byte) or self._make_step(state, byte)  # no step leads to the start, state 0
            go(state)
        for byte in data[FLUSH:]:
            if len(path) >= FLUSH and len(self.states[state >> 8]) == 1:  # one hypothesis is left: all before is decided
                out += self._walk_back(path)
                path.clear()
            state = get(state | byte) or self._make_step(state, byte)
            go(state)
        return out + self._walk_back(path)


class Strings:
    """Byte strings by number, to be laid end to end."""

    def __init__(self, strings: dict[int, bytes]):
        self.sizes = np.zeros(max(strings, default=-1) + 1, np.int64)
        self.sizes[list(strings)] = [len(b) for b in strings.values()]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join([strings[i] for i in sorted(strings)]), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        at = np.repeat(self.starts[ids] - np.cumsum(sizes) + sizes, sizes)
        at += np.arange(len(at))
        return self.bytes[at].tobytes()


#: UTF-8 by lead byte: (first, last lead byte) -> state; by state: (first, last next byte) -> state. State 0 is between characters.
_LEADS = [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)]
_NEXT = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}
BAD = -1


def utf8_step(state: int, byte: int) -> int:
    for first, last, to in _LEADS if state == 0 else [_NEXT[state]]:
        if first <= byte <= last:
            return to
    return BAD


class Decoder:
    """ids -> bytes of whole characters as soon as they are complete. Bytes that aren't UTF-8 pass through as they are."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.table = [[utf8_step(s, b) for b in range(256)] for s in range(8)]
        self.moves: dict[tuple[int, int], tuple[int, int]] = {}
        self.strings = Strings(tokens)
        #: Whether a token leads from between characters to between characters.
        self.closed = np.zeros(len(self.strings.sizes), bool)
        self.closed[[i for i, b in tokens.items() if self._move(0, i) == (0, len(b))]] = True

    def _move(self, state: int, token: int) -> tuple[int, int]:
        """The state after the token, and how many of its bytes complete characters."""
        key = (state, token)
        if key not in self.moves:
            if len(self.moves) >= MOVES:
                self.moves.clear()
            done = 0
            for k, byte in enumerate(self.tokens[token], 1):
                after = self.table[state][byte]
                if after == BAD:  # what was under way and this byte, or this byte as the start of a character
                    after = max(self.table[0][byte], 0) if state else 0
                state = after
                if state == 0:
                    done = k
            self.moves[key] = (state, done)
        return self.moves[key]

    def stream(self, ids):
        """Chunks of bytes, each ending between characters; the last one holds what stayed incomplete."""
        state, held = 0, b""
        for i in ids:
            token = self.tokens[i]
            state, done = self._move(state, i)
            if done:
                yield held + token[:done]
                held = token[done:]
            else:
                held += token
        if held:
            yield held

    def pieces(self, ids: np.ndarray) -> Iterator[bytes]:
        """The bytes of SPELLED ids at a time, each piece ending between characters; the last one holds what stayed incomplete.

        The machine stays between characters over tokens that are closed, so it runs only from the others on until it is back."""
        state, begun, held = 0, 0, b""  # the machine's state and how many bytes it has read of a character
        for start in range(0, len(ids), SPELLED):
            part = ids[start : start + SPELLED]
            opening, at, n = np.flatnonzero(~self.closed[part]).tolist(), 0, len(part)
            for k in [0, *opening] if state else opening:
                if k < at:
                    continue
                at = k
                while at < n:
                    token = int(part[at])
                    state, done = self._move(state, token)
                    begun = len(self.tokens[token]) - done if done else begun + len(self.tokens[token])
                    at += 1
                    if not state:
                        break
            held += self.strings.join(part)
            cut = len(held) - (begun if state else 0)
            if cut:
                yield held[:cut]
                held = held[cut:]
        if held:
            yield held

    def decode(self, ids: list[int]) -> bytes:
        if min(ids, default=0) < 0:
            raise KeyError(min(ids))
        return b"".join(self.pieces(np.asarray(ids, np.int64)))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PreTokens(dict):
    """A worker's cache: pre-token -> packed ids. When half of CACHE is full, it becomes the older half, from which what is
    still in use comes back, and the older half before it goes."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer, self.older = transducer, {}

    def __missing__(self, text: str) -> bytes:
        found = self.older.get(text)
        if found is None:
            found = array("i", self.transducer.encode(text.encode())).tobytes()
        if len(text) <= LONGEST:
            if len(self) >= CACHE // 2:
                self.older = dict(self)
                self.clear()
            self[text] = found
        return found


class Codec:
    """Pre-token pattern, transducer and decoder of one vocabulary, with a worker's cache of pre-tokens."""

    def __init__(self, path: str, pattern: str):
        ranks = load_ranks(path)
        self.split = regex.compile(pattern).findall
        self.transducer, self.decoder = Transducer(ranks), Decoder({r: b for b, r in ranks.items()})
        self.known = PreTokens(self.transducer)
        self.decimals = Strings({r: b" %d" % r for r in ranks.values()})

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.split(text))), np.int32)

    def encode(self, text: str) -> list[int]:
        return self.ids(text).tolist()

    def written(self, ids: np.ndarray) -> Iterator[bytes]:
        """The ids in decimals joined by a space, SPELLED of them at a time."""
        return (self.decimals.join(ids[k : k + SPELLED])[not k :] for k in range(0, len(ids), SPELLED))


def sha256(pieces: Iterator[bytes]) -> str:
    digest = hashlib.sha256()
    for piece in pieces:
        digest.update(piece)
    return digest.hexdigest()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array<int>): the BPE ids of every whole text; null counts as empty, an empty text has no ids."""

    def make():
        own = codec(path, pattern)
        return lambda cols: {"doc_id": cols["doc_id"], "ids": [own.encode(t or "") for t in cols["text"]]}

    return map_columns(texts_of(docs), make, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes: what the ids stand for; null ids count as none."""

    def make():
        own = codec(path, pattern).decoder
        return lambda cols: {"doc_id": cols["doc_id"], "bytes": [own.decode(i or []) for i in cols["ids"]]}

    return map_columns(encoded.select("doc_id", "ids"), make, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256 (the bytes decoded from the ids).

    One row per input row; a null or empty text has no ids, and both digests are then those of nothing. Map-only; other
    columns are not read."""

    def make():
        own = codec(path, pattern)

        def fn(cols: dict) -> dict:
            out: dict = {"doc_id": cols["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in cols["text"]:
                ids = own.ids(text or "")
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(sha256(own.written(ids)))
                out["decoded_sha256"].append(sha256(own.decoder.pieces(ids)))
            return out

        return fn

    return map_columns(texts_of(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

"""Secret scans with one automaton of all rules.

A rule is a head and a run of bytes of a class after it. The heads of all rules, each with the first byte of its run, are
one minimal deterministic automaton; a batch of texts is one buffer that it reads once, many stretches side by side. Each
place where it stops names a rule and where its run begins: the head is read backwards once to find the span's start, and
the run's end is the next byte outside the class, which one look-up gives. Nothing is read again after a failure, so time
is linear in the text whatever it holds. Spans are leftmost, longest, not overlapping within a kind, and without a second
try where a match is too short."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton, compile_rules
from .common import byte_slices, read, texts_of

#: Bytes of texts that are scanned at a time.
SCANNED = 1 << 23

SPANS = "array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A span is what `head` matches, then one or more bytes of the class `run` (none if there is no class), then each of
    `more`, a text followed by the same again. It counts if it, or with `run_only` its run, is `least` bytes or longer."""

    kind: str
    head: str
    run: str
    least: int
    run_only: bool = False
    any_case: bool = False
    more: tuple[str, ...] = ()


# The base kinds, in the order that ties are listed in.
BASE = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?", "[A-Za-z0-9+/_.=-]", 8, run_only=True, any_case=True),
    Rule("access", "AKIA", "[A-Z0-9]", 16),
    Rule("hex", "[0-9a-f]{31}", "[0-9a-f]", 32),
)
# Publicly documented token formats that the method adds.
ADDED = (
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 40),
    Rule("google", "AIza", "[A-Za-z0-9_-]", 39),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]", 15),
    Rule("stripe", "[rs]k_(live|test)_", "[A-Za-z0-9]", 24),
    Rule("jwt", "eyJ", "[A-Za-z0-9_-]", 30, more=(".eyJ", ".")),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "", 27),
)
RULES = BASE + ADDED


@cache
def automata(rules: tuple[Rule, ...]) -> tuple[Automaton, tuple[tuple[Automaton, np.ndarray], ...]]:
    """The automaton of all rules, and for each rule its head backwards and the bytes of its run."""
    own = []
    for r in rules:
        run = np.zeros(256, bool)
        if r.run:
            one = compile_rules([(r.run, r.any_case)], anchored=True)
            run[:] = one.accepts[one.next[:256] >> 8] > 0
        own.append((compile_rules([(r.head + r.run, r.any_case)], anchored=True, backward=True), run))
    return compile_rules([(r.head + r.run, r.any_case) for r in rules]), tuple(own)


def rule_spans(data: bytes, stops: np.ndarray, rule: Rule, own: tuple[Automaton, np.ndarray]) -> list[tuple[int, int]]:
    """Byte spans of one rule in one text; stops: where the automaton has stopped for it, in order."""
    if not len(stops):
        return []
    back, run = own
    outside = np.flatnonzero(~run[np.frombuffer(data, np.uint8)]) if rule.run else None

    def run_end(at: int) -> int:
        k = int(np.searchsorted(outside, at))
        return int(outside[k]) if k < len(outside) else len(data)

    found, at, k = [], 0, 0
    while k < len(stops):
        begun = int(stops[k])
        k += 1
        start = back.first_start(data, begun)
        if start < at:
            continue
        end = run_end(begun) if rule.run else begun
        for text in rule.more:
            after = end + len(text)
            end = run_end(after) if data.startswith(text.encode(), end) else after
            if end == after:
                break
        else:
            if (end - begun + 1 if rule.run_only else end - start) >= rule.least:
                found.append((start, end))
            at, k = end, max(k, int(np.searchsorted(stops, end, "right")))
    return found


def text_spans(data: bytes, stops: np.ndarray, bits: np.ndarray, rules: tuple[Rule, ...], own: tuple) -> list[dict]:
    """The spans of all rules in one text, in code points, by start and then rule."""
    order = np.argsort(stops, kind="stable")
    stops, bits = stops[order], bits[order]
    found = sorted((a, k, b) for k, r in enumerate(rules) for a, b in rule_spans(data, stops[bits >> k & 1 == 1], r, own[k]))
    if not data.isascii():
        points = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
        found = [(int(points[a]), k, int(points[b])) for a, k, b in found]
    return [{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in found]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, spans (array of kind, start, end in code points, end exclusive; empty where nothing is found).

    One row per input row, in a map-only plan; a null text counts as empty; other columns are not read."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    compiled = docs.sparkSession.sparkContext.broadcast(automata(rules))  # as large as the rules make it: about 1 MB

    def run(batches):
        scanner, own = compiled.value
        for whole in batches:
            for batch in byte_slices(whole, 1, SCANNED):
                texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
                stops, bits = scanner.scan(b"\n".join(texts))
                spans: list[list] = [[] for _ in texts]
                if len(stops):
                    after = np.cumsum([len(t) + 1 for t in texts])
                    row = np.searchsorted(after, stops)
                    order = np.argsort(row, kind="stable")
                    rows, first = np.unique(row[order], return_index=True)
                    for k, at in zip(rows.tolist(), np.split(order, first[1:]), strict=True):
                        spans[k] = text_spans(texts[k], stops[at] - (after[k] - len(texts[k]) - 1), bits[at], rules, own)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return texts_of(docs).mapInArrow(run, f"doc_id long, spans {SPANS}")


def digest_columns(found: DataFrame, kinds: tuple[str, ...], base: str = "spans") -> DataFrame:
    """doc_id, n_<kind> and base_sha256 of the base spans (column `base`, those of the base kinds), spans; spans are
    kind:start:end joined by commas."""
    listed = "concat_ws(',', transform({}, s -> concat_ws(':', s.kind, cast(s.start as string), cast(s.end as string))))"
    own = "filter({}, s -> s.kind in ({}))".format(base, ", ".join(f"'{k}'" for k in kinds))
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter({base}, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in kinds],
        F.sha2(F.expr(listed.format(own)), 256).alias("base_sha256"),
        F.expr(listed.format("spans")).alias("spans"),
    )


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    return digest_columns(find_secrets(read(spark, sf_dir, "documents")), tuple(r.kind for r in BASE))

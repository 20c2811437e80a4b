"""Personal data by weak supervision.

Spans that the base patterns accept always count. Wider patterns propose more candidates; five labelers (pattern,
checksum, gazetteer, context, shape) vote on every candidate, base spans included. Expectation-maximisation over the
counts of vote combinations, from all documents, estimates how reliable each labeler is for each kind; its posteriors
train a logistic classifier of candidates, and those it accepts are added. A candidate is described by its kind and its
cell (votes, digits, separators), of which there are a few thousand, so the corpus enters the fit as one bounded count
table, and the fitted classifier is a set of accepted cells."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship
from .common import SLICE_ROWS, map_columns, read, texts_of
from .secrets import SPANS, digest_columns

#: Kinds in the order that ties are listed in.
KINDS = ("email", "ip", "card", "phone")

# Base patterns. A run of digits is taken whole or not at all, which a look-behind says without retries.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Wider patterns that propose candidates.
_MORE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?)[A-Za-z0-9-]{1,63}){1,4}", re.I),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){12,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z.+])\(?[0-9]{2,4}\)?(?:[\x20.-][0-9]{2,4}){2,4}(?![0-9A-Za-z])"),
}
# Gazetteers and words of the context labeler.
_TLDS = {"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "it", "nl", "eu", "ch", "at", "us", "info"}
_CARD_STARTS = ("4", "51", "52", "53", "54", "55", "34", "37", "36", "38", "6011", "65", "35", "62", "22", "23", "24", "25", "26", "27")
_CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "82", "86", "91")
_FOR = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|correo|courriel|write)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|adresse|addr)\b", re.I),
    "card": re.compile(r"\b(?:card|credit|visa|mastercard|amex|carte|karte|tarjeta)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|mobile|cell|fax|t[ée]l[ée]phone|telefon|tel[ée]fono)\b", re.I),
}
_AGAINST = re.compile(r"\b(?:version|order|isbn|issn|ref|id|no|number|serial|invoice|build|section)\b[.:#]?\s*$", re.I)

VOTERS = 5
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns: leftmost, not overlapping within a kind, failing matches dropped."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        # the match at this @ begins where the characters before it that a local part may hold begin
        start = at
        while start > free and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, "email", m.end()))
            free = m.end()
        free = max(free, at + 1)
        at = text.find("@", free)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := q.lstrip("0")) <= 3 and int(p or 0) <= 255 for q in m[0].split(".")):
                found.append((m.start(), "ip", m.end()))
        for m in _CARD.finditer(text):
            d = _digits(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                found.append((m.start(), "card", m.end()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 10 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), "phone", m.end()))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def votes(text: str, start: int, kind: str, end: int, base: bool) -> tuple[int, ...]:
    """+1, -1 or 0 (no opinion) of each labeler."""
    span, before = text[start:end], text[max(0, start - 40) : start]
    d = _digits(span)
    if kind == "card":
        check, listed = (1 if luhn(d) else -1), (1 if d.startswith(_CARD_STARTS) else -1)
    elif kind == "phone":
        check = 1 if 10 <= len(d) <= 13 else -1
        listed = 0 if not base else 1 if d.startswith(_CALLING) else -1
    elif kind == "email":
        check = 1 if 3 <= len(span) <= 254 else -1
        listed = 1 if re.split(r"[.\])\x20]+", span)[-1].lower() in _TLDS else -1
    else:
        check = 1
        listed = -1 if span.startswith(("0.", "127.", "255.")) else 0
    context = 1 if _FOR[kind].search(before) else -1 if _AGAINST.search(before) else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    shape = -1 if (left and (left.isalnum() or left in "./-_")) or (right and (right.isalnum() or right in "/-_@")) else 1
    return (1 if base else -1, check, listed, context, shape)


def candidates(text: str) -> list[tuple[int, str, int, bool, int]]:
    """(start, kind, end, base, cell) of base spans and of wider matches that overlap none of them."""
    base = base_spans(text)
    found = [(a, k, b, True) for a, k, b in base]
    taken: list[tuple[int, int]] = []  # what base spans cover, without overlaps
    for a, _, b in base:
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    digits = bool(_DIGIT.search(text))
    for kind, pattern in _MORE.items():
        if kind == "email":
            if not ("[" in text or "(" in text) or not re.search(r"[\[(]\x20?at\x20?[\])]", text, re.I):
                continue
        elif not digits and kind != "ip" or kind == "ip" and text.count(":") < 7:
            continue
        for m in pattern.finditer(text):
            k = bisect_right(taken, m.start(), key=lambda s: s[0])  # the last that begins here or before, and the next one
            if not ((k and taken[k - 1][1] > m.start()) or (k < len(taken) and taken[k][0] < m.end())):
                found.append((m.start(), kind, m.end(), False))
    out = []
    for a, k, b, is_base in sorted(found, key=lambda s: (s[0], KINDS.index(s[1]), s[2])):
        cell = 0
        for v in votes(text, a, k, b, is_base):
            cell = cell * 3 + v + 1
        span = text[a:b]
        n, marks = len(_digits(span)), sum(c in " .-()" for c in span)
        out.append((a, k, b, is_base, (cell * 5 + min(4, n // 4)) * 4 + min(3, marks)))
    return out


def cell_votes(cell: int) -> np.ndarray:
    cell //= 20
    return np.array([cell // 3**k % 3 for k in range(VOTERS - 1, -1, -1)]) - 1


def estimate(vote: np.ndarray, count: np.ndarray, rounds: int = 50, prior: float = 4.0) -> tuple[np.ndarray, float, np.ndarray]:
    """Expectation-maximisation: P(true) of each combination of votes, the share of true ones, and P(vote | truth) by labeler.

    Pseudo-counts hold that a labeler is rather right than wrong; votes of 0 carry what they are found to carry."""
    p = 1 / (1 + np.exp(-vote.sum(1).astype(float)))
    hope = np.array([[[0.6, 0.2, 0.2], [0.2, 0.2, 0.6]]] * VOTERS) * prior  # labeler, truth, vote
    share, table = 0.5, hope / prior
    for _ in range(rounds):
        for v in range(VOTERS):
            for truth, weight in ((0, 1 - p), (1, p)):
                seen = np.bincount(vote[:, v] + 1, count * weight, 3) + hope[v, truth]
                table[v, truth] = seen / seen.sum()
        share = float((count @ p + prior / 2) / (count.sum() + prior))
        odds = np.log(share / (1 - share)) + sum(np.log(table[v, 1][vote[:, v] + 1] / table[v, 0][vote[:, v] + 1]) for v in range(VOTERS))
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p, share, table


def _features(cells: np.ndarray) -> np.ndarray:
    vote = np.array([cell_votes(c) for c in cells.tolist()]).reshape(-1, VOTERS)
    hot = [vote[:, v] == s for v in range(VOTERS) for s in (-1, 1)]
    hot += [cells // 4 % 5 == k for k in range(5)] + [cells % 4 == k for k in range(4)]
    return np.column_stack([np.ones(len(cells)), *hot]).astype(float)


def train(cells: np.ndarray, count: np.ndarray, soft: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Logistic regression on soft labels, weighted by counts: P(true) of each cell."""
    x, w = _features(cells), np.zeros(_features(cells[:1]).shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (count * (soft - p)) - ridge * w
        step = np.linalg.solve(x.T @ (x * (count * p * (1 - p))[:, None]) + ridge * np.eye(len(w)), gradient)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


@dataclass(frozen=True)
class PiiModel:
    accepted: frozenset[tuple[str, int]]
    reliability: dict[str, list]


CANDIDATES = "array<struct<kind:string,start:int,end:int,base:boolean,cell:int>>"


def pii_candidates(docs: DataFrame) -> DataFrame:
    """doc_id, found: every text's candidates with their cells, by start and then kind. Null texts have none."""

    def make():
        def fn(cols: dict) -> dict:
            names = ("start", "kind", "end", "base", "cell")
            return {"doc_id": cols["doc_id"], "found": [[dict(zip(names, c, strict=True)) for c in (candidates(t) if t else ())] for t in cols["text"]]}

        return fn

    return map_columns(texts_of(docs), make, f"doc_id long, found {CANDIDATES}")


def fit_pii(found: DataFrame, least: float = 0.9) -> PiiModel:
    """Counts of (kind, cell) over all candidates -> labelers' reliabilities and the accepted cells.

    A cell is accepted if both the classifier and the labelers' posterior hold it for true: the classifier spreads what
    is learned over cells, and may not overrule the votes."""
    cells = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.cell").count()
    rows = cells.collect()  # 4 * 4860 at most
    accepted, reliability = set(), {}
    for kind in KINDS:
        own = sorted((r["cell"], r["count"]) for r in rows if r["kind"] == kind)
        if not own:
            continue
        cells, count = np.array([c for c, _ in own]), np.array([n for _, n in own], float)
        soft, share, table = estimate(np.array([cell_votes(c) for c in cells.tolist()]), count)
        p = train(cells, count, soft)
        accepted |= {(kind, int(c)) for c, x, y in zip(cells, p, soft, strict=True) if min(x, y) >= least}
        reliability[kind] = [share, table.tolist()]
    return PiiModel(frozenset(accepted), reliability)


def text_pii(text: str, model: PiiModel) -> list[tuple[int, str, int, bool]]:
    return [(a, k, b, base) for a, k, b, base, cell in candidates(text) if base or (k, cell) in model.accepted]


def find_pii(docs: DataFrame, model: PiiModel | None = None) -> DataFrame:
    """doc_id, base (spans of the base patterns), spans (those and what the classifier adds), of every whole text.

    Spans hold kind, start and end in code points, end exclusive, by start and then kind. A null text counts as empty;
    one row per input row; other columns are not read. The model is fitted on docs unless given. Texts are read once:
    their candidates, written out, serve both the fit and the result."""
    found = cut(pii_candidates(docs), "candidates")
    own = docs.sparkSession.sparkContext.broadcast((model or fit_pii(found)).accepted)

    def make():
        def fn(cols: dict) -> dict:
            out: dict = {"doc_id": cols["doc_id"], "base": [], "spans": []}
            for listed in cols["found"]:
                spans = [({k: c[k] for k in ("kind", "start", "end")}, c["base"]) for c in listed if c["base"] or (c["kind"], c["cell"]) in own.value]
                out["base"].append([s for s, base in spans if base])
                out["spans"].append([s for s, _ in spans])
            return out

        return fn

    return map_columns(found, make, f"doc_id long, base {SPANS}, spans {SPANS}")


def redact_pii(docs: DataFrame, model: PiiModel | None = None) -> DataFrame:
    """docs with every found span replaced by its kind in angle brackets (<EMAIL>); n_chars, if there, follows. Overlapping
    spans are replaced together, by the first one's kind. Nulls stay null; all other columns stay as they are."""
    ship(docs.sparkSession)
    own = docs.sparkSession.sparkContext.broadcast(model or fit_pii(cut(pii_candidates(docs), "candidates")))
    schema, names = docs.schema, docs.columns

    def clean(text: str) -> str:
        out, at = [], 0
        for a, kind, b, _ in text_pii(text, own.value):
            if a >= at:
                out += [text[at:a], f"<{kind.upper()}>"]
            at = max(at, b)
        return "".join([*out, text[at:]]) if at else text

    def run(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(first, SLICE_ROWS)
                old = batch.column(names.index("text")).to_pylist()
                new = [t and clean(t) for t in old]
                columns = dict(zip(names, batch.columns, strict=True))
                columns["text"] = pa.array(new, columns["text"].type)
                if "n_chars" in columns:
                    kept = columns["n_chars"]
                    columns["n_chars"] = pa.array([n if t is u or t == u else len(u) for n, t, u in zip(kept.to_pylist(), old, new, strict=True)], kept.type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)

    return docs.mapInArrow(run, schema)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    return digest_columns(find_pii(read(spark, sf_dir, "documents")), KINDS, base="base")

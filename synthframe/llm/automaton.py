"""Regular expressions over bytes -> one minimal deterministic automaton in transition arrays.

`compile_rules` parses each rule (literals, classes, groups, | ? * + {m} {m,} {m,n}; ASCII only), builds one
nondeterministic automaton of all of them, determinises it by subset construction and merges equal states by partition
refinement. `Automaton.scan` runs many stretches of a buffer side by side, one byte of each a step, so every byte is read
once for all rules together."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

import numpy as np

_CLASS_ESCAPES = {"t": 9, "n": 10, "r": 13}


class _Parser:
    """Recursive descent into a nondeterministic automaton: fragments are (first state, last state)."""

    def __init__(self, backward: bool = False):
        self.backward = backward
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def parse(self, pattern: str, any_case: bool) -> tuple[int, int]:
        self.text, self.at, self.any_case = pattern, 0, any_case
        node = self._either()
        if self.at < len(pattern):
            raise ValueError(f"stray {pattern[self.at]!r} at {self.at} in {pattern!r}")
        return self._build(node)

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _next(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def _either(self):
        options = [self._sequence()]
        while self._peek() == "|":
            self._next()
            options.append(self._sequence())
        return ("or", options)

    def _sequence(self):
        parts = []
        while self._peek() not in ("", "|", ")"):
            node = self._atom()
            while self._peek() in ("?", "*", "+", "{") and self._peek():
                c = self._next()
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, 0))
                if c == "{":
                    end = self.text.index("}", self.at)
                    a, comma, b = self.text[self.at : end].partition(",")
                    least, most, self.at = int(a), (int(b) if b else None) if comma else int(a), end + 1
                node = ("repeat", node, least, most)
            parts.append(node)
        return ("then", parts)

    def _byte(self) -> int:
        c = self._next()
        if c != "\\":
            return ord(c)
        c = self._next()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return _CLASS_ESCAPES.get(c, ord(c))

    def _atom(self):
        c = self._peek()
        if c == "(":
            self._next()
            if self.text.startswith("?:", self.at):
                self.at += 2
            node = self._either()
            if self._next() != ")":
                raise ValueError(f"unclosed group in {self.text!r}")
            return node
        if c == "[":
            self._next()
            chosen: set[int] = set()
            negated = self._peek() == "^"
            self.at += negated
            while self._peek() != "]":
                first = self._byte()
                if self._peek() == "-" and self.text[self.at + 1] != "]":
                    self._next()
                    chosen.update(range(first, self._byte() + 1))
                else:
                    chosen.add(first)
            self._next()
            return ("byte", self._cased(frozenset(range(256)) - chosen if negated else frozenset(chosen)))
        return ("byte", self._cased(frozenset([self._byte()])))

    def _cased(self, chosen: frozenset[int]) -> frozenset[int]:
        if not self.any_case:
            return chosen
        return chosen | {x ^ 32 for x in chosen if 65 <= x & ~32 <= 90}

    def _build(self, node) -> tuple[int, int]:
        kind = node[0]
        if kind == "byte":
            a, b = self.state(), self.state()
            self.moves[a].append((node[1], b))
            return a, b
        if kind == "repeat":
            _, inner, least, most = node
            parts = [inner] * least
            first = last = self.state()
            for part in parts:
                a, b = self._build(part)
                self.empty[last].append(a)
                last = b
            if most is None:
                a, b = self._build(inner)
                loop = self.state()
                self.empty[last].append(loop)
                self.empty[loop].append(a)
                self.empty[b].append(loop)
                return first, loop
            end = self.state()
            self.empty[last].append(end)
            for _ in range(most - least):
                a, b = self._build(inner)
                self.empty[last].append(a)
                self.empty[b].append(end)
                last = b
            return first, end
        first, last = self.state(), self.state()
        if kind == "or":
            for option in node[1]:
                a, b = self._build(option)
                self.empty[first].append(a)
                self.empty[b].append(last)
            return first, last
        at = first
        for part in reversed(node[1]) if self.backward else node[1]:
            a, b = self._build(part)
            self.empty[at].append(a)
            at = b
        self.empty[at].append(last)
        return first, last


@dataclass(frozen=True)
class Automaton:
    """next: state * 256 + byte -> next state * 256 (state 0 is the start); accepts: bit k of state s is set if rule k ends there."""

    next: np.ndarray
    accepts: np.ndarray
    first_accepting: int

    def scan(self, data: bytes, reset: int = 10, lanes: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """(ends, rule bits) of all matches in data, ends exclusive. After `reset` every match starts anew.

        The buffer is cut into equal stretches that run side by side from the start state. A stretch that really begins
        in the middle of something is run again from the state before it, until both runs agree."""
        if not data:
            return np.empty(0, np.int64), np.empty(0, self.accepts.dtype)
        lanes = max(1, min(lanes, len(data) // 256))
        steps = -(-len(data) // lanes)
        grid = np.full(lanes * steps, reset, np.uint8)
        grid[: len(data)] = np.frombuffer(data, np.uint8)
        columns = np.ascontiguousarray(grid.reshape(lanes, steps).T)
        state, index = np.zeros(lanes, np.int32), np.empty(lanes, np.int32)
        least = self.first_accepting * 256
        ends, bits = [], []
        for k in range(steps):
            np.add(state, columns[k], out=index)
            np.take(self.next, index, out=state, mode="clip")
            if state.max() >= least:
                hit = np.flatnonzero(state >= least)
                ends.append(hit * steps + k + 1)
                bits.append(self.accepts[state[hit] >> 8])
        raw = grid.tobytes()
        for lane in range(1, lanes):
            true, guess, at = int(state[lane - 1]), 0, lane * steps
            while true != guess and at < (lane + 1) * steps:
                true, guess = int(self.next[true + raw[at]]), int(self.next[guess + raw[at]])
                at += 1
                if true >= least:
                    ends.append(np.array([at]))
                    bits.append(self.accepts[[true >> 8]])
            if true != guess:
                state[lane] = true
        if not ends:
            return np.empty(0, np.int64), np.empty(0, self.accepts.dtype)
        ends, bits = np.concatenate(ends), np.concatenate(bits)
        keep = ends <= len(data)
        return ends[keep], bits[keep]

    def first_start(self, data: bytes, end: int) -> int:
        """For an anchored automaton of reversed rules: the first byte from which a match reaches to end, or -1."""
        state, found, step, least, sink = 0, -1, self.next, self.first_accepting * 256, self.sink
        for at in range(end - 1, -1, -1):
            state = int(step[state + data[at]])
            if state >= least:
                found = at
            elif state == sink:
                break
        return found

    @cached_property
    def sink(self) -> int:
        """The state (* 256) that nothing leads out of and that accepts nothing, or -1."""
        rows = self.next.reshape(-1, 256)
        own = np.flatnonzero((rows == (np.arange(len(rows)) * 256)[:, None]).all(axis=1) & (self.accepts == 0))
        return int(own[0]) * 256 if len(own) else -1


def compile_rules(rules: Iterable[tuple[str, bool]], anchored: bool = False, backward: bool = False) -> Automaton:
    """rules: (pattern, letters in either case). Unanchored, a match may begin at every byte. Backward, it reads from the end."""
    nfa = _Parser(backward)
    start = nfa.state()
    accept: dict[int, int] = {}
    for k, (pattern, any_case) in enumerate(rules):
        first, last = nfa.parse(pattern, any_case)
        nfa.empty[start].append(first)
        accept[last] = 1 << k

    def closure(states: Iterable[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in nfa.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(s for s in seen if nfa.moves[s] or s in accept)

    base = closure([start])
    ids, order, rows = {base: 0}, [base], []
    for subset in order:
        to: list[set[int]] = [set() for _ in range(256)]
        for s in subset:
            for chosen, target in nfa.moves[s]:
                for b in chosen:
                    to[b].add(target)
        row, memo = [], {}
        for targets in to:
            key = frozenset(targets)
            if key not in memo:
                found = closure(key) if anchored else closure(key) | base
                if found not in ids:
                    ids[found] = len(order)
                    order.append(found)
                memo[key] = ids[found]
            row.append(memo[key])
        rows.append(row)
    table = np.array(rows, np.int32)
    bits = np.array([sum(accept.get(s, 0) for s in subset) for subset in order], np.int64)
    part = np.unique(bits, return_inverse=True)[1]
    while True:  # split classes until equal states go to equal classes on every byte
        finer = np.unique(np.column_stack((part, part[table])), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    sample = np.zeros(part.max() + 1, np.int64)
    sample[part[::-1]] = np.arange(len(part))[::-1]
    rank = np.lexsort((sample, bits[sample] != 0))  # the start first, accepting states last
    where = np.empty_like(rank)
    where[rank] = np.arange(len(rank))
    merged = where[part[table[sample[rank]]]]
    return Automaton((merged * 256).astype(np.int32).ravel(), bits[sample[rank]], int((bits[sample] == 0).sum()))

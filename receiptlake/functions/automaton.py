"""Many patterns in many texts in one pass: an Aho-Corasick automaton held in sorted arrays.

States are numbered by depth. All texts of an Arrow batch are stepped through
together, one character of each at a time, so that there is no loop over texts;
a batch's equal texts are read once. The arrays take some 25 bytes for each
character of the patterns, and are broadcast: ``LARGEST`` bounds those characters.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Characters of all patterns together, above which no automaton is made.
LARGEST = 4_000_000


class Automaton:
    def __init__(self, patterns: Sequence[str]):
        children: dict[int, int] = {}
        parent, char, depth, ends = [0], [0], [0], []
        for p in patterns:
            s = 0
            for c in map(ord, p):
                t = children.get(s << 21 | c)
                if t is None:
                    t = children[s << 21 | c] = len(parent)
                    parent.append(s), char.append(c), depth.append(depth[s] + 1)
                s = t
            ends.append(s)
        depth_ = np.array(depth)
        order = np.argsort(depth_, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        parent_, self.char = number[np.array(parent)[order]], np.array(char, np.int64)[order]
        edges = (parent_ << 21 | self.char)[1:]
        at = np.argsort(edges)
        self.edges, self.targets = edges[at], at + 1
        ends_ = number[np.array(ends, np.int64)] if ends else np.zeros(0, np.int64)
        by_state = np.argsort(ends_, kind="stable")
        self.at_end, self.ids = ends_[by_state], by_state  # patterns, by the state where they end
        self.fail = np.zeros(len(order), np.int64)
        level = np.searchsorted(depth_[order], np.arange(depth_.max() + 2))
        own = np.zeros(len(order), bool)
        own[ends_] = True
        self.link = np.full(len(order), -1)  # the longest proper suffix where a pattern ends
        for lo, hi in zip(level[1:-1], level[2:], strict=True):
            if lo > 1:
                up = parent_[lo:hi]
                self.fail[lo:hi] = np.where(up > 0, self._step(self.fail[up], self.char[lo:hi]), 0)
            back = self.fail[lo:hi]
            self.link[lo:hi] = np.where(own[back] & (back > 0), back, self.link[back])
        self.telling = own | (self.link >= 0)
        self.empty = np.flatnonzero(np.array([not p for p in patterns], bool))
        self.telling[0] = False

    def _step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        out = np.zeros(len(state), np.int64)
        if not len(self.edges):
            return out
        open_ = np.arange(len(state))
        while len(open_):
            key = state << 21 | char[open_]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[at] == key
            out[open_[hit]] = self.targets[at[hit]]
            more = ~hit & (state > 0)
            open_, state = open_[more], self.fail[state[more]]
        return out

    def find(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, pattern) for every text and pattern that it holds, in order; nulls hold none."""
        lengths = np.asarray(pc.fill_null(pc.utf8_length(texts), 0)).astype(np.int64)
        points = np.frombuffer("".join(t for t in texts.to_pylist() if t).encode("utf-32-le"), "<u4").astype(np.int64)
        order = np.argsort(-lengths, kind="stable")
        start, length = (np.cumsum(lengths) - lengths)[order], lengths[order]
        state, seen = np.zeros(len(order), np.int64), []
        for i in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -i, "left"))  # those longer than i
            state[:n] = self._step(state[:n], points[start[:n] + i])
            hot = np.flatnonzero(self.telling[state[:n]])
            if len(hot):
                seen.append((order[hot], state[hot]))
        where, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        text, at = (np.concatenate(x) for x in zip(*seen, strict=True)) if seen else (where[0], where[0])
        while len(text):
            lo, hi = np.searchsorted(self.at_end, at), np.searchsorted(self.at_end, at, "right")
            n = hi - lo
            where.append(np.repeat(text, n))
            which.append(self.ids[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())])
            at = self.link[at]
            text, at = text[at >= 0], at[at >= 0]
        if len(self.empty):
            known = np.flatnonzero(np.asarray(texts.is_valid()))
            where.append(np.repeat(known, len(self.empty)))
            which.append(np.tile(self.empty, len(known)))
        many = max(1, len(self.ids))
        return np.divmod(np.unique(np.concatenate(where) * many + np.concatenate(which)), many)


def held_patterns(spark: SparkSession, text: Column, patterns: Sequence[str], groups: Sequence[int] | None = None) -> Column:
    """array<int>: the places of the patterns that a text holds, in order; with groups only the first of each group.

    Patterns are bounded by LARGEST, which callers check before they gather them."""
    if sum(map(len, patterns)) > LARGEST:
        raise ValueError("too many patterns for one automaton")
    known = spark.sparkContext.broadcast((Automaton(patterns), None if groups is None else np.array(groups, np.int64)))

    def held(texts: pa.Array) -> pa.Array:
        automaton, group = known.value
        coded = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).dictionary_encode()
        at, pattern = automaton.find(coded.dictionary)
        if group is not None and len(at):
            pair = at * (int(group.max()) + 1) + group[pattern]
            first = np.sort(np.unique(pair, return_index=True)[1])
            at, pattern = at[first], pattern[first]
        ends = np.searchsorted(at, np.arange(len(coded.dictionary) + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(pattern, pa.int32()))
        return pc.fill_null(lists.take(coded.indices), pa.scalar([], pa.list_(pa.int32())))

    return F.arrow_udf(held, "array<int>")(text)

"""Periodic runs of words, found by descending-LCP Kruskal.

The suffixes of a document's words, sorted, are the nodes; neighbours are joined by an edge that
weighs their longest common prefix. Edges are taken by decreasing weight l and unite classes of
suffixes, each an ordered set of positions, the smaller one into the larger. Where two positions of
a class become neighbours at l, and are no more than l words apart, the words from the first to l
words after the second have that distance as a period: such a pair is the seed of a run. Every run
has one seed that no word before extends, at its first word, and only those are kept; a period that
is not the smallest has no seed, for a position between the two would be in the class.

A run of period q and length n has a seed of weight n - q, so edges under the least such weight are
left out. A document in which no stretch of so many words repeats has no run at all: a rolling hash
tells that before anything is sorted.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_binary, small_batches, text_rows


class Run(NamedTuple):
    start: int
    length: int
    period: int


def least_weight(least_length: int, least_periods: int) -> int:
    """The least of length - period over all runs of at least that length and so many periods."""
    return min(max(least_length, least_periods * q) - q for q in range(1, least_length + 1))


def word_numbers(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def may_repeat(numbers: np.ndarray, width: int) -> bool:
    """Whether some `width` words in a row may stand at two places; never False where they do."""
    if len(numbers) <= width:
        return False
    one = (numbers.astype(np.uint64) + np.uint64(1)) * _MIX
    one ^= one >> np.uint64(29)
    total, done = np.zeros(len(one) + 1, np.uint64), 0
    for bit in bin(width)[2:]:  # hashes of `done` words, doubled, and one word more where the bit is set
        if done:
            total = total[:-done] * _ODD + (total[done:] ^ total[done:] >> np.uint64(31))
            done *= 2
        if bit == "1":
            total, done = total[: len(one) - done] * _MIX + one[done:], done + 1
    grams = np.sort(total)
    return bool((grams[1:] == grams[:-1]).any())


def suffix_array(numbers: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in their order, by doubling: only groups that are not told apart yet are sorted again."""
    n = len(numbers)
    order = np.argsort(numbers, kind="stable")
    head = np.concatenate([[True], numbers[order][1:] != numbers[order][:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[n] = -1
    done = 1
    while True:
        alone = head & np.concatenate([head[1:], [True]])
        slots = np.flatnonzero(~alone)
        if not len(slots):
            return order
        at = order[slots]
        first, second = rank[at], rank[np.minimum(at + done, n)]
        by = np.lexsort((second, first))
        at, first, second = at[by], first[by], second[by]
        order[slots] = at
        fresh = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        head[slots] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, slots, 0))
        done *= 2


def neighbour_prefixes(numbers: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each suffix in sorted order but the first, the length of what it shares with the one before."""
    words, n = numbers.tolist(), len(numbers)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared, size = [0] * n, 0
    for i, j in enumerate(before.tolist()):
        if j < 0:
            size = 0
            continue
        most = n - max(i, j)
        while size < most and words[i + size] == words[j + size]:
            size += 1
        shared[i] = size
        size = max(0, size - 1)
    return np.array(shared, np.int64)[order[1:]]


class PositionSets:
    """Union-find whose classes are ordered sets of positions."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.members: dict[int, list[int]] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = parent.setdefault(x, x)
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def of(self, x: int) -> list[int]:
        top = self.root(x)
        return self.members.setdefault(top, [top])

    def unite(self, x: int, y: int) -> list[int]:
        """Put the smaller class into the larger; returns the positions that moved."""
        small, large = sorted((self.of(x), self.of(y)), key=len)
        if small is large:
            return []
        top = self.root(large[0])
        moved = self.members.pop(self.root(small[0]))
        self.parent[self.root(moved[0])] = top
        if len(moved) * 8 > len(large):
            large += moved
            large.sort()
        else:
            for position in moved:
                insort(large, position)
        return moved


def find_runs(numbers: np.ndarray, least_length: int = 24, least_periods: int = 3) -> list[Run]:
    """All runs by start, then period: stretches that keep their smallest period q and cannot be extended, max(least_length, least_periods * q) words long or longer."""
    weight = least_weight(least_length, least_periods)
    if not may_repeat(numbers, weight):
        return []
    order = suffix_array(numbers)
    shared = neighbour_prefixes(numbers, order)
    edges = np.flatnonzero(shared >= weight)
    edges = edges[np.argsort(-shared[edges], kind="stable")]
    words, n = numbers.tolist(), len(numbers)
    sets, found = PositionSets(), set()

    def seed(first: int, second: int, size: int) -> None:
        period = second - first
        if period > size or period + size < max(least_length, least_periods * period):
            return
        if second + size < n and words[first + size] == words[second + size]:
            return  # neighbours since a higher weight
        if not first or words[first - 1] != words[second - 1]:
            found.add(Run(first, period + size, period))

    lefts, rights, weights = order[edges].tolist(), order[edges + 1].tolist(), shared[edges].tolist()
    at = 0
    while at < len(weights):
        size, moved = weights[at], []
        while at < len(weights) and weights[at] == size:  # all of one weight, before neighbours are looked at
            moved += sets.unite(lefts[at], rights[at])
            at += 1
        for position in moved:
            members = sets.of(position)
            place = bisect_left(members, position)
            if place:
                seed(members[place - 1], position, size)
            if place + 1 < len(members):
                seed(position, members[place + 1], size)
    return sorted(found, key=lambda r: (r.start, r.period))


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words, joined by one space, without those that stand in a run after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for run in runs:
        gone[run.start + run.period] += 1
        gone[run.start + run.length] -= 1
    return b" ".join([w for w, cover in zip(words, np.cumsum(gone).tolist(), strict=False) if not cover])


_RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"


def periodic_runs(docs: DataFrame, least_length: int = 24, least_periods: int = 3, before: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of docs(doc_id, text).

    Words are what white space (U+0020, U+0009 to U+000D) leaves; runs are ordered by start, then
    period; `collapsed` is the text, words joined by one space, without what only repeats a period
    (UTF-8 bytes). `before` may change a document's words first. Null and empty texts have no words
    and no runs, and an empty text as `collapsed`. Repeated rows give repeated rows, and a null
    doc_id is passed on. Nothing is shuffled: a run lies in one document.
    """
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in Run._fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, limit=1 << 20):
            sizes, runs, texts = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), text_rows(batch), strict=True):
                words = (text or b"").split()
                if before is not None:
                    words = before(doc_id, words)
                found = find_runs(word_numbers(words), least_length, least_periods)
                sizes.append(len(words))
                runs.append([r._asdict() for r in found])
                texts.append(collapsed(words, found) if found else b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])

    return as_binary(docs).mapInArrow(run, _RUNS)

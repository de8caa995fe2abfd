"""Benchmark decontamination by greedy string tiling.

Documents that share a run of five words with a test item are seeds; for each such pair the longest
common runs of unmarked words are marked again and again, longest first, each found by running
Karp-Rabin over windows of one length. A document is contaminated if the tiles cover enough of an
item's words, in whatever order they stand.

The benchmark is the stated query set. It is read in blocks of bounded size, each an index that every
task holds while documents stream past, so documents are never shuffled. Where it fills more than one
block, a bitmap of its runs first picks the few documents that share any, and only these go through
the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, quoted, ready, save, small_batches, spare

LEAST_RUN = 5
COVERAGE = 0.8
#: Bytes of test items in a block; an item that is longer is a block of its own.
BLOCK_BYTES = 4 << 20

_U = np.uint64
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_WORD = np.zeros(256, np.uint8)  # lower-cased bytes of words; 0 between words
for _b in b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)):
    _WORD[_b] = _b
for _b in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _WORD[_b] = _b + 32
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_VALUE[0] = 0
_CHUNK = 1 << 20
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 12), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _window_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Karp-Rabin hashes of values[start:end], all from one running sum."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _power(base, n), out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * _power(pow(base, -1, 1 << 64), n + 1)[starts])


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(a 64-bit hash of each word, the word's first byte). Words: ASCII letters (A-Z as a-z), digits and all bytes beyond ASCII."""
    raw = np.frombuffer(data, np.uint8)
    hashes, firsts, at = [], [], 0
    while at < len(raw):
        end = min(len(raw), at + _CHUNK)
        while end < len(raw) and _WORD[raw[end]] and _WORD[raw[end - 1]]:
            end += 1  # never cut a word
        word = _WORD[raw[at:end]]
        edge = np.diff((word > 0).view(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        hashes.append(_window_hashes(_VALUE[word], starts, ends, _BASE))
        firsts.append(starts + at)
        at = end
    return (np.concatenate(hashes), np.concatenate(firsts)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def seeds_of(words: np.ndarray, run: int = LEAST_RUN) -> np.ndarray:
    """A hash for every run of words."""
    n = len(words) - run + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(run):
        total = total * _U(_STEP) + words[k : k + n]
    return _mix(total)


def _free_ahead(free: np.ndarray) -> np.ndarray:
    """For each place, how many unmarked places follow from there."""
    n = len(free)
    stops = np.where(free, n, np.arange(n))
    return np.minimum.accumulate(stops[::-1])[::-1] - np.arange(n)


def tiles(item: np.ndarray, doc: np.ndarray, run: int = LEAST_RUN, allowed: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in item, start in doc, length), longest first; of equal ones, the first in the item, then in the document.

    A hash only proposes a match: the words are compared. A round costs time in proportion to the words that are still free, times the logarithm of the
    longest run; there are at most len(item) / run rounds with tiles of different lengths.
    """
    free_a, free_b = np.ones(len(item), bool), np.ones(len(doc), bool) if allowed is None else allowed.copy()
    inverse = pow(_STEP, -1, 1 << 64)
    sums = []
    for x in (item, doc):
        s = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * _power(_STEP, len(x)), out=s[1:])
        sums.append(s)

    def windows(which: int, ahead: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(ahead >= length)
        return at, (sums[which][at + length] - sums[which][at]) * _power(inverse, len(sums[which]))[at]

    found, longest = [], min(len(item), len(doc))
    while longest >= run:
        ahead_a, ahead_b = _free_ahead(free_a), _free_ahead(free_b)
        low, high = run - 1, min(longest, int(ahead_a.max(initial=0)), int(ahead_b.max(initial=0)))
        while low < high:
            middle = (low + high + 1) // 2
            if np.isin(windows(0, ahead_a, middle)[1], windows(1, ahead_b, middle)[1]).any():
                low = middle
            else:
                high = middle - 1
        if low < run:
            break
        longest = low
        at_a, hash_a = windows(0, ahead_a, low)
        at_b, hash_b = windows(1, ahead_b, low)
        order = np.argsort(hash_b, kind="stable")
        hash_b, at_b = hash_b[order], at_b[order]
        for a, h in zip(at_a.tolist(), hash_a, strict=True):
            if not free_a[a : a + low].all():
                continue
            for k in range(int(np.searchsorted(hash_b, h)), len(hash_b)):
                if hash_b[k] != h:
                    break
                b = int(at_b[k])
                if free_b[b : b + low].all() and np.array_equal(item[a : a + low], doc[b : b + low]):
                    found.append((a, b, low))
                    free_a[a : a + low] = free_b[b : b + low] = False
                    break
        if not found or found[-1][2] != low:
            longest = low - 1  # equal hashes of different words
    return found


@dataclass
class Block:
    """Test items with an index of their runs."""

    ids: list[int]
    words: list[np.ndarray]
    seeds: np.ndarray  # sorted
    items: np.ndarray  # of each seed, the place of its item in ids
    places: np.ndarray  # of each seed, its place in the item
    bits: np.ndarray  # whether any seed has these top bits
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # of items of k words, fewer than a seed's: sorted hashes of all k, and places in ids

    @classmethod
    def of(cls, items: list[tuple[int, bytes]], run: int) -> Block:
        words = [words_of(text)[0] for _, text in items]
        seeds = [seeds_of(w, run) for w in words]
        flat = np.concatenate([*seeds, np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        bits = np.zeros(1 << 22, bool)
        bits[(flat >> _U(42)).astype(np.int64)] = True
        of = np.repeat(np.arange(len(items)), [len(s) for s in seeds])
        places = np.concatenate([*(np.arange(len(s)) for s in seeds), np.zeros(0, np.int64)])
        short = {}
        for k in sorted({len(w) for w in words} & set(range(1, run))):
            mine = [i for i, w in enumerate(words) if len(w) == k]
            whole = np.concatenate([seeds_of(words[i], k) for i in mine])
            by_hash = np.argsort(whole, kind="stable")
            short[k] = whole[by_hash], np.array(mine)[by_hash]
        return cls([i for i, _ in items], words, flat[order], of[order], places[order], bits, short)

    def short_hits(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place in words, words, place of the item in ids) wherever all words of a short item stand in a row."""
        for k, (hashes, items) in self.short.items():
            own = seeds_of(words, k)
            for at in np.flatnonzero(np.isin(own, hashes)).tolist():
                for i in items[np.searchsorted(hashes, own[at]) : np.searchsorted(hashes, own[at], "right")].tolist():
                    if np.array_equal(self.words[i], words[at : at + k]):
                        yield at, k, i

    def hits(self, seeds: np.ndarray) -> np.ndarray:
        """Places of those of a document's seeds that some item has too."""
        at = np.flatnonzero(self.bits[(seeds >> _U(42)).astype(np.int64)])
        if not len(at) or not len(self.seeds):
            return at[:0]
        found = np.minimum(np.searchsorted(self.seeds, seeds[at]), len(self.seeds) - 1)
        return at[self.seeds[found] == seeds[at]]

    def compare(self, words: np.ndarray, seeds: np.ndarray, hits: np.ndarray, run: int, coverage: float) -> list[tuple[int, float, list]]:
        """(item id, share of its words in tiles, tiles) for the items that reach the coverage."""
        values = np.unique(seeds[hits])
        low, high = np.searchsorted(self.seeds, values), np.searchsorted(self.seeds, values, "right")
        at = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)])
        out = []
        for item in np.unique(self.items[at]).tolist():
            own = at[self.items[at] == item]
            size = len(self.words[item])
            covered = np.zeros(size + 1, np.int64)
            np.add.at(covered, self.places[own], 1)
            np.add.at(covered, self.places[own] + run, -1)
            if (np.cumsum(covered)[:size] > 0).sum() < coverage * size:
                continue  # tiles are made of seeds, so they cannot cover more
            shared = hits[np.isin(seeds[hits], self.seeds[own])]
            inside = np.zeros(len(words) + 1, np.int64)
            inside[shared] += 1
            np.add.at(inside, shared + run, -1)
            keep = np.flatnonzero(np.cumsum(inside)[: len(words)] > 0)  # common runs lie in seeds: the rest of the document is left out
            gap = np.flatnonzero(np.diff(keep) > 1) + 1
            part = np.insert(words[keep], gap, 0)
            allowed = np.insert(np.ones(len(keep), bool), gap, False)
            place = np.insert(keep, gap, -1)
            found = [(a, int(place[b]), n) for a, b, n in tiles(self.words[item], part, run, allowed)]
            share = sum(n for _, _, n in found) / size
            if share >= coverage:
                out.append((self.ids[item], share, found))
        return out


def blocks_of(benchmark: DataFrame, run: int = LEAST_RUN, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The benchmark's items in blocks, read one partition at a time."""
    held, size = [], 0
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("binary")).toLocalIterator()
    for item_id, text in rows:
        if held and size + len(text) > block_bytes:
            yield Block.of(held, run)
            held, size = [], 0
        held.append((item_id, bytes(text)))
        size += len(text)
    if held:
        yield Block.of(held, run)


def _batch_findings(texts: list[bytes | None], block: Block, run: int, coverage: float) -> list[list[tuple[int, float, list]]]:
    flat = b"\n".join(t or b"" for t in texts)
    starts = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    words, firsts = words_of(flat)
    edges = np.searchsorted(firsts, starts)
    seeds = seeds_of(words, run)
    hits = block.hits(seeds)
    out: list[list] = [[] for _ in texts]
    owner = np.searchsorted(edges, hits, "right") - 1
    inside = hits + run <= edges[owner + 1]  # a run of one document only
    hits, owner = hits[inside], owner[inside]
    for i in np.unique(owner).tolist():
        a, b = int(edges[i]), int(edges[i + 1])
        out[i] = block.compare(words[a:b], seeds[a : b - run + 1], hits[owner == i] - a, run, coverage)
    for at, k, item in block.short_hits(words):
        i = int(np.searchsorted(edges, at, "right")) - 1
        if at + k <= edges[i + 1] and all(f[0] != block.ids[item] for f in out[i]):
            out[i].append((block.ids[item], 1.0, [(0, at - int(edges[i]), k)]))
    return out


def _passes(docs: DataFrame, benchmark: DataFrame, run: int, coverage: float, block_bytes: int):
    ready(docs.sparkSession)
    for block in blocks_of(benchmark, run, block_bytes):
        yield docs.sparkSession.sparkContext.broadcast(block)


def suspects(docs: DataFrame, benchmark: DataFrame, run: int, block_bytes: int) -> DataFrame | None:
    """Where the benchmark fills several blocks: (doc_id, text), distinct, of those documents that share a run with any item.

    None where one block holds it. The index is one bit for each hash slot, of a fixed size whatever
    the benchmark's; a slot that two runs share makes a suspect more, never one less. Only suspects go
    through the blocks one by one, so a large benchmark doesn't cost a pass over all documents each.
    """
    sized = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if sized <= block_bytes:
        return None

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 0, 1 << 20):
            kinds, found = [], []
            for text in batch.column(0).to_pylist():
                words = words_of(bytes(text or b""))[0]
                k = min(run, len(words))
                if k:
                    own = np.unique(seeds_of(words, k) >> _U(64 - _SLOT_BITS)).astype(np.int64)
                    kinds.append(np.full(len(own), k))
                    found.append(own)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kinds), pa.int32()), pa.array(np.concatenate(found))], ["k", "slot"])

    packed = benchmark.select(F.col("text").cast("binary")).mapInArrow(slots, "k int, slot long").groupBy("k", F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    index: dict[int, np.ndarray] = {}
    for part in packed.toLocalIterator():  # at most 2 ** (_SLOT_BITS - 6) numbers for each of `run` kinds
        index.setdefault(part["k"], np.zeros(1 << (_SLOT_BITS - 6), np.int64))[part["at"]] = part["bits"]
    shared = docs.sparkSession.sparkContext.broadcast({k: v.view(np.uint64) for k, v in index.items()})

    def likely(texts: list[bytes | None]) -> np.ndarray:
        flat = b"\n".join(t or b"" for t in texts)
        starts = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
        words, firsts = words_of(flat)
        edges = np.searchsorted(firsts, starts)
        out = np.zeros(len(texts), bool)
        for k, bits in shared.value.items():
            slot = seeds_of(words, k) >> _U(64 - _SLOT_BITS)
            at = np.flatnonzero(bits[(slot >> _U(6)).astype(np.int64)] >> (slot & _U(63)) & _U(1))
            owner = np.searchsorted(edges, at, "right") - 1
            out[owner[at + k <= edges[owner + 1]]] = True
        return out

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return save(filter_rows(texts, likely).withColumn("text_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text"), "suspects")


FOUND = "array<struct<item_id:long,coverage:double,tiles:array<struct<item_word:int,doc_word:int,words:int>>>>"
_SLOT_BITS = 27


def _search(texts: DataFrame, benchmark: DataFrame, run: int, coverage: float, block_bytes: int) -> DataFrame:
    """(doc_id, text, found) of every row of texts(doc_id, text as binary), a pass for each block."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.list_(pa.struct([("item_word", pa.int32()), ("doc_word", pa.int32()), ("words", pa.int32())])))]))
    plan, first = texts.withColumn("found", F.expr(f"cast(array() as {FOUND})")), True
    for shared in _passes(texts, benchmark, run, coverage, block_bytes):

        def go(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches, limit=1 << 20):
                new = _batch_findings(batch.column(1).to_pylist(), shared.value, run, coverage)
                old = batch.column(2).to_pylist()
                both = [o + [{"item_id": i, "coverage": c, "tiles": [{"item_word": a, "doc_word": b, "words": n} for a, b, n in t]} for i, c, t in f] for o, f in zip(old, new, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, kind)], ["doc_id", "text", "found"])

        if not first:
            plan = save(plan, "searched")  # one Python worker at a time, with one block
        plan, first = plan.mapInArrow(go, f"doc_id long, text binary, found {FOUND}"), False
    return plan


def contamination(docs: DataFrame, benchmark: DataFrame, run: int = LEAST_RUN, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, found) of every row: the items whose words the document's tiles cover to at least `coverage`.

    found is an array of (item_id, coverage, tiles), empty for clean, null and empty texts. An item of
    fewer than `run` words is found where all its words stand in a row; an item without words, null
    items and null item ids match nothing; an empty benchmark finds nothing. Repeated items are found
    by each of their ids. Of equal tiles the first in the item, then in the document, is taken. Rows
    with a null doc_id are searched; repeated rows give repeated rows, an empty table none.
    """
    texts = docs.select(quoted("doc_id").cast("long").alias("doc_id"), quoted("text").cast("binary").alias("text"))
    few = suspects(docs, benchmark, run, block_bytes)
    if few is None:
        return _search(texts, benchmark, run, coverage, block_bytes).select("doc_id", "found")
    hits = _search(few, benchmark, run, coverage, block_bytes).where("size(found) > 0").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), "found")
    hashed = texts.select("doc_id", F.xxhash64("text").alias("text_hash"))
    joined = hashed.join(save(hits, "hits"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("h")), "left")
    return joined.select("doc_id", F.coalesce("found", F.expr(f"cast(array() as {FOUND})")).alias("found"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, run: int = LEAST_RUN, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, in which no test item is found, by the rules of `contamination`."""
    few = suspects(docs, benchmark, run, block_bytes)
    if few is not None:
        h, g = spare(docs, "h"), spare(docs, "g")
        gone = _search(few, benchmark, run, coverage, block_bytes).where("size(found) > 0").select(F.xxhash64("text").alias(h), F.xxhash64("text", F.lit(1)).alias(g)).distinct()
        text = quoted("text").cast("binary")
        return docs.join(save(gone, "gone"), (F.xxhash64(text) == F.col(h)) & (F.xxhash64(text, F.lit(1)) == F.col(g)), "left_anti")
    blocks = list(_passes(docs, benchmark, run, coverage, block_bytes))  # one, or none
    if not blocks:
        return docs
    return filter_rows(docs, lambda texts: np.array([not f for f in _batch_findings(texts, blocks[0].value, run, coverage)], bool))

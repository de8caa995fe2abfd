"""Repeated byte strings by a sorted array of suffixes.

A byte goes where it is covered by a string of `length` bytes that starts anywhere else too. To learn
which starts repeat, suffixes are sorted and each is compared with its neighbours. A suffix for every
byte would move many times the input, so starts are sorted in groups, and a group is taken apart only
where it cannot be decided as a whole:

* Each start belongs to an anchor, the least hash of eight bytes in the first `reach` places of its
  string. Equal strings have their anchor at the same distance from the start. At first the suffix at
  an anchor stands for all its starts: those that lie up to `reach` bytes before it.
* The starts of a group have some bytes in common (its core) and reach over some more (its extent). Equal
  extents: all their starts repeat. A core that nothing else has: none does. What is left, the suffixes
  whose cores agree and whose extents differ, comes again as narrower groups, at last as single starts,
  whose core and extent are the string itself.

At each of the three levels sampled splitters range-partition the suffixes by their leading tokens (eight
bytes of the core, then digests of core and extent, and last the text they stand in, so that copies of a
single suffix can be split as well). A bucket is sorted by multikey quicksort in one task, and its ends
are compared with those of the buckets beside it. Extents are compared by 192 bits: the first eight bytes
and the digests of core and extent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_binary, partitions_for, save, small_batches, text_rows

#: Bytes that an anchor is chosen by.
GRAM = 8
#: The tokens that suffixes are sorted by; the first two are the core's, and all together the extent's.
TOKENS = ("lead", "core", "extent_a", "extent_b")
#: Suffixes of one bucket, on the average.
BUCKET_ROWS = 200_000
#: Below so many suffixes a part is sorted by columns at once.
SMALL = 2_048

_ROW = "lead long, core long, extent_a long, extent_b long, doc_id long, text_hash long, anchor int, first int, last int, low int, high int, known boolean"
_COLUMNS = [c.split()[0] for c in _ROW.split(", ")]
_PLACE = _COLUMNS[4:]


def reach_of(length: int) -> int:
    """A power of two, about half the length: how far before its anchor a start may lie."""
    return 1 << int(math.log2(0.7 * (length - GRAM + 1)))


def multikey_quicksort(tokens: list[np.ndarray]) -> np.ndarray:
    """The order of rows by tokens[0], then tokens[1], and so on; rows that agree in one token are parted by the next."""
    order = np.arange(len(tokens[0]))
    parts = [(0, len(order), 0)]
    while parts:
        start, stop, depth = parts.pop()
        if depth == len(tokens) or stop - start < 2:
            continue
        rows = order[start:stop]
        if len(rows) <= SMALL:
            order[start:stop] = rows[np.lexsort([t[rows] for t in reversed(tokens[depth:])])]
            continue
        token = tokens[depth][rows]
        pivot = np.partition(token[:: len(token) // 64], 32)[32]
        less, more = token < pivot, token > pivot
        a, b = start + int(less.sum()), stop - int(more.sum())
        order[start:stop] = np.concatenate([rows[less], rows[~(less | more)], rows[more]])
        parts += [(start, a, depth), (a, b, depth + 1), (b, stop, depth)]
    return order


def anchors(data: np.ndarray, reach: int) -> np.ndarray:
    """For each place from which `reach` grams start: the place of the one with the least hash, the leftmost of equals."""
    n = len(data) - GRAM + 1
    grams = np.empty(n, np.uint64)
    raw = data.tobytes()
    for i in range(min(GRAM, n)):
        grams[i::GRAM] = np.frombuffer(raw, "<u8", (len(raw) - i) // GRAM, i)[: len(grams[i::GRAM])]
    grams *= np.uint64(0x9E3779B97F4A7C15)
    grams ^= grams >> np.uint64(32)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    least = grams & np.uint64(0xFFFFFFFF00000000) | np.arange(n, dtype=np.uint64)
    width = 1
    while width < reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _tokens(data: bytes, anchor: int, first: int, last: int, length: int) -> tuple[int, int, int, int]:
    """The tokens of the suffixes that start `first` to `last` bytes before the anchor; what an extent lacks at the ends of a text counts as well."""
    core = data[anchor - first : anchor - last + length]
    lacks = max(0, last - anchor), max(0, anchor - first + length - len(data))
    extent = xxhash.xxh3_128_digest(data[max(0, anchor - last) : anchor - first + length], seed=lacks[0] << 32 | lacks[1])
    signed = int.from_bytes
    lead = int.from_bytes(core[:8].ljust(8, b"\0"), "big") - (1 << 63)
    return lead, signed(xxhash.xxh3_64_digest(core), "big", signed=True), signed(extent[:8], "big", signed=True), signed(extent[8:], "big", signed=True)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.int32()] * 5 + [pa.bool_()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _COLUMNS)


def _anchored(texts: list[bytes], reach: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(text, anchor, low, high): the starts from low to high belong to the anchor."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    if len(flat) < length:
        return
    ends = np.cumsum(sizes)
    first = ends - sizes
    text = np.repeat(np.arange(len(texts)), np.maximum(0, sizes - length + 1))
    if not len(text):
        return
    starts = np.arange(len(text)) - np.repeat(np.cumsum(np.maximum(0, sizes - length + 1)) - np.maximum(0, sizes - length + 1), np.maximum(0, sizes - length + 1)) + first[text]
    anchor = anchors(flat, reach)[starts]
    cut = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    stop = np.concatenate([cut[1:], [len(text)]]) - 1
    base = first[text[cut]]
    yield from zip(text[cut].tolist(), (anchor[cut] - base).tolist(), (starts[cut] - base).tolist(), (starts[stop] - base).tolist(), strict=True)


def _widest(docs: DataFrame, reach: int, length: int) -> DataFrame:
    """The first level: a row for each anchor; of those that a batch has twice, one is sorted, and the others are only noted as known, without tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, limit=1 << 20):
            texts = [t or b"" for t in text_rows(batch)]
            ids, hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            places = list(_anchored(texts, reach, length))
            tokens = [_tokens(texts[t], a, 0, reach - 1, length) for t, a, _, _ in places]
            seen: dict[tuple, int] = {}
            twice = set()
            for i, key in enumerate(tokens):
                if seen.setdefault(key, i) != i:
                    twice.add(key)
            rows: list[tuple] = []
            for i, (key, (t, anchor, low, high)) in enumerate(zip(tokens, places, strict=True)):
                again = seen[key] != i
                if again and rows and rows[-1][0] is None and rows[-1][4:6] == (ids[t], hashes[t]) and rows[-1][10] + 1 == low and places[i - 1][0] == t:
                    rows[-1] = (*rows[-1][:10], high, True)
                else:
                    rows.append((*((None,) * 4 if again else key), ids[t], hashes[t], anchor, 0, reach - 1, low, high, key in twice))
            yield _batch(rows)

    return docs.mapInArrow(run, _ROW)


_WINDOW = "doc_id long, text_hash long, anchor int, at int, low int, high int, known boolean, window binary"


def _windows(docs: DataFrame, open_ones: DataFrame, reach: int, length: int) -> DataFrame:
    """The bytes around each anchor that the next levels look at: one shuffle of the texts that have any."""
    asked = open_ones.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("anchor", "low", "high", "known")).alias("asked"))
    asked = asked.withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    both = docs.join(asked, docs["doc_id"].eqNullSafe(F.col("d")) & (docs["text_hash"] == F.col("h"))).select("doc_id", "text", "text_hash", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, limit=1 << 18):
            rows = []
            for doc_id, text, text_hash, places in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for p in places:
                    start = max(0, p["anchor"] - reach + 1)
                    rows.append((doc_id, text_hash, p["anchor"], p["anchor"] - start, p["low"], p["high"], p["known"], text[start : p["anchor"] + length]))
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.bool_(), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in _WINDOW.split(", ")])

    return both.mapInArrow(run, _WINDOW)


def _narrower(windows: DataFrame, width: int, length: int) -> DataFrame:
    """Rows for the starts low to high of each window, in groups of those `width` distances from the anchor that belong together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "window", 1 << 18):
            rows = []
            for doc_id, text_hash, anchor, at, low, high, known, data in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                near, far = anchor - high, anchor - low
                for first in range(near // width * width, far + 1, width):
                    last = first + width - 1
                    tokens = _tokens(data, at, first, last, length)
                    rows.append((*tokens, doc_id, text_hash, anchor, first, last, anchor - min(last, far), anchor - max(first, near), known))
            yield _batch(rows)

    return windows.mapInArrow(run, _ROW)


_PLACED = "known boolean, open boolean, edge int, bucket int, " + _ROW.replace(", known boolean", "")


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sort one bucket and compare neighbours. edge: 1 for its first suffix, 2 for its last, 3 for a lone one."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    tokens = [table.column(c).to_numpy() for c in TOKENS]
    order = multikey_quicksort(tokens)
    core, extent = _agree([t[order] for t in tokens])
    known = table.column("known").to_numpy()[order]
    known |= np.concatenate([[False], extent]) | np.concatenate([extent, [False]])
    differ = core & ~extent
    left = np.concatenate([[False], differ]) | np.concatenate([differ, [False]])
    edge = np.zeros(len(order), np.int32)
    edge[0] += 1
    edge[-1] += 2
    keep = np.flatnonzero(known | left | (edge > 0))
    flags = [pa.array(known[keep]), pa.array(left[keep]), pa.array(edge[keep]), pa.array(np.full(len(keep), TaskContext.get().partitionId(), np.int32))]
    table = table.drop_columns(["known"]).take(pa.array(order[keep])).combine_chunks()
    yield from pa.table([*flags, *table.columns], names=[c.split()[0] for c in _PLACED.split(", ")]).to_batches(max_chunksize=20_000)


def _agree(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each but the last agrees with the next: in the core, in the extent as well."""
    same = [t[1:] == t[:-1] for t in tokens]
    core = same[0] & same[1]
    return core, core & same[2] & same[3]


def _compared(rows: DataFrame) -> DataFrame:
    """Of sorted rows: those known to repeat, and those that are open, for they agree with a neighbour in the core and differ in the extent."""
    spark = rows.sparkSession
    buckets = max(partitions_for(rows), math.ceil(rows.count() / BUCKET_ROWS))
    dealt = rows.repartitionByRange(buckets, *TOKENS, "text_hash", "doc_id", "anchor")
    placed = save(dealt.mapInArrow(_bucket, _PLACED), "placed")
    ends: dict[int, list] = {}
    for row in placed.where("edge > 0").toLocalIterator():  # two suffixes of each bucket, as its splitters came from a few
        ends.setdefault(row["bucket"], []).append(row.asDict())
    pairs = []
    for both in ends.values():
        both.sort(key=lambda r: r["edge"])
        pairs.append([tuple(r[c] for c in TOKENS) for r in (both[0], both[-1])] + [both])
    pairs.sort(key=lambda x: x[:2])
    for (_, key, mine), (other, _, theirs) in zip(pairs, pairs[1:], strict=False):
        for row in (mine[-1], theirs[0]):
            row["known"] |= key == other
            row["open"] |= key[:2] == other[:2] and key != other
    mended = spark.createDataFrame([tuple(r[c] for c in placed.columns) for *_, both in pairs for r in both], placed.schema)
    wanted = [*_PLACE[:-1], "known", "open"]
    return placed.where("edge = 0").select(wanted).unionByName(mended.select(wanted))


def repeated_starts(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, text_hash, low, high) of docs(doc_id, text, text_hash): at each place from low to high starts a string of `length` bytes that starts elsewhere too."""
    reach = reach_of(length)
    narrow = max(1, reach // 16)
    span = ["doc_id", "text_hash", "low", "high"]
    rows = save(_widest(docs, reach, length), "suffixes")
    found = rows.where("core IS NULL").select(span)
    rows = rows.where("core IS NOT NULL")
    windows = None
    for width in (reach, narrow, 1) if narrow > 1 else (reach, 1):
        compared = save(_compared(rows), "compared")
        found = found.unionByName(compared.where("known").select(span))
        open_ones = compared.where("open")
        if width == 1 or open_ones.isEmpty():
            break
        if windows is None:
            windows = save(_windows(docs, open_ones, reach, length), "windows")
            rows = save(_narrower(windows, narrow, length), "suffixes")
        else:
            keys = open_ones.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("anchor").alias("a"), F.col("low").alias("l"), F.col("high").alias("u"), F.col("known").alias("k")).distinct()
            once = windows.dropDuplicates(["doc_id", "text_hash", "anchor"])
            same = once["doc_id"].eqNullSafe(F.col("d")) & (once["text_hash"] == F.col("h")) & (once["anchor"] == F.col("a"))
            part = once.join(keys, same).select("doc_id", "text_hash", "anchor", "at", F.col("l").alias("low"), F.col("u").alias("high"), F.col("k").alias("known"), "window")
            rows = save(_narrower(part, 1, length), "suffixes")
    return found


_KEPT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,length:long>>, kept binary"


def merged(spans: list[dict], length: int) -> list[tuple[int, int]]:
    """(start, stop) of the maximal runs of bytes that strings starting from low to high cover."""
    out: list[tuple[int, int]] = []
    for low, high in sorted((s["low"], s["high"]) for s in spans):
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], high + length)
        else:
            out.append((low, high + length))
    return out


def drop_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) of every row of docs(doc_id, text), the text as UTF-8 bytes.

    spans(start, length) are the maximal runs of removed bytes, `kept` is what is left; it may begin or
    end inside a character. Strings are judged on the input, overlaps and the text's own repeats count,
    and none crosses a document. Null and empty texts are no bytes; a row that stands twice loses all
    bytes of its strings, in both; rows with a null doc_id are texts like any other.
    """
    rows = as_binary(docs).withColumn("text_hash", F.xxhash64("text"))
    spans = repeated_starts(rows, length).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    spans = spans.withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    both = rows.join(spans, rows["doc_id"].eqNullSafe(F.col("d")) & (rows["text_hash"] == F.col("h")), "left").select("doc_id", "text", "spans")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, limit=1 << 20):
            out: list[list] = [[], [], [], []]
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text, gone = text or b"", merged(spans or [], length)
                edges = [0, *(x for span in gone for x in span), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                for column, value in zip(out, (len(text), len(text) - len(kept), [{"start": a, "length": b - a} for a, b in gone], kept), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), kind, pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], [c.split()[0] for c in _KEPT.split(", ")][:3] + ["spans", "kept"])

    return both.mapInArrow(run, _KEPT)

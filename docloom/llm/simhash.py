"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2 bits both lie within 1 bit of some middle word, so every
distinct fingerprint emits the 65 words within 1 bit of itself and equal words meet in one shuffle.
A word's bucket holds at most 65 fingerprints (itself and its 64 neighbours), whatever the data, and
copies are one row before anything is emitted: no bucket needs a cap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, Scratch, as_binary, quoted, save, small_batches, spare, text_rows
from .components import connected_components

SEED = 42
BITS = 64
_ROWS = 1 << 16


def shingle_hashes(text: bytes | None, width: int) -> bytes:
    """The XXH64 values (seed 42, 8 bytes each) of a text's word shingles, repeats included; none for a text without words.

    A text of fewer than `width` words is one shingle.
    """
    words = (text or b"").translate(ASCII_LOWER).split()
    if not words:
        return b""
    flat, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= width:
        return digest(flat, SEED)
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts = [0, *(gaps[: len(words) - width] + 1).tolist()]
    ends = [*gaps[width - 1 :].tolist(), len(flat)]
    return b"".join([digest(flat[a:b], SEED) for a, b in zip(starts, ends, strict=True)])


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The signed 64-bit SimHash of a text's word shingles; 0 for a text without words (or null).

    A bit is set if more than half of the shingles' XXH64 values (seed 42) have it. Repeated shingles
    count as often as they occur; a text of fewer than `width` words is one shingle.
    """
    return majority(shingle_hashes(text, width))


def majority(hashes: bytes) -> int:
    """The signed 64-bit fingerprint of what `shingle_hashes` gives; 0 of none."""
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(rows), _ROWS):
        ones += np.unpackbits(rows[at : at + _ROWS], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp, text_hash) of every document; fp is a signed 64-bit integer, text_hash tells rows of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fps = np.fromiter((fingerprint(t, width) for t in text_rows(batch)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), batch.column(2)], ["doc_id", "fp", "text_hash"])

    return as_binary(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, fp long, text_hash long")


def _variants(distinct: DataFrame) -> DataFrame:
    fp = F.col("fp")
    masks = [0, *((1 << i) - (1 << 64 if i == 63 else 0) for i in range(BITS))]
    return distinct.select("fp", F.explode(F.array(*(fp.bitwiseXOR(F.lit(m).cast("long")) for m in masks))).alias("word"))


def ball_links(distinct: DataFrame) -> DataFrame:
    """(src, dst): links of the distinct fingerprints fp that connect all those at 2 or fewer bits.

    All members of a bucket are within 2 bits of each other, so linking each to the bucket's least
    member loses no connection; the distance is verified all the same.
    """
    from pyspark.sql import Window

    met = _variants(distinct).withColumn("least", F.min("fp").over(Window.partitionBy("word")))
    near = (F.col("fp") != F.col("least")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= 2)
    return met.where(near).select(F.col("least").alias("src"), F.col("fp").alias("dst")).distinct()


def ball_pairs(distinct: DataFrame) -> DataFrame:
    """(src, dst, bits): every pair of distinct fingerprints at 1 or 2 bits, once. At most 64 + 2016 for a fingerprint."""
    words = _variants(distinct)
    other = words.select("word", F.col("fp").alias("dst"))
    bits = F.bit_count(F.col("fp").bitwiseXOR(F.col("dst")))
    return words.join(other, "word").where(F.col("fp") < F.col("dst")).select(F.col("fp").alias("src"), "dst", bits.alias("bits")).where("bits <= 2").distinct()


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id, text_hash) of every row of docs(doc_id, text).

    component_id is the least doc_id reachable over links of 2 or fewer bits, the document itself
    included. Null and empty texts have fingerprint 0 and are linked like any other; repeated rows
    stay; a row with a null doc_id is fingerprinted, names no component, and gets that of its group
    (null if the group has no other). An empty table gives no rows.
    """
    with Scratch() as mine:
        fps = save(fingerprints(docs, width), "fps")
        distinct = save(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
        named = named_groups(distinct, connected_components(ball_links(distinct)))
        mine.keep(fps, named)
    return fps.join(named, "fp").select("doc_id", "fp", "component_id", "text_hash")


def named_groups(distinct: DataFrame, components: DataFrame) -> DataFrame:
    """(fp, component_id): for distinct(fp, first_id), the least first_id of the fp's component(node, component)."""
    nodes = components.withColumnRenamed("node", "fp")
    rooted = save(distinct.join(nodes, "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    salt = F.pmod(F.xxhash64("root"), F.lit(65_521))
    return save(rooted.withColumn("k", salt).join(named.withColumn("k", salt), ["root", "k"]).select("fp", "component_id"), "by_fp")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one(docs: DataFrame, width: int = 3) -> DataFrame:
    """The rows of docs whose doc_id is the least of its group: one document of each group stays.

    Rows that repeat both a doc_id and its text are one document, and stay or go together. Rows with
    a null doc_id are kept: nothing says which of them to drop. Only the ids that go are joined, so
    texts are not shuffled while these are few.
    """
    return keep_least(docs, near_duplicates(docs, width))


def keep_least(docs: DataFrame, near: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is their group's component_id in near(doc_id, component_id, text_hash), or null."""
    i, h = spare(docs, "i"), spare(docs, "h")
    gone = near.where("doc_id > component_id").select(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).distinct()
    return docs.join(gone, (quoted("doc_id") == F.col(i)) & (F.xxhash64(quoted("text").cast("binary")) == F.col(h)), "left_anti")

"""Near-duplicates by SimHash and an exact set-similarity join: Jaccard 0.8 or more of the sets of 5-word shingles.

First the balls of `simhash` (fingerprints of the same shingles, 2 or fewer bits apart) bring sets
together, and exact verification follows: short texts and much repeated shingles can be that near and
differ. What they link is one component from there on, and its members are not compared again. Similar
sets may be 3 to 11 bits apart, so a join by prefixes then finds what the balls cannot reach.

All sets are put in one order of shingles, rare ones first. If two sets of m and n shingles have a
Jaccard similarity of p / q, they share at least p (m + n) / (p + q); so the first shingle that they
share has that many shingles left from it on in both. Every distinct set thus emits the shingles that
have p / q of it left (a fifth of them), equal shingles meet in one shuffle, and pairs that fail the
count of what is left are no candidates. The order changes the work and never the result: shingles
count as frequent by a fixed share of the rows, so that those which come first are as rare in a large
table as in a small one. Candidates are verified by counting what their whole sets share, but for those
whose bitmaps already tell that they differ too much: a bit that one set has and the other lacks stands
for one shingle at least that is not shared.

A large group of near copies is not paired with itself: members meet the first few of their bucket,
then only members of other components found so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, as_binary, give_back, save, small_batches, text_rows
from .components import connected_components
from .simhash import SEED, ball_links, keep_least, majority, named_groups, shingle_hashes

#: Rows are sampled to find frequent shingles: one in so many, whatever the size of the table.
SAMPLE_EACH = 8
#: A shingle that so many sampled rows have is frequent.
LEAST_SEEN = 4
#: The most frequent of them are listed, about so many (9 bytes each): the list goes to every worker.
LISTED = 2_000_000
#: Bits in the map of a set: at least so many, and from there on a power of two of at least so many a shingle, that long texts' maps do not fill up.
MAP_BITS, BITS_EACH = 2_048, 4
#: In turn, members of a bucket meet those of its members that are up to here; at last, all others.
LEADERS = (1, 8, 64)
#: Up to so many names of wanted texts (16 bytes each) are broadcast; more are joined.
BROADCAST_ROWS = 100_000


def shingle_set(text: bytes | None, width: int = 5) -> np.ndarray:
    """The distinct shingles of a text as sorted signed hashes; all texts without words have one and the same shingle."""
    return _distinct(shingle_hashes(text, width))


def _distinct(hashes: bytes) -> np.ndarray:
    return np.unique(np.frombuffer(hashes or xxhash.xxh64_digest(b"", SEED), ">i8").astype(np.int64))


def _bitmap(shingles: np.ndarray) -> np.ndarray:
    size = max(MAP_BITS, 1 << (BITS_EACH * len(shingles) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(shingles >> 32) & (size - 1)] = 1
    return np.packbits(bits).view("<i8")


def _node(shingles: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh64_digest(shingles.tobytes(), SEED), "big", signed=True)


def frequent_shingles(docs: DataFrame, width: int = 5, most: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, levels): the frequent shingles of docs(doc_id, text), sorted, each with the logarithm of how often sampled rows have it.

    One row in SAMPLE_EACH is sampled by a hash of its id and text, so copies of a text are drawn one by
    one. The counts are added up on executors; the driver gets a histogram, and then `most` shingles at
    most (LISTED by default), by raising the least count.
    """
    most = most or LISTED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, limit=1 << 20):
            for text in text_rows(batch):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, width))], ["s"])

    sample = as_binary(docs).where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE_EACH)) == 0).mapInArrow(run, "s long")
    counted = sample.groupBy("s").count().where(F.col("count") >= LEAST_SEEN).select("s", F.floor(F.log2("count")).cast("int").alias("level"))
    counted = save(counted, "frequent")
    least, listed = 64, 0
    for row in counted.groupBy("level").count().orderBy(F.desc("level")).collect():  # a row for each power of two
        if listed + row["count"] > most:
            break
        least, listed = row["level"], listed + row["count"]
    found = counted.where(F.col("level") >= least).toArrow()
    keys, levels = found["s"].to_numpy(), found["level"].to_numpy().astype(np.uint8)
    by = np.argsort(keys)
    return keys[by], levels[by]


def _firsts(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], width: int, least: Fraction) -> DataFrame:
    """(doc_id, text_hash, fp, n, firsts, bits, simhash): the hash of each row's set, its size, the shingles that it emits, in order, its bitmap, and the row's SimHash."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def first(shingles: np.ndarray) -> np.ndarray:
        keys, levels = shared.value
        order = shingles.view(np.uint64) >> np.uint64(6)
        if len(keys):
            place = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
            order = order | np.where(keys[place] == shingles, levels[place], 0).astype(np.uint64) << np.uint64(58)
        n = len(shingles)
        return shingles[np.argsort(order, kind="stable")[: n + (-least.numerator * n) // least.denominator + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, limit=1 << 20):
            hashes = [shingle_hashes(t, width) for t in text_rows(batch)]
            sets = [_distinct(h) for h in hashes]
            columns = [batch.column(0), batch.column(2), pa.array([_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([first(s) for s in sets], pa.list_(pa.int64())), pa.array([_bitmap(s) for s in sets], pa.list_(pa.int64()))]
            columns.append(pa.array([majority(h) for h in hashes], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "fp", "n", "firsts", "bits", "simhash"])

    return as_binary(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, fp long, n long, firsts array<long>, bits array<long>, simhash long")


def _sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(fp, shingles) of the wanted(fp), made anew from one text of each; texts are shuffled only where many are wanted."""
    one = save(rows.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("doc_id", "text_hash")).alias("one")).select("one.*"), "one")
    few = one.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = as_binary(docs).withColumn("text_hash", F.xxhash64("text"))
    same = texts["doc_id"].eqNullSafe(one["doc_id"]) & (texts["text_hash"] == one["text_hash"])
    texts = texts.join(F.broadcast(one) if few else one, same, "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, limit=1 << 20):
            sets = [shingle_set(t, width) for t in text_rows(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["fp", "shingles"])

    return texts.mapInArrow(run, "fp long, shingles array<long>").dropDuplicates(["fp"])


def _ball_candidates(rows: DataFrame) -> DataFrame:
    """(src, dst) of sets in rows(fp, simhash): those of one fingerprint with its least set, and the least sets of fingerprints that the balls link."""
    prints = save(rows.select("simhash", "fp").distinct(), "prints")
    least = save(prints.groupBy("simhash").agg(F.min("fp").alias("least")), "least")
    one = prints.withColumn("k", _salt("simhash")).join(least.withColumn("k", _salt("simhash")), ["simhash", "k"]).select(F.col("least").alias("a"), F.col("fp").alias("b"))
    linked = ball_links(least.select(F.col("simhash").alias("fp")))
    for end, name in (("src", "a"), ("dst", "b")):
        linked = linked.join(least.select(F.col("simhash").alias(end), F.col("least").alias(name)), end)
    pairs = one.unionByName(linked.select("a", "b")).where("a != b")
    return pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def _candidates(met: DataFrame, low: int, high: int | None, least: Fraction) -> DataFrame:
    """(src, dst) of members of one bucket that may be similar and are in two components; the earlier is at place low + 1 to high."""
    one = met.select("s", *(F.col(c).alias(f"{c}_1") for c in ("fp", "n", "left", "place", "component")), *(["largest"] if high is None else []))
    # Of two in different components one at least is outside the bucket's largest: only those are paired with all.
    one = one.where("component_1 != largest").drop("largest") if high is None else one.where(F.col("place_1") <= high)
    near = (F.col("component") != F.col("component_1")) & ((F.col("place") > F.col("place_1")) if high is not None else (F.col("place") > low))
    share = F.lit(least.numerator) * (F.col("n") + F.col("n_1"))
    enough = F.least("left", "left_1") * F.lit(least.numerator + least.denominator) >= share
    two = met.select("s", "fp", "n", "left", "place", "component")
    pairs = one.where(F.col("place_1") > low).join(two.hint("merge"), "s").where(near & enough)
    return pairs.select(F.least("fp", "fp_1").alias("src"), F.greatest("fp", "fp_1").alias("dst")).distinct()


def _salt(c: str):
    """A second key, a function of the first: with it Spark can split the partition of a set with many pairs."""
    return F.pmod(F.xxhash64(c), F.lit(65_521))


def _both(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(src, dst), a written table, with the other columns of sets(fp, ...), suffixed _1 for src and _2 for dst.

    Few pairs are broadcast to the sets of their src, and only the sets of their dst are shuffled, with the pairs'.
    Of more, the join that looks up the sets which a pair names has the partitioning of the one that follows, and
    costs no shuffle of its own.
    """
    named = [sets.select(F.col("fp").alias(end), *(F.col(c).alias(c + mark) for c in sets.columns if c != "fp")) for end, mark in (("src", "_1"), ("dst", "_2"))]
    if pairs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        one = named[0].join(F.broadcast(pairs), "src").withColumn("k", _salt("dst"))
        two = named[1].join(F.broadcast(pairs.select("dst")), "dst", "left_semi").withColumn("k", _salt("dst"))
        return one.join(two, ["dst", "k"]).drop("k")
    joined = pairs
    for end, own in zip(("src", "dst"), named, strict=True):
        names = pairs.select(end).distinct().withColumn("k", _salt(end))
        joined = joined.withColumn("k", _salt(end)).join(own.withColumn("k", _salt(end)).join(names, [end, "k"], "left_semi"), [end, "k"]).drop("k")
    return joined


def _possible(pairs: DataFrame, maps: DataFrame, least: Fraction) -> DataFrame:
    """The pairs(src, dst) whose bitmaps in maps(fp, n, bits) leave room for enough shared shingles; no similar pair is lost.

    A map of twice the other's size is folded: a bit's place is a hash modulo the size. Pairs of maps that differ more stay.
    """

    def folded(a: str, b: str):
        half = F.floor(F.size(a) / 2).cast("int")
        halves = F.zip_with(F.slice(a, F.lit(1), half), F.slice(a, half + 1, half), lambda x, y: x.bitwiseOR(y))
        return F.when(F.size(a) > F.size(b), halves).otherwise(F.col(a))

    def own(a: str, b: str):
        bits = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))))
        return F.aggregate(bits, F.lit(0), lambda total, c: total + c)

    both = _both(pairs, maps).withColumn("f_1", folded("bits_1", "bits_2")).withColumn("f_2", folded("bits_2", "bits_1"))
    most = F.least(F.col("n_1") - own("f_1", "f_2"), F.col("n_2") - own("f_2", "f_1"))
    enough = most * F.lit(least.numerator + least.denominator) >= F.lit(least.numerator) * (F.col("n_1") + F.col("n_2"))
    return both.where(enough | (F.size("f_1") != F.size("f_2"))).select("src", "dst")


def _verified(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """The pairs(src, dst) whose sets are similar."""
    same = F.size(F.array_intersect("shingles_1", "shingles_2")) * F.lit(least.numerator + least.denominator)
    return _both(pairs, sets).where(same >= F.lit(least.numerator) * (F.size("shingles_1") + F.size("shingles_2"))).select("src", "dst")


def similar_components(docs: DataFrame, rows: DataFrame, width: int, least: Fraction) -> DataFrame:
    """(node, component) of the sets in rows(fp, n, firsts, bits, simhash) that are similar to another."""
    spark = docs.sparkSession
    emitted = rows.select("fp", "n", "firsts").dropDuplicates(["fp"]).select("fp", "n", F.posexplode("firsts").alias("at", "s")).select("s", "fp", "n", (F.col("n") - F.col("at")).alias("left"))
    bucket = Window.partitionBy("s")
    several = emitted.withColumn("a", F.min("fp").over(bucket)).withColumn("b", F.max("fp").over(bucket)).where("a < b").drop("a", "b")
    met = save(several.withColumn("place", F.row_number().over(bucket.orderBy(F.xxhash64("fp"), "fp"))), "met")
    maps = save(rows.select("fp", "n", "bits").join(met.select("fp").distinct(), "fp", "left_semi").dropDuplicates(["fp"]), "maps")
    sets = spark.createDataFrame([], "fp long, shingles array<long>")
    links = spark.createDataFrame([], "src long, dst long")
    found = spark.createDataFrame([], "node long, component long")
    for low, high in [(None, None), *zip((0, *LEADERS), (*LEADERS, None), strict=True)]:
        with Scratch() as mine:  # of a round, the sets that it made and the links that it found stay
            if low is None:
                pairs = save(_ball_candidates(rows), "candidates")
            else:  # Only buckets of more than one component have anything left to compare.
                named = met.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
                open_ones = named.groupBy("s").agg(F.max("place").alias("most"), F.min("component").alias("a"), F.max("component").alias("b"), *([F.mode("component").alias("largest")] if high is None else []))
                open_ones = open_ones.where((F.col("most") > low + 1) & (F.col("a") < F.col("b"))).drop("most", "a", "b")
                pairs = save(_candidates(save(named.join(open_ones, "s"), "open"), low, high, least), "candidates")
            pairs = save(_possible(pairs, maps, least), "pairs")
            if pairs.isEmpty():
                continue
            wanted = pairs.select(F.explode(F.array("src", "dst")).alias("fp")).distinct().join(sets.select("fp"), "fp", "left_anti")
            made = save(_sets(docs, rows, wanted, width), "sets")
            sets = sets.unionByName(made)
            more = save(_verified(pairs, sets, least), "similar")
            mine.keep(made, more)
            if not more.isEmpty():
                links = links.unionByName(more)
                with Scratch() as inner:
                    found = save(connected_components(links), "found")
                    inner.keep(found)
                mine.keep(found)
    return found


def near_duplicates(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, fp, component_id, text_hash) of every row of docs(doc_id, text); fp is the hash of the row's set of shingles.

    component_id is the least doc_id reachable over links of Jaccard `least` or more, the document
    itself included. Null and empty texts are linked with each other and nothing else, a text of fewer
    than `width` words is one shingle; repeated rows and null ids as in simhash.near_duplicates.
    """
    share = Fraction(str(least))
    with Scratch() as mine:
        rows = save(_firsts(docs, frequent_shingles(docs, width), width, share), "firsts")
        distinct = save(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
        named = named_groups(distinct, similar_components(docs, rows, width, share))
        fps = save(rows.select("doc_id", "fp", "text_hash"), "fps")
        mine.keep(named, fps)
    give_back()
    return fps.join(named, "fp").select("doc_id", "fp", "component_id", "text_hash")


def keep_one(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs whose doc_id is the least of its group, by the rules of simhash.keep_one."""
    return keep_least(docs, near_duplicates(docs, width, least))

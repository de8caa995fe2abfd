"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, embeddings, html_extract, language_model, lines, periodic_runs, shards, simhash, suffixes, token_align, token_counts, toxicity
from .common import scratch_path, table


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line must repeat (min_pages = 2): else a host of one page would lose its whole text."""
    docs = table(spark, sf_dir, "documents")
    return lines.drop_boilerplate(docs, min_pages=2).select("doc_id", "text", "n_lines", "n_dropped")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_documents(table(spark, sf_dir, "documents"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(table(spark, sf_dir, "documents"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: whether it is contaminated, and by what."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    best = F.try_element_at(F.array_sort("found", lambda a, b: F.when(a["coverage"] != b["coverage"], F.when(a["coverage"] > b["coverage"], -1).otherwise(1)).otherwise(F.when(a["item_id"] < b["item_id"], -1).when(a["item_id"] > b["item_id"], 1).otherwise(0))), F.lit(1))
    return found.select("doc_id", (F.size("found") > 0).alias("contaminated"), F.size("found").cast("long").alias("n_items"), best["item_id"].alias("best_item_id"), best["coverage"].alias("best_coverage"), F.size(best["tiles"]).cast("long").alias("n_tiles"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the last version of the store has it: its run, its shard, and its text's length as read back."""
    store = shards.store_in_arrivals(table(spark, sf_dir, "documents"), scratch_path(spark, "shards"))
    return store.placed().select("doc_id", "run", "shard", "version", F.length("text").cast("long").alias("n_chars"), F.xxhash64("text").alias("text_hash"))


def with_loops(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents, by the checksum of their doc_id, repeat a stretch of words from some place on to the end; a null doc_id changes nothing."""
    h = zlib.crc32(b"%d" % doc_id) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, a tenth of which are given one, as digests; the run that repeats most often is told."""
    found = periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), before=with_loops)
    # length / period compared exactly: a greater exponent first, then the smaller start, then the smaller period
    ahead = F.array_sort(
        "runs",
        lambda x, y: F.when(x["length"] * y["period"] > y["length"] * x["period"], -1)
        .when(x["length"] * y["period"] < y["length"] * x["period"], 1)
        .when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1))
        .when(x["period"] != y["period"], F.when(x["period"] < y["period"], -1).otherwise(1))
        .otherwise(0),
    )
    found = found.withColumn("best", F.try_element_at(ahead, F.lit(1)))
    lines_of = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines_of.cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.link_statistics(table(spark, sf_dir, "documents"))


def op13_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the strings of 400 bytes that stand anywhere else too, as a digest of what is left."""
    found = suffixes.drop_repeats(table(spark, sf_dir, "documents"), length=400)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_html, op2_line_dedup, op3_simhash, op4_token_counts, op5_lm, op6_bpe, op7_embeddings, op8_decontaminate, op9_toxicity, op10_sharding, op11_periodic_runs, op12_token_align, op13_suffixes)}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": lines.oracle()}

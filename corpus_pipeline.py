"""From raw documents to token ids: the operators of docloom.llm in a row.

Each stage works on all rows that its predecessor kept, and is written as Parquet in the shared
folder before the next one reads it, so a lost executor costs no finished stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, decontaminate, lines, similar, toxicity
from docloom.llm.common import Scratch, drop_scratch, save, scratch_path, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores at 0.5 or more go; it learns from labels.toxic outside the held-out fold.

    Null and empty texts have the score of a text without terms. Without labels, or with one label
    only, all documents stay. Equal texts stay or go together, repeated rows too; a score of exactly
    0.5 goes; an empty table stays empty.
    """
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines, those on two pages and more than 0.1 of their source's pages, go from every document, and n_chars follows; no document goes.

    Null texts stay null, a null source is the source '', repeated rows are pages each, and a
    line at exactly 0.1 stays. A text of nothing but boilerplate becomes ''.
    """
    clean = lines.drop_boilerplate(docs, min_pages=2)
    size = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", size).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.8 or more (Jaccard, sets of five-word shingles) hold together, the one with the least doc_id stays.

    SimHash's balls link first, each link verified; the set join adds similar pairs further apart than 2 bits.
    Null, empty and blank texts are one group. Rows that repeat a doc_id and its text are one
    document; rows with a null doc_id all stay, for nothing says which of them to drop.
    """
    return similar.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover 0.8 of a test item's words go; null and empty texts stay, and all do where there is no test item.

    Coverage of exactly 0.8 goes. Repeated rows and equal texts go or stay together.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), and the digests of the ids and of what they decode to; no ids for null and empty texts.

    Repeated rows give repeated rows; what is not UTF-8 is encoded as replacement characters.
    """
    return bpe.encode_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_site_lines),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: A fitted model and byte-pair merges are beyond SQL. tests/llm/test_pipeline.py runs the stages on a corpus made by hand; the
#: operators have brute-force tests of their own, but for the fitted classifier, which is held against planted words.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        with Scratch():  # what the stage is made from goes once it is written
            docs = save(stage(spark, docs, sf_dir), path=path)
        if last:
            drop_scratch(spark, last)
        last = path
    return docs

"""Classification by thousands of document types: an inverted index of anchors.

`docloom.operators.classify` writes each anchor into the plan, which suits a few types. Here an anchor
is filed under the rarest of its runs of GRAM letters, rarest among all anchors; documents emit their runs,
equal ones meet in one equi-join, and the anchor is compared at the place that its run stands at. The
plan is the same for any number of types, and a document meets only anchors that it shares a run with.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.pytext import key
from docloom.operators.classify import WITH_DIGITS, WITHOUT_DIGITS, document_key, has_digit_run
from docloom.sources.rules import DocumentRules, builtin_rules

#: Letters of a run; shorter anchors are filed under themselves.
GRAM = 5
#: An index of up to so many rows is sent to every executor; a larger one is joined like any table.
BROADCAST_ROWS = 500_000


def anchor_rows(rules: Iterable[DocumentRules], gram: int = GRAM) -> list[tuple[str, int, int, str, int, str, bool]]:
    """(gram, at, number, anchor, rank, doc_type, excludes): each anchor or exclude of each type, the run that it is filed under and where in it this stands."""
    found = []
    for rank, r in enumerate(rules):
        names = [(k, False) for k in map(key, r.anchors)] + [(k, True) for k in map(key, r.excludes)]
        found += [(k, rank, r.doc_type, out) for k, out in names if k]
    runs = [[k[i : i + gram] for i in range(max(1, len(k) - gram + 1))] for k, *_ in found]
    seen = Counter(g for own in runs for g in set(own))
    rows = []
    for number, ((k, rank, doc_type, out), own) in enumerate(zip(found, runs, strict=True)):
        at = min(range(len(own)), key=lambda i: (seen[own[i]], own[i], i))
        rows.append((own[at], at, number, k, rank, doc_type, out))
    return rows


def anchor_index(spark: SparkSession, rules: Iterable[DocumentRules]) -> DataFrame:
    rows = anchor_rows(rules)
    index = spark.createDataFrame(rows, "gram string, at int, number int, anchor string, rank int, doc_type string, excludes boolean")
    return F.broadcast(index) if len(rows) <= BROADCAST_ROWS else index


def scores(docs: DataFrame, rules: Iterable[DocumentRules] | None = None, texts: str = "texts") -> DataFrame:
    """(doc_id, rank, doc_type, score) of docs(doc_id, texts): for each type with anchors in the document, how many; none where it has something that the type excludes.

    An anchor counts once, however often it occurs; one that a type names twice counts twice. doc_id is
    a key. Null texts are skipped; a document without texts has no rows. Matches are brought together by
    a map-side aggregate: documents are not shuffled.
    """
    rules = list(builtin_rules() if rules is None else rules)
    lengths = sorted({min(GRAM, len(r[0])) for r in anchor_rows(rules)}) or [GRAM]
    keyed = docs.select("doc_id", document_key(F.col(texts)).alias("key"))
    runs = keyed.select("doc_id", "key", F.explode(F.sequence(F.lit(1), F.length("key"))).alias("place")).where("key <> ''")
    grams = [F.substring(F.col("key"), F.col("place"), F.lit(n)) for n in lengths]
    runs = runs.select("doc_id", "key", "place", (grams[0] if len(grams) == 1 else F.explode(F.array_distinct(F.array(*grams)))).alias("gram"))
    met = runs.join(anchor_index(docs.sparkSession, rules), "gram")
    start = F.col("place") - F.col("at")
    met = met.where((start >= 1) & (F.substring(F.col("key"), start, F.length("anchor")) == F.col("anchor")))
    hits = met.select("doc_id", "rank", "doc_type", "number", "excludes").distinct()
    counted = hits.groupBy("doc_id", "rank", "doc_type").agg(F.count_if(~F.col("excludes")).alias("score"), F.bool_or("excludes").alias("out"))
    return counted.where((F.col("score") > 0) & ~F.col("out")).select("doc_id", "rank", "doc_type", "score")


def classify(docs: DataFrame, rules: Iterable[DocumentRules] | None = None, texts: str = "texts") -> DataFrame:
    """(doc_id, doc_type, confidence) of every row of docs(doc_id, texts), as `classify.classify` does without a hint."""
    rules = list(builtin_rules() if rules is None else rules)
    best = scores(docs, rules, texts).groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("least"), "rank", "doc_type", "score")).alias("b"))
    old = [r.doc_type for r in rules if r.family == "cmnd"]
    named = docs.select("doc_id", has_digit_run(F.col(texts)).alias("run")).join(best, "doc_id", "left")
    with_run = "cmnd_12" if "cmnd_12" in old else next(iter([t for t in ("cmnd_9",) if t in old] or old), None)
    without = "cmnd_9" if "cmnd_9" in old else next(iter(old), None)
    is_old = F.coalesce(F.col("b.doc_type").isin("cmnd_9", "cmnd_12"), F.lit(False))
    doc_type = F.when(is_old, F.when(F.col("run"), F.lit(with_run)).otherwise(F.lit(without))).otherwise(F.coalesce("b.doc_type", F.lit("unknown")))
    sure = F.least(F.lit(0.99), F.lit(0.6) + F.lit(0.2) * F.col("b.score"))
    confidence = F.when(is_old, F.when(F.col("run"), WITH_DIGITS).otherwise(WITHOUT_DIGITS)).when(F.col("b").isNotNull(), sure).otherwise(0.0)
    return named.select("doc_id", doc_type.alias("doc_type"), confidence.alias("confidence"))

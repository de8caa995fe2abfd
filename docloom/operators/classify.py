"""Classification by printed anchors. Rules are few and known when the plan is built, so scores are plain expressions: no join, no shuffle."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.pytext import key as python_key
from docloom.functions.text import key, let
from docloom.sources.rules import DocumentRules, builtin_rules

#: The hints that name a family, and the confidences.
FAMILIES = ("cmnd", "cccd")
TRUSTED_HINT, WITH_DIGITS, WITHOUT_DIGITS = 0.95, 0.9, 0.7


def document_key(texts: Column) -> Column:
    """All lines' texts as one key: anchors may cross the ends of lines."""
    return key(F.array_join(texts, " ", ""))


def has_digit_run(texts: Column, digits: int = 12) -> Column:
    return F.exists(texts, lambda t: F.coalesce(F.regexp_replace(t, r"[ .\-]", "").rlike(rf"[0-9]{{{digits},}}"), F.lit(False)))


def anchor_scores(text_key: Column, rules: Iterable[DocumentRules]) -> Column:
    """array<struct<score, order, doc_type>>: how many anchors of each type occur; 0 where something excluded does."""
    found = []
    for rank, r in enumerate(rules):
        hits = [F.contains(text_key, F.lit(k)).cast("int") for k in map(python_key, r.anchors) if k]
        out = [F.contains(text_key, F.lit(k)) for k in map(python_key, r.excludes) if k]
        score = reduce(lambda a, b: a + b, hits, F.lit(0))
        score = F.when(reduce(lambda a, b: a | b, out), 0).otherwise(score) if out else score
        found.append(F.struct(score.cast("int").alias("score"), F.lit(-rank).alias("order"), F.lit(r.doc_type).alias("doc_type")))
    return F.array(*found)


def _best(text_key: Column, rules: list[DocumentRules]) -> Column:
    def chosen(best: Column) -> Column:
        confidence = F.least(F.lit(0.99), F.lit(0.6) + F.lit(0.2) * best["score"])
        return F.struct(F.when(best["score"] > 0, best["doc_type"]).otherwise("unknown").alias("doc_type"), F.when(best["score"] > 0, confidence).otherwise(0.0).alias("confidence"))

    return let(F.array_max(anchor_scores(text_key, rules)), chosen)


def _by_digits(texts: Column, family: list[DocumentRules]) -> Column:
    types = [r.doc_type for r in family]
    some = F.when(has_digit_run(texts), F.struct(F.lit("cmnd_12" if "cmnd_12" in types else (["cmnd_9"] if "cmnd_9" in types else types)[0]).alias("doc_type"), F.lit(WITH_DIGITS).alias("confidence")))
    return some.otherwise(F.struct(F.lit("cmnd_9" if "cmnd_9" in types else types[0]).alias("doc_type"), F.lit(WITHOUT_DIGITS).alias("confidence")))


def classify(texts: Column, hint: Column | None = None, rules: Iterable[DocumentRules] | None = None) -> Column:
    """struct<doc_type, confidence> of a document's array of texts.

    A hint that names a type is trusted; one that names a family narrows the choice; any other counts
    as none. Of equal scores the type that comes first wins. The two old cards with the same print
    are told apart by a run of twelve digits.
    """
    rules = list(builtin_rules() if rules is None else rules)
    unknown = F.struct(F.lit("unknown").alias("doc_type"), F.lit(0.0).alias("confidence"))
    families = {f: [r for r in rules if r.family == f] for f in FAMILIES}
    old = _by_digits(texts, families["cmnd"]) if families["cmnd"] else unknown
    best = lambda of: let(document_key(texts), lambda text_key: _best(text_key, of))
    free = let(best(rules), lambda b: F.when(b["doc_type"].isin("cmnd_9", "cmnd_12"), old).otherwise(b))
    if hint is None:
        return free
    new = best(families["cccd"]) if families["cccd"] else unknown
    trusted = F.struct(hint.alias("doc_type"), F.lit(TRUSTED_HINT).alias("confidence"))
    return F.when(hint == "cmnd", old).when(hint == "cccd", new).when(hint.isin(*(r.doc_type for r in rules)), trusted).otherwise(free)

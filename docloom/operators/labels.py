"""Printed labels at the beginning of lines, found through an index of their one-letter deletions.

A label of five or more characters may differ from what was recognised by one edit. Two strings are
that near only if they, or what is left of either without one letter, are equal somewhere; so labels
and runs of a line's words emit themselves and all their deletions, equal strings meet in one
equi-join, and the distance is computed for those pairs alone. The index is made from rules and has a
row for each label and letter; lines are never compared with labels that they share nothing with.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.pytext import key
from docloom.functions.text import BETWEEN as _BETWEEN
from docloom.functions.text import fold, spelled

#: Fixed value: from so many characters on a label may differ by one edit, and be glued to what follows it.
LONG = 5
#: What may stand between the letters of a key in its text: all that is no letter or digit, and letters that fold to nothing.
_LOOSELY = "[^0-9A-Za-z]*?"
#: An index of up to so many rows is sent to every executor; a larger one is joined like any table.
BROADCAST_ROWS = 500_000


def line_table(docs: DataFrame) -> DataFrame:
    """docs(doc_id, lines) -> (doc_id, at, line_no, text, x, y, w, h, confidence): a row for each line, `at` its place in the array.

    A null text is '', a null coordinate 0, a null confidence 1; null lines and documents without lines
    give no rows. doc_id is a key: rows that repeat it are read as one document.
    """
    line = F.col("line")
    numbers = [F.coalesce(line[c].cast("double"), F.lit(0.0)).alias(c) for c in "xywh"]
    rows = docs.select("doc_id", F.posexplode("lines").alias("at", "line")).where(line.isNotNull())
    return rows.select("doc_id", "at", line["line_no"].alias("line_no"), F.coalesce(line["text"], F.lit("")).alias("text"), *numbers, F.coalesce(line["confidence"].cast("double"), F.lit(1.0)).alias("confidence"))


def word_keys(text: Column) -> Column:
    """The keys of a line's words (what white space and slashes leave), one separator between two."""
    words = F.regexp_replace(F.translate(text, _BETWEEN, "-"), r"(?U)^[\s/]+|[\s/]+$", "")
    return F.regexp_replace(fold(F.regexp_replace(words, r"(?U)[\s/]+", _BETWEEN)), f"[^0-9a-z{_BETWEEN}]", "")


def _first(words: Column, n: Column) -> Column:
    """The first n words' keys, joined."""
    return F.replace(F.call_function("substring_index", words, F.lit(_BETWEEN), n), F.lit(_BETWEEN), F.lit(""))


def deletions(text: str) -> set[str]:
    return {text, *(text[:i] + text[i + 1 :] for i in range(len(text)))}


def label_index(spark: SparkSession, labels: Iterable[str]) -> tuple[DataFrame, list[str]]:
    """(variant, rank, label) of the labels' keys, and the keys by rank; keys that are empty name nothing."""
    keys = [k for k in map(key, labels) if k]
    rows = sorted({(v, i, k) for i, k in enumerate(keys) for v in (deletions(k) if len(k) >= LONG else {k})})
    index = spark.createDataFrame(rows, "variant string, rank int, label string")
    return (F.broadcast(index) if len(rows) <= BROADCAST_ROWS else index), keys


def label_matches(lines: DataFrame, labels: Iterable[str]) -> DataFrame:
    """The rows of lines(text, ...) that begin with a label, once for each: their columns, and (rank, label, span).

    span is how many words make the label up, the least that do; a label of LONG characters or more may
    differ by one edit, and may be glued to what follows it. rank is the label's place among those given.
    """
    index, keys = label_index(lines.sparkSession, labels)
    if not keys:
        return lines.limit(0).selectExpr("*", "0 AS rank", "'' AS label", "0L AS span")
    longest = max(map(len, keys))
    glued = sorted({len(k) for k in keys if len(k) >= LONG})
    own = [F.col(f"`{c}`") for c in lines.columns]
    # Words beyond the longest label's length tell nothing: a run that is cut there is too long for every label but one that it begins with.
    cut = F.regexp_extract(word_keys(F.col("text")), f"^(?:{_BETWEEN}*[0-9a-z]){{0,{longest + 2}}}", 0)
    words = lines.select(*own, cut.alias("_words"))  # not filtered: Spark would make the keys once for the filter and once more for what it keeps
    n_words = F.length("_words") - F.length(F.replace("_words", F.lit(_BETWEEN), F.lit(""))) + 1
    runs = words.select("*", F.explode(F.sequence(F.lit(1), n_words)).alias("_n"))
    runs = runs.select(*own, F.col("_n").cast("long").alias("span"), _first(F.col("_words"), F.col("_n")).alias("_run"), F.length(_first(F.col("_words"), F.col("_n") - 1)).alias("_before"))
    runs = runs.where((F.col("_run") != "") & (F.col("_before") <= longest + 1))
    # -i: the beginning of the i-th length that labels have; 0: the run; i: the run without its i-th letter
    size = F.length("_run")
    last = F.when(size.isin(sorted({n + d for n in glued for d in (-1, 0, 1)})), size).otherwise(0)
    variants = runs.select("*", F.explode(F.sequence(F.lit(-len(glued)), last)).alias("_i"))
    beginning = F.substring(F.col("_run"), F.lit(1), F.try_element_at(F.array(*map(F.lit, glued or [0])), -F.col("_i")))
    without = F.concat(F.substring(F.col("_run"), F.lit(1), F.col("_i") - 1), F.substring(F.col("_run"), F.col("_i") + 1, F.lit(longest + 2)))
    variant = F.when(F.col("_i") == 0, F.col("_run")).when(F.col("_i") > 0, without).when(size > F.length(beginning), beginning)
    met = variants.withColumn("variant", variant).join(index, "variant")
    near = (F.length("label") >= LONG) & (F.startswith("_run", F.col("label")) | (F.levenshtein("_run", "label", 1) >= 0))
    return met.where((F.col("_before") <= F.length("label") + 1) & ((F.col("_run") == F.col("label")) | near)).select(*own, "rank", "label", "span")


def _label_pattern(label: str) -> str:
    """Of the keys of a line's words: those that begin with a label, as `label_matches` has it."""
    put = f"{_BETWEEN}*"
    if len(label) < LONG:
        return put.join(label) + f"(?:{_BETWEEN}|$)"
    any_letter = "[0-9a-z]"
    places = range(len(label))
    near = [[*label[:i], any_letter, *label[i:]] for i in range(len(label) + 1)]
    near += [[*label[:i], any_letter, *label[i + 1 :]] for i in places] + [[*label[:i], *label[i + 1 :]] for i in places]
    edited = "|".join(sorted({put.join(letters) for letters in near}))
    return f"{put.join(label)}|(?:{edited})(?:{_BETWEEN}|$)"


def begins_with_label(text: Column, labels: Iterable[str]) -> Column:
    """Whether a line begins with one of a few labels, without a join: for a field's labels, or a type's.

    One edit leaves a half of a label as it is, so only lines that have a half of one, in any spelling, are brought to their words' keys.
    """
    keys = [k for k in dict.fromkeys(map(key, labels)) if k]
    if not keys:
        return F.lit(False)
    halves = []
    for k in keys:
        first, second = spelled(k[: len(k) // 2], _LOOSELY), spelled(k[len(k) // 2 :], _LOOSELY)
        halves += [f"^{_LOOSELY}{spelled(k, _LOOSELY)}"] if len(k) < LONG else [f"^{_LOOSELY}{first}", second]
    plain = F.replace(F.replace(text, F.lit("ß"), F.lit("ss")), F.lit("ẞ"), F.lit("ss"))
    exact = "^" + _BETWEEN + "*(?:" + "|".join(map(_label_pattern, keys)) + ")"
    return plain.rlike("|".join(halves)) & word_keys(text).rlike(exact)


def label_spans(docs: DataFrame, labels: Iterable[str]) -> DataFrame:
    """(doc_id, line_no, span) of every line: how many words at its beginning make the first fitting label up; 0 if none does."""
    lines = line_table(docs).select("doc_id", "at", "line_no", "text")
    found = label_matches(lines, labels).groupBy("doc_id", "at").agg(F.min(F.struct("rank", "span"))["span"].alias("span"))
    return lines.join(found, ["doc_id", "at"], "left").select("doc_id", "line_no", F.coalesce("span", F.lit(0).cast("long")).alias("span"))


_LINE = ("at", "line_no", "text", "x", "y", "w", "h", "confidence")


def label_lines(lines: DataFrame, labels: Iterable[str]) -> DataFrame:
    """(doc_id, label, span) of each document with a line that begins with one of the labels: the first such line as a struct, and the first fitting label's words.

    Rows are reduced on the map side; a document sends one row for each partition of its lines.
    """
    found = label_matches(lines.select("doc_id", *_LINE), labels)
    first = F.min(F.struct("at", "rank", "span", *_LINE[1:])).alias("f")
    return found.groupBy("doc_id").agg(first).select("doc_id", F.struct(*(F.col(f"f.{c}").alias(c) for c in _LINE)).alias("label"), F.col("f.span").alias("span"))


def without_labels(lines: DataFrame, labels: Iterable[str]) -> DataFrame:
    """The rows of lines(doc_id, at, text, ...) that begin with none of the labels."""
    return lines.join(label_matches(lines.select("doc_id", "at", "text"), labels).select("doc_id", "at").distinct(), ["doc_id", "at"], "left_anti")

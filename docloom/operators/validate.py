"""Checks of values, cross-checks of fields, derived and composed fields, and confidence: the relational forms over nested or long fields."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T

#: Confidences.
AGREED, DERIVED, COMPOSED = 0.97, 0.9, 0.9


def warnings(name: Column, value: Column, required: Column, regex: Column, min_len: Column, enum: Column) -> Column:
    """array<string> of what is wrong with a value; a missing one is only ever missing."""
    missing = value.isNull() | (value == "")
    bad = lambda c: F.coalesce(c, F.lit(False))
    pattern = F.concat(F.lit("^(?:"), F.replace(regex, F.lit("$"), F.lit(r"\z")), F.lit(r")\z"))
    found = [
        F.when(missing & bad(required), F.concat(name, F.lit("_thieu"))),
        F.when(~missing & bad(~F.regexp_like(value, pattern)), F.concat(name, F.lit("_sai_dinh_dang"))),
        F.when(~missing & bad(F.length(value) < min_len), F.concat(name, F.lit("_qua_ngan"))),
        F.when(~missing & bad((F.size(enum) > 0) & ~F.array_contains(enum, value)), F.concat(name, F.lit("_ngoai_danh_muc"))),
    ]
    return F.array_compact(F.array(*found))


def expired(value: Column, as_of: Column | None = None) -> Column:
    day = F.when(value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(value, "yyyy-MM-dd"))
    return F.coalesce(day < (F.current_date() if as_of is None else as_of), F.lit(False))


def cross_checks(fields: DataFrame, checks: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(doc_id, warning) of documents(doc_id, field, value) whose dates are in the wrong order. Both must be dates; one pass, grouped by document."""
    checks = list(checks)
    names = sorted({n for a, _, b in checks for n in (a, b)})
    day = F.when(F.col("value").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date("value", "yyyy-MM-dd"))
    wide = fields.where(F.col("field").isin(*names)).groupBy("doc_id").agg(*(F.max(F.when(F.col("field") == n, day)).alias(n) for n in names))
    ok = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    told = [F.when(~ok[op](F.col(a), F.col(b)), F.lit(f"thu_tu_ngay_sai:{a}{op}{b}")) for a, op, b in checks if op in ok]
    return wide.select("doc_id", F.explode(F.array_compact(F.array(*told))).alias("warning"))


def derive_sex(sex: Column, confidence: Column, number: Column) -> Column:
    """struct<value, confidence, source, raw, warned>: what a twelve-digit number says of the sex wins over what was read."""
    rule = T.sex_from_id(number)
    agreed = F.struct(sex.alias("value"), F.greatest(confidence, F.lit(AGREED)).alias("confidence"), F.lit("ocr").alias("source"), F.lit(None).cast("string").alias("raw"), F.lit(False).alias("warned"))
    as_read = F.struct(sex.alias("value"), confidence.alias("confidence"), F.lit("ocr").alias("source"), F.lit(None).cast("string").alias("raw"), F.lit(False).alias("warned"))
    other = F.struct(rule.alias("value"), F.lit(DERIVED).alias("confidence"), F.lit("derived").alias("source"), T.empty_to_null(sex).alias("raw"), T.empty_to_null(sex).isNotNull().alias("warned"))
    return F.when(rule.isNull(), as_read).when(F.coalesce(sex == rule, F.lit(False)), agreed).otherwise(other)


def compose(*values: Column) -> Column:
    """The values that are there, joined by spaces; null if none is."""
    return T.empty_to_null(F.concat_ws(" ", *map(T.empty_to_null, values)))


def structured_or_ocr(structured: DataFrame, ocr: DataFrame) -> DataFrame:
    """(doc_id, field, value, confidence, source): codes win field by field. Both sides are long and have one row for a field of a document."""
    s = structured.select("doc_id", "field", F.col("value").alias("sv"))
    o = ocr.select("doc_id", "field", F.col("value").alias("ov"), F.col("confidence").alias("oc"))
    both = o.join(s, ["doc_id", "field"], "full")
    return both.select("doc_id", "field", F.coalesce("sv", "ov").alias("value"), F.when(F.col("sv").isNotNull(), AGREED).otherwise(F.col("oc")).alias("confidence"), F.when(F.col("sv").isNotNull(), "structured").otherwise("ocr").alias("source"))


def overall_confidence(fields: Column, weights: Column) -> Column:
    """Weighted mean over all fields (array of name, confidence), missing ones as 0, rounded to 4 places; 0 if there are none."""
    weight = lambda f: F.coalesce(F.try_element_at(weights, f["name"]), F.try_element_at(weights, F.lit("default")), F.lit(0.1))
    total = F.aggregate(fields, F.lit(0.0), lambda a, f: a + weight(f))
    sums = F.aggregate(fields, F.lit(0.0), lambda a, f: a + weight(f) * f["confidence"])
    return F.when(total > 0, F.round(sums / total, 4)).otherwise(0.0)


def overall_confidence_long(fields: DataFrame, weights: DataFrame, default: float = 0.1) -> DataFrame:
    """(doc_id, overall) of the long form fields(doc_id, field, confidence), with weights(field, weight), a row for each field that rules name, broadcast.

    One shuffle, combined before it. Sums and the quotient are decimals, so that no order of tasks
    changes the last digit, and halves go up; a null confidence is 0.
    """
    exact = lambda c, kind: c.cast(f"decimal({kind})")
    w, c = exact(F.coalesce("weight", F.lit(default)), "9,6"), exact(F.coalesce("confidence", F.lit(0.0)), "9,6")
    sums = fields.join(F.broadcast(weights), "field", "left").groupBy("doc_id").agg(exact(F.sum(w * c), "20,12").alias("a"), exact(F.sum(w), "12,6").alias("b"))
    return sums.select("doc_id", F.when(F.col("b") > 0, F.round(F.col("a") / F.col("b"), 4)).otherwise(0).cast("double").alias("overall"))

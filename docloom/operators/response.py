"""The whole of a document: codes first, else lines; classified, extracted, scored; one row each."""

from __future__ import annotations

import datetime
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators import classify, structured
from docloom.operators.extract import LINES, extract_fields
from docloom.operators.validate import overall_confidence
from docloom.sources.rules import DocumentRules, builtin_rules

MAP = "map<string,string>"
FIELD_VALUE = "struct<value:string,confidence:double,source:string,raw:string>"


def _by_type(rules: Iterable[DocumentRules], of, kind: str) -> Column:
    """A value that depends on the document's type: an expression rather than a join, for types are few."""
    out = F.lit(None).cast(kind)
    for r in rules:
        out = F.when(F.col("doc_type") == r.doc_type, of(r)).otherwise(out)
    return out


def process(docs: DataFrame, rules: Iterable[DocumentRules] | None = None, as_of: datetime.date | None = None) -> DataFrame:
    """docs(doc_id, lines, and if there are: payloads, hint, quality_ok) -> one response row each.

    A narrow chain without a shuffle: lines stay nested, codes and classes are expressions, and one
    Arrow kernel folds the fields. Documents that their codes make up are extracted from no lines.
    """
    rules = tuple(builtin_rules() if rules is None else rules)
    have = set(docs.columns)
    payloads = F.coalesce(F.col("payloads"), F.array().cast("array<string>")) if "payloads" in have else F.array().cast("array<string>")
    hint = F.col("hint") if "hint" in have else F.lit(None).cast("string")
    good = F.coalesce(F.col("quality_ok"), F.lit(True)) if "quality_ok" in have else F.lit(True)
    lines = F.coalesce(F.col("lines").cast(LINES), F.array().cast(LINES))
    rows = docs.select("doc_id", lines.alias("lines"), payloads.alias("payloads"), hint.alias("hint"), good.alias("good"))
    texts = F.transform("lines", lambda o: F.coalesce(o["text"], F.lit("")))
    rows = rows.withColumn("parsed", structured.parse(F.col("payloads"), texts, rules))
    rows = rows.withColumn("by_code", structured.identified(F.col("parsed"), F.col("hint"), rules)).withColumn("class", classify.classify(texts, F.col("hint"), rules))
    rows = rows.withColumn("doc_type", F.when(~F.col("good"), "unknown").otherwise(F.coalesce("by_code.doc_type", "class.doc_type")))
    rows = rows.withColumn("classification_confidence", F.when(~F.col("good"), 0.0).when(F.col("by_code").isNotNull(), 0.99).otherwise(F.col("class.confidence")))
    rows = rows.withColumn("found", structured.codes_of(F.col("doc_type"), F.col("parsed"), rules))
    alone = F.col("by_code").isNotNull()
    rows = rows.select(
        "doc_id",
        "doc_type",
        "classification_confidence",
        F.when(alone, F.array(F.lit("qr"))).otherwise(F.col("found.kinds")).alias("structured_used"),
        (F.size("lines") == 0).alias("no_text"),
        "good",
        alone.alias("alone"),
        F.when(alone, F.array().cast(LINES)).otherwise(F.col("lines")).alias("lines"),
        F.when(alone, F.col("by_code.codes")).otherwise(F.col("found.codes")).cast(MAP).alias("codes"),
        F.size(F.when(alone, F.col("by_code.codes")).otherwise(F.col("found.codes"))).alias("n_codes"),
    )
    out = extract_fields(rows, rules, as_of)
    unknown = F.col("doc_type") == "unknown"
    ready = F.coalesce(_by_type(rules, lambda r: F.lit(r.ready), "boolean"), F.lit(True))
    weights = _by_type(rules, lambda r: F.create_map(*(F.lit(x) for kv in r.field_weights.items() for x in kv)).cast("map<string,double>") if r.field_weights else F.create_map().cast("map<string,double>"), "map<string,double>")
    weights = F.coalesce(weights, F.create_map().cast("map<string,double>"))
    told = F.array_compact(F.array(F.when(F.col("good") & unknown, "khong_nhan_dang_duoc_loai"), F.when(~unknown & ~ready, "plugin_chua_co_mau"), F.when(~unknown & ~F.col("alone") & F.col("no_text") & (F.col("n_codes") == 0), "ocr_no_text")))
    return out.select(
        "doc_id",
        "doc_type",
        _by_type(rules, lambda r: F.lit(r.display_name), "string").alias("label"),
        F.round("classification_confidence", 4).alias("classification_confidence"),
        overall_confidence(F.col("fields"), weights).alias("overall_confidence"),
        "fields",
        "structured_used",
        F.concat(told, F.coalesce("field_warnings", F.array().cast("array<string>"))).alias("warnings"),
        F.array_compact(F.array(F.when(~F.col("good"), "anh_qua_kem"))).alias("errors"),
    )


def fields_map(fields: Column) -> Column:
    entry = lambda f: F.struct(f["name"].alias("key"), F.struct(f["value"].alias("value"), f["confidence"].alias("confidence"), f["source"].alias("source"), f["raw"].alias("raw")).alias("value"))
    return F.map_from_entries(F.transform(fields, entry)).cast(f"map<string,{FIELD_VALUE}>")


def to_json(responses: DataFrame) -> DataFrame:
    """(doc_id, json): the response as it is served."""
    body = F.struct(
        F.col("doc_id").cast("string").alias("requestId"), F.col("doc_type").alias("documentType"), F.col("label").alias("documentTypeLabel"), F.col("classification_confidence").alias("classificationConfidence"),
        F.col("overall_confidence").alias("overallConfidence"), fields_map(F.col("fields")).alias("fields"), F.col("structured_used").alias("structuredDataUsed"), "warnings", "errors",
    )
    return responses.select("doc_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))

"""Measuring a run: fields against golden ones, accuracy, time by stage, margins between scores, softmax of a model's outputs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def softmax(logits: Column) -> Column:
    """array<double> of probabilities, shifted by the greatest logit so that none overflows.

    A null or empty array stays as it is; with a null or NaN among them all probabilities are null, for
    nothing can be said of the others; an infinite logit takes all, several share it.
    """
    values = logits.cast("array<double>")
    top = F.array_max(values)
    odd = F.exists(values, lambda x: x.isNull() | F.isnan(x))
    shifted = F.transform(values, lambda x: F.when(x == top, 0.0).otherwise(x - top))
    parts = F.transform(shifted, F.exp)
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    shares = F.when(odd, F.transform(values, lambda x: F.lit(None).cast("double"))).otherwise(F.transform(parts, lambda x: x / total))
    return F.when(F.size(values) == 0, values).otherwise(shares)


def argmax(values: Column) -> Column:
    """The place, from 0, of the greatest value; the first of equal ones. Null where there is none; nulls and NaN never win."""
    real = F.transform(values.cast("array<double>"), lambda x: F.when(F.isnan(x), None).otherwise(x))
    place = F.array_position(real, F.array_max(real))
    return F.when(place > 0, place - 1)


def classified(logits: Column, names: Iterable) -> Column:
    """struct<label, confidence> of a classifier's logits; names by place. Null where nothing can be said."""
    shares = softmax(logits)
    place = argmax(shares)
    label = F.get(F.array(*map(F.lit, names)), place)
    return F.when(place.isNotNull(), F.struct(label.alias("label"), F.get(shares, place).alias("confidence")))


def stage_means(times: DataFrame, stage: str = "stage", value: str = "value") -> DataFrame:
    """(stage, n, mean) of measured times; rows without a value do not count."""
    rows = times.select(F.col(stage).alias("stage"), F.col(value).alias("value")).where("value IS NOT NULL")
    return rows.groupBy("stage").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def accuracy(results: DataFrame, correct: Column, by: str) -> DataFrame:
    """(by, accuracy, n): the share of rows that are correct, null counting as wrong."""
    return results.groupBy(by).agg(F.avg(F.coalesce(correct, F.lit(False)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def clear_winners(scores: DataFrame, group: str, score: str, order: str, least_ratio: float = 1.2) -> DataFrame:
    """(group, best, ratio) of groups whose best score is `least_ratio` times the second or more; groups of one have no second and are left out.

    Only two scores of a group leave the window; Spark cuts the others where they are.
    """
    ranked = scores.select(group, score, F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), order)).alias("k")).where("k <= 2")
    best, second = F.max(score), F.min(F.when(F.col("k") == 2, F.col(score)))
    return ranked.groupBy(group).agg(best.alias("best"), (best / second).alias("ratio")).where(F.col("ratio") >= least_ratio)


def compared(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, field, expected, found, same) of expected(doc_id, field, value) and found(doc_id, field, value): every field of either side, a null only equal to a null."""
    left = expected.select("doc_id", "field", F.col("value").alias("expected"))
    both = left.join(found.select("doc_id", "field", F.col("value").alias("found")), ["doc_id", "field"], "full")
    return both.withColumn("same", F.col("expected").eqNullSafe(F.col("found")))


def field_scores(compared_fields: DataFrame, *by: str) -> DataFrame:
    """(by, n, same, found): how many fields there are, how many are as expected, and how many have a value."""
    return compared_fields.groupBy(*(by or ("field",))).agg(F.count("*").alias("n"), F.count_if("same").alias("same"), F.count("found").alias("found"))


def unused(lines: DataFrame, used: DataFrame, keys: Iterable[str] = ("doc_id", "line_no")) -> DataFrame:
    """The lines whose keys are not among the used ones."""
    return lines.join(used.select(*keys).distinct(), list(keys), "left_anti")

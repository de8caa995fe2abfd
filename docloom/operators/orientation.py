"""Which way up: scores of the recognised lines of each tried angle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What upright lines look like.
TALL, LEAST_UPRIGHT, UPRIGHT_SHARE, LEAST_GOOD, GOOD_MEAN = 0.25, 3, 0.6, 6, 0.7


def _wide(line: Column) -> Column:
    return line["w"] >= line["h"]


def score(lines: Column) -> Column:
    """Sum of confidences; lines taller than wide count a quarter."""
    return F.aggregate(lines, F.lit(0.0), lambda a, o: a + o["confidence"] * F.when(_wide(o), 1.0).otherwise(TALL))


def wide_share(lines: Column) -> Column:
    return F.size(F.filter(lines, _wide)) / F.size(lines)


def looks_upright(lines: Column) -> Column:
    return (F.size(lines) >= LEAST_UPRIGHT) & F.coalesce(wide_share(lines) >= UPRIGHT_SHARE, F.lit(False))


def mean_confidence(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0.0), lambda a, o: a + o["confidence"]) / F.size(lines)


def good_enough(lines: Column) -> Column:
    return (F.size(lines) >= LEAST_GOOD) & F.coalesce(mean_confidence(lines) >= GOOD_MEAN, F.lit(False))


def angle_order(lines: Column) -> Column:
    """The angles to try after 0, by whether its lines are rather wide or tall."""
    wide = F.size(F.filter(lines, _wide))
    return F.when(wide >= F.size(lines) - wide, F.array(*map(F.lit, (180, 90, 270)))).otherwise(F.array(*map(F.lit, (90, 270, 180))))


def best_angle(tries: Column) -> Column:
    """Of array<struct<angle, lines>> in the order of trying: the first that is good enough, else the best score, the earlier of equal ones."""
    good = F.get(F.filter(tries, lambda t: good_enough(t["lines"])), 0)
    best = F.array_max(F.transform(tries, lambda t, i: F.struct(score(t["lines"]).alias("score"), (-i).alias("at"), t["angle"].alias("angle"))))
    before_good = F.coalesce(good["angle"], best["angle"])
    return before_good

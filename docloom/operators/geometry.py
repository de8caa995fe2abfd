"""Corner geometry as Columns over array<struct<x, y>> of four points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def polygon_box(points: Column) -> Column:
    """struct<x, y, w, h> of a polygon."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    x, y = F.array_min(xs), F.array_min(ys)
    return F.struct(x.alias("x"), y.alias("y"), (F.array_max(xs) - x).alias("w"), (F.array_max(ys) - y).alias("h"))


def _least(points: Column, of) -> Column:
    at = F.array_min(F.transform(points, lambda p, i: F.struct(of(p).alias("k"), i.alias("i"))))["i"]
    return F.get(points, at)


def order_points(points: Column) -> Column:
    """Top left, top right, bottom right, bottom left: by the extremes of x + y and y - x."""
    total, slope = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    return F.array(_least(points, total), _least(points, slope), _least(points, lambda p: -total(p)), _least(points, lambda p: -slope(p)))


def order_by_angle(points: Column) -> Column:
    """Around the centre by angle, beginning at the corner nearest the top left: right for corners of any rotation."""
    n = F.size(points)
    mean = lambda axis: F.aggregate(points, F.lit(0.0), lambda a, p: a + p[axis]) / n
    mx, my = mean("x"), mean("y")
    turned = F.array_sort(F.transform(points, lambda p, i: F.struct(F.atan2(p["y"] - my, p["x"] - mx).alias("angle"), i.alias("i"), p.alias("p"))))
    ring = F.transform(turned, lambda t: t["p"])
    start = F.array_min(F.transform(ring, lambda p, i: F.struct((p["x"] + p["y"]).alias("k"), i.alias("i"))))["i"]
    return F.concat(F.slice(ring, start + 1, n), F.slice(ring, F.lit(1), start))


def _side(points: Column, a: int, b: int) -> Column:
    p, q = F.get(points, a), F.get(points, b)
    return F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))


def size(points: Column) -> Column:
    """struct<w, h>: the longer of each pair of opposite sides of ordered corners."""
    return F.struct(F.greatest(_side(points, 0, 1), _side(points, 3, 2)).alias("w"), F.greatest(_side(points, 0, 3), _side(points, 1, 2)).alias("h"))


def aspect_ratio(points: Column) -> Column:
    s = size(points)
    return F.greatest(s["w"], s["h"]) / F.greatest(F.lit(1.0), F.least(s["w"], s["h"]))


def skew_degrees(points: Column) -> Column:
    p, q = F.get(points, 0), F.get(points, 1)
    return F.abs(F.degrees(F.atan2(q["y"] - p["y"], q["x"] - p["x"])))


def area(points: Column) -> Column:
    """By the shoelace formula."""
    n = F.size(points)
    terms = F.transform(points, lambda p, i: p["x"] * F.get(points, (i + 1) % n)["y"] - F.get(points, (i + 1) % n)["x"] * p["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)) / 2


def passes_through(points: Column, image_area: Column, skip_fill: float = 0.90, skip_skew: float = 3.0, aspect: tuple[float, float] | None = None) -> Column:
    """Whether an image is to be left as it is: the wrong shape, or a card that fills it and stands straight."""
    straight = (area(points) / image_area >= skip_fill) & (skew_degrees(points) <= skip_skew)
    return straight if aspect is None else straight | ~aspect_ratio(points).between(*aspect)


def use_corner_model(points: Column, image_area: Column, ratio: float = 0.55) -> Column:
    return F.coalesce(area(points) / image_area < ratio, F.lit(True))

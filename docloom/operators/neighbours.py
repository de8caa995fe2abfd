"""Lines around a label, relationally: what the label's row, column and page have.

A document has one line that a field's label is found on. It is joined with the document's lines by
doc_id, and every question is one aggregate over them: the least of a struct that begins with what
decides. So work is linear in the lines, however long a document is, the join and the aggregate share
one partitioning, and no Python worker runs. (`docloom.operators.spatial` asks the same of nested lines
in an Arrow kernel, which also knows what other fields have used.)
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.extract import BELOW_GAP, BELOW_SLACK, NOISE, RIGHT_SLACK, SAME_ROW
from docloom.operators.labels import begins_with_label, label_lines, line_table, without_labels


def _of(name: str) -> Column:
    return F.col(f"label.{name}")


def _centre(y: Column, h: Column) -> Column:
    return y + h / 2


def _columns() -> dict[str, Column]:
    return {c: F.col(c) for c in "xywh"}


def same_row(o: Column | None = None) -> Column:
    """Whether a line's (a row's, or a struct's) centre is about as high as the label's."""
    o = _columns() if o is None else o
    far = F.abs(_centre(_of("y"), _of("h")) - _centre(o["y"], o["h"]))
    return far <= F.lit(SAME_ROW) * F.greatest(_of("h"), o["h"])


def to_the_right(o: Column | None = None) -> Column:
    o = _columns() if o is None else o
    return same_row(o) & (o["x"] >= _of("x") + _of("w") - F.lit(RIGHT_SLACK) * _of("h"))


def underneath(o: Column | None = None) -> Column:
    """Lower than the label, and in its column."""
    o = _columns() if o is None else o
    lower = _centre(o["y"], o["h"]) > _of("y") + _of("h") - F.lit(BELOW_SLACK) * _of("h")
    return lower & (o["x"] < _of("x") + _of("w")) & (o["x"] + o["w"] > _of("x"))


def around(lines: DataFrame, labels: Iterable[str]) -> DataFrame:
    """Every other line of a document beside the line that one of the labels is found on, as `label`."""
    return lines.join(label_lines(lines, labels), "doc_id").where(F.col("at") != _of("at"))


def right_neighbours(docs: DataFrame, labels: Iterable[str], vietnamese: bool = False) -> DataFrame:
    """(doc_id, line_no, text) of the line to the right of the label's: certain ones first, then (if asked) Vietnamese ones, then the leftmost."""
    near = around(line_table(docs), labels).where(to_the_right())
    other = ~T.has_vietnamese(F.col("text")) if vietnamese else F.lit(False)
    best = F.min(F.struct((F.col("confidence") < NOISE).alias("noise"), other.alias("other"), "x", "at", "line_no", "text"))
    return near.groupBy("doc_id").agg(best.alias("b")).select("doc_id", "b.line_no", "b.text")


def lines_below(docs: DataFrame, labels: Iterable[str], all_labels: Iterable[str]) -> DataFrame:
    """(doc_id, line_no, text) of the nearest line under the label's, in its column, if it is near enough and no label."""
    near = around(line_table(docs), labels).where(underneath())
    gap = F.col("y") - (_of("y") + _of("h"))
    best = F.min(F.struct("y", "at", "line_no", "text", (gap <= F.lit(BELOW_GAP) * _of("h")).alias("close")))
    first = near.groupBy("doc_id").agg(best.alias("b")).where("b.close").select("doc_id", "b.at", "b.line_no", "b.text")
    return without_labels(first, all_labels).select("doc_id", "line_no", "text")


def _pages(docs: DataFrame, labels: Iterable[str] = ()) -> DataFrame:
    """(doc_id, page) of each row: its lines as structs of at, text, x, y, w, h, iso (the line's date) and labelled, made once and named by all that asks.

    A null text is '', a null coordinate 0; null lines are left out. Each row is a document of its own.
    """
    labels = list(labels)

    def facts(o: Column, at: Column) -> Column:
        text = F.coalesce(o["text"], F.lit(""))
        numbers = [F.coalesce(o[c].cast("double"), F.lit(0.0)).alias(c) for c in "xywh"]
        return F.struct(at.alias("at"), text.alias("text"), *numbers, T.find_date(text).alias("iso"), begins_with_label(text, labels).alias("labelled"))

    page = F.filter(F.transform("lines", lambda o, i: F.when(o.isNotNull(), facts(o, i))), lambda o: o.isNotNull())
    return docs.select("doc_id", page.alias("page"))


def _first(rows: Column) -> Column:
    return F.get(rows, 0)


def dates_after(docs: DataFrame, labels: Iterable[str]) -> DataFrame:
    """(doc_id, iso) of every document: the date on the label's line, else the leftmost to its right, else the first on three lines under it; null if there is none.

    Lines stay nested: nothing is shuffled.
    """
    found = _pages(docs, labels).withColumn("label", _first(F.filter("page", lambda o: o["labelled"])))
    others = F.filter("page", lambda o: o["at"] != _of("at"))
    rows = found.select("doc_id", "label", F.when(F.col("label").isNotNull(), others).alias("page"))
    dated = lambda o: o["iso"].isNotNull()
    beside = F.array_min(F.transform(F.filter("page", lambda o: dated(o) & to_the_right(o)), lambda o: F.struct(o["x"], o["at"], o["iso"].alias("iso"))))
    under = F.array_sort(F.transform(F.filter("page", underneath), lambda o: F.struct(o["y"], o["at"], o["iso"].alias("iso"))))
    below = _first(F.filter(F.slice(under, 1, 3), dated))
    return rows.select("doc_id", F.coalesce(_of("iso"), beside["iso"], below["iso"]).alias("iso"))


def _orphans(docs: DataFrame, all_labels: Iterable[str], bound: str, best: str, fits: Callable[[Column, Column], Column], says: Callable[[Column], Column] = lambda t: F.lit(True)) -> DataFrame:
    """(doc_id, text) of the first (min) or last (max) line from top to bottom that fits, beside the first or last of the dates' ys, and that has two or more words, Vietnamese among them, no date and no label."""
    all_labels, array = list(all_labels), {"min": F.array_min, "max": F.array_max}
    dates = F.transform(F.filter("page", lambda o: o["iso"].isNotNull()), lambda o: o["y"])
    rows = _pages(docs).withColumn("date", array[bound](dates))
    words = lambda t: T.has_vietnamese(t) & t.rlike(r"(?U)\S\s+\S")
    here = F.filter("page", lambda o: o["iso"].isNull() & fits(o, F.col("date")) & words(o["text"]) & says(o["text"]) & ~begins_with_label(o["text"], all_labels))
    found = array[best](F.transform(here, lambda o: F.struct(o["y"], o["at"], o["text"].alias("text"))))["text"]
    # As an array's only entry: a filter on the column itself would be pushed down, and all of it found twice.
    return rows.select("doc_id", F.explode(F.array(found)).alias("text")).where("text IS NOT NULL")


def places_after_dates(docs: DataFrame, all_labels: Iterable[str]) -> DataFrame:
    """(doc_id, text): the first words under the last date that are no label. Lines stay nested: nothing is shuffled."""
    return _orphans(docs, all_labels, "max", "min", lambda o, last: o["y"] > last)


def names_before_dates(docs: DataFrame, all_labels: Iterable[str], titles: str = "dangvien") -> DataFrame:
    """(doc_id, text): the last words over the first date that are no label and do not end in a title. Lines stay nested: nothing is shuffled."""
    return _orphans(docs, all_labels, "min", "max", lambda o, first: o["y"] < first, lambda t: ~(t.rlike(T.spelled(titles, "[^0-9A-Za-z]*?")) & F.endswith(T.key(t), F.lit(titles))))

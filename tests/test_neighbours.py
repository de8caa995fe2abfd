"""The relational operators around labels, against the kernel that asks the same of nested lines."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import labels, neighbours, spatial
from docloom.operators.extract import LINES, prefix_span
from docloom.sources.rules import FieldRule

WORDS = ["Họ", "và", "tên", "Ho", "va", "ten:", "Hova", "tem", "Họ/và", "Full", "name", "nane", "Ngày", "sinh", "sinhx", "Ngay", "Số", "so", "NGUYỄN", "MẪU", "Thử", "-", "/", "01/02/1990", "3.4.2001", "đảng", "viên", "ĐẢNGVIÊN", "x", "|", "Hộ"]
LABELS = ["Họ và tên", "Full name", "Ngày sinh", "Số", ""]


@pytest.fixture(scope="module")
def pages(spark):
    rnd = random.Random(1)
    rows = []
    for doc_id in range(300):
        page = [
            (i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(6))) if rnd.random() < 0.95 else None, *(float(rnd.choice(c)) for c in ((50, 60, 200, 340), (10, 40, 52, 60, 90, 100), (60, 150, 300), (20, 24, 30))), rnd.choice([0.3, 0.6, 0.9, None]))
            for i in range(rnd.randrange(14))
        ]
        rows.append((doc_id, page))
    rows += [(900, None), (901, []), (902, [None]), (903, [(0, "Họ và tên", None, None, None, None, None), (1, "NGUYỄN", 1.0, 1.0, 1.0, 1.0, None)])]
    return spark.createDataFrame(rows, f"doc_id long, lines {LINES}").cache()


def same(a, b):
    left, right = sorted(map(tuple, a.collect()), key=str), sorted(map(tuple, b.collect()), key=str)
    assert left == right
    return left


def no_python(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return "Python" not in plan and "Arrow" not in plan


def test_spans(pages):
    plain = pages.where("doc_id < 902")
    assert len({r[2] for r in same(labels.label_spans(plain, LABELS), spatial.label_spans(plain, LABELS))}) > 3


def test_no_distance_is_computed_outside_candidates(spark):
    """What a label meets shares a deletion with it: of 400 unlike lines none does."""
    frame = spark.createDataFrame([(i, i, f"zq{i} wk") for i in range(400)] + [(400, 0, "Ngay sihn"), (401, 0, "Ngay sjnh"), (402, 0, "ngaysinhtai"), (403, 0, "ngay tai sinh")], "doc_id long, at int, text string")
    assert {r["doc_id"]: r["span"] for r in labels.label_matches(frame, ["Ngày sinh"]).collect()} == {401: 2, 402: 1}
    index, keys = labels.label_index(spark, ["Ngày sinh", "Số"])
    assert keys == ["ngaysinh", "so"] and index.count() == 1 + len("ngaysinh") + 1


def test_neighbours(pages):
    plain = pages.where("doc_id < 902")
    for names in (["Họ và tên", "Full name"], ["Số"], []):
        for vietnamese in (False, True):
            same(neighbours.right_neighbours(plain, names, vietnamese), spatial.right_neighbours(plain, names, vietnamese))
        same(neighbours.lines_below(plain, names, LABELS), spatial.lines_below(plain, names, LABELS))


def test_dates_and_orphans(pages):
    plain = pages.where("doc_id < 902")
    found = spatial.values(plain, {"value": FieldRule("f", ("Ngày sinh",), "date_after_label")}).select("doc_id", T.find_date(F.col("value")).alias("iso"))
    assert any(r[1] for r in same(neighbours.dates_after(plain, ["Ngày sinh"]), found))
    for ours, take in ((neighbours.places_after_dates, "vn_place_orphan"), (neighbours.names_before_dates, "vi_name_orphan")):
        theirs = spatial.values(plain, {"text": FieldRule("f", (), take)}, LABELS).where("text IS NOT NULL")
        assert same(ours(plain, LABELS), theirs)


def test_null_coordinates_and_lines(pages):
    odd = pages.where("doc_id >= 900")
    assert labels.line_table(odd).count() == 2
    same(neighbours.right_neighbours(odd, LABELS), spatial.right_neighbours(odd, LABELS))
    same(labels.label_spans(odd, LABELS), spatial.label_spans(odd, LABELS))


def test_no_python_worker(spark):
    plain = spark.range(5).selectExpr("id AS doc_id", f"CAST(array() AS {LINES}) AS lines")
    for frame in (
        neighbours.right_neighbours(plain, LABELS), neighbours.lines_below(plain, LABELS, LABELS), neighbours.dates_after(plain, LABELS),
        neighbours.places_after_dates(plain, LABELS), neighbours.names_before_dates(plain, LABELS), labels.label_spans(plain, LABELS),
    ):
        assert no_python(frame)


def test_spans_of_single_lines():
    for text, label, want in (("ho va ten", "hovaten", 3), ("hovatem", "hovaten", 1), ("ho va tn", "hovaten", 3), ("so", "so", 1), ("sox", "so", 0)):
        assert prefix_span(text.split(), 0, label) == want

import math

from pyspark.sql import functions as F

from docloom.operators import evaluate, validate


def test_softmax_and_argmax(spark):
    """Shifted by the greatest: large logits do not overflow; the first of equals wins; nulls, NaN, infinities and no logits are defined."""
    rows = [(1, [1000.0, 1001.0, 999.0]), (2, [2.0, 2.0]), (3, []), (4, None), (5, [1.0, None]), (6, [1.0, float("nan")]), (7, [-math.inf, 0.0]), (8, [math.inf, 0.0, math.inf]), (9, [5.0])]
    found = {r["id"]: r for r in spark.createDataFrame(rows, "id int, z array<double>").select("id", evaluate.softmax(F.col("z")).alias("s"), evaluate.argmax(F.col("z")).alias("a"), evaluate.classified(F.col("z"), ("x", "y", "v")).alias("c")).collect()}
    exps = [math.exp(v - 1001) for v in rows[0][1]]
    assert all(abs(a - b / sum(exps)) < 1e-12 for a, b in zip(found[1]["s"], exps, strict=True)) and found[1]["a"] == 1
    assert found[2]["s"] == [0.5, 0.5] and found[2]["a"] == 0 and tuple(found[2]["c"]) == ("x", 0.5)
    assert found[3]["s"] == [] and found[3]["a"] is None and found[3]["c"] is None and found[4]["s"] is None
    assert found[5]["s"] == [None, None] and found[6]["s"] == [None, None] and found[6]["a"] == 0 and found[6]["c"] is None
    assert found[7]["s"] == [0.0, 1.0] and found[8]["s"] == [0.5, 0.0, 0.5] and found[9]["s"] == [1.0]


def test_compared_fields(spark):
    expected = spark.createDataFrame([(1, "a", "x"), (1, "b", None), (2, "a", "y")], "doc_id int, field string, value string")
    found = spark.createDataFrame([(1, "a", "x"), (1, "b", None), (2, "a", "z"), (2, "c", "w")], "doc_id int, field string, value string")
    both = evaluate.compared(expected, found)
    assert {(r["doc_id"], r["field"]): r["same"] for r in both.collect()} == {(1, "a"): True, (1, "b"): True, (2, "a"): False, (2, "c"): False}
    assert {tuple(r) for r in evaluate.field_scores(both).collect()} == {("a", 2, 1, 2), ("b", 1, 1, 0), ("c", 1, 0, 1)}


def test_means_accuracy_and_margins(spark):
    times = spark.createDataFrame([("ocr", 1.0), ("ocr", 3.0), ("ocr", None), ("read", 2.0)], "stage string, value double")
    assert {tuple(r) for r in evaluate.stage_means(times).collect()} == {("ocr", 2, 2.0), ("read", 1, 2.0)}
    results = spark.createDataFrame([("v", True), ("v", None), ("w", False)], "variant string, ok boolean")
    assert {tuple(r) for r in evaluate.accuracy(results, F.col("ok"), "variant").collect()} == {("v", 0.5, 2), ("w", 0.0, 1)}
    scores = spark.createDataFrame([(1, 6.0, 0), (1, 5.0, 1), (2, 5.0, 0), (2, 5.0, 1), (3, 9.0, 0)], "g int, s double, k int")
    assert [tuple(r) for r in evaluate.clear_winners(scores, "g", "s", "k").collect()] == [(1, 6.0, 1.2)]
    lines = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id int, line_no int")
    assert {tuple(r) for r in evaluate.unused(lines, lines.where("line_no = 0").unionByName(lines.where("line_no = 0"))).collect()} == {(1, 1)}


def test_overall_confidence_is_exact(spark):
    fields = spark.createDataFrame([(1, "a", 0.5), (1, "b", None), (1, "c", 0.375), (2, "z", 0.12345)], "doc_id int, field string, confidence double")
    weights = spark.createDataFrame([("a", 0.3), ("b", 0.25)], "field string, weight double")
    assert {tuple(r) for r in validate.overall_confidence_long(fields, weights).collect()} == {(1, 0.2885), (2, 0.1235)}

"""What the queries' plans make, and how often: work that grew with the number of names for a value."""

import datetime
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.functions import pytext as P
from docloom.functions import text as T
from docloom.operators import extract, labels, neighbours
from docloom.operators.extract import LINES, prefix_span
from docloom.plans import catalog, views
from docloom.sources.rules import builtin_rules

SMALL = "/root/testdata/sf0.001"
CARD_TITLE = "HỘ CHIẾU"


def optimized(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["card_line", "card_documents"])
def test_a_cards_lines_are_made_once(spark, name):
    frame = views.card_documents(spark, SMALL) if name == "card_documents" else views.view(spark, SMALL, name)
    plan = optimized(frame)
    assert plan.count(CARD_TITLE) == 1
    made = next(part for part in plan.splitlines() if CARD_TITLE in part)
    assert "lambda" not in made  # else all of it would be interpreted


def test_a_documents_key_is_made_once(spark):
    assert optimized(catalog.queries()["classify_anchor_score"](spark, SMALL)).count("array_join(") == 1


def test_a_line_without_four_digits_is_searched_for_no_date(spark):
    for find, most in ((T.find_date, 5), (T.find_date_phrase, 9)):  # the guard, and for each pattern the match and its three parts
        said = str(find(F.col("t"))).lower()
        assert "[0-9]{4}" in said
        assert said.count("regexp_extract(") + said.count("rlike(") <= most


def test_sex_is_found_without_folding(spark):
    rnd = random.Random(3)
    words = ["Nữ", "nu", "NỮ", "Nam", "nạm", "NAM", "Việt", "viet", "VIỆT", "m", "F", "fémale", "Malé", "x", "đực", "Nữ", "nữα", "7nam", "-", "Ω", "nämlich"]
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", "  ", "/", ": ", ""]) for _ in range(rnd.randrange(6))) for _ in range(600)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.norm_sex(F.col("t")).alias("sex"))
    assert "translate(" not in str(T.norm_sex(F.col("t")))
    got = rows.collect()
    assert all(r["sex"] == P.norm_sex(r["t"]) for r in got), [tuple(r) for r in got if r["sex"] != P.norm_sex(r["t"])][:5]
    assert {r["sex"] for r in got} == {"", "Nam", "Nữ"}


def test_labels_by_pattern(spark):
    rnd = random.Random(4)
    names = ["Họ và tên", "Full name", "Ngày sinh", "Quê quán", "Giới tính", "Số", "Straße"]
    texts = []
    for _ in range(1500):
        text = rnd.choice([*names, "Ngay sinh", "so", "ho/va/ten", "- Sô", "STRASSE"])
        for _ in range(rnd.randrange(3)):
            i = rnd.randrange(len(text) + 1)
            text = text[:i] + rnd.choice(["", " ", "x", "Ă", "-", "/", "1", "ß"]) + text[i + rnd.randrange(2) :]
        texts.append(text + rnd.choice(["", " x", ": 1", "y", " /"]))
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for own in (names, ["Ngày sinh"], ["Số"], [""]):
        keys = [k for k in map(P.key, own) if k]
        want = lambda t: any(prefix_span([P.key(w) for w in t.replace("/", " ").split()], 0, k) for k in keys)  # noqa: E731, B023
        got = rows.select("t", labels.begins_with_label(F.col("t"), own).alias("is")).collect()
        assert [r["t"] for r in got if r["is"] != want(r["t"])] == []


def test_lines_around_dates_are_not_shuffled(spark):
    docs = spark.range(5).selectExpr("id AS doc_id", f"CAST(array() AS {LINES}) AS lines")
    for frame in (neighbours.dates_after(docs, ["Ngày sinh"]), neighbours.places_after_dates(docs, ["Số"]), neighbours.names_before_dates(docs, ["Số"])):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan


def test_a_text_is_read_once_for_all_documents(monkeypatch):
    texts = ["Họ và tên: NGUYỄN VĂN MẪU", "Ngày sinh: 01/02/1990", "Quê quán once more"]
    asked = []
    monkeypatch.setattr(extract.T, "clean_token", lambda t, real=P.clean_token: asked.append(t) or real(t))
    rules = next(r for r in builtin_rules() if r.doc_type == "cccd_chip_front")
    pages = pa.array([[{"text": t, "x": 1.0, "y": None, "w": 5.0, "h": 2.0, "confidence": None, "line_no": 7} for t in [*texts, None]] + [None], None, []] * 3, pa.list_(pa.struct([("line_no", pa.int32()), ("text", pa.string()), *((c, pa.float64()) for c in ("x", "y", "w", "h", "confidence"))])))
    read = [*extract.page_lines(pages)]
    assert [[o.no for o in p] for p in read] == [[0, 1, 2, 3], [], []] * 3
    assert (read[0][3].text, read[0][0].y, read[0][0].confidence) == ("", 0.0, 1.0)
    found = [extract.extract_document(p, rules, {}, datetime.date(2020, 1, 1)) for p in read]
    assert found[0] == found[3] and found[0] == extract.extract_document([extract.read_line(i, o) for i, o in enumerate(pages[0].as_py()[:-1])], rules, {}, datetime.date(2020, 1, 1))
    assert asked and len(asked) == sum(len(t.replace("/", " ").split()) for t in texts)


def test_what_is_remembered_of_texts_is_bounded(monkeypatch):
    monkeypatch.setattr(extract, "REMEMBERED", 3)
    for i in range(20):
        extract.facts_of(f"text {i}")["a"] = i
    assert extract.facts_of("text 19") == {"a": 19} and extract.facts_of("text 1") == {}
    assert len(extract._new) <= 3 and len(extract._old) <= 3

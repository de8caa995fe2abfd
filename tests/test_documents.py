import datetime
import json

import pytest
from pyspark.sql import functions as F

from docloom.operators import classify, geometry, requests, structured
from docloom.operators.extract import Line, extract_document, label_span
from docloom.operators.response import process, to_json
from docloom.sources import adapters
from docloom.sources.documents import Settings, read_frozen_lines
from docloom.sources.rules import builtin_rules, from_manifest, read_manifests

DAY = datetime.date(2020, 1, 1)
RULES = {r.doc_type: r for r in builtin_rules()}


def lines(*rows):
    return [Line(i, *r) for i, r in enumerate(rows)]


CARD = [
    ("GIẤY PHÉP LÁI XE", 200, 10, 300, 30, 0.9),
    ("Số/No: 079 099 000 001", 50, 50, 250, 24, 0.9),
    ("Họ tên / Full name", 50, 90, 150, 24, 0.9),
    ("DRIVER'S LICENSE", 205, 91, 90, 20, 0.3),
    ("NGUYỄN VĂN MẪU", 310, 92, 200, 24, 0.8),
    ("Ngày sinh / Date of Birth", 50, 130, 200, 24, 0.9),
    ("01/02/1990", 60, 158, 120, 24, 0.7),
    ("Hạng / Class: B2", 50, 200, 200, 24, 0.9),
    ("Hà Nội, ngày 05 tháng 06 năm 2015", 300, 240, 300, 24, 0.8),
    ("Có giá trị đến: 04/06/2015", 50, 270, 250, 24, 0.9),
]


def test_one_licence():
    fields, warnings = extract_document(lines(*CARD), RULES["gplx_pet"], {}, DAY)
    found = {f["name"]: f["value"] for f in fields}
    assert found == {"idNumber": "079099000001", "fullName": "NGUYỄN VĂN MẪU", "dateOfBirth": "1990-02-01", "nationality": None, "placeOfResidence": None, "licenseClass": "B2", "dateOfIssue": "2015-06-05", "dateOfExpiry": "2015-06-04"}
    assert warnings == ["da_het_han", "thu_tu_ngay_sai:dateOfIssue<=dateOfExpiry"]


def test_codes_win_and_sex_follows_the_number():
    rules = RULES["cccd_chip_front"]
    fields, warnings = extract_document(lines(("Giới tính / Sex: Nữ", 50, 50, 200, 24, 0.6)), rules, {"idNumber": "001099000001", "dateOfBirth": "01/01/1999"}, DAY)
    by = {f["name"]: f for f in fields}
    assert by["idNumber"]["confidence"] == 0.97 and by["dateOfBirth"]["value"] == "1999-01-01"
    assert (by["sex"]["value"], by["sex"]["source"]) == ("Nam", "derived")
    assert "sex_lech_voi_so_dinh_danh" in warnings


def test_no_lines_give_all_fields_empty():
    fields, warnings = extract_document([], RULES["the_dang_vien"], {}, DAY)
    assert all(f["value"] is None and f["confidence"] == 0 for f in fields) and warnings == ["fullName_thieu", "dateOfBirth_thieu"]


def test_label_span_swallows_both_languages():
    assert label_span(["ho", "ten", "full", "name", "x"], ["hoten", "fullname"]) == 4
    assert label_span(["sinhdate"], ["ngaysinh"]) == 0
    assert label_span(["quequanx"], ["quequan"]) == 1


def test_a_broken_pattern_lets_its_field_through(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "manifest.yaml").write_text("docType: t\nclassify: {anchors: [PHIEU THU]}\nextraction: {fields: [{name: f, labels: [So], validate: {regex: '['}}, {name: g, labels: [Ngay], validate: {regex: '^x$'}}]}\n")
    rules, bad = read_manifests(tmp_path)
    assert not bad and len(rules) == 1 and rules[0].problems() == ["t.f: broken pattern '['"]
    fields, warnings = extract_document(lines(("So: 12", 0, 0, 90, 20, 0.9), ("Ngay: 34", 0, 40, 90, 20, 0.9)), rules[0], {}, DAY)
    assert [f["value"] for f in fields] == ["12", "34"] and warnings == ["g_sai_dinh_dang"]
    docs = spark.createDataFrame([("a", [(0, "PHIEU THU", 0.0, 0.0, 90.0, 20.0, 0.9), (1, "So: 12", 0.0, 40.0, 90.0, 20.0, 0.9)])], "doc_id string, lines array<struct<line_no:int,text:string,x:double,y:double,w:double,h:double,confidence:double>>")
    (row,) = process(docs, rules).collect()
    assert row["doc_type"] == "t" and row["fields"][0]["value"] == "12"


def test_process(spark):
    rows = [("a", [dict(zip(("line_no", "text", "x", "y", "w", "h", "confidence"), (i, t, float(x), float(y), float(w), float(h), float(c)), strict=True)) for i, (t, x, y, w, h, c) in enumerate(CARD)], [], None, True), ("b", [], ["079299000001|NGUYỄN VĂN MẪU|01011970|02021995||Đảng bộ A|05052010"], None, True), ("c", [], [], "gplx_pet", True), ("d", None, None, None, False)]
    docs = spark.createDataFrame(rows, "doc_id string, lines array<struct<line_no:int,text:string,x:double,y:double,w:double,h:double,confidence:double>>, payloads array<string>, hint string, quality_ok boolean")
    out = {r["doc_id"]: r for r in process(docs, as_of=DAY).collect()}
    assert (out["a"]["doc_type"], out["a"]["classification_confidence"]) == ("gplx_pet", 0.99)
    assert out["b"]["doc_type"] == "the_dang_vien" and out["b"]["structured_used"] == ["qr"] and out["b"]["classification_confidence"] == 0.99
    assert out["c"]["doc_type"] == "gplx_pet" and "ocr_no_text" in out["c"]["warnings"]
    assert out["d"]["doc_type"] == "unknown" and out["d"]["errors"] == ["anh_qua_kem"] and out["d"]["overall_confidence"] == 0
    body = json.loads(to_json(process(docs.where("doc_id = 'b'"), as_of=DAY)).first()["json"])
    assert body["fields"]["fullName"] == {"value": "NGUYỄN VĂN MẪU", "confidence": 0.97, "source": "structured", "raw": None}


def test_classification_ties_and_hints(spark):
    rows = spark.createDataFrame([(["CHỨNG MINH", "NHÂN DÂN", "so 0123 4567 8901"], None), (["CHUNG MINH NHAN DAN"], None), (["x"], "cccd"), (["x"], "passport_vn"), ([], None)], "t array<string>, hint string")
    got = [tuple(r[0]) for r in rows.select(classify.classify(F.col("t"), F.col("hint"))).collect()]
    assert got == [("cmnd_12", 0.9), ("cmnd_9", 0.7), ("unknown", 0.0), ("passport_vn", 0.95), ("unknown", 0.0)]


def test_zone_with_a_wrong_digit_is_not_trusted(spark):
    good = ["IDVNMT000000014999299000001<<<", "9901018M3401011VNM<<<<<<<<<<<<", "NGUYEN<<VAN<MAU<<<<<<<<<<<<<<<"]
    bad = [good[0], "9901017M3401011VNM<<<<<<<<<<<<", good[2]]
    rows = spark.createDataFrame([(good,), (bad,), (good[:2],)], "t array<string>")
    read = structured.read(F.lit("cccd_2024_back"), F.array().cast("array<string>"), F.col("t"))
    got = [r[0]["codes"] for r in rows.select(read).collect()]
    assert got == [{"idNumber": "999299000001", "dateOfExpiry": "01/01/2034"}, {}, {}]


def test_corners_of_any_rotation(spark):
    import math

    rows = [([{"x": 500 + 200 * math.cos(math.radians(a + b)), "y": 500 + 200 * math.sin(math.radians(a + b))} for b in (10, 170, 190, 350)],) for a in range(0, 360, 5)]
    df = spark.createDataFrame(rows, "p array<struct<x:double,y:double>>")
    for r in df.select(geometry.area(geometry.order_by_angle(F.col("p"))).alias("a")).collect():
        assert r["a"] == pytest.approx(2 * 200 * 200 * math.sin(math.radians(20)), rel=1e-6)


def test_networks(spark):
    hosts = spark.createDataFrame([("10.0.0.5",), ("192.168.1.1",), ("testclient",), ("::1",)], "h string")
    ask = lambda nets: [r[0] for r in hosts.select(requests.ip_allowed(F.col("h"), nets)).collect()]
    assert ask([]) == ask(["nonsense"]) == [True] * 4
    assert ask(["10.0.0.0/8"]) == [True, False, True, False]


def test_rules(tmp_path):
    assert [r.doc_type for r in builtin_rules()][0] == "bhyt" and not any(r.problems() for r in builtin_rules())
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "manifest.yaml").write_text("docType: t\nextraction: {fields: [{name: f, validate: {regex: '^x$'}}]}\n")
    (tmp_path / "b" / "manifest.yaml").write_text("displayName: none\n")
    good, bad = read_manifests(tmp_path)
    assert [r.doc_type for r in good] == ["t"] and good[0].fields[0].take == "after_colon" and len(bad) == 1
    with pytest.raises(KeyError):
        from_manifest({})


def test_sources(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"image": "a.jpg", "lines": [{"text": "x", "x": 1.0, "y": 2.0, "w": 3.0, "h": 4.0, "confidence": 0.5}]}))
    row = read_frozen_lines(spark, str(tmp_path)).first()
    assert row["doc_id"] == "one" and row["lines"][0]["line_no"] == 0
    assert Settings.load({"DIP_MAX_CONCURRENCY": "3", "DIP_CARD_DETECT": "no", "DIP_API_KEY": "k"}).max_concurrency == 3

    images = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b""))], "doc_id string, content binary")
    ten = adapters.Backend("ten", (), lambda: lambda image: [{"text": str(10 // len(image)), "x": 0.0, "y": 0.0, "w": 1.0, "h": 1.0}])
    got = {r["doc_id"]: r for r in adapters.recognise(images, ten).collect()}
    assert got["a"]["lines"][0]["text"] == "10" and got["b"]["lines"] == [] and "division" in got["b"]["_error"]
    assert adapters.choose().name == "stub"

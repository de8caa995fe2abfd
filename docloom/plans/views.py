"""Stand-ins for documents, made from the star schema by SQL that Spark and DuckDB read alike. All values are invented."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.extract import LINES

_DATE = "lpad(CAST(day({0}) AS STRING), 2, '0') || '{1}' || lpad(CAST(month({0}) AS STRING), 2, '0') || '{1}' || CAST(year({0}) - {2} AS STRING)"


def _date(column: str, separator: str, years_ago: int = 0) -> str:
    return _DATE.format(column, separator, years_ago)


CARD = f"""
SELECT o_orderkey AS doc_id,
  lpad(CAST((o_orderkey * 7919 + 100000000000) % 1000000000000 AS STRING), 12, '0') AS id12,
  CASE o_orderkey % 4 WHEN 0 THEN 'NGUYỄN VĂN MẪU' WHEN 1 THEN 'TRẦN THỊ THỬ' WHEN 2 THEN 'LÊ MINH KHÔNG' ELSE 'PHẠM ĐỨC GIẢ' END AS name,
  CASE o_orderkey % 3 WHEN 0 THEN 'Xã Mẫu, Huyện Bình Thử' WHEN 1 THEN 'Phường Thử Nghiệm' ELSE 'ap khong dau' END AS place,
  {_date("o_orderdate", "/", 30)} AS birth, {_date("o_orderdate", "/")} AS issued, {_date("o_orderdate", "/", -10)} AS expiry,
  lpad(CAST(day(o_orderdate) AS STRING), 2, '0') AS dd, lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS mm, CAST(year(o_orderdate) AS STRING) AS yyyy,
  o_orderkey % 3 AS shift
FROM orders"""

#: (line_no, text, x, y, w, h, confidence) of a card; a null text is no line.
_CARD_LINES = [
    ("CASE doc_id % 6 WHEN 0 THEN 'CĂN CƯỚC' WHEN 1 THEN 'GIẤY PHÉP LÁI XE' WHEN 2 THEN 'CHỨNG MINH NHÂN DÂN' WHEN 3 THEN 'THẺ ĐẢNG VIÊN' WHEN 4 THEN 'HỘ CHIẾU' ELSE 'CAN CUOC CONG DAN' END", 200, 10, 300, 30, 0.99),
    ("CASE doc_id % 5 WHEN 0 THEN 'IDENTITY CARD' WHEN 1 THEN 'DRIVER''S LICENSE' WHEN 2 THEN 'PASSPORT' END", 205, 100, 130, 20, 0.3),
    ("CASE WHEN doc_id % 2 = 0 THEN 'Số/No: ' || id12 ELSE 'Số' END", 50, 60, 60, 24, 0.95),
    ("CASE WHEN doc_id % 2 = 1 THEN substr(id12, 1, 4) || ' ' || substr(id12, 5, 8) END", 130, 61, 200, 24, 0.93),
    ("CASE WHEN doc_id % 2 = 0 THEN 'Họ và tên / Full name' ELSE 'Ho va ten:' END", 50, 100, 150, 24, 0.9),
    ("CASE WHEN doc_id % 3 = 0 THEN name END", 340, 102, 260, 26, 0.88),
    ("CASE WHEN doc_id % 3 <> 0 THEN name END", 60, 128, 260, 26, 0.91),
    ("CASE doc_id % 3 WHEN 0 THEN 'Ngày sinh: ' || birth ELSE 'Ngày sinh / Date of birth' END", 50, 165, 220, 24, 0.94),
    ("CASE WHEN doc_id % 3 = 1 THEN birth END", 300, 166, 130, 24, 0.92),
    ("CASE WHEN doc_id % 3 = 2 THEN substr(birth, 1, 2) || ' - ' || substr(birth, 4, 2) || ' ' || substr(birth, 7, 4) END", 60, 192, 130, 24, 0.87),
    ("CASE doc_id % 4 WHEN 0 THEN 'Giới tính / Sex: Nam' WHEN 1 THEN 'Giới tính: Nữ' WHEN 2 THEN 'Giới tính Sox Nam Quốc tịch Việt Nam' ELSE 'Quốc tịch: Việt Nam / VIETNAMESE' END", 50, 225, 300, 24, 0.9),
    ("CASE WHEN doc_id % 4 <> 3 THEN 'Quê quán' END", 50, 260, 90, 24, 0.9),
    ("place", 60, 286, 240, 24, 0.86),
    ("CASE doc_id % 7 WHEN 0 THEN 'Nơi giả, ngawdate ' || dd || ' mang ' || mm || ' nam ' || yyyy ELSE 'Nơi giả, ngày ' || dd || ' tháng ' || mm || ' năm ' || yyyy END", 300, 322, 300, 24, 0.82),
    ("CASE WHEN doc_id % 5 <> 0 THEN 'Có giá trị đến: ' || expiry END", 50, 350, 260, 24, 0.9),
    ("CASE WHEN doc_id % 2 = 0 THEN 'Noi ĐKHK thưng tru ' || place END", 50, 380, 300, 24, 0.8),
]
CARD_LINES = " UNION ALL ".join(
    f"SELECT doc_id, {n} AS line_no, {text} AS text, CAST({x} + shift AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y, CAST({w} AS DOUBLE) AS w, CAST({h} AS DOUBLE) AS h, CAST({c} AS DOUBLE) AS confidence FROM card"
    for n, (text, x, y, w, h, c) in enumerate(_CARD_LINES)
)
_STRUCTS = [
    f"named_struct('line_no', {n}, 'text', {text}, 'x', CAST({x} + shift AS DOUBLE), 'y', CAST({y} AS DOUBLE), 'w', CAST({w} AS DOUBLE), 'h', CAST({h} AS DOUBLE), 'confidence', CAST({c} AS DOUBLE))"
    for n, (text, x, y, w, h, c) in enumerate(_CARD_LINES)
]
#: All lines of a card as one array, null texts too.
CARD_ARRAY = f"array({', '.join(_STRUCTS)})"

PAYLOADS = f"""
SELECT c_custkey AS doc_id, CASE c_custkey % 6
  WHEN 0 THEN lpad(CAST(c_custkey + 2000000000 AS STRING), 10, '0') || '|' || hex(c_name) || '|' || '0' || CAST(c_custkey % 9 + 1 AS STRING) || '/0' || CAST(c_nationkey % 9 + 1 AS STRING) || '/1980|' || CAST(c_custkey % 3 AS STRING) || '|-|' || c_mktsegment || '|01/01/2020|-|02/02/2021||||03/03/2025|||' || hex(c_mktsegment)
  WHEN 1 THEN lpad(CAST(c_custkey + 1000 AS STRING), 12, '0') || '|' || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE lpad(CAST(c_custkey AS STRING), 9, '0') END || '|' || c_name || '|0' || CAST(c_custkey % 9 + 1 AS STRING) || '011990|' || CASE WHEN c_custkey % 2 = 0 THEN 'Nam' ELSE 'Nữ' END || '|' || c_mktsegment || ', X|02022024'
  WHEN 2 THEN lpad(CAST(c_custkey + 500 AS STRING), 12, '0') || '|' || c_name || '|01011970|02021995|' || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '02021996' END || '|' || c_mktsegment || '|05052010'
  WHEN 3 THEN 'HS' || lpad(CAST(c_custkey AS STRING), 13, '0') || '|' || c_name || '|1/1/1980|1|' || hex(c_mktsegment) || '|' || c_mktsegment
  WHEN 4 THEN 'ab|c'
  ELSE '' END AS payload
FROM customer"""


def _digit(expression: str, length: int) -> str:
    """The 7-3-1 check digit of a string of digits, as SQL."""
    return "CAST((" + " + ".join(f"CAST(substr({expression}, {i + 1}, 1) AS INT) * {(7, 3, 1)[i % 3]}" for i in range(length)) + ") % 10 AS STRING)"


_NUMBER = "lpad(CAST(s_suppkey * 31 AS STRING), 9, '0')"
_BIRTH = "lpad(CAST(s_suppkey % 60 AS STRING), 2, '0') || '0' || CAST(s_suppkey % 9 + 1 AS STRING) || '1' || CAST(s_suppkey % 9 AS STRING)"
_EXPIRY = "'3' || CAST(s_suppkey % 10 AS STRING) || '1231'"
ZONES = f"""
SELECT s_suppkey AS doc_id, number, birth, expiry, name,
  CASE WHEN s_suppkey % 7 = 0 THEN 'X' ELSE {_digit("number", 9)} END AS d1, {_digit("birth", 6)} AS d2, {_digit("expiry", 6)} AS d3
FROM (SELECT s_suppkey, {_NUMBER} AS number, {_BIRTH} AS birth, {_EXPIRY} AS expiry, CASE WHEN s_suppkey % 2 = 0 THEN 'NGUYEN<<VAN<MAU' ELSE 'TRAN<<THU' END AS name FROM supplier)"""
TD1 = """
SELECT doc_id, 0 AS line_no, 'BO CONG AN' AS text FROM zone
UNION ALL SELECT doc_id, 1, 'IDVNM' || number || d1 || lpad(CAST(doc_id AS STRING), 12, '0') || '<<<' FROM zone
UNION ALL SELECT doc_id, 2, birth || d2 || CASE WHEN doc_id % 3 = 0 THEN 'M' ELSE 'f' END || expiry || d3 || 'VNM<<<<<<<<<<<< ' FROM zone
UNION ALL SELECT doc_id, 3, rpad(name, 30, '<') FROM zone"""
TD3 = """
SELECT doc_id, 0 AS line_no, rpad('P<VNM' || name, 44, '<') AS text FROM zone
UNION ALL SELECT doc_id, 1, number || d1 || 'VNM' || birth || d2 || CASE WHEN doc_id % 3 = 0 THEN 'M' ELSE 'F' END || expiry || d3 || lpad(CAST(doc_id AS STRING), 12, '0') || '<<<0' FROM zone WHERE doc_id % 11 <> 0"""

#: What comes with a card's lines: the code of a third of them (its customer's), hints of all kinds, and now and then a poor image.
REQUESTS = """
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN q.payload END AS payload,
  CASE o_orderkey % 10 WHEN 0 THEN 'cmnd' WHEN 1 THEN 'cccd' WHEN 2 THEN 'gplx_pet' WHEN 3 THEN 'nonsense' WHEN 4 THEN 'cccd_chip_front' END AS hint, o_orderkey % 17 <> 0 AS quality_ok
FROM orders LEFT JOIN qr_payload q ON q.doc_id = o_custkey"""

_DEFINED = {"card": CARD, "card_line": f"SELECT * FROM ({CARD_LINES}) WHERE text IS NOT NULL", "qr_payload": PAYLOADS, "request": REQUESTS, "zone": ZONES, "td1_line": TD1, "td3_line": TD3}
_TABLES = {"card": ["orders"], "card_line": ["orders"], "qr_payload": ["customer"], "request": ["orders", "customer"], "zone": ["supplier"], "td1_line": ["supplier"], "td3_line": ["supplier"]}
_NEEDS = {"card_line": ["card"], "request": ["qr_payload"], "td1_line": ["zone"], "td3_line": ["zone"]}


def with_views(*names: str) -> str:
    """A WITH clause that defines the named views and what they need."""
    order = [v for v in _DEFINED if v in names or any(v in _NEEDS.get(n, []) for n in names)]
    return "WITH " + ",\n".join(f"{v} AS ({_DEFINED[v]})" for v in order) + "\n"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables of a folder; nothing is registered in the session."""
    if name == "card_line":
        card = view(spark, sf_dir, "card")  # exploded as it is made: of any other array Spark asks for the size first, and so makes it twice
        return card.repartition(_parts(card)).selectExpr("doc_id", f"inline({CARD_ARRAY})").where("text IS NOT NULL")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES[name]}
    sql = with_views(name) + f"SELECT * FROM {name}"
    for t in tables:
        sql = re.sub(rf"FROM {t}\b", f"FROM {{{t}}}", sql)
    return spark.sql(sql, **tables)


#: Bytes of orders in a partition of cards: a row of some ten bytes becomes a document that costs a millisecond or more.
CARD_BYTES = 1 << 20


def _parts(card: DataFrame) -> int:
    size = int(str(card._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(card.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size, 1 << 50) // CARD_BYTES)


def _cards(spark: SparkSession, sf_dir: str, more: DataFrame | None = None) -> DataFrame:
    """(doc_id, lines, ...) of the cards: an order is one card. Only the few columns that cards are made from, and what comes with them, are dealt out."""
    card = view(spark, sf_dir, "card")
    extra = [c for c in more.columns if c != "doc_id"] if more is not None else []
    rows = card if more is None else card.join(more, "doc_id")
    made = rows.repartition(_parts(card)).selectExpr("doc_id", f"{CARD_ARRAY} AS lines", *extra)
    # Named twice, the array is made before it is filtered, by compiled code; under the lambda all of it would be interpreted.
    return made.selectExpr("doc_id", "CASE WHEN size(lines) > 0 THEN filter(lines, o -> o.text IS NOT NULL) END AS lines", *extra)


def card_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lines) of the cards."""
    return _cards(spark, sf_dir).select("doc_id", F.col("lines").cast(LINES).alias("lines"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lines, payloads, hint, quality_ok): the cards with what comes with them."""
    more = view(spark, sf_dir, "request").select("doc_id", F.array_compact(F.array("payload")).alias("payloads"), "hint", "quality_ok")
    return _cards(spark, sf_dir, more).withColumn("lines", F.col("lines").cast(LINES))

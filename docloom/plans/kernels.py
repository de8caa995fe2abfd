"""Queries of single text kernels, each beside the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import geometry as G
from docloom.operators import requests as R
from docloom.operators import validate as V
from docloom.plans.views import view, with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "card_line")


_FOLD = "lower(strip_accents(replace(replace({}, 'đ', 'd'), 'Đ', 'D')))"
_KEY = "regexp_replace(replace(replace(" + _FOLD + ", 'ß', 'ss'), 'ẞ', 'ss'), '[^0-9a-z]', '', 'g')"


def sql_key(expression: str) -> str:
    return _KEY.format(expression)


@query("fold_key", f"SELECT doc_id, md5({sql_key('text')}) AS key_md5, length({sql_key('text')}) AS key_length FROM documents")
def fold_key(spark, sf_dir):
    """F1-F3 over every document's whole text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    k = T.key(F.col("text"))
    return docs.select("doc_id", F.md5(k).alias("key_md5"), F.length(k).cast("long").alias("key_length"))


@query("edit_distance", "SELECT p_partkey, levenshtein(p_brand, p_type) AS distance, CASE WHEN levenshtein(p_brand, p_type) <= 8 THEN levenshtein(p_brand, p_type) ELSE -1 END AS bounded FROM part")
def edit_distance(spark, sf_dir):
    """F4."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", F.levenshtein("p_brand", "p_type").cast("long").alias("distance"), F.levenshtein("p_brand", "p_type", 8).cast("long").alias("bounded"))


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(
    "text_parts",
    with_views("card_line")
    + rf"""SELECT doc_id, line_no, CASE WHEN contains(text, ':') THEN nullif({_TRIM.format("substr(text, instr(text, ':') + 1)")}, '') END AS after_colon,
  {_TRIM.format("split_part(text, '/', 1)")} AS before_slash, nullif(regexp_extract(text, '(\d)\s*$', 1), '') AS trailing_digit,
  regexp_matches(text, '[^\x00-\x7F]') AND length(regexp_replace(text, '[\x00-\x7F]|[^\p{{L}}]', '', 'g')) > 0 AS vietnamese,
  trim(text) <> '' AS not_blank FROM card_line""",
)
def text_parts(spark, sf_dir):
    """F5, F17, F27, P6, P20."""
    c = F.col("text")
    return _lines(spark, sf_dir).select("doc_id", "line_no", T.after_colon(c).alias("after_colon"), T.before_slash(c).alias("before_slash"), T.trailing_digit(c).alias("trailing_digit"), T.has_vietnamese(c).alias("vietnamese"), (F.trim(c) != "").alias("not_blank"))


_COMPACT = r"(\d{1,2})[\s\-/.]+(\d{1,2})[\s\-/.]+(\d{4})"
_PHRASE = r"(?i)ng[àa]y\D{0,10}?([0-9lio]{1,2})\D{0,10}?th[áa]ng\D{0,10}?([0-9lio]{1,2})\D{0,10}?n[ăa]m\D{0,10}?(\d{4})"
_LOOSE = r"(?:^|[^\p{L}\p{N}_])([0-9liIoO]{1,2})\D*?[A-Za-zÀ-ỹ]\D*?([0-9liIoO]{1,2})\D*?(\d{4})(?:$|[^\p{L}\p{N}_])"


def _sql_iso(expression: str, pattern: str) -> str:
    d, m, y = (f"TRY_CAST(translate(regexp_extract({expression}, '{pattern}', {i}), 'lLIioO', '111100') AS INT)" for i in (1, 2, 3))
    return f"CASE WHEN {m} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND 31 AND {y} BETWEEN 1900 AND 2100 THEN concat_ws('-', CAST({y} AS VARCHAR), lpad(CAST({m} AS VARCHAR), 2, '0'), lpad(CAST({d} AS VARCHAR), 2, '0')) END"


def sql_find_date(expression: str) -> str:
    return _sql_iso(expression, _COMPACT)


def sql_find_phrase(expression: str) -> str:
    return f"CASE WHEN regexp_matches({expression}, '{_PHRASE}') THEN {_sql_iso(expression, _PHRASE)} ELSE {_sql_iso(expression, _LOOSE)} END"


@query("date_compact_iso", with_views("card_line") + f"SELECT doc_id, line_no, {sql_find_date('text')} AS iso FROM card_line")
def date_compact_iso(spark, sf_dir):
    """F6, F9."""
    return _lines(spark, sf_dir).select("doc_id", "line_no", T.find_date(F.col("text")).alias("iso"))


@query("date_phrase_iso", with_views("card_line") + f"SELECT doc_id, line_no, {sql_find_phrase('text')} AS iso, coalesce({sql_find_date('text')}, {sql_find_phrase('text')}, text) AS any_iso FROM card_line")
def date_phrase_iso(spark, sf_dir):
    """F7, F8, F20."""
    c = F.col("text")
    return _lines(spark, sf_dir).select("doc_id", "line_no", T.find_date_phrase(c).alias("iso"), T.NORMALIZERS["toIsoDate"](c).alias("any_iso"))


@query(
    "normalize_text",
    with_views("card_line")
    + r"""SELECT doc_id, line_no, regexp_replace(t, '^\s+|\s+$', '', 'g') AS trimmed, trim(regexp_replace(t, '\s+', ' ', 'g')) AS collapsed, regexp_replace(t, '\s+', '', 'g') AS squeezed, upper(t) AS upper_vi,
  translate(t, 'OoIl|BSZ', '00111852') AS fixed, regexp_replace(t, '\D', '', 'g') AS digits, trim(regexp_replace(regexp_replace(t, '[·…]+|\.{2,}', ' ', 'g'), '\s+', ' ', 'g')) AS undotted, t AS dict_fixed,
  regexp_replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), '(\d)[^\p{L}\p{N}_]+(\d)', '\1.\2', 'g') AS dotted, regexp_replace(t, '^\D+|\D+$', '', 'g') AS stripped,
  regexp_replace(regexp_replace(translate(regexp_replace(t, '\s+', '', 'g'), 'OoIl|BSZ', '00111852'), '^\D+|\D+$', '', 'g'), '\D', '', 'g') AS chained
FROM (SELECT doc_id, line_no, ' ' || text || '...  x' || chr(9) AS t FROM card_line)""",
)
def normalize_text(spark, sf_dir):
    """F10-F16, F21, F23-F25."""
    t = F.concat(F.lit(" "), F.col("text"), F.lit("...  x\t"))
    n = T.NORMALIZERS
    named = {"trimmed": "trim", "collapsed": "collapseSpaces", "squeezed": "removeSpaces", "upper_vi": "upperVi", "fixed": "fixDigits", "digits": "digitsOnly", "undotted": "stripDots", "dict_fixed": "dictFix", "dotted": "dotSeparator", "stripped": "stripEdgeNonDigits"}
    chain = T.apply_normalizers(t, ["removeSpaces", "fixDigits", "stripEdgeNonDigits", "noSuchName", "digitsOnly"])
    return _lines(spark, sf_dir).select("doc_id", "line_no", *(n[f](t).alias(a) for a, f in named.items()), chain.alias("chained"))


@query(
    "norm_sex",
    with_views("card_line")
    + f"""SELECT doc_id, line_no, coalesce(CASE WHEN hit IN ('nu', 'f', 'female') THEN 'Nữ' WHEN hit IS NOT NULL THEN 'Nam' END, '') AS sex FROM (
  SELECT doc_id, line_no, list_filter(list_transform(range(1, len(ks) + 1), lambda i: CASE WHEN ks[i] IN ('nu', 'f', 'female', 'm', 'male') OR ks[i] = 'nam' AND (i = 1 OR ks[i - 1] <> 'viet') THEN ks[i] END), lambda k: k IS NOT NULL)[1] AS hit
  FROM (SELECT doc_id, line_no, list_transform(regexp_extract_all(text, '[0-9A-Za-zÀ-ỹ]+'), lambda w: {sql_key("w")}) AS ks FROM card_line))""",
)
def norm_sex(spark, sf_dir):
    """F18."""
    return _lines(spark, sf_dir).select("doc_id", "line_no", T.norm_sex(F.col("text")).alias("sex"))


@query("sex_from_id", with_views("card") + "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN CAST(substr(id12, 4, 1) AS INT) % 2 = 0 THEN 'Nam' ELSE 'Nữ' END AS sex FROM card")
def sex_from_id(spark, sf_dir):
    """numbers of other lengths say nothing."""
    card = view(spark, sf_dir, "card")
    number = F.when(F.col("doc_id") % 5 == 0, F.substring("id12", 1, 11)).otherwise(F.col("id12"))
    return card.select("doc_id", T.sex_from_id(number).alias("sex"))


_LIKE = " OR ".join(f"levenshtein(k, '{w}') <= {2 if w == 'thuong' else 1}" for w in ("noi", "dkhk", "dang", "ky", "ho", "khau", "thuong", "tru"))


@query(
    "strip_label_echo",
    with_views("card_line")
    + f"""SELECT doc_id, line_no, CASE WHEN first IS NULL OR first = 1 THEN text ELSE regexp_replace(array_to_string(ws[first:], ' '), '^[ ,]+|[ ,]+$', '', 'g') END AS value FROM (
  SELECT *, list_filter(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN NOT list_transform(ws, lambda w: {{k}} = '' OR {{like}})[i] THEN i END), lambda i: i IS NOT NULL)[1] AS first
  FROM (SELECT doc_id, line_no, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM card_line))""".replace("{k}", sql_key("w")).replace("{like}", _LIKE.replace("levenshtein(k,", f"levenshtein({sql_key('w')},")),
)
def strip_label_echo(spark, sf_dir):
    """F22."""
    return _lines(spark, sf_dir).select("doc_id", "line_no", T.strip_residence_label_echo(F.col("text")).alias("value"))


@query(
    "qr_hex_decode",
    "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN NULL ELSE c_name || 'ễ' END AS text FROM customer",
)
def qr_hex_decode(spark, sf_dir):
    """odd lengths and other letters are null."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    coded = F.lower(F.hex(F.concat("c_name", F.lit("ễ"))))
    raw = F.when(F.col("c_custkey") % 4 == 0, F.concat(coded, F.lit("a"))).when(F.col("c_custkey") % 4 == 1, F.concat(coded, F.lit("zz"))).otherwise(coded)
    return c.select("c_custkey", T.hex_to_text(raw).alias("text"))


@query(
    "qr_pipe_fields",
    with_views("qr_payload")
    + r"""SELECT doc_id, i, nullif(nullif(regexp_replace(string_split(payload, '|')[i + 1], '^[\s\x00]+|[\s\x00]+$', '', 'g'), ''), '-') AS part,
  CASE WHEN regexp_full_match(string_split(payload, '|')[i + 1], '[0-9]{8}') THEN concat_ws('/', substr(string_split(payload, '|')[i + 1], 1, 2), substr(string_split(payload, '|')[i + 1], 3, 2), substr(string_split(payload, '|')[i + 1], 5, 4)) ELSE string_split(payload, '|')[i + 1] END AS slashed
FROM qr_payload, (SELECT unnest(range(0, 8)) AS i)""",
)
def qr_pipe_fields(spark, sf_dir):
    """F29, F30."""
    parts = F.split("payload", r"\|")
    rows = view(spark, sf_dir, "qr_payload").select("doc_id", F.posexplode(F.array(*(F.struct(T.pipe_field(parts, i).alias("part"), T.ddmmyyyy(F.try_element_at(parts, F.lit(i + 1))).alias("slashed")) for i in range(8)))).alias("i", "p"))
    return rows.select("doc_id", F.col("i").cast("long").alias("i"), "p.part", "p.slashed")


@query(
    "mrz_dates_names",
    with_views("zone")
    + """SELECT doc_id, substr(birth, 5, 2) || '/' || substr(birth, 3, 2) || '/' || CAST(CASE WHEN CAST(substr(birth, 1, 2) AS INT) <= 30 THEN 2000 ELSE 1900 END + CAST(substr(birth, 1, 2) AS INT) AS VARCHAR) AS birth_slash,
  substr(expiry, 5, 2) || '/' || substr(expiry, 3, 2) || '/20' || substr(expiry, 1, 2) AS expiry_slash, trim(replace(split_part(name, '<<', 1), '<', ' ')) || ' ' || trim(replace(split_part(name, '<<', 2), '<', ' ')) AS full_name FROM zone""",
)
def mrz_dates_names(spark, sf_dir):
    """F31, F32."""
    return view(spark, sf_dir, "zone").select("doc_id", T.yymmdd(F.col("birth")).alias("birth_slash"), T.yymmdd(F.col("expiry"), True).alias("expiry_slash"), T.mrz_name(F.col("name")).alias("full_name"))


@query("mrz_check_digit", with_views("zone") + "SELECT doc_id, d2 AS birth_digit, d3 AS expiry_digit FROM zone")
def mrz_check_digit(spark, sf_dir):
    """A12."""
    return view(spark, sf_dir, "zone").select("doc_id", T.check_digit(F.col("birth")).alias("birth_digit"), T.check_digit(F.col("expiry")).alias("expiry_digit"))


@query(
    "validate_values",
    """SELECT c_custkey, unnest(list_filter([CASE WHEN value IS NULL AND c_custkey % 2 = 0 THEN 'f_thieu' END, CASE WHEN NOT regexp_full_match(value, '[A-Z]{8,9}') THEN 'f_sai_dinh_dang' END, CASE WHEN length(value) < 9 THEN 'f_qua_ngan' END,
  CASE WHEN value NOT IN ('BUILDING', 'FURNITURE') THEN 'f_ngoai_danh_muc' END], lambda w: w IS NOT NULL)) AS warning FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS value FROM customer)""",
)
def validate_values(spark, sf_dir):
    """F33, P9, T8."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    value = F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))
    told = V.warnings(F.lit("f"), value, F.col("c_custkey") % 2 == 0, F.lit("^[A-Z]{8,9}$"), F.lit(9), F.array(F.lit("BUILDING"), F.lit("FURNITURE")))
    return c.select("c_custkey", F.explode(told).alias("warning"))


@query("expiry_check", "SELECT o_orderkey, o_orderkey % 3 <> 0 AND CAST(o_orderdate AS DATE) < DATE '1996-06-15' AS expired FROM orders")
def expiry_check(spark, sf_dir):
    """F34 with a given day; what is no date is never expired."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    value = F.when(F.col("o_orderkey") % 3 == 0, F.lit("1990-02-31")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", V.expired(value, F.to_date(F.lit("1996-06-15"))).alias("expired"))


@query("json_access", "SELECT event_id, props ->> '$.k' AS k, json_keys(props)[1] AS first_key, json_valid(props) AS valid FROM events")
def json_access(spark, sf_dir):
    """fields of a JSON string."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get(F.json_object_keys("props"), 0).alias("first_key"), F.try_parse_json("props").isNotNull().alias("valid"))


@query("rounding", "SELECT l_orderkey, l_linenumber, round(l_quantity / 8.0, 2) AS two, round(l_quantity / 16.0, 1) AS one FROM lineitem")
def rounding(spark, sf_dir):
    """F37, on values that are exact in binary: halves go away from zero."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") / 8, 2).alias("two"), F.round(F.col("l_quantity") / 16, 1).alias("one"))


# ---------------------------------------------------------------- geometry

_BOXED = "SELECT doc_id, line_no, x, y, w, h, x + w AS x2, y + h AS y2, x + w / 2 AS cx, y + h / 2 AS cy FROM card_line"


@query("line_geometry", with_views("card_line") + _BOXED)
def line_geometry(spark, sf_dir):
    """A box from its polygon, and its edges and centre."""
    rows = _lines(spark, sf_dir)
    corner = lambda dx, dy: F.struct((F.col("x") + F.col("w") * dx).alias("x"), (F.col("y") + F.col("h") * dy).alias("y"))
    boxed = rows.select("doc_id", "line_no", G.polygon_box(F.array(corner(1, 0), corner(0, 0), corner(0, 1), corner(1, 1))).alias("b"))
    x, y, w, h = (F.col(f"b.{c}") for c in "xywh")
    return boxed.select("doc_id", "line_no", "b.x", "b.y", "b.w", "b.h", (x + w).alias("x2"), (y + h).alias("y2"), (x + w / 2).alias("cx"), (y + h / 2).alias("cy"))


@query(
    "corner_geometry",
    """SELECT s_suppkey, a AS tl_x, b AS tl_y, a + w AS br_x, b + h AS br_y, w AS width, h AS height, greatest(w, h) / least(w, h) AS aspect, 0.0 AS skew, w * h AS area, w * h / 1000000.0 >= 0.9 AS passes, w * h / 1000000.0 < 0.55 AS model
FROM (SELECT s_suppkey, CAST(s_suppkey % 7 AS DOUBLE) AS a, CAST(s_suppkey % 5 AS DOUBLE) AS b, 900.0 + s_suppkey % 90 AS w, 300.0 + (s_suppkey * 7) % 690 AS h FROM supplier)""",
)
def corner_geometry(spark, sf_dir):
    """Corners in any order; both ways of ordering agree on upright rectangles."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k = F.col("s_suppkey")
    a, b, w, h = (k % 7).cast("double"), (k % 5).cast("double"), F.lit(900.0) + k % 90, F.lit(300.0) + (k * 7) % 690
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    rows = s.select("s_suppkey", F.array(p(a + w, b + h), p(a, b), p(a, b + h), p(a + w, b)).alias("raw"))
    rows = rows.withColumn("pts", F.when(k % 2 == 0, G.order_points(F.col("raw"))).otherwise(G.order_by_angle(F.col("raw"))))
    pts, whole = F.col("pts"), F.lit(1_000_000.0)
    size = G.size(pts)
    return rows.select(
        "s_suppkey", F.get(pts, 0)["x"].alias("tl_x"), F.get(pts, 0)["y"].alias("tl_y"), F.get(pts, 2)["x"].alias("br_x"), F.get(pts, 2)["y"].alias("br_y"), size["w"].alias("width"), size["h"].alias("height"),
        G.aspect_ratio(pts).alias("aspect"), G.skew_degrees(pts).alias("skew"), G.area(pts).alias("area"), G.passes_through(pts, whole).alias("passes"), G.use_corner_model(pts, whole).alias("model"),
    )


# ---------------------------------------------------------------- requests

_HOST = "CASE WHEN c_custkey % 11 = 0 THEN 'testclient' ELSE '10.' || CAST(c_custkey % 4 AS {0}) || '.' || CAST(c_custkey % 256 AS {0}) || '.7' END"


@query("cidr_allow", f"SELECT c_custkey, c_custkey % 11 = 0 OR c_custkey % 4 = 1 OR (c_custkey % 4 = 2 AND c_custkey % 256 < 128) AS allowed FROM customer WHERE {_HOST.format('VARCHAR')} IS NOT NULL")
def cidr_allow(spark, sf_dir):
    """An entry that is no network is skipped."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select("c_custkey", R.ip_allowed(F.expr(_HOST.format("STRING")), ["10.1.0.0/16", "10.2.0.0/17", "not a network"]).alias("allowed"))


_HOST6 = "CASE WHEN c_custkey % 11 = 0 THEN 'testclient:80' WHEN c_custkey % 2 = 0 THEN concat('2001:DB8:', CAST(c_custkey % 4 AS {0}), '::', CAST(c_custkey % 10 AS {0})) ELSE concat('2001:0db8:0:0:0:ffff:10.0.', CAST(c_custkey % 4 AS {0}), '.', CAST(c_custkey % 256 AS {0})) END"


@query(
    "cidr_allow6",
    f"SELECT c_custkey, {_HOST6.format('VARCHAR')} AS host, c_custkey % 11 = 0 OR (c_custkey % 2 = 0 AND (c_custkey % 4 = 2 OR c_custkey % 10 >= 8)) OR (c_custkey % 2 = 1 AND c_custkey % 4 = 1 AND c_custkey % 256 < 128) AS allowed FROM customer",
)
def cidr_allow6(spark, sf_dir):
    """Addresses of the other family, in several spellings; a host with a port is no address."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("host", F.expr(_HOST6.format("STRING")))
    networks = ["2001:db8:2::/48", "2001:db8::8/125", "2001:db8::ffff:10.0.1.0/121", "10.0.0.0/8", "no:network"]
    return c.select("c_custkey", "host", R.ip_allowed(F.col("host"), networks).alias("allowed"))


@query("cidr_filter", "SELECT c_custkey FROM customer WHERE c_custkey % 11 = 0 OR c_custkey % 4 = 3")
def cidr_filter(spark, sf_dir):
    """Only allowed hosts get through."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("host", F.expr(_HOST.format("STRING")))
    return R.admitted(c, ["10.3.0.0/16"]).select("c_custkey")


@query(
    "request_errors",
    """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'unauthorized' WHEN c_custkey % 5 = 0 OR c_custkey % 3 = 0 THEN 'invalid_request' WHEN c_custkey * 20000 > 8388608 THEN 'image_too_large' END AS error,
  c_custkey % 4 < 2 AS upright, CASE WHEN c_custkey % 3 = 1 THEN 'rectified' ELSE 'none' END AS image FROM customer""",
)
def request_errors(spark, sf_dir):
    """P12, Q27, S1."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    api_key = F.when(k % 7 == 0, "wrong").otherwise("right")
    hint = F.when(k % 5 == 0, "no such type").when(k % 2 == 0, "cmnd").otherwise("")
    code = R.error_code(api_key, "right", hint, F.when(k % 3 == 0, 0).otherwise(k * 20_000), ["cmnd", "cccd", "gplx_pet"])
    upright = R.flag(F.when(k % 4 == 0, "TRUE").when(k % 4 == 1, " yes").when(k % 4 == 2, "0").otherwise(""))
    return c.select("c_custkey", code.alias("error"), upright.alias("upright"), R.returned_image(F.when(k % 3 == 1, "rectified").otherwise("anything")).alias("image"))

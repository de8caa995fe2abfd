"""Queries of operators over whole documents, each beside the SQL that states the same where SQL can."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.pytext import key as python_key
from docloom.operators import classify, evaluate, neighbours, orientation, spatial, structured, validate
from docloom.operators import requests as request_operators
from docloom.operators import response as response_operators
from docloom.operators.extract import extract_fields, field_rows
from docloom.operators.labels import label_spans
from docloom.plans.kernels import sql_find_date, sql_find_phrase, sql_key
from docloom.plans.views import card_documents, requests, view, with_views
from docloom.sources import documents as sources
from docloom.sources.rules import FieldRule, builtin_rules, field_table, type_table

QUERIES: dict = {}
SQL: dict[str, str] = {}
AS_OF = datetime.date(2005, 1, 1)


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _texts() -> F.Column:
    return F.col("lines.text")


# ---------------------------------------------------------------- rules as tables

_TYPES = ", ".join(f"('{r.doc_type}', '{r.display_name}', {i}, {('NULL' if not r.family else repr(r.family))}, {str(r.ready).lower()}, '{r.version}', {len(r.fields)})" for i, r in enumerate(builtin_rules()))


# ---------------------------------------------------------------- classification

_ANCHORS = ", ".join(f"({i}, '{r.doc_type}', '{python_key(a)}')" for i, r in enumerate(builtin_rules()) for a in r.anchors)
_EXCLUDES = ", ".join(f"('{r.doc_type}', '{python_key(a)}')" for r in builtin_rules() for a in r.excludes)
_SCORED = (
    with_views("card_line")
    + f""", doc AS (SELECT doc_id, {sql_key("string_agg(text, ' ' ORDER BY line_no)")} AS k, bool_or(regexp_matches(regexp_replace(text, '[ .\\-]', '', 'g'), '[0-9]{{12,}}')) AS run FROM card_line GROUP BY doc_id),
anchor(rank, doc_type, a) AS (VALUES {_ANCHORS}), exclude(doc_type, e) AS (VALUES {_EXCLUDES}),
score AS (SELECT doc_id, rank, doc_type, count(*) AS score FROM doc JOIN anchor ON contains(k, a) WHERE NOT EXISTS (SELECT 1 FROM exclude WHERE exclude.doc_type = anchor.doc_type AND contains(k, e)) GROUP BY ALL)
"""
)


@query("classify_anchor_score", _SCORED + "SELECT doc_id, doc_type, score FROM score")
def classify_anchor_score(spark, sf_dir):
    """Anchors found in each document for each type that nothing excludes."""
    docs = card_documents(spark, sf_dir).select("doc_id", classify.document_key(_texts()).alias("key"))  # a column: each anchor looks into it
    scores = docs.select("doc_id", F.explode(classify.anchor_scores(F.col("key"), builtin_rules())).alias("s"))
    return scores.where("s.score > 0").select("doc_id", "s.doc_type", F.col("s.score").cast("long").alias("score"))


_CLASSIFIED = _SCORED + """, best AS (SELECT doc_id, doc_type, score FROM score QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, rank) = 1)
SELECT doc_id, CASE WHEN doc_type IS NULL THEN 'unknown' WHEN doc_type IN ('cmnd_9', 'cmnd_12') THEN CASE WHEN run THEN 'cmnd_12' ELSE 'cmnd_9' END ELSE doc_type END AS doc_type,
  CASE WHEN doc_type IS NULL THEN 0.0 WHEN doc_type IN ('cmnd_9', 'cmnd_12') THEN CASE WHEN run THEN 0.9 ELSE 0.7 END ELSE round(least(0.99, 0.6 + 0.2 * score), 4) END AS confidence FROM doc LEFT JOIN best USING (doc_id)"""


@query("classify_documents", _CLASSIFIED)
def classify_documents(spark, sf_dir):
    """A2, A3, P18, Q10, Q11, Q13."""
    docs = card_documents(spark, sf_dir).select("doc_id", classify.classify(_texts()).alias("c"))
    return docs.select("doc_id", "c.doc_type", F.round("c.confidence", 4).alias("confidence"))


_HINT = "CASE doc_id % 4 WHEN 0 THEN 'cmnd' WHEN 1 THEN 'cccd' WHEN 2 THEN 'gplx_pet' ELSE 'nonsense' END"


@query(
    "classify_with_hint",
    _SCORED
    + f""", best AS (SELECT doc_id, doc_type, score FROM score QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, rank) = 1),
cccd AS (SELECT doc_id, doc_type, score FROM score WHERE doc_type LIKE 'cccd%' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, rank) = 1)
SELECT doc_id, CASE {_HINT} WHEN 'cmnd' THEN CASE WHEN run THEN 'cmnd_12' ELSE 'cmnd_9' END WHEN 'cccd' THEN coalesce(cccd.doc_type, 'unknown') WHEN 'gplx_pet' THEN 'gplx_pet'
  ELSE CASE WHEN best.doc_type IN ('cmnd_9', 'cmnd_12') THEN CASE WHEN run THEN 'cmnd_12' ELSE 'cmnd_9' END ELSE coalesce(best.doc_type, 'unknown') END END AS doc_type
FROM doc LEFT JOIN best USING (doc_id) LEFT JOIN cccd USING (doc_id)""",
)
def classify_with_hint(spark, sf_dir):
    """Q12."""
    return card_documents(spark, sf_dir).select("doc_id", classify.classify(_texts(), F.expr(_HINT))["doc_type"].alias("doc_type"))


@query("label_lookup", _CLASSIFIED.replace("SELECT doc_id, CASE WHEN doc_type IS NULL", ", c AS (SELECT doc_id, CASE WHEN doc_type IS NULL", 1) + f") SELECT doc_id, coalesce(label, c.doc_type) AS label, coalesce(ready, false) AS ready FROM c LEFT JOIN (VALUES {_TYPES}) AS t(doc_type, label, rank, family, ready, version, n_fields) USING (doc_type)")
def label_lookup(spark, sf_dir):
    """The types' table is joined by broadcast; it has a row for each type."""
    docs = card_documents(spark, sf_dir).select("doc_id", classify.classify(_texts())["doc_type"].alias("doc_type"))
    types = type_table(spark, builtin_rules()).select("doc_type", "display_name", "ready")
    return docs.join(F.broadcast(types), "doc_type", "left").select("doc_id", F.coalesce("display_name", "doc_type").alias("label"), F.coalesce("ready", F.lit(False)).alias("ready"))


@query(
    "doc_types",
    _CLASSIFIED.replace("SELECT doc_id, CASE WHEN doc_type IS NULL", ", c AS (SELECT doc_id, CASE WHEN doc_type IS NULL", 1)
    + f") SELECT t.*, CAST(coalesce(n, 0) AS BIGINT) AS n_documents FROM (VALUES {_TYPES}) AS t(doc_type, label, rank, family, ready, version, n_fields) LEFT JOIN (SELECT doc_type, count(*) AS n FROM c GROUP BY 1) USING (doc_type)",
)
def doc_types(spark, sf_dir):
    """The registry in its order, with how many documents each type has."""
    rules = builtin_rules()
    fields = field_table(spark, rules).groupBy("doc_type").agg(F.count("*").alias("n_fields"))
    found = card_documents(spark, sf_dir).groupBy(classify.classify(_texts())["doc_type"].alias("doc_type")).agg(F.count("*").alias("n"))
    types = type_table(spark, rules).join(F.broadcast(fields), "doc_type").join(found, "doc_type", "left")
    return types.select("doc_type", F.col("display_name").alias("label"), "rank", "family", "ready", "version", "n_fields", F.coalesce("n", F.lit(0)).cast("long").alias("n_documents"))


@query(
    "known_hints",
    with_views("request") + "SELECT hint, CAST(coalesce(n, 0) AS BIGINT) AS n_requests FROM (VALUES " + ", ".join(f"('{h}')" for h in sorted({r.doc_type for r in builtin_rules()} | {"cmnd", "cccd"})) + ") AS t(hint) LEFT JOIN (SELECT hint, count(*) AS n FROM request GROUP BY hint) USING (hint)",
)
def known_hints(spark, sf_dir):
    """T5: what a hint may name, with how many requests name it."""
    named = view(spark, sf_dir, "request").where("hint IS NOT NULL").groupBy("hint").agg(F.count("*").alias("n"))
    hints = request_operators.known_hints(type_table(spark, builtin_rules())).join(named, "hint", "left")
    return hints.select("hint", F.coalesce("n", F.lit(0)).cast("long").alias("n_requests"))


# ---------------------------------------------------------------- codes

_PART = lambda i: f"nullif(nullif(trim(string_split(payload, '|')[{i + 1}]), ''), '-')"
_SLASH = lambda e: f"CASE WHEN regexp_full_match({e}, '[0-9]{{8}}') THEN substr({e}, 1, 2) || '/' || substr({e}, 3, 2) || '/' || substr({e}, 5, 4) ELSE {e} END"
_HEX = lambda e: f"CASE WHEN length({e}) % 2 = 0 AND regexp_full_match({e}, '[0-9a-fA-F]+') THEN try(decode(unhex({e}))) END"


def _long(pairs: list[tuple[str, str]], where: str = "true") -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{k}' AS field, {v} AS value FROM qr_payload WHERE {v} IS NOT NULL AND {where}" for k, v in pairs)


def _exploded(docs: DataFrame, parsed) -> DataFrame:
    return docs.select("doc_id", F.explode(parsed).alias("field", "value"))


_HEALTH = [
    ("idNumber", f"CASE WHEN regexp_full_match({_PART(0)}, '[0-9]{{10}}|[A-Z]{{2}}[0-9]{{13}}') THEN {_PART(0)} END"), ("fullName", f"coalesce({_HEX(_PART(1))}, {_PART(1)})"), ("dateOfBirth", _PART(2)), ("objectCode", _PART(5)), ("validFrom", _PART(6)),
    ("dateOfIssue", _PART(8)), ("fiveYearContinuous", _PART(12)), ("sex", f"CASE {_PART(3)} WHEN '1' THEN 'Nam' WHEN '2' THEN 'Nữ' END"), ("placeOfResidence", _HEX(_PART(4))), ("issuePlace", f"coalesce({_HEX(_PART(15))}, {_PART(15)})"),
]


@query("qr_health_card", with_views("qr_payload") + _long(_HEALTH))
def qr_health_card(spark, sf_dir):
    """R1, F28, F29."""
    return _exploded(view(spark, sf_dir, "qr_payload"), structured.health_card(F.col("payload")))


_CITIZEN = [
    ("idNumber", f"CASE WHEN regexp_full_match({_PART(0)}, '[0-9]{{12}}') THEN {_PART(0)} END"), ("oldIdNumber", f"CASE WHEN regexp_full_match({_PART(1)}, '[0-9]{{9,12}}') THEN {_PART(1)} END"), ("fullName", _PART(2)),
    ("dateOfBirth", _SLASH(_PART(3))), ("sex", _PART(4)), ("placeOfResidence", _PART(5)), ("dateOfIssue", _SLASH(_PART(6))),
]


@query("qr_citizen_card", with_views("qr_payload") + _long(_CITIZEN))
def qr_citizen_card(spark, sf_dir):
    """R2, F30."""
    return _exploded(view(spark, sf_dir, "qr_payload"), structured.citizen_card(F.col("payload")))


_EIGHT = lambda i: f"CASE WHEN regexp_full_match({_PART(i)}, '[0-9]{{8}}') THEN {_SLASH(_PART(i))} END"
_IS_PARTY = f"len(string_split(payload, '|')) >= 7 AND regexp_full_match({_PART(0)}, '[0-9]{{12}}|[0-9]{{2}}\\.[0-9]{{6}}') AND {_EIGHT(2)} IS NOT NULL AND {_EIGHT(3)} IS NOT NULL AND {_EIGHT(6)} IS NOT NULL"
_PARTY = [("cardNumber", _PART(0)), ("fullName", _PART(1)), ("dateOfBirth", _EIGHT(2)), ("partyJoinDate", _EIGHT(3)), ("officialDate", _EIGHT(4)), ("dateOfIssue", _EIGHT(6)), ("partyOrganization", _PART(5))]


@query("qr_party_card", with_views("qr_payload") + _long(_PARTY, _IS_PARTY))
def qr_party_card(spark, sf_dir):
    """R3."""
    return _exploded(view(spark, sf_dir, "qr_payload"), structured.party_card(F.col("payload")))


_HEALTH_OK = f"regexp_full_match({_PART(0)}, '[0-9]{{10}}|[A-Z]{{2}}[0-9]{{13}}')"


@query(
    "qr_identify",
    with_views("qr_payload") + f"SELECT doc_id, CASE WHEN {_HEALTH_OK} THEN 'bhyt' WHEN {_IS_PARTY} THEN 'the_dang_vien' END AS doc_type FROM qr_payload WHERE {_HEALTH_OK} OR ({_IS_PARTY})",
)
def qr_identify(spark, sf_dir):
    """Documents that their codes alone make up."""
    docs = view(spark, sf_dir, "qr_payload").select("doc_id", structured.identify(F.array("payload")).alias("s"))
    return docs.where("s is not null").select("doc_id", "s.doc_type")


@query("payload_union", "SELECT c_custkey, unnest(CASE WHEN c_custkey % 3 = 0 THEN [c_name, c_mktsegment] WHEN c_custkey % 3 = 1 THEN [c_mktsegment, c_name] ELSE [c_name] END) AS payload FROM customer")
def payload_union(spark, sf_dir):
    """Payloads of two images, each once, in order."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey") % 3
    one = F.when(k == 0, F.array("c_name", "c_mktsegment")).when(k == 1, F.array("c_mktsegment"))
    two = F.when(k == 0, F.array("c_mktsegment", "c_name", "c_name")).otherwise(F.array("c_name"))
    return c.select("c_custkey", F.explode(structured.union_payloads(one, two)).alias("payload"))


def _zones(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lines = view(spark, sf_dir, name)
    return lines.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda o: o["text"]).alias("texts"))


_SHOWN = "CASE WHEN CAST(substr(birth, 1, 2) AS INT) <= 30 THEN 2000 ELSE 1900 END + CAST(substr(birth, 1, 2) AS INT)"
_DAY = f"substr(birth, 5, 2) || '/' || substr(birth, 3, 2) || '/' || CAST({_SHOWN} AS VARCHAR)"
_END = "substr(expiry, 5, 2) || '/' || substr(expiry, 3, 2) || '/20' || substr(expiry, 1, 2)"


def _zone_long(pairs: list[tuple[str, str]], where: str = "true") -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{k}' AS field, {v} AS value FROM zone WHERE {where} AND {v} IS NOT NULL" for k, v in pairs)


@query(
    "mrz_td1",
    with_views("zone") + _zone_long([("documentNumber", "number"), ("idNumber", "lpad(CAST(doc_id AS VARCHAR), 12, '0')"), ("dateOfBirth", _DAY), ("sex", "CASE WHEN doc_id % 3 = 0 THEN 'Nam' ELSE 'Nữ' END"), ("dateOfExpiry", _END), ("nationality", "'Việt Nam'"), ("fullName", "replace(replace(name, '<<', ' '), '<', ' ')"), ("checked", "CASE WHEN doc_id % 7 = 0 THEN 'false' ELSE 'true' END")]),
)
def mrz_td1(spark, sf_dir):
    """Lower case and white space are forgiven."""
    rows = _zones(spark, sf_dir, "td1_line").select("doc_id", structured.mrz_lines(F.col("texts")).alias("z"))
    return _exploded(rows, F.map_concat(structured.td1(F.col("z")), F.create_map(F.lit("checked"), structured.td1_checks(F.col("z")).cast("string"))))


@query(
    "mrz_td3",
    with_views("zone") + _zone_long([("idNumber", "number"), ("dateOfBirth", _DAY), ("sex", "CASE WHEN doc_id % 3 = 0 THEN 'Nam' ELSE 'Nữ' END"), ("dateOfExpiry", _END), ("nationality", "'Việt Nam'"), ("personalIdNumber", "lpad(CAST(doc_id AS VARCHAR), 12, '0')"), ("checked", "CASE WHEN doc_id % 7 = 0 THEN 'false' ELSE 'true' END")], "doc_id % 11 <> 0"),
)
def mrz_td3(spark, sf_dir):
    """A single line is no zone."""
    rows = _zones(spark, sf_dir, "td3_line").select("doc_id", structured.mrz_lines(F.col("texts"), "td3").alias("z"))
    return _exploded(rows, F.map_concat(structured.td3(F.col("z")), F.create_map(F.lit("checked"), structured.td3_checks(F.col("z")).cast("string"))))


@query(
    "structured_read",
    with_views("zone", "qr_payload")
    + f""", qr AS ({_long([p for p in _CITIZEN if p[0] in ("idNumber", "fullName", "dateOfBirth", "sex", "placeOfResidence", "dateOfIssue")])}),
mrz AS ({_zone_long([("idNumber", "lpad(CAST(doc_id AS VARCHAR), 12, '0')"), ("dateOfExpiry", _END)], "doc_id % 7 <> 0")})
SELECT doc_id, field, value FROM qr WHERE doc_id IN (SELECT doc_id FROM zone) UNION ALL SELECT doc_id, field, value FROM mrz WHERE (doc_id, field) NOT IN (SELECT doc_id, field FROM qr)""",
)
def structured_read(spark, sf_dir):
    """Codes first, the zone fills gaps, and only if its digits are right."""
    zones = _zones(spark, sf_dir, "td1_line")
    rows = zones.join(view(spark, sf_dir, "qr_payload"), "doc_id", "left")
    found = structured.read(F.lit("cccd_2024_back"), F.when(F.col("payload").isNotNull(), F.array("payload")).otherwise(F.array().cast("array<string>")), F.col("texts"))
    return _exploded(rows, found["codes"])


# ---------------------------------------------------------------- lines around labels

_EVERY = ("Họ và tên", "Full name", "Ngày sinh", "Quê quán", "Giới tính", "Số")
_NAME_KEYS = ("hovaten", "fullname")
_TOKENS = f"list_transform(regexp_extract_all(text, '([^\\s/]+)'), lambda w: {sql_key('w')})"


def _span(key: str) -> str:
    """Tokens that make a label up, as SQL."""
    joined = "list_transform(range(1, len(ts) + 1), lambda i: array_to_string(ts[1:i], ''))"
    fit = f"a = '{key}'" + (f" OR starts_with(a, '{key}') OR levenshtein(a, '{key}') <= 1" if len(key) >= 5 else "")
    return f"list_position(list_transform({joined}, lambda a: {fit}), true)"


_LABELLED = with_views("card_line") + f", tok AS (SELECT *, {_TOKENS} AS ts FROM card_line)"


@query("label_match", _LABELLED + f" SELECT doc_id, line_no, CAST(coalesce({_span('hovaten')}, {_span('quequan')}, {_span('so')}, 0) AS BIGINT) AS span FROM tok")
def label_match(spark, sf_dir):
    """Tokens at a line's beginning that are a label, through an index of deletions."""
    return label_spans(card_documents(spark, sf_dir), ["Họ và tên", "Quê quán", "Số"])


def _label_cte(name: str, keys: tuple[str, ...]) -> str:
    spans = ", ".join(_span(k) for k in keys)
    return f", {name} AS (SELECT * FROM (SELECT *, coalesce({spans}, 0) AS span FROM tok) WHERE span > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no) = 1)"


_VIET = "length(regexp_replace(o.text, '[\\x00-\\x7F]|[^\\p{L}]', '', 'g')) > 0"
_RIGHT = "o.doc_id = l.doc_id AND o.line_no <> l.line_no AND abs((o.y + o.h / 2) - (l.y + l.h / 2)) <= 0.6 * greatest(o.h, l.h) AND o.x >= l.x + l.w - l.h"
_UNDER = "o.doc_id = l.doc_id AND o.line_no <> l.line_no AND o.y + o.h / 2 > l.y + l.h - 0.3 * l.h AND o.x < l.x + l.w AND o.x + o.w > l.x"


@query(
    "right_neighbor",
    _LABELLED + _label_cte("l", _NAME_KEYS) + f" SELECT l.doc_id, o.line_no, o.text FROM l JOIN card_line o ON {_RIGHT} QUALIFY row_number() OVER (PARTITION BY l.doc_id ORDER BY o.confidence < 0.6, NOT ({_VIET}), o.x, o.line_no) = 1",
)
def right_neighbor(spark, sf_dir):
    """J4, W2, P3, P5, P6, P10, W1."""
    return neighbours.right_neighbours(card_documents(spark, sf_dir), ["Họ và tên", "Full name"], vietnamese=True)


_ALL_KEYS = ("hovaten", "fullname", "ngaysinh", "quequan", "gioitinh", "so")
_IS_LABEL = "(" + " OR ".join(f"{_span(k)} IS NOT NULL" for k in _ALL_KEYS) + ")"


@query(
    "below_value",
    _LABELLED
    + _label_cte("l", ("hovaten",))
    + f""", near AS (SELECT l.doc_id, l.y AS ly, l.h AS lh, o.* EXCLUDE (doc_id) FROM l JOIN tok o ON {_UNDER} QUALIFY row_number() OVER (PARTITION BY l.doc_id ORDER BY o.y, o.line_no) = 1)
SELECT doc_id, line_no, text FROM near WHERE NOT {_IS_LABEL} AND y - (ly + lh) <= 1.4 * lh""",
)
def below_value(spark, sf_dir):
    """Only the nearest line counts."""
    return neighbours.lines_below(card_documents(spark, sf_dir), ["Họ và tên"], _EVERY)


@query(
    "date_after_label",
    _LABELLED
    + _label_cte("l", ("ngaysinh",))
    + f""", r AS (SELECT l.doc_id, o.text FROM l JOIN card_line o ON {_RIGHT} WHERE {sql_find_date("o.text")} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY l.doc_id ORDER BY o.x, o.line_no) = 1),
u AS (SELECT l.doc_id, o.text, row_number() OVER (PARTITION BY l.doc_id ORDER BY o.y, o.line_no) AS k FROM l JOIN card_line o ON {_UNDER}),
b AS (SELECT doc_id, text FROM u WHERE k <= 3 AND {sql_find_date("text")} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k) = 1)
SELECT dd.doc_id, coalesce(CASE WHEN {sql_find_date("l.text")} IS NOT NULL THEN {sql_find_date("l.text")} END, {sql_find_date("r.text")}, {sql_find_date("b.text")}) AS iso FROM (SELECT DISTINCT doc_id FROM card_line) dd LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN b USING (doc_id)""",
)
def date_after_label(spark, sf_dir):
    """On the label's line, else to its right, else among three lines under it."""
    return neighbours.dates_after(card_documents(spark, sf_dir), ["Ngày sinh"])


_ORPHAN = f"{sql_find_date('o.text')} IS NULL AND {_VIET} AND len(list_filter(regexp_split_to_array(o.text, '\\s+'), lambda w: w <> '')) >= 2 AND NOT {_IS_LABEL}"


@query(
    "orphan_place",
    _LABELLED + f", d AS (SELECT doc_id, max(y) AS last FROM card_line WHERE {sql_find_date('text')} IS NOT NULL GROUP BY doc_id) SELECT o.doc_id, o.text FROM tok o JOIN d ON d.doc_id = o.doc_id AND o.y > last WHERE {_ORPHAN} QUALIFY row_number() OVER (PARTITION BY o.doc_id ORDER BY o.y, o.line_no) = 1",
)
def orphan_place(spark, sf_dir):
    """The first words under the last date."""
    return neighbours.places_after_dates(card_documents(spark, sf_dir), _EVERY)


@query(
    "orphan_name",
    _LABELLED + f", d AS (SELECT doc_id, min(y) AS first FROM card_line WHERE {sql_find_date('text')} IS NOT NULL GROUP BY doc_id) SELECT o.doc_id, o.text FROM tok o JOIN d ON d.doc_id = o.doc_id AND o.y < first WHERE {_ORPHAN} AND NOT ends_with({sql_key('o.text')}, 'dangvien') QUALIFY row_number() OVER (PARTITION BY o.doc_id ORDER BY o.y DESC, o.line_no DESC) = 1",
)
def orphan_name(spark, sf_dir):
    """The last words over the first date."""
    return neighbours.names_before_dates(card_documents(spark, sf_dir), _EVERY)


@query(
    "take_phrases",
    with_views("card_line")
    + f""", p AS (SELECT doc_id, line_no, text FROM card_line WHERE {sql_find_phrase("text")} IS NOT NULL), i AS (SELECT doc_id, line_no, text FROM card_line WHERE contains({sql_key("text")}, 'ngaycap') AND {sql_find_date("text")} IS NOT NULL)
SELECT d.doc_id, (SELECT arg_min(text, line_no) FROM p WHERE p.doc_id = d.doc_id) AS phrase, (SELECT arg_min(text, line_no) FROM p WHERE p.doc_id = d.doc_id AND contains({sql_key("text")}, 'noigia')) AS labelled,
  coalesce((SELECT arg_min(text, line_no) FROM p WHERE p.doc_id = d.doc_id), (SELECT arg_min(text, line_no) FROM i WHERE i.doc_id = d.doc_id)) AS issued FROM (SELECT DISTINCT doc_id FROM card_line) d""",
)
def take_phrases(spark, sf_dir):
    """V1-V3."""
    rules = {"phrase": FieldRule("f", (), "vn_date_phrase"), "labelled": FieldRule("f", ("Nơi giả",), "vn_date_phrase_labeled"), "issued": FieldRule("f", (), "date_phrase_or_issue")}
    return spatial.values(card_documents(spark, sf_dir), rules)


_AFTER = "nullif(trim(substr(l.text, instr(l.text, ':') + 1)), '')"


@query(
    "take_label_values",
    _LABELLED
    + _label_cte("l", ("so", "no"))
    + f""", r AS (SELECT l.doc_id, o.text FROM l JOIN card_line o ON {_RIGHT} QUALIFY row_number() OVER (PARTITION BY l.doc_id ORDER BY o.confidence < 0.6, o.x, o.line_no) = 1), d AS (SELECT DISTINCT doc_id FROM card_line)
SELECT d.doc_id, CASE WHEN contains(l.text, ':') THEN {_AFTER} END AS after_colon, nullif(regexp_extract(l.text, '(\\d)\\s*$', 1), '') AS last_digit, coalesce(CASE WHEN contains(l.text, ':') THEN {_AFTER} END, r.text) AS right_value
FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)""",
)
def take_label_values(spark, sf_dir):
    """V6, V7, V10."""
    rules = {"after_colon": FieldRule("f", ("Số", "No"), "after_colon"), "last_digit": FieldRule("f", ("Số", "No"), "trailing_digit"), "right_value": FieldRule("f", ("Số", "No"), "right_of_label", type="digits")}
    return spatial.values(card_documents(spark, sf_dir), rules)


@query(
    "take_colon_or_below",
    _LABELLED
    + _label_cte("l", ("quequan",))
    + f""", edge AS (SELECT doc_id, max(x + w) AS edge FROM card_line GROUP BY doc_id), narrow AS (SELECT l.doc_id, l.y AS ly, l.h AS lh, o.* EXCLUDE (doc_id) FROM l JOIN tok o ON {_UNDER} QUALIFY row_number() OVER (PARTITION BY l.doc_id ORDER BY o.y, o.line_no) = 1),
wide AS (SELECT l.doc_id, l.y AS ly, l.h AS lh, o.* EXCLUDE (doc_id) FROM l JOIN edge e ON e.doc_id = l.doc_id JOIN tok o ON {_UNDER.replace("o.x < l.x + l.w", "o.x < e.edge")} QUALIFY row_number() OVER (PARTITION BY l.doc_id ORDER BY o.y, o.line_no) = 1),
n AS (SELECT doc_id, text FROM narrow WHERE NOT {_IS_LABEL} AND y - (ly + lh) <= 1.4 * lh), v AS (SELECT doc_id, text FROM wide WHERE NOT {_IS_LABEL} AND y - (ly + lh) <= 1.4 * lh)
SELECT l.doc_id, coalesce(n.text, v.text) AS value FROM l LEFT JOIN n USING (doc_id) LEFT JOIN v USING (doc_id) WHERE coalesce(n.text, v.text) IS NOT NULL""",
)
def take_colon_or_below(spark, sf_dir):
    """The label's column first, then all to its right."""
    return spatial.values(card_documents(spark, sf_dir), {"value": FieldRule("f", ("Quê quán",), "after_colon_or_below")}, _EVERY).where("value is not null")


@query(
    "regex_fallback",
    with_views("card_line")
    + """, c AS (SELECT doc_id, line_no, 0 AS k, regexp_replace(translate(text, 'OoIl|BSZ', '00111852'), '\\D', '', 'g') AS v FROM card_line
  UNION ALL SELECT doc_id, line_no, k, regexp_replace(translate(ws[k], 'OoIl|BSZ', '00111852'), '\\D', '', 'g') FROM (SELECT doc_id, line_no, ws, unnest(range(1, len(ws) + 1)) AS k FROM (SELECT doc_id, line_no, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM card_line)))
SELECT doc_id, v AS value FROM c WHERE regexp_full_match(v, '\\d{12}') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no, k) = 1""",
)
def regex_fallback(spark, sf_dir):
    """Whole lines before their words, in the order of lines."""
    rule = FieldRule("f", (), regex=r"^\d{12}$", type="digits", normalize=("fixDigits", "digitsOnly"))
    return spatial.by_pattern(card_documents(spark, sf_dir), rule)


@query("merged_text", with_views("card_line") + "SELECT doc_id, string_agg(text, ' ' ORDER BY y, line_no) AS merged, count(*) AS n_lines, max(x + w) AS right_edge FROM card_line GROUP BY doc_id")
def merged_text(spark, sf_dir):
    """Lines joined from top to bottom."""
    docs = card_documents(spark, sf_dir)
    by_y = F.array_sort(F.transform("lines", lambda o: F.struct(o["y"].alias("y"), o["line_no"].alias("n"), o["text"].alias("text"))))
    return docs.select("doc_id", F.array_join(F.transform(by_y, lambda o: o["text"]), " ").alias("merged"), F.size("lines").cast("long").alias("n_lines"), F.array_max(F.transform("lines", lambda o: o["x"] + o["w"])).alias("right_edge"))


# ---------------------------------------------------------------- the whole document


@query("extract_documents")
def extract_documents(spark, sf_dir):
    """The fold over all fields. A state that consumes lines is beyond SQL; tests have cases made by hand."""
    docs = card_documents(spark, sf_dir).withColumn("doc_type", classify.classify(_texts())["doc_type"]).withColumn("codes", F.create_map().cast("map<string,string>"))
    return field_rows(extract_fields(docs, as_of=AS_OF))


@query("respond")
def respond(spark, sf_dir):
    """One JSON response for each document, from its lines, codes, hint and quality."""
    return response_operators.to_json(response_operators.process(requests(spark, sf_dir), as_of=AS_OF))


_CODES = {"bhyt_qr": (dict(_HEALTH), "true"), "cccd_qr": (dict(_CITIZEN), "true"), "dang_vien_qr": (dict(_PARTY), _IS_PARTY)}


def _filled(names: list[str], parser: str) -> str:
    """How many of a parser's named fields a payload has, as SQL."""
    fields, fits = _CODES[parser]
    return f"CASE WHEN {fits} THEN " + (" + ".join(f"CASE WHEN {fields[n]} <> '' THEN 1 ELSE 0 END" for n in names if n in fields) or "0") + " ELSE 0 END"


_BY_TYPE = [(r.doc_type, c.parser, list(c.maps_to), [f.name for f in r.fields if "structured" in f.source and f.name in c.maps_to]) for r in builtin_rules() for c in r.structured if c.kind == "qr"]
_USED = "CASE doc_type " + " ".join(f"WHEN '{t}' THEN {_filled(names, p)}" for t, p, names, _ in _BY_TYPE) + " ELSE 0 END"
_TAKEN = "CASE doc_type " + " ".join(f"WHEN '{t}' THEN {_filled(names, p)}" for t, p, _, names in _BY_TYPE) + " ELSE 0 END"
_SURE = "round(least(0.99, 0.6 + 0.2 * {0}.score), 4)"


@query(
    "respond_codes",
    _SCORED.replace("WITH ", with_views("request").rstrip() + ", ", 1)
    + f""", top AS (SELECT doc_id, doc_type, score FROM score QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, rank) = 1),
new AS (SELECT doc_id, doc_type, score FROM score WHERE doc_type LIKE 'cccd%' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, rank) = 1),
r AS (SELECT doc.doc_id, payload, hint, quality_ok, run, coalesce({_HEALTH_OK}, false) AS health, coalesce({_IS_PARTY}, false) AS party, top.doc_type AS top_type, CASE WHEN top.score IS NULL THEN 0.0 ELSE {_SURE.format("top")} END AS top_sure,
  new.doc_type AS new_type, CASE WHEN new.score IS NULL THEN 0.0 ELSE {_SURE.format("new")} END AS new_sure FROM doc JOIN request USING (doc_id) LEFT JOIN top USING (doc_id) LEFT JOIN new USING (doc_id)),
c AS (SELECT doc_id, payload, quality_ok, health OR party AS alone, CASE WHEN NOT quality_ok THEN 'unknown' WHEN health THEN 'bhyt' WHEN party THEN 'the_dang_vien' WHEN hint = 'cmnd' OR (hint IS DISTINCT FROM 'cccd' AND hint NOT IN ('gplx_pet', 'cccd_chip_front') AND top_type IN ('cmnd_9', 'cmnd_12')) OR (hint IS NULL AND top_type IN ('cmnd_9', 'cmnd_12')) THEN CASE WHEN run THEN 'cmnd_12' ELSE 'cmnd_9' END
    WHEN hint = 'cccd' THEN coalesce(new_type, 'unknown') WHEN hint IN ('gplx_pet', 'cccd_chip_front') THEN hint ELSE coalesce(top_type, 'unknown') END AS doc_type,
  CASE WHEN NOT quality_ok THEN 0.0 WHEN health OR party THEN 0.99 WHEN hint = 'cmnd' THEN CASE WHEN run THEN 0.9 ELSE 0.7 END WHEN hint = 'cccd' THEN new_sure WHEN hint IN ('gplx_pet', 'cccd_chip_front') THEN 0.95 WHEN top_type IN ('cmnd_9', 'cmnd_12') THEN CASE WHEN run THEN 0.9 ELSE 0.7 END ELSE top_sure END AS confidence FROM r)
SELECT doc_id, doc_type, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN alone OR {_USED} > 0 THEN 'qr' ELSE '' END AS used, CAST({_TAKEN} AS BIGINT) AS n_from_codes, quality_ok AND doc_type = 'unknown' AS unrecognised, CASE WHEN quality_ok THEN '' ELSE 'anh_qua_kem' END AS errors FROM c""",
)
def respond_codes(spark, sf_dir):
    """The class, the codes used and the warnings of the same responses."""
    out = response_operators.process(requests(spark, sf_dir), as_of=AS_OF)
    from_codes = F.filter("fields", lambda f: f["source"].isin("structured", "derived") & f["value"].isNotNull())  # derived: a number that the code gives decides on the sex that it gives
    taken = F.when(F.size("structured_used") > 0, F.size(from_codes)).otherwise(0).cast("long")
    unrecognised = F.array_contains("warnings", "khong_nhan_dang_duoc_loai")
    return out.select("doc_id", "doc_type", F.col("classification_confidence").alias("confidence"), F.array_join("structured_used", ",").alias("used"), taken.alias("n_from_codes"), unrecognised.alias("unrecognised"), F.array_join("errors", ",").alias("errors"))


@query("non_blank_lines", with_views("card_line") + "SELECT doc_id, count(*) AS n FROM card_line WHERE trim(text) <> '' GROUP BY doc_id")
def non_blank_lines(spark, sf_dir):
    """P20, S8."""
    lines = sources.exploded(card_documents(spark, sf_dir))
    return sources.non_blank(lines).groupBy("doc_id").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- orientation

_WIDE = "CASE WHEN w >= h THEN 1 ELSE 0 END"


@query(
    "orientation_scores",
    with_views("card_line")
    + f"""SELECT doc_id, round(sum(confidence * CASE WHEN w >= h THEN 1 ELSE 0.25 END), 6) AS score, count(*) >= 3 AND avg({_WIDE}) >= 0.6 AS upright, count(*) >= 6 AND avg(confidence) >= 0.7 AS good, sum({_WIDE}) >= count(*) - sum({_WIDE}) AS rather_wide
FROM (SELECT doc_id, line_no, confidence, CASE WHEN (doc_id + line_no) % 3 = 0 THEN h ELSE w END AS w, CASE WHEN (doc_id + line_no) % 3 = 0 THEN w ELSE h END AS h FROM card_line) GROUP BY doc_id""",
)
def orientation_scores(spark, sf_dir):
    """A5-A7."""
    turned = F.transform("lines", lambda o: F.struct(F.when((F.col("doc_id") + o["line_no"]) % 3 == 0, o["h"]).otherwise(o["w"]).alias("w"), F.when((F.col("doc_id") + o["line_no"]) % 3 == 0, o["w"]).otherwise(o["h"]).alias("h"), o["confidence"].alias("confidence")))
    docs = card_documents(spark, sf_dir).select("doc_id", turned.alias("t"))
    t = F.col("t")
    return docs.select("doc_id", F.round(orientation.score(t), 6).alias("score"), orientation.looks_upright(t).alias("upright"), orientation.good_enough(t).alias("good"), (F.get(orientation.angle_order(t), 0) == 180).alias("rather_wide"))


@query(
    "orientation_search",
    with_views("card_line")
    + """, s AS (SELECT doc_id, CAST(count(*) AS DOUBLE) AS n, avg(confidence) AS mean, sum(confidence) AS total FROM card_line GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND n >= 6 AND mean >= 0.7 THEN 180 WHEN doc_id % 2 = 0 THEN 180 ELSE 0 END AS angle FROM s""",
)
def orientation_search(spark, sf_dir):
    """Tries in order; the first good one ends the search, else the best score wins."""
    lines = F.col("lines")
    poor = F.transform(F.slice(lines, 1, 3), lambda o: F.struct(o["line_no"].alias("line_no"), o["text"].alias("text"), o["x"].alias("x"), o["y"].alias("y"), o["h"].alias("w"), o["w"].alias("h"), F.lit(0.2).alias("confidence")))
    tries = F.array(F.struct(F.lit(0).alias("angle"), F.when(F.col("doc_id") % 2 == 0, poor).otherwise(lines).alias("lines")), F.struct(F.lit(180).alias("angle"), F.when(F.col("doc_id") % 2 == 0, lines).otherwise(poor).alias("lines")))
    return card_documents(spark, sf_dir).select("doc_id", orientation.best_angle(tries).alias("angle"))


# ---------------------------------------------------------------- long fields: codes over lines, checks, confidence

_FIELDS = "SELECT l_orderkey AS doc_id, 'f' || CAST(l_linenumber AS STRING) AS field, {day} AS value, (CAST(l_quantity AS INT) % 101) / 100.0 AS confidence FROM lineitem"
_OCR = _FIELDS.format(day="CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END")


def _ocr_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_OCR.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet")).withColumn("confidence", F.col("confidence").cast("double"))


@query(
    "structured_coalesce",
    f"""WITH o AS ({_OCR}), s AS (SELECT o_orderkey AS doc_id, 'f' || CAST(o_orderkey % 9 AS VARCHAR) AS field, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS value FROM orders)
SELECT doc_id, field, coalesce(s.value, o.value) AS value, CASE WHEN s.value IS NOT NULL THEN 0.97 ELSE CAST(confidence AS DOUBLE) END AS confidence, CASE WHEN s.value IS NOT NULL THEN 'structured' ELSE 'ocr' END AS source FROM o FULL JOIN s USING (doc_id, field)""",
)
def structured_coalesce(spark, sf_dir):
    """A code without a value leaves what was read."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    codes = o.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("f"), (F.col("o_orderkey") % 9).cast("string")).alias("field"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("value"))
    return validate.structured_or_ocr(codes, _ocr_fields(spark, sf_dir))


@query(
    "cross_field_checks",
    f"""WITH o AS ({_OCR}), w AS (SELECT doc_id, max(CASE WHEN field = 'f1' THEN CAST(value AS DATE) END) AS a, max(CASE WHEN field = 'f2' THEN CAST(value AS DATE) END) AS b, max(CASE WHEN field = 'f3' THEN CAST(value AS DATE) END) AS c FROM o GROUP BY doc_id)
SELECT doc_id, 'thu_tu_ngay_sai:f1<f2' AS warning FROM w WHERE NOT a < b UNION ALL SELECT doc_id, 'thu_tu_ngay_sai:f2<=f3' FROM w WHERE NOT b <= c UNION ALL SELECT doc_id, 'thu_tu_ngay_sai:f3>=f1' FROM w WHERE NOT c >= a""",
)
def cross_field_checks(spark, sf_dir):
    """Grouped once by document, however many checks there are."""
    return validate.cross_checks(_ocr_fields(spark, sf_dir), [("f1", "<", "f2"), ("f2", "<=", "f3"), ("f3", ">=", "f1")])


@query(
    "derive_sex",
    with_views("card")
    + """SELECT doc_id, coalesce(rule, sex) AS value, CASE WHEN rule IS NULL THEN 0.5 WHEN rule = sex THEN 0.97 ELSE 0.9 END AS confidence, CASE WHEN rule IS NULL OR rule = sex THEN 'ocr' ELSE 'derived' END AS source,
  CASE WHEN rule <> sex THEN nullif(sex, '') END AS raw FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Nam' WHEN 1 THEN 'Nữ' ELSE '' END AS sex, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN CAST(substr(id12, 4, 1) AS INT) % 2 = 0 THEN 'Nam' ELSE 'Nữ' END AS rule FROM card)""",
)
def derive_sex(spark, sf_dir):
    """J11, Q21, Q22."""
    sex = F.expr("CASE doc_id % 3 WHEN 0 THEN 'Nam' WHEN 1 THEN 'Nữ' ELSE '' END")
    number = F.when(F.col("doc_id") % 5 != 0, F.col("id12"))
    found = view(spark, sf_dir, "card").select("doc_id", validate.derive_sex(sex, F.lit(0.5), number).alias("s"))
    return found.select("doc_id", "s.value", "s.confidence", "s.source", "s.raw")


@query("compose_name", "SELECT c_custkey, nullif(concat_ws(' ', CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_name END), '') AS name FROM customer")
def compose_name(spark, sf_dir):
    """What is null or empty is left out."""
    c, k = spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("c_custkey")
    return c.select("c_custkey", validate.compose(F.when(k % 3 != 0, F.col("c_mktsegment")).otherwise(""), F.when(k % 6 != 0, F.col("c_name"))).alias("name"))


_WEIGHT = "CASE field WHEN 'f1' THEN 0.3 WHEN 'f2' THEN 0.25 WHEN 'f3' THEN 0.2 ELSE 0.1 END"


@query(
    "overall_confidence",
    f"""WITH o AS (SELECT doc_id, CAST(round(100 * {_WEIGHT}) AS BIGINT) AS w, CAST(round(100 * confidence) AS BIGINT) AS c FROM ({_OCR})), s AS (SELECT doc_id, CAST(sum(w * c) AS BIGINT) AS a, CAST(sum(w) AS BIGINT) AS b FROM o GROUP BY doc_id)
SELECT doc_id, CAST((200 * a + b) // (2 * b) AS DOUBLE) / 10000 AS overall FROM s""",
)
def overall_confidence(spark, sf_dir):
    """A4, Q23. Sums are of decimals: the same in whatever order tasks end."""
    weights = spark.createDataFrame([("f1", 0.3), ("f2", 0.25), ("f3", 0.2)], "field string, weight double")
    return validate.overall_confidence_long(_ocr_fields(spark, sf_dir), weights)


@query(
    "golden_compare",
    f"""WITH o AS ({_OCR}), g AS (SELECT doc_id, CASE field WHEN 'f7' THEN 'f8' ELSE field END AS field, CASE WHEN doc_id % 4 = 0 THEN 'other' ELSE value END AS expected FROM o)
SELECT field, count(*) AS n, CAST(sum(CASE WHEN value IS NOT DISTINCT FROM expected THEN 1 ELSE 0 END) AS BIGINT) AS same, count(value) AS found FROM g FULL JOIN o USING (doc_id, field) GROUP BY field""",
)
def golden_compare(spark, sf_dir):
    """Expected fields against those found, field by field, those on one side only included."""
    found = _ocr_fields(spark, sf_dir)
    name = F.when(F.col("field") == "f7", "f8").otherwise(F.col("field"))
    golden = found.select("doc_id", name.alias("field"), F.when(F.col("doc_id") % 4 == 0, "other").otherwise(F.col("value")).alias("expected"))
    return evaluate.field_scores(evaluate.compared(golden.withColumnRenamed("expected", "value"), found))

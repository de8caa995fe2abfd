"""Operator shapes over the driver's own tables: windows of time, argmax, weighted means, anti-joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import evaluate
from docloom.plans.views import card_documents, view, with_views
from docloom.streaming import intake

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def put(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return put


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("event_windows", "SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """2.11: throughput in tumbling windows."""
    return intake.window_counts(_t(spark, sf_dir, "events")).withColumn("total", F.round("total", 6))


@query(
    "event_sessions",
    """SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s
  FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""",
)
def event_sessions(spark, sf_dir):
    """2.11: sessions."""
    return intake.sessions(_t(spark, sf_dir, "events"))


@query("stage_means", "SELECT event_type AS stage, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def stage_means(spark, sf_dir):
    """A14."""
    return evaluate.stage_means(_t(spark, sf_dir, "events"), "event_type").withColumn("mean", F.round("mean", 6))


@query("accuracy", "SELECT o_orderpriority AS variant, avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n FROM orders GROUP BY 1")
def accuracy(spark, sf_dir):
    """A16."""
    orders = _t(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "variant")
    return evaluate.accuracy(orders, F.col("o_orderstatus") == "O", "variant")


@query("label_margin", "SELECT l_orderkey, max(l_quantity) AS best, max(l_quantity) / nth AS ratio FROM (SELECT l_orderkey, l_quantity, nth_value(l_quantity, 2) OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS nth FROM lineitem) GROUP BY l_orderkey, nth HAVING max(l_quantity) / nth >= 1.2")
def label_margin(spark, sf_dir):
    """Documents whose best score is clearly above the second; only the first two of each group leave the window."""
    return evaluate.clear_winners(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", "l_linenumber")


@query("best_type", "SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS best FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1) GROUP BY o_custkey")
def best_type(spark, sf_dir):
    """A2: argmax without a window: the greater wins, of equal ones the first."""
    o = _t(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best"))


@query(
    "unused_lines",
    with_views("card_line") + "SELECT doc_id, line_no FROM card_line WHERE (doc_id, line_no) NOT IN (SELECT doc_id, min(line_no) FROM card_line GROUP BY doc_id UNION ALL SELECT doc_id, line_no FROM card_line WHERE contains(text, ':'))",
)
def unused_lines(spark, sf_dir):
    """The lines that no field has taken; here titles and lines with a colon are taken."""
    lines = view(spark, sf_dir, "card_line")
    docs = card_documents(spark, sf_dir)
    titles = docs.select("doc_id", F.array_min(F.col("lines.line_no")).alias("line_no"))
    return evaluate.unused(lines, titles.unionByName(lines.where("contains(text, ':')").select("doc_id", "line_no"))).select("doc_id", "line_no")


_LOGITS = "list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE) * 40)"


@query(
    "softmax_argmax",
    f"""WITH l AS (SELECT vec_id, {_LOGITS} AS z FROM embeddings), e AS (SELECT vec_id, z, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM l)
SELECT vec_id, (list_position(z, list_max(z)) - 1) * 90 AS angle, round(list_max(e) / list_sum(e), 9) AS confidence, round(e[1] / list_sum(e), 9) AS first FROM e""",
)
def softmax_argmax(spark, sf_dir):
    """four logits of each vector as a classifier of angles."""
    logits = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double") * 40)
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", logits.alias("z"))
    named = evaluate.classified(F.col("z"), (0, 90, 180, 270))
    return rows.select("vec_id", named.alias("c"), F.get(evaluate.softmax(F.col("z")), 0).alias("s")).select("vec_id", F.col("c.label").cast("long").alias("angle"), F.round("c.confidence", 9).alias("confidence"), F.round("s", 9).alias("first"))

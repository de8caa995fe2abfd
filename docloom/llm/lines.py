"""Line dedup by site-relative frequency, in DataFrame functions only.

A line that stands on more than a given share of a site's pages is boilerplate and is dropped from
all of that site's pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import actual, quoted, save, without

#: White space that a line is trimmed of before it is compared.
WHITE = " \t\r\x0b\x0c"

#: A flagged table of up to this many lines (32 bytes each, and its hosts' names) is broadcast; a larger one is joined by host.
BROADCAST_LINES = 100_000
#: In that join a host's pages are dealt to so many partitions.
SALTS = 32


def _key(line: Column) -> Column:
    """128 bits of the trimmed line: only these are shuffled, never the lines."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(1)).alias("b"))


def _spelled(key: Column) -> Column:
    """A key as a string, which sets of Spark's array functions can hash."""
    return F.concat(F.hex(key["a"]), F.lit("-"), F.hex(key["b"]))


def _host(name: str) -> Column:
    return F.coalesce(quoted(name).cast("string"), F.lit(""))


def boilerplate_lines(docs: DataFrame, ratio: float, min_pages: int = 1, fold_copies: bool = False, host: str = "source", text: str = "text") -> DataFrame:
    """(host, key, pages, total): the lines on more than `ratio` of their host's pages, and on `min_pages` at least.

    Every row with a text is a page; a line counts once for a page, however often it stands there.
    With fold_copies, pages of a host with the same text are one page. A null host is the host ''.
    Rows are (host, line) hashes, added up on the map side before they are shuffled by both, so no
    host and no line lands in one task.
    """
    pages = docs.select(_host(host).alias("host"), quoted(text).alias("t")).where("t is not null")
    lines = F.array_distinct(F.transform(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(WHITE))))
    keys = F.transform(F.filter(lines, lambda x: x != ""), _key)
    page = F.struct(F.xxhash64("t").alias("a"), F.xxhash64("t", F.lit(1)).alias("b")).alias("page")
    size = F.count_distinct("page") if fold_copies else F.count("*")
    counted = pages.select("host", page, F.explode(keys).alias("key")).groupBy("host", "key").agg(size.alias("pages"))
    totals = pages.select("host", page).groupBy("host").agg(size.alias("total"))
    often = counted.where(F.col("pages") >= min_pages).join(totals, "host")
    return often.where(F.col("pages") > F.lit(ratio) * F.col("total")).select("host", "key", "pages", "total")


def drop_boilerplate(docs: DataFrame, ratio: float = 0.1, min_pages: int = 1, fold_copies: bool = False, host: str = "source", text: str = "text") -> DataFrame:
    """docs with `text` rid of its host's boilerplate lines, and two more columns: n_lines and n_dropped.

    Null texts stay null with 0 lines; blank lines are never dropped; a text of nothing but
    boilerplate becomes ''. A line at exactly the ratio stays. All rows and all other columns stay,
    repeated rows too (each is a page); an empty table gives no rows. Columns named n_lines and
    n_dropped, in any case, are replaced. With min_pages = 1 and few pages every line exceeds the
    ratio: the page of a host of one loses its whole text; min_pages = 2 asks that a line repeats.

    A host has fewer flagged lines than its pages have lines on average, divided by `ratio`; so its
    lines fit into a row, whatever the number of its pages.
    """
    flagged = save(boilerplate_lines(docs, ratio, min_pages, fold_copies, host, text), "flagged")
    few = flagged.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    by_host = save(flagged.groupBy("host").agg(F.collect_list(_spelled(F.col("key"))).alias("bad")), "by_host")
    others = without(docs, text, "n_lines", "n_dropped")
    rest = F.struct(F.lit(0).alias("_"), *(quoted(c) for c in others)).alias("rest")
    rows = docs.select(rest, _host(host).alias("host"), quoted(text).alias("t"), F.pmod(F.xxhash64(quoted(text)), F.lit(SALTS)).alias("salt"))
    if few:
        joined = rows.join(F.broadcast(by_host), "host", "left")
    else:
        salted = by_host.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = rows.join(salted.hint("merge"), ["host", "salt"], "left")
    split = joined.withColumn("lines", F.split("t", "\n"))
    keyed = split.withColumn("keys", F.when(F.col("bad").isNotNull(), F.transform("lines", lambda x: _spelled(_key(F.btrim(x, F.lit(WHITE)))))))
    hit = keyed.withColumn("hits", F.array_intersect("keys", "bad"))  # hashed sets: a host's lines are gone through once for a page, not once for a line
    left = F.transform(F.filter(F.arrays_zip("lines", "keys"), lambda z: ~F.array_contains(F.col("hits"), z["keys"])), lambda z: z["lines"])
    done = hit.withColumn("kept", F.when(F.size("hits") > 0, left).otherwise(F.col("lines")))
    n_lines = F.when(F.col("t").isNull(), F.lit(0)).otherwise(F.size("lines"))
    n_kept = F.when(F.col("t").isNull(), F.lit(0)).otherwise(F.size("kept"))
    by_name = {c: F.col("rest").getField(c).alias(c) for c in others} | {actual(docs, text): F.array_join("kept", "\n").alias(actual(docs, text))}
    return done.select(*(by_name[c] for c in docs.columns if c in by_name), n_lines.cast("long").alias("n_lines"), (n_lines - n_kept).cast("long").alias("n_dropped"))


def oracle(ratio: float = 0.1, min_pages: int = 2, docs: str = "documents") -> str:
    """The same rows as DuckDB SQL: doc_id, text, n_lines, n_dropped."""
    trimmed = "trim({}, ' ' || chr(9) || chr(11) || chr(12) || chr(13))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, text, string_split(text, chr(10)) AS ls FROM {docs}),
t AS (SELECT host, count(text) AS total FROM d GROUP BY host),
u AS (SELECT host, unnest(list_distinct(list_transform(ls, lambda x: {trimmed.format("x")}))) AS line FROM d),
l AS (SELECT host, line, count(*) AS pages FROM u GROUP BY host, line),
bad AS (SELECT l.host, list(line) AS lines FROM l JOIN t USING (host)
  WHERE line <> '' AND pages >= {min_pages} AND pages > {ratio} * total GROUP BY l.host),
k AS (SELECT doc_id, ls, CASE WHEN lines IS NULL THEN ls
  ELSE list_filter(ls, lambda x: NOT list_contains(lines, {trimmed.format("x")})) END AS kept FROM d LEFT JOIN bad USING (host))
SELECT doc_id, CASE WHEN ls IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text,
  coalesce(len(ls), 0) AS n_lines, coalesce(len(ls) - len(kept), 0) AS n_dropped FROM k"""

"""Embedding near-duplicates by an exact metric range join.

Vectors are scaled to length 1, where cosine >= t is Euclidean distance <= r = sqrt(2 - 2 t). Pivots
partition them: a vector's home is its nearest pivot's cell. If x of cell p is linked with y of cell
q, the triangle inequality gives d(x, q) <= d(y, q) + r <= R_q + r, with R_q the cell's radius, and
d(x, q) <= d(x, p) + 2 r. Only vectors that pass both are a boundary of p towards q; only the two
boundaries are replicated, and each pair of cells joins independently of all others.

Copies (equal components) are one vector first. Cells are dealt to blocks of bounded size, and the
links between two blocks are counted by matrix products: a count and one edge for each vector leave
a task, never the pairs. Pivots grow with the table, within a bound in bytes.

Where vectors have no structure (random directions in many dimensions) all distances are alike, the
bounds exclude nothing, and the join is as good as comparing all with all; see the README's figures.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.shipping import ship

from .common import actual, quoted, save
from .components import connected_components

#: Vectors in a block; a task holds two blocks.
BLOCK = 4096
#: Vectors for each pivot, and bytes (as doubles) that the pivots and the sample they are drawn from may take.
PER_PIVOT, PIVOT_BYTES, SAMPLE_BYTES = 3000, 64 << 20, 128 << 20
#: Up to so many pivots are chosen far apart; more are drawn at random.
FAR_APART = 512
#: Room for rounding in the bounds: they only ever admit more. The test of a pair is the cosine itself.
_ROOM = 1e-9
_STRIP = 256


def _flagged(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v, usable): whether a vector can be linked."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    rows = vectors.select(quoted(vec_id).cast("long").alias("vec_id"), quoted(embedding).alias("v"))
    return rows.withColumn("usable", F.coalesce(usable, F.lit(False)))


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v, a, b): vectors that can be linked, and 128 bits that name their components."""
    plain = F.transform("v", lambda x: F.when(x == 0, F.abs(x)).otherwise(x))  # -0.0 is 0.0
    rows = _flagged(vectors, vec_id, embedding).where("usable").select("vec_id", plain.alias("v"))
    return rows.withColumn("a", F.xxhash64("v")).withColumn("b", F.xxhash64("v", F.lit(1)))


def _unit(packed: list[bytes], dtype: str) -> np.ndarray:
    v = np.frombuffer(b"".join(packed), dtype).astype(np.float64).reshape(len(packed), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def pivot_count(vectors: int, width: int, per_pivot: int = PER_PIVOT) -> int:
    """In proportion to the vectors, then to their square root (so that finding homes doesn't outgrow the join), and never beyond PIVOT_BYTES."""
    return max(1, min(round(vectors / per_pivot), round(16 * math.sqrt(vectors)), PIVOT_BYTES // (8 * max(1, width))))


def choose_pivots(unit: np.ndarray, count: int) -> np.ndarray:
    """Vectors far apart, each next one the farthest from those before it; where there are many, the first of the sample."""
    if count > FAR_APART:
        return unit[:count]
    chosen, near = [0], unit @ unit[0]
    while len(chosen) < min(count, len(unit)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    return unit[chosen]


def _distances(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (unit @ centres.T)))


def _reach(hit: np.ndarray, ids_x: np.ndarray, ids_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least id that each row and each column reaches over the links of a block, itself included."""
    least_x, least_y = ids_x.copy(), ids_y.copy()
    far = np.iinfo(np.int64).max
    while True:
        new_y = least_y.copy()
        new_x = least_x.copy()
        for at in range(0, len(ids_x), _STRIP):
            part = hit[at : at + _STRIP]
            new_x[at : at + _STRIP] = np.minimum(new_x[at : at + _STRIP], np.where(part, least_y[None, :], far).min(1, initial=far))
            np.minimum(new_y, np.where(part, new_x[at : at + _STRIP, None], far).min(0, initial=far), out=new_y)
        if (new_x == least_x).all() and (new_y == least_y).all():
            return least_x, least_y
        least_x, least_y = new_x, new_y


def _join_blocks(x: np.ndarray, y: np.ndarray | None, ids_x, ids_y, n_x, n_y, threshold: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, links, least) of the linked vectors of two blocks, or of one block with itself (y is None)."""
    own = y is None
    if own:
        y, ids_y, n_y = x, ids_x, n_x
    hit = np.empty((len(x), len(y)), bool)
    for at in range(0, len(x), _STRIP):
        hit[at : at + _STRIP] = x[at : at + _STRIP] @ y.T >= threshold
    if own:
        np.fill_diagonal(hit, False)
    rows, columns = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
    if not len(rows):
        return []
    hit = hit[np.ix_(rows, columns)]
    least_x, least_y = _reach(hit, ids_x[rows], ids_y[columns])
    links_x = np.concatenate([hit[at : at + _STRIP] @ n_y[columns] for at in range(0, len(rows), _STRIP)])
    if own:
        return [(ids_x[rows], links_x, least_x)]
    links_y = sum(n_x[rows[at : at + _STRIP]] @ hit[at : at + _STRIP] for at in range(0, len(rows), _STRIP))
    return [(ids_x[rows], links_x, least_x), (ids_y[columns], links_y, least_y)]


_KEY = ["c1", "c2", "b1", "b2"]


def range_join(classes: DataFrame, dtype: str, threshold: float, block: int = BLOCK, per_pivot: int = PER_PIVOT) -> DataFrame:
    """(rep, links, least): a class's `links` sum up to its links with other classes' vectors; (rep, least) are edges of its component.

    classes(rep, n, width, packed) are distinct vectors, n copies of each, numbered by rep. Vectors of
    different widths are never linked.
    """
    spark = classes.sparkSession
    ship(spark)
    parts = []
    for row in classes.groupBy("width").count().collect():  # a row for each width of vectors
        mine = classes.where(F.col("width") == row["width"])
        count = pivot_count(row["count"], row["width"], per_pivot)
        most = max(1, min(16 * count + 1024, SAMPLE_BYTES // (8 * max(1, row["width"]))))
        share = F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int(min(1.0, 1.2 * most / row["count"]) * (1 << 30))
        sample = [bytes(r[0]) for r in mine.where(share).limit(most).select("packed").collect()]
        if not sample:
            sample = [bytes(mine.select("packed").first()[0])]
        parts.append(_join_cells(mine, choose_pivots(_unit(sample, dtype), count), dtype, threshold, block))
    if not parts:
        return spark.createDataFrame([], "rep long, links long, least long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _join_cells(classes: DataFrame, centres: np.ndarray, dtype: str, threshold: float, block: int) -> DataFrame:
    context = classes.sparkSession.sparkContext
    pivots = context.broadcast(centres)  # PIVOT_BYTES at most
    strip = max(16, min(1024, (1 << 23) // len(centres)))  # rows whose distances are held at once
    radius = math.sqrt(max(0.0, 2 - 2 * threshold)) + _ROOM

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, strip) for at in range(0, whole.num_rows, strip)):
                distance = _distances(_unit(batch.column(2).to_pylist(), dtype), pivots.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(distance.argmin(1)), pa.array(distance.min(1))], ["rep", "n", "packed", "home", "distance"])

    homes = save(classes.select("rep", "n", "packed").mapInArrow(at_home, "rep long, n long, packed binary, home long, distance double"), "homes")
    size, reach = np.zeros(len(centres), np.int64), np.full(len(centres), -10.0)
    for r in homes.groupBy("home").agg(F.count("*").alias("size"), F.max("distance").alias("far")).collect():  # a row for each pivot
        size[r["home"]], reach[r["home"]] = r["size"], r["far"]
    bounds = context.broadcast((reach + radius, np.maximum(1, -(-size // block))))

    def to_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit, blocks = bounds.value
        cells = np.arange(len(limit))
        for whole in batches:
            for batch in (whole.slice(at, strip) for at in range(0, whole.num_rows, strip)):
                rep, home = np.asarray(batch.column(0)), np.asarray(batch.column(3))
                distance = _distances(_unit(batch.column(2).to_pylist(), dtype), pivots.value)
                near = (distance <= limit[None, :]) & (distance <= distance[np.arange(len(rep)), home][:, None] + 2 * radius)
                near[np.arange(len(rep)), home] = True
                mixed = (rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                mine = (mixed % blocks[home].astype(np.uint64)).astype(np.int64)
                row, cell = np.nonzero(near)
                times = blocks[cells[cell]]
                other = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                h, m = home[row], mine[row]
                first = (h < cell) | ((h == cell) & (m <= other))  # whether this vector's block is the pair's first
                c1, c2 = np.where(first, h, cell), np.where(first, cell, h)
                b1, b2 = np.where(first, m, other), np.where(first, other, m)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (c1, c2, b1, b2)), pa.array(~first), *(batch.column(i).take(take) for i in range(3))], [*_KEY, "second", "rep", "n", "packed"])

    def join(group: pa.Table) -> pa.Table:
        second = np.asarray(group.column("second")).astype(bool)
        rep, n = np.asarray(group.column("rep")), np.asarray(group.column("n"))
        own = all(group.column(a)[0] == group.column(b)[0] for a, b in (("c1", "c2"), ("b1", "b2")))
        unit = _unit(group.column("packed").to_pylist(), dtype)
        x, y = np.flatnonzero(~second), np.flatnonzero(second)
        found = _join_blocks(unit[x], None if own else unit[y], rep[x], rep[y], n[x], n[y], threshold) if own or len(x) and len(y) else []
        columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3)]
        return pa.table({"rep": pa.array(columns[0], pa.int64()), "links": pa.array(columns[1], pa.int64()), "least": pa.array(columns[2], pa.int64())})

    dealt = homes.mapInArrow(to_pairs, "c1 long, c2 long, b1 long, b2 long, second boolean, rep long, n long, packed binary")
    return dealt.groupBy(*_KEY).applyInArrow(join, "rep long, links long, least long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK, per_pivot: int = PER_PIVOT) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors.

    Links join rows whose cosine, in double precision, is at least `threshold` (a cosine of exactly
    that is a link); copies are linked with each other, rows that repeat a vec_id too. Distinct
    vectors are told apart by numbers of their own, so an id that stands on several vectors joins
    nothing: its rows are answered one by one. A vector that is null, zero, empty, or holds null or
    non-finite components has no links and is its own component. A row with a null vec_id is linked
    like any other, names no component, and is kept. An empty table gives no rows.
    """
    dtype = "<f4" if "float" in dict(vectors.dtypes)[actual(vectors, embedding)] else "<f8"
    usable = _usable(vectors, vec_id, embedding)
    classes = usable.groupBy("a", "b").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"), F.first("v").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(4)
            flat, ends = np.asarray(v.flatten()).astype(dtype), np.cumsum([0, *(len(x) for x in v)])
            packed = [flat[s:e].tobytes() for s, e in zip(ends[:-1], ends[1:], strict=True)]
            widths = pa.array([e - s for s, e in zip(ends[:-1], ends[1:], strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], widths, pa.array(packed, pa.binary())], ["a", "b", "first_id", "n", "width", "packed"])

    ship(vectors.sparkSession)
    packed = classes.select("a", "b", "first_id", "n", "v").mapInArrow(pack, "a long, b long, first_id long, n long, width long, packed binary")
    classes = save(packed.withColumn("rep", F.monotonically_increasing_id()), "classes")  # numbers are settled by being written
    found = save(range_join(classes.select("rep", "n", "width", "packed"), dtype, threshold, block, per_pivot), "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("rep").alias("src"), F.col("least").alias("dst")))
    by_class = classes.select("a", "b", "rep", "n", "first_id").join(links, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
    n_links = F.col("n") - 1 + F.coalesce("links", F.lit(0))
    by_class = save(by_class.select("a", "b", n_links.alias("n_links"), "first_id", F.coalesce("component", "rep").alias("root")), "by_class")
    salt = F.pmod(F.xxhash64("root"), F.lit(65_521))  # a second key, so that Spark can split the partition of a large component
    named = by_class.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_class = by_class.withColumn("k", salt).join(named.withColumn("k", salt), ["root", "k"]).select("a", "b", "n_links", "component_id")
    linked = usable.select("vec_id", "a", "b").join(by_class, ["a", "b"]).select("vec_id", "n_links", "component_id")
    alone = _flagged(vectors, vec_id, embedding).where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))

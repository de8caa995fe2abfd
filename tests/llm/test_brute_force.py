"""Operators against plain restatements, and the cases that their docstrings define."""

import hashlib
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import DOCS, ODD, brute_fingerprint, docs_of, roots, tiktoken_encoding

from docloom.llm import bpe, decontaminate, dom, embeddings, html_extract, language_model, lines, queries, shards, simhash, similar, token_counts, toxicity
from docloom.llm.common import scratch_path

# ---------------------------------------------------------------- 1


def texts(html):
    return [n.text for n in dom.parse(html) if n.tag == "#text"]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<html><head><title>T</title><article><p>One & two</article></html>", ["One & two"]),
        ("<title>T</title><meta charset=x><h1>A</h1>b", ["A", "b"]),
        ("<p>a<svg><text>no</text><p>b</p><svg></svg>c", ["a", "b", "c"]),
        ("<p>x<math><mi>y</mi></math> z <canvas>k<video>q<audio>r", ["xy z kqr"]),
        ("<div><svg><g>no</div><p>yes<svg></svg>", ["yes"]),
        ("<head><noscript><p>no</noscript><p>yes", ["yes"]),
        ("a<iframe>b", ["ab"]),
        ("<div>q<template></div><p>no</p></template>r", ["q r"]),
        ("<p t='>' u=\">\">y < z 3<4 &lt;i&gt;", ["y < z 3<4 <i>"]),
        ("a<!-- <p>no</p> -->b<!-- no", ["ab"]),
        ("a<script>if (a</b>) '</p>'</SCRIPT >b<style>no", ["a b"]),
        ("<li>1<li>2<ul><li>3</ul><li>4", ["1", "2", "3", "4"]),
        ("yes <a href='no", ["yes"]),
    ],
)
def test_html_as_browsers_read_it(html, want):
    assert texts(html) == want


@pytest.mark.parametrize("piece", ["<a ", "<p>x", "<", '<a b="', "<!--", "<svg>", "</p>", "<td><ul><div>", "<script>", "<canvas>", "&lt", "<table><tr><td>x"])
def test_long_pages_take_linear_time(piece):
    began = time.time()
    dom.parse(piece * (200_000 // len(piece)))
    assert time.time() - began < 5


def test_a_very_long_page(spark):
    html = "<article>" + "<p>Some words, and more of them.</p>" * 30_000 + "</article>" + "<a " * 1_700_000
    rows = spark.createDataFrame([(1, html), (1, html), (2, "<p></p>")], "page_id long, html string").withColumn("Text", F.lit("old")).withColumn("c1", F.lit(b"x"))
    got = html_extract.extract(rows, html_extract.train(pages=200))
    assert got.columns == ["page_id", "html", "c1", "text", "n_chars"]
    kept = {(r["page_id"], r["n_chars"]) for r in got.collect()}
    assert len(kept) == 2 and max(n for _, n in kept) >= 30_000 * 29
    assert html_extract.extract(rows.limit(0), html_extract.train(pages=200)).count() == 0


# ---------------------------------------------------------------- 2


def brute_lines(rows, ratio, least):
    seen, total = defaultdict(Counter), Counter()
    for _, t, s in rows:
        if t is not None:
            total[s or ""] += 1
            seen[s or ""].update({x.strip(lines.WHITE) for x in t.split("\n")} - {""})
    bad = {h: {x for x, k in c.items() if k >= least and k > ratio * total[h]} for h, c in seen.items()}
    return Counter((i, None if t is None else "\n".join(x for x in t.split("\n") if x.strip(lines.WHITE) not in bad[s or ""])) for i, t, s in rows)


@pytest.mark.parametrize(("least", "most"), [(1, 100_000), (2, 100_000), (2, 0)])
def test_lines_are_page_shares(spark, monkeypatch, least, most):
    monkeypatch.setattr(lines, "BROADCAST_LINES", most)
    rnd = random.Random(1)
    rows = [(i, "\n".join(rnd.choice(["Menu", " menu ", "", f"own {i}", f"w{rnd.randrange(30)}", "é\tx"]) for _ in range(rnd.randint(0, 9))), rnd.choice(["a", "b", None])) for i in range(150)]
    rows += [(500, "alone\nMenu", "one"), (501, "twice\nMenu", "two"), (502, "twice", "two"), *[(600 + k, "copy\nof a page", "c") for k in range(5)], *ODD]
    frame = docs_of(spark, rows).withColumn("a.b", F.lit(1)).withColumn("N_Lines", F.lit(2)).withColumn("host", F.lit(3)).withColumn("t", F.lit(4))
    got = lines.drop_boilerplate(frame, ratio=0.3, min_pages=least)
    assert got.columns == [*docs_of(spark, []).columns, "a.b", "host", "t", "n_lines", "n_dropped"]
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == brute_lines(rows, 0.3, least)


# ---------------------------------------------------------------- 3


def test_simhash_query(spark, tmp_path):
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(400)}"
    rows = []
    for i in range(0, 240, 4):
        base = [word() for _ in range(rnd.choice([2, 30, 200]))]
        rows += [(i, " ".join(base), "a"), (i + 1, " ".join(base).upper(), "a"), (i + 2, " ".join([*base[:-1], word()]), "b"), (i + 3, " ".join(base[1:]), "b")]
    rows += [(900, None, "a"), (901, "", "a"), (902, " \t", "b"), (3, rows[3][1], "c")]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    prints = [brute_fingerprint(t) for _, t, _ in rows]
    root = roots(len(rows), [(i, j) for i, a in enumerate(prints) for j in range(i + 1, len(prints)) if (a ^ prints[j]).bit_count() <= 2])
    least = defaultdict(lambda: 1 << 60)
    for k, (i, _, _) in enumerate(rows):
        least[root[k]] = min(least[root[k]], i)
    want = Counter((i, f"{prints[k]:016x}", least[root[k]]) for k, (i, _, _) in enumerate(rows))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.op3_simhash(spark, str(tmp_path)).collect()) == want


# ---------------------------------------------------------------- 4


def test_flat_files_hold_ids_only(spark):
    theirs, folder = tiktoken_encoding(), scratch_path(spark, "flat")
    names = token_counts.write_flat(docs_of(spark, ODD).coalesce(1), folder, 50_256)
    blocks = token_counts.flat_file_blocks(spark, folder, 2, 7).orderBy("block").collect()
    flat = np.frombuffer(b"".join(r["data"] for r in blocks), "<u2").tolist()
    assert flat == [x for _, t, _ in ODD for x in [*theirs.encode_ordinary(t or ""), 50_256]]
    assert [r["doc_id"] for r in names.orderBy("ordinal").collect()] == [i for i, _, _ in ODD]
    assert token_counts.id_width(50_256) == 2 and token_counts.id_width(1 << 16) == 4


# ---------------------------------------------------------------- 7


def test_embeddings_with_repeated_ids_and_planted_links(spark):
    rng = np.random.default_rng(2)
    rows = [(1, [1.0, 0.0] + [0.0] * 14), (1, [0.0, 1.0] + [0.0] * 14), (2, [1.0, 0.01] + [0.0] * 14)]
    centre = rng.normal(size=(60, 16))
    for i in range(4000):  # directions of their own, and families around centres
        v = rng.normal(size=16) if i % 3 else centre[i % 60] + rng.normal(size=16) * 0.2
        rows.append((100 + (i if i % 50 else 50), v.tolist()))
    rows += [(None, rows[5][1]), (9, [0.0] * 16), (9, None)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=300, per_pivot=200).collect()
    good = [(i, np.array(v)) for i, v in rows if v is not None and any(v)]
    unit = np.array([v / np.linalg.norm(v) for _, v in good])
    hit = unit @ unit.T >= 0.9
    np.fill_diagonal(hit, False)
    assert hit.sum() > 2000
    root = roots(len(good), np.argwhere(hit).tolist())
    least = {}
    for k, (i, _) in enumerate(good):
        least[root[k]] = min(least.get(root[k], 1 << 60), 1 << 60 if i is None else i)
    want = Counter((i, int(hit[k].sum()), least[root[k]]) for k, (i, _) in enumerate(good)) + Counter([(9, 0, 9)] * 2)
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["vec_id"] is None or r["vec_id"] == r["component_id"]) for r in got)


def test_pivots_grow_with_the_table_within_bytes():
    assert [embeddings.pivot_count(n, 64) for n in (1, 51_282, 3_000_000, 10**12)] == [1, 17, 1000, (64 << 20) // 512]


# ---------------------------------------------------------------- 8


def words(text):
    out, now = [], bytearray()
    for b in (text or "").encode() + b" ":
        b = b + 32 if 65 <= b <= 90 else b
        if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122:
            now.append(b)
        elif now:
            out.append(bytes(now))
            now = bytearray()
    return out


def brute_found(text, items, run=5, coverage=0.8):
    doc, found = words(text), set()
    for item_id, item in items:
        a = words(item)
        if 0 < len(a) < run:
            if any(doc[k : k + len(a)] == a for k in range(len(doc))):
                found.add(item_id)
            continue
        free_a, free_b, covered = [True] * len(a), [True] * len(doc), 0
        while a:
            best, where = run - 1, []
            for i in range(len(a)):
                for j in range(len(doc)):
                    k = 0
                    while i + k < len(a) and j + k < len(doc) and free_a[i + k] and free_b[j + k] and a[i + k] == doc[j + k]:
                        k += 1
                    if k > best:
                        best, where = k, [(i, j)]
                    elif k == best and k >= run:
                        where.append((i, j))
            if best < run:
                break
            for i, j in where:
                if all(free_a[i : i + best]) and all(free_b[j : j + best]):
                    covered += best
                    free_a[i : i + best] = free_b[j : j + best] = [False] * best
        if a and covered >= coverage * len(a):
            found.add(item_id)
    return found


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_contamination_is_what_plain_tiling_finds(spark, block_bytes):
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randrange(60)}"
    items = [(k, " ".join(word() for _ in range(rnd.randint(5, 25)))) for k in range(30)] + [(40, "two words"), (41, "ONE"), (42, ""), (43, "...")]
    rows = []
    for i in range(120):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 12)))]
        for _ in range(rnd.randint(0, 2)):
            w = rnd.choice(items)[1].split()
            cut = rnd.randint(0, len(w))
            parts += [" ".join(w[cut:]).upper(), word() * rnd.randint(0, 1), ", ".join(w[:cut])]
        rows.append((i, "\n".join(parts), "s"))
    rows += [(200, "twо words", "s"), (201, "these two, words", "s"), (202, "two\twords one", "s"), *[(300 + k, t, s) for k, (_, t, s) in enumerate(ODD)], (None, "two words", "s"), (201, "these two, words", "s")]
    frame = docs_of(spark, rows).withColumnRenamed("text", "Text").withColumn("tail", F.lit("two words"))
    bench = spark.createDataFrame([*items, (50, None), (None, items[0][1])], "item_id long, text string")
    want = [brute_found(t, items) for _, t, _ in rows]
    got = Counter((r["doc_id"], tuple(sorted(f["item_id"] for f in r["found"]))) for r in decontaminate.contamination(frame, bench, block_bytes=block_bytes).collect())
    assert got == Counter((i, tuple(sorted(f))) for (i, _, _), f in zip(rows, want, strict=True))
    kept = Counter((r["doc_id"], r["Text"]) for r in decontaminate.decontaminate(frame, bench, block_bytes=block_bytes).collect())
    assert kept == Counter((i, t) for (i, t, _), f in zip(rows, want, strict=True) if not f)


# ---------------------------------------------------------------- 9


def test_training_rows_are_bounded_after_the_join(spark):
    docs = docs_of(spark, [(1, f"text {k}", "s") for k in range(500)] + [(2, "same", "s")] * 50 + [(k, "x" * 100, "s") for k in range(10, 60)])
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(70)], "doc_id long, quality int, toxic int")
    got = toxicity.training_rows(docs, labels, toxicity.Settings(toxic_rows=20, other_rows=8, text_bytes=2400)).distinct().collect()
    assert len([r for r in got if r["toxic"] == 1]) <= 20 and len([r for r in got if r["toxic"] == 0]) <= 8
    assert sum(len(r["text"]) for r in got) <= 2400 and got


def test_no_document_goes_where_labels_tell_nothing(spark):
    frame = docs_of(spark, ODD).withColumnRenamed("text", "Text").withColumn("tail", F.lit("x"))
    for label in (0, 1):
        labels = spark.createDataFrame([(i, 1, label) for i in range(8)], "doc_id long, quality int, toxic int")
        assert toxicity.reject_toxic(frame, labels).count() == len(ODD)


# ---------------------------------------------------------------- 10


@pytest.mark.parametrize("conditional", [False, True])
def test_arrivals_of_one_pass(spark, conditional, tmp_path, monkeypatch):
    rows = [(i if i < 90 else 10**12 + i, f"t {i}", "s") for i in range(100)] + ODD
    frame = docs_of(spark, rows).withColumn("arrival", F.lit(1)).withColumn("Run", F.lit(2))
    make = shards.ShardStore
    monkeypatch.setattr(shards, "ShardStore", lambda spark, root, policy: make(spark, root, policy, conditional))
    store = shards.store_in_arrivals(frame, f"file://{tmp_path}/s", policy=shards.Policy(fan=3))
    assert Counter((r["doc_id"], r["text"]) for r in store.read().collect()) == Counter((i, t) for i, t, _ in rows)
    placed = store.placed()
    assert placed.where("run is null or shard is null").count() == 0 and {r.id for r in store.manifest().runs} >= {r["run"] for r in placed.collect()}
    assert {b for r in store.manifest().runs for b in r.batches} == {f"arrival-{k}" for k in range(8)}
    stale = store.manifest()
    store.append(frame, "late")
    with pytest.raises(shards.Conflict):
        store._commit(stale)
    files = {p.parent for p in (tmp_path / "s").rglob("part-*.parquet")}
    store.append(frame, "late")  # is there already
    assert {p.parent for p in (tmp_path / "s").rglob("part-*.parquet")} == files


# ---------------------------------------------------------------- all


def test_empty_tables_and_clashing_names(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for rows in ([], ODD):
        frame = spark.createDataFrame([(i, t, "en", s, None, "x") for i, t, s in rows], DOCS)
        for name in ("found", "fp", "n_tokens", "score", "shard", "component_id", "ids", "held_out", "a.b"):
            frame = frame.withColumn(name, F.lit(3))
        results = [
            lines.drop_boilerplate(frame), simhash.near_duplicates(frame), similar.near_duplicates(frame), token_counts.count_documents(frame), language_model.score_documents(frame),
            bpe.encode_documents(frame), decontaminate.contamination(frame, bench), decontaminate.decontaminate(frame, bench), toxicity.score_documents(frame, labels), toxicity.reject_toxic(frame, labels),
            shards.store_in_arrivals(frame, scratch_path(spark, "shards")).placed(),
        ]
        assert [r.count() for r in results] == [len(rows)] * len(results)
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, rep int, n int")
    assert embeddings.near_duplicates(vectors).count() == 0


def test_a_very_long_text(spark):
    rnd = random.Random(3)
    long = " ".join(f"w{rnd.randrange(100_000)}" for _ in range(700_000))
    frame = docs_of(spark, [(1, long, "s"), (2, long + " more", "s"), (3, "short", "s")])
    got = {r["doc_id"]: r for r in bpe.encode_documents(frame, keep_ids=False).collect()}
    assert got[1]["decoded_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    assert {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(frame).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r["doc_id"]: r["n_tokens"] for r in language_model.score_documents(frame).collect()} == {1: 700_001, 2: 700_002, 3: 2}
    bench = spark.createDataFrame([(7, " ".join(long.split()[500_000:500_050]))], "item_id long, text string")
    assert [len(r["found"]) for r in decontaminate.contamination(frame, bench).orderBy("doc_id").collect()] == [1, 1, 0]
    assert lines.drop_boilerplate(frame, min_pages=2).where("n_dropped > 0").count() == 0


def test_maps_of_two_sizes_lose_no_similar_pair(spark):
    """Sets on both sides of a map's size: the larger map is folded, and nothing that is similar is ruled out."""
    words = [f"w{i}" for i in range(1_040)]
    texts = [" ".join(words[: 1_040 - 20 * k]) for k in range(4)] + [" ".join(words[:400] + [f"x{i}" for i in range(640)])]
    sizes = {len(similar._bitmap(similar.shingle_set(t.encode()))) for t in texts}
    assert len(sizes) == 2
    got = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}

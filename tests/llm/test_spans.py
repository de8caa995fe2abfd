"""Periodic runs, aligned tokens and repeated strings, against plain restatements."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docloom.llm import common, periodic_runs, queries, suffixes, token_align
from docloom.llm.periodic_runs import Run


def digest(data):
    return hashlib.sha256(data).hexdigest()


# ---------------------------------------------------------------- periodic runs


def brute_runs(words, least, times):
    out = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(least, times * q) and all(words[i : i + size - r] != words[i + r : i + size] for r in range(1, q)):
                out.append(Run(i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r.start, r.period))


def repetitive(rnd):
    words = []
    while len(words) < rnd.randrange(120):
        piece = [rnd.randrange(rnd.choice([2, 4, 10])) for _ in range(rnd.randrange(1, 9))]
        words += piece * rnd.randrange(1, 6) + piece[: rnd.randrange(len(piece) + 1)] if rnd.random() < 0.6 else [rnd.randrange(20)]
    return words


@pytest.mark.parametrize(("least", "times"), [(24, 3), (6, 3), (4, 2), (5, 3)])
def test_runs_are_what_plain_search_finds(least, times):
    rnd = random.Random(least)
    found = 0
    for _ in range(400):
        words = repetitive(rnd)
        want = brute_runs(words, least, times)
        found += len(want)
        assert periodic_runs.find_runs(np.array(words, np.int64), least, times) == want
    assert found > 100


def test_long_runs():
    assert periodic_runs.find_runs(np.zeros(50_000, np.int64)) == [Run(0, 50_000, 1)]
    assert periodic_runs.find_runs(np.arange(30_000) % 9_000) == [Run(0, 30_000, 9_000)]


def test_runs_query(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(i, " ".join(f"w{w}" for w in (repetitive(rnd) * rnd.randrange(1, 4)))) for i in range(60)] + [(100, None), (101, ""), (102, " \t\n"), (None, "a " * 30), (7, "a " * 30), (7, "a " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("START", F.lit(2)).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()]
    want = []
    for doc_id, text in rows:
        words = (text or "").split()
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words, 24, 3)
        best = min(runs, key=lambda r: (-Fraction(r.length, r.period), r.start, r.period), default=None)
        gone = {i for r in runs for i in range(r.start + r.period, r.start + r.length)}
        told = (*best, 1000 * best.length // best.period) if best else (None,) * 4
        want.append((doc_id, len(runs), *told, digest("".join(f"{r.start},{r.length},{r.period}\n" for r in runs).encode()), digest(" ".join(w for i, w in enumerate(words) if i not in gone).encode())))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[1] for r in got) > 20


# ---------------------------------------------------------------- aligned tokens


def brute_alignment(text):
    """(n_a, n_b, groups, links) by whole-text encoding and byte ranges, or None."""
    both = token_align.aligner()
    tokenizer, model = both.a.tokenizer, both.b.processor
    if not text:
        return None
    ids = tokenizer.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
    parts = [[x.bytes_of.get(i, b"") for i in own] for x, own in zip((both.a, both.b), ids, strict=True)]
    if not b"".join(parts[0]) == b"".join(parts[1]) == (" " + text).encode():
        return None
    ends = [np.cumsum([len(p) for p in own]).tolist() for own in parts]
    groups, links, i, j = [], [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        k, m = ends[0].index(cut) + 1, ends[1].index(cut) + 1
        groups.append((ids[0][i:k], ids[1][j:m]))
        links += [(ids[0][x], ids[1][y]) for x in range(i, k) for y in range(j, m) if max(ends[0][x] - len(parts[0][x]), ends[1][y] - len(parts[1][y])) < min(ends[0][x], ends[1][y])]
        i, j = k, m
    return len(ids[0]), len(ids[1]), groups, links


PIECES = ["a", "b", " ", "  ", "\n", "\t", "\r\n", "é", "日本", "𝄞", "👩‍👧", "12", ".", " ", "▁", "\x1c", "<|endoftext|>", "<s>", "<0x41>", "'s", "́", " the", " of", "\x00", "{\r", "straße", "Übergang", "Tôi"]


def test_alignment_is_what_byte_ranges_say():
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(16))) for _ in range(3_000)] + [" ", "  ", "a ", " a", "", None, "The quick brown fox"]
    aligned = 0
    for text in texts:
        want = brute_alignment(text)
        (got,) = token_align.aligner().documents([None if text is None else text.encode()])
        if want is None:
            assert got == []
            continue
        aligned += 1
        assert [(a, b) for x in got for a, b in x.groups] == want[2]
        codes = np.frombuffer(b"".join(x.links for x in got), np.int64)
        assert sorted(zip((codes >> 32).tolist(), (codes & 0xFFFFFFFF).tolist(), strict=True)) == sorted(want[3])
        assert (sum(x.n_a for x in got), sum(x.n_b for x in got)) == want[:2]
    assert aligned > 1_000
    together = token_align.Aligner(*token_align.default_paths()).documents([t.encode() if t is not None else None for t in texts])
    assert together == [token_align.aligner().documents([t.encode() if t is not None else None])[0] for t in texts]


@pytest.mark.parametrize("block_bytes", [200, 1 << 20])
def test_link_statistics(spark, block_bytes):
    rnd = random.Random(6)
    texts = ["".join(rnd.choice([*PIECES, " the", " of", " the"]) for _ in range(rnd.randrange(30))) for _ in range(80)]
    rows = [*enumerate(texts), (200, None), (201, ""), (3, texts[3]), (None, "the of the")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("blk", F.lit(1)).withColumn("Links", F.lit("x")).repartition(5)
    got = [tuple(r) for r in token_align.link_statistics(frame, block_bytes=block_bytes).collect()]
    found = [brute_alignment(t) for _, t in rows]
    counts = Counter(link for w in found if w for link in w[3])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    want = []
    for (doc_id, _), w in zip(rows, found, strict=True):
        if w is None:
            want.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        told = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in w[2])
        want.append((doc_id, w[0], w[1], len(w[2]), len(w[3]), sum(counts[x] == most[x[1]] for x in w[3]), sum(counts[x] for x in w[3]), digest(told.encode())))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert token_align.link_statistics(frame.limit(0)).count() == 0
    groups = {r["doc_id"]: r["groups"] for r in token_align.align(frame).collect()}
    assert groups[200] == "" and digest(groups[5].encode()) == next(w[7] for w in want if w[0] == 5) or not groups[5]


def test_words_and_punctuation_are_aligned_once(monkeypatch):
    """Chunks end where punctuation follows a letter, so a block aligns each word and each mark once; forgetting changes nothing, and long chunks are not kept."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcé²Ⅷ_1") for _ in range(rnd.randrange(1, 5)))
    texts = ["".join(word() + rnd.choice([*" \n.,;!?'-_*/<()", "'s ", ", ", "...", "(", ' "', " \t"]) for _ in range(30)) for _ in range(300)] + ["x" * 200, "say foo;bar,baz!"]
    both = token_align.Aligner(*token_align.default_paths())
    assert both.chunks(" say foo;bar,baz!") == [" say", " foo", ";bar", ",baz", "!"]
    seen = []
    align = both.align
    monkeypatch.setattr(both, "align", lambda chunks: seen.extend(chunks) or align(chunks))
    token_align._block(0, [0, 1], [b"one, two! one! two,", b"two; one, two"], both)
    assert sorted(seen) == sorted([" one", " two", ",", "!", ";"])
    monkeypatch.setattr(token_align, "REMEMBERED", 20)
    for text in texts:
        want = brute_alignment(text)
        (got,) = both.documents([text.encode()])
        assert [(a, b) for x in got for a, b in x.groups] == (want[2] if want else [])
    both.documents([b"short"])
    assert not any(len(c) > token_align.SHORT for c in [*both._new, *both._old])


def test_invalid_bytes_have_no_tokens(spark):
    frame = spark.sql("SELECT 1L AS doc_id, CAST(x'61ff62' AS STRING) AS text UNION ALL SELECT 2L, 'plain text'")
    assert {r["doc_id"]: r["n_a"] > 0 for r in token_align.link_statistics(frame).collect()} == {1: False, 2: True}


# ---------------------------------------------------------------- repeated strings


def brute_repeats(rows, length):
    counts = Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = []
    for doc_id, text in rows:
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            if counts[text[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, x in enumerate(gone) if x and (not i or not gone[i - 1]))
        out.append((doc_id, len(text), sum(gone), spans, bytes(b for b, x in zip(text, gone, strict=True) if not x)))
    return sorted(out, key=str)


def pasted(rnd, length, n):
    pool = ["".join(rnd.choice("ab cdé\n") for _ in range(rnd.randrange(5, 3 * length))) for _ in range(10)] + ["a" * 3 * length, "ab" * length]
    for i in range(n):
        text = ""
        for _ in range(rnd.randrange(6)):
            piece = rnd.choice(pool)
            at = rnd.randrange(len(piece))
            text += piece[at : at + rnd.randrange(3 * length)] if rnd.random() < 0.5 else "".join(rnd.choice("abcdefgh é") for _ in range(rnd.randrange(2 * length)))
        yield i, text


@pytest.mark.parametrize("length", [24, 100, 400])
def test_repeats_are_what_plain_search_finds(spark, length, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET_ROWS", 40)  # many buckets, and equal suffixes on both sides of their ends
    rows = list(pasted(random.Random(length), length, 50))
    rows += [(None, rows[3][1]), (None, rows[7][1]), (5, rows[5][1]), (100, None), (101, ""), (102, "x" * (length - 1))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("core", F.lit(1)).withColumn("Spans", F.lit(2)).repartition(7)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in suffixes.drop_repeats(frame, length).collect()), key=str)
    assert got == brute_repeats([(i, (t or "").encode()) for i, t in rows], length)
    assert sum(r[2] for r in got) > 5 * length


def test_a_repeat_of_exactly_the_length(spark):
    """400 bytes between different neighbours go, 399 stay; one text may repeat itself, and invalid bytes are bytes."""
    rnd = random.Random(8)
    piece = "".join(rnd.choice("abcdefghij ") for _ in range(400))
    other = "".join(rnd.choice("klmnopqr ") for _ in range(399))
    twice = "".join(rnd.choice("stuvwxyz ") for _ in range(420))
    rows = [(1, f"A{piece}B"), (2, f"C{piece}D"), (3, f"E{other}F"), (4, f"G{other}H"), (5, f"{twice}-{twice}!")]
    got = {r["doc_id"]: (r["n_removed"], bytes(r["kept"])) for r in suffixes.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (400, b"AB"), 2: (400, b"CD"), 3: (0, rows[2][1].encode()), 4: (0, rows[3][1].encode()), 5: (840, b"-!")}
    raw = spark.sql("SELECT id AS doc_id, CAST(concat(repeat(CAST(x'ff' AS STRING), 400), CAST(id AS STRING)) AS STRING) AS text FROM range(2)")
    assert {(r["n_removed"], bytes(r["kept"])) for r in suffixes.drop_repeats(raw).collect()} == {(400, b"0"), (400, b"1")}


def test_no_texts_no_repeats(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.drop_repeats(empty).count() == 0
    assert periodic_runs.periodic_runs(empty).count() == 0


def test_multikey_quicksort():
    rnd = np.random.default_rng(1)
    for n, values in ((0, 3), (10, 3), (30_000, 3), (30_000, 10**6)):
        tokens = [rnd.integers(-values, values, n) for _ in range(4)]
        order = suffixes.multikey_quicksort(tokens)
        assert sorted(order.tolist()) == list(range(n))
        rows = [tuple(t[i] for t in tokens) for i in order.tolist()]
        assert rows == sorted(rows)


def test_idle_workers_remember_little(monkeypatch):
    """After a task only chunks met since the last forgetting stay, and after the last stage none; results are the same."""
    monkeypatch.setattr(token_align, "REMEMBERED", 3)
    both = token_align.Aligner(*token_align.default_paths())
    texts = [b"one two three four", b"five six", b"one " + b"x" * 100]
    first = [both.documents([t]) for t in texts]
    assert both._old and both._long
    both.rest()
    assert not both._old and not both._long and all(len(c) <= token_align.SHORT for c in both._new)
    assert [both.documents([t]) for t in texts] == first
    kept = token_align.aligner()
    assert token_align.aligner() is kept
    token_align.forget()
    assert not token_align._aligners and token_align.aligner() is not kept


def test_large_rows_are_written_in_small_row_groups(spark, monkeypatch):
    """Forty rows of 500 kB that do not compress: before, all were held in one row group."""
    monkeypatch.setattr(common, "ROW_GROUP", 2 << 20)
    rows = spark.range(40, numPartitions=1).selectExpr("id", "array_join(transform(sequence(1, 8000), i -> sha2(string(id * 9000 + i), 256)), '') AS t")
    groups = []
    for large in (0, 1 << 20):
        saved = common.save(rows, "large", rows_of=large)
        files = [f.removeprefix("file://").removeprefix("file:") for f in saved.inputFiles()]
        groups.append(sum(pq.ParquetFile(f).num_row_groups for f in files))
        assert saved.count() == 40
    assert groups[0] == 1 and groups[1] >= 4


def test_remembered_chunks_are_single_values():
    both = token_align.Aligner(*token_align.default_paths())
    chunks = [" one", " zwei", " Wort\u0103"]
    made, table = both.align(chunks), both.table(chunks)
    assert all(isinstance(table[c], bytes) and token_align._got(table[c]) == made[c] for c in chunks)
    assert token_align._put(None) is None and token_align._got(None) is None

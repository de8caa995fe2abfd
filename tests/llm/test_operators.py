import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import bpe, components, decontaminate, embeddings, html_extract, language_model, lines, shards, similar, simhash, token_counts, toxicity
from docloom.llm.common import scratch_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x") for i, t, s in rows], DOCS)


ODD = [(1, "A b c d e f", "h"), (2, "a B c d e f", "h"), (3, None, None), (4, "", "h"), (5, " \t\n", "g"), (1, "A b c d e f", "h"), (None, "z z z", "g"), (6, "w " * 3000, "h"), (7, "é ß 日本 🎉", "g")]


# ---------------------------------------------------------------- 1


def test_html_held_out_pages():
    extractor = html_extract.train(pages=500)
    same = [html_extract.training_page(9_000_000 + k) for k in range(80)]
    got = extractor.texts([h for h, _ in same])
    share = lambda a, b: len(set(a.split("\n")) & set(b.split("\n"))) / len(set(a.split("\n")))
    assert np.mean([share(x, y) for (_, x), y in zip(same, got, strict=True)]) > 0.9
    assert np.mean([share(y, x) for (_, x), y in zip(same, got, strict=True)]) > 0.9


def test_html_cases(spark):
    article = "<html><body><nav><ul><li><a href=/>Menu</a></li></ul></nav><article><h1>A &amp; B</h1><p>One\n two. It goes on, and on, with commas.<p>Three &lt;b&gt; four, five six seven.</article><footer>&copy; us</footer><script>var x='<p>no'</script></body></html>"
    rows = spark.createDataFrame([(1, "u", article, "old"), (2, None, None, None), (3, "v", "", None)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract(rows).collect()}
    want = "A & B\nOne two. It goes on, and on, with commas.\nThree <b> four, five six seven."
    assert got == {1: (want, len(want)), 2: ("", 0), 3: ("", 0)}


def test_decoding_never_contradicts():
    nodes = [html_extract.Node("a", -1, 0), html_extract.Node("b", 0, 1), html_extract.Node("c", 1, 2), html_extract.Node("d", 1, 2)]
    assert html_extract.decode(nodes, np.array([0.9, 0.4, 0.9, 0.1])).tolist() == [True, True, True, False]
    assert html_extract.decode(nodes, np.array([0.9, 0.01, 0.6, 0.1])).tolist() == [True, False, False, False]


# ---------------------------------------------------------------- 2


def test_lines(spark):
    rows = [(i, f"Menu\nbody {i}\n\n", "a") for i in range(10)] + [(20 + i, "copy line", "a") for i in range(9)] + ODD
    got = lines.drop_boilerplate(docs_of(spark, rows), ratio=0.3, min_pages=3, fold_copies=True)
    by = {(r["doc_id"], r["text"]) for r in got.collect()}
    assert (3, "body 3\n\n") in by and (20, "copy line") in by and (4, "") in by and (None, "z z z") in by
    assert got.count() == len(rows) and got.columns[-2:] == ["n_lines", "n_dropped"] and "extra" in got.columns
    assert lines.drop_boilerplate(docs_of(spark, [])).count() == 0


# ---------------------------------------------------------------- 3


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    import xxhash

    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    rnd = random.Random(1)
    for _ in range(60):
        text = "".join(rnd.choice("aB é\t\n\x0bxyZ") for _ in range(rnd.randint(0, 60)))
        assert simhash.fingerprint(text.encode()) & (1 << 64) - 1 == brute_fingerprint(text)


def roots(n, pairs):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_ball_pairs_and_links(spark):
    rnd = random.Random(2)
    values = {rnd.getrandbits(64) for _ in range(30)}
    for v in list(values):
        for _ in range(4):
            values.add(v ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    near = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert {(r["src"], r["dst"]) for r in simhash.ball_pairs(df).collect()} == near
    place = {v: i for i, v in enumerate(values)}
    found = [(place[r["src"]], place[r["dst"]]) for r in simhash.ball_links(df).collect()]
    assert roots(len(values), found) == roots(len(values), [(place[a], place[b]) for a, b in near])


def test_components(spark):
    rnd = random.Random(3)
    pairs = [(i, i + 1) for i in range(40)] + [(50, i) for i in range(51, 80)] + [(rnd.randrange(100, 150), rnd.randrange(100, 150)) for _ in range(40)] + [(3, 3), (1, 0), (None, 5)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    want = roots(150, [p for p in pairs if None not in p])
    assert got == {i: want[i] for p in pairs if None not in p and p[0] != p[1] for i in p}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_keep_one(spark):
    kept = simhash.keep_one(docs_of(spark, ODD))
    ids = sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect())
    assert ids == [(False, 1), (False, 1), (False, 3), (False, 6), (False, 7), (True, None)] and "extra" in kept.columns
    assert simhash.keep_one(docs_of(spark, [])).count() == 0


def brute_similar(texts):
    """The component (its least place) of each text, by comparing all pairs of sets of five-word shingles."""
    words = [t.lower().split() for t in texts]
    sets = [{" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in words]
    return roots(len(sets), [(i, j) for i, a in enumerate(sets) for j in range(i + 1, len(sets)) if 9 * len(a & sets[j]) >= 4 * (len(a) + len(sets[j]))])


def edited_copies():
    """Texts of all lengths, each with copies of more and more changed words; and a family that shares a long passage."""
    rnd = random.Random(8)
    word = lambda: f"w{rnd.randrange(5000)}"
    texts = []
    for _ in range(30):
        base = [word() for _ in range(rnd.randint(1, 150))]
        for changes in (0, 0, 1, 2, 3, 5, 8):
            copy = list(base)
            for _ in range(changes):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    passage = [word() for _ in range(90)]
    texts += [" ".join(passage + [word() for _ in range(k % 40)]) for k in range(100)]
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("leaders", [(1, 8, 64), (1, 2, 3)])
def test_similar_is_exact(spark, monkeypatch, leaders):
    monkeypatch.setattr(similar, "LEADERS", leaders)
    texts = edited_copies()
    got = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(docs_of(spark, [(i, t, "h") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == brute_similar(texts)


def test_similar_keep_one(spark):
    kept = similar.keep_one(docs_of(spark, ODD))
    ids = sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect())
    assert ids == [(False, 1), (False, 1), (False, 3), (False, 6), (False, 7), (True, None)] and "extra" in kept.columns
    assert similar.keep_one(docs_of(spark, [])).count() == 0


# ---------------------------------------------------------------- 4, 6


def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=bpe.read_ranks(bpe.default_ranks()), special_tokens={})


def test_bpe_is_what_tiktoken_does():
    mine, theirs, rnd = bpe.text_encoder(), tiktoken_encoding(), random.Random(4)
    texts = ["", " ", "a" * 500, "I'll we've 's", "\x1c\x1d x\x85\xa0 y", "x²³ ½ ªº"] + ["".join(rnd.choice("aabc de é\n\t  hello日本12!?-—='") for _ in range(rnd.randint(0, 50))) for _ in range(1500)]
    for text in texts:
        packed = mine.packed(text)
        assert np.frombuffer(packed, "<u4").tolist() == theirs.encode_ordinary(text), text
        assert mine.unpacked(packed) == text.encode()


def test_prefix_tables_append_and_edit():
    encoder, rnd = bpe.text_encoder().bpe, random.Random(5)
    table = encoder.prefixes(b"hello world")
    table.append(b"s and more")
    for _ in range(200):
        a = rnd.randint(0, len(table.data))
        table.edit(a, min(len(table.data), a + rnd.randint(0, 3)), bytes(rnd.choice(b"  abcdehello") for _ in range(rnd.randint(0, 4))))
        assert table.last == encoder.prefixes(table.data).last
    long = encoder.prefixes(b"the quick brown fox " * 200)
    assert long.edit(10, 12, b"zz") < 400


def test_encoded_documents(spark):
    got = bpe.encode_documents(docs_of(spark, ODD)).collect()
    theirs = tiktoken_encoding()
    want = Counter((i, hashlib.sha256(np.array(theirs.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in ODD)
    assert Counter((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want


@pytest.mark.parametrize("block", [2, 7, 1 << 16])
def test_token_counts(spark, block):
    got = token_counts.count_documents(docs_of(spark, ODD), block_tokens=block).collect()
    theirs = tiktoken_encoding()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((i, len(theirs.encode_ordinary(t or ""))) for i, t, _ in ODD)


def test_flat_files(spark, tmp_path):
    np.array([9, 5, 5, 9, 9, 4], "<u2").tofile(tmp_path / "a.bin")
    np.array([9], "<u2").tofile(tmp_path / "b.bin")
    blocks = token_counts.flat_file_blocks(spark, f"file://{tmp_path}", block_tokens=2)
    got = token_counts.document_lengths(token_counts.block_summaries(blocks, 9), block_tokens=2).collect()
    assert sorted((r["file"][-5:], r["ordinal"], r["n_tokens"], r["ended"]) for r in got) == [("a.bin", 0, 0, True), ("a.bin", 1, 2, True), ("a.bin", 2, 0, True), ("a.bin", 3, 1, False), ("b.bin", 0, 0, True)]


# ---------------------------------------------------------------- 5


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model(spark, order):
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice(["The", "cat", "sat", "dog", f"w{rnd.randrange(40)}"]) for _ in range(rnd.randint(0, 30))), "s") for i in range(120)] + [r for r in ODD if r[0] != 6]
    got = language_model.score_documents(docs_of(spark, rows), block_tokens=300, order=order).collect()
    tokens = lambda t: [*(t or "").encode().translate(language_model.ASCII_LOWER).split(), None]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    one, grams, held = Counter(), Counter(), Counter()
    for i, t, _ in rows:
        if not out(i):
            w = ["<s>", *tokens(t)]
            one.update(w[1:])
            for k in range(1, len(w)):
                for size in range(2, order + 1):
                    if k + 1 - size >= 0:
                        grams[tuple(w[k + 1 - size : k + 1])] += 1
                        held[tuple(w[k + 1 - size : k])] += 1
    n, v, m = sum(one.values()), len(one), language_model.PRIOR
    base = lambda w: (one[w] + 0.1) / (n + 0.1 * (v + 1))

    def p(h, w):
        return (grams[(*h, w)] + m * p(h[1:], w)) / (held[h] + m) if h else base(w)

    want = Counter()
    for i, t, _ in rows:
        w = ["<s>", *tokens(t)]
        score = sum(math.log10(p(tuple(w[max(0, k + 1 - order) : k]), w[k])) for k in range(1, len(w)))
        want[i, out(i), len(w) - 1, sum(one[x] > 0 for x in w[1:]), n, round(sum(math.log10(base(x)) for x in w[1:]), 6), round(score, 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == want


def test_automaton_of_order_three():
    rnd = random.Random(7)
    words, start = 6, 5
    texts = [[rnd.randrange(5) for _ in range(rnd.randint(1, 9))] for _ in range(30)]
    counts = Counter(g for t in texts for k in range(len(t)) for s in [[start, *t]] for size in (2, 3) if k + 2 - size >= 0 for g in [tuple(s[k + 2 - size : k + 2])])
    root = np.full(words, 1 / words)
    machine = language_model.automaton(counts, words, root, (start,), 3, prior=2.0)
    held = Counter()
    for g, c in counts.items():
        held[g[:-1]] += c

    def p(h, w):
        if not h:
            return root[w]
        low = p(h[1:], w)
        return (counts[(*h, w)] + 2 * low) / (held[h] + 2) if held[h] else low

    flat, ends = np.array([w for t in texts for w in t]), np.cumsum([len(t) for t in texts])
    want = [sum(math.log10(p(tuple([start, *t][max(0, k - 1) : k + 1]), t[k])) for k in range(len(t))) for t in texts]
    assert machine.run(flat, ends) == pytest.approx(want)


# ---------------------------------------------------------------- 7


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(12, 5))
    rows = [(i, (centre[i % 12] + rng.normal(size=5) * 0.25).tolist()) for i in range(300)]
    rows += [(1000, None), (1001, [0.0] * 5), (1002, [math.nan] * 5), (1003, [1.0, None, 0.0, 0.0, 0.0]), (1004, rows[3][1]), (1005, [2 * v for v in rows[3][1]]), (1006, []), (1007, [1.0, 2.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=40, per_pivot=60).collect()}
    good = [(i, np.array(v)) for i, v in rows if v is not None and len(v) == 5 and None not in v and np.isfinite(v).all() and any(v)]
    unit = np.array([v / np.linalg.norm(v) for _, v in good])
    hit = unit @ unit.T >= 0.9
    np.fill_diagonal(hit, False)
    root = roots(len(good), np.argwhere(hit).tolist())
    want = {i: (0, i, True) for i, _ in rows} | {i: (int(hit[k].sum()), good[root[k]][0], root[k] == k) for k, (i, _) in enumerate(good)}
    assert got == want


# ---------------------------------------------------------------- 8


def test_tiles_are_greedy():
    def plain(a, b, run=5):
        free_a, free_b, out = [True] * len(a), [True] * len(b), []
        while True:
            best, where = run - 1, []
            for i in range(len(a)):
                for j in range(len(b)):
                    k = 0
                    while i + k < len(a) and j + k < len(b) and free_a[i + k] and free_b[j + k] and a[i + k] == b[j + k]:
                        k += 1
                    if k > best:
                        best, where = k, [(i, j)]
                    elif k == best and k >= run:
                        where.append((i, j))
            if best < run:
                return out
            for i, j in where:
                if all(free_a[i : i + best]) and all(free_b[j : j + best]):
                    out.append((i, j, best))
                    free_a[i : i + best] = free_b[j : j + best] = [False] * best

    rnd = random.Random(3)
    for _ in range(150):
        a, b = ([rnd.randint(1, 3) for _ in range(rnd.randint(0, n))] for n in (22, 35))
        assert decontaminate.tiles(np.array(a, np.uint64), np.array(b, np.uint64)) == plain(a, b)


def test_decontamination(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, f"before {item.upper()}, after", "s"), (2, "six seven, eight nine ten! and one two three four five", "s"), (3, "one two three four five and no more", "s"), (4, "x\n" * 40_000 + item, "s"), *[(100 + (i or 0), t, s) for i, t, s in ODD]]
    bench = spark.createDataFrame([(7, item), (8, "too short"), (9, None), (None, item)], "item_id long, text string")
    found = {r["doc_id"]: r["found"] for r in decontaminate.contamination(docs_of(spark, rows), bench, block_bytes=10).collect()}
    assert [k for k, v in found.items() if v] == [1, 2, 4] and found[2][0]["coverage"] == 1.0 and len(found[2][0]["tiles"]) == 2
    kept = decontaminate.decontaminate(docs_of(spark, rows), bench)
    assert kept.count() == len(rows) - 3 and kept.columns == docs_of(spark, []).columns


# ---------------------------------------------------------------- 9


def test_toxicity(spark):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(700):
        words = [rnd.choice(["ba", "ce", "di", "fo", "gu"]) + rnd.choice(["na", "me", "ri", "to"]) for _ in range(rnd.randint(5, 80))]
        toxic = i % 6 == 0
        if toxic:
            words.insert(rnd.randrange(len(words)), "idiot")
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(toxic)))
    got = toxicity.score_documents(docs_of(spark, rows + ODD[2:5]), spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] >= 10]
    assert held and all(r["predicted"] == int(r["doc_id"] % 6 == 0) for r in held) and all(0 <= r["score"] <= 1 for r in got)
    none = toxicity.score_documents(docs_of(spark, ODD), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.where("predicted = 0").count() == len(ODD)


def test_pairs_are_learnt_among_many_rarer_words():
    rng = np.random.default_rng(3)

    def make(n):
        rows, labels = [], []
        for _ in range(n):
            insult, group = (rng.random(2) < 0.3).tolist()
            rows.append(np.unique(np.concatenate([[1] * insult, [2] * group, 10 + rng.integers(0, 200, 8)]).astype("<u4")))
            labels.append(float(insult and group))
        return rows, np.array(labels)

    rows, labels = make(4000)
    model = toxicity.fit(rows, labels, toxicity.Settings())
    rows, labels = make(1000)
    margin, _ = toxicity.margins(np.repeat(np.arange(1000), [len(r) for r in rows]), np.concatenate(rows).astype(int), 1000, model.x, model.bias, model.w, model.v)
    assert ((margin > 0) == (labels > 0)).mean() > 0.98
    assert abs(model.v[1] @ model.v[2]) > 10 * np.abs(model.v[10:210] @ model.v[10:210].T).max()


# ---------------------------------------------------------------- 10


def test_shards(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/store", shards.Policy(target_bytes=4096, least_bytes=1 << 20, fan=3))
    frame = docs_of(spark, ODD)
    for k in range(7):
        store.append(frame.coalesce(1), f"b{k}")
        store.append(frame, f"b{k}")  # a retry adds nothing
        store.compact()
    assert store.read().count() == 7 * len(ODD) and len(store.manifest().runs) == 3
    assert store.read(1).count() == len(ODD)
    stale = store.manifest()
    store.append(frame, "late")
    with pytest.raises(shards.Conflict):
        store._commit(stale)
    assert store.vacuum(keep=1) > 0 and store.read().count() == 8 * len(ODD)
    assert shards.store_in_arrivals(docs_of(spark, []), scratch_path(spark, "empty")).read().count() == 0


def test_input_is_not_changed_by_clashing_names(spark):
    frame = docs_of(spark, ODD).withColumn("n_lines", F.lit(1)).withColumn("fp", F.lit(2)).withColumn("found", F.lit(3))
    assert lines.drop_boilerplate(frame).count() == simhash.near_duplicates(frame).count() == bpe.encode_documents(frame).count() == len(ODD)

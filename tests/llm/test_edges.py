"""Cases at the edges of the operators: what is empty, null, invalid, repeated or clashes."""

import hashlib
import pickle
import random
import tracemalloc
import zlib
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import bpe, common, components, decontaminate, html_extract, language_model, periodic_runs, similar, simhash, token_counts, toxicity


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("rows", [[(1, None)], [(1, "")], [(1, "one")], [(1, "one two three four"), (2, "one two"), (3, "")], [(11, None), (30, "a b")]])
def test_blocks_without_grams(spark, order, rows):
    """A lone null text, an empty text in a partition of its own, a table of one word."""
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(max(1, len(rows)), "doc_id")
    got = {r["doc_id"]: r for r in language_model.score_documents(frame, order=order, block_tokens=1).collect()}
    assert {i: r["n_tokens"] for i, r in got.items()} == {i: len((t or "").split()) + 1 for i, t in rows}
    assert all(r["score"] <= 0 for r in got.values())


def test_clashing_names_in_anti_joins(spark):
    """Columns named like those of the joins inside; a benchmark of two blocks."""
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "v w x y z"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("__id", "__hash", "h", "g", "i", "K"):
        frame = frame.withColumn(name, F.lit(1))
    for kept in (similar.keep_one(frame), simhash.keep_one(frame)):
        assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {1, 3, None}
    items = [(1, "v w x y z"), (2, "p q r s t u"), (3, "k l m n o p")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = decontaminate.decontaminate(frame, bench, block_bytes=8)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, None}


def test_invalid_utf8_is_replaced(spark):
    """x'61ff62' reads as a, U+FFFD, b."""
    frame = spark.sql("SELECT 1L AS doc_id, CAST(x'61ff62' AS STRING) AS text, 's' AS source, 'u' AS url")
    want = bpe.text_encoder().packed("a�b")
    (row,) = bpe.encode_documents(frame).collect()
    assert bytes(row["ids"]) == want and row["decoded_sha256"] == hashlib.sha256("a�b".encode()).hexdigest()
    assert [r["n_tokens"] for r in token_counts.count_documents(frame).collect()] == [len(want) // 4]
    page = spark.sql("SELECT 1L AS page_id, 'u' AS url, CAST(concat('<article><p>', repeat('Plain words of a story. ', 20), CAST(x'ff' AS STRING), '</p></article>') AS STRING) AS html")
    (row,) = html_extract.extract(page).collect()
    assert row["text"].endswith("story. �")
    assert periodic_runs.periodic_runs(frame).first()["n_words"] == 1


def test_a_text_that_does_not_fit_shuts_out_no_other(spark):
    """The longest toxic text may come first in the sample: the others are learnt from all the same."""
    rows = [(i, "plain words of the day " + f"w{i}" * (1 + 3_000 * (i == 7))) for i in range(40)] + [(100 + i, f"vile rotten slur {i}" + " slur" * (20_000 if i % 5 == 0 else 1)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in rows], "doc_id long, toxic int")
    settings = toxicity.Settings(text_bytes=40_000)
    learnt = toxicity.training_rows(docs, labels, settings).collect()
    fits = [i for i, t in rows if len(t) < 20_000 and zlib.crc32(str(i).encode()) % 5]
    assert sorted(r["doc_id"] for r in learnt) == fits
    assert sum(len(bytes(r["text"])) for r in learnt) <= 40_000


def test_training_holds_its_terms_once():
    """What the driver learns from is numbered anew in place, and counted part by part."""
    rng = np.random.default_rng(5)
    rows = list(rng.integers(0, 4_000, (40_000, 50)).astype("<u4"))
    labels = (rng.random(len(rows)) < 0.2).astype(float)
    tracemalloc.start()
    try:
        toxicity.fit(rows, labels, toxicity.Settings(bucket_bits=12, epochs=1, steps=1))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 2 * sum(r.nbytes for r in rows)


def test_a_model_is_sent_without_what_it_has_not_learnt(spark):
    """It is the same where it arrives, and the same whatever partitions its rows came from."""
    rows = [(i, f"plain words of the day w{i % 7}" + " vile slur" * (i % 5 == 0)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    sent = pickle.dumps(model)
    assert len(sent) < 1 << 16
    for other in (pickle.loads(sent), toxicity.train(docs.repartition(7), labels)):
        assert other.settings == model.settings and other.bias == model.bias
        assert all(np.array_equal(getattr(other, k), getattr(model, k)) for k in ("x", "w", "v"))


def test_tables_belong_to_their_block(spark):
    """A block deletes its own tables, keeps what it says, and leaves those of other blocks and threads alone."""

    def there(path):
        fs, p = common.hadoop_fs(spark, path)
        return fs.exists(p)

    frame = spark.range(3).toDF("n")
    lazy = common.save(frame)
    with common.Scratch():
        with common.Scratch() as inner:
            kept, gone = common.save(frame), common.save(frame)
            inner.keep(kept)
        with ThreadPoolExecutor(1) as other:
            theirs = other.submit(common.save, frame).result()
        assert there(kept._scratch_path) and not there(gone._scratch_path)
    assert not there(kept._scratch_path)
    assert there(theirs._scratch_path) and lazy.count() == 3


def test_prefix_tables_are_what_is_read():
    """ids come from the table that appends and edits keep; after any edit they are tiktoken's."""
    encoder = bpe.text_encoder().bpe
    table = encoder.prefixes(b"internationalisation")
    table.last[-1] = encoder.ranks[b"n"]
    assert table.ids()[-1] == encoder.ranks[b"n"]
    rnd = random.Random(2)
    table = encoder.prefixes(b"the antidisestablishmentarianism")
    for _ in range(60):
        start = rnd.randrange(len(table.data) + 1)
        table.edit(start, min(len(table.data), start + rnd.randrange(5)), bytes(rnd.choice(b"abcdeing ") for _ in range(rnd.randrange(6))))
        assert table.ids() == encoder.encode(table.data)


def test_the_end_of_documents_is_no_token(spark):
    with pytest.raises(ValueError, match="token of the vocabulary"):
        token_counts.id_width(11)


def test_lists_of_frequent_shingles_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(similar, "SAMPLE_EACH", 1)
    rows = [(i, f"a b c d e f {'x y z u v w' if i % 2 else ''} {i}") for i in range(64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys, levels = similar.frequent_shingles(docs)
    assert len(keys) > 2 and (keys[1:] > keys[:-1]).all() and levels.max() == 6
    few, _ = similar.frequent_shingles(docs, most=2)
    assert len(few) == 2 and set(few) == set(keys[levels == 6])
    assert len(similar.frequent_shingles(docs, most=1)[0]) == 0


def test_balls_link_and_are_verified(spark, monkeypatch):
    """SimHash links an edited copy without the set join; what is 2 bits apart and not similar stays apart, with the join or without."""
    words = [f"w{i}" for i in range(3_000)]
    loop = "a b c d e f g h i " * 400
    texts = [" ".join(words), " ".join([*words[:1_500], "changed", *words[1_501:]]), f"{loop} k l m n o p q r s t u v", f"{loop} z y x w v u t s r q p o"]
    prints = [simhash.fingerprint(t.encode(), 5) for t in texts]
    assert all((a ^ b).bit_count() <= 2 for a, b in (prints[:2], prints[2:])) and prints[0] != prints[1]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = lambda: {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(docs).collect()}
    assert found() == {0: 0, 1: 0, 2: 2, 3: 3}
    monkeypatch.setattr(similar, "_candidates", lambda met, *_: met.where("false").selectExpr("fp AS src", "fp AS dst"))
    assert found() == {0: 0, 1: 0, 2: 2, 3: 3}


def test_few_edges_cost_no_shuffle_join(spark):
    """A round over few edges joins by broadcasts, and makes the same stars as one over many."""
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(150, 39)]
    edges = spark.createDataFrame([(max(x), min(x)) for x in links], "u long, v long")
    rounds = {few: components._one_round(edges, few) for few in (True, False)}
    stars = {few: {tuple(r) for r in df.collect()} for few, df in rounds.items()}
    assert stars[True] == stars[False]
    broadcasts = {few: df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin") for few, df in rounds.items()}
    assert broadcasts == {True: 3, False: 0}  # the large star stands in the plan twice
    assert {tuple(r) for r in components.connected_components(edges, "u", "v").collect()} == {(n, 1) for x in links for n in x}


def test_few_pairs_and_many_give_the_same_rows(spark, monkeypatch):
    """Both ways of looking up the sets of a pair's ends; a hub on either side."""
    pairs = common.save(spark.createDataFrame([(1, i) for i in range(2, 30)] + [(i, 40) for i in range(2, 30)], "src long, dst long"))
    sets = spark.createDataFrame([(i, [i, i * i]) for i in range(1, 50)], "fp long, shingles array<long>")
    rows = lambda: sorted((r["src"], r["dst"], tuple(r["shingles_1"]), tuple(r["shingles_2"])) for r in similar._both(pairs, sets).collect())
    few = rows()
    assert few == sorted((a, b, (a, a * a), (b, b * b)) for a, b in [tuple(r) for r in pairs.collect()])
    monkeypatch.setattr(similar, "BROADCAST_ROWS", 0)
    assert rows() == few


def test_the_driver_lets_go_between_rounds(spark):
    """The driver's heap is collected as a whole when a block of scratch tables ends: before, it grew to its limit over many short jobs."""

    def collected():
        return sum(b.getCollectionCount() for b in spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())

    before = collected()
    for _ in range(2):
        with common.Scratch():
            common.save(spark.range(3)).count()
    assert collected() >= before + 2

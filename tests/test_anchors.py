"""The inverted index of anchors, against the plan that names each anchor and against plain Python."""

import random

from pyspark.sql import functions as F

from docloom.functions.pytext import key
from docloom.operators import anchors, classify
from docloom.sources.rules import DocumentRules, builtin_rules


def test_the_ten_types(spark):
    rnd = random.Random(1)
    rules = builtin_rules()
    words = [a for r in rules for a in (*r.anchors, *r.excludes)] + ["079099000001", "x", "Không", "IDENTITY", "cư"]
    rows = [(i, [rnd.choice(words) if rnd.random() < 0.8 else None for _ in range(rnd.randrange(5))]) for i in range(400)] + [(900, []), (901, None)]
    docs = spark.createDataFrame(rows, "doc_id long, texts array<string>")
    by_plan = docs.select("doc_id", F.explode(classify.anchor_scores(classify.document_key(F.col("texts")), rules)).alias("s")).where("s.score > 0").select("doc_id", "s.doc_type", F.col("s.score").cast("long"))
    by_index = anchors.scores(docs).select("doc_id", "doc_type", "score")
    assert sorted(map(tuple, by_index.collect())) == sorted(map(tuple, by_plan.collect()))
    want = {r["doc_id"]: tuple(r["c"]) for r in docs.where("texts IS NOT NULL").select("doc_id", classify.classify(F.col("texts")).alias("c")).collect()}
    got = {r["doc_id"]: (r["doc_type"], r["confidence"]) for r in anchors.classify(docs).collect()}
    assert got.pop(901) == ("unknown", 0.0) and got == want and len({t for t, _ in want.values()}) > 8


def test_five_thousand_types(spark):
    """The plan does not grow with the types, and no type is missed."""
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) for _ in range(3_000)]
    name = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 4)))
    rules = [DocumentRules(doc_type=f"t{i}", display_name=f"T{i}", anchors=tuple(name() for _ in range(3)), excludes=(name(),) if i % 3 == 0 else ()) for i in range(5_000)]
    rows = [(i, [name() for _ in range(5)] + list(rnd.choice(rules).anchors[:2])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, texts array<string>")
    keyed = [([key(a) for a in r.anchors], [key(a) for a in r.excludes]) for r in rules]
    want = []
    for doc_id, texts in rows:
        k = key(" ".join(texts))
        for r, (names, out) in zip(rules, keyed, strict=True):
            n = sum(a in k for a in names)
            if n and not any(a in k for a in out):
                want.append((doc_id, r.doc_type, n))
    found = anchors.scores(docs, rules)
    assert sorted((r["doc_id"], r["doc_type"], r["score"]) for r in found.collect()) == sorted(want) and len(want) > 120
    small = anchors.scores(docs, rules[:50])
    assert len(found._jdf.queryExecution().analyzed().toString().splitlines()) == len(small._jdf.queryExecution().analyzed().toString().splitlines())
    best = {r["doc_id"]: r["doc_type"] for r in anchors.classify(docs, rules).collect()}
    for doc_id, doc_type in best.items():
        own = [(-n, int(t[1:]), t) for d, t, n in want if d == doc_id]
        assert doc_type == min(own)[2]

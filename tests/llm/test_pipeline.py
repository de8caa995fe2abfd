import random

import corpus_pipeline


def test_stages_take_effect(spark, tmp_path):
    text = lambda i: "Site menu\n" + " ".join(f"{random.Random(1000 * i + j).getrandbits(40):x}" for j in range(60))
    rows = [(i, text(i), "en", "s", 1) for i in range(60)]
    rows += [(100 + i, text(1000 + i) + " idiot moron clown", "en", "s", 1) for i in range(25)] + [(200, text(5), "en", "s", 1), (201, "lead " + " ".join(f"q{k}" for k in range(30)), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int("idiot" in r[1])) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"q{k}" for k in range(30)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(60))
    import hashlib

    assert got[7]["decoded_sha256"] == hashlib.sha256(text(7).removeprefix("Site menu\n").encode()).hexdigest()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "bpe"]


def test_an_edited_copy_goes(spark):
    words = [f"{random.Random(j).getrandbits(40):x}" for j in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(["other", *words[:120], "changed", *words[121:]])), (3, " ".join(words[:100] + [f"z{j}" for j in range(100)]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, frame, "").collect()) == [1, 3]

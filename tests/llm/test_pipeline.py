"""The corpus pipeline: every stage against what it must do, and the run as a whole."""

import corpus_pipeline as cp
from citeloom.llm import near_duplicates, quality
from citeloom.llm._common import table

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_turn(spark, tmp_path):
    docs = table(spark, SF, "documents")
    results = []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        results.append((docs, after))
        docs = after
    for before, after in results[:-1]:
        assert after.columns == COLUMNS and after.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
    model = quality.fit(results[0][0], table(spark, SF, "labels"))
    kept = {r["doc_id"] for r in quality.score(results[0][0], model).where("score >= 0.7").collect()}
    assert {r["doc_id"] for r in results[0][1].select("doc_id").collect()} == kept
    assert near_duplicates.near_duplicates(results[1][1]).where("not kept").count() == 0
    left = {r["doc_id"]: r["text"] for r in results[3][1].collect()}
    benchmark = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    assert not any(b in t for b in benchmark if len(b.split()) >= 10 for t in left.values() if t)
    end = results[-1][1]
    assert end.columns == [*COLUMNS, "size_of", "target_of", "copies_of"] and end.where("copies_of not in (1, 2)").count() == 0 and end.count() > 300


def test_run_gives_the_last_stage(spark):
    assert cp.run(spark, "/root/testdata/sf0.001").count() > 50
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "minhash near-dedup", "substring dedup", "benchmark decontamination", "mixing sources"]
    assert cp.ORACLE_SQL is None


def test_near_copies_from_eighty_percent_go(spark):
    words = [f"w{k}" for k in range(104)]
    texts = [words, [*words[:-10], *"abcdefghij"], [*words[:-16], *"klmnopqrstuvwxyz"]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id bigint, text string")
    # 90 of 110 shingles are shared with the second, 84 of 116 with the third
    assert {r["doc_id"] for r in cp.minhash_near_dedup(spark, docs, SF).collect()} == {0, 2}
    assert (near_duplicates.collections(85), near_duplicates.collections(80)) == (20, 28)

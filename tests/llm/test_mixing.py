"""Mixing: targets against an iterative reshare, closeness, caps, repeatability, defined cases."""

import random

from pyspark.sql import functions as F

from citeloom.llm.mixing import mix_sources


def reshare(sizes, share=1.5, most=2, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total = share * sum(sizes.values())
    target = {s: total * w[s] / sum(w.values()) for s in names}
    free = set(names)
    while over := [s for s in free if target[s] > most * sizes[s] + 1e-9]:
        for s in over:
            target[s] = most * sizes[s]
            free.discard(s)
        left = total - sum(target.values())
        for s in free:
            target[s] += left * w[s] / sum(w[x] for x in free)
    return target


def corpus(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = [(i, "w " * (rng.randrange(1, 60) if rng.random() < 0.99 else 900), rng.choice(["a", "a", "a", "b", "c", "d", "é", "Z", None])) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def test_targets_and_taken_words(spark):
    docs = corpus(spark)
    got = mix_sources(docs).cache()
    per = {r["source"]: r for r in got.groupBy("source").agg(F.first("source_size").alias("size"), F.first("target").alias("target"), F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()}
    want = reshare({k: v["size"] for k, v in per.items()})
    for k, v in per.items():
        assert abs(v["target"] - want[k]) < 1e-6 * max(1, want[k])
        assert abs(v["taken"] - v["target"]) <= 450
    assert got.where("copies > 2 or copies < 0").count() == 0 and got.count() == 3000
    again = mix_sources(docs.repartition(7))
    assert got.select("doc_id", "copies").exceptAll(again.select("doc_id", "copies")).count() == 0


def test_another_seed_takes_others_and_priority_counts(spark):
    docs = corpus(spark).withColumn("rich", F.when(F.col("doc_id") % 2 == 0, 20.0).otherwise(1.0))
    a, b = mix_sources(docs), mix_sources(docs, seed=2)
    assert a.select("doc_id", "copies").exceptAll(b.select("doc_id", "copies")).count() > 0
    c = mix_sources(docs, priority_col="rich").where("source = 'a'")
    even, odd = (c.where(f"doc_id % 2 = {k}").agg(F.avg("copies")).first()[0] for k in (0, 1))
    assert even > odd + 0.2


def test_defined_cases(spark):
    odd = spark.createDataFrame([(1, None, "a", 1), (2, "", None, 2), (None, "x y", "a", 3), (4, "x y z", "b", 4), (4, "x y z", "b", 5)], "doc_id bigint, text string, source string, Size int")
    got = mix_sources(odd).collect()
    assert len(got) == 5 and {r["size"] for r in got} == {0, 2, 3} and len({r["copies"] for r in got if r["doc_id"] == 4}) == 1
    assert mix_sources(odd.where("false")).count() == 0
    nothing = mix_sources(odd.where("doc_id = 2")).collect()
    assert [(r["target"], r["copies"]) for r in nothing] == [(0.0, 0)]
    kept = mix_sources(odd, keep=True)
    assert kept.columns == ["doc_id", "text", "source", "Size", "size_of", "target_of", "copies_of"] and kept.count() == 5


def test_kept_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 9, "x"), (2, "c", "t", 9, "y"), (None, "d e", None, 9, "z")], "doc_id bigint, text string, source string, Size_Of int, size string")
    got = mix_sources(docs, keep=True)
    assert got.columns == ["doc_id", "text", "source", "size", "size_of", "target_of", "copies_of"]
    assert sorted((r["size"], r["size_of"]) for r in got.collect()) == [("x", 2), ("y", 1), ("z", 2)]

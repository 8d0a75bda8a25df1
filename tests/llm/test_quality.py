"""Quality classifier: held-out accuracy, determinism, defined cases."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from citeloom.llm import quality
from citeloom.llm._common import SpanHash, held_out, table, utf8

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality.fit(docs, labels, train_where=~held_out("id", 4, 2))
    got = quality.score(docs, model).join(labels, "doc_id").where(held_out("doc_id", 4, 2))
    good, bad = got.agg(F.avg(F.when(F.col("quality") == 1, (F.col("score") >= 0.7).cast("int"))), F.avg(F.when(F.col("quality") == 0, (F.col("score") < 0.7).cast("int")))).first()
    assert good > 0.99 and bad > 0.95


def test_training_is_deterministic():
    texts = pa.array(["good words here again"] * 20 + ["bad!! WORDS!! HERE!!"] * 20)
    labels = pa.array([1] * 20 + [0] * 20).to_numpy()
    a, b = quality.train(texts, labels, buckets=1 << 12), quality.train(texts, labels, buckets=1 << 12)
    assert (a.weight == b.weight).all() and a.bias == b.bias


def test_defined_cases(spark):
    rows = [(i, "the cat sat on the mat " * 3 if i % 2 else "BUY|NOW|CHEAP|" * 5) for i in range(60)]
    odd = [(100, None), (101, ""), (102, "cat " * 100_000), (None, "the cat sat"), (103, "the cat sat"), (103, "the cat sat")]
    docs = spark.createDataFrame(rows + odd, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (100, None), (0, 0)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == 66 and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[100] == by[101] and by[1] > 0.7 > by[0] and by[103] == by[None]
    assert quality.score(docs.where("false"), model).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.score(docs, quality.fit(docs, none)).first()["score"] == 0.5
    one = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    assert quality.score(docs, quality.fit(docs, one)).first()["score"] > 0.5


def test_accepted_rows_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 3.5, "z")], "doc_id bigint, text string, score_of double, Text2 string")
    one = quality.fit(docs, spark.createDataFrame([(1, 1)], "doc_id bigint, quality int"))
    assert quality.accepted(docs, one, least=0.5).collect() == docs.collect()
    assert quality.accepted(docs, one, least=0.99).count() == 0


def test_features_against_a_plain_count():
    """Kinds and numbers of features, and which of them are equal, for words taken apart one by one."""
    text = "aa bb aa aa ünder x x x"
    points = np.array([ord(c) for c in text], np.uint32)
    parts = list(quality.features(points, np.array([0, len(points)]), 1 << 30, SpanHash()))
    w = text.split()
    grams = [("%s" % g[k : k + n], n) for g in (f" {x} " for x in w) for n in (3, 4, 5) for k in range(len(g) - n + 1)]
    plain = [[(x,) for x in w], list(zip(w, w[1:])), [a == b for a, b in zip(w, w[1:])], list(zip(w, w[1:], w[2:])), [(a == b, b == c, a == c) for a, b, c in zip(w, w[1:], w[2:])]]
    for (got, _), want in zip(parts, plain):
        assert len(got) == len(want) and [[x == y for y in got] for x in got.tolist()] == [[x == y for y in want] for x in want]
    rest = np.concatenate([g for g, _ in parts[5:]])
    assert len(rest) == len(grams) and len(set(rest.tolist())) == len(set(grams))


def test_score_is_the_mean_of_its_features(spark):
    rng = np.random.default_rng(1)
    model = quality.Model(rng.normal(size=1 << 12).astype(np.float32), 0.3)
    texts = ["some words here", "", "one", "again again again " * 50]
    raw, offsets = utf8(pa.array(texts))
    got = model.score(raw, offsets, SpanHash())
    for k, t in enumerate(texts):
        points = np.array([ord(c) for c in t], np.uint32)
        hits = [b for part, _ in quality.features(points, np.array([0, len(points)]), 1 << 12, SpanHash()) for b in part.tolist()]
        mean = sum(float(model.weight[b]) for b in hits) / max(1, len(hits))
        assert abs(got[k] - 1 / (1 + np.exp(-(mean + 0.3)))) < 1e-6


def test_labels_without_documents_take_no_place(spark):
    docs = spark.createDataFrame([(k, "good words" if k % 2 else "bad|words|") for k in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(k, 1) for k in range(1000, 3000)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.fit(docs, labels, max_train_docs=40)).collect()}
    assert got[1] > 0.6 > 0.4 > got[0]

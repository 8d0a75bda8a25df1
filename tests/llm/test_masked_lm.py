"""Masked language model: gradients, normalised probabilities, learning, distributed averaging, defined cases."""

import random
from collections import Counter

import numpy as np

from citeloom.llm import masked_lm as lm


def test_probabilities_sum_to_one():
    net = lm.Network.start(1)
    context = np.random.default_rng(0).integers(0, lm.VOCABULARY + 1, (1, 2 * lm.SIDE)).repeat(lm.VOCABULARY, 0)
    assert abs(np.exp(net.log_p(context, np.arange(lm.VOCABULARY)).astype(np.float64)).sum() - 1) < 1e-4


def test_gradient_against_differences():
    rng = np.random.default_rng(2)
    context, target = rng.integers(0, lm.VOCABULARY, (8, 2 * lm.SIDE)), rng.integers(0, lm.VOCABULARY, 8)
    flat = lm.Network.start(3).flat.astype(np.float64)

    class Seen(lm.Network):
        pass

    seen = lm.Network(np.zeros_like(flat))
    lm.Network(flat.copy()).step(context, target, seen, 0.0)
    for at in rng.choice(np.flatnonzero(seen.flat > 1e-12), 20):
        eps = 1e-5
        up, down = flat.copy(), flat.copy()
        up[at] += eps
        down[at] -= eps
        slope = -(lm.Network(up).log_p(context, target).mean() - lm.Network(down).log_p(context, target).mean()) / (2 * eps)
        assert abs(slope**2 - seen.flat[at]) < 1e-6 + 1e-3 * abs(slope**2)


def test_contexts_stay_in_their_text():
    ids, rows = np.array([1, 2, 3, 7]), np.array([0, 0, 0, 1])
    e = lm._EDGE
    assert lm.contexts(ids, rows).tolist() == [[e, e, 2, 3], [e, 1, 3, e], [1, 2, e, e], [e, e, e, e]]


def corpus(spark, n=300):
    rng = random.Random(4)
    line = lambda: " ".join(rng.choice(["the red fox runs", "a blue bird sings", "one old tree stands"]) for _ in range(20))
    rows = [(i, line()) for i in range(n)]
    rows += [(1000, " ".join(rng.sample(rows[0][1].split(), len(rows[0][1].split())))), (1001, None), (1002, ""), (None, "the red fox runs"), (1003, "unseen words only here"), (1003, "unseen words only here"), (1004, "fox " * 100_000)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)


def test_learns_order_and_scores_odd_rows(spark):
    docs = corpus(spark)
    net, known = lm.fit(docs, rounds=2, batch_words=64)
    got = lm.score(docs, net, known).collect()
    assert len(got) == 307
    by = {r["doc_id"]: r for r in got}
    assert by[1001]["log_likelihood"] == 0 and by[1001]["mean_log_likelihood"] is None and by[1002]["n_words"] == 0
    assert by[0]["mean_log_likelihood"] > by[1000]["mean_log_likelihood"] + 1
    assert by[0]["mean_log_likelihood"] > -np.log(12) + 0.5
    assert by[1004]["n_words"] == 100_000


def test_empty_table(spark):
    docs = corpus(spark).where("false")
    net, known = lm.fit(docs)
    assert lm.score(docs, net, known).count() == 0


def test_every_document_trains(spark):
    docs = corpus(spark)
    start = lambda known: lm.Network.start(5, known.leaves).flat
    for some in (docs.where("doc_id = 3"), docs.where("doc_id is null")):
        net, known = lm.fit(some, rounds=1)
        assert (net != start(known)).any()


def test_partitions_do_not_matter(spark):
    docs = corpus(spark)
    one, two = (lm.fit(docs.repartition(k), rounds=1, slice_words=2000)[0] for k in (1, 7))
    assert np.array_equal(one, two)


def test_starts_as_word_frequencies():
    leaves = np.arange(1.0, lm.VOCABULARY + 1)
    net = lm.Network.start(1, leaves)
    context = np.random.default_rng(0).integers(0, lm.VOCABULARY + 1, (50, 2 * lm.SIDE))
    target = np.arange(0, lm.VOCABULARY, lm.VOCABULARY // 50)[:50]
    assert np.allclose(net.log_p(context, target), np.log((leaves[target] + 0.1) / (leaves + 0.1).sum()), atol=1e-3)


def test_a_second_copy_raises_the_score(spark):
    """Words that only one text has are likelier where the corpus holds that text twice."""
    once, twice = " ".join(f"a{k}" for k in range(300)), " ".join(f"b{k}" for k in range(300))
    often = " ".join(f"w{k} " * 3 for k in range(lm.VOCABULARY))
    docs = spark.createDataFrame([(0, often), (1, once), (2, twice), (3, twice)], "doc_id bigint, text string")
    by = {r["doc_id"]: r["mean_log_likelihood"] for r in lm.score(docs, *lm.fit(docs, rounds=1)).collect()}
    assert by[2] == by[3] > by[1] + 0.5


def test_every_word_has_its_own_probability(spark, monkeypatch):
    often = " ".join(f"w{k} w{k} w{k} w{k}" for k in range(lm.VOCABULARY - lm.GROUPS))
    rare = [f"r{k}" for k in range(1500)]
    docs = spark.createDataFrame([(0, often), (1, " ".join(rare)), (2, " ".join(rare[:500])), (3, rare[0]), (4, rare[1499]), (None, None)], "doc_id bigint, text string")
    n = Counter(rare + rare[:500] + [rare[0], rare[1499]])
    results = []
    for held in (lm.COMMON, 100, 0):
        monkeypatch.setattr(lm, "COMMON", held)
        net, known = lm.fit(docs, rounds=1)
        got = {r["doc_id"]: r for r in lm.score(docs, net, known).collect()}
        assert len(got) == 6 and got[None]["log_likelihood"] == 0 and known.counts.count() == len(n) + lm.VOCABULARY - lm.GROUPS
        results.append([got[k]["log_likelihood"] for k in range(5)])
    assert np.allclose(results[0], results[1]) and np.allclose(results[0], results[2])
    hasher, groups = lm.SpanHash(), Counter()
    data = [np.frombuffer(w.encode(), np.uint8) for w in n]
    group = {w: int(hasher(d, np.array([0]), np.array([len(d)]))[0]) >> 64 - lm.GROUP_BITS for w, d in zip(n, data, strict=True)}
    for w in n:
        groups[group[w]] += n[w]
    net, known = lm.fit(docs, rounds=1)
    alone = np.full((1, 2 * lm.SIDE), lm._EDGE)
    for doc, w in ((3, rare[0]), (4, rare[1499])):
        of_group = lm.Network(net).log_p(alone, np.array([lm.VOCABULARY - lm.GROUPS + group[w]]))[0]
        want = of_group + np.log(n[w] / (groups[group[w]] + 1))
        got = {r["doc_id"]: r["log_likelihood"] for r in lm.score(docs, net, known).collect()}[doc]
        assert abs(got - want) < 1e-3
    unseen = spark.createDataFrame([(7, "neverseen")], "doc_id bigint, text string")
    d = np.frombuffer(b"neverseen", np.uint8)
    g = int(hasher(d, np.array([0]), np.array([9]))[0]) >> 64 - lm.GROUP_BITS
    want = lm.Network(net).log_p(alone, np.array([lm.VOCABULARY - lm.GROUPS + g]))[0] - np.log(groups[g] + 1)
    assert abs(lm.score(unseen, net, known).first()["log_likelihood"] - want) < 1e-3

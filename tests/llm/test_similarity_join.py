"""Epsilon grid order join against brute force."""

import numpy as np

from citeloom.llm import similarity_join as sj


def brute(ids, vectors, cosine):
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    unit = [np.array(v) / np.linalg.norm(v) if g else None for v, g in zip(vectors, good)]
    n = len(ids)
    link = [[i != j and good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine for j in range(n)] for i in range(n)]
    comp = list(ids)
    for _ in range(n):
        comp = [min([comp[i], *(comp[j] for j in range(n) if link[i][j])]) for i in range(n)]
    return {ids[i]: (sum(link[i]), comp[i], comp[i] == ids[i]) for i in range(n)}


def run(spark, ids, vectors, cosine=0.9):
    df = spark.createDataFrame(list(zip(ids, vectors)), "vec_id bigint, embedding array<double>")
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in sj.similarity_join(df, cosine=cosine).collect()}


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6))
    vectors = [(centres[k % 12] + rng.normal(size=6) * rng.choice([0.02, 0.3, 0.6])).tolist() for k in range(150)]
    vectors += [vectors[3]] * 4 + [(np.array(vectors[7]) * 3).tolist()]
    ids = rng.permutation(len(vectors)).tolist()
    for block, leaf in ((16, 4), (1024, 256)):
        monkeypatch.setattr(sj, "BLOCK", block)
        monkeypatch.setattr(sj, "LEAF", leaf)
        assert run(spark, ids, vectors) == brute(ids, vectors, 0.9)


def test_defined_cases(spark):
    ids = [1, 2, 3, 4, 5, 6, 7, 8, 9]
    vectors = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 0.0], [1.0, 0.0], [2.0, 0.0], [1.0, 0.0, 0.0]]
    assert run(spark, ids, vectors) == brute(ids, vectors, 0.9)


def test_one_large_group_of_copies_makes_few_rows(spark):
    vectors = [[1.0, 0.001 * (k % 3), 0.0] for k in range(3000)]
    got = run(spark, list(range(3000)), vectors)
    assert set(got.values()) == {(2999, 0, True), (2999, 0, False)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert sj.similarity_join(df).count() == 0


def test_null_ids_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.01], "a"), (5, [1.0, 0.0], "b"), (5, [0.0, 1.0], "c"), (9, [1.0, 0.02], None)], "vec_id bigint, embedding array<double>, rep string")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in sj.similarity_join(df).collect()), key=str)
    # each row is a vector of its own
    assert got == [(5, 0, 5, True), (5, 2, 5, True), (9, 2, 5, False), (None, 2, None, True)]


def test_many_tiles_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    m = np.concatenate([centres[rng.integers(0, 40, 1500)] + rng.normal(size=(1500, 16)) * 0.25, rng.normal(size=(700, 16))])
    u = m / np.linalg.norm(m, axis=1)[:, None]
    near = u @ u.T >= 0.9
    want = near.sum(1) - 1
    monkeypatch.setattr(sj, "BLOCK", 32)
    monkeypatch.setattr(sj, "LEAF", 8)
    df = spark.createDataFrame([(k, v) for k, v in enumerate(m.tolist())], "vec_id bigint, embedding array<double>").repartition(7)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in sj.similarity_join(df).collect()}
    assert [got[k][0] for k in range(len(m))] == want.tolist()
    comp = np.arange(len(m))
    while True:
        new = np.array([comp[near[k]].min() for k in range(len(m))])
        if (new == comp).all():
            break
        comp = new
    assert [got[k][1] for k in range(len(m))] == comp.tolist()


def test_many_lengths_and_text_ids(spark):
    rows = [(f"v{d}-{k}", [1.0] * d + [0.1 * k]) for d in range(1, 71) for k in range(2)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in sj.similarity_join(spark.createDataFrame(rows, "vec_id string, embedding array<double>")).collect()}
    assert got == {f"v{d}-{k}": (1, f"v{d}-0") for d in range(1, 71) for k in range(2)}

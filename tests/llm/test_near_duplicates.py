"""MinHash near-dedup against brute force on full sets."""

import random
import re
import tempfile

from citeloom.llm._common import components
from citeloom.llm.near_duplicates import maybe_in, near_duplicates, without_near_duplicates


def brute(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    n = len(texts)
    link = lambda a, b: a and b and 100 * len(a & b) >= 85 * len(a | b)
    comp = list(range(n))
    change = True
    while change:
        change = False
        for i in range(n):
            for j in range(i):
                if comp[i] != comp[j] and link(sets[i], sets[j]):
                    low, high = sorted((comp[i], comp[j]))
                    comp = [low if c == high else c for c in comp]
                    change = True
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i in range(n)}


def run(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect()}


def test_against_brute_force(spark, docs):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    bases = [[rng.choice(words) for _ in range(rng.choice([6, 40, 120, 300]))] for _ in range(30)]
    texts = []
    for b in bases:
        texts.append(" ".join(b))
        for _ in range(rng.randrange(5)):
            c = list(b)
            for _ in range(rng.randrange(1, 5)):
                c[rng.randrange(len(c))] = rng.choice(words)
            texts.append(" ".join(c))
    passage = [rng.choice(words) for _ in range(60)]
    texts += [" ".join([*passage, *(rng.choice(words) for _ in range(8))]) for _ in range(40)]
    texts += [texts[0].upper(), texts[0].replace(" ", "\n")]
    assert run(docs(texts)) == brute(texts)


def test_defined_cases(spark, docs):
    texts = [None, "", " \t\n", "one two", "One  two", "a b c d", "same text of more than five words", "same text of more than five words", "long " * 40_000]
    assert run(docs(texts)) == brute(texts)
    odd = spark.createDataFrame([(None, "some text of more than five words"), (7, "some text of more than five words"), (7, "some text of more than five words"), (3, None)], "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(odd).collect()), key=str)
    assert got == [(3, 3, True), (7, 7, True), (7, 7, True), (None, None, True)]
    assert near_duplicates(odd.where("false")).count() == 0


def test_extra_columns_that_differ_in_case(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 5, "x"), (2, "a b c d e f", 6, "y")], "doc_id bigint, text string, n bigint, Keys string")
    assert run(df) == {1: (2, 1, True), 2: (2, 1, False)}


def test_rows_that_share_an_id_and_text_ids(spark):
    a, b = [" ".join(f"{x}{k}" for k in range(60)) for x in "ab"]
    near = lambda t: t + " tail"
    rows = [("7", a), ("7", b), ("9", near(b)), ("8", near(a)), ("5", "alone with more than five words"), (None, a), ("7", a)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([("7", 56, "7"), ("7", 56, "7"), ("7", 56, "7"), ("9", 57, "7"), ("8", 57, "7"), ("5", 2, "5"), (None, 56, None)], key=str)
    left = sorted(((r["doc_id"], r["text"]) for r in without_near_duplicates(df).collect()), key=str)
    assert left == sorted([("7", a), ("7", b), ("5", "alone with more than five words"), (None, a)], key=str)


def test_repeated_rows_leave_one(spark):
    t = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(1, t, "y", 3), (1, t, "x", 3), (2, t, "x", 1), (3, None, "x", 1), (3, None, "x", 1)], "doc_id bigint, text string, Text string, keeper int")
    got = sorted((tuple(r) for r in without_near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, t, "x", 3), (3, None, "x", 1), (3, None, "x", 1)], key=str)
    assert without_near_duplicates(df.where("false")).count() == 0


def moved(spark, df):
    """Bytes that all shuffles of df() write, and its number of rows."""
    total = lambda: spark._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    before = total()
    n = len(df().collect())
    return total() - before, n


def test_texts_without_near_copies_do_not_move(spark):
    """Of 200 long texts one has a near copy."""
    rng = random.Random(3)
    texts = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(1500)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate([*texts, texts[7] + " tail"])), "doc_id bigint, text string").repartition(8)
    df.write.mode("overwrite").parquet(folder := tempfile.mkdtemp())
    size, df = sum(map(len, texts)), spark.read.parquet(folder)
    assert (bytes_ := moved(spark, lambda: near_duplicates(df)))[0] < 0.3 * size and bytes_[1] == 201
    assert (bytes_ := moved(spark, lambda: without_near_duplicates(df)))[0] < 0.4 * size and bytes_[1] == 200


def test_rows_that_a_filter_lets_pass(spark):
    rows = spark.range(20_000).selectExpr("id", "md5(cast(id as string)) as body").union(spark.createDataFrame([(None, None)], "id bigint, body string"))
    some = rows.where("id % 50 = 3")
    passed = rows.where(maybe_in(some, "id", "body"))
    assert passed.where("id % 50 = 3").count() == 400 and passed.count() < 4000
    assert rows.where(maybe_in(some.where("false"), "id", "body")).count() == 0
    assert rows.where(~maybe_in(rows, "id", "body")).count() == 0


def test_components_by_one_task_or_by_rounds(spark):
    rng = random.Random(6)
    for n in (0, 5, 400):
        edges = spark.createDataFrame([(rng.randrange(500), rng.randrange(500)) for _ in range(n)], "a bigint, b bigint").repartition(4)
        assert sorted(map(tuple, components(edges, 1000).collect())) == sorted(map(tuple, components(edges).collect()))

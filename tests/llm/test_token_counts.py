"""Token rollups: exact counts, deltas against a recount, idempotent commits, compaction."""

from pyspark.sql import functions as F

from citeloom.llm import token_counts as tc
from citeloom.llm._common import table
from citeloom.llm.queries import op5_token_counts

SF = "/root/testdata/sf0.001"


def totals(rollup):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"], r["chars"]) for r in rollup.totals().collect()}


def counted(spark, rows):
    return spark.createDataFrame(rows, "source string, lang string, tokens bigint, chars bigint")


def test_counts_equal_the_tokenizer(spark):
    path, pattern = tc.default_vocabulary()
    texts = ["Hello there, world", None, "", "naïve café 12345", " spaced   out\n\n lines ", "word " * 60_000, "x" * 1000, "  \n\n  tabs\t\t and 'll don't 12345 \u00a0\u3000x " * 9000 + "   "]
    docs = spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id bigint, text string, source string, lang string")
    got = {r["id"]: (r["tokens"], r["words"], r["chars"]) for r in tc.count_tokens(docs, path, pattern).collect()}
    enc = tc.encoding(open(path, "rb").read(), pattern)
    assert got == {i: (len(enc.encode_ordinary(t or "")), len((t or "").split()), len(t or "")) for i, t in enumerate(texts)}


def test_deltas_deletes_and_revisions(spark, tmp_path):
    r = tc.Rollup(spark, f"file://{tmp_path}/r")
    a, b = counted(spark, [("s", "en", 10, 50), ("s", "en", 5, 20), ("t", None, 7, 9)]), counted(spark, [("s", "en", 5, 20)])
    assert r.totals().count() == 0
    assert r.commit("one", tc.change(a, 1, "v1", "tokens"))
    assert not r.commit("one", tc.change(a, 1, "v1", "tokens"))
    assert r.commit("two", tc.change(b, -1, "v1", "tokens"))
    assert r.commit("three", tc.change(b.withColumn("tokens", F.lit(7)), 1, "v2", "tokens"))
    assert r.commit("none", tc.change(a.where("false"), 1, "v1", "tokens"))
    want = {("s", "en", "v1"): (1, 10, 50), ("t", None, "v1"): (1, 7, 9), ("s", "en", "v2"): (1, 7, 20)}
    assert totals(r) == want and r.committed() == {"one", "two", "three", "none"}
    r.compact()
    assert totals(r) == want and not r.commit("two", tc.change(b, -1, "v1", "tokens"))
    assert r.commit("four", tc.change(counted(spark, [("t", None, 7, 9)]), -1, "v1", "tokens"))
    assert totals(r)["t", None, "v1"] == (0, 0, 0)
    r.compact()
    assert ("t", None, "v1") not in totals(r)


def test_a_failed_write_leaves_nothing_that_counts(spark, tmp_path):
    r = tc.Rollup(spark, f"file://{tmp_path}/r")
    a = counted(spark, [("s", "en", 1, 1)])
    tc.change(a, 1, "v", "tokens").write.parquet(f"file://{tmp_path}/r/.half")
    assert totals(r) == {} and r.commit("one", tc.change(a, 1, "v", "tokens")) and totals(r) == {("s", "en", "v"): (1, 1, 1)}


def test_query_equals_a_recount(spark):
    path, pattern = tc.default_vocabulary()
    enc = tc.encoding(open(path, "rb").read(), pattern)
    want = {}
    for r in table(spark, SF, "documents").collect():
        words = len((r["text"] or "").split())
        if words:
            for name, n in (("byte_bpe_50k", len(enc.encode_ordinary(r["text"]))), ("words", words)):
                k = (r["source"], r["lang"], name)
                d, t, c = want.get(k, (0, 0, 0))
                want[k] = (d + 1, t + n, c + len(r["text"]))
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"], r["chars"]) for r in op5_token_counts(spark, SF).collect()}
    assert {k: v for k, v in got.items() if v != (0, 0, 0)} == want


def test_of_two_writers_one_is_late(spark, tmp_path, monkeypatch):
    r = tc.Rollup(spark, f"file://{tmp_path}/r")
    a = tc.change(counted(spark, [("s", "en", 1, 1)]), 1, "v", "tokens")
    # the second writer has looked before the first one's batch was there
    assert r.commit("one", a)
    monkeypatch.setattr(r, "committed", set)
    assert not r.commit("one", a)
    exists = r._fs

    class Blind:
        def exists(self, path):
            return not str(path).endswith("batch=one") and exists.exists(path)

        def __getattr__(self, name):
            return getattr(exists, name)

    monkeypatch.setattr(r, "_fs", Blind())
    assert not r.commit("one", a)
    monkeypatch.undo()
    assert totals(r) == {("s", "en", "v"): (1, 1, 1)} and len([x for x in (tmp_path / "r").rglob("*") if x.name.startswith(".") and x.is_dir()]) == 0


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "en", 7, "x")], "doc_id bigint, text string, source string, lang string, tokens int, Words string")
    assert [(r["tokens"], r["words"]) for r in tc.count_tokens(docs, *tc.default_vocabulary()).collect()] == [(2, 2)]

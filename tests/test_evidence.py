"""Grounding, cells, ledgers, themes and summaries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.operators import evidence as ev
from citeloom.operators import extract, group, summary, verify

SCHEMA = "entity string, question string, value string, quote string, source_url string, verified boolean, score double, match_type string, semantic double, ord bigint"


def rows(spark, *data):
    full = [("E", "Q", v, q, u, ok, 100.0 if ok else None, "exact" if ok else "none", s, i) for i, (v, q, u, ok, s) in enumerate(data)]
    return spark.createDataFrame(full, SCHEMA)


def cell(df, **kw):
    return ev.aggregate_cells(df, **kw).first()


def test_conflict_and_verification(spark):
    c = cell(rows(spark, ("unverified value", "q", "u1", False, None), ("verified value", "q", "u2", True, None)), fuzzy=False)
    assert c["num_unique_values"] == 2 and c["has_conflict"] and c["num_sources"] == 2 and not c["verified"]


def test_spelling_variants_are_one_value(spark):
    c = cell(rows(spark, ("Acme North America", "q", "u", True, None), ("acme   north america", "q", "u", True, None), ("Acme North America", "q", "v", True, None)))
    assert c["num_evidence"] == 2 and c["values"] == ["Acme North America"] and not c["has_conflict"]


def test_lists_and_sentinels(spark):
    five = rows(spark, *((f"claim number {w}", "q", "u", True, None) for w in ("apple", "zebra", "house", "music", "light")))
    assert cell(five, fuzzy=False, list_questions=spark.createDataFrame([("Q",)], "question string"))["has_conflict"] is False
    real = cell(rows(spark, ("None (not disclosed on site)", "", "u", False, None), ("Oslo", "q", "v", True, None)))
    assert real["values"] == ["Oslo"] and real["num_unique_values"] == 1 and not real["has_conflict"]
    none = cell(rows(spark, ("None (not disclosed on site)", "", "u", False, None)))
    assert none["values"] == ["None (not disclosed on site)"] and none["num_unique_values"] == 0


def test_first_match_depends_on_order(spark):
    a, b = "alpha beta gamma delta", "alpha beta gamma delto"
    assert cell(rows(spark, (a, "q", "u", True, None), (b, "q", "u", True, None)))["values"] == [a]
    assert cell(rows(spark, (b, "q", "u", True, None), (a, "q", "u", True, None)))["values"] == [b]


def test_rank_puts_soft_matches_with_the_rest(spark):
    df = rows(spark, ("a", "q", "u", True, 0.1), ("b", "q", "u", True, 0.9), ("c", "q", "u", False, None)).withColumn("match_type", F.when(F.col("ord") == 0, "exact").when(F.col("ord") == 1, "fuzzy_soft").otherwise("none"))
    assert [r["value"] for r in ev.ranked(df).orderBy("rank").collect()] == ["a", "b", "c"]


def test_claim_ids_run_past_four_digits(spark):
    df = spark.range(12_000).select(F.col("id").alias("ord"), F.lit("e").alias("entity"))
    got = {r["ord"]: r["claim_id"] for r in ev.claim_ids(df, 7).collect()}
    assert got[0] == "C0001" and got[9_998] == "C9999" and got[11_999] == "C12000" and len(set(got.values())) == 12_000


def test_grounding(spark):
    docs = spark.createDataFrame([(1, "X reports lower climate impact from oat-based drinks. More text here."), (2, None), (3, "-x")], "doc_id bigint, text string")
    quotes = spark.createDataFrame([(1, "lower climate impact"), (2, "reports lower climate impact from oat"), (3, "absent words that are long enough"), (4, ""), (5, None), (6, "-x")], "item_id bigint, text string")
    got = sorted((r["item_id"], r["doc_id"], r["char_start"], r["char_end"]) for r in verify.ground_exact(quotes, docs).collect())
    assert got == [(1, 1, 10, 30), (2, 1, 2, 39), (6, 3, 0, 2)]


def test_grounding_finds_every_literal_occurrence(spark):
    """Quotes that begin or end inside a word, follow a letter, have no word start or no letter at all, against plain search."""
    pages = ["xxunbelievable stories about the long winter nights ahead", "The unbelievable stories about the long winter nights", "a_b++c==d one two", "ÄÖÜ straßenbahn fährt über die lange brücke heute abend", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", ""]
    quotes = ["believable stories about the long winter ni", "unbelievable stories about the long winter nights ahead", "++c==", "e", "ßenbahn fährt über die lange brücke", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", " stories about the long wi", "stories about the long winter nights"]
    want = sorted((i, d, t.find(q), t.find(q) + len(q)) for i, q in enumerate(quotes) for d, t in enumerate(pages) if q in t)
    q, p = spark.createDataFrame(list(enumerate(quotes)), "item_id bigint, text string"), spark.createDataFrame([*enumerate(pages), (99, None)], "doc_id bigint, text string")
    for most in (100_000, 2):
        got = sorted((r["item_id"], r["doc_id"], r["char_start"], r["char_end"]) for r in verify.ground_exact(q, p, most).collect())
        assert got == want


def test_verify_quotes(spark):
    page = "X reports lower climate impact from oat-based drinks."
    long = "the first twenty characters are here " + "completely different middle part of text " * 2 + "and the last twenty are"
    pairs = [("lower climate impact", page), ("lower climate impacts", page), (None, page), ("zzz qqq www", page), (long, long.replace("different middle", "unlike xxxxxx"))]
    got = {r["quote"]: r for r in verify.verify_quotes(spark.createDataFrame(pairs, "quote string, page_text string")).collect()}
    assert (got["lower climate impact"]["match_type"], got["lower climate impact"]["char_start"], got["lower climate impact"]["score"]) == ("exact", 10, 100.0)
    assert got["lower climate impacts"]["match_type"] == "fuzzy" and got["lower climate impacts"]["char_start"] is None
    assert got[None]["verified"] is False and got[None]["score"] is None and got["zzz qqq www"]["match_type"] == "none"


def test_themes(spark):
    rng = np.random.default_rng(1)
    data = [("E", "Q", f"v{k}{i}", (np.eye(4)[k] + rng.normal(size=4) * 0.02).tolist(), 10 * k + i) for k, n in enumerate((3, 3, 1)) for i in range(n)]
    got = group.themes(spark.createDataFrame(data, "entity string, question string, value string, vector array<double>, ord bigint")).orderBy("place").collect()
    assert [r["n_items"] for r in got] == [3, 3, 1] and sorted(v for r in got for v in r["values"]) == sorted(x[2] for x in data)
    few = group.themes(spark.createDataFrame(data[:5], "entity string, question string, value string, vector array<double>, ord bigint")).first()
    assert few["theme"] == "(all items)" and few["n_items"] == 5


def test_summary_gate(spark):
    text = "Made in Oslo [C0001]. Founded by Acme Ltd. in 1990 [C0002]."
    s = spark.createDataFrame([("E", "Q", text), ("E", "R", "Invented [C0099]. No source."), ("E", "S", "")], "entity string, question string, summary string")
    shown = spark.createDataFrame([("E", q, ["C0001", "C0002"]) for q in "QRS"], "entity string, question string, ids array<string>")
    themes = spark.createDataFrame([("E", "Q", "t", 1, ["C0002"], 1), ("E", "R", "t", 1, ["C0001"], 1)], "entity string, question string, theme string, n_items int, claim_ids array<string>, place int")
    got = {r["question"]: r for r in summary.gate(s, shown, themes).collect()}
    assert got["Q"]["passed"] and not got["R"]["passed"] and not got["S"]["passed"]
    assert got["R"]["invented"] == ["C0099"] and got["R"]["uncited"] == 1 and got["R"]["missed"] == ["t"]
    assert len(summary.split_units(text)) == 2


def test_planted_errors_change_the_named_units(spark):
    s = spark.createDataFrame([("Acme", "Q", "Acme has 120 staff [C0001]. It sits in Oslo [C0002].")], "entity string, question string, summary string")
    got = {r["kind"]: r for r in summary.plant(s).collect()}
    assert set(got) == set(summary.CORRUPTIONS) and got["reattach_citation"]["wrong"] == [1, 2] and "120" not in got["swap_number"]["summary"]
    said = spark.createDataFrame([("Acme", "Q", "swap_number", 1, "contradicted")], "entity string, question string, kind string, unit int, verdict string")
    hits = {r["kind"]: r["hits"] for r in summary.detection(summary.plant(s), said).collect()}
    assert hits["swap_number"] == 1 and hits["inject_fact"] == 0


def test_verdicts_are_all_or_nothing():
    assert summary.parse_verdicts('```json\n{"1": "Faithful", "2": "unsupported"}\n```', 2) == {1: "faithful", 2: "unsupported"}
    for bad in ('{"1": "faithful"}', '{"1": "x", "2": "faithful"}', "no", '["faithful"]'):
        assert summary.parse_verdicts(bad, 2) is None


def test_extraction_uses_the_cache_and_keeps_errors(spark):
    pages = spark.createDataFrame([("u1", "text one"), ("u2", "text two"), ("u3", "boom")], "url string, text string")

    def model(body, questions, entities):
        if body == "boom":
            raise RuntimeError("no")
        return {"acme": {"hq": [{"value": "Oslo", "quote": None}, {"value": "Oslo", "quote": body}], "Other": "x"}}

    q = [{"question": "HQ", "instruction": ""}]
    first = extract.extract(extract.page_chunks(pages), q, ["Acme"], model)
    got = {r["url"]: r for r in first.collect()}
    assert got["u3"]["error"].startswith("RuntimeError") and got["u1"]["raw"]
    cache = first.where("raw is not null").select("key", "raw")

    def never(body, questions, entities):
        raise AssertionError("the cache has it")

    again = {r["url"]: r["error"] for r in extract.extract(extract.page_chunks(pages.where("url < 'u3'")), q, ["Acme"], never, cache=cache).collect()}
    assert again == {"u1": None, "u2": None}
    merged = extract.merge(first, q, ["Acme"]).orderBy("url").collect()
    assert [(r["url"], r["value"], r["quote"]) for r in merged] == [("u1", "Oslo", "text one"), ("u2", "Oslo", "text two")]


def test_a_busy_model_is_called_again():
    class Busy(Exception):
        status_code = 502

    calls = []

    def model(fail, error):
        calls.append(error)
        if len(calls) <= fail:
            raise error
        return "done"

    assert extract.patient(model, 3, 0.0)(2, Busy()) == "done" and len(calls) == 3
    for error, times in ((Busy(), 2), (TimeoutError(), 1), (ValueError(), 1)):
        calls.clear()
        with pytest.raises(type(error)):
            extract.patient(model, 2, 0.0)(9, error)
        assert len(calls) == times


def test_sums_beyond_bigint_are_whole(spark):
    from decimal import Decimal

    from citeloom.plans.evidence import whole_sums

    df = spark.createDataFrame([("a", 2**62), ("a", 2**62), ("b", 1)], "entity string, ord bigint")
    sums = lambda d: whole_sums(d.groupBy("entity").agg(F.sum(F.col("ord").cast("decimal(19,0)")).alias("ords")), "ords")
    assert {tuple(r) for r in sums(df).collect()} == {("a", Decimal(2**63)), ("b", Decimal(1))}
    small = sums(df.where("ord = 1"))
    assert small.dtypes[1] == ("ords", "bigint") and small.first()["ords"] == 1


def test_the_invented_id_stays_invented_where_a_claim_has_it(spark):
    from citeloom.plans.runs import _gated

    c = spark.createDataFrame([("a", "Q", "C9999998", "Yes", 1), ("a", "Q", "C9999999", "Yes", 2), ("b", "Q", "C10000000", "no.", 3)], "entity string, question string, claim_id string, value string, ord int")
    got = {r["entity"]: (r["passed"], r["invented"], r["uncited"], r["missed"]) for r in _gated(c).collect()}
    # as the query's SQL: b = 'C9999999' is invented
    assert got == {"a": (False, "C9999999", 0, ""), "b": (True, "", 0, "")}


def test_cells_read_evidence_once(spark):
    rows = [("A", "Q", f"Value {k % 5}", f"q{k % 3}", f"u{k % 4}" if k % 4 else None, k % 7 > 0, float(k), k) for k in range(60)] + [("A", "Q", "None (not disclosed)", None, "u9", False, 1.0, 99), ("B", "Q", "none (not disclosed)", None, "", None, None, 7)]
    schema = "entity string, question string, value string, quote string, source_url string, verified boolean, score double, ord int"
    df = spark.createDataFrame(rows, schema)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    for fuzzy in (False, True):
        before = seen.value
        a, b = sorted(ev.aggregate_cells(df.mapInArrow(count, schema), fuzzy=fuzzy).collect())
        assert seen.value - before == len(rows)
        assert a["values"] == ([f"Value {k}" for k in range(5)] if not fuzzy else ["Value 0"]) and a["source_urls"] == ["u1", "u2", "u3", "u9"] and a["num_evidence"] == 60 and not a["verified"]
        assert a["verification_score"] == 29.5 and a["num_unique_values"] == (1 if fuzzy else 5)
        assert (b["values"], b["num_evidence"], b["verified"], b["verification_score"], b["num_unique_values"], b["source_urls"]) == (["none (not disclosed)"], 1, False, None, 0, [])


def test_claims_are_numbered_by_more_tasks_as_they_grow(spark):
    df = spark.range(3000).select(((F.col("id") * 7919) % 3000).alias("ord"), F.lit("E").alias("entity"), F.lit("Q").alias("question"), (F.col("id") % 3).cast("string").alias("value"), (F.col("id") % 2 == 1).alias("verified"))
    out = ev.claim_ids(df, 5, rows_a_task=100)
    assert {r["ord"]: r["claim_id"] for r in out.collect()} == {k: f"C{k + 1:04d}" for k in range(3000)}
    sizes = out.groupBy(F.spark_partition_id()).count().collect()
    assert out.rdd.getNumPartitions() == 30 and max(r["count"] for r in sizes) < 600
    index = ev.claim_index(out)
    assert "SortAggregate" not in index._jdf.queryExecution().executedPlan().toString()
    first = {}
    for r in out.orderBy(~F.col("verified"), "ord").collect():
        first.setdefault(r["value"], r["claim_id"])
    assert {r["norm"]: r["claim_id"] for r in index.collect()} == first


def test_chunks_become_objects_a_few_at_a_time(spark):
    q = [{"question": "Q", "instruction": ""}]
    chunks = spark.range(500).coalesce(1).select(F.concat(F.lit("u"), "id").alias("url"), F.lit(0).alias("chunk"), F.col("id").cast("string").alias("body"))
    got = extract.extract(chunks, q, ["Acme"], lambda body, questions, entities: {"Acme": {"Q": {"value": body}}})
    assert str(got._jdf.queryExecution().executedPlan().toString()).count("MapInArrow") == 1
    sizes = extract.by_slices(chunks, lambda frames: (f.assign(n=len(f))[["n"]].head(1) for f in frames), "n int")
    assert {r["n"] for r in sizes.collect()} == {64, 500 % 64}
    assert {(r["url"], r["value"]) for r in extract.merge(got, q, ["Acme"]).collect()} == {(f"u{k}", str(k)) for k in range(500)}

"""Statistics, evaluation, shortlist, routing, resolution, sources and streams."""

import random

import pytest
from pyspark.sql import functions as F

from citeloom.operators import evaluate, links, readings, resolve, routing, shortlist, stats
from citeloom.sources import request, tables, workbook
from citeloom.streaming import windows


def test_rank_auc_equals_pairwise(spark):
    rng = random.Random(1)
    data = [("g", rng.randrange(8) / 8, rng.random() < 0.4) for _ in range(200)] + [("one", 0.5, True)]
    got = {r["g"]: r["auc"] for r in stats.auc(spark.createDataFrame(data, "g string, score double, label boolean"), ["g"]).collect()}
    pos, neg = [s for g, s, y in data if g == "g" and y], [s for g, s, y in data if g == "g" and not y]
    assert got["g"] == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)) and got["one"] is None


def test_bootstrap_finds_a_clear_winner(spark):
    rng = random.Random(2)
    data = [("q", y := rng.random() < 0.5, rng.random(), y + rng.random() * 0.1) for _ in range(120)]
    df = spark.createDataFrame(data, "g string, label boolean, a double, b double")
    r = stats.auc_difference(df, ["g"], "a", "b", resamples=200).first()
    assert r["winner"] == "b" and r["low"] > 0
    same = stats.auc_difference(df.withColumn("b", F.col("a")), ["g"], "a", "b", resamples=50)
    assert same.first()["winner"] == "none" and same.collect() == stats.auc_difference(df.withColumn("b", F.col("a")), ["g"], "a", "b", resamples=50).collect()


def test_typed_matching():
    assert evaluate.pair_score("2,003", "2003")[2] == 1 and evaluate.pair_score("2003", "2004")[2] == 0
    assert evaluate.pair_score("Yes", "No")[2] == 0 and evaluate.pair_score("No", "false")[2] == 1


def test_matching_prefers_the_best_pairs_and_later_ties():
    t = [{"value": v} for v in ("alpha beta", "gamma delta")]
    a = [{"value": v} for v in ("gamma delta", "alpha betas", "something else", "None (not disclosed)")]
    got = evaluate.match_cell(t, a)
    assert [(r["truth"], r["answer"], r["verdict"]) for r in got if r["kind"] == "pair"] == [("alpha beta", "alpha betas", "auto_match"), ("gamma delta", "gamma delta", "auto_match")]
    assert [r["answer"] for r in got if r["kind"] == "ai_only"] == ["something else"] and [r["answer"] for r in got if r["kind"] == "suppressed_null"] == ["None (not disclosed)"]
    tied = evaluate.match_cell([{"value": "same words"}, {"value": "words same"}], [{"value": "same words"}])
    assert [r["answer"] for r in tied] == [None, "same words"]
    assert evaluate.match_cell([{"value": "n/a"}], [{"value": "not disclosed"}])[0]["verdict"] == "null_match"


def test_metrics_of_empty_denominators(spark):
    t = spark.createDataFrame([("E", "Q", "x", "", False, 1)], "entity string, question string, value string, quote string, is_list boolean, ord bigint")
    a = spark.createDataFrame([], "entity string, question string, value string, quote string, verified boolean, match_type string, source_url string, ord bigint")
    r = evaluate.metrics(evaluate.align(t, a)).where("question = 'Q'").first()
    assert (r["tp"], r["fn"], r["fp"], r["precision"], r["recall"], r["f1"], r["hallucination"]) == (0, 1, 0, 1.0, 0.0, 0.0, 0.0)


def reader(spark, parser):
    def read(raw, year=2026, max_age=None):
        df = spark.createDataFrame([(parser, raw, max_age)], "parser string, raw string, max_age int")
        return df.select(readings.reading(F.col("parser"), F.col("raw"), F.col("max_age"), readings.Guide(year)).alias("r")).first()["r"]

    return read


def test_cells_are_aligned_by_batches(spark):
    t = spark.createDataFrame([(f"E{k}", "Q", v, "a quote", False, j) for k in range(70) for j, v in enumerate(("red brick", "grey slate"))], "entity string, question string, value string, quote string, is_list boolean, ord int")
    a = spark.createDataFrame([(f"E{k}", "Q", v, "a quote", None, None, "u", j) for k in range(70) for j, v in enumerate(("brick red", "blue glass"))], "entity string, question string, value string, quote string, verified boolean, match_type string, source_url string, ord int")
    out = evaluate.align(t, a)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan
    want = evaluate.match_cell([{"value": "red brick", "quote": "a quote"}, {"value": "grey slate", "quote": "a quote"}], [{"value": "brick red", "quote": "a quote"}, {"value": "blue glass", "quote": "a quote"}])
    got = out.collect()
    assert len(got) == 70 * len(want)
    for e in ("E0", "E69"):
        assert sorted(str({k: r[k] for k in want[0]}) for r in got if r["entity"] == e) == sorted(map(str, want))


def test_counts(spark):
    p = reader(spark, "count")
    assert p("1,200")["value"] == 1200 and p("more than 6,000")["lo"] == 6000 and p("more than 6,000")["hi"] is None and p("more than 6,000")["flags"] == ["QUALIFIED"]
    assert p("around 1,530")["hi"] == 1530 and "STALE" in p("15 (2005)", 2026, 10)["flags"] and not p("more than 100 skilled engineers")["ok"]
    assert p("100 to 200")["flags"] == ["RANGE"] and p("100 to 200")["value"] == 150
    assert p("100–200 (as of 2001)", 2026, 3)["flags"] == ["RANGE"] and p("50 (Acme Group)")["flags"] == ["ANNOTATION"] and p("50+")["hi"] is None
    assert p("40 (planned)")["reason"] == "not_current guard" and p("many")["flags"] == [] and p(None) is None
    b = reader(spark, "binary")
    assert (b(" Yes. ")["value"], b("FALSE")["value"], b("maybe")["reason"]) == (1.0, 0.0, "not a bare yes or no") and not reader(spark, "other")("x")["ok"]


def test_guide_from_rows(spark):
    g = readings.Guide.read(spark.createDataFrame([("rate", "usd", "1"), ("rate", "JPY", "0.01"), ("guard", "subset", "Pilots"), ("phrase", "make", "build to print")], "kind string, name string, value string"))
    assert g.rates == {"USD": 1.0, "JPY": 0.01} and g.guards["subset"] == ["pilots"] and g.guards["forecast"] == readings.GUARDS["forecast"] and g.phrases == {"make": ["build to print"]}


def test_money(spark):
    p = reader(spark, "money")
    assert p("-12.50 USD")["value"] == 12.5 and p("CHF 5m - CHF 7m")["hi"] == pytest.approx(7.7e6) and p("5 GBP (outlook 2027)")["flags"] == ["FORECAST"]
    assert p("about 3bn EUR (FY 2019)", 2026, 3)["flags"] == ["QUALIFIED", "STALE"] and p("1 to 2 million")["flags"] == ["NO_CURRENCY", "RANGE"]
    assert p("$29.8B (Fiscal Year 2025)")["value"] == pytest.approx(29.8e9) and p("$29.8B (Fiscal Year 2025)")["vintage"] == 2025
    assert p("£45M (2026)")["value"] == pytest.approx(45e6 * 1.27) and p("1,426.50 MSEK")["value"] == pytest.approx(1426.5e6 * 0.095)
    assert p("2+ billion")["flags"] == ["NO_CURRENCY", "QUALIFIED"] and p("2+ billion")["lo"] == 2e9 and p("2+ billion")["hi"] is None
    assert "RANGE" in p("$100 million to $500 million")["flags"] and p("$5M (Parent Corp)")["flags"] == ["PARENT_ATTRIBUTED"]
    assert p("4, 153 million SEK")["value"] == pytest.approx(4153e6 * 0.095) and not p("substantial")["ok"]


def test_gates_and_ranks(spark):
    spec = spark.createDataFrame([("own", "independent", "hard_gate", "binary", "require_yes", None, None, 0.0, "flag", "verified_only", None, 1), ("size", "staff", "hard_gate", "count", "max", None, 10_000.0, 0.0, "flag", "use_flagged", None, 2), ("med", "medical", "scored", "binary", "prefer_yes", None, None, 1.0, "flag", "use_flagged", None, 3)], "id string, question string, type string, parser string, direction string, lo double, hi double, weight double, missing_policy string, unverified_policy string, max_age int, ord int")
    item = lambda v, ok=True: [(v, ok)]
    cells = [
        ("alpha", "independent", "VALUE", item("Yes"), []), ("alpha", "staff", "VALUE", item("over 1,500"), []), ("alpha", "medical", "VALUE", item("Yes"), []),
        ("beta", "independent", "VALUE", item("No"), []), ("beta", "staff", "VALUE", item("over 20,000"), []),
        ("gamma", "independent", "ND", [], []), ("gamma", "staff", "VALUE", item("many"), []), ("gamma", "medical", "VALUE", item("No"), []),
        ("delta", "independent", "VALUE", item("No", False), []), ("delta", "staff", "VALUE", item("over 20,000"), []),
    ]
    cells = spark.createDataFrame(cells, "entity string, question string, state string, items array<struct<raw:string,verified:boolean>>, flags array<string>")
    got = {r["entity"]: r for r in shortlist.run(cells, spec).collect()}
    assert got["beta"]["excluded_by"] == "own" and got["delta"]["excluded_by"] == "size" and got["alpha"]["total"] == 1.0 and got["gamma"]["total"] == 0.0
    assert (got["alpha"]["rank"], got["gamma"]["rank"], got["beta"]["rank"]) == (1, 2, None)
    rows = shortlist.judged(cells, spec.withColumnsRenamed({"lo": "lo_t", "hi": "hi_t"})).withColumnsRenamed({"lo": "plo", "hi": "phi"})
    labels = {(r["entity"], r["id"]): r["label"] for r in shortlist.gates(rows).collect()}
    assert labels["alpha", "size"] == "PASS (bound open)" and labels["gamma", "own"] == "PASS (not disclosed)" and labels["delta", "own"] == "PASS (unverified only)" and labels["gamma", "size"].startswith("PASS (unparseable")
    assert shortlist.perturbations(spec).select("change").distinct().count() == 8


def test_totals_round_as_sql_does(spark):
    import duckdb

    halves = [(k, (k * 100 + 50) / 1e6) for k in range(2000)] + [(2000 + k, (1 + 2 * ((k * 150 + 75) / 1e6)) / 3) for k in range(2000)]
    got = {r["k"]: r["x"] for r in spark.createDataFrame(halves, "k int, x double").select("k", shortlist._rounded(F.col("x")).alias("x")).collect()}
    assert got == {k: duckdb.execute("select round(?::double, 4)", [x]).fetchone()[0] for k, x in halves}


def test_legal_forms_say_nothing_about_a_company(spark):
    c = [(n, "", "https://acme.com/", "Acme makes robots", 0) for n in ("Acme", "Acme GmbH", "Acme Holdings Inc.")]
    got = {(r["name_score"], r["content_score"]) for r in resolve.score_candidates(spark.createDataFrame(c, "company string, context string, url string, body string, rank int")).collect()}
    assert got == {(1.0, 1.0)}


def test_vectors_raise_the_confidence(spark):
    c = [("Qq Zz", "", f"https://other{k}.com/", "plain text", 3, v, w) for k, (v, w) in enumerate([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), (None, [1.0]), ([0.0], [0.0])])]
    df = spark.createDataFrame(c, "company string, context string, url string, body string, rank int, query_vector array<double>, body_vector array<double>")
    got = {r["domain"]: r["boost"] for r in resolve.score_candidates(df).collect()}
    assert got == {"other0.com": 0.1, "other1.com": 0.0, "other2.com": 0.0, "other3.com": 0.0}


def test_keywords(spark):
    df = spark.createDataFrame([("A CMOS maker",), ("a CMO for you",), ("Build-to-Print parts",), (None,)], "t string")
    assert [r[0] for r in df.select(shortlist.keyword_hit(F.col("t"), ["cmo", "build to print"])).collect()] == [None, "cmo", "build to print", None]


def test_routing_drops_shared_words_and_falls_back(spark):
    q = spark.createDataFrame([(x,) for x in ("company revenue", "company staff", "company origin", "founding year")], "question string")
    assert {r["keyword"] for r in routing.question_keywords(q).collect()} == {"revenue", "staff", "origin", "founding", "year"}
    s = spark.createDataFrame([("u", "a", 0.4962), ("u", "b", 0.7), ("v", "a", 0.1), ("v", "b", 0.2)], "url string, question string, score double")
    got = {(r["url"], r["question"]): r["reason"] for r in routing.route(s).collect()}
    assert got == {("u", "a"): "below_threshold", ("u", "b"): "similarity", ("v", "a"): "fallback_all", ("v", "b"): "fallback_all"}
    assert routing.route(s, passthrough=True).where("not included").count() == 0


def test_scores_of_pages_move_no_pairs(spark):
    chunks = spark.createDataFrame([("u", [1.0, 0.0]), ("u", [0.6, 0.8]), ("v", None), ("w", [-1.0, 0.5]), ("x", [0.0, 0.0]), ("y", [1.0, None]), ("z", [1.0])], "url string, vector array<double>")
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("a", [0.0, -1.0])], "question string, vector array<double>")
    scores = routing.question_scores(chunks, q)
    got = {(r["url"], r["question"]): r["score"] for r in scores.collect()}
    assert got == {("u", "a"): 1.0, ("u", "b"): 0.8, ("w", "a"): -0.5 / 1.25**0.5, ("w", "b"): 1.0 / (1.25**0.5 * 2.0), ("z", "a"): None, ("z", "b"): None} | {(u, n): 0.0 for u in "vxy" for n in "ab"}
    log = routing.route(scores)
    plain = routing.route(scores.drop("best"))
    assert log.columns == plain.columns and sorted(map(str, log.collect())) == sorted(map(str, plain.collect()))
    claims = spark.createDataFrame([("u", "a"), ("u", "b"), ("u", "b"), ("w", "a"), ("x", "b")], "url string, question string")
    steps = [-0.5, 0.0, 0.5, 0.9]
    whole = routing.counterfactual_of(chunks, q, claims, steps)
    assert sorted(whole.collect()) == sorted(routing.counterfactual(log, claims, steps).collect())
    for df in (log, whole):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Window" not in plan


def test_links_and_crawl(spark):
    page = '<a href="/a">One</a><a href="/a#x">Again</a><a href="logo.png">i</a><a href="https://other.org/b">o</a><a href="mailto:x@y">m</a><a href=\'https://sub.t.com/c?utm_source=1\'>Two &amp; more</a>'
    pages = spark.createDataFrame([("https://t.com/", page), ("https://u.com/", None)], "url string, body string")
    got = {(r["target"], r["anchor"]) for r in links.discover(pages).collect()}
    assert got == {("https://t.com/a", "One"), ("https://sub.t.com/c", "Two & more")}
    assert {r["target"] for r in links.discover(pages, same_site=False).collect()} == {"https://t.com/a"}
    md = spark.createDataFrame([("https://t.com/", "see [A page](/x) now")], "url string, body string")
    assert links.discover(md, "markdown").first()["anchor"] == "A page"
    edges = spark.createDataFrame([("seed", "a", 0.9, 1), ("seed", "b", 0.5, 2), ("a", "a/deep", 0.8, 1), ("b", "seed", 1.0, 1)], "page string, target string, score double, ord bigint")
    seeds = spark.createDataFrame([("seed",)], "url string")
    assert {r["url"] for r in links.crawl(edges, seeds, 2, 3).collect()} == {"seed", "a", "b"}
    assert {(r["url"], r["depth"]) for r in links.crawl(edges, seeds, 5, 10).collect()} == {("seed", 0), ("a", 1), ("b", 1), ("a/deep", 2)}


def test_a_crawl_that_no_budget_cuts_keeps_its_last_wave_nowhere(spark, monkeypatch):
    from citeloom.operators import graph

    n = 40
    pairs = [(k, (k * 7 + j * j) % n) for k in range(0, n, 2) for j in range(4)] + [(2, None), (2, None)]
    edges = spark.createDataFrame([(a, b, 1.0, k) for k, (a, b) in enumerate(pairs)], "page bigint, target bigint, score double, ord bigint")
    seeds = spark.createDataFrame([(k,) for k in (0, 2, 5, 12)], "url bigint")
    want = {}
    for s in (0, 2, 5, 12):
        want[s, s], wave = 0, {s}
        for depth in (1, 2, 3):
            wave = {b for a, b in pairs if a in wave and (s, b) not in want}
            want |= {(s, b): depth for b in wave}
    kept = []
    monkeypatch.setattr(graph, "checkpointed", lambda df, f=graph.checkpointed: kept.append(df.columns) or f(df))
    for out in (links.crawl(edges, seeds, 3, n + 2), links._reached(edges, seeds, 3, longest=2), links._reached(edges, seeds, 3, least_parts=1)):
        assert sorted(map(str, out.collect())) == sorted(f"Row(seed={a}, url={b}, depth={d})" for (a, b), d in want.items())
    # the start, the links and two waves, and no column of places
    assert kept == [["seed", "url", "depth"], ["page", "part", "urls"], *[["seed", "url", "depth"]] * 2] * 3


def test_quality_gate(spark):
    long = "word " * 60
    rows = [("short", "x", "<body>x</body>"), ("links", long, f"<body>{'<a>aaaaaaaaaa</a>' * 50} {'b' * 60}</body>"), ("lost", long, f"<body>{'c' * 9000}</body>"), ("fine", long, f"<html><script>var x</script><body>{long}</body></html>"), ("null", None, None)]
    got = {r["url"]: (r["passed"], r["reason"]) for r in links.quality_gate(spark.createDataFrame(rows, "url string, content string, body string")).collect()}
    assert got == {"short": (False, "content_chars"), "links": (False, "link_density"), "lost": (False, "content_ratio"), "fine": (True, ""), "null": (False, "content_chars")}


def test_resolution(spark):
    c = [("Acme Robotics Inc", "robots", "https://www.acmerobotics.com/", "Acme Robotics builds robots", 1), ("Acme Robotics Inc", "robots", "https://linkedin.com/acme", "Acme Robotics", 0), ("Acme Robotics Inc", "robots", "https://acmerobotics.com/about", "", 3), ("Zzz", "", "https://www.unrelated.org", "", 0)]
    got = {r["company"]: r for r in resolve.resolve(resolve.score_candidates(spark.createDataFrame(c, "company string, context string, url string, body string, rank int"))).collect()}
    assert got["Acme Robotics Inc"]["resolved"] == "https://www.acmerobotics.com/" and not got["Acme Robotics Inc"]["needs_review"] and got["Zzz"]["needs_review"]
    near = resolve.nearest_names(spark.createDataFrame([("Acme Robotic GmbH",), ("Qqqq",)], "name string"), spark.createDataFrame([("Acme Robotics Inc",), ("Other Works",)], "name string"))
    assert {r["name"]: r["kind"] for r in near.collect()} == {"Acme Robotic GmbH": "confident", "Qqqq": "no_match"}


def test_workbooks():
    rows = {"A & B": [["x", None, 1.5], [], ["ü\n<&>", True, 3]], "two": [[]]}
    got = workbook.read_sheets(workbook.write_sheets(rows))
    assert list(got) == ["A & B", "two"] and got["A & B"] == [["x", None, 1.5], [], ["ü\n<&>", True, 3.0]]


def test_requests():
    book = {"entities": [["Entity"], ["A"], ["B"], ["A"], [" "]], "urls": [["Page URL", "Depth", "Entities"], ["a.com", 1, "A"], ["https://b.org", None, None]], "questions": [["Question", "Instructions"], ["HQ", "one per site"]], "config": [["setting", "value"], ["crawl_max_pages", 5.0], ["filter_enabled", "yes"]]}
    r = request.read_request(workbook.write_sheets(book))
    assert r["entities"] == ["A", "B"] and [u["url"] for u in r["urls"]] == ["https://a.com", "https://b.org"] and r["urls"][1]["entities"] == ["A", "B"] and r["settings"] == {"crawl_max_pages": 5, "filter_enabled": True}
    for sheet, bad in (("urls", [["url", "entities"], ["a.com", "C"]]), ("questions", [["question"], ["q"], ["q"]]), ("config", [["setting", "value"], ["nope", 1]]), ("urls", [["url", "depth"], ["a.com", -1]])):
        with pytest.raises(ValueError):
            request.read_request(workbook.write_sheets(book | {sheet: bad}))
    assert request.read_request(workbook.write_sheets({"links": [["url"], ["x.com"]]}))["entities"] == ["https://x.com"]


def test_matrix_cells_and_truth(spark):
    m = spark.createDataFrame([("A", "(sources conflict)\n- one\n- two\n-- Unverified --\n- three\n[+2 more items — see Provenance]", "No data found")], "entity string, q1 string, q2 string")
    got = {(r["question"], r["value"]): (r["status"], r["verified"]) for r in tables.matrix_cells(m, ["q1", "q2"]).collect()}
    assert got == {("q1", "one"): ("CONFLICT", True), ("q1", "two"): ("CONFLICT", True), ("q1", "three"): ("CONFLICT", False), ("q2", "No data found"): ("NO_DATA", True)}
    t = spark.createDataFrame([(1, "A", "x; y"), (2, None, "- z\n- n/a")], "k int, who string, q string")
    rows = tables.unpivot_truth(t, "who", "k", ["q"]).orderBy("k", "pos").collect()
    assert [(r["entity"], r["value"], r["is_list"]) for r in rows] == [("A", "x", True), ("A", "y", True), ("A", "z", True), ("A", "None (not disclosed)", True)]


def test_page_cache(spark, tmp_path):
    pages = spark.createDataFrame([("u1", "old", 1), ("u1", "new", 2), ("u2", " ", 1)], "url string, text string, fetched_at int")
    tables.to_cache(pages, f"{tmp_path}/c")
    hits, misses = tables.from_cache(spark.createDataFrame([("u1",), ("u2",)], "url string"), spark.read.parquet(f"{tmp_path}/c"))
    assert [tuple(r) for r in hits.collect()] == [("u1", "new")] and [r["url"] for r in misses.collect()] == ["u2"]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = windows.tumbling(stream).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("w").withColumn("total", F.round("total", 4))
    assert got.exceptAll(windows.tumbling(events).withColumn("total", F.round("total", 4))).count() == 0 and got.count() > 0
    q = windows.first_arrivals(stream, "user_id").writeStream.format("memory").queryName("f").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("f").count() >= events.select("user_id").distinct().count()


def test_acquisition(spark):
    from citeloom.operators import acquire

    long = "word " * 60
    static = acquire.from_table({"https://a.com/1": (long, "<p>"), "https://a.com/2": ("thin", "<p>"), "https://b.com/1": ("x" * 300, "<p>")})
    render = acquire.from_table({"https://a.com/2": (long + "rendered", "<p>")})
    gate = lambda t, h: (len(t.strip()) >= 250 and "x" not in t, "thin")
    pages = spark.createDataFrame([("https://a.com/1",), ("https://a.com/2",), ("https://b.com/1",), ("https://b.com/private",), ("https://c.com/",), ("https://d.com/",)], "url string")
    robots = spark.createDataFrame([("b.com", "User-agent: *\nDisallow: /private")], "domain string, robots string")
    cache = spark.createDataFrame([("https://d.com/", "old", 1), ("https://d.com/", "kept", 2)], "u string, text string, fetched_at int").select(F.sha2("u", 256).alias("key"), "text", "fetched_at")
    got = {r["url"]: r for r in acquire.acquire(pages, cache, lambda u: acquire.hybrid(u, static, render, gate), robots=robots, delay=0.0).collect()}
    assert {u: (r["status"], r["backend"]) for u, r in got.items()} == {"https://a.com/1": ("ok", "static"), "https://a.com/2": ("ok", "render"), "https://b.com/1": ("ok", "static"), "https://b.com/private": ("gate_failed", None), "https://c.com/": ("error", None), "https://d.com/": ("cached", "cache")}
    assert got["https://b.com/1"]["reason"].startswith("rescued") and got["https://d.com/"]["text"] == "kept"


def test_audit(spark):
    from citeloom.operators import audit

    t = spark.createDataFrame([("E", "Q", "1", "q1", "alpha beta", "", False, 1), ("E", "Q", "2", "q1", "alpha betas", "", False, 2), ("E", "Q", "3", None, "omega", "", False, 3)], "entity string, question string, claim_id string, quote_id string, value string, quote string, is_list boolean, ord int")
    a = spark.createDataFrame([("E", "Q", v, "", ok, k) for k, (v, ok) in enumerate([("alpha beta", True), ("Alpha betas!", True), ("users 1,000", False), ("new thing", True), ("wrong thing here", False), ("None (not disclosed)", False)])], "entity string, question string, value string, quote string, verified boolean, ord int")
    x = spark.createDataFrame([("E", "users 1,000", "dynamic_counter")], "entity string, statement string, category string")
    r = audit.audit(t, a, x).first()
    assert (r["active"], r["tp"], r["redundant"], r["possible_gap"], r["hallucination"], r["dynamic_neutral"]) == (3, 1, 1, 1, 1, 2)
    assert r["recall_full"] == round(2 / 3, 4) and audit.macro(audit.audit(t, a, x), ["question"]).count() == 2
    assert audit.name_contained("Acme Inc", "Acme Robotics GmbH") and not audit.name_contained("Acme", "Zeta")


def test_link_scores_by_vectors(spark):
    df = spark.createDataFrame([("p", "https://t.com/a", [1.0, 0.0]), ("p", "https://t.com/b", [0.0, 1.0])], "page string, target string, vector array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.2])], "question string, vector array<double>")
    got = {r["target"]: r["score"] for r in links.embedding_scores(df, q, [1.0, 0.0], [0.0, 1.0]).collect()}
    assert got["https://t.com/a"] > 1 > got["https://t.com/b"]
    rows = spark.createDataFrame([("", "", "https://t.com/a/b/c/7"), ("Our contract manufacturing services", "they help many firms with their parts", "https://t.com/x")], "anchor string, context string, target string")
    assert [round(r[0], 2) for r in rows.select(links.structural_penalty(F.col("anchor"), F.col("context"), F.col("target"), ["menu"])).collect()] == [0.40, 0.0]
    assert [r[0] for r in rows.select(links.link_title(F.col("anchor"), F.col("target"))).collect()] == ["c 7", "Our contract manufacturing services"]

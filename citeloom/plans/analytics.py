"""Queries of the statistics, evaluation, shortlist, routing, grouping and resolution operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vector
from ..operators import evaluate, group, resolve, routing, shortlist, stats
from .relations import CLAIMS, claims, read

STEPS = [0.2, 0.4, 0.6, 0.8]


def scored_labels(spark, d):
    """A score of each labelled document: how its length compares with 4000 characters."""
    docs = read(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    rows = docs.join(read(spark, d, "labels"), "doc_id")
    return rows.select("doc_id", "source", "lang", F.least(F.lit(1.0), F.floor(F.col("n_chars") / 40) / 100).alias("score"), (F.col("quality") == 1).alias("label"), (F.col("toxic") == 1).alias("toxic"), "n_chars")


def auc_by_source(spark, d):
    return stats.auc(scored_labels(spark, d), ["source"]).withColumn("auc", F.round("auc", 6))


def auc_overall(spark, d):
    return stats.auc(scored_labels(spark, d).withColumn("whole", F.lit(1)), ["whole"]).withColumn("auc", F.round("auc", 6))


def pearson_spearman(spark, d):
    out = stats.correlations(read(spark, d, "lineitem"), [("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_tax", "l_discount")])
    return out.select("x_name", "y_name", "n", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


def threshold_sweep(spark, d):
    return stats.threshold_sweep(scored_labels(spark, d), ["lang"], STEPS)


def best_threshold(spark, d):
    return stats.best_threshold(stats.threshold_sweep(scored_labels(spark, d), ["lang"], STEPS), ["lang"]).select("lang", "threshold", "f1")


def operating_points(spark, d):
    return stats.operating_points(scored_labels(spark, d), [1.0, 0.98, 0.95]).withColumn("skipped", F.round("skipped", 6))


def score_bins(spark, d):
    return stats.score_bins(scored_labels(spark, d), "score", ["n_chars"]).withColumn("avg_n_chars", F.round("avg_n_chars", 4))


def rankings(spark, d):
    s = read(spark, d, "supplier")
    return stats.rankings(s, {"balance": F.col("s_acctbal"), "debt": -F.col("s_acctbal"), "surprise": F.round(F.col("s_acctbal") / 10_000 - (F.col("s_suppkey") % 10) / 10, 6)}, "s_suppkey", 15)


def misjudged(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey", ((F.col("s_suppkey") % 100) / 100).alias("score"), F.col("s_acctbal").alias("gain"))
    return stats.misjudged(s, "score", "gain").select("s_suppkey", "kind")


def matrix_parity(spark, d):
    c = claims(spark, d).groupBy("entity", "question")
    base = c.agg(F.max(F.when(F.col("verified"), F.col("value"))).alias("value")).where("value is not null")
    new = c.agg(F.max(F.when(F.col("score") > 90, F.col("value"))).alias("value"))
    return stats.parity(base, new, ["entity", "question"])


def label_confusion(spark, d):
    rows = scored_labels(spark, d)
    return stats.confusion(rows, F.col("score") >= 0.3, F.col("label"), ["lang"])


def auc_difference(spark, d):
    rows = scored_labels(spark, d).withColumn("other", (F.col("doc_id") % 97) / 97)
    return stats.auc_difference(rows, ["lang"], "other", "score", resamples=200)


def truth_and_answers(spark, d):
    c = claims(spark, d).where("value is not null")
    truth = c.where("verified").select("entity", "question", "value", "quote", (F.col("question") == "LARGE").alias("is_list"), "ord")
    answers = c.where("score < 60").select("entity", "question", "value", "quote", "verified", "match_type", "source_url", "ord")
    return truth, answers


def _named(m):
    return m.withColumns({"question": F.coalesce("question", F.lit("all")), "is_list": F.coalesce(F.col("is_list").cast("string"), F.lit("all"))})


def exact_metrics(spark, d):
    return _named(evaluate.metrics(evaluate.exact_alignment(*truth_and_answers(spark, d))))


def greedy_metrics(spark, d):
    return _named(evaluate.metrics(evaluate.align(*truth_and_answers(spark, d))))


def entity_crosscheck(spark, d):
    c = read(spark, d, "customer").select(F.col("c_nationkey").alias("entity"))
    s = read(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("entity"))
    return evaluate.crosscheck(c, s)


def manual_verdicts(spark, d):
    a = evaluate.exact_alignment(*truth_and_answers(spark, d)).select("entity", "question", F.col("norm").alias("answer"), "is_list", "kind", "verdict")
    manual = read(spark, d, "supplier").select(F.concat(F.lit("Supplier "), F.col("s_suppkey").cast("string")).alias("entity"), F.explode(F.array(F.lit("SMALL"), F.lit("LARGE"))).alias("question"), F.concat(F.lit("brand#"), (F.col("s_suppkey") % 25).cast("string"), F.lit(" x")).alias("answer"), F.when(F.col("s_suppkey") % 3 == 0, "TRUE").when(F.col("s_suppkey") % 3 == 1, "FALSE").otherwise("EXCLUDE").alias("said"), F.lit(1).alias("sheet"))
    out = evaluate.apply_verdicts(a, manual)
    return out.groupBy("question", "verdict").agg(F.count("*").alias("n"))


def question_binding(spark, d):
    wanted = spark.createDataFrame([("parts of type standard",), ("STANDARD",), ("Economy ",), ("mediums",), ("nothing alike at all",)], "question string")
    return evaluate.bind_questions(wanted, read(spark, d, "part").select(F.col("p_type").alias("question")))


CRITERIA = [
    ("balance", "balance", "hard_gate", "money", "range", -500.0, 9000.0, 0.0, "flag", "use_flagged", None, 1),
    ("nation", "nation", "hard_gate", "count", "max", None, 20.0, 0.0, "exclude", "use_flagged", None, 2),
    ("asia", "asia", "scored", "binary", "prefer_yes", None, None, 1.0, "flag", "use_flagged", None, 3),
    ("size", "balance", "scored", "money", "prefer_high", 0.0, 10000.0, 2.0, "flag", "use_flagged", None, 4),
]
_SPEC = "id string, question string, type string, parser string, direction string, lo double, hi double, weight double, missing_policy string, unverified_policy string, max_age int, ord int"


def shortlist_cells(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_name").alias("entity"), "s_suppkey", "s_nationkey", "s_acctbal")
    one = lambda q, raw, state="VALUE": s.select("entity", F.lit(q).alias("question"), F.lit(state).alias("state"), F.array(F.struct(raw.alias("raw"), F.lit(True).alias("verified"))).alias("items"), F.array().cast("array<string>").alias("flags"), "s_suppkey")
    rows = one("balance", F.format_string("%.2f USD", F.col("s_acctbal"))).union(one("nation", F.col("s_nationkey").cast("string"))).union(one("asia", F.when(F.col("s_nationkey") % 5 == 2, "Yes").otherwise("No")))
    return rows.where("not (question = 'asia' and s_suppkey % 7 = 0)").drop("s_suppkey")


def shortlist_rank(spark, d):
    return shortlist.run(shortlist_cells(spark, d), spark.createDataFrame(CRITERIA, _SPEC))


def shortlist_overlap(spark, d):
    spec = spark.createDataFrame(CRITERIA, _SPEC)
    cells = shortlist_cells(spark, d)
    return shortlist.overlap(shortlist.run(cells, spec), shortlist.run(cells, spec.withColumn("weight", F.when(F.col("id") == "asia", 4.0).otherwise(F.col("weight")))), 10)


def _gates(spark, d, shift=0.0):
    spec = spark.createDataFrame(CRITERIA, _SPEC).withColumnsRenamed({"lo": "lo_t", "hi": "hi_t"}).withColumn("hi_t", F.col("hi_t") + shift)
    return shortlist.gates(shortlist.judged(shortlist_cells(spark, d), spec).withColumnsRenamed({"lo": "plo", "hi": "phi"}))


def gate_decisiveness(spark, d):
    return shortlist.decisiveness(_gates(spark, d))


def gate_differences(spark, d):
    return shortlist.gate_differences(_gates(spark, d), _gates(spark, d, -2.0)).select("entity", "id", "outcome_a", "outcome_b", "difference")


def keyword_gate(spark, d):
    questions = spark.createDataFrame([("widget parts supply",), ("bolt parts supply",), ("gear parts supply",), ("anvil parts delivery",)], "question string")
    pages = read(spark, d, "part").select(F.col("p_partkey").alias("url"), F.concat_ws(" ", "p_name", "p_brand", F.lit("parts")).alias("text"))
    return routing.keyword_hits(pages, routing.question_keywords(questions))


def embedding_rows(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("url"), F.col("embedding").cast("array<double>").alias("vector"), "label")


def filter_routing(spark, d):
    e = embedding_rows(spark, d)
    q = e.where("url % 50 = 0").select(F.concat(F.lit("q"), F.col("url").cast("string")).alias("question"), "vector")
    out = routing.route(routing.question_scores(e.select("url", "vector"), q))
    return out.select("url", "question", F.round("score", 6).alias("score"), "included", "reason")


def routing_counterfactual(spark, d):
    e = embedding_rows(spark, d)
    q = e.where("url % 50 = 0").select(F.concat(F.lit("q"), F.col("url").cast("string")).alias("question"), "vector", "label")
    # few labels: joined where the pages are, by a broadcast of the questions, whose number question scores limit
    found = routing.dealt(e.select("url", "label")).join(F.broadcast(q.select("question", "label")), "label").select("url", "question")
    return routing.counterfactual_of(e.select("url", "vector"), q.select("question", "vector"), found, [0.0, 0.25, 0.5, 0.75])


def centered_norms(spark, d):
    e = embedding_rows(spark, d)
    return group.center(e, ["label"], key="url").select("url", "label", F.round(vector.norm(F.col("vector")), 6).alias("norm"))


def themes(spark, d):
    e = embedding_rows(spark, d)
    values = e.select((F.col("url") % 5).cast("string").alias("entity"), F.lit("label").alias("question"), F.format_string("v%06d", F.col("url")).alias("value"), "vector", F.col("url").alias("ord"))
    return group.themes(values).select("entity", "question", "theme", "n_items", "place")


def resolve_review(spark, d):
    p = read(spark, d, "pages").select(F.regexp_extract("url", r"https?://([^/?#]*)", 1).alias("host"), "url", "page_id")
    c = p.select(F.concat(F.element_at(F.split("host", r"\."), -3), F.lit(" Systems GmbH")).alias("company"), F.lit("").alias("context"), "url", F.col("host").alias("body"), (F.col("page_id") % 7).cast("int").alias("rank"))
    return resolve.resolve(resolve.score_candidates(c)).select("company", "confidence", "needs_review", "note")


def cell_readings(spark, d):
    """Texts written from each supplier's key in six ways, and what is read from them."""
    s = read(spark, d, "supplier")
    k, text_of = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    forms = [
        ("count", F.concat(F.lit("over "), F.format_number(k + 1000, 0))), ("count", F.concat(text_of, F.lit(" to "), (k + 100).cast("string"))), ("count", F.concat(text_of, F.lit(" (2001)"))),
        ("money", F.concat(F.lit("$"), text_of, F.lit(".5M (Fiscal Year 2025)"))), ("money", F.concat(F.lit("approx "), text_of, F.lit(" million EUR (Parent Corp)"))), ("binary", F.when(k % 4 == 1, "Yes.").otherwise(" no ")),
    ]
    parser = raw = F.lit(None).cast("string")
    for n, (kind, form) in enumerate(forms):
        parser, raw = F.when(k % 6 == n, kind).otherwise(parser), F.when(k % 6 == n, form).otherwise(raw)
    rows = shortlist.parse_column(s.select("s_suppkey", parser.alias("parser"), F.lit(10).alias("max_age"), raw.alias("raw")))
    return rows.select("s_suppkey", "parser", "ok", *(F.round(c, 2).alias(c) for c in ("value", "lo", "hi")), "vintage", F.array_join("flags", ",").alias("flags"))


def keyword_hits(spark, d):
    """The first phrase of a list in each document, short ones as whole words."""
    return read(spark, d, "documents").select("doc_id", shortlist.keyword_hit(F.col("text"), ["the", "und", "con-", "tion", "que"]).alias("hit"))


QUERIES = {f.__name__: f for f in (cell_readings, keyword_hits, auc_by_source, auc_overall, pearson_spearman, threshold_sweep, best_threshold, operating_points, score_bins, rankings, misjudged, matrix_parity, label_confusion, auc_difference, exact_metrics, greedy_metrics, entity_crosscheck, manual_verdicts, question_binding, shortlist_rank, shortlist_overlap, gate_decisiveness, gate_differences, keyword_gate, filter_routing, routing_counterfactual, centered_norms, themes, resolve_review)}

_SL = """sl AS (SELECT doc_id, source, lang, least(1.0::DOUBLE, floor(n_chars / 40) / 100) AS score, quality = 1 AS label, n_chars FROM documents JOIN labels USING (doc_id))"""
_AUC = "sum(r) FILTER (label) AS s, count(*) FILTER (label) AS p, count(*) FILTER (NOT label) AS q"
_TA = f"""{CLAIMS}, tr AS (SELECT entity, question, norm, bool_or(question = 'LARGE') AS is_list FROM normed WHERE verified GROUP BY ALL),
an AS (SELECT DISTINCT entity, question, norm FROM normed WHERE score < 60 AND entity IN (SELECT entity FROM tr)),
al AS (SELECT coalesce(tr.entity, an.entity) AS entity, coalesce(tr.question, an.question) AS question, coalesce(tr.norm, an.norm) AS norm, coalesce(is_list, false) AS is_list,
  CASE WHEN tr.norm IS NULL THEN 'ai_only' ELSE 'pair' END AS kind, CASE WHEN tr.norm IS NULL THEN 'false_positive' WHEN an.norm IS NULL THEN 'auto_miss' ELSE 'auto_match' END AS verdict
  FROM tr FULL JOIN an ON tr.entity = an.entity AND tr.question = an.question AND tr.norm = an.norm)"""
_COS = "list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))"
_ROUTE = f"""e AS (SELECT vec_id AS url, list_transform(embedding, lambda x: x::DOUBLE) AS e, label FROM embeddings),
s AS (SELECT a.url, 'q' || b.url AS question, {_COS} AS score, a.label = b.label AS hit FROM e a JOIN e b ON b.url % 50 = 0)"""
ORACLES = {
    "cell_readings": """WITH s AS (SELECT s_suppkey, s_suppkey % 6 AS n, s_suppkey::DOUBLE AS k FROM supplier)
SELECT s_suppkey, CASE WHEN n < 3 THEN 'count' WHEN n < 5 THEN 'money' ELSE 'binary' END AS parser, true AS ok,
  round(CASE n WHEN 0 THEN k + 1000 WHEN 1 THEN k + 50 WHEN 2 THEN k WHEN 3 THEN (k + 0.5) * 1000000 WHEN 4 THEN k * 1080000 ELSE (s_suppkey % 4 = 1)::INT END, 2)::DOUBLE AS value,
  round(CASE n WHEN 0 THEN k + 1000 WHEN 1 THEN k WHEN 2 THEN k WHEN 3 THEN (k + 0.5) * 1000000 WHEN 4 THEN k * 1080000 ELSE (s_suppkey % 4 = 1)::INT END, 2)::DOUBLE AS lo,
  round(CASE n WHEN 0 THEN NULL WHEN 1 THEN k + 100 WHEN 2 THEN k WHEN 3 THEN (k + 0.5) * 1000000 WHEN 4 THEN k * 1080000 ELSE (s_suppkey % 4 = 1)::INT END, 2)::DOUBLE AS hi,
  CASE n WHEN 2 THEN 2001 WHEN 3 THEN 2025 END::INT AS vintage,
  CASE n WHEN 0 THEN 'QUALIFIED' WHEN 1 THEN 'RANGE' WHEN 2 THEN 'STALE' WHEN 4 THEN 'PARENT_ATTRIBUTED,QUALIFIED' ELSE '' END AS flags FROM s""",
    "keyword_hits": r"""WITH t AS (SELECT doc_id, regexp_replace(replace(lower(text), '-', ' '), '\s+', ' ', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(t, '(^|[^a-z0-9])the([^a-z0-9]|$)') THEN 'the' WHEN regexp_matches(t, '(^|[^a-z0-9])und([^a-z0-9]|$)') THEN 'und'
  WHEN regexp_matches(t, '(^|[^a-z0-9])con ([^a-z0-9]|$)') THEN 'con-' WHEN regexp_matches(t, '(^|[^a-z0-9])tion([^a-z0-9]|$)') THEN 'tion'
  WHEN regexp_matches(t, '(^|[^a-z0-9])que([^a-z0-9]|$)') THEN 'que' END AS hit FROM t""",
    "auc_by_source": f"""WITH {_SL}, r AS (SELECT source, label, rank() OVER (PARTITION BY source ORDER BY score) + (count(*) OVER (PARTITION BY source, score) - 1) / 2 AS r FROM sl), t AS (SELECT source, {_AUC} FROM r GROUP BY 1)
SELECT source, p AS positives, q AS negatives, round(CASE WHEN p > 0 AND q > 0 THEN (s - p * (p + 1) / 2) / (p * q) END, 6)::DOUBLE AS auc FROM t""",
    "auc_overall": f"""WITH {_SL}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM sl), t AS (SELECT {_AUC} FROM r)
SELECT 1 AS whole, p AS positives, q AS negatives, round((s - p * (p + 1) / 2) / (p * q), 6)::DOUBLE AS auc FROM t""",
    "pearson_spearman": """WITH r AS (SELECT l_quantity AS q, l_discount AS d, l_tax AS t, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS rq,
rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2 AS rd, rank() OVER (ORDER BY l_tax) + (count(*) OVER (PARTITION BY l_tax) - 1) / 2 AS rt FROM lineitem)
SELECT 'l_quantity' AS x_name, 'l_discount' AS y_name, count(*) AS n, round(corr(q, d), 6) AS pearson, round(corr(rq, rd), 6) AS spearman FROM r
UNION ALL SELECT 'l_quantity', 'l_tax', count(*), round(corr(q, t), 6), round(corr(rq, rt), 6) FROM r UNION ALL SELECT 'l_tax', 'l_discount', count(*), round(corr(t, d), 6), round(corr(rt, rd), 6) FROM r""",
    "threshold_sweep": f"""WITH {_SL}, x AS (SELECT lang, t AS threshold, count(*) FILTER (label AND score >= t) AS tp, count(*) FILTER (NOT label AND score >= t) AS fp, count(*) FILTER (label AND score < t) AS fn FROM sl, (SELECT unnest([0.2::DOUBLE, 0.4, 0.6, 0.8]) AS t) GROUP BY ALL),
y AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM x)
SELECT lang, threshold, tp, fp, fn, round(p, 3)::DOUBLE AS precision, round(r, 3)::DOUBLE AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 3)::DOUBLE AS f1 FROM y""",
    "score_bins": f"""WITH {_SL}, b AS (SELECT unnest(range(5))::INT AS bin), c AS (SELECT least(4, floor(score * 5 + 1e-9))::INT AS bin, count(*) AS n, avg(n_chars) AS a FROM sl GROUP BY 1)
SELECT bin, bin / 5 AS low, coalesce(n, 0) AS n, round(coalesce(a, 0.0), 4)::DOUBLE AS avg_n_chars FROM b LEFT JOIN c USING (bin)""",
    "rankings": """WITH m AS (SELECT 'balance' AS ranking, s_suppkey AS key, s_acctbal AS measure FROM supplier UNION ALL SELECT 'debt', s_suppkey, -s_acctbal FROM supplier UNION ALL SELECT 'surprise', s_suppkey, round(s_acctbal / 10000 - (s_suppkey % 10) / 10, 6) FROM supplier)
SELECT ranking, row_number() OVER w AS rank, key, measure FROM m WINDOW w AS (PARTITION BY ranking ORDER BY measure DESC, key) QUALIFY rank <= 15""",
    "misjudged": """WITH s AS (SELECT s_suppkey, (s_suppkey % 100) / 100 AS score, s_acctbal AS gain, avg(s_acctbal) OVER () AS m FROM supplier)
SELECT s_suppkey, CASE WHEN score >= 0.6 THEN 'false_positive' ELSE 'false_negative' END AS kind FROM s WHERE (score >= 0.6 AND gain <= m) OR (score <= 0.4 AND gain > m)""",
    "matrix_parity": f"""WITH {CLAIMS}, c AS (SELECT entity, question, max(value) FILTER (verified) IS NOT NULL AS x, max(value) FILTER (score > 90) IS NOT NULL AS y FROM claims GROUP BY ALL)
SELECT question, count(*) FILTER (x) AS base, count(*) FILTER (y) AS candidate, count(*) FILTER (x AND y) AS kept, count(*) FILTER (x AND NOT y) AS lost, count(*) FILTER (NOT x AND y) AS gained,
CASE WHEN count(*) FILTER (x) > 0 THEN round(count(*) FILTER (x AND y) / count(*) FILTER (x), 4) ELSE 1.0 END::DOUBLE AS retention FROM c GROUP BY 1""",
    "label_confusion": f"""WITH {_SL}, c AS (SELECT lang, score >= 0.3 AS said, label FROM sl)
SELECT lang, count(*) FILTER (said AND label) AS tp, count(*) FILTER (said AND NOT label) AS fp, count(*) FILTER (NOT said AND label) AS fn, count(*) FILTER (NOT said AND NOT label) AS tn, round(avg((said = label)::INT), 4)::DOUBLE AS agreement FROM c GROUP BY GROUPING SETS ((lang), ())""",
    "operating_points": f"""WITH {_SL}, c AS (SELECT score, sum(count(*)) OVER (ORDER BY score DESC) AS rows_kept, sum(sum(label::INT)) OVER (ORDER BY score DESC) AS kept FROM sl GROUP BY score), k AS (SELECT *, max(kept) OVER () AS p, max(rows_kept) OVER () AS n FROM c)
SELECT recall, max(score) AS threshold, round(1 - arg_max(rows_kept, score) / max(n), 6)::DOUBLE AS skipped FROM k, (SELECT unnest([1.0::DOUBLE, 0.98, 0.95]) AS recall) WHERE kept >= recall * p GROUP BY recall""",
    "exact_metrics": f"""WITH {_TA}, m AS (SELECT question, is_list, count(*) FILTER (verdict = 'auto_match') AS tp, count(*) FILTER (verdict = 'auto_miss') AS fn, count(*) FILTER (verdict = 'false_positive') AS fp FROM al GROUP BY GROUPING SETS ((question), (is_list), ())),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS rc FROM m)
SELECT coalesce(question, 'all') AS question, coalesce(is_list::VARCHAR, 'all') AS is_list, tp, fn, fp, round(p, 4)::DOUBLE AS precision, round(rc, 4)::DOUBLE AS recall, round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0.0 END, 4)::DOUBLE AS f1, round(fp / greatest(1, tp + fp), 4)::DOUBLE AS hallucination FROM r""",
    "entity_crosscheck": """SELECT coalesce(a.e, b.e) AS entity, CASE WHEN b.e IS NULL THEN 'truth_only' WHEN a.e IS NULL THEN 'answers_only' ELSE 'both' END AS found
FROM (SELECT DISTINCT c_nationkey AS e FROM customer) a FULL JOIN (SELECT DISTINCT s_nationkey AS e FROM supplier WHERE s_acctbal > 5000) b ON a.e = b.e""",
    "manual_verdicts": f"""WITH {_TA}, mv AS (SELECT 'Supplier ' || s_suppkey AS entity, unnest(['SMALL', 'LARGE']) AS question, 'brand#' || (s_suppkey % 25) || ' x' AS norm, CASE s_suppkey % 3 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'FALSE' ELSE 'EXCLUDE' END AS said FROM supplier),
j AS (SELECT al.question, CASE said WHEN 'TRUE' THEN 'auto_match' WHEN 'FALSE' THEN 'auto_miss' ELSE verdict END AS verdict FROM al LEFT JOIN mv USING (entity, question, norm) WHERE said IS NULL OR said <> 'EXCLUDE')
SELECT question, verdict, count(*) AS n FROM j GROUP BY ALL""",
    "keyword_gate": """SELECT p_partkey AS url, q.question FROM part, (SELECT unnest(['widget parts supply', 'bolt parts supply', 'gear parts supply', 'anvil parts delivery']) AS question, unnest([['widget'], ['bolt'], ['gear'], ['anvil', 'delivery']]) AS words) q
WHERE len(list_intersect(string_split(p_name, ' '), words)) > 0""",
    "filter_routing": f"""WITH {_ROUTE}, f AS (SELECT *, max(score) OVER (PARTITION BY url) AS m FROM s)
SELECT url, question, round(score, 6) AS score, score >= 0.55 OR m < 0.55 AS included, CASE WHEN score >= 0.55 THEN 'similarity' WHEN m < 0.55 THEN 'fallback_all' ELSE 'below_threshold' END AS reason FROM f""",
    "routing_counterfactual": f"""WITH {_ROUTE}, f AS (SELECT *, max(score) OVER (PARTITION BY url) AS m FROM s), t AS (SELECT unnest([0.0::DOUBLE, 0.25, 0.5, 0.75]) AS threshold)
SELECT threshold, count(*) FILTER (score >= threshold OR m < threshold) AS calls, count(*) FILTER (hit AND (score >= threshold OR m < threshold)) AS claims_kept, count(*) FILTER (hit AND NOT (score >= threshold OR m < threshold)) AS claims_lost FROM f, t GROUP BY 1""",
    "centered_norms": """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY ALL)
SELECT vec_id AS url, label, round(sqrt(sum((x - m) * (x - m))), 6) AS norm FROM e JOIN m USING (label, i) GROUP BY ALL""",
    "gate_decisiveness": """SELECT 'balance' AS id, count(*) AS decided, 0::BIGINT AS flagged_through, count(*) FILTER (abs(s_acctbal) > 9000) AS failed FROM supplier
UNION ALL SELECT 'nation', count(*), 0, count(*) FILTER (s_nationkey > 20) FROM supplier""",
    "shortlist_rank": """WITH s AS (SELECT s_name AS entity, s_suppkey, s_acctbal AS b, s_nationkey AS k, CASE WHEN abs(s_acctbal) > 9000 THEN 'balance' WHEN s_nationkey > 20 THEN 'nation' END AS excluded_by,
CASE WHEN s_suppkey % 7 <> 0 THEN (s_nationkey % 5 = 2)::INT::DOUBLE END AS asia, greatest(0.0, least(1.0, abs(s_acctbal) / 10000)) AS size FROM supplier),
t AS (SELECT entity, excluded_by, round((coalesce(asia, 0) + 2 * size) / (CASE WHEN asia IS NULL THEN 2 ELSE 3 END), 4)::DOUBLE AS total, round(CASE WHEN asia IS NULL THEN 2 / 3 ELSE 1 END, 4)::DOUBLE AS coverage FROM s)
SELECT *, CASE WHEN excluded_by IS NULL THEN row_number() OVER (PARTITION BY excluded_by IS NULL ORDER BY total DESC, coverage DESC, lower(entity)) END AS rank FROM t""",
}

"""Which pages to ask which questions: similarity of chunks, keywords, and the fallback to all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# The similarity from which a question is asked; a keyword is dropped if so many questions share it.
THRESHOLD, SHARED, LEAST_QUESTIONS = 0.55, 0.5, 4


def question_keywords(questions: DataFrame) -> DataFrame:
    """(question, keyword): words longer than three characters, but none that half of at least four questions share."""
    words = questions.select("question", F.explode(text.keywords(F.col("question"))).alias("keyword"))
    n = questions.select("question").distinct().agg(F.count("*").alias("n"))
    common = words.groupBy("keyword").agg(F.count("*").alias("k")).join(F.broadcast(n)).where((F.col("n") >= LEAST_QUESTIONS) & (F.col("k") >= SHARED * F.col("n")))
    return words.join(common.select("keyword"), "keyword", "left_anti").select("question", "keyword")


def dealt(pages: DataFrame) -> DataFrame:
    """Rows by url over all tasks, however few bytes they are."""
    spark = pages.sparkSession
    return pages.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "url")


def by_page(chunks: DataFrame) -> DataFrame:
    """(url, vectors): one row a page."""
    return dealt(chunks).groupBy("url").agg(F.collect_list(F.coalesce("vector", F.array().cast("array<double>"))).alias("vectors"))


def _matrix(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, filled up with zeros, and their lengths; one with a null counts as zeros."""
    sizes = np.array([len(v) for v in vectors])
    out = np.zeros((len(vectors), int(sizes.max(initial=0))))
    for k, v in enumerate(vectors):
        if None not in v:
            out[k, : len(v)] = v
    return out, sizes


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All products of rows, summed in the order of the dimensions as SQL does, so that not a bit differs."""
    acc, one = np.zeros((len(a), len(b))), np.empty((len(a), len(b)))
    for d in range(min(a.shape[1], b.shape[1])):
        np.multiply(a[:, d, None], b[None, :, d], out=one)
        acc += one
    return acc


def _norms(a: np.ndarray) -> np.ndarray:
    acc = np.zeros(len(a))
    for d in range(a.shape[1]):
        acc += a[:, d] * a[:, d]
    return np.sqrt(acc)


def collected(questions: DataFrame, max_questions: int = 10_000) -> tuple[list, DataFrame]:
    """Rows (question, vector), and (place, question) of the different questions in their order."""
    asked = questions.select("question", "vector").limit(max_questions + 1).collect()
    if len(asked) > max_questions:
        raise ValueError(f"more than {max_questions} questions")
    names = list(dict.fromkeys(r["question"] for r in asked))
    return asked, questions.sparkSession.createDataFrame(list(enumerate(names)), f"place int, question {questions.schema['question'].dataType.simpleString()}")


def page_scores(pages: DataFrame, asked: list, block: int = 65_536) -> DataFrame:
    """pages (url, vectors, ...) with scores: by the place of a question, the best cosine of the page's vectors with it.

    The scores of a page are one array, so no pair is moved. A task holds block scores at a time, or those of one page.
    """
    order = {n: k for k, n in enumerate(dict.fromkeys(r["question"] for r in asked))}
    names, asked = list(order), sorted(asked, key=lambda r: order[r["question"]])
    starts = np.searchsorted([order[r["question"]] for r in asked], np.arange(len(names)))
    b, b_sizes = _matrix([r["vector"] or [] for r in asked])
    b_norms, n = _norms(b), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, block // max(1, len(asked)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lists = part.column(part.schema.get_field_index("vectors")).to_pylist()
                owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                a, a_sizes = _matrix([v for x in lists for v in x])
                a_norms, out = _norms(a), np.full((len(lists), n), -np.inf)
                for r in range(0, len(a) if n else 0, step):
                    x, who = a[r : r + step], owner[r : r + step]
                    size = a_norms[r : r + step, None] * b_norms[None, :]
                    with np.errstate(all="ignore"):
                        score = np.where((size > 0) | np.isnan(size), _dots(x, b) / size, 0.0)
                    # vectors of different lengths have no score
                    score[(a_sizes[r : r + step, None] != b_sizes[None, :]) & (size > 0)] = -np.inf
                    first = np.flatnonzero(np.diff(who, prepend=-1))
                    most = np.maximum.reduceat(np.maximum.reduceat(score, starts, axis=1), first, axis=0)
                    out[who[first]] = np.maximum(out[who[first]], most)
                flat = out.ravel()
                values = pa.array(flat, pa.float64(), mask=np.isneginf(flat))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n) if n else np.zeros(len(lists) + 1), pa.int32()), values)], names=[*part.schema.names, "scores"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields), "scores array<double>"])
    return pages.mapInArrow(run, schema)


def question_scores(chunks: DataFrame, questions: DataFrame, max_questions: int = 10_000) -> DataFrame:
    """(url, question, score, best): the best cosine of a page's chunks (url, vector) with each question (question, vector), and with any."""
    asked, names = collected(questions, max_questions)
    rows = page_scores(by_page(chunks), asked).select("url", F.array_max("scores").alias("best"), F.posexplode("scores").alias("place", "score"))
    # names: at most max_questions rows
    return rows.join(F.broadcast(names), "place").select("url", "question", "score", "best")


def keyword_hits(pages: DataFrame, keywords: DataFrame) -> DataFrame:
    """(url, question) where the page's words hold a keyword of the question."""
    words = pages.select("url", F.explode(F.array_distinct(text.ascii_tokens(F.col("text"), 4, []))).alias("keyword"))
    return words.join(keywords, "keyword").select("url", "question").distinct()


def route(scores: DataFrame, hits: DataFrame | None = None, threshold: float = THRESHOLD, passthrough: bool = False) -> DataFrame:
    """(url, question, score, keyword, included, reason); a page that no question fits is asked all.

    Where scores say each page's best and there are no hits, rows stay where they are.
    """
    hits = hits.withColumn("keyword", F.lit(True)) if hits is not None else None
    both = scores.join(hits, ["url", "question"], "left").withColumn("keyword", F.coalesce("keyword", F.lit(False))) if hits is not None else scores.withColumn("keyword", F.lit(False))
    fits = (F.col("score") >= threshold) | F.col("keyword")
    some = F.col("best") >= threshold if hits is None and "best" in scores.columns else F.max(fits.cast("int")).over(Window.partitionBy("url")) == 1
    reason = F.when(F.lit(passthrough), "passthrough").when(F.col("score") >= threshold, "similarity").when(F.col("keyword"), "keyword").when(~some, "fallback_all").otherwise("below_threshold")
    return both.withColumn("reason", reason).withColumn("included", F.col("reason") != "below_threshold").drop("best")


def counterfactual(log: DataFrame, claims: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, calls, claims_kept, claims_lost) had another threshold routed the pages; the fallback stays."""
    n = claims.groupBy("url", "question").agg(F.count("*").alias("claims"))
    rows = log.join(n, ["url", "question"], "left").fillna(0, ["claims"])
    each = rows.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    fits = (F.col("score") >= F.col("threshold")) | F.col("keyword")
    some = F.max(fits.cast("int")).over(Window.partitionBy("threshold", "url")) == 1
    each = each.withColumn("asked", fits | ~some)
    return each.groupBy("threshold").agg(F.count_if("asked").alias("calls"), F.sum(F.when(F.col("asked"), F.col("claims")).otherwise(0)).alias("claims_kept"), F.sum(F.when(F.col("asked"), 0).otherwise(F.col("claims"))).alias("claims_lost"))


def counterfactual_of(chunks: DataFrame, questions: DataFrame, claims: DataFrame, thresholds: list[float]) -> DataFrame:
    """counterfactual() of the routing of chunks without keywords: a page's claims meet its scores in one row, no pair is moved.

    claims (url, question) are counted where they are if they are dealt by url.
    """
    asked, names = collected(questions)
    # names: at most as many rows as collected() takes
    n = claims.join(F.broadcast(names), "question").groupBy("url", "place").agg(F.count("*").alias("n"))
    n = n.groupBy("url").agg(F.collect_list(F.struct("place", "n")).alias("claims"))
    rows = page_scores(by_page(chunks).join(n, "url", "left"), asked).withColumn("best", F.array_max("scores"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda t, x: t + x["n"])
    none, all_claims = F.lit(0).cast("bigint"), F.coalesce(total(F.col("claims")), F.lit(0))
    each = []
    for t in thresholds:
        some = F.col("best") >= t
        calls = F.when(some, F.size(F.filter("scores", lambda x: x >= t))).when(~some, F.size("scores")).otherwise(0)
        kept = F.when(some, F.coalesce(total(F.filter("claims", lambda x: F.get("scores", x["place"]) >= t)), none)).when(~some, all_claims).otherwise(none)
        each.append(F.struct(F.lit(float(t)).alias("threshold"), calls.cast("bigint").alias("calls"), kept.alias("kept"), (all_claims - kept).alias("lost")))
    each = rows.select(F.explode(F.array(*each)).alias("e")).select("e.*")
    return each.groupBy("threshold").agg(F.sum("calls").alias("calls"), F.sum("kept").alias("claims_kept"), F.sum("lost").alias("claims_lost"))


def chunk_count(length: Column, size: int = 8000, overlap: int = 200, most: int = 40) -> Column:
    return F.least(F.lit(most), F.when(length <= size, 1).otherwise(F.ceil((length - size) / (size - overlap)) + 1))

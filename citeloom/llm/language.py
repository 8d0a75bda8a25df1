"""Language identification by multilingual mixture inference.

Each language has a character trigram model: the probability of a character given the two before it,
inside a word and at its edges, counted by all tasks on a bounded sample of labelled documents for each language. A
document's words then have a likelihood under every language, and expectation-maximisation over its words
estimates in which proportions it mixes them. Language sets are nested by those proportions; the set with
the best likelihood after a penalty of half the logarithm of the word count for each language is chosen, and
the prediction is the set's largest member. The score is that language's proportion before a set is chosen, when all
languages compete, with one word added for each of them, so that few words give a low score. Scoring is one map over whole texts, without a shuffle.

Defined cases: a null text, or one without any letter, is `und` with score 0; ties go to the language that
sorts first; documents without a language or id never train, but a null id gets a prediction; a very long text is
read whole, in memory in proportion to its length; repeated rows give repeated results; without any labelled document
every document with letters is `und`; other columns, clashing names among them, are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import mix, passes, pick, reduce_rows, utf8
from .quality import code_points

UNKNOWN = "und"
_PASS = 1_000_000


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """For each code point its lower case if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    # no letters beyond the tertiary ideographic plane
    for c in range(0x40000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def trigrams(points: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of context and character, bucket of context, position) for each character inside or just after a word.

    A character is a code point folded to lower case; all that is no letter counts as one edge symbol.
    """
    n = len(points)
    key = _folded()[points].astype(np.uint64)
    letter = key > 0
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    one[1:], two[2:] = key[:-1], key[:-2]
    edges = offsets[:-1][offsets[:-1] < n]
    one[edges] = two[edges] = 0
    after = edges[edges + 1 < n] + 1
    two[after] = 0
    two[one == 0] = 0
    where = np.flatnonzero(letter | (one != 0))
    context = (two[where] << np.uint64(21)) | one[where]
    full = (context << np.uint64(21)) | key[where]
    mask = np.uint64(buckets - 1)
    return (mix(full) & mask).astype(np.int64), (mix(context + np.uint64(1)) & mask).astype(np.int64), where


@dataclass
class Model:
    """log_p: bucket × language, log-probability of a character after its context."""

    languages: list[str]
    log_p: np.ndarray

    def words(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihood of each word under each language, row offsets)."""
        full, _, where = trigrams(points, offsets, len(self.log_p))
        if not len(where):
            return np.zeros((0, len(self.languages)), np.float32), np.zeros(len(offsets), np.int64)
        begin = np.ones(len(where), bool)
        row = np.searchsorted(offsets, where, "right") - 1
        # a word's characters follow each other; its last entry is the character that ends it
        begin[1:] = (where[1:] != where[:-1] + 1) | (row[1:] != row[:-1])
        ended = np.zeros(len(where), bool)
        ended[1:] = _folded()[points[where]][:-1] == 0
        starts = np.flatnonzero(begin | ended)
        return np.add.reduceat(self.log_p[full], starts, axis=0), np.searchsorted(row[starts], np.arange(len(offsets)))


def mixture(logp: np.ndarray, bounds: np.ndarray, rounds: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row's words, by expectation-maximisation: the proportions in the chosen set, its size, and the proportions among all languages."""
    n, k = len(bounds) - 1, logp.shape[1]
    best = np.zeros((n, k))
    if not len(logp):
        return best, np.zeros(n, np.int64), best
    row = np.repeat(np.arange(n), np.diff(bounds))
    count = np.diff(bounds).astype(np.float64)
    top = logp.max(1, keepdims=True)
    p = np.exp(logp - top)

    def expect(share: np.ndarray, times: int, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The proportions of the rows in live after some rounds, and their log-likelihood."""
        words = np.flatnonzero(live[row])
        own = np.cumsum(live)[row[words]] - 1
        edges = np.concatenate([[0], np.cumsum(np.diff(bounds)[live])])
        q, some = p[words], share[live]
        for _ in range(times):
            joint = q * some[own]
            joint /= np.maximum(joint.sum(1, keepdims=True), 1e-30)
            some = (reduce_rows(np.add, joint, edges, 0.0) / np.maximum(count[live], 1)[:, None]).astype(np.float32)
        return some, reduce_rows(np.add, np.log((q * some[own]).sum(1) + 1e-30), edges, 0.0)

    live = np.ones(n, bool)
    share, most = expect(np.full((n, k), 1 / k, np.float32), rounds, live)
    order = np.argsort(-share, axis=1, kind="stable")
    base = reduce_rows(np.add, top[:, 0].astype(np.float64), bounds, 0.0)
    penalty = 0.5 * np.log(np.maximum(count, 1))
    # the best single language by likelihood, which need not have the largest share
    total = reduce_rows(np.add, logp.astype(np.float64), bounds, 0.0)
    single = total.argmax(1)
    best[np.arange(n), single] = 1
    value, size = total[np.arange(n), single] - penalty, np.ones(n, np.int64)
    for m in range(2, k + 1):
        # no set of m does better than all languages do without a penalty
        live = most + base - m * penalty > value
        if not live.any():
            break
        chosen = np.zeros((n, k), np.float32)
        np.put_along_axis(chosen, order[:, :m], 1, 1)
        start = chosen * np.maximum(share, 1e-6)
        got, fit = expect((start / start.sum(1, keepdims=True)).astype(np.float32), rounds // 2, live)
        fit = fit + base[live] - m * penalty[live]
        better = fit > value[live]
        at = np.flatnonzero(live)[better]
        value[at], size[at], best[at] = fit[better], m, got[better]
    best[count == 0], size[count == 0] = 0, 0
    return best, size, share


def _trigram_counts(languages: list[str], buckets: int):
    """(lang, bucket, context, n) of a task's documents (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            which = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            raw, offsets = utf8(batch.column(1))
            for i, j in passes(offsets, _PASS):
                points, at = code_points(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                full, context, where = trigrams(points, at, buckets)
                lang = which[i:j][np.searchsorted(at, where, "right") - 1]
                keys, n = np.unique((lang * buckets + full) * buckets + context, return_counts=True)
                yield pa.record_batch({"lang": (keys // buckets**2).astype(np.int32), "bucket": (keys // buckets % buckets).astype(np.int32), "context": (keys % buckets).astype(np.int32), "n": n.astype(np.int64)})

    return run


def model_of(languages: list[str], lang: np.ndarray, bucket: np.ndarray, context: np.ndarray, n: np.ndarray, buckets: int, smooth: float = 0.5, alphabet: int = 40) -> Model:
    """Character models from trigram counts; smooth counts are added to each context, spread over alphabet characters."""
    counts, contexts = np.zeros((buckets, len(languages))), np.zeros((buckets, len(languages)))
    context_of = np.zeros(buckets, np.int64)
    np.add.at(counts, (bucket, lang), n)
    np.add.at(contexts, (context, lang), n)
    # of contexts that meet in a bucket the largest number stands for all
    np.maximum.at(context_of, bucket, context)
    p = (counts + smooth / alphabet) / (contexts[context_of] + smooth)
    p[counts.sum(1) == 0] = smooth / alphabet
    return Model(languages, np.log(np.minimum(p, 1)).astype(np.float32))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_where=None, docs_per_language: int = 1_000, buckets: int = 1 << 17, **options) -> Model:
    """A model from about docs_per_language documents of each language, chosen by a hash of their ids; the driver gets the sums of their counts."""
    known = pick(docs, id=id_col, text=text_col, lang=lang_col).where("id is not null and lang is not null and text is not null")
    known = known.where(train_where) if train_where is not None else known
    known = known.withColumn("lang", F.col("lang").cast("string"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((buckets, 0), np.float32))
    share = F.create_map(*(F.lit(x) for lang in languages for x in (lang, docs_per_language / sizes[lang])))
    draw = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) / (1 << 30)
    sample = known.where(draw < F.element_at(share, F.col("lang"))).select("lang", "text")
    counted = sample.mapInArrow(_trigram_counts(languages, buckets), "lang int, bucket int, context int, n bigint")
    got = counted.groupBy("lang", "bucket", "context").agg(F.sum("n").alias("n")).toArrow()  # buckets bound the model of a language
    return model_of(languages, *(np.asarray(got[c]) for c in ("lang", "bucket", "context", "n")), buckets, **options)


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, n_languages, languages, proportions) of every document."""
    narrow = pick(docs, id=id_col, text=text_col)
    model = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"id {narrow.schema['id'].dataType.simpleString()}, lang_pred string, score double, n_languages int, languages array<string>, proportions array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for i, j in passes(offsets, _PASS):
                yield one(batch.column(0).slice(i, j - i), raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])

    def one(ids, raw, offsets) -> pa.RecordBatch:
        n, names = len(ids), model.value.languages
        points, at = code_points(raw, offsets)
        letters = reduce_rows(np.logical_or, _folded()[points] > 0, at, False)
        none_yet = np.zeros((n, 1)), np.zeros(n, np.int64), np.zeros((n, 1))
        logp, bounds = model.value.words(points, at)
        share, size, open_ = mixture(logp, bounds) if names else none_yet
        count = np.diff(bounds)
        top = share.argmax(1)
        none = ~letters | (size == 0)
        order = np.argsort(-share, axis=1, kind="stable")
        return pa.record_batch(
            {
                "id": ids,
                "lang_pred": [UNKNOWN if none[k] else names[top[k]] for k in range(n)],
                "score": np.where(none, 0.0, (open_[np.arange(n), top].astype(np.float64) * count + 1) / (count + max(1, len(names)))),
                "n_languages": np.where(none, 0, size).astype(np.int32),
                "languages": pa.array([[] if none[k] else [names[x] for x in order[k, : size[k]]] for k in range(n)], pa.list_(pa.string())),
                "proportions": pa.array([[] if none[k] else share[k, order[k, : size[k]]].tolist() for k in range(n)], pa.list_(pa.float64())),
            }
        )

    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)

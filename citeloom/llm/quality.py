"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its words, word pairs and triples and of the character
3- to 5-grams inside its words, all hashed into one table; a softmax over that average gives the class.
A word pair or triple is hashed twice, by its words and by which of them are equal, so that what is learned of one
repeated word holds for others.
The table and the softmax are trained in one task by stochastic gradient descent in numpy, on a bounded
sample of the labelled rows. The softmax is linear in the average, so a score needs one number per table
entry; executors get that vector (1 MB) and score whole texts in one map, without a shuffle.

Defined cases: a null or empty text has no features and gets the softmax of the bias alone; a very long text is read
whole, in memory in proportion to its length; rows without a label or with a null id never train, but a null id gets a
score; repeated ids train as the join makes them; labels without a document take no place in the sample, and ties in
its order go by id and label; with no labelled rows, or one class only, every score is 0.5 or that class's smoothed
share; an empty table gives an empty result; other columns, clashing names among them, are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SpanHash, ddl, mix, numbered, passes, pick, reduce_rows, row_bounds, utf8

#: Code points that separate words: white space of ASCII and the usual wider ones.
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x2028, 0x2029, 0x3000]
#: Text bytes in one numpy pass; a byte needs about 100 bytes of intermediate arrays.
_PASS = 1_000_000
#: The same while training, beside the sample's features.
_TRAIN_PASS = 250_000


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and their row offsets as code points and offsets."""
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(points) == len(raw):
        return points, offsets
    starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return points, starts[offsets]


def features(points: np.ndarray, offsets: np.ndarray, buckets: int, hasher: SpanHash) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, position of its first code point) of every feature, in blocks by kind."""
    n = len(points)
    if not n:
        return
    mask = np.uint64(buckets - 1)
    space = np.isin(points, _SPACES)
    word = ~space
    first, last = word.copy(), word.copy()
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    edges = offsets[:-1][offsets[:-1] < n]
    first[edges] = word[edges]
    ends_at = offsets[1:][offsets[1:] > 0] - 1
    last[ends_at] = word[ends_at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    h = hasher(points, starts, ends)
    yield (h & mask).astype(np.int64), starts
    two = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, np.int64)
    pair = mix(h[two] * np.uint64(3) + h[two + 1])
    yield (pair & mask).astype(np.int64), starts[two]
    equal = (h[two] == h[two + 1]).astype(np.uint64)
    yield (mix(equal + np.uint64(16)) & mask).astype(np.int64), starts[two]
    three = two[:-1][two[1:] == two[:-1] + 1]
    triple = mix(h[three] * np.uint64(9) + h[three + 1] * np.uint64(3) + h[three + 2] + np.uint64(1))
    yield (triple & mask).astype(np.int64), starts[three]
    equal = (h[three] == h[three + 1]) + 2 * (h[three + 1] == h[three + 2]) + 4 * (h[three] == h[three + 2])
    yield (mix(equal.astype(np.uint64) + np.uint64(32)) & mask).astype(np.int64), starts[three]
    # n-grams of a word between its two edges; an edge counts as one symbol
    padded = np.zeros(n + 2 * len(starts), np.uint32)
    before = np.zeros(n + 1, np.int64)
    np.add.at(before, starts, 1)
    np.add.at(before, ends, 1)
    at = np.arange(n) + np.cumsum(before)[:n]
    padded[at] = np.where(space, 0x20, points)
    inner = np.zeros(len(padded), bool)
    inner[at] = word
    origin = np.zeros(len(padded), np.int64)
    origin[at] = np.arange(n)
    origin = np.maximum.accumulate(origin)
    key = padded.astype(np.uint64) + np.uint64(1)
    gram = key.copy()
    solid = np.ones(len(key), bool)
    for size in range(2, 6):
        gram = gram[:-1] * np.uint64(0x100000001B3) + key[size - 1 :]
        if size >= 3:
            solid = solid[: len(gram)] & inner[size - 2 : size - 2 + len(gram)]
            good = np.flatnonzero(solid)
            if len(good):
                yield (mix(gram[good] + np.uint64(size)) & mask).astype(np.int64), origin[good + 1]


@dataclass
class Model:
    """weight: logit contribution of each bucket to class 1 against class 0; bias: of every document."""

    weight: np.ndarray
    bias: float

    def score(self, raw: np.ndarray, offsets: np.ndarray, hasher: SpanHash) -> np.ndarray:
        points, at = code_points(raw, offsets)
        n = len(at) - 1
        total, count = np.zeros(n), np.zeros(n)
        for bucket, where in features(points, at, len(self.weight), hasher):
            if len(where):
                bounds = np.searchsorted(where, at)
                total += reduce_rows(np.add, self.weight[bucket].astype(np.float64), bounds, 0.0)
                count += np.diff(bounds)
        return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.bias)))


def train(texts: pa.Array, labels: np.ndarray, *, buckets: int = 1 << 18, width: int = 8, epochs: int = 4, rate: float = 0.5, batch: int = 32, seed: int = 7) -> Model:
    """Embeddings and softmax by mini-batch gradient descent with per-entry step sizes."""
    if len(labels) == 0 or labels.min() == labels.max():
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(buckets, np.float32), float(np.log(share / (1 - share))) if len(labels) else 0.0)
    hasher, bags = SpanHash(), []
    raw, offsets = utf8(texts)
    for i, j in passes(offsets, _TRAIN_PASS):
        points, at = code_points(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        parts = [(b, w) for b, w in features(points, at, buckets, hasher)]
        rows = np.concatenate([np.searchsorted(at, w, "right") - 1 for _, w in parts]) if parts else np.zeros(0, np.int64)
        hits = np.concatenate([b for b, _ in parts]) if parts else np.zeros(0, np.int64)
        keys, counts = np.unique(rows * buckets + hits, return_counts=True)
        bounds = row_bounds(keys // buckets, j - i)
        for k in range(j - i):
            own = slice(bounds[k], bounds[k + 1])
            bags.append(((keys[own] % buckets).astype(np.int32), (counts[own] / max(1, counts[own].sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / width, 1 / width, (buckets, width)).astype(np.float32)
    out = np.zeros((width, 2), np.float32)
    bias = np.zeros(2, np.float32)
    seen_table, seen_out, seen_bias = np.full(buckets, 1e-8, np.float32), np.full((width, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    # rare classes weigh as much as common ones, up to a factor of 4
    share = np.array([(labels == c).mean() for c in (0, 1)])
    weigh = np.minimum(4.0, 0.5 / share).astype(np.float32)
    for _ in range(epochs):
        for some in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // batch)):
            ids = np.concatenate([bags[k][0] for k in some])
            parts = np.concatenate([bags[k][1] for k in some])
            sizes = np.array([len(bags[k][0]) for k in some])
            row = np.repeat(np.arange(len(some)), sizes)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            mean = reduce_rows(np.add, table[ids] * parts[:, None], bounds, np.float32(0))
            logits = mean @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            y = labels[some].astype(int)
            p[np.arange(len(some)), y] -= 1
            p *= weigh[y][:, None] / len(some)
            grad_out, grad_bias, grad_mean = mean.T @ p, p.sum(0), p @ out.T
            seen_out += grad_out**2
            seen_bias += grad_bias**2
            out -= rate * grad_out / np.sqrt(seen_out)
            bias -= rate * 0.1 * grad_bias / np.sqrt(seen_bias)
            step = grad_mean[row] * parts[:, None]
            which, inverse = np.unique(ids, return_inverse=True)
            total = np.stack([np.bincount(inverse, step[:, c], len(which)) for c in range(width)], 1)
            seen_table[which] += (total**2).mean(1)
            table[which] -= rate * total / np.sqrt(seen_table[which])[:, None]
    return Model(table @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_where=None, max_train_docs: int = 4_000, **options) -> Model:
    """A model from at most max_train_docs labelled documents, those with the least hash of their id.

    train_where: a condition on the column id that labelled rows must meet to train.
    """
    known = pick(labels, id=id_col, label=label_col).where("id is not null and label in (0, 1)")
    known = known.where(train_where) if train_where is not None else known
    texts = pick(docs, id=id_col, text=text_col)
    known = known.join(texts.select("id"), "id", "left_semi").orderBy(F.xxhash64(F.col("id"), F.lit(7)), "id", "label").limit(max_train_docs)
    rows = texts.join(F.broadcast(known), "id")  # known: max_train_docs rows at most
    sample = rows.orderBy("id", "label", "text").limit(2 * max_train_docs).select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        labels = np.concatenate([np.asarray(b.column(0)) for b in held]) if held else np.zeros(0, np.int64)
        texts = pa.concat_arrays([b.column(1) for b in held]) if held else pa.array([], pa.string())
        model = train(texts, labels, **options)
        yield pa.record_batch({"weight": pa.array([model.weight.astype(np.float32).tobytes()], pa.binary()), "bias": [model.bias]})

    # the sample is one partition, so one task trains, and the driver gets the model alone
    got = sample.select(F.col("label").cast("bigint").alias("label"), "text").coalesce(1).mapInArrow(run, "weight binary, bias double").collect()
    return Model(np.frombuffer(got[0]["weight"], np.float32), got[0]["bias"]) if got else train(pa.array([], pa.string()), np.zeros(0, np.int64), **options)


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash()
        for batch in batches:
            raw, offsets = utf8(batch.column(batch.num_columns - 1))
            for i, j in passes(offsets, _PASS):
                got = pa.array(model.score(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], hasher))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:-1]), got], names=[*batch.schema.names[:-1], "score_of"])

    return run


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every document: the probability of class 1."""
    narrow = pick(docs, id=id_col, text=text_col)
    out = narrow.mapInArrow(_scores(model), f"id {narrow.schema['id'].dataType.simpleString()}, score_of double")
    return out.toDF(id_col, "score")


def accepted(docs: DataFrame, model: Model, *, text_col: str = "text", least: float = 0.7) -> DataFrame:
    """The rows of docs, all columns as they are, whose score is at least least."""
    flat, at = numbered(docs, text=text_col)
    scored = flat.withColumn("text_of", F.col(at["text"])).mapInArrow(_scores(model), f"{ddl(flat)}, score_of double")
    return scored.where(F.col("score_of") >= least).drop("score_of").toDF(*docs.columns)

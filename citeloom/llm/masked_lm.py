"""LM scoring by masked pseudo-likelihood.

A bidirectional window network, written in numpy, predicts every word from the two words on either side: the
vectors of the four neighbours, each in a place of its own, pass a hidden layer, and a softmax tree of three levels
with 32 branches each gives the word's leaf; on the last level the 8,192 most frequent words depend on the neighbours,
rarer ones on their leaf's share of its node alone. A document's score is the sum of the log-probabilities of its
words, each with the word itself hidden.

The vocabulary is every word of all documents, with counts over the whole corpus. The 30,720 most frequent words have a
leaf of their own; all others fall into 2,048 leaves by hash, and such a word's probability is its leaf's times its
share of the leaf's count, with one count set aside in each for a word that was never counted. The counts of the next
most frequent words travel with the network, those of all others are joined. The network starts as the word
frequencies; training is distributed: documents are dealt by a hash of their id and text into slices of about four
million words, a task improves the shared network on all documents of its slice in the order of another hash, and
the networks are averaged, each number weighted by the squared gradients that the slice has for it, so a word counts
where it occurs. Slices depend on the rows alone, so neither the number of files nor of executors changes the result.
Averages are taken by parts of the parameters in two steps; neither the driver nor a task gathers all networks.

Defined cases: a null or empty text has no words, score 0 and a mean of null; a word that was never counted has the
share of one count in its leaf; words of equal count are ordered by hash; a very long text is scored in passes; null
ids are trained on and scored like others; repeated rows give repeated results; an empty table gives an empty result;
other columns, clashing names among them, are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, SPACE, SpanHash, checkpoint, passes, pick, reduce_rows, row_bounds, spans, utf8

FAN = 32
VOCABULARY = FAN**3
#: Nodes of the last level, those of the most frequent words, whose branches depend on the neighbours.
NEAR = 256
#: Leaves that share the words without one of their own; they are the last.
GROUP_BITS = 11
GROUPS = 1 << GROUP_BITS
SIDE, WIDTH, HIDDEN = 2, 12, 24
#: Stands outside a text.
_EDGE = VOCABULARY
#: Words in shared leaves whose counts every task holds; it only spares rows of the join.
COMMON = 1 << 18
#: Words that one training slice holds, and parameters of one row on their way to the average.
SLICE_WORDS, _PART = 4_000_000, 1 << 16
_PASS = 1_000_000
_TINY = np.float32(1e-10)


def _words(raw: np.ndarray, offsets: np.ndarray, hasher: SpanHash) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER[raw]
    starts, ends, rows = spans(~SPACE[data], offsets)
    return hasher(data, starts, ends), rows


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = SpanHash()
    for batch in batches:
        raw, offsets = utf8(batch.column(0))
        for i, j in passes(offsets, 4 * _PASS):
            words, _ = _words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], hasher)
            unique, counts = np.unique(words, return_counts=True)
            yield pa.record_batch({"word": unique.view(np.int64), "n": counts.astype(np.int64)})


@dataclass
class Vocabulary:
    """top: the sorted hashes of words with a leaf and, in step with them, their ids by rank, as rows of one array;
    common: the sorted hashes of the next ones and their counts; totals: the counts of each shared leaf, and one;
    leaves: the counts of all leaves; counts: (word, n) of all words."""

    top: np.ndarray
    common: np.ndarray
    totals: np.ndarray
    leaves: np.ndarray
    counts: DataFrame


def _group(word: Column) -> Column:
    return F.shiftrightunsigned(word, 64 - GROUP_BITS).cast("int")


def vocabulary(docs: DataFrame, text_col: str) -> Vocabulary:
    counted = checkpoint(pick(docs, text=text_col).mapInArrow(_counts, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    own, most = VOCABULARY - GROUPS, VOCABULARY - GROUPS + COMMON
    # the most frequent words without a sort: all above a step of the counts, and at the step those of the least hashes
    step = F.floor(F.ln("n") * 64).cast("int")
    left, least, part = most, -1, 1.0
    for r in counted.groupBy(step.alias("b")).agg(F.count("*").alias("k")).orderBy(F.desc("b")).collect():  # some 2,000 steps
        if r["k"] > left:
            least, part = r["b"], left / r["k"]
            break
        left -= r["k"]
    chance = F.shiftrightunsigned(F.xxhash64("word"), 33) / float(1 << 31)
    first = counted.where((step > least) | (step == least) & (chance < part)).toArrow()
    hashes, n = np.asarray(first["word"]).view(np.uint64), np.asarray(first["n"])
    rank = np.lexsort((hashes, -n))
    hashes, n = hashes[rank], n[rank]
    order, rest = np.argsort(hashes[:own]), np.argsort(hashes[own:])
    totals = np.ones(GROUPS)
    for r in counted.groupBy(_group(F.col("word")).alias("g")).agg(F.sum("n").alias("n")).collect():
        totals[r["g"]] += r["n"]
    np.subtract.at(totals, group_of(hashes[:own]), n[:own])
    leaves = np.concatenate([n[:own], np.zeros(own - len(n[:own])), totals])
    return Vocabulary(np.stack([hashes[:own][order], order.astype(np.uint64)]), np.stack([hashes[own:][rest], n[own:][rest].astype(np.uint64)]), totals, leaves, counted)


def group_of(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - GROUP_BITS)).astype(np.int64)


def shares(words: np.ndarray, ids: np.ndarray, common: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log of each word's share of its leaf, 0 for words with a leaf of their own, and which words' shares are to be joined."""
    out, rare = np.zeros(len(words)), ids >= VOCABULARY - GROUPS
    if common.shape[1]:
        of = np.flatnonzero(rare)
        at = np.minimum(np.searchsorted(common[0], words[of]), common.shape[1] - 1)
        same = common[0][at] == words[of]
        of, at = of[same], at[same]
        out[of] = np.log(common[1][at] / totals[ids[of] - (VOCABULARY - GROUPS)])
        rare[of] = False
    return out, rare


def ids_of(words: np.ndarray, known: np.ndarray) -> np.ndarray:
    out = VOCABULARY - GROUPS + group_of(words)
    if known.shape[1]:
        at = np.minimum(np.searchsorted(known[0], words), known.shape[1] - 1)
        same = known[0][at] == words
        out[same] = known[1][at[same]]
    return out


def contexts(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each word the ids of SIDE neighbours on either side; beyond the text stands the edge."""
    out = np.full((len(ids), 2 * SIDE), _EDGE, np.int64)
    for k in range(1, SIDE + 1):
        same = rows[k:] == rows[:-k]
        out[k:, SIDE - k][same] = ids[:-k][same]
        out[:-k, SIDE + k - 1][same] = ids[k:][same]
    return out


def _softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp(z - top), its row sums and top: one for all rows, or each row's own where that could lose a row."""
    top = z.max(keepdims=True) if z.size else np.zeros((1, 1), z.dtype)
    if z.size and top[0, 0] - z.min() > 60:
        top = z.max(1, keepdims=True)
    p = np.exp(z - top)
    return p, p @ np.ones(p.shape[1], p.dtype), top[:, 0]


class Network:
    """vectors: id × WIDTH; inner: places × HIDDEN; a softmax over FAN branches at the root, at each of FAN classes and at NEAR of FAN² nodes;
    fixed: the log of each leaf's share of its node, for the other nodes."""

    shapes = {"vectors": (VOCABULARY + 1, WIDTH), "inner": (2 * SIDE * WIDTH, HIDDEN), "inner_bias": (HIDDEN,), "out0": (1, HIDDEN, FAN), "bias0": (1, FAN), "out1": (FAN, HIDDEN, FAN), "bias1": (FAN, FAN), "out2": (NEAR, HIDDEN, FAN), "bias2": (NEAR, FAN), "fixed": (FAN * FAN - NEAR, FAN)}

    def __init__(self, flat: np.ndarray) -> None:
        self.flat, at = flat, 0
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n
        self.levels = [(self.out0, self.bias0), (self.out1, self.bias1), (self.out2, self.bias2)]

    @classmethod
    def start(cls, seed: int, leaves: np.ndarray | None = None) -> Network:
        """Random vectors under a tree that gives the frequencies of leaves, or all leaves alike."""
        rng = np.random.default_rng(seed)
        net = cls(np.zeros(sum(int(np.prod(s)) for s in cls.shapes.values()), np.float32))
        net.vectors[:] = rng.normal(0, 0.3, net.vectors.shape)
        net.inner[:] = rng.normal(0, net.inner.shape[0] ** -0.5, net.inner.shape)
        counts = (np.zeros(VOCABULARY) if leaves is None else leaves) + 0.1
        for _, bias in reversed(net.levels):
            log = np.log(counts).reshape(-1, FAN)
            bias[:] = log[: len(bias)]
            counts = counts.reshape(-1, FAN).sum(1)
            if bias is net.bias2:
                net.fixed[:] = log[NEAR:] - np.log(counts[NEAR:, None])
        return net

    def inputs(self, context: np.ndarray) -> np.ndarray:
        return self.vectors.take(context.ravel(), 0).reshape(len(context), -1)

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.inner + self.inner_bias)

    def nodes(self, h: np.ndarray, target: np.ndarray) -> Iterator[tuple]:
        """For each level its number, the words that have one in order of their node there, (node, start, end) of each that occurs, and in that order h, the logits and the branches taken."""
        for k, (out, bias) in enumerate(self.levels):
            leaf = target // FAN ** (2 - k)
            node, branch = leaf // FAN, leaf % FAN
            order = np.argsort(node.astype(np.uint16), kind="stable") if k else np.arange(len(node))
            own = node[order]
            if k == 2:
                own = own[: np.searchsorted(own, NEAR)]
                order = order[: len(own)]
            cuts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]]) if len(own) else np.zeros(1, np.int64)
            runs = list(zip(own[cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            held = h.take(order, 0) if k else h
            z = bias.take(own, 0)
            for c, i, j in runs:
                z[i:j] += held[i:j] @ out[c]
            yield k, order, runs, held, z, branch[order]

    def log_p(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        h = self.hidden(self.inputs(context))
        total = np.where(target >= NEAR * FAN, self.fixed.ravel()[np.maximum(target - NEAR * FAN, 0)], 0.0)
        for _, order, _, _, z, branch in self.nodes(h, target):
            _, whole, top = _softmax(z)
            total[order] += z[np.arange(len(z)), branch] - np.log(whole) - top
        return total

    def step(self, context: np.ndarray, target: np.ndarray, seen: Network, rate: float, grad: Network | None = None) -> None:
        """One step of gradient descent with step sizes for each parameter; grad: room for the gradient."""
        n = len(target)
        grad = Network(np.empty_like(self.flat)) if grad is None else grad
        grad.flat[:] = 0
        x = self.inputs(context)
        h = self.hidden(x)
        back = np.zeros_like(h)
        for k, order, runs, held, z, branch in self.nodes(h, target):
            p, whole, _ = _softmax(z)
            p /= whole[:, None]
            p[np.arange(len(p)), branch] -= 1
            (out, _), (grad_out, grad_bias) = self.levels[k], grad.levels[k]
            inner = np.empty_like(held)
            for c, i, j in runs:
                grad_out[c] = held[i:j].T @ p[i:j]
                np.matmul(p[i:j], out[c].T, out=inner[i:j])
            if runs:
                grad_bias[[c for c, _, _ in runs]] = np.add.reduceat(p, [i for _, i, _ in runs], axis=0)
            back[order] += inner
        back *= 1 - h * h
        grad.inner[:], grad.inner_bias[:] = x.T @ back, back.sum(0)
        by_place = (back @ self.inner.T).reshape(n * 2 * SIDE, WIDTH)
        flat = context.ravel()
        for k in range(WIDTH):
            grad.vectors[:, k] = np.bincount(flat, by_place[:, k], VOCABULARY + 1)
        # a few thousand numbers at a time stay in the processor's cache
        for i in range(0, len(self.flat), 1 << 14):
            g, own, past = grad.flat[i : i + (1 << 14)], self.flat[i : i + (1 << 14)], seen.flat[i : i + (1 << 14)]
            g *= 1 / n
            past += g * g
            g /= np.sqrt(past + _TINY)
            g *= rate
            own -= g


def _train(network, rate: float, batch_words: int):
    """Rows (part, slice, values, weights) of the network that one slice's documents make of the shared one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, known = network.value
        hasher, own, seen, at, grad = SpanHash(), None, None, None, Network(np.empty_like(shared))

        def done() -> Iterator[pa.RecordBatch]:
            for k in range(0, len(own.flat), _PART):
                values, weights = (x.flat[k : k + _PART].tobytes() for x in (own, seen))
                yield pa.record_batch({"part": pa.array([k // _PART], pa.int32()), "slice": pa.array([at], pa.int32()), "values": pa.array([values], pa.binary()), "weights": pa.array([weights], pa.binary())})

        for batch in batches:
            slices = np.asarray(batch.column(1))
            cuts = [0, *(np.flatnonzero(slices[1:] != slices[:-1]) + 1).tolist(), len(slices)]
            for first, last in zip(cuts, cuts[1:], strict=False):
                if first == last:
                    continue
                if at != slices[first]:
                    if at is not None:
                        yield from done()
                    at, own, seen = int(slices[first]), Network(shared.copy()), Network(np.zeros_like(shared))
                raw, offsets = utf8(batch.column(0).slice(first, last - first))
                for i, j in passes(offsets, _PASS):
                    words, rows = _words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], hasher)
                    ids = ids_of(words, known)
                    context = contexts(ids, rows)
                    order = np.random.default_rng(len(ids)).permutation(len(ids))
                    for some in np.array_split(order, max(1, len(order) // batch_words)) if len(order) else ():
                        own.step(context[some], ids[some], seen, rate, grad)
        if at is not None:
            yield from done()

    return run


def _average(shared, last: bool):
    """(part, slice, values, weights) to one row a part; values are sums of weighted values until the last step divides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for part, values, weights in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                # rows of one slice are single precision, sums are double
                kind = np.float64 if last else np.float32
                w = np.frombuffer(weights, kind).astype(np.float64)
                v = np.frombuffer(values, kind) if last else np.frombuffer(values, kind) * w
                if part in held:
                    held[part][0] += v
                    held[part][1] += w
                else:
                    held[part] = [v.astype(np.float64), w]
        for part, (v, w) in sorted(held.items()):
            if last:
                old = shared.value[0][part * _PART : part * _PART + len(v)]
                v, w = np.where(w > 0, v / np.maximum(w, 1e-300), old).astype(np.float32), w[:0]
            yield pa.record_batch({"part": pa.array([part], pa.int32()), "slice": pa.array([0], pa.int32()), "values": pa.array([v.tobytes()], pa.binary()), "weights": pa.array([w.tobytes()], pa.binary())})

    return run


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1, rate: float = 0.1, batch_words: int = 8192, slice_words: int = SLICE_WORDS, fan_in: int = 32, seed: int = 5) -> tuple[np.ndarray, Vocabulary]:
    """(network, vocabulary), trained on all documents."""
    known = vocabulary(docs, text_col)
    sc = docs.sparkSession.sparkContext
    network = Network.start(seed, known.leaves).flat
    n = max(1, round(known.leaves.sum() / slice_words))
    dealt = pick(docs, id=id_col, text=text_col).where("text is not null").select("text", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int").alias("slice"), F.xxhash64("text", "id").alias("place"))
    dealt = dealt.repartitionById(n, "slice").sortWithinPartitions("slice", "place").select("text", "slice")
    schema = "part int, slice int, values binary, weights binary"
    for r in range(rounds):
        shared = sc.broadcast((network, known.top))
        parts = dealt.mapInArrow(_train(shared, rate / (1 + r), batch_words), schema)
        some = parts.repartition(fan_in, "part", F.pmod("slice", F.lit(8))).sortWithinPartitions("part", "slice").mapInArrow(_average(shared, False), schema)
        rows = checkpoint(some.repartition("part").sortWithinPartitions("part", F.xxhash64("values")).mapInArrow(_average(shared, True), schema)).orderBy("part").collect()  # one network
        if rows:
            network = np.concatenate([np.frombuffer(r["values"], np.float32) for r in rows])
    return network, known


def score(docs: DataFrame, network: np.ndarray, known: Vocabulary, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, log_likelihood, mean_log_likelihood) of every document."""
    narrow = pick(docs, id=id_col, text=text_col)
    model = docs.sparkSession.sparkContext.broadcast((network, known.top, known.common, known.totals))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, top, common, totals = model.value
        hasher, net, key = SpanHash(), Network(flat), TaskContext.get().partitionId() << 40
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for i, j in passes(offsets, _PASS):
                words, rows = _words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], hasher)
                ids = ids_of(words, top)
                context = contexts(ids, rows)
                parts = [net.log_p(context[k : k + 32768], ids[k : k + 32768]) for k in range(0, len(ids), 32768)]
                within, rare = shares(words, ids, common, totals)
                bounds = row_bounds(rows, j - i)
                total = reduce_rows(np.add, np.concatenate(parts) + within if parts else np.zeros(0), bounds, 0.0)
                open_ = pa.ListArray.from_arrays(pa.array(row_bounds(rows[rare], j - i), pa.int32()), pa.array(words[rare].view(np.int64)))
                yield pa.record_batch({"id": batch.column(0).slice(i, j - i), "n_words": np.diff(bounds), "sum": total, "key": np.arange(key, key + j - i), "open": open_})
                key += j - i

    kind = narrow.schema["id"].dataType.simpleString()
    held = checkpoint(narrow.mapInArrow(run, f"id {kind}, n_words bigint, sum double, key bigint, open array<bigint>"))
    share = F.ln(F.coalesce("n", F.lit(1)) / F.element_at(F.lit([float(t) for t in known.totals]), _group(F.col("word")) + 1))
    joined = held.select("key", F.explode("open").alias("word")).join(known.counts, "word", "left").groupBy("key").agg(F.sum(share).alias("more"))
    whole = held.drop("open").join(joined, "key", "left").withColumn("sum", F.col("sum") + F.coalesce("more", F.lit(0.0)))
    mean = F.when(F.col("n_words") > 0, F.col("sum") / F.col("n_words"))
    return whole.select(F.col("id").alias(id_col), "n_words", F.col("sum").alias("log_likelihood"), mean.alias("mean_log_likelihood"))

"""Benchmark decontamination: an FM-index over every training shard answers all test phrases.

A shard is a few megabytes of documents that one task has read. Its words become symbols of the
benchmark's own vocabulary; runs of other words, which no phrase can cross, shrink to one symbol. The
shard's suffix array gives its Burrows-Wheeler transform, a wavelet tree over that gives ranks, and
backward search finds the rows of all phrases at once. Occurrences are located by walking to the nearest
sampled suffix, and their word spans are merged per document. Nothing is shuffled: the phrases go to the
documents, and a benchmark beyond a bound goes in several passes.

Defined cases: a null or empty text has no words and no hits; an item without words has no window; an item
with fewer words than the window is one window of its own length; repeated items hit and count as one; items without
an id hit like others and count as one, but no id of theirs is listed; ids may have any type and are passed on, null or
not; windows that tie in a document merge their spans; a very long text is a shard of its own, in memory in proportion to
its length; empty tables give empty results or results without hits; other columns, clashing names among them, are never
read or pass through unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, SpanHash, checkpoint, ddl, named_again, numbered, passes, pick, row_bounds, spans, utf8

WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

RESULT = "id {id}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, item_ids array<string>, spans array<struct<start:int,end:int>>, clean_text string"


class WaveletTree:
    """Ranks over a sequence of small integers: one bit vector with popcounts for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        self.depth = max(1, int(n_symbols - 1).bit_length())
        self.levels = []
        for shift in range(self.depth - 1, -1, -1):
            bits = (symbols >> shift) & 1
            padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
            padded[: len(bits)] = bits
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words)[:-1], out=before[1:])
            ones = bits.astype(bool)
            self.levels.append((shift, words, before, int(len(bits) - ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(words[word] & below)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low, high = np.zeros_like(at), at
        for shift, words, before, zeros in self.levels:
            one = (symbol >> shift) & 1 == 1
            a, b = self._ones(words, before, low), self._ones(words, before, high)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; each round sorts only the suffixes that still tie."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    new = np.ones(n, bool)
    new[1:] = symbols[order][1:] != symbols[order][:-1]
    heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = heads, -1
    step = 1
    while True:
        single = new.copy()
        single[:-1] &= new[1:]
        open_ = np.flatnonzero(~single)
        if not len(open_):
            return order
        who = order[open_]
        follow = rank[np.minimum(who + step, n)]
        by = np.lexsort((follow, rank[who]))
        who, follow = who[by], follow[by]
        order[open_] = who
        fresh = np.ones(len(who), bool)
        fresh[1:] = (follow[1:] != follow[:-1]) | (rank[who][1:] != rank[who][:-1])
        new[open_] = fresh
        heads = np.maximum.accumulate(np.where(fresh, open_, 0))
        rank[who] = heads
        step *= 2


class FMIndex:
    """Counts and locates phrases in one sequence of symbols from 1 up; 0 is kept for its end."""

    def __init__(self, symbols: np.ndarray, n_symbols: int, sample: int = 16) -> None:
        text = np.append(symbols, 0)
        order = suffix_array(text)
        self.tree = WaveletTree(text[order - 1], n_symbols)
        self.bwt = text[order - 1]
        counts = np.bincount(text, minlength=n_symbols)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.sampled = order % sample == 0
        self.before = np.cumsum(self.sampled) - 1
        self.positions = order[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of the suffixes that begin with each phrase; phrases: one a row."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.sampled), np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            c = phrases[live, j]
            low[live] = self.first[c] + self.tree.rank(c, low[live])
            high[live] = self.first[c] + self.tree.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of the suffixes at rows, by walking back to sampled ones."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        walk = np.arange(len(rows))
        while len(walk):
            done = self.sampled[rows[walk]]
            hit = walk[done]
            out[hit] = self.positions[self.before[rows[hit]]] + steps[hit]
            walk = walk[~done]
            c = self.bwt[rows[walk]]
            rows[walk] = self.first[c] + self.tree.rank(c, rows[walk])
            steps[walk] += 1
        return out


class Phrases:
    """The windows of a block of benchmark items as rows of symbols, by length, with the items that hold each."""

    def __init__(self, item_ids: list[str | None], texts: pa.Array, window: int) -> None:
        data, offsets = utf8(texts)
        data = LOWER[data]
        starts, ends, rows = spans(WORD[data], offsets)
        hashes = SpanHash()(data, starts, ends)
        self.vocabulary, symbols = np.unique(hashes, return_inverse=True)
        symbols = symbols + 2  # 0 ends a shard, 1 stands for words of no item
        self.n_symbols = len(self.vocabulary) + 2
        bounds = row_bounds(rows, len(offsets) - 1)
        found: dict[int, list] = {}
        for i in range(len(offsets) - 1):
            own = symbols[bounds[i] : bounds[i + 1]]
            if len(own):
                w = min(window, len(own))
                views = np.lib.stride_tricks.sliding_window_view(own, w)
                found.setdefault(w, []).append((views, np.full(len(views), i)))
        self.by_length = []
        for parts in found.values():
            windows, held = np.concatenate([v for v, _ in parts]), np.concatenate([i for _, i in parts])
            phrases, which = np.unique(windows, axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), held], 1), axis=0)
            self.by_length.append((phrases, row_bounds(pairs[:, 0], len(phrases)), pairs[:, 1]))
        self.item_ids = item_ids

    def symbols_of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.ones(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 2, 1)

    def occurrences(self, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first word, words, row, item index) of every window of every item among the words of a shard."""
        symbols = self.symbols_of(hashes)
        keep = symbols > 1
        inner = np.flatnonzero(keep[1:] & keep[:-1] & (rows[1:] == rows[:-1])) + 1 if len(keep) else np.zeros(0, np.int64)
        joined = np.zeros(len(symbols), bool)
        joined[inner] = True
        # a gap symbol stands before every kept word that does not follow a kept word of its own row
        kept = np.flatnonzero(keep)
        place = np.arange(len(kept)) + np.cumsum(~joined[kept])
        text = np.ones(int(place[-1]) + 1 if len(kept) else 0, np.int64)
        text[place] = symbols[kept]
        word_at = np.zeros(len(text), np.int64)
        word_at[place] = kept
        none = np.zeros(0, np.int64)
        if not len(text):
            return none, none, none, none
        index = FMIndex(text, self.n_symbols)
        first, length, item = [none], [none], [none]
        for phrases, bounds, items in self.by_length:
            low, high = index.search(phrases)
            count = high - low
            which = np.repeat(np.arange(len(phrases)), count)
            at = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
            begin = word_at[index.locate(at)]
            many = bounds[which + 1] - bounds[which]
            item.append(items[np.repeat(bounds[which], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)])
            first.append(np.repeat(begin, many))
            length.append(np.full(int(many.sum()), phrases.shape[1]))
        first, length, item = np.concatenate(first), np.concatenate(length), np.concatenate(item)
        return first, length, rows[first], item


def _shards(phrases, *, text: bool, spans_too: bool, keep: int | None = None, last: bool = True):
    """A pass over documents, the text in the last column; phrases: the broadcast windows of its items.

    Two columns before the text hold what earlier passes have found, a bit for each word and the items; an earlier pass
    gives the same columns again. The last one gives the facts of a document, or with keep its first keep columns with
    the text without hits and the counts of words and hits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash()
        for batch in batches:
            raw, offsets = utf8(batch.column(batch.num_columns - 1))
            for i, j in passes(offsets):
                yield one(batch.slice(i, j - i), raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], hasher)

    def one(part: pa.RecordBatch, raw: np.ndarray, offsets: np.ndarray, hasher: SpanHash) -> pa.RecordBatch:
        n = len(part)
        low = LOWER[raw]
        starts, ends, rows = spans(WORD[low], offsets)
        hashes = hasher(low, starts, ends)
        bounds = row_bounds(rows, n)
        edge = np.zeros(len(starts) + 1, np.int64)
        first, length, row, item = phrases.value.occurrences(hashes, rows)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + length, -1)
        hit = np.cumsum(edge)[:-1] > 0
        own: list[set[str | None]] = [set() for _ in range(n)]
        for k, x in np.unique(np.stack([row, item], 1), axis=0).tolist():
            own[k].add(phrases.value.item_ids[x])
        before = part.column(part.num_columns - 3)
        for k, (bits, items) in enumerate(zip(before, part.column(part.num_columns - 2), strict=True)) if before.null_count < n else ():
            if bits.as_py():
                hit[bounds[k] : bounds[k + 1]] |= np.unpackbits(np.frombuffer(bits.as_py(), np.uint8), count=bounds[k + 1] - bounds[k]).astype(bool)
                own[k].update(items.as_py())
        total = np.concatenate([[0], np.cumsum(hit)])
        n_hit = total[bounds[1:]] - total[bounds[:-1]]
        if not last:
            bits = [np.packbits(hit[bounds[k] : bounds[k + 1]]).tobytes() if n_hit[k] else None for k in range(n)]
            return pa.RecordBatch.from_arrays([*part.columns[:-3], pa.array(bits, pa.binary()), pa.array([list(x) for x in own], pa.list_(pa.string())), part.columns[-1]], names=part.schema.names)
        item_lists = [sorted(x - {None}) for x in own]
        found, clean = [], []
        for k in range(n):
            cuts = []
            if (spans_too or text) and n_hit[k]:
                turn = np.diff(np.concatenate([[0], hit[bounds[k] : bounds[k + 1]].astype(np.int8), [0]]))
                begin, end = bounds[k] + np.flatnonzero(turn == 1), bounds[k] + np.flatnonzero(turn == -1) - 1
                cuts = list(zip((starts[begin] - offsets[k]).tolist(), (ends[end] - offsets[k]).tolist(), strict=True))
            found.append([{"start": x, "end": y} for x, y in cuts] if spans_too else None)
            if text and cuts:
                body, cut = raw[offsets[k] : offsets[k + 1]].tobytes(), 0
                kept = []
                for x, y in cuts:
                    kept.append(body[cut:x])
                    cut = y
                clean.append(b"".join([*kept, body[cut:]]).decode())
            else:
                clean.append(part.column(part.num_columns - 1)[k].as_py() if text else None)
        cleaned, n_words = pa.array(clean, pa.string()), pa.array(np.diff(bounds), pa.int64())
        if keep is not None:
            return pa.RecordBatch.from_arrays([*part.columns[:keep], cleaned, n_words, pa.array(n_hit, pa.int64())], names=[*part.schema.names[:keep], "text_of", "words_of", "hit_of"])
        return pa.record_batch(
            {
                "id": part.column(0),
                "n_words": n_words,
                "n_hit": n_hit,
                "n_items": np.array([len(x) for x in own], np.int64),
                "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in item_lists],
                "contaminated": n_hit > 0,
                "item_ids": pa.array(item_lists, pa.list_(pa.string())),
                "spans": pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                "clean_text": cleaned,
            }
        )

    return run


def _scan(rows: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, window: int, pass_chars: int, schema: str, **options) -> DataFrame:
    """rows, the text last, scanned for all items: in one pass, or in as many as the items' texts need."""
    items = pick(benchmark, item=item_col, text=item_text_col).select(F.col("item").cast("string").alias("item"), "text")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // pass_chars) or 1
    state = rows.select(*rows.columns[:-1], F.lit(None).cast("binary").alias("hit_before"), F.lit(None).cast("array<string>").alias("items_before"), rows.columns[-1])
    for k in range(n):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else items
        got = own.toArrow()  # about pass_chars characters
        phrases = rows.sparkSession.sparkContext.broadcast(Phrases(got["item"].to_pylist(), got["text"].combine_chunks(), window))
        if k == n - 1:
            return state.mapInArrow(_shards(phrases, **options), schema)
        state = checkpoint(state.mapInArrow(_shards(phrases, last=False, **options), ddl(state)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, pass_chars: int = 4_000_000, spans: bool = True, clean_text: bool = True) -> DataFrame:
    """One row per document: word and hit counts, the items found, byte spans to remove and the text without them.

    pass_chars: how much item text goes to all tasks at once; a larger benchmark takes several passes.
    """
    rows = pick(docs, id=id_col, text=text_col)
    schema = RESULT.format(id=rows.schema["id"].dataType.simpleString())
    found = _scan(rows, benchmark, item_col, item_text_col, window, pass_chars, schema, text=clean_text, spans_too=spans)
    kind = pick(benchmark, item=item_col).schema["item"].dataType.simpleString()
    return found.withColumn("item_ids", F.array_sort(F.col("item_ids").cast(f"array<{kind}>"))).withColumnRenamed("id", id_col)


def without_items(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", n_chars_col: str | None = "n_chars", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, pass_chars: int = 4_000_000) -> DataFrame:
    """The rows of docs with all windows of the items cut from their texts; rows without any other word go."""
    flat, at = numbered(docs, text=text_col)
    rows = flat.withColumn("text_in", F.col(at["text"]))
    out = _scan(rows, benchmark, item_col, item_text_col, window, pass_chars, f"{ddl(flat)}, text_of string, words_of bigint, hit_of bigint", text=True, spans_too=False, keep=len(flat.columns))
    out = out.where((F.col("hit_of") == 0) | (F.col("hit_of") < F.col("words_of")))
    changed = {text_col: F.col("text_of")}
    if n_chars_col in docs.columns:
        own = f"c{docs.columns.index(n_chars_col)}"
        changed[n_chars_col] = F.when(F.col("hit_of") > 0, F.length("text_of").cast(docs.schema[n_chars_col].dataType)).otherwise(F.col(own))
    return named_again(out, docs.columns, **changed)

"""Substring dedup: content-defined chunking with a gear rolling hash.

A text's bytes are cut where the gear hash of the last 16 bytes meets a mask, unless another such place lies just
before, so a cut depends on a few bytes around it only and insertions elsewhere do not move it. A longer stretch where
no hash meets the mask, such as a word over and over, is cut where the hash is least among its neighbours, which is at
one and the same place of every period. Chunks are known by a 64-bit digest. Of equal chunks the first by document id
and position stays; the others are duplicates, and a run of duplicates of at least min_words words is removed from its
document.

Each task first folds equal chunks of the few megabytes that it holds at a time, and remembers about a million digests
beyond that: a chunk that comes later than one it has sent on is a duplicate for certain and travels with its
document's list. So a passage that a third of all documents share sends a few rows a task. One shuffle by digest then
ranks the rest; a second, by document, brings the duplicates back to their text.

Defined cases: a null text stays null, an empty one empty, and neither has chunks; documents with a null id are left
as they are and count for no other; ids that are no integers are ordered by a hash; rows that share an id and a text
count as one document and are cut alike, and equal ids with different texts are told apart by a checksum; texts that
tie are ordered by id; a very long text is cut in one piece, in memory of some 40 times its length; an empty table gives
an empty result; other columns, clashing names among them, pass through unchanged.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import SPACE, SpanHash, ddl, named_again, numbered, passes, pick, spans, utf8

#: Random weights of the gear hash, one a byte value.
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
REACH = 16
MASK = np.uint32(0b1111 << (REACH - 5))
NEAR, LONGEST = 8, 128
#: In stretches without a hash cut: the neighbours on either side that a hash is compared with, and the least length of a chunk.
BESIDE, SHORTEST = 24, 48
#: Slots of a task's memory of digests.
SLOTS = 1 << 20


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Chunk starts, each row's first byte among them."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    h = GEAR[data]
    step = 1
    while step < REACH:
        h[step:] += h[:-step].copy() << np.uint32(step)
        step *= 2
    ends = np.flatnonzero((h & MASK) == 0) + 1
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin = offsets[np.searchsorted(offsets, ends - 1, "right") - 1]
    # the hash of a place near a text's start would reach into the text before
    ends = ends[(ends - begin >= REACH) & (ends < n)]
    if len(ends) > 1:
        ends = ends[np.concatenate([[True], np.diff(ends) > NEAR])]
    starts = np.union1d(first, ends)
    length = np.diff(np.append(starts, n))
    more = [_least_cuts(h, int(starts[k]), int(starts[k] + length[k])) for k in np.flatnonzero(length > LONGEST)]
    return np.union1d(starts, np.concatenate(more)) if more else starts


def _least_cuts(h: np.ndarray, start: int, end: int) -> np.ndarray:
    """Cuts of a stretch from start to end: after places whose hash is the least of those around it, SHORTEST apart at least and LONGEST at most."""
    own = h[start + REACH : end]
    around = np.pad(own, BESIDE, mode="edge")
    least = np.lib.stride_tricks.sliding_window_view(around, 2 * BESIDE + 1)
    places = np.concatenate([np.flatnonzero(own[i : i + 65536] == least[i : i + 65536].min(1)) + i for i in range(0, len(own), 65536)]) + start + REACH + 1
    out, last = [], start
    while end - last > SHORTEST:
        k = int(np.searchsorted(places, last + SHORTEST))
        last = min(int(places[k]) if k < len(places) else end, last + LONGEST)
        if last < end:
            out.append(last)
    return np.array(out, np.int64)


def _digests(raw: np.ndarray, offsets: np.ndarray, hasher: SpanHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = cuts(raw, offsets)
    ends = np.append(starts[1:], len(raw)) if len(starts) else starts
    return starts, np.searchsorted(offsets, starts, "right") - 1, hasher(raw, starts, ends)


def _checks(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(raw[a:b]) & 0x7FFFFFFF for a, b in zip(offsets, offsets[1:], strict=False)], np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, id, place) of first chunks; (digest, id, null, places) of chunks known to be duplicates.

    place holds the text's checksum above the chunk's number in its text.
    """
    hasher = SpanHash()
    # digest, id and place of the earliest chunk that was sent on, by slot
    sent, sent_id, sent_place = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
    for batch in batches:
        ids = np.asarray(batch.column(0))
        raw_all, offsets_all = utf8(batch.column(1))
        for i, j in passes(offsets_all):
            raw, offsets = raw_all[offsets_all[i] : offsets_all[j]], offsets_all[i : j + 1] - offsets_all[i]
            starts, row, digest = _digests(raw, offsets, hasher)
            number = np.arange(len(starts)) - np.searchsorted(row, row, "left")
            place = (_checks(raw, offsets)[row] << 32) | number
            own = ids[i:j][row]
            order = np.lexsort((place, own, digest))
            d, o, p = digest[order], own[order], place[order]
            if not len(d):
                continue
            head = np.concatenate([[True], d[1:] != d[:-1]])
            lead = np.maximum.accumulate(np.where(head, np.arange(len(d)), 0))
            same = (o == o[lead]) & (p == p[lead])
            # a digest that was sent on before with an earlier place needs no row
            slot = (d[head] & np.uint64(SLOTS - 1)).astype(np.int64)
            known, o_head, p_head = sent[slot] == d[head], o[head], p[head]
            later = known & ((sent_id[slot] < o_head) | (sent_id[slot] == o_head) & (sent_place[slot] < p_head))
            repeat = known & (sent_id[slot] == o_head) & (sent_place[slot] == p_head)
            new = ~(later | repeat)
            sent[slot[new]], sent_id[slot[new]], sent_place[slot[new]] = d[head][new], o_head[new], p_head[new]
            same &= ~later[np.cumsum(head) - 1]
            head[np.flatnonzero(head)[~new]] = False
            yield pa.record_batch({"digest": d[head].view(np.int64), "id": o[head], "place": p[head], "places": pa.nulls(int(head.sum()), pa.list_(pa.int64()))})
            again = ~same
            if again.any():
                o, p = o[again], p[again]
                by = np.lexsort((p, o))
                o, p = o[by], p[by]
                at = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(o)).astype(np.int32)), pa.array(p))
                salt = (o[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                yield pa.record_batch({"digest": salt, "id": o[at], "place": pa.nulls(len(at), pa.int64()), "places": lists})


def _key(docs: DataFrame, id_col: str, value: Column) -> Column:
    """The id as a number: itself if it is one, else a hash of it."""
    kind = pick(docs, id=id_col).schema["id"].dataType
    return value.cast("bigint") if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else F.when(value.isNotNull(), F.xxhash64(value))


def duplicate_chunks(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(id, places): of each document that has some, the chunks that occur earlier."""
    narrow = pick(docs, id=id_col, text=text_col).where("id is not null and text is not null").select(_key(docs, id_col, F.col("id")).alias("id"), "text")
    chunks = narrow.mapInArrow(_chunks, "digest bigint, id bigint, place bigint, places array<bigint>")
    known = F.col("places").isNotNull()
    order = F.rank().over(Window.partitionBy("digest", known).orderBy("id", "place"))
    later = chunks.withColumn("r", order).where((F.col("r") > 1) | known)
    # a list for each document, of at most as many entries as it has chunks
    return later.groupBy("id").agg(F.flatten(F.collect_list(F.coalesce("places", F.array("place")))).alias("places"))


def _cut(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash()
        for batch in batches:
            for i in range(0, len(batch), 1000):
                part = batch.slice(i, 1000)
                yield one(part, hasher)

    def one(part: pa.RecordBatch, hasher: SpanHash) -> pa.RecordBatch:
        n_col = part.num_columns
        texts, places = part.column(n_col - 2), part.column(n_col - 1)
        out, facts, removed_spans = [], np.zeros((len(part), 4), np.int64), []
        for k in range(len(part)):
            text = texts[k].as_py()
            removed: list[dict] = []
            raw = np.frombuffer(text.encode(), np.uint8) if text else np.zeros(0, np.uint8)
            offsets = np.array([0, len(raw)])
            starts = cuts(raw, offsets)
            ends = np.append(starts[1:], len(raw))
            listed = places[k].values
            marked = np.zeros(len(starts), bool)
            if listed is not None and len(starts):
                own = np.asarray(listed)
                own = own[(own >> 32) == _checks(raw, offsets)[0]] & 0xFFFFFFFF
                marked[own] = True
                turn = np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))
                parts, last = [], 0
                for a, b in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1), strict=True):
                    s, e = int(starts[a]), int(ends[b - 1])
                    # whole characters only
                    while s < e and raw[s] & 0xC0 == 0x80:
                        s += 1
                    while e < len(raw) and e > s and raw[e] & 0xC0 == 0x80:
                        e -= 1
                    if len(spans(~SPACE[raw[s:e]], np.array([0, e - s]))[0]) >= min_words:
                        parts.append(raw[last:s].tobytes())
                        removed.append({"start": s, "end": e})
                        last = e
                if removed:
                    text = b"".join([*parts, raw[last:].tobytes()]).decode()
            out.append(text)
            removed_spans.append(removed)
            facts[k] = len(starts), marked.sum(), sum(r["end"] - r["start"] for r in removed), len(text or "")
        done = {part.schema.names[c]: part.column(c) for c in range(n_col - 2)}
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        done |= {"text_of": pa.array(out, pa.string()), "n_chunks_of": facts[:, 0], "n_duplicate_of": facts[:, 1], "removed_of": facts[:, 2], "chars_of": facts[:, 3], "spans_of": pa.array(removed_spans, kind)}
        return pa.record_batch(list(done.values()), names=list(done))

    return run


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20) -> DataFrame:
    """Every row of docs, its columns as c0, c1, ... in their order, with what is left of its text.

    Added: text_of, its characters chars_of; n_chunks_of, n_duplicate_of; the bytes removed_of and their spans_of.
    """
    found = duplicate_chunks(docs, id_col=id_col, text_col=text_col)
    flat, at = numbered(docs, id=id_col, text=text_col)
    rows = flat.withColumn("key_of", _key(docs, id_col, F.col(at["id"]))).join(found.withColumnRenamed("id", "key_of"), "key_of", "left")
    rows = rows.select(*flat.columns, F.col(at["text"]).alias("text_in"), "places")
    return rows.mapInArrow(_cut(min_words), f"{ddl(flat)}, text_of string, n_chunks_of bigint, n_duplicate_of bigint, removed_of bigint, chars_of bigint, spans_of array<struct<start:int,end:int>>")


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20) -> DataFrame:
    """(id, n_chunks, n_duplicate_chunks, n_chars, bytes_removed, spans, repeated) of every document."""
    narrow = pick(docs, **{id_col: id_col, text_col: text_col})
    out = dedup_substrings(narrow, id_col=id_col, text_col=text_col, min_words=min_words)
    return out.select(F.col("c0").alias(id_col), F.col("n_chunks_of").alias("n_chunks"), F.col("n_duplicate_of").alias("n_duplicate_chunks"), F.col("chars_of").alias("n_chars_kept"), F.col("removed_of").alias("bytes_removed"), F.col("spans_of").alias("spans"), (F.col("removed_of") > 0).alias("repeated"))


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str | None = "n_chars", min_words: int = 20) -> DataFrame:
    """The rows of docs with repeats cut from their texts; rows that nothing but white space is left of go."""
    out = dedup_substrings(docs, id_col=id_col, text_col=text_col, min_words=min_words)
    out = out.where((F.col("removed_of") == 0) | (F.length(F.trim("text_of")) > 0))
    changed = {text_col: F.col("text_of")}
    if n_chars_col in docs.columns:
        at = f"c{docs.columns.index(n_chars_col)}"
        changed[n_chars_col] = F.when(F.col("removed_of") > 0, F.col("chars_of").cast(docs.schema[n_chars_col].dataType)).otherwise(F.col(at))
    return named_again(out, docs.columns, **changed)

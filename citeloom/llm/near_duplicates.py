"""MinHash near-dedup with tensored banding, confirmed on full shingle sets.

A document's set is its distinct shingles of five words. One scan gives every document the digest of its set
and a small number of hash collections: each of 20 collections condenses 4 minhashes to one number. A table
key combines a pair of collections, so 80 minhashes serve 190 tables of 8 minhashes each; two sets with
similarity 0.85 share no key with a probability below 0.00001. Lower thresholds take as many collections as
keep that bound, 28 at 0.80. A pair of collections can only be shared by
documents that share each of the two, so documents make keys from the collections that some other document has.

Documents with equal sets are one class, found by digest. Within a table key each class is compared with the
key's smallest class only, on full sets, and the links found give components. A key whose members then lie
in one component needs no more comparisons. The documents of the other keys are sorted so that like ones meet,
packed into blocks of bounded size, and blocks that share a key are joined: of their pairs that differ in component
and share two collections, a sketch of 512 one-byte minhashes drops those far below the threshold, and the
rest is compared on full sets. So no key, however frequent, makes rows for its pairs or gathers in one task.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with nothing; a text of
fewer than five words has its whole word sequence as its one shingle; a very long text is hashed whole, its minhashes
taken in blocks; a null id is linked with nothing and kept; ids may have any type that can be ordered; each row is a
document, so rows that share an id are linked by their texts alone and equal rows get equal results; an empty table
gives an empty result; other columns, clashing names among them, are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, SPACE, SpanHash, checkpoint, components, mix, numbered, passes, pick, powers, row_bounds, spans, utf8

SHINGLE = 5
DEPTH, MISSED = 4, 0.00001
SKETCH = 512
#: Documents that one comparison holds on either side.
BLOCK = 512
#: Links of a forest that one task puts together.
AT_ONCE = 1_000_000
#: Text bytes that one numpy pass handles here.
_PASS = 400_000
_POWERS = powers(np.uint64(0xD6E8FEB86659FD93), SHINGLE + 1)[1:]
_ODD = mix(np.arange(1, 1 + 4096, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def collections(percent: int) -> int:
    """The least number of collections of which a pair at the threshold shares fewer than two with a probability below MISSED."""
    p, most = (percent / 100) ** DEPTH, len(_ODD) // DEPTH
    for n in range(2, most + 1):
        if (1 - p) ** n + n * p * (1 - p) ** (n - 1) < MISSED:
            return n
    raise ValueError(f"a threshold of {percent} % takes more than {most} collections")


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, hasher: SpanHash) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    data = LOWER[raw]
    starts, ends, rows = spans(~SPACE[data], offsets)
    words = hasher(data, starts, ends)
    bounds = row_bounds(rows, len(offsets) - 1)
    total = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        total += words[k : k + len(total)] * _POWERS[k]
    total = mix(total)
    out = []
    for i in range(len(offsets) - 1):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= SHINGLE:
            out.append(np.unique(total[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(mix((words[a:b] * _POWERS[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minhashes(shingles: np.ndarray, count: int) -> np.ndarray:
    """count minhashes of one set, in blocks so that a very long text needs no more memory than a short one."""
    least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[i : i + 2048, None] * _ODD[:count]).min(0), out=least)
    return least


def _signatures(count: int):
    fold = powers(np.uint64(0x9E3779B97F4A7C15), DEPTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash()
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for i, j in passes(offsets, _PASS):
                sets = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], hasher)
                keys = np.zeros((j - i, count), np.uint64)
                digest = np.zeros((j - i, 2), np.uint64)
                for k, s in enumerate(sets):
                    if len(s):
                        keys[k] = mix((minhashes(s, count * DEPTH).reshape(count, DEPTH) * fold).sum(1) + np.arange(count, dtype=np.uint64))
                        digest[k] = s.sum(), mix(s + np.uint64(1)).sum()
                flat = pa.array(keys.view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * count), flat)
                yield pa.record_batch({"id": batch.column(0).slice(i, j - i), "body": batch.column(2).slice(i, j - i), "n": np.array([len(s) for s in sets], np.int64), "d1": digest[:, 0].copy().view(np.int64), "d2": digest[:, 1].copy().view(np.int64), "keys": lists})

    return run


def _table_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id) for each pair of a document's shared collections."""
    for batch in batches:
        ids = np.asarray(batch.column(0))
        lists = batch.column(1)
        values, at = np.asarray(lists.values).view(np.uint64), np.asarray(lists.offsets)
        keys, of = [], []
        for k in range(len(ids)):
            own = np.sort(values[at[k] : at[k + 1]])
            x, y = np.triu_indices(len(own), 1)
            keys.append(mix(own[x] * np.uint64(3) + mix(own[y])))
            of.append(np.full(len(x), ids[k]))
        for i in range(0, len(keys), 2000):
            yield pa.record_batch({"key": np.concatenate(keys[i : i + 2000]).view(np.int64), "id": np.concatenate(of[i : i + 2000])})


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash()
        last: tuple = (None, None)
        for batch in batches:
            a, b = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            raw_a, at_a = utf8(batch.column(2))
            raw_b, at_b = utf8(batch.column(3))
            ok = np.zeros(len(a), bool)
            for k in range(len(a)):
                if last[0] != b[k]:
                    last = (b[k], shingle_sets(raw_b[at_b[k] : at_b[k + 1]], np.array([0, at_b[k + 1] - at_b[k]]), hasher)[0])
                ok[k] = linked(shingle_sets(raw_a[at_a[k] : at_a[k + 1]], np.array([0, at_a[k + 1] - at_a[k]]), hasher)[0], last[1], percent)
            yield pa.record_batch({"a": a[ok], "b": b[ok]})

    return run


def _facts(count: int):
    """(id, component, place, n, keys, sketch) of documents that still need comparisons; place sorts like ones together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash()
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            keys = np.asarray(batch.column(3).flatten()).reshape(-1, count)
            for i, j in passes(offsets, _PASS):
                sets = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], hasher)
                part = batch.slice(i, j - i)
                yield pa.record_batch(
                    {
                        "id": part.column(0),
                        "component": part.column(2),
                        "place": part.column(4),
                        "n": np.array([len(x) for x in sets], np.int64),
                        "keys": pa.array([k.tobytes() for k in keys[i:j]], pa.binary()),
                        "sketch": pa.array([(mix(minhashes(x, SKETCH)) >> np.uint64(56)).astype(np.uint8).tobytes() for x in sets], pa.binary()),
                    }
                )

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted documents to blocks of at most BLOCK documents."""
    for batch in batches:
        for i in range(0, len(batch), BLOCK):
            part = batch.slice(i, BLOCK)
            columns = {"ids": part.column(0), "components": part.column(1), "ns": part.column(3)}
            yield pa.record_batch(
                {"block": part.column(0).slice(0, 1)}
                | {k: pa.array([v.to_pylist()], pa.list_(pa.int64())) for k, v in columns.items()}
                | {"keys": pa.array([b"".join(part.column(4).to_pylist())], pa.binary()), "sketches": pa.array([b"".join(part.column(5).to_pylist())], pa.binary())}
            )


def _pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct pairs of blocks that some key has."""
    seen: set = set()
    for batch in batches:
        for blocks in batch.column(0).to_pylist():
            blocks = sorted(blocks)
            seen.update((x, y) for k, x in enumerate(blocks) for y in blocks[k:])
        if len(seen) > 200_000:
            yield pa.record_batch({"x": [p[0] for p in seen], "y": [p[1] for p in seen]})
            seen = set()
    if seen:
        yield pa.record_batch({"x": [p[0] for p in seen], "y": [p[1] for p in seen]})


def _join_blocks(percent: int, count: int):
    """Pairs between two blocks that differ in component, share two collections and whose sketches come near the threshold."""
    t = percent / 100
    # four and a half standard deviations below the threshold: a linked pair falls below with a probability of 0.000004
    least = int(SKETCH * (t - 4.5 * (t * (1 - t) / SKETCH) ** 0.5))

    def side(row: dict, which: str) -> tuple:
        ids, comps, ns = (np.array(row[c + which], np.int64) for c in ("ids", "components", "ns"))
        return ids, comps, ns, np.frombuffer(row["keys" + which], np.int64).reshape(-1, count), np.frombuffer(row["sketches" + which], np.uint8).reshape(-1, SKETCH)

    def pair(row: dict) -> pa.RecordBatch:
        a = side(row, "1")
        b = a if row["x"] == row["y"] else side(row, "2")
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(len(a[0])):
            j = np.arange(i + 1 if b is a else 0, len(b[0]))
            j = j[b[1][j] != a[1][i]]
            low, high = np.minimum(a[2][i], b[2][j]), np.maximum(a[2][i], b[2][j])
            j = j[100 * low >= percent * high]
            if len(j):
                j = j[(b[3][j] == a[3][i]).sum(1) >= 2]
            if len(j):
                j = j[(b[4][j] == a[4][i]).sum(1) >= least]
            out_a.append(np.maximum(a[0][i], b[0][j]))
            out_b.append(np.minimum(a[0][i], b[0][j]))
        return pa.record_batch({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                yield pair(batch.slice(k, 1).to_pylist()[0])

    return run


def maybe_in(some: DataFrame, *columns: str) -> Column:
    """True for the rows whose columns some has, and for about one in 16 of the others: a bit for each hash is sent to
    all tasks, so that rows need not move to be told apart."""
    bits = 1 << max(16, (16 * some.count()).bit_length())
    place = F.pmod(F.xxhash64(*columns), F.lit(bits))
    held = np.zeros(bits // 8, np.uint8)
    marks = some.select((place + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    for r in marks.collect():  # 4096 bytes each, two to four bytes for each row of some in all
        held[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    sent = some.sparkSession.sparkContext.broadcast(held)

    @F.arrow_udf("boolean")
    def marked(at: pa.Array) -> pa.Array:
        at = np.asarray(at)
        return pa.array((sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return marked(place)


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets meet the threshold; texts: (id, text), an id once."""
    one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_confirm(percent), "a bigint, b bigint")


def _grouped(narrow: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, body, n, keeper) of the rows (id, text, body) that can be linked, and rows (id, body, n) of all others.

    body is a digest of the text; keeper, the smallest (id, body) of a row's component.
    """
    count = collections(percent)
    kind = narrow.schema["id"].dataType.simpleString()
    signed = narrow.select("id", "text", "body").mapInArrow(_signatures(count), f"id {kind}, body string, n bigint, d1 bigint, d2 bigint, keys array<bigint>")
    signed = checkpoint(signed)
    live = signed.where("n > 0 and id is not null")
    # a class of equal sets is known by a number from here on, in the order of ids: copies mostly come after what they copy,
    # so the head of a key, its smallest number, is likelier than others to be near all its members
    classes = live.groupBy("n", "d1", "d2").agg(F.min(F.struct("id", "body")).alias("least"), F.first("keys").alias("keys"))
    classes = checkpoint(classes.sort("least").withColumn("rep", F.monotonically_increasing_id()))
    # collections that more than one class has
    single = classes.select("rep", F.explode("keys").alias("c"))
    shared = single.groupBy("c").agg(F.count("*").alias("k")).where("k > 1").select("c")
    own = single.join(shared, "c").groupBy("rep").agg(F.collect_list("c").alias("cs"))  # at most count of them
    keys = own.mapInArrow(_table_keys, "key bigint, id bigint")
    heads = keys.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("k")).where("k > 1").select("key", "head")
    keys = checkpoint(keys.join(heads, "key"))
    star = checkpoint(keys.where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct())
    # a text for each class that takes part in a pair: that of its smallest row, so that copies do not move
    ids = star.select("a").union(star.select(F.col("b").alias("a"))).distinct()
    wanted = checkpoint(classes.join(ids, F.col("rep") == F.col("a"), "left_semi").select("rep", "least.id", "least.body"))
    one = narrow.where(maybe_in(wanted, "id", "body")).groupBy("body").agg(F.first("text").alias("text"))
    texts = one.join(wanted.select("rep", "body"), "body").select(F.col("rep").alias("id"), "text")
    texts = checkpoint(texts)
    links = checkpoint(confirm(star, texts, percent))
    found = components(links, AT_ONCE)
    # keys that still hold several components
    marked = keys.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = marked.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    open_ = checkpoint(marked.join(mixed, "key"))
    # documents that no chain of such keys connects share none, so few blocks meet if those of a chain come together
    chains = components(open_.where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct(), AT_ONCE)
    who = open_.groupBy("id").agg(F.first("component").alias("component"), F.min("key").alias("first_key"))
    who = who.join(chains.select(F.col("node").alias("id"), F.col("component").alias("chain")), "id")
    who = who.select("id", "component", F.struct("chain", "first_key").alias("place"))
    who = who.join(classes.select(F.col("rep").alias("id"), "keys"), "id")
    facts = checkpoint(texts.join(who, "id").select("id", "text", "component", "keys", "place").mapInArrow(_facts(count), "id bigint, component bigint, place struct<chain: bigint, first_key: bigint>, n bigint, keys binary, sketch binary"))
    # few partitions, so that blocks are full whatever the number of shuffle partitions
    n_parts = max(1, facts.count() // (4 * BLOCK))
    blocks = facts.sort("place", "id").coalesce(n_parts).mapInArrow(_pack, "block bigint, ids array<bigint>, components array<bigint>, ns array<bigint>, keys binary, sketches binary")
    blocks = checkpoint(blocks)
    of = blocks.select("block", F.explode("ids").alias("id"))
    together = open_.select("key", "id").join(of, "id").groupBy("key").agg(F.collect_set("block").alias("blocks")).select("blocks").distinct()
    together = together.mapInArrow(_pairs_of, "x bigint, y bigint").distinct()
    one = blocks.toDF("x", *(c + "1" for c in blocks.columns[1:]))
    two = blocks.toDF("y", *(c + "2" for c in blocks.columns[1:]))
    near = together.join(one, "x").join(two, "y").mapInArrow(_join_blocks(percent, count), "a bigint, b bigint")
    near = checkpoint(near.join(star, ["a", "b"], "left_anti"))
    more = checkpoint(confirm(near, texts, percent))
    if not more.isEmpty():
        found = components(links.union(more), AT_ONCE)
    member = classes.select("rep", "least").join(found.withColumnRenamed("node", "rep"), "rep")
    names = member.groupBy("component").agg(F.min("least").alias("keeper"))
    renamed = member.join(names, "component").select("rep", "keeper")
    by_class = classes.select("n", "d1", "d2", "rep", "least").join(renamed, "rep", "left").select("n", "d1", "d2", F.coalesce("keeper", "least").alias("keeper"))
    grouped = live.select("id", "body", "n", "d1", "d2").join(by_class, ["n", "d1", "d2"]).select("id", "body", "n", "keeper")
    return grouped, signed.where("not (n > 0 and id is not null)").select("id", "body", "n")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every document; links hold at percent hundredths of similarity."""
    grouped, others = _grouped(pick(docs, id=id_col, text=text_col).withColumn("body", F.md5("text")), percent)
    out = grouped.select("id", "n", F.col("keeper.id").alias("component_id")).union(others.select("id", "n", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """The rows of docs without near-duplicates: of each component one row stays, that of the smallest id and, among
    rows that share it, of the smallest digest of the text; of rows that repeat both, the first by their JSON."""
    flat, at = numbered(docs, id=id_col, text=text_col)
    rows = flat.withColumns({"id_of": F.col(at["id"]), "body_of": F.md5(at["text"])})
    grouped, _ = _grouped(pick(docs, id=id_col, text=text_col).withColumn("body", F.md5("text")), percent)
    # of each id and text that goes, or that several rows have
    gone = grouped.groupBy("id", "body").agg(F.count("*").alias("k"), F.first(F.struct("id", "body") != F.col("keeper")).alias("goes")).where("goes or k > 1")
    gone = checkpoint(gone.select(F.col("id").alias("id_of"), F.col("body").alias("body_of"), "goes"))
    maybe = maybe_in(gone, "id_of", "body_of")
    some = rows.where(maybe)
    left = rows.where(~maybe).select(*flat.columns).union(some.join(gone, ["id_of", "body_of"], "left_anti").select(*flat.columns))
    whole = F.struct(*flat.columns)
    again = some.join(gone.where("not goes"), ["id_of", "body_of"], "left_semi").groupBy("id_of", "body_of").agg(F.min_by(whole, F.to_json(whole)).alias("row"))
    return left.union(again.select("row.*")).toDF(*docs.columns)

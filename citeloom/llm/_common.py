"""Helpers shared by the corpus operators: columns, arrow batches, checkpoints, hashing and components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multiplier of the polynomial word hash, and its inverse modulo 2**64.
RADIX = np.uint64(0x9E3779B97F4A7C15)
RADIX_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Text bytes that one numpy pass handles; bounds the memory of a Python worker.
PASS_BYTES = 2_000_000

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def pick(df: DataFrame, **names: str) -> DataFrame:
    """The columns names.values() under the names names.keys(); an exact name wins over one that differs in case."""
    flat, at = numbered(df, **names)
    return flat.select(*(flat[c].alias(new) for new, c in at.items()))


def numbered(df: DataFrame, **names: str) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns as c0, c1, ... in their order, and which of them each of names is."""
    flat = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    at = {}
    for new, old in names.items():
        found = [i for i, c in enumerate(df.columns) if c == old] or [i for i, c in enumerate(df.columns) if c.lower() == old.lower()]
        if not found:
            raise ValueError(f"no column {old!r} among {df.columns}")
        at[new] = f"c{found[0]}"
    return flat, at


def named_again(flat: DataFrame, names: list[str], **changed) -> DataFrame:
    """The columns c0, c1, ... under names again; those in changed (by name) get a new value."""
    return flat.select(*(F.col(f"c{i}") if c not in changed else changed[c].alias(f"c{i}") for i, c in enumerate(names))).toDF(*names)


def ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="citeloom-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def held_out(id_col: str, modulus: int, remainder: int):
    """True where crc32 of the id's decimal text leaves remainder."""
    return F.crc32(F.col(id_col).cast("string")) % modulus == remainder


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def passes(offsets: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes each; a longer text is alone in its range."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the maximal runs where is_word holds, broken at the rows' offsets."""
    n = len(is_word)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e
    first, last = is_word.copy(), is_word.copy()
    first[1:] &= ~is_word[:-1]
    last[:-1] &= ~is_word[1:]
    edges = offsets[:-1][offsets[:-1] < n]
    first[edges] = is_word[edges]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = is_word[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHash:
    """64-bit hashes of byte or code point spans, by a polynomial whose prefix sums are taken once a pass."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.up) < len(data) + 1:
            self.up, self.down = powers(RADIX, len(data) + 1), powers(RADIX_INV, len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * self.down[starts])


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Offsets of the rows 0..n-1 in the sorted array rows."""
    return np.searchsorted(rows, np.arange(n + 1), "left")


def reduce_rows(op: np.ufunc, values: np.ndarray, bounds: np.ndarray, empty) -> np.ndarray:
    """op over values between consecutive bounds; rows without values get empty."""
    n = len(bounds) - 1
    out = np.full((n, *values.shape[1:]), empty, values.dtype)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = op.reduceat(values, bounds[full], axis=0)
    return out


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node of the edges (a, b), the smallest node of its component, as arrays (node, root)."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        low, high = np.minimum(rx, ry), np.maximum(rx, ry)
        if (low == high).all():
            return nodes, nodes[root]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held_a, held_b, n = [], [], 0
    for batch in batches:
        held_a.append(np.asarray(batch.column(0)))
        held_b.append(np.asarray(batch.column(1)))
        n += len(batch)
        if n >= 500_000:
            a, b = local_forest(np.concatenate(held_a), np.concatenate(held_b))
            keep = a != b
            held_a, held_b, n = [a[keep]], [b[keep]], 0
            if len(held_a[0]) > 400_000:
                yield pa.record_batch({"a": held_a[0], "b": held_b[0]})
                held_a, held_b = [], []
    if held_a:
        a, b = local_forest(np.concatenate(held_a), np.concatenate(held_b))
        keep = a != b
        yield pa.record_batch({"a": a[keep], "b": b[keep]})


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches, pa.schema({"a": pa.int64(), "b": pa.int64()}))
    node, root = local_forest(np.asarray(table["a"]), np.asarray(table["b"]))
    yield pa.record_batch({"node": node, "component": root})


def components(edges: DataFrame, at_once: int = 0) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node reachable.

    Forests of at most at_once edges in all are put together by one task, which needs some 200 bytes an edge.

    Each partition first contracts its own edges to a forest, so no node keeps more edges than there
    are partitions; then every round links each root to its smallest neighbour and shortens the paths
    (large-star and small-star), until nothing changes. The state of each round is checkpointed.
    """
    link = "a bigint, b bigint"
    now = checkpoint(edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).where("a <> b").mapInArrow(_contract, link))
    last = None
    edge_count = now.count()
    if edge_count <= at_once:
        return checkpoint(now.coalesce(1).mapInArrow(_finish, "node bigint, component bigint"))
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("k")).select("a", F.least("a", "m").alias("m"), "k")
        # a node with many edges would gather them in one task; there are at most 1000 of those, sent to every task
        many = max(200, 2 * edge_count // 1000)
        hot, cold = least.where(F.col("k") > many).select("a", "m"), least.where(F.col("k") <= many).select("a", "m")
        up = both.where("b > a")
        large = up.join(F.broadcast(hot), "a").union(up.join(F.broadcast(hot.select("a")), "a", "left_anti").join(cold, "a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        best = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(best, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = checkpoint(small.union(best.select("a", F.col("m").alias("b"))).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == last:
            break
        last, edge_count = seen, seen[0]
    roots = now.groupBy("a").agg(F.min("b").alias("b"))
    return roots.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

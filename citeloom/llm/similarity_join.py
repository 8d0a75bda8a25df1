"""Embedding near-dedup by epsilon grid order join.

Unit vectors with cosine c or more lie within the distance eps = sqrt(2 - 2c). Vectors are rotated to their
principal dimensions, found from the covariance that one aggregation gathers, and cut into grid cells of
side eps along the leading ones. In the lexicographic order of those cells (epsilon grid order), vectors
within eps of each other differ by one at most in every cell coordinate.

The order is cut into blocks of bounded size, and consecutive blocks form a tile. Tiles and blocks keep the bounds of
their vectors along all leading dimensions; a tile meets the later blocks whose bounds come within eps of its own,
found by an equi-join on cells of the first three dimensions. A tile's vectors go to one task once, and the blocks that
it meets pass by them one at a time, so what moves is the input times the number of tiles that are near each other, and
memory holds one tile and one block. The intervals of the two sequences are then joined recursively: halves whose
bounds are farther apart than eps are skipped, and short ones are compared by a matrix product in double precision. A
comparison returns the number of links of each vector and a forest of the links, never the links themselves, so a
group of copies makes rows in proportion to its members.

Equal vectors are one row with a weight before all that.

Defined cases: vectors that are null, empty or zero, or hold nulls or values that are not finite, link with nothing
and keep themselves; vectors of different lengths link with nothing across lengths; each row is a vector of its own,
also where rows share an id; ids may have any type that can be ordered; a null id is kept and never names a component;
a cosine of exactly the threshold links, and equal vectors tie in every order without effect; very long vectors are
compared whole; an empty table gives an empty result; other columns, clashing names among them, are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpoint, components, local_forest, pick

#: Leading dimensions of the grid, vectors of one block, and vectors below which a pair is multiplied out.
DIMS, BLOCK, LEAF = 8, 1024, 256
#: Blocks of one tile: the more, the fewer tiles there are that the others pass by.
LEAST_TILE, MOST_TILE, TILES = 4, 64, 12
#: Vector lengths that get a rotation; rarer ones are ordered by their first coordinates, with the same result.
LENGTHS = 64


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, dim, ok, key): key is the unit vector in doubles, null where it has none."""
    for batch in batches:
        ids, keys, dims = batch.column(0), [], []
        lists = batch.column(1)
        whole = lists.null_count == 0 and lists.values.null_count == 0 and len(lists) and len(set(np.diff(np.asarray(lists.offsets)).tolist())) == 1
        if whole and len(lists.flatten()):
            m = np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), -1)
        else:
            m = None
        for k in range(len(ids)):
            v = m[k] if m is not None else lists[k].as_py()
            if v is not None and m is None:
                v = np.array([np.nan if x is None else x for x in v], np.float64)
            good = v is not None and len(v) and np.isfinite(v).all() and (v != 0).any()
            if good:
                v = v / np.abs(v).max()
                v = v / np.sqrt((v * v).sum())
            keys.append(v.tobytes() if good else None)
            dims.append(len(v) if good else None)
        yield pa.record_batch({"id": ids, "dim": pa.array(dims, pa.int32()), "vec": pa.array(keys, pa.binary())})


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a task and length: count, sum and second moments."""
    held: dict[int, list] = {}
    for batch in batches:
        dims = np.asarray(batch.column(0))
        for d in np.unique(dims):
            m = _matrix(batch.column(1).filter(pa.array(dims == d)), int(d))
            old = held.get(int(d), [0, np.zeros(d), np.zeros((d, d))])
            held[int(d)] = [old[0] + len(m), old[1] + m.sum(0), old[2] + m.T @ m]
    for d, (n, one, two) in held.items():
        yield pa.record_batch({"dim": pa.array([d], pa.int32()), "moments": pa.array([np.concatenate([[n], one, two.ravel()]).tolist()], pa.list_(pa.float64()))})


def principal(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each of the most frequent vector lengths the rotation to its leading principal dimensions."""
    often = [r["dim"] for r in vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(LENGTHS).collect()]
    moments = vectors.where(F.col("dim").isin(often)).select("dim", "vec").mapInArrow(_moments, "dim int, moments array<double>")
    flat = moments.select("dim", F.posexplode("moments")).groupBy("dim", "pos").agg(F.sum("col").alias("s"))
    rows = flat.groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("m")).orderBy("dim").collect()  # LENGTHS at most
    out = {}
    for r in rows:
        d, m = r["dim"], np.array([x["s"] for x in r["m"]])
        n, one, two = m[0], m[1 : 1 + d], m[1 + d :].reshape(d, d)
        _, axes = np.linalg.eigh(two / n - np.outer(one / n, one / n))
        out[d] = np.ascontiguousarray(axes[:, ::-1][:, :DIMS])
    return out


def _lead(m: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """The leading dimensions of the vectors in the rows of m; missing ones are 0."""
    d = m.shape[1]
    lead = m @ axes[d] if d in axes else m[:, :DIMS]
    return np.pad(lead, ((0, 0), (0, DIMS - lead.shape[1])))


def _grid(axes: dict[int, np.ndarray], eps: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(1))
            for d in np.unique(dims):
                own = batch.filter(pa.array(dims == d))
                cells = np.floor(_lead(_matrix(own.column(2), int(d)), axes) / eps).astype(np.int64)
                # cells of unit vectors lie within 1 / eps of 0; big-endian bytes sort as the cells do
                order = [x.tobytes() for x in (cells + (1 << 15)).clip(0, 65535).astype(">u2")]
                yield pa.record_batch({"rep": own.column(0), "dim": own.column(1), "vec": own.column(2), "weight": own.column(3), "cell": pa.array(order, pa.binary())})

    return run


def _pack(axes: dict[int, np.ndarray], tile_blocks: int):
    """Sorted rows of a partition to blocks with bounds and the tile they are in; a tile holds one vector length only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        made, tile, in_tile, tile_dim = 0, 0, 0, None

        def flush(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made, tile, in_tile, tile_dim, held
            t = pa.Table.from_batches(held).combine_chunks()
            dims = np.asarray(t["dim"])
            cuts = [0, *(np.flatnonzero(dims[1:] != dims[:-1]) + 1).tolist(), len(dims)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                for i in range(a, b, BLOCK):
                    part = t.slice(i, min(BLOCK, b - i)).combine_chunks()
                    if not whole and len(part) < BLOCK and i + BLOCK > len(t):
                        held = part.to_batches()
                        return
                    d = int(dims[i])
                    if in_tile == tile_blocks or tile_dim not in (None, d):
                        tile, in_tile = tile + 1, 0
                    tile_dim, in_tile, made = d, in_tile + 1, made + 1
                    vec = part["vec"].combine_chunks()
                    lead = _lead(_matrix(vec, d), axes)
                    yield pa.record_batch(
                        {
                            "block": pa.array([base + made], pa.int64()),
                            "tile": pa.array([base + tile], pa.int64()),
                            "dim": pa.array([d], pa.int32()),
                            "low": pa.array([lead.min(0).tolist()], pa.list_(pa.float64())),
                            "high": pa.array([lead.max(0).tolist()], pa.list_(pa.float64())),
                            "reps": pa.array([part["rep"].to_pylist()], pa.list_(pa.int64())),
                            "weights": pa.array([part["weight"].to_pylist()], pa.list_(pa.int64())),
                            "data": pa.array([b"".join(vec.to_pylist())], pa.binary()),
                        }
                    )
            held = []

        n = 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= 32 * BLOCK:
                yield from flush(False)
                n = sum(map(len, held))
        if held:
            yield from flush(True)

    return run


class _Side:
    """A sequence of vectors in grid order: names, weights, vectors, leading dimensions, and links found so far."""

    def __init__(self, reps: np.ndarray, weights: np.ndarray, vec: np.ndarray, axes: dict[int, np.ndarray]) -> None:
        self.reps, self.weights, self.vec = reps, weights, vec
        self.lead, self.count = _lead(vec, axes), np.zeros(len(reps), np.int64)


def _join(a: _Side, b: _Side, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest (node, root) of the links between two sequences, or within one if a is b; counts are added to both sides."""
    eps2, same = 2 - 2 * cosine + 1e-9, a is b
    edges: list = []
    # intervals of the sequences, as (from, to) in each
    todo = [(0, len(a.reps), 0, len(b.reps))]
    while todo:
        i, j, x, y = todo.pop()
        gap = np.maximum(0, np.maximum(a.lead[i:j].min(0) - b.lead[x:y].max(0), b.lead[x:y].min(0) - a.lead[i:j].max(0)))
        if (gap * gap).sum() > eps2:
            continue
        if j - i > LEAF or y - x > LEAF:
            # equal intervals of one sequence have equal halves
            m, z = (i + j) // 2, (x + y) // 2
            halves_a = [(i, m), (m, j)] if j - i > LEAF else [(i, j)]
            halves_b = [(x, z), (z, y)] if y - x > LEAF else [(x, y)]
            todo += [(p, q, r, s) for p, q in halves_a for r, s in halves_b if not same or s > p]
            continue
        near = a.vec[i:j] @ b.vec[x:y].T >= cosine
        if same:
            near &= np.arange(x, y)[None, :] > np.arange(i, j)[:, None]
        if near.any():
            a.count[i:j] += near @ b.weights[x:y]
            b.count[x:y] += near.T @ a.weights[i:j]
            p, q = np.nonzero(near)
            node, root = local_forest(a.reps[i + p], b.reps[x + q])
            edges.append(np.stack([node, root], 1)[node != root])
    if not edges:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    e = np.concatenate(edges)
    node, root = local_forest(e[:, 0], e[:, 1])
    return node[node != root], root[node != root]


def _join_tiles(axes: dict[int, np.ndarray], cosine: float):
    """Rows of a tile, its own blocks (guest false) before those that it meets, to (rep, links, other) rows:
    links to add to rep's count where other is null, else one edge of the forest."""

    def counts(side: _Side) -> pa.RecordBatch:
        some = side.count > 0
        return pa.record_batch({"rep": side.reps[some], "links": side.count[some], "other": pa.nulls(int(some.sum()), pa.int64())})

    def links(node: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({"rep": node, "links": np.zeros(len(node), np.int64), "other": root})

    def side(rows: list[pa.RecordBatch]) -> _Side:
        d = rows[0].column(2)[0].as_py()
        reps, weights = (np.concatenate([np.asarray(r.column(c)[0].values) for r in rows]) for c in (3, 4))
        return _Side(reps, weights, np.frombuffer(b"".join(r.column(5)[0].as_py() for r in rows), np.float64).reshape(-1, d), axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, own, held = None, None, []

        def close() -> Iterator[pa.RecordBatch]:
            if own is not None:
                yield counts(own)

        def begin() -> Iterator[pa.RecordBatch]:
            nonlocal own, held
            own, held = side(held), []
            yield links(*_join(own, own, cosine))

        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1)
                at, guest = row.column(0)[0].as_py(), row.column(1)[0].as_py()
                if at != tile:
                    if held:
                        yield from begin()
                    yield from close()
                    tile, own = at, None
                if not guest:
                    held.append(row)
                    continue
                if held:
                    yield from begin()
                other = side([row])
                yield links(*_join(own, other, cosine))
                yield counts(other)
        if held:
            yield from begin()
        yield from close()

    return run


def similarity_join(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """(id, n_links, component_id, kept) of every vector."""
    eps = (2 - 2 * cosine) ** 0.5
    narrow = pick(vectors, id=id_col, vec=vector_col).select("id", F.col("vec").cast("array<double>").alias("vec"))
    kind = narrow.schema["id"].dataType.simpleString()
    units = checkpoint(narrow.mapInArrow(_unit, f"id {kind}, dim int, vec binary"))
    # equal unit vectors are one row; rep numbers it, and id names it
    distinct = units.where("vec is not null").groupBy("vec", "dim").agg(F.min("id").alias("id"), F.count("*").alias("weight"))
    distinct = checkpoint(distinct.select(F.monotonically_increasing_id().alias("rep"), "dim", "vec", "weight", "id"))
    axes = principal(distinct)
    cells = distinct.select("rep", "dim", "vec", "weight").mapInArrow(_grid(axes, eps), "rep bigint, dim int, vec binary, weight bigint, cell binary")
    # few partitions, so that tiles are full whatever the number of shuffle partitions
    n = distinct.count()
    tile_blocks = min(MOST_TILE, max(LEAST_TILE, n // BLOCK // TILES))
    n_parts = max(1, n // (tile_blocks * BLOCK))
    ordered = cells.sort("dim", "cell", "rep").coalesce(n_parts).sortWithinPartitions("dim", "cell", "rep")
    blocks = checkpoint(ordered.mapInArrow(_pack(axes, tile_blocks), "block bigint, tile bigint, dim int, low array<double>, high array<double>, reps array<bigint>, weights array<bigint>, data binary"))
    bounds = blocks.select("block", "tile", "dim", "low", "high")
    ends = [f(F.element_at(end, k + 1)).alias(f"{end}{k}") for end, f in (("low", F.min), ("high", F.max)) for k in range(DIMS)]
    tiles = bounds.groupBy("tile", "dim").agg(*ends)
    tiles = tiles.select("tile", "dim", *(F.array(*(f"{end}{k}" for k in range(DIMS))).alias(end) for end in ("low", "high")))

    def covered(df: DataFrame, widen: int) -> DataFrame:
        for k in range(3):
            low, high = (F.floor(F.element_at(end, k + 1) / eps) for end in ("low", "high"))
            df = df.withColumn(f"at{k}", F.explode(F.sequence(low - widen, high + widen)))
        return df

    # tiles and blocks meet in the cells of the first dimensions that they cover, one side widened by one cell
    left = covered(tiles.toDF("host", "host_dim", "low", "high"), 0).withColumnsRenamed({"low": "low1", "high": "high1"})
    right = covered(bounds, 1).withColumnsRenamed({"low": "low2", "high": "high2"})
    gap = F.aggregate(F.zip_with(F.zip_with("low1", "high2", lambda x, y: x - y), F.zip_with("low2", "high1", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))), F.lit(0.0), lambda t, x: t + x * x)
    close = left.join(right, ["at0", "at1", "at2"]).where("host_dim = dim and host < tile").where(gap <= 2 - 2 * cosine + 1e-9)
    close = close.select("host", "block").distinct()
    facts = ("dim", "reps", "weights", "data")
    guests = close.join(blocks, "block").select(F.col("host").alias("tile"), F.lit(True).alias("guest"), *facts, "block")
    rows = blocks.select("tile", F.lit(False).alias("guest"), *facts, "block").union(guests)
    rows = rows.repartition(max(1, tiles.count()), "tile").sortWithinPartitions("tile", "guest", "block").select("tile", "guest", *facts)
    found = checkpoint(rows.mapInArrow(_join_tiles(axes, cosine), "rep bigint, links bigint, other bigint"))
    counts = found.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    own = distinct.select("rep", "vec", "weight", "id")
    member = own.select("rep", "id").join(parts.withColumnRenamed("node", "rep"), "rep")
    names = member.groupBy("component").agg(F.min("id").alias("name"))
    named = member.join(names, "component").select("rep", "name")
    facts = own.join(counts, "rep", "left").join(named, "rep", "left")
    facts = facts.select("vec", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("name", "id").alias("name"))
    out = units.where("vec is not null").join(facts, "vec").select("id", "n_links", F.when(F.col("id").isNotNull(), F.col("name")).alias("component_id"))
    out = out.union(units.where("vec is null").select("id", F.lit(0), "id"))
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("bigint").alias("n_links"), "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))

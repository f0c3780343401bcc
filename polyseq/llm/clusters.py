"""Centroid clustering by Lloyd's rounds, sharded by dimension.

Vectors become whole numbers and are kept as blocks of rows, each cut into column shards. A task holds one shard of one
block and the slice of the centroids that belongs to it: it gives the exact part of each squared distance that lies in
its columns. The parts of a block are added by key and the least is taken; the assignment, a byte or two a vector, goes
back to the shards, and each shard sums its own columns by cluster for its slice of the new centroids.

Nothing but centroids (k times the dimension) reaches the driver. All sums are of whole numbers and exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyseq.llm._shared import new_block, pack_numbers, stage, unpack_numbers, write_bucketed

#: Vectors of a block at most. Components beyond LARGEST raise an error: squared distances of 64 of them needn't fit in a long.
BLOCK, LARGEST = 4096, 1 << 27


def _whole(x: np.ndarray, scale: int) -> np.ndarray:
    x = np.floor(x * scale)
    if np.abs(x).max(initial=0) > LARGEST:
        raise ValueError(f"a component lies beyond {LARGEST} / {scale}")
    return x.astype(np.int64)


def _vectors(column: pa.Array, dimensions: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have ``dimensions`` components, all finite, and these rows' components scaled and rounded down."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    right = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), dimensions), False))
    x = column.filter(pa.array(right)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    whole = np.isfinite(x).all(axis=1)
    kept = right.copy()
    kept[right] = whole
    return kept, _whole(x[whole], scale)


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers as the least of them and the rest above it, in as few bytes each as hold the largest."""
    low = int(x.min(initial=0))
    return low.to_bytes(8, "little", signed=True) + pack_numbers(x.ravel() - low)


def _unpack(b: bytes) -> np.ndarray:
    return unpack_numbers(b[8:]) + int.from_bytes(b[:8], "little", signed=True)


def _shards(dimensions: int, n: int) -> list[slice]:
    edges = np.linspace(0, dimensions, n + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _cut(dimensions: int, scale: int, shards: list[slice]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, x = _vectors(batch.column(1), dimensions, scale)
            ids = batch.column(0).filter(pa.array(kept))
            for at in range(0, len(x), BLOCK):
                part, own, n = x[at : at + BLOCK], ids.slice(at, BLOCK), len(shards)
                yield pa.record_batch({
                    "block": pa.array([new_block()] * n, pa.int64()), "shard": pa.array(range(n), pa.int32()), "ids": pa.array([own.to_pylist()] + [None] * (n - 1), pa.list_(ids.type)),
                    "x": pa.array([_pack(part[:, s]) for s in shards], pa.binary()),
                })

    return run


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of whole numbers; by products of floats where these are exact too."""
    most = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def _partial(centroids: np.ndarray, shards: list[slice]):
    """The part of each distance in the columns of a shard; byte planes apart, since the upper ones are nearly alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, shard, x in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                c = centroids[:, shards[shard.as_py()]]
                d = squared_distances(_unpack(x.as_py()).reshape(-1, c.shape[1]), c)
                low = d.min(axis=1)
                rest = (d - low[:, None]).T.ravel()
                width = max(1, -(-int(rest.max(initial=0)).bit_length() // 8))
                planes = np.ascontiguousarray(rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
                yield pa.record_batch({"block": pa.array([block.as_py()], pa.int64()), "low": pa.array([low.astype("<i8").tobytes()], pa.binary()), "rest": pa.array([planes], pa.binary())})

    return run


def _nearest(k: int):
    """The parts of one block - a row for each shard - added up: the number of the nearest centroid, the smaller of equals, and its distance."""

    def run(part: pa.Table) -> pa.Table:
        total = None
        for low, rest in zip(part["low"], part["rest"], strict=True):
            low = np.frombuffer(low.as_py(), "<i8")
            planes = np.frombuffer(rest.as_py(), np.uint8).reshape(-1, k * len(low))
            wide = np.zeros((k * len(low), 8), np.uint8)
            wide[:, : len(planes)] = planes.T
            d = wide.view("<u8").astype(np.int64).reshape(k, len(low)) + low
            total = d if total is None else total + d
        best = total.argmin(axis=0)
        return pa.table({"block": part["block"].slice(0, 1), "best": pa.array([pack_numbers(best)], pa.binary()), "distance": pa.array([pack_numbers(total[best, np.arange(len(best))])], pa.binary())})

    return run


def _sums(k: int, shards: list[slice]):
    """The columns of each shard summed by cluster, for what the task has seen: shard, cluster, n, sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {}
        for batch in batches:
            for shard, x, best in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                s, own = shard.as_py(), unpack_numbers(best.as_py())
                x = _unpack(x.as_py()).reshape(len(own), -1)
                member = np.zeros((k, len(own)))
                member[own, np.arange(len(own))] = 1.0
                n, sums = totals.setdefault(s, (np.zeros(k, np.int64), np.zeros((k, x.shape[1]), np.int64)))
                n += np.bincount(own, minlength=k)
                sums += (member @ x).astype(np.int64)  # BLOCK * LARGEST < 2 ** 53
        rows = [(s, c, d + shards[s].start, int(n[c]), int(sums[c, d])) for s, (n, sums) in totals.items() for c in np.flatnonzero(n) for d in range(sums.shape[1])]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.record_batch([pa.array(v, pa.int64()) for v in columns], names=["shard", "cluster", "dimension", "n", "s"])

    return run


def starts(df: DataFrame, k: int, dimensions: int, scale: int, salt: str, id_col: str, vec_col: str) -> np.ndarray:
    """The k kept vectors whose id has the smallest hash, in its order; equal ids by their components, null ids last."""
    vec = df[vec_col].cast("array<double>")
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = df.filter((F.size(vec) == dimensions) & finite).select(F.sha2(F.concat(F.lit(salt), df[id_col].cast("string")), 256).alias("h"), vec.alias("v"))
    found = x.orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return _whole(np.array([r.v for r in found]).reshape(len(found), dimensions), scale)


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, dimensions: int = 64, scale: int = 256, salt: str = "2:", shards: int = 2, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row for each vector that is kept: vec_id, cluster, distance, cluster_inertia, inertia, centroid (its final components).

    Kept are vectors of exactly ``dimensions`` components, none null, NaN or infinite; each component x becomes
    floor(scale * x). The k kept vectors with the smallest SHA-256 of ``salt`` and id are the first centroids (fewer vectors
    make fewer). Each round assigns every vector to the nearest centroid by squared distance, ties to the smaller
    number, and puts each centroid that has vectors at their mean, rounded down; the last assignment is to the
    centroids after all rounds. Repeated ids and repeated vectors are rows of their own, a null id stays null. Other
    columns are not read. No kept vector: an empty result. A component beyond LARGEST / scale raises an error.
    """
    spark, cuts = df.sparkSession, _shards(dimensions, shards)
    kind = df.schema[id_col].dataType.simpleString()
    centroids = starts(df, k, dimensions, scale, salt, id_col, vec_col)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    k = len(centroids)
    slices = write_bucketed(df.select(df[id_col].alias("id"), df[vec_col].alias("v")).mapInArrow(_cut(dimensions, scale, cuts), f"block long, shard int, ids array<{kind}>, x binary"), "shards")

    def assigned() -> DataFrame:
        parts = slices.select("block", "shard", "x").mapInArrow(_partial(centroids, cuts), "block long, low binary, rest binary")
        return stage(parts.groupBy("block").applyInArrow(_nearest(k), "block long, best binary, distance binary"), "assigned")

    for _ in range(rounds):
        best = assigned().select("block", "best")
        sums = slices.select("block", "shard", "x").join(best, "block").select("shard", "x", "best").mapInArrow(_sums(k, cuts), "shard long, cluster long, dimension long, n long, s long")
        centroids = centroids.copy()
        for r in sums.groupBy("shard", "cluster", "dimension").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():  # k * dimensions rows at most
            centroids[r.cluster, r.dimension] = r.s // r.n
    ids = slices.filter("shard = 0").select("block", "ids")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, best, distance in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                yield pa.record_batch({"vec_id": own.values, "cluster": pa.array(unpack_numbers(best.as_py()).astype(np.int32)), "distance": pa.array(unpack_numbers(distance.as_py()))})

    rows = stage(ids.join(assigned(), "block").select("ids", "best", "distance").mapInArrow(spread, f"vec_id {kind}, cluster int, distance long"), "clustered")
    inertia = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
    known = [(c, s, sum(inertia.values()), [int(v) for v in centroids[c]]) for c, s in inertia.items()]
    return rows.join(F.broadcast(spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid array<long>")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")

"""Contact graphs and distances over the pairs of a sequence, as relations.

Edges and distances are relations of pairs, for joins with others. Spanning forests are found in parts: a task
keeps a least forest of the pairs that it has seen, and only forests move, which have an edge less than nodes at most.
What needs no table of pairs - degrees, searches, triangles, trees, loops - is in :mod:`polyseq.operators.networks`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyseq.operators.maps import is_sticker


def sticker_nodes(rows: DataFrame) -> DataFrame:
    """name, i of the stickers."""
    return rows.filter(is_sticker(F.get("idx", F.col("i")))).select("name", "i")


def sticker_pairs(rows: DataFrame) -> DataFrame:
    """name, u, v, e of pairs u < v of stickers, by position."""
    x = rows.filter(is_sticker(F.get("idx", F.col("i")))).select("name", F.col("i").alias("u"), "idx", F.posexplode_outer("e").alias("v", "e"))
    return x.filter((F.col("v") > F.col("u")) & is_sticker(F.get("idx", F.col("v")))).select("name", "u", "v", "e")


def contact_edges(rows: DataFrame, threshold: float = -0.2, separation: int = 4) -> DataFrame:
    """name, u, v, e of pairs below the threshold and at least ``separation`` apart, u < v."""
    x = rows.select("name", F.col("i").alias("u"), F.posexplode_outer("e").alias("v", "e"))
    return x.filter((F.col("v") - F.col("u") >= separation) & (F.col("e") < threshold))


def spanning_edges(u: np.ndarray, v: np.ndarray, d: np.ndarray) -> list[int]:
    """Which edges a least spanning forest has, in ascending order of (d, u, v)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for k in np.lexsort((v, u, d)).tolist():
        a, b = root(int(u[k])), root(int(v[k]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append(k)
    return kept


def _part(name, rows: tuple[np.ndarray, ...], kind: pa.DataType) -> pa.RecordBatch:
    u, v, d = rows
    return pa.record_batch({"name": pa.array([name] * len(u), kind), "u": pa.array(u, pa.int32()), "v": pa.array(v, pa.int32()), "d": pa.array(d, pa.float64())})


def _local_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A least forest of each stretch of pairs (name, u, v, d) of one sequence."""
    held, rows, kind = None, (), None
    for batch in batches:
        kind, names = batch.column(0).type, batch.column(0).to_pylist()
        columns = [batch.column(k).to_numpy() for k in (1, 2, 3)]
        cuts = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            own = tuple(c[a:b] for c in columns)
            if rows and names[a] == held:
                own = tuple(np.concatenate([x, y]) for x, y in zip(rows, own, strict=True))
            elif rows:
                yield _part(held, rows, kind)
            kept = spanning_edges(*own)
            held, rows = names[a], tuple(c[kept] for c in own)
    if rows:
        yield _part(held, rows, kind)


def spanning_forest(pairs: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """name, u, v, d of a least spanning forest of the pairs (name, u, v, d), by (d, u, v); ``more``: further pairs, few of each node."""
    kind = f"name {pairs.schema['name'].dataType.simpleString()}, u int, v int, d double"
    parts = pairs.select("name", "u", "v", "d").mapInArrow(_local_forests, kind)
    if more is not None:
        parts = parts.unionByName(more.select("name", "u", "v", "d"))

    def merge(x: pd.DataFrame) -> pd.DataFrame:
        return x.iloc[spanning_edges(x.u.to_numpy(), x.v.to_numpy(), x.d.to_numpy())]

    return parts.groupBy("name").applyInPandas(lambda x: merge(x), kind)


def _raw_distance(method: str) -> Column:
    if method not in ("negated", "shifted", "rank"):
        raise ValueError(f"unknown method {method}")
    return F.round(-F.col("e") if method == "negated" else F.col("e"), 12)


def _self_and_pairs(rows: DataFrame) -> DataFrame:
    own = rows.filter(is_sticker(F.get("idx", F.col("i")))).select("name", F.col("i").alias("u"), F.col("i").alias("v"), F.get("e", F.col("i")).alias("e"))
    return own.unionByName(sticker_pairs(rows))


def distances(rows: DataFrame, separation: int = 4, method: str = "negated") -> DataFrame:
    """name, u, v, d of the pairs u < v of stickers.

    Distance is minus the energy (negated), the energy less the least one (shifted), or its rank from 0 (equal energies
    by place); pairs nearer than ``separation`` are one further than the largest, self energies included. Energies are
    taken to twelve decimals, so that those alike but for rounding are alike.
    """
    x = sticker_pairs(rows)
    if method == "rank":
        x = x.withColumn("d", (F.row_number().over(Window.partitionBy("name").orderBy(F.round("e", 12), "u", "v")) - 1).cast("double"))
        far = x.groupBy("name").agg((F.count(F.lit(1)) - 1).cast("double").alias("most"))
        x = x.join(far, "name")
    else:
        d = _raw_distance(method)
        span = _self_and_pairs(rows).groupBy("name").agg(F.min(d).alias("least"), F.max(d).alias("most"))
        off = F.col("least") if method == "shifted" else F.lit(0.0)
        x = x.join(span, "name").withColumn("d", d - off).withColumn("most", F.col("most") - off)
    return x.select("name", "u", "v", F.when(F.col("v") - F.col("u") < separation, F.col("most") + 1).otherwise(F.col("d")).alias("d"))


def merge_tree(rows: DataFrame, separation: int = 4, method: str = "negated") -> DataFrame:
    """name, u, v, d: the edges of a least spanning tree of the :func:`distances`; of far pairs only forests move."""
    if method == "rank":
        return spanning_forest(distances(rows, separation, method))
    d, pairs = _raw_distance(method), sticker_pairs(rows)
    span = _self_and_pairs(rows).groupBy("name").agg(F.min(d).alias("least"), F.max(d).alias("most"))
    near = pairs.filter(F.col("v") - F.col("u") < separation).join(span, "name").withColumn("d", F.col("most") + 1)
    tree = spanning_forest(pairs.filter(F.col("v") - F.col("u") >= separation).withColumn("d", d), near)
    return tree.join(span.select("name", "least"), "name").select("name", "u", "v", (F.col("d") - F.col("least")).alias("d")) if method == "shifted" else tree

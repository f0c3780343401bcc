"""Graphs, spanning trees and loops of a sequence's map, made from the sequence in the tasks that need them.

Neither maps nor edges are shuffled or collected: energies between any nodes are products of their soft compositions, so
a task makes the rows it works on, some at a time, from the sequence. What is linear in rows of the graph - searches from
sources, triangles, loops - is dealt out by blocks of nodes, so that one long sequence is many tasks; per block there is
one result row, and these are summed by Spark. Trees and quantiles need some vectors over nodes, and some rows of the graph at a time.

Nodes are the stickers, or all places. Energies that are compared with each other are taken to twelve decimals, so that
those alike but for rounding are alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyseq.functions.residues import ALPHABET, STICKERS
from polyseq.operators.maps import _STICKER, _numbered, gaussian_weights
from polyseq.operators.moments import _parts, dealt, soft_rows
from polyseq.operators.sequences import count_of

#: Nodes of a block at least, blocks of a sequence at most, cells that are made together, cells of a graph that is kept whole.
BLOCK, BLOCKS, CELLS, WHOLE = 256, 64, 1_000_000, 9_000_000


class Network:
    """The nodes of a sequence, their places and soft compositions; rows of energies on demand."""

    def __init__(self, seq: str, matrix: np.ndarray, weights: list[float], stickers: bool = True) -> None:
        idx = _numbered(seq)
        self.at = np.flatnonzero(_STICKER[idx]) if stickers else np.arange(len(idx))
        soft = [soft_rows(idx, weights, a, b)[_STICKER[idx[a:b]]] if stickers else soft_rows(idx, weights, a, b) for a, b in _parts(len(idx))]
        self.soft = np.concatenate(soft) if soft else np.zeros((0, len(ALPHABET)))
        self.right = matrix @ self.soft.T
        self.n = len(self.at)

    def energies(self, a: int, b: int, first: int = 0) -> np.ndarray:
        """Between the nodes a to b - 1 and those from ``first`` on."""
        return self.soft[a:b] @ self.right[:, first:]

    def far(self, a: int, b: int, separation: int, first: int = 0) -> np.ndarray:
        return np.abs(self.at[a:b, None] - self.at[None, first:]) >= separation

    def apart(self, rows: np.ndarray, nodes: np.ndarray, separation: int, near: float, first: int = 0) -> np.ndarray:
        """``rows``, the values between some nodes and those from ``first`` on, with ``near`` where they are less than ``separation`` apart, themselves included; so few that they are told by place."""
        for k in range(-max(separation, 1) + 1, max(separation, 1)):
            other = nodes + k
            inside = np.flatnonzero((other >= first) & (other < self.n))
            close = inside[np.abs(self.at[other[inside]] - self.at[nodes[inside]]) < separation]
            rows[close, other[close] - first] = near
        return rows

    def count(self, separation: int) -> int:
        """How many pairs of nodes are at least ``separation`` apart."""
        return int(np.searchsorted(self.at, self.at - separation, side="right").sum())

    def span(self, separation: int) -> tuple[float, float]:
        """The least and the largest energy of the pairs of nodes at least ``separation`` apart."""
        low, high = np.inf, -np.inf
        for a, b in self.steps():
            e, nodes = self.energies(a, b, a), np.arange(a, b)
            low = min(low, float(self.apart(e, nodes, separation, np.inf, a).min()))
            high = max(high, float(self.apart(e, nodes, separation, -np.inf, a).max()))
        return low, high

    def steps(self) -> Iterator[tuple[int, int]]:
        step = max(1, CELLS // max(self.n, 1))
        for a in range(0, self.n, step):
            yield a, min(a + step, self.n)

    def pairs(self, separation: int = 1) -> Iterator[np.ndarray]:
        """Energies of the pairs of nodes at least ``separation`` apart, each once."""
        places = np.arange(self.n)
        first = np.searchsorted(self.at, self.at + max(separation, 1))  # later nodes are further away
        for a, b in self.steps():
            yield self.energies(a, b, a)[places[None, a:] >= first[a:b, None]]


class Contacts:
    """The graph of the pairs below a threshold and at least ``separation`` apart; kept whole while small, else its rows are made again."""

    def __init__(self, net: Network, threshold: float, separation: int, digits: int | None) -> None:
        self.net, self.separation, self.digits = net, separation, digits
        self.threshold = threshold if digits is None else round(threshold, digits)
        self.whole = self._rows(0, net.n).astype(np.float32) if net.n * net.n <= WHOLE else None

    def _rows(self, a: int, b: int) -> np.ndarray:
        e = self.net.energies(a, b)
        return ((e if self.digits is None else np.round(e, self.digits)) < self.threshold) & self.net.far(a, b, self.separation)

    def rows(self, a: int, b: int) -> np.ndarray:
        return self._rows(a, b).astype(np.float32) if self.whole is None else self.whole[a:b]

    def times(self, x: np.ndarray) -> np.ndarray:
        """x times the adjacency; float64 in, float64 out."""
        if self.whole is not None:
            return x @ self.whole.astype(x.dtype, copy=False)
        out = np.zeros_like(x)
        for a, b in self.net.steps():
            if x[:, a:b].any():
                out += x[:, a:b] @ self.rows(a, b).astype(x.dtype)
        return out


def _searched(graph: Contacts, low: int, high: int, flows: bool) -> dict:
    """Breadth-first from the nodes low to high - 1 together: lowest node reached, number reached, sum of distances, pairs by distance; flows: what shortest paths give each node."""
    n, k = graph.net.n, high - low
    dist = np.full((k, n), -1, np.int32)
    dist[np.arange(k), np.arange(low, high)] = 0
    paths = np.zeros((k, n))
    paths[np.arange(k), np.arange(low, high)] = 1.0
    front, d = paths if flows else paths.astype(np.float32), 0
    later = np.arange(n)[None, :] > np.arange(low, high)[:, None]
    pairs = []
    while True:
        reached = graph.times(front)
        fresh = (reached > 0) & (dist < 0)
        if not fresh.any():
            break
        d += 1
        dist[fresh] = d
        pairs.append(int((fresh & later).sum()))
        if flows:
            paths[fresh] = reached[fresh]
        front = np.where(fresh, reached if flows else np.float32(1), 0).astype(front.dtype)
    seen = dist >= 0
    out = {"i": graph.net.at[low:high], "root": graph.net.at[seen.argmax(axis=1)], "size": seen.sum(axis=1), "far": np.where(seen, dist, 0).sum(axis=1), "pairs": pairs}
    if flows:
        flow = np.zeros((k, n))
        for level in range(d, 0, -1):
            own = dist == level
            back = graph.times(np.where(own, (1.0 + flow) / np.where(own, paths, 1.0), 0.0))
            flow = np.where(dist == level - 1, paths * back, flow)
        flow[np.arange(k), np.arange(low, high)] = 0.0
        out["flow"] = flow.sum(axis=0)
    return out


_KINDS = {"int": pa.int64(), "real": pa.float64(), "ints": pa.list_(pa.int64()), "reals": pa.list_(pa.float64())}
_SQL = {"int": "long", "real": "double", "ints": "array<long>", "reals": "array<double>"}


def _run(x: DataFrame, out: dict[str, str], measure: Callable[..., dict]) -> DataFrame:
    """name and what ``measure`` makes of the other columns of each row; one row at a time is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[1:]]
            for k, values in enumerate(zip(*columns, strict=True)):
                found = measure(*values)
                yield pa.record_batch({"name": batch.column(0).slice(k, 1)} | {c: pa.array([found[c].tolist() if isinstance(found[c], np.ndarray) else found[c]], _KINDS[kind]) for c, kind in out.items()})

    return x.mapInArrow(run, f"name {x.schema['name'].dataType.simpleString()}, " + ", ".join(f"{c} {_SQL[k]}" for c, k in out.items()))


def _blocks(df: DataFrame, *columns: str, stickers: bool) -> DataFrame:
    """``columns`` with low and high, the nodes of each block of each sequence; dealt out by blocks. Sequences without nodes have none."""
    n = count_of(F.col("seq"), STICKERS) if stickers else F.length("seq")
    x = df.select(*columns, n.cast("long").alias("nodes")).filter("nodes > 0").withColumn("size", F.greatest(F.lit(BLOCK), F.ceil(F.col("nodes") / BLOCKS)))
    x = x.withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nodes") - 1, F.col("size"))))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    return x.select(*columns, "low", F.least(F.col("low") + F.col("size"), F.col("nodes")).alias("high")).repartition(parts, "name", "low")


def _made(matrix: list[list[float]], sigma: float, stickers: bool) -> Callable[[str], Network]:
    m, w = np.array(matrix), gaussian_weights(sigma)
    return lambda seq: Network(seq, m, w, stickers)


def searches(df: DataFrame, matrix: list[list[float]], sigma: float = 2.0, separation: int = 4, stickers: bool = True, digits: int | None = 12, flows: bool = False) -> DataFrame:
    """From ``df`` (name, seq, threshold) a row for each block of sources: i, root, size, far (arrays over sources), pairs (by distance, from 1 on), and with ``flows`` flow (over all nodes)."""
    made = _made(matrix, sigma, stickers)
    out = {"i": "ints", "root": "ints", "size": "ints", "far": "ints", "pairs": "ints"} | ({"flow": "reals", "at": "ints"} if flows else {})

    def measure(seq: str, threshold: float, low: int, high: int) -> dict:
        net = made(seq)
        return _searched(Contacts(net, threshold, separation, digits), low, high, flows) | {"at": net.at}

    return _run(_blocks(df, "name", "seq", "threshold", stickers=stickers), out, measure)


def path_statistics(found: DataFrame) -> DataFrame:
    """name, n_components, largest, path_length (mean within the largest component, the first of equals; 0 for one node), from :func:`searches`."""
    x = found.select("name", F.explode(F.arrays_zip("root", "far")).alias("x")).groupBy("name", F.col("x.root").alias("root")).agg(F.count(F.lit(1)).alias("k"), F.sum("x.far").alias("far"))
    big = F.max_by(F.struct("k", "far"), F.struct("k", -F.col("root"))).alias("b")
    x = x.groupBy("name").agg(F.count(F.lit(1)).alias("n_components"), big)
    k = F.col("b.k")
    return x.select("name", "n_components", k.alias("largest"), F.when(k > 1, F.col("b.far") / (k * (k - 1))).otherwise(0.0).alias("path_length"))


def distance_histogram(found: DataFrame) -> DataFrame:
    """name, steps, pairs: how many pairs u < v of nodes are so many steps apart, from :func:`searches`; pairs without a path aren't counted."""
    x = found.select("name", F.posexplode("pairs").alias("k", "c")).groupBy("name", (F.col("k") + 1).cast("long").alias("steps")).agg(F.sum("c").alias("pairs"))
    return x.filter("pairs > 0")


def betweenness(found: DataFrame) -> DataFrame:
    """name, i, betweenness: shares of shortest paths through a node, from all sources, over (n - 1)(n - 2), from :func:`searches` with flows; 0 under three nodes."""
    x = found.select("name", F.size("at").alias("n"), F.explode(F.arrays_zip("at", "flow")).alias("x")).groupBy("name", "n", F.col("x.at").cast("int").alias("i")).agg(F.sum("x.flow").alias("b"))
    return x.select("name", "i", F.when(F.col("n") > 2, F.col("b") / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(0.0).alias("betweenness"))


def neighbours(df: DataFrame, matrix: list[list[float]], sigma: float = 2.0, separation: int = 4, stickers: bool = True, digits: int | None = 12, triangles: bool = True) -> DataFrame:
    """From ``df`` (name, seq, threshold): name, i, degree and, if wanted, triangles of each node; a row of the graph times the graph counts common neighbours."""
    made = _made(matrix, sigma, stickers)

    def measure(seq: str, threshold: float, low: int, high: int) -> dict:
        net = made(seq)
        graph = Contacts(net, threshold, separation, digits)
        degree, closed = np.zeros(high - low, np.int64), np.zeros(high - low, np.int64)
        step = max(1, CELLS // max(net.n, 1))
        for a in range(low, high, step):
            own = graph.rows(a, min(a + step, high))
            degree[a - low : a - low + len(own)] = own.sum(axis=1)
            if triangles:
                closed[a - low : a - low + len(own)] = (graph.times(own) * own).sum(axis=1, dtype=np.float64) / 2
        return {"i": net.at[low:high], "degree": degree, "triangles": closed}

    x = _run(_blocks(df, "name", "seq", "threshold", stickers=stickers), {"i": "ints", "degree": "ints", "triangles": "ints"}, measure)
    x = x.select("name", F.explode(F.arrays_zip("i", "degree", "triangles")).alias("x"))
    return x.select("name", F.col("x.i").cast("int").alias("i"), "x.degree", "x.triangles")


def degree_statistics(found: DataFrame) -> DataFrame:
    """name, n_nodes, n_edges, density, mean_degree, std_degree, max_degree, min_degree, from :func:`neighbours`."""
    x = found.groupBy("name").agg(F.count(F.lit(1)).alias("n_nodes"), (F.sum("degree") / 2).cast("long").alias("n_edges"), F.avg("degree").alias("mean_degree"), F.stddev_pop("degree").alias("std_degree"), F.max("degree").alias("max_degree"), F.min("degree").alias("min_degree"))
    return x.withColumn("density", F.when(F.col("n_nodes") > 1, 2 * F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).otherwise(0.0))


def local_clustering(found: DataFrame) -> DataFrame:
    """name, i, clustering: the share of pairs of neighbours that are neighbours; 0 with fewer than two."""
    k = F.col("degree")
    return found.select("name", "i", F.when(k > 1, 2.0 * F.col("triangles") / (k * (k - 1))).otherwise(0.0).alias("clustering"))


def clustering_coefficient(found: DataFrame) -> DataFrame:
    """name, clustering: three times the triangles over the connected triples; 0 without any."""
    x = found.groupBy("name").agg(F.sum("triangles").alias("t"), F.sum(F.col("degree") * (F.col("degree") - 1) / 2).alias("k"))
    return x.select("name", F.when(F.col("k") > 0, F.col("t") / F.col("k")).otherwise(0.0).alias("clustering"))


# quantiles and histograms of pair energies

def _extremes(parts: Iterator[np.ndarray]) -> tuple[int, float, float]:
    n, low, high = 0, np.inf, -np.inf
    for e in parts:
        if e.size:
            n, low, high = n + e.size, min(low, float(e.min())), max(high, float(e.max()))
    return n, low, high


def _binned(e: np.ndarray, low: float, high: float, bins: int) -> np.ndarray:
    return np.minimum(((e - low) / ((high - low) / bins)).astype(np.int64), bins - 1)


def selected(parts: Callable[[], Iterator[np.ndarray]], ranks: list[int], held: int = CELLS, bins: int = 1 << 16) -> list[float]:
    """The values at the given places, from 0, of all values in order: counted by bins, each within a bin of the last, until those of a bin can be held."""
    n, low, high = _extremes(parts())
    found: dict[int, float] = {}
    todo = [(low, high, n, 0, sorted(set(ranks)))]  # values from low to high: how many, how many lie below, which places are wanted among them
    while todo:
        low, high, k, below, wanted = todo.pop()
        inside = lambda e, low=low, high=high: e[(e >= low) & (e <= high)]
        if low == high:
            found.update(dict.fromkeys(wanted, low))
        elif k <= held:
            own = np.sort(np.concatenate([inside(e) for e in parts()]))
            found.update({r: float(own[r - below]) for r in wanted})
        else:
            counts = np.zeros(bins, np.int64)
            for e in parts():
                e = inside(e)
                counts += np.bincount(_binned(e, low, high, bins), minlength=bins)
            before = below + np.concatenate([[0], np.cumsum(counts)])
            for b in np.unique(np.searchsorted(before, wanted, side="right") - 1).tolist():
                first, last = np.inf, -np.inf  # the least and the largest value of the bin: bins' edges are subject to rounding
                for e in parts():
                    e = inside(e)
                    e = e[_binned(e, low, high, bins) == b]
                    if e.size:
                        first, last = min(first, float(e.min())), max(last, float(e.max()))
                todo.append((first, last, int(counts[b]), int(before[b]), [r for r in wanted if before[b] <= r < before[b + 1]]))
    return [found[r] for r in ranks]


def auto_threshold(df: DataFrame, matrix: list[list[float]], sigma: float = 2.0, share: float = 0.25, separation: int = 4) -> DataFrame:
    """name, seq, threshold: a quantile of the energies of sticker pairs, between two values in proportion; 0 without any. Exact, and no more than CELLS of the energies are held."""
    made = _made(matrix, sigma, True)

    def measure(seq: str) -> dict:
        net = made(seq)
        n = net.count(separation)
        if not n:
            return {"threshold": 0.0}
        place = share * (n - 1)
        low = int(place)
        places = [low, min(low + 1, n - 1)]
        if n <= CELLS:
            e = np.concatenate(list(net.pairs(separation)))
            a, b = np.partition(e, places)[places].tolist()
        else:
            a, b = selected(lambda: net.pairs(separation), places)
        return {"threshold": a + (b - a) * (place - low)}

    return _keeping_seq(df, {"threshold": "real"}, measure)


def _keeping_seq(df: DataFrame, out: dict[str, str], measure: Callable[[str], dict]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(seq) for seq in batch.column(1).to_pylist()]
            yield pa.record_batch({"name": batch.column(0), "seq": batch.column(1)} | {c: pa.array([f[c] for f in found], _KINDS[k]) for c, k in out.items()})

    return dealt(df, "name", "seq").mapInArrow(run, f"name {df.schema['name'].dataType.simpleString()}, seq string, " + ", ".join(f"{c} {_SQL[k]}" for c, k in out.items()))


def interaction_entropy(df: DataFrame, matrix: list[list[float]], sigma: float = 2.0, bins: int = 20) -> DataFrame:
    """name, entropy in bits of a histogram of the energies of all sticker pairs; 0 without any."""
    made = _made(matrix, sigma, True)

    def measure(seq: str) -> dict:
        net = made(seq)
        n, low, high = _extremes(net.pairs())
        if not n or high - low <= 0:
            return {"entropy": 0.0}
        counts = sum(np.bincount(_binned(e, low, high, bins), minlength=bins) for e in net.pairs())
        p = counts[counts > 0] / n
        return {"entropy": float(-(p * np.log2(p)).sum()) + 0.0}

    return _keeping_seq(df, {"entropy": "real"}, measure).drop("seq")


# spanning trees, percolation, diagrams

def spanning_tree(n: int, rows: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """u < v and d of the least spanning forest by (d, u, v), in that order; ``rows`` gives the distances of some nodes to all, infinite where there is no edge.

    In each round every part is joined with what is nearest to it. A node keeps the nearest node outside its part, the
    first of equals, and its row is made again only when that one has come into its part. Some rows at a time are held.
    """
    label, near, best = np.arange(n), np.full(n, -1), np.full(n, -np.inf)
    step, places, out = max(1, CELLS // max(n, 1)), np.arange(n), [np.zeros((0, 2), np.int64)]
    weights = [np.zeros(0)]
    while n > 1:
        short = label.astype(np.int32)
        stale = np.flatnonzero((best < np.inf) & ((near < 0) | (label[near] == label)))
        for k in range(0, len(stale), step):
            own = stale[k : k + step]
            d = np.where(short[own, None] == short[None, :], np.inf, rows(own))
            near[own] = d.argmin(axis=1)
            best[own] = d[np.arange(len(own)), near[own]]
        open_ = np.flatnonzero(best < np.inf)
        if not len(open_):
            break
        lo, hi = np.minimum(open_, near[open_]), np.maximum(open_, near[open_])
        order = np.lexsort((hi, lo, best[open_], label[open_]))
        first = order[np.flatnonzero(np.diff(label[open_][order], prepend=-1))]
        code, at = np.unique(lo[first] * n + hi[first], return_index=True)
        u, v, w, before = code // n, code % n, best[open_][first][at], label
        label = _joined(label, u, v, places)
        if len(u) > len(np.unique(before)) - len(np.unique(label)):  # a loop of edges alike but for rounding, which differs by end
            keep = _forest(before[u], before[v], np.lexsort((v, u, w)))
            u, v, w = u[keep], v[keep], w[keep]
        out.append(np.column_stack([u, v]))
        weights.append(w)
    edges, d = np.concatenate(out), np.concatenate(weights)
    order = np.lexsort((edges[:, 1], edges[:, 0], d))
    return edges[order, 0], edges[order, 1], d[order]


def _joined(label: np.ndarray, u: np.ndarray, v: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Labels, which are nodes of the parts, after the parts of u and v have been joined: least labels go along the edges, and along labels, until none changes."""
    root, a, b = places.copy(), label[u], label[v]
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if (root == before).all():
            return root[label]


def _forest(a: np.ndarray, b: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which of the edges, taken in that order, close no loop."""
    part, keep = {x: {x} for x in [*a.tolist(), *b.tolist()]}, []
    for k in order.tolist():
        x, y = part[int(a[k])], part[int(b[k])]
        if x is not y:
            keep.append(k)
            x |= y
            part.update(dict.fromkeys(y, x))
    return np.array(keep)


def grown(n: int, u: np.ndarray, v: np.ndarray, d: np.ndarray, thresholds: np.ndarray) -> tuple[list[int], list[int]]:
    """Components and size of the largest at each threshold, ascending, by the edges of a tree in ascending order that are below it."""
    root, size, largest, done, parts, most = list(range(n)), [1] * n, 1, 0, [], []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for t in thresholds:
        while done < len(d) and d[done] < t:
            a, b = find(int(u[done])), find(int(v[done]))
            a, b = (a, b) if size[a] >= size[b] else (b, a)
            root[b] = a
            size[a] += size[b]
            largest, done = max(largest, size[a]), done + 1
        parts.append(n - done)
        most.append(largest)
    return parts, most


def percolation_curve(df: DataFrame, matrix: list[list[float]], sigma: float = 2.0, steps: int = 50, separation: int = 4) -> DataFrame:
    """name, step, threshold, n_components, largest, fraction of the stickers, along a sweep over thresholds.

    Edges are sticker pairs below the threshold and at least ``separation`` apart; the sweep goes a tenth of the span of
    their energies beyond both ends, or from -1 to 0 without any. One spanning tree tells which stickers hang together at
    any threshold. With fewer than two stickers there is one step, at 0; without any, no row.
    """
    made = _made(matrix, sigma, True)

    def measure(seq: str) -> dict:
        net = made(seq)
        if net.n < 2:
            return {"threshold": [0.0] * net.n, "n_components": [net.n] * net.n, "largest": [net.n] * net.n, "fraction": [1.0] * net.n}
        k, (low, high) = net.count(separation), net.span(separation)
        high = high if high - low > 1e-11 else low  # alike but for rounding
        margin = (0.1 * (high - low) or 0.1) if k else 0.0
        grid = np.linspace(low - margin, high + margin, steps) if k else np.linspace(-1.0, 0.0, steps)
        tree = spanning_tree(net.n, lambda nodes: net.apart(net.soft[nodes] @ net.right, nodes, separation, np.inf))
        parts, most = grown(net.n, *tree, grid)
        return {"threshold": grid, "n_components": parts, "largest": most, "fraction": [x / net.n for x in most]}

    x = _run(dealt(df, "name", "seq"), {"threshold": "reals", "n_components": "ints", "largest": "ints", "fraction": "reals"}, measure)
    x = x.select("name", F.posexplode(F.arrays_zip("threshold", "n_components", "largest", "fraction")).alias("step", "x"))
    return x.select("name", "step", "x.threshold", "x.n_components", "x.largest", "x.fraction")


def percolation(curve: DataFrame) -> DataFrame:
    """name, threshold, onset: of :func:`percolation_curve`, where the largest component grows most (the left end, the first of equals), and the first that holds half the stickers, or else the lowest."""
    order = Window.partitionBy("name").orderBy("step")
    x = curve.withColumn("growth", F.coalesce(F.lead("fraction").over(order) - F.col("fraction"), F.lit(-1.0)))
    half = F.min_by("threshold", F.when(F.col("fraction") >= 0.5, F.col("step")))
    return x.groupBy("name").agg(F.max_by("threshold", F.struct("growth", -F.col("step"))).alias("threshold"), F.coalesce(half, F.min_by("threshold", "step")).alias("onset"))


METHODS = ("negated", "shifted", "rank")


class Distances:
    """Distances of stickers from their energies: minus these (negated), these less the least one (shifted), or their rank from 0, equal ones by place (rank, which holds all pairs); near pairs are one further than the largest."""

    def __init__(self, net: Network, separation: int, method: str) -> None:
        if method not in METHODS:
            raise ValueError(f"unknown method {method}")
        self.net, self.separation, self.sign, self.ranks = net, separation, -1.0 if method == "negated" else 1.0, None
        low = high = 0.0
        if net.n and method == "rank":
            u, v = np.triu_indices(net.n, 1)
            order = np.argsort(np.round(net.energies(0, net.n)[u, v], 12), kind="stable")
            self.ranks = np.zeros((net.n, net.n))
            self.ranks[u[order], v[order]] = self.ranks[v[order], u[order]] = np.arange(len(u))
            high = len(u) - 1.0
        elif net.n:
            _, low, high = _extremes(self.sign * net.energies(a, b, a) for a, b in net.steps())
            low, high = float(np.round(low, 12)), float(np.round(high, 12))
        self.off = low if method == "shifted" else 0.0
        self.most = high - self.off

    def rows(self, a: int, b: int, first: int = 0) -> np.ndarray:
        d = np.round(self.sign * self.net.energies(a, b, first), 12) - self.off if self.ranks is None else self.ranks[a:b, first:]
        return np.where(self.net.far(a, b, self.separation, first), d, self.most + 1)

    def tree(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return spanning_tree(self.net.n, lambda nodes: self.net.apart(self._of(nodes), nodes, self.separation, self.most + 1))

    def _of(self, nodes: np.ndarray) -> np.ndarray:
        return np.round(self.sign * (self.net.soft[nodes] @ self.net.right), 12) - self.off if self.ranks is None else self.ranks[nodes]

    def deaths(self) -> np.ndarray:
        """The distances of the edges of :meth:`tree`, ascending. Rounding keeps the order, so that only they are rounded."""
        if self.ranks is not None:
            return self.tree()[2]
        far = np.nextafter(self.most + self.off + 1, np.inf)
        d = spanning_tree(self.net.n, lambda nodes: self.net.apart(self.sign * (self.net.soft[nodes] @ self.net.right), nodes, self.separation, far))[2]
        return np.where(d < far, np.round(d, 12) - self.off, self.most + 1)


def closing(distances: Distances, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """birth, death of the loops that edges from the nodes low to high - 1 to later ones open: not those of the tree, nor what closes at once.

    An edge's loop is closed by the third node that is nearest in the sense of its larger distance: a product of the
    distances with themselves, with the least for the sum and the larger for the product, made some rows at a time.
    """
    n, births, deaths = distances.net.n, [], []
    u, v, _ = distances.tree()
    whole = distances.rows(0, n) if n * n <= WHOLE else None
    for i in range(low, min(high, n - 1)):
        own = distances.rows(i, i + 1)[0]
        closed = np.full(n, np.inf)
        step = max(1, CELLS // n)
        for k in range(0, n, step):
            other = distances.rows(k, min(k + step, n)) if whole is None else whole[k : k + step]
            both = np.maximum(own[k : k + step, None], other)
            at = np.arange(len(other))
            both[at, k + at] = np.inf  # the edge's own end
            if k <= i < k + step:
                both[i - k] = np.inf
            closed = np.minimum(closed, both.min(axis=0))
        birth = own[i + 1 :]
        death = np.maximum(birth, closed[i + 1 :])
        keep = (death > birth) & np.isfinite(death)
        keep[v[u == i] - i - 1] = False
        births.append(birth[keep])
        deaths.append(death[keep])
    empty = np.zeros(0)
    return (np.concatenate(births), np.concatenate(deaths)) if births else (empty, empty)


def persistence_diagrams(df: DataFrame, matrix: list[list[float]], sigma: float = 2.0, separation: int = 4, method: str = "negated", loops: bool = True) -> DataFrame:
    """name, dim, birth, death of the stickers' :class:`Distances`: dim 0 for components, of which one never dies (infinity), 1 for loops."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    made = _made(matrix, sigma, True)

    def merged(seq: str) -> dict:
        net = made(seq)
        deaths = Distances(net, separation, method).deaths().tolist() + [np.inf] if net.n else []
        return {"birth": [0.0] * len(deaths), "death": deaths}

    def looped(seq: str, low: int, high: int) -> dict:
        birth, death = closing(Distances(made(seq), separation, method), low, high)
        return {"birth": birth, "death": death}

    listed = lambda x, dim: x.select("name", F.lit(dim).alias("dim"), F.explode(F.arrays_zip("birth", "death")).alias("x")).select("name", "dim", "x.birth", "x.death")
    kind = {"birth": "reals", "death": "reals"}
    zero = listed(_run(dealt(df, "name", "seq"), kind, merged), 0)
    return zero.unionByName(listed(_run(_blocks(df, "name", "seq", stickers=True), kind, looped), 1)) if loops else zero


def distance_spans(df: DataFrame, matrix: list[list[float]], sigma: float = 2.0, separation: int = 4, method: str = "negated") -> DataFrame:
    """name, low, high: the least positive and the largest distance of pairs of stickers (0 if that is below); none without a positive one."""
    made = _made(matrix, sigma, True)

    def measure(seq: str) -> dict:
        net = made(seq)
        found, low, high = Distances(net, separation, method), np.inf, -np.inf
        for a, b in net.steps():
            d = found.rows(a, b, a)
            d = d[np.arange(a, net.n)[None, :] > np.arange(a, b)[:, None]]
            if d.size:
                high = max(high, float(d.max()))
                low = min(low, float(d[d > 0].min(initial=np.inf)))
        return {"low": low if np.isfinite(low) else None, "high": max(high, 0.0)}

    return _run(dealt(df, "name", "seq"), {"low": "real", "high": "real"}, measure).filter("low is not null")


def betti_curves(spans: DataFrame, diagrams: DataFrame, steps: int = 50) -> DataFrame:
    """name, step, t, b0, b1: features of ``diagrams`` alive at each of ``steps`` distances along the :func:`distance_spans`."""
    grid = spans.select("name", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    width = (F.col("high") - F.col("low")) / (steps - 1)
    grid = grid.select("name", "step", F.when(F.col("step") == steps - 1, F.col("high")).otherwise(F.col("low") + F.col("step") * width).alias("t"))
    alive = (F.col("birth") <= F.col("t")) & (F.col("t") < F.col("death"))
    return grid.join(diagrams, "name").groupBy("name", "step", "t").agg(F.count_if(alive & (F.col("dim") == 0)).alias("b0"), F.count_if(alive & (F.col("dim") == 1)).alias("b1"))


def persistence(spans: DataFrame, diagrams: DataFrame, grid: int = 50) -> DataFrame:
    """name, n_features, h0_total, h0_longest, h0_mean_death, h1_features, h1_total, h1_longest, b0_auc, b1_auc: sums and largest of the finite lifetimes, and left sums under the curves. Zeros for what there is none of."""
    life, finite = F.col("death") - F.col("birth"), F.col("death") < float("inf")
    of = lambda dim: F.when(finite & (F.col("dim") == dim), life)
    sums = diagrams.groupBy("name").agg(
        F.count_if(F.col("dim") == 0).alias("n_features"), F.sum(of(0)).alias("h0_total"), F.max(of(0)).alias("h0_longest"), F.avg(F.when(finite & (F.col("dim") == 0), F.col("death"))).alias("h0_mean_death"),
        F.count_if(F.col("dim") == 1).alias("h1_features"), F.sum(of(1)).alias("h1_total"), F.max(of(1)).alias("h1_longest"),
    )
    step = F.lead("t").over(Window.partitionBy("name").orderBy("step")) - F.col("t")
    areas = betti_curves(spans, diagrams, grid).withColumn("w", step).groupBy("name").agg(F.sum(F.col("b0") * F.col("w")).alias("b0_auc"), F.sum(F.col("b1") * F.col("w")).alias("b1_auc"))
    return sums.join(areas, "name", "left").na.fill(0.0, ["h0_total", "h0_longest", "h0_mean_death", "h1_total", "h1_longest", "b0_auc", "b1_auc"])

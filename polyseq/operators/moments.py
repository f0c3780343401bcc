"""Measures of interaction maps at the cost of a sequence's length, so that they reach whole documents.

A map is S M S', S being the soft composition of each place. What follows needs no map: sums over classes of pairs are
products of 20 sums, the mean square is a trace over the 20 x 20 Gram matrix of S, sums over bands are products of near
rows, sums by separation are a correlation, sums over blocks are differences of running sums, and what a variant changes
lies in the rows and columns near the places where it differs. Each is one pass of a task over the sequence, in parts of
STEP places; nothing is shuffled but, where the input has fewer partitions than there are cores, the sequences.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyseq.functions.residues import ALPHABET
from polyseq.operators.maps import _STICKER, _numbered, gaussian_weights

#: Places that are done together; cells of a difference that are.
STEP, CELLS = 4096, 1_000_000


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of df, dealt out if there are fewer partitions than cores: an input of one file would be one task."""
    n = df.sparkSession.sparkContext.defaultParallelism
    x = df.select(*columns)
    return x.repartition(n, columns[0]) if x.rdd.getNumPartitions() < n else x


def reflected(n: int, low: int, high: int) -> np.ndarray:
    """The places low to high - 1 of a sequence of n, reflected at its edges, half a sample beyond them."""
    f = np.arange(low, high) % (2 * n)
    return np.where(f < n, f, 2 * n - 1 - f)


def smooth(x: np.ndarray, weights: list[float]) -> np.ndarray:
    """Numbers weighted over neighbours, edges reflected; the weights are symmetric, so this is its own transpose."""
    r = len(weights) // 2
    return np.convolve(x[reflected(len(x), -r, len(x) + r)], weights, "valid") if r else x


def soft_rows(idx: np.ndarray, weights: list[float], low: int, high: int, halo: int = 0, of: np.ndarray | None = None) -> np.ndarray:
    """The soft composition of the places low - halo to high + halo - 1 that exist; of: rows for the residues that are weighted in place of their unit vectors."""
    n, r = len(idx), len(weights) // 2
    low, high = max(low - halo, 0), min(high + halo, n)
    near = idx[reflected(n, low - r, high + r)]
    hot = (np.eye(len(ALPHABET)) if of is None else of).take(near, axis=0)
    out, part = np.zeros((high - low, hot.shape[1])), np.empty((high - low, hot.shape[1]))
    for d, w in enumerate(weights):
        out += np.multiply(hot[d : d + high - low], w, out=part)
    return out


def _parts(n: int) -> Iterator[tuple[int, int]]:
    for low in range(0, n, STEP):
        yield low, min(low + STEP, n)


_ROW = {float: ("double", pa.float64()), int: ("long", pa.int64()), list: ("array<double>", pa.list_(pa.float64()))}


def _lists(rows: tuple[np.ndarray, ...]) -> pa.Array:
    """A row for each array, without a Python number for each entry."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows), pa.float64()))


def _per_sequence(df: DataFrame, columns: list[str], out: dict[str, type], measure: Callable[..., tuple]) -> DataFrame:
    """A row for each row of ``df``: its name and what ``measure`` makes of its other columns, which are texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # results may be as long as the texts
                part = batch.slice(at, 64)
                rows = [measure(*texts) for texts in zip(*[c.to_pylist() for c in part.columns[1:]], strict=True)]
                found = zip(out.items(), zip(*rows, strict=True), strict=True)
                yield pa.record_batch({"name": part.column(0)} | {k: _lists(v) if t is list else pa.array(v, _ROW[t][1]) for (k, t), v in found})

    kind = df.schema["name"].dataType.simpleString()
    return dealt(df, "name", *columns).mapInArrow(run, f"name {kind}, " + ", ".join(f"{k} {_ROW[t][0]}" for k, t in out.items()))


def linear_energies(df: DataFrame, matrix: list[list[float]], sigma: float = 2.0, want: tuple[str, ...] = ("classes", "total", "profile")) -> DataFrame:
    """name, n and what is wanted of the smoothed map: n_stickers, ss, ll, cross (classes); total, mean (total); profile.

    ss, ll and cross are means by class of both ends, diagonal included, 0 for an empty class: the sums of soft
    compositions over a class are the residues counted by its smoothed mask. total and mean are over i < j; the diagonal
    that is taken off is a sum of squares of one smoothing for each eigenvector of the energies. profile has the means of
    the rows, one smoothing.
    """
    w, m = gaussian_weights(sigma), np.array(matrix)
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    keep = np.abs(values) > 1e-13
    values, vectors = values[keep], vectors[:, keep]
    out: dict[str, type] = {"n": int}
    out |= {"n_stickers": int, "ss": float, "ll": float, "cross": float} if "classes" in want else {}
    out |= {"total": float, "mean": float} if "total" in want else {}
    out |= {"profile": list} if "profile" in want else {}

    def measure(seq: str) -> tuple:
        idx = _numbered(seq)
        n, t = len(idx), np.bincount(idx, minlength=len(ALPHABET)).astype(float)
        found: list = [n]
        if "classes" in want:
            own = _STICKER[idx]
            k, s = int(own.sum()), np.bincount(idx, smooth(own.astype(float), w), minlength=len(ALPHABET))
            rest = t - s
            mean = lambda total, count: float(total / count) if count else 0.0
            found += [k, mean(s @ m @ s, k * k), mean(rest @ m @ rest, (n - k) ** 2), mean(2 * (s @ m @ rest), 2 * k * (n - k))]
        if "total" in want:
            diagonal = sum(value * float(np.square(smooth(vector[idx], w)).sum()) for value, vector in zip(values, vectors.T, strict=True))
            total = (float(t @ m @ t) - diagonal) / 2
            found += [total, total / (n * (n - 1) / 2) if n > 1 else 0.0]
        if "profile" in want:
            found.append(smooth((m @ t / n)[idx], w))
        return tuple(found)

    return _per_sequence(df, ["seq"], out, measure)


def map_moments(df: DataFrame, matrix: list[list[float]], sigma: float = 2.0, mask: int | None = None) -> DataFrame:
    """name, n, mean, std, total, off_diagonal_mean of the smoothed map and, for its z-scores, shift and scale.

    The variance is taken from the scatter of the soft composition about its mean, so that a flat map has none. With
    ``mask`` the places within that band are 0 for shift and scale (the population's), as they are before a map is normalised.
    """
    w, m = gaussian_weights(sigma), np.array(matrix)

    def measure(seq: str) -> tuple:
        idx = _numbered(seq)
        n, t = len(idx), np.bincount(idx, minlength=len(ALPHABET)).astype(float)
        middle, scatter, diagonal, band, band_squares = t / n, np.zeros(m.shape), 0.0, 0.0, 0.0
        for low, high in _parts(n):
            soft = soft_rows(idx, w, low, high, mask or 0)
            first = low - max(low - (mask or 0), 0)
            own = soft[first : first + high - low]
            scatter += (own - middle).T @ (own - middle)
            energies = own @ m
            for d in range((mask or 0) + 1):
                other = soft[first + d : first + d + high - low]
                e = np.einsum("ia,ia->i", energies[: len(other)], other)
                diagonal += float(e.sum()) if not d else 0.0
                band += float(e.sum()) * (2 if d else 1)
                band_squares += float(np.square(e).sum()) * (2 if d else 1)
        total = float(t @ m @ t)
        variance = float(np.trace(m @ scatter @ m.T @ scatter) + 2 / n * (t @ m @ scatter @ m.T @ t)) / n**2
        mean, shift, scale = total / n**2, total / n**2, math.sqrt(max(variance, 0.0))
        if mask is not None:
            shift = (total - band) / n**2
            scale = math.sqrt(max(variance + mean**2 - band_squares / n**2 - shift**2, 0.0))
        return n, mean, math.sqrt(max(variance, 0.0)), total, (total - diagonal) / (n * n - n) if n > 1 else 0.0, shift, scale

    return _per_sequence(df, ["seq"], {"n": int, "mean": float, "std": float, "total": float, "off_diagonal_mean": float, "shift": float, "scale": float}, measure)


def transform_size(n: int) -> int:
    """The least product of 2, 3 and 5 that is n or more and has one of a few odd parts: transforms of it are fast, and it isn't up to twice n, as a power of two is."""
    return min(odd << (-(-n // odd) - 1).bit_length() for odd in (1, 3, 5, 9, 15, 25, 27, 45, 75, 81, 125, 135))


def separation_sums(seq: str, values: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The raw energies of all pairs by separation, from 0 on: the autocorrelations of the residues' eigenvector entries, weighted, by one transform each, some together."""
    idx = _numbered(seq)
    n = len(idx)
    size = transform_size(2 * n)
    power, step = np.zeros(size // 2 + 1), max(1, CELLS // size)
    for k in range(0, len(values), step):
        f = np.fft.rfft(vectors.T[k : k + step].take(idx, axis=1), size)
        power += values[k : k + step] @ (f.real**2 + f.imag**2)
    return np.fft.irfft(power, size)[:n]


def separation_energies(df: DataFrame, matrix: list[list[float]], separation: int = 4, persistence: float = 5.0, want: tuple[str, ...] = ("by_separation", "chain", "contact")) -> DataFrame:
    """name and what is wanted of the raw map: by_separation (the sums over pairs j - i = d, from d = 1 on), chain (those at least ``separation`` apart), contact (weighted by (d / persistence) ** -1.5 from d = 3 on)."""
    m = np.array(matrix)
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    keep = np.abs(values) > 1e-13
    values, vectors = values[keep], vectors[:, keep]

    def measure(seq: str) -> tuple:
        g = separation_sums(seq, values, vectors)
        far = np.arange(3, len(g))
        found = {"by_separation": g[1:], "chain": float(g[separation:].sum()), "contact": float((g[3:] * (far / persistence) ** -1.5).sum())}
        return tuple(found[k] for k in want)

    kinds = {"by_separation": list, "chain": float, "contact": float}
    return _per_sequence(df, ["seq"], {k: kinds[k] for k in want}, measure)


def local_densities(df: DataFrame, matrix: list[list[float]], sigma: float = 2.0, window: int = 10) -> DataFrame:
    """name, density: for each place the mean of the square block of the smoothed map around it, cut at the edges; a block's sum is that of the squares of its sums along the energies' eigenvectors, weighted."""
    w, m = gaussian_weights(sigma), np.array(matrix)
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    keep = np.abs(values) > 1e-13
    values, vectors = values[keep], np.ascontiguousarray(vectors[:, keep])

    def measure(seq: str) -> tuple:
        idx = _numbered(seq)
        n, found = len(idx), []
        for low, high in _parts(n):
            soft, start = soft_rows(idx, w, low, high, window, vectors), max(low - window, 0)
            sums = np.zeros((len(soft) + 1, len(values)))
            np.cumsum(soft, axis=0, out=sums[1:])
            at = np.arange(low, high)
            a, b = np.maximum(at - window, 0), np.minimum(at + window + 1, n)
            block = sums[b - start] - sums[a - start]
            found.append(np.square(block) @ values / (b - a) ** 2)
        return (np.concatenate(found) if found else np.zeros(0),)

    return _per_sequence(df, ["seq"], {"density": list}, measure)


def changed_places(a: np.ndarray, b: np.ndarray, weights: list[float]) -> np.ndarray:
    """The places whose soft composition differs between two sequences of one length."""
    return np.flatnonzero(smooth((a != b).astype(float), [1.0] * len(weights)) > 0.5)


def map_differences(df: DataFrame, matrix: list[list[float]], sigma: float = 2.0) -> DataFrame:
    """Of the smoothed map of ``seq`` less that of ``reference``: name, n, total (half the sum), rmsd, low, high, mean_abs, changed (share over 0.01 in absolute value), profile (means of the rows).

    Only rows and columns near changed places differ from 0, and by symmetry the rows are enough; they are made some at
    a time and reduced at once. Raises where lengths differ. Energies are negative where residues attract each other, so
    a positive difference is a weaker variant.
    """
    w, m = gaussian_weights(sigma), np.array(matrix)

    def measure(seq: str, reference: str) -> tuple:
        new, old = _numbered(seq), _numbered(reference)
        if len(new) != len(old):
            raise ValueError("maps of different size")
        n, at = len(new), changed_places(new, old, w)
        low, high = (0.0, 0.0) if len(at) < n else (np.inf, -np.inf)
        total = squares = absolute = over = 0.0
        twice = np.full(n, 2.0)
        twice[at] = 1.0  # a row that isn't changed has only the changed columns
        for a, b in _parts(n) if len(at) else ():
            right_new = soft_rows(new, w, a, b).T
            right_old, own = right_new.copy(), at[np.searchsorted(at, a) : np.searchsorted(at, b)]
            if len(own):  # elsewhere both are alike
                first, last = int(own[0]), int(own[-1]) + 1
                right_old[:, first - a : last - a] = soft_rows(old, w, first, last).T
            step = max(1, CELLS // (b - a))
            for k in range(0, len(at), step):
                rows = at[k : k + step]
                first, last = int(rows[0]), int(rows[-1]) + 1
                if last - first <= 4 * len(rows):
                    s_new, s_old = soft_rows(new, w, first, last)[rows - first], soft_rows(old, w, first, last)[rows - first]
                else:
                    s_new, s_old = (np.vstack([soft_rows(x, w, int(i), int(i) + 1) for i in rows]) for x in (new, old))
                e = (s_new @ m) @ right_new - (s_old @ m) @ right_old
                size, weight = np.abs(e), twice[a:b]
                total += float((e @ weight).sum())
                squares += float((np.square(e) @ weight).sum())
                absolute += float((size @ weight).sum())
                over += float(((size > 0.01) @ weight).sum())
                low, high = min(low, float(e.min())), max(high, float(e.max()))
        t_new, t_old = (np.bincount(x, minlength=len(ALPHABET)) for x in (new, old))
        profile = smooth((m @ t_new / n)[new], w) - smooth((m @ t_old / n)[old], w)
        return n, total / 2, math.sqrt(squares / n**2), low, high, absolute / n**2, over / n**2, profile

    names = {"n": int, "total": float, "rmsd": float, "low": float, "high": float, "mean_abs": float, "changed": float, "profile": list}
    return _per_sequence(df, ["seq", "reference"], names, measure)


def top_places(df: DataFrame, n: int = 10) -> DataFrame:
    """name, rank, i, v: the n places whose ``profile`` is largest in absolute value, ties by the later place."""
    order = F.array_sort(F.transform("profile", lambda v, i: F.struct((-F.round(F.abs(v), 12)).alias("by"), (-i).alias("at"), v.alias("v"))))
    x = df.select("name", F.posexplode(F.slice(order, 1, n)).alias("k", "x"))
    return x.select("name", (F.col("k") + 1).alias("rank"), (-F.col("x.at")).alias("i"), F.col("x.v").alias("v"))

"""Interaction maps. A map is kept by rows: name, n, idx (residue numbers), i, e (the row as an array).

Smoothing is linear and separable, so it is done on the residues' 20 columns before there are any pairs: no pass over
pairs, and nothing is shuffled until rows of a sequence are summed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyseq.functions.residues import ALPHABET, STICKERS
from polyseq.operators.sequences import let


def gaussian_weights(sigma: float, truncate: float = 4.0, radius: int | None = None) -> list[float]:
    """Normalised weights at -r to r, r = int(truncate * sigma + 0.5) unless given; one weight for sigma 0."""
    r = (int(truncate * sigma + 0.5) if radius is None else radius) if sigma > 0 else 0
    w = [math.exp(-0.5 * (d / sigma) ** 2) if d else 1.0 for d in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def uniform_weights(size: int) -> tuple[list[float], int]:
    """Weights of a sliding mean and the offset of the first; an even window looks one further to the left."""
    return [1.0 / size] * size, -(size // 2)


def _numbers(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def fold(x: Column, n: Column) -> Column:
    """Index reflected at the edges, half a sample beyond them, as often as needed: d c b a | a b c d | d c b a."""
    f = F.pmod(x, 2 * n)
    return F.when(f < n, f).otherwise(2 * n - 1 - f)


def smoothed(values: Column, n: Column, weights: list[float], first: int | None = None) -> Column:
    """An array of n numbers weighted over neighbours, with reflected edges."""
    if len(weights) == 1:
        return values
    first = -(len(weights) // 2) if first is None else first
    at = lambda v, w, j: F.aggregate(F.sequence(F.lit(0), F.lit(len(weights) - 1)), F.lit(0.0), lambda a, d: a + F.get(w, d) * F.get(v, fold(j + d + first, n)))
    return let(values, lambda v: let(_numbers(weights), lambda w: F.transform(F.sequence(F.lit(0), n - 1), lambda j: at(v, w, j))))


EDGES = ("reflect", "clamp")


def _soft_composition(idx: np.ndarray, weights: list[float], edges: str = "reflect") -> np.ndarray:
    """For each position the weights of the 20 residues around it; beyond the edges the sequence is reflected, or its first and last residue go on (clamp)."""
    n, at = len(idx), np.arange(len(idx))
    out = np.zeros((n, len(ALPHABET)))
    for d, w in enumerate(weights, -(len(weights) // 2)):
        f = (at + d) % (2 * n)
        near = np.where(f < n, f, 2 * n - 1 - f) if edges == "reflect" else np.clip(at + d, 0, n - 1)
        out[at, idx[near]] += w
    return out


_NUMBER = np.full(256, -1, np.int8)
_NUMBER[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
_STICKER = np.array([a in STICKERS for a in ALPHABET])


def _numbered(seq: str) -> np.ndarray:
    return _NUMBER[np.frombuffer(seq.encode(), np.uint8)]


def _scaling(blocks: Iterator[np.ndarray], method: str) -> tuple[float, float]:
    """What is taken off a map and what it is divided by, from one pass over its parts."""
    n, mean, squares, low, high = 0, 0.0, 0.0, np.inf, -np.inf
    for e in blocks:
        own, k = float(e.mean()), e.size
        squares += float(((e - own) ** 2).sum()) + (own - mean) ** 2 * n * k / (n + k)
        mean += (own - mean) * k / (n + k)
        n, low, high = n + k, min(low, float(e.min())), max(high, float(e.max()))
    return {"zscore": (mean, math.sqrt(squares / n)), "minmax": (low, high - low), "symmetric": (0.0, max(abs(low), abs(high)))}[method]


METHODS = ("energy", "zscore", "minmax", "symmetric")


def _spread(df: DataFrame, *columns: str) -> DataFrame:
    """Sequences dealt out while they are small: what is made of them is some thousand times as large."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    return df.select(*columns).repartition(n, "name")


def map_rows(df: DataFrame, matrix: list[list[float]], sigma: float = 2.0, sigma_j: float | None = None, mask: int | None = None, method: str = "energy", edges: str = "reflect") -> DataFrame:
    """The smoothed map (sigma 0: the raw one), a row for each position; sigma_j: another width along the rows.

    A map is S M T', S and T being the soft compositions by rows and by columns and M the energies; it is made and
    sent on some rows at a time, so a long sequence needs no more room than those and its compositions.

    mask: the band around the diagonal that is set to 0. method: zscore (population), minmax, symmetric (by the largest
    absolute value) or energy (as it is), after masking; a flat map becomes zeros. edges: reflect, with weights within
    four sigma, or clamp, where the outermost residues go on and weights reach up to three sigma. Maps that are normalised are made
    twice, once for what they are scaled by, so that no map is shuffled.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    if edges not in EDGES:
        raise ValueError(f"unknown edges {edges}")
    wi, wj = (gaussian_weights(s, radius=math.ceil(3 * s) if edges == "clamp" else None) for s in (sigma, sigma if sigma_j is None else sigma_j))
    m = np.array(matrix)
    name_type = df.schema["name"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, seq in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                idx = _numbered(seq)
                left, right = _soft_composition(idx, wi, edges) @ m, _soft_composition(idx, wj, edges).T
                n, step = len(idx), max(1, 1_000_000 // max(len(idx), 1))

                def block(k: int, left=left, right=right, n=n, step=step) -> np.ndarray:
                    e = left[k : k + step] @ right
                    if mask is not None:
                        e[np.abs(np.arange(k, k + len(e))[:, None] - np.arange(n)) <= mask] = 0.0
                    return e

                starts = range(0, n, step)
                shift, scale = _scaling(map(block, starts), method) if method != "energy" and n else (0.0, 1.0)
                for k in starts:
                    e = block(k)
                    if method != "energy":
                        e = (e - shift) / scale if scale >= 1e-10 else np.zeros_like(e)
                    offsets = pa.array(np.arange(len(e) + 1, dtype=np.int32) * n)
                    yield pa.record_batch({
                        "name": pa.array([name.as_py()] * len(e), name.type), "n": pa.array(np.full(len(e), n, np.int32)), "idx": pa.ListArray.from_arrays(offsets, pa.array(np.tile(idx, len(e)))),
                        "i": pa.array(np.arange(k, k + len(e), dtype=np.int32)), "e": pa.ListArray.from_arrays(offsets, pa.array(e.ravel())),
                    })

    return _spread(df, "name", "seq").mapInArrow(run, f"name {name_type.simpleString()}, n int, idx array<tinyint>, i int, e array<double>")


def pairs(rows: DataFrame) -> DataFrame:
    """name, n, i, j, e: a row for each pair of positions."""
    return rows.select("name", "n", "i", F.posexplode_outer("e").alias("j", "e")).filter("j is not null")


def masked(rows: DataFrame, width: int = 5, fill: float = 0.0) -> DataFrame:
    """The map with the band around its diagonal filled."""
    return rows.withColumn("e", F.transform("e", lambda e, j: F.when(F.abs(F.col("i") - j) <= width, fill).otherwise(e)))


def _sum(f=lambda x: x) -> Column:
    return F.aggregate("e", F.lit(0.0), lambda a, x: a + f(x))


def map_statistics(rows: DataFrame) -> DataFrame:
    """name, mean, std, low, high, off_diagonal_mean, total, n_attractive, n_repulsive, attractive_fraction.

    Each row of a map becomes its sum, its variance and its extremes before anything moves.
    """
    n2 = F.max(F.col("n") * F.col("n")).cast("double")
    x = rows.select("name", "n", _sum().alias("s"), F.array_min("e").alias("lo"), F.array_max("e").alias("hi"), F.get("e", F.col("i")).alias("own"), *[F.size(F.filter("e", f)).alias(k) for k, f in (("neg", lambda v: v < 0), ("pos", lambda v: v > 0))], "e")
    x = x.withColumn("m", F.col("s") / F.col("n")).withColumn("v", _sum(lambda v: F.pow(v - F.col("m"), 2)) / F.col("n")).drop("e")
    neg = F.sum("neg").cast("long")
    return x.groupBy("name").agg(
        (F.sum("s") / n2).alias("mean"), F.sqrt(F.avg("v") + F.var_pop("m")).alias("std"), F.min("lo").alias("low"), F.max("hi").alias("high"),
        F.when(F.max("n") > 1, (F.sum("s") - F.sum("own")) / (n2 - F.max("n"))).otherwise(0.0).alias("off_diagonal_mean"), F.sum("s").alias("total"),
        neg.alias("n_attractive"), F.sum("pos").cast("long").alias("n_repulsive"), (neg / n2).alias("attractive_fraction"),
    )


def row_slices(rows: DataFrame, at: Column) -> DataFrame:
    """name, k, i, by_row, by_column: the values of row k and of column k of each map; ``at`` is the 0-based k, from the columns of ``rows``."""
    x = rows.withColumn("k", at)
    down = x.select("name", "k", "i", F.get("e", F.col("k")).alias("by_column"))
    along = x.filter(F.col("i") == F.col("k")).select("name", F.posexplode("e").alias("i", "by_row"))
    return down.join(along, ["name", "i"]).select("name", "k", "i", "by_row", "by_column")


def profile(rows: DataFrame) -> DataFrame:
    """name, n, i, v: the mean of each row."""
    return rows.select("name", "n", "i", (_sum() / F.col("n")).alias("v"))


def profile_array(rows: DataFrame) -> DataFrame:
    """name, n, p: the profile of a sequence as one array."""
    return profile(rows).groupBy("name", "n").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("p")).select("name", "n", F.transform("p", lambda x: x["v"]).alias("p"))


def smoothed_profile(rows: DataFrame, window: int = 5, method: str = "gaussian") -> DataFrame:
    """name, i, v: the profile smoothed once more; the window is the sigma of a gaussian, or the size of a sliding mean."""
    weights, first = (gaussian_weights(window), None) if method == "gaussian" else uniform_weights(window)
    x = profile_array(rows)
    x = x.select("name", smoothed(F.col("p"), F.col("n"), weights, first).alias("v"))
    return x.select("name", F.posexplode_outer("v").alias("i", "v"))


def local_density(rows: DataFrame, window: int = 10) -> DataFrame:
    """name, c, density: the mean of the square block around each place of the diagonal, cut at the edges."""
    low, high = F.greatest(F.col("i") - window, F.lit(0)), F.least(F.col("i") + window, F.col("n") - 1)
    x = rows.select("name", "n", "e", F.explode(F.sequence(low, high)).alias("c"))
    start = F.greatest(F.col("c") - window, F.lit(0))
    part = F.slice("e", start + 1, F.least(F.col("c") + window, F.col("n") - 1) - start + 1)
    x = x.select("name", "c", F.aggregate(part, F.lit(0.0), lambda a, v: a + v).alias("s"), F.size(part).alias("k"))
    return x.groupBy("name", "c").agg((F.sum("s") / F.sum("k")).alias("density"))


def contact_counts(rows: DataFrame, threshold: float = -0.2, mode: str = "attractive") -> DataFrame:
    """name, i, contacts: places of a row beyond the threshold - below, above, or in absolute value."""
    test = {"attractive": lambda v: v < threshold, "repulsive": lambda v: v > threshold, "both": lambda v: F.abs(v) > abs(threshold)}
    if mode not in test:
        raise ValueError(f"unknown mode {mode}")
    return rows.select("name", "i", F.size(F.filter("e", test[mode])).cast("long").alias("contacts"))


def differences(variant: DataFrame, reference: DataFrame) -> DataFrame:
    """The map of ``variant`` less that of ``reference``, joined on name and i; raises where the lengths differ.

    Energies are negative where residues attract each other, so a positive difference is a weaker variant.
    """
    r = reference.select("name", "i", F.col("e").alias("f"))
    e = F.when(F.size("e") == F.size("f"), F.zip_with("e", "f", lambda a, b: a - b)).otherwise(F.raise_error(F.lit("maps of different size")))
    return variant.join(r, ["name", "i"]).select("name", "n", "idx", "i", e.alias("e"))


def perturbation(rows: DataFrame) -> DataFrame:
    """name, total (half the sum), rmsd, low, high, mean_abs, changed (share over 0.01 in absolute value) of a difference."""
    n2 = F.max(F.col("n") * F.col("n")).cast("double")
    return rows.groupBy("name").agg(
        (F.sum(_sum()) / 2).alias("total"), F.sqrt(F.sum(_sum(lambda v: v * v)) / n2).alias("rmsd"), F.min(F.array_min("e")).alias("low"), F.max(F.array_max("e")).alias("high"),
        (F.sum(_sum(F.abs)) / n2).alias("mean_abs"), (F.sum(F.size(F.filter("e", lambda v: F.abs(v) > 0.01))) / n2).alias("changed"),
    )


def is_sticker(idx: Column) -> Column:
    return idx.isin(*[ALPHABET.index(a) for a in STICKERS])


def partitioned_energies(rows: DataFrame) -> DataFrame:
    """name, ss, ll, cross: mean energy of pairs by class of both ends, diagonal included; 0 for an empty class."""
    own = is_sticker(F.get("idx", F.col("i")))
    side = lambda s: F.aggregate(F.zip_with("e", "idx", lambda e, a: F.when(is_sticker(a) == s, e).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v)
    x = rows.select("name", "n", own.alias("own"), side(True).alias("s"), side(False).alias("l"))
    a = x.groupBy("name").agg(F.max("n").cast("double").alias("n"), F.sum(F.col("own").cast("double")).alias("k"), *[F.sum(F.when(F.col("own") == o, F.col(c)).otherwise(0.0)).alias(k) for k, o, c in (("ss", True, "s"), ("sl", True, "l"), ("ls", False, "s"), ("ll", False, "l"))])
    other = F.col("n") - F.col("k")
    mean = lambda total, count: F.when(count > 0, total / count).otherwise(0.0)
    return a.select("name", mean(F.col("ss"), F.col("k") * F.col("k")).alias("ss"), mean(F.col("ll"), other * other).alias("ll"), mean(F.col("sl") + F.col("ls"), 2 * F.col("k") * other).alias("cross"))


def top_perturbed(rows: DataFrame, n: int = 10) -> DataFrame:
    """name, rank, i, v: the n places of each sequence whose profile is largest in absolute value, ties by the later place."""
    own = Window.partitionBy("name").orderBy(F.desc(F.round(F.abs("v"), 12)), F.desc("i"))
    return profile(rows).withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= n).select("name", "rank", "i", "v")


def stickers_by_energy(p: DataFrame, threshold: float = -0.3) -> DataFrame:
    """The places of a profile (name, i, v) below a threshold."""
    return p.filter(F.col("v") < threshold)


def stickers_by_percentile(p: DataFrame, share: float = 0.25) -> DataFrame:
    """The places of a profile at or below a quantile of its sequence."""
    t = p.groupBy("name").agg(F.percentile("v", F.lit(share)).alias("t"))
    return p.join(t, "name").filter(F.col("v") <= F.col("t")).drop("t")


def stickers_hybrid(rows: DataFrame, threshold: float = -0.2) -> DataFrame:
    """name, i, v: stickers by chemistry whose profile is below a threshold."""
    own = rows.filter(is_sticker(F.get("idx", F.col("i"))))
    return stickers_by_energy(profile(own), threshold).select("name", "i", "v")


def delta_g(rows: DataFrame, w_ss: float = 2.0, w_ll: float = 0.5, w_cross: float = 1.0) -> DataFrame:
    """name, ss, ll, cross, delta_g: the weighted sum of the partitioned energies."""
    return partitioned_energies(rows).withColumn("delta_g", w_ss * F.col("ss") + w_ll * F.col("ll") + w_cross * F.col("cross"))


def total_energy(rows: DataFrame) -> DataFrame:
    """name, total, mean: over pairs i < j; the mean is 0 without any."""
    above = F.aggregate(F.slice("e", F.col("i") + 2, F.col("n")), F.lit(0.0), lambda a, v: a + v)
    x = rows.groupBy("name").agg(F.sum(above).alias("total"), F.max("n").alias("n"))
    return x.select("name", "total", F.when(F.col("n") > 1, F.col("total") / (F.col("n") * (F.col("n") - 1) / 2)).otherwise(0.0).alias("mean"))


def chain_energy(rows: DataFrame, separation: int = 4) -> DataFrame:
    """name, energy: over pairs of the raw map at least ``separation`` apart."""
    far = F.aggregate(F.slice("e", F.col("i") + 1 + separation, F.col("n")), F.lit(0.0), lambda a, v: a + v)
    return rows.groupBy("name").agg(F.sum(far).alias("energy"))


def chain_gradient(rows: DataFrame, separation: int = 4) -> DataFrame:
    """name, i, gradient: for each sticker, the energies of its row at least ``separation`` away."""
    far = F.aggregate(F.transform("e", lambda e, j: F.when(F.abs(F.col("i") - j) >= separation, e).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v)
    return rows.filter(is_sticker(F.get("idx", F.col("i")))).select("name", "i", far.alias("gradient"))


def contact_energy(rows: DataFrame, persistence: float = 5.0) -> DataFrame:
    """name, energy: pairs i < j of the raw map, weighted by (d / persistence) ** -1.5, and not at all under d = 3."""
    weighted = F.aggregate(F.transform("e", lambda e, j: F.when(j - F.col("i") >= 3, e * F.pow((j - F.col("i")) / persistence, -1.5)).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v)
    return rows.groupBy("name").agg(F.sum(weighted).alias("energy"))


def energy_by_separation(rows: DataFrame) -> DataFrame:
    """name, d, energy: the sum over pairs j - i = d, d > 0."""
    x = rows.select("name", "i", F.posexplode_outer("e").alias("j", "e")).filter("j > i")
    return x.groupBy("name", (F.col("j") - F.col("i")).alias("d")).agg(F.sum("e").alias("energy"))


def contacts(rows: DataFrame, threshold: float = -0.2, mode: str = "attractive") -> DataFrame:
    """name, i, j of the pairs i <= j of a contact map: below the threshold, above it, or beyond it in absolute value."""
    test = {"attractive": F.col("e") < threshold, "repulsive": F.col("e") > threshold, "both": F.abs("e") > abs(threshold)}
    if mode not in test:
        raise ValueError(f"unknown mode {mode}")
    return pairs(rows).filter(test[mode] & (F.col("j") >= F.col("i"))).select("name", "i", "j")


def all_differences(rows: DataFrame, of: str, variant: str, reference: str) -> DataFrame:
    """The map of every variant but ``reference`` less that of ``reference``, by the columns ``of`` (what varies) and ``variant``.

    Raises where lengths differ. Sequences without the reference give no rows.
    """
    own = rows.filter(F.col(variant) == reference).select(of, "i", F.col("e").alias("f"))
    e = F.when(F.size("e") == F.size("f"), F.zip_with("e", "f", lambda a, b: a - b)).otherwise(F.raise_error(F.lit("maps of different size")))
    return rows.filter(F.col(variant) != reference).join(own, [of, "i"]).withColumn("e", e).drop("f")


def value_bags(rows: DataFrame) -> DataFrame:
    """name, pair_class (ss, ll or cross), e: each value of the map with the class of its pair, both orders and the diagonal included."""
    own = is_sticker(F.get("idx", F.col("i")))
    other = is_sticker(F.get("idx", F.col("j")))
    x = rows.select("name", "i", "idx", F.posexplode_outer("e").alias("j", "e")).filter("j is not null")
    return x.select("name", F.when(own & other, "ss").when(~own & ~other, "ll").otherwise("cross").alias("pair_class"), "e")


def masks(rows: DataFrame) -> DataFrame:
    """name, i and, as arrays over j, which pairs are sticker-sticker, linker-linker and cross."""
    own = is_sticker(F.get("idx", F.col("i")))
    of = lambda f: F.transform("idx", lambda a: f(is_sticker(a)))
    return rows.select("name", "i", of(lambda a: own & a).alias("ss"), of(lambda a: ~own & ~a).alias("ll"), of(lambda a: own != a).alias("cross"))


def criteria_overlap(rows: DataFrame, threshold: float = -0.3, share: float = 0.25) -> DataFrame:
    """name and how many places are stickers by chemistry, by the energy of their profile, by its quantile, by two of these and by all."""
    p = rows.select("name", "i", is_sticker(F.get("idx", F.col("i"))).alias("a"), (_sum() / F.col("n")).alias("v"))
    limit = p.groupBy("name").agg(F.percentile("v", F.lit(share)).alias("t"))
    x = p.join(limit, "name").select("name", "a", (F.col("v") < threshold).alias("b"), (F.col("v") <= F.col("t") + 1e-12).alias("c"))
    both = {"chemistry": "a", "energy": "b", "percentile": "c", "chemistry_energy": "a and b", "chemistry_percentile": "a and c", "energy_percentile": "b and c", "all_three": "a and b and c"}
    return x.groupBy("name").agg(*[F.count_if(F.expr(test)).alias(k) for k, test in both.items()])

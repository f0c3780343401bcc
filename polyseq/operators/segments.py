"""Stickers and linkers: masks by chemistry, runs, spacings, chains and their entropies; per sequence, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyseq.functions.residues import ALPHABET, STICKERS
from polyseq.operators.sequences import blocks, count_of, counted, flat_parts, let, letters, linker_lengths, mean_std, positions, total, with_counts


def sticker_mask(df: DataFrame) -> DataFrame:
    """name, n, n_stickers, n_linker_residues, sticker_fraction."""
    k = count_of(F.col("seq"), STICKERS)
    return df.select("name", F.length("seq").cast("long").alias("n"), k.alias("n_stickers"), (F.length("seq") - k).cast("long").alias("n_linker_residues"), (k / F.length("seq")).alias("sticker_fraction"))


def segments(df: DataFrame) -> DataFrame:
    """name, seg, kind, start, end (half-open), seq: the chain of stickers and linkers."""
    inside = lambda a: a.isin(*STICKERS)
    first = lambda all_, a, i: F.when((i == 0) | (inside(a) != inside(F.get(all_, i - 1))), i)
    starts = let(letters(F.col("seq")), lambda x: F.array_compact(F.transform(x, lambda a, i: first(x, a, i))))
    x = df.select("name", F.posexplode_outer(F.arrays_zip(starts.alias("start"), blocks(F.col("seq")).alias("part"))).alias("seg", "x")).select("name", "seg", "x.start", "x.part")
    kind = F.when(inside(F.substring("part", 1, 1)), "sticker").otherwise("linker")
    return x.select("name", "seg", kind.alias("kind"), "start", (F.col("start") + F.length("part")).alias("end"), F.col("part").alias("seq"))


def regions(df: DataFrame, min_length: int = 1) -> DataFrame:
    """name, n_regions, longest, n_residues of the sticker runs of at least ``min_length``."""
    runs = F.filter(F.transform(F.regexp_extract_all("seq", F.lit(f"[{STICKERS}]+"), F.lit(0)), F.length), lambda k: k >= min_length)
    return df.select("name", F.size(runs).cast("long").alias("n_regions"), F.coalesce(F.array_max(runs), F.lit(0)).cast("long").alias("longest"), total(runs).cast("long").alias("n_residues"))


def chain_string(seq: Column) -> Column:
    """S(3)-L(5)-S(1) and so on."""
    piece = lambda b: F.concat(F.when(F.substring(b, 1, 1).isin(*STICKERS), "S(").otherwise("L("), F.length(b).cast("string"), F.lit(")"))
    return F.array_join(F.transform(blocks(seq), piece), "-")


def linker_statistics(df: DataFrame) -> DataFrame:
    """name, n_gaps, mean, std, shortest, longest, total, kappa of the linkers between stickers.

    Zeros without any. kappa is mean over standard deviation: NaN with fewer than two, infinite if all are alike.
    """
    x = df.select("name", linker_lengths(F.col("seq")).alias("gaps"))
    mean, std = mean_std(F.col("gaps"))
    kappa = F.when(F.size("gaps") < 2, float("nan")).when(std < 1e-10, float("inf")).otherwise(mean / std)
    return x.select(
        "name", F.size("gaps").cast("long").alias("n_gaps"), F.coalesce(mean, F.lit(0.0)).alias("mean_length"), F.coalesce(std, F.lit(0.0)).alias("std_length"),
        F.coalesce(F.array_min("gaps"), F.lit(0)).cast("long").alias("shortest"), F.coalesce(F.array_max("gaps"), F.lit(0)).cast("long").alias("longest"), total(F.col("gaps")).cast("long").alias("total_length"), kappa.alias("kappa"),
    )


def spacings(df: DataFrame) -> DataFrame:
    """name, n_stickers, gaps between neighbouring stickers as an array."""
    x = df.select("name", positions(F.col("seq"), STICKERS).alias("at"))
    gaps = F.zip_with(F.slice("at", F.lit(2), F.size("at")), F.slice("at", F.lit(1), F.greatest(F.size("at") - 1, F.lit(0))), lambda b, a: b - a)
    return x.select("name", F.size("at").cast("long").alias("n_stickers"), F.when(F.size("at") > 1, gaps).otherwise(F.array().cast("array<int>")).alias("gaps"))


def omega(df: DataFrame) -> DataFrame:
    """name, omega: the coefficient of variation of the spacings; NaN with fewer than two stickers, 0 with two."""
    mean, std = mean_std(F.col("gaps"))
    return spacings(df).select("name", F.when(F.col("n_stickers") < 2, float("nan")).when(F.col("n_stickers") == 2, 0.0).otherwise(std / mean).alias("omega"))


def clustering(df: DataFrame, distance: int = 3) -> DataFrame:
    """name, clustering: the share of stickers with another within ``distance``; 0 with fewer than two."""
    near = F.transform("gaps", lambda g: g <= distance)
    x = spacings(df).select("name", "n_stickers", near.alias("near"))
    either = F.zip_with(F.concat("near", F.array(F.lit(False))), F.concat(F.array(F.lit(False)), "near"), lambda a, b: a | b)
    return x.select("name", F.when(F.col("n_stickers") < 2, 0.0).otherwise(F.size(F.filter(either, lambda e: e)) / F.col("n_stickers")).alias("clustering"))


def entropy(counts: Column) -> Column:
    """Shannon entropy of an array of counts, in bits; 0 if they sum to 0."""
    of = lambda c, n: F.when(n > 0, -total(F.filter(c, lambda x: x > 0), lambda x: x / n * F.log2(x / n)) + 0.0).otherwise(0.0)
    return let(counts, lambda c: let(total(c), lambda n: of(c, n)))


def spacing_entropy(df: DataFrame, bins: int = 10) -> DataFrame:
    """name, entropy, normalized: of a histogram of the spacings, ``bins`` equal ones over [1, largest + 1]."""
    bin_of = lambda g, top: F.least(F.floor((g - 1) / (top / float(bins))), F.lit(bins - 1))
    at = let(F.array_max("gaps"), lambda top: F.transform("gaps", lambda g: bin_of(g, top)))
    counts = let(at, lambda a: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(a, lambda x: x == b))))
    used = lambda c: F.size(F.filter(c, lambda x: x > 0))
    both = let(counts, lambda c: F.struct(entropy(c).alias("entropy"), used(c).alias("used")))
    x = spacings(df).select("name", both.alias("x"))
    return x.select("name", "x.entropy", F.when(F.col("x.used") > 1, F.col("x.entropy") / F.log2("x.used")).otherwise(0.0).alias("normalized"))


def block_entropy(df: DataFrame) -> DataFrame:
    """name, entropy: of the lengths of all runs, stickers' and linkers'; 0 with one run."""
    sizes = df.select("name", F.explode(blocks(F.col("seq"))).alias("b")).groupBy("name", F.length("b").alias("k")).agg(F.count(F.lit(1)).alias("c"))
    n = F.sum("c")
    # sum of -c/n log2(c/n) over lengths is log2(n) - sum(c log2 c)/n
    found = sizes.groupBy("name").agg(n.alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return found.select("name", (F.log2("n") - F.col("s") / F.col("n") + 0.0).alias("entropy"))


def composition_entropy(df: DataFrame) -> DataFrame:
    """name, entropy: of the kinds of residues among the stickers."""
    return with_counts(df).select("name", entropy(F.array(*[counted(a) for a in STICKERS])).alias("entropy"))


def sticker_pairs_by_separation(df: DataFrame, most: int = 30) -> DataFrame:
    """d, pairs: over all sequences, pairs of stickers whose positions differ by d, 0 < d < ``most``."""
    inside = np.zeros(256, bool)
    inside[np.frombuffer(STICKERS.encode(), np.uint8)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(most, np.int64)
        for batch in batches:
            for _, flat, sizes in flat_parts(batch.column(0)):
                apart = np.zeros(len(flat) + most * len(sizes), bool)  # no two sequences within reach of each other
                apart[np.arange(len(flat)) + most * np.repeat(np.arange(len(sizes)), sizes)] = inside[flat]
                found += [0, *(np.count_nonzero(apart[d:] & apart[:-d]) for d in range(1, most))]
        at = np.flatnonzero(found)
        yield pa.record_batch({"d": pa.array(at.astype(np.int32)), "pairs": pa.array(found[at])})

    return df.select("seq").mapInArrow(run, "d int, pairs long").groupBy("d").agg(F.sum("pairs").alias("pairs"))


def theta_sticker(df: DataFrame) -> DataFrame:
    """name, n_s, n_l, ss, ll, sl: stickers, linkers, and pairs of each kind."""
    s, n = count_of(F.col("seq"), STICKERS), F.length("seq").cast("long")
    x = df.select("name", s.alias("n_s"), (n - s).alias("n_l"))
    half = lambda c: F.expr(f"{c} * ({c} - 1) div 2")
    return x.select("*", half("n_s").alias("ss"), half("n_l").alias("ll"), (F.col("n_s") * F.col("n_l")).alias("sl"))


CLASSES = ("pipi", "catpi", "elec_att", "elec_rep", "hydro", "polar", "other")


def class_pairs() -> dict[str, list[tuple[str, str]]]:
    """The unordered pairs of residues of each of seven interaction classes; a pair is in the first that it fits."""
    aromatic, cation, anion, hydro, polar = "YFW", "RK", "DE", "AVLIMFW", "STNQCY"
    kinds = {}
    for i, a in enumerate(ALPHABET):
        for b in ALPHABET[i:]:
            both, one = (lambda s, a=a, b=b: a in s and b in s), (lambda s, t, a=a, b=b: (a in s and b in t) or (b in s and a in t))
            name = "pipi" if both(aromatic) else "catpi" if one(cation, aromatic) else "elec_att" if one(cation, anion) else "elec_rep" if both(cation) or both(anion) else "hydro" if both(hydro) else "polar" if both(polar) else "other"
            kinds.setdefault(name, []).append((a, b))
    return kinds


def theta_classes(df: DataFrame) -> DataFrame:
    """name and the pairs i < j in each of seven interaction classes."""
    kinds = class_pairs()
    c = {a: F.get("c", k).cast("double") for k, a in enumerate(ALPHABET)}
    x = with_counts(df)
    pairs = lambda ab: c[ab[0]] * (c[ab[0]] - 1) / 2 if ab[0] == ab[1] else c[ab[0]] * c[ab[1]]
    return x.select("name", *[sum((pairs(p) for p in kinds[k]), F.lit(0.0)).cast("long").alias(k) for k in CLASSES])


def uniform_energy(df: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """name, energy: the sum of pair energies over i < j, from the composition alone."""
    c = [F.get("c", k).cast("double") for k in range(len(ALPHABET))]
    x = with_counts(df)
    terms = [c[i] * (c[i] - 1) / 2 * matrix[i][i] if i == j else c[i] * c[j] * matrix[i][j] for i in range(20) for j in range(i, 20) if matrix[i][j]]
    return x.select("name", sum(terms[1:], terms[0]).alias("energy"))


def numeric_mask(seq: Column) -> Column:
    """1.0 for a sticker and 0.0 for another residue, as an array."""
    return F.transform(letters(seq), lambda a: F.when(a.isin(*STICKERS), 1.0).otherwise(0.0))

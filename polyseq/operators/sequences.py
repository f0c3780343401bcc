"""Per-sequence operators: columns of name, seq to columns, without moving a row.

Positions are 0-based unless a mutation code or a name says otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyseq.functions.residues import ALPHABET, ANIONIC, AROMATIC, CATIONIC, CHARGE, HYDROPHOBIC, KYTE_DOOLITTLE, POLAR, STICKERS


def count_of(seq: Column, residues: str) -> Column:
    """How many residues of the sequence are among ``residues``."""
    return (F.length(seq) - F.length(F.translate(seq, residues, ""))).cast("long")


def is_valid(text: Column) -> Column:
    """Whether each character is a residue, in either case; the empty text is valid."""
    return text.rlike(f"^[{ALPHABET}{ALPHABET.lower()}]*$")


def letters(seq: Column) -> Column:
    return F.split(seq, "")


def positions(seq: Column, residues: str) -> Column:
    """0-based positions of residues, ascending."""
    return F.array_compact(F.transform(letters(seq), lambda a, i: F.when(a.isin(*residues), i)))


def blocks(seq: Column, residues: str = STICKERS) -> Column:
    """The sequence cut into runs of residues within and without the set, in order."""
    return F.regexp_extract_all(seq, F.lit(f"[{residues}]+|[^{residues}]+"), F.lit(0))


def let(value: Column, f) -> Column:
    """f(value), the value being computed once, however often f or a lambda in it uses it."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), 0)


def total(values: Column, f=lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + f(x).cast("double"))


def mean_std(values: Column) -> tuple[Column, Column]:
    """Mean and population standard deviation of an array of whole numbers, whose sums are exact; null if it is empty."""
    n, s, s2 = F.size(values), total(values), total(values, lambda x: x * x)
    return F.when(n > 0, s / n), F.when(n > 0, F.sqrt(n * s2 - s * s) / n)


_CODE = np.zeros(256, np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
#: Bytes of sequences that are gone through together.
_CHUNK = 1 << 20


def flat_parts(seqs: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Some sequences at a time: the number of the first, their bytes end to end, and the size of each."""
    seqs = pa.array(seqs.cast(pa.large_string()))
    ends = np.frombuffer(seqs.buffers()[1], np.int64, len(seqs) + seqs.offset + 1)[seqs.offset :]
    data = seqs.buffers()[2]
    flat, at = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), 0
    while at < len(seqs):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + _CHUNK, side="right")) - 1)
        yield at, flat[ends[at] : ends[to]], np.diff(ends[at : to + 1])
        at = to


def linker_lengths(seq: Column, residues: str = STICKERS) -> Column:
    """Lengths of the runs between stickers, from one pass over the sequence; what stands before the first or after the last doesn't count."""
    among = np.isin(np.arange(256), list(residues.encode()))

    @F.arrow_udf("array<int>")
    def gaps(seqs: pa.Array) -> pa.Array:
        found, counts = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        for _, flat, sizes in flat_parts(seqs):
            at = np.flatnonzero(among[flat])
            owner = np.searchsorted(np.cumsum(sizes), at, side="right")
            gap = np.diff(at) - 1
            keep = (gap > 0) & (owner[1:] == owner[:-1])
            found.append(gap[keep])
            counts.append(np.bincount(owner[:-1][keep], minlength=len(sizes)))
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)).astype(np.int32)), pa.array(np.concatenate(found).astype(np.int32)))

    return gaps(seq)


def residue_counts(seq: Column) -> Column:
    """How often each residue of the alphabet occurs, as an array in its order, from one pass over the sequence."""

    @F.arrow_udf("array<long>")
    def counts(seqs: pa.Array) -> pa.Array:
        out, k = np.zeros((len(seqs), len(ALPHABET)), np.int64), len(ALPHABET)
        for at, flat, sizes in flat_parts(seqs):
            n = len(sizes)
            out[at : at + n] = np.bincount(np.repeat(np.arange(n) * k, sizes) + _CODE[flat], minlength=n * k).reshape(n, k)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * k), pa.array(out.ravel()))

    return counts(seq)


def with_counts(df: DataFrame) -> DataFrame:
    """name, seq, c: the counts of :func:`residue_counts`."""
    return df.select("name", "seq", residue_counts(F.col("seq")).alias("c"))


def counted(residues: str) -> Column:
    """How many residues are among ``residues``, from the column c."""
    parts = [F.get("c", ALPHABET.index(a)) for a in residues]
    return sum(parts[1:], parts[0])


def charge_metrics(df: DataFrame) -> DataFrame:
    """name, fcr, ncpr, hydropathy (Kyte-Doolittle mean)."""
    n, plus, minus = F.length("seq"), counted(CATIONIC), counted(ANIONIC)
    kd = sum((counted(a) * v for a, v in KYTE_DOOLITTLE.items()), F.lit(0.0))
    return with_counts(df).select("name", ((plus + minus) / n).alias("fcr"), ((plus - minus) / n).alias("ncpr"), (kd / n).alias("hydropathy"))


def sequence_properties(df: DataFrame) -> DataFrame:
    """name and twelve properties; mean_y_spacing is null with fewer than two Y."""
    seq, n_y = F.col("seq"), counted("Y")
    first, last = F.instr(seq, "Y"), F.length("seq") + 1 - F.instr(F.reverse("seq"), "Y")
    return with_counts(df).select(
        "name", F.length("seq").cast("long").alias("n"), n_y.alias("n_tyrosine"), *[counted(s).alias(k) for k, s in (("n_aromatic", AROMATIC), ("n_cationic", CATIONIC), ("n_anionic", ANIONIC), ("n_polar", POLAR), ("n_hydrophobic", HYDROPHOBIC))],
        (counted(CATIONIC) - counted(ANIONIC)).alias("net_charge"), (n_y / F.length("seq")).alias("tyrosine_fraction"), (counted(AROMATIC) / F.length("seq")).alias("aromatic_fraction"),
        F.when(n_y > 0, first - 1).cast("long").alias("first_y"), F.when(n_y > 1, (last - first) / (n_y - 1)).alias("mean_y_spacing"),
    )


def composition(df: DataFrame) -> DataFrame:
    """name, aa, n of the residues that occur."""
    rows = with_counts(df).select("name", F.posexplode("c").alias("k", "n")).filter("n > 0")
    return rows.select("name", F.substring(F.lit(ALPHABET), F.col("k") + 1, F.lit(1)).alias("aa"), "n")


def kappa_charge(df: DataFrame, window: int = 5) -> DataFrame:
    """name, kappa: mean over full windows of the squared net charge fraction, over FCR squared, at most 1; 0 for shorter sequences and without charges."""
    value = np.zeros(256, np.int64)
    for a, c in CHARGE.items():
        value[ord(a)] = c

    @F.arrow_udf("double")
    def kappa(seqs: pa.Array) -> pa.Array:
        out = np.zeros(len(seqs))
        for at, flat, sizes in flat_parts(seqs):
            q = value[flat]
            up_to, charged = (np.concatenate([[0], np.cumsum(x)]) for x in (q, np.abs(q)))
            ends = np.cumsum(sizes)
            sums = np.zeros(len(q) + 1, np.int64)
            sums[: len(q) - window + 1] = (up_to[window:] - up_to[:-window]) ** 2 if len(q) >= window else 0
            squares = np.concatenate([[0], np.cumsum(sums)])
            n_windows = np.maximum(sizes - window + 1, 0)
            delta = (squares[ends - sizes + n_windows] - squares[ends - sizes]) / window**2 / np.maximum(n_windows, 1)
            fcr = (charged[ends] - charged[ends - sizes]) / np.maximum(sizes, 1)
            out[at : at + len(sizes)] = np.where((n_windows > 0) & (fcr >= 1e-10), np.minimum(1.0, delta / (fcr * fcr + 1e-10)), 0.0)
        return pa.array(out)

    return df.select("name", kappa("seq").alias("kappa"))


def charge_decoration(df: DataFrame) -> DataFrame:
    """name, scd: the mean over residues of q_i q_j sqrt(j - i) over pairs i < j.

    Summed by separation: the correlation of the charges with themselves comes from their transform, exactly, as it
    is whole numbers, so a sequence of n residues costs n log n.
    """
    value = np.zeros(256)
    for a, c in CHARGE.items():
        value[ord(a)] = c

    @F.arrow_udf("double")
    def scd(seqs: pa.Array) -> pa.Array:
        out = []
        for s in seqs:
            q = value[np.frombuffer(s.as_py().encode(), np.uint8)]
            size = 1 << (2 * len(q)).bit_length()
            by_gap = np.rint(np.fft.irfft(np.abs(np.fft.rfft(q, size)) ** 2, size))[: len(q)]
            out.append(float((by_gap * np.sqrt(np.arange(len(q)))).sum() / len(q)))
        return pa.array(out, pa.float64())

    return df.select("name", scd("seq").alias("scd"))


def parse_mutation(code: Column, seq: Column) -> Column:
    """Struct of a code like Y143S: old, pos (1-based), new and status: ok, format, position, residue, range or mismatch."""
    old, new = F.upper(F.substring(code, 1, 1)), F.upper(F.substring(code, -1, 1))
    pos = F.substring(code, F.lit(2), F.length(code) - 2).try_cast("int")
    legal = lambda a: F.instr(F.lit(ALPHABET), a) > 0
    status = (
        F.when(F.length(code) < 3, "format").when(pos.isNull(), "position").when(~legal(old) | ~legal(new), "residue")
        .when((pos < 1) | (pos > F.length(seq)), "range").when(F.substring(seq, pos, F.lit(1)) != old, "mismatch").otherwise("ok")
    )
    return F.struct(old.alias("old"), pos.alias("pos"), new.alias("new"), status.alias("status"))


def residue_at(seq: Column, pos: Column) -> Column:
    """The residue at a 1-based position; null outside of the sequence."""
    return F.when((pos >= 1) & (pos <= F.length(seq)), F.substring(seq, pos, F.lit(1)))


def apply_mutation(seq: Column, pos: Column, new: Column) -> Column:
    """The sequence with the residue at a 1-based position replaced."""
    return F.overlay(seq, new, pos, F.lit(1))


def apply_mutations(seq: Column, changes: Column) -> Column:
    """All of an array of (pos, new) against the original at once; null if a position occurs twice."""
    by_pos = F.map_from_arrays(F.transform(changes, lambda c: c["pos"]), F.transform(changes, lambda c: c["new"]))
    once = F.size(F.array_distinct(F.transform(changes, lambda c: c["pos"]))) == F.size(changes)
    changed = let(by_pos, lambda m: F.array_join(F.transform(letters(seq), lambda a, i: F.coalesce(F.element_at(m, i + 1), a)), ""))
    return F.when(once, F.when(F.size(changes) == 0, seq).otherwise(changed))


def mutate_all(seq: Column, target: str, new: str, exclude: Column | None = None) -> tuple[Column, Column]:
    """Each ``target`` made ``new``, but at 1-based positions in ``exclude``; and the mutation codes in order."""
    at = F.transform(positions(seq, target), lambda i: i + 1)
    at = at if exclude is None else F.array_except(at, exclude)
    codes = F.transform(at, lambda p: F.concat(F.lit(target), p.cast("string"), F.lit(new)))
    if exclude is None:
        return F.translate(seq, target, new), codes
    keep = lambda a, i: F.when((a == target) & ~F.array_contains(exclude, i + 1), new).otherwise(a)
    return F.array_join(F.transform(letters(seq), keep), ""), codes


def fraction_mutated(df: DataFrame, fraction: float, target: str = "Y", new: str = "S") -> DataFrame:
    """name, n (how many changed), seq with the first of the targets replaced: the fraction, rounded half to even."""
    n = F.bround(F.lit(fraction) * count_of(F.col("seq"), target)).cast("int")
    x = df.select("name", "seq", n.alias("n"), positions(F.col("seq"), target).alias("at"))
    end = F.when(F.col("n") > 0, F.get("at", F.col("n") - 1) + 1).otherwise(0)  # up to here all are replaced
    changed = F.concat(F.translate(F.substring("seq", F.lit(1), end), target, new), F.substring(F.col("seq"), end + 1, F.length("seq")))
    return x.select("name", F.col("n").cast("long").alias("n"), changed.alias("seq"))


def single_site_variants(df: DataFrame, target: str = "Y", new: str = "S", count: int = 6) -> DataFrame:
    """name, pos (1-based), seq: one variant for each of ``count`` targets spread evenly over all."""
    x = df.select("name", "seq", positions(F.col("seq"), target).alias("at"))
    picks = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.floor(k * (F.size("at") - 1) / (count - 1)).cast("int")))
    rows = x.filter(F.size("at") > 0).select("name", "seq", F.explode(F.transform(picks, lambda k: F.get("at", k) + 1)).alias("pos"))
    return rows.select("name", "pos", apply_mutation(F.col("seq"), F.col("pos"), F.lit(new)).alias("seq"))


def clustered(seq: Column, target: str = "Y", filler: str = "G") -> Column:
    """Targets moved to the first fillers: all become fillers, then as many of the fillers, from the start, targets."""
    n = count_of(seq, target)
    plain = F.translate(seq, target, filler)
    at = F.get(positions(plain, filler), (n - 1).cast("int")) + 1
    return F.when(n == 0, seq).otherwise(F.concat(F.translate(F.substring(plain, F.lit(1), at), filler, target), F.substring(plain, at + 1, F.length(seq))))


def evenly_spaced(seq: Column, target: str = "Y", filler: str = "G") -> Column:
    """Targets become fillers, then the residues at n evenly spaced places become targets, whatever they were."""
    n, size = count_of(seq, target), F.length(seq)
    at = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: F.least(F.bround(k * size / n).cast("int"), size - 1))
    changed = let(at, lambda p: F.array_join(F.transform(letters(F.translate(seq, target, filler)), lambda a, i: F.when(F.array_contains(p, i), target).otherwise(a)), ""))
    return F.when(n == 0, seq).otherwise(changed)

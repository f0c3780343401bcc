"""Variant sets of the canonical sequence, and measured values."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyseq.operators import sequences
from polyseq.sources.feeds import registry


def measured(spark: SparkSession) -> DataFrame:
    """name, csat_um, csat_relative, phase_separates: fixed published values, null where not measured."""
    rows = [("WT", 2.0, 1.0, True), ("AllY_to_S", None, 50.0, False), ("AllY_to_F", 1.5, 0.75, True), ("9Y_to_S", None, 3.0, True), ("18Y_to_S", None, 10.0, True)]
    return spark.createDataFrame(rows, "name string, csat_um double, csat_relative double, phase_separates boolean")


def shuffles(spark: SparkSession, seq: str, n: int = 3, seed: int = 42) -> DataFrame:
    """name, seq: n shuffles, each from the sequence itself, of one stream of random numbers of the legacy generator."""
    random = np.random.RandomState(seed)
    rows = []
    for k in range(1, n + 1):
        letters = list(seq)
        random.shuffle(letters)
        rows.append((f"Shuffled_{k}", "".join(letters)))
    return spark.createDataFrame(rows, "name string, seq string")


def base_variants(df: DataFrame) -> DataFrame:
    """name, variant, ordinal, seq, mutations: of each sequence (name, seq) itself, its middle Y made S, and all Y made S, A or F.

    Without Y all are the sequence itself.
    """
    y = F.transform(sequences.positions(F.col("seq"), "Y"), lambda i: i + 1)
    middle = F.get("y", F.floor((F.size("y") - 1) / 2).cast("int"))
    x = df.select("name", "seq", y.alias("y")).withColumn("m", F.when(F.size("y") > 0, middle))
    codes = lambda new: F.transform("y", lambda p: F.concat(F.lit("Y"), p.cast("string"), F.lit(new)))
    one = F.when(F.col("m").isNotNull(), F.array(F.concat(F.lit("Y"), F.col("m").cast("string"), F.lit("S")))).otherwise(F.array().cast("array<string>"))
    changed = F.when(F.col("m").isNotNull(), sequences.apply_mutation(F.col("seq"), F.col("m"), F.lit("S"))).otherwise(F.col("seq"))
    row = lambda name, k, seq, mutations: F.struct(F.lit(name).alias("variant"), F.lit(k).alias("ordinal"), seq.alias("seq"), mutations.alias("mutations"))
    rows = [row("WT", 0, F.col("seq"), F.array().cast("array<string>")), row("MidY_to_S", 1, changed, one), *[row(f"AllY_to_{a}", k, F.translate("seq", "Y", a), codes(a)) for k, a in enumerate("SAF", 2)]]
    return x.select("name", F.explode(F.array(*rows)).alias("v")).select("name", "v.*")


def middle_changed(df: DataFrame, old: str = "Y", new: str = "S") -> DataFrame:
    """name, seq, reference: each sequence with its middle ``old`` made ``new``, as in :func:`base_variants`, beside itself; by string functions on the row, nothing is shuffled."""
    n = F.length("seq") - F.length(F.replace("seq", F.lit(old), F.lit("")))
    x = df.select("name", "seq", F.floor((n + 1) / 2).cast("int").alias("k"))
    before = F.length(F.expr(f"substring_index(seq, '{old}', k)"))
    changed = F.concat(F.substring("seq", F.lit(1), before), F.lit(new), F.substring("seq", before + 2, F.length("seq")))
    return x.select("name", F.when(F.col("k") > 0, changed).otherwise(F.col("seq")).alias("seq"), F.col("seq").alias("reference"))


def shuffled(df: DataFrame, n: int = 3, seed: int = 42) -> DataFrame:
    """name, k, seq: n shuffles of each sequence, the random numbers seeded by ``seed``, the sequence and k."""

    @F.arrow_udf("array<string>")
    def shuffle(seqs: pa.Array) -> pa.Array:
        out = []
        for s in seqs.to_pylist():
            letters = np.frombuffer(s.encode(), np.uint8)
            out.append([np.random.default_rng([seed, zlib.crc32(s.encode()), k]).permutation(letters).tobytes().decode() for k in range(1, n + 1)])
        return pa.array(out, pa.list_(pa.string()))

    return df.select("name", F.posexplode(shuffle("seq")).alias("k", "seq")).select("name", (F.col("k") + 1).alias("k"), "seq")


FAMILIES = ("single_site", "progressive", "shuffles", "charge", "blocks")


def expanded_registry(spark: SparkSession, include: tuple[str, ...] = FAMILIES) -> DataFrame:
    """name, seq, ordinal: base variants, single sites, progressive, shuffled, charge and block variants.

    A later variant of the same name takes an earlier one's place but keeps its ordinal. include: the families beside
    the base variants.
    """
    if not set(include) <= set(FAMILIES):
        raise ValueError(f"families are {FAMILIES}")
    base = registry(spark).select("name", F.col("sequence").alias("seq"), F.lit(0).alias("source"), F.col("ordinal").cast("double").alias("k"))
    wt = base.filter("name = 'WT'").select("name", "seq")
    code = lambda old, new: F.concat(F.lit(old), F.col("pos").cast("string"), F.lit(new))
    parts = [base, sequences.single_site_variants(wt).select(code("Y", "S").alias("name"), "seq", F.lit(1).alias("source"), F.col("pos").cast("double").alias("k"))]
    parts += [sequences.fraction_mutated(wt, f).select(F.concat(F.col("n").cast("string"), F.lit("Y_to_S")).alias("name"), "seq", F.lit(2).alias("source"), F.lit(f).alias("k")) for f in (0.25, 0.5, 0.75)]
    text = wt.first().seq
    parts.append(shuffles(spark, text).select("name", "seq", F.lit(3).alias("source"), F.substring("name", 10, 9).cast("double").alias("k")))
    parts += [wt.select(F.lit(f"R213{a}").alias("name"), sequences.apply_mutation(F.col("seq"), F.lit(213), F.lit(a)).alias("seq"), F.lit(4).alias("source"), F.lit(float(k)).alias("k")) for k, a in enumerate("QK")]
    parts += [wt.select(F.lit(name).alias("name"), f(F.col("seq")).alias("seq"), F.lit(5).alias("source"), F.lit(float(k)).alias("k")) for k, (name, f) in enumerate((("Y_Clustered", sequences.clustered), ("Y_EvenSpaced", sequences.evenly_spaced)))]
    rows, kept = parts[0], {FAMILIES.index(f) + 1 for f in include}
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.filter(F.col("source").isin(0, *kept))
    own = Window.partitionBy("name").orderBy("source", "k")
    every = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select("name", F.last("seq").over(every).alias("seq"), F.first(F.struct("source", "k")).over(every).alias("at"), F.row_number().over(own).alias("r")).filter("r = 1")
    return rows.select("name", "seq", (F.count(F.lit(1)).over(Window.orderBy("at")) - 1).cast("int").alias("ordinal"))  # some twenty rows

"""Metrics of a variant joined into one row, and the effective energy built from them."""

from __future__ import annotations

from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyseq.operators import moments, networks, segments, sequences
from polyseq.sources.store import kept


@dataclass(frozen=True)
class Couplings:
    """Weights of the energy partition and of the topology terms."""

    w_ss: float = 2.0
    w_cross: float = 1.0
    w_ll: float = 0.5
    clustering: float = 0.05
    connectivity: float = 0.02
    percolation: float = 1.0
    arrangement: float = 0.02
    homology: float = 0.5


TERMS = ("e_ss", "e_cross", "e_ll", "phi_clustering", "phi_connectivity", "phi_percolation", "phi_arrangement", "phi_homology")


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities made null, as results have it."""
    return df.select(*[F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def topology_features(seqs: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """name and the graph features of the stickers, at the automatic threshold of each sequence."""
    limit = kept(networks.auto_threshold(seqs, matrix), "thresholds")
    h0 = networks.persistence_diagrams(seqs, matrix, loops=False).filter(F.col("death") < float("inf"))
    parts = [
        networks.clustering_coefficient(networks.neighbours(limit, matrix)), networks.path_statistics(networks.searches(limit, matrix)).select("name", "n_components", "path_length"),
        networks.percolation(networks.percolation_curve(seqs, matrix)), h0.groupBy("name").agg(F.sum("death").alias("h0_total")),
    ]
    out = limit.select("name", F.col("threshold").alias("auto_threshold"))
    for p in parts:
        out = out.join(p, "name", "left")
    return out.na.fill(0.0, ["clustering", "path_length", "threshold", "onset", "h0_total"]).na.fill(1, ["n_components"])


def topology_metrics(seqs: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """name and fourteen numbers: of the contact graph of all residues, of that of the stickers, of percolation and of betweenness; zeros without stickers."""
    limit = kept(networks.auto_threshold(seqs, matrix), "thresholds")
    full = networks.degree_statistics(networks.neighbours(limit, matrix, stickers=False, triangles=False)).select("name", F.col("n_edges").alias("n_contacts"), F.col("density").alias("graph_density"), "mean_degree", "max_degree")
    near, found = kept(networks.neighbours(limit, matrix), "neighbours"), kept(networks.searches(limit, matrix, flows=True), "searches")
    degree = networks.degree_statistics(near).select("name", F.col("n_edges").alias("sticker_n_contacts"), F.col("density").alias("sticker_graph_density"), F.col("mean_degree").alias("sticker_mean_degree"))
    closed = networks.clustering_coefficient(near).withColumnRenamed("clustering", "sticker_clustering_coefficient")
    paths = networks.path_statistics(found).select("name", F.col("path_length").alias("sticker_avg_path_length"), F.col("n_components").alias("sticker_n_components"))
    grown = networks.percolation(networks.percolation_curve(seqs, matrix)).select("name", F.col("threshold").alias("percolation_threshold"), F.col("onset").alias("giant_component_onset"))
    between = networks.betweenness(found).groupBy("name").agg(F.max("betweenness").alias("max_betweenness"), F.avg("betweenness").alias("mean_betweenness"))
    out = full
    for part in (degree, closed, paths, grown, between):
        out = out.join(part, "name", "left")
    return out.na.fill(0)


def entropy_metrics(seqs: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """name, spacing_entropy, normalized_spacing_entropy, block_entropy, interaction_entropy, composition_entropy."""
    out = segments.spacing_entropy(seqs).select("name", F.col("entropy").alias("spacing_entropy"), F.col("normalized").alias("normalized_spacing_entropy"))
    for part, name in ((segments.block_entropy(seqs), "block_entropy"), (networks.interaction_entropy(seqs, matrix), "interaction_entropy"), (segments.composition_entropy(seqs), "composition_entropy")):
        out = out.join(part.select("name", F.col("entropy").alias(name)), "name")
    return out


def variant_metrics(seqs: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """One wide row for each sequence, from name and seq; no map is made as a table."""
    out = segments.sticker_mask(seqs)
    energies = moments.linear_energies(seqs, matrix, want=("classes", "total"))
    energies = energies.select("name", F.col("total").alias("total_energy"), F.col("mean").alias("mean_energy"), "ss", "ll", "cross").withColumn("delta_g", 2.0 * F.col("ss") + 0.5 * F.col("ll") + F.col("cross"))
    for part in (
        sequences.charge_metrics(seqs), sequences.kappa_charge(seqs), segments.linker_statistics(seqs).select("name", "mean_length", F.col("kappa").alias("kappa_linker")), segments.omega(seqs),
        segments.spacing_entropy(seqs).select("name", F.col("entropy").alias("spacing_entropy"), F.col("normalized").alias("normalized_spacing_entropy")), segments.block_entropy(seqs).withColumnRenamed("entropy", "block_entropy"),
        segments.composition_entropy(seqs).withColumnRenamed("entropy", "composition_entropy"), energies, topology_features(seqs, matrix),
    ):
        out = out.join(part, "name")
    return out


def effective_energy(metrics: DataFrame, c: Couplings = Couplings()) -> DataFrame:
    """name, the eight terms, h_chemistry, h_topology, h_eff and topology_fraction, from :func:`variant_metrics`."""
    arrangement = F.col("normalized_spacing_entropy") + F.when(F.isnan("omega") | F.col("omega").isNull(), 1.0).otherwise(F.col("omega"))
    x = metrics.select(
        "name", (c.w_ss * F.col("ss")).alias("e_ss"), (c.w_cross * F.col("cross")).alias("e_cross"), (c.w_ll * F.col("ll")).alias("e_ll"), (-c.clustering * F.col("clustering")).alias("phi_clustering"),
        F.when(F.col("n_stickers") > 1, c.connectivity * (F.col("n_components") - 1) / (F.col("n_stickers") - 1)).otherwise(0.0).alias("phi_connectivity"), (c.percolation * F.col("threshold")).alias("phi_percolation"),
        (c.arrangement * arrangement).alias("phi_arrangement"), F.when(F.col("n_stickers") > 1, -c.homology * F.col("h0_total") / F.col("n_stickers")).otherwise(0.0).alias("phi_homology"),
    )
    chemistry, topology = sum(map(F.col, TERMS[1:3]), F.col(TERMS[0])), sum(map(F.col, TERMS[4:]), F.col(TERMS[3]))
    x = x.withColumns({"h_chemistry": chemistry, "h_topology": topology}).withColumn("h_eff", F.col("h_chemistry") + F.col("h_topology"))
    share = F.abs("h_topology") / (F.abs("h_chemistry") + F.abs("h_topology"))
    return x.withColumn("topology_fraction", F.when(F.abs("h_eff") < 1e-15, 0.0).otherwise(share))


def saturation(energies: DataFrame, reference: str | None = None, reference_h: float = -0.075, kt: float = 1.0, at_reference: float = 1.0) -> DataFrame:
    """name, c_sat: the reference's times exp((h_eff - its h_eff) / kt)."""
    if reference is None:
        return energies.select("name", (at_reference * F.exp((F.col("h_eff") - reference_h) / kt)).alias("c_sat"))
    own = energies.filter(F.col("name") == reference).select(F.col("h_eff").alias("h0"))
    return energies.join(F.broadcast(own), F.lit(True)).select("name", (at_reference * F.exp((F.col("h_eff") - F.col("h0")) / kt)).alias("c_sat"))


def sensitivity(energies: DataFrame) -> DataFrame:
    """term, sensitivity: the standard deviation of each term over all variants, over that of h_eff; 0 if the latter is tiny."""
    spread = energies.select(*[F.stddev_pop(t).alias(t) for t in (*TERMS, "h_eff")])
    rows = spread.select("h_eff", F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(t).alias("s")) for t in TERMS])).alias("x"))
    return rows.select("x.term", F.when(F.col("h_eff") < 1e-15, 0.0).otherwise(F.col("x.s") / F.col("h_eff")).alias("sensitivity"))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given that ``df`` doesn't have; Spark's names know no case."""
    taken, out = {c.lower() for c in df.columns}, []
    for x in names:
        while x.lower() in taken:
            x += "_"
        taken.add(x.lower())
        out.append(x)
    return out


def average_ranks(df: DataFrame, column: str, by: str) -> DataFrame:
    """The column by's rank from 1, equal values sharing their mean rank, as ``column``.

    Values are counted, the counts dealt out by ranges of values, and each range ranked by itself; what lies below it
    is added from the ranges' sums, of which there is a row for each partition.
    """
    n, part, within, off, value, total_, rank = free_names(df, "n", "part", "within", "off", "value", "total", "rank")
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias(n))
    ranged = counts.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), by).withColumn(part, F.spark_partition_id())
    own = Window.partitionBy(part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    below = ranged.withColumn(within, F.coalesce(F.sum(n).over(own), F.lit(0)))
    sums = ranged.groupBy(part).agg(F.sum(n).alias(total_))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(part, F.coalesce(F.sum(total_).over(before), F.lit(0)).alias(off))  # a row for each partition
    ranks = below.join(F.broadcast(offsets), part).select(F.col(by).alias(value), (F.col(off) + F.col(within) + (F.col(n) + 1) / 2).alias(rank))
    return df.join(ranks, F.col(by) == F.col(value)).withColumn(column, F.col(rank)).drop(value, rank)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """rho: the rank correlation of two whole-number columns over all rows, equal values at their mean rank; 0 if undefined."""
    ranked = average_ranks(average_ranks(df.select(x, y), "__rx", x), "__ry", y)
    rho = F.corr("__rx", "__ry")
    return ranked.agg(F.when(rho.isNull() | F.isnan(rho), 0.0).otherwise(rho).alias("rho"))


def decode(vector: list[float], base: Couplings = Couplings()) -> Couplings:
    """Couplings with the five topology weights of a vector."""
    return Couplings(*astuple(base)[:3], *vector)

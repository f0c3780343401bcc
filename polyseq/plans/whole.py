"""Queries over whole documents of what items have by maps: moments, sums by separation, local densities, differences and counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyseq.functions.residues import ALPHABET, FORCE_FIELD_SQL, RESIDUES_SQL, energy_matrix
from polyseq.operators import fitting, moments, networks, segments, sequences, variants
from polyseq.plans import extended
from polyseq.plans.catalog import _DOCS, _KIND, _r, _register
from polyseq.plans.extended import _GRAM
from polyseq.sources import feeds


@_register("map_moments_documents", f"""{_GRAM}
SELECT name, n::BIGINT AS n, {_r('t / (n * n)', 'mean')}, {_r('sqrt(greatest(q / (n * n) - (t / (n * n)) * (t / (n * n)), 0))', 'std')}, {_r('t', 'total')},
  CASE WHEN n > 1 THEN round((t - d) / (n * (n - 1)), 6) + 0.0 ELSE 0 END AS off_diagonal_mean FROM tm JOIN sq USING (name)""")  # fmt: skip
def map_moments_documents(spark, sf_dir):
    """Mean, standard deviation (so the scale of z-scores), total and mean off the diagonal of the map of each document."""
    return moments.map_moments(feeds.documents(spark, sf_dir), energy_matrix(spark)).select("name", "n", "mean", "std", "total", "off_diagonal_mean")


@_register("map_scales_documents")
def map_scales_documents(spark, sf_dir):
    """What the z-scores of each document's map, its band of five masked, are shifted and scaled by."""
    return moments.map_moments(feeds.documents(spark, sf_dir), energy_matrix(spark), mask=5).select("name", "shift", "scale")


@_register("chain_energy_documents", f"""{_DOCS}, {RESIDUES_SQL}, {FORCE_FIELD_SQL}, nc AS (SELECT name, aa, count(*) AS c FROM sites GROUP BY ALL),
al AS (SELECT a.name, sum(a.c * b.c * e) / 2 - sum(a.c * e) FILTER (a.aa = b.aa) / 2 AS t FROM nc a JOIN nc b ON b.name = a.name JOIN ff ON aa_i = a.aa AND aa_j = b.aa GROUP BY a.name),
nb AS (SELECT name, aa AS x, unnest([lead(aa, 1) OVER w, lead(aa, 2) OVER w, lead(aa, 3) OVER w]) AS y FROM sites WINDOW w AS (PARTITION BY name ORDER BY i)),
nr AS (SELECT name, sum(c * e) AS t FROM (SELECT name, x, y, count(*) AS c FROM nb GROUP BY ALL) JOIN ff ON aa_i = x AND aa_j = y GROUP BY name)
SELECT al.name, {_r('al.t - coalesce(nr.t, 0)', 'energy')} FROM al LEFT JOIN nr USING (name)""")  # fmt: skip
def chain_energy_documents(spark, sf_dir):
    """The raw energies of all pairs at least four apart, of whole documents: a sum over separations here, all pairs less near ones in SQL."""
    return moments.separation_energies(feeds.documents(spark, sf_dir), energy_matrix(spark), want=("chain",)).select("name", F.col("chain").alias("energy"))


@_register("contact_energy_documents")
def contact_energy_documents(spark, sf_dir):
    """Pair energies of whole documents weighted by contact probability; in SQL a document would be all its pairs."""
    return moments.separation_energies(feeds.documents(spark, sf_dir), energy_matrix(spark), want=("contact",)).select("name", F.col("contact").alias("energy"))


@_register("energy_by_sep_documents")
def energy_by_sep_documents(spark, sf_dir):
    """The sum of pair energies at each separation, of whole documents; in SQL a document would be all its pairs."""
    x = moments.separation_energies(feeds.documents(spark, sf_dir), energy_matrix(spark), want=("by_separation",))
    return x.select("name", F.posexplode("by_separation").alias("k", "energy")).select("name", (F.col("k") + 1).cast("long").alias("d"), "energy")


@_register("local_density_documents")
def local_density_documents(spark, sf_dir):
    """The mean energy of the block of 21 by 21 places around each place of whole documents."""
    x = moments.local_densities(feeds.documents(spark, sf_dir), energy_matrix(spark))
    return x.select("name", F.posexplode("density").alias("c", "density"))


@_register("diff_documents")
def diff_documents(spark, sf_dir):
    """What changing one tyrosine to serine does to the map of each document: only rows near it are made."""
    both = variants.middle_changed(feeds.documents(spark, sf_dir))
    return moments.map_differences(both, energy_matrix(spark)).drop("profile")


@_register("auto_threshold_documents")
def auto_threshold_documents(spark, sf_dir):
    """The quantile of the energies of all sticker pairs of each document; in SQL a document would be all its pairs."""
    return networks.auto_threshold(feeds.documents(spark, sf_dir), energy_matrix(spark)).drop("seq")


@_register("percolation_documents")
def percolation_documents(spark, sf_dir):
    """Where the stickers of each document come to hang together, by one spanning tree a document."""
    return networks.percolation(networks.percolation_curve(feeds.documents(spark, sf_dir), energy_matrix(spark)))


@_register("components_documents")
def components_documents(spark, sf_dir):
    """Sums and largest of the lifetimes of the components of each document's stickers."""
    x = networks.persistence_diagrams(feeds.documents(spark, sf_dir), energy_matrix(spark), loops=False)
    death = F.when(F.col("death") < float("inf"), F.col("death"))
    return x.groupBy("name").agg(F.count(F.lit(1)).alias("n_features"), F.coalesce(F.sum(death), F.lit(0.0)).alias("total"), F.coalesce(F.max(death), F.lit(0.0)).alias("longest"))


_COUNTS = f"{_DOCS}, nc AS (SELECT name, aa, count(*) AS c FROM sites GROUP BY ALL), pc AS (SELECT a.name, a.aa AS x, b.aa AS y, CASE WHEN a.aa = b.aa THEN a.c * (a.c - 1) // 2 ELSE a.c * b.c END AS c FROM nc a JOIN nc b ON b.name = a.name AND a.aa <= b.aa)"


@_register("energy_uniform_documents", f"{_COUNTS}, {RESIDUES_SQL}, {FORCE_FIELD_SQL} SELECT name, {_r('sum(c * e)', 'energy')} FROM pc JOIN ff ON aa_i = x AND aa_j = y GROUP BY name")
def energy_uniform_documents(spark, sf_dir):
    return segments.uniform_energy(feeds.documents(spark, sf_dir), energy_matrix(spark))


_CLASSES = ("pipi", "catpi", "elec_att", "elec_rep", "hydro", "polar", "other")


@_register("theta_classes_documents", f"{_COUNTS}, kd AS (SELECT name, c, {_KIND.replace('a.aa', 'x').replace('b.aa', 'y')} AS kind FROM pc) SELECT name, " + ", ".join(f"coalesce(sum(c) FILTER (kind = '{k}'), 0)::BIGINT AS {k}" for k in _CLASSES) + " FROM kd GROUP BY name")
def theta_classes_documents(spark, sf_dir):
    return segments.theta_classes(feeds.documents(spark, sf_dir))


@_register("theta_pairs_documents", f"{_COUNTS}, th AS (SELECT name, CASE WHEN x = y THEN 2 * c ELSE c END AS c FROM pc) SELECT name, sum(c)::DOUBLE AS total, max(c)::DOUBLE AS largest, count(*) FILTER (c > 0) AS used FROM th GROUP BY name")
def theta_pairs_documents(spark, sf_dir):
    x = fitting.pair_theta(feeds.documents(spark, sf_dir))
    return x.select("name", sequences.total(F.col("theta")).alias("total"), F.array_max("theta").alias("largest"), F.size(F.filter("theta", lambda t: t > 0)).cast("long").alias("used"))


@_register("pca_projections")
def pca_projections(spark, sf_dir):
    """The first three principal components of the residue fractions of each document."""
    x = fitting.composition_projections(feeds.documents(spark, sf_dir))
    return x.select("name", *[F.get("projection", k).alias(f"pc{k + 1}") for k in range(3)])


@_register("pca_loadings")
def pca_loadings(spark, sf_dir):
    """The residues' loadings on these components."""
    components = fitting.principal_components(feeds.documents(spark, sf_dir))
    rows = [(k, a, float(v)) for k, row in enumerate(components.loadings) for a, v in zip(ALPHABET, row, strict=True)]  # three times twenty
    return spark.createDataFrame(rows, "component int, aa string, loading double")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return extended.queries()


def oracle_sql() -> dict[str, str]:
    return extended.oracle_sql()

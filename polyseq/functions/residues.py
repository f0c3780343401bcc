"""Residue scales and the pair force field, as Spark tables and as SQL text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The alphabet, classes and scales that results depend on.
ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
AROMATIC, CATIONIC, ANIONIC, POLAR, HYDROPHOBIC = "YFW", "RK", "DE", "STNQC", "AVLIMPG"
STICKERS = AROMATIC + CATIONIC
HYDROPATHY = {"A": 0.17, "C": 0.24, "D": -0.78, "E": -0.64, "F": 0.61, "G": 0.01, "H": -0.40, "I": 0.73, "K": -1.10, "L": 0.53, "M": 0.26, "N": -0.60, "P": -0.07, "Q": -0.69, "R": -1.80, "S": -0.26, "T": -0.18, "V": 0.54, "W": 0.37, "Y": 0.02}
KYTE_DOOLITTLE = {"A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8, "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3}
CHARGE = {"D": -1, "E": -1, "K": 1, "R": 1}
AROMATICITY = {"F": 1.0, "H": 0.5, "W": 1.0, "Y": 0.9}
CATIONICITY = {"H": 0.3, "K": 1.0, "R": 1.0}


# The energies that results depend on.
@dataclass(frozen=True)
class ForceField:
    """Energies in kT."""

    aromatic: float = -0.65
    cation_pi: float = -0.50
    attractive: float = -0.30
    repulsive: float = 0.20
    hydrophobic: float = -0.15
    polar: float = -0.05
    glycine_factor: float = 0.3
    proline_penalty: float = 0.10


def residue_rows() -> list[tuple]:
    return [(a, k, HYDROPATHY[a], KYTE_DOOLITTLE[a], CHARGE.get(a, 0), AROMATICITY.get(a, 0.0), CATIONICITY.get(a, 0.0)) for k, a in enumerate(ALPHABET)]


def residues(spark: SparkSession) -> DataFrame:
    """aa, idx, hydropathy, kd, charge, arom, cation: 20 rows."""
    return spark.createDataFrame(residue_rows(), "aa string, idx int, hydropathy double, kd double, charge int, arom double, cation double")


def pair_energy(a, b, p: ForceField = ForceField()) -> dict[str, Column]:
    """Energy terms of residues given by the columns of two :func:`residues` tables, and their sum e.

    Glycine on either side scales the sum once, then proline adds its penalty once.
    """
    aromatic = a["arom"] * b["arom"] * p.aromatic
    cation_pi = (a["cation"] * b["arom"] + b["cation"] * a["arom"]) * p.cation_pi
    product = a["charge"] * b["charge"]
    electrostatic = F.when(product < 0, p.attractive).when(product > 0, p.repulsive).otherwise(0.0)
    hydrophobic = F.when((a["hydropathy"] > 0.2) & (b["hydropathy"] > 0.2), F.sqrt(a["hydropathy"] * b["hydropathy"]) * p.hydrophobic).otherwise(0.0)
    polar = F.when(a["aa"].isin(*"STNQ") & b["aa"].isin(*"STNQ"), p.polar).otherwise(0.0)
    either = lambda x: (a["aa"] == x) | (b["aa"] == x)
    e = (aromatic + cation_pi + electrostatic + hydrophobic + polar) * F.when(either("G"), p.glycine_factor).otherwise(1.0) + F.when(either("P"), p.proline_penalty).otherwise(0.0)
    return {"aromatic": aromatic, "cation_pi": cation_pi, "electrostatic": electrostatic, "e": e}


def force_field(spark: SparkSession, p: ForceField = ForceField()) -> DataFrame:
    """aa_i, aa_j, idx_i, idx_j, e and the pure terms: always 400 rows, to be broadcast."""
    a, b = residues(spark).alias("a"), residues(spark).alias("b")
    left, right = ({c: F.col(f"{s}.{c}") for c in a.columns} for s in "ab")
    terms = pair_energy(left, right, p)
    return a.join(b, F.lit(True)).select(left["aa"].alias("aa_i"), right["aa"].alias("aa_j"), left["idx"].alias("idx_i"), right["idx"].alias("idx_j"), *[x.alias(k) for k, x in terms.items()])


def energy_matrix(spark: SparkSession, p: ForceField = ForceField()) -> list[list[float]]:
    """The 20 x 20 energies in alphabet order, for literals in expressions."""
    rows = force_field(spark, p).orderBy("idx_i", "idx_j").select("e").collect()
    return [[r.e for r in rows[20 * k : 20 * k + 20]] for k in range(20)]


def most_attractive(ff: DataFrame, n: int = 10) -> DataFrame:
    """aa_i, aa_j, e of the n lowest energies, each unordered pair once; ties in alphabet order."""
    return ff.filter("idx_i <= idx_j").orderBy("e", "idx_i", "idx_j").limit(n).select("aa_i", "aa_j", "e")


def stickiness(ff: DataFrame) -> DataFrame:
    """aa, stickiness: the mean energy of a residue with all twenty."""
    return ff.groupBy(F.col("aa_i").alias("aa")).agg(F.avg("e").alias("stickiness"))


#: The same tables for DuckDB.
RESIDUES_SQL = "res(aa, idx, h, kd, q, ar, ca) AS (VALUES " + ", ".join(f"('{a}', {k}, {h}::DOUBLE, {kd}::DOUBLE, {q}, {ar}::DOUBLE, {ca}::DOUBLE)" for a, k, h, kd, q, ar, ca in residue_rows()) + ")"
def force_field_sql(p: ForceField = ForceField()) -> str:
    """The table ff of DuckDB, from the table res."""
    return f"""ff AS (SELECT a.aa AS aa_i, b.aa AS aa_j, a.idx AS idx_i, b.idx AS idx_j,
  (a.ar*b.ar*{p.aromatic}::DOUBLE + (a.ca*b.ar + b.ca*a.ar)*{p.cation_pi}::DOUBLE
   + CASE WHEN a.q*b.q < 0 THEN {p.attractive}::DOUBLE WHEN a.q*b.q > 0 THEN {p.repulsive}::DOUBLE ELSE 0 END
   + CASE WHEN a.h > 0.2 AND b.h > 0.2 THEN sqrt(a.h*b.h)*{p.hydrophobic}::DOUBLE ELSE 0 END
   + CASE WHEN a.aa IN ('S','T','N','Q') AND b.aa IN ('S','T','N','Q') THEN {p.polar}::DOUBLE ELSE 0 END)
   * CASE WHEN a.aa = 'G' OR b.aa = 'G' THEN {p.glycine_factor}::DOUBLE ELSE 1 END + CASE WHEN a.aa = 'P' OR b.aa = 'P' THEN {p.proline_penalty}::DOUBLE ELSE 0 END AS e
  FROM res a, res b)"""


FORCE_FIELD_SQL = force_field_sql()

"""Sequences from text tables and from files, and sinks for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyseq.functions.residues import ALPHABET

#: Fixed value: the canonical 214-residue sequence.
CANONICAL = (
    "MASNDYTQQATQSYGAYPTQPGQGYSQQSSQPYGQQSYSGYSQSTDTSGYGQSSYSSYGQSQNTGYGTQSTPQGYGSTGGYGSSQSSQSSYGQQSSYPGYGQQPAPSSTSGSYGSSSQSSSYGQPQSGSYSQQPSYGGQQQSYGQQQSYNPPQGYGQQNQYNSSSSGGGGGGGGGNYGQDQSSMSSGGGSGGGYGNQDQSGGGGSGGYGQQDRG"
)
assert len(CANONICAL) == 214


def residues_of(text: Column) -> Column:
    """The letters of a text that are residues, upper-cased; other characters go. Null gives null."""
    return F.upper(F.regexp_replace(text, f"[^{ALPHABET}{ALPHABET.lower()}]", ""))


def sequences(df: DataFrame, name_col: str, text_col: str = "text") -> DataFrame:
    """name, seq of each row whose text has a residue; whole texts, however long."""
    some = df.filter(df[text_col].rlike(f"[{ALPHABET}{ALPHABET.lower()}]"))  # of the text: a condition on seq would make it twice
    return some.select(df[name_col].alias("name"), residues_of(df[text_col]).alias("seq"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shorter sequences, for operators whose output has a row for each pair of positions."""
    return sequences(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id")


def registry(spark: SparkSession) -> DataFrame:
    """name, sequence, mutations, description, parent, ordinal of the base variants."""
    sites = [k + 1 for k, a in enumerate(CANONICAL) if a == "Y"]
    rows = [("WT", CANONICAL, [], "canonical", None, 0), ("Y143S", CANONICAL[:142] + "S" + CANONICAL[143:], ["Y143S"], "one site", "WT", 1)]
    rows += [(f"AllY_to_{x}", CANONICAL.replace("Y", x), [f"Y{p}{x}" for p in sites], f"all Y to {x}", "WT", k) for k, x in enumerate("SAF", 2)]
    return spark.createDataFrame(rows, "name string, sequence string, mutations array<string>, description string, parent string, ordinal int")


def get_variant(df: DataFrame, name: str) -> DataFrame:
    """The row of that name; KeyError with the names there are."""
    found = df.filter(F.col("name") == name)
    if found.isEmpty():
        raise KeyError(f"{name} is not among {[r.name for r in df.select('name').limit(50).collect()]}")
    return found


def fasta(name: Column, seq: Column, mutations: Column | None = None, description: Column | None = None) -> Column:
    """A FASTA record with lines of 60, without a final newline."""
    head = F.concat(F.lit(">"), name.cast("string"))
    if mutations is not None:
        head = F.concat(head, F.when(F.size(mutations) > 0, F.concat(F.lit(" mutations="), F.array_join(mutations, ","))).otherwise(""))
    if description is not None:
        head = F.concat(head, F.when(F.length(description) > 0, F.concat(F.lit(" | "), description)).otherwise(""))
    return F.concat(head, F.lit("\n"), F.regexp_replace(seq, "(.{60})(?=.)", "$1\n"))


def write_fasta(df: DataFrame, path: str) -> None:
    """One record a row, from name and seq."""
    df.select(fasta(F.col("name"), F.col("seq")).alias("value")).write.text(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; NaN and infinities become null, as strict JSON has none."""
    clean = [F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*clean).write.json(path)


def write_variants_json(df: DataFrame, path: str) -> None:
    """A registry (name, sequence, mutations, description, parent) as one object keyed by name, in one file; for the tens of variants that a registry has."""
    one = F.struct("name", "sequence", "mutations", "description", "parent")
    whole = df.agg(F.map_from_entries(F.collect_list(F.struct("name", one.alias("v")))).alias("m"))
    whole.select(F.to_json("m", {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.text(path)


def read_variants_json(spark: SparkSession, path: str) -> DataFrame:
    """The registry's file: one object, keyed by name, of variant objects."""
    one = "struct<name:string,sequence:string,mutations:array<string>,description:string,parent:string>"
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{one}>").alias("m"))
    return text.select(F.explode("m").alias("key", "v")).select("v.*")


def write_summary_csv(df: DataFrame, path: str, four: list[str], two: list[str]) -> None:
    """A CSV table with fixed decimals: four for some columns, two for others."""
    fixed = lambda c, n: F.format_string(f"%.{n}f", F.col(c).cast("double")).alias(c)
    out = df.select(*[fixed(c, 4) if c in four else fixed(c, 2) if c in two else F.col(c) for c in df.columns])
    out.write.option("header", True).csv(path)


def write_maps(rows: DataFrame, path: str) -> None:
    """Maps by rows (name, n, idx, i, e) as Parquet."""
    rows.write.parquet(path)


def write_masks(rows: DataFrame, path: str) -> None:
    """Masks (name, i and boolean columns or arrays) as Parquet."""
    rows.write.parquet(path)


def read_maps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

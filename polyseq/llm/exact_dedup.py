"""Exact deduplication with a heavy-hitter split.

Each text becomes the SHA-256 digest of its normalised form, and only digests move. A Misra-Gries summary of
each partition names the digests that may be frequent; the best of them are counted exactly, and these verified
winners - at most ``counters`` rows - are broadcast, so that their rows are settled where they lie. The other
digests, none of which is frequent, are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyseq.llm._shared import fresh, scratch, sift, stage

SPACES = r"[\x20\x09-\x0D]+"
#: Rows of a digest from which it is a winner.
LEAST_COPIES = 16


def text_digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text with each run of white space made one space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "), 256))


def _shrink(counts: dict[bytes, int], counters: int) -> dict[bytes, int]:
    """The Misra-Gries step for a batch: take the (counters + 1)-th largest count off all."""
    if len(counts) <= counters:
        return counts
    off = sorted(counts.values(), reverse=True)[counters]
    return {k: n - off for k, n in counts.items() if n > off}


def _misra_gries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for x in pc.value_counts(batch.column(0)):
                key = x["values"].as_py()
                counts[key] = counts.get(key, 0) + x["counts"].as_py()
            counts = _shrink(counts, counters)
        # a digest with over 2/counters of the rows of some partition is left with at least 1/counters of them
        strong = {k: n for k, n in counts.items() if n >= max(2, rows / (counters + 1))}
        yield pa.record_batch({"digest": pa.array(strong.keys(), pa.binary()), "weight": pa.array(strong.values(), pa.int64())})

    return run


def _parts(df: DataFrame, id_col: str, text_col: str, counters: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows (doc_id, digest, rid); the winners (digest, n, first), ``counters`` at most; the rows of other digests, with n and first."""
    rows = stage(df.select(df[id_col].alias("doc_id"), text_digest(df[text_col]).alias("digest")).withColumn("rid", F.monotonically_increasing_id()), "digests")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    frequent = (
        rows.select("digest").mapInArrow(_misra_gries(counters), "digest binary, weight long").groupBy("digest").agg(F.sum("weight").alias("weight"))
        .orderBy(F.desc("weight"), "digest").limit(counters).select("digest")
    )
    counted = rows.join(F.broadcast(frequent), "digest").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
    winners = stage(counted.filter(F.col("n") >= LEAST_COPIES), "winners")
    group = Window.partitionBy("digest")
    others = rows.join(F.broadcast(winners), "digest", "left_anti").withColumns({"n": F.count(F.lit(1)).over(group), "first": first.over(group)})
    return rows, winners, others


def group_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024) -> DataFrame:
    """One row for each row of ``df``: doc_id, digest, keep_id, group_size, kept.

    Of rows with equal normalised text the one with the smallest id is kept; a null id comes after all others,
    and of rows that share that id exactly one is kept, whichever. A null text equals the empty text. Other
    columns of ``df``, whatever their names, are not read. An empty table gives an empty result.

    counters: size of the Misra-Gries summaries and most winners to broadcast.
    """
    rows, winners, others = _parts(df, id_col, text_col, counters)
    settled = rows.join(F.broadcast(winners), "digest")
    return settled.unionByName(others).select("doc_id", "digest", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("rid") == F.col("first.rid")).alias("kept"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024) -> DataFrame:
    """The rows of ``df`` that :func:`group_copies` keeps, with all their columns, whatever the names of these.

    Rows of the winners are decided where they lie. Of the others those that go are known by (id, digest): a sieve of
    these, of fixed size, tells most rows that stay, which don't move; the rest is joined. Rows that agree in id and
    digest are made one. An empty table gives an empty one.
    """
    with scratch(df.sparkSession):
        rows, winners, others = _parts(df, id_col, text_col, counters)
        again = (F.count(F.lit(1)) > 1).alias("again")
        first = rows.join(F.broadcast(winners), "digest").filter(F.col("doc_id").eqNullSafe(F.col("first.doc_id")))
        hot = stage(first.groupBy("digest").agg(F.first("doc_id").alias("doc_id"), again), "hot", outlives=True)  # a row for each winner
        told = others.groupBy("doc_id", "digest").agg(F.max(F.col("rid") == F.col("first.rid")).alias("kept"), again)
        told = stage(told.filter("again or not kept"), "told", outlives=True)
    n_again = told.filter("again and kept").count() + hot.filter("again").count()

    digest, *names = fresh(df, "digest", "hot_id", "hot_digest", "hot_again", "told_id", "told_digest", "told_again", "told_kept")
    hot_id, hot_digest, hot_again, told_id, told_digest, told_again, told_kept = map(F.col, names)
    x = df.withColumn(digest, text_digest(df[text_col]))
    own, of = F.col(f"`{id_col}`"), F.col(digest)
    x = x.join(F.broadcast(hot.select(*[F.col(c).alias(k) for c, k in zip(("doc_id", "digest", "again"), names[:3], strict=True)])), of == hot_digest, "left")
    told = told.select(*[F.col(c).alias(k) for c, k in zip(("doc_id", "digest", "again", "kept"), names[3:], strict=True)])
    (key,) = fresh(x, "told_key")
    x, may = sift(x, F.xxhash64(own, of), told.select(F.xxhash64(told_id, told_digest).alias(key)), key)
    passed = x.filter(~may).select("*", *[F.lit(None).cast(t).alias(c) for c, t in told.dtypes])
    x = passed.union(x.filter(may).join(told, own.eqNullSafe(told_id) & (of == told_digest), "left"))
    x = x.filter(F.when(hot_digest.isNotNull(), own.eqNullSafe(hot_id)).otherwise(F.coalesce(told_kept, F.lit(True))))
    columns = [F.col(f"`{c}`") for c in df.columns]
    if not n_again:
        return x.select(*columns)
    several = F.coalesce(hot_again, told_again, F.lit(False))
    return x.filter(~several).select(*columns).union(x.filter(several).dropDuplicates([id_col, digest]).select(*columns))

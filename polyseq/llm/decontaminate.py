"""Benchmark decontamination by winnowing, in DataFrame operations only.

A window is ``span`` consecutive words of a benchmark item (a shorter item is one window of its own length).
Every span of t words, here or there, holds w = t - k + 1 k-grams; the least of their hashes is its fingerprint,
so a document that contains a window has that window's fingerprint among its own. Documents are winnowed once,
the fingerprints of both sides are joined, and around each hit the words themselves are compared, window by window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyseq.llm._shared import fresh, lower_az, rows_without, scratch, sift, stage

#: What lies between words: ASCII characters but letters and digits.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Most rows, and most fingerprints or windows in them, that are broadcast; beyond it Spark shuffles both sides.
BROADCAST_ROWS = 200_000


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), NOT_WORD), "")


def _shape(t: int) -> tuple[int, int]:
    """k-gram length and k-grams in a window, for spans of t words."""
    k = (t + 1) // 2
    return k, t - k + 1


def _indices(n: Column) -> Column:
    """0 .. n - 1, or no elements."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _grams(hashes: Column, t: int) -> Column:
    """A 32-bit hash of each k-gram; hits are compared word by word later on, so a collision costs time only."""
    k, _ = _shape(t)
    return F.transform(_indices(F.size(hashes) - (k - 1)), lambda i: F.hash(F.lit(t), *[F.get(hashes, i + j) for j in range(k)]))


def _minima(grams: Column, t: int) -> Column:
    _, w = _shape(t)
    at = lambda i: [F.get(grams, i + j) for j in range(w)]
    return F.transform(_indices(F.size(grams) - (w - 1)), lambda i: F.least(*at(i)) if w > 1 else at(i)[0])


def _word_hashes(words: Column) -> Column:
    # full lower-casing here: words that agree with A-Z lowered agree with everything lowered
    return F.transform(words, lambda w: F.hash(F.lower(w)))


def _with_fingerprints(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds fps, the distinct fingerprints for all span lengths; from the column hashes."""
    df = df.select("*", *[_grams(F.col("hashes"), t).alias(f"grams{t}") for t in lengths])
    df = df.select("*", *[_minima(F.col(f"grams{t}"), t).alias(f"minima{t}") for t in lengths])
    fps = F.concat(*[F.col(f"minima{t}") for t in lengths])
    return df.withColumn("fps", F.array_distinct(fps)).drop(*[f"{x}{t}" for x in ("grams", "minima") for t in lengths])


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _window_texts_near_hits(near: DataFrame, t: int) -> DataFrame:
    """doc_id, text_hash, start, t, window: each span of t words that holds a k-gram whose hash is in fps."""
    grams, w = F.col(f"grams{t}"), _shape(t)[1]
    at = F.filter(_indices(F.size(grams)), lambda p: F.array_contains("fps", F.get(grams, p)))
    around = lambda p: F.filter(F.sequence(F.greatest(p - (w - 1), F.lit(0)), p), lambda i: i <= F.size("words") - t)
    starts = near.select("doc_id", "text_hash", "words", F.array_distinct(F.flatten(F.transform(at, around))).alias("starts"))
    spans = F.transform("starts", lambda i: F.struct(i.alias("start"), F.lit(t).alias("t"), F.concat_ws(" ", F.slice("words", i + 1, t)).alias("window")))
    return starts.select("doc_id", "text_hash", F.explode_outer(spans).alias("x")).filter("x is not null").select("doc_id", "text_hash", "x.*")


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = 10) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_hash, n_words, n_hit, n_items, items (sorted strings), hits.

    hits: the array of (start, length) of each window that occurs, in words, by start. A document word within any
    of them is hit. n_items counts the distinct ids, nulls left out, of items with a window that occurs. Null text
    has no words; an item without words has no window; rows that are repeated each get the same answer, also under
    a null id. Other columns are not read. An empty benchmark hits nothing.
    """
    bench = benchmark.select(benchmark[item_col].cast("string").alias("item"), F.transform(_words(benchmark[item_text_col]), lower_az).alias("words")).filter(F.size("words") > 0)
    bench = bench.withColumn("t", F.least(F.size("words"), F.lit(span)))
    listed = bench
    bench = stage(listed.select("words", "t").distinct().withColumn("passage", F.monotonically_increasing_id()), "passages")
    of_passages = stage(listed.filter("item is not null").join(bench, ["words", "t"]).select("passage", "item").distinct(), "items")
    lengths = [r.t for r in bench.select("t").distinct().collect()] or [span]  # at most ``span`` numbers
    window_texts = F.transform(_indices(F.size("words") - F.col("t") + 1), lambda i: F.concat_ws(" ", F.slice("words", i + 1, F.col("t"))))
    # explode_outer: for explode, Spark would filter by the array's size first, and so make each array many times over
    each = bench.select("passage", "t", F.explode_outer(F.array_distinct(window_texts)).alias("window"))
    windows = stage(each.select("t", "window").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    of_windows = stage(each.join(windows, ["t", "window"]).select("wid", "passage"), "window-passages")
    own = [_with_fingerprints(bench.filter(F.col("t") == t).select(_word_hashes(F.col("words")).alias("hashes")), [t]) for t in lengths]
    wanted = stage(reduce(DataFrame.union, own).select(F.explode_outer("fps").alias("fp")).filter("fp is not null").distinct(), "wanted")

    scanned = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_hash"), _word_hashes(_words(docs[text_col])).alias("hashes"))
    scanned = _with_fingerprints(scanned, lengths).select("doc_id", "text_hash", F.size("hashes").cast("long").alias("n_words"), "fps")
    scanned = stage(scanned, "fingerprints")
    found = scanned.select("doc_id", "text_hash", F.explode("fps").alias("fp")).join(_small(wanted, wanted.count()), "fp")
    found = stage(found.groupBy("doc_id", "text_hash").agg(F.collect_set("fp").alias("fps")), "candidates")

    # extend: compare the words of each window that holds a fingerprint found on both sides
    near = found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "fps")
    texts = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_hash"), docs[text_col].alias("__text"))
    texts, may = sift(texts, F.xxhash64("doc_id", "text_hash"), found.select(F.xxhash64("doc_id", "text_hash").alias("key")), "key")  # other texts don't move
    near = texts.filter(may).join(near, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")))
    near = near.select("doc_id", "text_hash", "fps", _words(F.col("__text")).alias("raw"))
    near = near.select("doc_id", "text_hash", "fps", F.transform("raw", lower_az).alias("words"), _word_hashes(F.col("raw")).alias("hashes"))
    near = near.select("*", *[_grams(F.col("hashes"), t).alias(f"grams{t}") for t in lengths])
    each = [_window_texts_near_hits(near, t) for t in lengths]
    matches = reduce(DataFrame.union, each).join(_small(windows, windows.count()), ["t", "window"]).select("doc_id", "text_hash", "start", "t", "wid")
    matches = stage(matches, "matches")

    last = F.aggregate(
        F.col("hits"), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, x: F.struct(F.greatest(a["end"], x["start"] + x["t"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["start"] + x["t"] - F.greatest(a["end"], x["start"]))).alias("n")),
    )
    hits = matches.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("start", "t"))).alias("hits"))
    hits = hits.withColumn("n_hit", last["n"].cast("long"))
    # a row for each window and passage, and for each passage and item: a phrase that all items share makes no long row
    passages = matches.select("doc_id", "text_hash", "wid").distinct().join(_small(of_windows, of_windows.count()), "wid").select("doc_id", "text_hash", "passage").distinct()
    items = passages.join(_small(of_passages, of_passages.count()), "passage").groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("item")).alias("items"))
    for name, part in (("a", hits), ("b", items)):
        part = part.withColumnsRenamed({"doc_id": f"{name}_id", "text_hash": f"{name}_hash"})
        scanned = scanned.join(part, F.col("doc_id").eqNullSafe(F.col(f"{name}_id")) & (F.col("text_hash") == F.col(f"{name}_hash")), "left")
    no_items, no_hits = F.array().cast("array<string>"), F.array().cast("array<struct<start:int,t:int>>")
    items = F.coalesce("items", no_items)
    return scanned.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), F.coalesce("hits", no_hits).alias("hits"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 1, **options) -> DataFrame:
    """The rows of ``docs`` without a word that is hit by a window of ``least_words`` or more, with all their columns, whatever the names of these.

    Items shorter than the span are windows of their own in :func:`find_overlaps`; those of fewer than ``least_words``
    drop nothing here, as so few words may occur anywhere. Other options, nulls, repeated rows and empty tables as
    there. Rows that stay don't move but for those few that a sieve of fixed size takes for others.
    """
    long = F.size(F.filter("hits", lambda x: x["t"] >= least_words)) > 0
    own, of, key = fresh(docs, "bad_id", "bad_hash", "bad_key")
    with scratch(docs.sparkSession):
        bad = find_overlaps(docs, benchmark, id_col, text_col, **options).filter(long).select(F.col("doc_id").alias(own), F.col("text_hash").alias(of)).distinct()
        bad = stage(bad.withColumn(key, F.xxhash64(own, of)), "contaminated", outlives=True)
    text_hash = F.xxhash64(docs[text_col])
    return rows_without(docs, F.xxhash64(docs[id_col], text_hash), bad, key, docs[id_col].eqNullSafe(F.col(own)) & (text_hash == F.col(of)))

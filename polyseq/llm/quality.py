"""A quality classifier by importance resampling.

Two generative models over hashed words and pairs of words - one of the texts labelled good, one of all texts - give
each text the logarithm of the ratio of its probabilities. Its Gumbel key is that plus Gumbel noise drawn from a hash
of the row, and the k rows with the largest keys are the sample: one drawn without replacement, in proportion to the
ratios. k is given, or else the number of texts whose ratio is above the cut that best parts good from bad among
labelled texts that the models have not seen. What isn't drawn is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyseq.llm._shared import fresh, mix, scratch, stage, word_hashes

#: Buckets of n-grams, and labelled texts to learn from, about.
BUCKETS, SAMPLE = 1 << 18, 40_000
#: Added to a bucket's count, seen and expected, so that rare n-grams tell little: so much, but no more than so many times what a used bucket is
#: expected to have. With less, their noise adds up over long texts; with more, small corpora would tell nothing.
PRIOR, PRIOR_BUCKETS = 64.0, 8.0
_TURN = np.uint64(0x9E3779B97F4A7C15)


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of the pairs of neighbouring words of a batch of texts, and the text of each."""
    hashes, sizes = word_hashes(column, fold=False)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    pairs = mix(mix(hashes[:-1] + _TURN) ^ hashes[1:])[doc[1:] == doc[:-1]] if len(hashes) else hashes
    buckets = (np.concatenate([hashes, pairs]) >> np.uint64(64 - 18)).astype(np.int64)
    return buckets, np.concatenate([doc, doc[1:][doc[1:] == doc[:-1]]]) if len(hashes) else doc


def _parts(column: pa.Array, rows: int = 256) -> Iterator[pa.Array]:
    """A batch in parts, so that the n-grams of a few texts are held at a time."""
    for at in range(0, len(column), rows):
        yield column.slice(at, rows)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part in _parts(batch.column(0)):
            found += np.bincount(_grams(part)[0], minlength=BUCKETS)
    at = np.flatnonzero(found)
    yield pa.record_batch({"bucket": pa.array(at), "n": pa.array(found[at])})


def gram_counts(texts: DataFrame) -> np.ndarray:
    """Counts by bucket over all of one column of texts; the driver gets BUCKETS rows at most."""
    out = np.zeros(BUCKETS)
    rows = texts.mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


@dataclass(frozen=True)
class Model:
    """log p_good - log p_all by bucket, and the cut between bad and good."""

    ratios: np.ndarray
    cut: float

    def log_ratio(self, text: Column) -> Column:
        """Of the whole text: the sum over its n-grams; 0 without words."""
        ratios = self.ratios

        @F.arrow_udf("double")
        def log_ratio(x: pa.Array) -> pa.Array:
            out = [np.zeros(0)]
            for part in _parts(x):
                buckets, docs = _grams(part)
                out.append(np.bincount(docs, ratios[buckets], len(part)))
            return pa.array(np.concatenate(out))

        return log_ratio(text)


def best_cut(scores: np.ndarray, good: np.ndarray) -> float:
    """The cut with the largest sum of the shares of good texts above and bad ones below; midway where several have it."""
    if good.all() or not good.any():
        return -np.inf
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    value = np.cumsum(~g) / (~g).sum() - np.cumsum(g) / g.sum()
    value[:-1][s[:-1] == s[1:]] = -np.inf
    k = int(value.argmax())
    return float(s[k] if k == len(s) - 1 else (s[k] + s[k + 1]) / 2)


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model | None:
    """The two models and the cut; None without a good label that belongs to a text.

    The model of all texts counts every text. Of about ``sample`` labelled texts (never over twice as many), taken by
    a hash of the id, three quarters teach the model of good texts, which counts the good ones, and the others the cut.
    Labels other than 0 and 1, and those of a null id, are left out.
    """
    known = labels.select(labels[id_col].alias("id"), labels[label_col].alias("good")).filter("id is not null and good in (0, 1)").groupBy("id").agg(F.max("good").alias("good"))
    cut = min((1 << 63) - 1, (sample << 64) // max(known.count(), 1) - (1 << 63))
    known = known.filter(F.xxhash64("id") <= cut).limit(2 * sample).withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), 4))
    texts = df.select(df[id_col].alias("id"), df[text_col].alias("text")).join(F.broadcast(known), "id")  # 2 * sample rows at most
    texts = stage(texts, "labelled")
    good = gram_counts(texts.filter("part > 0 and good = 1").select("text"))
    if not good.sum():
        return None
    every = gram_counts(df.select(df[text_col]))
    expected = every * (good.sum() / every.sum())
    prior = min(PRIOR, PRIOR_BUCKETS * expected.sum() / (expected > 0).sum())
    model = Model(np.log((good + prior) / (expected + prior)), 0.0)
    held = texts.filter("part = 0").select(model.log_ratio(F.col("text")).alias("s"), "good").toArrow()
    return replace(model, cut=best_cut(held["s"].to_numpy(), held["good"].to_numpy() == 1))


def gumbel(row_hash: Column) -> Column:
    """Standard Gumbel noise from a 64-bit hash."""
    u = (F.shiftrightunsigned(row_hash, 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def _least_key(keys: DataFrame, k: int) -> float:
    """The k-th largest of the column key, to the width of a bin: histograms of 1,024 bins, each within a bin of the last."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    for _ in range(5):
        width = (high - low) / 1024
        if not width > 0:
            break
        bins = keys.filter(F.col("key").between(low, high)).groupBy(F.least(F.floor((F.col("key") - low) / width), F.lit(1023)).alias("bin")).count().orderBy(F.desc("bin")).collect()
        for r in bins:
            if above + r["count"] >= k:
                break
            above += r["count"]
        low, high = low + r["bin"] * width, min(high, low + (r["bin"] + 1) * width)
    return low


def _keyed(df: DataFrame, model: Model, id_col: str, text_col: str, ratio: str, key: str) -> DataFrame:
    x = df.withColumn(ratio, model.log_ratio(df[text_col]))
    return x.withColumn(key, F.col(ratio) + gumbel(F.xxhash64(df[id_col], df[text_col])))


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, k: int | None = None) -> DataFrame:
    """One row for each row of ``df``: doc_id, log_ratio, key, kept.

    k: how many rows to draw; None for as many as have a ratio above the learned cut. Null and empty texts have ratio
    0. Rows alike in id and text have the same key and are kept or rejected together, so a tie at the last place keeps
    more than k. Without usable labels all rows are kept, ratio and key null. Ids may be null or repeated; other
    columns are not read. An empty table gives an empty result.
    """
    model = fit(df, labels, id_col, text_col, label_col, sample)
    texts = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    if model is None:
        return texts.select("doc_id", F.lit(None).cast("double").alias("log_ratio"), F.lit(None).cast("double").alias("key"), F.lit(True).alias("kept"))
    keys = stage(_keyed(texts, model, "doc_id", "text", "log_ratio", "key").select("doc_id", "log_ratio", "key"), "keys")
    return keys.select("*", (F.col("key") >= _threshold(keys, model, k)).alias("kept"))


def _threshold(keys: DataFrame, model: Model, k: int | None) -> float:
    n, good = keys.agg(F.count(F.lit(1)), F.count_if(F.col("log_ratio") > model.cut)).first()
    k = min(n, good if k is None else k)
    return _least_key(keys, k) if k > 0 else np.inf


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, k: int | None = None) -> DataFrame:
    """The rows of ``df`` that :func:`judge` keeps, with all their columns, whatever the names of these; each row's key is made anew, so no text moves."""
    with scratch(df.sparkSession):
        model = fit(df, labels, id_col, text_col, label_col, sample)
    if model is None:
        return df
    ratio, key = fresh(df, "log_ratio", "key")
    keyed = _keyed(df, model, id_col, text_col, ratio, key)
    with scratch(df.sparkSession):
        least = _threshold(stage(keyed.select(F.col(ratio).alias("log_ratio"), F.col(key).alias("key")), "keys"), model, k)
    return keyed.filter(F.col(key) >= least).select(*[F.col(f"`{c}`") for c in df.columns])

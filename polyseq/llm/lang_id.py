"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1-, 2- and 3-grams of the characters (code points) of the text, case folded, ASCII digits and marks as
spaces, hashed into a fixed number of buckets; a feature's value is its share of the text's n-grams times its inverse document
frequency over all training texts. Follow-the-regularised-leader with elastic-net penalties fits the weights on a
bounded sample of training texts, most of which are left at zero; a part of the sample, not used in the fit, sets
the temperature that the scores are divided by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyseq.llm._shared import flat_text, mix

#: Buckets of n-grams; orders of n-grams; training texts that the weights are fitted on, about; least of a language, if it has them; most languages.
BUCKETS, ORDERS, SAMPLE, LEAST, LANGS = 1 << 16, (1, 2, 3), 4000, 100, 128
UNKNOWN = "und"
#: Shares are taken in parts of so many, which keeps values near one.
PER = 100
_LETTER = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)])
#: Code points from here on have no case.
_CASED = 0x1E944


def _fold_table() -> np.ndarray:
    """For each code point that may have case the one that it folds to, where that is a single one; ASCII but for letters becomes a space."""
    out = np.arange(_CASED, dtype=np.uint64)
    for k in range(_CASED):
        folds = [x for x in (chr(k).casefold(), chr(k).lower()) if len(x) == 1]
        out[k] = 0x20 if k < 0x80 and not chr(k).isalpha() else ord(folds[0]) if folds else k
    return out


_FOLD = _fold_table()


def characters(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The folded code points of texts that lie end to end as UTF-8, and the n + 1 offsets into these."""
    first = (flat & 0xC0) != 0x80
    at = np.flatnonzero(first)
    padded = np.concatenate([flat, np.zeros(3, np.uint8)])
    lead = padded[at].astype(np.uint64)
    size = 1 + (lead >= 0xC0).astype(int) + (lead >= 0xE0) + (lead >= 0xF0)
    code = np.where(size == 1, lead, lead & np.array([0, 0x7F, 0x1F, 0x0F, 0x07], np.uint64)[size])
    for k in (1, 2, 3):
        code = np.where(size > k, (code << np.uint64(6)) | (padded[at + k] & 0x3F).astype(np.uint64), code)
    cased = code < _CASED
    code[cased] = _FOLD[code[cased].astype(np.int64)]
    return code, np.concatenate([[0], np.cumsum(first)])[offsets]


def _grams(flat: np.ndarray, offsets: np.ndarray, chunk: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Some texts at a time: the first and the one after the last, the buckets of their n-grams, and the text of each n-gram."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + chunk, side="right")) - 1)
        text, cuts = characters(flat[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        doc = np.repeat(np.arange(to - at), np.diff(cuts))
        code, buckets, docs = np.zeros(len(text), np.uint64), [], []
        for n in range(1, max(ORDERS) + 1):
            code = (code[: len(text) - n + 1] << np.uint64(21)) | text[n - 1 :] if n > 1 else text
            if n in ORDERS and len(code):
                same = doc[: len(code)] == doc[n - 1 :]
                buckets.append((mix(mix(code) + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int32)[same])
                docs.append(doc[: len(code)][same])
        none = np.zeros(0, np.int64)
        yield at, to, np.concatenate(buckets or [none]), np.concatenate(docs or [none])
        at = to


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of the texts of a task each bucket occurs."""
    found, rows = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        rows += batch.num_rows
        for _, _, buckets, docs in _grams(*flat_text(batch.column(0))):
            found += np.bincount(np.unique(docs * BUCKETS + buckets) % BUCKETS, minlength=BUCKETS)
    at = np.flatnonzero(found)
    yield pa.record_batch({"bucket": pa.array(np.append(at, -1), pa.int64()), "n": pa.array(np.append(found[at], rows), pa.int64())})


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, key, lang, times) to (key, lang, times, buckets, shares): the term frequencies of each text."""
    for batch in batches:
        out_b, out_s = [], []
        for at, to, buckets, docs in _grams(*flat_text(batch.column(0))):
            keys, n = np.unique(docs * BUCKETS + buckets, return_counts=True)
            total = np.bincount(docs, minlength=to - at)
            cuts = np.searchsorted(keys // BUCKETS, np.arange(1, to - at))
            out_b += np.split((keys % BUCKETS).astype(np.int32), cuts)
            out_s += np.split((n / total[keys // BUCKETS]).astype(np.float32), cuts)
        yield pa.record_batch({"key": batch.column(1), "lang": batch.column(2), "times": batch.column(3), "buckets": pa.array(out_b, pa.list_(pa.int32())), "shares": pa.array(out_s, pa.list_(pa.float32()))})


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Ftrl:
    """Multinomial logistic regression by follow-the-regularised-leader (proximal), in small batches.

    l1 and l2 are the penalties of the elastic net: a weight whose sum of gradients stays within l1 is zero.
    """

    def __init__(self, n_classes: int, rate: float = 1.0, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-4):
        self.rate, self.beta, self.l1, self.l2 = rate, beta, l1, l2
        self.z, self.n = np.zeros((BUCKETS + 1, n_classes)), np.zeros((BUCKETS + 1, n_classes))  # the last row is the intercept

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.rate + self.l2))

    def step(self, cols: np.ndarray, values: np.ndarray, row: np.ndarray, y: np.ndarray) -> None:
        """One batch: column, value and row of each entry; the class of each row."""
        touched, at = np.unique(cols, return_inverse=True)
        w = self.weights(touched)
        scores = np.zeros((len(y), w.shape[1]))
        np.add.at(scores, row, w[at] * values[:, None])
        wrong = _softmax(scores)
        wrong[np.arange(len(y)), y] -= 1
        g = np.zeros_like(w)
        np.add.at(g, at, wrong[row] * values[:, None])
        g /= len(y)
        n = self.n[touched]
        self.z[touched] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.rate * w
        self.n[touched] = n + g * g


def fit_temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores that makes ``y`` likeliest, by golden-section search over its logarithm."""
    loss = lambda t: -np.log(np.maximum(_softmax(scores / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()
    low, high, r = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


class Model:
    """Languages, and for each bucket (the last row: always) the weight of each; scores are already divided by the temperature."""

    def __init__(self, langs: list[str], weights: np.ndarray):
        self.langs, self.weights = langs, weights.astype(np.float32)

    def scores(self, column: pa.Array) -> np.ndarray:
        flat, offsets = flat_text(column)
        out = np.tile(self.weights[-1].astype(np.float64), (len(offsets) - 1, 1))
        for at, to, buckets, docs in _grams(flat, offsets):
            total = np.maximum(np.bincount(docs, minlength=to - at), 1)
            for k in range(len(self.langs)):
                out[at:to, k] += np.bincount(docs, self.weights[buckets, k], to - at) / total
        return out


def has_letter(column: pa.Array) -> np.ndarray:
    flat, offsets = flat_text(column)
    letters = np.concatenate([[0], np.cumsum(_LETTER[flat])])
    found = letters[offsets[1:]] > letters[offsets[:-1]]
    for k in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[k] = any(c.isalpha() for c in flat[offsets[k] : offsets[k + 1]].tobytes().decode())
    return found


def _sampled(rows: DataFrame, sample: int) -> DataFrame:
    """The rows (text, key, lang) to fit the weights on: of each language those with the lowest keys, 2 ** 63 being added to keys.

    About ``sample`` in all, in proportion, but about LEAST of each language if it has them, and the lowest key of
    each at least. Rows alike in key and language are one, with their number as times. The LANGS most frequent values
    of lang are learned, of equals the first; others, as of a dirty column, are never predicted. The driver gets a
    row for each language.
    """
    langs = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low")).orderBy(F.desc("n"), "lang").limit(LANGS).collect()
    total = sum(r.n for r in langs)
    cut = lambda r: max(r.low, min((1 << 63) - 1, int(min(1.0, max(sample / total, LEAST / r.n)) * (1 << 64)) - (1 << 63)))
    cuts = rows.sparkSession.createDataFrame([(r.lang, cut(r)) for r in langs], "lang string, cut long")
    taken = rows.join(F.broadcast(cuts), "lang").filter(F.col("key") <= F.col("cut"))
    return taken.groupBy("key", "lang").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("times")).select("text", "key", "lang", "times")


def fit(df: DataFrame, lang: Column, order: Column, text_col: str = "text", sample: int = SAMPLE, epochs: int = 6, batch: int = 32) -> Model | None:
    """Learn from the texts of ``df`` whose ``lang`` isn't null; None if there are none.

    Document frequencies come from all of them. The weights are fitted on those whose ``order``, a 64-bit hash of the
    row, is among the lowest of their language, about ``sample`` of them and LEAST of each of LANGS languages at most
    (all, if there are no more); every tenth of a language sets the temperature only. Repeated rows are held once and fitted in proportion to
    their number.
    """
    rows = df.select(df[text_col].alias("text"), order.alias("key"), lang.alias("lang")).filter("text is not null and lang is not null")
    counts = {r.bucket: r.n for r in rows.select("text").mapInArrow(_document_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # at most BUCKETS + 1 rows
    n_texts = counts.pop(-1, 0)
    seen = np.zeros(BUCKETS)
    seen[list(counts)] = list(counts.values())
    idf = np.log((1 + n_texts) / (1 + seen)) + 1
    if not n_texts:
        return None
    first = _sampled(rows, sample).mapInArrow(_vectors, "key long, lang string, times long, buckets array<int>, shares array<float>").toArrow().sort_by("key")
    langs = sorted(set(first["lang"].to_pylist()))
    y = np.array([langs.index(x) for x in first["lang"].to_pylist()])
    cols = [np.append(x.values.to_numpy(), BUCKETS) for x in first["buckets"]]
    values = [np.append(s.values.to_numpy() * (PER * idf[c[:-1]]), 1.0) for s, c in zip(first["shares"], cols, strict=True)]
    rank = np.zeros(len(y), np.int64)  # within the language, by key
    for k in range(len(langs)):
        rank[y == k] = np.arange((y == k).sum())
    tenth = rank % 10 == 9
    times = first["times"].to_numpy()
    times = np.ceil(times * min(1.0, sample / times.sum())).astype(np.int64)
    model, own = Ftrl(len(langs)), np.repeat(np.flatnonzero(~tenth), times[~tenth])
    random = np.random.default_rng(0)
    for _ in range(epochs):
        random.shuffle(own)
        for k in range(0, len(own), batch):
            some = own[k : k + batch]
            model.step(np.concatenate([cols[i] for i in some]), np.concatenate([values[i] for i in some]), np.repeat(np.arange(len(some)), [len(cols[i]) for i in some]), y[some])
    w = model.weights()
    held = np.flatnonzero(tenth) if tenth.any() else own
    scores = np.array([(w[cols[i]] * values[i][:, None]).sum(axis=0) for i in held])
    w = w / fit_temperature(scores, y[held])
    w[:-1] *= PER * idf[:, None]
    return Model(langs, w)


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: doc_id, lang_pred, score (its calibrated probability).

    Texts that are null or have no letter are ``und``, score 0; so are all without a model. Ids may be null or
    repeated. No other column is read.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None:
                best, top = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows)
                ok = np.zeros(batch.num_rows, bool)
            else:
                p = _softmax(model.scores(batch.column(1)))
                best, top, ok = p.argmax(axis=1), p.max(axis=1), has_letter(batch.column(1))
            langs = [model.langs[k] if good else UNKNOWN for k, good in zip(best.tolist(), ok.tolist(), strict=True)]
            yield pa.record_batch({"doc_id": batch.column(0), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(np.where(ok, top, 0.0), pa.float64())})

    return df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2, sample: int = SAMPLE) -> DataFrame:
    """:func:`predict` for each row of ``df``, after learning from those whose crc32 of the id as text, modulo ``folds``, isn't ``held_out``; and held_out.

    A null id counts as the empty text. An empty table gives an empty result.
    """
    code = lambda c: F.crc32(F.coalesce(c.cast("string"), F.lit("")))
    model = fit(df.filter(code(df[id_col]) % folds != held_out), df[lang_col], F.xxhash64(df[id_col], df[text_col]), text_col, sample)
    found = predict(df, model, id_col, text_col)
    return found.select("doc_id", (code(F.col("doc_id")) % folds == held_out).alias("held_out"), "lang_pred", "score")

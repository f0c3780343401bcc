"""Language-model scores by deleted interpolation.

P(w | h) = l(h) c(h w) / c(h) + (1 - l(h)) P(w), where the weight l depends on the bucket of the frequency of the
context h, and P(w) = m c(w) / N + (1 - m) / (V + 1). A part of the training texts is deleted from the counts, and
expectation-maximisation on the n-grams of that part learns m and the l of each bucket; the scores then use the
counts of all training texts.

The texts of a task become blocks, written as a table bucketed by block. A block sends its distinct words and pairs
of words, as 64-bit hashes with their counts, once to the range of hashes that each belongs to; there they are summed
over all blocks, and the sums go back to the blocks that asked. So a pair that many texts share moves once for each
block, whatever its frequency, and the blocks themselves don't move. The blocks are dealt out to parts of a fixed size;
with more than one part, a range is summed by part first, then over the parts, so that the commonest words, which
every block has, bring no task more than a part's rows or a row for each part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from polyseq.llm._shared import give_back, mix, new_block, pack_numbers, pack_planes, pack_sorted, range_of, stage, unpack_numbers, unpack_planes, unpack_sorted, word_hashes, write_bucketed

#: Hashes of the end of a text, which is a token, and of its start, which is a context only.
END, START = np.uint64(0x5B1C0F4E2D3A6987), np.uint64(0xA7D9E3C1B5F02468)
_TURN = np.uint64(0x9E3779B97F4A7C15)
#: Tokens in a block, about, and distinct hashes in a range, about.
BLOCK_TOKENS, RANGE_HASHES = 1_000_000, 2_000_000
#: Blocks in a part, about: most rows of a range that a task sums.
PART_BLOCKS = 1 << 13
#: Steps of the logarithm of a ratio of probabilities, for expectation-maximisation.
STEPS = 32
_NEVER = -(1 << 20)


def _to_blocks(block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, words = word_hashes(batch.column(1))
            ends = np.cumsum(words + 1)
            tokens = np.insert(hashes, np.cumsum(words), END)
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + block_tokens, side="right")))
                keys, codes = np.unique(tokens[before : ends[to - 1]], return_inverse=True)
                part = batch.slice(at, to - at)
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.record_batch({
                    "block": pa.array([new_block()], pa.int64()), "doc_ids": one(part.column(0)), "parts": one(part.column(2)),
                    "sizes": one(pa.array(words[at:to] + 1, pa.int32())), "hashes": pa.array([keys.tobytes()], pa.binary()), "codes": pa.array([pack_planes(codes.reshape(-1))], pa.binary()),
                })
                give_back()
                at = to

    return run


class _Block:
    """A block as arrays. part of a text: 0 is scored only, 1 counts, 2 is the deleted part."""

    def __init__(self, row: dict):
        self.words = np.frombuffer(row["hashes"], np.uint64)
        self.codes = unpack_planes(row["codes"])
        self.sizes = np.array(row["sizes"], np.int64)
        self.part = np.repeat(np.array(row["parts"], np.int64), self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        # the start, which is nowhere a token, is a word more, so that its count as a context is found as others are
        context = np.concatenate([[0], self.codes[:-1]])
        context[self.starts] = len(self.words)
        self.context = context
        with_start = np.append(self.words, START)
        pairs = mix(mix(with_start[context] + _TURN) ^ self.words[self.codes])
        self.pairs, pair_codes = np.unique(pairs, return_inverse=True)
        self.pair_codes = pair_codes.reshape(-1)
        self.order = np.argsort(with_start)
        self.sorted_words = with_start[self.order]

    def word_counts(self, part: int) -> np.ndarray:
        """By sorted word; that of the start is the number of texts."""
        own = np.bincount(self.codes[self.part == part], minlength=len(self.words) + 1)
        own[len(self.words)] = (self.part[self.starts] == part).sum()
        return own[self.order]

    def pair_counts(self, part: int) -> np.ndarray:
        return np.bincount(self.pair_codes[self.part == part], minlength=len(self.pairs))

    def by_word(self, values: list[np.ndarray]) -> np.ndarray:
        """What came back, by range, in the order of the words as numbered."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.concatenate(values)
        return out


def _to_ranges(n: int):
    """Blocks to rows (range, block, words, their counts, pairs, their counts), the hashes sorted; only of ranges that a block has a hash in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = _Block(row)
            out: dict[str, list] = {k: [] for k in ("range", "block", "words", "word_n", "word_d", "pairs", "pair_n", "pair_d")}
            of_w, of_p = range_of(b.sorted_words, n), range_of(b.pairs, n)
            asked = np.unique(np.concatenate([of_w, of_p]))
            (from_w, to_w), (from_p, to_p) = ([np.searchsorted(x, asked, side).tolist() for side in ("left", "right")] for x in (of_w, of_p))
            counts = [b.word_counts(1), b.word_counts(2), b.pair_counts(1), b.pair_counts(2)]
            for i, k in enumerate(asked.tolist()):
                w, p = slice(from_w[i], to_w[i]), slice(from_p[i], to_p[i])
                values = (k, row["block"], pack_sorted(b.sorted_words[w]), pack_numbers(counts[0][w]), pack_numbers(counts[1][w]), pack_sorted(b.pairs[p]), pack_numbers(counts[2][p]), pack_numbers(counts[3][p]))
                for name, v in zip(out, values, strict=True):
                    out[name].append(v)
            yield pa.record_batch({k: pa.array(v, pa.int32() if k == "range" else pa.int64() if k == "block" else pa.binary()) for k, v in out.items()})

    return run


def _ratio_bins(n: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    return np.where(n > 0, np.floor(STEPS * np.log(np.maximum(ratio, 1e-300))), _NEVER).astype(np.int64)


def _column(rows: list[dict], name: str, unpack=unpack_numbers) -> np.ndarray:
    return np.concatenate([unpack(r[name]) for r in rows])


def _summed(rows: list[dict], what: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes of rows of one range, which of them each row's hashes are, and their sums without and in the deleted part."""
    keys, at = np.unique(_column(rows, f"{what}s", unpack_sorted), return_inverse=True)
    at = at.reshape(-1)
    return keys, at, *(np.bincount(at, _column(rows, f"{what}_{x}"), len(keys)).astype(np.int64) for x in "nd")


def _answers(rows: list[dict], found: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]], totals: dict | None) -> pa.Table:
    """A row for each of ``rows`` with the sums of its hashes; found: which each has, end to end, and the sums by hash. The first gets the totals."""
    out = {}
    for what, (at, kept, deleted) in found.items():
        cuts = np.cumsum([len(unpack_sorted(r[f"{what}s"])) for r in rows])[:-1]
        out[f"{what}_n"] = [pack_numbers(x) for x in np.split(kept[at], cuts)]
        out[f"{what}_d"] = [pack_numbers(x) for x in np.split(deleted[at], cuts)]
    give_back()
    return pa.table({
        "block": pa.array([r["block"] for r in rows], pa.int64()), "range": pa.array([r["range"] for r in rows], pa.int32()), **{k: pa.array(v, pa.binary()) for k, v in out.items()},
        "totals": pa.array([totals] + [None] * (len(rows) - 1), pa.struct([*((k, pa.int64()) for k in ("n", "n_all", "v", "v_all")), ("seen", pa.list_(pa.struct([("count", pa.int64()), ("times", pa.int64())])))])),
    })


def _totals(keys: np.ndarray, kept: np.ndarray, deleted: np.ndarray) -> dict:
    """What the words of a range add to N and V, with and without the deleted part, and how often those of the deleted part have which count without it."""
    token = keys != START
    n, d = kept[token], deleted[token]
    values, where = np.unique(n[d > 0], return_inverse=True)
    times = np.bincount(where.reshape(-1), d[d > 0], len(values)).astype(np.int64)
    # many counts are alike; far up, those within a percent are made one
    grid = np.where(values < 1024, values, np.exp(np.round(np.log(np.maximum(values, 1)) * 100) / 100).astype(np.int64))
    return {"n": int(n.sum()), "n_all": int((n + d).sum()), "v": int((n > 0).sum()), "v_all": int((n + d > 0).sum()), "seen": [{"count": int(a), "times": int(b)} for a, b in zip(grid, times, strict=True)]}


def _sum_range(group: pa.Table) -> pa.Table:
    """The rows of one range, of all blocks or parts, to a row for each with the sums over all of them; the first has the totals."""
    rows = group.to_pylist()
    words, pairs = _summed(rows, "word"), _summed(rows, "pair")
    return _answers(rows, {"word": words[1:], "pair": pairs[1:]}, _totals(words[0], *words[2:]))


def _sum_part(group: pa.Table) -> pa.Table:
    """The rows of one range and part, of all its blocks, to one as a block sends it, with the part in place of the block."""
    rows = group.to_pylist()
    out = {"range": pa.array([rows[0]["range"]], pa.int32()), "block": pa.array([rows[0]["part"]], pa.int64())}
    for what in ("word", "pair"):
        keys, _, kept, deleted = _summed(rows, what)
        out |= {f"{k}": pa.array([v], pa.binary()) for k, v in ((f"{what}s", pack_sorted(keys)), (f"{what}_n", pack_numbers(kept)), (f"{what}_d", pack_numbers(deleted)))}
    give_back()
    return pa.table(out)


def _answer_part(asked: pa.Table, sums: pa.Table) -> pa.Table:
    """The rows of one range and part, and the row that came back to the part, to a row for each block; the first has the totals if the part has."""
    rows, back = asked.to_pylist(), sums.to_pylist()[0]
    found = {what: (_summed(rows, what)[1], unpack_numbers(back[f"{what}_n"]), unpack_numbers(back[f"{what}_d"])) for what in ("word", "pair")}
    return _answers(rows, found, back["totals"])


def _range_sums(rows: DataFrame, n_parts: int) -> DataFrame:
    """What blocks send to ranges, to the sums that go back to them."""
    if n_parts == 1:
        return rows.groupBy("range").applyInArrow(_sum_range, _SUMS)
    rows = stage(rows.withColumn("part", F.pmod("block", F.lit(n_parts))), "asked")
    of_parts = rows.groupBy("range", "part").applyInArrow(_sum_part, _ASKED).groupBy("range").applyInArrow(_sum_range, _SUMS)
    return rows.groupBy("range", "part").cogroup(of_parts.withColumnRenamed("block", "part").groupBy("range", "part")).applyInArrow(_answer_part, _SUMS)


_ASKED = "range int, block long, words binary, word_n binary, word_d binary, pairs binary, pair_n binary, pair_d binary"
_SUMS = "block long, range int, word_n binary, word_d binary, pair_n binary, pair_d binary, totals struct<n:bigint,n_all:bigint,v:bigint,v_all:bigint,seen:array<struct<count:bigint,times:bigint>>>"


def mixture_weight(ratios: np.ndarray, times: np.ndarray, rounds: int = 200) -> float:
    """The weight x of p in x p + (1 - x) q that makes the data likeliest, by expectation-maximisation, from p / q."""
    if not times.sum():
        return 0.5
    x = 0.5
    for _ in range(rounds):
        new = float((times * x * ratios / (x * ratios + 1 - x)).sum() / times.sum())
        if abs(new - x) < 1e-7:
            break
        x = new
    return min(max(new, 1e-6), 1 - 1e-6)


def _bucket(n: np.ndarray) -> np.ndarray:
    """Contexts by frequency: those never seen, 1, 2 to 3, 4 to 7 and so on."""
    return np.where(n > 0, np.floor(np.log2(np.maximum(n, 1))), -1).astype(np.int64)


def _looked_up(b: _Block, row: dict, deleted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """c(h w), c(h), c(w) of each token of a block, with or without the deleted part."""
    parts = sorted(row["parts_back"] or [], key=lambda p: p["range"])
    sums = lambda p, what: unpack_numbers(p[f"{what}_n"]) + (unpack_numbers(p[f"{what}_d"]) if deleted else 0)
    words = b.by_word([sums(p, "word") for p in parts])
    pairs = np.concatenate([sums(p, "pair") for p in parts])
    return pairs[b.pair_codes], words[b.context], words[b.codes]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One block at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]
            give_back()


def _deleted_bins(m: float, n: int, v: int):
    """Of the deleted part: how often which bucket of c(h) comes with which ratio of c(h w) / c(h) to P(w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            if 2 in row["parts"]:
                b = _Block(row)
                at = b.part == 2
                pair, context, word = (x[at] for x in _looked_up(b, row, False))
                lower = m * word / max(n, 1) + (1 - m) / (v + 1)
                bins = np.column_stack([_bucket(context), _ratio_bins(pair, pair / np.maximum(context, 1) / lower)])
                found, times = np.unique(bins[context > 0], axis=0, return_counts=True)
                yield pa.record_batch({"bucket": pa.array(found[:, 0], pa.int64()), "bin": pa.array(found[:, 1], pa.int64()), "times": pa.array(times, pa.int64())})

    return run


def _by_bucket(weights: dict[int, float]) -> np.ndarray:
    """The weight of each bucket from -1 on; one that the deleted part never met has that of the nearest lower one it met, or else of the nearest higher one."""
    out, seen = np.zeros(65), np.array(sorted(weights), np.int64)
    if len(seen):
        for k in range(64):  # contexts never seen have no pairs and stay at zero
            out[k + 1] = weights[int(seen[max(0, int(np.searchsorted(seen, k, side="right")) - 1)])]
    return out


def _scores(m: float, n: int, v: int, weights: dict[int, float], id_type: pa.DataType):
    by_bucket = _by_bucket(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = _Block(row)
            pair, context, word = _looked_up(b, row, True)
            x = by_bucket[_bucket(context) + 1]
            p = x * pair / np.maximum(context, 1) + (1 - x) * (m * word / max(n, 1) + (1 - m) / (v + 1))
            summed = lambda a: np.add.reduceat(a, b.starts)
            base = summed(np.log10((word + 0.5) / (n + 0.5 * (v + 1))))
            yield pa.record_batch({
                "doc_id": pa.array(row["doc_ids"], id_type),
                "part": pa.array(row["parts"], pa.int32()), "n_tokens": pa.array(b.sizes, pa.int64()), "n_known": pa.array(summed((word > 0).astype(np.int64)), pa.int64()),
                "base_score": pa.array(base, pa.float64()), "score": pa.array(summed(np.log10(p)), pa.float64()),
            })

    return run


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 1, deleted: int = 10) -> DataFrame:
    """One row for each row of ``df``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learned from the texts for which crc32 of the id as text, modulo ``folds``, isn't ``held_out``; of these one in
    ``deleted`` (by the same number, divided by ``folds``) teaches the weights. Tokens are the words, A-Z
    lower-cased, and the end. n_known: tokens that occur in training texts; train_tokens: how many those have.
    base_score: log10 of the unigram probability, half added to each count; score: log10 of the model's. Null text
    is empty and has one token, the end; a null id counts as the empty text. Ids may be repeated. Other columns are
    not read. An empty table gives an empty result.

    Words and pairs are told apart by 64-bit hashes. A task holds a block of texts (one text at least), or the rows
    of a range of hashes from PART_BLOCKS blocks, or of a range from all parts; a block and what falls into a range
    have about the same size whatever the corpus, and their number grows with it.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    n_buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    code = F.crc32(F.coalesce(df[id_col].cast("string"), F.lit("")))
    part = F.when(code % folds == held_out, 0).when(F.floor(code / folds) % deleted == 0, 2).otherwise(1)
    texts = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"), part.cast("int").alias("part"))
    blocks = write_bucketed(texts.mapInArrow(_to_blocks(BLOCK_TOKENS), f"block long, doc_ids array<{kind}>, parts array<int>, sizes array<int>, hashes binary, codes binary"), "texts")
    n_tokens, n_blocks = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.count("*")).first()
    n_ranges = max(n_buckets, -(-(n_tokens or 0) // RANGE_HASHES))

    rows = blocks.mapInArrow(_to_ranges(n_ranges), _ASKED)
    sums = write_bucketed(_range_sums(rows, max(1, -(-n_blocks // PART_BLOCKS))).repartition(n_buckets, "block"), "sums")
    totals = sums.filter("totals is not null")
    n, n_all, v, v_all = (x or 0 for x in totals.agg(*[F.sum(f"totals.{k}") for k in ("n", "n_all", "v", "v_all")]).first())
    seen = totals.select(F.explode("totals.seen").alias("s")).groupBy("s.count").agg(F.sum("s.times").alias("times")).collect()  # some thousand rows at most
    counts, times = np.array([r["count"] for r in seen], float), np.array([r["times"] for r in seen], float)
    m = mixture_weight(counts / max(n, 1) * (v + 1), times)

    back = sums.groupBy("block").agg(F.collect_list(F.struct("range", "word_n", "word_d", "pair_n", "pair_d")).alias("parts_back"))
    both = blocks.join(back, "block", "left")
    bins = both.mapInArrow(_deleted_bins(m, n, v), "bucket long, bin long, times long").groupBy("bucket", "bin").agg(F.sum("times").alias("times")).collect()  # buckets by bins: some ten thousand rows at most
    weights = {}
    for k in {r.bucket for r in bins}:
        own = [r for r in bins if r.bucket == k]
        ratios = np.array([0.0 if r.bin == _NEVER else np.exp((r.bin + 0.5) / STEPS) for r in own])
        weights[k] = mixture_weight(ratios, np.array([r.times for r in own], float))
    found = both.mapInArrow(_scores(m, n_all, v_all, weights, to_arrow_type(df.schema[id_col].dataType)), f"doc_id {kind}, part int, n_tokens long, n_known long, base_score double, score double")
    return found.select("doc_id", (F.col("part") == 0).alias("held_out"), "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")

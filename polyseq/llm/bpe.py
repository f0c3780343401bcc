"""Byte-level BPE encoding and decoding over a table of distinct words.

Spark splits the texts into the tokenizer's words. The texts of a task become blocks: the distinct words, and for
each text the numbers of its words. The blocks are written as a table bucketed by block; each sends its distinct
words, once, to the cells of hashes that they belong to. A task has some cells that lie side by side, and goes through
the requests of these one after the other; it encodes each distinct word of the corpus when it first meets it, joins
the ids with the id-to-piece table to decode them, and answers from what it has from then on. The ids go back to the
blocks that asked, where they take the places of the words. Neither texts nor blocks are shuffled, and a frequent
word moves once a block. There are as many cells as tasks, and a fixed number at least: a task has its share of the
words that are asked for, however many they are, and a block sends at most one row for each word.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyseq.llm._shared import give_back, new_block, pack_numbers, pack_planes, partitions_for, range_of, string_hashes, unpack_numbers, unpack_planes, write_bucketed

#: White space as the tokenizer has it; Java's \s is ASCII only.
_WS = r"\x09-\x0D\x20\x85\xA0  -     　"
#: Code points without a category for this Java; the tokenizer's tables may be newer.
_UNKNOWN = r"\p{Cn}"
#: Most words in a block of texts (one text alone may have more), and bytes of words that a task is asked for, about.
BLOCK_WORDS, ASKED_BYTES = 1_000_000, 8_000_000
#: Least number of cells of hashes; more where more tasks are needed.
CELLS = 1 << 10


def split_pattern(special: list[str]) -> str:
    """The split of byte-level BPE as a Java pattern, with the special strings as words of their own."""
    s = "|".join(r"\Q" + x + r"\E" for x in special) or "(?!)"
    words = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?(?:(?!{s})[^{_WS}\p{{L}}\p{{N}}])+"
    return rf"{s}|{words}|[{_WS}]+(?={s})|[{_WS}]+(?![^{_WS}])|[{_WS}]+"


def words_of(text: Column, special: list[str]) -> Column:
    """The tokenizer's words of a text, which put together are the text; null has none.

    A text with code points that Java doesn't know is one word: the library splits it where its ids are made.
    """
    return F.when(text.rlike(_UNKNOWN), F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(split_pattern(special)), F.lit(0)))


def special_strings(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [x["content"] for x in json.load(f)["added_tokens"]]


def _byte_of_char() -> dict[str, int]:
    """The bytes by the characters that stand for them in the vocabulary: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def id_pieces(path: str) -> pa.Array:
    """The id-to-piece table of a tokenizer file: the bytes of each id, in order; as many as the vocabulary has."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    chars = _byte_of_char()
    found = {i: bytes(chars[c] for c in piece) for piece, i in spec["model"]["vocab"].items() if all(c in chars for c in piece)}
    found |= {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
    return pa.array([found.get(i, b"") for i in range(max(found) + 1)], pa.large_binary())


def _packed_strings(x: pa.Array) -> tuple[bytes, bytes]:
    offsets, flat = _flat(x)
    return pack_numbers(np.diff(offsets)), flat.tobytes()


def _flat(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    x = pa.array(x.cast(pa.large_binary()))
    offsets = np.frombuffer(x.buffers()[1], np.int64, len(x) + x.offset + 1)[x.offset :]
    data = x.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], flat[offsets[0] : offsets[-1]]


def _strings(sizes: bytes, flat: bytes) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(unpack_numbers(sizes))]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat)])


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1 and so on, sizes[0] of them, then those from starts[1] on."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _to_blocks(block_words: int):
    def block(batch: pa.RecordBatch, sizes: np.ndarray) -> pa.RecordBatch:
        coded = batch.column(1).flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        order = np.argsort(-np.bincount(codes, minlength=len(coded.dictionary)), kind="stable")
        rank = np.empty(len(order), "<u4")
        rank[order] = np.arange(len(order))
        word_sizes, words = _packed_strings(coded.dictionary.take(pa.array(order)))
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.record_batch({
            "block": pa.array([new_block()], pa.int64()), "word_sizes": pa.array([word_sizes], pa.binary()), "words": pa.array([words], pa.binary()),
            "doc_ids": one(batch.column(0)), "sizes": one(pa.array(sizes, pa.int32())), "codes": pa.array([pack_planes(rank[codes])], pa.binary()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, at = np.cumsum(sizes), 0
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + block_words, side="right")))
                yield block(batch.slice(at, to - at), sizes[at:to])
                give_back()
                at = to

    return run


def _by_hash(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The order of the words by hash, and their hashes in that order."""
    hashes = string_hashes(*_flat(words))
    order = np.argsort(hashes, kind="stable")
    return order, hashes[order]


def _to_cells(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words = _strings(batch.column(1)[k].as_py(), batch.column(2)[k].as_py())
                order, hashes = _by_hash(words)
                cells, first = np.unique(range_of(hashes, n), return_index=True)
                packed = [_packed_strings(words.take(pa.array(own))) for own in np.split(order, first[1:])] if len(order) else []
                yield pa.record_batch({
                    "cell": pa.array(cells.astype(np.int32)), "block": pa.array(np.full(len(cells), batch.column(0)[k].as_py(), np.int64)),
                    "word_sizes": pa.array([x for x, _ in packed], pa.binary()), "words": pa.array([x for _, x in packed], pa.binary()),
                })

    return run


_BACK = "block long, cell int, counts binary, ids binary, others array<struct<at:int,text:binary>>"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The library's tokenizer, once a worker, and on the one core that a task has."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class _Grown:
    """An array that numbers are added to; room is doubled as it fills up."""

    def __init__(self, kind):
        self.room, self.n = np.zeros(1 << 12, kind), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.room):
            self.room = np.concatenate([self.room[: self.n], np.zeros(max(self.n, len(x)), self.room.dtype)])
        self.room[self.n : self.n + len(x)] = x
        self.n += len(x)

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.n]


class _Encoded:
    """The distinct words met so far: the number of each, its ids, and what they decode to where that isn't the word."""

    def __init__(self, path: str, pieces: pa.Array):
        self.tokenizer, self.pieces = _tokenizer(path), pieces
        self.number: dict[bytes, int] = {}
        self.changed: dict[int, bytes] = {}
        self.ids, self.starts, self.counts = _Grown(np.int32), _Grown(np.int64), _Grown(np.int32)

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The number of each word; those not met before are encoded now."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary
        found = np.array([self.number.get(w, -1) for w in distinct.to_pylist()], np.int64)
        new = np.flatnonzero(found < 0)
        for k in range(0, len(new), 5_000):
            self._encode(distinct.take(pa.array(new[k : k + 5_000])), found, new[k : k + 5_000])
        return found[coded.indices.to_numpy()]

    def _encode(self, words: pa.Array, found: np.ndarray, at: np.ndarray) -> None:
        encoded = [x.ids for x in self.tokenizer.encode_batch_fast(words.cast(pa.large_string()).to_pylist(), add_special_tokens=False)]
        counts = np.array([len(x) for x in encoded], np.int64)
        ids = np.array([i for x in encoded for i in x], np.int64)
        ends = np.cumsum(counts)
        first = len(self.number)
        found[at] = np.arange(first, first + len(at))
        self.number.update(zip(words.to_pylist(), found[at].tolist(), strict=True))
        self.starts.add(self.ids.n + ends - counts)
        self.counts.add(counts)
        self.ids.add(ids)
        # the id-to-piece join: each id meets its piece, and the pieces of a word lie end to end
        offsets, flat = _flat(self.pieces.take(pa.array(ids)))
        bounds = offsets[np.append(ends - counts, len(ids))]
        decoded = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(flat.tobytes())])
        for k in np.flatnonzero(~pc.equal(decoded, words).to_numpy(zero_copy_only=False)).tolist():
            self.changed[first + k] = decoded[k].as_py()


def _encode_cells(path: str, pieces: Broadcast):
    """The words that blocks ask of the cells of a task, to their ids, in the order in which each block asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Encoded(path, pieces.value)
        for batch in batches:
            sizes = [unpack_numbers(x.as_py()) for x in batch.column("word_sizes")]
            offsets = np.concatenate([[0], np.cumsum(np.concatenate([*sizes, np.zeros(0, np.int64)]))]).astype(np.int64)
            flat = b"".join(x.as_py() for x in batch.column("words"))
            numbers = known.numbers(pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat)]))
            counts = known.counts.values[numbers].astype(np.int64)
            ids = known.ids.values[_ragged(known.starts.values[numbers], counts)]
            ends = np.cumsum([len(x) for x in sizes])
            id_ends = np.concatenate([[0], np.cumsum(counts)])[ends]
            others: list[list[dict]] = [[] for _ in sizes]
            if known.changed:
                for k in np.flatnonzero(np.isin(numbers, [*known.changed])).tolist():
                    row = int(np.searchsorted(ends, k, side="right"))
                    others[row].append({"at": k - int(ends[row]) + len(sizes[row]), "text": known.changed[int(numbers[k])]})
            yield pa.record_batch({
                "block": batch.column("block"), "cell": batch.column("cell"), "counts": pa.array([pack_numbers(x) for x in np.split(counts, ends[:-1])], pa.binary()), "ids": pa.array([pack_numbers(x) for x in np.split(ids, id_ends[:-1])], pa.binary()),
                "others": pa.array(others, pa.list_(pa.struct([("at", pa.int32()), ("text", pa.binary())]))),
            })
        del known
        give_back()

    return run


def _assemble(rows_words: int = 100_000):
    """A block and what came back for it to (id, ids, text) for each text of the block."""

    def parts(row: dict) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        words = _strings(row["word_sizes"], row["words"])
        order, _ = _by_hash(words)
        back = sorted(row["parts"] or [], key=lambda p: p["cell"])
        n = np.concatenate([unpack_numbers(p["counts"]) for p in back] or [np.zeros(0, np.int64)])
        ids = np.concatenate([unpack_numbers(p["ids"]).astype(np.int32) for p in back] or [np.zeros(0, np.int32)])
        if len(n) != len(words):
            raise ValueError(f"{len(words)} words in a block, {len(n)} came back")
        counts, starts = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        counts[order], starts[order] = n, np.cumsum(n) - n
        if any(p["others"] for p in back):
            first = np.cumsum([0, *(len(unpack_numbers(p["counts"])) for p in back)])
            changed = {int(order[first[k] + x["at"]]): x["text"] for k, p in enumerate(back) for x in p["others"]}
            words = pa.array([changed.get(k, x) for k, x in enumerate(words.to_pylist())], pa.large_binary())
        return words, counts, starts, ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                row = batch.slice(b, 1)
                words, counts, starts, ids = parts({k: row[k][0].as_py() for k in ("word_sizes", "words", "parts")})
                codes, sizes, doc_ids = unpack_planes(row["codes"][0].as_py()), row["sizes"][0].values.to_numpy(), row["doc_ids"][0].values
                ends, at = np.cumsum(sizes, dtype=np.int64), 0
                while at < len(sizes):
                    before = int(ends[at - 1]) if at else 0
                    to = max(at + 1, int(np.searchsorted(ends, before + rows_words, side="right")))
                    own, bounds = codes[before : ends[to - 1]], np.concatenate([[before], ends[at:to]]) - before
                    each = counts[own]
                    offsets, flat = _flat(words.take(pa.array(own)))
                    whole = pa.Array.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer(offsets[bounds].tobytes()), pa.py_buffer(flat)])
                    try:
                        text = whole.cast(pa.large_string())
                    except pa.ArrowInvalid:  # bytes that aren't UTF-8 together are replaced, as the library does
                        text = pa.array([x.decode("utf-8", "replace") for x in whole.to_pylist()], pa.large_string())
                    id_bounds = np.concatenate([[0], np.cumsum(each)])[bounds].astype(np.int32)
                    listed = pa.ListArray.from_arrays(pa.array(id_bounds), pa.array(ids[_ragged(starts[own], each)]))
                    yield pa.record_batch({"doc_id": doc_ids.slice(at, to - at), "ids": listed, "text": text.cast(pa.string())})
                    at = to
                give_back()

    return run


def encode_and_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each row of ``df``: doc_id, ids (array of int), text (what the ids decode to).

    ids are what the tokenizers library gives for the whole text with add_special_tokens=False and neither
    truncation nor padding, text what decode(ids, skip_special_tokens=False) gives. Null and empty texts have no
    ids and decode to the empty text. Ids may be null or repeated. Other columns are not read. The broadcast table
    has one row for each id of the vocabulary, whatever the corpus.

    An empty table gives an empty result.

    path: the tokenizer file, at the same place on each executor. block_words: most words in a block of texts; a
    text with more is a block by itself. A task holds a block, or the distinct words of its cells, for which about
    ASKED_BYTES are asked whatever the corpus.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    split = df.select(df[id_col].alias("doc_id"), words_of(df[text_col], special_strings(path)).alias("words"))
    blocks = write_bucketed(split.mapInArrow(_to_blocks(block_words), f"block long, word_sizes binary, words binary, doc_ids array<{kind}>, sizes array<int>, codes binary"), "blocks")
    asked = blocks.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    n = partitions_for(spark, asked, ASKED_BYTES)
    cells = max(CELLS, n)
    rows = blocks.select("block", "word_sizes", "words").mapInArrow(_to_cells(cells), "cell int, block long, word_sizes binary, words binary")
    task = F.floor(F.col("cell").cast("long") * n / cells).cast("int")
    back = rows.repartitionById(n, task).mapInArrow(_encode_cells(path, spark.sparkContext.broadcast(id_pieces(path))), _BACK)
    back = back.groupBy("block").agg(F.collect_list(F.struct("cell", "counts", "ids", "others")).alias("parts"))
    return blocks.join(back, "block", "left").select("word_sizes", "words", "doc_ids", "sizes", "codes", "parts").mapInArrow(_assemble(), f"doc_id {kind}, ids array<int>, text string")

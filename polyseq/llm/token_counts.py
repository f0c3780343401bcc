"""Exact token counts at every prefix, by dynamic programming over prefixes.

The BPE encoding of a prefix ends with the one token t for which the encoding of what stands before it ends with a
token p such that p and t stay apart when their bytes are encoded together. So the last token and the count of each
prefix follow from shorter prefixes, and nothing is encoded anew. The distinct words of a task form a trie, whose
nodes are the distinct prefixes; its levels are worked through with arrays. Texts add up the counts of their words.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyseq.llm.bpe import _UNKNOWN, _byte_of_char, special_strings, words_of

#: Longer words, in bytes, take the plain loop; the arrays of the trie have this width.
WIDE = 64
#: Distinct words that go into a trie together.
TRIE_WORDS = 100_000
_MULT, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)
_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)


class _Lookup:
    """64-bit keys to small numbers, many at a time: open addressing with linear probes; -1 if absent."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(len(keys)).bit_length() + 2))
        size = 1 << (64 - int(self.shift))
        self.keys, self.values, self.mask = np.full(size, _FREE), np.full(size, -1, np.int32), size - 1
        for key, value, slot in zip(keys.tolist(), values.tolist(), self._slots(keys).tolist(), strict=True):
            while self.values[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.values[slot] = key, value

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULT) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slots(keys)
        found = np.where(self.keys[slots] == keys, self.values[slots], -1)
        left = np.flatnonzero((self.keys[slots] != keys) & (self.values[slots] >= 0))
        while len(left):
            slots[left] = (slots[left] + 1) & self.mask
            at = slots[left]
            hit = self.keys[at] == keys[left]
            found[left[hit]] = self.values[at[hit]]
            left = left[~hit & (self.values[at] >= 0)]
        return found


class Merges:
    """The merges of a tokenizer file. Tokens are numbered: bytes 0 to 255, then merges by rank."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)["model"]
        chars = _byte_of_char()
        number = {c: b for c, b in chars.items()}
        self.bytes = [bytes([b]) for b in range(256)]
        self.left, self.right = list(range(256)), list(range(256))
        for m in spec["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            if a + b not in number:
                number[a + b] = len(self.bytes)
                self.left.append(number[a])
                self.right.append(number[b])
                self.bytes.append(self.bytes[number[a]] + self.bytes[number[b]])
        self.pair = {(self.left[k], self.right[k]): k for k in range(256, len(self.bytes))}
        self.longest = max(map(len, self.bytes))
        model = Tokenizer.from_file(path).model
        whole = {k for piece, k in number.items() if k < 256 or len(model.tokenize(piece)) == 1}  # a token may never arise
        self.token = {self.bytes[k]: k for k in whole}
        self._l, self._r = np.array(self.left), np.array(self.right)
        self._sizes = np.array([*map(len, self.bytes)])
        self._pairs = _Lookup(np.array([a << 32 | b for a, b in self.pair], np.uint64), np.array([*self.pair.values()]))
        kept = sorted(whole)
        self._tokens = _Lookup(np.array([_suffix_hash(self.bytes[k]) for k in kept], np.uint64), np.array(kept))

    def apart(self, a: int, b: int) -> bool:
        """Whether a and b stay two tokens when their bytes are encoded together.

        Goes back in time from (a, b), always undoing the later merge at the boundary; a merge across it that
        ranks before the one undone last would have come first. Of equal merges the left one comes first.
        """
        limit = len(self.bytes)
        while True:
            if self.pair.get((a, b), limit) < limit:
                return False
            if a < 256 and b < 256:
                return True
            if a > b:
                limit, a = a, self.right[a]
            else:
                limit, b = b + 1, self.left[b]

    def _all_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b, limit = a.copy(), b.copy(), np.full(len(a), len(self.bytes))
        good, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            m = self._pairs(x.astype(np.uint64) << np.uint64(32) | y.astype(np.uint64))
            bad = (m >= 0) & (m < limit[live])
            good[live[bad]] = False
            on = ~bad & ((x >= 256) | (y >= 256))
            live, x, y = live[on], x[on], y[on]
            first = x > y
            limit[live] = np.where(first, x, y + 1)
            a[live] = np.where(first, self._r[x], x)
            b[live] = np.where(first, y, self._l[y])
        return good

    def prefix_counts(self, word: bytes) -> list[int]:
        """Token counts of word[:1], word[:2] and so on."""
        last, count = [-1], [0]
        for i in range(1, len(word) + 1):
            for n in range(1, min(i, self.longest) + 1):
                t = self.token.get(word[i - n : i])
                if t is not None and (n == i or self.apart(last[i - n], t)):
                    last.append(t)
                    count.append(count[i - n] + 1)
                    break
        return count[1:]

    def all_prefix_counts(self, words: list[bytes]) -> list[np.ndarray]:
        """:meth:`prefix_counts` of each word."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        short = sorted((k for k, w in enumerate(words) if 0 < len(w) <= WIDE), key=words.__getitem__)
        for k in range(0, len(short), TRIE_WORDS):
            own = short[k : k + TRIE_WORDS]
            table = self._trie_counts([words[i] for i in own])
            for row, i in enumerate(own):
                out[i] = table[row, : len(words[i])]
        for k, w in enumerate(words):
            if len(w) > WIDE:
                out[k] = np.array(self.prefix_counts(w), np.int32)
        return out

    def totals(self, words: list[bytes]) -> np.ndarray:
        """Token count of each word."""
        return np.fromiter((c[-1] if len(c) else 0 for c in self.all_prefix_counts(words)), np.int64, len(words))

    def _trie_counts(self, words: list[bytes]) -> np.ndarray:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        wide = int(sizes.max())
        text = np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in words), np.uint8).reshape(-1, wide)
        counts = np.zeros((len(words), wide), np.int32)
        node = np.zeros((wide + 1, len(words)), np.int32)  # of the prefix of each length, by word
        last: list[np.ndarray] = [np.array([-1], np.int32)]
        count: list[np.ndarray] = [np.array([0], np.int32)]
        for i in range(1, wide + 1):
            live = np.flatnonzero(sizes >= i)
            new = np.ones(len(live), bool)
            new[1:] = (node[i - 1, live[1:]] != node[i - 1, live[:-1]]) | (text[live[1:], i - 1] != text[live[:-1], i - 1])
            node[i, live] = np.cumsum(new) - 1
            rep = live[new]
            end, n_tokens = np.full(len(rep), -1, np.int32), np.zeros(len(rep), np.int32)
            todo, hashes, power = np.arange(len(rep)), np.zeros(len(rep), np.uint64), 1
            for n in range(1, min(i, self.longest) + 1):
                hashes = hashes + (text[rep[todo], i - n].astype(np.uint64) + np.uint64(1)) * np.uint64(power)
                power = power * int(_STEP) % (1 << 64)
                t = self._tokens(hashes)
                hit = np.flatnonzero((t >= 0) & (self._sizes[t] == n))
                if not len(hit):
                    continue
                before = node[i - n, rep[todo[hit]]]
                if n < i:
                    good = self._all_apart(last[i - n][before].astype(np.int64), t[hit].astype(np.int64))
                    hit, before = hit[good], before[good]
                end[todo[hit]], n_tokens[todo[hit]] = t[hit], count[i - n][before] + 1
                left = np.ones(len(todo), bool)
                left[hit] = False
                todo, hashes = todo[left], hashes[left]
                if not len(todo):
                    break
            last.append(end)
            count.append(n_tokens)
            counts[live, i - 1] = n_tokens[node[i, live]]
        return counts


def _suffix_hash(token: bytes) -> int:
    h, power = 0, 1
    for b in reversed(token):
        h, power = (h + (b + 1) * power) % (1 << 64), power * int(_STEP) % (1 << 64)
    return h


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


@lru_cache(maxsize=4)
def _splitter(path: str):
    """The library's splitter and the special strings of a tokenizer file, once a worker."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).pre_tokenizer, special_strings(path)


def _library_words(path: str, text: str) -> list[str]:
    """The words of a text as the library splits it."""
    splitter, special = _splitter(path)
    out = []
    for part in re.split("(" + "|".join(map(re.escape, special)) + ")", text) if special else [text]:
        out += [part] if part in special else [part[a:b] for _, (a, b) in splitter.pre_tokenize_str(part)]
    return [w for w in out if w]


def _prepared(df: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(df[text_col], F.lit(""))
    return df.select(df[id_col].alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.rlike(_UNKNOWN).alias("odd"), words_of(text, special_strings(path)).alias("words"))


def _words(path: str, batch: pa.RecordBatch) -> pa.Array:
    words = batch.column("words")
    if pc.any(batch.column("odd")).as_py():
        words = pa.array([_library_words(path, x[0]) if odd else x for x, odd in zip(words.to_pylist(), batch.column("odd").to_pylist(), strict=True)], pa.list_(pa.string()))
    return words


def _totals(path: str):
    special = {x.encode() for x in special_strings(path)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = _words(path, batch)
            coded = words.flatten().dictionary_encode()
            distinct = coded.dictionary.cast(pa.binary()).to_pylist()
            totals = merges(path).totals(distinct)
            totals[[k for k, w in enumerate(distinct) if w in special]] = 1
            ends = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))
            up_to = np.concatenate([[0], np.cumsum(totals[coded.indices.to_numpy()])])
            n = np.diff(up_to[np.concatenate([[0], ends]).astype(np.int64)])
            yield pa.record_batch({"doc_id": batch.column(0), "n_bytes": batch.column(1), "n_tokens": pa.array(n, pa.int64())})

    return run


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: doc_id, n_bytes (of the UTF-8 text), n_tokens.

    n_tokens is what the tokenizers library gives for the whole text without added special tokens; null and empty
    texts have none. Ids may be null or repeated. Other columns are not read. An empty table gives an empty result.
    path: the tokenizer file, at the same place on each executor.
    """
    kind = df.schema[id_col].dataType.simpleString()
    return _prepared(df, path, id_col, text_col).mapInArrow(_totals(path), f"doc_id {kind}, n_bytes long, n_tokens long")


#: Words whose own prefixes are split in two.
_CONTRACTIONS = ("'re", "'ve", "'ll")


def text_prefix_counts(words: list[str], path: str) -> list[int]:
    """Token counts of the prefixes of a text, of 1, 2 and more code points, given its words.

    A prefix is split like its text but for its end: a run of white space stays whole where no word follows, and
    two letters of a contraction don't make one yet.
    """
    special, found = set(special_strings(path)), merges(path)
    runs = {w: None for w in words} | {a + b[0]: None for a, b in zip(words, words[1:], strict=False) if a.isspace() and b[0].isspace()}
    table = dict(zip(runs, found.all_prefix_counts([w.encode() for w in runs]), strict=True))
    out, before = [], 0
    for k, w in enumerate(words):
        if w in special:
            held = words[k - 1] if k and words[k - 1] not in special else ""  # until it is whole it goes with what stands before it
            less = table[held][-1] if held else 0
            count = lambda x: sum(found.prefix_counts(p.encode())[-1] for p in _library_words(path, x))
            own = [*(count(held + w[:j]) - less for j in range(1, len(w))), 1]
        else:
            at = np.cumsum([len(c.encode()) for c in w]) - 1
            own = table[w][at].tolist()
            if w in _CONTRACTIONS:
                own[1] = own[0] + 1
        out += [before + c for c in own]
        if k and words[k - 1].isspace() and w[0].isspace():
            out[-len(w)] = before - table[words[k - 1]][-1] + table[words[k - 1] + w[0]][-1]
        before += own[-1]
    return out


def truncate(df: DataFrame, path: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: doc_id, n_tokens, kept (the longest prefix of at most ``budget`` tokens), prefix_counts.

    prefix_counts has the token count of each prefix by code points, from which any other budget can be answered. A
    null or empty text has no tokens, the empty text as kept, and no counts. Where several prefixes have as many
    tokens, the longest is kept. Ids may be null or repeated; an empty table gives an empty result.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for words in _words(path, batch).to_pylist():
                counts = text_prefix_counts(words, path)
                fits = np.flatnonzero(np.array(counts) <= budget)
                rows.append((counts[-1] if counts else 0, "".join(words)[: fits[-1] + 1 if len(fits) else 0], counts))
            n, kept, counts = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch({"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "kept": pa.array(kept, pa.string()), "prefix_counts": pa.array(counts, pa.list_(pa.int32()))})

    return _prepared(df, path, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, kept string, prefix_counts array<int>")

"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

The templates' k-grams of words are hashed and winnowed, each template with the k and the window that its length and
the least coverage warrant, into an inverted index. The words of all texts are hashed alike. Where a template has as
many fingerprints around a diagonal as a match must have, it is aligned with the words there, within a band of the
diagonal, and reported if enough of it is matched.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from polyseq.llm._shared import mix, text_bytes, word_hashes
from polyseq.llm.license_texts import TEMPLATES

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_OUTSIDE = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_TURN = np.uint64(0x9E3779B97F4A7C15)
#: Words by which an alignment may leave the diagonal of its hit, at least (as many as may be missing, if those are more); most words of a fingerprint.
BAND, MOST_GRAM = 4, 3


def _lowered(text: bytes) -> list[bytes]:
    return [w.lower() for w in _WORD.findall(text)]


def _grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k words in a row."""
    n = max(len(hashes) - k + 1, 0)
    h = mix(hashes[:n] + _TURN)
    for j in range(1, k):
        h = mix(h ^ hashes[j : n + j])
    return h


def _may_miss(n: int, least: float) -> int:
    return int((1 - least) * n + 1e-9)


@dataclass(frozen=True)
class Template:
    """Words; band: how far an alignment may leave its diagonal; k and window of the winnowing; hits: fingerprints that every match has, at least."""

    name: str
    words: list[bytes]
    band: int
    k: int
    window: int
    hits: int

    @classmethod
    def of(cls, name: str, text: str, least: float) -> Template:
        words = _lowered(text.encode())
        if len(words) < 2:
            raise ValueError(f"template {name} has fewer than two words")
        n, missed = len(words), _may_miss(len(words), least)
        span = max(2, -(-(n - missed) // (missed + 1)))  # so many words in a row are matched, if enough are
        k = min(span, MOST_GRAM)
        window = span - k + 1
        # matched words lie in missed + 1 runs at most; a run of L has (L - span + 1) / window fingerprints or more
        hits = max(1, -(-(n - missed - (span - 1) * (missed + 1)) // window))
        return cls(name, words, max(BAND, missed), k, window, hits)


@dataclass(frozen=True)
class Index:
    """For each k: the sorted fingerprints of that length, and for each a slice of (template, place)."""

    templates: list[Template]
    lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    least: float

    @classmethod
    def build(cls, templates: dict[str, str], least: float) -> Index:
        found = [Template.of(name, text, least) for name, text in templates.items()]
        listed: dict[int, set[tuple[int, int, int]]] = {}
        for t, x in enumerate(found):
            grams = _grams(word_hashes(pa.array([b" ".join(x.words).decode()]), outside=_OUTSIDE)[0], x.k)
            for i in range(len(grams) - x.window + 1):
                at = i + int(grams[i : i + x.window].argmin())
                listed.setdefault(x.k, set()).add((int(grams[at]), t, at))
        lists = {}
        for k, rows in listed.items():
            rows = sorted(rows)
            keys, first = np.unique(np.array([r[0] for r in rows], np.uint64), return_index=True)
            lists[k] = keys, np.append(first, len(rows)), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        return cls(found, lists, least)

    def candidates(self, column: pa.Array) -> dict[int, list[tuple[int, int]]]:
        """By text: the (template, diagonal) that have as many hits within the band as a match must have; a diagonal is a place in the text less one in the template."""
        hashes, sizes = word_hashes(column, outside=_OUTSIDE)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        begins = np.cumsum(sizes) - sizes
        rows = [np.zeros((0, 3), np.int64)]
        for k, (keys, bounds, of, place) in self.lists.items():
            if len(hashes) < k:
                continue
            grams = _grams(hashes, k)
            at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            hit = np.flatnonzero((keys[at] == grams) & (doc[k - 1 :] == doc[: len(grams)]))
            n = (bounds[at[hit] + 1] - bounds[at[hit]]).astype(np.int64)
            listed = np.repeat(bounds[at[hit]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            where = np.repeat(hit, n)
            rows.append(np.column_stack([doc[where], of[listed], where - begins[doc[where]] - place[listed]]))
        x = np.concatenate(rows)
        x = x[np.lexsort((x[:, 2], x[:, 1], x[:, 0]))]
        band, least = (np.array([getattr(t, f) for t in self.templates], np.int64)[x[:, 1]] for f in ("band", "hits"))
        step = np.int64(1) << 33  # parts the diagonals of different texts and templates
        line = (x[:, 0] * len(self.templates) + x[:, 1]) * step + x[:, 2]
        near = np.searchsorted(line, line + band, side="right") - np.searchsorted(line, line - band, side="left")
        out: dict[int, list[tuple[int, int]]] = {}
        for d, t, diagonal in np.unique(x[near >= least], axis=0).tolist():
            out.setdefault(d, []).append((t, diagonal))
        return out

    def find(self, text: bytes, candidates: list[tuple[int, int]]) -> list[dict]:
        """Matches with enough coverage; of overlapping ones of a template the best, then the first. Offsets in code points."""
        spans = [m.span() for m in _WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in spans]
        found = set()
        for t, diagonal in candidates:
            x = self.templates[t]
            low, high = max(0, diagonal - x.band), max(0, diagonal + len(x.words) + x.band)
            near = Counter(words[low:high])
            if sum(min(n, near[w]) for w, n in Counter(x.words).items()) < self.least * len(x.words):
                continue
            n, start, end = align(x.words, words, diagonal, x.band)
            if n >= self.least * len(x.words):
                found.add((-n, start, end, t))
        kept: list[tuple[int, int, int, int]] = []
        for x in sorted(found):
            if all(x[3] != y[3] or x[2] <= y[1] or y[2] <= x[1] for y in kept):
                kept.append(x)
        points = lambda k: len(text[:k].decode("utf-8", "ignore"))
        return [{"license": self.templates[t].name, "coverage": -n / len(self.templates[t].words), "start": points(spans[a][0]), "end": points(spans[b - 1][1])} for n, a, b, t in sorted(kept, key=lambda x: (x[1], x[3]))]


def align(template: list[bytes], words: list[bytes], diagonal: int, band: int) -> tuple[int, int, int]:
    """Most words of the template that match in order words of the text, place i of the one against places within ``band`` of diagonal + i of the other.

    Returns how many, and the first and the one after the last matched word of the text; of equal ones the shortest,
    then the first. Only the part of the text within the band is held, and each word of the template goes over it once.
    """
    low, high = max(0, diagonal - band), min(len(words), diagonal + len(template) + band)
    if low >= high:
        return 0, 0, 0
    places: dict[bytes, list[int]] = {}
    for j in range(low, high):
        places.setdefault(words[j], []).append(j - low)
    at = {w: np.array(p) for w, p in places.items()}
    one = np.int64(1) << 32
    best = np.zeros(high - low, np.int64)  # by last matched place: how many are matched, and from which place on, the latest
    for i, w in enumerate(template):
        if w in at:
            own = at[w]
            own = own[(own >= diagonal + i - band - low) & (own <= diagonal + i + band - low)]
            if len(own):
                before = np.concatenate([[0], np.maximum.accumulate(best)])[own]
                best[own] = np.maximum(best[own], np.where(before > 0, before, own) + one)
    n = best >> 32
    if not n.max():
        return 0, 0, 0
    ends = np.flatnonzero(n == n.max())
    starts = best[ends] & (one - 1)
    k = int(np.argmin(ends - starts))
    return int(n.max()), int(starts[k]) + low, int(ends[k]) + low + 1


def _run(index: Index):
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for at in range(0, batch.num_rows, 256):  # the hashes of a few texts at a time
                part = batch.column(1).slice(at, 256)
                for k, candidates in index.candidates(part).items():
                    found[at + k] = index.find(next(text_bytes(part.slice(k, 1))), candidates)
            yield pa.record_batch({"doc_id": batch.column(0), "licenses": pa.array(found, kind)})

    return run


def find_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """One row for each row of ``df``: doc_id, licenses (license, coverage, start, end in code points; by start, then by template).

    A template is reported where at least the share ``least`` of its words occurs in order, near one diagonal. Every
    place where so many are matched without further words between them is found; words are compared without case
    and without what stands between them. Null and empty texts have none. Ids may be null or repeated. Other
    columns are not read. An empty table gives an empty result. templates: name to text, of two words or more; those
    of license_texts by default.
    """
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    return texts.mapInArrow(_run(Index.build(templates or TEMPLATES, least)), f"doc_id {kind}, licenses array<struct<license:string,coverage:double,start:int,end:int>>")

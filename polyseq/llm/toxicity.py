"""Toxicity by a learned lexicon, matched with spelling errors and weighed by context.

The lexicon is learned from labelled texts: words, and stems with any ending, that toxic texts have and others don't. It
is kept as a trie, and the Levenshtein automata of all its terms run through the trie together: a state holds trie nodes
with the errors made so far, so that one walk over a word finds the terms within its allowed distance. Transitions are
kept when first made; each distinct word is walked once in a task.

What stands around a hit decides how much it counts: quotation marks on both sides, and words that the labelled texts
have rather beside harmless hits, turn it from abuse into a quotation. A text's hits are summed up in a few figures,
and a logistic regression of these on the labels gives the score.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyseq.llm._shared import mix, stage, word_hashes

#: Labelled texts to learn from, about (never over twice as many); terms of the lexicon and context words at most.
SAMPLE, TERMS, CONTEXT_WORDS = 40_000, 2_000, 1_000
#: Shortest word and stem, longest stem; words to either side of a hit that are its context.
LEAST_WORD, STEM, WINDOW = 3, (3, 8), 6
#: Least log likelihood ratio of a term, least ratio of its shares in toxic and other texts, least toxic texts with it.
EVIDENCE, RATIO, LEAST_TEXTS = 12.0, 6.0, 4
#: Share of a term's uses that are taken to be misspelled, and the odds that a quoted hit is abuse, before any is seen.
MISSPELLED, QUOTED_ODDS = 0.02, 0.25
#: Log odds that a hit is abuse that nothing speaks against.
PLAIN = 3.0
_WORD = re.compile(r"[^\W_]+(?:[*@$]+[^\W_]+)*")
_OPEN, _CLOSE = "\"“„«‹「『", "\"”“»›」』"


def errors_allowed(term: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours that a term may be away: none below five letters, two from nine."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, lower-cased; stars, dollar and at signs inside count as letters."""
    return _WORD.findall(text.lower())


@dataclass(frozen=True)
class Term:
    """stem: the text must be followed by more letters, and is met without errors only."""

    text: str
    stem: bool


class Automaton:
    """The Levenshtein automata of all terms over their trie, determined as words are walked.

    A state is a set of (node, errors, due): due is the first letter of a swapped pair whose second letter has been read.
    """

    def __init__(self, terms: list[Term], kept: int = 20_000) -> None:
        self.children, self.ends, self.budget, self.kept = [{}], [[]], [0], kept
        for k, t in enumerate(terms):
            node, allowed = 0, 0 if t.stem else errors_allowed(t.text)
            self.budget[0] = max(self.budget[0], allowed)
            for c in t.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.budget.append(0)
                node = self.children[node][c]
                self.budget[node] = max(self.budget[node], allowed)
            self.ends[node].append((k, t.stem, allowed))
        self.clear()

    def clear(self) -> None:
        self.states, self.numbers, self.steps, self.words, self.stems = [], {}, [], [], []
        self.number(self.closed({(0, 0, "")}))

    def closed(self, state: set) -> frozenset:
        """With every node that leaving letters of a term out leads to; of the same node the fewest errors."""
        todo = list(state)
        while todo:
            node, e, due = todo.pop()
            if not due:
                for child in self.children[node].values():
                    if e < self.budget[child] and (child, e + 1, "") not in state:
                        state.add((child, e + 1, ""))
                        todo.append((child, e + 1, ""))
        least = {}
        for node, e, due in state:
            least[node, due] = min(e, least.get((node, due), e))
        return frozenset((node, e, due) for (node, due), e in least.items())

    def number(self, state: frozenset) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            self.words.append(tuple((k, e) for node, e, due in state if not due for k, stem, allowed in self.ends[node] if not stem and e <= allowed))
            self.stems.append(tuple(k for node, e, due in state if not due and e == 0 for k, stem, _ in self.ends[node] if stem))
        return self.numbers[state]

    def step(self, at: int, c: str) -> int:
        out = set()
        for node, e, due in self.states[at]:
            kids = self.children[node]
            if due:
                if c == due:
                    out.add((node, e, ""))
                continue
            if c in kids:
                out.add((kids[c], e, ""))
            if e < self.budget[node]:
                out.add((node, e + 1, ""))
            for x, child in kids.items():
                if x != c and e < self.budget[child]:
                    out.add((child, e + 1, ""))
                    swapped = self.children[child].get(c)
                    if swapped is not None and e < self.budget[swapped]:
                        out.add((swapped, e + 1, x))
        to = self.steps[at][c] = self.number(self.closed(out))
        return to

    def matches(self, word: str) -> list[tuple[int, int]]:
        """(term, errors) of every term that the word is within reach of; stems that it goes on after."""
        if len(self.states) > self.kept:
            self.clear()
        at, found = 0, []
        for k, c in enumerate(word):
            to = self.steps[at].get(c)
            at = self.step(at, c) if to is None else to
            if self.stems[at] and k + 1 < len(word):
                found += [(x, 0) for x in self.stems[at]]
        return found + list(self.words[at])


@dataclass(frozen=True)
class Lexicon:
    """weights: of each term, in nats, by errors; harmless: words that are no misspelling; beside: context words, in nats; quoted: less the log odds that a quoted hit is abuse."""

    terms: list[Term]
    weights: list[tuple[float, ...]]
    harmless: frozenset = frozenset()
    beside: dict = field(default_factory=dict)
    quoted: float = float(-np.log(QUOTED_ODDS))

    def finder(self) -> Finder:
        return Finder(self)


class Finder(dict):
    """A word to its best (term, errors), or to None."""

    def __init__(self, lexicon: Lexicon, kept: int = 1 << 17) -> None:
        self.lexicon, self.automaton, self.kept = lexicon, Automaton(lexicon.terms), kept

    def __missing__(self, word: str):
        if len(self) > self.kept:
            self.clear()
        best, found = 0.0, None
        forms = {word, re.sub(r"(.)\1{2,}", r"\1", word)} if len(word) <= 64 else {word[:64]}
        for form in forms:
            for k, e in self.automaton.matches(form):
                e = max(e, int(form != word and len(word) <= 64))
                w = self.lexicon.weights[k]
                if e < len(w) and w[e] > best and not (e and word in self.lexicon.harmless):
                    best, found = w[e], (k, e)
        self[word] = found
        return found

    def hits(self, text: str) -> tuple[list[str], list[tuple[int, int, int]]]:
        """The words of a text, and (place, term, errors) of its hits."""
        words = words_of(text)
        return words, [(i, *x) for i, x in enumerate(map(self.__getitem__, words)) if x is not None]


def quoted_places(text: str, places: list[int]) -> set[int]:
    """Which of the words given by number stand within WINDOW words after an opening and before a closing quotation mark, with none of them between."""
    if not any(c in text for c in _OPEN):
        return set()
    spans, marks = [m.span() for m in _WORD.finditer(text.lower())], re.compile(f"[{re.escape(_OPEN + _CLOSE)}]")
    found = set()
    for i in places:
        if i >= len(spans):
            continue
        a, b = spans[i]
        before = text[spans[max(0, i - WINDOW)][0] if i > WINDOW else 0 : a]
        after = text[b : spans[i + WINDOW][1] if i + WINDOW < len(spans) else len(text)]
        left, right = [m[0] for m in marks.finditer(before)], marks.search(after)
        if left and right and left[-1] in _OPEN and right[0] in _CLOSE and (left[-1] != '"' or text[:a].count('"') % 2):
            found.add(i)
    return found


def context_scores(lexicon: Lexicon, text: str, words: list[str], hits: list[tuple[int, int, int]]) -> np.ndarray:
    """For each hit between 0 (a quotation) and 1 (abuse): the logistic function of PLAIN, or in quotation marks of their learned log odds, and the learned weights of the words in its window."""
    if not hits:
        return np.zeros(0)
    quoted, out = quoted_places(text, [i for i, _, _ in hits]), np.empty(len(hits))
    for k, (i, _, _) in enumerate(hits):
        beside = sum(lexicon.beside.get(w, 0.0) for w in set(words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW])) if lexicon.beside else 0.0
        out[k] = min(0.0, max(-4.0, beside)) + (-lexicon.quoted if i in quoted else PLAIN)
    return 1.0 / (1.0 + np.exp(-out))


FIGURES = 5


def figures(lexicon: Lexicon, n_words: int, hits: list[tuple[int, int, int]], contexts: np.ndarray) -> np.ndarray:
    """Of a whole text: log of its weighted hits, their largest weight, log of distinct terms, log of hits in a thousand words, log of quoted hits."""
    if not hits:
        return np.zeros(FIGURES)
    weighted = np.array([lexicon.weights[k][e] for _, k, e in hits]) * contexts
    best: dict[int, float] = {}
    for (_, k, _), c in zip(hits, contexts, strict=True):
        best[k] = max(best.get(k, 0.0), float(c))
    return np.array([np.log1p(weighted.sum()), weighted.max(), np.log1p(sum(best.values())), np.log1p(1000 * contexts.sum() / n_words), np.log1p((1 - contexts).sum())])


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float


def _plain(column: pa.Array) -> Iterator[str]:
    for x in column:
        yield x.as_py() or ""


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three least hashes of the word triples of each text, by which near copies are told."""
    for batch in batches:
        hashes, sizes = word_hashes(batch.column(1))
        ends, out = np.cumsum(sizes), np.zeros((len(sizes), 3), np.uint64)
        for k, (end, n) in enumerate(zip(ends, sizes, strict=True)):
            own = hashes[end - n : end]
            own = mix(mix(own[:-2] + np.uint64(1)) + mix(own[1:-1] + np.uint64(2)) + own[2:]) if n >= 3 else np.array([mix(own + np.uint64(3)).sum(dtype=np.uint64)])
            out[k] = [mix(own ^ np.uint64(0x9E3779B97F4A7C15 * (j + 1) % (1 << 64))).min() for j in range(3)]
        yield pa.record_batch({"rid": batch.column(0), "toxic": batch.column(2), **{f"h{j}": pa.array(out[:, j].view(np.int64)) for j in range(3)}})


def _apart(sample: DataFrame) -> DataFrame:
    """``sample`` (id, text, toxic, rid) without near copies of the same label: groups of copies would make all their words look like terms. Goes by three sketches a text, which the driver gets (2 * sample rows at most)."""
    x = sample.select("rid", "text", "toxic").mapInArrow(_sketches, "rid long, toxic int, h0 long, h1 long, h2 long").toArrow().sort_by("rid")
    first = np.ones(len(x), bool)
    toxic = x["toxic"].to_numpy()
    for j in range(3):
        own = np.zeros(len(x), bool)
        own[np.unique(np.stack([x[f"h{j}"].to_numpy(), toxic], axis=1), axis=0, return_index=True)[1]] = True
        first &= own
    rids = sample.sparkSession.createDataFrame(pa.table({"rid": x["rid"].filter(pa.array(first))}))
    return stage(sample.join(F.broadcast(rids), "rid", "left_semi"), "apart")


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other texts each word (kind 0) and each stem with an ending (kind 1) is; sent on when many."""

    def told(counts: dict) -> pa.RecordBatch:
        keys = list(counts)
        return pa.record_batch({"term": pa.array([t for t, _ in keys], pa.string()), "stem": pa.array([s for _, s in keys], pa.bool_()), "pos": pa.array([counts[k][1] for k in keys], pa.int64()), "neg": pa.array([counts[k][0] for k in keys], pa.int64())})

    counts: dict = {}
    for batch in batches:
        for text, toxic in zip(_plain(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            words = {w for w in words_of(text) if len(w) >= LEAST_WORD}
            stems = {w[:n] for w in words for n in range(STEM[0], min(STEM[1], len(w) - 1) + 1)}
            for own, stem in ((words, False), (stems, True)):
                for w in own:
                    counts.setdefault((w[:64], stem), [0, 0])[toxic] += 1
            if len(counts) > 200_000:
                yield told(counts)
                counts = {}
    yield told(counts)


def choose_terms(rows: list[tuple[str, bool, int, int]], n_pos: int, n_neg: int) -> list[tuple[Term, int, int]]:
    """Of (text, stem, toxic texts, other texts) those that make the lexicon, strongest first.

    A stem that nearly always goes on to one longer stem or word gives way to that; words and stems that begin with a
    chosen stem that tells as much are left out.
    """
    most: dict[str, int] = {}
    for text, stem, pos, _ in rows:
        for n in range(STEM[0], len(text) + (0 if stem else 1)):
            if n < len(text):
                most[text[:n]] = max(most.get(text[:n], 0), pos)
    chosen: dict[str, tuple[int, int]] = {}
    out = []
    for text, stem, pos, neg in sorted(rows, key=lambda r: (not r[1], len(r[0]), r[0])):
        if stem and pos - most.get(text, 0) < max(3, 0.1 * pos):
            continue
        under = [chosen[text[:n]] for n in range(STEM[0], min(len(text), STEM[1] + 1)) if text[:n] in chosen]
        if any((p + 1) / (q + 1) >= 0.5 * (pos + 1) / (neg + 1) for p, q in under):
            continue
        if stem:
            chosen[text] = (pos, neg)
        out.append((Term(text, stem), pos, neg))
    return sorted(out, key=lambda r: (-_gain(r[1], r[2], n_pos, n_neg), r[0].text, r[0].stem))[:TERMS]


def _gain(pos: int, neg: int, n_pos: int, n_neg: int) -> float:
    share = (pos + neg) / (n_pos + n_neg)
    return pos * np.log(max(pos / n_pos, 1e-12) / share) + (neg * np.log(neg / n_neg / share) if neg else 0.0)


def learn_lexicon(sample: DataFrame) -> Lexicon | None:
    """From ``sample`` (text, toxic 0 or 1, without near copies): terms, their weights, harmless words, context; None where nothing tells."""
    n_neg, n_pos = sample.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    if not n_pos or not n_neg:
        return None
    counted = sample.select("text", "toxic").mapInArrow(_candidates, "term string, stem boolean, pos long, neg long").groupBy("term", "stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    p, q = F.col("pos"), F.col("neg")
    share = (p + q) / (n_pos + n_neg)
    gain = p * F.log(p / n_pos / share) + F.when(q > 0, q * F.log(q / n_neg / share)).otherwise(0.0)
    strong = counted.filter((p >= LEAST_TEXTS) & (p * n_neg >= RATIO * q * n_pos)).withColumn("gain", gain).filter(F.col("gain") >= EVIDENCE)
    rows = strong.orderBy(F.desc("gain"), "term", "stem").limit(8 * TERMS).collect()
    terms = choose_terms([(r.term, r.stem, r.pos, r.neg) for r in rows], n_pos, n_neg)
    if not terms:
        return None
    ratio = lambda pos, neg: float(np.clip(np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1)), 0.0, 6.0))
    exact = [ratio(pos, neg) for _, pos, neg in terms]
    wide = Lexicon([t for t, _, _ in terms], [(w,) * (1 if t.stem else errors_allowed(t.text) + 1) for w, (t, _, _) in zip(exact, terms, strict=True)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Misspelled forms by text, and the words beside hits: kind, term, errors, word, and texts by label."""
        counts, finder = defaultdict(lambda: [0, 0]), wide.finder()
        for batch in batches:
            for text, toxic in zip(_plain(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                words, hits = finder.hits(text)
                for key in {(0, k, e, words[i]) for i, k, e in hits if e}:
                    counts[key][toxic] += 1
                for w in {w for i, _, e in hits if not e for w in words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]}:
                    counts[1, -1, 0, w][toxic] += 1
                quoted = quoted_places(text, [i for i, _, e in hits if not e])
                if hits:
                    counts[2, -1, int(bool(quoted)), ""][toxic] += 1
        keys = list(counts)
        columns = list(zip(*[(*k, counts[k][1], counts[k][0]) for k in keys], strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["kind", "term", "errors", "word", "pos", "neg"])

    scanned = stage(sample.select("text", "toxic").mapInArrow(scan, "kind long, term long, errors long, word string, pos long, neg long").groupBy("kind", "term", "errors", "word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "scanned")
    # forms that several other texts have, and toxic ones not much rather, are words of their own; those of one text tell how often a new text brings a new one
    harmless = [r.word for r in scanned.filter((F.col("kind") == 0) & (F.col("neg") > 1) & (F.col("pos") * n_neg < RATIO * F.col("neg") * n_pos)).orderBy(F.desc("neg"), "word").limit(50 * TERMS).select("word").distinct().collect()]
    rare = {(r.term, r.errors): (r.pos, r.neg) for r in scanned.filter((F.col("kind") == 0) & (F.col("neg") <= 1)).groupBy("term", "errors").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()}
    weights = []
    for k, (t, pos, _) in enumerate(terms):
        own = [exact[k]]
        for e in range(1, 1 if t.stem else errors_allowed(t.text) + 1):
            a, b = rare.get((k, e), (0, 0))
            own.append(min(own[-1], float(np.clip(np.log((a + MISSPELLED * pos + 0.05) / n_pos) - np.log((b + 0.25) / n_neg), 0.0, 6.0))))
        weights.append(tuple(own))
    seen = {(r.kind, r.errors): (r.pos, r.neg) for r in scanned.filter("kind = 2").collect()}
    (qp, qn), (up, un) = seen.get((2, 1), (0, 0)), seen.get((2, 0), (0, 0))
    base = (up + 1) / (un + 1)
    quoted = float(np.clip(np.log(base) - np.log((qp + 4 * QUOTED_ODDS * base / (1 + QUOTED_ODDS * base)) / (qn + 4 / (1 + QUOTED_ODDS * base))), 0.0, 4.0))
    tilt = F.log((F.col("pos") + 8.0) / (F.col("neg") * base + 8.0))
    beside = scanned.filter((F.col("kind") == 1) & (F.col("neg") >= 8)).select("word", tilt.alias("t")).filter("t < -0.7").orderBy("t", "word").limit(CONTEXT_WORDS).collect()
    return Lexicon(wide.terms, weights, frozenset(harmless), {r.word: r.t for r in beside}, quoted)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, least: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's rule with a square penalty on the weights; weights below ``least`` are held there."""
    z, beta, held = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1, bool)
    least = np.append(np.full(x.shape[1], -np.inf) if least is None else least, -np.inf)
    ridge = np.append(np.full(x.shape[1], penalty), 1e-6)
    for _ in range(200):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ beta, -500, 500)))
        slope, free = z.T @ (y - p) - ridge * beta, ~held
        curve = (z[:, free] * (p * (1 - p))[:, None]).T @ z[:, free] + np.diag(ridge[free] + 1e-9)
        step = np.zeros_like(beta)
        step[free] = np.linalg.solve(curve, slope[free])
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        beta = beta + step
        low = beta < least
        beta[low], held = least[low], held | low
        if np.abs(step).max() < 1e-8:
            break
    return beta[:-1], float(beta[-1])


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model | None:
    """The model from about ``sample`` labelled texts, taken by a hash of the id; None without labels of both kinds. Labels other than 0 and 1, and those of a null id, are left out; an id with both counts as toxic."""
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    cut = min((1 << 63) - 1, (sample << 64) // max(known.count(), 1) - (1 << 63))
    known = known.filter(F.xxhash64("id") <= cut).orderBy(F.xxhash64("id"), "id").limit(2 * sample)
    texts = df.select(df[id_col].alias("id"), df[text_col].alias("text")).join(F.broadcast(known), "id").withColumn("rid", F.monotonically_increasing_id())
    chosen = _apart(stage(texts, "labelled"))
    lexicon = learn_lexicon(chosen)
    if lexicon is None:
        return None

    def figured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = lexicon.finder()
        for batch in batches:
            found = [(t, *finder.hits(t)) for t in _plain(batch.column(0))]
            x = np.array([figures(lexicon, len(words), hits, context_scores(lexicon, t, words, hits)) for t, words, hits in found]).reshape(-1, FIGURES)
            yield pa.record_batch([batch.column(1), *map(pa.array, x.T)], names=["toxic", *[f"x{k}" for k in range(FIGURES)]])

    rows = chosen.select("text", "toxic").mapInArrow(figured, "toxic int, " + ", ".join(f"x{k} double" for k in range(FIGURES))).toArrow()
    x = np.stack([rows[f"x{k}"].to_numpy() for k in range(FIGURES)], axis=1)
    least = np.array([0.0] * (FIGURES - 1) + [-np.inf])  # more abuse never lowers a score
    return Model(lexicon, *logistic(x, rows["toxic"].to_numpy().astype(float), least=least))


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """One row for each row of ``df``: doc_id, score (0 to 1), hits (array of term, word, place, context).

    Whole texts are read; place is the number of the word, context 0 for a quotation to 1 for abuse. Null and empty
    texts, and texts without hits, have the score of no hits. Without labels of both kinds every score is the share of
    toxic ones (0 without any) and there are no hits; where nothing tells toxic texts apart likewise. Ids may be null
    or repeated: rows alike have scores alike. Other columns are not read. An empty table gives an empty result.
    """
    kind, texts = df.schema[id_col].dataType.simpleString(), df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    model = fit(df, labels, id_col, text_col, label_col, sample)
    if model is None:
        known = labels.select(labels[label_col].cast("int").alias("t")).filter("t in (0, 1)").agg(F.avg("t")).first()[0] or 0.0
        return texts.select("doc_id", F.lit(float(known)).alias("score"), F.array().cast("array<struct<term:string,word:string,place:int,context:double>>").alias("hits"))
    lexicon = model.lexicon
    names = [t.text + ("*" if t.stem else "") for t in lexicon.terms]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = lexicon.finder()
        hit = pa.struct([("term", pa.string()), ("word", pa.string()), ("place", pa.int32()), ("context", pa.float64())])
        for batch in batches:
            scores, found = [], []
            for text in _plain(batch.column(1)):
                words, hits = finder.hits(text)
                c = context_scores(lexicon, text, words, hits)
                found.append([{"term": names[k], "word": words[i][:64], "place": i, "context": float(x)} for (i, k, _), x in zip(hits, c, strict=True)])
                z = model.bias + figures(lexicon, len(words), hits, c) @ model.weights
                scores.append(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))
            yield pa.record_batch({"doc_id": batch.column(0), "score": pa.array(scores, pa.float64()), "hits": pa.array(found, pa.list_(hit))})

    return texts.mapInArrow(run, f"doc_id {kind}, score double, hits array<struct<term:string,word:string,place:int,context:double>>")

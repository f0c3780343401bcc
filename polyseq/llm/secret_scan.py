"""Secret scans with one automaton for all rules.

The rules' regular expressions become one nondeterministic automaton, which subset construction and minimisation
turn into a transition array over classes of bytes. It reads each byte once, for all rules; many stretches of text
go through it side by side. Where it accepts, the rules' own small automata take the exact spans from the few bytes
around: no rule can match across a byte that sends every state back to the start.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from polyseq.llm._shared import text_bytes


@dataclass(frozen=True)
class Rule:
    """A match is the longest ``head``, then one or more of the characters ``tail``; it counts with ``least`` of them or more."""

    kind: str
    head: str
    tail: str
    least: int


#: The base kinds, in the order in which they are listed.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]", 6),
    Rule("access", "AKIA", "[A-Z0-9]", 16),
    Rule("hex", "", "[0-9a-f]", 24),
)
#: Published forms of further credentials.
MORE_RULES = (
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]", 10),
    Rule("jwt", "eyJ", "[A-Za-z0-9_.-]", 40),
)
#: Stretches that go through the automaton side by side.
LANES = 8192
#: The common automaton counts this far into a tail; the exact spans' own pass counts the rest.
COUNTED = 8


class _Nfa:
    """Thompson's construction; an edge has the set of bytes it takes."""

    def __init__(self):
        self.free: list[list[int]] = []
        self.edge: list[tuple[np.ndarray, int] | None] = []

    def node(self) -> int:
        self.free.append([])
        self.edge.append(None)
        return len(self.free) - 1

    def add(self, tree, start: int, fold: bool = False) -> int:
        """The node at which what ``tree`` matches from ``start`` on ends."""
        at = start
        for op, arg in tree:
            if op is sre.SUBPATTERN:
                at = self.add(arg[3], at, (fold or bool(arg[1] & 2)) and not arg[2] & 2)
            elif op is sre.BRANCH:
                end = self.node()
                for one in arg[1]:
                    self.free[self.add(one, self.fresh(at), fold)].append(end)
                at = end
            elif op is sre.MAX_REPEAT:
                low, high, what = arg
                for _ in range(low):
                    at = self.add(what, at, fold)
                if high is sre.MAXREPEAT:
                    loop = self.fresh(at)
                    self.free[self.add(what, loop, fold)].append(loop)
                    at = self.fresh(loop)
                else:
                    end = self.node()
                    for _ in range(high - low):
                        self.free[at].append(end)
                        at = self.add(what, self.fresh(at), fold)
                    self.free[at].append(end)
                    at = end
            else:
                node, end = self.fresh(at), self.node()
                self.edge[node] = (_byte_set(op, arg, fold), end)
                at = end
        return at

    def fresh(self, at: int) -> int:
        """A new node, free to reach from ``at``."""
        node = self.node()
        self.free[at].append(node)
        return node


def _byte_set(op, arg, fold: bool) -> np.ndarray:
    found = np.zeros(256, bool)
    if op is sre.IN:
        for kind, what in arg:
            if kind is sre.LITERAL:
                found[what] = True
            elif kind is sre.RANGE:
                found[what[0] : what[1] + 1] = True
            elif kind is not sre.NEGATE:
                raise ValueError(f"not supported in a rule: {kind}")
        if arg[0][0] is sre.NEGATE:
            found = ~found
    elif op is sre.LITERAL:
        found[arg] = True
    else:
        raise ValueError(f"not supported in a rule: {op}")
    if fold:
        for a, b in zip(range(0x41, 0x5B), range(0x61, 0x7B), strict=True):
            found[a] = found[b] = found[a] | found[b]
    return found


class Automaton:
    """Transition array ``step[state * classes + class]``, states given as multiples of ``classes``; 0 is the start.

    States from ``accepting`` on accept. anywhere: a match may begin at any byte, and only its first end is told.
    ``back`` marks the bytes that no match contains, so that they lead from every state to the start.
    """

    def __init__(self, patterns: list[str], anywhere: bool):
        nfa = _Nfa()
        root = nfa.node()
        finals = {nfa.add(sre_parse.parse(p), nfa.fresh(root)) for p in patterns}
        sets = np.array([e[0] for e in nfa.edge if e])
        columns, self.classes_of = np.unique(sets, axis=1, return_inverse=True)
        self.classes_of = self.classes_of.reshape(-1).astype(np.int64)
        n = columns.shape[1]
        sample = [int(np.flatnonzero(self.classes_of == c)[0]) for c in range(n)]

        def closure(nodes) -> frozenset[int]:
            todo, seen = list(nodes), set(nodes)
            while todo:
                for x in nfa.free[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            return frozenset(x for x in seen if nfa.edge[x] or x in finals)

        near = {x: closure([x]) for x in range(len(nfa.free))}
        first = near[root]
        number, todo, rows = {first: 0}, [first], []
        while len(rows) < len(todo):
            state = todo[len(rows)]
            moves = [nfa.edge[x] for x in state if nfa.edge[x]]
            if anywhere and state & finals:  # the hit is told; what follows is read as from the start
                rows.append(rows[0])
                continue
            row = []
            for b in sample:
                to = frozenset().union(*(near[end] for took, end in moves if took[b]), first if anywhere else ())
                if anywhere and to & finals:
                    to = frozenset(finals)
                if to not in number:
                    number[to] = len(todo)
                    todo.append(to)
                row.append(number[to])
            rows.append(row)
        table, accepts = np.array(rows), np.array([bool(s & finals) for s in todo])
        part = accepts.astype(np.int64)
        while True:  # minimisation: states stay together while their successors do
            _, finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)
            finer = finer.reshape(-1)
            if finer.max() == part.max():
                break
            part = finer
        order = sorted(range(part.max() + 1), key=lambda p: (accepts[part == p][0], p != part[0]))
        rank = np.argsort(order)
        least = [int(np.flatnonzero(part == p)[0]) for p in order]
        table = rank[part[table[least]]]
        self.size, self.step = len(order), (table * n).astype(np.int32).ravel()
        self.accepting = int((~accepts[least]).sum()) * n
        self.dead = {k * n for k in range(self.size) if k * n < self.accepting and (table[k] == k).all()}
        self.back = ~sets.any(axis=0)

    def longest(self, text: bytes, at: int) -> int:
        """End of the longest match that begins at ``at``; -1 if none."""
        state, end = 0, -1
        for k in range(at, len(text)):
            state = int(self.step[state + self.classes_of[text[k]]])
            if state >= self.accepting:
                end = k + 1
            elif state in self.dead:
                break
        return end

    def accepts_at(self, flat: np.ndarray, lanes: int = LANES) -> np.ndarray:
        """Positions of ``flat`` after whose byte a match ends."""
        if not len(flat):
            return np.zeros(0, np.int64)
        classes = self.classes_of.astype(np.uint8)[flat]
        cuts = np.flatnonzero(self.back[flat]) + 1  # here the state is the start, whatever came before
        ideal = np.linspace(0, len(flat), min(lanes, len(flat) // 64 + 1) + 1)[1:-1]
        at = np.searchsorted(cuts, ideal)
        starts = np.unique(np.concatenate([[0], cuts[at[at < len(cuts)]]]))
        sizes = np.diff(np.append(starts, len(flat)))
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        live = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # lanes longer than k
        state, found = np.zeros(len(starts), np.int32), []
        for k, n in enumerate(live.tolist()):
            s = self.step[state[:n] + classes[starts[:n] + k]]
            state[:n] = s
            if s.max() >= self.accepting:
                found.append(starts[:n][s >= self.accepting] + k)
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


class Scanner:
    """All rules together, and each by itself for exact spans."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.all = Automaton([f"{r.head}{r.tail}{{{min(r.least, COUNTED)},}}" for r in rules], anywhere=True)
        self.heads = [Automaton([r.head], anywhere=False) if r.head else None for r in rules]
        self.tails = [_byte_set(*sre_parse.parse(r.tail)[0], False) for r in rules]

    def _spans(self, text: bytes, k: int) -> list[tuple[int, int]]:
        """Leftmost matches of rule k that don't overlap; one with a short tail takes its bytes but isn't returned."""
        rule, head, tail = self.rules[k], self.heads[k], self.tails[k]
        out, at = [], 0
        while at < len(text):
            body = at if head is None else head.longest(text, at)
            end = body
            while 0 <= end < len(text) and tail[text[end]]:
                end += 1
            if body >= 0 and end > body:
                if end - body >= rule.least:
                    out.append((at, end))
                at = end
            else:
                at += 1
        return out

    def scan(self, texts: list[bytes]) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) of each text in bytes, by start and then by the order of the rules."""
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        joined = b"\n".join(texts)
        flat = np.frombuffer(joined, np.uint8)
        hits = self.all.accepts_at(flat)
        if not len(hits):
            return out
        cuts = np.flatnonzero(self.all.back[flat])
        k = np.unique(np.searchsorted(cuts, hits))
        lows, highs = np.concatenate([[0], cuts + 1])[k].tolist(), np.append(cuts, len(flat))[k].tolist()
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        for low, high in zip(lows, highs, strict=True):
            doc = int(np.searchsorted(starts, low, side="right")) - 1
            for r, rule in enumerate(self.rules):
                out[doc] += [(rule.kind, low - int(starts[doc]) + a, low - int(starts[doc]) + b) for a, b in self._spans(joined[low:high], r)]
        rank = {r.kind: k for k, r in enumerate(self.rules)}
        return [sorted(x, key=lambda s: (s[1], rank[s[0]])) for x in out]


def _code_points(text: bytes, spans: list[tuple[str, int, int]]) -> list[dict]:
    first = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [{"kind": kind, "start": int(first[a]), "end": int(first[b])} for kind, a, b in spans]


def _run(scanner: Scanner, batch_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            texts, found, at, held = list(text_bytes(batch.column(1))), [], 0, 0
            for k, x in enumerate(texts):
                held += len(x)
                if held >= batch_bytes or k == len(texts) - 1:
                    own = texts[at : k + 1]
                    found += [_code_points(t, s) if s else [] for t, s in zip(own, scanner.scan(own), strict=True)]
                    at, held = k + 1, 0
            yield pa.record_batch({"doc_id": batch.column(0), "spans": pa.array(found, kind)})

    return run


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, batch_bytes: int = 32 << 20) -> DataFrame:
    """One row for each row of ``df``: doc_id, spans (kind, start, end in code points, end exclusive; by start, then by rule).

    Matches of a rule are leftmost and don't overlap; those of different rules may. Null and empty texts have no
    spans. Ids may be null or repeated. Other columns are not read. The automata are built once, on the driver.
    batch_bytes: text that is scanned at once; one text may be longer.
    """
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    return texts.mapInArrow(_run(Scanner(rules), batch_bytes), f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")

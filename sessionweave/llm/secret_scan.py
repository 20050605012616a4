"""Secret scans with one deterministic automaton for all rules.

Each rule has a detection pattern (the shortest text that makes a find: every find contains one and few other texts do) and a full
pattern (the whole span). All rules' patterns are compiled together: parsed, turned into a nondeterministic automaton over bytes, made
deterministic by subset construction and minimised, giving one transition array for all rules. There are two such arrays. The first,
of the detection patterns begun at any byte, scans all rules in a single pass over the bytes. The pass runs many stretches of text
abreast; stretches begin after bytes that occur in no detection pattern, where the automaton is in its first state anyway.
The second, of the full patterns begun at one byte, gives the spans where the first reports anything: it walks the stretch of bytes
that the reported rules can use at all, and from each byte follows all rules that are still open there at once, stopping where none can
match any more. Spans are leftmost, longest, without overlap within a rule; a match that fails its rule's least length is dropped.

Nulls and edge cases: a null or empty text has no spans; repeated rows each give a row; spans count code points; an empty table
gives no rows. Columns other than the id, the text and those to carry are not read; a column to carry that is named like a result is
left out.
"""

from __future__ import annotations

import re
import re._constants as C
import re._parser
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, slices, source_of

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""


@dataclass(frozen=True)
class Rule:
    kind: str
    detect: str
    full: str
    least: int = 1
    #: The least length holds for what follows the first colon or equals sign, without spaces and a quote.
    assigned: bool = False

    def keep(self, match: bytes) -> bool:
        if self.assigned:
            match = match[min(k for k in (match.find(b":"), match.find(b"=")) if k >= 0) + 1 :].lstrip(b" ")
            match = match[match[:1] in (b'"', b"'") :]
        return len(match) >= self.least


#: The first three are the base rules; the others add spans.
RULES = (
    Rule("assign", _ASSIGN + r"[A-Za-z0-9+/_.=-]{6}", _ASSIGN + r"[A-Za-z0-9+/_.=-]+", 6, assigned=True),
    Rule("access", r"AKIA[A-Z0-9]", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24}", r"[0-9a-f]+", 24),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{2}", r"gh[opsu]_[A-Za-z0-9]{36}"),
    Rule("private_key", r"-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----", r"-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----"),
)

_KEY = r"(RSA |EC |OPENSSH )?PRIVATE KEY-----"
_KEY_HEAD = r"([\r\n\t\x20]*Proc-Type: 4,ENCRYPTED\r?\nDEK-Info: [A-Z0-9-]+,[A-Fa-f0-9]+)?"
#: Whole keys to redact: up to the END line, through line ends (also written \n) and white space; a key without one as far as its full lines go.
REDACTED_RULES = (
    *RULES[:-1],
    Rule("private_key", RULES[-1].detect, rf"-----BEGIN {_KEY}{_KEY_HEAD}([A-Za-z0-9+/=\\\r\n\t\x20]*-----END {_KEY}|([\r\n]+[A-Za-z0-9+/=]{{40}}[A-Za-z0-9+/=]*)*)"),
)


#: Stretches of text from which on the pass runs them abreast.
FEW_LANES = 24


class _Nfa:
    """Thompson's construction over bytes from the standard library's parse of a pattern."""

    def __init__(self) -> None:
        self.free: list[list[int]] = []  # moves without a byte
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, items: re._parser.SubPattern, at: int, fold: bool = False) -> int:
        for op, arg in items:
            if op in (C.LITERAL, C.IN):
                chars = self._chars([(op, arg)] if op is C.LITERAL else arg)
                if fold:
                    chars |= {ord(f(chr(c))) for c in chars for f in (str.lower, str.upper)}
                end = self.state()
                self.moves[at].append((frozenset(chars), end))
                at = end
            elif op is C.SUBPATTERN:
                at = self.add(arg[3], at, fold or bool(arg[1] & C.SRE_FLAG_IGNORECASE))
            elif op is C.BRANCH:
                end = self.state()
                for branch in arg[1]:
                    self.free[self.add(branch, at, fold)].append(end)
                at = end
            elif op is C.MAX_REPEAT:
                least, most, body = arg
                for _ in range(least):
                    at = self.add(body, at, fold)
                if most is C.MAXREPEAT:
                    loop = self.state()
                    self.free[at].append(loop)
                    self.free[self.add(body, loop, fold)].append(loop)
                    at = loop
                else:
                    end = self.state()
                    self.free[at].append(end)
                    for _ in range(most - least):
                        at = self.add(body, at, fold)
                        self.free[at].append(end)
                    at = end
            else:
                raise ValueError(f"rules can't use {op}")
        return at

    @staticmethod
    def _chars(items: list) -> set[int]:
        out: set[int] = set()
        for op, arg in items:
            out |= {arg} if op is C.LITERAL else set(range(arg[0], arg[1] + 1)) if op is C.RANGE else set()
            if op not in (C.LITERAL, C.RANGE) or max(out) > 127:
                raise ValueError(f"rules can't use {op} {arg}")
        return out


class Automaton:
    """table[state, byte] and accept[state], a bit for each pattern; state 0 is the first. `anywhere`: matches may begin at any byte."""

    def __init__(self, patterns: list[str], anywhere: bool) -> None:
        nfa = _Nfa()
        first = nfa.state()
        ends, self.alphabets = {}, []
        for k, pattern in enumerate(patterns):
            start = nfa.state()
            nfa.free[first].append(start)
            ends[nfa.add(re._parser.parse(pattern), start)] = k
            self.alphabets.append(frozenset(b for moves in nfa.moves[start:] for chars, _ in moves for b in chars))
        self.alphabet = frozenset().union(*self.alphabets)

        def closed(states: set[int]) -> frozenset[int]:
            todo = list(states)
            while todo:
                new = [x for x in nfa.free[todo.pop()] if x not in states]
                states.update(new)
                todo += new
            return frozenset(states)

        begin = closed({first})
        number, rows, todo = {begin: 0}, [], [begin]
        for states in todo:  # grows as subsets are found
            reach: dict[int, set[int]] = {}
            for s in states:
                for chars, end in nfa.moves[s]:
                    for b in chars:
                        reach.setdefault(b, set()).add(end)
            row = [0 if anywhere else -1] * 256
            for b, to in reach.items():
                subset = closed(to | ({first} if anywhere else set()))
                if subset not in number:
                    number[subset] = len(number)
                    todo.append(subset)
                row[b] = number[subset]
            rows.append(row)
        accept = np.array([sum(1 << ends[s] for s in states if s in ends) for states in todo], np.int64)
        self.table, self.accept = self._minimised(np.array(rows, np.int64), accept)

    def reachable(self) -> np.ndarray:
        """For each state the patterns, as bits, that this or a later state accepts."""
        found = self.accept.copy()
        while True:
            more = found | np.bitwise_or.reduce(np.where(self.table >= 0, found[self.table], 0), axis=1)
            if (more == found).all():
                return found
            found = more

    @staticmethod
    def _minimised(table: np.ndarray, accept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges states that no continuation tells apart, by refining classes until none splits."""
        block = np.unique(accept, return_inverse=True)[1]
        while True:
            signs = np.column_stack([block, np.where(table >= 0, block[table], -1)])
            finer = np.unique(signs, axis=0, return_inverse=True)[1].ravel()
            if finer.max() == block.max():
                break
            block = finer
        _, sample = np.unique(block, return_index=True)
        rank = np.argsort(np.argsort(sample))  # the first state's class becomes state 0
        order = np.argsort(sample)
        chosen = sample[order]
        rows = table[chosen]
        return np.where(rows >= 0, rank[block[rows]], -1), accept[chosen]


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        auto = Automaton([r.detect for r in rules], anywhere=True)
        order = np.argsort(auto.accept != 0, kind="stable")  # accepting states last, for one comparison per step
        rank = np.argsort(order)
        self.table = rank[auto.table[order]].astype(np.int32).ravel() * 256
        self.accept = auto.accept[order]
        self.flat = self.table.tolist()
        self.first_accepting = int(np.count_nonzero(self.accept == 0)) * 256
        self.full = Automaton([r.full for r in rules], anywhere=False)
        self.steps, self.ends, self.open = self.full.table.tolist(), self.full.accept.tolist(), self.full.reachable().tolist()
        self.begun: dict[int, re.Pattern] = {}
        self.usable = [np.isin(np.arange(256), list(self.full.alphabets[k])) for k in range(len(rules))]
        self.outside = ~np.isin(np.arange(256), list(auto.alphabet))
        self.begin = int(rank[0]) * 256

    def detect(self, data: np.ndarray, lanes: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Positions where some rule's detection ends, and the rules as bits. data ends in a byte of no rule."""
        breaks = np.flatnonzero(self.outside[data]) + 1
        wanted = np.linspace(0, len(data), max(1, min(lanes, len(data) // 64)), endpoint=False).astype(np.int64)
        starts = np.unique(np.concatenate([[0], breaks[np.minimum(np.searchsorted(breaks, wanted[1:]), len(breaks) - 1)]]))
        lengths = np.diff([*starts, len(data)])
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")
        state = np.full(len(starts), self.begin, np.int32)
        at, found = starts.copy(), []
        for n in active.tolist():
            if n <= FEW_LANES:  # long stretches are left: one after another
                found += [self._detect_in(data, int(a), int(starts[lane] + lengths[lane]), int(state[lane])) for lane, a in enumerate(at[:n])]
                break
            state = self.table[state[:n] + data[at[:n]]]
            if state.max(initial=0) >= self.first_accepting:
                lane = np.flatnonzero(state >= self.first_accepting)
                found.append((at[lane], self.accept[state[lane] >> 8]))
            at[:n] += 1
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([p for p, _ in found]), np.concatenate([b for _, b in found])

    def _detect_in(self, data: np.ndarray, begin: int, end: int, state: int) -> tuple[np.ndarray, np.ndarray]:
        """As detect for the one stretch from begin to end, entered in state."""
        table, accepting, places, bits = self.flat, self.first_accepting, [], []
        for k, byte in enumerate(data[begin:end].tobytes(), begin):
            state = table[state + byte]
            if state >= accepting:
                places.append(k)
                bits.append(int(self.accept[state >> 8]))
        return np.array(places, np.int64), np.array(bits, np.int64)

    def _beginnings(self, wanted: int) -> re.Pattern:
        """Matches a byte that some wanted rule can begin with."""
        if wanted not in self.begun:
            first = bytes(b for b in range(256) if self.steps[0][b] >= 0 and self.open[self.steps[0][b]] & wanted)
            self.begun[wanted] = re.compile(b"[" + re.escape(first) + b"]")
        return self.begun[wanted]

    def resolve(self, text: bytes, pieces: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
        """(start, end, rule) of the matches that the rules keep; pieces (begin, end, rule) touch, by begin, and say where each rule is wanted."""
        steps, ends, opened = self.steps, self.ends, self.open
        free, until = {}, {}  # where each rule's last match ended, and where its current piece does
        at, last, turn = pieces[0][0], max(p[1] for p in pieces), 0
        wanted, change = 0, at
        while at < last:
            if at >= change:  # which rules may begin here
                while turn < len(pieces) and pieces[turn][0] <= at:
                    begin, end, rule = pieces[turn]
                    free[rule], until[rule], turn = max(begin, free.get(rule, 0)), end, turn + 1
                wanted = sum(1 << r for r, x in free.items() if x <= at < until[r])
                later = [x for r, x in free.items() if x > at] + [x for x in until.values() if x > at] + [p[0] for p in pieces[turn : turn + 1]]
                change = min(later, default=last)
            begun = self._beginnings(wanted).search(text, at, change) if wanted else None
            if begun is None:
                at = change
                continue
            at = begun.start()
            state, seen = 0, {}
            for k in range(at, last):
                state = steps[state][text[k]]
                if state < 0 or not opened[state] & wanted:
                    break
                if ends[state] & wanted:
                    seen[ends[state] & wanted] = k + 1
            for rule in {r for bits in seen for r in range(bits.bit_length()) if bits >> r & 1}:
                end = max(k for bits, k in seen.items() if bits >> rule & 1)
                if self.rules[rule].keep(text[at:end]):
                    yield at, end, rule
                free[rule], change = end, at
            at += 1

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """Each text's (start, end, rule) in code points, by start and then rule."""
        joined = b"\xff".join([*texts, b""])  # a byte of no rule and no text
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        data = np.frombuffer(joined, np.uint8)
        if not len(data):
            return out
        places, bits = self.detect(data)
        if not len(places):
            return out
        heads = np.cumsum([0, *(len(t) + 1 for t in texts)])
        points = np.cumsum((data & 0xC0) != 0x80)  # code points up to and with each byte
        pieces: list[tuple[int, int, int]] = []
        for rule in range(len(self.rules)):
            hits = np.sort(places[bits >> rule & 1 == 1])
            if not len(hits):
                continue
            walls = np.concatenate([[-1], np.flatnonzero(~self.usable[rule][data]), [len(data)]])
            right = np.unique(np.searchsorted(walls, hits))
            pieces += [(a + 1, b, rule) for a, b in zip(walls[right - 1].tolist(), walls[right].tolist(), strict=True)]
        pieces.sort()
        groups, reach = [], -1
        for piece in pieces:
            if piece[0] >= reach:
                groups.append([])
            groups[-1].append(piece)
            reach = max(reach, piece[1])
        for group in groups:
            doc = int(np.searchsorted(heads, group[0][0], "right")) - 1
            base = int(points[heads[doc]]) - 1
            for start, end, rule in self.resolve(joined, group):
                before = int(points[start]) - 1 - base
                out[doc].append((before, before + end - start, rule))
        return [sorted(x, key=lambda s: (s[0], s[2])) for x in out]


@lru_cache(maxsize=4)
def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    """Compiled once in each Python worker."""
    return Scanner(rules)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, redact: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: the id, spans (array of kind, start, end), with `redact` also redacted, the text with each span
    replaced by it (overlapping spans by one), and the columns to carry along."""
    source, name, carried = source_of(docs, id_col, text_col, carry, ("spans", "redacted"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    found = ["spans"] + ["redacted"] * (redact is not None)
    kept = source.columns if text_col in carry else source.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(rules)
        for part in slices(batches, "t"):
            texts = part.column(0)
            spans = scanner.spans(as_bytes(texts))
            columns = [pa.array([[{"kind": scanner.rules[r].kind, "start": s, "end": e} for s, e, r in x] for x in spans], kind)]
            if redact is not None:
                columns.append(pa.array([_redacted(t, x, redact) if x else t.as_py() for t, x in zip(texts, spans, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays([*columns, *(part.column(c) for c in kept)], names=[*found, *kept])

    spans_type = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    types = [T.StructField("spans", spans_type), T.StructField("redacted", T.StringType())][: len(found)]
    return source.mapInArrow(run, T.StructType([*types, *(source.schema[c] for c in kept)])).select(*name, *found, *carried)


def _redacted(text: pa.Scalar, spans: list[tuple[int, int, int]], mark: str) -> str:
    value, out, at = text.as_py(), [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [value[at:start], mark]
        at = max(at, end)
    return "".join([*out, value[at:]])

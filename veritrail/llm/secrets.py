"""Secret scans: all rules in one deterministic automaton, run over the bytes of a text once.

The rules' expressions, read from right to left, become one nondeterministic automaton; subset construction and minimisation turn it into a
transition array over byte classes. It runs from a text's last byte to its first, and each state knows the rules of which a match begins
at the byte just read. A clean stretch costs one array access a byte; in one with matches the places where they begin are kept. From
there each rule's own minimal automaton finds the longest end, forwards over the match alone: leftmost, longest, non-overlapping by rule. No
text that a match does not cover is read again, so that the time grows with the text, whatever it holds.

Defined results: a null text counts as empty and has no spans, and stays null when secrets are masked; repeated rows are scanned one by one; an empty
table gives an empty table; a column that has the result's name is replaced; offsets are code points, the end exclusive; spans of several rules
may overlap and are ordered by start, then by the rules' order; stretches that overlapping spans cover are masked as one.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Rule:
    """A secret is `lead` followed by `value`, of `least` bytes at least; shorter ones are passed over.

    `signal`: an expression that begins a match where a secret of this rule begins, and nowhere in a shorter one that would be passed over; by default
    lead and value.
    """

    kind: str
    lead: str
    value: str
    least: int = 1
    either_case: bool = False
    signal: str | None = None


#: Rules whose spans any scan returns, in this order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 6, True),
    Rule("access", "", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", "", r"[0-9a-f]+", 24, signal=r"[0-9a-f]{24}"),
)
#: Rules that the method adds.
MORE = (
    Rule("repo", r"gh[oprsu]_", r"[A-Za-z0-9]+", 36),
    Rule("web", "", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 32),
    Rule("pem", "", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
)
RULES = (*BASE, *MORE)
#: Bytes that are passed at once; if matches begin among them, they are passed once more to see where.
STRETCH = 2048
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


class _Nfa:
    """States with edges on sets of bytes, and edges on nothing."""

    def __init__(self) -> None:
        self.on: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.on.append([])
        self.free.append([])
        return len(self.on) - 1

    def add(self, items, at: int, fold: bool, back: bool) -> int:
        """Append the parsed expression `items`, from its end if `back`, after state `at`; returns the state behind it."""
        for what, arg in reversed(items) if back else items:
            if what is op.LITERAL or what is op.IN:
                end = self.state()
                self.on[at].append((_bytes(what, arg, fold), end))
                at = end
            elif what is op.SUBPATTERN:
                at = self.add(arg[-1], at, fold, back)
            elif what is op.BRANCH:
                end = self.state()
                for branch in arg[1]:
                    self.free[self.add(branch, at, fold, back)].append(end)
                at = end
            elif what is op.MAX_REPEAT:
                low, high, body = arg
                for _ in range(low):
                    at = self.add(body, at, fold, back)
                if high == op.MAXREPEAT:
                    loop = self.state()
                    self.free[at].append(loop)
                    self.free[self.add(body, loop, fold, back)].append(loop)
                    at = loop
                else:
                    end = self.state()
                    for _ in range(high - low):
                        self.free[at].append(end)
                        at = self.add(body, at, fold, back)
                    self.free[at].append(end)
                    at = end
            else:
                raise ValueError(f"not supported in a rule: {what}")
        return at

    def closed(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


def _bytes(what, arg, fold: bool) -> frozenset[int]:
    found: set[int] = set()
    for kind, x in [(op.LITERAL, arg)] if what is op.LITERAL else arg:
        if kind is op.LITERAL:
            found.add(x)
        elif kind is op.RANGE:
            found.update(range(x[0], x[1] + 1))
        else:
            raise ValueError(f"not supported in a rule's class: {kind}")
    if max(found) > 127:
        raise ValueError("rules match ASCII only")
    return frozenset(found | {ord(chr(x).swapcase()) for x in found if chr(x).isalpha()} if fold else found)


@dataclass
class Automaton:
    """`step[state * classes + byte_class[byte]]` is the next state; 0 is the start; `accepts[state]`: the expressions that match; `dead`: no way to accept."""

    byte_class: bytes
    classes: int
    step: list[int]
    accepts: list[tuple[int, ...]]
    dead: int

    def rows(self, ends: list) -> list[list]:
        """For each state what comes next by byte: the next state's own list, or `ends` of it where that is not None."""
        rows: list[list] = [[] for _ in self.accepts]
        for s, row in enumerate(rows):
            following = [rows[x] if ends[x] is None else ends[x] for x in self.step[s * self.classes : (s + 1) * self.classes]]
            row.extend(following[c] for c in self.byte_class)
        return rows


def compile_rules(expressions: list[tuple[str, bool]], anywhere: bool = False, back: bool = False) -> Automaton:
    """Subset construction over all `expressions` (pattern, either case), then minimisation.

    `anywhere`: a match may begin at any byte. `back`: expressions are read from their ends, for a pass from right to left.
    """
    nfa = _Nfa()
    start, ends = nfa.state(), {}
    for k, (pattern, fold) in enumerate(expressions):
        begin = nfa.state()
        nfa.free[start].append(begin)
        ends[nfa.add(list(parser.parse(pattern)), begin, fold, back)] = k
    sets = {s for edges in nfa.on for s, _ in edges}
    kinds: dict[tuple, int] = {}
    byte_class = bytes(kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256))
    sample = [byte_class.index(c) for c in range(len(kinds))]
    moves = [[[t for on, t in edges if b in on] for b in sample] for edges in nfa.on]
    first = nfa.closed([start])
    number, order, step = {first: 0}, [first], []
    for states in order:
        for c in range(len(sample)):
            to = nfa.closed({t for s in states for t in moves[s][c]} | ({start} if anywhere else set()))
            if to not in number:
                number[to] = len(order)
                order.append(to)
            step.append(number[to])
    accepts = [tuple(sorted(ends[x] for x in s if x in ends)) for s in order]
    n, k = len(order), len(kinds)
    first_names: dict[tuple, int] = {}
    block = [first_names.setdefault(x, len(first_names)) for x in accepts]
    while True:  # split blocks until all states of one agree on the blocks they step to
        names: dict[tuple, int] = {}
        fresh = [names.setdefault((block[s], *(block[x] for x in step[s * k : s * k + k])), len(names)) for s in range(n)]
        if len(names) == len(set(block)):
            break
        block = fresh
    lead = {}
    for s in range(n):
        lead.setdefault(block[s], s)
    place = {b: i for i, b in enumerate(sorted(lead, key=lead.get))}
    least = sorted(lead.values())
    out = [place[block[step[s * k + c]]] for s in least for c in range(k)]
    accept = [accepts[s] for s in least]
    dead = next((s for s in range(len(least)) if not accept[s] and all(x == s for x in out[s * k : s * k + k])), -1)
    return Automaton(byte_class, k, out, accept, dead)


class Scanner:
    """The compiled rules: a few thousand numbers, built by the driver and sent along with the tasks."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules, self.clean = rules, None
        self.both = compile_rules([(r.signal or r.lead + r.value, r.either_case) for r in rules], anywhere=True, back=True)
        self.whole = [compile_rules([(r.lead + r.value, r.either_case)]) for r in rules]
        self.lead = [compile_rules([(r.lead, r.either_case)]) if r.lead else None for r in rules]

    def begins(self, data: bytes) -> list[tuple[int, int]]:
        """(place, state) of all bytes at which a match of some rule begins, from right to left."""
        auto = self.both
        if self.clean is None:  # rows that a stretch without matches stays in; any match leads to the number -1 and stays there
            gone: list = []
            gone.extend([gone] * 256)
            self.gone, self.clean = gone, auto.rows([gone if x else None for x in auto.accepts])
            self.number = {id(row): s for s, row in enumerate(self.clean)}
        back, found, state = data[::-1], [], 0
        step, classes, byte_class, accepts, last = auto.step, auto.classes, auto.byte_class, auto.accepts, len(data) - 1
        for at in range(0, len(back), STRETCH):
            part, row = back[at : at + STRETCH], self.clean[state]
            for b in part:
                row = row[b]
            if row is not self.gone:
                state = self.number[id(row)]
                continue
            for k, b in enumerate(part, at):
                state = step[state * classes + byte_class[b]]
                if accepts[state]:
                    found.append((last - k, state))
        return found

    def spans(self, data: bytes) -> list[tuple[str, int, int]]:
        """(kind, start, end) in bytes, by start and then in the rules' order."""
        found, done = [], [0] * len(self.rules)
        for at, state in reversed(self.begins(data)):
            for k in self.both.accepts[state]:
                if at < done[k]:
                    continue
                done[k] = _longest(self.whole[k], data, at)
                value = max(at, _longest(self.lead[k], data, at)) if self.lead[k] else at
                if done[k] - value >= self.rules[k].least:
                    found.append((at, k, done[k]))
        return [(self.rules[k].kind, a, e) for a, k, e in sorted(found)]


def _longest(auto: Automaton, data: bytes, at: int) -> int:
    """End of the longest match that begins at `at`, or -1."""
    state, end, n = 0, -1, len(data)
    step, classes, byte_class, accepts, dead = auto.step, auto.classes, auto.byte_class, auto.accepts, auto.dead
    while at < n:
        state = step[state * classes + byte_class[data[at]]]
        if state == dead:
            break
        at += 1
        if accepts[state]:
            end = at
    return end


def _code_points(data: bytes, spans: list[tuple[str, int, int]]) -> list[dict]:
    if data.isascii():
        return [{"kind": k, "start": a, "end": e} for k, a, e in spans]
    out, at, points = [], 0, 0
    for k, a, e in spans:  # by start; matches are ASCII, so that a byte of one is a code point
        points += len(data[at:a].decode())
        at = a
        out.append({"kind": k, "start": points, "end": points + e - a})
    return out


def _masked(data: bytes, spans: list[tuple[str, int, int]]) -> bytes:
    """`data` with each stretch that spans cover replaced by [kind] of the first of them."""
    parts, at = [], 0
    for kind, a, e in spans:
        if a >= at:
            parts += [data[at:a], f"[{kind}]".encode()]
        at = max(at, e)
    return b"".join([*parts, data[at:]])


def scan(df: DataFrame, text: str = "text", into: str = "secret_spans", rules: tuple[Rule, ...] = RULES, mask: bool = False) -> DataFrame:
    """`df` with one more column `into`: the spans of all secrets in each whole text. `mask`: the text has [kind] in the place of each."""

    scanner = Scanner(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            place = batch.schema.get_field_index(text)
            found, texts = [], []
            for x in batch.column(place):
                data = x.as_buffer().to_pybytes() if x.is_valid else b""
                spans = scanner.spans(data)
                found.append(_code_points(data, spans) if spans else [])
                if mask:
                    texts.append(_masked(data, spans) if x.is_valid else None)
            columns = list(batch.columns)
            if mask:
                columns[place] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], names=[*batch.schema.names, into])

    df = df.drop(into)
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, SPANS)]))


def joined(spans: Column) -> Column:
    """The spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

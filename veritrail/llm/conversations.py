"""Conversation structure repair: the cheapest edits that make a conversation's roles read system? (user assistant)*.

A forward Viterbi pass over four grammar states (nothing yet, after system, after user, after assistant) carries the least (cost, audit) of each.
A row is kept, given another role or deleted; before it and at the end up to two rows may be inserted, more of them only lead back. The audit is
not carried as text: after the same rows no audit is the beginning of another (each ends with the row's own edit), so that their order
follows from the order of those before and from the edit, and a rank is enough. Steps back give the text.

Conversations lie in sorted runs and are repaired one by one. One of more than HOT rows (counted first, on the ids alone) is cut: its rows, without
texts and equal ones as a count, are ordered by ranges; each stretch gives its own table of (cost, audit) from state to state, tables are
joined up in order, and the texts pass once, in order, for the hash of what is repaired, which by its definition reads them one after the other.

Defined results: a null role or text counts as one space, a null turn comes first; rows of a conversation with equal turns are ordered by the MD5 of
role:text; a row with an empty role, or one with another initial than s, u and a, can't be kept as it is; a null conversation id is a
conversation of its own; rows whose `present` is false or null only name their conversation, and a conversation without other rows gives zeros, an empty audit and
the hash of nothing; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.sources.catalog import written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows of a conversation that one task still takes as a whole, and of a stretch of a longer one.
HOT, STRETCH = 100_000, 50_000
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where an initial leads from each state; a row may be inserted as, or given the role of, u or a alone.
STEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
AHEAD = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
BLANK = " \t\n\x0b\x0c\r"
RESULT = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _inserted(state: int) -> list[tuple[int, str]]:
    """States that up to two insertions lead to, and what they write; a state that comes again is dearer."""
    out = [(state, "")]
    for n in (1, 2):
        nxt = AHEAD[out[-1][0]]
        if all(nxt != s for s, _ in out):
            out.append((nxt, "I" * n))
    return out


def _moves(initial: str, fault: str) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, written) of everything that may be done with a row, insertions before it included."""
    more, out = TRUNCATED if fault == "t" else 0, []
    for state in range(4):
        for at, ins in _inserted(state):
            paid = INSERT * len(ins)
            out.append((state, at, paid + DELETE, ins + "D"))
            if fault not in ("b", "d"):
                if at in STEP.get(initial, {}):
                    out.append((state, STEP[initial][at], paid + KEEP + more, ins + "K"))
                out.append((state, AHEAD[at], paid + REROLE + more, ins + "R"))
    return out


_MOVES = {(i, f): _moves(i, f) for i in ("s", "u", "a", "") for f in ("", "b", "d", "t")}


def forward(rows: Iterable[tuple[str, str]], start: int) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the best way from `start` to each state over rows (initial, fault); faults are b, d, t or nothing."""
    layer, back = {start: (0, 0)}, []
    for initial, fault in rows:
        best: dict[int, tuple] = {}
        for state, to, cost, text in _MOVES[initial if initial in STEP else "", fault]:
            if state in layer:
                paid, rank = layer[state]
                way = (paid + cost, rank, text, state)
                if to not in best or way < best[to]:
                    best[to] = way
        order = {way: k for k, way in enumerate(sorted({b[1:3] for b in best.values()}))}
        layer = {s: (b[0], order[b[1:3]]) for s, b in best.items()}
        back.append({s: b[2:] for s, b in best.items()})
    out = {}
    for end, (cost, _) in layer.items():
        state, text = end, []
        for step in reversed(back):
            written_, state = step[state]
            text.append(written_)
        out[end] = (cost, "".join(reversed(text)))
    return out


def closed(ends: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """The best of all ways that end as the grammar wants, insertions after the last row included."""
    ways = [(cost + INSERT * len(ins), audit + ins) for state, (cost, audit) in ends.items() for at, ins in _inserted(state) if at in (START, ASSISTANT)]
    return min(ways)


class Rewriter:
    """The hash of a conversation's repaired rows, one by one, from its audit."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.hash, self.first = audit, 0, START, hashlib.sha256(), True

    def _put(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.first = False

    def _insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state = AHEAD[self.state]
            self._put(ROLE[self.state], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = STEP[role[:1]][self.state]
            self._put(role, text)
        elif edit == "R":
            self.state = AHEAD[self.state]
            self._put(ROLE[self.state], text)

    def digest(self) -> str:
        self._insert()
        return self.hash.hexdigest()


def _fault(text: str) -> str:
    last = text.rstrip(BLANK)[-1:]
    return "b" if not last else "" if last in ".!?" else "t"


def _repaired(conv, rows: list[tuple]) -> tuple:
    """The result of one conversation from its rows (turn, role, text) in order."""
    seen, steps = set(), []
    for _, role, text in rows:
        fault, pair = _fault(text), (role, text)
        steps.append((role[:1], "d" if fault != "b" and pair in seen else fault))
        seen.add(pair)
    turns = {t for t, _, _ in rows if t is not None}
    count = {f: sum(x == f for _, x in steps) for f in "bdt"}
    illegal = sum(a + b not in LEGAL for (a, _), (b, _) in zip(steps, steps[1:]))
    cost, audit = closed(forward(steps, START))
    text = Rewriter(audit)
    for _, role, said in rows:
        text.row(role, said)
    return (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["b"], count["d"], count["t"], illegal, cost, audit, text.digest())


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 1000) -> Iterator[pa.RecordBatch]:
    """Rows as batches of `most` rows or about 8 MB of what the last column but one holds."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[-2]) if isinstance(r[-2], str) else 1
        if len(held) == most or size > 8_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)


def _kind(df: DataFrame) -> pa.DataType:
    return pa.int64() if dict(df.dtypes)["conv"] == "bigint" else pa.string()


def _schema(kind: pa.DataType) -> pa.Schema:
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return pa.schema([("conv_id", kind), *((n, pa.int64()) for n in longs), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _whole(rows: DataFrame) -> DataFrame:
    """Conversations that a task takes one by one."""
    kind, schema = dict(rows.dtypes)["conv"], _schema(_kind(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_conv = groupby(_streamed(batches), key=lambda r: r[0])
        yield from _batches((_repaired(conv, [(t, r, x) for _, here, t, r, x in part if here]) for conv, part in by_conv), schema)

    ordered = rows.repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "key")
    return ordered.select("conv", "here", "turn", "role", "text").mapInArrow(run, RESULT.format(kind))


_TABLE = "part int, at int, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string, start array<int>, end array<int>, cost array<long>, audit array<string>"


def _stretch(rows: list[tuple], at: int) -> tuple:
    """What a stretch (turn, initial, fault, duplicate, n) of one conversation tells: counts, its ends, and (cost, audit) from state to state."""
    steps = []
    for _, initial, fault, again, n in rows:
        steps += [(initial, "d" if again and fault != "b" else fault)] + [(initial, fault if fault == "b" else "d")] * (n - 1)
    turns = [t for t, *_ in rows if t is not None]
    ways = [(s, e, *w) for s in range(4) for e, w in forward(steps, s).items()]
    count = [sum(x == f for _, x in steps) for f in "bdt"]
    illegal = sum(a + b not in LEGAL for (a, _), (b, _) in zip(steps, steps[1:]))
    return (at, turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)), *count, illegal, steps[0][0], steps[-1][0], *map(list, zip(*ways)))


def _stretches(rows: Iterator[tuple]) -> Iterator[tuple]:
    for (conv, part), group in groupby(rows, key=lambda r: r[:2]):
        held, size, at = [], 0, 0
        for _, _, turn, initial, fault, again, n in group:
            while n:  # equal rows are a count, which may be more than a stretch
                some = min(n, STRETCH - size)
                held.append((turn, initial, fault, again, some))
                n, size, again = n - some, size + some, True
                if size == STRETCH:
                    yield (conv, part, *_stretch(held, at))
                    held, size, at = [], 0, at + 1
        if held:
            yield (conv, part, *_stretch(held, at))


def _joined(conv, parts: Iterable[tuple]) -> tuple:
    """The result of one conversation, all but the hash, from its stretches in order."""
    ends, total = {START: (0, "")}, [0, 0, 0, 0]
    least = most = before = None
    turns = 0
    for _, _, first_turn, last_turn, n, blank, again, short, illegal, first, last, start, end, cost, audit in parts:
        if n:
            turns += n - (most is not None and first_turn == most)
            least, most = first_turn if least is None else least, last_turn
        total = [a + b for a, b in zip(total, (blank, again, short, illegal + (before is not None and before + first not in LEGAL)), strict=True)]
        before = last
        fresh: dict[int, tuple[int, str]] = {}
        for s, e, c, a in zip(start, end, cost, audit, strict=True):
            if s in ends and (e not in fresh or ends[s][0] + c <= fresh[e][0]):
                way = (ends[s][0] + c, ends[s][1] + a)
                fresh[e] = min(fresh.get(e, way), way)
        ends = fresh
    cost, audit = closed(ends)
    return (conv, most - least + 1 - turns if most is not None else 0, *total, cost, audit, "")


def _long(rows: DataFrame) -> DataFrame:
    """Conversations whose rows are more than a task should hold."""
    kind, arrow, schema = dict(rows.dtypes)["conv"], _kind(rows), _schema(_kind(rows))
    here = rows.where("here")
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "b").when(F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "").otherwise("t")
    equal = here.select("conv", "turn", "key", F.substring("role", 1, 1).alias("initial"), fault.alias("fault")).groupBy("conv", "turn", "key").agg(F.first("initial").alias("initial"), F.first("fault").alias("fault"), F.count("*").alias("n"))
    first = equal.groupBy(F.col("conv").alias("c"), F.col("key").alias("k")).agg(F.min(F.struct("turn")).alias("first"))
    flagged = equal.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k"))).withColumn("again", ~F.col("first.turn").eqNullSafe(F.col("turn")))
    dealt = flagged.repartitionByRange("conv", F.asc_nulls_first("turn"), "key").withColumn("part", F.spark_partition_id()).sortWithinPartitions("conv", F.asc_nulls_first("turn"), "key")
    lists = {"start": pa.list_(pa.int32()), "end": pa.list_(pa.int32()), "cost": pa.list_(pa.int64()), "audit": pa.list_(pa.string())}
    plain = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    names = [tuple(f.split()) for f in _TABLE.split(", ")]
    shape = pa.schema([("conv", arrow), *((n, lists.get(n) or plain[t]) for n, t in names)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_stretches(_streamed(batches)), shape, 1)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_conv = groupby(_streamed(batches), key=lambda r: r[0])
        yield from _batches((_joined(conv, (r[1:] for r in part)) for conv, part in by_conv), schema, 1)

    def rehash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            for conv, part in groupby(_streamed(batches), key=lambda r: r[0]):
                found = next(part)
                text = Rewriter(found[3]["audit"])
                for _, role, said, _ in part:
                    text.row(role, said)
                yield (conv, *(found[3][c] for c in schema.names[1:-1]), text.digest())

        yield from _batches(results(), schema, 1)

    parts = dealt.select("conv", "part", "turn", "initial", "fault", "again", "n").mapInArrow(cut, f"conv {kind}, {_TABLE}")
    joined = parts.repartition("conv").sortWithinPartitions("conv", "part", "at").mapInArrow(fold, RESULT.format(kind))
    result = F.struct(*(c for c in schema.names if c != "conv_id"))
    head = joined.select(F.col("conv_id").alias("conv"), F.lit(0).alias("rank"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), result.alias("found"))
    none = F.lit(None).cast(head.schema["found"].dataType)
    both = head.unionByName(here.select("conv", F.lit(1).alias("rank"), "turn", "key", "role", "text", none.alias("found")))
    ordered = both.repartition("conv").sortWithinPartitions("conv", "rank", F.asc_nulls_first("turn"), "key")
    return ordered.select("conv", "role", "text", "found").mapInArrow(rehash, RESULT.format(kind))


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None, hot: int = HOT) -> DataFrame:
    """One row for each conversation: faults found, the cheapest repair's cost and audit, and the hash of its rows."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    here = F.coalesce(F.col(present), F.lit(False)) if present else F.lit(True)
    whole = dict(rows.select(conv).dtypes)[conv] in ("tinyint", "smallint", "int", "bigint")
    keyed = rows.select(F.col(conv).cast("bigint" if whole else "string").alias("conv"), here.alias("here"), F.col(turn).cast("long").alias("turn"), plain(role).alias("role"), plain(text).alias("text"))
    keyed = keyed.withColumn("key", F.md5(F.concat_ws(":", "role", "text").cast("binary")))
    large, _ = written(keyed.where("here").groupBy("conv").agg(F.count("*").alias("n")).where(F.col("n") > hot).select(F.col("conv").alias("hot")), "hot")
    if large.isEmpty():
        return _whole(keyed)
    is_hot = F.col("conv").eqNullSafe(F.col("hot"))
    return _whole(keyed.join(large, is_hot, "left_anti")).unionByName(_long(keyed.join(large, is_hot, "left_semi")))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in, by the checksum of conversation and turn; a dropped row stays, as one that is not present."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", plain("conv_id"), plain("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(plain("text"), "[.!?]", "")).otherwise(plain("text"))
    role = F.when(kind == 4, "user").otherwise(plain("role"))
    copies = F.explode(F.array_repeat(F.lit(True), F.when(kind == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind != 0).alias("present"), copies.alias("copy")).drop("copy")

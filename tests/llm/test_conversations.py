"""Conversation repair against a search from the end that carries whole texts."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from helpers import SMALL
from pyspark.sql import functions as F

from veritrail.llm import conversations

BLANK = " \t\n\x0b\x0c\r"
LEADS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def repaired(rows):
    """The result of one conversation: rows are (turn, role, text) in any order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{r[1]}:{r[2]}".encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(BLANK)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    @cache
    def best(i, state, inserts):
        """(cost, audit, repaired rows) from row i on."""
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserts < 3:
            for nxt, role in (("u", "user"), ("a", "assistant")):
                if LEADS.get((state, nxt)):
                    cost, audit, text = best(i, nxt, inserts + 1)
                    ways.append((cost + 3, "I" + audit, (f"{role}:", *text)))
        if i < len(rows):
            _, role, said = rows[i]
            cost, audit, text = best(i + 1, state, 0)
            ways.append((cost + 4, "D" + audit, text))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                for nxt, new, letter, paid in ((role[:1], role, "K", 0), ("u", "user", "R", 3), ("a", "assistant", "R", 3)):
                    if LEADS.get((state, nxt)):
                        cost, audit, text = best(i + 1, nxt, 0)
                        ways.append((cost + paid + more, letter + audit, (f"{new}:{said}", *text)))
        return min(ways) if ways else (10**9, "~", ())

    for i in range(len(rows), -1, -1):  # from the end, so that no call goes deep
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    cost, audit, text = best(0, "", 0)
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest())


def expected(rows, harm=damage):
    by = {c: [] for c, *_ in rows}
    for conv, *rest in harm(rows):
        by[conv].append(tuple(rest))
    return {c: repaired(r) for c, r in by.items()}


def collected(df):
    got = df.collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r)[1:] for r in got}


@pytest.fixture(scope="module")
def awkward():
    """Conversations of random roles and texts, among them null and repeated ones, ties, and rows without conversation or turn."""
    draw, rows = random.Random(7), []
    roles, texts = ["user", "assistant", "system", "tool", "", None, "user", "assistant"], ["yes.", "no", "why?", "", " \n", None, "so!", "well. ", "é."]
    for conv in [None, *range(1, 60)]:
        for turn in range(draw.randrange(1, 9)):
            rows.append((conv, draw.choice([turn, turn, turn, turn + 5, None]), draw.choice(roles), draw.choice(texts) if draw.random() < 0.6 else f"{draw.random()}."))
    rows += [(60, 0, "user", "a. "), (60, 0, "user", "a. "), (60, 0, "user", "a. ")] + [(61, t, "user" if t % 2 else "assistant", f"{'word ' * 3000}{t}.") for t in range(30)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_op11_query_is_that_of_a_plain_search(spark):
    from veritrail.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(QUERIES["op11_conversation_repair"](spark, SMALL)) == expected(rows)


@pytest.mark.parametrize("hot,stretch", [(1000, 1000), (4, 3), (0, 1)])
def test_awkward_conversations_whole_and_cut(spark, awkward, monkeypatch, hot, stretch):
    monkeypatch.setattr(conversations, "STRETCH", stretch)
    clashing = conversations.damaged(frame(spark, awkward)).withColumns({c: F.lit("mine") for c in ("conv", "here", "key", "audit", "n", "hot", "found")})
    assert collected(conversations.repair(clashing, present="present", hot=hot)) == expected(awkward)


def test_one_long_conversation_is_cut(spark):
    rows = [(1, t // 3, ("user", "assistant", "user", "system")[t % 4], f"{t % 50}.") for t in range(900)] + [(1, 5, "user", "again and again.")] * 500 + [(2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    df = frame(spark, rows).repartition(7)
    one, cut = (collected(conversations.repair(df, hot=n)) for n in (10_000, 100))
    assert one == cut and one[2] == (0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(b"user:a.\nassistant:b.").hexdigest())
    assert cut[1] == repaired([r[1:] for r in rows if r[0] == 1])


def test_empty_and_dropped_conversations(spark):
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert collected(conversations.repair(frame(spark, []))) == {}
    gone = frame(spark, [(1, 0, "user", "a."), (2, 0, "user", "a.")]).withColumn("there", F.when(F.col("conv_id") == 1, False))
    assert collected(conversations.repair(gone, present="there")) == {1: none, 2: none}


def test_ranks_order_audits_as_their_texts():
    draw = random.Random(3)
    for _ in range(300):
        rows = [(draw.choice("suax"), draw.choice(["", "", "t", "b", "d"])) for _ in range(draw.randrange(0, 7))]
        whole = [(i, {"x": "tool", "s": "system", "u": "user", "a": "assistant"}[r], {"": f"{i}.", "t": f"{i}", "b": "", "d": "0."}[f]) for i, (r, f) in enumerate(rows)]
        steps = conversations._repaired(0, whole)
        assert steps[1:] == repaired(whole)

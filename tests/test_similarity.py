"""Cosine joins and peers against plain versions that take every pair, with small caps and split terms."""

import collections
import math
import random
import re

import pytest

from veritrail.functions import fixed
from veritrail.operators import peers, similarity


def terms_of(text, bigrams):
    words = [w for w in re.findall(r"\w+", (text or "").lower()) if len(w) >= 2 and w not in fixed.STOP_WORDS]
    return collections.Counter(words + ([f"{a} {b}" for a, b in zip(words, words[1:])] if bigrams else []))


def fitted(counts, cap):
    """{id: unit vector} of {id: counts}, by the cap's most frequent terms of these texts alone."""
    total, df = collections.Counter(), collections.Counter()
    for c in counts.values():
        total.update(c)
        df.update(c.keys())
    known = sorted(total, key=lambda t: (-total[t], t))[:cap]
    idf = {t: math.log((1 + len(counts)) / (1 + df[t])) + 1 for t in known}
    out = {}
    for d, c in counts.items():
        v = {t: n * idf[t] for t, n in c.items() if t in idf}
        size = math.sqrt(sum(x * x for x in v.values()))
        out[d] = {t: x / size for t, x in v.items()} if size else {}
    return out


def cosine(a, b):
    return sum(x * b[t] for t, x in a.items() if t in b)


@pytest.fixture(scope="module")
def texts():
    """(id, subject, student, text): shared openings, copies, short, blank and null texts, a student with a third of all."""
    draw = random.Random(4)
    word = [f"word{i}" for i in range(80)]
    rows = []
    for i in range(70):
        words = [draw.choice(word[:20] if draw.random() < 0.5 else word) for _ in range(draw.choice([0, 2, 8, 20, 40]))]
        rows.append((i, draw.choice("pqr"), 0 if i % 3 == 0 else draw.randrange(1, 9), " ".join(words)))
    rows += [(100, "p", 3, rows[3][3]), (101, "p", 4, rows[3][3]), (102, "q", 1, None), (103, None, 2, "word1 word2 word3 word4"), (104, "s", 5, "only one text of its subject here"), (105, "p", 6, "the of and to in a is it")]
    return rows


@pytest.mark.parametrize("cap,hot", [(5000, 1 << 14), (25, 3), (60, 1)])
def test_peers_are_those_of_a_fit_for_each_target(spark, texts, cap, hot):
    docs = spark.createDataFrame(texts, "id long, subject string, student long, text string")
    got = {r["id"]: (r["similarity_score"], r["max_similarity"], r["matches"]) for r in peers.scores(docs, "subject", "id", "student", "text", cap, hot).collect()}
    want = {}
    for i, subject, student, text in texts:
        others = {j: terms_of(t, True) for j, s, who, t in texts if s == subject and s is not None and who != student and t}
        want[i] = (0.0, 0.0, 0)
        if others and subject and text and len(text.strip()) >= peers.LEAST_LENGTH:
            v = fitted(others | {i: terms_of(text, True)}, cap)
            found = [cosine(v[i], v[j]) for j in others]
            want[i] = (round(100 * max(found), 2), round(max(found), 4), sum(round(c, 9) > peers.MATCH for c in found))
    assert got.keys() == want.keys()
    for i, (score, most, matches) in want.items():
        assert got[i] == (pytest.approx(score, abs=0.011), pytest.approx(most, abs=1.1e-4), matches), i
    assert sum(m > 0 for _, _, m in want.values()) > 20


@pytest.mark.parametrize("least,hot", [(0.3, 1 << 14), (0.3, 2), (0.05, 5), (0.9, 1)])
def test_pairs_are_all_pairs_above_the_threshold(spark, texts, least, hot, monkeypatch):
    monkeypatch.setattr(similarity, "HOT", hot)
    docs = spark.createDataFrame(texts, "id long, subject string, student long, text string")
    vectors = similarity.vectors(docs, "subject", "id", "text", False, 60)
    got = {(r["a"], r["b"]): r["cosine"] for r in similarity.pairs(vectors, least).collect()}
    assert {(r["a"], r["b"]) for r in similarity.candidates(vectors, least, hot).collect()} >= got.keys()
    want = {}
    for subject in "pqrs":
        v = fitted({j: terms_of(t, False) for j, s, _, t in texts if s == subject}, 60)
        want |= {(a, b): c for a in v for b in v if a < b and round(c := cosine(v[a], v[b]), 9) > least}
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(c) for p, c in want.items()) and want


def test_unlike_documents_of_one_subject_are_not_compared(spark):
    draw = random.Random(9)
    rows = [(i, "s", " ".join(f"w{draw.randrange(20_000)}" for _ in range(60))) for i in range(2000)]
    vectors = similarity.vectors(spark.createDataFrame(rows, "id long, subject string, text string"), "subject", "id", "text", False, 50_000)
    assert similarity.candidates(vectors, similarity.EDGE).count() < 200


def test_vocabularies_keep_the_most_frequent_terms(spark, monkeypatch):
    monkeypatch.setattr(similarity, "PARTS", 3)
    text = " ".join(f"t{i:02d} " * (i % 7 + 1) for i in range(40))
    v = similarity.vectors(spark.createDataFrame([(1, "s", text), (2, "s", "t06")], "id long, subject string, text string"), "subject", "id", "text", False, 10)
    most = sorted(terms_of(text + " t06", False).items(), key=lambda x: (-x[1], x[0]))[:10]
    rows = {r["id"]: r["terms"] for r in v.collect()}
    assert rows[1] == list(range(10)) and rows[2] == [[t for t, _ in most].index("t06")]


def test_links_leave_their_tasks_without_a_shuffle_of_pairs(spark, texts, monkeypatch):
    monkeypatch.setattr(similarity, "SMALL", 5)
    monkeypatch.setattr(similarity, "TILE", 64)
    docs = spark.createDataFrame(texts, "id long, subject string, student long, text string")
    found = similarity.linked(docs, "subject", "id", "text", 60, 0.3)
    assert "hashpartitioning(a" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r["a"], r["b"]): r["cosine"] for r in found.collect()}
    owner, want, best = {i: s for i, _, s, _ in texts}, {}, {}
    for subject in "pqrs":
        v = fitted({j: terms_of(t, False) for j, s, _, t in texts if s == subject}, 60)
        want |= {(a, b): c for a in v for b in v if a < b and round(c := cosine(v[a], v[b]), 9) > 0.3}
        for a in v:
            for b in v:
                key = (subject, *sorted((owner[a], owner[b])))
                if owner[a] != owner[b] and round(c := cosine(v[a], v[b]), 9) > 0.3:
                    best[key] = max(best.get(key, 0), c)
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(c) for p, c in want.items()) and want
    edges = {(r["subject"], r["a"], r["b"]): r["cosine"] for r in similarity.linked_owners(docs, "subject", "id", "student", "text", 60, 0.3).collect()}
    assert edges.keys() == best.keys() and all(edges[p] == pytest.approx(c) for p, c in best.items())


def test_no_pair_of_peers_is_shuffled(spark, texts):
    docs = spark.createDataFrame(texts, "id long, subject string, student long, text string")
    plan = peers.scores(docs, "subject", "id", "student", "text", 60)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" in plan and "peer" not in plan


def test_vocabularies_are_made_longer_for_a_student_with_most_texts_and_no_student_is_no_peer(spark, monkeypatch):
    draw, taken = random.Random(8), []
    rows = [(i, "s", None if i % 11 == 5 else 1 if i % 8 else 2 + i % 3, " ".join(f"w{draw.randrange(60)}" for _ in range(12))) for i in range(60)]
    monkeypatch.setattr(peers, "counted", lambda *a: (taken.append(a[5]), similarity.counted(*a))[1])
    docs = spark.createDataFrame(rows, "id long, subject string, student long, text string")
    got = {r["id"]: (r["max_similarity"], r["matches"]) for r in peers.scores(docs, "subject", "id", "student", "text", 10, 20).collect()}
    assert len(taken) > 1 and taken == sorted(taken)
    for i, _, student, text in rows:
        want = (0.0, 0)
        if student is not None:
            others = {j: terms_of(t, True) for j, _, who, t in rows if who is not None and who != student}
            v = fitted(others | {i: terms_of(text, True)}, 10)
            found = [cosine(v[i], v[j]) for j in others]
            want = (round(max(found), 4), sum(round(c, 9) > peers.MATCH for c in found))
        assert got[i] == (pytest.approx(want[0], abs=1.1e-4), want[1]), i


@pytest.mark.parametrize("bigrams,known", [(False, 1 << 21), (True, 1 << 21), (True, 0)])
def test_terms_are_counted_as_numbers_and_rows_of_one_document_together(spark, texts, bigrams, known, monkeypatch):
    monkeypatch.setattr(similarity, "KNOWN", known)
    if known:
        monkeypatch.setattr(similarity, "term_counts", None)  # no word is dealt out with its document
    rows = [*texts, *([] if not known else [(0, texts[0][1], texts[0][2], "Straße ÄPFEL ΣΑΣ x 日本 a_b 12 the word1"), (106, "p", None, "word3-word4\tword3, of WORD4")])]
    docs = spark.createDataFrame(rows, "id long, subject string, student long, text string")
    bags, vocabulary = similarity.counted(docs, "subject", "id", "text", bigrams, 40, "student")
    want, size = collections.defaultdict(collections.Counter), collections.Counter(s for _, s, _, _ in rows if s)
    for i, subject, student, text in rows:
        if subject:
            want[subject, i, student].update(terms_of(text, bigrams))
    names = {}
    for subject in size:
        total, df = collections.Counter(), collections.Counter()
        for (s, _, _), c in want.items():
            if s == subject:
                total.update(c)
                df.update(c.keys())
        names[subject] = sorted(total, key=lambda t: (-total[t], t))[:40]
        got = [(r["term"], r["total"], r["df"], r["n"]) for r in vocabulary.where(f"subject = '{subject}'").orderBy("rank").collect()]
        assert got == [(t, total[t], df[t], size[subject]) for t in names[subject]]
    got = {(r["subject"], r["id"], r["owner"]): (r["n"], dict(zip((names[r["subject"]][t] for t in r["terms"]), r["counts"]))) for r in bags.collect()}
    held = {k: (size[k[0]], {t: n for t, n in c.items() if t in names[k[0]]}) for k, c in want.items()}
    assert got == {k: v for k, v in held.items() if v[1]}
    assert all(r["terms"] == sorted(r["terms"]) for r in bags.collect())


def block(docs, owners):
    """A block of documents, {term: weight} each."""
    import numpy as np
    import pyarrow as pa

    terms = [sorted(d) for d in docs]
    steps = [[t - s for s, t in zip([0, *ts], ts)] for ts in terms]
    table = pa.table([pa.array(range(len(docs))), pa.array(owners), pa.array(steps, pa.list_(pa.int32())), pa.array([[d[t] for t in ts] for d, ts in zip(docs, terms)], pa.list_(pa.int32()))], names=["id", "owner", "terms", "values"])
    return similarity.Block([similarity._stream(table)], np.linspace(1, 2, 30))


@pytest.mark.parametrize("often,sums,cells", [(0.0075, 1 << 17, 1 << 23), (2, 7, 1 << 23), (0, 100, 300), (0.2, 1, 100)])
def test_terms_of_few_and_of_many_documents_give_the_same_cosines(often, sums, cells, monkeypatch):
    for name, value in {"OFTEN": often, "SUMS": sums, "CELLS": cells, "TILE": 16, "GROUP": 3}.items():
        monkeypatch.setattr(similarity, name, value)
    draw = random.Random(5)
    docs = [{draw.randrange(30) if draw.random() < 0.5 else draw.randrange(4): draw.randrange(1, 5) for _ in range(draw.randrange(1, 9))} for _ in range(60)]
    a, b = (block(docs[i : i + 30], [draw.randrange(8) for _ in range(30)]) for i in (0, 30))
    dense = []
    for x in (a, b):
        m = similarity.np.zeros((30, 30))
        m[x.row, x.term] = x.x
        dense.append(m)
    import numpy as np

    assert np.allclose(similarity._cosines(a, np.arange(30), b, np.arange(30)), dense[0] @ dense[1].T)
    for other, y in ((None, a), (b, b)):
        want = collections.defaultdict(float)
        for i, j in np.ndindex(30, 30):
            p, q = sorted((int(a.owner[i]), int(y.owner[j])))
            if p != q:
                want[p, q] = max(want[p, q], float(dense[0][i] @ (dense[1] if other else dense[0])[j]))
        for sure in ([], [(0, 1), (2, 5), (3, 4)], [(p, q) for p in range(8) for q in range(p + 1, 8) if (p + q) % 5]):
            got = collections.defaultdict(float)
            for us, vs, cs in similarity._owners(a, other, 0.3, tuple(np.array([x[k] for x in sure], dtype=int) for k in (0, 1))):
                for u, v, c in zip(us.tolist(), vs.tolist(), cs.tolist()):
                    got[u, v] = max(got[u, v], c)
            assert got == pytest.approx({k: c for k, c in want.items() if c > 0.3 and k not in sure})


def test_owners_with_equal_documents_are_not_compared_again(spark, monkeypatch):
    draw = random.Random(6)
    rows = [(i, draw.choice("pqr"), draw.randrange(6), " ".join(f"w{draw.randrange(30)}" for _ in range(draw.choice([1, 2, 9])))) for i in range(150)]
    rows += [(200, "q", 1, "w1 w2 w2"), (201, "q", 2, "w2 w1 w2"), (202, "r", 3, "w7"), (203, "r", 4, "w7 w7 w7"), (204, "r", None, "w7")]
    docs = spark.createDataFrame(rows, "id long, subject string, student long, text string")

    def overall(whole):
        best = {}
        for r in similarity.linked_owners(docs, "subject", "id", "student", "text", 60, 0.3, whole).collect():
            best[r["a"], r["b"]] = max(best.get((r["a"], r["b"]), (0, "")), (round(r["cosine"], 9), r["subject"]))
        return best

    assert overall(True) == overall(False) and len(overall(True)) == 15
    bags, _ = similarity.counted(docs, "subject", "id", "text", False, 60, "student")
    same = {(r["a"], r["b"]): r["subject"] for r in similarity._copies(bags.where("owner is not null")).collect()}
    assert {(1, 2), (3, 4)} <= same.keys() and all(overall(False)[k] == (1.0, s) for k, s in same.items())
    import numpy as np

    monkeypatch.setattr(similarity, "_cosines", None)
    x = block([{1: 1}, {1: 2}, {1: 1, 2: 1}], [1, 2, 3])
    assert not list(similarity._owners(x, None, 0.3, (np.array([1, 1, 2]), np.array([2, 3, 3]))))

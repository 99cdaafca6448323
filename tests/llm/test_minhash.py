"""Near duplicates by signatures against all pairs of full sets."""

import collections
import itertools
import random

import numpy as np
import pytest
from helpers import SMALL

from veritrail.llm import minhash, ngram_join, queries

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, width=3):
    w = [x for x in (text or "").translate(LOWER).translate(str.maketrans(BLANK, " " * len(BLANK))).split(" ") if x]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def components(texts, percent=85):
    """{id: (size, component)} over all pairs that share a shingle."""
    sets = {d: shingle_set(x) for d, x in texts}
    where = collections.defaultdict(list)
    for d in sorted(sets):
        for g in sets[d]:
            where[g].append(d)
    shared = collections.Counter(p for ids in where.values() for p in itertools.combinations(ids, 2))
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for (a, b), k in shared.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            p, q = find(a), find(b)
            top[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in sets}


def answers(df):
    got = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}


@pytest.fixture(scope="module")
def copies():
    """Families of texts that differ by a word or by many, long chains, and one family of hundreds."""
    draw = random.Random(11)
    word = [f"w{i}" for i in range(400)]
    texts = []
    for family in range(50):
        base = [draw.choice(word) for _ in range(draw.choice([2, 3, 8, 25, 60, 120]))]
        for _ in range(200 if family == 7 else draw.choice([1, 2, 6, 12])):
            w = list(base)
            for _ in range(draw.choice([0, 1, 1, 2, 3, 5])):
                w[draw.randrange(len(w))] = draw.choice(word)
            texts.append(" ".join(w))
            if draw.random() < 0.3:
                base = w
    draw.shuffle(texts)
    return [(i, t.upper() if draw.random() < 0.2 else t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block,few", [(256, 64), (5, 3)])
def test_components_are_those_of_all_pairs(spark, copies, monkeypatch, block, few):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(minhash, "FEW", few)
    want = components(copies)
    assert answers(minhash.near_duplicates(spark.createDataFrame(copies, "doc_id long, text string"))) == want
    assert len({c for _, c in want.values()}) < len(want) - 100


def test_op12_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert answers(queries.op12_minhash_dedup(spark, SMALL)) == components(rows)


def test_all_pairs_within_the_distance_share_a_key():
    rng = np.random.default_rng(2)
    one = rng.integers(0, 2**16, (300, minhash.PLACES), dtype=np.uint16)
    for most in (0, 1, 5, 12, minhash.MOST):
        other = one.copy()
        for row in other:
            at = rng.permutation(minhash.PLACES)[:most]
            row[at] ^= rng.integers(1, 2**16, most, dtype=np.uint16)
        same = minhash.chunk_keys(one) == minhash.chunk_keys(other)
        assert same.any(axis=(1, 2)).all()
    apart = rng.integers(0, 2**16, one.shape, dtype=np.uint16)
    assert not (minhash.chunk_keys(one) == minhash.chunk_keys(apart)).any()
    keys = minhash.chunk_keys(np.zeros((1, minhash.PLACES), np.uint16)).ravel()
    assert len(set(keys.tolist())) == minhash.PLACES  # chunks and places keep their keys apart


def test_signatures_tell_the_similarity():
    rng = np.random.default_rng(4)
    for share in (0.2, 0.5, 0.85):
        k = round(2000 * share)
        ones = [rng.integers(0, 2**64, 2000, dtype=np.uint64) for _ in range(40)]
        sets = [[one, np.concatenate([one[:k], rng.integers(0, 2**64, 2000 - k, dtype=np.uint64)])] for one in ones]
        jaccard = k / (4000 - k)
        agree = np.mean([(a == b).mean() for a, b in (minhash.signatures(s) for s in sets)])
        assert abs(agree - jaccard) < 0.05


def test_awkward_rows(spark, edge, empty, edge_rows):
    got = minhash.near_duplicates(edge).collect()
    assert len(got) == len(edge_rows)
    by = collections.defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[1] == {(23, 1, True)} and by[2] == {(23, 1, False)} and by[3] == {(0, 3, True)} and by[4] == {(0, 4, True)} and by[6] == {(1, 6, True)}
    assert {(c, k) for _, c, k in by[None]} == {(None, None)}
    assert minhash.near_duplicates(empty).count() == 0


def test_texts_of_one_template_are_not_tied(spark):
    """Shared words that make no link: neither join brings all of them into one component to compare."""
    draw = random.Random(1)
    shared = [f"s{i}" for i in range(60)]
    texts = [(i, " ".join(shared[:30] + [f"o{draw.randrange(10**9)}" for _ in range(15)] + shared[30:])) for i in range(400)]
    docs = spark.createDataFrame(texts, "id long, text string")
    sized, common = ngram_join.shingle_sets(docs, 5)
    classes = ngram_join._first_shingles(docs, ngram_join._common(common), 5, 80)
    assert ngram_join._near(classes, 80).count() == 0
    named = docs.withColumnRenamed("id", "doc_id")
    assert ngram_join.similar_sets(named).where("doc_id <> component_id").count() == 0
    signed = minhash._signed(docs, 3).drop("class")
    near = minhash.candidates(signed, 85)
    assert near.count() == 400 and ngram_join.refined(docs, near, 3, 85).count() == 0
    assert minhash.near_duplicates(named, templates=True).where("doc_id <> component_id").count() == 0

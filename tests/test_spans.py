"""Intervals, pictures, forests, sentences and page tables against plain versions."""

import math
import random
import statistics
from datetime import datetime, timedelta

import numpy as np
import pytest
from helpers import SMALL
from pyspark.sql import functions as F

from veritrail.functions import images
from veritrail.operators import forest, intervals, layout, models, page_tables, parsing, training, writes
from veritrail.sources import readers


@pytest.mark.parametrize("narrow", [1.0, 60.0, 100_000.0])
def test_overlapping_pairs_are_all_and_once(spark, narrow):
    draw, begin = random.Random(6), datetime(2024, 1, 1)
    def some(n):
        out = []
        for i in range(n):
            at = begin + timedelta(seconds=draw.randrange(200_000))
            out.append((i, draw.choice(["a", "b", None]), at, at + timedelta(seconds=draw.choice([0, 1, 59, 60, 61, 3600, 86_400, 10**7, 64 * 60, 8 * 60]))))
        return [*out, (n, "a", begin, None), (n + 1, "a", begin, begin - timedelta(hours=1))]
    a, b = some(120), some(90)
    schema = "id long, key string, start timestamp, end timestamp"
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    cross = lambda x, y: x[3] and y[3] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3]
    for keys in ([], ["key"]):
        got = [(r[0], r[1]) for r in intervals.overlapping(left, right, "start", "end", keys, narrow).select("left.id", "right.id").collect()]
        want = {(x[0], y[0]) for x in a for y in b if cross(x, y) and (not keys or (x[1] == y[1] and x[1] is not None))}
        assert len(got) == len(set(got)) and set(got) == want


def test_long_intervals_are_not_spread_over_narrow_bins(spark):
    far = spark.sql("SELECT 1L AS id, TIMESTAMP '1970-01-01' AS start, TIMESTAMP '2070-01-01' AS end")
    assert intervals._entered(far, "left", [], "start", "end", 1.0).count() <= 2 * intervals.LEVELS


def test_hashes_are_those_of_pixels(spark):
    rng = np.random.default_rng(1)
    pictures = [(i, rng.integers(0, 256, 18 * 16).tolist()) for i in range(20)] + [(20, [1, 2, 3]), (21, None), (22, [5] * 288)]
    small = images.resized(F.col("p"), 18, 16, 9, 8)
    got = {r["i"]: (r["s"], r["h"]) for r in spark.createDataFrame(pictures, "i int, p array<int>").select("i", small.alias("s"), images.dhash(small).alias("h")).collect()}
    for i, p in pictures[:20]:
        grey = np.round(np.array(p).reshape(8, 2, 9, 2).mean(axis=(1, 3)))
        bits = (grey[:, 1:] > grey[:, :-1]).ravel()
        assert got[i][0] == grey.ravel().tolist() and got[i][1] == f"{sum(1 << k for k, b in enumerate(bits) if b):016x}"
    assert got[20] == got[21] == (None, None) and got[22][1] == "0" * 16
    uneven = images.resized(F.array(*map(F.lit, range(15))), 5, 3, 2, 2)
    assert spark.range(1).select(uneven).first()[0] == [2.0, 5.0, 9.0, 12.0]


def test_exported_forest_scores_as_the_model(spark):
    rng = np.random.default_rng(3)
    rows = [(i, *map(float, rng.normal(size=4)), int(rng.random() < 0.3)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y int").withColumn("y", F.when(F.col("a") + F.col("b") > 0.3, 1).otherwise(F.col("y")))
    columns = ["a", "b", "c", "d"]
    model = training.train_forest(df, columns, "y", trees=25, depth=5)
    trees = forest.exported(spark, model)
    assert trees.columns == [f.split()[0] for f in forest.SPLITS.split(", ")]
    want = {r["id"]: r["probability_1"] for r in training.scored(model, df).collect()}
    got = {r["id"]: r["probability_1"] for r in forest.scored(df, trees, columns, 5).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(p, abs=1e-9) for i, p in want.items()) and len(set(want.values())) > 50
    # NaN and null go beyond every threshold
    odd = spark.createDataFrame([(1, float("nan"), 0.0, 0.0, 0.0, 0), (2, None, 0.0, 0.0, 0.0, 0)], df.schema)
    one, two = (r["probability_1"] for r in forest.scored(odd, trees, columns, 5).orderBy("id").collect())
    top = spark.createDataFrame([(1, 1e300, 0.0, 0.0, 0.0, 0)], df.schema)
    assert one == two == pytest.approx(training.scored(model, top).first()["probability_1"])


def test_short_texts_are_not_scored(spark):
    trees = spark.createDataFrame([(0, 0, 0, 0.0, 1, 2, 1.0, 1.0), (0, 1, -1, None, -1, -1, 1.0, 3.0), (0, 2, -1, None, -1, -1, 1.0, 0.0)], forest.SPLITS)
    df = spark.createDataFrame([(1, 1.0, 49), (2, 1.0, 50), (3, 5.0, 500)], "id int, x double, length int")
    got = {r["id"]: (r["ai_probability"], r["ai_score"], r["label"], r["confidence"]) for r in forest.online(df, trees, ["x"], 1, "length").collect()}
    assert got == {1: (0.0, 0.0, "Original", 0.0), 2: (0.75, 75.0, "AI-generated", 0.5), 3: (0.0, 0.0, "Original", 1.0)}


def test_burstiness_is_of_sentences(spark):
    text = "One two three four five six. Seven eight nine ten eleven. Ab cd. One two nine ten; and so it went on.\nShort one."
    losses = [(a, b, 0.5 * len(a) + 0.1 * len(b)) for a in "one two three four five six seven eight nine ten eleven ab cd and so it went on short".split() for b in "one two three four five six seven eight nine ten eleven ab cd and so it went on short".split()]
    docs = spark.createDataFrame([(1, text), (2, "too short"), (3, None), (4, "word " * 20)], "id int, text string")
    got = {r["id"]: r for r in models.sentence_statistics(docs, "id", "text", spark.createDataFrame(losses, "a string, b string, loss double")).collect()}
    loss = {(a, b): x for a, b, x in losses}
    pairs = lambda w: [loss[p] for p in zip(w, w[1:])]
    words = text.lower().replace(".", "").replace(";", "").split()
    sentences = [s for s in ("one two three four five six", "seven eight nine ten eleven", "one two nine ten and so it went on")]
    x = [math.exp(min(statistics.mean(pairs(s.split())), 20)) for s in sentences]
    assert got[1]["sentences"] == 3 and got[1]["burstiness_cv"] == pytest.approx(statistics.stdev(x) / statistics.mean(x), abs=1e-4)
    assert got[1]["entropy"] == pytest.approx(statistics.mean(pairs(words)), abs=1e-4) and got[1]["perplexity_variance"] == pytest.approx(statistics.variance(pairs(words)), abs=1e-4)
    assert all((got[i]["fallback"], got[i]["mean_perplexity"], got[i]["burstiness_cv"], got[i]["greatest"]) == (True, 50.0, 0.0, 5.0) for i in (2, 3, 4))


def plain_table(items, columns):
    """Rows of cells from (column, mid, region, text)."""
    by = [sorted((m, i, t) for c, m, i, t in items if c == k) for k in range(columns)]
    spread = lambda k: statistics.pstdev([b[0] - a[0] for a, b in zip(by[k], by[k][1:])])
    many = [k for k in range(columns) if len(by[k]) >= 3]
    anchor = min(many, key=lambda k: (round(spread(k), 9), k)) if many else max(range(columns), key=lambda k: (len(by[k]), -k))
    mids = [m for m, _, _ in by[anchor]]
    rows = []
    for n, (m, _, text) in enumerate(by[anchor]):
        low, high = 0 if n == 0 else (mids[n - 1] + m) / 2, math.inf if n == len(mids) - 1 else (m + mids[n + 1]) / 2
        rows.append([text.strip() if k == anchor else " ".join(t.strip() for y, _, t in by[k] if low <= y < high and t.strip()) for k in range(columns)])
    return rows


def test_page_tables_are_those_of_a_plain_walk(spark):
    draw, rows = random.Random(3), []
    for page in range(25):
        columns = draw.choice([1, 2, 3])
        for n in range(draw.choice([2, 8, 14, 24])):
            c, y = draw.randrange(columns), draw.randrange(80, 1150)
            x1 = 100 + c * 300 + draw.randrange(5)
            rows.append((page, page * 100 + n, x1, y, x1 + 180 + draw.randrange(20), y + 20 + draw.randrange(9), draw.choice([f" t{n}", "", f"w{n} x"])))
    df = spark.createDataFrame(rows, "page int, region long, x1 int, y1 int, x2 int, y2 int, text string")
    cut = {r["region"]: (r["column"], r["n"]) for r in layout.with_gutters(df, 1000, 1400).select("region", layout.column_of(F.col("gutters")).alias("column"), (F.size("gutters") + 1).alias("n")).collect()}
    got = {r["page"]: r for r in page_tables.page_tables(df, 1000, 1400, {2: ["Name", "Id"]}, {"Id": F.upper}).collect()}
    assert len(got) == 25 and len({r["columns"] for r in got.values()}) > 1
    for page, r in got.items():
        items = [(cut[i][0], (y1 + y2) / 2, i, t) for p, i, _, y1, _, y2, t in rows if p == page]
        want = plain_table(items, r["columns"])
        names = ["Name", "Id"] if r["columns"] == 2 else [f"Column {k + 1}" for k in range(r["columns"])]
        if r["columns"] == 2:
            want = [[a, b.upper()] for a, b in want]
        assert [[x[n] for n in names] for x in r["records"]] == want and r["rows"] == len(want)
        assert r["markdown"] == "\n".join("| " + " | ".join(x) + " |" for x in [names, [":---"] * len(names), *want])


def test_zipping_loses_no_cell(spark):
    cells = [(1, 0, 0, "a"), (1, 2, 0, "b"), (1, 2, 0, "c"), (1, 1, 1, "x"), (2, 5, 1, "y"), (2, 6, 7, "of no column")]
    got = parsing.zipped(spark.createDataFrame(cells, "page int, at int, column int, text string"), "page", "at", {0: "left", 1: "right"})
    assert {tuple(r) for r in got.collect()} == {(1, 0, "a", "x"), (1, 1, "b", ""), (1, 2, "c", ""), (2, 0, "", "y")}


def test_scanned_documents_take_what_was_recognised(spark):
    own = spark.createDataFrame([("a", 1, "word " * 19), ("a", 2, "word"), ("b", 1, "few words"), ("c", 1, None), ("d", 1, "few")], "path string, page int, text string")
    seen = spark.createDataFrame([("a", 1, "x", 10.0), ("b", 2, "second", 50.0), ("b", 1, "first", 75.0), ("c", 1, None, 20.0), ("e", 1, "only", 33.0)], "path string, page int, text string, confidence double")
    got = {r["path"]: (r["text"], r["confidence"], r["scanned"]) for r in readers.document_texts(own, seen).collect()}
    assert got == {"a": ("word " * 19 + "\nword", 100.0, False), "b": ("first\n\nsecond", 62.5, True), "c": ("", 20.0, True), "d": ("few", 100.0, False), "e": ("only", 33.0, True)}


def test_updates_of_keys_of_several_columns(spark):
    subjects = spark.createDataFrame([(1, "CS1", "CSE", 3), (2, "CS2", "CSE", 3), (3, "CS1", "ECE", 3), (4, "CS9", None, 3)], "id int, code string, branch string, semester int")
    changes = spark.createDataFrame([(1, "CS2", None), (2, None, "CSE"), (3, None, "CSE"), (4, "CS2", None), (9, "CS1", "CSE")], "id int, code string, branch string")
    kept = writes.without_conflicts(subjects, changes, "id", ["code", "branch", "semester"])
    assert {r["id"] for r in kept.collect()} == {2, 4, 9}


def test_shares_of_authors_and_of_rows(spark):
    rows = [(i, 1, f"a{i % 3 if i % 2 else 0}") for i in range(200)] + [(200 + i, 0, "h") for i in range(40)] + [(300 + i, 1, None) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, y int, author string")
    kept = training.undersampled(df, "y", "author", "id")
    assert kept.where("y = 0").count() == 40 and kept.where("y = 1").count() <= 80 and kept.select("id").distinct().count() == kept.count()
    by = {r["author"]: r["count"] for r in kept.where("y = 1").groupBy("author").count().collect()}
    assert by["a0"] > 2 * by["a1"] and 1 <= by[None] <= 4
    half = training.sampled_fraction(df, "id", 0.5)
    assert half.count() == round(0.5 * 250) and half.select("id").exceptAll(training.sampled_fraction(df, "id", 0.5).select("id")).count() == 0


def test_four_queries_build_the_features_once(spark, monkeypatch):
    from veritrail.plans import training as plans

    monkeypatch.setattr(training, "TREES", 3)
    built = []
    monkeypatch.setattr(plans, "_BUILT", {})
    kept = plans._features
    monkeypatch.setattr(plans, "_features", lambda *a: (built.append(1), kept(*a))[1])
    for name in ("rf_train_eval", "rf_importances", "rf_online_scores", "legacy_forest"):
        plans.QUERIES[name](spark, SMALL).count()
    assert len(built) == 1


@pytest.mark.parametrize("chunk", [40, 400, 1 << 24])
def test_losses_are_counted_without_moving_pairs(spark, chunk, monkeypatch):
    monkeypatch.setattr(models, "CHUNK", chunk)
    draw = random.Random(8)
    texts = [" ".join(draw.choice(["ab", "Ab", "c", "dé", "e_1"]) + draw.choice(["", "", ".", "!\n"]) for _ in range(n)) for n in (0, 1, 2, 3, 9, 30, 30, 200)] + [None, "", "only", "ΑΣ. ΑΣ ΑΣ. Τα ab c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = models.bigram_losses(docs, "id", "text")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a" not in plan and "hashpartitioning(id" not in plan
    pairs, loss = models.bigram_table(docs, "id", "text")
    key = lambda r: (r["id"], round(r["loss"], 9))
    count = lambda rows: {k: sum(r["n"] for r in rows if key(r) == k) for k in set(map(key, rows))}
    want = pairs.join(loss, ["a", "b"]).select("id", "loss", "n").collect()
    assert count(found.collect()) == count(want) and want
    own, given = (models.sentence_statistics(docs, "id", "text", x).orderBy("id").collect() for x in (None, loss))
    assert own == given and any(r["sentences"] > 1 for r in own)


@pytest.mark.parametrize("bins", [2, 7, 256])
def test_overlaps_are_summed_up_without_pairs(spark, bins, monkeypatch):
    monkeypatch.setattr(intervals, "BINS", bins)
    draw, begin = random.Random(7), datetime(2024, 1, 1)
    def some(n):
        spans = [(draw.randrange(100_000, 200_000), begin + timedelta(seconds=draw.randrange(500) * 60)) for _ in range(n)]
        return [(i, at, at + timedelta(seconds=draw.choice([0, 1, 60, 600, 3600, 20_000]))) for i, at in spans] + [(n, begin, None), (n + 1, begin, begin - timedelta(hours=1)), (n + 2, None, begin)]
    a, b = some(150), some(200)
    schema = "id long, start timestamp, end timestamp"
    got = intervals.overlap_summary(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "start", "end", "id")
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    want = {}
    for i, s, e in a:
        met = [j for j, x, y in b if s and e and x and y and s < e and x < y and s < y and x < e]
        if met:
            n, first = want.get(i, (0, math.inf))
            want[i] = (n + len(met), min(first, *met))
    assert {r["id"]: (r["n"], r["first"]) for r in got.collect()} == want and want

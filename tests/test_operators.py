"""Operators on small fixtures: limits, ties, nulls, orders."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veritrail.functions import text
from veritrail.operators import access, analytics, graph, layout, parsing, ranks, reads, reports, rings, scoring, similarity, training


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first()["y"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_components_are_those_of_union_find(spark, edges):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            top[max(p, q)] = min(p, q)
    got = graph.connected_components(spark.createDataFrame(edges or [(1, 1)], "src long, dst long"))
    assert {(r["node"], r["component"]) for r in got.collect()} == {(x, find(x)) for x in list(top)}


def test_components_of_a_long_path(spark):
    order = random.Random(1).sample(range(200), 200)
    got = graph.connected_components(spark.createDataFrame(list(zip(order, order[1:])), "src long, dst long"))
    assert {r["component"] for r in got.collect()} == {0} and got.count() == 200


def test_whitespace_is_cleaned_in_one_pass(spark):
    assert one(spark, "a\n \n \nb", text.clean_whitespace) == "a\n\n\nb"
    assert one(spark, "  a\t\tb   c \n\n\n\nd  ", text.clean_whitespace) == "a b c\n\nd"


def test_each_leakage_pattern_is_removed_once(spark):
    assert one(spark, "Title: Title: x", text.without_leakage) == "Title: x"
    assert one(spark, "Great question! Certainly, let me say", text.without_leakage) == "Certainly, let me say"
    assert one(spark, "x as an ai", text.without_leakage) == "x as an ai"


def test_html_loses_no_tail(spark):
    rows = [("AT&T",), ("<p>a &amp; b</p><script>c</script><!-- d -->e",), ("text <b",), (None,)]
    got = [r["y"] for r in spark.createDataFrame(rows, "x string").select(text.strip_html("x").alias("y")).collect()]
    assert got[0] == "AT&T" and got[1] == "a & bce" and got[2].startswith("text ") and got[3] is None


def test_unicode_is_decomposed(spark):
    assert one(spark, "ﬁ​é", lambda x: text.normalize_unicode(x)) == "fié"


def test_short_texts_have_fixed_scores(spark):
    got = one(spark, "too short", text.semantic_layer)
    assert got["generic_phrasing"] == 0.5 and got["final_ai_likelihood"] == 50.0 and got["confidence"] == 0.1
    assert one(spark, None, text.fingerprint)["ttr"] == 0.0


def test_edit_similarity_at_its_ends(spark):
    pairs = [("", " ", 1.0), ("a", None, 0.0), ("AB ", "ab", 1.0), ("abc", "abd", 1 - 1 / 3)]
    got = spark.createDataFrame(pairs, "a string, b string, want double").select(text.similarity(F.col("a"), F.col("b")).alias("y"), "want").collect()
    assert all(r["y"] == pytest.approx(r["want"]) for r in got)


def test_labels_at_their_limits(spark):
    got = spark.createDataFrame([(30.0,), (29.99,), (70.0,), (70.01,)], "s double").select(scoring.label(F.col("s")).alias("l")).collect()
    assert [r["l"] for r in got] == ["Mixed", "Original", "Mixed", "AI-generated"]


def test_score_buckets_at_their_limits(spark):
    got = analytics.score_buckets(spark.createDataFrame([(14.9,), (15.0,), (30.0,), (30.1,)], "plagiarism_score double")).first()
    assert tuple(got) == (1, 2, 1)


def test_hours_without_reports_are_there(spark):
    at = dt.datetime(2024, 1, 1, 13, 5)
    df = spark.createDataFrame([(30.0, 1.0, at), (99.0, 99.0, None)], "plagiarism_score double, ai_score double, created_at timestamp")
    got = {r["hour"]: r for r in analytics.hour_risk_bins(spark.range(24), df).collect()}
    assert len(got) == 24 and got["13:00"]["risk"] == "High" and got["00:00"]["submissions"] == 0


def test_anomaly_needs_history_and_survives_no_variance(spark):
    base = {"word_length": 4.0, "sentence_length": 10.0, "ttr": 0.5, "punctuation_density": 0.1}
    rows = [(s, i, dt.datetime(2024, 1, i + 1), *(base | ({"word_length": 9.0, "sentence_length": 30.0, "ttr": 0.9, "punctuation_density": 0.5} if i == n - 1 else {})).values()) for s, n in ((1, 2), (2, 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "student_id long, submission_id long, created_at timestamp, word_length double, sentence_length double, ttr double, punctuation_density double")
    got = analytics.style_anomalies(df).collect()
    assert [(r["student_id"], r["history"], r["metric"]) for r in got] == [(2, 3, "sentence_length")]


def test_pages_of_a_roster(spark):
    df = spark.range(41).withColumnRenamed("id", "k")
    last = reports.page(df, "k", 3, 20).collect()
    assert [(r["k"], r["total"], r["total_pages"]) for r in last] == [(0, 41, 3)]
    assert reports.page(df.where("k < 0"), "k").count() == 0
    with pytest.raises(ValueError):
        reports.page(df, "k", 1, 101)


def test_unknown_status_is_no_filter(spark):
    df = spark.createDataFrame([(True,), (False,)], "ok boolean")
    count = lambda word: df.where(reports.has_status(F.col("ok"), word)).count()
    assert [count(w) for w in ("Active", "0", "what", None)] == [1, 1, 2, 2]


def test_as_of_takes_equal_times_and_leaves_nulls(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    left = spark.createDataFrame([(1, "a", t(5)), (2, "a", t(1)), (3, "b", t(9))], "id long, k string, at timestamp")
    right = spark.createDataFrame([("a", t(5), 50), ("a", t(3), 30), ("c", t(1), 1)], "k string, at timestamp, v int")
    got = {r["id"]: r["got"] for r in reports.as_of(left, right, "k", "at", "at", "v", "got").collect()}
    assert got == {1: 50, 2: None, 3: None}


def test_rate_limit_does_not_count_what_it_refused(spark):
    base = dt.datetime(2024, 1, 1)
    times = [0, 10, 20, 30, 59, 60, 61, 200]
    df = spark.createDataFrame([(i, "u", base + dt.timedelta(seconds=s)) for i, s in enumerate(times)], "id long, k string, at timestamp")
    got = {r["id"]: (r["limited"], r["retry_after"]) for r in access.rate_limited(df, "k", "at", "id", 3, 60).collect()}
    kept, want = [], {}
    for i, s in enumerate(times):
        kept = [x for x in kept if x > s - 60]
        want[i] = (True, max(1, int(kept[0] + 60 - s) + 1)) if len(kept) >= 3 else (False, None)
        if len(kept) < 3:
            kept.append(s)
    assert got == want


def test_sessions_end_after_idle_or_absolute_time(spark):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, "u", base + dt.timedelta(seconds=s)) for i, s in enumerate((0, 1800, 3601, 3700))], "id long, k string, at timestamp")
    assert [r["session"] for r in access.sessions(df, "k", "at", "id").orderBy("id").collect()] == [1, 1, 2, 2]


def test_token_times_are_inclusive(spark):
    now = dt.datetime(2024, 1, 31)
    df = spark.createDataFrame([(now, False, None), (now - dt.timedelta(days=7, seconds=1), False, None), (now, True, now - dt.timedelta(days=8))], "e timestamp, u boolean, a timestamp")
    n = F.lit(now)
    got = df.select(access.token_state(F.col("u"), F.col("e"), n).alias("s"), access.to_purge(F.col("u"), F.col("a"), F.col("e"), n).alias("p")).collect()
    assert [tuple(r) for r in got] == [("valid", False), ("expired", True), ("used", True)]


def test_similarity_is_symmetric_and_one_for_equal_texts(spark):
    docs = spark.createDataFrame([(1, "s", 1, "alpha beta gamma"), (2, "s", 2, "alpha beta gamma"), (3, "s", 3, "delta"), (4, "t", 4, "alpha"), (5, "s", 1, None)], "submission_id long, subject string, student_id long, text string")
    got = similarity.pairs(similarity.vectors(docs, "subject", "submission_id", "text", False, 10), 0.3).collect()
    assert [(r["a"], r["b"]) for r in got] == [(1, 2)] and got[0]["cosine"] == pytest.approx(1)
    peers = {r["submission_id"]: r["similarity_score"] for r in similarity.peer_scores(docs, "subject", "submission_id", "student_id", "text").collect()}
    assert peers == {1: 100.0, 2: 100.0, 3: 0.0, 4: 0.0, 5: 0.0}


def test_rings_chain_students(spark):
    docs = spark.createDataFrame(
        [(1, "s", 1, "alpha beta gamma", "h"), (2, "s", 2, "alpha beta gamma", None), (3, "t", 2, "delta epsilon", "k"), (4, "t", 3, "delta epsilon zeta", None), (5, "u", 9, "lonely words", "k2"), (6, "u", 1, "x", "h")],
        "submission_id long, subject string, student_id long, text string, visual_hash string",
    )
    ring, member = rings.rings(rings.edges(docs))
    assert [tuple(r)[:3] for r in ring.collect()] == [("RING-01", 3, 2)]
    assert sorted(r["student_id"] for r in member.collect()) == [1, 2, 3]


def test_undersampling_keeps_all_of_the_smaller_class(spark):
    rows = [(i, 0, "h") for i in range(5)] + [(100 + i, 1, f"m{i % 3}") for i in range(40)]
    got = training.undersampled(spark.createDataFrame(rows, "id long, label int, author string"), "label", "author", "id")
    by = {r["label"]: r["count"] for r in got.groupBy("label").count().collect()}
    assert by == {0: 5, 1: 10}
    few = spark.createDataFrame(rows[:5] + rows[5:13], "id long, label int, author string")
    assert training.undersampled(few, "label", "author", "id").count() == 13


def test_groups_are_never_split(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 7)
    parts = defaultdict(set)
    for r in training.group_split(df, "g").collect():
        parts[r["part"]].add(r["g"])
    assert not parts["test"] & parts["train"] and len(parts["test"]) == 2


def test_imputed_and_standardised_columns(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, float("nan")), (4, inf), (5, -inf), (6, None)], "id long, x double")
    assert [r["x"] for r in training.imputed(df, ["x"]).orderBy("id").collect()] == [1.0, 3.0, 2.0, 3.0, 1.0, 2.0]
    same = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [r["x"] for r in training.standardised(same, ["x"]).collect()] == [0.0, 0.0]


def test_gutters_keep_their_distance(spark):
    df = spark.createDataFrame([(1, 190, 210), (1, 230, 250), (1, 490, 510)], "page int, x1 int, x2 int")
    assert layout.spaced_gutters(df, 1000).first()["gutters"] == [200.0, 500.0]


def test_overlapping_boxes_and_lines(spark):
    boxes = [(1, 1, 0, 0, 100, 20), (1, 2, 2, 1, 98, 20), (1, 3, 110, 2, 130, 22), (1, 4, 0, 60, 50, 80)]
    df = spark.createDataFrame(boxes, "page int, region int, x1 int, y1 int, x2 int, y2 int")
    kept = layout.without_overlaps(df)
    assert sorted(r["region"] for r in kept.collect()) == [1, 3, 4]
    merged = layout.merged_lines(layout.lines(kept.withColumns({"column": F.lit(0), "confidence": F.lit(0.5)})))
    assert sorted((r["x1"], r["x2"], r["boxes"]) for r in merged.collect()) == [(0, 50, 1), (0, 130, 2)]


def test_stream_of_limits_equals_the_batch(spark):
    from helpers import SMALL

    from veritrail.plans import decisions, streams

    stream = {(r["event_id"], r["limited"]) for r in streams.rate_limit_stream(spark, SMALL).collect()}
    assert stream == {(r["event_id"], r["limited"]) for r in decisions.rate_limit_decisions(spark, SMALL).collect()}


def _requests(spark, n):
    draw, base = random.Random(5), dt.datetime(2024, 1, 1)
    rows = [(i, draw.choice([1, 1, 1, 2, 3]), base + dt.timedelta(seconds=draw.randrange(400_000))) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")


def test_stream_of_limits_orders_a_user_across_chunks(spark, tmp_path):
    from veritrail.plans import streams

    df = _requests(spark, 300)
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    most, seconds = access.POLICIES["resend_verification"]
    want = {(r["event_id"], r["limited"]) for r in access.rate_limited(df, "user_id", "ts", "event_id", most, seconds * 40).collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = {(r["event_id"], r["limited"]) for r in streams.rate_limit_stream(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == want and {x for _, x in want} == {True, False}


def test_stream_of_limits_goes_on_from_batch_to_batch(spark, tmp_path):
    from veritrail.streaming import events

    df, path = _requests(spark, 300), f"{tmp_path}/parts"
    days = sorted({r["d"] for r in df.select(F.to_date("ts").alias("d")).distinct().collect()})
    for d in days:
        df.where(F.to_date("ts") == d).coalesce(1).write.mode("append").parquet(path)
    want = {(r["event_id"], r["limited"]) for r in access.rate_limited(df, "user_id", "ts", "event_id", 3, 36_000).collect()}
    got = events.limited(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path), 3, 36_000).collect()
    assert len(days) > 3 and len(got) == 300 and {(r["event_id"], r["limited"]) for r in got} == want


def _plain_lines(boxes):
    """The lines of one column by the rules, box by box; boxes are (region, x1, y1, x2, y2)."""
    heights = sorted(y2 - y1 for _, _, y1, _, y2 in boxes)
    median = (heights[(len(heights) - 1) // 2] + heights[len(heights) // 2]) / 2
    cut = [part for r, x1, y1, x2, y2 in boxes for part in ([(r, x1, y1, x2, y1 + (y2 - y1) // 2), (r, x1, y1 + (y2 - y1) // 2, x2, y2)] if y2 - y1 > 1.8 * median else [(r, x1, y1, x2, y2)])]
    lines = []
    for box in sorted(cut, key=lambda b: ((b[2] + b[4]) / 2, b[1], b[0])):
        _, x1, y1, x2, y2 = box
        fits = []
        for k, line in enumerate(lines):
            mean = sum((b[2] + b[4]) / 2 for b in line) / len(line)
            top, bottom, right = min(b[2] for b in line), max(b[4] for b in line), max(b[3] for b in line)
            away = abs((y1 + y2) / 2 - mean)
            if away <= max(10, 0.4 * median) and all(min(x2, b[3]) - max(x1, b[1]) <= 8 for b in line):
                if max(bottom, y2) - min(top, y1) <= 1.6 * max(y2 - y1, bottom - top, median) and x1 - right <= 1.8 * max(y2 - y1, bottom - top):
                    fits.append((away, k))
        if fits:
            lines[min(fits)[1]].append(box)
        else:
            lines.append([box])
    return sorted((min(b[1] for b in x), min(b[2] for b in x), max(b[3] for b in x), max(b[4] for b in x), len(x)) for x in lines)


def test_lines_are_those_of_the_rules(spark):
    draw = random.Random(3)
    pages = {p: [(r, x := draw.randrange(0, 900), y := draw.choice([0, 4, 9, 30, 33, 60]) + draw.randrange(6), x + draw.randrange(10, 90), y + draw.choice([12, 16, 20, 24, 60])) for r in range(draw.randrange(1, 40))] for p in range(12)}
    rows = [(p, r, *box, 0, 0.5) for p, boxes in pages.items() for r, *box in boxes]
    df = spark.createDataFrame(rows, "page int, region int, x1 int, y1 int, x2 int, y2 int, column int, confidence double")
    got = defaultdict(list)
    for r in layout.merged_lines(layout.lines(df)).collect():
        got[r["page"]].append((r["x1"], r["y1"], r["x2"], r["y2"], r["boxes"]))
    assert {p: sorted(x) for p, x in got.items()} == {p: _plain_lines(boxes) for p, boxes in pages.items()}
    assert any(n > 1 for x in got.values() for *_, n in x)


def test_last_gutter_goes_if_it_leaves_no_column(spark):
    df = spark.createDataFrame([(1, 100, 140), (1, 300, 340), (1, 921, 935), (2, 950, 990)], "page int, x1 int, x2 int")
    assert {r["page"]: r["gutters"] for r in layout.spaced_gutters(df, 1000).collect()} == {1: [320, 928], 2: []}
    narrow = spark.createDataFrame([(1, 300, 340), (1, 926, 940)], "page int, x1 int, x2 int")
    assert layout.spaced_gutters(narrow, 1000).first()["gutters"] == [320]


def test_sections_of_a_paper(spark):
    said = [
        (1, "Name: Ada  "), (1, "Question 1: Why?"), (1, "(a) First part"), (1, "and more of it?"), (1, "because"), (2, "Ans: since"), (2, "E = mc2"), (2, "   "), (2, "Q2) " + "long prompt " * 3), (2, "goes on"),
    ]
    rows = [("d", i, page, t, 0.9 if i != 4 else 0.5, "FORMULA" if "=" in t else "TEXT", False) for i, (page, t) in enumerate(said)] + [("e", 0, 1, "only text", 0.25, "TEXT", True), ("e", 1, 1, "", 0.5, "TEXT", True), ("f", 0, 1, None, 0.5, "TEXT", False)]
    df = spark.createDataFrame(rows, "doc string, place int, page int, text string, confidence double, content_type string, needs_review boolean")
    got = {(r["doc"], r["section"]): r for r in parsing.sections(df).collect()}
    one, two = got["d", 1], got["d", 2]
    assert one["question"] == "Why? (a) First part" and one["answer"] == "and more of it? because since\n\nE = mc2" and one["parts"] == ["a"] and one["number"] == "1"
    assert one["confidence"] == 0.8 and one["regions"] == 6  # ((((0.9 + 0.9)/2 + 0.9)/2 + 0.5)/2 + 0.9)/2
    assert (two["question"], two["answer"], two["page"]) == (("long prompt " * 3).strip(), "goes on", 2) and got["e", 1]["answer"] == "only text" and len(got) == 3
    docs = {r["doc"]: r for r in parsing.documents(df).collect()}
    assert docs["d"]["name"] == "Ada" and docs["d"]["sections"] == 2 and docs["e"]["title"] == "only text" and docs["f"]["sections"] == 0 and docs["f"]["confidence"] == 0.5


def test_access_of_every_role(spark):
    user = lambda role, action, owner: reads.reaches_submission(F.lit(role), F.lit(1), F.lit(action), F.lit(owner), F.array(F.struct(F.lit("Maths").alias("subject"), F.lit("").alias("section"))), F.lit("A"), F.lit("maths II"))
    cases = {("admin", "delete", 2): True, ("hod", "read", 2): True, ("hod", "delete", 2): False, ("student", "delete", 1): True, ("student", "read", 2): False, ("teacher", "read", 2): True, ("teacher", "delete", 2): False, ("guest", "read", 1): False, (None, "read", 1): False}
    got = spark.range(1).select(*(user(*c).alias(str(i)) for i, c in enumerate(cases))).first()
    assert list(got) == list(cases.values())


def test_fifth_wrong_code_burns_the_link(spark):
    now = dt.datetime(2024, 1, 31)
    df = spark.createDataFrame([(1, 3, False), (2, 4, False), (3, 4, True), (4, 4, None)], "id int, tries int, good boolean").withColumns({"now": F.lit(now), "sent": F.lit(now - dt.timedelta(minutes=10))})
    s = access.reset_outcome(F.lit(False), F.col("now"), F.lit("10.0.0.1"), F.lit("10.0.0.2"), F.col("sent"), F.col("tries"), F.col("good"), F.col("now"))
    assert [tuple(r["s"]) for r in df.select("id", s.alias("s")).orderBy("id").collect()] == [("wrong code", 4, False), ("wrong code", 5, True), ("accepted", 4, False), ("code needed", 4, False)]


def test_exact_means_do_not_depend_on_order(spark):
    values = [53.24975] * 2 + [0.1] * 10 + [0.2] * 10
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert df.agg(analytics.rounded_mean("v", 4)).first()[0] == df.orderBy(F.desc("v")).agg(analytics.rounded_mean("v", 4)).first()[0]
    tie = spark.createDataFrame([(2129.99,)] + [(0.0,)] * 39 + [(None,)], "v double")
    assert tie.agg(analytics.rounded_mean("v", 4)).first()[0] == 53.2498 and tie.where("v is null").agg(analytics.rounded_mean("v", 4)).first()[0] is None


def test_quantiles_over_ranges_are_exact(spark):
    draw = random.Random(4)
    values = [draw.choice([1.5, 2.0, draw.random() * 10]) for _ in range(501)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    q = ranks.quantiles(df, "v", (0.25, 0.5, 0.9)).first()["q"]
    s = sorted(values)
    assert q == pytest.approx([s[125], s[250], s[450]])
    assert ranks.quantiles(df.limit(0), "v", (0.5,)).first()["q"] == [None]


def test_phrases_count_as_written(spark):
    said = "let's dive in, in today's fast-paced world; prior to begin with. multifacetedly rapidly, changing"
    got = spark.range(1).select(text.phrase_hits(F.lit(said), ("let's dive in", "in today's fast-paced", "prior to", "to begin with", "multifaceted", "rapidly changing")).alias("n")).first()
    assert got["n"] == 4


def test_long_pages_are_swept(spark):
    draw, boxes = random.Random(2), []
    for i in range(4000):
        x, y = draw.randrange(40) * 20, i * 3
        boxes.append((i % 2, i, x, y, x + 30 + draw.randrange(30), y + 10 + draw.randrange(20)))
    df = spark.createDataFrame(boxes, "page int, region int, x1 int, y1 int, x2 int, y2 int")
    kept = []
    for p, i, x1, y1, x2, y2 in sorted(boxes, key=lambda b: (b[0], b[3], b[2], b[1])):
        over = lambda k: max(0, min(x2, k[4]) - max(x1, k[2])) * max(0, min(y2, k[5]) - max(y1, k[3])) / min((x2 - x1) * (y2 - y1), (k[4] - k[2]) * (k[5] - k[3]))  # noqa: E731, B023
        if all(over(k) <= 0.7 for k in kept[-60:] if k[0] == p):
            kept.append((p, i, x1, y1, x2, y2))
    got = layout.without_overlaps(df)
    assert {r["region"] for r in got.collect()} == {k[1] for k in kept}
    sweep, most = layout._Lines(), 0
    for _, _, x1, y1, x2, y2 in sorted((b for b in boxes if b[0] == 0), key=lambda b: ((b[3] + b[5]) / 2, b[2], b[1])):
        sweep.take(x1, y1, x2, y2, 20.0)
        most = max(most, len(sweep.open))
    assert most < 50 < sweep.begun
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("value", ["don't", "it's it''s she's", "xx'yy don'", "a" * 40_000, "'tis won't_ can't-can't", None])
def test_contractions_begin_where_words_do(spark, value):
    import re

    from veritrail.functions import fixed

    found = [w for w in re.findall(r"\w+(?:'+\w+)+", (value or "").lower()) if w in fixed.CONTRACTIONS]
    n = max(1, len(re.findall(r"\w+", value or "")))
    assert one(spark, value, text.stylometrics)["contraction_ratio"] == pytest.approx(len(found) / n, abs=5.1e-5)

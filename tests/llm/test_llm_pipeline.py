"""The pipeline's stages, each against brute force on its own input."""

import corpus_pipeline
from helpers import SMALL
from test_llm_operators import base_spans, components, library, passages  # noqa: F401


def test_stages_decide_as_brute_force_does(spark, library):  # noqa: F811
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, SMALL).toPandas()) if name != "byte_bpe" else stage(spark, docs, SMALL)
        if name != "byte_bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
        after = {r["doc_id"]: r for r in docs.collect()}
        kept[name] = after
        if name == "quality_rules":
            long = [d for d, t in before.items() if labels.get(d) == 1 and len(t.split()) >= 20]
            assert all(d in after for d in long) and not [d for d in after if labels.get(d) == 0 and "!! " in before[d]]
        elif name == "ngram_join":
            assert set(after) == {d for d, (_, c) in components(list(before.items())).items() if c == d}
        elif name == "decontamination":
            assert set(before) - set(after) == {d for d, _ in passages(before, bench)}
        elif name == "secret_scan":
            assert set(after) == set(before)
            for d, text in before.items():
                spans = base_spans(text)
                assert (after[d]["text"] == text) == (not spans) and not base_spans(after[d]["text"]) and after[d]["n_chars"] == (len(after[d]["text"]) if spans else after[d]["n_chars"])
        else:
            import numpy as np

            assert all(np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(before[d]) for d, r in after.items()) and set(after) == set(before)
    assert kept["byte_bpe"]


def test_run_takes_awkward_rows(spark, edge, empty, tmp_path):
    bench = spark.createDataFrame([(1, None)], "item_id long, text string")
    for name, docs, least in (("edge", edge, 2), ("empty", empty, 0)):
        place = f"{tmp_path}/{name}"
        docs.drop("_metadata").write.parquet(f"{place}/documents.parquet")
        bench.write.parquet(f"{place}/benchmark.parquet")
        got = corpus_pipeline.run(spark, place).collect()
        assert [r["doc_id"] for r in sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"]))] == [1, None][:least]


def test_rows_that_repeat_an_id_are_judged_by_their_texts(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    rows = [(5, one), (5, two), (5, two), (9, two), (7, three), (7, three + " more"), (7, "x y z " + one), (None, one)]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.keep_distinct(spark, docs, SMALL)
    assert got.columns == corpus_pipeline.COLUMNS
    # of `two` the row whose id is its own stays, of `one` and of `three` one row each
    kept = sorted((r["text"][:2], r["doc_id"]) for r in got.where("doc_id is not null").collect())
    assert [t for t, _ in kept] in (["a0", "b0", "c0"], ["b0", "c0", "x "]) and ("b0", 9) in kept and got.where("doc_id is null").count() == 1

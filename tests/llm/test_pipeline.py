"""The pipeline's stages, each against brute force on its own input."""

import numpy as np

import corpus_pipeline
from galvan.llm import near_dedup, quality_rules, secrets, sentencepieces
from galvan.llm.common import written

from .test_operators import brute_classes

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = [near_dedup.words_of(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, before, DATA), "test")
        was, now = {r.doc_id: r.text for r in before.collect()} if "text" in before.columns else {}, {r.doc_id: r for r in after.collect()}
        if name == "quality rules":
            assert set(now) == {r.doc_id for r in quality_rules.judge(before, least_words=quality_rules.STAGE_WORDS).filter("kept").collect()} and 0 < len(now) < len(was)
        elif name == "MinHash near-dedup":
            classes = brute_classes(sorted(was.items()))
            assert set(now) == set(classes.values()) and len(now) < len(was)
        elif name == "benchmark decontamination":
            has = {i for i, t in was.items() if any(" " + " ".join(b) + " " in " " + " ".join(near_dedup.words_of(t)) + " " for b in bench)}
            assert set(was) - set(now) == has
        elif name == "secret scans":
            found = {r.doc_id for r in secrets.scan(before).filter("spans <> ''").collect()}
            assert set(now) == set(was) and {i for i in was if now[i].text != was[i]} == found
        else:
            codec = sentencepieces.Codec(sentencepieces.load(sentencepieces.default_model()))
            assert {i: codec.decode(np.array(r.ids)).decode() for i, r in now.items()} == was
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        before = after


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


ODD = ["__key", "__h", "__n", "__id", "__found", "__first", "__i", "__masked", "key", "KEY_", "h", "i", "n", "of", "first", "spans", "masked", "row", "class_id", "kept", "chars", "words"]


def odd_rows(spark):
    text = " ".join(f"word{i % 37} other{i % 41}" for i in range(120))
    rows = [(1, text, "en"), (1, text, "en"), (2, text + " more", None), (None, text, "en"), (None, None, None), (3, "", "en"), (4, "password: hunter2222x " + text[:300], "en"), (5, None, "en")]
    return spark.createDataFrame([(i, t, la, "s", 7, *[f"{c}-{k}" for c in ODD]) for k, (i, t, la) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in ODD))


def test_columns_of_any_name_nulls_and_empty_tables(spark):
    docs = odd_rows(spark)
    none = docs.filter("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, DATA)
        assert got.columns == docs.columns
        mine = {tuple(r[c] for c in ODD) for r in docs.collect()}
        assert {tuple(r[c] for c in ODD) for r in got.collect()} <= mine, name
        assert stage(spark, none, DATA).collect() == []
    kept = {r["__key"] for r in near_dedup.stage(spark, docs, DATA).collect()}
    # one row of the texts that are alike, the row with a password, and one without words for each doc_id
    assert len(kept & {f"__key-{k}" for k in (0, 1, 2, 3)}) == 1 and {"__key-4", "__key-5", "__key-6", "__key-7"} <= kept
    masked = {r["__key"]: r for r in secrets.stage(spark, docs, DATA).collect()}
    assert len(masked) == 8 and "hunter2222x" not in masked["__key-6"].text and masked["__key-0"].n_chars == 7
    assert len(sentencepieces.stage(spark, docs, DATA).collect()) == 8
    # end to end, on a table with nulls and on an empty one
    for table, most in ((docs, 8), (none, 0)):
        for _, stage in corpus_pipeline.STAGES:
            table = written(stage(spark, table, DATA), "test")
        assert table.count() <= most

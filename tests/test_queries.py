"""Every query against its SQL in DuckDB, on the smallest tables."""

import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from galvan.functions import lexicon, text, tokens
from galvan.plans import catalog

from . import cases
from .test_folds import edit_distance, plain_alignment

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return repr(v)
    return str(int(v)) if isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    if name not in catalog.SQL:
        assert rows
        return
    expected = duck.sql(catalog.SQL[name])
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    assert rows == sorted(tuple(shown(r[i]) for i in at) for r in expected.fetchall())


@pytest.mark.parametrize("name", sorted(cases.CASES))
def test_case(spark, name):
    """Small inputs whose results are known."""
    df = cases.CASES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    expected = duckdb.sql(cases.SQL[name])
    at = [expected.columns.index(c) for c in columns]
    assert rows == sorted(tuple(shown(r[i]) for i in at) for r in expected.fetchall())


def test_alignment_of_words(spark):
    """Queries without SQL against the whole table of costs."""
    for r in catalog.QUERIES["h10_word_alignment"](spark, DATA).collect():
        assert [(p.reference, p.hypothesis) for p in r.pairs] == plain_alignment(r.a, r.b)
    words = {r.doc_id: (r.text or "").split() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    items = {r.item_id: r.text.split() for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    got = {r.item_id: (r.same, r.missing, r.added) for r in catalog.QUERIES["h10_documents"](spark, DATA).collect()}
    assert set(got) == set(items) & set(words)
    for i in sorted(got, key=lambda i: len(words[i]))[:12]:
        pairs = plain_alignment(items[i], words[i])
        assert got[i] == (sum(p == q for p, q in pairs), sum(q is None for _, q in pairs), sum(p is None for p, _ in pairs))


def test_cuts_between_sentences(spark):
    def score(left, right, words, n):
        one = lambda ref, ws: edit_distance(ref, "".join(ws)) / max(1, len(ref))
        return one(left, words[:n]) + one(right, words[n:])

    for r in catalog.QUERIES["h6_best_cut"](spark, DATA).limit(15).collect():
        joined = list(spark.createDataFrame([(list(r.words),)], "w array<string>").select(*[text.align_form(F.array_join(F.slice("w", i, 1), "")).alias(f"w{i}") for i in range(1, len(r.words) + 1)]).first())
        best = min(score(r.left, r.right, joined, n) for n in range(1, len(joined)))
        assert abs(score(r.left, r.right, joined, r.cut) - best) < 0.1
    halves = {}
    for r in catalog.QUERIES["h7_resolved"](spark, DATA).collect():
        halves.setdefault(r.item_id, {})[r.sentence] = r
    assert halves
    for h in halves.values():
        a, b = h[0], h[1]
        both = list(a.words) + list(b.words)
        assert a.hi == b.lo == len(a.words) and b.hi == len(both)
        scores = [score(a.text, b.text, both, n) for n in range(1, len(both))]
        assert scores.index(min(scores)) + 1 == len(a.words)


def test_normalized_stream(spark):
    got = catalog.QUERIES["k10_normalized_stream"](spark, DATA).collect()
    lines = spark.createDataFrame([(r.value,) for r in got], "value string").select("value", tokens.normalized(F.col("value"), lexicon.small()).alias("said"))
    assert {(r.value, r.normalized) for r in got} == {tuple(r) for r in lines.collect()} and sum(r.n for r in got) > 50


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_error_rates_of_whole_texts(spark, tmp_path):
    same = " ".join(f"word{chr(97 + i)}" for i in range(25))
    many = [f"w{i}" for i in range(9000)]
    pairs = [(1, same, same + " more words here"), (2, same, same), (3, same + " end", same), (4, "a b c", ""), (5, " ".join(many), f"{many[8200]} {many[8195]}"), (6, "été\n\n là", "la été")]
    for name, key, at in (("benchmark", "item_id", 1), ("documents", "doc_id", 2)):
        spark.createDataFrame([(p[0], p[at]) for p in pairs], f"{key} bigint, text string").write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.item_id: (r.edits, r.words) for r in catalog.QUERIES["h11_wer"](spark, str(tmp_path)).collect()}
    assert got == {i: (edits(a.split(), b.split()), len(a.split())) for i, a, b in pairs}
    folded = lambda t: re.sub("[^a-z ]", "", t.lower())
    got = {r.item_id: r.cer for r in catalog.QUERIES["h11_cer"](spark, str(tmp_path)).collect()}
    assert got == {i: round(edits(folded(a), folded(b)) / len(folded(a)), 9) for i, a, b in pairs}

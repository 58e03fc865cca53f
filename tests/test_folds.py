"""Operators that walk ordered rows: against plain versions, and on parts too large for one array."""

import random
import tracemalloc
import xml.etree.ElementTree as ET

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from galvan.functions import text as T
from galvan.operators import corpus
from galvan.operators.edits import UNIT, aligned_words, distances
from galvan.sources import sinks


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


WORDS = st.text(st.sampled_from("abcß🎉"), max_size=6)


@settings(deadline=None, max_examples=200)
@given(WORDS, st.lists(WORDS, max_size=6))
def test_distances(word, others):
    assert distances(word, others).tolist() == [edit_distance(word, o) for o in others]


def plain_alignment(a, b):
    """The whole cost table."""
    swap = lambda i, j: edit_distance(a[i], b[j]) * UNIT // max(1, len(a[i]))
    cost = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i or j:
                cost[i][j] = min([cost[i - 1][j] + UNIT] * (i > 0) + [cost[i][j - 1] + UNIT] * (j > 0) + ([cost[i - 1][j - 1] + swap(i - 1, j - 1)] if i and j else []))
    out, i, j = [], len(a), len(b)
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + swap(i - 1, j - 1):
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
        elif i and cost[i][j] == cost[i - 1][j] + UNIT:
            i -= 1
            out.append((a[i], None))
        else:
            j -= 1
            out.append((None, b[j]))
    return out[::-1]


def test_alignment_of_random_pairs():
    r = random.Random(4)
    for _ in range(500):
        a = ["".join(r.choice("abcd") for _ in range(r.randint(0, 4))) for _ in range(r.randint(0, 14))]
        b = [w if r.random() < 0.6 else "".join(r.choice("abcd") for _ in range(3)) for w in a if r.random() < 0.8] + ["x"] * r.randint(0, 2)
        assert aligned_words(a, b) == plain_alignment(a, b)


def test_alignment_of_long_texts_in_little_memory():
    r = random.Random(5)
    a = [f"w{r.randint(0, 400)}" for _ in range(10_000)]
    b = [w for w in a if r.random() > 0.05]
    tracemalloc.start()
    pairs = aligned_words(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20  # the whole table would take 760 MB
    assert [p for p, _ in pairs if p is not None] == a and [q for _, q in pairs if q is not None] == b
    assert sum(p == q for p, q in pairs) > 9_000


def plain_joined(rows):
    """rows: (start, end, text, opens, open, full), sorted."""
    out = []
    for s, e, t, opens, open_, full in rows:
        if out:
            ls, le, lt, lopen, lfull = out[-1]
            if (lopen and opens and s - le < 1.5 and e - ls < 15) or (lfull and full and s - le < 2 and e - ls < 6):
                out[-1] = (ls, e, f"{lt} {t}", open_, lfull and full)
                continue
        out.append((s, e, t, open_, full))
    return [(s, e, t) for s, e, t, _, _ in out]


def test_joined_segments(spark):
    r = random.Random(6)
    texts = ["Full sentence.", "Open start and", "then goes on,", "small full.", "Another one!", "", "and ends."]
    rows = [(p, 1.0 * i + r.choice([0, 0.5]), 1.0 * i + r.choice([0.7, 1.2, 3.0]), r.choice(texts)) for p in ("a", "b", None) for i in range(60)]
    df = spark.createDataFrame(rows, "part string, start double, end double, text string").repartition(4)
    flags = {x.text: (x.a, x.b, x.c) for x in df.select("text", T.is_start_open(F.col("text")).alias("a"), T.is_end_open(F.col("text")).alias("b"), T.is_full_sentence(F.col("text")).alias("c")).distinct().collect()}
    got = corpus.joined_segments(df, ["part"]).collect()
    for p in ("a", "b", None):
        want = plain_joined([(s, e, t, *flags[t]) for _, s, e, t in sorted(x for x in rows if x[0] == p)] if p else [(s, e, t, *flags[t]) for _, s, e, t in sorted((x for x in rows if x[0] is None), key=lambda x: x[1:])])
        assert sorted((g.start, g.end, g.text) for g in got if g.part == p) == sorted(want) and len(want) < 60
    assert corpus.joined_segments(df.filter("false"), ["part"]).collect() == []


def test_joined_segments_of_one_long_part(spark):
    rows = spark.range(400_000).select(F.lit(1).alias("part"), (F.col("id") * 2.0).alias("start"), (F.col("id") * 2.0 + 1).alias("end"), F.when(F.col("id") % 3 == 0, "Begins and").otherwise("goes on,").alias("text"))
    got = corpus.joined_segments(rows, ["part"]).agg(F.count("*").alias("n"), F.max("end").alias("e"), F.max(F.length("text")).alias("t")).first()
    assert got.n < 200_000 and got.e == 799_999.0 and got.t < 200


def test_elan_times_never_run_backwards(spark):
    r = random.Random(7)
    rows = [(f, round(r.uniform(0, 30), 3), round(r.uniform(0, 30), 3), f"a<b & {i}") for f in "xy" for i in range(40)]
    got = {x.file: x.value for x in sinks.elan_document(spark.createDataFrame(rows, "file string, start double, end double, text string").repartition(5)).collect()}
    for f in "xy":
        times, last = [], 0
        for _, s, e, _ in sorted(x for x in rows if x[0] == f):
            for t in (s, e):
                last = max(last, round(t * 1000))
                times.append(last)
        root = ET.fromstring(got[f])
        assert [int(t.get("TIME_VALUE")) for t in root.iter("TIME_SLOT")] == times
        assert [t.text for t in root.iter("ANNOTATION_VALUE")] == [t for _, _, _, t in sorted(x for x in rows if x[0] == f)]
        assert [t.get("TIME_SLOT_REF2") for t in root.iter("ALIGNABLE_ANNOTATION")] == [f"ts{2 * i + 2}" for i in range(40)]


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_row_numbers_by_ranges(spark, n):
    df = spark.range(n).select((F.col("id") * 7919 % 1000).alias("x"), F.lit("s").alias("__i2")).repartition(7)
    got = corpus.numbered(df, F.desc("x")).collect()
    assert sorted((r.row, r.x) for r in got) == [(i + 1, x) for i, x in enumerate(sorted((i * 7919 % 1000 for i in range(n)), reverse=True))]
    both = corpus.zipped(df, "x", spark.range(3).select(F.col("id").alias("y")), "y").collect()
    assert sorted((r.x, r.y) for r in both) == [(x, y) for y, x in enumerate(sorted(i * 7919 % 1000 for i in range(n))[:3])]

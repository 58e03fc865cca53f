"""Steps that whole tables go through: what they hold at once, and odd rows."""

import os
import subprocess
import sys
import tracemalloc
from dataclasses import replace
from types import FunctionType

import duckdb
import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from galvan.functions import inverse, lexicon, numbers, text, tokens
from galvan.plans import catalog, file_queries
from galvan.sources import files

LEX = lexicon.small()


def test_tokens_beside_rows(spark):
    """Some texts at a time, with the tokens that a column function gives."""
    assert list(tokens.slices(np.array([3, 3, 9, 1, 1]), 4)) == [(0, 1), (1, 2), (2, 3), (3, 5)]
    texts = [None, "", "Demat Marie Gall, penaos (emañ) ar bed ?", "12 000 euro ha 92 ki…", "un den " * 90_000, "It. Bras h.a."]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string").coalesce(1)
    for persons in (False, True):
        want = df.select("n", tokens.tokenized(F.col("text"), LEX, persons=persons).alias("tokens")).collect()
        assert tokens.with_tokens(df, ["n"], F.col("text"), LEX, persons=persons).collect() == want
        assert want[0].tokens is None and want[1].tokens == []
    some = tokens.with_tokens(df, [], F.col("text"), LEX, ("data",), only=("QUANTITY",)).collect()
    plain = df.select(tokens.tokenized(F.col("text"), LEX).alias("tokens")).collect()
    assert [r.tokens and [t.data for t in r.tokens] for r in some] == [r.tokens and [t.data for t in r.tokens if t.type == "QUANTITY"] for r in plain]
    assert sum(len(r.tokens or []) for r in some) == 2


def test_tokens_are_handed_over_some_at_a_time(spark):
    df = spark.range(400).select(F.repeat(F.lit("un den "), 3000).alias("text")).coalesce(1)
    got = tokens.with_tokens(df, [], F.col("text"), LEX, ("type",))
    assert got.select(F.sum(F.size("tokens"))).first()[0] == 400 * 6000
    assert max(b - a for a, b in tokens.slices(np.full(400, 21_000))) * 21_000 <= tokens.AT_ONCE


def test_numbers_below_a_thousand_are_parsed_once(spark):
    """Of many different numbers the parts recur; nouns within them and words behind them count as before."""
    said = inverse.Inverse(LEX, 1)
    parsed, real = [], inverse.Grammar._thousand
    inverse.Grammar._thousand = lambda self, i: (parsed.append(i), real(self, i))[1]
    try:
        numbers = range(1, 40_000_000, 4001)
        assert [said.digits(f"bez eus {tokens.spelled(n)} anezho") for n in numbers] == [f"bez eus {n} anezho" for n in numbers]
    finally:
        inverse.Grammar._thousand = real
    assert len(parsed) < len(numbers) / 2
    for said_text in ("pemp bloaz warn-ugent, daou ha tregont kazh.", "div blac'h kozh ha daou-ugent kazh du", "hanter kant mil ki", "un", "ur milion", "mann", "daou warn ugent, un ki bras ha tregont"):
        fresh, plain = inverse.Inverse(LEX, 1), [inverse.Said(w) for w in said_text.split()]
        assert said.digits(said_text) == fresh.digits(said_text) == " ".join(x.word for x in said.words(plain))


def test_timecoded_rows(spark):
    """Rows that are null or empty, and rows without numbers, some at a time."""
    rows = [(0, None), (1, []), (2, [("un", 0.0, 1.0, 0.5), ("den", 1.0, 2.0, None)]), (3, [("pemp", 0.0, 1.0, 1.0), ("bloaz", 2.0, 3.0, 1.0), ("warn-ugent,", 4.0, 5.0, 1.0)])] * 9000
    df = spark.createDataFrame(rows, f"n int, words array<{inverse.WORD}>").coalesce(1)
    got = df.select("n", inverse.digits_timecoded(F.col("words"), LEX, 5).alias("x")).groupBy("n", "x").count().orderBy("n").collect()
    assert [r["count"] for r in got] == [9000] * 4
    assert [r.x and [tuple(w) for w in r.x] for r in got] == [None, [], [("un", 0.0, 1.0, 0.5), ("den", 1.0, 2.0, None)], [("25", 0.0, 4.0, 1.0), ("bloaz,", 4.0, 5.0, 1.0)]]


def test_numbers_of_more_than_twelve_digits(spark, tmp_path):
    """e1_number_words reads the last twelve digits, as its SQL does."""
    spark.createDataFrame([(1.0,), (0.0,)], "l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    keys = [1, 125_153, 149_999, 9 * 10**6, 10**12, 10**12 + 2, 1_002_000_004]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    duck = duckdb.connect()
    for t in ("lineitem", "orders"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = {(r.k, r.m, r.f) for r in catalog.QUERIES["e1_number_words"](spark, str(tmp_path)).collect()}
    assert got == set(duck.sql(catalog.SQL["e1_number_words"]).fetchall())
    assert spark.range(1).select(numbers.number_words(F.lit(10**12))).first()[0] is None


def test_transcripts_share_files(spark, tmp_path, monkeypatch):
    """Files are not as many as utterances."""
    monkeypatch.setattr(file_queries, "scratch", lambda spark, what: f"file://{tmp_path}/{what}")
    spark.range(300).select(F.col("id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), F.lit('a "b" a\n{x}').alias("text")).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {tuple(r) for r in catalog.QUERIES["a33_cached_transcripts"](spark, str(tmp_path)).collect()}
    assert got == {("a", 600, 300.0), ('"b"', 300, 150.0), ("x", 300, 450.0)}
    assert len(list(tmp_path.glob("transcripts/**/part-*"))) < 20


def test_beginnings_of_texts(spark):
    texts = [None, "", "a b", " a  . b, -- (c) d", "... ! ?", "1 22222 3 x y", "a\nb\tc", "«a» «b» «c»d e"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    heads = lambda c: F.slice(text.masked_tokens(c), 1, 3)
    for r in df.select("text", heads(F.col("text")).alias("want"), heads(text.beginning(F.col("text"), 3)).alias("got")).collect():
        assert r.got == (r.want if r.want is None or len(r.want) == 3 else []), r


def test_nouns_within_numbers(spark):
    nouns = ["bloaz", "kazh", "levr", "den"]
    rows = spark.range(0, 2200).select("id", *[numbers.number_noun(F.col("id"), F.lit(w)) for w in nouns]).collect()
    for n, *got in rows:
        assert got == [tokens.spelled_with(n, w) for w in nouns], n


def test_names_are_made_once(spark):
    """The mutated forms come from the same scan as the names; they win over names of their form."""
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda w: (seen.add(1), w)[1])
    names = [("Per", ["P EH R"]), ("Ber", ["B EH R"]), ("Yann", ["Y A N"]), ("Tangi", ["T A", "X"]), ("M", [])]
    df = spark.createDataFrame(names, "word string, prons array<string>").withColumn("word", count.asNondeterministic()("word"))
    got = {r.word: r.prons for r in files.mutated_names(df).collect()}
    assert got == {"Per": ["P EH R"], "Ber": ["B EH R"], "Ver": ["V EH R"], "Yann": ["Y A N"], "Tangi": ["T A", "X"], "Dangi": ["D A", "X"], "M": [], "V": []}
    assert seen.value == len(names)


def test_plain_tokens_are_small():
    """Tokens without flags or readings hold no sets or lists of their own."""
    t, said = tokens.Tokenizer(LEX), "un den a gomz " * 5000
    t.tokens(said)
    tracemalloc.start()
    found = t.tokens(said)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 20_000 and peak < 250 * len(found)


def test_simple_words_are_not_taken_to_pieces(monkeypatch):
    """A word with a mark behind it at most needs none of the patterns for pieces, which give the same."""
    lex = replace(LEX, abbreviations={"It.": "Itron", "st": "sant", "kazh,": "x"})
    t = tokens.Tokenizer(lex)
    words = "demat kazh, kazh. kazh) (kazh) c'hwec'h a·b It. It, st st. st, A. AB. a.b den... den.. den€ den2. 'n - -- ‚ den‚ x’ ’’ ſk Ñañ ÀB! h.a. h.a…".split()
    for w in words:
        assert t._scan(w) == t._pieces(w), w
    plain = [f"{a}{b}z{c}" for a in "dkl" for b in "aeiou" for c in ["", ",", "!", "»"]]
    monkeypatch.setattr(tokens, "_PIECES", ())
    assert [x.data for x in t.tokens(" ".join(plain)) if x.type != "END_OF_SENTENCE"] == [y for w in plain for y in ((w[:3], w[3:]) if w[3:] else (w,))]


def test_values_share_parts(monkeypatch):
    """Millions of numbers in words have a few thousand parts; each is taken through the grammar once."""
    parsed, init = [], inverse.Grammar.__init__
    monkeypatch.setattr(inverse.Grammar, "__init__", lambda self, *a, **k: (parsed.append(1), init(self, *a, **k))[1])
    some = range(0, 90_000_000, 4001)
    assert [inverse.value(tokens.spelled(n).split()) for n in some] == list(some)
    assert len(parsed) < len(some) / 5
    odd = {"mil": 1000, "hanter mil": 500, "hanter mil unan": None, "hanter milion mil": None, "milion hanter mil": 1_000_500, "pevarzek mil pevarzek kant": None, "pevarzek kant": 1400, "mil mann": None, "mann": 0, "": None, "daou milion milion": None, "ur miliard daou vilion tri mil pevar": 1_002_003_004, "mil x": None}
    assert {k: inverse.value(k.split()) for k in odd} == odd


def test_few_texts_at_once(spark):
    """What a function makes of texts goes back some rows at a time, not as one batch of all of them."""
    held = tokens.text_udf(lambda t: f"{pa.total_allocated_bytes()} {t}" if t else t)
    df = spark.range(0, 2000, 1, 1).select(F.when(F.col("id") % 500 > 0, F.repeat(F.lit("un den a gomz "), 1400)).alias("text"))
    got = df.select("text", held(F.col("text")).alias("held")).select(F.split("held", " ", 2).alias("p"), "text").agg(F.max(F.col("p")[0].cast("long")), F.sum(F.col("p")[1].eqNullSafe(F.col("text")).cast("int"))).first()
    assert got[0] < 1 << 20 and got[1] == 2000


def test_clauses_are_said_once(monkeypatch):
    """Lines are said as a whole would be; clauses that recur are said once, and a worker that gets the functions again for each task still knows them."""
    monkeypatch.setattr(tokens, "text_udf", lambda f: lambda c: f)
    seen, raw = [], tokens.Tokenizer.raw
    monkeypatch.setattr(tokens.Tokenizer, "raw", staticmethod(lambda x: (seen.append(x), raw(x))[1]))
    t = tokens.Tokenizer(LEX)
    lines = [f"{q} kazh, {k} 000 euro, {q}% hag {s}km." for q in (1, 12, 21) for k in range(1, 12) for s in range(1, 12)]
    want = [t.rendered(t.normalized(t.tokens(x)), normalize=True) for x in lines]
    said = tokens.normalized("text", LEX)
    seen.clear()
    assert [said(x) for x in lines] == want and len(seen) == 3 + 11 + 33
    again = FunctionType(tokens._clauses.__code__, dict(tokens._clauses.__globals__))
    assert again("a") is tokens._clauses("a") is not again("b")
    odd = [
        "", ",", ", 5 ki", "5, 000 ki", "12, 345, 000 km, l", "5 ki , 000 ki", "5 ki,  000 ki", "GBB AB, CD, AB. EF, GH", "kazh., Den, den", "Hirio, hirio, 'hirio", "a, b,, c", "a, (b, c), d", "«5 ki, 6 ki», 7 ki", '"5 ki, 6 ki", 7',
        "{a, b} 5 ki, 6 ki", "It. Gall, Ao. Bras, h.a.", "9e15, 3vet, XIV, XIVvet, 5", "un ki, " * 40, "un ki, " * 20 + "5 ki", "den...den, den.., ...den", "a\n, b\tc, 5\xa0ki", "12 ki, ", "_a, b_, c", "1.000€, 5%, % a", "²a, 3², ³",
    ]
    for options in ({}, {"norm_case": True}, {"autocorrect": True, "norm_punct": True, "norm_case": True}, {"capitalize": True}):
        said, case = tokens.normalized("text", LEX, **options), options.get("norm_case", False)
        plain = lambda x: t.rendered(t.normalized(t.tokens(x, options.get("autocorrect", False), options.get("norm_punct", False)), case), options.get("capitalize", False), normalize=True)  # noqa: B023, E731
        for x in odd:
            assert said(x) == said(x) == plain(x), (x, options)
    comma = replace(LEX, abbreviations={"kazh,": "x/"})
    assert tokens.normalized("text", comma)("un kazh, ki, ki") == "un x/ki, ki"


def test_functions_travel_by_value(monkeypatch, tmp_path):
    """Workers need no package on their path."""
    for module in (tokens, inverse):
        monkeypatch.setattr(module, "text_udf", lambda f: lambda c: f)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for f, text in ((tokens.normalized("text", LEX), "5 kazh, 21 ki"), (inverse.post_processed("text", LEX, normalize=True), "pemp kazh")):
        worker = [sys.executable, "-c", "import sys; from pyspark import cloudpickle; print(cloudpickle.load(sys.stdin.buffer)(sys.argv[1]))", text]
        got = subprocess.run(worker, input=cloudpickle.dumps(f), cwd=tmp_path, env=env, capture_output=True)
        assert got.stdout.decode().strip() == f(text), got.stderr[-500:]

"""Lexicons as tables: the rows of those in the plan, and at real size."""

from pyspark.sql import functions as F

from galvan.functions import lexicon, phonetics, tokens
from galvan.sources import lexicons

LEX = lexicon.Lexicon(
    first_names={"Yann": ["Y A N"], "Marie": [], "Anna": ["A N A", "A N N A"]}, last_names={"Gall": ["G A L"], "Yann": ["X"]}, places={"Brest": ["B R EH S T"]}, acronyms={"GBB": ["J E B E B E"], "TV": ["T E V E", "T V"]},
    proper_nouns={"Nedeleg": ["N"]}, said_only={"football": ["F OU T B A L"], "ok": ["O K E"]}, said_also={"ti": ["T EE"], "ok": ["O K"]}, countries={"Breizh": ["B"]},
)
WORDS = ["Yann", "yann", "Anna-TV", "GBB", "B", "b", "Ñ", "tra-mañ-tra", "football", "FOOTBALL", "ok", "Ok", "ti", "Ti", "euh", "x1-ti", "Brest-Gall", "Breizh", "", "-", "kazh", None, "Anna-Anna-Anna"]


def entries(spark, lex):
    rows = [(kind, w, list(said)) for kind in lexicons.PRONOUNCED for w, said in getattr(lex, kind).items()]
    return spark.createDataFrame(rows, lexicons.SCHEMA)


def test_phonetized_as_in_the_plan(spark):
    words = spark.createDataFrame([(w, i) for i, w in enumerate(WORDS * 2)], "word string, w int").repartition(3)
    p = phonetics.phonetized(F.col("word"), LEX)
    want = {r.w: (r.v, r.e) for r in words.select("w", p["variants"].alias("v"), p["errors"].alias("e")).collect()}
    got = lexicons.phonetized(words, "word", entries(spark, LEX)).collect()
    assert len(got) == len(WORDS) * 2
    for r in got:
        assert (r.variants, r.errors) == want[r.w] or (r.word is None and r.variants is None), r


def test_named_as_in_the_plan(spark):
    words = spark.createDataFrame([(w,) for w in WORDS], "word string")
    names = spark.createDataFrame([("Yann",), ("Anna",), ("TV",), ("Yann",)], "word string")
    want = {r.word: r.n for r in words.select("word", tokens.name_parts_in(F.col("word"), {"Yann", "Anna", "TV"}).alias("n")).collect()}
    assert {r.word: r.name for r in lexicons.named(words, "word", names).collect()} == want


def test_plan_does_not_grow_with_the_lexicon(spark, tmp_path):
    spark.range(200_000).select(F.lit("places").alias("kind"), F.concat(F.lit("place"), "id").alias("word"), F.array(F.concat(F.lit("P "), "id")).alias("said")).write.parquet(f"{tmp_path}/big")
    big, words = spark.read.parquet(f"{tmp_path}/big"), spark.range(0, 300_000, 7).select(F.concat(F.lit("place"), "id").alias("word"))
    big.limit(10).write.parquet(f"{tmp_path}/little")
    size = lambda e: len(lexicons.phonetized(words, "word", e)._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(big) - size(spark.read.parquet(f"{tmp_path}/little"))) < 2000
    got = {r.word: r.variants for r in lexicons.phonetized(words, "word", big).collect()}
    lex = lexicon.Lexicon(places={f"place{i}": [f"P {i}"] for i in range(200_000)})
    some = [w for i, w in enumerate(sorted(got)) if i % 40 == 0]
    rule = phonetics.phonetized_series(lex)
    import pandas as pd

    assert [got[w] for w in some] == rule(pd.Series(some)).tolist() and len(got) == -(-300_000 // 7)


def test_scan(spark, tmp_path):
    (tmp_path / "places.tsv").write_text("# places\nPariz P A R I Z\nBrest B R EH S T # said\nBrest\nBrest B R E S T\nMari M A\n")
    (tmp_path / "nouns_m.tsv").write_text("kazh\n  ki  \n\nkazh\n")
    (tmp_path / "corrected.tsv").write_text("hirio\thiziv\nhirio\thiziv an deiz\nnetra\n")
    (tmp_path / "other.tsv").write_text("not a lexicon\n")
    got = sorted((r.kind, r.word, r.said) for r in lexicons.scan(spark, str(tmp_path)).collect())
    assert got == sorted([
        ("places", "Pariz", ["P A R I Z"]), ("places", "Brest", ["B R E S T"]), ("places", "Mari", ["M A"]), ("places", "Bariz", ["B A R I Z"]), ("places", "Vrest", ["V R E S T"]), ("places", "Vari", ["V A"]),
        ("nouns_m", "kazh", []), ("nouns_m", "ki", []), ("corrected", "hirio", ["hiziv", "an", "deiz"]), ("corrected", "netra", []),
    ])


def test_order_of_lines_over_splits(spark, tmp_path):
    (tmp_path / "acronyms.tsv").write_text("".join(f"w{i % 50} V{i}\n" if i != 4000 else "w0\n" for i in range(6000)))
    had = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r.word: r.said for r in lexicons.scan(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", had)
    assert got["w0"] == [f"V{i}" for i in range(4050, 6000, 50)] and got["w7"] == [f"V{i}" for i in range(7, 6000, 50)]


def test_corrected(spark):
    e = spark.createDataFrame([("corrected", "hirio", ["hiziv", "c'hoazh"]), ("standard", "hirio", ["x"]), ("standard", "breman", ["bremañ"]), ("corrected", "empty", [])], lexicons.SCHEMA)
    words = spark.createDataFrame([("Hirio",), ("breman",), ("other",), (None,), ("empty",)], "word string")
    got = {r.word: r.replaced for r in lexicons.corrected(words, "word", e, "corrected", "standard").collect()}
    assert got == {"Hirio": ["Hiziv", "c'hoazh"], "breman": ["bremañ"], "other": None, None: None, "empty": None}

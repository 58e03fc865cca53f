"""Functions on small hand-written cases."""

import pytest
from pyspark.sql import functions as F

from galvan.functions import inverse, lexicon, numbers, phonetics, text, tokens
from galvan.operators import metadata, signal
from galvan.sources import files, sinks

from .test_folds import edit_distance

LEX = lexicon.small()


def one(spark, column, *values):
    """The column over rows (s, )."""
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string").orderBy("i").select(column).collect()]


def test_capitalize(spark):
    assert one(spark, text.capitalize(F.col("s")), "'vit se", "c'hoar", "", None, "12", "éa") == ["'Vit se", "C'hoar", "", None, "12", "Éa"]


def test_predicates_of_empty_and_null(spark):
    for f in (text.is_full_sentence, text.is_start_open, text.is_end_open, text.is_word, text.is_title, text.is_time):
        assert one(spark, f(F.col("s")), "", None) == [False, None]


@pytest.mark.parametrize("n,words", [(0, "mann"), (1, "unan"), (21, "unan warn-ugent"), (70, "dek ha tri-ugent"), (75, "pemzek ha tri-ugent"), (92, "daouzek ha pevar-ugent"), (55, "pemp hag hanter-kant"), (200, "daou c'hant"), (1789, "mil seizh kant nav ha pevar-ugent"), (2000, "daou vil"), (1000000, "ur milion")])
def test_numbers(spark, n, words):
    assert spark.range(1).select(numbers.number_words(F.lit(n))).first()[0] == words == tokens.spelled(n)


def test_numbers_agree_with_the_python_form(spark):
    rows = spark.range(0, 3000).select("id", numbers.number_words(F.col("id")), numbers.number_words(F.col("id"), True), numbers.number_noun(F.col("id"), F.lit("bloaz"))).collect()
    for n, m, f, years in rows:
        assert (m, f) == (tokens.spelled(n), tokens.spelled(n, n < 1000))
        if n:
            assert years == tokens.spelled_with(n, "bloaz")


@pytest.mark.parametrize("said,written", [("92 ki", "daouzek ki ha pevar-ugent"), ("12 000 euro", "daouzek mil euro"), ("9e15", "nav eur ha kard"), ("Demat It. Marie", "Demat Itron Marie"), ("12 2010", "daouzek daou vil dek"), ("1kg sukr, 21 kg bleud, 11kg", "ur c'hilo sukr, ur c'hilo warn-ugent bleud, unnek kilo")])
def test_normalized(spark, said, written):
    assert one(spark, tokens.normalized(F.col("s"), LEX), said) == [written]


@pytest.mark.parametrize("said,written", [("pemp kazh ha c'hwec'h pesk", "5 kazh ha 6 pesk"), ("pemp bloaz warn-ugent", "25 bloaz"), ("daou vil tregont", "2030"), ("pemp ha netra", "5 ha netra")])
def test_digits(spark, said, written):
    assert one(spark, inverse.digits(F.col("s"), LEX, 4), said) == [written]


NOUNS = lexicon.Lexicon(nouns_m={"den", "marc'h", "kazh", "pesk", "korn-boud", "ki", "bloaz"}, nouns_f={"plac'h", "patatezenn"})


@pytest.mark.parametrize(
    "said,written",
    [
        ("un den", "un den"), ("ur marc'h", "ur marc'h"), ("peder plac'h", "4 plac'h"), ("ur c'hant bennak a dud", "100 bennak a dud"), ("er bloavez mil nav c'hant pevar ha pevar-ugent", "er bloavez 1984"),
        ("naontek kant c'hwec'h ha tregont", "1936"), ("kant daou vil pevarzek", "102014"), ("unan daou tri staget mat ar c'hi", "unan daou tri staget mat ar c'hi"),
        ("seizh eizh nav deomp da c’hoari atav", "7 8 9 deomp da c’hoari atav"), ("kant tri patatezenn hag hanter-kant am eus debret", "153 patatezenn am eus debret"), ("dek den mil kazh", "10 den 1000 kazh"),
        ("daou gorn-boud warn-ugent", "22 gorn-boud"), ("ar c'hoant da zaou vil daou ha tregont", "ar c'hoant da 2032"), ("kant hanter-kant den a oa", "150 den a oa"),
        ("ar bardelloù e Pariz mil pemp kant eizh ha pevar-ugent mil c'hwec'h kant eizh ha daou-ugent mil eizh kant tregont...", "ar bardelloù e Pariz 1588 1648 1830..."),
        ("ar bardelloù e Pariz mil pemp kant eizh ha pevar-ugent mil c'hwec'h kant eizh ha daou-ugent mil eizh kant tregont", "ar bardelloù e Pariz 1588 1648 1830"),
        ("div blac'h kozh ha daou-ugent", "42 blac'h kozh"), ("div blac'h kozh ha daou-ugent aet d'an anaon", "42 blac'h kozh aet d'an anaon"), ("daou gi bihan warn-ugent.", "22 gi bihan."),
        # two numbers, as a noun follows the second; the first is below 4
        ("div blac'h kozh ha daou-ugent kazh du", "div blac'h kozh ha 40 kazh du"), ("pemp plac'h kozh ha daou-ugent kazh du", "5 plac'h kozh ha 40 kazh du"), ("pemp kazh ha daou-ugent pesk", "5 kazh ha 40 pesk"),
        ("pemp kazh pesk ha daou-ugent", "5 kazh pesk ha 40"), ("pemp kazh hag hag hanter-kant", "5 kazh hag hag 50"),
        ("tri ha ha", "tri ha ha"), ("warn ugent ki", "warn 20 ki"), ("naontek % ha tri ugent", "79 %"), ("daou vilion tri c'hant mil hag unan", "2300000 hag unan"), ("hanter milion", "500000"), ("", ""),
    ],
)
def test_digits_of_sentences(spark, said, written):
    assert one(spark, inverse.digits(F.col("s"), NOUNS, 4), said) == [written]
    timed = F.transform(F.filter(F.split("s", " "), lambda w: w != ""), lambda w, i: F.struct(w.alias("word"), (i * 2.0).alias("start"), (i * 2.0 + 1).alias("end"), F.lit(1.0).alias("conf")))
    got = one(spark, inverse.digits_timecoded(timed, NOUNS, 4), said)[0]
    assert " ".join(x.word for x in got) == written and all(a.start < b.start and a.end <= b.start for a, b in zip(got[:-1], got[1:], strict=True))


def test_values_are_those_of_the_words():
    """All numbers below 10,000 and larger ones, both ways."""
    for n in [*range(1, 10_000), *range(10_000, 2_000_000, 7919), *range(10**6, 4 * 10**9, 123456789)]:
        assert inverse.value(tokens.spelled(n).split()) == n, n
    assert inverse.value(["zero"]) == 0 and inverse.value([]) is None and inverse.value(["ha"]) is None and inverse.value("mil vil".split()) is None


def test_substitutions_by_brute_force(spark):
    import random

    table = {("a",): ["1"], ("a", "b"): ["2", "2"], ("b", "c", "a"): ["3"], ("c", "c"): ["c"]}
    r = random.Random(4)
    rows = [[r.choice("abcABCd") for _ in range(r.randrange(12))] for _ in range(200)] + [None]
    got = spark.createDataFrame([(i, w) for i, w in enumerate(rows)], "i int, w array<string>").select("i", inverse.substituted(F.col("w"), table).alias("x")).orderBy("i").collect()
    for row, g in zip(rows, got, strict=True):
        expected, i = [], 0
        while row and i < len(row):
            n = next((n for n in (3, 2, 1) if tuple(x.lower() for x in row[i : i + n]) in table and i + n <= len(row)), 0)
            expected += table[tuple(x.lower() for x in row[i : i + n])] if n else [row[i]]
            i += n or 1
        assert g.x == (None if row is None else expected)


def test_timecodes_rise(spark):
    rows = spark.createDataFrame([([(w, 2.0 * i, 2.0 * i + 1, 1.0) for i, w in enumerate("pemp bloaz warn ugent ha netra".split())],)], f"w array<{inverse.WORD}>")
    got = rows.select(inverse.digits_timecoded(F.col("w"), LEX)).first()[0]
    assert all(a.start < b.start for a, b in zip(got[:-1], got[1:], strict=True)) and [x.word for x in got] == ["25", "bloaz", "ha", "netra"]


@pytest.mark.parametrize("s", ["Demat deoc'h, penaos emañ ?", "(GBB).", "« Ya », emezañ.", "un [dra] \"all\" eo."])
def test_detokenized_is_the_same(spark, s):
    assert one(spark, tokens.detokenized(tokens.tokenized(F.col("s"), LEX)), s)[0].replace(" ", " ") == s.replace(" ", " ")


def test_persons(spark):
    t = tokens.tokenized(F.col("s"), LEX, persons=True)
    for got in one(spark, t, "Marie Gall", "Ao. Gall", "Yann ar Bras", "It. Marie Gall"):
        assert [x.type for x in got] == ["PERSON"]


def test_phonetized(spark):
    p = phonetics.phonetized(F.col("s"), LEX)
    assert one(spark, p["variants"], "B", "kazh", "GBB", "football", "ti", "E") == [["B E"], ["K A Z"], ["J E B E B E"], ["F OU T B A L"], ["T I", "T EE"], ["EU", "E"]]


def test_regions():
    rows = metadata.parse_file(["{spk: Yann Gall; gender: m} Demat {lang: fr} oui {lang: br} mat {start: 1; end: 2}", "", "# no", "{train: false} gevier"], unwanted={"train": "false"})
    assert [r["text"].strip() for r in rows[0]["regions"]] == ["Demat", "oui", "mat"] and (rows[0]["start"], rows[0]["end"]) == (1.0, 2.0)
    assert rows[1]["regions"][0]["text"] is None and rows[1]["regions"][0]["meta"]["speaker"] == "yann_gall"


def test_timecode(spark):
    got = [r[0] for r in spark.createDataFrame([(10.0,), (100.5,), (0.0,), (1.25,), (120.0,)], "t double").select(sinks.timecode(F.col("t"))).collect()]
    assert got == ["10", "100.5", "0", "1.25", "120"]


def test_ali_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "Demat", 0.0, 1.5), ("a", "Kenavo", 2.0, 3.25)], "file string, text string, start double, end double")
    sinks.write_ali(rows, str(tmp_path / "out"), {"media_path": "a.wav", "lang": "br"})
    written = spark.read.text(str(tmp_path / "out")).orderBy("value")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ali").write_text("\n".join(r.value for r in spark.read.text(str(tmp_path / "out")).select("value").coalesce(1).collect()))
    got = files.ali_sentences(spark, str(tmp_path / "in")).orderBy("start").select("text", "start", "end").collect()
    assert written.count() >= 2 and [tuple(r) for r in got] == [("Demat", 0.0, 1.5), ("Kenavo", 2.0, 3.25)]


def test_subtitles_and_elan(spark):
    eaf = '<A><TIME_ORDER><TIME_SLOT TIME_SLOT_ID="t1" TIME_VALUE="0"/><TIME_SLOT TIME_SLOT_ID="t2" TIME_VALUE="1500"/></TIME_ORDER><TIER TIER_ID="Transcription"><ANNOTATION><ALIGNABLE_ANNOTATION TIME_SLOT_REF1="t1" TIME_SLOT_REF2="t2"><ANNOTATION_VALUE>Demat</ANNOTATION_VALUE></ALIGNABLE_ANNOTATION></ANNOTATION></TIER></A>'
    got = files.elan(spark.createDataFrame([("x", eaf)], "file string, text string")).collect()
    assert [tuple(r) for r in got] == [("x", 0.0, 1.5, "Demat")]
    assert [tuple(r)[1:] for r in files.elan(sinks.elan_document(spark.createDataFrame([("x", 0.0, 1.5, "a & b")], "file string, start double, end double, text string")).withColumnRenamed("value", "text")).collect()] == [(0.0, 1.5, "a & b")]


def test_split_at_silence():
    import numpy as np

    x = np.concatenate([np.ones(4000), np.zeros(8000), np.ones(4000)])
    parts = signal.split_once(x, 16000)
    assert len(parts) == 2 and parts[0][0] == 0 and parts[1][1] == len(x) and parts[0][1] < parts[1][0]
    assert signal.split_once(np.zeros(0), 16000) == [] and signal.split_once(np.zeros(1), 16000) == []


def test_streams(spark, tmp_path):
    from galvan.streaming import streams

    (tmp_path / "a.txt").write_text("12 ki\n")
    q = streams.normalized_lines(streams.lines(spark, str(tmp_path)), LEX).writeStream.format("memory").queryName("said").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.normalized for r in spark.table("said").collect()] == ["daouzek ki"]


def test_remembered_words_change_nothing(spark):
    """The cascade with and without what a worker remembers, twice over the same texts."""
    rows = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("text").collect()] + ["Demat It. Marie Gall. 12 000 euro ha 92 ki, XIV, 3vet. Hirio (GBB) 9e15", "12 mil 3 bloaz 5km l m"] * 2
    fresh, kept = tokens.Tokenizer(LEX), tokens.Tokenizer(LEX)
    fresh.REMEMBERED = 0
    for autocorrect in (False, True):
        for t in rows:
            assert [x.row() for x in kept.tokens(t, autocorrect, True, True)] == [x.row() for x in fresh.tokens(t, autocorrect, True, True)]


def test_latest_version(spark):
    models = spark.createDataFrame([("a", "1.9", "x"), ("b", "1.10", "x"), ("c", "1.10.beta", "x"), ("d", "2", "y"), ("e", None, "z")], "name string, version string, type string")
    assert {r.type: r.name for r in files.latest(models, "type").collect()} == {"x": "c", "y": "d", "z": "e"}


def test_bootstrap_against_a_normal_interval(spark):
    from galvan.operators import align

    rows = spark.range(4000).select("id", (F.xxhash64("id") % 5 == 0).cast("int").alias("a"), (F.xxhash64("id", F.lit(2)) % 3 == 0).cast("int").alias("b"), F.lit(1).alias("w"))
    p = rows.agg(F.avg("a")).first()[0]
    low, high = align.bootstrap(rows, "a", "w", 400).first()
    half = 1.96 * (p * (1 - p) / 4000) ** 0.5
    assert abs(low - (p - half)) < 0.3 * half and abs(high - (p + half)) < 0.3 * half
    assert align.bootstrap(rows.repartition(7), "a", "w", 400).first() == (low, high)
    d = align.paired_bootstrap(rows, "a", "b", "w", 400).first()
    assert d.low < d.high < 0 and d.p_value < 0.01 and align.paired_bootstrap(rows.withColumn("c", F.col("a")), "a", "c", "w", 50).first().p_value == 1.0


def test_align_form_of_strings(spark):
    values = ["- Demat Deni ! Pelec’h emaout ?", "c'hoazh {a: b} <TRA> Sach", "ñ ň ã ŠŠ aa--bb", "", "C'HWEC'H ùê hh"]
    assert one(spark, text.align_form(F.col("s")), *values) == [text.align_form_of(v) for v in values]


def test_alignment_by_brute_force(spark):
    import random

    from galvan.operators import align

    r = random.Random(3)
    pool = "demat kazh sac hent c'h hoarz ki an ar bed emaout trugarez".split()
    sentences, words = [], []
    for doc in range(3):
        heard = [r.choice(pool) for _ in range(25)]
        words += [(doc, i, w) for i, w in enumerate(heard)]
        for k, a in enumerate(range(0, 25, 6)):
            said = [w if r.random() < 0.8 else r.choice(pool) for w in heard[a : a + 6]]
            sentences.append((doc, k, " ".join(said)))
    got = align.aligned(spark.createDataFrame(sentences, "doc int, pos int, text string"), spark.createDataFrame(words, "doc int, pos int, word string"), "doc").collect()
    form = text.align_form_of
    for doc in range(3):
        own, heard = [s for d, _, s in sentences if d == doc], [w for d, _, w in words if d == doc]
        total, before = sum(len(s.replace("'", "").split()) for s in own), 0
        for k, s in enumerate(own):
            ref, best = form(s), None
            for i in range(len(heard)):
                scores = []
                for n in range(1, min(len(heard) - i, 2 * len(ref) + 20) + 1):
                    x = edit_distance(ref, form("".join(heard[i : i + n]))) / len(ref) * 0.5 + abs(i / len(heard) - before / total) * 0.5
                    if scores and x > scores[-1]:
                        break
                    scores.append(x)
                if best is None or scores[-1] < best[0] - 1e-12:
                    best = scores[-1], i, i + len(scores)
            g = next(x for x in got if (x.doc, x.sentence) == (doc, k))
            assert abs(g.score - best[0]) < 1e-9 and (g.lo, g.hi) == best[1:], (doc, k)
            before += len(s.replace("'", "").split())


def test_refinement_finds_what_the_first_pass_misses(spark):
    """A repeated sentence is first found far off; its neighbours then hold it in place. Reliable matches never get fewer."""
    from galvan.operators import align

    said = ["demat deoc'h holl tudoù", "ya", "penaos emañ ar bed hiziv", "ya", "trugarez vras deoc'h c'hwi", "ya", "kenavo ar wech all"]
    heard = " ".join(said).split()
    sentences = spark.createDataFrame([(p, i, s) for p in (1, 2) for i, s in enumerate(said)], "doc int, pos int, text string")
    words = spark.createDataFrame([(1, i * 3, w) for i, w in enumerate(heard)] + [(2, i, w) for i, w in enumerate(heard[:2] + heard[3:])], "doc int, pos int, word string")
    once = align.reliability(align.aligned(sentences, words.withColumn("pos", F.when(F.col("doc") == 1, (F.col("pos") / 3).cast("int")).otherwise(F.col("pos"))), "doc"), "doc", F.when(F.col("doc") == 1, len(heard)).otherwise(len(heard) - 1))
    sure = lambda df: df.filter("reliability IN ('O', 'o')").count()
    got = align.refined(sentences, words, "doc")
    assert got.count() == 2 * len(said) and sure(got) >= sure(once)
    at, expected = 0, []
    for s in said:
        expected.append((at, at + len(s.split())))
        at += len(s.split())
    found = [(r.lo, r.hi) for r in got.filter("doc = 1").orderBy("sentence").collect()]
    assert found == expected

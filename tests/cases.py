"""Small inputs whose results are known, as cases of the library's functions: the rows in Spark and the same as SQL."""

from dataclasses import replace

from pyspark.sql import functions as F

from galvan.functions import inverse, lexicon, numbers, phonetics, text, tokens
from galvan.operators import align as A
from galvan.operators import metadata as M
from galvan.plans.text_queries import _LEX, _frame, _rows
from galvan.sources import files

CASES = {}
SQL = {}


def query(name, sql=None):
    def add(f):
        CASES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_SAMPLE = ["Demat It. Marie Gall, penaos emañ ar bed ?", "12 000 euro ha 92 ki.", "(GBB).", "pemp!...", "Hirio e oa 3 bloaz.", "d'ar 3e, 9e15", "{spk: a} <NTT> un dra- mañ", "C. Kozh an Bras h.a…", "XIV ha 2010 12 34"]


@query("d9_tokens")
def _(spark, d):
    t = tokens.tokenized(F.col("s"), _LEX, autocorrect=True, norm_punct=True)
    return _frame(spark, _SAMPLE, "s").select("s", F.posexplode(t).alias("pos", "t")).select("s", "pos", "t.*")


@query("d8_persons")
def _(spark, d):
    return _frame(spark, _SAMPLE, "s").select("s", F.explode(tokens.tokenized(F.col("s"), _LEX, persons=True)).alias("t")).filter("t.type = 'PERSON'").select("s", "t.data")


@query("d10_d12_rendered")
def _(spark, d):
    t = tokens.tokenized(F.col("s"), _LEX)
    return _frame(spark, _SAMPLE, "s").select("s", tokens.detokenized(t).alias("same"), tokens.detokenized(t, end="\n", capitalize=True).alias("sentences"), tokens.autocorrected(F.col("s"), _LEX).alias("corrected"))


_ARTICLES = [("kazh", True, False), ("kador", False, True), ("tour", False, True), ("gwezenn", False, True), ("gar", False, True), ("bag", False, True), ("Maouez", False, True), ("levr", True, False), ("den", True, False), ("dor", False, True), ("taol", True, True)]


@query("e3_e4_articles")
def _(spark, d):
    return _frame(spark, _ARTICLES, "noun, m, f").select("noun", F.explode(numbers.article_noun(F.col("noun"), "ar", F.col("m"), F.col("f"))).alias("reading"))


_ORD = ["1añ", "3vet", "12vet", "IIvet", "XIVvet", "XXXV", "XL", "x"]


@query("e6_e7_ordinals")
def _(spark, d):
    c = F.col("s")
    return _frame(spark, _ORD, "s").select("s", numbers.ordinal_words(c).alias("ordinal"), numbers.roman_words(c).alias("roman"), numbers.roman_ordinal_words(c).alias("roman_ordinal"))


@query("e8_e9_normalized")
def _(spark, d):
    return _frame(spark, _SAMPLE, "s").select("s", tokens.normalized(F.col("s"), _LEX, autocorrect=True, norm_punct=True, capitalize=True).alias("said"))


_SPOKEN = ["pemp kazh ha c'hwec'h pesk", "daou vil tregont", "pemp bloaz warn-ugent", "tri-ugent den", "hanter-kant ki", "mil nav c'hant tregont", "ur c'hazh ha pemp mañ", "an dra se"]


@query("e10_e12_digits")
def _(spark, d):
    rows = _frame(spark, _SPOKEN, "s")
    timed = F.transform(text.split_words(F.col("s")), lambda w, i: F.struct(w.alias("word"), (i * 2.0).alias("start"), (i * 2.0 + 1).alias("end"), F.lit(1.0).alias("conf")))
    return rows.select("s", inverse.digits(F.col("s"), _LEX, 4).alias("digits"), F.to_json(inverse.digits_timecoded(timed, _LEX, 4)).alias("timed"))


@query("e14_e16_post_processed")
def _(spark, d):
    timed = F.transform(text.split_words(F.col("s")), lambda w, i: F.struct(w.alias("word"), (i * 2.0).alias("start"), (i * 2.0 + 1).alias("end"), F.lit(1.0).alias("conf")))
    return _frame(spark, _SPOKEN, "s").select("s", inverse.post_processed(F.col("s"), _LEX, normalize=True, keep_fillers=False).alias("text"), F.to_json(inverse.post_processed_timecoded(timed, _LEX, normalize=True)).alias("timed"))


@query("f1_phonetized")
def _(spark, d):
    words = ["tra-mañ-tra", "B", "GBB", "kazh", "football", "euh", "ti", "Brest", "xx1", "c'hoarzh"]
    p = phonetics.phonetized(F.col("s"), _LEX)
    return _frame(spark, words, "s").select("s", F.array_join(p["variants"], "|").alias("said"), p["errors"].alias("errors"))


@query("f2_phones", f"SELECT DISTINCT unnest(string_split(s, ' ')) AS phone FROM {_rows([*phonetics.SAID.values(), *phonetics.FILLERS.values(), *(x for v in phonetics.LETTER_NAMES.values() for x in v)], 's')}")
def _(spark, d):
    said = [*phonetics.SAID.values(), *phonetics.FILLERS.values(), *(x for v in phonetics.LETTER_NAMES.values() for x in v)]
    return _frame(spark, said, "s").select(F.explode(F.split("s", " ")).alias("phone")).distinct()


_LINES = [
    "Gwin roz {spk: b11_paotr1; gender:m} {start: 60.139; end: 62.972}",
    "Demat {?} deoc'h {Yann Ar Gall} ha {?}",
    "hep titl",
    "{tags: a b, c; lang: fr; foo: bar} Bonjour {speaker: XYZ}",
]


@query("g5_extracted_metadata")
def _(spark, d):
    x = M.extracted(F.col("s"))
    return _frame(spark, _LINES, "s").select("s", x["text"].alias("text"), F.to_json(x["meta"]).alias("meta"), F.array_join(F.transform(x["unknown"], lambda u: u.cast("string")), ",").alias("unknown"))


_FILE = "{source: test}\n{lang: br}\nDemat {spk: Yann Gall; gender: m}Ya {lang: fr}oui {lang: br}mat {start: 1.5; end: 3}\n# comment\n{spk: Marie} Kenavo {start: 3; end: 4.25}\n{YG} Echu {train: false} gevier {start: 5; end: 6}"


@query("g1_regions")
def _(spark, d):
    parsed = M.parsed(_frame(spark, [("a.ali", _FILE)], "file, text"))
    return parsed.select("line", "start", "end", F.explode("regions").alias("r")).select("line", "start", "end", "r.text", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("r.meta")))).alias("meta"))


@query("g2_g6_squeezed")
def _(spark, d):
    lines = M.utterances(M.parsed(_frame(spark, [("a.ali", _FILE)], "file, text"), unwanted={"train": "false"}))
    s = M.squeezed(F.col("regions"), "br")
    return lines.select("line", s["text"].alias("text"), s["meta"]["speaker"].alias("speaker"), "start", "end")


@query("a21_subtitles")
def _(spark, d):
    srt = "1\n00:00:01,500 --> 00:00:03,000\nDemat\n deoc'h\n\n2\n00:10:03.250 --> 01:00:04.000\n&lt;i&gt;Ya&lt;/i&gt;&nbsp;\n"
    return files.subtitles(_frame(spark, [("a.srt", srt)], "file, text"))


def _spoken(spark):
    sentences = _frame(spark, [(1, 0, "Demat deoc'h holl."), (1, 1, "Penaos emañ ar bed ?"), (1, 2, "Mat-tre, trugarez deoc'h."), (1, 3, "Kenavo !")], "doc, pos, text")
    words = "demat deoc'h holl penaos eman ar bed mat tre trugarez deoc'h kenavo".split()
    return sentences, _frame(spark, [(1, i, w) for i, w in enumerate(words)], "doc, pos, word"), len(words)


@query("h1_aligned")
def _(spark, d):
    sentences, words, _ = _spoken(spark)
    return A.aligned(sentences, words, "doc").withColumn("score", F.round("score", 9))


@query("h2_reliability")
def _(spark, d):
    sentences, words, n = _spoken(spark)
    return A.reliability(A.aligned(sentences, words, "doc"), "doc", F.lit(n)).withColumn("score", F.round("score", 9))


@query("h8_global_score")
def _(spark, d):
    sentences, words, _ = _spoken(spark)
    return A.global_score(A.aligned(sentences, words, "doc"), sentences, "doc").withColumn("score", F.round("score", 9))


@query("h6_best_cut")
def _(spark, d):
    words = F.array(*[F.lit(w) for w in "demat deoc'h holl penaos emañ ar bed".split()])
    return _frame(spark, [("Demat deoc'h holl", "Penaos emañ ar bed")], "a, b").select("a", A.best_cut(F.col("a"), F.col("b"), words).alias("cut"))


@query("h7_resolved")
def _(spark, d):
    rows = _frame(spark, [(1, 0, "dematdeoX", 0, 3), (1, 1, "olpenaos", 2, 4)], "doc, sentence, text, lo, hi")
    words = F.when(F.col("sentence") == 0, F.array(F.lit("demat"), F.lit("deoX"), F.lit("ol"))).otherwise(F.array(F.lit("ol"), F.lit("penaos")))
    return A.resolved(rows.withColumn("words", words), "doc").select("sentence", "lo", "hi", F.array_join("words", " ").alias("words"))


@query("h10_word_alignment")
def _(spark, d):
    words = lambda *x: F.array(*[F.lit(w) for w in x])
    both = spark.range(1).select(A.word_alignment(words("demat", "deoch", "holl"), words("demat", "deoch", "te", "oll")).alias("a"))
    return both.select(F.posexplode("a").alias("pos", "p")).select("pos", "p.*")


_PLAIN = [("a", 0, "{Yann; parser: me}"), ("a", 1, "Demat"), ("a", 2, "Ya {gender: m}"), ("b", 0, "Nann"), ("b", 1, "{Marie} Kenavo")]


@query("a4_a7_carried")
def _(spark, d):
    return files.carried(_frame(spark, _PLAIN, "file, line, text"))


@query("a8_header")
def _(spark, d):
    text_ = "{source: test}\n{lang: br}\nDemat {start: 0; end: 1}\n{lang: fr} Bonjour {start: 1; end: 2}"
    h = files.header(M.parsed(_frame(spark, [("a.ali", text_)], "file, text")))
    return h.select("file", F.col("meta")["source"].alias("source"), F.col("meta")["lang"].alias("lang"))


_VALUES = [("ugent", 20), ("daou vil tregont", 2030), ("pemp ha tregont", 35), ("hanter kant", 50), ("mil nav kant", 1900)]


@query("e10_number_values", f"SELECT s, CAST(n AS BIGINT) AS n FROM {_rows(_VALUES, 's, n')}")
def _(spark, d):
    worth = F.pandas_udf(lambda s: s.map(lambda x: inverse.value(x.split())), "bigint")
    return _frame(spark, _VALUES, "s, n").select("s", worth("s").alias("n"))


@query("e15_joined_demonstratives")
def _(spark, d):
    return _frame(spark, _SPOKEN, "s").select("s", inverse.post_processed(F.col("s"), lexicon.small()).alias("text"))


@query("d6_numerals")
def _(spark, d):
    t = tokens.tokenized(F.col("s"), lexicon.small())
    rows = _frame(spark, ["12 000 euro", "12 2010 34 kazh", "1.000.000 den", "5km 3% 25 °C", "XIV 3vet IIvet 9e15"], "s")
    return rows.select("s", F.explode(t).alias("t")).filter("t.type IN ('NUMBER', 'QUANTITY', 'ORDINAL', 'ROMAN_NUMBER', 'ROMAN_ORDINAL', 'TIME', 'UNIT')").select("s", "t.data", "t.type", "t.number", "t.unit")


_PHONES = [("a", "B E t d A"), ("b", "_ t t d"), ("c", "")]


@query("f7_phone_lines", "SELECT * FROM (VALUES ('a', '_   100|B   80|EE  100|d   150|A   100|_   100'), ('b', '_   100|_   100|t   90|d   150|_   100'), ('c', '_   100|_   100')) AS t(s, lines)")
def _(spark, d):
    phones = F.filter(F.split("p", " "), lambda x: x != "")
    lines = phonetics.phone_lines(phones, {"E": "EE"}, {"B": 80, "t": 90, "d": 60}, {("t", "d"): "d"}, jitter=0)
    return _frame(spark, _PHONES, "s, p").select("s", F.array_join(lines, "|").alias("lines"))


_SMALL = lexicon.small()
EXAMPLE_LEX = replace(
    _SMALL,
    nouns_m=_SMALL.nouns_m | {"marc'h", "korn-boud", "bit", "babig", "eur", "metr", "kilometr", "kilogramm"},
    nouns_f=_SMALL.nouns_f | {"plac'h", "patatezenn", "skouerenn", "loarenn", "steredenn", "eur"},
)

# Sentences and what they are in words.
NORMALIZED = [
    ("d'an 3 a viz Here", "d'an tri a viz Here"),
    ("1 skouerenn", "ur skouerenn"),
    ("tro dro da 85000 den e Mec'hiko", "tro dro da pemp ha pevar-ugent mil den e Mec'hiko"),
    ("12 000 euro", "daouzek mil euro"),
    ("92 ki", "daouzek ki ha pevar-ugent"),
    ("Ouzhpenn da 42 bemdez", "Ouzhpenn da daou ha daou-ugent bemdez"),
    ("51 dre den", "unan hag hanter-kant dre den"),
    ("da lavaret eo 950km", "da lavaret eo nav c'hant hanter-kant kilometr"),
    ("34% e 2010", "pevar ha tregont dre gant e daou vil dek"),
    ("12e30, 11e35, 9e15, 8e45", "kreisteiz hanter, unnek eur pemp ha tregont, nav eur ha kard, nav eur nemet kard"),
    ("da 5e56 e roas an urzh", "da c'hwec'h eur nemet pevar e roas an urzh"),
    ("Loeiz XVI", "Loeiz c'hwezek"),
    ("kemeret perzh er 7vet hag en 8vet kuzuliadegoù", "kemeret perzh er seizhvet hag en eizhvet kuzuliadegoù"),
    ("en XXIvet kantved", "en un warn-ugentvet kantved"),
    ("d'an oad a 25 bloaz", "d'an oad a pemp bloaz warn-ugent"),
    ("e 1982 e varvas", "e mil nav c'hant daou ha pevar-ugent e varvas"),
    ("1, 1 c'hazh, 21 loarenn", "unan, ur c'hazh, ul loarenn warn-ugent"),
    ("32 687 bit", "daou ha tregont mil c'hwec'h kant seizh bit ha pevar-ugent"),
    ("21000 steredenn", "unan warn-ugent mil steredenn"),
]
# Spoken numbers and what they are in digits, from 4 on.
DIGITS = [
    ("un den", "un den"), ("ur marc'h", "ur marc'h"), ("peder plac'h", "4 plac'h"), ("ur c'hant bennak a dud", "100 bennak a dud"), ("er bloavez mil nav c'hant pevar ha pevar-ugent", "er bloavez 1984"),
    ("naontek kant c'hwec'h ha tregont", "1936"), ("kant daou vil pevarzek", "102014"), ("unan daou tri staget mat ar c'hi", "unan daou tri staget mat ar c'hi"),
    ("seizh eizh nav deomp da c’hoari atav", "7 8 9 deomp da c’hoari atav"), ("kant tri patatezenn hag hanter-kant am eus debret", "153 patatezenn am eus debret"), ("dek den mil kazh", "10 den 1000 kazh"),
    ("pemp kazh ha c'hwec'h pesk", "5 kazh ha 6 pesk"), ("daou gorn-boud warn-ugent", "22 gorn-boud"), ("ar c'hoant da zaou vil daou ha tregont", "ar c'hoant da 2032"), ("kant hanter-kant den a oa", "150 den a oa"),
]
# Article and noun, whether it is masculine or feminine, and the reading with its mutation.
ARTICLES = [("ar", "ki", True, False, "ar c'hi"), ("an", "dor", False, True, "an nor"), ("ur", "kador", False, True, "ur gador"), ("ul", "taol", False, True, "un daol"), ("an", "godell", False, True, "ar c'hodell"), ("ar", "bag", False, True, "ar vag"), ("ar", "mamm", False, True, "ar vamm")]
# Texts and their forms after tokenizing and rendering.
RENDERED = [
    ('"Digoret eo ar brezel douzh ar viruz brein-se."', '"Digoret eo ar brezel douzh ar viruz brein-se."'),
    ("Ha setu perak ‚oa bet divizet ganeomp", "Ha setu perak‚ oa bet divizet ganeomp"),
    ("3 / 4 eus an dud.", "3/4 eus an dud."),
    ("Dindan c'hwec'h vloaz :digoust.", "Dindan c'hwec'h vloaz : digoust."),
    ("unan... daou ...tri ... pevar ....pemp!... c'hwec'h,....seizh", "unan... daou... tri... pevar.... pemp !... c'hwec'h,.... seizh"),
    ("n'eus ster ebet, « na penn na lost» da gement-se.", "n'eus ster ebet, « na penn na lost » da gement-se."),
    ("un abadenn “ mikro digor” tro-dro d’ar rap", "un abadenn “mikro digor” tro-dro d’ar rap"),
    ("Gouel Broadel ar Brezhoneg ( GBB ) .", "Gouel Broadel ar Brezhoneg (GBB)."),
]
# Texts, their tokens and their sentences.
COUNTS = [("unan daou tri", 3, 0), ("demat,deoc'h", 3, 0), ("fin miz Gouere.Laouen e oa", 8, 1), ("Demat. Mont a ra ?", 8, 2), ("\"N'eo ket gwir !\" a huchas heñ.", 11, 1), ("«N'eo ket gwir !» a huchas heñ.", 11, 1)]
# Words and how they are said first.
SAID = [("tra-mañ-tra", "T R A M AN T R A"), ("B", "B E"), ("Ñ", "EH N T I L D E")]
# Sentences, recognised words, and which words each sentence is.
SENTENCES = ["- Demat Bleuenn ! Dale zo ganin, digarez.", "- Demat Deni ! Pelec’h emaout ?", "- E kreiz-kêr Kemper emaon c’hoazh. Stank eo an dremeniri.", "- Mat eo. Gortoz a reomp ac’hanout. Na rez ket bil !", "- Trugarez dit. - Ken bremaik."]
HEARD = "demat bleuñv dale zo ganin digarez nemet enni pelec'h emaout e kreiz kêr Kemper emañ c'hoazh stank eo an dremeniri mat eo gortoz a reont ar c'hannad na rez ket bil trugarez dit kent bremaik"
SPANS = [(0, 6), (6, 10), (10, 20), (20, 31), (31, 35)]


def _shown(rows, wanted: str, name: str) -> str:
    """Of example rows the input s and the wanted result under the query's name for it."""
    return f"SELECT s, {wanted} AS {name} FROM {_rows(rows, 's, ' + wanted)}"


@query("e9_normalized_examples", _shown(NORMALIZED, "wanted", "said"))
def _(spark, d):
    return _frame(spark, NORMALIZED, "s, wanted").select("s", tokens.normalized(F.col("s"), EXAMPLE_LEX).alias("said"))


@query("e11_digits_examples", _shown(DIGITS, "wanted", "digits"))
def _(spark, d):
    return _frame(spark, DIGITS, "s, wanted").select("s", inverse.digits(F.col("s"), EXAMPLE_LEX, 4).alias("digits"))


@query("e4_article_examples", f"SELECT article, noun, wanted FROM {_rows([(a, n, w) for a, n, _, _, w in ARTICLES], 'article, noun, wanted')}")
def _(spark, d):
    rows = _frame(spark, ARTICLES, "article, noun, m, f, wanted")
    reading = F.lit(None).cast("string")
    for article in sorted({a for a, *_ in ARTICLES}):
        found = numbers.article_noun(F.col("noun"), article, F.col("m"), F.col("f"))
        reading = F.when(F.col("article") == article, F.element_at(F.filter(found, lambda x: x == F.col("wanted")), 1)).otherwise(reading)
    return rows.select("article", "noun", reading.alias("wanted"))


@query("d10_rendered_examples", _shown(RENDERED, "wanted", "text"))
def _(spark, d):
    return _frame(spark, RENDERED, "s, wanted").select("s", tokens.detokenized(tokens.tokenized(F.col("s"), EXAMPLE_LEX)).alias("text"))


@query("d2_d4_count_examples", f"SELECT s, CAST(n AS INT) AS n, CAST(m AS INT) AS sentences FROM {_rows(COUNTS, 's, n, m')}")
def _(spark, d):
    t = tokens.tokenized(F.col("s"), EXAMPLE_LEX)
    return _frame(spark, COUNTS, "s, n, m").select("s", F.size(t).alias("n"), F.size(F.filter(t, lambda x: x["type"] == "END_OF_SENTENCE")).alias("sentences"))


@query("f1_said_examples", _shown(SAID, "wanted", "said"))
def _(spark, d):
    return _frame(spark, SAID, "s, wanted").select("s", F.element_at(phonetics.phonetized(F.col("s"), EXAMPLE_LEX)["variants"], 1).alias("said"))


@query("h1_aligned_examples", f"SELECT CAST(sentence AS INT) AS sentence, CAST(lo AS INT) AS lo, CAST(hi AS INT) AS hi FROM {_rows([(i, a, b) for i, (a, b) in enumerate(SPANS)], 'sentence, lo, hi')}")
def _(spark, d):
    sentences = _frame(spark, [(1, i, s) for i, s in enumerate(SENTENCES)], "doc, pos, text")
    words = _frame(spark, [(1, i, w) for i, w in enumerate(HEARD.split())], "doc, pos, word")
    return A.aligned(sentences, words, "doc").select("sentence", "lo", "hi")


def _value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, list):
        return "[" + ", ".join(map(_value, v)) + "]"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def sql(columns: dict[str, str], rows: list[tuple]) -> str:
    names = list(columns)
    picked = ", ".join(f'CAST("{c}" AS {t}) AS "{c}"' for c, t in columns.items())
    values = ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows)
    quoted = ", ".join(f'"{c}"' for c in names)
    return f"SELECT {picked} FROM (VALUES {values}) AS t({quoted})"


# Columns and rows by query.
ROWS: dict[str, tuple[dict[str, str], list[tuple]]] = {
    "a4_a7_carried": (
        {"file": "VARCHAR", "line": "INTEGER", "text": "VARCHAR", "speaker": "VARCHAR", "gender": "VARCHAR", "parser": "VARCHAR"},
        [
            ('a', 1, 'Demat', 'yann', None, 'me'),
            ('a', 2, 'Ya', 'yann', 'm', 'me'),
            ('b', 0, 'Nann', None, None, None),
            ('b', 1, 'Kenavo', 'marie', None, None),
        ],
    ),
    "a8_header": (
        {"file": "VARCHAR", "source": "VARCHAR", "lang": "VARCHAR"},
        [
            ('a.ali', 'test', 'br'),
        ],
    ),
    "a21_subtitles": (
        {"file": "VARCHAR", "n": "INTEGER", "start": "DOUBLE", "end": "DOUBLE", "text": "VARCHAR"},
        [
            ('a.srt', 0, 1.5, 3.0, "Demat deoc'h"),
            ('a.srt', 1, 603.25, 3604.0, 'Ya'),
        ],
    ),
    "d6_numerals": (
        {"s": "VARCHAR", "data": "VARCHAR", "type": "VARCHAR", "number": "VARCHAR", "unit": "VARCHAR"},
        [
            ('12 000 euro', '12000 euro', 'QUANTITY', '12000', 'euro'),
            ('12 2010 34 kazh', '12', 'NUMBER', None, None),
            ('12 2010 34 kazh', '2010', 'NUMBER', None, None),
            ('12 2010 34 kazh', '34 kazh', 'QUANTITY', '34', 'kazh'),
            ('1.000.000 den', '1000000', 'NUMBER', None, None),
            ('5km 3% 25 °C', '5km', 'QUANTITY', '5', 'km'),
            ('5km 3% 25 °C', '3%', 'QUANTITY', '3', '%'),
            ('5km 3% 25 °C', '25°C', 'QUANTITY', '25', '°C'),
            ('XIV 3vet IIvet 9e15', 'XIV', 'ROMAN_NUMBER', None, None),
            ('XIV 3vet IIvet 9e15', '3vet', 'ORDINAL', None, None),
            ('XIV 3vet IIvet 9e15', 'IIvet', 'ROMAN_ORDINAL', None, None),
            ('XIV 3vet IIvet 9e15', '9e15', 'TIME', None, None),
        ],
    ),
    "d8_persons": (
        {"s": "VARCHAR", "data": "VARCHAR"},
        [
            ('Demat It. Marie Gall, penaos emañ ar bed ?', 'It. Marie Gall'),
            ('C. Kozh an Bras h.a…', 'C. Kozh an Bras'),
        ],
    ),
    "d9_tokens": (
        {"s": "VARCHAR", "pos": "INTEGER", "data": "VARCHAR", "norm": "VARCHAR[]", "type": "VARCHAR", "flags": "VARCHAR[]", "number": "VARCHAR", "unit": "VARCHAR"},
        [
            ('Demat It. Marie Gall, penaos emañ ar bed ?', 0, 'Demat', [], 'WORD', ['FIRST_WORD'], None, None),
            ('Demat It. Marie Gall, penaos emañ ar bed ?', 1, 'It.', ['Itron'], 'ABBREVIATION', [], None, None),
            ('Demat It. Marie Gall, penaos emañ ar bed ?', 2, 'Marie', [], 'FIRST_NAME', [], None, None),
            ('Demat It. Marie Gall, penaos emañ ar bed ?', 3, 'Gall', [], 'LAST_NAME', [], None, None),
            ('Demat It. Marie Gall, penaos emañ ar bed ?', 4, ',', [], 'PUNCTUATION', [], None, None),
            ('Demat It. Marie Gall, penaos emañ ar bed ?', 5, 'penaos', [], 'WORD', [], None, None),
            ('Demat It. Marie Gall, penaos emañ ar bed ?', 6, 'emañ', [], 'WORD', [], None, None),
            ('Demat It. Marie Gall, penaos emañ ar bed ?', 7, 'ar', [], 'WORD', [], None, None),
            ('Demat It. Marie Gall, penaos emañ ar bed ?', 8, 'bed', [], 'WORD', [], None, None),
            ('Demat It. Marie Gall, penaos emañ ar bed ?', 9, '?', [], 'PUNCTUATION', [], None, None),
            ('Demat It. Marie Gall, penaos emañ ar bed ?', 10, '', [], 'END_OF_SENTENCE', [], None, None),
            ('12 000 euro ha 92 ki.', 0, '12000 euro', [], 'QUANTITY', ['MASCULINE'], '12000', 'euro'),
            ('12 000 euro ha 92 ki.', 1, 'ha', [], 'WORD', [], None, None),
            ('12 000 euro ha 92 ki.', 2, '92 ki', [], 'QUANTITY', ['MASCULINE'], '92', 'ki'),
            ('12 000 euro ha 92 ki.', 3, '.', [], 'PUNCTUATION', [], None, None),
            ('12 000 euro ha 92 ki.', 4, '', [], 'END_OF_SENTENCE', [], None, None),
            ('(GBB).', 0, '(', [], 'PUNCTUATION', ['OPENING_PUNCT'], None, None),
            ('(GBB).', 1, 'GBB', [], 'ACRONYM', ['FIRST_WORD'], None, None),
            ('(GBB).', 2, ')', [], 'PUNCTUATION', ['CLOSING_PUNCT'], None, None),
            ('(GBB).', 3, '.', [], 'PUNCTUATION', [], None, None),
            ('(GBB).', 4, '', [], 'END_OF_SENTENCE', [], None, None),
            ('pemp!...', 0, 'pemp', [], 'WORD', ['FIRST_WORD'], None, None),
            ('pemp!...', 1, '!', [], 'PUNCTUATION', [], None, None),
            ('pemp!...', 2, '', [], 'END_OF_SENTENCE', [], None, None),
            ('pemp!...', 3, '...', ['…'], 'PUNCTUATION', [], None, None),
            ('Hirio e oa 3 bloaz.', 0, 'Hiziv', [], 'WORD', ['CORRECTED'], None, None),
            ('Hirio e oa 3 bloaz.', 1, 'e', [], 'WORD', [], None, None),
            ('Hirio e oa 3 bloaz.', 2, 'oa', [], 'WORD', [], None, None),
            ('Hirio e oa 3 bloaz.', 3, '3 bloaz', [], 'QUANTITY', ['MASCULINE'], '3', 'bloaz'),
            ('Hirio e oa 3 bloaz.', 4, '.', [], 'PUNCTUATION', [], None, None),
            ('Hirio e oa 3 bloaz.', 5, '', [], 'END_OF_SENTENCE', [], None, None),
            ("d'ar 3e, 9e15", 0, "d'ar", [], 'WORD', ['FIRST_WORD'], None, None),
            ("d'ar 3e, 9e15", 1, '3e', [], 'ORDINAL', [], None, None),
            ("d'ar 3e, 9e15", 2, ',', [], 'PUNCTUATION', [], None, None),
            ("d'ar 3e, 9e15", 3, '9e15', [], 'TIME', [], None, None),
            ('{spk: a} <NTT> un dra- mañ', 0, '{spk: a}', [], 'METADATA', [], None, None),
            ('{spk: a} <NTT> un dra- mañ', 1, '<NTT>', [], 'SPECIAL_TOKEN', ['FIRST_WORD'], None, None),
            ('{spk: a} <NTT> un dra- mañ', 2, 'un', [], 'WORD', [], None, None),
            ('{spk: a} <NTT> un dra- mañ', 3, 'dra-', [], 'WORD', ['STUTTER'], None, None),
            ('{spk: a} <NTT> un dra- mañ', 4, 'mañ', [], 'WORD', [], None, None),
            ('C. Kozh an Bras h.a…', 0, 'C.', [], 'ACRONYM', ['FIRST_WORD'], None, None),
            ('C. Kozh an Bras h.a…', 1, 'Kozh', [], 'LAST_NAME', [], None, None),
            ('C. Kozh an Bras h.a…', 2, 'an', [], 'WORD', [], None, None),
            ('C. Kozh an Bras h.a…', 3, 'Bras', [], 'LAST_NAME', [], None, None),
            ('C. Kozh an Bras h.a…', 4, 'h.a', ['hag all'], 'ABBREVIATION', [], None, None),
            ('C. Kozh an Bras h.a…', 5, '…', [], 'PUNCTUATION', [], None, None),
            ('XIV ha 2010 12 34', 0, 'XIV', [], 'ROMAN_NUMBER', ['FIRST_WORD'], None, None),
            ('XIV ha 2010 12 34', 1, 'ha', [], 'WORD', [], None, None),
            ('XIV ha 2010 12 34', 2, '2010', [], 'NUMBER', [], None, None),
            ('XIV ha 2010 12 34', 3, '12', [], 'NUMBER', [], None, None),
            ('XIV ha 2010 12 34', 4, '34', [], 'NUMBER', [], None, None),
        ],
    ),
    "d10_d12_rendered": (
        {"s": "VARCHAR", "same": "VARCHAR", "sentences": "VARCHAR", "corrected": "VARCHAR"},
        [
            ('Demat It. Marie Gall, penaos emañ ar bed ?', 'Demat It. Marie Gall, penaos emañ ar bed\xa0?', 'Demat It. Marie Gall, penaos emañ ar bed\xa0?\n', 'Demat It. Marie Gall, penaos emañ ar bed\xa0?'),
            ('12 000 euro ha 92 ki.', '12000 euro ha 92 ki.', '12000 euro ha 92 ki.\n', '12000 euro ha 92 ki.'),
            ('(GBB).', '(GBB).', '(GBB).\n', '(GBB).'),
            ('pemp!...', 'pemp\xa0!...', 'Pemp\xa0!\n...', 'pemp\xa0!...'),
            ('Hirio e oa 3 bloaz.', 'Hirio e oa 3 bloaz.', 'Hirio e oa 3 bloaz.\n', 'Hiziv e oa 3 bloaz.'),
            ("d'ar 3e, 9e15", "d'ar 3e, 9e15", "D'ar 3e, 9e15", "d'ar 3e, 9e15"),
            ('{spk: a} <NTT> un dra- mañ', '{spk: a} <NTT> un dra- mañ', '{spk: a} <NTT> un dra- mañ', '{spk: a} <NTT> un dra- mañ'),
            ('C. Kozh an Bras h.a…', 'C. Kozh an Bras h.a…', 'C. Kozh an Bras h.a…', 'C. Kozh an Bras h.a…'),
            ('XIV ha 2010 12 34', 'XIV ha 2010 12 34', 'Xiv ha 2010 12 34', 'XIV ha 2010 12 34'),
        ],
    ),
    "e3_e4_articles": (
        {"noun": "VARCHAR", "reading": "VARCHAR"},
        [
            ('kazh', "ar c'hazh"),
            ('kador', 'ar gador'),
            ('tour', 'an dour'),
            ('gwezenn', 'ar wezenn'),
            ('gar', "ar c'har"),
            ('bag', 'ar vag'),
            ('Maouez', 'ar Vaouez'),
            ('levr', 'al levr'),
            ('den', 'an den'),
            ('dor', 'an nor'),
            ('taol', 'an taol'),
            ('taol', 'an daol'),
        ],
    ),
    "e6_e7_ordinals": (
        {"s": "VARCHAR", "ordinal": "VARCHAR", "roman": "VARCHAR", "roman_ordinal": "VARCHAR"},
        [
            ('1añ', 'kentañ', None, None),
            ('3vet', 'teirvet', None, None),
            ('12vet', 'daouzekvet', None, None),
            ('IIvet', None, None, 'eilvet'),
            ('XIVvet', None, None, 'pevarzekvet'),
            ('XXXV', None, 'pemp ha tregont', None),
            ('XL', None, None, None),
            ('x', None, None, None),
        ],
    ),
    "e8_e9_normalized": (
        {"s": "VARCHAR", "said": "VARCHAR"},
        [
            ('Demat It. Marie Gall, penaos emañ ar bed ?', 'Demat Itron Marie Gall, penaos emañ ar bed\xa0?'),
            ('12 000 euro ha 92 ki.', 'Daouzek mil euro ha daouzek ki ha pevar-ugent.'),
            ('(GBB).', '(GBB).'),
            ('pemp!...', 'Pemp\xa0!…'),
            ('Hirio e oa 3 bloaz.', 'Hiziv e oa tri bloaz.'),
            ("d'ar 3e, 9e15", "D'ar trede, nav eur ha kard"),
            ('{spk: a} <NTT> un dra- mañ', '{spk: a} <NTT> un dra- mañ'),
            ('C. Kozh an Bras h.a…', 'C. Kozh an Bras hag all…'),
            ('XIV ha 2010 12 34', 'Pevarzek ha daou vil dek daouzek pevar ha tregont'),
        ],
    ),
    "e10_e12_digits": (
        {"s": "VARCHAR", "digits": "VARCHAR", "timed": "VARCHAR"},
        [
            ("pemp kazh ha c'hwec'h pesk", '5 kazh ha 6 pesk', '[{"word":"5","start":0.0,"end":1.0,"conf":1.0},{"word":"kazh","start":2.0,"end":3.0,"conf":1.0},{"word":"ha","start":4.0,"end":5.0,"conf":1.0},{"word":"6","start":6.0,"end":7.0,"conf":1.0},{"word":"pesk","start":8.0,"end":9.0,"conf":1.0}]'),
            ('daou vil tregont', '2030', '[{"word":"2030","start":0.0,"end":5.0,"conf":1.0}]'),
            ('pemp bloaz warn-ugent', '25 bloaz', '[{"word":"25","start":0.0,"end":4.0,"conf":1.0},{"word":"bloaz","start":4.0,"end":5.0,"conf":1.0}]'),
            ('tri-ugent den', '60 den', '[{"word":"60","start":0.0,"end":1.0,"conf":1.0},{"word":"den","start":2.0,"end":3.0,"conf":1.0}]'),
            ('hanter-kant ki', '50 ki', '[{"word":"50","start":0.0,"end":1.0,"conf":1.0},{"word":"ki","start":2.0,"end":3.0,"conf":1.0}]'),
            ("mil nav c'hant tregont", '1930', '[{"word":"1930","start":0.0,"end":7.0,"conf":1.0}]'),
            ("ur c'hazh ha pemp mañ", "ur c'hazh ha 5 mañ", '[{"word":"ur","start":0.0,"end":1.0,"conf":1.0},{"word":"c\'hazh","start":2.0,"end":3.0,"conf":1.0},{"word":"ha","start":4.0,"end":5.0,"conf":1.0},{"word":"5","start":6.0,"end":7.0,"conf":1.0},{"word":"mañ","start":8.0,"end":9.0,"conf":1.0}]'),
            ('an dra se', 'an dra se', '[{"word":"an","start":0.0,"end":1.0,"conf":1.0},{"word":"dra","start":2.0,"end":3.0,"conf":1.0},{"word":"se","start":4.0,"end":5.0,"conf":1.0}]'),
        ],
    ),
    "e14_e16_post_processed": (
        {"s": "VARCHAR", "text": "VARCHAR", "timed": "VARCHAR"},
        [
            ("pemp kazh ha c'hwec'h pesk", '5 kazh ha 6 pesk', '[{"word":"5","start":0.0,"end":1.0,"conf":1.0},{"word":"kazh","start":2.0,"end":3.0,"conf":1.0},{"word":"ha","start":4.0,"end":5.0,"conf":1.0},{"word":"6","start":6.0,"end":7.0,"conf":1.0},{"word":"pesk","start":8.0,"end":9.0,"conf":1.0}]'),
            ('daou vil tregont', '2030', '[{"word":"2030","start":0.0,"end":5.0,"conf":1.0}]'),
            ('pemp bloaz warn-ugent', '25 bloaz', '[{"word":"25","start":0.0,"end":4.0,"conf":1.0},{"word":"bloaz","start":4.0,"end":5.0,"conf":1.0}]'),
            ('tri-ugent den', '60 den', '[{"word":"60","start":0.0,"end":1.0,"conf":1.0},{"word":"den","start":2.0,"end":3.0,"conf":1.0}]'),
            ('hanter-kant ki', '50 ki', '[{"word":"50","start":0.0,"end":1.0,"conf":1.0},{"word":"ki","start":2.0,"end":3.0,"conf":1.0}]'),
            ("mil nav c'hant tregont", '1930', '[{"word":"1930","start":0.0,"end":7.0,"conf":1.0}]'),
            ("ur c'hazh ha pemp mañ", "ur c'hazh ha 5 mañ", '[{"word":"ur","start":0.0,"end":1.0,"conf":1.0},{"word":"c\'hazh","start":2.0,"end":3.0,"conf":1.0},{"word":"ha","start":4.0,"end":5.0,"conf":1.0},{"word":"5","start":6.0,"end":7.0,"conf":1.0},{"word":"mañ","start":8.0,"end":9.0,"conf":1.0}]'),
            ('an dra se', 'an dra-se', '[{"word":"an","start":0.0,"end":1.0,"conf":1.0},{"word":"dra-se","start":2.0,"end":5.0,"conf":1.0}]'),
        ],
    ),
    "e15_joined_demonstratives": (
        {"s": "VARCHAR", "text": "VARCHAR"},
        [
            ("pemp kazh ha c'hwec'h pesk", "pemp kazh ha c'hwec'h pesk"),
            ('daou vil tregont', 'daou vil tregont'),
            ('pemp bloaz warn-ugent', 'pemp bloaz warn-ugent'),
            ('tri-ugent den', 'tri-ugent den'),
            ('hanter-kant ki', 'hanter-kant ki'),
            ("mil nav c'hant tregont", "mil nav c'hant tregont"),
            ("ur c'hazh ha pemp mañ", "ur c'hazh ha pemp mañ"),
            ('an dra se', 'an dra-se'),
        ],
    ),
    "f1_phonetized": (
        {"s": "VARCHAR", "said": "VARCHAR", "errors": "INTEGER"},
        [
            ('tra-mañ-tra', 'T R A M AN T R A', 0),
            ('B', 'B E', 0),
            ('GBB', 'J E B E B E', 0),
            ('kazh', 'K A Z', 0),
            ('football', 'F OU T B A L', 0),
            ('euh', 'OE', 0),
            ('ti', 'T I|T EE', 0),
            ('Brest', 'B R EH S T', 0),
            ('xx1', 'K S K S', 1),
            ("c'hoarzh", 'X O A R Z', 0),
        ],
    ),
    "g1_regions": (
        {"line": "INTEGER", "start": "DOUBLE", "end": "DOUBLE", "text": "VARCHAR", "meta": "VARCHAR"},
        [
            (0, None, None, None, '{"source":"test"}'),
            (1, None, None, None, '{"lang":"br","source":"test"}'),
            (2, 1.5, 3.0, 'Demat ', '{"lang":"br","source":"test"}'),
            (2, 1.5, 3.0, 'Ya ', '{"gender":"m","lang":"br","source":"test","speaker":"yann_gall"}'),
            (2, 1.5, 3.0, 'oui ', '{"gender":"m","lang":"fr","source":"test","speaker":"yann_gall"}'),
            (2, 1.5, 3.0, 'mat', '{"gender":"m","lang":"br","source":"test","speaker":"yann_gall"}'),
            (4, 3.0, 4.25, ' Kenavo', '{"gender":"m","lang":"br","source":"test","speaker":"marie"}'),
            (5, 5.0, 6.0, ' Echu ', '{"accent":"unknown","gender":"m","lang":"br","source":"test","speaker":"yann_gall"}'),
            (5, 5.0, 6.0, ' gevier', '{"accent":"unknown","gender":"m","lang":"br","source":"test","speaker":"yann_gall","train":"false"}'),
        ],
    ),
    "g2_g6_squeezed": (
        {"line": "INTEGER", "text": "VARCHAR", "speaker": "VARCHAR", "start": "DOUBLE", "end": "DOUBLE"},
        [
            (2, None, None, 1.5, 3.0),
            (4, 'Kenavo', 'marie', 3.0, 4.25),
            (5, 'Echu', 'yann_gall', 5.0, 6.0),
        ],
    ),
    "g5_extracted_metadata": (
        {"s": "VARCHAR", "text": "VARCHAR", "meta": "VARCHAR", "unknown": "VARCHAR"},
        [
            ('Gwin roz {spk: b11_paotr1; gender:m} {start: 60.139; end: 62.972}', 'Gwin roz', '{"speaker":"b11_paotr1","gender":"m","start":"60.139","end":"62.972"}', ''),
            ("Demat {?} deoc'h {Yann Ar Gall} ha {?}", "Demat {?} deoc'h  ha {?}", '{"speaker":"yann_ar_gall"}', '1,7'),
            ('hep titl', 'hep titl', '{}', ''),
            ('{tags: a b, c; lang: fr; foo: bar} Bonjour {speaker: XYZ}', 'Bonjour', '{"tags":"a_b,c","lang":"fr","foo":"bar","speaker":"XYZ"}', ''),
        ],
    ),
    "h1_aligned": (
        {"doc": "INTEGER", "sentence": "INTEGER", "lo": "INTEGER", "hi": "INTEGER", "score": "DOUBLE"},
        [
            (1, 0, 0, 3, 0.0),
            (1, 1, 3, 7, 0.033333333),
            (1, 2, 7, 11, 0.027777778),
            (1, 3, 11, 12, 0.0),
        ],
    ),
    "h2_reliability": (
        {"doc": "INTEGER", "sentence": "BIGINT", "lo": "INTEGER", "hi": "INTEGER", "score": "DOUBLE", "reliability": "VARCHAR"},
        [
            (1, 0, 0, 3, 0.0, 'O'),
            (1, 1, 3, 7, 0.033333333, 'O'),
            (1, 2, 7, 11, 0.027777778, 'O'),
            (1, 3, 11, 12, 0.0, 'O'),
        ],
    ),
    "h6_best_cut": (
        {"a": "VARCHAR", "cut": "INTEGER"},
        [
            ("Demat deoc'h holl", 3),
        ],
    ),
    "h7_resolved": (
        {"sentence": "INTEGER", "lo": "INTEGER", "hi": "INTEGER", "words": "VARCHAR"},
        [
            (0, 0, 2, 'demat deoX'),
            (1, 2, 4, 'ol penaos'),
        ],
    ),
    "h8_global_score": (
        {"doc": "INTEGER", "score": "DOUBLE"},
        [
            (1, 0.02),
        ],
    ),
    "h10_word_alignment": (
        {"pos": "INTEGER", "reference": "VARCHAR", "hypothesis": "VARCHAR"},
        [
            (0, 'demat', 'demat'),
            (1, 'deoch', 'deoch'),
            (2, None, 'te'),
            (3, 'holl', 'oll'),
        ],
    ),
}

SQL |= {name: sql(columns, rows) for name, (columns, rows) in ROWS.items()}

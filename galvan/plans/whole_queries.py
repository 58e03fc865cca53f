"""Queries over whole tables of what otherwise is shown on a few examples, and round trips through files."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import inverse, lexicon, numbers, phonetics, text, tokens
from ..operators import align as A
from ..operators import metadata as M
from ..sources import files, sinks
from .registry import query, scratch, table
from .text_queries import _WORDS, _frame, lit

_LEX = lexicon.small()
#: One line, without what separates columns or metadata, in both dialects.
_LINE_SQL = r"trim(regexp_replace(regexp_replace(text, '[{}]', '', 'g'), '[\x09-\x0D\x20]+', ' ', 'g'))"


def _lines(spark, d):
    line = F.btrim(F.regexp_replace(F.regexp_replace("text", "[{}]", ""), r"[\x09-\x0D\x20]+", " "))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", line.alias("text")).filter("text <> ''")


_SENTENCES_SQL = f"(SELECT conv_id, turn, role, {_LINE_SQL} AS text FROM conversations WHERE {_LINE_SQL} <> '')"


@query("a22_b5_common_voice", f"SELECT role AS client_id, 'c' || conv_id || '_' || turn || '.mp3' AS path, text AS sentence, CAST(turn AS VARCHAR) AS up_votes, 'br' AS locale FROM {_SENTENCES_SQL}")
def _(spark, d):
    path = scratch(spark, "voice")
    rows = _lines(spark, d).select(F.col("role").alias("client_id"), F.concat(F.lit("c"), "conv_id", F.lit("_"), "turn", F.lit(".mp3")).alias("path"), F.lit("0").alias("sentence_id"), F.col("text").alias("sentence"), F.col("turn").cast("string").alias("up_votes"), F.lit("br").alias("locale"))
    sinks.write_dataset(rows.select(*[c if c in rows.columns else F.lit("").alias(c) for c in files.VOICE_NEW]), path, "tsv")
    return files.common_voice(spark, path).select("client_id", "path", "sentence", "up_votes", "locale")


@query("a23_spontaneous", f"SELECT role AS client_id, 'a' || conv_id || '_' || turn AS audio_id, CAST(turn * 1500 AS VARCHAR) AS duration_ms, text AS transcription FROM {_SENTENCES_SQL}")
def _(spark, d):
    path = scratch(spark, "spontaneous")
    rows = _lines(spark, d).select(F.col("role").alias("client_id"), F.concat(F.lit("a"), "conv_id", F.lit("_"), "turn").alias("audio_id"), (F.col("turn") * 1500).cast("string").alias("duration_ms"), F.col("text").alias("transcription"))
    sinks.write_dataset(rows.select(*[c if c in rows.columns else F.lit("x").alias(c) for c in files.SPONTANEOUS]), path, "tsv")
    return files.spontaneous(spark, path).select("client_id", "audio_id", "duration_ms", "transcription")


@query("a24_scores", f"SELECT 'c' || conv_id AS filepath, CAST(turn AS VARCHAR) AS start, text AS reference, role AS hypothesis, turn / 4.0 AS wer, turn / 8.0 AS cer FROM {_SENTENCES_SQL}")
def _(spark, d):
    path = scratch(spark, "scores")
    turn = F.col("turn").cast("string")
    _lines(spark, d).select(F.concat_ws("\t", F.concat(F.lit("c"), "conv_id"), F.lit("mp3"), turn, turn, "text", "role", (F.col("turn") / 4).cast("string"), (F.col("turn") / 8).cast("string"))).write.text(path)
    return files.scores(spark, path).select("filepath", "start", "reference", "hypothesis", "wer", "cer")


@query("b5_dataset_jsonl", f"SELECT conv_id, turn, text FROM {_SENTENCES_SQL}")
def _(spark, d):
    path = scratch(spark, "jsonl")
    sinks.write_dataset(_lines(spark, d), path)
    return spark.read.schema("conv_id bigint, turn bigint, text string").json(path)


_UTT = "role || '-c' || conv_id || '-' || lpad(CAST(turn * 300 AS VARCHAR), 7, '0') || '-' || lpad(CAST(turn * 300 + 200 AS VARCHAR), 7, '0')"
_KALDI = {
    "segments": f"SELECT concat_ws(' ', {_UTT}, 'c' || conv_id, CAST(turn * 3 AS VARCHAR), CAST(turn * 3 + 2 AS VARCHAR)) AS value FROM conversations",
    "utt2spk": f"SELECT concat_ws(' ', {_UTT}, role) AS value FROM conversations",
    "spk2gender": "SELECT DISTINCT role || CASE role WHEN 'user' THEN ' f' ELSE ' m' END AS value FROM conversations WHERE role IN ('user', 'assistant')",
    "wav.scp": "SELECT DISTINCT 'c' || conv_id || ' c' || conv_id || '.wav' AS value FROM conversations",
    "corpus": "SELECT DISTINCT lower(text) AS value FROM conversations",
}


def _kaldi(name: str):
    def f(spark, d):
        u = table(spark, d, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("rec"), F.col("role").alias("speaker"), (F.col("turn") * 3.0).alias("start"), (F.col("turn") * 3.0 + 2).alias("end"), "text", F.concat(F.lit("c"), "conv_id", F.lit(".wav")).alias("audio"))
        return sinks.kaldi(u, "", _frame(spark, [("user", "female"), ("assistant", "male")], "speaker, gender"))[name]

    return f


for _name, _sql in _KALDI.items():
    query(f"b4_kaldi_{_name.replace('.', '_')}", _sql)(_kaldi(_name))

_MATCHES_SQL = "SELECT conv_id * 100 + turn AS n, text, turn * 2.25 AS s, turn * 2.25 + 1.5 AS e, CASE turn % 3 WHEN 0 THEN 'O' WHEN 1 THEN '?' ELSE 'X' END AS r FROM " + _SENTENCES_SQL
_SECONDS = "regexp_replace(printf('%.3f', CAST({} AS DOUBLE)), '\\.?0+$', '')"


def _matches(spark, d):
    grade = F.element_at(F.array(F.lit("O"), F.lit("?"), F.lit("X")), (F.col("turn") % 3 + 1).cast("int"))
    return _lines(spark, d).select((F.col("conv_id") * 100 + F.col("turn")).alias("n"), "text", (F.col("turn") * 2.25).alias("start"), (F.col("turn") * 2.25 + 1.5).alias("end"), grade.alias("reliability"))


@query("b3_segments", f"SELECT n, CAST(s * 1000 AS BIGINT) || ' ' || CAST(e * 1000 AS BIGINT) AS value FROM ({_MATCHES_SQL}) WHERE r <> 'X'")
def _(spark, d):
    return sinks.exported(_matches(spark, d), "seg")


_ALI = f"text || ' {{start: ' || {_SECONDS.format('s')} || '; end: ' || {_SECONDS.format('e')} || '}}'"


@query("b3_ali", f"SELECT n, {_ALI} AS value FROM ({_MATCHES_SQL}) WHERE r = 'O'")
def _(spark, d):
    return sinks.exported(_matches(spark, d), "ali")


@query("b12_srt_to_ali", f"SELECT 'c' || conv_id AS file, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS n, {_ALI} AS value FROM (SELECT conv_id, turn, text, turn * 2.25 AS s, turn * 2.25 + 1.5 AS e FROM {_SENTENCES_SQL})")
def _(spark, d):
    rows = _lines(spark, d).select("conv_id", "turn", F.col("turn").alias("n"), "text", (F.col("turn") * 2.25).alias("start"), (F.col("turn") * 2.25 + 1.5).alias("end"), F.lit("O").alias("reliability"))
    blocks = sinks.exported(rows.withColumn("n", F.struct("conv_id", "turn")).withColumn("n", F.to_json("n")), "srt")
    shown = blocks.select(F.from_json("n", "conv_id bigint, turn bigint").alias("k"), F.regexp_replace("value", r"^[^\n]*\n", "1\n").alias("value"))
    srt = shown.groupBy("k.conv_id").agg(F.array_sort(F.collect_list(F.struct("k.turn", "value"))).alias("b")).select(F.concat(F.lit("c"), "conv_id").alias("file"), F.array_join(F.transform("b", lambda x: x["value"]), "\n").alias("text"))
    return sinks.subtitles_to_ali(files.subtitles(srt))


@query("g1_regions_whole", f"SELECT 'c' || conv_id AS file, turn * 2.0 AS start, turn * 2.0 + 1.5 AS \"end\", text, role AS speaker, 'br' AS lang FROM {_SENTENCES_SQL} WHERE text NOT LIKE '#%'")
def _(spark, d):
    """Transcripts made of conversations: the speaker stands before each turn, the language once at the top."""
    line = F.concat(F.lit("{spk: "), "role", F.lit("} "), sinks.ali_line(F.col("text"), F.col("turn") * 2.0, F.col("turn") * 2.0 + 1.5))
    rows = _lines(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("b"))
    whole = rows.select(F.concat(F.lit("c"), "conv_id").alias("file"), F.concat(F.lit("{lang: br}\n"), F.array_join(F.transform("b", lambda x: x["line"]), "\n")).alias("text"))
    found = M.utterances(M.parsed(whole)).filter("start IS NOT NULL")
    return found.select("file", "start", "end", F.explode("regions").alias("r")).filter("r.text IS NOT NULL").select("file", "start", "end", F.btrim("r.text").alias("text"), F.col("r.meta")["speaker"].alias("speaker"), F.col("r.meta")["lang"].alias("lang"))


_NAMES = ["The", "Der", "La"]


@query("c19_name_parts", f"SELECT w AS word, len(list_filter(string_split(w, '-'), lambda p: p NOT IN ({', '.join(map(lit, _NAMES))}))) = 0 AS name, count(*) AS n FROM (SELECT unnest({_WORDS}) AS w FROM conversations) GROUP BY ALL")
def _(spark, d):
    words = table(spark, d, "conversations").select(F.explode(text.split_words(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).select("word", tokens.name_parts_in(F.col("word"), set(_NAMES)).alias("name"), "n")


@query(
    "d7_typed_words",
    rf"""SELECT w AS word, CASE WHEN regexp_matches(w, '^[A-Z]+$') THEN 'ACRONYM' WHEN w IN ('Marie', 'Yann', 'Deni') THEN 'FIRST_NAME' ELSE 'WORD' END AS type, count(*) AS n FROM (SELECT unnest({_WORDS}) AS w FROM conversations)
    WHERE regexp_matches(w, '^[A-Za-z]+$') AND length(w) > 1 AND NOT regexp_matches(w, '^[XVI]+$') AND lower(w) NOT IN ({', '.join(lit(x) for x in sorted({w.lower() for w in _LEX.nouns_m | _LEX.nouns_f | set(_LEX.last_names) | set(_LEX.places) | set(_LEX.countries) | set(_LEX.adjectives) | set(_LEX.proper_nouns) | set(_LEX.acronyms)} | set(tokens.FILLERS)))}) AND lower(w) NOT IN ({', '.join(lit(u.lower()) for u in sorted(tokens.UNITS))}) GROUP BY ALL""",
)
def _(spark, d):
    """The typing cascade on every plain word of the table, once a word."""
    plain = F.col("word").rlike("^[A-Za-z]+$") & (F.length("word") > 1) & ~F.col("word").rlike("^[XVI]+$")
    known = sorted({w.lower() for w in _LEX.nouns_m | _LEX.nouns_f | set(_LEX.last_names) | set(_LEX.places) | set(_LEX.countries) | set(_LEX.adjectives) | set(_LEX.proper_nouns) | set(_LEX.acronyms)} | set(tokens.FILLERS) | {u.lower() for u in tokens.UNITS})
    words = table(spark, d, "conversations").select(F.explode(text.split_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter(plain & ~F.lower("word").isin(known))
    typed = tokens.tokenized(F.concat(F.lit("a "), "word"), _LEX)  # not the first word of a sentence
    kind = F.element_at(typed, 2)["type"]
    return words.select("word", kind.alias("type"), "n").filter("type <> 'NOUN'")


_NUMBER_SQL = "(SELECT l_partkey * 50 + CAST(l_quantity AS BIGINT) AS n FROM lineitem)"


def _numbers(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_partkey") * 50 + F.col("l_quantity").cast("bigint")).alias("n")).groupBy("n").agg(F.count("*").alias("rows"))


@query("e11_spelled_numbers", f"SELECT n, 'bez ez eus ' || n || ' anezho' AS digits, count(*) AS rows FROM {_NUMBER_SQL} GROUP BY n")
def _(spark, d):
    """Numbers of the table in words, and in digits again."""
    said = F.concat(F.lit("bez ez eus "), numbers.number_words(F.col("n")), F.lit(" anezho"))
    return _numbers(spark, d).select("n", inverse.digits(said, _LEX, 1).alias("digits"), "rows")


@query("e12_spelled_nouns", f"SELECT n, [n || '', 'kazh'] AS words, 0.0::DOUBLE AS first, count(*) AS rows FROM {_NUMBER_SQL} GROUP BY n")
def _(spark, d):
    """Numbers with a noun within them, as timecoded words."""
    said = F.split(numbers.number_noun(F.col("n"), F.lit("kazh")), " ")
    timed = F.transform(said, lambda w, i: F.struct(w.alias("word"), (i * 2.0).alias("start"), (i * 2.0 + 1).alias("end"), F.lit(1.0).alias("conf")))
    found = _numbers(spark, d).select("n", "rows", inverse.digits_timecoded(timed, _LEX, 1).alias("x"))
    return found.select("n", F.transform("x", lambda x: x["word"]).alias("words"), F.element_at("x", 1)["start"].alias("first"), "rows")


# Without SQL: the cascades on all texts.


@query("d9_tokens_whole")
def _(spark, d):
    """Of every document its tokens by type."""
    found = tokens.with_tokens(table(spark, d, "documents"), ["doc_id"], F.col("text"), _LEX, ("type",))
    return found.select("doc_id", F.explode("tokens").alias("t")).groupBy("doc_id", "t.type").agg(F.count("*").alias("n"))


@query("d8_persons_whole")
def _(spark, d):
    """Runs of words that are taken for names here."""
    named = replace(_LEX, first_names={"The": [], "Der": [], "La": []}, last_names={"And": [], "Die": [], "De": [], "Of": []})
    found = tokens.with_tokens(table(spark, d, "conversations"), [], F.col("text"), named, ("data",), only=("PERSON",), persons=True)
    return found.select(F.explode("tokens").alias("t")).groupBy("t.data").agg(F.count("*").alias("n"))


@query("d10_rendered_whole")
def _(spark, d):
    same = tokens.rerendered(F.col("text"), _LEX)
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(same).alias("same"), F.md5(tokens.autocorrected(F.col("text"), _LEX)).alias("corrected"))


@query("e9_normalized_whole")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tokens.normalized(F.col("text"), _LEX, norm_punct=True)).alias("said"))


@query("e16_post_processed_whole")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(inverse.post_processed(F.col("text"), _LEX, normalize=True, keep_fillers=False)).alias("text"))


@query("f1_phonetized_whole")
def _(spark, d):
    words = table(spark, d, "documents").select(F.explode(text.split_words(F.col("text"))).alias("word")).distinct()
    p = phonetics.phonetized(F.col("word"), _LEX)
    return words.select("word", F.array_join(p["variants"], "|").alias("said"), p["errors"].alias("errors"))


@query("h14_paired_bootstrap")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.expr("l_orderkey * 10 + l_linenumber").alias("id"), (F.col("l_quantity") > 25).cast("int").alias("a"), (F.col("l_quantity") > 24).cast("int").alias("b"), F.lit(1).alias("words"))
    return A.paired_bootstrap(rows, "a", "b", "words", 200)


def _spoken(spark, d):
    """Benchmark items as sentences and, a word in seven left out, as what was heard."""
    items = table(spark, d, "benchmark")
    sentences = items.select("item_id", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("pos", "text"))
    words = items.select("item_id", F.posexplode(text.split_words(F.col("text"))).alias("pos", "word")).filter("pmod(xxhash64(item_id, pos), 7) > 0")
    return sentences, words


@query("h1_h2_aligned_whole")
def _(spark, d):
    sentences, words = _spoken(spark, d)
    counts = words.groupBy("item_id").agg(F.count("*").cast("int").alias("n_words"))
    found = A.aligned(sentences, words, "item_id").join(counts, "item_id")
    return A.reliability(found, "item_id", F.col("n_words")).withColumn("score", F.round("score", 9))


@query("h8_global_score_whole")
def _(spark, d):
    sentences, words = _spoken(spark, d)
    return A.global_score(A.aligned(sentences, words, "item_id"), sentences, "item_id").withColumn("score", F.round("score", 9))


@query("h9_refined_whole")
def _(spark, d):
    sentences, words = _spoken(spark, d)
    return A.refined(sentences, words, "item_id").withColumn("score", F.round("score", 9))



"""Queries through files, archives, streams and sound, all made of the tables at hand."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import affixes, lexicon, text
from ..operators import metadata
from ..operators import signal as S
from ..sources import files, formats, sinks, wav
from ..streaming import delivery, streams, transcripts
from .registry import query, scratch, table
from .text_queries import _WORDS
from .whole_queries import _SENTENCES_SQL, _lines

# Transcripts of conversations: the language once at the top, the speaker before each turn, its time behind it.

_PARSED_SQL = f"SELECT 'c' || conv_id AS file, CAST(turn * 2.0 AS DOUBLE) AS start, CAST(turn * 2.0 + 1.5 AS DOUBLE) AS \"end\", text, role AS speaker, 'br' AS lang FROM {_SENTENCES_SQL}"


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    """file, line, text of the transcripts' lines."""
    rows = _lines(spark, d).withColumn("file", F.concat(F.lit("c"), "conv_id"))
    turn = F.concat(F.lit("{spk: "), "role", F.lit("} "), sinks.ali_line(F.col("text"), F.col("turn") * 2.0, F.col("turn") * 2.0 + 1.5))
    turns = rows.select("file", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("line"), turn.alias("text"))
    return turns.unionByName(rows.select("file").distinct().select("file", F.lit(0).alias("line"), F.lit("{lang: br}").alias("text")))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """file, text of the transcripts."""
    rows = _numbered(spark, d).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("x"))
    return rows.select("file", F.array_join(F.transform("x", lambda x: x["text"]), "\n").alias("text"))


def _spoken(parsed: DataFrame) -> DataFrame:
    found = parsed.filter("start IS NOT NULL").select("file", "start", "end", F.explode("regions").alias("r")).filter("r.text IS NOT NULL")
    return found.select("file", "start", "end", F.btrim("r.text").alias("text"), F.col("r.meta")["speaker"].alias("speaker"), F.col("r.meta")["lang"].alias("lang"))


def _finished(writer) -> None:
    """Runs a stream over what there is."""
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()


def _few_partitions(spark: SparkSession, run) -> None:
    """State is kept for each shuffle partition; for one pass over a table as many as there are cores will do."""
    had = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(had), spark.sparkContext.defaultParallelism)))
    try:
        run()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)


@query("k11_transcript_stream", _PARSED_SQL)
def _(spark, d):
    """Lines of all transcripts, in four files that know nothing of the order of lines, as a stream with state for each transcript."""
    base = scratch(spark, "stream")
    _numbered(spark, d).repartition(4, F.col("text")).write.parquet(f"{base}/in")
    stream = spark.readStream.schema("file string, line int, text string").option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    _few_partitions(spark, lambda: _finished(transcripts.parsed(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")))
    return _spoken(spark.read.schema(transcripts.PARSED).parquet(f"{base}/out"))


def _counted(rows: pd.DataFrame, batch: int) -> pd.DataFrame:
    return pd.DataFrame({"utt": rows["utt"], "words": rows["text"].str.split().map(len)})


@query("k9_delivered", f"SELECT 'c' || conv_id || '-' || turn AS utt, len(string_split(text, ' ')) AS words FROM {_SENTENCES_SQL}")
def _(spark, d):
    """Each utterance of a stream handed to a callback; the first batch comes twice."""
    base = scratch(spark, "delivered")
    _lines(spark, d).select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("utt"), "text").repartition(3).write.parquet(f"{base}/in")
    stream = spark.readStream.schema("utt string, text string").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    schema = "utt string, words bigint"
    _finished(delivery.delivered(stream, f"{base}/out", "utt", _counted, schema, f"{base}/state"))
    delivery.Delivery(f"{base}/out", "utt", _counted, schema)(spark.read.parquet(f"{base}/in"), 0)
    return delivery.received(spark, f"{base}/out", schema).select("utt", "words")


@query("k10_normalized_stream")
def _(spark, d):
    base = scratch(spark, "normalized")
    _lines(spark, d).select(F.col("text").alias("value")).write.text(f"{base}/in")
    stream = streams.normalized_lines(streams.lines(spark, f"{base}/in"), lexicon.small())
    _finished(stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state"))
    return spark.read.schema("value string, normalized string").parquet(f"{base}/out").groupBy("value", "normalized").agg(F.count("*").alias("n"))


@query("a34_archive_lines", f"SELECT 'd/c' || conv_id || '.ali' AS member, CAST(line AS INT) AS line, text FROM (SELECT DISTINCT conv_id, 0 AS line, '{{lang: br}}' AS text FROM {_SENTENCES_SQL} UNION ALL SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn), '{{spk: ' || role || '}} ' || text || ' {{start: ' || turn * 2 || '; end: ' || turn * 2 + 1 || '.5}}' FROM {_SENTENCES_SQL})")
def _(spark, d):
    """Transcripts packed into archives, and their lines read from these."""
    formats.register(spark)
    path = scratch(spark, "archives")
    formats.write_archives(_documents(spark, d).select(F.concat(F.lit("d/"), "file", F.lit(".ali")).alias("member"), "text"), path).count()
    return spark.read.format("archive_lines").option("members", "ali").load(path).select("member", "line", "text")


@query("a34_archive_members", f"SELECT 'd/c' || conv_id || '.txt' AS member, CAST(octet_length(encode(string_agg(text, chr(10) ORDER BY turn))) AS BIGINT) AS size, md5(string_agg(text, chr(10) ORDER BY turn)) AS h FROM {_SENTENCES_SQL} GROUP BY conv_id")
def _(spark, d):
    """Members read in small chunks, and put together again."""
    formats.register(spark)
    path = scratch(spark, "archives")
    rows = _lines(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    formats.write_archives(rows.select(F.concat(F.lit("d/c"), "conv_id", F.lit(".txt")).alias("member"), F.array_join(F.transform("x", lambda x: x["text"]), "\n").alias("text")), path, compressed=False).count()
    chunks = spark.read.format("archive").option("chunkBytes", 1000).load(path)
    parts = chunks.groupBy("member", "size").agg(F.array_sort(F.collect_list(F.struct("chunk", F.hex("content").alias("x")))).alias("x"))
    return parts.select("member", "size", F.md5(F.unhex(F.array_join(F.transform("x", lambda x: x["x"]), ""))).alias("h"))


@query("a3_ali_format", _PARSED_SQL)
def _(spark, d):
    """Transcripts as files, read by the format `ali`."""
    formats.register(spark)
    path = scratch(spark, "ali")
    _documents(spark, d).select("file", "text").repartition("file").write.partitionBy("file").text(path)
    found = spark.read.format("ali").option("extensions", "txt").load(path)
    return _spoken(found.withColumn("file", F.regexp_extract("file", "file=([^/]+)/", 1)))


@query("a21_srt_format", f"SELECT 'c' || conv_id AS file, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS n, CAST(turn * 2.25 AS DOUBLE) AS start, CAST(turn * 2.25 + 1.5 AS DOUBLE) AS \"end\", text FROM {_SENTENCES_SQL} WHERE text NOT LIKE '%&%'")
def _(spark, d):
    """Subtitles as files, read by the format `srt`."""
    formats.register(spark)
    path = scratch(spark, "srt")
    start = F.col("turn") * 2.25
    block = F.concat_ws("\n", F.col("turn").cast("string"), F.concat(sinks.clock(start), F.lit(" --> "), sinks.clock(start + 1.5)), F.col("text"), F.lit(""))
    rows = _lines(spark, d).filter("NOT contains(text, '&')").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("x"))
    rows.select(F.concat(F.lit("c"), "conv_id").alias("file"), F.array_join(F.transform("x", lambda x: x["b"]), "\n").alias("value")).repartition("file").write.partitionBy("file").text(path)
    found = spark.read.format("srt").option("extensions", "txt").load(path)
    return found.select(F.regexp_extract("file", "file=([^/]+)/", 1).alias("file"), "n", "start", "end", "text")


def _ali_files(spark: SparkSession, d: str) -> str:
    """Transcripts as files of that name, a folder each."""
    path = scratch(spark, "ali")
    rows = _numbered(spark, d).repartition("file").sortWithinPartitions("file", "line").select("file", "text")
    plain = {"extension": "ali", "sep": "\x01", "quote": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    rows.write.options(**plain).partitionBy("file").csv(path)
    return path


@query("a2_listed", f"SELECT 'c' || conv_id AS file, count(*) AS n FROM (SELECT DISTINCT conv_id FROM {_SENTENCES_SQL}) GROUP BY ALL")
def _(spark, d):
    found = files.listed(spark, _ali_files(spark, d), ["ali", "srt"])
    return found.filter("size > 0").groupBy(F.regexp_extract("file", "file=([^/]+)/", 1).alias("file")).agg(F.count("*").alias("n"))


@query("a5_sentences", f"SELECT 'c' || conv_id AS file, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS line, text, role AS speaker, CAST(turn * 2.0 AS DOUBLE) AS start FROM {_SENTENCES_SQL}")
def _(spark, d):
    found = files.ali_sentences(spark, _ali_files(spark, d))
    return found.select(F.regexp_extract("file", "file=([^/]+)/", 1).alias("file"), "line", F.btrim("text").alias("text"), F.col("meta")["speaker"].alias("speaker"), "start")


@query("a33_cached_transcripts", f"SELECT word, count(*) AS n, sum(start) AS starts FROM (SELECT unnest({_WORDS}) AS word, CAST((generate_subscripts({_WORDS}, 1) - 1) * 0.5 AS DOUBLE) AS start FROM {_SENTENCES_SQL}) GROUP BY word")
def _(spark, d):
    """Recognised words as JSON, a list for each utterance, read back. A line has a list, so files are as many as tasks and not as utterances."""
    path = scratch(spark, "transcripts")
    words = F.transform(text.split_words(F.col("text")), lambda w, i: F.struct(w.alias("word"), (i * 0.5).alias("start"), (i * 0.5 + 0.25).alias("end"), F.lit(1.0).alias("conf")))
    _lines(spark, d).select(F.to_json(words).alias("value")).write.text(path)
    return files.transcripts(spark, path, lines=True).groupBy("word").agg(F.count("*").alias("n"), F.sum("start").alias("starts"))


@query("a32_model_catalogue", "SELECT p_type AS type, arg_max('m' || p_partkey, {'v': [CAST(p_size AS BIGINT), p_partkey % 50], 'n': 'm' || p_partkey}) AS name FROM part GROUP BY p_type")
def _(spark, d):
    """A catalogue of all parts as JSON, and the latest of each kind."""
    path = scratch(spark, "models")
    rows = table(spark, d, "part").select(F.struct(F.concat(F.lit("m"), "p_partkey").alias("name"), F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 50).cast("string")).alias("version"), F.col("p_type").alias("type"), F.lit("").alias("url")).alias("m"), "p_brand")
    rows.groupBy("p_brand").agg(F.to_json(F.collect_list("m")).alias("value")).repartition("p_brand").write.partitionBy("p_brand").text(path)
    return files.latest(files.models(spark, path), "type").select("type", "name")


@query("g3_g4_speakers", f"SELECT 'c' || conv_id AS file, turn, 'role_' || role AS speaker, 'f' AS gender, 'fr' AS lang FROM {_SENTENCES_SQL}")
def _(spark, d):
    """Speakers are named in full once and by their initials afterwards, with the gender they had; the language comes from outside."""
    first = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")) == 1
    full = F.concat(F.lit("{speaker: Role "), "role", F.lit("; gender: f}"))
    short = F.concat(F.lit("{R"), F.upper(F.substring("role", 1, 1)), F.lit("}"))
    line = F.concat(F.when(first, full).otherwise(short), F.lit("x {start: "), "turn", F.lit("; end: "), F.col("turn") + 1, F.lit("}"))
    rows = _lines(spark, d).select("conv_id", "turn", line.alias("line")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("x"))
    whole = rows.select(F.concat(F.lit("c"), "conv_id").alias("file"), F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("text"))
    found = metadata.parsed(whole, initial={"lang": "fr"}).filter("start IS NOT NULL").select("file", F.col("start").cast("bigint").alias("turn"), F.explode("regions").alias("r")).filter("r.text IS NOT NULL")
    return found.select("file", "turn", F.col("r.meta")["speaker"].alias("speaker"), F.col("r.meta")["gender"].alias("gender"), F.col("r.meta")["lang"].alias("lang"))


# Affix rules; these are no language's.

_AFF = """
SFX n Y 2
SFX n e ing e
SFX n 0 ing [^e]
SFX p Y 1
SFX p 0 s [^s]
SFX q N 1
SFX q 0 ly .
PFX r Y 1
PFX r 0 re [^aeiou]
PFX u Y 1
PFX u in an in
"""
_FLAGS = {"n": "length(w) % 2 = 0", "p": "length(w) % 3 = 0", "q": "length(w) % 4 = 1", "r": "length(w) % 5 < 3", "u": "w LIKE 'in%'"}
_LOWER = _WORDS.replace("text", "lower(text)")
_STEMS_SQL = f"(SELECT DISTINCT w FROM (SELECT unnest({_LOWER}) AS w FROM benchmark) WHERE regexp_full_match(w, '[a-z]+'))"
_SUFFIXED_SQL = f"""SELECT w AS stem, w AS f, true AS crossing FROM {_STEMS_SQL} UNION ALL SELECT w, left(w, length(w) - 1) || 'ing', true FROM {_STEMS_SQL} WHERE {_FLAGS['n']} AND w LIKE '_%e' UNION ALL
SELECT w, w || 'ing', true FROM {_STEMS_SQL} WHERE {_FLAGS['n']} AND w NOT LIKE '%e' UNION ALL SELECT w, w || 's', true FROM {_STEMS_SQL} WHERE {_FLAGS['p']} AND w NOT LIKE '%s' UNION ALL SELECT w, w || 'ly', false FROM {_STEMS_SQL} WHERE {_FLAGS['q']}"""
_FORMS_SQL = f"""WITH s AS ({_SUFFIXED_SQL}) SELECT DISTINCT stem, form FROM (SELECT stem, f AS form FROM s UNION ALL SELECT stem, 're' || f FROM s WHERE crossing AND {_FLAGS['r'].replace('w', 'stem')} AND NOT regexp_matches(f, '^[aeiou]')
UNION ALL SELECT stem, 'an' || substr(f, 3) FROM s WHERE crossing AND stem LIKE 'in%' AND f LIKE 'in_%')"""


def _stems(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "benchmark").select(F.explode(text.split_words(F.lower("text"))).alias("w")).filter("w RLIKE '^[a-z]+$'").distinct()
    return words.select(F.col("w").alias("stem"), F.filter(F.array(*[F.when(F.expr(c), F.lit(f)) for f, c in _FLAGS.items()]), lambda x: x.isNotNull()).alias("flags"))


@query("f6_expanded", _FORMS_SQL)
def _(spark, d):
    return affixes.expanded(_stems(spark, d), affixes.parsed(_AFF)[0]).select("stem", "form")


@query("f6_known_words", f"SELECT w AS word, w IN (SELECT form FROM ({_FORMS_SQL})) AS known, count(*) AS n FROM (SELECT unnest({_LOWER}) AS w FROM conversations) GROUP BY ALL")
def _(spark, d):
    words = table(spark, d, "conversations").select(F.explode(text.split_words(F.lower("text"))).alias("word"))
    return affixes.known(words.groupBy("word").agg(F.count("*").alias("n")), _stems(spark, d), affixes.parsed(_AFF)[0]).select("word", "known", "n")


# Sound: the vectors of a label, one behind another, are a signal.

_BLOCKS_SQL = "(SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS block, embedding FROM embeddings)"


def _signals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("label", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("block"), F.col("embedding").cast("array<double>").alias("samples"))


@query(
    "a31_resampled",
    f"""WITH b AS {_BLOCKS_SQL}, x AS (SELECT label, block * 64 + unnest(range(64)) AS n, CAST(unnest(embedding) AS DOUBLE) AS v FROM b),
    m AS (SELECT label, block, unnest(range((block * 64 * 160 + 440) // 441, ((block + 1) * 64 * 160 + 440) // 441)) AS m FROM b),
    t AS (SELECT m.label, m.block, m.m, v, m.m * 441 / 160.0 - x.n AS t FROM m JOIN x ON x.label = m.label AND x.n BETWEEN m.m * 441 // 160 - 45 AND m.m * 441 // 160 + 45)
    SELECT label, block, CAST(m - (block * 64 * 160 + 440) // 441 AS INT) AS at, round(sum(v * 160 / 441.0 * CASE WHEN t = 0 THEN 1 ELSE sin(pi() * t * 160 / 441.0) / (pi() * t * 160 / 441.0) END * (0.5 + 0.5 * cos(pi() * t / 44.1))), 6) AS sample
    FROM t WHERE abs(t) < 44.1 GROUP BY label, block, m""",
)
def _(spark, d):
    """From 44.1 to 16 kHz."""
    out = S.resampled(_signals(spark, d), "label", "block", "samples", 44100, 16000)
    return out.select("label", "block", F.posexplode("samples").alias("at", "x")).select("label", "block", "at", F.round("x", 6).alias("sample"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "wav")
    wav.written(_signals(spark, d).withColumn("file", F.concat(F.lit("label"), "label")), path).count()
    return wav.probed(spark, path)


@query("a29_headers", "SELECT 'label' || label AS file, 'pcm' AS codec, 1 AS channels, 16000 AS rate, 16 AS bits, count(*) * 128 AS bytes, count(*) * 64 / 16000.0 AS seconds, false AS truncated, true AS plain FROM embeddings GROUP BY label")
def _(spark, d):
    return _files(spark, d).select(F.regexp_extract("file", "([^/]+)\\.wav$", 1).alias("file"), "codec", "channels", "rate", "bits", "bytes", "seconds", "truncated", "plain")


@query("b10_wav_round_trip", f"SELECT 'label' || label AS file, block // 8 AS part, sum(greatest(-32768, least(32767, floor(v * 32768 + 0.5))))::BIGINT AS total, count(*) AS n FROM (SELECT label, block, CAST(unnest(embedding) AS DOUBLE) AS v FROM {_BLOCKS_SQL}) GROUP BY ALL")
def _(spark, d):
    """Signals written as sound files and read back in blocks of 8 vectors each."""
    parts = wav.blocks(_files(spark, d), 8 * 64 * 2)
    whole = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x * 32768)
    return parts.select(F.regexp_extract("file", "([^/]+)\\.wav$", 1).alias("file"), F.col("block").alias("part"), whole.cast("bigint").alias("total"), F.size("samples").cast("bigint").alias("n"))


@query("b10_pieces", f"SELECT label, block, 44 + 2 * 24 AS size, sum(greatest(-32768, least(32767, floor(v * 32768 + 0.5))))::BIGINT AS total FROM (SELECT label, block, CAST(unnest(embedding[9:32]) AS DOUBLE) AS v FROM {_BLOCKS_SQL}) GROUP BY label, block")
def _(spark, d):
    """Each vector as a sound file of its own, of which the part from its 8th sample to its 32nd is cut."""
    cut = _signals(spark, d).withColumn("c", wav.pieces(wav.encoded()(F.col("samples")), F.lit(8 / 16000), F.lit(32 / 16000)))
    value = lambda i: F.conv(F.concat(F.hex(F.substring("c", 46 + 2 * i, 1)), F.hex(F.substring("c", 45 + 2 * i, 1))), 16, 10).cast("int")
    signed = [F.when(value(i) > 32767, value(i) - 65536).otherwise(value(i)) for i in range(24)]
    return cut.select("label", "block", F.length("c").alias("size"), sum(signed[1:], signed[0]).cast("bigint").alias("total"))

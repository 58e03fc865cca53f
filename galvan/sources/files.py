"""Readers. All go through Spark's own sources, so any store that Spark reads will do; a file whose lines depend on each other is one row
until it is parsed."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import metadata

#: Kinds of sound files, the preferred first.
AUDIO = ("wav", "mp3", "m4a", "ogg", "mp4", "mkv")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line: stripped lines without blank ones and comments."""
    return spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("line")).filter("line <> '' AND NOT startswith(line, '#')")


def listed(spark: SparkSession, path: str, extensions: Iterable[str], recursive: bool = True) -> DataFrame:
    """file, size of the files with one of the extensions; their contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    pattern = "|".join(re.escape("." + e.lstrip(".")) for e in extensions)
    return reader.load(path).select(F.col("path").alias("file"), F.col("length").alias("size")).filter(F.col("file").rlike(f"(?:{pattern})$"))


def whole(spark: SparkSession, path: str, extension: str) -> DataFrame:
    """file, text: a row a file."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{extension}").text(path, wholetext=True)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def ali(spark: SparkSession, path: str, **options) -> DataFrame:
    """file, line, regions, start, end of annotated transcripts."""
    return metadata.parsed(whole(spark, path, "ali"), **options)


def ali_sentences(spark: SparkSession, path: str) -> DataFrame:
    """file, line, text, meta, start, end of utterances in one language that are for training."""
    found = metadata.utterances(ali(spark, path, initial={"lang": "br"}, unwanted={"train": "false"}))
    return found.withColumn("s", metadata.squeezed(F.col("regions"), "br")).filter("s IS NOT NULL").select("file", "line", metadata.plain(F.col("s.text")).alias("text"), F.col("s.meta").alias("meta"), "start", "end")


def header(parsed: DataFrame) -> DataFrame:
    """file, meta: what the lines before the first text say."""
    first = parsed.filter("exists(regions, r -> r.text IS NOT NULL)").groupBy("file").agg(F.min("line").alias("first"))
    before = parsed.join(first, "file", "left").filter("first IS NULL OR line < first")
    return before.groupBy("file").agg(F.max_by(F.element_at("regions", -1)["meta"], "line").alias("meta"))


def carried(numbered: DataFrame, keys: Iterable[str] = ("speaker", "gender", "parser")) -> DataFrame:
    """(file, line, text) -> text and the last value of each key so far, for plain transcripts."""
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    found = numbered.withColumn("x", metadata.extracted(F.col("text")))
    return found.select("file", "line", F.col("x.text").alias("text"), *[F.last(F.col("x.meta")[k], ignorenulls=True).over(w).alias(k) for k in keys]).filter("text <> ''")


def segments(spark: SparkSession, path: str) -> DataFrame:
    """start, end in seconds from lines of two numbers of milliseconds."""
    part = F.split("line", r"\s+")
    return lines(spark, path).select((part[0].cast("double") / 1000).alias("start"), (part[1].cast("double") / 1000).alias("end"))


def numbered(df: DataFrame, line: str = "value") -> DataFrame:
    """ord, line of rows that have no order but that of their partitions."""
    return df.select(F.monotonically_increasing_id().alias("ord"), F.col(line).alias("line"))


def ordered_lines(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file, ord, line: stripped lines without blank ones and comments; `ord` sorts them as the files have them, over any number of files and
    splits: by file, then where the split begins, then by the order within it."""
    read = spark.read.option("pathGlobFilter", pattern).text(path)
    rows = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("line"))
    return rows.filter("line <> '' AND NOT startswith(line, '#')").select("file", F.struct("file", "at", "i").alias("ord"), "line")


def lexicon(rows: DataFrame, *by: str) -> DataFrame:
    """word, prons from (ord, line), for each of `by`: variants in order, each once; a word alone clears what came before."""
    bare = F.btrim(F.substring_index("line", "#", 1))
    each = rows.select(*by, "ord", F.regexp_extract(bare, r"^(\S+)", 1).alias("word"), F.nullif(F.btrim(F.regexp_replace(bare, r"^\S+\s*", "")), F.lit("")).alias("pron")).filter("word <> ''")
    cleared = each.groupBy(*by, "word").agg(F.max(F.when(F.col("pron").isNull(), F.col("ord"))).alias("cleared"), F.array_sort(F.collect_list(F.struct("ord", "pron"))).alias("all"))
    kept = F.filter("all", lambda x: x["pron"].isNotNull() & (F.col("cleared").isNull() | (x["ord"] > F.col("cleared"))))
    return cleared.select(*by, "word", F.array_distinct(F.transform(kept, lambda x: x["pron"])).alias("prons"))


def keyed(rows: DataFrame, values: bool = False, *by: str) -> DataFrame:
    """key, value from (ord, line) with a tab, the last of a key, for each of `by`; with `values` the value's words as an array."""
    part = F.split("line", "\t")
    out = rows.select(*by, "ord", part[0].alias("key"), F.coalesce(F.try_element_at(part, F.lit(2)), F.lit("")).alias("value")).groupBy(*by, "key").agg(F.max_by("value", "ord").alias("value"))
    return out.withColumn("value", F.filter(F.split("value", " "), lambda w: w != "")) if values else out


def ngram_table(rows: DataFrame) -> DataFrame:
    """n, key, sub."""
    k = keyed(rows, True)
    words = F.filter(F.split(F.lower("key"), " "), lambda w: w != "")
    return k.select(F.size(words).alias("n"), words.alias("key"), F.col("value").alias("sub")).filter("n BETWEEN 1 AND 3")


def rules(rows: DataFrame) -> DataFrame:
    """prio, pattern, repl in the order of the file."""
    part = F.split("line", "\t")
    return rows.select(F.row_number().over(Window.orderBy("ord")).alias("prio"), part[0].alias("pattern"), F.coalesce(F.try_element_at(part, F.lit(2)), F.lit("")).alias("repl"))


def reversed_rules(rules: DataFrame) -> DataFrame:
    """word, keys: which keys give a word."""
    plain = rules.filter("NOT contains(pattern, ' ') AND NOT contains(repl, ' ') AND repl <> ''")
    return plain.groupBy(F.col("repl").alias("word")).agg(F.array_join(F.array_sort(F.collect_list("pattern")), ", ").alias("keys"))


def mutated_names(names: DataFrame, *by: str) -> DataFrame:
    """word, prons with the mutated forms of names that begin with P, B, M, K, T, for each of `by`; the mutated form wins over a name of that
    form."""
    to = F.create_map(*[F.lit(x) for kv in {"P": "B", "B": "V", "M": "V", "K": "G", "T": "D"}.items() for x in kv])
    new, old = F.try_element_at(to, F.substring("word", 1, 1)), F.substring("word", 1, 1)
    swapped = F.transform("prons", lambda p: F.when(F.substring(p, 1, 1) == old, F.concat(new, F.substr(p, F.lit(2)))).otherwise(p))
    form = lambda word, prons, o: F.struct(word.alias("word"), prons.alias("prons"), F.lit(o).alias("o"))
    made = F.when(new.isNotNull(), form(F.concat(new, F.substr("word", F.lit(2))), swapped, 1))
    both = F.array_compact(F.array(form(F.col("word"), F.col("prons"), 0), made))  # beside each other: a union would make the names twice
    return names.select(*by, F.explode(both).alias("f")).groupBy(*by, "f.word").agg(F.max_by("f.prons", "f.o").alias("prons"))


_TIME = r"(?:([0-9]+):)?([0-9]+):([0-9]+)[,.]([0-9]+)"


def subtitles(files: DataFrame) -> DataFrame:
    """file, n, start, end, text from (file, text) of SRT or VTT, natively: a block is a time line and the lines up to a blank one."""
    pattern = rf"(?s){_TIME} --> {_TIME}[^\n]*\n(.*?)(?:\n[ \t\r]*\n|\z)"
    seconds = lambda b, i: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(b, pattern, i), F.lit("")), F.lit("99999999")), F.lit(0)) * 3600 + F.regexp_extract(b, pattern, i + 1).cast("int") * 60 + F.regexp_extract(b, pattern, i + 2).cast("int") + F.regexp_extract(b, pattern, i + 3).cast("int") / 1000.0
    blocks = files.select("file", F.posexplode(F.regexp_extract_all(F.regexp_replace("text", "\r", ""), F.lit(pattern), 0)).alias("n", "block"))
    text = F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract("block", pattern, 9), r"\s*\n\s*", " "), "&lt;/?[a-zA-Z]+&gt;", ""), "&nbsp;", ""))
    return blocks.select("file", "n", seconds(F.col("block"), 1).cast("double").alias("start"), seconds(F.col("block"), 5).cast("double").alias("end"), text.alias("text"))


def elan(files: DataFrame) -> DataFrame:
    """file, start, end, text of the tiers named transcription or default, from (file, text) of EAF documents."""

    def parse(file: str, text: str) -> list[tuple]:
        root = ET.fromstring(text)
        slots = {s.get("TIME_SLOT_ID"): int(s.get("TIME_VALUE") or 0) / 1000 for s in root.iter("TIME_SLOT")}
        tiers = [t for t in root.iter("TIER") if (t.get("TIER_ID") or "").lower() in ("transcription", "default")]
        return [(file, slots[a.get("TIME_SLOT_REF1")], slots[a.get("TIME_SLOT_REF2")], (a.findtext("ANNOTATION_VALUE") or "").strip()) for t in tiers for a in t.iter("ALIGNABLE_ANNOTATION")]

    def run(batches):
        for b in batches:
            rows = [r for f, t in zip(b["file"], b["text"], strict=True) for r in parse(f, t)]
            yield pd.DataFrame(rows, columns=["file", "start", "end", "text"])

    return files.select("file", "text").mapInPandas(run, "file string, start double, end double, text string")


def _tsv(spark: SparkSession, path: str, names: list[str], header: bool) -> DataFrame:
    return spark.read.csv(path, sep="\t", quote="", header=header, schema=", ".join(f"`{n}` string" for n in names))


# Columns of tab-separated corpora.
VOICE_OLD = "client_id path sentence up_votes down_votes age gender accents variant locale segment".split()
VOICE_NEW = "client_id path sentence_id sentence sentence_domain up_votes down_votes age gender accents variant locale segment".split()
SPONTANEOUS = "client_id audio_id audio_file duration_ms prompt_id prompt transcription votes age".split()


def common_voice(spark: SparkSession, path: str) -> DataFrame:
    """The columns that all versions have; the header tells the version."""
    names = spark.read.csv(path, sep="\t", quote="", header=True).columns
    return _tsv(spark, path, VOICE_NEW if "sentence_id" in names else VOICE_OLD, True).select(*VOICE_OLD)


def spontaneous(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", quote="", header=True).select(*SPONTANEOUS)


def scores(spark: SparkSession, path: str, scored: bool = True) -> DataFrame:
    out = _tsv(spark, path, ["filepath", "audio_ext", "start", "end", "reference", "hypothesis", *(["wer", "cer"] if scored else [])], False)
    return out.withColumns({c: F.col(c).cast("double") for c in ("wer", "cer")}) if scored else out


def script(spark: SparkSession, path: str) -> DataFrame:
    """speaker, utterance of lines with a tab."""
    part = F.split("value", "\t", 2)
    return spark.read.text(path).filter("contains(value, '\t')").select(F.btrim(part[0]).alias("speaker"), F.btrim(part[1]).alias("utterance"))


def articles(text: Column) -> Column:
    """Lines of each block between blank lines: array of arrays."""
    blocks = F.filter(F.split(text, r"\n\s*\n"), lambda b: F.btrim(b) != "")
    return F.transform(blocks, lambda b: F.filter(F.transform(F.split(b, "\n"), lambda x: F.btrim(x)), lambda x: x != ""))


def with_audio(files: DataFrame, audio: DataFrame) -> DataFrame:
    """Adds audio: the file of the same name with the preferred extension, or null."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    rank = F.array_position(F.array(*[F.lit(e) for e in AUDIO]), F.regexp_extract("file", r"\.([^./]*)$", 1))
    best = audio.select(stem(F.col("file")).alias("stem"), F.col("file").alias("audio"), rank.alias("rank")).filter("rank > 0").groupBy("stem").agg(F.min_by("audio", "rank").alias("audio"))
    return files.withColumn("stem", stem(F.col("file"))).join(best, "stem", "left").drop("stem")


def transcripts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Cached recogniser output: files of one list each, or of a list a line."""
    return spark.read.json(path, schema="word string, start double, end double, conf double", multiLine=not lines)


def models(spark: SparkSession, path: str) -> DataFrame:
    """A local model catalogue."""
    return spark.read.json(path, schema="name string, version string, type string, url string", multiLine=True)


def latest(catalogue: DataFrame, *by: str) -> DataFrame:
    """Of each kind the name of the latest version; versions are numbers between dots, so 1.10 comes after 1.9."""
    numbers = F.transform(F.split("version", r"\."), lambda x: F.coalesce(F.regexp_extract(x, r"^\d+", 0).try_cast("bigint"), F.lit(-1).cast("bigint")))
    return catalogue.groupBy(*by).agg(F.max_by("name", F.struct(numbers, "name")).alias("name"))


def wav_samples(spark: SparkSession, path: str) -> DataFrame:
    """file, rate, samples in [-1, 1) of 16-bit WAV files, channels averaged."""
    import io
    import wave

    import numpy as np

    def run(batches):
        for b in batches:
            for file, raw in zip(b["path"], b["content"], strict=True):
                with wave.open(io.BytesIO(raw)) as w:
                    x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()).mean(1) / 32768
                    yield pd.DataFrame({"file": [file], "rate": [w.getframerate()], "samples": [x.tolist()]})

    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return read.select("path", "content").mapInPandas(run, "file string, rate int, samples array<double>")

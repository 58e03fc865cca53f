"""Writers and the text they write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.corpus import segment_id


def timecode(t: Column) -> Column:
    """Seconds with three decimals at most and no zeros at the end."""
    return F.regexp_replace(F.format_string("%.3f", t.cast("double")), r"\.?0+$", "")


def clock(t: Column, comma: str = ",") -> Column:
    """hh:mm:ss,mmm"""
    ms = F.round(t * 1000).cast("bigint")
    part = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.concat(part(F.floor(ms / 3600000), 2), F.lit(":"), part(F.floor(ms / 60000) % 60, 2), F.lit(":"), part(F.floor(ms / 1000) % 60, 2), F.lit(comma), part(ms % 1000, 3))


def ali_line(text: Column, start: Column, end: Column) -> Column:
    return F.concat(text, F.lit(" {start: "), timecode(start), F.lit("; end: "), timecode(end), F.lit("}"))


def ali_header(meta: dict[str, str]) -> list[str]:
    """Header lines, the media's path first."""
    named = {k.replace("_", "-"): v for k, v in meta.items()}
    return ["{" + f"{k}: {named[k]}" + "}" for k in sorted(named, key=lambda k: k != "media-path")]


def write_ali(utterances: DataFrame, path: str, meta: dict[str, str] | None = None) -> None:
    """A folder for each recording, its lines in time; (file, text, start, end)."""
    head = "\n".join(ali_header(meta or {}))
    body = utterances.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", ali_line(F.col("text"), F.col("start"), F.col("end")).alias("line")))).alias("lines"))
    body.select(F.concat_ws("\n", *([F.lit(head), F.lit("")] if head else []), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("value"), "file").write.partitionBy("file").text(path)


def exported(matches: DataFrame, kind: str) -> DataFrame:
    """value: lines of an alignment (n, text, start, end, reliability) as srt, seg or ali. Wrong matches are left out, and of ali unsure ones."""
    good = matches.filter("reliability <> 'X'" + (" AND reliability <> '?'" if kind == "ali" else ""))
    if kind == "srt":
        value = F.concat_ws("\n", F.col("n").cast("string"), F.concat(clock(F.col("start")), F.lit(" --> "), clock(F.col("end"))), F.col("text"), F.lit(""))
    elif kind == "seg":
        value = F.concat_ws(" ", F.round(F.col("start") * 1000).cast("bigint").cast("string"), F.round(F.col("end") * 1000).cast("bigint").cast("string"))
    else:
        value = ali_line(F.col("text"), F.col("start"), F.col("end"))
    return good.select("n", value.alias("value"))


def subtitles_to_ali(subtitles: DataFrame) -> DataFrame:
    """file, n, value: an ALI line of each subtitle (file, n, start, end, text) that has text."""
    return subtitles.filter("text <> ''").select("file", "n", ali_line(F.col("text"), F.col("start"), F.col("end")).alias("value"))


def rescaled(df: DataFrame, factor: float = 1.0, start_shift: float = 0.0, end_shift: float = 0.0) -> DataFrame:
    return df.withColumns({"start": F.col("start") * factor + start_shift, "end": F.col("end") * factor + end_shift})


def replaced_text(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The segments of one with the texts of the other, row by row."""
    return old.drop("text").join(new.select(key, "text"), key)


def resumed(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What isn't in the output yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def printed(text: Column, subtitles: Column) -> Column:
    """Text for print, null if it isn't for subtitles: line separators become tags, other tags but bold and italics go."""
    shown = F.regexp_replace(F.replace(text, F.lit(" "), F.lit("<BR>")), r"<(?!/?(?:BR|B|I|br|b|i)>)[^<>]*>", "")
    return F.when(F.coalesce(subtitles, F.lit("true")) != "false", F.btrim(shown))


def kaldi(utterances: DataFrame, path: str, speakers: DataFrame) -> dict[str, DataFrame]:
    """text, segments, utt2spk, spk2gender, wav.scp and corpus of (rec, speaker, start, end, text, audio), sorted; written below `path`
    if it isn't empty."""
    u = utterances.withColumn("utt", segment_id(F.concat_ws("-", "speaker", "rec"), F.col("start"), F.col("end")))
    line = lambda *c: F.concat_ws(" ", *[x if isinstance(x, Column) else F.col(x) for x in c]).alias("value")
    out = {
        "text": u.select(line("utt", "text")),
        "segments": u.select(line("utt", "rec", timecode(F.col("start")), timecode(F.col("end")))),
        "utt2spk": u.select(line("utt", "speaker")),
        "spk2gender": u.select("speaker").distinct().join(speakers, "speaker").select(line("speaker", F.substring("gender", 1, 1))),
        "wav.scp": u.select("rec", "audio").distinct().select(line("rec", "audio")),
        "corpus": u.select(F.lower("text").alias("value")).distinct(),
    }
    out = {name: df.orderBy("value") for name, df in out.items()}
    if path:
        for name, df in out.items():
            df.write.text(f"{path}/{name}")
    return out


def write_dataset(rows: DataFrame, path: str, kind: str = "jsonl") -> None:
    """Metadata of clips, as JSON lines or with tabs."""
    (rows.write.json(path) if kind == "jsonl" else rows.write.csv(path, sep="\t", header=True, quote="", emptyValue=""))


def elan_document(rows: DataFrame) -> DataFrame:
    """file, value: an EAF document of each file's (start, end, text); times never run backwards, which a running maximum sees to."""
    w = Window.partitionBy("file").orderBy("start", "end", "text")
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    latest = F.max(F.greatest(ms("start"), ms("end"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    timed = rows.select("file", "text", F.row_number().over(w).alias("n"), F.greatest(ms("start"), latest).alias("a"), ms("end").alias("b")).withColumn("b", F.greatest("a", "b"))
    escaped = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    slots = F.format_string('<TIME_SLOT TIME_SLOT_ID="ts%d" TIME_VALUE="%d"/><TIME_SLOT TIME_SLOT_ID="ts%d" TIME_VALUE="%d"/>', F.col("n") * 2 - 1, F.col("a"), F.col("n") * 2, F.col("b"))
    head = F.format_string('<ANNOTATION><ALIGNABLE_ANNOTATION ANNOTATION_ID="a%d" TIME_SLOT_REF1="ts%d" TIME_SLOT_REF2="ts%d"><ANNOTATION_VALUE>', F.col("n"), F.col("n") * 2 - 1, F.col("n") * 2)
    note = F.concat(head, escaped, F.lit("</ANNOTATION_VALUE></ALIGNABLE_ANNOTATION></ANNOTATION>"))
    lists = timed.select("file", F.struct("n", slots.alias("slots"), note.alias("note")).alias("x")).groupBy("file").agg(F.array_sort(F.collect_list("x")).alias("x"))
    joined = lambda name: F.array_join(F.transform("x", lambda x: x[name]), "")
    start = '<?xml version="1.0" encoding="UTF-8"?><ANNOTATION_DOCUMENT FORMAT="3.0" VERSION="3.0"><HEADER MEDIA_FILE="" TIME_UNITS="milliseconds"/><TIME_ORDER>'
    return lists.select("file", F.concat(F.lit(start), joined("slots"), F.lit('</TIME_ORDER><TIER TIER_ID="Transcription">'), joined("note"), F.lit("</TIER></ANNOTATION_DOCUMENT>")).alias("value"))

"""Metadata in braces within transcripts."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound

# Keys that a transcript's metadata may have, and how some are read.
KEYS = frozenset(
    "source source-audio audio-source audio-path media-path url author authors licence modifications transcription tags parser speaker spk gender lang accent start end train lm subtitles st phon title date".split()
)
LISTS, FLAGS = ("tags", "author"), ("train", "lm", "subtitles", "st")
_BRACES = re.compile(r"\{\s*(.+?)\s*\}")
_SEGMENT = re.compile(r"\{\s*start\s*:\s*([\d.]+)\s*;\s*end\s*:\s*([\d.]+)\s*\}")
REGIONS = "array<struct<text:string,meta:map<string,string>>>"


class State:
    """What holds from here on in a file: the current values, and who was heard before."""

    def __init__(self, keys: Iterable[str] = KEYS, initial: dict[str, str] | None = None, wanted: dict[str, str] | None = None, unwanted: dict[str, str] | None = None) -> None:
        self.keys, self.now = frozenset(keys), dict(initial or {})
        self.wanted, self.unwanted = wanted or {}, unwanted or {}
        self.people: dict[str, dict[str, str]] = {}
        self.initials: dict[str, str] = {}

    def passes(self, meta: dict[str, str]) -> bool:
        return all(meta.get(k) == v for k, v in self.wanted.items()) and not any(k in meta and meta[k] == v for k, v in self.unwanted.items())

    def _speaker(self, said: str, keyed: bool) -> None:
        short = said.isupper() and (not keyed or " " not in said)
        name = self.initials.get(said, said) if short else said.replace(" ", "_").lower()
        if name in self.people and (keyed or short):
            self.now |= self.people[name]
        elif keyed:
            self.people[name] = {"gender": "unknown", "accent": "unknown"}
            self.initials.setdefault("".join(w[0] for w in said.split()).upper(), name)
        self.now["speaker"] = name

    def unit(self, unit: str) -> None:
        key, colon, value = (x.strip() for x in unit.partition(":"))
        if not colon:
            if key:
                self._speaker(key, False)
        elif key in ("speaker", "spk"):
            self._speaker(value, True)
        elif key in self.keys:
            known = self.people.get(self.now.get("speaker", ""))
            if known is not None and key == "gender" and value:
                known["gender"] = value[0].lower()
            if known is not None and key == "accent":
                known["accent"] = value.lower()
            if key in LISTS:
                value = ",".join(v.strip().replace(" ", "_") for v in value.split(",") if v.strip())
            elif key in FLAGS:
                value = "false" if value.lower() == "false" else "true"
            self.now[key] = value

    def line(self, line: str) -> tuple[list[dict], tuple[float, float] | None]:
        """(regions of text with what holds for them, segment). Text belongs to what held before the braces that follow it; a line
        without text gives the state alone."""
        segment = None
        if m := _SEGMENT.search(line):
            segment = float(m[1]), float(m[2])
            line = (line[: m.start()] + line[m.end() :]).strip()
        regions, at = [], 0

        def take(text: str, meta: dict[str, str]) -> None:
            if text and self.passes(meta):
                regions.append({"text": text, "meta": meta})

        for m in _BRACES.finditer(line):
            if m[1].strip() == "?":
                continue
            take(line[at : m.start()], dict(self.now))
            for unit in m[1].split(";"):
                self.unit(unit.strip())
            at = m.end()
        take(line[at:], dict(self.now))
        return regions or [{"text": None, "meta": dict(self.now)}], segment


def lines_of(text: str | None) -> list[str]:
    """The lines of a file; line separators within a line (U+2028) are text."""
    return re.split("\r\n|\n|\r", text) if text else []


def parse_file(lines: Iterable[str], **options) -> list[dict]:
    """line number, regions, start and end of each line that is no comment."""
    state, out = State(**options), []
    for i, line in enumerate(lines):
        line = line.strip()
        if line and not line.startswith("#"):
            regions, segment = state.line(line)
            out.append({"line": i, "regions": regions, "start": segment and segment[0], "end": segment and segment[1]})
    return out


def parsed(files: DataFrame, **options) -> DataFrame:
    """file, line, regions, start, end from (file, text): a file is parsed by one task, as its lines depend on those before."""

    def run(batches: Iterable[pd.DataFrame]):
        for b in batches:
            for file, text in zip(b["file"], b["text"], strict=True):
                rows = pd.DataFrame(parse_file(lines_of(text), **options), columns=["line", "regions", "start", "end"])
                rows.insert(0, "file", file)
                rows["regions"] = rows["regions"].map(lambda r: [{"text": x["text"], "meta": x["meta"]} for x in r])
                yield rows.astype({"start": float, "end": float})

    return files.select("file", "text").mapInPandas(run, f"file string, line int, regions {REGIONS}, start double, end double")


def utterances(lines: DataFrame) -> DataFrame:
    """Lines with text and a segment."""
    return lines.filter("start IS NOT NULL AND exists(regions, r -> r.text IS NOT NULL)")


def squeezed(regions: Column, lang: str | None = None) -> Column:
    """(text, meta) of all regions together, later values win; null if a region has another language than `lang`."""
    text = F.btrim(F.array_join(F.transform(F.filter(regions, lambda r: r["text"].isNotNull()), lambda r: r["text"]), ""))
    meta = F.aggregate(regions, F.create_map().cast("map<string,string>"), lambda a, r: F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(r["meta"], k)), r["meta"]))
    out = F.struct(text.alias("text"), meta.alias("meta"))
    if lang is None:
        return out
    return F.when(~F.exists(regions, lambda r: F.coalesce(r["meta"]["lang"], F.lit(lang)) != lang), out)


def plain(text: Column) -> Column:
    """Without line breaks, bold and italic marks and unknown-word marks."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "(?i)<br>", " "), "(?i)</?[ib]>", ""), r"\{\?\}", "")


def matches(meta: Column, wanted: dict[str, str], unwanted: dict[str, str]) -> Column:
    out = F.lit(True)
    for k, v in wanted.items():
        out = out & F.coalesce(meta[k] == v, F.lit(False))
    for k, v in unwanted.items():
        out = out & ~F.coalesce(meta[k] == v, F.lit(False))
    return out


def extracted(c: Column) -> Column:
    """(text, meta, unknown) of one line by itself, natively: the last value of a key counts, a bare name is the speaker, and unknown
    has the word numbers of {?}."""
    braces = F.filter(F.regexp_extract_all(c, F.lit(r"\{\s*([^{}]+?)\s*\}"), 1), lambda x: x != "?")
    units = F.filter(F.transform(F.flatten(F.transform(braces, lambda b: F.split(b, ";"))), lambda x: F.btrim(x)), lambda u: u != "")
    name = lambda v: F.when(v == F.upper(v), v).otherwise(F.lower(F.translate(v, " ", "_")))

    def entry(u):
        key, value = F.btrim(F.substring_index(u, ":", 1)), F.btrim(F.substr(u, F.instr(u, ":") + 1))
        keyed = u.contains(":")
        key = F.when(~keyed | key.isin("spk", "speaker"), "speaker").otherwise(key)
        value = F.when(~keyed, name(u)).when(key == "speaker", name(value)).when(key.isin("tags", "author", "accent"), F.array_join(F.filter(F.transform(F.split(value, ","), lambda v: F.translate(F.btrim(v), " ", "_")), lambda v: v != ""), ",")).otherwise(value)
        return F.struct(key.alias("key"), value.alias("value"))

    # of a key the last entry
    last = lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda x: x["key"] == e["key"]))
    meta = bound(F.transform(units, entry), lambda es: F.map_from_entries(last(es)))
    text = F.btrim(F.regexp_replace(c, r"\{(?!\?\})\s*[^{}]+?\s*\}", ""))
    pieces = F.split(c, r"\{\?\}")
    counts = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: F.size(F.filter(F.split(F.array_join(F.slice(pieces, 1, i), "{?}"), r"\s+"), lambda w: w != "")))
    unknown = F.when(F.size(pieces) > 1, counts).otherwise(F.array().cast("array<int>"))
    return F.struct(text.alias("text"), meta.alias("meta"), unknown.alias("unknown"))


def tags(lines: DataFrame) -> DataFrame:
    """tag, files: which files use a tag."""
    each = lines.select("file", F.explode("regions").alias("r")).select("file", F.explode(F.split(F.col("r.meta")["tags"], ",")).alias("tag"))
    return each.filter("tag <> ''").groupBy("tag").agg(F.array_sort(F.collect_set("file")).alias("files"))

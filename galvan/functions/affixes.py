"""Affix rules of spelling dictionaries: forms of stems, and stems of forms.

Rules come from the caller, as the text of an .aff file; no dictionary is shipped. A form is a stem, a stem with a suffix, and either with
a prefix in front (which sees the suffixed word); prefix and suffix go together only if both classes say so. An affix takes `strip` off the
word, which must leave something, and puts `add` there, if the word meets the condition.

To find stems, the added parts are tries, of suffixes from the end: a word walks down each once, whatever the number of rules. What
comes out is joined with the stems by key, so no rule ever meets a stem that it doesn't give.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Affix:
    prefix: bool
    flag: str
    cross: bool
    strip: str
    add: str
    condition: str

    def meets(self, word: str) -> bool:
        found = _condition(self.condition, self.prefix)
        return len(word) > len(self.strip) and (word.startswith(self.strip) if self.prefix else word.endswith(self.strip)) and found.search(word) is not None

    def applied(self, word: str) -> str | None:
        if not self.meets(word):
            return None
        return self.add + word[len(self.strip) :] if self.prefix else word[: len(word) - len(self.strip)] + self.add

    def undone(self, form: str) -> str | None:
        """The word that gives the form, which begins or ends with `add`."""
        word = self.strip + form[len(self.add) :] if self.prefix else form[: len(form) - len(self.add)] + self.strip
        return word if self.meets(word) else None


@lru_cache(100_000)
def _condition(text: str, prefix: bool) -> re.Pattern:
    parts = re.findall(r"\[\^?[^\]]*\]|.", text)
    pattern = "".join("." if p == "." else p if len(p) > 1 and p in ("[]", "[^]") else f"[{'^' if p[1] == '^' else ''}{re.escape(p[1:-1].removeprefix('^'))}]" if len(p) > 1 else re.escape(p) for p in parts)
    return re.compile("^" + pattern if prefix else pattern + r"\Z", re.S)


def flags_of(text: str, kind: str = "char") -> list[str]:
    """The flags of a dictionary entry or rule: `char`, `long` (two characters each) or `num` (between commas)."""
    if kind == "num":
        return [x for x in text.split(",") if x]
    return [text[i : i + 2] for i in range(0, len(text), 2)] if kind == "long" else list(text)


def parsed(text: str) -> tuple[tuple[Affix, ...], str]:
    """(rules, kind of flags) of an .aff file. A condition may be missing; what follows it is no part of the rule."""
    out, cross, kind = [], {}, "char"
    for line in text.splitlines():
        part = line.split()
        if not part or part[0].startswith("#"):
            continue
        if part[0] == "FLAG":
            kind = {"long": "long", "num": "num"}.get(part[1].lower(), "char")
        elif part[0] in ("PFX", "SFX"):
            key = part[0], part[1]
            if key not in cross:
                cross[key] = part[2] == "Y"
                continue
            strip, add = ("" if x == "0" else x for x in part[2:4])
            if "/" in add:
                raise ValueError(f"affixes of affixes aren't supported: {line.strip()}")
            out.append(Affix(part[0] == "PFX", part[1], cross[key], strip, add, part[4] if len(part) > 4 else "."))
    return tuple(out), kind


def dictionary(lines: DataFrame, kind: str = "char") -> DataFrame:
    """stem, flags of the lines (`value`) of a .dic file; its first line, a number, is left out."""
    bare = F.regexp_extract("value", r"^([^\t ]+)", 1)
    flags = F.substring_index(bare, "/", -1)
    split = {"char": F.split(flags, ""), "long": F.regexp_extract_all(flags, F.lit("(..)"), 1), "num": F.split(flags, ",")}[kind]
    some = F.when(bare.contains("/"), F.filter(split, lambda f: f != "")).otherwise(F.array().cast("array<string>"))
    return lines.select(F.substring_index(bare, "/", 1).alias("stem"), some.alias("flags")).filter("stem <> '' AND NOT stem RLIKE '^[0-9]+$'")


class Tries:
    """Rules by what they add."""

    def __init__(self, rules: tuple[Affix, ...]) -> None:
        self.by_flag: dict[str, list[Affix]] = {}
        self.prefixes: dict = {}
        self.suffixes: dict = {}
        for r in rules:
            self.by_flag.setdefault(r.flag, []).append(r)
            node = self.prefixes if r.prefix else self.suffixes
            for c in r.add if r.prefix else reversed(r.add):
                node = node.setdefault(c, {})
            node.setdefault("", []).append(r)

    @staticmethod
    def _walk(node: dict, letters: Iterator[str]) -> Iterator[Affix]:
        yield from node.get("", ())
        for c in letters:
            node = node.get(c)
            if node is None:
                return
            yield from node.get("", ())

    def stems(self, form: str) -> set[tuple[str, tuple[str, ...]]]:
        """(stem, flags that it needs) of everything that gives the form."""
        out = {(form, ())}
        for s in self._walk(self.suffixes, reversed(form)):
            if (word := s.undone(form)) is not None:
                out.add((word, (s.flag,)))
        for p in self._walk(self.prefixes, iter(form)):
            if (word := p.undone(form)) is None:
                continue
            out.add((word, (p.flag,)))
            for s in self._walk(self.suffixes, reversed(word)) if p.cross else ():
                if s.cross and (stem := s.undone(word)) is not None:
                    out.add((stem, tuple(sorted({p.flag, s.flag}))))
        return out

    def forms(self, stem: str, flags: list[str]) -> set[str]:
        rules = [r for f in set(flags) for r in self.by_flag.get(f, ())]
        out, crossed = {stem}, [stem]
        for s in rules:
            if not s.prefix and (form := s.applied(stem)) is not None:
                out.add(form)
                if s.cross:
                    crossed.append(form)
        for p in rules:
            if p.prefix:
                out.update(form for word in (crossed if p.cross else [stem]) if (form := p.applied(word)) is not None)
        return out


@lru_cache(4)
def tries(rules: tuple[Affix, ...]) -> Tries:
    """Compiled once by a worker."""
    return Tries(rules)


def expanded(stems: DataFrame, rules: tuple[Affix, ...]) -> DataFrame:
    """form, stem: all forms of the stems (stem, flags)."""
    schema = pa.schema([("form", pa.string()), ("stem", pa.string())])

    def run(batches):
        t = tries(rules)
        for b in batches:
            rows = [(f, stem) for stem, flags in zip(b.column("stem").to_pylist(), b.column("flags").to_pylist(), strict=True) if stem for f in sorted(t.forms(stem, flags or []))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], schema=schema)

    return stems.select("stem", "flags").mapInArrow(run, "form string, stem string")


def analysed(words: DataFrame, rules: tuple[Affix, ...]) -> DataFrame:
    """word, stem, used: the possible stems of each word and the flags that they would need."""
    schema = pa.schema([("word", pa.string()), ("stem", pa.string()), ("used", pa.list_(pa.string()))])

    def run(batches):
        t = tries(rules)
        for b in batches:
            rows = [(w, *x) for w in b.column("word").to_pylist() if w for x in sorted(t.stems(w))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([list(r[2]) for r in rows], pa.list_(pa.string()))], schema=schema)

    return words.select("word").mapInArrow(run, "word string, stem string, used array<string>")


def known(words: DataFrame, stems: DataFrame, rules: tuple[Affix, ...], key: str = "word") -> DataFrame:
    """The rows of `words` with `known`: whether the word is a form of a stem (stem, flags). Each different word is looked up once; null and
    empty words aren't known."""
    distinct = words.select(F.col(key).alias("word")).filter("word <> ''").distinct()
    entries = stems.select(F.col("stem").alias("s"), "flags")
    found = analysed(distinct, rules).join(entries, (F.col("stem") == F.col("s")) & (F.size(F.array_except("used", "flags")) == 0), "left_semi").select("word").distinct()
    found = found.select(F.col("word").alias("__word"), F.lit(True).alias("known"))
    return words.join(found, F.col(key) == F.col("__word"), "left").drop("__word").withColumn("known", F.coalesce("known", F.lit(False)))

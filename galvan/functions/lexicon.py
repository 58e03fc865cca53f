"""Lexicons: read from a folder of text files, or given as Python values. All of them are small and travel with the plan."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path


@dataclass
class Lexicon:
    nouns_m: set[str] = field(default_factory=set)
    nouns_f: set[str] = field(default_factory=set)
    first_names: dict[str, list[str]] = field(default_factory=dict)
    last_names: dict[str, list[str]] = field(default_factory=dict)
    places: dict[str, list[str]] = field(default_factory=dict)
    countries: dict[str, list[str]] = field(default_factory=dict)
    adjectives: dict[str, list[str]] = field(default_factory=dict)
    proper_nouns: dict[str, list[str]] = field(default_factory=dict)
    acronyms: dict[str, list[str]] = field(default_factory=dict)
    abbreviations: dict[str, str] = field(default_factory=dict)
    corrected: dict[str, list[str]] = field(default_factory=dict)
    standard: dict[str, list[str]] = field(default_factory=dict)
    said_also: dict[str, list[str]] = field(default_factory=dict)
    said_only: dict[str, list[str]] = field(default_factory=dict)
    words: set[str] = field(default_factory=set)
    stopwords: set[str] = field(default_factory=set)
    ngrams: dict[tuple[str, ...], list[str]] = field(default_factory=dict)
    units: dict[tuple[str, ...], list[str]] = field(default_factory=dict)


def lines(path: str | Path) -> list[str]:
    """Stripped lines without blank ones and comments."""
    return [x for line in Path(path).read_text("utf-8").splitlines() if (x := line.strip()) and not x.startswith("#")]


def pronounced(rows: list[str]) -> dict[str, list[str]]:
    """word [pronunciation]: variants in order; a word alone clears what it had."""
    out: dict[str, list[str]] = {}
    for row in rows:
        word, *said = row.split("#", 1)[0].split(maxsplit=1)
        have = out.setdefault(word, [])
        if not said:
            out[word] = []
        elif said[0].strip() not in have:
            have.append(said[0].strip())
    return out


def substitutions(rows: list[str]) -> dict[str, list[str]]:
    return {k: v.split() for k, _, v in (r.partition("\t") for r in rows)}


def ngram_substitutions(rows: list[str]) -> dict[tuple[str, ...], list[str]]:
    out = {tuple(k.lower().split()): v.split() for k, _, v in (r.partition("\t") for r in rows)}
    if any(not 1 <= len(k) <= 3 for k in out):
        raise ValueError("n-grams have one to three words")
    return out


#: First letters of a name and of its pronunciation -> those of the mutated form.
NAME_MUTATIONS = {"P": "B", "B": "V", "M": "V", "K": "G", "T": "D"}


def with_mutations(names: dict[str, list[str]]) -> dict[str, list[str]]:
    """The names and their mutated forms."""
    out = dict(names)
    for name, said in names.items():
        if name[:1] in NAME_MUTATIONS:
            new = NAME_MUTATIONS[name[0]]
            out[new + name[1:]] = [new + s[1:] if s[:1] == name[0] else s for s in said]
    return out


def load(folder: str | Path) -> Lexicon:
    """Reads the files that the folder has: <field>.tsv for each field."""
    folder, out = Path(folder), Lexicon()
    for name, kind in (
        *((n, set) for n in ("nouns_m", "nouns_f", "words", "stopwords")),
        *((n, pronounced) for n in ("first_names", "last_names", "places", "countries", "adjectives", "proper_nouns", "acronyms", "said_also", "said_only")),
        *((n, substitutions) for n in ("corrected", "standard")),
        *((n, ngram_substitutions) for n in ("ngrams", "units")),
        ("abbreviations", lambda rows: {k: v for k, _, v in (r.partition("\t") for r in rows)}),
    ):
        if (path := folder / f"{name}.tsv").exists():
            setattr(out, name, kind(lines(path)))
    for name in ("places", "first_names", "adjectives"):
        setattr(out, name, with_mutations(getattr(out, name)))
    return out


def small() -> Lexicon:
    """A lexicon of a few words, for tests and demonstration."""
    return Lexicon(
        nouns_m={"kazh", "ki", "bloaz", "den", "euro", "pesk", "dra", "tra", "levr"}, nouns_f={"kador", "maouez", "tour", "gwezenn", "merc'h", "dor", "taol"},
        first_names={"Marie": [], "Yann": [], "Deni": []}, last_names={"Gall": [], "Bras": [], "Kozh": []}, places={"Brest": ["B R EH S T"]}, countries={"Breizh": []}, adjectives={"bras": []},
        proper_nouns={"Nedeleg": []}, acronyms={"GBB": ["J E B E B E"]}, abbreviations={"It.": "Itron", "Ao.": "Aotrou", "h.a.": "hag all"}, corrected={"hirio": ["hiziv"], "dezhan": ["dezhañ"]},
        standard={"breman": ["bremañ"]}, said_only={"football": ["F OU T B A L"]}, said_also={"ti": ["T EE"]}, words={"demat", "un", "hiziv", "mat", "eo", "an", "dra", "se", "kazh", "ki"},
        stopwords={"an", "ar", "al", "ha", "e"}, ngrams={("dre", "faot"): ["dre", "fazi"], ("emaoc'h",): ["emaoc'h"], ("an", "neiz"): ["an-neiz"]}, units={("dre", "gant"): ["%"]},
    )

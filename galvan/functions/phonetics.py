"""Pronunciations of words, and spelling against a vocabulary."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .alphabet import FILLERS
from .lexicon import Lexicon

# How letters are said; a dot is a word's edge.
SAID = {
    "a": "A", "â": "A", "à": "A", "añ": "AN", "an": "AN N", "amm": "AN M", "añv.": "AN", "aux.": "O", "b": "B", "ch": "CH", "c'h": "X", "d": "D", "dei": "D EH I", "c": "K", "e": "E",
    "ê": "E", "é": "E", "è": "EH", "ë": "E", "ec'h": "EH X", "ei": "EY", "eiñ": "EY", "el.": "EH L", "ell": "EH L", "em": "EH M", "eñ": "EN", "en.": "EH N", "enn.": "EH N", "enn": "E N",
    "eñv.": "EN", "er.": "EH R", "eu": "EU", "eü": "E U", "euñv": "EN", "f": "F", "g": "G", "gn": "GN", "h": "H", "ha.": "A", "hag.": "A G", "i": "I", "ï": "I", "î": "I", "iñ": "I N",
    "iñv": "I V", "iñ.": "I", "iv.": "I W", "j": "J", "k": "K", "l": "L", "lh": "LH", "ll": "L", "m": "M", "mm": "M", "n": "N", "nn": "N", "o": "O", "ô": "O", "om": "ON M", "on": "ON N",
    "ont.": "ON N", "oñ": "ON", "ou": "OU", "oû": "OU", "où": "OU", "or": "OH R", "orr": "O R", "oc'h": "OH X", "p": "P", ".p'h": "P", "qu": "K", "q": "K", "r": "R", "rr": "R", "s": "S",
    "t": "T", "u": "U", "û": "U", "ü": "U", "uñ": "UN", ".un.": "OE N", ".ul.": "OE L", ".ur.": "OE R", "'un.": "OE N", "'ur.": "OE R", "'ul.": "OE L", "v": "V", "v.": "O", "vr.": "OH R",
    "w": "W", "x": "K S", "y": "I", "ya": "IA", "ye": "IE", "yo": "IO", "you": "IOU", "z": "Z", "zh": "Z",
}
LETTER_NAMES = {
    "A": ["A"], "B": ["B E"], "C": ["S E"], "D": ["D E"], "E": ["EU", "E"], "F": ["EH F"], "G": ["J E"], "H": ["A CH"], "I": ["I"], "J": ["J I"], "K": ["K A", "K OE"], "L": ["EH L"],
    "M": ["EH M"], "N": ["EH N"], "Ñ": ["EH N T I L D E"], "O": ["O"], "P": ["P E", "P OE"], "Q": ["K U"], "R": ["EH R"], "S": ["EH S"], "T": ["T E", "T OE"], "U": ["U"], "V": ["V E"],
    "W": ["W E", "W OE"], "X": ["I K S"], "Y": ["YE"], "Z": ["Z EH D", "Z OE"],
}
#: Longest first, so that one alternation finds the longest match.
_GRAPHEMES = "|".join(re.escape(g) for g in sorted(SAID, key=lambda g: (-len(g), g)))


def phones() -> list[str]:
    """All phones of the tables."""
    return sorted({p for s in [*SAID.values(), *FILLERS.values(), *(x for v in LETTER_NAMES.values() for x in v)] for p in s.split()})


def by_rule(word: Column) -> Column:
    """(pronunciation, number of characters without a rule) by the longest letter groups, in built-in functions."""
    dotted = F.concat(F.lit("."), F.lower(word), F.lit("."))
    parts = F.regexp_extract_all(dotted, F.lit(f"(?s){_GRAPHEMES}|."), 0)
    rules = F.create_map(*[F.lit(x) for kv in SAID.items() for x in kv])
    said = F.transform(parts, lambda p: F.try_element_at(rules, p))
    errors = F.size(F.filter(parts, lambda p: F.try_element_at(rules, p).isNull() & ~p.isin(".", "'")))
    return F.struct(F.array_join(said, " ").alias("said"), errors.alias("errors"))


def known(lexicon: Lexicon) -> dict[str, list[str]]:
    """Exact words -> pronunciations, by the order in which lexicons count."""
    out: dict[str, list[str]] = {}
    for d in (lexicon.acronyms, LETTER_NAMES, lexicon.first_names, lexicon.last_names, lexicon.places, lexicon.proper_nouns):
        for w, said in d.items():
            if said:
                out.setdefault(w, said)
    return out


def known_lower(lexicon: Lexicon) -> dict[str, list[str]]:
    """Lower-cased words -> pronunciations."""
    out = {w: [s] for w, s in FILLERS.items()}
    return out | {w: s + lexicon.said_also.get(w, []) for w, s in lexicon.said_only.items()}


def _map(d: dict[str, list[str]]) -> Column:
    rows = [F.struct(F.lit(k).alias("key"), F.array(*[F.lit(x) for x in v]).alias("value")) for k, v in d.items()]
    return F.map_from_entries(F.array(*rows)) if rows else F.create_map().cast("map<string,array<string>>")


def combined(parts: Column) -> Column:
    """(variants, errors) of a word from those of its parts (said, errors), every variant of one with every one of the next."""
    start = F.struct(F.array(F.lit("")).alias("variants"), F.lit(0).alias("errors"))
    join = lambda a, p: F.struct(F.flatten(F.transform(p["said"], lambda s: F.transform(a["variants"], lambda v: F.btrim(F.concat(v, F.lit(" "), s))))).alias("variants"), (a["errors"] + p["errors"]).alias("errors"))
    return F.aggregate(parts, start, join)


def phonetized(word: Column, lexicon: Lexicon) -> Column:
    """(variants, errors). Parts of a hyphenated word each have variants, which are combined. The lexicon travels in the plan; for one of more
    than some hundred words there is `sources.lexicons.phonetized`."""
    exact, lower, also = _map(known(lexicon)), _map(known_lower(lexicon)), _map(lexicon.said_also)
    none = F.array().cast("array<string>")

    def one(w):
        fixed = F.coalesce(F.try_element_at(exact, w), F.try_element_at(lower, F.lower(w)))
        rule = by_rule(w)
        return F.struct(F.coalesce(fixed, F.concat(F.array(rule["said"]), F.coalesce(F.try_element_at(also, w), none))).alias("said"), F.when(fixed.isNull(), rule["errors"]).otherwise(0).alias("errors"))

    return combined(F.transform(F.split(F.btrim(word), "-"), one))


def mistakes(tokens: DataFrame, vocabulary: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_mistakes, words: from rows (keys, type, flags, data). Raw tokens are mistakes, and words that the vocabulary lacks;
    of an inclusive word its head counts, and corrected words don't."""
    checked = tokens.select(*keys, "type", "flags", F.when(F.array_contains("flags", "INCLUSIVE"), F.substring_index("data", "·", 1)).otherwise(F.col("data")).alias("word"))
    words = checked.filter("type = 'WORD'").filter(~F.array_contains("flags", "CORRECTED"))
    wrong = words.join(vocabulary.select(F.col("word")).distinct(), "word", "left_anti").select(*keys, "word").unionByName(checked.filter("type = 'RAW'").select(*keys, "word"))
    return wrong.groupBy(*keys).agg(F.count("*").alias("n_mistakes"), F.array_sort(F.collect_set("word")).alias("words"))


def phonetized_series(lexicon: Lexicon):
    """The same for whole columns of rare words, outside SQL plans."""

    def f(words: pd.Series) -> pd.Series:
        exact, lower, also = known(lexicon), known_lower(lexicon), lexicon.said_also

        def one(w: str) -> list[str]:
            fixed = exact.get(w) or lower.get(w.lower())
            return fixed or [" ".join(SAID[g] for g in re.findall(f"(?s){_GRAPHEMES}|.", f".{w.lower()}.") if g in SAID), *also.get(w, [])]

        return words.map(one)

    return f


def phone_lines(phones: Column, names: dict[str, str], durations: dict[str, int], joined: dict[tuple[str, str], str] | None = None, jitter: int = 20, usual: int = 100, pause: int = 100) -> Column:
    """The lines of a synthesizer's phone file, a name and milliseconds each, from an array of phones: a pause, the phones under the
    synthesizer's names, a pause. joined: pairs of names that become one, with both durations (the first of overlapping pairs). Durations differ by
    up to `jitter`, drawn from a hash of place and name, so they repeat. Unknown phones keep their names."""
    named = F.create_map(*[F.lit(x) for kv in (names or {"": ""}).items() for x in kv])
    lasting = F.create_map(*[F.lit(x) for kv in (durations or {"": usual}).items() for x in kv])

    def timed(p, i):
        name = F.coalesce(F.try_element_at(named, p), p)
        shift = F.pmod(F.xxhash64(name, i), F.lit(2 * jitter + 1)) - jitter
        return F.struct(name.alias("name"), (F.coalesce(F.try_element_at(lasting, name), F.lit(usual)) + shift).cast("int").alias("ms"))

    pairs = F.create_map(*[F.lit(x) for (a, b), c in (joined or {("", ""): ""}).items() for x in (f"{a} {b}", c)])
    becomes = lambda t, i: F.when((i >= 0) & (i + 1 < F.size(t)), F.try_element_at(pairs, F.concat_ws(" ", F.get(t, i)["name"], F.get(t, i + 1)["name"])))

    def merged(t):
        def line(x, i):
            own, by_last = becomes(t, i), becomes(t, i - 1).isNotNull() & becomes(t, i - 2).isNull()
            together = F.struct(own.alias("name"), (x["ms"] + F.get(t, i + 1)["ms"]).alias("ms"))
            return F.when(by_last, F.lit(None)).when(own.isNotNull(), together).otherwise(x)

        return F.filter(F.transform(t, line), lambda x: x.isNotNull())

    from .text import bound

    shown = F.transform(bound(F.transform(phones, timed), merged), lambda x: F.concat(F.rpad(x["name"], 4, " "), x["ms"].cast("string")))
    rest = F.array(F.lit("_".ljust(4) + str(pause)))
    return F.concat(rest, shown, rest)

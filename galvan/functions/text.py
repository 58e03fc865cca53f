"""Column functions on strings. Null in gives null out; predicates are false for an empty text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .alphabet import LETTERS, ORDINALS, PUNCT_PAIRS, PUNCTUATION, ROMAN_ORDINALS, UNITS

_ANY_LETTER = LETTERS + LETTERS.upper()
NBSP = "\u00a0"
#: White space as Python's str.split sees it.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x1c-\x1f\x85]"


def chars(s: str) -> str:
    """A character class that holds exactly the characters of s."""
    return "[" + "".join(re.escape(c) for c in s) + "]"


def bound(value: Column, f) -> Column:
    """f(value), with the value computed once: what a lambda refers to from outside is computed again at each element."""
    return F.transform(F.array(value), f)[0]


def split_words(c: Column) -> Column:
    return F.filter(F.split(c, SPACE + "+"), lambda w: w != "")


def beginning(c: Column, n: int) -> Column:
    """A text up to its n-th word that isn't punctuation alone; "" if it has fewer."""
    blank, mark = SPACE[1:-1], chars(PUNCTUATION)[1:-1]
    return F.regexp_extract(c, f"^(?:[{blank}{mark}]*+[^{blank}{mark}][^{blank}]*+){{{n}}}", 0)


# Pairs of characters and single ones, and their canonical forms; the last two single ones go.
_PAIRS = (("n\u0303", "\u00f1"), ("\u0148", "\u00f1"), ("\u00f1\u0303", "\u00f1"), ("u\u0300", "\u00f9"), ("e\u0302", "\u00ea"), ("u\u0302", "\u00fb"))
_SINGLE = ("\u2018\u2019\u02bc\u0131\u00e3\u00f6\u00e1\u00cd\u02dc\u0160", "'''iaoaI")


def canonical(c: Column) -> Column:
    """One form of quotes, tildes and accents. Pairs of characters go first, as no single one makes a new pair but U+0148."""
    for old, new in _PAIRS:
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.translate(c, *_SINGLE)


def drop_chars(c: Column, unwanted: str) -> Column:
    return F.translate(c, unwanted, "")


def keep_chars(c: Column, allowed: str) -> Column:
    return F.regexp_replace(c, "[^" + chars(allowed)[1:], "")


def strip_punct(c: Column) -> Column:
    return F.btrim(c, F.lit(PUNCTUATION))


def capitalize(c: Column) -> Column:
    """Upper-cases the first letter, wherever it stands, and nothing else."""
    pattern = f"(?s)^([^{_ANY_LETTER}]*)([{_ANY_LETTER}])(.*)$"
    return F.when(c.rlike(pattern), F.concat(F.regexp_extract(c, pattern, 1), F.upper(F.regexp_extract(c, pattern, 2)), F.regexp_extract(c, pattern, 3))).otherwise(c)


def is_title(c: Column) -> Column:
    """Each run of letters is an upper-case letter and lower-case ones, and there is a run."""
    return c.rlike(r"^(?:[^\p{L}]*\p{Lu}\p{Ll}*)+[^\p{L}]*$") & ~c.rlike(r"\p{Ll}\p{Lu}|\p{Lu}\p{Lu}")


def parentheses(c: Column) -> Column:
    """remaining, extracted: what stands in parentheses, and the text without it."""
    pattern = r"\(([^\n]+?)\)"
    return F.struct(F.regexp_replace(c, pattern, "").alias("remaining"), F.regexp_extract_all(c, F.lit(pattern), 1).alias("extracted"))


def _count(c: Column, pattern: str) -> Column:
    return (F.length(c) - F.length(F.regexp_replace(c, pattern, ""))).cast("int")


def sentence_stats(c: Column) -> Column:
    """Letters (' and - too), those in upper case, digits, punctuation, blanks, other characters and words. Fixed sets are counted by
    table lookups; only what no set has, a small part of a text, is searched for digits and blanks."""
    letters = LETTERS + LETTERS.upper() + "'-"
    without = lambda x, known: F.translate(x, known, "")
    sets = F.struct(without(c, letters).alias("no_letters"), without(c, LETTERS.upper()).alias("no_upper"), without(c, PUNCTUATION).alias("no_punct"))

    def counted(s):
        n = F.length(c)
        letter, upper, punct = n - F.length(s["no_letters"]), n - F.length(s["no_upper"]), n - F.length(s["no_punct"])
        rest = without(s["no_letters"], PUNCTUATION)
        decimal, blank = _count(rest, r"\p{Nd}"), _count(rest, SPACE)
        other = n - letter - decimal - punct - blank
        return F.struct(letter.alias("letter"), decimal.alias("decimal"), upper.alias("upper"), punct.alias("punct"), blank.alias("blank"), other.cast("int").alias("other"), F.size(split_words(s["no_punct"])).alias("words"))

    return bound(sets, counted)


def simplify(c: Column) -> Column:
    bare = F.regexp_replace(drop_chars(c, "\"«»'’()"), f"^{SPACE}+|{SPACE}+$", "")
    return F.regexp_replace(bare, f"^[-–—]{SPACE}+", "")


def is_full_sentence(c: Column) -> Column:
    return simplify(c).rlike(r"(?s)^\p{Lu}(?:.*[.!?…;:])$")


def is_start_open(c: Column) -> Column:
    return simplify(c).rlike(r"^(?:\p{Ll}|\p{Lu}[\p{Lu}\p{Nd}]|\p{Nd})")


def is_end_open(c: Column) -> Column:
    return simplify(c).rlike(r"(?:\p{Ll}|\p{Nd}|[-…,])\z")


def is_punct_paired(c: Column) -> Column:
    n = lambda x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    out = n('"') % 2 == 0
    for a, b in PUNCT_PAIRS.items():
        out = out & (n(a) == n(b))
    return out


def is_word(c: Column) -> Column:
    return c.rlike(f"^(?iu)['’\\-·{LETTERS}]+$")


def is_inclusive_word(c: Column) -> Column:
    """word·ending; the first part may have characters from ' to a as well."""
    return c.rlike(f"^(?iu)['-a{LETTERS[1:]}]+·[-{LETTERS}]+$")


def is_unit_number(c: Column) -> Column:
    units = "|".join(re.escape(u) for u in sorted(UNITS, key=lambda u: (-len(u), u)))
    return c.rlike(f"^(?:[0-9]{{1,3}}(?:\\.[0-9]{{3}})+|[0-9]+)(?:{units})$")


def is_time(c: Column) -> Column:
    return c.rlike("^[0-9]+(?:e|h|eur)(?:0*[0-5]?[0-9])?$")


def is_ordinal(c: Column) -> Column:
    return c.isin(*ORDINALS) | c.rlike("^[0-9]+vet$")


def is_roman_number(c: Column) -> Column:
    return c.rlike("^[XVI]+$")


def is_roman_ordinal(c: Column) -> Column:
    return c.isin(*ROMAN_ORDINALS) | c.rlike("^[XVI]+vet$")


def hms(seconds: Column, sep: str = " ", precision: int = 0, units: tuple[str, str, str] = ("h", "'", "''")) -> Column:
    """Seconds as hours, minutes and seconds; parts before the first that counts are left out."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    shown = F.format_string(f"%.{max(precision, 1)}f", F.bround(s.cast("double"), precision))
    return F.concat_ws(sep, F.when(h > 0, F.concat(h.cast("string"), F.lit(units[0]))), F.when((h > 0) | (m > 0), F.concat(m.cast("string"), F.lit(units[1]))), F.concat(shown, F.lit(units[2])))


#: First letters (of lower-cased words) -> what they may have been before a mutation.
UNMUTATED = {"z": "td", "f": "p", "k": "g", "t": "d", "p": "b", "g": "k", "d": "t", "b": "p", "v": "bm"}


def reverse_mutation(c: Column) -> Column:
    """Candidates for the unmutated word, in the case of the first letter."""
    first = F.lower(F.substring(c, 1, 1))
    made = lambda new, rest: F.concat(F.when(F.substring(c, 1, 1).rlike(r"^\p{Lu}"), F.lit(new.upper())).otherwise(F.lit(new)), rest)
    rest = F.substr(c, F.lit(2))
    out = F.when(F.lower(c).startswith("c'h"), F.array(made("k", F.substr(c, F.lit(4))), made("g", F.substr(c, F.lit(4))))).when(first == "w", F.array(made("g", c)))
    for letter, before in UNMUTATED.items():
        out = out.when(first == letter, F.array(*[made(x, rest) for x in before]))
    return F.when(c.isNotNull(), out.otherwise(F.array().cast("array<string>")))


_UNALIGNED = dict.fromkeys(map(ord, PUNCTUATION + " '-h"))


def align_form(c: Column) -> Column:
    """What forced alignment compares: no markup, one letter for c'h and ch, no doubled characters, no punctuation. Digits stay;
    spell them out first (numbers.spell_digits)."""
    c = F.regexp_replace(F.regexp_replace(c, r"\{[^\n]+?\}", ""), "<[A-Z']+?>", "")
    c = canonical(F.lower(c))
    c = F.replace(F.replace(c, F.lit("c'h"), F.lit("X")), F.lit("ch"), F.lit("S"))
    c = F.regexp_replace(F.translate(c, "ùê", "ue"), r"(?s)(.)\1+", "$1")
    return drop_chars(c, PUNCTUATION + " '-h")


def align_form_of(text: str) -> str:
    """The same of a Python string, for what grows word by word within a task."""
    text = re.sub("<[A-Z']+?>", "", re.sub(r"\{[^\n]+?\}", "", text)).lower()
    for old, new in _PAIRS:
        text = text.replace(old, new)
    for old, new in zip(_SINGLE[0], _SINGLE[1] + "\0\0", strict=True):
        text = text.replace(old, new.strip("\0"))
    text = text.replace("c'h", "X").replace("ch", "S").replace("ù", "u").replace("ê", "e")
    return re.sub(r"(?s)(.)\1+", r"\1", text).translate(_UNALIGNED)


def count_plain_words(c: Column) -> Column:
    c = F.regexp_replace(c, r"\{[^\n]+?\}", "")
    return F.size(split_words(F.translate(drop_chars(canonical(c), PUNCTUATION + "'"), "-", " ")))


def safe_filename(c: Column) -> Column:
    return keep_chars(F.translate(c, " ", "_"), _ANY_LETTER + "0123456789_-")


# Contractions and their parts, in the order they are tried.
CONTRACTIONS = (("'meus", "'m eus"), ("'neus", "'n eus"), ("'moa", "'m oa"), ("'noa", "'n oa"))


def split_contractions(c: Column, rules: tuple[tuple[str, str], ...] = CONTRACTIONS) -> Column:
    def word(w: Column) -> Column:
        for old, new in rules:
            w = F.replace(w, F.lit(old), F.lit(new))
        return w

    return F.array_join(F.transform(split_words(c), word), " ")


def masked_tokens(c: Column) -> Column:
    """Words without punctuation around them; numbers are <NUM>, or <BIG_NUM> from five digits on."""
    words = F.filter(F.transform(split_words(c), strip_punct), lambda w: w != "")
    return F.transform(words, lambda w: F.when(w.rlike(r"^\p{Nd}{5,}$"), "<BIG_NUM>").when(w.rlike(r"^\p{Nd}+$"), "<NUM>").otherwise(w))

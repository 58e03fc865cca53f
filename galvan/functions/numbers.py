"""Numbers, times and ordinals in words, as Column functions; counting is by twenties."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .alphabet import ORDINALS, ROMAN_ORDINALS, UNITS

# The words numbers are made of.
SMALL = ["mann", "unan", "daou", "tri", "pevar", "pemp", "c'hwec'h", "seizh", "eizh", "nav", "dek", "unnek", "daouzek", "trizek", "pevarzek", "pemzek", "c'hwezek", "seitek", "triwec'h", "naontek", "ugent"]
FEMININE = {2: "div", 3: "teir", 4: "peder"}
TENS = {20: "ugent", 30: "tregont", 40: "daou-ugent", 50: "hanter-kant", 60: "tri-ugent", 80: "pevar-ugent"}
ROMAN = {
    "I": "unan", "II": "daou", "III": "tri", "IIII": "pevar", "IV": "pevar", "V": "pemp", "VI": "c'hwec'h", "VII": "seizh", "VIII": "eizh", "IX": "nav", "X": "dek", "XI": "unnek",
    "XII": "daouzek", "XIII": "trizek", "XIV": "pevarzek", "XV": "pempzek", "XVI": "c'hwezek", "XVII": "seitek", "XVIII": "triwec'h", "XIX": "naontek", "IXX": "naontek", "XX": "ugent",
    "XXI": "un warn-ugent", "XXII": "daou warn-ugent", "XXIII": "tri warn-ugent", "XXIV": "pevar warn-ugent", "XXV": "pemp warn-ugent", "XXVI": "c'hwec'h warn-ugent",
    "XXVII": "seizh warn-ugent", "XXVIII": "eizh warn-ugent", "XXIX": "nav warn-ugent", "XXX": "tregont", "XXXI": "un ha tregont", "XXXII": "daou ha tregont", "XXXIII": "tri ha tregont",
    "XXXIV": "pevar ha tregont", "XXXV": "pemp ha tregont",
}


def below_hundred(n: int, feminine: bool = False) -> str:
    """1 to 99; units stand before the tens."""
    small = lambda k: FEMININE.get(k, SMALL[k]) if feminine else SMALL[k]
    if n <= 20:
        return small(n)
    base = max(t for t in TENS if t <= n)
    if n == base:
        return TENS[base]
    link = {20: " warn-", 50: " hag "}.get(base, " ha ")
    return small(n - base) + link + TENS[base]


def below_thousand(n: int, feminine: bool = False) -> str:
    """1 to 999, and "" for 0."""
    h, u = divmod(n, 100)
    hundreds = "" if not h else "kant" if h == 1 else f"{SMALL[h]} {"c'hant" if h in (2, 3, 4, 9) else 'kant'}"
    return " ".join(x for x in (hundreds, below_hundred(u, feminine) if u else "") if x)


@cache
def lookup(feminine: bool = False) -> tuple[str, ...]:
    """Readings of 0 ("") to 999."""
    return tuple(below_thousand(n, feminine) for n in range(1000))


@cache
def _parted(feminine: bool = False) -> tuple[tuple[str, str], ...]:
    """Readings of 0 to 1000 in what stands before a noun and behind it."""
    words = [SMALL[0], *lookup(feminine)[1:], "mil"]
    cuts = [max(w.rfind(x) for x in (" ha ", " hag ", " warn-")) for w in words]
    return tuple((w, "") if at < 0 else (w[:at], w[at:]) for w, at in zip(words, cuts, strict=True))


def number_words(n: Column, feminine: bool = False, beyond: bool = False) -> Column:
    """Cardinal in words for 0 up to 999,999,999,999; null outside, or with `beyond` the last twelve digits of greater ones. The feminine forms hold below
    a thousand."""
    n = n.cast("bigint")
    table = F.array(*[F.lit(x) for x in lookup()])
    at = lambda t, k: F.element_at(t, (k + 1).cast("int"))
    parts = []
    for size, one, two, many in ((10**9, "ur miliard", "viliard", "miliard"), (10**6, "ur milion", "vilion", "milion"), (10**3, "mil", "vil", "mil")):
        k = ((n % (1000 * size) - n % size) / size).cast("bigint")  # exact: below a thousand
        parts.append(F.when(k == 1, one).when(k == 2, "daou " + two).when(k > 2, F.concat(at(table, k), F.lit(" " + many))))
    last = at(table, n % 1000)
    if feminine:
        last = F.when(n < 1000, at(F.array(*[F.lit(x) for x in lookup(True)]), n % 1000)).otherwise(last)
    parts.append(F.when(n % 1000 > 0, last))
    return F.when(n == 0, "mann").when((n > 0) if beyond else (n > 0) & (n < 10**12), F.concat_ws(" ", *parts))


def year_noun(n: Column, noun: Column) -> Column:
    """bloaz or vloaz after a number; other nouns stay."""
    plain = (n % 10).isin(1, 3, 4, 5, 9) | n.isin(1000, 10**6, 10**9)
    return F.when(noun.isin("bloaz", "vloaz"), F.when(plain, "bloaz").otherwise("vloaz")).otherwise(noun)


def number_noun(n: Column, noun: Column, feminine: Column | None = None) -> Column:
    """A number with its noun, which stands before " ha ", " hag " or " warn-" of the part below a thousand. feminine: whether the noun is."""
    n = n.cast("bigint")
    noun = year_noun(n, noun)
    rest = F.when(n <= 1000, n).otherwise(n % 1000)
    first = F.lower(F.substring(noun, 1, 1))
    one = F.when(first == "l", "ul").when(first.isin(*"adehinot"), "un").otherwise("ur")

    def part(k: int) -> Column:
        of = lambda f: F.element_at(F.array(*[F.lit(x[k]) for x in _parted(f)]), F.when(rest >= 0, (rest + 1).cast("int")))
        return of(False) if feminine is None else F.when(feminine, of(True)).otherwise(of(False))

    head = F.when(rest % 10 == 1, F.replace(part(0), F.lit("unan"), one)).otherwise(part(0))
    placed = F.concat(head, F.lit(" "), noun, part(1))
    thousands = number_words(n - n % 1000)
    return F.when(n > 1000, F.when(n % 1000 == 0, F.concat(thousands, F.lit(" "), noun)).otherwise(F.concat(thousands, F.lit(" "), placed))).otherwise(placed)


def article_noun(noun: Column, article: str, masculine: Column, feminine: Column) -> Column:
    """Readings of article and noun, one for each gender that the noun has. article: an or un, in any form."""
    first = F.lower(F.substring(noun, 1, 1))
    stem = article[:-1]
    art = F.when(first == "l", stem + "l").when(first.isin(*"adehinot"), stem + "n").otherwise(stem + "r")
    rest = F.substr(noun, F.lit(2))
    cased = lambda w: F.when(F.substring(noun, 1, 1).rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))).otherwise(w)
    m = F.when(first == "k", F.concat(F.lit("c'h"), rest)).otherwise(noun)
    f = F.when(first == "k", F.concat(F.lit("g"), rest)).when(first == "p", F.concat(F.lit("b"), rest)).when(first == "t", F.concat(F.lit("d"), rest))
    f = f.when(F.lower(noun).startswith("gw"), F.concat(F.lit("w"), F.substr(noun, F.lit(3)))).when(first == "g", F.concat(F.lit("c'h"), rest)).when(first.isin("b", "m"), F.concat(F.lit("v"), rest)).otherwise(noun)
    reading = lambda w: F.concat(art, F.lit(" "), cased(w))
    return F.when(noun == "dor", F.array(F.concat(art, F.lit(" nor")))).otherwise(F.array_compact(F.array(F.when(masculine, reading(m)), F.when(feminine, reading(f)))))


def clock_words(hour: Column, minute: Column) -> Column:
    """Readings of a time of day, the most usual first."""
    named = lambda h: F.when(h == 0, F.array(F.lit("hanternoz"), F.lit("kreiznoz"))).when(h == 12, F.array(F.lit("kreisteiz"))).otherwise(F.array(F.concat(number_words(F.when(h > 12, h - 12).otherwise(h), True), F.lit(" eur"))))
    after = lambda a, tail: F.transform(a, lambda x: F.concat(x, F.lit(" "), tail))
    coming = named((hour + 1) % 12)
    to_next = F.when((minute == 40) | (minute > 50), after(coming, F.concat(F.lit("nemet "), number_words(60 - minute)))).when(minute == 45, after(coming, F.lit("nemet kard"))).otherwise(F.array().cast("array<string>"))
    minutes = F.when(minute == 15, F.array(F.lit("ha kard"), number_words(minute))).when(minute == 30, F.array(F.lit("hanter"), number_words(minute))).otherwise(F.array(number_words(minute)))
    past = F.when(minute == 0, named(hour)).otherwise(F.flatten(F.transform(named(hour), lambda h: F.transform(minutes, lambda m: F.concat(h, F.lit(" "), m)))))
    return F.concat(to_next, past)


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def ordinal_words(c: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(ORDINALS), c), F.concat(number_words(F.try_to_number(F.nullif(F.regexp_extract(c, "^([0-9]{1,12})vet$", 1), F.lit("")), F.lit("999999999999"))), F.lit("vet")))


def roman_words(c: Column) -> Column:
    """Null beyond 35."""
    return F.try_element_at(_map(ROMAN), c)


def roman_ordinal_words(c: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(ROMAN_ORDINALS), c), F.concat(roman_words(F.regexp_extract(c, "^([XVI]+)vet$", 1)), F.lit("vet")))


def unit_words(c: Column) -> Column:
    return F.try_element_at(_map(UNITS), c)


def words_sql(n: str, feminine: bool = False) -> str:
    """number_words as an SQL expression over the list `t` (and `tf`) of readings of 0 to 999."""
    part = lambda size, one, two, many: f"CASE WHEN ({n}) // {size} % 1000 = 1 THEN '{one} ' WHEN ({n}) // {size} % 1000 = 2 THEN 'daou {two} ' WHEN ({n}) // {size} % 1000 > 2 THEN t[({n}) // {size} % 1000 + 1] || ' {many} ' ELSE '' END"
    last = f"CASE WHEN ({n}) < 1000 THEN tf[({n}) % 1000 + 1] ELSE t[({n}) % 1000 + 1] END" if feminine else f"t[({n}) % 1000 + 1]"
    return f"(CASE WHEN ({n}) = 0 THEN 'mann' ELSE trim({part(10**9, 'ur miliard', 'viliard', 'miliard')} || {part(10**6, 'ur milion', 'vilion', 'milion')} || {part(10**3, 'mil', 'vil', 'mil')} || {last}) END)"


def lists_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return f"(SELECT [{', '.join(map(quoted, lookup()))}] AS t, [{', '.join(map(quoted, lookup(True)))}] AS tf)"

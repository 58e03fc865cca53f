"""Spelled numbers to digits, and substitutions after recognition, on texts and on timecoded words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .alphabet import FILLERS
from .lexicon import Lexicon
from .tokens import Tokenizer, joined, slices, text_udf

WORD = "struct<word:string,start:double,end:double,conf:double>"
# Number words.
ONES = {
    "unan": 1, "un": 1, "ur": 1, "ul": 1, "daou": 2, "zaou": 2, "div": 2, "tri": 3, "teir": 3, "pevar": 4, "peder": 4, "pemp": 5, "bemp": 5, "c'hwec'h": 6, "seizh": 7, "eizh": 8, "nav": 9,
}
TEENS = {"dek": 10, "unnek": 11, "daouzek": 12, "trizek": 13, "pevarzek": 14, "pemzek": 15, "c'hwezek": 16, "seitek": 17, "triwec'h": 18, "naontek": 19}
TENS = {"ugent": 20, "tregont": 30, "daou-ugent": 40, "hanter-kant": 50, "tri-ugent": 60, "pevar-ugent": 80}
HUNDRED, THOUSAND = ("kant", "c'hant"), ("mil", "vil")
LARGE = {"miliard": 10**9, "viliard": 10**9, "milion": 10**6, "vilion": 10**6}
NOTHING = ("zero", "mann")
LINKS = frozenset("hag pe met evit gant war dre dindan etre betek eus ouzh zo oa eo vez warn ugent hanter warn-ugent".split())
_MARKS = ".…,;:!?»)”\""


@dataclass(slots=True)
class Said:
    """A word, with its times if they are known."""

    word: str
    start: float = 0.0
    end: float = 0.0
    conf: float = 1.0


class Parse(NamedTuple):
    """A number that ends before word `end`; a noun may stand before its last part (pemp bloaz warn-ugent), alone or with a word that goes
    with it (div blac'h kozh ha daou-ugent): the `width` words from `noun` on."""

    end: int
    value: int
    noun: int | None = None
    width: int = 0


#: Words that a number may begin with, and those that begin tens of two words.
_TWO = frozenset(k.split("-")[0] for k in TENS if "-" in k)
STARTS = frozenset([*ONES, *TEENS, *TENS, *HUNDRED, *THOUSAND, *LARGE, *NOTHING, *_TWO])


class Grammar:
    """Numbers among the words of a sentence. Each rule gives all its parses from a place on:

    tens      ugent | tregont | daou-ugent | hanter-kant | tri-ugent | pevar-ugent, with a hyphen or a space
    hundred   below a hundred: one | teen | tens | one [noun [word]] warn-ugent | one [noun [word]] ha(g) tens | teen [noun [word]] ha 60 or 80;
              after a noun, ha(g) tens belongs to the number only if no noun of its own follows (... ha daou-ugent kazh are two numbers)
    thousand  [one or teen] kant [hundred] | hundred
    million   [thousand below 1000] mil [thousand] | thousand
    number    [million below a million] milion or miliard [smaller number] | hanter of one of these | million"""

    #: Of how many runs of words the numbers below a thousand are remembered, and how far behind a place such a number looks.
    REMEMBERED, AHEAD = 200_000, 10

    def __init__(self, words: list[str], is_noun: Callable[[str], bool] = lambda w: False, stops: set[int] = frozenset(), below: dict | None = None) -> None:
        """stops: words after which no number goes on. below: numbers below a thousand by their words and what was looked at behind them, as a tree of
        words, which may be shared by sentences with the same nouns."""
        self.count, self.is_noun = len(words), is_noun
        self.words = [*words, *[""] * self.AHEAD]
        #: of each place, behind which word a number from there ends at the latest
        self.upto: list[int] | None = None
        if stops:
            self.upto = [self.count] * (self.count + 1)
            for i in range(self.count - 1, -1, -1):
                self.upto[i] = i + 1 if i in stops else self.upto[i + 1]
        self.below = {} if below is None else below
        self.known: dict[int, list[Parse]] = {}
        self.reach = 0

    def at(self, i: int) -> str:
        if i > self.reach:
            self.reach = i
        return self.words[i]

    def tens(self, i: int) -> list[Parse]:
        word = self.at(i)
        out = [Parse(i + 1, TENS[word])] if word in TENS else []
        if word in _TWO and (both := f"{word}-{self.at(i + 1)}") in TENS:
            out.append(Parse(i + 2, TENS[both]))
        return out

    def added(self, i: int) -> list[Parse]:
        """What is said after the ones or teens of a number below a hundred."""
        link = self.at(i)
        if link == "warn-ugent" or (link == "warn" and self.at(i + 1) == "ugent"):
            return [Parse(i + 1 + (link == "warn"), 20)]
        if link not in ("ha", "hag"):
            return []
        return [p for p in self.tens(i + 1) if p.value > 20 and link == ("hag" if p.value == 50 else "ha")]

    def hundred(self, i: int) -> list[Parse]:
        low = ONES.get(self.at(i)) or TEENS.get(self.at(i))
        if low is None:
            return self.tens(i)
        out = [Parse(i + 1, low), *self.tens(i)]
        for width in range(3):
            if (width and not self.is_noun(self.at(i + 1))) or (width == 2 and not self.beside_noun(self.at(i + 2))):
                continue
            parts = [p for p in self.added(i + 1 + width) if low < 10 or p.value in (60, 80)]
            out += [Parse(p.end, low + p.value, i + 1 if width else None, width) for p in parts if not width or p.value == 20 or not self.is_noun(self.at(p.end))]
        return out

    def beside_noun(self, word: str) -> bool:
        """Whether a word may go with a noun, like an adjective: none that counts, joins or is a noun."""
        return len(word) > 2 and word not in LINKS and word not in ONES and word not in TEENS and word not in TENS and word not in HUNDRED + THOUSAND + NOTHING and word not in LARGE and not self.is_noun(word)

    def then(self, i: int, value: int, parses: list[Parse], below: int) -> list[Parse]:
        """`value`, alone or with a smaller number behind it."""
        new = tuple.__new__
        return [Parse(i, value)] + [new(Parse, (end, value + more, noun, width)) for end, more, noun, width in parses if more < below]

    def _thousand(self, i: int) -> list[Parse]:
        times = ONES.get(self.at(i)) or TEENS.get(self.at(i))
        out = self.hundred(i)
        if self.at(i) in HUNDRED:
            out += self.then(i + 1, 100, self.hundred(i + 1), 100)
        elif times and self.at(i + 1) in HUNDRED:
            out += self.then(i + 2, 100 * times, self.hundred(i + 2), 100)
        return out

    def thousand(self, i: int) -> list[Parse]:
        """What the words up to the furthest one looked at give is the same wherever they stand."""
        if i > self.count:
            return []
        words, node, j, new = self.words, self.below, i, tuple.__new__  # the class would be called a dozen times a number
        while j < i + self.AHEAD and j < len(words):
            node = node.get(words[j])
            if node is None:
                break
            if node.__class__ is list:
                return [new(Parse, (i + end, value, None if noun is None else i + noun, width)) for end, value, noun, width in node]
            j += 1
        self.reach = i
        found = self._thousand(i)
        left = self.below.setdefault(None, self.REMEMBERED)
        if left:
            self.below[None] = left - 1
            node = self.below
            for w in words[i : self.reach]:
                node = node.setdefault(w, {})
            node[words[self.reach]] = [Parse(p.end - i, p.value, None if p.noun is None else p.noun - i, p.width) for p in found]
        return found

    def million(self, i: int) -> list[Parse]:
        found = self.known.get(i)
        if found is None:
            words, found = self.words, self.thousand(i)
            times = [(p.end, p.value) for p in found if p.value < 1000 and p.noun is None and words[p.end] in THOUSAND]
            if words[i] in THOUSAND:
                times.insert(0, (i, 1))
            for end, value in times:
                found = found + self.then(end + 1, 1000 * value, self.thousand(end + 1), 1000)
            self.known[i] = found
        return found

    def number(self, i: int, below: int = 10**12) -> list[Parse]:
        words, million = self.words, self.million(i)
        out = [p for p in million if p.value < below]
        if words[i] == "hanter":
            halved = 1000 if words[i + 1] in THOUSAND else LARGE.get(words[i + 1])
            if halved and halved // 2 < below:
                out.append(Parse(i + 2, halved // 2))
        times = [(i, 1)] if words[i] in LARGE else []
        times += [(p.end, p.value) for p in million if words[p.end] in LARGE and p.noun is None and p.value < 10**6]
        for end, value in times:
            size = LARGE[words[end]]
            if size < below:
                out += self.then(end + 1, value * size, self.number(end + 1, size), size)
        return out

    def longest(self, i: int) -> Parse | None:
        first = self.words[i]
        if first in NOTHING:
            return Parse(i + 1, 0)
        if first not in STARTS:
            return None
        end = self.upto[i] if self.upto else self.count
        return max((p for p in self.number(i) if p.end <= end), key=lambda p: p[:2], default=None)


#: For words without nouns.
_PLAIN: dict = {}


@lru_cache(1 << 16)
def _worth(words: tuple[str, ...], below: int) -> int | None:
    return max((p.value for p in Grammar(list(words), below=_PLAIN).number(0, below) if p.end == len(words)), default=None)


def value(words: list[str]) -> int | None:
    """What number words are worth, if all of them are one number. What stands behind the last milion or miliard is a number of its own that is added, and
    so is what stands behind the last mil, so that millions of numbers share some thousand parts; only after hanter nothing goes on."""
    if len(words) == 1 and words[0] in NOTHING:
        return 0
    large = thousand = 0
    for end, w in enumerate(words, 1):
        if w in LARGE:
            large, thousand = end, 0
        elif w in THOUSAND:
            thousand = end
    out, start, below = 0, 0, 10**12
    for end in (large, thousand, len(words)):
        if end <= start or (end < len(words) and words[end - 2 : end - 1] == ["hanter"]):
            continue
        part = _worth(tuple(words[start:end]), below)
        if part is None:
            return None
        out, start, below = out + part, end, 1000 if end == thousand else 10**6
    return out if words else None


class Inverse:
    def __init__(self, lexicon: Lexicon, least: int = 5) -> None:
        self.noun, self.lex, self.least = Tokenizer(lexicon).noun, lexicon, least
        self.below: dict = {}
        self.ngrams, self.units = ((t, frozenset(k[0] for k in t)) for t in (lexicon.ngrams, lexicon.units))

    def numbers(self, words: list[str]) -> tuple[list[str], list[tuple[int, Parse]]]:
        """The words without punctuation at their ends, and the numbers of `least` or more with their places, the longest from each place on.
        Punctuation ends a number."""
        cores = [w.rstrip(_MARKS) or w for w in words]
        starts = [i for i, w in enumerate(cores) if w in STARTS]
        if not starts:
            return cores, []
        grammar = Grammar(cores, lambda w: w == "%" or self.noun(w), {i for i, c in enumerate(cores) if c != words[i]}, self.below)
        done, out = 0, []
        for i in starts:
            if i >= done and (p := grammar.longest(i)) is not None:
                done = p.end
                if p.value >= self.least:
                    out.append((i, p))
        return cores, out

    def digits(self, text: str) -> str:
        """`words` on a text."""
        words = text.split()
        cores, found = self.numbers(words)
        out, done = [], 0
        for at, p in found:
            out += words[done:at]
            tail = words[p.end - 1][len(cores[p.end - 1]) :]
            new = [str(p.value), *(cores[p.noun : p.noun + p.width] if p.width else [])]
            new[-1] += tail
            out += new
            done = p.end
        return " ".join(out + words[done:])

    def words(self, items: list[Said]) -> list[Said]:
        """Numbers of `least` or more become digits; a noun phrase within one comes behind it, in its last time. Punctuation at the end of a word
        stays."""
        cores, found = self.numbers([x.word for x in items])
        out: list[Said] = []
        done = 0
        for i, p in found:
            out += items[done:i]
            done, last = p.end, items[p.end - 1].end
            phrase = items[p.noun : p.noun + p.width] if p.width else []
            cut = last - sum(x.end - x.start for x in phrase)
            tail = items[done - 1].word[len(cores[done - 1]) :]
            out.append(Said(f"{p.value}{'' if phrase else tail}", items[i].start, cut))
            for k, x in enumerate(phrase):
                then = last if k == len(phrase) - 1 else cut + x.end - x.start
                out.append(replace(x, word=cores[p.noun + k] + (tail if k == len(phrase) - 1 else ""), start=cut, end=then))
                cut = then
        return out + items[done:]

    def replaced(self, items: list[Said], table: dict[tuple[str, ...], list[str]], firsts: frozenset[str]) -> list[Said]:
        """Of the n-grams at a place the longest that the table has; its time is shared evenly. firsts: words that n-grams begin with."""
        out, i = [], 0
        low = [x.word.lower() for x in items]
        for at, n, new in found_ngrams(low, table, [k for k, w in enumerate(low) if w in firsts]):
            step = (items[at + n - 1].end - items[at].start) / len(new)
            out += items[i:at] + [Said(w, items[at].start + k * step, items[at].start + (k + 1) * step, items[at].conf) for k, w in enumerate(new)]
            i = at + n
        return out + items[i:]

    def post_processed(self, items: list[Said], normalize: bool = False, keep_fillers: bool = True) -> list[Said]:
        if not keep_fillers:
            items = [x for x in items if x.word.lower() not in FILLERS]
        out: list[Said] = []
        for x in self.replaced(items, *self.ngrams):
            if x.word in ("se", "mañ") and out and self.noun(out[-1].word):
                out[-1] = Said(f"{out[-1].word}-{x.word}", out[-1].start, x.end, x.conf)
            else:
                out.append(x)
        return self.words(self.replaced(out, *self.units)) if normalize else out

    def text(self, f, s: str) -> str:
        return " ".join(x.word for x in f([Said(w) for w in s.split()]))


_WORDS = pa.list_(pa.field("element", pa.struct([("word", pa.string()), ("start", pa.float64()), ("end", pa.float64()), ("conf", pa.float64())])))


def _on_words(f):
    """A function of timecoded words; of a batch only some rows at a time are Python's objects, made column by column."""

    def some(rows: pa.Array) -> pa.Array:
        flat = rows.flatten()
        said = [Said(*x) for x in zip(*[c.to_pylist() for c in flat.flatten()], strict=True)]
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        ends, valid = np.cumsum(sizes).tolist(), rows.is_valid().to_pylist()
        made = [f(said[end - n : end]) if v else [] for end, n, v in zip(ends, sizes.tolist(), valid, strict=True)]
        every = [x for m in made for x in m]
        columns = [pa.array([x.word for x in every], pa.string()), *[pa.array([getattr(x, name) for x in every], pa.float64()) for name in ("start", "end", "conf")]]
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(m) for m in made])]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, fields=list(_WORDS.value_type)), type=_WORDS, mask=pa.array([not v for v in valid]))

    @F.arrow_udf(f"array<{WORD}>")
    def g(rows: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        return joined([some(rows.slice(a, b - a)) for a, b in slices(sizes, 1 << 15)], _WORDS)

    return g


def digits(c: Column, lexicon: Lexicon, least: int = 5) -> Column:
    return text_udf(Inverse(lexicon, least).digits)(c)


def digits_timecoded(words: Column, lexicon: Lexicon, least: int = 5) -> Column:
    return _on_words(Inverse(lexicon, least).words)(words)


def post_processed(c: Column, lexicon: Lexicon, **options) -> Column:
    i = Inverse(lexicon)
    return text_udf(lambda s: i.text(lambda x: i.post_processed(x, **options), s))(c)


def post_processed_timecoded(words: Column, lexicon: Lexicon, **options) -> Column:
    i = Inverse(lexicon)
    return _on_words(lambda x: i.post_processed(x, **options))(words)


def found_ngrams(words: list[str], table: dict[tuple[str, ...], list[str]], places: list[int] | None = None) -> Iterator[tuple[int, int, list[str]]]:
    """(place, n, substitute) of what is replaced, from left to right. places: where an n-gram of the table may begin, if that is known."""
    done = 0
    for i in range(len(words)) if places is None else places:
        if i < done:
            continue
        for n in (3, 2, 1):
            new = table.get(tuple(words[i : i + n])) if i + n <= len(words) else None
            if new:
                yield i, n, new
                done = i + n
                break


def substituted(words: Column, table: dict[tuple[str, ...], list[str]]) -> Column:
    """Greedy n-gram substitution on an array of words. A fold over the array would copy what it has made at each word, so whole
    batches go through Arrow: all words of a batch are looked up at once, and only places where an n-gram may begin are visited."""
    first = pa.array(sorted({k[0] for k in table}), pa.string())

    @F.pandas_udf("array<string>")
    def f(rows: pd.Series) -> pd.Series:
        lists = pa.array(rows, pa.list_(pa.string()))
        hits = pc.is_in(pc.utf8_lower(lists.values), value_set=first).to_numpy(zero_copy_only=False).nonzero()[0]
        offsets = lists.offsets.to_numpy()
        cuts = hits.searchsorted(offsets)
        out = []
        for r, a, lo, hi in zip(rows, offsets, cuts, cuts[1:], strict=False):
            if r is None or lo == hi:
                out.append(r)
                continue
            old, new, i = list(r), [], 0
            for at, n, put in found_ngrams([w.lower() if w is not None else "" for w in old], table, (hits[lo:hi] - a).tolist()):
                new += old[i:at] + put
                i = at + n
            out.append(new + old[i:])
        return pd.Series(out, dtype=object)

    return f(words)

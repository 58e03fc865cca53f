"""Edit distances in numpy: of a word and many, and the cheapest alignment of two lists of words in little memory."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Sequence
from math import isqrt

import numpy as np

#: What inserting or deleting a word costs; divisible by all lengths up to 16, so that error rates of such words are exact.
UNIT = 720_720
#: Words compared at a time; numbers that remembered costs may hold.
CHUNK, REMEMBERED = 2048, 4_000_000


def _letters(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters, padded with zeros; lengths)."""
    n = np.array([len(w) for w in words], np.int64)
    out = np.zeros((len(words), int(n.max(initial=0))), np.uint32)
    for i, w in enumerate(words):
        out[i, : n[i]] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, n


def distances(word: str, others: Sequence[str]) -> np.ndarray:
    """The edit distance of a word to each of the others, which take a row of the distance table each."""
    out = np.zeros(len(others), np.int64)
    order = sorted(range(len(others)), key=lambda i: len(others[i]))  # words of like lengths together: little padding
    mine = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(order), CHUNK):
        part = order[at : at + CHUNK]
        letters, n = _letters([others[i] for i in part])
        place = np.arange(letters.shape[1] + 1)
        rows = np.tile(place, (len(part), 1))
        for i, c in enumerate(mine, 1):
            new = np.empty_like(rows)
            new[:, 0] = i
            new[:, 1:] = np.minimum(rows[:, :-1] + (letters != c), rows[:, 1:] + 1)
            rows = np.minimum.accumulate(new - place, axis=1) + place
        out[part] = rows[np.arange(len(part)), n]
    return out


class Costs:
    """What replacing a word of one list by each word of the other costs: their edit distance over the first one's length. Each pair of
    different words is compared once, as long as the costs of its row are remembered."""

    def __init__(self, b: Sequence[str]) -> None:
        self.words = sorted(set(b))
        number = {w: i for i, w in enumerate(self.words)}
        self.at = np.array([number[w] for w in b], np.int64)
        self.known: OrderedDict[str, np.ndarray] = OrderedDict()

    def of(self, word: str) -> np.ndarray:
        found = self.known.get(word)
        if found is None:
            found = distances(word, self.words) * UNIT // max(1, len(word))
            self.known[word] = found
            if len(self.known) * len(self.words) > REMEMBERED and len(self.known) > 1:
                self.known.popitem(last=False)
        else:
            self.known.move_to_end(word)
        return found[self.at]


def aligned_words(a: Sequence[str], b: Sequence[str]) -> list[tuple[str | None, str | None]]:
    """Pairs of words, None where one side has none, of the least cost: a replaced word costs its character error rate, a missing or added one 1.
    Of equal costs, seen from the end, replacing comes before leaving out and that before adding. Of the cost table every r-th row is
    kept (r about the root of the number of rows), and the rows between two of them are made again when the path comes there."""
    n, m = len(a), len(b)
    costs, place = Costs(b), np.arange(m + 1, dtype=np.int64) * UNIT

    def following(row: np.ndarray, word: str) -> np.ndarray:
        new = row + UNIT
        if m:
            new[1:] = np.minimum(new[1:], row[:-1] + costs.of(word))
        return np.minimum.accumulate(new - place) + place

    step = isqrt(n) + 1
    kept, row = [place], place
    for i in range(n):
        row = following(row, a[i])
        if (i + 1) % step == 0:
            kept.append(row)
    out: list[tuple[str | None, str | None]] = []
    i, j = n, m
    for first in range((len(kept) - 1) * step, -1, -step):
        rows = [kept[first // step]]
        for k in range(first, min(first + step, n)):
            rows.append(following(rows[-1], a[k]))
        while i > first or (first == 0 and j):
            here = rows[i - first]
            above = rows[i - first - 1] if i > first else None
            if above is not None and j and here[j] == above[j - 1] + costs.of(a[i - 1])[j - 1]:
                i, j = i - 1, j - 1
                out.append((a[i], b[j]))
            elif above is not None and here[j] == above[j] + UNIT:
                i -= 1
                out.append((a[i], None))
            else:
                j -= 1
                out.append((None, b[j]))
    return out[::-1]

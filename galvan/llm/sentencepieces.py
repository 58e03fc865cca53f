"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

A text's spaces become U+2581 and it is cut where a space follows another character, as no piece spans such a place. Different
words of equal length advance together: at each end, hashes of all substrings (prefix hashes, so one multiplication each)
probe the sorted keys of the pieces, and a vectorised maximum stores score and backpointer. Words of over LONG characters (scripts
without spaces, encoded data) probe all of their substrings of a length at once. They are cut where no piece that was found spans a place,
which changes no best path; the parts advance together with other words. What is still long advances by itself, a vectorised maximum over
the lengths of pieces at each end. Of equal scores the longest last piece wins. Characters that no piece covers cost `UNKNOWN` below
the lowest score and become byte pieces; U+2581 itself does too, so decoding gives back every text exactly. Nothing is normalised and
no prefix is added.

Scores: a unigram model's own log-probabilities. A BPE model only ranks its pieces; their log-probabilities then follow
Zipf's law, -log(rank + 1).

Defined results: a null text is empty and has no ids; a null doc_id is a row like others; repeated doc_ids and repeated rows give a row
each; texts of any length are taken whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, mixed, of_worker, table

UNKNOWN = 10.0
LONG = 128
#: Ends of pieces in one long word that are prepared at a time.
ENDS = 1 << 16
#: Words whose ids a worker remembers.
REMEMBERED = 300_000
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_CUT = re.compile(r" *[^ ]+| +")
#: Stands for U+2581 in a text; no text from Arrow can hold it.
_STAND_IN = "\ud800"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load(path: str) -> dict:
    """Pieces, scores and byte pieces of a model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    scores = [sp.get_score(i) for i in range(n)]
    normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    if all(scores[i] == int(scores[i]) for i in normal):  # ranks
        scores = {i: -math.log(1 - scores[i] + 1) for i in normal}
    of_byte = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
    return {"pieces": {pieces[i]: i for i in normal}, "scores": {i: float(scores[i]) for i in normal}, "of_byte": [of_byte[b] for b in range(256)], "size": n}


def gather(flat: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[offsets[i]:offsets[i+1]] for all i of `at`, one after another, and their lengths."""
    n = offsets[at + 1] - offsets[at]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(offsets[at] - ends + n, n)], n


class Codec:
    def __init__(self, model: dict) -> None:
        pieces, self.scores, self.of_byte = model["pieces"], model["scores"], model["of_byte"]
        self.ids = {p.replace("▁", " "): i for p, i in pieces.items()}
        self.longest = max(map(len, self.ids))
        self.unknown = min(self.scores.values()) - UNKNOWN
        hashes = np.array([self._hash(p) for p in self.ids], _U)
        order = np.argsort(hashes)
        self.keys = hashes[order]
        assert len(np.unique(self.keys)) == len(self.keys)
        self.key_ids = np.fromiter(self.ids.values(), np.int64)[order]
        self.key_scores = np.array([self.scores[i] for i in self.key_ids])
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.keys & _U((1 << 20) - 1)).astype(np.int64)] = True
        texts = [b""] * model["size"]
        for p, i in self.ids.items():
            texts[i] = p.encode()
        for b, i in enumerate(self.of_byte):
            texts[i] = bytes([b])
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.byte_offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        self.rows: dict[str, int] = {}
        self.flat, self.ends = array("i"), array("q", [0])

    @staticmethod
    def _hash(p: str) -> int:
        h = 0
        for c in p:
            h = (h * int(_P) + ord(c) + 1) & (2**64 - 1)
        return int(mixed(np.array([h ^ len(p) << 56 & 2**64 - 1], _U))[0])

    def spelled(self, c: str) -> list[int]:
        return [self.of_byte[b] for b in ("▁" if c == _STAND_IN else c).encode()]

    def probed(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of hashes that pieces have, the pieces' rows)."""
        at = np.flatnonzero(self.filter[(h & _U((1 << 20) - 1)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hit = self.keys[k] == h[at]
        return at[hit], k[hit]

    def found_in(self, word: str) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(length, starts, pieces' rows) of all pieces in a word, longest first."""
        chars = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U) + _U(1)
        h, out = np.zeros(len(word), _U), []
        for m in range(1, min(self.longest, len(word)) + 1):
            h = h[: len(word) - m + 1] * _P + chars[m - 1 :]
            at, k = self.probed(mixed(h ^ _U(m << 56)))
            if len(at):
                out.append((m, at, k))
        return out[::-1]

    def parts(self, word: str) -> list[tuple[str, list]]:
        """A long word cut where no piece spans a place: (part, its pieces as in `found_in`)."""
        pieces, spans = self.found_in(word), np.zeros(len(word) + 1, np.int64)
        for m, at, _ in pieces:
            if m > 1:
                spans[at + 1] += 1
                spans[at + m] -= 1
        cuts = [0, *np.flatnonzero(np.cumsum(spans)[1:-1] == 0).tolist(), len(word)]
        cuts[1:-1] = [c + 1 for c in cuts[1:-1]]
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = []
            if b - a > LONG:
                for m, at, k in pieces:
                    i, j = np.searchsorted(at, [a, b])
                    own.append((m, at[i:j] - a, k[i:j]))
            out.append((word[a:b], own))
        return out

    def alone(self, word: str, pieces: list) -> list[int]:
        """The search in one long word: at each end a maximum over the lengths of the pieces that end there."""
        n = len(word)
        lengths = np.array([m for m, _, _ in pieces] + [1])
        best, length, piece = np.full(n + 1, -np.inf), np.zeros(n + 1, np.int32), np.full(n + 1, -1, np.int32)
        best[0] = 0
        for lo in range(1, n + 1, ENDS):
            hi = min(lo + ENDS, n + 1)
            score, ids = np.full((hi - lo, len(lengths)), -np.inf), np.full((hi - lo, len(lengths)), -1, np.int32)
            score[:, -1] = self.unknown
            for r, (m, at, k) in enumerate(pieces):
                i, j = np.searchsorted(at, [lo - m, hi - m])
                score[at[i:j] + m - lo, r], ids[at[i:j] + m - lo, r] = self.key_scores[k[i:j]], self.key_ids[k[i:j]]
            for j in range(lo, hi):
                x = best[np.maximum(j - lengths, 0)] + score[j - lo]
                c = int(x.argmax())
                best[j], length[j], piece[j] = x[c], lengths[c], ids[j - lo, c]
        out, j = [], n
        while j:
            out.append([int(piece[j])] if piece[j] >= 0 else self.spelled(word[j - 1]))
            j -= int(length[j])
        return [i for x in reversed(out) for i in x]

    def together(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words of one length in another order, their ids one after another, and how many each has."""
        n, length = len(words), len(words[0])
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, length).T.astype(_U) + _U(1)
        prefix = np.zeros((length + 1, n), _U)
        for j in range(length):
            prefix[j + 1] = prefix[j] * _P + chars[j]
        powers = [_U(pow(int(_P), k, 2**64)) for k in range(self.longest + 1)]
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        back, piece = np.zeros((length + 1, n), np.int64), np.full((length + 1, n), -1)
        for j in range(1, length + 1):
            for m in range(min(self.longest, j), 0, -1):
                h = mixed((prefix[j] - prefix[j - m] * powers[m]) ^ _U(m << 56))
                at, k = self.probed(h)
                if len(at):
                    x = best[j - m, at] + self.key_scores[k]
                    better = x > best[j, at]
                    at, k = at[better], k[better]
                    best[j, at], back[j, at], piece[j, at] = x[better], m, self.key_ids[k]
            lost = np.flatnonzero(best[j - 1] + self.unknown > best[j])
            best[j, lost], back[j, lost], piece[j, lost] = best[j - 1, lost] + self.unknown, 1, -1
        rows, step = np.full((length, n), -2), np.full(n, length)
        everyone = np.arange(n)
        while (step > 0).any():
            on = everyone[step > 0]
            rows[step[on] - 1, on] = piece[step[on], on]
            step[on] -= back[step[on], on]
        rows = rows.T
        odd = (rows == -1).any(1)
        plain = rows[~odd]
        used = plain >= 0
        spelled = [[i for c, x in zip(words[k], rows[k].tolist(), strict=True) if x != -2 for i in ([x] if x >= 0 else self.spelled(c))] for k in np.flatnonzero(odd).tolist()]
        order = [words[k] for k in np.flatnonzero(~odd).tolist()] + [words[k] for k in np.flatnonzero(odd).tolist()]
        return order, np.concatenate([plain[used], *spelled]).astype(np.int32), np.concatenate([used.sum(1), [len(x) for x in spelled]]).astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the texts' offsets."""
        lists = [_CUT.findall(t.replace("▁", _STAND_IN)) if "▁" in t else _CUT.findall(t) for t in texts]
        by_length: dict[int, list[str]] = {}
        single: dict[str, list] = {}
        new = set(chain.from_iterable(lists)).difference(self.rows)
        cut = {w: self.parts(w) for w in new if len(w) > LONG}
        for w, own in chain.from_iterable(cut.values()):
            if len(w) > LONG:
                single[w] = own
        short = {w for w in new if len(w) <= LONG} | {w for w, _ in chain.from_iterable(cut.values()) if len(w) <= LONG and w not in self.rows}
        for w in short:
            by_length.setdefault(len(w), []).append(w)
        kept, full = len(self.ends) - 1, len(self.rows) >= REMEMBERED
        for words in by_length.values():
            for k in range(0, len(words), 20_000):
                self._keep(*self.together(words[k : k + 20_000]))
        n_short = len(self.ends) - 1
        if single:
            found = [self.alone(w, own) for w, own in single.items()]
            self._keep(list(single), np.concatenate(found).astype(np.int32), np.array([len(x) for x in found], np.int64))
        # a long word's ids are those of its parts
        lists = [[p for w in x for p in ([q for q, _ in cut[w]] if len(w) > LONG and w in cut else (w,))] for x in lists] if cut else lists
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        at = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(lists)), np.int64, int(n.sum()))
        ids, each = gather(np.array(self.flat, np.int32), np.array(self.ends, np.int64), at)
        # once full, what is new is kept for these texts only; long parts always are, as they hardly come again
        for w in chain(chain.from_iterable(by_length.values()), single) if full else single:
            del self.rows[w]
        last = kept if full else n_short
        del self.flat[self.ends[last] :], self.ends[last + 1 :]
        of_word = np.concatenate([[0], np.cumsum(each)]).astype(np.int64)
        return ids, of_word[np.concatenate([[0], np.cumsum(n)])]

    def _keep(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.rows |= zip(words, range(len(self.ends) - 1, len(self.ends) - 1 + len(words)), strict=True)
        self.ends.frombytes((len(self.flat) + np.cumsum(counts)).astype(np.int64).tobytes())
        self.flat.frombytes(ids.tobytes())

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 text of ids."""
        return gather(self.bytes, self.byte_offsets, ids.astype(np.int64))[0].tobytes()


def _coder(model, path: str, digest: bool):
    def make():
        codec = of_worker(("codec", path), lambda: Codec(model.value))

        def f(texts, batch):
            ids, offsets = codec.encode(texts)
            each = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            out = {"doc_id": batch.column("doc_id"), "n_tokens": np.diff(offsets)}
            if not digest:
                return out | {"ids": each}
            same = [codec.decode(x) == t.encode() for x, t in zip(each, texts, strict=True)]
            return out | {"ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in each], "decoded_equal": same}

        return f

    return make


def encoded(docs: DataFrame, path: str | None = None, digest: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids; or instead of the ids their checksum and whether they decode to the text."""
    path = path or default_model()
    model = docs.sparkSession.sparkContext.broadcast(load(path))
    return map_texts(docs.select(F.col("doc_id").cast("bigint"), "text"), _coder(model, path, digest), "doc_id bigint, n_tokens bigint, " + ("ids_crc32 bigint, decoded_equal boolean" if digest else "ids array<int>"))


def decoded(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids. Null ids are an empty text."""
    import pyarrow as pa

    path = path or default_model()
    model = tokens.sparkSession.sparkContext.broadcast(load(path))

    def run(batches):
        codec = of_worker(("codec", path), lambda: Codec(model.value))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([codec.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("bigint"), "ids").mapInArrow(run, "doc_id bigint, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), digest=True)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document."""
    return encoded(docs)

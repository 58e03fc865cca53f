"""Benchmark decontamination by SimHash over item-sized windows.

Words are runs of letters, digits and underscores in lower case; shingles have five words and weigh as often as they
occur. Every window of a document that is as long as an item gets a 64-bit SimHash fingerprint over its weighted shingles:
running sums of the 64 votes give the votes of any window as one difference. Fingerprints, and nothing else, make
candidates. They are looked up in a multi-index of the items of that length: four blocks of sixteen bits, each with all values
within three bits of an item's block. If all four blocks differed in four bits or more, the distance would be 16 or more, so
every item within RADIUS = 15 is found. Candidates are then verified by exact weighted Jaccard similarity (0.8 or more).

Fingerprints of similar windows are near, not always within the radius; `tests/llm` measures the recall against brute force
over all windows. Window lengths above FINE are taken in steps of an eighth of the power of two below (an item's beginning is then looked
for in windows that are up to an eighth shorter), so that there are few lengths whatever the items; verification is at the item's own length.

Items are taken in blocks of bounded size, each a set of queries against all documents. With several blocks, the
matches of one are written to the shared folder and its broadcast is destroyed before the next begins.

Defined results: null and empty texts are clean; items of fewer than five words have no five-word shingle and match
nothing; a document that is shorter than an item is one window; of equally similar windows the first counts; repeated items count each by
its id; a null doc_id is a row like others; repeated doc_ids and repeated rows give a row each; texts of any length are taken whole;
no documents give no rows, no items no contamination; other columns are ignored.
"""

from __future__ import annotations

import uuid
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, content_key, fresh, hashed_words, map_texts, of_worker, packed, shared_dir, shingles, table
from .near_dedup import THRESHOLD, WORDS, words_of

RADIUS = 15
#: Blocks of the multi-index and bits of each.
BLOCKS, WIDTH = 4, 16
#: Window lengths up to which each length is taken by itself.
FINE = 16
#: Window starts whose votes are summed at a time (the sums then stay in the processor's cache) and looked up at a time.
STARTS, LOOKED_UP = 1024, 1 << 15
#: Items whose index is sent to the workers at a time, and characters of their texts.
ITEMS_AT_ONCE, CHARS_AT_ONCE = 4096, 16 << 20
_U = np.uint64


def window_length(m: int) -> int:
    """The length of the windows that items of m shingles are looked for in."""
    step = 1 << max(0, m.bit_length() - FINE.bit_length() + 1)
    return m if m <= FINE else m // step * step


def running_votes(s: np.ndarray, longest: int) -> np.ndarray:
    """Of each bit, how many shingles before a place have it; modulo a power of two that no window's length reaches."""
    bits = np.unpackbits(s.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    kind = np.uint8 if longest < 1 << 8 else np.uint16 if longest < 1 << 16 else np.uint32
    sums = np.zeros((len(s) + 1, 64), kind)
    np.cumsum(bits, axis=0, dtype=kind, out=sums[1:])
    return sums


def fingerprints(ones: np.ndarray, m: int) -> np.ndarray:
    """SimHash of multisets of m shingles, from how many have each bit: the bits that more than half have."""
    return np.packbits(ones > m // 2, axis=None, bitorder="little").view(_U)


def simhash(s: np.ndarray) -> int:
    """Fingerprint of a multiset of shingles."""
    return int(fingerprints(running_votes(s, len(s))[-1:], len(s))[0])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets."""
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    low = int(np.minimum(nx[i], ny[j]).sum())
    return low / (len(a) + len(b) - low)


def _flips() -> np.ndarray:
    """All 16-bit values with at most RADIUS // BLOCKS bits."""
    v = np.arange(1 << WIDTH, dtype=np.uint32)
    return v[np.bitwise_count(v) <= RADIUS // BLOCKS].astype(np.uint16)


class Lookup:
    """The multi-index of up to 64 items of one window length: of each block's value, which items are near it, as a bit each."""

    def __init__(self, items: np.ndarray, prints: np.ndarray, flips: np.ndarray) -> None:
        self.items, self.prints = items, prints
        self.near = np.zeros((BLOCKS, 1 << WIDTH), np.uint8 if len(items) <= 8 else np.uint16 if len(items) <= 16 else _U)
        for i, p in enumerate(prints.view(np.uint16).reshape(-1, BLOCKS)):
            for b in range(BLOCKS):
                self.near[b, p[b] ^ flips] |= self.near.dtype.type(1 << i)

    def within(self, prints: np.ndarray):
        """(rows of `prints`, item) of all that are within the radius."""
        blocks = prints.view(np.uint16).reshape(-1, BLOCKS)
        any_near = self.near[0].take(blocks[:, 0], mode="clip")
        for b in range(1, BLOCKS):
            any_near |= self.near[b].take(blocks[:, b], mode="clip")
        rows = np.flatnonzero(any_near != 0)
        found, prints = any_near[rows], prints[rows]
        for i, item in enumerate(self.items.tolist()):
            at = np.flatnonzero((found & found.dtype.type(1 << i)) != 0)
            at = at[np.bitwise_count(prints[at] ^ self.prints[i]) <= RADIUS]
            if len(at):
                yield rows[at], item


class Index:
    """The items' shingles and fingerprints, and a multi-index for each window length."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        kept = [(i, w) for i, t in items if len(w := words_of(t or "")) >= WORDS]
        self.ids = [i for i, _ in kept]
        h, offsets = hashed_words([w for _, w in kept], WordHashes())
        s, of = shingles(h, offsets, WORDS)
        self.shingles = [s[of == i] for i in range(len(kept))]
        self.sorted = [np.unique(x) for x in self.shingles]
        self.sizes = np.array([len(w) - WORDS + 1 for _, w in kept], np.int64)
        prints, flips = np.array([simhash(x) for x in self.shingles], _U), _flips()
        lengths = np.array([window_length(int(m)) for m in self.sizes], np.int64)
        # a shorter beginning of a long item is what its windows are compared with
        begun = np.array([p if m == n else simhash(x[:n]) for p, m, n, x in zip(prints, self.sizes, lengths, self.shingles, strict=True)], _U)
        lookups = lambda at, x: [Lookup(at[i : i + 64], x[at[i : i + 64]], flips) for i in range(0, len(at), 64)]
        self.by_length = {int(n): lookups(np.flatnonzero(lengths == n), begun) for n in np.unique(lengths)}
        # whole texts that are shorter than an item are compared with all of it
        self.longest = int(self.sizes.max()) if kept else 0
        self.of_whole = lookups(np.arange(len(kept)), prints)

    def candidates(self, s: np.ndarray, doc: np.ndarray, threshold: float):
        """(first shingles, item) of all windows of the documents whose fingerprint is near an item's. s: shingles of documents, one
        after another; doc: their documents."""
        shortest = min(self.by_length)
        step = max(STARTS, 4 * self.longest)
        for lo in range(0, len(s), LOOKED_UP):
            upto = min(lo + LOOKED_UP, len(s))
            prints = {m: np.zeros(max(0, min(upto, len(s) - m + 1) - lo), _U) for m in self.by_length}
            for a in range(lo, upto, step):
                sums = running_votes(s[a : min(a + step, upto) + self.longest], self.longest)
                for m, found in prints.items():
                    k = min(step, len(found) - (a - lo))
                    if k > 0:
                        found[a - lo : a - lo + k] = fingerprints(sums[m : m + k] - sums[:k], m)
            for m, found in prints.items():
                for lookup in self.by_length[m]:
                    for row, item in lookup.within(found):
                        row += lo
                        yield row[doc[row] == doc[row + m - 1]], item
        ids, begin, n = np.unique(doc, return_index=True, return_counts=True)
        small = np.flatnonzero((n < self.longest) & (n >= threshold * shortest))
        if len(small):
            whole = np.array([simhash(s[begin[i] : begin[i] + n[i]]) for i in small.tolist()], _U)
            for lookup in self.of_whole:
                for row, item in lookup.within(whole):
                    own = n[small[row]]
                    yield begin[small[row]][(own < self.sizes[item]) & (own >= threshold * self.sizes[item])], item

    def matches(self, s: np.ndarray, doc: np.ndarray, threshold: float) -> dict[tuple[int, int], tuple[float, int]]:
        """(document, item) -> (best similarity, shingle of the document where the first such window starts)."""
        best: dict[tuple[int, int], tuple[float, int]] = {}
        seen = set()
        for starts, item in self.candidates(s, doc, threshold):
            own, m, d = self.sorted[item], int(self.sizes[item]), doc[starts]
            begin, end = np.searchsorted(doc, d, "left"), np.searchsorted(doc, d, "right")
            at = np.minimum(starts, np.maximum(begin, end - m))  # the item is longer than the looked-up window at most
            n = np.minimum(m, end - at)
            # how many shingles the item has bounds the similarity
            place = np.arange(m)
            window = s[np.minimum(at[:, None] + place, len(s) - 1)]
            has = (own[np.minimum(np.searchsorted(own, window), len(own) - 1)] == window) & (place < n[:, None])
            for k in np.flatnonzero(has.sum(1) * (1 + threshold) >= threshold * (m + n) - 1e-9).tolist():
                if (int(at[k]), item) in seen:
                    continue
                seen.add((int(at[k]), item))
                x = similarity(window[k, : n[k]], self.shingles[item])
                key, first = (int(d[k]), item), int(at[k] - begin[k])
                had = best.get(key, (0.0, 0))
                if x >= threshold and (x > had[0] or (x == had[0] and first < had[1])):
                    best[key] = x, first
        return best


FOUND = "doc_id bigint, row bigint, item_ids array<bigint>, starts array<bigint>, similarities array<double>"


def _scan(index, threshold: float):
    def make():
        cache = of_worker("words", WordHashes)
        it = Index.__new__(Index)
        it.__dict__.update(index.value)

        def f(texts, batch):
            s, doc = shingles(*hashed_words([words_of(t) for t in texts], cache), WORDS)
            items, starts, sims = [[] for _ in texts], [[] for _ in texts], [[] for _ in texts]
            if it.ids and len(s):
                for (d, item), (x, start) in sorted(it.matches(s, doc, threshold).items()):
                    items[d].append(it.ids[item])
                    starts[d].append(start)
                    sims[d].append(x)
            return {"doc_id": batch.column("doc_id"), "row": batch.column("row"), "item_ids": items, "starts": starts, "similarities": sims}

        return f

    return make


def item_blocks(items: DataFrame, rows: int, chars: int):
    """The items in blocks of bounded size, read one block at a time in the order of their ids."""
    block: list[tuple[int, str]] = []
    size = 0
    for r in items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).orderBy("item_id").toLocalIterator():
        if block and (len(block) == rows or size + len(r.text) > chars):
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += len(r.text)
    if block:
        yield block


def scan(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, rows: int = ITEMS_AT_ONCE) -> DataFrame:
    """One row a document: contaminated, item_ids and, in their order, where the best window starts and its similarity."""
    docs = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("doc_id", "text").alias("row"))
    sc = docs.sparkSession.sparkContext
    lists = {"item_ids": "array<bigint>", "starts": "array<bigint>", "similarities": "array<double>"}
    blocks = item_blocks(items, rows, CHARS_AT_ONCE)
    first, second = next(blocks, None), next(blocks, None)
    scanned = lambda index: map_texts(docs, _scan(index, threshold), FOUND)
    if first is None:
        out = docs.select("doc_id", *[F.array().cast(t).alias(c) for c, t in lists.items()])
    elif second is None:
        out = scanned(sc.broadcast(Index(first).__dict__))
    else:
        # of each block only rows with matches, few and short, are kept
        path = f"{shared_dir(docs.sparkSession)}/galvan-matches-{uuid.uuid4().hex}"
        for block in chain((first, second), blocks):
            index = sc.broadcast(Index(block).__dict__)
            scanned(index).filter("size(item_ids) > 0").dropDuplicates(["row"]).write.mode("append").parquet(path)
            index.destroy()
        found = docs.sparkSession.read.schema(FOUND).parquet(path)
        found = found.groupBy("row").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in lists])
        out = docs.join(found, "row", "left").select("doc_id", *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in lists.items()])
    out = out.select("doc_id", *lists)
    return out.withColumn("contaminated", F.size("item_ids") > 0).withColumn("similarity", F.coalesce(F.array_max("similarities"), F.lit(0.0)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "contaminated", "item_ids", "similarity")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a window of any item, with their columns, whether or not they have a doc_id."""
    (key,) = fresh(docs, "key")
    keyed = docs.withColumn(key, content_key(docs, "doc_id", "text"))
    found = scan(keyed.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).filter("contaminated").select(F.col("doc_id").alias(key)).distinct()
    return packed(keyed.join(found, key, "left_anti").select(*docs.columns), docs.count(), 8_000)

"""Removal of repeated substrings by a logarithmic family of sparse suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a document of smaller doc_id, or earlier in the same
document. Strings are judged on the input and never cross documents.

Sparse suffixes: of each LENGTH-byte window the K-gram with the smallest fingerprint is an anchor. Equal windows have equal anchors at
equal places, so comparing anchors loses no match. An anchor's context is all that windows around it can hold, LENGTH - K bytes before
it and LENGTH from it on. A suffix array has a batch's anchors in the order of the bytes of their first K-gram, then of a fingerprint of the context; it is a
table of buckets (by K-gram) in the shared folder. `Index.add` takes a batch of documents behind all that it has: the batch's arrays are
merge-scanned against those of the levels, one pass over sorted entries in each bucket. A context that a level or the batch's
earlier part holds makes all windows around the anchor repeats. What is new becomes a level, and levels of equal size merge before the
next batch, so there are logarithmically many and each entry moves logarithmically often. `dedup` feeds a table in BATCHES ranges of doc_id.

What shares the K-gram alone may still share a window. For these anchors the contexts are fetched and dealt twice: by the K-gram and half of
what a window has behind it, for windows that begin near the anchor, and by the K-gram and as much before it, for the others, so that
a K-gram with very many surroundings is many groups there. Every window is compared, by 64-bit fingerprints of its bytes (as contexts are;
K-grams are compared by bytes).

Copies are aggregated before the shuffle: a task sends one anchor for each different context, and marks the others itself.

Defined results: a null text is empty; a text of under LENGTH bytes loses nothing; rows that repeat a doc_id and text get the same
result each and are no repeats of each other; rows with one doc_id and different texts come one after another, by the hash of their texts; a null doc_id comes
first; an empty table gives no rows; texts of any length are taken whole; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, table, written
from .common import mixed as mix

LENGTH, K = 100, 32
SIDE = LENGTH - K
#: Anchors of a bucket, bytes of text in a document bucket, anchors that a task gathers before it sends them.
BUCKET, DOC_BYTES, FLUSH = 400_000, 12 << 20, 400_000
#: Batches that a table is fed in.
BATCHES = 3
#: Bytes beside the K-gram that anchors share if they share a window.
HALF = SIDE // 2
_U = np.uint64
_P, _Q = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_NULL = -(1 << 63)
PIECE = "key int, kind int, payload binary"
DOC = "key int, doc_id bigint, sub int, text binary"


class Powers:
    """Powers of the inverse of an odd number modulo 2^64, as many as are asked for."""

    def __init__(self, p: int) -> None:
        self.p, self.inverse = p, pow(p, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = (np.multiply.accumulate(np.concatenate([[_U(1)], np.full(n, _U(x), _U)])) for x in (self.p, self.inverse))


_BYTES = mix(np.arange(1, 257).astype(_U) * _U(_P))


class Prints:
    """Fingerprints of substrings of some bytes, by prefix sums of b[i] p^i."""

    def __init__(self, raw: np.ndarray, powers: Powers) -> None:
        powers.grow(len(raw) + 1)
        self.down = powers.down
        self.sums = np.zeros(len(raw) + 1, _U)
        np.cumsum(_BYTES[raw] * powers.up[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def every(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:n]) * self.down[:n]


def _sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over all windows of w."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x = f(x[:-step], x[step:])
        have += step
    return x


def anchors(raw: np.ndarray, p: Powers, q: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, fingerprints of the K-grams, fingerprints of the contexts) in one text."""
    n = len(raw)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U)
    prints = Prints(raw, p)
    h = mix(prints.every(K))
    w = SIDE + 1
    low = _sliding(h, w, np.minimum)
    # the largest minimum of the windows that hold a place is its own value only at anchors
    pad = np.concatenate([np.zeros(w - 1, _U), low, np.zeros(w - 1, _U)])
    at = np.flatnonzero(_sliding(pad, w, np.maximum) == h)
    a, b = np.maximum(at - SIDE, 0), np.minimum(at + LENGTH, n)
    c = mix(Prints(raw, q).of(a, b) ^ (((at - a) * 256 + (b - at)).astype(_U) * _U(_P)))
    return at, h[at], c


def columns(*x: np.ndarray) -> bytes:
    raw = np.int64(len(x[0])).tobytes() + b"".join(np.ascontiguousarray(c).tobytes() for c in x)
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def parsed(payload: bytes, *types) -> list[np.ndarray]:
    raw = pa.decompress(payload[8:], int(np.frombuffer(payload, np.int64, 1)[0]), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    out, at = [], 8
    for t in types:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def joined(payloads: list[bytes], *types) -> list[np.ndarray]:
    parts = [parsed(p, *types) for p in payloads]
    return [np.concatenate([np.zeros(0, t), *[p[i] for p in parts]]).astype(t) for i, t in enumerate(types)]


#: The K-gram as four numbers in the order of its bytes, context, document (doc_id and the hash of its text), place.
ENTRY = (_U, _U, _U, _U, _U, np.int64, np.int32, np.int32)
#: Document, place, how: all windows around it are repeats, its windows must be compared, or it is of an earlier batch and compared with.
MARK = (np.int64, np.int32, np.int32, np.int32)
REPEAT, SHARED, EARLIER = 0, 1, 2
MARKS, LEVEL, SENT = 0, 1, 2


def grams(raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The K-grams at places as columns."""
    wide = np.ascontiguousarray(raw[at[:, None] + np.arange(K)]).view(">u8").astype(_U)
    return [np.ascontiguousarray(wide[:, j]) for j in range(4)]


def home(doc: np.ndarray, sub: np.ndarray, doc_buckets: int) -> np.ndarray:
    """The bucket of documents; the same as in `keyed`."""
    return (doc ^ (sub.astype(np.int64) * 2654435761)) % doc_buckets


def changes(cols: list[np.ndarray]) -> np.ndarray:
    """Whether a row differs from the one before."""
    out = np.zeros(len(cols[0]), bool)
    out[:1] = True
    for c in cols:
        out[1:] |= c[1:] != c[:-1]
    return out


def ordering(keys: list[np.ndarray]) -> np.ndarray:
    """The order of rows by their keys, the first one first. Most are told apart by the first two; only what these leave equal is
    sorted by the others."""
    o = np.lexsort((keys[1], keys[0]))
    new = changes([keys[0][o], keys[1][o]])
    tied = ~(new & np.append(new[1:], True))
    if tied.any():
        rows = o[tied]
        o[tied] = rows[np.lexsort((*[k[rows] for k in keys[:1:-1]], np.cumsum(new)[tied]))]
    return o


def ordered(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Rows in the order of their columns."""
    o = ordering(cols)
    return [c[o] for c in cols]


def once(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of ordered entries: which come first with their K-gram and context, and which repeat an earlier one elsewhere."""
    new = changes(cols[:5])
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    doc, sub, at = cols[5:]
    return new, (doc != doc[first]) | (sub != sub[first]) | (at != at[first])


def dealt(key: np.ndarray, cols: list[np.ndarray]):
    """(key, columns of its rows)."""
    order = np.argsort(key, kind="stable")
    key, cols = key[order], [c[order] for c in cols]
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(key[a]), [c[a:b] for c in cols]


def pieces(rows, kind: int = SENT) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([kind] * len(rows), pa.int32()), pa.array([p for _, p in rows], pa.binary())], names=["key", "kind", "payload"])


def _send(buckets: int, doc_buckets: int):
    """documents -> anchors by bucket; local repeats by document bucket, with negative keys."""

    def run(batches):
        p, q = Powers(_P), Powers(_Q)
        waiting, n = [], 0

        def flush():
            cols = ordered([np.concatenate(x) for x in zip(*(w[1:] for w in waiting), strict=True)])
            new, again = once(cols)
            sent = [c[new] for c in cols]
            yield pieces((k, columns(*x)) for k, x in dealt(bucket_of(sent, buckets), sent))
            doc, sub, at = (c[again] for c in cols[5:])
            yield pieces((-1 - k, columns(*x, np.full(len(x[0]), REPEAT, np.int32))) for k, x in dealt(home(doc, sub, doc_buckets), [doc, sub, at]))

        for batch in batches:
            for doc_id, sub, raw in _texts(batch):
                at, _, c = anchors(raw, p, q)
                if len(at):
                    waiting.append((0, *grams(raw, at), c, np.full(len(at), doc_id), np.full(len(at), sub, np.int32), at.astype(np.int32)))
                    n += len(at)
                if n >= FLUSH:
                    yield from flush()
                    waiting, n = [], 0
        if waiting:
            yield from flush()

    return run


def bucket_of(cols: list[np.ndarray], buckets: int) -> np.ndarray:
    h = np.zeros(len(cols[0]), _U)
    for c in cols[:4]:
        h = mix(h * _U(_P) + c)
    return (h % _U(buckets)).astype(np.int64)


def _match(doc_buckets: int, last: bool):
    """A bucket's anchors of a batch and of the levels -> marks by document bucket, and the batch's part of a new level, unless it is the last."""

    def run(key, t):
        key = key[0].as_py()
        kind, payload = t.column("kind").to_pylist(), t.column("payload").to_pylist()
        if key < 0:  # marks already
            return pa.Table.from_batches([pieces([(-1 - key, columns(*joined(payload, *MARK)))], MARKS)])
        batch = ordered(joined([p for p, k in zip(payload, kind, strict=True) if k == SENT], *ENTRY))
        if not len(batch[0]):
            return pa.Table.from_batches([pieces([])])
        new, again = once(batch)
        marks = [[c[again] for c in batch[5:]] + [np.full(int(again.sum()), REPEAT, np.int32)]]
        batch = [c[new] for c in batch]
        held = joined([p for p, k in zip(payload, kind, strict=True) if k != SENT], *ENTRY)
        # the merge scan: entries of the levels come before the batch's of the same K-gram and context
        own = np.concatenate([np.zeros(len(held[0]), np.int8), np.ones(len(batch[0]), np.int8)])
        both = [np.concatenate([a, b]) for a, b in zip(held, batch, strict=True)]
        if len(held[0]):
            o = ordering([*both[:5], own])
            both, own = [c[o] for c in both], own[o]
        fresh = changes(both[:5])
        repeat = (own == 1) & ~fresh
        marks.append([c[repeat] for c in both[5:]] + [np.full(int(repeat.sum()), REPEAT, np.int32)])
        both, own = [c[~repeat] for c in both], own[~repeat]
        # K-grams of several contexts, one of them new
        begins = np.flatnonzero(changes(both[:4]))
        sizes = np.diff(np.append(begins, len(own)))
        mixed_ = np.repeat((sizes > 1) & (np.add.reduceat(own, begins, dtype=np.int64) > 0), sizes)
        marks.append([c[mixed_] for c in both[5:]] + [np.where(own[mixed_] == 1, SHARED, EARLIER).astype(np.int32)])
        found = [np.concatenate(x) for x in zip(*marks, strict=True)]
        level = [c[own == 1] for c in both]
        out = [pieces(((k, columns(*x)) for k, x in dealt(home(found[0], found[1], doc_buckets), found)), MARKS)]
        if len(level[0]) and not last:
            out.append(pieces([(key, columns(*level))], LEVEL))
        return pa.Table.from_batches(out)

    return run


def _merge(key, t):
    """A bucket of two levels -> of one."""
    both = joined(t.column("payload").to_pylist(), *ENTRY)
    return pa.Table.from_batches([pieces([(key[0].as_py(), columns(*ordered(both)))], LEVEL)])


def _texts(t: pa.Table | pa.RecordBatch):
    for doc_id, sub, text in zip(t.column("doc_id").to_pylist(), t.column("sub").to_pylist(), t.column("text"), strict=True):
        yield doc_id, sub, np.frombuffer(text.as_buffer() or b"", np.uint8) if text.is_valid else np.zeros(0, np.uint8)


def _by_document(doc: np.ndarray, sub: np.ndarray, *cols):
    """(doc_id, hash of the text) -> its rows."""
    order = np.lexsort((sub, doc))
    doc, sub, cols = doc[order], sub[order], [c[order] for c in cols]
    starts = np.flatnonzero(changes([doc, sub]))
    ends = np.append(starts[1:], len(doc))[: len(starts)]
    return {(int(doc[a]), int(sub[a])): [c[a:b] for c in cols] for a, b in zip(starts, ends, strict=True)}


CONTEXT = np.dtype(f"V{SIDE + LENGTH}")
#: What is shared, document, place, bytes before and behind, whether it is of the batch, which windows, context.
FETCHED = (_U, np.int64, np.int32, np.int32, np.uint8, np.uint8, np.uint8, np.uint8, CONTEXT)


def _fetch(buckets: int):
    """Texts and marks of a document bucket -> contexts whose windows must be compared, by bucket."""

    def run(key, docs, marks):
        doc, sub, at, how = joined(marks.column("payload").to_pylist(), *MARK)
        some = how != REPEAT
        of = _by_document(doc[some], sub[some], at[some], how[some])
        p, out = Powers(_P), []
        for d, s, raw in _texts(docs) if of else ():
            found = of.pop((d, s), None)
            if found is None:
                continue
            a, how = found
            a = a.astype(np.int64)
            prints = Prints(raw, p)
            padded = np.concatenate([np.zeros(SIDE, np.uint8), raw, np.zeros(LENGTH, np.uint8)])
            for side, lo, hi in ((0, a, a + K + HALF), (1, a - HALF, a + K)):
                there = np.flatnonzero((lo >= 0) & (hi <= len(raw)))
                x = a[there]
                h = mix(prints.of(lo[there], hi[there]) ^ _U(side))
                before, after = np.minimum(x, SIDE).astype(np.uint8), np.minimum(len(raw) - x, LENGTH).astype(np.uint8)
                n = len(x)
                out.append((h, np.full(n, d), np.full(n, s, np.int32), x.astype(np.int32), before, after, (how[there] == SHARED).astype(np.uint8), np.full(n, side, np.uint8), padded[x[:, None] + np.arange(SIDE + LENGTH)].view(CONTEXT).ravel()))
        if not out:
            return pa.Table.from_batches([pieces([])])
        cols = [np.concatenate(x) for x in zip(*out, strict=True)]
        return pa.Table.from_batches([pieces((k, columns(*x)) for k, x in dealt((cols[0] % _U(buckets)).astype(np.int64), cols))])

    return run


def repeated_windows(h, doc, sub, at, before, after, side, wide) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor, in the order of the documents: the first and last byte + 1, from the anchor, that its repeated windows
    cover; 0, 0 without one. side: 0 for windows that begin up to HALF bytes before the anchor, 1 for the others."""
    n = len(h)
    powers = Powers(_Q)
    powers.grow(SIDE + LENGTH + 1)
    sums = np.zeros((SIDE + LENGTH + 1, n), _U)
    by_byte = wide.T
    for j in range(SIDE + LENGTH):
        sums[j + 1] = sums[j] + _BYTES[by_byte[j]] * powers.up[j]
    low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for o in range(SIDE + 1):  # the window starts o bytes before the anchor
        there = np.flatnonzero((before >= o) & (after >= LENGTH - o) & (side == (o > HALF)))
        if len(there) < 2:
            continue
        s = SIDE - o
        key = mix((sums[s + LENGTH][there] - sums[s][there]) * powers.down[s] ^ h[there])
        order = np.argsort(key, kind="stable")  # of equal keys the earliest comes first
        k = key[order]
        first = there[order[np.maximum.accumulate(np.where(changes([k]), np.arange(len(k)), 0))]]
        own = there[order]
        hit = own[(doc[own] != doc[first]) | (sub[own] != sub[first]) | (at[own] != at[first])]
        low[hit] = -o
        fresh = hit[high[hit] == 0]
        high[fresh] = LENGTH - o
    return low, high


def _compare(doc_buckets: int):
    """Contexts of a bucket -> removed runs of the batch by document bucket, as (document, first byte, bytes)."""

    def run(key, t):
        h, doc, sub, at, before, after, own, side, wide = joined(t.column("payload").to_pylist(), *FETCHED)
        wide = wide.view(np.uint8).reshape(-1, SIDE + LENGTH)
        o = np.lexsort((at, sub, doc))
        out = []
        # what shares nothing has no windows in common, so some are taken at a time
        part = (h[o] >> _U(20)) % _U(max(1, len(h) // 50_000))
        for p in np.unique(part):
            i = o[part == p]
            low, high = repeated_windows(h[i], doc[i], sub[i], at[i], before[i], after[i], side[i], wide[i])
            hit = (high > 0) & (own[i] == 1)
            out.append((doc[i][hit], sub[i][hit], (at[i] + low)[hit].astype(np.int32), (high - low)[hit].astype(np.int32)))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, t) for t in MARK]
        return pa.Table.from_batches([pieces(((k, columns(*x)) for k, x in dealt(home(cols[0], cols[1], doc_buckets), cols)), LEVEL)])

    return run


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _cut(with_text: bool):
    """Texts, and marks and runs, of a document bucket -> results."""

    def run(key, docs, found):
        payload, kind = found.column("payload").to_pylist(), found.column("kind").to_pylist()
        doc, sub, at, how = joined([p for p, k in zip(payload, kind, strict=True) if k == MARKS], *MARK)
        whole = how == REPEAT
        doc2, sub2, start, size = joined([p for p, k in zip(payload, kind, strict=True) if k != MARKS], *MARK)
        of = _by_document(np.concatenate([doc[whole], doc2]), np.concatenate([sub[whole], sub2]), np.concatenate([at[whole] - SIDE, start]), np.concatenate([at[whole] + LENGTH, start + size]))
        rows = {x.name: [] for x in RESULT}
        for d, s, raw in _texts(docs):
            n_removed = n_spans = 0
            kept = raw
            if (d, s) in of:
                a, b = (np.clip(x, 0, len(raw)) for x in of[d, s])
                depth = np.bincount(a, minlength=len(raw) + 1) - np.bincount(b, minlength=len(raw) + 1)
                gone = np.cumsum(depth)[:-1] > 0
                n_removed = int(gone.sum())
                n_spans = int((gone[1:] > gone[:-1]).sum() + gone[:1].sum())
                kept = raw[~gone]
            kept = kept.tobytes()
            for c, v in zip(rows, (None if d == _NULL else d, len(raw), n_removed, n_spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None), strict=True):
                rows[c].append(v)
        return pa.Table.from_pydict(rows, schema=RESULT)

    return run


def _freed(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


RESULT_SQL = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


class Index:
    """A family of suffix arrays in the shared folder, to which batches of documents are added in the order of their ids."""

    def __init__(self, spark: SparkSession, n_bytes: int) -> None:
        """n_bytes: about how many bytes of text the index will hold, which sets the number of buckets."""
        small_batches(spark)
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.spark, self.folder = spark, f"{shared_dir(spark)}/galvan-suffixes-{uuid.uuid4().hex}"
        self.buckets = max(least, -(-n_bytes * 2 // (SIDE + 2) // BUCKET))
        self.doc_buckets = max(least, -(-n_bytes // DOC_BYTES)) | 1
        #: (path, batches) of the levels, largest first, and the documents they come from.
        self.levels: list[tuple[str, int]] = []
        self.documents: list[DataFrame] = []

    def keyed(self, docs: DataFrame) -> DataFrame:
        docs = docs.select(F.expr(f"coalesce(cast(doc_id AS bigint), {_NULL + 1} - 1)").alias("doc_id"), F.expr("cast(xxhash64(coalesce(text, '')) & 2147483647 AS int)").alias("sub"), F.col("text").cast("binary").alias("text"))
        return docs.select(F.expr(f"cast(pmod(doc_id ^ (cast(sub AS bigint) * 2654435761), {self.doc_buckets}) AS int)").alias("key"), "doc_id", "sub", "text")

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema("key int, payload binary").parquet(path)

    def _merged(self) -> None:
        """Makes one level of the last two as long as they are of equal size."""
        while len(self.levels) > 1 and self.levels[-2][1] == self.levels[-1][1]:
            (b, n), (a, _) = self.levels.pop(), self.levels.pop()
            path = f"{self.folder}/merged-{uuid.uuid4().hex}"
            self._read(a).unionByName(self._read(b)).groupBy("key").applyInArrow(_merge, PIECE).select("key", "payload").write.parquet(path)
            self.levels.append((path, 2 * n))
            for old in (a, b):
                _delete(self.spark, old)

    def drop(self) -> None:
        """Deletes the levels."""
        for path, _ in self.levels:
            _delete(self.spark, path)
        self.levels = []

    def add(self, docs: DataFrame, with_text: bool = False, last: bool = False) -> DataFrame:
        """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept bytes) of a batch, whose ids are above those of earlier batches.
        last: no batch follows, so it makes no level and the others go."""
        self._merged()
        docs = self.keyed(docs)
        self.documents.append(docs)
        pieces_ = docs.mapInArrow(_send(self.buckets, self.doc_buckets), PIECE)
        for path, _ in self.levels:
            pieces_ = pieces_.unionByName(self._read(path).withColumn("kind", F.lit(LEVEL)))
        path = f"{self.folder}/batch-{uuid.uuid4().hex}"
        pieces_.groupBy("key").applyInArrow(_match(self.doc_buckets, last), PIECE).write.partitionBy("kind").parquet(path)
        _freed(self.spark)
        if last:
            self.drop()
        marks = self.spark.read.schema("key int, payload binary, kind int").parquet(path).filter(F.col("kind") == MARKS)
        if not self.spark.read.schema("key int, payload binary, kind int").parquet(path).filter(F.col("kind") == LEVEL).isEmpty():
            self.levels.append((f"{path}/kind={LEVEL}", 1))
        # texts of earlier batches are read again for the anchors that the batch's are compared with
        so_far = self.documents[0]
        for more in self.documents[1:]:
            so_far = so_far.unionByName(more)
        contexts = so_far.groupBy("key").cogroup(marks.groupBy("key")).applyInArrow(_fetch(self.buckets), PIECE)
        runs = written(contexts.groupBy("key").applyInArrow(_compare(self.doc_buckets), PIECE), "runs")
        _freed(self.spark)
        found = marks.select("key", "kind", "payload").unionByName(runs)
        out = docs.groupBy("key").cogroup(found.groupBy("key")).applyInArrow(_cut(with_text), RESULT_SQL)
        return out if with_text else out.drop("kept")


def dedup(docs: DataFrame, with_text: bool = False, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with `with_text` the kept bytes; the table in ranges of doc_id, one after another."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0)).alias("n")).first().n
    index = Index(spark, total)
    cuts = docs.filter("doc_id IS NOT NULL").approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    cuts = sorted({int(c) for c in cuts})
    out, at = None, F.col("doc_id")
    for i in range(len(cuts) + 1):
        above = at > cuts[i - 1] if i else at.isNull()
        upto = at <= cuts[i] if i < len(cuts) else F.lit(True)
        part = index.add(docs.filter((at.isNull() | upto) if not i else above & upto), with_text, last=i == len(cuts))
        out = part if out is None else out.unionByName(part)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))

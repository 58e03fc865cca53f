"""Near-duplicate classes by ProbMinHash.

Words are runs of letters, digits and underscores in lower case; a document is the weighted set of its five-word
shingles, a shingle's weight being how often it occurs. Documents with the same words are one text from the first
aggregation on. Each distinct text gets a ProbMinHash signature: a shingle of weight w is a Poisson process of rate w
whose points fall on random registers, a register keeps its earliest point, and a process stops as soon as its next
point is later than the latest register (early termination). Registers agree with the probability Jaccard similarity.

Banding: 32 bands of 4 registers; a pair of similarity 0.8 is missed with probability (1 - 0.8^4)^32 = 5e-8. Pairs are
verified by weighted Jaccard similarity over all shingles (sum of minima over sum of maxima, 0.8 or more), each a 32-bit hash: two
different shingles of a pair of texts count as one with odds of 2^-32. No bucket is expanded into its pairs: each member is compared with
the bucket's hub, and verified links join classes. In a bucket that still holds several classes (buckets of the same members are one), every
link between classes has an end outside its largest class: those members are compared with all, exactly and without a row for each
pair. Both sides are cut into blocks of bounded size, and a task takes two; small buckets share tasks. So no link between different
texts that meet in a bucket is lost to the classes; within a class not every link is looked for.

Defined results: a text of 1 to 4 words is one shingle; a null, empty or wordless text is a class of its own; repeated
doc_ids with the same words are one document, and with different words their classes meet; rows with a null doc_id and the same text
are one document behind (nearly) all ids, and the class_id is null where they are the class's first; other columns are ignored.
The stage has a key for each row, so it keeps one row of each class, also among repeated and null doc_ids. Pairs of similarity 0.8 exactly are
links; an empty table gives no rows; texts of any length are taken whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, fresh, hashed_words, late_key, map_texts, mixed, of_worker, packed, row_keyed, shingles, table, written

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
#: Shingles of a block, of which a task compares two; also of the small buckets of a task.
BLOCK = 500_000
_WORD = re.compile(r"\w+")
_U = np.uint64


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def weighted(s: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(48-bit shingle, document number, weight), sorted by document, of up to 65536 documents."""
    key = np.sort((doc.astype(_U) << _U(48)) | (s >> _U(16)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first] & _U((1 << 48) - 1), (key[first] >> _U(48)).astype(np.int64), np.diff(np.append(first, len(key)))


def signatures(ids: np.ndarray, doc: np.ndarray, w: np.ndarray, n: int, m: int) -> np.ndarray:
    """n x m registers: the shingle whose point is the earliest there."""
    times, owner = np.full(n * m, np.inf), np.zeros(n * m, _U)
    at, t, j = np.arange(len(ids)), np.zeros(len(ids)), 0
    while len(at):
        j += 1
        r = mixed(ids[at] + _U((j * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        t = t - np.log1p(-(r >> _U(11)).astype(np.float64) * 2.0**-53) / w[at]
        register = doc[at] * m + (mixed(r + _U(0x9E3779B97F4A7C15)) % _U(m)).astype(np.int64)
        early = t < times[register]
        reg, tt = register[early], t[early]
        np.minimum.at(times, reg, tt)
        won = tt == times[reg]
        owner[reg[won]] = ids[at[early][won]]
        latest = times.reshape(n, m).max(1)
        on = t < latest[doc[at]]
        at, t = at[on], t[on]
    return owner.reshape(n, m)


SIGNED = "doc_id bigint, k1 bigint, k2 bigint, n bigint, bands array<bigint>"


def _sign():
    cache = of_worker("words", WordHashes)
    m = BANDS * ROWS
    salt = mixed(np.arange(1, BANDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))

    def f(texts, batch):
        h, offsets = hashed_words([words_of(t) for t in texts], cache)
        k = [xxhash.xxh3_128_digest(h[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        keys = np.frombuffer(b"".join(k), np.int64).reshape(-1, 2)
        ids, doc, w = weighted(*shingles(h, offsets, WORDS))
        sig = signatures(ids, doc, w, len(texts), m).reshape(-1, BANDS, ROWS)
        band = np.broadcast_to(salt, sig.shape[:2])
        for r in range(ROWS):
            band = mixed(band * _U(0xD6E8FEB86659FD93) + sig[:, :, r])
        bands = list(band.view(np.int64))
        n = np.diff(offsets)
        return {"doc_id": batch.column("doc_id"), "k1": keys[:, 0], "k2": keys[:, 1], "n": n, "bands": [b if c else [] for b, c in zip(bands, n, strict=True)]}

    return f


def _sets():
    """Shingles as 32-bit numbers; the c-th occurrence of a shingle is an element of its own, so that sets give weighted similarity."""
    cache = of_worker("words", WordHashes)

    def f(texts, batch):
        s, doc = shingles(*hashed_words([words_of(t) for t in texts], cache), WORDS)
        order = np.lexsort((s, doc))
        s, doc = s[order], doc[order]
        first = np.concatenate([[True], (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])]) if len(s) else np.zeros(0, bool)
        start = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0)) if len(s) else np.zeros(0, np.int64)
        c = (np.arange(len(s)) - start).astype(_U)
        e = (mixed(s + c * _U(0x9E3779B97F4A7C15)) >> _U(32)).astype(np.uint32).view(np.int32)
        ends = np.searchsorted(doc, np.arange(len(texts) + 1))
        return {"doc_id": batch.column("doc_id"), "elements": [e[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]}

    return f


def _pairs_with_hubs(bands: DataFrame) -> DataFrame:
    """(a, b): members of a bucket and its hub, the member whose buckets are the largest in sum: originals rather than copies."""
    sizes = bands.groupBy("band").agg(F.count("*").alias("n"))
    central = bands.join(sizes, "band").groupBy("doc_id").agg(F.sum("n").alias("n"))
    hubs = bands.join(central, "doc_id").groupBy("band").agg(F.min(F.struct((-F.col("n")).alias("o"), F.col("doc_id").alias("hub"))).alias("h")).select("band", "h.hub")
    return bands.join(hubs, "band").filter("doc_id <> hub").select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()


def _mixed(bands: DataFrame, classes: DataFrame) -> DataFrame:
    """(grp, doc_id, class_id, outside): members of buckets of three texts or more that hold several classes; outside: not of the
    bucket's largest class. A bucket's pair of two texts is done, as one of them was the hub. Of buckets with the same members one is taken."""
    members = bands.join(classes, "doc_id")
    by_class = members.groupBy("band", "class_id").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y"))
    buckets = by_class.groupBy("band").agg(F.max_by("class_id", F.struct("n", "class_id")).alias("largest"), F.count("*").alias("classes"), F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    one = buckets.filter("classes > 1 AND n > 2").groupBy("n", "x", "y").agg(F.min(F.struct("band", "largest")).alias("b")).select("b.*")
    return members.join(one, "band").select(F.col("band").alias("grp"), "doc_id", "class_id", (F.col("class_id") != F.col("largest")).alias("outside"))


def _compare(threshold: float):
    """Blocks of buckets -> links between different classes. Intersections of one text with all of the other block are counted at once."""

    def block(doc, cls, side, size, flat):
        universe, ids = np.unique(flat, return_inverse=True)
        ends = np.concatenate([[0], np.cumsum(size)])
        flags, cls = np.zeros(len(universe), bool), cls.copy()
        for i in np.flatnonzero(side == 0).tolist():
            if (cls == cls[i]).all():
                continue
            own = ids[ends[i] : ends[i + 1]]
            flags[own] = True
            common = np.add.reduceat(flags[ids], ends[:-1], dtype=np.int64)
            flags[own] = False
            near = (side == 1) & (cls != cls[i]) & (common >= threshold * (size + size[i] - common))
            for j in np.flatnonzero(near).tolist():
                if cls[j] != cls[i]:
                    yield min(doc[i], doc[j]), max(doc[i], doc[j]), common[j] / (size[i] + size[j] - common[j])
                    cls[cls == cls[j]] = cls[i]  # their other pairs say nothing new

    def run(key, t):
        t = t.sort_by([("grp", "ascending"), ("s", "ascending"), ("a", "ascending")])
        doc, cls, side, grp, s, a = (np.array(t.column(c)) for c in ("doc_id", "class_id", "side", "grp", "s", "a"))
        elements = t.column("elements").combine_chunks()
        offsets, flat = np.array(elements.offsets), np.array(elements.values)
        size = np.diff(offsets)
        cuts = np.flatnonzero(np.concatenate([[True], (grp[1:] != grp[:-1]) | (s[1:] != s[:-1]) | (a[1:] != a[:-1]), [True]]))
        out = [x for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) for x in block(doc[lo:hi], cls[lo:hi], side[lo:hi], size[lo:hi], flat[offsets[lo] : offsets[hi]])]
        x, y, similarity = zip(*out, strict=True) if out else ((), (), ())
        return pa.Table.from_pydict({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64()), "similarity": pa.array(similarity, pa.float64())})

    return run


def _links_within(mixed_: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between different classes of a bucket: of blocks of members outside the largest class with blocks of all."""
    rows = mixed_.join(sets, "doc_id").filter("size(elements) > 0")
    size = F.size("elements").cast("bigint")
    sums = written(rows.groupBy("grp").agg(F.sum(F.when(F.col("outside"), size).otherwise(0)).alias("s"), F.sum(size).alias("a")), "buckets")
    total = sums.agg(F.coalesce(F.sum("a"), F.lit(0))).first()[0]
    blocks = sums.select("grp", *[F.ceil(F.col(c) / BLOCK).cast("int").alias(f"n_{c}") for c in "sa"])
    rows = rows.join(blocks, "grp")
    of_row = lambda c: F.pmod(F.xxhash64("doc_id"), F.col(f"n_{c}")).cast("int").alias(c)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(f"n_{c}") - 1)).alias(c)
    kept = ["grp", "n_s", "n_a", "doc_id", "class_id", "elements"]
    sides = rows.filter("outside").select(*kept, F.lit(0).alias("side"), of_row("s"), every("a")).unionByName(rows.select(*kept, F.lit(1).alias("side"), every("s"), of_row("a")))
    tasks = max(1, -(-total // BLOCK))
    task = F.when((F.col("n_s") == 1) & (F.col("n_a") == 1), F.pmod(F.xxhash64("grp"), F.lit(tasks))).otherwise(F.xxhash64("grp", "s", "a"))
    return sides.select(task.alias("task"), "grp", "s", "a", "side", "doc_id", "class_id", "elements").groupBy("task").applyInArrow(_compare(threshold), "a bigint, b bigint, similarity double")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose weighted Jaccard similarity reaches the threshold, with it."""
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("ea")), sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("eb"))
    both = pairs.join(left, "a").join(right, "b")
    na, nb = F.size("ea"), F.size("eb")
    both = both.filter(F.least(na, nb) >= threshold * F.greatest(na, nb))
    common = F.size(F.array_intersect("ea", "eb"))
    return both.select("a", "b", (common / (na + nb - common)).alias("similarity")).filter(F.col("similarity") >= threshold)


def components(edges: DataFrame, rows: int, what: str = "components") -> DataFrame:
    """(doc_id, class_id): the smallest id of the component, for the ends of the edges (a, b). Alternating large-star and
    small-star rounds, each written to the shared folder; stars of hot nodes are aggregated before they are shuffled.
    rows: about how many edges there are."""
    e = edges.select("a", "b")
    before = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        e = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # every node points to smaller ones now; the smallest of them takes the others and the node
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        joined = e.join(low, "a")
        e = joined.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        e = written(e, what, rows)
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            return e.groupBy("a").agg(F.min("b").alias("class_id")).withColumnRenamed("a", "doc_id").unionByName(e.select(F.col("b").alias("doc_id"), F.col("b").alias("class_id")).distinct())
        before = seen


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), n_links (verified links found for the document's text), kept (the class's first)."""
    missing = F.col("doc_id").isNull()
    unnamed = docs.filter(missing).select(late_key(F.coalesce("text", F.lit(""))).alias("unnamed")).distinct()
    docs = docs.select(F.when(missing, late_key(F.coalesce("text", F.lit("")))).otherwise(F.col("doc_id").cast("bigint")).alias("doc_id"), "text")
    signed = written(map_texts(docs, _sign, SIGNED), "signed")
    n = signed.count()
    # a row for each different text; wordless documents stay apart
    key = F.when(F.col("n") > 0, F.lit(0)).otherwise(F.col("doc_id"))
    reps = signed.groupBy("k1", "k2", key.alias("k3")).agg(F.min(F.struct("doc_id", "bands")).alias("r")).select("k1", "k2", "k3", "r.*")
    reps = written(reps, "texts", 4 * n)
    bands = reps.select("doc_id", F.explode("bands").alias("band"))
    # only buckets of two texts or more matter
    shared = bands.groupBy("band").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo <> hi").select("band")
    bands = written(bands.join(shared, "band", "left_semi"), "bands", 8 * n)
    candidates = bands.select("doc_id").distinct()
    sets = written(map_texts(docs, _sets, "doc_id bigint, elements array<int>").join(candidates, "doc_id", "left_semi"), "sets", 20 * n)
    edges = written(verified(_pairs_with_hubs(bands), sets, threshold), "links", 20 * n)  # few rows, but the shingles of many pass through
    by_class = lambda e: candidates.join(components(e, e.count()), "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    mixed_ = written(_mixed(bands, by_class(edges)), "mixed", n)
    edges = edges.unionByName(written(_links_within(mixed_, sets, threshold), "links", 20 * n))
    found = by_class(edges)
    n_links = edges.select(F.col("a").alias("doc_id")).unionByName(edges.select(F.col("b").alias("doc_id"))).groupBy("doc_id").agg(F.count("*").alias("n_links"))
    texts = reps.join(found, "doc_id", "left").join(n_links, "doc_id", "left").select("k1", "k2", "k3", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))
    out = signed.select("doc_id", "k1", "k2", key.alias("k3")).join(texts, ["k1", "k2", "k3"]).select("doc_id", "class_id", "n_links")
    out = out.withColumn("kept", F.col("doc_id") == F.col("class_id"))
    if unnamed.isEmpty():
        return packed(out, n, 100_000)
    for c in ("doc_id", "class_id"):
        out = out.join(unnamed, F.col(c) == F.col("unnamed"), "left").withColumn(c, F.when(F.col("unnamed").isNull(), F.col(c))).drop("unnamed")
    return packed(out, n, 100_000)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each class, with its columns."""
    (key,) = fresh(docs, "key")
    keyed = row_keyed(docs, key)
    kept = classes(keyed.select(F.col(key).alias("doc_id"), "text")).filter("kept").select(F.col("doc_id").alias(key))
    return packed(keyed.join(kept, key, "left_semi").select(*docs.columns), docs.count(), 8_000)

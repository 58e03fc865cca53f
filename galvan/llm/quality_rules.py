"""Quality rules by distribution divergence.

Every whole text gets a histogram of character classes and one of common words. The reference of a language is the sum
of these histograms over all of its documents that pass the base rules, so it follows the corpus. A document is
rejected if it fails a base rule or if the Jensen-Shannon distance (base 2, square root of the divergence) between a
histogram and the reference exceeds a threshold. Guards: the character test needs `min_chars` characters and the word test
`min_words` words. A sample of n words diverges from its own source by about k / n (squared distance, k growing with the number of
classes), so the word test allows sqrt(max_word^2 + SPREAD / n). A language needs MIN_DOCS documents that pass the base rules; below
that its documents have no distances and the base rules alone decide.

Defined results: a null or empty text has no words and fails the base rule; a null language is the language "und"; a null doc_id
is a row like others; repeated doc_ids and repeated rows give a row each; distances equal to the limit pass; no documents give no
rows; texts of any length are taken whole; other columns are ignored. The stage's own least number of words is `STAGE_WORDS`: it has no
cause to drop a short clean text, so what the guards leave out stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import content_key, fresh, hashed_words, map_texts, of_worker, packed, table, written

#: Common words whose shares are compared; the rest is one class.
COMMON_WORDS = {
    "en": "the of and to a in is that it for was as with be by on not this are or from at which but have an had they you were".split(),
    "fr": "de la le et les des en un une du que est dans qui par pour au il sur pas plus ne se ce sont avec".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er".split(),
    "es": "de la que el en y a los del se las por un para con no una su al es lo como más o pero sus".split(),
}
CLASSES = ("lower", "upper", "digit", "space", "punctuation", "symbol", "other", "not_ascii")
SYMBOLS = b"#*$%&|<>"
MIN_CHARS, MIN_WORDS = 200, 50
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.3, 0.25
#: What 1 / (number of words) adds to the squared word distance, by chance; base-passing documents that a language's reference needs.
SPREAD, MIN_DOCS = 7.0, 20
#: Least words of a text that the pipeline's stage keeps.
STAGE_WORDS = 1
#: Languages up to whose number the references, 290 numbers each, are broadcast.
BROADCAST_LANGUAGES = 10_000


def _classes() -> np.ndarray:
    """Byte -> class; continuation bytes of UTF-8 have class 8, which doesn't count."""
    c = np.full(256, 6)
    c[ord("a") : ord("z") + 1], c[ord("A") : ord("Z") + 1], c[ord("0") : ord("9") + 1] = 0, 1, 2
    c[[9, 10, 11, 12, 13, 32]] = 3
    c[list(b".,;:!?'\"()-")] = 4
    c[list(SYMBOLS)] = 5
    c[0xC0:] = 7
    c[0x80:0xC0] = 8
    return c


class _Slots(dict):
    """word (bytes) -> 56 bits of its hash and, in the low byte, its common-word class (0: none)."""

    def __init__(self) -> None:
        words = sorted({w for x in COMMON_WORDS.values() for w in x})
        assert len(words) < 255
        self.slot = {w.encode(): i + 1 for i, w in enumerate(words)}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        low = word.lower().strip(b".,;:!?'\"()-") if word.isascii() else word.decode().lower().strip(".,;:!?'\"()-").encode()
        self[word] = v = xxhash.xxh3_64_intdigest(word) & ~0xFF | self.slot.get(low, 0)
        return v


N_SLOTS = 1 + len({w for x in COMMON_WORDS.values() for w in x})
SCHEMA = "doc_id bigint, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, chars array<bigint>, words array<bigint>"


def _features():
    byte_class, slots = _classes(), of_worker("slots", _Slots)
    symbols = list(SYMBOLS)

    def f(texts, batch):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        lists = [b.split() for b in raw]
        h, offsets = hashed_words(lists, slots)
        n = np.diff(offsets)
        doc = np.repeat(np.arange(len(n)), n)
        counts = np.bincount(doc * N_SLOTS + (h & np.uint64(0xFF)).astype(np.int64), minlength=len(n) * N_SLOTS).reshape(len(n), N_SLOTS)
        covered = np.zeros(len(h), bool)
        if len(h) > 2:
            ids = (h >> np.uint64(8)) ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            tri = (ids[:-2] * np.uint64(0xD6E8FEB86659FD93) + ids[1:-1]) * np.uint64(0xA0761D6478BD642F) + ids[2:]
            at = np.flatnonzero(doc[:-2] == doc[2:])
            order = np.argsort(tri[at])
            ranked = tri[at][order]
            same = ranked[1:] == ranked[:-1]
            twice = np.zeros(len(at), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            for j in range(3):
                covered[at[twice] + j] = True
        repeat = np.bincount(doc[covered], minlength=len(n))
        hist = np.zeros((len(raw), 9), np.int64)
        n_symbols, dup = [], []
        for i, b in enumerate(raw):
            of = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
            hist[i] = np.bincount(byte_class, of, 9)
            n_symbols.append(int(of[symbols].sum()))
            lines = [x for x in b.split(b"\n") if x.strip()]
            dup.append(len(lines) - len(set(lines)))
        return {
            "doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "n_words": n, "word_chars": hist[:, :8].sum(1) - hist[:, 3], "n_symbols": n_symbols,
            "n_dup_lines": dup, "n_repeat_words": repeat, "chars": list(hist[:, :8]), "words": list(counts),
        }

    return f


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances of the rows of two matrices of counts, base 2; nan where a row is empty."""
    with np.errstate(divide="ignore", invalid="ignore"):
        p, q = p / p.sum(1, keepdims=True), q / q.sum(1, keepdims=True)
        m = (p + q) / 2
        x = np.where(p > 0, p * np.log2(p / m), 0).sum(1) + np.where(q > 0, q * np.log2(q / m), 0).sum(1)
        return np.where(np.isnan(p.sum(1) + q.sum(1)), np.nan, np.sqrt(np.maximum(x, 0) / 2))


COUNTS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _compared(min_chars: int, min_words: int, max_char: float, max_word: float):
    def run(batches):
        for b in batches:
            wide = lambda c, n: np.array([x if x is not None else [0] * n for x in b.column(c).to_pylist()], float).reshape(-1, n)  # noqa: E731, B023
            chars = wide("chars", len(CLASSES))
            by_char = np.where(chars.sum(1) >= min_chars, distances(chars, wide("ref_chars", len(CLASSES))), np.nan)
            by_word = np.where(np.array(b.column("n_words")) >= min_words, distances(wide("words", N_SLOTS), wide("ref_words", N_SLOTS)), np.nan)
            n = np.maximum(np.array(b.column("n_words")), 1)
            kept = ~np.array(b.column("base_failed").to_pylist(), bool) & ~(by_char > max_char) & ~(by_word > np.sqrt(max_word * max_word + SPREAD / n))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in COUNTS], pa.array(kept), pa.array(by_char, mask=np.isnan(by_char)), pa.array(by_word, mask=np.isnan(by_word))], names=[*COUNTS, "kept", "char_distance", "word_distance"])

    return run


def features(docs: DataFrame, least_words: int = 50) -> DataFrame:
    return map_texts(docs.select(F.col("doc_id").cast("bigint"), F.coalesce("lang", F.lit("und")).alias("lang"), "text"), _features, SCHEMA).withColumn(
        "base_failed", F.expr(f"n_words < {least_words} OR 100 * n_repeat_words > 50 * n_words")
    )


def references(found: DataFrame) -> DataFrame:
    """lang -> summed histograms over its documents that pass the base rules, if there are MIN_DOCS."""
    sums = lambda c, n: F.array(*[F.sum(F.col(c)[i]).cast("double") for i in range(n)])
    summed = found.filter("NOT base_failed").groupBy("lang").agg(F.count("*").alias("n"), sums("chars", len(CLASSES)).alias("ref_chars"), sums("words", N_SLOTS).alias("ref_words"))
    return summed.filter(F.col("n") >= MIN_DOCS).drop("n")


def judge(docs: DataFrame, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE, least_words: int = 50) -> DataFrame:
    """One row a document: the base counts, both distances (null below the guard) and `kept`. least_words: of the base rule.
    A row a language is broadcast, so that a language of most documents isn't one task; past BROADCAST_LANGUAGES both sides are shuffled."""
    found = written(features(docs, least_words), "quality")
    per_language = written(references(found), "references", 1)
    both = found.join(F.broadcast(per_language) if per_language.count() <= BROADCAST_LANGUAGES else per_language, "lang", "left")
    types = ", ".join(f"{c} {'boolean' if c == 'base_failed' else 'bigint'}" for c in COUNTS)
    return both.mapInArrow(_compared(min_chars, min_words, max_char, max_word), types + ", kept boolean, char_distance double, word_distance double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def sql() -> str:
    """The same rows. Where a document lacks a class, the class adds its reference share to the sum."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    slots = sorted({w for x in COMMON_WORDS.values() for w in x})
    classes = {"lower_": "[a-z]", "upper_": "[A-Z]", "digit": "[0-9]", "space": r"[\x09-\x0D\x20]", "punctuation": "[.,;:!?'\"()-]", "symbol": r"[#*$%&|<>]", "not_ascii": r"[^\x00-\x7F]"}
    count = lambda p: f"length(t) - length(regexp_replace(t, {quoted(p)}, '', 'g'))"
    divergence = "sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, 'und') AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, lang, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
tri AS (SELECT r, i, count(*) OVER (PARTITION BY r, a) AS n FROM (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS a FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w))),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE n > 1) GROUP BY r),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM (
    SELECT r, doc_id, lang, t, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST({count(classes['symbol'])} AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep USING (r))),
c0 AS (SELECT r, lang, base_failed, n_words, length(t) AS n, {', '.join(f'{count(p)} AS {k}' for k, p in classes.items())} FROM base),
c1 AS (SELECT r, lang, base_failed, n, unnest([{', '.join(quoted(k) for k in classes)}, 'other']) AS class, unnest([{', '.join(classes)}, n - ({' + '.join(classes)})]) AS x FROM c0),
few AS (SELECT lang FROM base WHERE NOT base_failed GROUP BY lang HAVING count(*) < {MIN_DOCS}),
cq AS (SELECT lang, class, sum(x) / sum(sum(x)) OVER (PARTITION BY lang) AS q FROM c1 WHERE NOT base_failed AND lang NOT IN (FROM few) GROUP BY lang, class),
cd AS (SELECT r, sqrt(greatest(0, {divergence}) / 2) AS char_distance FROM (SELECT r, x / n AS p, q FROM c1 JOIN cq USING (lang, class) WHERE n >= {MIN_CHARS}) GROUP BY r),
s0 AS (SELECT r, lang, base_failed, n_words, CASE WHEN v IN ({', '.join(map(quoted, slots))}) THEN v ELSE '' END AS class FROM (SELECT r, lang, base_failed, n_words, trim(lower(unnest(w)), {quoted(".,;:!?'" + chr(34) + "()-")}) AS v FROM base)),
s1 AS (SELECT r, lang, base_failed, n_words, class, count(*) AS x FROM s0 GROUP BY ALL),
sq AS (SELECT lang, class, sum(x) / sum(sum(x)) OVER (PARTITION BY lang) AS q FROM s1 WHERE NOT base_failed AND lang NOT IN (FROM few) GROUP BY lang, class),
sd AS (SELECT r, sqrt(greatest(0, {divergence} + 1 - sum(q)) / 2) AS word_distance FROM (SELECT r, x / n_words AS p, coalesce(q, 0) AS q FROM s1 LEFT JOIN sq USING (lang, class) WHERE n_words >= {MIN_WORDS} AND lang IN (SELECT lang FROM sq)) GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(char_distance, 0) <= {MAX_CHAR_DISTANCE} AND coalesce(word_distance, 0) <= sqrt({MAX_WORD_DISTANCE * MAX_WORD_DISTANCE} + {SPREAD} / greatest(n_words, 1)) AS kept,
    round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance
FROM base LEFT JOIN cd USING (r) LEFT JOIN sd USING (r)"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules keep, with their columns. Rows of the same doc_id (or none), language and text are judged alike."""
    (key,) = fresh(docs, "key")
    keyed = docs.withColumn(key, content_key(docs, "doc_id", "lang", "text"))
    kept = judge(keyed.select(F.col(key).alias("doc_id"), "lang", "text"), least_words=STAGE_WORDS).filter("kept").select(F.col("doc_id").alias(key)).distinct()
    return packed(keyed.join(kept, key, "left_semi").select(*docs.columns), docs.count(), 8_000)

"""Alignment of sentences with recognised words, and error metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .edits import aligned_words, distances
from .shared import kept


def cer(reference: Column, hypothesis: Column) -> Column:
    """Character error rate; null for an empty reference."""
    return F.levenshtein(reference, hypothesis) / F.nullif(F.length(reference), F.lit(0))


def wer_parts(reference: Column, hypothesis: Column) -> Column:
    """(edits, words): each different word of the pair becomes one character beyond the first plane, which has room for a million
    words, so that the edit distance of characters is that of words."""
    words = F.struct(T.split_words(reference).alias("a"), T.split_words(hypothesis).alias("b"))

    def coded(s):
        both = F.array_union(s["a"], s["b"])
        return T.bound(both, lambda v: F.struct(*[F.array_join(F.transform(s[x], lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(v, w) + 0xFFFF), 8, "0")), "UTF-32")), "").alias(x) for x in "ab"]))

    return T.bound(words, lambda s: T.bound(coded(s), lambda c: F.struct(F.levenshtein(c["a"], c["b"]).alias("edits"), F.size(s["a"]).alias("words"))))


def wer(reference: Column, hypothesis: Column) -> Column:
    p = wer_parts(reference, hypothesis)
    return p["edits"] / F.nullif(p["words"], F.lit(0))


def corpus_wer(pairs: DataFrame, *by: str) -> DataFrame:
    """All edits over all reference words."""
    p = wer_parts(F.col("reference"), F.col("hypothesis"))
    return pairs.select(*by, p.alias("p")).groupBy(*by).agg((F.sum("p.edits") / F.sum("p.words")).alias("wer"))


def weighted(rows: DataFrame, value: str, weight: Column, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg((F.sum(F.col(value) * weight) / F.sum(weight)).alias(value))


#: Starts of windows that grow together.
STARTS = 4096


def _grown(words: list[str], i: int, longest: int) -> list[str]:
    """Forms of the windows that start at word i, until they are so long that none can still be better for a sentence of `longest` letters."""
    out: list[str] = []
    raw = ""
    for w in words[i:]:
        raw += w
        out.append(T.align_form_of(raw))
        if len(out) > 2 * longest + 20 or len(out[-1]) > max(2 * longest, longest + len(out[0])) + 1:
            break
    return out


def _best_sizes(ref: np.ndarray, chars: np.ndarray, ends: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(words, edits) of the windows from each start at which the edit distance last fell or stayed before it first rose. chars: the
    letters of the longest window from each start; ends: its letters after each word. One row of the distance table is kept a start."""
    n, length = len(chars), len(ref)
    most = 2 * length + 20
    size, edits = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    at, place = np.zeros(n, np.int64), np.arange(length + 1)
    following = np.array([e[0] for e in ends])  # where each start's next window ends
    live, rows = np.arange(n), np.tile(place, (n, 1))
    p = 0
    while True:
        # windows that end here
        stop = np.zeros(len(live), bool)
        for k in np.flatnonzero(following[live] == p).tolist():
            i, d = live[k], int(rows[k, -1])
            if d > edits[i]:
                stop[k] = True
                continue
            while at[i] < len(ends[i]) and ends[i][at[i]] == p:
                at[i] += 1
                edits[i], size[i] = d, min(at[i], most)
            stop[k] = at[i] >= min(len(ends[i]), most)
            following[i] = -1 if stop[k] else ends[i][at[i]]
        live, rows = live[~stop], rows[~stop]
        if not len(live) or p >= chars.shape[1]:
            return size, edits
        swap = rows[:, :-1] + (chars[live, p][:, None] != ref)
        new = np.empty_like(rows)
        new[:, 0] = rows[:, 0] + 1
        new[:, 1:] = np.minimum(swap, rows[:, 1:] + 1)
        rows = np.minimum.accumulate(new - place, axis=1) + place
        p += 1


def _align(weight: float):
    """Sentences (sentence, ref, at) and words (i, word) of a part -> sentence, lo, hi, score."""

    def codes(s: str) -> np.ndarray:
        return np.frombuffer(s.encode("utf-32-le"), np.uint32)

    def run(key, sentences: pd.DataFrame, heard: pd.DataFrame) -> pd.DataFrame:
        words = heard.sort_values("i")["word"].fillna("").tolist()
        found = []
        longest = max((len(r) for r in sentences["ref"]), default=0)
        best = [(np.inf, 0, 0)] * len(sentences)
        for first in range(0, len(words), STARTS):
            starts = range(first, min(first + STARTS, len(words)))
            forms = [_grown(words, i, longest) for i in starts]
            ends = [np.array([len(x) for x in f]) for f in forms]
            # a window's form begins with those of its shorter ones, but where letters of two words join (c and h)
            odd = {k for k, f in enumerate(forms) if any(not b.startswith(a) for a, b in zip(f, f[1:], strict=False))}
            chars = np.zeros((len(forms), max(e[-1] for e in ends)), np.uint32)
            for k, f in enumerate(forms):
                chars[k, : len(f[-1])] = codes(f[-1])
            even = [k for k in range(len(forms)) if k not in odd]
            for s, (ref, where) in enumerate(zip(sentences["ref"], sentences["at"], strict=True)):
                size, edits = np.zeros(len(forms), np.int64), np.zeros(len(forms), np.int64)
                if even:
                    size[even], edits[even] = _best_sizes(codes(ref), chars[even], [ends[k] for k in even])
                for k in odd:
                    each = distances(ref, forms[k][: 2 * len(ref) + 20]).tolist()
                    size[k] = next((j for j in range(1, len(each)) if each[j] > each[j - 1]), len(each))
                    edits[k] = each[size[k] - 1]
                score = edits / len(ref) * (1 - weight) + np.abs(np.array(starts) / len(words) - where) * weight
                k = int(score.argmin())
                if score[k] < best[s][0]:
                    best[s] = score[k], first + k, first + k + int(size[k])
        for s, (score, lo, hi) in zip(sentences["sentence"], best, strict=True):
            if words:
                found.append((*key, s, lo, hi, score))
        return pd.DataFrame(found, columns=[part_name, "sentence", "lo", "hi", "score"])

    part_name = "__part"
    return run


def aligned(sentences: DataFrame, words: DataFrame, part: str, weight: float = 0.5) -> DataFrame:
    """part, sentence, lo, hi, score: where each sentence (part, pos, text) is among the words (part, pos, word). From each word a window
    grows while its score falls or stays; the best start wins, then the first. A task takes a part at a time: the windows of
    all starts grow together, a letter at a time, on one row of the distance table each, so that nothing is exploded."""
    w_part, w_all = Window.partitionBy(part).orderBy("pos"), Window.partitionBy(part)
    ref = sentences.select(part, F.col("pos").alias("sentence"), T.align_form(F.col("text")).alias("ref"), T.count_plain_words(F.col("text")).alias("n"), "pos")
    ref = ref.withColumn("at", (F.sum("n").over(w_part) - F.col("n")) / F.sum("n").over(w_all)).filter("ref <> ''").drop("pos", "n")
    hyp = words.select(part, F.col("pos").alias("i"), "word")
    ref, hyp = ref.toDF(*ref.columns), hyp.toDF(*hyp.columns)  # both may come from one table
    kinds = {f.name: f.dataType.simpleString() for f in [*ref.schema, *hyp.schema]}
    out = ref.groupBy(part).cogroup(hyp.groupBy(part)).applyInPandas(_align(weight), f"__part {kinds[part]}, sentence {kinds['sentence']}, lo int, hi int, score double")
    return out.withColumnRenamed("__part", part)


def reliability(matches: DataFrame, part: str, n_words: Column) -> DataFrame:
    """Adds O (sure), o, ? or X (wrong) from how far the neighbours are; a part at a time, as what was sure decides what follows."""
    w = Window.partitionBy(part).orderBy("sentence")
    near = matches.withColumn("n_words", n_words).withColumn("prev", F.abs(F.coalesce(F.lag("hi").over(w), F.lit(0)) - F.col("lo"))).withColumn("next", F.abs(F.coalesce(F.lead("lo").over(w), F.col("n_words")) - F.col("hi")))

    def grade(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sentence").reset_index(drop=True)
        last, out = 0, []
        for p, n, hi in zip(rows["prev"], rows["next"], rows["hi"], strict=True):
            ahead = hi > last
            if p <= 2 or (n <= 2 and ahead):
                out.append("O" if p <= 2 and n <= 2 and p + n <= 2 else "o")
            else:
                out.append("?" if ahead else "X")
            last = hi if out[-1] == "O" else last
        return rows[[part, "sentence", "lo", "hi", "score"]].assign(reliability=out)

    kind = near.schema[part].dataType.simpleString()
    rows = near.select(part, F.col("sentence").cast("bigint").alias("sentence"), F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"), "score", "prev", "next")
    return rows.groupBy(part).applyInPandas(grade, f"{part} {kind}, sentence bigint, lo int, hi int, score double, reliability string")


def unaligned_ranges(matches: DataFrame, part: str, good: tuple[str, ...] = ("O",)) -> DataFrame:
    """part, first, last (exclusive) of runs of unreliable matches, by row numbers from 0."""
    w = Window.partitionBy(part).orderBy("sentence")
    rows = matches.select(part, (F.row_number().over(w) - 1).alias("i"), F.col("reliability").isin(*good).alias("good"))
    bad = rows.filter("NOT good").withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy(part).orderBy("i")))
    return bad.groupBy(part, "run").agg(F.min("i").alias("first"), (F.max("i") + 1).alias("last")).drop("run")


def refined(sentences: DataFrame, words: DataFrame, part: str, weight: float = 0.5, rounds: int = 10) -> DataFrame:
    """part, sentence, lo, hi, score, reliability. Runs of unreliable sentences are aligned again between their reliable neighbours, as long as
    that makes more sentences reliable: half-sure ones stay in every other round. At last what half-sure matches run backwards is
    marked as unsure. Each round is one job over all parts, whose result is written."""
    index = F.row_number().over(Window.partitionBy(part).orderBy("pos")) - 1
    heard = words.select(part, index.alias("pos"), "word")
    sizes = heard.groupBy(part).agg(F.count("*").cast("int").alias("n_words"))
    graded = lambda m: kept(reliability(m.join(sizes, part), part, F.col("n_words")), "aligned")
    sure = lambda m: m.filter("reliability IN ('O', 'o')").count()
    texts = sentences.select(part, F.col("pos").alias("sentence"), "text")
    matches = graded(aligned(sentences, heard, part, weight))
    before = sure(matches)
    for k in range(rounds):
        rows = matches.withColumn("r", F.row_number().over(Window.partitionBy(part).orderBy("sentence")) - 1)
        runs = unaligned_ranges(matches, part, ("O", "o") if k % 2 == 0 else ("O",))
        left, right = rows.select(part, (F.col("r") + 1).alias("first"), F.col("hi").alias("left")), rows.select(part, F.col("r").alias("last"), F.col("lo").alias("right"))
        runs = runs.join(left, [part, "first"], "left").join(right, [part, "last"], "left").join(sizes, part)
        runs = runs.select(part, "first", "last", F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("right", "n_words").alias("right"), F.concat_ws(":", F.col(part).cast("string"), "first").alias("run")).filter("left < right")
        again = rows.join(runs, part).filter("r >= first AND r < last").join(texts, [part, "sentence"]).select("run", F.col("sentence").alias("pos"), "text")
        between = heard.join(runs, part).filter("pos >= left AND pos < right").select("run", "pos", "word")
        found = aligned(again, between, "run", weight).join(runs.select("run", part, "left"), "run")
        found = found.select(part, "sentence", (F.col("lo") + F.col("left")).alias("lo2"), (F.col("hi") + F.col("left")).alias("hi2"), F.col("score").alias("score2"))
        both = matches.join(found, [part, "sentence"], "left")
        matches = graded(both.select(part, "sentence", *[F.coalesce(f"{c}2", c).alias(c) for c in ("lo", "hi", "score")]))
        now = sure(matches)
        if now <= before:
            break
        before = now

    def forwards(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sentence").reset_index(drop=True)
        last, grades = 0, []
        for lo, hi, grade in zip(rows["lo"], rows["hi"], rows["reliability"], strict=True):
            if grade in ("O", "o"):
                grade, last = (grade, hi) if lo >= last else ("?", last)
            grades.append(grade)
        return rows.assign(reliability=grades)

    return matches.groupBy(part).applyInPandas(forwards, matches.schema)


def global_score(matches: DataFrame, sentences: DataFrame, part: str) -> DataFrame:
    """Score weighted by the letters of the sentences."""
    both = matches.join(sentences.select(part, F.col("pos").alias("sentence"), F.length(T.align_form(F.col("text"))).alias("n")), [part, "sentence"])
    return both.groupBy(part).agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("score"))


def best_cut(a: Column, b: Column, words: Column) -> Column:
    """After how many words the sum of both error rates is the smallest, the first such; -1 for fewer than two words."""
    joined = lambda x: T.align_form(F.array_join(x, ""))
    at = lambda i: F.struct((cer(T.align_form(a), joined(F.slice(words, F.lit(1), i))) + cer(T.align_form(b), joined(F.slice(words, i + 1, F.size(words))))).alias("score"), i.alias("i"))
    return F.when(F.size(words) > 1, F.array_min(F.transform(F.sequence(F.lit(1), F.size(words) - 1), at))["i"]).otherwise(-1)


def resolved(matches: DataFrame, part: str, most: int = 2) -> DataFrame:
    """Overlaps of up to `most` words between neighbours are cut where both fit best. (part, sentence, text, lo, hi, words), words being those
    of the span in their form for alignment, text too; each cut decides what the next one sees."""

    def fix(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sentence").reset_index(drop=True)
        lo, hi, words = rows["lo"].tolist(), rows["hi"].tolist(), [list(w) for w in rows["words"]]
        for k in range(len(rows) - 1):
            over = hi[k] - lo[k + 1]
            if lo[k + 1] < lo[k] or not 0 < over <= most:
                continue
            both = words[k][:-over] + words[k + 1]
            a, b = rows["text"][k], rows["text"][k + 1]
            if len(both) > 1:
                ends = range(1, len(both))
                score = distances(a, ["".join(both[:i]) for i in ends]) / max(1, len(a)) + distances(b, ["".join(both[i:]) for i in ends]) / max(1, len(b))
                cut = 1 + int(score.argmin())
                hi[k] -= len(words[k]) - cut
                lo[k + 1] = hi[k]
                words[k], words[k + 1] = both[:cut], both[cut:]
        return rows.assign(lo=lo, hi=hi, words=words)

    return matches.groupBy(part).applyInPandas(fix, matches.schema)


def word_alignment(reference: Column, hypothesis: Column) -> Column:
    """array of (reference word, hypothesis word), null where one has none: least cost, a substitution costing its character error rate. A pair
    takes memory in proportion to the root of one side's words times the other's; a null word counts as an empty one."""

    @F.pandas_udf("array<struct<reference:string,hypothesis:string>>")
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else [{"reference": p, "hypothesis": q} for p, q in aligned_words([w or "" for w in x], [w or "" for w in y])] for x, y in zip(a, b, strict=True)])

    return f(reference, hypothesis)


def boundary_error(a: DataFrame, b: DataFrame, part: str) -> DataFrame:
    """Mean of the squared differences of starts plus those of ends, row by row."""
    numbered = lambda d, s: d.select(part, F.row_number().over(Window.partitionBy(part).orderBy("start", "end")).alias("r"), F.col("start").alias("start" + s), F.col("end").alias("end" + s))
    both = numbered(a, "1").join(numbered(b, "2"), [part, "r"])
    return both.groupBy(part).agg(F.avg((F.col("start1") - F.col("start2")) ** 2 + (F.col("end1") - F.col("end2")) ** 2).alias("error"))


def _resampled(rows: DataFrame, sums: list[str], times: int) -> DataFrame:
    """s and the sums of columns over Poisson samples: a row counts k times in a sample with the odds of a Poisson number, drawn from a hash of
    its id and the sample's number, so results repeat. A task adds up its rows batch by batch and gives one row a sample."""
    odds = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 8)]))
    kind = ", ".join(f"{c} double" for c in sums)

    def run(batches):
        total = np.zeros((times, len(sums)))
        salt = (np.arange(1, times + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
        for b in batches:
            h, x = b["__h"].to_numpy().astype(np.uint64), b[sums].to_numpy(float)
            for i in range(0, len(h), 1000):
                z = (h[i : i + 1000] ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                total += np.searchsorted(odds, (z >> np.uint64(11)) * 2.0**-53, "right") @ x[i : i + 1000]
        yield pd.DataFrame({"s": np.arange(times), **{c: total[:, j] for j, c in enumerate(sums)}})

    parts = rows.select(F.xxhash64("id").alias("__h"), *[F.col(c).cast("double").alias(c) for c in sums]).mapInPandas(run, f"s bigint, {kind}")
    return parts.groupBy("s").agg(*[F.sum(c).alias(c) for c in sums])


def bootstrap(rows: DataFrame, edits: str, words: str, times: int = 1000, level: float = 0.95) -> DataFrame:
    """low, high of the error rate, by Poisson resampling of the rows (id, edits, words)."""
    rates = _resampled(rows, [edits, words], times).select((F.col(edits) / F.col(words)).alias("rate"))
    return rates.agg(F.percentile("rate", (1 - level) / 2).alias("low"), F.percentile("rate", (1 + level) / 2).alias("high"))


def paired_bootstrap(rows: DataFrame, a: str, b: str, words: str, times: int = 1000, level: float = 0.95) -> DataFrame:
    """low, high of the difference of two systems' error rates on the same rows (id, edits of both, words), and p_value: how often in
    the samples, counted twice as both sides matter, the one that is better on the whole is not."""
    rates = _resampled(rows, [a, b, words], times).select(((F.col(a) - F.col(b)) / F.col(words)).alias("d"))
    below, above = F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double"))
    return rates.agg(F.percentile("d", (1 - level) / 2).alias("low"), F.percentile("d", (1 + level) / 2).alias("high"), F.least(F.lit(1.0), F.least(below, above) * 2).alias("p_value"))

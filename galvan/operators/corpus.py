"""Relational operators on corpora: gates, vocabularies, n-grams, duplicates, roll-ups, runs and joins."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as T
from ..functions.alphabet import VALID_CHARS
from .shared import kept


def vocabulary(docs: DataFrame, tokens: Column, least: int = 1) -> DataFrame:
    """token, n: counted before the shuffle, as any hash aggregate."""
    return docs.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def masked_vocabulary(docs: DataFrame, text: Column) -> DataFrame:
    """token, n of `functions.text.masked_tokens`: words are counted as they stand, and each different one is masked once."""
    words = vocabulary(docs, T.split_words(text))
    masked = words.select(F.explode(T.masked_tokens(F.col("token"))).alias("token"), "n")
    return masked.groupBy("token").agg(F.sum("n").alias("n"))


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows; Spark keeps k rows of each partition only."""
    return df.orderBy(*order).limit(k)


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams, the last one too."""
    gram = lambda t: F.transform(t, lambda w, i: F.concat_ws(" ", w, *[F.get(t, i + k) for k in range(1, n)]))
    return T.bound(tokens, lambda t: F.slice(gram(t), F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(0))))


def ngram_counts(docs: DataFrame, tokens: Column, n: int, least: int = 1, heads_only: bool = False) -> DataFrame:
    return vocabulary(docs, ngrams(F.slice(tokens, 1, n) if heads_only else tokens, n), least).withColumnRenamed("token", "ngram")


def letter_counts(docs: DataFrame, text: Column) -> DataFrame:
    return vocabulary(docs, F.filter(F.split(text, ""), lambda c: c != "")).withColumnRenamed("token", "letter")


def first_of(df: DataFrame, key: list[Column], *order: Column) -> DataFrame:
    """One row for each key, the first in order. Aggregated before the shuffle, so a hot key costs a row a task."""
    rest = F.struct(*df.columns)
    picked = df.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(key)]).agg(F.min_by(rest, F.struct(*order)).alias("__row"))
    return picked.select("__row.*")


def head_key(text: Column, words: int = 3) -> Column:
    """md5 of the first lower-cased words."""
    return F.md5(F.array_join(F.slice(T.split_words(F.lower(text)), 1, words), " ").cast("binary"))


def shares(df: DataFrame, outer: str, inner: str, value: Column) -> DataFrame:
    """Totals by (outer, inner), by outer and of all, with their share of the whole."""
    rolled = df.groupBy(outer, inner).agg(F.sum(value).alias("total")).rollup(outer, inner).agg(F.sum("total").alias("total"))
    whole = df.agg(F.sum(value).alias("whole"))
    return rolled.join(F.broadcast(whole)).select(outer, inner, "total", (F.col("total") / F.col("whole")).alias("share"))


def histogram(df: DataFrame, value: Column, width: float, bins: int) -> DataFrame:
    """bin, n for all bins; what lies beyond the last is in it."""
    spark = df.sparkSession
    counted = df.select(F.least(F.floor(value / width), F.lit(bins - 1)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    return spark.range(bins).withColumnRenamed("id", "bin").join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def runs(df: DataFrame, part: list[str], order: str, same: str) -> DataFrame:
    """The rows with `run`, the number of the run of equal values they belong to."""
    w = Window.partitionBy(*part).orderBy(order)
    new = F.when(F.lag(same).over(w).isNull() | (F.lag(same).over(w) != F.col(same)), 1).otherwise(0)
    return df.withColumn("run", F.sum(new).over(w))


def offsets(df: DataFrame, part: list[str], order: str, length: str) -> DataFrame:
    """Where each row begins and ends if the rows of a part stand one after another."""
    end = F.sum(length).over(Window.partitionBy(*part).orderBy(order))
    return df.withColumn("end", end).withColumn("start", F.col("end") - F.col(length))


def with_gender(df: DataFrame, speakers: DataFrame) -> DataFrame:
    """A left lookup; of several rows of a speaker the first by `ord` counts."""
    known = speakers.groupBy("speaker").agg(F.min_by("gender", "ord").alias("gender"))
    return df.join(known, "speaker", "left")


def without(df: DataFrame, blacklist: DataFrame, *on: str) -> DataFrame:
    return df.join(blacklist, list(on), "left_anti")


def only(df: DataFrame, wanted: DataFrame, *on: str) -> DataFrame:
    return df.join(wanted, list(on), "left_semi")


def has_foreign_chars(text: Column, allowed: str = VALID_CHARS) -> Column:
    return text.rlike("[^" + T.chars(allowed)[1:])


def paragraphs(df: DataFrame, part: list[str], order: str, line: str) -> DataFrame:
    """Lines joined until one ends a sentence; blank lines and lines in capitals end what came before; what never ends is dropped."""
    w = Window.partitionBy(*part).orderBy(order)
    stripped = F.btrim(F.col(line))
    breaks = (stripped == "") | (F.upper(stripped).eqNullSafe(stripped) & stripped.rlike(r"\p{Lu}"))
    ends = stripped.rlike("[.?!]$") & ~breaks
    marked = df.select(*part, order, stripped.alias("line"), breaks.alias("breaks"), ends.alias("ends"))
    marked = marked.withColumn("p", F.sum(F.when(F.col("breaks") | F.coalesce(F.lag("ends").over(w), F.lit(False)), 1).otherwise(0)).over(w)).filter("NOT breaks")
    joined = marked.groupBy(*part, "p").agg(F.array_sort(F.collect_list(F.struct(order, "line"))).alias("lines"), F.max("ends").alias("ended"))
    return joined.filter("ended").select(*part, F.col("lines")[0][order].alias(order), F.array_join(F.transform("lines", lambda x: x["line"]), " ").alias("paragraph"))


def numbered(df: DataFrame, *by: Column | str, name: str = "row") -> DataFrame:
    """Adds row numbers from 1 in the order of `by`. Rows are dealt by ranges and sorted there; the ranges' sizes, a row each, give where their
    numbers begin, so no task sees all rows. Written in between, as ranges are drawn from a sample."""
    order = [F.col(c) if isinstance(c, str) else c for c in by]
    ranged = kept(df.repartitionByRange(*order).select("*", F.spark_partition_id().alias("__range")), "ranges")
    sizes = ranged.groupBy(F.col("__range").alias("__of")).agg(F.count("*").alias("__n"))
    before = sizes.select("__of", (F.sum("__n").over(Window.orderBy("__of")) - F.col("__n")).alias("__before"))
    within = ranged.withColumn("__i", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    return within.join(F.broadcast(before), F.col("__range") == F.col("__of")).withColumn(name, F.col("__before") + F.col("__i")).drop("__range", "__of", "__before", "__i")


def zipped(long: DataFrame, by: str, short: DataFrame, other: str) -> DataFrame:
    """Row by row in order, as far as the shorter one goes."""
    return numbered(long, by, name="__row").join(numbered(short, other, name="__row"), "__row").drop("__row")


def jaccard_share(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes of the intersection and the union of two one-column sets, and their ratio."""
    both, either = a.intersect(b).agg(F.count("*").alias("both")), a.union(b).distinct().agg(F.count("*").alias("either"))
    return both.join(F.broadcast(either)).select("both", "either", (F.col("both") / F.col("either")).alias("share"))


def sessions(df: DataFrame, part: list[str], start: str, end: str, gap: float) -> DataFrame:
    """Merges rows while the next starts less than `gap` after the latest end so far."""
    w = Window.partitionBy(*part).orderBy(start, end)
    latest = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    numbered = df.withColumn("session", F.sum(F.when(latest.isNull() | (F.col(start) - latest >= gap), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*part, "session").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n"))


def joined_segments(df: DataFrame, part: list[str]) -> DataFrame:
    """Subtitle rows (start, end, text) of a part joined in order: a row joins the one before, as joined so far, if that one ends open,
    this one starts open, the pause is under 1.5 s and the sum under 15 s; or if both are full, the pause under 2 s and the sum under 6 s.
    A task walks its sorted rows once and holds no more than the row that may still grow."""
    flags = (T.is_start_open(F.col("text")).alias("opens"), T.is_end_open(F.col("text")).alias("open"), T.is_full_sentence(F.col("text")).alias("full"))
    rows = df.select(*part, F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "text", *flags)
    ordered = rows.repartition(*part).sortWithinPartitions(*part, "start", "end", "text")
    out = df.select(*part).schema.add("start", "double").add("end", "double").add("text", "string")
    arrow = to_arrow_schema(out)

    def run(batches):
        last: dict | None = None

        def closed(row: dict) -> tuple:
            return (*(row[c] for c in part), row["start"], row["end"], row["texts"][0] if len(row["texts"]) == 1 else " ".join(t for t in row["texts"] if t is not None))

        for batch in batches:
            done = []
            for x in batch.to_pylist():
                pause = length = float("inf")
                if last is not None and all(x[c] == last[c] for c in part):
                    pause, length = (a - b if a is not None and b is not None else float("inf") for a, b in ((x["start"], last["end"]), (x["end"], last["start"])))
                if (last and last["open"] and x["opens"] and pause < 1.5 and length < 15) or (last and last["full"] and x["full"] and pause < 2 and length < 6):
                    last["texts"].append(x["text"])
                    last |= {"end": x["end"], "open": x["open"], "full": last["full"] and x["full"]}
                else:
                    if last is not None:
                        done.append(closed(last))
                    last = x | {"texts": [x["text"]]}
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(closed(last), arrow, strict=True)], schema=arrow)

    return ordered.mapInArrow(run, out)


def word_after(words: Column, wanted: Column) -> Column:
    """The word after the first one of `wanted`, without -se and -mañ at its end."""
    at = F.array_position(F.transform(words, lambda w: F.array_contains(wanted, F.lower(w))), F.lit(True))
    return F.when((at > 0) & (at < F.size(words)), F.regexp_replace(F.try_element_at(words, (at + 1).cast("int")), "-(?:se|mañ)$", ""))


def segment_id(prefix: Column, start: Column, end: Column) -> Column:
    """prefix-start-end in hundredths of a second, seven digits each."""
    part = lambda x: F.lpad(x.cast("bigint").cast("string"), 7, "0")
    return F.concat_ws("-", prefix, part(F.floor(start * 100)), part(F.ceil(end * 100)))


def quality_gate(words: Column, text: Column, least: int = 3, most: int = 15) -> Column:
    """Sentences fit for reading aloud: enough words, paired punctuation, no digits or foreign characters, full, no word in capitals."""
    n = F.size(words)
    return (n >= least) & (n <= most) & T.is_punct_paired(text) & ~text.rlike(r"\p{Nd}") & T.is_full_sentence(text) & ~F.exists(words, lambda w: (F.length(w) > 1) & w.rlike(r"^\p{Lu}+$"))

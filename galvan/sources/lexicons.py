"""Lexicons of any size as tables: scanned from files, and joined with words instead of travelling in the plan.

A folder has a file `<kind>.tsv` for each kind, or a folder `kind=<kind>`. Rows are (kind, word, said): what a set has is a word alone, what a pronouncing lexicon has is a
word and its pronunciations, and a dictionary gives a key and the words of its value. Spark broadcasts such a table where its size, which it
knows from files, is below `spark.sql.autoBroadcastJoinThreshold`, and shuffles both sides otherwise; the plan is the same for ten entries and
for millions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import phonetics
from ..functions.alphabet import FILLERS
from . import files

#: Kinds of files: plain sets, words with pronunciations, keys with values.
SETS = ("nouns_m", "nouns_f", "words", "stopwords", "interjections")
PRONOUNCED = ("acronyms", "first_names", "last_names", "places", "countries", "adjectives", "proper_nouns", "said_also", "said_only")
KEYED = ("corrected", "standard", "abbreviations", "ngrams", "units")
#: Kinds whose names have mutated forms beside them.
MUTATED = ("places", "first_names", "adjectives")
#: Whose pronunciation counts, the first of these that has one.
RANKS = ("acronyms", "letters", "first_names", "last_names", "places", "proper_nouns")
SCHEMA = "kind string, word string, said array<string>"


def scan(spark: SparkSession, folder: str, pattern: str = "*.tsv") -> DataFrame:
    """kind, word, said of all files of a folder, in one pass. Comments and blank lines don't count. Of a pronounced word the variants in the order
    of the file, each once, a word alone clearing what came before; of a key the last value."""
    kind = F.concat(*[F.regexp_extract("file", r"(?:/kind=([^/]+)/[^/]*|/([^/]+)\.tsv)$", i) for i in (1, 2)])
    text = files.ordered_lines(spark, folder, pattern).select(kind.alias("kind"), "ord", "line")
    plain = text.filter(F.col("kind").isin(*SETS)).select("kind", F.element_at(F.split("line", r"\s+"), 1).alias("word"), F.array().cast("array<string>").alias("said")).distinct()
    said = files.lexicon(text.filter(F.col("kind").isin(*PRONOUNCED)), "kind").select("kind", "word", F.col("prons").alias("said"))
    keyed = files.keyed(text.filter(F.col("kind").isin(*KEYED)), True, "kind").select("kind", F.col("key").alias("word"), F.col("value").alias("said"))
    mutable = F.col("kind").isin(*MUTATED)
    mutated = files.mutated_names(said.filter(mutable).withColumnRenamed("said", "prons"), "kind").select("kind", "word", F.col("prons").alias("said"))
    return plain.unionByName(said.filter(~mutable)).unionByName(mutated).unionByName(keyed)


def only(entries: DataFrame, *kinds: str) -> DataFrame:
    """word, said of some kinds."""
    return entries.filter(F.col("kind").isin(*kinds)).select("word", "said")


def named(words: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """The rows with `name`: whether every part of the word between hyphens is a name (word)."""
    parts = words.select(F.col(column).alias("w")).distinct().filter("w IS NOT NULL").select("w", F.explode(F.split("w", "-")).alias("p"))
    known = names.select(F.col("word").alias("p")).distinct().withColumn("in", F.lit(True))
    found = parts.join(known, "p", "left").groupBy("w").agg(F.bool_and(F.coalesce("in", F.lit(False))).alias("name"))
    return _with(words, column, found, "name")


def _with(rows: DataFrame, column: str, found: DataFrame, *added: str) -> DataFrame:
    """The rows and what was found of their word (w)."""
    right = found.toDF(*[f"__{c}" for c in found.columns])
    return rows.join(right, F.col(column) == F.col("__w"), "left").select(*[rows[c] for c in rows.columns], *[F.col(f"__{c}").alias(c) for c in added])


def _fixed(spark: SparkSession, entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pronunciations by the word as it is (p, exact), by its lower-cased form (l, lower), and those to add (p, also)."""
    some = entries.filter("size(said) > 0")
    letters = spark.createDataFrame([("letters", k, v) for k, v in phonetics.LETTER_NAMES.items()], SCHEMA)
    fillers = spark.createDataFrame([("fillers", k, [v]) for k, v in FILLERS.items()], SCHEMA)
    rank = F.array_position(F.array(*[F.lit(k) for k in RANKS]), F.col("kind"))
    exact = some.unionByName(letters).withColumn("r", rank).filter("r > 0").groupBy(F.col("word").alias("p")).agg(F.min_by("said", "r").alias("exact"))
    also = some.filter("kind = 'said_also'").groupBy(F.col("word").alias("p")).agg(F.first("said").alias("also"))
    instead = some.filter("kind = 'said_only'").join(also.select(F.col("p").alias("word"), "also"), "word", "left")
    instead = instead.select("kind", "word", F.concat("said", F.coalesce("also", F.array().cast("array<string>"))).alias("said"))
    lower = instead.unionByName(fillers).groupBy(F.col("word").alias("l")).agg(F.min_by("said", F.col("kind") == "fillers").alias("lower"))
    return exact, lower, also


def phonetized(words: DataFrame, column: str, entries: DataFrame) -> DataFrame:
    """The rows with `variants` and `errors`, as `functions.phonetics.phonetized` has them for a lexicon in the plan. Each different word, and
    each different part of one between hyphens, is looked up once."""
    exact, lower, also = _fixed(words.sparkSession, entries)
    none = F.array().cast("array<string>")
    parts = words.select(F.col(column).alias("w")).distinct().filter("w IS NOT NULL").select("w", F.posexplode(F.split(F.btrim("w"), "-")).alias("i", "p"))
    each = parts.select("p").distinct().withColumn("l", F.lower("p")).join(exact, "p", "left").join(lower, "l", "left").join(also, "p", "left")
    fixed, rule = F.coalesce("exact", "lower"), phonetics.by_rule(F.col("p"))
    each = each.select("p", F.coalesce(fixed, F.concat(F.array(rule["said"]), F.coalesce("also", none))).alias("said"), F.when(fixed.isNull(), rule["errors"]).otherwise(0).alias("errors"))
    found = parts.join(each, "p").groupBy("w").agg(F.array_sort(F.collect_list(F.struct("i", "said", "errors"))).alias("x"))
    found = found.select("w", phonetics.combined(F.col("x")).alias("x")).select("w", "x.variants", "x.errors")
    return _with(words, column, found, "variants", "errors")


def corrected(words: DataFrame, column: str, entries: DataFrame, *kinds: str) -> DataFrame:
    """The rows with `replaced`: the words that dictionaries of these kinds, the first before the others, give for the lower-cased word, with a
    capital if it had one; else null."""
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    best = entries.withColumn("r", rank).filter("r > 0 AND size(said) > 0").groupBy(F.col("word").alias("l")).agg(F.min_by("said", "r").alias("said"))
    found = words.select(F.col(column).alias("w")).distinct().filter("w IS NOT NULL").join(best, F.lower("w") == F.col("l"))
    upper: Column = F.regexp_extract("w", r"(\p{L})", 1).rlike(r"\p{Lu}")
    first = F.col("said")[0]
    capital = F.concat(F.array(F.concat(F.upper(F.substring(first, 1, 1)), F.substr(first, F.lit(2)))), F.slice("said", F.lit(2), F.greatest(F.size("said") - 1, F.lit(0))))
    return _with(words, column, found.select("w", F.when(upper, capital).otherwise(F.col("said")).alias("replaced")), "replaced")

"""Licence scans by an exact set-similarity join, in DataFrame operations only.

Words are runs of characters other than ASCII ones that are neither letters nor digits; only A-Z are lower-cased. The base finds three
phrases of consecutive words (PHRASES). The method finds every text block that contains at least `threshold` of the distinct
words of a licence notice (TEMPLATES). A block is s words of a text, across its lines, from a multiple of s / 2 on; a notice of n words is looked
for in blocks of the least power of two s that is 2n or more, so that any stretch of n words lies within a block, however its lines
are wrapped, and words that lie farther apart don't add up. A notice of fewer than WHOLE distinct words has to be there whole.

The words of the notices are ordered by how many documents hold them, rarest first. A block that reaches the threshold shares a word
with the prefix of a notice's ordered words (prefix filter), has at least as many words as must be shared (length filter), and
after the first shared word enough words are left on both sides (positional filter). What passes is verified exactly.

The notices are a parameter of at most MAX_TEMPLATES; they go into the plan as literals, so nothing that grows with the data is
broadcast. Only texts that hold a word of a prefix are cut into blocks, and only blocks that do are shuffled.

Defined results: a null or empty text has no words, no labels and score 0; a null doc_id is a row like others; repeated doc_ids and
repeated rows give a row each; a block that holds several notices has all of their labels; a containment equal to the threshold counts; the score is
1 with a base phrase, else the largest containment found; an empty table gives no rows; texts of any length are taken whole;
other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, table, written

#: Separators and word characters, as regular expressions.
_S, _W = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Fixed values: (label, notice), short forms and the notices that the licences ask for.
TEMPLATES = (
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0-notice",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike License"),
    ("cc-by-text", "This work is licensed under a Creative Commons Attribution License"),
    (
        "gpl-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
        "or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    ("gpl-text", "This work is licensed under the GNU General Public License"),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies.",
    ),
    ("mit", "Released under the MIT License"),
    (
        "mit-notice",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
        "so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as "
        "a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
)
THRESHOLD, WHOLE = 0.8, 12
MAX_TEMPLATES = 1000


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(text: str) -> list[str]:
    return sorted(set(re.findall(r"[a-z0-9]+", text.lower())))


def block_size(text: str) -> int:
    """Words of the blocks that a notice is looked for in."""
    return 1 << max(4, (2 * len(re.findall(r"[a-z0-9]+", text.lower())) - 1).bit_length())


def least_shared(words: int, threshold: float) -> int:
    return words if words < WHOLE else math.ceil(threshold * words - 1e-9)


def lowered(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def _phrase(words: str) -> str:
    return f"(?<!{_W})(?i:{f'{_S}+'.join(words.split())})(?!{_W})"


def count_words(c: Column) -> Column:
    """Pieces between separators, less empty ones at the ends."""
    edge = lambda at: F.substring(c, at, 1).rlike(_S).cast("int")
    return F.when(c == "", 0).otherwise(F.size(F.split(c, f"{_S}+")) - edge(1) - edge(-1)).cast("bigint")


def base(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_words and what the phrases give. Phrases share no words, so their places never overlap. Texts without all words
    of a phrase somewhere, nearly all of them, are told by plain substring searches."""
    every = "(?:" + "|".join(_phrase(p) for p, _ in PHRASES) + ")"
    may = F.lit(False)
    for phrase, _ in PHRASES:
        has_all = F.lit(True)
        for w in phrase.split():
            has_all = has_all & F.col("low").contains(w)
        may = may | has_all
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    texts = texts.select("doc_id", "t", lowered(F.col("t")).alias("low")).select("doc_id", "t", (may & F.col("t").rlike(every)).alias("found"))
    found = lambda x: F.when(F.col("found"), x)
    return texts.select(
        "doc_id",
        F.xxhash64("t").alias("row"),
        count_words(F.col("t")).alias("n_words"),
        found(F.regexp_count("t", F.lit(every))).otherwise(0).cast("bigint").alias("n_base"),
        found(count_words(F.regexp_extract("t", f"(?s)^(.*?){every}", 1))).alias("first_word"),
        found(count_words(F.regexp_extract("t", f"(?s)^(.*){every}", 1))).alias("last_word"),
        found(F.concat_ws(",", *[F.when(F.col("t").rlike(_phrase(p)), F.lit(label)) for p, label in sorted(PHRASES, key=lambda x: x[1])])).otherwise("").alias("base_labels"),
    )


def matches(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, row, label, containment of every block and notice that reach the threshold."""
    spark = docs.sparkSession
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates")
    sets = [(label, block_size(t), template_words(t)) for label, t in templates]
    vocabulary = sorted({w for _, _, ws in sets for w in ws})
    literal = lambda ws: F.array(*[F.lit(w) for w in ws])
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), F.split(lowered(F.col("text")), f"{_S}+").alias("words"))
    counted = texts.select(F.explode(F.array_intersect("words", literal(vocabulary))).alias("word")).groupBy("word").count()
    frequency = {r.word: r["count"] for r in counted.collect()}  # a row for each word of the notices at most
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    rows, prefixes, of_size = [], {}, {}
    for label, size, ws in sets:
        ordered = sorted(ws, key=rank.__getitem__)
        least = least_shared(len(ordered), threshold)
        prefix = ordered[: len(ordered) - least + 1]
        prefixes.setdefault(size, set()).update(prefix)
        of_size.setdefault(size, set()).update(ws)
        ranks = ",".join(str(rank[w]) for w in ordered)
        rows += [f"({size}, {rank[w]}, '{label}', {i}, {least}, array({ranks}), array({','.join(str(rank[x]) for x in prefix)}))" for i, w in enumerate(prefix)]
    index = spark.sql("SELECT * FROM VALUES " + ", ".join(rows) + " AS t(size, rank, label, at, least, ranks, prefix)")
    ranks_of = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, rank[w])])
    by_size = lambda of: F.element_at(F.create_map(*[x for k, ws in sorted(of.items()) for x in (F.lit(k), literal(sorted(ws)))]), F.col("size"))
    held = texts.filter(F.arrays_overlap("words", literal(sorted(set().union(*prefixes.values()))))).select("doc_id", "row", F.filter("words", lambda w: w != "").alias("words"))
    sized = held.select("*", F.explode(F.array(*[F.lit(k) for k in sorted(prefixes)])).alias("size")).filter(F.arrays_overlap("words", by_size(prefixes)))
    cut = F.transform(F.sequence(F.lit(0), F.size("words") - 1, F.expr("size div 2").cast("int")), lambda i: F.slice("words", i + 1, F.col("size")))
    blocks = sized.select("doc_id", "row", "size", F.explode(cut).alias("words")).filter(F.arrays_overlap("words", by_size(prefixes)))
    candidates = blocks.select("doc_id", "row", "size", F.size(F.array_distinct("words")).alias("n"), F.array_sort(F.transform(F.array_intersect("words", by_size(of_size)), lambda w: ranks_of[w])).alias("own"))
    candidates = written(candidates, "license-blocks")  # few blocks; and no filter on their ranks moves before the prefix filter
    pairs = candidates.select("doc_id", "row", "size", "n", "own", F.posexplode("own").alias("own_at", "rank")).join(F.broadcast(index), ["size", "rank"])
    pairs = pairs.filter(F.element_at(F.array_intersect("own", "prefix"), 1) == F.col("rank"))  # once a block and notice
    pairs = pairs.filter("n >= least").filter("1 + least(size(ranks) - at, size(own) - own_at) - 1 >= least")
    shared = F.size(F.array_intersect("own", "ranks"))
    return pairs.select("doc_id", "row", "label", "least", shared.alias("shared"), F.size("ranks").alias("of")).filter("shared >= least").select("doc_id", "row", "label", (F.col("shared") / F.col("of")).alias("containment"))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: the base columns, all labels and the score."""
    found = matches(docs, templates, threshold).groupBy("doc_id", "row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    own = F.filter(F.split("base_labels", ","), lambda x: x != "")
    labels = F.array_join(F.array_sort(F.array_union(own, F.coalesce("more", F.array().cast("array<string>")))), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    every = base(docs)
    same = every["doc_id"].eqNullSafe(found["doc_id"]) & (every["row"] == found["row"])
    both = packed(every.join(found, same, "left").select(every["doc_id"], "n_words", "n_base", "first_word", "last_word", "base_labels", "more", "best"), docs.count(), 100_000)
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def sql() -> str:
    """The same rows without any filter before the comparison."""
    sep = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    values = ", ".join(f"('{label}', {block_size(t)}, {least_shared(len(template_words(t)), THRESHOLD)}, [{', '.join(repr(w) for w in template_words(t))}])" for label, t in TEMPLATES)
    sizes = ", ".join(str(k) for k in sorted({block_size(t) for _, t in TEMPLATES}))
    place = lambda words: " AND ".join(f"w[i + {k}] = '{x}'" if k else f"w[i] = '{x}'" for k, x in enumerate(words.split()))
    lists = ", ".join(f"list_filter(range(1, len(w) + 1), lambda i: coalesce({place(p)}, false)) AS p{k}" for k, (p, _) in enumerate(PHRASES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, doc_id, list_filter(regexp_split_to_array(t, '{sep}'), lambda x: x <> '') AS w FROM d),
p AS (SELECT r, doc_id, len(w) AS n_words, {lists} FROM w),
q AS (SELECT *, p0 || p1 || p2 AS places, list_filter([{', '.join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(PHRASES))}], lambda x: x IS NOT NULL) AS own FROM p),
b AS (SELECT r, size, list_distinct(w[i + 1:i + size]) AS words FROM (SELECT r, w, size, unnest(range(0, len(w), size // 2)) AS i FROM (SELECT r, w, unnest([{sizes}]) AS size FROM w))),
m AS (SELECT r, label, max(len(list_intersect(words, ws)) / len(ws)) AS best FROM b JOIN (VALUES {values}) AS t(label, size, least, ws) USING (size)
      WHERE len(list_intersect(words, ws)) >= least GROUP BY r, label),
g AS (SELECT r, list(label) AS more, max(best) AS best FROM m GROUP BY r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) - 1 AS BIGINT) AS first_word, CAST(list_max(places) - 1 AS BIGINT) AS last_word,
       array_to_string(list_sort(own), ',') AS base_labels, array_to_string(list_sort(list_distinct(own || coalesce(more, []))), ',') AS labels,
       CAST(CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS DOUBLE) AS score
FROM q LEFT JOIN g USING (r)"""

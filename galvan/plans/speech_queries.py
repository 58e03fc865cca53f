"""Queries of metadata, alignment, metrics and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align as A
from ..operators import corpus as C
from ..operators import metadata as M
from ..operators import signal as S
from .registry import query, table


@query("g7_tags", "SELECT tag, string_agg(DISTINCT source, ',' ORDER BY source) AS files FROM (SELECT source, unnest(string_split(lang || ',' || source, ',')) AS tag FROM documents) WHERE tag <> '' GROUP BY tag")
def _(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("file"), F.array(F.struct(F.lit("x").alias("text"), F.create_map(F.lit("tags"), F.concat_ws(",", "lang", "source")).alias("meta"))).alias("regions"))
    return M.tags(rows).select("tag", F.array_join("files", ",").alias("files"))


_ASCII = "regexp_replace(lower({c}), '[^a-z ]', '', 'g')"


def _ascii(c):
    return F.regexp_replace(F.lower(c), "[^a-z ]", "")


def _pairs(spark, d, a, b):
    """Benchmark items with the documents of the same number, whole texts of both."""
    return table(spark, d, "benchmark").select("item_id", a.alias("a")).join(table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), b.alias("b")), "item_id")


_CER = f"SELECT item_id, round(levenshtein(a, b) / length(a), 9) AS cer FROM (SELECT b.item_id, {_ASCII.format(c='b.text')} AS a, {_ASCII.format(c='d.text')} AS b FROM benchmark b JOIN documents d ON b.item_id = d.doc_id)"


def _cer(spark, d):
    return _pairs(spark, d, _ascii("text"), _ascii("text")).select("item_id", F.round(A.cer(F.col("a"), F.col("b")), 9).alias("cer"))


def _wer(spark, d):
    p = A.wer_parts(F.col("a"), F.col("b"))
    return _pairs(spark, d, F.col("text"), F.col("text")).select("item_id", p["edits"].alias("edits"), p["words"].alias("words"))


# Whole texts; for words DuckDB has no edit distance of characters beyond ASCII, so brute force in the tests.
query("h11_cer", _CER)(_cer)
query("h11_wer")(_wer)


@query("h12_weighted_score", "SELECT event_type, round(sum(value * user_id) / sum(user_id), 6) AS value FROM events GROUP BY 1")
def _(spark, d):
    return A.weighted(table(spark, d, "events"), "value", F.col("user_id"), "event_type").withColumn("value", F.round("value", 6))


@query(
    "h3_neighbours",
    "SELECT conv_id, turn, coalesce(lag(turn + 1) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS prev, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), 99) AS next FROM conversations",
)
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.lag(F.col("turn") + 1).over(w), F.lit(0)).cast("bigint").alias("prev"), F.coalesce(F.lead("turn").over(w), F.lit(99)).cast("bigint").alias("next"))


@query(
    "h4_h5_unaligned_ranges",
    "WITH r AS (SELECT conv_id, role = 'user' AS good, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) SELECT conv_id, CAST(min(i) AS INT) AS first, CAST(max(i) + 1 AS INT) AS last FROM (SELECT *, i - row_number() OVER (PARTITION BY conv_id ORDER BY i) AS run FROM r WHERE NOT good) GROUP BY conv_id, run",
)
def _(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("sentence"), F.when(F.col("role") == "user", "O").otherwise("?").alias("reliability"))
    return A.unaligned_ranges(rows, "conv_id")


@query("h13_boundary_error", "SELECT conv_id, round(avg(0.25 + 1.0), 6) AS error FROM conversations GROUP BY 1")
def _(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", (F.col("turn") * 1.0).alias("start"), (F.col("turn") + 0.5).alias("end"))
    return A.boundary_error(rows, rows.select("conv_id", (F.col("start") + 0.5).alias("start"), (F.col("end") - 1).alias("end")), "conv_id").withColumn("error", F.round("error", 6))


@query("h14_bootstrap")
def _(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("value") > 50).cast("int").alias("edits"), F.lit(1).alias("words"))
    return A.bootstrap(rows, "edits", "words", 200)


@query(
    "k1_sessions",
    'SELECT user_id, session, min(t) AS start, max(t + 60) AS "end", count(*) AS n FROM (SELECT *, CAST(sum(CASE WHEN latest IS NULL OR t - latest >= 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, t + 60 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (SELECT *, max(t + 60) OVER (PARTITION BY user_id ORDER BY t, t + 60 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM (SELECT user_id, CAST(epoch(date_trunc(\'second\', ts)) AS BIGINT) AS t FROM events))) GROUP BY user_id, session',
)
def _(spark, d):
    e = table(spark, d, "events").select("user_id", F.unix_timestamp(F.date_trunc("second", "ts")).alias("start")).withColumn("end", F.col("start") + 60)
    return C.sessions(e, ["user_id"], "start", "end", 86400)


_FRAMES = "list_transform(range(CAST(greatest(1, ceil((len(embedding) - 16) / 8.0) + 1) AS BIGINT)), lambda i: sqrt(list_sum(list_transform(embedding[i * 8 + 1:i * 8 + 16], lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / 16))"


@query("k2_framed_rms", f"SELECT vec_id, i - 1 AS frame, round(e[i], 6) AS rms FROM (SELECT vec_id, e, unnest(range(1, len(e) + 1)) AS i FROM (SELECT vec_id, {_FRAMES} AS e FROM embeddings))")
def _(spark, d):
    e = S.framed_rms(F.col("embedding"), 16, 8)
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(e).alias("frame", "rms")).select("vec_id", F.col("frame").cast("bigint").alias("frame"), F.round("rms", 6).alias("rms"))


@query("k3_energy_threshold", f"SELECT vec_id, round(list_min(e) + (list_max(e) - list_min(e)) * 0.1, 6) AS threshold FROM (SELECT vec_id, {_FRAMES} AS e FROM embeddings)")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(S.threshold(S.framed_rms(F.col("embedding"), 16, 8)), 6).alias("threshold"))


@query("k4_k5_segments")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.explode(S.segments(40, 0.5)(F.col("embedding").cast("array<double>"))).alias("s")).select("vec_id", "s.start", "s.end")


@query("k7_peak_normalized", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) / list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))), 6) AS total FROM embeddings")
def _(spark, d):
    n = S.peak_normalized(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(n, F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("total"))


@query("k7_mixed", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 0.3 + 0.7 * CAST(x AS DOUBLE) / 2)), 6) AS total FROM embeddings")
def _(spark, d):
    m = S.mixed(F.col("embedding"), F.transform("embedding", lambda x: x.cast("double") / 2))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(m, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("k7_reverberated")
def _(spark, d):
    wet = S.reverberated([1.0, 0.5, 0.25])(F.col("embedding").cast("array<double>"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.array_max(wet), 6).alias("peak"))


@query("k8_piece", "SELECT vec_id, round(list_sum(list_transform(embedding[11:20], lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(S.piece(F.col("embedding"), 1.0, 2.0, 10), F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))

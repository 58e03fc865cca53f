"""Queries of sources, sinks and what is left of the other families."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import signal as S
from ..sources import files, sinks
from .registry import query, table
from .text_queries import _WORDS, _frame, lit


@query("a20_b6_elan", "SELECT CAST(conv_id AS VARCHAR) AS file, CAST(turn AS DOUBLE) AS start, turn + 1.0 AS \"end\", md5(text) AS text FROM conversations")
def _(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("file"), F.col("turn").cast("double").alias("start"), (F.col("turn") + 1.0).alias("end"), "text")
    return files.elan(sinks.elan_document(rows).withColumnRenamed("value", "text")).withColumn("text", F.md5("text"))


_TIME = "lpad(CAST(CAST({x} * 1000 AS BIGINT) // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST({x} * 1000 AS BIGINT) // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST({x} * 1000 AS BIGINT) // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST(CAST({x} * 1000 AS BIGINT) % 1000 AS VARCHAR), 3, '0')"


@query(
    "b3_subtitles",
    f"SELECT l_orderkey * 10 + l_linenumber AS n, concat_ws(chr(10), CAST(l_orderkey * 10 + l_linenumber AS VARCHAR), {_TIME.format(x='(l_quantity * 90.25)')} || ' --> ' || {_TIME.format(x='(l_quantity * 90.25 + 1.5)')}, l_returnflag, '') AS value FROM lineitem WHERE l_linestatus <> 'X'",
)
def _(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"), (F.col("l_quantity") * 90.25).alias("start"), (F.col("l_quantity") * 90.25 + 1.5).alias("end"), F.col("l_returnflag").alias("text"), F.col("l_linestatus").alias("reliability"))
    return sinks.exported(rows, "srt")


@query("b9_new_speakers", "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(spark, d):
    known = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return sinks.resumed(table(spark, d, "events").select("user_id").distinct(), known, "user_id")


@query("h15_real_time_factor", "SELECT event_type, round(sum(value) / sum(user_id + 1), 6) AS factor FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.sum("value") / F.sum(F.col("user_id") + 1), 6).alias("factor"))


@query("k6_noisy", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: greatest(-1.0, least(1.0, CAST(x AS DOUBLE) + CAST(x AS DOUBLE) * 0.5)))), 6) AS total FROM embeddings")
def _(spark, d):
    n = S.noisy(F.col("embedding"), F.col("embedding"), 0.5)
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(n, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("j28_mistake_gate", f"SELECT conv_id, turn FROM (SELECT conv_id, turn, {_WORDS} AS w FROM conversations) WHERE len(list_filter(w, lambda x: NOT regexp_matches(x, '^[A-Za-z]+[.,]?$'))) <= len(w) // 7")
def _(spark, d):
    words = text.split_words(F.col("text"))
    wrong = F.size(F.filter(words, lambda x: ~x.rlike("^[A-Za-z]+[.,]?$")))
    return table(spark, d, "conversations").filter(wrong <= F.floor(F.size(words) / 7)).select("conv_id", "turn")


@query("d7_word_types", f"SELECT w AS word, CASE WHEN w IN ('The', 'Der') THEN 'PLACE' WHEN upper(w) = w AND lower(w) <> w THEN 'ACRONYM' ELSE 'WORD' END AS type, count(*) AS n FROM (SELECT unnest(list_transform({_WORDS}, lambda x: trim(x, {lit('.,')}))) AS w FROM conversations) GROUP BY ALL")
def _(spark, d):
    words = table(spark, d, "conversations").select(F.explode(F.transform(text.split_words(F.col("text")), lambda x: F.btrim(x, F.lit(".,")))).alias("word"))
    places = _frame(spark, ["The", "Der"], "word").withColumn("place", F.lit(True))
    kind = F.when(F.col("place"), "PLACE").when((F.upper("word") == F.col("word")) & (F.lower("word") != F.col("word")), "ACRONYM").otherwise("WORD")
    return words.groupBy("word").agg(F.count("*").alias("n")).join(F.broadcast(places), "word", "left").select("word", kind.alias("type"), "n")

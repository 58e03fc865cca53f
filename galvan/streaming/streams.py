"""Streams: sessions by gaps, windowed counts and line-by-line normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import Lexicon
from ..functions.tokens import normalized


def lines(spark: SparkSession, path: str) -> DataFrame:
    """New text files of a folder, line by line."""
    return spark.readStream.text(path)


def normalized_lines(stream: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Stateless, so it keeps no more than a batch."""
    return stream.select("value", normalized(F.col("value"), lexicon).alias("normalized"))


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """key, start, end, n of runs of events; a pause of over `gap` ends one. State goes once the watermark has passed."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def rates(events: DataFrame, ts: str, length: str, slide: str, late: str = "10 minutes") -> DataFrame:
    """Counts in sliding windows."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")

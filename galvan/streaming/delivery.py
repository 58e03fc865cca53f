"""Results of a stream handed on utterance by utterance, and kept exactly once."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

#: (rows, batch) -> rows with the columns that were asked for.
Callback = Callable[[pd.DataFrame, int], pd.DataFrame]


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.schema("batch bigint").parquet(path).isEmpty()
    except AnalysisException:
        return False


class Delivery:
    """A `foreachBatch` function. The callback runs in the tasks over chunks of a batch's rows, of which each key is one; what it returns goes
    to `path`/data/batch=N, and then a marker to `path`/commits. A batch that comes again after its marker is skipped; one that failed
    before it writes its folder anew. So the table has each (batch, key) once; the callback may see a (batch, key) again after a failure."""

    def __init__(self, path: str, key: str, callback: Callback, schema: str) -> None:
        self.path, self.key, self.callback, self.schema = path.rstrip("/"), key, callback, schema

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark, callback = rows.sparkSession, self.callback
        marker = f"{self.path}/commits/batch={batch}"
        if _exists(spark, marker):
            return

        def run(chunks: Iterable[pd.DataFrame]):
            for chunk in chunks:
                if len(chunk):
                    yield callback(chunk, batch)

        rows.dropDuplicates([self.key]).mapInPandas(run, self.schema).write.mode("overwrite").parquet(f"{self.path}/data/batch={batch}")
        spark.range(1, numPartitions=1).select(F.lit(batch).alias("batch")).write.mode("overwrite").parquet(marker)


def delivered(stream: DataFrame, path: str, key: str, callback: Callback, schema: str, checkpoint: str) -> DataStreamWriter:
    """A writer, to be started, that hands each new row to `callback` and keeps what it returns."""
    return stream.writeStream.foreachBatch(Delivery(path, key, callback, schema)).option("checkpointLocation", checkpoint)


def received(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What was delivered, of batches that were finished."""
    path = path.rstrip("/")
    done = spark.read.schema("batch bigint").parquet(f"{path}/commits").select("batch").distinct()
    return spark.read.schema(f"{schema}, batch bigint").parquet(f"{path}/data").join(done, "batch", "left_semi")

"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text bytes that a Python worker handles at a time.
CHUNK_BYTES = 2 << 20
#: Rows of an Arrow batch between the JVM and a Python worker.
BATCH_ROWS = 256
#: Repeated doc_ids, with 24 bytes each, that are broadcast at most.
BROADCAST_IDS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of long texts small, so that workers stay within bounded memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, `spark.checkpoint.dir`. Only where it is unset and all is one process (a local
    master, as in tests) is a temporary one made; a cluster without it is an error, as executors would not see such a folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="galvan-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def packed(df: DataFrame, rows: int, per_task: int) -> DataFrame:
    """The same rows in fewer tasks and files, if there would be more than the cluster has cores and than `per_task` rows ask for."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // per_task)))


def written(df: DataFrame, what: str, rows: int | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there and lost executors cost nothing.
    rows: about how many there are, if that is known, so that small tables are few files."""
    spark = df.sparkSession
    if rows is not None:
        df = packed(df, rows, 200_000)
    path = f"{shared_dir(spark)}/galvan-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def content_key(df: DataFrame, *columns: str) -> Column:
    """A hash of the columns that there are, which is never null: rows of equal content have equal keys, with or without a doc_id."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns if c in df.columns])


def late_key(*columns: Column) -> Column:
    """A key among the 2^52 largest numbers, so behind nearly all doc_ids, of a row without a doc_id of its own."""
    return F.lit(2**63 - 1) - F.xxhash64(*columns).bitwiseAND(F.lit(2**52 - 1))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that the rows don't have, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_keyed(docs: DataFrame, name: str) -> DataFrame:
    """The rows with a key of their own, in the column `name`, which they don't have yet: doc_id, if no other row has it, or for the first of
    its rows by content; else a late key of content and number. It follows from content alone, so that it may be computed again."""
    h, i, n, first, of, _ = fresh(docs, "h", "i", "n", "first", "of", name)
    docs = docs.withColumn(h, content_key(docs, *docs.columns))
    repeated = docs.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(of)).agg(F.count("*").alias(n), F.min(h).alias(first)).filter(F.col(n) > 1)
    repeated = written(repeated, "repeated", 1)
    # few ids are repeated as a rule; if their number shows that, the texts stay where they are
    both = docs.join(F.broadcast(repeated) if repeated.count() <= BROADCAST_IDS else repeated, F.col("doc_id") == F.col(of), "left")
    alone = F.col("doc_id").isNotNull() & F.col(n).isNull()
    plain = both.filter(alone).withColumn(name, F.col("doc_id").cast("bigint"))
    odd = both.filter(~alone).withColumn(i, F.row_number().over(Window.partitionBy("doc_id", h).orderBy(h)))
    is_first = F.col("doc_id").isNotNull() & (F.col(h) == F.col(first)) & (F.col(i) == 1)
    odd = odd.withColumn(name, F.when(is_first, F.col("doc_id").cast("bigint")).otherwise(late_key(F.col(h), F.col(i)))).drop(i)
    return plain.unionByName(odd).drop(h, of, n, first)


def chunks(texts: pa.ChunkedArray | pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in slices of about `limit` characters; a null is an empty text, a very long text a slice of its own."""
    start, size, part = 0, 0, []
    for i, text in enumerate(texts.to_pylist()):
        text = text or ""
        if part and size + len(text) > limit:
            yield start, part
            start, size, part = i, 0, []
        part.append(text)
        size += len(text)
    if part:
        yield start, part


def map_texts(df: DataFrame, make: Callable[[], Callable[[list[str], pa.RecordBatch], dict]], schema: str, text: str = "text") -> DataFrame:
    """mapInArrow over (keys..., text): `make()` is called once a task; what it returns gets texts and the batch slice
    and gives columns in the order of `schema`."""
    small_batches(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    struct = _parse_datatype_string(schema)
    assert isinstance(struct, StructType)
    out = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for start, part in chunks(batch.column(text)):
                columns = f(part, batch.slice(start, len(part)))
                yield pa.RecordBatch.from_arrays([pa.array(columns[x.name], type=x.type) if not isinstance(columns[x.name], pa.Array) else columns[x.name].cast(x.type) for x in out], schema=out)

    return df.mapInArrow(run, struct)


def of_worker(key, make: Callable):
    """What `make` gives, kept by the Python worker for its later tasks."""
    kept = sys.modules.setdefault("galvan_worker", types.ModuleType("galvan_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


class WordHashes(dict):
    """word -> 64-bit hash, kept for as many words as memory allows."""

    LIMIT = 200_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def hashed_words(lists: list[list], cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, one list after another, and the lists' offsets."""
    offsets = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    h = np.fromiter(map(cache.__getitem__, chain.from_iterable(lists)), np.uint64, int(offsets[-1]))
    return h, offsets


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(h: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every k-word shingle, number of its list). A list of 1 to k-1 words is one shingle; an empty one has none."""
    n = np.diff(offsets)
    p = np.uint64(0x9E3779B97F4A7C15)
    if len(h) >= k:
        s = h[: len(h) - k + 1].copy()
        for j in range(1, k):
            s *= p
            s += h[j : len(h) - k + 1 + j]
    else:
        s = np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(n)), n)
    whole = doc[: len(s)] == doc[len(h) - len(s) :]
    s, d = mixed(s[whole]), doc[: len(s)][whole]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        extra = np.array([xxhash.xxh3_64_intdigest(h[offsets[i] : offsets[i + 1]].tobytes(), seed=k) for i in short], np.uint64)
        s, d = np.concatenate([s, extra]), np.concatenate([d, short])
        order = np.argsort(d, kind="stable")
        s, d = s[order], d[order]
    return s, d

"""Centroid clustering of integer vectors, exact to the last digit.

Distances are |x|^2 - 2 x.c + |c|^2 by one matrix product a block. All numbers are integers, so float64 is exact while every sum
stays below 2^53; a row for which that isn't certain from its largest component, and the largest of the centroids, takes the
integer path (64 bits where they suffice, else Python's integers). Ties go to the smaller number. Sums of a cluster are integers
too; tasks hand on one row of sums each, which RDD.treeAggregate adds, so a cluster that holds most rows costs no more than others,
and the driver gets a few parts of k times dim numbers.

Vectors are written once in packed form; each round reads them and writes nothing, so a lost executor costs the tasks it had.

Defined results: vectors that are null, have another length than `dim`, or hold null or non-finite components are left out (one
of 2^1014 and more, which has no float64 after scaling, counts as non-finite). Fewer vectors than `k` make as many centroids. Rows
of equal vec_id, or equal vectors, are vectors of their own; a null vec_id is kept, hashed as the empty text, and stays null. A
centroid without vectors stays where it is. A distance or inertia beyond 2^63 - 1 is null. No rows make no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .vectors import blocks, packed_vectors, summed

DIM, K, ROUNDS, SEED, SCALE = 64, 8, 10, 3, 1024
#: Integers below it are exact in float64.
EXACT = 1 << 53
LONG = (1 << 63) - 1


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row; x has integers as float64. Distances are int64, or Python's
    integers where some row needs them."""
    dim = x.shape[1]
    c_top = max(abs(v) for c in centroids for v in c)
    x_top = np.abs(x).max(1, initial=0)
    fast = 4 * dim * np.maximum(x_top, float(c_top)) ** 2 < EXACT
    cluster, distance = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64)
    if fast.any():
        a, c = x if fast.all() else x[fast], np.array(centroids, np.float64)
        d = np.einsum("ij,ij->i", a, a)[:, None] - 2 * (a @ c.T) + np.einsum("ij,ij->i", c, c)[None, :]
        best = d.argmin(1)
        cluster[fast], distance[fast] = best, d[np.arange(len(d)), best].astype(np.int64)
    rest = np.flatnonzero(~fast)
    if len(rest):
        small = dim * (2.0 * max(float(x_top.max()), float(c_top))) ** 2 < 2.0**62
        a = x[rest].astype(np.int64) if small else np.array([[int(v) for v in row] for row in x[rest]], object)
        c = np.array(centroids, np.int64 if small else object)
        d = np.stack([((a - row) ** 2).sum(1) for row in c], 1)
        best = d.argmin(1)
        cluster[rest] = best
        found = d[np.arange(len(rest)), best]
        if not small:
            distance = distance.astype(object)
        distance[rest] = found
    return cluster, distance


def sums_of(x: np.ndarray, cluster: np.ndarray, k: int) -> list[list[int]]:
    """Exact sums of the rows of each cluster."""
    top = float(np.abs(x).max(initial=0))
    if top * len(x) < EXACT:
        return [[int(v) for v in row] for row in (cluster[None, :] == np.arange(k)[:, None]).astype(np.float64) @ x]
    out = [[0] * x.shape[1] for _ in range(k)]
    for c, row in zip(cluster.tolist(), x, strict=True):
        out[c] = [a + int(v) for a, v in zip(out[c], row, strict=True)]
    return out


def _added(a: bytes, b: bytes) -> bytes:
    return json.dumps([[m + n for m, n in zip(p, q, strict=True)] for p, q in zip(json.loads(a), json.loads(b), strict=True)]).encode()


def totals(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """[count, inertia, sums...] of each cluster, over all vectors."""
    k, dim = len(centroids), len(centroids[0])

    def of_task(batches):
        out = None
        for _, x in blocks(batches, dim, "<f8"):
            cluster, d = nearest(x, centroids)
            count = np.bincount(cluster, minlength=k).tolist()
            inertia = [sum(d[cluster == i].tolist()) for i in range(k)]
            part = [[count[i], inertia[i], *s] for i, s in enumerate(sums_of(x, cluster, k))]
            out = part if out is None else [[m + n for m, n in zip(p, q, strict=True)] for p, q in zip(out, part, strict=True)]
        return out

    found = summed(vectors, of_task, _added)
    return json.loads(found) if found else [[0] * (dim + 2) for _ in centroids]


def _scaled(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        x = np.floor(SCALE * m)
    return x, np.isfinite(x).all(1)


def cluster(df: DataFrame, ids: str = "vec_id", vector: str = "embedding", dim: int = DIM, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, and size, the number of the cluster's vectors."""
    spark = df.sparkSession
    vectors = packed_vectors(df, ids, vector, dim, _scaled)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.orderBy(key, F.col("vec_id"), F.col("x")).limit(k).collect()
    schema = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string, size bigint"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = [[int(v) for v in np.frombuffer(r.x, "<f8")] for r in first]
    for _ in range(rounds):
        found = totals(vectors, centroids)
        moved = [[s // n for s in rest] if n else c for (n, _, *rest), c in zip(found, centroids, strict=True)]
        if moved == centroids:  # nothing changes from here on
            break
        centroids = moved
    found = totals(vectors, centroids)
    inertia = [x[1] for x in found]
    sizes = [x[0] for x in found]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    fits = lambda v: v if v <= LONG else None
    every = fits(sum(inertia))
    of_cluster = pa.array([fits(v) for v in inertia], pa.int64())
    types = [("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64()), ("cluster_inertia", pa.int64()), ("inertia", pa.int64()), ("centroid_sha256", pa.string()), ("size", pa.int64())]

    def run(batches):
        for vec_ids, x in blocks(batches, dim, "<f8"):
            c, d = nearest(x, centroids)
            at = pa.array(c)
            d = pa.array(d if d.dtype == np.int64 else [fits(int(v)) for v in d], pa.int64())
            yield pa.RecordBatch.from_arrays([vec_ids, at, d, of_cluster.take(at), pa.array([every] * len(c), pa.int64()), pa.array(digests).take(at), pa.array(sizes, pa.int64()).take(at)], schema=pa.schema(types))

    return vectors.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))

"""Whitening of vectors by a compensated covariance.

Counts and sums are exact integers. Rows are centred by the exact mean (its integer part in integers, the rest in float64) and
their outer products summed in double-double: a block is cut into slices of SLICE bits below its largest entry, so that the
matrix product of any two slices of up to BLOCK rows has no rounding (an error-free transformation of the product), and each such
product is added by two-sums. Tasks hand on a high and a low matrix each, which are added in double-double by a tree of tasks.
The eigenvectors come from LAPACK's symmetric solver: Householder reduction to a tridiagonal matrix, then divide and conquer.

The driver sees matrices of dim x dim only (dim is the length of a vector, not the number of rows), and solves one.

Defined results: vectors that are null or hold null or non-finite entries are left out, and so are those with an entry of 2^55 and
more, of which x is no safe 64-bit integer. Of vectors with different lengths, those of the most frequent length count (of
equally frequent ones, the shorter); the others, and empty ones, are left out. Rows of equal vec_id, or equal vectors, are rows of
their own; a null vec_id is kept. A component whose eigenvalue is no more than the rounding of the largest (dim * 2^-52 times it;
all, where rows are equal) has no direction: `whitened` is null there, and `identity_error` is over the others (null without any).
`explained` is null where nothing varies, `deviation` where it is beyond 2^63 - 1. No rows make no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .vectors import BLOCK, blocks, packed_vectors, summed, usable

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Bits of a slice: products of two, summed over a block, have at most 2 * SLICE - 2 + 12 = 52 bits.
SLICE, SLICES = 21, 4
LONG = (1 << 63) - 1
assert 2 * (SLICE - 1) + (BLOCK - 1).bit_length() <= 53


def two_sum(a, b):
    """The rounded sum and its error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def dd_add(a: tuple, b: tuple) -> tuple:
    """The sum of two double-doubles."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def slices(y: np.ndarray) -> list[np.ndarray]:
    """y as a sum of matrices, each a multiple of one power of two by less than 2^SLICE; what is left after SLICES of them is below the
    largest entry by 2^-80 and more."""
    out = []
    for _ in range(SLICES):
        top = np.abs(y).max(initial=0)
        if not top:
            break
        unit = np.ldexp(1.0, int(np.frexp(top)[1]) - SLICE + 1)
        sigma = 1.5 * 2.0**52 * unit
        part = (y + sigma) - sigma
        out.append(part)
        y = y - part
    return out


def outer_sums(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the outer products of the rows, as double-double."""
    hi = lo = np.zeros((y.shape[1], y.shape[1]))
    parts = slices(y)
    for i, a in enumerate(parts):
        for j in range(i, len(parts)):
            p = a.T @ parts[j]
            for q in (p,) if i == j else (p, p.T):
                hi, e = two_sum(hi, q)
                lo = lo + e
    return two_sum(hi, lo)


def _dd(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    m = np.frombuffer(raw)
    return m[: len(m) // 2], m[len(m) // 2 :]


def _raw(x: tuple) -> bytes:
    return np.concatenate([x[0].ravel(), x[1].ravel()]).tobytes()


def _merged(a: bytes, b: bytes) -> bytes:
    return _raw(dd_add(_dd(a), _dd(b)))


def _added(a: bytes, b: bytes) -> bytes:
    return json.dumps([m + n for m, n in zip(json.loads(a), json.loads(b), strict=True)]).encode()


def column_sums(x: np.ndarray) -> list[int]:
    """Exact sums of the columns of 64-bit integers."""
    return [int(h) * (1 << 32) + int(l) for h, l in zip((x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), strict=True)]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Of each row, the sum of (n * x - S)^2."""
    bound = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if bound < 1 << 62:
        d = n * x - np.array(sums, np.int64)
        if x.shape[1] * float(np.abs(d).max(initial=0)) ** 2 < 2.0**62:
            return (d * d).sum(1).tolist()
    out = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    return [v if v <= LONG else None for v in out]


def _integers(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = (np.abs(m) < 2.0**55).all(1)
    return np.floor(SCALE * np.where(keep[:, None], m, 0)).astype("<i8") + SHIFT, keep


def whiten(df: DataFrame, ids: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = df.sparkSession
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    v = F.col(vector)
    lengths = df.filter(usable(v) & (F.size(v) > 0)).groupBy(F.size(v).alias("dim")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "dim").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    dim = lengths[0].dim
    vectors = packed_vectors(df, ids, vector, dim, _integers)

    def counted(batches):
        out = None
        for _, x in blocks(batches, dim, "<i8"):
            part = [len(x), *column_sums(x)]
            out = part if out is None else [a + b for a, b in zip(out, part, strict=True)]
        return out

    found = summed(vectors, counted, _added)
    if not found:
        return spark.createDataFrame([], schema)
    n, *sums = json.loads(found)
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])

    def centred(x):
        return (x - whole).astype(np.float64) - rest

    def products(of_block):
        def of_task(batches):
            out = None
            for _, x in blocks(batches, dim, "<i8"):
                part = outer_sums(of_block(x))
                out = part if out is None else dd_add(out, part)
            return _raw(out) if out else None

        hi, lo = _dd(summed(vectors, of_task, _merged))
        side = int(len(hi) ** 0.5)
        return hi.reshape(side, side), lo.reshape(side, side)

    hi, lo = products(centred)
    values, directions = np.linalg.eigh((hi + lo) / n)
    values, directions = values[::-1][:components], directions[:, ::-1][:, :components]
    directions = directions * np.where(np.take_along_axis(directions, np.abs(directions).argmax(0)[None], 0) < 0, -1.0, 1.0)
    trace = float(np.trace(hi) + np.trace(lo)) / n
    real = values > max(float(values[0]), 0.0) * dim * 2.0**-52
    matrix = np.where(real, directions / np.sqrt(np.where(real, values, 1)), 0.0)
    # a column of ones beside the whitened ones brings their sums along, for centring
    hi, lo = products(lambda x: np.column_stack([centred(x) @ matrix[:, real], np.ones(len(x))]))
    made, mean = (hi + lo)[:-1, :-1] / n, (hi + lo)[-1, :-1] / n
    error = float(np.abs(made - np.outer(mean, mean) - np.eye(len(made))).max()) if real.any() else None
    explained = [float(v) / trace if trace else None for v in values]
    types = [("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())]
    wide = len(values)

    def run(batches):
        for ids_of_block, x in blocks(batches, dim, "<i8"):
            for i in range(0, len(x), 1024):
                part = x[i : i + 1024]
                each = np.repeat(np.arange(len(part)), wide)
                dev = pa.array(deviations(part, n, sums), pa.int64())
                w = pa.array((centred(part) @ matrix).ravel(), mask=np.tile(~real, len(part)))
                yield pa.RecordBatch.from_arrays(
                    [ids_of_block.slice(i, len(part)).take(pa.array(each)), pa.array(np.tile(np.arange(1, wide + 1, dtype=np.int32), len(part))), pa.array(np.full(len(each), n)), dev.take(pa.array(each)), w, pa.array(explained * len(part), pa.float64()), pa.array([error] * len(each), pa.float64())],
                    schema=pa.schema(types),
                )

    return vectors.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))

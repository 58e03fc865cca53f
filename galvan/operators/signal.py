"""Signals in array columns."""

from __future__ import annotations

from functools import lru_cache
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Zero crossings of the sinc on each side of a resampling kernel.
ZEROS = 16


def framed_rms(samples: Column, size: int, step: int) -> Column:
    """Root mean square of frames of `size` every `step`; the last one is padded with zeros."""
    n = F.size(samples)
    frames = F.greatest(F.lit(1), F.ceil((n - size) / step) + 1)
    energy = lambda i: F.sqrt(F.aggregate(F.slice(samples, (i * step + 1).cast("int"), F.lit(size)), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / size)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), frames - 1), energy)).otherwise(F.array().cast("array<double>"))


def threshold(energies: Column, ratio: float = 0.1) -> Column:
    low, high = F.array_min(energies), F.array_max(energies)
    return low + (high - low) * ratio


def peak_normalized(samples: Column) -> Column:
    peak = F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double"))))
    return F.when(peak > 0, F.transform(samples, lambda x: x.cast("double") / peak)).otherwise(F.transform(samples, lambda x: x.cast("double")))


def mixed(dry: Column, wet: Column, ratio: float = 0.7) -> Column:
    return F.zip_with(dry, wet, lambda d, w: d.cast("double") * (1 - ratio) + w.cast("double") * ratio)


def noisy(samples: Column, noise: Column, gain: float) -> Column:
    """Samples with noise added, clipped to [-1, 1]. The noise is a column, so that results repeat."""
    return F.zip_with(samples, noise, lambda s, n: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s.cast("double") + n.cast("double") * gain)))


def piece(samples: Column, start: float, end: float, rate: int) -> Column:
    return F.slice(samples, int(start * rate) + 1, int(end * rate) - int(start * rate))


def _rms(x: np.ndarray, size: int, step: int) -> np.ndarray:
    frames = max(1, -(-(len(x) - size) // step) + 1)
    padded = np.concatenate([x, np.zeros(max(0, (frames - 1) * step + size - len(x)))])
    sums = np.concatenate([[0.0], np.cumsum(padded * padded)])
    at = np.arange(frames) * step
    return np.sqrt(np.maximum(sums[at + size] - sums[at], 0) / size)


def split_once(x: np.ndarray, rate: int, ratio: float = 0.1, least_silence: float = 0.2) -> list[tuple[int, int]]:
    """Two parts around the longest silence, or halves without one; nothing if all is silence or too short."""
    size = int(0.1 * rate)
    step = size - int(0.05 * rate)
    e = _rms(x, size, step) if len(x) else np.zeros(0)
    if not len(e):
        return []
    loud = e >= e.min() + (e.max() - e.min()) * ratio
    edge = np.flatnonzero(np.diff(np.concatenate([[0], loud.view(np.int8), [0]])))
    voiced = [(int(a) * step, len(x) if b == len(e) else min(int(b) * step + size, len(x))) for a, b in zip(edge[::2], edge[1::2], strict=True)]
    if not voiced:
        return []
    gaps = [(voiced[i][0] - voiced[i - 1][1], -i) for i in range(1, len(voiced))]
    best = max((g for g in gaps if g[0] >= int(least_silence * rate) and g[0] > 0), default=None)
    if best:
        i = -best[1]
        return [(voiced[0][0], voiced[i - 1][1]), (voiced[i][0], voiced[-1][1])]
    half = len(x) // 2
    return [(0, half), (half, len(x))] if half else []


def segments(rate: int, longest: float = 10.0, ratio: float = 0.1, least_silence: float = 0.2):
    """A function of a samples column: parts of at most `longest` seconds, in seconds."""

    def of(x: np.ndarray) -> list[dict]:
        todo, done = [(0, len(x))], []
        while todo:
            a, b = todo.pop()
            parts = [] if (b - a) / rate <= longest else split_once(x[a:b], rate, ratio, least_silence)
            if parts:
                todo += [(a + s, a + t) for s, t in parts]
            else:
                done.append((a / rate, b / rate))
        return [{"start": s, "end": t} for s, t in sorted(done)]

    @F.pandas_udf("array<struct<start:double,end:double>>")
    def f(samples: pd.Series) -> pd.Series:
        return samples.map(lambda x: None if x is None else of(np.asarray(x, float)))

    return f


def reverberated(impulse: list[float]):
    """A function of a samples column: convolution with an impulse response, peaks normalised before and after."""
    peak = max(map(abs, impulse), default=0)
    ir = np.array(impulse, float) / (peak or 1)

    def normal(x: np.ndarray) -> np.ndarray:
        top = np.abs(x).max(initial=0)
        return x / top if top else x

    def wet(x: np.ndarray) -> np.ndarray:
        n = 1 << max(0, len(x) + len(ir) - 2).bit_length()
        return normal(np.fft.irfft(np.fft.rfft(normal(x), n) * np.fft.rfft(ir, n), n)[: len(x)]) if len(x) else x

    @F.pandas_udf("array<double>")
    def f(samples: pd.Series) -> pd.Series:
        return samples.map(lambda x: None if x is None else wet(np.asarray(x, float)))

    return f


@lru_cache(16)
def kernel(source: int, target: int, zeros: int = ZEROS) -> tuple[int, int, int, np.ndarray]:
    """(up, down, half, table): output sample m stands at input place m * down / up; row `phase` of the table holds the weights of the
    input samples from `half` before its whole place to `half` + 1 behind it, of a sinc cut at the lower of the two rates' limits and
    shaped by a raised cosine."""
    g = gcd(source, target)
    up, down = target // g, source // g
    cut = min(1.0, up / down)
    reach = zeros / cut
    half = int(np.ceil(reach))
    t = np.arange(up)[:, None] / up - np.arange(-half, half + 2)[None, :]
    return up, down, half, np.where(np.abs(t) < reach, cut * np.sinc(t * cut) * (0.5 + 0.5 * np.cos(np.pi * t / reach)), 0.0)


def resampled_part(x: np.ndarray, first: int, start: int, end: int, source: int, target: int, zeros: int = ZEROS) -> np.ndarray:
    """The output samples that stand within input places [start, end), from x, the input samples from place `first` on; what x doesn't have is
    silence."""
    up, down, half, table = kernel(source, target, zeros)
    m = np.arange(-(-start * up // down), -(-end * up // down), dtype=np.int64)
    if not len(m):
        return np.zeros(0)
    whole, phase = np.divmod(m * down, up)
    lo, hi = int(whole[0]) - half, int(whole[-1]) + half + 2
    padded = np.zeros(hi - lo)
    a, b = max(lo, first), min(hi, first + len(x))
    if a < b:
        padded[a - lo : b - lo] = x[a - first : b - first]
    out = np.empty(len(m))
    for i in range(0, len(m), 4096):
        w, p = whole[i : i + 4096], phase[i : i + 4096]
        windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 2)[w - half - lo]
        out[i : i + 4096] = np.einsum("ij,ij->i", windows, table[p])
    return out


def resampled(blocks: DataFrame, key: str, block: str, samples: str, source: int, target: int = 16000, zeros: int = ZEROS) -> DataFrame:
    """The blocks (key, block, samples) of signals at another rate, by a polyphase windowed sinc. A block gets the edges of its neighbours, so
    all blocks together are what the whole signal gives; each is a row of its own, and no signal is gathered. Blocks but the last of a
    signal need at least as many samples as the kernel reaches to one side (an error otherwise); null samples are none."""
    half = kernel(source, target, zeros)[2] + 1
    w = Window.partitionBy("k").orderBy("b")
    n = F.size("x")
    rows = blocks.select(F.col(key).alias("k"), F.col(block).alias("b"), F.coalesce(F.col(samples).cast("array<double>"), F.array().cast("array<double>")).alias("x"))
    rows = rows.withColumn("start", F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint"))
    short = F.raise_error(F.format_string("block %s of %s is shorter than the kernel", F.col("b").cast("string"), F.col("k").cast("string")))
    checked = F.when((n < half) & F.lead("b").over(w).isNotNull() & (n > 0), short.cast("array<double>")).otherwise(F.col("x"))
    tail = F.slice("x", F.greatest(n - half + 1, F.lit(1)), F.lit(half))
    before, after, then = F.lag(tail).over(w), F.lead(F.slice("x", 1, half)).over(w), F.lead(F.slice("x", 1, half), 2).over(w)
    none = F.array().cast("array<double>")
    rows = rows.select("k", "b", "start", n.cast("bigint").alias("n"), F.coalesce(before, none).alias("before"), checked.alias("x"), F.concat(F.coalesce(after, none), F.coalesce(then, none)).alias("after"))

    @F.pandas_udf("array<double>")
    def f(x: pd.Series, before: pd.Series, after: pd.Series, start: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([resampled_part(np.concatenate([b, v, a]).astype(float), s - len(b), s, s + k, source, target, zeros) for v, b, a, s, k in zip(x, before, after, start, n, strict=True)], dtype=object)

    return rows.select(F.col("k").alias(key), F.col("b").alias(block), f("x", "before", "after", "start", "n").alias(samples))

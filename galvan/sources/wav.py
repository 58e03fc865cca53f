"""RIFF/WAVE files: headers, samples in blocks, and writing.

Headers are read by ranges, so a file's length and form are known without its samples, and a long file is cut into blocks that different
tasks read. Samples are in [-1, 1); those of several channels are averaged.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of samples in a block.
BLOCK_BYTES = 4 << 20
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
HEADER = "codec string, channels int, rate int, bits int, offset bigint, bytes bigint, seconds double, truncated boolean, error string"


def header(read: Callable[[int, int], bytes], size: int) -> dict[str, Any]:
    """What the chunks of a file say, by `read(offset, n)`. A file without sound has an `error` and no length; one that is shorter than its
    header says is `truncated` and has the samples that are there. A data chunk of length 2^32 - 1 is one
    whose writer didn't know its length: it goes to the end, or as far as a ds64 chunk says."""
    out: dict[str, Any] = dict.fromkeys((x.split()[0] for x in HEADER.split(", ")), None) | {"truncated": False}
    start = read(0, 12)
    if len(start) < 12 or start[:4] not in (b"RIFF", b"RF64") or start[8:] != b"WAVE":
        return out | {"error": "no RIFF file"}
    at, kind, align, long = 12, None, 0, None
    while at + 8 <= size:
        name, n = struct.unpack("<4sI", read(at, 8))
        at += 8
        if name == b"ds64":
            long = struct.unpack("<8xQ", read(at, 16))[0]
        elif name == b"fmt ":
            raw = read(at, min(n, 40))
            if len(raw) < 16:
                return out | {"error": "short format chunk"}
            kind, channels, rate, _, align, bits = struct.unpack("<HHIIHH", raw[:16])
            if kind == EXTENSIBLE and len(raw) >= 26:
                kind = struct.unpack("<H", raw[24:26])[0]
            out |= {"codec": {PCM: "pcm", FLOAT: "float"}.get(kind, f"0x{kind:04x}"), "channels": channels, "rate": rate, "bits": bits}
        elif name == b"data":
            if kind is None:
                return out | {"error": "samples before their format"}
            if not (align and out["rate"] and out["channels"]):
                return out | {"error": "format without samples"}
            n = n if n != 0xFFFFFFFF else size - at if long is None else long
            there = max(0, min(n, size - at)) // align * align
            return out | {"offset": at, "bytes": there, "seconds": there / align / out["rate"], "truncated": n > size - at}
        at += n + n % 2
    return out | {"error": "no samples" if kind is not None else "no format chunk"}


def samples(raw: bytes, codec: str, bits: int, channels: int) -> np.ndarray:
    """Samples of whole frames, channels averaged."""
    wide = bits // 8
    if codec == "float" and wide in (4, 8):
        x = np.frombuffer(raw, f"<f{wide}").astype(np.float64)
    elif codec != "pcm" or wide not in (1, 2, 3, 4):
        raise ValueError(f"unknown samples: {codec}, {bits} bits")
    elif wide == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif wide == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{wide}") / float(1 << (bits - 1))
    return x.reshape(-1, channels).mean(1)


def pcm16(x: np.ndarray) -> bytes:
    """16-bit samples, rounded and clipped."""
    return np.clip(np.floor(np.asarray(x, float) * 32768 + 0.5), -32768, 32767).astype("<i2").tobytes()


def head(n_bytes: int, rate: int, channels: int = 1, bits: int = 16) -> bytes:
    """A header for n_bytes of samples."""
    align = channels * bits // 8
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", min(36 + n_bytes, 0xFFFFFFFF), b"WAVE", b"fmt ", 16, PCM, channels, rate, rate * align, align, bits, b"data", min(n_bytes, 0xFFFFFFFF))


class Writer:
    """Writes samples block by block to a file that can be rewound, and puts the sizes into its header at the end."""

    def __init__(self, sink: Any, rate: int) -> None:
        self.sink, self.rate, self.n = sink, rate, 0
        sink.write(head(0, rate))

    def add(self, x: np.ndarray) -> None:
        raw = pcm16(x)
        self.sink.write(raw)
        self.n += len(raw)

    def close(self) -> None:
        self.sink.seek(0)
        self.sink.write(head(self.n, self.rate))
        self.sink.seek(0, 2)


def _ranges(uri: str) -> tuple[Any, int]:
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path), fs.get_file_info(path).size


def probed(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """file, size, and of each file what its header says; `plain` is true for 16 kHz mono of 16 bits. Samples aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), F.col("length").alias("size"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file in b["file"]:
                f, size = _ranges(file)
                with f:
                    rows.append({"file": file, "size": size} | header(lambda at, n, f=f: f.read_at(n, at), size))
            yield pd.DataFrame(rows).astype({c: "Int64" for c in ("channels", "rate", "bits", "offset", "bytes")} | {"seconds": float})

    plain = (F.col("codec") == "pcm") & (F.col("rate") == 16000) & (F.col("channels") == 1) & (F.col("bits") == 16)
    return found.mapInPandas(run, f"file string, size bigint, {HEADER}").withColumn("plain", F.coalesce(plain, F.lit(False)))


def blocks(headers: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, block, rate, samples of the files of `probed`, each block read by itself; files with an error have none."""
    align = F.col("channels") * F.col("bits") / 8
    step = F.greatest(F.floor(F.lit(block_bytes) / align), F.lit(1)) * align
    cut = headers.filter("error IS NULL AND bytes > 0").withColumn("step", step.cast("bigint"))
    cut = cut.select("*", F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.col("step"))).alias("block", "first"))
    parts = cut.select("file", "block", "rate", "codec", "bits", "channels", (F.col("offset") + F.col("first")).alias("at"), F.least(F.col("step"), F.col("bytes") - F.col("first")).alias("n"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                f, _ = _ranges(r.file)
                with f:
                    x = samples(f.read_at(int(r.n), int(r.at)), r.codec, int(r.bits), int(r.channels))
                yield pd.DataFrame({"file": [r.file], "block": [r.block], "rate": [r.rate], "samples": [x]})

    return parts.repartition(F.col("file"), F.col("block")).mapInPandas(run, "file string, block int, rate int, samples array<double>")


def written(parts: DataFrame, folder: str, rate: int = 16000) -> DataFrame:
    """Writes (file, block, samples) as one WAV file of 16 bits for each `file`, and gives file, path, bytes. A task holds one block at a time;
    the header has the length from a count of all blocks, so it is right from the start and the store need not rewind."""
    totals = parts.groupBy(F.col("file").alias("__file")).agg(F.sum(F.size("samples")).alias("__n"))
    rows = parts.filter("file IS NOT NULL AND samples IS NOT NULL").select("file", "block", "samples").join(totals, F.col("file") == F.col("__file")).select("file", "block", "samples", F.col("__n").alias("n"))
    ordered = rows.repartition("file").sortWithinPartitions("file", "block")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(folder)
        name, sink, done = None, None, []

        def close() -> None:
            if sink is not None:
                sink.close()

        for b in batches:
            for r in b.itertuples():
                if r.file != name:
                    close()
                    name, path = r.file, f"{base}/{r.file}.wav"
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    sink = fs.open_output_stream(path, compression=None)
                    sink.write(head(2 * int(r.n), rate))
                    done.append((name, path, 44 + 2 * int(r.n)))
                sink.write(pcm16(r.samples))
        close()
        if done:
            yield pd.DataFrame(done, columns=["file", "path", "bytes"])

    return ordered.mapInPandas(run, "file string, path string, bytes bigint")


def encoded(rate: int = 16000) -> Callable[[Column], Column]:
    """A function of a samples column: a WAV file of 16 bits."""

    @F.pandas_udf("binary")
    def f(x: pd.Series) -> pd.Series:
        return x.map(lambda s: None if s is None else head(2 * len(s), rate) + pcm16(s))

    return f


def sliced(content: bytes, start: float, end: float) -> bytes:
    """The part of a WAV file between two times, its samples untouched."""
    h = header(lambda at, n: content[at : at + n], len(content))
    if h["error"]:
        raise ValueError(h["error"])
    align = h["channels"] * h["bits"] // 8
    a, b = (min(max(0, int(t * h["rate"])) * align, h["bytes"]) for t in (start, end))
    raw = content[h["offset"] + a : h["offset"] + max(a, b)]
    return head(len(raw), h["rate"], h["channels"], h["bits"]) + raw


def pieces(content: Column, start: Column, end: Column) -> Column:
    """`sliced` on columns; null where a file has no sound."""

    @F.pandas_udf("binary")
    def f(c: pd.Series, s: pd.Series, e: pd.Series) -> pd.Series:
        def one(x, a, b):
            try:
                return None if x is None else sliced(bytes(x), a, b)
            except ValueError:
                return None

        return pd.Series([one(*x) for x in zip(c, s, e, strict=True)], dtype=object)

    return f(content, start.cast("double"), end.cast("double"))

"""Sound: headers, blocks, writing and resampling."""

import io
import struct
import wave

import numpy as np
import pytest

from galvan.operators import signal
from galvan.sources import wav


def made(x, rate=16000, channels=1, wide=2):
    f = io.BytesIO()
    with wave.open(f, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(wide)
        w.setframerate(rate)
        w.writeframes(x)
    return f.getvalue()


def read(raw):
    return wav.header(lambda at, n: raw[at : at + n], len(raw))


def test_headers():
    raw = made(np.arange(100, dtype="<i2").tobytes(), 8000, 2)
    assert read(raw) == {"codec": "pcm", "channels": 2, "rate": 8000, "bits": 16, "offset": 44, "bytes": 200, "seconds": 50 / 8000, "truncated": False, "error": None}
    assert read(raw[:150])["bytes"] == 104 and read(raw[:150])["truncated"]
    extra = raw[:12] + b"LIST" + struct.pack("<I", 3) + b"abc\0" + raw[12:]
    assert read(extra)["offset"] == 56 and read(extra)["bytes"] == 200
    endless = raw[:40] + b"\xff" * 4 + raw[44:]
    assert read(endless)["bytes"] == 200 and read(endless)["seconds"] == 50 / 8000
    for bad, why in ((b"", "no RIFF file"), (b"RIFF\0\0\0\0WAVE", "no format chunk"), (raw[:36], "no samples"), (raw[:12] + raw[36:], "samples before their format"), (raw[:16] + b"\x02\0\0\0\1\0" + raw[36:], "short format chunk"), (b"x" * 100, "no RIFF file")):
        assert read(bad)["error"] == why and read(bad)["seconds"] is None
    zero = bytearray(raw)
    zero[24:28] = b"\0" * 4
    assert read(bytes(zero))["error"] == "format without samples"


@pytest.mark.parametrize("wide", [1, 2, 3, 4])
def test_samples(wide):
    values = np.array([0, 1, -1, 0.5, -0.25]) * 0.5
    top = 1 << (8 * wide - 1)
    ints = [int(v * top) + (128 if wide == 1 else 0) for v in values]
    raw = b"".join(i.to_bytes(wide, "little", signed=wide > 1) for i in ints)
    assert np.allclose(wav.samples(raw, "pcm", 8 * wide, 1), values, atol=1 / top)
    with pytest.raises(ValueError):
        wav.samples(raw, "0x0055", 16, 1)
    assert np.allclose(wav.samples(values.astype("<f4").tobytes(), "float", 32, 1), values)


def test_files(spark, tmp_path):
    r = np.random.default_rng(1)
    signals = {f"d/s{i}": [r.uniform(-1.2, 1.2, n) for n in (1000, 700, i)] for i in range(4)}
    rows = [(f, b, [float(v) for v in x]) for f, bs in signals.items() for b, x in enumerate(bs)] + [(None, 0, [0.0]), ("none", 0, None)]
    df = spark.createDataFrame(rows, "file string, block int, samples array<double>").repartition(5)
    out = wav.written(df, f"file://{tmp_path}/w", 8000).collect()
    assert {o.file: o.bytes for o in out} == {f: 44 + 2 * (1700 + i) for i, f in enumerate(signals)}
    (tmp_path / "w/bad.wav").write_bytes(b"nothing")
    (tmp_path / "w/other.txt").write_bytes(b"x")
    heads = wav.probed(spark, f"{tmp_path}/w")
    got = {h.file.split("/w/")[1][:-4]: h for h in heads.collect()}
    assert set(got) == {*signals, "bad"} and got["bad"].error == "no RIFF file" and not got["bad"].plain
    assert all(got[f].seconds == (1700 + i) / 8000 and got[f].rate == 8000 and not got[f].plain for i, f in enumerate(signals))
    found = {}
    for b in sorted(wav.blocks(heads, 600).collect(), key=lambda b: (b.file, b.block)):
        found.setdefault(b.file.split("/w/")[1][:-4], []).extend(b.samples)
    for f, bs in signals.items():
        assert np.abs(np.clip(np.concatenate(bs), -1, 32767 / 32768) - found[f]).max() <= 0.5 / 32768 + 1e-12


def test_writing_slicing_and_the_writer(spark):
    x = np.sin(np.arange(16000) / 20)
    df = spark.createDataFrame([(x.tolist(),), (None,), ([],)], "s array<double>").select(wav.encoded()("s").alias("c"))
    raw, none, empty = (r.c for r in df.collect())
    assert none is None and read(bytes(empty))["bytes"] == 0
    with wave.open(io.BytesIO(raw)) as w:
        assert (w.getnframes(), w.getframerate(), w.getnchannels(), w.getsampwidth()) == (16000, 16000, 1, 2)
    part = wav.sliced(bytes(raw), 0.25, 0.5)
    assert part[44:] == bytes(raw)[44 + 8000 : 44 + 16000] and read(part)["seconds"] == 0.25
    assert read(wav.sliced(bytes(raw), 0.9, 7))["seconds"] == pytest.approx(0.1) and read(wav.sliced(bytes(raw), 0.5, 0.1))["bytes"] == 0
    sink = io.BytesIO()
    writer = wav.Writer(sink, 16000)
    for i in range(0, 16000, 999):
        writer.add(x[i : i + 999])
    writer.close()
    assert sink.getvalue() == bytes(raw)


def test_pieces(spark):
    from pyspark.sql import functions as F

    raw = wav.head(8, 4) + wav.pcm16([0.1, 0.2, 0.3, 0.4])
    df = spark.createDataFrame([(raw, 0.25, 0.75), (b"junk", 0.0, 1.0), (None, 0.0, 1.0)], "c binary, s double, e double")
    got = [r.p for r in df.select(wav.pieces(F.col("c"), F.col("s"), F.col("e")).alias("p")).collect()]
    assert bytes(got[0]) == wav.head(4, 4) + wav.pcm16([0.2, 0.3]) and got[1:] == [None, None]


def plainly(x, source, target, zeros=signal.ZEROS):
    """Every output sample as a sum over all input samples."""
    cut = min(1.0, target / source)
    reach = zeros / cut
    n = np.arange(len(x))
    out = []
    for m in range(-(-len(x) * target // source)):
        t = m * source / target - n
        out.append(float(np.sum(np.where(np.abs(t) < reach, x * cut * np.sinc(t * cut) * (0.5 + 0.5 * np.cos(np.pi * t / reach)), 0))))
    return np.array(out)


@pytest.mark.parametrize(("source", "target"), [(44100, 16000), (8000, 16000), (16000, 16000), (22050, 16000), (48000, 16000)])
def test_resampling_by_blocks(spark, source, target):
    r = np.random.default_rng(2)
    sizes = {"a": [60, 90, 55, 70, 3], "b": [200], "c": [60, 1], "d": []}
    x = {k: r.normal(0, 1, sum(v)) for k, v in sizes.items()}
    rows = []
    for k, v in sizes.items():
        cuts = np.cumsum([0, *v])
        rows += [(k, i, x[k][a:b].tolist()) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    rows += [("e", 0, None)]
    got = signal.resampled(spark.createDataFrame(rows, "k string, b int, x array<double>").repartition(3), "k", "b", "x", source, target).collect()
    assert len(got) == len(rows)
    for k in x:
        whole = np.concatenate([np.zeros(0), *[r.x for r in sorted(got, key=lambda r: r.b) if r.k == k]])
        want = plainly(x[k], source, target)
        assert len(whole) == len(want) and np.allclose(whole, want, atol=1e-12)
        assert np.array_equal(whole, signal.resampled_part(x[k], 0, 0, len(x[k]), source, target))
    if source == target:
        assert np.allclose(np.concatenate([r.x for r in sorted(got, key=lambda r: r.b) if r.k == "a"]), x["a"])


def test_pass_band_and_alias():
    t = np.arange(44100) / 44100
    for tone, gain in ((1000, 1.0), (5000, 1.0), (10000, 0.0), (15000, 0.0)):
        y = signal.resampled_part(np.sin(2 * np.pi * tone * t), 0, 0, len(t), 44100, 16000)[200:-200]
        m = np.arange(200, 200 + len(y)) / 16000
        if gain:
            assert np.abs(y - np.sin(2 * np.pi * tone * m)).max() < 2e-3
        else:
            assert np.abs(y).max() < 2e-3


def test_short_blocks_are_an_error(spark):
    df = spark.createDataFrame([("a", 0, [1.0] * 100), ("a", 1, [1.0] * 5), ("a", 2, [1.0] * 100)], "k string, b int, x array<double>")
    with pytest.raises(Exception, match="shorter than the kernel"):
        signal.resampled(df, "k", "b", "x", 44100).collect()

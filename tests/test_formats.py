"""The formats against the plain readers, on files, archives and streams."""

import io
import os
import tarfile

import pytest

from galvan.operators import metadata
from galvan.sources import files, formats
from galvan.streaming import transcripts

ALI = {
    "x/a.ali": "{source: x}\n# c\n{speaker: Yann Gall; gender: m}\nDemat deoc'h {start: 1; end: 2.5}\r\n\r\nYa {YG} n'eo ket {start: 3; end: 4}\n",
    "b.ali": "one {start: 0; end: 1}\n{lang: fr} two",
    "empty.ali": "",
    "other.txt": "not a transcript",
    ".hidden.ali": "hidden {start: 0; end: 1}",
}
SRT = "1\n00:00:01,500 --> 00:00:03,000\nDemat\n deoc'h\n\n2\n01:10:03.250 --> 01:11:04.000 align:left\n&lt;i&gt;Ya&lt;/i&gt;&nbsp;\n\nnote\n\n02:03.000 --> 02:04.500\nlast\n"


@pytest.fixture
def folder(tmp_path, spark):
    formats.register(spark)
    for name, text in ALI.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    return tmp_path


def plain(rows):
    return sorted((os.path.basename(r.file), r.line, [(x.text, dict(x.meta)) for x in r.regions], r.start, r.end) for r in rows)


def test_ali(spark, folder):
    got = spark.read.format("ali").load(str(folder))
    want = [(n.split("/")[-1], r["line"], [(x["text"], x["meta"]) for x in r["regions"]], r["start"], r["end"]) for n, t in ALI.items() if n.endswith(".ali") and not n.startswith(".") for r in metadata.parse_file(metadata.lines_of(t))]
    assert plain(got.collect()) == sorted(want)
    assert plain(files.ali(spark, str(folder)).filter("NOT contains(file, 'hidden')").collect()) == sorted(want)
    few = spark.read.format("ali").schema("line int, file string").load(f"file://{folder}")
    assert sorted((r.line, os.path.basename(r.file)) for r in few.collect()) == sorted((x[1], x[0]) for x in want)
    each = spark.read.format("ali").option("taskBytes", 1).load(str(folder))
    assert each.rdd.getNumPartitions() == 3 and plain(each.collect()) == sorted(want)
    one = got.select("file").filter("file LIKE '%b.ali'").first().file
    only = spark.read.format("ali").option("taskBytes", 1).load(str(folder)).filter(f"file = '{one}'")
    assert {r.file for r in only.collect()} == {one} and only.rdd.getNumPartitions() == 1
    flat = spark.read.format("ali").option("recursive", "false").load(str(folder))
    assert {os.path.basename(r.file) for r in flat.collect()} == {"b.ali"}


def test_srt(spark, folder):
    (folder / "s.srt").write_text(SRT)
    (folder / "none.vtt").write_text("WEBVTT\n\n")
    got = spark.read.format("srt").load(str(folder)).drop("file").collect()
    want = files.subtitles(spark.createDataFrame([("s", SRT)], "file string, text string")).drop("file").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 3


@pytest.mark.parametrize("compressed", [True, False])
def test_archives(spark, tmp_path, compressed):
    formats.register(spark)
    texts = [(f"d/f{i}.{'ali' if i % 2 else 'txt'}", f"line {i}\n\nää {i}" * i) for i in range(20)] + [("null.txt", None), (None, "x")]
    made = formats.write_archives(spark.createDataFrame(texts, "member string, text string").repartition(3), f"file://{tmp_path}/out", compressed).collect()
    assert sum(r.members for r in made) == 21 and len(made) == 3
    read = spark.read.format("archive").option("chunkBytes", 7).load(f"{tmp_path}/out")
    found = {}
    for r in read.orderBy("member", "chunk").collect():
        found[r.member] = found.get(r.member, b"") + bytes(r.content)
        assert r.size == len((dict(texts)[r.member] or "").encode())
    assert {m: (t or "").encode() for m, t in texts if m} == found
    heads = spark.read.format("archive").schema("member string, size bigint").option("members", "ali").load(f"{tmp_path}/out")
    assert sorted((r.member, r.size) for r in heads.collect()) == sorted((m, len(t.encode())) for m, t in texts if m and m.endswith(".ali"))
    lines = {(r.member, r.line): r.text for r in spark.read.format("archive_lines").load(f"{tmp_path}/out").collect()}
    assert lines == {(m, i): x for m, t in texts if m for i, x in enumerate((t or "").split("\n")) if t}


def test_members_larger_than_a_chunk_and_odd_archives(spark, tmp_path):
    formats.register(spark)
    with tarfile.open(tmp_path / "a.tar.xz", "w:xz") as tar:
        big = tarfile.TarInfo("big.bin")
        big.size = 3_500_000
        tar.addfile(big, io.BytesIO(bytes(3_500_000)))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        tar.addfile(link)
        tar.addfile(tarfile.TarInfo("empty"))
    rows = spark.read.format("archive").load(str(tmp_path)).selectExpr("member", "chunk", "length(content) AS n").collect()
    assert sorted((r.member, r.chunk, r.n) for r in rows) == [("big.bin", 0, 1 << 20), ("big.bin", 1, 1 << 20), ("big.bin", 2, 1 << 20), ("big.bin", 3, 3_500_000 - (3 << 20)), ("empty", 0, 0)]


def test_streams_of_files(spark, folder, tmp_path):
    def run():
        stream = spark.readStream.format("numbered_lines").option("extensions", "ali").load(str(folder))
        q = transcripts.parsed(stream).writeStream.format("parquet").option("path", f"{tmp_path}/.out").option("checkpointLocation", f"{tmp_path}/.state").trigger(availableNow=True).start()
        assert q.awaitTermination(100)
        return spark.read.parquet(f"{tmp_path}/.out")

    first = run()
    assert plain(first.collect()) == plain(spark.read.format("ali").load(str(folder)).collect())
    (folder / "later.ali").write_text("{speaker: A B} late {start: 1; end: 2}")
    second = run()
    assert plain(second.collect()) == plain(spark.read.format("ali").load(str(folder)).collect())
    whole = spark.readStream.format("ali").load(str(folder)).writeStream.format("memory").queryName("whole_files").option("checkpointLocation", f"{tmp_path}/.state2").trigger(availableNow=True).start()
    assert whole.awaitTermination(100)
    assert plain(spark.table("whole_files").collect()) == plain(spark.read.format("ali").load(str(folder)).collect())

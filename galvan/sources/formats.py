"""Formats for `spark.read.format(...)` and `spark.readStream.format(...)`: `ali`, `srt`, `numbered_lines`, `archive`, `archive_lines`.

    formats.register(spark)
    spark.read.format("ali").load("corpus/")

Files are listed on the driver (names and sizes only) and dealt to tasks by size; a task reads its files as streams, line by line or
member by member, and holds no file whole. Columns that the given schema leaves out aren't made: without the columns of the lines an
archive gives its members from their headers alone. Filters on `file` (equal to, in) leave other files unread; `register` enables them.

A stream takes each new file once, in the order of time of change and name. Options: `extensions` (between commas), `recursive` (true),
`taskBytes` (64 MB), for archives `members` (extensions of members) and `chunkBytes` (1 MB).
"""

from __future__ import annotations

import io
import json
import re
import tarfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from ..operators.metadata import REGIONS, State

TASK_BYTES, CHUNK_BYTES = 64 << 20, 1 << 20


@dataclass
class Part(InputPartition):
    """Files that one task reads."""

    files: list[str]

    def __init__(self, files: list[str]) -> None:
        self.files = files


def opened(uri: str) -> Any:
    """The file's bytes as a stream, as they are stored."""
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_stream(path, compression=None, buffer_size=1 << 16)


class _Raw(io.RawIOBase):
    """A stream of Arrow's as one of Python's."""

    def __init__(self, stream: Any) -> None:
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, b: Any) -> int:
        data = self.stream.read(len(b))
        b[: len(data)] = data
        return len(data)


def lines(stream: Any) -> Iterator[str]:
    """Lines of UTF-8 text, a byte order mark left out; what is no UTF-8 is replaced."""
    text = io.TextIOWrapper(io.BufferedReader(_Raw(stream)), encoding="utf-8-sig", errors="replace", newline=None)
    for line in text:
        yield line[:-1] if line.endswith("\n") else line


class Format:
    """What a format's rows are; `rows` gives a dict a row, of the wanted columns at least."""

    name = columns = ""
    extensions: tuple[str, ...] = ()

    @staticmethod
    def rows(uri: str, stream: Any, wanted: frozenset[str], options: dict[str, str]) -> Iterator[dict]:
        raise NotImplementedError


class Ali(Format):
    name, columns, extensions = "ali", f"file string, line int, regions {REGIONS}, start double, end double", ("ali",)

    @staticmethod
    def rows(uri, stream, wanted, options):
        state = State()
        for i, line in enumerate(lines(stream)):
            line = line.strip()
            if not line or line.startswith("#"):
                continue
            row = {"file": uri, "line": i}
            if wanted & {"regions", "start", "end"}:
                regions, segment = state.line(line)
                row |= {"regions": [(x["text"], x["meta"]) for x in regions], "start": segment and segment[0], "end": segment and segment[1]}
            yield row


_TIME = r"(?:([0-9]+):)?([0-9]+):([0-9]+)[,.]([0-9]+)"
_TIMES = re.compile(rf"{_TIME} --> {_TIME}")


class Srt(Format):
    name, columns, extensions = "srt", "file string, n int, start double, end double, text string", ("srt", "vtt")

    @staticmethod
    def rows(uri, stream, wanted, options):
        seconds = lambda h, m, s, f: int(h or 0) * 3600 + int(m) * 60 + int(s) + int(f) / 1000
        n, block, text = 0, None, []

        def row():
            joined = re.sub("&lt;/?[a-zA-Z]+&gt;", "", " ".join(x.strip() for x in text)).replace("&nbsp;", "")
            return {"file": uri, "n": n, "start": seconds(*block[:4]), "end": seconds(*block[4:]), "text": joined.strip()}

        for line in lines(stream):
            if block is None:
                m = _TIMES.search(line)
                block, text = (m.groups(), []) if m else (None, [])
            elif line.strip():
                text.append(line)
            else:
                yield row()
                n, block = n + 1, None
        if block is not None:
            yield row()


class NumberedLines(Format):
    name, columns, extensions = "numbered_lines", "file string, line int, text string", ()

    @staticmethod
    def rows(uri, stream, wanted, options):
        for i, line in enumerate(lines(stream)):
            yield {"file": uri, "line": i, "text": line}


def _members(stream: Any, options: dict[str, str]) -> Iterator[tuple[tarfile.TarFile, tarfile.TarInfo]]:
    """The regular files of an archive, one after another, whatever its compression."""
    ends = tuple("." + x.strip().lstrip(".") for x in options.get("members", "").split(",") if x.strip())
    with tarfile.open(fileobj=stream, mode="r|*") as tar:
        for m in tar:
            if m.isfile() and (not ends or m.name.endswith(ends)):
                yield tar, m
            tar.members = []  # else all headers would stay in memory


class Archive(Format):
    """Members in chunks. Without `chunk` and `content` a member is one row, from its header."""

    name, columns, extensions = "archive", "file string, member string, size bigint, chunk int, content binary", ("tar", "tar.gz", "tgz", "tar.bz2", "tar.xz")

    @staticmethod
    def rows(uri, stream, wanted, options):
        step = int(options.get("chunkbytes", CHUNK_BYTES))
        for tar, m in _members(stream, options):
            row = {"file": uri, "member": m.name, "size": m.size}
            if not wanted & {"chunk", "content"}:
                yield row
                continue
            f = tar.extractfile(m)
            for chunk in range(max(1, -(-m.size // step))):
                yield row | {"chunk": chunk, "content": f.read(step)}


class ArchiveLines(Format):
    """Lines of the members of an archive."""

    name, columns, extensions = "archive_lines", "file string, member string, line int, text string", Archive.extensions

    @staticmethod
    def rows(uri, stream, wanted, options):
        for tar, m in _members(stream, options):
            for i, line in enumerate(lines(tar.extractfile(m))):
                yield {"file": uri, "member": m.name, "line": i, "text": line}


def listed(kind: type[Format], options: dict[str, str]) -> list[tuple[int, str, int]]:
    """(time of change, file, size) of the files of a path: a folder, a file, or several between commas."""
    given = options.get("extensions", "")
    ends = tuple("." + x.strip().lstrip(".") for x in (given.split(",") if given else kind.extensions))
    out = []
    for path in options["path"].split(","):
        fs, base = pafs.FileSystem.from_uri(path.strip())
        head = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://[^/]*", path.strip())
        info = fs.get_file_info(base)
        every = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(base, recursive=options.get("recursive", "true").lower() == "true"))
        for x in every:
            hidden = any(p.startswith(("_", ".")) for p in x.path[len(base) :].split("/") if p)
            if x.type == pafs.FileType.File and not hidden and (not ends or x.path.endswith(ends) or x is info):
                out.append((int((x.mtime.timestamp() if x.mtime else 0) * 1e6), (head[0] if head else "file://") + ("" if x.path.startswith("/") or head is None else "/") + x.path, x.size or 0))
    return sorted(out, key=lambda x: x[1])


def dealt(files: list[tuple[int, str, int]], task_bytes: int) -> list[Part]:
    """Files for tasks of about `task_bytes`."""
    out: list[Part] = []
    room = 0
    for _, name, size in files:
        if not out or size > room:
            out.append(Part([]))
            room = task_bytes
        out[-1].files.append(name)
        room -= size
    return out


class _Rows:
    """Reads parts; shared by batch and stream."""

    def __init__(self, kind: type[Format], options: dict[str, str], names: list[str]) -> None:
        self.kind, self.options, self.names = kind, options, names
        self.only: set[str] | None = None

    def parts(self, files: list[tuple[int, str, int]]) -> list[Part]:
        kept = [x for x in files if self.only is None or x[1] in self.only]
        return dealt(kept, int(self.options.get("taskbytes", TASK_BYTES)))

    def read(self, partition: Part) -> Iterator[tuple]:
        wanted = frozenset(self.names)
        for uri in partition.files:
            with opened(uri) as stream:
                for row in self.kind.rows(uri, stream, wanted, self.options):
                    yield tuple(row.get(n) for n in self.names)


class _Reader(_Rows, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("file",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = names if self.only is None else self.only & names
            else:
                yield f

    def partitions(self) -> list[Part]:
        return self.parts(listed(self.kind, self.options)) or [Part([])]


class _StreamReader(_Rows, DataSourceStreamReader):
    """An offset is the time and name of the last file taken."""

    def initialOffset(self) -> dict:
        return {"time": -1, "file": ""}

    def latestOffset(self) -> dict:
        time, name, _ = max(listed(self.kind, self.options), default=(-1, "", 0), key=lambda x: x[:2])
        return {"time": time, "file": name}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        at = lambda o: (o["time"], o["file"])
        return self.parts([x for x in listed(self.kind, self.options) if at(start) < x[:2] <= at(end)])

    def commit(self, end: dict) -> None:
        json.dumps(end)


class _Source(DataSource):
    kind: type[Format] = Format

    @classmethod
    def name(cls) -> str:
        return cls.kind.name

    def schema(self) -> str:
        return self.kind.columns

    def _given(self) -> dict[str, str]:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.kind, self._given(), schema.names)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.kind, self._given(), schema.names)


class AliSource(_Source):
    kind = Ali


class SrtSource(_Source):
    kind = Srt


class NumberedLinesSource(_Source):
    kind = NumberedLines


class ArchiveSource(_Source):
    kind = Archive


class ArchiveLinesSource(_Source):
    kind = ArchiveLines


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (AliSource, SrtSource, NumberedLinesSource, ArchiveSource, ArchiveLinesSource):
        spark.dataSource.register(source)


def write_archives(rows: DataFrame, folder: str, compressed: bool = True) -> DataFrame:
    """Writes rows (member, text) as members of an archive for each task and gives file, members. Members are written as they come. An
    archive's name follows from the number of its task, so a task that runs again writes its archive again."""
    name = "tar.gz" if compressed else "tar"

    def run(batches):
        import pandas as pd
        from pyspark import TaskContext

        fs, base = pafs.FileSystem.from_uri(folder)
        path = f"{base}/part-{TaskContext.get().partitionId():06d}.{name}"
        tar = sink = None
        n = 0
        for batch in batches:
            for member, text in zip(batch["member"], batch["text"], strict=True):
                if tar is None:
                    fs.create_dir(base, recursive=True)
                    sink = fs.open_output_stream(path, compression=None)
                    tar = tarfile.open(fileobj=sink, mode="w|gz" if compressed else "w|")
                raw = (text or "").encode()
                info = tarfile.TarInfo(member)
                info.size = len(raw)
                tar.addfile(info, io.BytesIO(raw))
                tar.members = []
                n += 1
        if tar is not None:
            tar.close()
            sink.close()
            yield pd.DataFrame({"file": [path], "members": [n]})

    return rows.select("member", "text").filter("member IS NOT NULL").mapInPandas(run, "file string, members bigint")

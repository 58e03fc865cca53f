"""Token ids in binary files, by Simple-8b word-aligned coding.

A 64-bit word holds a selector in its upper four bits and, in the other sixty, n values of b bits (see SELECTORS); n is as large
as the next values allow. Selector 0 is an escape: the word holds the index of a value of over sixty bits in its block's escape
table. A block has up to BLOCK ids; the block table gives where its words begin and how many words, escapes and ids it has, so
any block is decoded alone and all words of a selector at once.

File: the blocks (words, then escapes, little-endian 64 bits each), the block table, the document table (doc_id, number of ids),
and a footer of four words (words before the tables, blocks, documents, MAGIC). A file has documents in ascending order, and the
files, in the order of their part numbers, have all of them.

Ids: the word-level BPE of `tokenizers`. White space never joins tokens there, so texts are cut at ASCII white space and a worker
remembers the ids of chunks. The pieces of chunks in plain Latin letters go to the model itself; any other chunk goes through the
whole tokenizer.

Defined results: a null or empty text has the end id alone; rows with equal doc_ids each have their ids, ordered by text;
a null doc_id comes first and is kept as null; no rows make no ids; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunks, of_worker, shared_dir, small_batches, table, written
from .sentencepieces import gather

BLOCK = 1 << 16
MAGIC = 0x3842_5330_4E56_4C47
END_ID = 1
#: Selector -> (values, bits of each); selector 0 is the escape.
SELECTORS = {2: (60, 1), 3: (30, 2), 4: (20, 3), 5: (15, 4), 6: (12, 5), 7: (10, 6), 8: (8, 7), 9: (7, 8), 10: (6, 10), 11: (5, 12), 12: (4, 15), 13: (3, 20), 14: (2, 30), 15: (1, 60)}
_U = np.uint64
_COUNT = np.array([SELECTORS.get(s, (1, 0))[0] for s in range(16)], np.int64)
_POWERS = _U(1) << np.arange(1, 64, dtype=_U)
_BITS_16 = np.concatenate([[1], np.searchsorted(_POWERS, np.arange(1, 1 << 16).astype(_U), "right") + 1]).astype(np.uint8)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escapes) of unsigned 64-bit values."""
    v = np.asarray(values, _U)
    n = len(v)
    if not n:
        return np.zeros(0, _U), np.zeros(0, _U)
    bits = _BITS_16[v.astype(np.int64)] if int(v.max()) < 1 << 16 else np.searchsorted(_POWERS, v, "right").astype(np.uint8) + 1
    # widest value of the next 1, 2, 4, ... ; after the last one there is room for padding
    widest = {1: np.concatenate([bits, np.zeros(64, np.uint8)])}
    for k in (1, 2, 4, 8, 16):
        widest[2 * k] = np.maximum(widest[k][:-k], widest[k][k:])
    chosen = np.zeros(n, np.uint8)
    for s, (count, b) in reversed(SELECTORS.items()):
        k = 1 << count.bit_length() - 1
        chosen = np.where(np.maximum(widest[k][:n], widest[k][count - k : count - k + n]) <= b, np.uint8(s), chosen)
    step = _COUNT[chosen]
    starts, i, jumps = [], 0, step.tolist()
    while i < n:
        starts.append(i)
        i += jumps[i]
    starts = np.array(starts)
    sel = chosen[starts]
    words = sel.astype(_U) << _U(60)
    padded = np.concatenate([v, np.zeros(60, _U)])
    for s in np.unique(sel).tolist():
        rows = np.flatnonzero(sel == s)
        if s:
            count, b = SELECTORS[s]
            k = np.arange(count)
            words[rows] |= np.bitwise_or.reduce(padded[starts[rows][:, None] + k] << (k * b).astype(_U), axis=1)
        else:
            words[rows] |= np.arange(len(rows)).astype(_U)
    return words, v[starts[sel == 0]]


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The n values of a block."""
    sel = (words >> _U(60)).astype(np.int64)
    ends = np.cumsum(_COUNT[sel])
    out = np.empty(int(ends[-1]) if len(ends) else 0, _U)
    low = words & _U((1 << 60) - 1)
    for s in np.unique(sel).tolist():
        rows = np.flatnonzero(sel == s)
        if s:
            count, b = SELECTORS[s]
            k = np.arange(count)
            out[(ends[rows] - count)[:, None] + k] = (low[rows][:, None] >> (k * b).astype(_U)) & _U((1 << b) - 1)
        else:
            out[ends[rows] - 1] = escapes[low[rows].astype(np.int64)]
    return out[:n]


class Writer:
    """Writes one file, a block at a time."""

    def __init__(self, sink) -> None:
        self.sink, self.words, self.blocks, self.docs = sink, 0, [], []
        self.waiting, self.n_waiting = [], 0

    def add(self, doc_ids: list, counts: list[int], ids: np.ndarray) -> None:
        self.docs += zip(doc_ids, counts, strict=True)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // BLOCK * BLOCK
            for i in range(0, whole, BLOCK):
                self._block(ids[i : i + BLOCK])
            self.waiting, self.n_waiting = [ids[whole:]], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        words, escapes = pack(ids)
        self.sink.write(words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes())
        self.blocks += [(self.words, len(words), len(escapes), len(ids))]
        self.words += len(words) + len(escapes)

    def close(self) -> None:
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
        docs = [(-(1 << 63) if d is None else d, n) for d, n in self.docs]
        self.sink.write(np.array(self.blocks, "<u8").tobytes() + np.array(docs, "<i8").tobytes() + np.array([self.words, len(self.blocks), len(docs), MAGIC], "<u8").tobytes())


def read_file(f, size: int):
    """(doc_ids, counts) of a file, then its blocks of ids one after another."""
    f.seek(size - 32)
    words, n_blocks, n_docs, magic = np.frombuffer(f.read(32), "<u8").tolist()
    if magic != MAGIC:
        raise ValueError("not a token file")
    f.seek(words * 8)
    blocks = np.frombuffer(f.read(n_blocks * 32), "<u8").reshape(-1, 4)
    docs = np.frombuffer(f.read(n_docs * 16), "<i8").reshape(-1, 2)
    yield docs[:, 0], docs[:, 1]
    for at, n_words, n_escapes, n in blocks.tolist():
        f.seek(at * 8)
        raw = np.frombuffer(f.read((n_words + n_escapes) * 8), "<u8")
        yield unpack(raw[:n_words], raw[n_words:], n)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Letters that keep their form when normalised and have simple lower-case forms.
_LATIN = "À-ÖØ-öø-įı-ňŊ-ž"
_PLAIN = re.compile(f"[\x21-\x7e{_LATIN}]+")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^\\sa-z0-9{_LATIN}]+")


class Encoder:
    REMEMBERED = 300_000

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        own = {*range(33, 127), *range(161, 173), *range(174, 256)}
        other = iter(range(256, 512))
        self.of_byte = [chr(b) if b in own else chr(next(other)) for b in range(256)]
        self._forget()

    def _forget(self) -> None:
        self.pieces: dict[str, bytes] = {}
        self.flat, self.ends = array("I"), array("q", [0])
        self.rare: dict[bytes, int] = {}
        encoder = self

        class Rows(dict):
            """chunk -> row of its ids; once full, further chunks are kept for the texts at hand only."""

            def __missing__(self, chunk: bytes) -> int:
                full = len(self) >= encoder.REMEMBERED
                if full and (row := encoder.rare.get(chunk)) is not None:
                    return row
                encoder.flat.frombytes(encoder._ids(chunk.decode("utf-8", "surrogatepass")))
                encoder.ends.append(len(encoder.flat))
                (encoder.rare if full else self)[chunk] = row = len(encoder.ends) - 2
                return row

        self.rows = Rows()

    def _ids(self, chunk: str) -> bytes:
        """Ids of a chunk as 32-bit numbers."""
        if chunk.isascii() and chunk.isalpha():
            pieces = (chunk.lower(),)
        elif _PLAIN.fullmatch(chunk) and "<|" not in chunk:
            pieces = _PIECES.findall(chunk.lower())
        else:
            return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        out = b""
        known = self.pieces.get
        for p in pieces:
            ids = known(p)
            if ids is None:
                spelled = p if p.isascii() else "".join(self.of_byte[b] for b in p.encode())
                ids = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
                if len(self.pieces) < self.REMEMBERED:
                    self.pieces[p] = ids
            out += ids
        return out

    def encode(self, texts: list[str], end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, each text's with the end id, and their numbers."""
        lists = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        at = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(lists)), np.int64, int(n.sum()))
        flat, ends = np.array(self.flat, np.uint32), np.array(self.ends, np.int64)
        if len(self.rare) > 0.3 * len(at):  # other texts than those that were remembered
            self._forget()
        elif self.rare:
            kept = len(self.rows)
            del self.flat[self.ends[kept] :], self.ends[kept + 1 :]
            self.rare = {}
        ids, each = gather(flat, ends, at)
        sums = np.concatenate([[0], np.cumsum(each)])
        cuts = sums[np.concatenate([[0], np.cumsum(n)])]
        counts = np.diff(cuts)
        if end is None:
            return ids, counts
        return np.insert(ids, cuts[1:], end), counts + 1


def write(docs: DataFrame, folder: str, path: str | None = None) -> DataFrame:
    """Writes the ids of all documents to files in `folder`, which driver and executors share; gives part, file, n_ids, n_docs."""
    small_batches(docs.sparkSession)
    path = path or default_tokenizer()

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, base = pa.fs.FileSystem.from_uri(folder)
        name = f"{base}/{part:06d}-{uuid.uuid4().hex}.s8b"
        writer, n_ids, encoder, sink = None, 0, None, None
        for batch in batches:
            for start, texts in chunks(batch.column("text"), CHUNK_BYTES):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    sink = fs.open_output_stream(name)
                    writer, encoder = Writer(sink), of_worker(("tokens", path), lambda: Encoder(path))
                ids, counts = encoder.encode(texts)
                writer.add(batch.column("doc_id")[start : start + len(texts)].to_pylist(), counts.tolist(), ids)
                n_ids += len(ids)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name.removeprefix(base + "/")], "n_ids": [n_ids], "n_docs": [len(writer.docs)]}, schema=pa.schema([("part", pa.int64()), ("file", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64())]))

    ordered = docs.select(F.col("doc_id").cast("bigint"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(run, "part bigint, file string, n_ids bigint, n_docs bigint"), "manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, from the files."""
    parts = manifest.withColumn("first", F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    parts = parts.select("part", "file", F.coalesce("first", F.lit(0)).cast("bigint").alias("first")).repartitionByRange(max(1, manifest.count()), "part")  # a task for each file
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        fs, base = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{base}/{row['file']}"
                with fs.open_input_file(name) as f:
                    parts = read_file(f, fs.get_file_info(name).size)
                    doc_ids, counts = next(parts)
                    ends = np.cumsum(counts)
                    sums = np.zeros(len(counts), np.int64)
                    done, d = 0, 0
                    for ids in parts:
                        raw = memoryview(ids.astype("<u4").tobytes())
                        upto = done + len(ids)
                        while d < len(ends):
                            a, b = max(done, int(ends[d] - counts[d])), min(upto, int(ends[d]))
                            if b > a:
                                sums[d] = zlib.crc32(raw[4 * (a - done) : 4 * (b - done)], int(sums[d]))
                            if ends[d] > upto:
                                break
                            d += 1
                        done = upto
                    for i in range(0, len(counts), 10_000):
                        j = slice(i, i + 10_000)
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids[j], mask=doc_ids[j] == -(1 << 63)), pa.array(row["first"] + ends[j] - counts[j]), pa.array(counts[j]), pa.array(sums[j])], schema=schema)

    return parts.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/galvan-tokens-{uuid.uuid4().hex}"
    return read(write(table(spark, sf_dir, "documents"), folder), folder)

"""Streams: any split into batches gives the rows of the whole, a restart goes on, a batch that comes again writes nothing twice."""

import random
import time

import pandas as pd
import pytest
from pyspark.errors import AnalysisException

from galvan.operators import metadata
from galvan.streaming import delivery, transcripts

FILES = {
    "a": "{source: x}\n# note\n{speaker: Yann Gall; gender: m}\n\nDemat deoc'h {start: 1; end: 2.5}\n{Mari Bras: accent: leon}\n{speaker: Mari Bras; gender: f}Ya {YG} n'eo ket {start: 3; end: 4}\n{lang: fr} oui {lang: br} ya {start: 5; end: 6}\n{train: false}hep\n{YG}c'hoazh {start: 7; end: 8}",
    "b": "\n".join(f"{{speaker: P{i % 3} Q}} line {i} {{start: {i}; end: {i + 1}}}" for i in range(12)),
    "c": "no metadata at all",
    "d": "# only a comment",
}


def lines():
    return [(f, i, line) for f, t in FILES.items() for i, line in transcripts.numbered(t)]


def expected():
    return {(f, r["line"]): ([(x["text"], x["meta"]) for x in r["regions"]], r["start"], r["end"]) for f, t in FILES.items() for r in metadata.parse_file(t.splitlines())}


def feed(spark, folder, name, rows):
    spark.createDataFrame(rows, "file string, line int, text string").coalesce(1).write.parquet(f"{folder}/in/{name}")


def run(spark, folder, **options):
    stream = spark.readStream.schema("file string, line int, text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    q = transcripts.parsed(stream, **options).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    assert q.awaitTermination(100)
    assert q.exception() is None


def found(spark, folder):
    rows = spark.read.parquet(f"{folder}/out").collect()
    out = {(r.file, r.line): ([(x.text, x.meta) for x in r.regions], r.start, r.end) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("seed", [None, 3])
def test_transcript_stream_in_any_batches(spark, tmp_path, seed):
    rows = lines()
    if seed is not None:
        random.Random(seed).shuffle(rows)
    cuts = [0, 5, 6, 17, len(rows)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        feed(spark, tmp_path, f"{k}", rows[a:b])
    run(spark, tmp_path)
    assert found(spark, tmp_path) == expected()


def test_transcript_stream_restarts(spark, tmp_path):
    rows = lines()
    feed(spark, tmp_path, "0", rows[:7])
    run(spark, tmp_path)
    feed(spark, tmp_path, "1", rows[5:])  # two lines come again
    run(spark, tmp_path)
    assert found(spark, tmp_path) == expected()


def test_transcript_stream_options(spark, tmp_path):
    feed(spark, tmp_path, "0", [*lines(), (None, 0, "x"), ("a", None, "x")])
    run(spark, tmp_path, unwanted={"train": "false"})
    want = {(f, r["line"]): ([(x["text"], x["meta"]) for x in r["regions"]], r["start"], r["end"]) for f, t in FILES.items() for r in metadata.parse_file(t.splitlines(), unwanted={"train": "false"})}
    assert found(spark, tmp_path) == want


def until(holds):
    """Waits for it."""
    end = time.time() + 60
    while True:
        try:
            if holds():
                return
        except AnalysisException:  # nothing is written yet
            pass
        assert time.time() < end
        time.sleep(0.3)


def test_state_goes_after_its_time(spark, tmp_path):
    """Lines whose predecessors are forgotten wait for them."""
    feed(spark, tmp_path, "0", [("a", 0, "one"), ("a", 1, "two")])
    stream = spark.readStream.schema("file string, line int, text string").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = transcripts.parsed(stream, ttl_ms=1).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        until(lambda: set(found(spark, tmp_path)) == {("a", 0), ("a", 1)})
        time.sleep(1)
        feed(spark, tmp_path, "1", [("a", 2, "three"), ("b", 0, "one")])
        until(lambda: ("b", 0) in found(spark, tmp_path))
    finally:
        q.stop()
    assert set(found(spark, tmp_path)) == {("a", 0), ("a", 1), ("b", 0)}


SCHEMA = "id int, text string"


def test_delivery_of_a_batch_that_failed_and_came_again(spark, tmp_path):
    fail, seen = tmp_path / "fail", tmp_path / "seen"
    seen.mkdir()

    def callback(rows: pd.DataFrame, batch: int) -> pd.DataFrame:
        for i in rows["id"]:
            with (seen / f"{batch}-{i}").open("a") as f:
                f.write("x")
            if i == 7 and fail.exists():
                raise ValueError("the receiver is down")
        return rows.assign(text=rows["text"].str.upper())[["id", "text"]]

    for k in range(2):
        spark.createDataFrame([(5 * k + i, f"text {5 * k + i}") for i in range(5)] + [(5 * k, f"text {5 * k}")], SCHEMA).write.parquet(f"{tmp_path}/in/{k}")
    stream = lambda: spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 100).parquet(f"{tmp_path}/in")
    start = lambda: delivery.delivered(stream(), f"{tmp_path}/out", "id", callback, SCHEMA, f"{tmp_path}/check").trigger(availableNow=True).start()
    fail.touch()
    q = start()
    with pytest.raises(Exception, match="receiver is down"):
        q.awaitTermination(120)
    fail.unlink()
    start().awaitTermination(120)
    want = [(i, f"TEXT {i}") for i in range(10)]
    assert sorted((r.id, r.text) for r in delivery.received(spark, f"{tmp_path}/out", SCHEMA).collect()) == want
    # the batch comes again after it was finished: nothing is called or written
    before = {p.name: p.read_text() for p in seen.iterdir()}
    delivery.Delivery(f"{tmp_path}/out", "id", callback, SCHEMA)(spark.read.schema(SCHEMA).parquet(f"{tmp_path}/in/0"), 0)
    assert {p.name: p.read_text() for p in seen.iterdir()} == before
    assert sorted((r.id, r.text) for r in delivery.received(spark, f"{tmp_path}/out", SCHEMA).collect()) == want


def test_delivery_writes_an_unfinished_batch_anew(spark, tmp_path):
    d = delivery.Delivery(str(tmp_path), "id", lambda rows, batch: rows, SCHEMA)
    df = spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA)
    df.write.parquet(f"{tmp_path}/data/batch=4")  # as a run leaves it that ended before its marker
    d(spark.createDataFrame([(9, "z")], SCHEMA), 3)
    assert [r.id for r in delivery.received(spark, str(tmp_path), SCHEMA).collect()] == [9]
    d(df, 4)
    assert sorted((r.batch, r.id) for r in delivery.received(spark, str(tmp_path), SCHEMA).collect()) == [(3, 9), (4, 1), (4, 2)]

"""Annotated transcripts as a stream: what braces say holds for the rest of a file, however its lines arrive."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..operators.metadata import REGIONS, State, lines_of

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARSED = f"file string, line int, regions {REGIONS}, start double, end double"


def _fields(**kinds) -> StructType:
    return StructType([StructField(name, kind) for name, kind in kinds.items()])


class Transcript(StatefulProcessor):
    """One file: what holds now (speaker, gender, accent and other keys), who was heard before, the number of the next line, and lines that
    came before their turn."""

    def __init__(self, ttl: int | None, options: dict[str, Any]) -> None:
        self.ttl, self.options = ttl, options

    def init(self, handle: StatefulProcessorHandle) -> None:
        text = StringType()
        self.now = handle.getMapState("now", _fields(key=text), _fields(value=text), self.ttl)
        self.people = handle.getMapState("people", _fields(name=text), _fields(gender=text, accent=text), self.ttl)
        self.initials = handle.getMapState("initials", _fields(initials=text), _fields(name=text), self.ttl)
        self.waiting = handle.getMapState("waiting", _fields(line=IntegerType()), _fields(text=text), self.ttl)
        self.next = handle.getValueState("next", _fields(line=IntegerType()), self.ttl)

    def _state(self) -> State:
        state = State(**self.options)
        if self.next.exists():
            state.now = {k[0]: v[0] for k, v in self.now.iterator()}
            state.people = {k[0]: {"gender": v[0], "accent": v[1]} for k, v in self.people.iterator()}
            state.initials = {k[0]: v[0] for k, v in self.initials.iterator()}
        return state

    def _keep(self, state: State) -> None:
        for k, v in state.now.items():
            self.now.updateValue((k,), (v,))
        for name, p in state.people.items():
            self.people.updateValue((name,), (p["gender"], p["accent"]))
        for short, name in state.initials.items():
            self.initials.updateValue((short,), (name,))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        state = self._state()
        at = first = self.next.get()[0] if self.next.exists() else 0
        came = {r.line: r.text for r in rows if r.line >= at}
        waiting = {k[0]: v[0] for k, v in self.waiting.iterator()} if came else {}
        held = set(waiting)
        waiting |= came
        while at in waiting:
            line = (waiting.pop(at) or "").strip()
            if line and not line.startswith("#"):
                regions, segment = state.line(line)
                yield Row(file=key[0], line=at, regions=[Row(text=x["text"], meta=x["meta"]) for x in regions], start=segment and segment[0], end=segment and segment[1])
            at += 1
        for line in held - set(waiting):
            self.waiting.removeKey((line,))
        for line in set(waiting) - held:
            self.waiting.updateValue((line,), (waiting[line],))
        if at > first or not self.next.exists():
            self._keep(state)
            self.next.update((at,))


def parsed(lines: DataFrame, ttl_ms: int | None = None, **options) -> DataFrame:
    """file, line, regions, start, end of a stream of (file, line, text), as `operators.metadata.parsed` gives them for whole files.

    Lines are numbered from 0 in each file, blank ones and comments too. They may come in any batches and order: a line waits in the state
    until all before it have come; one that came already is ignored. State of a file that nothing came for in `ttl_ms` goes (None: never);
    with a `ttl_ms` the clock drives the query, so it goes on until it is stopped, also with a trigger for what is available now.
    options: those of `operators.metadata.State`."""
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = lines.select("file", F.col("line").cast("int").alias("line"), "text").filter("file IS NOT NULL AND line IS NOT NULL")
    return rows.groupBy("file").transformWithState(Transcript(ttl_ms, options), PARSED, "append", "processingTime" if ttl_ms else "none")


def numbered(text: str) -> Iterable[tuple[int, str]]:
    """The lines of a file as `parsed` takes them."""
    return enumerate(lines_of(text))

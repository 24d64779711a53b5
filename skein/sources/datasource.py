"""Transcript sources as Spark data sources: a batch reader of sessions, and a stream that follows appends."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from skein.runtime import ship
from skein.sources.adapters import create
from skein.sources.base import Found, content_hash

SUMMARY = "id string, agent string, project_id string, started_at string, last_activity_at string, message_count bigint, openable boolean, stamp string, place bigint, found string"
OPENED = "message_count bigint, content_hash string, session_json string, openable boolean, malformed bigint, unknown bigint, partial bigint, ignored bigint"
SCHEMA = "id string, agent string, project_id string, started_at string, last_activity_at string, " + OPENED + ", stamp string, place bigint"


def opened(adapter, f: Found) -> tuple:
    """id to last_activity_at of a session as opened, and the columns OPENED; nulls where it cannot be opened."""
    got = adapter.open(f)
    if got is None:
        return (f.id, f.agent, f.project_id, f.started_at, f.last_activity_at, f.message_count, None, None, False, 0, 0, 0, 0)
    s, k = got.session, got.skips
    return (s["id"], s["agent"], s["project_id"], s["started_at"], s["last_activity_at"], len(s["messages"]), content_hash(s), json.dumps(s, ensure_ascii=False), True, k.malformed, k.unknown, k.partial, k.ignored)


class _Sessions(InputPartition):
    def __init__(self, found: list[dict], first: int):
        self.found, self.first = found, first


class SessionReader(DataSourceReader):
    """Discovers on the driver; opens sessions on the executors, unless only summaries are asked for."""

    def __init__(self, options):
        self.name, self.root, self.each = options["source"], options["root"], int(options.get("sessions_per_partition", "64"))
        self.open = options.get("open", "true") == "true"

    def partitions(self):
        found = [asdict(f) for f in create(self.name, self.root).discover()]
        return [_Sessions(found[i : i + self.each], i) for i in range(0, len(found), self.each)] or [_Sessions([], 0)]

    def read(self, partition):
        adapter = create(self.name, self.root) if self.open else None
        for i, f in enumerate(partition.found, partition.first):
            if self.open:
                yield (*opened(adapter, Found(**f)), f["stamp"], i)
            else:
                yield (f["id"], f["agent"], f["project_id"], f["started_at"], f["last_activity_at"], f["message_count"], f["openable"], f["stamp"], i, json.dumps(f, ensure_ascii=False))


class SessionSource(DataSource):
    """spark.read.format("skein_sessions").option("source", name).option("root", folder), with option open=false for summaries"""

    @classmethod
    def name(cls):
        return "skein_sessions"

    def schema(self):
        return SCHEMA if self.options.get("open", "true") == "true" else SUMMARY

    def reader(self, schema):
        return SessionReader(self.options)


def open_found(found: DataFrame) -> DataFrame:
    """Opens summaries (with the columns source, root and found) on the executors: an adapter for each source and partition."""
    ship(found.sparkSession)

    def rows(batches):
        import pandas as pd

        from skein.sources.datasource import opened

        adapters: dict = {}
        for b in batches:
            for source, root, f in zip(b["source"], b["root"], b["found"]):
                if (source, root) not in adapters:
                    adapters[source, root] = create(source, root)
                one = opened(adapters[source, root], Found(**json.loads(f)))
                yield pd.DataFrame([one], columns=["id", "agent", "project_id", "started_at", "last_activity_at", "message_count", "content_hash", "session_json", "openable", "malformed", "unknown", "partial", "ignored"])  # a session may be large

    return found.select("source", "root", "found").mapInPandas(rows, SCHEMA.split(", stamp")[0])


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, first: bool):
        self.path, self.start, self.end, self.first = path, start, end, first


def last_line_end(path: Path, size: int, block: int = 1 << 16) -> int:
    """Where the last whole line of the first size bytes of a file ends; 0 if there is none."""
    with open(path, "rb") as f:
        while size > 0:
            a = max(0, size - block)
            f.seek(a)
            at = f.read(size - a).rfind(b"\n")
            if at >= 0:
                return a + at + 1
            size = a
    return 0


def range_lines(path: str, start: int, end: int, first: bool) -> Iterator[tuple[str, int, str]]:
    """The lines that begin in a range of a file; first says that a line begins where the range does."""
    with open(path, "rb") as f:
        pos = start
        f.seek(start if first else start - 1)
        if not first:
            pos += len(f.readline()) - 1  # the line before may end just here
        while pos < end:
            raw = f.readline()
            if not raw.endswith(b"\n"):
                return
            yield path, pos, raw[:-1].decode("utf-8", "replace")
            pos += len(raw)


class TailReader(DataSourceStreamReader):
    """Lines appended to files; the offset is a place in each file, a last line without an end waits.

    The driver only looks for the ends of the last lines; ranges of files are read by the executors.
    """

    def __init__(self, options):
        self.root, self.glob, self.each = Path(options["root"]), options.get("glob", "**/*.jsonl"), int(options.get("bytes_per_partition", str(32 << 20)))

    def initialOffset(self):
        return {}

    def latestOffset(self):
        return {str(p): last_line_end(p, p.stat().st_size) for p in sorted(self.root.glob(self.glob)) if p.is_file()}

    def partitions(self, start, end):
        out = []
        for path, b in end.items():
            a = start.get(path, 0)
            a = a if a <= b else 0  # a file that shrank was written anew
            out += [_Range(path, i, min(i + self.each, b), i == a) for i in range(a, b, self.each)]
        return out

    def read(self, partition):
        yield from range_lines(partition.path, partition.start, partition.end, partition.first)

    def commit(self, end):
        pass


class TailSource(DataSource):
    """spark.readStream.format("skein_tail").option("root", folder)"""

    @classmethod
    def name(cls):
        return "skein_tail"

    def schema(self):
        return "file string, byte_start bigint, line string"

    def streamReader(self, schema):
        return TailReader(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(SessionSource)
    spark.dataSource.register(TailSource)

"""The scan loop: passes over the sources, again and again, and streams of appended lines."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.datasource import register
from skein.store import Store


class Ticker(Protocol):
    """The clock of the loop; tests bring their own."""

    def now_ms(self) -> int: ...

    def wait_until(self, ms: int) -> None: ...

    def stop_requested(self) -> bool: ...


class Clock:
    def __init__(self):
        self.stopped = False

    def now_ms(self) -> int:
        return int(time.time() * 1000)

    def wait_until(self, ms: int) -> None:
        while not self.stopped and self.now_ms() < ms:
            time.sleep(min(0.2, max(0.0, (ms - self.now_ms()) / 1000)))

    def stop_requested(self) -> bool:
        return self.stopped


def reported(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """All sessions of the sources (name to root), opened, in one table; source_place and place tell the order of the reports."""
    register(spark)
    each = [spark.read.format("skein_sessions").option("source", n).option("root", r).load().withColumn("source_place", F.lit(i)) for i, (n, r) in enumerate(sources.items())]
    return reduce(DataFrame.unionByName, each)


def found(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """Summaries of all sessions of the sources, none of them opened; each knows its source and root."""
    register(spark)
    each = [spark.read.format("skein_sessions").option("source", n).option("root", r).option("open", "false").load().withColumns({"source_place": F.lit(i), "source": F.lit(n), "root": F.lit(r)}) for i, (n, r) in enumerate(sources.items())]
    return reduce(DataFrame.unionByName, each)


def scan(spark: SparkSession, store: Store, sources: dict[str, str], interval_s: float = 60, once: bool = False, since: str | None = None, dry_run: bool = False, ticker: Ticker | None = None, on_pass: Callable[[int, object], None] | None = None) -> int:
    """Passes with a pause counted from the end of the last; a pass that fails is reported and the loop goes on. Returns the passes."""
    ticker, n = ticker or Clock(), 0
    while True:
        try:
            result = store.sync(found(spark, sources), since=since, prune=False, dry_run=dry_run)
        except Exception as e:  # noqa: BLE001
            result = e
        n += 1
        if on_pass:
            on_pass(n, result)
        if once or ticker.stop_requested():
            return n
        ticker.wait_until(ticker.now_ms() + int(interval_s * 1000))
        if ticker.stop_requested():
            return n


def follow(spark: SparkSession, root: str, glob: str = "**/*.jsonl") -> DataFrame:
    """A stream of the lines appended under a folder: file, byte_start, line."""
    register(spark)
    return spark.readStream.format("skein_tail").option("root", root).option("glob", glob).load()

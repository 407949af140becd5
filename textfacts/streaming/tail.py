"""Logs as streams: growing tails and counts of diagnostics."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as X
from ..operators import logs, search
from ..sources import scan

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def log_lines(spark: SparkSession, path: str, glob: str = "*.log", keyword: str | None = None) -> DataFrame:
    """path, line and ts (the file's modification time) of lines as they are added in new files; a blank keyword is none."""
    got = spark.readStream.text(path, pathGlobFilter=glob).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"), F.col("_metadata.file_modification_time").alias("ts"))
    return got.where(X.contains_ci(F.col("line"), keyword)) if keyword and keyword.strip() else got


def diagnostic_counts(lines: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Diagnostics by severity and code in each window of `ts`; lines later than `late` don't count, which bounds the state."""
    found = logs.diagnostics(lines.withWatermark("ts", late))
    counted = found.groupBy(F.window("ts", window), "severity", "code").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("since"), "severity", "code", "n")


def tail_latest(spark: SparkSession, path: str, glob: str = "mcp-*.log", last: int = 200, keyword: str | None = None) -> DataFrame:
    """path, line_no and line: the last lines, which a keyword may filter before, of the log of a folder that was written last; of equally old ones the first by name.

    The folder alone is listed, without reading the logs; then the newest is read. No log gives no rows.
    """
    scan.register(spark)
    read = lambda text, names: spark.read.format("textfacts_files").options(levels="1", text=text, glob=names).load(path)
    newest = read("false", glob).orderBy(F.col("modified").desc(), "path").select("path").first()
    name = newest["path"] if newest else ""
    quoted = re.sub(r"([*?[])", r"[\1]", name)
    lines = search.file_lines((read("true", quoted) if name else read("false", "")).where(F.col("path") == name).select("path", "text"), "path")
    return search.tail(lines, ["path"], "line_no", "line", last, keyword).select("path", "line_no", "line").orderBy("line_no")


def growing(spark: SparkSession, path: str, glob: str = "*.log", levels: int = 1) -> DataFrame:
    """path, at and line of the lines that are added to a folder's logs, those of growing files too; `levels` folders deep."""
    scan.register(spark)
    return spark.readStream.format("textfacts_logs").option("glob", glob).option("levels", str(levels)).load(path)


class Ring(StatefulProcessor):
    """The last lines of a log as keyed state: as many slots as are kept, each written when its turn comes, and the number of lines so far."""

    def __init__(self, last: int) -> None:
        self.last = last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long")
        self.slots = handle.getMapState("slots", "slot int", "n long, line string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.seen.get()[0] if self.seen.exists() else 0
        # Only the last rows of a batch can stay, so only these are held.
        held: list[tuple[int, str]] = []
        more = 0
        for frame in rows:
            more += len(frame)
            held = heapq.nlargest(self.last, [*held, *zip(frame["at"].tolist(), frame["line"].tolist(), strict=True)], key=lambda x: x[0])
        first = n + more - len(held)
        for k, (_, line) in enumerate(reversed(held)):
            self.slots.updateValue(((first + k) % self.last,), (first + k + 1, line))
        n += more
        self.seen.update((n,))
        kept = sorted(v for _, v in self.slots.iterator())
        yield pd.DataFrame({"path": key[0], "line_no": pd.Series([v[0] for v in kept], dtype="int64"), "line": [v[1] for v in kept]})

    def close(self) -> None:
        pass


def ring_tail(lines: DataFrame, last: int = 200, keyword: str | None = None) -> DataFrame:
    """path, line_no and line: the last lines of each log that got new ones, at each batch; a keyword, in any case, filters before, and line_no counts what it leaves.

    lines are those of growing(). A log's state has at most `last` lines, however long it is, and a batch writes only the slots of its own lines.
    Use the output mode update. State is kept in RocksDB, for which the session is set.
    """
    if last < 1:
        raise ValueError("at least one line is kept")
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    if keyword and keyword.strip():
        lines = lines.where(X.contains_ci(F.col("line"), keyword))
    return lines.groupBy("path").transformWithStateInPandas(statefulProcessor=Ring(last), outputStructType="path string, line_no long, line string", outputMode="Update", timeMode="None")

"""Scanning documents as they arrive, each once, and undo logs as they are written.

What has been seen is keyed state of the stream, so a batch costs what it brings, however long the history is.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from docveil.shared import by_exchange

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which large states and transformWithState need."""
    held = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        if held is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, held)


def arriving(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def unscanned_only(pages: DataFrame, key: str = "page_uid", at: str | None = None, keep: str | None = None) -> DataFrame:
    """Each page once over the whole stream; the keys seen are the state.

    With at, a column of times, and keep, such as ``7 days``, a key is forgotten once the stream is so much later, and its page may come again.
    """
    if at is None or keep is None:
        return pages.dropDuplicates([key])
    return pages.withWatermark(at, keep).dropDuplicatesWithinWatermark([key])


def scan_stream(
    pages: DataFrame, scan: Callable[[DataFrame], DataFrame], out: str, log: str, checkpoint: str, policy: str = "scan", key: str = "page_uid", first: int = 0, at: str | None = None, keep: str | None = None
) -> StreamingQuery:
    """Scan new pages of each batch and add the findings to out; what was offered is written to log.

    policy scan scans them; skip and never mark them as seen without scanning.
    The batch number is part of what is written, so a batch that is run again after a failure replaces itself. What this stream has seen is
    its state, see unscanned_only(). A further stream over the same log has a checkpoint of its own, numbers its batches from first on, and passes over
    what the log has from batches before first.
    """
    if policy not in ("scan", "skip", "never"):
        raise ValueError(policy)
    spark = pages.sparkSession
    fresh, there = unscanned_only(pages, key, at, keep), spark._jvm.org.apache.hadoop.fs.Path(log)
    if first and there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(there):
        fresh = fresh.join(by_exchange(spark.read.parquet(log).where(F.col("batch") < first).select(key).distinct()), key, "left_anti")

    def batch(df: DataFrame, own: int) -> None:
        held = df.persist()
        if policy == "scan":
            scan(held).write.mode("overwrite").parquet(f"{out}/batch={first + own}")
        held.select(key).write.mode("overwrite").parquet(f"{log}/batch={first + own}")
        held.unpersist()

    with rocks_state(spark):
        return fresh.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Replayer(StatefulProcessor):
    """The line of versions of a session, where it stands on it, and how many versions were made. most: so many versions can be undone, older ones are forgotten."""

    def __init__(self, most: int | None, idle_ms: int | None):
        self.most, self.idle_ms = most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("line", "line array<int>, at int, made int", self.idle_ms)

    def walked(self, entries: list[tuple[int, str]]) -> list[int]:
        """The versions that the entries, by seq, show; the line is changed in its place, so an entry costs the same however long it is."""
        line, at, made = self.held.get() or ([0], 1, 0)
        line, versions = list(line), []
        for _, action in entries:
            if action == "do":
                made += 1
                del line[at:]
                line.append(made)
                if self.most is not None:
                    del line[: -self.most - 1]
                at = len(line)
            else:
                at = max(at - 1, 1) if action == "undo" else min(at + 1, len(line))
            versions.append(line[at - 1])
        self.held.update((line, at, made))
        return versions

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        entries = sorted((pair for r in rows for pair in zip(r["seq"].tolist(), r["action"].tolist(), strict=True)), key=itemgetter(0))
        yield pd.DataFrame({"session": key[0], "seq": [seq for seq, _ in entries], "version": self.walked(entries)})

    def close(self) -> None:
        pass


class RowReplayer(Replayer):
    """A Replayer that takes and gives rows: most sessions have few entries in a batch, for which frames of their own cost more than the replay."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        entries = sorted(((r["seq"], r["action"]) for r in rows), key=itemgetter(0))
        for (seq, _), version in zip(entries, self.walked(entries), strict=True):
            yield Row(session=key[0], seq=seq, version=version)


def replay_stream(log: DataFrame, most: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """(session, seq, version) of an arriving log (session, seq, action): what history.replay() gives, entry by entry.

    The state is one row for each session, forgotten after idle_ms without an entry; entries of a batch are taken by seq, and
    later batches have later entries. Start it within rocks_state().
    """
    kind = log.schema["session"].dataType.simpleString()
    rows = log.select("session", F.col("seq").cast("long").alias("seq"), "action").groupBy("session")
    return rows.transformWithState(RowReplayer(most, idle_ms), f"session {kind}, seq long, version int", "Append", "None" if idle_ms is None else "ProcessingTime")

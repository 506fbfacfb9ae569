"""A sink that writes one file for each row, as whole writes: all files of it are there at the end, or none.

Tasks write into folders of their own attempts, and list the names. The commit notes which attempts count, how many files were saved and how many
rows had failed; an abort deletes the attempts. So a task that is run again leaves nothing twice. Tasks then give the files of these attempts
their places, and what they have placed is logged, so neither the driver nor one task holds or moves all files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from docveil.shared import dealt_evenly

#: Where attempts lie below the folder, the report of the last write, the log of the names of all files, and which attempts count.
ATTEMPTS, REPORT, NAMES, DONE = "_attempts", "_report.json", "_names", "done.json"
#: Bytes of files that are handed on together when they are read.
TOGETHER = 1 << 24


@dataclass
class Attempt(WriterCommitMessage):
    """The folder of a task's attempt, and what it counted."""

    folder: str
    saved: int
    failed: int
    size: int


class FileWriter(DataSourceArrowWriter):
    """Writes (name, content); a null content is a row that failed before, which is counted."""

    def __init__(self, options: dict):
        self.store, self.path = fs.FileSystem.from_uri(options["path"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        folder, saved, failed, size = f"{self.path}/{ATTEMPTS}/{uuid.uuid4().hex}", 0, 0, 0
        self.store.create_dir(folder, recursive=True)
        try:
            with self.store.open_output_stream(f"{folder}.names") as names:
                for batch in iterator:
                    for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                        if not content.is_valid:
                            failed += 1
                            continue
                        held = content.as_buffer()
                        with self.store.open_output_stream(f"{folder}/{name}", buffer_size=None) as out:
                            out.write(held)
                        names.write(f"{name}\n".encode())
                        saved, size = saved + 1, size + len(held)
        except BaseException:
            with suppress(OSError):
                self.store.delete_dir(folder)
            raise
        return Attempt(folder, saved, failed, size)

    def commit(self, messages: list[Attempt | None]) -> None:
        done = [m for m in messages if m is not None]
        told = {"saved": sum(m.saved for m in done), "failed": sum(m.failed for m in done), "bytes": sum(m.size for m in done)}
        self.store.create_dir(f"{self.path}/{ATTEMPTS}", recursive=True)
        with self.store.open_output_stream(f"{self.path}/{ATTEMPTS}/{DONE}") as out:
            out.write(json.dumps({"attempts": [m.folder for m in done], "report": told}).encode())

    def abort(self, messages: list[Attempt | None]) -> None:
        with suppress(OSError):
            self.store.delete_dir(f"{self.path}/{ATTEMPTS}")


class DocumentFiles(DataSource):
    """``document_files``: files below path for each row (name, content), which write_files() then gives their places. Option: path."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options)


def named_apart(rows: DataFrame, name: str = "name", order: str = "pos") -> DataFrame:
    """rows with names that differ also without regard to case: a second of one name is numbered by order, and a number that is a name of its own is passed over.

    Names are numbered by name, so no task gets more than the rows of one.
    """
    from pyspark.sql import Window

    stem, end = F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?$", 2)
    k = F.row_number().over(Window.partitionBy(F.lower(name)).orderBy(order)) - 1
    numbered = rows.withColumn("__k", k).withColumn("__new", F.when(F.col("__k") == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), F.col("__k"), end)))
    clash = F.row_number().over(Window.partitionBy(F.lower("__new")).orderBy("__k", order)) - 1
    apart = F.when(clash == 0, F.col("__new")).otherwise(F.concat(F.regexp_replace("__new", r"(\.[^.]*)?$", ""), F.lit("__"), F.col("__k"), F.lit("_"), clash, end))
    return numbered.withColumn(name, apart).drop("__k", "__new")


def _place(spark: SparkSession, path: str, attempts: list[str]) -> None:
    """Moves the files of attempts to path, each attempt by one task, and logs their names. What a task has moved before it is run again is there already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, home = fs.FileSystem.from_uri(path)
        for batch in batches:
            for k in batch.column("id").to_pylist():
                with store.open_input_stream(f"{attempts[k]}.names") as f:
                    names = f.read().decode().split("\n")[:-1]
                for name in names:
                    try:
                        store.move(f"{attempts[k]}/{name}", f"{home}/{name}")
                    except OSError:
                        before, after = store.get_file_info([f"{attempts[k]}/{name}", f"{home}/{name}"])
                        if before.is_file or not after.is_file:
                            raise
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    each = spark.range(0, len(attempts), 1, max(1, len(attempts)))
    each.mapInArrow(run, "name string").write.mode("append").parquet(f"{path}/{NAMES}")


def write_files(rows: DataFrame, path: str, content: Column, name: str = "name", order: str = "pos", replace: bool = False) -> dict[str, int]:
    """One file for each row of rows (name, order, ...) below path, a URI; {saved, failed, bytes}.

    content is text, in UTF-8, or bytes; null for a row that could not be made. Names lose what file systems forbid; equal ones are numbered.
    With replace, files of the same name give way, else new ones are numbered too; the names that are there already come to the driver for it.
    """
    from docveil.functions.text import safe_filename

    spark, (store, folder) = rows.sparkSession, fs.FileSystem.from_uri(path)
    spark.dataSource.register(DocumentFiles)
    made = rows.select(safe_filename(F.col(name), width=200).alias("name"), F.col(order).alias("order"), content.cast("binary").alias("content"), F.lit(1).alias("new"))
    old = [] if replace else [x.base_name for x in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if x.is_file and x.base_name != REPORT]
    if old:
        there = spark.createDataFrame([(x,) for x in old], "name string")
        made = made.unionByName(there.withColumn("new", F.lit(0)), allowMissingColumns=True)
    apart = named_apart(made.withColumn("order", F.struct("new", "order")), "name", "order")
    apart.where("new = 1").select("name", "content").write.format("document_files").mode("append").options(path=path).save()
    with store.open_input_stream(f"{folder}/{ATTEMPTS}/{DONE}") as f:
        done = json.loads(f.read())
    _place(spark, path, done["attempts"])
    store.delete_dir(f"{folder}/{ATTEMPTS}")
    with store.open_output_stream(f"{folder}/{REPORT}") as out:
        out.write(json.dumps(done["report"]).encode())
    return report(path)


def report(path: str) -> dict[str, int]:
    """What the last write below path counted."""
    store, folder = fs.FileSystem.from_uri(path)
    with store.open_input_file(f"{folder}/{REPORT}") as f:
        return json.loads(f.read())


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of the files that write_files() has put below path. Their names come from its log, so the driver lists no files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, home = fs.FileSystem.from_uri(path)
        for batch in batches:
            names, held, size = [], [], 0
            for name in batch.column("name").to_pylist():
                with store.open_input_stream(f"{home}/{name}") as f:
                    held.append(f.read())
                names.append(name)
                size += len(held[-1])
                if size > TOGETHER:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(held, pa.binary())], ["name", "content"])
                    names, held, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(held, pa.binary())], ["name", "content"])

    # A file that gave way to another of its name is logged twice.
    return dealt_evenly(spark.read.schema("name string").parquet(f"{path}/{NAMES}").distinct()).mapInArrow(run, "name string, content binary")

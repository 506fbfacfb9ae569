"""Storage that the driver and all executors share, and global numbering."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Paths that materialize() has written and nothing has deleted, with their sessions.
_THERE: dict[str, SparkSession] = {}
#: The lists of tables() blocks that are open, the innermost last.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("docveil_tables", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Only in local mode, and only where the setting is missing, a temporary
    folder stands in for it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="docveil-")
    spark.sparkContext.setCheckpointDir(f"file://{folder}")
    return f"file://{folder}"


@contextlib.contextmanager
def tables() -> Iterator[list[str]]:
    """The paths of the tables that materialize() writes inside, for delete_tables() when nothing reads them any more.

    Operators return frames that are still to be computed from such tables, so only
    the caller knows when they can go. What nobody deletes goes when Python ends.
    """
    held: list[str] = []
    token = _OPEN.set((*_OPEN.get(), held))
    try:
        yield held
    finally:
        _OPEN.reset(token)


@contextlib.contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Deletes the shuffle files of what runs inside as soon as it has ended: a written table needs none of them.

    Where other jobs of the application run at the same time they are left to Spark's own cleaner.
    """
    status, context = spark.sparkContext.statusTracker(), spark._jsc.sc()
    alone, first = not status.getActiveJobsIds(), context.newShuffleId()
    yield
    last, cleaner = context.newShuffleId(), context.cleaner()
    if alone and cleaner.isDefined() and not status.getActiveJobsIds():
        for k in range(first + 1, last):
            cleaner.get().doCleanupShuffle(k, False)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as Parquet into the shared folder and read it again.

    It cuts the lineage like a checkpoint, is columnar and compressed, and any
    executor can reread it after another one is lost.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docveil/{name}-{uuid.uuid4().hex}"
    with _shuffles_deleted(spark):
        df.write.option("compression", "zstd").parquet(path)
    _THERE[path] = spark
    for held in _OPEN.get():
        held.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docveil_path = path
    return out


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for what another writer than materialize() writes; it goes with its tables."""
    path = f"{shared_dir(spark)}/docveil/{name}-{uuid.uuid4().hex}"
    _THERE[path] = spark
    for held in _OPEN.get():
        held.append(path)
    return path


def sent_if_small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows, which are counted; a larger one is joined by an exchange."""
    return F.broadcast(df) if df.count() <= rows else df


def by_exchange(df: DataFrame) -> DataFrame:
    """df, marked to be joined by an exchange. For what has a row for each page or span: Spark tells its size from compressed files, which say little of rows that are alike, and would send it whole."""
    return df.hint("merge")


def dealt_evenly(df: DataFrame) -> DataFrame:
    """df, dealt over as many partitions as exchanges have. For small files before much work a row: Spark plans tasks by bytes, so a compressed file of very many rows is read by a few."""
    return df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def release(*frames: DataFrame) -> None:
    """Delete what materialize() wrote for frames that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_docveil_path", None):
            delete_tables(df.sparkSession, [path])


def delete_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete those of the paths that are still there."""
    for path in paths:
        if _THERE.pop(path, None) is not None:
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(there, True)


@atexit.register
def _delete_rest() -> None:
    for path, spark in list(_THERE.items()):
        if SparkContext._active_spark_context is spark.sparkContext:
            with contextlib.suppress(Exception):  # the session may be ending
                delete_tables(spark, [path])


def values_table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A small driver-side list of numbers as a table; no Python worker is involved."""
    names = [c.split()[0] for c in columns.split(",")]
    kinds = [c.split()[1] for c in columns.split(",")]
    if not rows:
        return spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {k}) AS {n}" for n, k in zip(names, kinds, strict=True)) + " WHERE false")
    body = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in row) + ")" for row in rows)
    casts = ", ".join(f"CAST({n} AS {k}) AS {n}" for n, k in zip(names, kinds, strict=True))
    return spark.sql(f"SELECT {casts} FROM VALUES {body} AS t({', '.join(names)})")


def running_sum(df: DataFrame, order: list[Column], value: Column, out: str, reset: str | None = None) -> DataFrame:
    """Add ``out``: the sum of value over the rows before this one in the global order.

    Rows are dealt by range, so no task gets them all; only one sum for each
    range comes to the driver. With reset, the name of a column by which order
    begins, sums start anew for each of its values: what is held is the
    difference to the value's own start, which is one row for each value.
    """
    spark = df.sparkSession
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = materialize(df.repartitionByRange(width, *order).withColumn("__range", F.spark_partition_id()).withColumn("__value", value.cast("long")), "ranges")
    sums = sorted((r[0], r[1] or 0) for r in dealt.groupBy("__range").agg(F.sum("__value")).collect())
    before, rows = 0, []
    for k, n in sums:
        rows.append((k, before))
        before += n
    starts = values_table(spark, rows, "__range int, __start long")
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = (
        dealt.withColumn("__inside", F.coalesce(F.sum("__value").over(within), F.lit(0)))
        .join(F.broadcast(starts), "__range")
        .withColumn(out, F.col("__inside") + F.col("__start"))
    )
    if reset is not None:
        summed = materialize(summed, "sums")
        first = summed.groupBy(reset).agg(F.min(out).alias("__first")).withColumnRenamed(reset, "__of")
        summed = summed.join(first, F.col(reset).eqNullSafe(F.col("__of"))).withColumn(out, F.col(out) - F.col("__first")).drop("__of", "__first")
    return summed.drop("__range", "__value", "__inside", "__start")

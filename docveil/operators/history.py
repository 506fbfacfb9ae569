"""Undo as an append-only log of versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT = 100
#: Seconds within which changes of one kind are one step (fixed value).
COALESCE_SECONDS = 1.2


def coalesce_steps(log: DataFrame) -> DataFrame:
    """log (session, seq, at double, key) with step: an entry joins the one before if the keys are equal and it came soon after it.

    A null key never joins. Each entry is compared with the entry before, which is the merged one's latest time.
    """
    w = Window.partitionBy("session").orderBy("seq")
    joins = (F.col("key") == F.lag("key").over(w)) & (F.col("at") - F.lag("at").over(w) <= COALESCE_SECONDS)
    return log.withColumn("step", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def undo_depth(steps: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(session, step, first_seq, last_seq): steps that can still be undone, the latest limit of them."""
    each = steps.groupBy("session", "step").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    newest = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("step")))
    return each.withColumn("n", newest).where(F.col("n") <= limit).drop("n")


def replay(log: DataFrame) -> DataFrame:
    """(session, seq, version): which state is shown after each entry of a log with actions do, undo and redo.

    do makes a new version behind the current one and forgets what was undone;
    undo and redo walk along the current line, and stop at its ends.
    """
    start = F.struct(F.array(F.lit(0)).alias("line"), F.lit(1).alias("at"), F.lit(0).alias("made"), F.array().cast("array<struct<seq:bigint,version:int>>").alias("out"))

    def step(acc, e):
        done = e["action"] == "do"
        made = F.when(done, acc["made"] + 1).otherwise(acc["made"])
        line = F.when(done, F.concat(F.slice(acc["line"], F.lit(1), acc["at"]), F.array(acc["made"] + 1))).otherwise(acc["line"])
        at = F.when(done, acc["at"] + 1).when(e["action"] == "undo", F.greatest(acc["at"] - 1, F.lit(1))).otherwise(F.least(acc["at"] + 1, F.size(acc["line"])))
        shown = F.struct(e["seq"].cast("bigint").alias("seq"), F.element_at(line, at).alias("version"))
        return F.struct(line.alias("line"), at.alias("at"), made.alias("made"), F.concat(acc["out"], F.array(shown)).alias("out"))

    grouped = log.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("seq", "action"))).alias("e"))
    return grouped.select("session", F.explode(F.aggregate("e", start, step, lambda a: a["out"])).alias("o")).select("session", "o.*")


def restore(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of a versioned table (session, version, ...) as they stood at wanted (session, version)."""
    return versions.join(wanted, ["session", "version"], "left_semi")

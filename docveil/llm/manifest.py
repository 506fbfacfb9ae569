"""Merkle manifest of a dataset: trees of 16 over the rows of each group, and one tree over the groups.

Nodes are rows (g, idx, n, h): a group, the place in its level, how many nodes the level has there, and the digest.
A window over the runs of 16 gives each node its siblings and the parent's digest at once, so no task holds more of a group than a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docveil.llm.urls import LOWER, UPPER
from docveil.shared import materialize

#: Nodes of a run.
FAN = 16
_PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the parts behind each other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with its length before it; ``-`` for a null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes(g, ...) with idx, the place in the group by order from 0, and n, the group's size; written.

    Rows are dealt by ranges of group and order, so a large group lies in many ranges; what is
    summed up before a range is one number for each range and group.
    """
    dealt = materialize(nodes.repartitionByRange("g", *order).withColumn("__range", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy("__range", "g").agg(F.count("*").alias("__n"))
    of = Window.partitionBy("g")
    before = F.sum("__n").over(of.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("__range", "g", F.coalesce(before, F.lit(0)).alias("__start"), F.sum("__n").over(of).alias("n"))
    within = F.row_number().over(Window.partitionBy("__range", "g").orderBy(*order)) - 1
    placed = dealt.withColumn("__k", within).join(starts, ["__range", "g"])
    return materialize(placed.withColumn("idx", F.col("__start") + F.col("__k")).drop("__range", "__k", "__start"), "numbered")


def runs(nodes: DataFrame) -> DataFrame:
    """nodes with p (the parent's place), parent (its digest), before and after (the siblings' digests on either side).

    The only node of a level is its own parent.
    """
    whole = Window.partitionBy("g", "p").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = nodes.withColumn("p", F.floor(F.col("idx") / FAN).cast("long")).withColumn("__run", F.collect_list("h").over(whole)).withColumn("__k", (F.col("idx") % FAN).cast("int"))
    return held.select(
        "*",
        F.when(F.col("n") == 1, F.col("h")).otherwise(digest(F.array_join("__run", ""))).alias("parent"),
        F.array_join(F.slice("__run", F.lit(1), F.col("__k")), "").alias("before"),
        F.array_join(F.slice("__run", F.col("__k") + 2, F.lit(FAN)), "").alias("after"),
    ).drop("__run", "__k")


def climb(nodes: DataFrame) -> list[DataFrame]:
    """The levels above nodes, at least one, up to where each group has one node."""
    most, levels = nodes.agg(F.max("n")).first()[0] or 1, [nodes]
    while most > 1 or len(levels) == 1:
        parents = runs(levels[-1]).select("g", F.col("p").alias("idx"), F.ceil(F.col("n") / FAN).cast("long").alias("n"), F.col("parent").alias("h"))
        levels.append(materialize(parents.dropDuplicates(["g", "idx"]), "level"))
        most = -(-most // FAN)
    return levels


def descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest nodes with path: the siblings on either side, from their own level up and then along what tops(g, path) has for their group."""
    paths = tops.select("g", F.lit(0).cast("long").alias("p"), F.col("path").alias("__up"))
    for k in range(len(levels) - 2, -1, -1):
        own = F.when(F.col("n") == 1, F.col("__up")).otherwise(F.concat(F.array(F.struct("before", "after")), F.col("__up")))
        met = runs(levels[k]).join(paths, ["g", "p"]).withColumn("path", own).drop("__up", "before", "after", "p", "parent")
        paths = met.select("g", F.col("idx").alias("p"), F.col("path").alias("__up")) if k else met
    return paths


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", order: str = "doc_id", tampered: Column | None = None, tamper: Column | None = None) -> DataFrame:
    """(order, leaf, subroot, root, path, folded_root, verified), a row for each row of docs.

    leaf is the digest of the fields; leaves of a group ascend by order (nulls first, equal ones by leaf, so
    repeated rows have places of their own) and are joined by 16 up to the subroot; subroots, by group (null first, by bytes), likewise up to the root. path has the
    siblings that lead from the leaf to the root. Where tampered holds, folded_root begins with the leaf of a row whose text is
    tamper. A null group is a group of its own; an empty table gives no rows; other columns are not read.
    """
    key = F.col(group).cast("string")
    leaf = digest(*(field(F.col(c)) for c in fields))
    change = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    text = F.col("text") if tamper is None else tamper
    changed = F.when(change, digest(*(field(text if c == "text" else F.col(c)) for c in fields)))
    leaves = docs.select(F.coalesce(F.concat(F.lit("1"), key), F.lit("0")).alias("g"), F.col(order).alias("__order"), leaf.alias("h"), changed.alias("__changed"))
    levels = climb(numbered(leaves, ["__order", "h"]))
    subroots = levels[-1].select(F.lit("").alias("g"), F.col("g").alias("__of"), "h")
    tree = climb(numbered(subroots, ["__of"]))
    root = tree[-1].select("h").first()
    above = descend(tree, docs.sparkSession.range(1).select(F.lit("").alias("g"), F.array().cast(_PATH).alias("path")))
    tops = above.select(F.col("__of").alias("g"), "path", F.col("h").alias("subroot"))
    placed = descend(levels, tops).join(tops.select("g", "subroot"), "g")
    folded = F.aggregate("path", F.coalesce("__changed", "h"), lambda h, s: digest(s["before"], h, s["after"]))
    whole = F.lit(root[0] if root else None).cast("string")
    return placed.select(F.col("__order").alias(order), F.col("h").alias("leaf"), "subroot", whole.alias("root"), "path", folded.alias("folded_root"), (folded == whole).alias("verified"))


def proof(path: Column) -> Column:
    """The digest of all siblings of a path, level by level."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def lower_text() -> Column:
    """text with A-Z in lower case."""
    return F.translate(F.col("text"), UPPER, LOWER)

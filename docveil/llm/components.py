"""Connected components of a graph that no machine holds whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from docveil.shared import by_exchange, materialize, release


def _large_star(edges: DataFrame) -> DataFrame:
    """Join each node's larger neighbours to the least of it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(by_exchange(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Join each node and its smaller neighbours to the least of them; edges go from large to small."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(by_exchange(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(u, v) -> (node, root) for each node that has an edge; root is the least node reached.

    Alternating large and small stars end in a forest of stars after about
    log(n) rounds. Minima are partial aggregates, joins are on a node with
    exchanges on both sides, so that a node with very many links is split
    by adaptive execution. Each half of a round is one job that writes a table
    to the shared folder; a count and a hash, taken as it is written, tell whether anything changed.
    """
    now = materialize(edges.select("u", "v").where("u <> v").distinct(), "edges")
    mark = None
    while True:
        half = materialize(_large_star(now), "star")
        release(now)
        seen = Observation()
        now = materialize(_small_star(half).observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "star")
        release(half)
        if seen.get == mark:
            break
        mark = seen.get
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

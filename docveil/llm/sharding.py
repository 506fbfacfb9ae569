"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docveil.shared import materialize

#: Rows of a source partition, and of a block of a shard, about, as long as there are no more of them than so many.
PART_ROWS, MOST_PARTS, MOST_BLOCKS = 20_000, 4096, 256


def hypergeometric(draw: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n drawn without replacement are good, by inversion.

    Probabilities follow from the ratios of neighbours, from the mode to either side as far as
    twelve deviations and more; what lies beyond adds up to less than a double's last digit.
    One way for all sizes.
    """
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    whole = good + bad
    mode = min(high, max(low, (n + 1) * (good + 1) // (whole + 2)))
    reach = 64 + int(12 * np.sqrt(n * (good / whole) * (bad / whole) * ((whole - n) / max(1, whole - 1))))
    k = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.float64)
    steps = np.log((good - k[:-1]) * (n - k[:-1])) - np.log((k[:-1] + 1) * (bad - n + k[:-1] + 1))
    p = np.concatenate(([0.0], np.cumsum(steps)))
    heap = np.cumsum(np.exp(p - p.max()))
    return int(k[min(len(k) - 1, np.searchsorted(heap, draw.random() * heap[-1], side="right"))])


def communication_matrix(have: list[int], want: list[int], seed: int) -> np.ndarray:
    """Rows that each source partition sends to each shard, as a uniform shuffle would deal them.

    Row by row, a multivariate hypergeometric draw from what the shards still
    have room for; all row and column sums are exact.
    """
    draw, room = np.random.default_rng(seed), np.array(want, np.int64)
    out = np.zeros((len(have), len(want)), np.int64)
    for k, n in enumerate(have):
        left, rest = n, int(room.sum())
        for s in range(len(want)):
            rest -= int(room[s])
            got = hypergeometric(draw, int(room[s]), rest, left)
            out[k, s] = got
            left -= got
        room -= out[k]
    return out


def _numbered(base: DataFrame) -> DataFrame:
    """Add __again, the number of a row among those of its __id and text_crc32, in the order of partitions and of rows in them.

    Only the rows of one partition are numbered together, so a key that holds a third of all rows is no task of its own;
    how many came before, from counts, is joined to the few keys that lie in several partitions.
    """
    key = ["__id", "text_crc32"]
    counts = base.groupBy(*key, "__pid").agg(F.count("*").alias("__n"))
    ahead = F.sum("__n").over(Window.partitionBy(*key).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.withColumn("__before", ahead).where("__before > 0").select(*(F.col(c).alias(f"{c}_2") for c in (*key, "__pid")), "__before")
    inside = F.row_number().over(Window.partitionBy(*key, "__pid").orderBy("__at"))
    same = F.col("__id").eqNullSafe(F.col("__id_2")) & (F.col("text_crc32") == F.col("text_crc32_2")) & (F.col("__pid") == F.col("__pid_2"))
    numbered = base.withColumn("__inside", inside).join(before, same, "left")
    return numbered.withColumn("__again", F.col("__inside") + F.coalesce("__before", F.lit(0))).drop("__inside", "__before", "__pid", "__at", *(f"{c}_2" for c in (*key, "__pid")))


def shard(docs: DataFrame, shards: int = 24, seed: int = 7, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or their columns in keep) with size, text_crc32, law 'rows', shard, slot and grown_shard (null).

    Counts of the shards differ by one at most and slots are gapless from 0. A
    row's source partition and both permutations come from hashes of its
    doc_id, its text and its number among equal rows, so reruns agree and repeated rows part. A
    null text counts as an empty one, null doc_ids are one id. Columns that clash with a new one are
    replaced. The driver gets one count for each source partition, of which there are at most MOST_PARTS
    whatever the input, and draws the matrix from them.
    """
    spark = docs.sparkSession
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    sized = docs.select(*kept, (F.octet_length(whole) + 8).cast("long").alias("size"), F.crc32(whole).alias("text_crc32"), F.col("doc_id").alias("__id"), F.spark_partition_id().alias("__pid"), F.monotonically_increasing_id().alias("__at"))
    base = _numbered(materialize(sized, "sized"))
    base = materialize(base.withColumn("__mix", F.xxhash64(F.lit(seed), "__id", "text_crc32", "__again")).drop("__again"), "mixed")
    rows = base.count()
    parts = min(MOST_PARTS, max(1, -(-rows // PART_ROWS)))
    blocks = min(MOST_BLOCKS, max(1, -(-rows // shards // PART_ROWS)))
    base = base.withColumn("__part", F.pmod("__mix", F.lit(parts)).cast("int"))
    found = dict(base.groupBy("__part").count().collect())
    sent = communication_matrix([found.get(k, 0) for k in range(parts)], [rows // shards + (s < rows % shards) for s in range(shards)], seed)
    # A row of the matrix: up to which place in the partition rows go to which shard.
    ends = [{"p": k, "s": [{"e": int(e), "h": s} for s, e in enumerate(np.cumsum(sent[k]).tolist()) if sent[k, s]]} for k in range(parts)]
    matrix = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(ends)), "array<struct<p:int,s:array<struct<e:bigint,h:int>>>>")).alias("m")).select(F.col("m.p").alias("__part"), F.col("m.s").alias("__sends"))

    def shuffled(salt: int) -> list[Column]:
        return [F.xxhash64(F.lit(seed + salt), F.col("__mix")), F.col("__id"), F.col("text_crc32")]

    local = Window.partitionBy("__part").orderBy(*shuffled(1))
    dealt = (
        base.withColumn("__rank", F.row_number().over(local) - 1)
        .join(F.broadcast(matrix), "__part")  # at most MOST_PARTS rows
        .withColumn("shard", F.expr("filter(__sends, x -> x.e > __rank)[0].h"))
        .drop("__sends", "__rank", "__part")
        .withColumn("__block", F.pmod(F.xxhash64(F.lit(seed + 2), F.col("__mix")), F.lit(blocks)).cast("int"))
    )
    dealt = materialize(dealt, "dealt")
    ahead = F.sum("__n").over(Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    starts = dealt.groupBy("shard", "__block").agg(F.count("*").alias("__n")).select("shard", "__block", F.coalesce(ahead, F.lit(0)).alias("__start"))
    inside = Window.partitionBy("shard", "__block").orderBy(*shuffled(3))
    return (
        dealt.withColumn("__rank", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), ["shard", "__block"])  # at most shards * MOST_BLOCKS rows
        .withColumn("slot", (F.col("__start") + F.col("__rank")).cast("long"))
        .withColumn("law", F.lit("rows"))
        .withColumn("grown_shard", F.lit(None).cast("int"))
        .select(*kept, *made)
    )

"""A corpus pipeline of five stages; each stage's rows are written as Parquet and read again by the next.

All stages take nulls in any column, empty and very long texts, repeated rows, empty tables and columns
beyond those of documents, also such as are named like an operator's own; each says what becomes of them.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docveil.llm.decontaminate import find_leaks
from docveil.llm.mixing import mix
from docveil.llm.quality import judge_quality
from docveil.llm.sharding import shard
from docveil.llm.simhash import similar_documents
from docveil.shared import delete_tables, shared_dir, tables

#: Words of a shingle, and the similarity of near copies, in the near-dedup stage.
SHINGLE_WORDS, SIMILARITY = 5, 0.8

#: Helper tables of the stage that ran last, by thread and folder of the corpus.
_helpers: dict[tuple[int, str], list[str]] = {}


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Deletes the helper tables of the same corpus' stage before, whose rows are written by now."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        mine = threading.get_ident(), sf_dir
        delete_tables(spark, _helpers.pop(mine, []))
        with tables() as held:
            out = work(spark, docs, sf_dir)
        _helpers[mine] = held
        return out

    run_stage.__doc__ = work.__doc__
    return run_stage


def _hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())


def _times(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of docs as often as wanted(id, h, rows, times) says; equal rows are taken together.

    Texts are moved once, by (doc_id, hash of the text).
    """
    named = wanted.toDF("__id", "__h", "__rows", "__times").where("__times > 0")
    joined = docs.withColumn("__own", _hash()).join(named, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__h")))
    single = joined.where("__rows = 1")
    equal = joined.where("__rows > 1").dropDuplicates(["doc_id", "__own"])
    return single.unionByName(equal).withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select(*docs.columns)


@_stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; null and empty texts fail, each of equal rows is judged alike, a null source is a host of its own."""
    judged = judge_quality(docs.select(F.struct(*docs.columns).alias("__row"), "text", "source"), keep=["__row"])
    return judged.where("kept").select("__row.*")


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest doc_id, of each group of near copies.

    Texts without words are one group; a null doc_id stays only in a group without any other; of equal rows one stays.
    """
    slim = docs.select("doc_id", "text", _hash().alias("__key"))
    groups = similar_documents(slim, SHINGLE_WORDS, SIMILARITY, carry=["__key"])
    group = F.coalesce(F.concat(F.lit("to "), "component_id"), F.col("fingerprint"))
    rows = groups.groupBy(group.alias("g"), "doc_id", "__key").agg(F.count("*").alias("rows"))
    first = rows.groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__key", "rows")).alias("first"))
    return _times(docs, first.select("first.doc_id", "first.__key", "first.rows", F.lit(1)))


@_stage
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    slim = docs.select(F.struct(*docs.columns).alias("__row"), "text")
    return find_leaks(slim, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["__row"]).where("NOT contaminated").select("__row.*")


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; equal rows together as often as all of them. A null source is one of its own."""
    mixed = mix(docs.select("doc_id", "text", "source", _hash().alias("__key")), keep=["doc_id", "__key"])
    return _times(docs, mixed.groupBy("doc_id", "__key").agg(F.count("*").alias("rows"), F.sum("copies").alias("times")))


@_stage
def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's doc_id, lang and source with its shard and slot; copies of a row go their own ways."""
    return shard(docs, keep=["doc_id", "lang", "source"])


STAGES = [
    ("quality", keep_good),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: Near-dedup, the mix and the matrix are iterative, so SQL can't give the rows; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. The rows between stages are deleted as soon as they are used, helper tables too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, mine = f"{shared_dir(spark)}/docveil/pipeline-{uuid.uuid4().hex}", (threading.get_ident(), sf_dir)
    before = None
    for name, work in STAGES:
        work(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        delete_tables(spark, _helpers.pop(mine, []))
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        before = f"{folder}/{name}"
    return docs

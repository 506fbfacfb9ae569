"""Ranked lexical search: every document for each item, with scores in whole numbers.

An index is a table of postings. A row of it has a bucket of terms, a term, and the places and frequencies of the
term within up to BLOCK rows of the documents, which begin at ``base``; rows without a term hold
the ids and lengths of the same documents. So a term in every document makes one row for each block, not for
each document, and no task has to hold what one term leads to.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docveil.llm.urls import LOWER, UPPER
from docveil.llm.words import slices
from docveil.shared import materialize, sent_if_small

#: What a term is made of: every character but ASCII ones that are no letter or digit.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Documents of a block of postings, and buckets of terms.
BLOCK, BUCKETS = 4096, 1024
#: Terms of items, and their weights, that are sent to all workers; more are joined by an exchange.
SENT = 1 << 20

_INDEX = "term string, base long, places array<int>, freqs array<int>, ids array<long>"


def _lists(found: list[list[int]], of: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(list(chain.from_iterable(found)), of))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("term", pa.string()), ("base", pa.int64()), ("places", pa.list_(pa.int32())), ("freqs", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))])
    for batch in batches:
        for part in slices(batch, BLOCK):
            held: dict[bytes, tuple[list[int], list[int]]] = {}
            sizes = []
            for at, text in enumerate(part.column("text")):
                terms = (text.as_py() or b"").translate(_PLAIN).split()
                sizes.append(len(terms))
                for term, n in Counter(terms).items():
                    pair = held.get(term)
                    if pair is None:
                        held[term] = [at], [n]
                    else:
                        pair[0].append(at)
                        pair[1].append(n)
            base, n = part.column("row")[0].as_py(), len(held)
            columns = [
                pa.array(list(held), pa.binary()).cast(pa.string()),
                pa.array(np.full(n, base, np.int64)),
                _lists([p for p, _ in held.values()], pa.int32()),
                _lists([f for _, f in held.values()], pa.int32()),
                pa.nulls(n, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
            own = [[None], [base], [list(range(len(sizes)))], [sizes], [part.column("doc_id").to_pylist()]]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(own, schema, strict=True)], schema=schema)


def build_index(docs: DataFrame) -> DataFrame:
    """The postings of docs(doc_id, text), written: (bucket, term, base, places, freqs, ids).

    Rows with a term are postings; rows without one, of bucket -1, have the number of terms (freqs) and the id of each document of a block.
    A document is a row, and base + place is its number in this index; null and empty texts have no terms. Blocks are dealt by
    bucket, large buckets are split between tasks, and each file is in the order of terms.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).withColumn("row", F.monotonically_increasing_id())
    bucket = F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(BUCKETS))).cast("int")
    made = rows.mapInArrow(_blocks, _INDEX).select(bucket.alias("bucket"), "*")
    return materialize(made.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term"), "postings")


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the terms of each item once, whatever rows of items have its id."""
    found = F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(TERM), F.lit(0))
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(found).alias("term")).distinct()


def search(index: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the k documents of highest score above 0, equal ones by doc_id (nulls first).

    Blocks of the items' terms are looked up by bucket and term. What they hold goes to its document's partition as (row, term, frequency), once however many items
    have the term; there each match is scored for each item with the term and summed by item and document without a further
    exchange. The best k of each partition are taken before the last one. Items without terms, and those that nothing matches, give no rows; rows of equal id are one item.
    """
    wanted = materialize(item_terms(items), "terms")
    terms = materialize(wanted.select("term").distinct().select("term", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket"), F.monotonically_increasing_id().alias("term_no")), "vocabulary")
    docs = index.where("bucket = -1").select("base", F.explode(F.arrays_zip("places", "freqs", "ids")).alias("d"))
    docs = docs.select((F.col("base") + F.col("d.places")).alias("row"), F.col("d.ids").alias("doc_id"), F.col("d.freqs").cast("long").alias("n"))
    n_docs, n_terms = docs.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    met = index.where("bucket >= 0").join(sent_if_small(terms, SENT), ["bucket", "term"])
    counts = met.groupBy("term_no").agg(F.sum(F.size("places")).alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1))).cast("long")
    weights = materialize(counts.select("term_no", weight.alias("w")).join(terms, "term_no").join(wanted, "term").select("term_no", "item_id", "w"), "weights")
    matches = met.select("base", "term_no", F.explode(F.arrays_zip("places", "freqs")).alias("p"))
    matches = matches.select((F.col("base") + F.col("p.places")).alias("row"), "term_no", F.col("p.freqs").cast("long").alias("tf"))
    length = F.lit(50) + F.expr(f"(50 * n * {n_docs}L) div {max(n_terms, 1)}L")
    here = matches.join(docs.hint("shuffle_hash"), "row").withColumn("m", length).select("row", "doc_id", "term_no", F.expr("(1000000000 * tf) div (1000 * tf + 20 * m)").alias("gain"))
    scored = here.join(sent_if_small(weights, SENT), "term_no").groupBy("row", "item_id").agg(F.sum(F.col("w") * F.col("gain")).alias("score"), F.first("doc_id").alias("doc_id")).where("score > 0")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc("doc_id"), F.asc("row"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")

"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND."""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docveil.llm.urls import LOWER, UPPER
from docveil.llm.words import lower_words
from docveil.shared import materialize

#: Items indexed and sent to the workers at a time; more are taken in turns over the documents.
ITEMS_AT_ONCE = 2048
#: Items of a block, unless there are so many that MOST_BLOCKS would be exceeded.
BLOCK_ITEMS = 4
MOST_BLOCKS = 64
#: Words of a text that are looked at together.
SPAN_WORDS = 1 << 15
K1, B = 1.2, 0.75


class Index:
    """Postings of some items, with impacts as parts of what the item itself would score.

    A passage that holds all words of an item scores 1 for it. Postings run in
    the order of items; items lie in blocks, and for each term and block the
    greatest impact is kept.
    """

    def __init__(self, items: list[tuple[int, list[bytes]]], df: dict[bytes, int], n_items: int, mean_words: float, grams: int):
        self.items = [(i, w) for i, w in items if w]
        self.grams = grams
        self.longest = max((len(w) for _, w in self.items), default=1)
        self.terms: dict[bytes, int] = {}
        self.postings: list[list[tuple[int, float]]] = []
        for at, (_, found) in enumerate(self.items):
            weights = {}
            for term, tf in Counter(found).items():
                n = df.get(term, 1)
                weights[term] = math.log(1 + (n_items - n + 0.5) / (n + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(found) / max(mean_words, 1e-9)))
            total = sum(weights.values())
            for term, w in weights.items():
                k = self.terms.setdefault(term, len(self.terms))
                if k == len(self.postings):
                    self.postings.append([])
                self.postings[k].append((at, w / total))
        self.block_items = max(BLOCK_ITEMS, -(-len(self.items) // MOST_BLOCKS))
        self.blocks = max(1, -(-len(self.items) // self.block_items))
        self.most = np.zeros((len(self.terms) + 1, self.blocks), np.float32)
        for k, posts in enumerate(self.postings):
            for at, w in posts:
                b = at // self.block_items
                self.most[k, b] = max(self.most[k, b], w)
        self.parts = [self._parts(w) for _, w in self.items]

    def _parts(self, found: list[bytes]) -> tuple[set[bytes], set[bytes]]:
        """Word n-grams of the question (the first half of an item) and of the answer (the rest)."""
        half = (len(found) + 1) // 2
        n = self.grams
        cut = max(0, half - n + 1)
        grams = [b" ".join(found[k : k + n]) for k in range(max(1, len(found) - n + 1))]
        return set(grams[: max(1, cut)]), set(grams[max(1, cut) :]) or set(grams[-1:])

    def search(self, terms: list[int], block: int, threshold: float) -> list[tuple[int, float]]:
        """Items of a block that score the threshold or more for a set of terms: document-at-a-time WAND.

        Cursors stand on items in order. The pivot is the first item at which the
        block's greatest impacts of the cursors before it could reach the threshold;
        no item before it can.
        """
        low, high = block * self.block_items, (block + 1) * self.block_items
        cursors = []
        for k in terms:
            posts = [p for p in self.postings[k] if low <= p[0] < high]
            if posts:
                cursors.append([posts, 0, float(self.most[k, block])])
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[0][c[1]][0])
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c[2]
                if bound >= threshold - 1e-6:
                    pivot = c[0][c[1]][0]
                    break
            if pivot is None:
                break
            if cursors[0][0][cursors[0][1]][0] == pivot:
                score = sum(c[0][c[1]][1] for c in cursors if c[0][c[1]][0] == pivot)
                if score >= threshold - 1e-6:
                    out.append((pivot, score))
                goal = pivot + 1
            else:
                goal = pivot
            for c in cursors:
                while c[1] < len(c[0]) and c[0][c[1]][0] < goal:
                    c[1] += 1
            cursors = [c for c in cursors if c[1] < len(c[0])]
        return out

    def candidates(self, found: list[bytes], threshold: float) -> dict[int, float]:
        """Best passage score by item over all passages of a text.

        Passages are two units of as many words as the longest item, and begin
        at every unit, so an item that a text holds lies in one of them whole. The sum
        of block maxima over a passage's distinct terms bounds every score
        in the block; only blocks that may reach the threshold are searched.
        """
        best: dict[int, float] = {}
        unit, n_terms = self.longest, len(self.terms)
        if not n_terms:
            return best
        get = self.terms.get
        for low in range(0, max(1, len(found)), SPAN_WORDS // unit * unit or unit):
            span = found[low : low + SPAN_WORDS + 2 * unit]
            ids = np.array([get(w, n_terms) for w in span], np.int64)
            at = np.nonzero(ids < n_terms)[0]
            if not len(at):
                continue
            keys = np.unique(at // unit * n_terms + ids[at])
            units, terms = keys // n_terms, keys % n_terms
            first = np.concatenate(([0], np.nonzero(np.diff(units))[0] + 1))
            sums = np.zeros((len(span) // unit + 2, self.blocks), np.float32)
            sums[units[first]] = np.add.reduceat(self.most[terms], first, axis=0)
            bound = sums[:-1] + sums[1:]
            for u, b in zip(*(x.tolist() for x in np.nonzero(bound >= threshold - 1e-3)), strict=True):
                held = np.unique(terms[np.searchsorted(units, u) : np.searchsorted(units, u + 2)]).tolist()
                for item, score in self.search(held, b, threshold):
                    best[item] = max(score, best.get(item, 0.0))
        return best

    def verified(self, found: list[bytes], items: dict[int, float], overlap: float, part_overlap: float) -> list[tuple[int, float]]:
        """Of these items, those of whose n-grams a text holds enough, of the question and of the answer."""
        if not items:
            return []
        wanted = {g for i in items for part in self.parts[i] for g in part}
        sizes = {g.count(b" ") + 1 for g in wanted}
        there = {g for n in sizes for k in range(len(found) - n + 1) if (g := b" ".join(found[k : k + n])) in wanted}
        out = []
        for i in sorted(items):
            q, a = self.parts[i]
            whole = q | a
            if len(whole & there) >= overlap * len(whole) and len(q & there) >= part_overlap * len(q) and len(a & there) >= part_overlap * len(a):
                out.append((self.items[i][0], round(items[i], 6)))
        return out


def item_words(text: Column) -> Column:
    """Lower-case words of an item, as a column."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def indexes(benchmark: DataFrame, grams: int) -> Iterator[Index]:
    """Indexes of at most about ITEMS_AT_ONCE items each, one after the other; counts of terms cover all items."""
    held = benchmark.select(F.col("item_id").cast("long").alias("item_id"), item_words(F.col("text").cast("string")).alias("w")).where(F.size("w") > 0)
    n, mean = held.agg(F.count("*"), F.avg(F.size("w"))).first()
    turns = -(-n // ITEMS_AT_ONCE)
    df = held.select(F.explode(F.array_distinct("w")).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    for k in range(turns):
        part = held.where(F.pmod(F.xxhash64("item_id", "w"), F.lit(turns)) == k)
        items = [(r[0], [w.encode("utf-8", "surrogatepass") for w in r[1]]) for r in part.collect()]
        own = part.select(F.explode("w").alias("t")).distinct()
        counts = {t.encode("utf-8", "surrogatepass"): c for t, c in df.join(own, "t", "left_semi").collect()}
        yield Index(sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1])), counts, n, mean, grams)


SCHEMA = "n_candidates long, item_ids array<long>, item_scores array<double>"


def _judge(sent, threshold: float, overlap: float, part_overlap: float):
    def judge(texts: pa.Array) -> pa.Array:
        index, n, ids, scores = sent.value, [], [], []
        for text in texts:
            found = lower_words(text.as_py())
            near = index.candidates(found, threshold)
            sure = index.verified(found, near, overlap, part_overlap)
            n.append(len(near))
            ids.append([i for i, _ in sure])
            scores.append([s for _, s in sure])
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))], ["n_candidates", "item_ids", "item_scores"])

    return judge


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.55, overlap: float = 0.6, part_overlap: float = 0.25, grams: int = 5, keep: list[str] | None = None) -> DataFrame:
    """docs (or their columns in keep) with contaminated, n_candidates, item_ids and item_scores.

    Each passage of each text queries the index; all items whose BM25 score
    reaches threshold of what they score for themselves are candidates. A
    candidate counts if the text holds overlap of its word n-grams and
    part_overlap of those of its question and of its answer each. Null and empty
    texts hold nothing; items without words match nothing; of equal items all are named. Repeated rows come back as
    often, columns that clash with a new one are replaced.
    The driver holds, and sends, the index of ITEMS_AT_ONCE items at a time; of a longer benchmark each such part takes a turn over
    the texts, keeps what it finds by row and is given up before the next.
    """
    made = ["contaminated", "n_candidates", "item_ids", "item_scores"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]
    none = F.struct(F.lit(0).cast("long").alias("n_candidates"), F.array().cast("array<long>").alias("item_ids"), F.array().cast("array<double>").alias("item_scores"))
    parts, spark = indexes(benchmark, grams), docs.sparkSession
    index, second = next(parts, None), next(parts, None)

    def judged(sent) -> Column:
        return F.arrow_udf(_judge(sent, threshold, overlap, part_overlap), SCHEMA)("__text")

    rows = docs.select(*kept, F.col("text").cast("string").alias("__text"))
    if second is None:
        hit = none if index is None else judged(spark.sparkContext.broadcast(index))
        return rows.withColumn("__hit", hit).select(*kept, *_result(F.col("__hit")))
    rows, found = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "texts"), None
    for part in itertools.chain([index, second], parts):
        sent = spark.sparkContext.broadcast(part)
        hits = materialize(rows.select("__row", judged(sent).alias("h")).where("h.n_candidates > 0").select("__row", "h.*"), "hits")
        sent.destroy()
        found = hits if found is None else found.unionByName(hits)
    each = found.groupBy("__row").agg(F.sum("n_candidates").alias("n_candidates"), F.sort_array(F.collect_list(F.struct("item_ids", "item_scores"))).alias("f"))
    each = each.withColumns({c: F.flatten(F.col(f"f.{c}")) for c in ("item_ids", "item_scores")}).select("__row", F.struct("n_candidates", "item_ids", "item_scores").alias("__hit"))
    return rows.join(each, "__row", "left").withColumn("__hit", F.coalesce("__hit", none)).select(*kept, *_result(F.col("__hit")))


def _result(hit: Column) -> list[Column]:
    return [(F.size(hit["item_ids"]) > 0).alias("contaminated"), *(hit[c].alias(c) for c in ("n_candidates", "item_ids", "item_scores"))]

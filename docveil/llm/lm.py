"""Language-model scores from a log-frequency Bloom filter of n-gram counts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docveil.llm.words import lower_words, slices
from docveil.shared import materialize, release

#: The filter grows with the corpus in segments that one task fills each, a power of two and at least so many.
SEGMENTS, SEGMENT_BITS = 256, 1 << 20
#: At least so many bits for each entry.
BITS_PER_ENTRY = 8
#: Segments that are sent to the workers at once, which takes a turn over the texts.
GROUP = 1024
#: Tokens whose exact counts each worker holds; others' are joined.
HELD_COUNTS = 1 << 18
#: Bigrams that a task gathers before it sums them up.
GATHERED = 2_000_000

_START = np.uint64(xxhash.xxh64_intdigest(b"\x00start", 1))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bigram_hashes(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    return _mix(before * np.uint64(0x9E3779B97F4A7C15) + now)


@dataclass
class Tokens:
    """Tokens of some texts: words, each text closed by an end (the empty word)."""

    unique: np.ndarray  # hashes
    ids: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> Tokens:
        known: dict[bytes, int] = {}
        parts, bounds = [], [0]
        for t in texts:
            found = lower_words(t)
            found.append(b"")
            parts.append(np.fromiter((known.setdefault(w, len(known)) for w in found), np.int64, len(found)))
            bounds.append(bounds[-1] + len(found))
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, 0) for w in known), np.uint64, len(known))
        return cls(hashes, np.concatenate(parts) if parts else np.empty(0, np.int64), np.array(bounds))

    def bigrams(self) -> np.ndarray:
        """A hash for each token with the one before it, or with the start of the text."""
        now = self.unique[self.ids]
        before = np.concatenate((now[:1], now[:-1]))
        before[self.bounds[:-1]] = _START
        return bigram_hashes(before, now)


def _summed(order: int, hashes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), order, np.int8)), pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], ["o", "h", "n"])


def gather(docs: DataFrame) -> DataFrame:
    """(o, h, n): counts of all unigrams (o 1) and all bigrams (o 2).

    Tasks sum up what they gather before anything is sent. A 64-bit hash stands for an n-gram.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch):
                tokens = Tokens.of(part.column("text").to_pylist())
                yield _summed(1, tokens.unique, np.bincount(tokens.ids, minlength=len(tokens.unique)))
                held.append(tokens.bigrams())
                size += len(held[-1])
                if size >= GATHERED:
                    yield _summed(2, *np.unique(np.concatenate(held), return_counts=True))
                    held, size = [], 0
        if held:
            yield _summed(2, *np.unique(np.concatenate(held), return_counts=True))

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "o byte, h long, n long").groupBy("h", "o").agg(F.sum("n").alias("n"))


def level_of(n: Column) -> Column:
    """Quantised count: 1 + floor(log2 n)."""
    return F.length(F.bin(n)).cast("int")


def positions(h: np.ndarray, level: int | np.ndarray, hashes: int) -> np.ndarray:
    """Bits within its segment that stand for (n-gram, level)."""
    x = _mix(h + np.uint64(0xD1B54A32D192ED03) * np.asarray(level, np.uint64))
    out = []
    for k in range(hashes):
        if k and k % 3 == 0:
            x = _mix(x + np.uint64(k))
        out.append((x >> np.uint64(20 * (k % 3))) & np.uint64(SEGMENT_BITS - 1))
    return np.array(out)


@dataclass
class CountFilter:
    """A Bloom filter of pairs (n-gram, j) for j from 1 to the level of the n-gram's count.

    It holds some segments of several, by default all, from the first on; n-grams of others have level 0.
    """

    bits: bytes
    hashes: int
    segments: int
    first: int = 0

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Probe j = 1, 2, ... until a pair is missing."""
        table, out, j = np.frombuffer(self.bits, np.uint8), np.zeros(len(h), np.int64), 1
        segment = (h >> np.uint64(65 - self.segments.bit_length())).astype(np.int64) - self.first
        active = np.nonzero((segment >= 0) & (segment < len(self.bits) * 8 // SEGMENT_BITS))[0]
        while len(active):
            x = h[active]
            start = segment[active].astype(np.uint64) * np.uint64(SEGMENT_BITS)
            there = np.ones(len(x), bool)
            for p in positions(x, j, self.hashes):
                at = start + p
                there &= (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            active = active[there]
            out[active] = j
            j += 1
            if j > 64:
                break
        return out


def counts_of(levels: np.ndarray) -> np.ndarray:
    """What a level stands for: nothing, one, or the geometric middle of its range."""
    return np.where(levels < 2, levels, np.exp2(levels - 0.5)).astype(float)


def filter_segments(grams: DataFrame, bits_per_entry: int = BITS_PER_ENTRY) -> tuple[DataFrame, int, int]:
    """(segment, bits) of the filter of all grams, how many segments there are, and hashes of an entry.

    There are enough to leave each entry bits_per_entry bits, so each is filled by one task
    from at most about SEGMENT_BITS / bits_per_entry entries.
    """
    level = level_of(F.col("n"))
    entries = int(grams.agg(F.sum(level.cast("long"))).first()[0] or 0)
    segments = max(SEGMENTS, 1 << (max(0, -(-entries * bits_per_entry // SEGMENT_BITS) - 1)).bit_length())
    hashes = int(np.clip(round(np.log(2) * segments * SEGMENT_BITS / max(1, entries)), 1, 6))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        table, h, top = np.zeros(SEGMENT_BITS, np.uint8), pdf["h"].to_numpy().view(np.uint64), pdf["level"].to_numpy()
        for j in range(1, int(top.max()) + 1):
            for p in positions(h[top >= j], j, hashes):
                table[p] = 1
        return pd.DataFrame({"segment": [int(pdf["segment"].iloc[0])], "bits": [np.packbits(table, bitorder="little").tobytes()]})

    made = grams.select(F.shiftrightunsigned("h", 65 - segments.bit_length()).cast("int").alias("segment"), "h", level.alias("level")).groupBy("segment").applyInPandas(fill, "segment int, bits binary")
    return made, segments, hashes


def part_of(made: DataFrame, segments: int, hashes: int, first: int, size: int) -> CountFilter:
    """The filter's segments from first on, at most so many."""
    size = min(size, segments - first)
    parts = {r[0]: bytes(r[1]) for r in made.where((F.col("segment") >= first) & (F.col("segment") < first + size)).collect()}
    empty = bytes(SEGMENT_BITS // 8)
    return CountFilter(b"".join(parts.get(k, empty) for k in range(first, first + size)), hashes, segments, first)


def build_filter(grams: DataFrame, bits_per_entry: int = BITS_PER_ENTRY, least: int = 2) -> tuple[CountFilter, int]:
    """The whole filter of unigrams and of bigrams from the least count on, and that count."""
    made = filter_segments(grams.where((F.col("o") == 1) | (F.col("n") >= least)), bits_per_entry)
    return part_of(*made, 0, made[1]), least


def score(docs: DataFrame, train: Column, strength: float = 60.0, key: str = "doc_id") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    Learns from the rows where train holds. base_score uses exact counts with
    one added: those of the HELD_COUNTS most frequent tokens (a fixed number) are sent to
    the workers, the others are joined, so no token is frequent in the join.
    score is a bigram model smoothed towards the unigram one (Dirichlet, of
    the given strength) from the filter's counts. Where the filter has more than GROUP segments, as many
    at a time are sent, and levels found so far are kept by row between these turns. A null text is an empty
    one, that is just its end; without any training row all counts are zero.
    """
    spark = docs.sparkSession
    flagged = docs.select(F.col(key), F.col("text").cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("__train"))
    grams = materialize(gather(flagged.where("__train")), "grams")
    ones = grams.where("o = 1")
    n_train, n_types = (int(x or 0) for x in ones.agg(F.sum("n"), F.count("*")).first())
    n_texts = int(ones.where(F.col("h") == F.lit(int(np.uint64(xxhash.xxh64_intdigest(b"", 0)).view(np.int64)))).agg(F.sum("n")).first()[0] or 0)
    top = materialize(ones.select("h", "n").orderBy(F.desc("n"), "h").limit(HELD_COUNTS), "top")
    held = top.toArrow()
    order = np.argsort(np.asarray(held.column("h")).view(np.uint64))
    made, segments, hashes = filter_segments(grams)
    made = materialize(made, "filter")
    exact_counts = spark.sparkContext.broadcast((np.asarray(held.column("h")).view(np.uint64)[order], np.asarray(held.column("n"))[order]))
    total = float(n_train + n_types + 1)

    def levels(part: pa.RecordBatch, t: Tokens, counts: CountFilter) -> tuple[np.ndarray, np.ndarray]:
        """Levels of each token and of its bigram, those of earlier turns included."""
        pairs, where = np.unique(t.bigrams(), return_inverse=True)
        own = counts.levels(t.unique)[t.ids], counts.levels(pairs)[where]
        if "__one" not in part.schema.names:
            return own
        return tuple(np.maximum(x, np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8)) for x, c in zip(own, ("__one", "__two"), strict=True))

    def turn(sent) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    t = Tokens.of(part.column("text").to_pylist())
                    cut = [[x[a:b].astype(np.uint8).tobytes() for a, b in zip(t.bounds[:-1], t.bounds[1:], strict=True)] for x in levels(part, t, sent.value)]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (key, "text", "__train", "__row")), *(pa.array(x, pa.binary()) for x in cut)], [key, "text", "__train", "__row", "__one", "__two"])

        return run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, times), counts = exact_counts.value, sent.value
        for batch in batches:
            for part in slices(batch):
                t = Tokens.of(part.column("text").to_pylist())
                at = np.searchsorted(known, t.unique)
                at[at == len(known)] = 0
                hit = known[at] == t.unique if len(known) else np.zeros(len(t.unique), bool)
                exact = np.where(hit, times[at], 0) if len(known) else np.zeros(len(t.unique), np.int64)
                sums = lambda x: np.add.reduceat(x, t.bounds[:-1]) if len(x) else np.empty(0)
                base = sums(np.log10(exact + 1.0)[t.ids]) - np.diff(t.bounds) * np.log10(total)
                n_known = sums((exact > 0).astype(np.int64)[t.ids])
                near, seen = (counts_of(x) for x in levels(part, t, counts))
                p1 = (near + 1) / total
                context = np.concatenate((near[:1], near[:-1]))
                context[t.bounds[:-1]] = n_texts
                p = (np.minimum(seen, context) + strength * p1) / (context + strength)
                rare_h, rare_n = [], []
                for a, b in zip(t.bounds[:-1], t.bounds[1:], strict=True):
                    ids, tf = np.unique(t.ids[a:b], return_counts=True)
                    miss = ~hit[ids]
                    rare_h.append(t.unique[ids[miss]].view(np.int64))
                    rare_n.append(tf[miss])
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), part.column("__train"), part.column("__row"), pa.array(np.diff(t.bounds)), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(sums(np.log10(p))), pa.array(rare_h, pa.list_(pa.int64())), pa.array(rare_n, pa.list_(pa.int64()))],
                    [key, "__train", "__row", "n_tokens", "n_known", "base_score", "score", "rare", "times"],
                )

    kind = docs.schema[key].dataType.simpleString()
    state, done = flagged.withColumn("__row", F.monotonically_increasing_id()), None
    starts = range(0, segments, GROUP)
    for first in starts[:-1]:
        sent = spark.sparkContext.broadcast(part_of(made, segments, hashes, first, GROUP))
        state = materialize(state.mapInArrow(turn(sent), f"{key} {kind}, text string, __train boolean, __row long, __one binary, __two binary"), "levels")
        sent.destroy()
        if done is not None:
            release(done)
        done = state
    sent = spark.sparkContext.broadcast(part_of(made, segments, hashes, starts[-1], GROUP))
    release(made)
    scored = state.mapInArrow(run, f"{key} {kind}, __train boolean, __row long, n_tokens long, n_known long, base_score double, score double, rare array<long>, times array<long>")
    columns = [F.col(key), (~F.col("__train")).alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score"]
    scored = materialize(scored, "scored")
    pairs = scored.select("__row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("__row", F.col("r.rare").alias("h"), F.col("r.times").alias("tf"))
    more = pairs.join(ones.select("h", "n"), "h").groupBy("__row").agg(F.sum("tf").alias("__known"), F.sum(F.col("tf") * F.log10(F.col("n") + F.lit(1.0))).alias("__base"))
    more = materialize(more, "rare")
    both = scored.drop("rare", "times").join(more, "__row", "left")
    return both.withColumn("n_known", F.col("n_known") + F.coalesce("__known", F.lit(0))).withColumn("base_score", F.col("base_score") + F.coalesce("__base", F.lit(0.0))).select(*columns)

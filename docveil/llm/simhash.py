"""SimHash near-dedup by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docveil.llm.components import connected_components
from docveil.llm.words import lower_words, shingle_hashes, slices
from docveil.shared import by_exchange, materialize, release

#: Keys of more members than the first are compared as arrays, of more than the second by finer keys.
BLOCK, WIDE_BLOCK = 64, 2048

#: Shingles that a candidate pair shares among the rarest ones of both texts, at least.
SHARED = 4
#: Of so many texts (and of each 4096th of larger corpora) frequent shingles are told, of which so many are kept; they set the order only.
SAMPLED, FREQUENT = 1 << 14, 1 << 18
#: So many names of candidates are sent to the workers at most; more are joined by an exchange of texts.
SENT_NAMES = 1 << 20
#: Which other text of a shingle each is compared with before all pairs are, which they are once there are at most so many for each member.
KINDS_OF_HUBS, MOST_PAIRS = ("popular", "size", "popular", "by chance"), 4
#: Members of a shingle that are sorted by size together, about.
PART_MEMBERS = 4096
#: Bytes that a turn moves for each shingle of the corpus, and in any case.
TURN_BYTES, LEAST_TURN = 2, 1 << 26

#: For each byte, eight one-byte counters in one number, one for each bit.
_SPREAD = np.array([sum(1 << (8 * k) for k in range(8) if b >> k & 1) for b in range(256)], np.uint64)


def bit_counts(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How often each of 64 bits is set among hashes[bounds[i]:bounds[i + 1]], for each i."""
    out = np.zeros((len(bounds) - 1, 64), np.int64)
    step = 1 << 17
    for low in range(0, len(hashes), step):
        part = hashes[low : low + step]
        cuts = np.unique(np.concatenate((np.arange(0, len(part), 255), np.clip(bounds - low, 0, len(part)))))
        cuts = cuts[cuts < len(part)]
        packed = np.add.reduceat(_SPREAD[part.view(np.uint8).reshape(-1, 8)], cuts, axis=0)  # at most 255 rows each: no counter overflows
        owner = np.searchsorted(bounds, cuts + low, side="right") - 1
        np.add.at(out, owner, packed.view(np.uint8).reshape(-1, 64).astype(np.int64))
    return out


def fingerprints(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One for each text; a bit is set if over half the hashes have it."""
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    return ((2 * bit_counts(hashes, bounds) > np.diff(bounds)[:, None]) * weights).sum(1, dtype=np.uint64)


def prints_of(each: list[np.ndarray]) -> np.ndarray:
    """The fingerprints of texts, given the hashes of each one's shingles, as signed numbers."""
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int64)
    return fingerprints(np.concatenate(each) if each else np.empty(0, np.uint64), bounds).view(np.int64)


def simhash(docs: DataFrame, shingle_words: int = 3, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, carried columns, f0): fingerprints of whole texts.

    A text of fewer words is one shingle; one without words, or a null, has fingerprint zero.
    """
    held = ["doc_id", *(carry or [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                each = [shingle_hashes(lower_words(t), shingle_words) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in held), pa.array(prints_of(each))], [*held, "f0"])

    schema = ", ".join(["doc_id long", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in held[1:]), "f0 long"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *held[1:], F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def variants(rows: DataFrame, bits: Column, size: int, segments: int, held: list[str]) -> DataFrame:
    """(held, key, exact, side): a row for each segment of the low size bits as it is and one for each of its one-wildcard variants.

    key names segment, wildcard and the other bits; side is the bit under the
    wildcard. Two segments that differ in one bit meet in just one key, from
    two sides; equal ones meet in the key without a wildcard.
    """
    width = size // segments
    if width * segments != size or width > 32:
        raise ValueError("segments must be equal, of at most 32 bits")
    return (
        rows.withColumn("__bits", bits)
        .withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(segments * (width + 1) - 1))))
        .withColumn("__wild", F.expr(f"cast(__k % {width + 1} as int)"))
        .withColumn("__value", F.expr(f"shiftrightunsigned(__bits, cast(__k div {width + 1} as int) * {width}) & {(1 << width) - 1}L"))
        .withColumn("exact", F.expr(f"__wild = {width}"))
        .withColumn("side", F.expr("if(exact, 0, cast(shiftright(__value, __wild) & 1 as int))"))
        .withColumn("key", F.expr(f"shiftleft(cast(__k as long), {width}) | if(exact, __value, __value & ~shiftleft(1L, __wild))"))
        .select(*held, "key", "exact", "side")
    )


def members_of(every: DataFrame, by: list[str]) -> DataFrame:
    """Variants that another fingerprint has too, from the other side of a wildcard, with how many (n) share the key.

    Spark takes the variants for as many rows as they were made from, and would send their keys to the driver.
    """
    useful = every.groupBy(*by, "exact").agg(F.count("*").alias("n"), F.sum("side").alias("ones")).where("n > 1 AND (exact OR (ones > 0 AND ones < n))")
    return materialize(every.join(by_exchange(useful.select(*by, "n")), by), "members")


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Of the links (row, column) of a block, those that join its parts: fewer than it has rows and columns."""
    out, rows, columns = [], np.ones(near.shape[0], bool), np.ones(near.shape[1], bool)
    for start in range(len(rows)):
        if not rows[start]:
            continue
        rows[start], todo = False, [start]
        while todo:
            i = todo.pop()
            for j in np.nonzero(near[i] & columns)[0].tolist():
                columns[j] = False
                out.append((i, j))
                for k in np.nonzero(near[:, j] & rows)[0].tolist():
                    rows[k] = False
                    out.append((k, j))
                    todo.append(k)
    return out


def compared(members: DataFrame, by: list[str], max_bits: int) -> DataFrame:
    """(f0, g0): links that connect all members of a key that differ in at most max_bits.

    Keys with few members give pairs that pass the test of all bits. A key of more is cut into
    blocks; each pair of blocks is one group that is compared as arrays and returns a spanning forest.
    """
    few = members.where(F.col("n") <= BLOCK)
    other = few.select(*by, F.col("side").alias("other"), F.col("f0").alias("g0"))
    distance = F.bit_count(F.col("f0").bitwiseXOR(F.col("g0")))
    pairs = few.join(by_exchange(other), by).where(((F.col("exact") & (F.col("f0") < F.col("g0"))) | (~F.col("exact") & (F.col("side") < F.col("other")))) & (distance <= max_bits)).select("f0", "g0")

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        prints, part = pdf["f0"].to_numpy(np.int64).view(np.uint64), pdf["part"].to_numpy()
        low, high = (prints[part == pdf[c].iloc[0]] for c in ("low", "high"))
        found = forest(np.bitwise_count(low[:, None] ^ high[None, :]) <= max_bits)
        a, b = (np.array([x[k] for x in found], np.int64) for k in (0, 1))
        return pd.DataFrame({"f0": low[a].view(np.int64), "g0": high[b].view(np.int64)})

    many = (
        members.where(F.col("n") > BLOCK)
        .withColumn("blocks", F.ceil(F.col("n") / WIDE_BLOCK).cast("int"))
        .withColumn("part", F.pmod(F.xxhash64("f0"), F.col("blocks")).cast("int"))
        .withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("part", "x"))
        .withColumn("high", F.greatest("part", "x"))
        .groupBy(*by, "low", "high")
        .applyInPandas(block, "f0 long, g0 long")
    )
    return pairs.unionByName(many)


def links(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """Links (f0, g0) that connect all pairs of different fingerprints within max_bits.

    Of two halves one differs in one bit at most, so each such pair shares a key of 32 bits or
    31 and a wildcard. A key of more than WIDE_BLOCK members is not compared as it is: its members
    get the same kind of keys from the halves of their other 32 bits, of which again one differs in one
    bit at most. What shares such a key is alike in all but some 18 bits, so a group has at most
    2 ** 18 members and 128 blocks whatever the corpus, and rows stay in proportion to members.
    """
    if max_bits >= 4:
        raise ValueError("more bits need more segments")
    members = members_of(variants(prints, F.col("f0"), 64, 2, ["f0"]), ["key"])
    out = compared(members.where(F.col("n") <= WIDE_BLOCK), ["key"], max_bits)
    large = members.where(F.col("n") > WIDE_BLOCK)
    if large.limit(1).count():
        rest = F.expr("if(shiftright(outer, 32) >= 33, f0 & 4294967295L, shiftrightunsigned(f0, 32))")
        finer = members_of(variants(large.select(F.col("key").alias("outer"), "f0"), rest, 32, 2, ["outer", "f0"]), ["outer", "key"])
        out = out.unionByName(compared(finer, ["outer", "key"], max_bits))
    return out


def _jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / F.greatest(F.size(a) + F.size(b) - shared, F.lit(1))


def shingle_sets(docs: DataFrame, shingle_words: int, keep: list[str]) -> DataFrame:
    """(keep, shingles): distinct hashes of each text's word shingles; a text without words has the empty shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [np.unique(shingle_hashes(lower_words(t) or [b""], shingle_words)).view(np.int64) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(sets, pa.list_(pa.int64()))], [*keep, "shingles"])

    schema = ", ".join([*(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep), "shingles array<long>"])
    return docs.select(*keep, "text").mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, shingle_words: int = 3, max_bits: int = 3, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, carried columns, fingerprint, component_id, f0): each row's group of near copies.

    component_id is the smallest doc_id that links reach; rows with equal
    fingerprints are linked. Every input row comes back once, repeated ones
    too. A null doc_id never becomes a component_id unless a group has no
    other. Columns of docs other than doc_id, text and the carried
    ones are not read.
    """
    base = materialize(simhash(docs, shingle_words, carry), "prints")
    return _grouped(base, carry, lambda prints: connected_components(links(prints, max_bits).toDF("u", "v")))


def frequent_shingles(docs: DataFrame, shingle_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of shingles that several of about SAMPLED different texts hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                each = [np.unique(shingle_hashes(lower_words(t), shingle_words)) for t in part.column("text").to_pylist()]
                keys, n = np.unique(np.concatenate(each) if each else np.empty(0, np.uint64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    every = min(max(1, docs.count() // SAMPLED), 4096)
    picked = docs.where(F.pmod(F.xxhash64("__h"), F.lit(every)) == 0).select("__h", F.col("text").cast("string").alias("text")).dropDuplicates(["__h"])
    counts = picked.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    held = counts.orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
    keys, n = np.asarray(held.column("key")).astype(np.int64).view(np.uint64), np.asarray(held.column("n")).astype(np.int64)
    order = np.argsort(keys)
    return keys[order], n[order]


def prefix_length(size: int, similarity: float) -> int:
    """So many of the first shingles, in an order all texts share, hold SHARED common ones of any pair of the similarity.

    Such a pair has at least ceil(similarity * size) in common; all but SHARED - 1 of these and the
    SHARED-th itself stand at or behind the SHARED-th. A pair with fewer in common has them all here.
    """
    return min(size, size - int(np.ceil(similarity * size - 1e-9)) + SHARED)


def rare_prefixes(docs: DataFrame, shingle_words: int, similarity: float, carry: list[str]) -> DataFrame:
    """(doc_id, carried columns, f0, size, print, prefix): hash and size of each text's set of shingles, its fingerprint and its rarest shingles."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, shingle_words))
    held = ["doc_id", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = sent.value
        for batch in batches:
            for part in slices(batch):
                each = [shingle_hashes(lower_words(t), shingle_words) for t in part.column("text").to_pylist()]
                sets = [np.unique(x if len(x) else shingle_hashes([b""], shingle_words)) for x in each]
                sizes, prefixes = [len(x) for x in sets], []
                for x in sets:
                    at = np.minimum(np.searchsorted(known, x), max(0, len(known) - 1))
                    often = np.where(known[at] == x, times[at], 0) if len(known) else np.zeros(len(x), np.int64)
                    prefixes.append(x[np.lexsort((x, often))[: prefix_length(len(x), similarity)]].view(np.int64))
                names = np.array([xxhash.xxh64_intdigest(x.tobytes(), 0) for x in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in held), pa.array(names), pa.array(sizes, pa.int32()), pa.array(prints_of(each)), pa.array(prefixes, pa.list_(pa.int64()))], [*held, "f0", "size", "print", "prefix"])

    schema = ", ".join(["doc_id long", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry), "f0 long", "size int", "print long", "prefix array<long>"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def shared_least(size: Column, size2: Column, similarity: float) -> Column:
    """So many prefix shingles two sets of the similarity share at least.

    Up to the place where the first of the two prefixes ends both hold all common shingles; what comes after is at
    most the rest of that set. Where the sizes are equal, that is about a ninth of them.
    """
    large = F.greatest(size, size2)
    rest = F.greatest(F.ceil(large * similarity - 1e-9) - SHARED, F.lit(0))
    overlap = F.ceil((size + size2) * (similarity / (1 + similarity)) - 1e-9)
    return F.greatest(F.least(F.lit(SHARED), F.ceil(large * similarity - 1e-9)), overlap - rest)


def fewest_shared(size: Column, low: Column, high: Column, similarity: float) -> Column:
    """No more than what shared_least() says for any partner of low to high shingles, where low <= size <= high.

    For partners that are no larger it rises with their size. For larger ones it falls but for the rounding of both its
    parts: ceil(x) - ceil(y) is at least floor(x - y), which falls throughout.
    """
    own = F.ceil(size * similarity - 1e-9)
    falling = F.floor((size + high) * (similarity / (1 + similarity)) - high * similarity - 1e-6) + SHARED
    above = F.greatest(F.least(F.lit(SHARED), own), F.when(own > SHARED, falling).otherwise(F.lit(0)))
    return F.least(shared_least(size, low, similarity), above)


def composed(first: DataFrame, second: DataFrame) -> DataFrame:
    """(node, root) of links of two kinds, where second has the components of the first ones' roots and of nodes without any."""
    second = second.toDF("__node", "__root")
    moved = first.join(second, F.col("root") == F.col("__node"), "left").select("node", F.coalesce("__root", "root").alias("root"))
    alone = second.join(first, F.col("__node") == F.col("node"), "left_anti")
    return moved.unionByName(alone.toDF("node", "root"))


def signature_pairs(base: DataFrame, max_bits: int = 3) -> DataFrame:
    """(f0, g0, size, size2): sets whose fingerprints are equal or linked by deletion-variant signatures, as links() has them.

    One set stands for each fingerprint; each other one of it makes a pair with that.
    """
    one = F.struct("f0", "size")
    rows = materialize(base.select("f0", "size", "print").dropDuplicates(["f0"]), "signed")
    first = materialize(rows.groupBy("print").agg(F.min(one).alias("one")), "first")
    equal = rows.join(by_exchange(first), "print").select(one.alias("a"), F.col("one").alias("b"))
    near = links(first.select(F.col("print").alias("f0")), max_bits).distinct()
    a, b = first.select(F.col("print").alias("f0"), F.col("one").alias("a")), first.select(F.col("print").alias("g0"), F.col("one").alias("b"))
    both = near.join(by_exchange(a), "f0").join(by_exchange(b), "g0").select("a", "b")
    low, high = F.least("a", "b"), F.greatest("a", "b")
    pairs = equal.unionByName(both).where("a.f0 <> b.f0").select(low.alias("a"), high.alias("b")).distinct()
    return pairs.select("a.f0", F.col("b.f0").alias("g0"), "a.size", F.col("b.size").alias("size2"))


def similar_roots(base: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """(node, root): components of the graph of all pairs of sets of at least the similarity; no pair is lost.

    base comes from rare_prefixes(); sets is a function from (f0) to (f0, shingles). What op1's signatures
    link is verified and joined first. Signatures alone lose pairs of the similarity, so an exact way for the rest
    follows: pairs of different groups that share enough prefix shingles are verified too. While the pairs at the shingles are many more than their members, each member is first compared with one
    other: with the hub of its shingle, the text that shares most shingles (an original has all that its copies keep), the neighbour by size, or one by chance.
    What these links connect is not compared again, so that large groups of near copies stay cheap; all pairs that
    are left come last, in turns that bound the disk.
    """
    room = max(LEAST_TURN, TURN_BYTES * int(base.agg(F.sum("size")).first()[0] or 0))
    def pruned(rows: DataFrame) -> DataFrame:
        """Members (key, f0, size, root) with popular, how many keys each shares, but for those that can't share enough with any other root of the key.

        Such a one shares too few keys in all for any size that a partner at this key may have.
        """
        popular = rows.groupBy("f0").agg(F.count("*").cast("int").alias("popular"))
        ends = rows.groupBy("key").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.min("root").alias("least"), F.max("root").alias("most"))
        low, high = F.greatest("low", F.ceil(F.col("size") * similarity - 1e-9)), F.least("high", F.floor(F.col("size") / similarity + 1e-9))
        fewest = fewest_shared(F.col("size"), low, high, similarity)
        both = rows.drop("popular").join(ends.where("least < most"), "key").join(popular, "f0")
        return both.where(F.col("popular") >= fewest).select("key", "f0", "size", "root", "popular")

    def turns(rows: float) -> int:
        return max(1, -(-int(rows) // room))

    def turn(k: int, of: int) -> Column:
        return F.pmod(F.xxhash64("f0", "g0"), F.lit(of)) == k

    def counted(pairs: DataFrame, least: Column) -> DataFrame:
        alike = F.least("size", "size2") >= F.greatest("size", "size2") * similarity - 1e-9
        named = ["f0", "g0", "size", "size2", "root", "root2"]
        return pairs.where(alike).groupBy(*named).agg(F.count("*").alias("n")).where(F.col("n") >= least).drop("n")

    def linked(pairs: DataFrame) -> DataFrame:
        """(node, root): components of the roots of those pairs that have the similarity."""
        held = materialize(sets(pairs.select("f0").union(pairs.select("g0")).distinct()), "sets")
        of, out = turns(8 * (pairs.agg(F.sum(F.col("size").cast("long") + F.col("size2"))).first()[0] or 0)), None
        for k in range(of):
            left = pairs.where(turn(k, of)).join(held.withColumnRenamed("shingles", "s1"), "f0")
            both = left.join(held.withColumnsRenamed({"f0": "g0", "shingles": "s2"}), "g0")
            good = materialize(both.where(_jaccard(F.col("s1"), F.col("s2")) >= similarity).select("root", "root2").distinct(), "similar")
            out = good if out is None else out.unionByName(good)
        release(held)
        return connected_components(out.toDF("u", "v"))

    def rooted(rows: DataFrame) -> DataFrame:
        return rows.join(by_exchange(first.withColumnRenamed("node", "f0")), "f0", "left").withColumn("root", F.coalesce("root", "f0"))

    def beside(rows: DataFrame, kind: str) -> DataFrame:
        """Each member with one member of its key that has another root."""
        if kind == "size":
            parts = rows.groupBy("key").agg((F.floor(F.count("*") / PART_MEMBERS) + 1).alias("parts"))
            order = Window.partitionBy("key", "part").orderBy("size", "f0")
            dealt = rows.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("f0"), F.col("parts")))
            chosen = dealt.withColumn("other", F.lag(F.struct("f0", "size", "root")).over(order)).where("other.root <> root")
        else:
            by = F.col("popular") if kind == "popular" else F.xxhash64("f0", F.lit(kind))
            one = F.struct(by.alias("by"), "f0", "size", "root")
            hub = rows.join(rows.groupBy("key").agg(F.max(one).alias("hub")), "key")
            second = hub.where("hub.root <> root").groupBy("key").agg(F.max(one).alias("second"))
            chosen = hub.join(second, "key").withColumn("other", F.when(F.col("hub.root") == F.col("root"), F.col("second")).otherwise(F.col("hub")))
        low = F.col("f0") < F.col("other.f0")
        either = lambda a, b: F.when(low, a).otherwise(b)
        ends = [(n, F.col(n), F.col(f"other.{n}")) for n in ("f0", "size", "root")]
        return chosen.select(*(either(a, b).alias(n) for n, a, b in ends), *(either(b, a).alias({"f0": "g0"}.get(n, f"{n}2")) for n, a, b in ends))

    signed = signature_pairs(base).where(F.least("size", "size2") >= F.greatest("size", "size2") * similarity - 1e-9)
    first = materialize(linked(materialize(signed.withColumns({"root": F.col("f0"), "root2": F.col("g0")}), "signature_pairs")), "near_roots")
    # Texts of one set go before their prefixes are dealt, and one exchange by key serves for both the count and the members.
    spread = base.select("f0", "size", "prefix").dropDuplicates(["f0"]).select("f0", "size", F.explode("prefix").alias("key")).repartition("key")
    shared = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    members = materialize(spread.join(by_exchange(shared), "key"), "members")
    rest = materialize(pruned(rooted(members)), "unlinked")
    release(members)
    last, pairs = None, 0
    for kind in (*KINDS_OF_HUBS, None):
        before, rest = rest, materialize(pruned(rest), "unlinked")
        release(before)
        each = rest.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
        rows, pairs = each.agg(F.sum("n"), F.sum(F.expr("(double(n) * n - own) / 2"))).first()
        if kind is None or (pairs or 0) <= MOST_PAIRS * (rows or 0) or (last and pairs > 0.9 * last):
            break
        last = pairs
        found = linked(materialize(counted(beside(rest, kind), shared_least(F.col("size"), F.col("size2"), similarity) / 2), "neighbours"))
        first = materialize(composed(first, found), "near_roots")
        rest = rooted(rest.drop("root"))
    other = rest.select("key", F.col("f0").alias("g0"), F.col("size").alias("size2"), F.col("root").alias("root2"), F.col("popular").alias("popular2"))
    least = shared_least(F.col("size"), F.col("size2"), similarity)
    of, left = turns(24 * (pairs or 0)), None
    for k in range(of):
        own = rest.where(F.pmod(F.xxhash64("f0"), F.lit(of)) == k)
        met = own.join(other, "key").where((F.col("f0") < F.col("g0")) & (F.col("root") != F.col("root2")) & (F.least("popular", "popular2") >= least))
        part = materialize(counted(met, least), "candidates")
        left = part if left is None else left.unionByName(part)
    return composed(first, linked(left))


def similar_documents(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, carry: list[str] | None = None) -> DataFrame:
    """Like near_duplicates(), with links between all texts whose sets of word shingles have the similarity (of Jaccard).

    Candidates come from the signatures of near_duplicates() first, then from prefixes of rare shingles, by which no pair is lost, and are verified
    exactly; texts of one set are linked as they are, and the fingerprint is a hash of the set. Sets are
    made only of texts that have a candidate.
    """
    named = docs.withColumn("__h", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    base = materialize(rare_prefixes(named, shingle_words, similarity, [*(carry or []), "__h"]), "prefixes")

    def sets(needed: DataFrame) -> DataFrame:
        first = base.groupBy("f0").agg(F.min(F.struct("doc_id", "__h")).alias("d"))
        one = materialize(needed.join(first, "f0").select("f0", "d.doc_id", "d.__h"), "near")
        texts = named.select(F.col("doc_id").alias("__id"), F.col("__h").alias("__own"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        sent = F.broadcast(one) if one.count() <= SENT_NAMES else one
        wanted = texts.join(sent, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__own"))).dropDuplicates(["f0"])
        return shingle_sets(wanted, shingle_words, ["f0"])

    return _grouped(base, carry, lambda _: similar_roots(base, sets, similarity))


def _grouped(base: DataFrame, carry: list[str] | None, roots_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    prints = materialize(base.groupBy(F.col("f0").alias("node")).agg(F.min("doc_id").alias("least")), "distinct")
    roots = materialize(roots_of(prints.select(F.col("node").alias("f0"))), "roots")
    linked = materialize(prints.join(by_exchange(roots), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least"), "linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of = materialize(linked.join(by_exchange(least), "root").select("node", "component_id"), "of")
    release(prints, roots, linked)
    named = F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint")
    return base.join(by_exchange(of), F.col("f0") == F.col("node")).select("doc_id", *(carry or []), named, "component_id", "f0")

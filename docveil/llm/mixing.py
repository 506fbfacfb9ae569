"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docveil.llm.words import word_count
from docveil.shared import materialize, release, running_sum


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Add target to (source, source_size).

    Sources in code point order, null last, weigh weights in turn and share
    share times all sizes; a target stops at cap times its source's size and
    the excess goes to the others by weight: target = min(cap * size, level *
    weight), and each round raises the level until no more sources stop.
    """
    ranked = running_sum(sources, [F.col("source").asc_nulls_last()], F.lit(1), "rank")
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights)).cast("int") + 1)
    ranked = materialize(ranked.withColumn("weight", turn).withColumn("most", F.col("source_size") * F.lit(float(cap))), "weights")
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, held = 0.0, -1
    while True:
        stop = F.col("most") <= F.col("weight") * F.lit(level)
        n, full, rest = ranked.agg(F.count_if(stop), F.sum(F.when(stop, F.col("most"))), F.sum(F.when(~stop, F.col("weight")))).first()
        if not rest or (n == held):
            break
        held, level = n, (total - (full or 0.0)) / rest
    target = F.least("most", F.col("weight") * F.lit(level)) if rest else F.col("most")
    return ranked.withColumn("target", target).select("source", "source_size", "target")


def balance(hist: DataFrame, sources: DataFrame, cap: float, rounds: int = 40, tolerance: float = 1e-7) -> DataFrame:
    """Solve sum(size * rate) = target for each source; add dual (null: rate is cap throughout).

    Rates minimise the relative entropy to taking each document once, weighed
    by size / tilt, under the token constraints; so rate = min(cap,
    exp(dual * tilt)), where tilt is the document's size on a logarithmic
    scale. The dual problem is convex and falls apart by source: each round
    is one distributed aggregate over (source, size) counts and one Newton step
    for every source, halving its bracket instead where the step leaves it. Terms
    are summed as decimals, so sums don't depend on the order in which they arrive.
    """
    state = materialize(sources.withColumns({"dual": F.when(F.col("target") < cap * F.col("source_size"), F.lit(0.0)), "low": F.lit(-64.0), "high": F.lit(64.0)}), "dual")
    rate = _rate(cap)
    for _ in range(rounds):
        open_ = state.where("dual IS NOT NULL").select(F.col("source").alias("of"), "dual")
        tokens = F.col("n") * F.col("size")
        sums = (
            hist.join(open_, F.col("source").eqNullSafe(F.col("of")))
            .groupBy("source")
            .agg(_exact(tokens * rate).alias("got"), _exact(F.when(rate < cap, tokens * rate * _tilt()).otherwise(0.0)).alias("slope"))
            .withColumnRenamed("source", "of")
        )
        sums = materialize(sums, "sums")
        step = F.col("dual") - (F.col("got") - F.col("target")) / F.col("slope")
        over = F.col("got") > F.col("target")
        moved = (
            state.join(sums, F.col("source").eqNullSafe(F.col("of")), "left")
            .withColumn("off", F.abs(F.col("got") - F.col("target")) / F.greatest("target", F.lit(1.0)))
            .withColumn("high", F.when(over, F.col("dual")).otherwise(F.col("high")))
            .withColumn("low", F.when(~over, F.col("dual")).otherwise(F.col("low")))
            .withColumn("new", F.when((F.col("slope") > 0) & (step > F.col("low")) & (step < F.col("high")), step).otherwise((F.col("low") + F.col("high")) / 2))
            .withColumn("dual", F.when(F.col("off") > tolerance, F.col("new")).otherwise(F.col("dual")))
            .select("source", "source_size", "target", "dual", "low", "high", "off")
        )
        moved = materialize(moved, "dual")
        worst = moved.agg(F.max("off")).first()[0]
        release(state, sums)
        state = moved.drop("off")
        state._docveil_path = moved._docveil_path
        if worst is None or worst <= tolerance:
            break
    return state.select("source", "source_size", "target", "dual")


def _exact(term: Column) -> Column:
    return F.sum(term.cast("decimal(28,6)")).cast("double")


def _tilt() -> Column:
    """From 0.5 for a word to about 1.5 for a million."""
    return F.lit(0.5) + F.log2(F.lit(1.0) + F.col("size")) / 20


def _rate(cap: float) -> Column:
    return F.when(F.col("dual").isNull(), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.col("dual") * _tilt())))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, seed: int = 11, keep: list[str] | None = None) -> DataFrame:
    """docs (or their columns in keep) with size, source_size, target, rate, copies and taken.

    Each row is taken copies times (0 to cap); taken = copies * size. A rate is
    rounded up or down by a hash of doc_id and text length, then what a source misses or
    has too much is made good by one copy more or less of its smallest
    documents, as far as that brings the sum nearer. Null texts and
    sources, repeated rows and empty tables are taken like others.
    """
    made = ["size", "source_size", "target", "rate", "copies", "taken"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made and c != "source"]
    sized = materialize(docs.select(*kept, F.col("source"), word_count(F.col("text")).alias("size"), (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.length("text")), F.lit(1 << 53)) / float(1 << 53)).alias("__u")), "sized")
    hist = materialize(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    sources = hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    state = balance(hist, source_targets(sources, weights, share, cap), cap)

    def with_state(rows: DataFrame, of: DataFrame) -> DataFrame:
        return rows.join(of.withColumnRenamed("source", "__of"), F.col("source").eqNullSafe(F.col("__of"))).drop("__of")

    rated = with_state(sized, state).withColumn("rate", _rate(cap)).withColumn("copies", F.least(F.floor(F.col("rate") + F.col("__u")), F.lit(cap)).cast("long"))
    rated = materialize(rated.drop("dual"), "rated")
    short = rated.groupBy("source").agg(F.max("target").alias("__target"), F.sum(F.col("copies") * F.col("size")).alias("__got"))
    short = materialize(short.select("source", (F.col("__target") - F.col("__got")).alias("__short")), "short")
    more = F.col("__short") > 0
    able = F.when(more, F.col("copies") < cap).otherwise(F.col("copies") > 0)
    ordered = running_sum(with_state(rated, short).withColumn("__able", F.when(able, F.col("size")).otherwise(F.lit(0))), [F.col("source"), F.col("size"), F.col("__u")], F.col("__able"), "__before")
    ordered = materialize(ordered, "ordered")
    first = materialize(ordered.groupBy("source").agg(F.min("__before").alias("__first")), "first")
    within = F.col("__before") - F.col("__first") + F.col("__able") / 2 <= F.abs("__short")
    move = F.when((F.col("__able") > 0) & within, F.when(more, F.lit(1)).otherwise(F.lit(-1))).otherwise(F.lit(0))
    out = with_state(ordered, first).withColumn("copies", (F.col("copies") + move).cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*kept, "source", *made)

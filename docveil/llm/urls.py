"""URL filter: a sort-merge range join of reversed-host keys with nested rules."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docveil.shared import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parse_rule(text: str) -> tuple[str, str, str]:
    """'allow example.com/en/7' -> (host, path, verdict)."""
    verdict, _, where = text.partition(" ")
    host, slash, path = where.partition("/")
    if verdict not in ("allow", "block") or not host:
        raise ValueError(f"not a rule: {text!r}")
    return host.lower(), slash + path, verdict


def host_key(host: Column) -> Column:
    """Labels from the right, each closed by a dot: a domain's key begins the keys of its subdomains."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


@dataclass
class Interval:
    """All keys that begin with key, and the rules of that host."""

    key: str
    host: str
    paths: dict[str, str] = field(default_factory=dict)
    lengths: list[int] = field(default_factory=list)

    def add(self, path: str, verdict: str) -> None:
        """Of two verdicts on one rule, block counts."""
        self.paths[path] = "block" if "block" in (verdict, self.paths.get(path)) else verdict
        if len(path) not in self.lengths:
            self.lengths = sorted([*self.lengths, len(path)], reverse=True)


class Sweep:
    """Meets keys in ascending order, a host's rules before its pages; holds the nested intervals that the last key lies in."""

    def __init__(self) -> None:
        self.stack: list[Interval] = []

    def at(self, key: str) -> list[Interval]:
        while self.stack and not key.startswith(self.stack[-1].key):
            self.stack.pop()
        return self.stack

    def rule(self, key: str, host: str, path: str, verdict: str) -> None:
        stack = self.at(key)
        if not stack or stack[-1].key != key:
            stack.append(Interval(key, host))
        stack[-1].add(path, verdict)


def longest(active: list[Interval], path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule; of equally long ones the one with the longer host."""
    best = None
    for x in reversed(active):
        for n in x.lengths:
            if n <= len(path) and path[:n] in x.paths:
                if best is None or len(x.host) + n > best[0]:
                    best = (len(x.host) + n, x.host + path[:n], x.paths[path[:n]])
                break
    return best and best[1:]


def split_url(pages: DataFrame) -> DataFrame:
    """host and path of each url; both empty for a null and where there is no '://'."""
    rest = F.expr("if(instr(url, '://') > 0, substring(url, instr(url, '://') + 3), '')")
    return (
        pages.withColumn("__rest", F.coalesce(rest, F.lit("")))
        .withColumn("__host", F.regexp_extract("__rest", r"^[^/?#]*", 0))
        .withColumn("path", F.regexp_extract(F.expr("substring(__rest, length(__host) + 1)"), r"(?s)^[^?#]*", 0))
        .withColumn("host", F.translate("__host", UPPER, LOWER))
        .drop("__rest", "__host")
    )


def judge_urls(pages: DataFrame, rules: list[str] | DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages; rules are lines or a table (host, path, verdict).

    Pages and rules together are dealt by ranges of (key, hash), so one host's pages may
    lie in many ranges, and no list of rules is held by the driver or sent to all. A rule's interval may
    go beyond the range it lies in; so the rules on a range's first key, which are those of the domains above it, are joined to the
    range. Each range is then sorted and swept once. Intervals cover hosts: a rule fits subdomains too, so
    host and path together are no prefix of what it fits; the paths of the hosts on the stack are looked up by length.
    Where no rule fits, rule is null and verdict is the default. Null urls, and those without '://', have an empty host; repeated rows
    come back as often; other columns are not read; an empty table gives an empty one.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([parse_rule(r) for r in rules], "host string, path string, verdict string")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = pages.schema["page_id"].dataType
    asked = split_url(pages.select("page_id", F.col("url").cast("string").alias("url"))).select("page_id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    told = rules.select(F.lit(None).cast(kind).alias("page_id"), F.lower("host").alias("host"), "path", "verdict").distinct()
    both = asked.unionByName(told).withColumn("key", host_key(F.col("host")))
    order = ["key", F.col("verdict").isNull(), F.xxhash64("page_id", "path")]
    both = materialize(both.repartitionByRange(width, *order).withColumn("range", F.spark_partition_id()), "ranges")

    # Domains above a range's first key, each with its key, whose rules lie in an earlier range.
    label = F.split(F.regexp_replace("low", r"\.$", ""), r"\.", -1)
    first = both.groupBy("range").agg(F.min("key").alias("low")).select("range", label.alias("label"))
    above = first.select("range", F.explode(F.transform(F.sequence(F.lit(1), F.size("label")), lambda n: F.concat(F.array_join(F.slice("label", F.lit(1), n), "."), F.lit(".")))).alias("above"))
    early = both.where("verdict IS NOT NULL").withColumnRenamed("range", "was")
    brought = early.join(above, early.key == above.above).where(F.col("was") < F.col("range")).select(*both.columns)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, swept = None, Sweep()
        for batch in batches:
            ids, found = [], []
            for k, (place, key, host, path, verdict) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("range", "key", "host", "path", "verdict")), strict=True)):
                if place != at:
                    at, swept = place, Sweep()
                if verdict is not None:
                    swept.rule(key, host, path, verdict)
                else:
                    ids.append(k)
                    found.append(longest(swept.at(key), path) or (None, default))
            rows = batch.take(pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("page_id", "host", "path")), *(pa.array([x[k] for x in found], pa.string()) for k in (0, 1))], ["page_id", "host", "path", "rule", "verdict"])

    ordered = both.unionByName(brought).repartition(width, "range").sortWithinPartitions("range", "key", F.col("verdict").isNull())
    return ordered.mapInArrow(sweep, f"page_id {kind.simpleString()}, host string, path string, rule string, verdict string")

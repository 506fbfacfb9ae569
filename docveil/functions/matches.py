"""All matches of a pattern with their positions, as column expressions.

Pieces between matches and the matches themselves alternate, so positions
follow from running lengths; they are code points, half-open. A pattern must not match an empty string.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,value:string>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def exploded(df: DataFrame, values: Column, name: str, *held: str) -> DataFrame:
    """held and a row for each of values, which are worked out once: no filter on them, inferred or the caller's, is moved before them. Null values give no row.

    Spark compiles what makes them only where it is a step before the explosion.
    """
    return df.select(*held, values.alias("__values")).select(*held, F.explode_outer("__values").alias(name)).where(F.col(name).isNotNull())


#: Matches that are placed together. A fold copies what it has so far at each step, so it runs over parts of this length, and once over the parts.
PART = 64


def spans(text: Column, pattern: str | Column) -> Column:
    """array<struct<start, end, value>> in the order of the text; empty for a null text."""
    whole = F.coalesce(text, F.lit(""))
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, x: Column) -> Column:
        low = acc["at"] + F.length(x["gap"])
        high = low + F.length(x["value"])
        made = F.struct(low.alias("start"), high.alias("end"), x["value"].alias("value"))
        return F.struct(high.alias("at"), F.concat(acc["out"], F.array(made)).alias("out"))

    def parts(pairs: Column) -> Column:
        def part(acc: Column, k: Column) -> Column:
            begun = F.struct(acc["at"].alias("at"), none.alias("out"))
            own = F.aggregate(F.slice(pairs, k * PART + 1, F.lit(PART)), begun, step)
            return let(own, lambda o: F.struct(o["at"].alias("at"), F.concat(acc["outs"], F.array(o["out"])).alias("outs")))

        begun = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("outs"))
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / PART).cast("int")), begun, part, lambda acc: F.flatten(acc["outs"]))

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(whole, F.lit(pattern), F.lit(-1)), F.lit(1), F.size(found))
        return F.when(F.size(found) == 0, none).otherwise(let(F.arrays_zip(gaps.alias("gap"), found.alias("value")), parts))

    return let(F.regexp_extract_all(whole, F.lit(pattern), F.lit(0)), placed)


def group_spans(text: Column, pattern: str, group: int) -> Column:
    """Like spans(), for a group that ends where its match ends."""
    return F.transform(
        spans(text, pattern),
        lambda s: F.struct(
            (s["end"] - F.length(F.regexp_extract(s["value"], pattern, group))).cast("int").alias("start"),
            s["end"].alias("end"),
            F.regexp_extract(s["value"], pattern, group).alias("value"),
        ),
    )


def quoted(text: Column) -> Column:
    """A pattern that matches just the text."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def starts(text: Column, needle: Column) -> Column:
    """array<int>: every place of a needle, overlapping ones too. Only its first character is matched, the rest is looked ahead at."""
    pattern = F.concat(quoted(F.substring(needle, 1, 1)), F.lit("(?="), quoted(F.substring(needle, F.lit(2), F.length(needle))), F.lit(")"))
    return F.transform(spans(text, pattern), lambda s: s["start"])

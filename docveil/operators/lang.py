"""Evidence of language and of prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docveil.functions.matches import let

# Function words of both languages, and thresholds.
ENGLISH = (
    "the and of in is that with this be are was were shall which from have has been not any all such said will would may must other than "
    "their there upon herein hereby between under above who whom whose when where while these those it its"
).split()
DANISH = (
    "og ikke til at som med af har kan skal ved om eller der fra paa på det den er en et var blev efter over under mellem samt hvis fordi "
    "men også ingen hver"
).split()
LEAST_TOKENS = 12
LEAST_PROSE = 0.10
ENGLISH_SHARE, ENGLISH_MARGIN, MODEL_RATIO = 0.06, 2.0, 6.0
TOKEN = r"[a-zA-ZæøåÆØÅ][a-zA-ZæøåÆØÅ']*"


def word_score(text: Column) -> Column:
    """struct<tokens, en, da, en_ratio, prose>."""
    tokens = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.lower(t))

    def counts(found: Column) -> Column:
        return F.struct(F.size(found).alias("tokens"), _among(found, ENGLISH).alias("en"), _among(found, DANISH).alias("da"))

    def shares(c: Column) -> Column:
        ratio = lambda x: F.when(c["tokens"] > 0, x / c["tokens"]).otherwise(0.0)
        return F.struct(c["tokens"].alias("tokens"), c["en"].alias("en"), c["da"].alias("da"), ratio(c["en"]).alias("en_ratio"), ratio(F.greatest(c["en"], c["da"])).alias("prose"))

    return let(let(tokens, counts), shares)


def _among(found: Column, words: list[str]) -> Column:
    return F.size(F.filter(found, lambda t: t.isin(*words)))


def is_prose(score: Column) -> Column:
    return (score["tokens"] >= LEAST_TOKENS) & (score["prose"] >= LEAST_PROSE)


def looks_english(score: Column, model_ratio: Column | None = None) -> Column:
    """By a model's p(en) / p(da) where there is one, else by function words."""
    words = (score["en_ratio"] >= ENGLISH_SHARE) & (score["en"] >= ENGLISH_MARGIN * score["da"])
    said = words if model_ratio is None else F.when(model_ratio.isNull(), words).otherwise(model_ratio >= MODEL_RATIO)
    return (score["tokens"] >= LEAST_TOKENS) & said

"""Evidence from the corpus that a word is a name.

How a word is written elsewhere tells it: a name has its capital inside sentences too, and is not written small.
Spans: (page_uid, entity, start, end, value, ...); statistics: one row for each word in lower case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docveil.functions.matches import spans
from docveil.functions.stem import stem
from docveil.operators.lang import is_prose, word_score
from docveil.shared import by_exchange

TOKEN = r"\p{L}[\p{L}\p{N}'’-]*"
#: A token at the beginning of a text, line, cell or sentence: its capital tells nothing.
FIRST = r"(?:^|[.!?:;|\n\r\t])[\s\"'«»(\[*#>-]*(" + TOKEN + ")"
#: Places of a text that spans and tokens are dealt by.
STRETCH = 64
#: Of so many occurrences one at most is written small, if a word is a name without its capital too.
RARELY_SMALL = 10


def case_counts(pages: DataFrame) -> DataFrame:
    """(word, n_small, n_inside, n_first): how often each word of pages(text) is written small, with a capital inside a sentence, and with one at its beginning.

    Written forms are counted before the texts' forms of one word meet, so little is moved.
    """
    told = F.concat(
        F.transform(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)), lambda w: F.struct(w.alias("form"), F.lit(0).alias("first"))),
        F.transform(F.regexp_extract_all("text", F.lit(FIRST), F.lit(1)), lambda w: F.struct(w.alias("form"), F.lit(1).alias("first"))),
    )
    forms = pages.select(F.explode(told).alias("t")).groupBy("t.form").agg(F.count_if(F.col("t.first") == 0).alias("n"), F.sum("t.first").alias("n_first"))
    capital = F.col("form").rlike(r"^\p{Lu}")
    return forms.groupBy(F.lower("form").alias("word")).agg(
        F.sum(F.when(~capital, F.col("n")).otherwise(0)).alias("n_small"),
        F.sum(F.when(capital, F.col("n") - F.col("n_first")).otherwise(0)).alias("n_inside"),
        F.sum(F.when(capital, F.col("n_first")).otherwise(0)).alias("n_first"),
    )


def word_evidence(counts: DataFrame) -> DataFrame:
    """(word, is_name, keeps, small_name) of case_counts().

    is_name: inside sentences the word has its capital as often as not. keeps: so have all words of its stem together, as an inflected
    common noun would show. small_name: hardly ever written small at all. Words are met with their stems by an equi-join.
    """
    stemmed = counts.withColumn("stem", stem(F.col("word")))
    family = stemmed.groupBy("stem").agg(F.sum("n_small").alias("small"), F.sum("n_inside").alias("inside"))
    seen = F.col("n_small") + F.col("n_inside")
    return stemmed.join(family, "stem").select(
        "word",
        ((seen > 0) & (2 * F.col("n_inside") >= seen)).alias("is_name"),
        (2 * F.col("inside") >= F.col("small") + F.col("inside")).alias("keeps"),
        (RARELY_SMALL * F.col("n_small") <= seen + F.col("n_first")).alias("small_name"),
    )


def touching_tokens(found: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_uid, start, end, token_start, token): capitalised tokens of a page that share a place with a span of found.

    Only pages with spans are looked at. Both sides are dealt by page and stretch of STRETCH places, so a long page's spans and tokens meet
    along its length and not all with all.
    """
    own = found.select("page_uid", "start", "end").distinct()
    ends = own.select("*", F.explode(F.sequence(F.floor(F.col("start") / STRETCH), F.floor((F.greatest("end", F.col("start") + 1) - 1) / STRETCH))).alias("stretch"))
    texts = pages.join(by_exchange(own.select("page_uid").distinct()), "page_uid", "left_semi")
    tokens = texts.select("page_uid", F.explode(spans(F.col("text"), TOKEN)).alias("t")).where(F.col("t.value").rlike(r"^\p{Lu}"))
    parts = F.sequence(F.floor(F.col("t.start") / STRETCH), F.floor((F.col("t.end") - 1) / STRETCH))
    dealt = tokens.select("page_uid", F.col("t.start").alias("token_start"), F.col("t.end").alias("token_end"), F.col("t.value").alias("token"), F.explode(parts).alias("stretch"))
    met = ends.join(by_exchange(dealt), ["page_uid", "stretch"]).where((F.col("token_start") < F.col("end")) & (F.col("token_end") > F.col("start")))
    return met.select("page_uid", "start", "end", "token_start", "token").distinct()


def name_evidence(found: DataFrame, pages: DataFrame, evidence: DataFrame) -> DataFrame:
    """found with has_name, keeps_capital, is_name_lower and words, as plausible_names() takes them.

    found has spans of names only. is_name_lower is asked on pages that are no prose, and there only if some word of the
    page's spans passes; else it is null. A span without a capitalised token has no evidence.
    """
    tokens = touching_tokens(found, pages).withColumn("word", F.lower("token"))
    told = tokens.join(evidence, "word", "left")
    grouped = told.groupBy("page_uid", "start", "end").agg(
        F.bool_or(F.coalesce("is_name", F.lit(False))).alias("has_name"),
        F.bool_or(F.coalesce("keeps", F.lit(False))).alias("keeps_capital"),
        F.bool_or(F.coalesce("small_name", F.lit(False))).alias("__small"),
        F.transform(F.array_sort(F.collect_list(F.struct("token_start", "token"))), lambda t: t["token"]).alias("words"),
    )
    plain = pages.select("page_uid", (~is_prose(word_score(F.col("text")))).alias("__table"))
    asked = grouped.join(by_exchange(plain), "page_uid").groupBy("page_uid").agg(F.bool_or(F.col("__small") & F.col("__table")).alias("__asked"))
    rows = found.join(by_exchange(grouped), ["page_uid", "start", "end"], "left").join(by_exchange(asked), "page_uid", "left")
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("has_name", "keeps_capital")}
    small = F.when(F.coalesce("__asked", F.lit(False)), F.coalesce("__small", F.lit(False)))
    return rows.withColumns({**flags, "is_name_lower": small, "words": F.coalesce("words", F.array().cast("array<string>"))}).drop("__small", "__asked").select(*found.columns, "has_name", "keeps_capital", "is_name_lower", "words")


"""A language model of letters: trigrams of words, counted in one aggregate over texts whose language is known.

Scores are whole thousandths of natural logarithms, so that sums do not depend on their order.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trigrams of a model at most, the most frequent ones; this bounds what is sent to the workers.
MOST_GRAMS = 1 << 17
WORD = r"\p{L}+"
_WORD = regex.compile(WORD)


def grams(word: Column) -> Column:
    """The trigrams of a word with a blank on either side."""
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda k: F.substring(F.concat(F.lit(" "), word, F.lit(" ")), k, F.lit(3)))


def fit(texts: DataFrame, lang: str = "lang", most: int = MOST_GRAMS) -> DataFrame:
    """(gram, scores): for each language of texts(text, lang) the logarithm of (count + 1) / (all + number of grams).

    Words are counted before trigrams are made of them. Rows without a language or a text tell nothing.
    """
    words = texts.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("word"))
    counted = words.groupBy("lang", "word").agg(F.count("*").alias("n")).select("lang", F.explode(grams(F.col("word"))).alias("gram"), "n")
    each = counted.groupBy("gram", "lang").agg(F.sum("n").alias("n")).groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("counts"), F.sum("n").alias("n"))
    kept = each.orderBy(F.desc("n"), "gram").limit(most)
    totals = kept.select(F.explode("counts").alias("lang", "n")).groupBy("lang").agg(F.sum("n").alias("total"))
    whole = totals.agg(F.map_from_entries(F.collect_list(F.struct("lang", "total"))).alias("totals")).crossJoin(kept.agg(F.count("*").alias("size")))
    score = F.transform_values("totals", lambda k, total: F.floor(1000 * F.ln((F.coalesce(F.try_element_at("counts", k), F.lit(0)) + 1) / (total + F.col("size")))).cast("long"))
    return kept.crossJoin(F.broadcast(whole)).select("gram", score.alias("scores"))


def _scorer(model: list[tuple[str, dict[str, int]]]):
    langs = sorted({k for _, scores in model for k in scores})
    table = {g: tuple(scores[k] for k in langs) for g, scores in model}
    none = (0,) * len(langs)

    def score(texts: pa.Array) -> pa.Array:
        seen: dict[str, tuple[int, ...]] = {}
        out = []
        for text in texts:
            total = [0] * len(langs)
            for word in _WORD.findall((text.as_py() or "").lower()):
                own = seen.get(word)
                if own is None:
                    padded = f" {word} "
                    found = [table.get(padded[k : k + 3], none) for k in range(len(word))]
                    own = seen[word] = tuple(map(sum, zip(*found, strict=True)))
                for k, s in enumerate(own):
                    total[k] += s
            out.append(list(zip(langs, total, strict=True)))
        return pa.array(out, pa.map_(pa.string(), pa.int64()))

    return score


def language_scores(texts: DataFrame, model: DataFrame, out: str = "scores") -> DataFrame:
    """texts with the score of each language of the model, zero for a text without words. Trigrams that the model does not have count for none.

    The model, which fit() bounds, is sent; texts are read once and not moved.
    """
    rows = [(r["gram"], r["scores"]) for r in model.collect()]
    return texts.withColumn(out, F.arrow_udf(_scorer(rows), "map<string,long>")("text"))


def log_odds(scores: Column, lang: str, other: str | None = None) -> Column:
    """The logarithm of p(lang) / p(other), or of p(lang) to that of the likeliest other language."""
    own = F.coalesce(F.try_element_at(scores, F.lit(lang)), F.lit(0))
    rest = F.try_element_at(scores, F.lit(other)) if other else F.array_max(F.map_values(F.map_filter(scores, lambda k, _: k != lang)))
    return (own - F.coalesce(rest, F.lit(0))) / 1000


def model_ratio(scores: Column, lang: str = "en", other: str | None = "da") -> Column:
    """p(lang) / p(other) as looks_english() takes it; null where the model does not know both."""
    known = F.map_contains_key(scores, lang) & (F.map_contains_key(scores, other) if other else F.size(scores) > 1)
    return F.when(known, F.exp(log_odds(scores, lang, other)))

"""Quality rules with host verdicts shrunk by an empirical beta prior."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docveil.llm.words import words
from docveil.shared import materialize

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"

_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_shout_words long"


def repeated_words(found: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text holds twice or more."""
    n = len(found) - 2
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in found), np.int64, len(found))
    _, pair = np.unique(at[:-1] * len(ids) + at[1:], return_inverse=True)
    _, which, times = np.unique(pair[:-1] * len(ids) + at[2:], return_inverse=True, return_counts=True)
    again = np.zeros(len(found) + 1, np.int64)
    starts = np.nonzero(times[which] > 1)[0]
    again[starts] += 1
    again[starts + 3] -= 1  # each start is met once
    return int((np.cumsum(again)[:-1] > 0).sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The values of _STATS; all zero for a null."""
    if not text:
        return (0,) * 7
    found = words(text)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    shouted = sum(1 for w in found if len(w) > 1 and w.isupper())
    return (len(found), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(found), len(lines), shouted)


def stats_array(texts: pa.Array) -> pa.Array:
    rows = [text_stats(x.as_py()) for x in texts]
    names = [c.split()[0] for c in _STATS.split(", ")]
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: Soft rules by name, as SQL over the statistics: a failure, which clean prose never shows, and the strict form, which some clean texts break.
SOFT_RULES = {
    "symbols": ("5 * n_symbols > n_words", "10 * n_symbols > n_words"),
    "dup_lines": ("2 * n_dup_lines > n_lines", "4 * n_dup_lines > n_lines"),
    "word_length": ("word_chars < 2 * n_words OR word_chars > 14 * n_words", "word_chars < 3 * n_words OR word_chars > 10 * n_words"),
    "shouting": ("2 * n_shout_words > n_words", "4 * n_shout_words > n_words"),
    "repeats": ("5 * n_repeat_words > 2 * n_words", "5 * n_repeat_words > n_words"),
}
#: Of the posterior of a host's rate, the deviations between its mean and the bounds that verdicts ask for (nineteen in twenty).
SURE = 1.645
TRUSTED, CONDEMNED, ORDINARY = "trusted", "condemned", "ordinary"


def host_verdicts(judged: DataFrame, host: str, trusted_rate: float, condemned_rate: float) -> DataFrame:
    """(host, n_docs, n_failed, fail_rate, verdict) of each host.

    The rates' prior is a beta distribution with the mean and variance of the
    observed host rates, by moments over all hosts; fail_rate is the posterior
    mean, so a host of few documents stays near the common rate. A null is
    a host of its own. A host is trusted if its rate lies surely below trusted_rate, condemned if
    surely above condemned_rate, else ordinary.
    """
    hosts = materialize(judged.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), F.sum((F.col("base_failed") | (F.col("n_soft") > 0)).cast("long")).alias("n_failed")), "hosts")
    rate = F.col("n_failed") / F.col("n_docs")
    mean, spread, noise = hosts.agg(F.avg(rate), F.coalesce(F.var_samp(rate), F.lit(0.0)), F.avg(F.lit(1.0) / F.col("n_docs"))).first()
    a, b = beta_prior(mean, spread, noise)
    fail = F.col("fail_rate")
    bound = SURE * F.sqrt(fail * (1 - fail) / (F.col("n_docs") + F.lit(a + b + 1)))
    verdict = F.when(fail + bound < trusted_rate, TRUSTED).when(fail - bound > condemned_rate, CONDEMNED).otherwise(ORDINARY)
    return hosts.withColumn("fail_rate", (F.col("n_failed") + F.lit(a)) / (F.col("n_docs") + F.lit(a + b))).withColumn("verdict", verdict)


def beta_prior(mean: float | None, spread: float, noise: float | None) -> tuple[float, float]:
    """Parameters from the mean and variance of host rates, less the variance that counting alone gives."""
    if mean is None:
        return 1.0, 1.0
    level = min(max(mean, 0.001), 0.999)
    true = max(spread - level * (1 - level) * noise, level * (1 - level) / 1000)
    size = min(max(level * (1 - level) / true - 1, 2.0), 1000.0)
    return level * size, (1 - level) * size


def judge_quality(docs: DataFrame, host: str = "source", trusted_rate: float = 0.05, condemned_rate: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """docs (or their columns in keep) with statistics, base_failed, n_soft, n_strict, fail_rate, verdict and kept.

    A document goes if a base rule fails, or if it fails a soft rule, of which a trusted host's documents
    may fail one; on a condemned host it goes if it breaks the strict form of a rule. So the verdict on its host
    can save a document and can cost it, while one that is clean by the strict rules is kept on any host.
    A null or empty text has no words and fails. Repeated rows are judged and counted one by one; columns that clash
    with a new one are replaced; an empty table gives an empty one.
    """
    names = [c.split()[0] for c in _STATS.split(", ")]
    made = [*names, "base_failed", "n_soft", "n_strict", "fail_rate", "verdict", "kept"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]
    soft, strict = (sum((F.expr(rule[k]).cast("int") for rule in SOFT_RULES.values()), F.lit(0)) for k in (0, 1))
    judged = docs.select(*kept, F.col(host).alias("__host"), F.arrow_udf(lambda x: stats_array(x), _STATS)(F.col("text").cast("string")).alias("__q")).select(*kept, "__host", "__q.*")
    judged = materialize(judged.withColumn("base_failed", base_failed()).withColumns({"n_soft": soft, "n_strict": strict}), "judged")
    hosts = materialize(host_verdicts(judged, "__host", trusted_rate, condemned_rate).select("host", "fail_rate", "verdict"), "verdicts").withColumnRenamed("host", "__verdict_of")
    allowed = F.when(F.col("verdict") == TRUSTED, 1).otherwise(0)
    good = ~F.col("base_failed") & (F.col("n_soft") <= allowed) & ((F.col("verdict") != CONDEMNED) | (F.col("n_strict") == 0))
    return judged.join(hosts, F.col("__host").eqNullSafe(F.col("__verdict_of"))).withColumn("kept", good).select(*kept, *made)


__all__ = ["SOFT_RULES", "beta_prior", "host_verdicts", "judge_quality", "repeated_words", "stats_array", "text_stats"]

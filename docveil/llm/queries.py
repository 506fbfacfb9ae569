"""The queries of the operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docveil.llm import sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docveil.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docveil.llm.quality import judge_quality

    judged = judge_quality(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_soft", "n_strict", "verdict")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docveil.llm.personal import find_personal

    return find_personal(_table(spark, sf_dir, "documents")).drop("span_list")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docveil.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken", "copies")


#: The rules of the URL query.
URL_RULES = ["block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/"]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docveil.llm.urls import judge_urls

    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docveil.llm.sharding import shard

    return shard(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docveil.llm.html import extract_text

    return extract_text(_table(spark, sf_dir, "pages"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docveil.llm.lm import score

    return score(_table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 != 2)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docveil.llm.tokens import PIECES, count_tokens, load_pieces

    return count_tokens(_table(spark, sf_dir, "documents"), load_pieces(PIECES))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docveil.llm.decontaminate import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docveil.llm.search import build_index, search

    return search(build_index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark")).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docveil.llm.manifest import lower_text, manifest, proof

    made = manifest(_table(spark, sf_dir, "documents"), tampered=F.crc32(F.col("doc_id").cast("string")) % 5 == 0, tamper=lower_text())
    return made.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def op13_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docveil.llm.media import media_columns

    payload, media = F.col("payload"), F.col("media")
    return media_columns(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"),
        F.octet_length(media).cast("long").alias("media_bytes"), F.sha2(media, 256).alias("media_sha256"), "feature",
    )


# What SQL can say of operators whose whole result it can't.


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op13 says of the payloads alone."""
    return op13_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")


def similar_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of the similarity that the pipeline's near-dedup takes."""
    from docveil.llm.simhash import similar_documents

    return similar_documents(_table(spark, sf_dir, "documents")).select("doc_id", "component_id")


def personal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docveil.llm.personal import find_personal

    return find_personal(_table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docveil.llm.mixing import mix

    mixed = mix(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    near = F.abs(F.sum("taken").over(Window.partitionBy("source")) - F.col("target")) <= 0.02 * F.col("target") + F.max("size").over(Window.partitionBy("source"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), (F.col("taken") <= 2 * F.col("size")).alias("bounded"), near.alias("near"))


def shard_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = op6_sharding(spark, sf_dir).groupBy(F.col("shard").cast("long").alias("shard"))
    return slots.agg(F.count("*").alias("n"), F.count_distinct("slot").alias("n_slots"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.min("law").alias("law"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    parts = (similar_groups, personal_counts, mixing_targets, shard_laws, media_payloads)
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)} | {f.__name__: f for f in parts}


#: The same parse of urls, then every rule against every url; the longest that fits.
_URL_SQL = """
WITH rules(host, path, verdict) AS (VALUES {rules}),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id, r, regexp_extract(coalesce(r, ''), '^[^/?#]*') AS h FROM rest),
parts AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(coalesce(r, ''), length(h) + 1), '^[^?#]*', 0, 's') AS path FROM cut),
judged AS (SELECT page_id, host, path,
  (SELECT max_by(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host || r.path)) FROM rules r
   WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS best FROM parts p)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM judged
"""


def _url_sql() -> str:
    from docveil.llm.urls import parse_rule

    return _URL_SQL.format(rules=", ".join(str(parse_rule(r)) for r in URL_RULES))


#: Base values from words and lines, soft rules, the beta prior by moments, and verdicts.
_QUALITY_SQL = r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS k FROM w),
win AS (SELECT doc_id, k, x, lead(x) OVER p AS y, lead(x, 2) OVER p AS z FROM t WINDOW p AS (PARTITION BY doc_id ORDER BY k)),
twice AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, x, y, z) AS n FROM win WHERE z IS NOT NULL),
again AS (SELECT DISTINCT doc_id, k + o AS k FROM (SELECT doc_id, k, unnest([0, 1, 2]) AS o FROM twice WHERE n > 1)),
reps AS (SELECT doc_id, count(*) AS n_repeat_words FROM again GROUP BY doc_id),
shouts AS (SELECT doc_id, count(*) FILTER (octet_length(encode(x)) > 1 AND regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]')) AS n_shout FROM t GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w),
dups AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (SELECT w.doc_id, source, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_shout, 0) AS n_shout
  FROM w LEFT JOIN reps USING (doc_id) LEFT JOIN dups USING (doc_id) LEFT JOIN shouts USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  (5 * n_symbols > n_words)::INT + (2 * n_dup_lines > n_lines)::INT + (word_chars < 2 * n_words OR word_chars > 14 * n_words)::INT + (2 * n_shout > n_words)::INT + (5 * n_repeat_words > 2 * n_words)::INT AS n_soft,
  (10 * n_symbols > n_words)::INT + (4 * n_dup_lines > n_lines)::INT + (word_chars < 3 * n_words OR word_chars > 10 * n_words)::INT + (4 * n_shout > n_words)::INT + (5 * n_repeat_words > n_words)::INT AS n_strict FROM base),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR n_soft > 0) AS bad FROM judged GROUP BY source),
moments AS (SELECT least(greatest(avg(bad / n), 0.001), 0.999) AS level, coalesce(var_samp(bad / n), 0) AS spread, avg(1 / n) AS noise FROM hosts),
prior AS (SELECT level, least(greatest(level * (1 - level) / greatest(spread - level * (1 - level) * noise, level * (1 - level) / 1000) - 1, 2), 1000) AS size FROM moments),
rates AS (SELECT source, n, size, (bad + level * size) / (n + size) AS rate FROM hosts, prior),
bounds AS (SELECT source, rate, 1.645 * sqrt(rate * (1 - rate) / (n + size + 1)) AS bound FROM rates),
verdicts AS (SELECT source, CASE WHEN rate + bound < 0.05 THEN 'trusted' WHEN rate - bound > 0.5 THEN 'condemned' ELSE 'ordinary' END AS verdict FROM bounds)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_soft <= CASE WHEN verdict = 'trusted' THEN 1 ELSE 0 END AND (verdict <> 'condemned' OR n_strict = 0) AS kept, n_soft, n_strict, verdict
FROM judged JOIN verdicts ON judged.source IS NOT DISTINCT FROM verdicts.source
"""


#: All pairs of documents that share a shingle, their similarity, and what links reach.
_SIMILAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda k: hash(array_to_string(ws[k:k + 4], ' ')))) AS h FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
near AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
both_ AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, both_.b FROM reach JOIN both_ ON reach.b = both_.a)
SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
"""

_PERSONAL_SQL = r"""
WITH m AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS e, regexp_extract_all(coalesce(text, ''), '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') AS i,
  list_transform(regexp_extract_all(coalesce(text, ''), '[0-9](?:[ -]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS c, list_transform(regexp_extract_all(coalesce(text, ''), '\+[0-9][ ().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g'))) AS p FROM documents)
SELECT doc_id, len(e)::BIGINT AS n_email, len(list_filter(i, lambda x: len(list_filter(string_split(x, '.'), lambda y: length(ltrim(y, '0')) > 3 OR coalesce(try_cast(ltrim(y, '0') AS INT), 0) > 255)) = 0))::BIGINT AS n_ip,
len(list_filter(c, lambda x: length(x) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(x) + 1), lambda j: CASE WHEN (length(x) - j) % 2 = 0 THEN substr(x, j, 1)::INT ELSE 2 * substr(x, j, 1)::INT - CASE WHEN substr(x, j, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0))::BIGINT AS n_card,
len(list_filter(p, lambda x: x BETWEEN 10 AND 15))::BIGINT AS n_phone FROM m
"""

#: Sources stop in the order of what they can give for each weight; the level is the first that no further source stops at.
_TARGETS_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][r % 3 + 1] AS weight, 2.0 * source_size AS most, (SELECT 1.5 * sum(source_size) FROM s) AS total FROM s),
k AS (SELECT *, most / weight AS ratio, total - coalesce(sum(most) OVER (ORDER BY most / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(weight) OVER (ORDER BY most / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w),
l AS (SELECT (list(rest / free ORDER BY ratio, r))[1] AS level FROM k WHERE ratio > rest / free)
SELECT doc_id, size, source_size, round(least(most, coalesce((SELECT level FROM l), 1e300) * weight)::DOUBLE, 3) AS target, true AS bounded, true AS near FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source
"""

_SHARDS_SQL = """
WITH n AS (SELECT count(*) AS n FROM documents), s AS (SELECT unnest(range(24)) AS shard), c AS (SELECT shard, n // 24 + (shard < n % 24)::INT AS n FROM s, n)
SELECT shard, n::BIGINT AS n, n::BIGINT AS n_slots, 0::BIGINT AS low, (n - 1)::BIGINT AS high, 'rows' AS law FROM c WHERE n > 0
"""


def oracle_sql() -> dict[str, str]:
    parts = {"similar_groups": _SIMILAR_SQL, "personal_counts": _PERSONAL_SQL, "mixing_targets": _TARGETS_SQL, "shard_laws": _SHARDS_SQL, "media_payloads": sql.payloads_sql()}
    return {"op2_quality": _QUALITY_SQL, "op5_url_filter": _url_sql(), "op11_ranked_search": sql.search_sql(), "op12_merkle_manifest": sql.manifest_sql(), **parts}

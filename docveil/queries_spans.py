"""Registered queries of detection and resolution over texts made from the orders, and their SQL.

The texts follow templates, so where a span lies, and whether its number is valid, is known without any pattern.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docveil.functions import entities as E
from docveil.functions import ids
from docveil.functions.text import context_for
from docveil.operators import detect, resolve
from docveil.plans.anonymise import pseudonymise
from docveil.registry import query, table
from docveil.shared import dealt_evenly, materialize, new_path

# Expressions that Spark and DuckDB read alike.
_D = "concat(lpad(concat(dd, ''), 2, '0'), lpad(concat(mm, ''), 2, '0'), lpad(concat(yy, ''), 2, '0'))"
_S = "lpad(concat(k * 37 % 10000, ''), 4, '0')"
_V = "concat(20000000 + k * 7919 % 79999999, '')"
_A, _B = "lpad(concat(k * 104729 % 10000000, ''), 7, '0')", "lpad(concat(k * 1299709 % 10000000, ''), 7, '0')"
_CC = "lpad(concat(98 - ((k * 104729 % 10000000) * (10000000000000 % 97) + (k * 1299709 % 10000000) * (1000000 % 97) + 132000) % 97, ''), 2, '0')"
_TOWN = "CASE k % 4 WHEN 0 THEN '8500 Grenaa' WHEN 1 THEN '8500 Grena' WHEN 2 THEN '8500 Xyzby' ELSE '8500 Malling' END"
_KEYS = "o_orderkey AS k, o_orderkey % 15 AS kind, day(o_orderdate) AS dd, month(o_orderdate) AS mm, year(o_orderdate) % 100 AS yy"
_TEXT = f"""CASE kind WHEN 0 THEN concat('Hun er CPR ', {_D}, '-', {_S}, ' slut') WHEN 1 THEN concat('Nr ', {_D}, ' ', {_S}, ' slut')
  WHEN 2 THEN concat('Ref ', {_D}, {_S}, ' slut') WHEN 3 THEN concat('Tal 991399-', {_S}, ' slut') WHEN 4 THEN concat('Ring tlf +45', {_V}, ' slut')
  WHEN 5 THEN concat('Fax ', substr({_V}, 1, 2), ' ', substr({_V}, 3, 2), ' ', substr({_V}, 5, 2), ' ', substr({_V}, 7, 2), ' slut')
  WHEN 6 THEN concat('Mobil: ', {_V}, ' slut') WHEN 7 THEN concat('CVR-nr. ', {_V}, ' slut') WHEN 8 THEN concat('konto ', 1000 + k % 9000, ' ', 1000000 + k * 31 % 9000000, ' slut')
  WHEN 9 THEN concat('boede: Nørrevej ', k % 200 + 1, ' slut') WHEN 10 THEN concat('postnr ', {_TOWN}, ' slut') WHEN 11 THEN concat('se BS-', k % 999999, '/2019-ABC slut')
  WHEN 12 THEN concat('Sagsnr: Q', k, '-20/x9 slut') WHEN 13 THEN concat('skriv a', k, '@mail.dk nu') ELSE concat('IBAN DK', {_CC}, {_A}, {_B}, ' slut') END"""
_CODES = "VALUES (8500, 'Grenaa'), (8340, 'Malling'), (8000, 'Aarhus C')"


def _mod11(digits: str, weights: tuple[int, ...]) -> str:
    return "(" + " + ".join(f"{w} * substr({digits}, {k}, 1)::INT" for k, w in enumerate(weights, 1)) + ") % 11 = 0"


_EXPECTED = f"""
t AS (SELECT {_KEYS} FROM orders),
x AS (SELECT *, {_D} AS d, {_S} AS s, {_V} AS v, dd = 29 AND mm = 2 AND yy = 0 AND substr({_S}, 1, 1)::INT <= 3 AS bad,
  {_mod11(f"concat({_D}, {_S})", ids.CPR_WEIGHTS)} AS cpr_ok, {_mod11(_V, ids.CVR_WEIGHTS)} AS cvr_ok FROM t),
e(k, entity, off, value, score) AS (
  SELECT k, CASE WHEN bad THEN 'DK_CPR_MULIG' ELSE 'DK_CPR' END, 11, concat(d, '-', s), CASE WHEN bad THEN 0.8 WHEN cpr_ok THEN 1 ELSE 0.95 END FROM x WHERE kind = 0 AND (NOT bad OR k % 2 = 1)
  UNION ALL SELECT k, CASE WHEN bad THEN 'DK_CPR_MULIG' ELSE 'DK_CPR' END, 3, concat(d, ' ', s), CASE WHEN bad THEN 0.45 WHEN cpr_ok THEN 1 ELSE 0.5 END FROM x WHERE kind = 1 AND (NOT bad OR k % 2 = 1)
  UNION ALL SELECT k, CASE WHEN bad THEN 'DK_CPR_MULIG' ELSE 'DK_CPR' END, 4, concat(d, s), CASE WHEN bad THEN 0.45 ELSE 1 END FROM x WHERE kind = 2 AND CASE WHEN bad THEN k % 2 = 1 ELSE cpr_ok END
  UNION ALL SELECT k, 'DK_CPR_MULIG', 4, concat('991399-', s), 0.45 FROM x WHERE kind = 3 AND k % 2 = 1
  UNION ALL SELECT k, 'DK_PHONE', 9, concat('+45', v), 1 FROM x WHERE kind = 4
  UNION ALL SELECT k, 'DK_PHONE', 4, concat(substr(v, 1, 2), ' ', substr(v, 3, 2), ' ', substr(v, 5, 2), ' ', substr(v, 7, 2)), 0.5 FROM x WHERE kind = 5
  UNION ALL SELECT k, CASE WHEN cvr_ok THEN 'DK_CVR' ELSE 'DK_PHONE' END, 7, v, CASE WHEN cvr_ok THEN 1 ELSE 0.65 END FROM x WHERE kind = 6
  UNION ALL SELECT k, 'DK_CVR', 8, v, 1 FROM x WHERE kind = 7 AND cvr_ok
  UNION ALL SELECT k, 'DK_ACCOUNT', 6, concat(1000 + k % 9000, ' ', 1000000 + k * 31 % 9000000), 0.5 FROM x WHERE kind = 8
  UNION ALL SELECT k, 'DK_ADDRESS', 7, concat('Nørrevej ', k % 200 + 1), 0.85 FROM x WHERE kind = 9
  UNION ALL SELECT k, 'DK_POSTAL_CITY', 7, {_TOWN}, 1 FROM x WHERE kind = 10 AND k % 4 <> 2
  UNION ALL SELECT k, 'DK_CASE_NO', 3, concat('BS-', k % 999999, '/2019-ABC'), 0.6 FROM x WHERE kind = 11
  UNION ALL SELECT k, 'DK_CASE_NO', 8, concat('Q', k, '-20/x9'), 0.55 FROM x WHERE kind = 12
  UNION ALL SELECT k, 'EMAIL_ADDRESS', 6, concat('a', k, '@mail.dk'), 0.9 FROM x WHERE kind = 13
  UNION ALL SELECT k, 'IBAN_CODE', 5, concat('DK', {_CC}, {_A}, {_B}), 1 FROM x WHERE kind = 14)
"""


def made_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each order, with a number, address or the like of one of 15 kinds."""
    made = dealt_evenly(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")).selectExpr(*_KEYS.split(", "))
    return made.selectExpr("k AS page_uid", "k AS pos", "concat('page ', k) AS label", f"{_TEXT} AS text", "k % 2 = 1 AS ocr")


def _codes(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {_CODES} AS t(code, city)")


@query(f"WITH {_EXPECTED} SELECT k AS page_uid, entity, off::BIGINT AS start_at, (off + length(value))::BIGINT AS end_at, value, round(score::DOUBLE, 4) AS score FROM e")
def danish_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.detect(made_pages(spark, sf_dir), _codes(spark), ocr="ocr")
    return found.select("page_uid", "entity", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), "value", F.round("score", 4).alias("score"))


@query(f"""WITH {_EXPECTED.replace("x AS (", "x AS MATERIALIZED (").replace("value, score) AS (", "value, score) AS MATERIALIZED (")}, texts AS MATERIALIZED (SELECT k, {_TEXT} AS text FROM t),
g AS MATERIALIZED (SELECT entity, CASE WHEN entity IN ('DK_CPR', 'DK_CPR_MULIG', 'DK_PHONE', 'DK_CVR', 'DK_ACCOUNT') THEN regexp_replace(value, '[^0-9]', '', 'g') ELSE lower(trim(value, ' .,:;')) END AS key, k, off, value FROM e),
n AS (SELECT entity, key, min(k) AS f FROM g GROUP BY ALL),
l AS (SELECT *, CASE entity WHEN 'DK_CPR' THEN 'CPR-nummer' WHEN 'DK_CPR_MULIG' THEN 'CPR-nummer' WHEN 'DK_CVR' THEN 'CVR-nummer' WHEN 'DK_PHONE' THEN 'Telefonnummer' WHEN 'DK_ACCOUNT' THEN 'Kontonummer' WHEN 'DK_ADDRESS' THEN 'Adresse'
  WHEN 'DK_POSTAL_CITY' THEN 'Postnr-by' WHEN 'DK_CASE_NO' THEN 'Sagsnummer' WHEN 'EMAIL_ADDRESS' THEN 'E-mail' ELSE 'IBAN' END AS stem FROM n),
named AS MATERIALIZED (SELECT entity, key, stem || ' ' || row_number() OVER (PARTITION BY stem ORDER BY f) AS label FROM l),
put AS MATERIALIZED (SELECT g.k, g.off, g.value, named.label FROM g JOIN named ON named.key = g.key AND named.entity = g.entity)
SELECT texts.k AS page_uid, CASE WHEN put.k IS NULL THEN text ELSE concat(substr(text, 1, off), label, substr(text, off + 1 + length(value))) END AS rendered
FROM texts LEFT JOIN put ON put.k = texts.k""")
def pseudonymised_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialize(resolve.findings(detect.detect(made_pages(spark, sf_dir), _codes(spark), ocr="ocr", context=True), made_pages(spark, sf_dir), names=False), "findings")
    return resolve.render(made_pages(spark, sf_dir), found, resolve.assign_pseudonyms(resolve.group_findings(found))).select("page_uid", "rendered")


# --- spans as such -----------------------------------------------------

_ENTITIES = "CASE l_linenumber % 3 WHEN 0 THEN 'DK_CPR' WHEN 1 THEN 'EMAIL_ADDRESS' ELSE 'PERSON' END"
_RANK = "CASE entity WHEN 'DK_CPR' THEN 0 WHEN 'EMAIL_ADDRESS' THEN 8 ELSE 11 END"
_SPANS = f"l_orderkey AS page_uid, {_ENTITIES} AS entity, l_partkey % 40 AS s, l_partkey % 40 + 3 + l_suppkey % 12 AS e, (l_partkey * 7 + l_suppkey) % 10 AS score"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr(*_SPANS.split(", "))
    return rows.select("page_uid", "entity", F.col("s").cast("int").alias("start"), F.col("e").cast("int").alias("end"), (F.col("score") / 10).alias("score"))


def _folded(spark: SparkSession, sf_dir: str, fold) -> DataFrame:
    listed = _spans(spark, sf_dir).groupBy("page_uid").agg(F.collect_list(F.struct("entity", "start", "end", "score")).alias("f"))
    out = listed.select("page_uid", F.explode(fold(F.col("f"))).alias("s")).select("page_uid", "s.*")
    return out.select("page_uid", "entity", F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"), F.round("score", 2).alias("score"))


_LISTED = "SELECT page_uid, list_reduce(list_transform(l, lambda x: [x]), lambda a, x: {step}) AS kept FROM lists"
_OUT = "SELECT page_uid, k.entity AS entity, k.s::BIGINT AS s, k.e::BIGINT AS e, round(k.score / 10, 2) AS score FROM (SELECT page_uid, unnest(kept) AS k FROM folded)"


@query(f"""WITH spans AS (SELECT {_SPANS} FROM lineitem),
lists AS (SELECT page_uid, list(struct_pack(entity := entity, s := s, e := e, score := score) ORDER BY entity, s, e - s, e, score) AS l FROM spans GROUP BY page_uid),
folded AS ({_LISTED.format(step="CASE WHEN a[-1].entity = x[1].entity AND x[1].s < a[-1].e AND x[1].e > a[-1].s THEN CASE WHEN x[1].e - x[1].s < a[-1].e - a[-1].s OR x[1].score > a[-1].score THEN list_concat(a[1:len(a) - 1], x) ELSE a END ELSE list_concat(a, x) END")})
{_OUT}""")
def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded(spark, sf_dir, detect.merge_duplicates)


@query(f"""WITH spans AS (SELECT {_SPANS} FROM lineitem),
lists AS (SELECT page_uid, list(struct_pack(entity := entity, s := s, e := e, score := score) ORDER BY s - e, {_RANK}, -score, s, entity) AS l FROM spans GROUP BY page_uid),
folded AS ({_LISTED.format(step="CASE WHEN len(list_filter(a, lambda y: x[1].s < y.e AND x[1].e > y.s)) > 0 THEN a ELSE list_concat(a, x) END")})
{_OUT}""")
def pruned_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded(spark, sf_dir, detect.prune_overlaps)


@query(f"""WITH spans AS (SELECT {_SPANS} FROM lineitem)
SELECT a.page_uid, count(*) AS n, sum(a.s + b.e)::BIGINT AS total FROM spans a JOIN spans b ON a.page_uid = b.page_uid AND a.entity = 'PERSON' AND b.entity = 'DK_CPR' AND a.s < b.e AND a.e > b.s GROUP BY a.page_uid""")
def overlapping_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir)
    both = detect.overlapping(spans.where(F.col("entity") == E.PERSON), spans.where(F.col("entity") == E.CPR))
    return both.groupBy("page_uid").agg(F.count("*").alias("n"), F.sum(F.col("start") + F.col("end_2")).cast("long").alias("total"))


@query(f"""WITH spans AS (SELECT {_SPANS} FROM lineitem) SELECT page_uid, entity, (list(s ORDER BY e, s))[1]::BIGINT AS s FROM spans GROUP BY ALL""")
def first_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.first_seen(_spans(spark, sf_dir), ["page_uid", "entity"], ["end", "start"]).select("page_uid", "entity", F.col("start").cast("long").alias("s"))


@query(r"""WITH t AS (SELECT doc_id, text, (doc_id * 31 % 200) AS a, (doc_id * 31 % 200 + 9) AS b FROM documents WHERE length(text) >= 220),
p AS (SELECT *, greatest(0, a - 60) AS lo, least(length(text), b + 60) AS hi FROM t)
SELECT doc_id, concat(CASE WHEN lo > 0 THEN '…' ELSE '' END, trim(regexp_replace(substr(text, lo + 1, hi - lo), '\s+', ' ', 'g'), ' '), CASE WHEN hi < length(text) THEN '…' ELSE '' END) AS context FROM p""")
def span_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("length(text) >= 220")
    at = (F.col("doc_id") * 31 % 200).cast("int")
    return docs.select("doc_id", context_for(F.col("text"), at, at + 9).alias("context"))


# --- roles and names ---------------------------------------------------

_ROLES = """CASE k % 8 WHEN 0 THEN concat('Her moedte advokaten ', n, ' i dag') WHEN 1 THEN concat('dommer. Vidnet ', n, ' kom') WHEN 2 THEN concat('Saa kom ', n, ', tiltalte, ind')
  WHEN 3 THEN concat('domsmaendene ', n) WHEN 4 THEN concat('advokat', chr(10), n) WHEN 5 THEN concat('advokat ', repeat('x', 90), ' ', n) WHEN 6 THEN concat('beskikket forsvarer ', n) ELSE concat('Ingen ', n, ' mere') END"""
_N = "concat('Navn', k % 40)"


@query(f"""WITH p AS (SELECT o_orderkey AS k, concat('Navn', o_orderkey % 40) AS n FROM orders)
SELECT k, CASE k % 8 WHEN 0 THEN 'advokaten' WHEN 1 THEN 'vidnet' WHEN 2 THEN 'tiltalte' WHEN 3 THEN 'domsmaendene' WHEN 6 THEN 'beskikket forsvarer' ELSE '' END AS hint,
CASE k % 8 WHEN 0 THEN 'Advokaten' WHEN 3 THEN 'Domsmaendene' WHEN 6 THEN 'Beskikket forsvarer' ELSE 'Person' END AS stem FROM p""")
def role_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k").withColumn("n", F.expr(_N)).withColumn("text", F.expr(_ROLES))
    start = (F.instr("text", "Navn") - 1).cast("int")
    hinted = pages.withColumn("hint", resolve.role_hint(F.col("text"), start, start + F.length("n")))
    return hinted.select("k", "hint", resolve.stem(F.lit(E.PERSON), F.col("hint")).alias("stem"))


_FIRST, _LAST = "concat('Fo', chr(97 + cast(k % 20 as int)), 'rna')", "concat('Ef', chr(97 + cast(k % 20 as int)), 'ters')"
_NAMED = f"""CASE WHEN k < 20 THEN concat({_FIRST}, ' ', {_LAST}, ' bor her') WHEN k % 4 = 0 THEN concat('her er ', lower({_LAST}), ' igen')
  WHEN k % 4 = 1 THEN concat('se ', {_FIRST}, {_LAST}, ' nu') WHEN k % 4 = 2 THEN concat('x', {_FIRST}, 'y') ELSE 'ingen her' END"""


@query(f"""WITH p AS (SELECT o_orderkey AS k FROM orders)
SELECT k AS page_uid, lower(concat({_FIRST}, ' ', {_LAST})) AS key, CASE k % 4 WHEN 0 THEN lower({_LAST}) WHEN 1 THEN concat({_FIRST}, {_LAST}) ELSE {_FIRST} END AS value,
(CASE k % 4 WHEN 0 THEN 7 WHEN 1 THEN 3 ELSE 1 END)::BIGINT AS start_at FROM p WHERE k >= 20 AND k % 4 < 3 AND EXISTS (SELECT 1 FROM p q WHERE q.k = p.k % 20)""")
def propagated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k")
    pages = keys.selectExpr("k AS page_uid", f"{_NAMED} AS text")
    found = keys.where("k < 20").selectExpr("k AS page_uid", f"'{E.PERSON}' AS entity", f"lower(concat({_FIRST}, ' ', {_LAST})) AS key", f"concat({_FIRST}, ' ', {_LAST}) AS value", "0 AS start", f"length(concat({_FIRST}, ' ', {_LAST})) AS end")
    return resolve.propagate_names(pages, found).select("page_uid", "key", "value", F.col("start").cast("long").alias("start_at"))


_NAMES = """CASE k % 10 WHEN 0 THEN 'Retten i Glostrup' WHEN 1 THEN 'Jens 12' WHEN 2 THEN 'Kommune' WHEN 3 THEN 'B' WHEN 4 THEN 'Bnd Krt' WHEN 5 THEN 'CPR' WHEN 6 THEN 'Jens | Holm' WHEN 7 THEN 'Glostrup' WHEN 8 THEN 'Gage' ELSE 'Simon Faarkrog' END"""


@query("""SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 10 = 9 OR (o_orderkey % 10 = 8 AND o_orderkey % 3 = 0) OR (o_orderkey % 10 = 7 AND o_orderkey % 20 < 10) UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0 AND o_orderkey % 4 = 0""")
def plausible_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of kinds that are no names, the seat of a court, a word that only another span of its page saves, and e-mail addresses that stay."""
    keys = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k").withColumn("value", F.expr(_NAMES))
    court = F.expr("k % 10 = 7 AND k % 20 >= 10")
    text = F.when(court, F.concat(F.lit("Dom fra Retten i "), F.col("value"))).otherwise(F.concat(F.lit("Han kom fra xx i "), F.col("value")))
    entity = F.expr(f"CASE WHEN k % 10 = 0 AND k % 4 = 0 THEN '{E.EMAIL}' WHEN k % 10 = 7 THEN '{E.LOCATION}' ELSE '{E.PERSON}' END")
    evidence = {"has_name": F.lit(True), "keeps_capital": F.lit(True), "is_name_lower": F.expr("CASE WHEN k % 10 = 8 THEN false END"), "words": F.split("value", " ")}
    spans = keys.select(F.col("k").alias("page_uid"), F.col("k"), entity.alias("entity"), F.lit(17).alias("start"), "value").withColumns(evidence)
    # On every third page the word that was written small stands in a name that passes.
    saving = keys.where("k % 10 = 8 AND k % 3 = 0").select(F.col("k").alias("page_uid"), F.lit(-1).cast("long").alias("k"), F.lit(E.PERSON).alias("entity"), F.lit(40).alias("start"), F.lit("Simon Gage").alias("value")).withColumns({**evidence, "is_name_lower": F.lit(True), "words": F.array(F.lit("Simon"), F.lit("Gage"))})
    return detect.plausible_names(spans.unionByName(saving), keys.select(F.col("k").alias("page_uid"), text.alias("text"))).where("k >= 0").select("k")


# --- search, groups, items ---------------------------------------------


@query("""SELECT o_orderkey AS k, (CASE o_orderkey % 5 WHEN 0 THEN 5 WHEN 1 THEN 5 WHEN 2 THEN 3 WHEN 3 THEN 5 ELSE 0 END)::BIGINT AS s, (CASE o_orderkey % 5 WHEN 0 THEN 12 WHEN 1 THEN 15 WHEN 2 THEN 10 WHEN 3 THEN 10 ELSE 7 END)::BIGINT AS e FROM orders
UNION ALL SELECT o_orderkey, 4, 11 FROM orders WHERE o_orderkey % 5 = 4""")
def search_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of blanks, invisible characters, ligatures, case, and places that overlap."""
    text = "CASE k % 5 WHEN 0 THEN 'Der, FIN fin her' WHEN 1 THEN concat('Der, fi', chr(173), 'n  ', chr(10), 'fin') WHEN 2 THEN concat('se fin', chr(160), 'fiN') WHEN 3 THEN 'Der, ﬁn ﬁn' ELSE 'fin fin fin' END"
    pages = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k").selectExpr("k AS page_uid", f"{text} AS text")
    return detect.search_occurrences(pages, " Fin  FIN").select(F.col("page_uid").alias("k"), F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"))


@query("SELECT doc_id, len(regexp_extract_all(text, 'thethe|an\\.|the|an')) AS n, len(list_filter(regexp_extract_all(text, 'thethe|an\\.|the|an'), lambda x: length(x) > 3))::BIGINT AS n_long FROM documents WHERE text IS NOT NULL")
def longest_alternative(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(resolve.escape_all(["an", "the", "an.", "thethe"])), F.lit(0))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.size(found).cast("long").alias("n"), F.size(F.filter(found, lambda x: F.length(x) > 3)).cast("long").alias("n_long"))


@query(f"""WITH {_EXPECTED} SELECT entity, lower(regexp_replace(value, '[^0-9]', '', 'g')) AS key FROM e WHERE entity IN ('DK_PHONE', 'DK_CVR') AND (contains(lower(value), '21') OR contains(lower(CASE WHEN entity = 'DK_PHONE' THEN 'x' ELSE '' END), '21')
  OR EXISTS (SELECT 1 FROM x WHERE x.k = e.k AND contains(lower(CASE kind WHEN 4 THEN concat('Ring tlf +45', v, ' slut') WHEN 6 THEN concat('Mobil: ', v, ' slut') WHEN 7 THEN concat('CVR-nr. ', v, ' slut') ELSE concat('Fax ', value, ' slut') END), '21'))) GROUP BY ALL""")
def filtered_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = made_pages(spark, sf_dir)
    found = resolve.findings(detect.detect(pages, rules=tuple(r for r in detect.RULES if r.entity in (E.PHONE, E.CVR)), context=True), pages, names=False)
    return resolve.filter_groups(found, "21")


@query(f"""WITH {_EXPECTED}, g AS (SELECT entity, value, count(*) AS n, min(k) AS f FROM e WHERE entity IN ('DK_ADDRESS', 'DK_POSTAL_CITY', 'DK_CASE_NO') GROUP BY ALL),
l AS (SELECT *, CASE entity WHEN 'DK_ADDRESS' THEN 'Adresse' WHEN 'DK_POSTAL_CITY' THEN 'Postnr-by' ELSE 'Sagsnummer' END AS stem FROM g), r AS (SELECT stem || ' ' || row_number() OVER (PARTITION BY stem ORDER BY f) AS label, value, stem, n FROM l)
SELECT k AS seq, line FROM (VALUES (0::BIGINT, 'Oversigt over pseudonymier. Du må ikke uploade disse til AI.'), (1, ''), (2, '| Pseudonym | Original | Type | Antal |'), (3, '|---|---|---|---|')) AS h(k, line)
UNION ALL SELECT row_number() OVER (ORDER BY encode(label)) + 3, '| ' || label || ' | ' || value || ' | ' || stem || ' | ' || n || ' |' FROM r""")
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, labels = pseudonymise(made_pages(spark, sf_dir), _codes(spark), rules=tuple(r for r in detect.RULES if r.entity in (E.ADDRESS, E.POSTAL, E.CASE_NO)))
    return resolve.overview_lines(resolve.overview(labels))


@query(f"""WITH {_EXPECTED}, g AS (SELECT value, count(*) AS n, min(k) AS f FROM e WHERE entity = 'DK_CASE_NO' GROUP BY ALL), r AS (SELECT 'Sagsnummer ' || row_number() OVER (ORDER BY f) AS label, value, n FROM g),
l AS (SELECT 'Oversigt over pseudonymier. Du må ikke uploade disse til AI.' AS line UNION ALL SELECT '' UNION ALL SELECT rpad(label, 24, ' ') || rpad(value, 40, ' ') || rpad('Sagsnummer', 24, ' ') || n FROM r) SELECT line, count(*) AS n FROM l GROUP BY line""")
def overview_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain overview written as text and read again."""
    _, labels = pseudonymise(made_pages(spark, sf_dir), rules=tuple(r for r in detect.RULES if r.entity == E.CASE_NO))
    path = new_path(spark, "overview")
    resolve.write_overview(resolve.overview_lines(resolve.overview(labels), markdown=False), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


_RECT = "struct(double({0}) AS x0, double({1}) AS y0, double({2}) AS x1, double({3}) AS y1)"


@query("""WITH f AS (SELECT o_orderkey AS k, o_orderkey % 500 AS p, (o_orderkey * 13 % 7)::DOUBLE AS x, (o_orderkey * 5 % 3)::DOUBLE AS y FROM orders WHERE o_orderkey % 9 <> 0),
r AS (SELECT k, p, x, y, x + 20 AS x1, y + 9 AS y1 FROM f UNION ALL SELECT k, p, x, y + 12, x + 8, y + 21 FROM f WHERE k % 2 = 0),
drawn AS (SELECT p_partkey % 500 AS p, (p_partkey * 13 % 7 + 0.5)::DOUBLE AS x, (p_partkey * 5 % 3 + 0.25)::DOUBLE AS y, (p_partkey % 3) AS i FROM part WHERE p_partkey % 4 <> 1),
d AS (SELECT p, x, y, x + 20 AS x1, y + 9 AS y1, i FROM drawn UNION ALL SELECT p, x, y + 12, x + 8, y + 21, i FROM drawn WHERE i = 1),
free AS (SELECT DISTINCT k FROM r WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.p = r.p AND i < 2 AND abs(d.x - r.x) <= 1 AND abs(d.y - r.y) <= 1 AND abs(d.x1 - r.x1) <= 1 AND abs(d.y1 - r.y1) <= 1))
SELECT k FROM free""")
def redaction_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings but for those that earlier marks cover: marks of other sources or kinds don't count, findings that were not selected neither."""
    x, y = "(o_orderkey * 13 % 7)", "(o_orderkey * 5 % 3)"
    one, two = _RECT.format(x, y, f"{x} + 20", f"{y} + 9"), _RECT.format(x, f"{y} + 12", f"{x} + 8", f"{y} + 21")
    found = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_orderkey % 500 AS page_uid", "o_orderkey % 9 <> 0 AS selected", f"if(o_orderkey % 2 = 0, array({one}, {two}), array({one})) AS rects")
    x, y = "(p_partkey * 13 % 7 + 0.5)", "(p_partkey * 5 % 3 + 0.25)"
    one, two = _RECT.format(x, y, f"{x} + 20", f"{y} + 9"), _RECT.format(x, f"{y} + 12", f"{x} + 8", f"{y} + 21")
    kind = "CASE p_partkey % 4 WHEN 1 THEN 'highlight' ELSE 'redact' END AS kind"
    existing = table(spark, sf_dir, "part").selectExpr("p_partkey % 500 AS page_uid", kind, "CASE p_partkey % 3 WHEN 0 THEN 'presidio' WHEN 1 THEN 'search' ELSE 'hand' END AS source", f"if(p_partkey % 3 = 1, array({one}, {two}), array({one})) AS rects")
    return resolve.redaction_items(found, existing).select("k")


@query(f"""WITH {_EXPECTED}, g AS (SELECT entity, k, CASE WHEN entity = 'DK_ADDRESS' THEN lower(value) ELSE regexp_replace(value, '[^0-9]', '', 'g') END AS key FROM e WHERE entity IN ('DK_ADDRESS', 'DK_PHONE') UNION ALL SELECT 'DK_PHONE', k, v FROM x WHERE kind = 6 AND cvr_ok),
d AS (SELECT key, bool_or(k % 30 = 9) AS sel FROM g WHERE entity = 'DK_ADDRESS' GROUP BY key)
SELECT entity, g.key, count(*) AS n, sum(coalesce(sel, true)::INT)::BIGINT AS n_selected, CASE WHEN sum(coalesce(sel, true)::INT) = 0 THEN 'none' ELSE 'all' END AS state FROM g LEFT JOIN d ON d.key = g.key GROUP BY ALL""")
def remembered_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = made_pages(spark, sf_dir)
    found = resolve.findings(detect.detect(pages, rules=tuple(r for r in detect.RULES if r.entity in (E.ADDRESS, E.PHONE)), context=True), pages, names=False)
    decided = resolve.remember(resolve.group_findings(found.where(F.col("entity") == E.ADDRESS)), found.where((F.col("entity") == E.ADDRESS) & (F.col("page_uid") % 30 == 9)))
    return resolve.tree_state(resolve.preselect(found, decided))


@query("""SELECT o_orderkey AS k, try_strptime(((CASE WHEN s <= 3 THEN 1900 WHEN s IN (4, 9) THEN CASE WHEN yy <= 36 THEN 2000 ELSE 1900 END WHEN yy <= 57 THEN 2000 ELSE 1800 END) + yy) || '-' || lpad(mm::VARCHAR, 2, '0') || '-' || lpad((CASE WHEN dd > 31 THEN dd - 60 ELSE dd END)::VARCHAR, 2, '0'), '%Y-%m-%d')::DATE AS born,
list_sum(list_transform(range(1, length(c) + 1), lambda j: CASE WHEN (length(c) - j) % 2 = 0 THEN substr(c, j, 1)::INT ELSE 2 * substr(c, j, 1)::INT - CASE WHEN substr(c, j, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0 AS card
FROM (SELECT o_orderkey, o_orderkey * 7 % 95 AS dd, o_orderkey % 14 AS mm, o_orderkey * 3 % 100 AS yy, o_orderkey % 10 AS s, (100000000 + o_orderkey * 7919)::VARCHAR AS c FROM orders)""")
def checked_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Birth dates of numbers with impossible days and months too, and card checks, of numbers made from the orders."""
    t = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "concat(lpad(o_orderkey * 7 % 95, 2, '0'), lpad(o_orderkey % 14, 2, '0'), lpad(o_orderkey * 3 % 100, 2, '0'), o_orderkey % 10, '123') AS digits", "string(100000000 + o_orderkey * 7919) AS card")
    return t.select("k", ids.cpr_birth_date(F.col("digits")).alias("born"), ids.luhn(F.col("card")).alias("card"))


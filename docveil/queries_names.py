"""Registered queries of names, languages and context words over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docveil.functions import entities as E
from docveil.functions.matches import spans
from docveil.operators import detect, langmodel, names, resolve, tagger
from docveil.operators.lang import looks_english, word_score
from docveil.plans.anonymise import find_names
from docveil.registry import QUERIES, query, table
from docveil.shared import dealt_evenly


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_uid"), "text", "lang")


# --- language ----------------------------------------------------------


@query(r"""WITH w AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents),
c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL),
g AS (SELECT lang, unnest(list_transform(range(1, length(word) + 1), lambda k: substr(' ' || word || ' ', k, 3))) AS gram, n FROM c),
e AS (SELECT gram, lang, sum(n) AS n FROM g GROUP BY ALL),
kept AS (SELECT gram FROM e GROUP BY gram ORDER BY sum(n) DESC, gram LIMIT 131072),
totals AS (SELECT lang, sum(n) AS total, (SELECT count(*) FROM kept) AS size FROM e SEMI JOIN kept USING (gram) GROUP BY lang),
scores AS (SELECT kept.gram, totals.lang, floor(1000 * ln((coalesce(n, 0) + 1)::DOUBLE / (total + size)))::BIGINT AS s FROM kept CROSS JOIN totals LEFT JOIN e ON e.gram = kept.gram AND e.lang = totals.lang),
texts AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL),
own AS (SELECT word, lang, sum(s) AS s FROM (SELECT word, unnest(list_transform(range(1, length(word) + 1), lambda k: substr(' ' || word || ' ', k, 3))) AS gram FROM (SELECT DISTINCT word FROM texts)) JOIN scores USING (gram) GROUP BY ALL),
by_lang AS (SELECT doc_id, lang, sum(n * s) AS s FROM texts JOIN own USING (word) GROUP BY ALL),
told AS (SELECT doc_id, sum(s) FILTER (lang = 'en')::BIGINT AS s_en, max(s) FILTER (lang <> 'en')::BIGINT AS s_other FROM by_lang GROUP BY doc_id)
SELECT documents.doc_id, coalesce(s_en, 0) AS s_en, coalesce(s_other, 0) AS s_other,
  len(regexp_extract_all(coalesce(text, ''), '[a-zA-ZæøåÆØÅ][a-zA-ZæøåÆØÅ'']*')) >= 12 AND coalesce(s_en - s_other, 0) >= 1000 * ln(6) AS english FROM documents LEFT JOIN told USING (doc_id)""")
def language_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model fitted on all documents, its scores of all documents, and the language rule fed by it."""
    pages = _pages(spark, sf_dir)
    scored = langmodel.language_scores(pages, langmodel.fit(pages))
    other = F.array_max(F.map_values(F.map_filter("scores", lambda k, _: k != "en")))
    english = looks_english(word_score(F.col("text")), langmodel.model_ratio(F.col("scores"), "en", None))
    return scored.select(F.col("page_uid").alias("doc_id"), F.element_at("scores", "en").alias("s_en"), other.alias("s_other"), english.alias("english"))


# --- names -------------------------------------------------------------

_TOKEN = r"\p{L}[\p{L}\p{N}''’-]*"
_FIRST = r"""(?:^|[.!?:;|\n\r\t])[\s"''«»(\[*#>-]*(""" + _TOKEN + ")"
_ENDS = "erernes|ernes|erens|enes|eres|erne|eren|ene|ens|ers|ets|ede|ing|en|er|es|et|ed|e|s"
_COUNTS = rf"""
forms AS (SELECT form, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_TOKEN}')) AS form FROM documents) GROUP BY form),
firsts AS (SELECT form, count(*) AS f FROM (SELECT unnest(regexp_extract_all(text, '{_FIRST}', 1)) AS form FROM documents) GROUP BY form),
told AS (SELECT lower(form) AS word, regexp_matches(form, '^\p{{Lu}}') AS capital, n, coalesce(f, 0) AS f FROM forms LEFT JOIN firsts USING (form)),
counts AS (SELECT word, coalesce(sum(n) FILTER (NOT capital), 0)::BIGINT AS n_small, coalesce(sum(n - f) FILTER (capital), 0)::BIGINT AS n_inside, coalesce(sum(f) FILTER (capital), 0)::BIGINT AS n_first FROM told GROUP BY word)
"""
_EVIDENCE = rf"""{_COUNTS},
stemmed AS (SELECT *, regexp_replace(regexp_replace(word, '^(.{{3,}}?)(?:{_ENDS})$', '\1'), '^(.{{3,}}?)(?:{_ENDS})$', '\1') AS stem FROM counts),
family AS (SELECT stem, sum(n_small) AS small, sum(n_inside) AS inside FROM stemmed GROUP BY stem),
evidence AS (SELECT word, n_small + n_inside > 0 AND 2 * n_inside >= n_small + n_inside AS is_name, 2 * inside >= small + inside AS keeps, 10 * n_small <= n_small + n_inside + n_first AS small_name FROM stemmed JOIN family USING (stem))
"""


@query(f"WITH {_COUNTS} SELECT * FROM counts")
def case_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.case_counts(_pages(spark, sf_dir))


def _placed(pattern: str, out: str) -> str:
    """Matches of a pattern in documents with their positions, in SQL."""
    return rf"""
{out}_p AS (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM documents),
{out} AS (SELECT doc_id, value, sum(length(gap) + length(value)) OVER (PARTITION BY doc_id ORDER BY k) - length(value) AS s FROM (SELECT doc_id, unnest(range(1, len(m) + 1)) AS k, unnest(m) AS value, unnest(g[1:len(m)]) AS gap FROM {out}_p))"""


_PAIRS = "[A-Z][a-z]+ [A-Z][a-z]+"
_WORDS = "[a-zA-ZæøåÆØÅ][a-zA-ZæøåÆØÅ'']*"


def _among(words: list[str]) -> str:
    return "len(list_filter(ws, lambda x: x IN (" + ", ".join(f"'{w}'" for w in words) + ")))"


def _prose_sql() -> str:
    from docveil.operators.lang import DANISH, ENGLISH

    return f"""prose AS (SELECT doc_id, len(ws) >= 12 AND greatest({_among(ENGLISH)}, {_among(DANISH)}) >= 0.1 * len(ws) AS prose FROM (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '{_WORDS}'), lambda x: lower(x)) AS ws FROM documents))"""


@query(rf"""WITH {_EVIDENCE}, {_placed(_PAIRS, "found")}, {_placed(_TOKEN, "tokens")}, {_prose_sql()},
met AS (SELECT f.doc_id, f.s, f.value, bool_or(coalesce(is_name, false)) AS has_name, bool_or(coalesce(keeps, false)) AS keeps_capital, bool_or(coalesce(small_name, false)) AS small, string_agg(t.value, ' ' ORDER BY t.s) AS words
  FROM found f JOIN tokens t ON t.doc_id = f.doc_id AND t.s < f.s + length(f.value) AND t.s + length(t.value) > f.s AND regexp_matches(t.value, '^\p{{Lu}}') LEFT JOIN evidence ON word = lower(t.value) GROUP BY ALL),
asked AS (SELECT doc_id, bool_or(small AND NOT prose) AS asked FROM met JOIN prose USING (doc_id) GROUP BY doc_id)
SELECT found.doc_id, found.s::BIGINT AS start_at, found.value, coalesce(has_name, false) AS has_name, coalesce(keeps_capital, false) AS keeps_capital, CASE WHEN asked THEN coalesce(small, false) END AS is_name_lower, coalesce(words, '') AS words
FROM found LEFT JOIN met USING (doc_id, s) LEFT JOIN asked ON asked.doc_id = found.doc_id""")
def names_by_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of all documents for each pair of capitalised words in them."""
    pages = _pages(spark, sf_dir)
    found = pages.select("page_uid", F.explode(spans(F.col("text"), _PAIRS)).alias("s")).select("page_uid", F.lit(E.PERSON).alias("entity"), "s.start", "s.end", "s.value")
    told = names.name_evidence(found, pages, names.word_evidence(names.case_counts(pages)))
    return told.select(F.col("page_uid").alias("doc_id"), F.col("start").cast("long").alias("start_at"), "value", "has_name", "keeps_capital", "is_name_lower", F.array_join("words", " ").alias("words"))


# --- context words -----------------------------------------------------

_NUMBER = "concat(20000000 + k * 7919 % 70000000, '')"
_INFLECTED = f"""CASE k % 12 WHEN 0 THEN concat('Ring paa telefonen: ', {_NUMBER}, ' nu') WHEN 1 THEN concat('Se ', {_NUMBER}, ' (telefoner) her') WHEN 2 THEN concat('Skriv ', {_NUMBER}, ' til min fine gamle mobil') WHEN 3 THEN concat('Telefonen er gul og den er stor, ring ', {_NUMBER})
  WHEN 4 THEN concat('Hendes kontakts: ', {_NUMBER}) WHEN 5 THEN concat('Telefonbog ', {_NUMBER}) WHEN 6 THEN concat('/TLF.:/ ', {_NUMBER}) WHEN 7 THEN concat({_NUMBER}, ' mobilens') WHEN 8 THEN concat('mobil', repeat('x', 130), ' ', {_NUMBER}) WHEN 9 THEN concat('kontakt', chr(10), chr(10), 'her ', {_NUMBER})
  WHEN 10 THEN concat('kontakt ', repeat('y', 130), ' ', {_NUMBER}) ELSE concat('nr ', {_NUMBER}, ' slut') END"""


@query(f"""WITH t AS (SELECT o_orderkey AS k FROM orders), x AS (SELECT k, {_INFLECTED} AS text, {_NUMBER} AS v FROM t)
SELECT k AS page_uid, v AS value, (strpos(text, v) - 1)::BIGINT AS start_at, 0.65 AS score FROM x WHERE k % 12 IN (0, 1, 4, 6, 7, 9)""")
def inflected_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare numbers of eight digits, which only a word of telephones next to them makes believable: inflected, in brackets, behind them, in another line; not too far, cut off, or part of another word."""
    pages = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k").selectExpr("k AS page_uid", f"{_INFLECTED} AS text")
    found = detect.detect(pages, rules=tuple(r for r in detect.RULES if r.entity == E.PHONE))
    return found.select("page_uid", "value", F.col("start").cast("long").alias("start_at"), F.round("score", 2).cast("decimal(3,2)").alias("score"))


# --- propagation: patterns of two owners, short ones, glued words ------

_MET = "CASE k % 6 WHEN 0 THEN 'Se Holm her' WHEN 1 THEN 'HOLMen' WHEN 2 THEN 'Med AB i' WHEN 3 THEN 'idaholm og perholm' WHEN 4 THEN 'A B bor her' ELSE CASE k % 12 WHEN 5 THEN 'Ida Holm' ELSE 'Per Holm' END END"


@query("""WITH p AS (SELECT o_orderkey AS k FROM orders)
SELECT k AS page_uid, 'holm' AS key, 'Holm' AS value, 3::BIGINT AS start_at FROM p WHERE k % 6 = 0 UNION ALL SELECT k, 'holm', 'HOLM', 0 FROM p WHERE k % 6 = 1 UNION ALL SELECT k, 'a b', 'AB', 4 FROM p WHERE k % 6 = 2
UNION ALL SELECT k, 'ida holm', 'idaholm', 0 FROM p WHERE k % 6 = 3 UNION ALL SELECT k, 'per holm', 'perholm', 11 FROM p WHERE k % 6 = 3""")
def propagated_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word of two persons is a group of its own, words glued together lead to their person, a name's letters too; what is known already is not found again."""
    pages = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k").selectExpr("k", "k AS page_uid", f"{_MET} AS text")
    whole = F.when(F.expr("k % 6 = 4"), "A B").when(F.expr("k % 6 = 5"), F.col("text"))
    found = pages.select("page_uid", F.lit(E.PERSON).alias("entity"), F.lower(whole).alias("key"), whole.alias("value"), F.lit(0).alias("start"), F.length(whole).alias("end")).where("value IS NOT NULL")
    return resolve.propagate_names(pages, found).select("page_uid", "key", "value", F.col("start").cast("long").alias("start_at"))


# --- names by a trained model ------------------------------------------

_SYLLABLE = "element_at(array('Al', 'Bri', 'Cla', 'Dor', 'Eli', 'Fre', 'Gus', 'Hen', 'Ing', 'Jon', 'Kar', 'Lud', 'Mar'), 1 + cast({0} % 13 AS int))"
_GIVEN = "concat(" + _SYLLABLE.format("(k * 7)") + ", element_at(array('a', 'ette', 'us', 'ik'), 1 + cast(k * 5 % 4 AS int)))"
_FAMILY = "concat(" + _SYLLABLE.format("(k * 11)") + ", element_at(array('sen', 'gaard', 'holt', 'feldt'), 1 + cast(k * 3 % 4 AS int)))"
_PLACE = "concat(" + _SYLLABLE.format("(k * 17)") + ", element_at(array('by', 'rup', 'lev', 'købing'), 1 + cast(k * 9 % 4 AS int)))"
_FIRM = "concat(" + _SYLLABLE.format("(k * 19)") + ", element_at(array('tek', 'byg', 'data', 'transport'), 1 + cast(k * 13 % 4 AS int)))"
_PERSON = f"concat({_GIVEN}, ' ', {_FAMILY})"
_LINES = f"""CASE k % 9 WHEN 0 THEN concat('Derfor kom advokat ', {_PERSON}, ' med flere bilag.') WHEN 1 THEN concat('Sagen blev ført af ', {_PERSON}, ' med flere breve.') WHEN 2 THEN concat('I dag sagde vidnet ', {_PERSON}, ' det samme igen.')
  WHEN 3 THEN concat('Han mener at vidnet ', {_GIVEN}, ' og ', {_PERSON}, ' ved det.') WHEN 4 THEN concat('Hun bor nu i 8500 ', {_PLACE}, ' med sin hund.') WHEN 5 THEN concat('De rejste til ', {_PLACE}, ' med toget.') WHEN 6 THEN concat('Huset er købt af ', {_FIRM}, ' A/S i fjor.')
  WHEN 7 THEN concat('Regningen fra ', {_FIRM}, ' kom i går.') ELSE 'Der er ingen navne her, kun 12 bilag.' END"""


def _tagged_sql(kind: int, entity: str, head: str, value: str) -> str:
    return f"SELECT k, '{entity}' AS entity, length('{head}')::BIGINT AS start_at, {value} AS value FROM t WHERE k % 9 = {kind}"


_NAMED = " UNION ALL ".join(
    [
        _tagged_sql(0, E.PERSON, "Derfor kom advokat ", _PERSON), _tagged_sql(1, E.PERSON, "Sagen blev ført af ", _PERSON), _tagged_sql(2, E.PERSON, "I dag sagde vidnet ", _PERSON), _tagged_sql(3, E.PERSON, "Han mener at vidnet ", _GIVEN),
        f"SELECT k, '{E.PERSON}', length(concat('Han mener at vidnet ', {_GIVEN}, ' og ')), {_PERSON} FROM t WHERE k % 9 = 3", _tagged_sql(4, E.LOCATION, "Hun bor nu i 8500 ", _PLACE), _tagged_sql(5, E.LOCATION, "De rejste til ", _PLACE),
        _tagged_sql(6, E.ORGANIZATION, "Huset er købt af ", _FIRM), _tagged_sql(7, E.ORGANIZATION, "Regningen fra ", _FIRM),
    ]
).replace("element_at(array(", "list_extract(list_value(").replace(" AS int)", " AS INT)")


def named_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence for each order; titles, company forms and postal codes tell some of the names, the others stand without."""
    return dealt_evenly(table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k")).selectExpr("k AS page_uid", "k AS pos", "concat('page ', k) AS label", f"{_LINES} AS text")


@query(f"WITH t AS (SELECT o_orderkey AS k FROM orders), n AS ({_NAMED}) SELECT k AS page_uid, entity, start_at, value FROM n")
def tagged_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of persons, places and firms, found by a model that learns from the sentences in which rules see them."""
    pages = named_pages(spark, sf_dir)
    found = tagger.tag_names(pages, tagger.train(pages))
    return found.select("page_uid", "entity", F.col("start").cast("long").alias("start_at"), "value")


@query(f"""WITH t AS (SELECT o_orderkey AS k FROM orders), n AS ({_NAMED}), e AS (SELECT k, entity, start_at, value, 0.85 AS score FROM n),
x AS (SELECT *, k % 9 = 8 AS has_mail FROM t) SELECT k AS page_uid, entity, start_at, value, score FROM e UNION ALL SELECT k, 'EMAIL_ADDRESS', 52, concat('post', k, '@firma.dk'), 0.9 FROM x WHERE has_mail""")
def names_and_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by the model, checked by the corpus's case, together with what the patterns find."""
    mail = F.when(F.expr("k % 9 = 8"), F.concat(F.lit(" Skriv til os: "), F.lit("post"), F.col("k"), F.lit("@firma.dk"))).otherwise(F.lit(""))
    pages = named_pages(spark, sf_dir).withColumn("k", F.col("page_uid")).withColumn("text", F.concat("text", mail)).drop("k")
    found = detect.detect(pages, extra=find_names(pages, tagger.train(named_pages(spark, sf_dir))))
    return found.select("page_uid", "entity", F.col("start").cast("long").alias("start_at"), "value", F.round("score", 2).cast("decimal(3,2)").alias("score"))


def document_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole rule set over the texts of all documents: every third counts as scanned, postal towns are those of the customers' codes. SQL has no look-around; a test holds it against plain Python."""
    codes = table(spark, sf_dir, "customer").select((1000 + F.col("c_custkey") * 7 % 9000).cast("int").alias("code"), F.concat(F.lit("By"), F.col("c_custkey") % 40).alias("city"))
    pages = _pages(spark, sf_dir).withColumn("ocr", F.col("page_uid") % 3 == 0)
    found = detect.detect(pages, codes, ocr="ocr")
    return found.select("page_uid", "entity", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), "value", F.round("score", 4).alias("score"))


QUERIES["document_spans"] = document_spans


# --- towns, roles, edits, documents ------------------------------------

_CITY = "concat(element_at(array('Al', 'Bro', 'Dal', 'Eng', 'Fug', 'Gro', 'Hav', 'Ish', 'Kir', 'Lun', 'Mar', 'Nor', 'Ods'), 1 + cast({0} % 13 AS int)), element_at(array('købing', 'strup', 'holm', 'bjerg'), 1 + cast({0} % 4 AS int)))"
_TOWN_TEXT = """CASE k % 6 WHEN 0 THEN concat('bor i ', code, ' ', city, ' herhen') WHEN 1 THEN concat('bor i ', code, ' ', substr(city, 1, 1), substr(city, 3), ' herhen') WHEN 2 THEN concat('bor i ', other, ' ', city, ', nu') WHEN 3 THEN concat('bor i ', code, ' Xqzwby herhen')
  WHEN 4 THEN concat('bor i ', code, ' ', city, ' Nord') ELSE concat('bor i ', code, ' ', lower(city), ' herhen') END"""


@query(f"""WITH t AS (SELECT o_orderkey AS k, 1000 + o_custkey % 9000 AS code, 1000 + (o_custkey + 1) % 9000 AS other, {_CITY.format("o_custkey").replace("element_at(array(", "list_extract(list_value(").replace(" AS int)", " AS INT)")} AS city FROM orders)
SELECT k AS page_uid, 6::BIGINT AS start_at, CASE k % 6 WHEN 1 THEN concat(code, ' ', substr(city, 1, 1), substr(city, 3)) WHEN 2 THEN concat(other, ' ', city) ELSE concat(code, ' ', city) END AS value FROM t WHERE k % 6 IN (0, 1, 2, 4)""")
def towns_of_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postal codes of a table made from the customers, of which some have several towns: a town as written, with a letter lost, under another code, unknown, followed by another word, written small."""
    codes = table(spark, sf_dir, "customer").selectExpr("cast(1000 + c_custkey % 9000 AS int) AS code", f"{_CITY.format('c_custkey')} AS city")
    made = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "1000 + o_custkey % 9000 AS code", "1000 + (o_custkey + 1) % 9000 AS other", f"{_CITY.format('o_custkey')} AS city")
    found = detect.detect(made.selectExpr("k AS page_uid", f"{_TOWN_TEXT} AS text"), codes, rules=tuple(r for r in detect.RULES if r.entity == E.POSTAL))
    return found.select("page_uid", F.col("start").cast("long").alias("start_at"), "value")


_WHO = "concat('Jens Holm', chr(97 + cast(p AS int)))"
_ROLED = f"""CASE r WHEN 0 THEN concat('Her kom advokat ', {_WHO}, ' i dag') WHEN 1 THEN concat('Saa sagde vidnet ', {_WHO}, ' nej') WHEN 2 THEN concat('Brev til Dr. ', {_WHO}, ' her') ELSE concat('Da kom ', {_WHO}, ' igen') END"""


@query("""WITH t AS (SELECT o_orderkey AS k, o_orderkey % 8 AS p, o_orderkey // 8 % 4 AS r FROM orders), s AS (SELECT *, CASE WHEN p = 0 THEN 0 WHEN p < 4 THEN r ELSE 3 END AS role FROM t)
SELECT 'jens holm' || chr((97 + p)::INT) AS key, count(*) AS n, 'Jens Holm' || chr((97 + p)::INT) AS display, CASE WHEN p = 0 THEN 'advokat' WHEN p >= 4 THEN '' WHEN count(DISTINCT CASE WHEN role < 2 THEN role END) = 2 THEN 'blandet' ELSE max(CASE role WHEN 0 THEN 'advokat' WHEN 1 THEN 'vidnet' ELSE '' END) END AS role_hint FROM s GROUP BY p""")
def role_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons by name, of whom one has a single role, some contradicting ones and some none; a title is no part of the name."""
    keys = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_orderkey % 8 AS p", "o_orderkey div 8 % 4 AS r").withColumn("r", F.expr("CASE WHEN p = 0 THEN 0 WHEN p < 4 THEN r ELSE 3 END"))
    pages = keys.selectExpr("k AS page_uid", "k AS pos", "'p' AS label", f"{_ROLED} AS text", f"{_WHO} AS who", "r")
    start = (F.instr("text", "Jens") - 1).cast("int")
    titled = F.when(F.col("r") == 2, F.concat(F.lit("Dr. "), F.col("who"))).otherwise(F.col("who"))
    spans_ = pages.select("page_uid", F.lit(E.PERSON).alias("entity"), (start - F.when(F.col("r") == 2, 4).otherwise(0)).cast("int").alias("start"), (start + F.length("who")).cast("int").alias("end"), titled.alias("value"), F.lit(0.85).alias("score"))
    groups = resolve.group_findings(resolve.findings(spans_, pages.select("page_uid", "pos", "label", "text")))
    return groups.select("key", "n", F.regexp_replace("display", "^Dr\\. ", "").alias("display"), "role_hint")


_EDITS = "l_orderkey AS k, l_partkey % 40 AS s, l_partkey % 40 + 2 + l_suppkey % 9 AS e, concat('<', l_linenumber, '>') AS label"
_BASE = "concat('abcdefghijklmnopqrstuvwxyz', l_orderkey, '-ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


@query(f"""WITH x AS (SELECT {_EDITS}, {_BASE} AS text FROM lineitem),
g AS (SELECT k, any_value(text) AS text, list(struct_pack(s := s, e := e, label := label, at := 0::BIGINT, out := '') ORDER BY s, -e, label) AS l FROM x GROUP BY k),
f AS (SELECT k, text, list_reduce(list_prepend(struct_pack(s := 0::BIGINT, e := 0::BIGINT, label := '', at := 0::BIGINT, out := ''), l), lambda a, y: CASE WHEN y.s < a.at THEN a ELSE struct_pack(s := 0::BIGINT, e := 0::BIGINT, label := '', at := y.e, out := a.out || substr(text, a.at + 1, y.s - a.at) || y.label) END) AS r FROM g)
SELECT k, r.out || substr(text, r.at + 1) AS text FROM f""")
def spliced_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits that overlap, of which one that begins inside another is passed over."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(*_EDITS.split(", ", 3), f"{_BASE} AS text")
    edits = rows.groupBy("k", "text").agg(F.collect_list(F.struct(F.col("s").cast("int").alias("start"), F.col("e").cast("int").alias("end"), "label")).alias("edits"))
    return edits.select("k", resolve.splice(F.col("text"), F.col("edits")).alias("text"))


@query(r"""SELECT conv_id AS doc, md5(trim(string_agg(chr(10) || chr(10) || '===== ' || role || ' ' || turn || ' =====' || chr(10) || chr(10) || trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)), '' ORDER BY turn, role, text), ' ' || chr(9) || chr(10) || chr(13)) || chr(10)) AS digest FROM conversations GROUP BY conv_id""")
def rendered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents whose turns are pages, with a mark before each."""
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.struct("turn", "role", "text").alias("pos"), F.concat_ws(" ", "role", "turn").alias("label"), F.coalesce("text", F.lit("")).alias("rendered"))
    return resolve.render_document(pages).select("doc", F.md5("text").alias("digest"))

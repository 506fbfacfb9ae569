"""Registered queries of text, Markdown, dates in names, catalogues, histories and file metadata, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docveil.functions import entities as E
from docveil.functions import text
from docveil.operators import catalog, dates, detect, export, history, markdown
from docveil.plans.anonymise import scan_counters
from docveil.queries import _EMAIL, TODAY
from docveil.registry import ORACLES, longs, query, table
from docveil.shared import dealt_evenly, new_path
from docveil.sources import catalogues, documents, files
from docveil.streaming import session



# --- Markdown ----------------------------------------------------------

_MD = "concat('## ', p_name, chr(10), '> ', p_type, chr(10), '| a | **', p_brand, '** |', chr(10), '|---|:--:|', chr(10), 'plain *x* and **', p_name, '**', chr(10), '```', chr(10), '# code *y*', chr(10), '```', chr(10), '###### end #')"


@query("SELECT p_partkey, concat(p_name, chr(10), p_type, chr(10), 'a', chr(9), p_brand, chr(10), 'plain x and ', p_name, chr(10), '# code *y*', chr(10), 'end #') AS plain, concat('### ', p_name) AS demoted FROM part")
def stripped_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_MD} AS t")
    demoted = F.element_at(F.split(text.demote_headings(F.col("t")), "\n"), 1)
    same = F.element_at(F.split(text.demote_headings(F.col("t")), "\n"), -1) == "###### end #"  # the lowest one stays
    return made.select("p_partkey", text.strip_markdown(F.col("t")).alias("plain"), F.when(same, demoted).alias("demoted"))


_BODY = "concat('# H', n_nationkey, chr(10), 'text & <b>')"
_ERROR = "CASE WHEN n_nationkey % 7 = 0 THEN 'Fejl <x>' END"
_NOTE = "'Bemærk: ' || sum(n_nationkey % 2) || ' side(r) i dette dokument indeholder ingen tekst der kunne udtrækkes. De er markeret i teksten nedenfor.'"


def _chapters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nation = table(spark, sf_dir, "nation")
    chapters = nation.selectExpr("n_regionkey AS doc", "n_nationkey AS chapter", "n_name AS title", f"{_BODY} AS body", "n_nationkey % 2 AS missing", f"{_ERROR} AS error", "n_nationkey % 3 = 0 AS had_text")
    return chapters, nation.selectExpr("n_regionkey AS doc", "concat('Doc ', n_regionkey) AS doc_title").distinct()


@query(f"""SELECT n_regionkey::BIGINT AS doc, '# Doc ' || n_regionkey || chr(10) || chr(10) || CASE WHEN sum(n_nationkey % 2) > 0 THEN '> ' || {_NOTE} || chr(10) || chr(10) ELSE '' END
|| string_agg('## ' || n_name || chr(10) || chr(10) || coalesce('> **' || {_ERROR} || '**', '#' || {_BODY}), chr(10) || chr(10) ORDER BY n_nationkey) || chr(10) AS text FROM nation GROUP BY n_regionkey""")
def rendered_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.render(*_chapters(spark, sf_dir)).select(*longs("doc"), "text")


@query("SELECT n_regionkey::BIGINT AS doc, bool_or(n_nationkey % 3 = 0) OR bool_and(n_nationkey % 7 = 0) AS ok FROM nation GROUP BY n_regionkey")
def writable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.can_write(_chapters(spark, sf_dir)[0]).select(*longs("doc"), "ok")


@query("""SELECT n_nationkey::BIGINT AS chapter, concat('<html xmlns="http://www.w3.org/1999/xhtml"><head><title>', n_name, '</title></head><body>', CASE WHEN n_nationkey < 5 THEN '<p class="missing"><strong>note</strong></p>' ELSE '' END, '<h2>', n_name, '</h2>',
CASE WHEN n_nationkey % 7 = 0 THEN '<p class="missing"><strong>Fejl &lt;x&gt;</strong></p>' ELSE '<blockquote class="missing">x</blockquote><pre>a &amp; b</pre>' END, '</body></html>') AS page FROM nation""")
def xhtml_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters, _ = _chapters(spark, sf_dir)
    body = F.concat(F.lit("<blockquote>x</blockquote><pre><code>"), text.xml_escape(F.lit("a & b")), F.lit("</code></pre>"))
    note = F.when(F.col("chapter") < 5, F.lit("note"))
    return chapters.select(*longs("chapter"), export.xhtml_chapter(F.col("title"), body, F.col("error"), F.lit(True), note).alias("page"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN '```' ELSE concat('Belob 12,50-', chr(10), 'Andet ', CASE WHEN s_suppkey % 2 = 1 THEN '12,50' ELSE '99,00' END, ' x', chr(10), '|Nr|Belob|', chr(10), '|---|---|', chr(10), '|1000||', chr(10), '|a|b c|') END AS text FROM supplier""")
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sign that the text lost, told from an amount without one by the word before it; a table's true header; an empty table; inline marks."""
    keys = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "s_suppkey AS page_uid", "if(s_suppkey % 2 = 1, '12,50', '99,00') AS twin")
    body = "concat('Belob 12,50', chr(10), 'Andet ', twin, ' <b>x</b>', chr(10), '|1000|Col2|', chr(10), '|---|---|', chr(10), '|a|b<br>c|', chr(10), '|Col1|Col2|', chr(10), '|---|---|')"
    texts = keys.selectExpr("page_uid", f"{body.replace(', chr(10), ' + chr(39) + '|Col1', ', chr(10), ' + chr(39) + chr(39) + ', chr(10), ' + chr(39) + '|Col1')} AS text")
    boxes = keys.selectExpr("page_uid", "explode(array(named_struct('line', 0, 'seq', 0, 'text', 'Belob'), named_struct('line', 0, 'seq', 1, 'text', '12,50-'), named_struct('line', 1, 'seq', 2, 'text', 'Andet'), named_struct('line', 1, 'seq', 3, 'text', twin))) AS w").selectExpr("page_uid", "0 AS block", "w.*")
    headers = keys.selectExpr("page_uid", "0 AS table_id", "array('1000', NULL) AS names", "array('Nr', 'Belob') AS header")
    grids = keys.where("s_suppkey % 10 = 0").selectExpr("page_uid", "'```' AS text")
    made = export.page_markdown(texts, grids, export.trailing_minus_contexts(boxes), headers)
    return made.select(F.col("page_uid").alias("s_suppkey"), F.rtrim(F.regexp_replace("text", r"\n+$", "")).alias("text"))


@query("""SELECT s_suppkey, s_suppkey % 4 <> 1 AS kept FROM supplier""")
def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables: a frame around four lines, one of three, one column only, and two filled cells."""
    rows = "CASE s_suppkey % 4 WHEN 0 THEN array(array('a', 'b'), array('x', 'y')) WHEN 1 THEN array(array('a', 'b'), array('1\\n2\\n3\\n4', NULL)) WHEN 2 THEN array(array('a', 'b'), array('1\\n2\\n \\n3', NULL)) ELSE array(array('1\\n2\\n3\\n4')) END"
    tables = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"{rows} AS rows")
    left = export.without_frames(tables).select("s_suppkey", F.lit(True).alias("kept"))
    return tables.select("s_suppkey").join(left, "s_suppkey", "left").select("s_suppkey", F.coalesce("kept", F.lit(False)).alias("kept"))


@query("""WITH t AS (SELECT p_partkey, p_name AS a, concat(substr(p_name, 1, 1 + p_partkey::INT % 4), p_type, right(p_name, p_partkey::INT % 3)) AS b FROM part), k AS (SELECT *, least(length(a), length(b)) AS n FROM t),
p AS (SELECT *, len(list_filter(range(1, n + 1), lambda j: left(a, j) = left(b, j))) AS prefix FROM k)
SELECT p_partkey, prefix::BIGINT AS prefix, len(list_filter(range(1, n - prefix + 1), lambda j: right(a, j) = right(b, j)))::BIGINT AS suffix FROM p""")
def common_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.expr("concat(substr(p_name, 1, int(1 + p_partkey % 4)), p_type, right(p_name, int(p_partkey % 3)))")
    return table(spark, sf_dir, "part").select("p_partkey", export.common_ends(F.col("p_name"), new).alias("e")).select("p_partkey", F.col("e.prefix").cast("long").alias("prefix"), F.col("e.suffix").cast("long").alias("suffix"))


@query("""WITH t AS (SELECT p_partkey AS k, p_name, p_partkey % 16 AS flags, CASE p_partkey % 5 WHEN 0 THEN 'ABCDEF+CourierNew' WHEN 1 THEN 'Times-BoldItalic' WHEN 2 THEN 'OpenSans-Black' WHEN 3 THEN 'abc+Georgia' ELSE 'Lato-Oblique' END AS font FROM part),
f AS (SELECT *, regexp_matches(lower(font), 'cour') OR flags & 1 > 0 AS mono, regexp_matches(lower(font), 'times|georgia') OR flags & 2 > 0 AS serif, regexp_matches(lower(font), 'bold|black') OR flags & 8 > 0 AS bold, regexp_matches(lower(font), 'ital|obliq') OR flags & 4 > 0 AS slant FROM t)
SELECT k, CASE WHEN font LIKE 'ABCDEF+%' THEN substr(font, 8) ELSE font END AS font, CASE WHEN NOT bold AND NOT slant THEN CASE WHEN mono THEN 'cour' WHEN serif THEN 'tiro' ELSE 'helv' END ELSE CASE WHEN mono THEN 'co' WHEN serif THEN 'ti' ELSE 'he' END || CASE WHEN bold AND slant THEN 'bi' WHEN bold THEN 'bo' ELSE 'it' END END AS code,
CASE k % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.md' WHEN 2 THEN '.epub' WHEN 3 THEN '.txt' END AS ending, CASE k % 5 WHEN 0 THEN 'PDF' WHEN 1 THEN 'Markdown' WHEN 2 THEN 'EPUB' WHEN 3 THEN 'Text' END AS kind,
CASE WHEN k % 3 = 0 THEN 'document' ELSE substr(concat(p_name, ' b c ', repeat('x', 60)), 1, 60) END AS file, k % 4 IN (0, 3) AS words,
CASE k % 4 WHEN 0 THEN 'Dansk' WHEN 1 THEN 'Nederlands' WHEN 2 THEN 'Svenska' ELSE 'English' END AS language, CASE k % 3 WHEN 0 THEN 'Muligt CPR-nummer' WHEN 1 THEN 'Betalingskort' ELSE 'Oplysning' END AS label FROM f""")
def small_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fonts, formats, file names, words and labels of generated values."""
    t = table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_name", "int(p_partkey % 16) AS flags", "CASE p_partkey % 5 WHEN 0 THEN 'ABCDEF+CourierNew' WHEN 1 THEN 'Times-BoldItalic' WHEN 2 THEN 'OpenSans-Black' WHEN 3 THEN 'abc+Georgia' ELSE 'Lato-Oblique' END AS font", "CASE p_partkey % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'md' WHEN 2 THEN 'epub' WHEN 3 THEN 'txt' ELSE 'doc' END AS fmt")
    raw = F.expr("if(k % 3 = 0, ' <>:| ', concat('  ', p_name, '  b? ', chr(9), 'c ', repeat('x', 60)))")
    word = F.expr("CASE k % 4 WHEN 0 THEN 'Hans Krtz' WHEN 1 THEN 'Bcd fgh' WHEN 2 THEN 'Hans | Jens' ELSE 'B' END")
    return t.select(
        "k", text.strip_subset(F.col("font")).alias("font"), export.fallback_code(F.col("font"), F.col("flags")).alias("code"), export.format_extension(F.col("fmt")).alias("ending"), export.format_label(F.col("fmt")).alias("kind"), text.safe_filename(raw).alias("file"), text.looks_like_words(word).alias("words"),
        catalog.language_name(F.expr("CASE k % 4 WHEN 0 THEN 'da' WHEN 1 THEN 'nl' WHEN 2 THEN 'sv' ELSE 'xx' END")).alias("language"), E.review_label(F.expr(f"CASE k % 3 WHEN 0 THEN '{E.CPR_LOOSE}' WHEN 1 THEN '{E.CARD}' ELSE 'OTHER' END")).alias("label"),
    )


# --- dates in names ----------------------------------------------------


def _month(words: str) -> str:
    return "CASE month(o_orderdate) " + " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(words.split(), 1)) + " END"


_DANISH, _ENGLISH, _FRENCH, _SHORT = (
    _month(w)
    for w in (
        "januar februar marts april maj juni juli august september oktober november december", "January February March April May June July August September October November December",
        "janvier février mars avril mai juin juillet août septembre octobre novembre décembre", "jan feb mär apr mai jun jul aug sep okt nov dez",
    )
)
_D, _M, _Y = "day(o_orderdate)", "month(o_orderdate)", "year(o_orderdate)"
_DD, _MM, _YY = f"lpad(concat({_D}, ''), 2, '0')", f"lpad(concat({_M}, ''), 2, '0')", f"lpad(concat({_Y} % 100, ''), 2, '0')"
#: A name for each rule, in its order.
_FORMS = (
    f"concat('a_', {_DD}, {_MM}, {_Y}, '.pdf')", f"concat({_Y}, {_MM}, {_DD}, 'b')", f"concat('c ', {_D}, '-', {_M}, '-', {_YY})", f"concat('d.', {_Y}, '.', {_M}, '.', {_D})", f"concat({_D}, '. ', {_DANISH}, ' ', {_YY})", f"concat({_ENGLISH}, ' ', {_D}, 'th, ', {_Y})",
    f"concat('e ', {_Y}, ' ', {_SHORT}, '. ', {_D})", f"concat('f', {_DD}, {_MM}, {_YY})", f"concat({_YY}, {_MM}, {_DD}, '_g')", f"concat({_MM}, {_DD}, {_Y})", f"concat('h ', {_M}, '_', {_D}, '_', {_Y})", f"concat('i ', {_MM}, {_DD}, {_YY})",
    f"concat('J ', {_FRENCH}, ' ', {_Y})", f"concat({_Y}, '-', upper({_DANISH}))", f"concat('k ', {_M}, '.', {_Y})", f"concat({_Y}, '_', {_M}, ' l')", f"concat('m', {_Y}, {_MM})", f"concat({_MM}, {_Y}, 'n')",
)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 18 >= 12 THEN date_trunc('month', o_orderdate)::DATE ELSE o_orderdate::DATE END AS date FROM orders")
def date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rule over names of its own format, month names of several languages and two-digit years included."""
    parsed: Column = F.lit(None).cast("date")
    name = "CASE o_orderkey % 18 " + " ".join(f"WHEN {k} THEN {f}" for k, f in enumerate(_FORMS)) + " END AS name"
    for k, rule in enumerate(dates.RULES):
        parsed = F.when(F.col("o_orderkey") % 18 == k, dates.parse_rule(F.col("name"), rule, TODAY)).otherwise(parsed)
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", name).select("o_orderkey", parsed.alias("date"))


@query("SELECT o_orderkey, 'mmyyyy' AS rule, date_trunc('month', o_orderdate + INTERVAL 8 YEAR)::DATE AS date FROM orders")
def month_not_day_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """032005 is March 2005 if all names would else fall on a 20th."""
    return dates.date_names(table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"concat('Rapport_', {_MM}, {_Y} + 8, '.pdf') AS name"), TODAY).select("o_orderkey", "rule", "date")


@query("SELECT o_orderkey, o_orderdate::DATE AS date, strftime(o_orderdate, '%d/%m-%Y') AS shown FROM orders")
def marked_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = dates.rule_from_marks("Bilag 5 marts 2020 x", {"d": (6, 7), "m": (8, 13), "y": (14, 18)})
    names = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"concat('Bilag ', {_D}, ' ', {_DANISH}, ' ', {_Y}, ' x') AS name")
    found = names.select("o_orderkey", dates.parse_rule(F.col("name"), rule, TODAY).alias("date"))
    return found.withColumn("shown", dates.file_date(F.col("date")))


# --- catalogues --------------------------------------------------------

_ENTRIES = """e AS (SELECT lang, concat('m', n_nationkey) AS msgid, n_nationkey AS n, CASE lang WHEN 'en' THEN CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE concat('en', n_nationkey) END WHEN 'de' THEN CASE WHEN n_nationkey % 4 > 0 THEN concat('de', n_nationkey) END ELSE CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE concat('da', n_nationkey) END END AS value,
  lang <> 'da' AND n_nationkey % 7 = 1 AS fuzzy FROM nation, (VALUES ('da'), ('en'), ('de')) AS l(lang))"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation_of_entries")
    return spark.sql(f"WITH {_ENTRIES.replace('nation,', 'nation_of_entries,')} SELECT lang, msgid, n, value, fuzzy FROM e")


@query(f"WITH {_ENTRIES} SELECT msgid, string_agg(lang, ',' ORDER BY lang) AS langs FROM e WHERE lang <> 'da' AND (fuzzy OR coalesce(value, '') = '') GROUP BY msgid")
def missing_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.missing(_entries(spark, sf_dir)).select("msgid", F.array_join("langs", ",").alias("langs"))


@query(f"WITH {_ENTRIES} SELECT msgid, lang, CASE WHEN fuzzy OR coalesce(value, '') = '' THEN msgid ELSE value END AS text FROM e")
def message_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's texts; the source language's own gaps are filled first."""
    filled = catalog.fill_source(_entries(spark, sf_dir))
    ids = filled.select("msgid").distinct()
    each = [catalog.get_text(ids, filled, lang).withColumn("lang", F.lit(lang)) for lang in ("da", "en", "de")]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query(f"WITH {_ENTRIES} SELECT lang, msgid, CASE WHEN lang = 'en' AND n % 3 = 0 THEN concat('ny', n) ELSE value END AS value, fuzzy AND NOT (lang = 'en' AND n % 3 = 0) AS fuzzy, (SELECT count(*) + 1 FROM nation) AS n_errors FROM e")
def applied_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of good translations is put in; one of empty and unknown ones changes nothing and names each."""
    entries = _entries(spark, sf_dir)
    good = entries.where("lang = 'en' AND n % 3 = 0").select("lang", "msgid", F.concat(F.lit("ny"), "n").alias("value"))
    bad = entries.where("lang = 'en'").select("lang", "msgid", F.lit(" ").alias("value")).unionByName(spark.sql("SELECT 'en' AS lang, 'none' AS msgid, 'x' AS value"))
    same, errors = catalog.apply_table(entries, bad)
    done, _ = catalog.apply_table(same, good)
    return done.join(errors.agg(F.count("*").alias("n_errors"))).select("lang", "msgid", "value", "fuzzy", "n_errors")


_MESSAGES = """CASE p_partkey % 8 WHEN 0 THEN concat('Gem %s ', p_name) WHEN 1 THEN concat('Åbn ', p_name, '…') WHEN 2 THEN concat(' x', p_name) WHEN 3 THEN concat('x ', p_name, ' ') WHEN 4 THEN concat('a', chr(10), p_name) WHEN 5 THEN concat('{n} af ', p_name) ELSE p_name END"""
_VALUES = """CASE p_partkey % 8 WHEN 0 THEN concat('Save ', p_name) WHEN 1 THEN concat('Open ', p_name) WHEN 2 THEN concat('x', p_name) WHEN 3 THEN concat('x ', p_name) WHEN 4 THEN concat('a ', p_name) WHEN 5 THEN concat('{n} of ', p_name) WHEN 6 THEN '' ELSE p_name END"""


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'placeholders' WHEN 1 THEN 'ellipsis' WHEN 2 THEN 'leading_space' WHEN 3 THEN 'trailing_space' WHEN 4 THEN 'newlines' WHEN 6 THEN 'untranslated' ELSE 'fuzzy' END AS problem FROM part WHERE p_partkey % 8 IN (0, 1, 2, 3, 4, 6) OR (p_partkey % 8 = 7 AND p_partkey % 3 = 0)
UNION ALL SELECT p_partkey, 'missing' FROM part WHERE p_partkey % 8 = 5 AND p_partkey % 11 = 0 UNION ALL SELECT p_partkey, 'not in catalogue' FROM part WHERE p_partkey % 8 = 5 AND p_partkey % 11 = 0""")
def message_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of problem of a translation; messages without one; ids that a language, or the source's catalogue, lacks."""
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey", f"concat({_MESSAGES}, if(p_partkey % 8 = 3, ' ', concat('#', p_partkey))) AS msgid", f"if(p_partkey % 8 = 6, '', concat({_VALUES}, if(p_partkey % 8 = 3, '', concat('#', p_partkey)))) AS value", "p_partkey % 8 = 7 AND p_partkey % 3 = 0 AS fuzzy")
    parts = parts.withColumn("msgid", F.expr("CASE WHEN p_partkey % 8 = 3 THEN concat(p_partkey, msgid) WHEN p_partkey % 8 = 2 THEN msgid WHEN p_partkey % 8 = 1 THEN concat(p_partkey, substr(msgid, 1, instr(msgid, '…'))) ELSE msgid END")).withColumn("value", F.expr("CASE WHEN p_partkey % 8 = 3 THEN concat(p_partkey, value) WHEN p_partkey % 8 = 1 THEN concat(p_partkey, value) ELSE value END"))
    lost = F.expr("p_partkey % 8 = 5 AND p_partkey % 11 = 0")
    entries = parts.select(F.lit("da").alias("lang"), "msgid", F.col("msgid").alias("value"), F.lit(False).alias("fuzzy")).unionByName(parts.where(~lost).select(F.lit("en").alias("lang"), "msgid", "value", "fuzzy"))
    used = parts.where(lost).select(F.concat("msgid", F.lit("?")).alias("msgid"))
    found = catalog.check_all(entries, used)
    named = parts.select("p_partkey", "msgid").unionByName(parts.where(lost).select("p_partkey", F.concat("msgid", F.lit("?")).alias("msgid")))
    return found.join(named, "msgid").select("p_partkey", "problem")


@query("""WITH v AS (SELECT o_orderkey AS k, o_orderkey % 12 AS a, o_orderkey * 7 % 12 AS b, o_orderkey % 3 AS c, o_orderkey % 5 AS d FROM orders)
SELECT k, CASE d WHEN 0 THEN a > 5 OR (a = 5 AND (b > 6 OR (b = 6 AND c > 1))) WHEN 1 THEN a > 5 OR (a = 5 AND b > 6) WHEN 2 THEN a > 5 WHEN 3 THEN false ELSE a > 5 OR (a = 5 AND b > 6) END AS newer FROM v""")
def newer_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of three, two and one part, without any, and with a suffix, against 5.6.1."""
    v = "CASE o_orderkey % 5 WHEN 0 THEN concat(o_orderkey % 12, '.', o_orderkey * 7 % 12, '.', o_orderkey % 3) WHEN 1 THEN concat(o_orderkey % 12, '.', o_orderkey * 7 % 12) WHEN 2 THEN concat(' ', o_orderkey % 12) WHEN 3 THEN 'beta' ELSE concat(o_orderkey % 12, '.', o_orderkey * 7 % 12, 'rc1') END AS v"
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", v).select("k", text.is_newer(F.col("v"), F.lit("5.6.1")).alias("newer"))


@query("""SELECT s_suppkey AS id, concat('2.', s_suppkey) AS version, s_suppkey * 10 AS size, CASE s_suppkey % 3 WHEN 0 THEN 'https://good.example/d' ELSE 'https://own.example/d' END AS download_url, s_suppkey > 40 AS update_available, sha256(s_name) = sha256(CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'x' END) AS ok FROM supplier WHERE s_suppkey % 5 > 1""")
def update_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies without a version, unavailable ones, and addresses on other hosts or without https; downloads whose hash is right or not."""
    rows = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS id", "s_name", "sha2(if(s_suppkey % 2 = 0, s_name, 'x'), 256) AS sha",
        "concat('{\"available\": ', if(s_suppkey % 5 = 0, 'false', 'true'), ', \"version\": \"', if(s_suppkey % 5 = 1, '', concat('2.', s_suppkey)), '\", \"size\": \"', s_suppkey * 10, '\", \"download_url\": \"', CASE s_suppkey % 3 WHEN 0 THEN 'https://good.example/d' WHEN 1 THEN 'http://good.example/d' ELSE 'https://bad.example/d' END, '\"}') AS raw",
    )
    replies = catalog.update_reply(rows.select("id", "raw"), ["good.example"], "2.40", "https://own.example/d", "https://own.example/i")
    files = rows.select(F.col("id").alias("path"), F.col("s_name").cast("binary").alias("content"))
    checked = catalog.verify_download(files, rows.select(F.col("id").alias("path"), F.upper("sha").alias("sha256"))).withColumnRenamed("path", "id")
    return replies.join(checked, "id").select("id", "version", "size", "download_url", "update_available", "ok")


# --- history and session -----------------------------------------------


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'undo' WHEN 'signup' THEN 'redo' ELSE 'do' END AS action, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
s AS (SELECT DISTINCT user_id, 0::BIGINT AS k, 0::BIGINT AS event_id, [0] AS line, 1 AS place, 0 AS made FROM events UNION ALL
  SELECT s.user_id, e.k, e.event_id, CASE action WHEN 'do' THEN list_concat(line[1:place], [made + 1]) ELSE line END, CASE action WHEN 'do' THEN place + 1 WHEN 'undo' THEN greatest(place - 1, 1) ELSE least(place + 1, len(line)) END::INT, made + (action = 'do')::INT
  FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
SELECT user_id, event_id, line[place]::BIGINT AS version FROM s WHERE k > 0""")
def replayed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.expr("CASE event_type WHEN 'error' THEN 'undo' WHEN 'signup' THEN 'redo' ELSE 'do' END")
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), action.alias("action"))
    return history.replay(log).select(F.col("session").alias("user_id"), F.col("seq").alias("event_id"), *longs("version"))


@query("""WITH s AS (SELECT user_id, event_id, epoch(ts) AS t, event_type, lag(epoch(ts)) OVER w AS pt, lag(event_type) OVER w AS pk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, sum(CASE WHEN event_type = pk AND t - pt <= 1.2 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM s), r AS (SELECT user_id, step, min(event_id) AS f, max(event_id) AS l, row_number() OVER (PARTITION BY user_id ORDER BY step DESC) AS n FROM g GROUP BY user_id, step)
SELECT user_id, count(*) AS n, min(f) AS first_seq, max(l) AS last_seq FROM r WHERE n <= 3 GROUP BY user_id""")
def undo_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_type").alias("key"))
    left = history.undo_depth(history.coalesce_steps(log), 3)
    return left.groupBy(F.col("session").alias("user_id")).agg(F.count("*").alias("n"), F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"))


@query("SELECT user_id, event_id, event_type FROM events WHERE event_id % 4 = user_id % 4")
def restored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.col("user_id").alias("session"), (F.col("event_id") % 4).alias("version"))
    wanted = rows.select("session", (F.col("user_id") % 4).alias("version")).distinct()
    return history.restore(rows, wanted).select("user_id", "event_id", "event_type")


@query(f"SELECT doc_id AS page_uid, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) AS v FROM documents) GROUP BY doc_id")
def scanned_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream, offered twice: each page is scanned once."""
    folder, found = new_path(spark, "session"), tuple(r for r in detect.RULES if r.entity == E.EMAIL)
    for turn in range(2):
        pages = session.arriving(spark, f"{sf_dir}/documents.parque[t]", "doc_id long, text string").withColumnRenamed("doc_id", "page_uid")
        session.scan_stream(pages, lambda df: detect.detect(df, rules=found), f"{folder}/found", f"{folder}/log", f"{folder}/checkpoint-{turn}", first=1000 * turn).awaitTermination()
    return spark.read.parquet(f"{folder}/found").groupBy("page_uid").agg(F.count("*").alias("n"))


@query(ORACLES["replayed_versions"])
def replayed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of three deliveries, after each of which it ends and goes on later from its state."""
    folder = new_path(spark, "undo")
    action = F.expr("CASE event_type WHEN 'error' THEN 'undo' WHEN 'signup' THEN 'redo' ELSE 'do' END")
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), action.alias("action"))
    cuts = log.agg(F.percentile_approx("seq", [0.33, 0.66])).first()[0] or [0, 0]
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = log.where((F.lit(True) if low is None else F.col("seq") > low) & (F.lit(True) if high is None else F.col("seq") <= high))
        part.write.mode("append").parquet(f"{folder}/in")
        arrived = session.arriving(spark, f"{folder}/in", "session long, seq long, action string", 10000)
        with session.rocks_state(spark):
            stream = session.replay_stream(arrived).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        stream.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(F.col("session").alias("user_id"), F.col("seq").alias("event_id"), *longs("version"))


# --- files, counters, texts --------------------------------------------


@query("""WITH t AS (SELECT o_orderkey AS k, o_orderdate AS d, o_orderkey % 4 = 0 AS image, o_orderkey % 3 AS has, o_orderkey % 7 <> 0 AS readable, o_orderkey % 5 = 0 AS locked, o_orderkey % 2 = 0 AS fits, o_orderkey % 11 > 0 AS known FROM orders)
SELECT k, CASE WHEN image THEN 'image' ELSE 'pdf' END AS kind, k % 6 <> 5 AS supported, CASE has WHEN 0 THEN strftime(d, '%Y-%m-%d') || ' 13:05' WHEN 1 THEN strftime(d, '%Y-%m-%d') || ' 00:00' END AS stamp,
CASE WHEN known AND has = 0 THEN strftime(d, '%Y-%m-%d') WHEN known AND has = 1 THEN '2011-02-03' ELSE strftime(d, '%Y-%m-%d') END AS creation_date, CASE WHEN image THEN 'image' WHEN NOT known OR NOT readable THEN 'error' WHEN NOT locked THEN 'not_encrypted' WHEN fits THEN 'decrypted' ELSE 'encrypted' END AS enc_key,
CASE WHEN image THEN 1 WHEN known THEN k % 9 END::BIGINT AS page_count, strftime(d, '%Y-%m-%d %H:%M') AS created, CASE WHEN image THEN '' WHEN has = 0 THEN strftime(d, '%Y-%m-%d') || ' 13:05' WHEN has = 1 THEN '2011-02-03 04:05' ELSE '' END AS pdf_date FROM t""")
def file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds, stamps, dates and locks of files, of which some have no information."""
    t = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS k", "concat('dir/f', o_orderkey, if(o_orderkey % 4 = 0, '.JPG', '.Pdf')) AS path", "o_orderdate AS modified", "if(o_orderkey % 4 = 0, 'image', 'pdf') AS kind", "concat('x', if(o_orderkey % 6 = 5, '.doc', '.tiff')) AS other",
        "CASE o_orderkey % 3 WHEN 0 THEN concat('D:', date_format(o_orderdate, 'yyyyMMdd'), '1305') ELSE 'no date' END AS created", "CASE o_orderkey % 3 WHEN 2 THEN '' ELSE 'D:201102030405Z' END AS changed", "if(o_orderkey % 3 = 1, concat('D:', date_format(o_orderdate, 'yyyyMMdd')), CASE o_orderkey % 3 WHEN 0 THEN concat('D:', date_format(o_orderdate, 'yyyyMMdd'), '1305') END) AS said",
    )
    info = t.where("k % 11 > 0").selectExpr("path", "int(k % 9) AS page_count", "k % 7 <> 0 AS readable", "k % 5 = 0 AS needs_password", "k % 2 = 0 AS fits", "created", "changed")
    both = documents.file_dates(F.col("path"), F.col("modified"), F.col("created"), F.col("changed"))
    from docveil.operators.model import is_supported, kind_for_path

    own = t.select("k", "path", kind_for_path(F.col("path")).alias("kind"), is_supported(F.col("other")).alias("supported"), documents.pdf_stamp(F.col("said")).alias("stamp"), both["created"].alias("created"), both["pdf_date"].alias("pdf_date"))
    meta = documents.metadata(t.select("path", "modified", "kind"), info).select("path", "enc_key", *longs("page_count"), "creation_date")
    return own.join(meta, "path").drop("path")


@query(r"""WITH t AS (SELECT text, doc_id % 3 = 0 AS ocr, doc_id % 7 = 0 AS failed FROM documents)
SELECT count(*) AS n_pages, count(*) FILTER (NOT failed) AS n_with_text, count(*) FILTER (ocr) AS n_ocr, count(*) FILTER (failed) AS n_failed FROM t""")
def scan_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").selectExpr("if(doc_id % 7 = 0, ' ', concat('x', text)) AS text", "doc_id % 3 = 0 AS ocr", "doc_id % 7 = 0 AS failed")
    return scan_counters(pages).select("n_pages", "n_with_text", "n_ocr", "n_failed")


@query("SELECT n_nationkey::BIGINT AS page, CASE WHEN n_nationkey % 2 = 0 THEN concat('%PDF-1.4 /Type /Page x /Type/Page /Pages', CASE WHEN n_nationkey % 3 = 0 THEN ' /Encrypt 5 0 R' ELSE '' END) END IS NOT NULL AS is_pdf, n_nationkey % 2 = 0 AND n_nationkey % 3 = 0 AS encrypted, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 0 END::BIGINT AS page_count FROM nation")
def pdf_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = "if(n_nationkey % 2 = 0, concat('%PDF-1.4 /Type /Page x /Type/Page /Pages /Type /Pages', if(n_nationkey % 3 = 0, ' /Encrypt 5 0 R', '')), 'GIF89')"
    files = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS path", f"cast({raw} AS binary) AS content")
    return documents.pdf_markers(files).select(F.col("path").cast("long").alias("page"), "is_pdf", "encrypted", *longs("page_count"))




@query("""WITH c AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'Brev: ' || c_custkey || '.txt' WHEN 1 THEN 'Note.txt' WHEN 2 THEN 'note.TXT' ELSE '  Sag  ' || c_custkey // 8 || '.md' END AS raw, CASE WHEN c_custkey % 7 > 0 THEN 'til ' || c_name || ' æ' END AS body FROM customer),
n AS (SELECT k, body, trim(regexp_replace(regexp_replace(raw, '[<>:"/\\\\|?*]', '', 'g'), '\\s+', ' ', 'g')) AS name FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY k) - 1 AS i FROM n)
SELECT CASE WHEN i = 0 THEN name ELSE regexp_replace(name, '(\\.[^.]*)$', '_' || i || '\\1') END AS name, body AS content FROM r WHERE body IS NOT NULL
UNION ALL SELECT 'saved ' || count(body) || ', failed ' || count(*) - count(body) || ', bytes ' || sum(octet_length(encode(body)))::BIGINT, NULL FROM r""")
def saved_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A letter to each customer as a file: forbidden characters, equal names whatever their case, rows that failed; read back, with the report."""
    path = new_path(spark, "files")
    raw = "CASE c_custkey % 4 WHEN 0 THEN concat('Brev: ', c_custkey, '.txt') WHEN 1 THEN 'Note.txt' WHEN 2 THEN 'note.TXT' ELSE concat('  Sag  ', c_custkey div 8, '.md') END AS name"
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS pos", raw, "CASE WHEN c_custkey % 7 > 0 THEN concat('til ', c_name, ' æ') END AS body")
    told = files.write_files(rows, path, F.col("body"))
    said = spark.range(1).select(F.lit(f"saved {told['saved']}, failed {told['failed']}, bytes {told['bytes']}").alias("name"), F.lit(None).cast("string").alias("content"))
    return files.read_back(spark, path).select("name", F.decode("content", "UTF-8").alias("content")).unionByName(said)


@query("""SELECT l AS lang, CASE WHEN p_partkey % 4 = 0 THEN p_type END AS context, m AS msgid, CASE WHEN p_partkey % 6 = 1 THEN m || 's' END AS plural, CASE WHEN p_partkey % 7 > 0 THEN l || ' ' || m || p_partkey ELSE '' END AS value, p_partkey % 8 = 0 AS fuzzy
FROM (SELECT *, p_partkey || p_name || CASE p_partkey % 3 WHEN 0 THEN chr(10) WHEN 1 THEN ' "q" ' ELSE '' END || 'a' || chr(92) || 'n' || chr(9) || 'b' || CASE WHEN p_partkey % 5 = 0 THEN chr(10) ELSE '' END AS m FROM part), (VALUES ('da'), ('en')) AS t(l)""")
def catalogue_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two catalogues of the parts written as lines and read again: escapes, strings over several lines, contexts, plurals, fuzzy and empty ones, with lines out of use between them."""
    name = F.concat("p_partkey", "p_name", F.expr("CASE p_partkey % 3 WHEN 0 THEN chr(10) WHEN 1 THEN ' \"q\" ' ELSE '' END"), F.lit("a\\n\tb"), F.expr("if(p_partkey % 5 = 0, chr(10), '')"))
    parts = table(spark, sf_dir, "part").withColumn("msgid", name).withColumn("lang", F.explode(F.array(F.lit("da"), F.lit("en"))))
    key = F.col("p_partkey")
    entries = parts.select(
        "lang", F.when(key % 4 == 0, F.col("p_type")).alias("context"), "msgid", F.when(key % 6 == 1, F.concat("msgid", F.lit("s"))).alias("plural"), F.when(key % 7 > 0, F.concat("lang", F.lit(" "), "msgid", key)).otherwise(F.lit("")).alias("value"), (key % 8 == 0).alias("fuzzy")
    )
    lines = catalogues.catalogue_lines(entries)
    lost = lines.where("seq % 50 = 49 AND text = ''").select("lang", F.col("seq") + 0.5, F.explode(F.array(F.lit("#~ msgid \"x\""), F.lit("#~ msgstr \"y\""))).alias("text"))
    return catalogues.read_catalogues(lines.select("lang", F.col("seq").cast("double").alias("seq"), "text").union(lost))


@query("""SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name || chr(10) || p_type WHEN 2 THEN 'it''s ' || p_brand ELSE '%d ' || p_type END AS msgid FROM part WHERE p_partkey % 5 < 4""")
def source_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of code made from the parts: both quotes, literals over lines, arguments behind; comments, formatted strings and other calls are none."""
    made = """CASE p_partkey % 5 WHEN 0 THEN concat('x = _("', p_name, '")') WHEN 1 THEN concat('f(N_("', p_name, chr(92), 'n"', chr(10), '     "', p_type, '"), 3)') WHEN 2 THEN concat('y = _(', chr(39), 'it', chr(92), chr(39), 's ', p_brand, chr(39), ', a)')
      WHEN 3 THEN concat('_( "%d "', chr(10), chr(39), p_type, chr(39), ' )') ELSE concat('# _("no', p_partkey, '")', chr(10), 'a._("no', p_partkey, '"); my_("no")', chr(10), '_(f"no', p_partkey, '")') END AS text"""
    return catalogues.source_messages(table(spark, sf_dir, "part").selectExpr("p_partkey AS path", made))


_MARKED = """concat('## ', p_name, ' & <b>', chr(10), 'First *', p_brand, '* and **', p_type, '** with `a*b*<c>` ', chr(92), '*x', chr(92), '*  ', chr(10), 'next [l', p_partkey, '](http://h/?a=1&b=2 "t")', chr(10), chr(10), '- one', chr(10), '- two', chr(10), '    1. in ', p_size, chr(10), '    2. out', chr(10), chr(10),
'> **', p_name, '**', chr(10), chr(10), '| a | b', p_partkey, ' |', chr(10), '|:--|--:|', chr(10), '| ', p_brand, ' | x', chr(92), '|y |', chr(10), chr(10), '```', chr(10), p_name, ' <tag>  | ', chr(10), '* no list', chr(10), '```', chr(10), '* * *', chr(10), p_partkey, '. first', chr(10), chr(10), p_partkey, '. second', chr(10), chr(10), 'snake_case_', p_partkey, ' 2 * 3 * 4')"""


@query("""SELECT p_partkey, replace('<h2>' || p_name || ' &amp; &lt;b&gt;</h2>~<p>First <em>' || p_brand || '</em> and <strong>' || p_type || '</strong> with <code>a*b*&lt;c&gt;</code> *x*<br />~next <a href="http://h/?a=1&amp;b=2" title="t">l' || p_partkey || '</a></p>~<ul>~<li>one</li>~<li>two~<ol>~<li>in ' || p_size || '</li>~<li>out</li>~</ol></li>~</ul>~' ||
'<blockquote class="missing">~<p><strong>' || p_name || '</strong></p>~</blockquote>~<table>~<thead>~<tr>~<th style="text-align: left;">a</th>~<th style="text-align: right;">b' || p_partkey || '</th>~</tr>~</thead>~<tbody>~<tr>~<td style="text-align: left;">' || p_brand || '</td>~<td style="text-align: right;">x|y</td>~</tr>~</tbody>~</table>~' ||
'<pre>' || p_name || ' &lt;tag&gt;  | ~* no list~</pre>~<hr />~<ol' || CASE WHEN p_partkey = 1 THEN '' ELSE ' start="' || p_partkey || '"' END || '>~<li>~<p>first</p>~</li>~<li>~<p>second</p>~</li>~</ol>~<p>snake_case_' || p_partkey || ' 2 * 3 * 4</p>', '~', chr(10)) AS body FROM part""")
def xhtml_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of generated Markdown as the inside of their XHTML pages."""
    made = dealt_evenly(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")).selectExpr("p_partkey", f"{_MARKED} AS md").withColumn("html", markdown.markdown_xhtml(F.col("md")))
    page = export.xhtml_chapter(F.lit("t"), F.col("html"), F.lit(None).cast("string"), F.lit(False), F.lit(None).cast("string"))
    return made.select("p_partkey", F.regexp_extract(page, r"(?s)<body>(.*)</body>", 1).alias("body"))


@query("""SELECT s_suppkey AS k, '|' || CASE WHEN s_suppkey % 3 = 0 THEN 'Lav||' WHEN s_suppkey % 5 = 0 THEN 'Nr' || s_suppkey || '||Belob' ELSE 'Nr' || s_suppkey || '|Navn og|Belob' END || '|' || chr(10) || '|---|---|---|' || chr(10) || '|1000||x|' || chr(10) || '|a|b|c|' AS text FROM supplier WHERE s_suppkey % 7 > 0
UNION ALL SELECT s_suppkey, '|1000|Col2|x|' || chr(10) || '|---|---|---|' || chr(10) || '|a|b|c|' FROM supplier WHERE s_suppkey % 7 = 0""")
def headers_from_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column names out of word boxes that a table's edge cuts: words above, inside and beside the table are none, one cut deeper stands alone, a column may have no cell; the row in their place comes below."""
    keys = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS page_uid", "double(40 + s_suppkey * 13 % 700) AS edge")
    box = lambda name, x0, y0, x1, y1: f"named_struct('text', {name}, 'x0', double({x0}), 'y0', edge - {y0}, 'x1', double({x1}), 'y1', edge + {y1})"
    usual = [box("'Nr' || page_uid", 20, 8, 40, 0.4), box("'og'", 155, 8, 165, 1.4), box("'Navn'", 120, 8, 150, 0.4), box("'Belob'", 220, 8, 250, 0.4), box("'Over'", 120, 30, 150, -20), box("'Inde'", 120, 1, 150, 9), box("'Side'", 400, 8, 420, 0.4)]
    boxes = f"array({', '.join(usual)}, if(page_uid % 3 = 0, {box(chr(39) + 'Lav' + chr(39), 30, 30, 35, 5)}, NULL))"
    placed = keys.selectExpr("page_uid", f"explode({boxes}) AS w").where("w IS NOT NULL AND page_uid % 7 > 0").select("page_uid", "w.*")
    cells = "array(named_struct('x0', 10.0D, 'x1', 110.0D), if(page_uid % 5 = 0, NULL, named_struct('x0', 110.0D, 'x1', 210.0D)), named_struct('x0', 210.0D, 'x1', 310.0D)) AS cells"
    tables = keys.selectExpr("page_uid", "0 AS table_id", "struct(10.0D AS x0, edge AS y0, 310.0D AS x1, edge + 90 AS y1) AS box", cells)
    headers = export.table_headers(placed, tables).withColumn("names", F.array(F.lit("1000"), F.lit(None), F.lit("x")))
    texts = keys.select("page_uid", F.lit("|1000|Col2|x|\n|---|---|---|\n|a|b|c|").alias("text"))
    return export.restore_headers(texts, headers).select(F.col("page_uid").alias("k"), "text")

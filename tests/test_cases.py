"""Cases from descriptions, of a few rows each, with their answers."""

import duckdb
import pytest
from pyspark.sql import functions as F

from docveil.functions import geometry as G
from docveil.functions import ids, text
from docveil.operators import catalog, detect, export

CASES = {}


def query(sql):
    def put(f):
        CASES[f.__name__] = (f, sql)
        return f

    return put


CPR_CASES = ["0101901234", "0101900002", "3002901234", "2902005678", "2902001234", "6101901234", "3201901234", "0101579123", "0101605123"]
_CPR_SQL = "VALUES " + ", ".join(f"('{x}')" for x in CPR_CASES)


@query(f"""WITH t(d) AS ({_CPR_SQL}), p AS (SELECT d, substr(d, 1, 2)::INT AS dd, substr(d, 3, 2) AS mm, substr(d, 5, 2)::INT AS yy, substr(d, 7, 1)::INT AS s FROM t)
SELECT d AS digits, try_strptime(((CASE WHEN s <= 3 THEN 1900 WHEN s IN (4, 9) THEN CASE WHEN yy <= 36 THEN 2000 ELSE 1900 END WHEN yy <= 57 THEN 2000 ELSE 1800 END) + yy) || '-' || mm || '-' || lpad((CASE WHEN dd > 31 THEN dd - 60 ELSE dd END)::VARCHAR, 2, '0'), '%Y-%m-%d')::DATE AS born,
list_sum(list_transform(range(1, 11), lambda k: [4, 3, 2, 7, 6, 5, 4, 3, 2, 1][k] * substr(d, k, 1)::INT)) % 11 = 0 AS mod11 FROM p""")
def cpr_validate(spark):
    t = spark.sql(f"SELECT * FROM {_CPR_SQL} AS t(digits)")
    return t.select("digits", ids.cpr_birth_date(F.col("digits")).alias("born"), ids.cpr_mod11(F.col("digits")).alias("mod11"))


_CVR_SQL = "VALUES ('12345674'), ('12345682'), ('12345675'), ('1234567')"


@query(f"""WITH t(d) AS ({_CVR_SQL}) SELECT d AS digits, length(d) = 8 AND list_sum(list_transform(range(1, length(d) + 1), lambda k: [2, 7, 6, 5, 4, 3, 2, 1][k] * substr(d, k, 1)::INT)) % 11 = 0 AS mod11 FROM t""")
def cvr_validate(spark):
    return spark.sql(f"SELECT * FROM {_CVR_SQL} AS t(digits)").select("digits", ids.cvr_mod11(F.col("digits")).alias("mod11"))


_CODES_SQL = "VALUES (8500, 'Grenaa'), (8340, 'Malling'), (8000, 'Aarhus C'), (1550, 'København V')"
_POSTAL_SQL = "VALUES ('8500 Grenaa'), ('8340 Mallin'), ('8000 Arhus C'), ('1504 København V'), ('8500 Grenaa Hun sagde'), ('1503 Lørdag'), ('1511 Overarbejde'), ('2025 Tiludbetaling')"
_FOLD = "regexp_replace(replace(replace(replace(lower({0}), 'æ', 'ae'), 'ø', 'oe'), 'å', 'aa'), '[^a-z0-9]', '', 'g')"


@query(f"""WITH c(code, city) AS ({_CODES_SQL}), v(value) AS ({_POSTAL_SQL}), k AS (SELECT code, {_FOLD.format("city")} AS want FROM c),
f AS (SELECT value, substr(value, 1, 4)::INT AS code, {_FOLD.format("substr(value, 6)")} AS town FROM v)
SELECT value, coalesce(levenshtein(f.town, k.want) <= CASE WHEN length(k.want) <= 4 THEN 0 WHEN length(k.want) <= 6 THEN 1 ELSE 2 END, false) OR f.town IN (SELECT want FROM k) AS accepted FROM f LEFT JOIN k ON k.code = f.code""")
def postal_match(spark):
    codes, values = spark.sql(f"SELECT * FROM {_CODES_SQL} AS t(code, city)"), spark.sql(f"SELECT * FROM {_POSTAL_SQL} AS t(value)")
    return detect.postal_match(values, codes).select("value", "accepted")


_VERSIONS_SQL = "VALUES ('8.0.10', '8.0.9'), ('8.0', '8.0.0'), ('0rc1', '0'), ('', '1.0'), ('9.4.4', '9.5'), ('10', '9.9.9')"


@query("""SELECT * FROM (VALUES ('8.0.10', '8.0.9', true), ('8.0', '8.0.0', false), ('0rc1', '0', false), ('', '1.0', false), ('9.4.4', '9.5', false), ('10', '9.9.9', true)) AS t(remote, own, newer)""")
def version_newer(spark):
    return spark.sql(f"SELECT * FROM {_VERSIONS_SQL} AS t(remote, own)").withColumn("newer", text.is_newer(F.col("remote"), F.col("own")))


_MESSAGES = "VALUES ('da', 'Gem %s', 'Gem %s', false), ('en', 'Gem %s', 'Save', false), ('da', 'Åbn…', 'Åbn…', false), ('en', 'Åbn…', 'Open', false), ('en', ' x', 'x', false), ('da', ' x', ' x', false), ('da', 'ny', '', false), ('en', 'ny', 'new', true)"


@query("""SELECT * FROM (VALUES ('en', 'Gem %s', 'placeholders'), ('en', 'Åbn…', 'ellipsis'), ('en', ' x', 'leading_space'), ('da', 'ny', 'untranslated'), ('en', 'ny', 'fuzzy'), ('code', 'ukendt', 'not in catalogue')) AS t(lang, msgid, problem)""")
def catalogue_check(spark):
    entries = spark.sql(f"SELECT * FROM {_MESSAGES} AS t(lang, msgid, value, fuzzy)")
    return catalog.check_all(entries, spark.sql("SELECT * FROM VALUES ('ny'), ('ukendt') AS t(msgid)"))


_RECTS = "VALUES (1, 0, 0, 10, 10), (2, 0.5, 0.5, 10.5, 10.5), (3, 5, 5, 15, 15), (4, 10, 10, 20, 20), (5, 30, 30, 40, 40)"


@query(f"""WITH r(id, x0, y0, x1, y1) AS ({_RECTS}) SELECT a.id AS a, b.id AS b, a.x0 < b.x1 AND a.x1 > b.x0 AND a.y0 < b.y1 AND a.y1 > b.y0 AS meets,
abs(a.x0 - b.x0) <= 1 AND abs(a.y0 - b.y0) <= 1 AND abs(a.x1 - b.x1) <= 1 AND abs(a.y1 - b.y1) <= 1 AS same FROM r a, r b WHERE a.id < b.id""")
def covered_rects(spark):
    r = spark.sql(f"SELECT id, struct(double(x0) x0, double(y0) y0, double(x1) x1, double(y1) y1) r FROM {_RECTS} AS t(id, x0, y0, x1, y1)")
    pairs = r.select(F.col("id").alias("a"), F.array("r").alias("ra")).join(r.select(F.col("id").alias("b"), F.array("r").alias("rb")), F.col("a") < F.col("b"))
    return pairs.select("a", "b", G.any_overlap(F.col("ra"), F.col("rb")).alias("meets"), G.covered(F.col("ra"), F.col("rb")).alias("same"))


@query("""SELECT d AS degrees, CASE d % 360 WHEN 0 THEN 10 WHEN 90 THEN 780 WHEN 180 THEN 590 ELSE 20 END::DOUBLE AS x, CASE d % 360 WHEN 0 THEN 20 WHEN 90 THEN 10 WHEN 180 THEN 780 ELSE 590 END::DOUBLE AS y FROM (VALUES (0), (90), (180), (270), (450)) AS t(d)""")
def rotate_points(spark):
    t = spark.sql("SELECT * FROM VALUES (0), (90), (180), (270), (450) AS t(degrees)")
    x, y = G.rotate_point(F.lit(10.0), F.lit(20.0), F.lit(600.0), F.lit(800.0), F.col("degrees"))
    return t.select("degrees", x.alias("x"), y.alias("y"))


@query("""WITH t(w, h) AS (VALUES (400, 300), (300, 900), (1000, 1000)), s AS (SELECT w, h, least(575.0 / w, 822.0 / h) AS k FROM t)
SELECT w, h, round((595 - w * k) / 2, 6)::DOUBLE AS x, round((842 - h * k) / 2, 6)::DOUBLE AS y FROM s""")
def a4_placements(spark):
    t = spark.sql("SELECT * FROM VALUES (400, 300), (300, 900), (1000, 1000) AS t(w, h)").withColumn("p", G.a4_placement(F.col("w"), F.col("h")))
    return t.select("w", "h", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("""SELECT * FROM (VALUES ('p', 0, 'intro'), ('p', 4, '|a|b|'), ('p', 5, '|---|---|'), ('p', 6, 'end')) AS t(page_uid, seq, text)""")
def drop_empty_tables(spark):
    lines = spark.sql("SELECT * FROM VALUES ('p', 0, 'intro'), ('p', 1, '|Col1|Col2|'), ('p', 2, '|---|---|'), ('p', 3, ''), ('p', 4, '|a|b|'), ('p', 5, '|---|---|'), ('p', 6, 'end') AS t(page_uid, seq, text) WHERE text <> ''")
    return export.drop_empty_tables(lines.where("seq < 3").unionByName(spark.sql("SELECT 'p' page_uid, 3 seq, '' text")).unionByName(lines.where("seq > 3"))).where("text <> ''")


def _plain(v):
    return round(float(v), 6) if not isinstance(v, (str, bool, type(None))) and hasattr(v, "__float__") else v


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    made, sql = CASES[name]
    df = made(spark)
    cols = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=str)
    res = duckdb.connect().execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(_plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in res.fetchall()), key=str)

"""Registered queries of word boxes, characters and geometry, over boxes made from orders and line items, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docveil.functions import geometry as G
from docveil.operators import words
from docveil.plans.anonymise import find_text
from docveil.registry import longs, query, table


def _keys(spark: SparkSession, sf_dir: str, page: int) -> DataFrame:
    """(k, page_uid, seq): orders, so many a page."""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", f"o_orderkey div {page} AS page_uid", f"o_orderkey % {page} AS seq")


# Pages of twelve words: three lines of two columns, the last line a block of its own.
_WORDS = """w AS (SELECT o_orderkey // 12 AS page_uid, o_orderkey % 12 AS seq, concat('w', o_orderkey % 7, 'x') AS text, (o_orderkey % 12) // 4 AS line, (o_orderkey % 12) // 8 AS block,
  (o_orderkey % 4 * 30 + CASE WHEN o_orderkey % 4 >= 2 THEN 100 ELSE 0 END)::DOUBLE AS x0, ((o_orderkey % 12) // 4 * 20)::DOUBLE AS y0 FROM orders),
b AS (SELECT *, x0 + 18 AS x1, y0 + 10 AS y1, lag(text) OVER o AS pt, lag(line) OVER o AS pl, lag(block) OVER o AS pb, lag(x0 + 18) OVER o AS px FROM w WINDOW o AS (PARTITION BY page_uid ORDER BY seq)),
s AS (SELECT *, CASE WHEN pt IS NULL THEN '' WHEN block <> pb THEN chr(10) || chr(10) WHEN line <> pl OR x0 - px > 3 * 6 THEN chr(10) ELSE ' ' END AS sep FROM b),
placed AS (SELECT *, sum(length(sep) + length(text)) OVER (PARTITION BY page_uid ORDER BY seq) AS e FROM s)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _keys(spark, sf_dir, 12).selectExpr("page_uid", "seq", "concat('w', k % 7, 'x') AS text", "int(seq div 4) AS line", "int(seq div 8) AS block", "double(seq % 4 * 30 + if(seq % 4 >= 2, 100, 0)) AS x0", "double(seq div 4 * 20) AS y0")
    return rows.withColumns({"x1": F.col("x0") + 18, "y1": F.col("y0") + 10})


@query(f"WITH {_WORDS} SELECT page_uid, seq, (e - length(text))::BIGINT AS s, e::BIGINT AS e, length(sep)::BIGINT AS gap FROM placed")
def word_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.word_offsets(_boxes(spark, sf_dir)).select("page_uid", "seq", F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"), F.length("sep").cast("long").alias("gap"))


@query(f"WITH {_WORDS} SELECT page_uid, string_agg(sep || text, '' ORDER BY seq) AS text FROM s GROUP BY page_uid")
def column_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.words_to_text(_boxes(spark, sf_dir))


@query(f"""WITH {_WORDS}, spans(id, a, z) AS (VALUES ('a', 2, 17), ('b', 30, 41)), hit AS (SELECT p.*, id, lag(seq) OVER (PARTITION BY page_uid, id ORDER BY seq) AS before FROM placed p, spans WHERE e - length(text) < z AND e > a),
g AS (SELECT *, sum((before IS NULL OR sep <> ' ')::INT) OVER (PARTITION BY page_uid, id ORDER BY seq) AS part FROM hit),
r AS (SELECT page_uid, id, part, min(x0) - 1 AS x0, min(y0) - 1 AS y0, max(x1) + 1 AS x1, max(y1) + 1 AS y1, count(*) AS n FROM g GROUP BY ALL)
SELECT page_uid, id AS span_id, count(*) AS n, sum(x0) AS x0, sum(y0) AS y0, sum(x1) AS x1, sum(y1) AS y1 FROM r GROUP BY ALL""")
def span_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    spans = boxes.select("page_uid").distinct().join(F.broadcast(spark.sql("SELECT * FROM VALUES ('a', 2, 17), ('b', 30, 41) AS t(span_id, start, end)")))
    rects = words.rects_for_spans(words.word_offsets(boxes), spans)
    each = rects.select("page_uid", "span_id", F.explode("rects").alias("r"))
    return each.groupBy("page_uid", "span_id").agg(F.count("*").alias("n"), *(F.sum(f"r.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")))


@query(f"WITH {_WORDS} SELECT page_uid, (e - 3)::BIGINT AS s, x0 - 1 AS x0, y0 - 1 AS y0, x1 + 1 AS x1, y1 + 1 AS y1 FROM placed WHERE text = 'w3x'")
def found_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_text(_boxes(spark, sf_dir), "W3X", clip=True)
    return found.select("page_uid", F.col("start").cast("long").alias("s"), F.explode("rects").alias("r")).select("page_uid", "s", "r.*")


_LINES = """w AS (SELECT o_orderkey // 20 AS page_uid, o_orderkey * 7 % 20 AS seq, o_orderkey AS k, (o_orderkey * 7 % 20) // 5 AS l, (o_orderkey * 7 % 20 % 5 * 50) AS x0 FROM orders),
v AS (SELECT *, dense_rank() OVER (PARTITION BY page_uid ORDER BY l) - 1 AS v_line FROM w), p AS (SELECT *, row_number() OVER (PARTITION BY page_uid, v_line ORDER BY x0, seq) - 1 AS place FROM v)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words whose heights differ a little within a line; seq is not their order on the page."""
    rows = _keys(spark, sf_dir, 20).selectExpr("page_uid", "k", "k * 7 % 20 AS seq").selectExpr("*", "double(seq div 5 * 20 + k * 13 % 4) AS y0", "double(seq % 5 * 50) AS x0")
    return words.visual_lines(rows.withColumns({"y1": F.col("y0") + 10, "x1": F.col("x0") + 40}))


@query(f"WITH {_LINES} SELECT page_uid, seq, v_line FROM v")
def visual_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("page_uid", "seq", *longs("v_line"))


@query(f"WITH {_LINES} SELECT page_uid, seq FROM p WHERE (v_line = 0 AND place >= 1) OR v_line = 1 OR (v_line = 2 AND place <= 1)")
def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.line_runs(_lines(spark, sf_dir), (2, 1), (0, 1)).select("page_uid", "seq")


@query("WITH c AS (SELECT o_orderkey // 30 AS page_uid, o_orderkey % 30 AS seq FROM orders) SELECT page_uid, seq, dense_rank() OVER (PARTITION BY page_uid ORDER BY seq % 6) - 1 AS row FROM c")
def baseline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = _keys(spark, sf_dir, 30).selectExpr("page_uid", "seq", "double(seq % 6 * 12 + k * 13 % 3) AS y", "10.0D AS size")
    return words.baseline_rows(chars).select("page_uid", "seq", *longs("row"))


@query("""WITH d AS (SELECT doc_id, doc_id % 2 = 0 AS t, doc_id % 3 = 0 AS v, doc_id % 7 = 0 AS f, doc_id % 40 AS n, CASE WHEN doc_id % 5 > 0 THEN repeat(' ', doc_id::INT % 2) || repeat('m', doc_id::INT % 3) END AS m, CASE WHEN doc_id % 4 > 0 THEN repeat('w', doc_id::INT % 4 - 1) END AS w, CASE WHEN doc_id % 11 > 0 THEN 'o' END AS o FROM documents)
SELECT doc_id, CASE WHEN f THEN 'needs_ocr' WHEN t THEN 'text' WHEN v THEN 'needs_ocr' ELSE 'blank' END AS state, NOT f AND n < 20 AND v AS ocr, coalesce(nullif(trim(m, ' '), ''), nullif(w, ''), o, '') AS text,
coalesce(trim(m, ' '), '') = '' AND coalesce(w, '') = '' AND o IS NOT NULL AS used_ocr FROM d""")
def page_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "doc_id % 2 = 0 AS t", "doc_id % 3 = 0 AS v", "doc_id % 7 = 0 AS f", "doc_id % 40 AS n", "if(doc_id % 5 > 0, concat(repeat(' ', int(doc_id % 2)), repeat('m', int(doc_id % 3))), NULL) AS m", "if(doc_id % 4 > 0, repeat('w', int(doc_id % 4 - 1)), NULL) AS w", "if(doc_id % 11 > 0, 'o', NULL) AS o"
    )
    text = words.page_text(F.col("m"), F.col("w"), F.col("o"))
    return d.select("doc_id", words.page_state(F.col("t"), F.col("v"), F.col("f")).alias("state"), words.needs_ocr(F.col("n"), F.col("v"), F.col("f")).alias("ocr"), text["text"].alias("text"), text["used_ocr"].alias("used_ocr"))


@query("""WITH n AS (SELECT o_orderkey // 12 AS p, repeat('a', 1 + (o_orderkey // 12)::INT % 3) AS t FROM orders WHERE (o_orderkey // 12) % 5 > 0), o AS (SELECT o_orderkey // 12 AS p, 'ocr' AS t FROM orders WHERE (o_orderkey // 12) % 2 = 0 AND o_orderkey % 3 = 0),
s AS (SELECT coalesce(a.p, b.p) AS p, coalesce(a.l, 0) < 20 AND b.p IS NOT NULL AS used FROM (SELECT p, sum(length(t)) AS l FROM n GROUP BY p) a FULL JOIN (SELECT DISTINCT p FROM o) b ON a.p = b.p)
SELECT s.p AS page_uid, used, count(*) AS n, sum(length(t))::BIGINT AS chars FROM s JOIN (SELECT *, false AS u FROM n UNION ALL SELECT *, true FROM o) w ON w.p = s.p AND w.u = used GROUP BY ALL""")
def chosen_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _keys(spark, sf_dir, 12)
    native = keys.where("page_uid % 5 > 0").selectExpr("page_uid", "repeat('a', int(1 + page_uid % 3)) AS text")
    ocr = keys.where("page_uid % 2 = 0 AND k % 3 = 0").selectExpr("page_uid", "'ocr' AS text")
    return words.choose_words(native, ocr).groupBy("page_uid", F.col("used_ocr").alias("used")).agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


_SCORES = """w AS (SELECT o_orderkey // 40 AS p, o_orderkey % 4 * 90 AS d, (o_orderkey * 7 + o_orderkey // 40) % 5 AS kind FROM orders), s AS (SELECT p, d, sum(CASE kind WHEN 0 THEN 25 WHEN 1 THEN 25 WHEN 4 THEN 16 ELSE 0 END) AS score FROM w GROUP BY ALL)"""


def _oriented(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "CASE (k * 7 + page_uid) % 5 WHEN 0 THEN 'Hello' WHEN 1 THEN 'HELLO' WHEN 2 THEN 'hELLo' WHEN 3 THEN 'ab' ELSE '\"Word,\"' END AS text"
    return words.orientation_score(_keys(spark, sf_dir, 40).selectExpr("page_uid", "int(k % 4 * 90) AS degrees", text))


@query(f"WITH {_SCORES} SELECT p AS page_uid, d::BIGINT AS degrees, score::BIGINT AS score FROM s")
def orientation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _oriented(spark, sf_dir).select("page_uid", *longs("degrees"), "score")


@query(f"""WITH {_SCORES}, k AS (SELECT *, CASE d WHEN 0 THEN 0 WHEN 180 THEN 1 WHEN 90 THEN 2 ELSE 3 END AS turn FROM s)
SELECT p AS page_uid, (list(d ORDER BY score >= 100 DESC, CASE WHEN score >= 100 THEN turn END, score DESC, turn))[1]::BIGINT AS degrees FROM k GROUP BY p HAVING max(score) > 0""")
def best_orientations(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _oriented(spark, sf_dir).withColumn("score", F.col("score") * 4)  # so that 100 here is good enough
    return words.best_orientation(scores, [0, 180, 90, 270]).select("page_uid", *longs("degrees"))


@query("""WITH c AS (SELECT l_orderkey % 300 AS p, l_partkey % 30 = 0 AS blank, l_partkey % 11 > 0 OR l_orderkey % 2 = 0 AS mono, l_linenumber % 4 AS kind, l_suppkey % 5 AS opacity, l_partkey % 50 AS n, l_quantity AS q FROM lineitem)
SELECT p AS page_uid, count(*) FILTER (NOT blank) >= 20 AND count(*) FILTER (NOT blank AND mono) >= 0.9 * count(*) FILTER (NOT blank) AS monospaced,
sum(CASE WHEN kind = 3 OR opacity = 0 THEN 0 ELSE n END) > sum(CASE WHEN kind = 3 OR opacity = 0 THEN n ELSE 0 END) AS visible, list_sort(list(q))[len(list(q)) // 2 + 1] AS median FROM c GROUP BY p""")
def character_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey % 300 AS page_uid", "if(l_partkey % 30 = 0, ' ', 'x') AS c", "l_partkey % 11 > 0 OR l_orderkey % 2 = 0 AS mono", "l_linenumber % 4 AS render_type", "l_suppkey % 5 AS opacity", "l_partkey % 50 AS n_chars", "l_quantity AS q"
    )
    return words.monospace_share(chars).join(words.text_layer_visible(chars), "page_uid").join(words.upper_medians(chars, "q"), "page_uid")


@query("""WITH u AS (SELECT l_orderkey % 500 AS line_id, l_returnflag || l_linestatus AS style, count(*) AS n, min(l_orderkey * 8 + l_linenumber) AS f FROM lineitem GROUP BY ALL) SELECT line_id, (list(style ORDER BY n DESC, f, style))[1] AS style FROM u GROUP BY line_id""")
def dominant_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 500 AS line_id", "concat(l_returnflag, l_linestatus) AS style", "l_orderkey * 8 + l_linenumber AS seq")
    return words.dominant_style(rows)


@query("""SELECT o_orderkey AS k, 99::DOUBLE AS x0, CASE o_orderkey % 5 WHEN 1 THEN 98.05 ELSE 95 END::DOUBLE AS y0, CASE o_orderkey % 5 WHEN 2 THEN 148.95 ELSE 151 END::DOUBLE AS x1, CASE o_orderkey % 5 WHEN 0 THEN 111.95 ELSE 115 END::DOUBLE AS y1 FROM orders WHERE o_orderkey % 5 < 4
UNION ALL SELECT o_orderkey, 99, 98.05, 151, 111.95 FROM orders WHERE o_orderkey % 5 = 4""")
def clipped_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle around a word, with another word below, above, beside, far off, or both above and below."""
    own = "named_struct('seq', 0, 'x0', 100.0D, 'y0', 100.0D, 'x1', 150.0D, 'y1', 110.0D)"
    low, high = ("named_struct('seq', {}, 'x0', 110.0D, 'y0', {}, 'x1', 140.0D, 'y1', {})".format(*v) for v in ((1, "112.0D", "122.0D"), (2, "88.0D", "98.0D")))
    side, far = ("named_struct('seq', 1, 'x0', {}, 'y0', {}, 'x1', {}, 'y1', {})".format(*v) for v in (("149.0D", "101.0D", "180.0D", "109.0D"), ("300.0D", "300.0D", "310.0D", "310.0D")))
    keys = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k")
    others = f"CASE k % 5 WHEN 0 THEN array({low}) WHEN 1 THEN array({high}) WHEN 2 THEN array({side}) WHEN 3 THEN array({far}) ELSE array({low}, {high}) END"
    boxes = keys.selectExpr("k AS page_uid", f"explode(concat(array({own}), {others})) AS w").select("page_uid", "w.*")
    rects = keys.selectExpr("k AS page_uid", "k AS rect_id", "named_struct('x0', 99.0D, 'y0', 95.0D, 'x1', 151.0D, 'y1', 115.0D) AS r", "array(0) AS own")
    return words.clip_to_words(rects, boxes).select(F.col("rect_id").alias("k"), "r.*")


_NEAR = """p AS (SELECT o_orderkey AS k, o_orderkey % 50 AS page, o_orderkey * 37 % 200 AS x, o_orderkey * 53 % 120 AS y FROM orders), l AS (SELECT s_suppkey AS id, s_suppkey % 50 AS page, s_suppkey * 17 % 60 AS x0, s_suppkey * 29 % 100 AS y0 FROM supplier),
j AS (SELECT k, id, abs(y0 + 6 - y) AS dy, greatest(x0 - x, x - x0 - 80, 0) AS dx, x BETWEEN x0 - 1.5 AND x0 + 81.5 AND y BETWEEN y0 - 1.5 AND y0 + 13.5 AS inside FROM p JOIN l USING (page))"""


def _points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    points = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS point_id", "o_orderkey % 50 AS page_uid", "double(o_orderkey * 37 % 200) AS x", "double(o_orderkey * 53 % 120) AS y")
    lines = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS line_id", "s_suppkey % 50 AS page_uid", "double(s_suppkey * 17 % 60) AS x0", "double(s_suppkey * 29 % 100) AS y0")
    return points, lines.withColumns({"x1": F.col("x0") + 80, "y1": F.col("y0") + 12})


@query(f"WITH {_NEAR} SELECT k, (list(id ORDER BY dy + 0.25 * dx, id))[1] AS line_id FROM j GROUP BY k")
def nearest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.nearest_line(*_points(spark, sf_dir)).select(F.col("point_id").alias("k"), "line_id")


@query(f"WITH {_NEAR} SELECT k, (list(id ORDER BY dy, id))[1] AS line_id FROM j WHERE inside GROUP BY k")
def lines_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.line_at(*_points(spark, sf_dir)).select(F.col("point_id").alias("k"), "line_id")


@query("""WITH c AS (SELECT o_orderkey // 16 AS p, (o_orderkey % 16) // 4 AS r, o_orderkey AS k FROM orders), l AS (SELECT p, r, CASE WHEN r % 2 = 0 THEN string_agg(chr((97 + k % 26)::INT), '' ORDER BY k) ELSE string_agg(chr((97 + k % 26)::INT), ' ' ORDER BY k) END AS line FROM c GROUP BY p, r)
SELECT p AS page_uid, '```' || chr(10) || string_agg(CASE WHEN r = 3 THEN chr(10) ELSE '' END || line, chr(10) ORDER BY r) || chr(10) || '```' AS text FROM l GROUP BY p""")
def monospace_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rows of characters, every other one spaced, the last one after a gap."""
    chars = _keys(spark, sf_dir, 16).selectExpr("page_uid", "seq", "chr(97 + k % 26) AS c", "seq div 4 AS r").selectExpr("*", "double(seq % 4 * (1 + r % 2) * 6) AS x", "double(r * 12 + if(r = 3, 24, 0)) AS y", "6.0D AS w", "10.0D AS size")
    return words.monospace_grid(chars)


@query("""WITH t AS (SELECT o_orderkey AS k, (o_orderkey % 600)::DOUBLE AS x, (o_orderkey * 7 % 800)::DOUBLE AS y, o_orderkey % 5 * 90 AS d FROM orders), r AS (SELECT *, CASE d % 360 WHEN 0 THEN x WHEN 90 THEN 800 - y WHEN 180 THEN 600 - x ELSE y END AS rx, CASE d % 360 WHEN 0 THEN y WHEN 90 THEN x WHEN 180 THEN 800 - y ELSE 600 - x END AS ry FROM t)
SELECT k, 10 + rx * 2 AS cx, 20 + ry * 2 AS cy, x AS bx, y AS by_, CASE WHEN least(x + 100, 500) - greatest(x - 50, 100) >= 1 AND least(y + 30, 700) - greatest(y - 30, 200) >= 1 THEN least(x + 100, 500) - greatest(x - 50, 100) END AS width,
greatest(8, least(200, (x + 1) * 72 / 400)) AS dpi FROM r""")
def canvas_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points to a turned canvas and back, a rectangle around each clamped to a box, and resolutions for widths."""
    t = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "double(o_orderkey % 600) AS x", "double(o_orderkey * 7 % 800) AS y", "o_orderkey % 5 * 90 AS d")
    size = (F.lit(600.0), F.lit(800.0), F.col("d"), F.lit(2.0), F.lit(10.0), F.lit(20.0))
    cx, cy = G.to_canvas(F.col("x"), F.col("y"), *size)
    placed = t.withColumns({"cx": cx, "cy": cy})
    bx, by = G.from_canvas(F.col("cx"), F.col("cy"), *size)
    around = G.normalise(G.rect(F.col("x") + 100, F.col("y") + 30, F.col("x") - 50, F.col("y") - 30))
    part = G.clamp(around, G.rect(F.lit(100.0), F.lit(200.0), F.lit(500.0), F.lit(700.0)))
    return placed.select("k", "cx", "cy", bx.alias("bx"), by.alias("by_"), (part["x1"] - part["x0"]).alias("width"), G.zoom_dpi(F.col("x") + 1, F.lit(400.0)).alias("dpi"))


@query("""WITH r AS (SELECT l_orderkey AS k, list(struct_pack(y := (l_partkey % 300)::DOUBLE, h := (5 + l_suppkey % 9)::DOUBLE) ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem GROUP BY l_orderkey),
m AS (SELECT *, 3 * list_sort(list_transform(r, lambda x: x.h))[len(r) // 2 + 1] * len(r) AS most FROM r)
SELECT k, (CASE WHEN len(r) < 2 THEN len(r) ELSE greatest(1, len(list_filter(r, lambda x: abs(x.y - r[1].y) <= most))) END)::BIGINT AS n FROM m""")
def kept_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS k", "l_linenumber AS a", "l_partkey AS b", "l_suppkey AS c", "named_struct('x0', 0.0D, 'y0', double(l_partkey % 300), 'x1', 9.0D, 'y1', double(l_partkey % 300 + 5 + l_suppkey % 9)) AS r")
    listed = rows.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", "c", "r"))), lambda x: x["r"]).alias("r"))
    return listed.select("k", F.size(G.drop_outliers(F.col("r"))).cast("long").alias("n"))

"""Registered queries of the file and page model, over files made of sources and pages made of documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docveil.operators import export, model
from docveil.queries import _FILES, _model, _selected
from docveil.registry import longs, query, table

# Pages after the marked ones moved to 'src1', behind its first two other pages.
_MOVED = f"""{_FILES}, m AS (SELECT f.model, f.uid, f.iid AS src, f.pos AS src_index, CASE WHEN c.uid IS NULL THEN f.iid ELSE 'src1' END AS iid, f.pos AS old, c.out_pos FROM flat f LEFT JOIN chosen c ON c.uid = f.uid),
r AS (SELECT *, row_number() OVER (PARTITION BY model, iid, out_pos IS NULL ORDER BY old) - 1 AS rest FROM m),
moved AS (SELECT model, uid, src, src_index, iid, row_number() OVER (PARTITION BY model, iid ORDER BY CASE WHEN out_pos IS NULL THEN rest ELSE 2 END, out_pos IS NULL, out_pos) - 1 AS pos FROM r)"""
# Files of which some were torn out of the one or two before them, and some of one that is gone.
_TORN = f"""{_FILES}, torn AS (SELECT *, CASE WHEN file_pos % 3 = 1 THEN lag(iid) OVER w WHEN file_pos % 3 = 2 THEN CASE WHEN file_pos % 2 = 1 THEN lag(iid, 2) OVER w ELSE 'gone' END END AS origin FROM files WINDOW w AS (PARTITION BY model ORDER BY file_pos))"""


def _moved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return model.move_pages(*_model(spark, sf_dir), _selected(spark, sf_dir), "src1", 2)


def _torn(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("model").orderBy("pos")
    two = F.when(F.col("pos") % 2 == 1, F.lag("iid", 2).over(w)).otherwise(F.lit("gone"))
    return _model(spark, sf_dir)[0].withColumn("origin_iid", F.when(F.col("pos") % 3 == 1, F.lag("iid").over(w)).when(F.col("pos") % 3 == 2, two))


@query(f"""WITH {_FILES}, new(path, p) AS (VALUES ('src3.pdf', 0), ('new0.pdf', 1), ('new0.pdf', 2), ('new1.pdf', 3)),
own AS (SELECT f.model, n.path, min(n.p) AS p FROM (SELECT DISTINCT model FROM files) f CROSS JOIN new n ANTI JOIN files g ON g.model = f.model AND g.iid || '.pdf' = n.path GROUP BY ALL),
both_ AS (SELECT model, iid || '.pdf' AS path, 0 AS g, file_pos AS p FROM files UNION ALL SELECT model, path, 1, p FROM own)
SELECT model, path, row_number() OVER (PARTITION BY model ORDER BY g, p) - 1 AS pos FROM both_""")
def added_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, _ = _model(spark, sf_dir)
    rows = spark.sql("SELECT * FROM VALUES ('src3.pdf', 0), ('new0.pdf', 1), ('new0.pdf', 2), ('new1.pdf', 3) AS t(path, pos)").withColumn("iid", F.concat(F.lit("n"), "pos"))
    new = files.select("model").distinct().join(F.broadcast(rows))
    return model.add_files(files, new).select("model", "path", *longs("pos"))


@query(f"""WITH {_FILES}, k AS (SELECT model, iid, CASE WHEN u % 3 = 0 THEN 1 WHEN u % 5 = 0 THEN 0 ELSE n END AS n FROM files)
SELECT model, iid, n::BIGINT AS n, iid || '#' || (n - 1) AS last_uid FROM k WHERE n > 0""")
def populated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, _ = _model(spark, sf_dir)
    kinds = files.withColumn("kind", F.expr("if(size_bytes % 3 = 0, 'image', 'pdf')")).withColumn("source_page_count", F.expr("if(size_bytes % 5 = 0, NULL, source_page_count)"))
    return model.populate_pages(kinds).groupBy("model", "iid").agg(F.count("*").alias("n"), F.max_by("uid", "pos").alias("last_uid"))


@query(f"""WITH {_FILES}, s AS (SELECT * FROM chosen WHERE model <> 'en' UNION ALL (SELECT * FROM chosen WHERE model = 'en' ORDER BY uid LIMIT 1)), c AS (SELECT model, count(DISTINCT uid) AS n FROM s GROUP BY model)
SELECT f.model, count(*) AS n, sum(f.uid)::BIGINT AS total FROM flat f LEFT JOIN c ON c.model = f.model WHERE coalesce(c.n, 0) < 2 OR f.uid IN (SELECT uid FROM s) GROUP BY f.model""")
def page_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, pages = _model(spark, sf_dir)
    marked = _selected(spark, sf_dir)
    one = marked.where("model = 'en'").orderBy("uid").limit(1)
    return model.page_scope(pages, marked.where("model <> 'en'").unionByName(one)).groupBy("model").agg(F.count("*").alias("n"), F.sum("uid").alias("total"))


@query(f"WITH {_MOVED} SELECT model, uid, CASE WHEN iid = src THEN (src_index + 1)::VARCHAR ELSE '+' || (pos + 1) END AS label FROM moved")
def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, pages = _moved(spark, sf_dir)
    joined = pages.join(files.select("model", "iid", "path"), ["model", "iid"], "left").withColumn("path", F.coalesce("path", F.lit("src1.pdf")))
    return joined.select("model", "uid", model.page_label(F.col("path"), F.col("src_path"), F.col("src_index"), F.col("pos")).alias("label"))


@query(f"""WITH {_FILES}, k AS (SELECT model, iid, n, u % 3 = 0 AS image, u % 2 = 0 AS loaded, CASE WHEN u % 5 > 0 THEN n END AS said FROM files)
SELECT model, iid, (CASE WHEN loaded THEN n WHEN image THEN 1 ELSE coalesce(said, 0) END)::BIGINT AS n_pages,
CASE WHEN loaded THEN n::VARCHAR WHEN image THEN '1' ELSE coalesce(said::VARCHAR, '') END AS in_view, CASE WHEN loaded THEN n::VARCHAR WHEN image THEN '' ELSE coalesce(said::VARCHAR, '') END AS in_model FROM k""")
def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, pages = _model(spark, sf_dir)
    kinds = files.withColumns({"kind": F.expr("if(size_bytes % 3 = 0, 'image', 'pdf')"), "pages_loaded": F.expr("size_bytes % 2 = 0"), "source_page_count": F.expr("if(size_bytes % 5 > 0, source_page_count, NULL)")})
    shown = [model.pages_text(F.col("kind"), F.col("pages_loaded"), F.col("n_pages"), F.col("source_page_count"), view).alias(name) for view, name in ((True, "in_view"), (False, "in_model"))]
    return model.page_totals(kinds, pages).select("model", "iid", "n_pages", *shown)


@query(f"WITH {_FILES} SELECT model, count(*) AS n FROM flat WHERE uid % 4 = 0 GROUP BY model")
def image_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, pages = _model(spark, sf_dir)
    return model.image_pages(pages.withColumn("src_path", F.expr("if(uid % 4 = 0, concat(iid, '.JPG'), concat(iid, '.PDF'))"))).groupBy("model").agg(F.count("*").alias("n"))


@query(f"WITH {_FILES} SELECT model, uid, out_pos FROM chosen")
def ordered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.ordered_pages(*_model(spark, sf_dir), _selected(spark, sf_dir)).select("model", "uid", *longs("out_pos"))


@query(f"WITH {_FILES} SELECT model, uid, pos * 10 AS hit FROM flat WHERE iid IN ('src1', 'src2') AND pos % 3 = 0 AND pos < 30")
def applied_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = spark.sql("SELECT src_path, id AS src_index, id * 10 AS hit FROM range(0, 30, 3), (VALUES ('SRC1.pdf'), ('Src2.PDF')) AS t(src_path)")
    return model.apply_hits(_model(spark, sf_dir)[1], hits).select("model", "uid", *longs("hit"))


@query(f"WITH {_FILES} SELECT iid || '.pdf' AS src_key, pos AS src_index, count(*) AS n FROM flat GROUP BY ALL")
def ocr_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, serves = model.ocr_jobs(_model(spark, sf_dir)[1].withColumn("src_path", F.expr("if(model = 'de', upper(src_path), src_path)")))
    return jobs.join(serves, ["src_key", "src_index"]).groupBy("src_key", "src_index").agg(F.count("*").alias("n")).select("src_key", *longs("src_index"), "n")


@query(f"""WITH {_MOVED}, s AS (SELECT *, src <> lag(src) OVER (PARTITION BY model, iid ORDER BY pos) AS new FROM moved)
SELECT model, iid, (1 + count(*) FILTER (new))::BIGINT AS n_runs FROM s GROUP BY model, iid""")
def source_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.source_runs(_moved(spark, sf_dir)[1]).groupBy("model", "iid").agg((F.max("src_run") + 1).cast("long").alias("n_runs"))


@query(f"""WITH {_TORN} SELECT model, iid, (sum(CASE WHEN file_pos % 3 = 1 OR (file_pos % 3 = 2 AND file_pos % 2 = 1) THEN 0 ELSE 1 END) OVER (PARTITION BY model ORDER BY file_pos) - 1)::BIGINT AS block FROM torn""")
def file_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.blocks(_torn(spark, sf_dir)).select("model", "iid", *longs("block"))


@query(f"""WITH {_TORN}, k AS (SELECT t.*, p.u AS pu, p.file_pos AS pp FROM torn t LEFT JOIN files p ON p.model = t.model AND p.iid = t.origin)
SELECT model, iid, row_number() OVER (PARTITION BY model ORDER BY coalesce(pu, u) DESC, coalesce(pp, file_pos) DESC, pu IS NOT NULL, file_pos) - 1 AS pos FROM k""")
def sorted_with_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.sort_files(_torn(spark, sf_dir), "size", True).select("model", "iid", *longs("pos"))


@query(f"""WITH {_FILES}, k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY creation_date DESC NULLS LAST, iid || '.pdf', iid) AS rank FROM files),
named AS (SELECT *, CASE WHEN u % 4 <> 0 THEN rank END AS r FROM k)
SELECT model, iid, row_number() OVER (PARTITION BY model ORDER BY r NULLS LAST, file_pos) - 1 AS pos, CASE WHEN u % 2 = 0 THEN DATE '2021-01-01' + (u % 300)::INT END AS name_date FROM named""")
def power_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, _ = _model(spark, sf_dir)
    rows = model.power_sort_rows(files.withColumn("name", model.base_name(F.col("path"))), "creation_date", True)
    dates = files.where("size_bytes % 2 = 0").select("model", "iid", F.expr("date_add(DATE '2021-01-01', int(size_bytes % 300))").alias("name_date"))
    return model.power_sort(files, rows.where("size_bytes % 4 <> 0").select("model", "iid", "rank"), dates).select("model", "iid", *longs("pos"), "name_date")


@query(f"""WITH {_FILES}, k AS (SELECT *, (model = 'en' AND iid = 'src3') OR (model = 'de' AND iid = 'src0') AS m FROM files), r AS (SELECT *, row_number() OVER (PARTITION BY model, m ORDER BY file_pos) - 1 AS i FROM k)
SELECT model, iid, row_number() OVER (PARTITION BY model ORDER BY CASE WHEN m THEN CASE model WHEN 'en' THEN 0.5 ELSE 98.5 END ELSE i END) - 1 AS pos FROM r""")
def moved_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, _ = _model(spark, sf_dir)
    return model.move_file(model.move_file(files, "en", "src3", 1), "de", "src0", 99).select("model", "iid", *longs("pos"))


@query(f"""WITH {_TORN}, b AS (SELECT *, model = 'en' AND (file_pos = 3 OR coalesce(origin = (SELECT iid FROM files WHERE model = 'en' AND file_pos = 3), false)) AS own FROM torn)
SELECT model, iid, row_number() OVER (PARTITION BY model ORDER BY CASE WHEN own THEN 7.5 ELSE file_pos END, CASE WHEN own THEN file_pos <> 3 END, file_pos) - 1 AS pos FROM b""")
def dropped_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourth file with its children before the ninth; a drop on itself changes nothing, one of an unknown file neither."""
    files = _torn(spark, sf_dir)
    iid = files.where("model = 'en' AND pos = 3").first()
    name = iid["iid"] if iid else "src0"
    still = model.drop_file(model.drop_file(files, "de", "none", 2), "en", name, 3)
    return model.drop_file(still, "en", name, 8).select("model", "iid", *longs("pos"))


@query(f"""WITH {_FILES}, new(place) AS (VALUES (0), (3), (7)), b AS (SELECT model, iid, uid::VARCHAR AS uid, pos AS place, 1 AS g FROM flat UNION ALL SELECT model, iid, 'n' || place, place, 0 FROM (SELECT model, iid FROM files WHERE iid = 'src2'), new)
SELECT model, iid, uid, row_number() OVER (PARTITION BY model, iid ORDER BY place, g) - 1 AS pos FROM b WHERE iid = 'src2'""")
def inserted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, pages = _model(spark, sf_dir)
    places = spark.sql("SELECT * FROM VALUES (0), (3), (7) AS t(at)")
    new = files.where("iid = 'src2'").select("model", "iid").join(F.broadcast(places)).select("model", "iid", F.concat(F.lit("n"), "at").alias("uid"), F.lit("x.pdf").alias("src_path"), F.lit(0).alias("src_index"), F.lit(0).alias("rotation"), "at")
    return model.insert_pages(pages.withColumn("uid", F.col("uid").cast("string")), new).where("iid = 'src2'").select("model", "iid", "uid", *longs("pos"))


@query(f"WITH {_FILES} SELECT f.model, f.uid, (CASE WHEN c.uid IS NULL THEN 0 ELSE ((c.uid * 90 - 720) % 360 + 360) % 360 END)::BIGINT AS rotation FROM flat f LEFT JOIN chosen c ON c.uid = f.uid")
def set_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _selected(spark, sf_dir).withColumn("rotation", (F.col("uid") * 90 - 720).cast("int"))
    return model.set_fields(_model(spark, sf_dir)[1], changes).select("model", "uid", *longs("rotation"))


@query(f"WITH {_FILES} SELECT f.model, bool_or(f.model IN ('en', 'de') AND f.iid <> 'src1' AND f.uid IN (SELECT uid FROM chosen) AND EXISTS (SELECT 1 FROM files x WHERE x.model = f.model AND x.iid = 'src1')) AS moved FROM flat f GROUP BY f.model")
def pages_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, pages = _model(spark, sf_dir)
    after, now = model.move_pages(files, pages, _selected(spark, sf_dir).where("model IN ('en', 'de')"), "src1", 2)
    return model.pages_moved(after, now, model.retired_files(files, after))


def _stepped(spark: SparkSession, sf_dir: str, down: bool) -> DataFrame:
    files, _ = _model(spark, sf_dir)
    return model.step_files(files, files.where("size_bytes % 3 = 0"), down).select("model", "iid", *longs("pos"))


@query(f"""WITH {_FILES}, k AS (SELECT *, u % 3 = 0 AS c, count(*) FILTER (u % 3 <> 0) OVER (PARTITION BY model ORDER BY file_pos) AS free FROM files)
SELECT model, iid, row_number() OVER (PARTITION BY model ORDER BY CASE WHEN c AND free = 0 THEN -1 WHEN c THEN free - 0.5 ELSE free END, file_pos) - 1 AS pos FROM k""")
def files_step_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stepped(spark, sf_dir, False)


@query(f"""WITH {_FILES}, k AS (SELECT *, u % 3 = 0 AS c, count(*) FILTER (u % 3 <> 0) OVER (PARTITION BY model ORDER BY file_pos DESC) AS free FROM files)
SELECT model, iid, row_number() OVER (PARTITION BY model ORDER BY CASE WHEN c AND free = 0 THEN -1 WHEN c THEN free - 0.5 ELSE free END DESC, file_pos) - 1 AS pos FROM k""")
def files_step_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stepped(spark, sf_dir, True)


@query(f"""WITH {_FILES}, k AS (SELECT *, lag(iid) OVER w AS other, lag(n) OVER w AS n_other FROM files WINDOW w AS (PARTITION BY model ORDER BY file_pos)),
s AS (SELECT model, (list(iid ORDER BY out_pos))[1] AS iid, (list(pos ORDER BY out_pos))[1] AS a FROM chosen WHERE model = 'es' GROUP BY model)
SELECT model, 'move' AS action, 'src3' AS iid, 3::BIGINT AS position FROM files WHERE model = 'en' AND iid = 'src3' AND n > 5 UNION ALL SELECT model, 'move', other, n_other FROM k WHERE model = 'fr' AND iid = 'src5' AND n > 1
UNION ALL SELECT model, 'extract', NULL, 0 FROM files WHERE model = 'de' AND file_pos = 0 AND n > 1 UNION ALL SELECT model, 'move', iid, a FROM s WHERE (SELECT count(DISTINCT iid) FROM chosen WHERE model = 'es') > 1""")
def nudged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages inside a file, at its start with a file before it, at the start of the first file, and of several files."""
    files, pages = _model(spark, sf_dir)
    first = files.where("pos = 0").select("model", "iid")
    inside = pages.where("(model = 'en' AND iid = 'src3' AND pos IN (4, 5)) OR (model = 'fr' AND iid = 'src5' AND pos IN (0, 1))").select("model", "uid")
    start = pages.where("model = 'de' AND pos = 0").join(first, ["model", "iid"], "left_semi").select("model", "uid")
    return model.plan_nudge(files, pages, inside.unionByName(start).unionByName(_selected(spark, sf_dir).where("model = 'es'")), False)


@query(f"""WITH {_FILES}, s AS (SELECT model, iid, uid FROM chosen UNION SELECT model, iid, uid FROM flat WHERE iid = 'src7'), c AS (SELECT f.model, f.iid, count(*) AS n, count(s.uid) AS k FROM flat f LEFT JOIN s ON s.uid = f.uid GROUP BY ALL)
SELECT f.model, CASE WHEN s.uid IS NOT NULL AND c.k < c.n THEN f.iid || '/part' ELSE f.iid END AS iid, count(*) AS n FROM flat f JOIN c ON c.model = f.model AND c.iid = f.iid LEFT JOIN s ON s.uid = f.uid GROUP BY ALL""")
def moved_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, pages = _model(spark, sf_dir)
    marked = _selected(spark, sf_dir).unionByName(pages.where("iid = 'src7'").select("model", "uid"))
    return model.move_across(files, pages, marked, True)[1].groupBy("model", "iid").agg(F.count("*").alias("n"))


@query(f"WITH {_FILES} SELECT f.model, (8 - count(c.uid) FILTER (f.iid = 'src4' AND f.pos < 8))::BIGINT AS position FROM flat f LEFT JOIN chosen c ON c.uid = f.uid GROUP BY f.model")
def drop_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.drop_position(_model(spark, sf_dir)[1], _selected(spark, sf_dir), "src4", 8).select("model", *longs("position"))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ", ".join(f"if(uid % {k} = 0, named_struct('kind', '{kind}'), NULL)" for k, kind in ((3, "redact"), (2, "edit"), (5, "mark"), (9, "redact")))
    pages = _model(spark, sf_dir)[1].withColumn("annots", F.expr(f"filter(array({kinds}), x -> x IS NOT NULL)"))
    return pages.withColumns({"rotation": F.expr("int(uid % 4 * 90)"), "crop": F.expr("if(uid % 7 = 0, named_struct('x0', 1.0), NULL)")})


@query(f"WITH {_FILES} SELECT model, (count(*) FILTER (uid % 3 = 0) + count(*) FILTER (uid % 9 = 0))::BIGINT AS n FROM flat GROUP BY model")
def redaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.count_redactions(_marked(spark, sf_dir))


@query(f"""WITH {_FILES} SELECT model, stage::BIGINT AS stage, what, sum(k)::BIGINT AS n FROM (SELECT model, 0 AS stage, 'edit' AS what, (uid % 2 = 0)::INT AS k FROM flat UNION ALL SELECT model, 1, 'redact', (uid % 3 = 0)::INT + (uid % 9 = 0)::INT FROM flat
UNION ALL SELECT model, 2, 'mark', (uid % 5 = 0)::INT FROM flat UNION ALL SELECT model, 3, 'rotate', (uid % 4 <> 0)::INT FROM flat UNION ALL SELECT model, 4, 'crop', (uid % 7 = 0)::INT FROM flat) GROUP BY ALL HAVING sum(k) > 0""")
def edit_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.edit_stages(_marked(spark, sf_dir)).groupBy("model", "stage", "what").agg(F.count("*").alias("n")).select("model", *longs("stage"), "what", "n")


@query("""WITH j AS (SELECT p_brand AS model, p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS stem, row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_partkey) - 1 AS k FROM part)
SELECT p_partkey, stem || CASE WHEN k > 0 THEN '_' || k ELSE '' END || '.pdf' AS name FROM j""")
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "part").selectExpr("p_brand AS model", "p_partkey", "if(p_partkey % 2 = 0, upper(p_name), p_name) AS stem", "'.pdf' AS suffix", "p_partkey AS pos")
    return model.unique_outputs(jobs).select("p_partkey", "name")


@query("""WITH c AS (SELECT n_regionkey AS doc, n_nationkey AS chapter, n_nationkey % 4 - 1 AS a, CASE WHEN n_nationkey % 3 = 0 THEN -1 ELSE n_nationkey END AS b, 6 + n_regionkey AS n FROM nation)
SELECT doc::BIGINT AS doc, chapter::BIGINT AS chapter, unnest(range(greatest(a, 0), least(CASE WHEN b < 0 THEN n ELSE b END, n)))::BIGINT AS page FROM c""")
def chapter_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    chapters = nation.selectExpr("n_regionkey AS doc", "n_nationkey AS chapter", "n_nationkey % 4 - 1 AS first_page", "if(n_nationkey % 3 = 0, -1, n_nationkey) AS last_page")
    return export.chapter_pages(chapters, nation.selectExpr("n_regionkey AS doc", "6 + n_regionkey AS page_count").distinct()).select(*longs("doc", "chapter", "page"))

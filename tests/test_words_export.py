"""Word boxes, geometry, export, catalogue, history, sources and streams."""

import os
import random

from pyspark.sql import functions as F

from docveil.functions import geometry as G
from docveil.operators import catalog, export, history, words
from docveil.sources import documents
from docveil.streaming import session

WORDS = "page_uid string, seq int, x0 double, y0 double, x1 double, y1 double, text string, block int, line int"


def test_words_and_rects(spark):
    rows = [
        ("p", 0, 0.0, 0.0, 30.0, 10.0, "Mette", 0, 0), ("p", 1, 36.0, 0.0, 66.0, 10.0, "Kudsk", 0, 0), ("p", 2, 240.0, 0.0, 300.0, 10.0, "Fratraadt", 0, 0), ("p", 3, 0.0, 12.0, 30.0, 22.0, "under", 0, 1),
        ("p", 4, 0.0, 40.0, 30.0, 50.0, "blok", 1, 0), ("p", 5, 0.0, 40.0, 30.0, 50.0, "", 1, 0),
    ]
    df = spark.createDataFrame(rows, WORDS)
    assert words.words_to_text(df).first()["text"] == "Mette Kudsk\nFratraadt\nunder\n\nblok"
    offsets = words.word_offsets(df)
    assert {(r["start"], r["end"], r["text"]) for r in offsets.collect()} == {(0, 5, "Mette"), (6, 11, "Kudsk"), (12, 21, "Fratraadt"), (22, 27, "under"), (29, 33, "blok")}
    spans = spark.createDataFrame([("p", "s", 3, 14), ("p", "t", 30, 31), ("p", "none", 33, 40)], "page_uid string, span_id string, start int, end int")
    got = {r["span_id"]: [tuple(x) for x in r["rects"]] for r in words.rects_for_spans(offsets, spans).collect()}
    assert got == {"s": [(-1.0, -1.0, 67.0, 11.0), (239.0, -1.0, 301.0, 11.0)], "t": [(-1.0, 39.0, 31.0, 51.0)]}


def test_outliers_and_rotation(spark):
    r = "array<struct<x0:double,y0:double,x1:double,y1:double>>"
    df = spark.createDataFrame([([(0.0, 0.0, 9.0, 10.0), (0.0, 12.0, 9.0, 22.0), (0.0, 900.0, 9.0, 910.0)],), ([(0.0, 0.0, 1.0, 1.0)],)], f"r {r}")
    assert [len(x[0]) for x in df.select(G.drop_outliers(F.col("r"))).collect()] == [2, 1]
    pts = spark.createDataFrame([(float(x), float(y), d) for x in (0, 7, 30) for y in (0, 5) for d in (0, 90, 180, 270)], "x double, y double, d int")
    w, h, s, o = (F.lit(v) for v in (100.0, 200.0, 1.5, 3.0))
    cx, cy = G.to_canvas(F.col("x"), F.col("y"), w, h, F.col("d"), s, o, o)
    bx, by = G.from_canvas(F.col("cx"), F.col("cy"), w, h, F.col("d"), s, o, o)
    for r in pts.withColumn("cx", cx).withColumn("cy", cy).select("x", "y", bx.alias("bx"), by.alias("by")).collect():
        assert abs(r["x"] - r["bx"]) < 1e-9 and abs(r["y"] - r["by"]) < 1e-9


def test_lines_and_rows(spark):
    rows = [("p", 0, 0.0, 0.0, 5.0, 10.0, "a", 0, 0), ("p", 1, 8.0, 2.0, 12.0, 12.0, "b", 0, 0), ("p", 2, 0.0, 11.0, 5.0, 21.0, "c", 0, 0)]
    got = {r["text"]: r["v_line"] for r in words.visual_lines(spark.createDataFrame(rows, WORDS)).collect()}
    assert got == {"a": 0, "b": 0, "c": 1}
    chars = spark.createDataFrame([("p", k, y, 9.0) for k, y in enumerate([0.0, 2.0, 4.0, 6.0])], "page_uid string, seq int, y double, size double")
    assert [r["row"] for r in words.baseline_rows(chars).orderBy("seq").collect()] == [0, 0, 1, 1]


def test_ocr_choices(spark):
    native = spark.createDataFrame([("a", "long enough native text"), ("b", "x")], "page_uid string, text string")
    ocr = spark.createDataFrame([("a", "o"), ("b", "scanned"), ("c", "only")], "page_uid string, text string")
    got = {(r["page_uid"], r["text"], r["used_ocr"]) for r in words.choose_words(native, ocr).collect()}
    assert got == {("a", "long enough native text", False), ("b", "scanned", True), ("c", "only", True)}
    scores = spark.createDataFrame([("p", 0, 10), ("p", 90, 500), ("p", 180, 900), ("q", 0, 0)], "page_uid string, degrees int, score long")
    assert [tuple(r) for r in words.best_orientation(scores, [0, 90, 180, 270]).collect()] == [("p", 90)]


def test_grid(spark):
    chars = [("p", k, c, x * 6.0, y, 6.0, 10.0) for k, (c, x, y) in enumerate([("a", 0, 0.0), ("b", 3, 0.0), ("c", 1, 12.0), ("e", 0, 24.0), ("d", 0, 60.0)])]
    df = spark.createDataFrame(chars, "page_uid string, seq int, c string, x double, y double, w double, size double")
    assert words.monospace_grid(df).first()["text"] == "```\na  b\n c\ne\n\nd\n```"


def test_export(spark):
    pages = spark.createDataFrame(
        [("d", 0, 0, 0, "text", " # En \n", None), ("d", 0, 0, 1, "blank", "", None), ("d", 0, 0, 2, "needs_ocr", "", None), ("d", 1, 3, 3, "needs_ocr", "", "læst ")],
        "doc string, chapter int, first_page int, page int, state string, md string, ocr string",
    )
    bodies = export.chapter_bodies(pages)
    got = {r["chapter"]: (r["body"], r["missing"], r["had_text"]) for r in bodies.collect()}
    assert got[1] == ("læst", 0, True) and got[0][1] == 1 and "Side 3" in got[0][0]
    chapters = bodies.withColumn("title", F.concat(F.lit("K"), "chapter")).withColumn("error", F.lit(None).cast("string"))
    titles = spark.createDataFrame([("d", "Titel")], "doc string, doc_title string")
    md = export.render(chapters, titles, "md").first()["text"]
    assert md.startswith("# Titel\n\n> Bemærk: 1 side") and "## K0\n\n# En" not in md and "## K0" in md and md.endswith("læst\n")
    txt = export.render(chapters, titles, "txt").first()["text"]
    assert txt.startswith("Titel\n\n=====") and "--- K1 ---" in txt and txt.endswith("\r\n")
    ranges = export.chapter_pages(spark.createDataFrame([("d", 0, -2, 2), ("d", 1, 2, -1), ("d", 2, 9, 9)], "doc string, chapter int, first_page int, last_page int"), spark.createDataFrame([("d", 4)], "doc string, page_count int"))
    assert sorted((r["chapter"], r["page"]) for r in ranges.collect()) == [(0, 0), (0, 1), (1, 2), (1, 3)]


def test_minus_and_ends(spark):
    w = [("p", 0, 0, k, t) for k, t in enumerate(["A-skat", "592,39-"])] + [("p", 0, 1, k, t) for k, t in enumerate(["Gage", "592,39"])]
    df = spark.createDataFrame(w, "page_uid string, block int, line int, seq int, text string")
    contexts = export.trailing_minus_contexts(df)
    assert [r["context"] for r in contexts.collect()] == ["A-skat 592,39"]
    texts = spark.createDataFrame([("p", "A-skat 592,39\nGage 592,39")], "page_uid string, text string")
    assert export.restore_minus(texts, contexts).first()["text"] == "A-skat 592,39-\nGage 592,39"
    rnd = random.Random(1)
    cases = [("".join(rnd.choice("ab") for _ in range(rnd.randint(0, 6))), "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 6)))) for _ in range(40)]
    for r in spark.createDataFrame(cases, "a string, b string").select("a", "b", export.common_ends(F.col("a"), F.col("b")).alias("e")).collect():
        a, b = r["a"], r["b"]
        n = len(os.path.commonprefix([a, b]))
        s = min(len(os.path.commonprefix([a[::-1], b[::-1]])), min(len(a), len(b)) - n)
        assert (r["e"]["prefix"], r["e"]["suffix"]) == (n, s)


def test_frames(spark):
    df = spark.createDataFrame([([["a\nb\nc\nd", None], ["x", "y"]],), ([["a\nb", None], ["x", "y"]],), ([["a\nb\nc\nd"]],)], "rows array<array<string>>")
    assert [r[0] for r in df.select(export.is_frame(F.col("rows"))).collect()] == [True, False, False]


def test_catalogue(spark):
    entries = spark.createDataFrame([("da", "Gem %s", "Gem %s", False), ("en", "Gem %s", "", False)], "lang string, msgid string, value string, fuzzy boolean")
    bad, errors = catalog.apply_table(entries, spark.createDataFrame([("en", "Gem %s", "Save")], "lang string, msgid string, value string"))
    assert errors.count() == 1 and bad.where("value = 'Save'").count() == 0
    good, errors = catalog.apply_table(entries, spark.createDataFrame([("en", "Gem %s", "Save %s")], "lang string, msgid string, value string"))
    assert errors.count() == 0 and good.where("value = 'Save %s'").count() == 1
    assert catalog.missing(entries).first()["langs"] == ["en"]
    assert [r["text"] for r in catalog.get_text(spark.createDataFrame([("Gem %s",), ("x",)], "msgid string"), good, "en").orderBy("msgid").collect()] == ["Save %s", "x"]
    reply = spark.createDataFrame([("1", '{"version": "9.5", "download_url": "http://evil/x", "size": "12"}'), ("2", '{"available": false}'), ("3", "{")], "id string, raw string")
    got = catalog.update_reply(reply, ["good.example"], "9.4", "https://good.example/d", "https://good.example/i").collect()
    assert [(r["id"], r["download_url"], r["size"], r["update_available"]) for r in got] == [("1", "https://good.example/d", 12, True)]


def test_history(spark):
    log = spark.createDataFrame([("s", k, a) for k, a in enumerate(["do", "do", "undo", "undo", "undo", "redo", "do", "redo"])], "session string, seq int, action string")
    assert [r["version"] for r in history.replay(log).orderBy("seq").collect()] == [1, 2, 1, 0, 0, 1, 3, 3]
    steps = history.coalesce_steps(spark.createDataFrame([("s", 0, 0.0, "a"), ("s", 1, 1.0, "a"), ("s", 2, 2.1, "a"), ("s", 3, 9.0, "a"), ("s", 4, 9.1, None), ("s", 5, 9.2, None)], "session string, seq int, at double, key string"))
    assert [r["step"] for r in steps.orderBy("seq").collect()] == [1, 1, 1, 2, 3, 4]
    assert history.undo_depth(steps, 2).count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF-1.4 /Type /Page /Type /Pages /CreationDate (D:20220630) /Encrypt 5 0 R")
    (tmp_path / "in" / "b.png").write_bytes(b"x")
    (tmp_path / "in" / "c.txt").write_bytes(b"x")
    files = documents.read_files(spark, str(tmp_path / "in"), content=True)
    assert sorted(r["kind"] for r in files.collect()) == ["image", "pdf"]
    marks = {r["is_pdf"]: r for r in documents.pdf_markers(files).collect()}
    assert marks[True]["encrypted"] and marks[True]["page_count"] == 1 and marks[True]["created"] == "2022-06-30 00:00"
    documents.write_texts(spark.createDataFrame([("d", "tekst")], "doc string, text string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()["value"].endswith("tekst")


def test_stream_scans_each_page_once(spark, tmp_path):
    schema = "page_uid long, text string"
    for k, ids in enumerate([(1, 2), (2, 3), (3, 1, 4)]):
        spark.createDataFrame([(i, f"t{i}") for i in ids], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = session.arriving(spark, str(tmp_path / "in"), schema)
    query = session.scan_stream(stream, lambda df: df.select("page_uid", F.length("text").alias("n")), str(tmp_path / "out"), str(tmp_path / "log"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert sorted(r["page_uid"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3, 4]


def test_find_text_and_selection(spark):
    from docveil.plans.anonymise import find_text

    df = spark.createDataFrame([("p", 0, 0.0, 0.0, 30.0, 10.0, "Anna", 0, 0), ("p", 1, 36.0, 0.0, 66.0, 10.0, "Ananas", 0, 0), ("q", 0, 0.0, 0.0, 9.0, 9.0, "x", 0, 0)], WORDS)
    got = sorted((r["start"], [tuple(x) for x in r["rects"]]) for r in find_text(df, "ana").collect())
    assert got == [(5, [(35.0, -1.0, 67.0, 11.0)]), (7, [(35.0, -1.0, 67.0, 11.0)])]
    box = spark.createDataFrame([("p", "s", (20.0, 5.0, 40.0, 6.0))], "page_uid string, selection_id string, r struct<x0:double,y0:double,x1:double,y1:double>")
    assert [len(r["rects"]) for r in words.words_in_selection(df, box).collect()] == [2]

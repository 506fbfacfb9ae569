"""Chapters, plain text and Markdown from page texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docveil.functions.matches import quoted
from docveil.functions.text import clean_markdown, demote_headings, strip_markdown, table_cells, xml_escape

FRAME_LINES = 4
#: File endings and names of output formats.
FORMATS = {"pdf": (".pdf", "PDF"), "md": (".md", "Markdown"), "epub": (".epub", "EPUB"), "txt": (".txt", "Text")}


def chapter_pages(chapters: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc, chapter, page): chapters' bounds clamped to the document; a last page of -1 means to the end."""
    n = F.col("page_count")
    end = F.least(F.when(F.col("last_page") < 0, n).otherwise(F.col("last_page")), n)
    start = F.greatest(F.col("first_page"), F.lit(0))
    index = F.filter(F.sequence(start, F.greatest(end - 1, start)), lambda k: k < F.col("__end"))
    return chapters.join(documents, "doc").withColumn("__end", end).select("doc", "chapter", "first_page", F.explode(index).alias("page"))


def chapter_bodies(pages: DataFrame, markdown: bool = True) -> DataFrame:
    """(doc, chapter, body, missing, had_text) from (doc, chapter, first_page, page, state, md, ocr).

    Text pages give their Markdown, scanned ones what OCR read, unreadable ones
    a visible placeholder; blank ones nothing. Parts are joined by empty lines in page order.
    """
    said = F.format_string("[Side %d indeholder ingen tekst der kunne udtrækkes]", F.col("page") - F.col("first_page") + 1)
    mark = F.concat(F.lit("> **"), said, F.lit("**")) if markdown else said
    ocr = F.nullif(F.trim(F.coalesce("ocr", F.lit(""))), F.lit(""))
    lost = (F.col("state") == "needs_ocr") & ocr.isNull()
    part = F.when(F.col("state") == "text", F.trim("md")).when(F.col("state") == "needs_ocr", F.coalesce(ocr, mark)).otherwise(F.lit(""))
    rows = pages.withColumn("part", part).withColumn("lost", lost).withColumn("text", (F.col("state") == "text") | ocr.isNotNull() & (F.col("state") == "needs_ocr"))
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.col("part") != "", F.struct("page", "part")))), lambda p: p["part"])
    return rows.groupBy("doc", "chapter").agg(F.array_join(ordered, "\n\n").alias("body"), F.sum(F.col("lost").cast("long")).alias("missing"), F.bool_or("text").alias("had_text"))


def summary_note(missing: Column) -> Column:
    return F.format_string("Bemærk: %d side(r) i dette dokument indeholder ingen tekst der kunne udtrækkes. De er markeret i teksten nedenfor.", missing)


def render(chapters: DataFrame, titles: DataFrame, fmt: str = "md") -> DataFrame:
    """(doc, text) from chapters (doc, chapter, title, body, missing, error) and titles (doc, doc_title).

    Several chapters get headings, and their own ones are demoted. Markdown
    ends with a line feed; plain text loses its marks and ends with CR LF.
    """
    many = F.count("*").over(Window.partitionBy("doc")) > 1
    rows = chapters.withColumn("many", many)
    if fmt == "md":
        own = F.when(F.col("many"), demote_headings(F.col("body"))).otherwise(F.col("body"))
        body = F.when(F.col("error").isNotNull(), F.concat(F.lit("> **"), F.col("error"), F.lit("**"))).otherwise(own)
        parts = F.array(F.when(F.col("many"), F.concat(F.lit("## "), F.col("title"))), F.nullif(body, F.lit("")))
    else:
        body = F.coalesce(F.col("error"), strip_markdown(F.col("body")))
        parts = F.array(F.when(F.col("many"), F.lit("")), F.when(F.col("many"), F.concat(F.lit("--- "), F.col("title"), F.lit(" ---"))), body)
    rows = rows.withColumn("parts", F.filter(parts, lambda p: p.isNotNull()))
    joined = rows.groupBy("doc").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chapter", "parts"))), lambda x: x["parts"])).alias("body"), F.sum("missing").alias("missing")).join(titles, "doc")
    note = F.when(F.col("missing") > 0, summary_note(F.col("missing")))
    title = F.nullif(F.col("doc_title"), F.lit(""))
    if fmt == "md":
        head = F.array(F.concat(F.lit("# "), title), F.concat(F.lit("> "), note))
        text = F.concat(F.btrim(F.array_join(F.concat(F.filter(head, lambda p: p.isNotNull()), "body"), "\n\n"), F.lit(" \t\r\n")), F.lit("\n"))
    else:
        head = F.array(title, F.when(title.isNotNull(), F.expr("repeat('=', length(doc_title))")), note)
        text = F.concat(F.btrim(F.array_join(F.concat(F.filter(head, lambda p: p.isNotNull()), "body"), "\n\n"), F.lit("\r\n")), F.lit("\r\n"))
    return joined.select("doc", text.alias("text"))


def can_write(bodies: DataFrame) -> DataFrame:
    """(doc, ok): some text, or chapters that are errors only."""
    return bodies.groupBy("doc").agg((F.bool_or("had_text") | F.bool_and(F.col("error").isNotNull())).alias("ok"))


def missing_pages(bodies: DataFrame) -> DataFrame:
    """(doc, chapter, missing), and with a null chapter the total."""
    return bodies.rollup("doc", "chapter").agg(F.sum("missing").alias("missing")).where("doc IS NOT NULL")


def drop_empty_tables(lines: DataFrame) -> DataFrame:
    """lines (page_uid, seq, text) without the runs of table rows of which no cell has content."""
    row = F.col("text").rlike(r"^\|.*\|$")
    filled = F.exists(table_cells(F.col("text")), lambda c: ~c.rlike(r"^[-:]*$") & ~c.rlike(r"^Col\d+$"))
    w = Window.partitionBy("page_uid").orderBy("seq")
    tagged = lines.withColumn("row", row).withColumn("full", row & filled)
    runs = tagged.withColumn("run", F.sum(F.when(F.col("row") & F.coalesce(F.lag("row").over(w), F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = F.max("full").over(Window.partitionBy("page_uid", "run"))
    return runs.withColumn("kept", ~F.col("row") | kept).where("kept").select("page_uid", "seq", "text")


def is_frame(rows: Column) -> Column:
    """A table (array of rows of cells) that is a frame: two columns or more, and a row of one cell with four lines of text."""
    lines = lambda c: F.size(F.filter(F.split(c, r"\r\n|\n|\r"), lambda x: F.trim(x) != ""))
    own = lambda r: F.filter(r, lambda c: c.isNotNull())
    return (F.array_max(F.transform(rows, lambda r: F.size(r))) >= 2) & F.exists(rows, lambda r: (F.size(own(r)) == 1) & (lines(F.element_at(own(r), 1)) >= FRAME_LINES))


#: Heights of a page that words and edges of tables are dealt by.
STRIP = 64.0


def swallowed_words(words: DataFrame, tables: DataFrame, band: float = 2.0) -> DataFrame:
    """(page_uid, table_id, cells, x0, x1, text): words that cross a table's top edge with their middle above it, in the lowest line of these.

    words: (page_uid, x0, y0, x1, y1, text); tables: (page_uid, table_id, box, cells array<struct<x0, x1>>). Words and edges meet by page and strip of STRIP, so a page's words
    are not held against all of its tables.
    """
    strips = F.sequence(F.floor(F.col("y0") / STRIP), F.floor(F.greatest("y0", "y1") / STRIP))
    dealt = words.where("y1 >= y0").withColumn("__strip", F.explode(strips))
    edges = tables.select("page_uid", "table_id", "box", "cells", F.floor(F.col("box.y0") / STRIP).alias("__strip"))
    inside = (F.col("y1") > F.col("box.y0")) & ((F.col("y0") + F.col("y1")) / 2 < F.col("box.y0")) & (F.col("x1") > F.col("box.x0")) & (F.col("x0") < F.col("box.x1"))
    crossing = dealt.join(edges, ["page_uid", "__strip"]).where(inside)
    lowest = F.max("y1").over(Window.partitionBy("page_uid", "table_id"))
    return crossing.withColumn("low", lowest).where(F.abs(F.col("y1") - F.col("low")) <= band).select("page_uid", "table_id", "cells", "x0", "x1", "text")


def table_headers(words: DataFrame, tables: DataFrame, band: float = 2.0) -> DataFrame:
    """(page_uid, table_id, header array<string>): the words that a table's top edge swallowed, by column.

    A word belongs to the first cell that its middle lies in, and to none where there is no cell; a table without any has no row.
    """
    mid = (F.col("x0") + F.col("x1")) / 2
    within = F.transform("cells", lambda c: c.isNotNull() & (mid >= c["x0"]) & (mid < c["x1"]))
    placed = swallowed_words(words, tables, band).withColumn("column", F.array_position(within, True))
    grouped = placed.where("column > 0").groupBy("page_uid", "table_id").agg(F.first("cells").alias("cells"), F.array_sort(F.collect_list(F.struct("x0", "text", "column"))).alias("w"))
    names = F.transform("cells", lambda c, k: F.array_join(F.transform(F.filter("w", lambda x: x["column"] == k + 1), lambda x: x["text"]), " "))
    return grouped.select("page_uid", "table_id", names.alias("header")).where(F.exists("header", lambda h: h != ""))


def without_frames(tables: DataFrame) -> DataFrame:
    """tables (..., rows) but for those that are frames around text."""
    return tables.where(~is_frame(F.col("rows")))


def table_row(cells: Column) -> Column:
    return F.concat(F.lit("|"), F.array_join(cells, "|"), F.lit("|"))


def restore_headers(texts: DataFrame, headers: DataFrame) -> DataFrame:
    """texts (page_uid, text) with the true headers of tables; the row that stood in their place comes below as data.

    headers: (page_uid, table_id, names, header): a table's header cells as they were extracted, null or empty where it has none, and the words found
    above it by column. The extracted row shows empty cells as Col1, Col2, ...
    """
    said = F.transform("names", lambda n: F.replace(F.coalesce(n, F.lit("")), F.lit("\n"), F.lit("<br>")))
    shown = F.transform(said, lambda n, k: F.when(n == "", F.concat(F.lit("Col"), k + 1)).otherwise(n))
    rule = table_row(F.transform("names", lambda n: F.lit("---")))
    rows = headers.select("page_uid", F.struct("table_id", table_row(shown).alias("old"), table_row(said).alias("data"), table_row(F.col("header")).alias("new"), rule.alias("rule")).alias("h"))
    listed = rows.groupBy("page_uid").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    line = F.lit("\n")

    def put(text: Column, h: Column) -> Column:
        parts = F.split(text, quoted(F.concat(line, h["old"], line, h["rule"], line)), F.lit(2))
        done = F.concat(parts[0], line, h["new"], line, h["rule"], line, h["data"], line, F.try_element_at(parts, F.lit(2)))
        return F.when((h["new"] != h["old"]) & (F.size(parts) == 2), done).otherwise(text)

    whole = F.aggregate("hs", F.concat(line, F.col("text"), line), put)
    fixed = F.substring(whole, F.lit(2), F.length(whole) - 2)
    return texts.join(listed, "page_uid", "left").withColumn("text", F.when(F.col("hs").isNull(), F.col("text")).otherwise(fixed)).drop("hs")


def page_markdown(texts: DataFrame, grids: DataFrame, contexts: DataFrame, headers: DataFrame) -> DataFrame:
    """(page_uid, text): a page's grid (page_uid, text) if it is set in one; else its Markdown with signs and headers restored, cleaned, without empty tables."""
    mended = restore_headers(restore_minus(texts, contexts), headers).select("page_uid", clean_markdown(F.col("text")).alias("text"))
    lines = mended.select("page_uid", F.posexplode(F.split("text", "\n", -1)).alias("seq", "text"))
    kept = drop_empty_tables(lines).groupBy("page_uid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n").alias("kept"))
    own = grids.select("page_uid", F.col("text").alias("grid"))
    return texts.select("page_uid").join(kept, "page_uid", "left").join(own, "page_uid", "left").select("page_uid", F.coalesce("grid", "kept", F.lit("")).alias("text"))


def xhtml_chapter(title: Column, body: Column, error: Column, many: Column, note: Column) -> Column:
    """A chapter as XHTML from its body's XHTML; an error stands in for the body, note is for the first chapter, else null."""
    marked = lambda t: F.concat(F.lit('<p class="missing"><strong>'), t, F.lit("</strong></p>"))
    head = F.when(many, F.concat(F.lit("<h2>"), xml_escape(title), F.lit("</h2>"))).otherwise(F.lit(""))
    shown = F.when(error.isNotNull(), marked(xml_escape(error))).otherwise(F.replace(F.replace(F.replace(body, F.lit("<blockquote>"), F.lit('<blockquote class="missing">')), F.lit("<pre><code>"), F.lit("<pre>")), F.lit("</code></pre>"), F.lit("</pre>")))
    start = F.concat(F.lit('<html xmlns="http://www.w3.org/1999/xhtml"><head><title>'), xml_escape(title), F.lit("</title></head><body>"))
    return F.concat(start, F.coalesce(marked(note), F.lit("")), head, shown, F.lit("</body></html>"))


def trailing_minus_contexts(words: DataFrame, most: int = 3) -> DataFrame:
    """(page_uid, context): amounts written with a minus behind, with as many words before as tell them from an unsigned twin.

    words: (page_uid, block, line, seq, text). An amount that has a twin even with most words is left alone.
    """
    w = Window.partitionBy("page_uid", "block", "line").orderBy("seq")
    base = words.withColumn("signed", F.col("text").rlike(r"\d[.,]\d+-$"))
    bare = base.withColumn("bare", F.when(F.col("signed"), F.regexp_replace("text", "-$", "")).otherwise(F.col("text")))
    tries = []
    for k in range(1, most + 1):
        parts = [F.lag("text", j).over(w) for j in range(k - 1, 0, -1)]
        whole = F.when(F.row_number().over(w) >= k, F.concat_ws(" ", *parts, F.col("bare")))
        tries.append(F.struct(F.lit(k).alias("k"), whole.alias("context")))
    rows = bare.withColumn("tries", F.array(*tries)).select("page_uid", "block", "line", "seq", "signed", "text", F.explode("tries").alias("t")).select("*", "t.*").where("context IS NOT NULL")
    twins = rows.where(~F.col("signed") & F.col("text").rlike(r"\d$")).select("page_uid", "k", "context").distinct()
    alone = rows.where("signed").join(twins, ["page_uid", "k", "context"], "left_anti")
    return alone.groupBy("page_uid", "block", "line", "seq").agg(F.min_by("context", "k").alias("context")).select("page_uid", "context").distinct()


def restore_minus(texts: DataFrame, contexts: DataFrame) -> DataFrame:
    """texts (page_uid, text) with the minus put back behind each context, the longest first."""
    quoted = F.regexp_replace("context", r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    pattern = F.concat(F.lit(r"(?<![\w.,])("), F.regexp_replace(quoted, " ", r"[ \\t]+"), F.lit(r")(?!-)"))
    listed = contexts.select("page_uid", F.struct((-F.length("context")).alias("n"), pattern.alias("p")).alias("c")).groupBy("page_uid").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    fixed = F.aggregate("cs", F.col("text"), lambda s, c: F.regexp_replace(s, c["p"], F.lit("$1-")))
    return texts.join(listed, "page_uid", "left").withColumn("text", F.when(F.col("cs").isNull(), F.col("text")).otherwise(fixed)).drop("cs")


def merge_plan(jobs: DataFrame, failed: DataFrame) -> DataFrame:
    """(doc, target_index, job, page, ok): pages of all jobs in order; a failed job gives one error page and is counted as a failure.

    jobs: (doc, job, n_pages); failed: (doc, job).
    """
    tagged = jobs.join(failed.select("doc", "job").withColumn("bad", F.lit(True)), ["doc", "job"], "left").withColumn("ok", F.col("bad").isNull())
    n = F.when(F.col("ok"), F.col("n_pages")).otherwise(1)
    pages = tagged.withColumn("n", n).where("n > 0").select("doc", "job", "ok", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("page"))
    w = Window.partitionBy("doc").orderBy("job", "page")
    return pages.withColumn("target_index", F.row_number().over(w) - 1)


def save_totals(plan: DataFrame) -> DataFrame:
    """(doc, n_ok, n_failed)."""
    each = plan.groupBy("doc", "job").agg(F.bool_and("ok").alias("ok"))
    return each.groupBy("doc").agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"))


def edit_stages(pages: DataFrame) -> DataFrame:
    """(model, uid, stage, what): edits in the order in which a save applies them: text edits, redactions, marks, rotation, crop."""
    kinds = {"edit": 0, "redact": 1}
    stage = F.lit(2)
    for kind, n in kinds.items():
        stage = F.when(F.col("a.kind") == kind, n).otherwise(stage)
    marks = pages.select("model", "uid", F.explode("annots").alias("a")).select("model", "uid", stage.alias("stage"), F.col("a.kind").alias("what"))
    turned = pages.where("rotation <> 0").select("model", "uid", F.lit(3).alias("stage"), F.lit("rotate").alias("what"))
    cut = pages.where("crop IS NOT NULL").select("model", "uid", F.lit(4).alias("stage"), F.lit("crop").alias("what"))
    return marks.unionByName(turned).unionByName(cut)


def common_ends(old: Column, new: Column) -> Column:
    """struct<prefix, suffix>: lengths of what both texts begin and end with, not overlapping."""
    least = F.least(F.length(old), F.length(new))

    def longest(most: Column, same) -> Column:
        return F.aggregate(F.sequence(F.lit(0), most), F.lit(0), lambda best, k: F.when((best == k - 1) & same(k), k).otherwise(best))

    prefix = longest(least, lambda k: F.substring(old, F.lit(1), k) == F.substring(new, F.lit(1), k))
    suffix = longest(least - prefix, lambda k: F.right(old, k) == F.right(new, k))
    return F.struct(prefix.alias("prefix"), suffix.alias("suffix"))


def fallback_code(name: Column, flags: Column) -> Column:
    """A base font's code from hints in the name, then from flags (1 fixed pitch, 2 serif, 4 italic, 8 bold)."""
    low = F.lower(name)
    fixed = low.rlike("cour|mono|consol") | (flags.bitwiseAND(1) != 0)
    serif = low.rlike("times|serif|roman|georgia|garamond") & ~low.contains("sans") | (flags.bitwiseAND(2) != 0)
    bold = low.rlike("bold|black|heavy") | (flags.bitwiseAND(8) != 0)
    slant = low.rlike("ital|obliq") | (flags.bitwiseAND(4) != 0)
    family = F.when(fixed, "co").when(serif, "ti").otherwise("he")
    plain = F.when(fixed, "cour").when(serif, "tiro").otherwise("helv")
    return F.when(bold & slant, F.concat(family, F.lit("bi"))).when(bold, F.concat(family, F.lit("bo"))).when(slant, F.concat(family, F.lit("it"))).otherwise(plain)


def format_extension(fmt: Column) -> Column:
    out = F.lit(None).cast("string")
    for key, (ending, _) in FORMATS.items():
        out = F.when(fmt == key, ending).otherwise(out)
    return out


def format_label(fmt: Column) -> Column:
    out = F.lit(None).cast("string")
    for key, (_, label) in FORMATS.items():
        out = F.when(fmt == key, label).otherwise(out)
    return out

"""Word boxes to text, and spans of text back to rectangles.

Words: (page_uid, seq, x0, y0, x1, y1, text, block, line); seq is the reading order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docveil.functions import geometry as G
from docveil.functions.matches import let

# Least visible characters of a native text layer, and of a monospaced page.
LEAST_NATIVE = 20
#: Score at which an orientation is good enough (fixed value).
GOOD_ENOUGH = 400


def column_gap(a: Column, b: Column) -> Column:
    """Is the gap between two words wider than some of their characters? It is measured along the longer gap's axis."""
    dx = F.greatest(b["x0"] - a["x1"], a["x0"] - b["x1"])
    dy = F.greatest(b["y0"] - a["y1"], a["y0"] - b["y1"])

    def wide(gap: Column, low: str, high: str) -> Column:
        width = lambda w: (w[high] - w[low]) / F.greatest(F.lit(1), F.length(w["text"]))
        char = (width(a) + width(b)) / 2
        return (gap > G.COLUMN_GAP_CHARS * char) & (char > 0)

    return F.when(dx >= dy, wide(dx, "x0", "x1")).otherwise(wide(dy, "y0", "y1"))


def _column_gap() -> Column:
    fields = ("x0", "y0", "x1", "y1", "text")
    return column_gap(F.struct(*(F.col(f"p_{c}").alias(c) for c in fields)), F.struct(*fields))


def _with_previous(words: DataFrame, order: str = "seq") -> DataFrame:
    w = Window.partitionBy("page_uid").orderBy(order)
    names = [c for c in ("x0", "y0", "x1", "y1", "text", "block", "line") if c in words.columns]
    return words.withColumns({f"p_{c}": F.lag(c).over(w) for c in names})


def word_offsets(words: DataFrame) -> DataFrame:
    """Words with text, with sep before them and half-open offsets in the page's text.

    A new block gives an empty line, a new line or column a line break.
    """
    linked = _with_previous(words.where(F.coalesce(F.col("text"), F.lit("")) != ""))
    sep = (
        F.when(F.col("p_text").isNull(), "")
        .when(F.col("block") != F.col("p_block"), "\n\n")
        .when((F.col("line") != F.col("p_line")) | _column_gap(), "\n")
        .otherwise(" ")
    )
    running = Window.partitionBy("page_uid").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    placed = linked.withColumn("sep", sep).withColumn("end", F.sum(F.length("sep") + F.length("text")).over(running).cast("int"))
    return placed.withColumn("start", (F.col("end") - F.length("text")).cast("int")).drop(*(c for c in placed.columns if c.startswith("p_")))


def listed_text(listed: Column) -> Column:
    """The text of one page, whose words with their boxes are listed in reading order; those without text are passed over."""

    def part(before: Column, own: Column) -> Column:
        sep = F.when(before.isNull(), "").when(own["block"] != before["block"], "\n\n").when((own["line"] != before["line"]) | column_gap(before, own), "\n").otherwise(" ")
        return F.concat(sep, own["text"])

    said = F.filter(listed, lambda w: w["text"] != "")
    # One behind the other: the word before each, of which the first has none.
    return let(said, lambda w: F.array_join(F.zip_with(F.concat(F.slice(w, F.lit(1), F.lit(0)), F.array(F.lit(None)), F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0)))), w, part), ""))


def words_to_text(words: DataFrame) -> DataFrame:
    """(page_uid, text): the texts that word_offsets() places, from one array of a page's words, without a window."""
    names = ["seq", "x0", "y0", "x1", "y1", "text", "block", "line"]
    listed = words.where(F.coalesce(F.col("text"), F.lit("")) != "").groupBy("page_uid").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("w"))
    return listed.select("page_uid", listed_text(F.col("w")).alias("text"))


def words_for_spans(offsets: DataFrame, spans: DataFrame) -> DataFrame:
    """Words that the spans (page_uid, span_id, start, end) touch."""
    s = spans.select("page_uid", "span_id", F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    return offsets.join(s, "page_uid").where("start < s_end AND end > s_start")


def rects_for_spans(offsets: DataFrame, spans: DataFrame, pad: float = G.PAD) -> DataFrame:
    """(page_uid, span_id, rects): one padded rectangle for each line and column part of a span; far ones are dropped."""
    hit = words_for_spans(offsets, spans)
    w = Window.partitionBy("page_uid", "span_id").orderBy("seq")
    names = ("x0", "y0", "x1", "y1", "text", "block", "line")
    linked = hit.withColumns({f"p_{c}": F.lag(c).over(w) for c in names})
    opens = F.col("p_text").isNull() | (F.col("block") != F.col("p_block")) | (F.col("line") != F.col("p_line")) | _column_gap()
    numbered = linked.withColumn("g", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    boxes = numbered.groupBy("page_uid", "span_id", "g").agg(G.rect(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).alias("r"))
    listed = boxes.groupBy("page_uid", "span_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "r"))), lambda x: x["r"]).alias("raw"))
    grown = F.transform(G.drop_outliers(F.col("raw")), lambda r: G.rect(r["x0"] - pad, r["y0"] - pad, r["x1"] + pad, r["y1"] + pad))
    return listed.select("page_uid", "span_id", grown.alias("rects"))


def words_in_selection(words: DataFrame, selections: DataFrame) -> DataFrame:
    """(page_uid, selection_id, rects): boxes of the words that a selected rectangle r meets, in reading order."""
    hit = words.join(selections, "page_uid").where(G.overlaps(F.struct("x0", "y0", "x1", "y1"), F.col("r")))
    boxes = F.array_sort(F.collect_list(F.struct("seq", G.rect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("r"))))
    return hit.groupBy("page_uid", "selection_id").agg(F.transform(boxes, lambda b: b["r"]).alias("rects"))


def clip_to_words(rects: DataFrame, words: DataFrame, eps: float = 0.05, band: float = 0.25) -> DataFrame:
    """(page_uid, rect_id, r): each rectangle freed of the foreign words it touches.

    A foreign word whose centre lies beside the rectangle's own words in one axis cuts
    that axis at its edge; of both, the axis that loses the smaller share. Where nothing is left, a
    narrow band around the middle stays. rects: (page_uid, rect_id, r, own array<seq>).
    """
    own = rects.select("page_uid", "rect_id", F.explode("own").alias("seq")).join(words, ["page_uid", "seq"]).groupBy("page_uid", "rect_id").agg(G.rect(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).alias("core"))
    near = rects.join(own, ["page_uid", "rect_id"]).join(words, "page_uid").where(~F.array_contains("own", F.col("seq")) & G.overlaps(F.col("r"), F.struct("x0", "y0", "x1", "y1")))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    in_x = (cx > F.col("core.x0")) & (cx < F.col("core.x1"))
    in_y = (cy > F.col("core.y0")) & (cy < F.col("core.y1"))
    lose_x = F.least(F.abs(F.col("r.x1") - F.col("x0")), F.abs(F.col("x1") - F.col("r.x0"))) / (F.col("r.x1") - F.col("r.x0"))
    lose_y = F.least(F.abs(F.col("r.y1") - F.col("y0")), F.abs(F.col("y1") - F.col("r.y0"))) / (F.col("r.y1") - F.col("r.y0"))
    cut_y = (in_x & ~in_y) | (in_x == in_y) & (lose_y <= lose_x)
    mid_x, mid_y = (F.col("core.x0") + F.col("core.x1")) / 2, (F.col("core.y0") + F.col("core.y1")) / 2
    bounds = near.groupBy("page_uid", "rect_id").agg(
        F.max(F.when(cut_y & (cy < mid_y), F.col("y1") + eps)).alias("ly"), F.min(F.when(cut_y & (cy >= mid_y), F.col("y0") - eps)).alias("hy"),
        F.max(F.when(~cut_y & (cx < mid_x), F.col("x1") + eps)).alias("lx"), F.min(F.when(~cut_y & (cx >= mid_x), F.col("x0") - eps)).alias("hx"),
    )
    joined = rects.join(bounds, ["page_uid", "rect_id"], "left")
    low = {a: F.greatest(F.col(f"r.{a}0"), F.coalesce(f"l{a}", F.col(f"r.{a}0"))) for a in "xy"}
    high = {a: F.least(F.col(f"r.{a}1"), F.coalesce(f"h{a}", F.col(f"r.{a}1"))) for a in "xy"}
    mid = {a: (F.col(f"r.{a}0") + F.col(f"r.{a}1")) / 2 for a in "xy"}
    edge = lambda a, side, sign: F.when(low[a] >= high[a], mid[a] + sign * band).otherwise(side[a])
    return joined.select("page_uid", "rect_id", G.rect(edge("x", low, -1), edge("y", low, -1), edge("x", high, 1), edge("y", high, 1)).alias("r"))


def visual_lines(words: DataFrame) -> DataFrame:
    """Words with v_line: sorted by middle and left edge, a word joins the line that it overlaps by over half the lower height.

    The line's box grows with its words, so each page is folded in order;
    a page's words are one array.
    """
    row = F.struct(((F.col("y0") + F.col("y1")) / 2).alias("cy"), "x0", "seq", "y0", "y1")
    start = F.struct(F.lit(-1).alias("n"), F.lit(0.0).alias("top"), F.lit(0.0).alias("bottom"), F.array().cast("array<struct<seq:bigint,v_line:int>>").alias("out"))

    def step(acc: Column, w: Column) -> Column:
        shared = F.least(acc["bottom"], w["y1"]) - F.greatest(acc["top"], w["y0"])
        same = (acc["n"] >= 0) & (shared > 0.5 * F.least(acc["bottom"] - acc["top"], w["y1"] - w["y0"]))
        n = F.when(same, acc["n"]).otherwise(acc["n"] + 1)
        top = F.when(same, F.least(acc["top"], w["y0"])).otherwise(w["y0"])
        bottom = F.when(same, F.greatest(acc["bottom"], w["y1"])).otherwise(w["y1"])
        put = F.struct(w["seq"].cast("bigint").alias("seq"), n.alias("v_line"))
        return F.struct(n.alias("n"), top.cast("double").alias("top"), bottom.cast("double").alias("bottom"), F.concat(acc["out"], F.array(put)).alias("out"))

    lines = words.groupBy("page_uid").agg(F.array_sort(F.collect_list(row)).alias("w")).select("page_uid", F.explode(F.aggregate("w", start, step, lambda a: a["out"])).alias("o")).select("page_uid", "o.*")
    return words.join(lines, ["page_uid", "seq"])


def line_runs(lines: DataFrame, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """Words from (line, place) first to last in reading order: the rest of the first line, whole lines, the start of the last."""
    w = Window.partitionBy("page_uid", "v_line").orderBy("x0", "seq")
    at = F.struct(F.col("v_line"), F.row_number().over(w) - 1)
    low, high = (F.struct(F.lit(a), F.lit(b)) for a, b in sorted((first, last)))
    return lines.withColumn("at", at).where((F.col("at") >= low) & (F.col("at") <= high)).drop("at")


def baseline_rows(chars: DataFrame) -> DataFrame:
    """Characters (page_uid, seq, y, size) with row: a new one where y exceeds the row's first y by over a third of the size."""
    start = F.struct(F.lit(-1).alias("n"), F.lit(0.0).alias("y"), F.array().cast("array<struct<seq:bigint,row:int>>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        new = (acc["n"] < 0) | (c["y"] - acc["y"] > c["size"] / 3)
        n = F.when(new, acc["n"] + 1).otherwise(acc["n"])
        put = F.struct(c["seq"].cast("bigint").alias("seq"), n.alias("row"))
        return F.struct(n.alias("n"), F.when(new, c["y"]).otherwise(acc["y"]).cast("double").alias("y"), F.concat(acc["out"], F.array(put)).alias("out"))

    rows = chars.groupBy("page_uid").agg(F.array_sort(F.collect_list(F.struct("y", "seq", "size"))).alias("c")).select("page_uid", F.explode(F.aggregate("c", start, step, lambda a: a["out"])).alias("o")).select("page_uid", "o.*")
    return chars.join(rows, ["page_uid", "seq"])


def page_state(has_text: Column, has_visuals: Column, failed: Column) -> Column:
    """text, needs_ocr or blank; a page that can't be read needs OCR."""
    return F.when(failed, "needs_ocr").when(has_text, "text").when(has_visuals, "needs_ocr").otherwise("blank")


def needs_ocr(native_chars: Column, has_visuals: Column, failed: Column) -> Column:
    """Few native characters beside visual content; an unreadable page does not. Differs from page_state() on purpose."""
    return F.when(failed, False).otherwise((native_chars < LEAST_NATIVE) & has_visuals)


def choose_words(native: DataFrame, ocr: DataFrame, allow_ocr: bool = True) -> DataFrame:
    """Each page's native words if they have enough characters, else those of OCR if there are any, else the native ones; with used_ocr."""
    size = native.groupBy("page_uid").agg(F.sum(F.length(F.trim("text"))).alias("n"))
    there = ocr.select("page_uid").distinct().withColumn("read", F.lit(allow_ocr))
    pages = native.select("page_uid").union(ocr.select("page_uid")).distinct()
    use = pages.join(size, "page_uid", "left").join(there, "page_uid", "left").select("page_uid", ((F.coalesce("n", F.lit(0)) < LEAST_NATIVE) & F.coalesce("read", F.lit(False))).alias("used_ocr"))
    return native.join(use, "page_uid").where("NOT used_ocr").unionByName(ocr.join(use, "page_uid").where("used_ocr"))


def page_text(markdown: Column, native: Column, ocr: Column) -> Column:
    """struct<text, used_ocr>: Markdown, else native words, else OCR."""
    m, n = F.nullif(F.trim(markdown), F.lit("")), F.nullif(F.trim(native), F.lit(""))
    return F.struct(F.coalesce(m, n, ocr, F.lit("")).alias("text"), (m.isNull() & n.isNull() & ocr.isNotNull()).alias("used_ocr"))


def text_layer_visible(chars: DataFrame) -> DataFrame:
    """(page_uid, visible): more characters are seen than hidden (render type 3 or no opacity)."""
    hidden = (F.col("render_type") == 3) | (F.col("opacity") == 0)
    n = F.sum(F.when(hidden, 0).otherwise(F.col("n_chars")))
    return chars.groupBy("page_uid").agg((n > F.sum(F.when(hidden, F.col("n_chars")).otherwise(0))).alias("visible"))


def orientation_score(words: DataFrame) -> DataFrame:
    """(page_uid, degrees, score): squared lengths of well-formed tokens of three letters or more."""
    token = F.regexp_replace("text", r"^[\p{Punct}]+|[\p{Punct}]+$", "")
    formed = (F.length(token) >= 3) & token.rlike(r"^(?:\p{Lu}?\p{Ll}+|\p{Lu}+)$")
    return words.groupBy("page_uid", "degrees").agg(F.sum(F.when(formed, F.length(token) * F.length(token)).otherwise(0)).cast("long").alias("score"))


def best_orientation(scores: DataFrame, tried: list[int]) -> DataFrame:
    """(page_uid, degrees): the first that is good enough in the order tried, else the best, the first of equals; none if all are zero."""
    order = F.lit(len(tried))
    for k, d in reversed(list(enumerate(tried))):
        order = F.when(F.col("degrees") == d, k).otherwise(order)
    ranked = scores.withColumn("k", order)
    early = F.min_by(F.when(F.col("score") >= GOOD_ENOUGH, F.col("degrees")), F.when(F.col("score") >= GOOD_ENOUGH, F.col("k")))
    best = F.min_by("degrees", F.struct(-F.col("score"), F.col("k")))
    return ranked.groupBy("page_uid").agg(F.coalesce(early, best).alias("degrees"), F.max("score").alias("top")).where("top > 0").drop("top")


def monospace_share(chars: DataFrame) -> DataFrame:
    """(page_uid, monospaced): nine in ten of at least twenty visible characters are."""
    n = F.sum(F.when(F.trim("c") != "", 1).otherwise(0))
    mono = F.sum(F.when((F.trim("c") != "") & F.col("mono"), 1).otherwise(0))
    return chars.groupBy("page_uid").agg(((n >= LEAST_NATIVE) & (mono >= 0.9 * n)).alias("monospaced"))


def upper_medians(rows: DataFrame, value: str) -> DataFrame:
    """(page_uid, median): the middle of the sorted values, the greater of two."""
    return rows.groupBy("page_uid").agg(G.upper_median(F.collect_list(value)).alias("median"))


def monospace_grid(chars: DataFrame) -> DataFrame:
    """(page_uid, text): characters (page_uid, seq, c, x, y, w, size) set in columns by their place, in a fence.

    An empty line stands where the pitch of rows is exceeded by over four fifths.
    """
    placed = baseline_rows(chars)
    width = placed.groupBy("page_uid").agg(G.upper_median(F.collect_list("w")).alias("cw"), F.min("x").alias("xmin"))
    cells = placed.join(width, "page_uid").withColumn("col", F.round((F.col("x") - F.col("xmin")) / F.col("cw")).cast("int"))
    line = F.aggregate(
        F.array_sort(F.collect_list(F.struct("col", "seq", "c"))), F.lit(""), lambda s, x: F.concat(F.when(F.length(s) < x["col"], F.rpad(s, x["col"], " ")).otherwise(s), x["c"])
    )
    rows = cells.groupBy("page_uid", "row").agg(F.min("y").alias("y"), F.rtrim(line).alias("line"))
    w = Window.partitionBy("page_uid").orderBy("row")
    gaps = rows.withColumn("gap", F.col("y") - F.lag("y").over(w))
    pitch = gaps.where("gap IS NOT NULL").groupBy("page_uid").agg(G.upper_median(F.collect_list("gap")).alias("pitch"))
    wide = F.coalesce(F.col("gap") > 1.8 * F.col("pitch"), F.lit(False))
    lines = gaps.join(pitch, "page_uid", "left").select("page_uid", "row", F.concat(F.when(wide, F.lit("\n")).otherwise(F.lit("")), F.col("line")).alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("page_uid").agg(F.concat(F.lit("```\n"), body, F.lit("\n```")).alias("text"))


def dominant_style(lines: DataFrame) -> DataFrame:
    """(line_id, style): the most used, of equals the first."""
    used = lines.groupBy("line_id", "style").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return used.groupBy("line_id").agg(F.min_by("style", F.struct(-F.col("n"), F.col("first"), F.col("style"))).alias("style"))


def _to_middle() -> Column:
    return F.abs((F.col("y0") + F.col("y1")) / 2 - F.col("y"))


def _best_line(points: DataFrame, lines: DataFrame, hit: Column | None, rank: Column) -> DataFrame:
    """(page_uid, point_id, line_id): of the lines of a point's page that it hits the one of the least rank, the first of equals.

    What a line is to a point depends on their places alone, so each place of a page's points meets each box of its lines once, and the boxes' first lines stand for them.
    """
    places, boxes = ["page_uid", "x", "y"], ["page_uid", "x0", "y0", "x1", "y1"]
    first = lines.groupBy(*boxes).agg(F.min("line_id").alias("line_id"))
    met = points.select(*places).distinct().join(first, "page_uid")
    best = (met if hit is None else met.where(hit)).groupBy(*places).agg(F.min(F.struct(rank.alias("rank"), "line_id")).alias("best")).toDF(*(f"__{c}" for c in places), "best")
    own = (F.col("page_uid") == F.col("__page_uid")) & F.col("x").eqNullSafe(F.col("__x")) & F.col("y").eqNullSafe(F.col("__y"))
    return points.join(best, own).groupBy("page_uid", "point_id").agg(F.min("best")["line_id"].alias("line_id"))


def nearest_line(points: DataFrame, lines: DataFrame) -> DataFrame:
    """(page_uid, point_id, line_id): the line whose middle is the nearest in height, with a quarter of the distance beside it; the first of equals."""
    aside = F.greatest(F.col("x0") - F.col("x"), F.col("x") - F.col("x1"), F.lit(0.0))
    return _best_line(points, lines, None, _to_middle() + 0.25 * aside)


def line_at(points: DataFrame, lines: DataFrame, pad: float = 1.5) -> DataFrame:
    """(page_uid, point_id, line_id): the line whose padded box holds the point, of several the one with the nearest middle; no row if none does."""
    hit = F.col("x").between(F.col("x0") - pad, F.col("x1") + pad) & F.col("y").between(F.col("y0") - pad, F.col("y1") + pad)
    return _best_line(points, lines, hit, _to_middle())

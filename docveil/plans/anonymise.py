"""The two whole flows: redaction items, and pseudonymised texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docveil.functions.geometry import overlaps
from docveil.operators.detect import RULES, Rule, detect, plausible_names, search_occurrences
from docveil.operators.lang import is_prose, looks_english, word_score
from docveil.operators.names import case_counts, name_evidence, word_evidence
from docveil.operators.resolve import assign_pseudonyms, findings, group_findings, propagate_names, redaction_items, render
from docveil.operators.tagger import Model, tag_names, train
from docveil.operators.words import clip_to_words, rects_for_spans, word_offsets, words_for_spans, words_to_text
from docveil.shared import materialize


def pseudonymise(pages: DataFrame, codes: DataFrame | None = None, names: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(texts, pseudonyms) of pages (page_uid, pos, label, text): spans, keys, groups, numbers, and the texts with labels put in."""
    found = materialize(findings(detect(pages, codes, names, rules, context=True), pages, names is not None), "findings")
    if names is not None:
        found = materialize(found.unionByName(findings(propagate_names(pages, found), pages)), "findings")
    labels = assign_pseudonyms(group_findings(found))
    return render(pages, found, labels), labels


def find_names(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """Spans of names in pages(page_uid, text) by a model, trained on the same pages if none is given, but for those that the corpus's own use of their words speaks against."""
    found = materialize(tag_names(pages, model or train(pages)), "names")
    told = name_evidence(found, pages, word_evidence(case_counts(pages)))
    return plausible_names(told, pages).select(*found.columns)


def redact(words: DataFrame, labels: DataFrame, existing: DataFrame, decisions: DataFrame, codes: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """Items to redact from word boxes: text, spans, keys, rectangles, earlier decisions, and no second mark over an old one.

    labels: (page_uid, pos, label); existing: (page_uid, kind, source, rects); decisions: (key, selected).
    """
    pages = words_to_text(words).join(labels, "page_uid")
    found = findings(detect(pages, codes, names, context=True), pages, names is not None)
    spans = found.select("page_uid", F.col("uid").alias("span_id"), "start", "end")
    boxes = rects_for_spans(word_offsets(words), spans).withColumnRenamed("span_id", "uid")
    placed = found.join(boxes, ["page_uid", "uid"]).join(decisions, "key", "left").withColumn("selected", F.coalesce("selected", F.lit(True)))
    return redaction_items(placed, existing)


def find_text(words: DataFrame, query: str, clip: bool = False) -> DataFrame:
    """(page_uid, start, end, rects): where a query stands on the pages; pages without it give no row.

    With clip, which is for pages whose text layer is what is seen, rectangles are freed of other words' boxes.
    """
    offsets = word_offsets(words)
    hits = search_occurrences(words_to_text(words), query)
    spans = hits.withColumn("span_id", F.concat_ws(":", "start", "end"))
    boxes = rects_for_spans(offsets, spans)
    if clip:
        each = boxes.select("page_uid", "span_id", F.posexplode("rects").alias("k", "r")).withColumn("rect_id", F.concat_ws("/", "span_id", "k"))
        own = words_for_spans(offsets, spans).select("page_uid", "span_id", "seq", F.struct("x0", "y0", "x1", "y1").alias("b"))
        held = each.join(own, ["page_uid", "span_id"]).where(overlaps(F.col("r"), F.col("b"))).groupBy("page_uid", "span_id", "k", "rect_id", "r").agg(F.collect_list("seq").alias("own"))
        freed = clip_to_words(held, words).join(held.select("page_uid", "rect_id", "span_id", "k"), ["page_uid", "rect_id"])
        boxes = freed.groupBy("page_uid", "span_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "r"))), lambda x: x["r"]).alias("rects"))
    return spans.join(boxes, ["page_uid", "span_id"]).drop("span_id")


def scan_counters(pages: DataFrame) -> DataFrame:
    """(n_pages, n_with_text, n_ocr, n_failed, n_english, n_prose) of pages (text, ocr, failed)."""
    s = word_score(F.col("text"))
    scored = pages.withColumn("s", s)
    return scored.agg(
        F.count("*").alias("n_pages"), F.count_if(F.trim("text") != "").alias("n_with_text"), F.count_if("ocr").alias("n_ocr"), F.count_if("failed").alias("n_failed"),
        F.count_if(looks_english(F.col("s"))).alias("n_english"), F.count_if(is_prose(F.col("s"))).alias("n_prose"),
    )

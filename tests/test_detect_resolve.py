"""Detection, resolution, dates and scalar functions on small tables."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from docveil.functions import text as T
from docveil.functions.matches import group_spans, spans, starts
from docveil.operators import dates as D
from docveil.operators import detect, resolve
from docveil.plans.anonymise import pseudonymise

PAGES = [
    ("a", 0, "A 1", "Mit cpr er 010190-0002, tlf. 20304050 og bor Nørregade 12, 2. tv, 8500 Grenaa Hun sagde. 2025 Tiludbetaling. j.nr.: 2024-0012345. Mail x.y@a.dk, CVR 12345674, kort 4111 1111 1111 1111, BS-123/2020. Tal 300290-1234 og 12345675."),
    ("b", 1, "A 2", "Advokat Jens Hansen og tiltalte Hans Olsen.\nJensHansen kom, og olsen gik."),
    ("c", 2, "A 3", ""),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_uid string, pos int, label string, text string").cache()


@pytest.fixture(scope="module")
def codes(spark):
    return spark.createDataFrame([(8500, "Grenaa"), (8340, "Malling"), (1550, "København V")], "code int, city string")


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([("b", "PERSON", 8, 19, "Jens Hansen", 0.85), ("b", "PERSON", 32, 42, "Hans Olsen", 0.85)], "page_uid string, entity string, start int, end int, value string, score double")


def test_spans_slice_back(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ab1 é😀2") for _ in range(30)) for _ in range(50)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", spans(F.col("t"), "[a-b]+1?").alias("s"), starts(F.col("t"), F.lit("aa")).alias("o"), group_spans(F.col("t"), "a(b+)", 1).alias("g"))
    import re

    for r in df.collect():
        t = r["t"] or ""
        assert [(s["start"], s["end"], s["value"]) for s in r["s"]] == [(m.start(), m.end(), m.group()) for m in re.finditer("[a-b]+1?", t)]
        assert r["o"] == [m.start() for m in re.finditer("a(?=a)", t)]
        assert [(s["start"], s["end"]) for s in r["g"]] == [m.span(1) for m in re.finditer("a(b+)", t)]


def test_detect(pages, codes, names):
    found = detect.detect(pages, codes, names).collect()
    texts = {p[0]: p[3] for p in PAGES}
    by = {(r["entity"], r["value"]) for r in found}
    assert {
        ("DK_CPR", "010190-0002"), ("DK_PHONE", "20304050"), ("DK_ADDRESS", "Nørregade 12, 2. tv"), ("DK_POSTAL_CITY", "8500 Grenaa"), ("DK_CASE_NO", "2024-0012345"), ("EMAIL_ADDRESS", "x.y@a.dk"),
        ("DK_CVR", "12345674"), ("CREDIT_CARD", "4111 1111 1111 1111"), ("DK_CASE_NO", "BS-123/2020"), ("PERSON", "Jens Hansen"), ("PERSON", "Hans Olsen"),
    } == by
    for r in found:
        assert texts[r["page_uid"]][r["start"] : r["end"]] == r["value"]
    for a in found:
        assert not any(a is not b and a["page_uid"] == b["page_uid"] and a["start"] < b["end"] and b["start"] < a["end"] for b in found)


def test_loose_numbers_only_on_scanned_pages(spark):
    p = spark.createDataFrame([("a", "nr 300290 12 34 x", True), ("b", "nr 300290 12 34 x", False)], "page_uid string, text string, ocr boolean")
    assert [(r["page_uid"], r["entity"]) for r in detect.detect(p, ocr="ocr").collect()] == [("a", "DK_CPR_MULIG")]


def test_empty_tables(spark, pages, codes):
    assert detect.detect(pages.limit(0), codes).count() == 0
    assert resolve.group_findings(resolve.findings(detect.detect(pages.limit(0)), pages)).count() == 0


def test_pseudonyms_and_propagation(pages, codes, names):
    texts, labels = pseudonymise(pages, codes, names)
    said = {r["page_uid"]: r["rendered"] for r in texts.collect()}
    assert said["b"] == "Advokat Advokat 1 og tiltalte Person 1.\nAdvokat 1 kom, og Person 1 gik."
    assert "010190" not in said["a"] and "CPR-nummer 1" in said["a"] and said["c"] == ""
    assert {r["label"] for r in labels.collect()} >= {"Advokat 1", "Person 1", "E-mail 1"}
    doc = resolve.render_document(texts.withColumn("doc", F.lit(1))).first()["text"]
    assert doc.startswith("===== A 1 =====\n\nMit cpr") and doc.endswith("=====\n")


def test_groups(spark):
    rows = [("p", (0, k), "PERSON", "jensen", v, h) for k, (v, h) in enumerate([("Jensen", ""), ("Advokat Jensen", "advokat"), ("JENSEN", "tiltalte"), ("Jensen  ", "")])] + [("q", (1, 0), "EMAIL_ADDRESS", "a@b.c", "A@b.c", "")]
    found = spark.createDataFrame(rows, "page_uid string, pos struct<a:int,b:int>, entity string, key string, value string, role_hint string")
    got = {r["key"]: (r["n"], r["display"], r["role_hint"]) for r in resolve.group_findings(found).collect()}
    assert got == {"jensen": (4, "Jensen", "blandet"), "a@b.c": (1, "A@b.c", "")}


def test_splice(spark):
    edits = [(0, 3, "X"), (2, 5, "Y"), (5, 6, "Z"), (0, 2, "W")]
    df = spark.createDataFrame([("abcdefg", edits)], "t string, e array<struct<start:int,end:int,label:string>>")
    assert df.select(resolve.splice(F.col("t"), F.col("e"))).first()[0] == "XdeZg"


def test_merge_duplicates(spark):
    s = "struct<entity:string,start:int,end:int,score:double>"
    cases = [
        ([("P", 0, 20, 0.9), ("P", 8, 20, 0.9)], [("P", 8, 20, 0.9)]),
        ([("P", 0, 5, 0.5), ("P", 0, 9, 0.9)], [("P", 0, 9, 0.9)]),
        ([("P", 0, 5, 0.5), ("L", 0, 9, 0.9)], [("L", 0, 9, 0.9), ("P", 0, 5, 0.5)]),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], f"s array<{s}>")
    assert [[tuple(x) for x in r[0]] for r in df.select(detect.merge_duplicates(F.col("s"))).collect()] == [c[1] for c in cases]


def test_redaction_items(spark):
    rect = "array<struct<x0:double,y0:double,x1:double,y1:double>>"
    found = spark.createDataFrame([("p", "u1", True, [(0.0, 0.0, 9.0, 9.0)]), ("p", "u2", True, [(20.0, 0.0, 29.0, 9.0)]), ("p", "u3", False, [(0.0, 0.0, 1.0, 1.0)])], f"page_uid string, uid string, selected boolean, rects {rect}")
    old = spark.createDataFrame([("p", "redact", "search", [(0.5, 0.5, 9.0, 9.0)])], f"page_uid string, kind string, source string, rects {rect}")
    assert [r["uid"] for r in resolve.redaction_items(found, old).collect()] == ["u2"]


@pytest.mark.parametrize(
    "names,want",
    [
        (["30062022.pdf", "01062022.pdf"], ["2022-06-30", "2022-06-01"]), (["2022-06-30 x"], ["2022-06-30"]), (["30. juni 2022"], ["2022-06-30"]), (["June 30, 2022"], ["2022-06-30"]), (["062022", "072022"], ["2022-06-01", "2022-07-01"]),
        (["Relevé des comptes 2022"], [None]), (["kunde 99999999 31.12.21"], ["2021-12-31"]), (["31-12-2021", "30-11-2021", "04052022"], ["2021-12-31", "2021-11-30", "2022-05-04"]), (["12-31-2021", "11-30-2021", "04052022"], ["2021-12-31", "2021-11-30", "2022-04-05"]), (["2022 Août"], ["2022-08-01"]),
    ],
)
def test_dates(spark, names, want):
    got = D.date_names(spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, name string"), datetime.date(2026, 1, 1)).orderBy("k").collect()
    assert [r["date"] and str(r["date"]) for r in got] == want


def test_marks(spark):
    rule = D.rule_from_marks("Faktura 3. juni 2022 x", {"d": (8, 9), "m": (11, 15), "y": (16, 20)})
    df = spark.createDataFrame([("Faktura 14. maj 2021",), ("Faktura 2021",)], "name string")
    assert [r[0] and str(r[0]) for r in df.select(D.parse_rule(F.col("name"), rule, datetime.date(2026, 1, 1))).collect()] == ["2021-05-14", None]
    for marks, code in (({"y": (0, 1)}, "missing"), ({"y": (0, 3), "m": (4, 6)}, "year"), ({"y": (16, 20), "m": (18, 20)}, "overlap"), ({"y": (16, 20), "m": (0, 4)}, "month")):
        with pytest.raises(D.MarkError) as e:
            D.rule_from_marks("Faktura 3. juni 2022 x", marks)
        assert e.value.code == code


def test_text_functions(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c).first()[0]

    assert value(T.normalize_value(F.lit("PERSON"), F.lit(" Advokat  Jens Hansen, "))) == "jens hansen"
    assert value(T.normalize_value(F.lit("DK_CPR"), F.lit("010190-1234"))) == "0101901234"
    assert value(T.normalize_value(F.lit("PERSON"), F.lit("Straße"))) == "strasse"
    assert value(T.context_for(F.lit("x" * 100 + " navn " + "y" * 100), F.lit(101), F.lit(105))) == "…" + "x" * 59 + " navn " + "y" * 59 + "…"
    assert value(T.strip_markdown(F.lit("# T\n|a|b|\n|---|---|\n```\n|x|\n```\n> **q** *i*"))) == "T\na\tb\n|x|\nq i"
    assert value(T.demote_headings(F.lit("# a\n###### b"))) == "## a\n###### b"
    assert value(T.safe_filename(F.lit('a<b>:"c  d'))) == "abc d"
    assert value(T.safe_filename(F.lit("??"))) == "document"
    assert value(T.looks_like_words(F.lit("TT TT"))) is False and value(T.looks_like_words(F.lit("HK Privat"))) is True
    assert value(T.message_errors(F.lit("%d af {x}…"), F.lit("{x} of\n"))) == ["placeholders", "newlines", "ellipsis"]
    assert value(T.message_errors(F.lit("Gem 100%% %s"), F.lit("Save 100%% %s"))) == []

"""Catalogue files, Markdown, folding search, and the whole rule set over documents against plain Python."""

import datetime
import os
import random
import re
import unicodedata
import xml.dom.minidom

import pytest
from pyspark.sql import functions as F

from docveil.functions import ids
from docveil.functions.entities import PRIORITY
from docveil.functions.stem import _PATTERN
from docveil.operators import detect
from docveil.operators.markdown import to_xhtml
from docveil.sources import catalogues

LINES = '''# head
msgid ""
msgstr ""
"Language: da\\n"
# a note
#, fuzzy, python-format
msgid "one"
msgstr "en"
msgctxt "menu"
msgid ""
"two\\n"
"lines \\\\n \\"q\\""
msgstr[0] "to"
msgstr[1] "flere"

#~ msgid "old"
#~ msgstr "gammel"
#: file.py:3
msgid "three"
msgid_plural "threes"
msgstr[0] ""
"tre"
msgstr[1] "treer"
msgid "four"
msgstr ""'''


def test_catalogue_without_empty_lines(spark):
    rows = spark.createDataFrame([("da", k, t) for k, t in enumerate(LINES.split("\n"))], "lang string, seq long, text string").repartition(3)
    got = {r["msgid"]: tuple(r)[1:] for r in catalogues.read_catalogues(rows).collect()}
    assert got == {
        "one": (None, "one", None, "en", True), 'two\nlines \\n "q"': ("menu", 'two\nlines \\n "q"', None, "to", False),
        "three": (None, "three", "threes", "tre", False), "four": (None, "four", None, "", False),
    }
    assert catalogues.read_catalogues(rows.limit(0)).count() == 0


def test_messages_of_code(spark):
    code = '_("a")\n# _("no")\n_(\'b\\\'s\' "c")\nN_(r"\\d")\nself._("no")\n_("d",\n x)\n_(name)\n_("")'
    rows = spark.createDataFrame([("p", code), ("q", None), ("r", "_('a')")], "path string, text string")
    assert {r[0] for r in catalogues.source_messages(rows).collect()} == {"a", "b'sc", "\\d", "d"}


def test_any_markdown_gives_well_formed_xhtml():
    rnd = random.Random(2)
    parts = ["*", "**", "_", "`", "```\n", "[a](b)", "![", "](", "# ", "> ", "- ", "1. ", "    ", "\n", "\n\n", "|", "|-|-|\n", "a", " b ", "<i>", "&", "\\", "\x02", "---\n", "~~~\n", '"']
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))
        clean = "".join(c for c in to_xhtml(text) if c >= " " or c in "\n\t")
        xml.dom.minidom.parseString(f"<body>{clean}</body>")
    for deep in (">" * 5000 + "a", "- " * 5000 + "a", "*" * 5000, "[" * 5000):
        xml.dom.minidom.parseString(f"<body>{to_xhtml(deep)}</body>")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", ""), ("a\nb", "<p>a\nb</p>"), ("a  \nb", "<p>a<br />\nb</p>"), ("# T #", "<h1>T</h1>"), ("a\n- b", "<p>a\n- b</p>"), ("> a\n> b", "<blockquote>\n<p>a\nb</p>\n</blockquote>"), ("~~~\n<x>\n", "<pre><code>&lt;x&gt;\n\n</code></pre>"),
        ("**a *b* c**", "<p><strong>a <em>b</em> c</strong></p>"), ("2*3*4 a_b_c", "<p>2<em>3</em>4 a_b_c</p>"), ("`` a`b ``", "<p><code>a`b</code></p>"), ("![p](q.png)", '<p><img alt="p" src="q.png" /></p>'), ("[*x*](u)", '<p><a href="u"><em>x</em></a></p>'),
        ("- a\n\n- b", "<ul>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n</li>\n</ul>"), ("3. a\n4. b\n\nc", '<ol start="3">\n<li>a</li>\n<li>b</li>\n</ol>\n<p>c</p>'), ("a | b\n-|-\nc", "<table>\n<thead>\n<tr>\n<th>a</th>\n<th>b</th>\n</tr>\n</thead>\n<tbody>\n</tbody>\n</table>\n<p>c</p>"),
    ],
)
def test_markdown(text, want):
    assert to_xhtml(text) == want


def test_folding_by_runs():
    """Runs are folded like their characters one by one."""
    rnd = random.Random(7)
    letters = [*"aAzZ09-~! ", " ", "  ", "é", "É", "ß", "÷", "×", "\u0301", "\u0327", "\u00ad", "\t", "\u00a0", "ﬁ", "İ", "ÿ", "Þ"]

    def one_by_one(text):
        out, low, high, at = [], [], [], 0
        while at < len(text):
            end = at + 1
            while end < len(text) and unicodedata.combining(text[end]):
                end += 1
            for c in unicodedata.normalize("NFKC", text[at:end]):
                if c in detect.INVISIBLE or (c.isspace() and out and out[-1] == " "):
                    continue
                for f in " " if c.isspace() else c.casefold():
                    out.append(f)
                    low.append(at)
                    high.append(end)
            at = end
        return "".join(out), low, high

    for _ in range(30000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 14)))
        assert detect.folded(text) == one_by_one(text), text


def test_search_prefilter_is_sure():
    rnd = random.Random(1)
    letters = [*"aAfiFI nN ", "ﬁ", "İ", "ß", "ẞ", "\u00ad", "\u200b", "\u0301", "é", " ", "Å", "ͅ", "Σ", "ς", "K", "ᄀ", "ᅡ", "가", "ᾳ", "\u09c7", "\u09be", "½", "ŉ", "ǰ", "´"]
    hits = 0
    for _ in range(60000):
        text, query = ("".join(rnd.choice(letters) for _ in range(rnd.randint(0, n))) for n in (12, 3))
        needle = detect.folded(query)[0].strip()
        if needle and needle in detect.folded(text)[0]:
            hits += 1
            assert detect.may_hold(text, needle), (text, query)
    assert hits > 1000


# --- all rules over documents, in plain Python -------------------------


def _verdict(entity, value):
    d = re.sub("[^0-9]", "", value)
    luhn = lambda s: sum(int(c) if (len(s) - k) % 2 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(s)) % 10 == 0

    def born():
        dd, mm, yy, s = int(d[:2]), int(d[2:4]), int(d[4:6]), int(d[6])
        dd -= 60 if dd > 60 else 0
        year = 1900 + yy if s <= 3 else (2000 + yy if yy <= 36 else 1900 + yy) if s in (4, 9) else (2000 + yy if yy <= 57 else 1800 + yy)
        try:
            return datetime.date(year, mm, dd)
        except ValueError:
            return None

    mod11 = lambda weights: sum(w * int(c) for w, c in zip(weights, d, strict=True)) % 11 == 0
    if entity == "DK_CPR":
        return False if len(d) != 10 or not born() else True if mod11(ids.CPR_WEIGHTS) else None
    if entity == "DK_CPR_MULIG":
        return False if len(d) != 10 or born() else None
    if entity == "DK_PHONE":
        own = d[4:] if d.startswith("0045") and len(d) == 12 else d[2:] if d.startswith("45") and len(d) == 10 else d
        return False if len(own) != 8 or own[0] in "01" else None
    if entity == "DK_CVR":
        return len(d) == 8 and mod11(ids.CVR_WEIGHTS)
    if entity == "CREDIT_CARD":
        return luhn(d)
    if entity == "IBAN_CODE":
        plain = value.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    return None


def _stem(w):
    return re.sub(_PATTERN, r"\1", re.sub(_PATTERN, r"\1", w))


def _near(text, a, b):
    before, behind = text[max(0, a - detect.CONTEXT_CHARS) : a], text[b : b + detect.CONTEXT_CHARS]
    before = re.sub(r"^\S*", "", before) if a > detect.CONTEXT_CHARS else before
    behind = re.sub(r"\S*$", "", behind) if len(text) > b + detect.CONTEXT_CHARS else behind
    words = before.split()[-detect.CONTEXT_BEFORE :] + behind.split()[: detect.CONTEXT_BEHIND]
    bare = [w.lower().strip(detect._EDGES) for w in words]
    return {_stem(p) for w in bare if w for p in (w, *re.split("[-./]", w))}


def _fold(city):
    s = unicodedata.normalize("NFKC", city).casefold().replace("æ", "ae").replace("ø", "oe").replace("å", "aa")
    return "".join(c for c in s if c.isalnum())


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(text, ocr, codes):
    towns, found = {_fold(c) for _, c in codes}, []
    for r in detect.RULES:
        if r.entity == "DK_CPR_MULIG" and not ocr:
            continue
        flags = re.ASCII
        for m in re.finditer(r.pattern, text, flags):
            if r.mark and r.mark not in text:
                continue
            a, b, value = m.start(r.group), m.end(r.group), m[r.group]
            if r.entity == "DK_POSTAL_CITY":
                for n in sorted((n for n in range(5, len(value) + 1) if n == len(value) or value[n] in " \t-"), reverse=True):
                    cut = value[:n].rstrip(" ")
                    code, city = re.match(r"^([0-9]{4})[ \t]+(.+?)\s*$", cut, re.S).groups() if re.match(r"^[0-9]{4}[ \t]+\S", cut) else (None, None)
                    if code and _fold(city) and (_fold(city) in towns or any(int(code) == k and _edits(_fold(city), _fold(c)) <= (0 if len(_fold(c)) <= 4 else 1 if len(_fold(c)) <= 6 else 2) for k, c in codes)):
                        found.append((r.entity, a, a + len(cut), cut, 1.0))
                        break
                continue
            said = _verdict(r.entity, value)
            if said is False:
                continue
            wanted = {_stem(w) for w in detect.CONTEXT.get(r.entity, "").split()}
            score = 1.0 if said else min(1.0, max(r.score + detect.CONTEXT_GAIN, detect.CONTEXT_LEAST)) if wanted & _near(text, a, b) else r.score
            if score >= detect.SCORE_THRESHOLD:
                found.append((r.entity, a, b, value, score))
    merged = []
    for s in sorted(found, key=lambda s: (s[0], s[1], s[2] - s[1], s[2], s[3], s[4])):
        if merged and merged[-1][0] == s[0] and s[1] < merged[-1][2] and s[2] > merged[-1][1]:
            if s[2] - s[1] < merged[-1][2] - merged[-1][1] or s[4] > merged[-1][4]:
                merged[-1] = s
        else:
            merged.append(s)
    kept = []
    for s in sorted(merged, key=lambda s: (s[1] - s[2], PRIORITY.index(s[0]), -s[4], s[1])):
        if not any(s[1] < k[2] and s[2] > k[1] for k in kept):
            kept.append(s)
    return {(e, a, b, v, round(x, 4)) for e, a, b, v, x in kept}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_all_rules_over_documents(spark):
    from docveil.queries import QUERIES

    data = "/root/testdata/sf0.001"
    codes = [(1000 + r[0] * 7 % 9000, f"By{r[0] % 40}") for r in spark.read.parquet(f"{data}/customer.parquet").select("c_custkey").collect()]
    want = {(r[0], *s) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect() for s in brute(r[1] or "", r[0] % 3 == 0, codes)}
    got = {(r[0], r["entity"], r["start_at"], r["end_at"], r["value"], r["score"]) for r in QUERIES["document_spans"](spark, data).collect()}
    assert got == want and len({r[1] for r in got}) >= 2


def test_all_rules_over_made_texts(spark):
    """Numbers, towns and context words by chance, close together."""
    rnd = random.Random(4)
    codes = [(8500, "Grenaa"), (8340, "Malling"), (8000, "Aarhus C"), (8500, "Ørum"), (1050, "København K")]
    parts = ["tlf", "telefonen", "CPR", "personnummeret:", "konto", "12345678", "010203-1234", "0102031234", "010203 1234", "+45 22334455", "0045-22 33 44 55", "20 30 40 50", "8500 Grenaa", "8500 Grena", "8340 Mallingg By", "9000 Ørum", "8000 Xby", "BS-12/2019-ABC", "Sagsnr: Q1-20/x9", "a@b.dk", "4111 1111 1111 1111", "DK5000400440116243", "Nørrevej 12", "Store Kongensgade 3 B, 2. tv.", "1234 1234567", "og", "er", ".", ",", "\n", "1050 København K"]
    rows = [(k, " ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))) for k in range(400)]
    pages = spark.createDataFrame(rows, "page_uid long, text string").withColumn("ocr", F.col("page_uid") % 2 == 0)
    got = {}
    for r in detect.detect(pages, spark.createDataFrame(codes, "code int, city string"), ocr="ocr").collect():
        got.setdefault(r["page_uid"], set()).add((r["entity"], r["start"], r["end"], r["value"], round(r["score"], 4)))
    wrong = [(t, sorted(got.get(k, set()) ^ brute(t, k % 2 == 0, codes))) for k, t in rows if got.get(k, set()) != brute(t, k % 2 == 0, codes)]
    assert not wrong, wrong[:3]

"""Scalar text operators."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docveil.functions.entities import NUMERIC, PERSON


def fold(value: Column) -> Column:
    """Compatibility form (NFKC), case-folded; what no built-in function gives. Apply it to distinct values."""

    @F.pandas_udf("string")
    def nfkc(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())

    return nfkc(value)


def nfkc_only(value: Column) -> Column:
    @F.pandas_udf("string")
    def nfkc(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    return nfkc(value)


def fold_city(name: Column, folded: bool = False) -> Column:
    """A town's name without spaces, marks and case, with ae, oe and aa written out. folded: it went through fold()."""
    s = F.lower(name) if folded else fold(name)
    for letter, plain in (("æ", "ae"), ("ø", "oe"), ("å", "aa")):
        s = F.replace(s, F.lit(letter), F.lit(plain))
    return F.regexp_replace(s, r"[^\p{L}\p{N}]", "")


def ocr_slack(name: Column) -> Column:
    """Edits that a name of this length may have."""
    return F.when(F.length(name) <= 4, 0).when(F.length(name) <= 6, 1).otherwise(2)


def edits_within(a: Column, b: Column, limit: Column) -> Column:
    return F.levenshtein(a, b) <= limit


#: Titles that a person's key does not hold.
TITLES = r"advokat(?:fuldmægtig)?|adv\.|dommer|retsformand|anklager|forsvarer|hr\.|fru|frk\.|dr\.|prof\."
_EDGE = " \t\r\n.,:;!?\"'()[]{}«»"


def normalize_value(entity: Column, value: Column) -> Column:
    """The group key of a value: digits of numbers; else single spaces, bare ends, no title, folded."""
    v = nfkc_only(F.coalesce(value, F.lit("")))
    words = F.btrim(F.regexp_replace(v, r"(?U)\s+", " "), F.lit(_EDGE))
    person = F.btrim(F.regexp_replace(words, rf"(?i)^(?:{TITLES})\s+", ""))
    return F.when(entity.isin(*NUMERIC), F.regexp_replace(v, r"(?U)\D", "")).otherwise(fold(F.when(entity == PERSON, person).otherwise(words)))


def collapse(value: Column) -> Column:
    return F.btrim(F.regexp_replace(value, r"(?U)\s+", " "), F.lit(" "))


#: Characters of context on either side.
CONTEXT = 60


def context_for(text: Column, start: Column, end: Column, width: int = CONTEXT) -> Column:
    low, high = F.greatest(F.lit(0), start - width), F.least(F.length(text), end + width)
    part = collapse(F.substring(text, low + 1, high - low))
    return F.concat(F.when(low > 0, F.lit("…")).otherwise(F.lit("")), part, F.when(high < F.length(text), F.lit("…")).otherwise(F.lit("")))


def looks_like_words(value: Column) -> Column:
    """No frame characters, and a vowel in some token of two letters or more, if there are any."""
    tokens = F.filter(F.split(value, r"(?U)[^\w]+"), lambda t: F.length(t) >= 2)
    return ~value.rlike(r"[|\[\]{}<>\\_~^*#=+]") & ((F.size(tokens) == 0) | F.exists(tokens, lambda t: t.rlike("(?i)[aeiouyæøå]")))


# --- page text: patterns of marks are fixed values ---------------------


def clean_markdown(text: Column) -> Column:
    """Line breaks of cells to spaces, inline tags dropped, runs of blanks to one."""
    s = F.regexp_replace(text, r"(?i)<br\s*/?>", " ")
    s = F.regexp_replace(s, r"(?i)<(?:img|/?(?:span|div|p|b|i|em|strong|font|sub|sup))\b[^>]*>", "")
    return F.regexp_replace(s, r"[ \t]{2,}", " ")


def demote_headings(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)^(#{1,5}) ", "#$1 ")


def table_cells(line: Column) -> Column:
    """Trimmed cells of a table row; the outer bars are optional."""
    inner = F.regexp_replace(F.regexp_replace(F.btrim(line), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(inner, r"\|"), lambda c: F.btrim(c))


def flatten_table_line(line: Column) -> Column:
    return F.array_join(F.filter(table_cells(line), lambda c: c != ""), "\t")


def plain_line(line: Column) -> Column:
    """A line outside code without its Markdown marks."""
    s = F.when(F.ltrim(line).startswith("|"), flatten_table_line(line)).otherwise(line)
    s = F.regexp_replace(s, r"^#{1,6}\s*", "")
    s = F.regexp_replace(s, r"^>\s?", "")
    s = F.regexp_replace(s, r"\*\*(.+?)\*\*", "$1")
    return F.regexp_replace(s, r"(?<!\*)\*(?!\*)(.+?)\*", "$1")


TABLE_RULE = r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*$"


def strip_markdown(text: Column) -> Column:
    """Plain text: rules of tables dropped, cells tabbed, fences dropped around code that stays as it is."""
    lines = F.split(text, r"\r\n|\n|\r", -1)
    start = F.struct(F.lit(False).alias("code"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        fence = line.startswith("```")
        dropped = fence | (~acc["code"] & line.rlike(TABLE_RULE))
        kept = F.when(acc["code"], line).otherwise(plain_line(line))
        return F.struct(
            F.when(fence, ~acc["code"]).otherwise(acc["code"]).alias("code"),
            F.when(dropped, acc["out"]).otherwise(F.concat(acc["out"], F.array(kept))).alias("out"),
        )

    return F.array_join(F.aggregate(lines, start, step, lambda acc: acc["out"]), "\n")


# --- names, versions, messages -----------------------------------------


def version_parts(text: Column) -> Column:
    """Leading digits of the dotted parts, up to the first part without any."""
    parts = F.transform(F.split(F.btrim(F.coalesce(text, F.lit(""))), r"\."), lambda p: F.regexp_extract(p, r"^\s*([0-9]+)", 1))
    stop = F.array_position(parts, "")
    whole = F.when(stop > 0, F.slice(parts, F.lit(1), (stop - 1).cast("int"))).otherwise(parts)
    return F.transform(whole, lambda p: p.cast("int"))


def is_newer(remote: Column, local: Column) -> Column:
    """Compares versions part by part, the shorter one filled up with zeros."""
    r, own = version_parts(remote), version_parts(local)
    n = F.greatest(F.size(r), F.size(own))

    def padded(parts: Column) -> Column:
        return F.concat(parts, F.array_repeat(F.lit(0), (n - F.size(parts)).cast("int")))

    return (F.size(r) > 0) & (padded(r) > padded(own))


_PRINTF = r"%\([^)]*\)[-+ #0]*[0-9*]*(?:\.[0-9]+)?[a-zA-Z]|%[-+ #0]*[0-9*]*(?:\.[0-9]+)?[a-zA-Z]"


def placeholders(text: Column) -> Column:
    """printf and brace placeholders, sorted."""
    plain = F.replace(text, F.lit("%%"), F.lit("\u0001"))
    return F.array_sort(F.concat(F.regexp_extract_all(plain, F.lit(_PRINTF), F.lit(0)), F.regexp_extract_all(text, F.lit(r"\{[^{}]*\}"), F.lit(0))))


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def message_errors(msgid: Column, value: Column) -> Column:
    """Names of what makes a translation wrong."""
    checks = {
        "placeholders": placeholders(msgid) != placeholders(value),
        "newlines": _count(msgid, "\n") != _count(value, "\n"),
        "ellipsis": msgid.endswith("…") & ~value.endswith("…"),
        "leading_space": msgid.startswith(" ") != value.startswith(" "),
        "trailing_space": msgid.endswith(" ") != value.endswith(" "),
    }
    return F.filter(F.array(*(F.when(bad, F.lit(name)) for name, bad in checks.items())), lambda x: x.isNotNull())


def safe_filename(name: Column, fallback: str = "document", width: int = 60) -> Column:
    """Without the characters that file systems forbid, single spaces, at most width characters."""
    s = F.btrim(F.substring(collapse(F.regexp_replace(name, r'[<>:"/\\|?*]', "")), 1, width))
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit(fallback)).otherwise(s)


def xml_escape(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def strip_subset(font: Column) -> Column:
    return F.regexp_replace(font, r"^[A-Z]{6}\+", "")


def role_alternatives(words) -> str:
    """Words of roles as one alternation; their Danish letters may be written out."""
    spelled = [re.sub("[æøå]", lambda m: {"æ": "(?:æ|ae)", "ø": "(?:ø|oe)", "å": "(?:å|aa)"}[m[0]], w) for w in words]
    return "|".join(w.replace(".", r"\.") for w in spelled)


def role_pattern(words) -> str:
    return r"(?<![\wÆØÅæøå])(" + role_alternatives(words) + r")(?![\wÆØÅæøå])"

"""Which date format the names of a collection share, and the dates in them."""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docveil.functions.matches import let
from docveil.shared import materialize

# Month names of eight languages.
MONTH_WORDS = (
    "januar january januari jänner janvier janv enero ene jan jän",
    "februar february februari février fevrier févr fevr febrero feb fév fev",
    "marts march märz maerz mars maart marzo mär mrz mrt mar",
    "april avril abril apr avr abr",
    "maj may mai mei mayo",
    "juni june juin junio jun",
    "juli july juillet juil julio jul",
    "august augusti augustus août aout agosto aug",
    "september septiembre setiembre septembre sept sep",
    "oktober october octubre octobre okt oct",
    "november noviembre novembre nov",
    "december dezember desember diciembre décembre decembre dec dez dic déc",
)
MONTHS = {w: k for k, words in enumerate(MONTH_WORDS, 1) for w in words.split()}
_NAMES = "|".join(sorted(MONTHS, key=len, reverse=True))
_MONTH = rf"(?<!\p{{L}})(?<m>{_NAMES})\.?(?!\p{{L}})"


@dataclass(frozen=True)
class DateRule:
    """A pattern with groups y, m and maybe d; order is that of day and month where it could be the other."""

    key: str
    pattern: str
    order: str = ""
    template: str = ""

    @property
    def regex(self) -> str:
        return "(?iu)" + self.pattern if self.named or self.key == "manual" else self.pattern

    @property
    def has_day(self) -> bool:
        return "(?<d>" in self.regex

    @property
    def named(self) -> bool:
        """May the month be a name?"""
        return "(?<m>[0-9]" not in self.pattern

    def group(self, name: str) -> int:
        """The number of a named group, 0 if there is none."""
        opened = re.findall(r"\((?:\?<([a-z])>|(?!\?))", self.regex)
        return opened.index(name) + 1 if name in opened else 0


# The known formats in their priority.
RULES = (
    DateRule("ddmmyyyy", r"(?<![0-9])(?<d>[0-9]{2})(?<m>[0-9]{2})(?<y>[0-9]{4})(?![0-9])", "dm", "ddmmyyyy"),
    DateRule("yyyymmdd", r"(?<![0-9])(?<y>[0-9]{4})(?<m>[0-9]{2})(?<d>[0-9]{2})(?![0-9])", "", "yyyymmdd"),
    DateRule("d-m-y", r"(?<![0-9])(?<d>[0-9]{1,2})(?<s>[-._ ])(?<m>[0-9]{1,2})\k<s>(?<y>[0-9]{4}|[0-9]{2})(?![0-9])", "dm", "dd-mm-yyyy"),
    DateRule("y-m-d", r"(?<![0-9])(?<y>[0-9]{4})(?<s>[-._ ])(?<m>[0-9]{1,2})\k<s>(?<d>[0-9]{1,2})(?![0-9])", "", "yyyy-mm-dd"),
    DateRule("d-month-y", rf"(?<![0-9])(?<d>[0-9]{{1,2}})\.?[-._ ,]*{_MONTH}[-._ ,]*(?<y>[0-9]{{4}}|[0-9]{{2}})(?![0-9])", "", "dd month yyyy"),
    DateRule("month-d-y", rf"{_MONTH}[-._ ,]*(?<d>[0-9]{{1,2}})(?:st|nd|rd|th)?[-._ ,]*(?<y>[0-9]{{4}})(?![0-9])", "", "month dd yyyy"),
    DateRule("y-month-d", rf"(?<![0-9])(?<y>[0-9]{{4}})[-._ ,]*{_MONTH}[-._ ,]*(?<d>[0-9]{{1,2}})(?![0-9])", "", "yyyy month dd"),
    DateRule("ddmmyy", r"(?<![0-9])(?<d>[0-9]{2})(?<m>[0-9]{2})(?<y>[0-9]{2})(?![0-9])", "dm", "ddmmyy"),
    DateRule("yymmdd", r"(?<![0-9])(?<y>[0-9]{2})(?<m>[0-9]{2})(?<d>[0-9]{2})(?![0-9])", "", "yymmdd"),
    DateRule("mmddyyyy", r"(?<![0-9])(?<m>[0-9]{2})(?<d>[0-9]{2})(?<y>[0-9]{4})(?![0-9])", "md", "mmddyyyy"),
    DateRule("m-d-y", r"(?<![0-9])(?<m>[0-9]{1,2})(?<s>[-._ ])(?<d>[0-9]{1,2})\k<s>(?<y>[0-9]{4}|[0-9]{2})(?![0-9])", "md", "mm-dd-yyyy"),
    DateRule("mmddyy", r"(?<![0-9])(?<m>[0-9]{2})(?<d>[0-9]{2})(?<y>[0-9]{2})(?![0-9])", "md", "mmddyy"),
    DateRule("month-y", rf"{_MONTH}[-._ ,]*(?<y>[0-9]{{4}})(?![0-9])", "", "month yyyy"),
    DateRule("y-month", rf"(?<![0-9])(?<y>[0-9]{{4}})[-._ ,]*{_MONTH}", "", "yyyy month"),
    DateRule("m-y", r"(?<![0-9])(?<m>[0-9]{1,2})[-._ ](?<y>[0-9]{4})(?![0-9])", "", "mm-yyyy"),
    DateRule("y-m", r"(?<![0-9])(?<y>[0-9]{4})[-._ ](?<m>[0-9]{1,2})(?![0-9])", "", "yyyy-mm"),
    DateRule("yyyymm", r"(?<![0-9])(?<y>[0-9]{4})(?<m>[0-9]{2})(?![0-9])", "", "yyyymm"),
    DateRule("mmyyyy", r"(?<![0-9])(?<m>[0-9]{2})(?<y>[0-9]{4})(?![0-9])", "", "mmyyyy"),
)


def month_number(word: Column, named: bool = True) -> Column:
    """1 to 12 for digits, or, if named, for a month's name or abbreviation; null otherwise."""
    if not named:
        return word.try_cast("int")
    plain = F.lower(F.regexp_replace(F.trim(word), r"\.+$", ""))
    table = F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))
    return F.coalesce(plain.try_cast("int"), F.try_element_at(table, plain))


def full_year(text: Column, today: datetime.date) -> Column:
    """Four digits of a year; two are near: up to five years ahead or in the past. Null outside 1900 to ten years ahead."""
    n = text.try_cast("int")
    y = F.when(F.length(text) == 2, n + F.when(n <= (today.year + 5) % 100, 2000).otherwise(1900)).otherwise(n)
    return F.when(y.between(1900, today.year + 10), y)


def make_date(year: Column, month: Column, day: Column, today: datetime.date, named: bool = True) -> Column:
    d = F.coalesce(F.nullif(day, F.lit("")), F.lit("1"))
    text = F.concat_ws("-", full_year(year, today).cast("string"), F.lpad(month_number(month, named).cast("string"), 2, "0"), F.lpad(d, 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


def parse_rule(name: Column, rule: DateRule, today: datetime.date, may: Column | None = None) -> Column:
    """The first valid date in a name; an invalid match does not hide a later one. Nothing is looked for where may is false."""

    def part(k: str, whole: Column) -> Column:
        g = rule.group(k)
        return F.regexp_extract_all(name, F.lit(rule.regex), F.lit(g)) if g else F.transform(whole, lambda _: F.lit(""))

    def first(whole: Column) -> Column:
        fields = F.arrays_zip(part("y", whole).alias("y"), part("m", whole).alias("m"), part("d", whole).alias("d"))
        dates = F.transform(fields, lambda f: make_date(f["y"], f["m"], f["d"], today, rule.named))
        return F.try_element_at(F.filter(dates, lambda d: d.isNotNull()), F.lit(1))

    there = name.rlike(rule.regex) if may is None else may & name.rlike(rule.regex)
    return F.when(there, let(F.regexp_extract_all(name, F.lit(rule.regex), F.lit(0)), first))


def parse_rules(names: DataFrame, rules: tuple[DateRule, ...] | list[DateRule], today: datetime.date) -> DataFrame:
    """names with an array dates, one element for each rule; rules of month names are tried where a name holds one."""
    guarded = names.withColumn("__month", F.col("name").rlike(f"(?iu)(?:{_NAMES})"))
    each = [parse_rule(F.col("name"), r, today, F.col("__month") if r.named and r.key != "manual" else None) for r in rules]
    return guarded.withColumn("dates", F.array(*each)).drop("__month")


def rule_hits(names: DataFrame, today: datetime.date, rules: tuple[DateRule, ...] = RULES) -> DataFrame:
    """(rule, prio, has_day, hits, all_on_20): one aggregate over the names for all rules."""
    return _hits(parse_rules(names.select("name"), rules, today), rules)


def _hits(parsed: DataFrame, rules: tuple[DateRule, ...]) -> DataFrame:
    found = lambda k: F.col("dates")[k]
    aggs = [a for k, r in enumerate(rules) for a in (F.count(found(k)).alias(f"h_{r.key}"), F.bool_and(F.dayofmonth(found(k)) == 20).alias(f"t_{r.key}"))]
    one = parsed.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(r.key).alias("rule"), F.lit(k).alias("prio"), F.lit(r.has_day).alias("has_day"), F.col(f"`h_{r.key}`").alias("hits"), F.coalesce(F.col(f"`t_{r.key}`"), F.lit(False)).alias("all_on_20")) for k, r in enumerate(rules)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def choose_chain(hits: list[tuple[str, int, bool, int, bool]], rules: tuple[DateRule, ...] = RULES) -> list[DateRule]:
    """From rule_hits(): the rule with the most hits, then those that do not turn day and month round.

    Of equal rules one with a day wins, then the priority. Where all month-day-year
    dates fall on a 20th and month-year fits as many names, the 20 was a century.
    """
    by = {r.key: r for r in rules}
    ranked = sorted((h for h in hits if h[3]), key=lambda h: (-h[3], not h[2], h[1]))
    if not ranked:
        return []
    keys = [h[0] for h in ranked]
    count = {h[0]: h[3] for h in ranked}
    first = keys[0]
    if first == "mmddyy" and ranked[0][4] and count.get("mmyyyy", 0) >= count[first]:
        keys.remove(first)
        first = "mmyyyy"
    main = by[first]
    return [main, *(by[k] for k in keys if k != first and not (main.order and by[k].order and by[k].order != main.order))]


def date_names(names: DataFrame, today: datetime.date, rules: tuple[DateRule, ...] = RULES) -> DataFrame:
    """names with rule and date by the chain that fits them all best; the hit counts are the only thing the driver gets.

    Names are parsed once: the dates of all rules are written with them, and the chain picks among these.
    """
    parsed = materialize(parse_rules(names, rules, today), "dates")
    chain = choose_chain([tuple(r) for r in _hits(parsed, rules).collect()], rules)
    at = {r.key: k for k, r in enumerate(rules)}
    tried = [F.struct(F.lit(r.key).alias("rule"), F.col("dates")[at[r.key]].alias("date")) for r in chain]
    best = F.try_element_at(F.filter(F.array(*tried), lambda t: t["date"].isNotNull()), F.lit(1)) if chain else F.lit(None).cast("struct<rule:string,date:date>")
    return parsed.withColumn("__best", best).withColumn("rule", F.col("__best.rule")).withColumn("date", F.col("__best.date")).drop("__best", "dates")


class MarkError(ValueError):
    """code says what is wrong with the marks."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def rule_from_marks(example: str, marks: dict[str, tuple[int, int]]) -> DateRule:
    """A rule from the places of year, month and maybe day in one name. Only what is between them belongs to the pattern."""
    if not {"y", "m"} <= marks.keys():
        raise MarkError("missing")
    placed = sorted((a, b, k) for k, (a, b) in marks.items())
    if any(not 0 <= a < b <= len(example) for a, b, _ in placed):
        raise MarkError("empty")
    if any(x[1] > y[0] for x, y in zip(placed, placed[1:], strict=False)):
        raise MarkError("overlap")
    digit = lambda i: 0 <= i < len(example) and example[i].isdigit()
    body, end = "", None
    for a, b, k in placed:
        said = example[a:b]
        if end is not None and a > end:
            gap = example[end:a]
            body += re.escape(gap) if any(c.isalnum() for c in gap) else r"[^\p{L}\p{N}]+"
        if k == "y":
            if not (said.isdigit() and len(said) in (2, 4)):
                raise MarkError("year")
            body += rf"(?<y>[0-9]{{{len(said)}}})"
        elif said.isdigit() and len(said) <= 2:
            body += rf"(?<{k}>[0-9]{{1,2}})" if not digit(a - 1) and not digit(b) else rf"(?<{k}>[0-9]{{{len(said)}}})"
        elif k == "m" and said.strip(".").casefold() in MONTHS:
            body += r"(?<m>\p{L}+)\.?"
        else:
            raise MarkError("month" if k == "m" else "day")
        end = b
    first, last = placed[0][0], placed[-1][1] - 1
    head = (r"(?<![0-9])" if not digit(first - 1) else "") if digit(first) else r"(?<!\p{L})"
    tail = (r"(?![0-9])" if not digit(last + 1) else "") if digit(last) else r"(?!\p{L})"
    return DateRule("manual", head + body + tail)


def file_date(date: Column) -> Column:
    """dd/mm-yyyy."""
    return F.date_format(date, "dd/MM-yyyy")


def rule_template(rule: DateRule) -> str:
    """A readable template, such as dd-mm-yyyy."""
    return rule.template

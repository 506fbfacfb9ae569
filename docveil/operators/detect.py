"""Detectors: page texts to scored spans.

Pages have page_uid and text. Spans are (page_uid, entity, start, end, value,
score), half-open positions in code points. Names of persons, places and
organisations come from a model: see ``plans.anonymise.find_names`` and pass
its spans, or those of another model, as ``extra``. E-mail, account and card patterns, and how context
words lift a score, are this library's own.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docveil.functions import entities as E
from docveil.functions import ids
from docveil.functions.matches import exploded, group_spans, let, spans, starts
from docveil.functions.stem import plain_stem, stem
from docveil.functions.text import edits_within, fold_city, ocr_slack
from docveil.shared import by_exchange

#: Fixed value: spans below it are not shown.
SCORE_THRESHOLD = 0.4
#: What a context word adds and the least score it gives (own choice).
CONTEXT_GAIN, CONTEXT_LEAST = 0.35, 0.4
#: How many words before and behind a span may be its context, and within how many characters they are looked for (own choice).
CONTEXT_BEFORE, CONTEXT_BEHIND, CONTEXT_CHARS = 5, 3, 120

_B, _E = r"(?<![\wÆØÅæøå])", r"(?![\wÆØÅæøå])"
_DAY, _MONTH = r"(?:0[1-9]|[12]\d|3[01]|6[1-9]|[78]\d|9[01])", r"(?:0[1-9]|1[0-2])"
# Endings of street names.
STREETS = (
    "vej vejen gade gaden allé alle allee boulevard blvd plads stræde straede torv torvet park parken have haven bakke bakken "
    "toften engen lunden dalen marken vangen vænget vaenget sti stien kaj kajen brygge bryggen gårdsvej gaardsvej krogen højen hoejen ager agre"
).split()
_STREET = r"(?:[A-ZÆØÅ][\wÆØÅæøå.'\-]{0,25}(?:" + "|".join(STREETS) + r")|(?:" + "|".join(s[0].upper() + s[1:] for s in STREETS) + r"))"
POSTAL_PATTERN = _B + r"(?:1[0-9]{3}|[2-9][0-9]{3})[ \t]+[A-ZÆØÅ][a-zæøå]{2,}(?:[ \-][A-ZÆØÅ]?[a-zæøå]+){0,2}(?:[ \t][A-ZÆØÅ]" + _E + r")?"


@dataclass(frozen=True)
class Rule:
    """A pattern of an entity with its score; group names the part that counts, mark is what every match holds."""

    entity: str
    pattern: str
    score: float
    group: int = 0
    mark: str = ""


# Formats and their scores.
RULES = (
    Rule(E.CPR, _B + _DAY + _MONTH + r"\d{2}-\d{4}" + _E, 0.6),
    Rule(E.CPR, _B + _DAY + _MONTH + r"\d{2}\s\d{4}" + _E, 0.5),
    Rule(E.CPR, _B + _DAY + _MONTH + r"\d{6}" + _E, 0.3),
    Rule(E.CPR_LOOSE, _B + r"\d[\d .\-]{8,14}\d" + _E, 0.45),
    Rule(E.PHONE, r"(?<![\d+])(?:\+45|0045)[ .\-]?[2-9]\d(?:[ .\-]?\d{2}){3}" + _E, 0.7),
    Rule(E.PHONE, _B + r"[2-9]\d(?:[ .]\d{2}){3}" + _E, 0.5),
    Rule(E.PHONE, _B + r"[2-9]\d{7}" + _E, 0.3),
    Rule(E.CVR, _B + r"(?:DK[ ]?)?\d{8}" + _E, 0.1),
    Rule(E.ACCOUNT, _B + r"\d{4}[ .\-]\d{6,10}" + _E, 0.15),
    Rule(E.ADDRESS, _B + r"(?:[A-ZÆØÅ][\wÆØÅæøå.'\-]{0,20}[ \t]+){0,2}?" + _STREET + r"[ \t]+\d{1,4}(?:[ \t]*[A-Za-z]" + _E + r")?(?i:(?:[ \t]*,?[ \t]*\d{1,2}\.?[ \t]*(?:sal)?[ \t]*,?[ \t]*(?:t\.?[hv]\.?|m\.?f\.?))?)", 0.5),
    Rule(E.POSTAL, POSTAL_PATTERN, 0.45),
    Rule(E.CASE_NO, _B + r"(?:BS|SKS|FS|A\.?S\.?|B\.?S\.?|V\.?L\.?|Ø\.?L\.?)[ \-]?\d{1,6}[/\-]\d{4}(?:-[A-ZÆØÅ]{2,5})?" + _E, 0.6),
    Rule(E.CASE_NO, r"(?i)(?:j\.?\s?nr\.?|journalnr\.?|journalnummer|sagsnr\.?|sagsnummer|akt\.?\s?nr\.?)\s*[:.]?\s*([\wÆØÅæøå/\-][\wÆØÅæøå./\-]{2,28}[\wÆØÅæøå/\-])", 0.55, 1),
    # Own patterns.
    Rule(E.EMAIL, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0.9, mark="@"),
    Rule(E.IBAN, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", 0.5),
    # One run of digits, or the groups that cards are printed in; a number beside a card is no part of it.
    Rule(E.CARD, r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1(?:[0-9]{4}\1[0-9]{3}|[0-9]{1,7})|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5})(?![0-9])", 0.3),
)

#: Words that make a weak format believable.
CONTEXT = {
    E.CPR: "cpr cpr-nr cprnr cpr.nr personnummer person-nr fødselsdato født fødselsdag",
    E.CPR_LOOSE: "cpr personnummer født",
    E.PHONE: "telefon tlf tlf. mobil telefonnr mobilnr kontakt træffes",
    E.CVR: "cvr cvr-nr cvrnr se-nr se-nummer momsnr virksomhed p-nr",
    E.ACCOUNT: "konto kontonr kontonummer reg.nr regnr registreringsnummer bank indbetales overføres",
    E.ADDRESS: "adresse bopæl boede bor beliggende c/o",
    E.POSTAL: "adresse postnr postnummer by bopæl",
}


def verdict(entity: Column, value: Column, digits: Column | None = None) -> Column:
    """True lifts a span to the highest score, false drops it, null keeps the pattern's score. digits: those of the value, if they are at hand."""
    if digits is None:
        return let(F.regexp_replace(value, "[^0-9]", ""), lambda d: verdict(entity, value, d))
    born = ids.cpr_birth_date(digits).isNotNull()
    national = F.when(digits.startswith("0045") & (F.length(digits) == 12), F.substring(digits, 5, 8)).when(digits.startswith("45") & (F.length(digits) == 10), F.substring(digits, 3, 8)).otherwise(digits)
    return (
        F.when(entity == E.CPR, F.when((F.length(digits) != 10) | ~born, False).when(ids.cpr_mod11(digits), True))
        .when(entity == E.CPR_LOOSE, F.when((F.length(digits) != 10) | born, False))
        .when(entity == E.PHONE, F.when((F.length(national) != 8) | national.rlike("^[01]"), False))
        .when(entity == E.CVR, ids.cvr_mod11(digits))
        .when(entity == E.CARD, ids.luhn(digits))
        .when(entity == E.IBAN, ids.iban_ok(value))
    )


def _named(found: Column, rule: Rule) -> Column:
    return F.transform(found, lambda s: F.struct(F.lit(rule.entity).alias("entity"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(rule.score).alias("score")))


def pattern_spans(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Raw matches of all rules: one pass over the texts, no shuffle. Only matches of a rule that a text has are placed, which costs more than to see that it has none."""
    none = F.array().cast("array<struct<entity:string,start:int,end:int,value:string,score:double>>")
    each = [none]
    for r in rules:
        text = F.col("text")
        there = text.contains(r.mark) & text.rlike(r.pattern) if r.mark else text.rlike(r.pattern)
        found = spans(text, r.pattern) if r.group == 0 else group_spans(text, r.pattern, r.group)
        each.append(F.when(there, _named(found, r)).otherwise(none))
    return exploded(pages, F.concat(*each), "s", "page_uid", "text").select("page_uid", "text", "s.*")


def _around(text: Column, start: Column, end: Column) -> Column:
    from docveil.functions.text import context_for

    return context_for(text, start, end)


def postal_candidates(value: Column) -> Column:
    """The match and its shorter beginnings, cut at blanks and hyphens, longest first."""
    cuts = F.filter(F.sequence(F.lit(5), F.greatest(F.length(value), F.lit(5))), lambda n: F.substring(value, n + 1, 1).rlike(r"^[ \t-]?$"))
    made = F.transform(cuts, lambda n: F.rtrim(F.substring(value, 1, n)))
    return F.reverse(F.array_distinct(F.filter(made, lambda v: v.rlike(r"^[0-9]{4}[ \t]+\S"))))


def postal_match(values: DataFrame, codes: DataFrame, value: str = "value") -> DataFrame:
    """Add accepted to a table of 'code town' texts.

    The town must be that of the code, up to some edits, or any known
    town. codes(code int, city) is a reference table, of which each town of a code counts once, however
    often it is given; both joins are on equal keys.
    """
    folded = codes.select("code", "city").distinct().select(F.col("code").alias("__code"), fold_city(F.col("city")).alias("__want")).distinct()
    towns = folded.select(F.col("__want").alias("__town")).distinct()
    parts = values.withColumn("__c", F.regexp_extract(value, r"^\s*([0-9]{4})[ \t]+", 1).try_cast("int")).withColumn("__f", fold_city(F.regexp_extract(value, r"(?s)^\s*[0-9]{4}[ \t]+(.+?)\s*$", 1)))
    joined = parts.join(folded, F.col("__c") == F.col("__code"), "left").join(towns, F.col("__f") == F.col("__town"), "left")
    near = F.coalesce(edits_within(F.col("__f"), F.col("__want"), ocr_slack(F.col("__want"))), F.lit(False))
    return joined.withColumn("accepted", (F.col("__f") != "") & (near | F.col("__town").isNotNull())).drop("__c", "__f", "__code", "__want", "__town")


def validated_postal(found: DataFrame, codes: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Each postal match cut to its longest valid beginning; those without one are dropped."""
    tried = found.withColumn("__id", F.monotonically_increasing_id()).select("*", F.posexplode(postal_candidates(F.col("value"))).alias("__k", "__v"))
    good = postal_match(tried.drop("value").withColumnRenamed("__v", "value"), codes).where("accepted")
    held = ["page_uid", "entity", "start", *(carry or [])]
    first = good.groupBy(*held, "__id").agg(F.min_by("value", "__k").alias("value"))
    return first.select(*held, (F.col("start") + F.length("value")).cast("int").alias("end"), "value", F.lit(1.0).alias("score"))


#: What surrounds a word without being part of it.
_EDGES = ".,:;!?()[]{}<>|*#=_\"'«»“”…"


def lemmas(words: Column) -> Column:
    """Lower-case words without punctuation around them, and their parts at hyphens, dots and slashes, each as its stem."""
    bare = F.filter(F.transform(words, lambda w: F.btrim(F.lower(w), F.lit(_EDGES))), lambda w: w != "")
    return F.transform(F.flatten(F.transform(bare, lambda w: F.concat(F.array(w), F.split(w, r"[-./]")))), stem)


def _hinted(text: Column, entity: Column, start: Column, end: Column) -> Column:
    """Whether a stem of the entity's context words stands around a span at all: a lemma is a part of the lower-case text, so where none does there is no context word."""
    low = F.greatest(start - CONTEXT_CHARS, F.lit(0))
    around = F.lower(F.substring(text, low + 1, end + CONTEXT_CHARS - low))
    hint = F.lit(False)
    for key, found in CONTEXT.items():
        hint = F.when(entity == key, around.rlike("|".join(sorted({re.escape(plain_stem(w)) for w in found.split()})))).otherwise(hint)
    return hint


def context_words(text: Column, start: Column, end: Column) -> Column:
    """Lemmas of the words next to a span on either side. A word that CONTEXT_CHARS cut is left out, one that the span cuts is not."""
    low = F.greatest(start - CONTEXT_CHARS, F.lit(0))
    before, behind = F.substring(text, low + 1, start - low), F.substring(text, end + 1, F.lit(CONTEXT_CHARS))
    whole = F.when(low > 0, F.regexp_replace(before, r"^\S*", "")).otherwise(before)
    rest = F.when(F.length(text) > end + CONTEXT_CHARS, F.regexp_replace(behind, r"\S*$", "")).otherwise(behind)
    near = F.filter(F.split(whole, r"(?U)\s+"), lambda w: w != "")
    after = F.filter(F.split(rest, r"(?U)\s+"), lambda w: w != "")
    last = F.slice(near, F.greatest(F.size(near) - CONTEXT_BEFORE, F.lit(0)) + 1, F.lit(CONTEXT_BEFORE))
    return lemmas(F.concat(last, F.slice(after, 1, CONTEXT_BEHIND)))


def with_context(text: Column, entity: Column, start: Column, end: Column, score: Column) -> Column:
    """A span's score, raised if a context word of its entity, in whatever inflection, stands next to it."""
    told = F.create_map(*(F.lit(x) for key, found in CONTEXT.items() for x in (key, sorted({plain_stem(w) for w in found.split()}))))
    wanted = F.try_element_at(told, entity)
    near = F.when(_hinted(text, entity, start, end), F.arrays_overlap(wanted, context_words(text, start, end)))
    return F.when(F.coalesce(near, F.lit(False)), F.least(F.lit(1.0), F.greatest(score + CONTEXT_GAIN, F.lit(CONTEXT_LEAST)))).otherwise(score)


def merge_duplicates(found: Column) -> Column:
    """Of overlapping spans of one entity the tighter, or a later one of higher score.

    In the order (entity, start, length) each span is compared with the last
    one kept. Spans: array<struct<entity, start, end, score, ...>>.
    """
    ordered = _sorted(found, lambda s: [s["entity"], s["start"], s["end"] - s["start"]])

    def step(kept: Column, s: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        meets = (F.size(kept) > 0) & (last["entity"] == s["entity"]) & (s["start"] < last["end"]) & (s["end"] > last["start"])
        better = ((s["end"] - s["start"]) < (last["end"] - last["start"])) | (s["score"] > last["score"])
        replaced = F.concat(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))), F.array(s))
        return F.when(~F.coalesce(meets, F.lit(False)), F.concat(kept, F.array(s))).when(better, replaced).otherwise(kept)

    return F.aggregate(ordered, F.slice(ordered, 1, 0), step)


def prune_overlaps(found: Column) -> Column:
    """One span for each place: the longest, then by the entities' priority, then by score."""
    ordered = _sorted(found, lambda s: [s["start"] - s["end"], E.priority(s["entity"]), -s["score"], s["start"]])

    def step(kept: Column, s: Column) -> Column:
        return F.when(F.exists(kept, lambda k: (s["start"] < k["end"]) & (s["end"] > k["start"])), kept).otherwise(F.concat(kept, F.array(s)))

    kept = F.aggregate(ordered, F.slice(ordered, 1, 0), step)
    return _sorted(kept, lambda s: [s["start"], s["end"]])


def _sorted(found: Column, keys: Callable[[Column], list[Column]]) -> Column:
    """Spans in the order of some keys, then of their fields."""
    keyed = F.transform(found, lambda s: F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys(s))), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def detect(pages: DataFrame, codes: DataFrame | None = None, extra: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, ocr: str | None = None, context: bool = False) -> DataFrame:
    """All spans of pages(page_uid, text), validated, merged and pruned.

    codes validates postal towns; without it they are left out. extra has
    further spans (page_uid, entity, start, end, value, score), such as
    names. Possible identity numbers (CPR_LOOSE) stay only on pages where the column named
    by ocr is true. Texts are read once; only spans are shuffled, by page. With context each span keeps the text around it
    as it is found (null for extra ones), so that nothing has to fetch its text again.
    """
    plain = tuple(r for r in rules if r.entity != E.POSTAL and (ocr or r.entity != E.CPR_LOOSE))
    source = pages.select("page_uid", "text", (F.coalesce(F.col(ocr), F.lit(False)) if ocr else F.lit(False)).alias("__ocr"))
    found = pattern_spans(source.select(F.struct("page_uid", "__ocr").alias("page_uid"), "text"), plain).select("page_uid.*", "text", "entity", "start", "end", "value", "score")
    found = found.where((F.col("entity") != E.CPR_LOOSE) | F.col("__ocr"))
    columns = ["page_uid", "entity", "start", "end", "value", "score"]
    text, at = F.col("text"), (F.col("start"), F.col("end"))

    # Each of these steps is a row's own and worked out once; apart from each other they are compiled.
    held = (*columns[:5], "text", "__base")
    told = exploded(found.withColumnRenamed("score", "__base"), F.array(F.struct(F.regexp_replace("value", "[^0-9]", "").alias("digits"))), "__d", *held)
    told = exploded(told, F.array(F.struct(verdict(F.col("entity"), F.col("value"), F.col("__d.digits")).alias("say"))), "__v", *held)
    say = F.col("__v.say")
    score = F.when(say, F.lit(1.0)).otherwise(with_context(text, F.col("entity"), *at, F.col("__base")))
    scored = exploded(told, F.array(F.when(F.coalesce(say, F.lit(True)), F.struct(score.alias("score")))), "__j", *held)
    scored = scored.withColumn("score", F.col("__j.score")).where(F.col("score") >= SCORE_THRESHOLD)
    if context:
        columns.append("context")
        scored = scored.withColumn("context", _around(text, *at))
    every = scored.select(*columns)
    if codes is not None and any(r.entity == E.POSTAL for r in rules):
        postal = pattern_spans(pages.select("page_uid", "text"), tuple(r for r in rules if r.entity == E.POSTAL))
        postal = postal.withColumn("context", _around(F.col("text"), F.col("start"), F.col("end"))) if context else postal
        every = every.unionByName(validated_postal(postal.drop("text"), codes, columns[6:]).select(*columns))
    if extra is not None:
        every = every.unionByName((extra.withColumn("context", F.lit(None).cast("string")) if context else extra).select(*columns))
    every = every.where(F.col("score") >= SCORE_THRESHOLD)
    grouped = every.groupBy("page_uid").agg(F.collect_list(F.struct(*columns[1:])).alias("s"))
    kept = F.when(F.size("s") < 2, F.col("s")).otherwise(prune_overlaps(merge_duplicates(F.col("s"))))
    return exploded(grouped, kept, "s", "page_uid").select("page_uid", "s.*")


#: Characters that can't be seen, which a search passes over.
INVISIBLE = frozenset("\u00ad\u200b\u200c\u200d\ufeff")


#: Runs of characters that fold to one lower-case character each, with single blanks inside.
_SIMPLE = re.compile(r"(?:[!-~À-ÖØ-Þà-öø-ÿ]| (?=[!-~À-ÖØ-Þà-öø-ÿ]))+")


def folded(text: str) -> tuple[str, list[int], list[int]]:
    """text in the form that a search compares, with the start and end in text of what each of its characters stands for.

    Compatibility form (NFKC), without invisible characters, white space single, case-folded. Marks are taken together with the character before them.
    """
    out, low, high, at = [], [], [], 0
    while at < len(text):
        if run := _SIMPLE.match(text, at):
            first, end = at, run.end()
            end -= end < len(text) and unicodedata.combining(text[end]) > 0  # a mark belongs to the last one
            first += text[at] == " " and bool(out) and out[-1] == " "
            out.extend(text[first:end].lower())
            low.extend(range(first, end))
            high.extend(range(first + 1, end + 1))
            if end > at:
                at = end
                continue
        end = at + 1
        while end < len(text) and unicodedata.combining(text[end]):
            end += 1
        for c in unicodedata.normalize("NFKC", text[at:end]):
            if c in INVISIBLE or (c.isspace() and out and out[-1] == " "):
                continue
            for f in " " if c.isspace() else c.casefold():
                out.append(f)
                low.append(at)
                high.append(end)
        at = end
    return "".join(out), low, high


_BLANKS = re.compile(r"\s+")
_UNSEEN = regex.compile(r"[\p{M}" + "".join(sorted(INVISIBLE)) + "]+")


def bare(text: str) -> str:
    """text without case, marks, invisible characters and runs of blanks, everything taken apart. What one folded() string has of another, this has too; it costs some whole-string calls."""
    low = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text.casefold()).casefold())
    return _BLANKS.sub(" ", low if low.isascii() else _UNSEEN.sub("", low))


def may_hold(text: str, needle: str) -> bool:
    """Whether the needle, in folded form, can stand in the folded text; false is sure."""
    return bare(needle) in bare(text)


def _places(needle: str):
    n, wanted = len(needle), bare(needle)

    def places(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            text, found = t.as_py() or "", []
            if wanted in bare(text):
                hay, low, high = folded(text)
                k = hay.find(needle)
                while k >= 0:
                    found.append({"start": low[k], "end": high[k + n - 1]})
                    k = hay.find(needle, k + 1)
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    return places


def search_occurrences(pages: DataFrame, query: str) -> DataFrame:
    """Every place of query in the texts, overlapping ones too, in folded form on both sides: (page_uid, start, end).

    Where folding is just lower-casing, as in plain texts without runs of blanks, built-in functions do it; other texts go through an Arrow UDF, which
    folds a text as a whole first and follows its characters only if the query may be in it.
    """
    needle = folded(query)[0].strip()
    n = len(needle)
    if not n:
        return pages.select("page_uid", F.lit(0).alias("start"), F.lit(0).alias("end")).where("false")
    plain = ~F.col("text").rlike(r"[^\x00-\x7F]|[\x1c-\x1f]|\s\s")
    low = F.lower(F.translate("text", "\t\n\r\x0b\x0c", "     "))
    own = F.transform(F.when(low.contains(needle), starts(low, F.lit(needle))), lambda s: F.struct(s.alias("start"), (s + n).alias("end")))
    tagged = pages.select("page_uid", "text", plain.alias("plain"))
    folds = F.arrow_udf(_places(needle), "array<struct<start:int,end:int>>")
    found = tagged.select("page_uid", F.when(F.col("plain"), own).otherwise(folds(F.when(~F.col("plain"), F.col("text")))).alias("found"))
    return found.select("page_uid", F.explode("found").alias("f")).select("page_uid", "f.start", "f.end")


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of spans of one page that overlap; b's columns get the suffix _2."""
    other = b.select("page_uid", *(F.col(c).alias(f"{c}_2") for c in b.columns if c != "page_uid"))
    return a.join(other, "page_uid").where("start < end_2 AND end > start_2")


# --- names -------------------------------------------------------------

# What a language model takes for a name but is none.
NAME_STOPWORDS = frozenset(
    """retten byretten landsretten landsret højesteret hoejesteret handelsretten statsforvaltningen familieretshuset politiet
anklagemyndigheden ankestyrelsen skattestyrelsen udlændingestyrelsen kommune kommunen regionen staten domstolsstyrelsen advokatnævnet
retslægerådet arbejdsretten januar februar marts april maj juni juli august september oktober november december mandag tirsdag onsdag
torsdag fredag lørdag søndag cpr cvr tlf telefon mobil mail e-mail journalnr sagsnr adresse postnr att bilag side dato reg.nr kontonr
hr fru frk hr. fru. frk. mr mrs ms miss dr sir madam mr. mrs. ms. dr.""".split()
)
# Institutions, and what stands before the seat of a court.
INSTITUTIONS = r"^(?:Retten|Byretten|Landsretten|Østre|Vestre|Højesteret|Sø-\s*og\s*Handelsretten|Statsforvaltningen|Familieretshuset|Politiet|Anklagemyndigheden)(?![\wæøå])"


COURT_SEAT = r"(?:Retten|Byretten|Landsretten|Sø-\s*og\s*Handelsretten|Familieretshuset|Politiet)\s+i\s*$"
NAMES = (E.PERSON, E.ORGANIZATION, E.LOCATION)


def plausible_names(names: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Of spans of names those that are no institution, number, stop word, abbreviation or scanning noise.

    With pages (page_uid, text) the seat of a court is none either. names may bring a tagger's evidence: has_name (some word is a proper noun),
    keeps_capital (its lemma is), is_name_lower (some word is one when written small; null where that was not asked) and words.
    A span that fails by is_name_lower alone is saved if all its words stand in spans of the page that pass.
    """
    from docveil.functions.text import looks_like_words

    v = F.btrim("value")
    none = v.rlike(INSTITUTIONS) | v.rlike(r"\d")
    noise = F.lower(v).isin(*sorted(NAME_STOPWORDS)) | (F.length(v) < 2) | ~looks_like_words(v) | ((F.length(v) <= 4) & (F.upper(v) == v) & (F.lower(v) != v))
    rows = names
    if pages is not None:
        rows = rows.join(by_exchange(pages.select("page_uid", F.col("text").alias("__text"))), "page_uid", "left")
        before = F.substring("__text", F.greatest(F.col("start") - 40, F.lit(0)) + 1, F.least(F.col("start"), F.lit(40)))
        noise = noise | ((F.col("entity") == E.LOCATION) & F.coalesce(before.rlike(COURT_SEAT), F.lit(False)))
    other = ~F.col("entity").isin(*NAMES)
    if "has_name" not in names.columns:
        return rows.where(other | ~(none | noise)).select(*names.columns)
    named = ~none & F.col("has_name") & F.col("keeps_capital")
    asked = F.coalesce(F.col("is_name_lower"), F.lit(True))
    tagged = rows.withColumns({"__sure": ~other & named & asked, "__low": F.transform("words", lambda w: F.lower(w)), "__keep": other | (named & asked & ~noise), "__try": ~other & named & ~asked})
    sure = tagged.where("__sure").groupBy("page_uid").agg(F.array_distinct(F.flatten(F.collect_list("__low"))).alias("__known"))
    known = F.coalesce("__known", F.array().cast("array<string>"))
    saved = F.col("__try") & (F.size("__low") > 0) & (F.size(F.array_except("__low", known)) == 0)
    return tagged.join(by_exchange(sure), "page_uid", "left").where(F.col("__keep") | saved).select(*names.columns)


def first_seen(table: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first by order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return table.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")

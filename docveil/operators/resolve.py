"""Findings to groups, groups to pseudonyms, and both to texts.

Findings: (page_uid, pos, entity, key, value, start, end, score, role_hint);
pos orders findings over the whole collection.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docveil.functions import entities as E
from docveil.functions.geometry import same_places
from docveil.functions.text import collapse, normalize_value, role_alternatives, role_pattern
from docveil.shared import by_exchange, materialize, running_sum

# Words of roles, and the mark of contradicting ones.
PROFESSIONAL = (
    "advokatfuldmægtig", "advokaten", "advokat", "adv.", "beskikket forsvarer", "forsvareren", "forsvarer", "anklageren", "anklager", "retsformanden", "retsformand", "dommeren",
    "dommer", "domsmændene", "domsmand", "nævning", "bisidder", "kurator", "protokolfører", "retsassessor", "byretsdommer", "landsdommer", "sagsbehandler",
)
PARTIES = (
    "sagsøgeren sagsøger sagsøgte tiltalte sigtede vidnet vidne forurettede klageren klager indklagede rekvirenten rekvirent rekvisitus "
    "skyldneren skyldner kreditor ansøgeren ansøger"
).split()
MIXED = "blandet"
LOOK_BACK, LOOK_AHEAD = 80, 30
LEAST_NAME_WORD = 4


_ANY_ROLE = role_pattern([*PROFESSIONAL, *PARTIES])


def professional(hint: Column) -> Column:
    return hint.rlike(f"(?i)^(?:{role_alternatives(PROFESSIONAL)})$")


def role_hint(text: Column, start: Column, end: Column) -> Column:
    """The role word nearest before a name on its line, else one that follows at once; lower case, '' if none."""
    before = F.substring_index(F.substring(text, F.greatest(start - LOOK_BACK, F.lit(0)) + 1, F.least(start, F.lit(LOOK_BACK))), "\n", -1)
    last = F.try_element_at(F.regexp_extract_all(before, F.lit("(?i)" + _ANY_ROLE), F.lit(1)), F.lit(-1))
    after = F.substring(text, end + 1, LOOK_AHEAD)
    follow = F.regexp_extract(after, r"(?i)^.{0,2}?" + _ANY_ROLE, 1)
    return F.lower(F.coalesce(last, follow, F.lit("")))


def findings(spans: DataFrame, pages: DataFrame, names: bool = True) -> DataFrame:
    """Spans with key, role_hint, context, label and uid. Keys that are missing are worked out once for each distinct value, from spans that are written first, so nothing finds them twice.

    Spans that bring their context need no text; only persons do, for their roles, and without names there are none.
    """
    from docveil.functions.text import context_for

    keyed = spans
    if "key" not in spans.columns:
        spans = materialize(spans, "spans")
        keys = spans.select("entity", "value").distinct().withColumn("key", normalize_value(F.col("entity"), F.col("value")))
        keyed = spans.join(keys, ["entity", "value"])
    texts = by_exchange(pages.select("page_uid", "text", F.col("pos").alias("page_pos"), F.col("label").alias("page_label")))

    def with_text(rows: DataFrame) -> DataFrame:
        hint = F.when(F.col("entity") == E.PERSON, role_hint(F.col("text"), F.col("start"), F.col("end"))).otherwise(F.lit(""))
        return rows.drop("context").join(texts, "page_uid").withColumn("role_hint", hint).withColumn("context", context_for(F.col("text"), F.col("start"), F.col("end"))).drop("text")

    if "context" not in spans.columns:
        placed = with_text(keyed)
    else:
        ready = F.col("context").isNotNull() & (F.col("entity") != E.PERSON)
        placed = keyed.where(ready).join(texts.drop("text"), "page_uid").withColumn("role_hint", F.lit(""))
        placed = placed.unionByName(with_text(keyed.where(~ready))) if names else placed
    return placed.withColumn("uid", F.concat_ws(":", "page_uid", "start", "end")).withColumn("pos", F.struct("page_pos", "start", "end")).drop("page_pos")


def group_findings(found: DataFrame) -> DataFrame:
    """(entity, key): n, display, role_hint, first_pos.

    display is the most frequent spelling, then the shortest, then the first
    seen; role_hint is empty, the only one, or MIXED. Two partial aggregates, no window.
    """
    spelled = found.withColumn("spelling", collapse(F.col("value"))).groupBy("entity", "key", "spelling").agg(
        F.count("*").alias("n"), F.min("pos").alias("first"), F.collect_set(F.when(F.col("role_hint") != "", F.col("role_hint"))).alias("hints")
    )
    best = F.min_by("spelling", F.struct(-F.col("n"), F.length("spelling"), F.col("first")))
    grouped = spelled.groupBy("entity", "key").agg(F.sum("n").alias("n"), best.alias("display"), F.array_distinct(F.flatten(F.collect_list("hints"))).alias("hints"), F.min("first").alias("first_pos"))
    hint = F.when(F.size("hints") == 0, F.lit("")).when(F.size("hints") == 1, F.element_at("hints", 1)).otherwise(F.lit(MIXED))
    return grouped.select("entity", "key", "n", "display", hint.alias("role_hint"), "first_pos")


def review_order(groups: DataFrame) -> DataFrame:
    """Groups with their rank in a review: entity, professional or mixed roles first, frequent first, name. Ranks are dealt by ranges, no task gets all groups."""
    ahead = F.when((F.col("role_hint") == MIXED) | professional(F.col("role_hint")), 0).otherwise(1)
    order = [E.review_rank(F.col("entity")), ahead, F.desc("n"), F.lower("display"), F.col("key")]
    return running_sum(materialize(groups, "groups"), order, F.lit(1), "rank").withColumn("rank", F.col("rank") + 1)


def stem(entity: Column, hint: Column) -> Column:
    """A pseudonym's stem: a person's only professional role, else the entity's label."""
    role = (entity == E.PERSON) & (hint != "") & (hint != MIXED) & professional(hint)
    return F.when(role, F.concat(F.upper(F.substring(hint, 1, 1)), F.substring(hint, F.lit(2), F.length(hint)))).otherwise(E.entity_label(entity))


def assign_pseudonyms(groups: DataFrame, by_key_alone: bool = False) -> DataFrame:
    """(entity, key, label, display, n): numbered by stem in the order in which groups are first seen, by ranges of groups.

    by_key_alone gives one label to a key that occurs under several entities,
    that of the entity last in review order.
    """
    if by_key_alone:
        latest = groups.groupBy("key").agg(F.max_by(F.struct("entity", "n", "display", "role_hint"), F.struct(E.review_rank(F.col("entity")), F.col("entity"))).alias("g"), F.min("first_pos").alias("first_pos"))
        groups = latest.select("g.entity", "key", "g.n", "g.display", "g.role_hint", "first_pos")
    named = groups.withColumn("stem", stem(F.col("entity"), F.col("role_hint")))
    numbered = running_sum(materialize(named, "groups"), [F.col("stem"), F.col("first_pos"), F.col("entity"), F.col("key")], F.lit(1), "number", reset="stem")
    return numbered.withColumn("label", F.concat_ws(" ", "stem", F.col("number") + 1)).select("entity", "key", "label", "display", "n")


def splice(text: Column, edits: Column) -> Column:
    """text with replacements array<struct<start, end, label>> put in.

    In the order of starts, longer first, an edit that begins before the last
    one's end is skipped.
    """
    ordered = F.array_sort(F.transform(edits, lambda e: F.struct(e["start"].alias("start"), (-e["end"]).alias("minus"), e["label"].alias("label"))))
    begin = F.struct(F.lit(0).cast("int").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        end = -e["minus"]
        put = F.struct(end.cast("int").alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, e["start"] - acc["at"]), e["label"]).alias("out"))
        return F.when(e["start"] < acc["at"], acc).otherwise(put)

    return F.aggregate(ordered, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def render(pages: DataFrame, found: DataFrame, pseudonyms: DataFrame, keys: tuple[str, ...] = ("entity", "key")) -> DataFrame:
    """(page_uid, pos, label, rendered): each page's text with pseudonyms; pages without any stay as they are."""
    edits = found.join(pseudonyms.select(*keys, F.col("label").alias("put")), list(keys)).groupBy("page_uid").agg(F.collect_list(F.struct("start", "end", F.col("put").alias("label"))).alias("edits"))
    joined = pages.join(by_exchange(edits), "page_uid", "left")
    return joined.select("page_uid", "pos", "label", F.when(F.col("edits").isNull(), F.col("text")).otherwise(splice(F.col("text"), F.col("edits"))).alias("rendered"))


def page_marker(label: Column) -> Column:
    return F.concat(F.lit("\n\n===== "), label, F.lit(" =====\n\n"))


def render_document(rendered: DataFrame, by: str = "doc") -> DataFrame:
    """One text for each document: marked, stripped pages in order."""
    part = F.concat(page_marker(F.col("label")), F.btrim(F.col("rendered"), F.lit(" \t\r\n")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))), lambda p: p["part"])
    return rendered.groupBy(by).agg(F.concat(F.btrim(F.array_join(parts, ""), F.lit(" \t\r\n")), F.lit("\n")).alias("text"))


def overview(pseudonyms: DataFrame) -> DataFrame:
    """(label, original, type, n) with originals fit for a Markdown cell, in review order."""
    cell = F.replace(F.replace(F.col("display"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return pseudonyms.select("label", cell.alias("original"), E.review_label(F.col("entity")).alias("type"), "n")


OVERVIEW_WARNING = "Oversigt over pseudonymier. Du må ikke uploade disse til AI."


def overview_lines(rows: DataFrame, markdown: bool = True) -> DataFrame:
    """(seq, line) of an overview's rows by label, with the warning first; plain text has padded columns. Lines are numbered by ranges, so no task gets them all."""
    line = F.format_string("| %s | %s | %s | %d |", "label", "original", "type", "n") if markdown else F.concat(F.rpad("label", 24, " "), F.rpad("original", 40, " "), F.rpad("type", 24, " "), F.col("n").cast("string"))
    head = [OVERVIEW_WARNING, "", *(["| Pseudonym | Original | Type | Antal |", "|---|---|---|---|"] if markdown else [])]
    placed = running_sum(rows.select("label", line.alias("line")), [F.col("label"), F.col("line")], F.lit(1), "seq").select((F.col("seq") + len(head)).cast("long").alias("seq"), "line")
    first = rows.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, head))).alias("seq", "line"))
    return first.select(F.col("seq").cast("long").alias("seq"), "line").unionByName(placed)


def write_overview(lines: DataFrame, path: str) -> None:
    """An overview's lines as text below path: files that follow each other by name, each in order."""
    lines.repartitionByRange("seq").sortWithinPartitions("seq").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


# --- propagation of names ----------------------------------------------


def name_variants(found: DataFrame) -> DataFrame:
    """(pattern, key): words of names of several words, and neighbouring words glued together.

    A pattern of one owner leads to the owner's key, one of several to its own.
    """
    from docveil.operators.detect import NAME_STOPWORDS

    words = F.filter(F.split("value", r"(?U)[^\w]+"), lambda w: w.rlike(r"^\p{Lu}") & ~w.rlike(r"\d"))
    own = F.filter(F.col("caps"), lambda w: (F.length(w) >= LEAST_NAME_WORD) & ~F.lower(w).isin(*sorted(NAME_STOPWORDS)))
    glued = F.zip_with(F.slice("caps", F.lit(1), F.size("caps") - 1), F.slice("caps", F.lit(2), F.size("caps") - 1), lambda a, b: F.concat(a, b))
    names = found.where(F.col("entity") == E.PERSON).select("key", words.alias("caps")).where(F.size("caps") >= 2)
    patterns = names.select("key", F.explode(F.concat(own, glued)).alias("pattern"))
    owners = patterns.groupBy("pattern").agg(F.min("key").alias("one"), F.count_distinct("key").alias("n"))
    return owners.select("pattern", F.when(F.col("n") == 1, F.col("one")).otherwise(normalize_value(F.lit(E.PERSON), F.col("pattern"))).alias("key"))


#: Patterns of one automaton; a larger dictionary is dealt into parts, each of which takes a pass over the texts.
MOST_PATTERNS = 1 << 17
_LETTER = re.compile(r"[\wæøåÆØÅ]")


def lowered(text: str) -> str:
    """text in lower case with as many characters as before."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _finder(patterns: list[str], word_bounds: bool):
    """A function from texts to the places of all patterns in them, found in one run over each text."""
    held = []

    def find(texts: pa.Array) -> pa.Array:
        import ahocorasick

        if not held:
            automaton = ahocorasick.Automaton()
            for k, p in enumerate(patterns):
                automaton.add_word(p, (k, len(p)))
            automaton.make_automaton()
            held.append(automaton)
        out = []
        for each in texts:
            text, found = each.as_py() or "", []
            for last, (k, n) in held[0].iter(lowered(text)):
                low, high = last + 1 - n, last + 1
                if not word_bounds or not ((low and _LETTER.match(text[low - 1])) or (high < len(text) and _LETTER.match(text[high]))):
                    found.append({"start": low, "end": high, "low": patterns[k], "value": text[low:high]})
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("low", pa.string()), ("value", pa.string())])))

    return find


def places_of(pages: DataFrame, variants: DataFrame, word_bounds: bool = False) -> DataFrame:
    """(page_uid, start, end, low, value): every place of every pattern of variants(low) in pages(page_uid, text), whatever its case; overlapping ones too."""
    found, parts = None, max(1, -(-variants.count() // MOST_PATTERNS))
    for k in range(parts):
        own = sorted(r[0] for r in variants.where(F.pmod(F.xxhash64("low"), F.lit(parts)) == k).select("low").collect())
        if own or found is None:
            find = F.arrow_udf(_finder(own, word_bounds), "array<struct<start:int,end:int,low:string,value:string>>")
            hits = pages.where(F.lit(bool(own))).select("page_uid", F.explode(find("text")).alias("h")).select("page_uid", "h.*")
            found = hits if found is None else found.unionByName(hits)
    return found


def propagate_names(pages: DataFrame, found: DataFrame, word_bounds: bool = False) -> DataFrame:
    """Further places of known names: (page_uid, entity, key, value, start, end, score).

    Places of a pattern are found case-insensitively and, unless word_bounds,
    also inside longer words. All patterns are looked for in one run over each text; texts are not moved, places
    are met with their keys by an equi-join. Of overlapping places the leftmost stays, the longest of those; those over a known finding are dropped.
    """
    variants = name_variants(found).groupBy(F.lower("pattern").alias("low")).agg(F.min("key").alias("key"))
    variants = materialize(variants, "variants")
    placed = places_of(pages, variants, word_bounds).join(variants, "low")
    known = found.select(F.col("page_uid").alias("p2"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    fresh = placed.join(known, (F.col("page_uid") == F.col("p2")) & (F.col("start") < F.col("e2")) & (F.col("end") > F.col("s2")), "left_anti")
    rows = fresh.groupBy("page_uid").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("minus"), "key", "value"))).alias("s"))

    def step(kept: Column, s: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        return F.when((F.size(kept) > 0) & (s["start"] < -last["minus"]), kept).otherwise(F.concat(kept, F.array(s)))

    kept = F.aggregate("s", F.slice("s", 1, 0), step)
    return rows.select("page_uid", F.explode(kept).alias("s")).select("page_uid", F.lit(E.PERSON).alias("entity"), "s.key", "s.value", "s.start", (-F.col("s.minus")).cast("int").alias("end"), F.lit(0.99).alias("score"))


# --- session -----------------------------------------------------------


def remember(groups: DataFrame, selected: DataFrame) -> DataFrame:
    """(key, selected): a key is selected if any of its findings is. selected has the key of each chosen finding."""
    chosen = selected.select("key").distinct().withColumn("selected", F.lit(True))
    return groups.select("key").distinct().join(chosen, "key", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def preselect(found: DataFrame, decisions: DataFrame) -> DataFrame:
    """Findings with selected: as decided before for the key, else true."""
    return found.join(decisions, "key", "left").withColumn("selected", F.coalesce("selected", F.lit(True)))


def tree_state(found: DataFrame) -> DataFrame:
    """(entity, key, n, n_selected, state): none, all or partial."""
    n = F.sum(F.col("selected").cast("long"))
    state = F.when(n == 0, "none").when(n == F.count("*"), "all").otherwise("partial")
    return found.groupBy("entity", "key").agg(F.count("*").alias("n"), n.alias("n_selected"), state.alias("state"))


def filter_groups(found: DataFrame, needle: str) -> DataFrame:
    """Keys of groups whose spellings or contexts hold the needle, without regard to case."""
    low = needle.lower()
    return found.groupBy("entity", "key").agg(F.bool_or(F.lower("value").contains(low) | F.lower("context").contains(low)).alias("hit")).where("hit").drop("hit")


def redaction_items(found: DataFrame, existing: DataFrame, sources: tuple[str, ...] = ("presidio", "search")) -> DataFrame:
    """Selected findings whose rectangles no existing redaction of these sources covers.

    found has page_uid, selected and rects; existing has page_uid, kind, source and rects. Rectangles meet by the cells of their corners,
    each place of a page once, so no page's rectangles are compared with all of its marks.
    """
    marks = existing.where((F.col("kind") == "redact") & F.col("source").isin(*sources))
    chosen = found.where("selected")
    asked = chosen.select("page_uid", "rects").distinct()
    each = asked.select("page_uid", "rects", F.explode("rects").alias("r"))
    met = same_places(each.select("page_uid", "r").distinct(), marks.select("page_uid", F.explode("rects").alias("d")).distinct())
    full = each.join(by_exchange(met.withColumn("hit", F.lit(True))), ["page_uid", "r"], "left").groupBy("page_uid", "rects").agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("full")).where("full").drop("full")
    empty = asked.where("coalesce(size(rects), 0) <= 0").join(marks.select("page_uid").distinct(), "page_uid", "left_semi")
    covered = full.unionByName(empty).select(F.col("page_uid").alias("__page"), F.col("rects").alias("__rects"))
    return chosen.join(by_exchange(covered), (F.col("page_uid") == F.col("__page")) & F.col("rects").eqNullSafe(F.col("__rects")), "left_anti")


def escape_all(patterns: list[str]) -> str:
    """One alternation, the longest first."""
    return "|".join(re.escape(p) for p in sorted(patterns, key=lambda p: (-len(p), p)))

"""Catalogues of translations as lines of text, and the messages that source code asks for.

A record is a run of lines: comments, then keywords with quoted strings, of which each may go on over
further lines. What a line belongs to follows from the lines before it, by windows over ranges of each catalogue
and what the ranges before hand on, so no task holds a catalogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docveil.shared import materialize, running_sum

_KEYWORD = r"^\s*(msgctxt|msgid_plural|msgid|msgstr(?:\[[0-9]+\])?)\s*\""
_QUOTED = r"^[^\"]*\"((?:[^\"\\]|\\.)*)\"\s*$"
#: A call for a message with string literals behind each other; what is formatted is none.
_CALL = r"(?s)(?<![\w.])N?_\(\s*((?:[rRuU]?(?:\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')\s*)+)[,)]"
_LITERAL = r"[rRuU]?(?:\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"


def unescaped(text: Column) -> Column:
    """A string literal's inside with its escapes resolved."""
    held = F.replace(text, F.lit("\\\\"), F.lit("\u0001"))
    for mark, letter in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ('\\"', '"'), ("\\'", "'")):
        held = F.replace(held, F.lit(mark), F.lit(letter))
    return F.replace(held, F.lit("\u0001"), F.lit("\\"))


def escaped(text: Column) -> Column:
    for letter, mark in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        text = F.replace(text, F.lit(letter), F.lit(mark))
    return text


def read_catalogues(lines: DataFrame) -> DataFrame:
    """(lang, context, msgid, plural, value, fuzzy) of lines (lang, seq, text).

    A record begins with its id, or the context before that, whether or not an empty line stands there. The header,
    which has no id, and records that are out of use are passed over; of several forms of a translation the first is taken.
    """
    spark = lines.sparkSession
    live = lines.where(~F.coalesce(F.col("text").startswith("#~"), F.lit(True))).withColumn("own", F.nullif(F.regexp_extract("text", _KEYWORD, 1), F.lit("")))
    dealt = materialize(live.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "lang", "seq").withColumn("__range", F.spark_partition_id()), "catalogue")
    # The keyword that a range begins under: one row for each range and catalogue.
    ends = dealt.groupBy("lang", "__range").agg(F.max(F.when(F.col("own").isNotNull(), F.struct("seq", "own")))["own"].alias("end"))
    carried = ends.select(F.col("lang").alias("__lang"), F.col("__range").alias("__at"), F.last("end", ignorenulls=True).over(Window.partitionBy("lang").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    w = Window.partitionBy("__range", "lang").orderBy("seq")
    spoken = lambda upto: F.coalesce(F.last("own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, upto)), F.col("carried"))
    told = dealt.join(F.broadcast(carried), F.col("lang").eqNullSafe(F.col("__lang")) & (F.col("__range") == F.col("__at"))).withColumns({"last": spoken(0), "before": spoken(-1)})
    goes_on = F.col("own").isNull() & F.col("text").rlike(r"^\s*\"")
    kind = F.when(F.col("own").isNotNull() | goes_on, F.col("last")).otherwise(F.lit(""))
    after_context = F.coalesce(F.col("before") == "msgctxt", F.lit(False))
    opens = F.when(F.coalesce(F.col("own").isin("msgid", "msgctxt"), F.lit(False)) & ~after_context, 1).otherwise(0)
    numbered = running_sum(told.select("lang", "seq", "text", kind.alias("kind"), opens.alias("opens")), [F.col("lang"), F.col("seq")], F.col("opens"), "opened", reset="lang")
    # Comments stand before what opens a record, so they count as of the next one.
    record = F.col("opened") + F.col("opens") + F.when(F.col("text").startswith("#"), 1).otherwise(0)
    parts = numbered.withColumn("record", record).withColumn("part", F.when(F.col("kind") != "", unescaped(F.regexp_extract("text", _QUOTED, 1))))
    joined = parts.groupBy("lang", "record", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "part"))), lambda p: p["part"]), "").alias("whole"), F.bool_or(F.col("text").rlike(r"^#,.*\bfuzzy\b")).alias("fuzzy"))
    of = lambda *kinds: F.max(F.when(F.col("kind").isin(*kinds), F.col("whole")))
    rows = joined.groupBy("lang", "record").agg(of("msgctxt").alias("context"), of("msgid").alias("msgid"), of("msgid_plural").alias("plural"), of("msgstr", "msgstr[0]").alias("value"), F.bool_or("fuzzy").alias("fuzzy"))
    return rows.where("msgid <> ''").select("lang", "context", "msgid", "plural", "value", "fuzzy")


def _field(name: str, value: Column) -> Column:
    """A keyword's lines: one, or an empty string and a line for each line of the value."""
    pieces = F.filter(F.split(F.replace(value, F.lit("\n"), F.lit("\n\u0001")), "\u0001"), lambda p: p != "")
    quoted = lambda p: F.concat(F.lit('"'), escaped(p), F.lit('"'))
    one = F.array(F.concat(F.lit(name + " "), quoted(value)))
    return F.when(value.isNull(), F.array().cast("array<string>")).when(F.size(pieces) > 1, F.concat(F.array(F.lit(name + ' ""')), F.transform(pieces, quoted))).otherwise(one)


def catalogue_lines(entries: DataFrame) -> DataFrame:
    """(lang, seq, text): entries (lang, context, msgid, plural, value, fuzzy) as lines, by id and context, with a header that names the language. The inverse of read_catalogues()."""
    value = F.coalesce("value", F.lit(""))
    body = F.concat(
        F.when(F.col("fuzzy"), F.array(F.lit("#, fuzzy"))).otherwise(F.array().cast("array<string>")), _field("msgctxt", F.col("context")), _field("msgid", F.col("msgid")), _field("msgid_plural", F.col("plural")),
        F.when(F.col("plural").isNull(), _field("msgstr", value)).otherwise(_field("msgstr[0]", value)), F.array(F.lit("")),
    )
    head = F.array(F.lit('msgid ""'), F.lit('msgstr ""'), F.concat(F.lit('"Language: '), F.col("lang"), F.lit('\\n"')), F.lit('"Content-Type: text/plain; charset=utf-8\\n"'), F.lit(""))
    rows = entries.select("lang", F.struct(F.lit(1).alias("k"), F.col("msgid"), F.coalesce("context", F.lit("")).alias("context")).alias("at"), body.alias("lines"))
    heads = entries.select("lang").distinct().select("lang", F.struct(F.lit(0).alias("k"), F.lit("").alias("msgid"), F.lit("").alias("context")).alias("at"), head.alias("lines"))
    each = rows.unionByName(heads).select("lang", "at", F.posexplode("lines").alias("k", "text"))
    order = [F.col(c) for c in ("lang", "at.k", "at.msgid", "at.context", "k")]
    return running_sum(each, order, F.lit(1), "seq", reset="lang").select("lang", F.col("seq").cast("int").alias("seq"), "text")


def source_messages(files: DataFrame) -> DataFrame:
    """(msgid): every message that code (path, text) asks for, with neighbouring literals joined, once."""
    code = F.regexp_replace("text", r"(?m)^\s*#.*$", "")
    calls = files.select(F.explode(F.regexp_extract_all(code, F.lit(_CALL), F.lit(1))).alias("call"))

    def inside(literal: Column) -> Column:
        bare = F.regexp_replace(literal, r"(?s)^[rRuU]?[\"'](.*)[\"']$", "$1")
        return F.when(literal.rlike("^[rR]"), bare).otherwise(unescaped(bare))

    return calls.select(F.array_join(F.transform(F.regexp_extract_all("call", F.lit(_LITERAL), F.lit(0)), inside), "").alias("msgid")).where("msgid <> ''").distinct()

"""Consistency of translation tables, and the reply of an update service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docveil.functions.text import is_newer, message_errors

# Languages with a catalogue, by code.
LANGUAGE_NAMES = {"da": "Dansk", "en": "English", "de": "Deutsch", "fr": "Français", "es": "Español", "nl": "Nederlands", "sv": "Svenska", "nb": "Norsk"}


def check_all(entries: DataFrame, source_ids: DataFrame, source_lang: str = "da") -> DataFrame:
    """(lang, msgid, problem): everything wrong with catalogue entries (lang, msgid, value, fuzzy).

    A fuzzy or untranslated entry has just that problem. source_ids (msgid) are
    those in use; ids that the source catalogue or another language lacks are named too.
    """
    found = F.when(F.col("fuzzy"), F.array(F.lit("fuzzy"))).when(F.coalesce("value", F.lit("")) == "", F.array(F.lit("untranslated"))).otherwise(message_errors(F.col("msgid"), F.col("value")))
    own = entries.select("lang", "msgid", F.explode(found).alias("problem"))
    known = entries.where(F.col("lang") == source_lang).select("msgid")
    unknown = source_ids.join(known, "msgid", "left_anti").select(F.lit("code").alias("lang"), "msgid", F.lit("not in catalogue").alias("problem"))
    langs = entries.agg(F.collect_set("lang").alias("langs")).first()[0]
    wanted = known.distinct().withColumn("lang", F.explode(F.array(*(F.lit(x) for x in langs)).cast("array<string>")))
    lost = wanted.join(entries.select("lang", "msgid"), ["lang", "msgid"], "left_anti").select("lang", "msgid", F.lit("missing").alias("problem"))
    return own.unionByName(unknown).unionByName(lost)


def missing(entries: DataFrame, source_lang: str = "da") -> DataFrame:
    """(msgid, langs): languages in which a message is fuzzy or untranslated."""
    open_ = entries.where((F.col("lang") != source_lang) & (F.col("fuzzy") | (F.coalesce("value", F.lit("")) == "")))
    return open_.groupBy("msgid").agg(F.array_sort(F.collect_set("lang")).alias("langs"))


def apply_table(entries: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, errors): translations of table (lang, msgid, value) put in, or, if any is wrong, nothing."""
    new = table.withColumnRenamed("value", "new")
    joined = new.join(entries.select("lang", "msgid", F.lit(True).alias("known")), ["lang", "msgid"], "left")
    wrong = F.when(F.col("known").isNull(), F.array(F.lit("unknown"))).when(F.trim(F.coalesce("new", F.lit(""))) == "", F.array(F.lit("empty"))).otherwise(message_errors(F.col("msgid"), F.col("new")))
    errors = joined.select("lang", "msgid", F.explode(wrong).alias("problem"))
    if errors.limit(1).count():
        return entries, errors
    put = entries.join(new, ["lang", "msgid"], "left")
    done = put.withColumn("value", F.coalesce("new", "value")).withColumn("fuzzy", F.when(F.col("new").isNotNull(), False).otherwise(F.col("fuzzy")))
    return done.select(*entries.columns), errors


def fill_source(entries: DataFrame, source_lang: str = "da") -> DataFrame:
    """The source language's messages are their own translation."""
    own = (F.col("lang") == source_lang) & (F.col("fuzzy") | (F.coalesce("value", F.lit("")) == ""))
    return entries.withColumn("value", F.when(own, F.col("msgid")).otherwise(F.col("value"))).withColumn("fuzzy", F.when(own, False).otherwise(F.col("fuzzy")))


def get_text(ids: DataFrame, entries: DataFrame, lang: str) -> DataFrame:
    """ids (msgid) with text: the translation, or the id itself."""
    own = entries.where((F.col("lang") == lang) & ~F.col("fuzzy")).select("msgid", F.nullif(F.col("value"), F.lit("")).alias("text"))
    return ids.join(own, "msgid", "left").withColumn("text", F.coalesce("text", "msgid"))


def language_name(code: Column) -> Column:
    out = F.lit(LANGUAGE_NAMES["en"])
    for key, name in LANGUAGE_NAMES.items():
        out = F.when(code == key, name).otherwise(out)
    return out


REPLY = "available boolean, version string, file_name string, size string, sha256 string, release_notes string, download_url string, info_url string, published_at string"


def update_reply(replies: DataFrame, hosts: list[str], own: str, download_url: str, info_url: str) -> DataFrame:
    """Replies (id, raw JSON) with typed fields; addresses other than https on trusted hosts are replaced; no version, no row."""
    r = replies.select("id", F.from_json("raw", REPLY).alias("r")).select("id", "r.*").where("coalesce(available, true) AND trim(coalesce(version, '')) <> ''")

    def trusted(url: Column, instead: str) -> Column:
        good = (F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & F.try_parse_url(url, F.lit("HOST")).isin(*hosts)
        return F.when(good, F.trim(url)).otherwise(F.lit(instead))

    return r.select(
        "id", F.trim("version").alias("version"), F.coalesce("file_name", F.lit("")).alias("file_name"), F.coalesce(F.col("size").try_cast("long"), F.lit(0)).alias("size"),
        F.lower(F.trim(F.coalesce("sha256", F.lit("")))).alias("sha256"), F.trim(F.coalesce("release_notes", F.lit(""))).alias("release_notes"), trusted(F.col("download_url"), download_url).alias("download_url"),
        trusted(F.col("info_url"), info_url).alias("info_url"), F.coalesce("published_at", F.lit("")).alias("published_at"), is_newer(F.col("version"), F.lit(own)).alias("update_available"),
    )


def verify_download(files: DataFrame, expected: DataFrame) -> DataFrame:
    """files (path, content) with ok: their SHA-256 is the expected one (path, sha256)."""
    return files.join(expected, "path").select("path", (F.sha2("content", 256) == F.lower("sha256")).alias("ok"))

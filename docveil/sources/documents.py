"""Reading collections of document files and their metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docveil.operators.model import kind_for_path

PATTERN = "*.{pdf,PDF,jpg,jpeg,png,bmp,tiff,tif}"
_STAMP = r"D:([0-9]{4})([0-9]{2})([0-9]{2})([0-9]{2})?([0-9]{2})?"


def read_files(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """(path, modified, size_bytes, kind[, content]) of supported files below path; content is pruned unless asked for."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", PATTERN).option("recursiveFileLookup", "true").load(path)
    out = raw.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size_bytes"), kind_for_path(F.col("path")).alias("kind"), "content")
    return out if content else out.drop("content")


def pdf_stamp(value: Column) -> Column:
    """'YYYY-MM-DD HH:MM' from a PDF's date; missing hours and minutes are 00; null if there is no date."""
    part = lambda k: F.regexp_extract(value, _STAMP, k)
    filled = lambda k: F.when(part(k) == "", "00").otherwise(part(k))
    return F.when(part(1) != "", F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit(" "), filled(4), F.lit(":"), filled(5)))


def creation_date(created: Column, changed: Column, modified: Column | None = None) -> Column:
    """The first date that matches of a document's creation and change; else, if given, the file's own."""
    day = lambda v: F.substring(pdf_stamp(v), 1, 10)
    own = F.coalesce(day(created), day(changed))
    return own if modified is None else F.coalesce(own, F.date_format(modified, "yyyy-MM-dd"))


def file_dates(path: Column, created: Column, doc_created: Column, doc_changed: Column) -> Column:
    """struct<created, pdf_date>: the file's own date, and the document's, which does not fall back to the file's; '' where there is none."""
    own = F.when(kind_for_path(path) == "pdf", F.coalesce(pdf_stamp(doc_created), pdf_stamp(doc_changed)))
    return F.struct(F.coalesce(F.date_format(created, "yyyy-MM-dd HH:mm"), F.lit("")).alias("created"), F.coalesce(own, F.lit("")).alias("pdf_date"))


def read_postal_codes(spark: SparkSession, path: str) -> DataFrame:
    """(code, city) from a table of 'code;city' lines: the reference table that towns are held against."""
    return spark.read.csv(path, sep=";", schema="code int, city string").where("code IS NOT NULL")


def enc_status(path: Column, readable: Column, needs_password: Column, fits: Column) -> Column:
    """image, error, not_encrypted, decrypted (a known password fits) or encrypted."""
    return (
        F.when(kind_for_path(path) == "image", "image")
        .when(~readable, "error")
        .when(~needs_password, "not_encrypted")
        .when(fits, "decrypted")
        .when(needs_password, "encrypted")
        .otherwise("unknown")
    )


def pdf_markers(files: DataFrame) -> DataFrame:
    """(path, is_pdf, encrypted, page_count, created) of files with content, as far as their uncompressed bytes say."""
    text = F.decode("content", "ISO-8859-1")
    pages = F.regexp_extract_all(text, F.lit(r"/Type\s*/Page(?![a-zA-Z])"), F.lit(0))
    return files.select(
        "path", text.startswith("%PDF-").alias("is_pdf"), text.rlike(r"/Encrypt\s+\d+\s+\d+\s+R").alias("encrypted"), F.size(pages).alias("page_count"), pdf_stamp(F.regexp_extract(text, r"/CreationDate\s*\((D:[0-9]+)", 1)).alias("created")
    )


def metadata(files: DataFrame, info: DataFrame) -> DataFrame:
    """files with page_count, enc_key and creation_date from info (path, page_count, readable, needs_password, fits, created, changed); files without info are errors."""
    j = files.join(info, "path", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = enc_status(F.col("path"), yes("readable"), yes("needs_password"), yes("fits"))
    return j.select(*files.columns, F.when(F.col("kind") == "image", 1).otherwise(F.col("page_count")).alias("page_count"), status.alias("enc_key"), creation_date(F.col("created"), F.col("changed"), F.col("modified")).alias("creation_date"))


def write_texts(texts: DataFrame, path: str, fmt: str = "txt", packed: bool = False) -> None:
    """One text a row (doc, text), a folder for each document; plain text begins with a byte order mark.

    packed is for collections of very many documents: lines of JSON with doc and text in few large files.
    """
    if packed:
        texts.select("doc", "text").write.mode("overwrite").json(path)
        return
    mark = F.concat(F.lit("\ufeff"), F.col("text")) if fmt == "txt" else F.col("text")
    texts.select("doc", mark.alias("value")).write.mode("overwrite").partitionBy("doc").option("lineSep", "\n").text(path)

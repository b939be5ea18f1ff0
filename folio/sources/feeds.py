"""Atom feeds and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.text import decode_entities, paper_id


def feed_entries(xml: Column) -> Column:
    """Entries of an Atom feed: array<struct<id, title, published, authors, abstract>>. An id is all of its address behind /abs/, but for
    the version."""
    one = lambda e, tag: F.trim(F.regexp_replace(decode_entities(F.regexp_extract(e, f"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)), r"\s+", " "))
    body = F.split(xml, "<entry>")
    address = lambda e: F.regexp_extract(one(e, "id"), r"/abs/(.+?)(v\d+)?$", 1)
    named = lambda e: F.when(address(e) != "", address(e)).otherwise(paper_id(one(e, "id")))
    entries = F.slice(body, F.lit(2), F.greatest(F.size(body) - 1, F.lit(0)))
    names = lambda e: F.transform(F.regexp_extract_all(e, F.lit("(?s)<name>(.*?)</name>"), 1), decode_entities)
    return F.transform(entries, lambda e: F.struct(named(e).alias("id"), one(e, "title").alias("title"), F.substring(one(e, "published"), 1, 10).alias("published"), names(e).alias("authors"), one(e, "summary").alias("abstract")))


def feed_total(xml: Column) -> Column:
    """The feed's total number of results, 0 if it has none."""
    return F.coalesce(F.try_to_number(F.regexp_extract(xml, r"<opensearch:totalResults[^>]*>(\d+)<", 1), F.lit("999999999")).cast("long"), F.lit(0).cast("long"))


def entry_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of the entries of Atom pages that are put into a folder: id, title, published, authors, abstract, total (of the page).

    A row is read for each page, up to its closing tag, so a file may hold many. The total is read before the entries become rows,
    once a page.
    """
    pages = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).text(path, lineSep="</feed>")
    read = pages.select(feed_entries(F.col("value")).alias("entries"), feed_total(F.col("value")).alias("total"))
    return read.select(F.explode("entries").alias("e"), "total").select("e.*", "total")


def audio_key(paper: Column, version: Column) -> Column:
    """The blob key of a version's audio."""
    return F.concat_ws("/", F.lit("audio"), paper, F.concat(version.cast("string"), F.lit(".mp3")))


def transcript_key(paper: Column, version: Column) -> Column:
    """The blob key of a version's transcript."""
    return F.concat_ws("/", F.lit("transcripts"), paper, F.concat(version.cast("string"), F.lit(".txt")))


def append_rows(df: DataFrame, path: str) -> None:
    """Append rows as Parquet."""
    df.write.mode("append").parquet(path)


def write_blobs(df: DataFrame, path: str, key_col: str, text_col: str, by: str) -> None:
    """Texts as files below `path`, one folder for each value of `by`; the key is kept as a column of the file's table."""
    df.select(by, key_col, text_col).repartition(by).write.mode("append").partitionBy(by).parquet(path)

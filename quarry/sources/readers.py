"""Sources of documents: XML dumps, tables, JDBC databases, files that stream in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators import order as order_by

#: A page may hold several revisions: the first is its text.
PAGE = "title string, redirect struct<_title: string>, revision array<struct<text: string>>, _damaged string"
#: White space around texts belongs to them.
XML = {"rowTag": "page", "ignoreSurroundingSpaces": "false", "columnNameOfCorruptRecord": "_damaged"}


def read_xml_dump(spark: SparkSession, path: str) -> DataFrame:
    """(title, redirect_title, content, damaged, and where each page stands) of the pages of a dump: a file or a folder of files; compressed dumps too.

    A dump is cut behind each </page>, by many tasks also within a file (bzip2 too), and each page is parsed alone: one that is no well-formed
    XML, or is cut off by the end of the file, has its own source as damaged and harms no other. A page without a text has an empty one.
    Dumps with CDATA sections that hold </page> are not read rightly."""
    x = spark.read.text(path, lineSep="</page>").select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")).withColumn("_row", F.monotonically_increasing_id())
    begin = F.regexp_instr("value", F.lit("<page[\\s>]"))
    page = F.concat(F.col("value").substr(begin, F.length("value")), F.lit("</page>"))
    x = x.where(begin > 0).withColumn("_page", F.from_xml(page, PAGE, XML))
    content = F.coalesce(F.get("_page.revision", F.lit(0))["text"], F.lit(""))
    return x.select(F.col("_page.title").alias("title"), F.col("_page.redirect._title").alias("redirect_title"), content.alias("content"), F.col("_page._damaged").alias("damaged"), "_file", "_block", "_row")


def numbered(items: DataFrame, order: list[str], out: str = "doc_id") -> DataFrame:
    """Dense numbers from 0 in the given order, redirects included."""
    return order_by.numbered(items, order, out)


def limited(items: DataFrame, limit: int | None, id: str = "doc_id") -> DataFrame:
    """The first so many items, redirects counted; None: all."""
    return items if limit is None else items.where(F.col(id) < limit)


def without_redirects(items: DataFrame, redirect: Column | str = "redirect_title") -> DataFrame:
    c = F.col(redirect) if isinstance(redirect, str) else redirect
    return items.where(c.isNull() | (c == ""))


def _items(spark: SparkSession, path: str) -> DataFrame:
    return numbered(read_xml_dump(spark, path), ["_file", "_block", "_row"])


def corpus_from_xml(spark: SparkSession, path: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(doc_id, title, text): identifiers have gaps where redirects and damaged pages were."""
    items = limited(_items(spark, path), config.item_limit).where("damaged is null")
    return without_redirects(items).select("doc_id", "title", F.col("content").alias("text"))


def damaged_pages(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, damaged): the number and the source of each page of a dump that could not be parsed."""
    return _items(spark, path).where("damaged is not null").select("doc_id", "damaged")


def read_table(spark: SparkSession, source: str, **options: str) -> DataFrame:
    """A Parquet folder, a table of the catalog, or with url=... a JDBC table."""
    if "url" in options:
        return spark.read.format("jdbc").options(dbtable=source, **options).load()
    return spark.read.parquet(source) if "/" in source else spark.table(source)


def read_partitioned(spark: SparkSession, source: str, id: str = "doc_id", rows: int = 100_000, quote: str = '"', **options: str) -> DataFrame:
    """A JDBC table in partitions of about so many identifiers each, by ranges between its smallest and largest; rows without an identifier are in the first. quote: how the database quotes names.

    The bounds are asked of the database in one query; they only cut the ranges, so rows that arrive later are read as well. Filters reach the database."""
    low, high = spark.read.format("jdbc").options(query=f"SELECT MIN({quote}{id}{quote}) AS lo, MAX({quote}{id}{quote}) AS hi FROM {source}", **options).load().first()
    if low is None or high == low:
        return read_table(spark, source, **options)
    parts = max(1, -(-(int(high) - int(low) + 1) // rows))
    return spark.read.format("jdbc").options(dbtable=source, partitionColumn=id, lowerBound=int(low), upperBound=int(high) + 1, numPartitions=parts, **options).load()


def id_range(docs: DataFrame, start: int, number: int, id: str = "doc_id") -> DataFrame:
    """start <= id < start + number; reaches the scan as a pushed filter."""
    return docs.where((F.col(id) >= start) & (F.col(id) < start + number))


def corpus(spark: SparkSession, config: EngineConfig, xml: str = "", table: str = "", **options: str) -> DataFrame:
    """Documents from a table if the configuration says so or no dump is given, else from the dump."""
    return read_table(spark, table or "page", **options) if config.load_from_db or not xml else corpus_from_xml(spark, xml, config)

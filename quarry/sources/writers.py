"""Sinks: tables, created if missing, emptied or overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

TABLES = {"page": "doc_id BIGINT NOT NULL, title STRING NOT NULL, text STRING NOT NULL", "token": "stem STRING NOT NULL, df BIGINT, idf DOUBLE"}


def create_tables(spark: SparkSession) -> None:
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")


def clean_tables(spark: SparkSession) -> None:
    """Empties both tables."""
    for name in TABLES:
        if spark.catalog.tableExists(name):
            spark.sql(f"TRUNCATE TABLE {name}")


def save_documents(docs: DataFrame, table: str = "page") -> dict[str, int]:
    """Puts docs (doc_id, title, text, perhaps redirect_title) but redirects in place of what the table held, so that a second run changes nothing.

    Returns n_docs, n_redirects and largest_id, counted by the pass that writes."""
    seen = Observation()
    redirect = F.coalesce(F.col("redirect_title") != "", F.lit(False)) if "redirect_title" in docs.columns else F.lit(False)
    counted = docs.withColumn("_redirect", redirect).observe(seen, F.count_if(~F.col("_redirect")).alias("n_docs"), F.count_if("_redirect").alias("n_redirects"), F.max("doc_id").alias("largest_id"))
    counted.where(~F.col("_redirect")).select("doc_id", "title", "text").write.insertInto(table, overwrite=True)
    return seen.get


def save_idf(idf: DataFrame, table: str = "token") -> dict[str, int]:
    """Puts idf (stem, df, idf) in place of what the table held; returns n_tokens, counted by the pass that writes."""
    seen = Observation()
    idf.select("stem", "df", "idf").observe(seen, F.count("*").alias("n_tokens")).write.insertInto(table, overwrite=True)
    return seen.get


#: What XML 1.0 cannot carry in any form.
NOT_XML = "[^\\t\\n\\r\\x{20}-\\x{D7FF}\\x{E000}-\\x{FFFD}\\x{10000}-\\x{10FFFF}]"


def save_dump(items: DataFrame, path: str, files: int, compression: str = "bzip2") -> None:
    """Writes items (doc_id, title, text, perhaps redirect_title and revisions) as a page dump of at most so many files, in the order of doc_id.

    Read again, items have dense numbers in that order, redirects included. revisions (an array of texts) follow the text, which stays the
    page's text. A null text is written as an empty one, a null in revisions too; null identifiers come first, rows of one doc_id by title and
    text. Characters that XML cannot carry become U+FFFD. files: below 100,000, as the names of more are not in the order of their numbers."""
    if not 0 < files < 100_000:
        raise ValueError(f"a dump of {files} files")

    def carried(c):
        return F.regexp_replace(F.coalesce(c, F.lit("")), NOT_XML, "\ufffd")

    to = F.col("redirect_title") if "redirect_title" in items.columns else F.lit(None).cast("string")
    more = F.coalesce("revisions", F.array().cast("array<string>")) if "revisions" in items.columns else F.array().cast("array<string>")
    texts = F.concat(F.array(F.col("text")), more)
    x = items.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "title", "text")
    x = x.select(carried(F.col("title")).alias("title"), F.when(to != "", F.struct(carried(to).alias("_title"))).alias("redirect"), F.transform(texts, lambda t: F.struct(carried(t).alias("text"))).alias("revision"))
    x.write.format("xml").options(rootTag="mediawiki", rowTag="page", ignoreSurroundingSpaces="false", compression=compression).save(path)


def save(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)

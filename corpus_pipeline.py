"""The corpus pipeline: STAGES, applied one after the other to documents.

Each stage takes all that its predecessor kept and returns the same columns; the last returns token ids. A row is known by its
doc_id and a 64-bit hash of its text, so that rows which share a doc_id are told apart. Further columns of documents pass
through, whatever their names; operators see doc_id, text, source and columns of the stage's own only. In every stage a null
text is a text without words (of exact copies, equal to an empty one) whose ids are null, very long texts are read whole, and an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import exact_dedup, mixing, quality_crf, sentencepiece_codec, simhash
from quarry.llm.common import remove, tables, written

#: Decisions about at most so many documents (16 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: A document whose probability of good quality is below this goes.
LEAST_QUALITY = 0.3


def _key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """What an operator is to see of docs."""
    return docs.select("doc_id", "text", *columns, _key().alias("key"))


def _decided(docs: DataFrame, decisions: DataFrame, name: str, how: str) -> DataFrame:
    """docs joined to decisions about (doc_id, key), whose further columns are in a struct that docs cannot clash with."""
    decisions = written(decisions.select(F.struct("*").alias("_")), name)
    decisions = F.broadcast(decisions) if decisions.count() <= BROADCAST_ROWS else decisions
    own = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", _key().alias("key")).select("doc", F.struct("doc_id", "key").alias("at"))
    return own.join(decisions, F.col("at.doc_id").eqNullSafe(F.col("_.doc_id")) & (F.col("at.key") == F.col("_.key")), how)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, taught by all labels, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_crf.train(docs, labels, F.lit(True))
    boxed = docs.select("text", F.struct(*docs.columns).alias("doc"))
    return quality_crf.score(boxed, model).where(F.col("score") >= LEAST_QUALITY).select("doc.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row with the largest doc_id stays."""
    out = exact_dedup.exact_dedup(_keyed(docs), carry=["key"])
    # rows of one doc_id and text are equally good: all but one go, whichever
    per = out.groupBy("doc_id", "key").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("n > 1 or not kept")
    left = _decided(docs, per, "copies", "left")
    again = left.where("_.kept").select("at", "doc").groupBy("at").agg(F.first("doc").alias("doc"))
    return left.where("_ is null").select("doc.*").union(again.select("doc.*"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the rows with the smallest doc_id stay. Near copies: sets of shingles of five words with a similarity of 0.8 or more."""
    out = simhash.simhash_dedup(_keyed(docs), carry=["key"])
    gone = out.where("component_id is not null and not (doc_id <=> component_id)").select("doc_id", "key").distinct()
    return _decided(docs, gone, "near-copies", "left_anti").select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole number; documents without words stay once."""
    out = mixing.mix(_keyed(docs, "source"), carry=["key"]).where("size > 0")
    times = out.groupBy("doc_id", "key").agg(F.round(F.avg(F.col("taken") / F.col("size"))).cast("int").alias("times")).where("times <> 1")
    mixed = _decided(docs, times, "times", "left").withColumn("times", F.coalesce("_.times", F.lit(1)))
    return mixed.select("doc", F.explode(F.when(F.col("times") > 0, F.sequence(F.lit(1), F.col("times"))))).select("doc.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    out = sentencepiece_codec.sentencepiece_encode(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", keep_good), ("exact_dedup", drop_copies), ("simhash_dedup", drop_near_copies), ("mixing", mix_sources), ("sentencepiece", encode)]
#: A trained classifier has no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = len(tables(spark))
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        remove(spark, tables(spark)[before:-1])  # what the stage kept on its way, and the stage before it
    return STAGES[-1][1](spark, docs, sf_dir)

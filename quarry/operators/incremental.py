"""Document frequencies kept up to date by deltas of new, changed and deleted documents.

A table of versions: each version adds a segment with the stems of the documents it touched, and writes the vocabulary's document
frequencies anew, as those before it, less the stems that the touched documents had, plus those that they have now. A document's stems, one row of them, are
those of the latest version that touched it, so no segment is ever rewritten. A version counts once its commit is written, the last thing
it writes; what a lost attempt left is overwritten by the next. A batch that has a commit changes nothing when it is run again.

Defined results: a deleted document needs no text; a document without terms is kept without stems; of several rows of one doc_id in a delta the
terms are taken together; rows with a null doc_id are ignored; an empty delta makes a version equal to the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from .order import staged
from .terms import tokenized

SCHEMAS = {"commits": "version long, batch string", "touched": "doc_id long, version long", "stems": "doc_id long, version long, stem array<string>", "df": "stem string, df long"}


class TokenTable:
    def __init__(self, spark: SparkSession, path: str, config: EngineConfig = EngineConfig()):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config

    def _read(self, name: str, version: str = "v=*") -> DataFrame:
        """A table of all versions, or of one; empty where there is none."""
        where = f"{self.path}/{name}/{version}"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        found = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(hadoop)
        return self.spark.read.schema(SCHEMAS[name]).parquet(where) if found else self.spark.createDataFrame([], SCHEMAS[name])

    def _write(self, df: DataFrame, name: str, version: int) -> None:
        df.select(*(c.split()[0] for c in SCHEMAS[name].split(", "))).write.mode("overwrite").parquet(f"{self.path}/{name}/v={version}")

    def commits(self) -> dict[str, int]:
        """Version by batch: a row for each batch ever applied."""
        return {r.batch: r.version for r in self._read("commits").collect()}

    def document_frequency(self) -> DataFrame:
        """(stem, df) of the last version."""
        done = self.commits()
        return self._read("df", f"v={max(done.values())}") if done else self.spark.createDataFrame([], SCHEMAS["df"])

    def _stems(self, docs: DataFrame) -> DataFrame:
        """(doc_id, stem): each document's distinct stems, as an array; only rows of a doc_id that has several are moved."""
        rows = tokenized(docs, self.config).select("doc_id", F.array_distinct("tokens").alias("stem"))
        several = staged(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
        if not several.isEmpty():
            merged = rows.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("stem"))).alias("stem"))
            rows = rows.join(several, "doc_id", "left_anti").union(merged)
        return rows.where(F.size("stem") > 0)

    def apply(self, batch: str, delta: DataFrame) -> int:
        """The version after delta (doc_id, text, deleted); that of the first time if the batch has been applied before."""
        done = self.commits()
        if batch in done:
            return done[batch]
        last = max(done.values(), default=0)
        now = last + 1
        delta = delta.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("deleted", F.lit(False)).alias("deleted"))
        self._write(delta.select("doc_id").distinct().withColumn("version", F.lit(now)), "touched", now)
        self._write(self._stems(delta.where(~F.col("deleted"))).withColumn("version", F.lit(now)), "stems", now)
        touched = self._read("touched", f"v={now}").select("doc_id")
        before = self._read("touched").where(F.col("version") <= last).join(touched, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("version").alias("version"))
        had = self._read("stems").where(F.col("version") <= last).join(before, ["doc_id", "version"], "left_semi")
        each = F.explode("stem").alias("stem")
        change = self._read("stems", f"v={now}").select(each, F.lit(1).cast("long").alias("df")).union(had.select(each, F.lit(-1).cast("long").alias("df")))
        old = self._read("df", f"v={last}")
        self._write(old.union(change).groupBy("stem").agg(F.sum("df").alias("df")).where("df > 0"), "df", now)
        self._write(self.spark.createDataFrame([(now, batch)], SCHEMAS["commits"]).coalesce(1), "commits", now)
        return now

"""A total order over a whole table without one task that sees it all.

Rows are sorted by range and written once to the shared folder; then each partition begins where those before it end. What is
read twice is the written table: a second sort could cut its ranges elsewhere.
"""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a folder of our own, but only if the driver and all workers are one machine (tests)."""
    sc = spark.sparkContext
    if said := sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None):
        return said
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
    return Path(tempfile.gettempdir(), "checkpoints").as_uri()


def staged(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """df, sorted and written, with _part (number of the partition, in order) and _at (place in it)."""
    return staged(df.sort(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))


def _before(x: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """(_part, sums over all partitions before it): a row for each partition, so that one task and a broadcast do."""
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = x.groupBy("_part").agg(*(c.alias(k) for k, c in sums.items()))
    return F.broadcast(per.select("_part", *(F.coalesce(F.sum(k).over(w), F.lit(0)).alias(k) for k in sums)))


def numbered(df: DataFrame, order: list[str | Column], out: str) -> DataFrame:
    """Dense numbers from 0 in the given order, which must be total."""
    x = ranged(df, order)
    return x.join(_before(x, {"_n": F.count("*")}), "_part").withColumn(out, F.col("_n") + F.col("_at")).drop("_part", "_at", "_n")


def running(df: DataFrame, order: list[str | Column], columns: list[str]) -> DataFrame:
    """df with running_<c> for each of columns: its sum over the row and all before it in the given order, which must be total."""
    x = ranged(df, order)
    own = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    x = x.join(_before(x, {f"_{c}": F.sum(c) for c in columns}), "_part")
    return x.select(*df.columns, *((F.col(f"_{c}") + F.sum(c).over(own)).alias(f"running_{c}") for c in columns))

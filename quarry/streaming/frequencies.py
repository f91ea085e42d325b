"""Document frequencies of documents that arrive as a stream, each doc_id counted once, however often it is delivered.

State is keyed: the identifiers seen and the frequency of each stem, both in Spark's state store, spread over the shuffle partitions. A batch
writes the frequencies that it changed to a folder of its own, so a batch that runs again replaces its rows. A stream that starts again from
its checkpoint goes on where it ended. State grows with identifiers and vocabulary: for more than executors hold in memory, set
spark.sql.streaming.stateStore.providerClass to the RocksDB provider before the first start.

Defined results: rows with a null doc_id are ignored; documents without terms count for no stem; of several rows of one doc_id the first to
arrive counts. Rows of one doc_id within one batch are taken for deliveries of the same text: any one of them counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import EngineConfig
from ..operators.terms import tokenized


def count_stream(stream: DataFrame, out: str, checkpoint: str, config: EngineConfig = EngineConfig()) -> StreamingQuery:
    """Keeps the document frequencies of stream (doc_id, text) in out, and its state in checkpoint; ends when all that is there has been read."""
    seen = stream.where("doc_id is not null").select("doc_id", "text").dropDuplicates(["doc_id"])
    stems = tokenized(seen, config).select(F.explode(F.array_distinct("tokens")).alias("stem"))
    changed = stems.groupBy("stem").agg(F.count("*").alias("df"))

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return changed.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted(spark: SparkSession, out: str) -> DataFrame:
    """(stem, df) after the last batch written to out: frequencies only grow, so a stem's largest is its latest."""
    return spark.read.schema("stem string, df long").parquet(f"{out}/batch=*").groupBy("stem").agg(F.max("df").alias("df"))

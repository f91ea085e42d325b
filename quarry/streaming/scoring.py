"""New documents as a stream: each micro-batch is classified against a fixed corpus, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import EngineConfig
from ..operators.classify import knn_label, neighbors
from ..operators.terms import tfidf_of_new


def documents(spark: SparkSession, folder: str, schema: str = "doc_id long, text string", files: int = 100) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def classify_stream(stream: DataFrame, doc_terms: DataFrame, idf: DataFrame, n_docs: DataFrame, labels: DataFrame, out: str, checkpoint: str, config: EngineConfig = EngineConfig()) -> StreamingQuery:
    """Writes (new_id, knn_class) of each batch to its own folder of out, so that a batch that runs again replaces its rows."""

    def batch(df: DataFrame, number: int) -> None:
        near = neighbors(tfidf_of_new(df, idf, n_docs, config), doc_terms, labels, config, asked=df)
        knn_label(near).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

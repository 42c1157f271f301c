"""An extension: text files that arrive in a folder go into a store as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tamis.functions.text import normalize, title_of_name
from tamis.operators import embed
from tamis.plans.answering import ingest


def watch(spark: SparkSession, folder: str, path: str, checkpoint: str, embedder: embed.Embedder | None = None, *, until_empty: bool = False) -> StreamingQuery:
    """Ingest each new file of a folder once.  Replacing whole scopes makes a repeated batch harmless."""
    raw = spark.readStream.schema("value string").option("wholetext", True).text(folder).select("value", F.col("_metadata.file_path").alias("source_id"))
    name = F.element_at(F.split("source_id", "/"), -1)
    documents = raw.select(title_of_name(name).alias("title"), normalize(F.col("value")).alias("content"), "source_id")

    def take(batch: DataFrame, _: int) -> None:
        ingest(batch.sparkSession, path, batch, embedder)

    writer = documents.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if until_empty else writer).start()

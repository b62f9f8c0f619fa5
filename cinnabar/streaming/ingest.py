"""An optional stream of source files: new contents only, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cinnabar.sources.store import insert_or_ignore


def ingest(spark: SparkSession, source: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Add the new records of a streaming source (with code_content) to a table, batch by batch."""
    hashed = source.withColumn("code_hash", F.sha2("code_content", 256))
    write = lambda batch, _: insert_or_ignore(batch.sparkSession, batch, table)
    return hashed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Evidence nodes from files that arrive in a folder, each taken once; the upload queue of an online service as a stream."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from dossier.sources.tables import NODE_SCHEMA


def node_stream(spark: SparkSession, path: str, schema: str = NODE_SCHEMA, files_per_batch: int = 1000) -> DataFrame:
    """JSON lines under path as a stream; files_per_batch bounds a batch, not the stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def ingest(nodes: DataFrame, target: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Appends all that there is to Parquet under target, in `buckets` folders by a hash of the document, and ends. A failed batch is taken again from the checkpoint."""
    return nodes.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")).writeStream.format("parquet").partitionBy("bucket").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

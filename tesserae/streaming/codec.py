"""Containers from a stream of frames."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import container


def encode_stream(spark: SparkSession, source: str, schema: T.StructType, codec: container.Codec, *, array_col: str, to: str, checkpoint: str) -> StreamingQuery:
    """Encode each frame that arrives as Parquet in ``source`` once, into Parquet in ``to``; runs until what is there is done."""
    frames = spark.readStream.schema(schema).parquet(source)
    coded = container.encode(frames, codec, array_col=array_col).drop(array_col)
    return coded.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""An extension: photo files as a stream into the photo table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from geomill.functions import grid, times
from geomill.operators import ingest


def photo_stream(spark: SparkSession, path: str, schema: str, watermark: str = "1 day") -> DataFrame:
    """Normalised photos of new JSON files, one per key within the watermark of their capture time."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).json(path)
    rows = ingest.normalize(raw)
    rows = rows.withColumns({"captured_ts": times.parse_timestamp(F.col("Captured_At")), "cell": grid.encode(F.col("Latitude"), F.col("Longitude"))})
    return rows.withWatermark("captured_ts", watermark).dropDuplicatesWithinWatermark(["photo_key"])


def cell_counts(stream: DataFrame, resolution: int = 4, window: str = "1 hour", watermark: str = "1 day") -> DataFrame:
    """Photos of each window and cell; late ones count until the watermark passes."""
    rows = stream.where("cell is not null").withWatermark("captured_ts", watermark)
    return rows.groupBy(F.window("captured_ts", window), grid.parent(F.col("cell"), resolution).alias("query_cell")).agg(F.count(F.lit(1)).alias("n"))


def write_batches(stream: DataFrame, checkpoint: str, store: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Each micro-batch to store(batch, id), which must be idempotent by id; all that is there, then stop."""
    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

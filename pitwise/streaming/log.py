"""Streams around the forecast log and the landing directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from pitwise.schema import KEY


def read_files(
    spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet",
    per_trigger: int | None = None,
) -> DataFrame:
    """Files as they land; each is read once, whatever the number of restarts."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.format(fmt).load(path)


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def append_to(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """An append-only Parquet sink, exactly once per row.

    State lives in RocksDB on the executors, so that it need not fit their heap;
    keyed states with timers ask for it.
    """
    stream.sparkSession.conf.set(_PROVIDER, _ROCKS)
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def first_sight(stream: DataFrame, time: str, window: str, keys=(KEY,)) -> DataFrame:
    """Overlapping pulls reduced to one row per key within the watermark."""
    return stream.withWatermark(time, window).dropDuplicatesWithinWatermark(list(keys))


def resolve_stream(
    forecasts: DataFrame, outcomes: DataFrame, wait: str = "10 days", delay: str = "1 day"
) -> DataFrame:
    """Forecasts joined to outcomes that arrive within ``wait``; late ones stay unresolved.

    ``forecasts`` carries ``predicted_at``; ``outcomes`` is ``(match_id, result,
    settled_at)``. Both sides are bounded by watermarks, so state is dropped
    once a pair can no longer meet.
    """
    left = forecasts.withWatermark("predicted_at", delay).alias("f")
    right = outcomes.withWatermark("settled_at", delay).alias("o")
    near = (
        (F.col(f"f.{KEY}") == F.col(f"o.{KEY}"))
        & (F.col("o.settled_at") >= F.col("f.predicted_at"))
        & (F.col("o.settled_at") <= F.col("f.predicted_at") + F.expr(f"INTERVAL {wait}"))
    )
    return left.join(right, near, "leftOuter").select("f.*", F.col("o.result").alias("result"))

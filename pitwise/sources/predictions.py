"""The append-only log of served forecasts.

A batch is a folder of the log, written whole or not at all. Its number is claimed for its writer
and the writer's own count, so a batch that is repeated finds its folder and writes nothing, and
writers that work at the same time have numbers of their own: nothing is lost or told twice. The id
of a forecast is its batch's start plus its place in the batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from pitwise.schema import KEY, PREDICTION_SCHEMA, conform
from pitwise.session import durable
from pitwise.sources.claims import claim, exists

#: Ids of one batch: batch ``n`` begins at ``n`` times this.
BATCH_IDS = 1 << 40


def read(spark: SparkSession, path: str) -> DataFrame:
    """The whole log; one that nobody has written to yet is empty. Unreadable files are an error."""
    if not exists(spark, path):
        return spark.createDataFrame([], PREDICTION_SCHEMA)
    reader = spark.read.schema(PREDICTION_SCHEMA).option("recursiveFileLookup", "true")
    return reader.option("pathGlobFilter", "*.parquet").parquet(path)


def _numbered(batch: DataFrame, start: int) -> DataFrame:
    """Ids without gaps from ``start``: places inside each part, after the counts of the parts before."""
    placed = durable(
        batch.withColumn("_part", F.spark_partition_id()).withColumn(
            "_place", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
        ), "log-batch",
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).orderBy("_part").collect()
    starts, at = [], start  # one row per task of one batch
    for r in sizes:
        starts.append((r["_part"], at))
        at += r["_n"]
    table = batch.sparkSession.createDataFrame(starts, "_part int, _start long")
    return placed.join(table, "_part").withColumn("id", F.col("_start") + F.col("_place"))


def record(predictions: DataFrame, path: str, owner: str | None = None) -> bool:
    """Append one batch; ``False`` if ``owner``, who asks for it, has written it before.

    Without an owner it is a batch of its own. Numbers grow, so do ids from batch to batch.
    """
    spark = predictions.sparkSession
    number = claim(spark, f"{path}/_claims", owner or uuid.uuid4().hex)
    folder = f"{path}/batch={number:012d}"
    if exists(spark, f"{folder}/_SUCCESS"):
        return False
    # what an attempt that died left behind is replaced
    numbered = conform(_numbered(predictions, number * BATCH_IDS), PREDICTION_SCHEMA)
    numbered.write.mode("overwrite").parquet(folder)
    return True


def record_stream(stream: DataFrame, path: str, checkpoint: str, writer: str, **trigger) -> StreamingQuery:
    """A stream's forecasts into the log, each once, whatever restarts and replays come between."""

    def append(batch: DataFrame, number: int) -> None:
        record(batch, path, f"{writer}/{number}")

    return (
        stream.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def recent(log: DataFrame, limit: int) -> DataFrame:
    """The newest forecasts first: a distributed top-k, not a sort of the log."""
    return log.orderBy(F.col("predicted_at").desc(), F.col("id").desc(), F.col(KEY)).limit(limit)

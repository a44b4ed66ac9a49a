"""Session construction and the durable scratch area shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_LOCAL: dict[str, str] = {}  # one folder per application, only where none is named


def build_session(app: str = "pitwise", cores: str | None = None) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    cpus = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PITWISE_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    The cluster names a shared folder in ``spark.checkpoint.dir`` and that one
    is used as it is. Only a session on one machine may do without the setting:
    a local folder is created for it, once per application. On any other master
    that folder would be a different one on each executor, so it is refused.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_CONF, None
    )
    if named:
        return named
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"{CHECKPOINT_CONF} must name a shared folder on master {master}")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="pitwise-")
    return _LOCAL[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the scratch root; never reused, so never overwritten."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch area and read it back.

    Cuts the lineage at a table that outlives any executor, and makes a result
    that several later jobs read be computed once. The schema is passed on
    explicitly so the read needs no inference job. ``codec`` is for tables of
    which the size counts; the session's own is taken otherwise.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)

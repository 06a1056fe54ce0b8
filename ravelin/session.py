"""The session, and tables in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "ravelin", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; ``master`` only where none is set, as in tests."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='ravelin-')}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below the application's own, which can be removed when its results are written.

    Where ``spark.checkpoint.dir`` is unset, a temporary folder serves on one
    machine; elsewhere that is an error, since executors would write to their own disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own_dir()
    base = base.rstrip("/")
    return f"{base}/ravelin-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts the lineage of loops."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Small helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset and all
    runs on one machine, as in tests, a temporary folder is made once; elsewhere
    that is an error, since executors would write to their own disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = _own_dir()
    return path.rstrip("/")


@cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='ravelin-')}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the application's own folder, which can be removed when its results are written."""
    return f"{shared_dir(spark)}/ravelin-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage and lets several consumers read one computation; a lost
    executor loses nothing, since the files are not on its own disk.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(column: str | Column = "text") -> Column:
    """A hash that tells apart rows of one id with different texts."""
    return F.xxhash64(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")))


def range_count(spark: SparkSession, n_bytes: int | None, most: int = 64 << 20) -> int:
    """How many ranges to sort so many bytes in: as many as shuffles have, and more where those would be large."""
    return max(shuffle_partitions(spark), -(-(n_bytes or 0) // most))


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so that only few rows at a time become Python objects."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A batch's texts; null is the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]

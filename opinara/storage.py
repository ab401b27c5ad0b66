"""Tables written on the way, below the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; unset, it is an error, but in one local process, where it is a folder of our own."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir is unset: intermediate tables need a folder that all executors share")
        found = tempfile.mkdtemp(prefix="opinara-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: tuple[int, str] | None = None) -> DataFrame:
    """``df`` as a written table: computed once, with its lineage cut.

    ``by``: a number of buckets, and a column; joins on it with that many partitions then read the table in place.
    """
    path = fresh_path(df.sparkSession, name)
    if by:
        found = path.rpartition("/")[2].replace("-", "_")
        df.write.format("parquet").bucketBy(*by).option("path", path).saveAsTable(found)
        table = df.sparkSession.table(found)
        table._path, table._table = path, found
        return table
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._path = path  # so that dropped() finds it
    return table


def dropped(df: DataFrame) -> None:
    """Delete a table made by ``stored`` that no later plan reads."""
    spark = df.sparkSession
    if found := getattr(df, "_table", None):
        spark.sql(f"DROP TABLE {found}")
    where = spark._jvm.org.apache.hadoop.fs.Path(df._path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def once(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``df`` written for a block that reads it several times and keeps no plan on it; deleted at the end."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

"""Shared folder, written tables and small column helpers."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.storage import fresh_path

#: Characters that separate words: space and the five ASCII line and tab characters.
WORD_SPACE = "[\\x20\\x09-\\x0D]+"
#: Rows of a file, where a table's rows are known beforehand.
FILE_ROWS = 100_000
_TRIM = " \t\n\x0b\x0c\r"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = fresh_path(spark, name)
    if _scopes:
        _scopes[-1].append(path)
    return path


#: Paths made within each open ``released`` block.
_scopes: list[list[str]] = []


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, all paths made within; for blocks whose result is written elsewhere."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, with its lineage cut.

    ``rows``: about how many rows it has, where known; a small table then goes to few files.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(1, math.ceil(rows / FILE_ROWS)))
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path  # so that drop_written() finds it
    return table


def drop_written(df: DataFrame) -> None:
    """Delete a table made by ``written`` that no later plan reads."""
    delete(df.sparkSession, df._scratch)


def free(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The runs of characters other than WORD_SPACE, in order; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_TRIM))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_SPACE))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")

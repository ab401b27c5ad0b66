from __future__ import annotations

import os

from pyspark.sql import functions as F

from opinara.llm import common, mixing


def test_released_tables_are_gone(spark):
    with common.released(spark):
        table = common.written(spark.range(5), "some")
        assert table.count() == 5 and os.path.exists(table._scratch.removeprefix("file:"))
    assert not os.path.exists(table._scratch.removeprefix("file:"))
    kept = common.written(spark.range(5), "some")
    assert kept.count() == 5


def test_free_names(spark):
    df = spark.range(1).select(F.col("id").alias("__N"), F.col("id").alias("__n_"))
    assert common.free(df, "__n") == "__n__" and common.free(df, "other") == "other"


def test_rows_that_share_key_source_and_size(spark):
    rows = [(1, f"text {k}", "a") for k in range(6)] + [(1, "text 0", "a")] * 3 + [(None, "text n", "a")] * 4 + [(2, "x y z w", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("__mark", F.lit("m")).withColumn("__copies", F.lit("c")).withColumn("__n", F.lit("n"))
    one, two = (sorted(map(tuple, mixing.mixed(d).collect()), key=str) for d in (df, df.orderBy("text").repartition(3)))
    assert one == two and mixing.mixed(df).columns == df.columns
    want = {(r["source"], r["size"]): r["n"] for r in mixing.mix(df).groupBy("source", "size").agg(F.sum("copies").alias("n")).collect()}
    assert want == {(r["source"], r["size"]): r["n"] for r in mixing.mixed(df).groupBy("source", F.size(F.split("text", " ")).alias("size")).agg(F.count("*").alias("n")).collect()}

"""Trends over a stream of reviews: an extension, since the batch forms are what results are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trend_stream(reviews: DataFrame, grain: str = "1 day", late: str = "7 days") -> DataFrame:
    """Counts and mean rating in tumbling windows; rows more than ``late`` behind are dropped."""
    by = reviews.withWatermark("review_date", late).groupBy(F.window("review_date", grain).alias("w"))
    return by.agg(F.count("*").alias("reviews"), F.count_if(F.col("rating") <= 2).alias("low_ratings"), F.avg("rating").alias("avg_rating")).select(F.col("w.start").alias("period"), "reviews", "low_ratings", "avg_rating")


def burst_stream(reviews: DataFrame, least: int = 3, late: str = "2 days") -> DataFrame:
    """Days on which a product got ``least`` or more reviews of one rating."""
    by = reviews.withWatermark("review_date", late).groupBy(F.window("review_date", "1 day").alias("w"), "product_name", "rating")
    return by.agg(F.count("*").alias("reviews")).where(F.col("reviews") >= least).select(F.col("w.start").alias("day"), "product_name", "rating", "reviews")

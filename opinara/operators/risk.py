"""Additive authenticity risk of a review, with reasons in a fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinara.functions import text as T
from opinara.operators.similarity import nearest


def burst_flags(reviews: DataFrame) -> DataFrame:
    """``reviews`` with ``same_day``, ``typical`` and ``burst``: three or more alike on a day, and three times the usual.

    Counts by product, day and rating are aggregated first and joined back, so no product is gathered.
    """
    day = F.to_date("review_date")
    counts = reviews.groupBy("product_name", day.alias("__day"), "rating").agg(F.count("*").alias("same_day"))
    daily = counts.groupBy("product_name", "__day").agg(F.sum("same_day").alias("n"))
    typical = daily.groupBy("product_name").agg(F.median("n").alias("typical"))
    placed = reviews.withColumn("__day", day).join(counts, ["product_name", "__day", "rating"]).join(typical, "product_name")
    return placed.withColumn("burst", (F.col("same_day") >= 3) & (F.col("same_day") >= 3 * F.col("typical"))).drop("__day")


def similar_reviews(reviews: DataFrame, threshold: float = 0.75) -> DataFrame:
    """``review_id``, ``similar_to``, ``max_similarity``, after the length gate on the best partner."""
    docs = reviews.select(F.col("review_id").alias("id"), "review_text")
    best = nearest(docs, T.similarity_text(F.col("review_text")), threshold)
    size = reviews.groupBy("review_id").agg(F.min(F.length("review_text")).alias("n"))
    joined = best.join(size.select(F.col("review_id").alias("id"), F.col("n").alias("own")), "id").join(size.select(F.col("review_id").alias("partner"), F.col("n").alias("other")), "partner")
    fits = F.least("own", "other") / F.greatest("own", "other") >= 0.6
    return joined.where(fits).select(F.col("id").alias("review_id"), F.col("partner").alias("similar_to"), F.col("similarity").alias("max_similarity"))


def assess(reviews: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    """``reviews`` (with sentiment) and ``risk_score``, ``risk_level``, ``risk_reasons``, ``similar_to``, ``max_similarity``."""
    rows = burst_flags(reviews)
    if similar is None:
        rows = rows.withColumn("similar_to", F.lit("")).withColumn("max_similarity", F.lit(0.0))
    else:
        rows = rows.join(similar, "review_id", "left").withColumn("similar_to", F.coalesce("similar_to", F.lit(""))).withColumn("max_similarity", F.coalesce("max_similarity", F.lit(0.0)))
    text, s, r = F.col("review_text"), F.col("sentiment_score"), F.col("rating")
    against = ~T.is_mixed(text) & (((r >= 4) & (s <= -0.5)) | ((r <= 2) & (s >= 0.5)))
    signals = [
        (F.col("max_similarity") >= 0.90, 40, F.concat(F.lit("Near-duplicate of review "), "similar_to")),
        (F.col("max_similarity").between(0.75, 0.9) & (F.col("max_similarity") < 0.90), 20, F.concat(F.lit("Very similar to review "), "similar_to")),
        (F.col("burst"), 20, F.concat(F.lit("Part of a burst of "), F.col("same_day").cast("string"))),
        ((T.word_count(text) <= 6) & (T.theme_mask(text).bitwiseAND(F.lit(0xFFFF)) == 0), 15, F.lit("Generic text with no specific product detail")),
        (T.is_promo(text), 10, F.lit("Promotional or exaggerated phrasing")),
        (against, 15, F.lit("Star rating contradicts the review text")),
        (T.is_shouting(text), 10, F.lit("Excessive punctuation or capital letters")),
    ]
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(p).alias("points"), why.alias("reason"))) for c, p, why in signals]))
    rows = rows.withColumn("__hits", hits)
    extreme = r.isin(1.0, 5.0) & (F.size("__hits") > 0)
    rows = rows.withColumn("__hits", F.when(extreme, F.concat("__hits", F.array(F.struct(F.lit(5).alias("points"), F.lit("Extreme rating combined with other signals").alias("reason"))))).otherwise(F.col("__hits")))
    score = F.least(F.lit(100), F.aggregate("__hits", F.lit(0), lambda t, h: t + h["points"]))
    rows = rows.withColumn("risk_score", score).withColumn("risk_reasons", F.transform("__hits", lambda h: h["reason"])).drop("__hits")
    return rows.withColumn("risk_level", F.when(F.col("risk_score") >= 55, "High").when(F.col("risk_score") >= 30, "Medium").otherwise("Low"))


def same_rating_volume(reviews: DataFrame) -> DataFrame:
    """The window form of the burst count, for filters on product and day that should reach the scan."""
    alike = Window.partitionBy("product_name", F.to_date("review_date"), "rating")
    return reviews.withColumn("same_day", F.count("*").over(alike))


def risk_queue(assessed: DataFrame, levels: tuple[str, ...] = ("High", "Medium")) -> DataFrame:
    """Reviews of the levels, the riskiest first."""
    return assessed.where(F.col("risk_level").isin(*levels)).orderBy(F.desc("risk_score"), "review_id")

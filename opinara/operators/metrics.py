"""Aggregates over reviews and mentions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.functions import lexicon as L
from opinara.functions.text import cloud_words, rint


def label_counts(reviews: DataFrame, column: str, labels: Sequence[str]) -> DataFrame:
    """Rows for each label, in their order, zero where there are none: one conditional aggregation, no join."""
    counted = reviews.agg(*[F.count_if(F.col(column) == k).alias(f"n{i}") for i, k in enumerate(labels)])
    rows = F.array(*[F.struct(F.lit(k).alias(column), F.lit(i).alias("position"), F.col(f"n{i}").alias("reviews")) for i, k in enumerate(labels)])
    return counted.select(F.explode(rows).alias("x")).select("x.*")


def rating_histogram(reviews: DataFrame) -> DataFrame:
    """Stars 1 to 5, ratings rounded half to even."""
    counts = reviews.groupBy(F.rint("rating").cast("int").alias("stars")).agg(F.count("*").alias("reviews"))
    stars = reviews.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("stars"))
    return F.broadcast(stars).join(counts, "stars", "left").select("stars", F.coalesce("reviews", F.lit(0)).alias("reviews"))


def _reviews_where(mentions: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """By theme, the reviews with a mention for which each condition holds: one row for each theme and review first."""
    each = mentions.groupBy("theme", "review_id").agg(*[F.max(c.cast("int")).alias(n) for n, c in conditions.items()])
    return each.groupBy("theme").agg(*[F.sum(n).alias(n) for n in conditions])


def theme_summary(mentions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews praising, complaining and neutral by theme, and their shares of all reviews."""
    by = _reviews_where(mentions, {n: F.col("polarity") == p for p, n in (("praise", "praise"), ("complaint", "complaints"), ("neutral", "neutral"))})
    total = reviews.agg(F.count("*").alias("total"))
    share = lambda c: rint(F.col(c) / F.col("total") * 100, 1)
    return by.crossJoin(F.broadcast(total)).select("theme", "praise", "complaints", "neutral", share("praise").alias("praise_pct"), share("complaints").alias("complaint_pct"))


def top_complaints(mentions: DataFrame, limit: int = 5) -> DataFrame:
    """Themes by complaining reviews, with the text of the most negative clause."""
    worst = F.min_by("review_text", F.struct("clause_score", "review_id"))
    by = mentions.where("polarity = 'complaint'").groupBy("theme").agg(F.count_distinct("review_id").alias("mentions"), worst.alias("example_review"))
    return by.orderBy(F.desc("mentions"), "theme").limit(limit)


def recent_start(reviews: DataFrame) -> DataFrame:
    """One row: ``start`` of the recent window, ``total``, and the reviews in and before the window."""
    span = F.greatest(F.floor((F.unix_micros(F.max("review_date")) - F.unix_micros(F.min("review_date"))) / 86_400_000_000), F.lit(1))
    one = reviews.agg(F.max("review_date").alias("last"), span.alias("span"))
    days = F.when(F.col("span") >= 120, 30).otherwise(F.greatest(F.lit(7), F.floor(F.col("span") / 4))).cast("int")
    one = one.select((F.unix_micros("last") - (days - 1).cast("long") * 86_400_000_000).alias("start"))
    return reviews.crossJoin(F.broadcast(one)).groupBy("start").agg(
        F.count("*").alias("total"), F.count_if(F.unix_micros("review_date") >= F.col("start")).alias("recent"), F.count_if(F.unix_micros("review_date") < F.col("start")).alias("earlier")
    )


def priority_ranking(reviews: DataFrame, mentions: DataFrame) -> DataFrame:
    """Complaint themes by a score of frequency, negativity, low ratings and recent rise.

    One pass over the mentions: first one row for each theme and review, then the themes.
    """
    window = recent_start(reviews)
    per_review = mentions.where("polarity = 'complaint'").groupBy("theme", "review_id").agg(
        F.min("rating").alias("rating"), F.min("review_date").alias("review_date"), F.sum(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -F.col("clause_score")))).alias("neg"), F.count("*").alias("rows")
    )
    late = F.unix_micros("review_date") >= F.col("start")
    by = per_review.crossJoin(F.broadcast(window)).groupBy("theme", "total", "recent", "earlier").agg(
        F.count("*").alias("complaint_reviews"),
        (F.sum("neg") / F.sum("rows")).alias("negativity"),
        F.avg((F.col("rating") <= 2).cast("double")).alias("low_ratings"),
        F.avg("rating").alias("avg_rating"),
        F.count_if(late).alias("recent_ids"),
        F.count_if(~late).alias("earlier_ids"),
    )
    known = (F.col("recent") >= 5) & (F.col("earlier") >= 5)
    by = by.withColumn("recent_rate", F.when(known, F.col("recent_ids") / F.col("recent")).otherwise(0.0)).withColumn("earlier_rate", F.when(known, F.col("earlier_ids") / F.col("earlier")).otherwise(0.0))
    sharp = known & (F.col("recent_ids") >= 3) & (F.col("recent_rate") >= 1.5 * F.greatest("earlier_rate", F.lit(0.01)))
    some = known & (F.col("recent_ids") >= 2) & (F.col("recent_rate") > F.col("earlier_rate"))
    by = by.withColumn("recent_rise", F.when(sharp, 1.0).when(some, 0.5).otherwise(0.0)).withColumn("frequency", F.least(F.col("complaint_reviews") / F.col("total") / 0.20, F.lit(1.0)))
    by = by.withColumn("raw", 40 * F.col("frequency") + 25 * F.col("negativity") + 20 * F.col("low_ratings") + 15 * F.col("recent_rise"))
    n, s = F.col("complaint_reviews"), F.col("raw")
    level = F.when((s >= 70) & (n >= 5), "Critical").when((s >= 50) & (n >= 3), "High").when((s >= 30) & (n >= 2), "Medium").otherwise("Low")
    return by.select(
        "theme", level.alias("level"), rint(s, 1).alias("score"), "complaint_reviews", rint(n / F.col("total") * 100, 1).alias("share_pct"), rint(F.col("avg_rating"), 2).alias("avg_rating"),
        rint(F.col("frequency"), 2).alias("frequency"), rint(F.col("negativity"), 2).alias("negativity"), rint(F.col("low_ratings"), 2).alias("low_ratings"), "recent_rise",
        rint(F.col("recent_rate") * 100, 1).alias("recent_rate_pct"), rint(F.col("earlier_rate") * 100, 1).alias("earlier_rate_pct"),
    )


def evidence(mentions: DataFrame, limit: int = 3) -> DataFrame:
    """The strongest reviews of every theme and side, in one pass: most negative complaints, most positive praise."""
    side = F.when(F.col("polarity") == "complaint", F.col("clause_score")).otherwise(-F.col("clause_score"))
    first = Window.partitionBy("theme", "polarity", "review_id").orderBy(side, "clause")
    order = Window.partitionBy("theme", "polarity").orderBy(side, F.desc("review_date"), "review_id")
    one = mentions.where("polarity IN ('complaint', 'praise')").withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("theme", "polarity", "rank", "review_id", "clause", "clause_score")


def fix_impact(reviews: DataFrame, mentions: DataFrame) -> DataFrame:
    """The mean rating if the reviews complaining of a theme rated at least like the others.

    Reviews are counted by theme and rating (few rows), from which every theme's complement follows.
    """
    affected = mentions.where("polarity = 'complaint'").select("theme", "review_id").distinct()
    hit = affected.join(reviews.select("review_id", "rating"), "review_id").groupBy("theme", "rating").agg(F.count("*").alias("k"))
    total = reviews.agg(F.count("*").alias("n"), F.sum("rating").alias("s"))
    by = hit.groupBy("theme").agg(F.sum("k").alias("affected"), F.sum(F.col("k") * F.col("rating")).alias("hit_sum"), F.collect_list(F.struct("rating", "k")).alias("ratings")).crossJoin(F.broadcast(total))
    by = by.where(F.col("affected") < F.col("n")).withColumn("others", (F.col("s") - F.col("hit_sum")) / (F.col("n") - F.col("affected")))
    raised = F.aggregate("ratings", F.lit(0.0), lambda t, r: t + r["k"] * F.greatest(r["rating"], F.col("others")))
    by = by.withColumn("projected", (F.col("s") - F.col("hit_sum") + raised) / F.col("n")).withColumn("current", F.col("s") / F.col("n"))
    return by.select("theme", "affected", rint(F.col("current"), 2).alias("current_avg"), rint(F.col("projected"), 2).alias("projected_avg"), rint(F.col("projected") - F.col("current"), 2).alias("gain"))


def top_words(mentions: DataFrame, polarity: str, limit: int = 28) -> DataFrame:
    """Words by the number of reviews whose clauses of that polarity use them, two or more."""
    stop = sorted({*L.STOP_WORDS, *L.CLOUD_STOP_WORDS})
    words = mentions.where(F.col("polarity") == polarity).select("review_id", F.explode(F.array_distinct(cloud_words(F.col("clause")))).alias("word"))
    by = words.where(~F.col("word").isin(stop)).groupBy("word").agg(F.count_distinct("review_id").alias("reviews"))
    return by.where("reviews >= 2").orderBy(F.desc("reviews"), "word").limit(limit)


def health(avg_rating: Column, positive: Column, negative: Column, total: Column) -> Column:
    return F.rint(100 * (0.5 * (avg_rating - 1) / 4 + 0.5 * ((positive - negative) / total + 1) / 2)).cast("int")


def product_metrics(reviews: DataFrame) -> DataFrame:
    """Every product and, as product ``All``, everything: one pass with grouping sets."""
    by = reviews.rollup("product_name").agg(
        F.count("*").alias("reviews"), F.avg("rating").alias("a"), F.count_if(F.col("sentiment") == "Positive").alias("p"), F.count_if(F.col("sentiment") == "Negative").alias("m"), F.grouping_id().alias("g")
    )
    n = F.col("reviews")
    return by.select(
        F.when(F.col("g") == 1, "All").otherwise(F.col("product_name")).alias("product_name"), "reviews", rint(F.col("a"), 2).alias("avg_rating"),
        rint(F.col("p") / n * 100, 1).alias("positive_pct"), rint(F.col("m") / n * 100, 1).alias("negative_pct"), health(F.col("a"), F.col("p"), F.col("m"), n).alias("health"),
    )


def theme_table(mentions: DataFrame, a: str, b: str) -> DataFrame:
    """Praise and complaint reviews of two products by theme, with satisfaction where at least two rate it."""
    mine = mentions.where(F.col("product_name").isin(a, b))
    by = _reviews_where(mine, {f"{n}_{s}": (F.col("product_name") == p) & (F.col("polarity") == q) for p, s in ((a, "a"), (b, "b")) for q, n in (("praise", "praise"), ("complaint", "complaints"))})
    for s in "ab":
        rated = F.col(f"praise_{s}") + F.col(f"complaints_{s}")
        by = by.withColumn(f"satisfaction_{s}", F.when(rated >= 2, F.rint(F.col(f"praise_{s}") / rated * 100)))
    return by


def strengths(table: DataFrame, gap: float = 15, limit: int = 3) -> DataFrame:
    """Themes on which a side is clearly better or worse, widest gap first."""
    both = table.where("satisfaction_a IS NOT NULL AND satisfaction_b IS NOT NULL").withColumn("gap", F.col("satisfaction_a") - F.col("satisfaction_b")).where(F.abs("gap") >= gap)
    told = both.withColumn("verdict", F.when(F.col("gap") > 0, "better").otherwise("worse"))
    order = Window.partitionBy("verdict").orderBy(F.desc(F.abs("gap")), "theme")
    return told.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("verdict", "rank", "theme", "gap")


def winners(a: dict, b: dict) -> dict[str, int]:
    """For each metric 0 if ``a`` wins, 1 if ``b`` does, -1 for neither."""
    higher = {"reviews": None, "avg_rating": True, "positive_pct": True, "negative_pct": False, "health": True}
    return {k: -1 if up is None or a[k] == b[k] else int((a[k] > b[k]) != up) for k, up in higher.items()}


def theme_map(summary: DataFrame) -> DataFrame:
    rated = F.col("praise") + F.col("complaints")
    return summary.where(rated > 0).select("theme", (rated + F.col("neutral")).alias("mentions"), rint((F.col("praise") - F.col("complaints")) / rated * 100, 1).alias("net"))


def products(reviews: DataFrame) -> DataFrame:
    """Products by volume, the larger first, then by name."""
    return reviews.groupBy("product_name").agg(F.count("*").alias("reviews")).orderBy(F.desc("reviews"), "product_name")


def theme_radar(table: DataFrame, limit: int = 8) -> DataFrame:
    """Satisfaction with the most mentioned themes of two products, 0 where too few rate it."""
    total = F.col("praise_a") + F.col("complaints_a") + F.col("praise_b") + F.col("complaints_b")
    rated = table.where("satisfaction_a IS NOT NULL OR satisfaction_b IS NOT NULL").orderBy(F.desc(total), "theme").limit(limit)
    return rated.select("theme", F.coalesce("satisfaction_a", F.lit(0.0)).alias("a"), F.coalesce("satisfaction_b", F.lit(0.0)).alias("b"))

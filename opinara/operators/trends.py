"""Periods, trends and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.functions.text import rint

UNITS = {"Daily": "DAY", "Weekly": "WEEK", "Monthly": "MONTH"}
DAY = 86_400_000_000


def period(date: Column, frequency: str) -> Column:
    return F.date_trunc(UNITS[frequency], date)


def auto_frequency(reviews: DataFrame) -> DataFrame:
    """One row: the grain that suits the span of dates."""
    span = F.floor((F.unix_micros(F.max("review_date")) - F.unix_micros(F.min("review_date"))) / DAY)
    return reviews.agg(span.alias("days")).select("days", F.when(F.coalesce("days", F.lit(0)) <= 45, "Daily").when(F.col("days") <= 240, "Weekly").otherwise("Monthly").alias("frequency"))


def review_trends(reviews: DataFrame, frequency: str) -> DataFrame:
    """Counts and means by period, with rows for the periods without reviews."""
    by = reviews.groupBy(period(F.col("review_date"), frequency).alias("period")).agg(
        F.count("*").alias("reviews"), F.count_if(F.col("sentiment") == "Positive").alias("positive"), F.count_if(F.col("sentiment") == "Negative").alias("negative"),
        F.count_if(F.col("rating") <= 2).alias("low_ratings"), rint(F.avg("rating"), 2).alias("avg_rating"),
    )
    every = F.expr(f"sequence(min(period), max(period), interval 1 {UNITS[frequency]})")
    spine = by.agg(every.alias("p")).select(F.explode("p").alias("period"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = spine.join(by, "period", "left")
    return joined.select("period", zero("reviews"), zero("positive"), zero("negative"), zero("low_ratings"), "avg_rating", F.when(F.col("reviews") > 0, rint(F.col("negative") / F.col("reviews") * 100, 1)).alias("negative_pct"))


def theme_trends(mentions: DataFrame, frequency: str, polarity: str = "complaint") -> DataFrame:
    return mentions.where(F.col("polarity") == polarity).groupBy(period(F.col("review_date"), frequency).alias("period"), "theme").agg(F.count_distinct("review_id").alias("reviews"))


def alert_windows(reviews: DataFrame) -> DataFrame:
    """One row: start of the baseline, start of the recent window, end; at midnight."""
    one = reviews.agg(F.to_date(F.min("review_date")).alias("first"), F.to_date(F.max("review_date")).alias("last"))
    span = F.datediff("last", "first") + 1
    days = F.when(span >= 70, 14).otherwise(F.greatest(F.lit(7), F.floor(span / 4))).cast("int")
    one = one.withColumn("recent_start", F.date_sub("last", days - 1))
    return one.select(F.greatest(F.col("first"), F.date_sub("recent_start", 56)).alias("baseline_start"), "recent_start", F.col("last").alias("data_end"))


def spike_alerts(reviews: DataFrame, mentions: DataFrame) -> DataFrame:
    """Rates that jump from the baseline to the recent window, volume, and falls of the mean rating.

    Every signal's hits in both windows come from one conditional aggregation over reviews and one over
    mentions; ``evidence`` holds the newest three ids.
    """
    w = F.broadcast(alert_windows(reviews))
    date = F.to_date("review_date")
    recent, base = date >= F.col("recent_start"), (date >= F.col("baseline_start")) & (date < F.col("recent_start"))
    placed = reviews.crossJoin(w).where(date >= F.col("baseline_start")).withColumn("late", recent)
    negative, low = F.col("sentiment") == "Negative", F.col("rating") <= 2
    days = (F.datediff("data_end", "recent_start") + 1, F.greatest(F.datediff("recent_start", "baseline_start"), F.lit(1)))
    total = placed.groupBy("recent_start", "baseline_start", "data_end").agg(
        F.count_if(recent).alias("r"), F.count_if(base).alias("b"), F.count_if(recent & negative).alias("rn"), F.count_if(base & negative).alias("bn"), F.count_if(recent & low).alias("rl"), F.count_if(base & low).alias("bl"),
        F.avg(F.when(recent, F.col("rating"))).alias("ra"), F.avg(F.when(base, F.col("rating"))).alias("ba"),
    )
    total = total.withColumn("days_r", days[0]).withColumn("days_b", days[1]).crossJoin(F.broadcast(reviews.agg(F.count("*").alias("n")))).where("n >= 30 AND r >= 8 AND b >= 15")
    last = _newest(placed.where(recent & negative), "signal", F.lit("Negative reviews")).unionAll(_newest(placed.where(recent & low), "signal", F.lit("Low ratings (1-2 stars)")))
    themed = mentions.where("polarity = 'complaint'").crossJoin(w).where(date >= F.col("baseline_start"))
    by_theme = themed.groupBy("theme").agg(F.count_distinct(F.when(recent, F.col("review_id"))).alias("hr"), F.count_distinct(F.when(base, F.col("review_id"))).alias("hb"))
    last = last.unionAll(_newest(themed.where(recent), "signal", F.concat("theme", F.lit(" complaints"))))
    row = lambda name, hr, hb, least, jump: F.struct(F.lit(name).alias("signal"), hr.alias("hr"), hb.alias("hb"), F.lit(least).alias("least"), F.lit(jump).alias("jump"))
    own = total.select("r", "b", F.explode(F.array(row("Negative reviews", F.col("rn"), F.col("bn"), 4, 0.15), row("Low ratings (1-2 stars)", F.col("rl"), F.col("bl"), 4, 0.15))).alias("x")).select("r", "b", "x.*")
    theme = by_theme.crossJoin(F.broadcast(total.select("r", "b"))).select("r", "b", F.concat("theme", F.lit(" complaints")).alias("signal"), "hr", "hb", F.lit(3).alias("least"), F.lit(0.10).alias("jump"))
    rates = own.unionAll(theme).withColumn("rr", F.col("hr") / F.col("r")).withColumn("br", F.col("hb") / F.col("b"))
    jumped = rates.where((F.col("hr") >= F.col("least")) & (F.col("rr") - F.col("br") >= F.col("jump")) & (F.col("rr") >= 1.5 * F.col("br")))
    high = (F.col("rr") - F.col("br") >= 0.25) | (F.col("br") == 0) | (F.col("rr") >= 3 * F.col("br"))
    alerts = jumped.join(last, "signal", "left").select("signal", F.when(high, "High").otherwise("Medium").alias("severity"), rint(F.col("rr") * 100, 1).alias("recent_pct"), rint(F.col("br") * 100, 1).alias("baseline_pct"), "evidence")
    none = F.lit(None).cast("double")
    empty = F.array().cast("array<string>")
    volume = total.where((F.col("r") >= 10) & (F.col("r") / F.col("days_r") >= 2 * F.col("b") / F.col("days_b"))).select(F.lit("Review volume"), F.lit("Info"), none, none, empty)
    drop = total.where("ba - ra >= 0.5").select(F.lit("Average rating"), F.when(F.col("ba") - F.col("ra") >= 1, "High").otherwise("Medium"), none, none, empty)
    return alerts.unionAll(volume).unionAll(drop)


def _newest(rows: DataFrame, name: str, value: Column, limit: int = 3) -> DataFrame:
    """The newest ids for each value, by a ranked window that keeps ``limit`` rows of each task."""
    one = rows.select(value.alias(name), "review_date", "review_id").distinct()
    ranked = one.withColumn("k", F.row_number().over(Window.partitionBy(name).orderBy(F.desc("review_date"), "review_id"))).where(F.col("k") <= limit)
    return ranked.groupBy(name).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "review_id"))), lambda x: x["review_id"]).alias("evidence"))


#: One level coarser than a grain, for lines by theme.
COARSER = {"Daily": "Weekly", "Weekly": "Monthly", "Monthly": "Monthly"}


def theme_lines(mentions: DataFrame, frequency: str, top: int = 5) -> DataFrame:
    """Complaints by theme and period, one level coarser than ``frequency``, of the ``top`` themes by volume."""
    by = theme_trends(mentions, COARSER[frequency])
    most = by.groupBy("theme").agg(F.sum("reviews").alias("__all")).orderBy(F.desc("__all"), "theme").limit(top)
    return by.join(F.broadcast(most.select("theme")), "theme")


def sparkline(reviews: DataFrame) -> DataFrame:
    """The periods that have reviews, by week, or by month where the span asks for months."""
    monthly = F.col("frequency") == "Monthly"
    placed = reviews.crossJoin(F.broadcast(auto_frequency(reviews)))
    start = F.when(monthly, period(F.col("review_date"), "Monthly")).otherwise(period(F.col("review_date"), "Weekly"))
    share = lambda k: rint(F.count_if(F.col("sentiment") == k) / F.count("*") * 100, 1)
    return placed.groupBy(start.alias("period")).agg(F.count("*").alias("reviews"), rint(F.avg("rating"), 2).alias("avg_rating"), share("Positive").alias("positive_pct"), share("Negative").alias("negative_pct"))


def video_markers(reviews: DataFrame, videos: DataFrame, text_source: str = "text") -> DataFrame:
    """``date``, ``value``, ``label`` of the reviews that are not texts; the label is the video's title, or the id."""
    titles = videos.select("review_id", F.col("video_title").alias("__title"))
    marked = reviews.where(F.col("source") != text_source).join(titles, "review_id", "left")
    return marked.select(F.col("review_date").alias("date"), F.col("rating").alias("value"), F.coalesce("__title", "review_id").alias("label"))

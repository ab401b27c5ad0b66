"""Sentences and reports over the aggregates. Only small aggregates reach the driver here."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.functions import lexicon as L
from opinara.functions import text as T
from opinara.operators import metrics, trends, wishlist
from opinara.operators.enrich import add_emotion
from opinara.storage import once


def _first_ids(mentions: DataFrame, limit: int = 3) -> dict[tuple[str, str], list[str]]:
    found: dict[tuple[str, str], list[str]] = {}
    for r in metrics.evidence(mentions, limit).orderBy("theme", "polarity", "rank").collect():
        found.setdefault((r["theme"], r["polarity"]), []).append(r["review_id"])
    return found


def key_insights(reviews: DataFrame, mentions: DataFrame) -> DataFrame:
    """``seq``, ``kind``, ``text``, ``evidence``: overview, praise, recurring and rising complaints, the driver
    of low ratings, single complaints, and the share of reviews in Indian languages.

    The mentions are worked out once, for all the aggregates over them.
    """
    with once(mentions.drop("review_text"), "mentions") as written:
        return _insights(reviews, written)


def _insights(reviews: DataFrame, mentions: DataFrame) -> DataFrame:
    spark = reviews.sparkSession
    summary = metrics.theme_summary(mentions, reviews).orderBy(F.desc("complaints"), F.desc("praise"), "theme").collect()
    ranking = metrics.priority_ranking(reviews, mentions).collect()
    ids = _first_ids(mentions)
    one = reviews.agg(F.count("*").alias("n"), F.avg("rating").alias("a"), F.count_if(F.col("sentiment") == "Positive").alias("p"), F.count_if(F.col("language") != "English").alias("i"), F.count_if(F.col("rating") <= 2).alias("low")).first()
    low = mentions.where("polarity = 'complaint' AND rating <= 2").groupBy("theme").agg(F.count_distinct("review_id").alias("k")).orderBy(F.desc("k"), "theme").first()
    rows: list[tuple[str, str, list[str]]] = []
    if one["n"]:
        rows.append(("overview", f"{one['n']} reviews, {one['a']:.1f} stars on average, {one['p'] / one['n']:.0%} positive.", []))
    for r in sorted((r for r in summary if r["praise"] >= 2), key=lambda r: (-r["praise"], r["theme"]))[:2]:
        rows.append(("praise", f"{r['theme']} is praised in {r['praise']} reviews.", ids.get((r["theme"], "praise"), [])))
    for r in [r for r in summary if r["complaints"] >= 2][:3]:
        rows.append(("complaint", f"{r['theme']} is a recurring complaint ({r['complaints']} reviews).", ids.get((r["theme"], "complaint"), [])))
    for r in sorted((r for r in ranking if r["recent_rise"] == 1), key=lambda r: r["theme"]):
        rows.append(("rise", f"{r['theme']} complaints rose to {r['recent_rate_pct']} % of recent reviews from {r['earlier_rate_pct']} %.", ids.get((r["theme"], "complaint"), [])))
    if low and one["low"] >= 3:
        rows.append(("driver", f"{low['theme']} drives low ratings: {low['k']} of {one['low']}.", ids.get((low["theme"], "complaint"), [])))
    for r in (r for r in summary if r["complaints"] == 1):
        rows.append(("single", f"One review complains of {r['theme']}.", ids.get((r["theme"], "complaint"), [])))
    if one["i"]:
        rows.append(("language", f"{one['i'] / one['n']:.0%} of the reviews are in Hindi or Hinglish.", []))
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "seq int, kind string, text string, evidence array<string>")


def headline(mentions: DataFrame) -> str:
    """What is loved and what is not, in one sentence."""
    by = {p: mentions.where(F.col("polarity") == p).groupBy("theme").agg(F.count_distinct("review_id").alias("n")).where("n >= 2").orderBy(F.desc("n"), "theme").first() for p in ("praise", "complaint")}
    loved, problem = by["praise"], by["complaint"]
    if loved and problem:
        return f"Customers love {loved['theme'].lower()}, but {problem['theme'].lower()} keeps coming up as a problem."
    if loved:
        return f"Customers love {loved['theme'].lower()}, and no complaint keeps coming up."
    return f"{problem['theme']} keeps coming up as a problem." if problem else "No theme stands out yet."


def stats_context(reviews: DataFrame, mentions: DataFrame) -> str:
    """The computed numbers as text, for prompts."""
    with once(mentions.drop("review_text"), "mentions") as written:
        return _context(reviews, written)


def _context(reviews: DataFrame, mentions: DataFrame) -> str:
    one = reviews.agg(F.count("*").alias("n"), F.date_format(F.min("review_date"), "yyyy-MM-dd").alias("a"), F.date_format(F.max("review_date"), "yyyy-MM-dd").alias("b"), F.avg("rating").alias("r")).first()
    lines = [f"Reviews: {one['n']} ({one['a']} to {one['b']})", f"Average rating: {one['r']:.2f}/5"]
    lines.append("Ratings: " + ", ".join(f"{r['stars']}: {r['reviews']}" for r in metrics.rating_histogram(reviews).orderBy("stars").collect()))
    for column, labels in (("sentiment", L.SENTIMENTS), ("language", L.LANGUAGES)):
        lines.append(f"{column.title()}: " + ", ".join(f"{r[column]} {r['reviews']}" for r in metrics.label_counts(reviews, column, labels).orderBy("position").collect()))
    lines += [f"- {r['theme']}: {r['praise']} praise, {r['complaints']} complaints" for r in metrics.theme_summary(mentions, reviews).orderBy("theme").collect()]
    lines += [f"- {r['theme']}: {r['level']} ({r['score']})" for r in metrics.priority_ranking(reviews, mentions).orderBy(F.desc("score"), "theme").collect()]
    lines += [f"- {r['signal']}: {r['severity']}" for r in trends.spike_alerts(reviews, mentions).orderBy("signal").collect()]
    return "\n".join(lines)


@dataclass
class Report:
    headline: str
    sections: dict[str, list[dict]]

    def markdown(self) -> str:
        out = [f"# {self.headline}"]
        for name, rows in self.sections.items():
            out.append(f"\n## {name}")
            out += ["- " + ", ".join(f"{k}: {v}" for k, v in row.items()) for row in rows]
        return "\n".join(out)


def report(reviews: DataFrame, mentions: DataFrame) -> Report:
    """The aggregates of a printed report, each small."""
    with once(mentions.drop("review_text"), "mentions") as written:
        return _report(reviews, written)


def _report(reviews: DataFrame, mentions: DataFrame) -> Report:
    gain = metrics.fix_impact(reviews, mentions).select("theme", "gain")
    priority = metrics.priority_ranking(reviews, mentions).join(gain, "theme", "left").orderBy(F.desc("score"), "theme").limit(8)
    parts = {
        "Products": metrics.product_metrics(reviews).orderBy("product_name"),
        "Emotions": metrics.label_counts(add_emotion(reviews), "emotion", [*L.EMOTIONS, L.NO_EMOTION]).orderBy(F.desc("reviews"), "position").drop("position"),
        "Priorities": priority.select("theme", "level", "score", "gain"),
        "Quotes": metrics.evidence(mentions, 2).where("polarity = 'complaint'").orderBy("theme", "rank").select("theme", "review_id", "clause"),
        "Praise": metrics.theme_summary(mentions, reviews).where("praise >= 2").orderBy(F.desc("praise"), "theme").limit(4).select("theme", "praise"),
        "Insights": _insights(reviews, mentions).where("kind <> 'overview'").orderBy("seq").limit(6).select("text"),
        "Requests": wishlist.group_requests(wishlist.extract_requests(reviews)).orderBy(F.desc("reviews"), F.desc("last_date")).limit(5).select("request", "reviews"),
    }
    return Report(headline(mentions), {k: [r.asDict() for r in df.collect()] for k, df in parts.items()})


def markdown_lines(texts: DataFrame) -> DataFrame:
    """``id``, ``pos``, ``kind``, ``line`` of the lines of ``text``: headings, bullets and text; blank and note lines go."""
    lines = texts.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).withColumn("line", F.trim("raw")).where("line <> '' AND NOT startswith(line, '_(')")
    kind = F.when(F.col("line").rlike("^#{1,6} "), "heading").when(F.col("line").rlike("^[-*•] "), "bullet").otherwise("text")
    return lines.select("id", "pos", kind.alias("kind"), F.regexp_replace("line", "^(#{1,6}|[-*•]) ", "").alias("line"))


def integrity(reviews: DataFrame) -> DataFrame:
    """One row of the risk counts; similarities were rounded to two places, so 0.895 and above count as copies."""
    return reviews.agg(F.count("*").alias("reviews"), *[F.count_if(F.col("risk_level") == k).alias(k.lower()) for k in ("High", "Medium", "Low")], F.count_if(T.rint(F.col("max_similarity"), 2) >= 0.9).alias("copies"))


def video_reach(videos: DataFrame) -> DataFrame:
    """One row: the views of all videos and of the negative ones."""
    return videos.agg(F.coalesce(F.sum("views"), F.lit(0)).alias("views"), F.coalesce(F.sum(F.when(F.col("sentiment") == "Negative", F.col("views"))), F.lit(0)).alias("negative_views"))


def compare_text(reviews: DataFrame, mentions: DataFrame, a: str, b: str) -> str:
    """The figures of two products, for prompts."""
    by = {r["product_name"]: r for r in metrics.product_metrics(reviews.where(F.col("product_name").isin(a, b))).collect()}
    lines = [f"{p}: {m['reviews']} reviews, {m['avg_rating']} stars of 5 on average, {m['positive_pct']} % positive, {m['negative_pct']} % negative, health {m['health']} of 100" for p in (a, b) if (m := by.get(p))]
    total = F.col("praise_a") + F.col("complaints_a") + F.col("praise_b") + F.col("complaints_b")
    score = lambda v: "none" if v is None else str(int(v))
    lines.append("By theme, praise / complaints / satisfaction of 100:")
    for r in metrics.theme_table(mentions, a, b).orderBy(F.desc(total), "theme").collect():
        lines.append(f"- {r['theme']}: {a} {r['praise_a']}/{r['complaints_a']}/{score(r['satisfaction_a'])}, {b} {r['praise_b']}/{r['complaints_b']}/{score(r['satisfaction_b'])}")
    return "\n".join(lines)

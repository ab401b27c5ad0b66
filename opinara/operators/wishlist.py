"""Feature requests: extraction, and grouping of similar ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.functions import lexicon as L
from opinara.functions import text as T
from opinara.operators.similarity import similar_pairs, weighted
from opinara.storage import stored


def extract_requests(reviews: DataFrame) -> DataFrame:
    return reviews.select("review_id", "product_name", "review_date", "rating", F.explode(T.requests(F.col("review_text"))).alias("request"))


def group_requests(requests: DataFrame, threshold: float = L.REQUEST_SIMILARITY) -> DataFrame:
    """One row for each group of similar requests.

    Wordings that compare alike are one text, in the order of their first review. A text joins the group of the
    first earlier text that it is similar to, or opens one. The first earlier text is an aggregate over the similar
    pairs, and following it to the group's opener takes rounds that each double the steps, so no order is walked.
    """
    keyed = requests.withColumn("key", T.request_key(F.col("request")))
    texts = stored(keyed.groupBy("key").agg(F.min(F.struct("review_date", "review_id")).alias("first"), F.count("*").alias("n")), "request-texts")
    pairs = similar_pairs(weighted(texts.select(F.col("key").alias("id"), F.col("key").alias("text"), "n"), sublinear=True, pattern="[\\p{L}\\p{N}_]{2,}", stop=True), threshold)
    place = F.struct("first", "key")
    both = pairs.select("a", "b").unionAll(pairs.select("b", "a"))
    earlier = both.join(texts.select(F.col("key").alias("a"), place.alias("mine")), "a").join(texts.select(F.col("key").alias("b"), place.alias("other")), "b").where("other < mine")
    parent = earlier.groupBy(F.col("a").alias("key")).agg(F.min("other")["key"].alias("up"))
    now = stored(texts.select("key").join(parent, "key", "left").select("key", F.coalesce("up", "key").alias("up")), "request-groups")
    while True:
        above = now.select(F.col("key").alias("up"), F.col("up").alias("top"))
        after = stored(now.join(above, "up").select("key", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "request-groups")
        if after.where("moved").isEmpty():
            break
        now = after.select("key", "up")
    members = keyed.join(now.select("key", F.col("up").alias("grp")), "key")
    wording = members.groupBy("grp", "request").agg(F.count("*").alias("n")).groupBy("grp").agg(F.max_by("request", F.struct("n", -F.length("request"), "request")).alias("request"), F.slice(F.sort_array(F.collect_list("request")), 1, 3).alias("examples"))
    reviews = members.groupBy("grp").agg(F.count_distinct("review_id").alias("reviews"), F.sort_array(F.collect_set("product_name")).alias("products"), F.max("review_date").alias("last_date"))
    return reviews.join(wording, "grp").drop("grp")


def wishlist_counts(requests: DataFrame, groups: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row: requests, groups, reviews that request something, and their share of all reviews."""
    asked = requests.agg(F.count("*").alias("requests"), F.count_distinct("review_id").alias("asking"))
    one = asked.crossJoin(groups.agg(F.count("*").alias("groups"))).crossJoin(reviews.agg(F.count("*").alias("n")))
    return one.select("requests", "groups", "asking", F.when(F.col("n") > 0, T.rint(F.col("asking") / F.col("n") * 100, 1)).alias("asking_pct"))


def requesting(reviews: DataFrame, requests: DataFrame) -> DataFrame:
    """The reviews that request something."""
    return reviews.join(requests.select("review_id").distinct(), "review_id", "left_semi")

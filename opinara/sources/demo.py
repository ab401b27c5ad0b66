"""Made-up reviews with planted patterns: a rise of complaints, a burst of near-equal praise, exact copies, requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRODUCTS = ("Aura Headphones", "Brewly Kettle", "Pacer Band")
#: Cumulative shares of the products.
SHARES = (0.5, 0.8, 1.0)
START, DAYS, RISE = "2026-04-01", 183, "2026-09-01"
COMPLAINTS = {
    "Connectivity": ("Bluetooth disconnects all the time.", "Pairing fails with my laptop.", "Bluetooth baar baar disconnect ho jata hai."),
    "Battery": ("The battery drains overnight.", "बैटरी जल्दी खत्म हो जाती है।", "Charging has become slow."),
    "Delivery": ("The parcel came late and the box was crushed.", "Delivery bahut late thi."),
    "Quality": ("A hinge cracked in the second week.", "Quality kharab hai, paisa barbaad."),
    "Service": ("Customer care never replied.", "The refund was refused."),
}
PRAISE = ("Great value for the price.", "It is very comfortable, I love it.", "Easy to use and the setup was simple.", "Bahut accha hai, ekdum mast.", "बहुत अच्छा है।", "The sound is superb.", "Sturdy build, works well.")
REQUESTS = ("I wish it had a longer cable.", "Please add a running mode.", "It should have an equaliser.")


def demo_reviews(spark: SparkSession, rows: int = 300, seed: int = 7) -> DataFrame:
    """``rows`` reviews and eight planted ones; the same seed gives the same rows."""
    lot = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1_000_000)) / 1_000_000
    pick = lambda items, k: F.element_at(F.array(*map(F.lit, items)), (1 + F.floor(lot(k) * len(items))).cast("int"))
    date = F.timestamp_add("HOUR", F.floor(lot("hour") * 24).cast("int"), F.date_add(F.lit(START).cast("date"), F.floor(lot("day") * DAYS).cast("int")).cast("timestamp"))
    product = F.when(lot("product") < SHARES[0], PRODUCTS[0]).when(lot("product") < SHARES[1], PRODUCTS[1]).otherwise(PRODUCTS[2])
    base = spark.range(rows).select("id", product.alias("product_name"), date.alias("review_date"))
    rising = (F.col("product_name") == PRODUCTS[0]) & (F.col("review_date") >= F.lit(RISE).cast("timestamp"))
    bad = lot("mood") < F.when(rising, 0.6).otherwise(0.3)
    kinds = list(COMPLAINTS)
    weighted: Column = F.when(rising, pick([kinds[0]] * 6 + kinds[1:], "kind")).otherwise(pick(kinds, "kind"))
    words = F.lit(None).cast("string")
    for kind, texts in COMPLAINTS.items():
        words = F.when(weighted == kind, pick(texts, "words")).otherwise(words)
    asked = F.when(lot("asks") < 0.12, pick(REQUESTS, "request"))
    told = base.select(
        F.format_string("D%05d", "id").alias("review_id"), "product_name", F.when(bad, 1 + F.floor(lot("stars") * 2)).otherwise(4 + F.floor(lot("stars") * 2)).cast("double").alias("rating"),
        F.concat_ws(" ", F.when(bad, words).otherwise(pick(PRAISE, "words")), asked, F.format_string("Day %d.", F.datediff("review_date", F.lit(START).cast("date")))).alias("review_text"), "review_date",
    )
    burst = [(f"B{k}", PRODUCTS[2], 5.0, f"Best band ever, must buy, five stars from me and my {who}!", "2026-07-15 10:00:00") for k, who in enumerate(("wife", "brother", "sister", "friend", "cousin", "boss"))]
    copied = "I have used this kettle for a month and the lid leaks whenever it boils, which is a pity."
    copies = [(f"C{k}", PRODUCTS[1], 2.0, copied, day) for k, day in enumerate(("2026-05-01 09:00:00", "2026-06-10 09:00:00", "2026-07-05 09:00:00"))]
    planted = spark.createDataFrame(burst + copies, "review_id string, product_name string, rating double, review_text string, d string")
    return told.unionByName(planted.withColumn("review_date", F.to_timestamp("d")).drop("d"))

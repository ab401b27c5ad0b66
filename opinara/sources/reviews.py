"""A review table derived from the order tables, with texts from a phrase table of our own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.session import spread

OPENERS = (
    "The battery drains quickly and charging is slow.",
    "Great sound quality but the headband is flimsy.",
    "Delivery was late and the box arrived crushed.",
    "Customer care never replied to my emails.",
    "Excellent value for money, I love the price.",
    "Very comfortable strap and soft cushions.",
    "Bluetooth keeps disconnecting every few minutes.",
    "Battery backup bahut accha hai lekin design confusing hai.",
    "बैटरी जल्दी खत्म हो जाती है।",
    "Nice design, easy to use and the setup is simple.",
    "The screen is not good; it is overpriced!!!",
    "Average.",
    "WORST APP EVER and I regret it.",
)
MIDDLES = (
    "Sound quality is superb, build quality is not.",
    "It is not bad, but not what I expected.",
    "लेकिन आवाज़ साफ है।",
    "The call quality dropped, although the support team was helpful.",
    "Never again!",
    "Not worth the money, though the strap is soft.",
    "Setup was easy; pairing fails every time!!!",
    "Ekdum mast hai yaar, paisa vasool.",
    "How do I connect it to two devices?",
    "The refund arrived late and the hinge cracked.",
    "I am angry, furious even: it drains and drains.",
)
CLOSERS = (
    "I wish it had a longer cable.",
    "Must buy, highly recommend.",
    "The camera is good.",
    "It should have an equalizer.",
    "Kharab quality hai, paisa barbaad.",
    "Okay overall.",
    "Please add a running mode. The seller was helpful.",
    "I wish it had an EQ and a much longer cable.",
    "Would be nice if it had a mode for runs.",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(phrases: tuple[str, ...], number) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in phrases]), (1 + number % len(phrases)).cast("int"))


#: From this day to the end of the orders, two reviews in three are bad and open with the first phrase.
BAD_DAYS = "2001-07-19"


def order_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review for each order, in a thousand wordings, and one in fifty with a text of its own; reads five columns.

    The last days hold a planted rise of complaints.
    """
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate"))
    bad = (F.col("o_orderdate") >= F.lit(BAD_DAYS).cast("timestamp")) & (F.col("o_orderkey") % 3 != 0)
    return orders.select(
        F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("review_id"),
        F.concat(F.lit("Product "), (F.col("o_custkey") % 12).cast("string")).alias("product_name"),
        F.when(bad, 1.0).otherwise(F.substring("o_orderpriority", 1, 1).cast("double")).alias("rating"),
        F.concat_ws(" ", _pick(OPENERS, F.when(bad, 0).otherwise(F.col("o_orderkey"))), _pick(MIDDLES, F.floor(F.col("o_orderkey") / len(OPENERS))), _pick(CLOSERS, F.col("o_custkey")), F.when(F.col("o_orderkey") % 50 == 7, F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(".")))).alias("review_text"),
        F.col("o_orderdate").cast("timestamp").alias("review_date"),
    )

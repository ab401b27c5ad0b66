"""Per-review columns and the mention table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions import lexicon as L
from opinara.functions import text as T
from opinara.schema import MENTION_COLUMNS

Scorer = Callable[[Column], Column]


def add_sentiment(reviews: DataFrame, scorer: Scorer = T.lexicon_score, text: str = "review_text") -> DataFrame:
    scored = reviews.withColumn("sentiment_score", scorer(F.col(text)))
    return scored.withColumn("sentiment", T.sentiment_label(F.col("sentiment_score"))).withColumn("language", T.language(F.col(text)))


def add_emotion(reviews: DataFrame, text: str = "review_text") -> DataFrame:
    return reviews.withColumn("emotion", T.emotion(F.col(text)))


def mentions(reviews: DataFrame, scorer: Scorer = T.lexicon_score, many: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row for each review and theme: its first complaint clause, else its first clause.

    A review's clauses are matched, scored and chosen inside its row, so there is no shuffle, and repeated
    ids stay apart. One pass over a clause finds the words of all themes; only clauses with some are scored.
    ``many`` scores an array of clauses at once, for scorers that run outside the JVM.
    """
    told = F.transform(T.clauses(F.col("review_text")), lambda c: F.struct(c.alias("clause"), T.theme_mask(c).alias("mask")))
    split = reviews.withColumn("__parts", F.filter(told, lambda c: c["mask"] != 0))
    if many:
        split = split.withColumn("__scores", many(F.transform("__parts", lambda c: c["clause"])))
        split = split.withColumn("__clauses", F.transform("__parts", lambda c, i: F.struct(c["clause"].alias("clause"), c["mask"].alias("mask"), F.get("__scores", i).alias("score"))))
    else:
        split = split.withColumn("__clauses", F.transform("__parts", lambda c: F.struct(c["clause"].alias("clause"), c["mask"].alias("mask"), scorer(c["clause"]).alias("score"))))

    def of(k: int, theme: str) -> Column:
        has = lambda c, bit: c["mask"].bitwiseAND(F.lit(1 << bit)) != 0
        here = F.transform(
            F.filter("__clauses", lambda c: has(c, k)),
            lambda c: F.struct(F.lit(theme).alias("theme"), T.polarity(has(c, 16 + k), c["score"], F.col("rating")).alias("polarity"), c["clause"].alias("clause"), c["score"].alias("clause_score")),
        )
        return T.let(here, lambda found: F.coalesce(F.get(F.filter(found, lambda m: m["polarity"] == "complaint"), F.lit(0)), F.get(found, F.lit(0))))

    found = split.withColumn("__m", F.explode_outer(F.array_compact(F.array(*[of(k, t) for k, t in enumerate(L.THEMES)])))).where("__m IS NOT NULL")  # an inner explode has its array made twice, the first time to see whether it is empty
    return found.select(*[F.col(c) if c in reviews.columns else F.col(f"__m.{c}").alias(c) for c in MENTION_COLUMNS])

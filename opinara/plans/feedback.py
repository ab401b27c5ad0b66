"""Queries over reviews and mentions, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.functions import lexicon as L
from opinara.functions import text as T
from opinara.functions.valence import valence_score
from opinara.operators import enrich, metrics
from opinara.plans.oracle import MENTIONS, REVIEWS, any_word, lit, rnd
from opinara.session import spread
from opinara.sources.reviews import order_reviews, table


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.add_sentiment(order_reviews(spark, sf_dir))


def mentioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.mentions(enriched(spark, sf_dir))


def _me(f):
    return lambda spark, sf: f(mentioned(spark, sf))


def _en(f):
    return lambda spark, sf: f(enriched(spark, sf))


def _both(f):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        reviews = enriched(spark, sf)
        return f(reviews, enrich.mentions(reviews))

    return run


def clause_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = order_reviews(spark, sf).select("review_id", F.posexplode(T.clauses(F.col("review_text"))).alias("pos", "clause"))
    return rows.select("review_id", F.col("pos").cast("long").alias("pos"), "clause")


def language_detect(spark: SparkSession, sf: str) -> DataFrame:
    reviews = order_reviews(spark, sf).select(F.col("review_id").alias("id"), F.col("review_text").alias("t"))
    docs = spread(table(spark, sf, "documents")).select(F.concat(F.lit("D"), F.col("doc_id")).alias("id"), F.col("text").alias("t"))
    return reviews.unionAll(docs).select("id", T.language(F.col("t")).alias("language"))


def emotion_plain(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of each emotion's words, negations aside."""
    text = F.col("review_text")
    counts = [F.regexp_count(text, F.lit(T.whole_words(L.EMOTIONS[n], literal=False))).cast("long").alias(n.lower()) for n in L.EMOTIONS]
    return order_reviews(spark, sf).select("review_id", *counts)


def sentiment_by_language(spark: SparkSession, sf: str) -> DataFrame:
    return enriched(spark, sf).groupBy("language", "sentiment").agg(F.count("*").alias("reviews"))


def vader_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.add_sentiment(order_reviews(spark, sf), valence_score).select("review_id", "sentiment_score", "sentiment", "language")


_MARKED = f"""
words AS (SELECT id, t, regexp_extract_all(lower(t), '[a-z]+') AS w FROM (SELECT review_id AS id, review_text AS t FROM rv UNION ALL SELECT 'D' || doc_id, text FROM documents)),
marked AS (
    SELECT id, t, len(w) AS n, len(list_filter(w, lambda x: list_contains({L.HINGLISH_MARKERS!r}, x))) AS m,
           len(list_filter(w, lambda x: list_contains({[w for w in L.HINGLISH_MARKERS if w not in L.WEAK_MARKERS]!r}, x))) AS s
    FROM words
), lang AS (
    SELECT id, CASE WHEN len(regexp_extract_all(t, '\\p{{L}}')) > 0 AND len(regexp_extract_all(t, '[\\x{{0900}}-\\x{{097F}}]')) > 0.3 * len(regexp_extract_all(t, '\\p{{L}}')) THEN 'Hindi'
                    WHEN s >= 2 OR (s >= 1 AND (m >= 2 OR n <= 5)) THEN 'Hinglish' ELSE 'English' END AS language
    FROM marked
)"""

def language_sql() -> str:
    """``lang``: the language of every review and document."""
    return _MARKED


_EMOTION_COLUMNS = ", ".join(f"len(regexp_extract_all(' ' || replace(review_text, ' ', '  ') || ' ', {lit(any_word([w.replace(' ', '  ') for w in words], literal=False))})) AS {name.lower()}" for name, words in L.EMOTIONS.items())

_UNNEGATED = "(?i)(?:\\b(?:not|no|never|nahi|nahin)|n't|नहीं)\\s+(?:\\w+\\s+)?(?:%s)([^\\p{L}\\p{N}_\\x{0900}-\\x{097F}])"


def _felt(name: str) -> str:
    words, text = [w.replace(" ", "  ") for w in L.EMOTIONS[name]], "' ' || replace(review_text, ' ', '  ') || ' '"
    if name in L.POSITIVE_EMOTIONS:
        text = f"regexp_replace({text}, {lit(_UNNEGATED % '|'.join(words))}, ' \\1', 'g')"
    return f"len(regexp_extract_all({text}, {lit(any_word(words, literal=False))}))"


FEELING = f"""fh AS (SELECT review_id, [{', '.join(_felt(n) for n in L.EMOTIONS)}] AS h FROM rv),
fe AS (SELECT review_id, CASE WHEN list_max(h) = 0 THEN {lit(L.NO_EMOTION)} ELSE [{', '.join(lit(n) for n in L.EMOTIONS)}][list_position(h, list_max(h))] END AS emotion FROM fh)"""

SATISFACTION = """tt AS (
    SELECT theme, count(DISTINCT CASE WHEN product_name = 'Product 1' AND polarity = 'praise' THEN review_id END) AS praise_a,
           count(DISTINCT CASE WHEN product_name = 'Product 1' AND polarity = 'complaint' THEN review_id END) AS complaints_a,
           count(DISTINCT CASE WHEN product_name = 'Product 2' AND polarity = 'praise' THEN review_id END) AS praise_b,
           count(DISTINCT CASE WHEN product_name = 'Product 2' AND polarity = 'complaint' THEN review_id END) AS complaints_b
    FROM me WHERE product_name IN ('Product 1', 'Product 2') GROUP BY theme
), st AS (
    SELECT *, CASE WHEN praise_a + complaints_a >= 2 THEN round_even(praise_a / (praise_a + complaints_a) * 100, 0) END AS satisfaction_a,
           CASE WHEN praise_b + complaints_b >= 2 THEN round_even(praise_b / (praise_b + complaints_b) * 100, 0) END AS satisfaction_b
    FROM tt
)"""

SUMMARY = f"""SELECT theme, count(DISTINCT CASE WHEN polarity = 'praise' THEN review_id END) AS praise, count(DISTINCT CASE WHEN polarity = 'complaint' THEN review_id END) AS complaints,
       count(DISTINCT CASE WHEN polarity = 'neutral' THEN review_id END) AS neutral FROM me GROUP BY theme"""


def _zero_filled(column: str, labels, source: str) -> str:
    rows = ", ".join(f"({lit(k)}, {i})" for i, k in enumerate(labels))
    return f"SELECT l.{column}, position, count(s.{column}) AS reviews FROM (VALUES {rows}) l({column}, position) LEFT JOIN {source} s ON s.{column} = l.{column} GROUP BY 1, 2"


_PER_PRODUCT = "count(*) AS reviews, avg(rating) AS a, count(*) FILTER (sentiment = 'Positive') AS p, count(*) FILTER (sentiment = 'Negative') AS m FROM en"
PRIORITY = f"""
win AS (SELECT epoch_us(max(review_date)) AS last, greatest(floor((epoch_us(max(review_date)) - epoch_us(min(review_date))) / 86400000000.0), 1) AS span FROM rv),
st AS (SELECT last - ((CASE WHEN span >= 120 THEN 30 ELSE greatest(7, floor(span / 4)) END)::BIGINT - 1) * 86400000000 AS start FROM win),
tot AS (SELECT start, count(*) AS total, count(*) FILTER (epoch_us(review_date) >= start) AS recent, count(*) FILTER (epoch_us(review_date) < start) AS earlier FROM rv, st GROUP BY start),
g AS (
    SELECT theme, total, recent, earlier, count(*) AS n, avg(greatest(0, least(1, -clause_score))) AS neg, avg(CASE WHEN rating <= 2 THEN 1.0 ELSE 0 END) AS low, avg(rating) AS avg_r,
           count(*) FILTER (epoch_us(review_date) >= start) AS ri, count(*) FILTER (epoch_us(review_date) < start) AS ei
    FROM me, tot WHERE polarity = 'complaint' GROUP BY ALL
), r AS (SELECT *, CASE WHEN recent >= 5 AND earlier >= 5 THEN ri / recent ELSE 0 END AS rr, CASE WHEN recent >= 5 AND earlier >= 5 THEN ei / earlier ELSE 0 END AS er FROM g),
q AS (
    SELECT *, least(n / total / 0.20, 1.0) AS freq,
           CASE WHEN recent < 5 OR earlier < 5 THEN 0.0 WHEN ri >= 3 AND rr >= 1.5 * greatest(er, 0.01) THEN 1.0 WHEN ri >= 2 AND rr > er THEN 0.5 ELSE 0.0 END AS rise
    FROM r
), s AS (SELECT *, 40 * freq + 25 * neg + 20 * low + 15 * rise AS raw FROM q)"""

QUERIES = {
    "lexicon_sentiment": _en(lambda d: d.select("review_id", "sentiment_score", "sentiment")),
    "vader_sentiment": vader_sentiment,
    "language_detect": language_detect,
    "sentiment_by_language": sentiment_by_language,
    "clause_split": clause_split,
    "mentions_keyword": _me(lambda m: m.select("review_id", "theme", "polarity", "clause", "clause_score")),
    "emotion_hits": emotion_plain,
    "emotion": lambda spark, sf: enrich.add_emotion(order_reviews(spark, sf)).select("review_id", "emotion"),
    "emotion_mix": lambda spark, sf: metrics.label_counts(enrich.add_emotion(order_reviews(spark, sf)), "emotion", [*L.EMOTIONS, L.NO_EMOTION]),
    "sentiment_mix": _en(lambda d: metrics.label_counts(d, "sentiment", L.SENTIMENTS)),
    "rating_histogram": _en(metrics.rating_histogram),
    "theme_summary": _both(lambda r, m: metrics.theme_summary(m, r)),
    "theme_map": _both(lambda r, m: metrics.theme_map(metrics.theme_summary(m, r))),
    "top_complaints": _me(metrics.top_complaints),
    "priority_ranking": _both(metrics.priority_ranking),
    "evidence_topk": _me(metrics.evidence),
    "fix_impact": _both(metrics.fix_impact),
    "top_words": _me(lambda m: metrics.top_words(m, "complaint")),
    "product_metrics": _en(metrics.product_metrics),
    "theme_satisfaction": _me(lambda m: metrics.theme_table(m, "Product 1", "Product 2")),
    "strengths": _me(lambda m: metrics.strengths(metrics.theme_table(m, "Product 1", "Product 2"), gap=2)),
}

_STOP = "[" + ", ".join(lit(w) for w in sorted({*L.STOP_WORDS, *L.CLOUD_STOP_WORDS})) + "]"
ORACLES = {
    "lexicon_sentiment": f"WITH {REVIEWS} SELECT review_id, sentiment_score, sentiment FROM en",
    "language_detect": f"WITH {REVIEWS}, {_MARKED} SELECT id, language FROM lang",
    "sentiment_by_language": f"WITH {REVIEWS}, {_MARKED} SELECT language, sentiment, count(*) AS reviews FROM en JOIN lang ON id = review_id GROUP BY ALL",
    "clause_split": f"WITH {MENTIONS} SELECT review_id, CAST(row_number() OVER (PARTITION BY review_id ORDER BY pos) - 1 AS BIGINT) AS pos, clause FROM rv JOIN cl USING (review_text)",
    "mentions_keyword": f"WITH {MENTIONS} SELECT review_id, theme, polarity, clause, clause_score FROM me",
    "emotion_hits": f"WITH {REVIEWS} SELECT review_id, {_EMOTION_COLUMNS} FROM rv",
    "emotion": f"WITH {REVIEWS}, {FEELING} SELECT review_id, emotion FROM fe",
    "emotion_mix": f"WITH {REVIEWS}, {FEELING} {_zero_filled('emotion', [*L.EMOTIONS, L.NO_EMOTION], 'fe')}",
    "sentiment_mix": f"WITH {REVIEWS} {_zero_filled('sentiment', L.SENTIMENTS, 'en')}",
    "rating_histogram": f"WITH {REVIEWS} SELECT stars, count(review_id) AS reviews FROM (SELECT unnest(range(1, 6))::INT AS stars) LEFT JOIN rv ON round_even(rating, 0) = stars GROUP BY 1",
    "theme_summary": f"WITH {MENTIONS}, s AS ({SUMMARY}), n AS (SELECT count(*) AS total FROM rv) SELECT s.*, {rnd('praise / total * 100', 1)} AS praise_pct, {rnd('complaints / total * 100', 1)} AS complaint_pct FROM s, n",
    "theme_map": f"WITH {MENTIONS}, s AS ({SUMMARY}) SELECT theme, praise + complaints + neutral AS mentions, {rnd('(praise - complaints) / (praise + complaints) * 100', 1)} AS net FROM s WHERE praise + complaints > 0",
    "top_complaints": f"WITH {MENTIONS} SELECT theme, count(DISTINCT review_id) AS mentions, arg_min(review_text, (clause_score, review_id)) AS example_review FROM me WHERE polarity = 'complaint' GROUP BY theme ORDER BY mentions DESC, theme LIMIT 5",
    "priority_ranking": f"""WITH {MENTIONS}, {PRIORITY}
        SELECT theme, CASE WHEN raw >= 70 AND n >= 5 THEN 'Critical' WHEN raw >= 50 AND n >= 3 THEN 'High' WHEN raw >= 30 AND n >= 2 THEN 'Medium' ELSE 'Low' END AS level, {rnd('raw', 1)} AS score,
               n AS complaint_reviews, {rnd('n / total * 100', 1)} AS share_pct, {rnd('avg_r', 2)} AS avg_rating, {rnd('freq', 2)} AS frequency, {rnd('neg', 2)} AS negativity, {rnd('low', 2)} AS low_ratings,
               rise AS recent_rise, {rnd('rr * 100', 1)} AS recent_rate_pct, {rnd('er * 100', 1)} AS earlier_rate_pct FROM s""",
    "evidence_topk": f"""WITH {MENTIONS} SELECT theme, polarity, row_number() OVER (PARTITION BY theme, polarity ORDER BY CASE WHEN polarity = 'complaint' THEN clause_score ELSE -clause_score END, review_date DESC, review_id) AS rank,
        review_id, clause, clause_score FROM me WHERE polarity IN ('complaint', 'praise') QUALIFY rank <= 3""",
    "fix_impact": f"""WITH {MENTIONS}, n AS (SELECT count(*) AS n, sum(rating) AS s FROM rv), h AS (SELECT DISTINCT theme, review_id, rating FROM me WHERE polarity = 'complaint'),
        o AS (SELECT theme, count(*) AS affected, (any_value(s) - sum(rating)) / (any_value(n) - count(*)) AS others, any_value(n) AS n, any_value(s) AS s FROM h, n GROUP BY theme),
        p AS (SELECT theme, affected, s / n AS cur, (s - sum(rating) + sum(greatest(rating, others))) / n AS proj FROM h JOIN o USING (theme) WHERE affected < n GROUP BY theme, affected, s, n)
        SELECT theme, affected, {rnd('cur', 2)} AS current_avg, {rnd('proj', 2)} AS projected_avg, {rnd('proj - cur', 2)} AS gain FROM p""",
    "top_words": f"""WITH {MENTIONS}, w AS (SELECT review_id, unnest(regexp_extract_all(lower(clause), '[a-z\\x{{0900}}-\\x{{097F}}][a-z''\\x{{0900}}-\\x{{097F}}]{{2,}}')) AS word FROM me WHERE polarity = 'complaint')
        SELECT word, count(DISTINCT review_id) AS reviews FROM w WHERE NOT list_contains({_STOP}, word) GROUP BY word HAVING reviews >= 2 ORDER BY reviews DESC, word LIMIT 28""",
    "product_metrics": f"""WITH {REVIEWS}, g AS (SELECT product_name, {_PER_PRODUCT} GROUP BY 1 UNION ALL SELECT 'All', {_PER_PRODUCT})
        SELECT product_name, reviews, {rnd('a', 2)} AS avg_rating, {rnd('p / reviews * 100', 1)} AS positive_pct, {rnd('m / reviews * 100', 1)} AS negative_pct,
               round_even(100 * (0.5 * (a - 1) / 4 + 0.5 * ((p - m) / reviews + 1) / 2), 0)::INT AS health FROM g""",
    "theme_satisfaction": f"WITH {MENTIONS}, {SATISFACTION} SELECT * FROM st",
    "strengths": f"""WITH {MENTIONS}, {SATISFACTION} SELECT CASE WHEN satisfaction_a > satisfaction_b THEN 'better' ELSE 'worse' END AS verdict,
        row_number() OVER (PARTITION BY satisfaction_a > satisfaction_b ORDER BY abs(satisfaction_a - satisfaction_b) DESC, theme) AS rank, theme, satisfaction_a - satisfaction_b AS gap
        FROM st WHERE abs(satisfaction_a - satisfaction_b) >= 2 QUALIFY rank <= 3""",
}

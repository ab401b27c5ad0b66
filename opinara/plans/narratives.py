"""Queries that tell the results, and the batch run of the streaming form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.operators import enrich, narrate, risk
from opinara.functions import lexicon as L
from opinara.plans.feedback import PRIORITY, SUMMARY, enriched, language_sql, mentioned
from opinara.plans.oracle import MENTIONS, REVIEWS, SIMILAR, lit, rnd
from opinara.plans.series import BURST, SIGNALS, SPIKES, event_reviews
from opinara.streaming.trends import trend_stream


def key_insights(spark: SparkSession, sf: str) -> DataFrame:
    reviews = enriched(spark, sf)
    return narrate.key_insights(reviews, enrich.mentions(reviews))


def headline(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(narrate.headline(mentioned(spark, sf)),)], "headline string")


def stats_context(spark: SparkSession, sf: str) -> DataFrame:
    reviews = enriched(spark, sf)
    return spark.createDataFrame([(narrate.stats_context(reviews, enrich.mentions(reviews)),)], "text string")


def markdown_lines(spark: SparkSession, sf: str) -> DataFrame:
    made = F.concat(F.lit("# Review "), "review_id", F.lit("\n\n- "), "review_text", F.lit("\n_(made)_\nend"))
    return narrate.markdown_lines(enriched(spark, sf).select(F.col("review_id").alias("id"), made.alias("text"))).select("id", F.col("pos").cast("long").alias("pos"), "kind", "line")


def integrity(spark: SparkSession, sf: str) -> DataFrame:
    reviews = enriched(spark, sf)
    return narrate.integrity(risk.assess(reviews, risk.similar_reviews(reviews)))


QUERIES = {
    "key_insights": key_insights,
    "headline": headline,
    "stats_context": stats_context,
    "markdown_lines": markdown_lines,
    "integrity": integrity,
    "stream_trend_daily": lambda spark, sf: trend_stream(event_reviews(spark, sf)),
}
_PERCENT = "printf('%.0f%%', {} * 100)"
_TOLD = f"""{language_sql()},
sm AS ({SUMMARY}), {PRIORITY},
ev AS (SELECT theme, polarity, list(review_id ORDER BY k)[1:3] AS ids FROM (
    SELECT theme, polarity, review_id, row_number() OVER (PARTITION BY theme, polarity ORDER BY CASE WHEN polarity = 'complaint' THEN clause_score ELSE -clause_score END, review_date DESC, review_id) AS k
    FROM me WHERE polarity IN ('complaint', 'praise')) GROUP BY ALL),
oa AS (SELECT count(*) AS n, avg(rating) AS a, count(*) FILTER (sentiment = 'Positive') AS p, count(*) FILTER (language <> 'English') AS i, count(*) FILTER (rating <= 2) AS low FROM en JOIN lang ON id = review_id),
dr AS (SELECT theme, count(DISTINCT review_id) AS k FROM me WHERE polarity = 'complaint' AND rating <= 2 GROUP BY 1 ORDER BY k DESC, theme LIMIT 1),
ki AS (
    SELECT 0 AS part, 0 AS turn, 'overview' AS kind, printf('%d reviews, %.1f stars on average, ', n, a) || {_PERCENT.format('p / n')} || ' positive.' AS text, NULL AS theme, NULL AS side FROM oa WHERE n > 0
    UNION ALL SELECT 1, row_number() OVER (ORDER BY praise DESC, theme) AS turn, 'praise', theme || ' is praised in ' || praise || ' reviews.', theme, 'praise' FROM sm WHERE praise >= 2 QUALIFY turn <= 2
    UNION ALL SELECT 2, row_number() OVER (ORDER BY complaints DESC, praise DESC, theme) AS turn, 'complaint', theme || ' is a recurring complaint (' || complaints || ' reviews).', theme, 'complaint' FROM sm WHERE complaints >= 2 QUALIFY turn <= 3
    UNION ALL SELECT 3, row_number() OVER (ORDER BY theme), 'rise', theme || ' complaints rose to ' || {rnd('rr * 100', 1)} || ' % of recent reviews from ' || {rnd('er * 100', 1)} || ' %.', theme, 'complaint' FROM s WHERE rise = 1
    UNION ALL SELECT 4, 0, 'driver', theme || ' drives low ratings: ' || k || ' of ' || low || '.', theme, 'complaint' FROM dr, oa WHERE low >= 3
    UNION ALL SELECT 5, row_number() OVER (ORDER BY praise DESC, theme), 'single', 'One review complains of ' || theme || '.', theme, 'complaint' FROM sm WHERE complaints = 1
    UNION ALL SELECT 6, 0, 'language', {_PERCENT.format('i / n')} || ' of the reviews are in Hindi or Hinglish.', NULL, NULL FROM oa WHERE i > 0
)"""
_LOVED = "(SELECT theme, count(DISTINCT review_id) AS n FROM me WHERE polarity = '{}' GROUP BY 1 HAVING n >= 2 ORDER BY n DESC, theme LIMIT 1)"


def _labels(column: str, labels, source: str) -> str:
    return " || ', ' || ".join(f"{lit(k + ' ')} || (SELECT count(*) FROM {source} WHERE {column} = {lit(k)})" for k in labels)


ORACLES = {
    "key_insights": f"WITH {MENTIONS}, {_TOLD} SELECT (row_number() OVER (ORDER BY part, turn) - 1)::INT AS seq, kind, text, coalesce(ids, []::VARCHAR[]) AS evidence FROM ki LEFT JOIN ev ON ev.theme = ki.theme AND polarity = side",
    "headline": f"""WITH {MENTIONS}, p AS {_LOVED.format('praise')}, c AS {_LOVED.format('complaint')}, o AS (SELECT (SELECT theme FROM p) AS p, (SELECT theme FROM c) AS c)
        SELECT CASE WHEN p IS NOT NULL AND c IS NOT NULL THEN 'Customers love ' || lower(p) || ', but ' || lower(c) || ' keeps coming up as a problem.' WHEN p IS NOT NULL THEN 'Customers love ' || lower(p) || ', and no complaint keeps coming up.'
                    WHEN c IS NOT NULL THEN c || ' keeps coming up as a problem.' ELSE 'No theme stands out yet.' END AS headline FROM o""",
    "stats_context": f"""WITH {MENTIONS}, {_TOLD}, {SPIKES}, li AS (
            SELECT 0 AS part, 0 AS turn, printf('Reviews: %d (%s to %s)', count(*), strftime(min(review_date), '%Y-%m-%d'), strftime(max(review_date), '%Y-%m-%d')) AS line FROM rv
            UNION ALL SELECT 1, 0, printf('Average rating: %.2f/5', avg(rating)) FROM rv
            UNION ALL SELECT 2, 0, 'Ratings: ' || (SELECT string_agg(k || ': ' || (SELECT count(*) FROM rv WHERE round_even(rating, 0) = k), ', ' ORDER BY k) FROM (SELECT unnest(range(1, 6)) AS k))
            UNION ALL SELECT 3, 0, 'Sentiment: ' || {_labels('sentiment', L.SENTIMENTS, 'en')}
            UNION ALL SELECT 4, 0, 'Language: ' || {_labels('language', L.LANGUAGES, '(SELECT language FROM en JOIN lang ON id = review_id)')}
            UNION ALL SELECT 5, row_number() OVER (ORDER BY theme), '- ' || theme || ': ' || praise || ' praise, ' || complaints || ' complaints' FROM sm
            UNION ALL SELECT 6, row_number() OVER (ORDER BY score DESC, theme), '- ' || theme || ': ' || level || ' (' || score || ')' FROM (
                SELECT theme, CASE WHEN raw >= 70 AND n >= 5 THEN 'Critical' WHEN raw >= 50 AND n >= 3 THEN 'High' WHEN raw >= 30 AND n >= 2 THEN 'Medium' ELSE 'Low' END AS level, {rnd('raw', 1)} AS score FROM s)
            UNION ALL SELECT 7, row_number() OVER (ORDER BY signal), '- ' || signal || ': ' || severity FROM al)
        SELECT string_agg(line, chr(10) ORDER BY part, turn) AS text FROM li""",
    "integrity": f"""WITH {REVIEWS}, {SIMILAR}, {BURST}, {SIGNALS} SELECT count(*) AS reviews, count(*) FILTER (risk_score >= 55) AS high, count(*) FILTER (risk_score BETWEEN 30 AND 54) AS medium, count(*) FILTER (risk_score < 30) AS low,
        count(*) FILTER ({rnd('max_similarity', 2)} >= 0.9) AS copies FROM sp""",
    "markdown_lines": f"WITH {REVIEWS} SELECT review_id AS id, unnest([0, 2, 4])::BIGINT AS pos, unnest(['heading', 'bullet', 'text']) AS kind, unnest(['Review ' || review_id, review_text, 'end']) AS line FROM rv",
    "stream_trend_daily": "SELECT date_trunc('day', ts)::TIMESTAMP AS period, count(*) AS reviews, count(*) FILTER (1 + floor(value)::BIGINT % 5 <= 2) AS low_ratings, avg(1 + floor(value)::BIGINT % 5) AS avg_rating FROM events GROUP BY 1",
}

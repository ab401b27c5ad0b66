"""Queries over time, risk and similarity, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.functions import lexicon as L
from opinara.functions import text as T
from opinara.operators import risk, trends, wishlist
from opinara.operators.similarity import nearest
from opinara.plans.feedback import enriched, mentioned
from opinara.plans.oracle import MENTIONS, REVIEWS, SIMILAR, alike, any_word, lit, rnd, tfidf
from opinara.sources.reviews import table


def event_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Events as reviews: the type is the product, and the value gives stars and sentiment."""
    stars = (1 + F.floor("value") % 5).cast("double")
    return table(spark, sf, "events").select(
        F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("review_id"), F.col("event_type").alias("product_name"), stars.alias("rating"), F.col("ts").cast("timestamp").alias("review_date"),
        F.when(stars >= 4, "Positive").when(stars <= 2, "Negative").otherwise("Neutral").alias("sentiment"),
    )


_EV = """ev AS (
    SELECT 'E' || event_id AS review_id, event_type AS product_name, (1 + floor(value)::BIGINT % 5)::DOUBLE AS rating, ts::TIMESTAMP AS review_date,
           CASE WHEN 1 + floor(value)::BIGINT % 5 >= 4 THEN 'Positive' WHEN 1 + floor(value)::BIGINT % 5 <= 2 THEN 'Negative' ELSE 'Neutral' END AS sentiment FROM events
)"""


def trend_sql(source: str, unit: str, cte: bool = False) -> str:
    """The trend of ``source``, as what follows WITH, or as a query of its own."""
    return ("WITH " if cte else "") + f"""
        by_p AS (SELECT date_trunc('{unit}', review_date)::TIMESTAMP AS period, count(*) AS reviews, count(*) FILTER (sentiment = 'Positive') AS positive, count(*) FILTER (sentiment = 'Negative') AS negative,
                        count(*) FILTER (rating <= 2) AS low_ratings, {rnd('avg(rating)', 2)} AS avg_rating FROM {source} GROUP BY 1),
        spine AS (SELECT unnest(generate_series((SELECT min(period) FROM by_p), (SELECT max(period) FROM by_p), INTERVAL 1 {unit})) AS period)
        SELECT period, coalesce(reviews, 0) AS reviews, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative, coalesce(low_ratings, 0) AS low_ratings, avg_rating,
               CASE WHEN reviews > 0 THEN {rnd('negative / reviews * 100', 1)} END AS negative_pct FROM spine LEFT JOIN by_p USING (period)"""


def spike_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts, with the ids they rest on; the source plants a rise of complaints."""
    return trends.spike_alerts(enriched(spark, sf), mentioned(spark, sf)).select("signal", "severity", "recent_pct", "baseline_pct", "evidence")


def tfidf_near_dups(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return nearest(docs, T.similarity_text(F.col("text"))).select("id", "partner", "similarity")


def risk_score(spark: SparkSession, sf: str) -> DataFrame:
    reviews = enriched(spark, sf)
    return risk.assess(reviews, risk.similar_reviews(reviews)).select("review_id", "risk_score", "risk_level", F.array_join("risk_reasons", "; ").alias("reasons"))


def wishlist_counts(spark: SparkSession, sf: str) -> DataFrame:
    reviews = enriched(spark, sf)
    requests = wishlist.extract_requests(reviews)
    return wishlist.wishlist_counts(requests, wishlist.group_requests(requests), reviews)


def similar_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return risk.similar_reviews(enriched(spark, sf))


_WORD = "[\\p{L}\\p{N}_\\x{0900}-\\x{097F}]+"
BURST = """daily AS (SELECT product_name, review_date::DATE AS day, count(*) AS n FROM rv GROUP BY ALL),
typ AS (SELECT product_name, median(n) AS typical FROM daily GROUP BY 1),
alike AS (SELECT product_name, review_date::DATE AS day, rating, count(*) AS same_day FROM rv GROUP BY ALL),
bu AS (SELECT rv.review_id, same_day, typical, same_day >= 3 AND same_day >= 3 * typical AS burst FROM rv JOIN typ USING (product_name)
       JOIN alike ON alike.product_name = rv.product_name AND alike.day = review_date::DATE AND alike.rating = rv.rating)"""
_NO_THEME = " AND ".join(f"NOT regexp_matches(regexp_replace(' ' || review_text || ' ', {lit(any_word(s['exclude']) if 'exclude' in s else '$^')}, '  ', 'g'), {lit(any_word(s['keywords'] + s['complaint']))})" for s in L.THEMES.values())
_CAPS = "len(regexp_extract_all(review_text, '[A-Z]'))"
_LETTERS = "len(regexp_extract_all(review_text, '[A-Za-z]'))"
SIGNALS = f"""sg AS (
    SELECT review_id, rating, coalesce(max_similarity, 0) AS max_similarity, [
        CASE WHEN max_similarity >= 0.9 THEN {{'p': 40, 'r': 'Near-duplicate of review ' || similar_to}} WHEN max_similarity >= 0.75 THEN {{'p': 20, 'r': 'Very similar to review ' || similar_to}} END,
        CASE WHEN burst THEN {{'p': 20, 'r': 'Part of a burst of ' || same_day}} END,
        CASE WHEN len(regexp_extract_all(review_text, '\\S+')) <= 6 AND {_NO_THEME} THEN {{'p': 15, 'r': 'Generic text with no specific product detail'}} END,
        CASE WHEN regexp_matches(review_text, {lit(L.PROMO)}) THEN {{'p': 10, 'r': 'Promotional or exaggerated phrasing'}} END,
        CASE WHEN NOT regexp_matches(review_text, {lit(L.CONTRAST)}) AND ((rating >= 4 AND sentiment_score <= -0.5) OR (rating <= 2 AND sentiment_score >= 0.5)) THEN {{'p': 15, 'r': 'Star rating contradicts the review text'}} END,
        CASE WHEN regexp_matches(review_text, '!{{3,}}') OR ({_LETTERS} >= 10 AND {_CAPS} > 0.6 * {_LETTERS}) THEN {{'p': 10, 'r': 'Excessive punctuation or capital letters'}} END
    ] AS raw FROM en JOIN bu USING (review_id) LEFT JOIN sim USING (review_id)
), sf AS (SELECT review_id, rating, max_similarity, list_filter(raw, lambda x: x IS NOT NULL) AS h FROM sg),
sx AS (SELECT review_id, max_similarity, CASE WHEN rating IN (1, 5) AND len(h) > 0 THEN list_append(h, {{'p': 5, 'r': 'Extreme rating combined with other signals'}}) ELSE h END AS h FROM sf),
sp AS (SELECT review_id, max_similarity, least(100, coalesce(list_sum(list_transform(h, lambda x: x.p)), 0))::INT AS risk_score, array_to_string(list_transform(h, lambda x: x.r), '; ') AS reasons FROM sx)"""
_REQUESTS = f"""rq AS (
    SELECT review_id, trim(s) AS request FROM (SELECT review_id, unnest(string_split(regexp_replace(review_text, '([.!?।])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM rv)
    WHERE trim(s) <> '' AND regexp_matches(s, {lit(L.REQUEST)})
)"""

_KEY = "lower(request)"
for _pattern, _to in L.REQUEST_SYNONYMS:
    _KEY = f"regexp_replace({_KEY}, {lit(_pattern)}, {lit(_to)}, 'g')"
_GROUPS = f"""{_REQUESTS},
kq AS (SELECT rq.*, rv.product_name, rv.review_date, regexp_replace({_KEY}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g') AS key FROM rq JOIN rv USING (review_id)),
kt AS (SELECT key AS id, key AS text, count(*) AS n, min({{'d': review_date, 'r': review_id}}) AS first FROM kq GROUP BY key),
{tfidf('kv', 'kt', '[\\p{L}\\p{N}_]{2,}', 'SELECT count(*) FROM kq', sublinear=True, stop=True)},
kp AS ({alike('kv', L.REQUEST_SIMILARITY)}),
ku AS (SELECT kp.id, arg_min(partner, (o.first, o.id)) AS up FROM kp JOIN kt m ON m.id = kp.id JOIN kt o ON o.id = partner WHERE (o.first, o.id) < (m.first, m.id) GROUP BY 1),
kr AS (SELECT id, id AS grp FROM kt WHERE id NOT IN (SELECT id FROM ku) UNION ALL SELECT ku.id, grp FROM ku JOIN kr ON kr.id = up),
km AS (SELECT kq.*, grp FROM kq JOIN kr ON kr.id = key),
gr AS (
    SELECT count(DISTINCT review_id) AS reviews, list(DISTINCT product_name ORDER BY product_name) AS products, max(review_date) AS last_date, any_value(best) AS request, list(DISTINCT request ORDER BY request)[1:3] AS examples
    FROM km JOIN (SELECT grp, request AS best FROM km GROUP BY grp, request QUALIFY row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, length(request), request DESC) = 1) USING (grp) GROUP BY grp
)"""

QUERIES = {
    "trend_daily": lambda spark, sf: trends.review_trends(event_reviews(spark, sf), "Daily"),
    "trend_weekly": lambda spark, sf: trends.review_trends(enriched(spark, sf), "Weekly"),
    "trend_monthly": lambda spark, sf: trends.review_trends(enriched(spark, sf), "Monthly"),
    "theme_trend": lambda spark, sf: trends.theme_trends(mentioned(spark, sf), "Monthly"),
    "auto_frequency": lambda spark, sf: trends.auto_frequency(event_reviews(spark, sf)),
    "spike_windows": lambda spark, sf: trends.alert_windows(event_reviews(spark, sf)).select(*[F.col(c).cast("timestamp").alias(c) for c in ("baseline_start", "recent_start", "data_end")]),
    "spike_alerts": spike_alerts,
    "burst_flags": lambda spark, sf: risk.burst_flags(enriched(spark, sf)).select("review_id", "same_day", "typical", "burst"),
    "risk_score": risk_score,
    "tfidf_near_dups": tfidf_near_dups,
    "similar_reviews": similar_reviews,
    "request_extract": lambda spark, sf: wishlist.extract_requests(enriched(spark, sf)).select("review_id", "request"),
    "request_groups": lambda spark, sf: wishlist.group_requests(wishlist.extract_requests(enriched(spark, sf))),
    "wishlist_counts": wishlist_counts,
}

_WINDOWS = """w0 AS (SELECT min(review_date)::DATE AS first, max(review_date)::DATE AS last FROM {src}),
w1 AS (SELECT first, last, last - ((CASE WHEN last - first + 1 >= 70 THEN 14 ELSE greatest(7, (last - first + 1) // 4) END) - 1)::INT AS recent_start FROM w0),
ww AS (SELECT greatest(first, recent_start - 56) AS baseline_start, recent_start, last AS data_end FROM w1)"""
SPIKES = f"""{_WINDOWS.format(src='en')},
pl AS (SELECT en.*, review_date::DATE >= recent_start AS late, recent_start, baseline_start, data_end FROM en, ww WHERE review_date::DATE >= baseline_start),
ml AS (SELECT me.*, review_date::DATE >= recent_start AS late FROM me, ww WHERE review_date::DATE >= baseline_start AND polarity = 'complaint'),
n AS (SELECT count(*) FILTER (late) AS r, count(*) FILTER (NOT late) AS b, avg(rating) FILTER (late) AS ra, avg(rating) FILTER (NOT late) AS ba, any_value(data_end - recent_start) + 1 AS dr, greatest(any_value(recent_start - baseline_start), 1) AS db FROM pl),
hits AS (
    SELECT 'Negative reviews' AS signal, review_id, review_date, late, 4 AS least, 0.15 AS jump FROM pl WHERE sentiment = 'Negative'
    UNION ALL SELECT 'Low ratings (1-2 stars)', review_id, review_date, late, 4, 0.15 FROM pl WHERE rating <= 2
    UNION ALL SELECT theme || ' complaints', review_id, review_date, late, 3, 0.10 FROM ml
),
rt AS (SELECT signal, least, jump, count(DISTINCT review_id) FILTER (late) AS hr, count(DISTINCT review_id) FILTER (late) / any_value(r) AS rr, count(DISTINCT review_id) FILTER (NOT late) / any_value(b) AS br,
              (list(review_id ORDER BY review_date DESC, review_id) FILTER (late))[1:3] AS evidence FROM hits, n WHERE r >= 8 AND b >= 15 GROUP BY ALL),
al AS (SELECT signal, CASE WHEN rr - br >= 0.25 OR br = 0 OR rr >= 3 * br THEN 'High' ELSE 'Medium' END AS severity, {rnd('rr * 100', 1)} AS recent_pct, {rnd('br * 100', 1)} AS baseline_pct, evidence
FROM rt WHERE hr >= least AND rr - br >= jump AND rr >= 1.5 * br
UNION ALL SELECT 'Review volume', 'Info', NULL, NULL, []::VARCHAR[] FROM n WHERE r >= 10 AND r / dr >= 2 * b / db
UNION ALL SELECT 'Average rating', CASE WHEN ba - ra >= 1 THEN 'High' ELSE 'Medium' END, NULL, NULL, []::VARCHAR[] FROM n WHERE ba - ra >= 0.5)"""

ORACLES = {
    "trend_daily": f"WITH {_EV}, {trend_sql('ev', 'DAY')}",
    "trend_weekly": f"WITH {REVIEWS}, {trend_sql('en', 'WEEK')}",
    "trend_monthly": f"WITH {REVIEWS}, {trend_sql('en', 'MONTH')}",
    "theme_trend": f"WITH {MENTIONS} SELECT date_trunc('MONTH', review_date)::TIMESTAMP AS period, theme, count(DISTINCT review_id) AS reviews FROM me WHERE polarity = 'complaint' GROUP BY ALL",
    "auto_frequency": f"WITH {_EV}, s AS (SELECT floor((epoch_us(max(review_date)) - epoch_us(min(review_date))) / 86400000000.0)::BIGINT AS days FROM ev) SELECT days, CASE WHEN days <= 45 THEN 'Daily' WHEN days <= 240 THEN 'Weekly' ELSE 'Monthly' END AS frequency FROM s",
    "spike_windows": f"WITH {_EV}, {_WINDOWS.format(src='ev')} SELECT baseline_start::TIMESTAMP AS baseline_start, recent_start::TIMESTAMP AS recent_start, data_end::TIMESTAMP AS data_end FROM ww",
    "spike_alerts": f"WITH {MENTIONS}, {SPIKES} SELECT * FROM al",
    "burst_flags": f"WITH {REVIEWS}, {BURST} SELECT * FROM bu",
    "similar_reviews": f"WITH {REVIEWS}, {SIMILAR} SELECT * FROM sim",
    "risk_score": f"WITH {REVIEWS}, {SIMILAR}, {BURST}, {SIGNALS} SELECT review_id, risk_score, CASE WHEN risk_score >= 55 THEN 'High' WHEN risk_score >= 30 THEN 'Medium' ELSE 'Low' END AS risk_level, reasons FROM sp",
    "tfidf_near_dups": f"""WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM documents),
        t AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM d),
        f AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT count(*) AS n FROM d), df AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
        v AS (SELECT id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM f JOIN df USING (term), n), m AS (SELECT id, sqrt(sum(w * w)) AS norm FROM v GROUP BY 1),
        x AS (SELECT id, term, w / norm AS w FROM v JOIN m USING (id)),
        p AS (SELECT a.id, b.id AS partner, floor(sum(a.w * b.w) * 1000000 + 0.5) / 1000000 AS similarity FROM x a JOIN x b ON a.term = b.term AND a.id <> b.id GROUP BY ALL)
        SELECT id, partner, similarity FROM p WHERE similarity >= 0.75 QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, partner) = 1""",
    "request_extract": f"WITH {REVIEWS}, {_REQUESTS} SELECT * FROM rq",
    "request_groups": f"WITH RECURSIVE {REVIEWS}, {_GROUPS} SELECT * FROM gr",
    "wishlist_counts": f"WITH RECURSIVE {REVIEWS}, {_GROUPS} SELECT (SELECT count(*) FROM rq) AS requests, (SELECT count(*) FROM gr) AS groups, (SELECT count(DISTINCT review_id) FROM rq) AS asking, {rnd('(SELECT count(DISTINCT review_id) FROM rq) / (SELECT count(*) FROM rv) * 100', 1)} AS asking_pct",
}

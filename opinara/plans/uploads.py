"""Queries over files that are written and read back, videos, queues and displays, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.functions import parsing as P
from opinara.operators import ingest, metrics, narrate, risk, serve, trends
from opinara.operators.enrich import add_emotion
from opinara.functions.text import emotion_label
from opinara.functions import lexicon as L
from opinara.plans.feedback import FEELING, SATISFACTION, enriched, mentioned
from opinara.plans.ingesting import DIRTY, MOMENTS, dirty_reviews, moment_asof
from opinara.plans.oracle import MENTIONS, REVIEWS, SIMILAR, lit, rnd
from opinara.plans.series import BURST, SIGNALS, trend_sql
from opinara.schema import VIDEO_SCHEMA
from opinara.sources import files
from opinara.sources.reviews import order_reviews, table
from opinara.storage import fresh_path


# ---- files ---------------------------------------------------------------------------------------------
def _raw_file(spark: SparkSession, sf: str) -> str:
    """Reviews as a file of other names, parted by semicolons."""
    path = fresh_path(spark, "upload")
    rows = order_reviews(spark, sf).select(
        F.col("review_id").alias("Review ID"), F.col("product_name").alias("Item"), F.col("review_text").alias("comment"), F.format_string("%d/5", F.col("rating").cast("int")).alias("Stars"), F.date_format("review_date", "yyyy-MM-dd").alias("created at")
    )
    rows.write.csv(path, header=True, sep=";", escape='"')
    return path


def ingest_csv(spark: SparkSession, sf: str) -> DataFrame:
    rows = files.read_reviews(spark, _raw_file(spark, sf), "upload")
    return rows.select("review_id", "product_name", "rating", "review_date", F.md5("review_text").alias("digest"), "source_file")


def ingest_mapping(spark: SparkSession, sf: str) -> DataFrame:
    found = ingest.detect_columns(files.read_delimited(spark, _raw_file(spark, sf)))
    return spark.createDataFrame([(f, c, found.method[f]) for f, c in found.columns.items()], "field string, column string, method string")


def ingest_latin(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written in Latin-1, of which most lines are ASCII, some lines hold quotes, and texts span lines."""
    path = fresh_path(spark, "latin")
    rows = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.regexp_replace(F.regexp_replace("text", "[^\\x00-\\xFF]", "?"), "\\r", "").alias("text"))
    rows.orderBy(F.length("id"), "id").coalesce(1).write.csv(path, header=True, encoding="ISO-8859-1", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return files.read_delimited(spark, path).select(F.col("id").cast("long").alias("doc_id"), F.md5("text").alias("digest"))


def export_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "export")
    files.export(order_reviews(spark, sf).withColumn("tags", F.array("product_name", F.lit("made"))), path)
    back = files.read_delimited(spark, path)
    return back.select("review_id", "product_name", F.col("rating").cast("double").alias("rating"), "tags", F.md5("review_text").alias("digest"))


def rows_numbered(spark: SparkSession, sf: str) -> DataFrame:
    rows = ingest.numbered(order_reviews(spark, sf).repartition(7))
    return rows.agg(F.count("*").alias("n"), F.count_distinct("_row").alias("numbers"), F.min("_row").alias("low"), F.max("_row").alias("high"))


# ---- videos --------------------------------------------------------------------------------------------
def videos(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth order as a video review, written to a store and read back."""
    path = fresh_path(spark, "videos")
    key = F.substring("review_id", 2, 20).cast("long")
    rows = enriched(spark, sf).withColumn("__k", key).where("__k % 10 = 3")
    told = {
        "source": F.lit("YouTube"), "rating_estimated": F.lit(True), "video_title": F.when(F.col("__k") % 20 == 3, F.concat(F.lit("Film "), "review_id")), "video_id": F.lpad("review_id", 11, "v"), "channel": F.lit("c"),
        "views": F.col("__k") * 997, "rating": P.estimated_rating(F.col("sentiment_score")), "timestamps": F.array(F.struct(F.lit(0).alias("offset"), F.lit(0.5).alias("seconds")), F.struct(F.lit(20).alias("offset"), F.lit(4.5).alias("seconds"))),
    }
    files.write_videos(rows.withColumns(told).drop("__k"), path)
    return files.read_videos(spark, path)


def video_store(spark: SparkSession, sf: str) -> DataFrame:
    return videos(spark, sf).select("review_id", "rating", "views", "video_title", F.element_at("timestamps", 2)["seconds"].alias("second"))


def video_fields(spark: SparkSession, sf: str) -> DataFrame:
    kept = files.analysis_fields(videos(spark, sf))
    return kept.agg(F.count("*").alias("videos"), F.lit(len(kept.columns)).cast("long").alias("fields"), F.lit("timestamps" in kept.columns).alias("stamps"))


def video_reach(spark: SparkSession, sf: str) -> DataFrame:
    scored = videos(spark, sf).join(enriched(spark, sf).select("review_id", "sentiment"), "review_id")
    return narrate.video_reach(scored)


def video_markers(spark: SparkSession, sf: str) -> DataFrame:
    both = ingest.union_all([order_reviews(spark, sf).withColumn("source", F.lit("text")), videos(spark, sf)])
    return trends.video_markers(both, videos(spark, sf))


_FORMS = ("https://www.youtube.com/watch?v=%s", "https://youtu.be/%s?t=3", "youtube.com/shorts/%s", "  https://m.youtube.com/watch?list=x&v=%s&t=1 ", "https://www.youtube.com/embed/%s", "https://example.com/watch?v=%s", "https://youtu.be/%sx")


def video_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links in seven forms, two of them wrong; each video is linked twice and every fifth is known already."""
    key = F.col("o_orderkey")
    orders = table(spark, sf, "orders").select(key.alias("position"), F.lpad(F.floor(key / 2).cast("string"), 11, "v").alias("id"))
    forms = F.array(*[F.format_string(f, "id") for f in _FORMS])
    links = orders.select("position", F.element_at(forms, (1 + F.col("position") % len(_FORMS)).cast("int")).alias("link"))
    known = orders.where("position % 10 < 2").select(F.col("id").alias("video_id")).distinct()
    return serve.new_links(links, known)


def moment_links(spark: SparkSession, sf: str) -> DataFrame:
    at = moment_asof(spark, sf)
    return at.select("conv_id", "turn", serve.moment_link(F.lpad(F.col("conv_id").cast("string"), 11, "v"), F.col("seconds")).alias("link"), P.seconds_label(F.col("seconds")).alias("label"))


# ---- displays ------------------------------------------------------------------------------------------
def display_forms(spark: SparkSession, sf: str) -> DataFrame:
    key, value = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        "o_orderkey", P.views_label(key * key * 37 % 3_000_000_000 * (key % 4)).alias("views"), P.star_signs(1 + key % 9 / 2).alias("stars"), P.estimated_rating(F.lit(-1.0) + key % 41 / 20).alias("estimated"),
        P.to_five(1 + key % 10, F.lit("1-10")).alias("ten"), P.to_five(key % 101, F.lit("0-100")).alias("hundred"), P.to_five(key % 11, F.lit("0-10")).alias("zero_ten"),
    )


def emotion_signs(spark: SparkSession, sf: str) -> DataFrame:
    return add_emotion(order_reviews(spark, sf)).groupBy(emotion_label(F.col("emotion")).alias("label")).agg(F.count("*").alias("reviews"))


def excerpts(spark: SparkSession, sf: str) -> DataFrame:
    return mentioned(spark, sf).select("review_id", "theme", P.excerpt(F.col("review_text"), F.col("clause"), 60).alias("focused"), P.excerpt(F.col("review_text"), limit=60).alias("plain"))


def highlights(spark: SparkSession, sf: str) -> DataFrame:
    clause = F.array(F.struct("clause", "polarity"))
    return mentioned(spark, sf).select("review_id", "theme", P.highlighted(F.concat(F.lit("<b> & "), "review_text"), clause).alias("html"))


def html_lines(spark: SparkSession, sf: str) -> DataFrame:
    made = F.concat(F.lit("**"), "product_name", F.lit("** & more\n"), "review_text")
    return order_reviews(spark, sf).select("review_id", P.md_to_html(made).alias("html"))


def assessed(spark: SparkSession, sf: str) -> DataFrame:
    reviews = enriched(spark, sf)
    return risk.assess(reviews, risk.similar_reviews(reviews))


QUERIES = {
    "ingest_csv": ingest_csv,
    "ingest_mapping": ingest_mapping,
    "ingest_latin": ingest_latin,
    "export_csv": export_csv,
    "rows_numbered": rows_numbered,
    "upload_counts": lambda spark, sf: ingest.summary(dirty_reviews(spark, sf)),
    "video_store": video_store,
    "video_fields": video_fields,
    "video_reach": video_reach,
    "video_markers": video_markers,
    "video_links": video_links,
    "moment_links": moment_links,
    "display_forms": display_forms,
    "emotion_signs": emotion_signs,
    "excerpts": excerpts,
    "highlights": highlights,
    "html_lines": html_lines,
    "product_search": lambda spark, sf: serve.search(enriched(spark, sf), product_name=("Product 3",)).select("review_id"),
    "reply_queue": lambda spark, sf: serve.reply_queue(enriched(spark, sf), "low").select("review_id", "rating"),
    "risk_queue": lambda spark, sf: risk.risk_queue(assessed(spark, sf)).select("review_id", "risk_level", "risk_score"),
    "risk_mix": lambda spark, sf: metrics.label_counts(assessed(spark, sf), "risk_level", ("Low", "Medium", "High")),
    "product_volume": lambda spark, sf: metrics.products(order_reviews(spark, sf)),
    "cardinalities": lambda spark, sf: order_reviews(spark, sf).agg(F.count_distinct("product_name").alias("products"), F.count_distinct("review_id").alias("ids"), F.count_distinct("review_text").alias("texts")),
    "theme_radar": lambda spark, sf: metrics.theme_radar(metrics.theme_table(mentioned(spark, sf), "Product 1", "Product 2")),
    "theme_lines": lambda spark, sf: trends.theme_lines(mentioned(spark, sf), "Weekly"),
    "sparkline": lambda spark, sf: trends.sparkline(enriched(spark, sf)),
    "compare_text": lambda spark, sf: spark.createDataFrame([(narrate.compare_text(enriched(spark, sf), mentioned(spark, sf), "Product 1", "Product 2"),)], "text string"),
}

_LINKED = "CASE o_orderkey % 7 " + " ".join(f"WHEN {i} THEN printf({lit(f)}, id)" for i, f in enumerate(_FORMS)) + " END"
_VIEWS = "((o_orderkey * o_orderkey * 37) % 3000000000 * (o_orderkey % 4))"


def _short(by: str, sign: str) -> str:
    return f"regexp_replace(printf('%.1f', v / {by}), '\\.0$', '') || '{sign} views'"


_VIDEO = """vi AS (
    SELECT en.*, substr(review_id, 2)::BIGINT AS k, CASE WHEN substr(review_id, 2)::BIGINT % 20 = 3 THEN 'Film ' || review_id END AS video_title, greatest(1.0, least(5.0, round_even(3 + 2 * sentiment_score, 0))) AS estimated
    FROM en WHERE substr(review_id, 2)::BIGINT % 10 = 3
)"""
_HTML = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_PLAIN = "CASE WHEN length(review_text) <= 60 THEN review_text ELSE regexp_replace(substr(review_text, 1, 60), ' [^ ]*$', '') || ' …' END"

ORACLES = {
    "ingest_csv": f"WITH {REVIEWS} SELECT review_id, product_name, rating, date_trunc('day', review_date)::TIMESTAMP AS review_date, md5(review_text) AS digest, 'upload' AS source_file FROM rv",
    "ingest_mapping": "SELECT * FROM (VALUES ('review_id', 'Review ID', 'name'), ('product_name', 'Item', 'name'), ('rating', 'Stars', 'name'), ('review_text', 'comment', 'name'), ('review_date', 'created at', 'name')) t(field, \"column\", method)",
    "ingest_latin": "SELECT doc_id, CASE WHEN t <> '' THEN md5(t) END AS digest FROM (SELECT doc_id, ltrim(replace(regexp_replace(text, '[^\\x{00}-\\x{FF}]', '?', 'g'), chr(13), ''), ' ' || chr(9)) AS t FROM documents)",
    "export_csv": f"WITH {REVIEWS} SELECT review_id, product_name, rating, product_name || '; made' AS tags, md5(review_text) AS digest FROM rv",
    "rows_numbered": "SELECT count(*) AS n, count(*) AS numbers, 0 AS low, count(*) - 1 AS high FROM orders",
    "upload_counts": f"""WITH {REVIEWS}, {DIRTY}, j AS (SELECT *, CASE WHEN trim(review_text) = '' THEN 'text' WHEN rating > 5 THEN 'rating' WHEN review_date IS NULL THEN 'date' END AS reject FROM di)
        SELECT count(*) AS rows_in, count(*) FILTER (reject IS NULL) AS reviews, count(DISTINCT CASE WHEN product_name = '' THEN 'Unknown product' ELSE product_name END) FILTER (reject IS NULL) AS products,
               count(*) FILTER (reject = 'text') AS without_text, count(*) FILTER (reject = 'rating') AS without_rating, count(*) FILTER (reject = 'date') AS without_date FROM j""",
    "video_store": f"WITH {REVIEWS}, {_VIDEO} SELECT review_id, estimated AS rating, k * 997 AS views, video_title, 4.5 AS second FROM vi",
    "video_fields": f"WITH {REVIEWS}, {_VIDEO} SELECT count(*) AS videos, {len(VIDEO_SCHEMA.rsplit(', timestamps', 1)[0].split(', '))} AS fields, false AS stamps FROM vi",
    "video_reach": f"WITH {REVIEWS}, {_VIDEO} SELECT sum(k * 997)::BIGINT AS views, coalesce(sum(k * 997) FILTER (sentiment = 'Negative'), 0)::BIGINT AS negative_views FROM vi",
    "video_markers": f"WITH {REVIEWS}, {_VIDEO} SELECT review_date AS date, estimated AS value, coalesce(video_title, review_id) AS label FROM vi",
    "video_links": f"""WITH o AS (SELECT o_orderkey, lpad((o_orderkey // 2)::VARCHAR, 11, 'v') AS id FROM orders), l AS (SELECT o_orderkey, id, trim({_LINKED}) AS link FROM o WHERE o_orderkey % 7 < 5)
        SELECT id AS key, arg_min(link, o_orderkey) AS link FROM l WHERE id NOT IN (SELECT id FROM o WHERE o_orderkey % 10 < 2) GROUP BY id""",
    "moment_links": f"""SELECT conv_id, turn, 'https://www.youtube.com/watch?v=' || lpad(conv_id::VARCHAR, 11, 'v') || '&t=' || s || 's' AS link, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') ELSE (s // 60)::VARCHAR END || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS label
        FROM (SELECT *, floor(seconds)::BIGINT AS s FROM ({MOMENTS}))""",
    "display_forms": f"""SELECT o_orderkey, CASE WHEN v = 0 THEN '' WHEN v >= 1000000000 THEN {_short('1e9', 'B')} WHEN v >= 1000000 THEN {_short('1e6', 'M')} WHEN v >= 1000 THEN {_short('1e3', 'K')} ELSE v || ' views' END AS views,
            repeat('★', round_even(1 + o_orderkey % 9 / 2, 0)::INT) || repeat('☆', 5 - round_even(1 + o_orderkey % 9 / 2, 0)::INT) AS stars, greatest(1.0, least(5.0, round_even(3 + 2 * (-1.0::DOUBLE + o_orderkey % 41 / 20), 0))) AS estimated,
            {rnd('1 + (1 + o_orderkey % 10 - 1) * 4 / 9', 1)} AS ten, {rnd('1 + (o_orderkey % 101) * 4 / 100', 1)} AS hundred, {rnd('1 + (o_orderkey % 11) * 4 / 10', 1)} AS zero_ten FROM (SELECT *, {_VIEWS} AS v FROM orders)""",
    "emotion_signs": f"WITH {REVIEWS}, {FEELING} SELECT CASE emotion {' '.join(f'WHEN {lit(k)} THEN {lit(s + chr(32) + k)}' for k, s in L.EMOTION_SIGNS.items())} ELSE emotion END AS label, count(*) AS reviews FROM fe GROUP BY 1",
    "excerpts": f"""WITH {MENTIONS}, p AS (SELECT *, instr(review_text, clause) - 1 AS place, greatest(0, instr(review_text, clause) - 21) AS begin FROM me)
        SELECT review_id, theme, CASE WHEN length(review_text) <= 60 THEN review_text WHEN place >= 0 THEN CASE WHEN begin > 0 THEN '… ' ELSE '' END || substr(review_text, begin + 1, 60) || CASE WHEN begin + 60 < length(review_text) THEN ' …' ELSE '' END ELSE {_PLAIN} END AS focused, {_PLAIN} AS plain FROM p""",
    "highlights": f"""WITH {MENTIONS}, p AS (SELECT review_id, theme, polarity, {_HTML.format("'<b> & ' || review_text")} AS h, {_HTML.format('clause')} AS c FROM me)
        SELECT review_id, theme, CASE WHEN polarity <> 'neutral' AND instr(h, c) > 0 THEN substr(h, 1, instr(h, c) - 1) || '<mark class=\"' || polarity || '\">' || c || '</mark>' || substr(h, instr(h, c) + length(c)) ELSE h END AS html FROM p""",
    "html_lines": f"WITH {REVIEWS} SELECT review_id, '<strong>' || product_name || '</strong> &amp; more<br>' || {_HTML.format('review_text')} AS html FROM rv",
    "product_search": f"WITH {REVIEWS} SELECT review_id FROM rv WHERE product_name = 'Product 3'",
    "reply_queue": f"WITH {REVIEWS} SELECT review_id, rating FROM rv WHERE rating <= 3",
    "risk_queue": f"WITH {REVIEWS}, {SIMILAR}, {BURST}, {SIGNALS} SELECT review_id, CASE WHEN risk_score >= 55 THEN 'High' ELSE 'Medium' END AS risk_level, risk_score FROM sp WHERE risk_score >= 30",
    "risk_mix": f"WITH {REVIEWS}, {SIMILAR}, {BURST}, {SIGNALS} SELECT risk_level, position, count(review_id) AS reviews FROM (VALUES ('Low', 0, 0, 29), ('Medium', 1, 30, 54), ('High', 2, 55, 100)) l(risk_level, position, lo, hi) LEFT JOIN sp ON risk_score BETWEEN lo AND hi GROUP BY ALL",
    "product_volume": f"WITH {REVIEWS} SELECT product_name, count(*) AS reviews FROM rv GROUP BY 1",
    "cardinalities": f"WITH {REVIEWS} SELECT count(DISTINCT product_name) AS products, count(DISTINCT review_id) AS ids, count(DISTINCT review_text) AS texts FROM rv",
    "theme_radar": f"WITH {MENTIONS}, {SATISFACTION} SELECT theme, coalesce(satisfaction_a, 0) AS a, coalesce(satisfaction_b, 0) AS b FROM st WHERE satisfaction_a IS NOT NULL OR satisfaction_b IS NOT NULL ORDER BY praise_a + complaints_a + praise_b + complaints_b DESC, theme LIMIT 8",
    "theme_lines": f"""WITH {MENTIONS}, t AS (SELECT date_trunc('MONTH', review_date)::TIMESTAMP AS period, theme, count(DISTINCT review_id) AS reviews FROM me WHERE polarity = 'complaint' GROUP BY ALL)
        SELECT * FROM t WHERE theme IN (SELECT theme FROM t GROUP BY theme ORDER BY sum(reviews) DESC, theme LIMIT 5)""",
    "sparkline": f"""WITH {REVIEWS}, p AS ({trend_sql('en', 'MONTH', cte=True)}) SELECT period, reviews, avg_rating, {rnd('positive / reviews * 100', 1)} AS positive_pct, negative_pct FROM p WHERE reviews > 0""",
    "compare_text": f"""WITH {MENTIONS}, {SATISFACTION}, m AS (SELECT product_name, count(*) AS n, avg(rating) AS a, count(*) FILTER (sentiment = 'Positive') AS p, count(*) FILTER (sentiment = 'Negative') AS g FROM en WHERE product_name IN ('Product 1', 'Product 2') GROUP BY 1),
        li AS (SELECT 0 AS part, row_number() OVER (ORDER BY product_name) AS turn, product_name || ': ' || n || ' reviews, ' || {rnd('a', 2)} || ' stars of 5 on average, ' || {rnd('p / n * 100', 1)} || ' % positive, ' || {rnd('g / n * 100', 1)} || ' % negative, health ' ||
                      round_even(100 * (0.5 * (a - 1) / 4 + 0.5 * ((p - g) / n + 1) / 2), 0)::INT || ' of 100' AS line FROM m
               UNION ALL SELECT 1, 0, 'By theme, praise / complaints / satisfaction of 100:'
               UNION ALL SELECT 2, row_number() OVER (ORDER BY praise_a + complaints_a + praise_b + complaints_b DESC, theme), '- ' || theme || ': Product 1 ' || praise_a || '/' || complaints_a || '/' || coalesce(satisfaction_a::INT::VARCHAR, 'none')
                      || ', Product 2 ' || praise_b || '/' || complaints_b || '/' || coalesce(satisfaction_b::INT::VARCHAR, 'none') FROM st)
        SELECT string_agg(line, chr(10) ORDER BY part, turn) AS text FROM li""",
}

"""Queries over raw columns, files and conversations, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.functions import lexicon as L
from opinara.functions import parsing as P
from opinara.operators import ingest, serve
from opinara.plans.feedback import enriched, mentioned
from opinara.plans.oracle import MENTIONS, REVIEWS, lit, rnd, tfidf
from opinara.sources.reviews import order_reviews, table

_RATINGS = ("%s", "%s stars", "%s/5", "%s out of 10", "★★★", "4,%s", "none")


def raw_ratings(spark: SparkSession, sf: str) -> DataFrame:
    digit = F.substring("o_orderpriority", 1, 1)
    forms = F.array(*[F.format_string(f, digit) if "%s" in f else F.lit(f) for f in _RATINGS])
    return table(spark, sf, "orders").select("o_orderkey", F.element_at(forms, (1 + F.col("o_orderkey") % len(_RATINGS)).cast("int")).alias("raw"))


def raw_dates(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("o_orderdate")
    forms = F.array(F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "M/d/yyyy"), F.date_format(d, "MMM d, yyyy"), F.date_format(d, "d MMM yyyy"), (F.unix_timestamp(d) + 400_000_000).cast("string"), F.lit("soon"))
    return table(spark, sf, "orders").select("o_orderkey", F.element_at(forms, (1 + F.col("o_orderkey") % 6).cast("int")).alias("raw"))


def dirty_reviews(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("_k")
    rows = order_reviews(spark, sf).withColumn("_k", F.substring("review_id", 2, 20).cast("long")).withColumn("_row", key)
    return rows.withColumns({
        "review_text": F.when(key % 11 == 0, "  ").otherwise(F.col("review_text")), "rating": F.when(key % 7 == 0, 9.0).otherwise(F.col("rating")),
        "review_date": F.when(key % 13 == 0, None).otherwise(F.col("review_date")), "review_id": F.when(key % 5 == 0, "").otherwise(F.col("review_id")), "product_name": F.when(key % 17 == 0, "").otherwise(F.col("product_name")),
    }).drop("_k")


DIRTY = """di AS (
    SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN '  ' ELSE review_text END AS review_text, CASE WHEN o_orderkey % 7 = 0 THEN 9.0 ELSE rating END AS rating,
           CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE review_date END AS review_date, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE review_id END AS review_id, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE product_name END AS product_name
    FROM rv JOIN orders ON 'O' || o_orderkey = review_id
)"""


def document_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Documents filed under clashing ids: the id is the doc id in halves."""
    return table(spark, sf, "documents").select(F.concat(F.lit("D"), F.floor(F.col("doc_id") / 2).cast("string")).alias("review_id"), F.col("source").alias("product_name"), "text", F.col("doc_id").alias("_seq"))


def conflict_rename(spark: SparkSession, sf: str) -> DataFrame:
    fields = ("review_id", "product_name", "text")
    return ingest.rename_conflicts(document_reviews(spark, sf), "_seq", on=fields).select("_seq", "review_id")


def exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.mark_copies(table(spark, sf, "documents").select("doc_id", "lang", "text"), ["doc_id"], on=("lang", "text")).where("copy = 0").select("doc_id")


def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    raw = order_reviews(spark, sf).select("review_id", "product_name", F.col("rating").cast("int").cast("string").alias("rating"), "review_text")
    return ingest.profile(raw).select("column", "filled", "distinct", *[(F.floor(F.col(c) * 10_000 + 0.5) / 10_000).alias(c) for c in ("rating_shape", "length", "words", "spaced")])


def turn_places(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").where("text IS NOT NULL")
    return serve.caption_offsets(rows, "conv_id", "turn", "text").select("conv_id", "turn", "place")


def moment_asof(spark: SparkSession, sf: str) -> DataFrame:
    """For every turn: the start, in seconds, of the last turn of its conversation that begins at or before it."""
    placed = serve.caption_offsets(table(spark, sf, "conversations").where("text IS NOT NULL"), "conv_id", "turn", "text")
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("place").alias("offset"), (F.col("turn") * 7.5).alias("seconds"), F.col("snippet")))).alias("s"))
    whole = whole.select("conv_id", F.array_join(F.transform("s", lambda x: x["snippet"]), " ").alias("t"), F.transform("s", lambda x: F.struct(x["offset"].alias("offset"), x["seconds"].alias("seconds"))).alias("stamps"))
    return placed.join(whole, "conv_id").select("conv_id", "turn", serve.moment_seconds(F.col("t"), F.col("snippet"), F.col("stamps")).alias("seconds"))


def json_props(spark: SparkSession, sf: str) -> DataFrame:
    keys = F.json_object_keys("props")
    return table(spark, sf, "events").select("event_id", F.array_join(F.array_sort(keys), ",").alias("keys"), F.size(keys).cast("long").alias("n"))


def page_scrape(spark: SparkSession, sf: str) -> DataFrame:
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    return table(spark, sf, "pages").select("page_id", host.alias("host"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<p[ >]")).cast("long").alias("paragraphs"))


_QUESTION = "How is the battery and charging?"


def faceted_search(spark: SparkSession, sf: str) -> DataFrame:
    return serve.search(enriched(spark, sf), "BATTERY", (1, 3), "1996-01-01", "1999-12-31", sentiment=("Negative",)).select("review_id", "rating", "review_date")


def theme_filter(spark: SparkSession, sf: str) -> DataFrame:
    reviews = enriched(spark, sf)
    return serve.with_theme(reviews, mentioned(spark, sf), ["Connectivity"], "complaint").select("review_id")


def page_n(spark: SparkSession, sf: str) -> DataFrame:
    return serve.page(enriched(spark, sf).select("review_id", "rating", "review_date"), 3, 12, F.desc("review_date"), "review_id")


def answers(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("answer_id"))
    k = F.col("answer_id").cast("string")
    return rows.withColumn("answer", F.concat(F.lit("As [O"), k, F.lit(", X"), k, F.lit("] and [see note] say, [O"), k, F.lit("].")))


QUERIES = {
    "rating_parse": lambda spark, sf: raw_ratings(spark, sf).select("o_orderkey", P.rating(F.col("raw")).alias("rating")),
    "rating_scale": lambda spark, sf: raw_ratings(spark, sf).groupBy((F.col("o_orderkey") % 7).alias("form")).agg(P.scale(F.min(P.rating(F.col("raw"))), F.max(P.rating(F.col("raw")))).alias("scale")),
    "date_parse": lambda spark, sf: raw_dates(spark, sf).select("o_orderkey", P.timestamp(F.col("raw")).alias("parsed")),
    "column_profile": column_profile,
    "clean_rejects": lambda spark, sf: ingest.judged(dirty_reviews(spark, sf)).groupBy(F.coalesce("reject", F.lit("none")).alias("reject")).agg(F.count("*").alias("rows")),
    "clean_reviews": lambda spark, sf: ingest.validate(dirty_reviews(spark, sf)).select("review_id", "product_name", "rating"),
    "exact_dedup": exact_dedup,
    "dup_id_count": lambda spark, sf: document_reviews(spark, sf).groupBy("review_id").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("ids")),
    "conflict_rename": conflict_rename,
    "union_sources": lambda spark, sf: ingest.union_all([order_reviews(spark, sf), order_reviews(spark, sf).withColumn("source", F.lit("video"))]).groupBy(F.coalesce("source", F.lit("text")).alias("source")).agg(F.count("*").alias("rows")),
    "video_keys": lambda spark, sf: order_reviews(spark, sf).select("review_id", P.short_key(F.col("review_id")).alias("key"), P.youtube_id(F.concat(F.lit("https://www.youtube.com/watch?v="), F.lpad("review_id", 11, "a"))).alias("video"), P.seconds_label(F.substring("review_id", 2, 9).cast("double")).alias("at")),
    "caption_offsets": turn_places,
    "moment_asof": moment_asof,
    "json_props": json_props,
    "page_scrape": page_scrape,
    "faceted_search": faceted_search,
    "theme_filter": theme_filter,
    "page_n": page_n,
    "question_boost": lambda spark, sf: serve.relevance(enriched(spark, sf), _QUESTION, mentioned(spark, sf)).select("review_id", "relevance"),
    "retrieve_topk": lambda spark, sf: serve.retrieve(enriched(spark, sf), _QUESTION, mentioned(spark, sf)).select("review_id", "relevance"),
    "retrieve_general": lambda spark, sf: serve.retrieve(enriched(spark, sf), "What is it all about?", mentioned(spark, sf)).select("review_id", "relevance"),
    "review_lines": lambda spark, sf: order_reviews(spark, sf).select("review_id", serve.review_line().alias("line")),
    "chunk_lines": lambda spark, sf: serve.prompt_chunks(order_reviews(spark, sf), newest=serve.NEWEST),  # the operator's own bound on what goes into prompts
    "citation_check": lambda spark, sf: serve.check_citations(answers(spark, sf), order_reviews(spark, sf)),
    "template_reply": lambda spark, sf: serve.replies(enriched(spark, sf), mentioned(spark, sf)),
}

_ASKED = f"""qd AS (SELECT review_text AS id, lower(review_text) AS text, count(*) AS n FROM rv GROUP BY ALL UNION ALL SELECT NULL, lower({lit(_QUESTION)}), 1),
qe AS (SELECT coalesce(id, '?') AS id, text, n FROM qd),
{tfidf('qv', 'qe', '[\\p{L}\\p{N}_]{2,}', 'SELECT count(*) + 1 FROM rv', sublinear=True, stop=True)},
qc AS (SELECT a.id AS review_text, sum(a.w * b.w) AS cosine FROM qv a JOIN qv b ON b.id = '?' AND a.term = b.term WHERE a.id <> '?' GROUP BY 1),
rk AS (SELECT review_id, floor((coalesce(cosine, 0) + CASE WHEN review_id IN (SELECT review_id FROM me WHERE theme IN ({', '.join(lit(t) for t in serve.question_themes(_QUESTION))})) THEN 0.5 ELSE 0 END) * 10000 + 0.5) / 10000 AS relevance
       FROM rv LEFT JOIN qc USING (review_text))"""
MOMENTS = """WITH c AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '\\[[^\\]]*\\]', ' ', 'g'), '\\s+', ' ', 'g')) AS s FROM conversations WHERE text IS NOT NULL),
        p AS (SELECT conv_id, turn, s, coalesce(sum(length(s) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM c WHERE s <> ''),
        t AS (SELECT conv_id, string_agg(s, ' ' ORDER BY place) AS whole FROM p GROUP BY 1)
        SELECT p.conv_id, p.turn, arg_max(o.turn * 7.5, o.place) AS seconds FROM p JOIN t USING (conv_id) JOIN p o ON o.conv_id = p.conv_id AND o.place <= instr(whole, p.s) - 1 GROUP BY ALL"""
_FORMS = ["d", "d || ' stars'", "d || '/5'", "d || ' out of 10'", "'★★★'", "'4,' || d", "'none'"]
_RAW = f"ra AS (SELECT o_orderkey, CASE o_orderkey % 7 {' '.join(f'WHEN {i} THEN {f}' for i, f in enumerate(_FORMS))} END AS raw FROM (SELECT o_orderkey, substr(o_orderpriority, 1, 1) AS d FROM orders))"
_PARSED = f"""pr AS (
    SELECT o_orderkey, CASE WHEN raw = '★★★' THEN 3.0 WHEN raw LIKE '%/5' THEN {rnd('substr(raw, 1, 1)::DOUBLE / 5 * 5', 2)} WHEN raw LIKE '%out of 10' THEN {rnd('substr(raw, 1, 1)::DOUBLE / 10 * 5', 2)}
                            WHEN raw = 'none' THEN NULL ELSE replace(split_part(raw, ' ', 1), ',', '.')::DOUBLE END AS rating FROM ra
)"""
_HI = "CASE WHEN hi <= 5 AND lo = 0 THEN '0-5' WHEN hi <= 5 THEN '1-5' WHEN hi <= 10 AND lo < 1 THEN '0-10' WHEN hi <= 10 THEN '1-10' WHEN hi <= 100 THEN '0-100' ELSE 'unknown' END"
_FRIENDLY = L.REPLY_PARTS["Friendly"]
_SAY = "CASE x " + " ".join(f"WHEN {lit(t)} THEN {lit(p)}" for t, p in L.REPLY_THEMES.items()) + " END"


def _and(items: str) -> str:
    return f"CASE WHEN len({items}) <= 1 THEN {items}[1] ELSE {items}[1] || ' and ' || {items}[2] END"


def _filled(template: str, value: str) -> str:
    before, _, after = template.partition("%s")
    return f"{lit(before)} || ({value}) || {lit(after)}"


ORACLES = {
    "rating_parse": f"WITH {_RAW}, {_PARSED} SELECT * FROM pr",
    "rating_scale": f"WITH {_RAW}, {_PARSED}, g AS (SELECT o_orderkey % 7 AS form, min(rating) AS lo, max(rating) AS hi FROM pr GROUP BY 1) SELECT form, {_HI} AS scale FROM g",
    "date_parse": "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 5 THEN NULL WHEN 4 THEN CASE WHEN epoch(o_orderdate) + 400000000 >= 1000000000 THEN to_timestamp(epoch(o_orderdate) + 400000000) AT TIME ZONE 'UTC' END ELSE date_trunc('day', o_orderdate)::TIMESTAMP END AS parsed FROM orders",
    "column_profile": f"""WITH {REVIEWS}, c AS (SELECT unnest([{{'c': 'review_id', 'v': review_id}}, {{'c': 'product_name', 'v': product_name}}, {{'c': 'rating', 'v': rating::INT::VARCHAR}}, {{'c': 'review_text', 'v': review_text}}]) AS x FROM rv)
        SELECT x.c AS column, count(*) AS filled, count(DISTINCT x.v) AS distinct, floor(avg(CASE WHEN regexp_matches(x.v, '^[0-9]+$') THEN 1.0 ELSE 0 END) * 10000 + 0.5) / 10000 AS rating_shape,
               floor(avg(length(x.v)) * 10000 + 0.5) / 10000 AS length, floor(avg(len(string_split_regex(x.v, '\\s+'))) * 10000 + 0.5) / 10000 AS words, floor(avg(CASE WHEN regexp_matches(x.v, '\\s') THEN 1.0 ELSE 0 END) * 10000 + 0.5) / 10000 AS spaced
        FROM c GROUP BY 1""",
    "clean_rejects": f"WITH {REVIEWS}, {DIRTY} SELECT CASE WHEN trim(review_text) = '' THEN 'text' WHEN rating > 5 THEN 'rating' WHEN review_date IS NULL THEN 'date' ELSE 'none' END AS reject, count(*) AS rows FROM di GROUP BY 1",
    "clean_reviews": f"WITH {REVIEWS}, {DIRTY} SELECT CASE WHEN review_id = '' THEN 'AUTO-' || (k + 1) ELSE review_id END AS review_id, CASE WHEN product_name = '' THEN 'Unknown product' ELSE product_name END AS product_name, rating FROM di WHERE trim(review_text) <> '' AND rating <= 5 AND review_date IS NOT NULL",
    "exact_dedup": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY lang, text",
    "dup_id_count": "SELECT count(*) AS ids FROM (SELECT doc_id // 2 AS k FROM documents GROUP BY 1 HAVING count(*) > 1)",
    "conflict_rename": """WITH d AS (SELECT doc_id, 'D' || (doc_id // 2) AS id, source, text FROM documents), f AS (SELECT *, min(doc_id) OVER (PARTITION BY id, source, text) AS first FROM d),
        v AS (SELECT *, dense_rank() OVER (PARTITION BY id ORDER BY first) AS v FROM f) SELECT doc_id AS _seq, CASE WHEN v > 1 THEN id || '~' || v ELSE id END AS review_id FROM v""",
    "union_sources": "SELECT unnest(['text', 'video']) AS source, (SELECT count(*) FROM orders) AS rows",
    "video_keys": "SELECT 'O' || o_orderkey AS review_id, upper(substr(sha1('O' || o_orderkey), 1, 8)) AS key, right('aaaaaaaaaaa' || 'O' || o_orderkey, 11) AS video, CASE WHEN o_orderkey >= 3600 THEN (o_orderkey // 3600) || ':' || lpad((o_orderkey // 60 % 60)::VARCHAR, 2, '0') ELSE (o_orderkey // 60)::VARCHAR END || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') AS at FROM orders",
    "caption_offsets": """WITH c AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '\\[[^\\]]*\\]', ' ', 'g'), '\\s+', ' ', 'g')) AS s FROM conversations WHERE text IS NOT NULL)
        SELECT conv_id, turn, coalesce(sum(length(s) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM c WHERE s <> ''""",
    "moment_asof": MOMENTS,
    "json_props": "SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS keys, len(json_keys(props)) AS n FROM events",
    "page_scrape": "SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs FROM pages",
    "faceted_search": f"WITH {REVIEWS} SELECT review_id, rating, review_date FROM en WHERE contains(lower(review_text), 'battery') AND rating BETWEEN 1 AND 3 AND review_date >= '1996-01-01' AND review_date < '2000-01-01' AND sentiment = 'Negative'",
    "theme_filter": f"WITH {MENTIONS} SELECT review_id FROM rv WHERE review_id IN (SELECT review_id FROM me WHERE theme = 'Connectivity' AND polarity = 'complaint')",
    "page_n": f"WITH {REVIEWS} SELECT review_id, rating, review_date FROM rv ORDER BY review_date DESC, review_id LIMIT 12 OFFSET 24",
    "review_lines": f"""WITH {REVIEWS} SELECT review_id, '[' || review_id || '] ' || rating::INT || ' stars, ' || strftime(review_date, '%Y-%m-%d') || ', ' || product_name || ': ' || CASE WHEN length(review_text) > {serve.LINE} THEN substr(review_text, 1, {serve.LINE}) || '...' ELSE review_text END AS line FROM rv""",
    "question_boost": f"WITH {MENTIONS}, {_ASKED} SELECT review_id, relevance FROM rk",
    "retrieve_topk": f"WITH {MENTIONS}, {_ASKED} SELECT review_id, relevance FROM rk WHERE relevance > 0.05 ORDER BY relevance DESC, review_id LIMIT 60",
    "retrieve_general": f"""WITH {REVIEWS}, f AS (
            SELECT * FROM (SELECT review_id, 1 AS turn, row_number() OVER (ORDER BY sentiment_score, review_id) AS k FROM en UNION ALL SELECT review_id, 2, row_number() OVER (ORDER BY sentiment_score DESC, review_id) FROM en
                           UNION ALL SELECT review_id, 3, row_number() OVER (ORDER BY review_date DESC, review_id) FROM en) WHERE k <= 20)
        SELECT DISTINCT review_id, 0.0 AS relevance FROM f""",
    "chunk_lines": f"""WITH RECURSIVE {REVIEWS}, nw AS (SELECT * FROM rv ORDER BY review_date DESC, review_id LIMIT {serve.NEWEST}),
        l AS (SELECT row_number() OVER w AS i, line, sum(length(line) + 1) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
              FROM (SELECT *, '[' || review_id || '] ' || rating::INT || ' stars, ' || strftime(review_date, '%Y-%m-%d') || ', ' || product_name || ': ' || review_text AS line FROM nw) WINDOW w AS (ORDER BY review_date, review_id)),
        c AS (SELECT 0 AS chunk, 1 AS start, 0 AS base UNION ALL
              SELECT chunk + 1, (SELECT min(i) FROM l WHERE i > start AND upto - 1 - base > {serve.CHUNK}), (SELECT max(upto) FROM l WHERE i < (SELECT min(i) FROM l WHERE i > start AND upto - 1 - base > {serve.CHUNK})) FROM c
              WHERE EXISTS (SELECT 1 FROM l WHERE i > start AND upto - 1 - base > {serve.CHUNK}))
        SELECT chunk::BIGINT AS chunk, string_agg(line, chr(10) ORDER BY i) AS text FROM l ASOF JOIN c ON l.i >= c.start GROUP BY chunk""",
    "citation_check": "SELECT o_orderkey AS answer_id, unnest(['O' || o_orderkey, 'X' || o_orderkey]) AS cited_id, unnest([true, false]) AS known FROM orders",
    "template_reply": f"""WITH {MENTIONS}, s AS (
            SELECT review_id, product_name, coalesce(list(DISTINCT theme ORDER BY theme) FILTER (polarity = 'complaint'), [])[1:2] AS c, coalesce(list(DISTINCT theme ORDER BY theme) FILTER (polarity = 'praise'), [])[1:2] AS p
            FROM rv LEFT JOIN (SELECT review_id, theme, polarity FROM me) USING (review_id) GROUP BY ALL),
        q AS (SELECT review_id, product_name, list_transform(c, lambda x: {_SAY}) AS c, list_transform(p, lambda x: lower(split_part(x, ' & ', 1))) AS p FROM s)
        SELECT review_id, {_filled(_FRIENDLY[0], 'product_name')} || CASE WHEN len(p) > 0 THEN ' ' || {_filled(_FRIENDLY[1], _and('p'))} ELSE '' END
               || CASE WHEN len(c) > 0 THEN ' ' || {_filled(_FRIENDLY[2], _and('c'))} || ' ' || {lit(_FRIENDLY[3])} ELSE ' ' || {lit(_FRIENDLY[4])} END || chr(10) || chr(10) || 'The ' || product_name || ' team' AS reply FROM q""",
}

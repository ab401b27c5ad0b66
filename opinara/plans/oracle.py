"""SQL twins: shared table expressions for DuckDB, written from the same lists."""

from __future__ import annotations

import re

from opinara.functions import lexicon as L
from opinara.sources.reviews import BAD_DAYS, CLOSERS, MIDDLES, OPENERS


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(lit(i) for i in items) + "]"


_EDGE = "[^\\p{L}\\p{N}_\\x{0900}-\\x{097F}]"


def any_word(words, literal: bool = True) -> str:
    """A pattern that finds any of ``words`` as whole words in a text padded with spaces."""
    parts = sorted((re.escape(w).replace("\\ ", " ") if literal else w for w in words), key=len, reverse=True)
    return f"(?i){_EDGE}({'|'.join(parts)}){_EDGE}"


def score_of(total: str) -> str:
    return f"floor({total} / sqrt({total} * {total} + 15) * 10000 + 0.5) / 10000"


def label_of(score: str) -> str:
    return f"CASE WHEN {score} >= 0.05 THEN 'Positive' WHEN {score} <= -0.05 THEN 'Negative' ELSE 'Neutral' END"


def rnd(value: str, places: int) -> str:
    return f"(round_even(({value}) * {10**places}, 0) / {10**places})"


_VALENCE = ", ".join(f"({lit(w)}, {v})" for w, v in L.VALENCE.items())
_TOPICS = ", ".join(
    f"({lit(t)}, {lit(any_word(s['keywords'] + s['complaint']))}, {lit(any_word(s['complaint']))}, {lit(any_word(s['exclude']) if 'exclude' in s else '$^')})" for t, s in L.THEMES.items()
)

_BAD = f"(o_orderdate::TIMESTAMP >= TIMESTAMP '{BAD_DAYS}' AND o_orderkey % 3 <> 0)"
REVIEWS = f"""
rv AS (
    SELECT 'O' || o_orderkey AS review_id, 'Product ' || (o_custkey % 12) AS product_name,
           CASE WHEN {_BAD} THEN 1.0 ELSE CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) END AS rating, o_orderdate::TIMESTAMP AS review_date,
           concat_ws(' ', {_list(OPENERS)}[1 + CASE WHEN {_BAD} THEN 0 ELSE o_orderkey END % {len(OPENERS)}], {_list(MIDDLES)}[1 + (o_orderkey // {len(OPENERS)}) % {len(MIDDLES)}], {_list(CLOSERS)}[1 + o_custkey % {len(CLOSERS)}],
                     CASE WHEN o_orderkey % 50 = 7 THEN 'Order ' || o_orderkey || '.' END) AS review_text
    FROM orders
), valence(word, v) AS (VALUES {_VALENCE}),
texts AS (SELECT DISTINCT review_text FROM rv),
text_words AS (SELECT review_text, unnest(regexp_extract_all(lower(review_text), '[a-z\\x{{0900}}-\\x{{097F}}]+')) AS word FROM texts),
text_sums AS (SELECT review_text, sum(v) AS s FROM text_words JOIN valence USING (word) GROUP BY 1),
text_scores AS (SELECT review_text, {score_of('coalesce(s, 0.0)')} AS sentiment_score FROM texts LEFT JOIN text_sums USING (review_text)),
en AS (SELECT rv.*, sentiment_score, {label_of('sentiment_score')} AS sentiment FROM rv JOIN text_scores USING (review_text))
"""
MENTIONS = f"""{REVIEWS},
parts AS (SELECT review_text, string_split_regex(review_text, {lit(L.CLAUSE_SPLIT)}) AS p FROM texts),
cl AS (
    SELECT review_text, pos, trim(p[pos], ' ,-') AS clause FROM parts, unnest(range(1, len(p) + 1)) AS u(pos) WHERE trim(p[pos], ' ,-') <> ''
),
one AS (SELECT DISTINCT clause FROM cl),
one_words AS (SELECT clause, unnest(regexp_extract_all(lower(clause), '[a-z\\x{{0900}}-\\x{{097F}}]+')) AS word FROM one),
one_sums AS (SELECT clause, sum(v) AS s FROM one_words JOIN valence USING (word) GROUP BY 1),
cs AS (SELECT one.clause, {score_of('coalesce(s, 0.0)')} AS clause_score FROM one LEFT JOIN one_sums USING (clause)),
topics(theme, topic, complaint, exclude) AS (VALUES {_TOPICS}),
tm AS (
    SELECT clause, clause_score, theme, regexp_matches(' ' || clause || ' ', complaint) AS told FROM cs, topics
    WHERE regexp_matches(regexp_replace(' ' || clause || ' ', exclude, '  ', 'g'), topic)
),
mp AS (
    SELECT en.*, theme, pos, clause, clause_score,
           CASE WHEN told THEN 'complaint' WHEN clause_score <= -0.05 THEN 'complaint' WHEN clause_score >= 0.05 THEN 'praise'
                WHEN rating <= 2 THEN 'complaint' WHEN rating >= 4 THEN 'praise' ELSE 'neutral' END AS polarity
    FROM en JOIN cl USING (review_text) JOIN tm USING (clause)
),
me AS (
    SELECT * FROM mp QUALIFY row_number() OVER (PARTITION BY review_id, theme ORDER BY (polarity = 'complaint') DESC, pos) = 1
)
"""
WORD = "[\\p{L}\\p{N}_\\x{0900}-\\x{097F}]+"


def tfidf(name: str, texts: str, pattern: str, total: str, sublinear: bool = False, stop: bool = False) -> str:
    """Unit vectors ``{name}`` (id, term, w) of ``texts`` (id, text, n)."""
    words = f"regexp_extract_all(text, {lit(pattern)})"
    if stop:
        words = f"list_filter({words}, lambda x: NOT list_contains({_list(L.STOP_WORDS)}, x))"
    return f"""{name}_w AS (SELECT id, n, {words} AS w FROM {texts}),
{name}_x AS (SELECT id, n, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM {name}_w),
{name}_f AS (SELECT id, n, term, count(*) AS tf FROM {name}_x GROUP BY ALL),
{name}_d AS (SELECT term, sum(n) AS df FROM {name}_f GROUP BY 1),
{name}_v AS (SELECT id, term, {'(1 + ln(tf))' if sublinear else 'tf'} * (ln((1 + total) / (1 + df)) + 1) AS w FROM {name}_f JOIN {name}_d USING (term), ({total}) AS tt(total)),
{name}_m AS (SELECT id, sqrt(sum(w * w)) AS norm FROM {name}_v GROUP BY 1),
{name} AS (SELECT id, term, w / norm AS w FROM {name}_v JOIN {name}_m USING (id))"""


def alike(vectors: str, least: float) -> str:
    """Pairs (id, partner, similarity) of vectors, both ways."""
    return f"SELECT a.id, b.id AS partner, floor(sum(a.w * b.w) * 1000000 + 0.5) / 1000000 AS similarity FROM {vectors} a JOIN {vectors} b ON a.term = b.term AND a.id <> b.id GROUP BY ALL HAVING similarity >= {least}"


SIMILAR = f"""
sim_t AS (SELECT review_id, trim(regexp_replace(regexp_replace(lower(review_text), '[^\\p{{L}}\\p{{N}}_\\s\\x{{0900}}-\\x{{097F}}]', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM rv),
sim_g AS (SELECT text, min(review_id) AS id, count(*) AS n FROM sim_t GROUP BY 1),
{tfidf('sim_n', 'sim_g', WORD, 'SELECT count(*) FROM rv')},
sim_p AS ({alike('sim_n', 0.75)}),
sim_b AS (SELECT id, partner, similarity FROM sim_p QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, partner) = 1),
sim_s AS (SELECT id, min(review_id) AS second FROM sim_t JOIN sim_g USING (text) WHERE review_id <> id GROUP BY 1),
sim_r AS (
    SELECT review_id, CASE WHEN n = 1 THEN partner WHEN review_id = id THEN second ELSE id END AS similar_to, CASE WHEN n = 1 THEN similarity ELSE 1.0 END AS max_similarity
    FROM sim_t JOIN sim_g USING (text) LEFT JOIN sim_b USING (id) LEFT JOIN sim_s USING (id) WHERE n > 1 OR partner IS NOT NULL
),
sim AS (
    SELECT r.review_id, similar_to, max_similarity FROM sim_r r JOIN rv a ON a.review_id = r.review_id JOIN rv b ON b.review_id = similar_to
    WHERE least(length(a.review_text), length(b.review_text)) / greatest(length(a.review_text), length(b.review_text)) >= 0.6
)"""

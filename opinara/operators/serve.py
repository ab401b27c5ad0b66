"""Search, retrieval, paging, replies, transcripts and the data side of prompts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.functions import lexicon as L
from opinara.operators.similarity import weighted

LINE, LONG_LINE, CHUNK, NEWEST = 1000, 8000, 40_000, 1500


def search(reviews: DataFrame, needle: str = "", rating: tuple[float, float] | None = None, start: str | None = None, end: str | None = None, **any_of: Sequence[str]) -> DataFrame:
    """Conjunction of facets: a literal substring of text, product or id; ranges; and columns' allowed values."""
    if needle:
        low = needle.lower()
        reviews = reviews.where(F.lower("review_text").contains(low) | F.lower("product_name").contains(low) | F.lower("review_id").contains(low))
    if rating:
        reviews = reviews.where(F.col("rating").between(*rating))
    if start:
        reviews = reviews.where(F.col("review_date") >= F.lit(start).cast("timestamp"))
    if end:
        reviews = reviews.where(F.col("review_date") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    for column, values in any_of.items():
        if values:
            reviews = reviews.where(F.col(column).isin(list(values)))
    return reviews


def with_theme(reviews: DataFrame, mentions: DataFrame, themes: Sequence[str], polarity: str | None = None) -> DataFrame:
    chosen = mentions.where(F.col("theme").isin(list(themes)))
    return reviews.join(chosen.where(F.col("polarity") == polarity) if polarity else chosen, "review_id", "left_semi")


def page(rows: DataFrame, number: int, size: int = 12, *order: Column | str) -> DataFrame:
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def question_themes(question: str) -> list[str]:
    """Themes whose words or hints are in a question."""
    import re

    low = question.lower()
    found = {t for t, hints in L.QUESTION_HINTS.items() if any(h in low for h in hints)}
    for theme, spec in L.THEMES.items():
        bare = low
        for phrase in spec.get("exclude", []):
            bare = bare.replace(phrase, " ")
        if any(re.search(rf"(?<!\w){re.escape(w)}(?!\w)", bare) for w in spec["keywords"] + spec["complaint"]):
            found.add(theme)
    return sorted(found)


def relevance(reviews: DataFrame, question: str, mentions: DataFrame) -> DataFrame:
    """``reviews`` with ``relevance``: cosine to the question, and 0.5 for reviews on its themes.

    Equal texts are weighed once. The question counts as a document and its vector is joined by term.
    """
    spark = reviews.sparkSession
    asked = spark.createDataFrame([(question, 1)], "review_text string, n long")
    every = reviews.groupBy("review_text").agg(F.count("*").alias("n")).unionAll(asked)
    vectors = weighted(every.select(F.sha1("review_text").alias("id"), F.lower("review_text").alias("text"), "n"), sublinear=True, pattern="[\\p{L}\\p{N}_]{2,}", stop=True)
    key = hashlib.sha1(question.encode()).hexdigest()
    query = vectors.where(F.col("id") == key).select("term", F.col("w").alias("wq"))
    score = vectors.where(F.col("id") != key).join(F.broadcast(query), "term").groupBy("id").agg(F.sum(F.col("w") * F.col("wq")).alias("cosine"))
    themes = question_themes(question)
    on = mentions.where(F.col("theme").isin(themes)).select("review_id").distinct().withColumn("__on", F.lit(0.5))
    scored = reviews.withColumn("id", F.sha1("review_text")).join(score, "id", "left").join(on, "review_id", "left")
    total = F.coalesce("cosine", F.lit(0.0)) + F.coalesce("__on", F.lit(0.0))
    return scored.withColumn("relevance", F.floor(total * 10_000 + 0.5) / 10_000).drop("id", "cosine", "__on")


def retrieve(reviews: DataFrame, question: str, mentions: DataFrame, limit: int = 60) -> DataFrame:
    """The most relevant reviews; where they are fewer than ``limit``, extremes of sentiment and the newest fill up.

    The ranking runs once: the first ``limit`` rows of each order are all that an answer can hold, and the fill is
    chosen among those few.
    """
    ranked = relevance(reviews, question, mentions)
    fit, turn = F.col("relevance") > 0.05, F.col("__turn")
    # the relevant ones, the most negative, the most positive, the newest
    ends = ranked.withColumn("__turn", F.explode(F.when(fit, F.array(F.lit(0))).otherwise(F.array(*map(F.lit, (1, 2, 3))))))
    value = F.when(turn == 0, -F.col("relevance")).when(turn == 1, F.col("sentiment_score")).when(turn == 2, -F.col("sentiment_score")).otherwise(-F.unix_micros("review_date").cast("double"))
    few = ends.withColumn("__value", value).withColumn("__rank", F.row_number().over(Window.partitionBy("__turn").orderBy("__value", "review_id"))).where(F.col("__rank") <= limit)
    have = F.count_if(turn == 0).over(Window.partitionBy())
    each = F.greatest(F.floor((limit - have) / 3), F.lit(1))
    kept = few.withColumn("__kept", (turn == 0) | ((have < limit) & (F.col("__rank") <= each))).where("__kept")
    once = kept.withColumn("__nth", F.row_number().over(Window.partitionBy("review_id").orderBy("__turn"))).where("__nth = 1")
    return once.orderBy("__turn", "__rank").limit(limit).drop("__turn", "__value", "__rank", "__kept", "__nth")


def review_line(cap: int = LINE) -> Column:
    body = F.trim(F.regexp_replace("review_text", "\\s+", " "))
    cut = F.when(F.length(body) > cap, F.concat(F.substring(body, 1, cap), F.lit("..."))).otherwise(body)
    return F.concat(F.lit("["), F.col("review_id"), F.lit("] "), F.rint("rating").cast("int").cast("string"), F.lit(" stars, "), F.date_format("review_date", "yyyy-MM-dd"), F.lit(", "), F.col("product_name"), F.lit(": "), cut)


def cited(text: Column) -> Column:
    """Ids in square brackets, in order, each once."""
    groups = F.regexp_extract_all(text, F.lit("\\[([^\\[\\]]+)\\]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, "\\s*,\\s*"))), lambda x: F.trim(x)), lambda x: x.rlike("^[\\w-]+$")))


def check_citations(answers: DataFrame, reviews: DataFrame) -> DataFrame:
    """``answer_id``, ``cited_id``, ``known`` from ``answer_id``, ``answer``."""
    ids = answers.select("answer_id", F.explode(cited(F.col("answer"))).alias("cited_id"))
    known = reviews.select(F.col("review_id").alias("cited_id")).distinct().withColumn("known", F.lit(True))
    return ids.join(known, "cited_id", "left").select("answer_id", "cited_id", F.coalesce("known", F.lit(False)).alias("known"))


def chunk_lines(lines: Sequence[str], most: int = CHUNK) -> list[str]:
    """Consecutive lines joined to chunks; a line starts a new one if it would pass ``most``."""
    out: list[list[str]] = [[]]
    size = 0
    for line in lines:
        if out[-1] and size + len(line) > most:
            out.append([])
            size = 0
        out[-1].append(line)
        size += len(line) + 1
    return ["\n".join(c) for c in out if c]


def prompt_chunks(reviews: DataFrame, newest: int = NEWEST, most: int = CHUNK) -> DataFrame:
    """``chunk``, ``text`` of the newest reviews' lines, oldest first: a bounded set, folded in order in one task."""
    last = reviews.orderBy(F.desc("review_date"), "review_id").limit(newest).select("review_date", "review_id", review_line().alias("line"))

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines = [line for part in parts for line in part["line"]]
        made = chunk_lines(lines, most)
        yield pd.DataFrame({"chunk": range(len(made)), "text": made})

    return last.repartition(1).sortWithinPartitions("review_date", "review_id").select("line").mapInPandas(fold, "chunk long, text string")


def answer_chunks(chunks: DataFrame, client: Callable[[str], str], prompt: str) -> DataFrame:
    """``client`` on every chunk behind ``prompt``; the client runs in the tasks."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"chunk": part["chunk"], "answer": [client(f"{prompt}\n\n{t}") for t in part["text"]]})

    return chunks.mapInPandas(run, "chunk long, answer string")


def _listed(items: Column) -> Column:
    return F.when(F.size(items) <= 1, F.get(items, F.lit(0))).otherwise(F.concat_ws(" and ", F.get(items, F.lit(0)), F.get(items, F.lit(1))))


def template_reply(tone: str = "Friendly", signature: str = "") -> Column:
    """A reply from ``product_name``, ``complaints`` and ``praise`` (themes, of which two are named)."""
    opening, praised, problem, after, otherwise = L.REPLY_PARTS.get(tone, L.REPLY_PARTS["Friendly"])
    phrases = F.create_map(*[F.lit(x) for kv in L.REPLY_THEMES.items() for x in kv])
    liked = _listed(F.transform(F.slice("praise", 1, 2), lambda t: F.lower(F.substring_index(t, " & ", 1))))
    issues = _listed(F.transform(F.slice("complaints", 1, 2), lambda t: F.coalesce(F.element_at(phrases, t), F.concat(F.lit("the "), F.lower(t), F.lit(" issues")))))
    body = F.concat_ws(
        " ", F.format_string(opening, F.col("product_name")), F.when(F.size("praise") > 0, F.format_string(praised, liked)), F.when(F.size("complaints") > 0, F.format_string(problem, issues)),
        F.when(F.size("complaints") > 0, F.lit(after)).otherwise(F.lit(otherwise)),
    )
    return F.concat(body, F.lit("\n\n"), F.lit(signature) if signature else F.concat(F.lit("The "), F.col("product_name"), F.lit(" team")))


def replies(reviews: DataFrame, mentions: DataFrame, tone: str = "Friendly") -> DataFrame:
    side = lambda p: F.sort_array(F.collect_set(F.when(F.col("polarity") == p, F.col("theme"))))
    by = mentions.groupBy("review_id").agg(side("complaint").alias("complaints"), side("praise").alias("praise"))
    none = F.array().cast("array<string>")
    rows = reviews.join(by, "review_id", "left").withColumn("complaints", F.coalesce("complaints", none)).withColumn("praise", F.coalesce("praise", none))
    return rows.select("review_id", template_reply(tone).alias("reply"))


def caption_offsets(snippets: DataFrame, key: str, position: str, text: str) -> DataFrame:
    """Cleaned snippets in order with the place of each in the text that joins them by spaces."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(text, "\\[[^\\]]*\\]", " "), "\\s+", " "))
    rows = snippets.withColumn("snippet", clean).where("snippet <> ''")
    before = Window.partitionBy(key).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(key, position, "snippet", F.coalesce(F.sum(F.length("snippet") + 1).over(before), F.lit(0)).cast("long").alias("place"))


def moment_seconds(text: Column, clause: Column, stamps: Column) -> Column:
    """Seconds of the last stamp at or before the clause's place in the text; the first stamp's if none is before."""
    at = F.instr(text, clause)
    found = F.filter(stamps, lambda s: s["offset"] <= at - 1)
    chosen = F.when(F.size(found) > 0, F.get(found, F.size(found) - 1)).otherwise(F.get(stamps, F.lit(0)))
    return F.when((at > 0) & (F.size(stamps) > 0), chosen["seconds"])


def moment_link(video_id: Column, seconds: Column) -> Column:
    """The address that starts a video at a moment; null without an id or a moment."""
    return F.when(video_id.isNotNull() & (video_id != "") & seconds.isNotNull(), F.concat(F.lit("https://www.youtube.com/watch?v="), video_id, F.lit("&t="), seconds.cast("long").cast("string"), F.lit("s")))


def reply_queue(reviews: DataFrame, which: str = "negative") -> DataFrame:
    """Reviews to reply to: ``negative`` ones, those ``low`` in stars (3 or fewer), or ``all``."""
    chosen = {"negative": F.col("sentiment") == "Negative", "low": F.col("rating") <= 3, "all": F.lit(True)}
    return reviews.where(chosen[which])


def new_links(links: DataFrame, known: DataFrame, link: str = "link") -> DataFrame:
    """``key``, ``link`` of the videos not yet in ``known`` (``video_id``), each once, under its first link in order."""
    from opinara.functions.parsing import youtube_id

    keyed = links.select(F.col("position"), F.trim(link).alias("link")).withColumn("key", youtube_id(F.col("link"))).where("key IS NOT NULL")
    first = keyed.groupBy("key").agg(F.min_by("link", "position").alias("link"))
    return first.join(known.select(F.col("video_id").alias("key")), "key", "left_anti")

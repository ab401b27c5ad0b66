"""Behaviours on small literals."""

from __future__ import annotations

import math
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from opinara.functions import lexicon as L
from opinara.functions import parsing as P
from opinara.functions import text as T
from opinara.functions.valence import compound, valence_score
from opinara.operators import enrich, ingest, metrics, narrate, risk, serve, trends, wishlist
from opinara.operators.similarity import nearest
from opinara.sources import files
from opinara.storage import shared_folder


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, want",
    [("5", 5.0), ("4.5", 4.5), ("5 stars", 5.0), ("4/5", 4.0), ("8 out of 10", 4.0), ("★★★★", 4.0), ("4,5", 4.5), ("none", None), ("3/0", 3.0), ("", None), (None, None)],
)
def test_rating(spark, raw, want):
    assert one(spark, raw, P.rating) == want


@pytest.mark.parametrize(
    "raw, want", [("2024-03-01", "2024-03-01 00:00:00"), ("3/4/2024", "2024-03-04 00:00:00"), ("25/12/2024", "2024-12-25 00:00:00"), ("Mar 5, 2024", "2024-03-05 00:00:00"), ("1700000000", "2023-11-14 22:13:20"), ("soon", None), (None, None)]
)
def test_date(spark, raw, want):
    assert one(spark, raw, lambda c: P.timestamp(c).cast("string")) == want


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://www.youtube.com/watch?v=abcdefghijk", "abcdefghijk"), ("https://youtu.be/abcdefghijk?t=3", "abcdefghijk"), ("youtube.com/shorts/abcdefghijk", "abcdefghijk"),
        ("https://example.com/watch?v=abcdefghijk", None), ("https://youtu.be/short", None), ("", None), (None, None),
    ],
)
def test_video_id(spark, url, want):
    assert one(spark, url, P.youtube_id) == want


@pytest.mark.parametrize(
    "text, want",
    [("Works well and looks nice", "English"), ("Bahut accha hai yaar", "Hinglish"), ("बहुत अच्छा है", "Hindi"), ("", "English"), ("the ka of", "English")],
)
def test_language(spark, text, want):
    assert one(spark, text, T.language) == want


@pytest.mark.parametrize(
    "text, sign",
    [("I love this, it is great", 1), ("Terrible, it broke", -1), ("It is not good", -1), ("accha nahi hai", -1), ("Customer care called.", 0), ("", 0), ("GREAT phone!!!", 1), ("जवाब नहीं दिया", -1)],
)
def test_valence_sign(spark, text, sign):
    score = one(spark, text, valence_score)
    assert (score > 0) - (score < 0) == sign and -1 <= score <= 1


def test_valence_order_matters():
    assert compound("very good") > compound("good") > compound("not good")
    assert compound("good but terrible") < compound("terrible but good")
    assert compound("GOOD phone") > compound("good phone")
    assert math.isclose(compound(None), 0.0)


@pytest.mark.parametrize("text, want", [("Sound quality is great", False), ("Build quality is poor", True), ("qualitywise", False), ("The hinge broke", True)])
def test_theme_words_and_exclusions(spark, text, want):
    assert one(spark, text, lambda c: T.has_theme("Product Quality", c)) is want


def _negated(text: str, start: int) -> bool:
    return bool(re.search(L.EMOTION_NEGATION + "$", text[max(0, start - 20) : start], re.I))


@pytest.mark.parametrize("text", ["not good", "good", "never a good thing", "not a very good one, but good", "no good nice", "I love it, worst ever", "", "nahi accha", "it is n't nice"])
def test_emotion_against_windows(spark, text):
    best, top = L.NO_EMOTION, 0
    for name, words in L.EMOTIONS.items():
        hits = [m for m in re.finditer(rf"(?<!\w)(?:{'|'.join(words)})(?!\w)", text, re.I) if not (name in L.POSITIVE_EMOTIONS and _negated(text, m.start()))]
        if len(hits) > top:
            best, top = name, len(hits)
    assert one(spark, text, T.emotion) == best


REVIEWS = [
    ("a", "P", 5.0, "Battery is great but delivery was late.", "2024-01-01"),
    ("b", "P", 1.0, "Screen broke. The battery drains.", "2024-01-02"),
    ("c", "Q", 3.0, "Delivery. Delivery was late!", "2024-01-03"),
    ("d", "Q", 2.0, "", "2024-01-04"),
]


@pytest.fixture(scope="module")
def reviews(spark):
    rows = spark.createDataFrame(REVIEWS, "review_id string, product_name string, rating double, review_text string, d string")
    return enrich.add_sentiment(rows.withColumn("review_date", F.to_timestamp("d")).drop("d")).cache()


def test_mentions_prefer_complaints(reviews):
    found = {(r["review_id"], r["theme"]): (r["polarity"], r["clause"]) for r in enrich.mentions(reviews).collect()}
    assert found["a", "Battery & Charging"] == ("praise", "Battery is great")
    assert found["a", "Shipping & Delivery"] == ("complaint", "delivery was late")
    assert found["c", "Shipping & Delivery"] == ("complaint", "Delivery was late")
    assert not any(k[0] == "d" for k in found)


def test_empty_tables(reviews):
    none = reviews.where("false")
    m = enrich.mentions(none)
    assert m.count() == 0 and metrics.priority_ranking(none, m).count() == 0 and trends.review_trends(none, "Daily").count() == 0
    assert risk.assess(none).count() == 0 and trends.spike_alerts(none, m).count() == 0 and metrics.label_counts(none, "sentiment", L.SENTIMENTS).count() == 3
    assert narrate.headline(m) == "No theme stands out yet."


def test_gaps_are_filled(reviews):
    rows = trends.review_trends(reviews.where("review_id IN ('a', 'd')"), "Daily").orderBy("period").collect()
    assert [r["reviews"] for r in rows] == [1, 0, 0, 1] and rows[1]["avg_rating"] is None and rows[1]["negative_pct"] is None


def test_risk_reasons_in_order(spark, reviews):
    burst = reviews.limit(0).unionByName(spark.createDataFrame([(f"x{i}", "P", 5.0, "BEST PRODUCT EVER BUY IT!!!", 0.0) for i in range(3)] + [(f"y{i}", "P", 4.0, "Works.", 0.0) for i in range(4)], "review_id string, product_name string, rating double, review_text string, sentiment_score double")
        .withColumn("review_date", F.to_timestamp(F.when(F.col("review_id").startswith("x"), "2024-05-01").otherwise(F.concat(F.lit("2024-06-0"), F.substring("review_id", 2, 1).cast("int") + 1)))).withColumn("sentiment", F.lit("Neutral")).withColumn("language", F.lit("English")))
    got = {r["review_id"]: r for r in risk.assess(burst).collect()}
    assert got["x0"]["risk_reasons"][0] == "Part of a burst of 3" and got["x0"]["risk_score"] == 20 + 15 + 10 + 10 + 5 and got["x0"]["risk_level"] == "High"


def test_integrity_counts_copies(spark, sf):
    from collections import Counter

    from opinara.plans import narratives
    from opinara.plans.feedback import enriched

    rows = risk.assess(enriched(spark, sf)).select("review_id", "review_text", "rating", "risk_score").collect()
    words = {t: re.findall(r"[\w\u0900-\u097f]+", t.lower()) for t in {r["review_text"] for r in rows}}
    terms = {t: Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]) for t, w in words.items()}
    times = Counter(r["review_text"] for r in rows)
    df = Counter()
    for t, found in terms.items():
        for term in found:
            df[term] += times[t]
    weights = {t: {k: n * (math.log((1 + len(rows)) / (1 + df[k])) + 1) for k, n in found.items()} for t, found in terms.items()}
    norm = {t: math.sqrt(sum(w * w for w in v.values())) for t, v in weights.items()}

    def best(t):
        if times[t] > 1:
            return 1.0
        s, other = max((sum(w * weights[o].get(k, 0) for k, w in weights[t].items()) / norm[t] / norm[o], o) for o in weights if o != t)
        return s if min(len(t), len(other)) / max(len(t), len(other)) >= 0.6 else 0.0

    levels, copies, near = Counter(), 0, {t: best(t) for t in terms}
    for r in rows:
        points = 40 if near[r["review_text"]] >= 0.9 else 20 if near[r["review_text"]] >= 0.75 else 0
        score = min(100, r["risk_score"] + points + (5 if points and not r["risk_score"] and r["rating"] in (1, 5) else 0))
        levels["high" if score >= 55 else "medium" if score >= 30 else "low"] += 1
        copies += round(near[r["review_text"]], 2) >= 0.9
    got = narratives.QUERIES["integrity"](spark, sf).first().asDict()
    assert copies > 0 and got == {"reviews": len(rows), "high": levels["high"], "medium": levels["medium"], "low": levels["low"], "copies": copies}


def test_nearest_with_copies_and_ties(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "one two three four five"), (3, "one two three four six"), (4, "nothing alike here"), (5, ""), (6, None)], "id long, text string")
    got = {r["id"]: (r["partner"], r["similarity"]) for r in nearest(docs.where("text IS NOT NULL"), T.similarity_text(F.col("text")), 0.3).collect()}
    assert got[1] == (2, 1.0) and got[2] == (1, 1.0) and got[3][0] == 1 and 4 not in got


def test_nearest_moves_less_than_four_times_its_texts(spark):
    """a row for each posting took over seven times the input; and all partners against brute force."""
    import random
    from collections import Counter

    draw = random.Random(7)
    words = [f"w{k}x{k * 7919 % 1009}" for k in range(1500)]
    texts = [[words[min(int(draw.expovariate(0.004)), 1499)] for _ in range(draw.randint(20, 500))] for _ in range(120)]
    texts += [[w if draw.random() > 0.01 * k else draw.choice(words) for w in texts[k]] for k in range(30)] + texts[100:105]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "id long, text string").repartition(4).cache()
    docs.count()
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    before = written()
    got = {r["id"]: (r["partner"], r["similarity"]) for r in nearest(docs, T.similarity_text(F.col("text"))).collect()}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert written() - before < 4 * sum(len(" ".join(w)) for w in texts)
    terms = [Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]) for w in texts]
    df = Counter(t for found in terms for t in found)
    vectors = [{t: n * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in found.items()} for found in terms]
    norm = [math.sqrt(sum(w * w for w in v.values())) for v in vectors]
    best = {}
    for a, v in enumerate(vectors):
        s, b = max((math.floor(sum(w * u.get(t, 0) for t, w in v.items()) / norm[a] / norm[b] * 1e6 + 0.5) / 1e6, -b) for b, u in enumerate(vectors) if a != b)
        if s >= 0.75:
            best[a] = (-b, s)
    assert len(best) > 30 and got == best


def test_nearest_by_vector_not_by_text(spark):
    """Other texts of the same vector tie with copies, and texts without words have no partner."""
    docs = spark.createDataFrame([(1, "x a x b x"), (5, "x b x a x"), (6, "x b x a x"), (7, "!"), (8, "?!"), (9, None), (10, "q r s")], "id long, text string")
    got = {r["id"]: (r["partner"], r["similarity"]) for r in nearest(docs, T.similarity_text(F.col("text"))).collect()}
    assert got == {1: (5, 1.0), 5: (1, 1.0), 6: (1, 1.0)}


def test_similar_reviews_with_text_ids(spark):
    start = "one two three four five six seven eight nine "
    rows = spark.createDataFrame([("a", start + "ten"), ("b", start + "eleven"), ("c", start + "twelve"), ("d", "nothing alike")], "review_id string, review_text string")
    got = {r["review_id"]: r["similar_to"] for r in risk.similar_reviews(rows, 0.3).collect()}
    assert got == {"a": "b", "b": "a", "c": "a"}


def test_requests_group_by_synonyms(spark):
    rows = spark.createDataFrame(
        [("r1", "P", 4.0, "I wish it had an equalizer."), ("r2", "P", 3.0, "Nice. I wish it had an equaliser!"), ("r3", "Q", 5.0, "Please add a running mode."), ("r4", "Q", 5.0, "Works.")],
        "review_id string, product_name string, rating double, review_text string",
    ).withColumn("review_date", F.to_timestamp(F.lit("2024-01-01")))
    groups = wishlist.group_requests(wishlist.extract_requests(rows)).orderBy(F.desc("reviews")).collect()
    assert [g["reviews"] for g in groups] == [2, 1]


def test_detection_of_other_headers(spark):
    raw = spark.createDataFrame([(str(i), f"Phone {i % 3}", f"It works well for me, number {i}.", f"{1 + i % 5}/5", f"2024-01-{1 + i % 28:02d}") for i in range(60)], "id string, item string, comment string, stars string, created_at string")
    found = ingest.detect_columns(raw)
    assert found.columns == {"review_id": "id", "product_name": "item", "review_text": "comment", "rating": "stars", "review_date": "created_at"} and not found.missing
    assert ingest.mapping_problems(found.columns | {"rating": "id"}, raw.columns) == ["id is used twice"]


def test_unmappable(spark):
    raw = spark.createDataFrame([("x", "y")] * 5, "col_a string, col_b string")
    assert set(ingest.detect_columns(raw).missing) >= {"review_text", "rating", "review_date"}


def test_file_to_reviews(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_bytes("Id;Product;Review;Stars;Date\n1;Mug;Das ist sehr gut und schön;8;2024-02-03\n2;Mug;Not so good, I think it leaks;2;2024-02-04\n3;;  ;5;2024-02-05\n4;Mug;No date here but words enough;10;\n".encode("cp1252"))
    df = files.read_reviews(spark, str(path), "r").orderBy("review_id")
    rows = df.collect()
    assert [r["review_id"] for r in rows] == ["1", "2"] and rows[0]["rating"] == 4.1 and "schön" in rows[0]["review_text"]
    good, failed = files.read_many(spark, {"r": str(path), "gone": str(tmp_path / "none.csv")})
    assert good.count() == 2 and list(failed) == ["gone"]
    files.export(df, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2


def test_scale_and_conflicts(spark):
    rows = spark.createDataFrame([(1, "A", "x"), (2, "A", "y"), (3, "A", "x"), (4, "B", "z")], "_seq long, review_id string, review_text string")
    got = [r["review_id"] for r in ingest.rename_conflicts(rows, "_seq", on=("review_id", "review_text")).orderBy("_seq").collect()]
    assert got == ["A", "A~2", "A", "B"]


def test_chunks_never_split_lines():
    lines = ["x" * n for n in (10, 20, 5, 40, 1)]
    chunks = serve.chunk_lines(lines, 30)
    assert "\n".join(chunks).split("\n") == lines and all(len(c) <= 31 or "\n" not in c for c in chunks) and serve.chunk_lines([], 5) == []


def test_question_themes():
    assert serve.question_themes("Does the battery last?") == ["Battery & Charging"] and serve.question_themes("hello") == []


def test_moment(spark):
    row = spark.createDataFrame([("hello there my friend", [(0, 1.0), (6, 4.0), (12, 9.0)])], "t string, s array<struct<offset:int,seconds:double>>")
    at = lambda w: row.select(serve.moment_seconds(F.col("t"), F.lit(w), F.col("s")).alias("x")).first()["x"]
    assert at("my") == 9.0 and at("there") == 4.0 and at("absent") is None


def test_winners():
    a, b = ({"reviews": 3, "avg_rating": 4.0, "positive_pct": 50.0, "negative_pct": 10.0, "health": 70}, {"reviews": 2, "avg_rating": 4.0, "positive_pct": 40.0, "negative_pct": 20.0, "health": 71})
    assert metrics.winners(a, b) == {"reviews": -1, "avg_rating": -1, "positive_pct": 0, "negative_pct": 0, "health": 1}


def test_stream(spark, reviews, tmp_path):
    from opinara.streaming.trends import trend_stream

    reviews.select("review_id", "rating", "review_date").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("review_id string, rating double, review_date timestamp").parquet(str(tmp_path / "in"))
    q = trend_stream(stream).writeStream.outputMode("complete").format("memory").queryName("trend").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("trend").count() == 4


def test_report(reviews):
    assert "## Priorities" in narrate.report(reviews, enrich.mentions(reviews)).markdown()


def test_theme_words_in_one_pass(spark):
    """The bits of a clause are what the patterns of each theme say of it."""
    from opinara.sources.reviews import CLOSERS, MIDDLES, OPENERS

    words = [w for spec in L.THEMES.values() for part in spec.values() for w in part]
    texts = [*OPENERS, *MIDDLES, *CLOSERS, *words, *(f"{a} {b}" for a, b in zip(words, words[7:])), *(f"x{w} {w}y, {w}!" for w in words), "", "SOUND QUALITY", "build quality and sound quality", "support team's customer support team"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    want = [F.array(T.has_theme(name, t), t.rlike(T.whole_words(spec["complaint"]))) for name, spec in L.THEMES.items()]
    got = [F.array(T.theme_mask(t).bitwiseAND(F.lit(1 << k)) != 0, T.theme_mask(t).bitwiseAND(F.lit(1 << 16 + k)) != 0) for k in range(len(L.THEMES))]
    for r in df.select("t", F.array(*want).alias("want"), F.array(*got).alias("got")).collect():
        assert [w[0] for w in r["want"]] == [g[0] for g in r["got"]], r["t"]
        assert all(w[1] == g[1] for w, g in zip(r["want"], r["got"]) if w[0]), r["t"]


@pytest.mark.parametrize("words", [["drain", "drains", "drained"], ["a.b", "a+"], ["eq"], ["customer care", "customer", "care"]])
def test_patterns_of_words(words):
    found = re.compile(f"(?:{T.any_of(words)})")
    assert all(found.fullmatch(w) for w in words) and not any(found.fullmatch(w + "x") or found.fullmatch(w[:-1] + "#") for w in words)


@pytest.mark.parametrize("at", [3, 401])
def test_encoding_is_that_of_the_whole_file(spark, tmp_path, at):
    lines = ["Id;Product;Review;Stars;Date"] + [f"{k};Mug;This one is number {k} and it works;4;2024-02-03" for k in range(500)]
    lines[at + 1] = f"{at};Mug;Das ist schön gut \x80 so;4;2024-02-03"
    (tmp_path / "r.csv").write_bytes("\n".join(lines).encode("latin-1"))
    rows = {r["Id"]: r["Review"] for r in files.read_delimited(spark, str(tmp_path / "r.csv")).collect()}
    assert len(rows) == 500 and rows[str(at)] == "Das ist schön gut € so"
    lines[at + 1] += "\x81"
    (tmp_path / "open.csv").write_bytes("\n".join(lines).encode("latin-1"))
    assert files.judged(spark.read.text(str(tmp_path / "open.csv"))) == ("latin-1", False)
    (tmp_path / "u.csv").write_text("\n".join(lines), encoding="utf-8")
    assert files.judged(spark.read.text(str(tmp_path / "u.csv"))) == ("utf-8", False)


def test_quotes_that_span_lines(spark, tmp_path):
    (tmp_path / "r.csv").write_text('id,text\n1,"one\ntwo"\n2,three\n')
    assert [tuple(r) for r in files.read_delimited(spark, str(tmp_path / "r.csv")).collect()] == [("1", "one\ntwo"), ("2", "three")]
    for empty in ("", " \n \n"):
        (tmp_path / "e.csv").write_text(empty)
        with pytest.raises(ValueError, match="empty"):
            files.read_delimited(spark, str(tmp_path / "e.csv"))


def test_rows_are_numbered_from_zero(spark):
    rows = ingest.numbered(spark.range(100, numPartitions=7)).orderBy("_row").collect()
    assert [(r["id"], r["_row"]) for r in rows] == [(k, k) for k in range(100)]
    assert ingest.numbered(spark.range(0)).count() == 0


def test_unreadable_files_give_the_sample(spark, tmp_path, reviews):
    got, why = files.load_reviews(spark, str(tmp_path / "none.csv"), "none", reviews)
    assert got is reviews and why


def test_large_ingest(spark, tmp_path):
    import time

    began = time.perf_counter()
    rows = spark.range(50_000).select(F.col("id").cast("string").alias("review_id"), F.concat(F.lit("Product "), F.col("id") % 5).alias("product"), F.concat(F.lit("It works well for me, number "), "id").alias("review"), (1 + F.col("id") % 5).alias("stars"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 600).cast("string").alias("date"))
    rows.write.csv(str(tmp_path / "big"), header=True)
    assert files.read_reviews(spark, str(tmp_path / "big"), "big").count() == 50_000
    assert time.perf_counter() - began < 60


def test_video_store_of_an_array(spark, tmp_path):
    (tmp_path / "v.json").write_text('[{"review_id": "a", "review_text": "good", "views": 5},\n {"review_id": "b"}, {"review_text": "c"}]')
    assert [r["review_id"] for r in files.read_videos(spark, str(tmp_path / "v.json")).collect()] == ["a"]
    (tmp_path / "w.json").write_text('{"review_id": "a", "review_text": "good"}\n{"review_id": "b", "review_text": "bad"}\n')
    assert files.read_videos(spark, str(tmp_path / "w.json")).count() == 2


def test_choices_for_a_mapping():
    options = ingest.column_options(["a", "b"])
    assert options["review_text"] == ["a", "b"] and options["rating"][-1] == ingest.FROM_TEXT and options["review_date"][-1] == ingest.TODAY


def test_copies_are_marked_once(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", "x"), (4, "a", None)], "k long, t string, u string")
    assert {r["k"]: r["copy"] for r in ingest.mark_copies(rows, ["k"], on=("t", "u")).collect()} == {1: 0, 2: 1, 3: 0, 4: 1}


def test_requests_join_the_first_earlier_group(spark):
    """Groups by the quadratic walk over all requests, in order, against the aggregate."""
    import itertools

    wishes = ["I wish it had a longer cable", "I wish it had a longer cable and a case", "Please add a case", "I wish it had a case and a stand", "It should have a stand", "I wish it had a longer strap", "Please add a dark mode"]
    rows = [(f"r{i:02d}", "P", 4.0, w + ".", "2024-01-01") for i, w in enumerate(itertools.islice(itertools.cycle(wishes), 20))]
    requests = wishlist.extract_requests(spark.createDataFrame(rows, "review_id string, product_name string, rating double, review_text string, d string").withColumn("review_date", F.to_timestamp("d")))
    for threshold in (0.1, 0.25, 0.45):
        from opinara.operators.similarity import similar_pairs, weighted

        texts = requests.groupBy(T.request_key(F.col("request")).alias("id")).agg(F.count("*").alias("n"), F.min("review_id").alias("first")).withColumn("text", F.col("id"))
        order = [r["id"] for r in texts.orderBy("first").collect()]
        near = {(r["a"], r["b"]) for r in similar_pairs(weighted(texts.select("id", "text", "n"), True, "[\\p{L}\\p{N}_]{2,}", True), threshold).collect()}
        group: dict[str, int] = {}
        for i, a in enumerate(order):
            group.setdefault(a, len(set(group.values())))
            for b in order[i + 1 :]:
                if b not in group and ((a, b) in near or (b, a) in near):
                    group[b] = group[a]
        assert wishlist.group_requests(requests, threshold).count() == len(set(group.values()))


def told():
    """A client that notes what it is asked, and cites."""

    def client(rules: str, prompt: str) -> str:
        ids = re.findall(r"^\[([\w-]+)\]", prompt, re.M)
        return f"# Seen [{', '.join(ids[:2])}] [made-up]" if "<notes>" not in prompt else f"Combined {prompt.count('Notes on part')} parts [a, zz]"

    return client


def test_analysis_of_one_and_of_many_parts(spark, reviews):
    from opinara.operators import assist

    one = assist.summary("overall", reviews, told(), stats="n: 4")
    assert one.chunks == 1 and one.reviews_total == 4 and one.unknown == ["made-up"] and set(one.cited) <= {"a", "b", "c", "d"}
    many = assist.summary("negative", reviews, told(), most=60)
    assert many.chunks > 1 and many.text == f"Combined {many.chunks} parts [a, zz]" and many.cited == ["a"] and many.unknown == ["zz"]
    assert assist.summary("headline", reviews, told()).text == "Seen"
    assert assist.summary("overall", reviews, told(), newest=2).reviews_used == 2
    with pytest.raises(ValueError):
        assist.summary("overall", reviews.where("false"), told())
    with pytest.raises(ValueError):
        assist.answer("  ", reviews, told())
    with pytest.raises(ValueError):
        assist.answer("x" * 501, reviews, told())
    assert assist.answer("Why late?", reviews, told()).chunks == 1 and assist.compare(reviews, "P", reviews, "Q", told(), "").reviews_total == 8
    assert assist.cited_ids("[a, b] x [b] [not an id] [c-1]") == ["a", "b", "c-1"] and assist.draft_reply("bad", "P", 2.0, lambda r, p: p).endswith("The P team")


def test_planted_patterns_are_found(spark):
    from opinara.sources.demo import demo_reviews

    made = enrich.add_sentiment(demo_reviews(spark)).cache()
    assert made.count() == 309 and sorted(map(str, made.collect())) == sorted(map(str, enrich.add_sentiment(demo_reviews(spark)).collect()))
    rated = {r["review_id"]: r for r in risk.assess(made, risk.similar_reviews(made)).collect()}
    assert all(rated[f"B{k}"]["burst"] for k in range(6)) and all(rated[f"B{k}"]["risk_level"] == "High" for k in range(6))
    assert all(rated[f"C{k}"]["risk_reasons"][0].startswith("Near-duplicate of review C") for k in range(3))
    mine = made.where(F.col("product_name") == "Aura Headphones")
    assert "Connectivity" in {r["theme"] for r in metrics.priority_ranking(mine, enrich.mentions(mine)).where("recent_rise > 0").collect()}
    assert 15 <= wishlist.extract_requests(made).select("review_id").distinct().count() <= 60
    assert {r["language"] for r in made.select("language").distinct().collect()} == {"English", "Hinglish", "Hindi"}


@pytest.mark.parametrize("master, allowed", [("local", True), ("local[4]", True), ("local[*]", True), ("local-cluster[3,2,1000]", False), ("yarn", False), ("spark://host:7077", False)])
def test_an_unset_folder_is_an_error_on_a_cluster(master, allowed):
    made = []
    context = SimpleNamespace(master=master, getConf=lambda: {}, getCheckpointDir=lambda: None, setCheckpointDir=made.append)
    if allowed:
        assert shared_folder(SimpleNamespace(sparkContext=context)) == made[0]
    else:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_folder(SimpleNamespace(sparkContext=context))

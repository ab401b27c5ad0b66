"""Secret scans: three fixed patterns, and Markov models of random strings against identifiers.

Only DataFrame expressions run on the main path. Positions come from the pieces between matches:
``split`` gives the gaps, ``regexp_extract_all`` the matches, and a running sum of their lengths
the starts, in code points.

The method: two first-order Markov models over characters are counted from labelled samples, one
of random strings and one of ordinary identifiers, made of words of the table and of common code words. A long
token whose mean log-likelihood ratio favours the random model is a further span, unless it overlaps a span of the
fixed patterns. Where the whole token does not, its parts between = and / count, and then the token, if any 20
characters in a row do.

Long texts are scanned in pieces of about PIECE characters, cut only where no pattern can match across, so spans
are those of the whole text, and time grows with the text however many spans it has. Without such a place a piece
goes on; within one, time grows with the square of its spans.

Null texts count as empty and have no spans. Repeated rows are scanned row by row. Texts of any
length are scanned whole. Other columns are not looked at, and keep their names and values.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm.common import free, let

ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
#: A value behind a name, or a step of a path.
PART = "[A-Za-z0-9+_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
PIECE = 4096
#: After a character that is in no pattern, after one space that does not stand beside a sign of assignment, or
#: after a colon that no name of a secret, quote or space precedes.
_CUT = "(?:(?<=[^A-Za-z0-9+/_.=:\"'\\x20-])|(?<=[^:=\\x20]\\x20)(?![:=\\x20])|(?<=[^dtnyDTNY\"'\\x20]:))"

ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
#: Words of the table that ordinary identifiers are made of, and the documents they come from, at most in the mean.
CORPUS_WORDS, CORPUS_DOCS = 1000, 400
#: Samples of each label, and the mean log-likelihood ratio a transition must exceed.
SAMPLES = 3000
THRESHOLD = 0.35
#: Characters in a row that are judged by themselves, where ordinary ones would average a secret away.
WINDOW = 20
#: Fewer distinct characters, as in rules of dashes, make no secret.
DISTINCT = 8

#: Common words of code.
_WORDS = (
    "account action address agent amount answer array article author balance batch block border branch buffer build "
    "button cache channel client cluster code column commit config content context control counter country create "
    "customer data date default delete detail device direct document domain driver element email engine entry error "
    "event export factory field file filter folder format frame function gateway group handle header history house "
    "image import index input insert install instance interface invoice item journal kernel label language layer layout "
    "length level library limit linear list local lock logger machine main manager market master matrix member memory "
    "message method metric model module monitor network node notice number object offset option order output owner "
    "package page panel parent parser partner path pattern payment people person picture platform player point policy "
    "price print process product profile project property provider public query queue random reader record region "
    "release remote report request resource response result return review router sample schema school screen script "
    "search section select sender series server service session setting shape signal simple single source space state "
    "station status stock storage stream string student style subject summary supply support switch system table target "
    "template test text theme thread time title total track trade transfer travel tree trigger type union update upload "
    "user value vector version video view visit volume water weather week widget window winter worker world writer year"
).split()


def corpus_words(df: DataFrame, text: str = "text") -> list[str]:
    """At most CORPUS_WORDS words of four to twelve letters, from one document in as many as leave about CORPUS_DOCS.

    A word is a whole token, so no part of a longer one, such as a secret, is learnt as ordinary.

    Documents and words are drawn by hash, so the same table gives the same words, whatever its partitions.
    """
    every = max(1, df.count() // CORPUS_DOCS)
    some = df.where(F.pmod(F.xxhash64(F.col(text)), F.lit(every)) == 0)
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit("(?<![a-z0-9+/_=-])[a-z]{4,12}(?![a-z0-9+/_=-])"), F.lit(0)))
    few = F.slice(F.sort_array(F.transform(found, lambda w: F.struct(F.xxhash64(w).alias("lot"), w.alias("word")))), 1, CORPUS_WORDS)
    words = some.select(F.explode(few).alias("w")).select("w.*").distinct().orderBy("lot", "word").limit(CORPUS_WORDS)
    return [r["word"] for r in words.collect()]


def labelled_samples(spark: SparkSession, per_label: int = SAMPLES, words: list[str] | None = None) -> DataFrame:
    """``text``, ``random``: digests in four alphabets, and identifiers in five styles of words.

    Identifiers are made of common code words and of ``words``, each as likely as the other.
    """
    usual = [*_WORDS, *(words or [])]
    rows, listed = spark.range(per_label), F.lit(usual)

    def word(k: int) -> Column:
        return F.element_at(listed, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(usual))) + 1).cast("int"))

    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    coded = F.base64(F.unhex(digest))
    plain = F.regexp_replace(coded, "[^A-Za-z0-9]", "")
    kind = F.pmod(F.col("id"), F.lit(5))
    random = (
        F.when(kind == 0, digest).when(kind == 1, plain).when(kind == 2, F.upper(plain)).when(kind == 3, F.translate(coded, "+/=", "-_")).otherwise(coded)
    )
    three = [word(1), word(2), word(3)]
    ordinary = (
        F.when(kind == 0, F.concat_ws("_", *three))
        .when(kind == 1, F.concat(three[0], F.initcap(three[1]), F.initcap(three[2])))
        .when(kind == 2, F.concat_ws("-", *three, F.pmod(F.xxhash64("id"), F.lit(100)).cast("string")))
        .when(kind == 3, F.concat(F.lit("/"), F.concat_ws("/", *three)))
        .otherwise(F.upper(F.concat_ws("_", *three)))
    )
    return rows.select(random.alias("text"), F.lit(True).alias("random")).unionAll(rows.select(ordinary, F.lit(False)))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all transitions of ALPHABET, row by row; add-one smoothing within a label.

    What reaches the driver is at most one count for each pair of characters and label.
    """
    chars = samples.select("random", F.split("text", "").alias("c")).where(F.size("c") > 1)
    pairs = chars.select("random", F.explode(F.arrays_zip(F.slice("c", F.lit(1), F.size("c") - 1).alias("a"), F.slice("c", F.lit(2), F.size("c") - 1).alias("b"))).alias("p"))
    found = {(r["random"], r["a"], r["b"]): r["n"] for r in pairs.groupBy("random", "p.a", "p.b").agg(F.count("*").alias("n")).collect()}
    size = len(ALPHABET)
    totals = {(label, a): sum(found.get((label, a, b), 0) for b in ALPHABET) for label in (True, False) for a in ALPHABET}

    def log_p(label: bool, a: str, b: str) -> float:
        return math.log((found.get((label, a, b), 0) + 1) / (totals[label, a] + size))

    return [log_p(True, a, b) - log_p(False, a, b) for a in ALPHABET for b in ALPHABET]


def _steps(token: Column, table: Column) -> Column:
    """The log-likelihood ratio of the transition to each character of ``token``; zero for the first."""
    places = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return let(places, lambda p: F.transform(p, lambda x, i: F.when(i > 0, F.coalesce(F.get(table, F.get(p, i - 1) * len(ALPHABET) + x), F.lit(0.0))).otherwise(F.lit(0.0))))


def _mean(steps: Column) -> Column:
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / (F.size(steps) - 1)


def mean_ratio(token: Column, ratios: list[float] | Column) -> Column:
    """Mean log-likelihood ratio over the transitions of ``token``."""
    return _mean(_steps(token, ratios if isinstance(ratios, Column) else F.lit(ratios)))


def _best_window(steps: Column) -> Column:
    """The largest mean of any WINDOW characters in a row; there are no fewer."""
    part = lambda i: F.aggregate(F.slice(steps, i, WINDOW - 1), F.lit(0.0), lambda s, x: s + x)
    return F.array_max(F.transform(F.sequence(F.lit(2), F.size(steps) - (WINDOW - 2)), part)) / (WINDOW - 1)


def _span(kind: int, start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))


def _no_spans() -> Column:
    return F.array().cast("array<struct<start:int,kind:int,end:int>>")


def match_spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans of the matches for which ``keep`` of (match index, match, start, end) holds, in order."""

    def placed(found: Column) -> Column:
        def walk(gaps: Column) -> Column:
            start = F.struct(F.lit(0).alias("at"), _no_spans().alias("spans"))

            def step(state: Column, item: Column) -> Column:
                begin = state["at"] + F.length(F.get(gaps, item["i"]))
                end = begin + F.length(item["m"])
                spans = F.when(keep(item["i"], item["m"], begin, end), F.concat(state["spans"], F.array(_span(kind, begin, end)))).otherwise(state["spans"])
                return F.struct(end.alias("at"), spans.alias("spans"))

            return F.aggregate(F.transform(found, lambda m, i: F.struct(m.alias("m"), i.alias("i"))), start, step, lambda s: s["spans"])

        return F.when(F.size(found) == 0, _no_spans()).otherwise(let(F.split(text, pattern, -1), walk))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def base_spans(text: Column) -> Column:
    """All spans of the fixed patterns, by start and then kind."""
    always = lambda *_: F.lit(True)
    assign = let(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda values: F.when(F.size(values) == 0, _no_spans()).otherwise(match_spans(text, ASSIGN, 0, lambda i, *_: F.length(F.get(values, i)) >= 8)))
    return F.sort_array(F.concat(assign, match_spans(text, ACCESS, 1, always), match_spans(text, HEX, 2, always)))


def _apart(start: Column, end: Column, taken: Column) -> Column:
    return ~F.exists(taken, lambda b: (b["start"] < end) & (start < b["end"]))


def random_spans(text: Column, base: Column, ratios: list[float], threshold: float = THRESHOLD) -> Column:
    """Tokens that the random model explains better as a whole, then their parts and tokens of which a window says so; none overlaps another or a base span."""

    def found(table: Column) -> Column:
        varied = lambda m: F.size(F.array_distinct(F.split(m, ""))) >= DISTINCT
        whole = lambda i, m, a, z: _apart(a, z, base) & varied(m) & (mean_ratio(m, table) > threshold)
        within = lambda i, m, a, z: _apart(a, z, base) & varied(m) & let(_steps(m, table), lambda s: (_mean(s) > threshold) | (_best_window(s) > threshold))
        tries = F.concat(match_spans(text, CANDIDATE, 3, whole), match_spans(text, PART, 3, within), match_spans(text, CANDIDATE, 3, within))

        def step(kept: Column, s: Column) -> Column:
            return F.when(_apart(s["start"], s["end"], kept), F.concat(kept, F.array(s))).otherwise(kept)

        return F.sort_array(F.aggregate(tries, _no_spans(), step))

    return F.when(text.rlike(CANDIDATE), let(F.lit(ratios), found)).otherwise(_no_spans())


def pieces(text: Column) -> Column:
    """The text in pieces of PIECE characters or more, cut where no pattern matches across."""
    cut = f"(?s).{{{PIECE},}}?(?:{_CUT}|\\z)|.+"
    return F.when(F.length(text) <= PIECE, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(cut), F.lit(0)))


def with_pieces(df: DataFrame, text: str = "text", samples: DataFrame | None = None) -> tuple[DataFrame, str]:
    """``df`` with an array of ``at`` (the start), ``text``, ``base`` and ``added`` (arrays of start, kind, end, within the piece), and its name."""
    ratios = train(labelled_samples(df.sparkSession, words=corpus_words(df, text)) if samples is None else samples)
    name = free(df, "__pieces")

    def scanned(piece: Column) -> Column:
        return let(base_spans(piece), lambda base: F.struct(piece.alias("text"), base.alias("base"), random_spans(piece, base, ratios).alias("added")))

    def placed(parts: Column) -> Column:
        size = lambda s, i: F.when(i == 0, F.lit(0)).otherwise(F.element_at(s, -1) + F.length(F.get(parts, i - 1)["text"]))
        starts = F.aggregate(F.sequence(F.lit(0), F.size(parts) - 1), F.array().cast("array<int>"), lambda s, i: F.concat(s, F.array(size(s, i))))
        return let(starts, lambda s: F.transform(parts, lambda p, i: F.struct(F.get(s, i).alias("at"), p["text"].alias("text"), p["base"].alias("base"), p["added"].alias("added"))))

    found = F.transform(pieces(F.coalesce(F.col(text), F.lit(""))), scanned)
    return df.withColumn(name, let(found, placed)), name


def _all(parts: Column, field: str) -> Column:
    """The spans of all pieces, placed in the text."""
    moved = lambda p: F.transform(p[field], lambda s: F.struct((s["start"] + p["at"]).alias("start"), s["kind"].alias("kind"), (s["end"] + p["at"]).alias("end")))
    return F.flatten(F.transform(parts, moved))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", samples: DataFrame | None = None) -> DataFrame:
    """Per row: counts of the fixed kinds, a digest of their spans, and all spans."""
    placed, name = with_pieces(df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), samples=samples)
    spans = placed.select("doc_id", _all(F.col(name), "base").alias("base"), _all(F.col(name), "added").alias("added"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return spans.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.sort_array(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_random"),
    )


def redact(df: DataFrame, text: str = "text", samples: DataFrame | None = None) -> DataFrame:
    """``df`` with every span replaced by its kind in brackets; overlapping spans become one."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def clean(p: Column) -> Column:
        def step(state: Column, s: Column) -> Column:
            fresh = s["start"] >= state["at"]
            piece = F.concat(state["out"], F.substring(p["text"], state["at"] + 1, s["start"] - state["at"]), F.get(names, s["kind"]))
            return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(fresh, piece).otherwise(state["out"]).alias("out"))

        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        return F.aggregate(F.sort_array(F.concat(p["base"], p["added"])), start, step, lambda s: F.concat(s["out"], F.substring(p["text"], s["at"] + 1, F.length(p["text"]))))

    placed, name = with_pieces(df, text, samples)
    untouched = F.forall(name, lambda p: F.size(p["base"]) + F.size(p["added"]) == 0)
    return placed.withColumn(text, F.when(untouched, F.col(text)).otherwise(F.array_join(F.transform(name, clean), ""))).drop(name)

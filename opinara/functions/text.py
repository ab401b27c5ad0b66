"""Text expressions: clauses, themes, polarity, language, emotion, requests and the lexicon score.

All of it stays in the JVM. ``lexicon_score`` is the scorer for large inputs; the word-order heuristics are
in ``valence``, as an Arrow function.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinara.functions import lexicon as L

_WORD = "[\\p{L}\\p{N}_\\u0900-\\u097F]"
_JAVA_SPECIAL = re.compile(r"([\\.^$|?*+()\[\]{}])")


def quoted(word: str) -> str:
    return _JAVA_SPECIAL.sub(r"\\\1", word)


def any_of(words: Iterable[str]) -> str:
    """A pattern for any of ``words``, the longest that fits: common beginnings are tried once."""
    tree: dict = {}
    for word in words:
        at = tree
        for sign in word:
            at = at.setdefault(sign, {})
        at[""] = {}

    def told(at: dict) -> str:
        parts = [quoted(sign) + told(rest) for sign, rest in at.items() if sign]
        if not parts:
            return ""
        return parts[0] if len(parts) == 1 and "" not in at else f"(?:{'|'.join(parts)}){'?' if '' in at else ''}"

    return told(tree)


def whole_words(words: Iterable[str], literal: bool = True) -> str:
    """A pattern for any of ``words`` as whole words, longest first."""
    return f"(?iu)(?<!{_WORD})(?:{any_of(words) if literal else '|'.join(words)})(?!{_WORD})"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rint(value: Column, places: int = 0) -> Column:
    """Half-even rounding of the scaled value."""
    return F.rint(value * 10**places) / 10**places


def rewritten(text: Column) -> Column:
    for pattern, to in L.REWRITES:
        text = F.regexp_replace(text, pattern, to)
    return text


def lexicon_score(text: Column, valence: dict[str, float] | None = None) -> Column:
    """Sum of the words' valences, brought to -1..1 by x / sqrt(x^2 + 15), to 4 places.

    Words are runs of a-z and Devanagari signs; only those that have a valence are looked up.
    """
    known = valence or L.VALENCE
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    words = F.regexp_extract_all(F.lower(text), F.lit(f"(?<![a-z\\u0900-\\u097F]){any_of(known)}(?![a-z\\u0900-\\u097F])"), F.lit(0))
    found = F.transform(words, lambda w: F.element_at(table, w))
    total = F.aggregate(found, F.lit(0.0), lambda s, v: s + v)
    return let(total, lambda s: F.floor(s / F.sqrt(s * s + 15) * 10000 + 0.5) / 10000)


def sentiment_label(score: Column) -> Column:
    return F.when(score >= 0.05, "Positive").when(score <= -0.05, "Negative").otherwise("Neutral")


def language(text: Column) -> Column:
    """Hindi by script; Hinglish by marker words, counted with repeats; else English."""
    script, letters = F.regexp_count(text, F.lit("[\\u0900-\\u097F]")), F.regexp_count(text, F.lit("\\p{L}"))
    low, only = F.lower(text), lambda words: F.lit(f"(?<![a-z]){any_of(words)}(?![a-z])")
    strong = F.regexp_count(low, only([w for w in L.HINGLISH_MARKERS if w not in L.WEAK_MARKERS]))
    romanised = F.when((strong >= 2) | ((strong >= 1) & ((F.regexp_count(low, only(L.HINGLISH_MARKERS)) >= 2) | (F.regexp_count(low, F.lit("[a-z]+")) <= 5))), "Hinglish").otherwise("English")
    return F.when((letters > 0) & (script > 0.3 * letters), "Hindi").otherwise(romanised)


def clauses(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, L.CLAUSE_SPLIT), lambda c: F.btrim(c, F.lit(" ,-"))), lambda c: c != "")


def has_theme(theme: str, text: Column) -> Column:
    spec = L.THEMES[theme]
    if "exclude" in spec:
        text = F.regexp_replace(text, whole_words(spec["exclude"]), " ")
    return text.rlike(whole_words(spec["keywords"] + spec["complaint"]))


def themes_of(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(has_theme(t, text), F.lit(t)) for t in L.THEMES]))


def theme_bits() -> dict[str, int]:
    """What each theme word or excluded phrase says: bit k for a word of theme k, bit 16 + k for a complaint of it.

    A phrase says what the words within it say, except to the themes that exclude it.
    """
    specs = list(L.THEMES.values())
    said = {w.lower(): 0 for spec in specs for part in spec.values() for w in part}
    within = lambda word, phrase: f" {word} " in f" {phrase} "
    for phrase in said:
        for k, spec in enumerate(specs):
            complaint = any(within(w.lower(), phrase) for w in spec["complaint"])
            left = re.sub("|".join(rf"(?<!\S){re.escape(x.lower())}(?!\S)" for x in spec["exclude"]), " ", phrase) if "exclude" in spec else phrase
            if any(within(w.lower(), left) for w in spec["keywords"] + spec["complaint"]):
                said[phrase] |= 1 << k
            if complaint:
                said[phrase] |= 1 << 16 + k
    return said


def theme_mask(text: Column) -> Column:
    """The bits of ``theme_bits`` that a text's words say together, in one pass over it."""
    bits = theme_bits()
    table = F.create_map(*[F.lit(x) for pair in bits.items() for x in pair])
    words = F.regexp_extract_all(F.lower(text), F.lit(whole_words(bits).removeprefix("(?iu)")), F.lit(0))
    return F.aggregate(words, F.lit(0), lambda mask, w: mask.bitwiseOR(F.coalesce(F.element_at(table, w), F.lit(0))))


def polarity(complains: Column, score: Column, rating: Column) -> Column:
    """``complains``: whether complaint words are anywhere in the clause, excluded phrases too."""
    return (
        F.when(complains, "complaint")
        .when(score <= -0.05, "complaint")
        .when(score >= 0.05, "praise")
        .when(rating <= 2, "complaint")
        .when(rating >= 4, "praise")
        .otherwise("neutral")
    )


def emotion_hits(name: str, text: Column) -> Column:
    """Matches of an emotion's words; for positive ones, without those within reach of a negation.

    A negation reaches a word if it starts at most 20 characters before it with at most one word between,
    which a bounded look-behind states.
    """
    pattern = whole_words(L.EMOTIONS[name], literal=False).removeprefix("(?iu)")  # lower-case text is matched as it is, which is far cheaper
    if name in L.POSITIVE_EMOTIONS:
        behind = r"(?<!(?:\bnot|\bno|\bnever|n't|\bnahi|\bnahin|नहीं)\s{1,4}(?:\w{1,13}\s{1,2})?)"
        pattern = f"(?={pattern}){behind}{pattern}"  # looks behind only where a word stands
    return F.regexp_count(F.lower(text), F.lit(pattern))


def emotion(text: Column) -> Column:
    """The emotion with most hits, the earlier one on ties."""
    names = list(L.EMOTIONS)
    counted = F.array(*[F.struct(emotion_hits(n, text).alias("hits"), F.lit(-k).alias("turn"), F.lit(n).alias("name")) for k, n in enumerate(names)])
    return let(F.array_max(counted), lambda best: F.when(best["hits"] > 0, best["name"]).otherwise(L.NO_EMOTION))


def emotion_label(name: Column) -> Column:
    out = name
    for k, sign in L.EMOTION_SIGNS.items():
        out = F.when(name == k, f"{sign} {k}").otherwise(out)
    return out


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("\\S+"))


def is_promo(text: Column) -> Column:
    return text.rlike(L.PROMO)


def is_mixed(text: Column) -> Column:
    return text.rlike(L.CONTRAST)


def is_shouting(text: Column) -> Column:
    letters, capitals = F.regexp_count(text, F.lit("[A-Za-z]")), F.regexp_count(text, F.lit("[A-Z]"))
    return text.rlike("!{3,}") | ((letters >= 10) & (capitals > 0.6 * letters))


def requests(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "(?<=[.!?।])\\s+"), lambda s: F.trim(s)), lambda s: (s != "") & s.rlike(L.REQUEST))


def request_key(text: Column) -> Column:
    out = F.lower(text)
    for pattern, to in L.REQUEST_SYNONYMS:
        out = F.regexp_replace(out, pattern, to)
    return F.regexp_replace(out, "[^\\p{L}\\p{N}_\\s]", " ")


def similarity_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}_\\s\\u0900-\\u097F]", " "), "\\s+", " "))


def cloud_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z\\u0900-\\u097F][a-z'\\u0900-\\u097F]{2,}"), F.lit(0))

"""Rule-based valence scoring with word order, after the published VADER heuristics, as an Arrow function."""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from opinara.functions import lexicon as L
from opinara.functions.text import rewritten

_CAPS, _FLIP, _NEAR = 0.733, -0.74, (1.0, 0.95, 0.9)


def _tokens(text: str) -> list[str]:
    out = []
    for raw in text.split():
        bare = raw.strip(string.punctuation)
        out.append(raw if len(bare) <= 2 else bare)
    return out


def _is_negation(word: str, negations: frozenset[str]) -> bool:
    return word in negations or "n't" in word


def _word_valence(at: int, tokens: list[str], lower: list[str], some_caps: bool, valence, boosters, negations) -> float:
    v = valence[lower[at]]
    if some_caps and tokens[at].isupper():
        v += math.copysign(_CAPS, v)
    for distance in (1, 2, 3):
        k = at - distance
        if k < 0 or lower[k] in valence:
            continue
        boost = boosters.get(lower[k], 0.0)
        if boost:
            if some_caps and tokens[k].isupper():
                boost += math.copysign(_CAPS, boost)
            v += math.copysign(1, v) * boost * _NEAR[distance - 1]
        if _is_negation(lower[k], negations):
            v *= _FLIP
    return v


def compound(text: str | None, valence=None, boosters=None, negations=None) -> float:
    """-1..1 for one text whose rewrites are done; 0 for null or empty texts."""
    valence, boosters, negations = valence or L.VALENCE, boosters or L.BOOSTERS, negations or frozenset(L.NEGATIONS)
    tokens = _tokens(text or "")
    if not tokens:
        return 0.0
    lower = [t.lower() for t in tokens]
    shouted = sum(t.isupper() for t in tokens)
    some_caps = 0 < shouted < len(tokens)
    scores = [0.0 if w in boosters or w not in valence else _word_valence(i, tokens, lower, some_caps, valence, boosters, negations) for i, w in enumerate(lower)]
    if "but" in lower:
        turn = lower.index("but")
        scores = [s * (0.5 if i < turn else 1.5 if i > turn else 1.0) for i, s in enumerate(scores)]
    total = sum(scores)
    if total:
        asked = text.count("?")
        total += math.copysign(0.292 * min(text.count("!"), 4) + (0.0 if asked < 2 else 0.18 * asked if asked <= 3 else 0.96), total)
    return round(max(-1.0, min(1.0, total / math.sqrt(total * total + 15))), 4)


def valence_score(text: Column, valence: dict[str, float] | None = None) -> Column:
    """``compound`` over a column; the rewrites run in the JVM."""

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: compound(t, valence))

    return scored(rewritten(F.coalesce(text, F.lit(""))))


def valence_scores(texts: Column, valence: dict[str, float] | None = None) -> Column:
    """``compound`` of each text of an array."""

    @F.pandas_udf("array<double>")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda row: [compound(t, valence) for t in row])

    return scored(F.transform(texts, rewritten))


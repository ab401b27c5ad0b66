"""Every query with a SQL twin gives the twin's rows on the smallest tables, and some rows."""

from __future__ import annotations

import math
import re
import string

import duckdb
import pandas as pd
import pytest

from opinara.functions import lexicon as L
from opinara.plans import registry
from opinara.sources.reviews import order_reviews

TABLES = "orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def cell(v) -> str:
    if hasattr(v, "__len__") and not isinstance(v, str):
        return str(list(v))
    if pd.isna(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    return f"{v:.6g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, sf, duck, name):
    ours, theirs = registry.QUERIES[name](spark, sf).toPandas(), duck.execute(registry.ORACLES[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_every_other_query_has_a_test_of_its_own():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"vader_sentiment"}


def test_vader_sentiment_by_plain_python(spark, sf):
    """The whole query against scores worked out here, word by word."""
    texts = {r["review_id"]: r["review_text"] for r in order_reviews(spark, sf).collect()}

    def score(text: str) -> float:
        for pattern, to in L.REWRITES:
            text = re.sub(pattern.replace("(?iu)", "(?i)"), to.replace("$1", r"\1"), text)
        words = [w if len(w.strip(string.punctuation)) <= 2 else w.strip(string.punctuation) for w in text.split()]
        low, shouts = [w.lower() for w in words], sum(w.isupper() for w in words)
        mixed, total = 0 < shouts < len(words), []
        for i, w in enumerate(low):
            v = 0.0 if w in L.BOOSTERS else L.VALENCE.get(w, 0.0)
            if v:
                v += math.copysign(0.733, v) if mixed and words[i].isupper() else 0
                for d, fade in ((1, 1.0), (2, 0.95), (3, 0.9)):
                    if i >= d and low[i - d] not in L.VALENCE:
                        boost = L.BOOSTERS.get(low[i - d], 0.0)
                        if boost:
                            boost += math.copysign(0.733, boost) if mixed and words[i - d].isupper() else 0
                            v += math.copysign(boost * fade, boost * v)
                        if low[i - d] in L.NEGATIONS or "n't" in low[i - d]:
                            v *= -0.74
            total.append(v)
        if "but" in low:
            at = low.index("but")
            total = [v * (0.5 if i < at else 1.5 if i > at else 1) for i, v in enumerate(total)]
        s = sum(total)
        asked = text.count("?")
        s += math.copysign(0.292 * min(4, text.count("!")) + (0.18 * asked if 2 <= asked <= 3 else 0.96 if asked > 3 else 0), s) if s else 0
        return round(s / math.sqrt(s * s + 15), 4)

    got = {r["review_id"]: r for r in registry.QUERIES["vader_sentiment"](spark, sf).collect()}
    assert set(got) == set(texts)
    known = {t: score(t) for t in set(texts.values())}
    wrong = [(t, got[i]["sentiment_score"], known[t]) for i, t in texts.items() if abs(got[i]["sentiment_score"] - known[t]) > 1e-9]
    assert wrong == []
    assert all(r["sentiment"] == ("Positive" if r["sentiment_score"] >= 0.05 else "Negative" if r["sentiment_score"] <= -0.05 else "Neutral") for r in got.values())

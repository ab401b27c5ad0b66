from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from opinara.llm import mixing, piece_sampling, registry


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 3)), max_size=5, unique_by=lambda x: x[0]), st.integers(0, 120))
def test_knapsack_is_exact(classes, budget):
    sizes, counts = [s for s, _ in classes], [c for _, c in classes]
    taken = mixing.knapsack(sizes, counts, budget)
    best = min((sum(a * b for a, b in zip(c, sizes)) for c in itertools.product(*(range(n + 1) for n in counts))), key=lambda v: (abs(v - budget), v))
    assert sum(a * b for a, b in zip(taken, sizes)) == best and all(0 <= t <= c for t, c in zip(taken, counts))


def brute_targets(sizes: dict) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, capped = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, set()
    while True:
        left, total = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        aim = {s: 2 * sizes[s] if s in capped else left * weight[s] / total for s in names}
        over = {s for s in names if s not in capped and aim[s] > 2 * sizes[s]}
        if not over:
            return aim
        capped |= over


def test_mix_meets_targets(spark, sf, documents):
    got = registry.op9_mixing(spark, sf).join(documents.select("doc_id", "source"), "doc_id").toPandas()
    sizes = got.groupby("source")["size"].sum().to_dict()
    aims, taken = brute_targets(sizes), got.groupby("source")["taken"].sum()
    for s, t in got.groupby("source")["target"].first().items():
        own = got[got["source"] == s]["size"].tolist()
        sums = {0}
        for v in own:
            sums |= {x + v for x in sums}
        whole = min(int(t // sum(own)), 2) * sum(own)
        nearest = min(abs(whole + x - t) for x in sums) if whole < 2 * sum(own) else abs(whole - t)
        assert math.isclose(t, aims[s], rel_tol=1e-9) and abs(taken[s] - t) <= nearest + 1
    assert (got["taken"] <= 2 * got["size"]).all() and math.isclose(sum(aims.values()), 1.5 * got["size"].sum())
    again = registry.op9_mixing(spark, sf).toPandas().sort_values("doc_id")["taken"].tolist()
    assert again == got.sort_values("doc_id")["taken"].tolist()
    assert mixing.mixed(documents).count() == int((got["taken"] // got["size"].where(got["size"] > 0, 1)).sum())


def test_mix_odd_rows(odd):
    rows = mixing.mix_report(odd).collect()
    assert len(rows) == odd.count() and all(r["taken"] <= 2 * r["size"] for r in rows)
    out = mixing.mixed(odd.drop("__text"))
    assert out.columns == odd.drop("__text").columns
    assert mixing.mix_report(odd.where("false")).count() == 0 and mixing.mixed(odd.where("false")).count() == 0


def test_hot_class_is_binned(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BIN", 10)
    df = spark.range(500).selectExpr("id AS doc_id", "'one two three' AS text", "if(id < 300, 'a', 'b') AS source")
    rows = mixing.mix(df).toPandas()
    for s, part in rows.groupby("source"):
        assert abs((part["size"] * part["copies"]).sum() - part["target"].iloc[0]) <= 3


@pytest.fixture(scope="module")
def pieces():
    with open(piece_sampling.VOCABULARY, "rb") as f:
        return piece_sampling.Pieces(f.read())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=5))
def test_lossless(pieces, texts):
    ids, sizes = piece_sampling.encode(pieces, list(range(len(texts))), texts)
    ends = np.cumsum(sizes)
    assert [piece_sampling.decode(pieces, ids[e - n : e].tolist()) for e, n in zip(ends, sizes)] == texts


@pytest.mark.parametrize("text", ["  two  spaces ", "▁ mark ▁▁x", "<s></s><0x41>", "漢字 😀\x00", "a" * 3000, "the " * 2000])
def test_hard_texts(pieces, text):
    ids, _ = piece_sampling.encode(pieces, [3], [text])
    assert piece_sampling.decode(pieces, ids.tolist()) == text


def test_draws_follow_the_lattice(pieces):
    word, found = "thes", {}

    def walk(rest, ids, weight):
        if not rest:
            found[tuple(ids)] = math.exp(weight)
        for k in range(1, len(rest) + 1):
            for i in [i for i, b in enumerate(pieces.bytes) if b == rest[:k].encode() and np.isfinite(pieces.log_weight[i])]:
                walk(rest[k:], [*ids, i], weight + pieces.log_weight[i])

    walk(f" {word}", [], 0.0)
    n = 20_000
    ids, sizes = piece_sampling.encode(pieces, list(range(n)), [word] * n)
    ends = np.cumsum(sizes)
    seen = Counter(tuple(ids[e - k : e].tolist()) for e, k in zip(ends, sizes))
    total = sum(found.values())
    assert set(seen) <= set(found) and len(seen) > 2
    assert all(abs(seen[s] / n - p / total) < 0.015 for s, p in found.items())


def test_long_words_agree_with_short_ones(pieces, monkeypatch):
    texts = ["withstanding interoperability", "unfathomable"]
    plain = piece_sampling.encode(pieces, [1, 2], texts)[0].tolist()
    monkeypatch.setattr(piece_sampling, "PLAIN", 0)
    assert piece_sampling.encode(pieces, [1, 2], texts)[0].tolist() == plain


def test_pieces_query(spark, sf, documents, odd):
    rows = registry.op10_piece_sampling(spark, sf)
    assert rows.where("NOT lossless").count() == 0 and rows.count() == documents.count()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert all(r["text"] == texts[r["doc_id"]] for r in piece_sampling.decoded(rows).collect())
    assert sorted(map(str, rows.collect())) == sorted(map(str, registry.op10_piece_sampling(spark, sf).repartition(3).collect()))
    got = piece_sampling.encode_sampled(odd).collect()
    assert len(got) == odd.count() and all(r["lossless"] for r in got)
    assert [r["ids"] for r in got if r["doc_id"] == 1] == [None] and [r["ids"] for r in got if r["doc_id"] == 2] == [[]]
    assert piece_sampling.encode_sampled(odd.where("false")).count() == 0

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from opinara.llm import registry, simhash
from opinara.llm.components import components


def brute_fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(rows: list[tuple[int, int]]) -> dict[int, int]:
    """Least id reachable, by comparing all fingerprints."""
    ids, fps = [i for i, _ in rows], np.array([f for _, f in rows], np.uint64)
    label = np.arange(len(rows))
    for i in range(len(rows)):
        near = np.nonzero(np.bitwise_count(fps ^ fps[i]) <= 2)[0]
        label[np.isin(label, label[near])] = label[i]
    return {i: min(j for j, other in zip(ids, label) if other == mine) for i, mine in zip(ids, label)}


def test_query_against_brute_force(spark, sf, documents):
    got = {r["doc_id"]: r for r in registry.op3_simhash(spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert set(got) == set(texts)
    for i in random.Random(0).sample(sorted(texts), 40):
        assert got[i]["fingerprint"] == f"{brute_fingerprint(texts[i]):016x}"
    want = brute_classes([(i, int(r["fingerprint"], 16)) for i, r in got.items()])
    assert {i: r["component_id"] for i, r in got.items()} == want


def near_pairs(texts: dict[int, str | None]) -> dict[tuple[int, int], float]:
    """Jaccard similarity over five-word shingles of all pairs of texts that share one."""
    sets, places = {}, {}
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {" ".join(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else {""}
        for s in sets[i]:
            places.setdefault(s, []).append(i)
    pairs = {(a, b) for found in places.values() for n, a in enumerate(found) for b in found[:n]}
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in pairs}


def test_similar_texts_link(documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    got = {r["doc_id"]: r["component_id"] for r in simhash.classes(documents, shingle=5, similarity=0.8).collect()}
    near = near_pairs(texts)
    assert [p for p, s in near.items() if s >= 0.8 and got[p[0]] != got[p[1]]] == []
    best = {}
    for (a, b), s in near.items():
        best[a], best[b] = max(best.get(a, 0), s), max(best.get(b, 0), s)
    members = [i for i, c in got.items() if sum(c == other for other in got.values()) > 1]
    assert members and all(best.get(i, 0) >= 0.78 for i in members)


def test_files_in_blocks(spark, monkeypatch):
    from opinara.llm import near_copies

    words = [f"w{i}" for i in range(300)]
    rows = [(k, " ".join([*words[: 2 * k], f"x{k}", *words[2 * k + 1 :]])) for k in range(60)] + [(90, " ".join(words[150:]))]
    monkeypatch.setattr(near_copies, "BLOCK", 8)
    got = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 90]


def test_rows_that_share_an_id(spark):
    one, two, three, four, five = (" ".join(f"{w}{i}" for i in range(40)) for w in "abcde")
    rows = [(1, one), (5, one), (5, two), (5, three), (5, three), (9, four), (None, one), (None, four), (None, five), (None, five)]
    got = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, [(r["doc_id"], r["text"]) for r in got])) == sorted(map(str, [(1, one), (5, two), (5, three), (9, four), (None, five)]))


@pytest.mark.parametrize("size", [100, 5000])
def test_sketch_similarity(size):
    from opinara.llm import near_copies

    rng = np.random.default_rng(size)
    both, one, two = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (size * 8 // 10, size // 10, size // 10))
    marks = [near_copies.sketch(np.concatenate([both, rest])) for rest in (one, two)]
    assert [m[0] for m in marks] == [len(both) + len(one)] * 2
    parts = [near_copies.least(*m[:2]) for m in marks]
    whole = size <= near_copies.SKETCH
    near, exact = near_copies.similarities(parts[0], whole, parts[1][None], np.array([len(parts[1])]), np.array([whole]))
    assert exact[0] == whole and near[0] == pytest.approx(0.8, abs=1e-9 if whole else 0.04)
    assert near_copies.whole_similarity(*(m[:2] for m in marks)) == pytest.approx(0.8, abs=1e-12)
    assert near_copies.near_forest([m[0] for m in marks], [m[1] for m in marks]) == [(0, 1)]


def test_long_texts_link_at_the_bound_and_not_below():
    from opinara.llm import near_copies

    rng = np.random.default_rng(1)
    for extra, links in ((0, 1), (1, 0)):  # 8000 of 10000 hashes shared, then of 10001
        both, one, two = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (8000, 1000, 1000 + extra))
        marks = [near_copies.sketch(np.concatenate([both, rest])) for rest in (one, two)]
        assert len(near_copies.near_forest([m[0] for m in marks], [m[1] for m in marks])) == links


@pytest.mark.parametrize("seed", range(4))
def test_blocks_miss_no_link(spark, monkeypatch, seed):
    """Sets that all share every key: links over blocks are those of comparing all pairs."""
    from opinara.llm import near_copies

    monkeypatch.setattr(near_copies, "BLOCK", 8)
    rng = np.random.default_rng(seed)
    sets = [np.arange(100, dtype=np.uint64) * np.uint64(2**33)]
    for _ in range(59):
        s = sets[rng.integers(len(sets)) if rng.random() < 0.8 else 0].copy()
        at = rng.choice(100, rng.integers(1, 25), replace=False)
        s[at] = rng.integers(0, 2**64, len(at), dtype=np.uint64)
        sets.append(s)
    rows = [(k, k, *near_copies.sketch(s)[:2], [1, 2]) for k, s in enumerate(sets)]
    texts = spark.createDataFrame(rows + rows[:5], "tid long, fp long, n long, sketch binary, bands array<long>")
    found = near_copies.near_links(texts, spark.createDataFrame([], "a long, b long"))
    ours = {r["node"]: r["component"] for r in components(found, "a", "b").collect()}
    label = list(range(60))
    for i in range(60):
        for j in range(i):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if len(a & b) >= 0.8 * len(a | b):
                label = [label[i] if x == label[j] else x for x in label]
    assert len({ours.get(i, i) for i in range(60)}) == len(set(label))
    assert all((ours.get(i, i) == ours.get(j, j)) == (label[i] == label[j]) for i in range(60) for j in range(i))


def test_odd_rows(odd):
    rows = simhash.simhash_classes(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["fingerprint"], r["component_id"]))
    assert by[1] == [("0" * 16, 1)] and by[2] == by[3] == by[1]
    assert len(by[5]) == 2 and by[5][0][1] == by[6][0][1] == 5 and {c for _, c in by[None]} == {1, 5}
    clashing = odd.withColumn("__row", F.lit("clash")).withColumn("__mark", F.lit("clash"))
    assert simhash.deduplicate(clashing).columns == clashing.columns


def test_empty(odd):
    assert simhash.simhash_classes(odd.where("false")).count() == 0


def test_fingerprint_chunks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(1000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text) == whole


@pytest.mark.parametrize("bits, count", [(10, 300), (16, 2000), (63, 500)])
def test_forest_keeps_every_connection(bits, count):
    rng = np.random.default_rng(bits)
    members = np.unique(np.uint64(0xABCDEF0123456789) ^ rng.integers(0, 2**bits, count, dtype=np.uint64))
    made = simhash.forest(members, simhash.pivots())
    assert all(np.bitwise_count(a ^ b) <= 2 for a, b in made)
    place = {int(m): i for i, m in enumerate(members)}
    ours, theirs = np.arange(len(members)), np.arange(len(members))
    for a, b in made.tolist():
        ours[ours == ours[place[b]]] = ours[place[a]]
    for i in range(len(members)):
        near = np.nonzero(np.bitwise_count(members ^ members[i]) <= 2)[0]
        theirs[np.isin(theirs, theirs[near])] = theirs[i]
    assert len(set(ours)) == len(set(theirs)) and len(made) == len(members) - len(set(ours))


def test_components_of_a_chain(spark):
    n = 200
    chain = spark.range(n - 1).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y")).unionAll(spark.createDataFrame([(1000, 1001)], "x long, y long"))
    got = {r["node"]: r["component"] for r in components(chain, "x", "y").collect()}
    assert {got[i] for i in range(n)} == {0} and got[1000] == got[1001] == 1000
    assert components(chain.where("false"), "x", "y").count() == 0

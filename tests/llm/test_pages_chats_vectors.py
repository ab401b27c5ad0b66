from __future__ import annotations

import gzip
import io
import math
import re
import zlib
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from opinara.llm import chat_format, cross_polytope, html_text, quality_model, registry, warc


# --- nearest neighbours ------------------------------------------------------------------------------
@pytest.mark.parametrize("size", ["0.001", "0.1"])
def test_recall_and_scores(spark, sf, size):
    sf = sf.replace("0.001", size)
    data = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.stack(data["embedding"].to_numpy()).astype(float), data["vec_id"].to_numpy()
    got = registry.op1_cross_polytope(spark, sf).toPandas()
    hits = total = 0
    for i in np.nonzero(ids % 20 == 0)[0]:
        score = x @ x[i]
        score[i] = -np.inf
        mine = got[got["query_id"] == ids[i]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and mine["score"].is_monotonic_decreasing
        assert np.allclose(mine["score"], [score[np.nonzero(ids == v)[0][0]] for v in mine["vec_id"]], atol=1e-12)
        hits += len(set(ids[np.lexsort((ids, -score))[:20]]) & set(mine["vec_id"]))
        total += 20
    assert hits / total >= 0.9


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [nan, 1.0]), (80, [1.0, None]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [-1.0, 1.0]), (4, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (5, []), (1, [2.0, 0.0]), (100, [float("inf"), 1.0])]
    df = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<double>, rank string, score double")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in cross_polytope.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 3, -1.0)]
    assert cross_polytope.search(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def recall(spark, x):
    """Of the 20 nearest to each vector whose id divides by 20, the share that a search finds."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in cross_polytope.search(df, F.col("vec_id") % 20 == 0).select("query_id", "vec_id").collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for i in range(0, len(x), 20):
        score = x @ x[i]
        score[i] = -np.inf
        hits += len(got.get(i, set()) & set(np.argsort(-score)[:20].tolist()))
    return hits / (20 * len(range(0, len(x), 20)))


def clustered(rows, clusters):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(clusters, 64))[rng.integers(0, clusters, rows)] + 0.5 * rng.normal(size=(rows, 64))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("longer", [2, 3])
def test_recall_with_long_vectors_outside_the_sample(spark, longer):
    x = clustered(12_000, 60)
    order = spark.range(len(x)).orderBy(F.xxhash64("id"), "id").toPandas()["id"].to_numpy()
    assert len(order) > cross_polytope.SAMPLE
    x[order[-5:]] *= longer
    assert recall(spark, x) >= 0.9


def test_a_tile_keeps_distinct_ids():
    rng = np.random.default_rng(0)
    c = rng.normal(size=(60, 8))
    ids, vectors = np.tile(np.arange(60), 4), np.tile(c, (4, 1))
    vectors[60:120] *= 0.5  # an id may have several vectors: the nearest counts
    tile = cross_polytope.Tile(ids, vectors, rng.integers(0, 32, (len(ids), 2)).astype(np.int32))
    _, found, scores = next(tile.ranked(np.array([100]), c[:1], np.zeros((2, 1, 32)), 0.0, 20))
    want = np.maximum(c @ c[0], 0.5 * (c @ c[0]))
    assert found.tolist() == np.argsort(-want)[:20].tolist() and np.allclose(scores, np.sort(want)[::-1][:20])


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_candidates_are_those_of_the_probed_buckets(depth):
    x = clustered(3000, 20)
    q = x[:50]
    code = cross_polytope.codes(cross_polytope.lifted(x, 1.0, False), 0, depth)
    cost = cross_polytope.costs(cross_polytope.lifted(q, 1.0, True), 0, depth)
    tile = cross_polytope.Tile(np.arange(len(x)), x, code)
    bound = 0.03 * depth
    of, at = tile.candidates(cost, bound)
    total = sum(cost[p][:, code[:, p]] for p in range(depth))
    assert sorted(zip(of.tolist(), tile.ids[at].tolist())) == sorted(zip(*(z.tolist() for z in np.nonzero(total <= bound))))


def test_nothing_but_candidates_is_ranked(spark, monkeypatch):
    x = clustered(2000, 20)
    x[-5:] *= 3
    largest, depth, bound = np.linalg.norm(x, axis=1).max(), 2, 0.035
    monkeypatch.setattr(cross_polytope, "TILE", 700)
    monkeypatch.setattr(cross_polytope, "LOT", 30)
    monkeypatch.setattr(cross_polytope, "bound_for", lambda *_: bound)
    monkeypatch.setattr(cross_polytope, "polytopes", lambda *_: depth)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in cross_polytope.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    asked = np.arange(0, len(x), 20)
    met, up, down = np.zeros((len(asked), len(x)), bool), cross_polytope.lifted(x[asked], largest, True), cross_polytope.lifted(x, largest, False)
    for t in range(cross_polytope.TABLES):
        cost, code = cross_polytope.costs(up, t, depth), cross_polytope.codes(down, t, depth)
        met |= sum(cost[p][:, code[:, p]] for p in range(depth)) <= bound
    met[np.arange(len(asked)), asked] = False
    assert 0.02 < met.mean() < 0.6
    for i, row in zip(asked.tolist(), met):
        found = np.nonzero(row)[0].tolist() if row.sum() >= 20 else [j for j in range(len(x)) if j != i]
        assert got[i] == sorted(found, key=lambda j: -(x[j] @ x[i]))[:20]


def test_copies_of_one_vector(spark, monkeypatch):
    x = np.concatenate([np.tile(clustered(1, 1), (700, 1)), clustered(1400, 30)])
    monkeypatch.setattr(cross_polytope, "TILE", 100)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = cross_polytope.search(df, F.col("vec_id") == 40).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(20))
    assert recall(spark, x[650:]) >= 0.9


def test_buckets_grow_with_the_table():
    assert [cross_polytope.polytopes(n, 64) for n in (0, 500, 2000, 10_000, 1_000_000, 10**9)] == [1, 1, 1, 2, 3, 4]


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(cross_polytope.turned(x, 1, 0), axis=1), np.linalg.norm(x, axis=1))


# --- archives ----------------------------------------------------------------------------------------
def test_archive_twin(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
    want = con.execute(registry.ORACLES["op2_warc"]).fetchall()
    got = [tuple(r) for r in registry.op2_warc(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.fixture
def pages(spark):
    big = "x" * 1200 + "é"
    rows = [(1, "http://a/ b\r\nc", big), (2, None, big), (3, "http://a", None), (4, "http://a", ""), (None, "http://a", big), (5, "u", "small"), (6, "u", "small"), (2, None, big), (7, "u", "y" * 3_000_000)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")


def test_odd_pages(spark, pages, tmp_path):
    warc.write_archives(pages, str(tmp_path / "w"))
    for split in (1 << 10, 8 << 20):
        rows = sorted(((r["key"] or 0, r["payload_bytes"], r["type"], r["refers_to"]) for r in warc.read_archives(spark, str(tmp_path / "w"), split).collect()), key=str)
        want = [(0, 1202, "revisit", 2), (1, 1202, "revisit", 2), (2, 1202, "response", None), (2, 1202, "response", None), (3, 0, "response", None), (4, 0, "response", None), (5, 5, "response", None), (6, 5, "response", None), (7, 3_000_000, "response", None)]
        assert rows == sorted(want, key=str)
    for part in (tmp_path / "w").glob("part-*"):  # other readers read them too
        assert gzip.decompress(part.read_bytes()).startswith(b"WARC/1.1\r\n")
    assert warc.archive_round_trip(pages.where("false")).count() == 0


def test_false_magic_is_passed_over():
    noise = b"\x1f\x8b\x08" + b"\x00" * 9
    one, two = warc.member(1, "u", noise * 50, "a" * 40, None, False), warc.member(2, "u", b"second", "b" * 40, None, False)
    data = noise + one + b"\0\0" + noise + gzip.compress(b"no archive record") + two
    found = [(o, f["x-key"]) for o, f, _ in warc.records(io.BytesIO(data), 0, len(data), len(data))]
    assert [k for _, k in found] == ["1", "2"]
    for cut in range(0, len(data), 37):  # a record is owned by the range it starts in
        parts = [k for a, b in ((0, cut), (cut, len(data))) for _, f, _ in warc.records(io.BytesIO(data), a, b, len(data)) for k in [f["x-key"]]]
        assert parts == ["1", "2"]


def test_unknown_stores_are_read_by_spark(spark, pages, tmp_path, monkeypatch):
    warc.write_archives(pages, str(tmp_path / "w"))
    want = sorted(map(str, warc.read_archives(spark, str(tmp_path / "w")).drop("path").collect()))
    monkeypatch.setattr(warc, "_known", lambda name: False)
    assert sorted(map(str, warc.read_archives(spark, str(tmp_path / "w")).drop("path").collect())) == want
    monkeypatch.undo()
    assert not warc._known("viewfs://store/x") and warc._known("file:///x")


def test_files_follow_the_payload_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 100_000)
    rows = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, F.repeat(F.lit("same "), 1000)).otherwise(F.repeat(F.concat(F.lit("p"), "id"), 1000)).alias("html"))
    warc.write_archives(rows.coalesce(1), str(tmp_path / "w"))
    sizes = [r["n"] for r in warc.read_archives(spark, str(tmp_path / "w")).groupBy("path").agg(F.sum("payload_bytes").alias("n")).collect()]
    assert len(sizes) > 10 and max(sizes) < 8 * 100_000


def test_long_urls_are_read_back():
    url = "data:" + np.random.default_rng(0).bytes(200_000).hex()
    data = warc.member(1, url, b"one", "a" * 40, None, False) + warc.member(2, "u", b"two", "b" * 40, None, False)
    assert [(f["x-key"], f["warc-target-uri"]) for _, f, _ in warc.records(io.BytesIO(data), 0, len(data), len(data))] == [("1", url), ("2", "u")]


# --- pages as text -----------------------------------------------------------------------------------
class Shown(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def test_all_visible_text(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in registry.op7_html_text(spark, sf).collect():
        other = Shown()
        other.feed(pages[r["page_id"]])
        other.close()
        plain = re.sub(r"(?m)^\s*(\* |\d+\. )", "", r["text"])
        assert "".join(plain.split()) == "".join("".join(other.out).split())


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>One <b>two</b>\n three<p>Next", "One two three\n\nNext"), ("a<br>b", "a\nb"), ("<ul><li>a<li>b<ol start=3><li>x</ol></ul>c", "* a\n* b\n  3. x\n\nc"),
        ("<table><tr><th>Name<th>Qty<tr><td>apple<td>3<tr><td>long banana<td>12</table>", "Name         Qty\napple        3\nlong banana  12"),
        ("<div hidden>x</div><div style='color:red;display: none'>y</div>z", "z"), ("<pre>  a\n   b</pre>", "  a\n   b"), ("<script>var a='<p>';</script>t", "t"), ("a &lt; b &amp; c", "a < b & c"),
        ("a < b", "a < b"), ("", ""), (None, None), ("<!-- x --><title>no</title>yes", "yes"), ("<td>loose</td>", "loose"), ("<p>x</div></span></p>y", "x\n\ny"), ("<select><option>a<option>b</select>", "a\nb"),
        ("<table><tr><td>q<td><table><tr><td>in1<td>in2</table></table>", "q  in1  in2"), ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_layout(html, want):
    assert html_text.to_text(html) == want


def test_deep_pages_take_memory_in_proportion():
    import tracemalloc

    tracemalloc.start()
    for tag in ("blockquote", "dd", "ul><li"):
        text = html_text.to_text(f"<{tag}>" * 100_000 + "deep")
        assert text.strip(" *") == "deep" and len(text) <= html_text.DEEPEST + 6
    assert tracemalloc.get_traced_memory()[1] < 500 << 20
    tracemalloc.stop()
    assert html_text.to_text("<dl><dd>a<blockquote>b<ul><li>c") == "    a\n\n        b\n\n        * c"


def test_odd_html(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (None, "<p>a", "z"), (2, "<p>" + "word " * 100_000, "w")], "page_id long, html string, text string")
    rows = {(r["page_id"], r["text"] if r["text"] is None else len(r["text"])) for r in html_text.extract(df).collect()}
    assert rows == {(1, None), (1, 0), (None, 1), (2, 499_999)} and html_text.extract(df.where("false")).count() == 0


# --- transcripts -------------------------------------------------------------------------------------
def test_roles_are_recovered(spark, sf):
    rows = registry.op4_chat_format(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count()
    assert sum(r["recovered"] for r in rows) / len(rows) > 0.7 and sum(r["lines_right"] for r in rows) / len(rows) > 0.9
    said = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn", "text").collect():
        said.setdefault(r["conv_id"], []).append((r["role"], (r["text"] or "").strip()))
    for r in rows:  # where roles are right, the rendering holds every turn as it was said
        if r["recovered"]:
            back = re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", r["chat"], re.S)
            assert [(a, " ".join(b.split())) for a, b in back] == [(a if a in chat_format.ROLES else "user", " ".join(b.split())) for a, b in said[r["conv_id"]]]


def test_unseen_markers_score_per_line(spark, sf, monkeypatch):
    turns = spark.read.parquet(f"{sf}/conversations.parquet".replace("0.001", "0.1")).where("conv_id < 400")
    model = chat_format.train(chat_format.transcripts(turns.where("conv_id % 2 = 0")))
    monkeypatch.setattr(chat_format, "STYLES", (("Zork: ", "Quux: ", "Blip: "), ("<hub> ", "<rover> ", "<tower> ")))
    fresh = chat_format.parse_transcripts(chat_format.transcripts(turns.where("conv_id % 2 = 1")), model)
    right = total = 0
    for r in fresh.select("path", "states").collect():
        right += sum(a // 2 == b // 2 for a, b in zip(r["path"], r["states"]))
        total += len(r["states"])
    print(right / total)
    assert right / total > 0.85


def test_a_long_conversation_is_one(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn number {k}{'?' if k % 2 == 0 else ''}") for k in range(600)] + [(2, 0, "user", f"same {k}") for k in range(600)]
    out = {r["conv_id"]: r for r in chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).collect()}
    assert set(out) == {1, 2} and out[1]["chat"].count("turn number") == 600 and out[2]["chat"].count("same") == 600
    assert [int(n) for n in re.findall(r"turn number (\d+)", out[1]["chat"])] == list(range(600))


@pytest.fixture(scope="module")
def model(spark, sf):
    return chat_format.train(chat_format.transcripts(spark.read.parquet(f"{sf}/conversations.parquet")))


def brute_path(model, seen):
    import itertools

    best = max(itertools.product(range(len(chat_format.STATES)), repeat=len(seen)), key=lambda p: model.start[p[0]] + sum(model.step[a, b] for a, b in zip(p, p[1:])) + sum(t[s, v] for s, row in zip(p, seen) for t, v in zip(model.shows, row)))
    return list(best)


@pytest.mark.parametrize("text", ["User: hi?\nAssistant: yes, there", "Human: a\nb\nAI: c", "no marker at all\nsecond line?", "Q: one\n\nA: two"])
def test_viterbi_is_exact(model, text):
    seen = chat_format.features(text.split("\n"))
    assert model.roles(seen) == brute_path(model, seen)


def test_rendering(model):
    assert chat_format.turns(model, None) == [] and chat_format.turns(model, "") == [] and chat_format.rendered([]) == ""
    found = chat_format.turns(model, "User: hello\nAssistant: hi <|im_end|>")
    assert found == [("user", "hello"), ("assistant", "hi <|im_end|>")] and chat_format.rendered(found).count("<|im_end|>") == 2


def test_odd_turns(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, None, None), (None, None, "user", "x"), (2, 0, "other", ""), (3, 300, "assistant", "late"), (3, 0, "user", "early")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, roles string")
    out = chat_format.format_conversations(df).collect()
    assert sorted(str(r["conv_id"]) for r in out) == ["1", "2", "3", "None"]
    assert chat_format.format_conversations(df.where("false")).count() == 0


# --- quality model -----------------------------------------------------------------------------------
def test_held_out_quality(spark, sf):
    sf = sf.replace("0.001", "0.01")
    got = registry.op8_quality_model(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((got["score"] >= 0.3) == (got["quality"] == 1)).mean() > 0.95 and got["score"].between(0, 1).all()


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 8)] + [(None, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_model.classify(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert quality_model.classify(odd.where("false"), labels).count() == 0
    assert {round(r["score"], 6) for r in quality_model.classify(odd, labels.where("false")).collect()} == {0.5}


def test_scores_against_plain_python(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality_model.train(documents, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r["doc_id"]: r for r in quality_model.score(documents, model).collect()}
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    table, sizes = model.table.astype(float).tolist(), range(model.table.shape[1])
    for i in sorted(texts)[::20]:
        rows, before = [], None
        for token in re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+|\n+", texts[i] or ""):
            shape = "mark" if not token[0].isalpha() else "lower" if token.islower() else "upper" if token.isupper() else "title" if token.istitle() else "mixed"
            bucket = xxhash.xxh32_intdigest(token.lower() if token[0].isalpha() else token[:3]) % quality_model.BUCKETS
            rows += [bucket, quality_model.BUCKETS + quality_model.SHAPES.index("again" if bucket == before else shape)]
            before = bucket
        pool = [sum(table[r][k] for r in rows) / max(len(rows) // 2, 1) for k in sizes]
        hidden = [math.tanh(sum((pool[k] - model.centre[k]) / model.scale[k] * model.w1[k][h] for k in sizes) + model.b1[h]) for h in range(quality_model.HIDDEN)]
        logit = (sum(h * w for h, w in zip(hidden, model.w2)) + model.b2) / model.temperature
        want = 1 / (1 + math.exp(-max(-50.0, min(50.0, logit))))
        assert got[i]["score"] == pytest.approx(want, abs=2e-4) and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_temperature_scales():
    rng = np.random.default_rng(0)
    logits = rng.normal(0, 1, 4000)
    labels = (rng.random(4000) < 1 / (1 + np.exp(-logits))).astype(int)
    assert 2.3 < quality_model.temperature(logits * 3, labels) < 3.8

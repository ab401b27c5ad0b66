"""Cosine neighbours over whole TF-IDF vectors, without a row for each posting.

1. A text is its words' XXH64 hashes; neighbouring texts lie in chunks, as one vocabulary and places in it. A term
   is a hash of 64 bits over one word or two.
2. Each chunk sends its distinct terms, once each, to BUCKET_TERMS-sized ranges of the hashes; a range returns to
   each chunk the terms' numbers and document frequencies. Hashes go as differences and answers in their order.
3. A text's shared terms are ordered from rare to common; r(t) is the length of what is left from t on. What two
   texts share after a term t is at most r(t) times r(t) of the other. So if they reach the threshold, the terms they
   share where that product is at least threshold - slack make up a part of ``slack`` or more of their product.
   A chunk sends only terms whose own r is that large; a range adds up the parts of all pairs there.
4. Of k ranges, the sums below slack / 2k are not sent. A pair whose sums, and slack / 2k for each range that sent
   none, stay below ``slack`` can't reach the threshold. All bounds are rounded up: no pair is lost.
5. Pairs left are worked out in double precision on their whole vectors, in blocks of texts. A block gives each
   text's best partner only, so a large group of near copies costs multiplications and no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.storage import dropped, stored

#: Words and texts of a chunk; a longer text is a chunk by itself.
CHUNK_WORDS, CHUNK_TEXTS = 1_000_000, 1 << 20
#: Terms, repeats included, for which there is one range of hashes, and the least number of ranges.
BUCKET_TERMS, LEAST_BUCKETS = 8_000_000, 8
#: Texts of a group; two groups make a block.
GROUP = 4_000
#: Share of the threshold by which shared rare terms must be seen.
SLACK = 0.1
#: Pairs that are held before they are added up.
HELD = 1_000_000
#: Bits of a text's place in its chunk, and of a term's number in its range.
_POS, _NUMBER = 22, 40
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]
#: Up to so many terms, repeats included, 56 bits of a hash tell them apart; else all 64 go.
FEW_TERMS = 1 << 31
#: Weights go in a byte, as steps of a logarithmic scale from the least weight.
_LEAST_WEIGHT = 1e-5
_WEIGHT_STEP = -math.log(_LEAST_WEIGHT) / 255


def pack(values: np.ndarray) -> bytes:
    """Compressed, the bytes of equal weight together."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def unpack(data: bytes, kind: type) -> np.ndarray:
    size, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = pa.Codec("zstd").decompress(data[8:], size, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, size // width).T).view(kind).ravel()


def steps(ascending: np.ndarray, kind: type) -> bytes:
    return pack(np.diff(ascending, prepend=ascending.dtype.type(0)).astype(kind))


def climbed(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(unpack(data, kind), dtype=np.uint64)


def runs(ascending: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    if not len(ascending):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(ascending[1:] != ascending[:-1]) + 1, [len(ascending)]])


def term_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = first * _ODD[0] + _ODD[2]
    x = (x ^ (x >> np.uint64(32))) * _ODD[1] + second * _ODD[2]
    x = (x ^ (x >> np.uint64(29))) * _ODD[0]
    return x ^ (x >> np.uint64(32))


def rests_up(rest: np.ndarray, bar: float) -> np.ndarray:
    """Lengths from ``bar`` to 1 as bytes, rounded up."""
    return np.clip(np.ceil((rest - bar) / (1 - bar) * 255 + 1e-6), 0, 255).astype(np.uint8)


def weights_up(w: np.ndarray) -> np.ndarray:
    """Weights as bytes, rounded up."""
    return np.clip(np.ceil(np.log(w / _LEAST_WEIGHT) / _WEIGHT_STEP + 1e-6), 0, 255).astype(np.uint8)


def postings(sizes: np.ndarray, vocabulary: np.ndarray, words: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    """The chunk's distinct term hashes, ascending; and of each text's distinct terms the place there, the text and tf."""
    docs, v, n = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), len(vocabulary) + 1, len(sizes)
    first = words.astype(np.int64) + 1
    same = docs[1:] == docs[:-1]
    key = np.concatenate([first * v * n + docs, ((first[:-1] * v + first[1:]) * n + docs[1:])[same]])
    del docs, first, same
    key.sort()
    bounds = runs(key)
    tf = np.diff(bounds).astype(np.int32)
    key = key[bounds[:-1]]
    del bounds
    code = key // n
    doc = (key - code * n).astype(np.int32)
    del key
    starts = runs(code)
    a, b = np.divmod(code[starts[:-1]], v)
    del code
    hashes = term_hashes(vocabulary[a - 1], np.where(b > 0, vocabulary[b - 1] | np.uint64(1), np.uint64(0))) >> np.uint64(64 - bits)
    order = np.argsort(hashes)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return hashes[order], np.repeat(place, np.diff(starts)), doc, tf


def edges(hashes: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each range of hashes begins, and the end."""
    inner = np.array([-(-(k << bits) // buckets) for k in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, inner), [len(hashes)]])


def table(columns: list, names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of each run of equal first columns."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != key:
                if held:
                    yield key, held
                key, held = row[0], []
            held.append(row[1:])
    if held:
        yield key, held


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seq, held, size, id_kind = TaskContext.get().partitionId() << 16, [], 0, None

    def closed() -> pa.RecordBatch:
        vocabulary, words, times = np.unique(np.concatenate([w for _, w in held]), return_inverse=True, return_counts=True)
        order = np.lexsort((vocabulary, -np.floor(np.log2(times))))  # frequent ones first: small numbers compress
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        sizes = np.array([len(w) for _, w in held], np.uint32)
        digests = [hashlib.blake2b(w.tobytes(), digest_size=16).digest() if len(w) else None for _, w in held]
        row = [seq, [i for i, _ in held], digests, len(held), int(sizes.sum()), pack(sizes), steps(vocabulary[order], np.uint64), pack(place[words])]
        kinds = [pa.int64(), pa.list_(id_kind), pa.list_(pa.binary()), pa.int64(), pa.int64(), *[pa.binary()] * 3]
        return table([[x] for x in row], ["chunk", "ids", "digests", "texts", "terms", "sizes", "vocabulary", "words"], kinds)

    for batch in batches:
        id_kind = batch.schema.field(0).type
        lists = batch.column(1)
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        for i, low, high in zip(batch.column(0).to_pylist(), offsets[:-1], offsets[1:]):
            if held and (size + high - low > CHUNK_WORDS or len(held) == CHUNK_TEXTS):
                yield closed()
                seq, held, size = seq + 1, [], 0
            held.append((i, values[low:high].copy()))
            size += high - low
    if held:
        yield closed()


def _sent(buckets: int, bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, sizes, vocabulary, words in zip(*(c.to_pylist() for c in batch.columns)):
                hashes, place, _, _ = postings(unpack(sizes, np.uint32), climbed(vocabulary, np.uint64), unpack(words, np.uint32), bits)
                df, at = np.bincount(place, minlength=len(hashes)).astype(np.uint32), edges(hashes, buckets, bits)
                rows = [(k, chunk, steps(hashes[low:high], np.uint64), pack(df[low:high])) for k, (low, high) in enumerate(zip(at[:-1], at[1:])) if high > low]
                yield table(list(zip(*rows)) or [[]] * 4, ["bucket", "chunk", "hashes", "df"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()])

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, rows in grouped(batches):
        parts = [climbed(h, np.uint64) for _, h, _ in rows]
        _, number = np.unique(np.concatenate(parts), return_inverse=True)
        df = np.bincount(number, weights=np.concatenate([unpack(d, np.uint32) for _, _, d in rows])).astype(np.uint32)
        ends = np.cumsum([len(p) for p in parts])
        for (chunk, _, _), low, high in zip(rows, ends - [len(p) for p in parts], ends):
            mine = number[low:high].astype(np.uint64)
            yield table([[chunk], [bucket], [steps(mine, np.uint32)], [pack(df[number[low:high]])]], ["chunk", "bucket", "numbers", "df"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()])


def weighed(row: tuple, total: int, bits: int) -> tuple[np.ndarray, ...]:
    """Of the whole texts' terms: text, term number (range above, number below), tf, df and weight; and the lengths of the texts' vectors."""
    sizes, vocabulary, words, answers = row
    sizes = unpack(sizes, np.uint32)
    _, place, doc, tf = postings(sizes, climbed(vocabulary, np.uint64), unpack(words, np.uint32), bits)
    answers = sorted(answers or [], key=lambda a: a["bucket"])
    if not answers:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0),) + (np.zeros(len(sizes)),)
    number = np.concatenate([climbed(a["numbers"], np.uint32).astype(np.int64) + (a["bucket"] << _NUMBER) for a in answers])[place]
    df = np.concatenate([unpack(a["df"], np.uint32) for a in answers])[place]
    w = tf * (np.log((1 + total) / (1.0 + df)) + 1)
    return doc, number, tf, df, w, np.sqrt(np.bincount(doc, w * w, len(sizes)))


def _rare(total: int, bits: int, bar: float) -> Callable:
    """Rows (bucket, chunk, texts, numbers, rests, weights) of the terms that can be the first of a pair's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, members, *row in zip(*(c.to_pylist() for c in batch.columns)):
                doc, number, _, df, w, norm = weighed(tuple(row), total, bits)
                copies = np.zeros(len(norm), np.int64)
                for m in members or []:
                    copies[m["pos"]] = m["n"]
                kept = (copies[doc] > 0) & (df > copies[doc])
                doc, number, df, w = doc[kept], number[kept], df[kept], w[kept]
                w = w / norm[doc]
                order = np.lexsort((number, df, doc))
                doc, number, w = doc[order], number[order], w[order]
                left = np.cumsum((w * w)[::-1])[::-1]
                ends = runs(doc)
                after = np.append(left, 0)[ends[1:]]
                rest = np.sqrt(np.maximum(left - np.repeat(after, np.diff(ends)), 0)) + 1e-7
                kept = rest >= bar
                doc, number, w, rest = doc[kept], number[kept], w[kept], rest[kept]
                order = np.argsort(number, kind="stable")
                doc, number, w, rest = doc[order], number[order], w[order], rest[order]
                at, rows = runs(number >> _NUMBER), []
                for low, high in zip(at[:-1], at[1:]):
                    rows.append((int(number[low] >> _NUMBER), chunk, pack(doc[low:high].astype(np.uint32)), steps((number[low:high] & ((1 << _NUMBER) - 1)).astype(np.uint64), np.uint32), pack(rests_up(rest[low:high], bar)), pack(weights_up(w[low:high]))))
                yield table(list(zip(*rows)) or [[]] * 6, ["bucket", "chunk", "texts", "numbers", "rests", "weights"], [pa.int64(), pa.int64(), *[pa.binary()] * 4])

    return run


def pair_sums(number: np.ndarray, doc: np.ndarray, rest: np.ndarray, w: np.ndarray, docs: int, bar: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of texts (lesser * docs + greater) that share a number where the product of their rests reaches ``bar``, and the sums of their products."""
    order = np.lexsort((-rest, number))
    number, doc, rest, w = number[order], doc[order], rest[order], w[order]
    at = runs(number)
    length, start = np.diff(at), at[:-1]
    # from the largest rest down, a text meets those before it
    many = length > 1
    many[many] = rest[start[many]] * rest[start[many] + 1] >= bar
    place = np.arange(len(number)) - np.repeat(start, length)
    inside = np.repeat(many, length) & (place > 0)
    inside[inside] = rest[inside] * np.repeat(rest[start], length)[inside] >= bar
    later, ahead = np.flatnonzero(inside), place[inside]
    codes, sums = np.zeros(0, np.int64), np.zeros(0, np.float32)
    del order
    ends = np.cumsum(ahead)
    low = 0
    while low < len(later):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + HELD, side="right")))
        n = ahead[low:high]
        b = np.repeat(later[low:high], n)
        a = b - np.repeat(n, n) + (np.arange(len(b)) - np.repeat(np.cumsum(n) - n, n))
        kept = rest[a] * rest[b] >= bar
        a, b = a[kept], b[kept]
        x, y = doc[a], doc[b]
        code = np.concatenate([codes, np.minimum(x, y) * np.int64(docs) + np.maximum(x, y)])
        part = np.concatenate([sums, w[a] * w[b]])
        del a, b, x, y, kept
        order = np.argsort(code)
        code, part = code[order], part[order]
        begin = runs(code)[:-1]
        codes, sums = code[begin], np.add.reduceat(part, begin) if len(part) else part
        low = high
    return codes, sums


def _met(bar: float, least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches):
            texts = [unpack(r[1], np.uint32) for r in rows]
            base = np.cumsum([0] + [int(t.max()) + 1 for t in texts])
            keys = np.concatenate([(np.int64(r[0]) << _POS) + np.arange(high - low) for r, low, high in zip(rows, base[:-1], base[1:])])
            number = np.concatenate([climbed(r[2], np.uint32).astype(np.uint32) for r in rows])
            steps_up = np.arange(256)
            rest = (bar + steps_up / 255 * (1 - bar)).astype(np.float32)[np.concatenate([unpack(r[3], np.uint8) for r in rows])]
            w = (_LEAST_WEIGHT * np.exp(steps_up * _WEIGHT_STEP)).astype(np.float32)[np.concatenate([unpack(r[4], np.uint8) for r in rows])]
            codes, sums = pair_sums(number, np.concatenate([t.astype(np.int32) + np.int32(b) for t, b in zip(texts, base)]), rest, w, len(keys), bar - 1e-6)
            kept = sums >= least
            x, y = np.divmod(codes[kept], len(keys))
            a, b = keys[x], keys[y]
            for low in range(0, len(a), 100_000):
                part = slice(low, low + 100_000)
                yield table([np.minimum(a, b)[part], np.maximum(a, b)[part], sums[kept][part].astype(np.float32)], ["a", "b", "s"], [pa.int64(), pa.int64(), pa.float32()])

    return run


def _vectors(total: int, bits: int) -> Callable:
    """The shared terms of the texts that blocks ask for, once for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_kind = None
        for batch in batches:
            id_kind = batch.schema.field(2).type.value_type
            for chunk, wanted, ids, *row in zip(*(c.to_pylist() for c in batch.columns)):
                doc, number, tf, df, w, norm = weighed(tuple(row), total, bits)
                asked = np.zeros(len(norm), bool)
                asked[[m["pos"] for m in wanted]] = True
                kept = asked[doc] & (df > 1)
                doc, number, tf, df = doc[kept], number[kept], tf[kept], df[kept]
                order = np.lexsort((number, doc))
                doc, number, tf, df = doc[order], number[order], tf[order], df[order]
                at, made, rows = runs(doc), {}, []
                for low, high in zip(at[:-1], at[1:]):
                    made[int(doc[low])] = (steps(number[low:high].astype(np.uint64), np.uint64), pack(tf[low:high].astype(np.uint32)), pack(df[low:high].astype(np.uint32)))
                for m in wanted:
                    rows.append((m["block"], 0, (chunk << _POS) + m["pos"], None, ids[m["pos"]], float(norm[m["pos"]]), *made[m["pos"]]))
                yield table(list(zip(*rows)), ["block", "kind", "a", "b", "id", "norm", "numbers", "tf", "df"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), id_kind, pa.float64(), *[pa.binary()] * 3])

    return run


def _best(total: int, threshold: float) -> Callable:
    """Each text's best partner in a block of vectors (kind 0) and pairs (kind 1)."""

    def block(vectors: list, pairs: np.ndarray) -> list[tuple]:
        keys = np.array([v[0] for v in vectors])
        number = [climbed(v[3], np.uint64) for v in vectors]
        weight = [unpack(v[4], np.uint32) * (np.log((1 + total) / (1 + unpack(v[5], np.uint32).astype(np.int64))) + 1) / v[2] for v in vectors]
        size = np.array([len(x) for x in number])
        start, (_, term), w = np.cumsum(size) - size, np.unique(np.concatenate(number), return_inverse=True), np.concatenate(weight)
        order = np.argsort(keys)
        place = order[np.searchsorted(keys[order], pairs)]
        place = place[np.argsort(place[:, 0], kind="stable")]
        dense, found = np.zeros(int(term.max()) + 1), []
        at = runs(place[:, 0])
        for low, high in zip(at[:-1], at[1:]):
            x = int(place[low, 0])
            own = slice(start[x], start[x] + size[x])
            dense[term[own]] = w[own]
            for part in range(low, high, 2_000):
                y = place[part : min(part + 2_000, high), 1]
                n = size[y]
                spot = np.repeat(start[y] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                dots = np.add.reduceat(dense[term[spot]] * w[spot], np.cumsum(n) - n)
                similar = np.floor(dots * 1_000_000 + 0.5) / 1_000_000
                reached = similar >= threshold
                found.append(np.stack([np.full(int(reached.sum()), x), y[reached], similar[reached]]))
            dense[term[own]] = 0
        x, y, s = np.concatenate(found, axis=1)
        name = [v[1] for v in vectors]
        rank = np.empty(len(name), np.int64)
        rank[sorted(range(len(name)), key=name.__getitem__)] = np.arange(len(name))
        x, y, s = np.concatenate([x, y]).astype(np.int64), np.concatenate([y, x]).astype(np.int64), np.concatenate([s, s])
        order = np.lexsort((rank[y], -s, x))
        return [(name[x[k]], name[y[k]], float(s[k])) for k in order[runs(x[order])[:-1]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_kind, now, vectors, pairs = None, None, [], []

        def closed() -> pa.RecordBatch:
            rows = block(vectors, np.concatenate(pairs)) if pairs else []
            return table(list(zip(*rows)) or [[]] * 3, ["a", "b", "similarity"], [id_kind, id_kind, pa.float64()])

        for batch in batches:
            id_kind = batch.schema.field(4).type
            blocks = batch.column(0).to_numpy()
            at = runs(blocks)
            for low, high in zip(at[:-1], at[1:]):
                if blocks[low] != now:
                    if vectors:
                        yield closed()
                    now, vectors, pairs = blocks[low], [], []
                part = batch.slice(low, high - low)
                first = int((part.column(1).to_numpy() == 0).sum())
                vectors += list(zip(*(part.column(k).slice(0, first).to_pylist() for k in (2, 4, 5, 6, 7, 8))))
                if first < high - low:
                    pairs.append(np.stack([part.column(k).slice(first).to_numpy() for k in (2, 3)], axis=1))
        if vectors:
            yield closed()

    return run


def neighbours(docs: DataFrame, text: Column, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Groups of equal texts, as rows ``id``, ``rep``, ``n`` of texts with words; and ``a``, ``b``, ``similarity``: the best partner of each group's least id, among such ids."""
    spark, kind, slack = docs.sparkSession, dict(docs.dtypes)["id"], SLACK * threshold
    bar = threshold - 1e-6 - slack
    words = F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(text, " "), lambda w: F.xxhash64(w)))
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = f"chunk long, ids array<{kind}>, digests array<binary>, texts long, terms long, sizes binary, vocabulary binary, words binary"
    # by chunk, chunks and answers lie in as many files as a join has tasks: neither moves again
    chunks = stored(docs.select("id", words.alias("words")).mapInArrow(_chunks, columns), "chunks", (files, "chunk"))
    total, count = chunks.agg(F.coalesce(F.sum("texts"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    bits = 56 if 2 * count <= FEW_TERMS else 64
    buckets = max(LEAST_BUCKETS, math.ceil(2 * count / BUCKET_TERMS))

    rows = chunks.select("chunk", F.posexplode(F.arrays_zip("ids", "digests")).alias("pos", "m")).select("chunk", "pos", F.col("m.ids").alias("id"), F.col("m.digests").alias("digest")).where("digest IS NOT NULL")
    groups = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("id", "chunk", "pos")).alias("first"))
    members = stored(rows.join(groups, "digest").select("id", "chunk", "pos", F.col("first.id").alias("rep"), "n", (F.struct("id", "chunk", "pos") == F.col("first")).alias("leads")), "members")

    sent = chunks.select("chunk", "sizes", "vocabulary", "words").mapInArrow(_sent(buckets, bits), "bucket long, chunk long, hashes binary, df binary")
    answers = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_answered, "chunk long, bucket long, numbers binary, df binary")
    answers = stored(answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "numbers", "df")).alias("answers")), "answers", (files, "chunk"))
    whole = chunks.select("chunk", "ids", "sizes", "vocabulary", "words").join(answers, "chunk")
    leading = members.where("leads").groupBy("chunk").agg(F.collect_list(F.struct("pos", "n")).alias("members"))

    rare = whole.join(leading, "chunk").select("chunk", "members", "sizes", "vocabulary", "words", "answers").mapInArrow(_rare(total, bits, bar), "bucket long, chunk long, texts binary, numbers binary, rests binary, weights binary")
    least = slack / 2 / buckets
    met = rare.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_met(bar, least * (1 - 1e-6)), "a long, b long, s float")
    near = met.groupBy("a", "b").agg(F.sum("s").alias("s"), F.count("*").alias("k")).where(F.col("s") + (buckets - F.col("k")) * least >= slack - 1e-5)
    pairs = stored(near.select("a", "b"), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc"))
    n = max(4, math.ceil(ends.distinct().count() / GROUP))
    low, high = (F.expr(f"{f}(pmod(xxhash64(a), {n}L), pmod(xxhash64(b), {n}L))") for f in ("least", "greatest"))
    dealt = pairs.withColumn("block", low * n + high)
    wanted = dealt.select("block", F.explode(F.array("a", "b")).alias("doc")).distinct().groupBy(F.shiftright("doc", _POS).alias("chunk")).agg(F.collect_list(F.struct(F.col("doc").bitwiseAND((1 << _POS) - 1).alias("pos"), "block")).alias("wanted"))
    columns = f"block long, kind int, a long, b long, id {kind}, norm double, numbers binary, tf binary, df binary"
    vectors = whole.join(wanted, "chunk").select("chunk", "wanted", "ids", "sizes", "vocabulary", "words", "answers").mapInArrow(_vectors(total, bits), columns)
    none = [F.lit(None).cast(k).alias(c) for c, k in (("id", kind), ("norm", "double"), ("numbers", "binary"), ("tf", "binary"), ("df", "binary"))]
    both = vectors.unionAll(dealt.select("block", F.lit(1).alias("kind"), "a", "b", *none))
    best = stored(both.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(_best(total, threshold), f"a {kind}, b {kind}, similarity double"), "best")
    for made in (chunks, answers, pairs):
        dropped(made)
    return members.select("id", "rep", "n"), best.groupBy("a").agg(F.min_by(F.struct("b", "similarity"), F.struct(-F.col("similarity"), "b")).alias("x")).select("a", "x.*")

"""Approximate nearest neighbours by inner product: cross-polytope hashing with multiprobe tables.

A polytope turns unit vectors by three rounds of random signs and a Hadamard transform and files a vector under
the signed axis nearest to it. A table concatenates ``polytopes(n)`` of them: their number grows with the vectors,
so buckets stay small however many there are.

Inner products become angles by one more component: with M the largest norm, x goes to
(x, sqrt(M^2 - |x|^2)) / M and a query q to (q, 0) / |q|, so the nearest angle is the largest product.

Probing. An axis costs a query the square of what it lacks to the query's own nearest axis; a bucket costs the
sum over its axes. A query probes every bucket, in all tables, that costs at most a bound, and the vectors found
there, no others, are ranked by their inner product on the original components. The bound is set on CALIBRATION
distinct vectors, whose true neighbours among *all* vectors are found in one pass: it is the least at which
RECALL of these neighbours are met.

Work is dealt in tiles. Axes of a table's first polytope are packed into tiles of about TILE vectors, never with
those of another table; an axis with more is split over several by id, so no vector, however common, meets in one
place. A task holds a tile and streams the queries that probe it; every LOT queries go to a copy of the tile. What
a task returns is K rows a query and tile. Only counts by table and first axis reach the driver (TABLES times
twice the padded dimension at most) and the bounded calibration rows. Queries that met fewer than K are ranked
against all vectors in a second pass.

Vectors that are null or zero, hold a null or non-finite component, or have another length than the
commonest take no part; nor do rows without an id. Rows that repeat an id count as one, with the
nearest of their vectors. Ties go to the smaller id. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm.common import written

TABLES = 8
K = 20
TILE = 32768
LOT = 65536
#: Vectors a bucket is meant to hold, by which the polytopes of a table are numbered.
BUCKET = 8
#: Rows from which CALIBRATION distinct vectors are taken, in the order of the hash of their ids.
SAMPLE = 4096
CALIBRATION = 128
RECALL = 0.95
SEED = 1
#: Queries and candidate pairs that are looked at together.
STRIP, PAIRS = 256, 1 << 16


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row; the length is a power of two."""
    count, size = rows.shape
    half = 1
    while half < size:
        pairs = rows.reshape(count, size // (2 * half), 2, half)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(count, size)
        half *= 2
    return rows / math.sqrt(size)


def turned(rows: np.ndarray, table: int, polytope: int, seed: int = SEED) -> np.ndarray:
    signs = np.random.default_rng([seed, table, polytope]).choice([-1.0, 1.0], (3, rows.shape[1]))
    for s in signs:
        rows = hadamard(rows * s)
    return rows


def padded(dim: int) -> int:
    return 1 << max(dim, 1).bit_length()  # room for the added component


def polytopes(count: int, dim: int) -> int:
    """Polytopes of a table: as many as leave about BUCKET of ``count`` vectors in a bucket, one at least."""
    return max(1, math.ceil(math.log(max(count / BUCKET, 1)) / math.log(2 * padded(dim))))


def lifted(vectors: np.ndarray, largest: float, query: bool) -> np.ndarray:
    out = np.zeros((len(vectors), padded(vectors.shape[1])))
    norms = np.linalg.norm(vectors, axis=1)
    scale = norms if query else largest
    out[:, : vectors.shape[1]] = vectors / (scale[:, None] if query else scale)
    if not query:
        out[:, vectors.shape[1]] = np.sqrt(np.maximum(0.0, 1 - (norms / largest) ** 2))
    return out


def codes(rows: np.ndarray, table: int, depth: int) -> np.ndarray:
    """The nearest signed axis of each lifted row under each polytope of a table: shape (rows, depth)."""
    found = np.empty((len(rows), depth), np.int32)
    for p in range(depth):
        r = turned(rows, table, p)
        best = np.abs(r).argmax(axis=1)
        found[:, p] = best + r.shape[1] * (r[np.arange(len(r)), best] < 0)
    return found


def costs(rows: np.ndarray, table: int, depth: int) -> np.ndarray:
    """What each signed axis of each polytope of a table costs each lifted query: shape (depth, rows, axes)."""
    found = []
    for p in range(depth):
        r = turned(rows, table, p)
        both = np.concatenate([r, -r], axis=1)
        found.append((both.max(axis=1, keepdims=True) - both) ** 2)
    return np.stack(found)


def bound_for(asked: np.ndarray, near: np.ndarray, largest: float, depth: int, tables: int = TABLES, recall: float = RECALL) -> float:
    """The least bound at which ``recall`` of the pairs meet in some table; row i of ``near`` is a true neighbour of row i of ``asked``."""
    if not len(asked):
        return math.inf
    q, x, at = lifted(asked, largest, True), lifted(near, largest, False), np.arange(len(asked))
    least = np.full(len(asked), np.inf)
    for t in range(tables):
        cost, code = costs(q, t, depth), codes(x, t, depth)
        least = np.minimum(least, sum(cost[p][at, code[:, p]] for p in range(depth)))
    return float(np.sort(least)[math.ceil(recall * len(least)) - 1]) + 1e-12


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _norm(c: Column) -> Column:
    return F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def usable(df: DataFrame, is_query: Column, key: str, vector: str) -> tuple[DataFrame, int, float, int]:
    """``vec_id``, ``v``, ``asked`` of the rows that take part, their dimension, largest norm and number."""
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.col(key).isNotNull() & v.isNotNull() & sound).select(F.col(key).cast("long").alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked")).withColumn("norm", _norm(F.col("v")))
    rows = rows.where((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    by_size = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max("norm").alias("norm"))
    best = by_size.orderBy(F.desc("n"), "dim").first()
    if best is None:
        return rows.drop("norm"), 0, 0.0, 0
    return rows.where(F.size("v") == best["dim"]).drop("norm"), best["dim"], best["norm"], best["n"]


def nearest_of(scores: np.ndarray, ids: np.ndarray, k: int, repeated: bool) -> np.ndarray:
    """Places of the ``k`` best of one query's candidates: largest score first, ties to the smaller id, ids once."""
    at = np.arange(len(scores))
    if not repeated and len(scores) > 4 * k:
        at = np.nonzero(scores >= np.partition(scores, -k)[-k])[0]
    at = at[np.lexsort((ids[at], -scores[at]))]
    if repeated:
        at = at[np.sort(np.unique(ids[at], return_index=True)[1])]
    return at[:k]


class Tile:
    """The vectors of a tile, by first axis and then by the other axes of their bucket."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, code: np.ndarray):
        order = np.lexsort(code.T[::-1])
        self.ids, self.vectors, code = ids[order], vectors[order], code[order]
        self.repeated = len(np.unique(ids)) < len(ids)
        fresh = np.ones(len(code), bool)
        fresh[1:] = (code[1:] != code[:-1]).any(axis=1)
        self.starts = np.append(np.nonzero(fresh)[0], len(code))  # of the buckets
        self.buckets = code[self.starts[:-1]]
        first = np.ones(len(self.buckets), bool)
        first[1:] = self.buckets[1:, 0] != self.buckets[:-1, 0]
        self.axes = np.append(np.nonzero(first)[0], len(self.buckets))  # of the first axes, in buckets

    def candidates(self, cost: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """Query and vector of every pair whose bucket costs at most ``bound``, by query; ``cost``: (depth, queries, axes)."""
        pairs = []
        for low, high in zip(self.axes[:-1], self.axes[1:]):
            spent = cost[0][:, self.buckets[low, 0]]
            q = np.nonzero(spent <= bound)[0]
            if not len(q):
                continue
            total = np.repeat(spent[q][:, None], high - low, axis=1)
            for p in range(1, len(cost)):
                total += cost[p][np.ix_(q, self.buckets[low:high, p])]
            i, b = np.nonzero(total <= bound)
            size = self.starts[low + b + 1] - self.starts[low + b]
            begin = np.repeat(self.starts[low + b] - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size, size)
            pairs.append((np.repeat(q[i], size), begin + np.arange(len(begin))))
        if not pairs:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        of, at = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        order = np.argsort(of, kind="stable")
        return of[order], at[order]

    def ranked(self, names: np.ndarray, queries: np.ndarray, cost: np.ndarray, bound: float, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Query id, vector id and score of each query's ``k`` best candidates."""
        for low in range(0, len(names), STRIP):
            strip = slice(low, low + STRIP)
            of, at = self.candidates(cost[:, strip], bound)
            other = names[strip][of] != self.ids[at]
            of, at = of[other], at[other]
            score = np.concatenate([(queries[strip][of[s : s + PAIRS]] * self.vectors[at[s : s + PAIRS]]).sum(axis=1) for s in range(0, len(of), PAIRS)] or [np.empty(0)])
            cuts = np.append(np.nonzero(np.diff(of, prepend=-1))[0], len(of))
            for a, b in zip(cuts[:-1], cuts[1:]):
                best = a + nearest_of(score[a:b], self.ids[at[a:b]], k, self.repeated)
                yield np.full(len(best), names[low + of[a]]), self.ids[at[best]], score[best]


def true_neighbours(rows: DataFrame, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the ``k`` nearest rows of each of a bounded number of vectors (not counting equal ones), paired with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [(np.empty(0), np.empty((0, asked.shape[1])))] * len(asked)
        for batch in batches:
            x = _matrix(batch.column(1))
            for low in range(0, len(x), 2048):
                part = x[low : low + 2048]
                score = asked @ part.T
                for i, (s, v) in enumerate(held):
                    at = np.argpartition(score[i], -k)[-k:] if len(part) > k else np.arange(len(part))
                    at = at[(score[i][at] > (s[-1] if len(s) == k else -np.inf)) & (part[at] != asked[i]).any(axis=1)]
                    if len(at):
                        s, v = np.concatenate([s, score[i][at]]), np.concatenate([v, part[at]])
                        best = np.argsort(-s, kind="stable")[:k]
                        held[i] = s[best], v[best]
        which = np.concatenate([np.full(len(s), i) for i, (s, _) in enumerate(held)])
        found = np.concatenate([v for _, v in held])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array(np.concatenate([s for s, _ in held])), lists], ["which", "score", "v"])

    near = rows.select("vec_id", "v").mapInArrow(run, "which long, score double, v array<double>")
    rank = F.row_number().over(Window.partitionBy("which").orderBy(F.desc("score"), "v"))
    found = near.withColumn("rank", rank).where(F.col("rank") <= k).select("which", "v").toArrow()
    return asked[found.column("which").to_numpy()], _matrix(found.column("v"))


def search(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K, tables: int = TABLES) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest rows found for each row where ``is_query``."""
    spark = df.sparkSession
    schema = "query_id long, vec_id long, score double"
    rows, dim, largest, count = usable(df, is_query, key, vector)
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, depth = 2 * padded(dim), polytopes(count, dim)
    sample = _matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow().column("v"))
    chosen = sample[np.sort(np.unique(sample, axis=0, return_index=True)[1])][:CALIBRATION]
    bound = bound_for(*true_neighbours(rows, chosen, k), largest, depth, tables)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = lifted(_matrix(b.column(1)), largest, False) if b.num_rows else np.empty((0, width // 2))
            found = np.concatenate([codes(x, t, depth) for t in range(tables)], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], ["vec_id", "v", "asked", "codes"])

    kind = dict(rows.dtypes)["v"]
    index = written(rows.mapInArrow(coded, f"vec_id long, v {kind}, asked boolean, codes array<int>"), "vectors")
    filed = index.select("vec_id", "v", F.explode(F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.struct((t * width + F.get("codes", t * depth)).alias("axis"), F.slice("codes", t * depth + 1, depth).alias("codes")))).alias("at")).select("vec_id", "v", "at.*")
    sizes = {r["axis"]: r["n"] for r in filed.groupBy("axis").agg(F.count("*").alias("n")).collect()}
    first, parts, tile, held, table = [0] * (tables * width), [0] * (tables * width), -1, TILE, -1
    table_of: list[int] = []
    for axis in sorted(sizes):
        if held + sizes[axis] > TILE or axis // width != table:
            tile, held, table = tile + 1, 0, axis // width
        first[axis], parts[axis] = tile, max(1, math.ceil(sizes[axis] / TILE))
        tile, held = tile + parts[axis] - 1, TILE if parts[axis] > 1 else held + sizes[axis]
        table_of += [table] * (tile + 1 - len(table_of))
    firsts, lots = F.lit(first), F.lit(parts)
    begins, ends = np.array(first), np.array(first) + np.array(parts)  # of an axis, in tiles

    def probing(limit: float, over: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q = lifted(_matrix(b.column(1)), largest, True) if b.num_rows else np.empty((0, width // 2))
                wanted = np.zeros((b.num_rows, len(table_of) + 1), np.int32)
                for t in range(over):
                    i, axis = np.nonzero(costs(q, t, 1)[0] <= limit)
                    axis = axis + t * width
                    i, axis = i[ends[axis] > begins[axis]], axis[ends[axis] > begins[axis]]
                    np.add.at(wanted, (i, begins[axis]), 1)
                    np.add.at(wanted, (i, ends[axis]), -1)
                i, found = np.nonzero(np.cumsum(wanted, axis=1) > 0)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(i, np.arange(b.num_rows + 1)).astype(np.int32)), pa.array(found.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["id", "v", "tiles"])

        return run

    def met(limit: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, filling, ready = None, [], None
            for b in batches:
                out = []
                place = np.stack([b.column(c).to_numpy() for c in (0, 1, 2)])  # tile, lot, whether a query
                edges = np.append(np.nonzero(np.append(True, (place[:, 1:] != place[:, :-1]).any(axis=0)))[0], b.num_rows) if b.num_rows else [0]
                for low, high in zip(edges[:-1], edges[1:]):
                    tile_, lot_, query = place[:, low].tolist()
                    if (tile_, lot_) != now:
                        now, filling, ready = (tile_, lot_), [], None
                    ids, x = b.column(3).slice(low, high - low).to_numpy(), _matrix(b.column(4).slice(low, high - low))
                    if not query:
                        filling.append((ids, x, _matrix(b.column(5).slice(low, high - low)).astype(np.int32)))
                    elif filling or ready:
                        if ready is None:
                            ready, filling = Tile(*(np.concatenate(c) for c in zip(*filling))), []
                        cost = costs(lifted(x, largest, True), table_of[tile_], depth)
                        out += ready.ranked(ids, x, cost, limit, k)
                arrays = [np.concatenate([o[c] for o in out] or [np.empty(0)]) for c in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(arrays[0].astype(np.int64)), pa.array(arrays[1].astype(np.int64)), pa.array(arrays[2].astype(np.float64))], ["query_id", "vec_id", "score"])

        return run

    queries = index.where("asked").select(F.col("vec_id").alias("id"), "v")
    copies = max(1, math.ceil(queries.count() / LOT))

    def ranked(some: DataFrame, limit: float, over: int) -> DataFrame:
        asked = some.mapInArrow(probing(limit, over), f"id long, v {kind}, tiles array<int>").select(F.explode("tiles").alias("tile"), F.pmod(F.xxhash64("id"), F.lit(copies)).cast("int").alias("lot"), F.lit(1).alias("kind"), "id", "v", F.lit(None).cast("array<int>").alias("codes"))
        at = (F.get(firsts, F.col("axis")) + F.pmod(F.xxhash64("vec_id"), F.get(lots, F.col("axis")))).cast("int")
        held_ = filed.where(F.col("axis") < over * width).select(at.alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("lot"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "v", "codes")
        dealt = held_.unionAll(asked).repartition("tile", "lot").sortWithinPartitions("tile", "lot", "kind")
        return dealt.mapInArrow(met(limit), schema)

    best = lambda found: found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    found = written(best(ranked(queries, bound, tables)), "found")
    number = found.groupBy("query_id").agg(F.count("*").alias("n"))
    short = queries.join(number, queries["id"] == number["query_id"], "left").where(F.coalesce("n", F.lit(0)) < min(k, count - 1)).select("id", "v")
    if not short.isEmpty():
        found = best(found.unionAll(ranked(short, math.inf, 1)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

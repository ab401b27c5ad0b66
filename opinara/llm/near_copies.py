"""Links between near copies by the Jaccard similarity of their shingle sets.

SimHash fingerprints of 64 bits can't tell a similarity of 0.8 from less (see ``simhash``), so these links
complete theirs:

1. A text's shingles are hashed once. Its sketch is the whole set of distinct hashes: their upper 32 bits for at
   most SKETCH of them, else all 64.
2. Each of BANDS keys is made of ROWS min-hashes. Texts that share a key meet in a file; two texts of
   similarity 0.8 miss one another in all bands once in 1,600 times, of 0.9 practically never.
3. A file of more than BLOCK texts or BLOCK_BYTES of sketches is dealt into blocks, and each is linked by itself.
   Where blocks of a file then hold texts of several classes, all that are not of its commonest class meet every
   block: no two members of different classes miss each other, and a large group of copies, which is one class
   by then, costs no more than its members. Files with the same members count once.
4. In a file, a text meets only those within the size ratio that the similarity implies and not yet in its
   tree. The least SKETCH hashes of two sets give their similarity, exactly where they are the whole sets; else to
   a deviation of 0.009, so where it is above the bound less SLACK the whole sets are compared. Every link
   is decided on whole sets. A file emits a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import drop_written, written
from opinara.llm.components import components

SIMILARITY = 0.8
SLACK = 0.08
SKETCH = 2048
BANDS, ROWS = 14, 4
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Hashes that meet the min-hash functions at once.
CHUNK = 1 << 12
_SEEDS = np.random.default_rng(42).integers(1, 2**63, (2, BANDS * ROWS), dtype=np.uint64)


def sketch(hashes: np.ndarray) -> tuple[int, bytes, list[int]]:
    """The number of distinct hashes, their set, and the band keys."""
    distinct = np.unique(hashes)
    if not len(distinct):
        return 0, b"", []
    held = distinct if len(distinct) > SKETCH else np.unique((distinct >> np.uint64(32)).astype(np.uint32))
    odd, shift = _SEEDS[0] | np.uint64(1), _SEEDS[1]
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for low in range(0, len(distinct), CHUNK):
        mixed = distinct[low : low + CHUNK, None] * odd + shift
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, (mixed * odd).min(axis=0))
    keys = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(29)
    return len(distinct), held.tobytes(), keys.view(np.int64).tolist()


def least(count: int, held: bytes) -> np.ndarray:
    """The least SKETCH hashes of a set, by their upper 32 bits."""
    if count <= SKETCH:
        return np.frombuffer(held, np.uint32).astype(np.uint64)
    return np.unique(np.frombuffer(held, np.uint64, min(count, 2 * SKETCH)) >> np.uint64(32))[:SKETCH]


def whole_similarity(one: tuple[int, bytes], other: tuple[int, bytes]) -> float:
    """Jaccard similarity of two whole sets."""
    sets = [np.frombuffer(held, np.uint64 if count > SKETCH else np.uint32) for count, held in (one, other)]
    if sets[0].dtype != sets[1].dtype:
        sets = [np.unique((s >> np.uint64(32)).astype(np.uint32)) if s.dtype == np.uint64 else s for s in sets]
    few, many = sorted(sets, key=len)
    at = np.minimum(np.searchsorted(many, few), len(many) - 1)
    shared = int((many[at] == few).sum())
    return shared / (len(few) + len(many) - shared)


def similarities(one: np.ndarray, whole: bool, others: np.ndarray, sizes: np.ndarray, wholes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity of the sketch ``one`` to each row of ``others``, and whether it is exact.

    Rows hold ``sizes`` ascending values, filled up with the largest 64-bit value.
    """
    top = np.uint64(2**64 - 1)
    ends = np.where(wholes, top, others[np.arange(len(others)), sizes - 1])
    ends = np.minimum(ends, top if whole else one[-1])
    at = np.searchsorted(one, others)
    shared = (one[np.minimum(at, len(one) - 1)] == others).sum(axis=1)
    mine = np.searchsorted(one, ends, side="right")
    theirs = np.minimum((others <= ends[:, None]).sum(axis=1), sizes)
    return shared / np.maximum(mine + theirs - shared, 1), wholes & whole


def near_forest(counts: list[int], sketches: list[bytes], similarity: float = SIMILARITY, trees: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among the members of a file, as pairs of positions; members of equal ``trees`` are linked already."""
    order = np.argsort(np.array(counts), kind="stable")
    sets = [(counts[k], sketches[k]) for k in order]
    counts = np.array(counts, np.int64)[order]
    parts = [least(*s) for s in sets]
    sizes = np.array([len(p) for p in parts])
    wholes = counts <= SKETCH
    table = np.full((len(parts), sizes.max()), 2**64 - 1, np.uint64)
    for row, part in zip(table, parts):
        row[: len(part)] = part
    ends = np.searchsorted(counts, counts / similarity + 1e-9, side="right")
    tree = np.arange(len(parts)) if trees is None else np.array(trees)[order]
    kept = []
    for i in range(len(parts) - 1):
        later = i + 1 + np.nonzero(tree[i + 1 : ends[i]] != tree[i])[0]
        if not len(later):
            continue
        near, exact = similarities(parts[i], wholes[i], table[later], sizes[later], wholes[later])
        linked = later[exact & (near >= similarity - 1e-9)].tolist()
        met = set(tree[linked].tolist())
        for j in later[~exact & (near >= similarity - SLACK)].tolist():
            if tree[j] not in met and whole_similarity(sets[i], sets[j]) >= similarity - 1e-9:
                linked.append(j)
                met.add(tree[j])
        if linked:
            others, first = np.unique(tree[linked], return_index=True)
            kept += [(int(order[i]), int(order[linked[k]])) for k in first]
            tree[np.isin(tree, others)] = tree[i]
    return kept


def _linked(files: DataFrame, named: DataFrame, similarity: float) -> DataFrame:
    """``a``, ``b``: links within files, given as arrays of ``tid`` and ``tree``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, members = None, []

        def closed() -> list[tuple[int, int]]:
            if len(members) < 2:
                return []
            return [(members[i][0], members[j][0]) for i, j in near_forest([m[2] for m in members], [m[3] for m in members], similarity, [m[1] for m in members])]

        def made(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            pairs = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != file:
                    pairs += closed()
                    file, members = row[0], []
                members.append(row[1:])
            yield made(pairs)
        yield made(closed())

    rows = files.select(F.xxhash64("members").alias("file"), F.explode("members").alias("m")).select("file", "m.*").join(named, "tid").select("file", "fp", "tree", "n", "sketch")
    return rows.repartition("file").sortWithinPartitions("file", "fp", "n").mapInArrow(run, "a long, b long")


def near_links(texts: DataFrame, others: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``a``, ``b``: the links of ``others``, and those between the fingerprints of near copies, as a written table.

    ``texts`` has a row (``tid``, ``fp``, ``n``, ``sketch``, ``bands``) for each text, written before; those of equal
    sets have one ``tid``. Sets move once, to meet the files they are in.
    """
    named = texts.where("n > 0").select("tid", "fp", "n", "sketch").dropDuplicates(["tid"])
    narrow = texts.where("n > 0").select("tid", "fp", F.octet_length("sketch").alias("bytes"), "bands").distinct()
    keyed = narrow.select("tid", "fp", "bytes", F.explode("bands").alias("key"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("b") / BLOCK_BYTES)).cast("long")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("m"), F.sum("bytes").alias("b")).where("m > 1").select("key", blocks.alias("blocks"))
    dealt = written(keyed.drop("bytes").join(sizes, "key").withColumn("block", F.expr("pmod(xxhash64(tid, 7L), blocks)")), "near-dealt")

    def filed(rows: DataFrame, *by: str) -> DataFrame:
        members = F.sort_array(F.collect_set(F.struct("tid", "tree")))
        return rows.groupBy(*by).agg(members.alias("members")).where(F.size("members") > 1).select("members").distinct()

    within = _linked(filed(dealt.withColumn("tree", F.col("tid")), "key", "block"), named, similarity)
    found = written(others.unionAll(within), "near-links")
    large = dealt.where("blocks > 1")
    if not large.isEmpty():
        classes = components(found, "a", "b")
        placed = written(large.join(classes, large["fp"] == classes["node"], "left").select("key", "tid", "blocks", "block", F.coalesce("component", "fp").alias("tree")), "near-placed")
        common = placed.groupBy("key", "tree").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "tree"))["tree"].alias("common"), F.sum("n").alias("all"), F.max("n").alias("most"))
        open_ = placed.join(common.where("all > most").withColumn("rest", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("long")), "key")
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        one = open_.where("tree <> common").withColumn("mine", F.expr("pmod(xxhash64(tid, 11L), rest)")).withColumn("other", every(F.col("blocks")))
        other = open_.withColumn("mine", every(F.col("rest"))).withColumn("other", F.col("block"))
        columns = ("key", "mine", "other", "tid", "tree")
        across = _linked(filed(one.select(*columns).unionAll(other.select(*columns)), "key", "mine", "other"), named, similarity)
        more = written(found.unionAll(across), "near-links")
        drop_written(found)
        drop_written(placed)
        found = more
    drop_written(dealt)
    return found

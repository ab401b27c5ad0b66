"""SimHash near-duplicates, verified through tables of distances to reference fingerprints.

A fingerprint is 64 bits over the word shingles of a whole text. Two fingerprints link at
``RADIUS`` or fewer differing bits; near-duplicate classes are the connected components.

How links are found, without comparing all pairs:

1. Equal texts and equal fingerprints collapse to one fingerprint each.
2. The 64 bits fall into SEGMENTS equal segments. Two linked fingerprints differ in at most RADIUS
   segments, so they agree on all the others; each fingerprint is filed once for every choice of
   SEGMENTS - RADIUS segments. A file holds at most 2 ** (bits of the left-out segments) distinct
   fingerprints, 65,536 at 8 segments: a bound that no input exceeds, so files need no cap.
3. Within a file, the Hamming distances of every member to many reference fingerprints (pivots) are
   tabled. By the triangle inequality the distance of a pair is at least the largest coordinate
   difference, so pairs whose coordinates differ by more than RADIUS anywhere are discarded. Members
   are sorted by their first coordinate, and each meets only the later ones within RADIUS of it.
4. Survivors are verified on their 64 bits. A file emits a spanning forest of its links, never all
   pairs, and the components join the forests.

Pivots alone, as a join index, leave a fixed share of all pairs to compare (a coordinate of random
fingerprints has a deviation of 4, so one discards about 40 %), which is why the files come first.

64 bits can't tell a Jaccard similarity of 0.8 from less: such pairs lie up to 14 bits apart, where files no
longer part the fingerprints. ``deduplicate`` therefore adds the links of ``near_copies`` to those above.

Null and empty texts have the fingerprint zero and link like any other. Rows with a null id form
classes too, and never become a class's name unless no other id is there. Repeated rows keep their
own result rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import drop_written, free, written
from opinara.llm.components import components
from opinara.llm.near_copies import SIMILARITY, near_links, sketch

SHINGLE = 3
#: Words of a shingle where texts are compared by the similarity of their shingle sets.
NEAR_SHINGLE = 5
RADIUS = 2
SEGMENTS = 8
PIVOTS = 24
#: Bytes of sketches that are handed on together.
MARK_BYTES = 8 << 20
#: Shingles hashed before their bits are added up.
CHUNK = 1 << 16

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The XXH64 hashes (seed 42) of a text's shingles, repeats included, in parts.

    Works on UTF-8 bytes: ``bytes.split`` parts at just the six ASCII space characters, and only
    A-Z change in lower-casing.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    count = max(len(words) - shingle + 1, 1) if words else 0
    digest = xxhash.xxh64_intdigest
    for low in range(0, count, CHUNK):
        part = words[low : low + CHUNK + shingle - 1]
        if len(part) <= shingle:
            yield np.array([digest(b" ".join(part), 42)], np.uint64)
        else:
            yield np.array([digest(s, 42) for s in map(b" ".join, zip(*(part[k:] for k in range(shingle))))], np.uint64)


def majority(hashes: Iterable[np.ndarray]) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit integer; zero for none."""
    ones, count = np.zeros(64, np.int64), 0
    for part in hashes:
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        count += len(part)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The bits set in over half of the hashes of the shingles, as a signed 64-bit integer."""
    return majority(shingle_hashes(text, shingle))


def with_fingerprints(df: DataFrame, key: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``fp`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def with_marks(df: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """``doc_id``, ``fp`` and what ``near_links`` needs: ``n``, ``sketch``, ``bands``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, held, fps, marks = 0, 0, [], []
            for at, t in enumerate(batch.column(1), 1):
                hashes = list(shingle_hashes(t.as_py(), shingle))
                fps.append(majority(hashes))
                marks.append(sketch(np.concatenate(hashes) if hashes else np.empty(0, np.uint64)))
                held += len(marks[-1][1])
                if at == batch.num_rows or at - low == 256 or held > MARK_BYTES:
                    n, sketches, bands = zip(*marks)
                    ids = batch.column(0).slice(low, at - low)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(fps, pa.int64()), pa.array(n, pa.int64()), pa.array(sketches, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "fp", "n", "sketch", "bands"])
                    low, held, fps, marks = at, 0, [], []

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long, n long, sketch binary, bands array<long>")


def _masks() -> list[int]:
    """One mask for each choice of segments that must agree, as signed 64-bit integers."""
    width = 64 // SEGMENTS
    masks = []
    for kept in combinations(range(SEGMENTS), SEGMENTS - RADIUS):
        mask = sum(((1 << width) - 1) << (width * s) for s in kept)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, the same everywhere."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {k}", 42) for k in range(count)], np.uint64)


def forest(members: np.ndarray, references: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """A spanning forest of the links among distinct ``members``: rows of (member, other member).

    Members are taken one by one in the order of their first coordinate, each against the later ones
    within ``radius`` of it that are not yet in its tree, so memory is linear in the members.
    """
    table = np.bitwise_count(members[:, None] ^ references[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    members, table = members[order], table[order]
    ends = np.searchsorted(table[:, 0], table[:, 0] + radius, side="right")
    tree = np.arange(len(members))
    kept = []
    for i in range(len(members) - 1):
        later = i + 1 + np.nonzero(tree[i + 1 : ends[i]] != tree[i])[0]
        if not len(later):
            continue
        near = later[np.abs(table[later] - table[i]).max(axis=1) <= radius]
        linked = near[np.bitwise_count(members[near] ^ members[i]) <= radius]
        if len(linked):
            others, at = np.unique(tree[linked], return_index=True)
            kept += [(members[i], members[j]) for j in linked[at]]
            tree[np.isin(tree, others)] = tree[i]
    return np.array(kept, np.uint64).reshape(-1, 2)


def links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a``, ``b``: links that connect the distinct values of ``fp`` as all links would."""
    references = pivots()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = batch.column(0).flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(batch.column(0).value_lengths().to_numpy())])
            found, pair = [], np.diff(offsets) == 2
            at = offsets[:-1][pair]
            two = np.stack([values[at], values[at + 1]], axis=1) if len(at) else np.empty((0, 2), np.uint64)
            tabled = np.bitwise_count(two[:, :, None] ^ references).astype(np.int8)  # the many files of two, at once
            near = np.abs(tabled[:, 0] - tabled[:, 1]).max(axis=1, initial=0) <= radius
            two = two[near]
            found.append(two[np.bitwise_count(two[:, 0] ^ two[:, 1]) <= radius])
            for k in np.nonzero(~pair)[0].tolist():
                found.append(forest(values[offsets[k] : offsets[k + 1]], references, radius))
            pairs = np.concatenate(found).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    if radius != RADIUS:
        raise ValueError("files are made for RADIUS")
    tasks = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filed = fingerprints.select("fp").distinct().repartition(tasks).select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in _masks()])).alias("choice", "key"))
    files = filed.groupBy("choice", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return files.select("fps").mapInArrow(run, "a long, b long")


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """Per row: ``doc_id``, ``fp`` and ``component_id``, the least id of its class.

    With ``similarity``, texts whose shingle sets are so similar (Jaccard) link too, by ``near_links``.
    """
    if similarity is None:
        marked = written(with_fingerprints(df, key, text, shingle), "simhash")
        joined = components(links(marked), "a", "b")
    else:
        sketched = written(with_marks(df, key, text, shingle).withColumn("tid", F.xxhash64("fp", "n", "sketch")), "simhash-sketched")
        marked = written(sketched.select("doc_id", "fp"), "simhash")
        near = near_links(sketched, links(marked), similarity)
        drop_written(sketched)
        joined = components(near, "a", "b")
        drop_written(near)
    names = marked.groupBy("fp").agg(F.min("doc_id").alias("low"))
    linked = written(joined.withColumnRenamed("node", "fp").join(names, "fp"), "simhash-linked")
    least = linked.groupBy("component").agg(F.min("low").alias("component_id"))
    renamed = linked.join(least, "component").select("fp", "component_id")
    named = names.join(renamed, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return classes(df, key, text).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = NEAR_SHINGLE, similarity: float | None = SIMILARITY) -> DataFrame:
    """One row of each class, with the columns of ``df``: the one with the least id; rows without an id come last.

    By default texts link at a similarity of 0.8 over shingles of five words. Classes are named by row, so rows that
    share an id but are no near-duplicates all stay. Ties go to the least hash of the text, then of the row.
    """
    marks = {"none": F.col(key).isNull(), "id": F.col(key), "digest": F.xxhash64(F.col(text)), "mark": F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])}
    own = free(df, "__row")
    rows = df.withColumn(own, F.struct(*[c.alias(k) for k, c in marks.items()]))
    found = classes(rows, own, text, shingle, similarity)
    names = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(*[F.col(f"component_id.{k}").alias(free(rows, f"__{k}")) for k in marks]).distinct()
    same = [F.col(f"{own}.{k}").eqNullSafe(F.col(free(rows, f"__{k}"))) for k in marks]
    return rows.join(names, same, "left_semi").dropDuplicates([own]).drop(own)

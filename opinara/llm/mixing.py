"""Mixing sources to target weights by subset-sum budget fitting.

Every document has a size in words. A source's target is met in three steps, on counts of documents
by exact size rather than on documents:

1. whole copies: a source whose target is at least its size takes every document once or twice;
2. a proportional share of every size, rounded down, then one more of each size in a seeded order
   while the remaining budget stays above RESERVE;
3. a bounded knapsack over the sizes and counts left, by dynamic programming around the remaining
   budget, which comes as near to it as any subset of the documents left can.

Then each (source, size) class takes its number of documents by a seeded hash of the key. Classes are
split into bins of about BIN documents by that hash, so no class is ranked in one task, and equal rows are counted
before they are ranked, so no key or text, however common, meets in one place.

Only counts leave the document rows: one row for each source and size, where a source's sizes number
no more than its longest document's words. Null texts have size zero; a null source is a source of its
own, ordered last. Repeated rows are separate documents. Reruns agree: all choices follow from the
seed, the key, the size and, in ``mixed``, the other columns of rows that share a key or have none.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm.common import free, word_count, written

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
SEED = 20
RESERVE = 1 << 16
BIN = 4096


def targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """``source``, ``source_size``, ``target`` from one row for each source with its ``source_size``.

    Weights go round in the code-point order of the sources. Sources fill up in the order of size by
    weight: one is capped if its share of what the smaller ones left is above ``most`` times its size.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    shares = F.array(*[F.lit(float(w)) for w in weights])
    weighed = totals.withColumn("w", F.get(shares, turn)).withColumn("cap", F.col("source_size").cast("double") * most)
    by_fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, everywhere = by_fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    zero = F.lit(0.0)
    left = F.sum("source_size").over(everywhere) * budget - F.coalesce(F.sum("cap").over(before), zero)
    level = left / (F.sum("w").over(everywhere) - F.coalesce(F.sum("w").over(before), zero))
    filled = weighed.withColumn("level", level).withColumn("capped", F.col("level") * F.col("w") >= F.col("cap"))
    common = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("level")))).over(everywhere)["level"]
    return filled.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(common * F.col("w")).alias("target"))


def knapsack(sizes: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many of each size to take so that their sum comes nearest to ``budget`` (the lesser sum on ties).

    Counts are split into powers of two; for every sum the first item that reaches it is kept, from
    which the choice is read back. Sums are followed up to one largest size beyond the budget, and to twice the
    budget at most, as taking nothing is nearer than any larger sum.
    """
    taken = [0] * len(sizes)
    top = min(budget + max(sizes, default=0), 2 * budget)
    full = (1 << (top + 1)) - 1
    reach, first = 1, np.full(top + 1, -1, np.int32)
    items: list[tuple[int, int]] = []
    for k, (size, count) in enumerate(zip(sizes, counts)):
        left, piece = min(count, top // size if size else 0), 1
        while left and not reach >> budget & 1:
            number = min(piece, left)
            fresh = (reach << (number * size)) & full & ~reach
            if fresh:
                bits = np.unpackbits(np.frombuffer(fresh.to_bytes(top // 8 + 1, "little"), np.uint8), bitorder="little")
                first[np.nonzero(bits)[0]] = len(items)
                items.append((k, number))
                reach |= fresh
            left, piece = left - number, piece * 2
    below = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1
    above = reach >> (budget + 1)
    gap = (above & -above).bit_length() if above else None
    at = below if gap is None or budget - below <= gap else budget + gap
    while at:
        k, number = items[first[at]]
        taken[k] += number
        at -= number * sizes[k]
    return taken


def fit(sizes: np.ndarray, counts: np.ndarray, target: float, seed: int = SEED, most: int = MOST) -> tuple[int, np.ndarray]:
    """Whole copies of the source, and how many documents of each size get one copy more."""
    total = int((sizes * counts).sum())
    whole = min(int(target // total), most) if total else 0
    extra = np.zeros(len(sizes), np.int64)
    rest = int(round(target)) - whole * total
    if rest <= 0 or whole == most or not total:
        return whole, extra
    rest = min(rest, total)
    extra = np.where(sizes > 0, counts * rest // total, 0)  # a share of every size
    rest -= int((extra * sizes).sum())
    order = np.random.default_rng(seed).permutation(len(sizes))
    for k in order:
        if rest <= RESERVE:
            break
        if extra[k] < counts[k] and 0 < sizes[k] <= rest:
            extra[k] += 1
            rest -= int(sizes[k])
    open_ = [k for k in order if 0 < sizes[k] and extra[k] < counts[k]]
    for k, more in zip(open_, knapsack([int(sizes[k]) for k in open_], [int(counts[k] - extra[k]) for k in open_], rest)):
        extra[k] += more
    return whole, extra


def _join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join in which null equals null, with the columns of ``on`` once."""
    other = right.select(*[F.col(n).alias(f"__{n}") if n in on else F.col(n) for n in right.columns])
    match = F.lit(True)
    for n in on:
        match = match & F.col(n).eqNullSafe(F.col(f"__{n}"))
    return left.join(other, match).drop(*[f"__{n}" for n in on])


def _plan(df: DataFrame, key: str, source: str, text: str, seed: int, mark: Column | None) -> DataFrame:
    """Equal rows as one: key, ``source``, ``size``, ``source_size``, ``target``, ``mark``, their number ``n``, the
    copies that each gets (``whole``) and how many of them get one more (``more``)."""
    docs = df.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), (F.lit(0).cast("long") if mark is None else mark).alias("mark"))
    groups = written(docs.groupBy("doc_id", "source", "size", "mark").agg(F.count("*").alias("n")), "mix-rows")
    counts = written(groups.groupBy("source", "size").agg(F.sum("n").alias("of_size")), "mix-counts")
    aims = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("of_size")).alias("source_size")))

    def fitted(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size")
        whole, extra = fit(part["size"].to_numpy(np.int64), part["of_size"].to_numpy(np.int64), float(part["target"].iloc[0]), seed)
        return part.assign(whole=whole, extra=extra)

    kind = dict(docs.dtypes)["source"]
    planned = _join(counts, aims, ["source"]).groupBy("source").applyInPandas(fitted, f"source {kind}, size long, of_size long, source_size long, target double, whole int, extra long")
    plan = written(planned.select("source", "size", "of_size", "source_size", "target", "whole", "extra"), "mix-plan")

    dealt = _join(groups, plan, ["source", "size"]).withColumn("lot", F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), "mark")).otherwise(F.xxhash64(F.lit(seed), "doc_id"))).withColumn("bin", F.pmod("lot", 1 + F.floor(F.col("of_size") / BIN)))
    binned = dealt.groupBy("source", "size", "bin", "extra").agg(F.sum("n").alias("here"))
    earlier = Window.partitionBy("source", "size").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    quota = binned.withColumn("quota", F.col("extra") - F.coalesce(F.sum("here").over(earlier), F.lit(0))).select("source", "size", "bin", "quota")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size", "bin").orderBy("lot", "doc_id", "mark").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.greatest(F.lit(0), F.least(F.col("n"), F.col("quota") - before))
    return _join(dealt, quota, ["source", "size", "bin"]).select("doc_id", "source", "size", "source_size", "target", "mark", "n", "whole", more.alias("more"))


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED) -> DataFrame:
    """Per row of ``df``: key, ``source``, ``size``, ``source_size``, ``target`` and ``copies``."""
    told = _plan(df, key, source, text, seed, None).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return told.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + (F.col("nth") <= F.col("more")).cast("int")).alias("copies"))


def mix_report(df: DataFrame) -> DataFrame:
    """Per row: its size, its source's size and target, and the words the mix takes of it."""
    return mix(df).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it, with its own columns.

    Rows are told apart by a hash of all their columns, so rows that share a key, source and size keep apart, and
    texts move once, to meet their number of copies.
    """
    columns, mark = [f"`{c}`" for c in df.columns], F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    own, n, times = free(df, "__mark"), free(df, "__n"), free(df, "__copies")
    plan = _plan(df, key, source, text, seed, mark).groupBy(F.col("mark").alias(own)).agg(F.sum("n").alias(n), F.sum(F.col("n") * F.col("whole") + F.col("more")).alias(times))
    plan = written(plan.where(F.col(times) > 0), "mix-copies")
    marked = df.withColumn(own, mark)
    each = marked.join(plan, own).withColumn(times, F.floor(F.col(times) / F.col(n)))
    rest = marked.join(plan.where(F.col(times) % F.col(n) > 0), own).dropDuplicates([own]).withColumn(times, F.col(times) % F.col(n))
    copies = lambda rows: rows.where(F.col(times) > 0).withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*columns)
    return copies(each).unionAll(copies(rest))

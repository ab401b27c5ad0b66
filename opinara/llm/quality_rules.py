"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule is a predicate that rejects a document, and states what it costs for one: the characters it looks at,
as an expression over the document. On a bounded sample the rejection rate and the mean cost of each rule are
taken; the rules then run in falling order of rejections per cost, as the branches of one CASE, so that a rule
is evaluated only for documents that passed all before it. The order never changes a verdict, only what it costs.
Costs are counted, not timed: a job on a small sample takes as long for one comparison as for a pattern, and
counts agree between runs. The sample is the first rows that the scan yields; what leaves a task is a few numbers
a row, and no more partitions are read than fill the sample.

Null texts count as empty. Empty texts have no words and fail the base rules. Repeated rows and
ties are judged row by row, so equal texts get equal verdicts. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import let, words_of

#: Rows of the sample from which costs and selectivities are estimated.
SAMPLE_ROWS = 400
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for documents to reject, at ``cost`` characters; both may use the columns of ``prepared``."""

    name: str
    rejects: Column
    cost: Column


@dataclass(frozen=True)
class Measured:
    rule: Rule
    cost: float
    rejected: float

    @property
    def yield_(self) -> float:
        return self.rejected / max(self.cost, 1.0)


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def symbol_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long")


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    filled = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    return let(filled, lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def repeat_words(words: Column) -> Column:
    """Words inside a window of eight that the text holds twice or more, first occurrences included.

    Windows are compared by a 64-bit hash. Texts without a repeated window, the usual case, stop
    after a hash-set pass; only the others sort their windows.
    """

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, i: F.least(F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    def repeated(ordered: Column) -> Column:
        same = lambda a, b: F.coalesce(a["k"] == b["k"], F.lit(False))
        kept = F.filter(ordered, lambda x, i: same(x, F.get(ordered, i - 1)) | same(x, F.get(ordered, i + 1)))
        return let(F.sort_array(F.transform(kept, lambda x: x["p"])), covered)

    def of(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda k, i: F.struct(k.alias("k"), i.alias("p")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(F.sort_array(pairs), repeated))

    windows = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, WINDOW)]))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(F.slice(windows, F.lit(1), F.size(words) - (WINDOW - 1)), of)).cast("long")


def base_rules(words: Column, n_repeat: Column, size: Column) -> list[Rule]:
    """``size``: the characters of the text."""
    n = F.size(words)
    return [Rule("few_words", n < 20, F.lit(1)), Rule("repeated_text", 100 * n_repeat > 30 * n, WINDOW * size + n)]


def own_rules(words: Column, text: Column, n_symbols: Column, n_dup_lines: Column, chars: Column, size: Column) -> list[Rule]:
    """The method's rules, well clear of ordinary prose.

    Symbols on over 30 % of the words, over half of the lines repeated, mean word length outside
    1.5 to 25, and over 40 % of the words followed by two exclamation marks or more.
    """
    n = F.size(words)
    return [
        Rule("symbols", 100 * n_symbols > 30 * n, size),
        Rule("repeated_lines", 100 * n_dup_lines > 50 * F.size(F.split(text, "\n")), 3 * size),  # split twice, lines compared
        Rule("word_length", (2 * chars < 3 * n) | (chars > 25 * n), n),
        Rule("shouting", 100 * F.regexp_count(text, F.lit("!!+")) > 40 * n, size),
    ]


def prepared(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``__text`` (never null) and ``__words``. For projections: see ``filter_quality`` on filters."""
    return df.withColumn("__text", F.coalesce(F.col(text), F.lit(""))).withColumn("__words", words_of(F.col("__text")))


def default_rules(words: Column, text: Column) -> list[Rule]:
    """All rules over the words and the text, each computing what it needs."""
    size = F.length(text)
    return base_rules(words, repeat_words(words), size) + own_rules(words, text, symbol_count(text), dup_lines(text), word_chars(words), size)


def measure(df: DataFrame, rows: int = SAMPLE_ROWS) -> list[Measured]:
    """Mean cost and rejection rate of each rule on at most ``rows`` rows, best yield first, then the cheaper."""
    rules = default_rules(F.col("__words"), F.col("__text"))
    seen = prepared(df).select(*[F.struct(r.rejects.cast("int").alias("hit"), r.cost.alias("cost")).alias(r.name) for r in rules]).limit(rows).collect()
    total = max(len(seen), 1)
    found = [Measured(r, sum(row[r.name]["cost"] for row in seen) / total, sum(row[r.name]["hit"] for row in seen) / total) for r in rules]
    return sorted(found, key=lambda m: (-m.yield_, m.cost))


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, in the order given; null for a document to keep."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.rejects, F.lit(rule.name)).otherwise(verdict)
    return verdict


def filter_quality(df: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``df`` that no rule rejects, with its own columns."""
    ranks = _ranks(df.select(F.col(text).alias("text")), rows)

    def verdict(words: Column, whole: Column) -> Column:
        return cascade(sorted(default_rules(words, whole), key=lambda r: ranks[r.name]))

    # the words are bound inside the predicate: as a column of their own they would be computed again for
    # every use once the filter is pushed below them
    judged = let(F.coalesce(F.col(text), F.lit("")), lambda whole: let(words_of(whole), lambda words: verdict(words, whole)))
    return df.where(judged.isNull())


def _ranks(docs: DataFrame, rows: int) -> dict[str, int]:
    return {m.rule.name: i for i, m in enumerate(measure(docs, rows))}


def quality_report(df: DataFrame, key: str = "doc_id", rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row: the base counts, ``base_failed``, ``kept`` and the rule that rejected it."""
    docs = df.select(F.col(key).alias("doc_id"), F.col("text"))
    ranks = _ranks(docs, rows)

    def judged(text: Column, words: Column, found: Column) -> Column:
        size, n = F.length(text), F.size(words)
        base = base_rules(words, found["n_repeat_words"], size)
        rules = base + own_rules(words, text, found["n_symbols"], found["n_dup_lines"], found["word_chars"], size)
        verdict = cascade(sorted(rules, key=lambda r: ranks[r.name]))
        counts = [found[c].alias(c) for c in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        return F.struct(n.cast("long").alias("n_words"), *counts, (base[0].rejects | base[1].rejects).alias("base_failed"), verdict.isNull().alias("kept"))

    def counted(text: Column, words: Column) -> Column:
        counts = F.struct(word_chars(words).alias("word_chars"), symbol_count(text).alias("n_symbols"), dup_lines(text).alias("n_dup_lines"), repeat_words(words).alias("n_repeat_words"))
        return let(counts, lambda found: judged(text, words, found))

    # words and counts are bound inside one expression, so a filter on the report computes them once more at most
    told = let(F.coalesce(F.col("text"), F.lit("")), lambda text: let(words_of(text), lambda words: counted(text, words)))
    return docs.select("doc_id", told.alias("__told")).select("doc_id", "__told.*")

"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Random indexing: every token has a fixed sparse vector of +1 and -1, from a hash of the token. A token's
context vector is the sum of the index vectors of its neighbours within REACH places, over the training
texts; tokens are filed in BUCKETS by hash. A document is the mean of its tokens' context vectors (for
tokens not met in training, their bucket's, which may be zero), beside the mean of their index vectors.

Tokens are runs of letters, digits or other marks. Beside each goes a token for its shape (a mark, lower,
upper, title or mixed case, or the same as the token before), so that case and repetition have vectors too.

The network has one hidden layer, trained by Adam in numpy on a bounded sample: SAMPLE labelled rows at
most, those with the smallest hashes of their ids among the rows that may be learnt from. A tenth of them
is held back to fit the temperature that calibrates the probabilities. All rows are scored, on whole texts.

Null texts count as empty; empty texts have zero vectors and still get a score. Repeated rows get equal
scores. Rows without a label or an id are scored but not learnt from. With no labelled row of either kind
the score is 0.5 for all rows, or the one label there is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 4000
BUCKETS = 1 << 14
WIDTH = 48
NONZERO = 6
REACH = 2
HIDDEN = 32
EPOCHS = 60
RATE = 0.01
THRESHOLD = 0.3
#: Tokens that are summed at a time.
CHUNK = 1 << 16

SHAPES = ("mark", "lower", "upper", "title", "mixed", "again")
_AGAIN = BUCKETS + SHAPES.index("again")

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+|\n+")


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def index_vectors(buckets: int = BUCKETS + len(SHAPES), width: int = WIDTH) -> np.ndarray:
    """NONZERO signed ones in the row of each bucket and, after them, of each shape."""
    rng = np.random.default_rng(0)
    places = rng.random((buckets, width)).argsort(axis=1)[:, :NONZERO]
    vectors = np.zeros((buckets, width), np.float32)
    np.put_along_axis(vectors, places, rng.choice(np.array([-1, 1], np.float32), places.shape), axis=1)
    return vectors


class Buckets(dict):
    """Tokens to the rows of the token and its shape; each is hashed once, and the table is emptied when it is full."""

    FULL = 400_000

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) >= self.FULL:
            self.clear()
        word = token[0].isalpha()
        shape = "mark" if not word else "lower" if token.islower() else "upper" if token.isupper() else "title" if token.istitle() else "mixed"
        seen = token.lower() if word else token[:3]
        self[token] = found = (xxhash.xxh32_intdigest(seen) % BUCKETS, BUCKETS + SHAPES.index(shape))
        return found

    def of(self, text: str | None) -> np.ndarray:
        tokens = _TOKEN.findall(text or "")
        ids = np.array(list(map(self.__getitem__, tokens)), np.int32).reshape(-1, 2)
        ids[1:][ids[1:, 0] == ids[:-1, 0], 1] = _AGAIN
        return ids


def pooled(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean of the rows of ``table`` over all tokens and shapes."""
    if not len(ids):
        return np.zeros(table.shape[1], np.float32)
    total = np.bincount(ids[:, 1] - BUCKETS, minlength=len(SHAPES)) @ table[BUCKETS:]
    words = ids[:, 0]
    for low in range(0, len(words), CHUNK):
        total = total + table[words[low : low + CHUNK]].sum(axis=0, dtype=np.float32)
    return (total / len(words)).astype(np.float32)


@dataclass
class Model:
    table: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, features: np.ndarray) -> np.ndarray:
        hidden = np.tanh((features - self.centre) / self.scale @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(features) / self.temperature, -50, 50)))


def context_table(documents: list[np.ndarray]) -> np.ndarray:
    """Index vectors beside context vectors, each context scaled to unit length."""
    index = index_vectors()
    context = np.zeros_like(index)
    for ids in documents:
        words = ids[:, 0]
        for step in range(1, REACH + 1):
            np.add.at(context, words[step:], index[words[:-step]])
            np.add.at(context, words[:-step], index[words[step:]])
    norms = np.linalg.norm(context, axis=1, keepdims=True)
    return np.hstack([index, context / np.where(norms > 0, norms, 1)]).astype(np.float32)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on rows that were not trained on."""
    grid = np.exp(np.linspace(np.log(0.2), np.log(8.0), 81))
    loss = [np.mean(np.logaddexp(0, np.where(labels == 1, -1, 1) * logits / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(documents: list[np.ndarray], labels: np.ndarray, seed: int = 0) -> Model:
    table = context_table(documents)
    x = np.stack([pooled(d, table) for d in documents]) if documents else np.zeros((0, table.shape[1]), np.float32)
    y = labels.astype(np.float32)
    wide = table.shape[1]
    rng = np.random.default_rng(seed)
    centre, scale = (x.mean(axis=0), x.std(axis=0) + 1e-4) if len(x) else (np.zeros(wide), np.ones(wide))
    weights = [rng.normal(0, wide**-0.5, (wide, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    if len(set(y.tolist())) < 2:
        level = 0.0 if not len(y) else 50.0 * (2 * y[0] - 1)
        return Model(table, centre, scale, weights[0], weights[1], np.zeros(HIDDEN), float(level), 1.0)
    order = rng.permutation(len(x))
    kept, used = order[: len(x) // 10], order[len(x) // 10 :]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    z, step = (x - centre) / scale, 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(used), max(1, len(used) // 64)):
            h = np.tanh(z[at] @ weights[0] + weights[1])
            d = (1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3][0], -50, 50))) - y[at]) / len(at)
            back = np.outer(d, weights[2]) * (1 - h**2)
            grads = [z[at].T @ back + 1e-4 * weights[0], back.sum(axis=0), h.T @ d + 1e-4 * weights[2], np.array([d.sum()])]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] = weights[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    model = Model(table, centre, scale, weights[0], weights[1], weights[2], float(weights[3][0]), 1.0)
    if len(kept):
        model.temperature = temperature(model.logits(x[kept]), y[kept])
    return model


def labelled_sample(df: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int) -> DataFrame:
    """``ids`` and ``y`` of the sample, ordered by id hash. The sample's ids are chosen before any text is read."""
    chosen = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("__id")).agg(F.max(label).alias("y"))
    few = chosen.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    joined = df.select(F.col(key).alias("__key"), F.col(text).alias("text")).join(F.broadcast(few), F.col("__key") == F.col("__id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for b in batches:
            ids = [buckets.of(t.as_py()).ravel() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int16())), b.column(2)], ["id", "ids", "y"])

    kind = dict(df.dtypes)[key]
    return joined.select("__key", "text", F.col("y").cast("int")).mapInArrow(run, f"id {kind}, ids array<smallint>, y int")


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE) -> Model:
    """Fit on the sample, in one task, which reads nothing but the tokens of the sample; one row, the model, comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        whole = [(k.as_py(), np.array(i.values.to_numpy()).reshape(-1, 2), y.as_py()) for b in batches for k, i, y in zip(*b.columns)]
        whole.sort(key=lambda r: (str(r[0]), len(r[1])))
        model = fit([r[1] for r in whole], np.array([r[2] for r in whole]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model.__dict__)], pa.binary())], ["model"])

    import pickle

    got = labelled_sample(df, labels, key, text, label, rows).repartition(1).mapInArrow(run, "model binary").collect()
    return Model(**pickle.loads(bytes(got[0]["model"]))) if got else fit([], np.empty(0))


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model.__dict__)  # a few megabytes, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, fitted = Buckets(), Model(**shared.value)
        for b in batches:
            features = np.stack([pooled(buckets.of(t.as_py()), fitted.table) for t in b.column(1)]) if b.num_rows else np.zeros((0, fitted.table.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fitted.scores(features).astype(np.float64))], ["doc_id", "held_out", "score"])

    kind = dict(df.dtypes)[key]
    scored = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), held_out(F.col(key)).alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def classify(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE) -> DataFrame:
    return score(df, train(df, labels, key, text, label, rows), key, text)

"""SentencePiece encoding by forward-filtering backward-sampling, and lossless decoding.

The lattice of a text holds every way to write it in pieces of a vocabulary; a segmentation has the
probability of the product of its pieces' weights, normalised. Forward filtering sums the weights of
all paths to each position; backward sampling then draws the last piece, the one before it, and so
on. Draws come from a hash of the seed, the row key, the word and the step, so a row's segmentation
depends on nothing but its key and text.

Pieces have a space marker only at their front, so a lattice falls apart into independent ones at
every run of spaces. Filtering is done once for each distinct word of a block of texts, for all words
together; draws are made for all occurrences together.

The vocabulary's scores are merge ranks, not log-probabilities, so a piece's weight is its rank to the
power of -ALPHA (Zipf's law). A character without a piece is written as its UTF-8 bytes.

Decoding joins the pieces' bytes and drops the marker put in front of a text. It is lossless for every
text: characters are never normalised, and a space marker that stands in a text is written as bytes.

Null texts have null ids; empty texts have no ids. Rows with a null key draw like key zero. Repeated
rows (same key and text) are segmented alike. Texts are handled whole, in blocks of BLOCK characters at
least, so memory follows the block and the longest text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 1.0
SEED = 10
BLOCK = 1_500_000
#: Characters of distinct words that are filtered together.
GROUP = 1 << 16
#: Words up to so long are filtered on weights scaled by SCALE a character, which stay far inside a
#: double's range; longer ones on logarithms.
PLAIN, SCALE = 32, 300.0

_MARK = "▁"
_OWN_MARK = "\ud800"  # stands for a marker in the text: no UTF-8 text holds a lone surrogate
_WORD = re.compile(" +[^ ]*")
_BYTES = -2
_NONE = -1
_STEP, _ROW, _WORDS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0xA0761D6478BD642F)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """A vocabulary as a trie in sorted arrays, with piece weights and the bytes each id stands for."""

    def __init__(self, model: bytes, alpha: float = ALPHA):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        self.byte_ids = np.full(256, -1, np.int32)
        self.bytes = [b""] * size
        normal = []
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if _MARK in piece.lstrip(_MARK):
                    raise ValueError(f"piece {i} has a space marker after its front")
                self.bytes[i] = piece.replace(_MARK, " ").encode()
                normal.append((i, piece.replace(_MARK, " "), sp.get_score(i)))
        ranks = {i: rank for rank, (i, _, _) in enumerate(sorted(normal, key=lambda x: -x[2]), 1)}
        self.log_weight = np.full(size + 2, -np.inf)
        self.log_weight[list(ranks)] = -alpha * np.log(list(ranks.values()))
        self.log_weight[_BYTES] = -2 * alpha * np.log(size)
        self.weight = np.exp(self.log_weight)
        self.longest = max(len(p) for _, p, _ in normal)
        states, edges, ids = {"": 0}, {}, {}
        for i, piece, _ in normal:
            for k in range(1, len(piece) + 1):
                if piece[:k] not in states:
                    states[piece[:k]] = len(states)
                edges[states[piece[: k - 1]] << 21 | ord(piece[k - 1])] = states[piece[:k]]
            ids[states[piece]] = i
        keys = sorted(edges)
        self.keys = np.array(keys + [1 << 62], np.int64)
        self.next = np.array([edges[k] for k in keys] + [0], np.int64)
        self.id_of = np.array([ids.get(s, _NONE) for s in range(len(states))], np.int16 if size < 1 << 15 else np.int32)

    def lattice(self, codes: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Ids by (start, length - 1). ``left``: characters from each start to the end of its word."""
        found = np.full((len(codes), self.longest), _NONE, self.id_of.dtype)
        at, state = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        for length in range(1, self.longest + 1):
            key = state << 21 | codes[at + length - 1]
            place = np.searchsorted(self.keys, key)
            on = self.keys[place] == key
            at, state = at[on], self.next[place[on]]
            found[at, length - 1] = self.id_of[state]
            on = left[at] > length
            at, state = at[on], state[on]
            if not len(at):
                break
        alone = found[:, 0] == _NONE
        found[alone, 0] = _BYTES
        return found


class Filtered:
    """Distinct words with, for each end position, the ids of the pieces that end there and the running
    sums of their probabilities given that the path passes."""

    def __init__(self, pieces: Pieces, words: list[str]):
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lengths, kind="stable")
        self.base = np.empty(len(words), np.int64)
        self.length = lengths
        total = int(lengths.sum())
        self.ids = np.full((total, pieces.longest), _NONE, pieces.id_of.dtype)
        self.upto = np.full((total, pieces.longest), 2, np.float32)
        self.codes = np.empty(total, np.int32)
        upto = np.concatenate([[0], np.cumsum(lengths[order])])
        long = int((lengths > PLAIN).sum())
        low = 0
        while low < len(words):
            high = max(int(np.searchsorted(upto, upto[low] + GROUP, side="right")) - 1, low + 1)
            high = min(high, long) if low < long else high
            part = order[low:high]
            self._filter(pieces, [words[k] for k in part.tolist()], lengths[part], part, int(upto[low]))
            low = high

    def _filter(self, pieces: Pieces, words: list[str], lengths: np.ndarray, part: np.ndarray, done: int) -> None:
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.int32)
        starts = np.cumsum(lengths) - lengths
        left = np.repeat(starts + lengths, lengths) - np.arange(len(codes))
        by_start = pieces.lattice(codes, left)
        widest = int(np.nonzero((by_start != _NONE).any(axis=0))[0].max()) + 1
        by_end, upto = self.ids[done : done + len(codes)], self.upto[done : done + len(codes)]
        for k in range(widest):
            by_end[k:, k] = by_start[: len(codes) - k, k]  # a piece of length k + 1 that starts at s ends at s + k
        known = by_end[:, :widest]
        plain = lengths[0] <= PLAIN
        # id -1 reads the last entry of the table and id -2 the one before: no piece, and a character's bytes
        weights = (pieces.weight[known] * SCALE ** np.arange(1, widest + 1)) if plain else pieces.log_weight[known]
        reached = np.full(len(codes) + len(words), float(plain))  # of all paths to a position; a place more for each word's front
        front = starts + np.arange(len(words))
        back = np.arange(1, widest + 1)
        count = len(words)
        for p in range(1, int(lengths[0]) + 1):
            while count and lengths[count - 1] < p:
                count -= 1
            width = min(p, widest)
            end, at = starts[:count] + p - 1, front[:count] + p
            before = reached[at[:, None] - back[:width]]
            if plain:
                summed = np.cumsum(weights[end, :width] * before, axis=1)
                reached[at] = summed[:, -1]
            else:
                score = weights[end, :width] + before
                top = score.max(axis=1)
                summed = np.cumsum(np.exp(score - top[:, None]), axis=1)
                reached[at] = top + np.log(summed[:, -1])
            upto[end, :width] = summed / summed[:, -1:]
        self.codes[done : done + len(codes)] = codes
        self.base[part] = starts + done


def _draw(pieces: Pieces, table: Filtered, word: np.ndarray, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all occurrences in order, and how many each has. ``stream``: a random state for each occurrence."""
    end, base = table.base[word] + table.length[word], table.base[word]
    count = np.zeros(len(word), np.int64)
    steps, live = [], np.arange(len(word))
    step = 0
    while len(live):
        row = end[live] - 1
        uniform = (_mixed(stream[live] + np.uint64(step * int(_STEP) % (1 << 64))) >> np.uint64(40)).astype(np.float32) * np.float32(2**-24)
        size = (table.upto[row] <= uniform[:, None]).sum(axis=1) + 1
        ids = table.ids[row, size - 1].astype(np.int32)
        raw = np.nonzero(ids == _BYTES)[0]
        if len(raw):  # a character as bytes, the last of them first
            sizes = np.ones(len(live), np.int64)
            values = []
            for k, code in zip(raw.tolist(), table.codes[row[raw]].tolist()):
                data = (_MARK if code == ord(_OWN_MARK) else chr(code)).encode()
                sizes[k] = len(data)
                values.append(pieces.byte_ids[list(data)])
            flat = np.repeat(ids, sizes)
            flat[np.repeat(ids == _BYTES, sizes)] = np.concatenate(values)
            into = np.cumsum(sizes) - sizes
            place = np.repeat(count[live] + sizes - 1, sizes) - (np.arange(len(flat)) - np.repeat(into, sizes))
            steps.append((np.repeat(live, sizes), place, flat))
            count[live] += sizes
        else:
            steps.append((live, count[live], ids))
            count[live] += 1
        end[live] -= size
        live = live[end[live] > base[live]]
        step += 1
    last = np.cumsum(count) - 1
    out = np.empty(int(count.sum()), np.int32)
    for who, place, ids in steps:
        out[last[who] - place] = ids
    return out, count


def encode(pieces: Pieces, keys: list[int], texts: list[str], seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, and the number of ids of each."""
    found = [_WORD.findall(" " + t.replace(_MARK, _OWN_MARK)) if t else [] for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    at = int(sizes.sum())
    if not at:
        return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
    places: dict[str, int] = {}
    word = np.fromiter((places.setdefault(w, len(places)) for words in found for w in words), np.int64, at)
    table = Filtered(pieces, list(places))
    row = _mixed(np.array(keys, np.int64).view(np.uint64) + np.uint64(seed * int(_ROW) % (1 << 64)))
    starts = np.cumsum(sizes) - sizes
    nth = (np.arange(at) - np.repeat(starts, sizes)).astype(np.uint64)
    ids, count = _draw(pieces, table, word, _mixed(np.repeat(row, sizes) + nth * _WORDS))
    upto = np.concatenate([[0], np.cumsum(count)])
    return ids, upto[starts + sizes] - upto[starts]


def decode(pieces: Pieces, ids: list[int]) -> str:
    """The text of one row's ids."""
    return b"".join(map(pieces.bytes.__getitem__, ids))[1:].decode()


def _key(value) -> int:
    """An integer key as it is, any other by a hash of its text."""
    if value is None:
        return 0
    if isinstance(value, int):
        return value
    import xxhash

    return xxhash.xxh64_intdigest(str(value)) - (1 << 63)


def encode_sampled(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """Per row: key, ``n_pieces``, ``ids`` and ``lossless`` (whether the ids decode to the text)."""
    with open(vocabulary, "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model, alpha)
        for batch in batches:
            low, chars = 0, 0
            lengths = pa.compute.coalesce(pa.compute.utf8_length(batch.column(1)), 0).to_pylist()
            for high in range(1, batch.num_rows + 1):
                chars += lengths[high - 1]
                if chars >= BLOCK or high == batch.num_rows:
                    yield one(pieces, batch.slice(low, high - low))
                    pa.default_memory_pool().release_unused()
                    low, chars = high, 0

    def one(pieces: Pieces, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        ids, sizes = encode(pieces, [_key(k) for k in batch.column(0).to_pylist()], [t or "" for t in texts], seed)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        values = ids.tolist()
        same = [t is None or decode(pieces, values[a:b]) == t for t, a, b in zip(texts, offsets[:-1].tolist(), offsets[1:].tolist())]
        nulls = pa.array([t is None for t in texts])
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=nulls)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), lists, pa.array(same)], ["doc_id", "n_pieces", "ids", "lossless"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_pieces long, ids array<int>, lossless boolean")


def decoded(df: DataFrame, key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``text`` from the rows of ``encode_sampled``."""
    with open(vocabulary, "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in batches:
            texts = [None if ids is None else decode(pieces, ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("doc_id"), "ids").mapInArrow(run, f"doc_id {kind}, text string")

"""Chat formatting: a hidden Markov model recovers the turns of a raw transcript, which are then rendered.

A transcript is lines of text in which speakers are marked in some style, or not at all. The model has a
state for the first and one for the further lines of each role. A line shows four features: the class of
its speaker marker (a word known for a role, none, or an unknown word, by its turn among the unknown ones of the
transcript and their number, so names tell speakers apart without being known), its length, whether it ends as a
question, and whether a blank line stands before it. Start, transition and feature probabilities are
counted on labelled transcripts, with add-one smoothing, and the roles are the Viterbi path.

Turns are rendered as ``<|im_start|>role``, the text without its marker, ``<|im_end|>``. Those two
openings inside a text are set apart by a space, so that a rendering can be read back.

Null and empty transcripts have no turns and render to an empty text; repeated rows render alike; ties of
paths go to the earlier state. Transcripts are handled row by row, in memory in proportion to their text: the
path is found over the whole transcript, however long.

``transcripts`` makes raw transcripts from a table of turns, one for each conversation, from a sorted stream:
a task holds one conversation at a time. (A transcript is one value, so a conversation must fit in a row, 2 GB.)
Rows without a conversation are one of their own; rows without a turn sort first; ties of turns go by text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
STATES = tuple((role, first) for role in ROLES for first in (True, False))
#: Conversations, by smallest hash of their id, whose transcripts the model is counted on.
SAMPLE = 500

#: Marker styles of raw transcripts: system, user, assistant.
STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("Context: ", "Human: ", "AI: "),
    ("### System:\n", "### Instruction:\n", "### Response:\n"),
    ("Note: ", "Q: ", "A: "),
    ("[system] ", "[user] ", "[bot] "),
    ("admin> ", "guest> ", "helper> "),
    ("Priya: ", "Ben: ", "Ilse: "),
    ("<stage> ", "<caller> ", "<desk> "),
)
_KNOWN = {
    "system": ("system", "context", "sys", "note", "instructions"),
    "user": ("user", "human", "q", "question", "customer", "instruction", "me", "guest", "prompter"),
    "assistant": ("assistant", "ai", "a", "answer", "bot", "response", "model", "agent", "helper"),
}
_CLASS = {word: role for role, words in _KNOWN.items() for word in words}
#: Unknown marker words of a transcript told apart, by turn and number; further ones are "other".
APART = 3
_CLASSES = (*ROLES, "none", "other", *(f"{turn} of {number}" for number in range(1, APART + 1) for turn in range(1, number + 1)))
_MARKER = re.compile(r"\s*(?:#{2,4}\s*([A-Za-z]{1,16})\s*:?|\[([A-Za-z]{1,16})\]:?|\*\*([A-Za-z]{1,16}):?\*\*:?|<\|?([A-Za-z]{1,16})\|?>:?|([A-Za-z]{1,16})\s?[:>](?=\s|$))[ \t]*")
_SIZES = (len(_CLASSES), 4, 2, 2)


def marker(line: str) -> tuple[str | None, int]:
    """The word of a line's speaker marker and where the text after it starts."""
    found = _MARKER.match(line)
    return (next(g for g in found.groups() if g).lower(), found.end()) if found else (None, 0)


def classes_of(words: list[str | None]) -> list[int]:
    """The class of each line's marker word."""
    unknown = list(dict.fromkeys(w for w in words if w and w not in _CLASS))
    turn = {w: f"{k} of {len(unknown)}" if len(unknown) <= APART else "other" for k, w in enumerate(unknown, 1)}
    return [_CLASSES.index("none" if w is None else _CLASS.get(w) or turn[w]) for w in words]


def features(lines: list[str]) -> np.ndarray:
    """One row for each line that is not blank: marker class, length, question, blank line before."""
    rows, words, blank = [], [], False
    for line in lines:
        bare = line.strip()
        if not bare:
            blank = True
            continue
        size = len(bare)
        words.append(marker(line)[0])
        rows.append(((size > 30) + (size > 90) + (size > 250), bare[-1] in "?？", blank))
        blank = False
    return np.column_stack([np.array(classes_of(words), np.int64).reshape(-1, 1), np.array(rows, np.int64).reshape(-1, 3)])


@dataclass
class Model:
    start: np.ndarray
    step: np.ndarray
    shows: list[np.ndarray]

    def roles(self, seen: np.ndarray) -> list[int]:
        """The likeliest state of each line."""
        if not len(seen):
            return []
        shown = sum(table[:, seen[:, k]] for k, table in enumerate(self.shows)).T
        back = np.empty((len(seen), len(STATES)), np.int8)
        now = self.start + shown[0]
        for t in range(1, len(seen)):
            paths = now[:, None] + self.step
            back[t] = paths.argmax(axis=0)
            now = paths.max(axis=0) + shown[t]
        path = [int(now.argmax())]
        for t in range(len(seen) - 1, 0, -1):
            path.append(int(back[t, path[-1]]))
        return path[::-1]


def _logged(counts: np.ndarray) -> np.ndarray:
    return np.log((counts + 1) / (counts + 1).sum(axis=-1, keepdims=True))


def counted(rows: list[tuple[str, int, int, int]]) -> Model:
    """The model from counts: ("start", state, 0, n), ("step", state, state, n) and (feature number, state, value, n)."""
    n = len(STATES)
    start, step, shows = np.zeros(n), np.zeros((n, n)), [np.zeros((n, size)) for size in _SIZES]
    for what, a, b, count in rows:
        if what == "start":
            start[a] += count
        elif what == "step":
            step[a, b] += count
        else:
            shows[int(what)][a, b] += count
    impossible = np.array([[(not later) and role != other for other, later in STATES] for role, _ in STATES])  # further lines keep the role
    return Model(np.where([first for _, first in STATES], _logged(start), -np.inf), np.where(impossible.reshape(n, n), -np.inf, _logged(step)), [_logged(s) for s in shows])


def path_of(model: Model, text: str | None) -> tuple[list[str], list[int]]:
    """The lines of a transcript, and the likeliest state of each that is not blank."""
    lines = (text or "").replace("\r\n", "\n").split("\n")
    return lines, model.roles(features(lines))


def turns(model: Model, text: str | None) -> list[tuple[str, str]]:
    """Role and text of each turn of a transcript."""
    return turns_on(*path_of(model, text))


def turns_on(lines: list[str], states: list[int]) -> list[tuple[str, str]]:
    path = iter(states)
    found: list[tuple[str, list[str]]] = []
    for line in lines:
        if not line.strip():
            if found:
                found[-1][1].append("")
            continue
        role, first = STATES[next(path)]
        if first or not found:
            found.append((role, []))
            line = line[marker(line)[1] :]
        found[-1][1].append(line)
    return [(role, "\n".join(body).strip()) for role, body in found]


def rendered(found: list[tuple[str, str]]) -> str:
    safe = lambda t: t.replace("<|im_", "< |im_")
    return "".join(f"<|im_start|>{role}\n{safe(body)}<|im_end|>\n" for role, body in found)


def transcript(conversation: str, rows: list[tuple[str | None, str | None]]) -> tuple[str, list[int]]:
    """A raw transcript of role and text rows in the style of this conversation, and the state of each line
    that is not blank. About one turn in ten has no marker; unknown roles are written as users."""
    style = STYLES[xxhash.xxh32_intdigest(conversation) % len(STYLES)]
    lines, states = [], []
    for k, (role, text) in enumerate(rows):
        number = ROLES.index(role) if role in ROLES else 1
        bare = xxhash.xxh32_intdigest(f"{conversation} {k}") % 10 == 0
        written = ("" if bare else style[number]) + (text or "")
        first = True
        for line in written.split("\n"):
            if line.strip():
                states.append(2 * number + (not first))
                first = False
            lines.append(line)
    return "\n".join(lines), states


def transcripts(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id``, ``text``, ``states`` (of its lines) from one row for each turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("text", pa.string()), ("states", pa.list_(pa.int32()))])
        key, held, done = None, [], []

        def flush() -> None:
            if held:
                done.append((key, *transcript(str(key), held)))
                held.clear()

        for batch in batches:
            for conv, who, said in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != key:
                    flush()
                    key = conv
                held.append((who, said))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), schema.types)], schema=schema)
                done = []
        flush()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), schema.types)], schema=schema)

    rows = df.select(F.col(conversation).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "text", "role")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, text string, states array<int>")


def train(labelled: DataFrame) -> Model:
    """Count the model on rows of ``text`` and ``states``. Only counts by state and feature value come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, int, int]] = Counter()
        for batch in batches:
            for text, states in zip(*(c.to_pylist() for c in batch.columns)):
                if not states:
                    continue
                counts["start", states[0], 0] += 1
                counts.update(("step", a, b) for a, b in zip(states, states[1:]))
                for k, column in enumerate(features(text.split("\n")).T.tolist()):
                    counts.update((str(k), s, v) for s, v in zip(states, column))
        rows = [(*k, n) for k, n in counts.items()]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, kinds)], ["what", "a", "b", "n"])

    found = labelled.select("text", "states").mapInArrow(run, "what string, a int, b int, n long")
    return counted([tuple(r) for r in found.groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()])


def parse_transcripts(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``roles`` (of the turns), ``chat`` (their rendering) and ``path`` (the states of the lines that are not blank)."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                paths = [path_of(model, t.as_py()) for t in part.column(names.index(text))]
                found = [turns_on(*p) for p in paths]
                extra = [pa.array([[r for r, _ in f] for f in found], pa.list_(pa.string())), pa.array([rendered(f) for f in found], pa.string()), pa.array([p[1] for p in paths], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], [*names, "roles", "chat", "path"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", roles array<string>, chat string, path array<int>"
    return df.mapInArrow(run, schema)


def _roles_of(states: Column) -> Column:
    names = F.array(*[F.lit(role) for role, _ in STATES])
    firsts = F.filter(states, lambda s: s % 2 == 0)
    return F.transform(firsts, lambda s: F.get(names, s))


def format_conversations(df: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Raw transcripts of all conversations, parsed and rendered: ``conv_id``, ``n_turns``, ``roles``, ``chat``,
    ``recovered`` (whether the roles are those the transcript was written from) and ``lines_right`` (the share of
    lines whose role is)."""
    raw = transcripts(df)
    few = df.select(F.col("conv_id").alias("__id")).where("conv_id IS NOT NULL").distinct().orderBy(F.xxhash64("__id"), "__id").limit(sample)
    chosen = df.join(F.broadcast(few), F.col("conv_id") == F.col("__id"), "left_semi")
    parsed = parse_transcripts(raw, train(transcripts(chosen)))
    right = F.size(F.filter(F.zip_with("path", "states", lambda a, b: F.floor(a / 2) == F.floor(b / 2)), lambda same: same))
    return parsed.select(
        "conv_id",
        F.size("roles").cast("long").alias("n_turns"),
        "roles",
        "chat",
        (F.col("roles") == _roles_of(F.col("states"))).alias("recovered"),
        F.when(F.size("states") == 0, 1.0).otherwise(right / F.size("states")).alias("lines_right"),
    )

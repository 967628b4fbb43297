"""Chat transcripts: roles recovered by a hidden Markov model, turns rendered canonically.

The hidden states are (role, first line of a turn or a later one). A line shows
its speaker marker if it has one, whether it begins a block (a row of the
input), the length of the block, its own length and whether it asks. Transitions
and lengths are counted on the rows whose roles are known; markers and block
starts have stated chances. Viterbi finds the best roles.

A conversation of any length is decoded in parts: for each part of `part` turns
the best score from every state before it to every state at its end is one
small matrix. Matrices are chained in order, then backwards, and each part is
decoded between its two known ends. No task ever holds more than one part.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chronoweave.llm.session import ship
from pyspark.sql.pandas.types import to_arrow_type as arrow_type

ROLES = ("system", "user", "assistant")
#: What speakers are called in transcripts.
NAMES = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "question", "prompter", "customer", "instruction", "input", "q"),
    "assistant": ("assistant", "ai", "bot", "gpt", "answer", "response", "model", "agent", "output", "a"),
}
_ROLE = {n: r for r, role in enumerate(ROLES) for n in NAMES[role]}
_MARKER = re.compile(
    r"^\s*(?:<\|(?:im_start\|>)?\s*(?P<a>[a-z]+)\s*(?:\|>)?|\[(?P<b>[a-z]+)\]\s*:?|#{2,}\s*(?P<c>[a-z]+)\s*:?|\*\*(?P<d>[a-z]+)\s*:?\*\*\s*:?|(?P<e>[a-z]+)\s*:(?=\s|$))\s*",
    re.I,
)
_N = 2 * len(ROLES)
_LENGTHS = 12
#: Chances of a marker on a first line: the right one, another one, none; of one on a later line; and of a block's first line in either.
_RIGHT, _WRONG, _NONE, _LATER = 0.92, 0.01, 0.06, 0.001
_BLOCK_FIRST = {"first": 0.7, "later": 0.03}


def marker(line: str) -> tuple[int, int]:
    """(role, length of the marker) of a line; (-1, 0) without one."""
    m = _MARKER.match(line)
    r = _ROLE.get((m["a"] or m["b"] or m["c"] or m["d"] or m["e"]).lower(), -1) if m else -1
    return (r, m.end()) if r >= 0 else (-1, 0)


def _bucket(n: int) -> int:
    return min(_LENGTHS - 1, n.bit_length())


def observed(text: str | None, role: str | None) -> list[tuple[int, int, int, int, int]]:
    """Of each line of a block: marker + 1, first of its block, length of the block (0 on later lines), its length, whether it asks."""
    text = text or ""
    out = []
    for i, line in enumerate(text.split("\n")):
        r, at = marker(line)
        if r < 0 and i == 0 and role:
            r = _ROLE.get(role.lower(), -1)
        out.append((r + 1, int(i == 0), _bucket(len(text)) if i == 0 else 0, _bucket(len(line) - at), int(line.rstrip().endswith("?"))))
    return out


@dataclass
class Model:
    """Log chances: of the first state, of transitions, and of each feature's values in a state."""

    first: np.ndarray
    move: np.ndarray
    features: list[np.ndarray]

    def emit(self, seen: list[tuple[int, int, int, int, int]]) -> np.ndarray:
        x = np.array(seen, np.int64).reshape(-1, 5)
        return sum((f[:, x[:, i]] for i, f in enumerate(self.features))).T


def _markers() -> np.ndarray:
    out = np.full((_N, len(ROLES) + 1), math.log(_LATER))
    for r in range(len(ROLES)):
        out[2 * r] = math.log(_WRONG)
        out[2 * r, 0], out[2 * r, r + 1] = math.log(_NONE), math.log(_RIGHT)
        out[2 * r + 1, 0] = math.log(1 - 3 * _LATER)
    return out


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(keys, rows) of each run of equal keys in sorted batches."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key is not None and row[:n_keys] != key:
                yield key, rows
                rows = []
            key = row[:n_keys]
            rows.append(row[n_keys:])
    if rows:
        yield key, rows


def _by_parts(df: DataFrame, then: Callable, schema: str) -> DataFrame:
    return df.repartition("key", "part").sortWithinPartitions("key", "part", "turn", "role", "text").mapInArrow(then, schema)


def _rows(chats: DataFrame, key: str, turn: str, text: str, role: Column, part: int) -> DataFrame:
    at = F.floor(F.coalesce(F.col(turn).cast("double"), F.lit(0.0)) / part).cast("long")
    return chats.select(F.col(key).alias("key"), at.alias("part"), F.col(turn).alias("turn"), role.cast("string").alias("role"), F.col(text).alias("text"))


def fit(chats: DataFrame, key: str = "conv_id", turn: str = "turn", text: str = "text", role: str = "role", part: int = 256) -> Model:
    """Count transitions and features over all rows with a known role; the counts are a few hundred numbers."""
    ship(chats.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int, int], int] = {}
        for (_, at), rows in _groups(batches, 2):
            last = -1 if at == 0 else -2
            for _, name, t in rows:
                r = _ROLE.get((name or "").lower(), -1)
                if r < 0:
                    last = -2
                    continue
                for i, o in enumerate(observed(t, None)):
                    s = 2 * r + (i > 0)
                    pairs = [(f, s, o[f]) for f in range(2, 5)]
                    if last >= -1:
                        pairs.append((5, last, s))
                    for p in pairs:
                        seen[p] = seen.get(p, 0) + 1
                    last = s
        if seen:
            cols = list(zip(*((*k, n) for k, n in seen.items()), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["f", "a", "b", "n"])

    rows = _rows(chats, key, turn, text, F.col(role), part)
    found = _by_parts(rows, count, "f long, a long, b long, n long").groupBy("f", "a", "b").agg(F.sum("n").alias("n")).collect()
    features = [np.zeros((_N, n)) for n in (1, 2, _LENGTHS, _LENGTHS, 2)]
    first, move = np.full(_N, 0.1), np.full((_N, _N), 0.1)
    for r in found:
        if r["f"] < 5:
            features[r["f"]][r["a"], r["b"]] += r["n"]
        elif r["a"] < 0:
            first[r["b"]] += r["n"]
        else:
            move[r["a"], r["b"]] += r["n"]
    logs = [np.log((f + 0.5) / (f + 0.5).sum(1, keepdims=True)) for f in features]
    logs[2][:, 0] = 0.0  # later lines of a block say nothing of its length
    begins = np.log([[1 - p, p] for p in _BLOCK_FIRST.values()] * len(ROLES))
    return Model(np.log(first / first.sum()), np.log(move / move.sum(1, keepdims=True)), [_markers(), begins, *logs[2:]])


def through(model: Model, emit: np.ndarray, start: bool) -> np.ndarray:
    """Best score from each state before the lines (or from the start: one row) to each state at their end."""
    m = (model.first + emit[0])[None, :] if start else model.move + emit[0]
    for e in emit[1:]:
        m = (m[:, :, None] + model.move[None]).max(1) + e
    return m


def viterbi(model: Model, emit: np.ndarray, before: np.ndarray | None = None, last: int | None = None) -> list[int]:
    """The best states of the lines, given the scores of the states before them and the state of the last one."""
    score = model.first + emit[0] if before is None else (before[:, None] + model.move).max(0) + emit[0]
    back = []
    for e in emit[1:]:
        step = score[:, None] + model.move
        back.append(step.argmax(0))
        score = step.max(0) + e
    states = [int(score.argmax()) if last is None else last]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return states[::-1]


def render(chats: DataFrame, model: Model, key: str = "conv_id", turn: str = "turn", text: str = "text", role: Column | str | None = "role", part: int = 256) -> DataFrame:
    """key, turn, piece, role, starts and rendered: the stretches of each row that belong to one role, in order.

    role gives the marker of a row's first line where the text has none (null: no
    marker). Markers are taken out of the text. rendered is the stretch with the
    turn's opening line `<|role|>` where one starts; put together by (turn,
    piece), they are the canonical transcript. Null texts are empty lines; rows
    of one turn number are in order of role and text; unknown roles are no marker.
    """
    ship(chats.sparkSession)
    given = F.lit(None) if role is None else F.col(role) if isinstance(role, str) else role
    rows = _rows(chats, key, turn, text, given, part)
    key_kind, turn_kind = (chats.schema[c].dataType for c in (key, turn))
    key_type, turn_type, floats = arrow_type(key_kind), arrow_type(turn_kind), pa.list_(pa.float64())
    key_name, turn_name = key_kind.simpleString(), turn_kind.simpleString()

    def emitted(group: list[tuple]) -> np.ndarray:
        return model.emit([o for _, name, t in group for o in observed(t, name)])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for (k, at), group in _groups(batches, 2):
            e = emitted(group)
            found.append((k, at, through(model, e, True).ravel().tolist(), through(model, e, False).ravel().tolist()))
            if len(found) == 500:
                yield _batch(found, [key_type, pa.int64(), floats, floats], ["key", "part", "s", "m"])
                found = []
        if found:
            yield _batch(found, [key_type, pa.int64(), floats, floats], ["key", "part", "s", "m"])

    def forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, score = object(), None
        for batch in batches:
            out = []
            for k, at, s, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                before = score if k == last else None
                m = np.array(m).reshape(_N, _N)
                out.append((k, at, None if before is None else before.tolist(), m.ravel().tolist(), s))
                score = np.array(s) if before is None else (before[:, None] + m).max(0)
                last = k
            yield _batch(out, [key_type, pa.int64(), floats, floats, floats], ["key", "part", "before", "m", "s"])

    def backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, end = object(), 0
        for batch in batches:
            out = []
            for k, at, before, m, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b, m = None if before is None else np.array(before), np.array(m).reshape(_N, _N)
                if k != last:
                    end = int(np.argmax(s) if b is None else (b[:, None] + m).max(0).argmax())
                out.append((k, at, before, end))
                end = end if b is None else int((b + m[:, end]).argmax())
                last = k
            yield _batch(out, [key_type, pa.int64(), floats, pa.int32()], ["key", "part", "before", "end"])

    array = "array<double>"
    steps = _by_parts(rows, matrices, f"key {key_name}, part long, s {array}, m {array}")
    steps = steps.repartition("key").sortWithinPartitions("key", "part").mapInArrow(forwards, f"key {key_name}, part long, before {array}, m {array}, s {array}")
    ends = steps.sortWithinPartitions("key", F.desc("part")).mapInArrow(backwards, f"key {key_name}, part long, before {array}, end int")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, turn, "piece", "role", "starts", "rendered"]
        kinds = [key_type, turn_type, pa.int32(), pa.string(), pa.bool_(), pa.string()]
        out = []
        for (k, _), group in _groups(batches, 2):
            _, _, _, _, before, end = group[0]
            own = [g[1:4] for g in group[1:]]
            states = viterbi(model, emitted(own), None if before is None else np.array(before), end)
            at = 0
            for number, name, t in own:
                pieces: list[tuple[int, bool, list[str]]] = []
                for i, line in enumerate((t or "").split("\n")):
                    state = states[at]
                    at += 1
                    line = line[marker(line)[1] :]
                    if i and state % 2 and pieces[-1][0] == state // 2:
                        pieces[-1][2].append(line)
                    else:
                        pieces.append((state // 2, state % 2 == 0, [line]))
                out += [(k, number, p, ROLES[r], first, (f"<|{ROLES[r]}|>\n" if first else "") + "\n".join(ls) + "\n") for p, (r, first, ls) in enumerate(pieces)]
            if len(out) >= 2_000:
                yield _batch(out, kinds, names)
                out = []
        if out:
            yield _batch(out, kinds, names)

    nothing = {"turn": turn_name, "role": "string", "text": "string"}
    lead = ends.select("key", "part", F.lit(0).alias("kind"), *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()), "before", "end")
    body = rows.select("key", "part", F.lit(1).alias("kind"), "turn", "role", "text", F.lit(None).cast(array).alias("before"), F.lit(None).cast("int").alias("end"))
    both = lead.unionByName(body).repartition("key", "part").sortWithinPartitions("key", "part", "kind", "turn", "role", "text")
    return both.mapInArrow(decode, f"`{key}` {key_name}, `{turn}` {turn_name}, piece int, role string, starts boolean, rendered string")


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

"""Chat formatting: roles of a transcript's lines by a hidden Markov model, then canonical turns.

The lines of a conversation are the observations, their speakers' roles the hidden states. A line
shows a speaker marker (the turn's own, or one that starts the line), whether it opens a turn, and
coarse features (question, code fence, length). Transitions and feature probabilities are counted over
all turns whose marker is known; how far a marker is trusted is a parameter. Viterbi finds the roles.

A conversation may be longer than a task can hold, so it is cut into blocks of BLOCK turn numbers.
Viterbi's step is a product of matrices in the (max, +) algebra, which is associative: each block first
gives one matrix (best score from any role before it to any role at its end), a scan over a
conversation's matrices fixes the roles at the block borders, and each block is then decoded between
them. The result is that of one pass over the whole conversation.

Defined cases: a NULL or unknown marker is no marker; a NULL or empty text is one empty line; a NULL
conversation id or turn is a value of its own and comes first; turns that share a number are ordered by
text, and equal rows each give their segments; extra columns are left out; an empty table gives none.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from mailstrata.llm.common import named
from mailstrata.session import ship_package

ROLES = ("system", "user", "assistant")
#: Spellings of speaker markers by role (fixed values).
SPELLINGS = {
    "system": ("system", "sys", "instruction", "instructions"),
    "user": ("user", "human", "prompter", "customer", "question", "q"),
    "assistant": ("assistant", "bot", "ai", "gpt", "model", "chatbot", "agent", "answer", "a"),
}
BLOCK = 256
#: Probability that a marker, where there is one, names the right role.
TRUST = 0.995
#: Probability that a line inside a turn changes the speaker.
SWITCH = 0.02
_MARKER = re.compile(r"^\s*(?:[#*\[<|>]*\s*)(" + "|".join(
    s for spellings in SPELLINGS.values() for s in sorted(spellings, key=len, reverse=True) if len(s) > 2)
    + r")\s*(?:\|>|[\]>*]*\s*[:>\]])\s*", re.IGNORECASE)
_OF = {s: k for k, role in enumerate(ROLES) for s in SPELLINGS[role]}
_LENGTHS = (0, 20, 80, 320)  # lower bounds of the length classes
_FEATURES = 2 * 2 * len(_LENGTHS)


def marker_code(marker: Column) -> Column:
    """Number of the role a marker names, -1 for none."""
    word = F.lower(F.regexp_replace(F.coalesce(marker.cast("string"), F.lit("")), r"[^\p{L}]", ""))
    out = F.lit(-1)
    for k, role in enumerate(ROLES):
        out = F.when(word.isin(list(SPELLINGS[role])), k).otherwise(out)
    return out.cast("int")


def _feature(question: Column, fence: Column, length: Column) -> Column:
    size = sum((F.when(length >= b, 1).otherwise(0) for b in _LENGTHS[1:]), F.lit(0))
    return (F.when(question, 1).otherwise(0) * 2 + F.when(fence, 1).otherwise(0)) * len(_LENGTHS) + size


def _features(text: Column) -> Column:
    """Feature number of every line of a text."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: _feature(
        line.rlike(r"\?\s*$"), line.startswith("```"), F.length(line)))


def turns(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", marker: str = "role",
          text: str = "text") -> DataFrame:
    """(conv_id, block, turn, marker, features, text): one row per turn; block bounds a task's share."""
    number = named(turn).cast("long")
    body = F.coalesce(named(text).cast("string"), F.lit(""))
    return df.select(named(conversation).cast("long").alias("conv_id"), number.alias("turn"),
                     F.floor(F.coalesce(number, F.lit(0)) / BLOCK).cast("long").alias("block"),
                     marker_code(named(marker)).alias("marker"), _features(body).alias("features"), body.alias("text"))


def train(rows: DataFrame) -> dict[str, list]:
    """Log-probabilities, counted over all turns with a known marker; the counts are a few dozen rows."""
    labelled = rows.where("marker >= 0").select("conv_id", "turn", "marker", "features")
    seen = labelled.select("marker", F.explode("features").alias("feature")).groupBy("marker", "feature").count()
    # The speaker before a turn is that of the turn one lower: a join, which no long conversation can skew.
    # Rows that share a turn are counted first, so a turn gives as many joined rows as there are pairs of roles.
    sides = labelled.groupBy("conv_id", "turn", "marker").count()
    after = sides.select("conv_id", "turn", F.col("marker").alias("now"), F.col("count").alias("n"))
    before = sides.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("marker").alias("was"), F.col("count").alias("m"))
    steps = after.join(before, ["conv_id", "turn"]).groupBy("was", "now").agg(F.sum(F.col("n") * F.col("m")).alias("count"))
    first = labelled.where("turn = 0").groupBy("marker").count()
    n = len(ROLES)
    emit, move, start = np.ones((n, _FEATURES)), np.ones((n, n)), np.ones(n)
    for r in seen.collect():
        emit[r["marker"], r["feature"]] += r["count"]
    for r in steps.collect():
        move[r["was"], r["now"]] += r["count"]
    for r in first.collect():
        start[r["marker"]] += r["count"]
    stay = np.full((n, n), SWITCH / (n - 1)) + np.eye(n) * (1 - SWITCH - SWITCH / (n - 1))
    return {"emit": np.log(emit / emit.sum(axis=1, keepdims=True)).tolist(),
            "move": np.log(move / move.sum(axis=1, keepdims=True)).tolist(),
            "start": np.log(start / start.sum()).tolist(), "stay": np.log(stay).tolist()}


def observed(rows: list[dict]) -> tuple[list[tuple[int, int]], list[int], list[int], list[bool]]:
    """Per line of the sorted turns: (turn row, line), marker code, feature, and whether it opens a turn."""
    places, markers, features, opens = [], [], [], []
    for row, turn in enumerate(rows):
        for line, (code, body) in enumerate(zip(turn["features"], turn["text"].split("\n"))):
            found = _MARKER.match(body)
            own = _OF.get(found.group(1).lower(), -1) if found else -1
            places.append((row, line))
            markers.append(own if own >= 0 else (turn["marker"] if line == 0 else -1))
            features.append(code)
            opens.append(line == 0)
    return places, markers, features, opens


def steps_of(model: dict) -> np.ndarray:
    """Matrix of every kind of line, by whether it opens a turn, its marker (last: none) and its feature:
    score of being in role j at the line after role i before it."""
    n = len(ROLES)
    emit, move, stay = np.array(model["emit"]), np.array(model["move"]), np.array(model["stay"])
    trusted = np.zeros((n + 1, n))
    trusted[:n] = math.log((1 - TRUST) / (n - 1))
    trusted[np.arange(n), np.arange(n)] = math.log(TRUST)
    return np.stack([stay, move])[:, None, None] + trusted[None, :, None, None, :] + emit.T[None, None, :, None, :]


def scores(steps: np.ndarray, markers: list[int], features: list[int], opens: list[bool]) -> np.ndarray:
    """One matrix per line."""
    return steps[np.array(opens, dtype=np.int64), np.array(markers), np.array(features)]


def product(matrices: np.ndarray) -> np.ndarray:
    """The (max, +) product; halves are multiplied pairwise, as the product is associative."""
    while len(matrices) > 1:
        odd = matrices[len(matrices) // 2 * 2:]
        pairs = (matrices[:-1:2][: len(matrices) // 2, :, :, None] + matrices[1::2][:, None, :, :]).max(axis=2)
        matrices = np.concatenate((pairs, odd))
    return matrices[0]


def decode(matrices: np.ndarray, entry: np.ndarray, last: int) -> list[int]:
    """Best roles of a block's lines, given the scores before it and the role at its last line."""
    best, back = entry, []
    for m in matrices:
        step = best[:, None] + m
        back.append(step.argmax(axis=0))
        best = step.max(axis=0)
    roles = [last]
    for pointers in back[:0:-1]:
        roles.append(int(pointers[roles[-1]]))
    return roles[::-1]


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, list[dict]]]:
    """Consecutive rows with equal keys; one run at a time is held."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            own = tuple(row[k] for k in keys)
            if rows and own != key:
                yield key, rows
                rows = []
            key = own
            rows.append(row)
    if rows:
        yield key, rows


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    kept = []
    for row in rows:
        kept.append(row)
        if len(kept) == 4096:
            yield pa.RecordBatch.from_pylist(kept, schema=schema)
            kept = []
    if kept:
        yield pa.RecordBatch.from_pylist(kept, schema=schema)


def _stage(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], work: Callable, ddl: str) -> DataFrame:
    """``work`` of every run of rows with equal keys, sorted by ``order``; tasks hold many runs."""
    kind = StructType.fromDDL(ddl)
    schema = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = (row for key, rows in _runs(batches, *keys) for row in work(key, rows))
        return _batches(made, schema)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, kind)


def _start(model: dict) -> np.ndarray:
    """Scores before the first line: any role's, such that its transition gives the start probabilities."""
    return np.array(model["start"]) - np.array(model["move"]).max(axis=0)


def segments(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", marker: str = "role",
             text: str = "text") -> DataFrame:
    """(conv_id, turn, segment, role, rendered): each run of lines of one role in a turn, rendered as
    ``<|role|>`` and the text without its own markers."""
    ship_package(df.sparkSession)
    rows = turns(df, conversation, turn, marker, text)
    model = train(rows)

    steps, start = steps_of(model), _start(model)
    turn_order = ("turn", "text", "marker")

    def matrix(key: tuple, block: list[dict]) -> Iterator[dict]:
        _, markers, features, opens = observed(block)
        whole = product(scores(steps, markers, features, opens))
        yield {"conv_id": key[0], "block": key[1], "matrix": whole.ravel().tolist()}

    def borders(key: tuple, blocks: list[dict]) -> Iterator[dict]:
        matrices = [np.array(b["matrix"]).reshape(len(ROLES), -1) for b in blocks]
        entries = [start]
        for m in matrices:
            entries.append((entries[-1][:, None] + m).max(axis=0))
        ends = [int(entries[-1].argmax())]
        for entry, m in zip(entries[-2:0:-1], matrices[:0:-1]):
            ends.append(int((entry + m[:, ends[-1]]).argmax()))
        for b, entry, last in zip(blocks, entries, ends[::-1]):
            yield {"border_conv": key[0], "border_block": b["block"], "entry": entry.tolist(), "last": last}

    def render(key: tuple, block: list[dict]) -> Iterator[dict]:
        places, markers, features, opens = observed(block)
        roles = decode(scores(steps, markers, features, opens), np.array(block[0]["entry"]), block[0]["last"])
        bodies = [row["text"].split("\n") for row in block]
        out: list[dict] = []
        for (row, line), role in zip(places, roles):
            body = bodies[row][line]
            found = _MARKER.match(body)
            body = body[found.end():] if found else body
            if line == 0 or out[-1]["role"] != ROLES[role]:
                out.append({"conv_id": key[0], "turn": block[row]["turn"], "role": ROLES[role], "lines": [body],
                            "segment": 0 if line == 0 else out[-1]["segment"] + 1})
            else:
                out[-1]["lines"].append(body)
        for x in out:
            yield {**x, "rendered": f"<|{x['role']}|>\n" + "\n".join(x["lines"]) + "\n<|end|>\n"}

    keys = ("conv_id", "block")
    blocks = _stage(rows, keys, turn_order, matrix, "conv_id long, block long, matrix array<double>")
    border = _stage(blocks, ("conv_id",), ("block",), borders,
                    "border_conv long, border_block long, entry array<double>, last int")
    joined = rows.join(border, rows.conv_id.eqNullSafe(border.border_conv) & (rows.block == border.border_block))
    return _stage(joined, keys, turn_order, render,
                  "conv_id long, turn long, segment int, role string, rendered string")

"""Conversation structure repair: cheapest edits, ties broken by prefix-doubling path ranking.

*Faults*: a turn is blank (nothing but white space), a duplicate (role and text seen earlier in the
conversation), or truncated (its last character that is no white space is none of ``.!?``); the first that
holds counts.

*Cost*. Edits turn the rows into a conversation whose role initials read ``(s?(ua)+)?``: Keep costs 0, Rerole
to user or assistant 3, Delete 4 (the only edit for blank and duplicate rows), Insert of an empty user or
assistant turn 3, and a truncated row that stays adds 3. The automaton has four states (start, after the
system turn, after user, after assistant), so a row is a 4 x 4 matrix in (min, +), and so is a block of rows.

*Choice*. Nodes are (row, state); their optimal arcs are those on cheapest ways to the end. A node has at
most one arc of each letter, as row and state fix where an edit leads. The least letter gives every node's
first pointer; rank and pointer are then doubled: the rank of a node for 2n letters is that of its pair (own
rank for n letters, rank of the node its pointer for n leads to), until every rank covers a whole audit.
The audit is read off through the doubled pointers; ranks tell whether one node's audit precedes another's.

*Long conversations*. Rows are dealt by range over (conversation, order) and packed into blocks of BLOCK rows
with their matrix. The task that closes a conversation first multiplies the matrices from the end, which
gives the cost ahead of each block, and then takes the blocks in order, one at a time: it keeps four numbers
a block. A digest of a conversation's whole text is sequential by nature, so its blocks pass one task as a
stream; nothing else does.

Defined cases: a NULL role or text is one space (so such a text is blank); NULL turns come first, equal turns
are ordered by role and text, and equal rows are counted before they are shuffled; rows without a
conversation id are one conversation; an empty conversation has empty results; an empty table has no
rows; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailstrata.llm.common import named, staged
from mailstrata.llm.turns import dealt, turn_order
from mailstrata.session import ship_package

BLOCK = 4096
#: Characters of text of a block; one longer turn is a block of its own.
BLOCK_CHARS = 4 * 1024 * 1024
FAR = 1 << 40
START, SYSTEM, USER, ASSISTANT = range(4)
#: Letters in the order of their ranks; 0 ends an audit.
LETTERS = "\0DIKR"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
#: State after an inserted or reroled turn.
NEXT = (USER, USER, ASSISTANT, USER)
#: Cost of the inserts that lead from a state to another one.
INSERTS = ((0, FAR, 3, 6), (FAR, 0, 3, 6), (FAR, FAR, 0, 3), (FAR, FAR, 3, 0))
#: Kind 0 must be deleted; kind 1 + 4 * truncated + initial, with initials s, u, a and any other.
INITIALS = "sua"
ENDING = (0, FAR, FAR, 0)
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\x0b\x0c\r"


def kind_of(initial: str, truncated: bool) -> int:
    at = INITIALS.find(initial) if initial else -1
    return 1 + 4 * truncated + (at if at >= 0 else 3)


def row_arcs(kind: int) -> list[tuple[int, int, int, int]]:
    """(state, letter, cost, state after) of the edits of one row."""
    arcs = [(s, DELETE, 4, s) for s in range(4)]
    if not kind:
        return arcs
    extra, initial = 3 * (kind > 4), (kind - 1) % 4
    arcs += [(s, REROLE, 3 + extra, NEXT[s]) for s in range(4)]
    if initial == 0:
        arcs.append((START, KEEP, extra, SYSTEM))
    elif initial == 1:
        arcs += [(s, KEEP, extra, USER) for s in (START, SYSTEM, ASSISTANT)]
    elif initial == 2:
        arcs.append((USER, KEEP, extra, ASSISTANT))
    return arcs


ARCS = [row_arcs(kind) for kind in range(9)]
_STEPS: dict[tuple, tuple] = {}


def inserted(ahead: tuple) -> tuple:
    """Costs where inserts may come first."""
    return tuple(min(FAR, *(INSERTS[s][t] + ahead[t] for t in range(4))) for s in range(4))


def step(kind: int, ahead: tuple) -> tuple[int, tuple, tuple, tuple]:
    """Costs before a row from those after it: (least, the rest above it), and each state's least optimal letter
    and the state it leads to. Costs above the least repeat, so they are remembered."""
    known = _STEPS.get((kind, ahead))
    if known is None:
        after = [FAR] * 4
        for s, _, cost, t in ARCS[kind]:
            after[s] = min(after[s], cost + ahead[t])
        costs = inserted(tuple(after))
        letters, targets = [], []
        for s in range(4):
            ways = [(letter, t) for a, letter, cost, t in ARCS[kind] if a == s and cost + ahead[t] == costs[s]]
            if 3 + costs[NEXT[s]] == costs[s]:
                ways.append((INSERT, NEXT[s]))
            letter, t = min(ways) if costs[s] < FAR else (0, s)
            letters.append(letter)
            targets.append(t)
        least = min(costs)
        known = (least, tuple(min(FAR, c - least) if c < FAR else FAR for c in costs), tuple(letters), tuple(targets))
        if len(_STEPS) > 100_000:
            _STEPS.clear()
        _STEPS[(kind, ahead)] = known
    return known


def behind(kinds: bytes, ahead: tuple) -> tuple:
    """Costs at the first row, given those after the last one."""
    base = min(ahead)
    rest = tuple(min(FAR, a - base) if a < FAR else FAR for a in ahead)
    for kind in reversed(kinds):
        least, rest, _, _ = step(kind, rest)
        base += least
    return tuple(base + r if r < FAR else FAR for r in rest)


def matrix(kinds: bytes) -> list[int]:
    """The block's (min, +) matrix by rows: cost from state s before it to state t after it."""
    columns = [behind(kinds, tuple(0 if s == t else FAR for s in range(4))) for t in range(4)]
    return [columns[t][s] for s in range(4) for t in range(4)]


def times(block: list[int], ahead: tuple) -> tuple:
    return tuple(min(FAR, *(block[4 * s + t] + ahead[t] for t in range(4))) for s in range(4))


def ranked(blocks: list[tuple[bytes, tuple]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[int]]:
    """(letters, ranks, doubled pointers, first nodes) of the nodes of several blocks (kinds, costs ahead)."""
    letters, pointers, firsts, at = [], [], [], 0
    for kinds, ahead in blocks:
        base = min(ahead)
        rest = tuple(min(FAR, a - base) if a < FAR else FAR for a in ahead)
        made = []
        for kind in reversed(kinds):
            _, rest, own, to = step(kind, rest)
            made.append((own, to))
        firsts.append(at)
        for own, to in reversed(made):
            letters.extend(own)
            # An insert stays before its row, every other edit goes behind it.
            pointers.extend(at + t if x == INSERT else at + 4 * (x > 0) + t for x, t in zip(own, to))
            at += 4
        letters.extend((0, 0, 0, 0))
        pointers.extend(range(at, at + 4))
        at += 4
    letter, pointer = np.array(letters, dtype=np.int64), np.array(pointers, dtype=np.int64)
    ranks, levels = letter, [pointer]
    while True:
        _, ranks = np.unique(ranks * (ranks.max() + 1) + ranks[pointer], return_inverse=True)
        if not letter[pointer].any():
            return letter, ranks, levels, firsts
        pointer = pointer[pointer]
        levels.append(pointer)


def path(letter: np.ndarray, levels: list[np.ndarray], node: int) -> np.ndarray:
    """Nodes of the least audit from ``node``, its end included: the known part is doubled by the next pointers."""
    nodes = np.array([node], dtype=np.int64)
    for pointer in levels:
        if not letter[nodes[-1]]:
            break
        nodes = np.concatenate((nodes, pointer[nodes]))
    return nodes[: int(np.argmin(letter[nodes] > 0)) + 1]


# Rows to blocks ----------------------------------------------------------------------------


def rows_of(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies): one space for a NULL role or text, one copy of each row."""
    def string(c: str) -> Column:
        return F.coalesce(named(c).cast("string"), F.lit(" "))
    return df.select(named(conversation).cast("long").alias("conv_id"), named(turn).cast("long").alias("turn"),
                     string(role).alias("role"), string(text).alias("text"), F.lit(1).cast("long").alias("copies"))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with the contract's faults: dropped rows have no copies and nothing else left."""
    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn"))), F.lit(20))
    row = rows.withColumn("fault", fault)
    gone = F.col("fault") == 0
    return row.select(
        "conv_id", F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, "").when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(gone | (F.col("fault") == 1), "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.when(gone, 0).when(F.col("fault") == 3, F.col("copies") * 2).otherwise(F.col("copies")).alias("copies"))


_BLOCK = ("conv_id long, part long, no long, kinds binary, roles array<string>, texts array<string>, matrix array<long>, "
          "blank long, duplicate long, truncated long, illegal long, first string, last string, "
          "n_turns long, low long, high long")


def blocks(rows: DataFrame) -> DataFrame:
    """Blocks of consecutive rows of a conversation, numbered by (part, no) in its order."""
    ship_package(rows.sparkSession)
    runs = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    placed = F.struct(F.col("turn").isNotNull().alias("known"), "turn")  # NULL first
    digest = F.sha2("text", 256)
    several = runs.where("copies > 0").groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), digest.alias("_text")) \
        .agg(F.min(placed).alias("_first"), F.count("*").alias("_runs")).where("_runs > 1")
    seen = runs.join(several, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (digest == F.col("_text")), "left")
    tail = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    ready = seen.select(
        "conv_id", "turn", "role", "text", "copies", F.coalesce(placed > F.col("_first"), F.lit(False)).alias("later"),
        (tail == "").alias("blank"), (~tail.isin(".", "!", "?")).alias("cut"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, made, size = TaskContext.get().partitionId(), 0, [], 0
        own: dict | None = None
        for batch in batches:
            for row in batch.to_pylist():
                if own is None or row["conv_id"] != own["conv_id"]:
                    if own is not None:
                        made.append(_sealed(own))
                    no += 1
                    own = _opened(row["conv_id"], part, no)
                for copy in range(max(row["copies"], 1)):
                    if len(own["kinds"]) >= BLOCK or own["chars"] > BLOCK_CHARS:
                        size += own["chars"] + len(own["kinds"])
                        made.append(_sealed(own))
                        no += 1
                        own = _opened(row["conv_id"], part, no)
                    if row["copies"]:
                        _added(own, row, copy > 0)
                    if len(made) >= 1024 or size > BLOCK_CHARS:
                        yield pa.RecordBatch.from_pylist(made, schema=_BLOCK_ARROW)
                        made, size = [], 0
        if own is not None:
            made.append(_sealed(own))
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=_BLOCK_ARROW)

    return dealt(ready, F.col("conv_id").asc_nulls_first(), *turn_order()).mapInArrow(pack, _BLOCK)


_BLOCK_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int64()), ("no", pa.int64()), ("kinds", pa.binary()),
    ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("matrix", pa.list_(pa.int64())),
    *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")], ("first", pa.string()), ("last", pa.string()),
    *[(c, pa.int64()) for c in ("n_turns", "low", "high")]])


def _opened(conv_id: int | None, part: int, no: int) -> dict:
    return {"conv_id": conv_id, "part": part, "no": no, "kinds": bytearray(), "roles": [], "texts": [], "chars": 0,
            "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first": None, "last": None,
            "n_turns": 0, "low": None, "high": None}


def _added(own: dict, row: dict, copy: bool) -> None:
    role, text = row["role"], row["text"]
    kind = 0
    if row["blank"]:
        own["blank"] += 1
    elif row["later"] or copy:
        own["duplicate"] += 1
    else:
        own["truncated"] += row["cut"]
        kind = kind_of(role[:1], row["cut"])
    own["kinds"].append(kind)
    own["roles"].append(role if kind else "")
    own["texts"].append(text if kind else "")  # a row that must go needs no text
    own["chars"] += len(text) if kind else 0
    if own["first"] is None:
        own["first"] = role[:1]
    else:
        own["illegal"] += own["last"] + role[:1] not in LEGAL
    own["last"] = role[:1]
    turn = row["turn"]
    if turn is not None:
        own["n_turns"] += turn != own["high"]
        own["low"] = turn if own["low"] is None else own["low"]
        own["high"] = turn


def _sealed(own: dict) -> dict:
    kinds = bytes(own["kinds"])
    return {**own, "kinds": kinds, "matrix": matrix(kinds)}


# Blocks to conversations -------------------------------------------------------------------

_REPAIRED = ("conv_id long, no long, last_block boolean, gaps long, blank long, duplicate long, truncated long, illegal long, "
             "cost long, audit string, turns array<struct<role: string, text: string>>")
_REPAIRED_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("no", pa.int64()), ("last_block", pa.bool_()),
    *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()),
    ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])
_ROLE = {USER: "user", ASSISTANT: "assistant"}


def repaired(packed: DataFrame) -> DataFrame:
    """One row per block, a conversation's blocks together and in order: its part of the audit, the turns after
    repair, and the conversation's sums so far (whole where ``last_block``)."""
    order = F.col("part") * (1 << 32) + F.col("no")
    small = [c for c in packed.columns if c not in ("conv_id", "matrix")]
    ahead = packed.select("conv_id", F.lit(0).alias("kind"), (-order).alias("at"), "matrix",
                          *[F.lit(None).cast(packed.schema[c].dataType).alias(c) for c in small])
    body = packed.select("conv_id", F.lit(1).alias("kind"), order.alias("at"),
                         F.lit(None).cast("array<long>").alias("matrix"), *small)
    stream = ahead.unionByName(body).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "kind", "at")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, conv, costs, state, totals, waiting, held = True, None, [], START, {}, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal state, totals
            letter, _, levels, nodes = ranked([(b["kinds"], b["ahead"]) for b in waiting])
            out = []
            for b, start in zip(waiting, nodes):
                if b["opens"]:
                    state, totals = START, {"no": 0, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0,
                                            "audit": "", "last": None, "low": None, "high": None, "n_turns": 0}
                way = path(letter, levels, start + 4 * 0 + state)
                edits, turns = letter[way[:-1]].tolist(), []
                for x, node in zip(edits, way.tolist()):
                    at, now = (node - start) // 4, (node - start) % 4
                    if x == KEEP:
                        turns.append({"role": b["roles"][at], "text": b["texts"][at]})
                    elif x == REROLE:
                        turns.append({"role": _ROLE[NEXT[now]], "text": b["texts"][at]})
                    elif x == INSERT:
                        turns.append({"role": _ROLE[NEXT[now]], "text": ""})
                audit = "".join(LETTERS[x] for x in edits)
                state = int(way[-1] - start) % 4
                if not b["more"]:  # inserts behind the last row
                    tail = {START: [], ASSISTANT: [], USER: [ASSISTANT], SYSTEM: [USER, ASSISTANT]}[state]
                    turns += [{"role": _ROLE[t], "text": ""} for t in tail]
                    audit += LETTERS[INSERT] * len(tail)
                t = totals
                for c in ("blank", "duplicate", "truncated", "illegal"):
                    t[c] += b[c]
                if b["first"] is not None:
                    if t["last"] is not None:
                        t["illegal"] += t["last"] + b["first"] not in LEGAL
                    t["last"] = b["last"]
                if b["low"] is not None:
                    t["n_turns"] += b["n_turns"] - (t["high"] == b["low"])
                    t["low"] = b["low"] if t["low"] is None else t["low"]
                    t["high"] = b["high"]
                    t["gaps"] = t["high"] - t["low"] + 1 - t["n_turns"]
                out.append({"conv_id": b["conv_id"], "no": t["no"], "last_block": not b["more"], "cost": b["cost"], "audit": audit,
                            "turns": turns, **{c: t[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal")}})
                t["no"] += 1
            waiting.clear()
            return pa.RecordBatch.from_pylist(out, schema=_REPAIRED_ARROW)

        for batch in batches:
            for row in batch.to_pylist():
                if first or row["conv_id"] != conv:
                    first, conv, costs, opens = False, row["conv_id"], [inserted(ENDING)], True
                if row["kind"] == 0:
                    costs.append(times(row["matrix"], costs[-1]))
                    continue
                if opens:
                    cost = costs.pop()[START]
                row.update(ahead=costs.pop(), opens=opens, cost=cost)
                row["more"] = bool(costs)
                opens = False
                waiting.append(row)
                held += len(row["kinds"]) + sum(map(len, row["texts"])) // 64
                if held >= BLOCK:
                    yield flush()
                    held = 0
        if waiting:
            yield flush()

    return stream.mapInArrow(finish, _REPAIRED)


def repair(df: DataFrame, **columns: str) -> DataFrame:
    """``repaired`` rows of a table of conversations as it is."""
    return repaired(staged(blocks(rows_of(df, **columns)), "blocks"))


def ledger(blocks_of: DataFrame) -> DataFrame:
    """One row per conversation: faults, cost, audit and the SHA-256 of the repaired turns, fed block by block.

    Reads ``repaired`` rows in the order in which they are made, so no exchange may lie between.
    """
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in names[1:7]], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, audit, begun = hashlib.sha256(), [], False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                audit.append(row["audit"])
                for turn in row["turns"]:
                    state.update(("\n" * begun + turn["role"] + ":" + turn["text"]).encode("utf-8", "surrogatepass"))
                    begun = True
                if row["last_block"]:
                    out.append({**{c: row[c] for c in names[:7]}, "audit": "".join(audit), "repaired_sha256": state.hexdigest()})
                    state, audit, begun = hashlib.sha256(), [], False
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return blocks_of.mapInArrow(fold, "conv_id long, " + ", ".join(f"{c} long" for c in names[1:7])
                                + ", audit string, repaired_sha256 string")

"""Trie of conversation prefixes by truncation peeling.

A node of depth d is a distinct sequence of the first d turns; its members are the conversations that
start with it. Nodes are named by their least member and depth: a child has the same least member as
its parent or a larger one.

*Prefixes* are told apart by the running sum of four 32-bit pieces of the SHA-256 values of (place,
role, text), 128 bits that a long conversation's tasks can add up independently.

*Peeling*. Conversations are stripped from their ends: those that end at a node merge with the nodes
that survive from below, and what is left regroups at the next node upwards, carrying the number of
leaves and the saved tokens below it. A run of turns that no conversation leaves, ends in or joins is
stripped in one step, so rounds follow the number of such *knots* on a path and not the length of a
conversation (a level at a time, one conversation of 400 turns would take 400 jobs). Every round
takes the knots that wait for nothing below them; nodes with a single member wait for nobody.

Defined cases: NULL and empty roles and texts are empty; turns are ordered NULL first, at equal turns by
role and text; repeated rows are turns of their own; rows without a conversation id belong to none and
are left out; an empty table has no node; extra columns are left out. Long conversations are cut by
ranges (``turns``), popular nodes are combined map-side, long member lists are joined in chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailstrata.llm.common import named, staged, unstage
from mailstrata.llm.turns import dealt, running, turn_order
from mailstrata.session import ship_package

LANES = 4
#: Members of a chunk of a node's list.
CHUNK = 65_536
KEYS = ["depth", *[f"sum_lane{k}" for k in range(LANES)]]


def conversations(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, one) with empty strings for NULL; rows without an id are left out."""
    def string(c: str):
        return F.coalesce(named(c).cast("string"), F.lit(""))
    return df.select(named(conversation).cast("long").alias("conv_id"), named(turn).cast("long").alias("turn"),
                     string(role).alias("role"), string(text).alias("text"), F.lit(1).cast("long").alias("one")) \
        .where(F.col("conv_id").isNotNull())


def numbered(df: DataFrame, **columns: str) -> DataFrame:
    """(conv_id, depth, role, text): every turn with its place in its conversation, from 1."""
    return running(conversations(df, **columns), "conv_id", turn_order(), ["one"]) \
        .select("conv_id", F.col("sum_one").alias("depth"), "role", "text")


def paths(steps: DataFrame) -> DataFrame:
    """Every prefix of every conversation of ``steps`` (conv_id, depth, role, text, ends): its key,
    that of the prefix one shorter, and the length of its last text."""
    digest = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), F.length("role").cast("string"), "role", "text"), 256)
    lanes = [F.conv(F.substring("digest", 1 + 8 * k, 8), 16, 10).cast("long").alias(f"lane{k}") for k in range(LANES)]
    known = steps.select("conv_id", "depth", "ends", F.length("text").cast("long").alias("chars"), digest.alias("digest")) \
        .select("conv_id", "depth", "ends", "chars", *lanes)
    summed = running(known, "conv_id", [F.col("depth").asc()], [f"lane{k}" for k in range(LANES)])
    return staged(summed.select("conv_id", "ends", "chars", *KEYS, *[
        (F.col(f"sum_lane{k}") - F.col(f"lane{k}")).alias(f"up{k}") for k in range(LANES)]), "paths")


def grouped(prefixes: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node with its members, ends and parent; ``lengths`` (conv_id, length) has every conversation."""
    nodes = staged(prefixes.groupBy(*KEYS).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("chars").alias("chars"),
        F.sum("ends").alias("n_ends"), *[F.first(f"up{k}").alias(f"up{k}") for k in range(LANES)]), "nodes")
    root = lengths.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"),
                       F.count_if(F.col("length") == 0).alias("n_ends")).where("n_convs > 0")
    ups = [f"up{k}" for k in range(LANES)]
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"),
                         *[F.col(c).alias(u) for c, u in zip(KEYS[1:], ups)]).unionByName(
        root.select(F.lit(1).cast("long").alias("depth"), F.col("conv_id").alias("parent_conv_id"),
                    *[F.lit(0).cast("long").alias(u) for u in ups]))
    below = nodes.join(above, ["depth", *ups])
    kept = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_ends", "chars", *KEYS[1:]]
    rooted = root.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
                         "n_convs", "n_ends", F.lit(0).cast("long").alias("chars"),
                         *[F.lit(0).cast("long").alias(c) for c in KEYS[1:]])
    tree = staged(below.select(*kept).unionByName(rooted), "tree")
    children = tree.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")) \
        .agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("lone"))
    return staged(tree.join(children, ["conv_id", "depth"], "left")
                  .fillna(0, ["n_children", "lone"]), "tree")


def peeled(tree: DataFrame) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens) of every node, subtrees included."""
    spark = tree.sparkSession
    saved = (F.col("n_convs") - 1) * F.col("chars")
    knot = (F.col("n_children") != 1) | (F.col("n_ends") > 0)
    upward = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    # A node with one child and no end has its child's members, so its chain goes on under the same name.
    shared = staged(tree.where("n_convs > 1").withColumn(
        "knot", F.last(F.when(knot, F.col("depth")), ignorenulls=True).over(upward)).withColumn(
        "below", F.sum(saved).over(Window.partitionBy("conv_id", "knot").orderBy(F.desc("depth")))), "shared")
    chains = shared.groupBy("conv_id", "knot").agg(
        F.min_by(F.struct("parent_conv_id", (F.col("depth") - 1).alias("above"), "below"), "depth").alias("top"))
    waiting = shared.where("depth = knot").select(
        "conv_id", "knot", F.when(F.col("n_children") == 0, 1).otherwise(F.col("lone")).cast("long").alias("leaves"),
        F.lit(0).cast("long").alias("under"), (F.col("n_children") - F.col("lone")).alias("open"))
    waiting = staged(waiting.join(chains, ["conv_id", "knot"]).select(
        "conv_id", "knot", "leaves", "under", "open", F.col("top.parent_conv_id").alias("up_conv"),
        F.col("top.above").alias("up_knot"), F.col("top.below").alias("chain")), "waiting")
    done, rounds = [], [waiting]
    while True:
        done.append(waiting.where("open = 0").select("conv_id", "knot", "leaves", "under"))
        if not waiting.where("open > 0").limit(1).count():
            break
        merged = waiting.where("open = 0 AND up_conv IS NOT NULL").groupBy(F.col("up_conv").alias("_conv"), F.col("up_knot").alias("_knot")).agg(
            F.sum("leaves").alias("_leaves"), F.sum(F.col("under") + F.col("chain")).alias("_under"), F.count("*").alias("_n"))
        on = (F.col("conv_id") == F.col("_conv")) & (F.col("knot") == F.col("_knot"))
        waiting = staged(waiting.where("open > 0").join(merged, on, "left").select(
            "conv_id", "knot", (F.col("leaves") + F.coalesce("_leaves", F.lit(0))).alias("leaves"),
            (F.col("under") + F.coalesce("_under", F.lit(0))).alias("under"),
            (F.col("open") - F.coalesce("_n", F.lit(0))).alias("open"), "up_conv", "up_knot", "chain"), "waiting")
        rounds.append(waiting)
    values = done[0]
    for part in done[1:]:
        values = values.unionByName(part)
    values = staged(values, "knots")
    for old in rounds:
        unstage(spark, old)
    several = shared.join(values, ["conv_id", "knot"]).select(
        "conv_id", "depth", F.col("leaves").alias("n_leaves"), (F.col("under") + F.col("below")).alias("saved_tokens"))
    alone = tree.where("n_convs = 1").select("conv_id", "depth", F.lit(1).cast("long").alias("n_leaves"),
                                             F.lit(0).cast("long").alias("saved_tokens"))
    return several.unionByName(alone)


def ends(prefixes: DataFrame, lengths: DataFrame) -> DataFrame:
    """(keys of a node, part, place, ids): the members that end at a node, ascending, in chunks of text."""
    ship_package(prefixes.sparkSession)
    at_root = lengths.where("length = 0").select("conv_id", *[F.lit(0).cast("long").alias(c) for c in KEYS])
    ended = prefixes.where("ends = 1").select("conv_id", *KEYS).unionByName(at_root)
    keys = [F.col(c).asc() for c in KEYS]
    names = [*KEYS, "part", "place", "ids"]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, key, held = TaskContext.get().partitionId(), 0, None, []

        def flush(rows: list) -> None:
            rows.append((*key, part, place, ",".join(held)))

        for batch in batches:
            rows: list[tuple] = []
            for own, i in zip(zip(*[batch.column(c).to_pylist() for c in KEYS]), batch.column("conv_id").to_pylist()):
                if held and (own != key or len(held) == CHUNK):
                    flush(rows)
                    place, held = place + 1, []
                key = own
                held.append(str(i))
            yield pa.RecordBatch.from_pydict({n: [r[j] for r in rows] for j, n in enumerate(names)}, schema=_CHUNKS)
        if held:
            rows = []
            flush(rows)
            yield pa.RecordBatch.from_pydict({n: [r[j] for r in rows] for j, n in enumerate(names)}, schema=_CHUNKS)

    return dealt(ended, *keys, F.col("conv_id").asc()).mapInArrow(
        chunks, ", ".join(f"{n} long" for n in names[:-1]) + ", ids string")


_CHUNKS = pa.schema([*[(n, pa.int64()) for n in (*KEYS, "part", "place")], ("ids", pa.string())])


def end_digests(lists: DataFrame) -> DataFrame:
    """(keys of a node, ends_sha256): SHA-256 of a node's comma-joined ends, taken chunk by chunk in order."""
    names = [*KEYS, "ends_sha256"]
    schema = pa.schema([*[(n, pa.int64()) for n in KEYS], ("ends_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            rows = []
            for own, ids in zip(zip(*[batch.column(c).to_pylist() for c in KEYS]), batch.column("ids").to_pylist()):
                if own != key:
                    if state is not None:
                        rows.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pa.RecordBatch.from_pydict({n: [r[j] for r in rows] for j, n in enumerate(names)}, schema=schema)
        if state is not None:
            row = (*key, state.hexdigest())
            yield pa.RecordBatch.from_pydict({n: [row[j]] for j, n in enumerate(names)}, schema=schema)

    return lists.repartition(*KEYS).sortWithinPartitions(*KEYS, "part", "place").mapInArrow(
        digest, ", ".join(f"{n} long" for n in KEYS) + ", ends_sha256 string")


def trie(steps: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of conversations given as turns (conv_id, depth, role, text, ends) and their lengths.

    Nodes carry conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and the keys that
    name them in ``ends``.
    """
    prefixes = paths(steps)
    tree = grouped(prefixes, lengths)
    nodes = tree.join(peeled(tree), ["conv_id", "depth"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", *KEYS[1:])
    return nodes, ends(prefixes, lengths)


def of_conversations(df: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and ends of a table of conversations as it is."""
    steps = staged(numbered(df, **columns), "turns")
    lengths = steps.groupBy("conv_id").agg(F.max("depth").alias("length"))
    return trie(steps.join(lengths, "conv_id").select(
        "conv_id", "depth", "role", "text", (F.col("depth") == F.col("length")).cast("long").alias("ends")), lengths)


# The contract's rebuilt conversations ------------------------------------------------------

SHARING = 100
HEADS = 6


def rebuilt(df: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(steps, lengths) where each conversation starts with turns of the one its hundred begins with."""
    turns = staged(numbered(df, **columns), "turns")
    counts = turns.groupBy("conv_id").agg(F.max("depth").alias("n"))
    heads = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(HEADS))
    base = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = counts.select("conv_id", "n", heads.alias("h"), (F.col("conv_id") - F.col("conv_id") % SHARING).alias("base")) \
        .join(base, "base", "left").withColumn("lent", F.least("h", F.coalesce("n_base", F.lit(0)))) \
        .withColumn("length", F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = staged(convs.select("conv_id", "base", "h", "lent", "length"), "conversations")
    lender = turns.where(F.col("depth") < HEADS).withColumnRenamed("conv_id", "base")
    lent = convs.select("conv_id", "base", "lent", "length").join(lender, "base").where("depth <= lent") \
        .select("conv_id", "depth", "role", "text", "length")
    own = turns.join(convs.select("conv_id", "h", "lent", "length"), "conv_id").where("depth > h").select(
        "conv_id", (F.col("depth") - F.col("h") + F.col("lent")).alias("depth"), "role", "text", "length")
    steps = lent.unionByName(own).select("conv_id", "depth", "role", "text",
                                         (F.col("depth") == F.col("length")).cast("long").alias("ends"))
    return staged(steps, "steps"), convs.select("conv_id", "length")


def digest_nodes(nodes: DataFrame, lists: DataFrame) -> DataFrame:
    """The nodes with the digest of their ends in place of the keys."""
    none = hashlib.sha256(b"").hexdigest()
    return nodes.join(end_digests(lists), KEYS, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))

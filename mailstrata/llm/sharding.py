"""Shards of near equal size by longest-processing-time scheduling.

Rows of equal texts form a group that stays together. Groups go, largest first, to the shard that is
least loaded so far; a heap of the shards gives it.

What is scheduled are classes, one for each size that a group has, with the number of its groups: groups
of one size are alike, so it only matters how many of them a shard takes. A class larger than the number
of shards is filled up to a level at once, as the heap would one by one; the heap places the rest. The
driver sees one row per distinct size (at most the root of twice the corpus' bytes, as distinct sizes
add up to no more than that), never a group. Groups of a class are numbered in blocks by tasks, and their
number gives the shard.

Defined cases: a NULL text counts no bytes and is grouped with empty texts; NULL and repeated ids are
rows like any other (their slots follow size and checksum); groups of equal size are taken in the order
of their texts' digests; a text of any length is one row; an empty table has no rows; extra columns are
left out.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailstrata.llm.common import documents, staged

SHARDS = 40
OVERHEAD = 16
#: A text that fills this part of all rows is joined by broadcast; there are at most as many such texts.
HOT = 8_192
#: Blocks of a class of groups that are numbered in parallel.
CLASS_BLOCKS = 4_096
#: Blocks of a shard that are numbered in parallel.
BLOCKS = 256
LAW = "bytes"


def longest_first(classes: list[tuple[int, int]], shards: int) -> list[list[tuple[int, int]]]:
    """(shard, groups it takes) of each class (size, groups), which come with the largest size first.

    Each group goes to the least loaded shard, ties to the lower number.
    """
    loads = np.zeros(shards, dtype=np.int64)
    out = []
    for size, groups in classes:
        taken = np.zeros(shards, dtype=np.int64)
        if groups > shards:
            # All placements that start below a level come before all others; find the highest level they reach.
            low, high = int(loads.min()), int(loads.max()) + size * (groups // shards + 1)
            while low < high:
                level = (low + high + 1) // 2
                if int(np.maximum(0, -((loads - level) // size)).sum()) <= groups:
                    low = level
                else:
                    high = level - 1
            taken = np.maximum(0, -((loads - low) // size))
            loads += taken * size
        heap = [(int(load), shard) for shard, load in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(groups - int(taken.sum())):
            load, shard = heap[0]
            taken[shard] += 1
            loads[shard] += size
            heapq.heapreplace(heap, (load + size, shard))
        out.append([(int(s), int(taken[s])) for s in np.nonzero(taken)[0]])
    return out


def placed_groups(rows: DataFrame, shards: int) -> DataFrame:
    """(group, members, shard) per group of equal texts."""
    spark = rows.sparkSession
    block = F.pmod(F.xxhash64("group"), F.lit(CLASS_BLOCKS)).cast("int")
    groups = staged(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("members"))
                    .withColumn("block", block), "groups")
    counts = groups.groupBy("bytes", "block").agg(F.count("*").alias("n"))
    classes = sorted(((r["bytes"], r["n"]) for r in counts.groupBy("bytes").agg(F.sum("n").alias("n")).toLocalIterator()),
                     reverse=True)
    table = [(size, np.cumsum([n for _, n in runs]).tolist(), [s for s, _ in runs])
             for (size, _), runs in zip(classes, longest_first(classes, shards))]
    runs = spark.createDataFrame(table, "bytes long, ends array<long>, shards array<int>")
    # At most CLASS_BLOCKS rows of a size meet here; groups themselves are dealt by (size, block).
    before = F.sum("n").over(Window.partitionBy("bytes").orderBy("block")) - F.col("n")
    starts = counts.withColumn("before", before).join(runs, "bytes").drop("n")
    inside = F.row_number().over(Window.partitionBy("bytes", "block").orderBy("group"))
    numbered = groups.withColumn("inside", inside).join(starts, ["bytes", "block"])
    number = F.col("before") + F.col("inside")
    run = F.size(F.filter("ends", lambda end: end < number))
    return numbered.select("group", "members", F.get("shards", run).alias("shard"))


def shard(df: DataFrame, shards: int = SHARDS, id_column: str = "doc_id",
          text_column: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row of ``df``."""
    text = F.coalesce(F.col("text"), F.lit(b""))
    rows = staged(documents(df, id_column, text_column).select(
        "doc_id", (F.length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("group")), "sized")
    groups = staged(placed_groups(rows, shards), "placed")
    total = rows.count()
    # A text with a large share of all rows must not meet its rows in one task; at most HOT texts have one.
    hot = groups.where(F.col("members") * HOT >= total).drop("members")
    joined = rows.join(F.broadcast(hot), "group", "left")
    others = joined.where("shard is null").drop("shard").join(groups.where(F.col("members") * HOT < total).drop("members"), "group")
    put = joined.where("shard is not null").unionByName(others).drop("group")
    block = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(BLOCKS)).cast("int")
    placed_rows = put.withColumn("block", block)
    counts = placed_rows.groupBy("shard", "block").agg(F.count("*").alias("rows"))
    # shards * BLOCKS rows at most.
    offsets = counts.select("shard", "block", (F.sum("rows").over(
        Window.partitionBy("shard").orderBy("block")) - F.col("rows")).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32"))
    return placed_rows.withColumn("inside", inside).join(F.broadcast(offsets), ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
        (F.col("offset") + F.col("inside") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

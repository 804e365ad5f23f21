"""Connected components by contraction, for tables of links of any size.

Each round every node moves to the neighbour, or itself, that comes first in an order drawn for that
round; links are renamed, links inside one name and repeated ones are dropped. A round leaves a fixed
share of the nodes at most, so rounds grow with the logarithm of the longest chain, and what is settled
is not looked at again. Names are then followed back from the last round to the first. A round is a
table in the shared folder; nothing goes to the driver but whether links are left.

Defined cases: repeated links, links of a node with itself and both directions of a link count once; a
node that has only a link with itself is not in the result; an empty table gives an empty result; a
link with a NULL end is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailstrata.llm.common import staged, unstage


def _links(a: Column, b: Column, df: DataFrame) -> DataFrame:
    return df.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the same root for all nodes of ``edges(a, b)`` that are linked, directly or not."""
    spark = edges.sparkSession
    now = staged(_links(F.col("a"), F.col("b"), edges.select("a", "b")), "links")
    moves: list[DataFrame] = []
    while not moves or not now.isEmpty():
        def rank(c: str, turn: int = len(moves)) -> Column:
            return F.struct(F.xxhash64(F.col(c), F.lit(turn)), F.col(c).alias("node"))

        ways = now.union(now.select("b", "a")).toDF("a", "b")
        best = ways.groupBy("a").agg(F.min(rank("b")).alias("best"))
        moves.append(staged(best.select(F.col("a").alias("node"), F.least(rank("a"), "best")["node"].alias("name")), "moves"))
        left = moves[-1].select(F.col("node").alias("a"), F.col("name").alias("x"))
        right = moves[-1].select(F.col("node").alias("b"), F.col("name").alias("y"))
        renamed = now.join(left, "a").join(right, "b")
        after = staged(_links(F.col("x"), F.col("y"), renamed), "links")
        unstage(spark, now)
        now = after
    roots = moves[-1].select("node", F.col("name").alias("root"))
    for move in reversed(moves[:-1]):
        later = roots.select(F.col("node").alias("via"), F.col("root").alias("far"))
        roots = move.join(later, move.name == later.via, "left").select("node", F.coalesce("far", "name").alias("root"))
    out = staged(roots, "components")
    for table in (*moves, now):
        unstage(spark, table)
    return out

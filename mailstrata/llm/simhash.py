"""SimHash near-duplicates through a forest of vantage-point trees.

*Fingerprint*: 64 bits; a bit is 1 if it is set in over half of the XXH64 values of a text's shingles.

*Search*. Texts with one fingerprint collapse into one point. Two points that differ in at most four
of 64 bits differ, for a cut of the 64 bits into three bands, in at most 1, 1 or 0 bits of one band
(two differences in each of the first two and one in the third would already be five). So there is
one vantage-point tree per band, whose metric is the Hamming distance within the band:

* a node holds a vantage fingerprint and a radius ``mu``: points at distance <= mu go inside, points
  at distance > mu - r outside, with r the band's search radius. By the triangle inequality a pair
  within r is never parted: only the points of the boundary ring go to both sides;
* the upper levels are fitted on a bounded sample of the fingerprints and cut all points into
  shards, to which boundary points travel as copies. A shard is one group of a Spark shuffle; in it
  the tree grows on until its branches are small or no ring can part them, and there all 64 bits are
  compared. The sample only moves the cuts; the pairs found are exact whatever it holds.

A plain tree over all 64 bits would be useless at this radius: distances of unrelated fingerprints
are 32 +- 4, so every second point would be in the ring of every node.

*Links*. A shard reports a spanning forest of the links in it (at most one row per point, never the
pairs of a group), and the components of all shards' forests come from label propagation with pointer
jumping over tables in the shared folder.

Defined cases: no words gives fingerprint zero, linked like any other; a NULL text is such a text; a
NULL id is kept and never becomes a component id unless no other id is in the component; repeated
rows stay rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailstrata.llm.common import documents, map_texts, named, staged, unstage
from mailstrata.session import ship_package

SHINGLE = 4
SEED = 42
RADIUS = 4
#: (mask, radius) of each band; the radii plus one sum to RADIUS + 1, so one band is always hit.
BANDS = ((0x1FFFFFF, 1), (0x1FFFFFF << 25, 1), (0x3FFF << 50, 0))
#: One fingerprint in SAMPLE_RATE fits the upper levels, SAMPLE_MAX at most; both move only the cuts.
SAMPLE_RATE = 16
SAMPLE_MAX = 65_536
#: Sample points of a shard, and points of a branch that are compared directly.
SHARD_SAMPLE = 8
BRANCH = 128
VANTAGE_TRIES = 6

_U64 = (1 << 64) - 1


def fingerprint(data: bytes | None, size: int = SHINGLE) -> int:
    """Unsigned fingerprint of one text given as UTF-8."""
    words = (data or b"").lower().split()  # bytes.lower touches A-Z only
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in
                       zip(starts[: len(words) - size + 1].tolist(), ends[size - 1:].tolist())],
                      dtype=np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of ``hashes``; none: zero."""
    # Votes by byte value: 8 histograms of 256 bins instead of 64 counters per shingle.
    octets = hashes.view(np.uint8).reshape(-1, 8)
    votes = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * votes > len(hashes), bitorder="little").tobytes(), "little")


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1, bitorder="little").astype(np.int64)


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp): one row per row of ``df``; fp is the fingerprint as a signed 64-bit integer."""
    def make() -> Callable:
        def work(texts: list, part: object) -> list:
            fps = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
            return [part.column("doc_id"), fps]
        return work

    return map_texts(documents(df, id_column, text_column), "text", make, "doc_id long, fp long")


# The trees -------------------------------------------------------------------------------


def distances(points: np.ndarray, vantage: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((points ^ vantage) & mask)


def choose(points: np.ndarray, mask: np.uint64, radius: int) -> tuple[np.uint64, int] | None:
    """Vantage point and mu that leave the least work, or None where no ring parts the points well."""
    best, least = None, 0.9
    step = max(1, len(points) // VANTAGE_TRIES)
    for vantage in points[::step][:VANTAGE_TRIES]:
        near = np.cumsum(np.bincount(distances(points, vantage, mask), minlength=65)) / len(points)
        inside = near[:64]
        outside = 1 - np.concatenate((np.zeros(radius), near))[:64]  # farther than mu - radius
        work = inside ** 2 + outside ** 2
        mu = int(work.argmin())
        if work[mu] < least:
            best, least = (vantage, mu), float(work[mu])
    return best


@dataclass
class Tree:
    """Upper levels over a sample: per node vantage, mu and the two children; a child < 0 is a shard."""

    mask: int
    radius: int
    vantage: list[int] = field(default_factory=list)
    mu: list[int] = field(default_factory=list)
    inside: list[int] = field(default_factory=list)
    outside: list[int] = field(default_factory=list)
    shards: int = 0
    root: int = 0

    @staticmethod
    def fit(sample: np.ndarray, mask: int, radius: int, leaf: int = SHARD_SAMPLE) -> Tree:
        tree = Tree(mask, radius)
        band = np.uint64(mask)

        def grow(points: np.ndarray) -> int:
            cut = choose(points, band, radius) if len(points) > leaf else None
            if cut is None:
                tree.shards += 1
                return -tree.shards
            node = len(tree.mu)
            tree.vantage.append(int(cut[0]))
            tree.mu.append(cut[1])
            tree.inside.append(0)
            tree.outside.append(0)
            d = distances(points, cut[0], band)
            tree.inside[node] = grow(points[d <= cut[1]])
            # As integers: a radius larger than mu must not wrap around.
            tree.outside[node] = grow(points[d.astype(np.int64) > cut[1] - radius])
            return node

        tree.root = grow(sample)
        return tree

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of point, shard): every shard whose region, widened by the radius, holds the point."""
        band = np.uint64(self.mask)
        found_at, found_in = [], []
        open_ = [(self.root, np.arange(len(points)))]
        while open_:
            node, at = open_.pop()
            if not len(at):
                continue
            if node < 0:
                found_at.append(at)
                found_in.append(np.full(len(at), -node - 1, dtype=np.int64))
                continue
            d = distances(points[at], np.uint64(self.vantage[node]), band).astype(np.int64)
            open_.append((self.inside[node], at[d <= self.mu[node]]))
            open_.append((self.outside[node], at[d > self.mu[node] - self.radius]))
        if not found_at:
            none = np.zeros(0, dtype=np.int64)
            return none, none
        return np.concatenate(found_at), np.concatenate(found_in)


def _spanning(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``points``, each tree a star around its first point.

    Breadth first over what is still unvisited, so a dense group costs about one pass, not its pairs.
    """
    links, rest = [], points
    while len(rest):
        root, rest = rest[0], rest[1:]
        frontier = [root]
        while frontier and len(rest):
            close = np.bitwise_count(rest ^ frontier.pop()) <= radius
            if close.any():
                found, rest = rest[close], rest[~close]
                links.extend((int(root), int(x)) for x in found)
                frontier.extend(found)
    return links


def shard_links(points: np.ndarray, mask: int, radius: int, full: int = RADIUS) -> list[tuple[int, int]]:
    """Links of one shard: the tree grown on inside it, all 64 bits compared in its branches."""
    band, links, open_ = np.uint64(mask), [], [np.unique(points)]
    while open_:
        at = open_.pop()
        cut = choose(at, band, radius) if len(at) > BRANCH else None
        if cut is None:
            links.extend(_spanning(at, full))
            continue
        d = distances(at, cut[0], band).astype(np.int64)
        open_ += [at[d <= cut[1]], at[d > cut[1] - radius]]
    return links


def links(points: DataFrame) -> DataFrame:
    """(a, b): edges whose components are those of all pairs of ``points.fp`` within RADIUS bits.

    ``points`` must be cheap to read twice (a staged table) and hold each fingerprint once.
    """
    spark = points.sparkSession
    ship_package(spark)
    by_hash = F.xxhash64(F.col("fp"), F.lit(7))
    sample = np.array([r[0] for r in points.select("fp").where(F.pmod(by_hash, F.lit(SAMPLE_RATE)) == 0)
                      .orderBy(by_hash).limit(SAMPLE_MAX).collect()], dtype=np.int64).view(np.uint64)
    trees = [Tree.fit(sample, mask, radius) for mask, radius in BANDS]

    def route(batches):
        for batch in batches:
            fps = batch["fp"].to_numpy()
            for number, tree in enumerate(trees):
                at, shard = tree.route(fps.view(np.uint64))
                yield pd.DataFrame({"tree": np.full(len(at), number, dtype=np.int32), "shard": shard,
                                    "fp": fps[at]})

    def search(key, shard):
        mask, radius = BANDS[int(key[0])]
        found = shard_links(shard["fp"].to_numpy().view(np.uint64), mask, radius)
        pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    routed = points.select("fp").mapInPandas(route, "tree int, shard long, fp long")
    return routed.groupBy("tree", "shard").applyInPandas(search, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node each node of ``edges(a, b)`` can reach.

    Every round takes the least label among the neighbours (combined map-side) and then the label of
    that label; a round is one table in the shared folder.
    """
    spark = edges.sparkSession
    both = staged(edges.union(edges.select("b", "a")).toDF("a", "b").distinct(), "edges")
    labels = staged(both.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct(), "labels")
    while True:
        offered = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("least"))
        lower = labels.join(offered, labels.node == offered.a, "left").select(
            "node", F.col("root").alias("was"), F.least("root", "least").alias("root"))
        lower = staged(lower, "labels")
        jump = lower.select(F.col("node").alias("via"), F.col("root").alias("far"))
        after = staged(lower.join(jump, lower.root == jump.via).select("node", "was", F.least("root", "far").alias("root")),
                       "labels")
        changed = after.where("root <> was").limit(1).count()
        for old in (labels, lower):
            unstage(spark, old)
        labels = after.select("node", "root")
        if not changed:
            unstage(spark, both)
            return labels


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id linked to the row, itself included."""
    spark = df.sparkSession
    prints = staged(fingerprints(df, id_column, text_column), "prints")
    points = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows")),
                    "points")
    edges = staged(links(points), "links")
    labels = components(edges)
    of = labels.join(points, labels.node == points.fp)
    least = of.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = of.join(least, "root").select("fp", F.col("component_id").alias("group_id"))
    # Only fingerprints that are shared or linked need a lookup; the rest are their own component.
    shared = points.where("rows > 1").join(linked, "fp", "full_outer").select(
        F.col("fp").alias("print"), F.coalesce("group_id", "first_id").alias("group_id"))
    out = prints.join(shared, prints.fp == shared.print, "left").select(
        "doc_id", "fp", F.coalesce("group_id", "doc_id").alias("component_id"))
    return out


def as_hex(fp: Column) -> Column:
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of ``df`` per group: that of the least id; of rows that share this id, the first by text.

    A row without an id cannot be named as a member of a group and stays.
    """
    found = near_duplicates(df, id_column, text_column)
    first = found.where("doc_id = component_id").select(F.col("doc_id").alias("first_id")).distinct()
    row = F.struct(*[named(c) for c in df.columns]).alias("row")
    rows = df.select(row, named(id_column).cast("long").alias("id"), named(text_column).alias("text"))
    kept = rows.join(first, rows.id == first.first_id, "left_semi")
    # Partitioned by the key of the join, so repeated ids cost no further exchange.
    order = F.row_number().over(Window.partitionBy("id").orderBy("text"))
    once = kept.withColumn("place", order).where("place = 1").select("row.*")
    return once.unionByName(df.where(named(id_column).isNull()))

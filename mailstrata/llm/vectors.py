"""Approximate nearest neighbours by an adaptive scan of dimensions.

*Lists*. K-means centroids, fitted on a bounded sample, cut all distinct vectors into lists. Equal
vectors collapse into one point that keeps the ids a result can name (one more than asked for, as a
query leaves out its own row). A list is scanned in blocks of bounded size, each in one task.

*Scan*. Vectors are turned by one random orthogonal matrix, so any few coordinates are a fair sample of
a distance, and a block holds them by column. Per query the columns are read block by block: with d of
D columns read, a candidate is given up once its partial square exceeds what the bound r allows,

    partial > r * r * d / D * (1 + EPS / sqrt(d)) ** 2,

the test of the hypothesis that its distance is at most r. The bound is the last kept distance; chunks
of a block lower it as they go, and the first round (each query's nearest list) gives it to the second
(all its other lists), which therefore abandons most candidates after a few columns. What is left is
measured in double precision on the original vectors, coordinate after coordinate.

How many lists a query asks is measured on the sample: the fewest that hold TARGET of the sample's own
neighbours. Fitting sees SAMPLE_MAX points and decides which lists are probed; every row is indexed.

Defined cases: vectors that are NULL, empty, zero or hold NULL or non-finite components take no part,
nor do those of another length than the most frequent one (ties: the longer); a row without an id is a
candidate, behind all ids at equal distance, but no query; repeated rows are rows like any other, so a
row's copy is a candidate for it, and a repeated query is answered as often; an empty table, or one
without queries, gives no rows; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailstrata.llm.common import named, staged
from mailstrata.session import ship_package

K = 10
EVERY = 100
SEED = 11
#: Points that the index is fitted on, at most; points a list should hold; sample points behind a centroid.
SAMPLE_MAX = 32_768
LIST_ROWS = 512
SAMPLE_PER_LIST = 8
LLOYD_ROUNDS = 8
#: Share of the sample's own neighbours that the probed lists must hold, and sample queries asked.
TARGET = 0.985
TRIALS = 256
#: Rows of a block, rows of a chunk between two bounds, columns read between two tests.
BLOCK_ROWS = 4096
CHUNK = 512
COLUMNS = 8
EPS = 2.1
#: Single precision of the turned vectors.
SLACK = 1 + 1e-4


@dataclass
class Index:
    """What the tasks need: the turn is drawn from ``SEED`` again in each."""

    dim: int
    centroids: np.ndarray
    probes: int


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every process."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def squares(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all centroids."""
    return (points ** 2).sum(axis=1)[:, None] - 2 * points @ centroids.T + (centroids ** 2).sum(axis=1)


def k_means(points: np.ndarray, k: int) -> np.ndarray:
    centroids = points[np.random.default_rng(SEED).choice(len(points), k, replace=False)]
    for _ in range(LLOYD_ROUNDS):
        own = np.concatenate([squares(points[a:a + 4096], centroids).argmin(axis=1)
                              for a in range(0, len(points), 4096)])
        order = np.argsort(own, kind="stable")
        used, first = np.unique(own[order], return_index=True)
        centroids = centroids.copy()
        centroids[used] = np.add.reduceat(points[order], first) / np.diff([*first, len(points)])[:, None]
    return centroids


def fit(sample: np.ndarray, total: int, k: int = K) -> Index:
    """Centroids for ``total`` points, and the number of lists to probe."""
    lists = max(1, min(total // LIST_ROWS, len(sample) // SAMPLE_PER_LIST))
    centroids = k_means(sample, lists) if lists > 1 else sample.mean(axis=0, keepdims=True)
    own = np.concatenate([squares(sample[a:a + 4096], centroids).argmin(axis=1)
                          for a in range(0, len(sample), 4096)])
    asked = np.random.default_rng(SEED).choice(len(sample), min(TRIALS, len(sample)), replace=False)
    hits, wanted = np.zeros(lists, dtype=np.int64), 0
    for at in asked:
        near = ((sample - sample[at]) ** 2).sum(axis=1)
        near[at] = np.inf
        true = np.argsort(near, kind="stable")[:min(k, len(sample) - 1)]
        place = np.empty(lists, dtype=np.int64)
        place[squares(sample[at:at + 1], centroids)[0].argsort(kind="stable")] = np.arange(lists)
        hits += np.bincount(place[own[true]], minlength=lists)
        wanted += len(true)
    enough = np.nonzero(np.cumsum(hits) >= TARGET * wanted)[0]
    return Index(sample.shape[1], centroids, int(enough[0]) + 1 if len(enough) else lists)


# Rows ------------------------------------------------------------------------------------


def valid(df: DataFrame, dim: int, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, key, vec): rows that take part; ``vec`` holds the doubles, ``key`` names equal vectors."""
    ship_package(df.sparkSession)
    schema = pa.schema([("vec_id", pa.int64()), ("key", pa.binary()), ("vec", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) + 0.0
            good = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
            vecs = [row.tobytes() for row in values[good]]
            keys = [hashlib.blake2b(v, digest_size=16).digest() for v in vecs]
            ids = batch.column("vec_id").filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], schema=schema)

    vec = named(vector).cast("array<double>")
    sized = df.select(named(id_column).cast("long").alias("vec_id"), vec.alias("vec"))
    # Spark's size() of NULL is -1 or NULL; both fail the test. A NULL component is no number.
    return sized.where((F.size("vec") == dim) & ~F.exists("vec", lambda x: x.isNull())) \
        .mapInArrow(work, "vec_id long, key binary, vec binary")


def dimension(df: DataFrame, vector: str = "embedding") -> int:
    """The most frequent length of a vector, 0 if there is none."""
    sizes = df.where(named(vector).isNotNull()).groupBy(F.size(named(vector)).alias("dim")).count()
    top = sizes.where("dim > 0").orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    return top[0]["dim"] if top else 0


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, dim)


def nearest_lists(vecs: np.ndarray, index: Index, probes: int) -> np.ndarray:
    """Numbers of the nearest lists of each vector, nearest first."""
    away = squares(vecs, index.centroids)
    return np.argsort(away, axis=1, kind="stable")[:, :probes].astype(np.int32)


# Scan ------------------------------------------------------------------------------------


class Block:
    """Vectors of one block: turned ones by column, originals by row."""

    def __init__(self, turned: np.ndarray, vecs: np.ndarray, ids: list[list]):
        self.columns = np.ascontiguousarray(turned.T)
        self.vecs, self.ids = vecs, ids
        self.first = np.array([_rank(i[0]) for i in ids], dtype=np.float64)

    def search(self, turned: np.ndarray, vec: np.ndarray, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, distances) of the k nearest vectors within ``bound``, ordered by distance and least id."""
        dim, n = self.columns.shape
        places, scores = np.zeros(0, dtype=np.int64), np.zeros(0)
        for a in range(0, n, CHUNK):
            at = np.arange(a, min(a + CHUNK, n))
            partial = np.zeros(len(at), dtype=np.float32)
            for d in range(0, dim, COLUMNS):
                upto = min(d + COLUMNS, dim)
                part = self.columns[d:upto, at] if len(at) < CHUNK else self.columns[d:upto, a:a + CHUNK]
                partial += ((part - turned[d:upto, None]) ** 2).sum(axis=0)
                if bound < np.inf:
                    allowed = bound * bound * (upto / dim if upto < dim else 1.0)
                    allowed *= (1 + EPS / np.sqrt(upto)) ** 2 if upto < dim else SLACK
                    stay = partial <= allowed + 1e-12
                    at, partial = at[stay], partial[stay]
                if not len(at):
                    break
            if not len(at):
                continue
            exact = np.zeros(len(at))
            rows = self.vecs[at]
            for j in range(dim):
                exact += (rows[:, j] - vec[j]) ** 2
            places, scores = np.concatenate((places, at)), np.concatenate((scores, np.sqrt(exact)))
            order = np.lexsort((self.first[places], scores))[:k]
            places, scores = places[order], scores[order]
            if len(places) == k:
                bound = min(bound, float(scores[-1]))
        return places, scores


def _rank(i: int | None) -> float:
    return np.inf if i is None else float(i)


def _scan(dim: int, keep: int):
    """Tasks' function over rows sorted by (list, block, kind): vectors of a block, then its queries."""
    schema = pa.schema([("key", pa.binary()), ("score", pa.float64()), ("vec_id", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, held, block = None, [], None
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            lists, blocks, kinds = (batch.column(c).to_numpy() for c in ("list", "block", "kind"))
            cuts = np.nonzero((np.diff(lists) != 0) | (np.diff(blocks) != 0) | (np.diff(kinds) != 0))[0] + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(lists)]):
                if b == a:
                    continue
                own, part = (lists[a], blocks[a]), batch.slice(a, b - a)
                if own != where:
                    where, held, block = own, [], None
                vecs = _matrix(part.column("vec"), dim)
                turned = np.frombuffer(b"".join(part.column("turned").to_pylist()), dtype=np.float32).reshape(-1, dim)
                if kinds[a] == 0:
                    held.append((turned, vecs, part.column("ids").to_pylist()))
                    continue
                if block is None and held:
                    block = Block(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]),
                                  [i for h in held for i in h[2]])
                    held = []
                if block is None:
                    continue
                bounds = part.column("bound").to_numpy(zero_copy_only=False)
                for row, key in enumerate(part.column("key").to_pylist()):
                    places, scores = block.search(turned[row], vecs[row], float(bounds[row]), keep)
                    found = sorted(((s, _rank(i), i) for p, s in zip(places.tolist(), scores.tolist())
                                    for i in block.ids[p]), key=lambda x: x[:2])[:keep]
                    out[0].extend([key] * len(found))
                    out[1].extend(s for s, _, _ in found)
                    out[2].extend(i for _, _, i in found)
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(out, schema)], schema=schema)

    return work


def _best(found: DataFrame, keep: int) -> DataFrame:
    """(key, best): per query vector its ``keep`` nearest rows as (score, vec_id), nearest first."""
    order = Window.partitionBy("key").orderBy("score", F.col("vec_id").asc_nulls_last())
    top = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)
    return top.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "score", "vec_id"))).alias("best"))


def neighbours(df: DataFrame, k: int = K, every: int = EVERY, id_column: str = "vec_id",
               vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for every row whose id ``every`` divides."""
    spark = df.sparkSession
    dim = dimension(df, vector)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not dim:
        return empty
    keep = k + 1  # a query's own row is left out at the end
    rows = staged(valid(df, dim, id_column, vector), "vectors")
    by_id = Window.partitionBy("key").orderBy(F.col("vec_id").asc_nulls_last())
    # The least ids of equal vectors are kept before they are shuffled: a popular vector meets as few rows a task.
    points = staged(rows.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= keep)
                    .groupBy("key").agg(F.min("vec").alias("vec"), F.transform(F.array_sort(F.collect_list(
                        F.struct("place", "vec_id"))), lambda x: x["vec_id"]).alias("ids")), "points")
    total = points.count()
    if not total:
        return empty
    by_hash = F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(1 << 30))
    sampled = points.where(by_hash <= int(min(1.0, SAMPLE_MAX / total) * (1 << 30))) \
        .select("vec").orderBy(F.xxhash64("key")).limit(SAMPLE_MAX).toArrow()
    if not sampled.num_rows:
        sampled = points.select("vec").limit(1).toArrow()
    index = fit(_matrix(sampled.column("vec").combine_chunks(), dim), total, k)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim)
        for batch in batches:
            if not batch.num_rows:
                continue
            vecs = _matrix(batch.column("vec"), dim)
            near = nearest_lists(vecs, index, index.probes if "ids" not in batch.schema.names else 1)
            turned = pa.array([t.tobytes() for t in (vecs @ turn).astype(np.float32)], pa.binary())
            if "ids" in batch.schema.names:
                made = [pa.array(near[:, 0]), batch.column("ids"), batch.column("vec"), turned]
                yield pa.RecordBatch.from_arrays(made, names=["list", "ids", "vec", "turned"])
            else:
                made = [batch.column("key"), batch.column("vec"), turned, pa.array(near.tolist(), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(made, names=["key", "vec", "turned", "lists"])

    lists = staged(points.select("ids", "vec").mapInArrow(place, "list int, ids array<long>, vec binary, turned binary"), "lists")
    queries = rows.where(F.col("vec_id") % every == 0)
    asked = staged(queries.select("key", "vec").dropDuplicates(["key"])
                   .mapInArrow(place, "key binary, vec binary, turned binary, lists array<int>"), "asked")
    # As many rows as there are lists, SAMPLE_MAX / SAMPLE_PER_LIST at most.
    blocks = F.broadcast(lists.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")))
    stored = lists.join(blocks, "list").select(
        "list", F.pmod(F.xxhash64("vec"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("kind"),
        F.lit(None).cast("binary").alias("key"), "ids", "vec", "turned", F.lit(0.0).alias("bound"))

    def scan(probes: DataFrame) -> DataFrame:
        to = probes.join(blocks, "list").select(
            "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"),
            "key", F.lit(None).cast("array<long>").alias("ids"), "vec", "turned", "bound")
        both = stored.unionByName(to).repartition("list", "block").sortWithinPartitions("list", "block", "kind")
        return both.mapInArrow(_scan(dim, keep), "key binary, score double, vec_id long")

    first = staged(_best(scan(asked.select("key", "vec", "turned", F.col("lists")[0].alias("list"),
                                           F.lit(float("inf")).alias("bound"))), keep), "first")
    bound = F.when(F.size("best") == keep, F.col("best")[keep - 1]["score"]).otherwise(float("inf"))
    rest = asked.join(first.select("key", bound.alias("bound")), "key", "left").select(
        "key", "vec", "turned", F.explode(F.slice("lists", 2, max(1, index.probes))).alias("list"),
        F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    found = first.select("key", F.explode("best").alias("x")).select("key", "x.score", "x.vec_id")
    best = _best(found.unionByName(scan(rest)), keep)
    # The query's own row: the first of its id at distance zero.
    own = F.array_position(F.transform("best", lambda x: (x["vec_id"] == F.col("query_id")) & (x["score"] == 0)), True)
    others = F.filter("best", lambda x, i: (own == 0) | (i != own - 1))
    return queries.select(F.col("vec_id").alias("query_id"), "key").join(best, "key") \
        .select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "x")) \
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")

"""Near-duplicates by similarity: texts whose five-word shingles have a Jaccard similarity of at least 0.8.

The search is the forest of vantage-point trees of ``simhash``, over SimHash fingerprints of the five-word
shingles, and an exact check. Many such pairs lie farther apart than its radius (5 to 13 of 64 bits), and
at a radius that holds them all no tree prunes; these are found by the shingles themselves:

* *copies* collapse first, by a digest of 128 bits, and only distinct texts take part in what follows;
* *forest*: fingerprints within ``simhash.RADIUS`` bits, found by the trees with boundary points sent to
  both shards, are links between candidates;
* *sketch*, for what lies beyond that radius: BANDS keys of ROWS least hashes each. Two texts of similarity 0.8 share no key with
  probability (1 - 0.8 ** ROWS) ** BANDS, less than 1e-9; more similar ones still less often;
* *coarse groups*: the texts of a key form a star, never its pairs; stars are begun before the keys are
  dealt, so that a frequent key sends one row per run of texts. The components of all stars and of the
  forest's links are groups that hold every pair which shares a key or is within the radius;
* *exact check*: only texts in a coarse group travel, once per size class and the next one (sizes of
  similar texts differ by a quarter at most). There the exact similarity decides about every link, and
  a spanning forest of the links is reported; its components are the result;
* *large groups* are cut into blocks of bounded size, with two texts of the group in all of them. A link
  between blocks that is still unknown then has an end outside the group's largest component, so only
  the texts outside it meet all blocks, again in parts of bounded size.

Words are runs without white space, A-Z in lower case; a text of fewer words is one shingle. Words and
shingles are known by 64-bit hashes.

Defined cases: texts without words are similar to each other; a NULL text is such a text; a text of any
length is read whole; a row without an id stays, and is not a member of a group; of rows equal in id and
text one stays; rows that share an id but not a group are kept or dropped each by its own text; an empty
table gives an empty result; further columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailstrata.llm import simhash
from mailstrata.llm.common import map_texts, named, shingle_hashes, staged, unstage, word_hashes
from mailstrata.llm.contraction import connected
from mailstrata.session import ship_package

SHINGLE = 5
#: Least similarity as a fraction.
LEAST = (4, 5)
BANDS = 40
ROWS = 4
_STEP = 1024
#: Shingles of the texts that meet in one call, about; a larger coarse group is cut into blocks.
BLOCK_MARKS = 1 << 20
#: Distinct texts whose keys are combined before they are dealt.
RUN = 1 << 13

_RNG = np.random.default_rng(42)
_FACTOR = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)
_FOLD = _RNG.integers(0, 1 << 64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_BAND = _RNG.integers(0, 1 << 64, BANDS, dtype=np.uint64)


def shingles(data: bytes | None) -> np.ndarray:
    """The distinct shingles of a text, as hashes in order."""
    return np.unique(shingle_hashes(word_hashes(data or b"")[0], SHINGLE))


def keys(marks: np.ndarray) -> np.ndarray:
    """The band keys of a set of shingles."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, dtype=np.uint64)
    for at in range(0, len(marks), _STEP):
        np.minimum(least, (marks[None, at: at + _STEP] * _FACTOR).min(axis=1), out=least)
    least ^= least >> np.uint64(31)
    out = (least.reshape(BANDS, ROWS) * _FOLD).sum(axis=1, dtype=np.uint64) + _BAND
    return out ^ out >> np.uint64(29)


def text_key(text: Column) -> Column:
    """Digest of 128 bits of a text's bytes; NULL as the empty text."""
    return F.unhex(F.md5(F.coalesce(text.cast("string").cast("binary"), F.lit("").cast("binary"))))


def sketches(texts: DataFrame) -> DataFrame:
    """(node, id, digest, keys, fp) of each distinct text of ``texts(id, digest, text)``: its least id, band keys and
    fingerprint."""
    def make() -> Callable:
        def work(values: list, part: pa.RecordBatch) -> list:
            sets = [shingles(v) for v in values]
            prints = np.array([simhash.majority(s) for s in sets], dtype=np.uint64).view(np.int64)
            return [part.column("id"), part.column("digest"), [keys(s).tobytes() for s in sets], prints]
        return work

    drawn = map_texts(texts, "text", make, "id long, digest binary, keys binary, fp long")
    once = drawn.groupBy("digest").agg(F.min("id").alias("id"), F.first("keys").alias("keys"), F.first("fp").alias("fp"))
    return staged(once.select(F.monotonically_increasing_id().alias("node"), "id", "digest", "keys", "fp"), "sketches")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of keys, one per key and run of texts, and links (``via``) of the run's other texts to it."""
    held: list[pa.RecordBatch] = []

    def combined() -> pa.RecordBatch:
        part = pa.Table.from_batches(held).combine_chunks()
        node = np.repeat(part.column("node").to_numpy(), BANDS)
        band = np.frombuffer(b"".join(part.column("keys").to_pylist()), dtype=np.int64)
        order = np.lexsort((node, band))
        node, band = node[order], band[order]
        opens = np.concatenate(([True], band[1:] != band[:-1]))
        root = node[np.maximum.accumulate(np.where(opens, np.arange(len(node)), 0))]
        links = np.unique(np.stack((root, node))[:, ~opens], axis=1)
        none = np.zeros(links.shape[1], dtype=bool)
        # A link needs no key; its own node deals it evenly.
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate((band[opens], links[1]))), pa.array(np.concatenate((node[opens], links[1]))),
            pa.array(np.concatenate((node[opens], links[0])), mask=np.concatenate((opens[opens], none)))],
            names=["band", "node", "via"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(x.num_rows for x in held) >= RUN:
            yield combined()
            held.clear()
    if held:
        yield combined()


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from the first text of each key to its others, and the links made before; in order of (band, node)."""
    key = root = None
    for batch in batches:
        linked = batch.column("via").is_valid().to_numpy(zero_copy_only=False)
        if linked.any():
            ready = batch.filter(pa.array(linked))
            yield pa.RecordBatch.from_arrays([ready.column("via"), ready.column("node")], names=["a", "b"])
        band, node = batch.column("band").to_numpy()[~linked], batch.column("node").to_numpy()[~linked]
        if not len(band):
            continue
        opens = np.concatenate(([key is None or band[0] != key], band[1:] != band[:-1]))
        at = np.maximum.accumulate(np.where(opens, np.arange(len(band)), -1))
        roots = np.where(at >= 0, node[at], 0 if root is None else root)
        key, root = band[-1], roots[-1]
        fresh = node != roots
        yield pa.RecordBatch.from_arrays([pa.array(roots[fresh]), pa.array(node[fresh])], names=["a", "b"])


def near_prints(drawn: DataFrame, points: DataFrame) -> DataFrame:
    """(a, b): edges whose components are those of all texts of ``drawn(node, fp)`` within ``simhash.RADIUS`` bits.

    ``points(fp, first)`` holds each fingerprint and the least of its texts, staged.
    """
    links = simhash.links(points)
    ends = links.join(points.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(
        points.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = drawn.select("node", "fp").join(points, "fp").where(F.col("node") != F.col("first"))
    return ends.union(same.select(F.col("first").alias("a"), F.col("node").alias("b")))


def coarse(drawn: DataFrame) -> DataFrame:
    """(node, root) of all texts of ``sketches`` that the forest links to another one or that share a key with one."""
    ship_package(drawn.sparkSession)
    entries = drawn.select("node", "keys").mapInArrow(_entries, "band long, node long, via long")
    ordered = entries.repartition("band").sortWithinPartitions("band", "node")
    points = staged(drawn.groupBy("fp").agg(F.min("node").alias("first")), "points")
    found = near_prints(drawn, points).union(ordered.mapInArrow(_stars, "a long, b long"))
    edges = staged(found.distinct(), "stars")
    labels = connected(edges)
    unstage(drawn.sparkSession, edges)
    unstage(drawn.sparkSession, points)
    return labels


def forest(sizes: np.ndarray, values: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets, given their sizes and, one after the other, their members.

    Breadth first over what is still unvisited. A set is met through the lists of its members or, where
    these are longer (a dense group), through the members of all unvisited sets.
    """
    up, down = LEAST
    n = len(sizes)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    known, codes = np.unique(values, return_inverse=True)
    counts = np.bincount(codes, minlength=len(known))
    owner = np.repeat(np.arange(n), sizes)
    listed = owner[np.argsort(codes, kind="stable")]
    heads = np.concatenate(([0], np.cumsum(counts)))
    mark, fresh, links = np.zeros(len(known), dtype=bool), np.ones(n, dtype=bool), []
    rest_owner, rest_codes, left = owner, codes, n
    empty = np.nonzero(sizes == 0)[0]
    links.extend((int(empty[0]), int(x)) for x in empty[1:])
    fresh[empty] = False
    left -= len(empty)
    for root in range(n):
        if not fresh[root]:
            continue
        fresh[root] = False
        left -= 1
        frontier = [root]
        while frontier and left:
            x = frontier.pop()
            mine = codes[ends[x]: ends[x + 1]]
            if counts[mine].sum() <= len(rest_codes):
                met = np.concatenate([listed[heads[c]: heads[c + 1]] for c in mine])
            else:
                mark[mine] = True
                met = rest_owner[mark[rest_codes]]
                mark[mine] = False
            other, shared = np.unique(met, return_counts=True)
            near = other[fresh[other] & (shared * (up + down) >= up * (sizes[x] + sizes[other]))]
            if len(near):
                links.extend((root, int(y)) for y in near)
                frontier.extend(near.tolist())
                fresh[near] = False
                left -= len(near)
                if 2 * int(sizes[fresh].sum()) < len(rest_codes):
                    stay = fresh[rest_owner]
                    rest_owner, rest_codes = rest_owner[stay], rest_codes[stay]
    return links


def _search(group: pa.Table) -> pa.Table:
    column = group.column("marks").combine_chunks()
    node = group.column("node").to_numpy()
    found = forest(column.value_lengths().to_numpy().astype(np.int64), column.flatten().to_numpy())
    pairs = node[np.array(found, dtype=np.int64).reshape(-1, 2)]
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def mark_sets(texts: DataFrame) -> DataFrame:
    """(root, node, class, marks): the shingles of ``texts(root, node, text)`` and the class of their number."""
    def make() -> Callable:
        def work(values: list, part: pa.RecordBatch) -> list:
            sets = [shingles(v) for v in values]
            sizes = np.array([len(s) for s in sets])
            own = np.where(sizes > 0, np.floor(np.log(np.maximum(sizes, 1)) / np.log(LEAST[1] / LEAST[0])), -2).astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
            flat = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
            return [part.column("root"), part.column("node"), pa.array(own), lists]
        return work

    return map_texts(texts, "text", make, "root long, node long, class long, marks array<long>")


def verified(sets: DataFrame, block_marks: int = BLOCK_MARKS) -> DataFrame:
    """(a, b): edges whose components are those of all similar pairs inside the roots of ``sets``.

    ``sets`` must be cheap to read more than once (a staged table).
    """
    weight = F.size("marks") + F.lit(16)

    def both(df: DataFrame) -> DataFrame:
        # Similar sizes are in the same class or in neighbours; so each text goes to its own and the next.
        return df.withColumn("class", F.explode(F.array(F.col("class"), F.col("class") + 1)))

    sized = both(sets.select("root", "node", "class", weight.alias("n"))).groupBy("root", "class").agg(
        F.ceil(F.sum("n") / block_marks).cast("int").alias("blocks"), F.min("node").alias("hub"), F.max("node").alias("far"))
    large = staged(sized.where("blocks > 1"), "large")
    dealt = both(sets).join(large, ["root", "class"], "left")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    place = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).when(
        F.col("node").isin(F.col("hub"), F.col("far")), every).otherwise(F.array(own))
    small = dealt.select("root", "class", "node", "marks", F.explode(place).alias("block"))
    edges = staged(small.groupBy("root", "class", "block").applyInArrow(_search, "a long, b long"), "similar")
    if large.isEmpty():
        return edges
    # Between blocks: whatever is outside the largest component of a large group meets all blocks of it.
    labels = connected(edges).select(F.col("node").alias("known"), F.col("root").alias("part"))
    inside = both(sets.select("root", "node", "class", weight.alias("n"))).join(large, ["root", "class"])
    inside = staged(inside.join(labels, inside.node == labels.known, "left").select(
        "root", "class", "node", "n", "blocks", F.coalesce("part", "node").alias("part")), "inside")
    parts = inside.groupBy("root", "class", "part").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    top = staged(parts.groupBy("root", "class").agg(
        F.max_by("part", F.struct("rows", "part")).alias("top"),
        F.ceil((F.sum("n") - F.max_by("n", F.struct("rows", "part"))) / block_marks).cast("int").alias("turns")), "tops")
    apart = inside.join(top, ["root", "class"]).select("root", "class", "node", "blocks", "turns",
                                                       (F.col("part") != F.col("top")).alias("outside"))
    apart = staged(apart.withColumn("turns", F.greatest("turns", F.lit(1))), "apart")
    open_ = apart.where("outside").select("root", "class").distinct()
    turn = F.pmod(F.xxhash64("node", F.lit(1)), F.col("turns")).cast("int")
    meets = apart.join(open_, ["root", "class"], "left_semi").select(
        "root", "class", "node", "blocks", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), own.alias("block")).unionByName(
        apart.where("outside").select("root", "class", "node", "blocks", turn.alias("turn"), F.explode(every).alias("block")))
    held = meets.distinct().join(sets.select("node", "marks"), "node")
    more = held.groupBy("root", "class", "turn", "block").applyInArrow(_search, "a long, b long")
    return edges.unionByName(more)


def keep_one(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", block_marks: int = BLOCK_MARKS) -> DataFrame:
    """One row of ``df`` per group of similar texts: the least by (id, digest of the text); rows without an id stay."""
    spark = df.sparkSession
    text = named(text_column)
    some = df.where(named(id_column).isNotNull())
    texts = some.select(named(id_column).cast("long").alias("id"), text_key(text).alias("digest"),
                        text.cast("string").cast("binary").alias("text"))
    drawn = sketches(texts)
    labels = coarse(drawn)
    of = staged(drawn.select("node", "id", "digest").join(labels, "node"), "suspects")
    # By id and digest: of a text's copies one row is asked for, and the others are spread over all tasks.
    met = texts.join(of.hint("merge"), ["id", "digest"]).dropDuplicates(["id", "digest"])
    sets = staged(mark_sets(met.select("root", "node", "text")), "sets")
    final = connected(verified(sets, block_marks)).select("node", F.col("root").alias("group"))
    members = of.select("node", "id", "digest").join(final, "node")
    first = members.groupBy("group").agg(F.min(F.struct("id", "digest")).alias("first"))
    gone = members.join(first, "group").where(F.struct("id", "digest") != F.col("first")).select("node")
    stay = staged(drawn.select("node", "id", "digest").join(gone, "node", "left_anti").select("id", "digest"), "stay")
    unstage(spark, sets)
    unstage(spark, drawn)
    rows = some.select(F.struct(*[named(c) for c in df.columns]).alias("row"), named(id_column).cast("long").alias("id"),
                       text_key(text).alias("digest"), text.isNull().alias("blank"))
    # Rows equal in id and text differ in other columns only; the join has sorted them side by side.
    rest = F.to_json(F.struct("blank", *[F.col("row").getField(c).alias(f"c{i}") for i, c in enumerate(df.columns) if c != text_column]))
    kept = rows.join(stay.hint("merge"), ["id", "digest"]).groupBy("id", "digest").agg(F.min_by("row", rest).alias("row"))
    return kept.select("row.*").unionByName(df.where(named(id_column).isNull()))

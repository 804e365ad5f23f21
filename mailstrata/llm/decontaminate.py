"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact verification.

An item of L words is sought in every window of L words of a document (a shorter document is one
window). Both are sets of shingles of five words with multiplicities; a window is a hit if its weighted
Jaccard similarity with the item is at least THRESHOLD.

1. A window that is similar at all shares a shingle with the item, so only windows that hold a shingle
   of some item of this length are looked at; shingles are found by hash in one vector step per text.
2. Each such window has a 64-bit SimHash, from running sums over the shingles' bits. The multi-index
   cuts fingerprints into BLOCKS blocks: two fingerprints within RADIUS bits agree up to
   RADIUS // BLOCKS bits in at least one block, so looking up each block among the items' blocks and
   their near variants misses none of them.
3. Candidates within RADIUS are verified by the exact similarity of their words' shingles. RADIUS is
   far above what two windows of the threshold's similarity differ by (about 10 of 64 bits, deviation
   under 3).

The benchmark is read in blocks of at most ITEM_BYTES of text; each block's index goes to the tasks of
one pass over the documents, so its size is bounded whatever the benchmark's.

Defined cases: a NULL or empty document or item matches nothing; items of fewer than five words are one
shingle of all their words; repeated items and rows are reported each; NULL ids are carried; extra
columns are ignored, or passed through by ``drop_contaminated``; either table may be empty.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mailstrata.llm.common import documents, map_texts, named, shingle_hashes, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 23
BLOCKS = 8
ITEM_BYTES = 4 * 1024 * 1024
_FILTER_BITS = 20


def shingles(words: list[bytes], size: int = SHINGLE) -> Counter:
    if not words:
        return Counter()
    size = min(size, len(words))
    return Counter(zip(*(words[k: len(words) - size + 1 + k] for k in range(size))))


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: common multiplicities over united ones."""
    common = sum((a & b).values())
    union = sum(a.values()) + sum(b.values()) - common
    return common / union if union else 0.0


def window_prints(hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """SimHash of the ``width`` shingle hashes from each start on; ``starts`` ascend."""
    first, last = int(starts[0]), int(starts[-1]) + width
    bits = np.unpackbits(hashes[first:last].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((last - first + 1, 64), dtype=np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=sums[1:])
    votes = sums[starts - first + width] - sums[starts - first]
    return np.packbits(2 * votes > width, axis=1, bitorder="little").view(np.uint64).ravel()


@dataclass
class Item:
    item_id: int | None
    counts: Counter
    print: int
    length: int
    size: int  # words of a shingle


class Index:
    """Items of one block: a filter of shingle hashes, shingle to lengths, and a multi-index per length."""

    def __init__(self, rows: list[tuple[int | None, bytes | None]]) -> None:
        self.items: dict[int, list[Item]] = defaultdict(list)
        owners: dict[int, set[int]] = defaultdict(set)
        for item_id, text in rows:
            words = (text or b"").lower().split()
            if not words:
                continue
            size = min(SHINGLE, len(words))
            hashes = shingle_hashes(word_hashes(text)[0], size)
            mark = int(window_prints(hashes, np.zeros(1, dtype=np.int64), len(hashes))[0])
            self.items[len(words)].append(Item(item_id, shingles(words, size), mark, len(words), size))
            for h in hashes.tolist():
                owners[h].add(len(words))
        self.sizes = sorted({i.size for group in self.items.values() for i in group})
        self.owners = {h: sorted(lengths) for h, lengths in owners.items()}
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        if owners:
            keys = np.array(list(owners), dtype=np.uint64)
            self.filter[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        # tables[length][block][value]: items with a block within RADIUS // BLOCKS bits of the value.
        value = np.arange(256, dtype=np.uint8)
        self.tables = {length: [[np.nonzero(np.bitwise_count(
            value[v] ^ np.array([i.print >> (8 * b) & 255 for i in group], dtype=np.uint8))
            <= RADIUS // BLOCKS)[0].tolist() for v in range(256)] for b in range(BLOCKS)]
            for length, group in self.items.items()}

    def candidates(self, length: int, mark: int) -> list[int]:
        """Items of ``length`` words within RADIUS of a window's fingerprint: all of them."""
        tables, group = self.tables[length], self.items[length]
        near = {i for b in range(BLOCKS) for i in tables[b][mark >> (8 * b) & 255]}
        return [i for i in sorted(near) if (group[i].print ^ mark).bit_count() <= RADIUS]

    def hits(self, data: bytes | None) -> list[tuple[int | None, int, int, float]]:
        """(item_id, first word, differing bits, similarity): the best window per item, the first of equals."""
        if not data or not self.items:
            return []
        words, starts, ends = word_hashes(data)
        n = len(words)
        if not n:
            return []
        anchors: dict[int, set[int]] = defaultdict(set)  # length -> places of shared shingles
        rolled = {}
        for size in self.sizes:
            if size > n:
                continue
            rolled[size] = hashes = shingle_hashes(words, size)
            for at in np.nonzero(self.filter[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])[0].tolist():
                for length in self.owners.get(int(hashes[at]), ()):
                    if min(SHINGLE, length) == size:
                        anchors[length].add(at)
        if not anchors:
            return []
        text = [data[a:b].lower() for a, b in zip(starts.tolist(), ends.tolist())]
        best: dict[int, tuple[float, int, int, int]] = {}
        for length, places in anchors.items():
            size = min(SHINGLE, length)
            width = min(length, n) - size + 1
            last = rolled[size].shape[0] - width
            begins = np.array(sorted({s for p in places for s in range(max(0, p - width + 1), min(p, last) + 1)}),
                              dtype=np.int64)
            if not len(begins):
                continue
            # Runs of neighbouring windows share their running sums.
            for run in np.split(begins, np.nonzero(np.diff(begins) > width)[0] + 1):
                for begin, mark in zip(run.tolist(), window_prints(rolled[size], run, width).tolist()):
                    near = self.candidates(length, mark)
                    if not near:
                        continue
                    window = shingles(text[begin: begin + min(length, n)], size)
                    for i in near:
                        item = self.items[length][i]
                        score = similarity(window, item.counts)
                        if score >= THRESHOLD and score > best.get(id(item), (0.0,))[0]:
                            best[id(item)] = (score, begin, (item.print ^ mark).bit_count(), item.item_id)
        return [(item_id, begin, bits, score) for score, begin, bits, item_id in best.values()]


def benchmark_blocks(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text") -> list[list]:
    """Thunks that each read one block of items, of about ITEM_BYTES of text."""
    items = documents(benchmark, id_column, text_column)
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / ITEM_BYTES))
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))
    return [lambda b=b: [(r[0], bytes(r[1])) for r in items.where("text is not null").where(part == b).collect()]
            for b in range(n)]


def matches(df: DataFrame, benchmark: DataFrame, id_column: str = "doc_id",
            text_column: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, hamming, similarity) of every item found in a document."""
    docs = documents(df, id_column, text_column)
    out = None
    for read in benchmark_blocks(benchmark):
        index = df.sparkSession.sparkContext.broadcast(Index(read()))

        def make(index=index) -> Callable:
            def work(texts: list, part: pa.RecordBatch) -> list:
                ids = part.column("doc_id").to_pylist()
                rows = [(d, *hit) for d, t in zip(ids, texts) for hit in index.value.hits(t)]
                return list(zip(*rows)) or [[]] * 5
            return work

        found = map_texts(docs, "text", make,
                          "doc_id long, item_id long, first_word long, hamming long, similarity double")
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows of ``df`` that hold no item, with its columns; one pass per block of the benchmark."""
    out = df
    for read in benchmark_blocks(benchmark):
        index = df.sparkSession.sparkContext.broadcast(Index(read()))
        packed = out.select(F.struct(*[named(c) for c in df.columns]).alias("row"),
                            named(text_column).cast("string").cast("binary").alias("text"))

        def make(index=index) -> Callable:
            def work(texts: list, part: pa.RecordBatch) -> pa.RecordBatch:
                clean = pa.array([not index.value.hits(t) for t in texts], type=pa.bool_())
                return part.select(["row"]).filter(clean)
            return work

        out = map_texts(packed, "text", make, StructType([packed.schema["row"]])).select("row.*")
    return out

"""Token ids as binary files: Simple-8b words with escapes and a directory of blocks.

A *file image* is, in little-endian order:

    magic "S8TB", version u32, documents u64, ids u64, blocks u64, words u64, escapes u64
    doc_id i64 per document; present u8 per document (0: the id was NULL); ids per document u64
    per block: place of its first word u64, place of its first escape u64
    words u64; escaped ids u64

A block is BLOCK ids (the last one fewer) and is packed on its own. A word's top four bits select how
many ids of how many bits its other sixty hold. In the widest field of many (20 bits) the value of all
ones stands for the next escaped id, so one large id never forces its neighbours into wide fields. A
reader finds any block by the directory and decodes all words of one selector in one vector step.

Spark sorts the documents by range, packs each range as a stream into images of bounded size, and
writes the images as rows of a table in the shared folder, so its commit protocol covers lost
executors; ``read_back`` reads that table alone.

Defined cases: a NULL or empty text is the end id alone; NULL ids come first; documents that share an
id are ordered by their texts; extra columns are left out; an empty table writes and reads no file.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailstrata.llm.bpe import DEFAULT, Pieces, resolve, text_groups
from mailstrata.llm.common import documents, slices, staged
from mailstrata.session import ship_package

END = 2
BLOCK = 65_536
#: Ids of one file image; bounds the memory of a reader and a writer.
FILE_IDS = 2_000_000
#: (ids of a word, bits of each): selector 0 to 15.
SELECTORS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8),
             (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE_BITS = 20
ESCAPE = (1 << ESCAPE_BITS) - 1
_MAGIC = b"S8TB"
_HEAD = struct.Struct("<4sIQQQQQ")


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escapes) of one block of ids."""
    large = ids >= ESCAPE
    escapes = ids[large].astype(np.uint64)
    values = np.where(large, ESCAPE, ids).astype(np.int32)
    n = len(values)
    chosen = np.full(n, len(SELECTORS) - 1, dtype=np.int8)
    free = np.ones(n, dtype=bool)
    at = np.arange(n, dtype=np.int32)
    least = int(values.min()) if n else 0
    for selector, (count, bits) in enumerate(SELECTORS[:-1]):
        if least >= 1 << bits:
            continue
        wide = np.where(values >= np.int32(min(1 << bits, (1 << 31) - 1)), at, np.int32(n + 240))
        stop = np.minimum.accumulate(wide[::-1])[::-1]  # the next id that is too wide
        fits = free & (stop - at >= count)
        chosen[fits] = selector
        free &= ~fits
    counts = np.array([c for c, _ in SELECTORS])[chosen].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += counts[i]
    starts = np.array(starts, dtype=np.int64)
    picked = chosen[starts].astype(np.uint64)
    words = picked << np.uint64(60)
    padded = np.concatenate((values.astype(np.uint64), np.zeros(240, dtype=np.uint64)))
    for selector, (count, bits) in enumerate(SELECTORS):
        mine = np.nonzero(picked == selector)[0]
        if bits and len(mine):
            fields = padded[starts[mine][:, None] + np.arange(count)]
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            words[mine] |= np.bitwise_or.reduce(fields << shifts, axis=1)
    return words, escapes


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of one block."""
    picked = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS])[picked]
    starts = np.cumsum(counts) - counts
    out = np.zeros(n + 240, dtype=np.uint64)
    for selector, (count, bits) in enumerate(SELECTORS):
        mine = np.nonzero(picked == selector)[0]
        if bits and len(mine):
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            out[starts[mine][:, None] + np.arange(count)] = \
                (words[mine][:, None] >> shifts) & np.uint64((1 << bits) - 1)
    out = out[:n]
    out[out == ESCAPE] = escapes
    return out


def write_image(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    parts = [pack(ids[k: k + BLOCK]) for k in range(0, len(ids), BLOCK)]
    sizes = np.array([[len(w), len(e)] for w, e in parts], dtype=np.uint64).reshape(-1, 2)
    places = np.cumsum(sizes, axis=0, dtype=np.uint64) - sizes
    total = sizes.sum(axis=0)
    return b"".join([
        _HEAD.pack(_MAGIC, 1, len(doc_ids), len(ids), len(parts), int(total[0]), int(total[1])),
        np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes(),
        bytes(0 if d is None else 1 for d in doc_ids),
        np.array(counts, dtype="<u8").tobytes(),
        places.astype("<u8").tobytes(),
        *[w.astype("<u8").tobytes() for w, _ in parts],
        *[e.astype("<u8").tobytes() for _, e in parts]])


def read_image(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, ids per document, ids) of a file image."""
    magic, version, n_docs, n_ids, n_blocks, n_words, n_escapes = _HEAD.unpack_from(image)
    if magic != _MAGIC or version != 1:
        raise ValueError("not a token file of version 1")
    at = _HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(image, dtype=kind, count=n, offset=at)
        at += out.nbytes
        return out

    doc_ids, present, counts = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs)
    places = take("<u8", 2 * n_blocks).reshape(-1, 2).astype(np.int64)
    words, escapes = take("<u8", n_words), take("<u8", n_escapes)
    stops = np.vstack((places[1:], [[n_words, n_escapes]])) if n_blocks else places
    blocks = [unpack(words[a:b], escapes[c:d], min(BLOCK, n_ids - k * BLOCK))
              for k, ((a, c), (b, d)) in enumerate(zip(places, stops))]
    ids = np.concatenate(blocks) if blocks else np.zeros(0, dtype=np.uint64)
    return [d if p else None for d, p in zip(doc_ids.tolist(), present)], counts.astype(np.int64), ids


class Library(Pieces):
    """Ids by the tokenizers library, which sees every distinct piece once while it is remembered."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        super().__init__({token.content: i for i, token in added.items()})

        self.opens = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        self.opens[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("\u0120")]] = True

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """One call for all pieces that open with a blank: side by side they are cut as they were, and
        only their first tokens hold one. The others go as a batch."""
        out: list[list[int]] = [[]] * len(pieces)
        opening = [k for k, p in enumerate(pieces) if len(p) > 1 and p[0] == " " and not p[1].isspace()]
        ids = self.tokenizer.encode_batch_fast(
            ["".join([pieces[k] for k in opening])], add_special_tokens=False)[0].ids if opening else []
        starts = np.flatnonzero(self.opens[ids]).tolist() if ids else []
        if len(starts) != len(opening):
            opening = []
        for k, a, b in zip(opening, starts, [*starts[1:], len(ids)]):
            out[k] = ids[a:b]
        rest = sorted(set(range(len(pieces))) - set(opening))
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[k] for k in rest], add_special_tokens=False)):
            out[k] = e.ids
        return out


@functools.lru_cache(maxsize=2)
def library(vocabulary: str) -> Library:
    return Library(resolve(vocabulary))


def write_files(df: DataFrame, vocabulary: str = DEFAULT, end: int = END, id_column: str = "doc_id",
                text_column: str = "text") -> DataFrame:
    """The table of file images (part, before, n_ids, image) of ``df`` in ascending order of ids; ``before``
    counts the ids of earlier files of the part."""
    spark = df.sparkSession
    ship_package(spark)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")
    ordered = documents(df, id_column, text_column).repartitionByRange(width, F.col("doc_id"), tie) \
        .sortWithinPartitions("doc_id", tie, "text")
    schema = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("image", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, place, before = library(vocabulary), TaskContext.get().partitionId(), 0
        closing = np.array([end], dtype=np.uint32)
        doc_ids, counts, streams, size = [], [], [], 0

        def file() -> pa.RecordBatch:
            ids = np.concatenate(streams) if streams else np.zeros(0, dtype=np.uint32)
            return pa.RecordBatch.from_arrays(
                [pa.array([x], type=f.type) for x, f in
                 zip((place, before, len(ids), write_image(doc_ids, counts, ids)), schema)], schema=schema)

        for part, texts in slices(batches, "text"):
            rows = iter(part.column("doc_id").to_pylist())
            for group in text_groups(texts):
                for ids in of.encode_arrays(group):
                    doc_ids.append(next(rows))
                    counts.append(len(ids) + 1)
                    streams += ids, closing
                    size += len(ids) + 1
                    if size >= FILE_IDS:
                        yield file()
                        before += size
                        doc_ids, counts, streams, size = [], [], [], 0
        if doc_ids:
            yield file()

    return staged(ordered.mapInArrow(run, "part int, before long, n_ids long, image binary"), "token_files")


def read_back(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, from the file images alone."""
    ship_package(files.sparkSession)
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    # One row per range of the writer: as many as its partitions, whatever the size of the corpus.
    parts = sizes.select("part", (F.sum("part_ids").over(Window.orderBy("part")) - F.col("part_ids")).alias("earlier"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, image in zip(batch.column("start").to_pylist(), batch.column("image")):
                doc_ids, counts, ids = read_image(image.as_py())
                stops = np.cumsum(counts)
                raw = ids.astype("<u4").tobytes()
                sums = [zlib.crc32(raw[4 * (b - c): 4 * b]) for b, c in zip(stops.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, type=pa.int64()), pa.array(first + stops - counts),
                     pa.array(counts), pa.array(sums, type=pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = files.join(F.broadcast(parts), "part").select((F.col("earlier") + F.col("before")).alias("start"), "image")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")

"""Language-model scores from an Elias-Fano trie of word bigrams.

*Model*. Tokens are words and one end per document; the context of a document's first token is an end.
With c the training counts, N all training tokens, V distinct ones:

    p(w)     = (c(w) + 1) / (N + V + 1)
    p(w | v) = q(c(v, w) / (c(v) + MU)) + MU / (c(v) + MU) * p(w)

q rounds down to one of 255 steps of the logarithm (one byte a bigram), so the sum over w stays <= 1.

*Trie*. First level: the contexts, with pointers to their successors; second level: the successors with
their quantised probabilities. Contexts, pointers and successors (made monotone by adding their
context's place times the size of the vocabulary) are Elias-Fano sequences in one flat image that is
read through a memory map; a look-up finds the context, then searches between its two pointers.

*Work in Spark*. The model grows with the corpus, so neither tasks nor the driver see it whole:

1. documents become *chunks* (some megabytes of text as word numbers; a staged table);
2. each chunk sends its distinct words with training counts to word shards (by hash), which number and
   count them over the corpus and answer;
3. each chunk sends its distinct bigrams to bigram shards, which add up the training counts, build
   their trie and answer each chunk with one byte per bigram it asked for;
4. chunks score their documents.

Words meet as distinct words of a chunk, so a frequent word costs one entry per chunk; a frequent
context is split over as many shards as its share of all tokens demands. Words are known by 64-bit
hashes.

Defined cases: a NULL or empty text is its end alone; a NULL id is never in training (its checksum is
NULL) and not held out; repeated rows are scored alike; extra columns are left out; an empty table has
no rows; the length of a text is not limited.
"""

from __future__ import annotations

import mmap
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailstrata.llm.common import documents, named, slices, staged, word_hashes
from mailstrata.session import ship_package

MU = 4.0
FOLDS = 7
HELD_OUT = 2
#: A context is split once it has 1/SPLIT of all tokens.
SPLIT = 2_000
#: Range of the quantised logarithms: from LOWEST to 0 in 255 steps; code 0 is "not seen".
LOWEST = -12.0
STEPS = 255


# Flat arrays ------------------------------------------------------------------------------


def squeeze(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    raw = np.ascontiguousarray(values)
    return zlib.compress(raw.view(np.uint8).reshape(-1, raw.itemsize).T.tobytes(), 1)


def spread(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(size, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


class Monotone:
    """An Elias-Fano sequence: low bits packed, high bits in unary.

    Image: n u64, bytes of the low bits u64, bytes of the high bits u64, width u64, low bits, high bits.
    """

    _HEAD = struct.Struct("<4Q")

    @classmethod
    def image(cls, values: np.ndarray) -> bytes:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(1, n)).bit_length() - 1) if n else 0
        low = values & np.uint64((1 << width) - 1)
        bits = ((low[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        low_bytes = np.packbits(bits.ravel(), bitorder="little").tobytes()
        high = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(high[-1]) + 1 if n else 0, dtype=np.uint8)
        unary[high] = 1
        high_bytes = np.packbits(unary, bitorder="little").tobytes()
        return cls._HEAD.pack(n, len(low_bytes), len(high_bytes), width) + low_bytes + high_bytes

    def __init__(self, image: memoryview, at: int = 0) -> None:
        self.n, n_low, n_high, self.width = self._HEAD.unpack_from(image, at)
        at += self._HEAD.size
        self.low = np.frombuffer(image, dtype=np.uint8, count=n_low, offset=at)
        high = np.frombuffer(image, dtype=np.uint8, count=n_high, offset=at + n_low)
        self.end = at + n_low + n_high
        # Place of the i-th one: the select structure, made when the image is opened.
        self.ones = np.flatnonzero(np.unpackbits(high, bitorder="little")) if n_high else np.zeros(0, dtype=np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places ``i``."""
        high = (self.ones[i] - i).astype(np.uint64) << np.uint64(self.width)
        if not self.width:
            return high
        bit = i.astype(np.int64) * self.width
        first, low = bit >> 3, np.zeros(len(i), dtype=np.uint64)
        # A field of up to 57 bits lies in eight bytes, a wider one in nine.
        for k in range((self.width + 14) // 8):
            at = first + k
            octet = self.low[np.minimum(at, len(self.low) - 1)].astype(np.uint64)
            shift = 8 * k - (bit & 7)
            up = np.maximum(shift, 0).astype(np.uint64)
            down = np.maximum(-shift, 0).astype(np.uint64)
            low |= np.where(up < 64, (octet >> down) << np.minimum(up, np.uint64(63)), np.uint64(0))
        return high | (low & np.uint64((1 << self.width) - 1))


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes 1 to STEPS of probabilities, rounded down; 0 for probability zero."""
    with np.errstate(divide="ignore"):
        log = np.log10(p)
    code = np.floor((log - LOWEST) / -LOWEST * STEPS)
    return np.where(p > 0, np.clip(code, 1, STEPS), 0).astype(np.uint8)


def dequantise(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** (LOWEST + codes.astype(np.float64) / STEPS * -LOWEST), 0.0)


class Trie:
    """Two levels over (context, successor) pairs in ascending order."""

    @staticmethod
    def image(context: np.ndarray, successor: np.ndarray, p: np.ndarray) -> bytes:
        contexts, first = np.unique(context, return_index=True)
        pointers = np.append(first, len(context))
        place = np.repeat(np.arange(len(contexts), dtype=np.uint64), np.diff(pointers))
        size = np.uint64(int(successor.max()) + 1 if len(successor) else 1)
        return b"".join([struct.pack("<Q", int(size)), Monotone.image(contexts), Monotone.image(pointers),
                         Monotone.image(successor.astype(np.uint64) + place * size), quantise(p).tobytes()])

    def __init__(self, image: memoryview) -> None:
        self.size = struct.unpack_from("<Q", image)[0]
        self.contexts = Monotone(image, 8)
        self.pointers = Monotone(image, self.contexts.end)
        self.successors = Monotone(image, self.pointers.end)
        self.codes = np.frombuffer(image, dtype=np.uint8, count=self.successors.n, offset=self.successors.end)

    @staticmethod
    def mapped(image: bytes) -> Trie:
        """The trie read through a memory map."""
        area = mmap.mmap(-1, len(image))
        area.write(image)
        return Trie(memoryview(area))

    @staticmethod
    def _search(level: Monotone, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """First place in [low, high) whose value is not below the wanted one."""
        low, high = low.copy(), high.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_]) >> 1
            below = level.get(middle) < wanted[open_]
            low[open_[below]] = middle[below] + 1
            high[open_[~below]] = middle[~below]

    def look_up(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Codes of pairs: the context's place, then its successors between its two pointers."""
        codes = np.zeros(len(context), dtype=np.uint8)
        n = self.contexts.n
        if not n or not len(context):
            return codes
        asked, back = np.unique(context, return_inverse=True)
        place = self._search(self.contexts, np.zeros(len(asked), dtype=np.int64), np.full(len(asked), n), asked.astype(np.uint64))
        held = place < n
        held[held] = self.contexts.get(place[held]) == asked[held].astype(np.uint64)
        start, stop = (np.zeros(len(asked), dtype=np.int64) for _ in range(2))
        start[held] = self.pointers.get(place[held]).astype(np.int64)
        stop[held] = self.pointers.get(place[held] + 1).astype(np.int64)
        inside = successor < self.size
        at = np.flatnonzero(held[back] & inside)
        of = back[at]
        wanted = successor[at].astype(np.uint64) + place[of].astype(np.uint64) * np.uint64(self.size)
        found = self._search(self.successors, start[of], stop[of], wanted)
        hit = found < stop[of]
        hit[hit] = self.successors.get(found[hit]) == wanted[hit]
        codes[at[hit]] = self.codes[found[hit]]
        return codes


# Chunks -----------------------------------------------------------------------------------

_CHUNK = ("chunk long, doc_ids binary, id_known binary, held binary, lengths binary, "
          "words binary, word_counts binary, tokens binary")


def _emit(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def chunks(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row per chunk: its documents, their lengths, distinct words with training counts, tokens."""
    ship_package(df.sparkSession)
    schema = pa.schema([("chunk", pa.int64()), *[(name, pa.binary()) for name in
                        ("doc_ids", "id_known", "held", "lengths", "words", "word_counts", "tokens")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for part, texts in slices(batches, "text"):
            ids = part.column("doc_id").to_pylist()
            fold = [None if i is None else zlib.crc32(str(i).encode()) % FOLDS for i in ids]
            hashes = [word_hashes(t or b"")[0] for t in texts]
            lengths = np.array([len(h) for h in hashes], dtype=np.int32)
            words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
            train = np.array([f is not None and f != HELD_OUT for f in fold])
            counts = np.bincount(tokens, weights=np.repeat(train, lengths), minlength=len(words)).astype(np.uint32)
            # Frequent words first: small numbers compress.
            rank = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")
            number_of = np.empty(len(words), dtype=np.uint32)
            number_of[rank] = np.arange(len(words), dtype=np.uint32)
            words, counts = words[rank], counts[rank]
            yield _emit(schema, [(number, np.array([0 if i is None else i for i in ids], dtype=np.int64).tobytes(),
                                  bytes(0 if i is None else 1 for i in ids), bytes(int(f == HELD_OUT) for f in fold),
                                  lengths.tobytes(), words.tobytes(), squeeze(counts),
                                  squeeze(number_of[tokens]))])
            number += 1

    return documents(df, id_column, text_column).mapInArrow(run, _CHUNK)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _cut(order: np.ndarray, shards: int) -> np.ndarray:
    """Start of each shard's run in a sorted list of shards, and the end of all."""
    return np.searchsorted(order, np.arange(shards + 1))


def count_words(table: DataFrame, shards: int) -> DataFrame:
    """(chunk, shard, ids, counts): number and training count of every word a chunk asks for.

    A word's number is its rank in its shard times the number of shards, plus the shard, plus one.
    """
    sent = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, counts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "words", "word_counts"))):
                words, counts = np.frombuffer(words, dtype=np.uint64), spread(counts, "<u4")
                shard = (words % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                cut = _cut(shard[order], shards)
                yield _emit(sent, [(s, chunk, words[order[a:b]].tobytes(), squeeze(counts[order[a:b]]))
                                   for s, (a, b) in enumerate(zip(cut, cut[1:])) if b > a])

    def count(key, frame):
        asked = [np.frombuffer(w, dtype=np.uint64) for w in frame["words"]]
        words, at = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([spread(c, "<u4") for c in frame["counts"]]),
                            minlength=len(words)).astype(np.int64)
        cut = np.cumsum([0, *map(len, asked)])
        mine = [at[a:b] for a, b in zip(cut, cut[1:])]
        rows = [(chunk, key[0], squeeze(m.astype(np.uint32) * np.uint32(shards) + np.uint32(key[0] + 1)), squeeze(total[m]))
                for chunk, m in zip(frame["chunk"], mine)]
        rows.append((-1, key[0], b"", np.array([total.sum(), (total > 0).sum()], dtype=np.int64).tobytes()))
        return pd.DataFrame(rows, columns=["chunk", "shard", "ids", "counts"])

    asked = table.select("chunk", "words", "word_counts").mapInArrow(send, "shard int, chunk long, words binary, counts binary")
    return asked.groupBy("shard").applyInPandas(count, "chunk long, shard int, ids binary, counts binary")


class Chunk:
    """A chunk with the numbers and counts of its words: the pairs of its documents."""

    def __init__(self, row: dict, answers: list[dict], shards: int, total: int, ends: int) -> None:
        words = np.frombuffer(row["words"], dtype=np.uint64)
        shard = (words % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        answers = sorted(answers, key=lambda a: a["shard"])
        ids, counts = np.empty(len(words), dtype=np.uint32), np.empty(len(words), dtype=np.int64)
        if answers:
            ids[order] = np.concatenate([spread(a["ids"], "<u4") for a in answers])
            counts[order] = np.concatenate([spread(a["counts"], "<i8") for a in answers])
        place = spread(row["tokens"], "<u4")
        self.lengths = np.frombuffer(row["lengths"], dtype=np.int32)
        self.held = np.frombuffer(row["held"], dtype=np.uint8).astype(bool)
        self.known = np.frombuffer(row["id_known"], dtype=np.uint8).astype(bool)
        self.doc_ids = np.frombuffer(row["doc_ids"], dtype=np.int64)
        n = len(place) + len(self.lengths)
        closing = np.cumsum(self.lengths + 1) - 1
        word = np.ones(n, dtype=bool)
        word[closing] = False
        # Number 0 is the end; it closes each document and so stands before the next one's first word.
        self.token, self.count = np.zeros(n, dtype=np.uint64), np.full(n, ends, dtype=np.int64)
        self.token[word], self.count[word] = ids[place], counts[place]
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths + 1)
        context = np.concatenate((np.zeros(1, dtype=np.uint64), self.token[:-1]))[:n]
        self.context_count = np.concatenate(([ends], self.count[:-1])).astype(np.int64)[:n]
        self.pairs, first, self.pair = np.unique(context << np.uint64(32) | self.token, return_index=True, return_inverse=True)
        pair_context = self.pairs >> np.uint64(32)
        pieces = np.uint64(1) + (self.context_count[first] * SPLIT // max(1, total)).astype(np.uint64)
        self.pair_context_count = self.context_count[first]
        self.shard = ((_mix(pair_context) + _mix(self.pairs) % pieces) % np.uint64(shards)).astype(np.int64)
        self.order = np.argsort(self.shard, kind="stable")
        self.cut = _cut(self.shard[self.order], shards)


def score(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``df``."""
    spark = df.sparkSession
    shards = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = staged(chunks(df, id_column, text_column), "chunks")
    answers = staged(count_words(table, shards), "word_counts")
    train = F.pmod(F.crc32(named(id_column).cast("long").cast("string").cast("binary")), F.lit(FOLDS)) != HELD_OUT
    ends = df.where(train).count()
    sums = np.zeros(2, dtype=np.int64)
    for r in answers.where("chunk = -1").select("counts").toLocalIterator():  # one row per shard
        sums += np.frombuffer(r[0], dtype=np.int64)
    total, distinct = int(sums[0]) + ends, int(sums[1]) + (ends > 0)
    answered = answers.where("chunk >= 0").groupBy("chunk").agg(
        F.collect_list(F.struct("shard", "ids", "counts")).alias("answers"))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Chunk]]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield row, Chunk(row, row["answers"] or [], shards, total, ends)

    sent = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("contexts", pa.binary()),
                      ("successors", pa.binary()), ("counts", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, c in rows_of(batches):
            trained = (~c.held & c.known)[c.doc]
            counts = np.bincount(c.pair, weights=trained, minlength=len(c.pairs)).astype(np.uint32)
            out = []
            for s, (a, b) in enumerate(zip(c.cut, c.cut[1:])):
                if b > a:
                    at = c.order[a:b]
                    contexts, first, many = np.unique(c.pairs[at] >> np.uint64(32), return_index=True, return_counts=True)
                    steps = np.diff(contexts, prepend=np.uint64(0))
                    out.append((s, row["chunk"],
                                b"".join(struct.pack("<I", len(x)) + x for x in (
                                    squeeze(steps.astype(np.uint32)), squeeze(many.astype(np.uint32)),
                                    squeeze(c.pair_context_count[at][first]))),
                                squeeze((c.pairs[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32)), squeeze(counts[at])))
            yield _emit(sent, out)

    def asked(contexts: bytes, successors: bytes) -> tuple[np.ndarray, np.ndarray]:
        parts, at = [], 0
        for kind in ("<u4", "<u4", "<i8"):
            n = struct.unpack_from("<I", contexts, at)[0]
            parts.append(spread(contexts[at + 4: at + 4 + n], kind))
            at += 4 + n
        steps, many, count = parts
        context = np.repeat(np.cumsum(steps, dtype=np.uint64), many)
        return context << np.uint64(32) | spread(successors, "<u4").astype(np.uint64), np.repeat(count, many)

    def build(key, frame):
        asks = [asked(c, s) for c, s in zip(frame["contexts"], frame["successors"])]
        keys = np.concatenate([k for k, _ in asks])
        pairs, first, at = np.unique(keys, return_index=True, return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([spread(c, "<u4") for c in frame["counts"]]), minlength=len(pairs))
        context_count = np.concatenate([c for _, c in asks])[first]
        seen = counts > 0
        p = counts[seen] / (context_count[seen] + MU)
        trie = Trie.mapped(Trie.image(pairs[seen] >> np.uint64(32), pairs[seen] & np.uint64(0xFFFFFFFF), p))
        return pd.DataFrame([(chunk, key[0], zlib.compress(trie.look_up(
            k >> np.uint64(32), k & np.uint64(0xFFFFFFFF)).tobytes(), 1)) for chunk, (k, _) in zip(frame["chunk"], asks)],
            columns=["chunk", "shard", "codes"])

    with_words = table.join(answered, "chunk", "left")
    codes = staged(with_words.mapInArrow(send, "shard int, chunk long, contexts binary, successors binary, counts binary")
                   .groupBy("shard").applyInPandas(build, "chunk long, shard int, codes binary"), "codes")
    coded = codes.groupBy("chunk").agg(F.collect_list(F.struct("shard", "codes")).alias("coded"))
    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, c in rows_of(batches):
            code = np.empty(len(c.pairs), dtype=np.uint8)
            parts = sorted(row["coded"] or [], key=lambda x: x["shard"])
            code[c.order] = np.frombuffer(b"".join(zlib.decompress(x["codes"]) for x in parts), dtype=np.uint8)
            single = (c.count + 1.0) / (total + distinct + 1)
            double = dequantise(code)[c.pair] + MU / (c.context_count + MU) * single
            n = len(c.lengths)
            sums = [np.bincount(c.doc, weights=x, minlength=n) for x in (
                c.count > 0, np.log10((c.count + 1.0) / (total + 1 * (distinct + 1))), np.log10(double))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c.doc_ids, mask=~c.known), pa.array(c.held), pa.array(c.lengths.astype(np.int64) + 1),
                 pa.array(sums[0].astype(np.int64)), pa.array(np.full(n, total, dtype=np.int64)),
                 pa.array(sums[1]), pa.array(sums[2])], schema=out)

    return with_words.join(coded, "chunk", "left").mapInArrow(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

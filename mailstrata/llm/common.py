"""Shared pieces: normalized inputs, Arrow stages that pass rows through, shared-folder tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from mailstrata.session import ship_package, staging_root

#: Output batches of an Arrow stage are cut at this many bytes of input text.
SLICE_BYTES = 8 * 1024 * 1024

#: White space that separates words: blank and the five controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """A column by its literal name, dots and blanks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def documents(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Exactly (doc_id long, text binary): any further columns, clashing names included, are left out.

    Binary, because the bytes of a text are what the stages work on and any byte string is valid.
    """
    return df.select(named(id_column).cast("long").alias("doc_id"),
                     named(text_column).cast("string").cast("binary").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """(part of a batch, its values of ``column``), cut so that no part holds much over SLICE_BYTES."""
    for batch in batches:
        values = batch.column(column)
        sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = np.cumsum(sizes) // SLICE_BYTES
        cuts = [0, *(np.nonzero(np.diff(block))[0] + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                part = batch.slice(a, b - a)
                yield part, part.column(column).to_pylist()


def map_texts(df: DataFrame, text: str, make: Callable[[], Callable[[list, pa.RecordBatch], Any]],
              schema: str | StructType) -> DataFrame:
    """An Arrow stage over parts of bounded size.

    ``make()`` runs once per task and returns a function of (texts, part) that gives the columns of
    ``schema`` as a list of sequences, or a RecordBatch.
    """
    ship_package(df.sparkSession)
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part, texts in slices(batches, text):
            made = work(texts, part)
            if isinstance(made, pa.RecordBatch):
                yield made
            else:
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, type=f.type, from_pandas=False)
                     for x, f in zip(made, arrow)], schema=arrow)

    return df.mapInArrow(run, kind)


def append_columns(df: DataFrame, text: Column, make: Callable[[], Callable[[list], list]],
                   added: str) -> DataFrame:
    """``df`` with the columns of DDL ``added`` behind its own, which pass through untouched.

    The rows travel as one struct next to the text, so no name of ``df`` can clash with ``added``
    on the way; a clash in the result is the caller's to resolve.
    """
    new = StructType.fromDDL(added)
    packed = df.select(F.struct(*[named(c) for c in df.columns]).alias("row"),
                       text.cast("string").cast("binary").alias("text"))
    schema = StructType([packed.schema["row"], *new.fields])

    def worker() -> Callable[[list, pa.RecordBatch], list]:
        work = make()

        def one(texts: list, part: pa.RecordBatch) -> list:
            return [part.column("row"), *work(texts)]

        return one

    made = map_texts(packed, "text", worker, schema)
    return made.select("row.*", *[f.name for f in new.fields])


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder the session names and read it back.

    Cuts the lineage, survives lost executors, and lets several branches read the one result.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/llm/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(spark: SparkSession, df: DataFrame) -> None:
    """Remove the folder of a table made by ``staged`` once nothing will read it again."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# Fingerprints of words without a Python object per word ------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLOCK = 1 << 18


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word of ``data``: equal words have equal hashes.

    A polynomial over the word's bytes modulo 2**64, taken from differences of running sums. Callers
    that need exactness compare the words behind equal hashes.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), none, none
    edge = np.diff(np.concatenate(([1], _SPACE[raw].view(np.int8), [1])).astype(np.int8))
    start, end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    return span_hashes(_LOWER[raw] if lower else raw, start, end), start, end


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes; spans ascend and do not overlap."""
    out = np.empty(len(start), dtype=np.uint64)
    # Blocks bound the width of the power table; a word longer than a block still gets its own sum.
    at = 0
    while at < len(start):
        first = int(start[at])
        upto = max(at + 1, int(np.searchsorted(end, first + _BLOCK, side="right")))
        last = int(end[upto - 1])
        up, down = _powers(_BASE, last - first), _powers(_INVERSE, last - first)
        run = np.zeros(last - first + 1, dtype=np.uint64)
        np.cumsum((raw[first:last].astype(np.uint64) + np.uint64(1)) * up, out=run[1:])
        s, e = start[at:upto] - first, end[at:upto] - first
        out[at:upto] = (run[e] - run[s]) * down[s]
        at = upto
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; fewer words: one run of all; none: nothing."""
    n = len(words)
    if not n:
        return words
    size = min(size, n)
    out = np.zeros(n - size + 1, dtype=np.uint64)
    factor = np.uint64(0xD6E8FEB86659FD93)
    for k in range(size):
        out = out * factor + words[k: n - size + 1 + k]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(29)
    return out

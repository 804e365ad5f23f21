"""The one shape all Arrow stages share: a column in, a struct column out.

Spark partitions the rows; per batch a small per-value function runs over one binary or string
column. All other columns pass through as Arrow data without becoming Python objects.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import DataType, LongType, StructField, StructType
from pyspark.sql.pandas.types import to_arrow_type

from mailstrata.session import ship_package

# Output batches are cut by size, so a run of large messages does not become one large batch.
OUTPUT_BYTES = 32 * 1024 * 1024
# And by rows: results are Python objects until they are written, many times the size of a short message.
OUTPUT_ROWS = 256


def arrow_stage(df: DataFrame, source: str, out: str, out_type: str,
                fn: Callable[..., dict[str, Any] | None], keep_source: bool = False,
                extra: tuple[str, ...] = (), weight: Callable[[Any], int] = len) -> DataFrame:
    """Replace column ``source`` by ``out`` = ``fn(value, *extra values)`` of type ``out_type``.

    A NULL source gives a NULL result without calling ``fn``.
    """
    ship_package(df.sparkSession)
    kind: DataType = DataType.fromDDL(out_type)
    passed = [f for f in df.schema.fields if keep_source or f.name != source]
    schema = StructType([*passed, StructField(out, kind, True)])
    arrow_kind = to_arrow_type(kind)
    names = [f.name for f in passed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(source)
            others = [batch.column(name) for name in extra]
            results: list[Any] = []
            start, size = 0, 0
            for i in range(batch.num_rows):
                value = column[i].as_py()
                results.append(None if value is None else fn(value, *[o[i].as_py() for o in others]))
                size += 0 if value is None else weight(value)
                if size >= OUTPUT_BYTES or i + 1 - start >= OUTPUT_ROWS or i + 1 == batch.num_rows:
                    part = batch.slice(start, i + 1 - start)
                    made = pa.array(results, type=arrow_kind)
                    yield pa.RecordBatch.from_arrays(
                        [*[part.column(n) for n in names], made], names=[*names, out])
                    results, start, size = [], i + 1, 0

    return df.mapInArrow(run, schema)


def running_count(df: DataFrame, key: str, counted: str, out: str) -> DataFrame:
    """``df`` with ``out``: how many rows since the last change of ``key`` have ``counted``, this one included.

    For rows that lie together and in order because they were made from one row; nothing is moved.
    """
    ship_package(df.sparkSession)
    schema = StructType([*df.schema.fields, StructField(out, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key)
            changed = np.ones(batch.num_rows, dtype=bool)
            changed[0] = keys[0].as_py() != last
            changed[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
            total = np.cumsum(batch.column(counted).to_numpy(zero_copy_only=False).astype(np.int64))
            before = np.concatenate(([0], total[:-1]))
            start = np.maximum.accumulate(np.where(changed, np.arange(batch.num_rows), 0))
            counts = total - before[start]
            if not changed[0]:
                counts[: int(changed.argmax()) if changed.any() else batch.num_rows] += carried
            last, carried = keys[-1].as_py(), int(counts[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts)], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)

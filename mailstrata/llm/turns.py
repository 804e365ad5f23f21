"""Rows of conversations in order, cut so that no conversation needs a task of its own.

Rows are dealt by range over (conversation, order), so a long conversation spreads over neighbouring
tasks; what a row needs of those before it is summed inside a task's run first, and the few runs that
continue one of another task take its sums by a join of at most one row a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from mailstrata.llm.common import staged
from mailstrata.session import ship_package


def turn_order() -> list[Column]:
    """Order of a conversation's rows: turn, NULL first; at one turn role, the text's head, the text.

    Bounded keys, as some values of them travel to the driver when Spark chooses the ranges.
    """
    return [F.col("turn").asc_nulls_first(), F.substring("role", 1, 64).asc(), F.substring("text", 1, 256).asc(),
            F.xxhash64("role", "text").asc()]


def dealt(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` by range over ``order``, sorted by it; rows equal in all of it can spread over several tasks."""
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(64))
    salted = df.withColumn("_salt", salt)
    return salted.repartitionByRange(*order, F.col("_salt").asc()).drop("_salt").sortWithinPartitions(*order)


def running(df: DataFrame, group: str, order: list[Column], values: list[str]) -> DataFrame:
    """``df`` with ``sum_v`` for each long column v: its sum over the group's rows up to this one, in order."""
    ship_package(df.sparkSession)
    added = [f"sum_{v}" for v in values]
    kind = StructType([*df.schema.fields, *[StructField(a, LongType()) for a in ("part", *added)]])
    arrow = to_arrow_schema(kind)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, carried = None, np.zeros(len(values), dtype=np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names = batch.column(group)
            ids = names.fill_null(0).to_numpy()
            absent = np.array(names.is_null())
            new = np.concatenate(([(ids[0], absent[0]) != last], (np.diff(ids) != 0) | (np.diff(absent.view(np.int8)) != 0)))
            start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            sums = []
            for k, v in enumerate(values):
                run = np.cumsum(batch.column(v).to_numpy())
                before = np.concatenate(([0], run))[start]
                own = run - before
                if not new[0]:
                    own[: int(np.argmax(new)) if new.any() else n] += carried[k]
                sums.append(own)
                carried[k] = own[-1]
            last = (ids[-1], absent[-1])
            made = [*batch.columns, pa.array(np.full(n, part, dtype=np.int64)), *[pa.array(s) for s in sums]]
            yield pa.RecordBatch.from_arrays(made, schema=arrow)

    runs = staged(dealt(df, F.col(group).asc_nulls_first(), *order).mapInArrow(scan, kind), "runs")
    totals = runs.groupBy(group, "part").agg(*[F.sum(v).alias(v) for v in values])
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # Only the first run of a task can continue another one: at most one row a task is left.
    carried = totals.select(F.col(group).alias("_group"), F.col("part").alias("_part"),
                            *[F.sum(v).over(before).alias(f"_{v}") for v in values]).where(F.col(f"_{values[0]}").isNotNull())
    return runs.join(F.broadcast(carried), F.col(group).eqNullSafe(F.col("_group")) & (F.col("part") == F.col("_part")), "left") \
        .select(*df.columns, *[(F.col(a) + F.coalesce(F.col(f"_{v}"), F.lit(0))).alias(a) for a, v in zip(added, values)])

"""Sessions for tests and benchmarks, and the shared staging folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Messages are up to 25 MiB each: an Arrow batch must hold few of them.
ARROW_ROWS = 64

# Rows of per-message work in one task: some seconds.
TASK_ROWS = 16_384


def build_session(master: str = "local[*]", app: str = "mailstrata", **conf: str) -> SparkSession:
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(ARROW_ROWS),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.dataFrameQueryContext.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tasks_for(df: DataFrame) -> int:
    """Tasks for per-row work on ``df``: one per ``TASK_ROWS`` rows, one per core at least.

    Asks for the number of rows, which a scan of parquet reads off the footers.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))


def spread(df: DataFrame) -> DataFrame:
    """Give a scan that has fewer splits than its rows need tasks that many.

    A split is cut by bytes, but a row of few bytes becomes a whole message: without this, a task's work
    grows with the table. Moving the few columns is far cheaper than the work. Scans with enough splits
    are left alone.
    """
    wanted = tasks_for(df)
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the session's executors."""
    sc = spark.sparkContext
    if getattr(sc, "_mailstrata_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="spark-mailstrata-")
    archive = os.path.join(folder, "mailstrata.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for base, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(base, name)
                    out.write(path, os.path.join("mailstrata", os.path.relpath(path, here)))
    sc.addPyFile(archive)
    sc._mailstrata_shipped = True


def staging_root(spark: SparkSession) -> str:
    """The folder shared by all executors: ``spark.checkpoint.dir`` of the session.

    Only a local master may run without it; its temporary folder is shared by construction.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="spark-mailstrata-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def file_system(spark: SparkSession, root: str) -> tuple:
    """(Hadoop file system of ``root``, function that makes its paths)."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path


def delete_path(spark: SparkSession, folder: str) -> None:
    fs, path = file_system(spark, folder)
    fs.delete(path(folder), True)


#: Folders staged inside open ``staging`` blocks, innermost last.
_OPEN: list[list[str]] = []


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Remove what ``stage`` writes inside the block when the block ends, even by an error.

    Only for results that are written inside it: a table read from a staged folder is void afterwards.
    """
    _OPEN.append([])
    try:
        yield
    finally:
        for folder in _OPEN.pop():
            delete_path(spark, folder)


def stage(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once as parquet to the shared folder and read it back.

    Used where several branches follow an Arrow stage: the written table cuts the lineage, survives
    lost executors and lets every branch scan only its own columns.
    """
    spark = df.sparkSession
    folder = os.path.join(staging_root(spark), "mailstrata", uuid.uuid4().hex)
    if _OPEN:
        _OPEN[-1].append(folder)
    path = os.path.join(folder, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

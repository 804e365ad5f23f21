"""Continuous landing: the batch functions applied to each new set of message files.

The stream carries names and sizes only. Inside a micro-batch the files within the size bound are read by name and
the others become rejects without a byte of them being read. Every operator is per message, so the stream needs
no state, watermark or late-data handling; a micro-batch is published as one run, so a replayed one changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from mailstrata.limits import Limits
from mailstrata.plans.analysis import AREAS, analyze
from mailstrata.plans.publish import publish
from mailstrata.sources.mail import RAW_FILE_SCHEMA, read_listed


def message_stream(spark: SparkSession, path: str, glob: str = "*.eml",
                   max_files: int = 10_000) -> DataFrame:
    """``(path, modificationTime, length)`` of files as they land below ``path``, at most ``max_files`` a batch."""
    files = (spark.readStream.format("binaryFile").schema(RAW_FILE_SCHEMA)
             .option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
             .option("maxFilesPerTrigger", max_files).load(path))
    return files.select("path", "modificationTime", "length")


def run_stream(files: DataFrame, out: str, checkpoint: str, areas: Iterable[str] = AREAS,
               limits: Limits = Limits(), **trigger: object) -> StreamingQuery:
    """Publish the tables of every micro-batch below ``out`` as the run ``batch-<number>``."""
    wanted = tuple(areas)

    def write(batch: DataFrame, batch_id: int) -> None:
        publish(batch.sparkSession, out, f"batch-{batch_id}",
                lambda: analyze(read_listed(batch, limits), wanted, limits))

    return (files.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())

"""Raw messages: landing files or any table with a binary column.

The unit everywhere is one row per message: ``source_path`` is the row key, ``sha256`` and
``evidence_id`` identify content (two files with equal bytes share them).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailstrata.functions.common import pinned
from mailstrata.functions.content import evidence_id, sha256_hex
from mailstrata.limits import Limits

RAW_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
REJECT_TYPE = "struct<reason:string,observed:bigint,limit:bigint>"


def read_messages(spark: SparkSession, path: str, limits: Limits = Limits(),
                  glob: str = "*.eml") -> DataFrame:
    """Message files below ``path``. A size bound is pushed into the scan: larger files are listed
    without being read and come as rows with a NULL ``raw``, which ``fingerprint`` rejects by size.
    Compact into parquet before repeated use."""
    files = _landing(spark, path, glob)
    read = from_files(files.where(F.col("length") <= limits.message_bytes))
    listed = from_files(files.where(F.col("length") > limits.message_bytes)
                        .select("path", "modificationTime", "length").withColumn("content", F.lit(None).cast("binary")))
    return read.unionByName(listed)


def read_listed(listed: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Messages of ``listed(path, modificationTime, length)``: files within the size bound are read by name,
    larger ones come without bytes.

    The names of one batch pass through the driver, as they do for any list of input paths; the caller bounds them
    (``message_stream`` by its files a batch).
    """
    spark = listed.sparkSession
    within = F.col("length") <= limits.message_bytes
    names = [re.sub(r"([\\\[\]{}*?])", r"\\\1", r[0]) for r in listed.where(within).select("path").collect()]
    large = from_files(listed.where(~within).withColumn("content", F.lit(None).cast("binary")))
    if not names:
        return large
    # Not skipped below the bound: the size is that of the bytes read, so a file that grew meanwhile is rejected.
    read = spark.read.format("binaryFile").schema(RAW_FILE_SCHEMA).load(names)
    return from_files(read).unionByName(large)


def from_files(files: DataFrame) -> DataFrame:
    """Rows of a ``binaryFile`` source as messages; the size is that of the bytes read, else the listed one."""
    return files.select(
        F.col("path").alias("source_path"),
        F.col("modificationTime").alias("modification_time"),
        F.coalesce(F.octet_length("content").cast("bigint"), F.col("length")).alias("size_bytes"),
        F.col("content").alias("raw"),
    )


def oversize_files(spark: SparkSession, path: str, limits: Limits = Limits(),
                   glob: str = "*.eml") -> DataFrame:
    """Reject rows for files above the size bound; their content column is not scanned."""
    files = _landing(spark, path, glob)
    return files.where(F.col("length") > limits.message_bytes).select(
        F.col("path").alias("source_path"),
        F.lit(None).cast("string").alias("sha256"),
        F.lit("message-too-large").alias("reason"),
        F.col("length").alias("observed"),
        F.lit(limits.message_bytes).cast("bigint").alias("limit"),
    )


def _landing(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob)
            .option("recursiveFileLookup", "true").load(path))


def from_table(df: DataFrame, path_col: str = "source_path", raw_col: str = "raw") -> DataFrame:
    """Messages already held in a table."""
    return df.select(
        F.col(path_col).cast("string").alias("source_path"),
        F.lit(None).cast("timestamp").alias("modification_time"),
        F.octet_length(raw_col).cast("bigint").alias("size_bytes"),
        F.col(raw_col).cast("binary").alias("raw"),
    )


def header_block(raw: Column) -> Column:
    """Bytes before the first CRLFCRLF, else before the first LFLF, else everything."""
    text = raw.cast("string")
    return F.when(F.contains(raw, F.lit(b"\r\n\r\n")), F.substring_index(text, "\r\n\r\n", 1)
                  ).otherwise(F.substring_index(text, "\n\n", 1))


def fingerprint(messages: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Add ``sha256``, ``evidence_id``, ``head`` and ``reject`` (NULL when within bounds).

    The digest is over the raw bytes, before anything is parsed. A rejected message keeps no head.
    """

    def reject(reason: str, observed: Column, limit: int) -> Column:
        return F.struct(F.lit(reason).alias("reason"), observed.cast("bigint").alias("observed"),
                        F.lit(limit).cast("bigint").alias("limit"))

    df = messages.withColumn("sha256", sha256_hex(F.col("raw")))
    df = df.withColumn("evidence_id", evidence_id(F.col("sha256")))
    df = pinned(df, df.columns, header_block(F.col("raw")), "head")
    df = df.withColumn(
        "reject",
        F.when(F.col("size_bytes") > limits.message_bytes,
               reject("message-too-large", F.col("size_bytes"), limits.message_bytes))
        .when(F.octet_length("head") > limits.header_bytes,
              reject("header-too-large", F.octet_length("head"), limits.header_bytes)))
    return df.withColumn("head",
                         F.when(F.col("reject").isNull(), F.make_valid_utf8(F.col("head"))))


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.col("reject").isNull())


def rejects(df: DataFrame) -> DataFrame:
    """``rejects(source_path, sha256, reason, observed, limit)``."""
    return df.where(F.col("reject").isNotNull()).select("source_path", "sha256", "reject.*")

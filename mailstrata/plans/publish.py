"""Tables of a run that become visible together.

A run writes below ``<root>/runs/<run>/<attempt>/<table>`` and is published by one small manifest,
``<root>/manifests/<run>.json``, that names the attempt. Readers follow manifests only, so they see all tables of
a run or none. A manifest is renamed into place and never replaced: a run that was published before is left as it
is when it is repeated, and of two attempts at one run the first manifest wins. Attempts without a manifest, such
as those of a killed driver, are removed when the run is repeated.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailstrata.session import delete_path, file_system, staging


def publish(spark: SparkSession, root: str, run: str, make: Callable[[], dict[str, DataFrame]]) -> bool:
    """Write the tables of ``make()`` and publish them as ``run``; false if that run is published already.

    What the tables stage on the way is removed, whether or not the run gets through.
    """
    if not re.fullmatch(r"[A-Za-z0-9._=-]+", run):
        raise ValueError(f"a run's name is used as a file name: {run!r}")
    manifest = f"{root}/manifests/{run}.json"
    fs, path = file_system(spark, root)
    if fs.exists(path(manifest)):
        return False
    delete_path(spark, f"{root}/runs/{run}")  # attempts that were never published
    attempt = f"runs/{run}/{uuid.uuid4().hex}"
    with staging(spark):
        tables = make()
        for name, df in tables.items():
            df.write.parquet(f"{root}/{attempt}/{name}")
    text = json.dumps({"run": run, "attempt": attempt, "tables": sorted(tables)})
    draft = f"{root}/manifests/.{uuid.uuid4().hex}"
    out = fs.create(path(draft), False)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(path(draft), path(manifest)):
        fs.delete(path(draft), False)
        delete_path(spark, f"{root}/{attempt}")
        return False
    return True


def published(spark: SparkSession, root: str) -> list[dict]:
    """The manifests of all published runs, by name: one small file a run."""
    fs, path = file_system(spark, root)
    if not fs.exists(path(f"{root}/manifests")):
        return []
    texts = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(f"{root}/manifests")
    return sorted((json.loads(r[0]) for r in texts.collect()), key=lambda m: m["run"])


def read_published(spark: SparkSession, root: str, table: str) -> DataFrame:
    """One table over all published runs that have it, with the ``run`` a row came with."""
    paths = [f"{root}/{m['attempt']}/{table}" for m in published(spark, root) if table in m["tables"]]
    if not paths:
        raise ValueError(f"no published run has a table {table!r}")
    return spark.read.parquet(*paths).withColumn(
        "run", F.regexp_extract(F.col("_metadata.file_path"), "/runs/([^/]+)/[^/]+/[^/]+/[^/]+$", 1))

"""The whole analysis: raw messages in, a small star of tables out."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailstrata.limits import Limits
from mailstrata.operators import attachments as att
from mailstrata.operators import auth, containers, headers, mime, received, urls
from mailstrata.operators.addresses import with_from_domain, with_return_path
from mailstrata.operators.mime import all_of, first_of
from mailstrata.session import stage

AREAS = ("headers", "authentication", "urls", "attachments")


def analyze(messages: DataFrame, areas: Iterable[str] = AREAS, limits: Limits = Limits(),
            staged: bool = True) -> dict[str, DataFrame]:
    """Tables of one run over ``raw_messages(source_path, modification_time, size_bytes, raw)``.

    The raw bytes are read once: fingerprint, bounds and the MIME stage run in one pass whose result
    is staged as parquet (``spark.checkpoint.dir``); every area then scans only its own columns.
    ``staged=False`` keeps the plan lazy, for callers that use a single table of the result.
    """
    wanted = tuple(areas)
    unknown = set(wanted) - set(AREAS)
    if unknown:
        raise ValueError(f"unknown areas {sorted(unknown)}; known are {AREAS}")
    parsed = mime.flatten_messages(messages, limits, with_text="urls" in wanted,
                                   with_payload="attachments" in wanted)
    if staged:
        parsed = stage(parsed, "parsed")
    ok = parsed.where(F.col("reject").isNull())
    tables = {
        "messages": message_rows(ok),
        "rejects": mime.reject_rows(parsed),
        "parts": mime.part_rows(ok),
        "addresses": mime.address_rows(ok),
        "attachment_inventory": mime.attachment_inventory(ok),
    }
    observed: list[DataFrame] = []
    warned = [mime.message_warnings(ok)]
    if {"headers", "authentication"} & set(wanted):
        fields = ok.select("source_path", "evidence_id", "fields")
        tables["headers"] = headers.header_rows(fields)
        if "headers" in wanted:
            tables["routing"] = routing_rows(fields)
            tables["hops"] = received.hop_rows(fields)
            observed.append(received.header_observations(fields))
            warned.append(received.header_warnings(fields))
        if "authentication" in wanted:
            tables["auth_results"] = auth.auth_result_rows(fields)
            tables["dkim_signatures"] = auth.dkim_rows(fields)
            tables["received_spf"] = auth.spf_rows(fields)
            tables["from_domains"] = with_from_domain(fields).select("source_path", "evidence_id", "from_domain")
            observed.append(auth.auth_observations(fields))
            warned.append(auth.auth_warnings(fields))
    if "urls" in wanted:
        ledger = urls.url_ledger(ok)
        if staged:
            ledger = stage(ledger, "ledger")
        seen = urls.with_observations(urls.merged_urls(ledger, limits))
        if staged:
            seen = stage(seen, "urls")
        tables["urls"] = urls.url_rows(seen)
        counts = urls.url_counts(ledger, seen)
        observed += [urls.url_observations(seen), stage(counts, "url_counts") if staged else counts]
        warned += [mime.message_warnings(ok, "urls"), urls.url_warnings(ledger, limits)]
    if "attachments" in wanted:
        carried = att.attachment_rows(ok)
        listed = containers.with_inventory(carried, limits)
        if staged:
            listed = stage(listed, "containers")
        tables["attachments"] = carried.select(
            "source_path", "evidence_id", *att.ATTACHMENT_COLUMNS)
        tables["containers"] = containers.container_rows(listed)
        tables["container_entries"] = containers.container_entries(listed)
        observed += [att.own_observations(carried, limits), att.listed_observations(listed),
                     att.count_observations(ok)]
        warned += [att.container_warnings(listed), reparse_warnings(ok)]
    if observed:
        tables["observations"] = union(observed)
    tables["warnings"] = union(warned)
    tables["status"] = message_status(parsed, tables["warnings"])
    return tables


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def message_rows(ok: DataFrame) -> DataFrame:
    """``messages``: the normalized view of one message."""
    return ok.withColumn("date", headers.message_date(headers.first_of_any("date"))).select(
        "source_path", "modification_time", "evidence_id", "sha256", "size_bytes", "date",
        first_of("from").alias("from_addr"), all_of("to").alias("to"), all_of("cc").alias("cc"),
        all_of("reply-to").alias("reply_to"), first_of("return-path").alias("return_path"),
        "message_id", "subject")


def routing_rows(fields: DataFrame) -> DataFrame:
    """``routing``: the wide header projection of one message."""
    return with_return_path(headers.with_routing(fields)).drop(
        "fields", "return_path_original", "date_original")


def reparse_warnings(ok: DataFrame) -> DataFrame:
    """The attachment area reports the structural warnings of the message again, as its own."""
    again = mime.message_warnings(ok).where(F.col("code") != "missing-header")
    return again.withColumn("stage", F.lit("attachments"))


def message_status(parsed: DataFrame, warnings: DataFrame) -> DataFrame:
    """``status(source_path, warnings, status)``: rejected, warnings or ok.

    Every message contributes one zero row, so messages without warnings need no join; counts are
    combined map-side before the one exchange.
    """
    base = parsed.select("source_path", F.lit(0).cast("bigint").alias("n"),
                         F.col("reject").isNotNull().alias("rejected"))
    found = warnings.select("source_path", F.lit(1).cast("bigint").alias("n"),
                            F.lit(False).alias("rejected"))
    return base.unionByName(found).groupBy("source_path").agg(
        F.sum("n").alias("warnings"), F.max("rejected").alias("rejected"),
    ).select("source_path", "warnings", status(F.col("rejected"), F.col("warnings")).alias("status"))


def header_status(messages: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``status`` of an analysis of the header area alone, in one pass over the messages: nothing is staged and one
    row a hop meets by message, combined map-side."""
    seen = mime.warned_messages(messages, limits)
    own = F.size(F.filter("warnings", lambda w: w["stage"] == "message"))
    seen = seen.select("source_path", "fields", F.col("reject").isNotNull().alias("rejected"),
                       F.when(F.col("reject").isNull(), F.greatest(own, F.lit(0))).otherwise(0).alias("own"))
    n = F.col("n") + F.when(F.col("first"), F.col("own")).otherwise(0)
    return received.with_warning_count(seen, "n").groupBy("source_path").agg(
        F.sum(n).alias("warnings"), F.max("rejected").alias("rejected"),
    ).select("source_path", "warnings", status(F.col("rejected"), F.col("warnings")).alias("status"))


def status(rejected: Column, warnings: Column) -> Column:
    return F.when(rejected, "rejected").when(warnings > 0, "warnings").otherwise("ok")


def observation_rollup(observations: DataFrame, *counted: DataFrame) -> DataFrame:
    """Observations and affected messages by (area, code), over the whole corpus.

    First per message, then over messages: a code that half of the corpus carries is pre-aggregated
    twice before it meets in one task. ``counted`` are parts of the corpus that are counted per message already.
    """
    per_message = observations.groupBy("area", "code", "source_path").agg(
        F.count(F.lit(1)).alias("observations")).drop("source_path").withColumn("messages", F.lit(1).cast("bigint"))
    return union([per_message, *counted]).groupBy("area", "code").agg(
        F.sum("observations").alias("observations"), F.sum("messages").alias("messages"))

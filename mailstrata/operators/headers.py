"""Header fields of a message as an array column, and what is read from it.

A header block is at most 1 MiB and belongs to one row, so everything here is row-local: no
operator of this module shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailstrata import rules
from mailstrata.functions.common import (
    after_index,
    first_match,
    let,
    null_if_empty,
    rows_of,
)
from mailstrata.functions.dates import iso_utc, rfc5322_epoch


def _trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\r\x0b\x0c"))


def _unfolded(line: Column) -> Column:
    """Join continuation lines by one space; only continuation lines lose blanks at both ends."""
    parts = F.split(line, "\n")
    joined = F.array_join(F.transform(parts, lambda part, i: F.when(
        i == 0, F.rtrim(part, F.lit("\r"))).otherwise(_trimmed(part))), " ")
    return F.when(line.contains("\n"), joined).otherwise(line)


def header_fields(head: Column) -> Column:
    """ARRAY<STRUCT<ordinal,name,name_raw,value>> in order; lines without a colon are dropped."""
    lines = F.transform(F.split(head, r"\r*\n(?![ \t]|\r*(?:\n|\z))"), _unfolded)

    def field(line: Column, i: Column) -> Column:
        name = F.substring_index(line, ":", 1)
        return F.struct(
            i.alias("ordinal"),
            F.lower(_trimmed(name)).alias("name"),
            _trimmed(name).alias("name_raw"),
            _trimmed(after_index(line, F.length(name) + 2)).alias("value"),
        )

    return F.transform(F.filter(lines, lambda x: x.contains(":")), field)


def with_fields(df: DataFrame) -> DataFrame:
    return df.withColumn("fields", header_fields(F.col("head")))


def header_rows(df: DataFrame) -> DataFrame:
    """``headers(source_path, evidence_id, ordinal, name, name_raw, value)``."""
    return rows_of(df, ("source_path", "evidence_id"), "fields", "f").select(
        "source_path", "evidence_id", "f.*")


def values_of(name: str, fields: str = "fields") -> Column:
    """All values of one header, in order."""
    return F.transform(F.filter(F.col(fields), lambda f: f["name"] == name), lambda f: f["value"])


def first_value(name: str, fields: str = "fields") -> Column:
    """Value of the first such header; an empty first value is NULL and hides later ones."""
    return null_if_empty(first_match(F.col(fields), lambda f: f["name"] == name)["value"])


def first_of_any(name: str, fields: str = "fields") -> Column:
    """Value of the first such header as it stands; an empty one stays empty."""
    return first_match(F.col(fields), lambda f: f["name"] == name)["value"]


def list_headers(fields: str = "fields") -> Column:
    """MAP of the ``List-*`` headers that have a non-empty first value."""
    entries = F.array(*[
        F.struct(F.lit(name).alias("key"), first_value(name, fields).alias("value"))
        for name in rules.LIST_HEADERS
    ])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def top_content_type(fields: str = "fields") -> Column:
    return null_if_empty(F.lower(F.btrim(
        F.substring_index(first_value("content-type", fields), ";", 1))))


def message_date(original: Column) -> Column:
    """STRUCT<original, epoch, utc, valid>; the claim is kept verbatim."""
    return let(rfc5322_epoch(original), lambda e: F.struct(
        original.alias("original"), e.alias("epoch"), iso_utc(e).alias("utc"),
        e.isNotNull().alias("valid")))


def with_routing(df: DataFrame) -> DataFrame:
    """The wide routing projection of one message."""
    columns = {name.replace("-", "_"): first_value(name) for name in rules.ROUTING_HEADERS}
    return df.withColumns({
        **columns,
        "return_path_original": first_value("return-path"),
        "date_original": first_value("date"),
        "list_headers": list_headers(),
        "top_content_type": top_content_type(),
    }).withColumn("date", message_date(F.col("date_original")))

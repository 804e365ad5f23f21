"""Addresses of one header value.

Plain spellings (``user@host``, ``Some Name <user@host>``) are read by expression. Only the others go
through an Arrow function around the standard library's address parser; plain rows reach it as NULL.
"""

from __future__ import annotations

import email.utils

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from mailstrata.functions.auth import domain_of
from mailstrata.functions.common import first_match, null_if_empty
from mailstrata.session import ship_package

_PAIRS = ArrayType(StructType([
    StructField("display_name", StringType()), StructField("addr", StringType())]))
_ATOM = r"[A-Za-z0-9_%+-]+"
_LABEL = r"[A-Za-z0-9-]+"
_SPEC = rf"{_ATOM}(?:\.{_ATOM})*@{_LABEL}(?:\.{_LABEL})*"
PLAIN_ADDRESS = rf"^(?:([A-Za-z0-9]+(?: [A-Za-z0-9]+)*) <({_SPEC})>|<({_SPEC})>|({_SPEC}))$"
_PLAIN = PLAIN_ADDRESS[:-1] + r"\z"


def _pairs(value: str | None) -> list[dict[str, str]] | None:
    if value is None:
        return None
    try:
        found = email.utils.getaddresses([value])
    except Exception:
        return []
    return [{"display_name": name, "addr": addr} for name, addr in found]


@F.arrow_udf(_PAIRS)
def _parsed(values: pa.Array) -> pa.Array:
    return pa.array([_pairs(v) for v in values.to_pylist()], type=to_arrow_type(_PAIRS))


def address_pairs(value: Column) -> Column:
    """ARRAY<STRUCT<display_name, addr>> of a header value; NULL for NULL."""
    plain = value.rlike(_PLAIN)
    direct = F.array(F.struct(
        F.regexp_extract(value, _PLAIN, 1).alias("display_name"),
        F.concat(*[F.regexp_extract(value, _PLAIN, g) for g in (2, 3, 4)]).alias("addr")))
    return F.coalesce(F.when(plain, direct), _parsed(F.when(~plain, value)))


def first_address(pairs: Column, raw: Column) -> Column:
    """STRUCT<display_name, addr, raw> of the first pair that has an address, else NULL."""
    found = first_match(pairs, lambda p: p["addr"] != "")
    return F.when(found.isNotNull(), F.struct(
        found["display_name"].alias("display_name"), found["addr"].alias("addr"),
        raw.alias("raw")))


def with_from_domain(df: DataFrame) -> DataFrame:
    """``from_domain``: domain of the first address of the first From header that has one.

    A bare word counts as a domain, as it does for every other claim.
    """
    ship_package(df.sparkSession)
    raw = first_match(F.col("fields"), lambda f: f["name"] == "from")["value"]
    df = df.withColumn("from_pairs", address_pairs(raw))
    domains = F.transform("from_pairs", lambda p: domain_of(p["addr"]))
    return df.withColumn("from_domain", first_match(domains, lambda d: d.isNotNull())).drop(
        "from_pairs")


def with_return_path(df: DataFrame) -> DataFrame:
    """``return_path`` STRUCT from the verbatim header claim."""
    ship_package(df.sparkSession)
    raw = F.col("return_path_original")
    df = df.withColumn("return_pairs", address_pairs(null_if_empty(raw)))
    return df.withColumn("return_path", first_address(F.col("return_pairs"), raw)).drop(
        "return_pairs")

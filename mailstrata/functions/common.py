"""Small building blocks shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unicode white space plus the four separator controls that str.isspace() also accepts.
SPACE = r"\s\x1c-\x1f"
SPACE_CHARS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_STRIPPED = rf"(?s)^[{SPACE_CHARS}]*+(.*[^{SPACE_CHARS}])?"
_TOKEN = rf"(?U)[^{SPACE}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times in ``body``.

    Without it an expression that mentions its input n times, nested k deep, grows to n**k nodes.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def rows_of(df: DataFrame, keep: Iterable[str], array: Column | str, name: str,
            position: str | None = None) -> DataFrame:
    """One row per element of ``array`` (elements are never NULL), as column ``name``.

    The outer form plus a filter on its output, instead of the inner form: for the latter Catalyst
    infers ``size(array) > 0`` and pushes it to the scan, which evaluates the array twice.
    """
    if position is None:
        return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())
    return df.select(*keep, F.posexplode_outer(array).alias(position, name)).where(
        F.col(position).isNotNull())


def pinned(df: DataFrame, keep: Iterable[str], value: Column, name: str) -> DataFrame:
    """Add ``value`` so that later filters on it do not get pushed below (and evaluate it again)."""
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def strip(c: Column) -> Column:
    """``c`` without the ``SPACE_CHARS`` at both ends; the pattern goes to the end and comes back, so it is linear."""
    return F.regexp_extract(c, _STRIPPED, 1)


def tokens(c: Column) -> Column:
    """White-space separated tokens; an all-blank value gives an empty array.

    Extraction keeps one compiled pattern per task, ``split`` compiles its pattern per value.
    """
    return F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(0))


def first_token(c: Column) -> Column:
    return F.try_element_at(tokens(c), F.lit(1))


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def after_index(c: Column, start: Column) -> Column:
    """Text of ``c`` from the 1-based character ``start`` on."""
    return F.substring(c, start, F.length(c))


def count_of(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def last_match(arr: Column, predicate: Callable[[Column], Column]) -> Column:
    return F.try_element_at(F.filter(arr, predicate), F.lit(-1))


def first_match(arr: Column, predicate: Callable[[Column], Column]) -> Column:
    return F.try_element_at(F.filter(arr, predicate), F.lit(1))


def str_map(**entries: Column) -> Column:
    """MAP<STRING,STRING> basis of an observation; NULL values are kept."""
    flat = []
    for name, value in entries.items():
        flat += [F.lit(name), value.cast("string")]
    return F.create_map(*flat) if flat else F.expr("cast(map() as map<string,string>)")

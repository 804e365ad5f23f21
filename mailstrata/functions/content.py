"""Fingerprints, file names and leading bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailstrata import rules
from mailstrata.functions.common import let


def sha256_hex(raw: Column) -> Column:
    return F.sha2(raw, 256)


def evidence_id(sha256: Column) -> Column:
    return F.concat(F.lit(rules.EVIDENCE_PREFIX),
                    F.upper(F.left(sha256, F.lit(rules.EVIDENCE_HEX_DIGITS))))


def extension_chain(filename: Column) -> Column:
    """Lower-case dot parts after the stem; empty for no extension or a trailing dot."""
    base = F.substring_index(F.substring_index(filename, "/", -1), "\\", -1)
    parts = F.split(base, r"\.")
    chain = F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda p: p != "")
    return F.when(base.contains(".") & ~base.endswith("."),
                  F.transform(chain, F.lower)).otherwise(F.expr("cast(array() as array<string>)"))


def looks_like_html(raw: Column) -> Column:
    return F.decode(raw, "ISO-8859-1").rlike(
        r"(?i)^[ \t\n\r\x0b\f]*(?:<html|<!doctype html)")


def looks_like_text(raw: Column) -> Column:
    """No NUL and at least 90% printable, over all bytes, read as UTF-8 if valid, else Latin-1."""
    utf8 = raw.cast("string")
    text = F.when(F.is_valid_utf8(utf8), utf8).otherwise(F.decode(raw, "ISO-8859-1"))

    def printable(t: Column) -> Column:
        odd = F.regexp_count(t, F.lit(r"[\p{C}\p{Z}&&[^ \r\n\t]]"))
        return (F.length(t) - odd) / F.length(t) >= rules.PRINTABLE_SHARE

    has_nul = F.contains(raw, F.lit(b"\x00"))
    return (F.octet_length(raw) > 0) & ~has_nul & let(text, printable)


def identify_bytes(raw: Column) -> Column:
    """STRUCT<category, label, detail> of the bytes; unknown content stays ``unknown``."""

    def kind(category: str, label: str, detail: str) -> Column:
        return F.struct(F.lit(category).alias("category"), F.lit(label).alias("label"),
                        F.lit(detail).alias("detail"))

    def other(label: str) -> Column:
        category, detail = rules.OTHER_CONTENT[label]
        return kind(category, label, detail)

    out = F.when(F.octet_length(raw) == 0, other("empty"))
    for magic, category, label, detail in rules.MAGIC_TABLE:
        out = out.when(F.startswith(raw, F.lit(magic)), kind(category, label, detail))
    return (out.when(looks_like_html(raw), other("html"))
            .when(looks_like_text(raw), other("text"))
            .otherwise(other("unknown")))

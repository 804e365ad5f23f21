"""IP literals: validation, canonical text, ordering key and the private-range test."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailstrata import rules
from mailstrata.functions.common import let

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def _v6_pattern() -> str:
    """All RFC 4291 spellings, with an optional zone, built from the group counts."""
    group = "[0-9A-Fa-f]{1,4}"
    forms = [f"(?:{group}:){{7}}{group}", f"(?:{group}:){{6}}{_V4}"]
    for left in range(8):
        head = f"{group}(?::{group}){{{left - 1}}}" if left else ""
        room = 7 - left
        tails = []
        if room >= 1:
            tails.append(f"{group}(?::{group}){{0,{room - 1}}}")
        if room >= 2:
            tails.append(f"(?:{group}:){{0,{room - 2}}}{_V4}")
        forms.append(f"{head}::" + (f"(?:{'|'.join(tails)})?" if tails else ""))
    return f"(?:{'|'.join(forms)})(?:%[^%]+)?"


IPV4_PATTERN = rf"^{_V4}\z"
IPV6_PATTERN = rf"^{_v6_pattern()}\z"


def is_ipv4(c: Column) -> Column:
    return c.rlike(IPV4_PATTERN)


def is_ipv6(c: Column) -> Column:
    return c.contains(":") & c.rlike(IPV6_PATTERN)


def ip_version(c: Column) -> Column:
    """4, 6 or NULL."""
    return F.when(is_ipv4(c), F.lit(4)).when(is_ipv6(c), F.lit(6))


def _hextets(c: Column) -> Column:
    """The 8 groups of a valid IPv6 text, lower case, without leading zeros."""
    addr = F.lower(F.substring_index(c, "%", 1))

    def embed(a: Column) -> Column:
        dotted = F.split(F.substring_index(a, ":", -1), r"\.")

        def pair(i: int) -> Column:
            hi, lo = F.get(dotted, F.lit(i)).cast("int"), F.get(dotted, F.lit(i + 1)).cast("int")
            return F.lower(F.hex(hi * 256 + lo))

        prefix = F.left(a, F.length(a) - F.length(F.substring_index(a, ":", -1)))
        return F.when(a.contains("."), F.concat(prefix, pair(0), F.lit(":"), pair(2))).otherwise(a)

    def groups(text: Column) -> Column:
        return F.filter(F.split(text, ":"), lambda g: g != "")

    def spread(a: Column) -> Column:
        left = groups(F.substring_index(a, "::", 1))
        right = groups(F.substring_index(a, "::", -1))
        zeros = F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right))
        return F.when(a.contains("::"), F.concat(left, zeros, right)).otherwise(groups(a))

    return F.transform(let(let(addr, embed), spread),
                       lambda g: F.regexp_replace(g, "^0+(?=.)", ""))


def _compress(text: Column) -> Column:
    """Replace the first longest run of two or more zero groups by ``::``."""
    out = text
    for run in range(2, 9):  # the longest run ends up outermost, so it is tried first
        pattern = rf"^(.*?)(?:^|:)0(?::0){{{run - 1}}}(?::|\z)"
        out = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, "$1::")).otherwise(out)
    return out


def _canonical_v6(c: Column) -> Column:
    zone = F.when(c.contains("%"), F.concat(F.lit("%"), F.substring_index(c, "%", -1))).otherwise("")

    def text(h: Column) -> Column:
        def dec(i: int) -> Column:
            n = F.conv(F.get(h, F.lit(i)), 16, 10).cast("int")
            return F.concat_ws(".", F.shiftright(n, 8).cast("string"),
                               n.bitwiseAND(F.lit(255)).cast("string"))

        mapped = F.array_join(F.slice(h, 1, 6), ":") == "0:0:0:0:0:ffff"
        return F.when(mapped, F.concat(F.lit("::ffff:"), dec(6), F.lit("."), dec(7))).otherwise(
            let(F.array_join(h, ":"), _compress)
        )

    return F.concat(let(_hextets(c), text), zone)


def canonical_ip(c: Column) -> Column:
    """Canonical text of a valid literal (IPv6 lower case and compressed), else NULL."""
    return F.when(is_ipv4(c), c).when(is_ipv6(c), _canonical_v6(c))


def ip_hex(c: Column) -> Column:
    """Fixed-width hex of a canonical literal (8 or 32 digits): orders like the address."""
    v4 = F.array_join(
        F.transform(F.split(c, r"\."), lambda o: F.lpad(F.lower(F.hex(o.cast("int"))), 2, "0")), "")
    v6 = F.array_join(F.transform(_hextets(c), lambda g: F.lpad(g, 4, "0")), "")
    return F.when(is_ipv4(c), v4).when(is_ipv6(c), v6)


def is_private_ip(c: Column) -> Column:
    """Internal-use address test on canonical text; NULL counts as not private."""
    v4 = (r"^(?:10\.|127\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\."
          r"|100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.)")
    v6 = r"^(?:::1(?:%.*)?\z|fe[89ab][0-9a-f]:|f[cd][0-9a-f]{2}:)"
    return F.coalesce(F.when(c.contains(":"), c.rlike(v6)).otherwise(c.rlike(v4)), F.lit(False))


def private_ranges(spark: SparkSession) -> DataFrame:
    """The same ranges as a 9-row dimension ``(network, version, lo, hi)`` for range joins."""
    rows = []
    for text in rules.PRIVATE_NETWORKS:
        net = ipaddress.ip_network(text)
        width = 8 if net.version == 4 else 32
        lo, hi = int(net.network_address), int(net.broadcast_address)
        rows.append((text, net.version, f"{lo:0{width}x}", f"{hi:0{width}x}"))
    return spark.createDataFrame(rows, "network string, version int, lo string, hi string")

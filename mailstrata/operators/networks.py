"""Addresses in networks: a range join as equi-joins on prefixes.

A network covers all addresses that start with its bits, so in fixed-width hexadecimal text it is one prefix, or
up to eight when its bits end inside a digit (16 when it has none). An address is in the network exactly if one of its own prefixes is
among these. Distinct addresses are looked up once, for the prefix lengths that occur, and joined back; Spark
deals or broadcasts either side by its size, and no pair outside a network is ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def network_prefixes(networks: DataFrame) -> DataFrame:
    """``(network, version, prefix)`` of ``networks(network 'address/bits', version, lo hex)``."""
    bits = F.substring_index("network", "/", -1).cast("int")
    digits = F.greatest(F.ceil(bits / 4), F.lit(1)).cast("int")
    spare = digits * 4 - bits
    head = F.substring("lo", F.lit(1), digits - 1)
    last = F.conv(F.substring("lo", digits, F.lit(1)), 16, 10).cast("int")
    steps = F.sequence(F.lit(0), F.expr("shiftleft(1, spare) - 1"))
    return networks.select("network", "version", head.alias("head"), last.alias("last"), spare.alias("spare")).select(
        "network", "version", "head", "last", F.explode(steps).alias("step")).select(
        "network", "version", F.concat("head", F.lower(F.hex(F.col("last") + F.col("step")))).alias("prefix"))


def with_networks(df: DataFrame, networks: DataFrame, version: str = "ip_version", address: str = "ip_hex",
                  out: str = "networks") -> DataFrame:
    """``df`` with ``out``: the sorted networks its address is in, empty for none and for NULL."""
    prefixes = network_prefixes(networks)
    lengths = prefixes.groupBy("version").agg(F.collect_set(F.length("prefix")).alias("lengths"))  # two rows
    asked = df.select(F.col(version).alias("version"), F.col(address).alias("address")).where("address IS NOT NULL").distinct()
    own = asked.join(F.broadcast(lengths), "version").select("version", "address", F.explode("lengths").alias("n")).select(
        "version", "address", F.left("address", F.col("n")).alias("prefix"))
    found = own.join(prefixes, ["version", "prefix"]).groupBy("version", "address").agg(
        F.sort_array(F.collect_set("network")).alias(out))
    matched = df.join(found, (df[version] == found["version"]) & (df[address] == found["address"]), "left")
    return matched.select(*[df[c] for c in df.columns], F.coalesce(found[out], _none()).alias(out))


def _none() -> Column:
    return F.expr("cast(array() as array<string>)")

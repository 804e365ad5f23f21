"""URL decomposition as column expressions.

``parse_url`` is not used: it returns NULL for hosts and ports that occur in real mail.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailstrata import rules
from mailstrata.functions.common import after_index, let, null_if_empty, pinned, strip
from mailstrata.functions.ip import ip_version, is_ipv6
from mailstrata.functions.text import defang_url, undefang_url

URL_FIELDS = (
    "url", "defanged", "scheme", "host", "port", "path", "query_params", "fragment",
    "host_is_ip", "ip_version", "punycode", "userinfo", "registered_domain", "subdomain_depth",
    "tld", "nonstandard_port", "shortener", "invalid_port", "url_key",
)


def _decoded(text: Column) -> Column:
    """Form decoding that keeps a bad percent sequence as it is."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(text: Column) -> Column:
    out = F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A"))
    return F.replace(out, F.lit("%7E"), F.lit("~"))


def query_params(query: Column) -> Column:
    """ARRAY<STRUCT<name,value>> in order; repeats and blank values are kept."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")

    def pair(p: Column) -> Column:
        name = F.substring_index(p, "=", 1)
        return F.struct(_decoded(name).alias("name"),
                        _decoded(after_index(p, F.length(name) + 2)).alias("value"))

    return F.transform(pairs, pair)


Lookup = Callable[[str], Column]


def _canonical(c: Lookup) -> dict[str, Column]:
    return {"url": undefang_url(strip(c("raw")))}


def _authority(c: Lookup) -> dict[str, Column]:
    return {
        "scheme_text": F.regexp_extract(c("url"), "^([A-Za-z][A-Za-z0-9+.-]*):", 1),
        "netloc": F.regexp_extract(c("url"), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1),
    }


def _sections(c: Lookup) -> dict[str, Column]:
    host_info = F.substring_index(c("netloc"), "@", -1)
    login_len = F.length(c("netloc")) - F.length(host_info) - 1
    return {
        "scheme": F.lower(c("scheme_text")),
        "after": after_index(c("url"), F.length(c("scheme_text")) + F.length(c("netloc")) + 4),
        "host_info": host_info,
        "login": F.when(c("netloc").contains("@"), F.left(c("netloc"), login_len)),
    }


def _host_and_port(c: Lookup) -> dict[str, Column]:
    literal = c("host_info").contains("[")
    host = F.when(literal, F.regexp_extract(c("host_info"), r"\[([^\]]*)", 1)).otherwise(
        F.substring_index(c("host_info"), ":", 1))
    port = F.when(
        literal, F.regexp_extract(c("host_info"), r"(?s)\[[^\]]*\][^:]*:(.*)\z", 1)
    ).otherwise(F.regexp_extract(c("host_info"), r"(?s)^[^:]*:(.*)\z", 1))
    no_fragment = F.substring_index(c("after"), "#", 1)
    return {
        "host": F.rtrim(F.lower(host), F.lit(".")),
        "port_text": null_if_empty(port),
        "no_fragment": no_fragment,
        "fragment": after_index(c("after"), F.length(no_fragment) + 2),
    }


def _validity(c: Lookup) -> dict[str, Column]:
    bracketed = F.regexp_extract(c("netloc"), r"\[([^\]]*)", 1)
    opens, closes = c("netloc").contains("["), c("netloc").contains("]")
    literal_ok = is_ipv6(bracketed) | bracketed.rlike(r"^v[a-fA-F0-9]+\..+\z")
    number = F.when(c("port_text").rlike(r"^[0-9]+\z"), c("port_text").try_cast("bigint"))
    return {
        "valid": c("scheme").isin(*rules.DEFAULT_PORTS)
        & (opens == closes) & (~opens | literal_ok)
        & (c("host") != "")
        & ~c("netloc").rlike(f"[{rules.CONFUSABLE_NETLOC_CHARS}]"),
        "ip_version": ip_version(c("host")),
        "path": F.substring_index(c("no_fragment"), "?", 1),
        "port": F.when(number.between(0, 65535), number.cast("int")),
    }


def _facts(c: Lookup) -> dict[str, Column]:
    named = c("ip_version").isNull()
    labels = F.split(c("host"), r"\.")
    dotted = named & c("host").contains(".")
    user = F.substring_index(c("login"), ":", 1)
    password = after_index(c("login"), F.length(user) + 2)
    default_port = F.when(c("scheme") == "http", rules.DEFAULT_PORTS["http"]).when(
        c("scheme") == "https", rules.DEFAULT_PORTS["https"])
    return {
        "query_params": query_params(after_index(c("no_fragment"), F.length(c("path")) + 2)),
        "host_is_ip": ~named,
        "invalid_port": c("port_text").isNotNull() & c("port").isNull(),
        "punycode": c("host").rlike(r"(?:^|\.)xn--"),
        "userinfo": F.when(
            (user != "") | (password != ""),
            F.concat(user, F.when(password != "", F.concat(F.lit(":"), password)).otherwise(""))),
        "registered_domain": F.when(dotted, F.substring_index(c("host"), ".", -2)),
        "tld": F.when(dotted, F.substring_index(c("host"), ".", -1)),
        "subdomain_depth": F.when(named, F.greatest(F.size(labels) - 2, F.lit(0))).otherwise(0),
        "nonstandard_port": c("port").isNotNull() & (c("port") != default_port),
        "defanged": defang_url(c("url")),
    }


def _identity(c: Lookup) -> dict[str, Column]:
    port = F.when(c("nonstandard_port"), F.concat(F.lit(":"), c("port").cast("string")))
    form = F.array_join(F.transform(
        c("query_params"),
        lambda p: F.concat(_encoded(p["name"]), F.lit("="), _encoded(p["value"]))), "&")
    short = c("registered_domain").isin(*rules.SHORTENER_DOMAINS)
    return {
        "shortener": c("host").isin(*rules.SHORTENER_DOMAINS) | F.coalesce(short, F.lit(False)),
        # Scheme, host, non-default port, path and re-encoded query; user info and fragment are
        # not part of what is requested.
        "url_key": F.concat(
            c("scheme"), F.lit("://"), c("host"), F.coalesce(port, F.lit("")), c("path"),
            F.when(F.size(c("query_params")) > 0, F.concat(F.lit("?"), form)).otherwise("")),
    }


_STAGES = (_canonical, _authority, _sections, _host_and_port, _validity, _facts, _identity)


def _result(c: Lookup) -> Column:
    return F.struct(*[c(f).alias(f) for f in (*URL_FIELDS, "valid")])


def with_url(df: DataFrame, raw: str, name: str = "u") -> DataFrame:
    """Add ``name`` STRUCT<URL_FIELDS..., valid> decomposed from the (maybe defanged) column ``raw``.

    The stages are successive projections, so every intermediate is evaluated once, in generated
    code. Use this on tables; ``url_struct`` is the same as a single expression.
    """

    def c(field: str) -> Column:
        return F.col(raw) if field == "raw" else F.col(f"__url_{field}")

    own = df.columns
    for stage in _STAGES:
        df = df.withColumns({f"__url_{field}": value for field, value in stage(c).items()})
    return pinned(df, own, _result(c), name)


def url_struct(raw: Column) -> Column:
    """STRUCT<URL_FIELDS..., valid> of one (maybe defanged) URL."""

    def bind(index: int, bound: Column, known: tuple[str, ...]) -> Column:
        if index == len(_STAGES):
            return _result(lambda field: bound[field])
        fields = _STAGES[index](lambda field: bound[field])
        grown = F.struct(*[bound[k].alias(k) for k in known],
                         *[v.alias(k) for k, v in fields.items()])
        return let(grown, lambda b: bind(index + 1, b, (*known, *fields)))

    return let(F.struct(raw.alias("raw")), lambda b: bind(0, b, ("raw",)))


def url_dedup_key(raw: Column) -> Column:
    """Identity used to merge sightings of one URL; NULL when it cannot be decomposed."""
    return let(url_struct(raw), lambda u: F.when(u["valid"], u["url_key"]))

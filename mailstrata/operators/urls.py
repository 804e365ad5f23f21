"""URLs of a message: a ledger of candidates, merge by identity, observations.

Shape of the job: message rows -> text sources -> HTML stage -> candidates, all narrow. The ledger holds what
this one pass finds: every candidate with its rank in the message and its parts, HTML failures, and a marker
row per message. URLs, warnings and counts are read from it, so extraction runs once. A message's rows leave the
pass together and in order, so ranks are counted on the way, without an exchange.

Merging exchanges by (message, identity), not by message: a message with millions of URLs spreads over all tasks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from mailstrata import rules
from mailstrata.functions.common import null_if_empty, rows_of, strip
from mailstrata.functions.text import clean_url_text, looks_defanged, url_spellings
from mailstrata.functions.urls import with_url
from mailstrata.limits import UNBOUNDED, Limits
from mailstrata.operators.html import html_links
from mailstrata.operators.observations import (
    observation,
    observation_rows,
    present,
)
from mailstrata.session import ship_package
from mailstrata.sources.arrow_stage import running_count

_MARKER = "message"  # one row per message, so that "no URLs" is observable
_FAILED = "html-failed"
#: Room for the observations of one URL between the ranks of two.
_CODES = 16


def text_sources(df: DataFrame) -> DataFrame:
    """One row per scannable text of an accepted message, behind one marker row per message: body parts in
    document order, then header values."""

    def source(kind: Column, detail: Column, text: Column) -> Column:
        return F.struct(kind.alias("kind"), detail.cast("string").alias("detail"),
                        text.cast("string").alias("text"))

    bodies = F.transform("texts", lambda t: source(
        F.when(t["content_type"] == "text/html", "html").otherwise("body-text"),
        t["part_index"], t["text"]))
    headers = F.transform("header_urls", lambda h: source(F.lit("header"), h["name"], h["value"]))
    marker = F.array(source(F.lit(_MARKER), F.lit(None), F.lit(None)))
    return df.where(F.col("reject").isNull()).select(
        "source_path", "evidence_id", F.inline_outer(F.concat(marker, bodies, headers)))


def linked_sources(df: DataFrame) -> DataFrame:
    """Text sources with HTML parts replaced by their link structure."""
    sources = text_sources(df).withColumns({
        "html": F.when(F.col("kind") == "html", F.col("text")),
        "text": F.when(F.col("kind") != "html", F.col("text")),
    })
    return html_links(sources, "html", absolute_only=True)


def candidates(df: DataFrame) -> DataFrame:
    """Every URL spelling found, in document order; marker and failed HTML parts have a NULL candidate."""
    piece = F.struct(F.col("kind").alias("kind"), F.col("detail").alias("detail"), F.col("text").alias("text"),
                     F.lit(None).cast("string").alias("anchor_text"))
    failed = F.struct(F.lit(_FAILED).alias("kind"), F.col("detail").alias("detail"),
                      F.lit(None).cast("string").alias("text"), F.col("html_links.failed").alias("anchor_text"))
    links = F.transform(F.col("html_links.links"), lambda link: F.struct(
        link["kind"].alias("kind"),
        F.when(link["tag"].isNotNull(), F.concat(
            F.col("detail"), F.lit(" <"), link["tag"], F.lit(" "), link["attr"], F.lit(">")))
        .otherwise(F.col("detail")).alias("detail"),
        link["value"].alias("text"), link["anchor_text"].alias("anchor_text")))
    pieces = F.when(F.col("html_links.failed").isNotNull(), F.array(failed)).when(
        F.col("html_links").isNotNull(), links).otherwise(F.array(piece))
    rows = rows_of(linked_sources(df), ("source_path", "evidence_id"), pieces, "piece")
    spelled = F.when(F.col("piece.kind").isin(_MARKER, _FAILED), F.array(F.lit(None).cast("string"))).otherwise(
        url_spellings(F.col("piece.text")))
    # The text itself stays behind: a copy for each URL in it would grow with the square of its length.
    kept = ("source_path", "evidence_id", "kind", "detail", "anchor_text")
    rows = rows.select("source_path", "evidence_id", "piece.kind", "piece.detail", "piece.anchor_text", spelled.alias("spellings"))
    return rows_of(rows, kept, "spellings", "spelling", "match_ord").select(
        *kept, clean_url_text(F.col("spelling")).alias("candidate"))


def url_ledger(df: DataFrame) -> DataFrame:
    """One pass over the accepted messages of ``df``: ``source_path, evidence_id, rank, kind, detail,
    anchor_text, candidate, defanged_in_source, u``.

    ``rank`` counts a message's candidates from 1; ``u`` is a candidate's decomposition and ``u.valid`` false
    where it is no URL after all. The marker row of a message has rank 0.
    """
    found = candidates(df).withColumn("counted", F.col("candidate").isNotNull())
    ranked = running_count(found, "source_path", "counted", "rank").drop("counted")
    return with_url(ranked.withColumn("defanged_in_source", looks_defanged(F.col("candidate"))), "candidate")


def sightings(ledger: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The valid ones of the first ``limits.url_candidates`` candidates of each message."""
    return ledger.where(F.col("u.valid") & (F.col("rank") <= limits.url_candidates))


def url_sightings(ledger: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``url_sightings``: one row per valid sighting."""
    return sightings(ledger, limits).select(
        "source_path", "evidence_id", "rank", "kind", "detail", "defanged_in_source", "candidate",
        "anchor_text", "u.url", "u.url_key")


def with_display_key(df: DataFrame) -> DataFrame:
    """``display_key``: identity of the first URL spelled in the anchor text, if it is a URL."""
    text = strip(null_if_empty(F.col("anchor_text")))
    shown = clean_url_text(clean_url_text(F.try_element_at(url_spellings(text), F.lit(1))))
    df = with_url(df.withColumn("shown_url", shown), "shown_url", "d")
    return df.withColumn("display_key", F.when(F.col("d.valid"), F.col("d.url_key"))).drop(
        "d", "shown_url")


def merged_urls(ledger: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per (message, URL identity), first sighting wins.

    Sightings at the same place are counted first, then merged, so the second step sees one row per
    place. Both exchanges are by identity.
    """
    seen = with_display_key(sightings(ledger, limits))
    differs = F.col("display_key").isNotNull() & (F.col("display_key") != F.col("u.url_key"))
    seen = seen.withColumn("mismatch", F.when(differs, F.struct("rank", "anchor_text")))
    places = seen.groupBy(
        "source_path", "evidence_id", F.col("u.url_key").alias("url_key"), "kind", "detail",
        "defanged_in_source",
    ).agg(
        F.count(F.lit(1)).alias("count"), F.min("rank").alias("rank"),
        F.min_by("u", "rank").alias("u"), F.min("mismatch").alias("mismatch"))
    source = F.struct("rank", "kind", "detail", "defanged_in_source", "count")
    return places.groupBy("source_path", "evidence_id", "url_key").agg(
        F.min("rank").alias("rank"),
        F.min_by("u", "rank").alias("u"),
        F.min("mismatch").alias("mismatch"),
        F.sum(F.when(F.col("defanged_in_source"), F.col("count")).otherwise(0))
        .alias("defanged_sightings"),
        F.transform(F.sort_array(F.collect_list(source)), lambda s: s.dropFields("rank"))
        .alias("sources"))


@F.arrow_udf(StringType())
def _idna_text(hosts: pa.Array) -> pa.Array:
    known: dict[str, str] = {}

    def shown(host: str | None) -> str | None:
        if host is None:
            return None
        if host not in known:
            try:
                known[host] = host.encode("ascii").decode("idna")
            except (UnicodeError, ValueError):
                known[host] = host
        return known[host]

    return pa.array([shown(h) for h in hosts.to_pylist()], type=pa.string())


def host_unicode(host: Column, punycode: Column) -> Column:
    """Unicode form of a host. Only punycode hosts reach the Arrow function; others are NULL there."""
    return F.coalesce(_idna_text(F.when(punycode, host)), host)


URL_COLUMNS = (
    "url", "defanged", "scheme", "host", "host_unicode", "port", "path", "query_params",
    "fragment", "host_is_ip", "ip_version", "punycode", "userinfo", "registered_domain",
    "subdomain_depth", "tld", "nonstandard_port", "shortener", "invalid_port",
)


def with_observations(merged: DataFrame) -> DataFrame:
    """Flatten ``u`` and add ``observed``: the observations of each URL."""
    ship_package(merged.sparkSession)
    fields = [c for c in URL_COLUMNS if c != "host_unicode"]
    df = merged.select(
        "source_path", "evidence_id", "url_key", "rank", "mismatch", "defanged_sightings", "sources",
        *[F.col(f"u.{c}").alias(c) for c in fields])
    df = df.withColumn("host_unicode", host_unicode(F.col("host"), F.col("punycode")))
    return df.withColumn("observed", _url_observations())


def url_counts(ledger: DataFrame, merged: DataFrame) -> DataFrame:
    """Observation rows: how many distinct URLs each message has, combined map-side."""
    markers = ledger.where(F.col("kind") == _MARKER).select("source_path", "evidence_id", F.lit(0).alias("n"))
    n = F.col("n")
    counted = markers.unionByName(merged.select("source_path", "evidence_id", F.lit(1).alias("n"))).groupBy(
        "source_path", "evidence_id").agg(F.sum("n").alias("n"))
    return observation_rows(counted.withColumn("observed", F.array(observation(
        1 << 60, F.when(n > 0, "url-count").otherwise("no-urls"),
        F.concat(n.cast("string"), F.lit(" distinct URL(s)")), url_count=n))), "urls", "observed")


def _url_observations() -> Column:
    url, host = F.col("url"), F.col("host")
    place = F.col("rank") * _CODES
    names = F.transform("query_params", lambda p: p["name"])
    shown = clean_url_text(strip(F.col("mismatch.anchor_text")))
    items = [
        (F.col("host_is_ip"), "ip-literal-host", F.lit("the host is an address"),
         {"host": host, "ip_version": F.col("ip_version")}),
        (F.col("userinfo") != "", "userinfo-present", F.lit("text before @ is not the host"),
         {"userinfo": F.col("userinfo")}),
        (F.col("punycode"), "punycode-host", F.concat(F.lit("shown as "), F.col("host_unicode")),
         {"host": host, "host_unicode": F.col("host_unicode")}),
        (F.col("shortener"), "shortened-url", F.lit("the destination is not in the URL"),
         {"host": host}),
        (F.col("nonstandard_port"), "nonstandard-port",
         F.concat(F.lit("port "), F.col("port").cast("string")),
         {"port": F.col("port"), "scheme": F.col("scheme")}),
        (F.col("invalid_port"), "invalid-port", F.lit("the port is not a port number"), {}),
        (F.col("scheme") == "http", "http-scheme", F.lit("not encrypted in transit"), {}),
        (F.size("query_params") >= rules.MANY_QUERY_PARAMS, "many-query-params",
         F.concat(F.size("query_params").cast("string"), F.lit(" query parameters")),
         {"param_names": F.to_json(names)}),
        (F.col("subdomain_depth") >= rules.DEEP_SUBDOMAIN, "deep-subdomain",
         F.concat(F.col("subdomain_depth").cast("string"), F.lit(" labels before the domain")),
         {"host": host, "depth": F.col("subdomain_depth"),
          "registered_domain": F.col("registered_domain")}),
        (F.col("defanged_sightings") > 0, "defanged-in-source",
         F.lit("written in a defanged spelling"), {"sightings": F.col("defanged_sightings")}),
        (F.col("mismatch").isNotNull(), "display-href-mismatch",
         F.concat(F.lit("the text shows "), shown), {"display_text": shown, "href": url}),
    ]
    return present(*[
        (cond, observation(place + k, code, detail, url, url=url, **basis))
        for k, (cond, code, detail, basis) in enumerate(items)
    ])


def url_rows(observed: DataFrame) -> DataFrame:
    """``urls``: one row per distinct URL of a message, with its sources and observation codes."""
    return observed.select(
        "source_path", "evidence_id", *URL_COLUMNS, "sources",
        F.array_distinct(F.transform("observed", lambda o: o["code"])).alias("observation_codes"))


def url_observations(observed: DataFrame) -> DataFrame:
    return observation_rows(observed, "urls", "observed")


def url_warnings(ledger: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Warnings of extraction and decomposition, read off the ledger; those of decoding come with the message
    rows."""
    cap = limits.url_candidates
    failed = F.col("kind") == _FAILED
    bad = (F.col("rank") <= cap) & ~F.coalesce("u.valid", F.lit(True))
    found = ledger.where(failed | bad).select(
        "source_path", F.lit("urls").alias("stage"),
        (F.col("rank") + F.when(failed, 0).otherwise(1 << 32)).cast("bigint").alias("seq"),
        F.when(failed, "url-html-parse-failed").otherwise("url-unparseable").alias("code"),
        F.when(failed, F.col("anchor_text")).otherwise(F.col("candidate")).alias("detail"),
        F.when(failed, F.col("detail")).alias("part"))
    if cap >= UNBOUNDED:
        return found
    late = ledger.where(F.col("rank") > cap).groupBy("source_path").agg(F.max("rank").alias("found")).select(
        "source_path", F.lit("urls").alias("stage"), (F.lit(1 << 33) + F.col("found")).alias("seq"),
        F.lit("url-candidate-cap").alias("code"),
        F.concat(F.col("found").cast("string"), F.lit(f" found, first {cap} kept")).alias("detail"),
        F.lit(None).cast("string").alias("part"))
    return found.unionByName(late)

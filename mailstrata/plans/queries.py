"""Registered queries: one per operator group, each over whole driver tables.

Results are flat scalar columns. Queries on the message corpora render the corpus from a table and run
the same operators ``analyze`` runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailstrata import rules
from mailstrata.functions import (
    canonical_ip,
    defang_text,
    defang_url,
    domain_of,
    evidence_id,
    identify_bytes,
    ip_hex,
    ip_version,
    is_private_ip,
    looks_defanged,
    org_domain,
    sha256_hex,
    truncate_display,
    undefang_url,
)
from mailstrata.functions.common import pinned, rows_of
from mailstrata.functions.ip import private_ranges
from mailstrata.functions.urls import with_url
from mailstrata.limits import MIB, Limits
from mailstrata.operators import attachments as att
from mailstrata.operators import auth, containers, headers, html, mime, networks, received, urls
from mailstrata.operators.addresses import with_from_domain, with_return_path
from mailstrata.plans import analysis, documents
from mailstrata.session import stage
from mailstrata.sources import corpora
from mailstrata.sources.mail import accepted, fingerprint

# Bounds of the two queries about rejected messages; a job has none unless it sets them.
_BOUNDS = Limits(message_bytes=25 * MIB, header_bytes=MIB, mime_parts=200, mime_depth=16)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- corpora in the states queries start from -----------------------------------------------


def _fields(messages: DataFrame) -> DataFrame:
    """Accepted messages with their header array; no Python worker is involved."""
    return headers.with_fields(accepted(fingerprint(messages)).select(
        "source_path", "evidence_id", "head"))


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(corpora.chain_messages(spark, sf_dir))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(corpora.auth_messages(spark, sf_dir))


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mime.flatten_messages(corpora.url_messages(spark, sf_dir), with_payload=False, with_head=False)


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_ledger(_linked(spark, sf_dir))


def _carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mime.flatten_messages(corpora.attachment_messages(spark, sf_dir), with_text=False, with_head=False)


def _structure(messages: DataFrame, with_head: bool = False) -> DataFrame:
    return mime.flatten_messages(messages, with_text=False, with_payload=False, with_head=with_head)


# --- functions over driver tables -----------------------------------------------------------


@query
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = sha256_hex(F.encode("text", "UTF-8"))
    return corpora.table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", sha.alias("sha256"), evidence_id(sha).alias("evidence_id"))


@query
def payload_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.encode("html", "UTF-8")
    return corpora.table(spark, sf_dir, "pages", "page_id", "html").select(
        "page_id", F.octet_length(raw).alias("size_bytes"), F.sha2(raw, 256).alias("sha256"),
        F.md5(raw).alias("md5"))


@query
def address_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all(
        "text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0))
    docs = corpora.table(spark, sf_dir, "documents", "doc_id", "text")
    domain = domain_of(F.col("address"))
    return rows_of(docs, ("doc_id",), found, "address", "pos").select(
        "doc_id", "pos", "address", domain.alias("domain"), org_domain(domain).alias("org_domain"))


@query
def private_ip_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IPv4 literals of the documents, each also moved into three internal networks, looked up in the
    network dimension."""
    docs = corpora.table(spark, sf_dir, "documents", "doc_id", "text")
    found = F.regexp_extract_all("text", F.lit(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"), F.lit(0))
    rows = rows_of(docs, ("doc_id",), found, "literal", "pos")
    tail = F.regexp_replace("literal", r"^[0-9]+\.", "")
    rest = F.regexp_replace("literal", r"^[0-9]+\.[0-9]+\.", "")
    moved = F.array(F.col("literal"), F.concat(F.lit("10."), tail),
                    F.concat(F.lit("172.31."), rest), F.concat(F.lit("100.128."), rest))
    rows = rows_of(rows, ("doc_id", "pos"), moved, "literal", "variant")
    rows = rows.withColumn("ip", canonical_ip(F.col("literal")))
    rows = rows.withColumns({"ip_hex": ip_hex(F.col("ip")), "ip_version": ip_version(F.col("ip")),
                             "is_private": is_private_ip(F.col("ip"))})
    rows = networks.with_networks(rows, private_ranges(spark))
    return rows.select("doc_id", "pos", "variant", "literal", "ip_hex", "is_private",
                       F.explode_outer("networks").alias("network"))


def _page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_url(corpora.table(spark, sf_dir, "pages", "page_id", "url"), "url")


@query
def url_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("scheme", "host", "port", "path", "fragment", "host_is_ip", "registered_domain",
             "subdomain_depth", "tld", "nonstandard_port", "shortener", "punycode", "userinfo")
    return _page_urls(spark, sf_dir).where("u.valid").select(
        "page_id", *[F.col(f"u.{n}").alias(n) for n in names])


@query
def url_query_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(_page_urls(spark, sf_dir).where("u.valid"), ("page_id",),
                   F.col("u.query_params"), "param", "pos").select(
        "page_id", "pos", "param.name", "param.value")


@query
def url_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL identities over all pages: first page and spelling win, the rest is counted."""
    first = F.struct("page_id", "u.url")
    return _page_urls(spark, sf_dir).where("u.valid").groupBy(
        F.col("u.url_key").alias("url_key")).agg(
        F.count(F.lit(1)).alias("pages"), F.min(first).alias("first")).select(
        "url_key", "pages", F.col("first.page_id").alias("first_page"),
        F.col("first.url").alias("first_url"))


@query
def url_defang(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = defang_url(F.col("url"))
    return corpora.table(spark, sf_dir, "pages", "page_id", "url").select(
        "page_id", shown.alias("defanged"), undefang_url(shown).alias("restored"),
        looks_defanged(F.col("url")).alias("plain_looks_defanged"),
        looks_defanged(shown).alias("shown_looks_defanged"),
        defang_url(shown).alias("twice"))


@query
def defang_free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Go to "), "url", F.lit(" or <"), F.upper("url"), F.lit("> etc."))
    return corpora.table(spark, sf_dir, "pages", "page_id", "url").select(
        "page_id", defang_text(text).alias("shown"))


@query
def display_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", truncate_display(F.col("text"), Limits().display_chars).alias("shown"))


@query
def html_link_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.html_links(corpora.table(spark, sf_dir, "pages", "page_id", "html"), "html")
    links = rows_of(pages, ("page_id",), F.col("html_links.links"), "link", "pos")
    return links.where(F.col("link.kind") != "html-text").select(
        "page_id", "pos", "link.kind", "link.tag", "link.attr", "link.value", "link.anchor_text")


@query
def page_identification(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = identify_bytes(F.encode("html", "UTF-8"))
    return corpora.table(spark, sf_dir, "pages", "page_id", "html").select(
        "page_id", kind["category"].alias("category"), kind["label"].alias("label"))


@query
def document_identification(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = identify_bytes(F.encode("text", "UTF-8"))
    return corpora.table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", kind["label"].alias("label"))


# --- headers and relay chain ----------------------------------------------------------------


@query
def header_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers.header_rows(_chains(spark, sf_dir)).select("source_path", "name", "value")


@query
def routing_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_return_path(headers.with_routing(_chains(spark, sf_dir)))
    return df.select(
        "source_path", "message_id", "x_originating_ip", "x_sender_ip", "x_mailer", "user_agent",
        "mime_version", "top_content_type", F.col("return_path.addr").alias("return_path"),
        F.try_element_at("list_headers", F.lit("list-id")).alias("list_id"),
        F.size("list_headers").alias("list_headers"),
        F.col("date.original").alias("date_original"), F.col("date.utc").alias("date_utc"),
        F.col("date.valid").alias("date_valid"))


@query
def received_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return received.hop_rows(_chains(spark, sf_dir)).drop(
        "evidence_id", "raw", "timestamp_epoch", "timestamp_original")


def _header_codes(spark: SparkSession, sf_dir: str, *codes: str) -> DataFrame:
    rows = received.header_observations(_chains(spark, sf_dir), codes)
    return rows.where(F.col("code").isin(*codes))


def _basis(name: str) -> Column:
    return F.try_element_at("basis", F.lit(name)).alias(name)


@query
def hop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _header_codes(spark, sf_dir, "hop-count", "no-received-headers").select(
        "source_path", "code", _basis("hops"))


@query
def hop_missing_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _header_codes(spark, sf_dir, "missing-timestamp").select("source_path", _basis("hop"))


@query
def private_ip_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _header_codes(spark, sf_dir, "private-ip-hop").select(
        "source_path", _basis("hop"), _basis("clause"), _basis("ip"))


@query
def unverifiable_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _header_codes(spark, sf_dir, "unverifiable-from").select(
        "source_path", _basis("hop"), _basis("from_host"))


@query
def hop_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _header_codes(spark, sf_dir, "timestamp-inversion").select(
        "source_path", _basis("hop"), _basis("hop_timestamp"), _basis("previous_hop"),
        _basis("previous_timestamp"))


@query
def originating_ip_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _header_codes(spark, sf_dir, "originating-ip-claim").select(
        "source_path", _basis("header"), _basis("value"))


@query
def received_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return received.header_warnings(_chains(spark, sf_dir)).groupBy("source_path", "code").agg(
        F.count(F.lit(1)).alias("n"))


# --- authentication -------------------------------------------------------------------------


@query
def auth_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = auth.auth_result_rows(_claims(spark, sf_dir)).withColumns({
        "domain": auth.property_domain(F.col("properties"), rules.CLAIM_DOMAIN_KEYS),
        "display_domain": auth.property_domain(F.col("properties"), rules.DISPLAY_DOMAIN_KEYS),
    })
    return rows.select(
        "source_path", "ordinal", "authserv_id", "method", "result", "known_result", "reason",
        F.size("properties").alias("properties"), "domain", "display_domain")


@query
def dkim_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = auth.dkim_rows(_claims(spark, sf_dir))
    return rows.select(
        "source_path", "ordinal", "d", "s", "a", "c", "bh", F.array_join("h", ":").alias("h"),
        F.try_element_at("other_tags", F.lit("b")).alias("b"),
        F.size("other_tags").alias("other_tags"), "cryptographically_verified")


@query
def received_spf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auth.spf_rows(_claims(spark, sf_dir)).select(
        "source_path", "ordinal", "result", "detail")


@query
def auth_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auth.auth_warnings(_claims(spark, sf_dir)).select("source_path", "code")


@query
def from_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_from_domain(_claims(spark, sf_dir)).select("source_path", "from_domain")


def _auth_codes(spark: SparkSession, sf_dir: str, group: str, predicate: Column) -> DataFrame:
    return auth.auth_observations(_claims(spark, sf_dir), (group,)).where(predicate)


@query
def auth_method_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _auth_codes(spark, sf_dir, "results", F.element_at("basis", "method").isNotNull()
                       & (F.col("code") != "conflicting-auth-results")).select(
        "source_path", "code", _basis("authserv_id"), _basis("domain"))


@query
def auth_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _auth_codes(spark, sf_dir, "conflicts", F.col("code") == "conflicting-auth-results").select(
        "source_path", _basis("method"), _basis("results"))


@query
def dkim_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _auth_codes(spark, sf_dir, "signatures", F.col("code").startswith("dkim-signature-")).select(
        "source_path", "code", _basis("d"))


@query
def auth_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _auth_codes(spark, sf_dir, "alignment", F.col("code").contains("-alignment-")).select(
        "source_path", "code", F.col("subject").alias("domain"), _basis("from_domain"))


@query
def spf_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _auth_codes(spark, sf_dir, "received_spf", F.col("code") == "spf-claim-disagreement").select(
        "source_path", _basis("received_spf"), _basis("auth_results_spf"))


@query
def auth_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _auth_codes(spark, sf_dir, "absent", F.col("code") == "no-auth-headers").select("source_path")


# --- message structure ----------------------------------------------------------------------


@query
def message_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mime.part_rows(_structure(corpora.attachment_messages(spark, sf_dir))).select(
        "source_path", "part_index", "parent_index", "depth", "ordinal", "content_type",
        "is_container", "filename", "disposition", "size_bytes", "is_attachment")


@query
def attachment_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mime.attachment_inventory(
        _structure(corpora.attachment_messages(spark, sf_dir))).drop("evidence_id")


@query
def message_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mime.address_rows(_structure(corpora.chain_messages(spark, sf_dir), with_head=True)).drop("evidence_id")


@query
def message_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded subject and sender name (RFC 2047), normalized date."""
    parsed = _structure(corpora.attachment_messages(spark, sf_dir), with_head=True)
    return analysis.message_rows(parsed).select(
        "source_path", "subject", F.col("from_addr.display_name").alias("from_name"),
        F.col("from_addr.addr").alias("from_addr"), F.col("date.utc").alias("date_utc"))


@query
def missing_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mime.message_warnings(_structure(corpora.chain_messages(spark, sf_dir))).where(
        F.col("code") == "missing-header").select("source_path", "detail")


@query
def message_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = mime.flatten_messages(corpora.bounds_messages(spark, sf_dir), _BOUNDS, with_text=False,
                                   with_payload=False, with_head=False)
    return mime.reject_rows(parsed).select(
        "source_path", "reason", "limit")


@query
def message_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _structure(corpora.attachment_messages(spark, sf_dir), with_head=True)
    return documents.overview(parsed).select(
        "source_path", "date", "from", "to", "subject", "parts", "content_type", "attachments",
        "files", "warnings", "first_warning")


# --- URLs -----------------------------------------------------------------------------------


@query
def url_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_sightings(_ledger(spark, sf_dir)).select(
        "source_path", "kind", "detail", "candidate", "defanged_in_source", "url_key")


@query
def url_unparseable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_warnings(_ledger(spark, sf_dir)).select("source_path", "code", "detail")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.with_observations(urls.merged_urls(_ledger(spark, sf_dir)))


@query
def url_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct URLs of each message in canonical order."""
    order = Window.partitionBy("source_path").orderBy("url")
    rows = urls.url_rows(_merged(spark, sf_dir))
    sightings = F.aggregate("sources", F.lit(0).cast("bigint"), lambda n, s: n + s["count"])
    return rows.select(
        "source_path", F.row_number().over(order).alias("position"), "url",
        F.size("sources").alias("sources"), sightings.alias("sightings"))


@query
def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_rows(_merged(spark, sf_dir)).select(
        "source_path", "host", "host_unicode", "punycode", "shortener", "host_is_ip",
        "invalid_port", "port", "userinfo", "subdomain_depth", F.size("query_params").alias("params")
    )


def _url_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_observations(_merged(spark, sf_dir))


@query
def url_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _url_codes(spark, sf_dir).select(
        "source_path", "code", F.col("subject").alias("url"))


@query
def display_href_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _url_codes(spark, sf_dir).where(F.col("code") == "display-href-mismatch").select(
        "source_path", _basis("href"), _basis("display_text"))


@query
def url_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = _ledger(spark, sf_dir)
    return urls.url_counts(ledger, urls.merged_urls(ledger)).select("source_path", "code", _basis("url_count"))


@query
def page_url_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observation codes of the page URLs by registered domain; expressions only, no Python."""
    u = F.col("u")
    codes = F.array(
        F.when(u["scheme"] == "http", F.lit("http-scheme")),
        F.when(F.size(u["query_params"]) >= rules.MANY_QUERY_PARAMS, F.lit("many-query-params")),
        F.when(u["subdomain_depth"] >= rules.DEEP_SUBDOMAIN, F.lit("deep-subdomain")),
        F.when(u["nonstandard_port"], F.lit("nonstandard-port")),
        F.when(u["shortener"], F.lit("shortened-url")),
        F.lit("url"))
    rows = _page_urls(spark, sf_dir).where("u.valid").select(
        u["registered_domain"].alias("registered_domain"), u["url_key"].alias("url_key"),
        codes.alias("codes"))
    rows = rows_of(rows, ("registered_domain", "url_key"),
                   F.filter("codes", lambda c: c.isNotNull()), "code")
    # Counted per identity first, so a domain that holds most pages is pre-aggregated.
    return rows.groupBy("registered_domain", "code", "url_key").agg(
        F.count(F.lit(1)).alias("n")).groupBy("registered_domain", "code").agg(
        F.sum("n").alias("pages"), F.count(F.lit(1)).alias("urls"))


# --- attachments ----------------------------------------------------------------------------


@query
def attachment_identification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return att.attachment_rows(_carried(spark, sf_dir)).select(
        "source_path", "part_index", "filename", "mime_claim", "size_bytes", "md5", "category",
        "label", "extension", F.size("extension_chain").alias("extensions"))


_CORPUS_LIMITS = Limits(oversized_bytes=200)


def _attachment_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    carried = att.attachment_rows(_carried(spark, sf_dir))
    return att.own_observations(carried, _CORPUS_LIMITS)


@query
def attachment_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attachment_codes(spark, sf_dir).select("source_path", "code", "subject")


@query
def extension_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return att.with_agreement(att.attachment_rows(_carried(spark, sf_dir)).drop("payload")).where(
        F.col("extension_mismatch") | F.col("mime_mismatch")).select(
        "source_path", "extension", "label", "mime_claim", "extension_mismatch", "mime_mismatch")


def _inventoried(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.with_inventory(att.attachment_rows(_carried(spark, sf_dir)))


@query
def container_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.container_entries(_inventoried(spark, sf_dir)).drop("evidence_id")


@query
def container_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return att.listed_observations(_inventoried(spark, sf_dir)).select(
        "source_path", "code", "subject")


@query
def container_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return att.container_warnings(_inventoried(spark, sf_dir)).select("source_path", "code", "part")


@query
def attachment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return att.count_observations(_structure(corpora.attachment_messages(spark, sf_dir))).select(
        "source_path", "code", _basis("text"))


# --- assembly -------------------------------------------------------------------------------


@query
def message_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = corpora.chain_messages(spark, sf_dir).unionByName(
        corpora.bounds_messages(spark, sf_dir))
    return analysis.header_status(both, _BOUNDS).select("source_path", "status")


@query
def observation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations and affected messages by area and code; each area over its own corpus."""
    ledger = stage(_ledger(spark, sf_dir), "ledger")
    seen = urls.with_observations(urls.merged_urls(ledger))
    parts = [urls.url_observations(seen), urls.url_counts(ledger, seen), _attachment_codes(spark, sf_dir)]
    return analysis.observation_rollup(
        analysis.union(parts), received.header_code_counts(_chains(spark, sf_dir)),
        auth.auth_code_counts(_claims(spark, sf_dir)))


_DOCUMENT = (
    "struct<evidence_id:string,sha256:string,subject:string,date:struct<utc:string>,`from`:struct<addr:string>,"
    "mime_tree:struct<index:string,size_bytes:bigint,children:array<struct<index:string,content_type:string,"
    "children:array<struct<index:string>>>>>,parser_warnings:array<struct<code:string>>,"
    "headers:struct<received:array<struct<position:int>>,list_headers:map<string,string>,observations:array<struct<code:string>>>,"
    "authentication:struct<from_domain:string,observations:array<struct<code:string>>>,"
    "urls:struct<url_count:bigint,urls:array<struct<url:string,sources:array<struct<count:bigint>>>>,"
    "observations:array<struct<code:string>>,parser_warnings:array<struct<code:string,detail:string>>>,"
    "attachments_detail:struct<attachments:array<struct<filename:string>>,observations:array<struct<code:string>>>>")


@query
def message_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON documents of the URL corpus, unpacked again: keys of all blocks, scalars, tree and lists."""
    made = documents.message_documents(analysis.analyze(corpora.url_messages(spark, sf_dir)))
    d = F.from_json("document", _DOCUMENT)

    def keys(text: Column) -> Column:
        return F.array_join(F.json_object_keys(text), ",")

    def codes(area: str) -> Column:
        return F.array_join(F.transform(F.col(f"d.{area}.observations"), lambda o: o["code"]), ",")

    nodes = F.flatten(F.transform("d.mime_tree.children", lambda n: F.concat(
        F.array(F.concat_ws(" ", n["index"], n["content_type"])), F.transform(n["children"], lambda c: c["index"]))))
    # Each reading of the text goes through all of it: one for the values, one for the texts of all blocks.
    blocks = ("mime_tree", "headers", "authentication", "urls", "attachments_detail")
    read = pinned(made, made.columns, d, "d")
    return read.select("*", F.json_tuple("document", *blocks).alias(*[f"{b}_text" for b in blocks])).select(
        "source_path", keys(F.col("document")).alias("keys"), *[keys(F.col(f"{b}_text")).alias(f"{b}_keys") for b in blocks],
        F.col("d.subject").alias("subject"), F.col("d.date.utc").alias("date_utc"), F.col("d.from.addr").alias("from_addr"),
        F.col("d.mime_tree.index").alias("root"), F.array_join(nodes, ",").alias("nodes"),
        F.size("d.parser_warnings").alias("warnings"), F.size("d.headers.received").alias("hops"),
        F.try_element_at("d.headers.list_headers", F.lit("list-unsubscribe")).alias("unsubscribe"),
        codes("headers").alias("header_codes"), codes("authentication").alias("auth_codes"),
        F.col("d.authentication.from_domain").alias("from_domain"), F.col("d.urls.url_count").alias("url_count"),
        F.array_join(F.transform("d.urls.urls", lambda u: F.concat_ws(" ", u["url"], F.size(u["sources"]).cast("string"))), ",").alias("urls"),
        F.size("d.urls.observations").alias("url_observations"),
        F.array_join(F.transform("d.urls.parser_warnings", lambda w: F.concat_ws(" ", w["code"], w["detail"])), ",").alias("url_warnings"),
        F.size("d.attachments_detail.attachments").alias("attachments"), codes("attachments_detail").alias("attachment_codes"))

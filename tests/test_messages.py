"""Whole messages through ``analyze``: structure, headers, claims, URLs, attachments, bounds."""

from __future__ import annotations

import glob
import io
import json
import os
import struct
import time
import zipfile
from email.message import EmailMessage

import pytest
from conftest import grouped
from pyspark.sql import functions as F

from mailstrata.functions.text import clean_url_text
from mailstrata.limits import Limits
from mailstrata.operators.auth import conflicting_methods
from mailstrata.operators.headers import header_fields
from mailstrata.plans import documents
from mailstrata.plans.analysis import analyze
from mailstrata.plans.publish import publish, published, read_published
from mailstrata.session import staging_root


def crlf(*lines: str, body: str = "hello\r\n") -> bytes:
    return ("\r\n".join(lines) + "\r\n\r\n" + body).encode()


BASE = ("From: Ann <ann@example.org>", "To: bob@example.com",
        "Date: Tue, 06 Oct 2026 10:00:00 +0200")


def attached(name: str | None, payload: bytes, mime: str = "application/octet-stream") -> bytes:
    message = EmailMessage()
    message["From"], message["Date"] = "ann@example.org", "Tue, 06 Oct 2026 10:00:00 +0000"
    message.set_content("see file")
    main, sub = mime.split("/")
    message.add_attachment(payload, maintype=main, subtype=sub, filename=name)
    return message.as_bytes()


def zipped(*members: tuple[str, bytes], locked: bool = False) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, data in members:
            archive.writestr(name, data)
    raw = bytearray(out.getvalue())
    if locked:  # set the encryption flag in the local and central headers
        for mark, offset in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
            at = raw.find(mark)
            while at != -1:
                raw[at + offset] |= 1
                at = raw.find(mark, at + 4)
    return bytes(raw)


def compound(*names: tuple[str, int]) -> bytes:
    """A minimal compound file: one FAT sector, one directory sector, entries linked as siblings."""
    header = bytearray(512)
    header[:8] = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
    struct.pack_into("<H", header, 30, 9)
    struct.pack_into("<II", header, 44, 1, 1)
    for i in range(109):
        struct.pack_into("<I", header, 76 + 4 * i, 0 if i == 0 else 0xFFFFFFFF)
    fat = struct.pack("<2I", 0xFFFFFFFD, 0xFFFFFFFE) + b"\xff" * 504
    directory = b""
    for i, (name, kind) in enumerate((("Root Entry", 5), *names)):
        text = name.encode("utf-16-le") + b"\x00\x00"
        right = i + 1 if 0 < i < len(names) else -1
        child = 1 if i == 0 and names else -1
        directory += (text.ljust(64, b"\x00") + struct.pack("<HBB", len(text), kind, 1)
                      + struct.pack("<iii", -1, right, child) + bytes(48))
    return bytes(header) + fat + directory.ljust(512, b"\x00")


# --- structure and bounds ---------------------------------------------------------------------


def test_structure(table):
    nested = EmailMessage()
    nested["From"] = "in@example.org"
    nested.set_content("inner https://inner.example/x")
    outer = EmailMessage()
    outer["From"] = "=?utf-8?q?J=C3=BCrgen?= <j@example.org>"
    outer["To"] = '"Last, First" <a@example.org>, b@example.org'
    outer["Subject"] = "=?utf-8?b?Z3LDtsOfZQ==?="
    outer["Date"] = "Tue, 06 Oct 2026 10:00:00"
    outer.set_content("plain")
    outer.add_alternative("<p>html</p>", subtype="html")
    outer.add_attachment(b"abc", maintype="application", subtype="x", filename="übung.bin")
    outer.add_attachment(nested)
    raw = outer.as_bytes()
    tables = analyze(table({"a": raw, "copy": raw}))
    parts = {r.part_index: r for r in tables["parts"].where("source_path = 'a'").collect()}
    assert [(i, p.content_type, p.is_container) for i, p in sorted(parts.items())] == [
        ("0", "multipart/mixed", True), ("0.0", "multipart/alternative", True),
        ("0.0.0", "text/plain", False), ("0.0.1", "text/html", False),
        ("0.1", "application/x", False), ("0.2", "message/rfc822", True),
        ("0.2.0", "text/plain", False)]
    leaves = sum(p.size_bytes for p in parts.values() if not p.is_container)
    assert parts["0"].size_bytes == leaves and parts["0"].sha256 is None
    assert parts["0.1"].filename == "übung.bin" and parts["0.1"].parent_index == "0"
    message = tables["messages"].where("source_path = 'a'").first()
    assert message.subject == "größe" and message.from_addr.display_name == "Jürgen"
    assert [t.display_name for t in message.to] == ["Last, First", ""]
    # "-0000" says that the zone is unknown: the claim is kept, no instant is made up.
    assert message.date.original == "Tue, 06 Oct 2026 10:00:00 -0000"
    assert not message.date.valid and message.date.utc is None
    # Equal bytes share the evidence id, yet stay two messages.
    assert tables["messages"].select("evidence_id").distinct().count() == 1
    assert grouped(tables["attachment_inventory"], "filename") == {
        "a": ["übung.bin"], "copy": ["übung.bin"]}
    assert ["https://inner.example/x"] == grouped(tables["urls"], "url")["a"]
    assert "raw" not in tables["messages"].columns


def test_bounds_and_status(table):
    leaf = "--b\r\nContent-Type: text/plain\r\n\r\nx\r\n"

    def wide(n):
        return crlf(*BASE, 'Content-Type: multipart/mixed; boundary="b"',
                    body=leaf * n + "--b--\r\n")

    deep = crlf(*BASE, "Content-Type: multipart/mixed; boundary=d0", body="".join(
        f"--d{i}\r\nContent-Type: multipart/mixed; boundary=d{i + 1}\r\n\r\n" for i in range(20)))
    tables = analyze(table({
        "ok": crlf(*BASE), "warned": crlf("Subject: x"), "wide": wide(3), "wider": wide(4),
        "deep": deep, "long": crlf(*BASE, "X: " + "y" * 3000), "big": crlf(*BASE, body="z" * 9000),
        "empty": b"",
    }), areas=(), limits=Limits(mime_parts=4, header_bytes=2000, message_bytes=8000))
    assert {r.source_path: (r.reason, r.observed, r["limit"]) for r in tables["rejects"].collect()
            } == {"wider": ("too-many-parts", 5, 4), "deep": ("too-many-parts", 5, 4),
                  "long": ("header-too-large", 3092, 2000),
                  "big": ("message-too-large", 9091, 8000)}
    assert {k: v[0] for k, v in grouped(tables["status"], "status").items()} == {
        "ok": "ok", "wide": "ok", "warned": "warnings", "empty": "warnings", "wider": "rejected",
        "deep": "rejected", "long": "rejected", "big": "rejected"}
    assert grouped(tables["warnings"], "code")["warned"] == ["missing-header"] * 2
    deep_only = analyze(table({"deep": deep}), areas=(), limits=Limits(mime_depth=16), staged=False)
    first = deep_only["rejects"].first()
    assert (first.reason, first.observed) == ("mime-too-deep", 17)
    assert analyze(table({"deep": deep}), areas=(), staged=False)["rejects"].count() == 0


def test_malformed_parts_are_warnings(table):
    raw = crlf(*BASE, 'Content-Type: multipart/mixed; boundary="never"', body="no boundary here\r\n")
    tables = analyze(table({"m": raw}))
    codes = grouped(tables["warnings"], "stage", "code")["m"]
    assert ("message", "mime-defect") in codes and ("attachments", "mime-defect") in codes


def test_areas_are_checked(table):
    with pytest.raises(ValueError):
        analyze(table({"m": crlf(*BASE)}), areas=("dns",))


# --- headers ------------------------------------------------------------------------------------


def hops_of(table, *received: str):
    raw = crlf(*[f"Received: {r}" for r in received], *BASE)
    tables = analyze(table({"m": raw}), areas=("headers",), staged=False)
    return tables, tables["hops"].orderBy("position").collect()


def test_hop_clauses(table):
    _, hops = hops_of(
        table,
        "from a.example (b [IPv6:2001:DB8::1]) by c.example ([192.168.0.9])\r\n\twith SMTP id X1;; "
        "Tue, 6 Oct 2026 10:00:00 +0000",
        "FROM [10.0.0.1] by d (envelope-from <e@f>) with id z",
        "from ([1.2.3.4]) via relay for <x@y>; never",
        "garbage",
    )
    assert [h.position for h in hops] == [0, 1, 2, 3]
    garbage, third, second, newest = hops
    assert (newest.from_host, newest.from_ip) == ("a.example", "2001:db8::1")
    assert (newest.by_host, newest.by_ip, newest.with_protocol, newest.hop_id) == (
        "c.example", "192.168.0.9", "SMTP", "X1")
    assert newest.timestamp_utc == "2026-10-06T10:00:00+00:00"
    # A keyword inside a comment opens a clause, and a keyword without a token empties its slot.
    assert (second.from_host, second.from_ip, second.with_protocol, second.hop_id) == (
        "<e@f>)", None, None, "z")
    assert (third.from_host, third.from_ip) == ("([1.2.3.4])", "1.2.3.4")
    assert third.timestamp_original == "never" and not third.timestamp_valid
    assert garbage.from_host is None and garbage.timestamp_original is None


def test_hop_observations(table):
    def at(minute, host="h ([198.51.100.7])"):
        return f"from {host} by b; Tue, 6 Oct 2026 10:{minute:02d}:00 +0000"

    cases = {
        # newest first, so the second listed is the older hop
        "reversed": (at(1), at(5)), "equal": (at(5), at(5)), "ordered": (at(5), at(1)),
        "gap": (at(1), "from h ([198.51.100.7]) by b", at(5)),
        "private": (at(1, "h ([127.0.0.1])"),), "bare": (at(1, "h"),), "none": (),
    }
    tables = analyze(table({
        k: crlf(*[f"Received: {r}" for r in v], *BASE, "X-Sender-IP: [9.9.9.9]")
        for k, v in cases.items()}), areas=("headers",))
    codes = {k: {c for c in v if c not in ("hop-count", "originating-ip-claim")}
             for k, v in grouped(tables["observations"], "code").items()}
    assert codes == {
        "reversed": {"timestamp-inversion"}, "equal": set(), "ordered": set(),
        "gap": {"missing-timestamp"}, "private": {"private-ip-hop"}, "bare": {"unverifiable-from"},
        "none": {"no-received-headers"}}
    warned = grouped(tables["warnings"], "code")
    assert warned == {"gap": ["received-no-timestamp"]}
    first = tables["observations"].where("source_path = 'none'").orderBy("seq").first()
    assert (first.code, first.basis["hops"]) == ("hop-count", "0")


def test_header_block(table):
    raw = (b"A: one\r\n\ttwo  \r\n   three\r\nno colon line\r\nB :x\xff\r\nB: later\r\nList-Id:\r\n"
           b"List-Post: <mailto:p>\r\nContent-Type: Text/HTML ; charset=x\r\nUser-Agent: \r\n"
           b"User-Agent: second\r\n\r\nList-Help: body\r\n")
    tables = analyze(table({"crlf": raw, "lf": raw.replace(b"\r\n", b"\n")}), areas=("headers",),
                     staged=False)
    for path in ("crlf", "lf"):
        rows = tables["headers"].where(f"source_path = '{path}'").orderBy("ordinal").collect()
        assert [(r.name, r.value) for r in rows][:3] == [
            ("a", "one two three"), ("b", "x�"), ("b", "later")]
        routing = tables["routing"].where(f"source_path = '{path}'").first()
        assert routing.top_content_type == "text/html"
        assert routing.user_agent is None  # an empty first value hides the second
        assert routing.list_headers == {"list-post": "<mailto:p>"}


# --- authentication -----------------------------------------------------------------------------


def test_claims(table):
    tables = analyze(table({
        "a": crlf(
            "Authentication-Results: mx.a (v;1); spf=PASS (x; (y)) smtp.mailfrom=ann@Sub.Example.org;"
            " dkim=weird header.i=@other.net header.d=none header.d=third.net; ;arc=none",
            "Authentication-Results: mx.b; spf=fail smtp.mailfrom=none",
            "DKIM-Signature: v=1; d=Example.org; d=EXAMPLE.org; h=From : To; s=; x",
            "Received-SPF: Pass; (looks (fine)) x=y", *BASE),
        "quiet": crlf(*BASE),
        "nofrom": crlf("Authentication-Results: mx; spf=pass smtp.mailfrom=x.org"),
        "junk": crlf("Authentication-Results: just words", "Received-SPF:", *BASE),
    }), areas=("authentication",))
    results = tables["auth_results"].where("source_path = 'a'").orderBy("ordinal").collect()
    assert [(r.authserv_id, r.method, r.result, r.reason, r.known_result) for r in results] == [
        ("mx.a", "spf", "pass", "x; (y)", True), ("mx.a", "dkim", "weird", None, False),
        ("mx.a", "arc", "none", None, True), ("mx.b", "spf", "fail", None, True)]
    assert results[1].properties == {"header.i": "@other.net", "header.d": "third.net"}
    signature = tables["dkim_signatures"].first()
    assert (signature.d, signature.s, signature.h, signature.other_tags) == (
        "EXAMPLE.org", None, ["from", "to"], {"v": "1"})
    spf = tables["received_spf"].first()
    assert (spf.result, spf.detail) == ("pass;", "looks (fine)")
    codes = grouped(tables["observations"], "code")
    assert set(codes["a"]) == {
        "spf-pass", "dkim-weird", "arc-none", "spf-fail", "conflicting-auth-results",
        "dkim-signature-present", "spf-alignment-relaxed-aligned", "dkim-alignment-unaligned",
        "received-spf-pass;", "spf-claim-disagreement"}
    assert codes["a"].count("dkim-alignment-unaligned") == 2  # other.net, and d= as written
    assert set(codes["quiet"]) == set(codes["junk"]) == {"no-auth-headers", "dkim-signature-absent"}
    assert "spf-alignment-unknown" in codes["nofrom"]
    assert set(grouped(tables["warnings"], "code")["junk"]) == {
        "auth-results-no-clauses", "received-spf-empty"}
    assert grouped(tables["warnings"], "code")["a"] == ["dkim-tag-no-equals"]


@pytest.mark.parametrize(("value", "domain"), [
    ("Ann <ann@Example.ORG>", "example.org"), ('"A, B" <x@y.z>', "y.z"), ("word", "word"),
    ("=?utf-8?q?x?= <a@b.c>", "b.c"), ("(comment) a@b.c", "b.c"), ("<>", None), ("", None),
])
def test_from_domain(spark, value, domain):
    from mailstrata.operators.addresses import with_from_domain

    df = spark.createDataFrame(
        [([{"name": "from", "value": value}],)],
        "fields array<struct<name:string,value:string>>")
    assert with_from_domain(df).first().from_domain == domain


# --- URLs ---------------------------------------------------------------------------------------


def html_message(*body: str) -> bytes:
    return crlf(*BASE, "Content-Type: text/html; charset=utf-8", body="\n".join(body))


def test_urls(table):
    tables = analyze(table({
        "m": html_message(
            '<a href="https://real.example/x#top">http://shown.example</a>',
            '<a href="https://same.example/">see https://same.example/ now</a>',
            '<a HREF="https://open.example/">unclosed http://inside.example',
            '<img src="http://[bad"><script>var u="https://in.script/";</script>'),
        "text": crlf(*BASE, "List-Unsubscribe:\r\n <https://list.example/u>",
                     body="https://A.example:443/p?x=1 https://a.example/p?x=1#f hxxp://d[.]example"),
        "none": crlf(*BASE),
        "file": attached("http:--x.example.txt", b"https://not.seen/"),
    }), areas=("urls",))
    urls = {(r.source_path, r.url): r for r in tables["urls"].collect()}
    assert set(urls) == {
        ("m", "https://real.example/x#top"), ("m", "http://shown.example"),
        ("m", "https://same.example/"), ("m", "https://open.example/"),
        ("m", "http://inside.example"), ("m", "https://in.script/"),
        ("text", "https://A.example:443/p?x=1"), ("text", "http://d.example"),
        ("text", "https://list.example/u")}
    same = urls["m", "https://same.example/"]
    assert [(s.kind, s.detail, s["count"]) for s in same.sources] == [
        ("html-href", "0 <a href>", 1), ("html-text", "0", 1)]
    assert [s["count"] for s in urls["text", "https://A.example:443/p?x=1"].sources] == [2]
    assert [(s.kind, s.detail) for s in urls["text", "https://list.example/u"].sources] == [
        ("header", "List-Unsubscribe")]
    shown = tables["observations"].where("code = 'display-href-mismatch'").collect()
    assert [(o.subject, o.basis["display_text"]) for o in shown] == [
        ("https://real.example/x#top", "http://shown.example")]
    codes = grouped(tables["observations"], "code")
    assert "defanged-in-source" in codes["text"] and codes["none"] == codes["file"] == ["no-urls"]
    assert grouped(tables["warnings"], "code") == {"m": ["url-unparseable"]}


def test_url_scan_bounds(table):
    many = crlf(*BASE, body=" ".join(f"http://h{i}.example" for i in range(12)))
    parts = "".join(f"--b\r\nContent-Type: text/plain\r\n\r\nhttp://p{i}.example\r\n"
                    for i in range(4))
    multi = crlf(*BASE, "Content-Type: multipart/mixed; boundary=b", body=parts + "--b--\r\n")
    long = crlf(*BASE, body="http://early.example " + "x" * 300 + " http://late.example")
    tables = analyze(table({"many": many, "multi": multi, "long": long}), areas=("urls",),
                     limits=Limits(url_candidates=10, text_parts=3, text_bytes=250))
    assert {k: len(v) for k, v in grouped(tables["urls"], "url").items()} == {
        "many": 10, "multi": 3, "long": 1}
    assert grouped(tables["warnings"], "code") == {
        "many": ["url-candidate-cap"], "multi": ["url-too-many-text-parts"],
        "long": ["url-text-truncated"]}


# --- attachments --------------------------------------------------------------------------------


def attachment_codes(table, limits=Limits(), **files):
    tables = analyze(table({k: attached(*v) for k, v in files.items()}), areas=("attachments",),
                     limits=limits)
    codes = {k: {c for c in v if c != "attachment-count"}
             for k, v in grouped(tables["observations"], "code").items()}
    return tables, codes


def test_attachment_types(table):
    _, codes = attachment_codes(
        table, Limits(oversized_bytes=50),
        pdf=("a.pdf", b"%PDF-1.7", "application/pdf"),
        double=("a.pdf.exe", b"MZ\x90", "application/octet-stream"),
        fake=("a.pdf", b"MZ\x90", "application/pdf"),
        script=("run.js", b"plain text", "application/octet-stream"),
        shebang=("x", b"#!/bin/sh", "text/x-sh"),
        empty=("a.pdf", b"", "application/pdf"),
        odd=("a.pdf", b"\x00\x01", "application/pdf"),
        big=("a.bin", b"x" * 50, "application/octet-stream"),
        docx=("a.docx", zipped(("w.xml", b"")),
              "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    )
    assert codes == {
        "pdf": set(), "double": {"double-extension", "executable-content"},
        "fake": {"extension-type-mismatch", "declared-mime-mismatch", "executable-content"},
        "script": {"extension-type-mismatch"}, "shebang": {"script-content"},
        "empty": {"empty-attachment"}, "odd": set(), "big": {"oversized-attachment"},
        "docx": {"declared-mime-mismatch", "oversized-attachment"}}


def test_attachment_bases(table):
    tables, _ = attachment_codes(table, Limits(oversized_bytes=50),
                                 fake=("it's.pdf", b"MZ\x90", "application/pdf"),
                                 big=("a.bin", b"x" * 50, "application/octet-stream"))
    got = {r.code: r.basis["text"] for r in tables["observations"].where("code <> 'attachment-count'").collect()}
    magic = " magic=MZ header (PE executable)"
    assert got == {
        "extension-type-mismatch": 'filename="it\'s.pdf"' + magic,
        "executable-content": 'filename="it\'s.pdf"' + magic,
        "declared-mime-mismatch": "mime_claim='application/pdf'" + magic,
        "oversized-attachment": "filename='a.bin' size=50"}


def test_documents_keep_the_order_of_attachments(table):
    outer = EmailMessage()
    outer["From"], outer["Date"] = "a@example.org", "Mon, 01 Jan 2024 00:00:00 +0000"
    outer.set_content("body")
    for k in range(12):
        outer.add_attachment(b"%PDF-1.7", maintype="application", subtype="pdf", filename=f"f{k}.pdf")
    tables = analyze(table({"m": outer.as_bytes()}), areas=("attachments",))
    document = json.loads(documents.message_documents(tables).first().document)
    assert [a["filename"] for a in document["attachments"]] == [f"f{k}.pdf" for k in range(12)]


@pytest.mark.parametrize("odd", [".", ")", " ", ";", "("])
def test_long_runs_inside_a_value_stay_linear(spark, odd):
    run = odd * 300_000
    frame = spark.createDataFrame([(f"https://a.example{run}x", f"X: a\r\n b{run}c\r\n")], "url string, head string")
    started = time.time()
    row = frame.select(clean_url_text(F.col("url")).alias("url"), header_fields(F.col("head")).alias("fields")).first()
    assert len(row.url) > 300_000 and len(row.fields[0]["value"]) > 300_000
    assert time.time() - started < 20


def test_many_clauses_in_one_header(table):
    clauses = "; ".join(f"dkim=pass header.d=d{k}.example" for k in range(3000))
    raw = crlf(*BASE, "Authentication-Results: mx.example; " + clauses)
    tables = analyze(table({"m": raw}), areas=("authentication",))
    assert tables["auth_results"].count() == 3000
    assert tables["observations"].where("code like 'dkim-%'").count() >= 3000


def test_containers(table):
    inner = zipped(("deep.exe", b"MZ"))
    nested = zipped(("readme.txt", b"hi"), ("inner.zip", inner))
    four = inner
    for level in range(4):
        four = zipped((f"l{level}.zip", four))
    octets = "application/octet-stream"
    tables, codes = attachment_codes(
        table, Limits(archive_entries=3),
        plain=("a.zip", zipped(("a.txt", b"1"), ("dir/b.EXE", b"2")), octets),
        locked=("a.zip", zipped(("s.zip", b"x"), locked=True), octets),
        nested=("a.zip", nested, octets), four=("a.zip", four, octets),
        many=("a.zip", zipped(*[(f"{i}.txt", b"") for i in range(5)]), octets),
        broken=("a.zip", b"PK\x03\x04 not really", octets),
        renamed=("a.zip", b"just text", octets),
        bad_inner=("a.zip", zipped(("x.zip", b"not a zip")), octets),
        macro=("a.docm", zipped(("word/vbaProject.bin", b"")), octets),
        ole=("a.doc", compound(("Macros", 1), ("_VBA_PROJECT", 2)), octets),
        clean=("a.doc", compound(("WordDocument", 2)), octets),
        cut=("a.doc", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\x00" * 20, octets),
    )
    assert codes["plain"] == {"archive-member-executable"}
    assert codes["locked"] == {"password-protected"}
    assert codes["nested"] == {"nested-archive", "archive-member-executable"}
    assert codes["four"] == {"nested-archive"}
    assert codes["macro"] == {"macro-capable-format", "vba-project-present"}
    assert codes["ole"] == {"macro-capable-format", "vba-project-present"}
    assert codes["clean"] == codes["cut"] == {"macro-capable-format"}
    assert codes["renamed"] == {"extension-type-mismatch"}
    assert grouped(tables["warnings"], "code") == {
        "four": ["archive-depth-capped"], "many": ["archive-entries-capped"],
        "broken": ["archive-unreadable"], "renamed": ["archive-unreadable"],
        "bad_inner": ["archive-unreadable"], "cut": ["ole-unreadable"]}
    entries = grouped(tables["container_entries"], "container_path", "level", "name", "size_bytes")
    assert entries["nested"] == [
        ("0", 0, "inner.zip", len(inner)), ("0", 0, "readme.txt", 2), ("0.1", 1, "deep.exe", 2)]
    assert entries["locked"] == [("0", 0, "s.zip", None)]
    assert grouped(tables["container_entries"], "entry_kind", "name")["ole"] == [
        ("storage", "Macros"), ("stream", "_VBA_PROJECT")]
    levels = grouped(tables["containers"], "level")
    assert levels["four"] == [0, 1, 2, 3] and len(levels["many"]) == 1


def test_unreadable_and_large_members(table):
    raw = bytearray(zipped(("x.zip", b"stored content")))
    at = raw.find(b"stored content")
    raw[at] ^= 0xFF  # the checksum no longer fits
    tables, _ = attachment_codes(
        table, Limits(nested_member_bytes=5),
        big=("a.zip", zipped(("x.jar", b"123456")), "application/zip"))
    assert grouped(tables["warnings"], "code") == {"big": ["archive-member-too-large"]}
    tables, _ = attachment_codes(table, bad=("a.zip", bytes(raw), "application/zip"))
    assert grouped(tables["warnings"], "code") == {"bad": ["archive-member-unreadable"]}


def test_unnamed_attachment(table):
    raw = crlf(*BASE, "Content-Type: text/plain", "Content-Disposition: attachment", body="x")
    tables = analyze(table({"m": raw}))
    assert grouped(tables["attachments"], "filename", "extension") == {
        "m": [("unnamed-attachment-0", "")]}
    assert grouped(tables["attachment_inventory"], "filename") == {"m": ["unnamed-attachment-0"]}


# --- sources, documents, streams ------------------------------------------------------------------


def test_files_and_stream(spark, tmp_path):
    from mailstrata.sources.mail import oversize_files, read_listed, read_messages
    from mailstrata.streaming.landing import message_stream, run_stream

    box = tmp_path / "box"
    (box / "sub").mkdir(parents=True)
    (box / "a.eml").write_bytes(crlf(*BASE))
    (box / "sub" / "b.eml").write_bytes(crlf(*BASE, body="z" * 5000))
    (box / "c.txt").write_bytes(b"no mail")
    limits = Limits(message_bytes=1000)
    read = read_messages(spark, str(box), limits)
    assert sorted((r.source_path.rsplit("/", 1)[-1], r.raw is None) for r in read.collect()) == [
        ("a.eml", False), ("b.eml", True)]
    tables = analyze(read, areas=("headers",), limits=limits)
    assert tables["status"].count() == 2
    assert [(r.source_path.rsplit("/", 1)[-1], r.reason) for r in tables["rejects"].collect()] == [
        ("b.eml", "message-too-large")]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,1000)" in plan
    over = oversize_files(spark, str(box), limits).collect()
    assert [(r.reason, r["limit"]) for r in over] == [("message-too-large", 1000)]
    out, state = tmp_path / "out", tmp_path / "state"
    (box / "d[1] x.eml").write_bytes(crlf(*BASE))
    stream = message_stream(spark, str(box))
    assert stream.columns == ["path", "modificationTime", "length"]  # no byte of a file is in the stream
    before = set(_staged(spark))
    run_stream(stream, str(out), str(state), areas=("headers",), limits=limits, availableNow=True).awaitTermination(120)
    assert read_published(spark, str(out), "messages").count() == 2
    assert read_published(spark, str(out), "status").count() == 3
    assert [r.reason for r in read_published(spark, str(out), "rejects").collect()] == ["message-too-large"]
    assert read_published(spark, str(out), "observations").where("code = 'hop-count'").count() == 2
    assert set(_staged(spark)) == before
    grown = spark.createDataFrame([(str(box / "sub" / "b.eml"), None, 10)], "path string, modificationTime timestamp, length long")
    again = analyze(read_listed(grown, limits), areas=(), limits=limits)["rejects"].first()
    assert (again.reason, again.observed > 5000) == ("message-too-large", True)


def _staged(spark):
    return glob.glob(os.path.join(staging_root(spark).removeprefix("file://"), "mailstrata", "*"))


def test_runs_are_published_whole_and_once(spark, tmp_path):
    root = str(tmp_path / "lake")

    def tables(n, broken=False):
        made = {"a": spark.range(n).toDF("x"), "b": spark.range(2 * n).toDF("x")}
        if broken:
            made["c"] = spark.range(1).select(F.raise_error(F.lit("lost")).alias("x"))
        return made

    with pytest.raises(Exception, match="lost"):
        publish(spark, root, "one", lambda: tables(3, broken=True))
    assert published(spark, root) == []
    assert publish(spark, root, "one", lambda: tables(3)) and publish(spark, root, "two", lambda: tables(5))
    assert not publish(spark, root, "one", lambda: tables(100))
    assert sorted(tuple(r) for r in read_published(spark, root, "a").groupBy("run").count().collect()) == [("one", 3), ("two", 5)]
    assert read_published(spark, root, "b").count() == 16
    assert len(os.listdir(os.path.join(root, "runs", "one"))) == 1


def test_documents_are_deterministic(table, tmp_path, spark):
    raw = attached("a.pdf", b"%PDF-1.7", "application/pdf")
    first, second = (
        {r.source_path: r.document for r in
         documents.message_documents(analyze(table({"m": raw, "n": crlf(*BASE)}))).collect()}
        for _ in range(2))
    assert first == second and set(first) == {"m", "n"}
    assert '"label":"pdf"' in first["m"] and '"code":"hop-count"' in first["n"]
    tables = analyze(table({"m": raw}), areas=("headers",))
    documents.write_tables(tables, str(tmp_path / "lake"), "2026-10-06")
    back = spark.read.parquet(str(tmp_path / "lake" / "messages"))
    assert back.count() == 1 and str(back.first().ingest_date) == "2026-10-06"


def test_overview(table):
    from mailstrata.operators.mime import flatten_messages

    rows = documents.overview(flatten_messages(table({
        "m": attached("a.pdf", b"%PDF-1.7"), "n": crlf("From: " + "x" * 300 + "@example.org")})))
    got = {r.source_path: r for r in rows.collect()}
    assert (got["m"].files, got["m"].parts, got["m"].attachments) == ("a.pdf", 3, 1)
    assert got["n"].date == "<missing>" and got["n"]["from"].endswith("more chars, see --json]")
    assert got["n"].first_warning == "missing-header"


# --- large messages -------------------------------------------------------------------------------


def test_header_urls_have_observations(table):
    tables = analyze(table({"m": crlf(*BASE, "List-Unsubscribe: <http://192.0.2.7/u>", body="http://b.example")}), areas=("urls",))
    codes = sorted((o.subject, o.code, o.seq) for o in tables["observations"].where("subject is not null").collect())
    assert codes == [("http://192.0.2.7/u", "http-scheme", 2 * 16 + 6), ("http://192.0.2.7/u", "ip-literal-host", 2 * 16),
                     ("http://b.example", "http-scheme", 16 + 6)]


def test_one_message_with_many_urls_spreads(spark, table):
    n = 200_000
    body = "\r\n".join(f"http://h{i % 50_000}.example/{'x' * (i % 3)}" for i in range(n))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables = analyze(table({"m": crlf(*BASE, body=body), "n": crlf(*BASE, body="http://one.example")}), areas=("urls",))
        places = tables["urls"].select("*", F.input_file_name().alias("file")).where("source_path = 'm'")
        assert places.count() == 150_000 and places.select("file").distinct().count() >= 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    first = tables["observations"].where("code = 'http-scheme'").orderBy("source_path", "seq").limit(3).collect()
    assert [(o.subject, o.seq) for o in first] == [(f"http://h{i}.example/{'x' * i}", (i + 1) * 16 + 6) for i in range(3)]
    assert [o.basis["url_count"] for o in tables["observations"].where("code = 'url-count'").orderBy("source_path").collect()] == ["150000", "1"]


def test_warnings_and_status_read_the_ledger(table):
    broken = crlf(*BASE, body="http://[bad and https://good.example and hxxp://x..y")
    tables = analyze(table({"m": broken}), areas=("urls",))
    for name in ("warnings", "status", "observations"):
        assert "MapInArrow" not in tables[name]._jdf.queryExecution().executedPlan().toString()
    assert [(w.code, w.detail) for w in tables["warnings"].collect()] == [("url-unparseable", "http://[bad")]


def test_documents_need_one_exchange(table):
    tables = analyze(table({"m": attached("a.pdf", b"%PDF-1.7"), "n": crlf(*BASE)}))
    made = documents.message_documents(tables, {"engine": "x"})
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    document = {r.source_path: json.loads(r.document) for r in made.collect()}["m"]
    assert list(document) == sorted(document) and document["provenance"] == {"engine": "x"}
    own = document["attachments_detail"]["attachments"][0]
    assert own["observation_codes"] == [o["code"] for o in own["observations"]] and own["identified"]["label"] == "pdf"


def test_document_tree(table):
    inner = EmailMessage()
    inner["From"] = "in@example.org"
    inner.set_content("inner")
    outer = EmailMessage()
    outer["From"], outer["Date"] = "a@example.org", "Mon, 01 Jan 2024 00:00:00 +0000"
    outer.set_content("plain")
    outer.add_alternative("<p>html</p>", subtype="html")
    outer.add_attachment(inner)
    outer.add_attachment(b"abc", maintype="application", subtype="x", filename='q"uote.bin')
    tree = json.loads(documents.message_documents(analyze(table({"m": outer.as_bytes()}), areas=())).first().document)["mime_tree"]

    def shape(node):
        return (node["index"], node["content_type"], [shape(c) for c in node["children"]])

    assert shape(tree) == ("0", "multipart/mixed", [
        ("0.0", "multipart/alternative", [("0.0.0", "text/plain", []), ("0.0.1", "text/html", [])]),
        ("0.1", "message/rfc822", [("0.1.0", "text/plain", [])]), ("0.2", "application/x", [])])
    assert tree["size_bytes"] == 3 + 6 + 12 + 6 and tree["children"][2]["filename"] == 'q"uote.bin'


def test_many_parts_and_levels(table):
    leaf = "--b\r\nContent-Type: text/plain\r\n\r\nxy\r\n"
    wide = crlf(*BASE, 'Content-Type: multipart/mixed; boundary="b"', body=leaf * 20_000 + "--b--\r\n")
    deep = crlf(*BASE, "Content-Type: multipart/mixed; boundary=d0", body="".join(
        f"--d{i}\r\nContent-Type: multipart/mixed; boundary=d{i + 1}\r\n\r\n" for i in range(100)))
    tables = analyze(table({"wide": wide, "deep": deep}), areas=())
    started = time.time()
    sizes = {r.source_path: (r.size_bytes, r["last"]) for r in tables["parts"].where("part_index = '0'").collect()}
    assert sizes == {"wide": (40_000, 20_000), "deep": (0, 100)} and time.time() - started < 10
    endless = crlf(*BASE, "Content-Type: multipart/mixed; boundary=d0", body="".join(
        f"--d{i}\r\nContent-Type: multipart/mixed; boundary=d{i + 1}\r\n\r\n" for i in range(3000)))
    assert analyze(table({"m": endless}), areas=())["rejects"].first().reason == "mime-too-deep"


def test_many_claims_in_one_message(spark):
    claims = [(f"m{i % 2000}", f"r{i % 3}", f"s{i % 7}") for i in range(20_000)]
    frame = spark.createDataFrame([(claims,)], "claims array<struct<method:string,result:string,authserv_id:string>>")
    got = frame.select(conflicting_methods(F.col("claims")).alias("found")).first().found
    want = {}
    for m, r, a in claims:
        want.setdefault(m, {}).setdefault(r, set()).add(a)
    assert {f.method: {k: sorted(v) for k, v in f.results.items()} for f in got} == {
        m: {r: sorted(a) for r, a in rs.items()} for m, rs in want.items() if len(rs) > 1}

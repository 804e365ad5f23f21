"""Column functions against the standard library or stated cases."""

from __future__ import annotations

import email.utils
import ipaddress
import random
import time
import urllib.parse

import pytest
from pyspark.sql import functions as F

from mailstrata import functions as fn
from mailstrata import rules
from mailstrata.functions.auth import balanced_comment, split_outside_parens
from mailstrata.functions.urls import with_url
from mailstrata.operators.networks import with_networks


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


DATES = [
    "Tue, 06 Oct 2026 10:00:00 +0000", "6 Oct 2026 10:00 -0500", "Tue, 06 Oct 26 10:00:00 EST",
    "06-Oct-26 10:00:00 GMT", "Tue Oct  6 10:00:00 +0130 2026", "Tue, 6 Oct 2026 10:00:00 -0000",
    "Tue, 6 Oct 2026 25:00:00 +0000", "Tue, 6 Oct 2026 10:00:00",
    "Tue, 6 Oct 2026 10:00:00 +0000 (UTC)", "Tue, 6 Oct 2026 10:00:00 (UTC)",
    "2026-10-06T10:00:00Z", "garbage", "", "Tue, 31 Feb 2026 10:00:00 +0000",
    "6 October 2026 10.15.20 PDT", "Tue,6 Oct 2026 10:00:00 Z", "Oct 6, 2026 10:00:00 UT",
    "Tue Oct 6 10:00:00 2026", "6 Oct 1969 10:00:00 +0000", "6 Oct 2026 10:00:60 +0000",
    "6 Oct 2026 10:00:00+0200", "6 Oct 2026 10:00:00 +9999", "6 Oct 2026 10:00:00 XYZ",
    "6 Oct 68 10:00:00 GMT", "6 Oct 69 10:00:00 GMT", "6 Oct 2026 10:00:00 +2400",
    "\tTue,  06 Oct 2026\t10:00:00   +0000  ", "Tue, 06 Oct 2026 10:00:00 0530",
    "29 Feb 2024 23:59:59 -1200", "1 Jan 2024 00:00:00 +1400",
]


def library_epoch(text):
    try:
        moment = email.utils.parsedate_to_datetime(text)
    except (TypeError, ValueError):
        return None
    return int(moment.timestamp()) if moment.tzinfo else None


def test_dates_agree_with_the_library(spark):
    assert column(spark, DATES, fn.rfc5322_epoch) == [library_epoch(d) for d in DATES]


def test_iso_text_does_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = column(spark, DATES[:2], lambda c: fn.iso_utc(fn.rfc5322_epoch(c)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == ["2026-10-06T10:00:00+00:00", "2026-10-06T15:00:00+00:00"]


ADDRESSES = [
    "1.2.3.4", "01.2.3.4", "256.1.1.1", "::", "::1", "2001:DB8::1", "2001:db8:0:0:1:0:0:1",
    "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2:3:4:5:6:7:8",
    "::ffff:1.2.3.4", "::1.2.3.4", "64:ff9b::192.0.2.1", "fe80::1%eth0", "fc00::1",
    "FD12:0:0:1::", "1:0:0:2:0:0:0:3", "0:0:1::", "12345::", "1:::2", "1.2.3", "a.b.c.d",
    "1:2:3:4:5:6:1.2.3.4", "0:0:0:0:0:ffff:102:304", "::%1", "10.1.1.1", "172.31.0.1",
    "100.64.1.1", "100.128.0.1", "febf::1", "fec0::1", "192.0.2.1", "2001:db8::", "169.254.0.9",
]


def test_ip_literals_agree_with_the_library(spark):
    def canonical(text):
        try:
            return str(ipaddress.ip_address(text))
        except ValueError:
            return None

    got = column(spark, ADDRESSES, fn.canonical_ip)
    assert got == [canonical(a) for a in ADDRESSES]
    valid = [a for a in got if a]
    nets = [ipaddress.ip_network(n) for n in rules.PRIVATE_NETWORKS]
    parsed = [ipaddress.ip_address(a) for a in valid]
    assert column(spark, valid, fn.is_private_ip) == [
        any(a.version == n.version and a in n for n in nets) for a in parsed]
    assert column(spark, valid, fn.ip_hex) == [
        f"{int(a):0{8 if a.version == 4 else 32}x}" for a in parsed]
    assert column(spark, [None], fn.is_private_ip) == [False]


URLS = [
    "http://a.b.c/x?y=1&z=&y=2#f", "https://user:pw@Host.EXAMPLE.com.:8443/p;a?q=a+b%20c%zz",
    "http://[2001:db8::1]:80/x", "http://[bad", "http://host:abc/", "http://host:70000/",
    "http://h:/x", "http://1.2.3.4", "http://:80/", "http://@host", "http://u@@host/?a=*~&b=é",
    "https://a..b/", "HTTP://EXAMPLE.com?x#y?z", "http://e.com/a?x=%ff&=b&c", "mailto:x",
    "http://host]/", "http://v1.x[v1.x]/", "http://exa℀mple.com/", "http://:pw@h/", "http://h:080/",
    "http://h:443/", "https://h:443/a", "http://[1.2.3.4]/", "http://a_b.c/", "http://h?&&a=1&",
]


def library_url(text):
    try:
        parts = urllib.parse.urlsplit(text)
    except ValueError:
        return None
    host = (parts.hostname or "").lower().rstrip(".")
    if parts.scheme not in ("http", "https") or not host:
        return None
    try:
        port, invalid = parts.port, False
    except ValueError:
        port, invalid = None, True
    params = urllib.parse.parse_qsl(parts.query, keep_blank_values=True)
    return (parts.scheme, host, port, parts.path, params, parts.fragment, invalid)


def test_url_parts_agree_with_the_library(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "raw string")
    rows = with_url(df, "raw").withColumn("single", fn.url_struct(F.col("raw"))).withColumn(
        "key", fn.url_dedup_key(F.col("raw"))).collect()
    for row in rows:
        u = row.u
        got = (u.scheme, u.host, u.port, u.path, [tuple(p) for p in u.query_params], u.fragment,
               u.invalid_port) if u.valid else None
        assert got == library_url(row.raw), row.raw
        assert row.single == u
        assert row.key == (u.url_key if u.valid else None)


@pytest.mark.parametrize(("url", "key"), [
    ("HTTP://Example.com:80/a#frag", "http://example.com/a"),
    ("https://example.com:443", "https://example.com"),
    ("https://example.com/", "https://example.com/"),
    ("https://u:p@example.com:8443/?b=1&a=x y*~", "https://example.com:8443/?b=1&a=x+y%2A~"),
    ("hxxps[:]//bad[.]example/%7e", "https://bad.example/%7e"),
])
def test_url_identity(spark, url, key):
    assert column(spark, [url], fn.url_dedup_key) == [key]


@pytest.mark.parametrize(("text", "kept"), [
    ("http://a.b/c.", "http://a.b/c"), ("http://a.b/c!?.", "http://a.b/c"),
    ("http://a.b/c).", "http://a.b/c"), ("http://a.b/x_(y)", "http://a.b/x_(y)"),
    ("http://a.b/x_(y))", "http://a.b/x_(y)"), ("http://a.b/c.)", "http://a.b/c."),
    ("http://a.b/c]}", "http://a.b/c"), ("http://a.b/([c)]", "http://a.b/([c)]"),
    ("http://a.b/c'", "http://a.b/c"), ("http://[::1]", "http://[::1]"), ("..", ""),
])
def test_trailing_punctuation(spark, text, kept):
    assert column(spark, [text], fn.clean_url_text) == [kept]


def test_long_closing_run_is_cut_in_one_step(spark):
    text = "http://a.b/(" + ")" * 20000
    assert column(spark, [text], fn.clean_url_text) == ["http://a.b/()"]


def test_defanging(spark):
    cases = ["https://a.b/c.d", "HTTP://a.b", "hxxp://a[.]b", "ftp://a.b"]
    assert column(spark, cases, fn.defang_url) == [
        "hxxps://a[.]b/c[.]d", "hxxp://a[.]b", "hxxp://a[.]b", "ftp://a[.]b"]
    assert column(spark, ["hxxps[:]//a[.]b", "HXXP://a", "see hxxp://a"], fn.undefang_url) == [
        "https://a.b", "http://a", "see hxxp://a"]
    assert column(spark, ["x[.]y", "HxXp", "plain"], fn.looks_defanged) == [True, True, False]
    assert column(spark, ["at http://a.b/c and HTTPS://X.y. end."], fn.defang_text) == [
        "at hxxp://a[.]b/c and HTTPS://X[.]y[.] end."]


def test_url_spellings_use_unicode_space(spark):
    text = "a http://x.y/1\u00a0b hxxps[:]//z[.]w/2\x1cc https//no <http://q.r/>"
    assert column(spark, [text], fn.url_spellings) == [
        ["http://x.y/1", "hxxps[:]//z[.]w/2", "http://q.r/"]]


def test_truncation(spark):
    assert column(spark, ["abcdef", "abc"], lambda c: fn.truncate_display(c, 3)) == [
        "abc… [3 more chars, see --json]", "abc"]


@pytest.mark.parametrize(("text", "pieces"), [
    ("a;b", ["a", "b"]), ("a (x;y);b", ["a (x;y)", "b"]), ("a ((x;) y;);b;", ["a ((x;) y;)", "b", ""]),
    ("a);b(;c", ["a)", "b(;c"]), ("", [""]),
])
def test_split_outside_parens(spark, text, pieces):
    assert column(spark, [text], fn.split_outside_parens) == [pieces]


@pytest.mark.parametrize(("text", "rest", "comment", "balanced"), [
    ("pass (ok) x=1", "pass   x=1", "ok", True), ("pass ((a) b) (c)", "pass   (c)", "(a) b", True),
    ("fail (open x=1", "fail", "open x=1", False), ("none", "none", None, True),
    ("a () b", "a   b", None, True),
])
def test_balanced_comment(spark, text, rest, comment, balanced):
    got = column(spark, [text], fn.balanced_comment)[0]
    assert (got.rest, got.comment, got.balanced) == (rest, comment, balanced)


def test_domains(spark):
    cases = [" User@Mail.Example.COM. ", "@x.org", "plain", "a@b@c.d", "", "@", None]
    assert column(spark, cases, fn.domain_of) == [
        "mail.example.com", "x.org", "plain", "c.d", None, None, None]
    assert column(spark, ["a.b.c", "b.c", "c", None], fn.org_domain) == ["b.c", "b.c", "c", None]


def test_extension_chain(spark):
    cases = ["a.PDF.exe", "dir.x/b", "c:\\d\\e.tar.gz", "f.", "none", ".hidden", "a..b"]
    assert column(spark, cases, fn.extension_chain) == [
        ["pdf", "exe"], [], ["tar", "gz"], [], [], ["hidden"], ["b"]]


def test_identification(spark):
    cases = [
        (b"", "empty"), (b"  \n<HTML><p>", "html"), (b"<!DOCTYPE html>", "html"),
        (b"hello\r\nworld\t!", "text"), ("größe".encode(), "text"), (b"gr\xf6\xdfe", "text"),
        (b"a\x00b", "unknown"), (b"\x01\x02\x03abc", "unknown"), (b"BMP is text too", "bmp"),
        (b"MZ text", "windows-pe"),
    ] + [(magic + b"\x00rest", label) for magic, _, label, _ in rules.MAGIC_TABLE]
    df = spark.createDataFrame([(i, bytearray(raw)) for i, (raw, _) in enumerate(cases)],
                               "i int, raw binary")
    got = df.orderBy("i").select(fn.identify_bytes(F.col("raw"))["label"]).collect()
    assert [r[0] for r in got] == [label for _, label in cases]


def test_evidence_id(spark):
    sha = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    df = spark.createDataFrame([(bytearray(b"abc"),)], "raw binary")
    got = df.select(fn.sha256_hex(F.col("raw")), fn.evidence_id(fn.sha256_hex(F.col("raw"))))
    assert tuple(got.first()) == (sha, "PS-MSG-BA7816BF8F01")


def _by_hand(value):
    """(segments outside parentheses, (rest, comment, balanced)) of a value."""
    out, current, depth = [], "", 0
    for ch in value:
        depth = depth + 1 if ch == "(" else max(0, depth - 1) if ch == ")" else depth
        if ch == ";" and not depth:
            out.append(current)
            current = ""
        else:
            current += ch
    at, level = value.find("("), 0
    if at < 0:
        return [*out, current], (value, None, True)
    for end in range(at, len(value)):
        level += (value[end] == "(") - (value[end] == ")")
        if not level:
            return [*out, current], ((value[:at] + " " + value[end + 1:]).strip(), value[at + 1:end].strip() or None, True)
    return [*out, current], (value[:at].strip(), value[at + 1:].strip() or None, False)


def test_depth_scans_agree_with_a_loop(spark):
    rng = random.Random(1)
    values = ["".join(rng.choice("((());;; ab") for _ in range(rng.randint(0, 25))) for _ in range(2000)] + ["a\x01(;)\x01;b"]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    for row in frame.select("v", split_outside_parens(F.col("v")).alias("s"), balanced_comment(F.col("v")).alias("b")).collect():
        assert (row.s, tuple(row.b)) == _by_hand(row.v)


@pytest.mark.parametrize("value", ["(" * 250_000 + ")" * 250_000, "();" * 150_000, ")(;" * 150_000, "a;(" + ";" * 500_000])
def test_depth_scans_are_linear(spark, value):
    frame = spark.createDataFrame([(value,)], "v string")
    started = time.time()
    row = frame.select(split_outside_parens(F.col("v")).alias("s"), balanced_comment(F.col("v")).alias("b")).first()
    assert (row.s, tuple(row.b)) == _by_hand(value) and time.time() - started < 15


def test_networks_agree_with_the_library(spark):
    rng = random.Random(4)
    nets = {ipaddress.ip_network((rng.getrandbits(32), rng.randint(0, 32)), strict=False) for _ in range(3000)}
    nets |= {ipaddress.ip_network((rng.getrandbits(128), rng.randint(0, 128)), strict=False) for _ in range(300)}
    known = list(nets)
    ips = [ipaddress.ip_address(rng.getrandbits(32)) for _ in range(200)]
    ips += [known[k].network_address for k in range(200)] + [ipaddress.ip_address(rng.getrandbits(128)) for _ in range(50)]
    width = {4: 8, 6: 32}
    table = spark.createDataFrame([(str(n), n.version, f"{int(n.network_address):0{width[n.version]}x}") for n in nets],
                                  "network string, version int, lo string")
    asked = spark.createDataFrame([(k, i.version, f"{int(i):0{width[i.version]}x}") for k, i in enumerate(ips)] + [(-1, None, None)],
                                  "k int, ip_version int, ip_hex string")
    made = with_networks(asked, table)
    assert "NestedLoop" not in made._jdf.queryExecution().executedPlan().toString()
    got = {r.k: r.networks for r in made.collect()}
    assert got.pop(-1) == []
    assert got == {k: sorted(str(n) for n in nets if n.version == i.version and i in n) for k, i in enumerate(ips)}


def test_usual_dates_are_read_as_the_rewritten_ones(spark):
    from mailstrata.functions import dates

    shown = ["Mon, 01 Jan 2024 10:00:00 +0100", "Xyz, 31 Dec 1999 23:59:59 -2359", "Tue, 30 Feb 2024 10:00:00 +0000",
             "Tue, 29 Feb 2000 00:00:00 -0000", "Tue, 00 Mar 2024 00:00:00 +0000", "Mon, 01 Jan 2024 24:00:00 +0000",
             "Mon, 01 Jan 2024 10:00:00 +2400", "Mon, 01 May 2999 10:00:00 -0530", "Mon, 01 jan 2024 10:00:00 EST"]
    df = spark.createDataFrame([(s,) for s in shown], "s string")
    usual = df.select("s", dates.rfc5322_epoch(F.col("s")).alias("a"), dates._rewritten_epoch(F.col("s")).alias("b")).collect()
    assert [r.a for r in usual] == [r.b for r in usual]
    assert sum(df.select(F.col("s").rlike(dates._USUAL).cast("int")).toPandas().iloc[:, 0]) == 5


def test_last_clause_of_a_kind_is_read_from_the_end(spark):
    from mailstrata.operators import received

    shown = ["from a by b with C id d", "from a (from x by y) by z", "by b FROM  a\nwith from", "frombya by", "", "x" * 100_000,
             "wıth q id r; by (with) s", "from by"]
    clause = rf"(?isU){received._KEYWORD}.*?(?={received._KEYWORD}|\z)"
    df = spark.createDataFrame([(s,) for s in shown], "clauses string")
    for name in ("from", "by", "with", "id"):
        old = F.try_element_at(F.filter(F.regexp_extract_all("clauses", F.lit(clause), F.lit(0)),
                                        lambda s: s.rlike(rf"(?iU)^{name}\b")), F.lit(-1))
        rows = df.select(received._segment(name).alias("a"),
                         F.coalesce(F.substring(old, len(name) + 1, 2**31 - 1), F.lit("")).alias("b")).collect()
        assert [r.a for r in rows] == [r.b for r in rows]

"""Message corpora rendered from driver tables by expressions.

The tables hold no mail, so each corpus writes messages whose content follows from table columns by
integer arithmetic. What the analysis should find is then known from the same columns, without
parsing anything. Rows are rendered in place (one message per row), except for the relay corpus,
whose message key bounds its group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailstrata.functions.common import pinned
from mailstrata.session import spread, tasks_for
from mailstrata.sources.mail import from_table

# Events of one user within one block of this many consecutive event ids share a message, so a
# message has at most this many hops whatever the share of its user.
HOP_BLOCK = 4096

PAYLOAD_HEX = (
    "4D5A900003000000",  # 0 PE
    "7F454C4602010100",  # 1 ELF
    "255044462D312E37",  # 2 PDF
    "D0CF11E0A1B11AE1",  # 3 OLE signature without a directory
    # 4 ZIP with the members readme.txt and tool.exe, both without content
    "504B0304140000000000000021000000000000000000000000000A000000" "726561646D652E747874"
    "504B03041400000000000000210000000000000000000000000008000000" "746F6F6C2E657865"
    "504B01021403140000000000000021000000000000000000000000000A0000000000000000000000800100000000"
    "726561646D652E747874"
    "504B0102140314000000000000002100000000000000000000000000080000000000000000000000800128000000"
    "746F6F6C2E657865"
    "504B050600000000020002006E0000004E0000000000",
    "1F8B0800000000000003",  # 5 gzip
    "526172211A070000",  # 6 RAR
    "89504E470D0A1A0A",  # 7 PNG
    "FFD8FFE000104A46",  # 8 JPEG
    "474946383961",  # 9 GIF
    "3C68746D6C3E3C2F68746D6C3E",  # 10 HTML
    "706C61696E20746578742C20686572652E",  # 11 text
    "0001020304050607",  # 12 unknown
    "",  # 13 empty
)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df.select(*columns) if columns else df)


def lines(*parts: Column | str) -> Column:
    """CRLF-joined lines; a NULL line is left out."""
    return F.concat_ws("\r\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def text(*parts: Column | str | int) -> Column:
    return F.concat(*[
        (p if isinstance(p, Column) else F.lit(str(p))).cast("string") for p in parts])


def _messages(rows: DataFrame, path: Column, body: Column) -> DataFrame:
    """Rendered once: what follows refers to the text, not to the expression that writes it."""
    named = pinned(rows, rows.columns, body.cast("binary"), "raw")
    return from_table(named.select(path.alias("source_path"), "raw"))


def mail_time(ts: Column) -> Column:
    """RFC 5322 text of a TIMESTAMP_NTZ read as UTC."""
    return F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))


def chain_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relay corpus from ``events``: one hop per event, newest first."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    eid, uid = F.col("event_id"), F.col("user_id")
    # Dealt by message before anything is rendered: the one exchange, with as many tasks as the rows need.
    e = e.withColumn("block", F.floor(eid / HOP_BLOCK).cast("bigint")).repartition(
        tasks_for(e), "user_id", "block")
    hop_ts = F.date_trunc("second", F.col("ts")).cast("timestamp_ntz") + F.make_dt_interval(
        secs=((eid * 37) % 7200 - 3600).cast("decimal(18,6)"))
    host = text("h", eid % 97, ".example.com")
    kind = F.col("event_type")
    sender = (
        F.when(kind == "signup", text(host, " ([10.0.", uid % 256, ".", eid % 256, "])"))
        .when(kind == "view", text(host, " ([IPv6:2001:DB8:0:0:0:0:0:",
                                   F.lower(F.hex(eid % 65535 + 1)), "])"))
        .when(kind == "purchase", text(host, " ([203.0.113.", eid % 256, "])"))
        .otherwise(host))
    stamp = F.when(kind != "error", text("; ", mail_time(hop_ts)))
    line = text("Received: from ", sender, " by mx", eid % 7, ".example.net\r\n\twith ESMTPS id q",
                eid, F.coalesce(stamp, F.lit("")))
    hops = e.select(uid, "block", eid, line.alias("line"))
    chains = hops.groupBy("user_id", "block").agg(
        F.max("event_id").alias("last_id"),
        F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("event_id", "line")), asc=False),
            lambda x: x["line"]), "\r\n").alias("received"))
    body = lines(
        F.col("received"),
        text("Return-Path: <bounce-", uid, "@example.org>"),
        text("From: User ", uid, " <u", uid, "@example.org>"),
        "To: one@example.com, Two Words <two@example.com>",
        text("Subject: chain ", uid, "-", F.col("block")),
        text("Message-ID: <m", uid, ".", F.col("block"), "@example.org>"),
        F.when(uid % 11 != 0, text("Date: Tue, 02 Jan 2024 ", F.lpad((uid % 24).cast("string"), 2, "0"),
                                   ":15:00 ", F.when(uid % 2 == 0, "+0200").otherwise("EST"))),
        F.when(uid % 3 == 0, text("X-Originating-IP: [198.51.100.", uid % 256, "]")),
        F.when(uid % 5 == 0, text("List-Id: <list", uid % 10, ".example.org>")),
        F.when(uid % 7 == 0, F.lit("X-Mailer: Sample\r\n Mailer")),
        "MIME-Version: 1.0", "Content-Type: Text/Plain; charset=utf-8", "", "body", "")
    path = text("m1/", uid, "/", F.col("block"), ".eml")
    return _messages(chains, path, body)


def auth_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authentication corpus from ``orders``: one message per order."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    k = F.col("o_orderkey")
    domain = text("c", F.col("o_custkey") % 50, ".example.net")
    envelope = F.when(k % 3 == 0, domain).when(k % 3 == 1, text("mail.", domain)).otherwise(
        "relay.example.org")
    spf = F.element_at(F.array(*map(F.lit, ("pass", "fail", "softfail", "none", "neutral"))),
                       F.left("o_orderpriority", F.lit(1)).cast("int"))
    signed = k % 5 < 2
    silent = k % 17 == 0
    reason = F.when(k % 7 == 0, F.lit(" (a;b (c))")).otherwise("")
    first = text(
        "Authentication-Results: mx.example.com;\r\n spf=", spf, reason, " smtp.mailfrom=bounce@",
        envelope, ";\r\n\tdkim=", F.when(signed, "pass").otherwise("none"), " header.d=",
        F.when(signed, domain).otherwise("none"), "; dmarc=", F.when(spf == "pass", "pass")
        .otherwise("fail"), " header.from=", domain)
    second = text("Authentication-Results: gw.example.org; spf=fail smtp.mailfrom=@",
                  F.upper(envelope), ".")
    signature = text(
        "DKIM-Signature: v=1; a=rsa-sha256; c=relaxed/relaxed; d=", domain, "; s=sel", k % 4,
        ";\r\n h=From:To: Subject; bh=Ym9keQ==; b=c2ln", k, "; s=sel", k % 4, "b")
    rspf = text("Received-SPF: ", F.when(F.col("o_orderstatus") == "F", "Fail")
                .when(F.col("o_orderstatus") == "O", "pass").otherwise("neutral"),
                " (mx.example.com: order ", k, " (checked)) client-ip=192.0.2.1;")
    def noisy(n: int) -> Column:
        return F.when(~silent & (k % 19 == n), F.lit({
            1: "Authentication-Results: lonely.example",
            2: "Authentication-Results: mx.bad.example; justwords; b@d=pass; spf= ;",
            3: "DKIM-Signature: nothing here; =x; a=b",
            4: "DKIM-Signature: ;;",
            5: "Received-SPF: ",
            6: "Received-SPF: (never closed",
        }[n]))
    body = lines(
        F.when(~silent, first), F.when(~silent & (k % 4 == 0), second),
        F.when(~silent & signed, signature), F.when(~silent, rspf),
        *[noisy(n) for n in range(1, 7)],
        text("From: Billing <billing@", domain, ">"), "To: you@example.com",
        text("Subject: order ", k), "", "body", "")
    return _messages(o, text("m2/", k, ".eml"), body)


def url_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL corpus from ``pages``: one multipart message per page."""
    p = table(spark, sf_dir, "pages", "page_id", "url")
    k, url = F.col("page_id"), F.col("url")
    defanged = F.replace(F.regexp_replace(url, "^http", "hxxp"), F.lit("."), F.lit("[.]"))
    plain = lines(
        text("See ", url, " and again (", url, ")."),
        F.when(k % 2 == 0, text("shared as ", defanged)),
        F.when(k % 3 == 0, text("http://192.0.2.", k % 256, ":8080/x")),
        F.when(k % 5 == 0, text("https://bit.ly/", k, ",")),
        F.when(k % 7 == 0, text("https://a.b.c.d.example.com/", k)),
        F.when(k % 11 == 0, text("http://user:pw@xn--bcher-kva.example:99999/",
                                 k, "?a=1&b=2&c=&d=x+y&e=%2F&e=z")),
        F.when(k % 13 == 0, F.lit("https://[bad")))
    html = text("<html><body><a href=\"", url, "\">",
                F.when(k % 2 == 0, url).otherwise(text("https://www.shown.example/", k)),
                "</a> <img src=\"https://img.example.net/p.png\"> <a href=\"/local\">x</a></body>"
                "</html>")
    body = lines(
        "From: a@example.org", "To: b@example.org", text("Subject: page ", k),
        "Date: Mon, 01 Jan 2024 00:00:00 +0000",
        text("List-Unsubscribe: <http", F.when(k % 4 == 0, "").otherwise("s"), "://lists.example.org/u?id=", k, ">"),
        "MIME-Version: 1.0", 'Content-Type: multipart/alternative; boundary="cut"', "",
        "--cut", "Content-Type: text/plain; charset=utf-8", "", plain,
        "--cut", "Content-Type: text/html; charset=utf-8", "", html, "--cut--", "")
    return _messages(p, text("m3/", k, ".eml"), body)


def attachment_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachment corpus from ``part``: one attachment per message, in a nested multipart."""
    t = table(spark, sf_dir, "part", "p_partkey", "p_size")
    k = F.col("p_partkey")
    payload = F.unhex(F.element_at(F.array(*map(F.lit, PAYLOAD_HEX)), (k % 14 + 1).cast("int")))
    name = text("f", k, F.element_at(
        F.array(*map(F.lit, (".pdf", ".pdf.EXE", ".docm", ".png", ".txt", ""))),
        (F.col("p_size") % 6 + 1).cast("int")))
    mime = F.element_at(F.array(*map(F.lit, (
        "application/octet-stream", "application/pdf", "text/plain", "image/png"))),
        (k % 4 + 1).cast("int"))
    body = lines(
        "From: =?utf-8?q?J=C3=BCrgen?= <a@example.org>",
        text("To: part", k, "@example.com"),
        text("Subject: =?utf-8?b?", F.base64(F.encode(text("Teil ", k, " ü"), "UTF-8")), "?="),
        F.when(k % 3 != 0, F.lit("Date: Mon, 01 Jan 2024 10:00:00 +0100")),
        "MIME-Version: 1.0", 'Content-Type: multipart/mixed; boundary="outer"', "",
        "--outer", 'Content-Type: multipart/alternative; boundary="inner"', "",
        "--inner", "Content-Type: text/plain", "", text("part ", k),
        "--inner--",
        "--outer", text("Content-Type: ", mime), "Content-Transfer-Encoding: base64",
        F.when(F.col("p_size") % 10 == 0, F.lit("Content-Disposition: attachment")).otherwise(
            text('Content-Disposition: attachment; filename="', name, '"')),
        "", F.base64(payload), "--outer--", "")
    return _messages(t, text("m4/", k, ".eml"), body)


def bounds_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bound corpus from ``customer``: mostly small messages, some over one bound."""
    c = table(spark, sf_dir, "customer", "c_custkey")
    k = F.col("c_custkey")
    leaf = "--wide\r\nContent-Type: text/plain\r\n\r\nx\r\n"
    leaves = F.when(k % 100 == 1, 250).when(k % 100 == 2, 199).otherwise(2)
    wide = F.concat(F.lit('Content-Type: multipart/mixed; boundary="wide"\r\n\r\n'),
                    F.repeat(F.lit(leaf), leaves), F.lit("--wide--\r\n"))
    depth = F.when(k % 100 == 3, 17).otherwise(16)
    levels = F.transform(F.sequence(F.lit(0), depth - 1), lambda i: text(
        'Content-Type: multipart/mixed; boundary="d', i, 'x"\r\n\r\n--d', i, "x\r\n"))
    deep = F.concat(F.array_join(levels, ""), F.lit("Content-Type: text/plain\r\n\r\nx\r\n"))
    long_header = F.when(k % 500 == 5, F.concat(
        F.lit("X-Long: "), F.repeat(F.lit("y"), 1_100_000), F.lit("\r\n"))).otherwise("")
    body = F.concat(
        F.lit("From: a@example.org\r\nDate: Mon, 01 Jan 2024 00:00:00 +0000\r\n"),
        long_header, F.lit("MIME-Version: 1.0\r\n"),
        F.when((k % 100 == 3) | (k % 100 == 4), deep).otherwise(wide))
    return _messages(c, text("m5/", k, ".eml"), body)

"""Work in one task does not grow with a table."""

from __future__ import annotations

import base64
import email.message
import email.policy
import io
import json
import zipfile

from pyspark.sql import functions as F

from mailstrata import session
from mailstrata.limits import Limits
from mailstrata.operators import auth, headers, mime, received
from mailstrata.plans import analysis, documents
from mailstrata.sources import arrow_stage, corpora
from mailstrata.sources.mail import fingerprint


def events(spark, folder, n):
    spark.range(n).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 7).alias("user_id"), F.lit("view").alias("event_type"),
    ).coalesce(1).write.parquet(f"{folder}/events.parquet")


def test_tasks_follow_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100, raising=False)
    spark.range(2000).selectExpr("id as o_orderkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    dealt = corpora.table(spark, str(tmp_path), "orders")
    assert dealt.rdd.getNumPartitions() == 20
    assert sorted(r[0] for r in dealt.collect()) == list(range(2000))


def test_relay_corpus_is_dealt_once_by_message(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100, raising=False)
    events(spark, tmp_path, 2000)
    messages = corpora.chain_messages(spark, str(tmp_path))
    assert messages.rdd.getNumPartitions() == 20
    assert messages.count() == 7


MESSAGES = {
    "none": b"From: a@example.org\r\nSubject: x\r\n\r\nbody",
    "bad": b"Authentication-Results: mx.example; justwords; b@d=pass\r\nDKIM-Signature: ;;\r\nReceived-SPF: (open\r\n\r\nbody",
    "spf": b"Received-SPF: pass\r\nReceived: from a ([10.0.0.1]) by b; never\r\n\r\nbody",
    "dkim": b"DKIM-Signature: d=example.org; s=x\r\nX-Sender-IP: 192.0.2.1\r\n\r\nbody",
    "ar": b"Received-SPF: \r\nAuthentication-Results: mx.example; spf=pass\r\nReceived: from a by b\r\n\r\nbody",
}


def test_absent_claims_alone_equal_those_of_the_whole_area(table):
    fields = headers.with_fields(fingerprint(table(MESSAGES)))
    whole = auth.auth_observations(fields).where("code = 'no-auth-headers'")
    alone = auth.auth_observations(fields, ("absent",))
    assert sorted(map(str, alone.collect())) == sorted(map(str, whole.collect()))
    assert sorted(r.source_path for r in alone.collect()) == ["bad", "none"]
    assert auth._absent(fields).columns == whole.columns


def test_chosen_header_codes_equal_those_of_the_whole_area(table):
    fields = headers.with_fields(fingerprint(table(MESSAGES)))
    whole = received.header_observations(fields)
    for codes in (("hop-count", "no-received-headers"), ("originating-ip-claim",), ("missing-timestamp",), ("private-ip-hop",)):
        want = whole.where(F.col("code").isin(*codes))
        assert sorted(map(str, received.header_observations(fields, codes).collect())) == sorted(map(str, want.collect()))
        assert want.count()


def test_structure_alone_carries_nothing_of_the_head(table):
    parsed = mime.flatten_messages(table(MESSAGES), with_head=False)
    whole = mime.flatten_messages(table(MESSAGES))
    assert parsed.columns == whole.columns and parsed.schema == whole.schema
    assert {(r.fields, r.addresses, r.subject) for r in parsed.collect()} == {(None, None, None)}
    assert sorted(map(str, mime.message_warnings(parsed).collect())) == sorted(map(str, mime.message_warnings(whole).collect()))


def test_encoded_subjects_equal_the_header_parser():
    texts = ["Teil 1 ü", "", " a  b ", "x\r\ny", "日本 語", "=?utf-8?b?eA==?=", "tab\there", "nul\x00"]
    values = [f"=?{c}?{e}?{base64.b64encode(t.encode()).decode()}?=" for t in texts for c in ("utf-8", "UTF-8") for e in "bB"]
    for value in [*values, "=?utf-8?b?eA=?=", "=?utf-8?b?/w==?=", "=?utf-8?b?eA==?= =?utf-8?b?eA==?=", "=?nope?b?eA==?="]:
        slow = str(email.policy.default.header_fetch_parse("subject", value)).strip()
        assert mime._decoded.__wrapped__("subject", value) == (mime._text(slow) or None), value
    assert mime._ENCODED.match(values[0])


def test_counted_codes_equal_the_counted_observations(table, spark):
    fields = headers.with_fields(fingerprint(table(MESSAGES)))
    for area, rows in ((received.header_code_counts, received.header_observations(fields)),
                       (auth.auth_code_counts, auth.auth_observations(fields))):
        made = area(fields)
        want = analysis.observation_rollup(rows)
        got = analysis.observation_rollup(rows.limit(0), made)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # Claims are counted where they are: nothing is moved by message.
    plan = auth.auth_code_counts(fields)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_status_of_the_header_area_needs_no_staging(table, monkeypatch):
    bounds = Limits(header_bytes=400, mime_parts=3)
    many = b"\r\nContent-Type: multipart/mixed; boundary=x\r\n\r\n" + b"--x\r\n\r\na\r\n" * 4 + b"--x--\r\n"
    messages = table({**MESSAGES, "hops": b"Date: x\r\nFrom: a@b\r\nReceived: from a; x\r\nReceived: y\r\n\r\n",
                      "fine": b"Date: x\r\nFrom: a@b\r\n\r\n", "long": b"X: " + b"y" * 500 + b"\r\n\r\n",
                      "many": b"Received: y" + many})
    want = analysis.analyze(messages, ("headers",), bounds)["status"].collect()
    monkeypatch.setattr(analysis, "stage", None)
    got = analysis.header_status(messages, bounds).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert {r.status for r in got} == {"ok", "warnings", "rejected"}


def test_results_of_an_arrow_stage_are_written_by_few_rows(spark):
    class Made(dict):
        alive = 0

        def __init__(self, **values):
            super().__init__(**values)
            Made.alive += 1

        def __del__(self):
            Made.alive -= 1

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        df = spark.range(0, 2000, 1, 1).selectExpr("cast(id as string) as s")
        rows = arrow_stage.arrow_stage(df, "s", "made", "struct<alive:int>", lambda s: Made(alive=Made.alive), keep_source=True).collect()
    finally:
        spark.conf.set(key, usual)
    assert [r.s for r in rows] == [str(i) for i in range(2000)]
    assert max(r.made.alive for r in rows) <= 2 * 256


def zipped(*names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as made:
        for name in names:
            made.writestr(name, b"x")
    return out.getvalue()


def test_documents_move_one_row_per_table_row_to_tasks_by_messages(table, monkeypatch):
    mail = email.message.EmailMessage()
    mail["From"] = "a@example.org"
    mail.set_content("http://a.example and http://b.example and http://[bad")
    for k, names in enumerate((["a.txt", "b.exe"], [], ["c.txt"])):
        mail.add_attachment(zipped(*names), maintype="application", subtype="zip", filename=f"f{k}.zip")
    tables = analysis.analyze(table({**MESSAGES, "zips": mail.as_bytes()}))
    shown = [t for t in tables if t not in ("rejects", "addresses", "headers", "status")]
    assert documents.document_items(tables).count() == sum(tables[t].count() for t in shown)
    monkeypatch.setattr(session, "TASK_ROWS", 1)
    made = documents.message_documents(tables)
    assert made.rdd.getNumPartitions() == 6
    texts = {r.source_path: json.loads(r.document) for r in made.collect()}
    assert set(texts) == {*MESSAGES, "zips"} and texts["zips"]["urls"]["url_count"] == 2
    records = texts["zips"]["attachments_detail"]["attachments"]
    assert [(r["filename"], [e["name"] for e in r["container_entries"]], len(r["containers"])) for r in records] == [
        ("f0.zip", ["a.txt", "b.exe"], 1), ("f1.zip", [], 1), ("f2.zip", ["c.txt"], 1)]
    assert all(r["observation_codes"] == [o["code"] for o in r["observations"]] for r in records)

"""MIME flattening: one Arrow stage turns raw bytes into nested columns of the same row.

The grammar of RFC 5322/2045/2047 is a per-message codec and stays with the standard library. The
stage parses each message once and returns structure: parts, addresses, decoded texts, warnings and a
possible reject. Everything after it is ordinary column work on the message row.
"""

from __future__ import annotations

import binascii
import email
import email.policy
import email.utils
import functools
import hashlib
import re
from email.message import Message
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailstrata import rules
from mailstrata.functions.common import null_if_empty, rows_of
from mailstrata.limits import Limits
from mailstrata.operators.addresses import PLAIN_ADDRESS
from mailstrata.operators.headers import header_fields
from mailstrata.sources.arrow_stage import arrow_stage
from mailstrata.sources.mail import REJECT_TYPE, fingerprint

ADDRESS_TYPE = "struct<role:string,ordinal:int,display_name:string,addr:string,raw:string>"
PART_TYPE = (
    "struct<part_index:string,parent_index:string,depth:int,ordinal:int,content_type:string,"
    "is_container:boolean,filename:string,filename_compat:string,disposition:string,"
    "size_bytes:bigint,sha256:string,is_attachment:boolean,last:int,before:bigint>"
)
#: Fields of a part that tables show; ``last`` is the ordinal of the last part of its subtree.
PART_FIELDS = ("part_index", "parent_index", "depth", "ordinal", "content_type", "is_container", "filename",
               "filename_compat", "disposition", "size_bytes", "sha256", "is_attachment", "last")
# Bodies live beside the structure, so reading the structure never reads them.
TEXT_TYPE = "struct<ordinal:int,part_index:string,content_type:string,text:string>"
CARRIED_TYPE = (
    "struct<ordinal:int,part_index:string,filename:string,content_disposition:string,"
    "mime_claim:string,size_bytes:bigint,payload:binary>"
)
WARNINGS = "warnings:array<struct<stage:string,seq:bigint,code:string,detail:string,part:string>>"
PARSED_TYPE = (
    f"struct<reject:{REJECT_TYPE},subject:string,message_id:string,"
    f"addresses:array<{ADDRESS_TYPE}>,parts:array<{PART_TYPE}>,"
    f"texts:array<{TEXT_TYPE}>,carried:array<{CARRIED_TYPE}>,"
    f"header_urls:array<struct<ordinal:int,name:string,value:string>>,{WARNINGS}>"
)

_MESSAGE_ID = re.compile(r"<[^\s<>@\"()\\\[\]=]+@[A-Za-z0-9.-]+>\Z")
_PLAIN = re.compile(PLAIN_ADDRESS)
#: A value that is one encoded word of plain UTF-8 in base64, the usual form of a subject that is not ASCII.
_ENCODED = re.compile(r"=\?utf-8\?b\?([A-Za-z0-9+/]+={0,2})\?=\Z", re.IGNORECASE)
#: Header values up to this length are remembered once read, so many a worker; senders and lists recur.
_SHORT, _REMEMBERED = 1000, 4096


def flatten_messages(messages: DataFrame, limits: Limits = Limits(), with_text: bool = True,
                     with_payload: bool = True, with_head: bool = True) -> DataFrame:
    """Fingerprint and parse; ``raw`` goes away, nested columns come in.

    Result: ``source_path, modification_time, size_bytes, sha256, evidence_id, fields, reject,
    subject, message_id, addresses, parts, texts, carried, header_urls, warnings``. Rejected rows keep only identity
    and ``reject``. ``with_text`` / ``with_payload`` say whether text bodies / attachment bytes are
    carried along for the URL and attachment areas. Without ``with_head`` the columns read from the head alone
    (``fields``, ``subject``, ``message_id``, ``addresses``) are NULL and nothing is read or carried for them.
    """
    df = fingerprint(messages, limits)
    df = df.withColumn("raw", F.when(F.col("reject").isNull(), F.col("raw")))
    if not with_head:
        df = df.drop("head")

    def parse(raw: bytes) -> dict[str, Any]:
        return _Flattening(limits, with_text, with_payload, with_head).run(raw)

    out = arrow_stage(df, "raw", "parsed", PARSED_TYPE, parse)
    kept = [c for c in out.columns if c not in ("parsed", "reject", "head")]
    head = F.col("head") if with_head else F.lit(None).cast("string")
    return out.select(
        *kept, header_fields(head).alias("fields"),
        F.coalesce("reject", "parsed.reject").alias("reject"),
        *[F.col(f"parsed.{c}") for c in (
            "subject", "message_id", "addresses", "parts", "texts", "carried", "header_urls",
            "warnings")])


def warned_messages(messages: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``source_path, fields, reject, warnings`` of ``flatten_messages``: each message is parsed as there, nothing
    but its warnings and reject comes back."""
    df = fingerprint(messages, limits).select(
        "source_path", "head", "reject", F.when(F.col("reject").isNull(), F.col("raw")).alias("raw"))

    def parse(raw: bytes) -> dict[str, Any]:
        return _Flattening(limits, False, False, False).run(raw)

    out = arrow_stage(df, "raw", "parsed", f"struct<reject:{REJECT_TYPE},{WARNINGS}>", parse)
    reject = F.coalesce("reject", "parsed.reject")
    return out.select("source_path", F.when(reject.isNull(), header_fields(F.col("head"))).alias("fields"),
                      reject.alias("reject"), "parsed.warnings")


class _Bound(Exception):
    def __init__(self, reason: str, observed: int, limit: int) -> None:
        super().__init__(reason)
        self.row = {"reason": reason, "observed": observed, "limit": limit}


class _Flattening:
    """State of one message while it is being walked."""

    def __init__(self, limits: Limits, with_text: bool, with_payload: bool, with_head: bool = True) -> None:
        self.limits = limits
        self.with_head = with_head
        self.with_text = with_text
        self.with_payload = with_payload
        self.parts: list[dict[str, Any]] = []
        self.texts: list[dict[str, Any]] = []
        self.carried: list[dict[str, Any]] = []
        self.warnings: list[dict[str, Any]] = []
        self.text_parts = 0
        self.bytes = 0  # of the leaves so far

    def run(self, raw: bytes) -> dict[str, Any]:
        try:
            message = email.message_from_bytes(raw)
            self.visit(message, "0", None, 0)
        except _Bound as bound:
            return {"reject": bound.row}
        except RecursionError:  # of the parser, far beyond any real message
            return {"reject": {"reason": "mime-too-deep", "observed": None, "limit": None}}
        except Exception:
            return {"reject": {"reason": "unparseable", "observed": len(raw), "limit": None}}
        items = list(message.raw_items())
        first: dict[str, str] = {}  # value of the first header of each name
        for key, value in items:
            first.setdefault(key.lower(), value)
        for name in ("date", "from"):
            if name not in first:
                self.warn("missing-header", f"no {name} header", None)
        return {
            "reject": None,
            **(_head(first) if self.with_head else {}),
            "parts": self.parts,
            "texts": self.texts,
            "carried": self.carried,
            "warnings": self.warnings,
            "header_urls": [
                {"ordinal": i, "name": _text(str(n)), "value": _text(str(v))}
                for i, (n, v) in enumerate(items) if "//" in str(v)
            ],
        }

    def warn(self, code: str, detail: str, part: str | None, stage: str = "message") -> None:
        self.warnings.append({"stage": stage, "seq": len(self.warnings), "code": code,
                              "detail": _text(detail), "part": part})

    def visit(self, part: Message, index: str, parent: str | None, depth: int) -> None:
        if depth > self.limits.mime_depth:
            raise _Bound("mime-too-deep", depth, self.limits.mime_depth)
        if len(self.parts) >= self.limits.mime_parts:
            raise _Bound("too-many-parts", len(self.parts) + 1, self.limits.mime_parts)
        for defect in part.defects:
            self.warn("mime-defect", f"{type(defect).__name__}: {defect}", index)
        filename, compat = self.filenames(part, index)
        row: dict[str, Any] = {
            "part_index": index, "parent_index": parent, "depth": depth,
            "ordinal": len(self.parts), "content_type": _text(part.get_content_type()),
            "is_container": part.is_multipart(), "is_attachment": False, "before": self.bytes,
        }
        self.parts.append(row)
        if part.is_multipart():
            children = part.get_payload()
            for i, child in enumerate(children if isinstance(children, list) else []):
                self.visit(child, f"{index}.{i}", index, depth + 1)
            row["last"] = len(self.parts) - 1
            return
        data = self.payload(part, index)
        disposition = part.get_content_disposition()
        attached = filename is not None or disposition == "attachment"
        row.update(
            filename=filename, filename_compat=compat, disposition=_text(disposition),
            size_bytes=len(data), sha256=hashlib.sha256(data).hexdigest() if data else None,
            is_attachment=attached, last=row["ordinal"])
        self.bytes += len(data)
        if attached:
            if self.with_payload:
                self.carried.append({
                    "ordinal": row["ordinal"], "part_index": index, "filename": compat,
                    "content_disposition": row["disposition"], "mime_claim": row["content_type"],
                    "size_bytes": len(data), "payload": data})
        elif self.with_text and row["content_type"] in ("text/plain", "text/html"):
            text = self.body(part, index, data)
            if text is not None:
                self.texts.append({
                    "ordinal": row["ordinal"], "part_index": index,
                    "content_type": row["content_type"], "text": text})

    def filenames(self, part: Message, index: str) -> tuple[str | None, str | None]:
        """The decoded file name and the one with encoded words left alone."""
        try:
            compat = part.get_filename()
            if compat is not None and "=?" in compat:
                part.policy = email.policy.default
                try:
                    return _text(part.get_filename()), _text(compat)
                finally:
                    part.policy = email.policy.compat32
            return _text(compat), _text(compat)
        except Exception as exc:
            self.warn("filename-decode-failed", f"file name not readable: {exc}", index)
            return None, None

    def payload(self, part: Message, index: str) -> bytes:
        try:
            data = part.get_payload(decode=True)
        except Exception as exc:
            self.warn("payload-decode-failed", f"transfer encoding not readable: {exc}", index)
            return b""
        return data if isinstance(data, bytes) else b""

    def body(self, part: Message, index: str, data: bytes) -> str | None:
        self.text_parts += 1
        if self.text_parts > self.limits.text_parts:
            if self.text_parts == self.limits.text_parts + 1:
                self.warn("url-too-many-text-parts",
                          f"text parts beyond the first {self.limits.text_parts} are not scanned",
                          None, "urls")
            return None
        if len(data) > self.limits.text_bytes:
            self.warn("url-text-truncated",
                      f"text beyond {self.limits.text_bytes} bytes is not scanned", index, "urls")
            data = data[: self.limits.text_bytes]
        try:
            return _text(data.decode(part.get_content_charset() or "utf-8", "replace"))
        except (LookupError, ValueError):
            return data.decode("utf-8", "replace")
        except Exception as exc:
            self.warn("url-body-decode-failed", f"text not readable: {exc}", index, "urls")
            return None


def _text(value: str | None) -> str | None:
    """Make a header string valid UTF-8: undecodable bytes become replacement characters."""
    if value is None:
        return None
    try:
        value.encode("utf-8")
        return value
    except UnicodeEncodeError:
        try:
            return value.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        except UnicodeEncodeError:
            return value.encode("utf-8", "replace").decode("utf-8")


def _head(first: dict[str, str]) -> dict[str, Any]:
    """What is read from the first header of each name."""
    return {
        "subject": _read(_decoded, first, "subject"),
        "message_id": _read(_decoded, first, "message-id"),
        "addresses": [
            {"role": role, "ordinal": i, "display_name": name, "addr": addr, "raw": shown}
            for role in rules.ADDRESS_ROLES
            for i, (name, addr, shown) in enumerate(_read(_addresses, first, role) or ())
        ],
    }


def _read(reader: Any, first: dict[str, str], name: str) -> Any:
    """``reader(name, value)`` of a header, remembered for short values; None without the header."""
    value = first.get(name)
    if value is None:
        return None
    return reader(name, value) if len(value) <= _SHORT else reader.__wrapped__(name, value)


def _structured(name: str, value: str) -> Any:
    """The header as the modern policy reads it (slow; only for values that need it)."""
    return email.policy.default.header_fetch_parse(name, value)


@functools.lru_cache(_REMEMBERED)
def _decoded(name: str, value: str) -> str | None:
    """Decoded header text, blank is NULL. Plain ASCII needs no header parser."""
    if value.isascii() and "\n" not in value and "\r" not in value and "=?" not in value:
        if name == "subject" or _MESSAGE_ID.match(value):
            return value.strip() or None
    word = _ENCODED.match(value) if name == "subject" else None
    try:
        if word:
            text = binascii.a2b_base64(word.group(1), strict_mode=True).decode()
            if text.isprintable():
                return text.strip() or None
    except ValueError:
        pass
    try:
        return _text(str(_structured(name, value)).strip()) or None
    except Exception:
        return None


@functools.lru_cache(_REMEMBERED)
def _addresses(role: str, value: str) -> tuple[tuple[str | None, ...], ...]:
    """(display name, address, raw) of each address; a value that is no list keeps itself as ``raw``."""
    raw = value if value.isascii() else None
    found: list[tuple[str, str, str]] = []
    plain = [_PLAIN.match(piece.strip()) for piece in raw.split(",")] if raw else [None]
    if raw and all(plain):
        for m in plain:
            name, addr = m.group(1) or "", m.group(2) or m.group(3) or m.group(4)
            shown = raw if role == "return-path" else (f"{name} <{addr}>" if name else addr)
            found.append((name, addr, shown))
    else:
        found = _parsed_addresses(role, value)
    return tuple(tuple(map(_text, row)) for row in found)


def _parsed_addresses(role: str, value: str) -> list[tuple[str, str, str]]:
    try:
        header = _structured(role, value)
    except Exception:
        return []
    out = []
    for a in getattr(header, "addresses", None) or ():
        try:
            out.append((a.display_name or "", a.addr_spec or "", str(a)))
        except Exception:
            continue
    if not out:
        try:
            text = str(header)
            out = [(name, addr, text) for name, addr in email.utils.getaddresses([text])]
        except Exception:
            return []
    return out


# --- tables ---------------------------------------------------------------------------------


def with_container_sizes(df: DataFrame) -> DataFrame:
    """Give every container the summed size of the leaves below it.

    Parts are numbered depth first, so a subtree is a range of them, and its size a difference of running sums:
    what lies before the part after its last one, less what lies before itself.
    """
    def size(p: Column) -> Column:
        end = F.get(F.col("parts"), p["last"])
        return end["before"] + F.coalesce(end["size_bytes"], F.lit(0)) - p["before"]

    return df.withColumn("parts", F.transform("parts", lambda p: p.withField(
        "size_bytes", F.when(p["is_container"], size(p)).otherwise(p["size_bytes"]))))


def part_rows(df: DataFrame) -> DataFrame:
    """``parts(source_path, evidence_id, the fields of PART_TYPE)``."""
    return with_container_sizes(df.where(F.col("reject").isNull())).select(
        "source_path", "evidence_id", F.inline_outer("parts")).select("source_path", "evidence_id", *PART_FIELDS)


def unnamed(filename: Column, part_index: Column) -> Column:
    return F.coalesce(null_if_empty(filename),
                      F.concat(F.lit("unnamed-attachment-"), part_index))


def attachment_inventory(df: DataFrame) -> DataFrame:
    """Attachments of the message tree: ``filename, mime_claim, size_bytes, sha256, part_index``."""
    empty_digest = F.sha2(F.lit(b""), 256)
    return (
        rows_of(df, ("source_path", "evidence_id"), "parts", "p")
        .where("p.is_attachment")
        .select(
            "source_path", "evidence_id", "p.part_index",
            unnamed(F.col("p.filename"), F.col("p.part_index")).alias("filename"),
            F.col("p.content_type").alias("mime_claim"), "p.size_bytes",
            F.coalesce("p.sha256", empty_digest).alias("sha256"))
    )


def address_rows(df: DataFrame) -> DataFrame:
    return df.select("source_path", "evidence_id", F.inline_outer("addresses")).where(
        F.col("role").isNotNull())


def first_of(role: str) -> Column:
    """STRUCT<display_name, addr, raw> of the first address with that role."""
    found = F.try_element_at(F.filter("addresses", lambda a: a["role"] == role), F.lit(1))
    return F.when(found.isNotNull(), F.struct(
        *[found[c].alias(c) for c in ("display_name", "addr", "raw")]))


def all_of(role: str) -> Column:
    return F.transform(
        F.filter("addresses", lambda a: a["role"] == role),
        lambda a: F.struct(*[a[c].alias(c) for c in ("display_name", "addr", "raw")]))


def message_warnings(df: DataFrame, stage: str = "message") -> DataFrame:
    """Warning rows found while parsing, for one stage (``message`` or ``urls``)."""
    return df.select("source_path", F.inline_outer("warnings")).where(F.col("stage") == stage)


def reject_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("reject").isNotNull()).select("source_path", "sha256", "reject.*")

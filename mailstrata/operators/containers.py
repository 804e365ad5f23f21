"""Names inside ZIP and OLE containers. Members are listed, never written or run."""

from __future__ import annotations

import io
import zipfile
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailstrata import rules
from mailstrata.limits import Limits
from mailstrata.operators.observations import WARNING_TYPE
from mailstrata.sources.arrow_stage import arrow_stage

CONTAINER_TYPE = (
    "struct<container_path:string,level:int,format:string,member_count:bigint,truncated:boolean,"
    "encrypted_entries:bigint>"
)
ENTRY_TYPE = (
    "struct<container_path:string,level:int,ordinal:int,entry_kind:string,name:string,"
    "size_bytes:bigint,encrypted:boolean,nested_archive:boolean>"
)
INVENTORY_TYPE = (
    f"struct<containers:array<{CONTAINER_TYPE}>,entries:array<{ENTRY_TYPE}>,"
    f"warnings:array<{WARNING_TYPE}>>"
)


class _Unreadable(Exception):
    pass


class _Listing:
    """Rows of one attachment."""

    def __init__(self, limits: Limits, part_index: str) -> None:
        self.limits = limits
        self.part_index = part_index
        self.containers: list[dict[str, Any]] = []
        self.entries: list[dict[str, Any]] = []
        self.warnings: list[dict[str, Any]] = []

    def warn(self, code: str, detail: str) -> None:
        self.warnings.append({"seq": len(self.warnings), "code": code, "detail": _valid(detail),
                              "part": self.part_index})

    def add(self, path: str, kind: str, total: int, rows: list[tuple[str, str, int | None, bool, bool]]) -> None:
        """One container and its listed (entry kind, name, size, locked, nested) rows."""
        level = path.count(".")
        self.containers.append({
            "container_path": path, "level": level, "format": kind, "member_count": total,
            "truncated": total > len(rows), "encrypted_entries": sum(row[3] for row in rows)})
        names = ("entry_kind", "name", "size_bytes", "encrypted", "nested_archive")
        self.entries += [{"container_path": path, "level": level, "ordinal": k, **dict(zip(names, row))}
                         for k, row in enumerate(rows)]


def _members(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except Exception as exc:
        raise _Unreadable(f"not a readable ZIP: {exc}") from exc


def _list_zip(out: _Listing, data: bytes) -> None:
    """Lists the archive and, from a stack of paths, the archives in it: a member is listed before its
    content, and content before the next member."""
    bound = out.limits
    waiting: list[tuple[str, Any]] = [("0", lambda: (_members(data), None))]
    while waiting:
        path, opened = waiting.pop()
        found = opened()
        if found is None:
            continue
        archive, label = found
        members = archive.infolist()
        listed = members[: bound.archive_entries]
        locked = [bool(m.flag_bits & 1) for m in listed]
        inner = [not lock and m.filename.lower().endswith(rules.NESTED_ARCHIVE_SUFFIXES)
                 for m, lock in zip(listed, locked)]
        out.add(path, "zip", len(members), [
            ("member", _valid(m.filename), None if lock else m.file_size, lock, nested)
            for m, lock, nested in zip(listed, locked, inner)])
        if len(members) > len(listed):
            waiting.append((path, _later(out, "archive-entries-capped",
                                         f"{len(members)} members, {len(listed)} listed")))
        waiting += [(f"{path}.{k}", _opener(out, archive, m, path.count(".")))
                    for k, (m, nested) in reversed(list(enumerate(zip(listed, inner)))) if nested and not m.is_dir()]


def _later(out: _Listing, code: str, detail: str) -> Any:
    return lambda: out.warn(code, detail)


def _opener(out: _Listing, archive: zipfile.ZipFile, member: zipfile.ZipInfo, level: int) -> Any:
    """Opens a member as an archive when its turn comes; what stands against it becomes a warning."""
    name, bound = member.filename, out.limits

    def open_() -> tuple[zipfile.ZipFile, str] | None:
        if level >= bound.archive_depth:
            return out.warn("archive-depth-capped", f"{name}: nested deeper than the limit")
        if member.file_size > bound.nested_member_bytes:
            return out.warn("archive-member-too-large", f"{name}: {member.file_size} bytes")
        try:
            data = archive.read(member)
        except Exception as exc:
            return out.warn("archive-member-unreadable", f"{name}: {exc}")
        try:
            return _members(data), name
        except _Unreadable as exc:
            return out.warn("archive-unreadable", f"{name}: {exc}")

    return open_


# Compound files: the published layout as numpy records over the whole file --------------------

_HEADER = np.dtype([
    ("magic", "V8"), ("clsid", "V16"), ("minor", "<u2"), ("major", "<u2"), ("order", "<u2"), ("shift", "<u2"),
    ("mini_shift", "<u2"), ("reserved", "V6"), ("n_directory", "<u4"), ("n_fat", "<u4"), ("directory", "<u4"),
    ("transaction", "<u4"), ("cutoff", "<u4"), ("mini_fat", "<u4"), ("n_mini_fat", "<u4"), ("difat", "<u4"),
    ("n_difat", "<u4"), ("fat", "<u4", 109)])
_ENTRY = np.dtype([("name", "<u2", 32), ("name_bytes", "<u2"), ("kind", "u1"), ("rest", "V61")])
_LAST_SECTOR = 0xFFFFFFFA  # sector numbers above it are marks
_KINDS = {1: "storage", 2: "stream"}


def _chain(follow: np.ndarray, first: int) -> np.ndarray:
    """Sectors of a chain; a chain that leaves the table or meets itself is broken."""
    out, at = [], first
    while at < _LAST_SECTOR:
        if at >= len(follow) or len(out) > len(follow):
            raise _Unreadable(f"broken sector chain at {at}")
        out.append(at)
        at = int(follow[at])
    return np.array(out, dtype=np.int64)


def _compound_names(data: bytes) -> list[tuple[str, str]]:
    """(kind, name) of all storages and streams in the order of the directory, the root left out."""
    try:
        head = np.frombuffer(data, _HEADER, count=1)[0]
        size = 1 << int(head["shift"])
        n = (len(data) - 512) // size
        body = np.frombuffer(data, np.uint8, count=n * size, offset=512).reshape(n, size)
        fat = head["fat"][head["fat"] < _LAST_SECTOR]
        at = int(head["difat"])
        for _ in range(int(head["n_difat"])):  # further sectors that list the allocation table
            more = body[at].view("<u4")
            fat, at = np.append(fat, more[:-1][more[:-1] < _LAST_SECTOR]), int(more[-1])
        follow = np.ascontiguousarray(body[fat.astype(np.int64)]).view("<u4").ravel()
        sectors = body[_chain(follow, int(head["directory"]))]
        entries = np.ascontiguousarray(sectors).ravel().view(_ENTRY)
    except (ValueError, IndexError) as exc:
        raise _Unreadable(f"no readable compound file: {exc}") from exc
    return [(_KINDS[int(e["kind"])], _valid(e["name"].tobytes()[: max(0, int(e["name_bytes"]) - 2)].decode("utf-16-le", "replace")))
            for e in entries[1:] if int(e["kind"]) in _KINDS]


def _list_compound(out: _Listing, data: bytes) -> None:
    names = _compound_names(data)
    out.add("0", "ole", len(names), [(kind, name, None, False, False) for kind, name in names])


def _valid(text: str) -> str:
    return text.encode("utf-8", "replace").decode("utf-8")


def _inventory(data: bytes, kind: str, part_index: str, limits: Limits) -> dict[str, Any]:
    out = _Listing(limits, part_index)
    try:
        (_list_compound if kind == "ole" else _list_zip)(out, data)
    except _Unreadable as exc:
        out.warn("ole-unreadable" if kind == "ole" else "archive-unreadable", str(exc))
    return {"containers": out.containers, "entries": out.entries, "warnings": out.warnings}


def routed(df: DataFrame) -> DataFrame:
    """Attachments that are inventoried: ZIP content, non-empty ``.zip`` names, OLE content."""
    return df.where(
        F.col("label").isin("zip", "ole")
        | ((F.col("extension") == ".zip") & (F.col("label") != "empty")))


def with_inventory(attachments: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Replace ``payload`` of the routed attachments by STRUCT<containers, entries, warnings>."""
    df = routed(attachments)
    # A name may say .zip while the content is OLE: content that is no ZIP is still tried as one.
    df = df.withColumn("container_kind", F.when(
        (F.col("label") == "ole") & (F.col("extension") != ".zip"), "ole").otherwise("zip"))
    out = arrow_stage(df, "payload", "inventory", INVENTORY_TYPE,
                      lambda data, kind, part: _inventory(data, kind, part, limits),
                      extra=("container_kind", "part_index"))
    return out


def container_rows(inventoried: DataFrame) -> DataFrame:
    return inventoried.select("source_path", "evidence_id", "part_index", "filename",
                              F.inline("inventory.containers"))


def container_entries(inventoried: DataFrame) -> DataFrame:
    """``container_entries(source_path, evidence_id, part_index, filename, ENTRY fields...)``."""
    return inventoried.select("source_path", "evidence_id", "part_index", "filename",
                              F.inline("inventory.entries"))

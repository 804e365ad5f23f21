"""Documents for people and tools: one overview row and one JSON document per message."""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailstrata.functions.common import let, null_if_empty
from mailstrata.functions.text import defang_text, truncate_display
from mailstrata.limits import Limits
from mailstrata.operators import headers
from mailstrata.operators.mime import all_of, first_of, unnamed
from mailstrata.session import tasks_for


def _shown(address: Column) -> Column:
    name, addr = null_if_empty(address["display_name"]), null_if_empty(address["addr"])
    both = F.concat(name, F.lit(" <"), addr, F.lit(">"))
    return F.coalesce(both, addr, name, F.lit("—"))


def _display(text: Column, limits: Limits) -> Column:
    value = F.coalesce(null_if_empty(text), F.lit("—"))
    return defang_text(truncate_display(value, limits.display_chars))


def overview(parsed: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One summary row per accepted message, row-local: every count comes from the row's arrays."""
    ok = parsed.where(F.col("reject").isNull())
    df = ok.withColumn("date", headers.message_date(headers.first_of_any("date")))
    attached = F.filter("parts", lambda p: p["is_attachment"])
    names = F.array_join(
        F.transform(attached, lambda p: unnamed(p["filename"], p["part_index"])), ", ")
    own = F.filter("warnings", lambda w: w["stage"] == "message")
    first = F.try_element_at(own, F.lit(1))
    return df.select(
        "source_path", "evidence_id", F.left("sha256", F.lit(16)).alias("sha256_head"),
        "size_bytes",
        F.coalesce("date.utc", null_if_empty(F.col("date.original")), F.lit("<missing>"))
        .alias("date"),
        _display(_shown(first_of("from")), limits).alias("from"),
        _display(F.array_join(F.transform(all_of("to"), _shown), ", "), limits).alias("to"),
        _display(F.col("subject"), limits).alias("subject"),
        F.size("parts").alias("parts"),
        F.get("parts", F.lit(0))["content_type"].alias("content_type"),
        F.size(attached).alias("attachments"),
        null_if_empty(truncate_display(names, limits.display_chars)).alias("files"),
        F.size(own).alias("warnings"),
        first["code"].alias("first_warning"),
        truncate_display(first["detail"], limits.display_chars).alias("first_warning_detail"),
    )


# --- one JSON document per message --------------------------------------------------------------
#
# Every table contributes rows (source_path, items and the texts of one-row tables): an *item* is (block, path,
# name, slot, at, json), where ``block`` is the place of an item in the document, (path, name) its order there, and
# (slot, at) its place in a record that has items of several tables. A table row is one row here, whatever number of
# items it has. One union of all is exchanged by message; records and documents are then put together in place.

_AREAS = {"headers": "received", "authentication": "auth", "urls": "urls", "attachments_detail": "attachments"}
_RECORDS = "attachments_detail.attachments"
#: Lists of a document. Items carry the number of theirs, which is shorter and quicker to compare than its name.
_BLOCKS = ("mime_tree", "attachments", "parser_warnings", *[f"{area}.{own}" for area in _AREAS for own in (
    "observations", "parser_warnings")], "headers.received", "authentication.auth_results", "authentication.dkim_signatures",
    "authentication.received_spf", "urls.urls", _RECORDS)
#: Lists inside a record, in order; the record opens before the first and closes behind the last.
_SLOTS = ("containers", "container_entries", "observations", "observation_codes")
_ITEMS = "array<struct<block:int,path:array<bigint>,name:string,slot:int,at:array<bigint>,json:string>>"
#: Texts of the tables with one row per message.
_OWN = ("message", "routing", "sender")
_MESSAGE = ("evidence_id", "source_path", "sha256", "size_bytes", "date", "from", "to", "cc", "reply_to", "return_path",
            "message_id", "subject")


def _dotted(path: Column) -> Column:
    """A dotted path by its numbers, so that 0.2 comes before 0.10."""
    return F.transform(F.split(path, r"\."), lambda number: number.cast("long"))


def _json(value: Column) -> Column:
    """JSON text of any value, scalars and NULL included; the text is made once."""
    text = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return let(text, lambda t: F.substring(t, F.lit(2), F.length(t) - 2))


def _object_json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def _sorted_map(entries: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(entries)))


def _record(df: DataFrame, *left_out: str) -> Column:
    """The other columns of a table as one JSON object, names and map keys sorted."""
    maps = {f.name for f in df.schema.fields if f.dataType.typeName() == "map"}
    names = sorted(c for c in df.columns if c not in ("source_path", "evidence_id", *left_out))
    return _object_json(*[(_sorted_map(F.col(c)) if c in maps else F.col(c)).alias(c) for c in names])


def _block(name: str) -> Column:
    return F.lit(_BLOCKS.index(name))


def _item(block: Column | str, json: Column, path: Column | None = None, name: Column | None = None,
          slot: int = 0, at: Column | None = None) -> Column:
    def numbers(c: Column | None) -> Column:
        return F.expr("cast(array() as array<bigint>)") if c is None else c.cast("array<bigint>")
    return F.struct((_block(block) if isinstance(block, str) else block).alias("block"), numbers(path).alias("path"),
                    (F.lit("") if name is None else name).alias("name"), F.lit(slot).alias("slot"),
                    numbers(at).alias("at"), json.alias("json"))


def _rows(df: DataFrame, items: Column | None = None, **own: list[Column]) -> DataFrame:
    """All items and texts of a table row in one row."""
    def texts(name: str) -> Column:
        return (F.array(*map(_json, own[name])) if name in own else F.lit(None)).cast("array<string>").alias(name)
    return df.select("source_path", (F.lit(None) if items is None else items).cast(_ITEMS).alias("items"), *map(texts, _OWN))


def _items(df: DataFrame, *items: Column) -> DataFrame:
    return _rows(df, F.array(*items))


def _tree(parts: DataFrame) -> DataFrame:
    """The nested tree of parts as text: a part opens before its subtree and closes behind it.

    Parts are numbered depth first; what closes behind a part closes from the deepest one on.
    """
    more = ~F.col("part_index").rlike(r"(^|\.)0$")
    opened = F.concat(F.when(more, ",").otherwise(""), F.lit('{"children":['))
    fields = _object_json("content_type", "filename", F.col("part_index").alias("index"), "is_attachment", "sha256", "size_bytes")
    closed = let(fields, lambda f: F.concat(F.lit("],"), F.substring(f, F.lit(2), F.length(f))))

    def place(*numbers: Column | int) -> Column:
        return F.array(*[(F.lit(n) if isinstance(n, int) else n).cast("bigint") for n in numbers])

    return _items(parts, _item("mime_tree", opened, place(F.col("ordinal"), 0, F.col("depth"))),
                  _item("mime_tree", closed, place(F.col("last"), 1, -F.col("depth"))))


def _opened(record: Column, path: Column) -> list[Column]:
    """The frame of a record: its own fields, the brackets of its lists and its end. ``at`` is NULL, before any item."""
    texts = [let(record, lambda r: F.substring(r, F.lit(1), F.length(r) - 1)),
             *[F.lit(("]," if i else ",") + f'"{slot}":[') for i, slot in enumerate(_SLOTS)], F.lit("]}")]
    return [_item(_RECORDS, text, path, None, slot, F.lit(None)) for slot, text in enumerate(texts)]


def _routing_columns(tables: dict[str, DataFrame]) -> list[str]:
    return [c for c in tables["routing"].columns if c not in ("source_path", "evidence_id")]


def document_items(tables: dict[str, DataFrame]) -> DataFrame:
    """The union of all tables of one run: ``source_path``, ``items`` and the texts of the one-row tables."""
    made = {"date": F.col("date").dropFields("epoch"), "from": F.col("from_addr")}
    found = [_rows(tables["messages"], message=[made.get(c, F.col(c)) for c in _MESSAGE]),
             _tree(tables["parts"]),
             _items(tables["attachment_inventory"], _item("attachments", _record(tables["attachment_inventory"]),
                                                          _dotted(F.col("part_index"))))]

    def listed(table: str, block: str, order: str, *left_out: str, **made: Column) -> None:
        if table in tables:
            df = tables[table].withColumns(made)
            key = F.col(order)
            text = df.schema[order].dataType.typeName() == "string"
            found.append(_items(df, _item(block, _record(df, *left_out), None if text else F.array(key), key if text else None)))

    warned = tables["warnings"]
    area = _block("parser_warnings")
    for block, stage in _AREAS.items():
        area = F.when(F.col("stage") == stage, _block(f"{block}.parser_warnings")).otherwise(area)
    found.append(_items(warned, _item(area, _record(warned, "stage", "seq"), F.array("seq"))))
    if "routing" in tables:
        found.append(_rows(tables["routing"], routing=[
            _sorted_map(F.col(c)) if c == "list_headers" else F.col(c).dropFields("epoch") if c == "date" else F.col(c)
            for c in _routing_columns(tables)]))
    listed("hops", "headers.received", "position", "timestamp_epoch")
    if "from_domains" in tables:
        found.append(_rows(tables["from_domains"], sender=[F.col("from_domain")]))
    listed("auth_results", "authentication.auth_results", "ordinal", "ordinal", "known_result")
    listed("dkim_signatures", "authentication.dkim_signatures", "ordinal", "ordinal",
           verification_note=F.lit("as stated by the header; no key was looked up and nothing was verified"))
    listed("received_spf", "authentication.received_spf", "ordinal", "ordinal")
    listed("urls", "urls.urls", "url", "invalid_port",
           query_params=F.transform("query_params", lambda p: F.array(p["name"], p["value"])))
    if "attachments" in tables:
        kept = tables["attachments"].select(*[c for c in tables["attachments"].columns if c not in ("category", "label", "label_detail")],
                                            F.struct("category", F.col("label_detail").alias("detail"), "label").alias("identified"))
        found.append(_items(kept, *_opened(_record(kept), _dotted(F.col("part_index")))))
        for table, *ordinal in (("containers",), ("container_entries", "ordinal")):
            df = tables[table]
            inside = _dotted(F.col("container_path"))
            at = F.concat(F.array(F.size(inside)), inside, *[F.array(F.col(c)) for c in ordinal])
            found.append(_items(df, _item(_RECORDS, _record(df, "part_index", "filename"), _dotted(F.col("part_index")), None,
                                          1 + _SLOTS.index(table), at)))
    if "observations" in tables:
        observed = tables["observations"]
        note = _object_json(_sorted_map(F.col("basis")).alias("basis"), "code", "detail")
        own = (F.col("area") == "attachments") & F.col("subject").isNotNull()
        block = F.lit(None).cast("int")
        for area in _AREAS:
            block = F.when(F.col("area") == area.removesuffix("_detail"), _block(f"{area}.observations")).otherwise(block)
        path, at = _dotted(F.col("subject")), F.array("seq")
        inside = F.array(_item(_RECORDS, note, path, None, 1 + _SLOTS.index("observations"), at),
                         _item(_RECORDS, _json(F.col("code")), path, None, 1 + _SLOTS.index("observation_codes"), at))
        found.append(_rows(observed, F.when(own, inside).otherwise(F.array(_item(block, note, at)))))
    return reduce(DataFrame.unionByName, found)


def _object(fields: dict[str, Column]) -> Column:
    """JSON object of texts, keys sorted."""
    parts: list[Column] = []
    for k in sorted(fields):
        parts += [F.lit(("," if parts else "{") + f'"{k}":'), fields[k]]
    return F.concat(*parts, F.lit("}"))


def _in_block(items: Column, block: str) -> Column:
    return F.filter(items, lambda x: x["block"] == _block(block))


def _records(items: Column) -> Column:
    """The text of all records. Their items lie in order, so each piece only looks at the one before it: a comma
    stands before a record and between two items of a list."""
    def piece(all_: Column, x: Column, i: Column) -> Column:
        follows = F.when(x["at"].isNull(), x["slot"] == 0).otherwise(F.get(all_, i - 1)["at"].isNotNull())
        return F.concat(F.when((i > 0) & follows, ",").otherwise(""), x["json"])
    return let(_in_block(items, _RECORDS), lambda all_: F.array_join(
        F.transform(all_, lambda x, i: piece(all_, x, i)), ""))


def message_documents(tables: dict[str, DataFrame], provenance: dict[str, str | None] | None = None) -> DataFrame:
    """``(source_path, document)``: one deterministic JSON text per accepted message.

    All items meet in one exchange by message, with tasks by the rows of ``messages`` (what is moved is small for the
    work that follows); there they are sorted once. Keys are sorted; nothing depends on the run but ``provenance``,
    which the caller states.
    """
    made = document_items(tables).repartition(tasks_for(tables["messages"]), "source_path")
    messages = made.groupBy("source_path").agg(
        F.sort_array(F.flatten(F.collect_list("items"))).alias("items"), *[F.min(c).alias(c) for c in _OWN])
    items = F.col("items")

    def one(table: str, columns: Iterable[str]) -> dict[str, Column]:
        return {c: F.coalesce(F.get(table, F.lit(i)), F.lit("null")) for i, c in enumerate(columns)}

    def many(block: str, by: str = ",") -> Column:
        return F.concat(F.lit("["), F.array_join(F.transform(_in_block(items, block), lambda x: x["json"]), by), F.lit("]"))

    message = one("message", _MESSAGE)
    source = {k: message[k] for k in ("evidence_id", "source_path", "sha256")}
    source["provenance"] = F.lit(json.dumps(provenance, sort_keys=True, separators=(",", ":")))
    tree = F.array_join(F.transform(_in_block(items, "mime_tree"), lambda x: x["json"]), "")
    blocks = {**source, **message, "mime_tree": tree, "attachments": many("attachments"), "parser_warnings": many("parser_warnings")}

    def area(name: str, **own: Column) -> Column:
        return _object({**source, **own, "observations": many(f"{name}.observations"),
                        "parser_warnings": many(f"{name}.parser_warnings")})

    if "routing" in tables:
        blocks["headers"] = area("headers", received=many("headers.received"), **one("routing", _routing_columns(tables)))
    if "from_domains" in tables:
        blocks["authentication"] = area("authentication", **one("sender", ["from_domain"]), **{
            c: many(f"authentication.{c}") for c in ("auth_results", "dkim_signatures", "received_spf")})
    if "urls" in tables:
        blocks["urls"] = area("urls", urls=many("urls.urls"), url_count=F.size(_in_block(items, "urls.urls")).cast("string"))
    if "attachments" in tables:
        blocks["attachments_detail"] = area("attachments_detail", attachments=F.concat(F.lit("["), _records(items), F.lit("]")))
    return messages.select("source_path", _object(blocks).alias("document"))


def write_tables(tables: dict[str, DataFrame], path: str, ingest_date: str) -> None:
    """Write every table as parquet below ``path``, one partition per ingest date."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/ingest_date={ingest_date}")

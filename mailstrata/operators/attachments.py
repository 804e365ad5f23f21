"""Attachments: what name, declared type, leading bytes and container listing say, side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailstrata import rules
from mailstrata.functions.common import first_match, pinned
from mailstrata.functions.content import extension_chain, identify_bytes
from mailstrata.limits import Limits
from mailstrata.operators.mime import unnamed
from mailstrata.operators.observations import observation, observation_rows, present

ATTACHMENT_COLUMNS = (
    "filename", "part_index", "content_disposition", "mime_claim", "size_bytes", "sha256", "md5",
    "category", "label", "label_detail", "extension", "extension_chain",
)


def attachment_rows(df: DataFrame) -> DataFrame:
    """One row per attachment with hashes and identification; ``payload`` is still there."""
    rows = df.select("source_path", "evidence_id", F.inline("carried"))
    rows = rows.withColumn("filename", unnamed(F.col("filename"), F.col("part_index")))
    rows = pinned(rows, rows.columns, identify_bytes(F.col("payload")), "identified")
    rows = rows.withColumns({
        "sha256": F.sha2("payload", 256), "md5": F.md5("payload"),
        "extension_chain": extension_chain(F.col("filename")),
    })
    return rows.withColumns({
        "category": F.col("identified.category"), "label": F.col("identified.label"),
        "label_detail": F.col("identified.detail"),
        "extension": F.coalesce(F.concat(
            F.lit("."), F.try_element_at("extension_chain", F.lit(-1))), F.lit("")),
    }).drop("identified")


def extension_dimension(spark: SparkSession) -> DataFrame:
    """``(extension, agreeing_labels)``: a few dozen rows fixed by the rules."""
    rows = [("." + ext, list(labels)) for exts, labels in rules.EXTENSION_LABELS for ext in exts]
    return spark.createDataFrame(rows, "extension string, agreeing_labels array<string>")


def mime_dimension(spark: SparkSession) -> DataFrame:
    """``(label, agreeing_types)``: a few dozen rows fixed by the rules."""
    rows = [(label, list(types)) for label, types in rules.LABEL_MIME_TYPES.items()]
    return spark.createDataFrame(rows, "label string, agreeing_types array<string>")


def with_agreement(attachments: DataFrame) -> DataFrame:
    """Add ``extension_mismatch`` and ``mime_mismatch``; both dimensions are constant tables."""
    spark = attachments.sparkSession
    df = attachments.join(F.broadcast(extension_dimension(spark)), "extension", "left")
    df = df.join(F.broadcast(mime_dimension(spark)), "label", "left")
    judged = ~F.col("label").isin("unknown", "empty")
    claimed = F.lower(F.btrim(F.substring_index("mime_claim", ";", 1)))
    says_something = (claimed != "") & ~claimed.isin(*rules.GENERIC_MIME_TYPES)
    return df.withColumns({
        "extension_mismatch": judged & F.coalesce(
            ~F.array_contains("agreeing_labels", F.col("label")), F.lit(False)),
        "mime_mismatch": judged & says_something & F.coalesce(
            ~F.array_contains("agreeing_types", claimed), F.lit(False)),
    }).drop("agreeing_labels", "agreeing_types")


_SLOTS = 1 << 32  # observation numbers per attachment


def _slot(k: int | Column) -> Column:
    return F.col("ordinal").cast("bigint") * _SLOTS + k


def _extension_in(names: tuple[str, ...]) -> Column:
    return F.col("extension").isin(*["." + n for n in names])


def quoted(text: Column) -> Column:
    """A value as a quoted literal: double quotes only around text that holds single ones alone."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for sign, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(sign), F.lit(shown))
    single = F.concat(F.lit("'"), F.replace(out, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(text.contains("'") & ~text.contains('"'), F.concat(F.lit('"'), out, F.lit('"'))).otherwise(single)


def own_observations(attachments: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Observations that need no container listing, in one narrow pass."""
    label, name = F.col("label"), F.col("filename")
    filled = F.col("size_bytes") > 0
    native = ("windows-pe", "elf")
    items = [
        ((F.size("extension_chain") >= 2) & _extension_in(rules.EXECUTABLE_EXTENSIONS),
         "double-extension",
         F.concat(F.lit("ends in "), F.array_join("extension_chain", " "))),
        (F.col("extension_mismatch"), "extension-type-mismatch",
         F.concat(F.lit("named "), F.col("extension"), F.lit(", content is "), label)),
        (F.col("mime_mismatch"), "declared-mime-mismatch",
         F.concat(F.lit("declared "), F.col("mime_claim"), F.lit(", content is "), label)),
        (~filled, "empty-attachment", F.lit("no content")),
        (filled & label.isin(*native), "executable-content", F.col("label_detail")),
        (filled & (label == "script"), "script-content", F.col("label_detail")),
        (filled & _extension_in(rules.MACRO_EXTENSIONS) & label.isin("zip", "ole"),
         "macro-capable-format", F.concat(F.col("extension"), F.lit(" can hold macros"))),
        (F.col("size_bytes") >= limits.oversized_bytes, "oversized-attachment",
         F.concat(F.col("size_bytes").cast("string"), F.lit(" bytes"))),
    ]
    last = _SLOTS - 1
    named, magic = F.concat(F.lit("filename="), quoted(name)), F.concat(F.lit(" magic="), F.col("label_detail"))
    basis = {
        "extension-type-mismatch": F.concat(named, magic),
        "declared-mime-mismatch": F.concat(F.lit("mime_claim="), quoted(F.col("mime_claim")), magic),
        "executable-content": F.concat(named, magic),
        "oversized-attachment": F.concat(named, F.lit(" size="), F.col("size_bytes").cast("string")),
    }
    observed = present(*[
        (cond, observation(_slot(last if code == "oversized-attachment" else k), code, detail,
                           F.col("part_index"), text=basis.get(code, named)))
        for k, (cond, code, detail) in enumerate(items)
    ])
    df = with_agreement(attachments.drop("payload")).withColumn("observed", observed)
    return observation_rows(df, "attachments", "observed")


def _has_vba(name: Column) -> Column:
    low = F.lower(name)
    return low.contains("vbaproject.bin") | (low.contains("vba") & low.endswith(".bin"))


def _member_extension(name: Column) -> Column:
    stem = F.substring_index(F.substring_index(name, "/", -1), "\\", -1)
    return F.when(stem.contains("."), F.lower(F.substring_index(stem, ".", -1)))


def listed_observations(inventoried: DataFrame) -> DataFrame:
    """Observations from container listings (input of ``containers.with_inventory``)."""
    entries, levels = F.col("inventory.entries"), F.col("inventory.containers")
    name = F.col("filename")

    def note(k: int | Column, code: str, detail: Column, basis: Column | None = None) -> Column:
        text = F.concat(F.lit("filename="), name)
        return observation(_slot(k), code, detail, F.col("part_index"),
                           text=text if basis is None else F.concat(text, basis))

    def of_container(c: Column, i: Column) -> Column:
        mine = F.filter(entries, lambda e: e["container_path"] == c["container_path"])
        program = first_match(mine, lambda e: _member_extension(e["name"]).isin(
            *rules.EXECUTABLE_EXTENSIONS))
        at = i.cast("bigint") * 4 + 100
        return F.when(c["format"] == "zip", present(
            (c["level"] > 0, note(at, "nested-archive", F.lit("an archive inside an archive"))),
            (c["encrypted_entries"] > 0, note(
                at + 1, "password-protected",
                F.concat(c["encrypted_entries"].cast("string"), F.lit(" encrypted member(s)")))),
            (program.isNotNull(), note(
                at + 2, "archive-member-executable", program["name"],
                F.concat(F.lit(" member="), program["name"]))),
        )).otherwise(present())

    ole_vba = F.exists(entries, lambda e: e["entry_kind"].isin("storage", "stream")
                       & F.upper(e["name"]).contains("VBA"))
    zip_vba = (F.col("label") == "zip") & F.exists(
        entries, lambda e: (e["entry_kind"] == "member") & _has_vba(e["name"]))
    observed = F.concat(
        present((ole_vba & (F.col("size_bytes") > 0), note(
            50, "vba-project-present", F.lit("compound file lists a macro project")))),
        F.flatten(F.transform(levels, of_container)),
        present((zip_vba, note(
            _SLOTS - 2, "vba-project-present", F.lit("container lists a macro project")))),
    )
    return observation_rows(inventoried.withColumn("observed", observed), "attachments", "observed")


def count_observations(df: DataFrame) -> DataFrame:
    """attachment-count / no-attachments, read off the message row."""
    n = F.size(F.filter("parts", lambda p: p["is_attachment"]))
    rows = df.where(F.col("reject").isNull()).select("source_path", "evidence_id", n.alias("n"))
    rows = rows.withColumn("observed", F.array(observation(
        1 << 61, F.when(F.col("n") > 0, "attachment-count").otherwise("no-attachments"),
        F.concat(F.col("n").cast("string"), F.lit(" attachment(s)")),
        text=F.concat(F.lit("count="), F.col("n").cast("string")))))
    return observation_rows(rows, "attachments", "observed")


def container_warnings(inventoried: DataFrame) -> DataFrame:
    return inventoried.select(
        "source_path", F.lit("attachments").alias("stage"), "ordinal",
        F.inline("inventory.warnings"),
    ).select("source_path", "stage", (F.col("ordinal") * F.lit(1 << 32) + F.col("seq")).alias("seq"),
             "code", "detail", "part")

"""Snapshot and result codecs: versioned JSON in and out, with the migration of version 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SNAPSHOT_VERSION, RESULT_VERSION = 2, 1


def encode(df: DataFrame, version_field: str = "snapshotSchemaVersion", version: int = SNAPSHOT_VERSION, key: str = "doc_id") -> DataFrame:
    """key, payload: every row as camel-case JSON with its schema version; nulls are written."""
    camel = lambda n: "".join(w.title() if k else w for k, w in enumerate(n.split("_")))
    fields = [F.col(c).alias(camel(c)) for c in df.columns if c != key]
    return df.select(key, F.to_json(F.struct(F.lit(version).alias(version_field), *fields), {"ignoreNullFields": "false"}).cast("binary").alias("payload"))


def _version(payload: Column, field: str) -> Column:
    return F.get_json_object(payload.cast("string"), f"$.{field}").cast("int")


def decode(df: DataFrame, schema: str, version_field: str = "snapshotSchemaVersion", version: int = SNAPSHOT_VERSION, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows, refused). ``schema``: DDL of the current version in camel case.

    Payloads without a version, of a newer one or that do not parse are refused with a
    reason; version 1 snapshots are migrated.
    """
    v = _version(F.col("payload"), version_field)
    reason = F.when(v.isNull(), "MissingVersion").when(v > version, "UnsupportedVersion").when((v < version) & ~((v == 1) & (F.lit(version) == SNAPSHOT_VERSION)), "UnsupportedVersion")
    judged = df.withColumns({"_version": v, "reason": reason})
    text = F.col("payload").cast("string")
    rows = judged.where("reason is null").select(key, "_version", F.from_json(text, schema).alias("s"))
    return rows, judged.where("reason is not null").select(key, "reason")


#: Version 1 knew texts and styles only.
V1 = "snapshotSchemaVersion int, title string, sha256 string, paragraphs array<struct<nodeId:string,index:int,text:string,styleId:string>>"
V2 = "snapshotSchemaVersion int, title string, sha256 string, status string, paragraphs array<struct<nodeId:string,index:int,rawText:string,displayText:string,isEmpty:boolean,styleId:string>>, diagnostics array<struct<severity:string,code:string>>"


def migrate(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Snapshots of both versions as version 2 structs (key, s): a migrated one is Partial and says so."""
    text = F.col("payload").cast("string")
    old, new = F.from_json(text, V1), F.from_json(text, V2)
    paragraphs = F.transform(
        old["paragraphs"],
        lambda p: F.struct(p["nodeId"].alias("nodeId"), p["index"].alias("index"), p["text"].alias("rawText"), p["text"].alias("displayText"), (F.coalesce(p["text"], F.lit("")) == "").alias("isEmpty"), p["styleId"].alias("styleId")),
    )
    note = F.array(F.struct(F.lit("Info").alias("severity"), F.lit("LegacySnapshotMigrated").alias("code")))
    lifted = F.struct(F.lit(SNAPSHOT_VERSION).alias("snapshotSchemaVersion"), old["title"].alias("title"), old["sha256"].alias("sha256"), F.lit("Partial").alias("status"), paragraphs.alias("paragraphs"), note.alias("diagnostics"))
    v = _version(F.col("payload"), "snapshotSchemaVersion")
    return df.where(v.isin(1, SNAPSHOT_VERSION)).select(key, F.when(v == 1, lifted).otherwise(new).alias("s"))

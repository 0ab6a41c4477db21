"""Queries over files: the usage of a data folder that the query itself writes, and manifests of pages, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.sources import files
from docweave.storage import shared_dir

#: Where the texts of a table go in the data folder.
PLACES = {"documents": "Backups/a", "pages": "Cache/deep/er", "conversations": "Logs", "benchmark": "Temp", "region": "WorkingCopies/x/y", "nation": "other"}
_TEXT = {"documents": "text", "pages": "url", "conversations": "role", "benchmark": "text", "region": "r_name", "nation": "n_name"}


def folder_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of a folder by kind of file, after the texts of six tables were written to it as hex lines."""
    root = f"{shared_dir(spark)}/docweave/files-{uuid.uuid4().hex}"
    for table, place in PLACES.items():
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").where(F.col(_TEXT[table]).isNotNull())
        rows.select(F.hex(F.col(_TEXT[table]).cast("binary")).alias("value")).write.option("compression", "none").text(f"{root}/{place}")
    return files.usage(files.listing(spark, root)).select("kind", "bytes")


_BYTES = "\n  UNION ALL ".join(f"SELECT '{kind}' AS kind, coalesce(sum(2 * strlen({_TEXT[t]}) + 1), 0) AS bytes FROM {t} WHERE {_TEXT[t]} IS NOT NULL" for t, kind in (("documents", "Backup"), ("pages", "Cache"), ("conversations", "Logs"), ("benchmark", "Temp"), ("region", "Other"), ("nation", "Other")))
USAGE_SQL = f"""SELECT kind, CAST(sum(bytes) AS BIGINT) AS bytes FROM ({_BYTES}
  UNION ALL SELECT 'Database', 0 UNION ALL SELECT 'WorkingCopy', 0) GROUP BY kind"""


def _manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    key = F.col("page_id")
    path = lambda odd: F.concat(F.lit("d"), (key % 97).cast("string"), F.when(odd, "/new-").otherwise("/"), key.cast("string"))
    rows = lambda where, odd, text: pages.where(where).select(path(odd).alias("path"), F.octet_length(text).cast("long").alias("length"), F.sha2(text.cast("binary"), 256).alias("sha256"))
    html = F.coalesce("html", F.lit(""))
    after = F.when(key % 11 == 0, F.concat(html, F.lit("x"))).when(key % 13 == 0, F.reverse(html)).otherwise(html)
    return rows(key % 17 != 1, F.lit(False), html), rows(key % 19 != 2, key % 23 == 0, after)


def manifest_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files of two manifests, some lost, renamed, longer or changed in the second."""
    return files.differences(*_manifests(spark, sf_dir))


def changed_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes of every folder of the second manifest, and whether its digest is still that of the first."""
    one, two = (files.folder_digests(m) for m in _manifests(spark, sf_dir))
    old = one.select("folder", F.col("digest").alias("before"))
    return two.join(old, "folder", "left").select("folder", "files", "bytes", F.col("digest").eqNullSafe(F.col("before")).alias("same"))


_SIDES = """a AS (SELECT page_id AS k, 'd' || (page_id % 97) || '/' || page_id AS path, coalesce(html, '') AS h FROM pages WHERE page_id % 17 <> 1),
b AS (SELECT page_id AS k, 'd' || (page_id % 97) || CASE WHEN page_id % 23 = 0 THEN '/new-' ELSE '/' END || page_id AS path, CASE WHEN page_id % 11 = 0 THEN coalesce(html, '') || 'x' WHEN page_id % 13 = 0 THEN reverse(coalesce(html, '')) ELSE coalesce(html, '') END AS h FROM pages WHERE page_id % 19 <> 2)"""
DIFFERENCES_SQL = f"""WITH {_SIDES}
SELECT path, CASE WHEN b.k IS NULL THEN 'Lost' WHEN a.k IS NULL THEN 'Extra' WHEN strlen(a.h) <> strlen(b.h) THEN 'Resized' ELSE 'Changed' END AS what FROM a FULL JOIN b USING (path) WHERE a.k IS NULL OR b.k IS NULL OR a.h <> b.h"""
FOLDERS_SQL = f"""WITH {_SIDES},
both_sides AS (SELECT string_split(path, '/')[1] AS folder, a.k IS NOT NULL AS had, b.k IS NOT NULL AS has, a.h IS NOT DISTINCT FROM b.h AS equal, coalesce(strlen(b.h), 0) AS bytes FROM a FULL JOIN b USING (path))
SELECT folder, count(*) FILTER (has) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, bool_and(had AND has AND equal) AS same FROM both_sides GROUP BY 1 HAVING count(*) FILTER (has) > 0"""

QUERIES = {"folder_usage": (folder_usage, USAGE_SQL), "manifest_differences": (manifest_differences, DIFFERENCES_SQL), "changed_folders": (changed_folders, FOLDERS_SQL)}

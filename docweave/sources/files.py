"""Files of a data folder as rows: usage by kind from their metadata alone, and manifests that tell what changed.

A listing reads no content: only the path and length columns of Spark's file source are
asked for. Spark's source passes over empty files and names that begin with a dot or an
underscore, so these are in no listing. A manifest adds a digest of each file, read where the task is. Two manifests are
compared both ways; folders are compared by digests that add up, so no folder is gathered.
"""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds of files in a data folder.
KINDS = ("Database", "WorkingCopy", "Backup", "Cache", "Logs", "Temp", "Other")
#: The database's file unless another is named; its log and index stand beside it.
DATABASE = "store.db"


def listing(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """path below ``root``, length and, where asked for, content of every file in it and its subfolders."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.lit(urlsplit(root).path.rstrip("/") + "/")
    # The part of the full path behind the root: the scheme and host may be written in several ways.
    path = F.expr("substring(path, instr(path, root) + length(root))")
    return found.withColumn("root", below).select(path.alias("path"), "length", *(["content"] if content else []))


def kind(path: Column, database: str = DATABASE) -> Column:
    """The kind of a file by its path below the data folder."""
    parts = F.split(path, "/")
    top, leaf, deep = parts[0], F.element_at(parts, -1), F.size(parts) > 1
    working = deep & (top == "WorkingCopies")
    return (
        F.when(path.isin(database, f"{database}-wal", f"{database}-shm"), "Database")
        .when(deep & (top == "Backups"), "Backup")
        .when(deep & top.isin("Cache", "Logs", "Temp"), top)
        .when(working & (leaf == "restored.docx"), "WorkingCopy")
        .when(working & leaf.startswith("previous-"), "Backup")
        .when(working & leaf.startswith("candidate-"), "Temp")
        .otherwise("Other")
    )


def usage(files: DataFrame, originals: DataFrame | None = None, database: str = DATABASE) -> DataFrame:
    """kind, files and bytes of every kind, those without files too; ``originals`` (path) are left out."""
    rows = files if originals is None else files.join(originals.select("path"), "path", "left_anti")
    found = rows.groupBy(kind(F.col("path"), database).alias("kind")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    every = files.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    return every.join(found, "kind", "left").select("kind", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def manifest(files: DataFrame) -> DataFrame:
    """path, length, sha256 of a listing with contents."""
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """path and what became of it: Lost, Extra, Resized or Changed, from two manifests."""
    side = lambda df, s: df.select("path", F.struct("length", "sha256").alias(s))
    both = side(before, "a").join(side(after, "b"), "path", "full_outer")
    what = F.when(F.col("b").isNull(), "Lost").when(F.col("a").isNull(), "Extra").when(F.col("a.length") != F.col("b.length"), "Resized").when(~F.col("a.sha256").eqNullSafe(F.col("b.sha256")), "Changed")
    return both.select("path", what.alias("what")).where("what is not null")


def folder_digests(entries: DataFrame) -> DataFrame:
    """folder, files, bytes, digest of every folder with files of its own: equal folders have equal digests, in any order of files."""
    folder = F.regexp_replace(F.col("path"), "/?[^/]*$", "")
    one = F.xxhash64(F.regexp_extract("path", "([^/]*)$", 1), "length", "sha256")
    return entries.groupBy(folder.alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.hex(F.bit_xor(one)).alias("digest"))


def verified(before: DataFrame, after: DataFrame) -> bool:
    """Whether both manifests name the same files with the same contents."""
    return differences(before, after).limit(1).count() == 0

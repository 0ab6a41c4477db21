"""Version pairs of a text table, and the comparison of all pairs in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import annotate, changes, matching
from docweave.storage import stored

#: A line must be longer to tie versions together.
ANCHOR_CHARS = 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def paragraphs(docs: DataFrame, *key: str) -> DataFrame:
    """The key (doc_id), idx, node, text, norm: a paragraph for each line."""
    key = key or ("doc_id",)
    rows = docs.select(*key, F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    return rows.select(*key, "idx", F.concat(F.lit("body/p["), F.col("idx").cast("string"), F.lit("]")).alias("node"), "text", tx.normalize(F.col("text")).alias("norm"))


def version_pairs(lines: DataFrame) -> DataFrame:
    """pair, base_doc, cur_doc: documents with the same anchor line are versions, each compared with the one before.

    The anchor is the line longer than 20 characters with the smallest MD5, so a chain has
    one pair per document however many share it.
    """
    # Not filtered beforehand: the filter would make the normal form once more.
    digests = lines.select("doc_id", F.when(F.length("norm") > ANCHOR_CHARS, F.md5(F.col("norm").cast("binary"))).alias("anchor"))
    anchor = digests.groupBy("doc_id").agg(F.min("anchor").alias("anchor")).where("anchor is not null")
    before = F.lag("doc_id").over(Window.partitionBy("anchor").orderBy("doc_id"))
    return anchor.select(F.col("doc_id").alias("pair"), before.alias("base_doc"), F.col("doc_id").alias("cur_doc")).where("base_doc is not null")


def roles(pairs: DataFrame) -> DataFrame:
    """pair, doc_id, is_base: the two documents of each pair."""
    return pairs.select(F.inline(F.array(*(F.struct("pair", F.col(c).alias("doc_id"), F.lit(c == "base_doc").alias("is_base")) for c in ("base_doc", "cur_doc")))))


@dataclass
class Comparison:
    matched: matching.Matched
    mappings: DataFrame
    changes: DataFrame
    groups: DataFrame
    statistics: DataFrame


def compare(base: DataFrame, cur: DataFrame) -> Comparison:
    """The whole comparison of paired paragraphs (pair, idx, node, text, norm)."""
    b, c = matching.features(base), matching.features(cur)
    matched = matching.match(b, c)
    mappings = stored(matching.moved(matched.mappings), "mappings")
    found = stored(changes.text_changes(mappings, base, cur).unionByName(changes.unmatched_changes(matched.deleted, matched.inserted)), "changes")
    grouped = changes.groups(found)
    return Comparison(matched, mappings, found, grouped, changes.statistics(found, grouped, mappings=mappings))


def snapshot_paragraphs(snapshots: DataFrame) -> DataFrame:
    rows = snapshots.select("pair", F.explode("paragraphs").alias("p"))
    return rows.select("pair", "p.idx", "p.node", "p.text", tx.normalize(F.col("p.text")).alias("norm"), "p.style", F.col("p.numbering.level_index").alias("num_level"), F.col("p.numbering.level_text").alias("num_text"), F.col("p.numbering.number_format").alias("num_format"), "p.runs", "p.format")


def compare_snapshots(base: DataFrame, cur: DataFrame) -> Comparison:
    """The whole comparison of paired snapshots (pair, paragraphs, tables, revisions, comments).

    Texts and moves, formats of mapped paragraphs, tables and cells, and the annotations of
    the current side; ``order_items`` gives the items' total order. Pairs are strings in the result.
    """
    key = lambda df: df.withColumn("pair", F.col("pair").cast("string"))
    base, cur = key(base), key(cur)
    b, c = stored(snapshot_paragraphs(base), "base"), stored(snapshot_paragraphs(cur), "current")
    text = ("pair", "idx", "node", "text", "norm", "style", "num_level", "num_text", "num_format")
    found = compare(b.select(*text), c.select(*text))
    tables = lambda df: df.select("pair", F.explode("tables").alias("t")).select("pair", "t.table", "t.node", "t.format", "t.cells")
    cells, _, placed = changes.table_changes(tables(base), tables(cur))
    every = stored(found.changes.unionByName(changes.paragraph_format_changes(found.mappings, b, c)).unionByName(cells), "found")  # read by annotations twice
    noted = lambda name: cur.select("pair", F.explode(name).alias("n")).select("pair", "n.*")
    comments = noted("comments")
    every = stored(annotate.integrate(every, noted("revisions"), comments), "items")
    grouped = changes.groups(every)
    judged = found.mappings.select("pair", "confidence").unionByName(placed.select("pair", "confidence"))
    return Comparison(found.matched, found.mappings, every, grouped, changes.statistics(every, grouped, comments, judged))


def order_items(items: DataFrame) -> DataFrame:
    """Items of all pairs in their total order: by pair, then by the bytes of their id."""
    return items.orderBy("pair", "change_id")


def stored_pairs(docs: DataFrame) -> DataFrame:
    return stored(version_pairs(paragraphs(docs)), "pairs")


def stored_sides(spark: SparkSession, sf_dir: str, pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides of all version pairs of the table, written once; documents outside pairs only give their anchor."""
    docs = documents(spark, sf_dir)
    both = roles(pairs if pairs is not None else stored_pairs(docs)).join(docs.select("doc_id", "text"), "doc_id")
    lines = stored(paragraphs(both, "pair", "is_base"), "sides")
    return lines.where("is_base").drop("is_base"), lines.where("not is_base").drop("is_base")


def comparison(spark: SparkSession, sf_dir: str) -> Comparison:
    return compare(*stored_sides(spark, sf_dir))

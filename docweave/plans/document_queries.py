"""Queries over Word packages, styles, tables, codecs and restore plans, and the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import styles
from docweave.operators import changes, matching, restore
from docweave.plans import versions as v
from docweave.sources import docx, docx_build, snapshots
from docweave.storage import stored


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docx_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed as a Word file, scanned and parsed back to paragraphs."""
    packed = docx_build.packages(v.documents(spark, sf_dir), "doc_id", "text").withColumn("package", docx.sniff())
    rows = docx.parse_files(packed, "path string, status string, paragraphs array<struct<idx:int,node:string,text:string>>").select(F.col("path").cast("long").alias("doc_id"), "status", F.explode("paragraphs").alias("p"))
    return rows.select("doc_id", "status", "p.idx", "p.node", F.length("p.text").alias("chars"), F.md5(F.col("p.text").cast("binary")).alias("digest"))


DOCX_SQL = """SELECT doc_id, 'Complete' AS status, CAST(idx AS INT) AS idx, 'body/p[' || idx || ']' AS node, CAST(length(line) AS INT) AS chars, md5(line) AS digest
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents)"""


def style_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as a style chain: a returned line flips, an accepted one does nothing, others are absent."""
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False).alias("b"), F.when(F.col("l_returnflag") != "N", F.col("l_linestatus")).alias("c")).alias("s"))
    chain = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return chain.select("l_orderkey", styles.toggled(F.transform("s", lambda x: x["b"])).alias("bold"), styles.last_given(F.transform("s", lambda x: x["c"])).alias("color"))


TOGGLE_SQL = """SELECT l_orderkey, CASE WHEN count(*) FILTER (l_returnflag = 'R') = 0 THEN NULL ELSE count(*) FILTER (l_returnflag = 'R') % 2 = 1 END AS bold,
  arg_max(l_linestatus, (l_linenumber, l_partkey, l_suppkey)) FILTER (l_returnflag <> 'N') AS color FROM lineitem GROUP BY 1"""


def style_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as styles, each based on one some places before it; chains end at a root or at a missing style."""
    up = F.col("p_partkey") - 40 - F.col("p_size")
    parts = _t(spark, sf_dir, "part").where("p_size > 2")
    rows = parts.select(F.col("p_partkey").alias("style"), F.when(up >= 0, up).alias("based_on"))
    return styles.style_chains(rows).where("ended is not null").select("style", "depth", "ancestor", "ended")


CHAIN_SQL = """WITH RECURSIVE s AS (SELECT p_partkey AS style, CASE WHEN p_partkey - 40 - p_size >= 0 THEN p_partkey - 40 - p_size END AS based_on FROM part WHERE p_size > 2),
walk AS (SELECT style, 0 AS depth, style AS ancestor, based_on AS next FROM s UNION ALL SELECT walk.style, depth + 1, s.style, s.based_on FROM walk JOIN s ON s.style = next)
SELECT walk.style, depth, ancestor, CASE WHEN next IS NULL THEN 'Root' ELSE 'BrokenStyleReference' END AS ended FROM walk LEFT JOIN s ON s.style = next WHERE s.style IS NULL"""

_EDGE = "struct<style:string,color:string,size:string>"
_BORDERS = "struct<" + ",".join(f"{e}:{_EDGE}" for e in changes.EDGES.values()) + ">"
_CELL = f"struct<width:string,width_type:string,vertical_alignment:string,shading_fill:string,grid_span:int,vertical_merge:string,borders:{_BORDERS}>"
_TABLE = f"struct<style_id:string,width:string,width_type:string,alignment:string,shading_fill:string,borders:{_BORDERS}>"


def _order_tables(lines: DataFrame, quantity) -> DataFrame:
    """Orders as tables: a row for each line, its quantity in one cell and its status as shading."""
    from pyspark.sql import Window

    row = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    nothing = F.lit(None).cast("string")
    edges = F.struct(*(F.lit(None).cast(_EDGE).alias(e) for e in changes.EDGES.values())).cast(_BORDERS)
    form = F.struct(nothing, nothing, nothing, F.col("l_linestatus"), F.lit(None).cast("int"), nothing, edges).cast(_CELL)
    cells = lines.withColumn("row", row).select("l_orderkey", F.struct(F.col("row"), F.lit(0).alias("col"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("row").cast("string")).alias("node"), quantity.cast("int").cast("string").alias("text"), form.alias("format")).alias("cell"))
    table = F.struct(*(nothing for _ in range(5)), edges).cast(_TABLE)
    return cells.groupBy(F.col("l_orderkey").alias("pair")).agg(F.sort_array(F.collect_list("cell.row")).alias("rows"), F.collect_list("cell").alias("cells")).select("pair", F.lit(0).alias("table"), F.col("pair").cast("string").alias("node"), table.alias("format"), "cells")


def table_cell_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order tables against copies in which returned lines have one more."""
    lines = _t(spark, sf_dir, "lineitem")
    found, _, _ = changes.table_changes(_order_tables(lines, F.col("l_quantity")), _order_tables(lines, F.when(F.col("l_returnflag") == "R", F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))))
    return found.groupBy("pair", "kind").agg(F.count("*").alias("items"), F.sum(F.size("spans")).alias("spans"))


TABLES_SQL = "SELECT l_orderkey AS pair, 'TableCellChange' AS kind, count(*) AS items, count(*) AS spans FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1"


def snapshot_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded as snapshots of both versions, decoded and migrated."""
    docs = v.documents(spark, sf_dir)
    paragraph = F.transform(F.split("text", "\n"), lambda t, i: F.struct(F.concat(F.lit("p"), i.cast("string")).alias("nodeId"), i.alias("index"), t.alias("text"), F.lit(None).cast("string").alias("styleId")))
    old = docs.where("doc_id % 2 = 0").select("doc_id", F.col("lang").alias("title"), paragraph.alias("paragraphs"))
    new = docs.where("doc_id % 2 = 1").select("doc_id", F.col("lang").alias("title"), F.transform(paragraph, lambda p: F.struct(p["nodeId"], p["index"], p["text"].alias("rawText"), p["text"].alias("displayText"), (p["text"] == "").alias("isEmpty"), p["styleId"])).alias("paragraphs"), F.lit("Complete").alias("status"))
    both = snapshots.encode(old, version=1).unionByName(snapshots.encode(new))
    return snapshots.migrate(both).select("doc_id", F.col("s.title").alias("title"), F.coalesce("s.status", F.lit("none")).alias("status"), F.size("s.paragraphs").alias("paragraphs"), F.size(F.filter("s.paragraphs", lambda p: p["isEmpty"])).alias("empty"))


CODEC_SQL = """SELECT doc_id, lang AS title, CASE WHEN doc_id % 2 = 0 THEN 'Partial' ELSE 'Complete' END AS status,
  CAST(len(string_split(text, chr(10))) AS INT) AS paragraphs, CAST(len(list_filter(string_split(text, chr(10)), lambda t: t = '')) AS INT) AS empty FROM documents"""


def restore_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restore plans of all version pairs, with an alignment for long and for short paragraphs."""
    base, cur = v.stored_sides(spark, sf_dir)
    mappings = stored(matching.match(matching.features(base), matching.features(cur)).mappings, "mappings")
    look = lambda df: df.withColumns({"parent": F.lit(None).cast("string"), "style": F.lit(None).cast("string"), "num_level": F.lit(None).cast("int"), "format": F.struct(F.when(F.length("text") > 200, "both").otherwise("left").alias("alignment"))})
    items, notes = restore.paragraph_plan(mappings, look(base), look(cur), {"Alignment": "alignment"})
    return restore.plan_status(stored(items, "items"), notes)


QUERIES = {
    "docx_paragraphs": (docx_paragraphs, DOCX_SQL),
    "style_toggles": (style_toggles, TOGGLE_SQL),
    "style_chain": (style_chain, CHAIN_SQL),
    "table_cell_changes": (table_cell_changes, TABLES_SQL),
    "snapshot_codec": (snapshot_codec, CODEC_SQL),
    "restore_plan": (restore_plan, None),
}

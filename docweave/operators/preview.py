"""Preview of snapshots: blocks in document order, changes marked in their formatted segments, context of one change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.diff import SPANS
from docweave.functions.text import units
from docweave.operators.display import paragraph_label
from docweave.operators.review import segments

#: Blocks shown beside a located one, and rows of its own table.
REACH, TABLE_REACH = 1, 2


def all_paragraphs(snapshots: DataFrame, key: str = "pair") -> DataFrame:
    """key, paragraph: those of the body and those of table cells."""
    inner = F.flatten(F.transform("tables", lambda t: F.flatten(F.transform(t["cells"], lambda c: c["paragraphs"]))))
    body = snapshots.select(key, F.explode("paragraphs").alias("paragraph"))
    return body.unionByName(snapshots.select(key, F.explode(inner).alias("paragraph")))


def _shown(p: Column) -> Column:
    return F.struct(p["node"].alias("node"), p["text"].alias("text"), p["runs"].alias("runs"), p["format"]["alignment"].alias("alignment"))


def blocks(snapshots: DataFrame, key: str = "pair") -> DataFrame:
    """key, position, node, label, is_table, table, cells: paragraphs and table rows by source place and row.

    ``cells`` is an array of (node, col, span, text, paragraphs); a paragraph is a block of
    one cell, a table without rows a block of none.
    """
    cell = lambda node, col, span, text, ps: F.struct(node.alias("node"), col.alias("col"), span.alias("span"), text.alias("text"), ps.alias("paragraphs"))
    p = F.col("p")
    body = snapshots.select(key, F.explode("paragraphs").alias("p"))
    own = F.array(cell(p["node"], F.lit(0), F.lit(1), p["text"], F.array(_shown(p))))
    body = body.select(key, p["source"].alias("source"), F.lit(-1).alias("row"), p["node"].alias("node"), paragraph_label(p["idx"]).alias("label"), F.lit(None).cast("int").alias("table"), own.alias("cells"))
    t = F.col("t")
    rows = F.array_sort(F.array_distinct(F.transform(t["cells"], lambda c: c["row"])))
    tables = snapshots.select(key, F.explode("tables").alias("t")).select(key, "t", F.explode_outer(rows).alias("row"))
    inner = F.transform(
        F.filter(t["cells"], lambda c: c["row"] == F.col("row")),
        lambda c: cell(c["node"], c["col"], F.greatest(F.lit(1), F.coalesce(c["format"]["grid_span"], F.lit(1))), c["text"], F.transform(c["paragraphs"], _shown)),
    )
    node = F.when(F.col("row").isNull(), t["node"]).otherwise(F.concat(t["node"], F.format_string("/tr[%d]", "row")))
    label = F.when(F.col("row").isNull(), F.format_string("表格 %d（无可预览行）", t["table"] + 1)).otherwise(F.format_string("表格 %d · 第 %d 行", t["table"] + 1, F.col("row") + 1))
    tables = tables.select(key, t["source"].alias("source"), F.coalesce("row", F.lit(0)).alias("row"), node.alias("node"), label.alias("label"), t["table"].alias("table"), inner.alias("cells"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("source", "row")) - 1
    return body.unionByName(tables).select(key, place.alias("position"), "node", "label", F.col("table").isNotNull().alias("is_table"), "table", "cells")


def block_nodes(shown: DataFrame, key: str = "pair") -> DataFrame:
    """key, node, position: the first block that holds each node; a table's own node is in its first row."""
    inside = F.flatten(F.transform("cells", lambda c: F.concat(F.array(c["node"]), F.flatten(F.transform(c["paragraphs"], lambda p: F.concat(F.array(p["node"]), F.coalesce(F.transform(p["runs"], lambda r: r["node"]), F.array().cast("array<string>"))))))))
    parent = F.when(F.col("is_table"), F.array(F.regexp_replace("node", "/tr\\[\\d+\\]$", ""))).otherwise(F.array().cast("array<string>"))
    return shown.select(key, F.explode(F.array_distinct(F.concat(F.array("node"), parent, inside))).alias("node"), "position").groupBy(key, "node").agg(F.min("position").alias("position"))


def formatted(cut: Column, runs: Column, text: Column) -> Column:
    """Segments (text, marked) cut again where the runs (text, format) end: array of (text, format, marked).

    Where the runs do not spell the text the segments have no format.
    """
    spoken = F.filter(runs, lambda r: F.length(r["text"]) > 0)

    def placed(parts: Column) -> Column:
        """Parts with the offset each starts at."""
        before = lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda n, x: n + F.length(x["text"]))
        return F.transform(parts, lambda x, i: F.struct(before(i).alias("at"), x.alias("part")))

    def of_segment(s: Column) -> Column:
        end = s["at"] + F.length(s["part"]["text"])
        meets = F.filter(placed(spoken), lambda r: (r["at"] < end) & (r["at"] + F.length(r["part"]["text"]) > s["at"]))
        low = lambda r: F.greatest(r["at"], s["at"])
        high = lambda r: F.least(r["at"] + F.length(r["part"]["text"]), end)
        return F.transform(meets, lambda r: F.struct(F.substring(text, low(r) + 1, high(r) - low(r)).alias("text"), r["part"]["format"].alias("format"), s["part"]["marked"].alias("marked")))

    # An element of no run: its format is the null of the runs' own type.
    none = F.get(F.filter(runs, lambda r: F.lit(False)), F.lit(0))["format"]
    plain = F.transform(cut, lambda s: F.struct(s["text"].alias("text"), none.alias("format"), s["marked"].alias("marked")))
    return F.when(F.array_join(F.transform(spoken, lambda r: r["text"]), "") == text, F.flatten(F.transform(placed(cut), of_segment))).otherwise(plain)


def clip(spans: Column, offset: Column, length: Column, side: str) -> Column:
    """The parts of one side's spans that lie in ``length`` UTF-16 code units from ``offset``, counted from there."""
    low = lambda s: F.greatest(s[f"{side}_start"], offset)
    high = lambda s: F.least(s[f"{side}_start"] + s[f"{side}_len"], offset + length)
    inside = F.filter(spans, lambda s: low(s) < high(s))
    return F.transform(inside, lambda s: s.withField(f"{side}_start", (low(s) - offset).cast("int")).withField(f"{side}_len", (high(s) - low(s)).cast("int")))


def by_node(changes: DataFrame, side: str) -> DataFrame:
    """pair, node, spans, whole: the spans of all changes of a node, by change id, and whether one adds or removes it."""
    gone = "ParagraphDelete" if side == "b" else "ParagraphInsert"
    found = F.transform(F.array_sort(F.collect_list(F.struct("change_id", "spans"))), lambda x: x["spans"])
    return changes.where(f"{side}_node is not null").groupBy("pair", F.col(f"{side}_node").alias("node")).agg(F.flatten(found).alias("spans"), F.bool_or(F.col("kind") == gone).alias("whole"))


def flat(shown: DataFrame) -> DataFrame:
    """One row for each paragraph of the blocks, with its cell, its place there and its offset in the cell's text."""
    cells = shown.select("*", F.posexplode_outer("cells").alias("cell_no", "cell")).drop("cells")
    rows = cells.select("*", F.posexplode_outer("cell.paragraphs").alias("k", "p"))
    before = F.aggregate(F.slice("cell.paragraphs", 1, F.col("k")), F.lit(0), lambda n, x: n + units(x["text"]) + 1)
    return rows.select("pair", "position", "node", "label", "is_table", "table", "cell_no", F.col("cell.node").alias("cell_node"), F.col("cell.text").alias("cell_text"), F.size("cell.paragraphs").alias("n_paragraphs"), "k", before.alias("offset"), F.col("p.node").alias("paragraph"), "p.text", "p.runs", "p.alignment")


def preview(shown: DataFrame, changes: DataFrame, side: str) -> DataFrame:
    """Every paragraph of the blocks with its segments; all blocks are shown, changed or not.

    A cell's own spans are marked in its paragraph where it has one of the same text.
    """
    marks = by_node(changes, side)
    rows = flat(shown)
    rows = rows.join(marks.select("pair", F.col("node").alias("paragraph"), "spans", "whole"), ["pair", "paragraph"], "left")
    rows = rows.join(marks.select("pair", F.col("node").alias("cell_node"), F.col("spans").alias("cell_spans")), ["pair", "cell_node"], "left")
    none = F.array().cast(SPANS)
    alone = F.col("is_table") & (F.col("n_paragraphs") == 1) & (F.col("cell_text") == F.col("text"))
    spans = F.concat(F.coalesce("spans", none), F.when(alone, F.coalesce("cell_spans", none)).otherwise(none))
    cut = segments(F.col("text"), spans, side, F.col("whole"), clipped=True)
    return rows.withColumn("segments", formatted(cut, F.col("runs"), F.coalesce("text", F.lit("")))).drop("spans", "whole", "cell_spans", "runs")


def context(shown: DataFrame, changes: DataFrame, side: str) -> DataFrame:
    """The blocks around the one that holds each change's node, with only that change marked.

    One block on each side; within a table two rows. A change without a node on the side,
    or whose node is in no block, has no rows.
    """
    at = block_nodes(shown).select("pair", F.col("node").alias("target"), F.col("position").alias("center"))
    wanted = changes.where(f"{side}_node is not null").select("pair", "change_id", "kind", "spans", "format", F.col(f"{side}_node").alias("target")).join(at, ["pair", "target"])
    own = shown.select("pair", F.col("position").alias("center"), F.col("table").alias("own_table"))
    near = wanted.join(own, ["pair", "center"]).withColumn("position", F.explode(F.sequence(F.col("center") - TABLE_REACH, F.col("center") + TABLE_REACH)))
    rows = near.join(shown, ["pair", "position"]).where((F.abs(F.col("position") - F.col("center")) <= REACH) | (F.col("table") == F.col("own_table")))
    keys = ["pair", "position"]
    parts = flat(shown.join(rows.select(*keys).distinct(), keys, "left_semi"))
    rows = rows.select(*keys, "change_id", "kind", "spans", F.col("format").alias("difference"), "target", "center").join(parts, keys)
    of_cell = (F.col("cell_node") == F.col("target")) & (F.col("n_paragraphs") > 1)
    nodes = F.concat(F.array("paragraph"), F.coalesce(F.transform("runs", lambda r: r["node"]), F.array().cast("array<string>")))
    chosen = (F.col("position") == F.col("center")) & ((F.col("node") == F.col("target")) | (F.col("cell_node") == F.col("target")) | F.array_contains(nodes, F.col("target")))
    joined = F.array_join(F.collect_list("text").over(Window.partitionBy(*keys, "change_id", "cell_node").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "\n")
    rows = rows.withColumns({"mapped": F.col("cell_text") == joined, "chosen": F.coalesce(chosen, F.lit(False))})
    none = F.array().cast(SPANS)
    spans = F.when(~F.col("chosen"), none).when(of_cell, F.when(F.col("mapped"), clip(F.col("spans"), F.col("offset"), units(F.col("text")), side)).otherwise(none)).otherwise(F.col("spans"))
    whole = F.col("chosen") & (F.col("kind").isin("ParagraphInsert", "ParagraphDelete") | (F.col("difference").isNotNull() & (F.size("spans") == 0)))
    cut = segments(F.col("text"), spans, side, whole, clipped=True)
    return rows.withColumn("segments", formatted(cut, F.col("runs"), F.coalesce("text", F.lit("")))).select("pair", "change_id", "position", "label", "cell_node", "k", "paragraph", "chosen", "segments")

"""Format-restore planning: which current nodes can take the format of their baseline partner.

Set-oriented over pairs. Mapped paragraphs give items where formats differ; unmapped ones
borrow from the nearest trusted neighbours on both sides when these agree (an as-of lookup
in both directions, one sort each); runs meet the runs of the partner by overlapping ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import units
from docweave.storage import stored

# Fixed value: least score of a mapping that restores automatically.
LEAST_SCORE = 0.8
ITEM = ("pair", "item_id", "b_node", "c_node", "category", "properties", "eligibility", "fallback", "score")


def trusted(least: float = LEAST_SCORE, confidence: str = "confidence", score: str = "score") -> Column:
    return F.col(confidence).isin("Exact", "High") & ~F.isnan(score) & F.col(score).between(least, 1.0)


def same_level(a: str, b: str) -> Column:
    """Same style, same numbering level, and both numbered or neither."""
    of = lambda s, n: F.col(f"{s}.{n}")
    return of(a, "style").eqNullSafe(of(b, "style")) & of(a, "num_level").eqNullSafe(of(b, "num_level"))


def differences(current: Column, target: Column, fields: dict[str, str]) -> Column:
    """Dotted names of the fields that differ, null-safe."""
    def get(c: Column, path: str) -> Column:
        for part in path.split("."):
            c = c[part]
        return c

    return F.array_compact(F.array(*(F.when(~get(current, p).eqNullSafe(get(target, p)), F.lit(n)) for n, p in fields.items())))


def _items(rows: DataFrame, category: str, eligible: Column, fallback: Column) -> DataFrame:
    key = F.sha2(F.concat_ws("\x1f", F.lit(category), "b_node", "c_node", F.to_json(F.struct("current", "target"))), 256)
    return rows.where(F.size("properties") > 0).select("pair", key.alias("item_id"), "b_node", "c_node", F.lit(category).alias("category"), "properties", F.when(eligible, "Eligible").otherwise("NeedsReview").alias("eligibility"), fallback.alias("fallback"), "score")


def paragraph_plan(mappings: DataFrame, base: DataFrame, cur: DataFrame, fields: dict[str, str], least: float = LEAST_SCORE) -> tuple[DataFrame, DataFrame]:
    """(items, diagnostics) of paragraphs. Sides: pair, parent, idx, node, style, num_level, format."""
    side = lambda df, s: df.select("pair", F.col("idx").alias(f"{s}_idx"), F.struct("parent", "idx", "node", "style", "num_level", "format").alias(s))
    joined = side(cur, "c").join(mappings.select("pair", "b_idx", "c_idx", "confidence", "score"), ["pair", "c_idx"], "left").join(side(base, "b"), ["pair", "b_idx"], "left")
    joined = cur_mapped = stored(joined, "aligned")  # items and diagnostics read it twice each
    own = joined.where("b is not null").withColumns({"b_node": F.col("b.node"), "c_node": F.col("c.node"), "current": F.col("c.format"), "target": F.col("b.format"), "properties": differences(F.col("c.format"), F.col("b.format"), fields)})
    items = _items(own, "Paragraph", trusted(least), F.lit(None).cast("string"))
    notes = own.where(~trusted(least)).select("pair", F.col("c.node").alias("node"), F.lit("LowConfidenceMapping").alias("code"))

    good = F.when(F.col("b").isNotNull() & trusted(least), F.struct("c", "b", "score"))
    sorted_ = lambda d: Window.partitionBy("pair", "c.parent").orderBy(F.desc("c.idx") if d else F.asc("c.idx")).rowsBetween(Window.unboundedPreceding, -1)
    near = cur_mapped.withColumns({"before": F.last(good, True).over(sorted_(False)), "after": F.last(good, True).over(sorted_(True))}).where("b is null")
    level = lambda n: F.col(n).isNotNull() & same_level("c", f"{n}.c")
    agree = level("before") & level("after") & F.col("before.b.format").eqNullSafe(F.col("after.b.format")) & same_level("before.b", "after.b")
    near = near.withColumn("agree", F.coalesce(agree, F.lit(False)))
    lent = near.where("agree").withColumns({"b_node": F.col("before.b.node"), "c_node": F.col("c.node"), "current": F.col("c.format"), "target": F.col("before.b.format"), "score": F.col("before.score"), "properties": differences(F.col("c.format"), F.col("before.b.format"), fields)})
    items = items.unionByName(_items(lent, "Paragraph", F.lit(True), F.lit("SameLevelMappedNeighbourConsensus")))
    notes = notes.unionByName(near.select("pair", F.col("c.node").alias("node"), F.when(F.col("agree"), "AddedParagraphFallbackUsed").otherwise("UnmappedNode").alias("code")))
    return items, notes


def run_ranges(side: DataFrame) -> DataFrame:
    """pair, idx, k, start, stop, node, format of the runs that show text: running sums of their UTF-16 lengths."""
    rows = side.select("pair", "idx", F.posexplode("runs").alias("k", "run")).withColumn("n", units(F.col("run.text")))
    before = Window.partitionBy("pair", "idx").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(before), F.lit(0))
    return rows.withColumn("start", start).select("pair", "idx", "k", "start", (F.col("start") + F.col("n")).alias("stop"), "run.node", "run.format").where("stop > start")


def run_plan(mappings: DataFrame, base: DataFrame, cur: DataFrame, spans: DataFrame, fields: dict[str, str], least: float = LEAST_SCORE) -> tuple[DataFrame, DataFrame]:
    """(items, diagnostics) of runs. ``spans``: pair, b_idx, c_idx, spans of the texts of mapped paragraphs.

    Texts are cut into pieces that are equal or replaced; each piece of the current side
    meets the baseline runs its counterpart overlaps, or the two beside it for a pure
    insertion. A run whose pieces meet one format takes it; else it needs review.
    """
    b, c = run_ranges(base), run_ranges(cur)
    flat = spans.select("pair", "b_idx", "c_idx", "spans")
    # Pieces: every span, and the equal stretch that follows each and starts the text.
    edge = F.struct(F.lit(0).alias("bs"), F.lit(0).alias("be"), F.lit(0).alias("cs"), F.lit(0).alias("ce"))
    cut = F.concat(F.array(edge), F.transform("spans", lambda s: F.struct(s["b_start"].alias("bs"), (s["b_start"] + s["b_len"]).alias("be"), s["c_start"].alias("cs"), (s["c_start"] + s["c_len"]).alias("ce"))))
    far = F.lit(2**30)
    follow = F.transform(cut, lambda x, i: F.struct(x["be"].alias("bs"), F.coalesce(F.get(cut, i + 1)["bs"], far).alias("be"), x["ce"].alias("cs"), F.coalesce(F.get(cut, i + 1)["cs"], far).alias("ce"), F.lit(False).alias("edited")))
    edits = F.transform("spans", lambda s: F.struct(s["b_start"].alias("bs"), (s["b_start"] + s["b_len"]).alias("be"), s["c_start"].alias("cs"), (s["c_start"] + s["c_len"]).alias("ce"), F.lit(True).alias("edited")))
    pieces = flat.select("pair", "b_idx", "c_idx", F.explode(F.concat(follow, edits)).alias("p")).where("p.ce > p.cs")
    runs = c.select("pair", F.col("idx").alias("c_idx"), "k", F.col("start").alias("c_start"), F.col("stop").alias("c_stop"), F.col("node").alias("c_node"), F.col("format").alias("current"))
    met = runs.join(pieces, ["pair", "c_idx"]).where("c_start < p.ce and p.cs < c_stop")
    low = F.when(F.col("p.edited"), F.col("p.bs")).otherwise(F.col("p.bs") + F.greatest(F.lit(0), F.col("c_start") - F.col("p.cs")))
    high = F.when(F.col("p.edited"), F.col("p.be")).otherwise(F.col("p.bs") + F.least("c_stop", "p.ce") - F.col("p.cs"))
    met = met.withColumns({"low": low, "high": high})
    partner = b.select("pair", F.col("idx").alias("b_idx"), F.col("start").alias("b_start"), F.col("stop").alias("b_stop"), F.col("node").alias("b_node"), F.col("format").alias("target"))
    touches = F.when(F.col("high") > F.col("low"), (F.col("b_start") < F.col("high")) & (F.col("b_stop") > F.col("low"))).otherwise((F.col("b_stop") == F.col("low")) | (F.col("b_start") == F.col("low")))
    hits = met.join(partner, ["pair", "b_idx"]).where(touches)
    ranked = hits.groupBy("pair", "b_idx", "c_idx", "k", "c_node").agg(F.first("current").alias("current"), F.min_by(F.struct("b_node", "target"), "b_start").alias("best"), F.count_distinct("target").alias("formats"), F.bool_or(F.col("p.edited") & (F.col("high") == F.col("low"))).alias("added"))
    judged = ranked.join(mappings.select("pair", "b_idx", "c_idx", "confidence", "score"), ["pair", "b_idx", "c_idx"])
    one = judged.where("formats = 1").withColumns({"b_node": F.col("best.b_node"), "target": F.col("best.target")})
    one = one.withColumn("properties", differences(F.col("current"), F.col("target"), fields))
    items = _items(one, "Character", trusted(least), F.when(F.col("added"), "MappedNeighbourRunConsensus"))
    notes = judged.select("pair", F.col("c_node").alias("node"), F.when(F.col("formats") > 1, "MixedRunFormattingNeedsReview").when(F.col("added"), "AddedTextFallbackUsed").alias("code")).where("code is not null")
    return items, notes


def table_plan(base: DataFrame, cur: DataFrame, fields: dict[str, str], cell_fields: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(items, diagnostics) of tables and cells by position; sides as for the comparison of tables.

    Merges are structure and are never restored: a cell keeps its own span and merge.
    """
    side = lambda df, s: df.select("pair", "table", F.struct("node", "format", "cells").alias(s))
    both = side(base, "b").join(side(cur, "c"), ["pair", "table"])
    n = lambda df, s: df.groupBy("pair").agg(F.count("*").alias(s))
    both = both.join(n(base, "nb"), "pair").join(n(cur, "nc"), "pair")
    shape = lambda s: F.transform(f"{s}.cells", lambda x: F.struct(x["row"], x["col"], x["format"]["grid_span"], x["format"]["vertical_merge"]))
    both = both.withColumns({"even": F.col("nb") == F.col("nc"), "same": shape("b") == shape("c"), "score": F.lit(1.0)})
    tables = both.withColumns({"b_node": F.col("b.node"), "c_node": F.col("c.node"), "current": F.col("c.format"), "target": F.col("b.format")})
    tables = tables.withColumn("properties", differences(F.col("current"), F.col("target"), {k: v for k, v in fields.items() if v != "style_id"}))
    items = _items(tables, "Table", F.col("even"), F.lit(None).cast("string"))
    notes = tables.where("current.style_id is not null or target.style_id is not null").select("pair", F.col("c_node").alias("node"), F.lit("UnsupportedTableStyle").alias("code"))
    cells = lambda s: both.select("pair", "table", "even", "same", "score", F.explode(f"{s}.cells").alias("x")).select("pair", "table", "even", "same", "score", F.col("x.row").alias("row"), F.col("x.col").alias("col"), F.col("x").alias(s))
    alone = lambda df, s: df.withColumn(f"{s}_only", F.count("*").over(Window.partitionBy("pair", "table", f"{s}.text")) == 1)
    met = alone(cells("b"), "b").join(alone(cells("c"), "c").drop("even", "same", "score"), ["pair", "table", "row", "col"])
    anchor = (F.col("b.text") != "") & (F.col("b.text") == F.col("c.text")) & F.col("b_only") & F.col("c_only")
    met = met.withColumns({"b_node": F.col("b.node"), "c_node": F.col("c.node"), "current": F.col("c.format"), "target": F.col("b.format"), "ok": F.col("even") & (F.col("same") | anchor) & (F.coalesce("b.nested_tables", F.lit(0)) + F.coalesce("c.nested_tables", F.lit(0)) == 0)})
    keep = {k: v for k, v in cell_fields.items() if v not in ("grid_span", "vertical_merge")}
    met = met.withColumn("properties", differences(F.col("current"), F.col("target"), keep))
    items = items.unionByName(_items(met, "Cell", F.col("ok"), F.lit(None).cast("string")))
    merge = ~F.col("current.grid_span").eqNullSafe(F.col("target.grid_span")) | ~F.col("current.vertical_merge").eqNullSafe(F.col("target.vertical_merge"))
    codes = F.array_compact(F.array(F.when(~F.col("same"), "TableStructureChanged"), F.when(merge, "MergeStructurePreserved")))
    return items, notes.unionByName(met.select("pair", F.col("c_node").alias("node"), F.explode(codes).alias("code")))


def plan_status(items: DataFrame, notes: DataFrame) -> DataFrame:
    """pair, items, needs_review, diagnostics, status of every pair with items or diagnostics."""
    counted = items.groupBy("pair").agg(F.count("*").alias("items"), F.count_if(F.col("eligibility") != "Eligible").alias("needs_review"))
    out = counted.join(notes.groupBy("pair").agg(F.count("*").alias("diagnostics")), "pair", "full_outer").fillna(0, ["items", "needs_review", "diagnostics"])
    return out.withColumn("status", F.when((F.col("needs_review") > 0) | (F.col("diagnostics") > 0), "NeedsReview").when(F.col("items") == 0, "Empty").otherwise("Ready"))


def select_scope(items: DataFrame, category: str | None = None, ids: DataFrame | None = None, eligible_only: bool = False) -> DataFrame:
    """All items, those of a category (Table includes Cell), or those of given ids; an unknown id is an error.

    ``eligible_only`` leaves out what needs a review, as choosing a category at once does; ids
    named one by one that need a review are left out then, and are no error.
    """
    if eligible_only:
        chosen = select_scope(items, category, ids)
        return chosen.where("eligibility = 'Eligible'")
    if ids is not None:
        if ids.join(items, "item_id", "left_anti").limit(1).count():
            raise ValueError("unknown restore item")
        return items.join(ids.select("item_id"), "item_id", "left_semi")
    if category is None:
        return items
    return items.where(F.col("category").isin(*(("Table", "Cell") if category == "Table" else (category,))))

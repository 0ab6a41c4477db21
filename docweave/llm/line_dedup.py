"""Line dedup over the suffix array of line-ID sequences, built by distributed prefix doubling.

Every line gets an ID, a 128-bit hash. Level 0 sorts the IDs that occur more than once and
ranks them. Level k ranks the runs of 2**k lines by the pair of two ranks of level k - 1,
that of the run's first half and that of its second; within the interval of an old rank the
pairs are sorted, so ranks stay in the order of the suffixes. Runs that occur once leave, as
no run that holds them can repeat, and doubling goes on until no run is left that anything
asks for. The deepest level follows from the texts alone; there is no bound on it.

A run of m lines is named by its length and the ranks of its first and its last 2**k lines
(2**k <= m < 2**(k + 1)); suffixes with one name are the interval of the suffix array whose
longest common prefix has m lines or more. Of each interval of runs that hold ``min_chars``
characters the earliest member stays, and the run that starts at each later member is
deleted. A line lies in such a run of any length exactly if the shortest run of so many
characters from some line on, or up to some line, repeats and holds it (a longer run can be
cut at either end until it is one of these, with the line still inside), so these are the
runs whose intervals are looked up. Overlapping and adjoining ones make the maximal runs.

Only DataFrame operations are used. IDs and pairs are counted before the shuffle, so a line
that a third of all documents share is one row per task; the sort within a large interval is
split by ranges of the second rank; joins back on a frequent ID are left to skew splitting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import stored

#: A run must hold so many characters to be deleted.
MIN_CHARS = 100
KEY = ("doc", "ta", "tb")
#: Width of the range of second ranks that one task sorts within an interval.
CELL_BITS = 20


def _key(doc_id: Column, text: Column) -> dict[str, Column]:
    """A document's key: its id (the least number where it is null) and two hashes of its text."""
    null = doc_id.isNull()
    return {"doc": F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63))), "ta": F.xxhash64(null, text), "tb": F.xxhash64(F.lit(1), null, text)}


def _lines(docs: DataFrame) -> DataFrame:
    """KEY, line, the two halves a and b of its ID, and chars for every line, by document."""
    text = F.col("text").cast("string")
    lines = docs.select("doc_id", text.alias("text")).where("text is not null")
    lines = lines.select(*(c.alias(k) for k, c in _key(F.col("doc_id"), F.col("text")).items()), F.posexplode(F.split("text", "\n")).alias("line", "content"))
    lines = lines.select(*KEY, "line", F.xxhash64("content").alias("a"), F.xxhash64(F.lit(1), "content").alias("b"), F.length("content").cast("long").alias("chars"))
    return lines.repartition(*KEY).dropDuplicates([*KEY, "line"])


def _ranked(counted: DataFrame, within: list[str], cell: Column, order: list[str]) -> DataFrame:
    """Adds ``before``: the sum of n over the rows of the same ``within`` that come earlier by ``order``.

    ``cell`` must rise with the order; a task sorts one cell, and cells are joined by their totals.
    """
    counted = counted.withColumn("cell", cell)
    cells = [*within, "cell"]
    inside = F.sum("n").over(Window.partitionBy(*cells).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    earlier = Window.partitionBy(*(within or [F.lit(0)])).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = counted.groupBy(*cells).agg(F.sum("n").alias("n")).select(*cells, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return counted.withColumn("inside", F.coalesce(inside, F.lit(0))).join(totals, cells).withColumn("before", F.col("base") + F.col("inside")).drop("cell", "inside", "base")


def _first_level(docs: DataFrame) -> DataFrame:
    """KEY, line, chars, rank of every line that occurs more than once."""
    lines = stored(_lines(docs), "line-ids")
    ids = lines.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1")
    # 65,536 cells at most, by the leading bits of the hash.
    ids = _ranked(ids, [], F.shiftright("a", 48), ["a", "b"]).select("a", "b", F.col("before").alias("rank"))
    return lines.join(ids, ["a", "b"]).select(*KEY, "line", "chars", "rank")


def _shortest_runs(lines: DataFrame, min_chars: int) -> DataFrame:
    """KEY, line, rank, forward, back, most.

    forward: lines of the shortest run of ``min_chars`` characters from this line on; back: those of
    the shortest run up to this line, where that is no line's forward run; null where there is none
    among lines that all occur elsewhere. most: the longest of both in the document.
    """
    here = Window.partitionBy(*KEY).orderBy("line")
    # Islands of lines that follow each other; no run that repeats passes the end of one.
    lines = lines.withColumn("island", F.col("line") - F.row_number().over(here))
    island = Window.partitionBy(*KEY, "island")
    upto = F.sum("chars").over(island.orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("upto", upto).withColumn("size", F.count("*").over(island)).withColumn("begin", F.min("line").over(island))
    # The run ends at the first line whose sum is enough: as many lines come before it as have smaller sums.
    marks = F.array(
        F.struct(F.col("upto").alias("at"), F.lit(1).alias("is_end")),
        F.struct((F.col("upto") - F.col("chars") + min_chars).alias("at"), F.lit(0).alias("is_end")),
    )
    lines = lines.select(*KEY, "island", "line", "rank", "begin", "size", F.explode(marks).alias("mark"))
    smaller = F.sum("mark.is_end").over(island.orderBy("mark.at", "mark.is_end").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("smaller", smaller).where("mark.is_end = 0")
    lines = lines.withColumn("end", F.when(F.col("smaller") < F.col("size"), F.col("begin") + F.col("smaller")).cast("int"))
    # Of the forward runs that end at a line or before it, the last to start is the shortest up to that line, with what lies between.
    marks = F.array(
        F.struct(F.col("end").alias("at"), F.lit(0).alias("is_line"), F.struct(F.col("line").alias("start"), F.col("end")).alias("run")),
        F.struct(F.col("line").alias("at"), F.lit(1).alias("is_line"), F.lit(None).cast("struct<start:int,end:int>").alias("run")),
    )
    lines = lines.select(*KEY, "island", "line", "rank", "end", F.explode(F.filter(marks, lambda x: x["at"].isNotNull())).alias("mark"))
    last = F.max("mark.run").over(island.orderBy("mark.at", "mark.is_line").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("last", last).where("mark.is_line = 1")
    lines = lines.select(*KEY, "line", "rank", (F.col("end") - F.col("line") + 1).alias("forward"), F.when(F.col("last.end") < F.col("line"), F.col("line") - F.col("last.start") + 1).alias("back"))
    return lines.withColumn("most", F.max(F.greatest("forward", "back")).over(Window.partitionBy(*KEY))).where("most is not null")


def _doubled(ranks: DataFrame, level: int) -> DataFrame:
    """KEY, line, rank, most of the runs of 2**level lines that occur more than once, from the ranks one level below."""
    half = 1 << (level - 1)
    ahead = Window.partitionBy(*KEY).orderBy("line").rangeBetween(half, half)
    pairs = ranks.withColumn("second", F.first("rank").over(ahead)).where(f"second is not null and most >= {2 * half}")
    counted = pairs.groupBy("rank", "second").agg(F.count("*").alias("n")).where("n > 1")
    placed = _ranked(counted, ["rank"], F.shiftright("second", CELL_BITS), ["second"]).select("rank", "second", "before")
    return pairs.join(placed, ["rank", "second"]).select(*KEY, "line", (F.col("rank") + F.col("before")).alias("rank"), "most")


def _later(runs: DataFrame, ranks: DataFrame, level: int) -> DataFrame:
    """The runs (KEY, start, m) of 2**level lines and more, but fewer than twice that, that start earlier as well."""
    size = 1 << level
    runs = runs.where(f"m >= {size} and m < {2 * size}")
    at = ranks.select(*KEY, "line", "rank")
    named = runs.join(at.select(*KEY, F.col("line").alias("start"), F.col("rank").alias("x")), [*KEY, "start"])
    if level:
        named = named.withColumn("at", F.col("start") + F.col("m") - size).join(at.select(*KEY, F.col("line").alias("at"), F.col("rank").alias("y")), [*KEY, "at"])
    else:
        named = named.withColumn("y", F.col("x"))
    place = F.struct(*KEY, "start")
    first = named.groupBy("m", "x", "y").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return named.join(first, ["m", "x", "y"]).where(place > F.col("first")).select(*KEY, "start", "m")


def repeated_runs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """KEY and spans (start, end: lines, disjoint, in order) of the maximal deleted runs of each document that has any."""
    lines = stored(_shortest_runs(_first_level(docs), min_chars), "line-runs")
    runs = lines.select(*KEY, F.col("line").alias("start"), F.col("forward").alias("m")).where("m is not null")
    runs = runs.unionByName(lines.where("back is not null").select(*KEY, (F.col("line") - F.col("back") + 1).alias("start"), F.col("back").alias("m")))
    ranks = lines.select(*KEY, "line", "rank", "most")
    longest, level = lines.agg(F.max("most")).first()[0] or 0, 0
    found = _later(runs, ranks, 0)
    while longest >= 2 << level:
        level += 1
        ranks = stored(_doubled(ranks, level), f"line-ranks-{level}")
        if not ranks.limit(1).count():
            break
        found = found.unionByName(_later(runs, ranks, level))
    found = stored(found, "line-later")
    order = Window.partitionBy(*KEY).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    found = found.select(*KEY, "start", (F.col("start") + F.col("m")).alias("end"))
    fresh = found.withColumn("fresh", F.coalesce(F.col("start") > F.max("end").over(order), F.lit(True)).cast("int"))
    number = F.sum("fresh").over(Window.partitionBy(*KEY).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))
    whole = fresh.withColumn("number", number).groupBy(*KEY, "number").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return whole.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Every row and column of ``docs``, text without its deleted lines, and n_lines, n_deleted, n_runs.

    Lines are the parts of text between line feeds. A line is deleted if it lies in a run of
    lines, of any number, that holds ``min_chars`` characters and also starts earlier: in a
    smaller doc_id (null before all others), or earlier in the document. Runs are compared as
    given, not by what is left. A null text stays null and has no lines; an empty one has one
    line. Rows of equal id and text are one document and lose the same lines; rows of one id
    with different texts are ordered by a hash. n_runs: maximal deleted runs. Columns of
    ``docs`` named like the new ones are replaced.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_deleted", "n_runs")]
    source = docs.select(*keep, F.struct(*(c.alias(k) for k, c in _key(F.col("doc_id"), F.col("text").cast("string")).items())).alias("_key"))
    spans = repeated_runs(docs, min_chars).select(F.struct(*KEY).alias("_key"), F.col("spans").alias("_spans"))
    joined = source.join(spans, "_key", "left")
    parts, gone = F.split("text", "\n"), F.col("_spans")
    # What stays are the parts before, between and after the deleted runs.
    edge = F.struct(F.size(parts).alias("start"), F.lit(0).alias("end"))
    pieces = F.transform(F.concat(gone, F.array(edge)), lambda x, i: F.struct(F.when(i > 0, F.get(gone, i - 1)["end"]).otherwise(0).alias("low"), x["start"].alias("high")))
    left = F.array_join(F.flatten(F.transform(pieces, lambda x: F.slice(parts, x["low"] + 1, x["high"] - x["low"]))), "\n")
    new = {
        "text": F.when(gone.isNotNull(), left).otherwise(F.col("text")),
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long"),
        "n_deleted": F.when(gone.isNotNull(), F.aggregate(gone, F.lit(0), lambda n, x: n + x["end"] - x["start"])).otherwise(0).cast("long"),
        "n_runs": F.when(gone.isNotNull(), F.size(gone)).otherwise(0).cast("long"),
    }
    return joined.withColumns(new).select(*keep, "n_lines", "n_deleted", "n_runs")

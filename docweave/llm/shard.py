"""Balanced sharding by label propagation: linked documents gather in one shard while row counts stay equal.

Documents of equal text are linked, all with all. Members of such a group are alike, so the
state is a histogram (group, shard, number), not a row per document. Every document starts
with a label of its own, a hash of its id and text; these are the votes of its neighbours.

Propagation: each round joins the groups that wait with their votes, and a group asks for
the shard where it has most neighbours among those with room for all of it. Requests are
granted whole, large groups first, up to the shard's quota; who is refused asks again
elsewhere. Only a group larger than every remaining room is cut: it fills the roomiest shard
and waits with the rest. Movement: of a cut group the members in its smallest cell move to
the shard with most of its members that has room, round by round, as long as the number of
cut edges falls. Exchange: where shards are full, a cell of a cut group goes to another of
its shards against rows of that shard: a cell of an uncut group, part of one, or two of them,
or together with an uncut group's cell of its own shard against a larger one. Partners are
looked up by size in a histogram of the shards' cells, with one join for each form, and the
best exchange of a round is made as long as the number of cut edges falls. Documents without
links then fill what the quotas leave.

Law ``rows``: shard sizes in rows differ by one at most. Everything is DataFrame
operations; running totals are taken within buckets and carried by a table of bucket totals,
so that no task holds a shard or a group of copies. Labels depend on ids and texts only, so
the result does not depend on how the rows lie in files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import stored

#: Rows that one bucket of a running total holds, about, and the fewest buckets.
BUCKET_ROWS, BUCKETS = 100_000, 64
#: Groups of more rows than this are joined with their cells in several tasks.
HOT_ROWS = 10_000
GROUP = ("ga", "gb")


def running(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the rows that come earlier within ``keys``, by ``bucket``, then ``order``."""
    where = [*keys, "bucket"]
    totals = df.groupBy(*where).agg(F.sum(value).alias("total"))
    over_buckets = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*where, F.coalesce(F.sum("total").over(over_buckets), F.lit(0)).alias("offset"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(*where).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("inside", inside).join(offsets, where).withColumn("before", F.col("offset") + F.col("inside")).drop("inside", "offset")


def _rooms(room: dict[int, int]):
    """The shards with room, roomiest first, as an array of (shard, room)."""
    return F.array(*(F.struct(F.lit(k).alias("shard"), F.lit(v).cast("long").alias("room")) for k, v in sorted(room.items(), key=lambda x: (-x[1], x[0]))))


def _total(df: DataFrame) -> dict[int, int]:
    return {r.shard: r.n for r in df.groupBy("shard").agg(F.sum("number").alias("n")).collect()}  # a row for each shard


def _propagated(waiting: DataFrame, votes: DataFrame, room: dict[int, int]) -> DataFrame | None:
    """Cells (group, shard, number) of the groups (group, bucket, number); ``room`` is brought down to what is left."""
    spark, settled, step = waiting.sparkSession, None, 0
    while True:
        largest = waiting.orderBy(F.desc("number"), *GROUP).limit(len(room)).collect()  # one for each shard at most: those that a round can place when none fits whole
        if not largest:
            return settled
        open_ = sorted(((v, -k) for k, v in room.items() if v > 0), reverse=True)
        if largest[0].number > open_[0][0]:
            cut = [(r.ga, r.gb, -k, v) for r, (v, k) in zip([x for x in largest if x.number > open_[0][0]], open_, strict=False)]
            cells = F.array(*(F.struct(F.lit(a).alias("ga"), F.lit(b).alias("gb"), F.lit(s).alias("shard"), F.lit(n).cast("long").alias("number")) for a, b, s, n in cut))
            accepted = spark.range(1).select(F.explode(cells).alias("cell")).select("cell.*")
        else:
            fits = F.filter(_rooms({k: v for k, v in room.items() if v > 0}), lambda x: x["room"] >= F.col("number"))
            wide = waiting.withColumn("fits", fits)
            wished = wide.join(votes, list(GROUP)).where(F.array_contains(F.transform("fits", lambda x: x["shard"]), F.col("label")))
            wished = wished.groupBy(*GROUP).agg(F.max_by("label", F.struct("votes", -F.col("label"))).alias("near"))
            spread = F.get("fits", F.pmod(F.xxhash64(*GROUP, F.lit(step)), F.size("fits").cast("long")).cast("int"))["shard"]
            # Whoever was refused by its neighbours' shard tries others by turns.
            target = F.coalesce("near", spread) if step % 2 == 0 else spread
            asking = wide.join(wished, list(GROUP), "left").select(*GROUP, "bucket", "number", target.alias("shard"))
            rooms = F.element_at(F.create_map(*(F.lit(x) for k, v in room.items() for x in (k, v))), F.col("shard"))
            accepted = running(asking, ["shard"], "number", ["bucket", F.desc("number"), *GROUP]).where(F.col("before") + F.col("number") <= rooms).select(*GROUP, "shard", "number")
        accepted = stored(accepted, "shard-accepted")
        for k, n in _total(accepted).items():
            room[k] -= n
        settled = accepted if settled is None else settled.unionByName(accepted)
        left = waiting.join(accepted.select(*GROUP, F.col("number").alias("taken")), list(GROUP), "left")
        waiting = stored(left.select(*GROUP, "bucket", (F.col("number") - F.coalesce("taken", F.lit(0))).alias("number")).where("number > 0"), "shard-waiting")
        step += 1


def _edges(cells: DataFrame) -> float:
    """Links between different shards: all pairs of a group less those within one cell."""
    whole = cells.groupBy(*GROUP).agg(F.sum("number").cast("double").alias("n"), F.sum(F.col("number").cast("double") * F.col("number")).alias("inside"))
    return whole.agg(F.sum((F.col("n") * F.col("n") - F.col("inside")) / 2)).first()[0] or 0.0


def _moved(cells: DataFrame, room: dict[int, int]) -> tuple[DataFrame, list[float]]:
    """The cells after movement, and the number of cut edges before it and after each round."""
    cells = cells.groupBy(*GROUP, "shard").agg(F.sum("number").alias("number"))
    cut = [_edges(cells)]
    while cut[-1] and any(v > 0 for v in room.values()):
        split = cells.groupBy(*GROUP).agg(
            F.max_by("shard", F.when(F.col("shard").isin([k for k, v in room.items() if v > 0]), F.struct("number", -F.col("shard")))).alias("target"),
            F.min(F.struct("number", "shard")).alias("least"),
            F.count("*").alias("n"),
        )
        asking = split.where("n > 1 and target is not null and target <> least.shard").select(*GROUP, F.col("least.shard").alias("source"), F.col("target").alias("shard"), F.col("least.number").alias("number"), F.pmod("ga", F.lit(BUCKETS)).alias("bucket"))
        rooms = F.element_at(F.create_map(*(F.lit(x) for k, v in room.items() for x in (k, v))), F.col("shard"))
        granted = F.greatest(F.lit(0), F.least(F.col("number"), rooms - F.col("before"))).cast("long")
        moves = stored(running(asking, ["shard"], "number", [*GROUP]).select(*GROUP, "source", "shard", granted.alias("number")).where("number > 0"), "shard-moves")
        arrived = moves.select(*GROUP, "shard", "number")
        gone = moves.select(*GROUP, F.col("source").alias("shard"), (-F.col("number")).alias("number"))
        after = stored(cells.unionByName(arrived).unionByName(gone).groupBy(*GROUP, "shard").agg(F.sum("number").alias("number")).where("number > 0"), "shard-moved")
        edges = _edges(after)
        if edges >= cut[-1]:
            break
        for change in (arrived, gone):
            for k, n in _total(change).items():
                room[k] -= n
        cells = after
        cut.append(edges)
    return cells, cut


def _split(cells: DataFrame) -> DataFrame:
    """The cells of the groups that lie in several shards; at most two for each shard, as a cut fills a shard."""
    cut = cells.groupBy(*GROUP).agg(F.count("*").alias("n")).where("n > 1")
    return cells.join(cut.select(*GROUP), list(GROUP), "left_semi")


def _move(ga, gb, source, shard, number):
    return F.struct(ga.alias("ga"), gb.alias("gb"), source.cast("int").alias("source"), shard.cast("int").alias("shard"), number.cast("long").alias("number"))


def _exchanges(cells: DataFrame, room: dict[int, int], quota: dict[int, int]) -> DataFrame:
    """gain (links no longer cut), and the moves that make it, of exchanges that bring two cells of a group together.

    ``low`` to ``high`` are the numbers of rows that may come back for the ``x`` that go.
    """
    split = stored(_split(cells), "shard-split")
    at = lambda table, shard: F.element_at(F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, v))), shard).cast("long")
    wish = split.select(*GROUP, F.col("shard").alias("source"), F.col("number").alias("x")).join(split.select(*GROUP, "shard", F.col("number").alias("there")), list(GROUP))
    wish = wish.where((F.col("source") != F.col("shard")) & (F.col("x") + F.col("there") <= at(quota, F.col("shard"))))
    wish = wish.withColumns({"low": F.col("x") - at(room, F.col("shard")), "high": F.col("x") + at(room, F.col("source"))})
    # Sizes of the uncut groups in each shard, with two groups of each size.
    pair = F.struct(*GROUP)
    sizes = stored(cells.join(split.select(*GROUP).distinct(), list(GROUP), "left_anti").groupBy("shard", "number").agg(F.min(pair).alias("one"), F.max(pair).alias("two")), "shard-sizes")
    own = _move(F.col("ga"), F.col("gb"), F.col("source"), F.col("shard"), F.col("x"))
    back = lambda who, number: _move(F.col(f"{who}.ga"), F.col(f"{who}.gb"), F.col("shard"), F.col("source"), number)
    gain = F.col("x") * F.col("there")
    free = wish.where("low <= 0").select(gain.alias("gain"), F.array(own).alias("moves"))
    # One group, whole or in part.
    single = wish.join(sizes, "shard").withColumn("y", F.explode(F.array_distinct(F.array(F.greatest("low", F.lit(1)), F.least("high", "number")))))
    single = single.where("y >= 1 and y >= low and y <= high and y <= number").select((gain - F.col("y") * (F.col("number") - F.col("y"))).alias("gain"), F.array(own, back("one", F.col("y"))).alias("moves"))
    exact = wish.withColumn("y", F.explode(F.array_distinct(F.array("low", "x", "high")))).where("y > 0")
    # Two whole groups.
    second = sizes.select("shard", F.col("number").alias("other"), F.col("one").alias("third"), F.col("two").alias("fourth"))
    double = exact.join(sizes, "shard").withColumn("other", F.col("y") - F.col("number")).where("other >= number").join(second, ["shard", "other"])
    double = double.withColumn("partner", F.when(F.col("other") == F.col("number"), F.col("fourth")).otherwise(F.col("third"))).where("one <> partner")
    double = double.select(gain.alias("gain"), F.array(own, back("one", F.col("number")), back("partner", F.col("other"))).alias("moves"))
    # A whole group goes along, a larger one comes back.
    along = sizes.select(F.col("shard").alias("source"), F.col("number").alias("more"), F.col("one").alias("with"))
    larger = exact.join(along, "source").withColumn("number", F.col("more") + F.col("y")).join(sizes, ["shard", "number"])
    beside = _move(F.col("with.ga"), F.col("with.gb"), F.col("source"), F.col("shard"), F.col("more"))
    larger = larger.select(gain.alias("gain"), F.array(own, beside, back("one", F.col("number"))).alias("moves"))
    return free.unionByName(single).unionByName(double).unionByName(larger).where("gain > 0")


def _exchanged(cells: DataFrame, room: dict[int, int], quota: dict[int, int], cut: list[float]) -> DataFrame:
    """The cells after exchanges; ``room`` follows, and ``cut`` gets the number of cut edges after each."""
    spark = cells.sparkSession
    while cut[-1]:
        best = _exchanges(cells, room, quota).orderBy(F.desc("gain"), F.size("moves"), "moves").limit(1).collect()  # one row of three moves at most
        if not best:
            break
        moves = [m.asDict() for m in best[0].moves]
        listed = F.array(*(F.struct(F.lit(m["ga"]).alias("ga"), F.lit(m["gb"]).alias("gb"), F.lit(k).alias("shard"), F.lit(n).cast("long").alias("number")) for m in moves for k, n in ((m["shard"], m["number"]), (m["source"], -m["number"]))))
        changed = spark.range(1).select(F.explode(listed).alias("cell")).select("cell.*")
        after = stored(cells.unionByName(changed).groupBy(*GROUP, "shard").agg(F.sum("number").alias("number")).where("number > 0"), "shard-exchanged")
        edges = _edges(after)
        if edges >= cut[-1]:
            break
        for m in moves:
            room[m["shard"]] -= m["number"]
            room[m["source"]] += m["number"]
        cells = after
        cut.append(edges)
    return cells


def balanced_shards(docs: DataFrame, shards: int = 16, trace: list | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text plus one; a null text counts as none, with CRC 0, and groups
    with the empty text. Null and repeated ids are placed like any row. grown_shard is null
    under the law ``rows``. No rows: no rows. Other columns are not read. ``trace`` receives
    the numbers of cut edges before movement and after each of its rounds and each exchange.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"),
        # Rows alike in id and text are dealt over several windows; which of them goes where makes no difference.
        F.pmod(F.monotonically_increasing_id(), F.lit(BUCKETS)).cast("int").alias("part"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("ga"),
        F.xxhash64(F.lit(1), text).alias("gb"),
    )
    rows = stored(rows, "shard-rows")
    total = rows.count()
    buckets = max(BUCKETS, total // BUCKET_ROWS)
    quota = {k: total // shards + (k < total % shards) for k in range(shards)}
    members = stored(rows.groupBy(*GROUP, "id", "part").agg(F.count("*").alias("copies")), "shard-members")
    label = F.pmod(F.xxhash64(*GROUP, "id"), F.lit(shards)).cast("int")
    votes = members.groupBy(*GROUP, label.alias("label")).agg(F.sum("copies").alias("votes"))
    # Buckets rise as sizes fall, so that running totals meet large groups first.
    by_size = (63 - F.floor(F.log2("number"))).cast("long") * buckets + F.pmod("ga", F.lit(buckets))
    groups = stored(votes.groupBy(*GROUP).agg(F.sum("votes").alias("number")).withColumn("bucket", by_size), "shard-groups")
    linked = groups.where("number > 1")
    votes = stored(votes.join(linked.select(*GROUP), list(GROUP), "left_semi"), "shard-votes")

    room = dict(quota)
    settled = _propagated(linked, votes, room)
    single = groups.where("number = 1")
    if settled is not None:
        settled, cut = _moved(settled, room)
        settled = _exchanged(settled, room, quota, cut)
        if trace is not None:
            trace.extend(cut)
    rest = running(single, [], "number", list(GROUP))
    spans, at = [], 0
    for k in range(shards):
        spans.append(F.struct(F.lit(k).alias("shard"), F.lit(at).cast("long").alias("low"), F.lit(at + room[k]).cast("long").alias("high")))
        at += room[k]
    filled = rest.withColumn("span", F.explode(F.filter(F.array(*spans), lambda s: (s["low"] <= F.col("before")) & (s["high"] > F.col("before")))))
    cells = filled.select(*GROUP, F.col("span.shard").alias("shard"), "number")
    if settled is not None:
        cells = settled.unionByName(cells)
    # Slots of a shard's cell, and the ranks within its group that the cell holds.
    cells = running(cells.withColumn("bucket", F.pmod("ga", F.lit(buckets))), ["shard"], "number", list(GROUP)).withColumnRenamed("before", "slot_base")
    inside = Window.partitionBy(*GROUP).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard at most
    cells = cells.withColumn("low", F.coalesce(F.sum("number").over(inside), F.lit(0))).withColumn("whole", F.sum("number").over(Window.partitionBy(*GROUP)))
    # A row of a large group meets a copy of its group's cells, one of several.
    salts = F.when(F.col("whole") > HOT_ROWS, F.sequence(F.lit(0), F.lit(BUCKETS - 1))).otherwise(F.array(F.lit(0)))
    cells = stored(cells.select(*GROUP, "shard", "slot_base", "low", (F.col("low") + F.col("number")).alias("high"), salts.alias("salts")), "shard-cells")

    ranks = running(members.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS))), list(GROUP), "copies", ["id", "part"]).drop("copies")
    ranks = ranks.join(groups.select(*GROUP, "number"), list(GROUP))
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(*GROUP, "id", "part").orderBy("size"))).join(ranks, [*GROUP, "id", "part"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("place") - 1).withColumn("salt", F.when(F.col("number") > HOT_ROWS, F.pmod("rank", F.lit(BUCKETS)).cast("int")).otherwise(0))
    placed = ranked.join(cells.withColumn("salt", F.explode("salts")), [*GROUP, "salt"]).where("rank >= low and rank < high")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("slot_base") + F.col("rank") - F.col("low")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

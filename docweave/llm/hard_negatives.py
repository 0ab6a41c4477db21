"""Hard-negative mining by norm-bucketed search.

Vectors become integers (floor(256 * x)) and are sorted by norm, longest first, into buckets
of ``BUCKET_ROWS``; a bucket keeps its greatest norm. A search takes windows, each of one
anchor: a lower and an upper limit of scores, and whether the rows sought have the anchor's
label. By the Cauchy-Schwarz inequality no row of a bucket scores above
``|anchor| * greatest norm``, so a window needs a bucket only where that reaches its lower
limit and, once it has k rows, the score of its kth one. As norms fall, the buckets that a
window needs are a prefix of all. Rounds of twice as many buckets each walk that prefix:
anchors of windows that are still open meet the next buckets by number, and between rounds
the best k of each window and its kth score are written to the shared folder.

The same search runs twice: for positives (any score, same label), then for negatives in the
windows that the positives' scores give. Anchors travel in blocks and are dealt over buckets,
so a task holds one block and one bucket; nothing is broadcast but the buckets' numbering,
one row for each of ``PARTS`` ranges at most. Every window is answered in full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import stored, tidied

BUCKET_ROWS = 4096
#: Anchors that travel together.
BLOCK_ROWS = 256
#: Ranges of norms, at most, and the rows of one, about.
PARTS, PART_ROWS = 4096, 16 * BUCKET_ROWS
SCALE = 256
#: Inner products of shorter vectors than this are whole numbers that doubles hold.
EXACT = float(1 << 53)
#: Bounds are raised by this share, so that rounding of norms loses nothing.
SLACK = 1 + 1e-9
_LIMIT = 1 << 62
#: Components beyond this count as it.
WIDEST = 1e300


def _packed(values: np.ndarray) -> bytes:
    """16-bit numbers where they fit, marked by an odd number of bytes; doubles else."""
    small = values.astype(np.int16) if np.abs(values).max(initial=0) < 1 << 15 else None
    return values.tobytes() if small is None else small.tobytes() + b"\0"


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw[:-1], np.int16).astype(float) if len(raw) % 2 else np.frombuffer(raw, float)


def _matrix(raw: list[bytes]) -> np.ndarray:
    """The vectors as rows of doubles; shorter ones end in zeros."""
    if raw and all(len(r) == len(raw[0]) and len(r) % 2 for r in raw):
        joined = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)[:, :-1]
        return np.ascontiguousarray(joined).view(np.int16).astype(float)
    rows = [_unpacked(r) for r in raw]
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)))
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of ``a`` with those of ``b``; beyond 2**62 the nearest limit."""
    wide = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (a, b))
    longest = [float(np.sqrt((x * x).sum(1)).max(initial=0)) for x in (a, b)]
    if longest[0] * longest[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape) for x in (a, b)]
    return np.clip(whole[0].dot(whole[1].T), -_LIMIT, _LIMIT).astype(np.int64)


@tidied
def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("embedding")
        flat = np.clip(np.floor(lists.flatten().to_numpy(zero_copy_only=False) * SCALE), -WIDEST, WIDEST)
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        rows = np.split(flat, ends[:-1]) if len(ends) else []
        norms = np.array([math.sqrt(float(r @ r)) if np.abs(r).max(initial=0) < 1e150 else math.hypot(*r) for r in rows])
        yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("vec_id"), batch.column("label"), pa.array(norms), pa.array([_packed(r) for r in rows], pa.binary())], names=["uid", "vec_id", "label", "norm", "vec"])


def quantised(rows: DataFrame) -> DataFrame:
    """uid, vec_id, label, norm and vec of the rows that take part."""
    plain = rows.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    valid = plain.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return stored(valid.withColumn("label", label).mapInArrow(_quantise, "uid long, vec_id long, label long, norm double, vec binary"), "negatives-rows")


def _fill(size: int):
    """Buckets of ``size`` rows of one range, its rows coming longest first."""

    def bucket(rows: pa.Table, seq: int) -> pa.RecordBatch:
        cells = [rows["part"][0].as_py(), seq, rows["norm"][0].as_py(), rows["uid"].to_pylist(), rows["vec_id"].to_pylist(), rows["label"].to_pylist(), rows["vec"].to_pylist()]
        kinds = [pa.int32(), pa.int64(), pa.float64(), *(pa.list_(pa.int64()),) * 3, pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names=["part", "seq", "reach", "uids", "vec_ids", "labels", "vecs"])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seq = [], 0, 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= size:
                rows = pa.Table.from_batches(held)
                yield bucket(rows.slice(0, size), seq)
                rest = rows.slice(size)
                held, n, seq = rest.to_batches(), rest.num_rows, seq + 1
        if n:
            yield bucket(pa.Table.from_batches(held), seq)

    return run


def norm_buckets(rows: DataFrame) -> tuple[DataFrame, int]:
    """Buckets numbered from 0 by falling norm, and how many there are. Equal norms are split by uid."""
    spark = rows.sparkSession
    parts = max(1, min(PARTS, math.ceil(rows.count() / PART_ROWS)))
    ranged = rows.withColumn("down", -F.col("norm")).repartitionByRange(parts, "down", "uid").sortWithinPartitions("down", "uid")
    ranged = ranged.select(F.spark_partition_id().alias("part"), "uid", "vec_id", "label", "norm", "vec")
    filled = stored(ranged.mapInArrow(_fill(BUCKET_ROWS), "part int, seq long, reach double, uids array<long>, vec_ids array<long>, labels array<long>, vecs array<binary>"), "negatives-buckets")
    counted = sorted((r.part, r.n) for r in filled.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row for each of PARTS at most
    first, total = [], 0
    for part, n in counted:
        first.append((part, total))
        total += n
    numbers = F.broadcast(spark.createDataFrame(first, "part int, first long"))
    return filled.join(numbers, "part").select((F.col("first") + F.col("seq")).alias("bucket"), "reach", "uids", "vec_ids", "labels", "vecs"), total


def _best(score: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k by falling score, then id."""
    if len(score) > 4 * k:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= kth)
        return near[np.lexsort((uids[near], ids[near], -score[near]))[:k]]
    return np.lexsort((uids, ids, -score))[:k]


def _scan(k: int, same: bool):
    """A function over (block of anchors with windows, bucket): the best k rows of the bucket for each window."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cell = {name: batch.column(name)[row] for name in batch.schema.names}
                reach = cell["reach"].as_py() * SLACK
                found = [[] for _ in range(6)]
                # One bucket may hold as many rows as BUCKET_ROWS, one block as many anchors as BLOCK_ROWS.
                anchors = [a for a in cell["anchors"].as_py() if any(a["norm"] * reach >= w["need"] for w in a["windows"])]
                if anchors:
                    uids, ids, labels = (cell[name].values.to_numpy() for name in ("uids", "vec_ids", "labels"))
                    scores = products(_matrix([a["vec"] for a in anchors]), _matrix(cell["vecs"].values.to_pylist()))
                    for a, score in zip(anchors, scores, strict=True):
                        alike = (labels == a["label"]) & (uids != a["uid"]) if same else labels != a["label"]
                        for w in a["windows"]:
                            at = np.flatnonzero(alike & (score >= max(w["low"], w["need"])) & (score <= w["high"]))
                            at = at[_best(score[at], ids[at], uids[at], k)]
                            for held, values in zip(found, (np.full(len(at), a["uid"]), np.full(len(at), w["slot"]), uids[at], ids[at], score[at]), strict=False):
                                held.append(values)
                if anchors:
                    arrays = [pa.array(np.concatenate(x), pa.int64()) for x in found[:5]]
                    yield pa.RecordBatch.from_arrays(arrays, names=["anchor", "slot", "uid", "vec_id", "score"])

    return run


_FOUND = "anchor long, slot long, uid long, vec_id long, score long"


def search(windows: DataFrame, anchors: DataFrame, buckets: DataFrame, n_buckets: int, k: int, same: bool) -> DataFrame:
    """The first k rows of each window (anchor, slot, low, high): anchor, slot, uid, vec_id, score, place from 1.

    ``same``: rows of the anchor's label, itself excepted, else rows of other labels. Higher
    scores come first, ties by smaller vec_id.
    """
    ranked = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "uid")
    best, low, step = None, 0, 1
    while low < n_buckets:
        high = min(n_buckets, low + step)
        open_ = windows.withColumn("need", F.col("low"))
        if best is not None:
            kth = best.groupBy("anchor", "slot").agg(F.max(F.when(F.col("place") == k, F.col("score"))).alias("kth"))
            open_ = open_.join(kth, ["anchor", "slot"], "left").withColumn("need", F.greatest("low", F.coalesce("kth", F.col("low")))).drop("kth")
        wanted = open_.groupBy("anchor").agg(F.collect_list(F.struct("slot", "low", "high", "need")).alias("windows"), F.min("need").alias("need"))  # a few windows an anchor
        members = wanted.join(anchors, wanted.anchor == anchors.uid)
        # What the norm of a bucket must reach; a null for anchors of length 0, which reach 0 anywhere.
        least = F.when(F.col("need") <= 0, F.lit(0.0)).otherwise(F.try_divide(F.col("need").cast("double"), F.col("norm")))
        blocks = members.groupBy("block").agg(F.collect_list(F.struct("uid", "label", "norm", "vec", "windows")).alias("anchors"), F.min(least).alias("least"))
        tiles = blocks.withColumn("bucket", F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high - 1).cast("long"))))
        met = tiles.join(buckets.where((F.col("bucket") >= low) & (F.col("bucket") < high)), "bucket").where(F.col("reach") * SLACK >= F.col("least"))
        found = met.select("anchors", "reach", "uids", "vec_ids", "labels", "vecs").mapInArrow(_scan(k, same), _FOUND)
        if best is not None:
            found = found.unionByName(best.drop("place"))
        best = stored(found.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= k), "negatives-best")
        low, step = high, step * 2
    return best


def hard_negatives(rows: DataFrame, positives: int = 5, negatives: int = 10, anchor_every: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, embedding and label; other columns are not read. Rows with a null
    id, label or vector, or with a null or non-finite component, take no part. Vectors may
    differ in length: missing components count as 0, and an empty vector scores 0. Rows that
    repeat an id are rows of their own, each an anchor where the id says so; an anchor is no
    positive of itself, but a repeated row of it is one. No rows, no anchors or no rows in
    any window: an empty result. Scores beyond 2**62 count as that.
    """
    points = quantised(rows)
    buckets, n = norm_buckets(points)
    chosen = points.where(F.col("vec_id") % anchor_every == 0)
    blocks = max(1, math.ceil(chosen.count() / BLOCK_ROWS))
    # Anchors of like norm share a block, since they need like buckets: blocks are cut from a sort within hashed groups.
    groups = max(1, blocks // 64)
    within = Window.partitionBy("group").orderBy("norm", "uid")
    anchors = chosen.withColumn("group", F.pmod(F.xxhash64("uid"), F.lit(groups))).withColumn("block", F.struct("group", F.floor((F.row_number().over(within) - 1) / BLOCK_ROWS).alias("run")))
    anchors = stored(anchors.select("block", "uid", "vec_id", "label", "norm", "vec"), "negatives-anchors")
    if not n:
        return points.select(*(F.col("vec_id").cast(t).alias(c) for c, t in (("anchor_id", "long"), ("positive_id", "long"), ("rank", "int"), ("negative_id", "long"), ("positive_score", "long"), ("negative_score", "long"))))
    everything = anchors.select(F.col("uid").alias("anchor"), F.lit(0).cast("long").alias("slot"), F.lit(-_LIMIT).alias("low"), F.lit(_LIMIT).alias("high"))
    first = search(everything, anchors, buckets, n, positives, same=True)
    # 30 p <= 100 n <= 90 p, in whole numbers that cannot overflow.
    low = F.expr("3 * (score div 10) + (3 * (score % 10) + 9) div 10").alias("low")
    limits = first.where("score >= 0").select("anchor", F.col("place").cast("long").alias("slot"), low, F.expr("score - score div 10 - cast(score % 10 > 0 as long)").alias("high"))
    second = search(stored(limits.where("low <= high"), "negatives-windows"), anchors, buckets, n, negatives, same=False)
    named = first.join(anchors.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    named = named.select("anchor", F.col("place").cast("long").alias("slot"), "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return second.join(named, ["anchor", "slot"]).select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

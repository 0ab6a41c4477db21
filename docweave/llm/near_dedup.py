"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full shingle sets, union-find grouping.

A SuperMinHash signature gives every element of a set one rank per signature slot,
drawn from a random permutation, so the ranks of an element are correlated and the
estimate varies less than with independent hashes. An element stops early once no
slot can still take a rank as high as the next one (Ertl 2017).

Distributed shape:

* one pass over the texts gives set size, a 128-bit set fingerprint and the band keys;
* equal sets collapse to one representative, so groups of exact copies cost one row;
* rows of a band bucket are not paired with each other: a round compares each bucket's
  pivot with its members of other components, links that the full sets confirm merge
  components, and buckets with one component left go;
* after the first round, buckets that still hold several components are replaced by
  buckets of rare shingles (prefix filtering, which loses no link);
* the last round compares what is still outside a bucket's largest component with the
  members of the others; pairs that exact bounds rule out are not made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import SPACES, list_column, lower_ascii, mix, row_bounds, stored, text_blocks, tidied, word_hashes, words
from docweave.llm.components import connected_components

_U = np.uint64
SHINGLE_WORDS, BANDS, BAND_ROWS = 5, 40, 5
#: What tells sets apart: their size and two sums of hashes.
SET = ("n_shingles", "set_a", "set_b")


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted by row and value, and the row of each."""
    data = lower_ascii(data)
    start, end, row = words(data, offsets, SPACES)
    n = len(offsets) - 1
    if not len(start):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    one = word_hashes(data, start, end)
    bounds = row_bounds(row, n)
    count = np.diff(bounds)
    hashes = np.zeros(len(one), _U)
    length = np.minimum(count, size)[row]
    place = np.arange(len(one)) - bounds[:-1][row]
    valid = place + length <= count[row]
    for k in range(size):
        there = valid & (k < length)
        at = np.flatnonzero(there)
        hashes[at] = hashes[at] * _U(0xA0761D6478BD642F) + one[at + k]
    hashes = mix(hashes[valid] + length[valid].astype(_U))
    row = row[valid]
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], row[new]


def super_minhash(hashes: np.ndarray, row: np.ndarray, n: int, slots: int) -> np.ndarray:
    """Signatures (n x slots, 64-bit: rank in the high byte, fraction below) of the sets that ``row`` sorts the hashes into."""
    signature = np.full((n, slots), np.iinfo(np.uint64).max, _U)
    flat = signature.reshape(-1)
    live, owner, order = hashes, row, None
    for j in range(slots):
        if not len(live):
            break
        draw = mix(live + _U((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        k = j + ((draw >> _U(40)) % _U(slots - j)).astype(np.int64)
        if j == 0:
            slot = k
        else:
            at = np.arange(len(live))
            slot = order[at, k].astype(np.int64)
            order[at, k] = order[:, j]
        np.minimum.at(flat, owner * slots + slot, (_U(j) << _U(56)) | (mix(draw) >> _U(8)))
        wanted = np.zeros(n, bool)
        rows = np.unique(owner)
        wanted[rows] = (signature[rows] >> _U(56)).max(axis=1) > j
        on = wanted[owner]
        if j == 0:
            live, owner, first = live[on], owner[on], k[on]
            order = np.tile(np.arange(slots, dtype=np.uint8), (len(live), 1))
            order[np.arange(len(live)), first] = 0
        elif not on.all():
            live, owner, order = live[on], owner[on], order[on]
    return signature


def _profile(bands: int, band_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_blocks(batch.column(1)):
                n = last - first
                hashes, row = shingle_sets(data, offsets)
                bounds = row_bounds(row, n)
                size = np.diff(bounds)
                sums = [np.concatenate([[_U(0)], np.cumsum(mix(hashes ^ _U(seed)), dtype=_U)]) for seed in (0x5851F42D, 0x14057B7E)]
                one, two = ((s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums)
                signature = super_minhash(hashes, row, n, bands * band_rows)
                keys = np.zeros((n, bands), _U)
                for k in range(band_rows):
                    keys = mix(keys * _U(0xE7037ED1A0B428DB) + signature[:, k::band_rows][:, :bands])
                keys = mix(keys + np.arange(1, bands + 1, dtype=_U)[None, :] * _U(0x8EBC6AF09C88C6E3))
                keys = keys[size > 0].reshape(-1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), batch.column(2).slice(first, n), pa.array(size, pa.int64()), pa.array(one), pa.array(two), list_column(keys, np.where(size > 0, bands, 0), pa.int64())],
                    ["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "bands"],
                )

    return run


def _confirm(percent: int):
    """Rows (pivot, id, text of pivot, text of id) in; the pairs whose full sets are similar enough out."""

    def one_set(text: str, kept: dict) -> np.ndarray:
        if text not in kept:
            if len(kept) >= 256:
                kept.clear()
            raw = np.frombuffer((text or "").encode(), np.uint8)
            kept[text] = shingle_sets(raw, np.array([0, len(raw)]))[0]
        return kept[text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = one_set(a, kept), one_set(b, kept)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in text_blocks(batch.column(1)):
            hashes, row = shingle_sets(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first).take(pa.array(row, pa.int64())), pa.array(hashes.view(np.int64))], ["id", "shingle"])


def _prefix_buckets(state: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Buckets by rare shingle for the members of band buckets that still hold several components.

    In the order of rarity among these members, two linked sets share one of their first
    n - ceil(percent * n / 100) + 1 shingles, so these are the only keys needed. Edits make
    rare shingles: near misses of one origin fill this prefix with shingles of their own (u
    counts those that no other member has) and leave, while the shingles that all copies
    share are keys only of members close to the origin, which are linked by then.
    """
    several = state.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    left = stored(state.join(several, "key").select("id", "n", "component").distinct(), "several")
    own = stored(texts.join(left.select("id"), "id", "left_semi").select("id", "text").mapInArrow(tidied(_shingles), "id long, shingle long"), "shingles")
    count = own.groupBy("shingle").agg(F.min("id").alias("id"), F.count("*").alias("c"))
    alone = count.where("c = 1").groupBy("id").agg(F.count("*").alias("u"))
    prefix = F.expr(f"n - ceil({percent} * n / 100) + 1 - coalesce(u, 0)").cast("int")
    members = stored(left.join(alone, "id", "left").select("id", "n", "component", F.coalesce("u", F.lit(0)).cast("long").alias("u"), prefix.alias("room")).where("room > 0"), "members")
    common = own.join(members.select("id"), "id", "left_semi").join(count.where("c > 1").select("shingle", "c"), "shingle")
    ranked = common.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("c", "shingle"))).alias("order"))  # one document's shingles
    keys = ranked.join(members, "id").select("id", "n", "u", "component", F.posexplode(F.slice("order", F.lit(1), F.col("room"))).alias("k", "x"))
    return keys.select(F.col("x.shingle").alias("key"), "id", "n", "u", (F.col("u") + F.col("k")).alias("place"), "component")


def near_duplicates(docs: DataFrame, percent: int = 80, bands: int = BANDS, band_rows: int = BAND_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are runs of anything but ASCII white space, A-Z in lower case; a set holds the
    distinct 5-word shingles, or the whole sequence of a shorter text. Rows are linked at
    100 * intersection >= percent * union. With 40 bands of 5 slots a pair at 0.85 escapes
    all buckets with probability below 1e-10, at 0.8 with 1.2e-7.

    Null or empty texts and texts without words have no set and are linked with nothing.
    A null id gives component_id null and kept false, and is linked with nothing. Rows of one
    id are one document, whatever their texts: what is linked with one of its texts is linked
    with it. Other columns are not read, so they may have any name. An empty table gives an
    empty result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    profile = stored(source.mapInArrow(tidied(_profile(bands, band_rows)), "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, bands array<long>"), "minhash")
    real = profile.where("doc_id is not null and n_shingles > 0")
    # The nodes are classes of equal sets; a document with several sets is in several classes, which are linked at the end.
    made = real.groupBy(*SET).agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.first("bands").alias("bands"))
    classes = stored(made.select(*SET, "least.*", "bands", F.monotonically_increasing_id().alias("id")), "classes")
    spread = classes.select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key")
    buckets = stored(spread.join(shared, "key"), "buckets")
    candidates = buckets.select("id").distinct()
    sample = classes.join(candidates, "id", "left_semi").select("id", "doc_id", "text_hash")
    texts = stored(source.join(sample, ["doc_id", "text_hash"]).groupBy("doc_id", "text_hash", "id").agg(F.min("text").alias("text")).select("id", "text"), "texts")
    component = candidates.select("id", F.col("id").alias("component"))
    zero = F.lit(0).cast("long")
    open_buckets = buckets.withColumns({"u": zero, "place": zero})
    # Bands, then rare shingles: a pivot of each bucket against its members; at last every member outside a bucket's largest component.
    for number, step in enumerate(("bands", "rare", "rare", "rest")):
        state = stored(open_buckets.join(component, "id"), "state")
        if number == 1:
            state = stored(_prefix_buckets(state, texts, percent), "prefixes")
        if step == "rest":
            most = state.groupBy("key", "component").agg(F.count("*").alias("k")).groupBy("key").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
            stats = stored(most.select("key", "main"), "pivots")
        else:
            stats = state.groupBy("key").agg(F.min(F.struct("u", "id", "n", "place", "component")).alias("q"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
            stats = stored(stats.drop("low", "high"), "pivots")
        if not stats.limit(1).count():
            break
        state = state.join(stats, "key")
        if step == "rest":
            strays = state.where("component <> main").select("key", F.struct("u", "id", "n", "place", "component").alias("q"), F.col("main").alias("m"))
            pairs = state.join(strays, "key").where("component = main or q.id < id")
        else:
            state = state.withColumn("is_pivot", F.col("id") == F.col("q.id"))
            pairs = state.where("not is_pivot")
        both = "least(n - u, q.n - q.u)"
        # Length bound; bound on common shingles; and, the key being the first that a linked pair shares, bound on what can follow it.
        pairs = pairs.where(
            f"component <> q.component and 100 * least(n, q.n) >= {percent} * greatest(n, q.n) and 100 * {both} >= {percent} * (n + q.n - {both})"
            f" and (100 + {percent}) * least(n - place, q.n - q.place) >= {percent} * (n + q.n)"
        ).select(F.col("q.id").alias("pivot"), "id").distinct()
        loaded = pairs.join(texts.select("id", F.col("text").alias("text_b")), "id").join(texts.select(F.col("id").alias("pivot"), F.col("text").alias("text_a")), "pivot")
        links = stored(loaded.select("pivot", "id", "text_a", "text_b").mapInArrow(tidied(_confirm(percent)), "a long, b long"), "links")
        named = links.join(component.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a").join(component.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b")
        merged = connected_components(named.select("ca", "cb"))
        component = stored(component.join(merged.select(F.col("node").alias("component"), "root"), "component", "left").select("id", F.coalesce("root", "component").alias("component")), "components")
        if step != "rest":
            open_buckets = state.where("not is_pivot").drop("q", "is_pivot", "component")
    found = stored(classes.select(*SET, "id", "doc_id").join(component, "id", "left").withColumn("component", F.coalesce("component", "id")), "found")
    # Documents with several sets bring the components of these together.
    several = stored(real.groupBy("doc_id").agg(F.min(F.struct(*SET)).alias("low"), F.max(F.struct(*SET)).alias("high")).where("low <> high").select("doc_id"), "several-sets")
    if several.limit(1).count():
        shared = real.join(several, "doc_id", "left_semi").select("doc_id", *SET).distinct().join(found.select(*SET, "component"), list(SET)).select("doc_id", "component")
        merged = connected_components(shared.groupBy("doc_id").agg(F.min("component").alias("first")).join(shared, "doc_id").select("first", "component"))
        found = stored(found.join(merged.select(F.col("node").alias("component"), "root"), "component", "left").withColumn("component", F.coalesce("root", "component")).drop("root"), "found")
    # A class of its own names itself; for the others the smallest document of their component is looked up.
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    named = found.join(least, "component", "left").select(*SET, F.coalesce("component_id", "doc_id").alias("component_id"))
    out = profile.select("doc_id", *SET).join(named, list(SET), "left")
    component_id = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"), F.coalesce(component_id == F.col("doc_id"), F.lit(False)).alias("kept"))

"""Prefix trie of conversations by distributed MSD radix partitioning, finished by multikey quicksort.

Turns (role, text) become dictionary ids. A conversation is rebuilt from the head of the
first conversation of its hundred and its own tail, and becomes one array of ids. Equal
arrays are one class with a number of members, so copies never meet anywhere.

Radix rounds: all classes start in one bucket. A bucket that is large is split by the next
id, after the ids that all its classes share (up to ``STRIDE`` a round) have been walked at
once: they are a chain of nodes with the same members. What rounds learn of a bucket is
aggregated before it is shuffled, and large buckets are few, since each has more than a
``LARGE_BUCKETS`` th of all turns; only these travel by broadcast, so a bucket with a third
of all classes is still spread over all tasks. Buckets that are not large go to tasks whole,
many to a task, where multikey quicksort (ternary partition on one id at a time) sorts them
and its recursion emits their nodes. What a subtree adds up to above the local buckets comes
from one aggregation of the local roots over the large buckets on their way.

A conversation travels as one array of 12 bytes a turn and must fit in a worker, as a text
must. The members that end in a
node are hashed from packed runs of their sorted ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import stored, tidied

#: Heads have fewer turns than this and come from the conversation at the start of each run of FAMILY ids.
HEADS, FAMILY = 6, 100
#: A bucket of more turns is split by Spark, and there are this many such buckets at once at most.
LOCAL_TURNS, LARGE_BUCKETS = 2048, 4096
#: Shared ids that one round walks at most.
STRIDE = 64
#: Decimal ids packed into one string, at most, before a class's digest is taken.
PACK_IDS = 4096
EMPTY_SHA256 = hashlib.sha256().hexdigest()


# --- turns, their dictionary, classes ---------------------------------------------


def coded_turns(turns: DataFrame) -> DataFrame:
    """conv_id, seq (rising in the order of turns within a conversation), code and chars of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    # The length keeps ("a", "b") and ("", "ab") apart.
    said = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    ranged = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    ranged = stored(ranged.select("conv_id", F.monotonically_increasing_id().alias("seq"), F.unhex(F.sha2(said.cast("binary"), 256)).alias("digest"), F.length("text").alias("chars")), "trie-turns")
    dictionary = stored(ranged.groupBy("digest").agg(F.count("*").alias("n")).withColumn("code", F.monotonically_increasing_id()), "trie-dictionary")
    total = ranged.count()
    # Frequent turns, fewer than 1,000, are looked up by broadcast; the others meet few rows each.
    frequent = F.broadcast(dictionary.where(F.col("n") * 1000 > total).select("digest", "code"))
    rare = dictionary.where(F.col("n") * 1000 <= total).select("digest", "code")
    return ranged.join(frequent, "digest").unionByName(ranged.join(frequent, "digest", "left_anti").join(rare, "digest")).select("conv_id", "seq", "code", "chars")


def rebuilt(coded: DataFrame, heads: int = HEADS, family: int = FAMILY) -> DataFrame:
    """conv_id, key, codes and chars of every conversation: a head of its family's first one, then its own tail."""
    lists = stored(coded.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "code", "chars"))).alias("own")).select("conv_id", F.transform("own", lambda t: F.struct(t["code"].alias("code"), t["chars"].alias("chars"))).alias("own")), "trie-lists")
    wide = lists.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    bases = lists.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, heads - 1).alias("head"))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("own", 1, 0))
    joined = wide.join(bases, "base", "left").select("conv_id", F.concat(head, F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))).alias("all"))
    codes = F.transform("all", lambda t: t["code"])
    return joined.select("conv_id", F.unhex(F.sha2(F.array_join(F.transform(codes, lambda c: c.cast("string")), ",").cast("binary"), 256)).alias("key"), codes.alias("codes"), F.transform("all", lambda t: t["chars"]).alias("chars"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of decimal ids of one key, from rows sorted by key and id."""
    for batch in batches:
        keys, ids = batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()
        cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1] or k % PACK_IDS == 0), len(keys)]
        spans = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
        yield pa.RecordBatch.from_arrays([pa.array([keys[a] for a, _ in spans], pa.binary()), pa.array([ids[a] for a, _ in spans], pa.int64()), pa.array([",".join(map(str, ids[a:b])) for a, b in spans], pa.string())], names=["key", "first", "ids"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's joined runs, from rows sorted by key and first id."""
    key, state, out = None, None, ([], [])

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.string())], names=["key", "ends"])

    for batch in batches:
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    out[0].append(key), out[1].append(state.hexdigest())
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield batch_of(out)
        out = ([], [])
    if key is not None:
        yield batch_of(([key], [state.hexdigest()]))


def classes(convs: DataFrame) -> DataFrame:
    """One row per distinct sequence: cls (smallest member), n, codes, chars, ends (digest of the members' ids)."""
    packed = convs.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_pack, "key binary, first long, ids string")
    ends = packed.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digest, "key binary, ends string")
    alike = convs.groupBy("key").agg(F.min("conv_id").alias("cls"), F.count("*").alias("n"), F.first("codes").alias("codes"), F.first("chars").alias("chars"))
    return alike.join(ends, "key").drop("key")


# --- buckets that are local ---------------------------------------------------------

_NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, way array<long>"
_NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "way"]
#: Turns that are sorted at once, and nodes in one batch, about.
CHUNK_TURNS, BATCH_NODES = 100_000, 100_000


class _Sorter:
    """Multikey quicksort of the classes of many buckets, whose recursion makes the nodes of groups of two or more.

    A class that is alone below some node goes on as a tail: nodes that differ by depth only.
    """

    def __init__(self, rows: pa.Table):
        lists = rows["codes"].combine_chunks()
        self.codes, chars = lists.flatten().to_numpy(), rows["chars"].combine_chunks().flatten().to_numpy()
        self.length = lists.value_lengths().to_numpy().astype(np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.upto = np.concatenate([[0], np.cumsum(chars, dtype=np.int64)])
        self.chars = chars
        self.cls, self.n, self.at = (rows[c].to_numpy().astype(np.int64) for c in ("cls", "n", "at"))
        self.parent_conv = rows["parent_conv"].to_numpy().astype(np.int64)
        self.ends = pa.concat_arrays([pa.array([EMPTY_SHA256]), rows["ends"].combine_chunks().cast(pa.string())])
        self.way = rows["way"].combine_chunks()
        up, code = rows["up"].to_numpy(), rows["code"].to_numpy()
        edges = np.flatnonzero((up[1:] != up[:-1]) | (code[1:] != code[:-1])) + 1
        self.buckets = np.split(np.arange(len(up)), edges)
        # Of a node: conv, depth, parent's conv, parent's number, members, children, leaves, saved, class that ends there, bucket's first row.
        self.nodes: list[list[int]] = []
        # Of a tail: class, first depth, parent's conv, bucket's first row (-1: not the top of a bucket).
        self.tails: list[tuple[int, int, int, int]] = []

    def _node(self, group: np.ndarray, depth: int, up: int, top: int) -> int:
        conv, members = int(self.cls[group].min()), int(self.n[group].sum())
        own = int(self.chars[self.start[group[0]] + depth - 1]) * (members - 1)
        parent = self.nodes[up][0] if up >= 0 else int(self.parent_conv[group[0]])
        self.nodes.append([conv, depth, parent, up, members, 0, 0, own, -1, top])
        if up >= 0:
            self.nodes[up][5] += 1
        return len(self.nodes) - 1

    def _tail(self, row: int, depth: int, up: int, top: int) -> None:
        """The nodes of ``row`` from ``depth`` on, below node ``up``."""
        if up >= 0:
            node = self.nodes[up]
            node[5] += 1
            node[6] += 1
            node[7] += int(self.n[row] - 1) * self._rest(row, depth)
        self.tails.append((row, depth, self.nodes[up][0] if up >= 0 else int(self.parent_conv[row]), top))

    def _rest(self, row, depth):
        """Characters of the turns from ``depth`` (counted from 1) on."""
        return self.upto[self.start[row] + self.length[row]] - self.upto[self.start[row] + depth - 1]

    def sort(self) -> None:
        for bucket in self.buckets:
            depth, top = int(self.at[bucket[0]]), int(bucket[0])
            if len(bucket) == 1:
                self._tail(top, depth, -1, top)
                continue
            stack = [(bucket, depth, self._node(bucket, depth, -1, top))]
            while stack:
                group, depth, node = stack.pop()
                if len(group) == 1:
                    row = int(group[0])
                    if self.length[row] == depth:
                        self.nodes[node][8] = row
                    else:
                        self._tail(row, depth + 1, node, -1)
                    continue
                ids = np.where(self.length[group] > depth, self.codes[np.minimum(self.start[group] + depth, len(self.codes) - 1)], -1)
                pivot = ids[len(ids) // 2]
                for part, same in ((group[ids < pivot], False), (group[ids > pivot], False), (group[ids == pivot], True)):
                    if len(part) == 0:
                        continue
                    if same and len(part) > 1:  # sequences are distinct, so these go on
                        stack.append((part, depth + 1, self._node(part, depth + 1, node, -1)))
                    else:
                        stack.append((part, depth, node))
        for node in reversed(self.nodes):  # children come after their parents
            if node[3] >= 0:
                above = self.nodes[node[3]]
                above[6] += node[6]
                above[7] += node[7]

    def _ways(self, top: np.ndarray) -> pa.Array:
        return self.way.take(pa.array(np.where(top >= 0, top, 0), mask=top < 0))

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.nodes:
            made = np.array(self.nodes, np.int64)
            arrays = [pa.array(made[:, k]) for k in (0, 1, 2, 4, 5, 6, 7)]
            yield pa.RecordBatch.from_arrays([*arrays, self.ends.take(pa.array(made[:, 8] + 1)), self._ways(made[:, 9])], names=_NAMES)
        if not self.tails:
            return
        row, first, parent, top = np.array(self.tails, np.int64).T
        until = np.cumsum(self.length[row] - first + 1)
        for low in range(0, int(until[-1]), BATCH_NODES):
            at = np.arange(low, min(low + BATCH_NODES, int(until[-1])))
            tail = np.searchsorted(until, at, "right")
            r = row[tail]
            depth = self.length[r] - (until[tail] - 1 - at)
            head, last = depth == first[tail], depth == self.length[r]
            ones = np.ones(len(at), np.int64)
            numbers = [self.cls[r], depth, np.where(head, parent[tail], self.cls[r]), self.n[r], ones - last, ones, (self.n[r] - 1) * self._rest(r, depth)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, numbers), self.ends.take(pa.array(np.where(last, r + 1, 0))), self._ways(np.where(head, top[tail], -1))], names=_NAMES)


@tidied
def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of whole buckets, from rows sorted by bucket."""
    held, turns = [], 0

    def nodes(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        sorter = _Sorter(rows)
        sorter.sort()
        yield from sorter.batches()

    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        turns += len(batch.column("codes").flatten())
        if turns >= CHUNK_TURNS:
            rows = pa.Table.from_batches(held)
            up, code = rows["up"].to_numpy(), rows["code"].to_numpy()
            edges = np.flatnonzero((up[1:] != up[:-1]) | (code[1:] != code[:-1])) + 1
            if len(edges):  # the last bucket may go on in the next batch
                yield from nodes(rows.slice(0, int(edges[-1])))
                held = rows.slice(int(edges[-1])).to_batches()
                turns = sum(len(b.column("codes").flatten()) for b in held)
    if held:
        yield from nodes(pa.Table.from_batches(held))


# --- radix rounds -------------------------------------------------------------------


def _split(open_: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chains of large buckets (up, code, id), and their classes dealt to the buckets of the next ids."""
    inside = open_.join(F.broadcast(large), ["up", "code"])
    # Of a bucket: its members and the next ids of one class, STRIDE at most; a row for each large bucket.
    known = inside.groupBy("id").agg(
        F.min("cls").alias("conv"),
        F.sum("n").alias("members"),
        F.min_by(F.slice("codes", F.col("at") + 1, F.lit(STRIDE)), "cls").alias("pivot"),
        F.min_by(F.slice("chars", F.greatest("at", F.lit(1)), F.lit(STRIDE) + F.least("at", F.lit(1))), "cls").alias("texts"),
    )
    known = stored(known, "trie-known")
    met = inside.join(F.broadcast(known.select("id", "conv", "pivot")), "id")
    differs = F.array_position(F.zip_with(F.slice("codes", F.col("at") + 1, F.lit(STRIDE)), "pivot", lambda a, b: ~a.eqNullSafe(b)), True)
    shared = F.when(differs > 0, differs - 1).otherwise(F.size("pivot")).cast("int")
    steps = stored(met.groupBy("id").agg(F.min(shared).alias("step")), "trie-steps")
    moved = met.join(F.broadcast(steps), "id").withColumn("end", F.col("at") + F.col("step"))
    onward = moved.where(F.size("codes") > F.col("end")).select(
        F.col("id").alias("up"), F.get("codes", F.col("end")).alias("code"), (F.col("end") + 1).alias("at"), "cls", "n", "codes", "chars", "ends", F.col("conv").alias("parent_conv"), F.concat("way", F.array("id")).alias("way")
    )
    onward = stored(onward, "trie-open")
    ended = moved.where(F.size("codes") == F.col("end")).select("id", "ends")  # one class a bucket at most
    children = onward.select("up", "code").distinct().groupBy("up").agg(F.count("*").alias("n_children")).withColumnRenamed("up", "id")
    tops = inside.groupBy("id").agg(F.first("at").alias("at"), F.first("parent_conv").alias("parent_conv"), F.first("way").alias("way"))
    chains = tops.join(known, "id").join(steps, "id").join(children, "id", "left").join(ended, "id", "left")
    return stored(chains.select("id", "at", "step", "conv", "parent_conv", "members", "texts", "way", "ends", F.coalesce("n_children", F.lit(0)).alias("n_children")), "trie-chains"), onward


def _chain_nodes(chains: DataFrame, local: DataFrame) -> DataFrame:
    """The nodes of large buckets: what their subtrees add up to comes from the local roots and the chains below."""
    own = F.transform("texts", lambda t: (F.col("members") - 1) * t)
    # texts begins with the text of the chain's top, but for the root, which has none.
    spent = F.when(F.col("at") == 0, F.concat(F.array(F.lit(0).cast("long")), own)).otherwise(own)
    chains = chains.withColumn("spent", F.slice(spent, F.lit(1), F.col("step") + 1))
    total = F.aggregate("spent", F.lit(0).cast("long"), lambda a, b: a + b)
    leaf = (F.col("n_children") == 0).cast("long")
    gained = local.where("way is not null").select(F.explode("way").alias("id"), "n_leaves", "saved_tokens").unionByName(chains.select(F.explode("way").alias("id"), leaf.alias("n_leaves"), total.alias("saved_tokens")))
    below = gained.groupBy("id").agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    wide = chains.join(below, "id", "left").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("step"))))
    later = F.aggregate(F.slice("spent", F.col("j") + 1, F.col("step") - F.col("j") + 1), F.lit(0).cast("long"), lambda a, b: a + b)
    last = F.col("j") == F.col("step")
    return wide.select(
        F.col("conv").alias("conv_id"),
        (F.col("at") + F.col("j")).cast("long").alias("depth"),
        F.when(F.col("j") == 0, F.col("parent_conv")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("members").alias("n_convs"),
        F.when(last, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        (F.coalesce("leaves", F.lit(0)) + leaf).alias("n_leaves"),
        (F.coalesce("saved", F.lit(0)) + later).alias("saved_tokens"),
        F.when(last, F.coalesce("ends", F.lit(EMPTY_SHA256))).otherwise(F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv_id, turn, role and text; other columns are not read. Rows without a
    conv_id take no part. Turns of equal number (nulls come first) are ordered by role, then
    text, and repeated rows are turns of their own; turns that share a conversation and a
    number are sorted in one task. No rows: no nodes, not even a root. A conversation that
    has no turns after rebuilding is a member of the root only.
    """
    spark = turns.sparkSession
    found = classes(rebuilt(stored(coded_turns(turns), "trie-coded")))
    open_ = found.select(F.lit(-1).cast("long").alias("up"), F.lit(-1).cast("long").alias("code"), F.lit(0).alias("at"), "cls", "n", "codes", "chars", "ends", F.lit(None).cast("long").alias("parent_conv"), F.array().cast("array<long>").alias("way"))
    open_ = stored(open_, "trie-open")
    most, chains, local, large_ids = local_turns, None, None, 0
    while True:
        if chains is None:
            buckets = open_.agg(F.sum(F.size("codes")).alias("turns")).collect()
            if buckets[0].turns is None:
                return spark.createDataFrame([], _NODES).drop("way")
            most = max(local_turns, buckets[0].turns // LARGE_BUCKETS)
            named = [(-1, -1, 0)]  # the root is always split
        else:
            sizes = open_.groupBy("up", "code").agg(F.sum(F.size("codes") - F.col("at") + 1).alias("turns"), F.count("*").alias("classes"))
            # LARGE_BUCKETS at most (twice that where turns that buckets end with count): each has more than ``most`` turns.
            named = [(r.up, r.code, large_ids + k) for k, r in enumerate(sizes.where((F.col("turns") > most) & (F.col("classes") > 1)).select("up", "code").collect())]
        large = spark.createDataFrame(named, "up long, code long, id long")
        small = open_.join(F.broadcast(large), ["up", "code"], "left_anti")
        local = small if local is None else local.unionByName(small)
        if not named:
            break
        large_ids += len(named)
        chain, open_ = _split(open_, large)
        chains = chain if chains is None else chains.unionByName(chain)
    dealt = local.repartition("up", "code").sortWithinPartitions("up", "code")
    nodes = stored(dealt.select("up", "code", "at", "cls", "n", "codes", "chars", "ends", "parent_conv", "way").mapInArrow(_finish, _NODES), "trie-nodes")
    return nodes.drop("way").unionByName(_chain_nodes(chains, nodes))

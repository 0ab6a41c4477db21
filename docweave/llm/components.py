"""Connected components by union-find over blocks of links, repeated on the roots until all blocks agree."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import stored, tidied

#: Links that one union-find block holds in memory at once.
BLOCK_LINKS = 500_000


def _roots_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def flush() -> pa.RecordBatch:
        nodes = list(parent)
        out = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "root"])
        parent.clear()
        return out

    seen = 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        seen += batch.num_rows
        if seen >= BLOCK_LINKS:
            yield flush()
            seen = 0
    if parent:
        yield flush()


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` has two long columns; returns (node, root), root the smallest node of the component.

    Links are read in as many blocks as their number asks for, so one block holds few
    links in memory and joins many. A node that two blocks give different roots links
    those roots; the next round works on these links and on one link per node.
    Self links keep a node. Null ends are ignored. No links: no rows.
    """
    a, b = links.columns
    now = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null")
    now = stored(now.distinct(), "component-links")
    while True:
        blocks = -(-now.count() // BLOCK_LINKS) or 1
        found = stored(now.coalesce(blocks).mapInArrow(tidied(_roots_of_blocks), "node long, root long"), "roots")
        best = found.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("other"))
        if not best.where("root < other").limit(1).count():
            return best.select("node", "root")
        ends = found.groupBy("node").agg(F.min("root").alias("low"), F.collect_set("root").alias("roots"))
        now = stored(ends.select(F.col("low").alias("a"), F.explode("roots").alias("b")).where("a <> b").distinct().union(ends.select("low", "node")), "component-links")

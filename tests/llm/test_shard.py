from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import pytest
from docweave.llm.shard import _edges, _exchanged, _moved, balanced_shards


def rows_of(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, shard string").repartition(5)
    return balanced_shards(df, **more).collect()


def law_holds(out, rows, shards=16):
    assert sorted(((r.doc_id is None, r.doc_id, r.size, r.text_crc32) for r in out), key=str) == sorted(((d is None, d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows), key=str)
    count = Counter(r.shard for r in out)
    sizes = [count.get(k, 0) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(count) <= set(range(shards))
    slots = defaultdict(list)
    for r in out:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_groups_stay_together_as_far_as_quotas_allow(spark):
    rows = [(i, f"text {i % 40}") for i in range(400)] + [(1000 + i, f"own {i}") for i in range(433)] + [(2000 + i, "hot") for i in range(420)]
    out = rows_of(spark, rows)
    law_holds(out, rows)
    text = {d: t for d, t in rows}
    places = defaultdict(set)
    for r in out:
        places[text[r.doc_id]].add(r.shard)
    assert len(places["hot"]) == 6  # 420 of 1253 rows need six shards at least
    assert not [k for k in range(40) if len(places[f"text {k}"]) > 1]


def test_edges(spark):
    rows = [(1, "a"), (1, "a"), (2, None), (None, "é"), (None, None), (3, ""), (4, "x" * 200000)]
    law_holds(rows_of(spark, rows), rows)
    law_holds(rows_of(spark, rows, shards=3), rows, 3)
    assert rows_of(spark, []) == []


def test_all_copies(spark):
    rows = [(i, "same") for i in range(101)]
    law_holds(rows_of(spark, rows), rows)


def edges(sizes, cells):
    return sum((n * n - sum(x * x for x in c)) // 2 for n, c in zip(sizes, cells, strict=True))


def least_cut(sizes, quota):
    """The fewest cut links over all ways to spread groups of these sizes under the quotas, the rest filled by single rows."""
    best = [10**9]

    def place(k, room, cut):
        if cut >= best[0]:
            return
        if k == len(sizes):
            best[0] = cut
            return

        def deal(s, left, cell):
            if s == len(room):
                if not left:
                    place(k + 1, [r - c for r, c in zip(room, cell, strict=True)], cut + edges([sizes[k]], [cell]))
                return
            for c in range(min(left, room[s]), -1, -1):
                deal(s + 1, left - c, [*cell, c])

        deal(0, sizes[k], [])

    place(0, quota, 0)
    return best[0]


def test_against_exhaustive_search(spark):
    rng = random.Random(5)
    for case in range(8):
        shards = rng.choice([2, 3])
        sizes = sorted((rng.randrange(2, 7) for _ in range(rng.randrange(2, 5))), reverse=True)
        single = rng.randrange(0, 8)
        rows = [(100 * g + i, f"group {case} {g}") for g, n in enumerate(sizes) for i in range(n)] + [(9000 + i, f"own {i}") for i in range(single)]
        out = rows_of(spark, rows, shards=shards)
        law_holds(out, rows, shards)
        cells = [[sum(r.shard == s and r.doc_id // 100 == g for r in out) for s in range(shards)] for g in range(len(sizes))]
        total = len(rows)
        got, best = edges(sizes, cells), least_cut(sizes, [total // shards + (k < total % shards) for k in range(shards)])
        assert got == best, (sizes, single, shards)


TIGHT = [((5, 5, 4, 3, 3), 2), ((5, 4, 4, 3), 2), ((7, 5, 4, 4), 2), ((6, 5, 4), 3), ((4, 4, 4), 2), ((8, 3, 3, 2), 2)]


@pytest.mark.parametrize(("sizes", "shards"), TIGHT)
def test_full_shards_exchange(spark, sizes, shards):
    """No single rows, so no free room; three of the tables have to cut something."""
    rows = [(100 * g + i, f"tight {sizes} {g}") for g, n in enumerate(sizes) for i in range(n)]
    trace = []
    out = rows_of(spark, rows, shards=shards, trace=trace)
    law_holds(out, rows, shards)
    cells = [[sum(r.shard == s and r.doc_id // 100 == g for r in out) for s in range(shards)] for g in range(len(sizes))]
    total = len(rows)
    assert edges(sizes, cells) == least_cut(sizes, [total // shards + (k < total % shards) for k in range(shards)]) == trace[-1]
    assert all(x > y for x, y in zip(trace, trace[1:], strict=False))


def test_files_do_not_matter_and_cuts_fall(spark):
    rows = [(i, f"text {i % 7}") for i in range(120)] + [(500 + i, f"own {i}") for i in range(11)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = [], []
    a = balanced_shards(df.repartition(1), 5, one).collect()
    b = balanced_shards(df.repartition(7, "text"), 5, two).collect()
    assert sorted(a) == sorted(b) and one == two
    assert one and all(x > y for x, y in zip(one, one[1:], strict=False))


def test_movement_gathers_cut_groups(spark):
    cells = spark.createDataFrame([(1, 1, 0, 5), (1, 1, 1, 2), (1, 1, 2, 1), (2, 2, 1, 4), (2, 2, 2, 4)], "ga long, gb long, shard int, number long")
    room = {0: 3, 1: 0, 2: 4}
    after, cut = _moved(cells, room)
    got = sorted(tuple(r) for r in after.select("ga", "shard", "number").collect())
    assert got == [(1, 0, 8), (2, 2, 8)] and cut == [33.0, *cut[1:]] and cut[-1] == 0 and room == {0: 0, 1: 6, 2: 1}
    assert all(x > y for x, y in zip(cut, cut[1:], strict=False))


def test_exchange_forms(spark):
    """Full shards: a whole group, part of one, two groups, and a group that goes along; room stays as it was."""
    cells = lambda *rows: spark.createDataFrame([(g, g, s, n) for g, s, n in rows], "ga long, gb long, shard int, number long")
    for rows, least in (
        ([(1, 0, 2), (1, 1, 3), (2, 1, 2)], 0),
        ([(1, 0, 3), (2, 0, 7), (1, 1, 2), (3, 1, 4), (4, 1, 4)], 3),
        ([(1, 0, 4), (1, 1, 6), (2, 1, 1), (3, 1, 3)], 0),
        ([(1, 0, 1), (2, 0, 4), (3, 0, 5), (1, 1, 2), (4, 1, 5), (5, 1, 3)], 0),
    ):
        full = {s: sum(r[2] for r in rows if r[1] == s) for s in (0, 1)}
        room, cut = {0: 0, 1: 0}, [_edges(cells(*rows))]
        after = _exchanged(cells(*rows), room, full, cut)
        held = {r.shard: r.n for r in after.groupBy("shard").sum("number").withColumnRenamed("sum(number)", "n").collect()}
        assert cut[-1] == least and len(cut) > 1 and room == {0: 0, 1: 0} and held == full
        whole = {r.ga: r.n for r in after.groupBy("ga").sum("number").withColumnRenamed("sum(number)", "n").collect()}
        assert whole == {g: sum(r[2] for r in rows if r[0] == g) for g in {r[0] for r in rows}}

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from docweave.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows):
    points = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        points.append((i, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a in points:
        if a[0] % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(a[1], p[1], strict=False)), p[0], p[2]) for p in points if p is not a]
        for minus, pos, _ in sorted(s for s in scored if s[2] == a[2])[:5]:
            fit = sorted((m, i) for m, i, label in scored if label != a[2] and 30 * -minus <= 100 * -m <= 90 * -minus)
            out += [(a[0], pos, k, i, -minus, -m) for k, (m, i) in enumerate(fit[:10], 1)]
    return sorted(out)


def mined(spark, rows, schema=SCHEMA):
    out = hn.hard_negatives(spark.createDataFrame(rows, schema))
    assert out.columns == NAMES
    return sorted(tuple(r) for r in out.collect())


def vectors(rnd, n, dim, spread):
    return [[rnd.gauss(0, 1) * spread(rnd) for _ in range(dim)] for _ in range(n)]


@pytest.mark.parametrize(("seed", "bucket"), [(1, 4096), (2, 7), (4, 64)])
def test_equals_brute_force(spark, monkeypatch, seed, bucket):
    """Norms from tiny to large, copies of one vector, and buckets of few rows so that rounds and bounds matter."""
    monkeypatch.setattr(hn, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(hn, "PART_ROWS", 4 * bucket)
    rnd = random.Random(seed)
    n = 260
    rows = []
    for k in range(n):
        scale = rnd.choice([0.01, 0.3, 1, 5])
        vec = [rnd.gauss(0, 1) * scale for _ in range(6)] if k % 3 else [0.5, -0.25, 0.125, 0.0, 1.0, 1.0]
        rows.append((rnd.choice([k, k * 100, k * 50]), vec, rnd.randrange(3)))
    assert mined(spark, rows) == brute(rows)


def test_bounds_prune(spark, monkeypatch):
    """Buckets come by falling norm; one that cannot reach a window's limit or kth score is not scanned."""
    monkeypatch.setattr(hn, "BUCKET_ROWS", 8)
    monkeypatch.setattr(hn, "PART_ROWS", 32)
    rows = [(k, [2.0 ** -(k // 40), 0.1], k % 2) for k in range(400)]
    buckets, n = hn.norm_buckets(hn.quantised(spark.createDataFrame(rows, SCHEMA)))
    reach = [r.reach for r in buckets.orderBy("bucket").collect()]
    assert n == len(reach) >= 50 and reach == sorted(reach, reverse=True)
    scanned = []
    monkeypatch.setattr(hn, "products", lambda a, b: scanned.append(len(a)) or a @ b.T)
    vec = hn._packed(np.array([3.0, 4.0]))
    windows = {"slot": 0, "low": 1, "high": 99}
    anchors = [{"uid": k, "label": 1, "norm": 5.0, "vec": vec, "windows": [windows | {"need": need}]} for k, need in enumerate((10, 50, 51))]
    batch = pa.RecordBatch.from_pylist([{"anchors": anchors, "reach": 10.0, "uids": [9], "vec_ids": [9], "labels": [2], "vecs": [hn._packed(np.array([6.0, 8.0]))]}])
    found = [r for b in hn._scan(10, False)(iter([batch])) for r in b.to_pylist()]
    assert scanned == [2] and [(r["anchor"], r["score"]) for r in found] == [(0, 50), (1, 50)]


def test_odd_rows(spark):
    assert mined(spark, []) == []
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (100, [], 1), (200, [0.0, 0.0], 2), (1, [0.5, 0.25, 9.0], 2), (2, [0.5], 2), (None, [1.0], 1), (3, None, 1), (4, [nan, 1.0], 1), (5, [1.0, None], 1), (6, [inf], 1), (8, [1.0, 1.0], None), (7, [1.0, 1.0], 0), (300, [-1.0, -1.0], 1), (9, [3e38, 1.0], 3)]
    plain = [r for r in rows if r[0] != 9]
    assert mined(spark, plain) == brute(plain)
    wide = [(*r, "x", 5) for r in plain]
    assert mined(spark, wide, SCHEMA + ", norm string, anchor_id int") == brute(plain)
    # Products beyond what doubles or longs hold: whole numbers up to 2**62, that limit above it.
    big = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 1.0], [2.0**60, 0.0]])
    assert hn.products(*big).tolist() == [[2**60 + 3, 2**62]]
    assert mined(spark, rows)

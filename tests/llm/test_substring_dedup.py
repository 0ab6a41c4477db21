from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from docweave.llm import substring_dedup as sd


def brute(rows, length):
    """rows: (doc_id, text) of distinct ids."""
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def cases(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randrange(15, 60)) for _ in range(8)]
    rows = []
    for i in range(90):
        t = text(rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p))
            t += p[cut : cut + rng.randrange(60, 400)] + text(rng.randrange(0, 20))
        if rng.random() < 0.15 and rows:
            t = rng.choice(rows)[1]
        if rng.random() < 0.2 and rows:
            t = list(rng.choice(rows)[1])
            for _ in range(3):
                if t:
                    t[rng.randrange(len(t))] = "Z"
            t = "".join(t)
        rows.append((rng.randrange(10**6) * 100 + i, t))
    rows += [(-5, passages[0] * 3), (10**9, "a" * 700), (10**9 + 1, "ab" * 500), (10**9 + 2, None), (10**9 + 3, ""), (10**9 + 4, "a" * 99), (10**9 + 5, "q" * 100), (10**9 + 6, "q" * 100)]
    return rows


def result(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, bucket string").repartition(5)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.removed_substrings(df, **more).collect()), key=lambda r: (r[0] is not None, r[0]))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = cases(seed)
    want = brute(rows, 100)
    assert sum(r[2] > 0 for r in want) > 20
    assert result(spark, rows) == want


def test_frequent_anchors_in_parts_give_the_same(spark):
    rng = random.Random(9)
    hot = "".join(rng.choice("abcdefgh ") for _ in range(260))
    rows = cases(3) + [(2 * 10**9 + i, f"{rng.random()} start {i} " + hot[rng.randrange(40) :] + f" end {rng.random()} {i}" * 4) for i in range(80)]
    assert result(spark, rows, anchor_rows=8) == brute(rows, 100)


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sd, "BLOCK", 257)
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    rows = [base[300:900], base + "x" + base[100:700], "y" + base]
    pieces = []
    for i, t in enumerate(rows):
        for skip, data in sd.split_windows(t.encode(), 100):
            own = sd.segments(data, skip=skip)
            starts = np.concatenate([np.arange(a - le, a - le + n) for a, le, n in zip(own["a"], own["left"], own["n"], strict=True)])
            pieces += [(i, s) for s in starts.tolist()]
    assert sorted(pieces) == [(i, s) for i, t in enumerate(rows) for s in range(len(t) - 99)]


def test_equal_windows_choose_equal_anchors():
    rng = random.Random(5)
    for alphabet in ("a", "ab", "abcdefgh"):
        shared = "".join(rng.choice(alphabet) for _ in range(180))
        x = ("".join(rng.choice(alphabet) for _ in range(77)) + shared).encode()
        y = ("".join(rng.choice(alphabet) for _ in range(31)) + shared + "tail" * 9).encode()
        found = []
        for raw in (x, y):
            own = sd.segments(np.frombuffer(raw, np.uint8))
            found.append({raw[s : s + 100]: (int(m), int(a - s)) for m, a, le, n in zip(own["m"], own["a"], own["left"], own["n"], strict=True) for s in range(a - le, a - le + n)})
        for w in set(found[0]) & set(found[1]):
            assert found[0][w] == found[1][w]


def test_suffix_order_is_the_plain_one():
    rng = np.random.default_rng(6)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    start = np.sort(rng.integers(0, 3900, 600))
    end = np.minimum(start + rng.integers(0, 100, 600), 4000)
    group = np.sort(rng.integers(0, 12, 600))
    suffixes = sd.Suffixes(data, start, end)
    order, common = sd.suffix_order(suffixes, group)
    plain, lengths = sd.plain_order(suffixes, group)
    raw = data.tobytes()
    assert [raw[start[i] : end[i]] for i in order] == [raw[start[i] : end[i]] for i in plain]
    assert common.tolist() == lengths.tolist()
    inner = np.flatnonzero(common >= 0)
    assert suffixes.verified(order[inner - 1], order[inner], common[inner])
    assert not suffixes.verified(order[inner - 1], order[inner], np.maximum(common[inner] - 1, 0))


def test_a_lying_hash_is_found_out(monkeypatch):
    data = np.frombuffer(b"abcabdabc", np.uint8)
    suffixes = sd.Suffixes(data, np.array([0, 3, 6]), np.array([3, 6, 9]))
    monkeypatch.setattr(suffixes.prefix, "of", lambda a, b: np.zeros(len(a), np.uint64))
    order, common = sd.sorted_suffixes(suffixes, np.zeros(3, np.int64))
    assert order.tolist() == [0, 2, 1] and common.tolist() == [-1, 3, 2]


def test_edges(spark):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefghij ") for _ in range(300))
    rows = [(None, text), (3, text), (3, text), (3, text[:200] + "other"), (4, None)]
    got = sorted((str(r[0]), r[1], r[2], r[3]) for r in result(spark, rows))
    assert got == [("3", 205, 200, 1), ("3", 300, 300, 1), ("3", 300, 300, 1), ("4", 0, 0, 0), ("None", 300, 0, 0)]
    assert result(spark, []) == []

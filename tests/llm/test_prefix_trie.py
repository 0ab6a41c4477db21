from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from docweave.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        ends = sorted(c for c in convs if len(whole[c]) == len(path))
        saved = sum((len(members[p]) - 1) * len(p[-1][1].decode()) for p in below if p)
        leaves = sum(not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in members) for p in below)
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(kids), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out)


def nodes(spark, rows, schema=SCHEMA, **more):
    out = prefix_trie.prefix_trie(spark.createDataFrame(rows, schema), **more)
    assert out.columns == NAMES
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize(("seed", "local"), [(1, 2048), (2, 4), (3, 20)])
def test_equals_brute_force(spark, seed, local):
    """Buckets of every size: all local, none local, and between."""
    rnd = random.Random(seed)
    rows = []
    for c in [*range(0, 40), *range(100, 130), 205, 317]:
        for t in range(rnd.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, t if rnd.random() > 0.1 else None, rnd.choice(["user", "assistant"][: 1 + t % 2]), rnd.choice(["a", "b😀", "", None][: rnd.choice([1, 2, 4])])))
    assert nodes(spark, rows, local_turns=local) == brute(rows)


def test_long_shared_heads_and_copies(spark):
    """Chains longer than one round walks, many copies of one conversation, and copies that end inside others."""
    rows = []
    for c in range(1000, 1012):
        length = 150 if c % 3 else 100
        rows += [(c, t, "user", f"turn {t}") for t in range(length)] + ([(c, 200, "user", str(c))] if c % 4 == 0 else [])
    assert nodes(spark, rows, local_turns=500) == brute(rows)


def test_empty_and_odd_rows(spark):
    assert nodes(spark, []) == []
    # Its first turns come from conversation 0, which is absent: nothing is left but the root.
    bare = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6)
    turnless = [(bare, 0, "user", "x"), (None, 1, "user", "lost")]
    assert nodes(spark, turnless) == brute(turnless)
    assert len(nodes(spark, turnless)) == 1
    wide = [(0, 0, "user", "é" * 50_000, 1, "z"), (0, 0, "user", "é" * 50_000, 2, "z"), (1, None, None, None, 3, None), (1, None, "a", "bc", 3, None), (1, None, "ab", "c", 3, None)]
    assert nodes(spark, wide, SCHEMA + ", depth long, code string") == brute([r[:4] for r in wide])

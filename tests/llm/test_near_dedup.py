from __future__ import annotations

import random
import re

import numpy as np
from docweave.llm.components import connected_components
from docweave.llm.near_dedup import near_duplicates, shingle_sets, super_minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text):
    words = WORD.findall(lower(text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows, percent):
    sets = [shingles(t) for _, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(rows[i][0]), find(rows[j][0])
                root[max(a, b)] = min(a, b)
    return {(d, len(s), find(d), find(d) == d) for (d, _), s in zip(rows, sets, strict=True)}


def test_against_all_pairs(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ünï", "x y"]
    rows = []
    for base in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 5, 6, 30, 120, 400]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3 + base % 2, rng.choice([" ", "\n", " \t"]).join(copy)))
    rows += [(9000, ""), (9001, None), (9002, " \n\t"), (9003, "Ab cd"), (9004, "aB CD")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for percent in (85, 80):
        got = {tuple(r) for r in near_duplicates(df, percent).collect()}
        assert got == brute(rows, percent)


def test_a_document_with_several_texts_is_one_node(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (4, "other words"), (4, "quite other words")]
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 80) and {(d, c) for d, _, c, _ in got} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    rng = random.Random(8)
    rows = []
    for _ in range(160):
        words = rows[rng.randrange(len(rows))][1].split() if rows and rng.random() < 0.6 else [f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 20, 60]))]
        words = [w if rng.random() < 0.99 else "new" for w in words]
        rows.append((rng.randrange(70), " ".join(words)))
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute(rows, 80)


def test_edges(spark):
    rows = [(None, "a b c", 1), (1, "a b c", 2), (1, "a b c", 3), (2, "x " * 30000, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(tuple(r) for r in near_duplicates(df).collect() if r.doc_id is not None)
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 2, True)]
    assert [r.kept for r in near_duplicates(df).collect() if r.doc_id is None] == [False]
    assert near_duplicates(df.limit(0)).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        pool = rng.integers(0, 2**63, 300).astype(np.uint64)
        a, b = np.sort(pool[:200]), np.sort(pool[40:])
        s = super_minhash(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2, 200)
        assert sorted((super_minhash(a, np.zeros(len(a), int), 1, 200)[0] == s[0]).tolist()) == [True] * 200
        errors.append((s[0] == s[1]).mean() - 160 / 300)
    assert abs(np.mean(errors)) < 0.02


def test_ranks_of_one_element_are_a_permutation():
    s = super_minhash(np.array([77], np.uint64), np.array([0]), 1, 200)[0]
    assert sorted((s >> np.uint64(56)).tolist()) == list(range(200))


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in list(root)}


def test_shingles_of_a_short_text_are_its_whole_sequence():
    data = np.frombuffer("A b\nc".encode(), np.uint8)
    assert len(shingle_sets(data, np.array([0, 5]))[0]) == 1

from __future__ import annotations

import random
import re

from docweave.llm.decontaminate import contamination, digest_of, item_digest

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        own, hit, names = words(text), set(), set()
        for item, passage in items:
            w = words(passage)
            for k in range(max(1, len(w) - 12) if w else 0):
                window = w[k : k + 13]
                for s in range(len(own) - len(window) + 1):
                    if own[s : s + len(window)] == window:
                        hit.update(range(s, s + len(window)))
                        names.add(str(item))
        out.append((doc_id, len(own), len(hit), len(names), digest_of(list(names)), bool(hit) and 20 * len(hit) >= len(own)))
    return sorted(out)


def cases():
    rng = random.Random(4)
    vocabulary = ["the", "of", "ünï", "Zoë", "a1", "x"] + [f"w{i}" for i in range(40)]
    text = lambda n: rng.choice([" ", ", ", "-\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 5, 12, 13, 14, 20, 40]))) for i in range(30)]
    items[7] = (7, "the")
    items += [(100, ""), (101, None), (102, items[3][1]), (10, items[4][1].upper())]
    docs = []
    for i in range(120):
        parts = [text(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            w = words(rng.choice(items)[1])
            cut = rng.randrange(0, max(1, len(w) - 12))
            parts += [" ".join(w[cut : cut + rng.randrange(10, 30)]), text(rng.randrange(0, 200))]
        docs.append((i, rng.choice([" ", "! "]).join(parts)))
    docs += [(500, None), (501, ""), (502, "..."), (503, "THE")]
    return docs, items


def result(spark, docs, items, **more):
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, items string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    found = contamination(d, b, **more).withColumn("sha", item_digest())
    return sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.sha, r.contaminated) for r in found.collect())


def test_against_brute_force(spark):
    docs, items = cases()
    want = brute(docs, items)
    assert sum(r[5] for r in want) > 20
    assert result(spark, docs, items) == want


def test_blocks_of_the_benchmark_give_the_same(spark):
    docs, items = cases()
    assert result(spark, docs[:50], items, block_bytes=900) == brute(docs[:50], items)


def test_empty_tables(spark):
    docs, items = cases()
    none = spark.createDataFrame([], "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert all(r.n_hit == 0 and not r.contaminated for r in contamination(d, none).collect())
    assert contamination(d.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0

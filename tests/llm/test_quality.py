from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
from docweave.llm import quality_classifier as qc
from docweave.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    cover = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_statistics_against_brute_force(spark):
    rng = random.Random(8)
    pieces = ["a", "bb", "é", "日本", "x|y", "#", "\n", "\n", " ", "\t", "\x0b", "\r\n", "the cat", " "]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["", None, "\n\n", "a a a a", "a\na\n a\na ", "word " * 40000, "x" * 100000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:6] for r in qr.text_statistics(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_rules_learn_thresholds_and_become_an_expression(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    big = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    rows, rules = qr.quality_rules(docs, labels)
    assert rules
    found = rows.join(labels, "doc_id").where("not base_failed and crc32(cast(cast(doc_id as string) as binary)) % 3 = 1").toPandas()
    wrong = (found["kept"] != (found["quality"] == 1)).mean()
    assert wrong < 0.08, wrong
    kept = found[found["quality"] == 1]["kept"].mean()
    assert kept > 0.97, kept
    assert rows.where("kept and base_failed").count() == 0


def test_rules_without_labels_keep_all(spark):
    docs = spark.createDataFrame([(1, "word " * 3 + " ".join(f"w{i}" for i in range(90)), 2), (None, None, 3)], "doc_id long, text string, kept int")
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    rows, rules = qr.quality_rules(docs, labels)
    assert rules == [] and sorted((r.doc_id or 0, r.kept) for r in rows.collect()) == [(0, False), (1, True)]
    assert qr.quality_rules(docs.limit(0), labels)[0].count() == 0


def test_decision_list_order():
    rng = np.random.default_rng(0)
    n = 3000
    rows = {k: rng.integers(1, 100, n) for k in qr.STATISTICS}
    rows["n_words"] = np.full(n, 100)
    rows["n_symbols"] = rng.integers(0, 30, n)
    good = rows["n_symbols"] < 20
    rules = qr.learn_rules(rows, good)
    assert rules and any(c.ratio == "symbols_per_word" for c in rules[0])
    values = qr.ratio_values(rows)
    rejected = np.logical_or.reduce([qr._covered(r, values, n) for r in rules])
    assert (rejected == ~good).mean() > 0.99


def test_classifier_held_out(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = qc.fit(docs, labels)
    found = qc.classify(docs, model).withColumn("held_out", qc.held_out()).join(labels, "doc_id").where("held_out").toPandas()
    right = ((found["score"] >= 0.5) == (found["quality"] == 1)).mean()
    recall = (found[found["quality"] == 1]["score"] >= 0.5).mean()
    print("held-out accuracy", right, "clean kept", recall)
    assert right > 0.95 and recall > 0.97


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (2, None, 2), (None, "", 3), (2, "x" * 100000, 4)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(2, 1), (1, 0), (None, 1), (3, None)], "doc_id long, quality int")
    out = qc.classify(docs, qc.fit(docs, labels)).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
    assert qc.classify(docs.limit(0), qc.fit(docs, labels.limit(0))).count() == 0


def test_averages_equal_the_plain_model():
    texts = ["one two three", "", "dos  tres\ncuatro é", "x"]
    raw = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    parts = list(qc.features(np.frombuffer(raw, np.uint8), offsets))
    for k, t in enumerate(texts):
        own = t.encode()
        alone = list(qc.features(np.frombuffer(own, np.uint8), np.array([0, len(own)])))
        for (index, cuts), (one, one_cuts) in zip(parts, alone, strict=True):
            assert index[cuts[k] : cuts[k + 1]].tolist() == one[one_cuts[0] : one_cuts[1]].tolist()


def test_grams_are_of_characters():
    """Features of a text counted by hand: words, pairs, and runs of 3 and 5 characters without white space inside."""
    text = "Größe zählt für öäü\nβγδε ok ok"
    raw = np.frombuffer(text.encode(), np.uint8)
    found = list(qc.features(raw, np.array([0, len(raw)])))
    padded = " " + text.replace("\n", " ") + " "
    for (index, cuts), length in zip(found[2:], qc.NGRAMS, strict=True):
        grams = [padded[i : i + length] for i in range(len(padded) - length + 1) if " " not in padded[i + 1 : i + length - 1]]
        assert cuts.tolist() == [0, len(grams)]
        names = {}
        for g, k in zip(grams, index.tolist(), strict=True):
            assert names.setdefault(g, k) == k
    assert len(found[0][0]) == 7 and len(found[1][0]) == 6


def test_score_is_the_plain_average_and_softmax(spark):
    texts = ["good words here and there", "bad spam spam spam", "", None, "ünïcode größe"]
    rng = np.random.default_rng(3)
    model = qc.Model(rng.normal(size=(1 << qc.TABLE_BITS, 4)).astype(np.float32), rng.normal(size=(2, 4)).astype(np.float32), np.array([0.3, -0.2], np.float32))
    got = {r.doc_id: r.score for r in qc.classify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, t in enumerate(texts):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        index = np.concatenate([x for x, _ in qc.features(raw, np.array([0, len(raw)]))])
        hidden = model.vectors[index].astype(np.float64).mean(axis=0) if len(index) else np.zeros(4)
        power = np.exp(model.output.astype(np.float64) @ hidden + model.bias)
        assert abs(got[k] - power[1] / power.sum()) < 1e-4


def test_training_follows_the_gradient():
    """One step on one document against the gradient of the log loss by differences."""
    bags, labels = [(np.array([1, 2]), np.array([1, 3])), (np.array([2]), np.array([2]))], np.array([1, 0])

    def loss(model):
        out = 0.0
        for (ids, n), y in zip(bags, labels, strict=True):
            z = model.output @ ((n / n.sum()) @ model.vectors[ids]) + model.bias
            out -= z[y] - np.log(np.exp(z).sum())
        return out

    models = [qc.train(bags, labels, bits=4, dim=3, epochs=e) for e in (1, 20, 100)]
    assert loss(models[0]) > loss(models[1]) > loss(models[2]) and loss(models[2]) < 0.3


def test_bound_on_feature_bytes(spark):
    docs = spark.createDataFrame([(i, f"text {i} " + "word " * 50) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    none = qc.fit(docs, labels, sample_bytes=0)
    assert none.bias[0] == none.bias[1]
    assert qc.fit(docs, labels).bias.tolist() != none.bias.tolist()


def test_repeated_ids_and_the_verdict_column(spark):
    rows = [(7, f"copy {i} " + " ".join(f"w{k}" for k in range(60))) for i in range(500)]
    rows += [(100 + i, " ".join(("# " if i % 2 else "") + f"x{k}" for k in range(70))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1)] + [(100 + i, (i + 1) % 2) for i in range(120)], "doc_id long, quality int")
    out, rules = qr.quality_rules(docs, labels)
    assert rules
    found = out.collect()
    assert len(found) == 620
    values = qr.ratio_values({k: np.array([getattr(r, k) for r in found]) for k in qr.STATISTICS})
    covered = np.zeros(620, bool)
    for rule in rules:
        covered |= np.logical_and.reduce([c.holds(values) for c in rule])
    assert [r.kept for r in found] == [not (c or r.base_failed) for c, r in zip(covered.tolist(), found, strict=True)]

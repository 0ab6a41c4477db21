from __future__ import annotations

import hashlib
import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from docweave.llm import token_store as ts
from docweave.llm.common import scratch_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows):
    tokenizer = Tokenizer.from_file(PATH)
    ids = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for k, (_, t) in enumerate(rows)}
    out, start = [], 0
    for k in sorted(ids, key=lambda k: rows[k][0]):
        out.append((rows[k][0], start, len(ids[k]), zlib.crc32(np.array(ids[k], "<u4").tobytes())))
        start += len(ids[k])
    return out, [(rows[k][0], ids[k]) for k in sorted(ids, key=lambda k: rows[k][0])]


def test_round_trip(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120).collect()]
    rows += [(10**6, ""), (10**6 + 1, None), (10**6 + 2, "it's <|endoftext|> Á   x　y\tΣΑΣ 'll don't 123"), (-5, "the quick " * 9000), (10**6 + 3, "é́ ́a ﬁ\r\n\x1c\x85 z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    folder = scratch_path(spark, "test-store")
    ts.write_store(df, folder, PATH)
    want, streams = expected(rows)
    assert sorted(tuple(r) for r in ts.read_store(spark, folder).collect()) == want
    assert sorted((r.doc_id, r.ids) for r in ts.documents(spark, folder).collect()) == streams
    hashes = spark.read.parquet(f"{folder}/objects/kind=chunk")
    assert hashes.count() == hashes.select("route").distinct().count()
    manifests = spark.read.parquet(f"{folder}/manifests").collect()
    assert sum(m.n_tokens for m in manifests) == sum(x[2] for x in want) and sum(m.n_docs for m in manifests) == len(rows)


def test_shared_passages_are_stored_once(spark):
    passage = " ".join(f"word{i} of{i % 91} it" for i in range(2500))
    rows = [(i, f"intro {i} {passage} end {i}") for i in range(8)]
    folder = scratch_path(spark, "test-store")
    ts.write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), folder, PATH)
    stored = spark.read.parquet(f"{folder}/objects/kind=chunk").selectExpr("sum(n)").first()[0]
    assert stored < 0.3 * sum(x[2] for x in expected(rows)[0])


def test_edges(spark):
    folder = scratch_path(spark, "test-store")
    df = spark.createDataFrame([(None, "a", 1), (4, "b", 2), (4, "b", 2), (4, None, 3)], "doc_id long, text string, start int")
    ts.write_store(df, folder, PATH)
    got = ts.read_store(spark, folder).collect()
    assert sorted(r.start for r in got) == [0, 2, *sorted(r.start for r in got)[2:]] and sum(r.n_tokens for r in got) == 7
    assert [r.start for r in got if r.doc_id is None] == [0]
    folder = scratch_path(spark, "test-store")
    ts.write_store(df.limit(0), folder, PATH)
    assert ts.read_store(spark, folder).count() == 0


def test_damage_is_found(spark):
    folder = scratch_path(spark, "test-store")
    ts.write_store(spark.createDataFrame([(1, "some words")], "doc_id long, text string"), folder, PATH)
    objects = spark.read.parquet(f"{folder}/objects")
    bad = objects.selectExpr("route", "doc_id", "n", "hashes", "case when packed is not null then cast('xx' as binary) end as packed", "kind").collect()
    other = scratch_path(spark, "test-store")
    spark.createDataFrame(bad, objects.selectExpr("route", "doc_id", "n", "hashes", "packed", "kind").schema).write.partitionBy("kind").parquet(f"{other}/objects")
    for name in ("recipes", "manifests", "top"):
        spark.read.parquet(f"{folder}/{name}").write.parquet(f"{other}/{name}")
    with pytest.raises(Exception, match="damaged"):
        ts.read_store(spark, other).collect()


def test_crc_join():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 700):
        a, b = rng.bytes(33), rng.bytes(n)
        assert ts.crc_join(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)


def test_merkle_depends_on_order_and_content():
    assert len({ts.merkle(x) for x in ([], [b"a"], [b"a", b"b"], [b"b", b"a"], [b"a", b"b", b"c"])}) == 5


def test_lost_files_are_found(spark):
    rows = [(i, f"document {i} with words of its own") for i in range(30)]
    folder = scratch_path(spark, "test-store")
    ts.write_store(spark.createDataFrame(rows, "doc_id long, text string"), folder, PATH)
    names = {"objects": ["kind"], "recipes": [], "manifests": [], "top": []}

    def copy(change):
        other = scratch_path(spark, "test-store")
        for name, by in names.items():
            change(name, spark.read.parquet(f"{folder}/{name}")).write.partitionBy(*by).parquet(f"{other}/{name}")
        return other

    whole = copy(lambda name, df: df)
    assert ts.read_store(spark, whole).count() == 30 and ts.documents(spark, whole).count() == 30
    chunk = spark.read.parquet(f"{folder}/objects").where("kind = 'chunk'").first().route
    part = spark.read.parquet(f"{folder}/manifests").first().part
    losses = [
        lambda name, df: df.where(F.col("route") != F.lit(chunk)) if name == "objects" else df,
        lambda name, df: df.where("doc_id <> 7") if name == "recipes" else df,
        lambda name, df: df.where("part < 0") if name == "manifests" else df,
        lambda name, df: df.where("n_docs < 0") if name == "top" else df,
        lambda name, df: df.where(f"part <> {part}") if name in ("recipes", "manifests") else df,
        lambda name, df: df.withColumn("place", 100 - F.col("place")) if name == "recipes" else df,
        lambda name, df: df.withColumn("n_tokens", F.col("n_tokens") + 1) if name == "recipes" else df,
    ]
    for loss in losses:
        other = copy(loss)
        for read in (ts.read_store, ts.documents):
            with pytest.raises(Exception, match="damaged"):
                read(spark, other).collect()


def test_equal_documents_are_dealt_evenly(spark):
    df = spark.createDataFrame([(None, "")] * 2000 + [(5, "the same words")] * 2000, "doc_id long, text string").repartition(8)
    objects = df.mapInArrow(ts._encode(PATH, None, 2, 2), ts._OBJECTS).where("kind = 'recipe'").repartition(16, "deal")
    sizes = [r[1] for r in objects.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * sum(sizes) / 16
    folder = scratch_path(spark, "test-store")
    ts.write_store(df, folder, PATH)
    assert ts.read_store(spark, folder).agg(F.countDistinct("start"), F.sum("n_tokens")).first()[0] == 4000


def test_words_one_by_one_only_where_the_file_allows_it(tmp_path):
    assert ts.joins_no_words(PATH)
    parts = json.load(open(PATH))
    for name, change in (("normalizer", None), ("pre_tokenizer", {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True})):
        other = tmp_path / f"{name}.json"
        other.write_text(json.dumps(parts | {name: change}))
        assert not ts.joins_no_words(str(other))


def test_ids_must_fit(spark):
    with pytest.raises(Exception, match="do not fit"):
        ts.write_store(spark.createDataFrame([(1, "a")], "doc_id long, text string"), scratch_path(spark, "test-store"), PATH, end_id=1 << 17)


def test_merkle_as_by_levels():
    def levels(leaves):
        level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
        while len(level) > 1:
            level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    for n in range(1, 40):
        leaves = [bytes([k]) for k in range(n)]
        assert ts.merkle(leaves) == levels(leaves)

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F
from docweave.llm import decontaminate, line_dedup, near_dedup, piece_dropout, quality_classifier

import corpus_pipeline as cp


def test_stages_on_their_own_input(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{big}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in cp.STAGES:
        before = docs
        docs = cp.stored(stage(spark, docs, big), "test-pipeline")
        seen.append((name, before.count(), docs.count()))
        if name != cp.STAGES[-1][0]:
            assert docs.columns == columns and docs.dtypes == before.dtypes
        if name == "quality classifier":
            model = quality_classifier.fit(before, spark.read.parquet(f"{big}/labels.parquet"))
            want = {r.doc_id for r in quality_classifier.classify(before, model).where("score >= 0.5").collect()}
            assert {r.doc_id for r in docs.collect()} == want
        elif name == "line dedup":
            text = {r.doc_id: r.text for r in line_dedup.dedup_lines(before).collect()}
            assert all(text[r.doc_id] == r.text and r.n_chars == len(r.text) for r in docs.collect())
            assert all(not text[d].strip() for d in set(text) - {r.doc_id for r in docs.collect()})
        elif name == "MinHash near-dedup":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in near_dedup.near_duplicates(before).where("kept").collect()}
        elif name == "benchmark decontamination":
            found = decontaminate.contamination(before, spark.read.parquet(f"{big}/benchmark.parquet"))
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in found.where("not contaminated").collect()}
        else:
            assert docs.where("not lossless").count() == 0
            back = {r.doc_id: r.text for r in piece_dropout.decode(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
            assert back == {r.doc_id: r.text for r in before.collect()}
    assert [n for n, _, _ in seen] == [n for n, _ in cp.STAGES]
    assert seen[0][1] > seen[0][2] > 0 and seen[2][1] > seen[2][2] and seen[3][1] > seen[3][2]


def test_run_is_the_last_stage(spark, sf_dir):
    out = cp.run(spark, sf_dir)
    assert out.columns == ["doc_id", "variant", "n_pieces", "piece_ids", "ids_crc32", "text_crc32", "lossless"] and out.count() > 0


def test_nulls_and_empty_tables(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, None, "en", "s", None), (2, "word", None, None, 4)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in cp.STAGES:
            docs = cp.stored(stage(spark, docs, sf_dir), "test-nulls")
            assert docs.count() <= 4, name


def test_rows_of_one_id_are_judged_one_by_one(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("length(text) > 100").first().text
    clean = " ".join(f"plain{i} words{i}" for i in range(40))
    other = " ".join(f"further{i} text{i}" for i in range(40))
    rows = [(1, item, "en", "a", 1), (1, clean, "en", "b", 2), (None, item, "en", "c", 3), (None, clean, "en", "d", 4)]
    left = cp.decontaminate_benchmark(spark, spark.createDataFrame(rows, schema), sf_dir).collect()
    assert sorted(r.source for r in left) == ["b", "d"]
    rows = [(3, clean, "en", "a", 1), (3, clean, "en", "b", 2), (3, other, "en", "c", 3), (4, clean, "en", "d", 4), (None, clean, "en", "e", 5), (None, "", "en", "f", 6), (9, "", "en", "g", 7)]
    left = cp.dedup_near(spark, spark.createDataFrame(rows, schema).repartition(3), sf_dir).collect()
    got = sorted(r.source for r in left)
    assert got in (["a", "c", "f", "g"], ["b", "c", "f", "g"])


def test_clashing_columns_and_long_texts(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    text = "\n".join(f"line {i} " + " ".join(f"w{(i * 7919 + k) % 9973}" for k in range(30)) for i in range(4000))
    rows = [(1, text, "en", "s", len(text)), (2, text[: len(text) // 2] + "x" * 200_000, "en", "s", 5)]
    docs = spark.createDataFrame(rows, schema)
    for name in ("score", "row", "kept", "n_words", "spans", "component_id"):
        docs = docs.withColumn(name, F.lit("clash"))
    for name, stage in cp.STAGES:
        docs = cp.stored(stage(spark, docs, sf_dir), "test-clash")
        assert name == cp.STAGES[-1][0] or docs.columns == schema.names

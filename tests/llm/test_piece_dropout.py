from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from docweave.llm import piece_dropout as pd

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = pd.pieces(PATH)
NONE = np.uint64(0)


def corpus(spark, sf_dir, n=60):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(n).collect()]
    return [*texts, "", " ", "  a  b ", "\n\n", "x", "tab\there", "naïve ﬁ 日本語 😀 the", "á b", " x ", "<s> </s> <0x41> <unk>", "1234567890" * 9, " " * 700]


def test_without_dropout_it_is_the_library(spark, sf_dir):
    texts = corpus(spark, sf_dir)
    processor = sentencepiece.SentencePieceProcessor(model_file=PATH)
    ids, counts = pd.encode_texts(MODEL, texts, np.zeros(len(texts), np.int64), 0.0, 5)
    ends = np.cumsum(counts)
    for t, a, b in zip(texts, ends - counts, ends, strict=True):
        assert ids[a:b].tolist() == processor.encode(t), t[:80]


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_lossless_and_heap_agrees(spark, sf_dir, dropout, monkeypatch):
    texts = [*corpus(spark, sf_dir, 40), "literal ▁ mark▁", "▁", "x" * 3000, "the" * 500]
    variants = np.arange(len(texts)) % 3
    ids, counts = pd.encode_texts(MODEL, texts, variants, dropout, 9)
    assert pd.decode_ids(MODEL, ids, counts) == [t.encode() for t in texts]
    monkeypatch.setattr(pd, "LONG_UNIT", 1)
    few = texts[-30:]
    again, n = pd.encode_texts(MODEL, few, variants[-30:], dropout, 9)
    assert n.tolist() == counts[-30:].tolist() and again.tolist() == ids[-len(again) :].tolist()


def test_dropout_varies_with_seed_and_share():
    text = ["some ordinary words that merge in several ways here"]
    runs = {s: pd.encode_texts(MODEL, text, np.zeros(1, np.int64), 0.4, s)[0].tolist() for s in range(6)}
    assert len({tuple(x) for x in runs.values()}) > 2
    lengths = [len(pd.encode_texts(MODEL, text, np.zeros(1, np.int64), p, 1)[0]) for p in (0.0, 0.3, 1.0)]
    assert lengths[0] < lengths[1] < lengths[2] == len(text[0]) + 1


def test_random_strings_round_trip():
    rng = random.Random(2)
    texts = ["".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x2570, 0x2590), rng.randrange(0x4E00, 0x4F00), 32, 10, 0x1F600])) for _ in range(rng.randrange(80))) for _ in range(200)]
    ids, counts = pd.encode_texts(MODEL, texts, np.arange(200) % 4, 0.2, 3)
    assert pd.decode_ids(MODEL, ids, counts) == [t.encode() for t in texts]


def test_query(spark):
    rows = [(1, "one two three", 1), (2, None, 2), (None, "one", 3), (1, "one two three", 4), (3, "", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_pieces int")
    out = pd.encode(df, PATH)
    got = {(r.doc_id, r.n_pieces, r.lossless, r.decoded_crc32) for r in out.collect()}
    assert {(d, ok, c) for d, _, ok, c in got} == {(d, True, zlib.crc32((t or "").encode())) for d, t, _ in rows}
    assert {d: n for d, n, _, _ in got if d in (2, 3)} == {2: 0, 3: 0}
    texts = sorted((r.doc_id or 0, r.text) for r in pd.decode(out, PATH).collect())
    assert texts == sorted((d or 0, t or "") for d, t, _ in rows)
    assert pd.encode(df.limit(0), PATH).count() == 0

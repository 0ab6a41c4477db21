"""Quality classifier: supervised subword embeddings.

Features of a text are its words, its word pairs and the byte n-grams of its words (with a
boundary mark at both ends), all hashed into one table of learned vectors. A document is
the average of its feature vectors, followed by a softmax over the two labels. Training is
plain stochastic gradient descent in numpy on a bounded sample of labelled rows.

Scoring uses that averaging and the output layer are linear: each table row is projected
once on the difference of the two output rows, so a document costs one lookup and one sum
per feature, and the broadcast model is one float per table row, whatever the input size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import BYTE_VALUES, SPACES, Prefix, give_back, mix, stored, text_blocks, word_hashes, words

_U = np.uint64
TABLE_BITS, NGRAMS = 18, (3, 5)
#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 2_500
#: Bytes of the features of these rows that the driver takes, at most; rows beyond it are not learned from.
SAMPLE_BYTES = 256 << 20
#: A document's vector averages its features, so each of them sees a small part of the gradient; their rate is higher by this factor,
#: or by as much as their number allows: the average then moves by the plain rate at most, or a text of a few words would diverge.
VECTOR_RATE = 100
BLOCK = 1 << 19


def features(data: np.ndarray, offsets: np.ndarray, bits: int = TABLE_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(table indexes, cuts) for one kind of feature at a time; row k has the indexes cuts[k]:cuts[k + 1]."""
    n = len(offsets) - 1
    padded = np.full(len(data) + n + 1, 32, np.uint8)
    padded[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets)) + 1] = data
    bounds = offsets + np.arange(n + 1)
    start, end, _ = words(padded, np.array([0, len(padded)]), SPACES)
    cuts = np.searchsorted(start, bounds)
    hashes = word_hashes(padded, start, end)
    shift = _U(64 - bits)
    yield (mix(hashes + _U(1)) >> shift).astype(np.int64), cuts
    first = np.ones(len(hashes) + 1, bool)
    first[cuts] = False  # the first word of a row follows none
    pair = np.flatnonzero(first[:-1])
    # A word that follows itself is one feature, whatever the word.
    both = np.where(hashes[pair - 1] == hashes[pair], _U(99), hashes[pair - 1] * _U(3) + hashes[pair])
    yield (mix(both + _U(2)) >> shift).astype(np.int64), np.searchsorted(pair, cuts)
    gap = SPACES[padded]
    gaps = np.zeros(len(padded) + 1, np.int32)
    np.cumsum(gap, out=gaps[1:])
    prefix = Prefix(np.where(gap, BYTE_VALUES[32], BYTE_VALUES[padded]))
    # Characters begin at bytes that continue none.
    chars = np.append(np.flatnonzero((padded & 0xC0) != 0x80), len(padded))
    for length in NGRAMS:
        at, last, stop = chars[:-length], chars[length - 1 : -1], chars[length:]
        whole = gaps[last] == gaps[at + 1]  # white space at either end only
        at, stop = at[whole], stop[whole]
        yield (mix(prefix.of(at, stop) + _U(length)) >> shift).astype(np.int64), np.searchsorted(at, bounds)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in text_blocks(batch.column(2), BLOCK):
            n = last - first
            parts = list(features(data, offsets))
            index = np.concatenate([p[0] for p in parts])
            row = np.concatenate([np.repeat(np.arange(n), np.diff(p[1])) for p in parts])
            key, count = np.unique(row * (1 << TABLE_BITS) + index, return_counts=True)
            cuts = np.searchsorted(key, np.arange(n + 1) << TABLE_BITS)
            key = (key & ((1 << TABLE_BITS) - 1)).astype(np.int32)
            count = count.astype(np.int32)
            bags = [(key[a:b].tobytes(), count[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array([b[0] for b in bags], pa.binary()), pa.array([b[1] for b in bags], pa.binary())],
                ["doc_id", "quality", "ids", "counts"],
            )


@dataclass
class Model:
    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def projected(self) -> np.ndarray:
        return (self.vectors @ (self.output[1] - self.output[0])).astype(np.float32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = TABLE_BITS, dim: int = 12, epochs: int = 15, rate: float = 1.0, seed: int = 1) -> Model:
    """Stochastic gradient descent on the log loss; the learning rate falls linearly to zero.

    Labels are drawn evenly: the rarer one is repeated in each epoch's order. Where one label
    is missing, the model is the smoothed share of the other.
    """
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((1 << bits, dim)) - 0.5) / dim).astype(np.float32)
    output, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    groups = [np.flatnonzero(labels == k) for k in (0, 1)]
    if not len(labels) or not all(len(g) for g in groups):
        for k, g in enumerate(groups):
            bias[k] = np.log((len(g) + 1) / (len(labels) + 2))
        return Model(vectors, output, bias)
    most = max(len(g) for g in groups)
    weights = [(c / max(1, c.sum())).astype(np.float32) for _, c in bags]
    scale = [min(VECTOR_RATE, 1 / max(float(w @ w), 1e-12)) for w in weights]
    total, step = epochs * 2 * most, 0
    for _ in range(epochs):
        order = np.concatenate([np.resize(rng.permutation(g), most) for g in groups])
        for k in rng.permutation(order):
            lr = rate * (1 - step / total)
            step += 1
            ids, w = bags[k][0], weights[k]
            hidden = w @ vectors[ids] if len(ids) else np.zeros(dim, np.float32)
            logit = output @ hidden + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = p @ output
            output -= lr * np.outer(p, hidden)
            bias -= lr * 0.1 * p
            vectors[ids] -= (lr * scale[k] * w)[:, None] * back
    return Model(vectors, output, bias)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = shared.value
        for batch in batches:
            for first, last, data, offsets in text_blocks(batch.column(1), BLOCK):
                n = last - first
                total, count = np.zeros(n), np.zeros(n)
                for index, cuts in features(data, offsets):
                    sums = np.concatenate([[0.0], np.cumsum(table[index], dtype=np.float64)])
                    total += sums[cuts[1:]] - sums[cuts[:-1]]
                    count += np.diff(cuts)
                score = 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + bias, -500, 500)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(score, pa.float64())], ["doc_id", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on labelled ids whose crc32 modulo 3 is not 1, those with the smallest hashes: at most ``sample_rows``, with ``sample_bytes`` of features."""
    ours = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    label = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(ours)
    chosen = label.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text"))
    found = stored(texts.mapInArrow(_bags, "doc_id long, quality int, ids binary, counts binary"), "bags")
    total = F.sum(F.octet_length("ids").cast("long") + F.octet_length("counts")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    within = found.select("doc_id", total.alias("total")).where(F.col("total") <= sample_bytes).select("doc_id")  # sample_rows numbers at most
    rows = found.join(F.broadcast(within), "doc_id", "left_semi").toArrow().sort_by("doc_id").to_pydict()
    bags = [(np.frombuffer(i, np.int32), np.frombuffer(c, np.int32)) for i, c in zip(rows["ids"], rows["counts"], strict=True)]
    model = train(bags, np.array(rows["quality"], np.int64))
    del rows, bags
    give_back()
    return model


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of every row of ``docs``.

    Only the text is scored. Null and empty texts have no features: their score is that of
    the bias alone. Rows of null or repeated ids are scored row by row. Other columns of
    ``docs`` are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.projected(), float(model.bias[1] - model.bias[0])))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_score(shared), "doc_id long, score double")


def held_out() -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 3, is 1; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _passes(shared, at: int):
    score = _score(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            texts = pa.RecordBatch.from_arrays([pa.nulls(len(column), pa.int64()), column], ["doc_id", "text"])
            scores = np.concatenate([b.column(1).to_numpy() for b in score(iter([texts]))] or [np.zeros(0)])
            yield batch.filter(pa.array(scores >= 0.5, pa.bool_()))

    return run


def filter_quality(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score 0.5 or more; one pass, no join back."""
    shared = docs.sparkSession.sparkContext.broadcast((model.projected(), float(model.bias[1] - model.bias[0])))
    return docs.mapInArrow(_passes(shared, docs.columns.index(text_col)), docs.schema)

"""Quality rules: base statistics of whole texts and a decision list learned by sequential covering.

Every text gives a row of integer statistics in one pass. Rules are grown from labelled
rows: each rule is a conjunction of thresholds on ratios of those statistics, grown by
FOIL gain on two thirds of the remaining rows, pruned on the last third and added to the
ordered list while it is precise enough; the rows it covers then leave. The list becomes
one Spark ``CASE`` expression, so applying it needs no Python.

The rules are fitted on a bounded sample of labelled rows (``sample_rows``, the rows with
the smallest hashes of their id); statistics and verdicts cover all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import BYTE_VALUES, SPACES, Prefix, mix, row_bounds, text_blocks, word_hashes, words

_U = np.uint64
#: Labelled rows that the rules are fitted on, at most.
SAMPLE_ROWS = 20_000
#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars", "n_upper", "n_lower", "n_digits", "n_marks", "n_distinct")


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


_SYMBOL, _MARKS = _table(SYMBOLS), _table(b"!?")
_UPPER, _LOWER, _DIGITS = _table(bytes(range(65, 91))), _table(bytes(range(97, 123))), _table(bytes(range(48, 58)))


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _seen_twice(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: has its row an equal one anywhere; has its row an equal one before it."""
    order = np.lexsort((np.arange(len(hashes)), hashes, row))
    h, r = hashes[order], row[order]
    same = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    before, after = np.zeros(len(h), bool), np.zeros(len(h), bool)
    before[1:], after[:-1] = same, same
    anywhere, earlier = np.zeros(len(h), bool), np.zeros(len(h), bool)
    anywhere[order], earlier[order] = before | after, before
    return anywhere, earlier


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of each row of a block of UTF-8 texts."""
    n = len(offsets) - 1
    start, end, row = words(data, offsets, SPACES)
    bounds = row_bounds(row, n)
    count = np.diff(bounds)
    out = {"n_words": count}
    lead = (data & 0xC0) != 0x80
    out["n_chars"] = _sums(lead, offsets)
    inside = ~SPACES[data]
    out["word_chars"] = _sums(lead & inside, offsets)
    for name, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_lower", _LOWER), ("n_digits", _DIGITS), ("n_marks", _MARKS)):
        out[name] = _sums(table[data], offsets)

    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    line_row = np.searchsorted(offsets, line_start, "right") - 1
    line_end = np.minimum(np.append(line_start[1:], len(data)), offsets[line_row + 1])
    line_end = np.where((line_end > line_start) & (data[np.maximum(line_end - 1, 0)] == 10), line_end - 1, line_end)
    word_count = np.searchsorted(start, line_end) - np.searchsorted(start, line_start)
    real = np.flatnonzero(word_count > 0)
    prefix = Prefix(BYTE_VALUES[data])
    line_hash = mix(prefix.of(line_start[real], line_end[real]) + (line_end - line_start)[real].astype(_U))
    _, earlier = _seen_twice(line_hash, line_row[real])
    out["n_dup_lines"] = np.bincount(line_row[real][earlier], minlength=n)
    out["n_lines"] = np.bincount(line_row[real], minlength=n)

    one = mix(prefix.of(start, end) + (end - start).astype(_U))
    windows = np.flatnonzero(np.arange(len(one)) + 3 <= bounds[1:][row]) if len(one) else np.zeros(0, np.int64)
    three = mix((one[windows] * _U(0xA0761D6478BD642F) + one[windows + 1]) * _U(0xA0761D6478BD642F) + one[windows + 2]) if len(windows) else np.zeros(0, _U)
    anywhere, _ = _seen_twice(three, row[windows])
    cover = np.zeros(len(one) + 3, bool)
    for k in range(3):
        cover[windows[anywhere] + k] = True
    out["n_repeat_words"] = _sums(cover[: len(one)], bounds)
    _, again = _seen_twice(one, row)
    out["n_distinct"] = count - _sums(again, bounds)
    return {k: out[k] for k in STATISTICS}


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in text_blocks(batch.column(1)):
            found = statistics(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *(pa.array(found[k], pa.int64()) for k in STATISTICS)], ["doc_id", *STATISTICS])


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATISTICS, one row per row of ``docs``; null texts count as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_measure, "doc_id long, " + ", ".join(f"{k} long" for k in STATISTICS))


#: Ratios that conditions compare with a threshold: name, numerator, denominator (plus one).
RATIOS = (
    ("symbols_per_word", "n_symbols", "n_words"),
    ("upper_share", "n_upper", "n_chars"),
    ("mark_share", "n_marks", "n_words"),
    ("digit_share", "n_digits", "n_chars"),
    ("repeat_share", "n_repeat_words", "n_words"),
    ("dup_line_share", "n_dup_lines", "n_lines"),
    ("distinct_share", "n_distinct", "n_words"),
    ("word_length", "word_chars", "n_words"),
    ("words_per_line", "n_words", "n_lines"),
    ("words", "n_words", None),
)


@dataclass(frozen=True)
class Condition:
    ratio: str
    above: bool
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return values[self.ratio] >= self.threshold if self.above else values[self.ratio] <= self.threshold

    def column(self) -> Column:
        value = ratio_column(self.ratio)
        return value >= F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.ratio} {'>=' if self.above else '<='} {self.threshold:.6g}"


def ratio_column(name: str) -> Column:
    _, top, bottom = next(x for x in RATIOS if x[0] == name)
    value = F.col(top).cast("double")
    return value / (F.col(bottom).cast("double") + F.lit(1.0)) if bottom else value


def ratio_values(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {name: rows[top].astype(float) / (rows[bottom] + 1.0) if bottom else rows[top].astype(float) for name, top, bottom in RATIOS}


def _covered(rule: tuple[Condition, ...], values: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(values)
    return out


def _grow(values: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray], depth: int) -> tuple[Condition, ...]:
    rule: tuple[Condition, ...] = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < depth and inside.any() and (~bad[inside]).any():
        p0, n0 = bad[inside].sum(), inside.sum()
        if not p0:
            break
        best, gain = None, 1e-9
        for name, thresholds in cuts.items():
            x, y = values[name][inside], bad[inside]
            order = np.argsort(x, kind="stable")
            x, total = x[order], np.concatenate([[0], np.cumsum(y[order])])
            low, high = np.searchsorted(x, thresholds, "left"), np.searchsorted(x, thresholds, "right")
            for above, p, n in ((True, p0 - total[low], n0 - low), (False, total[high], high)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(p / np.maximum(n, 1)) - np.log2(p0 / n0)), 0)
                k = int(np.argmax(g))
                if g[k] > gain:
                    best, gain = Condition(name, above, float(thresholds[k])), float(g[k])
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(values)
    return rule


def _prune(rule: tuple[Condition, ...], values: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Condition, ...]:
    """Drop last conditions as long as (bad - good) / (bad + good) on the pruning rows does not fall."""

    def worth(r: tuple[Condition, ...]) -> float:
        inside = _covered(r, values, len(bad))
        p, n = bad[inside].sum(), (~bad[inside]).sum()
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn_rules(rows: dict[str, np.ndarray], good: np.ndarray, precision: float = 0.97, depth: int = 3, most: int = 12, cuts: int = 64, seed: int = 7) -> list[tuple[Condition, ...]]:
    """Rules whose rows are rejected, in order. Without bad rows there are none."""
    values, bad = ratio_values(rows), ~good.astype(bool)
    left, rules = np.ones(len(bad), bool), []
    rng = np.random.default_rng(seed)
    part = rng.random(len(bad)) < 2 / 3
    thresholds = {k: np.unique(np.quantile(v, np.linspace(0, 1, cuts))) for k, v in values.items()} if len(bad) else {}
    while len(rules) < most and bad[left].sum() >= 5:
        grow, prune = left & part, left & ~part
        fine = {k: np.unique(np.concatenate([t, np.quantile(values[k][grow & bad], np.linspace(0, 1, cuts))])) for k, t in thresholds.items()} if (grow & bad).any() else thresholds
        rule = _grow({k: v[grow] for k, v in values.items()}, bad[grow], fine, depth)
        if not rule:
            break
        rule = _prune(rule, {k: v[prune] for k, v in values.items()}, bad[prune])
        inside = _covered(rule, values, len(bad)) & left
        if inside.sum() < 5 or bad[inside].mean() < precision:
            break
        rules.append(rule)
        left &= ~inside
    return rules


def verdict(rules: list[tuple[Condition, ...]]) -> Column:
    """The ordered decision list as one expression over the statistics: false for a row that a rule covers."""
    out = None
    for rule in rules:
        covered = rule[0].column()
        for c in rule[1:]:
            covered = covered & c.column()
        out = F.when(covered, F.lit(False)) if out is None else out.when(covered, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def quality_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, list[tuple[Condition, ...]]]:
    """(rows, rules): the statistics of every row with base_failed and kept, and the learned list.

    kept is false where base_failed, else the verdict of the list. ``labels`` has doc_id and
    quality; rows with a null in either are not learned from, and the rows of one third of
    ids (crc32 of the id modulo 3 = 1) are never learned from. Rows that fail the base rules
    are not learned from either, since the list never decides on them. Null and empty texts
    have no words and fail the base rules. Rows of null or repeated ids are judged row by
    row. Without labels the list is empty and keeps all.
    """
    label = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    order = F.xxhash64("doc_id")
    chosen = label.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(order, "doc_id").limit(sample_rows)
    chosen = F.broadcast(chosen)  # sample_rows pairs of numbers at most
    texts = docs.select("doc_id", "text").join(chosen, "doc_id", "left_semi")
    sample = text_statistics(texts).join(chosen, "doc_id").where(~base_failed())
    # One row for each id, that of the least statistics where an id has several texts.
    sample = sample.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min(F.struct(*STATISTICS)).alias("least"))
    sample = sample.orderBy(order, "doc_id").select("quality", "least.*").toPandas()  # sample_rows rows at most
    rules = learn_rules({k: sample[k].to_numpy(np.int64) for k in STATISTICS}, sample["quality"].to_numpy() == 1)
    rows = text_statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules)))
    return rows, rules

"""Benchmark decontamination by a prefix-filtered set join with exact verification.

Words are runs of the pattern ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z in lower
case. An item is cut into windows of 13 consecutive words; an item of fewer words, but
not none, is one window. Containment of a whole window is a set join at threshold 1, so
its necessary prefix is one token: the rarest of the window by its count over all
documents. A document word that is such a prefix proposes the one place of the window
that puts the token at its offset (positional bound), which must lie within the document
(length bound). The word sequence there is then compared: by the hash of the range, and
word by word against the item.

Benchmark items are read in blocks of a bounded size (``block_bytes`` of text), each
broadcast to a pass over the documents, so that no broadcast grows with the benchmark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import NOT_ALNUM, Prefix, lower_ascii, mix, row_bounds, stored, text_blocks, word_hashes, words

_U = np.uint64
WINDOW = 13
#: Text of benchmark items that one broadcast block holds at most (a longer item is a block of its own).
BLOCK_BYTES = 8 << 20
#: Places that are verified at once.
PLACES = 1 << 20


class Windows:
    """The distinct windows of a block of items: a row of word numbers each, their hashes, the items that hold them.

    All are arrays, some 100 bytes a window, so that the index stays near the size of the text.
    """

    def __init__(self, items: list[tuple[str, str]], size: int = WINDOW):
        self.items = [i for i, _ in items]
        number: dict[bytes, int] = {}
        spoken = []
        for _, text in items:
            raw = lower_ascii(np.frombuffer((text or "").encode(), np.uint8))
            start, end, _ = words(raw, np.array([0, len(raw)]), NOT_ALNUM)
            spoken.append(np.array([number.setdefault(raw[a:b].tobytes(), len(number)) for a, b in zip(start.tolist(), end.tolist(), strict=True)], np.int32))
        self.names = list(number)
        self.token = hash_words(self.names)
        self.vocabulary = np.sort(self.token)
        # One row for each window of each item, short ones filled up with -1.
        n_words = np.array([len(x) for x in spoken], np.int64)
        n_windows = np.where(n_words > 0, np.maximum(1, n_words - size + 1), 0)
        item, low = _expand(np.cumsum(n_words) - n_words, n_windows)
        length = np.minimum(size, n_words[item])
        flat = np.concatenate([*spoken, np.full(size, -1, np.int32)])
        rows = flat[low[:, None] + np.arange(size)]
        rows[np.arange(size) >= length[:, None]] = -1
        self.rows, first, kind = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        self.length = length[first]
        own = np.append(self.token, _U(0))[flat]
        self.hash = Prefix(own).of(low[first], (low + length)[first]) if len(first) else np.zeros(0, _U)
        held = np.unique(np.stack([kind.reshape(-1), item], axis=1), axis=0) if len(item) else np.zeros((0, 2), np.int64)
        self.owner = held[:, 1]
        self.owner_from = np.searchsorted(held[:, 0], np.arange(len(self.rows) + 1))

    def words(self, window: int) -> list[bytes]:
        return [self.names[k] for k in self.rows[window, : self.length[window]].tolist()]

    def owners(self, window: int) -> list[int]:
        return self.owner[self.owner_from[window] : self.owner_from[window + 1]].tolist()

    def order(self, counts: np.ndarray) -> None:
        """Choose each window's prefix token, the rarest by ``counts`` over the vocabulary; ties go to the smaller hash."""
        count = counts[np.searchsorted(self.vocabulary, self.token)]
        rank = np.empty(len(count) + 1, np.int64)
        rank[np.lexsort([self.token, count])] = np.arange(len(count))
        rank[-1] = len(count)  # for -1, never the rarest
        offset = rank[self.rows].argmin(axis=1) if len(self.rows) else np.zeros(0, np.int64)
        prefix = self.token[self.rows[np.arange(len(offset)), offset]]
        self.window = np.lexsort([offset, prefix])
        self.prefix, self.offset = prefix[self.window], offset[self.window]
        self.keys, self.first = np.unique(self.prefix, return_index=True)
        self.count = np.diff(np.append(self.first, len(self.prefix)))


def hash_words(names: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(names), np.uint8)
    ends = np.cumsum([len(x) for x in names], dtype=np.int64) if names else np.zeros(0, np.int64)
    return word_hashes(raw, ends - np.array([len(x) for x in names], np.int64), ends)


def _places(sorted_values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``wanted`` whose value is among the sorted values, and its index there."""
    if not len(sorted_values) or not len(wanted):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    index = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    hit = np.flatnonzero(sorted_values[index] == wanted)
    return hit, index[hit]


def _counter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value.vocabulary
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                data = lower_ascii(data)
                start, end, _ = words(data, offsets, NOT_ALNUM)
                _, index = _places(vocabulary, word_hashes(data, start, end))
                total += np.bincount(index, minlength=len(vocabulary))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], ["token", "n"])

    return run


def _expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry k, the numbers first[k] .. first[k] + count[k] - 1, with k beside them."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]


def _find(windows: Windows, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[set[int]], np.ndarray, np.ndarray, np.ndarray]:
    """Word counts, items and hit words of each row of a block, with the first word of each row."""
    n = len(offsets) - 1
    data = lower_ascii(data)
    start, end, row = words(data, offsets, NOT_ALNUM)
    hashes = word_hashes(data, start, end)
    bounds = row_bounds(row, n)
    cover = np.zeros(len(start) + 1, np.int64)
    items: list[set[int]] = [set() for _ in range(n)]
    ranges = Prefix(hashes)
    at, key = _places(windows.keys, hashes)
    cuts = np.searchsorted(np.cumsum(windows.count[key]), np.arange(PLACES, windows.count[key].sum() + PLACES, PLACES)) if len(key) else []
    begin = 0
    for cut in cuts:
        part, chosen = at[begin : cut + 1], key[begin : cut + 1]
        begin = cut + 1
        owner, entry = _expand(windows.first[chosen], windows.count[chosen])
        window = windows.window[entry]
        low = part[owner] - windows.offset[entry]
        high = low + windows.length[window]
        doc = row[part[owner]]
        fits = np.flatnonzero((low >= bounds[doc]) & (high <= bounds[doc + 1]))
        low, high, window, doc = low[fits], high[fits], window[fits], doc[fits]
        same = np.flatnonzero(ranges.of(low, high) == windows.hash[window])
        for a, b, w, d in zip(low[same].tolist(), high[same].tolist(), window[same].tolist(), doc[same].tolist(), strict=True):
            if all(data[start[a + k] : end[a + k]].tobytes() == x for k, x in enumerate(windows.words(w))):
                cover[a] += 1
                cover[b] -= 1
                items[d].update(windows.owners(w))
    return np.diff(bounds), items, np.cumsum(cover[:-1]) > 0, bounds, row


def _matcher(shared, whole: bool):
    """``whole``: one block holds all items, so a row's digest columns are final; else its hit words and items come out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            for first, last, data, offsets in text_blocks(batch.column(1)):
                n = last - first
                n_words, items, hit, bounds, _ = _find(windows, data, offsets)
                names = [sorted(str(windows.items[i]) for i in x) for x in items]
                head = [batch.column(0).slice(first, n), pa.array(n_words, pa.int64())]
                if whole:
                    total = np.concatenate([[0], np.cumsum(hit)])
                    yield pa.RecordBatch.from_arrays([*head, pa.array(total[bounds[1:]] - total[bounds[:-1]], pa.int64()), pa.array(names, pa.list_(pa.string())), batch.column(2).slice(first, n)], ["doc_id", "n_words", "n_hit", "items", "row"])
                else:
                    places = [np.flatnonzero(hit[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([*head, pa.array([p.tolist() for p in places], pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))], ["doc_id", "n_words", "places", "items"])

    return run


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks whose texts have ``limit`` bytes at most; the rows come to the driver one partition at a time."""
    block, size = [], 0
    for item, text in benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).where(F.col(id_col).isNotNull()).toLocalIterator():
        if block and size + len((text or "").encode()) > limit:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len((text or "").encode())
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, items (ids as strings, sorted), n_items, contaminated.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are not read.
    contaminated: n_hit > 0 and 20 * n_hit >= n_words. Null or empty texts have no words and
    are clean. Items without words or with a null id match nothing. Items of equal text are
    all reported. With an empty benchmark every document is clean. Rows with a null or
    repeated doc_id are judged row by row. ``carry`` names columns of ``docs`` that each row
    brings along, in the column ``row``, a struct; without any the column is left out.
    """
    spark = docs.sparkSession
    brought = F.struct(*(F.col(c) for c in carry)) if carry else F.lit(0)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), brought.alias("row"))
    kind = source.schema["row"].dataType.simpleString()
    rest, parts = iter(_blocks(benchmark, "item_id", "text", block_bytes)), []
    block = next(rest, [])
    while True:
        following = next(rest, None)
        windows = Windows(block, window)
        counted = source.select("text").mapInArrow(_counter(spark.sparkContext.broadcast(windows)), "token long, n long")
        counts = np.zeros(len(windows.vocabulary), np.int64)
        for token, n in counted.groupBy("token").agg(F.sum("n")).collect() if len(counts) else []:  # at most one row per word of the block
            counts[token] = n
        windows.order(counts)
        shared = spark.sparkContext.broadcast(windows)
        if following is None and not parts:
            out = source.mapInArrow(_matcher(shared, True), f"doc_id long, n_words long, n_hit long, items array<string>, row {kind}")
            break
        if not parts:  # several blocks: the rows need a name of their own to meet again
            source = stored(source.withColumn("number", F.monotonically_increasing_id()), "contamination-rows")
        rows = source.select("number", "text").mapInArrow(_matcher(shared, False), "number long, n_words long, places array<long>, items array<string>")
        parts.append(rows)
        if following is None:
            merged = parts[0]
            for part in parts[1:]:
                merged = merged.union(part)
            merged = merged.groupBy("number").agg(F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
            out = source.select("number", "doc_id", "row").join(merged, "number").select("doc_id", "n_words", F.size("places").cast("long").alias("n_hit"), "items", "row")
            break
        block = following
    return out.select("doc_id", "n_words", "n_hit", "items", F.size("items").cast("long").alias("n_items"), F.expr("n_hit > 0 and 20 * n_hit >= n_words").alias("contaminated"), *(["row"] if carry else []))


def item_digest(items: str = "items"):
    """Lower-case hex SHA-256 of the item ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


def digest_of(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()

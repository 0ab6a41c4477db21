"""Substring dedup by a hash-compared suffix sort.

Removed is every byte covered by a ``length``-byte string (window) that also starts earlier.
Equal windows choose equal anchors: the window's gram of ``GRAM`` bytes with the least hash,
leftmost of equals. So a text is cut into segments, runs of windows with one anchor, and
windows can only equal windows of segments with an equal anchor. The stages:

1. each task finds its segments (anchor hash and a fingerprint of the segment's bytes); of
   equal segments in a task the first goes on, the others are already known to be removed;
2. segments meet by anchor hash; anchors that occur once leave, of equal segments all but
   the first are removed, and segments that share only the anchor ask for their bytes;
3. those bytes are fetched from the texts;
4. per anchor the suffixes at the anchors are sorted, and the reversed prefixes too, by a
   mergesort that compares two suffixes by binary search over prefix polynomial hashes for
   their common extension. A window that reaches d bytes to the left of its anchor equals
   another iff both share d bytes to the left and length - d to the right: intervals of the
   two sorted orders. Neighbours' extensions are verified byte by byte; should a hash have
   lied, the task sorts by the bytes themselves;
5. removed ranges return to the texts.

An anchor with more occurrences than a task should hold is dealt over several tasks
(``anchor_rows``); each resolves its part, and the first windows of the parts are compared in one more
aggregation over 128-bit window hashes. The segments of every anchor that stage 1 sends on are counted
over all texts first (anchor and number are shuffled, nothing else). The broadcast list holds the
``FREQUENT`` most frequent ones at most; any other has fewer occurrences than all segments
divided by that number. It decides where rows go, never what is removed.

Between the stages rows travel as column blobs per bucket; the number of buckets follows
the amount of text, at any size, so that a bucket stays as large as it is.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import BYTE_VALUES, Prefix, _byte_values, mix, stored, tidied

_U = np.uint64
LENGTH, GRAM = 100, 20
BLOCK, FLUSH = 1 << 19, 300_000
BUCKET_BYTES = 2 << 20
#: Occurrences of one anchor that one task resolves; anchors that the broadcast list holds at most (16 bytes each).
ANCHOR_ROWS, FREQUENT = 50_000, 2_000_000
OTHER_VALUES = _byte_values(9973)
NO_ID = -(1 << 63)

SEGMENT = (("m", "<u8"), ("c", "<u8"), ("e", "<u4"), ("doc", "<i8"), ("v", "<i8"), ("a", "<i4"), ("left", "u1"), ("n", "u1"))
RANGE = (("doc", "<i8"), ("v", "<i8"), ("low", "<i4"), ("high", "<i4"))
WANTED = (("m", "<u8"), ("part", "<u4"), ("doc", "<i8"), ("v", "<i8"), ("a", "<i4"), ("left", "u1"), ("n", "u1"))

Columns = dict[str, np.ndarray]


def pack(columns: Columns, layout) -> bytes:
    n = len(columns[layout[0][0]])
    return struct.pack("<q", n) + b"".join(np.ascontiguousarray(columns[k], t).tobytes() for k, t in layout)


def unpack(blobs: list[bytes], layout) -> Columns:
    parts: dict[str, list] = {k: [] for k, _ in layout}
    for blob in blobs:
        n, at = struct.unpack_from("<q", blob)[0], 8
        for k, t in layout:
            parts[k].append(np.frombuffer(blob, t, n, at))
            at += n * np.dtype(t).itemsize
    return {k: np.concatenate(parts[k]) if parts[k] else np.zeros(0, t) for k, t in layout}


def take(columns: Columns, index: np.ndarray) -> Columns:
    return {k: v[index] for k, v in columns.items()}


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if width > have else values


def segments(data: np.ndarray, length: int = LENGTH, gram: int = GRAM, skip: int = 0) -> Columns:
    """m, c, e, a, left, n of the segments of one block's windows that lie within ``data``.

    A segment's windows start at a - left .. a - left + n - 1.
    """
    width = length - gram + 1
    prefix, other = Prefix(BYTE_VALUES[data]), Prefix(OTHER_VALUES[data])
    at = np.arange(len(data) - gram + 1)
    hashes = mix(prefix.of(at, at + gram))
    chosen = least((hashes & _U(0xFFFFFFFFFF000000)) | at.astype(_U), width)
    anchor = (chosen & _U(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    n = np.diff(np.append(first, len(anchor)))
    a = anchor[first]
    end = first + n + length - 1
    return {"m": hashes[a], "c": mix(prefix.of(first, end) + n.astype(_U) * _U(1009) + (a - first).astype(_U)), "e": (mix(other.of(first, end)) >> _U(32)).astype(np.uint32), "a": a + skip, "left": a - first, "n": n}


def split_windows(text: bytes, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, bytes) of pieces that together hold every window of the text once."""
    raw = np.frombuffer(text, np.uint8)
    for start in range(0, max(0, len(raw) - length + 1), BLOCK):
        yield start, raw[start : start + BLOCK + length - 1]


def first_of_equals(rows: Columns, keys: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """An order by ``keys``, doc, v, a, and for each place the place of the first row with its keys."""
    order = np.lexsort((rows["a"], rows["v"], rows["doc"], *(rows[k] for k in reversed(keys))))
    new = np.ones(len(order), bool)
    for k in keys:
        x = rows[k][order]
        new[1:] &= x[1:] == x[:-1]
    new[1:] = ~new[1:]
    start = np.flatnonzero(new)
    return order, np.repeat(start, np.diff(np.append(start, len(order))))


def ranges_of(rows: Columns, length: int) -> Columns:
    """The byte ranges that whole segments cover, adjoining ones of a document merged."""
    low = rows["a"].astype(np.int64) - rows["left"]
    return merged({"doc": rows["doc"], "v": rows["v"], "low": low, "high": low + rows["n"] + length - 1})


def merged(rows: Columns) -> Columns:
    if not len(rows["doc"]):
        return rows
    order = np.lexsort((rows["low"], rows["v"], rows["doc"]))
    doc, v, low, high = (rows[k][order].astype(np.int64) for k in ("doc", "v", "low", "high"))
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (v[1:] != v[:-1])
    group = np.cumsum(fresh) - 1
    lift = group * (int(high.max()) + 2)
    reach = np.maximum.accumulate(high + lift)
    new = fresh.copy()
    new[1:] |= (low + lift)[1:] > reach[:-1]
    start = np.flatnonzero(new)
    return {"doc": doc[start], "v": v[start], "low": low[start], "high": np.maximum.reduceat(high + lift, start) - lift[start]}


def bucket_of(doc: np.ndarray, buckets: int) -> np.ndarray:
    """As pmod(doc, buckets) in SQL."""
    return np.mod(doc.astype(np.int64), buckets)


def prime_from(n: int) -> int:
    """The first prime from n on, so that ids at regular distances spread over all buckets."""
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


_BLOBS = "kind string, bucket long, blob binary"
_FIELDS = pa.schema([("kind", pa.string()), ("bucket", pa.int64()), ("blob", pa.binary())])


def blobs(kind: str, rows: Columns, bucket: np.ndarray, layout) -> Iterator[tuple[str, int, bytes]]:
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0]))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
        part = order[a:b]
        yield kind, int(bucket[part[0]]), pack(take(rows, part), layout)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_FIELDS)], schema=_FIELDS)


def _document_segments(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[Columns]:
    """Segments of the texts (doc, v, text), in portions of about FLUSH rows."""
    parts: list[Columns] = []
    size = 0
    for batch in batches:
        for doc, v, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), pc.fill_null(batch.column(2), "").cast(pa.binary()).to_pylist(), strict=True):
            for skip, data in split_windows(text, length):
                own = segments(data, length, skip=skip)
                own["doc"], own["v"] = np.full(len(own["a"]), doc, np.int64), np.full(len(own["a"]), v, np.int64)
                parts.append(own)
                size += len(own["a"])
            if size >= FLUSH:
                yield {k: np.concatenate([p[k] for p in parts]) for k, _ in SEGMENT}
                parts, size = [], 0
    if parts:
        yield {k: np.concatenate([p[k] for p in parts]) for k, _ in SEGMENT}


def _same_place(rows: Columns, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return (rows["doc"][one] == rows["doc"][other]) & (rows["v"][one] == rows["v"][other]) & (rows["a"][one] == rows["a"][other])


def _cut(shared, length: int):
    """Stage 1. A frequent anchor's rows go to one of its parts, by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, doc_buckets, frequent, parts = shared.value
        for rows in _document_segments(batches, length):
            order, first = first_of_equals(rows, ("m", "c", "e"))
            again = first != np.arange(len(order))
            gone = order[again & ~_same_place(rows, order, order[first])]
            out = list(blobs("range", found := ranges_of(take(rows, gone), length), bucket_of(found["doc"], doc_buckets), RANGE))
            rows = take(rows, np.sort(order[~again]))
            part = part_of(rows, frequent, parts)
            out += blobs("segment", rows, ((rows["m"] + part.astype(_U) * _U(0x9E3779B97F4A7C15)) % _U(buckets)).astype(np.int64), SEGMENT)
            yield _batch(out)

    return run


def part_of(rows: Columns, frequent: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """0 for an ordinary anchor; 1 to its number of parts for a frequent one, by document."""
    if not len(frequent):
        return np.zeros(len(rows["m"]), np.int64)
    at = np.minimum(np.searchsorted(frequent, rows["m"]), len(frequent) - 1)
    own = 1 + (mix(rows["doc"].astype(np.int64).view(_U) + _U(77)) % parts[at].astype(_U)).astype(np.int64)
    return np.where(frequent[at] == rows["m"], own, 0)


def _meet(shared, length: int):
    """Stage 2, over the blobs of a partition bucket by bucket."""

    def finish(blob_list: list[bytes]) -> Iterator[tuple]:
        buckets, doc_buckets, frequent, parts = shared.value
        rows = unpack(blob_list, SEGMENT)
        rows["part"] = part_of(rows, frequent, parts)
        order, first = first_of_equals(rows, ("m", "part", "c", "e"))
        again = first != np.arange(len(order))
        gone = order[again & ~_same_place(rows, order, order[first])]
        found = ranges_of(take(rows, gone), length)
        yield from blobs("range", found, bucket_of(found["doc"], doc_buckets), RANGE)
        left = order[~again]  # by m, part
        m, part = rows["m"][left], rows["part"][left]
        same = (m[1:] == m[:-1]) & (part[1:] == part[:-1])
        several = part > 0
        several[1:] |= same
        several[:-1] |= same
        wanted = take(rows, left[several])
        yield from blobs("wanted", wanted, bucket_of(wanted["doc"], doc_buckets), WANTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        current, forward = None, []
        for batch in batches:
            for kind, bucket, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if kind == "range":
                    forward.append((kind, bucket, blob))
                    continue
                if bucket != current and held:
                    if out := list(finish(held)):
                        yield _batch(out)
                    held = []
                current = bucket
                held.append(blob)
            if forward:
                yield _batch(forward)
                forward = []
        if held and (out := list(finish(held))):
            yield _batch(out)

    return run


_CONTEXT = "part_bucket long, blob binary, bytes binary"


def _fetch(buckets: int, length: int):
    """Stage 3: the bytes of the wanted segments of one bucket of documents, split by anchor."""

    def run(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        rows = unpack(wanted.column("blob").to_pylist(), WANTED)
        order = np.lexsort((rows["a"], rows["v"], rows["doc"]))
        rows = take(rows, order)
        where = {}
        for doc, v, text in zip(*(texts.column(c).to_pylist() for c in ("doc", "v", "text")), strict=True):
            where.setdefault((doc, v), text)
        pieces = []
        last, raw = None, b""
        for doc, v, a, left, n in zip(*(rows[k].tolist() for k in ("doc", "v", "a", "left", "n")), strict=True):
            if last != (doc, v):
                last, raw = (doc, v), (where[doc, v] or "").encode()
            pieces.append(raw[a - left : a - left + n + length - 1])
        out: dict[str, list] = {"part_bucket": [], "blob": [], "bytes": []}
        bucket = ((mix(rows["m"]) + rows["part"].astype(_U)) % _U(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(bucket[by]) != 0])).tolist() if len(by) else []
        for x, y in zip(cuts, cuts[1:] + [len(by)] if cuts else [], strict=True):
            part = by[x:y]
            out["part_bucket"].append(int(bucket[part[0]]))
            out["blob"].append(pack(take(rows, part), WANTED))
            out["bytes"].append(b"".join(pieces[i] for i in part.tolist()))
        return pa.table(out, schema=pa.schema([("part_bucket", pa.int64()), ("blob", pa.binary()), ("bytes", pa.binary())]))

    return run


class Suffixes:
    """Suffixes data[start:end] compared by hashes; any may be longer than the others."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.data, self.start, self.end = data, start, end
        self.prefix = Prefix(BYTE_VALUES[data])

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes x and y: binary search over prefix hashes."""
        low = np.zeros(len(x), np.int64)
        high = np.minimum((self.end - self.start)[x], (self.end - self.start)[y])
        for _ in range(int(high.max()).bit_length() if len(x) else 0):
            middle = (low + high + 1) >> 1
            same = self.prefix.of(self.start[x], self.start[x] + middle) == self.prefix.of(self.start[y], self.start[y] + middle)
            low, high = np.where(same, middle, low), np.where(same, high, np.maximum(middle - 1, low))
        return low

    def before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether suffix x sorts before suffix y, or equals it."""
        common = self.common(x, y)
        out_x, out_y = self.start[x] + common >= self.end[x], self.start[y] + common >= self.end[y]
        byte_x = self.data[np.minimum(self.start[x] + common, len(self.data) - 1)]
        byte_y = self.data[np.minimum(self.start[y] + common, len(self.data) - 1)]
        return out_x | (~out_y & (byte_x < byte_y))

    def verified(self, x: np.ndarray, y: np.ndarray, common: np.ndarray) -> bool:
        """Whether x and y really share ``common`` bytes and no more."""
        total = np.cumsum(common)
        inside = np.arange(total[-1] if len(total) else 0) - np.repeat(total - common, common)
        if not np.array_equal(self.data[np.repeat(self.start[x], common) + inside], self.data[np.repeat(self.start[y], common) + inside]):
            return False
        longer = (self.start[x] + common < self.end[x]) & (self.start[y] + common < self.end[y])
        return bool((self.data[(self.start[x] + common)[longer]] != self.data[(self.start[y] + common)[longer]]).all())


def suffix_order(suffixes: Suffixes, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix numbers sorted within each (ascending) group, and each one's common extension with its predecessor, -1 at a group's start.

    Bottom-up mergesort of all groups at once: the place of an entry in the merge of two runs
    is its own place plus the entries of the other run before it, found by binary search.
    """
    n = len(group)
    order = np.arange(n)
    begin = np.searchsorted(group, group)
    stop = np.searchsorted(group, group, "right")
    width = 1
    while n and (stop - begin > width).any():
        live = np.flatnonzero(stop - begin > width)
        place = live - begin[live]
        run = place // width
        partner = begin[live] + (run ^ 1) * width
        is_right = (run & 1).astype(bool)
        low = np.minimum(partner, stop[live])
        first, high = low.copy(), np.minimum(partner + width, stop[live])
        mine = order[live]
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) >> 1
            x, y = mine[open_], order[middle]
            # Entries of a left run come before equal ones of the right run.
            goes = np.where(is_right[open_], suffixes.before(y, x), ~suffixes.before(x, y))
            low[open_] = np.where(goes, middle + 1, low[open_])
            high[open_] = np.where(goes, high[open_], middle)
        target = begin[live] + (run >> 1) * 2 * width + place % width + (low - first)
        merged_order = order.copy()
        merged_order[target] = mine
        order = merged_order
        width *= 2
    common = np.full(n, -1, np.int64)
    inner = np.flatnonzero(begin < np.arange(n))
    common[inner] = suffixes.common(order[inner - 1], order[inner])
    return order, common


def plain_order(suffixes: Suffixes, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same by the bytes themselves, for the case that a hash lied."""
    raw = suffixes.data.tobytes()
    text = [raw[a:b] for a, b in zip(suffixes.start.tolist(), suffixes.end.tolist(), strict=True)]
    order = sorted(range(len(group)), key=lambda i: (group[i], text[i]))
    common = [-1] * len(order)
    for k in range(1, len(order)):
        x, y = text[order[k - 1]], text[order[k]]
        if group[order[k]] == group[order[k - 1]]:
            common[k] = next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))
    return np.array(order, np.int64), np.array(common, np.int64)


def sorted_suffixes(suffixes: Suffixes, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order, common = suffix_order(suffixes, group)
    inner = np.flatnonzero(common >= 0)
    if suffixes.verified(order[inner - 1], order[inner], common[inner]):
        return order, common
    return plain_order(suffixes, group)


def repeated_windows(rows: Columns, raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows (row, bytes to the left of the anchor) that start earlier in another row, and those that do not.

    ``rows`` are in the order of doc, v, a; ``raw`` holds their bytes, one after the other.
    """
    n = len(rows["m"])
    left, count = rows["left"].astype(np.int64), rows["n"].astype(np.int64)
    size = count + length - 1
    start = np.cumsum(size) - size
    anchor = start + left
    _, group = np.unique(np.stack([rows["m"], rows["part"].astype(_U)]), axis=1, return_inverse=True) if n else (None, np.zeros(0, np.int64))
    by = np.argsort(group, kind="stable")
    labels = group[by]
    right = Suffixes(raw, anchor[by], (start + size)[by])
    flipped = raw[::-1].copy()
    back = Suffixes(flipped, (len(raw) - anchor)[by], (len(raw) - start)[by])
    orders = [sorted_suffixes(s, labels) for s in (right, back)]
    lowest = left - count + 1
    again_row, again_d, first_row, first_d = [], [], [], []
    for d in range(int(left.max()) + 1 if n else 0):
        classes = []
        for (order, common), depth in zip(orders, (length - d, d), strict=True):
            number = np.zeros(n, np.int64)
            number[by[order]] = np.cumsum(common < depth)
            classes.append(number)
        there = np.flatnonzero((lowest <= d) & (d <= left))
        if not len(there):
            continue
        _, at, which = np.unique(classes[0][there] * (n + 1) + classes[1][there], return_index=True, return_inverse=True)
        later = at[which] != np.arange(len(there))
        again_row.append(there[later])
        again_d.append(np.full(int(later.sum()), d))
        first_row.append(there[~later])
        first_d.append(np.full(int((~later).sum()), d))
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(again_row), join(again_d), join(first_row), join(first_d)


_SORTED = "kind string, bucket long, blob binary, ha long, hb long, doc long, v long, low int"
_SORTED_FIELDS = pa.schema([*_FIELDS, ("ha", pa.int64()), ("hb", pa.int64()), ("doc", pa.int64()), ("v", pa.int64()), ("low", pa.int32())])


def _resolve(doc_buckets: int, length: int):
    """Stage 4 for one bucket of anchors."""

    def run(table: pa.Table) -> pa.Table:
        chunks = table.column("blob").to_pylist()
        rows = unpack(chunks, WANTED)
        raw = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8)
        size = rows["n"].astype(np.int64) + length - 1
        start = np.cumsum(size) - size
        order = np.lexsort((rows["a"], rows["v"], rows["doc"]))
        total = np.cumsum(size[order])
        raw = raw[np.repeat(start[order] - total + size[order], size[order]) + np.arange(len(raw))] if len(raw) else raw
        rows = take(rows, order)
        row, d, first_row, first_d = repeated_windows(rows, raw, length)
        low = rows["a"][row].astype(np.int64) - d
        found = merged({"doc": rows["doc"][row], "v": rows["v"][row], "low": low, "high": low + length})
        out = list(blobs("range", found, bucket_of(found["doc"], doc_buckets), RANGE))
        shared = np.flatnonzero(rows["part"][first_row] > 0)
        row, d = first_row[shared], first_d[shared]
        begin = (np.cumsum(size[order]) - size[order])[row] + rows["left"][row].astype(np.int64) - d
        one, two = (Prefix(v[raw]).of(begin, begin + length) if len(raw) else np.zeros(0, _U) for v in (BYTE_VALUES, OTHER_VALUES))
        k, s = len(out), len(row)
        return pa.table(
            [
                pa.array([x[0] for x in out] + ["window"] * s, pa.string()),
                pa.array([x[1] for x in out] + [0] * s, pa.int64()),
                pa.array([x[2] for x in out] + [None] * s, pa.binary()),
                *(pa.concat_arrays([pa.nulls(k, t), pa.array(x.astype(t.to_pandas_dtype()) if x.dtype != _U else x.view(np.int64), t)]) for x, t in ((one, pa.int64()), (two, pa.int64()), (rows["doc"][row], pa.int64()), (rows["v"][row], pa.int64()), (rows["a"][row].astype(np.int64) - d, pa.int32()))),
            ],
            schema=_SORTED_FIELDS,
        )

    return run


def _cover(length: int):
    """Stage 5: removed bytes of one bucket of documents."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        rows = merged(unpack([b for b in found.column("blob").to_pylist() if b is not None], RANGE))
        start = {}
        keys = list(zip(rows["doc"].tolist(), rows["v"].tolist(), strict=True))
        for k, key in enumerate(keys):
            start.setdefault(key, k)
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")}
        for doc, v, text in zip(*(texts.column(c).to_pylist() for c in ("doc", "v", "text")), strict=True):
            raw = (text or "").encode()
            spans, k = [], start.get((doc, v), len(keys))
            while k < len(keys) and keys[k] == (doc, v):
                spans.append((int(rows["low"][k]), int(rows["high"][k])))
                k += 1
            kept, at = [], 0
            for low, high in spans:
                kept.append(raw[at:low])
                at = high
            kept.append(raw[at:])
            left = b"".join(kept)
            out["doc_id"].append(None if doc == NO_ID else doc)
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(len(raw) - len(left))
            out["n_spans"].append(len(spans))
            out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
            out["kept"].append(left)
            out["spans"].append([{"start": a, "end": b} for a, b in spans])
        return pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]))

    return run


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _document_segments(batches, length):
            # Of equal segments in a portion only the first goes on to stage 2, so only it counts.
            _, first = np.unique(mix(rows["m"] + rows["c"] * _U(0xD1342543DE82EF95)) ^ rows["e"].astype(_U), return_index=True)
            values, counts = np.unique(rows["m"][first], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts, pa.int64())], ["m", "n"])

    return run


def removed_substrings(docs: DataFrame, length: int = LENGTH, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, spans.

    Texts are UTF-8 bytes, a null is empty; windows never cross documents and are judged on
    the input. Earlier means a smaller doc_id, a null one before all others, or an earlier
    start in one document. Rows of one id with different texts are ordered by a hash of the
    text; rows of one id and text are one document and lose the same bytes. ``kept`` holds
    the remaining bytes, ``spans`` the maximal removed runs. No rows: no rows. Other columns
    are not read.
    """
    spark = docs.sparkSession
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    repeated = docs.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    source = docs.select(doc, (F.xxhash64(text) if repeated else F.lit(0).cast("long")).alias("v"), text.alias("text"))
    size = source.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    doc_buckets = prime_from(max(17, -(-size // BUCKET_BYTES)))
    buckets = doc_buckets

    counted = source.mapInArrow(tidied(_anchors(length)), "m long, n long").groupBy("m").agg(F.sum("n").alias("n"))
    often = counted.where(F.col("n") > anchor_rows).orderBy(F.desc("n")).limit(FREQUENT).toArrow()
    frequent = often.column("m").to_numpy().astype(np.int64).view(_U)
    parts = 1 + often.column("n").to_numpy().astype(np.int64) // anchor_rows + 1
    by = np.argsort(frequent)
    shared = spark.sparkContext.broadcast((buckets, doc_buckets, frequent[by], parts[by]))

    cut = source.mapInArrow(tidied(_cut(shared, length)), _BLOBS)
    met = stored(cut.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidied(_meet(shared, length)), _BLOBS), "segments")
    texts = source.withColumn("bucket", F.pmod("doc", F.lit(doc_buckets)))
    wanted = met.where("kind = 'wanted'").select("bucket", "blob")
    contexts = texts.groupBy("bucket").cogroup(wanted.groupBy("bucket")).applyInArrow(_fetch(buckets, length), _CONTEXT)
    resolved = stored(contexts.groupBy("part_bucket").applyInArrow(_resolve(doc_buckets, length), _SORTED), "resolved")
    found = met.where("kind = 'range'").select("bucket", "blob").unionByName(resolved.where("kind = 'range'").select("bucket", "blob"))
    if len(frequent):
        windows = resolved.where("kind = 'window'").select("ha", "hb", F.struct("doc", "v", "low").alias("place"))
        first = windows.groupBy("ha", "hb").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        later = windows.join(first, ["ha", "hb"]).where("place > first").select("place.*")
        found = found.unionByName(later.mapInArrow(_as_ranges(doc_buckets, length), _BLOBS).select("bucket", "blob"))
    return texts.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(_cover(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:int,end:int>>")


def _as_ranges(buckets: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, v, low = (batch.column(k).to_numpy().astype(np.int64) for k in range(3))
            found = merged({"doc": doc, "v": v, "low": low, "high": low + length})
            if out := list(blobs("range", found, bucket_of(found["doc"], buckets), RANGE)):
                yield _batch(out)

    return run

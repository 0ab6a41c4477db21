"""SentencePiece encoding with seeded merge-dropout, and decoding.

A text is cut into units that no merge can cross: at word marks, and at characters that no
piece contains. Within a unit, candidates (adjacent symbols whose concatenation is a piece)
wait in an agenda; the best score, then the leftmost, is taken next. Each candidate taken is
skipped for good with probability ``dropout``, so its rivals merge instead. Which are skipped
follows from a keyed hash (seed, document, unit and its place there): it gives the number of
candidates taken before the first skip, then between one skip and the next, each of them
geometric, which is the same as an independent draw for each candidate. So each occurrence of
a word is cut on its own, while the hash is drawn once for each skip.

Units are processed together, one candidate each a round. Each distinct unit of a block is
merged once without skips; an occurrence whose first skip would come later has the same
pieces. Of the others, those of equal unit and equal skips are merged once. Very long units
use a heap.

With ``dropout`` 0 the ids are those of the library. Every segmentation decodes to the text:
characters without a piece, and a literal word mark, become byte pieces.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import Prefix, mix

_U = np.uint64
MARK = 0x2581
NONE = np.int64(1) << 62
#: Units of more symbols than this go through the heap.
LONG_UNIT = 400
BLOCK_CHARS = 1 << 20
#: Units whose plain pieces a worker remembers, about.
CACHE_UNITS = 200_000
DROPOUT, SEED = 0.1, 17


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        normal = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)]
        ids = {names[i]: i for i in range(n) if normal[i]}
        symbols = dict(ids)
        for name in ids:  # characters that occur only inside longer pieces
            for c in name:
                symbols.setdefault(c, n + len(symbols))
        self.symbol = np.full(0x110000, -1, np.int64)
        for c, i in symbols.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i
        self.width = 1 << 20
        pairs = {}
        for name, i in ids.items():
            for k in range(1, len(name)):
                if name[:k] in symbols and name[k:] in symbols:
                    pairs[symbols[name[:k]] * self.width + symbols[name[k:]]] = i
        scores = sorted({-model.get_score(i) for i in pairs.values()})
        rank = {s: k for k, s in enumerate(scores)}
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.ranks = np.array([rank[-model.get_score(i)] for i in self.merged.tolist()], np.int64)
        self.shift = _U(64 - max(4, (4 * len(self.keys)).bit_length()))
        self.slots = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        waiting = np.arange(len(self.keys))
        at = self._slot(self.keys)
        while len(waiting):  # open addressing: who finds its slot taken tries the next one
            empty = self.slots[at] < 0
            self.slots[at[empty]] = waiting[empty]
            on = self.slots[at] != waiting
            waiting, at = waiting[on], (at[on] + 1) % len(self.slots)
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        raw = [bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else names[i].replace(chr(MARK), " ").encode() if normal[i] else b"" for i in range(n)]
        self.sizes = np.array([len(x) for x in raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        #: Extended symbols (and normal ones) as UTF-8, for symbols that never merged into a piece.
        self.extended = {i: c for c, i in symbols.items() if i >= n}
        self.n = n
        self.plain = Plain()

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged piece and rank of adjacent symbols; rank -1 where they make no piece."""
        key = left * self.width + right
        at = self._slot(key)
        found = self.slots[at]
        open_ = np.flatnonzero((found >= 0) & (self.keys[found] != key))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.slots)
            found[open_] = self.slots[at[open_]]
            open_ = open_[(found[open_] >= 0) & (self.keys[found[open_]] != key[open_])]
        there = (found >= 0) & (left >= 0) & (right >= 0)
        return self.merged[found], np.where(there, self.ranks[found], -1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(_U) * _U(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)


class Plain:
    """What units become without skips, as far as this worker has met them: code points and pieces by the hash of the code points."""

    def __init__(self):
        self.slot: dict[int, int] = {}
        self.codes, self.code_ends = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.pieces, self.piece_ends = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def find(self, content: np.ndarray, codes: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The slot of each unit, given hash and code points; -1 where it is new. Equal hashes of different units: all are new."""
        at = np.fromiter(map(self.slot.get, content.tolist(), repeat(-1)), np.int64, len(content))
        known = np.flatnonzero(at >= 0)
        size = np.diff(self.code_ends)[at[known]]
        if not np.array_equal(size, length[known]) or not np.array_equal(self.codes[_gather(self.code_ends[at[known]], size)], codes[_gather((np.cumsum(length) - length)[known], size)]):
            self.__init__()
            return np.full(len(content), -1)
        return at

    def add(self, content: np.ndarray, codes: np.ndarray, length: np.ndarray, pieces: np.ndarray, count: np.ndarray) -> None:
        if len(self.slot) > CACHE_UNITS:
            self.__init__()
        self.slot.update(zip(content.tolist(), range(len(self.slot), len(self.slot) + len(content)), strict=True))
        self.codes, self.pieces = np.concatenate([self.codes, codes]), np.concatenate([self.pieces, pieces])
        self.code_ends = np.concatenate([self.code_ends, self.code_ends[-1] + np.cumsum(length)])
        self.piece_ends = np.concatenate([self.piece_ends, self.piece_ends[-1] + np.cumsum(count)])


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def gaps(keys: np.ndarray, draw: int, dropout: float) -> np.ndarray:
    """How many candidates each key takes before its skip number ``draw``, counted from the skip before."""
    u = ((mix(keys + _U(draw * 0x9E3779B97F4A7C15 % 2**64)) >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53
    with np.errstate(divide="ignore"):
        return np.minimum(np.log(u) / np.log1p(-min(dropout, 1.0)), 2.0**40).astype(np.int64)


def skips(keys: np.ndarray, most: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """Key number and turn of every skip before turn ``most`` of each key, by key number within a draw."""
    at, owner, out, draw = gaps(keys, 0, dropout), np.arange(len(keys)), [], 0
    while len(owner := owner[on := at < most[owner]]):
        at = at[on]
        out.append((owner, at))
        draw += 1
        at = at + 1 + gaps(keys[owner], draw, dropout)
    return (np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def agenda(model: Pieces, symbols: list[int], key: np.uint64, dropout: float) -> list[int]:
    """One unit by a heap: candidates by rank, then place."""
    n = len(symbols)
    sym, start, end = list(symbols), list(range(n)), list(range(1, n + 1))
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(at: list[int]) -> None:
        at = [i for i in at if i >= 0 and after[i] >= 0]
        if not at:
            return
        left, right = np.array([sym[i] for i in at]), np.array([sym[after[i]] for i in at])
        merged, rank = model.pair(left, right)
        for i, m, r in zip(at, merged.tolist(), rank.tolist(), strict=True):
            if r >= 0:
                heapq.heappush(heap, (r, start[i], end[after[i]], sym[i], m))

    place = {start[i]: i for i in range(n)}
    offer(list(range(n)))
    own = np.array([key], _U)
    turn, draw, skip = -1, 0, int(gaps(own, 0, dropout)[0]) if dropout > 0 else -1
    while heap:
        _, a, b, first, merged = heapq.heappop(heap)
        i = place.get(a, -1)
        if i < 0 or sym[i] != first or after[i] < 0 or end[after[i]] != b:
            continue
        turn += 1
        if turn == skip:
            draw += 1
            skip = turn + 1 + int(gaps(own, draw, dropout)[0])
            continue
        j = after[i]
        sym[i], end[i], after[i] = merged, end[j], after[j]
        del place[start[j]]
        if after[j] >= 0:
            before[after[j]] = i
        offer([before[i], i])
    out, i = [], 0 if n else -1
    while i >= 0:
        out.append(sym[i])
        i = after[i]
    return out


def merge_units(model: Pieces, symbols: np.ndarray, bounds: np.ndarray, keys: np.ndarray, dropout: float, skipped: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Segment the units bounds[k]:bounds[k + 1] of ``symbols``: all final symbols, and the number of each unit's.

    ``skipped`` holds unit and turn of what is skipped in units of at most LONG_UNIT symbols; longer ones draw from their key.
    """
    who, turns = skipped or (np.zeros(0, np.int64), np.zeros(0, np.int64))
    by = np.argsort(turns, kind="stable")
    who, turns, turn = who[by], turns[by], 0
    skip = np.zeros(len(bounds) - 1, bool)
    n = len(bounds) - 1
    size = np.diff(bounds)
    results: list[tuple[np.ndarray, np.ndarray]] = []
    for k in np.flatnonzero(size > LONG_UNIT).tolist():
        done = agenda(model, symbols[bounds[k] : bounds[k + 1]].tolist(), keys[k], dropout)
        results.append((np.full(len(done), k), np.array(done, np.int64)))
    live = size <= LONG_UNIT
    unit = np.repeat(np.arange(n), size)
    keep = live[unit]
    unit, sym = unit[keep], symbols[keep]
    start = (np.arange(len(symbols)) - np.repeat(bounds[:-1], size))[keep]

    def judge(at: np.ndarray) -> None:
        right = np.minimum(at + 1, len(sym) - 1)
        merged, r = model.pair(sym[at], sym[right])
        good = (r >= 0) & (right > at) & (unit[at] == unit[right])
        target[at] = merged
        rank[at] = np.where(good, r * 512 + start[at], NONE)

    target, rank = np.zeros(len(sym), np.int64), np.full(len(sym), NONE)
    if len(sym):
        judge(np.arange(len(sym)))
    while len(sym):
        first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        count = np.diff(np.append(first, len(sym)))
        best = np.repeat(np.minimum.reduceat(rank, first), count)
        over = best == NONE
        if over.any():
            results.append((unit[over], sym[over]))
            on = ~over
            unit, sym, start, target, rank, best = unit[on], sym[on], start[on], target[on], rank[on], best[on]
            if not len(sym):
                break
        at = np.flatnonzero(rank == best)
        low, high = np.searchsorted(turns, (turn, turn + 1))
        turn += 1
        if low < high:
            skip[who[low:high]] = True
            gone = skip[unit[at]]
            rank[at[gone]] = NONE
            at = at[~gone]
            skip[who[low:high]] = False
            if not len(at):
                continue
        sym[at] = target[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        moved = np.cumsum(keep)[at] - 1
        unit, sym, start, target, rank = unit[keep], sym[keep], start[keep], target[keep], rank[keep]
        judge(moved)
        left = moved - 1
        left = left[(left >= 0) & (unit[np.maximum(left, 0)] == unit[moved])]
        if len(left):
            judge(left)
    if not results:
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    unit, sym = np.concatenate([r[0] for r in results]), np.concatenate([r[1] for r in results])
    order = np.argsort(unit, kind="stable")
    return sym[order], np.bincount(unit, minlength=n)


def _gather(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(first - total + size, size)


def _plain(model: Pieces, content: np.ndarray, codes: np.ndarray, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of distinct units without skips: those met before are looked up."""
    known = model.plain
    at = known.find(content, codes, length)
    new = np.flatnonzero(at < 0)
    picked = _gather((np.cumsum(length) - length)[new], length[new])
    fresh, fresh_count = merge_units(model, symbols[picked], np.concatenate([[0], np.cumsum(length[new])]), content[new], 0.0)
    count = np.diff(known.piece_ends)[at] if len(known.slot) else np.zeros(len(at), np.int64)
    begin = known.piece_ends[at]
    count[new], begin[new] = fresh_count, len(known.pieces) + np.cumsum(fresh_count) - fresh_count
    out = np.concatenate([known.pieces, fresh])[_gather(begin, count)]
    if len(np.unique(content[new])) == len(new):
        known.add(content[new], codes[picked], length[new], fresh, fresh_count)
    return out, count


def encode_texts(model: Pieces, texts: list[str], variants: np.ndarray, dropout: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts, all in one, and the number of each text's. ``variants``: the key of each text's dropout."""
    size = np.array([len(t) for t in texts], np.int64)
    lead = (size > 0).astype(np.int64)  # the word mark that a text begins with
    codes = np.zeros(int((size + lead).sum()), np.int64)
    bounds = np.concatenate([[0], np.cumsum(size + lead)])
    codes[bounds[:-1][lead > 0]] = MARK
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    inner = np.ones(len(codes), bool)
    inner[bounds[:-1][lead > 0]] = False
    codes[inner] = np.where(raw == 32, MARK, np.where(raw == MARK, -MARK, raw))
    sym = np.where(codes >= 0, model.symbol[np.maximum(codes, 0)], -1)
    if not len(sym):
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)

    cut = np.ones(len(sym), bool)  # a unit begins here
    mark = (codes == MARK) & (sym >= 0)
    cut[1:] = (mark[1:] & ~mark[:-1]) | (sym[1:] < 0) | (sym[:-1] < 0)
    cut[bounds[:-1][lead > 0]] = True
    first = np.flatnonzero(cut)
    unit_bounds = np.append(first, len(sym))
    length = np.diff(unit_bounds)
    doc = np.searchsorted(bounds, first, "right") - 1
    content = mix(Prefix(mix(codes.astype(_U) + _U(7))).of(first, unit_bounds[1:]) + length.astype(_U))
    order = np.unique(content, return_index=True, return_inverse=True)
    chosen, which = order[1], order[2]
    same = length == length[chosen][which]
    if same.all():  # equal hashes must mean equal units: compare their characters
        same = np.array_equal(codes, codes[_gather(first[chosen][which], length)])
    else:
        same = False
    if not same:
        chosen, which = np.arange(len(first)), np.arange(len(first))
    place = (first - bounds[doc]).astype(_U)
    key = mix(content + _U(seed % 2**64) + mix(mix(variants[doc].astype(_U) + _U(1)) + place))
    plain, plain_count = _plain(model, content[chosen], codes[_gather(first[chosen], length[chosen])], sym[_gather(first[chosen], length[chosen])], length[chosen])
    other, other_count, again, form = plain[:0], plain_count[:0], which[:0], which[:0]
    if dropout > 0:
        # A unit without skips takes as many candidates as it loses symbols.
        again = np.flatnonzero((gaps(key, 0, dropout) < (length[chosen] - plain_count)[which]) | (length > LONG_UNIT))
        size = length[again]
        # A merge offers two candidates at most, and a candidate is taken once.
        owner, turn = skips(key[again], np.where(size > LONG_UNIT, 0, 3 * (size - 1)), dropout)
        mask = np.zeros(len(again), _U)
        small = turn < 63
        np.bitwise_or.at(mask, owner[small], _U(1) << turn[small].astype(_U))
        alone = (3 * (size - 1) > 63) | (size > LONG_UNIT)  # skips that the mask does not hold: no other is equal
        same = np.lexsort((np.where(alone, np.arange(len(again)), -1), mask, which[again]))
        new = np.ones(len(again), bool)
        new[1:] = (which[again][same][1:] != which[again][same][:-1]) | (mask[same][1:] != mask[same][:-1]) | alone[same][1:] | alone[same][:-1]
        form = np.zeros(len(again), np.int64)
        form[same] = np.cumsum(new) - 1
        lead = same[new]
        number = np.full(len(again), -1)
        number[lead] = np.arange(len(lead))
        led = number[owner] >= 0
        at = again[lead]
        other, other_count = merge_units(model, sym[_gather(first[at], length[at])], np.concatenate([[0], np.cumsum(length[at])]), key[at], dropout, (number[owner[led]], turn[led]))
    count, begin = plain_count[which], (np.cumsum(plain_count) - plain_count)[which]
    count[again], begin[again] = other_count[form], (len(plain) + np.cumsum(other_count) - other_count)[form]
    out = np.concatenate([plain, other])[_gather(begin, count)]
    counts = np.bincount(doc, weights=count, minlength=len(texts)).astype(np.int64)

    odd = np.flatnonzero((out < 0) | (out >= model.n))  # characters as bytes
    if len(odd):
        unknown = np.abs(codes[sym < 0])
        text_of = [chr(c).encode("utf-8", "surrogatepass") for c in unknown.tolist()]
        parts, k = [], 0
        for s in out[odd].tolist():
            if s < 0:
                parts.append(text_of[k])
                k += 1
            else:
                parts.append(model.extended[s].encode())
        widths = np.ones(len(out), np.int64)
        widths[odd] = [len(p) for p in parts]
        owner = np.repeat(np.arange(len(texts)), counts)
        wide = np.repeat(out, widths)
        is_byte = np.repeat((out < 0) | (out >= model.n), widths)
        wide[is_byte] = model.byte_ids[np.frombuffer(b"".join(parts), np.uint8)]
        counts = np.bincount(owner, weights=widths, minlength=len(texts)).astype(np.int64)
        out = wide
    return out, counts


def decode_ids(model: Pieces, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """UTF-8 of each text from its ids."""
    size = model.sizes[ids]
    raw = model.raw[_gather(model.starts[ids], size)].tobytes()
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
    return [raw[a + 1 : b] if b > a else b"" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _encode(path: str, dropout: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            sizes = np.cumsum(pc.utf8_length(texts).to_numpy())
            chosen = pc.fill_null(batch.column(2), 0).to_numpy()
            first = 0
            while first < len(texts):
                last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + BLOCK_CHARS, "right")))
                own = texts.slice(first, last - first).to_pylist()
                ids, counts = encode_texts(model, own, chosen[first:last], dropout, seed)
                back = decode_ids(model, ids, counts)
                ends = np.concatenate([[0], np.cumsum(counts)])
                small = ids.astype("<u4")
                crc = [zlib.crc32(small[a:b].tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        batch.column(2).slice(first, last - first),
                        pa.array(counts, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
                        pa.array(crc, pa.int64()),
                        pa.array([zlib.crc32(b) for b in back], pa.int64()),
                        pa.array([b == t.encode() for b, t in zip(back, own, strict=True)], pa.bool_()),
                    ],
                    ["doc_id", "variant", "n_pieces", "piece_ids", "ids_crc32", "decoded_crc32", "lossless"],
                )
                first = last

    return run


def encode(docs: DataFrame, model: str, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): variant, n_pieces, piece_ids, ids_crc32, decoded_crc32, lossless.

    ``model`` is the path of a merge-type SentencePiece model with byte pieces. A document's
    variant is a keyed hash of its id, of its text where the id is null; with the place in the
    document it keys the dropout of each occurrence of a unit. Null and empty texts have no
    pieces and are lossless. Repeated rows are encoded row by row. ids_crc32 is over little-endian 32-bit
    ids, decoded_crc32 over the UTF-8 that the ids decode to.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    source = source.withColumn("variant", F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(seed))).otherwise(F.xxhash64("doc_id", F.lit(seed))))
    return source.mapInArrow(_encode(model, dropout, seed), "doc_id long, variant long, n_pieces long, piece_ids array<int>, ids_crc32 long, decoded_crc32 long, lossless boolean")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            lists = [np.array(x or [], np.int64) for x in batch.column(1).to_pylist()]
            counts = np.array([len(x) for x in lists], np.int64)
            back = decode_ids(model, np.concatenate(lists) if lists else np.zeros(0, np.int64), counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b.decode("utf-8", "surrogatepass") for b in back], pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows with doc_id and piece_ids; null lists give empty texts."""
    return encoded.select("doc_id", "piece_ids").mapInArrow(_decode(model), "doc_id long, text string")

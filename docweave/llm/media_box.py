"""ISO media containers as a column: walk nested boxes, decode sample tables, store facts about each track.

``probe`` turns a binary column of ISO files into rows of codec, duration and byte ranges of
keyframes. It reads boxes by their headers: payloads (mdat) are skipped, never decoded, and
tables that give one value for many samples stay runs, so a file costs what its tables hold.
``write_media`` keeps texts as such files: 8-bit PCM, one byte a sample, chunks of
``CHUNK_SAMPLES``; the edit list presents the text's bytes, what follows them is padding.
``read_media`` finds the payload through the sample table and computes digests and features.

Everything is one pass over the rows: no shuffle, one file of a batch in memory at a time.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import bound_batches, tidied

#: Payloads are padded to a positive multiple of this.
UNIT = 64
CHUNK_SAMPLES, RATE = 4096, 8000
TAIL = 64

# Boxes that hold boxes, and the matrix of a track shown as it is.
CONTAINERS = frozenset([b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"])
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


class BadMedia(ValueError):
    """A file that breaks the box structure or whose tables disagree."""


# --- reading ----------------------------------------------------------------------


class Box(NamedTuple):
    kind: bytes
    start: int
    body: int
    end: int


def boxes(data: memoryview, start: int, end: int) -> Iterator[Box]:
    """The boxes between two places; a size of 0 reaches to the end, one of 1 is followed by 64 bits."""
    while start < end:
        if end - start < 8:
            raise BadMedia("box header cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - body < 8:
                raise BadMedia("box header cut off")
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif size == 0:
            size = end - start
        if kind == b"uuid":
            body += 16
        if start + size > end or body > start + size:
            raise BadMedia(f"size of box {kind!r} leaves its parent")
        yield Box(kind, start, body, start + size)
        start += size


def walk(data: memoryview, start: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, Box]]:
    """Every box with the kinds above it, parents first; a track's place in the path tells tracks apart."""
    for place, box in enumerate(boxes(data, start, len(data) if end is None else end)):
        yield path, box
        if box.kind in CONTAINERS:
            yield from walk(data, box.body, box.end, (*path, (box.kind, place)))


def _table(data: memoryview, box: Box, width: int, skip: int = 8) -> np.ndarray:
    """The big-endian 32-bit (or, at width 0, 64-bit) entries of a full box, counted in the last word before them."""
    if box.end - box.body < skip:
        raise BadMedia(f"table {box.kind!r} cut off")
    count = struct.unpack_from(">I", data, box.body + skip - 4)[0]
    kind, cells = (">u8", count) if width == 0 else (">u4", count * width)
    if box.body + skip + cells * int(kind[-1]) > box.end:
        raise BadMedia(f"table {box.kind!r} has fewer entries than it counts")
    found = np.frombuffer(data, kind, cells, box.body + skip).astype(np.int64)
    return found if width == 0 else found.reshape(count, width)


class Track(NamedTuple):
    handler: str
    codec: str
    timescale: int
    duration: int
    presented: int | None
    n_samples: int
    sizes: int | np.ndarray
    chunk_starts: np.ndarray
    chunk_samples: np.ndarray
    sync: np.ndarray | None

    def chunk_ranges(self) -> np.ndarray:
        """(start, end) byte of every chunk."""
        if isinstance(self.sizes, int):
            return np.stack([self.chunk_starts, self.chunk_starts + self.chunk_samples * self.sizes], 1)
        upto = np.concatenate([[0], np.cumsum(self.sizes)])
        last = np.cumsum(self.chunk_samples)
        return np.stack([self.chunk_starts, self.chunk_starts + upto[last] - upto[last - self.chunk_samples]], 1)

    def keyframes(self) -> np.ndarray:
        """(start, end) byte of each run of sync samples that lie together; without a sync table every sample is one."""
        if self.sync is None:
            ranges = self.chunk_ranges()
        else:
            before = np.cumsum(self.chunk_samples) - self.chunk_samples
            chunk = np.searchsorted(before, self.sync, "right") - 1
            # Chunks without samples begin where the next one does; the last of them holds the sample.
            if isinstance(self.sizes, int):
                start = self.chunk_starts[chunk] + (self.sync - before[chunk]) * self.sizes
                ranges = np.stack([start, start + self.sizes], 1)
            else:
                upto = np.concatenate([[0], np.cumsum(self.sizes)])
                start = self.chunk_starts[chunk] + upto[self.sync] - upto[before[chunk]]
                ranges = np.stack([start, start + self.sizes[self.sync]], 1)
        ranges = ranges[ranges[:, 0] < ranges[:, 1]]
        if len(ranges) == 0:
            return ranges
        begins = np.concatenate([[True], ranges[1:, 0] != ranges[:-1, 1]])
        return np.stack([ranges[begins, 0], ranges[np.concatenate([begins[1:], [True]]), 1]], 1)


def _version(data: memoryview, box: Box) -> int:
    if box.end - box.body < 4:
        raise BadMedia(f"box {box.kind!r} cut off")
    return data[box.body]


def _field(data: memoryview, box: Box, kind: str, at: int) -> tuple:
    if box.body + at + struct.calcsize(kind) > box.end:
        raise BadMedia(f"box {box.kind!r} cut off")
    return struct.unpack_from(kind, data, box.body + at)


def _sizes(data: memoryview, found: dict[bytes, Box]) -> tuple[int | np.ndarray, int]:
    if b"stsz" in found:
        size, count = _field(data, found[b"stsz"], ">II", 4)
        return (size, count) if size else (_table(data, found[b"stsz"], 1, 12)[:, 0], count)
    if b"stz2" not in found:
        raise BadMedia("no sample sizes")
    box = found[b"stz2"]
    bits, count = _field(data, box, ">xxxBI", 4)
    if bits not in (4, 8, 16) or box.body + 12 + (count * bits + 7) // 8 > box.end:
        raise BadMedia("compact sizes cut off")
    raw = np.frombuffer(data, np.uint8 if bits < 16 else ">u2", (count * bits + 7) // 8 if bits < 16 else count, box.body + 12).astype(np.int64)
    if bits == 4:
        raw = np.stack([raw >> 4, raw & 15], 1).ravel()[:count]
    return raw, count


def _track(data: memoryview, found: dict[bytes, Box]) -> Track:
    for kind in (b"mdhd", b"hdlr", b"stsd", b"stts", b"stsc"):
        if kind not in found:
            raise BadMedia(f"track without {kind.decode()}")
    timescale, duration = _field(data, found[b"mdhd"], ">IQ" if _version(data, found[b"mdhd"]) else ">II", 20 if _version(data, found[b"mdhd"]) else 12)
    handler = _field(data, found[b"hdlr"], "4s", 8)[0].decode("latin-1")
    codec = _field(data, found[b"stsd"], "4s", 12)[0].decode("latin-1")
    presented = None
    if b"elst" in found:
        if _version(data, found[b"elst"]):
            rows = _field(data, found[b"elst"], ">I", 4)[0]
            presented = sum(_field(data, found[b"elst"], ">Q", 8 + 20 * k)[0] for k in range(rows))
        else:
            presented = int(_table(data, found[b"elst"], 3)[:, 0].sum())
    sizes, n = _sizes(data, found)
    starts = _table(data, found[b"stco"], 1)[:, 0] if b"stco" in found else _table(data, found[b"co64"], 0) if b"co64" in found else np.zeros(0, np.int64)
    runs = _table(data, found[b"stsc"], 3)
    if len(runs) and (runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any()):
        raise BadMedia("chunk runs out of order")
    until = np.append(runs[1:, 0], len(starts) + 1) if len(runs) else np.zeros(0, np.int64)
    per_chunk = np.repeat(runs[:, 1], np.clip(until - runs[:, 0], 0, None))[: len(starts)]
    if len(per_chunk) != len(starts) or int(per_chunk.sum()) != n:
        raise BadMedia("chunks and samples disagree")
    times = _table(data, found[b"stts"], 2)
    if int(times[:, 0].sum()) != n:
        raise BadMedia("times and samples disagree")
    if duration == 0:
        duration = int((times[:, 0] * times[:, 1]).sum())
    sync = _table(data, found[b"stss"], 1)[:, 0] - 1 if b"stss" in found else None
    if sync is not None and len(sync) and (sync[0] < 0 or sync[-1] >= n or (np.diff(sync) <= 0).any()):
        raise BadMedia("sync samples out of order")
    track = Track(handler, codec, timescale, duration, presented, n, sizes, starts, per_chunk, sync)
    ranges = track.chunk_ranges()
    if len(ranges) and (ranges[:, 1] > len(data)).any():
        raise BadMedia("chunk beyond the end of the file")
    return track


def tracks(raw: bytes) -> list[Track]:
    """The tracks of a file, in order; raises BadMedia."""
    data = memoryview(raw)
    found: dict[tuple, dict[bytes, Box]] = {}
    movie = False
    for path, box in walk(data):
        movie = movie or box.kind == b"moov"
        if box.kind == b"trak":
            found[(*path, (box.kind, None), box.start)] = {}
        elif any(kind == b"trak" for kind, _ in path):
            next(reversed(found.values())).setdefault(box.kind, box)
    if not movie:
        raise BadMedia("no moov box")
    return [_track(data, boxes_) for boxes_ in found.values()]


_PROBED = "key long, track int, handler string, codec string, timescale long, duration long, n_samples long, n_keyframes long, keyframes array<struct<start:long,end:long>>, error string"


@tidied
def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("key", pa.int64()), ("track", pa.int32()), ("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("n_keyframes", pa.int64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("error", pa.string())])
    for batch in batches:
        rows = []
        for key, media in zip(batch.column("key"), batch.column("media"), strict=True):
            row = {"key": key.as_py()}
            try:
                for k, t in enumerate(tracks(media.as_py() or b"")):
                    ranges = [{"start": int(a), "end": int(b)} for a, b in t.keyframes()]
                    rows.append(row | {"track": k, "handler": t.handler, "codec": t.codec, "timescale": t.timescale, "duration": t.duration, "n_samples": t.n_samples, "n_keyframes": t.n_samples if t.sync is None else len(t.sync), "keyframes": ranges})
            except BadMedia as why:
                rows.append(row | {"error": str(why)})
        yield pa.RecordBatch.from_pylist(rows, schema=kinds)


def probe(files: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """One row per track of each file: codec, duration, keyframe byte ranges (sync samples that lie together are one).

    A file that cannot be read has one row with ``error`` and no track; null and empty files
    lack a moov box. A file without tracks has no row. Null and repeated keys are kept.
    """
    bound_batches(files.sparkSession)
    return files.select(F.col(key).cast("long").alias("key"), F.col(media).alias("media")).mapInArrow(_probe, _PROBED).withColumnRenamed("key", key)


# --- writing ----------------------------------------------------------------------


def box(kind: bytes, *parts: bytes) -> bytes:
    return struct.pack(">I4s", 8 + sum(map(len, parts)), kind) + b"".join(parts)


def full(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


@functools.lru_cache(4096)
def _head(n_bytes: int, payload: int) -> bytes:
    """All of a file before its payload, which is ``payload`` samples of a byte of which ``n_bytes`` are presented.

    32-bit fields are enough: a cell of a table cannot reach 2 GB.
    """
    shown, whole = struct.pack(">I", n_bytes), struct.pack(">I", payload)
    chunks, rest = divmod(payload, CHUNK_SAMPLES)
    runs = ([(1, CHUNK_SAMPLES, 1)] if chunks else []) + ([(chunks + 1, rest, 1)] if rest else [])
    entry = box(b"ipcm", struct.pack(">6xH8xHHIH2x", 1, 1, 8, 0, RATE), full(b"pcmC", 0, 0, b"\1\x08"))
    brand = box(b"ftyp", b"isom", struct.pack(">I", 0), b"isomiso2")

    def movie(first: int) -> bytes:
        starts = np.arange(first, first + payload, CHUNK_SAMPLES, dtype=">u4")
        table = box(
            b"stbl",
            full(b"stsd", 0, 0, struct.pack(">I", 1), entry),
            full(b"stts", 0, 0, struct.pack(">III", 1, payload, 1)),
            full(b"stsc", 0, 0, struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", 0, 0, struct.pack(">II", 1, payload)),
            full(b"stco", 0, 0, struct.pack(">I", len(starts)), starts.tobytes()),
        )
        media = box(
            b"mdia",
            full(b"mdhd", 0, 0, bytes(8), struct.pack(">I", RATE), whole, struct.pack(">HH", 0x55C4, 0)),
            full(b"hdlr", 0, 0, struct.pack(">I4s12x", 0, b"soun"), b"\0"),
            box(b"minf", full(b"smhd", 0, 0, bytes(4)), box(b"dinf", full(b"dref", 0, 0, struct.pack(">I", 1), full(b"url ", 0, 1))), table),
        )
        track = box(
            b"trak",
            full(b"tkhd", 0, 3, bytes(8), struct.pack(">II", 1, 0), shown, struct.pack(">8xhhH2x", 0, 0, 0x100), MATRIX, bytes(8)),
            box(b"edts", full(b"elst", 0, 0, struct.pack(">I", 1), shown, struct.pack(">ihh", 0, 1, 0))),
            media,
        )
        return box(b"moov", full(b"mvhd", 0, 0, bytes(8), struct.pack(">I", RATE), shown, struct.pack(">IH10x", 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2)), track)

    return brand + movie(len(brand) + len(movie(0)) + 8) + struct.pack(">I4s", payload + 8, b"mdat")


def media_of(text: bytes) -> bytes:
    """The file that keeps ``text``, padded with bytes 0 to a positive multiple of UNIT."""
    padding = -len(text) % UNIT if text else UNIT
    return b"".join([_head(len(text), len(text) + padding), text, bytes(padding)])


@tidied
def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([media_of(t.as_py() or b"") for t in texts], pa.binary())], names=["doc_id", "media"])


def write_media(docs: DataFrame, folder: str) -> None:
    """Parquet rows of doc_id and media, one for each row of ``docs`` (doc_id, text), at ``folder``."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows.mapInArrow(_store, "doc_id long, media binary").write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(folder)


def payload(media: bytes, track: Track) -> bytes:
    """What the sample table of ``track`` points at, chunk after chunk."""
    data = memoryview(media)
    ranges = track.chunk_ranges()
    if len(ranges) and (ranges[1:, 0] == ranges[:-1, 1]).all():
        return bytes(data[ranges[0, 0] : ranges[-1, 1]])
    return b"".join(data[a:b] for a, b in ranges)


_FACTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


@tidied
def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, cell in zip(batch.column("doc_id").to_pylist(), batch.column("media"), strict=True):
            media = cell.as_py()
            (track,) = tracks(media)
            body = payload(media, track)
            keys = track.keyframes()
            feature = f"{track.handler} {track.codec} {track.duration}/{track.timescale} shown {track.presented} samples {track.n_samples} chunks {len(track.chunk_starts)} keyframes " + ",".join(f"{a}-{b}" for a, b in itertools.islice(keys.tolist(), 4))
            feature += f" of {len(keys)} {zlib.crc32(keys.astype('<i8').tobytes()):08x}"
            rows.append((key, track.presented, len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-TAIL:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        columns = list(zip(*rows, strict=True)) or [()] * 8
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def read_media(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file of ``write_media``: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    The payload's digest and the CRC of its last 64 bytes are those of the bytes that the
    sample table finds; n_bytes is what the edit list presents. Null texts are empty texts,
    whose payload is 64 zeros; null and repeated ids are kept; no rows: no rows. A damaged
    file raises. One file must fit in a worker.
    """
    bound_batches(spark)
    return spark.read.schema("doc_id long, media binary").parquet(folder).mapInArrow(_facts, _FACTS)

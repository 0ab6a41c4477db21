from __future__ import annotations

import hashlib
import struct
import zlib

import pytest
from docweave.llm import media_box as mb

SCHEMA = "doc_id long, text string"


def facts(spark, tmp_path, rows, schema=SCHEMA):
    folder = f"file://{tmp_path}/media"
    mb.write_media(spark.createDataFrame(rows, schema), folder)
    return mb.read_media(spark, folder).collect()


def find(data, *path):
    """An independent look-up: body of the first box on a path of kinds, all sizes being 32-bit."""
    for kind in path:
        at = 0
        while data[at + 4 : at + 8] != kind:
            at += int.from_bytes(data[at : at + 4], "big")
        data = data[at + 8 : at + int.from_bytes(data[at : at + 4], "big")]
    return data


def test_texts_come_back(spark, tmp_path):
    texts = ["", None, "a", "é" * 32, "x" * 63, "y" * 64, "z" * 65, "long " * 100_000, "a", "nul\0in it"]
    rows = [(k if k != 4 else None, t) for k, t in enumerate(texts)]
    got = sorted(facts(spark, tmp_path, [(*r, b"clash") for r in rows], SCHEMA + ", media binary"), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert len(got) == len(texts)
    for r in got:
        raw = (texts[4 if r.doc_id is None else r.doc_id] or "").encode()
        body = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        media = mb.media_of(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(body), hashlib.sha256(body).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(body[-64:]), len(media), hashlib.sha256(media).hexdigest())
        assert find(media, b"mdat") == body and media.endswith(body)
        table = find(media, b"moov", b"trak", b"mdia", b"minf", b"stbl")
        offsets = find(table, b"stco")
        assert media[int.from_bytes(offsets[8:12], "big") :][: len(body)] == body
        assert find(table, b"stsz")[4:] == struct.pack(">II", 1, len(body))
        assert int.from_bytes(find(media, b"moov", b"trak", b"mdia", b"mdhd")[16:20], "big") == len(body)
    same = [r[1:] for r in got if r.doc_id in (2, 8)]
    assert same[0] == same[1] and [r[1:] for r in got if r.doc_id == 0] == [r[1:] for r in got if r.doc_id == 1]
    assert facts(spark, tmp_path / "none", []) == []


def movie(tables, codec=b"avc1", handler=b"vide", first=b"", version=0):
    duration = struct.pack(">QQIQ", 0, 0, 1000, 4000) if version else struct.pack(">IIII", 0, 0, 1000, 4000)
    stsd = mb.full(b"stsd", 0, 0, struct.pack(">I", 1), mb.box(codec, bytes(78)))
    media = mb.box(b"mdia", mb.full(b"mdhd", version, 0, duration, bytes(4)), mb.full(b"hdlr", 0, 0, struct.pack(">I4s12x", 0, handler), b"\0"), mb.box(b"minf", mb.box(b"stbl", stsd, *tables)))
    return first + mb.box(b"moov", mb.box(b"trak", media))


def table(kind, *words, count=None, width=">I"):
    return mb.full(kind, 0, 0, struct.pack(">I", len(words) if count is None else count), *(struct.pack(width, w) for w in words))


VIDEO = [table(b"stts", 5, 10, 1, 30, count=2), table(b"stsc", 1, 2, 1, 3, 1, 1, count=2), mb.full(b"stsz", 0, 0, struct.pack(">II", 0, 6), struct.pack(">6I", 7, 1, 2, 3, 4, 5)), table(b"stss", 1, 2, 5, 6)]
# Chunks: samples 1-2 at 100, 3-4 at 200, 5 at 300, 6 at 304.
WANT = [(100, 108), (300, 309)]


def files():
    whole = [*VIDEO, table(b"stco", 100, 200, 300, 304)]
    far = struct.pack(">I4sQ", 1, b"free", 24) + bytes(8) + struct.pack(">I4s", 24, b"uuid") + bytes(16)
    compact = lambda bits, raw: [*VIDEO[:2], mb.full(b"stz2", 0, 0, bytes([0, 0, 0, bits]), struct.pack(">I", 6), raw), VIDEO[3], table(b"stco", 100, 200, 300, 304)]
    return {
        "plain": movie(whole),
        "wide": movie([*VIDEO, table(b"co64", 100, 200, 300, 304, width=">Q")], first=far, version=1),
        "four bits": movie(compact(4, bytes([0x71, 0x23, 0x45]))),
        "bytes": movie(compact(8, bytes([7, 1, 2, 3, 4, 5]))),
        "to the end": movie(whole) + struct.pack(">I4s", 0, b"mdat"),
    }


def test_probe(spark):
    good = {name: raw + bytes(400) if name == "to the end" else raw + mb.box(b"mdat", bytes(400)) for name, raw in files().items()}
    plain = good["plain"]
    bad = {
        "empty": b"",
        "null": None,
        "text": b"not a movie at all",
        "cut": plain[:-1],
        "no movie": mb.box(b"ftyp", b"isom"),
        "sizes": plain.replace(struct.pack(">II", 0, 6) + struct.pack(">I", 7), struct.pack(">II", 0, 9) + struct.pack(">I", 7)),
        "chunks": movie([*VIDEO, table(b"stco", 100, 200)]) + mb.box(b"mdat", bytes(400)),
        "beyond": movie([*VIDEO, table(b"stco", 100, 200, 300, 1 << 30)]) + mb.box(b"mdat", bytes(400)),
        "sync": plain.replace(table(b"stss", 1, 2, 5, 6), table(b"stss", 1, 2, 5, 7)),
        "missing": movie(VIDEO[1:]),
    }
    names = [*good, *bad]
    rows = [(k, good.get(n, bad.get(n))) for k, n in enumerate(names)]
    got = {names[r.doc_id]: r for r in mb.probe(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    for name in good:
        r = got[name]
        assert (r.error, r.codec, r.handler, r.timescale, r.duration, r.n_samples, r.n_keyframes) == (None, "avc1", "vide", 1000, 4000, 6, 4), name
        assert [tuple(k) for k in r.keyframes] == WANT, name
    for name in bad:
        assert got[name].error and got[name].codec is None, name
    own = mb.probe(spark.createDataFrame([(None, mb.media_of(b"x" * 9000))], "doc_id long, media binary")).collect()
    assert [(r.doc_id, r.codec, r.n_samples, r.duration) for r in own] == [(None, "ipcm", 9024, 9024)]
    assert [k.end - k.start for k in own[0].keyframes] == [9024]


def test_no_sync_table():
    (t,) = mb.tracks(movie([*VIDEO[:3], table(b"stco", 100, 200, 300, 304)]) + mb.box(b"mdat", bytes(400)))
    assert t.keyframes().tolist() == [[100, 108], [200, 205], [300, 309]]


@pytest.mark.parametrize("n", [0, 1, 64, 4096, 4097, 8192])
def test_round_trip_without_spark(n):
    raw = bytes(k % 251 for k in range(n))
    (t,) = mb.tracks(mb.media_of(raw))
    assert t.presented == n and mb.payload(mb.media_of(raw), t)[:n] == raw

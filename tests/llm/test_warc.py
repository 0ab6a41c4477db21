from __future__ import annotations

import hashlib

import pytest
from docweave.llm import warc
from docweave.llm.common import scratch_path


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, record_type int").repartition(3)


def round_trip(spark, rows):
    folder = scratch_path(spark, "test-warc")
    warc.write_archive(pages(spark, rows), folder)
    return folder, warc.read_records(spark, folder)


def brute(rows):
    head = {}
    for p, _, h, _ in rows:
        if h and len(h.encode()) >= 100 and p is not None:
            head[h] = min(p, head.get(h, p))
    out = []
    for p, _, h, _ in rows:
        raw = (h or "").encode()
        again = h in head and head[h] != p
        out.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", head[h] if again else None))
    return sorted(out, key=str)


def cases():
    big = "<p>é</p>" * 30
    texts = [big, "x" * 100, "y" * 99, "", None, "ends\r\n", "\r\n\r\nhead", "a\r\n\r\n\r\nb" * 40, "WARC/1.1\r\n\r\n" * 20, big + "\r", "z" * 300000, "\r\n"]
    rows = [(i, f"http://host{i}.example/é?q={i}", t, 1) for i, t in enumerate(texts)]
    rows += [(100 + i, None if i % 5 == 0 else "http://a\r\nb", texts[i % len(texts)], 2) for i in range(60)]
    return [*rows, (-3, "u", "x" * 100, 3)]


def test_round_trip_and_revisits(spark):
    rows = cases()
    _, records = round_trip(spark, rows)
    got = sorted((tuple(r) for r in warc.capture_digests(records).collect()), key=str)
    assert got == brute(rows)


def test_nested_captures_hold_the_payload(spark):
    rows = cases()
    _, records = round_trip(spark, rows)
    text = {p: h or "" for p, _, h, _ in rows}
    found = warc.captures(records).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.request.target_uri == r.response.target_uri and r.metadata.page_id == r.page_id
        assert r.request.record_id != r.response.record_id == r.capture_id
        if r.response.record_type == "response":
            assert bytes(r.response.payload).decode() == text[r.page_id]


def test_repeated_rows_and_nulls(spark):
    same = "s" * 200
    rows = [(5, "u", same, 1), (5, "u", same, 1), (7, "v", same, 1), (None, "w", same, 1), (None, None, None, 1), (5, "u", "t", 1), (5, "u", "t", 1)]
    _, records = round_trip(spark, rows)
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.capture_digests(records).collect()), key=str)
    assert got == sorted([(5, 200, "response", None), (5, 200, "revisit", 5), (7, 200, "revisit", 5), (None, 200, "revisit", 5), (None, 0, "response", None), (5, 1, "response", None), (5, 1, "response", None)], key=str)


def test_empty_table(spark):
    folder = scratch_path(spark, "test-warc")
    warc.write_archive(pages(spark, cases()).limit(0), folder)
    assert warc.read_records(spark, folder).count() == 0


def test_damaged_archives_are_refused():
    good = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 3"
    assert [b for _, b in warc.parse_records(iter([good, b"abc"]))] == [b"abc"]
    for bad in ([b"HTTP/1.1 200 OK"], [good, b"a"], [good]):
        with pytest.raises(ValueError, match="WARC|archive"):
            list(warc.parse_records(iter(bad)))


def test_every_record_is_a_member_of_its_own(spark):
    import glob

    rows = cases()
    folder, _ = round_trip(spark, rows)
    kinds, targets = [], {}
    for path in glob.glob(folder.removeprefix("file://") + "/part-*"):
        with open(path, "rb") as f:
            data = f.read()
        members = [m for m in data.split(warc.EMPTY_MEMBER) if m]
        found = [warc.parse_member(m)[0] for m in members]
        # Any reader of gzip files sees the same records.
        assert [h for h, _ in warc.read_file(path)] == found
        if found:
            assert found[0]["warc-type"] == "warcinfo" and all(h["warc-type"] != "warcinfo" for h in found[1:])
        kinds += [h["warc-type"] for h in found[1:]]
        targets |= {h["warc-record-id"]: h for h in found}
    assert len(kinds) == 3 * len(rows) and kinds.count("request") == kinds.count("metadata") == len(rows)
    again = [h for h in targets.values() if h["warc-type"] == "revisit"]
    assert again and all(targets[h["warc-refers-to"]]["warc-target-uri"] == h["warc-refers-to-target-uri"] for h in again)


def test_files_open_with_warcinfo_when_the_writer_rolls(spark):
    import glob

    folder = scratch_path(spark, "test-warc")
    warc.write_archive(pages(spark, cases()), folder, 20)
    records = warc.read_records(spark, folder)
    assert records.count() == 3 * len(cases())
    files = [warc.read_file(p) for p in glob.glob(folder.removeprefix("file://") + "/part-*")]
    files = [f for f in files if f]
    assert len(files) > 3 and all(f[0][0]["warc-type"] == "warcinfo" and len(f) <= 20 for f in files)


def test_revisits_are_held_against_their_response(spark):
    from pyspark.sql import functions as F

    rows = [(1, "u", "a" * 120, 1), (2, "v", "a" * 120, 1)]
    _, records = round_trip(spark, rows)
    wrong = F.when(F.col("kind") == "revisit", F.lit(7)).otherwise(F.col("payload_bytes"))
    with pytest.raises(Exception, match="revisit differs"):
        warc.capture_digests(records.withColumn("payload_bytes", wrong.cast("long"))).collect()
    lost = records.where("kind <> 'response'")
    assert [(r.record_type, r.refers_to) for r in warc.capture_digests(lost).where("page_id = 2").collect()] == [("revisit", None)]


def test_damaged_members_are_refused():
    good = warc._member(b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    assert warc.parse_member(good)[1] == b"abc"
    for bad in (good[:-3], b"plain", warc._member(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"), warc._member(b"HTTP/1.1 200 OK\r\n\r\n")):
        with pytest.raises(ValueError, match="archive|WARC"):
            warc.parse_member(bad)

from __future__ import annotations

from docweave.sources import files
from pyspark.sql import functions as F

FILES = {
    "store.db": b"12345", "store.db-wal": b"1", "Backups/b.bin": b"12", "Cache/c/d.bin": b"123", "Logs/l.txt": b"1234", "Temp/t": b"", "Temp": None, "note.txt": b"1",
    "WorkingCopies/v1/restored.docx": b"1234567", "WorkingCopies/v1/previous-1.docx": b"12", "WorkingCopies/v1/candidate-1.docx": b"1", "WorkingCopies/v1/operation.lock": b"", "Cache2/x": b"11",
}


def write(root, found):
    for path, raw in found.items():
        if raw is not None:
            (root / path).parent.mkdir(parents=True, exist_ok=True)
            (root / path).write_bytes(raw)


def test_usage_by_kind(spark, tmp_path):
    root = tmp_path / "data root"
    write(root, FILES)
    listed = files.listing(spark, str(root))
    assert {r.path: r.length for r in listed.collect()} == {k: len(v) for k, v in FILES.items() if v}  # empty files are not listed
    got = {r.kind: (r.files, r.bytes) for r in files.usage(listed).collect()}
    assert got == {"Database": (2, 6), "WorkingCopy": (1, 7), "Backup": (2, 4), "Cache": (1, 3), "Logs": (1, 4), "Temp": (1, 1), "Other": (2, 3)}
    without = files.usage(listed, spark.createDataFrame([("note.txt",), ("nowhere",)], "path string"))
    assert {r.kind: r.files for r in without.collect()}["Other"] == 1
    plan = files.usage(listed)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_manifests(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    write(a, FILES)
    write(b, {k: v for k, v in FILES.items() if k != "Logs/l.txt"} | {"Cache/c/d.bin": b"321", "Backups/b.bin": b"1", "Cache/new": b"x"})
    one, two = (files.manifest(files.listing(spark, str(x), content=True)) for x in (a, b))
    assert files.verified(one, one) and not files.verified(one, two)
    assert {r.path: r.what for r in files.differences(one, two).collect()} == {"Logs/l.txt": "Lost", "Cache/new": "Extra", "Backups/b.bin": "Resized", "Cache/c/d.bin": "Changed"}
    digests = lambda m: {r.folder: (r.files, r.bytes, r.digest) for r in files.folder_digests(m.orderBy(F.rand())).collect()}
    x, y = digests(one), digests(two)
    assert x == digests(one) and {f for f in x if x[f] == y.get(f)} == {"", "WorkingCopies/v1", "Cache2"}
    assert x["WorkingCopies/v1"][:2] == (3, 10)

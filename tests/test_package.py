"""Packages written from rows: what is written is read back, equal rows give equal bytes, manifests find what differs."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pytest
from docweave.operators import restore, review
from docweave.sources import docx, docx_build
from pyspark.sql import functions as F


def run(text, bold=None, color=None, tracked=None):
    return {"text": text, "bold": bold, "color": color, "tracked": tracked}


def block(runs=None, **more):
    return dict.fromkeys(("style", "level", "alignment", "changed", "comments", "table")) | {"runs": runs} | more


def comment(number, text="why"):
    return {"id": number, "author": 'A "quoted" <name>', "initials": None, "date": "2024-05-01T00:00:00Z", "text": text}


def track(kind, number):
    return {"kind": kind, "id": number, "author": "me", "date": None}


def cell(text, width=None, fill=None, span=None):
    return {"text": text, "width": width, "fill": fill, "span": span}


WHOLE = {
    "path": "w",
    "title": "T & <t>",
    "blocks": [
        block([run("Head", True)], style="Title", alignment="right", changed=track("ParagraphPropertyChange", "5")),
        block([run("a\tb\nc & <d>\r\x07 😀", color="00FF00"), run("gone", tracked=track("Delete", "6")), run("new", False, tracked=track("Insert", "7"))], level=1, comments=[comment("1", "two\nlines"), comment("2")]),
        block(table={"style": None, "width": "5000", "rows": [[cell("x", "10", "FFFF00"), cell(None)], [cell("wide", span=2)], []]}),
        block(None),
    ],
    "loose": [comment("9")],
}


def test_round_trip():
    content = docx_build.document(WHOLE)
    s = docx.parse("w", content)
    first, second, third = s["paragraphs"]
    assert s["title"] == "T & <t>" and [p["node"] for p in s["paragraphs"]] == [f"body/p[{k}]" for k in range(3)]
    assert (first["style"], first["direct"]["alignment"], first["runs"][0]["format"]["bold"]) == ("Title", "right", True)
    assert second["text"] == "a\tb\nc & <d>\r� 😀new" and second["raw"] == "a\tb\nc & <d>\r� 😀gonenew"
    assert second["numbering"] == {"numbering_id": 1, "level_index": 1, "abstract_id": 0, "number_format": "decimal", "level_text": "%1.%2.", "start_value": 1}
    assert second["runs"][0]["direct"]["color"] == "00FF00" and second["runs"][2]["direct"]["bold"] is False and third["text"] == ""
    assert sorted((r["kind"], r["revision_id"], r["text"], r["affected"]) for r in s["revisions"]) == [("Delete", "6", "gone", "body/p[1]/r[1]"), ("Insert", "7", "new", "body/p[1]/r[2]"), ("ParagraphPropertyChange", "5", "", "body/p[0]")]
    notes = {c["comment_id"]: c for c in s["comments"]}
    assert notes["1"]["text"] == "two\nlines" and notes["1"]["author"] == 'A "quoted" <name>'
    assert (notes["1"]["anchor_start"], notes["2"]["anchor_end"], notes["2"]["run"]) == ("body/p[1]/r[0]", "body/p[1]/r[2]", "body/p[1]/r[4]") and not notes["9"]["is_anchored"]
    cells = s["tables"][0]["cells"]
    assert [(c["row"], c["col"], c["text"], c["format"]["shading_fill"], c["format"]["grid_span"]) for c in cells] == [(0, 0, "x", "FFFF00", None), (0, 1, "", None, None), (1, 0, "wide", None, 2)]
    assert s["tables"][0]["format"]["width"] == "5000" and [d["code"] for d in s["diagnostics"]] == ["UnresolvedCommentAnchor"]


def test_order_of_elements_is_valid():
    order = ["pStyle", "numPr", "jc", "pPrChange", "b", "color", "tblStyle", "tblW", "tcW", "gridSpan", "shd"]
    with zipfile.ZipFile(io.BytesIO(docx_build.document(WHOLE))) as z:
        parts = {n: ElementTree.fromstring(z.read(n)) for n in z.namelist()}
    seen = [[e.tag.removeprefix(docx.W) for e in x] for name in ("pPr", "rPr", "tblPr", "tcPr") for x in parts[docx.PART].iter(docx.W + name)]
    assert any(len(x) > 2 for x in seen) and all(x == sorted(x, key=order.index) for x in seen)
    targets = {r.get("Target") for r in parts["word/_rels/document.xml.rels"]}
    assert targets == {"styles.xml", "numbering.xml", "comments.xml"} and len(parts) == 8


def test_equal_rows_give_equal_bytes():
    assert docx_build.document(WHOLE) == docx_build.document(WHOLE)
    assert docx_build.package(["a", "b"]) == docx_build.package(["a", "b"])


def test_empty_and_null_rows(spark):
    rows = spark.createDataFrame([("a", None, None, None), ("b", "", [], [])], docx_build.PACKAGE).withColumn("content", F.lit("clashing"))
    found = {r.path: (r.status, r.paragraphs, r.tables, r.comments) for r in docx_build.manifest(docx_build.structured(rows)).collect()}
    assert found == {k: ("Complete", 0, 0, 0) for k in "ab"}
    none = spark.createDataFrame([], docx_build.PACKAGE)
    assert docx_build.manifest(docx_build.structured(none)).count() == 0


def test_structured_equals_document(spark):
    rows = spark.createDataFrame([WHOLE], docx_build.PACKAGE)
    assert bytes(docx_build.structured(rows).head().content) == docx_build.document(WHOLE)


@pytest.fixture(scope="module")
def verdicts(spark):
    good = docx_build.package(["a", "b"])
    files = {k: good for k in ("same", "lost", "cut", "other", "big", "old", "counted")}
    make = lambda d: docx_build.manifest(spark.createDataFrame([(k, bytearray(x)) for k, x in d.items()], "path string, content binary"))
    expected = make(files | {"old": bytes.fromhex(docx.OLE) + b"x", "big": docx_build.package(["b"])}).withColumn("paragraphs", F.when(F.col("path") == "counted", 3).otherwise(F.col("paragraphs")))
    found = {k: c for k, c in files.items() if k != "lost"} | {"cut": good[:-9], "other": docx_build.package(["a", "c"]), "new": good, "old": bytes.fromhex(docx.OLE) + b"x", "big": good + b" " * 3000}
    return {r.path: r.reason for r in docx_build.verified(expected, make(found), most_bytes=3000).collect()}


def test_manifests_are_held_against_each_other(verdicts):
    assert verdicts == {"lost": "Missing", "new": "Unexpected", "cut": "IdentityMismatch", "other": "IdentityMismatch", "big": "TooLarge", "old": "Invalid", "counted": "CountMismatch"}


def test_dates_are_utc(spark):
    cases = {"2024-05-01T10:00:00Z": "2024-05-01 10:00:00", "2024-05-01T10:00:00+02:00": "2024-05-01 08:00:00", "2024-05-01T10:00:00": "2024-05-01 10:00:00", " 2024-05-01 ": "2024-05-01 00:00:00", "soon": None, "": None, None: None}
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, c string").select("k", docx.utc(F.col("c")).cast("string").alias("t"))
    assert [r.t for r in rows.orderBy("k").collect()] == list(cases.values())
    s = docx.dated(docx.parse_files(spark.createDataFrame([("w", bytearray(docx_build.document(WHOLE)))], "path string, content binary").withColumn("package", docx.sniff()))).head()
    assert {str(c.date_utc) for c in s.comments} == {"2024-05-01 00:00:00"} and s.created_utc is None and s.revisions[0].date_utc is None


def test_review_types_and_fields(spark):
    kind = "pair string, change_id string, kind string, b_text string, c_text string, spans array<string>, format string, revision_ids array<string>, comment_ids array<string>, c_location string, comment_details string"
    rows = [("x", k, kind, "Alpha", "", [], None, [], [], place, note) for k, kind, place, note in (("1", "ParagraphInsert", "第 5 段", ""), ("2", "NativeRevision", None, None), ("3", "Comment", None, "Ann · \nsee Beta"))]
    items = spark.createDataFrame(rows, kind)
    states = spark.createDataFrame([], "pair string, change_id string, state string")
    found = lambda **more: sorted(r.change_id for r in review.review_list(items, states, **more).collect())
    assert (found(type_="Text"), found(type_="Revision"), found(type_="Comment")) == (["1"], ["2"], ["3"])
    assert (found(search=" beta "), found(search="第 5"), found(search="ALPHA"), found(search="  "), found(search="b%")) == (["3"], ["1"], ["1", "2", "3"], ["1", "2", "3"], [])


def test_only_eligible_items_are_selected(spark):
    items = spark.createDataFrame([("a", "Cell", "Eligible"), ("b", "Table", "NeedsReview"), ("c", "Paragraph", "Eligible")], "item_id string, category string, eligibility string")
    ids = lambda **more: sorted(r.item_id for r in restore.select_scope(items, eligible_only=True, **more).collect())
    assert ids() == ["a", "c"] and ids(category="Table") == ["a"] and ids(ids=items.where("item_id <> 'a'").select("item_id")) == ["c"]

from __future__ import annotations

import json

import pytest
from docweave.functions import diff
from docweave.operators import annotate, display, history, preview, restore, review
from docweave.sources import docx
from pyspark.sql import functions as F

from tests.docx_builder import docx as package
from tests.docx_builder import p

SPAN = "array<struct<op:string,b_start:int,b_len:int,c_start:int,c_len:int,old:string,new:string>>"
FORMAT = "struct<scope:string,properties:array<struct<property:string,baseline:string,current:string>>>"
FILE = "struct<path:string,name:string,size:long,modified:string,sha256:string>"
CHANGES = f"pair string, change_id string, kind string, b_node string, c_node string, b_text string, c_text string, spans {SPAN}, format {FORMAT}, revision_ids array<string>, comment_ids array<string>, evidence array<string>, confidence string, codes array<string>"


def change(pair, name, kind="TextReplace", b=None, c=None, bt="", ct="", spans=(), form=None, r=(), m=()):
    return (pair, name, kind, b, c, bt, ct, list(spans), form, list(r), list(m), ["SnapshotDifference"], "Exact", [])


@pytest.fixture(scope="module")
def snapshot(spark):
    cell = lambda *t: "<w:tc>" + "".join(map(p, t)) + "</w:tc>"
    table = f"<w:tbl><w:tr>{cell('a', 'bc')}{cell('d')}</w:tr><w:tr>{cell('e')}{cell('f')}</w:tr><w:tr>{cell('g')}{cell('h')}</w:tr><w:tr>{cell('i')}</w:tr></w:tbl>"
    body = p("first", extra="<w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r>") + table + p("last") + "<w:tbl></w:tbl>"
    rows = spark.createDataFrame([("x.docx", package(body))], "path string, content binary")
    return docx.parse_files(rows.withColumn("package", docx.sniff())).select(F.lit("p").alias("pair"), "paragraphs", "tables")


def test_blocks_are_in_document_order(snapshot):
    got = [(r.position, r.label, r.is_table, len(r.cells)) for r in preview.blocks(snapshot).orderBy("position").collect()]
    assert got == [(0, "正文第 1 段", False, 1), (1, "表格 1 · 第 1 行", True, 2), (2, "表格 1 · 第 2 行", True, 2), (3, "表格 1 · 第 3 行", True, 2), (4, "表格 1 · 第 4 行", True, 1), (5, "正文第 2 段", False, 1), (6, "表格 2（无可预览行）", True, 0)]
    nodes = {r.node: r.position for r in preview.block_nodes(preview.blocks(snapshot)).collect()}
    assert nodes["body/tbl[0]"] == 1 and nodes["body/tbl[0]/tr[2]/tc[1]/p[0]"] == 3 and nodes["body/p[1]/r[0]"] == 5 and nodes["body/tbl[1]"] == 6
    assert preview.all_paragraphs(snapshot).count() == 10


def test_locations(snapshot):
    at = {r.node: r.location for r in display.locations(snapshot).collect()}
    assert at["body/p[0]/r[1]"] == "正文第 1 段" and at["body/tbl[0]"] == "表格 1" and at["body/tbl[0]/tr[1]"] == "表格 1 / 第 2 行"
    assert at["body/tbl[0]/tr[0]/tc[1]"] == "表格 1 / 第 1 行第 2 列" and at["body/tbl[0]/tr[0]/tc[0]/p[1]"] == "表格 1 / 第 1 行第 1 列 / 第 2 段"


def test_preview_marks_and_formats(spark, snapshot):
    span = [("Replace", 3, 4, 3, 2, "stbo", "xx")]
    cell = [("Replace", 0, 1, 0, 1, "d", "D")]
    df = spark.createDataFrame([change("p", "1", b="body/p[0]", spans=span), change("p", "2", "TableCellChange", b="body/tbl[0]/tr[0]/tc[1]", spans=cell), change("p", "3", "ParagraphDelete", b="body/p[1]")], CHANGES)
    rows = {r.paragraph: r for r in preview.preview(preview.blocks(snapshot), df, "b").collect()}
    got = [(s.text, s.marked, bool(s.format.bold)) for s in rows["body/p[0]"].segments]
    assert got == [("fir", False, False), ("st", True, False), ("bo", True, True), ("ld", False, True)]
    assert [(s.text, s.marked) for s in rows["body/tbl[0]/tr[0]/tc[1]/p[0]"].segments] == [("d", True)]
    assert [(s.text, s.marked) for s in rows["body/p[1]"].segments] == [("last", True)]
    assert [(s.text, s.marked) for s in rows["body/tbl[0]/tr[0]/tc[0]/p[0]"].segments] == [("a", False)]
    assert len(rows) == 11


def test_context_of_one_change(spark, snapshot):
    across = [("Replace", 0, 3, 0, 3, "a\nb", "x\ny")]
    df = spark.createDataFrame([change("p", "1", "TableCellChange", c="body/tbl[0]/tr[0]/tc[0]", spans=across), change("p", "2", c="body/p[1]", form=("Paragraph", [])), change("p", "3", c="nowhere"), change("p", "4")], CHANGES)
    rows = preview.context(preview.blocks(snapshot), df, "c").collect()
    near = {c: sorted({r.position for r in rows if r.change_id == c}) for c in "1234"}
    assert near == {"1": [0, 1, 2, 3], "2": [4, 5, 6], "3": [], "4": []}
    marked = {(r.change_id, r.paragraph): [(s.text, s.marked) for s in r.segments] for r in rows if r.paragraph}
    assert marked["1", "body/tbl[0]/tr[0]/tc[0]/p[0]"] == [("a", True)] and marked["1", "body/tbl[0]/tr[0]/tc[0]/p[1]"] == [("b", True), ("c", False)]
    assert marked["1", "body/tbl[0]/tr[0]/tc[1]/p[0]"] == [("d", False)] and marked["2", "body/p[1]"] == [("last", True)]


def test_segments_clip_what_overlaps(spark):
    df = spark.createDataFrame([("abcdef", [("R", 0, 3, 1, 1, "", ""), ("R", 2, 2, 3, 9, "", "")])], f"t string, s {SPAN}")
    cut = lambda side, whole=False: [tuple(x) for x in df.select(review.segments(F.col("t"), F.col("s"), side, whole, clipped=True)).head()[0]]
    assert cut("b") == [("abc", True), ("d", True), ("ef", False)]
    assert cut("c") == [("a", False), ("b", True), ("cdef", False)] and cut("c", True) == [("abcdef", True)]


def test_shown_values(spark):
    df = spark.createDataFrame([("FontSizeHalfPoints", "21"), ("FontSizeHalfPoints", "24"), ("Bold", "True"), ("Alignment", "both"), ("Other", "<null>"), ("Color", None), ("Color", "FF0000")], "n string, v string")
    got = [(r.a, r.b) for r in df.select(display.property_name(F.col("n")).alias("a"), display.value_text(F.col("n"), F.col("v")).alias("b")).collect()]
    assert got == [("字号", "10.5 磅"), ("字号", "12 磅"), ("粗体", "是"), ("对齐", "两端对齐"), ("其他格式（Other）", "未指定"), ("颜色", "未指定"), ("颜色", "FF0000")]
    texts = spark.createDataFrame([("",), (None,), ("x" * 70,), ("x" * 71,)], "t string").select(display.short(F.col("t"))).collect()
    assert [r[0] for r in texts] == ["（无）", "（无）", "x" * 70, "x" * 70 + "…"]


def test_locations_and_notes_join(spark):
    df = spark.createDataFrame([change("p", "1", b="n1", c="n9", r=["r1"], m=["k2", "k1"]), change("p", "2", c="n2")], CHANGES)
    at = spark.createDataFrame([("p", "n1", "one"), ("p", "n2", "two")], "pair string, node string, location string")
    got = {r.change_id: (r.b_location, r.c_location) for r in display.with_locations(df, at, at).collect()}
    assert got == {"1": ("one", "位置暂无法定位"), "2": ("无对应位置", "two")}
    revisions = spark.createDataFrame([("p", 0, "r1", "Delete", None, "2024-01-02T03:04:05Z", "gone")], "pair string, position int, revision_id string, kind string, author string, date string, text string")
    comments = spark.createDataFrame([("p", 0, "k1", "Li", None, "a"), ("p", 1, "k2", "Wu", "bad", "b"), ("p", 2, "k3", "Wu", None, "c")], "pair string, position int, comment_id string, author string, date string, text string")
    noted = {r.change_id: r for r in display.with_notes(df, revisions, comments).collect()}
    assert noted["1"].revision_details == "Word 删除修订 · 未知作者 · 2024-01-02 03:04\ngone" and noted["1"].comment_details == "Li · \na\nWu · \nb"
    assert noted["2"].revision_details == noted["2"].comment_details == ""


def test_input_flags(spark):
    s = "struct<path:string,sha256:string>"
    df = spark.createDataFrame([(("A", "1"), ("a", "1"), ("1",), ("1",)), (("A", "1"), ("B", "2"), ("1",), ("3",))], f"b {s}, c {s}, b_chosen struct<sha256:string>, c_chosen struct<sha256:string>")
    assert [(r.same_path, r.same_content, r.changed) for r in display.input_flags(df).collect()] == [(False, True, False), (False, False, True)]
    assert [r.same_path for r in display.input_flags(df, True).collect()] == [True, False]


def files(name, sha):
    return (f"/d/{name}", name, 5, "2024", sha)


@pytest.fixture(scope="module")
def kept(spark):
    schema = f"pair string, b_file {FILE}, c_file {FILE}, b_snapshot binary, c_snapshot binary, b_sha256 string, c_sha256 string, algorithm string, created timestamp"
    row = lambda pair, b, c, fb=None: (pair, files(f"{pair}.docx", fb or b), files("cur.docx", c), b"{}", b"{}", b, c, "1", None)
    inputs = spark.createDataFrame([row("p", "s1", "s2"), row("q", "s3", "S3".lower()), row("bad", "s4", "s5", "other")], schema)
    df = spark.createDataFrame([change("p", "b", spans=[("Insert", 0, 0, 0, 1, "", "x")]), change("p", "a", form=("Paragraph", [("Alignment", "left", None)])), change("bad", "z")], CHANGES)
    return inputs, df, history.save(inputs, df, "batch-1")


def test_saved_comparisons_load_again(spark, kept, tmp_path):
    _, df, saved = kept
    assert [tuple(r) for r in saved.refused.collect()] == [("bad", "InputIdentityChanged")]
    assert (saved.snapshots.count(), saved.results.count(), saved.records.count(), saved.states.count()) == (4, 2, 2, 2)
    loaded, refused = history.load(saved)
    rows = {r.pair: r for r in loaded.collect()}
    assert refused.count() == 0 and sorted(rows) == ["p", "q"] and rows["q"].result.changes == []
    items = rows["p"].result.changes
    assert [x.change_id for x in items] == ["a", "b"] and items[0].format.properties[0].baseline == "left" and items[1].spans[0].new == "x"
    payload = json.loads(bytes(saved.results.where("b_sha256 = 's1'").head().payload))
    assert payload["comparisonSchemaVersion"] == 1 and payload["metadata"]["currentSnapshotId"] == "sha256:s2"
    history.append(saved.records, str(tmp_path / "records"))
    history.append(saved.records.limit(0), str(tmp_path / "records"))
    assert history.by_id(spark, str(tmp_path / "records"), saved.records.where("pair = 'p'"), "record_id").count() == 1


def test_broken_histories_are_refused(spark, kept):
    _, _, saved = kept
    broken = lambda **k: {r.reason for r in history.load(history.Saved(**(vars(saved) | k)))[1].collect()}
    assert broken(states=saved.states.where("change_id = 'a'")) == {"InconsistentHistory"}
    assert broken(results=saved.results.limit(0)) == {"MissingResult"}
    assert broken(snapshots=saved.snapshots.where("sha256 <> 's2'")) == {"MissingCurrent"}
    assert broken(snapshots=saved.snapshots.withColumn("sha256", F.lit("s1"))) == {"InconsistentHistory"}
    assert broken(records=saved.records.withColumn("version", F.lit(9))) == {"UnsupportedVersion"}
    newer = F.regexp_replace(F.col("payload").cast("string"), '"comparisonSchemaVersion":1', '"comparisonSchemaVersion":2').cast("binary")
    assert broken(results=saved.results.withColumn("payload", newer)) == {"MissingResult"}


TEMPLATES = "id string, name string, is_enabled boolean, is_deleted boolean"
TEMPLATE_VERSIONS = "id string, template_id string, version string, is_current boolean, parse_status string, snapshot_id string, sha256 string"


def test_automatic_projects(spark, kept):
    _, _, saved = kept
    ids = {r.pair: r.record_id for r in saved.records.collect()}
    chosen = spark.createDataFrame([(ids["q"], "t", "tv", "sn")], "record_id string, template_id string, template_version_id string, snapshot_id string")
    tv = spark.createDataFrame([("tv", "t", "1", True, "Complete", "sn", "s3")], TEMPLATE_VERSIONS)
    make = lambda enabled: history.automatic_projects(saved.records, saved.states, chosen, tv, spark.createDataFrame([("t", "  ", enabled, False)], TEMPLATES))
    out = make(True)
    assert sorted((r.project_name, r.next_number, r.bound_version_id) for r in out["projects"].collect()) == [("p", 3, None), ("未命名合同", 2, "tv")]
    assert sorted(r.version_number for r in out["versions"].collect()) == [1, 1, 2] and out["rounds"].count() == 2
    assert sorted((r.baseline_type, r.total_changes) for r in out["links"].collect()) == [("Template", 0), ("Version", 2)]
    assert [tuple(r) for r in make(False)["refused"].collect()] == [(ids["q"], "TemplateChanged")]


def test_baselines(spark):
    projects = spark.createDataFrame([("P", "Active", "v1", None, None, 0), ("Q", "Active", None, "t", "Own", 0), ("R", "Archived", None, "u", None, 0), ("S", "Active", "w1", None, None, 0)], "id string, status string, baseline_version_id string, bound_template_id string, last_type string, updated int")
    versions = spark.createDataFrame([("v1", "P", "Own", 1, 1, "a"), ("v2", "P", "Counterparty", 2, 2, "b"), ("v3", "P", "Own", 2, 3, "c"), ("w1", "Q", "Unspecified", 1, 1, "d"), ("x1", "R", "Own", 1, 1, "e"), ("y1", "S", "Own", 1, 1, "f")], "id string, project_id string, role string, round_number int, version_number int, file_name string")
    templates = spark.createDataFrame([("t", "T", True, False), ("u", "U", False, False)], TEMPLATES)
    tv = spark.createDataFrame([("t1", "t", "1", False, "Complete", "s", "h"), ("t2", "t", "2", True, "Complete", "s", "h"), ("u1", "u", "1", True, "Complete", "s", "h")], TEMPLATE_VERSIONS)
    asked = spark.createDataFrame([("P", "v2"), ("Q", "w1"), ("R", "x1"), ("S", "y1"), ("P", "w1")], "project_id string, current_id string")
    options, refused = history.choices(asked, projects, versions, templates, tv)
    assert sorted(tuple(r) for r in refused.collect()) == [("P", "w1", "ForeignVersion"), ("S", "y1", "InvalidBaseline")]
    got = sorted((r.project_id, r.type, r.version_id, r.name, r.is_current) for r in options.collect())
    assert got == [("P", "Own", "v1", "我方 · 第 1 轮 · a", True), ("P", "Version", "v1", "V1 · a", False), ("P", "Version", "v3", "V3 · c", False), ("Q", "Template", "t1", "模板 · T · 1（历史）", False), ("Q", "Template", "t2", "模板 · T · 2（当前）", True), ("R", "Template", "u1", "模板 · U · 1（当前）", False)]
    told = {r.project_id: r for r in history.advice(asked.where("current_id in ('v2', 'w1', 'x1') and project_id || current_id <> 'Pw1'"), options, projects, versions, templates, tv).collect()}
    assert told["P"].recommendation == history.COUNTERPARTY_ADVICE and told["P"].default_version == "v1" and told["P"].warning is None
    assert told["Q"].default_version == "t2" and told["Q"].recommendation == history.NO_ADVICE and told["Q"].warning is None
    assert told["R"].default_version is None and told["R"].warning == history.DISABLED_TEMPLATE
    picks = spark.createDataFrame([("P", "v2", "Version", "v3"), ("P", "v2", "Template", "t1"), ("P", "v2", "Template", "u1"), ("P", "v2", "Version", "v2")], "project_id string, current_id string, type string, version_id string")
    resolved, lost = history.resolve(picks, options, templates, tv)
    assert {r.version_id: r.name for r in resolved.collect()} == {"v3": "V3 · c", "t1": "模板 · T · 1"} and sorted(r.version_id for r in lost.collect()) == ["u1", "v2"]
    wanted = spark.createDataFrame([("P", "v3"), ("Q", "w1"), ("R", "x1"), ("S", "v1")], "project_id string, version_id string")
    after, no = history.set_baseline(projects, versions, wanted, F.lit(7))
    assert {r.id: (r.baseline_version_id, r.updated) for r in after.collect()} == {"P": ("v3", 7), "Q": (None, 0), "R": (None, 0), "S": ("w1", 0)} and no.count() == 3


def test_comparisons_in_projects(spark, kept):
    inputs, _, saved = kept
    projects = spark.createDataFrame([("P", "Active", None, 0), ("R", "Archived", None, 0)], "id string, status string, last_type string, updated int")
    resolved = spark.createDataFrame([("P", "v2", "Own", "v1", "n", "p"), ("R", "x", "Own", "y", "n", "p"), ("P", "v2", "Version", "v1", "n", "q")], "project_id string, current_id string, type string, version_id string, name string, pair string")
    found = spark.createDataFrame([("p", "s1", "s2"), ("q", "s3", "moved")], "pair string, b_sha256 string, c_sha256 string")
    links, after, refused = history.save_in_projects(resolved, inputs, found, projects, saved, F.lit(9))
    assert [(r.project_id, r.baseline_type, r.total_changes) for r in links.collect()] == [("P", "Own", 2)]
    assert {r.id: (r.last_type, r.updated) for r in after.collect()} == {"P": ("Own", 9), "R": (None, 0)}
    assert sorted(tuple(r) for r in refused.collect()) == [("P", "q", "InputIdentityChanged"), ("R", "p", "ProjectNotActive")]


def test_pending(spark):
    ops = spark.createDataFrame([("v", "Prepared", 2), ("v", "Prepared", 1), ("v", "Done", 3), ("w", "Done", 4)], "version string, status string, created int")
    assert [r.created for r in history.of_key(ops, "version", "v", [F.asc("created")], F.col("status") == "Prepared").collect()] == [1, 2]
    owners = spark.createDataFrame([("v",), ("w",), ("x",)], "version string")
    assert {r.version: r.pending for r in history.pending_counts(owners, "version", ops).collect()} == {"v": 2, "w": 0, "x": 0}


def test_revisions_carry_their_format_marker(spark):
    df = spark.createDataFrame([], CHANGES)
    schema = "pair string, revision_id string, kind string, text string, affected string, paragraph string, run string, is_supported boolean, previous string"
    revisions = spark.createDataFrame([("p", "1", "Format", "", "n", "n", None, True, "Character"), ("p", "2", "Insert", "t", "m", "m", None, True, None)], schema)
    comments = spark.createDataFrame([], "pair string, comment_id string, text string, paragraph string, run string, anchor_start string, anchor_end string, is_anchored boolean")
    got = {r.change_id: r.format for r in annotate.integrate(df, revisions, comments).collect()}
    assert got["revision:2"] is None and got["revision:1"].scope == "Character" and got["revision:1"].properties[0].asDict() == {"property": "NativeRevisionPreviousFormat", "baseline": "available", "current": "current"}


def test_whole_comparison_of_packages(spark):
    from docweave.plans import versions

    cell = lambda t: f"<w:tbl><w:tr><w:tc>{p(t)}</w:tc></w:tr></w:tbl>"
    bold = lambda t: f"<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>{t}</w:t></w:r></w:p>"
    revised = "<w:p><w:r><w:rPr><w:rPrChange w:id='7'><w:rPr/></w:rPrChange></w:rPr><w:t>last line</w:t></w:r></w:p>"
    parse = lambda body: docx.parse_files(spark.createDataFrame([("x.docx", package(body))], "path string, content binary").withColumn("package", docx.sniff())).withColumn("pair", F.lit(1))
    base = parse(p("payment in 30 days") + p("same text") + cell("old") + p("last line"))
    cur = parse(p("payment in 60 days") + bold("same text") + cell("new") + revised)
    out = versions.compare_snapshots(base, cur)
    items = {r.change_id: r for r in versions.order_items(out.changes).collect()}
    assert list(items) == sorted(items) and len(items) == 4
    assert items["format:Character:body/p[1]:body/p[1]"].format.properties[0].property == "Bold"
    assert items["cell:body/tbl[0]/tr[0]/tc[0]:body/tbl[0]/tr[0]/tc[0]"].spans[0].new == "new"
    assert items["text:body/p[0]:body/p[0]"].kind == "TextReplace"
    assert items["revision:7"].kind == "NativeRevision" and items["revision:7"].format.scope == "Character"
    counted = out.statistics.head()
    assert (counted.total_changes, counted.text_changes, counted.format_changes) == (4, 2, 2)


ASTRAL = [("😀😀甲方付款", "😀😀乙方付款", "乙"), ("a😀b", "a😀𝄞b", "𝄞"), ("😀😀甲方", "😀😀乙方", "乙"), ("x😀y\ue000z", "x😀q\ue000z", "q"), ("𝄞\ue000", "𝄞\ue000😀", "😀")]


def test_marks_behind_characters_of_two_units(spark):
    df = spark.createDataFrame(ASTRAL, "old string, new string, want string").withColumn("spans", diff.diff_spans("old", "new"))
    cut = review.segments(F.col("new"), F.col("spans"), "c")
    runs = F.array(F.struct(F.substring("new", 1, 2).alias("text"), F.lit("a").alias("format")), F.struct(F.substring("new", 3, 99).alias("text"), F.lit("b").alias("format")))
    for r in df.select("*", cut.alias("cut"), preview.formatted(cut, runs, F.col("new")).alias("parts")).collect():
        assert "".join(p.text for p in r.cut) == r.new and [p.text for p in r.cut if p.marked] == [r.want]
        assert "".join(p.text for p in r.parts) == r.new and "".join(p.text for p in r.parts if p.marked) == r.want


def test_cell_paragraphs_behind_characters_of_two_units(spark):
    """The second paragraph of a cell whose first has such characters keeps its mark."""
    cell = {"node": "c", "text": "😀😀\n甲方", "paragraphs": [{"node": "p0", "text": "😀😀", "runs": [], "alignment": None}, {"node": "p1", "text": "甲方", "runs": [], "alignment": None}]}
    kinds = "pair string, position int, node string, label string, is_table boolean, table int, cells array<struct<node:string,text:string,paragraphs:array<struct<node:string,text:string,runs:array<struct<node:string,text:string,format:string>>,alignment:string>>>>"
    shown = spark.createDataFrame([("p", 0, "t", "", True, 0, [cell])], kinds)
    assert [(r.k, r.offset) for r in preview.flat(shown).orderBy("k").collect()] == [(0, 0), (1, 5)]
    spans = spark.createDataFrame([("😀😀\n甲方", "😀😀\n乙方")], "b string, c string").select(diff.diff_spans("b", "c").alias("s"))
    cut = spans.select(preview.clip(F.col("s"), F.lit(5), F.lit(2), "b").alias("s")).head().s
    assert [(s.b_start, s.b_len) for s in cut] == [(0, 1)]
    near = spans.select(review.segments(F.lit("甲方"), preview.clip(F.col("s"), F.lit(5), F.lit(2), "b"), "b").alias("g")).head().g
    assert [(p.text, p.marked) for p in near] == [("甲", True), ("方", False)]


def test_runs_behind_characters_of_two_units(spark):
    """The run that a format goes to is found by the same units as the spans."""
    kind = "pair string, idx int, runs array<struct<node:string,text:string,format:struct<color:string>>>"
    run = lambda node, text, color: (node, text, (color,))
    base = spark.createDataFrame([("x", 0, [run("b0", "😀😀", "red"), run("b1", "甲", "blue"), run("b2", "方", "green")])], kind)
    cur = spark.createDataFrame([("x", 0, [run("c0", "😀😀", "red"), run("c1", "乙", "black"), run("c2", "方", "green")])], kind)
    maps = spark.createDataFrame([("x", 0, 0, "High", 0.9)], "pair string, b_idx int, c_idx int, confidence string, score double")
    spans = maps.select("pair", "b_idx", "c_idx", diff.diff_spans(F.lit("😀😀甲方"), F.lit("😀😀乙方")).alias("spans"))
    items, notes = restore.run_plan(maps, base, cur, spans, {"Color": "color"})
    assert [(r.b_node, r.c_node) for r in items.collect()] == [("b1", "c1")] and notes.count() == 0
    assert [(r.start, r.stop) for r in restore.run_ranges(base).orderBy("k").collect()] == [(0, 4), (4, 5), (5, 6)]

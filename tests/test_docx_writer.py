from __future__ import annotations

import hashlib
import io
import zipfile

import pytest
from docweave.sources import docx as dx
from docweave.sources import docx_writer as dw

from tests.docx_builder import docx, p

BODY = p("one", "<w:jc w:val='left'/>") + p("", "", "<w:r><w:rPr><w:b/><w:color w:val='FF0000'/></w:rPr><w:t>two</w:t></w:r>") + "<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val='2'/></w:tcPr>" + p("c") + "</w:tc></w:tr></w:tbl>"
ITEMS = [
    {"node": "body/p[0]", "category": "Paragraph", "target": {"alignment": "center", "left_indent": "720"}},
    {"node": "body/p[1]/r[0]", "category": "Character", "target": {"bold": None, "italic": True, "color": "FF0000", "ascii": "Arial"}},
    {"node": "body/tbl[0]/tr[0]/tc[0]", "category": "Cell", "target": {"shading_fill": "EEEEEE", "grid_span": 9}},
]


def test_render_and_revert():
    content = docx(BODY, footer1="<w:ROOT/>")
    made, done = dw.render(content, ITEMS)
    s = dx.parse("", made)
    assert s["paragraphs"][0]["direct"]["alignment"] == "center" and s["paragraphs"][0]["direct"]["left_indent"] == "720"
    look = s["paragraphs"][1]["runs"][0]["direct"]
    assert look["bold"] is None and look["italic"] is True and look["color"] == "FF0000" and look["fonts"]["ascii"] == "Arial"
    cell = s["tables"][0]["cells"][0]["format"]
    assert cell["shading_fill"] == "EEEEEE" and cell["grid_span"] == 2
    assert len(done) == 6 and dw.violations(content, made) == []
    back = dw.revert(made, hashlib.sha256(made).hexdigest(), done)
    a, b = dx.parse("", content), dx.parse("", back)
    assert {k: v for k, v in a.items() if k != "sha256"} == {k: v for k, v in b.items() if k != "sha256"}


def test_guards():
    content = docx(BODY)
    made, done = dw.render(content, ITEMS)
    with pytest.raises(dw.Refused, match="changed"):
        dw.revert(made, "0" * 64, done)
    with pytest.raises(dw.Refused, match="restored state"):
        dw.revert(content, hashlib.sha256(content).hexdigest(), done)
    with pytest.raises(dw.Refused, match="unknown node"):
        dw.render(content, [{"node": "body/p[9]", "category": "Paragraph", "target": {}}])
    assert dw.violations(content, docx(BODY.replace("one", "uno"))) == ["Text"]


def test_render_all(spark):
    packages = spark.createDataFrame([("a", docx(BODY)), ("b", docx(p("x")))], "path string, content binary")
    items = spark.createDataFrame([("a", "body/p[0]", "Paragraph", {"alignment": "right"}), ("b", "body/p[0]/r[0]", "Character", {"bold": "true"})], "path string, node string, category string, target map<string,string>")
    got = {r.path: r for r in dw.render_all(packages, items).collect()}
    assert dx.parse("", bytes(got["a"].content))["paragraphs"][0]["direct"]["alignment"] == "right"
    assert dx.parse("", bytes(got["b"].content))["paragraphs"][0]["runs"][0]["direct"]["bold"] is True
    assert all(r.violations == [] and len(r.mutations) == 1 for r in got.values())
    assert all(r.refused is None for r in got.values())
    made = spark.createDataFrame([(r.path, r.content) for r in got.values()], "path string, content binary")
    journal = spark.createDataFrame([(r.path, r.sha256 if r.path == "a" else "0" * 64, r.mutations) for r in got.values()], f"path string, sha256 string, mutations {dw.MUTATIONS}")
    back = {r.path: r for r in dw.revert_all(made, journal).collect()}
    assert zipfile.ZipFile(io.BytesIO(bytes(back["a"].content))).read(dx.PART) == zipfile.ZipFile(io.BytesIO(docx(BODY))).read(dx.PART)
    assert back["b"].content is None and "changed" in back["b"].refused
    odd = dw.render_all(packages, spark.createDataFrame([("a", "body/p[7]", "Paragraph", {"alignment": "right"})], items.schema)).collect()
    assert [(r.path, r.content) for r in odd] == [("a", None)] and "unknown node" in odd[0].refused


HEAD = "<?xml version='1.0' encoding='UTF-8'?>\n<w:document xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main' xmlns:mc=\"http://schemas.openxmlformats.org/markup-compatibility/2006\" xmlns:w14=\"http://schemas.microsoft.com/office/word/2010/wordml\" mc:Ignorable=\"w14\">"
ODD = (
    "<w:body><!-- a > b --><w:p w14:paraId='1'><w:pPr>\n <w:keepNext/>\n <w:rPr><w:b/></w:rPr>\n</w:pPr><w:r><w:rPr><w:rFonts w:hint=\"a>b\"/><w:sz w:val = '20' /></w:rPr><w:t>甲😀 &amp; one</w:t></w:r></w:p>"
    "<w:p/><w:p><w:pPr/><w:r><w:t>two</w:t></w:r></w:p><w14:odd x='1'/><w:tbl><w:tblPr><w:tblLook w:val='04A0'/></w:tblPr><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>"
)


def package(document):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr(dx.PART, document)
    return out.getvalue()


def document(content):
    return zipfile.ZipFile(io.BytesIO(content)).read(dx.PART)


def test_only_touched_ranges_change():
    """Declarations, comments, entities, spacing and unknown markup stay; new properties stand in the schema's order."""
    content = package(HEAD + ODD)
    items = [
        {"node": "body/p[0]", "category": "Paragraph", "target": {"alignment": "center", "left_indent": "720"}},
        {"node": "body/p[0]/r[0]", "category": "Character", "target": {"italic": True, "bold": True, "ascii": 'A "quoted" & <font>', "color": "00FF00"}},
        {"node": "body/p[1]", "category": "Paragraph", "target": {"alignment": "right"}},
        {"node": "body/p[2]", "category": "Paragraph", "target": {"alignment": "right"}},
        {"node": "body/tbl[0]", "category": "Table", "target": {"alignment": "center"}},
        {"node": "body/tbl[0]/tr[0]/tc[0]", "category": "Cell", "target": {"shading_fill": "EEEEEE"}},
    ]
    made, done = dw.render(content, items)
    want = (
        "<w:body><!-- a > b --><w:p w14:paraId='1'><w:pPr>\n <w:keepNext/>\n <w:ind w:left=\"720\"/><w:jc w:val=\"center\"/><w:rPr><w:b/></w:rPr>\n</w:pPr><w:r><w:rPr><w:rFonts w:hint=\"a>b\" w:ascii='A \"quoted\" &amp; &lt;font&gt;'/><w:b/><w:i/><w:color w:val=\"00FF00\"/><w:sz w:val = '20' /></w:rPr><w:t>甲😀 &amp; one</w:t></w:r></w:p>"
        "<w:p><w:pPr><w:jc w:val=\"right\"/></w:pPr></w:p><w:p><w:pPr><w:jc w:val=\"right\"/></w:pPr><w:r><w:t>two</w:t></w:r></w:p><w14:odd x='1'/><w:tbl><w:tblPr><w:jc w:val=\"center\"/><w:tblLook w:val='04A0'/></w:tblPr><w:tr><w:tc><w:tcPr><w:shd w:fill=\"EEEEEE\"/></w:tcPr><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>"
    )
    assert document(made).decode() == HEAD + want
    assert dw.violations(content, made) == [] and len(done) == 10
    assert dx.parse("", made)["paragraphs"][0]["runs"][0]["direct"]["fonts"]["ascii"] == 'A "quoted" & <font>'
    back = dw.revert(made, hashlib.sha256(made).hexdigest(), done)
    gone = "<w:p><w:pPr></w:pPr></w:p>"  # containers that were not there are left empty
    assert document(back).decode() == HEAD + ODD.replace("<w:p/><w:p><w:pPr/>", gone + "<w:p><w:pPr></w:pPr>").replace("<w:tc><w:p/>", "<w:tc><w:tcPr></w:tcPr><w:p/>")
    assert dw.render(content, []) == (content, [])


def test_writing_in_steps():
    """Attributes of one property one by one, a value changed twice, and a property taken away."""
    content = package(HEAD + ODD)
    made, done = dw.render(content, [{"node": "body/p[0]/r[0]", "category": "Character", "target": {"ascii": "A", "east_asia": "B", "size": None}}])
    assert b"<w:rFonts w:hint=\"a>b\" w:ascii=\"A\"" in document(made)
    again, more = dw.render(made, [{"node": "body/p[0]/r[0]", "category": "Character", "target": {"ascii": "C"}}])
    assert b'w:ascii="C"' in document(again) and [m["before"] for m in more] == [(True, "A")]
    back = dw.revert(dw.revert(again, hashlib.sha256(again).hexdigest(), more), hashlib.sha256(made).hexdigest(), done)
    assert document(back) == document(content)


def test_broken_markup_is_seen():
    content = package(HEAD + ODD)
    assert dw.violations(content, package(HEAD.replace(' xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml"', "") + ODD.replace(" w14:paraId='1'", "").replace("<w14:odd x='1'/>", ""))) == ["Namespaces"]
    late = "<w:rPr><w:b/></w:rPr><w:jc w:val='center'/>"
    assert dw.violations(content, package(HEAD + ODD.replace("<w:rPr><w:b/></w:rPr>", late, 1))) == ["Order"]
    with pytest.raises(dw.Refused, match="no XML"):
        dw.index(b"<a><b></a>")

"""Small Word packages built from XML for tests."""

from __future__ import annotations

import io
import zipfile

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def docx(body: str, **parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        for name, xml in parts.items():
            path = {"core": "docProps/core.xml", "rels": "word/_rels/document.xml.rels"}.get(name, f"word/{name}.xml")
            z.writestr(path, xml.replace("<w:ROOT", f"<w:{name} {NS}").replace("</w:ROOT", f"</w:{name}"))
    return out.getvalue()


def p(text: str = "", props: str = "", extra: str = "") -> str:
    run = f"<w:r><w:t>{text}</w:t></w:r>" if text else ""
    return f"<w:p><w:pPr>{props}</w:pPr>{run}{extra}</w:p>"


STYLES = (
    "<w:ROOT><w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val='21'/></w:rPr></w:rPrDefault></w:docDefaults>"
    "<w:style w:type='paragraph' w:styleId='Base' w:default='1'><w:rPr><w:b/></w:rPr><w:pPr><w:jc w:val='left'/></w:pPr></w:style>"
    "<w:style w:type='paragraph' w:styleId='Title'><w:basedOn w:val='Base'/><w:rPr><w:b/><w:color w:val='FF0000'/></w:rPr><w:pPr><w:jc w:val='center'/></w:pPr></w:style>"
    "<w:style w:type='paragraph' w:styleId='Loop'><w:basedOn w:val='Loop2'/></w:style><w:style w:type='paragraph' w:styleId='Loop2'><w:basedOn w:val='Loop'/></w:style>"
    "<w:style w:type='character' w:styleId='Strong'><w:rPr><w:b/></w:rPr></w:style></w:ROOT>"
).replace("w:ROOT", "w:ROOT")

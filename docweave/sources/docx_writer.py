"""Writing restored formats into Word packages, undoing them, and checking that nothing else changed.

The document is not written anew: an index of byte offsets tells where each element's tags
stand, and only the property containers of planned items are cut out and put back, new
properties at their place in the schema's order. All other bytes of the document and every
other part of the package stay as they are. Each change is a mutation (node, container,
field, before, after), so a restored package can be taken back.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.sources import docx
from docweave.sources.docx import OFF, PART, W

#: Where a category keeps its properties, and which fields it may write.
CONTAINERS = {
    "Character": ("rPr", docx.FONTS + docx.CHARACTER),
    "Paragraph": ("pPr", docx.PARAGRAPH),
    "Table": ("tblPr", [f for f in docx.TABLE if f[0] != "style_id"]),
    "Cell": ("tcPr", [f for f in docx.CELL if f[0] not in ("grid_span", "vertical_merge")]),
}
# The order of properties in their containers, from the schema of the format.
ORDER = {
    "pPr": "pStyle keepNext keepLines pageBreakBefore framePr widowControl numPr suppressLineNumbers pBdr shd tabs suppressAutoHyphens kinsoku wordWrap overflowPunct topLinePunct autoSpaceDE autoSpaceDN bidi adjustRightInd snapToGrid spacing ind contextualSpacing mirrorIndents suppressOverlap jc textDirection textAlignment textboxTightWrap outlineLvl divId cnfStyle rPr sectPr pPrChange".split(),
    "rPr": "rStyle rFonts b bCs i iCs caps smallCaps strike dstrike outline shadow emboss imprint noProof snapToGrid vanish webHidden color spacing w kern position sz szCs highlight u effect bdr shd fitText vertAlign rtl cs em lang eastAsianLayout specVanish oMath rPrChange".split(),
    "tblPr": "tblStyle tblpPr tblOverlap bidiVisual tblStyleRowBandSize tblStyleColBandSize tblW jc tblCellSpacing tblInd tblBorders shd tblLayout tblCellMar tblLook tblCaption tblDescription tblPrChange".split(),
    "tcPr": "cnfStyle tcW gridSpan hMerge vMerge tcBorders shd noWrap tcMar textDirection tcFitText vAlign hideMark cellIns cellDel cellMerge tcPrChange".split(),
}


class Refused(ValueError):
    """The package is not the one that the plan or the mutations were made for."""


# --- the index of a document's markup ------------------------------------------------


@dataclass
class Element:
    """Byte offsets: where the tag starts and ends, and where the content and the element end."""

    name: str
    start: int
    content: int
    stop: int = 0
    end: int = 0
    children: list[Element] = field(default_factory=list)

    @property
    def local(self) -> str:
        return self.name.rpartition(":")[2]

    @property
    def prefix(self) -> str:
        return self.name.rpartition(":")[0]

    @property
    def empty(self) -> bool:
        return self.content == self.end


def _tag_end(raw: bytes, at: int) -> int:
    """The place behind a tag; a ``>`` within quotes does not end it."""
    quote = None
    for at in range(at, len(raw)):
        c = raw[at : at + 1]
        if quote:
            quote = None if c == quote else quote
        elif c in (b'"', b"'"):
            quote = c
        elif c == b">":
            return at + 1
    raise Refused("the document's markup is cut off")


def index(raw: bytes) -> list[Element]:
    """The elements of a document in UTF-8, in document order."""
    found: list[Element] = []
    open_: list[Element] = []
    parser = expat.ParserCreate()

    def start(name: str, _) -> None:
        at = parser.CurrentByteIndex
        e = Element(name, at, _tag_end(raw, at))
        if open_:
            open_[-1].children.append(e)
        found.append(e)
        open_.append(e)

    def end(_) -> None:
        e = open_.pop()
        empty = raw[e.content - 2 : e.content] == b"/>"
        e.stop = e.content if empty else parser.CurrentByteIndex
        e.end = e.content if empty else _tag_end(raw, e.stop)

    parser.StartElementHandler, parser.EndElementHandler = start, end
    try:
        parser.Parse(raw, True)
    except expat.ExpatError as error:
        raise Refused(f"the document is no XML: {error}") from error
    return found


class _Document:
    """A document's bytes, its elements by node, and the splices to be made."""

    def __init__(self, content: bytes):
        self.content = content
        raw = zipfile.ZipFile(io.BytesIO(content)).read(PART)
        if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):  # offsets count bytes of UTF-8
            raw = re.sub(rb"(<\?xml[^>]*encoding=)([\"'])[^\"']*[\"']", rb"\1\2UTF-8\2", raw.decode("utf-16").encode(), count=1)
        self.raw = raw
        parser = docx.Parser(content)
        parser.snapshot()
        root = parser.body
        while parser.parent.get(root) is not None:
            root = parser.parent[root]
        elements = index(raw)
        first = next((k for k, e in enumerate(elements) if f"}}{e.local}" == root.tag[root.tag.find("}") :]), 0)
        places = {id(e): first + k for k, e in enumerate(root.iter())}
        self.tree = {name: e for e, name in parser.node.items()}
        self.markup = {name: elements[places[id(e)]] for name, e in self.tree.items() if id(e) in places}
        self.edits: dict[tuple[str, str], list[tuple[str, str, tuple[bool, str | None]]]] = {}
        self.state: dict[tuple[str, str, str, str], tuple[bool, str | None]] = {}

    def read(self, node: str, container: str, name: str, attribute: str) -> tuple[bool, str | None]:
        """Whether a property is there, and its attribute, after the edits so far."""
        key = (node, container, name, attribute)
        if key in self.state:
            return self.state[key]
        props = self.tree[node].find(W + container)
        found = props.find(W + name) if props is not None else None
        # Another attribute of the same property may have been written before.
        if found is None and any(k[:3] == key[:3] and v[0] for k, v in self.state.items()):
            return True, None
        return (False, None) if found is None else (True, found.get(W + attribute))

    def write(self, node: str, container: str, name: str, attribute: str, state: tuple[bool, str | None]) -> None:
        self.edits.setdefault((node, container), []).append((name, attribute, state))
        self.state[node, container, name, attribute] = state

    def bytes(self) -> bytes:
        """The package with the containers of all edits put back."""
        splices = []
        for (node, container), edits in self.edits.items():
            owner = self.markup[node]
            if not owner.prefix:
                raise Refused("the document binds no prefix to its namespace")
            props = next((c for c in owner.children if c.local == container and c.prefix == owner.prefix), None)
            made = _container(self.raw, props, owner.prefix, container, edits)
            if props is not None:
                splices.append((props.start, props.end, made))
            elif made and owner.empty:
                tag = self.raw[owner.start : owner.content]
                splices.append((owner.start, owner.end, tag[:-2].rstrip() + b">" + made + f"</{owner.name}>".encode()))
            elif made:
                splices.append((owner.content, owner.content, made))
        out, at = [], 0
        for start, end, made in sorted(splices):
            out += [self.raw[at:start], made]
            at = end
        return _repack(self.content, b"".join([*out, self.raw[at:]]))


def _container(raw: bytes, props: Element | None, prefix: str, container: str, edits: list) -> bytes:
    """A property container after edits; one that was not there and has no property is nothing."""
    pieces: list[tuple[str | None, bytes]] = []  # the name of a property of our own, its bytes; None for what lies between
    at = props.content if props is not None else 0
    for child in props.children if props is not None else []:
        pieces += [(None, raw[at : child.start]), (child.local if child.prefix == prefix else None, raw[child.start : child.end])]
        at = child.end
    if props is not None and not props.empty:
        pieces.append((None, raw[at : props.stop]))
    rank = {name: k for k, name in enumerate(ORDER[container])}
    for name, attribute, (there, value) in edits:
        place = next((k for k, p in enumerate(pieces) if p[0] == name), None)
        if place is None:
            if not there:
                continue
            later = (k for k, p in enumerate(pieces) if p[0] in rank and rank[p[0]] > rank.get(name, len(rank)))
            place = next(later, len(pieces))
            pieces.insert(place, (name, f"<{prefix}:{name}/>".encode()))
        pieces[place] = (name, _with_attribute(pieces[place][1], f"{prefix}:{attribute}", value if there else None))
        if not there and re.fullmatch(rb"<[^\s/>]+\s*(/>|>\s*</[^>]*>)", pieces[place][1]):
            del pieces[place]
    inner = b"".join(p for _, p in pieces)
    if props is None:
        return f"<{prefix}:{container}>".encode() + inner + f"</{prefix}:{container}>".encode() if inner else b""
    tag = raw[props.start : props.content]
    if not inner:
        return raw[props.start : props.end] if props.empty else tag + raw[props.stop : props.end]
    return (tag[:-2].rstrip() + b">" if props.empty else tag) + inner + f"</{props.name}>".encode()


def _with_attribute(element: bytes, name: str, value: str | None) -> bytes:
    """An element with one attribute set, or without it."""
    end = _tag_end(element, 0)
    tag, rest = element[:end], element[end:]
    old = re.search(rb"(\s+" + re.escape(name.encode()) + rb"\s*=\s*)(\"[^\"]*\"|'[^']*')", tag)
    if old:
        mark = old.group(2)[:1].decode()  # the quotes stay as they were
        kept = b"" if value is None else old.group(1) + f"{mark}{escape(value, {mark: '&quot;' if mark == chr(34) else '&apos;'})}{mark}".encode()
        return tag[: old.start()] + kept + tag[old.end() :] + rest
    written = b"" if value is None else f" {name}={quoteattr(value)}".encode()
    close = b"/>" if tag.endswith(b"/>") else b">"
    return tag[: -len(close)].rstrip() + written + close + rest


def _repack(content: bytes, document: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for info in old.infolist():
            new.writestr(info, document if info.filename == PART else old.read(info.filename))
    return out.getvalue()


# --- restoring and undoing -----------------------------------------------------------


def render(content: bytes, items: list[dict]) -> tuple[bytes, list[dict]]:
    """(package, mutations). Items: node, category, target (field -> value; a font field by its own name).

    A value that the node already shows is not written. An unknown node is an error. Without
    mutations the package is returned as it is.
    """
    doc = _Document(content)
    done = []
    for item in sorted(items, key=lambda i: (i["node"], i["category"])):
        if item["node"] not in doc.markup:
            raise Refused(f"unknown node {item['node']}")
        container, fields = CONTAINERS[item["category"]]
        for field_, name, attribute, kind in fields:
            if field_ not in item["target"]:
                continue
            value = item["target"][field_]
            before = doc.read(item["node"], container, name, attribute)
            after = (False, None) if value is None else (True, (None if value else "0") if kind == "flag" else str(value))
            shown = before[0] and (before[1] is None or before[1].lower() not in OFF) if kind == "flag" else before[1]
            if shown == value or before == after or (value is None and before[1] is None and kind != "flag"):
                continue
            doc.write(item["node"], container, name, attribute, after)
            done.append({"node": item["node"], "container": container, "name": name, "attribute": attribute, "before": before, "after": after})
    return (doc.bytes() if done else content), done


def revert(content: bytes, sha256: str, mutations: list[dict]) -> bytes:
    """The package without the mutations. It must have the given hash, and every property its state after them."""
    if hashlib.sha256(content).hexdigest() != sha256:
        raise Refused("the package has changed since it was restored")
    doc = _Document(content)
    for m in reversed(mutations):
        at = (m["node"], m["container"], m["name"], m["attribute"])
        if m["node"] not in doc.markup or doc.read(*at) != tuple(m["after"]):
            raise Refused(f"{m['node']} is not in its restored state")
        doc.write(*at, tuple(m["before"]))
    return doc.bytes() if mutations else content


def _declared(raw: bytes) -> tuple[bytes, set[bytes]]:
    """A document's root tag, and the prefixes that it asks readers to ignore without declaring them."""
    root = index(raw)[0]
    tag = raw[root.start : root.content]
    ignored = re.search(rb":Ignorable\s*=\s*[\"']([^\"']*)", tag)
    return tag, set(ignored.group(1).split() if ignored else ()) - set(re.findall(rb"xmlns:([^\s=]+)\s*=", tag))


def _disordered(raw: bytes) -> set[str]:
    """Containers with properties against the schema's order, by kind and by the names in their order."""
    found = set()
    for e in index(raw):
        if e.local in ORDER:
            names = [c.local for c in e.children if c.local in ORDER[e.local] and c.prefix == e.prefix]
            if names != sorted(names, key=ORDER[e.local].index):
                found.add(f"{e.local}:{','.join(names)}")
    return found


def violations(before: bytes, after: bytes) -> list[str]:
    """What a restore must not change: other parts, texts, structure, revisions, comments; nor may it break the markup.

    ``Namespaces``: the root tag differs, or a prefix to be ignored is not declared any more.
    ``Order``: a property stands against the schema's order, in a container where none did.
    """
    old, new = zipfile.ZipFile(io.BytesIO(before)), zipfile.ZipFile(io.BytesIO(after))
    found = [] if old.namelist() == new.namelist() else ["Parts"]
    found += [n for n in old.namelist() if n != PART and n in new.namelist() and old.read(n) != new.read(n)]
    x, y = docx.parse("", before), docx.parse("", after)
    plain = lambda s: ([(p["node"], p["raw"], [r["raw"] for r in p["runs"]]) for p in s["paragraphs"]], [(t["node"], [(c["node"], c["text"], c["format"]["grid_span"], c["format"]["vertical_merge"]) for c in t["cells"]]) for t in s["tables"]])
    found += ["Text"] if plain(x) != plain(y) else []
    if PART in old.namelist() and PART in new.namelist():
        was, now = old.read(PART), new.read(PART)
        (tag, missing), (new_tag, new_missing) = _declared(was), _declared(now)
        found += ["Namespaces"] if new_missing - missing or (tag != new_tag and not was.startswith((b"\xff\xfe", b"\xfe\xff"))) else []
        found += ["Order"] if _disordered(now) - _disordered(was) else []
    return found + [k.title() for k in ("revisions", "comments", "hyperlinks", "sections") if x[k] != y[k]]


_STATE = pa.struct([("there", pa.bool_()), ("value", pa.string())])
_MUTATION = pa.struct([("node", pa.string()), ("container", pa.string()), ("name", pa.string()), ("attribute", pa.string()), ("before", _STATE), ("after", _STATE)])
MUTATIONS = "array<struct<node:string,container:string,name:string,attribute:string,before:struct<there:boolean,value:string>,after:struct<there:boolean,value:string>>>"


def render_all(packages: DataFrame, items: DataFrame) -> DataFrame:
    """path, content, sha256, mutations, violations of every package (path, content) with items (path, node, category, target map).

    The mutations have the states before and after, so ``revert_all`` can take them back. A
    package or item that is refused has no content, and why in ``refused``.
    """
    schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("sha256", pa.string()), ("mutations", pa.list_(_MUTATION)), ("violations", pa.list_(pa.string())), ("refused", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = lambda x: {"there": x[0], "value": x[1]}
        for batch in batches:
            for path, content, wanted in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                targets = [{"node": i["node"], "category": i["category"], "target": _typed(i["category"], dict(i["target"]))} for i in wanted]
                try:
                    made, done = render(content, targets)
                    row = {"content": made, "sha256": hashlib.sha256(made).hexdigest(), "mutations": [m | {"before": state(m["before"]), "after": state(m["after"])} for m in done], "violations": violations(content, made)}
                except Refused as why:
                    row = {"refused": str(why)}
                yield pa.RecordBatch.from_pylist([{"path": path} | row], schema=schema)

    listed = items.groupBy("path").agg(F.collect_list(F.struct("node", "category", "target")).alias("items"))
    joined = packages.select("path", "content").join(listed, "path").select("path", "content", "items")
    return joined.mapInArrow(run, f"path string, content binary, sha256 string, mutations {MUTATIONS}, violations array<string>, refused string")


def revert_all(packages: DataFrame, journal: DataFrame) -> DataFrame:
    """path, content, refused of every package (path, content) that the journal (path, sha256, mutations) names, without its mutations."""
    schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("refused", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = lambda x: (x["there"], x["value"])
        for batch in batches:
            for path, content, sha256, mutations in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                try:
                    row = {"content": revert(content, sha256, [m | {"before": state(m["before"]), "after": state(m["after"])} for m in mutations])}
                except Refused as why:
                    row = {"refused": str(why)}
                yield pa.RecordBatch.from_pylist([{"path": path} | row], schema=schema)

    joined = packages.select("path", "content").join(journal.select("path", "sha256", "mutations"), "path").select("path", "content", "sha256", "mutations")
    return joined.mapInArrow(run, "path string, content binary, refused string")


def _typed(category: str, target: dict) -> dict:
    """Values of a string map as the category's fields have them."""
    kinds = {f: k for f, _, _, k in CONTAINERS[category][1]}
    return {f: (v if v is None or kinds.get(f) != "flag" else v == "true") for f, v in target.items() if f in kinds}

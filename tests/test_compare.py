from __future__ import annotations

import random

import pytest
from docweave.functions import diff
from docweave.operators import annotate, changes, ignore, matching, recommend, review
from docweave.plans import versions
from pyspark.sql import functions as F


def sides(spark, pairs):
    """pairs: name -> (baseline texts, current texts)."""
    rows = lambda k: [(n, i, f"body/p[{i}]", t, t) for n, v in pairs.items() for i, t in enumerate(v[k])]
    schema = "pair string, idx int, node string, text string, norm string"
    return spark.createDataFrame(rows(0), schema), spark.createDataFrame(rows(1), schema)


CASES = {
    "same": (["一", "二", "三"], ["一", "二", "三"]),
    "number": (["付款期限为30日"], ["付款期限为60日"]),
    "front": (["标题", "第一段正文", "第二段正文"], ["新增说明", "标题", "第一段正文", "第二段正文"]),
    "move": (["一一一", "二二二", "三三三"], ["二二二", "三三三", "一一一"]),
    "moves": (list("ABCDE"), list("CDEAB")),
    "repeat": (["重复", "重复", "甲"], ["甲", "乙", "重复", "重复", "丙"]),
    "group": ([f"第{i}条 甲方应当在第{i}日履行全部约定义务" for i in range(3)], [f"第{i}条 乙方应当在第{i}日履行全部约定义务" for i in range(3)]),
}


@pytest.fixture(scope="module")
def found(spark):
    result = versions.compare(*sides(spark, CASES))
    return {
        "kinds": {(r.pair, r.change_id): r.kind for r in result.changes.collect()},
        "spans": {r.pair: r.spans for r in result.changes.where("size(spans) > 0").collect()},
        "maps": [(r.pair, r.b_idx, r.c_idx, r.type, r.moved) for r in result.mappings.collect()],
        "groups": {r.pair: len(r.members) for r in result.groups.collect()},
        "notes": {(r.pair, r.code) for r in result.matched.diagnostics.collect()},
        "stats": {r.pair: r for r in result.statistics.collect()},
    }


def kinds(found, pair):
    return sorted(v for (p, _), v in found["kinds"].items() if p == pair)


def test_golden_cases(found):
    assert kinds(found, "same") == []
    assert kinds(found, "number") == ["TextReplace"]
    assert [(s.old, s.new) for s in found["spans"]["number"]] == [("30", "60")]
    assert kinds(found, "front") == ["ParagraphInsert"]
    assert kinds(found, "move") == ["ParagraphMove"]
    assert kinds(found, "moves") == ["ParagraphMove"] * 2
    assert ("repeat", "DuplicateCandidate") in found["notes"] and sorted(t for p, b, c, t, m in found["maps"] if p == "repeat" and not m) == ["Contextual", "Contextual"]
    assert found["groups"] == {"group": 3} and found["stats"]["group"].group_count == 1
    assert found["stats"]["number"].text_changes == 1 and found["stats"]["front"].paragraphs_added == 1
    assert all(t == "HeadingOrNumbering" for p, _, _, t, _ in found["maps"] if p == "group")


@pytest.mark.parametrize(("old", "new", "spans"), [("甲方", "乙方", [("Replace", 0, "甲", "乙")]), ("及时", "立即", [("Replace", 0, "及时", "立即")]), ("today", "tomorrow", [("Replace", 0, "today", "tomorrow")]), ("合同生效", "合同立即生效", [("Insert", 2, "", "立即")]), ("合同立即生效", "合同生效", [("Delete", 2, "立即", "")]), ("甲方应在30日付款。", "乙方应在60日付款！", [("Replace", 0, "甲", "乙"), ("Replace", 4, "30", "60"), ("Replace", 9, "。", "！")])])
def test_span_goldens(old, new, spans):
    assert [(s["op"], s["b_start"], s["old"], s["new"]) for s in diff.text_diff(old, new)] == spans


def plain_diff(a, b):
    """The walk over a full table, as the definition reads."""
    x, y = diff.tokens(a), diff.tokens(b)
    t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if x[i] == y[j] else max(t[i + 1][j], t[i][j + 1])
    i = j = 0
    out = []
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            out.append(("=", x[i]))
            i, j = i + 1, j + 1
        elif j < len(y) and (i == len(x) or t[i][j + 1] >= t[i + 1][j]):
            out.append(("+", y[j]))
            j += 1
        else:
            out.append(("-", x[i]))
            i += 1
    return out


def test_diff_against_the_full_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = (" ".join(rng.choice(["a", "b", "甲", "12", "😀", "é"]) for _ in range(rng.randrange(9))) for _ in range(2))
        spans = diff.text_diff(a, b)
        assert diff.apply_spans(a, spans) == b
        steps = plain_diff(a, b)
        merged, gone, come = [], "", ""
        for k, v in [*steps, ("=", "")]:
            if k == "=":
                if gone or come:
                    merged.append((gone, come))
                gone = come = ""
            elif k == "-":
                gone += v
            else:
                come += v
        assert [(s["old"], s["new"]) for s in spans] == merged


def test_stable_positions():
    assert diff.stable_positions([2, 3, 4, 0, 1]) == [True, True, True, False, False]
    assert diff.stable_positions([]) == []
    rng = random.Random(2)
    for _ in range(100):
        v = rng.sample(range(20), rng.randrange(12))
        kept = [x for x, s in zip(v, diff.stable_positions(v), strict=True) if s]
        best = [0] * len(v)
        for i in range(len(v)):
            best[i] = 1 + max((best[j] for j in range(i) if v[j] < v[i]), default=0)
        assert kept == sorted(kept) and len(kept) == max(best, default=0)


def test_normal_text_and_tokens(spark):
    from docweave.functions import text as tx

    rows = [("  a\t\tb \r\n\r\n c  ",), ("Ａ①　x",), ("第十条 付款",), ("1.2. Title",), ("三、内容",), ("Hello, Wörld 第12",), ("",)]
    got = spark.createDataFrame(rows, "t string").select(tx.normalize(F.col("t")).alias("n")).select("n", tx.match_tokens(F.col("n")).alias("k"), tx.heading_key(F.col("n")).alias("h")).collect()
    assert [r.n for r in got] == ["a b\nc", "A1 x", "第十条 付款", "1.2. Title", "三、内容", "Hello, Wörld 第12", ""]
    assert [r.h for r in got] == [None, None, "第十条", "1.2", "三", None, None]
    assert got[5].k == ["hello", ",", "wörld", "第", "12"]


def item(change_id, node, spans=(), fmt=None, kind="TextReplace", b="", c=""):
    return ("x", change_id, kind, node, node, b, c, list(spans), fmt, [], [], ["SnapshotDifference"], None, [])


ITEM = "pair string, change_id string, kind string, b_node string, c_node string, b_text string, c_text string, spans " + diff.SPANS + ", format " + changes.FORMAT + ", revision_ids array<string>, comment_ids array<string>, evidence array<string>, confidence string, codes array<string>"


def test_ignore_rules(spark):
    span = lambda old, new, b=0, c=0: ("Replace", b, len(old), c, len(new), old, new)
    rows = [
        item("punct", "n", [span("，", ",")], b="a，", c="a,"), item("page", "n", [span("3", "4")], b="第 3 页", c="第 4 页"), item("amount", "n", [span("30", "60")], b="付30日", c="付60日"),
        item("number", "n", [span("1", "2"), span("甲", "乙", 3, 3)], b="1. 甲", c="2. 乙"), item("format", "n", fmt=("TableCell", [("Width", "1", "2"), ("GridSpan", "1", "2")])),
        item("only", "n", fmt=("Character", [("Bold", "True", "False")])), item("custom", "n", [span("※", "")], b="※", c=""),
    ]
    df = spark.createDataFrame(rows, ITEM)
    shown = lambda **r: {x.change_id: (len(x.spans), len(x.format.properties) if x.format else 0) for x in ignore.project(df, ignore.Rules(**r)).collect()}
    assert len(shown()) == 7
    assert "punct" not in shown(punctuation=True) and "amount" in shown(punctuation=True)
    assert "page" not in shown(page_numbers=True) and "amount" in shown(page_numbers=True)
    assert shown(numbering=True)["number"] == (1, 0)
    got = shown(all_formatting=True)
    assert got["format"] == (0, 1) and "only" not in got
    assert "only" not in shown(properties=("Character.Bold",)) and "custom" not in shown(characters="※")


def test_annotations_attach_in_order(spark):
    df = spark.createDataFrame([item("text:a:a", "a"), item("format:P:a:a", "a"), item("text:b:b", "b")], ITEM)
    revisions = spark.createDataFrame([("x", "r1", "Insert", "t", "a", None, None, True), ("x", "r2", "Delete", "u", "z", None, None, True), ("x", "r3", "Insert", "v", "z", None, None, False)], "pair string, revision_id string, kind string, text string, affected string, paragraph string, run string, is_supported boolean")
    comments = spark.createDataFrame([("x", "c1", "why", "z", None, None, None, True), ("x", "c2", "loose", None, " ", None, None, False)], "pair string, comment_id string, text string, paragraph string, run string, anchor_start string, anchor_end string, is_anchored boolean")
    got = {r.change_id: (r.kind, r.revision_ids, r.comment_ids, r.codes) for r in annotate.integrate(df, revisions, comments).collect()}
    assert got["format:P:a:a"][1] == ["r1"] and got["text:a:a"][1] == []
    assert got["revision:r2"] == ("NativeRevision", ["r2", "r3"], ["c1"], ["RevisionMappingFailed"])
    assert got["comment:c2"] == ("Comment", [], ["c2"], ["UnanchoredComment"]) and len(got) == 5
    codes = annotate.links(df, revisions, comments).where("kind = 'diagnostic'").collect()
    assert [(r.annotation_id, r.code) for r in codes] == [("r3", "UnsupportedComparisonElement")]


def test_formats_and_tables(spark):
    runs = "array<struct<text:string,format:struct<bold:boolean,color:string>>>"
    df = spark.createDataFrame([([("ab", (True, None)), ("", (False, "x")), ("c", (True, "red"))],), ([],)], f"runs {runs}")
    got = df.select(changes.pattern(F.col("runs"), lambda r: changes.shown(r["format"]["bold"], True)).alias("b"), changes.pattern(F.col("runs"), lambda r: r["format"]["color"]).alias("c")).collect()
    assert [tuple(r) for r in got] == [("True", "2:<null>|1:red"), ("<null>", "<null>")]
    edge = "struct<style:string,color:string,size:string>"
    borders = "struct<" + ",".join(f"{e}:{edge}" for e in changes.EDGES.values()) + ">"
    cell = f"struct<width:string,width_type:string,vertical_alignment:string,shading_fill:string,grid_span:int,vertical_merge:string,borders:{borders}>"
    schema = f"pair string, table int, node string, format struct<style_id:string,width:string,width_type:string,alignment:string,shading_fill:string,borders:{borders}>, cells array<struct<row:int,col:int,node:string,text:string,format:{cell}>>"
    none, no_borders = (None,) * 5, (None,) * 6
    c = lambda r, k, t, w=None: (r, k, f"c{r}{k}", t, (w, None, None, None, None, None, no_borders))
    base = spark.createDataFrame([("x", 0, "t0", (*none, no_borders), [c(0, 0, "a"), c(0, 1, "b")]), ("x", 1, "t1", (*none, no_borders), [])], schema)
    cur = spark.createDataFrame([("x", 0, "t0", (None, "9", None, None, None, (("single", "auto", "4"), *(None,) * 5)), [c(0, 0, "z", "5"), c(0, 2, "b")])], schema)
    found, notes, maps = changes.table_changes(base, cur)
    rows = {r.change_id: r for r in found.collect()}
    assert set(rows) == {"table-format:t0:t0", "cell:c00:c00", "table-structure:t1:none"}
    assert [x.property for x in rows["table-format:t0:t0"].format.properties] == ["Width", "Borders"]
    assert rows["table-format:t0:t0"].format.properties[1].current.startswith("top=single,auto,4;left=<null>")
    assert [x.property for x in rows["cell:c00:c00"].format.properties] == ["Width"] and rows["cell:c00:c00"].spans[0].new == "z"
    assert [r.code for r in notes.collect()] == ["TableStructureFallback"] and maps.count() == 2


def test_review_events(spark):
    events = spark.createDataFrame([("x", "a", "Confirmed", 1), ("x", "b", "Ignored", 1), ("y", "a", "Unresolved", 1)], "pair string, change_id string, state string, seq long")
    edit = spark.createDataFrame([("x", "a", "Confirmed", "Ignored"), ("x", "b", "Ignored", "Confirmed"), ("y", "a", "Confirmed", "Ignored")], "pair string, change_id string, expected string, state string")
    after, conflicts = review.apply_edit(events, edit, 2)
    assert [r.pair for r in conflicts.collect()] == ["y"]
    now = {(r.pair, r.change_id): r.state for r in review.latest_states(after).collect()}
    assert now == {("x", "a"): "Ignored", ("x", "b"): "Confirmed", ("y", "a"): "Unresolved"}
    back = {(r.pair, r.change_id): r.state for r in review.latest_states(review.undo(after, 2, 3)).collect()}
    assert back == {("x", "a"): "Confirmed", ("x", "b"): "Ignored", ("y", "a"): "Unresolved"}


def test_segments(spark):
    df = spark.createDataFrame([("abcdef", [("Replace", 1, 2, 0, 0, "bc", ""), ("Replace", 2, 2, 0, 0, "cd", ""), ("Delete", 5, 1, 0, 0, "f", ""), ("Insert", 3, 0, 0, 1, "", "x"), ("Delete", 5, 9, 0, 0, "f", "")])], f"t string, s {diff.SPANS}")
    got = df.select(review.segments(F.col("t"), F.col("s")).alias("g")).head().g
    assert [(x.text, x.marked) for x in got] == [("a", False), ("bc", True), ("de", False), ("f", True)]


def test_recommendation_decides(spark):
    clause = lambda i, term: f"第{i}条 服务内容，双方约定履行期限为{term}日，逾期承担违约责任。"
    doc = lambda k, term: (k, f"contract{k}.docx", None, [clause(i, term) for i in range(12)], ["3:2,2"])
    docs = spark.createDataFrame([doc(1, 30)], "id long, file_name string, title string, paragraphs array<string>, tables array<string>")
    other = (9, "menu.docx", None, ["完全不同的菜单内容", "苹果香蕉橘子"], [])
    make = lambda rows: spark.createDataFrame(rows, docs.schema).withColumn("is_current", F.lit(True))
    kind = lambda rows: recommend.recommend(recommend.scored(docs, make(rows))).head()
    assert kind([doc(1, 30), other]).kind == "Unique"
    assert kind([other]).kind == "None"


def test_candidates_are_bounded(spark):
    base, cur = sides(spark, {"x": ([f"the same word {i} base" for i in range(120)], [f"the same word {i} cur" for i in range(120)])})
    got = matching.candidates(matching.features(base), matching.features(cur)).groupBy("b_idx").count().agg(F.max("count")).head()[0]
    assert got <= matching.MOST


def test_grams_are_linear_and_plain(spark):
    from docweave.functions import text as tx

    texts = ["", "a", "ab", "abcab", "两个\n字𝄞x𝄞", "xy" * 30_000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.bigrams(F.col("t")).alias("b"), tx.shingles(F.col("t"), 3, 4).alias("s")).collect()
    plain = lambda t, w: list(dict.fromkeys(t[i : i + w] for i in range(len(t) - w + 1)))
    for r in rows:
        assert r.b == plain(texts[r.i], 2) and r.s == plain(texts[r.i], 3)[:4]


def test_size_bound_loses_no_candidate(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select(F.col("doc_id").alias("id"), F.lit("x.docx").alias("file_name"), F.lit(None).cast("string").alias("title"), F.split("text", "\n").alias("paragraphs"), F.array(F.lit("3:2,2")).alias("tables"))
    templates = docs.where("id % 20 = 0").withColumn("is_current", F.lit(True))
    for grid in (None, 0):
        bound = recommend.BROADCAST_BYTES
        recommend.BROADCAST_BYTES = bound if grid is None else 0
        whole = {tuple(r) for r in recommend.scored(docs, templates).where("score >= 0.6").collect()}
        assert {tuple(r) for r in recommend.scored(docs, templates, least=0.6).where("score >= 0.6").collect()} == whole and len(whole) >= 10
        recommend.BROADCAST_BYTES = bound


def test_search_equals_all_pairs(spark, monkeypatch):
    """The search over packs and tiles finds the same pairs and scores as comparing all, for random features of all kinds."""
    rnd = random.Random(5)
    words = ["alpha", "beta", "第一条 交付", "2. 验收", "gamma delta", "x", "", "付款期限"]
    rows = []
    for k in range(160):
        base = rows[rnd.randrange(len(rows))][3] if rows and rnd.random() < 0.6 else None
        text = [rnd.choice(words) + str(rnd.randrange(30)) * rnd.randrange(4) for _ in range(rnd.choice([0, 1, 4, 30]))] if not base else [p for p in base if rnd.random() < 0.93] + [rnd.choice(words)]
        rows.append((k, rnd.choice(["a.docx", f"f{k % 5}.docx", ".docx"]), rnd.choice([None, " ", "Title", f"T{k % 3}"]), text, rnd.choice([[], ["3:2,2"], ["3:2,2", "1:1"]])))
    rows.append((900, "n.docx", None, None, None))
    docs = spark.createDataFrame(rows, "id long, file_name string, title string, paragraphs array<string>, tables array<string>")
    templates = docs.where("id % 3 = 0").withColumn("is_current", F.col("id") % 2 == 0)
    for least in (0.55, recommend.CANDIDATE, 0.9):
        take = lambda df: sorted((r.doc_id, r.template_id, r.is_current, round(r.score, 9)) for r in df.where(F.col("score") >= least).collect())  # noqa: B023, E731
        whole = take(recommend.scored(docs, templates))
        monkeypatch.setattr(recommend, "PACK_ROWS", 7)
        assert take(recommend.scored(docs, templates, least=least)) == whole and len(whole) >= 25
    with pytest.raises(ValueError, match="alike"):
        recommend.search(docs, templates, 0.5)


def test_signatures_of_parsed_tables(spark):
    kind = "array<struct<cells:array<struct<row:int,col:int>>>>"
    tables = [{"cells": [(0, 0), (0, 1), (1, 0)]}, {"cells": []}, {"cells": [(r, 0) for r in range(40)]}]
    got = spark.createDataFrame([(tables,)], f"t {kind}").select(recommend.signatures(F.col("t")).alias("s")).head().s
    assert got == ["2:2,1", "0:", "40:" + ",".join(["1"] * 30)]

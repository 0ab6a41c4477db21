from __future__ import annotations

import random

import pytest
from docweave.functions import diff
from docweave.functions import text as tx
from docweave.operators import changes, matching, restore
from docweave.plans import compare_queries, document_queries, history_queries, versions
from pyspark.sql import functions as F

ALPHABET = [*"aB1.é ñЖ中。、", "  ", "\t", "\r", "\r\n", "\n", "\x0b", "\x1c", "\x85", " ", " ", " ", " ", "　", "㐀", "豈", "①", "ﬁ", "é", "Σ", "İ", "😀", "٣", "_", "-", "ｱﾞ", "²"]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choice(ALPHABET) for _ in range(rng.randrange(14))),) for _ in range(1500)]
    return spark.createDataFrame([*rows, ("",), (None,)], "t string").repartition(2).cache()


def test_the_normal_form_in_one_step_is_that_in_steps(odd):
    import unicodedata

    plain = F.udf(lambda t: None if t is None else unicodedata.normalize("NFKC", t))
    steps = F.regexp_replace(F.regexp_replace(plain("t"), "\r\n?", "\n"), "[\\u00A0\\u3000]", " ")
    steps = F.regexp_replace(steps, "[\\t\\p{Zs}]*\\n[\\t\\p{Zs}\\n]*", "\n")
    steps = F.regexp_replace(F.regexp_replace(steps, "[\\t\\p{Zs}]+", " "), "(?U)^\\s+|\\s+$", "")
    assert odd.select("t", steps.alias("x"), tx.normalize(F.col("t")).alias("y")).where("not x <=> y").collect() == []


def test_only_texts_that_may_change_travel_to_python(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(tx, "_normal", lambda c: seen.append(c) or c)
    rows = spark.createDataFrame([("plain text, 中文。",), ("Ａ",), ("a  b",), (" a",), ("a\t",), ("é",)], "t string")
    rows.select(tx.normalize(F.col("t"))).collect()
    assert [r[0] for r in rows.select(seen[0]).collect()] == [None, "Ａ", "a  b", " a", "a\t", None]


def test_tokens_and_bigrams_as_defined(odd):
    pattern = f"[{tx.CJK}]|[\\p{{L}}\\p{{Nd}}&&[^{tx.CJK}]]+|(?U)[^\\s\\p{{L}}\\p{{Nd}}]"
    tokens = F.array_distinct(F.transform(F.regexp_extract_all("t", F.lit(pattern), F.lit(0)), F.lower))
    rows = odd.select("t", tokens.alias("x"), tx.match_tokens(F.col("t")).alias("y"), tx.bigrams(F.col("t")).alias("p"), tx.bigram_codes(F.col("t")).alias("q"))
    assert rows.where("not x <=> y").collect() == []
    assert rows.where("size(p) <> size(q) and t is not null").collect() == []


def test_a_given_normal_form_is_not_made_again(spark):
    lines = spark.createDataFrame([("p", 0, "body/p[0]", "a", "a")], "pair string, idx int, node string, text string, norm string")
    plan = matching.features(lines).select("norm", "prev", "next")._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_exact_stages_against_their_definition(spark):
    rng = random.Random(6)
    made = {f"p{k}": [[rng.choice("abcde") for _ in range(rng.randrange(9))] for _ in range(2)] for k in range(60)}
    side = lambda s: spark.createDataFrame([(p, i, t) for p, both in made.items() for i, t in enumerate(both[s])], "pair string, idx int, norm string")
    groups = matching.equal_texts(side(0), side(1)).cache()
    got = {(r.pair, r.b_idx, r.c_idx, r.type) for r in matching.exact(groups)[0].collect()}
    want = set()
    for p, (b, c) in made.items():
        left_b, left_c = dict(enumerate(b)), dict(enumerate(c))

        def take(i, j, kind):
            want.add((p, i, j, kind))
            del left_b[i], left_c[j]

        for i in range(min(len(b), len(c))):
            if b[i] == c[i]:
                take(i, i, "Structural")
        of = lambda left, t: [i for i, x in left.items() if x == t]
        for t in "abcde":
            x, y = of(left_b, t), of(left_c, t)
            for i, j in zip(x, y) if len(x) > 1 else zip(x, y) if len(x) == len(y) == 1 else ():
                take(i, j, "ExactText" if len(x) == 1 else "Contextual")
    assert got == want


def _written(monkeypatch, module):
    seen, step = {}, module.stored
    monkeypatch.setattr(module, "stored", lambda df, label: seen.setdefault(label, step(df, label)))
    return seen


def test_only_paired_documents_are_written(spark, sf_dir, monkeypatch):
    seen = _written(monkeypatch, versions)
    base, cur = versions.stored_sides(spark, sf_dir)
    docs = versions.documents(spark, sf_dir)
    pairs = seen["pairs"]
    wanted = pairs.select(F.col("base_doc").alias("doc_id")).union(pairs.select("cur_doc")).join(versions.paragraphs(docs), "doc_id").count()
    assert sum(df.count() for label, df in seen.items() if label != "pairs") == wanted == base.count() + cur.count()


def test_texts_are_read_only_where_equal_ones_leave_them(spark, sf_dir, monkeypatch):
    seen = _written(monkeypatch, matching)
    compare_queries.match_diagnostics(spark, sf_dir)
    assert {"equal", "left-b", "left-c"} <= set(seen)
    assert "tokens" in seen["left-b"].columns and "bigrams" not in seen["left-b"].columns


def test_queries_on_matching_alone_do_not_compare_texts(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(versions, "compare", lambda *_: pytest.fail("compared whole"))
    for query in (compare_queries.unmatched_paragraphs, compare_queries.moved_paragraphs, compare_queries.review_filter, compare_queries.scroll_links):
        query(spark, sf_dir)


def test_only_documents_of_pairs_become_packages(spark, sf_dir, monkeypatch):
    seen, step = [], history_queries.docx_build.packages
    monkeypatch.setattr(history_queries.docx_build, "packages", lambda docs, *a: seen.append(docs) or step(docs, *a))
    history_queries._snapshots(spark, sf_dir)
    pairs = versions.version_pairs(versions.paragraphs(versions.documents(spark, sf_dir)))
    assert {r[0] for r in seen[0].select("doc_id").collect()} == {x for r in pairs.collect() for x in (r.base_doc, r.cur_doc)}


def test_saved_comparisons_find_pairs_once(spark, sf_dir, monkeypatch):
    seen, step = [], versions.version_pairs
    monkeypatch.setattr(versions, "version_pairs", lambda lines: seen.append(lines) or step(lines))
    history_queries.saved_comparisons(spark, sf_dir)
    assert len(seen) == 1


def test_equal_cells_are_not_compared(spark, sf_dir, monkeypatch):
    seen, step = [], changes.diff_spans
    monkeypatch.setattr(changes, "diff_spans", lambda a, b: seen.append((a, b)) or step(a, b))
    kept = _written(monkeypatch, changes)
    found = document_queries.table_cell_changes(spark, sf_dir)
    assert list(kept) == ["tables"] and found.count() > 0
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    python = next(i for i, line in enumerate(plan) if "ArrowEvalPython" in line)
    assert any("Filter" in line and "NOT (_extract_text" in line for line in plan[python + 1 : python + 4])


def test_a_restore_plan_aligns_once(spark, sf_dir, monkeypatch):
    kept = _written(monkeypatch, restore)
    document_queries.restore_plan(spark, sf_dir)
    assert list(kept) == ["aligned"]


def test_equal_rows_of_a_batch_are_compared_once(monkeypatch):
    import pyarrow as pa

    seen, step = [], diff.text_diff
    monkeypatch.setattr(diff, "text_diff", lambda o, n: seen.append((o, n)) or step(o, n))
    got = diff.diff_spans.func(pa.array(["1", "1", None, "1"]), pa.array(["2", "2", "x", "3"])).to_pylist()
    assert sorted(seen) == [("1", "2"), ("1", "3")] and got[0] == got[1] == step("1", "2") and got[2] is None and got[3] == step("1", "3")

from __future__ import annotations

import random

import duckdb
from docweave.llm.line_dedup import dedup_lines
from docweave.llm.registry import oracle_sql, queries


def brute(rows, min_chars):
    """doc_id -> text left: every line of every run, of any length, that holds min_chars and starts earlier as well."""
    lines = {d: t.split("\n") for d, t in rows}
    first = {}
    for d in sorted(lines):
        for i in range(len(lines[d])):
            for j in range(i + 1, len(lines[d]) + 1):
                first.setdefault(tuple(lines[d][i:j]), (d, i))
    out = {}
    for d, own in lines.items():
        gone = set()
        for i in range(len(own)):
            for j in range(i + 1, len(own) + 1):
                if sum(map(len, own[i:j])) >= min_chars and first[tuple(own[i:j])] < (d, i):
                    gone.update(range(i, j))
        out[d] = ("\n".join(x for i, x in enumerate(own) if i not in gone), len(own), len(gone), sum(i - 1 not in gone for i in gone))
    return out


def result(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return {r.doc_id: (r.text, r.n_lines, r.n_deleted, r.n_runs) for r in dedup_lines(df, **more).collect()}


def test_against_brute_force_over_all_lengths(spark):
    rng = random.Random(8)
    pool = ["", "", "a", "bc", "short", "a line of some length", "é" * 30, "x" * 60, "y" * 130]
    passages = [[rng.choice(pool) + rng.choice(["", str(k)]) for _ in range(rng.randrange(1, 14))] for k in range(8)]
    rows = []
    for i in range(70):
        lines = [rng.choice(pool) + rng.choice(["", "", str(i)]) for _ in range(rng.randrange(0, 12))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = rng.choice(passages)
        rows.append((i, "\n".join(lines)))
    rows += [(900, rows[5][1]), (903, ""), (904, "\n\n\n"), (906, "z\n" * 150)]
    for min_chars in (1, 40, 100):
        assert result(spark, rows, min_chars=min_chars) == brute(rows, min_chars)


def test_runs_that_no_power_of_two_fits(spark):
    three, seven, few = ["a" * 39 + str(i) for i in range(3)], ["b" * 19 + str(i) for i in range(7)], ["w" * 200, *("c" * 29 + str(i) for i in range(3))]
    words = [f"{i:03d}" for i in range(60)]
    rows = []
    for k, run in enumerate((three, seven, few, words)):
        rows += [(10 * k, "\n".join(["own", *run, f"end {k}"])), (10 * k + 1, "\n".join([f"{k} starts", *run, "tail"])), (10 * k + 2, "\n".join(run))]
    got = result(spark, rows)
    for k in range(4):
        assert got[10 * k][2] == 0
        assert got[10 * k + 1][0] == f"{k} starts\ntail"
        assert got[10 * k + 2][0] == ""
    assert got[31][2] == got[32][2] == 60


def test_long_blank_documents(spark):
    rows = [(1, "\n" * 30000 + "x" * 120 + "\n" * 30000), (2, "\n" * 100 + "x" * 120 + "\n" * 40000)]
    got = result(spark, rows)
    assert got[1][2] == 0 and got[2][2] == 100 + 1 + 30000


def test_no_python_worker(spark, sf_dir):
    plan = queries()["op5_line_dedup"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan


def test_edges(spark):
    long = "w" * 150
    df = spark.createDataFrame([(1, long, 1), (1, long, 2), (None, long, 3), (2, long + "\nb", 4)], "doc_id long, text string, ta int")
    got = sorted((r.doc_id or 0, r.text, r.ta) for r in dedup_lines(df).collect())
    assert got == [(0, long, 3), (1, "", 1), (1, "", 2), (2, "b", 4)]
    assert dedup_lines(df).columns == ["doc_id", "text", "ta", "n_lines", "n_deleted", "n_runs"]
    assert dedup_lines(df.limit(0)).count() == 0
    rows = [(1, None, "x", 7), (2, "", "y", 8), (3, "\n\n", "z", 9)]
    clash = spark.createDataFrame(rows, "doc_id long, text string, gone string, n_runs int")
    assert sorted((r.doc_id, r.text, r.gone, r.n_lines, r.n_deleted, r.n_runs) for r in dedup_lines(clash).collect()) == [(1, None, "x", 0, 0, 0), (2, "", "y", 1, 0, 0), (3, "\n\n", "z", 3, 0, 0)]


def test_sql_from_the_definition(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    out = queries()["op5_line_dedup"](spark, sf_dir)
    want = con.sql(oracle_sql()["op5_line_dedup"])
    assert sorted(map(tuple, out.select(*want.columns).collect())) == sorted(want.fetchall())
    assert out.where("n_deleted > 0").count() > 0

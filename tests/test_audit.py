from __future__ import annotations

import pytest
from docweave.operators import audit
from docweave.operators.audit import Alone, Prefix, Refers, Row
from docweave.plans import audit_queries
from pyspark.errors import AnalysisException

PARENTS, CHILDREN = "id long, owner string, label string", "id long, parent long, owner string, n int, label string"


def found(broken):
    return sorted(tuple(r) for r in broken.collect())


def test_rules(spark):
    tables = {
        "parents": spark.createDataFrame([(1, "a", "x"), (2, "b", None)], PARENTS),
        "children": spark.createDataFrame([(10, 1, "a", 1, "x"), (11, 1, "b", None, "x"), (12, 9, "a", 0, "y"), (13, None, "a", 2, "y"), (14, 2, "b", 3, "z")], CHILDREN),
        "list": spark.createDataFrame([("1",), ("3",)], "id string"),
        "empty": spark.createDataFrame([], "id long"),
    }
    rules = {
        "children": (
            Row("Positive", "n > 0"),
            Refers("Parent", ("parent",), "parents", ("id",)),
            Refers("Owner", ("parent",), "parents", ("id",), when="parent is not null", holds="parents.owner = owner", reads=("owner",)),
            Alone("OneBig", ("label",), "n > 1"),
        ),
        "parents": (Row("Label", "label <> ''"), Refers("Child", ("id", "owner"), "children", ("parent", "owner"))),
        "list": (Prefix("Known", "id", ("1", "2", "3")),),
        "empty": (Row("Never", "false"),),
    }
    broken, counts = audit.audit(tables, dict.fromkeys(tables, "id"), rules)
    assert found(broken) == [("children", "10", "OneBig"), ("children", "11", "Owner"), ("children", "11", "Positive"), ("children", "12", "Owner"), ("children", "12", "Parent"), ("children", "12", "Positive"), ("children", "13", "Parent"), ("list", "3", "Known"), ("parents", "2", "Label")]
    assert sorted(tuple(r) for r in counts.collect()) == [("children", "OneBig", 5, 1), ("children", "Owner", 5, 2), ("children", "Parent", 5, 2), ("children", "Positive", 5, 2), ("empty", "Never", 0, 0), ("list", "Known", 2, 1), ("parents", "Child", 2, 0), ("parents", "Label", 2, 1)]
    assert audit.missing_columns(tables, {"parents": ["id", "size"], "gone": ["id"]}) == [("parents", "size"), ("gone", "id")]
    with pytest.raises(AnalysisException):
        audit.audit(tables, dict.fromkeys(tables, "id"), {"empty": (Row("Odd", "size > 0"),)})


def test_one_pass_a_table_and_one_join_a_lookup(spark, sf_dir):
    """Rules that look up one table by one key share a join."""
    rules = audit.project_rules(audit_queries.MIGRATIONS)["comparisons"]
    tables = audit_queries.store_tables(spark, sf_dir)
    df, lookup = audit._joined(tables["comparisons"], tables, [*rules, Refers("Again", ("own_id",), "versions", ("id",), reads=("sha256",))])
    assert lookup["OwnBaseline"] == lookup["Again"] and len(set(lookup.values())) == 4
    assert set(df.schema[lookup["Again"]].dataType.names) == {"there", "project_id", "role", "sha256", "snapshot_id"}


def test_every_rule_of_the_store_is_broken_somewhere(spark):
    tables = audit_queries.store_tables(spark, "/root/testdata/sf0.01")
    stray = spark.createDataFrame([(-5, 1, "-5:1")], "project_id long, number long, id string")
    lost = tables["versions"].where("id = 1").selectExpr("-7L as id", "-5L as project_id", "sha256", "path", "role", "snapshot_id", "round_number", "version_number", "duplicate_of")
    tables |= {"rounds": tables["rounds"].unionByName(stray, allowMissingColumns=True), "versions": tables["versions"].unionByName(lost)}
    _, counts = audit.audit_projects(tables, audit_queries.MIGRATIONS)
    rows = counts.collect()
    assert len(rows) == 36 and [(r.table_name, r.rule) for r in rows if r.n_broken == 0] == []
    assert all(r.n_broken < r.n_rows for r in rows)

from __future__ import annotations

from docweave.operators import history
from docweave.plans import history_queries
from pyspark.sql import functions as F


def _seen(monkeypatch, name, at):
    """The options that a step of a query is given."""
    seen, step = [], getattr(history, name)
    monkeypatch.setattr(history, name, lambda *a: seen.append(a[at]) or step(*a))
    return seen


def test_advice_looks_at_few_options_of_a_project(spark, sf_dir, monkeypatch):
    seen = _seen(monkeypatch, "advice", 1)
    history_queries.baseline_advice(spark, sf_dir)
    per = seen[0].groupBy("project_id", "type").count().agg({"count": "max"}).first()[0]
    assert per == 1


def test_advice_is_that_of_all_options(spark, sf_dir):
    made = history_queries._projects(spark, sf_dir)
    tables = [made[n] for n in ("projects", "versions", "templates", "template_versions")]
    told = lambda **how: sorted(history.advice(made["asked"], history.choices(**made, **how)[0], *tables).collect(), key=repr)
    assert told() == told(foremost=True)


def test_a_rematch_looks_at_what_is_selected(spark, sf_dir, monkeypatch):
    seen = _seen(monkeypatch, "resolve", 1)
    history_queries.rematched_baselines(spark, sf_dir)
    listed = seen[0].where("type = 'Template'")
    assert listed.groupBy("project_id").count().where("count > 1").isEmpty()


def test_the_product_is_dealt_in_cells(spark, monkeypatch):
    monkeypatch.setattr(history, "CELL", 3)
    left = spark.createDataFrame([(k % 3, k) for k in range(30)], "t long, p long")
    right = spark.createDataFrame([(k % 4, k) for k in range(40)], "t long, v long")
    met = history._each_with_each(left, right, "t", "p", "v")
    assert sorted(map(tuple, met.collect())) == sorted(map(tuple, left.join(right, "t").collect()))


def test_the_product_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(history, "CELL", 5)
    left = spark.createDataFrame([(k % 2, k) for k in range(60)], "t long, p long")
    right = spark.createDataFrame([(k % 2, k) for k in range(80)], "t long, v long")
    met = history._each_with_each(left, right, "t", "p", "v").groupBy(F.spark_partition_id()).count().collect()
    assert len(met) > spark.sparkContext.defaultParallelism and max(r["count"] for r in met) < 30 * 40

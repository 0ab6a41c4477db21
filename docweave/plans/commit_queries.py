"""Queries of a store whose tables change by commits, and the SQL that must agree.

Each query loads a store in the shared folder from the relational tables, lets authors work
on it, and reports what the store holds in the end and what was refused. Customers stand for
projects, orders for versions and comparisons, order lines for changes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import commits
from docweave.operators.commits import PROJECT_TABLES, Change, Store
from docweave.storage import shared_dir


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _store(spark: SparkSession, label: str, **tables: DataFrame) -> Store:
    store = Store(spark, f"{shared_dir(spark)}/docweave/{label}-{uuid.uuid4().hex}", PROJECT_TABLES)
    store.transact(lambda now: Change(tables), "load")
    return store


def _said(df: DataFrame, what: str, id_: str, reason: str, number: str | None = None) -> DataFrame:
    n = F.lit(None) if number is None else F.col(number)
    return df.select(F.lit(what).alias("what"), F.col(id_).cast("long").alias("id"), n.cast("long").alias("number"), F.col(reason).alias("said"))


def store_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two authors review the same comparisons from what they saw at first; the second one's conflicting edits are refused."""
    lines = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag"))
    state = F.when(F.col("flag") == "R", "Confirmed").when(F.col("flag") == "A", "Ignored").otherwise("Unresolved")
    store = _store(spark, "reviews", states=lines.select(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").cast("long").alias("change_id"), state.alias("state")))
    seen = store.snapshot()["states"]
    edits = lambda every, lines, to, expected: seen.where((F.col("record_id") % every == 0) & (F.col("change_id") <= lines)).select(F.col("record_id").alias("edit_id"), "record_id", "change_id", F.lit(to).alias("state"), expected.alias("expected"))
    one = store.transact(commits.edit_reviews(edits(3, 2, "Confirmed", F.lit("Unresolved"))), "first author")
    two = store.transact(commits.edit_reviews(edits(2, 3, "Ignored", F.col("state"))), "second author")
    changed = store.snapshot()["states"].where("_version > 1")
    out = _said(changed.where("_version = 2"), "first", "record_id", "state", "change_id").unionByName(_said(changed.where("_version = 3"), "second", "record_id", "state", "change_id"))
    return out.unionByName(_said(one.refused, "first refused", "edit_id", "reason")).unionByName(_said(two.refused, "second refused", "edit_id", "reason"))


REVIEWS_SQL = """WITH s AS (SELECT l_orderkey AS r, l_linenumber AS c, CASE max(l_returnflag) WHEN 'R' THEN 'Confirmed' WHEN 'A' THEN 'Ignored' ELSE 'Unresolved' END AS state FROM lineitem GROUP BY 1, 2),
a AS (SELECT r, bool_and(state = 'Unresolved') AS ok FROM s WHERE r % 3 = 0 AND c <= 2 GROUP BY 1),
b AS (SELECT r, NOT (r % 3 = 0 AND EXISTS (SELECT 1 FROM a WHERE a.r = s.r AND ok)) AS ok FROM s WHERE r % 2 = 0 AND c <= 3 GROUP BY 1)
SELECT 'first' AS what, r AS id, CAST(c AS BIGINT) AS number, 'Confirmed' AS said FROM s JOIN a USING (r) WHERE ok AND c <= 2
UNION ALL SELECT 'second', r, c, 'Ignored' FROM s JOIN b USING (r) WHERE ok AND c <= 3
UNION ALL SELECT 'first refused', r, NULL, 'Conflict' FROM a WHERE NOT ok UNION ALL SELECT 'second refused', r, NULL, 'Conflict' FROM b WHERE NOT ok"""


def store_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders imported as versions in two batches: numbers go on, rounds follow, equal contents need leave."""
    c, o = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders")
    projects = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") >= 0, "Active").otherwise("Archived").alias("status"), F.lit(1).cast("long").alias("next_number"))
    store = _store(spark, "imports", projects=projects)
    content = F.concat_ws("-", "o_orderpriority", F.year("o_orderdate").cast("string"))
    key = F.col("o_orderkey")
    asked = o.select(key.alias("id"), F.col("o_custkey").alias("project_id"), content.alias("sha256"), (key % 500).alias("snapshot_id"), F.when(F.col("o_orderdate") < "1995-01-01", 1).when(F.col("o_custkey") % 5 == 0, 1).otherwise(2).alias("round_number"), (key % 7 != 0).alias("allow_duplicate"), F.datediff("o_orderdate", F.lit("1990-01-01")).alias("position"), "o_orderdate")
    one = store.transact(commits.import_versions(asked.where("o_orderdate < '1995-01-01'")), "early orders")
    two = store.transact(commits.import_versions(asked.where("o_orderdate >= '1995-01-01'")), "late orders")
    versions = store.snapshot()["versions"].withColumn("said", F.concat(F.lit("round "), F.col("round_number").cast("string"), F.coalesce(F.concat(F.lit(" copy of "), F.col("duplicate_of").cast("string")), F.lit(""))))
    return _said(versions, "version", "id", "said", "version_number").unionByName(_said(one.refused, "early refused", "id", "reason")).unionByName(_said(two.refused, "late refused", "id", "reason"))


IMPORTS_SQL = """WITH o AS (
  SELECT o_orderkey AS id, o_custkey AS p, o_orderpriority || '-' || year(o_orderdate) AS sha, o_orderdate AS at_day, o_orderdate < '1995-01-01' AS early,
    CASE WHEN o_orderdate < '1995-01-01' OR o_custkey % 5 = 0 THEN 1 ELSE 2 END AS round, o_orderkey % 7 <> 0 AS allowed, c_acctbal >= 0 AS active, c_custkey IS NOT NULL AS known
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey
), e AS (
  SELECT *, CASE WHEN row_number() OVER w > 1 THEN first_value(id) OVER w END AS copy_of, count(*) OVER (PARTITION BY p) AS n FROM o WHERE early WINDOW w AS (PARTITION BY p, sha ORDER BY at_day, id)
), e1 AS (
  SELECT *, CASE WHEN NOT known THEN 'ProjectMissing' WHEN NOT active THEN 'ProjectNotActive' WHEN n > 100 THEN 'TooManyVersions' WHEN copy_of IS NOT NULL AND NOT allowed THEN 'DuplicateContent' END AS own FROM e
), e2 AS (
  SELECT *, bool_or(own IS NOT NULL) OVER (PARTITION BY p) AS refused, row_number() OVER (PARTITION BY p ORDER BY at_day, id) AS number FROM e1
), held AS (
  SELECT p, sha, arg_min(id, number) AS held FROM e2 WHERE NOT refused GROUP BY ALL
), had AS (
  SELECT p, count(*) AS n_held FROM e2 WHERE NOT refused GROUP BY 1
), l AS (
  SELECT o.*, coalesce(held, CASE WHEN row_number() OVER w > 1 THEN first_value(id) OVER w END) AS copy_of, coalesce(n_held, 0) AS n_held, count(*) OVER (PARTITION BY o.p) AS n
  FROM o LEFT JOIN held ON held.p = o.p AND held.sha = o.sha LEFT JOIN had ON had.p = o.p WHERE NOT early WINDOW w AS (PARTITION BY o.p, o.sha ORDER BY at_day, id)
), l1 AS (
  SELECT *, CASE WHEN NOT known THEN 'ProjectMissing' WHEN NOT active THEN 'ProjectNotActive' WHEN n > 100 THEN 'TooManyVersions' WHEN round = 2 AND n_held = 0 THEN 'RoundSkipped' WHEN copy_of IS NOT NULL AND NOT allowed THEN 'DuplicateContent' END AS own FROM l
), l2 AS (
  SELECT *, bool_or(own IS NOT NULL) OVER (PARTITION BY p) AS refused, n_held + row_number() OVER (PARTITION BY p ORDER BY at_day, id) AS number FROM l1
)
SELECT 'version' AS what, id, number, 'round ' || round || coalesce(' copy of ' || copy_of, '') AS said FROM (SELECT id, number, round, copy_of, refused FROM e2 UNION ALL SELECT id, number, round, copy_of, refused FROM l2) WHERE NOT refused
UNION ALL SELECT 'early refused', id, NULL, coalesce(own, 'OtherRowRefused') FROM e2 WHERE refused UNION ALL SELECT 'late refused', id, NULL, coalesce(own, 'OtherRowRefused') FROM l2 WHERE refused"""


def store_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the projects are to be deleted for good: what goes with each, and which snapshots nothing names any more."""
    c, o = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders")
    key, none = F.col("o_orderkey"), F.lit(None).cast("long")
    snapshot = lambda shift: ((key * 7 + shift) % 4001).alias
    versions = o.select(key.alias("id"), F.col("o_custkey").alias("project_id"), F.lit("").alias("sha256"), snapshot(0)("snapshot_id"), F.lit(1).alias("round_number"), none.alias("version_number"), none.alias("duplicate_of"))
    store = _store(
        spark, "deletions", versions=versions,
        projects=c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") < 5000, "Recycled").otherwise("Active").alias("status"), F.lit(1).cast("long").alias("next_number")),
        snapshots=spark.range(4001).select("id", F.lit("").alias("sha256")).join(o.select(snapshot(0)("id")).distinct(), "id", "left_semi"),
        records=o.where(key % 4 == 0).select(key.alias("id"), F.col("o_custkey").alias("project_id"), key.alias("version_id"), snapshot(1)("b_snapshot"), snapshot(0)("c_snapshot")),
        operations=o.where(key % 97 == 0).select(key.alias("id"), key.alias("version_id"), F.when(key % 2 == 0, "Prepared").otherwise("Completed").alias("status")),
    )
    locked = o.where((F.col("o_custkey") % 7 != 0) | (key % 5 != 0)).groupBy(F.col("o_custkey").alias("project_id")).agg(F.collect_list("o_orderkey").alias("version_ids"))
    asked = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("project_id")).join(locked, "project_id", "left").withColumn("version_ids", F.coalesce("version_ids", F.array().cast("array<bigint>")))
    done = store.transact(commits.delete_projects(asked), "delete")
    now = store.snapshot()
    kept = [now[t].select(F.lit(t).alias("what"), F.col(k).alias("id"), F.lit(None).cast("long").alias("number"), F.lit(None).cast("string").alias("said")) for t, k in (("projects", "id"), ("versions", "id"), ("snapshots", "id"), ("records", "id"), ("operations", "id"))]
    journal = now["deletions"].select(F.lit("deleted").alias("what"), F.col("project_id").alias("id"), F.size("version_ids").cast("long").alias("number"), F.col("status").alias("said"))
    out = journal.unionByName(_said(done.refused, "refused", "project_id", "reason"))
    for rows in kept:
        out = out.unionByName(rows)
    return out


DELETIONS_SQL = """WITH o AS (SELECT o_orderkey AS id, o_custkey AS p, (o_orderkey * 7) % 4001 AS snap, (o_orderkey * 7 + 1) % 4001 AS b_snap FROM orders),
asked AS (
  SELECT c_custkey AS p, CASE WHEN c_acctbal >= 5000 THEN 'NotRecycled' WHEN c_custkey % 7 = 0 AND EXISTS (SELECT 1 FROM o WHERE o.p = c_custkey AND id % 5 = 0) THEN 'VersionsChanged'
    WHEN EXISTS (SELECT 1 FROM o WHERE o.p = c_custkey AND id % 97 = 0 AND id % 2 = 0) THEN 'OperationPending' END AS reason FROM customer WHERE c_custkey % 3 = 0
), gone AS (SELECT p FROM asked WHERE reason IS NULL),
live AS (SELECT * FROM o WHERE p NOT IN (SELECT p FROM gone)), dead AS (SELECT * FROM o WHERE p IN (SELECT p FROM gone)),
named AS (SELECT snap FROM live UNION SELECT b_snap FROM live WHERE id % 4 = 0), touched AS (SELECT snap FROM dead UNION SELECT b_snap FROM dead WHERE id % 4 = 0)
SELECT 'deleted' AS what, p AS id, (SELECT count(*) FROM dead WHERE dead.p = gone.p) AS number, 'PendingCleanup' AS said FROM gone
UNION ALL SELECT 'refused', p, NULL, reason FROM asked WHERE reason IS NOT NULL
UNION ALL SELECT 'projects', c_custkey, NULL, NULL FROM customer WHERE c_custkey NOT IN (SELECT p FROM gone)
UNION ALL SELECT 'versions', id, NULL, NULL FROM live UNION ALL SELECT 'records', id, NULL, NULL FROM live WHERE id % 4 = 0 UNION ALL SELECT 'operations', id, NULL, NULL FROM live WHERE id % 97 = 0
UNION ALL SELECT 'snapshots', snap, NULL, NULL FROM (SELECT DISTINCT snap FROM o) WHERE snap IN (SELECT snap FROM named) OR snap NOT IN (SELECT snap FROM touched)"""

QUERIES = {
    "store_reviews": (store_reviews, REVIEWS_SQL),
    "store_imports": (store_imports, IMPORTS_SQL),
    "store_deletions": (store_deletions, DELETIONS_SQL),
}

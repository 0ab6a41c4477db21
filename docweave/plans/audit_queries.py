"""The audit of a whole store, over tables derived from the relational ones that break every rule somewhere, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.operators import audit
from docweave.storage import stored

#: The migrations that a store may have, in order; the regions stand for those applied.
MIGRATIONS = ("0-AFRICA", "1-AMERICA", "2-ASIA", "3-EUROPE", "4-OCEANIA")


def store_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Customers are projects, orders versions, comparisons and operations, parts versions of templates."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    o, c, part = t("orders"), t("customer"), t("part")
    key, cust, p = F.col("o_orderkey"), F.col("c_custkey"), F.col("p_partkey")
    every = lambda column, n: column % n == 0
    null = F.lit(None).cast("long")
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    sha = lambda column: F.sha2((column % 50).cast("string").cast("binary"), 256)
    path = lambda column, n: F.when(every(column, n), "in/x").when(column % 2 == 0, F.concat(F.lit("C:\\"), column.cast("string"))).otherwise(F.concat(F.lit("/in/"), column.cast("string")))
    versions = o.select(
        key.alias("id"), F.col("o_custkey").alias("project_id"), F.when(every(key, 53), "abc").otherwise(sha(key)).alias("sha256"), path(key, 59).alias("path"),
        F.when(every(key, 61), "Odd").when(key % 2 == 0, "Own").otherwise("Counterparty").alias("role"), key.alias("snapshot_id"), (1 + key % 3).alias("round_number"),
        F.when(every(key, 89), 0).otherwise(number).alias("version_number"), F.when(every(key, 158), F.lit(-1).cast("long")).when(every(key, 79), key).alias("duplicate_of"),
    )
    facts = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))
    projects = c.join(facts, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        cust.alias("id"), F.when(every(cust, 41), " ").otherwise(F.col("c_name")).alias("name"), F.when(every(cust, 37), "Odd").otherwise("Active").alias("status"),
        F.when(every(cust, 31), 0).when(every(cust, 29), 1).otherwise(F.coalesce("n", F.lit(0)) + 1).cast("long").alias("next_number"),
        F.when(every(cust, 43), F.lit(-1).cast("long")).when(every(cust, 3), F.col("first")).alias("baseline_version_id"),
        F.when(every(cust, 20), cust % 100 + 1).when(every(cust, 4), cust % 100).alias("bound_template_id"), F.when(every(cust, 24), null).when(every(cust, 4), cust % 200 + 1).alias("bound_version_id"),
    )
    rounds = c.select(cust.alias("project_id"), F.explode(F.when(every(cust, 47), F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(3)))).alias("number"))
    kind = F.when(every(key, 52), "Odd").when(key % 12 == 0, "Own").when(key % 12 == 4, "Template").otherwise("Version")
    comparisons = o.where(every(key, 4)).select(
        key.alias("record_id"), F.col("o_custkey").alias("project_id"), key.alias("current_id"), F.when(every(key, 92), -1).otherwise(key).cast("long").alias("current_snapshot"), kind.alias("baseline_type"),
        F.when(kind == "Own", key).alias("own_id"), F.when(kind == "Template", key % 200 + 1).alias("template_version_id"), F.when((kind == "Version") | every(key, 20), key).alias("version_id"),
        F.when(every(key, 44), 0).when(kind == "Template", -(key % 200 + 1)).otherwise(key).cast("long").alias("baseline_snapshot"),
    )
    templates = part.select(p.alias("id"), (p % 100).alias("template_id"), sha(p).alias("sha256"), path(p, 23).alias("path"), (-p).alias("snapshot_id"), ((p <= 100) | every(p, 97)).alias("is_current"), F.when(every(p, 19), "Odd").otherwise("Complete").alias("parse_status"))
    snapshots = o.where(key % 67 != 0).select(key.alias("id"), F.when(every(key, 71), "").otherwise(sha(key)).alias("sha256"), F.when(every(key, 73), 9).otherwise(1).alias("schema_version"))
    snapshots = snapshots.unionByName(part.select((-p).alias("id"), F.when(every(p, 17), "").otherwise(sha(p)).alias("sha256"), F.lit(1).alias("schema_version")))
    text = F.concat(F.lit("s"), key.cast("string"))
    copies = o.where(every(key, 5)).select(key.alias("version_id"), text.alias("sha256"), key.alias("last_operation_id"))
    operations = o.where(every(key, 5) & (key % 55 != 0)).select(key.alias("id"), F.when(every(key, 65), -1).otherwise(key).cast("long").alias("version_id"), F.when(every(key, 35), "").otherwise(text).alias("after"), F.when(every(key, 85), "Odd").otherwise("Completed").alias("status"))
    deletions = c.where(every(cust, 10)).select(cust.alias("id"), F.when(every(cust, 30), "Odd").otherwise("Completed").alias("status"), F.when(every(cust, 40), "a/../b").when(every(cust, 70), "/a").otherwise("a/b").alias("path"), F.when(every(cust, 90), "").otherwise(sha(cust)).alias("sha256"))
    migrations = t("region").select(F.concat_ws("-", F.col("r_regionkey").cast("string"), F.trim("r_name")).alias("id"))
    made = {"projects": projects, "rounds": rounds.withColumn("id", F.concat_ws(":", "project_id", "number")), "versions": versions, "comparisons": comparisons, "template_versions": templates, "snapshots": snapshots, "copies": copies, "operations": operations, "deletions": deletions, "migrations": migrations}
    return made | {"versions": stored(versions, "audit-versions")}


def store_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each rule of the store looked at and found broken."""
    return audit.audit_projects(store_tables(spark, sf_dir), MIGRATIONS)[1]


def store_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every broken row of the store with the rule it breaks."""
    return audit.audit_projects(store_tables(spark, sf_dir), MIGRATIONS)[0]


_SHA = "sha256(CAST({} % 50 AS VARCHAR))"
_FAULTS = f"""v AS (
  SELECT o_orderkey AS id, o_custkey AS p, CASE WHEN o_orderkey % 53 = 0 THEN 'abc' ELSE {_SHA.format('o_orderkey')} END AS sha, CASE WHEN o_orderkey % 61 = 0 THEN 'Odd' WHEN o_orderkey % 2 = 0 THEN 'Own' ELSE 'Counterparty' END AS role,
    1 + o_orderkey % 3 AS round, CASE WHEN o_orderkey % 89 = 0 THEN 0 ELSE row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS number FROM orders
), pr AS (
  SELECT c_custkey AS id, c_name, CASE WHEN c_custkey % 31 = 0 THEN 0 WHEN c_custkey % 29 = 0 THEN 1 ELSE (SELECT count(*) FROM v WHERE v.p = c_custkey) + 1 END AS next_number,
    CASE WHEN c_custkey % 43 = 0 THEN -1 WHEN c_custkey % 3 = 0 THEN (SELECT min(id) FROM v WHERE v.p = c_custkey) END AS baseline,
    CASE WHEN c_custkey % 20 = 0 THEN c_custkey % 100 + 1 WHEN c_custkey % 4 = 0 THEN c_custkey % 100 END AS bound, CASE WHEN c_custkey % 24 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN c_custkey % 200 + 1 END AS bound_version FROM customer
), r AS (
  SELECT c_custkey AS p, unnest(CASE WHEN c_custkey % 47 = 0 THEN [0, 1, 2] ELSE [1, 2, 3] END) AS number FROM customer
), c AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 52 = 0 THEN 'Odd' WHEN o_orderkey % 12 = 0 THEN 'Own' WHEN o_orderkey % 12 = 4 THEN 'Template' ELSE 'Version' END AS kind FROM orders WHERE o_orderkey % 4 = 0
), faults AS (
  SELECT 'projects' AS table_name, id, 'ProjectName' AS rule FROM pr WHERE id % 41 = 0
  UNION ALL SELECT 'projects', id, 'ProjectStatus' FROM pr WHERE id % 37 = 0
  UNION ALL SELECT 'projects', id, 'NextNumber' FROM pr WHERE next_number < 1
  UNION ALL SELECT 'projects', id, 'VersionSequence' FROM pr WHERE (SELECT max(number) FROM v WHERE v.p = pr.id) >= next_number
  UNION ALL SELECT 'projects', id, 'BaselineIdentity' FROM pr WHERE baseline IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v WHERE v.id = baseline AND v.p = pr.id AND role = 'Own')
  UNION ALL SELECT 'projects', id, 'BindingWhole' FROM pr WHERE (bound IS NULL) <> (bound_version IS NULL)
  UNION ALL SELECT 'projects', id, 'BindingIdentity' FROM pr WHERE bound IS NOT NULL AND bound_version IS NOT NULL AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = bound_version AND p_partkey % 100 = bound)
  UNION ALL SELECT 'rounds', p || ':' || number, 'RoundNumber' FROM r WHERE number < 1
  UNION ALL SELECT 'versions', id, 'VersionHash' FROM v WHERE id % 53 = 0
  UNION ALL SELECT 'versions', id, 'VersionPath' FROM v WHERE id % 59 = 0
  UNION ALL SELECT 'versions', id, 'VersionRole' FROM v WHERE id % 61 = 0
  UNION ALL SELECT 'versions', id, 'VersionNumber' FROM v WHERE number < 1
  UNION ALL SELECT 'versions', id, 'VersionProject' FROM v WHERE p NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'versions', id, 'VersionRound' FROM v WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.p = v.p AND r.number = v.round)
  UNION ALL SELECT 'versions', id, 'SnapshotIdentity' FROM v WHERE id % 67 = 0 OR id % 71 = 0 OR id % 53 = 0
  UNION ALL SELECT 'versions', id, 'DuplicateIdentity' FROM v WHERE id % 158 = 0
  UNION ALL SELECT 'comparisons', id, 'BaselineType' FROM c WHERE kind = 'Odd'
  UNION ALL SELECT 'comparisons', id, 'BaselineOnlyOne' FROM c WHERE kind = 'Odd' OR (id % 20 = 0 AND kind <> 'Version')
  UNION ALL SELECT 'comparisons', id, 'CurrentIdentity' FROM c WHERE id % 92 = 0
  UNION ALL SELECT 'comparisons', id, 'OwnBaseline' FROM c WHERE kind = 'Own' AND (id % 44 = 0 OR id % 61 = 0)
  UNION ALL SELECT 'comparisons', id, 'TemplateBaseline' FROM c WHERE kind = 'Template' AND (id % 44 = 0 OR id % 200 + 1 NOT IN (SELECT p_partkey FROM part))
  UNION ALL SELECT 'comparisons', id, 'VersionBaseline' FROM c WHERE kind = 'Version' AND id % 44 = 0
  UNION ALL SELECT 'template_versions', p_partkey, 'SnapshotIdentity' FROM part WHERE p_partkey % 17 = 0
  UNION ALL SELECT 'template_versions', p_partkey, 'TemplatePath' FROM part WHERE p_partkey % 23 = 0
  UNION ALL SELECT 'template_versions', p_partkey, 'TemplateParsed' FROM part WHERE p_partkey % 19 = 0
  UNION ALL SELECT 'template_versions', min(p_partkey), 'OneCurrent' FROM part GROUP BY p_partkey % 100 HAVING count(*) FILTER (p_partkey <= 100 OR p_partkey % 97 = 0) <> 1
  UNION ALL SELECT 'snapshots', o_orderkey, 'SnapshotSchema' FROM orders WHERE o_orderkey % 67 <> 0 AND o_orderkey % 73 = 0
  UNION ALL SELECT 'snapshots', o_orderkey, 'SnapshotHash' FROM orders WHERE o_orderkey % 67 <> 0 AND o_orderkey % 71 = 0
  UNION ALL SELECT 'snapshots', -p_partkey, 'SnapshotHash' FROM part WHERE p_partkey % 17 = 0
  UNION ALL SELECT 'copies', o_orderkey, 'OperationChain' FROM orders WHERE o_orderkey % 5 = 0 AND (o_orderkey % 55 = 0 OR o_orderkey % 65 = 0 OR o_orderkey % 35 = 0)
  UNION ALL SELECT 'operations', o_orderkey, 'OperationStatus' FROM orders WHERE o_orderkey % 55 <> 0 AND o_orderkey % 85 = 0
  UNION ALL SELECT 'operations', o_orderkey, 'OperationVersion' FROM orders WHERE o_orderkey % 55 <> 0 AND o_orderkey % 65 = 0
  UNION ALL SELECT 'deletions', c_custkey, 'DeletionStatus' FROM customer WHERE c_custkey % 30 = 0
  UNION ALL SELECT 'deletions', c_custkey, 'DeletionPath' FROM customer WHERE c_custkey % 40 = 0 OR c_custkey % 70 = 0
  UNION ALL SELECT 'deletions', c_custkey, 'DeletionHash' FROM customer WHERE c_custkey % 90 = 0
  UNION ALL SELECT 'migrations', r_regionkey || '-' || trim(r_name), 'KnownMigrations' FROM region WHERE r_regionkey || '-' || trim(r_name) NOT IN {MIGRATIONS}
)"""
FAULTS_SQL = f"WITH {_FAULTS} SELECT table_name, CAST(id AS VARCHAR) AS key, rule FROM faults"
_RULES = ", ".join(f"('{t}', '{r.name}')" for t, rules in audit.project_rules(MIGRATIONS).items() for r in rules)
AUDIT_SQL = f"""WITH {_FAULTS}, sizes AS (
  SELECT 'projects' AS table_name, count(*) AS n_rows FROM customer UNION ALL SELECT 'rounds', 3 * count(*) FROM customer UNION ALL SELECT 'versions', count(*) FROM orders UNION ALL SELECT 'comparisons', count(*) FROM c
  UNION ALL SELECT 'template_versions', count(*) FROM part UNION ALL SELECT 'snapshots', (SELECT count(*) FROM orders WHERE o_orderkey % 67 <> 0) + (SELECT count(*) FROM part) UNION ALL SELECT 'copies', count(*) FROM orders WHERE o_orderkey % 5 = 0
  UNION ALL SELECT 'operations', count(*) FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 55 <> 0 UNION ALL SELECT 'deletions', count(*) FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT 'migrations', count(*) FROM region
)
SELECT k.table_name, k.rule, n_rows, count(f.id) AS n_broken FROM (VALUES {_RULES}) k(table_name, rule) JOIN sizes USING (table_name) LEFT JOIN faults f ON f.table_name = k.table_name AND f.rule = k.rule GROUP BY ALL"""

QUERIES = {"store_audit": (store_audit, AUDIT_SQL), "store_faults": (store_faults, FAULTS_SQL)}

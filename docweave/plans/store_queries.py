"""Queries of the catalog operators over the relational tables, and the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.operators import catalog, review
from docweave.sources import html


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def project_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second page of the open orders of large value, newest first, with the names they refer to."""
    rows = catalog.where_given(_t(spark, sf_dir, "orders"), [("O", F.col("o_orderstatus") == "O"), (1000, F.col("o_totalprice") >= 1000), (None, F.lit(False))])
    rows = catalog.page(rows, [F.desc("o_orderdate"), F.asc("o_orderkey")], 20, 20)
    return catalog.labelled(rows, [(_t(spark, sf_dir, "customer"), "o_custkey", "c_custkey", "c_name", "customer", "none")]).select("o_orderkey", "o_custkey", "o_totalprice", "customer")


def left_join_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with nation, region, best supplier of the nation and latest order, each with a default label."""
    t = lambda n: _t(spark, sf_dir, n)
    supplier = t("supplier").groupBy("s_nationkey").agg(F.max_by("s_name", F.struct("s_acctbal", "s_suppkey")).alias("best"))
    latest = t("orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).cast("string").alias("latest"))
    nations = t("nation").withColumn("shown", F.when(F.col("n_nationkey") % 5 != 0, F.col("n_name")))
    rows = t("customer").join(nations.select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    out = catalog.labelled(rows, [(nations, "c_nationkey", "n_nationkey", "shown", "nation", "unassigned"), (t("region"), "n_regionkey", "r_regionkey", "r_name", "region", "none"), (supplier, "c_nationkey", "s_nationkey", "best", "supplier", "no supplier"), (latest, "c_custkey", "o_custkey", "latest", "latest_order", "no order")])
    return out.select("c_custkey", "nation", "region", "supplier", "latest_order")


LABELS_SQL = """SELECT c_custkey, coalesce(CASE WHEN n_nationkey % 5 <> 0 THEN n_name END, 'unassigned') AS nation, coalesce(r_name, 'none') AS region,
  coalesce(best, 'no supplier') AS supplier, coalesce(latest, 'no order') AS latest_order
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT s_nationkey, arg_max(s_name, (s_acctbal, s_suppkey)) AS best FROM supplier GROUP BY 1) s ON s_nationkey = c_nationkey
LEFT JOIN (SELECT o_custkey, CAST(arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS VARCHAR) AS latest FROM orders GROUP BY 1) o ON o_custkey = c_custkey"""


def version_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.numbered(_t(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "version_number")


def import_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the last year numbered on from those before."""
    orders = _t(spark, sf_dir, "orders")
    old, new = orders.where("o_orderdate < '1998-01-01'"), orders.where("o_orderdate >= '1998-01-01'")
    start = catalog.next_numbers(catalog.numbered(old, "o_custkey", ["o_orderdate", "o_orderkey"]), "o_custkey")
    return catalog.numbered(new, "o_custkey", ["o_orderdate", "o_orderkey"], start).select("o_custkey", "o_orderkey", "version_number")


def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.next_numbers(catalog.numbered(_t(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]), "o_custkey")


def duplicate_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return catalog.first_copies(docs, "lang", "sha", ["doc_id"], "doc_id").where("duplicate_of is not null").select("doc_id", "lang", "duplicate_of")


def round_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose line numbers are not 1 .. n."""
    return catalog.round_gaps(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber").select("l_orderkey", "highest", "rounds")


def last_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(catalog.RECENT).select("event_id", "user_id", "event_type")


def latest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))


def top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return _t(spark, sf_dir, "orders").withColumn("rank", rank).where("rank <= 3").select("o_custkey", "rank", "o_orderkey", "o_totalprice")


def chronological_or_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sort modes of a version list as positions."""
    orders = _t(spark, sf_dir, "orders")
    key = Window.partitionBy("o_custkey")
    return orders.select("o_orderkey", F.row_number().over(key.orderBy("o_orderdate", "o_orderkey")).alias("by_time"), F.row_number().over(key.orderBy("o_orderpriority", "o_orderdate", "o_orderkey")).alias("by_round"))


def orphan_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no line of either kind of order refers to."""
    lines = _t(spark, sf_dir, "lineitem")
    refs = [(lines.where("l_returnflag = 'R'"), "l_partkey"), (lines.where("l_linestatus = 'O' and l_quantity > 30"), "l_partkey"), (lines.where("l_shipdate < '1993-01-01'"), "l_partkey")]
    return catalog.orphans(_t(spark, sf_dir, "part"), "p_partkey", refs).select("p_partkey", "p_name")


def reference_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "orders")
    return catalog.reference_counts([(lines, "l_suppkey", "l_orderkey"), (lines.where("l_returnflag = 'R'"), "l_suppkey", "l_orderkey"), (orders.select((F.col("o_custkey") % 10).alias("k"), "o_orderkey"), "k", "o_orderkey")]).select(F.col("key").alias("supp"), "references")


def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a returned line."""
    lines = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    owners = _t(spark, sf_dir, "orders").join(lines, "o_orderkey", "left_semi").select(F.col("o_custkey").alias("c_custkey"))
    return _t(spark, sf_dir, "customer").join(owners, "c_custkey", "left_semi").select("c_custkey", "c_name")


def payload_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.payload_bytes({n: (_t(spark, sf_dir, n), c) for n, c in (("pages", "html"), ("documents", "text"), ("conversations", "text"))})


def usage_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of pages by kind of path."""
    kind = F.when(F.col("url").contains("/en/"), "english").when(F.col("url").contains("/de/"), "german").when(F.col("url").contains("#"), "anchored").otherwise("other")
    return _t(spark, sf_dir, "pages").groupBy(kind.alias("category")).agg(F.sum(F.octet_length("html").cast("long")).alias("bytes"), F.count("*").alias("files"))


def distinct_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values over several tables, one of them within JSON."""
    a = _t(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("path"))
    b = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("path"))
    c = _t(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("string").alias("path"))
    return a.union(b).union(c).where("path is not null").distinct()


def asof_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest purchase before and after each error of a user."""
    rows = catalog.nearest(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", "event_id")
    return rows.where("event_type = 'error'").select("event_id", "previous", "following")


def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity ranges of the lines of an order against price bands."""
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("a_id"), F.col("l_linenumber").cast("long").alias("a_start"), (F.col("l_linenumber") + F.col("l_quantity")).cast("long").alias("a_stop"))
    bands = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("b_id"), (F.col("o_custkey") % 20).alias("b_start"), (F.col("o_custkey") % 20 + 7).alias("b_stop"))
    return catalog.overlaps(lines, bands, ["k"], 16).groupBy("k").agg(F.count("*").alias("pairs"), F.sum(F.least("a_stop", "b_stop") - F.greatest("a_start", "b_start")).alias("covered"))


def run_length_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.runs(_t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "run", F.col("value").alias("event_type"), "length")


def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start of each line of a text, and the column of each order line: exclusive running sums."""
    lines = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    before = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return lines.select("doc_id", "idx", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).alias("start"))


def column_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, -1)
    span = F.greatest(F.lit(1), (F.col("l_quantity") % 4).cast("long"))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(F.sum(span).over(before), F.lit(0)).alias("col"))


def fact_digest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order table against a copy with changes, row by row."""
    a = _t(spark, sf_dir, "orders")
    b = a.where("o_orderkey % 10 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    return catalog.fact_differences(a, b, "o_orderkey")


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers who bought in both years, in the first only, and in either."""
    orders = _t(spark, sf_dir, "orders")
    a, b = (orders.where(F.year("o_orderdate") == y).select("o_custkey") for y in (1996, 1997))
    one = lambda df, n: df.select(F.lit(n).alias("operation"), "o_custkey")
    return one(a.intersect(b), "both").union(one(a.distinct().exceptAll(b.distinct()), "first")).union(one(a.union(b).distinct(), "either"))


def suggested_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "part").select("p_brand", F.concat_ws(".", (F.col("p_size") % 3).cast("string"), (F.col("p_size") % 11).cast("string"), F.col("p_partkey").cast("string")).alias("version"))
    return catalog.highest_version(rows, "p_brand", "version")


def audit_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").withColumn("line", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")))
    rules = {"discount": F.col("l_discount") < 0.1, "quantity": F.col("l_quantity").between(2, 49), "status": F.col("l_linestatus").isin("O", "F")}
    return catalog.audit(rows, rules, "line").groupBy("rule").agg(F.count("*").alias("broken"))


def foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose order is missing, counted: zero rows mean integrity."""
    return _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("lines"))


def navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pair"), F.format_string("t%05d", "turn").alias("change_id"))
    return review.navigation(rows)


def context_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review.context(_t(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role")
    return rows.select("conv_id", "turn", F.array_join("context", "|").alias("context"))


def html_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("paragraphs"))
    return docs.select("doc_id", F.sha2(html.article(F.col("paragraphs")).cast("binary"), 256).alias("sha"))


def project_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggested names (stem of a file name, trimmed, a default, 100 characters at most) and tag colour checks."""
    pages = _t(spark, sf_dir, "pages")
    stem = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("url", "([^/]*)$", 1), "[?#].*$", ""), "\\.[^.]*$", ""))
    color = F.concat(F.lit("#"), F.upper(F.substring(F.md5(F.col("url").cast("binary")), 1, 6)))
    return pages.select("page_id", F.substring(F.coalesce(F.nullif(stem, F.lit("")), F.lit("untitled")), 1, 100).alias("name"), color.rlike("^#[0-9A-F]{6}$").alias("color_ok"), F.concat(F.lit("V"), (F.col("page_id") + 1).cast("string")).alias("label"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order history of each customer: counts by state within a page of the newest orders."""
    orders, lines = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    state = F.when(F.col("l_returnflag") == "R", "Confirmed").when(F.col("l_returnflag") == "A", "Ignored").otherwise("Unresolved")
    counted = review.counts(lines.select("l_orderkey", state.alias("state")), "l_orderkey")
    joined = orders.join(counted, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_orderdate", "total", "unresolved", "confirmed", "ignored")
    return catalog.page(joined, [F.desc("o_orderdate"), F.asc("o_orderkey")], 0, 100).drop("o_orderdate")


def group_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_returnflag")).alias("states"))
    return rows.select("l_orderkey", review.group_label(F.col("states")).alias("label"))


_ESC = "replace(replace(replace(replace(replace(p, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"

QUERIES = {
    "project_page": (project_page, "SELECT o_orderkey, o_custkey, o_totalprice, coalesce(c_name, 'none') AS customer FROM (SELECT * FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 1000 ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20) LEFT JOIN customer ON c_custkey = o_custkey"),
    "left_join_labels": (left_join_labels, LABELS_SQL),
    "version_backfill": (version_backfill, "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version_number FROM orders"),
    "import_numbers": (import_numbers, "SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version_number FROM orders) WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate >= '1998-01-01')"),
    "next_version": (next_version, "SELECT o_custkey, count(*) + 1 AS next_number FROM orders GROUP BY 1"),
    "duplicate_versions": (duplicate_versions, "SELECT doc_id, lang, duplicate_of FROM (SELECT doc_id, lang, min(doc_id) OVER (PARTITION BY lang, sha256(text)) AS duplicate_of FROM documents) WHERE duplicate_of <> doc_id"),
    "round_gaps": (round_gaps, "SELECT l_orderkey, max(l_linenumber) AS highest, count(DISTINCT l_linenumber) AS rounds FROM lineitem GROUP BY 1 HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(DISTINCT l_linenumber)"),
    "last_50": (last_50, "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50"),
    "latest_row": (latest_row, "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1"),
    "top3": (top3, "SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderkey, o_totalprice FROM orders QUALIFY rank <= 3"),
    "chronological_or_round": (chronological_or_round, "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS by_time, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS by_round FROM orders"),
    "orphan_gc": (orphan_gc, "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' OR (l_linestatus = 'O' AND l_quantity > 30) OR l_shipdate < '1993-01-01')"),
    "reference_count": (reference_count, "SELECT k AS supp, count(*) AS references FROM (SELECT l_suppkey AS k, l_orderkey AS i FROM lineitem UNION SELECT o_custkey % 10, o_orderkey FROM orders) GROUP BY 1"),
    "semi_join": (semi_join, "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))"),
    "payload_bytes": (payload_bytes, "SELECT 'pages' AS table_name, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM pages UNION ALL SELECT 'documents', CAST(sum(strlen(text)) AS BIGINT) FROM documents UNION ALL SELECT 'conversations', CAST(sum(strlen(text)) AS BIGINT) FROM conversations"),
    "usage_by_category": (usage_by_category, "SELECT CASE WHEN contains(url, '/en/') THEN 'english' WHEN contains(url, '/de/') THEN 'german' WHEN contains(url, '#') THEN 'anchored' ELSE 'other' END AS category, CAST(sum(strlen(html)) AS BIGINT) AS bytes, count(*) AS files FROM pages GROUP BY 1"),
    "distinct_paths": (distinct_paths, "SELECT path FROM (SELECT json_extract_string(props, '$.k') AS path FROM events UNION SELECT o_orderpriority FROM orders UNION SELECT CAST(l_linenumber AS VARCHAR) FROM lineitem) WHERE path IS NOT NULL"),
    "asof_neighbours": (asof_neighbours, """SELECT event_id, previous, following FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous,
  first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM events) WHERE event_type = 'error'"""),
    "interval_overlap": (interval_overlap, """SELECT k, count(*) AS pairs, CAST(sum(least(a_stop, b_stop) - greatest(a_start, b_start)) AS BIGINT) AS covered FROM (SELECT l_orderkey AS k, l_linenumber AS a_start, CAST(trunc(l_linenumber + l_quantity) AS BIGINT) AS a_stop FROM lineitem)
  JOIN (SELECT o_orderkey AS k, o_custkey % 20 AS b_start, o_custkey % 20 + 7 AS b_stop FROM orders) USING (k) WHERE a_start < b_stop AND b_start < a_stop AND a_start < a_stop GROUP BY 1"""),
    "run_length_merge": (run_length_merge, """SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, count(*) AS length FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY 1, 2"""),
    "running_offsets": (running_offsets, "SELECT doc_id, CAST(idx AS INT) AS idx, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents)"),
    "column_index": (column_index, "SELECT l_orderkey, l_linenumber, l_partkey, CAST(coalesce(sum(greatest(1, CAST(l_quantity % 4 AS BIGINT))) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS col FROM lineitem"),
    "fact_digest_diff": (fact_digest_diff, "SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 10 = 0 THEN 'removed' ELSE 'changed' END AS difference FROM orders WHERE o_orderkey % 10 = 0 OR (o_orderkey % 7 = 0 AND o_orderstatus <> 'X')"),
    "set_operations": (set_operations, "WITH a AS (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996), b AS (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997) SELECT 'both' AS operation, o_custkey FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first', o_custkey FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'either', o_custkey FROM (SELECT * FROM a UNION SELECT * FROM b)"),
    "suggested_version": (suggested_version, "SELECT p_brand, v[1] || '.' || v[2] || '.' || v[3] AS highest, v[1] || '.' || v[2] || '.' || (v[3] + 1) AS suggested FROM (SELECT p_brand, max([p_size % 3, p_size % 11, p_partkey]) AS v FROM part GROUP BY 1)"),
    "audit_rules": (audit_rules, "SELECT rule, count(*) AS broken FROM (SELECT 'discount' AS rule FROM lineitem WHERE NOT l_discount < 0.1::DOUBLE UNION ALL SELECT 'quantity' FROM lineitem WHERE NOT l_quantity BETWEEN 2 AND 49 UNION ALL SELECT 'status' FROM lineitem WHERE l_linestatus NOT IN ('O', 'F')) GROUP BY 1"),
    "foreign_keys": (foreign_keys, "SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY 1"),
    "navigation": (navigation, "SELECT conv_id AS pair, printf('t%05d', turn) AS change_id, lag(printf('t%05d', turn)) OVER w AS previous, lead(printf('t%05d', turn)) OVER w AS following FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"),
    "context_frame": (context_frame, "SELECT conv_id, turn, array_to_string(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), '|') AS context FROM conversations"),
    "html_preview": (html_preview, f"SELECT doc_id, sha256('<article>' || coalesce(array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda p: p <> ''), lambda p: '<p>' || {_ESC} || '</p>'), ''), '') || '</article>') AS sha FROM documents"),
    "project_names": (project_names, r"SELECT page_id, substr(coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[?#].*$', ''), '\.[^.]*$', '')), ''), 'untitled'), 1, 100) AS name, true AS color_ok, 'V' || (page_id + 1) AS label FROM pages"),
    "history": (history, "SELECT o_orderkey, total, unresolved, confirmed, ignored FROM orders JOIN (SELECT l_orderkey, count(*) AS total, count(*) FILTER (l_returnflag NOT IN ('R', 'A')) AS unresolved, count(*) FILTER (l_returnflag = 'R') AS confirmed, count(*) FILTER (l_returnflag = 'A') AS ignored FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 100"),
    "group_labels": (group_labels, "SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) ELSE 'Partial' END AS label FROM lineitem GROUP BY 1"),
}

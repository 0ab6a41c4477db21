"""Queries of the comparison store, baseline choices, preview and display, and the SQL that must agree.

In the relational tables customers stand for projects, their orders for versions of a
contract, suppliers for templates and parts for versions of templates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions.diff import SPANS, diff_spans
from docweave.operators import display, history, preview, review
from docweave.plans import versions as v
from docweave.plans.compare_queries import LINES, PAIRS
from docweave.sources import docx, docx_build
from docweave.storage import stored


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Comparisons of documents


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of all version pairs as snapshots parsed from Word packages, each document of a pair parsed once."""
    docs = v.documents(spark, sf_dir)
    pairs = v.stored_pairs(docs)
    docs = docs.join(v.roles(pairs).select("doc_id"), "doc_id", "left_semi")
    parsed = docx.parse_files(docx_build.packages(docs, "doc_id", "text").withColumn("package", docx.sniff()), docx.COMPARED)
    parsed = stored(parsed.select(F.col("path").cast("long").alias("doc_id"), "paragraphs", "tables", "revisions", "comments"), "snapshots")
    side = lambda c: pairs.select("pair", F.col(c).alias("doc_id")).join(parsed, "doc_id").drop("doc_id")
    return side("base_doc"), side("cur_doc")


def comparison_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change item of the whole comparison of all version pairs, in order."""
    items = v.compare_snapshots(*_snapshots(spark, sf_dir)).changes
    return v.order_items(items.select("pair", "change_id", "kind", "b_node", "c_node", F.size("spans").alias("n_spans"), "confidence"))


def saved_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All version pairs compared, saved to the shared folder and loaded back from there."""
    docs = v.documents(spark, sf_dir).where("text is not null")
    pairs = v.stored_pairs(docs)
    found = v.compare(*v.stored_sides(spark, sf_dir, pairs))
    sha = F.sha2(F.col("text").cast("binary"), 256)
    file = F.struct(F.concat(F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("name"), F.octet_length("text").cast("long").alias("size"), F.lit(None).cast("string").alias("modified"), sha.alias("sha256"))
    side = lambda s, d: docs.select(F.col("doc_id").alias(d), file.alias(f"{s}_file"), F.col("text").cast("binary").alias(f"{s}_snapshot"), sha.alias(f"{s}_sha256"))
    inputs = pairs.join(side("b", "base_doc"), "base_doc").join(side("c", "cur_doc"), "cur_doc").withColumns({"algorithm": F.lit("1"), "created": F.timestamp_micros(F.lit(0))}).drop("base_doc", "cur_doc")
    made = history.save(stored(inputs, "inputs"), found.changes, "all")
    saved = history.Saved(*(stored(df, name) for name, df in vars(made).items()))
    loaded, _ = history.load(saved)
    same = F.lower("b_file.sha256") == F.lower("c_file.sha256")
    return loaded.select("pair", F.col("b_file.name").alias("b_name"), F.col("c_file.name").alias("c_name"), F.col("b_sha256").alias("b_digest"), F.sha2("c_snapshot", 256).alias("c_digest"), same.alias("same_content"), (~same & (F.size("result.changes") == 0)).alias("unexplained"))


SAVED_SQL = f"""WITH {PAIRS}
SELECT pair, base_doc || '.docx' AS b_name, cur_doc || '.docx' AS c_name, sha256(b.text) AS b_digest, sha256(c.text) AS c_digest, b.text = c.text AS same_content,
  b.text <> c.text AND (SELECT list(norm ORDER BY idx) FROM lines WHERE lines.doc_id = base_doc) = (SELECT list(norm ORDER BY idx) FROM lines WHERE lines.doc_id = cur_doc) AS unexplained
FROM pairs JOIN documents b ON b.doc_id = base_doc JOIN documents c ON c.doc_id = cur_doc"""


#: What ``preview.blocks`` reads here of a snapshot, whose paragraphs have no formats.
_SHOWN = "struct<node:string,idx:int,source:int,text:string,format:struct<alignment:string>,runs:array<struct<node:string,text:string>>>"
PREVIEWED = f"path string, paragraphs array<{_SHOWN}>, tables array<struct<node:string,table:int,source:int,cells:array<struct<row:int,col:int,node:string,text:string,format:struct<grid_span:int>,paragraphs:array<{_SHOWN}>>>>>"


def preview_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of every document's preview with their labels, and the texts beside each."""
    parsed = docx.parse_files(docx_build.packages(v.documents(spark, sf_dir), "doc_id", "text").withColumn("package", docx.sniff()), PREVIEWED)
    shown = preview.blocks(parsed.select(F.col("path").cast("long").alias("doc_id"), "paragraphs", "tables"), "doc_id")
    text = F.get("cells", F.lit(0))["text"]
    near = review.context(shown.withColumn("text", text), ["doc_id"], "position", "text")
    return near.select("doc_id", "position", "label", "is_table", F.md5(F.array_join("context", "\x1f").cast("binary")).alias("around"))


BLOCKS_SQL = rf"""WITH {LINES}
SELECT doc_id, idx AS position, '正文第 ' || (idx + 1) || ' 段' AS label, false AS is_table, md5(concat_ws(chr(31), lag(text) OVER w, text, lead(text) OVER w)) AS around
FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY idx)"""


def located_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of both sides of a version pair that the other lacks, with their places."""
    base, cur = v.stored_sides(spark, sf_dir)
    key = F.col("norm")
    left = base.select("pair", "node", "norm").join(cur.select("pair", "norm").distinct(), ["pair", "norm"], "left_anti")
    right = cur.select("pair", "node", "norm").join(base.select("pair", "norm").distinct(), ["pair", "norm"], "left_anti")
    none = F.lit(None).cast("string")
    items = left.select("pair", F.col("node").alias("b_node"), none.alias("c_node"), F.length(key).alias("chars")).unionByName(right.select("pair", none.alias("b_node"), F.col("node").alias("c_node"), F.length(key).alias("chars")))
    places = lambda df: df.select("pair", "node", display.paragraph_label(F.col("idx")).alias("location"))
    return display.with_locations(items, places(base), places(cur)).select("pair", "b_node", "c_node", "chars", "b_location", "c_location")


LOCATED_SQL = f"""WITH {PAIRS}
SELECT pair, 'body/p[' || idx || ']' AS b_node, NULL::VARCHAR AS c_node, length(norm)::INT AS chars, '正文第 ' || (idx + 1) || ' 段' AS b_location, '{display.NO_PLACE}' AS c_location FROM b0 WHERE NOT EXISTS (SELECT 1 FROM c0 WHERE c0.pair = b0.pair AND c0.norm = b0.norm)
UNION ALL SELECT pair, NULL, 'body/p[' || idx || ']', length(norm)::INT, '{display.NO_PLACE}', '正文第 ' || (idx + 1) || ' 段' FROM c0 WHERE NOT EXISTS (SELECT 1 FROM b0 WHERE b0.pair = c0.pair AND b0.norm = c0.norm)"""


# Spans and shown values


def clipped_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as spans of one cell, clipped to paragraphs of 20 characters joined by one separator."""
    x = _t(spark, sf_dir, "lineitem").withColumns({"start": (F.col("l_partkey") % 60).cast("int"), "n": (F.col("l_quantity") % 40).cast("int")})
    empty = F.lit("")
    span = F.struct(F.lit("Replace").alias("op"), F.col("start").alias("b_start"), F.col("n").alias("b_len"), F.lit(0).alias("c_start"), F.lit(0).alias("c_len"), empty.alias("old"), empty.alias("new"))
    rows = x.select("l_orderkey", "l_linenumber", "l_suppkey", F.array(span).cast(SPANS).alias("spans"), F.explode(F.array(*map(F.lit, range(5)))).alias("paragraph"))
    cut = rows.select("l_orderkey", "l_linenumber", "l_suppkey", "paragraph", F.explode(preview.clip(F.col("spans"), F.col("paragraph") * 21, F.lit(20), "b")).alias("s"))
    return cut.select("l_orderkey", "l_linenumber", "l_suppkey", "paragraph", "s.b_start", "s.b_len")


CLIP_SQL = """SELECT l_orderkey, l_linenumber, l_suppkey, paragraph, greatest(start, paragraph * 21) - paragraph * 21 AS b_start, least(start + n, paragraph * 21 + 20) - greatest(start, paragraph * 21) AS b_len
FROM (SELECT *, (l_partkey % 60)::INT AS start, floor(l_quantity % 40)::INT AS n FROM lineitem) CROSS JOIN (SELECT unnest(range(5))::INT AS paragraph)
WHERE greatest(start, paragraph * 21) < least(start + n, paragraph * 21 + 20)"""

_MARK = 5


def marked_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts with the range of their size marked, cut where the word of a format run ends."""
    name = F.col("p_name")
    part = _t(spark, sf_dir, "part").where("p_name is not null")
    empty = F.lit("")
    span = F.struct(F.lit("Replace").alias("op"), F.lit(0).alias("b_start"), F.lit(0).alias("b_len"), (F.col("p_size") % 7).alias("c_start"), F.lit(_MARK).alias("c_len"), empty.alias("old"), empty.alias("new"))
    first = F.substring_index(name, " ", 1)
    runs = F.array(F.struct(first.alias("text"), F.lit("first").alias("format")), F.struct(F.substring(name, F.length(first) + 1, F.length(name)).alias("text"), F.lit("rest").alias("format")))
    cut = preview.formatted(review.segments(name, F.array(span).cast(SPANS), "c"), runs, name)
    return part.select("p_partkey", F.posexplode(cut).alias("k", "s")).select("p_partkey", "k", "s.text", "s.format", "s.marked")


MARKED_SQL = f"""WITH p AS (SELECT p_partkey, p_name, length(p_name)::INT AS n, p_size % 7 AS a, length(string_split(p_name, ' ')[1])::INT AS w FROM part WHERE p_name IS NOT NULL),
q AS (SELECT *, a + {_MARK} <= n AS fits FROM p),
cuts AS (SELECT DISTINCT p_partkey, unnest(CASE WHEN fits THEN [0, a, a + {_MARK}, w, n] ELSE [0, w, n] END) AS pos FROM q),
pieces AS (SELECT p_partkey, pos, lead(pos) OVER (PARTITION BY p_partkey ORDER BY pos) AS till FROM cuts)
SELECT p_partkey, (row_number() OVER (PARTITION BY p_partkey ORDER BY pos) - 1)::INT AS k, substr(p_name, pos + 1, till - pos) AS text, CASE WHEN pos < w THEN 'first' ELSE 'rest' END AS format,
  fits AND pos >= a AND pos < a + {_MARK} AS marked FROM pieces JOIN q USING (p_partkey) WHERE till IS NOT NULL"""


def marks_beyond_bmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts behind characters of two UTF-16 units, one word replaced: the differences and what they mark."""
    part = _t(spark, sf_dir, "part").where("p_name is not null")
    lead = F.expr("repeat('😀', p_size % 4) || repeat('𝄞x', p_size % 3)")
    text = lambda word: F.concat(lead, F.lit(word + " "), "p_name")
    rows = part.select("p_partkey", text("7").alias("old"), text("8").alias("new")).withColumn("spans", diff_spans("old", "new"))
    marked = rows.select("p_partkey", F.col("spans")[0]["c_start"].alias("c_start"), F.posexplode(review.segments(F.col("new"), F.col("spans"), "c")).alias("k", "s"))
    return marked.select("p_partkey", "c_start", "k", "s.text", "s.marked")


BEYOND_SQL = """WITH p AS (SELECT p_partkey, p_name, repeat('😀', p_size % 4) || repeat('𝄞x', p_size % 3) AS ahead, (2 * (p_size % 4) + 3 * (p_size % 3))::INT AS c_start FROM part WHERE p_name IS NOT NULL),
pieces AS (SELECT p_partkey, c_start, 0 AS place, ahead AS text, false AS marked FROM p UNION ALL SELECT p_partkey, c_start, 1, '8', true FROM p UNION ALL SELECT p_partkey, c_start, 2, ' ' || p_name, false FROM p)
SELECT p_partkey, c_start, (row_number() OVER (PARTITION BY p_partkey ORDER BY place) - 1)::INT AS k, text, marked FROM pieces WHERE text <> ''"""


def shown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of parts as half points and their types as values, with names of properties and short texts."""
    part = _t(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 3 == 0, "FontSizeHalfPoints").when(F.col("p_partkey") % 3 == 1, "Alignment").otherwise(F.col("p_brand"))
    value = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).when(F.col("p_partkey") % 6 == 1, "both").when(F.col("p_partkey") % 6 == 4, "<null>").otherwise(F.col("p_type"))
    return part.select("p_partkey", display.property_name(name).alias("property"), display.value_text(name, value).alias("value"), display.short(F.repeat(F.col("p_type"), F.col("p_size") % 9)).alias("short"))


VALUES_SQL = f"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '字号' WHEN 1 THEN '对齐' ELSE '其他格式（' || p_brand || '）' END AS property,
  CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_size % 2 = 0 THEN (p_size // 2)::VARCHAR ELSE (p_size // 2)::VARCHAR || '.5' END || ' 磅' WHEN p_partkey % 6 = 1 THEN '两端对齐' WHEN p_partkey % 6 = 4 THEN '{display.NO_VALUE}' ELSE p_type END AS value,
  CASE WHEN length(t) = 0 THEN '{display.NO_TEXT}' WHEN length(t) > {display.SHORT} THEN substr(t, 1, {display.SHORT}) || '…' ELSE t END AS short
FROM (SELECT *, repeat(p_type, p_size % 9) AS t FROM part)"""


# Projects and their baselines


def _projects(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = lambda n: _t(spark, sf_dir, n)
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    role = F.when(F.col("o_orderstatus") == "O", "Own").when(F.col("o_orderstatus") == "F", "Counterparty").otherwise("Unspecified")
    orders = stored(t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"), role.alias("role"), (F.year("o_orderdate") - 1990).alias("round_number"), place.alias("version_number"), F.concat("o_orderpriority", F.lit(".docx")).alias("file_name")), "versions")
    own = orders.groupBy("project_id").agg(F.max_by(F.when(F.col("role") == "Own", F.col("id")), F.when(F.col("role") == "Own", F.col("version_number"))).alias("baseline_version_id"), F.max_by("id", "version_number").alias("current_id"))
    bound = F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 60 + 1)
    last = F.when(F.col("c_custkey") % 4 == 0, "Own")
    rows = t("customer").join(own, F.col("c_custkey") == F.col("project_id"))
    projects = rows.select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") >= 0, "Active").otherwise("Archived").alias("status"), F.when(F.col("c_custkey") % 2 == 0, F.col("baseline_version_id")).alias("baseline_version_id"), bound.alias("bound_template_id"), last.alias("last_type"), F.lit(0).alias("updated"), "current_id")
    templates = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_acctbal") > 0).alias("is_enabled"), (F.col("s_nationkey") == 3).alias("is_deleted"))
    first = F.row_number().over(Window.partitionBy(F.col("p_partkey") % 100).orderBy("p_partkey")) == 1
    parts = t("part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 100 + 1).alias("template_id"), F.col("p_brand").alias("version"), first.alias("is_current"), F.when(F.col("p_size") % 7 == 0, "Partial").otherwise("Complete").alias("parse_status"))
    return {"asked": projects.select(F.col("id").alias("project_id"), "current_id"), "projects": projects, "versions": orders, "templates": templates, "template_versions": parts}


PROJECTS_SQL = """v AS (SELECT o_orderkey AS id, o_custkey AS project_id, CASE o_orderstatus WHEN 'O' THEN 'Own' WHEN 'F' THEN 'Counterparty' ELSE 'Unspecified' END AS role, year(o_orderdate) - 1990 AS round_number,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version_number, o_orderpriority || '.docx' AS file_name FROM orders),
latest AS (SELECT project_id, arg_max(id, version_number) FILTER (role = 'Own') AS own, arg_max(id, version_number) AS current_id FROM v GROUP BY 1),
p AS (SELECT c_custkey AS project_id, current_id, c_acctbal >= 0 AS active, CASE WHEN c_custkey % 2 = 0 THEN own END AS baseline, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 60 + 1 END AS bound, CASE WHEN c_custkey % 4 = 0 THEN 'Own' END AS last_type FROM customer JOIN latest ON project_id = c_custkey),
t AS (SELECT s_suppkey AS id, s_name AS name, s_acctbal > 0 AND s_nationkey <> 3 AS in_use FROM supplier),
tv AS (SELECT p_partkey AS id, p_partkey % 100 + 1 AS template_id, p_brand AS version, row_number() OVER (PARTITION BY p_partkey % 100 ORDER BY p_partkey) = 1 AS is_current, p_size % 7 <> 0 AS whole FROM part),
usable AS (SELECT template_id, bool_or(is_current AND whole) AS whole FROM tv GROUP BY 1),
options AS (
  SELECT p.project_id, current_id, 'Own' AS type, v.id AS version_id, '我方 · 第 ' || round_number || ' 轮 · ' || file_name AS name, true AS is_current, NULL::BIGINT AS n FROM p JOIN v ON v.id = baseline
  UNION ALL SELECT project_id, current_id, 'Template', tv.id, '模板 · ' || t.name || ' · ' || version || CASE WHEN is_current THEN '（当前）' ELSE '（历史）' END, in_use AND usable.whole AND is_current, NULL FROM p JOIN t ON t.id = bound JOIN tv ON tv.template_id = bound JOIN usable ON usable.template_id = bound
  UNION ALL SELECT * FROM (SELECT p.project_id, current_id, 'Version', v.id, 'V' || version_number || ' · ' || file_name, false, version_number FROM p JOIN v ON v.project_id = p.project_id AND v.id <> current_id QUALIFY row_number() OVER (PARTITION BY p.project_id ORDER BY version_number DESC) <= 100))"""


def baseline_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the newest version of every project can be compared with."""
    return history.choices(**_projects(spark, sf_dir))[0]


def baseline_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendation, warning and the default choice of every project."""
    made = _projects(spark, sf_dir)
    options, _ = history.choices(**made, foremost=True)
    return history.advice(made["asked"], options, *(made[n] for n in ("projects", "versions", "templates", "template_versions")))


ADVICE_SQL = f"""WITH {PROJECTS_SQL},
ranked AS (SELECT o.*, CASE WHEN bound IS NOT NULL THEN CASE WHEN type = 'Template' AND is_current THEN 0 END WHEN type = last_type AND is_current THEN 0 WHEN is_current THEN CASE type WHEN 'Own' THEN 1 ELSE 2 END WHEN type = 'Version' THEN 3 END AS fit FROM options o JOIN p USING (project_id)),
best AS (SELECT * FROM ranked WHERE fit IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY fit, n DESC, version_id) = 1)
SELECT p.project_id, p.current_id, CASE WHEN v.role = 'Counterparty' AND baseline IS NOT NULL THEN '{history.COUNTERPARTY_ADVICE}' WHEN EXISTS (SELECT 1 FROM options o WHERE o.project_id = p.project_id AND o.type = 'Version') THEN '{history.VERSION_ADVICE}' ELSE '{history.NO_ADVICE}' END AS recommendation,
  CASE WHEN bound IS NULL OR (coalesce(in_use, false) AND coalesce(usable.whole, false)) THEN NULL WHEN NOT coalesce(in_use, false) THEN '{history.DISABLED_TEMPLATE}' ELSE '{history.NO_TEMPLATE_VERSION}' END AS warning,
  bound IS NOT NULL AS has_bound_template, best.type AS default_type, best.version_id AS default_version
FROM p JOIN v ON v.id = p.current_id LEFT JOIN t ON t.id = bound LEFT JOIN usable ON usable.template_id = bound LEFT JOIN best ON best.project_id = p.project_id"""


def rematched_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each project selects some part as the template version to compare with; parts of templates out of use are refused."""
    made = _projects(spark, sf_dir)
    picks = made["asked"].select("project_id", "current_id", F.lit("Template").alias("type"), (F.col("project_id") * 7 % 2000).alias("version_id"))
    options, _ = history.choices(**made, wanted=picks)
    return history.resolve(picks, options, made["templates"], made["template_versions"])[0].select("project_id", "version_id", "name")


REMATCH_SQL = f"""WITH {PROJECTS_SQL},
picks AS (SELECT project_id, project_id * 7 % 2000 AS version_id FROM p)
SELECT k.project_id, k.version_id, coalesce(o.name, '模板 · ' || t.name || ' · ' || version) AS name FROM picks k LEFT JOIN options o ON o.project_id = k.project_id AND o.version_id = k.version_id AND o.type = 'Template'
LEFT JOIN tv ON tv.id = k.version_id LEFT JOIN t ON t.id = tv.template_id AND in_use WHERE coalesce(o.name, t.name) IS NOT NULL"""


def baselines_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every project asks for its newest version as its baseline."""
    made = _projects(spark, sf_dir)
    wanted = made["asked"].withColumnRenamed("current_id", "version_id")
    return history.set_baseline(made["projects"], made["versions"], wanted, F.lit(1))[0].select("id", "baseline_version_id", "updated")


SET_SQL = f"""WITH {PROJECTS_SQL} SELECT p.project_id AS id, CASE WHEN active AND role = 'Own' THEN current_id ELSE baseline END AS baseline_version_id, CASE WHEN active AND role = 'Own' THEN 1 ELSE 0 END AS updated FROM p JOIN v ON v.id = current_id"""


def pending_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in progress of every customer."""
    orders = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("status"))
    return history.pending_counts(_t(spark, sf_dir, "customer"), "c_custkey", orders, "P")


def unequal_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose open orders have other priorities than their finished ones."""
    orders = _t(spark, sf_dir, "orders")
    of = lambda s: orders.where(F.col("o_orderstatus") == s)
    return history.unequal_sets(of("O"), of("F"), "o_custkey", "o_orderpriority")


UNEQUAL_SQL = """SELECT o_custkey FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY 1
HAVING list_sort(coalesce(list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'O'), [])) IS DISTINCT FROM list_sort(coalesce(list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F'), []))"""


def input_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two documents of every version pair checked again before a comparison."""
    docs = v.documents(spark, sf_dir)
    pairs = v.version_pairs(v.paragraphs(docs))
    side = lambda s, d: docs.select(F.col("doc_id").alias(d), F.struct(F.col("source").alias("path"), F.md5(F.col("text").cast("binary")).alias("sha256")).alias(s), F.struct(F.md5(F.col("text").cast("binary")).alias("sha256")).alias(f"{s}_chosen"))
    return display.input_flags(pairs.join(side("b", "base_doc"), "base_doc").join(side("c", "cur_doc"), "cur_doc")).select("pair", "same_path", "same_content", "changed")


INPUT_SQL = f"WITH {PAIRS} SELECT pair, b.source IS NOT DISTINCT FROM c.source AS same_path, b.text = c.text AS same_content, false AS changed FROM pairs JOIN documents b ON b.doc_id = base_doc JOIN documents c ON c.doc_id = cur_doc"

QUERIES = {
    "comparison_items": (comparison_items, None),
    "saved_comparisons": (saved_comparisons, SAVED_SQL),
    "preview_blocks": (preview_blocks, BLOCKS_SQL),
    "located_paragraphs": (located_paragraphs, LOCATED_SQL),
    "clipped_spans": (clipped_spans, CLIP_SQL),
    "marked_segments": (marked_segments, MARKED_SQL),
    "marks_beyond_bmp": (marks_beyond_bmp, BEYOND_SQL),
    "shown_values": (shown_values, VALUES_SQL),
    "baseline_choices": (baseline_choices, f"WITH {PROJECTS_SQL} SELECT * EXCLUDE (n) FROM options"),
    "baseline_advice": (baseline_advice, ADVICE_SQL),
    "rematched_baselines": (rematched_baselines, REMATCH_SQL),
    "baselines_set": (baselines_set, SET_SQL),
    "pending_operations": (pending_operations, "SELECT c_custkey, count(o_orderkey) AS pending FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1"),
    "unequal_customers": (unequal_customers, UNEQUAL_SQL),
    "input_checks": (input_checks, INPUT_SQL),
}

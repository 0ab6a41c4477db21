"""Store of comparisons and the choices of a project's baseline.

Everything works on tables of many comparisons or projects at once. Ids are derived from
the batch and the pair, so a step that runs again makes the same rows. What breaks a rule
is returned as refused rows with a reason, never dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions.diff import SPANS
from docweave.operators.changes import FORMAT
from docweave.sources import snapshots
from docweave.sources.snapshots import RESULT_VERSION

RECORD_VERSION = 1
RESULT_FIELD = "comparisonSchemaVersion"
ITEM = f"struct<change_id:string,kind:string,b_node:string,c_node:string,b_text:string,c_text:string,spans:{SPANS},format:{FORMAT},revision_ids:array<string>,comment_ids:array<string>,evidence:array<string>,confidence:string,codes:array<string>>"
RESULT = f"{RESULT_FIELD} int, metadata struct<baselineSnapshotId:string,currentSnapshotId:string,algorithmVersion:string>, changes array<{ITEM}>"
# Names of projects, options offered, labels.
UNNAMED, MOST_NAME, MOST_OPTIONS = "未命名合同", 100, 100
#: Projects and versions of one template that meet in one cell of their product, about.
CELL = 1_000
COUNTERPARTY_ADVICE, VERSION_ADVICE, NO_ADVICE = "建议与当前我方基准比较，不与上一版对方版本比较。", "可与已有项目版本比较；基准文件不代表我方角色。", "请明确选择基准版本。"
DISABLED_TEMPLATE, NO_TEMPLATE_VERSION = "已绑定模板已停用；请选择其他基准，未自动切换。", "已绑定模板无可用的完整当前版本；请选择其他基准，未自动切换。"


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def by_id(spark: SparkSession, path: str, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows of a table whose key is among the given ids."""
    return spark.read.parquet(path).join(ids.select(key).distinct(), key, "left_semi")


def unequal_sets(left: DataFrame, right: DataFrame, group: str, member: str) -> DataFrame:
    """The groups whose sets of members differ between the two tables."""
    one = lambda df, name: df.select(group, member).distinct().withColumn(name, F.lit(True))
    return one(left, "_l").join(one(right, "_r"), [group, member], "full_outer").where("_l is null or _r is null").select(group).distinct()


def encode_results(changes: DataFrame, inputs: DataFrame) -> DataFrame:
    """pair, payload: the result of each pair of ``inputs`` (pair, b_sha256, c_sha256, algorithm) as versioned JSON, items by id."""
    fields = [f.split(":")[0] for f in ("change_id", "kind", "b_node", "c_node", "b_text", "c_text", "spans", "format", "revision_ids", "comment_ids", "evidence", "confidence", "codes")]
    grouped = changes.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("change_id", F.struct(*fields).alias("item")))).alias("found"))
    rows = inputs.select("pair", "b_sha256", "c_sha256", "algorithm").join(grouped, "pair", "left")
    items = F.coalesce(F.transform("found", lambda x: x["item"]), F.array().cast(f"array<{ITEM}>"))
    name = lambda s: F.concat(F.lit("sha256:"), f"{s}_sha256")
    meta = F.struct(name("b").alias("baselineSnapshotId"), name("c").alias("currentSnapshotId"), F.col("algorithm").alias("algorithmVersion"))
    return rows.select("pair", F.to_json(F.struct(F.lit(RESULT_VERSION).alias(RESULT_FIELD), meta.alias("metadata"), items.alias("changes")), {"ignoreNullFields": "false"}).cast("binary").alias("payload"))


def decode_results(df: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows, refused): results of exactly the known version as struct ``s``."""
    return snapshots.decode(df, RESULT, RESULT_FIELD, RESULT_VERSION, key)


@dataclass
class Saved:
    snapshots: DataFrame
    results: DataFrame
    records: DataFrame
    states: DataFrame
    refused: DataFrame


def _id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def save(inputs: DataFrame, changes: DataFrame, batch: str) -> Saved:
    """The rows that keep comparisons: two snapshots, a result and a record each, every change unresolved.

    ``inputs``: pair, b_file and c_file (path, name, size, modified, sha256), b_snapshot and
    c_snapshot (payloads), b_sha256 and c_sha256 (as parsed), algorithm, created. A file
    whose hash is not the parsed one is refused; comparisons without changes are kept.
    """
    name = lambda role: _id(F.lit(batch), F.col("pair").cast("string"), F.lit(role))
    same = F.col("b_file.sha256").eqNullSafe(F.col("b_sha256")) & F.col("c_file.sha256").eqNullSafe(F.col("c_sha256"))
    refused = inputs.where(~same).select("pair", F.lit("InputIdentityChanged").alias("reason"))
    own = inputs.where(same).withColumns({"record_id": name("record"), "b_id": name("baseline"), "c_id": name("current"), "result_id": name("result")})
    kept = lambda s: own.select(F.col(f"{s}_id").alias("id"), F.col(f"{s}_sha256").alias("sha256"), F.col(f"{s}_snapshot").alias("payload"), "created")
    results = own.select("pair", F.col("result_id").alias("id"), "b_sha256", "c_sha256", "algorithm", "created").join(encode_results(changes.join(own.select("pair"), "pair", "left_semi"), own), "pair")
    records = own.select("record_id", "pair", F.lit(RECORD_VERSION).alias("version"), "b_file", "c_file", "b_id", "c_id", "result_id", "created")
    states = changes.join(own.select("pair", "record_id"), "pair").select("record_id", "pair", "change_id", F.lit("Unresolved").alias("state"), F.lit(0).cast("long").alias("seq"))
    return Saved(kept("b").unionByName(kept("c")), results.drop("pair"), records, states, refused)


def load(saved: Saved, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(comparisons, refused) of the records, all or those of the given record ids.

    A record is refused whose version is unknown, whose snapshots or result are missing,
    refused by their codec or of other content, or whose states are not those of its changes.
    """
    records = saved.records if ids is None else saved.records.join(ids.select("record_id"), "record_id", "left_semi")
    read, _ = decode_results(saved.results)
    results = read.select(F.col("id").alias("result_id"), F.col("s").alias("result"))
    side = lambda s: saved.snapshots.select(F.col("id").alias(f"{s}_id"), F.col("sha256").alias(f"{s}_sha256"), F.col("payload").alias(f"{s}_snapshot"))
    rows = records.join(side("b"), "b_id", "left").join(side("c"), "c_id", "left").join(results, "result_id", "left")
    items = rows.select("record_id", F.explode("result.changes").alias("x")).select("record_id", F.col("x.change_id").alias("change_id"))
    odd = unequal_sets(items, saved.states.join(records.select("record_id"), "record_id", "left_semi"), "record_id", "change_id").withColumn("odd", F.lit(True))
    frozen = lambda s, field: F.col(f"{s}_file.sha256").eqNullSafe(F.col(f"{s}_sha256")) & F.col(f"result.metadata.{field}").eqNullSafe(F.concat(F.lit("sha256:"), f"{s}_sha256"))
    sound = frozen("b", "baselineSnapshotId") & frozen("c", "currentSnapshotId")
    reason = F.when(F.col("version") != RECORD_VERSION, "UnsupportedVersion").when(F.col("b_sha256").isNull(), "MissingBaseline").when(F.col("c_sha256").isNull(), "MissingCurrent").when(F.col("result").isNull(), "MissingResult").when(~sound | F.col("odd"), "InconsistentHistory")
    judged = rows.join(odd, "record_id", "left").withColumn("reason", reason).drop("odd")
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null").select("record_id", "reason")


def automatic_projects(records: DataFrame, states: DataFrame, chosen: DataFrame, template_versions: DataFrame, templates: DataFrame) -> dict[str, DataFrame]:
    """projects, rounds, versions, links and refused: a project of its own for each record.

    ``chosen``: record_id, template_id, template_version_id, snapshot_id of records whose
    baseline is a template; that version must still be there with the file's hash and its
    template be in use, else the record is refused. Equal files make one version, else two.
    """
    usable = template_versions.select(F.col("id").alias("template_version_id"), "template_id", "snapshot_id", F.col("sha256").alias("template_sha")).join(templates.where("is_enabled and not is_deleted").select(F.col("id").alias("template_id"), F.col("name").alias("template_name")), "template_id")
    asked = chosen.withColumn("asked", F.lit(True))
    keys = ["template_id", "template_version_id", "snapshot_id"]
    rows = records.join(asked, "record_id", "left").join(usable, keys, "left")
    good = F.col("asked").isNull() | F.coalesce(F.col("template_sha") == F.col("b_file.sha256"), F.lit(False))
    refused = rows.where(~good).select("record_id", F.lit("TemplateChanged").alias("reason"))
    rows = rows.where(good).withColumn("same", F.lower("b_file.sha256") == F.lower("c_file.sha256"))
    title = F.trim(F.coalesce("template_name", F.regexp_replace("b_file.name", "\\.[^.]*$", "")))
    rows = rows.withColumns({
        "project_id": _id(F.col("record_id"), F.lit("project")), "v1": _id(F.col("record_id"), F.lit("v1")), "v2": _id(F.col("record_id"), F.lit("v2")),
        "project_name": F.when(title == "", UNNAMED).otherwise(F.substring(title, 1, MOST_NAME)),
    })
    rows = rows.withColumn("current", F.when(F.col("same"), F.col("v1")).otherwise(F.col("v2")))
    projects = rows.select(F.col("project_id").alias("id"), "project_name", F.lit("Active").alias("status"), F.when(F.col("same"), 2).otherwise(3).alias("next_number"), F.col("template_id").alias("bound_template_id"), F.col("template_version_id").alias("bound_version_id"), "created")
    rounds = rows.select(_id(F.col("record_id"), F.lit("round")).alias("id"), "project_id", F.lit(1).alias("number"))
    version = lambda s, id_, n: F.struct(F.col(id_).alias("id"), F.col(f"{s}_file").alias("file"), F.col(f"{s}_id").alias("snapshot_id"), F.lit(n).alias("version_number"))
    made = F.when(F.col("same"), F.array(version("b", "v1", 1))).otherwise(F.array(version("b", "v1", 1), version("c", "v2", 2)))
    versions = rows.select("project_id", F.explode(made).alias("v")).select("v.*", "project_id", F.lit("Unspecified").alias("role"), F.lit(1).alias("round_number"))
    totals = states.groupBy("record_id").agg(F.count_distinct("change_id").alias("total_changes"))
    links = rows.join(totals, "record_id", "left").select(
        "record_id", "project_id", F.col("current").alias("current_version_id"), F.when(F.col("asked"), "Template").otherwise("Version").alias("baseline_type"),
        F.coalesce("template_version_id", "v1").alias("baseline_version_id"), F.col("b_file.name").alias("baseline_name"), F.col("c_file.name").alias("current_name"), F.coalesce("total_changes", F.lit(0)).alias("total_changes"),
    )
    return {"projects": projects, "rounds": rounds, "versions": versions, "links": links, "refused": refused}


def set_baseline(projects: DataFrame, versions: DataFrame, wanted: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(projects, refused): ``wanted`` (project_id, version_id) becomes the baseline where it is an own version of an active project."""
    asked = wanted.join(projects.select(F.col("id").alias("project_id"), "status"), "project_id", "left").join(versions.select(F.col("id").alias("version_id"), F.col("project_id").alias("_owner"), "role"), "version_id", "left")
    good = F.coalesce((F.col("status") == "Active") & (F.col("_owner") == F.col("project_id")) & (F.col("role") == "Own"), F.lit(False))
    taken = asked.where(good).select(F.col("project_id").alias("id"), F.col("version_id").alias("_new"))
    out = projects.join(taken, "id", "left").withColumns({"baseline_version_id": F.coalesce("_new", "baseline_version_id"), "updated": F.when(F.col("_new").isNotNull(), now).otherwise(F.col("updated"))}).drop("_new")
    return out, asked.where(~good).select("project_id", "version_id", F.lit("NotAnOwnVersion").alias("reason"))


def _in_use(templates: DataFrame, template_versions: DataFrame) -> DataFrame:
    """bound_template_id, template_name, in_use, and ``usable``: in use, and its current version complete."""
    kept = templates.select(F.col("id").alias("bound_template_id"), F.col("name").alias("template_name"), (F.col("is_enabled") & ~F.col("is_deleted")).alias("in_use"))
    whole = template_versions.groupBy(F.col("template_id").alias("bound_template_id")).agg(F.bool_or(F.col("is_current") & (F.col("parse_status") == "Complete")).alias("whole"))
    return kept.join(whole, "bound_template_id", "left").withColumn("usable", F.col("in_use") & F.coalesce("whole", F.lit(False))).drop("whole")


def _each_with_each(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> DataFrame:
    """The inner join on a key that many rows of both sides share, dealt in cells of some CELL rows of each side."""
    cells = lambda df, name: df.groupBy(key).agg(F.ceil(F.count("*") / CELL).alias(name))
    sizes = cells(left, "_ln").join(cells(right, "_rn"), key)
    # Rows that meet are few and their product is not: adaptive execution would put all cells into a few tasks.
    spark = left.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    cell = lambda df, id_, own, other: df.join(sizes, key).select(*df.columns, F.pmod(F.xxhash64(id_), F.col(f"_{own}n")).alias(f"_{own}"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"_{other}n") - 1)).alias(f"_{other}"))
    dealt = lambda *side: cell(*side).repartition(parts, key, "_l", "_r")
    return dealt(left, left_id, "l", "r").join(dealt(right, right_id, "r", "l").hint("merge"), [key, "_l", "_r"]).drop("_l", "_r")


def choices(asked: DataFrame, projects: DataFrame, versions: DataFrame, templates: DataFrame, template_versions: DataFrame, wanted: DataFrame | None = None, foremost: bool = False) -> tuple[DataFrame, DataFrame]:
    """(options, refused) of ``asked`` (project_id, current_id): what a version can be compared with.

    Options: project_id, current_id, type, version_id, name, is_current. The project's own
    baseline, the versions of its bound template, and its newest other versions (100 at most
    are offered). Refused: a version of another project, a baseline that is not an own one.

    A template's versions are offered to each of its projects, which is the product of both.
    ``wanted`` (selections as in ``resolve``) leaves out versions of templates that are not
    selected; ``foremost`` leaves of each template the smallest current version if it is usable,
    and of other versions the newest, as ``advice`` looks at no more.
    """
    project = projects.select(F.col("id").alias("project_id"), "baseline_version_id", "bound_template_id")
    v = versions.select(F.col("id").alias("version_id"), F.col("project_id").alias("_owner"), "role", "round_number", "version_number", "file_name")
    rows = asked.join(project, "project_id").join(v.select(F.col("version_id").alias("current_id"), F.col("_owner").alias("_current_owner")), "current_id", "left")
    rows = rows.join(v.select(F.col("version_id").alias("baseline_version_id"), F.col("_owner").alias("_own_owner"), F.col("role").alias("_own_role"), F.col("round_number").alias("_own_round"), F.col("file_name").alias("_own_file")), "baseline_version_id", "left")
    foreign = ~F.coalesce(F.col("_current_owner") == F.col("project_id"), F.lit(False))
    wrong = F.col("baseline_version_id").isNotNull() & ~F.coalesce((F.col("_own_owner") == F.col("project_id")) & (F.col("_own_role") == "Own"), F.lit(False))
    rows = rows.withColumn("reason", F.when(foreign, "ForeignVersion").when(wrong, "InvalidBaseline"))
    refused, rows = rows.where("reason is not null").select("project_id", "current_id", "reason"), rows.where("reason is null")
    out = ["project_id", "current_id"]
    own = rows.where("baseline_version_id is not null").select(*out, F.lit("Own").alias("type"), F.col("baseline_version_id").alias("version_id"), F.concat(F.format_string("我方 · 第 %d 轮 · ", "_own_round"), "_own_file").alias("name"), F.lit(True).alias("is_current"))
    label = F.concat(F.lit("模板 · "), "template_name", F.lit(" · "), "version", F.when(F.col("is_current"), "（当前）").otherwise("（历史）"))
    # Named before they meet their projects, once each.
    named = template_versions.select(F.col("template_id").alias("bound_template_id"), F.col("id").alias("version_id"), "version", "is_current").where("version_id is not null").join(_in_use(templates, template_versions), "bound_template_id")
    named = named.select("bound_template_id", "version_id", label.alias("name"), (F.col("usable") & F.col("is_current")).alias("is_current"))
    bound = rows.where("bound_template_id is not null").select(*out, "bound_template_id")
    if foremost:
        first = named.where("is_current").groupBy("bound_template_id").agg(F.min(F.struct("version_id", "name", "is_current")).alias("v")).select("bound_template_id", "v.*")
        bound = bound.join(first, "bound_template_id")
    elif wanted is not None:
        bound = bound.join(wanted.where("type = 'Template'").select(*out, "version_id").distinct(), out).join(named, ["bound_template_id", "version_id"])
    else:
        bound = _each_with_each(bound, named, "bound_template_id", "project_id", "version_id")
    from_template = bound.select(*out, F.lit("Template").alias("type"), "version_id", "name", "is_current")
    # The newest 101 of a project hold the newest 100 others of any version in it: no project's versions meet more often than that.
    newest = v.withColumn("_k", F.row_number().over(Window.partitionBy("_owner").orderBy(F.desc("version_number")))).where(F.col("_k") <= MOST_OPTIONS + 1)
    others = rows.select(*out).join(newest.select(F.col("_owner").alias("project_id"), "version_id", "version_number", "file_name"), "project_id").where("version_id <> current_id")
    place = F.row_number().over(Window.partitionBy(*out).orderBy(F.desc("version_number")))
    if foremost:
        others = others.groupBy(*out).agg(F.min(F.struct((-F.coalesce("version_number", F.lit(0))).alias("_newest"), "version_id", "version_number", "file_name")).alias("v")).select(*out, "v.*")
    else:
        others = others.withColumn("_k", place).where(F.col("_k") <= MOST_OPTIONS)
    versioned = others.select(*out, F.lit("Version").alias("type"), "version_id", F.concat(F.format_string("V%d · ", "version_number"), "file_name").alias("name"), F.lit(False).alias("is_current"))
    return own.unionByName(from_template).unionByName(versioned), refused


def advice(asked: DataFrame, options: DataFrame, projects: DataFrame, versions: DataFrame, templates: DataFrame, template_versions: DataFrame) -> DataFrame:
    """project_id, current_id, recommendation, warning, has_bound_template and the option chosen by default (type, version), if any.

    The default is the bound template's current version; without a bound template the
    current option of the type used last, else any current one, else the newest version.
    """
    out = ["project_id", "current_id"]
    project = projects.select(F.col("id").alias("project_id"), "baseline_version_id", "bound_template_id", "last_type")
    rows = asked.join(project, "project_id").join(versions.select(F.col("id").alias("current_id"), "role"), "current_id")
    bound = rows.select(*out, "bound_template_id").join(_in_use(templates, template_versions), "bound_template_id").groupBy(*out).agg(F.bool_or("usable").alias("usable"), F.bool_or("in_use").alias("in_use"))
    ordinal = F.regexp_extract("name", "^V(\\d+) ", 1).try_cast("long")
    fit = F.when(F.col("bound_template_id").isNotNull(), F.when((F.col("type") == "Template") & F.col("is_current"), 0)).when((F.col("type") == F.col("last_type")) & F.col("is_current"), 0).when(F.col("is_current"), F.when(F.col("type") == "Own", 1).otherwise(2)).when(F.col("type") == "Version", 3)
    ranked = options.join(rows.select(*out, "bound_template_id", "last_type"), out).withColumn("fit", fit)
    best = ranked.groupBy(*out).agg(F.bool_or(F.col("type") == "Version").alias("has_versions"), F.min(F.when(F.col("fit").isNotNull(), F.struct("fit", (-F.coalesce(ordinal, F.lit(0))).alias("newest"), "type", "version_id"))).alias("best"))
    rows = rows.join(best, out, "left").join(bound, out, "left")
    text = F.when((F.col("role") == "Counterparty") & F.col("baseline_version_id").isNotNull(), COUNTERPARTY_ADVICE).when(F.col("has_versions"), VERSION_ADVICE).otherwise(NO_ADVICE)
    warning = F.when(F.col("bound_template_id").isNotNull() & ~F.coalesce("usable", F.lit(False)), F.when(~F.coalesce("in_use", F.lit(False)), DISABLED_TEMPLATE).otherwise(NO_TEMPLATE_VERSION))
    return rows.select(*out, text.alias("recommendation"), warning.alias("warning"), F.col("bound_template_id").isNotNull().alias("has_bound_template"), F.col("best.type").alias("default_type"), F.col("best.version_id").alias("default_version"))


def resolve(selections: DataFrame, options: DataFrame, templates: DataFrame, template_versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, refused) of selections (project_id, current_id, type, version_id).

    A selection is one of its options, or a version of any template in use (an explicit rematch).
    """
    keys = ["project_id", "current_id", "type", "version_id"]
    rows = selections.join(options.select(*keys, "name"), keys, "left")
    in_use = templates.where("is_enabled and not is_deleted").select(F.col("id").alias("template_id"), F.col("name").alias("_template"))
    other = template_versions.join(in_use, "template_id").select(F.lit("Template").alias("type"), F.col("id").alias("version_id"), F.concat(F.lit("模板 · "), "_template", F.lit(" · "), "version").alias("_rematch"))
    rows = rows.join(other, ["type", "version_id"], "left").withColumn("name", F.coalesce("name", "_rematch")).drop("_rematch")
    return rows.where("name is not null"), rows.where("name is null").select(*keys, F.lit("BaselineChanged").alias("reason"))


def save_in_projects(resolved: DataFrame, inputs: DataFrame, found: DataFrame, projects: DataFrame, saved: Saved, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, projects, refused) of comparisons made in projects; ``saved`` keeps the comparisons themselves.

    ``resolved``: project_id, current_id, type, version_id, name, pair. ``inputs`` are the
    comparisons' inputs, ``found`` (pair, b_sha256, c_sha256) the same files as looked up
    again. Refused: a project that is not active, or inputs that changed meanwhile.
    """
    again = found.select("pair", F.col("b_sha256").alias("_b"), F.col("c_sha256").alias("_c"))
    rows = resolved.join(projects.select(F.col("id").alias("project_id"), "status"), "project_id", "left").join(inputs.select("pair", F.col("b_file.sha256").alias("_bf"), F.col("c_file.sha256").alias("_cf")), "pair").join(again, "pair", "left")
    reason = F.when(~F.col("status").eqNullSafe(F.lit("Active")), "ProjectNotActive").when(~F.col("_b").eqNullSafe(F.col("_bf")) | ~F.col("_c").eqNullSafe(F.col("_cf")), "InputIdentityChanged")
    rows = rows.withColumn("reason", reason)
    totals = saved.states.groupBy("record_id").agg(F.count_distinct("change_id").alias("total_changes"))
    links = rows.where("reason is null").join(saved.records.select("pair", "record_id", "created", F.col("c_file.name").alias("current_name")), "pair").join(totals, "record_id", "left")
    links = links.select("record_id", "project_id", F.col("current_id").alias("current_version_id"), F.col("type").alias("baseline_type"), F.col("version_id").alias("baseline_version_id"), F.col("name").alias("baseline_name"), "current_name", F.coalesce("total_changes", F.lit(0)).alias("total_changes"), "created")
    last = links.groupBy(F.col("project_id").alias("id")).agg(F.max_by("baseline_type", F.struct("created", "record_id")).alias("_last"))
    out = projects.join(last, "id", "left").withColumns({"last_type": F.coalesce("_last", "last_type"), "updated": F.when(F.col("_last").isNotNull(), now).otherwise(F.col("updated"))}).drop("_last")
    return links, out, rows.where("reason is not null").select("project_id", "pair", "reason")


def of_key(df: DataFrame, key: str, value: object, order: list[Column], where: Column | None = None) -> DataFrame:
    """The rows of one key in order, such as a project's rounds, pending operations or unfinished cleanups."""
    rows = df.where(F.col(key) == F.lit(value))
    return (rows if where is None else rows.where(where)).orderBy(*order)


def pending_counts(owners: DataFrame, key: str, operations: DataFrame, status: str = "Prepared") -> DataFrame:
    """key, pending: the operations of that status of every owner, 0 where there is none."""
    counted = operations.where(F.col("status") == status).groupBy(key).agg(F.count("*").alias("pending"))
    return owners.select(key).join(counted, key, "left").fillna(0, ["pending"])

"""Audit of a whole store: named rules over its tables, one plan a table, one pass for all rules.

A rule holds for a row by its own columns (``Row``), or by rows of another table that it
names (``Refers``); lookups of the same table by the same columns are joined once, however
many rules ask. ``Alone`` and ``Prefix`` rules look at the rows of a key or of a short list
in their order. Every broken row is returned with its table, key and rule; the numbers of
rows looked at and broken come from observing the same pass, not from a job a rule.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from docweave.storage import stored


@dataclass(frozen=True)
class Row:
    """``holds`` is SQL over the row's columns; null counts as broken."""

    name: str
    holds: str


@dataclass(frozen=True)
class Refers:
    """Where ``when`` holds there must be a row of ``table`` whose ``keys`` are the row's ``columns``.

    ``holds`` may compare further: the other table's columns are written ``<table>.<column>``
    and must be named in ``reads``. Keys of the other table are unique.
    """

    name: str
    columns: tuple[str, ...]
    table: str
    keys: tuple[str, ...]
    when: str = "true"
    holds: str = "true"
    reads: tuple[str, ...] = ()


@dataclass(frozen=True)
class Alone:
    """Of the rows with one value of ``columns`` exactly one has ``which``; a broken group shows as its rows with the least key."""

    name: str
    columns: tuple[str, ...]
    which: str


@dataclass(frozen=True)
class Prefix:
    """The values of ``column`` in order are the first entries of a known list."""

    name: str
    column: str
    known: tuple[str, ...]


Rule = Row | Refers | Alone | Prefix
BROKEN = "table_name string, key string, rule string"


def _joined(df: DataFrame, tables: dict[str, DataFrame], rules: Sequence[Rule]) -> tuple[DataFrame, dict[str, str]]:
    """The table with one struct for each lookup of another table, null where nothing is found; and its name for each rule."""
    found: dict[tuple, str] = {}
    reads: dict[tuple, set[str]] = {}
    for r in rules:
        if isinstance(r, Refers):
            reads.setdefault((r.columns, r.table, r.keys), set()).update(r.reads)
    for n, (place, columns) in enumerate(sorted(reads.items())):
        own, table, keys = place
        name = f"_found{n}"
        other = tables[table].select(*(F.col(k).alias(f"_k{n}_{i}") for i, k in enumerate(keys)), F.struct(F.lit(True).alias("there"), *sorted(columns)).alias(name))
        df = df.join(other, [F.col(c) == F.col(f"_k{n}_{i}") for i, c in enumerate(own)], "left").drop(*(f"_k{n}_{i}" for i in range(len(keys))))
        found[place] = name
    return df, {r.name: found[r.columns, r.table, r.keys] for r in rules if isinstance(r, Refers)}


def _breaks(rule: Rule, lookup: dict[str, str], key: str) -> Column:
    """Whether a row breaks the rule."""
    sound = lambda c: F.coalesce(c, F.lit(False))
    if isinstance(rule, Row):
        return ~sound(F.expr(rule.holds))
    if isinstance(rule, Refers):
        at = lookup[rule.name]
        further = rule.holds.replace(f"{rule.table}.", f"{at}.")
        return sound(F.expr(rule.when)) & ~(F.col(at).isNotNull() & sound(F.expr(further)))
    if isinstance(rule, Alone):
        whole = Window.partitionBy(*rule.columns).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return (F.count_if(F.expr(rule.which)).over(whole) != 1) & (F.min(key).over(whole) == F.col(key))
    place = F.row_number().over(Window.orderBy(rule.column))  # a list of a few entries
    return ~sound(F.get(F.array(*map(F.lit, rule.known)), place - 1) == F.col(rule.column))


def audit(tables: dict[str, DataFrame], keys: dict[str, str], rules: dict[str, Sequence[Rule]]) -> tuple[DataFrame, DataFrame]:
    """(broken, counts): table_name, key, rule of every broken row; table_name, rule, n_rows and n_broken of every rule.

    ``keys`` names each table's key column, ``rules`` its rules, by names of their own. A
    table without rows breaks nothing. A table that is missing, or a column that a rule
    needs, raises before anything runs.
    """
    spark = next(iter(tables.values())).sparkSession
    broken, watched = None, {}
    for table, asked in rules.items():
        df, lookup = _joined(tables[table], tables, asked)
        flags = {r.name: _breaks(r, lookup, keys[table]) for r in asked}
        flagged = df.select(F.col(keys[table]).cast("string").alias("key"), *(c.alias(f"_rule{i}") for i, c in enumerate(flags.values())))
        watched[table] = Observation()
        flagged = flagged.observe(watched[table], F.count(F.lit(1)).alias("n_rows"), *(F.count_if(f"_rule{i}").alias(f"_rule{i}") for i in range(len(flags))))
        names = F.array_compact(F.array(*(F.when(F.col(f"_rule{i}"), F.lit(n)) for i, n in enumerate(flags))))
        rows = flagged.select(F.lit(table).alias("table_name"), "key", F.explode(names).alias("rule"))
        broken = rows if broken is None else broken.unionByName(rows)
    broken = stored(broken, "audit")
    seen = [(t, r.name, watched[t].get["n_rows"], watched[t].get[f"_rule{i}"]) for t, asked in rules.items() for i, r in enumerate(asked)]
    # A task that ran twice is observed twice: the rows written are the truth.
    written = {(r.table_name, r.rule): r.n for r in broken.groupBy("table_name", "rule").agg(F.count("*").alias("n")).collect()}  # a row for each rule
    doubled = {t for t, rule, _, n in seen if n != written.get((t, rule), 0)}
    again = {t: tables[t].count() for t in doubled}
    counts = [(t, rule, again.get(t, rows), written.get((t, rule), 0)) for t, rule, rows, _ in seen]
    return broken, spark.createDataFrame(counts, "table_name string, rule string, n_rows long, n_broken long")


def missing_columns(tables: dict[str, DataFrame], needed: dict[str, Sequence[str]]) -> list[tuple[str, str]]:
    """(table, column) of what a store must have and has not; a missing table lacks all its columns."""
    return [(t, c) for t, columns in needed.items() for c in columns if t not in tables or c not in tables[t].columns]


# --- rules of the store of projects -------------------------------------------------

# Domains and bounds of the store.
_STATUSES, _ROLES, _PARSED, _TYPES = "('Active', 'Archived', 'Recycled')", "('Own', 'Counterparty', 'Unspecified')", "('Complete', 'Partial', 'Failed')", "('Own', 'Template', 'Version')"
_KNOWN_SCHEMA, _DELETIONS, _OPERATIONS = 1, "('PendingCleanup', 'Completed', 'NeedsReview')", "('Prepared', 'Completed', 'Failed', 'Undone')"
_ABSOLUTE = "(path like '/%' or path rlike '^[A-Za-z]:[\\\\\\\\/]')"


def _hash(column: str) -> str:
    return f"{column} rlike '^[0-9a-fA-F]{{64}}$'"


def project_rules(migrations: Sequence[str]) -> dict[str, tuple[Rule, ...]]:
    """Every rule that a store of projects must keep, by table. ``migrations``: those known, in order."""
    same_snapshot = Refers("SnapshotIdentity", ("snapshot_id",), "snapshots", ("id",), holds="snapshots.sha256 <=> sha256", reads=("sha256",))
    return {
        "projects": (
            Row("ProjectName", "trim(name) <> ''"),
            Row("ProjectStatus", f"status in {_STATUSES}"),
            Row("NextNumber", "next_number >= 1"),
            Refers("VersionSequence", ("id",), "numbers", ("project_id",), when="highest_needed", holds="numbers.highest < next_number", reads=("highest",)),
            Refers("BaselineIdentity", ("baseline_version_id",), "versions", ("id",), when="baseline_version_id is not null", holds="versions.project_id = id and versions.role = 'Own'", reads=("project_id", "role")),
            Row("BindingWhole", "(bound_template_id is null) = (bound_version_id is null)"),
            Refers("BindingIdentity", ("bound_version_id",), "template_versions", ("id",), when="bound_version_id is not null and bound_template_id is not null", holds="template_versions.template_id = bound_template_id", reads=("template_id",)),
        ),
        "rounds": (Row("RoundNumber", "number >= 1"), Refers("RoundProject", ("project_id",), "projects", ("id",))),
        "versions": (
            Row("VersionHash", _hash("sha256")),
            Row("VersionPath", _ABSOLUTE),
            Row("VersionRole", f"role in {_ROLES}"),
            Row("VersionNumber", "version_number >= 1"),
            Refers("VersionProject", ("project_id",), "projects", ("id",)),
            Refers("VersionRound", ("project_id", "round_number"), "rounds", ("project_id", "number")),
            same_snapshot,
            Refers("DuplicateIdentity", ("duplicate_of",), "versions", ("id",), when="duplicate_of is not null", holds="versions.project_id = project_id and versions.sha256 = sha256", reads=("project_id", "sha256")),
        ),
        "comparisons": (
            Row("BaselineType", f"baseline_type in {_TYPES}"),
            Row("BaselineOnlyOne", "baseline_type in " + _TYPES + " and (own_id is not null) = (baseline_type = 'Own') and (template_version_id is not null) = (baseline_type = 'Template') and (version_id is not null) = (baseline_type = 'Version')"),
            Refers("CurrentIdentity", ("current_id",), "versions", ("id",), holds="versions.project_id = project_id and versions.snapshot_id = current_snapshot", reads=("project_id", "snapshot_id")),
            Refers("OwnBaseline", ("own_id",), "versions", ("id",), when="baseline_type = 'Own'", holds="versions.project_id = project_id and versions.role = 'Own' and versions.snapshot_id = baseline_snapshot", reads=("project_id", "role", "snapshot_id")),
            Refers("TemplateBaseline", ("template_version_id",), "template_versions", ("id",), when="baseline_type = 'Template'", holds="template_versions.snapshot_id = baseline_snapshot", reads=("snapshot_id",)),
            Refers("VersionBaseline", ("version_id",), "versions", ("id",), when="baseline_type = 'Version'", holds="versions.project_id = project_id and versions.snapshot_id = baseline_snapshot", reads=("project_id", "snapshot_id")),
        ),
        "template_versions": (same_snapshot, Row("TemplatePath", _ABSOLUTE), Row("TemplateParsed", f"parse_status in {_PARSED}"), Alone("OneCurrent", ("template_id",), "is_current")),
        "snapshots": (Row("SnapshotSchema", f"schema_version between 1 and {_KNOWN_SCHEMA}"), Row("SnapshotHash", _hash("sha256"))),
        "copies": (Refers("OperationChain", ("last_operation_id",), "operations", ("id",), holds="operations.version_id = version_id and operations.after = sha256", reads=("version_id", "after")),),
        "operations": (Row("OperationStatus", f"status in {_OPERATIONS}"), Refers("OperationVersion", ("version_id",), "versions", ("id",))),
        "deletions": (Row("DeletionStatus", f"status in {_DELETIONS}"), Row("DeletionPath", "not path like '/%' and not exists(split(path, '[/\\\\\\\\]'), p -> p in ('.', '..'))"), Row("DeletionHash", _hash("sha256"))),
        "migrations": (Prefix("KnownMigrations", "id", tuple(migrations)),),
    }


PROJECT_KEYS = dict.fromkeys(("projects", "versions", "template_versions", "snapshots", "operations", "deletions", "migrations"), "id") | {"rounds": "id", "comparisons": "record_id", "copies": "version_id"}


def audit_projects(tables: dict[str, DataFrame], migrations: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``audit`` of a store of projects by all its rules; the highest number of each project's versions is taken first."""
    numbers = tables["versions"].groupBy("project_id").agg(F.max("version_number").alias("highest"))
    # Projects without versions have no number to keep below.
    known = numbers.select(F.col("project_id").alias("id"), F.lit(True).alias("highest_needed"))
    projects = tables["projects"].join(known, "id", "left").withColumn("highest_needed", F.coalesce("highest_needed", F.lit(False)))
    return audit(tables | {"numbers": numbers, "projects": projects}, PROJECT_KEYS, project_rules(migrations))

"""Tables of a store that change together: rows are only added, a log names what each commit added.

A commit writes its rows as Parquet parts and then one entry in the log, by a rename that
fails where the entry is there already. Readers see what the log names, so a commit is
visible whole or not at all. A row replaces the earlier rows of its key, or ends it
(``_gone``); a snapshot is the newest row of each key up to some commit.

``transact`` builds a commit from the newest snapshot and publishes it as the next one; if
another commit came first it is built again from what that one left, three times at most.
What a request expects of the store is checked in that snapshot for all requests of a batch
at once; requests that it does not meet come back as refused rows with a reason.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: How often a commit is built before its author is told that the store is too busy.
ATTEMPTS = 3
_LOG = "version long, what string, parts array<struct<table:string,path:string,whole:boolean>>"


class Busy(RuntimeError):
    """Other commits came first each time."""


@dataclass
class Change:
    """Rows for tables, with ``_gone`` where rows of a key end, and the requests that were refused."""

    rows: dict[str, DataFrame]
    refused: DataFrame | None = None


@dataclass
class Committed:
    version: int
    attempts: int
    refused: DataFrame | None


class Snapshot:
    """The tables as of one commit."""

    def __init__(self, store: Store, version: int):
        self.store, self.version = store, version
        self.parts = store.parts(version)

    def __getitem__(self, table: str) -> DataFrame:
        """The rows there are, with ``_version``, the commit that wrote each."""
        schema, keys = self.store.tables[table]
        found = self.parts.get(table, [])
        reader = self.store.spark.read.schema(f"{schema}, _version long, _gone boolean")
        if not found:
            return self.store.spark.createDataFrame([], f"{schema}, _version long")
        rows = reader.parquet(*found)
        if len(found) > 1:  # the keys of one part differ
            rest = [c for c in rows.columns if c not in keys]
            rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_version").alias("_row")).select(*keys, "_row.*").select(*rows.columns)
        return rows.where("not _gone").drop("_gone")


class Store:
    """``tables``: name to (columns as DDL, key columns). ``folder`` may be on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, tuple[str, list[str]]]):
        self.spark, self.folder, self.tables = spark, folder.rstrip("/"), tables
        self._log = f"{self.folder}/log"
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._files = self._path(self._log).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self._log).toUri(), conf)
        self._options = jvm.org.apache.hadoop.fs.Options

    def _entry(self, version: int) -> str:
        return f"{self._log}/{version:020d}.json"

    def head(self) -> int:
        """The newest commit; 0 before the first."""
        if not self._files.exists(self._path(self._log)):
            return 0
        names = (s.getPath().getName() for s in self._files.listStatus(self._path(self._log)))
        return max((int(n[:20]) for n in names if n.endswith(".json") and n[:20].isdigit()), default=0)

    def log(self) -> DataFrame:
        """version, what and parts of every commit."""
        if not self.head():
            return self.spark.createDataFrame([], _LOG)
        return self.spark.read.schema(_LOG).json(f"{self._log}/*.json")

    def parts(self, version: int) -> dict[str, list[str]]:
        """The parts of each table as of a commit; those before a whole rewrite do not count."""
        found: dict[str, list[str]] = {}
        for entry in sorted(self.log().where(F.col("version") <= version).collect()):  # a row for each commit
            for part in entry.parts:
                found[part.table] = [*([] if part.whole else found.get(part.table, [])), f"{self.folder}/{part.path}"]
        return found

    def snapshot(self, version: int | None = None) -> Snapshot:
        head = self.head()
        if version is not None and not 0 <= version <= head:
            raise ValueError(f"there is no commit {version}")
        return Snapshot(self, head if version is None else version)

    def _write(self, rows: dict[str, DataFrame], version: int) -> list[dict]:
        parts, name = [], uuid.uuid4().hex
        for table, df in rows.items():
            columns = [*self.spark.createDataFrame([], self.tables[table][0]).columns]
            gone = F.coalesce(F.col("_gone"), F.lit(False)) if "_gone" in df.columns else F.lit(False)
            df.select(*columns, F.lit(version).cast("long").alias("_version"), gone.alias("_gone")).write.parquet(f"{self.folder}/parts/{name}/{table}")
            parts.append({"table": table, "path": f"parts/{name}/{table}", "whole": False})
        return parts

    def _publish(self, version: int, what: str, parts: list[dict]) -> bool:
        """Whether this became commit ``version``: the rename fails if there is one."""
        draft = self._path(f"{self._log}/draft-{uuid.uuid4().hex}")
        out = self._files.create(draft, False)
        out.write(bytearray(json.dumps({"version": version, "what": what, "parts": parts}).encode()))
        out.close()
        try:
            self._context.rename(draft, self._path(self._entry(version)), self.spark.sparkContext._gateway.new_array(self._options.Rename, 0))
        except Exception as lost:
            self._files.delete(draft, False)
            if not self._files.exists(self._path(self._entry(version))):
                raise lost
            return False
        return True

    def transact(self, build: Callable[[Snapshot], Change], what: str = "") -> Committed:
        """Publish what ``build`` makes of the newest snapshot. A change without tables publishes nothing."""
        for attempt in range(1, ATTEMPTS + 1):
            now = self.snapshot()
            change = build(now)
            if not change.rows:
                return Committed(now.version, attempt, change.refused)
            parts = self._write(change.rows, now.version + 1)
            if self._publish(now.version + 1, what, parts):
                return Committed(now.version + 1, attempt, change.refused)
        raise Busy(f"{what}: {ATTEMPTS} other commits came first")

    def compact(self, table: str) -> Committed:
        """One part instead of many: later readers of this commit on read it alone."""
        now = self.snapshot()
        name = uuid.uuid4().hex
        rows = now[table].withColumn("_gone", F.lit(False))
        rows.write.parquet(f"{self.folder}/parts/{name}/{table}")
        if not self._publish(now.version + 1, f"compact {table}", [{"table": table, "path": f"parts/{name}/{table}", "whole": True}]):
            raise Busy(f"compact {table}: another commit came first")
        return Committed(now.version + 1, 1, None)

    def sweep(self) -> int:
        """Remove the parts that no commit names, left by commits that were lost or came second. Not while commits are being written."""
        named = {part.path.split("/")[1] for entry in self.log().collect() for part in entry.parts}
        root = self._path(f"{self.folder}/parts")
        if not self._files.exists(root):
            return 0
        left = [s.getPath() for s in self._files.listStatus(root) if s.getPath().getName() not in named]
        for path in left:
            self._files.delete(path, True)
        return len(left)


# --- the store of projects ----------------------------------------------------------

# The tables of the store, states of projects and reviews, bounds.
PROJECT_TABLES = {
    "projects": ("id long, name string, status string, next_number long", ["id"]),
    "rounds": ("project_id long, number int", ["project_id", "number"]),
    "versions": ("id long, project_id long, sha256 string, snapshot_id long, round_number int, version_number long, duplicate_of long", ["id"]),
    "snapshots": ("id long, sha256 string", ["id"]),
    "records": ("id long, project_id long, version_id long, b_snapshot long, c_snapshot long", ["id"]),
    "states": ("record_id long, change_id long, state string", ["record_id", "change_id"]),
    "operations": ("id long, version_id long, status string", ["id"]),
    "templates": ("id long, template_id long, version string, is_current boolean", ["id"]),
    "deletions": ("project_id long, version_ids array<bigint>, status string", ["project_id"]),
}
ACTIVE, RECYCLED = "Active", "Recycled"
STATES = ("Unresolved", "Confirmed", "Ignored")
MOST_IMPORTED, MOST_ROUND = 100, 10_000


def _reason(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that holds, or null."""
    out = F.when(F.lit(False), F.lit(""))
    for holds, name in rules:
        out = out.when(F.coalesce(holds, F.lit(False)), F.lit(name))
    return out


def import_versions(asked: DataFrame) -> Callable[[Snapshot], Change]:
    """Versions for projects: id, project_id, sha256, snapshot_id, round_number, allow_duplicate, position.

    A project takes all its rows or none. Its rows are numbered on in order of position. New
    rounds must follow the last one without a gap; a content that the project has, or that
    came earlier in the batch, is refused unless allowed, and then refers to the first copy.
    """

    def build(now: Snapshot) -> Change:
        projects = now["projects"].select(F.col("id").alias("project_id"), "name", "status", "next_number")
        rows = asked.select("id", "project_id", "sha256", "snapshot_id", "round_number", "allow_duplicate", "position").join(projects, "project_id", "left")
        had = now["versions"].groupBy("project_id", "sha256").agg(F.min_by("id", "version_number").alias("held"))
        rows = rows.join(had, ["project_id", "sha256"], "left").join(now["versions"].select("id", F.lit(True).alias("known")), "id", "left")
        first = Window.partitionBy("project_id", "sha256").orderBy("position", "id")
        rows = rows.withColumn("earlier", F.when(F.row_number().over(first) > 1, F.first("id").over(first)))
        rows = rows.withColumn("duplicate_of", F.coalesce("held", "earlier"))
        rounds = now["rounds"].groupBy("project_id").agg(F.max("number").alias("last_round"))
        fresh = asked.select("project_id", F.col("round_number").alias("number")).distinct().join(now["rounds"].select("project_id", "number"), ["project_id", "number"], "left_anti")
        fresh = fresh.groupBy("project_id").agg(F.min("number").alias("low"), F.max("number").alias("high"), F.count("*").alias("n_rounds"))
        rows = rows.join(rounds, "project_id", "left").join(fresh, "project_id", "left").withColumn("n", F.count("*").over(Window.partitionBy("project_id")))
        gap = (F.col("low") != F.coalesce("last_round", F.lit(0)) + 1) | (F.col("high") - F.col("low") + 1 != F.col("n_rounds"))
        judged = rows.withColumn(
            "own",
            _reason(
                (F.col("status").isNull(), "ProjectMissing"), (F.col("status") != ACTIVE, "ProjectNotActive"), (F.col("n") > MOST_IMPORTED, "TooManyVersions"), (F.col("known"), "VersionExists"),
                (~F.col("round_number").between(1, MOST_ROUND) | F.col("round_number").isNull(), "InvalidRound"), (gap, "RoundSkipped"), (F.col("duplicate_of").isNotNull() & ~F.coalesce("allow_duplicate", F.lit(False)), "DuplicateContent"),
            ),
        )
        # One refused row refuses the rows of its project.
        whole = Window.partitionBy("project_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        judged = judged.withColumn("any", F.min_by("own", F.when(F.col("own").isNotNull(), F.struct("position", "id"))).over(whole))
        refused = judged.where("any is not null").select("id", "project_id", F.coalesce("own", F.lit("OtherRowRefused")).alias("reason"))
        kept = judged.where("any is null")
        number = F.col("next_number") + F.row_number().over(Window.partitionBy("project_id").orderBy("position", "id")) - 1
        versions = kept.select("id", "project_id", "sha256", "snapshot_id", "round_number", number.alias("version_number"), "duplicate_of")
        raised = kept.groupBy(F.col("project_id").alias("id")).agg(F.first("name").alias("name"), F.first("status").alias("status"), (F.first("next_number") + F.count("*")).alias("next_number"))
        added = kept.select("project_id", F.col("round_number").alias("number")).distinct().join(now["rounds"].select("project_id", "number"), ["project_id", "number"], "left_anti")
        return Change({"versions": versions, "projects": raised, "rounds": added}, refused)

    return build


def edit_reviews(edits: DataFrame) -> Callable[[Snapshot], Change]:
    """Review states: edit_id, record_id, change_id, state, expected (null: whatever it is).

    An edit is applied whole or refused, with the first reason among its rows. Of several
    edits of one change in a batch the one with the lowest id may be applied, the others are
    refused as conflicts; edits of other changes do not disturb each other.
    """

    def build(now: Snapshot) -> Change:
        rows = edits.select("edit_id", "record_id", "change_id", "state", "expected").join(now["states"].select("record_id", "change_id", F.col("state").alias("before")), ["record_id", "change_id"], "left")
        rows = rows.withColumn("first", F.min("edit_id").over(Window.partitionBy("record_id", "change_id")))
        clash = (F.col("expected") != F.col("before")) | (F.col("first") != F.col("edit_id"))
        rows = rows.withColumn("own", _reason((~F.col("state").isin(*STATES) | F.col("state").isNull(), "UnknownState"), (F.col("before").isNull(), "UnknownChange"), (clash, "Conflict")))
        judged = rows.groupBy("edit_id").agg(F.min("own").alias("reason"), F.collect_set(F.struct("record_id", "change_id", "state")).alias("items"))
        applied = judged.where("reason is null").select(F.explode("items").alias("x")).select("x.*")
        return Change({"states": applied}, judged.where("reason is not null").select("edit_id", "reason"))

    return build


def set_current(asked: DataFrame) -> Callable[[Snapshot], Change]:
    """Of every asked template (template_id, id) exactly the named version is current from now on."""

    def build(now: Snapshot) -> Change:
        one = asked.groupBy("template_id").agg(F.max("id").alias("chosen"), F.count("*").alias("n"))
        owned = one.join(now["templates"].select(F.col("id").alias("chosen"), F.col("template_id").alias("owner")), "chosen", "left")
        good = F.coalesce(F.col("owner") == F.col("template_id"), F.lit(False))
        refused = owned.where((F.col("n") > 1) | ~good).select("template_id", F.when(F.col("n") > 1, "Conflict").otherwise("OtherTemplate").alias("reason"))
        chosen = owned.where((F.col("n") == 1) & good).select("template_id", "chosen")
        rows = now["templates"].join(chosen, "template_id").withColumn("now_current", F.col("id") == F.col("chosen")).where("not (is_current <=> now_current)")
        return Change({"templates": rows.select("id", "template_id", "version", F.col("now_current").alias("is_current"))}, refused)

    return build


def save_projects(asked: DataFrame) -> Callable[[Snapshot], Change]:
    """Projects as they should be: id, name, status, seen (the commit of the row that the author saw; null: a new project)."""

    def build(now: Snapshot) -> Change:
        rows = asked.select("id", F.trim("name").alias("name"), "status", "seen").join(now["projects"].select("id", "next_number", F.col("_version").alias("at")), "id", "left")
        rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("id")))
        reason = _reason((F.coalesce(F.col("name"), F.lit("")) == "", "NoName"), (F.col("n") > 1, "Conflict"), (F.col("seen").isNull() & F.col("at").isNotNull(), "Exists"), (F.col("seen").isNotNull() & F.col("at").isNull(), "Missing"), (F.col("seen") != F.col("at"), "Conflict"))
        judged = rows.withColumn("reason", reason)
        kept = judged.where("reason is null").select("id", "name", "status", F.coalesce("next_number", F.lit(1)).alias("next_number"))
        return Change({"projects": kept}, judged.where("reason is not null").select("id", "reason"))

    return build


def delete_projects(asked: DataFrame) -> Callable[[Snapshot], Change]:
    """Recycled projects for good: project_id, version_ids (all versions that the author holds locked).

    One commit ends the project and all that belongs to it, and the snapshots that nothing
    names any more, and writes the journal of files still to be cleaned. A project is refused
    that is not recycled, whose versions are others than the locked ones, or with a prepared
    operation.
    """

    def build(now: Snapshot) -> Change:
        versions, records = now["versions"], now["records"]
        held = versions.groupBy("project_id").agg(F.sort_array(F.collect_list("id")).alias("held"))  # a project has some hundreds
        busy = now["operations"].where("status = 'Prepared'").join(versions.select(F.col("id").alias("version_id"), "project_id"), "version_id").select("project_id").distinct().withColumn("busy", F.lit(True))
        rows = asked.select("project_id", F.sort_array(F.array_distinct("version_ids")).alias("locked")).dropDuplicates(["project_id"])
        rows = rows.join(now["projects"].select(F.col("id").alias("project_id"), "status"), "project_id", "left").join(held, "project_id", "left").join(busy, "project_id", "left")
        same = F.col("locked").eqNullSafe(F.coalesce("held", F.array().cast("array<bigint>")))
        judged = rows.withColumn("reason", _reason((F.col("status").isNull(), "ProjectMissing"), (F.col("status") != RECYCLED, "NotRecycled"), (~same, "VersionsChanged"), (F.col("busy"), "OperationPending")))
        gone = judged.where("reason is null").select("project_id", F.col("locked").alias("version_ids"))
        of_project = lambda df: df.join(gone.select("project_id"), "project_id", "left_semi")
        dead_versions, dead_records = of_project(versions), of_project(records)
        live = versions.join(gone.select("project_id"), "project_id", "left_anti")
        live_records = records.join(gone.select("project_id"), "project_id", "left_anti")
        pair = lambda df: df.select(F.explode(F.array("b_snapshot", "c_snapshot")).alias("id"))
        named = live.select(F.col("snapshot_id").alias("id")).unionByName(pair(live_records)).where("id is not null")
        touched = dead_versions.select(F.col("snapshot_id").alias("id")).unionByName(pair(dead_records)).where("id is not null").distinct()
        orphans = now["snapshots"].join(touched, "id", "left_semi").join(named, "id", "left_anti")
        ends = lambda df: df.withColumn("_gone", F.lit(True))
        of_version = now["operations"].join(dead_versions.select(F.col("id").alias("version_id")), "version_id", "left_semi")
        of_record = now["states"].join(dead_records.select(F.col("id").alias("record_id")), "record_id", "left_semi")
        rows = {
            "projects": ends(now["projects"].join(gone.select(F.col("project_id").alias("id")), "id", "left_semi")), "rounds": ends(of_project(now["rounds"])), "versions": ends(dead_versions), "records": ends(dead_records),
            "states": ends(of_record), "operations": ends(of_version), "snapshots": ends(orphans), "deletions": gone.withColumn("status", F.lit("PendingCleanup")),
        }
        return Change(rows, judged.where("reason is not null").select("project_id", "reason"))

    return build

"""Working copies of contract versions: publish, undo, preserve, regenerate and recover, as a fold over a journal.

Requests of one version are applied in order of ``seq``; versions are independent. A request
changes a state of constant size: the source's hash, the working file's hash on disk, the
copy that the store believes in, its last operation and the operation that is prepared but
not finished. In batch, versions are dealt over tasks and each task folds rows as they
stream by, so a version with very many requests costs time but no memory; as a stream, the
same fold keeps its state in Spark's state store. What many versions need at once and in no
order (recovery after a restart, the gates before an analysis) is plain columns and joins.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

REQUESTS = "version_id long, seq long, request string, sha string, path string, plan_sha string, mutations int, fault string"
OUTCOMES = "version_id long, seq long, request string, status string, code string, made string, kind string, before string, after string, undoes long, recovered_seq long, recovered_to string, copy string, file string"

# Outcomes, codes and operation states.
COMPLETED, NO_CHANGES, FAILED, CANCELLED, EXTERNAL, REVIEW = "Completed", "NoChanges", "Failed", "Cancelled", "WorkingCopyExternallyModified", "RecoveryNeedsReview"
PREPARED, UNDONE = "Prepared", "Undone"
WRITE_FAILED, NO_COPY, NOT_UNDOABLE, UNTRACKED, OTHER_ORIGINAL = "WorkingCopyWriteFailed", "NoWorkingCopy", "NoUndoableRestore", "UntrackedWorkingCopy", "OriginalIdentityMismatch"
UNDO_MISMATCH, RECOVERY_EDIT, MANY_PENDING, OUT_OF_ORDER = "UndoHashMismatch", "ExternalModificationDuringRecovery", "MultiplePendingOperations", "OutOfOrder"
#: What happens in the world between requests, and what has no outcome since the process died.
NOTED, INTERRUPTED = "Noted", "Interrupted"
#: Faults of a publication: the process dies before or after the file is replaced, writing fails, the caller cancels.
CRASH_PREPARED, CRASH_PROMOTED, WRITE, CANCEL = "CrashPrepared", "CrashPromoted", "Write", "Cancel"


@dataclass(frozen=True)
class Operation:
    seq: int
    kind: str
    before: str | None
    after: str
    path: str | None
    original: str | None
    undoes: int | None = None


@dataclass(frozen=True)
class State:
    """``copy`` is the operation that made the copy which the store believes in; its path and original stay with it."""

    seq: int | None = None
    source: str | None = None
    file: str | None = None
    copy: Operation | None = None
    pending: Operation | None = None

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def loads(text: str) -> State:
        raw = json.loads(text)
        return State(**raw | {k: Operation(**raw[k]) if raw[k] else None for k in ("copy", "pending")})


class _Stop(Exception):
    """A request that ends without a publication: status and code."""


def _recovered(s: State) -> tuple[State, dict]:
    """A prepared operation is finished if its file is in place, failed if the old one is, else left for review."""
    op = s.pending
    if op is None:
        return s, {}
    if s.file == op.after:
        return replace(s, pending=None, copy=op), {"recovered_seq": op.seq, "recovered_to": COMPLETED}
    if s.file == op.before:
        return replace(s, pending=None), {"recovered_seq": op.seq, "recovered_to": FAILED}
    raise _Stop(REVIEW, RECOVERY_EDIT)


def _planned(s: State, r: dict) -> Operation:
    """The operation that a request asks for, or why there is none."""
    kind, copy = r["request"], s.copy
    if kind == "Restore":
        if s.source is None:
            raise _Stop(FAILED, WRITE_FAILED)
        if copy is not None and copy.path != r["path"]:
            raise _Stop(FAILED, OTHER_ORIGINAL)
        if copy is None and s.file is not None:
            raise _Stop(FAILED, UNTRACKED)
        if copy is not None and s.file != copy.after:
            raise _Stop(EXTERNAL, EXTERNAL)
        if not r["mutations"]:
            raise _Stop(NO_CHANGES, None)
        return Operation(r["seq"], kind, s.file, r["sha"], r["path"], copy.original if copy else r["plan_sha"])
    if copy is None:
        raise _Stop(FAILED, NO_COPY)
    if kind == "Undo":
        if copy.kind != "Restore":
            raise _Stop(FAILED, NOT_UNDOABLE)
        if s.file != copy.after:
            raise _Stop(EXTERNAL, UNDO_MISMATCH)
        back = r["sha"] or copy.before or copy.original
        return Operation(r["seq"], kind, s.file, back, copy.path, copy.original, copy.seq)
    now = s.file if kind == "Preserve" else s.source
    if now is None:
        raise _Stop(FAILED, WRITE_FAILED)
    return Operation(r["seq"], kind, s.file, now, copy.path, copy.original if kind == "Preserve" else s.source)


def _published(s: State, op: Operation, fault: str | None) -> tuple[State, str, str | None, str | None]:
    """State, status, code and the operation's state after a publication with its fault, if any."""
    keeps_file = op.kind == "Preserve"
    if fault == CANCEL:
        return s, CANCELLED, CANCELLED, None if keeps_file else FAILED
    if fault == CRASH_PREPARED or (keeps_file and fault == CRASH_PROMOTED):
        return replace(s, pending=op), INTERRUPTED, None, PREPARED
    if fault == WRITE and keeps_file:
        return s, EXTERNAL, EXTERNAL, FAILED
    # A first publication and a new one from the source must come from the source as it is now.
    stale = (s.copy is None or op.kind == "Regenerate") and s.source != op.original
    if stale or fault == WRITE:
        return s, FAILED, WRITE_FAILED, FAILED
    s = replace(s, file=op.after)
    if fault == CRASH_PROMOTED:
        return replace(s, pending=op), INTERRUPTED, None, PREPARED
    return replace(s, copy=op), COMPLETED, None, COMPLETED


def step(s: State, r: dict) -> tuple[State, dict]:
    """The state after a request, and the request's outcome."""
    out = {"version_id": r["version_id"], "seq": r["seq"], "request": r["request"]}
    if r["seq"] is None or (s.seq is not None and r["seq"] <= s.seq):
        return s, out | {"status": FAILED, "code": OUT_OF_ORDER, "copy": s.copy and s.copy.after, "file": s.file}
    s = replace(s, seq=r["seq"])
    if r["request"] in ("Source", "External"):
        s, status, code = replace(s, **{"source" if r["request"] == "Source" else "file": r["sha"]}), NOTED, None
    else:
        try:
            s, found = _recovered(s)
            out |= found
            if r["request"] == "Recover":
                raise _Stop(COMPLETED if found.get("recovered_to") == COMPLETED else NO_CHANGES, None)
            op = _planned(s, r)
            s, status, code, made = _published(s, op, r["fault"])
            if made:
                out |= {"made": made, "kind": op.kind, "before": op.before, "after": op.after, "undoes": op.undoes}
        except _Stop as stop:
            status, code = stop.args
    return s, out | {"status": status, "code": code, "copy": s.copy and s.copy.after, "file": s.file}


_IN = [c.split()[0] for c in REQUESTS.split(", ")]
_OUT = [c.split()[0] for c in OUTCOMES.split(", ")]
_WHOLE = [c.split()[0] for c in OUTCOMES.split(", ") if c.endswith(" long")]


def _records(frame: pd.DataFrame) -> list[dict]:
    """Rows as plain values: missing ones are None, numbers whole."""
    plain = lambda name, x: None if pd.isna(x) else x if isinstance(x, str) else int(x)
    return [dict(zip(_IN, (plain(n, x) for n, x in zip(_IN, row, strict=True)), strict=True)) for row in frame[_IN].itertuples(index=False, name=None)]


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame([[r.get(c) for c in _OUT] for r in rows], columns=_OUT, dtype=object)
    return out.astype(dict.fromkeys(_WHOLE, "Int64"))


def _fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Outcomes of rows that come sorted by version and seq."""
    key, state = None, State()
    for frame in frames:
        rows = []
        for r in _records(frame):
            if r["version_id"] != key:
                key, state = r["version_id"], State()
            state, out = step(state, r)
            rows.append(out)
        yield _frame(rows)


def outcomes(requests: DataFrame) -> DataFrame:
    """One row per request: status, code, the operation that it made, what it recovered, and copy and file after it.

    Requests: Restore (sha of the rendered file, path, plan_sha, mutations), Undo, Preserve,
    Regenerate, Recover; External sets the working file's hash (null: deleted) and Source the
    source's. ``fault`` strikes a publication. A seq that is null or not above the one before
    it is refused as out of order. Rows without a version form a version of their own; other
    columns are not read; no rows: no rows.
    """
    rows = requests.select(*_IN).repartition("version_id").sortWithinPartitions("version_id", "seq")
    return rows.mapInPandas(_fold, OUTCOMES)


def outcome_stream(requests: DataFrame) -> DataFrame:
    """``outcomes`` of a stream of requests; the state of a version is kept between batches."""

    def run(_, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = State.loads(held.get[0]) if held.exists else State()
        for r in sorted((r for f in frames for r in _records(f)), key=lambda r: (r["seq"] is not None, r["seq"] or 0)):
            state, out = step(state, r)
            yield _frame([out])
        held.update((state.dumps(),))

    return requests.select(*_IN).groupBy("version_id").applyInPandasWithState(run, OUTCOMES, "state string", "append", GroupStateTimeout.NoTimeout)


def operations(found: DataFrame) -> DataFrame:
    """The journal: every operation that was prepared, in its last state, from the outcomes."""
    keys = ["version_id", "seq"]
    made = found.where("made is not null").select(*keys, "kind", "made", "before", "after", "undoes")
    recovered = found.where("recovered_seq is not null").select("version_id", F.col("recovered_seq").alias("seq"), "recovered_to")
    # Of rows with one seq only the first was applied; the others made nothing.
    ended = made.join(recovered, keys, "left").withColumn("status", F.coalesce("recovered_to", "made"))
    undone = ended.where(f"undoes is not null and status = '{COMPLETED}'").select("version_id", F.col("undoes").alias("seq"), F.lit(UNDONE).alias("undone"))
    return ended.drop("made", "recovered_to").join(undone, keys, "left").withColumn("status", F.coalesce("undone", "status")).drop("undone")


def recoveries(journal: DataFrame, files: DataFrame) -> DataFrame:
    """version_id, verdict, code and n of every version with prepared operations (version_id, seq, status, before, after).

    ``files``: version_id and sha of the working files there are. This judges any journal at
    once, as after a restart: one prepared operation is completed, failed or left for review
    by the file's hash; several are left for review.
    """
    pending = journal.where(f"status = '{PREPARED}'").groupBy("version_id").agg(F.count("*").alias("n"), F.first("before").alias("before"), F.first("after").alias("after"))
    rows = pending.join(files.select("version_id", F.col("sha").alias("now")), "version_id", "left")
    at = lambda c: F.col("now").eqNullSafe(F.col(c))
    verdict = F.when(F.col("n") > 1, REVIEW).when(at("after"), COMPLETED).when(at("before"), FAILED).otherwise(REVIEW)
    code = F.when(F.col("n") > 1, MANY_PENDING).when(~at("after") & ~at("before"), RECOVERY_EDIT)
    return rows.select("version_id", verdict.alias("verdict"), code.alias("code"), "n")


# States and messages of an analysis.
READY, UNAVAILABLE, RECOVERY_REQUIRED, SOURCE_CHANGED, COPY_CHANGED = "Ready", "Unavailable", "RecoveryRequired", "SourceChanged", "WorkingCopyChanged"
MESSAGES = {
    "Partial": (UNAVAILABLE, "比对不存在或文档解析不完整，不能生成可靠恢复计划。"),
    "Unlinked": (UNAVAILABLE, "此历史记录缺少合同版本关联，请从项目版本重新比对。"),
    "OtherVersion": (UNAVAILABLE, "合同版本与历史快照不一致，请重新打开项目检查。"),
    "Pending": (RECOVERY_REQUIRED, "存在未完成恢复操作，请正常关闭并重启核验。文件与历史仍保留。"),
    "OtherPlace": (RECOVERY_REQUIRED, "工作文件位置与版本身份不一致，请核验存储状态。"),
    "PartialCopy": (UNAVAILABLE, "工作文件解析不完整，不能生成可靠恢复计划。"),
    "SourceChanged": (SOURCE_CHANGED, "原始修订文件缺失或已变化，请重新比对当前文件。"),
    "CopyChanged": (COPY_CHANGED, "格式恢复版缺失或已被外部修改，请先选择保留修改或重新生成。"),
    "Ready": (READY, "计划已生成；分析没有写入 DOCX 或恢复历史。"),
}


def expected_place(root: str, version: Column) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/WorkingCopies/"), version.cast("string"), F.lit("/restored.docx"))


def analysis_gates(asked: DataFrame, records: DataFrame, links: DataFrame, versions: DataFrame, journal: DataFrame, copies: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """record_id, version_id, gate, status, message and source of every asked record: the first gate that stops it, or Ready.

    records: record_id, is_partial, current_sha; links: record_id, version_id, snapshot_id;
    versions: version_id, snapshot_id, sha, path; journal: version_id, status; copies:
    version_id, path, sha, parse_status; files: path, sha, linked (through a link). Tables
    have one row for each key but the journal. A stopped record has its version only where it
    got as far as that, and a source only where it is ready.
    """
    pending = journal.where(f"status = '{PREPARED}'").select("version_id").distinct().withColumn("pending", F.lit(True))
    rows = asked.select("record_id").distinct().join(records.select("record_id", "is_partial", F.col("current_sha").alias("record_sha"), F.lit(True).alias("known")), "record_id", "left")
    rows = rows.join(links.select("record_id", F.col("version_id").alias("linked_id"), F.col("snapshot_id").alias("linked_snapshot")), "record_id", "left")
    rows = rows.join(versions.select(F.col("version_id").alias("linked_id"), "snapshot_id", F.col("sha").alias("version_sha"), F.col("path").alias("version_path")), "linked_id", "left")
    rows = rows.join(pending.withColumnRenamed("version_id", "linked_id"), "linked_id", "left")
    rows = rows.join(copies.select(F.col("version_id").alias("linked_id"), F.col("path").alias("copy_path"), F.col("sha").alias("copy_sha"), "parse_status", F.lit(True).alias("copied")), "linked_id", "left")
    copied = F.coalesce("copied", F.lit(False))
    rows = rows.withColumn("place", F.when(copied, F.col("copy_path")).otherwise(F.col("version_path")))
    rows = rows.join(files.select(F.col("path").alias("place"), F.col("sha").alias("now"), "linked"), "place", "left")
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    intact = F.coalesce(F.lower("now") == F.lower(F.when(copied, F.col("copy_sha")).otherwise(F.col("record_sha"))), F.lit(False)) & ~F.coalesce("linked", F.lit(False))
    gate = (
        F.when(F.col("known").isNull() | F.coalesce("is_partial", F.lit(True)), "Partial")
        .when(F.col("linked_id").isNull(), "Unlinked")
        .when(~same("snapshot_id", "linked_snapshot") | ~same("version_sha", "record_sha"), "OtherVersion")
        .when(F.coalesce("pending", F.lit(False)), "Pending")
        .when(copied & ~F.coalesce(F.col("copy_path") == expected_place(root, F.col("linked_id")), F.lit(False)), "OtherPlace")
        .when(copied & ~F.coalesce(F.col("parse_status") == "Complete", F.lit(False)), "PartialCopy")
        .when(~intact & ~copied, "SourceChanged")
        .when(~intact, "CopyChanged")
        .otherwise("Ready")
    )
    said = lambda k: F.element_at(F.create_map(*(F.lit(x) for gate, pair in MESSAGES.items() for x in (gate, pair[k]))), F.col("gate"))
    early = F.col("gate").isin("Partial", "Unlinked", "OtherVersion")
    judged = rows.withColumn("gate", gate)
    named = F.when(~early, F.col("linked_id")).alias("version_id")
    return judged.select("record_id", named, "gate", said(0).alias("status"), said(1).alias("message"), F.when(F.col("gate") == "Ready", F.col("place")).alias("source"))

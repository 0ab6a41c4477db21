from __future__ import annotations

import pytest
from docweave.operators import working_copy as wc
from docweave.plans import working_copy_queries as queries
from pyspark.sql import functions as F

SOURCE = ("Source", "o")


def run(spark, *steps):
    """Steps are (request, sha, fault); Restore comes from source o unless it says otherwise."""
    rows = []
    for k, step in enumerate(steps, 1):
        request, sha, fault, more = (*step, None, None, None)[:4]
        rows.append((1, k, request, sha, "p", (more or {}).get("plan", "o"), (more or {}).get("mutations", 2), fault))
    found = wc.outcomes(spark.createDataFrame(rows, wc.REQUESTS)).collect()
    assert [r.seq for r in found] == list(range(1, len(rows) + 1))
    return found


def said(found):
    return [(r.status, r.code) for r in found if r.request not in ("Source", "External")]


def states(spark, found):
    return {r.seq: r.status for r in wc.operations(spark.createDataFrame(found, wc.OUTCOMES)).collect()}


def test_create_update_and_undo_use_one_file(spark):
    found = run(spark, SOURCE, ("Restore", "r1"), ("Restore", "r2"), ("Restore", "r3", None, {"mutations": 0}), ("Undo",), ("Undo",))
    assert said(found) == [("Completed", None), ("Completed", None), ("NoChanges", None), ("Completed", None), ("Failed", "NoUndoableRestore")]
    assert [r.file for r in found] == [None, "r1", "r2", "r2", "r1", "r1"] == [r.copy for r in found]
    assert states(spark, found) == {2: "Completed", 3: "Undone", 5: "Completed"}


def test_external_edits_stop_restore_and_undo_until_kept(spark):
    found = run(spark, SOURCE, ("Undo",), ("Preserve",), ("Regenerate",), ("Restore", "r1"), ("External", "x"), ("Restore", "r2"), ("Undo",), ("Preserve",), ("Undo",), ("Restore", "r3"))
    assert said(found) == [("Failed", "NoWorkingCopy")] * 3 + [("Completed", None)] + [("WorkingCopyExternallyModified", "WorkingCopyExternallyModified"), ("WorkingCopyExternallyModified", "UndoHashMismatch"), ("Completed", None), ("Failed", "NoUndoableRestore"), ("Completed", None)]
    assert (found[-1].before, found[-1].file) == ("x", "r3")


def test_regenerate_takes_the_source_again(spark):
    found = run(spark, SOURCE, ("Restore", "r1"), ("External", None), ("Source", "o2"), ("Regenerate",), ("Restore", "r2"), ("Source", None), ("Regenerate",))
    assert said(found) == [("Completed", None)] * 3 + [("Failed", "WorkingCopyWriteFailed")]
    assert [r.file for r in found][-2:] == ["r2", "r2"] and found[4].file == "o2"


def test_cancelled_and_failed_publications_leave_the_file(spark):
    found = run(spark, SOURCE, ("Restore", "r1"), ("Restore", "r2", "Cancel"), ("Restore", "r3", "Write"), ("Preserve", None, "Cancel"), ("Preserve", None, "Write"), ("Restore", "r4"))
    assert said(found) == [("Completed", None), ("Cancelled", "Cancelled"), ("Failed", "WorkingCopyWriteFailed"), ("Cancelled", "Cancelled"), ("WorkingCopyExternallyModified", "WorkingCopyExternallyModified"), ("Completed", None)]
    assert [r.file for r in found] == [None, "r1", "r1", "r1", "r1", "r1", "r4"]
    assert states(spark, found) == {2: "Completed", 3: "Failed", 4: "Failed", 6: "Failed", 7: "Completed"}


def test_first_publication_needs_the_source_of_its_plan(spark):
    found = run(spark, SOURCE, ("Restore", "r1", None, {"plan": "older"}), ("External", "stray"), ("Restore", "r2"), ("External", None), ("Restore", "r3"))
    assert said(found) == [("Failed", "WorkingCopyWriteFailed"), ("Failed", "UntrackedWorkingCopy"), ("Completed", None)]


@pytest.mark.parametrize(("fault", "edited", "want"), [("CrashPromoted", None, "Completed"), ("CrashPrepared", None, "Failed"), ("CrashPrepared", "x", "Prepared")])
def test_recovery_after_a_crash(spark, fault, edited, want):
    """A file in place is completed without restoring again, the old file fails safely, an unknown one needs review."""
    found = run(spark, SOURCE, ("Restore", "r1"), ("Restore", "r2", fault), *([("External", edited)] if edited else []), ("Recover",), ("Undo",))
    assert states(spark, found)[3] == {"Completed": "Undone"}.get(want, want)
    if want == "Prepared":
        assert said(found)[-2:] == [("RecoveryNeedsReview", "ExternalModificationDuringRecovery")] * 2 and found[-1].file == "x"
    else:
        assert [r.recovered_to for r in found][-2:] == [want, None]
        assert said(found)[-2:] == [("Completed" if want == "Completed" else "NoChanges", None), ("Completed", None)]
        assert found[-1].file == ("r1" if want == "Completed" else "o")


def test_odd_rows(spark):
    rows = [(1, 2, "Source", "o", None, None, None, None), (1, 2, "Source", "o9", None, None, None, None), (1, None, "Recover", None, None, None, None, None), (None, 1, "Undo", None, None, None, None, None), (None, 2, "Recover", None, None, None, None, None)]
    got = wc.outcomes(spark.createDataFrame(rows, wc.REQUESTS).withColumn("copy", F.lit(1))).collect()
    assert sorted((r.version_id or 0, r.seq or 0, r.status, r.code or "") for r in got) == [(0, 1, "Failed", "NoWorkingCopy"), (0, 2, "NoChanges", ""), (1, 0, "Failed", "OutOfOrder"), (1, 2, "Failed", "OutOfOrder"), (1, 2, "Noted", "")]
    assert wc.outcomes(spark.createDataFrame([], wc.REQUESTS)).count() == 0


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    """Two batches of a stream, the second going on from the state that the first left."""
    asked = queries.requests(spark, sf_dir).where("version_id < 6").cache()
    for k, part in enumerate((asked.where("seq <= 20"), asked.where("seq > 20"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/k={k}")
    stream = wc.outcome_stream(spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"))
    query = stream.writeStream.format("memory").queryName("copies").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(300)
    key = lambda r: (r.version_id, r.seq)
    assert sorted(spark.table("copies").collect(), key=key) == sorted(wc.outcomes(asked).collect(), key=key)


def test_query_reaches_every_branch(spark):
    """The query over events at a larger size meets all outcomes that requests can have."""
    found = wc.outcomes(queries.requests(spark, "/root/testdata/sf0.01")).select("status", "code").distinct().collect()
    assert {r.status for r in found} == {"Completed", "NoChanges", "Failed", "Cancelled", "WorkingCopyExternallyModified", "RecoveryNeedsReview", "Noted", "Interrupted"}
    assert {"NoWorkingCopy", "NoUndoableRestore", "UntrackedWorkingCopy", "OriginalIdentityMismatch", "UndoHashMismatch", "WorkingCopyWriteFailed"} <= {r.code for r in found}

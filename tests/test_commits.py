from __future__ import annotations

import pytest
from docweave.operators import commits
from docweave.operators.commits import PROJECT_TABLES, Change, Store
from pyspark.sql import functions as F


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", PROJECT_TABLES)


def put(store, **tables):
    frames = {t: store.spark.createDataFrame(rows, PROJECT_TABLES[t][0]) for t, rows in tables.items()}
    return store.transact(lambda now: Change(frames), "load").version


def rows(snapshot, table):
    return sorted(tuple(r)[:-1] for r in snapshot[table].collect())


def refused(done):
    return sorted(tuple(r) for r in done.refused.collect())


def states(store, at=None):
    return {r.change_id: r.state for r in store.snapshot(at)["states"].collect()}


EDIT = "edit_id long, record_id long, change_id long, state string, expected string"


def edit(store, *edits):
    return commits.edit_reviews(store.spark.createDataFrame(edits, EDIT))


def test_snapshots_and_whole_commits(store):
    assert store.head() == 0 and rows(store.snapshot(), "projects") == []
    assert put(store, projects=[(1, "a", "Active", 1), (2, "b", "Active", 1)], rounds=[(1, 1)]) == 1
    assert put(store, projects=[(2, "c", "Recycled", 4)]) == 2
    assert rows(store.snapshot(1), "projects") == [(1, "a", "Active", 1), (2, "b", "Active", 1)]
    assert rows(store.snapshot(), "projects") == [(1, "a", "Active", 1), (2, "c", "Recycled", 4)]
    assert rows(store.snapshot(), "rounds") == [(1, 1)]
    with pytest.raises(ValueError, match="no commit"):
        store.snapshot(3)
    assert store.compact("projects").version == 3 and len(store.parts(3)["projects"]) == 1
    assert rows(store.snapshot(3), "projects") == rows(store.snapshot(2), "projects")
    assert [r.what for r in store.log().orderBy("version").collect()] == ["load", "load", "compact projects"]


def test_half_written_commits_are_invisible(store, tmp_path, monkeypatch):
    put(store, states=[(1, 1, "Unresolved")])
    monkeypatch.setattr(Store, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        put(store, states=[(1, 1, "Ignored")], rounds=[(1, 1)])
    monkeypatch.undo()
    (tmp_path / "store/log/draft-1").write_text('{"version": 2, "parts"')
    assert store.head() == 1 and states(store) == {1: "Unresolved"} and rows(store.snapshot(), "rounds") == []
    assert store.sweep() == 1 and store.sweep() == 0 and states(store) == {1: "Unresolved"}


def test_conflicting_edits_have_one_winner(store):
    """The second author's commit is built while the first one lands: built again, it finds its expectation broken."""
    put(store, states=[(1, 1, "Unresolved"), (1, 2, "Unresolved")])
    late = edit(store, (2, 1, 1, "Ignored", "Unresolved"))
    inner = []

    def build(now):
        change = late(now)
        if not inner:
            inner.append(store.transact(edit(store, (1, 1, 1, "Confirmed", "Unresolved"))))
        return change

    done = store.transact(build)
    assert (inner[0].version, done.version, done.attempts) == (2, 3, 2) and refused(inner[0]) == []
    assert refused(done) == [(2, "Conflict")] and states(store) == {1: "Confirmed", 2: "Unresolved"}
    assert states(store, 1) == {1: "Unresolved", 2: "Unresolved"}


def test_disjoint_edits_are_merged(store):
    put(store, states=[(1, 1, "Unresolved"), (1, 2, "Unresolved")])
    inner = []

    def build(now):
        change = edit(store, (2, 1, 2, "Ignored", "Unresolved"))(now)
        if not inner:
            inner.append(store.transact(edit(store, (1, 1, 1, "Confirmed", "Unresolved"))))
        return change

    assert refused(store.transact(build)) == [] and states(store) == {1: "Confirmed", 2: "Ignored"}


def test_a_busy_store_gives_up(store):
    put(store, states=[(1, 1, "Unresolved")])

    def build(now):
        change = edit(store, (9, 1, 1, "Ignored", None))(now)
        store.transact(edit(store, (1, 1, 1, "Confirmed", None)))
        return change

    with pytest.raises(commits.Busy):
        store.transact(build)
    assert store.head() == 1 + commits.ATTEMPTS and states(store) == {1: "Confirmed"}


def test_edits_are_whole(store):
    put(store, states=[(1, 1, "Unresolved"), (1, 2, "Ignored"), (1, 3, "Confirmed")])
    done = store.transact(edit(store, (1, 1, 1, "Ignored", "Unresolved"), (1, 1, 2, "Confirmed", "Unresolved"), (2, 1, 3, "Ignored", None), (3, 1, 3, "Unresolved", "Confirmed"), (4, 1, 9, "Ignored", None), (5, 1, 2, "Odd", None)))
    assert refused(done) == [(1, "Conflict"), (3, "Conflict"), (4, "UnknownChange"), (5, "UnknownState")]
    assert states(store) == {1: "Unresolved", 2: "Ignored", 3: "Ignored"}


ASKED = "id long, project_id long, sha256 string, snapshot_id long, round_number int, allow_duplicate boolean, position int"


def test_imports(store):
    put(store, projects=[(1, "a", "Active", 3), (2, "b", "Archived", 1), (3, "c", "Active", 1), (4, "d", "Active", 1)], rounds=[(1, 1)], versions=[(10, 1, "x", 1, 1, 1, None), (11, 1, "y", 2, 1, 2, None)])
    asked = [(20, 1, "z", 3, 2, False, 0), (21, 1, "x", 1, 3, True, 1), (22, 1, "z", 3, 2, True, 2), (30, 2, "q", 4, 1, False, 0), (31, 3, "q", 4, 2, False, 0), (40, 4, "q", 4, 1, False, 0), (41, 4, "q", 4, 1, False, 1), (50, 9, "q", 4, 1, False, 0)]
    done = store.transact(commits.import_versions(store.spark.createDataFrame(asked, ASKED)), "import")
    assert refused(done) == [(30, 2, "ProjectNotActive"), (31, 3, "RoundSkipped"), (40, 4, "OtherRowRefused"), (41, 4, "DuplicateContent"), (50, 9, "ProjectMissing")]
    new = [r for r in rows(store.snapshot(), "versions") if r[0] >= 20]
    assert [(r[0], r[5], r[6]) for r in new] == [(20, 3, None), (21, 4, 10), (22, 5, 20)]
    assert rows(store.snapshot(), "projects")[0] == (1, "a", "Active", 6) and rows(store.snapshot(), "rounds") == [(1, 1), (1, 2), (1, 3)]
    # Another import of one author, numbered while a first one lands, is numbered on from it.
    more = lambda k: commits.import_versions(store.spark.createDataFrame([(k, 1, str(k), 1, 3, False, 0)], ASKED))
    inner = []

    def build(now):
        change = more(61)(now)
        if not inner:
            inner.append(store.transact(more(60)))
        return change

    store.transact(build)
    assert [(r[0], r[5]) for r in rows(store.snapshot(), "versions") if r[0] >= 60] == [(60, 6), (61, 7)]
    many = store.spark.range(200, 301).select("id", F.lit(1).cast("long").alias("project_id"), F.col("id").cast("string").alias("sha256"), F.lit(1).cast("long").alias("snapshot_id"), F.lit(1).alias("round_number"), F.lit(False).alias("allow_duplicate"), F.col("id").cast("int").alias("position"))
    assert {r.reason for r in store.transact(commits.import_versions(many)).refused.collect()} == {"TooManyVersions"}


def test_deletions_cascade_in_one_commit(store):
    put(store, projects=[(1, "a", "Recycled", 3), (2, "b", "Recycled", 2), (3, "c", "Active", 1), (4, "d", "Recycled", 2)], rounds=[(1, 1), (2, 1)], snapshots=[(1, "s"), (2, "t"), (3, "u"), (4, "v")],
        versions=[(10, 1, "s", 1, 1, 1, None), (11, 1, "t", 2, 1, 2, None), (20, 2, "t", 2, 1, 1, None), (40, 4, "w", 4, 1, 1, None)], records=[(100, 1, 11, 1, 3), (200, 2, 20, 2, 2)], states=[(100, 1, "Ignored"), (200, 1, "Ignored")], operations=[(5, 10, "Completed"), (6, 40, "Prepared")])
    asked = store.spark.createDataFrame([(1, [11, 10]), (2, [20, 21]), (3, []), (4, [40]), (9, [])], "project_id long, version_ids array<bigint>")
    done = store.transact(commits.delete_projects(asked), "delete")
    assert refused(done) == [(2, "VersionsChanged"), (3, "NotRecycled"), (4, "OperationPending"), (9, "ProjectMissing")]
    now = store.snapshot()
    assert {t: len(rows(now, t)) for t in PROJECT_TABLES} == {"projects": 3, "rounds": 1, "versions": 2, "snapshots": 2, "records": 1, "states": 1, "operations": 1, "templates": 0, "deletions": 1}
    assert [r[0] for r in rows(now, "snapshots")] == [2, 4] and rows(now, "deletions") == [(1, [10, 11], "PendingCleanup")]
    assert len(rows(store.snapshot(1), "versions")) == 4


def test_projects_and_templates(store):
    put(store, projects=[(1, "a", "Active", 7)], templates=[(1, 5, "1.0.0", True), (2, 5, "1.0.1", False), (3, 6, "1.0.0", True)])
    save = lambda *r: store.transact(commits.save_projects(store.spark.createDataFrame(r, "id long, name string, status string, seen long")))
    assert refused(save((1, " z ", "Archived", 1), (2, "new", "Active", None))) == [] and rows(store.snapshot(), "projects") == [(1, "z", "Archived", 7), (2, "new", "Active", 1)]
    assert refused(save((1, "q", "Active", 1), (2, "q", "Active", None), (3, "q", "Active", 1), (4, " ", "Active", None))) == [(1, "Conflict"), (2, "Exists"), (3, "Missing"), (4, "NoName")]
    done = store.transact(commits.set_current(store.spark.createDataFrame([(5, 2), (6, 2)], "template_id long, id long")))
    assert refused(done) == [(6, "OtherTemplate")] and [(r[0], r[3]) for r in rows(store.snapshot(), "templates")] == [(1, False), (2, True), (3, True)]

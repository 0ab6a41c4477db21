"""Queries of working copies and of the gates before an analysis, and the SQL that must agree.

Events stand for what befalls the working copy of a version (a user), in order of time; in
the relational tables orders stand for comparisons and their customers for versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.operators import working_copy as wc
from docweave.storage import stored


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FAULTS = {7: wc.CRASH_PREPARED, 8: wc.CRASH_PROMOTED, 9: wc.WRITE, 10: wc.CANCEL}


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups change the source, purchases restore, views undo, errors edit the file, clicks do the rest."""
    e = _t(spark, sf_dir, "events").where("user_id is not null")
    n, kind = F.col("event_id"), F.col("event_type")
    request = F.when(kind == "signup", "Source").when(kind == "purchase", "Restore").when(kind == "view", "Undo").when(kind == "error", F.when(n % 2 == 0, "External").otherwise("Restore"))
    request = F.coalesce(request, F.when(n % 3 == 0, "Preserve").when(n % 3 == 1, "Regenerate").otherwise("Recover"))
    text = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    sha = F.when(request == "Source", F.when(n % 23 != 0, text("o", n % 2))).when(request == "External", F.when(n % 5 != 0, text("x", n % 4))).when(request == "Restore", text("r", n))
    fault = F.element_at(F.create_map(*(F.lit(x) for pair in _FAULTS.items() for x in pair)), (n % 11).cast("int"))
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return e.select(F.col("user_id").alias("version_id"), seq.alias("seq"), request.alias("request"), sha.alias("sha"), text("p", (n % 19 == 0).cast("int")).alias("path"), text("o", (n / 2).cast("long") % 2).alias("plan_sha"), (n % 4).cast("int").alias("mutations"), fault.alias("fault"))


def working_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every request, and the working copy after it."""
    return wc.outcomes(requests(spark, sf_dir))


_REQUESTS_SQL = """ev AS (
  SELECT event_id AS n, user_id AS version_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
    CASE event_type WHEN 'signup' THEN 'Source' WHEN 'purchase' THEN 'Restore' WHEN 'view' THEN 'Undo' WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'External' ELSE 'Restore' END
      ELSE CASE event_id % 3 WHEN 0 THEN 'Preserve' WHEN 1 THEN 'Regenerate' ELSE 'Recover' END END AS request
  FROM events WHERE user_id IS NOT NULL
), requests AS (
  SELECT version_id, seq, request, CASE request WHEN 'Source' THEN CASE WHEN n % 23 <> 0 THEN 'o' || (n % 2) END WHEN 'External' THEN CASE WHEN n % 5 <> 0 THEN 'x' || (n % 4) END WHEN 'Restore' THEN 'r' || n END AS sha,
    'p' || CAST(n % 19 = 0 AS INT) AS path, 'o' || (n // 2 % 2) AS plan_sha, n % 4 AS mutations, CASE n % 11 WHEN 7 THEN 'CrashPrepared' WHEN 8 THEN 'CrashPromoted' WHEN 9 THEN 'Write' WHEN 10 THEN 'Cancel' END AS fault
  FROM ev
)"""

# The fold as a recursion over seq. c_ is the copy's operation, p_ the prepared one, n_ the one that a request plans.
_FOLD_SQL = f"""{_REQUESTS_SQL}, st AS (
  SELECT DISTINCT version_id, CAST(0 AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS request, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS code, CAST(NULL AS VARCHAR) AS made, CAST(NULL AS VARCHAR) AS kind,
    CAST(NULL AS VARCHAR) AS before, CAST(NULL AS VARCHAR) AS after, CAST(NULL AS BIGINT) AS undoes, CAST(NULL AS BIGINT) AS recovered_seq, CAST(NULL AS VARCHAR) AS recovered_to,
    CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS file,
    CAST(NULL AS STRUCT(seq BIGINT, kind VARCHAR, before VARCHAR, after VARCHAR, path VARCHAR, original VARCHAR, undoes BIGINT)) AS c,
    CAST(NULL AS STRUCT(seq BIGINT, kind VARCHAR, before VARCHAR, after VARCHAR, path VARCHAR, original VARCHAR, undoes BIGINT)) AS p
  FROM requests
  UNION ALL
  SELECT version_id, seq, request, status, code, made, CASE WHEN made IS NOT NULL THEN n.kind END, CASE WHEN made IS NOT NULL THEN n.before END, CASE WHEN made IS NOT NULL THEN n.after END, CASE WHEN made IS NOT NULL THEN n.undoes END,
    recovered_seq, recovered_to,
    CASE WHEN request = 'Source' THEN sha ELSE source END,
    CASE WHEN request = 'External' THEN sha WHEN made = 'Completed' OR (made = 'Prepared' AND fault = 'CrashPromoted' AND request <> 'Preserve') THEN n.after ELSE file END,
    CASE WHEN made = 'Completed' THEN n ELSE c END, CASE WHEN made = 'Prepared' THEN n ELSE p END
  FROM (
    SELECT *, CASE WHEN why IS NOT NULL OR request IN ('Source', 'External', 'Recover') THEN NULL
        WHEN fault = 'Cancel' THEN CASE WHEN request <> 'Preserve' THEN 'Failed' END
        WHEN fault = 'CrashPrepared' OR (request = 'Preserve' AND fault = 'CrashPromoted') THEN 'Prepared'
        WHEN fault = 'Write' OR stale THEN 'Failed' WHEN fault = 'CrashPromoted' THEN 'Prepared' ELSE 'Completed' END AS made,
      CASE WHEN request IN ('Source', 'External') THEN 'Noted' WHEN why IS NOT NULL THEN string_split(why, '/')[1]
        WHEN request = 'Recover' THEN CASE WHEN recovered_to = 'Completed' THEN 'Completed' ELSE 'NoChanges' END
        WHEN fault = 'Cancel' THEN 'Cancelled' WHEN fault = 'CrashPrepared' OR (request = 'Preserve' AND fault = 'CrashPromoted') THEN 'Interrupted'
        WHEN fault = 'Write' AND request = 'Preserve' THEN 'WorkingCopyExternallyModified' WHEN fault = 'Write' OR stale THEN 'Failed' WHEN fault = 'CrashPromoted' THEN 'Interrupted' ELSE 'Completed' END AS status,
      CASE WHEN request IN ('Source', 'External', 'Recover') AND why IS NULL THEN NULL WHEN why IS NOT NULL THEN nullif(string_split(why, '/')[2], '')
        WHEN fault = 'Cancel' THEN 'Cancelled' WHEN fault = 'CrashPrepared' OR (request = 'Preserve' AND fault = 'CrashPromoted') THEN NULL
        WHEN fault = 'Write' AND request = 'Preserve' THEN 'WorkingCopyExternallyModified' WHEN fault = 'Write' OR stale THEN 'WorkingCopyWriteFailed' END AS code
    FROM (
      SELECT *, (c IS NULL OR request = 'Regenerate') AND request <> 'Preserve' AND source IS DISTINCT FROM n.original AS stale,
        CASE WHEN request IN ('Source', 'External') THEN NULL WHEN stuck THEN 'RecoveryNeedsReview/ExternalModificationDuringRecovery' WHEN request = 'Recover' THEN NULL
          WHEN request = 'Restore' THEN CASE WHEN source IS NULL THEN 'Failed/WorkingCopyWriteFailed' WHEN c IS NOT NULL AND c.path <> path THEN 'Failed/OriginalIdentityMismatch' WHEN c IS NULL AND file IS NOT NULL THEN 'Failed/UntrackedWorkingCopy'
            WHEN c IS NOT NULL AND file IS DISTINCT FROM c.after THEN 'WorkingCopyExternallyModified/WorkingCopyExternallyModified' WHEN mutations = 0 THEN 'NoChanges/' END
          WHEN c IS NULL THEN 'Failed/NoWorkingCopy'
          WHEN request = 'Undo' THEN CASE WHEN c.kind <> 'Restore' THEN 'Failed/NoUndoableRestore' WHEN file IS DISTINCT FROM c.after THEN 'WorkingCopyExternallyModified/UndoHashMismatch' END
          WHEN n.after IS NULL THEN 'Failed/WorkingCopyWriteFailed' END AS why
      FROM (
        SELECT *, CAST(CASE request
            WHEN 'Restore' THEN {{'seq': seq, 'kind': request, 'before': file, 'after': sha, 'path': path, 'original': CASE WHEN c IS NULL THEN plan_sha ELSE c.original END, 'undoes': NULL}}
            WHEN 'Undo' THEN {{'seq': seq, 'kind': request, 'before': file, 'after': coalesce(sha, c.before, c.original), 'path': c.path, 'original': c.original, 'undoes': c.seq}}
            WHEN 'Preserve' THEN {{'seq': seq, 'kind': request, 'before': file, 'after': file, 'path': c.path, 'original': c.original, 'undoes': NULL}}
            WHEN 'Regenerate' THEN {{'seq': seq, 'kind': request, 'before': file, 'after': source, 'path': c.path, 'original': source, 'undoes': NULL}} END
          AS STRUCT(seq BIGINT, kind VARCHAR, before VARCHAR, after VARCHAR, path VARCHAR, original VARCHAR, undoes BIGINT)) AS n
        FROM (
          SELECT version_id, r.seq, r.request, r.sha, r.path, r.plan_sha, r.mutations, r.fault, s.source, s.file, coalesce(acts AND s.p IS NOT NULL AND NOT ends, false) AS stuck,
            CASE WHEN acts AND ends THEN s.p.seq END AS recovered_seq, CASE WHEN acts AND ends THEN CASE WHEN done THEN 'Completed' ELSE 'Failed' END END AS recovered_to,
            CASE WHEN acts AND done THEN s.p ELSE s.c END AS c, CASE WHEN acts AND ends THEN NULL ELSE s.p END AS p
          FROM (SELECT *, p IS NOT NULL AND file IS NOT DISTINCT FROM p.after AS done, p IS NOT NULL AND (file IS NOT DISTINCT FROM p.after OR file IS NOT DISTINCT FROM p.before) AS ends FROM st) s
          JOIN (SELECT *, request NOT IN ('Source', 'External') AS acts FROM requests) r USING (version_id) WHERE r.seq = s.seq + 1
        )
      )
    )
  )
)"""

COPIES_SQL = f"""WITH RECURSIVE {_FOLD_SQL}
SELECT version_id, seq, request, status, code, made, kind, before, after, undoes, recovered_seq, recovered_to, c.after AS copy, file FROM st WHERE seq > 0"""


def restore_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every operation on a working copy in its last state."""
    return wc.operations(stored(wc.outcomes(requests(spark, sf_dir)), "outcomes"))


_JOURNAL_SQL = """journal AS (
  SELECT m.version_id, m.seq, m.kind, m.before, m.after, m.undoes, coalesce(r.recovered_to, m.made) AS status
  FROM st m LEFT JOIN st r ON r.version_id = m.version_id AND r.recovered_seq = m.seq WHERE m.made IS NOT NULL
), operations AS (
  SELECT j.* REPLACE (CASE WHEN u.seq IS NOT NULL THEN 'Undone' ELSE j.status END AS status)
  FROM journal j LEFT JOIN journal u ON u.version_id = j.version_id AND u.undoes = j.seq AND u.status = 'Completed'
)"""


def restore_recoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last prepared operation of every version as if nothing had recovered it since, and what recovery would find."""
    found = stored(wc.outcomes(requests(spark, sf_dir)), "outcomes")
    # Versions that share a number meet in one journal, so that some have several prepared operations.
    merged = F.when(F.col("version_id") % 10 == 3, F.col("version_id") - 1).otherwise(F.col("version_id"))
    prepared = found.where(F.col("made") == wc.PREPARED).select(merged.alias("version_id"), F.struct("seq", "before", "after").alias("op"), F.col("version_id").alias("own"))
    last = prepared.groupBy("version_id", "own").agg(F.max("op").alias("op"))
    journal = last.select("version_id", "op.*", F.lit(wc.PREPARED).alias("status"))
    files = found.groupBy("version_id").agg(F.max_by("file", "seq").alias("sha"))
    return wc.recoveries(journal, files)


RECOVERIES_SQL = f"""WITH RECURSIVE {_FOLD_SQL},
last AS (SELECT version_id AS own, CASE WHEN version_id % 10 = 3 THEN version_id - 1 ELSE version_id END AS version_id, arg_max({{'b': before, 'a': after}}, seq) AS op FROM st WHERE made = 'Prepared' GROUP BY ALL),
files AS (SELECT version_id, arg_max({{'f': file}}, seq).f AS sha FROM st WHERE seq > 0 GROUP BY 1),
pending AS (SELECT version_id, count(*) AS n, any_value(op) AS op FROM last GROUP BY 1)
SELECT version_id, n, CASE WHEN n > 1 THEN 'RecoveryNeedsReview' WHEN sha IS NOT DISTINCT FROM op.a THEN 'Completed' WHEN sha IS NOT DISTINCT FROM op.b THEN 'Failed' ELSE 'RecoveryNeedsReview' END AS verdict,
  CASE WHEN n > 1 THEN 'MultiplePendingOperations' WHEN sha IS NOT DISTINCT FROM op.a OR sha IS NOT DISTINCT FROM op.b THEN NULL ELSE 'ExternalModificationDuringRecovery' END AS code
FROM pending LEFT JOIN files USING (version_id)"""

_ROOT = "/data"


def restore_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a comparison whose customer's contract is to be restored: the first gate that stops it."""
    o, c = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer")
    key, cust = F.col("o_orderkey"), F.col("c_custkey")
    text = lambda letter, x: F.concat(F.lit(letter), x.cast("string"))
    records = o.where(key % 31 != 0).select(key.alias("record_id"), (key % 17 == 0).alias("is_partial"), text("s", F.col("o_custkey")).alias("current_sha"))
    links = o.where(key % 13 != 0).select(key.alias("record_id"), F.col("o_custkey").alias("version_id"), F.when(key % 7 == 0, F.lit(0)).otherwise(F.col("o_custkey")).alias("snapshot_id"))
    versions = c.select(cust.alias("version_id"), cust.alias("snapshot_id"), F.when(cust % 11 == 0, "old").otherwise(text("s", cust)).alias("sha"), F.concat(F.lit("/in/"), cust.cast("string")).alias("path"))
    journal = c.where(cust % 2 == 0).select(cust.alias("version_id"), F.when(cust % 6 == 0, wc.PREPARED).otherwise(wc.COMPLETED).alias("status"))
    place = F.when(cust % 25 == 0, F.lit("/elsewhere.docx")).otherwise(wc.expected_place(_ROOT, cust))
    copies = c.where(cust % 5 == 0).select(cust.alias("version_id"), place.alias("path"), text("w", cust).alias("sha"), F.when(cust % 20 == 0, "Partial").otherwise("Complete").alias("parse_status"))
    linked = (cust % 19 == 0).alias("linked")
    files = c.where(cust % 23 != 0).select(F.concat(F.lit("/in/"), cust.cast("string")).alias("path"), F.when(cust % 9 == 0, "new").otherwise(text("S", cust)).alias("sha"), linked)
    files = files.unionByName(c.where(cust % 3 != 1).select(wc.expected_place(_ROOT, cust).alias("path"), text("W", cust).alias("sha"), linked))
    return wc.analysis_gates(o.select(key.alias("record_id")), records, links, versions, journal, copies, files, _ROOT)


_SAID = "\n  ".join(f"WHEN '{gate}' THEN '{{}}{said}'" for gate, (_, said) in wc.MESSAGES.items()).replace("{}", "")
_STATUS = " ".join(f"WHEN '{gate}' THEN '{status}'" for gate, (status, _) in wc.MESSAGES.items())

GATES_SQL = f"""WITH x AS (
  SELECT o_orderkey AS k, o_custkey AS c, c_custkey % 5 = 0 AS copied FROM orders LEFT JOIN customer ON c_custkey = o_custkey
), g AS (
  SELECT k, c, copied, CASE WHEN k % 31 = 0 OR k % 17 = 0 THEN 'Partial' WHEN k % 13 = 0 THEN 'Unlinked' WHEN k % 7 = 0 OR c % 11 = 0 THEN 'OtherVersion' WHEN c % 6 = 0 THEN 'Pending'
    WHEN c % 25 = 0 THEN 'OtherPlace' WHEN c % 20 = 0 THEN 'PartialCopy'
    WHEN NOT copied AND (c % 23 = 0 OR c % 9 = 0 OR c % 19 = 0) THEN 'SourceChanged' WHEN copied AND (c % 3 = 1 OR c % 19 = 0) THEN 'CopyChanged' ELSE 'Ready' END AS gate FROM x
)
SELECT k AS record_id, CASE WHEN gate NOT IN ('Partial', 'Unlinked', 'OtherVersion') THEN c END AS version_id, gate, CASE gate {_STATUS} END AS status,
  CASE gate {_SAID} END AS message, CASE WHEN gate = 'Ready' THEN CASE WHEN copied THEN '{_ROOT}/WorkingCopies/' || c || '/restored.docx' ELSE '/in/' || c END END AS source
FROM g"""

QUERIES = {
    "working_copies": (working_copies, COPIES_SQL),
    "restore_journal": (restore_journal, f"WITH RECURSIVE {_FOLD_SQL}, {_JOURNAL_SQL} SELECT * FROM operations"),
    "restore_recoveries": (restore_recoveries, RECOVERIES_SQL),
    "restore_gates": (restore_gates, GATES_SQL),
}

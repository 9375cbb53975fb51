"""Queries of the change feed and of incremental processing, with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changefeed import BucketedTable
from ..operators.worklist import listed, work_for_next_run
from ..session import scratch, table


def _replayed(spark: SparkSession, d: str) -> DataFrame:
    """The log applied in two deliveries (split halfway through the arrival times) to a new table."""
    wal = table(spark, d, "wal_records").select("seq", "op", "key", "value", "arrived_at")
    lo, hi = wal.agg(F.min("arrived_at"), F.max("arrived_at")).first()
    into = BucketedTable(spark, scratch(spark, "replay"))
    late = F.lit(False) if lo is None else F.coalesce(F.col("arrived_at") > F.lit(lo + (hi - lo) / 2), F.lit(False))
    into.apply(wal.where(~late), "first-delivery")
    into.apply(wal.where(late), "second-delivery")
    return into.live()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _replayed(spark, d).select("key", "seq")


def p3_current(spark: SparkSession, d: str) -> DataFrame:
    return _replayed(spark, d)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    work = work_for_next_run(spark, scratch(spark, "ledger"), table(spark, d, "index_requests"), table(spark, d, "file_hashes"), table(spark, d, "index_runs"))
    return work.select("id", "request_id")


def p4_processed(spark: SparkSession, d: str) -> DataFrame:
    """What was processed once all work is done, though a worker lost its lease on the way.

    The first worker leases all shards and stops; its leases run out. The second takes half of them
    over and commits. The first wakes up and tries to commit everything: it is fenced off. A third
    does the rest, and repeats a commit as after a lost answer. Nothing is skipped or repeated.
    """
    now = [0.0]
    tables = [table(spark, d, n) for n in ("index_requests", "file_hashes", "index_runs")]
    ledger = listed(spark, scratch(spark, "ledger"), *tables, shards=4, clock=lambda: now[0])
    at = dt.datetime(2100, 1, 1, tzinfo=dt.timezone.utc)

    def work(leases: list[dict]) -> list[bool]:
        done = []
        for lease in leases:
            mine = ledger.leased_items(lease)
            done.append(ledger.complete(lease, mine.select("id", "request_id"), mine, at))
        return done

    stale = ledger.lease("first", 60, 4)
    now[0] = 61
    work(ledger.lease("second", 60, 2))
    now[0] = 122
    again = ledger.lease("third", 60, 4)
    assert not any(work(stale))
    assert all(work(again)) and ledger.complete(again[0], tables[0].limit(0), tables[0].limit(0), at)
    ledger.fold()
    assert ledger.pending().isEmpty()
    done = ledger.results()
    return done if done is not None else spark.createDataFrame([], "id string, request_id long")


_APPLICABLE = r"""
WITH named AS (
  SELECT key, seq, value, lower(regexp_replace(op, '^\s+|\s+$', '', 'g')) AS o FROM wal_records
), records AS (
  SELECT key, seq, value, o IN ('delete', '2') AS deleted FROM named
  WHERE o IN ('put', '1', 'delete', '2') AND seq IS NOT NULL AND key <> ''
    AND NOT (o IN ('delete', '2') AND coalesce(value, '') <> '')
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC, deleted DESC) AS n FROM records
)
"""

QUERIES = {"p3_found": p3_found, "p3_current": p3_current, "p4_found": p4_found, "p4_processed": p4_processed}

SQL = {
    "p3_found": _APPLICABLE + "SELECT key, seq FROM ordered WHERE n = 1 AND NOT deleted",
    "p3_current": _APPLICABLE + "SELECT key, seq, value FROM ordered WHERE n = 1 AND NOT deleted",
    "p4_found": r"""
WITH req AS (
  SELECT id, request_id, sha256(data) AS sha,
    row_number() OVER (PARTITION BY id ORDER BY received_at DESC NULLS LAST, request_id DESC) AS n
  FROM index_requests WHERE data IS NOT NULL AND regexp_matches(id, '\S')
), rec AS (
  SELECT path, lower(sha256) AS sha, row_number() OVER (PARTITION BY path ORDER BY marked_at DESC NULLS LAST, run_id DESC) AS n
  FROM file_hashes WHERE run_id IN (SELECT run_id FROM index_runs WHERE status = 'committed')
)
SELECT id, request_id FROM req LEFT JOIN rec ON rec.path = req.id AND rec.n = 1
WHERE req.n = 1 AND (rec.sha IS NULL OR rec.sha <> req.sha)
""",
}

SQL["p4_processed"] = SQL["p4_found"]

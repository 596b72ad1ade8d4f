"""Query of the general data-pipeline problem (number 4) and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import incremental as inc
from sievework.session import table, work_path

#: State partitions at the scale of the test tables; a parameter of every operator function.
PARTITIONS = 32


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashes, runs = table(spark, sf_dir, "file_hashes"), table(spark, sf_dir, "index_runs")
    path = work_path(spark, "p4-state")
    inc.write_state(inc.committed_state(hashes, runs, PARTITIONS), path)
    found = inc.changed_files(spark, inc.pending_records(hashes, runs, PARTITIONS), path)
    return found.select("repo", "file_path").distinct()


def p4_after_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after the running attempt was committed: one row per file, by run."""
    hashes, runs = table(spark, sf_dir, "file_hashes"), table(spark, sf_dir, "index_runs")
    path = work_path(spark, "p4-state")
    inc.write_state(inc.committed_state(hashes, runs, PARTITIONS), path)
    inc.apply_changes(spark, inc.pending_records(hashes, runs, PARTITIONS), path)
    return inc.read_state(spark, path).groupBy("repo").agg(
        F.count(F.lit(1)).alias("files"), F.countDistinct("digest").alias("digests")
    )


_RECORDS = """
    SELECT repo, file_path, regexp_replace(lower(trim(content_hash)), '^sha256:', '') AS digest,
           h.run_id, h.attempt, recorded_at, ingested_at, r.status
    FROM file_hashes h JOIN index_runs r ON h.run_id = r.run_id AND h.attempt = r.attempt
"""
_STATES = f"""
    WITH rec AS ({_RECORDS}),
    old AS (SELECT repo, file_path, digest FROM (
        SELECT *, row_number() OVER (PARTITION BY repo, file_path
            ORDER BY run_id DESC, attempt DESC, recorded_at DESC, ingested_at DESC, digest DESC) AS k
        FROM rec WHERE status = 'succeeded') WHERE k = 1),
    cur AS (SELECT repo, file_path, digest FROM (
        SELECT *, row_number() OVER (PARTITION BY repo, file_path
            ORDER BY recorded_at DESC, ingested_at DESC, digest DESC) AS k
        FROM rec WHERE status = 'running') WHERE k = 1)
"""

QUERIES = {"p4_found": p4_found, "p4_after_commit": p4_after_commit}

SQL = {
    "p4_found": f"""{_STATES}
        SELECT cur.repo, cur.file_path FROM cur LEFT JOIN old ON cur.repo = old.repo AND cur.file_path = old.file_path
        WHERE old.digest IS NULL OR old.digest <> cur.digest""",
    "p4_after_commit": f"""{_STATES}
        SELECT repo, count(*) AS files, count(DISTINCT digest) AS digests FROM (
            SELECT coalesce(cur.repo, old.repo) AS repo, coalesce(cur.digest, old.digest) AS digest
            FROM cur FULL JOIN old ON cur.repo = old.repo AND cur.file_path = old.file_path)
        GROUP BY repo""",
}

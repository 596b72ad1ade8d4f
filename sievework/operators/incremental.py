"""Processing only new or changed records.

A record is a file seen by an attempt of a run. The state keeps, for each file, the digest that the
last *successful* attempt recorded. State and incoming records are divided into partitions by a
hash of (repo, directory of the file) and some bits of the file's own hash, so that files of one
directory stay together and a directory that holds a third of all files is still spread over
``SPREAD`` partitions. Each partition has a fingerprint, its number of files and the sum of their
row hashes, which is stored beside the state. Addition commutes, so fingerprints are computed with
a map-side combine and do not depend on order, on how files were spread over tasks or on retries.
A run

1. reduces the incoming records to one row per file (the latest ``recorded_at``),
2. compares their fingerprints with the stored ones (a few numbers per partition) and drops
   partitions that did not change; neither files nor state are joined for that,
3. reads the state of the remaining partitions only, by their folders, and compares digests,
4. after success writes the new content of each changed partition by dynamic partition overwrite
   into a folder of the next version, then the fingerprints of all partitions with their versions,
   and at last renames a pointer to that version over the old one. What no version names any more
   is deleted afterwards.

An attempt that stopped half-way has other fingerprints than the whole: its partitions are then
compared file by file, which costs time and changes no result.

The pointer is the commit. A run that dies before leaves the old version untouched, whatever it
wrote, and its repetition overwrites that; one that dies after it leaves only rubbish, which the
next commit deletes. So nothing is skipped, and a run repeated after its commit finds no difference.

Edge cases: rows with a null ``repo``, ``file_path`` or digest identify nothing and are ignored;
repeated rows and ties on ``recorded_at`` are settled by later ``ingested_at``, then the larger
digest; an empty input gives no rows; a state that was never written is empty; columns other than
those named are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.session import cut, names_in, read_text, remove, write_text

KEYS = ("repo", "file_path")
STATE = "repo string, file_path string, digest string, run_id int, attempt int, recorded_at timestamp, part int, version int"
FINGERPRINT = "part int, version int, files long, hash_sum decimal(38,0)"
#: Partitions over which the files of one directory are spread, and files that write one partition.
SPREAD, WRITERS = 8, 4


def digest_key(content_hash: Column) -> Column:
    """A digest without algorithm prefix, blanks and letter case."""
    bare = F.regexp_replace(F.lower(F.trim(content_hash)), r"^(sha-?256|sha2-256|0x)[:=\s-]*|^0x", "")
    return F.when(bare != "", bare)


def part_of(partitions: int) -> Column:
    """The state partition of a file: one of a few that belong to its directory."""
    folder = F.regexp_replace("file_path", r"[^/]*$", "")
    return F.pmod(F.xxhash64("repo", folder) + F.pmod(F.xxhash64("file_path"), F.lit(SPREAD)), F.lit(partitions)).cast("int")


def fingerprints(df: DataFrame) -> DataFrame:
    """Per partition: the number of files and the sum of their row hashes."""
    row_hash = F.xxhash64("repo", "file_path", "digest").cast("decimal(38,0)")
    return df.groupBy("part").agg(F.count(F.lit(1)).alias("files"), F.sum(row_hash).cast("decimal(38,0)").alias("hash_sum"))


def _records(file_hashes: DataFrame, partitions: int) -> DataFrame:
    return (
        file_hashes.select(
            "repo", "file_path", digest_key(F.col("content_hash")).alias("digest"),
            "run_id", "attempt", "recorded_at", "ingested_at",
        )
        .where("repo is not null and file_path is not null and digest is not null")
        .withColumn("part", part_of(partitions))
    )


def _latest(records: DataFrame, *order: str) -> DataFrame:
    """One row per file: the greatest by ``order``, reduced in each task before the shuffle."""
    best = F.max(F.struct(*order, "digest", "run_id", "attempt", "recorded_at")).alias("best")
    return records.groupBy(*KEYS, "part").agg(best).select(
        *KEYS, *[F.col(f"best.{c}").alias(c) for c in ("digest", "run_id", "attempt", "recorded_at")], "part"
    )


def committed_state(file_hashes: DataFrame, index_runs: DataFrame, partitions: int) -> DataFrame:
    """Per file what the succeeded attempt with the highest run recorded."""
    done = index_runs.where(F.lower(F.trim("status")) == "succeeded").select("run_id", "attempt").distinct()
    records = _records(file_hashes, partitions).join(done, ["run_id", "attempt"], "left_semi")
    return _latest(
        records.withColumn("run_no", F.col("run_id")).withColumn("attempt_no", F.col("attempt")).withColumn("at", F.col("recorded_at")),
        "run_no", "attempt_no", "at", "ingested_at",
    )


def pending_records(file_hashes: DataFrame, index_runs: DataFrame, partitions: int, status: str = "running") -> DataFrame:
    """Per file the latest record of the attempts with the given status."""
    open_runs = index_runs.where(F.lower(F.trim("status")) == status).select("run_id", "attempt").distinct()
    records = _records(file_hashes, partitions).join(open_runs, ["run_id", "attempt"], "left_semi")
    return _latest(records.withColumn("at", F.col("recorded_at")), "at", "ingested_at")


COLUMNS = (*KEYS, "digest", "run_id", "attempt", "recorded_at", "part")


def current_version(spark: SparkSession, path: str) -> int:
    """The committed version of a state; 0 if there is none."""
    return int(read_text(spark, f"{path}/_current") or 0)


def stored_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """part, version, files, hash_sum of the committed state: one row per partition."""
    version = current_version(spark, path)
    return spark.read.schema(FINGERPRINT).parquet(f"{path}/_fingerprints/{version}") if version else spark.createDataFrame([], FINGERPRINT)


def read_state(spark: SparkSession, path: str, parts: list[int] | None = None) -> DataFrame:
    """The committed state, or some partitions of it: only their folders are listed and read."""
    live = stored_fingerprints(spark, path).select("part", "version").collect()  # one row per partition
    folders = [f"{path}/data/part={r.part}/version={r.version}" for r in live if parts is None or r.part in set(parts)]
    if not folders:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).option("basePath", f"{path}/data").parquet(*folders)


def write_partitions(rows: DataFrame, path: str, version: int) -> None:
    """Step 1 of a commit: each partition of ``rows`` as a whole into the folder of a version; repeatable."""
    salted = rows.select(*COLUMNS).withColumn("version", F.lit(version)).repartition("part", F.pmod(F.xxhash64("file_path"), F.lit(WRITERS)))
    salted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "version").parquet(f"{path}/data")


def write_fingerprints(spark: SparkSession, path: str, version: int, parts: list[int]) -> None:
    """Step 2: fingerprints of the written partitions, taken from what was written, and the old ones of all others."""
    folders = [f"{path}/data/part={p}/version={version}" for p in parts]
    fresh = fingerprints(spark.read.schema(STATE).option("basePath", f"{path}/data").parquet(*folders)).withColumn("version", F.lit(version)) if folders else spark.createDataFrame([], FINGERPRINT)
    kept = stored_fingerprints(spark, path).where(~F.col("part").isin(parts))
    fresh.select("part", "version", "files", "hash_sum").unionByName(kept).coalesce(1).write.mode("overwrite").parquet(f"{path}/_fingerprints/{version}")


def swap_pointer(spark: SparkSession, path: str, version: int) -> None:
    """Step 3, the commit."""
    write_text(spark, f"{path}/_current", str(version))


def sweep(spark: SparkSession, path: str) -> None:
    """Step 4: delete folders that the committed version does not name."""
    version = current_version(spark, path)
    live = {(r.part, r.version) for r in stored_fingerprints(spark, path).collect()}
    for part in names_in(spark, f"{path}/data"):
        if part.startswith("part="):
            for v in names_in(spark, f"{path}/data/{part}"):
                if v.startswith("version=") and (int(part[5:]), int(v[8:])) not in live:
                    remove(spark, f"{path}/data/{part}/{v}")
    for v in names_in(spark, f"{path}/_fingerprints"):
        if v != str(version):
            remove(spark, f"{path}/_fingerprints/{v}")


def write_state(rows: DataFrame, path: str) -> None:
    """Replace those partitions of the state that ``rows`` has rows for, each as a whole, by one commit."""
    spark = rows.sparkSession
    version = current_version(spark, path) + 1
    rows = cut(rows.select(*COLUMNS))
    parts = [r.part for r in rows.select("part").distinct().collect()]  # at most as many as partitions
    write_partitions(rows, path, version)
    write_fingerprints(spark, path, version, parts)
    swap_pointer(spark, path, version)
    sweep(spark, path)


def changed_partitions(incoming: DataFrame, stored: DataFrame) -> list[int]:
    """Partitions of the input whose fingerprint differs from the stored one; at most as many as partitions."""
    a, b = fingerprints(incoming).alias("a"), F.broadcast(stored).alias("b")  # one row per partition
    same = (F.col("a.files") == F.col("b.files")) & (F.col("a.hash_sum") == F.col("b.hash_sum"))
    return [r.part for r in a.join(b, "part", "left").where(~F.coalesce(same, F.lit(False))).select("part").collect()]


def changed_files(spark: SparkSession, incoming: DataFrame, path: str) -> DataFrame:
    """New and changed files, compared only in partitions whose fingerprint changed."""
    incoming = cut(incoming)
    parts = changed_partitions(incoming, stored_fingerprints(spark, path))
    old = read_state(spark, path, parts).select(*KEYS, F.col("digest").alias("old_digest"))
    return incoming.where(F.col("part").isin(parts)).join(old, list(KEYS), "left").where(
        F.col("old_digest").isNull() | (F.col("old_digest") != F.col("digest"))
    ).select(*KEYS, "digest", "old_digest", "run_id", "attempt", "recorded_at", "part")


def apply_changes(spark: SparkSession, incoming: DataFrame, path: str) -> int:
    """Bring the state at ``path`` up to date; returns the number of partitions replaced."""
    changed = cut(changed_files(spark, incoming, path))
    parts = [r.part for r in changed.select("part").distinct().collect()]  # at most as many as partitions
    if parts:
        fresh = changed.select(*COLUMNS)
        kept = read_state(spark, path, parts).join(fresh, list(KEYS), "left_anti").select(*COLUMNS)
        write_state(fresh.unionByName(kept), path)
    return len(parts)

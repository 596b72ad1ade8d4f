"""The persisted index: versioned folders and a pointer that is swapped when a version is complete."""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

FORMAT = "2"
SCHEMAS = {
    "chunks": "id string, repo string, file_path string, line_start int, line_end int, content string, language string, symbol_type string, symbol_name string, part_index int",
    "references": "repo string, file_path string, line int, callee string, qualifier string, caller string",
    "type_relations": "repo string, file_path string, line int, owner string, target string",
    "file_index_state": "repo string, file_path string, language string, status string, tree_has_error boolean, tier0_fallback boolean, chunk_count long",
    "file_hashes": "repo string, file_path string, content_hash string",
    "postings": "repo string, id string, field string, term string, tf long, size int",
    "lengths": "repo string, field string, docs long, mean double",
    "vectors": "repo string, id string, vector array<float>",
}
#: Tables that searches read instead of content.
SEARCH_TABLES = ("postings", "lengths", "vectors")


@contextmanager
def index_lock(root: str, stale_s: float = 3600):
    """One writer per index, across processes; a lock older than ``stale_s`` belongs to a dead one."""
    path = os.path.join(root, ".lock")
    os.makedirs(root, exist_ok=True)
    while True:
        try:
            os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            break
        except FileExistsError:
            if time.time() - os.path.getmtime(path) > stale_s:
                os.unlink(path)
                continue
            raise RuntimeError(f"{root} is being written") from None
    try:
        yield
    finally:
        os.unlink(path)


def publish(tables: dict[str, DataFrame], root: str, meta: dict[str, str] | None = None) -> str:
    """Writes all tables to a new version and then moves the pointer; readers see the old version until then."""
    missing = set(SCHEMAS) - set(tables)
    if missing:
        raise ValueError(f"tables missing: {sorted(missing)}")
    version = f"v-{uuid.uuid4().hex}"
    with index_lock(root):
        for name, df in tables.items():
            df.write.parquet(f"file://{os.path.abspath(root)}/{version}/{name}")
        pointer = os.path.join(root, "CURRENT")
        with open(pointer + ".new", "w") as f:
            json.dump({"version": version, "format": FORMAT, **(meta or {})}, f)
        os.replace(pointer + ".new", pointer)
    return version


def seed(source: str, target: str) -> str:
    """A copy of another index's current version to start from, as for a second working tree; an update follows."""
    with open(os.path.join(source, "CURRENT")) as f:
        meta = json.load(f)
    with index_lock(target):
        shutil.copytree(os.path.join(source, meta["version"]), os.path.join(target, meta["version"]), dirs_exist_ok=True)
        with open(os.path.join(target, "CURRENT.new"), "w") as f:
            json.dump(meta, f)
        os.replace(os.path.join(target, "CURRENT.new"), os.path.join(target, "CURRENT"))
    return meta["version"]


def open_index(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the current version; never creates anything, and refuses another format."""
    with open(os.path.join(root, "CURRENT")) as f:
        meta = json.load(f)
    if meta.get("format") != FORMAT:
        raise ValueError(f"index format {meta.get('format')}, this library reads {FORMAT}")
    base = f"{os.path.abspath(root)}/{meta['version']}"
    absent = [n for n in SCHEMAS if not os.path.isdir(f"{base}/{n}")]
    if absent:
        raise ValueError(f"index is incomplete: {absent}")
    return {n: spark.read.schema(s).parquet(f"file://{base}/{n}") for n, s in SCHEMAS.items()}


def union_indexes(indexes: list[DataFrame], most: int = 8) -> DataFrame:
    """The same table of several indexes with the number of its index, the first of equal ones only."""
    from functools import reduce

    from pyspark.sql import functions as F

    if len(indexes) > most:
        raise ValueError(f"at most {most} indexes")
    return reduce(DataFrame.unionByName, [d.withColumn("index_no", F.lit(i)) for i, d in enumerate(indexes)])

"""Session helpers: tables, shared work folders and lineage cuts.

All state that outlives one stage is written below the folder that the cluster names in
``spark.checkpoint.dir`` so that it survives the loss of any executor. A folder of our own is
used only where that setting is absent, as in tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes up to which a side that was measured may be broadcast.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, taken from the session; a folder of this machine only where everything runs on it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), f"sievework-{os.getuid()}")
        os.makedirs(found, exist_ok=True)
        found = f"file://{found}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table written by one run; deleted with the checkpoints when the application ends."""
    context = spark.sparkContext
    base = f"{shared_dir(spark)}/sievework-{context.applicationId}"
    if getattr(context, "_sievework_work", None) != base:
        for folder in (base, context.getCheckpointDir()):
            fs, path = filesystem(spark, folder)
            fs.mkdirs(path)
            fs.deleteOnExit(path)
        context._sievework_work = base
    return f"{base}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise a DataFrame in the shared folder and forget how it was computed."""
    work_path(df.sparkSession, "cut")
    return df.checkpoint(eager=True)


# ---------------------------------------------------------------- files of any Hadoop file system
def filesystem(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = filesystem(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, replace: bool = True) -> bool:
    """Write a small file whole: aside first, then renamed over the old one. Without ``replace``, False if it exists."""
    fs, p = filesystem(spark, path)
    if not replace:
        try:
            stream = fs.create(p, False)
        except Exception as e:
            if "already exists" in str(e).lower() or "FileAlreadyExists" in str(e):
                return False
            raise
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        return True
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(aside, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    rename(spark, aside.toString(), path)
    return True


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file over another in one step."""
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    fs, a = filesystem(spark, source)
    _, b = filesystem(spark, target)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(a), fs.makeQualified(b), options)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    fs, p = filesystem(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, on a cluster too; once per application."""
    context = spark.sparkContext
    if getattr(context, "_sievework_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="sievework-")) / "sievework.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(target))
    context._sievework_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, most: int = BROADCAST_BYTES):
    """``df`` with a broadcast hint if its rows hold at most ``most`` bytes, else unchanged.

    The size is measured by reading it; pass only what is already materialised.
    """
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    size = F.lit(16 * len(df.columns))
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            size = size + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0))
    measured = df.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(df) if measured <= most else df

"""Keeping an index up to date: staleness, repair, reuse of embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def staleness(stored: DataFrame, current: DataFrame) -> DataFrame:
    """repo, file_path, change: added, modified, deleted or unchanged, from digests on both sides."""
    a = stored.select("repo", "file_path", F.col("content_hash").alias("old"))
    b = current.select("repo", "file_path", F.col("content_hash").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified").otherwise("unchanged")
    return a.join(b, ["repo", "file_path"], "full").select("repo", "file_path", change.alias("change"))


def replace_files(table: DataFrame, touched: DataFrame, fresh: DataFrame) -> DataFrame:
    """A table of rows by file after an update: touched files lose their rows, fresh rows come in."""
    kept = table.join(touched.select("repo", "file_path").distinct(), ["repo", "file_path"], "left_anti")
    return kept.unionByName(fresh)


def missing_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    return chunks.join(vectors.select(F.col("chunk_id").alias("id")).distinct(), "id", "left_anti")


def orphans(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    return vectors.join(chunks.select(F.col("id").alias("chunk_id")).distinct(), "chunk_id", "left_anti")


def embed_with_reuse(texts: DataFrame, saved: DataFrame, embed, identity: str) -> DataFrame:
    """id, key, vector, identity: texts embedded before by the same model keep their vectors, others are embedded once per distinct text."""
    keyed = texts.withColumn("key", F.sha2("text", 256))
    known = saved.where(F.col("identity") == identity).select("key", "vector").dropDuplicates(["key"])
    have = keyed.join(known, "key")
    new = keyed.join(known, "key", "left_anti")
    made = new.dropDuplicates(["key"]).select("key", embed("text").alias("vector"))
    return have.select("id", "key", "vector").unionByName(new.join(made, "key").select("id", "key", "vector")).withColumn("identity", F.lit(identity))

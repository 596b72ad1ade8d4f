"""The verbs of the engine over a source tree and a persisted index."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import chunking, filters, graph, retrieval, search, stats, update
from sievework.session import cut, ship_package
from sievework.sources import files as source
from sievework.sources import index as store


class Engine:
    """Builds, updates and queries the index of one source tree."""

    def __init__(self, spark: SparkSession, index_root: str, embed=None):
        """``embed``: a pandas UDF from text to vector; a stand-in that hashes words where none is given."""
        self.spark, self.root, self.embed = spark, index_root, embed
        ship_package(spark)

    # ------------------------------------------------------------ writing
    def _tables(self, files: DataFrame, repo: str) -> dict[str, DataFrame]:
        rows = files.select(F.lit(repo).alias("repo"), F.col("relative_path").alias("file_path"), "language", "content", "content_hash")
        chunks = cut(chunking.chunk_files(rows))
        counted = chunks.groupBy("repo", "file_path").agg(F.count("*").alias("chunk_count"), F.max(F.col("symbol_name").isNotNull()).alias("named"))
        readable = ["python", *chunking.HEADS]
        state = rows.join(counted, ["repo", "file_path"], "left").select(
            "repo", "file_path", "language", F.when(F.col("chunk_count").isNull() & (F.trim("content") != ""), "parse_error").otherwise("indexed").alias("status"),
            F.lit(False).alias("tree_has_error"), (F.col("language").isin(*readable) & ~F.coalesce("named", F.lit(False))).alias("tier0_fallback"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
        )
        return {
            "chunks": chunks,
            "references": graph.call_edges(chunks),
            "type_relations": graph.type_relations(chunks),
            "file_index_state": state,
            "file_hashes": rows.select("repo", "file_path", "content_hash"),
        }

    def index(self, tree: str, repo: str, **options) -> str:
        """Builds a new version from a tree; readers keep the old one until it is complete."""
        tables = self._tables(source.discover(self.spark, tree, **options), repo)
        return store.publish(tables | retrieval.search_tables(tables["chunks"], self.embed), self.root, {"repo": repo})

    def staleness(self, tree: str, repo: str, **options) -> DataFrame:
        now = source.discover(self.spark, tree, **options).select(F.lit(repo).alias("repo"), F.col("relative_path").alias("file_path"), "content_hash")
        return update.staleness(self.tables()["file_hashes"], now)

    def update(self, tree: str, repo: str, **options) -> dict[str, int]:
        """Brings the index up to date: only added and modified files are parsed again."""
        old = self.tables()
        found = source.discover(self.spark, tree, **options)
        now = found.select(F.lit(repo).alias("repo"), F.col("relative_path").alias("file_path"), "content_hash")
        changes = update.staleness(old["file_hashes"], now).cache()
        counts = {r.change: r["count"] for r in changes.groupBy("change").count().collect()}
        if set(counts) - {"unchanged"}:
            touched = changes.where("change != 'unchanged'")
            again = touched.where("change != 'deleted'").select(F.col("file_path").alias("relative_path"))
            fresh = self._tables(found.join(again, "relative_path", "left_semi"), repo)
            kept = {n: update.replace_files(old[n], touched, fresh[n]) for n in fresh}
            found_by = retrieval.updated_search_tables(old, touched, old["chunks"], fresh["chunks"], self.embed)
            store.publish(kept | found_by, self.root, {"repo": repo})
        changes.unpersist()
        return counts

    # ------------------------------------------------------------ reading
    def tables(self) -> dict[str, DataFrame]:
        return store.open_index(self.spark, self.root)

    def search(self, queries: str | Sequence[str], repo: str, limit: int = 5, where: filters.SearchFilters | None = None) -> DataFrame:
        asked = [queries] if isinstance(queries, str) else list(queries)
        q = self.spark.createDataFrame([(i, repo, x) for i, x in enumerate(asked)], "query_id int, repo string, query string")
        tables = self.tables()
        stored = {n: tables[n] for n in store.SEARCH_TABLES}
        return search.search(tables["chunks"], q, limit, (where or filters.SearchFilters()).condition(), stored, self.embed).orderBy("query_id", "rank")

    def grep(self, pattern: str, context: int = 2, limit: int = 20, case_sensitive: bool = True) -> DataFrame:
        return graph.regex_search(self.tables()["chunks"], pattern, context, case_sensitive).orderBy("repo", "file_path", "line").limit(limit)

    def references(self, symbol: str, limit: int = 20, calls_of: bool = False) -> DataFrame:
        """Calls of a symbol, or with ``calls_of`` the calls that it makes."""
        edges = self.tables()["references"]
        key = F.lower("caller") if calls_of else F.lower("callee")
        return edges.where(key == symbol.lower()).orderBy("repo", "file_path", "line").limit(limit)

    def structural(self, intent: str, name: str | None = None, limit: int = 20) -> DataFrame:
        """intent: definitions, implementations, env, routes or sql."""
        tables = self.tables()
        chunks = tables["chunks"]
        if intent == "definitions":
            rows = graph.definitions(chunks)
            exact = rows.where(F.col("symbol_name") == name) if name else rows
            rows = exact if not name or exact.limit(1).count() else rows.where(F.lower("symbol_name") == name.lower())
        elif intent == "implementations":
            rows = tables["type_relations"].where(F.lower("target") == (name or "").lower())
        else:
            patterns = {"env": (graph.ENV_READS, 1), "routes": (graph.ROUTES, 2), "sql": (graph.SQL_SITES, 1)}
            if intent not in patterns:
                raise ValueError(f"unknown intent {intent}")
            if name and intent != "env":
                raise ValueError(f"{intent} takes no name")
            rows = graph.matches(chunking.masked(chunks), *patterns[intent])  # not what comments mention
            rows = rows.where(F.lower("g1") == name.lower()) if name else rows
        return rows.orderBy("repo", "file_path").limit(limit)

    def dead_code(self, limit: int = 20) -> DataFrame:
        t = self.tables()
        return graph.dead_symbols(t["chunks"], t["references"]).orderBy("repo", "file_path", "line").limit(limit)

    def stats(self) -> DataFrame:
        return stats.language_stats(self.tables()["chunks"])

    def health(self) -> DataFrame:
        return stats.index_health(self.tables()["file_index_state"])

    def overview(self, directories: int = 15, hotspots: int = 10) -> dict[str, DataFrame]:
        c = self.tables()["chunks"]
        return {
            "languages": stats.language_stats(c), "directories": stats.top_directories(c, directories), "symbol types": stats.symbol_types(c), "entry points": stats.entry_points(c),
            "hotspots": stats.hotspots(c, hotspots), "conventions": stats.conventions(c), "counts": stats.counts(c),
        }

    def explain_path(self, tree: str, path: str, **options) -> tuple[str, str]:
        return source.explain_path(self.spark, os.path.abspath(tree), path, **options)

"""Exact candidates in front of ranked search, list limits and priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import text as t


def pool_size(kind: Column, limit: int) -> Column:
    """Candidates that vector search fetches for a result limit, by kind of query."""
    return F.greatest(F.when(kind == "natural", limit * 5).otherwise(limit * 3), F.lit(50))


def lexical_pool(query: Column, limit: int) -> Column:
    """Candidates that lexical search fetches: paths, natural language, one or two words, others."""
    words = F.size(F.filter(F.split(F.trim(query), r"\s+"), lambda w: w != ""))
    path = query.rlike(r"[/\\]")
    n = limit
    return F.when(path, max(5 * n, 100)).when(t.query_kind(query) == "natural", max(4 * n, n + 40)).when(words <= 2, max(4 * n, 80)).otherwise(max(3 * n, n + 20))


def fetch_limit(query: Column, limit: int, filtered: bool = False, globs: bool = False, exact_paths: bool = False, symbol_type: bool = False) -> Column:
    """Candidates that a search fetches before ranking: more where something is filtered or a question is broad."""
    least = max(3 * limit, limit + 20) if filtered else limit
    least = max(least, 10 * limit, limit + 100) if globs else least
    least = max(least, 12 * limit, limit + 200) if exact_paths else least
    words = F.size(F.filter(F.split(F.trim(query), r"\s+"), lambda w: w != ""))
    natural = t.query_kind(query) == "natural"
    broad = natural & (words >= 4) & ~query.rlike(r"[/\\\\]") & F.lit(not (globs or exact_paths or symbol_type))
    return F.when(broad, max(least, 8 * limit, limit + 140)).when(natural, max(least, 3 * limit, limit + 40)).otherwise(least)


def raw_lexical_pool(limit: int, filtered: bool = False) -> int:
    """Raw hits behind a lexical list of a limit."""
    return min(max(24 * limit, limit + 1000), 20_000) if filtered else max(2 * limit, limit + 10)


def raw_vector_pool(limit: int, rows: int) -> int:
    """Raw hits behind a vector list of a limit; no more than there are rows."""
    return min(max(limit * 3 // 2, limit + 10), rows)


def rerank_depth(limit: int, configured: int = 20) -> int:
    return max(configured, limit)


def filename_candidates(chunks: DataFrame, queries: DataFrame, most: int = 20) -> DataFrame:
    """query_id, file_path, depth: files named like a word of the query that has an extension or like the last part of a path, shallow ones first."""
    words = F.filter(F.split(F.lower(F.trim("query")), r"\s+"), lambda w: w.rlike(r"\.[a-z0-9]+$"))
    names = queries.select("query_id", "repo", F.explode(F.array_distinct(F.transform(words, lambda w: F.regexp_extract(w, r"[^/\\\\]*$", 0)))).alias("name"))
    files = chunks.select("repo", "file_path").distinct().select("repo", "file_path", t.depth(F.col("file_path")).alias("depth"), F.lower(t.file_name(F.col("file_path"))).alias("name"))
    hits = files.join(names, ["repo", "name"]).select("query_id", "file_path", "depth").distinct()
    w = Window.partitionBy("query_id").orderBy("depth", "file_path")
    return hits.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


PUBLIC = r"(?m)^\s*(?:pub\b|export\b|public\b)"


def exact_order(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Exact symbols (query_id, id, kind) with their place: equal case first, public ones, types before functions where a name is capitalised, shallow files, early lines."""
    c = chunks.select("id", "file_path", "line_start", "symbol_type", "symbol_name", F.coalesce("content", F.lit("")).rlike(PUBLIC).alias("public"))
    rows = hits.join(c, "id")
    mismatch = F.col("symbol_name").rlike(r"^\p{Lu}") & F.lower("symbol_type").isin("function", "method") & (F.col("kind") != 0)
    order = ["kind", (~F.col("public")).cast("int"), F.coalesce(mismatch, F.lit(False)).cast("int"), t.depth(F.col("file_path")), F.coalesce("line_start", F.lit(0)), "file_path", "id"]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).select("query_id", "id", "kind", "place")


def exact_symbols(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, id, kind: symbols named like a word of the query; 0 with equal case, 1 otherwise.

    Joined by repository and lower-case word, so a query meets only symbols it names.
    """
    words = queries.select("query_id", "repo", F.explode(F.array_distinct(F.regexp_extract_all("query", F.lit(r"[A-Za-z_]\w*"), F.lit(0)))).alias("word"))
    named = chunks.where("symbol_name is not null").select("repo", "id", "symbol_name", F.lower("symbol_name").alias("key"))
    hits = named.join(words.withColumn("key", F.lower("word")), ["repo", "key"])
    return hits.groupBy("query_id", "id").agg(F.min(F.when(F.col("word") == F.col("symbol_name"), 0).otherwise(1)).alias("kind"))


def stem_files(chunks: DataFrame, queries: DataFrame, most: int = 20) -> DataFrame:
    """query_id, file_path, depth: files whose stem holds a word of the query, shallow ones first."""
    words = queries.select("query_id", "repo", F.explode(F.array_distinct(t.analyze(F.col("query")))).alias("word")).where("length(word) >= 4")
    files = chunks.select("repo", "file_path").distinct()
    parts = files.select("repo", "file_path", t.depth(F.col("file_path")).alias("depth"), F.explode(F.array_distinct(t.analyze(F.translate(t.file_stem(F.col("file_path")), "_-.", "   ")))).alias("word"))
    hits = parts.join(words, ["repo", "word"]).select("query_id", "file_path", "depth").distinct()
    w = Window.partitionBy("query_id").orderBy("depth", "file_path")
    return hits.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def concept_files(chunks: DataFrame, queries: DataFrame, files: int = 3, per_file: int = 4) -> DataFrame:
    """query_id, id: definitions of the few files whose stem holds most words of a query of one to five words, for queries that name no symbol."""
    words = F.size(F.filter(t.analyze(F.col("query")), lambda w: F.length(w) >= 4))
    asked = queries.where(words.between(1, 5)).join(exact_symbols(chunks, queries).select("query_id").distinct(), "query_id", "left_anti")
    near = stem_files(chunks, asked).join(asked.select("query_id", "repo"), "query_id")
    first = Window.partitionBy("query_id").orderBy("depth", "file_path")
    near = near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= files)
    defined = chunks.where("symbol_name is not null").select("repo", "file_path", "id", F.coalesce("line_start", F.lit(0)).alias("rank"))
    return cap_per_file(near.join(defined, ["repo", "file_path"]), per_file).select("query_id", "id")


def cap_per_file(ranked: DataFrame, most: int = 4) -> DataFrame:
    """At most so many results of a file for each query, the best ones."""
    w = Window.partitionBy("query_id", "file_path").orderBy("rank")
    return ranked.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)


CLASS_PRIORITY = ("source", "config", "unknown", "test", "example", "benchmark", "docs", "archive", "runtime", "generated")


def scan_order(files: DataFrame) -> DataFrame:
    """Files in the order in which a scan visits them: class, depth, path."""
    cls = t.path_class(F.col("file_path"), F.col("language"))
    priority = F.array_position(F.array(*[F.lit(c) for c in CLASS_PRIORITY]), cls)
    return files.withColumn("priority", priority).withColumn("depth", t.depth(F.col("file_path")))

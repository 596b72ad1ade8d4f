"""Searches composed of ranked lists: reranking, several queries, expansion, following symbols."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions import text as t
from sievework.operators import candidates, ranking, retrieval
from sievework.session import cut

log = logging.getLogger(__name__)

#: Names that are too common to follow (fixed values).
COMMON_NAMES = ("new", "main", "init", "get", "set", "run", "test")
RERANK_CHARS = 2000
#: Keys under which models answer with queries (fixed values).
ANSWER_KEYS = ("rewrites", "queries", "candidates", "alternatives")


class Reranker(Protocol):
    """Scores documents for a query; one number per document."""

    def __call__(self, query: str, documents: Sequence[str]) -> Sequence[float]: ...


def rerank_document(chunks: DataFrame) -> DataFrame:
    """What a reranker sees of a chunk, in column ``document``; long code is cut at a line."""
    name = t.display_name(F.col("symbol_name"), F.col("part_index"))
    code = F.when(F.length("content") <= RERANK_CHARS, F.col("content")).otherwise(F.regexp_replace(F.substring("content", 1, RERANK_CHARS), r"\n[^\n]*$", ""))
    part = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(f"{label}: "), c))
    lines = F.concat_ws(
        "\n", part("Symbol", name), part("Type", F.col("symbol_type")), part("Filename", t.file_name(F.col("file_path"))), part("File", F.concat("file_path", F.lit(" ("), F.coalesce("language", F.lit("unknown")), F.lit(")"))),
        part("Path tokens", t.path_tokens(F.col("file_path"))), part("Role", t.path_class(F.col("file_path"), F.col("language"))), part("Lines", F.concat_ws("-", "line_start", "line_end")), part("Code", code),
    )
    return chunks.withColumn("document", lines)


def wants_rerank(query: str, intent: str | None = None, exact_paths: bool = False, symbol_type: bool = False) -> bool:
    """Exact paths, symbol types, paths and short identifiers need no reranking; a stated intent forces it."""
    if intent:
        return True
    words = query.split()
    return not (exact_paths or symbol_type or "/" in query or "\\" in query or (len(words) <= 2 and "?" not in query))


def rerank(ranked: DataFrame, score: Reranker, depth: int = 20) -> DataFrame:
    """The first ``depth`` rows of each query in the order of a model's scores, the rest behind in its old order.

    ``ranked`` has query_id, query, id, rank, document. A failing or incomplete model leaves the order
    as it was; only ``depth`` documents of a query are gathered.
    """
    head = ranked.where(F.col("rank") <= depth)
    lists = head.groupBy("query_id", "query").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "document"))).alias("docs"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for q, text, docs in zip(f["query_id"], f["query"], f["docs"], strict=True):
                try:
                    s = list(score(text, [d["document"] for d in docs]))
                except Exception as e:  # a model that is away must not fail the search
                    log.warning("reranker failed, order kept: %s", e)
                    s = []
                known = sorted(range(min(len(s), len(docs))), key=lambda i: (-s[i], i))
                order = known + list(range(len(known), len(docs)))
                rows += [(q, docs[i]["id"], n) for n, i in enumerate(order, 1)]
            yield pd.DataFrame(rows, columns=["query_id", "id", "new_rank"])

    kind = dict(ranked.dtypes)
    moved = lists.mapInPandas(run, f"query_id {kind['query_id']}, id {kind['id']}, new_rank int")
    return ranked.join(moved, ["query_id", "id"], "left").withColumn("rank", F.coalesce("new_rank", "rank")).drop("new_rank")


def query_candidates(answer: str, limit: int) -> list[str]:
    """Queries in a model's answer: a JSON array of strings, alone, under a usual key, or inside other text; empty if there is none."""
    bracketed = answer[answer.find("[") : answer.rfind("]") + 1]
    for text in (answer.strip(), bracketed):
        try:
            value = json.loads(text)
        except ValueError:
            continue
        lists = [value] if isinstance(value, list) else [value.get(k) for k in ANSWER_KEYS] if isinstance(value, dict) else []
        for x in lists:
            if isinstance(x, list) and all(isinstance(q, str) for q in x):
                return normalize_queries(x)[:limit]
    return []


def normalize_queries(queries: Sequence[str]) -> list[str]:
    """Queries without outer blanks, without empty ones, each once whatever the case; the first wins."""
    seen: dict[str, str] = {}
    for q in queries:
        q = " ".join(q.split())
        if q:
            seen.setdefault(q.lower(), q)
    return list(seen.values())


def multi_query(spark: SparkSession, chunks: DataFrame, repo: str, queries: Sequence[str], limit: int, weights: Sequence[float] | None = None) -> DataFrame:
    """One result list for several phrasings: each is searched alone, the lists are fused with equal (or given) weights."""
    asked = normalize_queries(queries)
    weights = list(weights or [])[: len(asked)] + [1.0] * (len(asked) - len(weights or []))
    q = spark.createDataFrame([(i, repo, x, float(w)) for i, (x, w) in enumerate(zip(asked, weights, strict=True))], "query_id int, repo string, query string, weight double")
    width = max(2 * limit, limit + 10, 20)
    lists = retrieval.hybrid(chunks, q, width).join(q.select("query_id", "weight"), "query_id").select(F.lit(0).alias("query_id"), "id", "rank", "weight")
    return retrieval.fuse(lists, limit)


def deep_search(spark: SparkSession, chunks: DataFrame, repo: str, query: str, expand: Callable[[str, list[str]], Sequence[str]], limit: int, hints: int = 10) -> DataFrame:
    """Expansion: a model proposes phrasings from the best lexical hits; the original counts twice."""
    q = spark.createDataFrame([(0, repo, query)], "query_id int, repo string, query string")
    first = retrieval.bm25(chunks, q, hints).join(chunks, "id").select("symbol_name", "file_path", "rank").orderBy("rank").limit(hints).collect()
    try:
        extra = list(expand(query, [r.symbol_name or r.file_path for r in first]))
    except Exception as e:
        log.warning("expansion failed, query searched alone: %s", e)
        extra = []
    asked = normalize_queries([query, *extra])
    return multi_query(spark, chunks, repo, asked, limit, [2.0] + [1.0] * (len(asked) - 1))


def iterative_search(spark: SparkSession, chunks: DataFrame, repo: str, query: str, limit: int, follow: int = 5) -> DataFrame:
    """A search, then one for the symbols of its first results, half as wide; a result once, first ones first."""
    q = spark.createDataFrame([(0, repo, query)], "query_id int, repo string, query string")
    first = retrieval.hybrid(chunks, q, limit)
    names = first.join(chunks, "id").where(F.col("symbol_name").isNotNull() & ~F.lower("symbol_name").isin(*COMMON_NAMES)).orderBy("rank").select("symbol_name").limit(follow).collect()
    found = first.withColumn("list", F.lit(0))
    for n, r in enumerate(normalize_queries([x.symbol_name for x in names]), 1):
        more = spark.createDataFrame([(0, repo, r)], "query_id int, repo string, query string")
        found = found.unionByName(retrieval.hybrid(chunks, more, max(1, limit // 2)).withColumn("list", F.lit(n)))
    once = Window.partitionBy("id").orderBy("list", "rank")
    kept = found.withColumn("n", F.row_number().over(once)).where("n = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("list", "rank", "id"))
    return kept.withColumn("rank", place).where(F.col("rank") <= limit).select("query_id", "id", "score", "rank")


def search(chunks: DataFrame, queries: DataFrame, limit: int, condition=None, stored: dict[str, DataFrame] | None = None, embed=None) -> DataFrame:
    """Ranked chunks for a batch of queries: filtered, fused, exact symbols and files in front, concept files behind, ranked by code signals.

    The condition is applied before any list is cut, so a filter never starves the result. ``stored`` are the search
    tables of the index that the chunks are from; a filter narrows them to the chunks that pass.
    """
    pool = chunks if condition is None else chunks.where(condition)
    if stored and condition is not None:
        ids = cut(pool.select("repo", "id"))
        stored = {n: df if n == "lengths" else df.join(ids, ["repo", "id"], "left_semi") for n, df in stored.items()}
    fetch = candidates.fetch_limit(F.col("query"), limit, condition is not None)
    most = max(8 * limit, limit + 140)
    width = queries.select("query_id", fetch.alias("width"))
    fused = retrieval.hybrid(pool, queries, most, embed, stored).join(width, "query_id").where("rank <= width").select("query_id", "id", "rank")
    exact = candidates.exact_order(candidates.exact_symbols(pool, queries), pool).select("query_id", "id", (F.col("place") - 1_000_000).alias("rank"))
    named = candidates.filename_candidates(pool, queries).join(queries.select("query_id", "repo"), "query_id")
    first = Window.partitionBy("query_id", "file_path").orderBy(F.coalesce("line_start", F.lit(0)), "id")
    named = named.join(pool.select("repo", "file_path", "id", "line_start"), ["repo", "file_path"]).withColumn("n", F.row_number().over(first)).where("n = 1").select("query_id", "id", (F.col("depth") - 2_000_000).alias("rank"))
    concepts = candidates.concept_files(pool, queries).select("query_id", "id", F.lit(1_000_000).alias("rank"))
    both = fused.unionByName(exact).unionByName(named).unionByName(concepts).groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("query_id").orderBy("rank", "id")
    numbered = both.withColumn("rank", F.row_number().over(w)).join(width, "query_id").where(F.col("rank") <= F.col("width") + 3 * 4).drop("width")
    rows = numbered.join(pool, "id").join(queries.select("query_id", "query"), "query_id")
    return ranking.rank(rows).where(F.col("rank") <= limit)

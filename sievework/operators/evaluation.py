"""Retrieval quality: recall, reciprocal rank, gain, latency."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same_path(a: Column, b: Column) -> Column:
    """Equal, or one ends with the other at a separator."""
    return (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))


def ranked_results(results: DataFrame, by: tuple[str, ...] = ("lane", "task_id")) -> DataFrame:
    """One list per lane and task (its latest), as (by, rank, file_path, line_start, line_end)."""
    last = results.groupBy(*by).agg(F.max(F.struct("finished_at", "result_id", "results")).alias("r"))
    return last.select(*by, F.posexplode("r.results").alias("at", "x")).select(*by, (F.col("at") + 1).alias("rank"), "x.file_path", "x.line_start", "x.line_end")


def truths(tasks: DataFrame) -> DataFrame:
    """task_id, category, gt (number), file_path, line_start, line_end, relevance."""
    return tasks.select(F.col("id").alias("task_id"), "category", F.posexplode("ground_truth").alias("gt", "g")).select(
        "task_id", "category", "gt", F.col("g.file_path").alias("gt_path"), F.col("g.line_start").alias("gt_start"), F.col("g.line_end").alias("gt_end"), "g.relevance"
    )


def hits(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """Results that overlap a truth: joined by task, so nothing is compared across tasks."""
    both = ranked.join(truth, "task_id")
    return both.where(same_path(F.col("file_path"), F.col("gt_path")) & (F.col("line_start") <= F.col("gt_end")) & (F.col("line_end") >= F.col("gt_start")))


def recall_and_mrr(ranked: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Per lane and task: share of truths found in the first k results, and 1 / rank of the first hit."""
    asked = ranked.select("lane", "task_id").distinct().join(truth.groupBy("task_id").agg(F.count("*").alias("truths")), "task_id")
    h = hits(ranked, truth)
    found = h.groupBy("lane", "task_id").agg(
        *[F.countDistinct(F.when(F.col("rank") <= k, F.col("gt"))).alias(f"f{k}") for k in ks], (1 / F.min("rank")).alias("mrr")
    )
    joined = asked.join(found, ["lane", "task_id"], "left")
    return joined.select("lane", "task_id", *[(F.coalesce(f"f{k}", F.lit(0)) / F.col("truths")).alias(f"recall_{k}") for k in ks], F.coalesce("mrr", F.lit(0.0)).alias("mrr"))


def ndcg(ranked: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """Per lane and task, with each truth used once: results take the most relevant free truth in rank order.

    The assignment is sequential, so it runs per task in Python, over the few hits of a task only.
    """
    h = hits(ranked, truth).where(F.col("rank") <= k).groupBy("lane", "task_id").agg(F.collect_list(F.struct("rank", "gt", "relevance")).alias("hits"))
    ideal = truth.groupBy("task_id").agg(F.sort_array(F.collect_list("relevance"), asc=False).alias("ideal"))
    asked = ranked.select("lane", "task_id").distinct().join(ideal, "task_id").join(h, ["lane", "task_id"], "left")

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for lane, task, best, got in zip(f["lane"], f["task_id"], f["ideal"], f["hits"], strict=True):
                used, dcg, by_rank = set(), 0.0, {}
                for x in got if got is not None else ():
                    by_rank.setdefault(x["rank"], []).append((x["relevance"], x["gt"]))
                for r in sorted(by_rank):
                    free = [x for x in by_rank[r] if x[1] not in used]
                    if free:
                        relevance, gt = max(free)
                        used.add(gt)
                        dcg += relevance / math.log2(r + 1)
                top = sum(x / math.log2(i + 2) for i, x in enumerate(list(best)[:k]))
                out.append((lane, task, dcg / top if top else 0.0))
            yield pd.DataFrame(out, columns=["lane", "task_id", "ndcg"])

    return asked.select("lane", "task_id", "ideal", "hits").mapInPandas(score, "lane string, task_id string, ndcg double")


def by_category(scores: DataFrame, tasks: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    cat = F.coalesce(F.regexp_replace(F.lower(F.trim("category")), "-", "_"), F.lit("unknown"))
    named = scores.join(tasks.select(F.col("id").alias("task_id"), cat.alias("category")).dropDuplicates(["task_id"]), "task_id")
    return named.groupBy("lane", "category").agg(F.count("*").alias("tasks"), *[F.avg(c).alias(c) for c in columns])


def latency(results: DataFrame) -> DataFrame:
    """p50 and p95 by lane, interpolated linearly."""
    ok = results.where("latency_ms > 0 and not isnan(latency_ms)").dropDuplicates(["result_id"])
    return ok.groupBy("lane").agg(F.round(F.percentile("latency_ms", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("latency_ms", F.lit(0.95)), 6).alias("p95"))

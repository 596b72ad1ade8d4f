"""Queries of the training-data problems and their SQL where SQL can express them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.llm import handwritten, leakage, mixing, neighbours, percentiles, splitting, truncation
from sievework.llm.syntax import operator as syntax
from sievework.session import cut, small, table

PERCENTILES = (0.5, 0.9, 0.95, 0.99)
#: Relative error of percentiles combined from partial counts.
ERROR = 0.005
#: Values that stand for "no measurement".
PLACEHOLDERS = (-1.0, 30000.0)


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per result with its category and day; late and repeated deliveries count once."""
    results = table(spark, sf_dir, "task_results").select("result_id", "task_id", "latency_ms", "finished_at")
    usable = (F.col("latency_ms") > 0) & ~F.isnan("latency_ms") & ~F.col("latency_ms").isin(*PLACEHOLDERS) & (F.col("latency_ms") < float("inf"))
    # copies of a result differ in ingested_at only; buffers of fixed width make this a hash aggregate
    once = results.where(usable).groupBy("result_id").agg(F.max("latency_ms").alias("latency_ms"), F.max(F.xxhash64("task_id")).alias("task"), F.max("finished_at").alias("finished_at"))
    tasks = table(spark, sf_dir, "benchmark_tasks").groupBy(F.xxhash64("id").alias("task")).agg(F.max("category").alias("category"))
    category = F.coalesce(F.regexp_replace(F.lower(F.trim("category")), "-", "_"), F.lit("unknown"))
    return once.join(tasks, "task", "left").select(category.alias("category"), F.date_format("finished_at", "yyyy-MM-dd").alias("day"), "latency_ms")


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = percentiles.exact_percentiles(latencies(spark, sf_dir), ["category", "day"], "latency_ms", PERCENTILES)
    names = [percentiles.name_of(p) for p in PERCENTILES]
    return exact.withColumns({n: F.round(n, 6) for n in names})  # measured to three decimals; interpolation adds two


def p1_combined_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per category from the partial counts of the single days."""
    days = percentiles.partial_counts(latencies(spark, sf_dir), ["category", "day"], "latency_ms", ERROR)
    got = percentiles.combined_percentiles(days, ["category"], PERCENTILES, ERROR)
    return got.withColumns({percentiles.name_of(p): F.round(percentiles.name_of(p), 6) for p in PERCENTILES})


def p1_combined_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each percentile combined from days is within ERROR of the exact order statistic of its rank."""
    combined = p1_combined_days(spark, sf_dir)
    names = [percentiles.name_of(p) for p in PERCENTILES]
    values = latencies(spark, sf_dir)
    below = values.join(F.broadcast(combined), "category")  # one row per category
    share = lambda p, name: F.struct(
        F.count_if(F.col("latency_ms") < F.col(name) * (1 - ERROR - 1e-9)).alias("low"), F.count_if(F.col("latency_ms") <= F.col(name) * (1 + ERROR + 1e-9)).alias("high"), F.floor(F.lit(p) * (F.max("n") - 1)).alias("at"))
    held = below.groupBy("category").agg(F.max("n").alias("n"), *[share(p, n).alias(n) for p, n in zip(PERCENTILES, names, strict=True)])
    return held.select("category", "n", *[((F.col(f"{n}.low") <= F.col(f"{n}.at")) & (F.col(f"{n}.at") < F.col(f"{n}.high"))).alias(n) for n in names])


LIMITS = splitting.Limits(lines=200, bytes=24_576, overlap=10)


PIECES = ["item_id", "piece", "line_start", "line_end", "n_bytes", "n_repeated"]
PIECES_DDL = "item_id string, piece int, line_start int, line_end int, n_bytes long, n_repeated long"


def _over(content: str) -> F.Column:
    """Whether a text is over a limit; decided in the JVM, so that only large items reach Python."""
    lines = F.length(content) - F.length(F.replace(F.col(content), F.lit("\n"), F.lit(""))) + F.when(F.col(content).endswith("\n"), 0).otherwise(1)
    return (lines > LIMITS.lines) | (F.octet_length(content) > LIMITS.bytes)


def chunk_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks").where(_over("content")).select("id", "content", F.coalesce("line_start", F.lit(1)).alias("first"))
    chunks = chunks.where("id is not null").groupBy("id").agg(F.max(F.struct("first", "content")).alias("r")).select("id", "r.*")

    def cut_up(frames):
        for f in frames:
            rows = [
                (i, n, a + s - 1, a + e - 1, len(t.encode()), r)
                for i, a, c in zip(f["id"], f["first"], f["content"], strict=True)
                for n, (s, e, t, r) in enumerate(splitting.placed_pieces(c, LIMITS))
            ]
            yield pd.DataFrame(rows, columns=PIECES)

    out = chunks.mapInPandas(cut_up, PIECES_DDL)
    return out.select(F.lit("chunk").alias("item_type"), "*")


def ground_truth_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "benchmark_tasks").select("id", "repo", F.explode("ground_truth").alias("g")).select("id", "repo", "g.file_path", "g.line_start", "g.line_end")
    item = F.concat_ws(":", "id", "file_path", "line_start", "line_end")
    over = cut(tasks.where(F.col("line_end") - F.col("line_start") + 1 > LIMITS.lines).withColumn("item_id", item).dropDuplicates(["item_id", "repo"]))
    files = table(spark, sf_dir, "discovered_files").select("repo", F.col("relative_path").alias("file_path"), "content")
    texts = files.join(small(over.select("repo", "file_path").distinct()), ["repo", "file_path"], "left_semi").groupBy("repo", "file_path").agg(F.max("content").alias("content"))

    def cut_up(frames):
        for f in frames:
            rows = []
            for i, s, e, c in zip(f["item_id"], f["line_start"], f["line_end"], f["content"], strict=True):
                rows += [(i, n, a, b, None, None) for n, (a, b) in enumerate(splitting.split_range(s, e, None if c is None else c.split("\n"), LIMITS))]
            yield pd.DataFrame(rows, columns=PIECES)

    joined = over.join(texts, ["repo", "file_path"], "left").select("item_id", "line_start", "line_end", "content")
    out = joined.mapInPandas(cut_up, PIECES_DDL)
    return out.select(F.lit("ground_truth").alias("item_type"), "*")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_pieces(spark, sf_dir).unionByName(ground_truth_pieces(spark, sf_dir))


def p2_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item whether its pieces cover it without a gap, keep to the limits and overlap as specified.

    A piece starts as many lines before the end of its predecessor as specified, or fewer where lines are so long that
    more would not fit; within one line bytes are repeated.
    """
    w = Window.partitionBy("item_type", "item_id").orderBy("piece")
    p = p2_pieces(spark, sf_dir).withColumn("before", F.lag("line_end").over(w)).withColumn("last", F.lead("piece").over(w).isNull())
    lines = F.col("line_end") - F.col("line_start") + 1
    shared = F.col("before") - F.col("line_start") + 1
    gap = F.col("before").isNotNull() & (F.col("line_start") > F.col("before") + 1)
    fits = (lines <= LIMITS.lines) & (F.coalesce("n_bytes", F.lit(0)) <= LIMITS.bytes)
    overlap = F.col("before").isNull() | (shared == LIMITS.overlap) | (F.col("n_repeated") > 0) & (shared < LIMITS.overlap)
    return p.groupBy("item_type", "item_id").agg((~F.bool_or(gap)).alias("covers"), F.bool_and(fits).alias("fits"), F.bool_and(overlap).alias("overlaps"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pieces(spark, sf_dir).where("piece > 0").select("item_type", "item_id").distinct()


#: Similarity from which a pair of vectors is a case, and neighbours per vector.
COSINE, NEIGHBOURS = 0.90, 5


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours.top_similar(table(spark, sf_dir, "vectors"), table(spark, sf_dir, "flat_manifest"), NEIGHBOURS, COSINE)
    return near.select(F.least("rowid", "other").alias("rowid_a"), F.greatest("rowid", "other").alias("rowid_b")).distinct()


def p3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar rows of every row whose id is divisible by 20, among all rows."""
    live = neighbours.live_vectors(table(spark, sf_dir, "vectors"), table(spark, sf_dir, "flat_manifest"))
    live = cut(live)
    return neighbours.nearest(live.where("rowid % 20 = 0"), live, NEIGHBOURS)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.found(handwritten.judge(table(spark, sf_dir, "discovered_files")))


def p5_searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per search request: files of its repository and language that it may see, with the filter applied."""
    files = table(spark, sf_dir, "discovered_files")
    kinds = handwritten.judge(files).select("file_id", F.expr("generated or minified or vendored or blob").alias("not_written"))
    one = files.groupBy("file_id").agg(F.max("repo").alias("repo"), F.lower(F.max("language")).alias("language")).join(kinds, "file_id")
    sums = one.groupBy("repo", "language").agg(F.count("*").alias("all_files"), F.count_if(~F.col("not_written")).alias("written"))
    asked = table(spark, sf_dir, "search_requests").select("request_id", "repo", F.lower("lang").alias("lang"), F.coalesce("include_generated", F.lit(False)).alias("with_generated"))
    seen = asked.join(sums, "repo", "left").where(F.col("lang").isNull() | (F.col("lang") == F.col("language")))
    return seen.groupBy("request_id", "with_generated").agg(F.sum("all_files").alias("files"), F.sum(F.when(F.col("with_generated"), F.col("all_files")).otherwise(F.col("written"))).alias("visible"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.check(table(spark, sf_dir, "discovered_files")).where("flawed").select("file_id").distinct()


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.rates(syntax.check(table(spark, sf_dir, "discovered_files")))


def p6_missed_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flawed files that the indexer took for sound, with what the repair says of them."""
    files = table(spark, sf_dir, "discovered_files").groupBy("file_id").agg(F.max("relative_path").alias("file_path"))
    flawed = syntax.check(table(spark, sf_dir, "discovered_files")).where("flawed").join(files, "file_id")
    states = table(spark, sf_dir, "file_index_state").where("status = 'indexed' and not coalesce(tree_has_error, false)").select("repo", "file_path").distinct()
    return flawed.join(states, ["repo", "file_path"], "left_semi").select("repo", "file_path", "extension", "cost", "reason", "place")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leak with its share and its place in the original text."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which test items leaked, and into how many documents."""
    return p7_leaks(spark, sf_dir).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("share").alias("most"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, chosen = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return mixing.report(chosen, p)


#: A request of this many times all tokens: small sources reach their cap, and what they cannot give falls to the others, in several rounds.
LARGE_REQUEST = 1.2


def p8_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of a size at which sources are clamped at their cap and their weight is redistributed."""
    p, chosen = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), share=LARGE_REQUEST)
    return mixing.report(chosen, p)


def p8_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.judge(table(spark, sf_dir, "documents")).where("truncated").select("doc_id").distinct()


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.rates(truncation.judge(table(spark, sf_dir, "documents")))


_LATENCIES = """
    SELECT coalesce(replace(lower(trim(b.category)), '-', '_'), 'unknown') AS category,
           strftime(t.finished_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, t.latency_ms
    FROM (SELECT result_id, max(latency_ms) AS latency_ms, any_value(task_id) AS task_id, any_value(finished_at) AS finished_at
          FROM task_results WHERE latency_ms > 0 AND NOT isnan(latency_ms) AND latency_ms NOT IN (-1, 30000) GROUP BY result_id) t
    LEFT JOIN benchmark_tasks b ON b.id = t.task_id
"""

QUERIES = {
    "p1_percentiles": p1_percentiles,
    "p1_combined_days": p1_combined_days,
    "p1_combined_error": p1_combined_error,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p2_checks": p2_checks,
    "p3_found": p3_found,
    "p3_nearest": p3_nearest,
    "p5_found": p5_found,
    "p5_searchable": p5_searchable,
    "p6_found": p6_found,
    "p6_rates": p6_rates,
    "p6_missed_by_index": p6_missed_by_index,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p7_items": p7_items,
    "p8_shares": p8_shares,
    "p8_clamped": p8_clamped,
    "p8_selection": p8_selection,
    "p9_found": p9_found,
    "p9_rates": p9_rates,
}

_OVER = """
        SELECT DISTINCT 'chunk' AS item_type, id AS item_id FROM chunks
        WHERE length(content) - length(replace(content, chr(10), '')) + CASE WHEN content LIKE '%' || chr(10) THEN 0 ELSE 1 END > 200 OR strlen(content) > 24576
        UNION SELECT DISTINCT 'ground_truth', id || ':' || g.file_path || ':' || g.line_start || ':' || g.line_end
        FROM (SELECT id, unnest(ground_truth) AS g FROM benchmark_tasks) WHERE g.line_end - g.line_start + 1 > 200"""

SQL = {
    "p1_percentiles": f"""SELECT category, day, count(*) AS n, {', '.join(f"round(quantile_cont(latency_ms, {p}), 6) AS {percentiles.name_of(p)}" for p in PERCENTILES)}
        FROM ({_LATENCIES}) GROUP BY category, day""",
    "p1_combined_error": f"""SELECT category, count(*) AS n, {', '.join(f"true AS {percentiles.name_of(p)}" for p in PERCENTILES)}
        FROM ({_LATENCIES}) GROUP BY category""",
    "p1_combined_days": f"""WITH bins AS (
            SELECT category, ceil(ln(latency_ms) / ln({(1 + ERROR) / (1 - ERROR)})) AS b, count(*) AS c FROM ({_LATENCIES}) GROUP BY category, b),
        upto AS (SELECT *, sum(c) OVER (PARTITION BY category ORDER BY b) AS u, sum(c) OVER (PARTITION BY category) AS n FROM bins)
        SELECT category, n::BIGINT AS n, {', '.join(f"max(CASE WHEN floor({p} * (n - 1)) >= u - c AND floor({p} * (n - 1)) < u THEN round(2 * pow({(1 + ERROR) / (1 - ERROR)}, b) / ({(1 + ERROR) / (1 - ERROR)} + 1), 6) END) AS {percentiles.name_of(p)}" for p in PERCENTILES)}
        FROM upto GROUP BY category, n""",
    "p2_found": _OVER,
    "p2_checks": f"SELECT item_type, item_id, true AS covers, true AS fits, true AS overlaps FROM ({_OVER})",
}

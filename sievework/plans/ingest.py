"""Queries that build, update and check an index, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions import text as t
from sievework.operators import candidates, chunking, graph, retrieval, stats, update
from sievework.plans.index import _FILES, CLASS_SQL, EDGES_SQL, ONCE, _chunks, _files, _requests
from sievework.session import table
from sievework.sources import files as source
from sievework.streaming import watch

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- discovery
_EXT = "lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1))"
_LANG = "CASE " + " ".join(f"WHEN lower(regexp_extract(file_path, '[^/]*$')) = '{k}' THEN '{v}'" for k, v in t.FILE_NAMES.items()) + " " + " ".join(f"WHEN {_EXT} = '{k}' THEN '{v}'" for k, v in t.LANGUAGES.items()) + " ELSE 'unknown' END"


@query(f"SELECT repo, {_LANG} AS detected, count(*) AS files, count(*) FILTER (language IS DISTINCT FROM {_LANG}) AS differing FROM {_FILES} GROUP BY 1, 2")
def detect_languages(s, d):
    lang = t.detect_language(F.col("file_path"))
    return _files(s, d).groupBy("repo", lang.alias("detected")).agg(F.count("*").alias("files"), F.count_if(~F.col("language").eqNullSafe(lang)).alias("differing"))


_SKIPS = ", ".join(repr(x) for x in source.DEFAULT_EXCLUDES)


@query(f"""SELECT CASE WHEN list_has_any(string_split(file_path, '/'), [{_SKIPS}]) THEN 'default exclude' WHEN strlen(content) > 16000 THEN 'too large' WHEN strlen(content) = 0 THEN 'empty'
    WHEN {_EXT} IN {source.BINARY_EXTENSIONS!r} THEN 'binary extension' ELSE 'indexed' END AS reason, count(*) AS files FROM {_FILES} WHERE content IS NOT NULL GROUP BY 1""")
def discovery_decisions(s, d):
    f = _files(s, d).where("content is not null").select(F.col("file_path").alias("relative_path"), F.octet_length("content").alias("size"), F.col("content").cast("binary").alias("content"))
    return source.decide(f, [], max_bytes=16_000).groupBy("reason").agg(F.count("*").alias("files"))


@query()
def discovery_sample(s, d):
    """One file per interval of the sorted list with the number of files that it stands for."""
    return source.sampling_estimate(_files(s, d).select(F.concat_ws("/", "repo", "file_path").alias("relative_path"), F.octet_length("content").alias("size")), 100)


@query(f"SELECT file_path, depth, priority FROM (SELECT file_path, length(file_path) - length(replace(file_path, '/', '')) AS depth, list_position({list(candidates.CLASS_PRIORITY)!r}, {CLASS_SQL}) AS priority FROM {_FILES})")
def scan_order(s, d):
    return candidates.scan_order(_files(s, d)).select("file_path", "depth", "priority")


# ---------------------------------------------------------------- chunks from files
@query()
def ingest_chunks(s, d):
    return chunking.chunk_files(_files(s, d)).select("id", "repo", "file_path", "line_start", "line_end", "symbol_type", "symbol_name", "part_index")


@query(f"""SELECT repo, file_path, len(list_filter(string_split(content, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)) <> '')) AS full_lines, 0 AS uncovered FROM {_FILES} WHERE content IS NOT NULL AND regexp_matches(content, '\\S')""")
def ingest_coverage(s, d):
    """Lines with text per file, and how many of them no chunk holds: none may be lost."""
    f = _files(s, d).where("content is not null").where(F.col("content").rlike(r"\S"))
    lines = f.select("repo", "file_path", F.posexplode(F.split("content", "\n")).alias("n", "x")).where(F.col("x").rlike(r"\S")).select("repo", "file_path", (F.col("n") + 1).alias("line"))
    held = chunking.chunk_files(f).select("repo", "file_path", F.explode(F.sequence("line_start", "line_end")).alias("line")).distinct().withColumn("held", F.lit(1))
    both = lines.join(held, ["repo", "file_path", "line"], "left")
    return both.groupBy("repo", "file_path").agg(F.count("*").cast("int").alias("full_lines"), (F.count("*") - F.count("held")).cast("int").alias("uncovered"))


@query()
def ingest_references(s, d):
    """Call edges of chunks made from the files."""
    return graph.call_edges(chunking.chunk_files(_files(s, d)))


@query()
def ingest_embedding_texts(s, d):
    return chunking.embedding_text(_chunks(s, d)).select("id", F.octet_length("text").alias("n_bytes"))


@query(f"SELECT repo, count(*) AS chunks, count(DISTINCT sha256(content)) AS texts FROM {ONCE} WHERE content IS NOT NULL GROUP BY 1")
def ingest_distinct_texts(s, d):
    return _chunks(s, d).where("content is not null").groupBy("repo").agg(F.count("*").alias("chunks"), F.countDistinct(F.sha2("content", 256)).alias("texts"))


@query()
def ingest_embeddings_reused(s, d):
    """Vectors of all chunks when half the texts (by hash) were embedded before: each distinct new text is embedded once."""
    embed = retrieval.hash_embedding(16)
    texts = _chunks(s, d).where("content is not null").select("id", F.col("content").alias("text"))
    saved = texts.where(F.sha2("text", 256) < "8").select(F.sha2("text", 256).alias("key"), embed("text").alias("vector"), F.lit("hash-16").alias("identity"))
    return update.embed_with_reuse(texts, saved, embed, "hash-16").select("id", "key", F.size("vector").alias("dim"))


# ---------------------------------------------------------------- updates
_RUN = "(SELECT repo, file_path, regexp_replace(lower(trim(content_hash)), '^sha256:', '') AS content_hash, row_number() OVER (PARTITION BY repo, file_path ORDER BY h.run_id DESC, h.attempt DESC, recorded_at DESC, ingested_at DESC, content_hash DESC) AS k FROM file_hashes h JOIN index_runs r ON r.run_id = h.run_id AND r.attempt = h.attempt WHERE r.status = '{}')"
_STALE = f"SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.file_path, b.file_path) AS file_path, CASE WHEN a.content_hash IS NULL THEN 'added' WHEN b.content_hash IS NULL THEN 'deleted' WHEN a.content_hash <> b.content_hash THEN 'modified' ELSE 'unchanged' END AS change FROM (SELECT * FROM {_RUN.format('succeeded')} WHERE k = 1) a FULL JOIN (SELECT * FROM {_RUN.format('running')} WHERE k = 1) b ON a.repo = b.repo AND a.file_path = b.file_path"


def _changes(s: SparkSession, d: str) -> DataFrame:
    from sievework.operators import incremental as inc

    hashes, runs = table(s, d, "file_hashes"), table(s, d, "index_runs")
    name = lambda df: df.withColumnRenamed("digest", "content_hash")
    return update.staleness(name(inc.committed_state(hashes, runs, 8)), name(inc.pending_records(hashes, runs, 8)))


@query(_STALE)
def staleness(s, d):
    return _changes(s, d)


@query(f"SELECT repo, change, count(*) AS files FROM ({_STALE}) GROUP BY 1, 2")
def staleness_counts(s, d):
    return _changes(s, d).groupBy("repo", "change").agg(F.count("*").alias("files"))


@query(f"SELECT c.id FROM {ONCE} c WHERE NOT EXISTS (SELECT 1 FROM ({_STALE}) x WHERE x.change = 'deleted' AND x.repo = c.repo AND x.file_path = c.file_path)")
def remove_deleted(s, d):
    c = _chunks(s, d)
    gone = _changes(s, d).where("change = 'deleted'")
    return update.replace_files(c, gone, c.limit(0)).select("id")


@query(f"SELECT DISTINCT file_path FROM {ONCE} INTERSECT SELECT DISTINCT file_path FROM file_index_state WHERE status = 'indexed'")
def indexed_and_chunked(s, d):
    return _chunks(s, d).select("file_path").intersect(table(s, d, "file_index_state").where("status = 'indexed'").select("file_path"))


# ---------------------------------------------------------------- lists
@query(f"""WITH w AS (SELECT request_id AS query_id, repo, unnest(list_distinct(list_filter(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+'), lambda w: len(w) <= 40))) AS word FROM search_requests),
    f AS (SELECT DISTINCT repo, file_path FROM chunks), p AS (SELECT repo, file_path, length(file_path) - length(replace(file_path, '/', '')) AS depth,
        unnest(list_distinct(regexp_extract_all(lower(translate(regexp_replace(regexp_extract(file_path, '[^/]*$'), '(.)\\.[^.]*$', '\\1'), '_-.', '   ')), '[\\p{{L}}\\p{{N}}]+'))) AS word FROM f),
    h AS (SELECT DISTINCT query_id, file_path, depth FROM p JOIN w ON w.repo = p.repo AND w.word = p.word WHERE len(w.word) >= 4)
    SELECT query_id, file_path, depth FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY depth, file_path) AS n FROM h) WHERE n <= 20""")
def stem_files(s, d):
    return candidates.stem_files(_chunks(s, d), _requests(s, d))


@query()
def concept_files(s, d):
    return candidates.concept_files(_chunks(s, d), _requests(s, d))


_POOL = "(SELECT repo AS query_id, id, file_path, octet_length(encode(content)) AS n, row_number() OVER (PARTITION BY repo ORDER BY coalesce(line_start, 0), id) AS rank FROM " + ONCE + " WHERE content IS NOT NULL)"


def _pool(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("repo").orderBy(F.coalesce("line_start", F.lit(0)), "id")
    return _chunks(s, d).where("content is not null").withColumn("rank", F.row_number().over(w)).withColumnRenamed("repo", "query_id")


@query(f"SELECT query_id, id, rank, nth FROM (SELECT *, row_number() OVER (PARTITION BY query_id, file_path ORDER BY rank) AS nth FROM {_POOL}) WHERE nth <= 4")
def cap_per_file(s, d):
    return candidates.cap_per_file(_pool(s, d)).select("query_id", "id", "rank", "nth")


@query(f"SELECT query_id, id, allowed FROM (SELECT *, least(greatest(5000 - coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0), n)::BIGINT AS allowed FROM {_POOL}) WHERE allowed > 0")
def output_budget(s, d):
    return chunking.within_budget(_pool(s, d), 5000).select("query_id", "id", F.col("allowed").cast("long").alias("allowed"))


@query(f"SELECT query_id, id, rank, min(n) OVER (PARTITION BY query_id ORDER BY rank)::DOUBLE AS score FROM {_POOL}")
def score_ceiling(s, d):
    from sievework.operators import ranking

    return ranking.score_ceiling(_pool(s, d).withColumn("score", F.octet_length("content").cast("double"))).select("query_id", "id", "rank", "score")


_DB = "(SELECT 1 AS query_id, database_id, rowid AS id, row_number() OVER (PARTITION BY database_id ORDER BY rowid) AS rank, dense_rank() OVER (ORDER BY database_id) - 1 AS index_no FROM (SELECT DISTINCT database_id, rowid FROM vectors))"


@query(f"SELECT query_id, id, rank, index_no, row_number() OVER (PARTITION BY query_id ORDER BY rank + CASE WHEN index_no <> 0 THEN 1 ELSE 0 END, index_no, rank) AS place FROM {_DB} WHERE rank <= 20")
def merge_indexes(s, d):
    dbs = table(s, d, "flat_manifest").select("database_id").distinct().withColumn("index_no", F.row_number().over(Window.orderBy("database_id")) - 1)
    v = table(s, d, "vectors").select("database_id", "rowid").distinct().join(F.broadcast(dbs), "database_id")
    w = Window.partitionBy("database_id").orderBy("rowid")
    lists = v.withColumn("rank", F.row_number().over(w)).where("rank <= 20").select(F.lit(1).alias("query_id"), F.col("rowid").alias("id"), "rank", "index_no")
    return retrieval.merge_indexes(lists)


# ---------------------------------------------------------------- overview
@query(f"""SELECT 'language' AS section, language AS name, count(*) AS value FROM {ONCE} GROUP BY 2
    UNION ALL SELECT 'symbol type', symbol_type, count(*) FROM {ONCE} WHERE symbol_type IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'calls', NULL, count(*) FROM {EDGES_SQL} UNION ALL SELECT 'files', NULL, count(DISTINCT repo || '|' || file_path) FROM {ONCE}""")
def overview(s, d):
    c = _chunks(s, d)
    row = lambda section, df, name, value: df.select(F.lit(section).alias("section"), name.alias("name"), value.alias("value"))
    none = F.lit(None).cast("string")
    return (
        row("language", stats.language_stats(c), F.col("language"), F.col("chunks"))
        .unionByName(row("symbol type", stats.symbol_types(c), F.col("symbol_type"), F.col("chunks")))
        .unionByName(row("calls", graph.call_edges(c).agg(F.count("*").alias("n")), none, F.col("n")))
        .unionByName(row("files", stats.counts(c), none, F.col("files")))
    )


@query("SELECT strftime(time_bucket(INTERVAL 10 MINUTE, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(s, d):
    out = watch.event_counts(table(s, d, "events"))
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = Q

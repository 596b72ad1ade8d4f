"""Queries over words, sizes, positions, candidates and planted lines, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text as t
from sievework.functions import values as v
from sievework.operators import candidates, graph, stats
from sievework.plans.index import _FILES, ONCE, _chunks, _files, _requests
from sievework.session import table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Lines in the ways of several languages that the tables do not hold: both sides of a check add them to the chunks.
PLANTED = (
    ("planted/app.py", "python", "root = os.environ['APP_ROOT']"),
    ("planted/app.py", "python", "level = os.getenv('LOG_LEVEL', 'info')"),
    ("planted/web.ts", "typescript", "const key = process.env.API_KEY;"),
    ("planted/main.rs", "rust", "let home = env::var(\"HOME\")?;"),
    ("planted/main.go", "go", "addr := os.Getenv(\"ADDR\")"),
    ("planted/App.java", "java", "String user = System.getenv(\"USER\");"),
    ("planted/web.ts", "typescript", "app.get('/users', list);"),
    ("planted/web.ts", "typescript", "router.post('/users/:id', save);"),
    ("planted/app.py", "python", "rows = run('SELECT id FROM users WHERE id = 1')"),
    ("planted/app.py", "python", "run(\"insert into log values (1)\")"),
    ("planted/web.ts", "typescript", "class Page extends Base {}"),
    ("planted/App.java", "java", "class Store implements Closeable {}"),
    ("planted/app.py", "python", "class Reader(Source):"),
)
_VALUES = ", ".join("('planted', '{}', {}, '{}')".format(p, n + 1, x.replace("'", "''")) for n, (p, _, x) in enumerate(PLANTED))
_PLANTED_LINES = (
    "(SELECT repo, file_path, (first + n - 1)::INT AS line, text FROM (SELECT repo, file_path, coalesce(line_start, 1) AS first, unnest(string_split(content, chr(10))) AS text, "
    f"generate_subscripts(string_split(content, chr(10)), 1) AS n FROM {ONCE} WHERE content IS NOT NULL) UNION ALL SELECT * FROM (VALUES {_VALUES}) p(repo, file_path, line, text))"
)


def _planted(s: SparkSession, d: str) -> DataFrame:
    rows = s.createDataFrame([("planted", p, n + 1, x) for n, (p, _, x) in enumerate(PLANTED)], "repo string, file_path string, line_start int, content string")
    return table(s, d, "chunks").where("id is not null").select("repo", "file_path", "line_start", "content").unionByName(rows)


def _sql(pattern: str, cols: str) -> str:
    p = pattern.replace("'", "''")
    return f"SELECT DISTINCT repo, file_path, line, {cols.format(p=p)} FROM {_PLANTED_LINES} WHERE regexp_matches(text, '{p}')"


@query(_sql(graph.ENV_READS, "regexp_extract(text, '{p}', 1) AS g1"))
def structural_env_reads(s, d):
    return graph.matches(_planted(s, d), graph.ENV_READS)


@query(_sql(graph.ROUTES, "regexp_extract(text, '{p}', 1) AS g1, regexp_extract(text, '{p}', 2) AS g2"))
def structural_routes(s, d):
    return graph.matches(_planted(s, d), graph.ROUTES, 2)


@query(_sql(graph.SQL_SITES, "regexp_extract(text, '{p}', 1) AS g1"))
def structural_sql_sites(s, d):
    return graph.matches(_planted(s, d), graph.SQL_SITES)


@query(f"""SELECT repo, file_path, line, owner, target FROM (SELECT *, row_number() OVER (PARTITION BY repo, file_path, lower(owner), lower(target) ORDER BY line) AS k FROM
    ({_sql(graph.RELATION, "regexp_extract(text, '{p}', 1) AS owner, regexp_extract(text, '{p}', 2) AS target")})) WHERE k = 1""")
def type_relations(s, d):
    return graph.type_relations(_planted(s, d))


# a word of each file's own path stands for a query that names what exists
_ASKED = f"""(SELECT file_id AS query_id, repo, 'where is ' || regexp_extract(file_path, '[^/]*$') AS query FROM {_FILES})"""


def _asked_files(s: SparkSession, d: str) -> DataFrame:
    return _files(s, d).select(F.col("file_id").alias("query_id"), "repo", F.concat(F.lit("where is "), t.file_name(F.col("file_path"))).alias("query"))


@query(f"""WITH q AS {_ASKED}, f AS (SELECT DISTINCT repo, file_path, length(file_path) - length(replace(file_path, '/', '')) AS depth, lower(regexp_extract(file_path, '[^/]*$')) AS name FROM chunks WHERE id IS NOT NULL),
    h AS (SELECT DISTINCT q.query_id, f.file_path, f.depth FROM q JOIN f ON f.repo = q.repo AND f.name = lower(split_part(q.query, ' ', 3)) WHERE regexp_matches(f.name, '\\.[a-z0-9]+$'))
    SELECT query_id, file_path, depth FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY depth, file_path) AS n FROM h) WHERE n <= 20""")
def filename_candidates(s, d):
    return candidates.filename_candidates(_chunks(s, d), _asked_files(s, d))


_NAMED = f"(SELECT vec_id AS query_id, c.repo, c.symbol_name AS query FROM (SELECT repo, symbol_name, row_number() OVER (ORDER BY repo, symbol_name) - 1 AS vec_id FROM (SELECT DISTINCT repo, symbol_name FROM {ONCE} WHERE symbol_name IS NOT NULL AND repo IS NOT NULL)) c)"


def _asked_symbols(s: SparkSession, d: str) -> DataFrame:
    """A query for each symbol of each repository."""
    names = _chunks(s, d).where("symbol_name is not null and repo is not null").select("repo", "symbol_name").distinct()
    return names.select(F.concat_ws("|", "repo", "symbol_name").alias("query_id"), "repo", F.col("symbol_name").alias("query"))


@query(f"""WITH q AS (SELECT DISTINCT repo || '|' || symbol_name AS query_id, repo, unnest(list_distinct(regexp_extract_all(symbol_name, '[A-Za-z_]\\w*'))) AS word FROM {ONCE} WHERE symbol_name IS NOT NULL)
    SELECT query_id, id, min(CASE WHEN word = symbol_name THEN 0 ELSE 1 END) AS kind FROM q JOIN {ONCE} c ON c.repo = q.repo AND lower(c.symbol_name) = lower(word) GROUP BY 1, 2""")
def exact_symbols(s, d):
    return candidates.exact_symbols(_chunks(s, d), _asked_symbols(s, d))


@query(f"""WITH q AS (SELECT DISTINCT repo || '|' || symbol_name AS query_id, repo, unnest(list_distinct(regexp_extract_all(symbol_name, '[A-Za-z_]\\w*'))) AS word FROM {ONCE} WHERE symbol_name IS NOT NULL),
    h AS (SELECT query_id, c.id, min(CASE WHEN word = symbol_name THEN 0 ELSE 1 END) AS kind FROM q JOIN {ONCE} c ON c.repo = q.repo AND lower(c.symbol_name) = lower(word) GROUP BY 1, 2)
    SELECT query_id, h.id, kind, row_number() OVER (PARTITION BY query_id ORDER BY kind, NOT regexp_matches(coalesce(content, ''), '(?m)^\\s*(?:pub\\b|export\\b|public\\b)'),
        coalesce(regexp_matches(symbol_name, '^\\p{{Lu}}') AND lower(symbol_type) IN ('function', 'method') AND kind <> 0, false),
        length(file_path) - length(replace(file_path, '/', '')), coalesce(line_start, 0), file_path, h.id) AS place FROM h JOIN {ONCE} c ON c.id = h.id""")
def exact_order(s, d):
    c = _chunks(s, d)
    return candidates.exact_order(candidates.exact_symbols(c, _asked_symbols(s, d)), c)


@query("SELECT DISTINCT repo, relative_path AS file_path FROM discovered_files EXCEPT SELECT c.repo, c.file_path FROM chunks c JOIN file_index_state f ON f.repo = c.repo AND f.file_path = c.file_path AND f.status = 'indexed'")
def files_without_chunks(s, d):
    """Files that no chunk of a well indexed file covers."""
    indexed = table(s, d, "file_index_state").where("status = 'indexed'").select("repo", "file_path").distinct()
    return table(s, d, "discovered_files").select("repo", F.col("relative_path").alias("file_path")).subtract(table(s, d, "chunks").select("repo", "file_path").join(indexed, ["repo", "file_path"], "left_semi"))


_ENTRY_ROWS = "(SELECT repo, file_path FROM chunks WHERE id IS NOT NULL UNION ALL VALUES ('planted', 'src/main.rs'), ('planted', 'lib/index.ts'), ('planted', 'src/domain.rs'))"


@query(f"SELECT DISTINCT repo, file_path FROM {_ENTRY_ROWS} p(repo, file_path) WHERE lower(string_split(regexp_extract(file_path, '[^/]*$'), '.')[1]) IN {t.ENTRY_STEMS!r}")
def entry_points(s, d):
    more = s.createDataFrame([("planted", "src/main.rs"), ("planted", "lib/index.ts"), ("planted", "src/domain.rs")], "repo string, file_path string")
    return stats.entry_points(table(s, d, "chunks").where("id is not null").select("repo", "file_path").unionByName(more))


@query("""SELECT language, total, indexed, parse_error, tree_error, fallback, chunks FROM (
    SELECT language, count(*) AS total, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status = 'parse_error') AS parse_error, count(*) FILTER (tree_has_error) AS tree_error,
        count(*) FILTER (tier0_fallback) AS fallback, coalesce(sum(chunk_count), 0)::BIGINT AS chunks FROM file_index_state GROUP BY GROUPING SETS ((), (language)))""")
def health_totals(s, d):
    return stats.health_totals(table(s, d, "file_index_state"))


@query(f"SELECT symbol_type, count(*) AS chunks FROM {ONCE} c WHERE symbol_type IS NOT NULL AND EXISTS (SELECT 1 FROM file_index_state f WHERE f.tree_has_error AND f.repo = c.repo AND f.file_path = c.file_path) GROUP BY 1")
def symbol_types_of(s, d):
    return stats.symbol_types_of(_chunks(s, d), table(s, d, "file_index_state").where("tree_has_error"))


@query(f"SELECT 'python' AS name, count(*) FILTER (lower(language) = 'python') AS matches FROM {ONCE} UNION ALL SELECT 'source tree', count(*) FILTER (file_path LIKE 'src/%') FROM {ONCE}")
def match_counts(s, d):
    return stats.match_counts(_chunks(s, d), {"python": F.lower("language") == "python", "source tree": t.glob_matches(F.col("file_path"), ["src/**"])})


@query(f"SELECT c.id, c.file_path FROM {ONCE} c WHERE EXISTS (SELECT 1 FROM vectors v WHERE v.chunk_id = c.id AND v.tombstoned)")
def chunks_by_ids(s, d):
    return stats.by_ids(_chunks(s, d), table(s, d, "vectors").where("tombstoned").select(F.col("chunk_id").alias("id"))).select("id", "file_path")


@query(f"""SELECT file_id, CASE WHEN n >= 1073741824 THEN printf('%.1f GB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.1f KB', n / 1024.0) ELSE n || ' B' END AS size
    FROM (SELECT file_id, strlen(content) * m AS n, m FROM {_FILES}, (VALUES (1), (1000), (1000000)) k(m) WHERE content IS NOT NULL)""")
def byte_sizes(s, d):
    f = _files(s, d).where("content is not null").select("file_id", F.octet_length("content").cast("long").alias("n"), F.explode(F.array(F.lit(1), F.lit(1000), F.lit(1000000))).alias("m"))
    return f.select("file_id", v.bytes_text(F.col("n") * F.col("m")).alias("size"))


@query(f"""SELECT file_id, (array_length(string_split(decode(encode(content)[1:strlen(content) // 2]), chr(10))))::BIGINT AS line FROM {_FILES} WHERE content IS NOT NULL AND strlen(content) = length(content)""")
def lines_of_bytes(s, d):
    f = _files(s, d).where("content is not null and octet_length(content) = length(content)")
    return f.select("file_id", v.line_of_byte(F.col("content"), F.floor(F.octet_length("content") / 2)).cast("long").alias("line"))


@query(f"""SELECT file_id, CASE WHEN len(x) < 3 THEN NULL ELSE strlen(array_to_string(x[1:2], chr(10))) + 1 END AS third FROM (SELECT file_id, string_split(content, chr(10)) AS x FROM {_FILES} WHERE content IS NOT NULL)""")
def bytes_of_lines(s, d):
    f = _files(s, d).where("content is not null")
    return f.select("file_id", F.when(F.size(F.split("content", "\n")) >= 3, v.byte_of_line(F.col("content"), F.lit(3))).cast("long").alias("third"))


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(query), '[a-z]{3,}')) AS a FROM search_requests), p AS (SELECT x.a, y.a AS b, least(length(x.a), length(y.a)) AS n FROM w x JOIN w y ON x.a < y.a AND x.a[1:3] = y.a[1:3])
    SELECT a, b FROM p WHERE CASE WHEN n <= 5 THEN a[1:4] = b[1:4] AND n >= 4 ELSE a[1:5] = b[1:5] END""")
def shared_stems(s, d):
    """Words of the requests that share a stem; pairs meet by their first three letters."""
    w = table(s, d, "search_requests").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit("[a-z]{3,}"), F.lit(0)))).alias("a")).distinct()
    pairs = w.withColumn("key", F.substring("a", 1, 3)).join(w.select(F.col("a").alias("b"), F.substring("a", 1, 3).alias("key")), "key").where("a < b")
    return pairs.where(v.shares_stem(F.col("a"), F.col("b"))).select("a", "b")


@query("""SELECT vec_id, round(list_sum(list_transform(x, lambda e: e * e)), 6) AS norm, round(x[1], 6) AS first, len(x) AS dim FROM (
    SELECT vec_id, list_transform(embedding[1:16], lambda e: e::DOUBLE / sqrt(list_sum(list_transform(embedding[1:16], lambda y: y::DOUBLE * y::DOUBLE)))) AS x FROM embeddings)""")
def shortened_vectors(s, d):
    x = table(s, d, "embeddings").select("vec_id", v.shortened(F.col("embedding"), 16).alias("x"))
    return x.select("vec_id", F.round(F.aggregate("x", F.lit(0.0), lambda a, e: a + e * e), 6).alias("norm"), F.round(F.get("x", F.lit(0)), 6).alias("first"), F.size("x").cast("long").alias("dim"))


@query("""SELECT label, round(list_sum(list_transform(range(1, 65), lambda i: power(m[i], 2))), 6) AS norm FROM (SELECT label, list_transform(t, lambda e: e / sqrt(list_sum(list_transform(t, lambda y: y * y)))) AS m FROM
    (SELECT label, list(total ORDER BY i) AS t FROM (SELECT label, i, sum(embedding[i]::DOUBLE) AS total FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1))""")
def pooled_vectors(s, d):
    x = table(s, d, "embeddings").groupBy("label").agg(v.pooled(F.collect_list("embedding")).alias("m"))
    return x.select("label", F.round(F.aggregate("m", F.lit(0.0), lambda a, e: a + e * e), 6).alias("norm"))


_WORDS_OF = "list_filter(string_split_regex(trim(query), '\\s+'), lambda x: x <> '')"


@query(f"""WITH k AS (SELECT b.id, b.query, q.kind, len({_WORDS_OF}) AS n FROM benchmark_tasks b JOIN ({{kinds}}) q ON q.id = b.id)
    SELECT DISTINCT id, CASE WHEN kind = 'natural' AND n >= 4 AND NOT (contains(query, '/') OR contains(query, chr(92))) THEN 150 WHEN kind = 'natural' THEN 50 ELSE 10 END AS fetch,
        CASE WHEN contains(query, '/') OR contains(query, chr(92)) THEN 100 WHEN kind = 'natural' THEN 50 WHEN n <= 2 THEN 80 ELSE 30 END AS words, 50 AS vectors FROM k""")
def candidate_sizes(s, d):
    q = F.col("query")
    b = table(s, d, "benchmark_tasks").where("query is not null")
    return b.select("id", candidates.fetch_limit(q, 10).alias("fetch"), candidates.lexical_pool(q, 10).alias("words"), candidates.pool_size(t.query_kind(q), 10).alias("vectors")).distinct()


@query("""SELECT task_id, lane, stamp FROM (SELECT task_id, lane, CASE WHEN epoch(ingested_at) - epoch(finished_at) > 3 THEN epoch_us(finished_at) || '-' || 7 END AS stamp FROM task_results)
    WHERE stamp IS NOT NULL GROUP BY ALL""")
def trusted_stamps(s, d):
    """Stamps of what was last written long enough before it was looked at."""
    r = table(s, d, "task_results").select("task_id", "lane", v.trusted_stamp(F.col("finished_at"), F.lit(7), F.col("ingested_at"), F.lit("x.py")).alias("stamp"))
    return r.where("stamp is not null").distinct()


def _kinds() -> str:
    from sievework.plans import index

    return index.SQL["query_kinds"]


SQL["candidate_sizes"] = SQL["candidate_sizes"].replace("{kinds}", _kinds())
QUERIES = Q

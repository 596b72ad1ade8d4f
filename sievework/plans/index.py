"""Queries over the index tables: filters, statistics, graph, search, evaluation, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions import text as t
from sievework.operators import candidates, chunking, evaluation, filters, graph, ranking, retrieval, stats, update
from sievework.session import table, work_path


def _chunks(spark: SparkSession, d: str, where=None) -> DataFrame:
    """Chunks once per id. Rows of one id are copies, so a condition goes in front and reaches the scan."""
    rows = table(spark, d, "chunks")
    return stats.once(rows if where is None else rows.where(where))


def _delivered(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as delivered, copies included: for operators whose results are distinct anyway, no shuffle of content."""
    return table(spark, d, "chunks").where("id is not null")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_requests").select(F.col("request_id").alias("query_id"), "repo", "query")


_INDEXES: dict[tuple[str, str], str] = {}


def _stored(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """The index over the chunks of a folder: each chunk once, postings, lengths and vectors; written once per application and read by every search.

    Chunks are numbered (``no``) in the order of their ids; the search tables have the numbers as ids.
    """
    key = (s.sparkContext.applicationId, d)
    if key not in _INDEXES:
        root = work_path(s, "index")
        ranges = stats.once(_delivered(s, d).repartitionByRange("id")).sortWithinPartitions("id")
        ranges.withColumn("no", F.monotonically_increasing_id()).write.parquet(f"{root}/chunks")
        retrieval.write_search_tables(s.read.parquet(f"{root}/chunks").drop("id").withColumnRenamed("no", "id"), root)
        _INDEXES[key] = root
    return {"chunks": s.read.parquet(f"{_INDEXES[key]}/chunks"), **retrieval.read_search_tables(s, _INDEXES[key])}


def _named(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits of the index with the ids of their chunks for the numbers."""
    return hits.withColumnRenamed("id", "no").join(chunks.select("no", "id"), "no").select("query_id", "id", "score", "rank")


ONCE = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY id) AS dup FROM chunks WHERE id IS NOT NULL) WHERE dup = 1)"
Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- filters and predicates
@query(f"SELECT id FROM {ONCE} WHERE lower(language) = 'rust'")
def filter_language(s, d):
    return _chunks(s, d, F.lower("language") == "rust").select("id")


@query(f"SELECT id FROM {ONCE} WHERE regexp_matches(file_path, '^(|.*/)core/(|.*/)[^/]*\\.py$') OR file_path LIKE 'src/storage/%'")
def filter_glob(s, d):
    return _chunks(s, d, t.glob_matches(F.col("file_path"), ["**/core/**/*.py", "src/storage/**"])).select("id")


@query(f"SELECT id FROM {ONCE} WHERE file_path LIKE 'packages/web/%'")
def filter_folder_prefix(s, d):
    return _chunks(s, d, t.glob_matches(F.col("file_path"), ["./packages/web/"])).select("id")


@query(f"SELECT c.id FROM {ONCE} c WHERE EXISTS (SELECT 1 FROM file_index_state f WHERE f.status = 'parse_error' AND f.repo = c.repo AND f.file_path = c.file_path)")
def filter_exact_paths(s, d):
    wanted = table(s, d, "file_index_state").where("status = 'parse_error'").select("repo", "file_path").distinct()
    return _chunks(s, d).join(wanted, ["repo", "file_path"], "left_semi").select("id")


@query(f"SELECT id FROM {ONCE} WHERE lower(symbol_type) IN ('function', 'method')")
def filter_symbol_type(s, d):
    return _chunks(s, d, filters.symbol_type_is(F.col("symbol_type"), "Method")).select("id")


def _words_sql(col: str) -> str:
    return f"string_split_regex(lower({col}), '[^a-z0-9]+')"


def _any_sql(words: str, wanted) -> str:
    return f"list_has_any({words}, [{', '.join(repr(w) for w in wanted)}])"


_W = _words_sql("file_path")
_FOLDERS = "string_split(lower(file_path), '/')[:-2]"
CLASS_SQL = f"""CASE
    WHEN regexp_matches(lower(file_path), '\\.asar|asar\\.unpacked|/tmp/|/temp/|/cache/') OR {_any_sql(_W, t.RUNTIME_WORDS)} THEN 'runtime'
    WHEN {_any_sql(_FOLDERS, t.ARCHIVE_FOLDERS)} OR ({_any_sql(_FOLDERS, ("snapshot", "snapshots"))} AND {_any_sql(_FOLDERS, t.TEST_WORDS)}) THEN 'archive'
    WHEN {_any_sql(_W, t.TEST_WORDS)} THEN 'test' WHEN {_any_sql(_W, t.EXAMPLE_WORDS)} THEN 'example' WHEN {_any_sql(_W, t.BENCH_WORDS)} THEN 'benchmark'
    WHEN language IN ('markdown', 'rst') OR {_any_sql(_W, t.DOC_WORDS)} THEN 'docs' WHEN language IN {t.CONFIG_LANGUAGES!r} THEN 'config'
    WHEN {_any_sql(_W, t.GENERATED_WORDS)} OR contains(lower(file_path), 'node_modules') THEN 'generated' WHEN {_any_sql(_W, t.SOURCE_WORDS)} THEN 'source'
    WHEN coalesce(language, 'unknown') NOT IN ('unknown', 'markdown', 'rst') THEN 'source' ELSE 'unknown' END"""
_LINES = "string_split(regexp_replace(content, '\\n$', ''), chr(10))"
MINIFIED_SQL = f"""(CASE WHEN content = '' OR len({_LINES}) <= 1 THEN strlen(content) >= 1200 ELSE
    len(list_filter({_LINES}, lambda x: strlen(x) >= 240)) * 3 >= len({_LINES}) OR (strlen(content) // len({_LINES}) >= 180 AND len(list_filter({_LINES}, lambda x: strlen(x) >= 240)) * 2 >= len({_LINES}))
    OR contains(content, 'sourceMappingURL=') OR contains(content, '__webpack_require__') END)"""


@query(f"SELECT {CLASS_SQL} AS class, count(*) AS chunks FROM {ONCE} GROUP BY 1")
def path_classes(s, d):
    return _chunks(s, d).groupBy(t.path_class(F.col("file_path"), F.col("language")).alias("class")).agg(F.count("*").alias("chunks"))


_FILES = "(SELECT * FROM (SELECT file_id, repo, relative_path AS file_path, lower(language) AS language, content, row_number() OVER (PARTITION BY file_id ORDER BY discovered_at) AS dup FROM discovered_files) WHERE dup = 1)"


def _files(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "discovered_files").dropDuplicates(["file_id"]).select("file_id", "repo", F.col("relative_path").alias("file_path"), F.lower("language").alias("language"), "content")


@query(f"SELECT file_id, {MINIFIED_SQL} AS minified FROM {_FILES} WHERE content IS NOT NULL")
def minified_files(s, d):
    return _files(s, d).where("content is not null").select("file_id", t.looks_minified(F.col("content")).alias("minified"))


_STRICT = CLASS_SQL.replace("language IN ('markdown', 'rst')", "false").replace(f"language IN {t.CONFIG_LANGUAGES!r}", "false").replace("coalesce(language, 'unknown') NOT IN ('unknown', 'markdown', 'rst')", "false")
CONTENT_SQL = f"CASE WHEN {CLASS_SQL} IN ('source', 'unknown', 'runtime') AND ({_STRICT} = 'generated' OR coalesce({MINIFIED_SQL}, false)) THEN 'generated' ELSE {CLASS_SQL} END"


@query(f"SELECT language, {CONTENT_SQL} AS class, count(*) AS files FROM {_FILES} GROUP BY ALL")
def content_classes(s, d):
    cls = t.content_class(F.col("file_path"), F.col("language"), F.col("content"))
    return _files(s, d).groupBy("language", cls.alias("class")).agg(F.count("*").alias("files"))


@query(f"""SELECT r.request_id, count(*) AS files FROM search_requests r JOIN (SELECT *, {CONTENT_SQL} AS class FROM {_FILES}) f ON f.repo = r.repo
    WHERE CASE lower(r.scope) WHEN 'source' THEN f.class IN {t.SCOPES["source"]!r} OR (coalesce(r.include_generated, false) AND f.class = 'generated')
        WHEN 'docs' THEN f.class IN {t.SCOPES["docs"]!r} WHEN 'runtime' THEN f.class = 'runtime' OR (coalesce(r.include_generated, false) AND f.class = 'generated')
        ELSE f.class <> 'generated' OR coalesce(r.include_generated, false) END GROUP BY 1""")
def scope_visibility(s, d):
    """Files in the scope of each request, counted by class first: requests never meet single files."""
    cls = t.content_class(F.col("file_path"), F.col("language"), F.col("content"))
    per = _files(s, d).groupBy("repo", cls.alias("class")).agg(F.count("*").alias("n"))
    asked = table(s, d, "search_requests").select("request_id", "repo", "scope", "include_generated")
    seen = asked.join(per, "repo").where(t.in_scope(F.col("class"), F.col("scope"), F.col("include_generated")))
    return seen.groupBy("request_id").agg(F.sum("n").alias("files"))


@query(f"""SELECT id FROM {ONCE} WHERE lower(language) = 'python' AND lower(symbol_type) IN ('function', 'method') AND file_path LIKE 'src/%'
    AND {CONTENT_SQL} IN {t.SCOPES["source"]!r}""")
def filter_all(s, d):
    f = filters.SearchFilters(language="Python", globs=("src/**",), symbol_type="function", scope="source")
    return _chunks(s, d, f.condition()).select("id")


_PATTERNS = ["src/**", "core", "**/*.rs", "nothing/here"]


@query(f"""WITH p AS (SELECT DISTINCT repo, file_path FROM chunks),
    m AS (SELECT count(*) FILTER (file_path LIKE 'src/%') AS a, count(*) FILTER (regexp_matches(file_path, '^(|.*/)src/.*')) AS a2,
        count(*) FILTER (file_path LIKE 'core/%' OR file_path = 'core') AS b, count(*) FILTER (regexp_matches(file_path, '^(|.*/)core/')) AS b2,
        count(*) FILTER (file_path LIKE '%.rs') AS c FROM p)
    SELECT *, CASE WHEN matches = 0 AND near > 0 THEN '**/' || pattern || '/**' END AS suggestion FROM (
    SELECT 'src/**' AS pattern, a AS matches, a2 AS near FROM m UNION ALL SELECT 'core', b, b2 FROM m UNION ALL SELECT '**/*.rs', c, 0 FROM m UNION ALL SELECT 'nothing/here', 0, 0)""")
def glob_near_misses(s, d):
    paths = table(s, d, "chunks").select("repo", "file_path").distinct()
    return filters.near_misses(paths, _PATTERNS)


@query(f"SELECT file_path, line_start, symbol_name, repo FROM {ONCE} WHERE lower(symbol_name) = (SELECT min(lower(symbol_name)) FROM chunks)")
def symbol_lookup(s, d):
    c = _chunks(s, d)
    name = c.agg(F.min(F.lower("symbol_name"))).first()[0]
    return graph.lookup(c, name or "").select("file_path", "line_start", "symbol_name", "repo")


# ---------------------------------------------------------------- statistics
@query(f"SELECT count(*) AS chunks, count(DISTINCT repo || '|' || file_path) AS files, coalesce(sum(line_end - line_start + 1), 0)::BIGINT AS lines FROM {ONCE}")
def index_counts(s, d):
    return stats.counts(_chunks(s, d))


@query(f"""SELECT language, count(*) AS chunks, count(DISTINCT repo || '|' || file_path) AS files, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS percent FROM {ONCE} GROUP BY 1""")
def language_stats(s, d):
    return stats.language_stats(_chunks(s, d))


@query("""SELECT language, count(*) AS total, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status = 'parse_error') AS parse_error,
    count(*) FILTER (tree_has_error) AS tree_error, count(*) FILTER (tier0_fallback) AS fallback, coalesce(sum(chunk_count), 0)::BIGINT AS chunks FROM file_index_state GROUP BY 1""")
def index_health(s, d):
    return stats.index_health(table(s, d, "file_index_state"))


@query(f"""SELECT CASE WHEN instr(file_path, '/') > 0 THEN substr(file_path, 1, instr(file_path, '/') - 1) ELSE '.' END AS directory,
    count(DISTINCT repo || '|' || file_path) AS files FROM {ONCE} GROUP BY 1 ORDER BY files DESC, directory LIMIT 15""")
def top_directories(s, d):
    return stats.top_directories(_chunks(s, d), 15)


@query(f"SELECT symbol_type, count(*) AS chunks FROM {ONCE} WHERE symbol_type IS NOT NULL GROUP BY 1")
def symbol_types(s, d):
    return stats.symbol_types(_chunks(s, d, "symbol_type is not null"))


@query(f"SELECT repo, file_path, count(*) AS chunks FROM {ONCE} GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10")
def hotspots(s, d):
    return stats.hotspots(_chunks(s, d), 10)


@query(f"SELECT repo, file_path, count(*) AS chunks, max(line_end) AS last_line, min(language) AS language FROM {ONCE} GROUP BY 1, 2")
def file_summaries(s, d):
    return stats.file_summaries(_chunks(s, d))


def _sign_sql(mark: str) -> str:
    path = "'/' || file_path || '/'"
    hits = [f"contains({path}, '/{mark}/')"]
    if mark in stats.OPEN_ENDED:
        hits.append(f"contains({path}, '/{mark}.')")
    if mark == ".proto":
        hits.append("file_path LIKE '%.proto'")
    return " OR ".join(hits)


_CONVENTION_PATHS = ("crates/a/Cargo.toml", "web/vite.config.ts", ".github/workflows/ci.yml", "api/user.proto", "my.github/workflows", "db/migrations/1.sql", "Makefile.old")


def _conventions_sql() -> str:
    planted = ", ".join(f"('planted', '{p}')" for p in _CONVENTION_PATHS)
    rows = f"(SELECT repo, file_path FROM {ONCE} UNION ALL SELECT * FROM (VALUES {planted}) p(repo, file_path))"
    return " UNION ALL ".join(f"SELECT DISTINCT repo, '{name}' AS convention FROM {rows} WHERE {' OR '.join(map(_sign_sql, marks))}" for name, marks in stats.CONVENTIONS.items())


@query(_conventions_sql())
def conventions(s, d):
    planted = s.createDataFrame([("planted", p) for p in _CONVENTION_PATHS], "repo string, file_path string")
    return stats.conventions(_delivered(s, d).select("repo", "file_path").unionByName(planted))


@query("""SELECT repo, count(*) AS files, count(*) FILTER (e.file_path IS NOT NULL) AS with_error FROM file_index_state f
    LEFT JOIN (SELECT DISTINCT repo AS r, file_path FROM parse_errors) e ON e.r = f.repo AND e.file_path = f.file_path GROUP BY 1""")
def reported_errors(s, d):
    e = table(s, d, "parse_errors").select("repo", "file_path").distinct().withColumn("hit", F.lit(1))
    return table(s, d, "file_index_state").join(e, ["repo", "file_path"], "left").groupBy("repo").agg(F.count("*").alias("files"), F.count("hit").alias("with_error"))


# ---------------------------------------------------------------- derived text
@query(f"""WITH x AS (SELECT DISTINCT file_path FROM chunks), y AS (SELECT file_path, regexp_extract(file_path, '[^/]*$') AS name,
    trim(regexp_replace(lower(regexp_replace(file_path, '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g')), '[/_.\\s-]+', ' ', 'g')) AS c FROM x)
    SELECT file_path, CASE WHEN c = '' THEN name WHEN contains(c, name) THEN c ELSE c || ' ' || name END AS tokens FROM y""")
def path_tokens(s, d):
    return table(s, d, "chunks").select("file_path").distinct().select("file_path", t.path_tokens(F.col("file_path")).alias("tokens"))


_PARTS = """list_filter(string_split(lower(CASE WHEN contains(k, '_') THEN k ELSE regexp_replace(regexp_replace(k, '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z])([A-Z])', '\\1_\\2', 'g') END), '_'), lambda p: p <> '')"""


@query(f"""SELECT id, coalesce(array_to_string(list_sort(list_distinct(list_filter(flatten(list_filter(list_transform(regexp_extract_all(content, '[A-Za-z0-9_]{{4,}}'), lambda k: {_PARTS}), lambda q: len(q) >= 2)), lambda p: len(p) >= 2))), ' '), '') AS parts FROM {ONCE} WHERE content IS NOT NULL""")
def split_identifiers(s, d):
    return _chunks(s, d, "content is not null").select("id", t.split_identifiers(F.col("content")).alias("parts"))


_LOW = "lower(content)"
_HAS = lambda *w: "(" + " OR ".join(f"contains({_LOW}, '{x}')" for x in w) + ")"


@query(f"""SELECT id, array_to_string(list_filter([
    CASE WHEN {_HAS('if ', ' else', 'match ', 'switch ', 'case ')} THEN 'branches' END, CASE WHEN {_HAS('for ', 'while ', 'loop ', '.iter(', '.map(', '.filter(')} THEN 'loops' END,
    CASE WHEN {_HAS('try', 'catch', 'except', 'raise', 'throw', 'err(', 'result<', 'bail!', 'panic!', 'abort(')} THEN 'error handling' END], lambda x: x IS NOT NULL), ', ') AS hints FROM {ONCE} WHERE content IS NOT NULL""")
def flow_hints(s, d):
    return _chunks(s, d, "content is not null").select("id", t.flow_hints(F.col("content")).alias("hints"))


@query(f"SELECT id, CASE WHEN part_index IS NOT NULL THEN symbol_name || ' (part ' || part_index || ')' ELSE symbol_name END AS name FROM {ONCE} WHERE symbol_name IS NOT NULL")
def display_names(s, d):
    return _chunks(s, d, "symbol_name is not null").select("id", t.display_name(F.col("symbol_name"), F.col("part_index")).alias("name"))


@query(f"SELECT repo, sum(ceil(strlen(content) / 4.0))::BIGINT AS tokens FROM {ONCE} GROUP BY 1")
def token_estimates(s, d):
    return _chunks(s, d).groupBy("repo").agg(F.sum(t.token_estimate(F.col("content"))).alias("tokens"))


@query(f"""WITH l AS (SELECT file_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS n FROM {_FILES} WHERE content IS NOT NULL),
    m AS (SELECT *, strlen(trim(line)) >= 40 AND len(regexp_extract_all(trim(line), '\\p{{L}}{{4,}}')) <= 1 AS data FROM l),
    g AS (SELECT *, n - row_number() OVER (PARTITION BY file_id, data ORDER BY n) AS run FROM m),
    r AS (SELECT file_id, run, count(*) AS size FROM g WHERE data GROUP BY 1, 2)
    SELECT file_id, sum(size)::BIGINT AS data_lines, count(*) AS runs FROM r WHERE size >= 4 GROUP BY 1""")
def data_line_runs(s, d):
    """What the collapse of data-dense lines replaces, per file, read from its marks."""
    marks = F.regexp_extract_all(chunking.collapsed(F.col("content")), F.lit(r"(?m)^\[(\d+) lines of data\]$"), F.lit(1))
    sizes = _files(s, d).where("content is not null").select("file_id", F.explode(marks).alias("size")).select("file_id", F.col("size").cast("long").alias("size"))
    return sizes.groupBy("file_id").agg(F.sum("size").alias("data_lines"), F.count("*").alias("runs"))


# ---------------------------------------------------------------- windows of text
@query(f"""WITH l AS (SELECT file_id, {_LINES} AS x FROM {_FILES} WHERE content IS NOT NULL AND trim(content) <> ''),
    w AS (SELECT file_id, x, unnest(range(0, greatest(len(x) - 10, 1), 40)) AS pos FROM l)
    SELECT file_id, (pos + 1)::INT AS line_start, least(pos + 50, len(x))::INT AS line_end, strlen(array_to_string(x[pos + 1:pos + 50], chr(10))) AS n_bytes
    FROM w WHERE regexp_matches(array_to_string(x[pos + 1:pos + 50], chr(10)), '\\S')""")
def windows_of_lines(s, d):
    """Windows of 50 lines, ten of them shared with the next, without blank ones."""
    f = _files(s, d).where("content is not null and trim(content) != ''").select("file_id", t.text_lines(F.col("content")).alias("x"))
    w = f.select("file_id", "x", F.explode(chunking.window_bounds(F.size("x"))).alias("w")).select("file_id", "w.line_start", "w.line_end", F.array_join(F.slice("x", F.col("w.line_start"), F.col("w.line_end") - F.col("w.line_start") + 1), "\n").alias("part"))
    return w.where(F.col("part").rlike(r"\S")).select("file_id", "line_start", "line_end", F.octet_length("part").alias("n_bytes"))


# ---------------------------------------------------------------- references
_KW = ", ".join(repr(k) for k in graph.CALL_KEYWORDS)
EDGES_SQL = f"""(SELECT repo, file_path, first + n - 1 AS line, callee, nullif(qualifier, '') AS qualifier, caller FROM (
    SELECT repo, file_path, caller, first, n, unnest(regexp_extract_all(text, '(?:([A-Za-z_]\\w*)\\s*(?:\\.|::|->)\\s*)?([A-Za-z_]\\w*)\\s*\\(', 2)) AS callee,
           unnest(regexp_extract_all(text, '(?:([A-Za-z_]\\w*)\\s*(?:\\.|::|->)\\s*)?([A-Za-z_]\\w*)\\s*\\(', 1)) AS qualifier
    FROM (SELECT repo, file_path, symbol_name AS caller, coalesce(line_start, 1) AS first, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS n
          FROM {ONCE} WHERE symbol_name IS NOT NULL AND content IS NOT NULL))
    WHERE lower(callee) NOT IN ({_KW}) AND lower(callee) <> lower(caller))"""


@query(f"SELECT repo, file_path, line::INT AS line, callee, qualifier, caller FROM {EDGES_SQL}")
def call_edges(s, d):
    return graph.call_edges(_chunks(s, d))


@query(f"SELECT lower(caller) AS caller, lower(callee) AS callee, count(*) AS calls FROM {EDGES_SQL} GROUP BY 1, 2")
def callees(s, d):
    return graph.callees(graph.call_edges(_chunks(s, d)))


@query(f"SELECT n.name, e.repo, e.file_path, e.line::INT AS line, e.caller FROM {EDGES_SQL} e JOIN (SELECT DISTINCT symbol_name AS name FROM chunks) n ON lower(e.callee) = lower(n.name)")
def callers(s, d):
    c = _chunks(s, d)
    return graph.callers(graph.call_edges(c), c.select(F.col("symbol_name").alias("name")).where("name is not null")).select("name", "repo", "file_path", "line", "caller")


@query(f"SELECT lower(callee) AS callee, min(qualifier) AS qualifier, count(*) AS calls FROM {EDGES_SQL} WHERE qualifier IS NOT NULL GROUP BY lower(callee), lower(qualifier)")
def call_qualifiers(s, d):
    return graph.qualifiers(graph.call_edges(_chunks(s, d)))


@query(f"""SELECT repo, file_path, min(symbol_name) AS symbol, min(line_start) AS line, min(symbol_type) AS kind FROM {ONCE} c
    WHERE symbol_name IS NOT NULL AND lower(symbol_type) IN ('function', 'method') AND lower(symbol_name) NOT IN {graph.RUNTIME_NAMES!r}
      AND NOT EXISTS (SELECT 1 FROM {EDGES_SQL} e WHERE e.repo = c.repo AND lower(e.callee) = lower(c.symbol_name)) GROUP BY repo, file_path, lower(symbol_name)""")
def dead_symbols(s, d):
    c = _delivered(s, d)
    return graph.dead_symbols(c, graph.call_edges(c))


@query(f"""SELECT repo, file_path, symbol_name, symbol_type, line_start FROM (SELECT *, row_number() OVER (PARTITION BY repo, file_path, lower(symbol_name) ORDER BY line_start NULLS FIRST, id) AS n
    FROM {ONCE} WHERE symbol_name IS NOT NULL) WHERE n = 1""")
def definitions(s, d):
    return graph.definitions(_delivered(s, d))


_LINE_ROWS = f"(SELECT repo, file_path, coalesce(line_start, 1) AS first, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM {ONCE} WHERE content IS NOT NULL)"


_LINE_SNIPPETS = f"""(SELECT repo, file_path, first, n, x[n] AS text, array_to_string(x[greatest(n - 2, 1):n + 2], chr(10)) AS snippet FROM
    (SELECT repo, file_path, coalesce(line_start, 1) AS first, string_split(content, chr(10)) AS x, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS n FROM {ONCE} WHERE content IS NOT NULL))"""


def _match_sql(pattern: str, cols: str) -> str:
    p = pattern.replace("'", "''")
    return f"SELECT DISTINCT repo, file_path, (first + n - 1)::INT AS line, {cols.format(p=p)} FROM {_LINE_ROWS} WHERE regexp_matches(text, '{p}')"


_THROW = r"(?:throw new|raise|return Err\(|errors\.New\()\s*([A-Za-z_]\w*)?"


@query(_match_sql(_THROW, "regexp_extract(text, '{p}', 1) AS g1"))
def structural_raises(s, d):
    return graph.matches(_delivered(s, d), _THROW)


@query(f"SELECT repo, file_path, (first + n - 1)::INT AS line, min(text) AS text, max(snippet) AS snippet FROM {_LINE_SNIPPETS} WHERE regexp_matches(text, '(?i)out of range') GROUP BY ALL")
def regex_search(s, d):
    return graph.regex_search(_delivered(s, d), "out of range", 2, case_sensitive=False)


@query(f"""WITH p AS ({_match_sql(_THROW, "1 AS x")}), j AS (SELECT p.repo, p.file_path, p.line, c.line_start, c.line_end, c.symbol_name, row_number() OVER (PARTITION BY p.repo, p.file_path, p.line
        ORDER BY c.line_end - c.line_start, c.line_start, c.line_end, c.symbol_name NULLS FIRST) AS k
    FROM p JOIN {ONCE} c ON c.repo = p.repo AND c.file_path = p.file_path AND p.line BETWEEN c.line_start AND c.line_end WHERE c.symbol_name IS NOT NULL OR c.symbol_type IS NOT NULL)
    SELECT repo, file_path, line, line_start, line_end, symbol_name FROM j WHERE k = 1""")
def enclosing_symbols(s, d):
    c = _delivered(s, d)
    return graph.enclosing(graph.matches(c, _THROW).select("repo", "file_path", "line").distinct(), c)


# ---------------------------------------------------------------- vectors and chunks
@query(f"SELECT id FROM {ONCE} c WHERE NOT EXISTS (SELECT 1 FROM vectors v WHERE v.chunk_id = c.id AND v.vector IS NOT NULL AND NOT coalesce(v.tombstoned, false))")
def chunks_without_vector(s, d):
    have = table(s, d, "vectors").where("vector is not null and not coalesce(tombstoned, false)").select("chunk_id")
    return update.missing_vectors(_chunks(s, d).select("id"), have)


@query("""SELECT DISTINCT rowid FROM vectors v WHERE NOT EXISTS (SELECT 1 FROM chunks c JOIN file_index_state f ON f.repo = c.repo AND f.file_path = c.file_path AND f.status = 'indexed' WHERE c.id = v.chunk_id)""")
def orphan_vectors(s, d):
    """Vectors of chunks that are gone, or whose file is no longer indexed well."""
    indexed = table(s, d, "file_index_state").where("status = 'indexed'").select("repo", "file_path").distinct()
    live = table(s, d, "chunks").select("id", "repo", "file_path").join(indexed, ["repo", "file_path"], "left_semi")
    return update.orphans(table(s, d, "vectors").select("rowid", "chunk_id"), live).select("rowid").distinct()


@query("SELECT v.database_id, m.generation, count(DISTINCT v.rowid) AS row_count, count(DISTINCT v.rowid) FILTER (len(v.vector) = m.dim) AS fitting FROM vectors v LEFT JOIN flat_manifest m ON m.database_id = v.database_id GROUP BY 1, 2")
def vector_inventory(s, d):
    m = table(s, d, "flat_manifest")
    v = table(s, d, "vectors").join(F.broadcast(m.select("database_id", "dim", "generation")), "database_id", "left")
    return v.groupBy("database_id", "generation").agg(F.countDistinct("rowid").alias("row_count"), F.countDistinct(F.when(F.size("vector") == F.col("dim"), F.col("rowid"))).alias("fitting"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
    s AS (SELECT query_id, vec_id AS id, 1 / (1 + sqrt(list_sum(list_transform(range(1, 65), lambda i: power(q[i]::DOUBLE - embedding[i]::DOUBLE, 2))))) AS score FROM q, embeddings)
    SELECT query_id, id, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""")
def nearest_embeddings(s, d):
    """Exact search of every vector whose id is divisible by 20, among all."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.lit(1).alias("one"))
    return retrieval.vector_search(e, e.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 5, groups=("one",)).withColumn("score", F.round("score", 9))


# ---------------------------------------------------------------- search
_TERMS = lambda x: f"list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+'), lambda w: len(w) <= 40)"
_TOKENS_SQL = SQL["path_tokens"]
BM25_SQL = f"""WITH c AS (SELECT c.*, p.tokens FROM {ONCE} c JOIN ({_TOKENS_SQL}) p ON p.file_path = c.file_path),
    f AS (SELECT repo, id, 'filename' AS field, 2.0 AS boost, 8.0 AS boost_paths, {_TERMS("regexp_extract(file_path, '[^/]*$')")} AS terms FROM c
        UNION ALL SELECT repo, id, 'path_tokens', 1.5, 5.0, {_TERMS("tokens")} FROM c UNION ALL SELECT repo, id, 'symbol_name', 3.0, 2.0, {_TERMS("coalesce(symbol_name, '')")} FROM c
        UNION ALL SELECT repo, id, 'content', 1.0, 1.0, {_TERMS("coalesce(content, '')")} FROM c),
    q AS (SELECT request_id AS query_id, repo, contains(query, '/') OR contains(query, chr(92)) AS for_paths, unnest(list_distinct({_TERMS("query")})) AS term FROM search_requests),
    len AS (SELECT repo, field, count(*) AS docs, avg(len(terms)) AS mean FROM f GROUP BY 1, 2),
    post AS (SELECT repo, id, field, boost, boost_paths, term, count(*) AS tf, max(size) AS size FROM (SELECT repo, id, field, boost, boost_paths, len(terms) AS size, unnest(terms) AS term FROM f)
        WHERE (repo, term) IN (SELECT repo, term FROM q) GROUP BY ALL),
    df AS (SELECT repo, field, term, count(*) AS df FROM post GROUP BY ALL),
    w AS (SELECT p.repo, p.id, p.term, sum(boost * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS w,
            sum(boost_paths * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS wp
        FROM post p JOIN df USING (repo, field, term) JOIN len USING (repo, field) GROUP BY ALL),
    sc AS (SELECT query_id, id, sum(CASE WHEN for_paths THEN wp ELSE w END) AS score FROM q JOIN w USING (repo, term) GROUP BY ALL)
    SELECT query_id, id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, id) AS rank FROM sc"""


@query(f"SELECT * FROM ({BM25_SQL}) WHERE rank <= 10")
def search_lexical(s, d):
    stored = _stored(s, d)
    return _named(retrieval.score_postings(stored["postings"], stored["lengths"], _requests(s, d), 10, digits=4), stored["chunks"])


@query()
def search_hybrid(s, d):
    """Lexical and vector search of all requests, fused by reciprocal rank."""
    stored = _stored(s, d)
    return _named(retrieval.hybrid(stored["chunks"], _requests(s, d), 10, stored=stored), stored["chunks"])


@query()
def search_ranked(s, d):
    """Hybrid search, ranked anew by paths, symbols and classes, spread over files."""
    stored, q = _stored(s, d), _requests(s, d)
    fused = retrieval.hybrid(stored["chunks"], q, 150, stored=stored, width=candidates.fetch_limit(F.col("query"), 10)).select("query_id", F.col("id").alias("no"), "rank")
    # texts of queries come first: they are short, and texts of chunks need no shuffle by query
    pool = fused.join(q.select("query_id", "query"), "query_id").join(stored["chunks"], "no")
    return ranking.rank(pool).where("rank <= 10").select("query_id", "rank", "id", F.round("score", 6).alias("score"))


_KIND = f"""CASE WHEN len(w) <= 1 THEN 'identifier' WHEN contains(q, '::') OR contains(q, '->') OR contains(q, '.') THEN 'identifier'
    WHEN len(list_filter(w, lambda x: regexp_matches(x, '_|::|\\.|/|\\\\|\\p{{Ll}}\\p{{Lu}}'))) > len(w) // 2 THEN 'identifier'
    WHEN regexp_matches(lower(q), '^(?:{"|".join(t.QUESTION_STARTS)}) ') OR q LIKE '%?' OR len(list_filter(w, lambda x: lower(x) IN {t.PROSE_WORDS!r})) >= 2
      OR (len(w) >= 3 AND len(list_filter(w, lambda x: lower(x) IN {t.PROSE_WORDS!r})) * 3 >= len(w)) THEN 'natural'
    WHEN len(w) >= 3 THEN 'natural' ELSE 'identifier' END"""


@query(f"""SELECT id, {_KIND} AS kind FROM (SELECT id, q, list_filter(string_split_regex(q, '\\s+'), lambda x: x <> '') AS w FROM
    (SELECT id, regexp_replace(trim(query), '\\.+$', '') AS q FROM benchmark_tasks))""")
def query_kinds(s, d):
    return table(s, d, "benchmark_tasks").select("id", t.query_kind(F.col("query")).alias("kind"))


_LIST = "(SELECT task_id, lane, pos AS rank, x.file_path AS id FROM (SELECT task_id, lane, unnest(results) AS x, generate_subscripts(results, 1) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY lane, task_id ORDER BY finished_at DESC, result_id DESC, ingested_at) AS k FROM task_results) WHERE k = 1))"


@query(f"""WITH l AS (SELECT task_id AS query_id, id, min(rank) AS rank, lane FROM {_LIST} GROUP BY ALL),
    f AS (SELECT query_id, id, round(sum(CASE lane WHEN 'bm25' THEN 2.5 ELSE 1.0 END / (60 + rank)), 9) AS score FROM l GROUP BY 1, 2)
    SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 5""")
def fuse_lanes(s, d):
    """Reciprocal-rank fusion of the lanes' result lists by file."""
    r = evaluation.ranked_results(table(s, d, "task_results").dropDuplicates(["result_id"]))
    lists = r.groupBy(F.col("task_id").alias("query_id"), F.col("file_path").alias("id"), "lane").agg(F.min("rank").alias("rank"))
    lists = lists.withColumn("weight", F.when(F.col("lane") == "bm25", 2.5).otherwise(1.0))
    return retrieval.fuse(lists, 5, digits=9)


@query(f"""WITH l AS (SELECT task_id AS query_id, id, lane AS list, min(rank) AS rank FROM {_LIST} GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY rank, list) AS n FROM l)
    SELECT query_id, id, list, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank, list, id) AS place FROM o WHERE n = 1""")
def interleave_lanes(s, d):
    r = evaluation.ranked_results(table(s, d, "task_results").dropDuplicates(["result_id"]))
    lists = r.groupBy(F.col("task_id").alias("query_id"), F.col("file_path").alias("id"), F.col("lane").alias("list")).agg(F.min("rank").alias("rank"))
    return retrieval.interleave(lists)


@query(f"""WITH b AS (SELECT task_id AS query_id, id, row_number() OVER (PARTITION BY task_id ORDER BY rank, id) AS rank FROM {_LIST} WHERE lane = 'hybrid'),
    n AS (SELECT *, 1 - (rank - 1) / count(*) OVER (PARTITION BY query_id)::DOUBLE AS base, row_number() OVER (PARTITION BY query_id, id ORDER BY rank) AS nth FROM b)
    SELECT query_id, id, rank, round(base * power(0.35, nth - 1), 9) AS score FROM n""")
def diversify_lane(s, d):
    """Base scores of the hybrid lane with the decay of repeated files."""
    r = evaluation.ranked_results(table(s, d, "task_results").dropDuplicates(["result_id"])).where("lane = 'hybrid'")
    w = Window.partitionBy("task_id").orderBy("rank", "file_path")
    pool = r.select(F.col("task_id").alias("query_id"), F.col("file_path").alias("id"), F.row_number().over(w).alias("rank"))
    base = ranking.base_score(F.col("rank"), F.count("*").over(Window.partitionBy("query_id")))
    scored = pool.select("query_id", F.col("id").alias("file"), F.lpad(F.col("rank").cast("string"), 9, "0").alias("id"), base.alias("score"))
    return ranking.diversify(scored).select("query_id", F.col("file").alias("id"), F.col("id").cast("int").alias("rank"), F.round("score", 9).alias("score"))


# ---------------------------------------------------------------- evaluation
_SAME = "(r.file_path = g.file_path OR suffix(r.file_path, '/' || g.file_path) OR suffix(g.file_path, '/' || r.file_path))"
RANKED_SQL = "(SELECT lane, task_id, pos AS rank, x.file_path AS file_path, x.line_start AS line_start, x.line_end AS line_end FROM (SELECT lane, task_id, unnest(results) AS x, generate_subscripts(results, 1) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY lane, task_id ORDER BY finished_at DESC, result_id DESC, ingested_at) AS k FROM task_results) WHERE k = 1))"
TRUTH_SQL = "(SELECT id AS task_id, gt, g.file_path AS file_path, g.line_start AS line_start, g.line_end AS line_end FROM (SELECT id, unnest(ground_truth) AS g, generate_subscripts(ground_truth, 1) AS gt FROM benchmark_tasks))"


@query(f"""WITH r AS {RANKED_SQL}, g AS {TRUTH_SQL}, n AS (SELECT task_id, count(*) AS truths FROM g GROUP BY 1),
    h AS (SELECT r.lane, r.task_id, r.rank, g.gt FROM r JOIN g ON r.task_id = g.task_id AND {_SAME} AND r.line_start <= g.line_end AND r.line_end >= g.line_start),
    f AS (SELECT lane, task_id, count(DISTINCT gt) FILTER (rank <= 1) AS f1, count(DISTINCT gt) FILTER (rank <= 5) AS f5, count(DISTINCT gt) FILTER (rank <= 10) AS f10, 1.0 / min(rank) AS m FROM h GROUP BY 1, 2)
    SELECT a.lane, a.task_id, coalesce(f1, 0) / truths AS recall_1, coalesce(f5, 0) / truths AS recall_5, coalesce(f10, 0) / truths AS recall_10, coalesce(m, 0)::DOUBLE AS mrr
    FROM (SELECT DISTINCT lane, task_id FROM r) a JOIN n ON n.task_id = a.task_id LEFT JOIN f ON f.lane = a.lane AND f.task_id = a.task_id""")
def eval_recall(s, d):
    r = evaluation.ranked_results(table(s, d, "task_results").dropDuplicates(["result_id"]))
    return evaluation.recall_and_mrr(r, evaluation.truths(table(s, d, "benchmark_tasks")))


@query()
def eval_ndcg(s, d):
    r = evaluation.ranked_results(table(s, d, "task_results").dropDuplicates(["result_id"]))
    return evaluation.ndcg(r, evaluation.truths(table(s, d, "benchmark_tasks")))


@query()
def eval_by_category(s, d):
    tasks = table(s, d, "benchmark_tasks")
    r = evaluation.ranked_results(table(s, d, "task_results").dropDuplicates(["result_id"]))
    scores = evaluation.recall_and_mrr(r, evaluation.truths(tasks)).join(evaluation.ndcg(r, evaluation.truths(tasks)), ["lane", "task_id"])
    return evaluation.by_category(scores, tasks, ("recall_1", "recall_5", "recall_10", "mrr", "ndcg"))


@query("""SELECT lane, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95 FROM
    (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY ingested_at) AS k FROM task_results WHERE latency_ms > 0 AND NOT isnan(latency_ms)) WHERE k = 1 GROUP BY 1""")
def eval_latency(s, d):
    return evaluation.latency(table(s, d, "task_results"))


QUERIES = Q

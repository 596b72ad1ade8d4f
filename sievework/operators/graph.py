"""References between symbols: calls, callers, callees, dead code, type relations, definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Names that look like calls, and names that are called by the runtime.
CALL_KEYWORDS = ("if", "for", "while", "match", "switch", "return", "fn", "def", "class", "struct", "enum", "trait", "impl", "catch", "except", "try", "use", "import", "from", "loop", "macro_rules", "where", "new")
RUNTIME_NAMES = ("main", "new", "default", "drop", "clone", "fmt", "from", "into", "deref", "init", "setup", "teardown")
CALL = r"(?:([A-Za-z_]\w*)\s*(?:\.|::|->)\s*)?([A-Za-z_]\w*)\s*\("
ENV_READS = r"(?:os\.environ(?:\.get)?\s*[\[(]\s*|os\.getenv\(\s*|process\.env\.|env::var\(\s*|os\.Getenv\(\s*|System\.getenv\(\s*|getenv\(\s*)[\"']?([A-Za-z_]\w*)"
ROUTES = r"(?i)(?:app|router|server)\.(get|post|put|patch|delete|route)\(\s*[\"']([^\"']+)"
SQL_SITES = r"(?i)[\"'`]\s*(select\s.+?\sfrom|insert\s+into|update\s+\w+\s+set|delete\s+from)\s"
RELATION = r"(?:class|interface|struct|trait)\s+([A-Z]\w*)\s*(?:extends|implements|:|\()\s*([A-Z]\w*)"


def call_edges(chunks: DataFrame) -> DataFrame:
    """repo, file_path, line, callee, qualifier, caller: one row per call in a named chunk."""
    lines = chunks.where("symbol_name is not null and content is not null").select(
        "repo", "file_path", F.col("symbol_name").alias("caller"), F.coalesce("line_start", F.lit(1)).alias("first"), F.posexplode(F.split("content", "\n")).alias("at", "text")
    )
    names = F.regexp_extract_all("text", F.lit(CALL), F.lit(2))
    owners = F.regexp_extract_all("text", F.lit(CALL), F.lit(1))
    calls = lines.select("repo", "file_path", "caller", (F.col("first") + F.col("at")).alias("line"), F.explode(F.arrays_zip(names.alias("callee"), owners.alias("qualifier"))).alias("c"))
    return calls.select("repo", "file_path", "line", "c.callee", F.nullif("c.qualifier", F.lit("")).alias("qualifier"), "caller").where(
        ~F.lower("callee").isin(*CALL_KEYWORDS) & (F.lower("callee") != F.lower("caller"))
    )


def callers(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Calls of each name (column ``name``), whatever the case."""
    return edges.join(names.select(F.lower("name").alias("key"), "name").distinct(), F.lower("callee") == F.col("key")).drop("key")


def callees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.lower("caller").alias("caller"), F.lower("callee").alias("callee")).agg(F.count("*").alias("calls"))


def qualifiers(edges: DataFrame) -> DataFrame:
    """Receivers of the calls of each name."""
    q = edges.where("qualifier is not null").groupBy(F.lower("callee").alias("callee"), F.lower("qualifier").alias("key"))
    return q.agg(F.min("qualifier").alias("qualifier"), F.count("*").alias("calls")).drop("key")


def dead_symbols(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions and methods of a repository that nothing in it calls."""
    called = edges.select("repo", F.lower("callee").alias("key")).distinct()
    named = chunks.where("symbol_name is not null and lower(symbol_type) in ('function', 'method')").withColumn("key", F.lower("symbol_name"))
    lonely = named.where(~F.col("key").isin(*RUNTIME_NAMES)).join(called, ["repo", "key"], "left_anti")
    return lonely.groupBy("repo", "key", "file_path").agg(F.min("symbol_name").alias("symbol"), F.min("line_start").alias("line"), F.min("symbol_type").alias("kind")).drop("key")


def definitions(chunks: DataFrame) -> DataFrame:
    """The earliest definition of each name in each file."""
    w = Window.partitionBy("repo", "file_path", F.lower("symbol_name")).orderBy("line_start", "id")
    return chunks.where("symbol_name is not null").withColumn("n", F.row_number().over(w)).where("n = 1").select("repo", "file_path", "symbol_name", "symbol_type", "line_start")


def lookup(chunks: DataFrame, name: str, case_sensitive: bool = False) -> DataFrame:
    key = F.col("symbol_name") if case_sensitive else F.lower("symbol_name")
    return chunks.where(key == (name if case_sensitive else name.lower())).select("repo", "file_path", "line_start", "symbol_name").orderBy("repo", "file_path", "line_start")


def matches(chunks: DataFrame, pattern: str, groups: int = 1) -> DataFrame:
    """Every match of a pattern, by line, with its groups g1..gn."""
    lines = chunks.where("content is not null").select("repo", "file_path", F.coalesce("line_start", F.lit(1)).alias("first"), F.posexplode(F.split("content", "\n")).alias("at", "text")).where(F.col("text").rlike(pattern))
    cols = [F.regexp_extract("text", pattern, g).alias(f"g{g}") for g in range(1, groups + 1)]
    return lines.select("repo", "file_path", (F.col("first") + F.col("at")).alias("line"), *cols).distinct()


def regex_search(chunks: DataFrame, pattern: str, context: int, case_sensitive: bool = True) -> DataFrame:
    """Matching lines with lines around them, once per file and line."""
    p = pattern if case_sensitive else f"(?i){pattern}"
    rows = chunks.where(F.col("content").rlike(p)).withColumn("lines", F.split("content", "\n")).select("repo", "file_path", F.coalesce("line_start", F.lit(1)).alias("first"), "lines", F.posexplode("lines").alias("at", "text")).where(F.col("text").rlike(p))
    lo = F.greatest(F.col("at") - context, F.lit(0))
    snippet = F.array_join(F.slice("lines", lo + 1, F.col("at") + context - lo + 1), "\n")
    found = rows.select("repo", "file_path", (F.col("first") + F.col("at")).alias("line"), "text", snippet.alias("snippet"))
    return found.groupBy("repo", "file_path", "line").agg(F.min("text").alias("text"), F.max("snippet").alias("snippet"))


def type_relations(chunks: DataFrame) -> DataFrame:
    """owner, target: 'owner extends or implements target', once whatever the case."""
    m = matches(chunks, RELATION, 2)
    w = Window.partitionBy("repo", "file_path", F.lower("g1"), F.lower("g2")).orderBy("line")
    return m.withColumn("n", F.row_number().over(w)).where("n = 1").select("repo", "file_path", "line", F.col("g1").alias("owner"), F.col("g2").alias("target"))


def enclosing(points: DataFrame, chunks: DataFrame) -> DataFrame:
    """The smallest named chunk around each (repo, file_path, line); the join is by file, so it stays local to one."""
    spans = chunks.where("symbol_name is not null or symbol_type is not null").select("repo", "file_path", "line_start", "line_end", "symbol_name")
    inside = points.join(spans, ["repo", "file_path"]).where(F.col("line").between(F.col("line_start"), F.col("line_end")))
    best = F.min(F.struct((F.col("line_end") - F.col("line_start")).alias("span"), "line_start", "line_end", "symbol_name"))
    return inside.groupBy("repo", "file_path", "line").agg(best.alias("b")).select("repo", "file_path", "line", "b.line_start", "b.line_end", "b.symbol_name")

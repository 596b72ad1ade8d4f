"""Statistics over an index: counts, health, overviews, conventions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import text as t


def once(chunks: DataFrame) -> DataFrame:
    """Chunks by id; the index keeps one row per id, whatever was delivered."""
    return chunks.where("id is not null").dropDuplicates(["id"])


def counts(chunks: DataFrame) -> DataFrame:
    """Chunks, files and lines; lines of overlapping chunks count in each."""
    return chunks.agg(
        F.count("*").alias("chunks"), F.countDistinct("repo", "file_path").alias("files"),
        F.coalesce(F.sum(F.col("line_end") - F.col("line_start") + 1), F.lit(0)).alias("lines"),
    )


def language_stats(chunks: DataFrame) -> DataFrame:
    """Per language: chunks, files, and the percentage of all chunks."""
    per = chunks.groupBy("language").agg(F.count("*").alias("chunks"), F.countDistinct("repo", "file_path").alias("files"))
    return per.withColumn("percent", F.col("chunks") * 100.0 / F.sum("chunks").over(Window.partitionBy()))


def index_health(states: DataFrame) -> DataFrame:
    """Per language: files, and how many the indexer could not read well."""
    return states.groupBy("language").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "indexed").alias("indexed"), F.count_if(F.col("status") == "parse_error").alias("parse_error"),
        F.count_if(F.col("tree_has_error")).alias("tree_error"), F.count_if(F.col("tier0_fallback")).alias("fallback"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"),
    )


def health_totals(states: DataFrame) -> DataFrame:
    """The health of all languages together (language null), then of each, the largest first."""
    per = index_health(states)
    total = per.agg(F.lit(None).cast("string").alias("language"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in per.columns if c != "language"])
    return total.unionByName(per).orderBy(F.col("language").isNotNull(), F.desc("total"), "language")


def symbol_types_of(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Kinds of symbols in a set of files (repo, file_path)."""
    return symbol_types(chunks.join(files.select("repo", "file_path").distinct(), ["repo", "file_path"], "left_semi"))


def has_matches(chunks: DataFrame, condition) -> bool:
    """Whether any chunk passes a filter; stops at the first."""
    return bool(chunks.where(condition).limit(1).count())


def match_counts(chunks: DataFrame, conditions: dict) -> DataFrame:
    """name, matches: chunks that pass each of several filters, counted in one scan."""
    one = chunks.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("matches")) for n in conditions])).alias("r")).select("r.*")


def by_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks of given ids."""
    return chunks.join(ids.select("id").distinct(), "id", "left_semi")


def by_file(chunks: DataFrame, repo: str, path: str) -> DataFrame:
    """Chunks of a file in its order."""
    return chunks.where((F.col("repo") == repo) & (F.col("file_path") == path)).orderBy(F.coalesce("line_start", F.lit(0)), "id")


def top_directories(chunks: DataFrame, limit: int) -> DataFrame:
    """First path segments by number of files; files at the root count as '.'."""
    folder = F.when(F.col("file_path").contains("/"), F.substring_index("file_path", "/", 1)).otherwise(".")
    return chunks.groupBy(folder.alias("directory")).agg(F.countDistinct("repo", "file_path").alias("files")).orderBy(F.desc("files"), "directory").limit(limit)


def symbol_types(chunks: DataFrame) -> DataFrame:
    return chunks.where("symbol_type is not null").groupBy("symbol_type").agg(F.count("*").alias("chunks"))


def hotspots(chunks: DataFrame, limit: int) -> DataFrame:
    return chunks.groupBy("repo", "file_path").agg(F.count("*").alias("chunks")).orderBy(F.desc("chunks"), "repo", "file_path").limit(limit)


def entry_points(chunks: DataFrame) -> DataFrame:
    stem = F.lower(F.substring_index(t.file_name(F.col("file_path")), ".", 1))
    return chunks.select("repo", "file_path").where(stem.isin(*t.ENTRY_STEMS)).distinct()


def file_summaries(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("repo", "file_path").agg(F.count("*").alias("chunks"), F.max("line_end").alias("last_line"), F.min("language").alias("language"))


# Files and folders that show a convention, as names of whole path components, chains of them, or suffixes (with a leading dot and no name).
CONVENTIONS = {
    "Rust/Cargo project": ("Cargo.toml",),
    "Node.js/npm project": ("package.json",),
    "Python project": ("pyproject.toml", "setup.py", "setup.cfg"),
    "Go module": ("go.mod",),
    "Java/JVM project": ("pom.xml", "build.gradle", "build.gradle.kts"),
    "Ruby/Bundler project": ("Gemfile",),
    "Docker containerization": ("Dockerfile", "docker-compose.yml", "docker-compose.yaml"),
    "GitHub Actions CI": (".github/workflows",),
    "GitLab CI": (".gitlab-ci.yml",),
    "Make build system": ("Makefile",),
    "TypeScript project": ("tsconfig.json",),
    "ESLint linting": (".eslintrc", ".eslintrc.json", ".eslintrc.js", "eslint.config"),
    "Prettier formatting": (".prettierrc", "prettier.config"),
    "JS test framework": ("jest.config", "vitest.config"),
    "Next.js framework": ("next.config",),
    "Nuxt.js framework": ("nuxt.config",),
    "Vite build tool": ("vite.config",),
    "Webpack bundler": ("webpack.config",),
    "Tailwind CSS": ("tailwind.config",),
    "Environment variable config": (".env", ".env.example"),
    "Terraform infrastructure": ("terraform",),
    "Kubernetes deployment": ("k8s", "kubernetes", "helm"),
    "Protocol Buffers": ("proto", ".proto"),
    "OpenAPI/Swagger spec": ("openapi", "swagger"),
    "Database migrations": ("migrations",),
    "Prisma ORM": ("prisma",),
    "Storybook UI": (".storybook",),
}
# What begins with one of these and an extension follows: configuration in several formats.
OPEN_ENDED = ("eslint.config", "prettier.config", "jest.config", "vitest.config", "next.config", "nuxt.config", "vite.config", "webpack.config", "tailwind.config")


def sign(mark: str):
    """Whether a path shows a sign: as whole components, as a suffix of a name, or with any extension."""
    path = F.concat(F.lit("/"), "file_path", F.lit("/"))
    hit = F.contains(path, F.lit(f"/{mark}/"))
    if mark in OPEN_ENDED:
        hit = hit | F.contains(path, F.lit(f"/{mark}."))
    return hit | F.col("file_path").endswith(mark) if mark == ".proto" else hit


def conventions(chunks: DataFrame) -> DataFrame:
    """Conventions of each repository."""
    wide = chunks.groupBy("repo").agg(*[F.max(reduce(lambda a, b: a | b, map(sign, marks))).alias(n) for n, marks in CONVENTIONS.items()])
    names = F.array(*[F.when(F.col(f"`{n}`"), F.lit(n)) for n in CONVENTIONS])
    return wide.select("repo", F.explode(F.array_compact(names)).alias("convention"))

"""Search filters as Boolean columns, and what they match."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as t


@dataclass(frozen=True)
class SearchFilters:
    """All given conditions must hold; a filter without conditions keeps everything but generated files."""

    language: str | None = None
    globs: tuple[str, ...] = ()
    exact_paths: tuple[str, ...] | None = None
    symbol_type: str | None = None
    scope: str | None = None
    include_generated: bool = False
    extra: tuple[Column, ...] = field(default=())

    def condition(self) -> Column:
        parts: list[Column] = list(self.extra)
        if self.language:
            parts.append(F.lower("language") == self.language.lower())
        if self.globs:
            parts.append(t.glob_matches(F.col("file_path"), list(self.globs)))
        if self.exact_paths is not None:
            parts.append(F.col("file_path").isin(*self.exact_paths) if self.exact_paths else F.lit(False))
        if self.symbol_type:
            parts.append(symbol_type_is(F.col("symbol_type"), self.symbol_type))
        cls = t.content_class(F.col("file_path"), F.col("language"), F.col("content"))
        parts.append(t.in_scope(cls, F.lit(self.scope).cast("string"), F.lit(self.include_generated)))
        return reduce(lambda a, b: a & b, parts)


def symbol_type_is(column: Column, wanted: str) -> Column:
    """Case-insensitive; functions and methods are one kind; a null never matches."""
    kinds = ("function", "method") if wanted.lower() in ("function", "method") else (wanted.lower(),)
    return F.coalesce(F.lower(column).isin(*kinds), F.lit(False))


def apply_filters(ranked: DataFrame, filters: SearchFilters, limit: int, order: str = "rank") -> DataFrame:
    """The first rows of a ranked list that pass, in its order."""
    return ranked.where(filters.condition()).orderBy(order).limit(limit)


def near_misses(paths: DataFrame, patterns: list[str]) -> DataFrame:
    """Per pattern: how many paths match, how many would as a folder at any depth, and a suggestion if none matches."""
    sums = []
    for i, p in enumerate(patterns):
        deep = f"**/{p.strip('/')}/**"
        sums += [F.count_if(t.glob_matches(F.col("file_path"), [p])).alias(f"m{i}"), F.count_if(t.glob_matches(F.col("file_path"), [deep])).alias(f"n{i}")]
    one = paths.agg(*sums)
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"m{i}").alias("matches"), F.col(f"n{i}").alias("near")) for i, p in enumerate(patterns)]))
    out = one.select(rows.alias("r")).select("r.*")
    hint = F.when((F.col("matches") == 0) & (F.col("near") > 0), F.concat(F.lit("**/"), F.col("pattern"), F.lit("/**")))
    return out.withColumn("suggestion", hint)


def relative_pattern(pattern: str, root: str) -> str | None:
    """An absolute pattern below a root as a relative one; the root itself admits everything; None if it lies elsewhere."""
    p, r = pattern.replace("\\", "/"), root.replace("\\", "/").rstrip("/")
    if not p.startswith("/") and not (len(p) > 1 and p[1] == ":"):
        return pattern
    if p.rstrip("/") == r:
        return "**"
    return p[len(r) + 1 :] if p.startswith(r + "/") else None

"""Ranking after fusion: additive prior, coherence of files, diversification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import text as t
from sievework.functions import values as v

COHERENCE, DECAY = 0.4, 0.35
#: Additive penalties by content class: (when the query asks for the class, otherwise).
ROLE = {"test": (0.0, -0.95), "archive": (0.18, -0.85), "runtime": (0.95, -0.72), "docs": (0.0, -0.95), "example": (0.0, -0.55), "benchmark": (0.0, -0.55), "generated": (-0.18, -0.95)}
#: Gain and losses: a requested kind of symbol, a version in path and query, configuration files, names of the query in paths and definitions.
KIND_MATCH, KIND_OTHER = 0.62, -0.55
VERSION_MATCH, VERSION_OTHER, VERSION_UNASKED = 0.55, -0.34, -0.08
CONFIG_ROOT = 0.35
PATH_BOOST, DEFINES_BOOST = 1.0, {"identifier": 3.0, "natural": 1.5}
KIND_WORDS = ("function", "method", "class", "struct", "enum", "trait", "interface", "module")
CONFIG_WORDS = ("config", "configuration", "settings", "toml", "yaml", "json", "ini")
VERSION = r"(?:^|[^a-z0-9])(v[0-9]+)(?:[^a-z0-9]|$)"
DEFINES = r"(?i)\b(?:def|fn|func|function|class|struct|enum|trait|interface|type|mod|const)\s+"
BODY_BIAS = {"class": 0.12, "struct": 0.12, "trait": 0.12, "interface": 0.12, "function": 0.08, "method": 0.08, "enum": 0.06, "block": -0.05}


def base_score(rank: Column, size: Column) -> Column:
    return 1 - (rank - 1) / size


def shared_columns(query: Column) -> dict[str, Column]:
    """What several terms read of a candidate and its query; as columns of a projection of their own they are computed once."""
    return {"_cls": t.content_class(F.col("file_path"), F.col("language"), F.col("content")), "_words": t.analyze(query), "_kind": t.query_kind(query), "_low": F.lower(query), "_content": F.lower(F.coalesce("content", F.lit("")))}


def prior(query: Column, given: dict[str, Column] | None = None) -> Column:
    """Additive score of a candidate from its path, symbol and class; wants columns of a chunk."""
    given = given or shared_columns(query)
    low, words, kind_of, body_low = given["_low"], given["_words"], given["_kind"], given["_content"]
    n = F.size(words)
    name = F.lower(t.file_name(F.col("file_path")))
    stem = F.lower(t.file_stem(F.col("file_path")))
    cls = given["_cls"]
    d = F.least(t.depth(F.col("file_path")), F.lit(5))
    symbol = F.lower("symbol_name")
    by_path = (
        F.when(F.contains(F.lower("file_path"), low) & low.contains("/"), 1.2)
        .when(name == low, F.when(d == 0, 0.9).otherwise(0.6 - 0.06 * d))
        .otherwise(0.0)
    )
    by_symbol = (
        F.when(symbol.isNull(), 0.0)
        .when(F.array_contains(words, symbol) | (symbol == low), F.when(n <= 2, 1.6).otherwise(1.2) + F.when(F.col("symbol_name") == query, 0.28).otherwise(0.0))
        .when(F.contains(symbol, low), F.when(n <= 2, 0.7).otherwise(0.55))
        .otherwise(0.0)
    )
    by_stem = F.when(F.array_contains(words, stem), 0.35).when(F.exists(words, lambda w: (F.length(w) >= 6) & stem.startswith(F.substring(w, 1, 6))), 0.28).otherwise(0.0)
    distinct = F.array_distinct(words)
    hits = F.size(F.filter(distinct, lambda w: (F.length(w) >= 3) & F.contains(body_low, w)))
    cover = hits / F.greatest(F.size(distinct), F.lit(1))
    by_cover = F.when((F.size(distinct) >= 2) & (cover >= 0.5), F.when(kind_of == "natural", 2.4).otherwise(2.0) * cover * cover).otherwise(0.0)
    role: Column = F.lit(0.0)
    for c, (asked, other) in ROLE.items():
        role = F.when(cls == c, F.when(F.array_contains(words, c), asked).otherwise(other)).otherwise(role)
    body: Column = F.lit(0.0)
    for c, w in BODY_BIAS.items():
        body = F.when(F.lower("symbol_type") == c, w).otherwise(body)
    source = F.when(cls.isin("source", "config"), F.when(kind_of == "natural", 0.12 - 0.0 * d).otherwise(0.24) / (1 + d)).otherwise(0.0)
    kind = F.get(F.array_intersect(words, F.array(*[F.lit(k) for k in KIND_WORDS])), F.lit(0))
    same = F.lower("symbol_type") == kind
    callable_ = kind.isin("function", "method") & F.lower("symbol_type").isin("function", "method")
    by_kind = F.when(kind.isNull(), 0.0).when(F.coalesce(same | callable_, F.lit(False)), KIND_MATCH).otherwise(KIND_OTHER)
    asked, found = F.regexp_extract(low, VERSION, 1), F.regexp_extract(F.lower("file_path"), VERSION, 1)
    by_version = F.when(found == "", 0.0).when(asked == "", VERSION_UNASKED).when(asked == found, VERSION_MATCH).otherwise(VERSION_OTHER)
    wants_config = F.arrays_overlap(words, F.array(*[F.lit(w) for w in CONFIG_WORDS]))
    by_config = F.when(wants_config & (cls == "config"), F.when(d == 0, CONFIG_ROOT).otherwise(F.greatest(0.2 - 0.03 * d, F.lit(0.05)))).otherwise(0.0)
    terms = [by_path, by_symbol, by_stem, by_cover, role, body, source, by_kind, by_version, by_config, v.let(meaning(query, kind_of), lambda m: reduce(lambda a, b: a + b, [m[n] for n in TERMS]))]
    return reduce(lambda a, b: a + F.coalesce(b, F.lit(0.0)), terms, F.lit(0.0))


DEFINITION_KINDS = ("function", "method", "class", "struct", "enum", "trait", "interface", "type", "module")
#: Terms of the prior: a symbol that holds a keyword or its stem; definitions asked for, with a name or without; definitions that keywords overlap, with an
#: aligned file stem or without; a keyword defined in the first lines; scopes.
SYMBOL_WORD, SYMBOL_STEM = 0.5, 0.32
ASKED_DEFINITION, ASKED_UNNAMED = 0.34, 0.18
OVERLAP, OVERLAP_ALIGNED, DEFINED_EARLY = 1.0, 1.5, 0.3
IN_SCOPE, OUT_OF_SCOPE = 0.18, -1.1
IMPLEMENTATION, PUBLIC_SYMBOL = 0.18, 0.08
EARLY_DEFINITION = (
    r"(?m)^\s*(?:(?:pub|export(?: default)?|abstract|data)\s+)?(?:class|struct|enum|trait|interface|type|mod|module|def|fn|func|function|fun|object|protocol|record|namespace|package|defmodule)\s+(\w{3,})"
)


TERMS = ("symbol_word", "asked_definition", "overlap", "defined_early", "implementation", "public")


def meaning(query: Column, kind: Column) -> Column:
    """Terms of the prior that compare the words of a question with names, as a struct."""
    natural = kind == "natural"
    content = F.coalesce("content", F.lit(""))
    definition = F.coalesce(F.lower("symbol_type").isin(*DEFINITION_KINDS), F.lit(False))
    head = F.array_join(F.slice(F.split(content, "\n"), 1, 5), "\n")
    words = v.keywords(query)
    known = F.struct(
        words.alias("words"), F.filter(words, lambda w: F.length(w) >= 5).alias("long"), v.identifier_stems(F.coalesce("symbol_name", F.lit(""))).alias("stems"), t.normalize_token(t.file_stem(F.col("file_path"))).alias("file"),
        F.flatten(F.transform(F.regexp_extract_all(head, F.lit(EARLY_DEFINITION), F.lit(1)), v.identifier_stems)).alias("early"),
    )
    same = lambda a, b: (a == b) | v.shares_stem(a, b)

    def terms(k: Column) -> Column:
        covered = F.size(F.filter(k["long"], lambda w: F.exists(k["stems"], lambda s: same(s, w))))
        aligned = (F.lower(t.file_stem(F.col("file_path"))) == F.lower("symbol_name")) | F.exists(k["stems"], lambda s: same(s, k["file"]))
        return F.struct(
            F.when(F.arrays_overlap(k["stems"], k["words"]), SYMBOL_WORD).when(F.exists(k["stems"], lambda s: F.exists(k["words"], lambda w: v.shares_stem(s, w))), SYMBOL_STEM).otherwise(0.0).alias("symbol_word"),
            F.when(definition & (covered > 0), F.when(aligned, OVERLAP_ALIGNED).otherwise(OVERLAP) * F.least(covered / F.greatest(F.size(k["long"]), F.lit(1)), F.lit(1.0))).otherwise(0.0).alias("overlap"),
            F.when(F.exists(k["early"], lambda s: F.exists(k["long"], lambda w: same(s, w))), DEFINED_EARLY).otherwise(0.0).alias("defined_early"),
        )

    compared = F.when(natural, v.let(known, terms))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return F.struct(
        zero(compared["symbol_word"]).alias("symbol_word"),
        F.when(query.rlike(r"(?i)\b(?:defin\w+|declar\w+)\b") & definition, F.when(F.col("symbol_name").isNotNull(), ASKED_DEFINITION).otherwise(ASKED_UNNAMED)).otherwise(0.0).alias("asked_definition"),
        zero(compared["overlap"]).alias("overlap"), zero(compared["defined_early"]).alias("defined_early"),
        F.when(query.rlike(r"(?i)\bimpl(?:ement\w*)?\b") & content.rlike(r"\A\s*impl\b"), IMPLEMENTATION).otherwise(0.0).alias("implementation"),
        F.when(natural & content.rlike(r"\A\s*(?:pub|export|public)\b") & F.col("symbol_name").isNotNull(), PUBLIC_SYMBOL).otherwise(0.0).alias("public"),
    )


def scope_term(scope: Column, include_generated: Column) -> Column:
    """Gain inside a requested scope, loss outside; nothing where none is requested."""
    cls = t.content_class(F.col("file_path"), F.col("language"), F.col("content"))
    return F.when(scope.isNull(), 0.0).when(t.in_scope(cls, scope, include_generated), IN_SCOPE).otherwise(OUT_OF_SCOPE)


def boosts(query: Column, given: dict[str, Column] | None = None) -> Column:
    """Multiples of the pool's best score: query words in the path (natural language only), and definitions of names of the query."""
    given = given or shared_columns(query)
    words = F.filter(F.array_distinct(given["_words"]), lambda w: F.length(w) >= 4)
    tokens = F.transform(t.analyze(t.path_tokens(F.col("file_path"))), t.normalize_token)
    ratio = F.size(F.array_intersect(F.transform(words, t.normalize_token), tokens)) / F.greatest(F.size(words), F.lit(1))
    kind = given["_kind"]
    by_path = F.when((kind == "natural") & (ratio >= 0.05), PATH_BOOST * ratio).otherwise(0.0)
    names = F.filter(F.array_distinct(F.regexp_extract_all(query, F.lit(r"[A-Za-z_]\w*"), F.lit(0))), lambda w: F.length(w) >= 4)
    defines = F.exists(names, lambda w: F.contains(given["_content"], F.lower(w)) & F.regexp_like(F.coalesce("content", F.lit("")), F.concat(F.lit(DEFINES), w, F.lit(r"\b"))))
    single = F.size(names) <= 2
    by_definition = F.when(defines & single, DEFINES_BOOST["identifier"]).when(defines & F.get(names, F.lit(0)).rlike(r"_|\p{Ll}\p{Lu}"), DEFINES_BOOST["natural"]).otherwise(0.0)
    return by_path + by_definition


def coherence(pool: DataFrame) -> DataFrame:
    """The best chunk of each file gains by the file's share of the largest sum of scores (query_id, file, score, rank)."""
    file = Window.partitionBy("query_id", "file")
    sums = pool.withColumn("file_sum", F.sum(F.greatest("score", F.lit(0.0))).over(file))
    q = Window.partitionBy("query_id")
    sums = sums.withColumn("top_sum", F.max("file_sum").over(q)).withColumn("pool_max", F.greatest(F.max(F.greatest("score", F.lit(0.0))).over(q), F.lit(1e-6)))
    best = F.row_number().over(file.orderBy(F.desc("score"), "rank")) == 1
    gain = COHERENCE * F.col("pool_max") * F.col("file_sum") / F.col("top_sum")
    return sums.withColumn("score", F.when(best & (F.col("top_sum") > 0), F.col("score") + gain).otherwise(F.col("score"))).drop("file_sum", "top_sum", "pool_max")


def diversify(pool: DataFrame) -> DataFrame:
    """The n-th chunk of a file keeps DECAY ** (n - 1) of its score; ranks are given anew."""
    nth = F.row_number().over(Window.partitionBy("query_id", "file").orderBy(F.desc("score"), "id"))
    scored = pool.withColumn("score", F.col("score") * F.pow(F.lit(DECAY), nth - 1))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))


def rank(candidates: DataFrame, query: str = "query") -> DataFrame:
    """Ranks the fused candidates (query_id, id, rank, the query and the chunk's columns) anew; a pool of one row stays as it is."""
    q = Window.partitionBy("query_id")
    once = shared_columns(F.col(query))
    given = {n: F.col(n) for n in once}
    # what reads texts comes before the first window, so that those who want no text shuffle none
    read = candidates.withColumns(once).withColumns({"_prior": prior(F.col(query), given), "_boost": boosts(F.col(query), given), "file": F.concat_ws(":", "repo", "file_path")}).drop(*once)
    sized = read.withColumn("pool", F.count("*").over(q))
    scored = sized.withColumn("score", F.when(F.col("pool") > 1, base_score(F.col("rank"), F.col("pool")) + F.col("_prior")).otherwise(F.lit(1.0)))
    best = F.greatest(F.max("score").over(q), F.lit(1e-6))
    gained = coherence(scored.withColumn("best", best)).withColumn("score", F.when(F.col("pool") > 1, F.col("score") + F.col("best") * F.col("_boost")).otherwise(F.col("score")))
    return diversify(gained).drop("pool", "file", "best", "_prior", "_boost")


def score_ceiling(ranked: DataFrame) -> DataFrame:
    """Unscored results take the lowest score in front of them, so scores never rise."""
    up = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("score", F.min("score").over(up))

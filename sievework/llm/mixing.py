"""Mixing sources to target weights.

Each distinct text belongs to one source: that of its lowest id among the sources that have a
target, so that no text is used more often than its cap, in whatever sources copies of it lie.
Sizes are tokens of a public tokenizer, counted over whole texts.

``water_fill`` computes the tokens that each source gives to a mixture of a requested size:
sources that would need more than ``max_repeats`` passes are clamped there and the excess is
redistributed over the others in proportion to their weights, until all fit. Without a requested
size the mixture is the largest in which every source reaches its weight unclamped. The table of
sources is configuration (one row per source); it alone is brought to the driver.

Whole passes use every text of a source; the rest of a pass is a seeded choice: texts in the order
of a seeded hash until the tokens are reached. The order is cut in ``BINS`` hash bins first, so
only the one bin per source in which the rest ends is sorted; a source that holds a third of all
rows is never ordered as a whole.

Edge cases: texts that are null or blank have no tokens and are never chosen; a null or unknown
source takes no part; a weight that is null or not positive counts as 0; ties of the hash are
settled by the text's own id; an empty table, or a source without any text, gets 0 tokens and the
others share its weight; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.session import cut

BINS = 4096
#: Session setting that names the vocabulary file, the same on every machine, and the file where it is unset.
TOKENIZER_CONF, TOKENIZER = "sievework.tokenizer", "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Split pattern that belongs to the vocabulary (fixed value, published with it).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def source_name(source: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(source), r"[\s-]+", "_"))


_CODECS: dict[str, object] = {}


def codec(path: str):
    """The tokenizer of a vocabulary file, loaded once per Python worker."""
    if path not in _CODECS:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _CODECS[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _CODECS[path]


def token_counter(path: str | None = None):
    """A pandas UDF that counts tokens."""
    spark = SparkSession.active()
    path = path or spark.conf.get(TOKENIZER_CONF, TOKENIZER)

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: 0 if t is None else len(codec(path).encode_ordinary(t)))

    return count


def water_fill(tokens: Mapping[str, int], weights: Mapping[str, float], caps: Mapping[str, int], total: float | None = None) -> dict[str, float]:
    """Tokens that each source gives; sources with tokens only."""
    live = {s: float(w) for s, w in weights.items() if w and w > 0 and tokens.get(s, 0) > 0 and caps.get(s, 0) > 0}
    if not live:
        return {}
    room = {s: float(tokens[s]) * caps[s] for s in live}
    if total is None:
        norm = sum(live.values())
        total = min(room[s] * norm / w for s, w in live.items())
    given: dict[str, float] = {}
    rest = min(float(total), sum(room.values()))
    while live:
        norm = sum(live.values())
        over = [s for s, w in live.items() if rest * w / norm > room[s] * (1 + 1e-12)]
        if not over:
            return given | {s: rest * w / norm for s, w in live.items()}
        for s in over:
            given[s] = room[s]
            live.pop(s)
        rest = max(0.0, min(float(total), sum(room.values())) - sum(given.values()))
    return given


def sized_texts(documents: DataFrame, targets: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Distinct texts of known sources: source, text_id, doc_id (the lowest), tokens.

    Tokens are counted where texts are read; what is shuffled per row is a hash and three numbers, never a text.
    """
    known = F.broadcast(targets.select(source_name(F.col("source")).alias("source")).where("source is not null").distinct())  # configuration
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_name(F.col("source")).alias("source"), F.col("text").alias("body"))
    texts = texts.where("trim(body) != ''").join(known, "source", "left_semi")
    sized = texts.select("source", F.sha2("body", 256).alias("text_id"), "doc_id", token_counter(tokenizer)("body").alias("tokens")).where("tokens > 0")
    owner = F.min(F.struct("doc_id", "source", "tokens")).alias("owner")
    return sized.groupBy("text_id").agg(owner).select("owner.source", "text_id", "owner.doc_id", "owner.tokens")


def plan(sizes: DataFrame, targets: DataFrame, total: float | None = None, share: float | None = None) -> DataFrame:
    """For ``total`` tokens, or ``share`` times all tokens, or as many as all weights can be met with; per source: target_weight, max_repeats, tokens, give (tokens to use), passes, rest (tokens of the last pass)."""
    spark = sizes.sparkSession
    t = targets.select(source_name(F.col("source")).alias("source"), "target_weight", "max_repeats").groupBy("source").agg(F.sum("target_weight").alias("w"), F.max("max_repeats").alias("m"))
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    conf = t.where("source is not null").join(have, "source", "left").collect()  # one row per source of the configuration
    tokens = {r.source: int(r.tokens or 0) for r in conf}
    weights = {r.source: float(r.w or 0) for r in conf}
    caps = {r.source: int(r.m or 0) for r in conf}
    give = water_fill(tokens, weights, caps, share * sum(tokens.values()) if total is None and share is not None else total)
    rows = []
    for s in sorted(tokens):
        g = give.get(s, 0.0)
        passes = min(int(g // tokens[s]), caps[s]) if tokens[s] else 0
        rows.append((s, weights[s], caps[s], tokens[s], g, passes, g - passes * tokens[s] if passes < caps[s] else 0.0))
    return spark.createDataFrame(rows, "source string, target_weight double, max_repeats int, tokens long, give double, passes int, rest double")


def select(sizes: DataFrame, plan_df: DataFrame, seed: int = 1) -> DataFrame:
    """source, doc_id, text_id, tokens, copies: how often each text is used."""
    p = F.broadcast(plan_df.select("source", "passes", "rest"))  # one row per source
    h = sizes.withColumn("h", F.xxhash64(F.lit(seed), "text_id")).withColumn("bin", F.pmod("h", F.lit(BINS)).cast("int"))
    bins = h.groupBy("source", "bin").agg(F.sum("tokens").alias("t"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("t").over(upto), F.lit(0))).join(p, "source")
    bins = F.broadcast(bins.where("before < rest").select("source", "bin", "before", "t", "rest", "passes"))  # at most BINS rows per source
    inside = h.join(bins, ["source", "bin"])
    whole = inside.where("before + t <= rest").withColumn("extra", F.lit(1))
    edge = inside.where("before + t > rest")
    seen = Window.partitionBy("source").orderBy("h", "text_id").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("used", F.col("before") + F.coalesce(F.sum("tokens").over(seen), F.lit(0)))
    # the text across which the rest ends is used if more than half of it fits
    edge = edge.where("used + tokens / 2.0 <= rest").drop("used").withColumn("extra", F.lit(1))
    extra = whole.unionByName(edge).select("text_id", "extra")
    picked = h.join(p, "source").join(extra, "text_id", "left").withColumn("copies", F.col("passes") + F.coalesce("extra", F.lit(0)))
    return picked.where("copies > 0").select("source", "doc_id", "text_id", "tokens", "copies")


def report(selection: DataFrame, plan_df: DataFrame) -> DataFrame:
    """Per source the share reached beside the target."""
    used = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"), F.count("*").alias("texts"), F.max("copies").alias("most_copies"))
    used = plan_df.join(used, "source", "left").fillna(0, ["used", "texts", "most_copies"])
    return used.withColumn("share", F.try_divide("used", F.sum("used").over(Window.partitionBy()))).select(
        "source", "target_weight", "share", "tokens", "used", "texts", "max_repeats", "most_copies", F.try_divide("used", "tokens").alias("epochs")
    )


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 1, tokenizer: str | None = None, share: float | None = None):
    """(plan, selection) of a mixture."""
    sizes = cut(sized_texts(documents, targets, tokenizer))
    p = plan(sizes, targets, total, share)
    return p, select(sizes, p, seed)

"""Ranked retrieval for batches of queries: lexical, by vectors, fused."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sievework.functions import text as t
from sievework.session import cut, small

K1, B = 1.2, 0.75
#: Boosts of the fields; queries for paths weigh names of files more.
FIELDS = {"filename": 2.0, "path_tokens": 1.5, "symbol_name": 3.0, "content": 1.0}
PATH_FIELDS = {"filename": 8.0, "path_tokens": 5.0, "symbol_name": 2.0, "content": 1.0}
RRF_K = 60.0
#: Weights of (lexical, vector) lists by kind of query.
FUSION = {"identifier": (2.5, 1.0), "natural": (1.0, 1.0)}


def fields_of(chunks: DataFrame) -> DataFrame:
    """repo, id, field, terms: the analysed fields of each chunk."""
    f = {
        "filename": t.file_name(F.col("file_path")),
        "path_tokens": t.path_tokens(F.col("file_path")),
        "symbol_name": F.coalesce("symbol_name", F.lit("")),
        "content": F.coalesce("content", F.lit("")),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), t.analyze(v).alias("terms")) for k, v in f.items()]))
    return chunks.select("repo", "id", rows.alias("r")).select("repo", "id", "r.*")


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, repo, term: once each."""
    return queries.select("query_id", "repo", F.explode(F.array_distinct(t.analyze(F.col("query")))).alias("term"))


def postings(chunks: DataFrame) -> DataFrame:
    """repo, id, field, term, tf, size: what an index keeps for lexical search."""
    found = fields_of(chunks).select("repo", "id", "field", F.size("terms").alias("size"), F.explode("terms").alias("term"))
    return found.groupBy("repo", "id", "field", "term").agg(F.count("*").alias("tf"), F.max("size").alias("size"))


def field_lengths(chunks: DataFrame) -> DataFrame:
    """repo, field, docs, mean: one row per repository and field."""
    return fields_of(chunks).groupBy("repo", "field").agg(F.count("*").alias("docs"), F.avg(F.size("terms")).alias("mean"))


def embedded(chunks: DataFrame, embed=None) -> DataFrame:
    """repo, id, vector of chunks; ``embed`` is a pandas UDF from text to vector."""
    return chunks.select("repo", "id", (embed or hash_embedding())(F.coalesce("content", F.lit(""))).alias("vector"))


def search_tables(chunks: DataFrame, embed=None) -> dict[str, DataFrame]:
    """Postings, lengths and vectors of an index; searches read these and no content."""
    return {"postings": postings(chunks), "lengths": field_lengths(chunks), "vectors": embedded(chunks, embed)}


def write_search_tables(chunks: DataFrame, root: str, embed=None) -> None:
    """The search tables below a folder, postings by repository and term."""
    found = search_tables(chunks, embed)
    # terms are counted where a chunk's row lies: its content is shuffled once, none of its terms before they are counted
    postings(chunks.repartition("repo", "id")).repartition("repo", "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{root}/postings")
    found["lengths"].coalesce(1).write.mode("overwrite").parquet(f"{root}/lengths")
    found["vectors"].write.mode("overwrite").parquet(f"{root}/vectors")


def read_search_tables(spark, root: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{root}/{n}") for n in ("postings", "lengths", "vectors")}


def updated_search_tables(old: dict[str, DataFrame], touched: DataFrame, old_chunks: DataFrame, fresh: DataFrame, embed=None) -> dict[str, DataFrame]:
    """The tables after an update: chunks of touched files lose their rows, fresh chunks get theirs; nothing else is analysed or embedded again."""
    lost = old_chunks.join(touched.select("repo", "file_path").distinct(), ["repo", "file_path"], "left_semi")
    gone = lost.select("repo", "id").distinct()
    # sums of lengths change by what came and went
    sums = lambda df, sign: df.select("repo", "field", (sign * F.col("docs")).alias("docs"), (sign * F.col("docs") * F.col("mean")).alias("total"))
    total = sums(old["lengths"], 1).unionByName(sums(field_lengths(fresh), 1)).unionByName(sums(field_lengths(lost), -1)).groupBy("repo", "field").agg(F.sum("docs").alias("docs"), F.sum("total").alias("total"))
    return {
        "postings": old["postings"].join(gone, ["repo", "id"], "left_anti").unionByName(postings(fresh)),
        "lengths": total.where("docs > 0").select("repo", "field", "docs", (F.col("total") / F.col("docs")).alias("mean")),
        "vectors": old["vectors"].join(gone, ["repo", "id"], "left_anti").unionByName(embedded(fresh, embed)),
    }


def bm25(chunks: DataFrame, queries: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """query_id, id, score, rank: the k best chunks of each query within its repository, from the chunks themselves."""
    return score_postings(postings(chunks), field_lengths(chunks), queries, k, digits)


def _weights() -> tuple[Column, Column]:
    """Weight of a posting with its df, docs and mean, for queries at large and for those with a separator."""
    boost = lambda b: F.create_map(*[F.lit(x) for kv in b.items() for x in kv])[F.col("field")]
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    return boost(FIELDS) * idf * norm, boost(PATH_FIELDS) * idf * norm


def score_postings(posts: DataFrame, lengths: DataFrame, queries: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """query_id, id, score, rank from stored postings.

    Statistics (documents, lengths, document frequencies) are those of the repository. Only terms that some query asks
    for are read on; scores are summed by (query, chunk) with a map-side combine. Queries with a separator weigh names of
    files more. Scores may be rounded before they are ranked, so that equal ones tie.
    """
    terms = query_terms(queries).join(queries.select("query_id", F.col("query").rlike(r"[/\\\\]").alias("for_paths")), "query_id")
    wanted = terms.select("repo", "term").distinct()
    found = posts.join(wanted, ["repo", "term"], "left_semi")
    df = found.groupBy("repo", "field", "term").agg(F.count("*").alias("df"))
    w, w_paths = _weights()
    weighted = found.join(df, ["repo", "field", "term"]).join(lengths, ["repo", "field"]).select("repo", "id", "term", w.alias("w"), w_paths.alias("w_paths"))
    per_term = weighted.groupBy("repo", "id", "term").agg(F.sum("w").alias("w"), F.sum("w_paths").alias("w_paths"))
    score = F.sum(F.when(F.col("for_paths"), F.col("w_paths")).otherwise(F.col("w")))
    scored = terms.join(per_term, ["repo", "term"]).groupBy("query_id", "id").agg((score if digits is None else F.round(score, digits)).alias("score"))
    return top(scored, ["query_id"], k)


def top(scored: DataFrame, groups: Sequence[str], k: int, score: str = "score", tie: str = "id") -> DataFrame:
    """The k best of each group with their rank; a rank limit stops each task's sort early."""
    w = Window.partitionBy(*groups).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hash_embedding(dim: int = 64):
    """A deterministic stand-in for a model: signed feature hashing of terms, unit length. Any pandas UDF from text to vector takes its place."""

    @F.pandas_udf("array<float>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import re
        import zlib

        known: dict[str, tuple[int, float]] = {}
        for s in texts:
            out = []
            for x in s:
                v = np.zeros(dim, np.float32)
                for w in re.findall(r"[^\W_]+", (x or "").lower()):
                    at = known.get(w)
                    if at is None:
                        h = zlib.crc32(w.encode())
                        at = known[w] = (h % dim, 1.0 if h >> 16 & 1 else -1.0)
                    v[at[0]] += at[1]
                n = float(np.sqrt((v**2).sum()))
                out.append((v / n if n > 1e-6 else v).tolist())
            yield pd.Series(out)

    return embed


QUERY_BLOCK = 8_192


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, groups: Sequence[str] = ("repo",)) -> DataFrame:
    """query_id, id, score, rank: exact nearest neighbours within a group; score is 1 / (1 + distance), ties go to the lower id.

    Filters belong in front of this call: they are applied before the ranking, so they never starve k.
    Queries are taken in blocks of at most QUERY_BLOCK, each sent to the workers once; every task
    multiplies its vectors with the queries of their group and keeps k rows per query, so no pair
    of rows is ever materialised and a group of any size stays spread over its partitions.
    """
    known = [F.col(g).isNotNull() for g in groups]
    inside = lambda df: reduce(lambda x, y: x & y, known, F.col("vector").isNotNull())
    base = vectors.where(inside(vectors)).select(F.xxhash64(*groups).alias("g"), "id", "vector")
    asked = cut(queries.where(inside(queries)).select("query_id", F.xxhash64(*groups).alias("g"), "vector"))
    kinds = f"query_id {dict(queries.dtypes)['query_id']}, id {dict(vectors.dtypes)['id']}, score double"
    parts = max(1, -(-asked.count() // QUERY_BLOCK))
    found = None
    for b in range(parts):
        block: dict[tuple[int, int], tuple[list, list]] = {}
        for r in asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == b).toLocalIterator():
            at = block.setdefault((r.g, len(r.vector)), ([], []))
            at[0].append(r.query_id)
            at[1].append(r.vector)
        sent = vectors.sparkSession.sparkContext.broadcast({key: (ids, np.array(x, np.float64)) for key, (ids, x) in block.items()})
        part = base.mapInArrow(_scanner(sent, k, to_arrow_type(queries.schema["query_id"].dataType)), kinds)
        found = part if found is None else found.unionByName(part)
    return top(found, ["query_id"], k)


def nearest_of(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distances, ids) of the k rows of x nearest to each query, by (distance, id); inf where there are fewer.

    Products say which rows can be among them; those, ties included, are compared exactly.
    """
    d, i = np.full((len(q), k), np.inf), np.empty((len(q), k), ids.dtype)
    norms = (x**2).sum(1)
    for s in range(0, len(q), 512):
        part = q[s : s + 512]
        near = norms - 2 * part @ x.T
        bar = np.partition(near, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
        qi, xi = np.nonzero(near <= bar[:, None] + 1e-9 * (1 + np.abs(bar[:, None])))
        exact = np.concatenate([np.sqrt(((x[xi[a : a + 100_000]] - part[qi[a : a + 100_000]]) ** 2).sum(1)) for a in range(0, len(qi), 100_000)]).round(12)
        order = np.lexsort((ids[xi], exact, qi))
        qi, xi, exact = qi[order], xi[order], exact[order]
        place = np.arange(len(qi)) - np.searchsorted(qi, qi)
        kept = place < k
        d[s + qi[kept], place[kept]], i[s + qi[kept], place[kept]] = exact[kept], ids[xi[kept]]
    return d, i


def _scanner(sent, k: int, query_type: pa.DataType):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        kind = None
        for batch in batches:
            column, ids, g = batch.column("vector"), batch.column("id"), batch.column("g").to_numpy()
            kind = ids.type
            names = np.array(ids.to_pylist())
            sizes = np.diff(column.offsets.to_numpy())
            for group, dim in {(int(a), int(n)) for a, n in zip(g, sizes, strict=True)} & set(sent.value):
                rows = np.flatnonzero((g == group) & (sizes == dim))
                x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
                d, i = nearest_of(sent.value[group, dim][1], x, names[rows], k)
                if (group, dim) in best:
                    d, i = np.concatenate([best[group, dim][0], d], 1), np.concatenate([best[group, dim][1], i], 1)
                    order = np.lexsort((i, d), axis=1)[:, :k]
                    d, i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
                best[group, dim] = d, i
        for key, (d, i) in best.items():
            kept = np.isfinite(d)
            owner = np.repeat(np.arange(len(d)), kept.sum(1))
            queries = sent.value[key][0]
            yield pa.RecordBatch.from_arrays([pa.array([queries[o] for o in owner], query_type), pa.array(i[kept].tolist(), kind), pa.array(1 / (1 + d[kept]))], names=["query_id", "id", "score"])

    return scan


def fuse(lists: DataFrame, k: int, rrf_k: float = RRF_K, tie: str = "id", digits: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists in one table (query_id, id, rank, weight)."""
    rrf_k = rrf_k if np.isfinite(rrf_k) and rrf_k > 0 else RRF_K
    score = F.sum(F.col("weight") / (F.lit(rrf_k) + F.col("rank")))
    fused = lists.groupBy("query_id", "id").agg((score if digits is None else F.round(score, digits)).alias("score"))
    return top(fused, ["query_id"], k, tie=tie)


def with_intent(query, intent):
    """What a model reads of a query whose intent is stated; lexical search reads the query alone."""
    return F.when(F.trim(F.coalesce(intent, F.lit(""))) == "", query).otherwise(F.concat(F.lit("intent: "), F.trim(intent), F.lit(" | "), query))


def hybrid(chunks: DataFrame, queries: DataFrame, k: int, embed=None, stored: dict[str, DataFrame] | None = None, width: Column | None = None) -> DataFrame:
    """Lexical and vector lists of each query, weighted by its kind and fused, as query_id, id, score, rank.

    ``stored`` are the search tables of an index; without them the chunks are analysed and embedded here. ``embed`` is a
    pandas UDF from text to vector, the one that made the stored vectors. How many candidates a list gives follows from the
    query's kind and k; a query without any in one list has those of the other. ``width``, over the queries' columns, is how
    many fused rows of a query are wanted, at most k. Where ids are numbers, lists are made and fused in the workers.
    """
    from sievework.operators.candidates import lexical_pool, pool_size

    embed = embed or hash_embedding()
    kind = t.query_kind(F.col("query"))
    asked_text = with_intent(F.col("query"), F.col("intent")) if "intent" in queries.columns else F.col("query")
    pools = [
        F.when(kind == "natural", FUSION["natural"][0]).otherwise(FUSION["identifier"][0]).alias("lexical"), F.lit(1.0).alias("semantic"),
        lexical_pool(F.col("query"), k).alias("words_pool"), pool_size(kind, k).alias("vector_pool"), F.least(F.lit(k), F.lit(k) if width is None else width).alias("width"),
    ]
    by = stored or search_tables(chunks, embed)
    if dict(by["vectors"].dtypes)["id"] in ("int", "bigint"):
        return fused_in_blocks(by, queries.select("query_id", "repo", "query", embed(asked_text).alias("vector"), *pools), k)
    plan = queries.select("query_id", *pools)
    most_words, most_vectors = max(5 * k, 100, k + 40), max(5 * k, 50)
    words = score_postings(by["postings"], by["lengths"], queries, most_words).join(plan, "query_id").where("rank <= words_pool").select("query_id", "id", "rank", F.col("lexical").alias("weight"))
    asked = queries.select("query_id", "repo", embed(asked_text).alias("vector"))
    near = vector_search(by["vectors"], asked, most_vectors).join(plan, "query_id").where("rank <= vector_pool").select("query_id", "id", "rank", F.col("semantic").alias("weight"))
    fused = fuse(words.unionByName(near), k)
    return fused if width is None else fused.join(plan.select("query_id", "width"), "query_id").where("rank <= width").drop("width")


#: Queries of a repository that one task answers in one pass over its chunks.
FUSED_BLOCK = 512


def fused_in_blocks(by: dict[str, DataFrame], queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank: fused lists of queries (with vector, pools, weights and width) over search tables whose ids are numbers.

    Each block of a repository's queries meets the repository's vectors and the postings of its own terms as one sorted
    stream. A task keeps the best rows of its queries as numbers, whatever the size of the repository, and fuses them at
    its end, so that neither list is ever shuffled.
    """
    known = queries.where("repo is not null")
    parts = known.groupBy("repo").agg(F.ceil(F.count("*") / FUSED_BLOCK).alias("parts"))
    block = F.xxhash64("repo", F.pmod(F.xxhash64("query_id"), F.col("parts")))
    terms = F.coalesce(F.array_distinct(t.analyze(F.col("query"))), F.array().cast("array<string>"))
    asked = cut(known.join(parts, "repo").withColumn("g", block).withColumn("terms", terms).withColumn("for_paths", F.coalesce(F.col("query").rlike(r"[/\\\\]"), F.lit(False))).drop("parts", "query"))
    # what is known of the wanted terms is small where the postings are not; sent to them, only postings that are asked for are shuffled
    wanted = small(cut(asked.select("repo", "g", F.explode("terms").alias("term")).groupBy("repo", "term").agg(F.collect_set("g").alias("gs"))))
    df = by["postings"].join(wanted.select("repo", "term"), ["repo", "term"], "left_semi").groupBy("repo", "field", "term").agg(F.count("*").alias("df"))
    terms = small(cut(df.join(wanted, ["repo", "term"])))
    w, w_paths = _weights()
    found = by["postings"].join(terms, ["repo", "field", "term"]).join(by["lengths"], ["repo", "field"])
    posts = found.select(F.explode("gs").alias("g"), "id", F.xxhash64("term").alias("t"), "field", w.cast("double").alias("w"), w_paths.cast("double").alias("w_paths"))
    chunks = by["vectors"].where("vector is not null").join(small(asked.select("repo", "g").distinct()), "repo").select("g", "id", "vector")
    sizes = F.array(*[F.col(c).cast("int") for c in ("words_pool", "vector_pool", "width", "for_paths")])
    heads = asked.select(
        "g", F.lit(0).alias("kind"), "query_id", "vector", F.col("lexical").alias("w"), F.col("semantic").alias("w_paths"), sizes.alias("sizes"), F.transform("terms", lambda w: F.xxhash64(w)).alias("terms"),
    )
    rows = heads.unionByName(chunks.withColumn("kind", F.lit(1)), True).unionByName(posts.withColumn("kind", F.lit(2)), True)
    # empty lists where a row has none: Spark's Arrow writer goes through all null lists of a batch again with every row
    lists = [F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in (("vector", dict(queries.dtypes)["vector"]), ("sizes", "array<int>"), ("terms", "array<bigint>"))]
    rows = rows.select("g", "kind", F.col("id").cast("long"), "t", "field", "w", "w_paths", "query_id", *lists).repartition("g").sortWithinPartitions("g", "kind", "id", "t", "field")
    types = dict(queries.dtypes)["query_id"], dict(by["vectors"].dtypes)["id"]
    return rows.mapInArrow(_blocks, f"query_id {types[0]}, id bigint, score double, rank int").withColumn("id", F.col("id").cast(types[1]))


class _Best:
    """The rows with the lowest keys of each query, as many as it wants; ties go to the lower id."""

    def __init__(self, most: np.ndarray):
        self.most, self.bar, self.rows, self.new = most, np.full(len(most), np.inf), [], 0

    def add(self, q: np.ndarray, key: np.ndarray, ids: np.ndarray) -> None:
        self.rows.append((q.astype(np.int32), key, ids))
        self.new += len(q)
        if self.new > 250_000:
            self.ranked()

    def ranked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, place from 0) of the kept rows; what is worse than the last of a full list is kept out from now on."""
        if not self.rows:
            return np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        q, key, ids = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        order = np.lexsort((ids, key, q))
        q, key, ids = q[order], key[order], ids[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < self.most[q]
        q, key, ids, place = q[kept], key[kept], ids[kept], place[kept]
        full = place == self.most[q] - 1
        self.bar[q[full]] = key[full]
        self.rows, self.new = [(q, key, ids)], 0
        return q, ids, place


class _Block:
    """Queries of one repository while its chunks and postings pass by."""

    CHUNKS, POSTINGS, COLUMNS = 8_192, 100_000, 1_024

    def __init__(self):
        self.heads, self.held, self.kept = [], [], 0

    def open(self) -> None:
        head = pa.Table.from_batches(self.heads).combine_chunks()
        column = lambda n: head.column(n).combine_chunks()
        sizes = column("sizes").flatten().to_numpy().reshape(-1, 4)
        self.ids = column("query_id")
        self.weights, self.width, self.for_paths = (column("w").to_numpy(), column("w_paths").to_numpy()), sizes[:, 2], sizes[:, 3] > 0
        self.words, self.near = _Best(sizes[:, 0]), _Best(sizes[:, 1])
        vectors = column("vector").to_pylist()
        dims = np.array([len(v) for v in vectors])
        self.vectors = {int(n): (at, np.array([vectors[i] for i in at], np.float64)) for n in set(dims.tolist()) - {0} for at in [np.flatnonzero(dims == n)]}
        terms = [sorted(x) for x in column("terms").to_pylist()]
        self.terms = np.array(sorted({x for ts in terms for x in ts}), np.int64)
        # a query's terms as rows of the weights; behind the last term lies a row of zeros
        self.asked = np.full((len(terms), max(1, max(map(len, terms)))), len(self.terms))
        for i, ts in enumerate(terms):
            self.asked[i, : len(ts)] = np.searchsorted(self.terms, np.array(ts, np.int64))
        self.heads = None

    def take(self, kind: int, rows: pa.RecordBatch) -> None:
        if kind == 0:
            self.heads.append(rows)
            return
        if self.heads:
            self.open()
        if self.held and self.held[0][0] != kind:
            self.flush()
        columns = ["id", "vector"] if kind == 1 else ["id", "t", "w", "w_paths"]
        self.held.append((kind, rows.select(columns)))
        self.kept += len(rows)
        if self.kept >= (self.CHUNKS if kind == 1 else self.POSTINGS):
            self.flush(last=False)

    def flush(self, last: bool = True) -> None:
        """What is held is scored; of postings, those of the last chunk wait for its others."""
        if not self.held:
            return
        kind = self.held[0][0]
        rows = pa.Table.from_batches([r for _, r in self.held]).combine_chunks()
        self.held, self.kept = [], 0
        if kind == 1:
            self.score_vectors(rows)
            return
        ids = rows.column("id").to_numpy()
        end = len(ids) if last else int(np.searchsorted(ids, ids[-1]))
        if end < len(ids):
            self.held = [(kind, r) for r in rows.slice(end).to_batches()]
            self.kept = len(ids) - end
        if end:
            self.score_postings(ids[:end], *[rows.column(c).to_numpy()[:end] for c in ("t", "w", "w_paths")])

    def score_vectors(self, rows: pa.Table) -> None:
        names, column = rows.column("id").to_numpy(), rows.column("vector").combine_chunks()
        sizes = pc.list_value_length(column).to_numpy()
        best = self.near
        for dim, (which, q) in self.vectors.items():
            at = np.flatnonzero(sizes == dim)
            if not len(at):
                continue
            x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
            norms, ids = (x**2).sum(1), names[at]
            for s in range(0, len(q), 128):
                part, own = q[s : s + 128], which[s : s + 128]
                # products say which rows can be among the best; those, ties included, are compared exactly
                near = norms - 2 * part @ x.T
                bar = best.bar[own] ** 2 - (part**2).sum(1)
                most = int(best.most[own].max())
                if len(x) > most:
                    bar = np.minimum(bar, np.partition(near, most - 1, axis=1)[:, most - 1])
                qi, xi = np.nonzero(near <= bar[:, None] + 1e-9 * (1 + np.abs(bar[:, None])))
                for a in range(0, len(qi), 8_192):
                    i, j = qi[a : a + 8_192], xi[a : a + 8_192]
                    exact = np.sqrt(((x[j] - part[i]) ** 2).sum(1)).round(12)
                    kept = exact <= best.bar[own[i]]
                    best.add(own[i[kept]], exact[kept], ids[j[kept]])

    def score_postings(self, ids: np.ndarray, t: np.ndarray, w: np.ndarray, w_paths: np.ndarray) -> None:
        term = np.searchsorted(self.terms, t)
        starts = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
        for c in range(0, len(starts), self.COLUMNS):
            names = ids[starts[c : c + self.COLUMNS]]
            a, z = starts[c], starts[c + self.COLUMNS] if c + self.COLUMNS < len(starts) else len(ids)
            n = len(names)
            cell = term[a:z] * n + np.searchsorted(names, ids[a:z])
            for paths, weight in ((False, w), (True, w_paths)):
                which = np.flatnonzero(self.for_paths == paths)
                if not len(which):
                    continue
                by_term = np.bincount(cell, weight[a:z], (len(self.terms) + 1) * n).reshape(-1, n)
                for s in range(0, len(which), 128):
                    own = which[s : s + 128]
                    asked = self.asked[own]
                    score = by_term[asked[:, 0]]
                    for k in range(1, int((asked < len(self.terms)).sum(1).max())):
                        score += by_term[asked[:, k]]
                    qi, xi = np.nonzero((score > 0) & (-score <= self.words.bar[own][:, None]))
                    self.words.add(own[qi], -score[qi, xi], names[xi])

    def result(self) -> Iterator[pa.RecordBatch]:
        if self.heads is not None:
            return
        self.flush()
        lists = [best.ranked() for best in (self.words, self.near)]
        q, ids = (np.concatenate([x[n] for x in lists]) for n in (0, 1))
        part = np.concatenate([weight[x[0]] / (RRF_K + x[2] + 1) for weight, x in zip(self.weights, lists, strict=True)])
        if not len(q):
            return
        order = np.lexsort((ids, q))
        q, ids, part = q[order], ids[order], part[order]
        first = np.flatnonzero((np.diff(q, prepend=-1) != 0) | (np.diff(ids, prepend=ids[0] - 1) != 0))
        q, ids, score = q[first], ids[first], np.add.reduceat(part, first)
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < self.width[q]
        columns = [self.ids.take(pa.array(q[kept])), pa.array(ids[kept]), pa.array(score[kept]), pa.array((place[kept] + 1).astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "score", "rank"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, g = None, None
    for batch in batches:
        groups, kinds = batch.column("g").to_numpy(), batch.column("kind").to_numpy()
        edges = [0, *(np.flatnonzero((np.diff(groups) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(groups)]
        for a, z in pairwise(edges):
            if a == z:
                continue
            if block is None or g != groups[a]:
                if block is not None:
                    yield from block.result()
                block, g = _Block(), groups[a]
            block.take(int(kinds[a]), batch.slice(a, z - a))
    if block is not None:
        yield from block.result()


def hydrate(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their chunks; hits without a chunk are dropped and the order is kept in ``rank``."""
    return chunks.join(small(hits), "id")


def interleave(lists: DataFrame) -> DataFrame:
    """Round robin over lists (query_id, id, list, rank): first places first, a result once."""
    order = Window.partitionBy("query_id").orderBy("rank", "list", "id")
    first = Window.partitionBy("query_id", "id").orderBy("rank", "list")
    once = lists.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    return once.withColumn("place", F.row_number().over(order))


def merge_indexes(lists: DataFrame) -> DataFrame:
    """Results of several indexes (index_no, rank): the first index leads each round by one place."""
    key = F.col("rank") + F.when(F.col("index_no") != 0, 1).otherwise(0)
    return lists.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(key, "index_no", "rank")))

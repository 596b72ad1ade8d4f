"""Most similar vectors for every vector, with randomly rotated one-bit codes.

A vector is normalised, padded to D (a multiple of 64) coordinates and rotated by a seeded random
orthonormal matrix; the signs of the D rotated coordinates are a code of D / 64 machine words. With
f = <o, code> (the code scaled to unit length), a correction scalar kept per vector, <code, q> / f
estimates <o, q>, and the estimate errs by at most EPS * sqrt((1 - f^2) / f^2 / (D - 1)) but for a
tiny probability. Several codes of one vector are averaged, which divides the bound by the root of
their number.

``nearest`` answers a stated set of queries against all rows. Rows are divided in cells around
centroids, which are fitted per database on a sample of at most SAMPLE_FLOATS numbers; every row is
indexed. How many of the nearest cells a query visits follows from the sample too: so many that they
hold the wanted share of the sample's own nearest neighbours, which lie farther off than those among
all rows. In a cell queries are quantised to four bits,
inner products with CODES codes come from AND and popcount over four bit planes; the best estimates
are compared exactly, and then only vectors whose upper bound reaches the k-th best of these. Cells
beyond CELL_ROWS rows are cut in parts, each visited by the cell's queries.

``similar_pairs`` finds, for all rows, pairs at or above a similarity. Words from independent
rotations are cut in bands of bits; vectors that agree in a band meet. Each task that reads vectors
packs the entries of a band (key, row, code, scalar) in one binary block, so the shuffle moves a few
numbers per vector and band, never vectors, and no row per entry. Within a band a pair is kept if
the upper bound of the estimate from two codes of *another* rotation reaches the threshold; the
survivors are compared exactly. ``bits_for`` lets the bits grow with the number of rows, so that
buckets keep their size, and ``bands_for`` gives the number of bands for a stated recall at the
threshold; recall rises steeply above it. Members of a bucket of more than BUCKET entries (families of
vectors that hardly differ) are not compared by codes: ``exact_best`` compares all such members
exactly, so none of their nearest is lost. They are divided in cells around centroids; the radius of a
cell is that of its farthest member, so the triangle inequality of angles tells which cells cannot
hold a partner at the threshold, and all others are compared in blocks of bounded size, of which each
vector keeps its k best. That is quadratic in a family whose members all reach each other's threshold.
Keys that a sample of HOT_FLOATS numbers shows to be as large are spread over several tasks.

Equal vectors of one database are compared as one: a group of copies is represented by its lowest
row id, and each copy's neighbours follow from the representative's (the other copies come first,
by row id), so a third of all rows being one vector costs no quadratic work.

Edge cases: rows that are tombstoned (in any copy), null, of the wrong length, not finite or all
zero are left out, as are rows whose database has no manifest; repeated rows count once; ties in
similarity (to twelve decimals) go to the lower row id; an empty table gives no rows; a database
with fewer than k + 1 vectors gives all it has; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.session import cut, small

WORD = 64
#: Codes per vector in a search: each costs D bits, and the error of the estimate falls with the root of their number.
CODES = 3
#: Least bits of a band, and log2 of the entries that a bucket holds on average where rows are many.
BITS, BUCKET_BITS = 16, 5
RECALL = 0.9
EPS = 3.0
SEED = 20_240_607
#: Entries of a band that one task holds at most, on average.
BLOCK_ENTRIES = 2_000_000
#: Entries up to which a bucket is compared all with all by codes, and most such comparisons that an entry of a larger one may cost (it costs none: ``exact_best`` has them).
BUCKET, WINDOW = 256, 12
#: Cells: numbers in the sample that centroids are fitted on, most cells of a database, rows of a cell in one task.
SAMPLE_FLOATS, MOST_CELLS, CELL_ROWS = 4_000_000, 4_096, 50_000
#: Numbers in the sample that hot keys are read from, and rows of a cell of members of large buckets.
HOT_FLOATS, HOT_CELL = 250_000, 4_096
#: Share of the nearest neighbours that lie in visited cells, and sample rows it is read from.
VISITED, TRIALS = 0.97, 512


def bits_for(rows: int) -> int:
    """Bits of a band: BITS, and one more with each doubling from 2 ** (BITS + BUCKET_BITS) rows on."""
    return min(32, max(BITS, math.ceil(math.log2(max(1, rows))) - BUCKET_BITS))


def bands_for(cosine: float, recall: float, bits: int = BITS) -> int:
    """Bands needed so that a pair of this similarity meets in one with this probability."""
    agree = (1 - math.acos(min(1.0, cosine)) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def padded(dim: int) -> int:
    return -(-dim // WORD) * WORD


@lru_cache(64)
def rotation(dim: int, number: int, seed: int = SEED) -> np.ndarray:
    """dim x D with orthonormal rows, D the next multiple of 64."""
    rng = np.random.default_rng([seed, dim, number])
    q, r = np.linalg.qr(rng.standard_normal((padded(dim), padded(dim))))
    return (q * np.sign(np.diag(r)))[:dim]


def encode(unit: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x D / 64, uint64) and correction scalars of unit vectors under one rotation."""
    turned = unit @ rotation(unit.shape[1], number)
    f = np.abs(turned).sum(1) / math.sqrt(turned.shape[1])
    return np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64), f.astype(np.float32)


def usable_rows(vectors: DataFrame, manifest: DataFrame) -> DataFrame:
    """rowid, db, vector, dead: rows that can be compared, and tombstoned rows (they kill their copies)."""
    dims = small(manifest.groupBy("database_id").agg(F.max("dim").alias("dim")))
    ok = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select(F.col("rowid").cast("long").alias("rowid"), "database_id", "vector", F.coalesce("tombstoned", F.lit(False)).alias("dead"))
    rows = rows.join(dims, "database_id").where((F.size("vector") == F.col("dim")) & ok | F.col("dead"))
    return rows.select("rowid", F.xxhash64("database_id").alias("db"), "vector", "dead")


def live_vectors(vectors: DataFrame, manifest: DataFrame) -> DataFrame:
    """rowid, db, vector of the rows that can be compared, once each."""
    one = usable_rows(vectors, manifest).groupBy("rowid").agg(F.max("dead").alias("dead"), F.max(F.struct("db", "vector")).alias("r"))
    return one.where("not dead").select("rowid", "r.db", "r.vector")


def unit_rows(column: pa.Array, wanted: np.ndarray) -> np.ndarray:
    """Chosen rows of a list column of equal lengths as unit vectors."""
    taken = column.take(pa.array(wanted))
    flat = taken.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(wanted), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def by_dim(column: pa.Array) -> Iterator[np.ndarray]:
    lengths = np.diff(column.offsets.to_numpy())
    for d in np.unique(lengths):
        yield np.flatnonzero(lengths == d)


F_STEP = 1 / 255
#: Scalar of an entry whose key is known to be that of a large bucket.
LARGE = 0


@lru_cache
def entry(words: int) -> np.dtype:
    return np.dtype([("key", "<u4"), ("row", "<i8"), ("f", "u1"), ("code", "<u8", (words,))])


def band_keys(unit: np.ndarray, bands: int, bits: int) -> Iterator[np.ndarray]:
    """The key of each band, cut from the words of as many rotations as it takes."""
    per_word, mask, done, number = WORD // bits, np.uint64((1 << bits) - 1), 0, 1
    while done < bands:
        for word in encode(unit, number)[0].T:
            for k in range(per_word):
                if done < bands:
                    yield (word >> np.uint64(k * bits)) & mask
                    done += 1
        number += 1


def _packer(bands: int, bits: int, parts: int, hot: dict[int, list[np.ndarray]]):
    """``hot[db]``: per band the keys of large buckets."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], list[np.ndarray]] = {}
        seen: set[int] = set()  # bodies of this task: copies are packed once
        for batch in batches:
            column, bodies, dbs = batch.column("vector"), batch.column("body").to_numpy(), batch.column("db").to_numpy()
            for wanted in by_dim(column):
                fresh = [i for i in wanted if not (bodies[i] in seen or seen.add(bodies[i]))]
                if not fresh:
                    continue
                wanted = np.array(fresh)
                unit = unit_rows(column, wanted)
                db = dbs[wanted]
                code, f = encode(unit, 0)
                e = np.empty(len(wanted), entry(code.shape[1]))
                e["row"], e["code"] = bodies[wanted], code
                for band, key in enumerate(band_keys(unit, bands, bits)):
                    e["key"], e["f"] = key, np.rint(f / F_STEP)
                    part = key % np.uint64(parts)
                    for d in np.unique(db):
                        large = np.flatnonzero(np.isin(key, hot[int(d)][band]) & (db == d)) if int(d) in hot else ()
                        if len(large):
                            e["f"][large] = LARGE
                            part[large] = e["row"][large].view(np.uint64) % np.uint64(parts)
                    order = np.lexsort((part, db))
                    d, p = db[order], part[order]
                    starts = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (p[1:] != p[:-1])))
                    for a, b in zip(starts, np.append(starts[1:], len(order)), strict=True):
                        held.setdefault((int(d[a]), band, int(p[a])), []).append(e[order[a:b]])
        keys = list(held)
        # keys in order and as differences, columns apart: what can be compressed is compressed
        blocks = []
        for k in keys:
            e = np.concatenate(held.pop(k))
            e = e[np.argsort(e["key"], kind="stable")]
            gaps = np.diff(e["key"].astype(np.int64), prepend=0)
            width = "<u1" if gaps.max() < 256 else "<u2" if gaps.max() < 65536 else "<u4"
            head = bytes([np.dtype(width).itemsize, e["code"].shape[1]]) + len(e).to_bytes(4, "little")
            blocks.append(head + gaps.astype(width).tobytes() + e["f"].tobytes() + e["row"].tobytes() + e["code"].tobytes())
        yield pa.RecordBatch.from_pydict({
            "db": pa.array([k[0] for k in keys], pa.int64()), "band": pa.array([k[1] for k in keys], pa.int32()),
            "part": pa.array([k[2] for k in keys], pa.int32()), "block": pa.array(blocks, pa.binary()),
        })

    return pack


def unpack(block: bytes) -> np.ndarray:
    w, words, n = block[0], block[1], int.from_bytes(block[2:6], "little")
    e = np.empty(n, entry(words))
    at = 6
    e["key"] = np.cumsum(np.frombuffer(block, f"<u{w}", n, at).astype(np.int64))
    e["f"] = np.frombuffer(block, "u1", n, at + w * n)
    e["row"] = np.frombuffer(block, "<i8", n, at + (w + 1) * n)
    e["code"] = np.frombuffer(block, "<u8", n * words, at + (w + 9) * n).reshape(n, words)
    return e


def estimate_ok(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Whether the upper bound of the similarity of two entries reaches ``cosine``.

    The inner product of two sign codes, corrected by both scalars, has its mean at asin(similarity);
    its spread is that of the share of differing bits.
    """
    bits = WORD * a["code"].shape[1]
    ip = 1 - 2.0 * np.bitwise_count(a["code"] ^ b["code"]).sum(1, dtype=np.int32) / bits
    differ = math.acos(cosine) / math.pi
    slack = EPS * math.pi * math.sqrt(differ * (1 - differ) / bits)
    f = a["f"].astype(np.float32) * b["f"] * np.float32(F_STEP**2)
    return ip / np.maximum(f, 1e-6) + slack + 0.01 >= math.asin(cosine)


def meeting_pairs(entries: np.ndarray, cosine: float) -> np.ndarray:
    """Pairs (low, high) that share a key and pass the estimate; members of buckets of more than BUCKET come as pairs with themselves."""
    e = entries[np.lexsort((entries["row"], entries["key"]))]
    copy = np.zeros(len(e), bool)
    copy[1:] = (e["key"][1:] == e["key"][:-1]) & (e["row"][1:] == e["row"][:-1])  # copies that several tasks have read
    e = e[~copy]
    _, bucket, size = np.unique(e["key"], return_inverse=True, return_counts=True)
    large = (size[bucket] > BUCKET) | (e["f"] == LARGE)
    members = np.unique(e["row"][large])
    out, gap = [np.stack([members, members], 1)], 1
    e = e[~large]
    key = e["key"]
    left = np.arange(len(e))
    while len(left):
        left = left[left + gap < len(e)]
        left = left[key[left] == key[left + gap]]  # runs are contiguous: who fails here fails for larger gaps
        a, b = e[left], e[left + gap]
        ok = estimate_ok(a, b, cosine)
        if ok.any():
            x, y = a["row"][ok], b["row"][ok]
            out.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
        gap += 1
    return np.concatenate(out)


def hot_keys(rows: DataFrame, n: int, bands: int, bits: int) -> dict[int, list[np.ndarray]]:
    """Per database and band the keys that hold more than BUCKET rows by a sample."""
    dim = rows.select(F.max(F.size("vector"))).first()[0] or 1
    every = max(1, n * dim // HOT_FLOATS)
    sample = rows.where(F.pmod(F.xxhash64("body", F.lit(SEED)), F.lit(every)) == 0).groupBy("body").agg(F.any_value("db").alias("db"), F.any_value("vector").alias("vector")).toArrow()
    column, dbs = sample.column("vector").combine_chunks(), sample.column("db").to_numpy()
    out: dict[int, list[np.ndarray]] = {}
    for d in np.unique(dbs):
        unit = unit_rows(column, np.flatnonzero(dbs == d))
        large = []
        for key in band_keys(unit, bands, bits):
            values, times = np.unique(key, return_counts=True)
            large.append(values[(times * every > BUCKET) & (times > 1)])
        if any(map(len, large)):
            out[int(d)] = large
    return out


def best_of(q: np.ndarray, x: np.ndarray, k: int, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in q, in x) of the k best of x for each of q that reach ``cosine``, ties to the lower position; where both are the ``same``, others only."""
    out, step = [], max(1, 2_000_000 // len(x))
    for a in range(0, len(q), step):
        s = (q[a : a + step] @ x.T).round(12)
        i = np.arange(len(s))
        if same:
            s[i, a + i] = -2
        for _ in range(k):
            j = s[i].argmax(1)
            ok = s[i, j] >= cosine - 1e-9
            i, j = i[ok], j[ok]
            if not len(i):
                break
            out.append(np.stack([a + i, j]))
            s[i, j] = -2
    return tuple(np.concatenate(out, 1)) if out else (np.empty(0, np.int64), np.empty(0, np.int64))


def _placed(shared):
    """Rows with the cell whose centroid is nearest, and the angle to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dbs = batch.column("db").to_numpy()
            for d in np.unique(dbs):
                w = np.flatnonzero(dbs == d)
                unit, c = unit_rows(batch.column("vector"), w), shared.value[int(d)]
                cell = nearest_cells(unit, c, 1)[:, 0]
                angle = np.arccos(np.clip((unit * c[cell]).sum(1), -1, 1))
                yield pa.RecordBatch.from_arrays([batch.column(n).take(pa.array(w)) for n in ("db", "body", "rep", "vector")] + [pa.array(cell.astype(np.int32)), pa.array(angle)], names=["db", "body", "rep", "vector", "cell", "angle"])

    return run


def _blocks(shared, cosine: float):
    """Rows once for each block (lo, hi) of two parts of cells: of their own part and each part that may hold a partner."""
    reach = math.acos(cosine) + 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dbs, bodies, cells = (batch.column(n).to_numpy() for n in ("db", "body", "cell"))
            for d in np.unique(dbs):
                c, radius, parts = shared.value[int(d)]
                base = np.cumsum(parts) - parts
                rows = np.flatnonzero(dbs == d)
                step = max(1, 20_000 // int(parts.sum()))
                for w in (rows[a : a + step] for a in range(0, len(rows), step)):
                    angle = np.arccos(np.clip(unit_rows(batch.column("vector"), w) @ c.T, -1, 1))
                    i, v = np.nonzero((angle <= radius + reach) | (cells[w, None] == np.arange(len(c))))
                    at = np.repeat(np.arange(len(i)), parts[v])
                    other = base[v[at]] + np.arange(len(at)) - np.repeat(np.cumsum(parts[v]) - parts[v], parts[v])
                    w = w[i[at]]
                    own = base[cells[w]] + bodies[w] % parts[cells[w]]
                    arrays = [batch.column(n).take(pa.array(w)) for n in ("db", "body", "rep", "vector")]
                    arrays += [pa.array(x.astype(np.int32)) for x in (np.minimum(own, other), np.maximum(own, other), own)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["db", "body", "rep", "vector", "lo", "hi", "own"])

    return run


def exact_best(rows: DataFrame, k: int, cosine: float) -> DataFrame:
    """low, high: pairs of which one is among the k most similar of the other, by comparison of all ``rows`` (db, body, rep, vector) that can reach ``cosine``."""
    spark = rows.sparkSession
    counts = {r.db: (r.n, r.dim) for r in rows.groupBy("db").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).collect()}  # one row per database of the manifest
    every = max(1, sum(n * d for n, d in counts.values()) // SAMPLE_FLOATS)
    sample = rows.where(F.pmod(F.xxhash64("body", F.lit(SEED)), F.lit(every)) == 0).select("db", "vector").toArrow()
    column, dbs = sample.column("vector").combine_chunks(), sample.column("db").to_numpy()
    fitted = {}
    for d, (n, dim) in counts.items():
        w = np.flatnonzero(dbs == d)
        fitted[int(d)] = centroids(unit_rows(column, w), min(MOST_CELLS, -(-n // HOT_CELL))) if len(w) else np.eye(1, dim)
    placed = cut(rows.select("db", "body", "rep", "vector").mapInArrow(_placed(spark.sparkContext.broadcast(fitted)), "db long, body long, rep long, vector array<float>, cell int, angle double"))
    found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {d: (c, np.full(len(c), -np.inf), np.ones(len(c), np.int64)) for d, c in fitted.items()}
    for r in placed.groupBy("db", "cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect():  # at most one row per centroid
        found[r.db][1][r.cell], found[r.db][2][r.cell] = r.radius, -(-r.n // (2 * HOT_CELL))
    blocks = placed.mapInArrow(_blocks(spark.sparkContext.broadcast(found), cosine), "db long, body long, rep long, vector array<float>, lo int, hi int, own int")

    def search(group: pa.Table) -> pa.Table:
        group = group.sort_by("rep")
        lo, own, body = group.column("lo")[0].as_py(), group.column("own").to_numpy(), group.column("body").to_numpy()
        unit = unit_rows(group.column("vector").combine_chunks(), np.arange(len(body)))
        one, two = np.flatnonzero(own == lo), np.flatnonzero(own != lo)
        pairs = [(one, one)] if group.column("hi")[0].as_py() == lo else [(one, two), (two, one)] if len(one) and len(two) else []
        low, high = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for q, x in pairs:
            i, j = best_of(unit[q], unit[x], k, cosine, q is x)
            a, b = body[q[i]], body[x[j]]
            low, high = [*low, np.minimum(a, b)], [*high, np.maximum(a, b)]
        return pa.table({"low": np.concatenate(low), "high": np.concatenate(high)})

    return blocks.groupBy("db", "lo", "hi").applyInArrow(search, "low long, high long")


def similar_pairs(rows: DataFrame, live: DataFrame, k: int, cosine: float, recall: float = RECALL, bits: int | None = None) -> DataFrame:
    """low, high, similarity of pairs of different vectors at or above ``cosine``; of members of large buckets those with the k most similar.

    ``rows`` has db, body, vector and may repeat bodies; it is read several times and should be a cheap scan. ``live`` has rowid and body.
    """
    n = rows.count()
    bits = bits or bits_for(n)
    bands = bands_for(cosine, recall, bits)
    parts = max(1, -(-n // BLOCK_ENTRIES))
    blocks = rows.mapInArrow(_packer(bands, bits, parts, hot_keys(rows, n, bands, bits)), "db long, band int, part int, block binary")

    def meet(group: pa.Table) -> pa.Table:
        entries = np.concatenate([unpack(x.as_py()) for x in group.column("block")])
        pairs = meeting_pairs(entries, cosine)
        return pa.table({"low": pairs[:, 0], "high": pairs[:, 1]})

    met = cut(blocks.groupBy("db", "band", "part").applyInArrow(meet, "low long, high long").distinct())
    members, met = met.where("low = high").select(F.col("low").alias("body")), met.where("low != high")
    if not members.isEmpty():
        reps = live.join(members.hint("merge"), "body", "left_semi").groupBy("body").agg(F.min("rowid").alias("rep"))
        large = rows.join(members.hint("merge"), "body", "left_semi").groupBy("body").agg(F.max("db").alias("db"), F.max("vector").alias("vector"))
        met = cut(met.unionByName(exact_best(cut(large.join(reps.hint("merge"), "body")), k, cosine)).distinct())
    needed = cut(met.select(F.col("low").alias("body")).unionByName(met.select(F.col("high").alias("body"))).distinct())
    v = rows.select("body", "vector").join(needed.hint("merge"), "body", "left_semi").groupBy("body").agg(F.max("vector").alias("vector"))
    both = met.hint("merge").join(v.withColumnsRenamed({"body": "low", "vector": "a"}), "low").hint("merge").join(v.withColumnsRenamed({"body": "high", "vector": "b"}), "high")
    return both.select("low", "high", cosine_of(F.col("a"), F.col("b")).alias("similarity")).where(F.col("similarity") >= cosine)


def cosine_of(a, b):
    """Exact similarity in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))


def top_similar(vectors: DataFrame, manifest: DataFrame, k: int, cosine: float, recall: float = RECALL) -> DataFrame:
    """rowid, other, similarity, place: those of each row's k most similar others that reach ``cosine``.

    Vectors are hashed in place; what is shuffled per row is an id and a hash, never the vector.
    """
    rows = usable_rows(vectors, manifest).withColumn("body", F.xxhash64("db", "vector"))
    one = rows.groupBy("rowid").agg(F.max("dead").alias("dead"), F.max("body").alias("body"))
    live = cut(one.where("not dead").select("rowid", "body"))
    pairs = cut(similar_pairs(rows.where("not dead").select("db", "body", "vector"), live, k, cosine, recall))
    near = pairs.unionByName(pairs.select(F.col("high").alias("low"), F.col("low").alias("high"), "similarity"))
    return rows_of(near, live, live, k)


def rows_of(near: DataFrame, asked: DataFrame, live: DataFrame, k: int) -> DataFrame:
    """rowid, other, similarity, place of the rows ``asked``, from similarities (low, high, similarity) of different vectors.

    ``asked`` and ``live`` have rowid and body; ``near`` has at least the k best of each body that is asked.
    """
    copies = live.groupBy("body").agg(F.min("rowid").alias("rep"), F.count("*").alias("n"))
    near = near.withColumn("similarity", F.round("similarity", 12)).join(copies.select(F.col("body").alias("high"), F.col("rep").alias("high_rep")).hint("merge"), "high")
    best = Window.partitionBy("low").orderBy(F.desc("similarity"), "high_rep")
    near = near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)

    # at most k + 1 copies of a vector can be among anyone's k most similar
    many = live.join(copies.where("n > 1").hint("merge"), "body")
    first = many.withColumn("c", F.row_number().over(Window.partitionBy("body").orderBy("rowid"))).where(F.col("c") <= k + 1).select("body", F.col("rowid").alias("other"))
    shown = first.unionByName(copies.where("n = 1").select("body", F.col("rep").alias("other")))
    own = asked.join(first.hint("merge"), "body").where("rowid != other").select("rowid", "other", F.lit(1.0).alias("similarity"))
    others = near.join(shown.withColumnRenamed("body", "high").hint("merge"), "high").join(asked.withColumnRenamed("body", "low").hint("merge"), "low").select("rowid", "other", "similarity")
    place = Window.partitionBy("rowid").orderBy(F.desc("similarity"), "other")
    return own.unionByName(others).withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)


def _planes(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rotated queries quantised to four bits: planes (4 x q x words), low, step, sum."""
    low = turned.min(1)
    step = np.maximum((turned.max(1) - low) / 15, 1e-12)
    level = np.clip(np.rint((turned - low[:, None]) / step[:, None]), 0, 15).astype(np.uint8)
    planes = np.stack([np.packbits((level >> j) & 1, axis=1, bitorder="little").view(np.uint64) for j in range(4)])
    return planes, low, step, level.sum(1)


def estimates(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarities of unit vectors (q x rows) and the bound of their error."""
    bits = padded(x.shape[1])
    root, est, slack = math.sqrt(bits), np.zeros((len(q), len(x)), np.float32), np.zeros((len(q), len(x)), np.float32)
    for number in range(CODES):
        codes, f = encode(x, number)
        planes, low, step, total = _planes(q @ rotation(q.shape[1], number))
        hits = np.zeros((len(q), len(x)), np.float32)
        for w in range(bits // WORD):
            for j in range(4):
                hits += np.bitwise_count(planes[j, :, w, None] & codes[:, w]) * np.float32(1 << j)
        ones = np.bitwise_count(codes).sum(1, dtype=np.float32)
        ip = (2 * step[:, None] * hits + 2 * low[:, None] * ones - step[:, None] * total[:, None]) / root - root * low[:, None]
        est += (ip / f).astype(np.float32)
        slack += (np.maximum(1 - f**2, 0) / f**2 / (bits - 1) + (step[:, None] / f) ** 2 / 12).astype(np.float32)
    return est / CODES, EPS * np.sqrt(slack) / CODES


def search_block(q: np.ndarray, x: np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions and similarities (q x k, -1 where none) of the k best of x for each query, and the number of exact comparisons.

    The best estimates are compared exactly; their k-th best and the bounds choose what else is.
    Ties go to the lower position. ``skip[i, j]`` excludes a pair.
    """
    est, slack = estimates(q, x)
    if skip is not None:
        est = np.where(skip, -np.inf, est)
    where, sims = np.full((len(q), k), -1), np.full((len(q), k), -np.inf)
    m = min(2 * k, len(x))
    first = np.argpartition(-est, m - 1, axis=1)[:, :m]
    exact = np.einsum("qmd,qd->qm", x[first], q)
    exact[~np.isfinite(np.take_along_axis(est, first, 1))] = -np.inf
    bar = np.sort(exact, axis=1)[:, -k] if m >= k else np.full(len(q), -np.inf)
    chosen = (est + slack >= bar[:, None] - 1e-9) & np.isfinite(est)
    np.put_along_axis(chosen, first, np.isfinite(np.take_along_axis(est, first, 1)), 1)
    qi, xi = np.nonzero(chosen)
    s = np.concatenate([np.einsum("nd,nd->n", q[qi[a : a + 100_000]], x[xi[a : a + 100_000]]) for a in range(0, len(qi), 100_000)] or [np.empty(0)]).round(12)
    order = np.lexsort((xi, -s, qi))
    qi, xi, s = qi[order], xi[order], s[order]
    place = np.arange(len(qi)) - np.searchsorted(qi, qi)
    kept = place < k
    where[qi[kept], place[kept]], sims[qi[kept], place[kept]] = xi[kept], s[kept]
    return where, sims, len(qi)


def centroids(unit: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    """Unit centroids of a sample: a few rounds of spherical k-means from a seeded choice."""
    rng = np.random.default_rng(SEED)
    c = unit[np.sort(rng.choice(len(unit), min(cells, len(unit)), replace=False))]
    for _ in range(rounds):
        own = nearest_cells(unit, c, 1)[:, 0]
        total = np.zeros_like(c)
        np.add.at(total, own, unit)
        length = np.sqrt((total**2).sum(1, keepdims=True))
        c = np.where(length > 1e-9, total / np.maximum(length, 1e-9), c)
    return c


def nearest_cells(unit: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    n = min(n, len(c))
    out = np.empty((len(unit), n), np.int64)
    for a in range(0, len(unit), 4096):
        d = unit[a : a + 4096] @ c.T
        out[a : a + 4096] = d.argmax(1)[:, None] if n == 1 else np.argpartition(-d, n - 1, axis=1)[:, :n] if n < len(c) else np.arange(n)
    return out


def cells_to_visit(unit: np.ndarray, c: np.ndarray, k: int, share: float) -> int:
    """Nearest cells of a row that hold this share of its k nearest among the sample."""
    q = unit[:: max(1, len(unit) // TRIALS)]
    own = nearest_cells(unit, c, 1)[:, 0]
    near = np.argpartition(-(q @ unit.T), min(k, len(unit) - 1), axis=1)[:, : k + 1]  # with the row itself
    d = q @ c.T
    order = np.argsort(-d, axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(c))[None, :], 1)
    ranks = np.sort(np.take_along_axis(rank, own[near], 1)[(q @ unit.T)[np.arange(len(q))[:, None], near] < 1 - 1e-9])
    return int(ranks[min(len(ranks) - 1, math.ceil(share * len(ranks)))]) + 1 if len(ranks) else 1


def _cells(shared, visit: bool):
    """Rows with the cells they lie in (one) or visit (several)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, dbs = batch.column("vector"), batch.column("db").to_numpy()
            for d in np.unique(dbs):
                w = np.flatnonzero(dbs == d)
                c, probes = shared.value[int(d)]
                own = nearest_cells(unit_rows(column, w), c, probes if visit else 1)
                rows = pa.array(np.repeat(w, own.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(c).take(rows) for c in ("db", "body", "rep", "vector")] + [pa.array(own.ravel().astype(np.int32))], names=["db", "body", "rep", "vector", "cell"])

    return run


def nearest(queries: DataFrame, base: DataFrame, k: int, visited: float = VISITED) -> DataFrame:
    """rowid, other, similarity, place: the k most similar base rows of each query, itself excluded.

    Both sides have rowid, db, vector, and queries are rows of the base.
    """
    spark = base.sparkSession
    live = cut(base.withColumn("body", F.xxhash64("db", "vector")).select("rowid", "db", "body", "vector"))
    asked = cut(live.select("rowid", "body").join(queries.select("rowid").distinct().hint("merge"), "rowid", "left_semi"))
    reps = live.groupBy("body").agg(F.min("rowid").alias("rep"), F.any_value("db").alias("db"), F.any_value("vector").alias("vector"))
    counts = {r.db: (r.n, r.dim) for r in live.groupBy("db").agg(F.count_distinct("body").alias("n"), F.max(F.size("vector")).alias("dim")).collect()}  # one row per database of the manifest
    every = max(1, sum(n * d for n, d in counts.values()) // SAMPLE_FLOATS)
    sample = live.where(F.pmod(F.xxhash64("body", F.lit(SEED)), F.lit(every)) == 0).select("db", "vector").toArrow()
    column, dbs = sample.column("vector").combine_chunks(), sample.column("db").to_numpy()
    fitted = {}
    for d, (n, dim) in counts.items():
        w = np.flatnonzero(dbs == d)
        unit = unit_rows(column, w) if len(w) else np.zeros((1, dim))
        c = centroids(unit, max(1, min(MOST_CELLS, math.isqrt(n))))
        fitted[int(d)] = c, cells_to_visit(unit, c, k, visited)
    shared = spark.sparkContext.broadcast(fitted)  # at most MOST_CELLS centroids of each database of the manifest
    ddl = "db long, body long, rep long, vector array<float>, cell int"
    placed = cut(reps.select("db", "body", "rep", "vector").mapInArrow(_cells(shared, False), ddl))
    visits = reps.join(asked.select("body").distinct().hint("merge"), "body", "left_semi").select("db", "body", "rep", "vector").mapInArrow(_cells(shared, True), ddl)
    sizes = placed.groupBy("db", "cell").agg(F.ceil(F.count("*") / F.lit(CELL_ROWS)).cast("int").alias("parts"))
    sizes = F.broadcast(sizes)  # at most one row per centroid
    placed = placed.join(sizes, ["db", "cell"]).withColumn("part", F.pmod("body", F.col("parts")).cast("int")).drop("parts")
    visits = visits.join(sizes, ["db", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def search(asking: pa.Table, here: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if asking.num_rows and here.num_rows:
            here = here.sort_by("rep")
            x, q = unit_rows(here.column("vector").combine_chunks(), np.arange(here.num_rows)), unit_rows(asking.column("vector").combine_chunks(), np.arange(asking.num_rows))
            own, qid = here.column("body").to_numpy(), asking.column("body").to_numpy()
            step = max(1, 2_000_000 // len(x))
            for s in range(0, len(q), step):
                at, sim, _ = search_block(q[s : s + step], x, k, qid[s : s + step, None] == own[None, :])
                i, j = np.nonzero(at >= 0)
                out.append((qid[s + i], own[at[i, j]], sim[i, j]))
        low, high, sim = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"low": low, "high": high, "similarity": sim})

    by = ["db", "cell", "part"]
    near = visits.groupBy(*by).cogroup(placed.groupBy(*by)).applyInArrow(search, "low long, high long, similarity double")
    return rows_of(near, asked, live.select("rowid", "body"), k)

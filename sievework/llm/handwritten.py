"""Telling hand-written source from generated, minified, vendored files and data blobs.

Every file becomes token shingles in which names are masked; literals, keywords and punctuation
stay. MinHash signatures of the masked shingles are cut in bands; files that agree in a band meet, each
bucket is linked so that all its pairs that agree are connected, and links count only if the masked
signatures agree in at least ``SIMILAR`` of their values. Linked files whose literal signatures agree as well are copies, others are a
family. Links are closed transitively by passing the lowest id on.

* A cluster of copies that spans repositories is code from elsewhere: vendored, except where a file
  names its own repository as the owner.
* Files without names outside literals, and with many literals, are data saved as code: blobs.
* A family inside one repository is generated if a file of it says so, or if it has ``FAMILY`` members
  of ``FAMILY_TOKENS`` tokens that are no copies of each other: short files of one form are boilerplate.
* A source file that is one form (names and numbers masked) over and over with numbers that count upwards
  is generated, alone or not: accessors, tables of constants, switches of steps.
* Text that *declares* an origin (generator, upstream) before, behind or apart from the code, the
  conventional folders and names of such files, and the form of minified text are evidence of their own.
  Words that only occur somewhere are not: a declaration must open a comment, and behind the head one that
  is attached to code or lies in a string (a template) is a mention.

Exact copies are compared once: one file stands for all with the same bytes, with the number of
repositories it lies in.

Only ids, band keys and, for linked files, signatures are shuffled; never content. Of each minimum one byte is
kept for the comparison: minima that differ agree in it by chance once in 256. Buckets of
more than ``BUCKET`` files are subdivided by further minima without losing a pair; what is still larger
then is compared block by block, at quadratic cost.

Edge cases: null or empty content is judged by path alone, null paths by content alone; repeated
rows of a file give one result; ``size`` is not trusted (it may be null or wrong); very long files
are read whole in linear time; data formats (json, toml, md and such) are never blobs; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import shingles as sh
from sievework.session import cut

SIMILAR = 0.8
BAND_ROWS = 6
#: Files up to which a bucket is compared in one task.
BUCKET = 2000
#: Tokens from which near copies are meaningful; exact copies need fewer.
NEAR_TOKENS, COPY_TOKENS = 64, 24
#: Members of one repository, and tokens of each, from which a family that declares nothing is generated.
FAMILY, FAMILY_TOKENS = 3, 200
#: Share of a file's forms that must occur FORM_TIMES in it; forms of fewer than FORM_SHARE of the tokens are mostly prose.
FORM_TOKENS, FORM_TIMES, REPEATED, FORM_SHARE = 200, 20, 0.94, 0.5
HEADER_LINES, HEADER_CHARS = 30, 4000
LONG_LINE = 240

_OPEN = r"^[ \t]*(?://[/!]?|#+|/\*+!?|\*|--|;+|<!--|\"\"\"|''')[ \t]*"
GENERATED_TEXT = re.compile(
    _OPEN + r"(?:<auto-?generated\b|@generated\b|(?:this (?:file|code|class|module) (?:was|is|has been) )?(?:automatically |machine[- ]|auto-?)?generated (?:by|from|with|on)\b"
    r"|(?:this (?:file|code) (?:was|is) )(?:auto-?generated|automatically generated|machine[- ]generated)\b|autogenerated (?:by|from)\b"
    r"|code generated (?:by|from)\b|(?:machine[- ]made|machine[- ]generated) (?:output|file|code)\b|do not (?:edit|modify)\b|automatisch (?:erzeugt|generiert)\b|(?:fichier )?généré automatiquement\b|generado automáticamente\b)",
    re.I | re.M,
)
UPSTREAM_TEXT = re.compile(
    _OPEN + r"(?:bundled copy of|vendored (?:copy|from)|third[- ]party copy|copied (?:verbatim |unchanged )?from|(?:[\w.-]+ (?:-|–|:) )?imported from (?:the )?upstream|taken (?:unchanged )?from upstream"
    r"|copyright\b.{0,40}\bthe [\w.-]+ authors\b)",
    re.I | re.M,
)
OWNER_TEXT = re.compile(r"copyright (?:\(c\) |© )?[\d, -]*(?:the )?([\w.-]+) contributors\b", re.I)
BANNER = re.compile(r"^\s*/\*! *([\w.-]+) +v?\d")
#: Comments and blank lines only, from a place on.
COMMENTS = re.compile(r"(?:\s*+(?://[^\n]*+|\#(?!\s*+(?:include|define|if|ifdef|ifndef|endif|undef|pragma)\b)[^\n]*+|--[^\n]*+|;[^\n]*+|/\*.*?\*/|<!--.*?-->|\"\"\".*?\"\"\"|'''.*?'''))*+\s*+", re.S)
ALONE = re.compile(r"\s*(?:$|//|#|/\*|\*|--|;|<!--)")
VENDOR_PATH = re.compile(r"(?:^|/)(?:vendor|vendored|third[-_]party|thirdparty|3rdparty|node_modules|bower_components|deps|external|externals|bundled|Godeps|site-packages)/", re.I)
GENERATED_PATH = re.compile(
    r"(?:^|/)(?:generated|__generated__|generated[-_]sources|generated[-_]src|autogen|gen-src)/|^(?:dist|build|out|target)/"
    r"|\.(?:pb|pb\.gw|gen|g|generated|designer)\.\w+$|_pb2(?:_grpc)?\.py$|[-_.](?:autogen|generated)\.\w+$", re.I,
)
MINIFIED_PATH = re.compile(r"\.(?:min|bundle|chunk|pack)\.(?:js|css|mjs)$", re.I)
SOURCE = frozenset("py pyi rs ts tsx js jsx mjs cjs go java kt kts c h cc cpp cxx hpp cs rb php swift scala lua pl zig m mm".split())

NUMBER = re.compile(r"\b[0-9]{1,15}\b")

PAGE = re.compile(r"\ufeff?\s*(?:<!--.{0,2000}?-->\s*)*<(?:!doctype\s+html|html|head|body)\b", re.I | re.S)
MARKUP = frozenset("html htm xhtml shtml xml svg php phtml vue svelte jsp jspx asp aspx erb ejs hbs".split())

LIT_TOKENS, NAME_SHARE = 40, 0.12
SLICE_BYTES = 2_000_000


def minified_form(text: str) -> bool:
    """Long lines almost without white space."""
    lines = text.split("\n")
    long_chars = sum(len(x) for x in lines if len(x) >= LONG_LINE)
    if long_chars < 0.6 * len(text) or len(text) < 500:
        return "sourceMappingURL=" in text and long_chars > 0.3 * len(text)
    return sum(map(text.count, " \t\n")) < 0.09 * len(text)


def declared(text: str, repo: str | None) -> tuple[bool, bool, bool]:
    """(says it is generated, says it comes from elsewhere, says it is the repository's own)."""
    head = "\n".join(text[:HEADER_CHARS].split("\n", HEADER_LINES)[:HEADER_LINES])
    first = max(len(head), COMMENTS.match(text).end())
    own = False
    upstream = opens(UPSTREAM_TEXT, text, first) or bool(BANNER.match(head))
    for m in OWNER_TEXT.finditer(text[:first]):
        if repo and m.group(1).lower() == repo.lower():
            own = True
        else:
            upstream = True
    return opens(GENERATED_TEXT, text, first), upstream, own


def opens(pattern: re.Pattern, text: str, first: int) -> bool:
    """Whether a comment declares an origin: in the first part, behind all code, or as an unindented comment between blank lines or comments that lies in no string."""
    for m in pattern.finditer(text):
        if m.start() < first:
            return True
        start, close = text.rfind("/*", 0, m.end()), m.end()
        if start > text.rfind("*/", 0, m.end()):
            close = max(close, text.find("*/", close))
        else:
            start = text.rfind("\n", 0, m.end()) + 1
        stop = text.find("\n", close)
        stop = len(text) if stop < 0 else stop
        if COMMENTS.fullmatch(text, start):
            return True
        before = text[:start].rstrip("\n").rpartition("\n")[2] if not text[:start].endswith("\n\n") else ""
        after = text[stop + 1 :].split("\n", 1)[0]
        if text[start].isspace() or not (ALONE.match(before) and ALONE.match(after)):
            continue
        if not any(text.count(q, 0, start) % 2 for q in ('"""', "'''", "`")):
            return True
    return False


def literal_only(t: sh.Tokens) -> np.ndarray:
    """Per text: whether it has many literals and hardly a name outside them."""
    quote = t.buf == ord('"')
    before = np.zeros(len(quote), bool)
    before[1:] = t.buf[:-1] == ord("\\")
    ticks = np.concatenate([[0], np.cumsum(quote & ~before)])
    first = np.zeros(t.n, np.int64)
    seen, at = np.unique(t.text, return_index=True)
    first[seen] = ticks[t.start[at]]
    inside = (ticks[t.start] - first[t.text]) % 2 == 1
    words = (t.kind == sh.WORD) | (t.kind == sh.DIGIT)
    count = lambda m: np.bincount(t.text[m], minlength=t.n)
    literal = count(words & (inside | (t.kind == sh.DIGIT)))
    names = count((t.kind == sh.WORD) & ~inside)
    return (literal >= LIT_TOKENS) & (names <= NAME_SHARE * (literal + names)) & (names <= 40)


def repetitive(t: sh.Tokens, masked: np.ndarray) -> np.ndarray:
    """Per text: whether nearly all of it is a few forms over and over. Runs of names or numbers count once."""
    forms = np.where(t.kind == sh.DIGIT, np.uint64(2), masked)
    first = np.ones(len(forms), bool)
    first[1:] = (forms[1:] != forms[:-1]) | (t.text[1:] != t.text[:-1])
    hashes, text = sh.shingle(forms[first], t.text[first])
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(hashes)))
    total = np.bincount(text, minlength=t.n)
    often = np.bincount(text[at], weights=np.where(times >= FORM_TIMES, times, 0), minlength=t.n)
    return (total >= FORM_TOKENS) & (often >= REPEATED * total) & (total >= FORM_SHARE * np.bincount(t.text, minlength=t.n))


def saved_page(path: str | None, text: str | None) -> bool:
    """Whether a web page lies under the name of something else: it is no copied code."""
    ext = (path or "").rsplit(".", 1)[-1].lower()
    return ext not in MARKUP and bool(PAGE.match(text or ""))


def ascending(text: str) -> bool:
    """Whether numbers of the text count upwards: all, or every second, third or fourth of them."""
    x = np.array([int(n) for n in NUMBER.findall(text)])
    for lag in range(1, 5):
        for at in range(lag):
            column = x[at::lag]
            if len(column) >= FORM_TIMES and (np.diff(column) >= 0).mean() >= REPEATED and column[-1] > column[0]:
                return True
    return False


OUT = pa.schema([
    ("file_id", pa.int64()), ("repo", pa.string()), ("content_key", pa.int64()), ("tokens", pa.int32()), ("generated", pa.bool_()), ("vendored", pa.bool_()),
    ("own", pa.bool_()), ("minified", pa.bool_()), ("blob", pa.bool_()), ("sig", pa.binary()), ("keys", pa.list_(pa.int64())),
])
OUT_DDL = "file_id long, repo string, content_key long, tokens int, generated boolean, vendored boolean, own boolean, minified boolean, blob boolean, sig binary, keys array<long>"


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about SLICE_BYTES of content: the arrays over all bytes of a part stay small, however long files are."""
    column = batch.column("body")
    sizes = np.nan_to_num(np.array(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.float64))
    start, held = 0, 0.0
    for i, n in enumerate(sizes):
        if i > start and held + n > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0.0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def read_files(declarations: bool = True):
    """Evidence of single files, and their signatures."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, repos, paths, texts = (part.column(c).to_pylist() for c in ("file_id", "repo", "relative_path", "body"))
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
                t = sh.tokenize(np.frombuffer(b"".join(raw), np.uint8), offsets)
                tokens = np.bincount(t.text, minlength=t.n)
                literal = sh.signatures(*sh.shingle(t.hash, t.text), t.n)
                masked = sh.masked(t)
                names_masked = sh.signatures(*sh.shingle(masked, t.text), t.n)
                keys = sh.band_keys(names_masked, BAND_ROWS)
                blobs, repeats = literal_only(t), repetitive(t, masked)
                rows = []
                for i in range(part.num_rows):
                    path, text = paths[i] or "", texts[i] or ""
                    ext = path.rsplit(".", 1)[-1].lower() if "." in path else ""
                    gen, up, own = declared(text, repos[i]) if declarations else (False, False, False)
                    named = path if declarations else ""
                    source = ext in SOURCE
                    minified = source and (bool(MINIFIED_PATH.search(named)) or minified_form(text)) and not blobs[i]
                    counted = source and repeats[i] and not blobs[i] and not minified and ascending(text)
                    rows.append((
                        gen or bool(GENERATED_PATH.search(named)) or bool(counted), up or bool(VENDOR_PATH.search(named)), own,
                        minified, source and bool(blobs[i]),
                    ))
                flags = list(zip(*rows, strict=True)) or [[]] * 5
                page = [saved_page(path, text) for path, text in zip(paths, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array(repos, pa.string()), part.column("content_key"), pa.array(tokens.astype(np.int32)),
                    *[pa.array(x, pa.bool_()) for x in flags],
                    pa.array([np.stack([m, s]).tobytes() for m, s in zip(sh.low_bytes(names_masked), sh.low_bytes(literal), strict=True)], pa.binary()),
                    pa.array([k.tolist() if n >= NEAR_TOKENS and not p else [] for k, n, p in zip(keys, tokens, page, strict=True)], pa.list_(pa.int64())),
                ], schema=OUT)

    return read


def link(ids: np.ndarray, sig: np.ndarray) -> list[tuple[int, int, float, float]]:
    """Links (low, high, masked, literal) of a bucket that connect all its pairs that agree; each file is the centre once."""
    order = np.argsort(ids)
    ids, sig = ids[order], sig[order]
    family, copies = np.arange(len(ids)), np.arange(len(ids))
    out = []
    for i in range(len(ids) - 1):
        same = (sig[i] == sig[i + 1 :]).mean(2)
        near = same[:, 0] >= SIMILAR
        copy = near & (same[:, 1] >= SIMILAR)
        new = np.flatnonzero(near & (family[i + 1 :] != family[i]) | copy & (copies[i + 1 :] != copies[i]))
        for j in new:
            out.append((ids[i], ids[i + 1 + j], same[j, 0], same[j, 1]))
        for label, hit in ((family, near), (copies, copy)):
            label[np.isin(label, label[i + 1 :][hit])] = label[i]
    return out


def link_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of buckets; rows come sorted by key."""

    def rows(got: list[tuple[int, int, float, float]]) -> pa.RecordBatch:
        low, high, masked, literal = list(zip(*got, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(masked, pa.float64()), pa.array(literal, pa.float64())], names=["low", "high", "masked", "literal"])

    held: list[tuple[int, np.ndarray, np.ndarray]] = []

    def flush() -> list[tuple[int, int, float, float]]:
        got = link(np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])) if held else []
        held.clear()
        return got

    for batch in batches:
        if not batch.num_rows:
            continue
        key, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "file_id"))
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, 2, sh.BINS)
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        out = []
        for a, b in zip(starts, np.append(starts[1:], len(key)), strict=True):
            if held and held[0][0] != key[a]:
                out += flush()
            held.append((key[a], ids[a:b], sig[a:b]))
        yield rows(out)
    yield rows(flush())


def subdivide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets by further minima. A pair that agrees in SIMILAR of them differs in fewer minima than there are groups, so it agrees in all of some group."""
    groups = np.array_split(np.arange(sh.BINS), round(sh.BINS * (1 - SIMILAR)) + 1)
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, 2, sh.BINS)[:, 0]
        key = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
        ids = batch.column("file_id").to_numpy(zero_copy_only=False)
        for g, columns in enumerate(groups):
            h = sh.mix(key + np.uint64(g))
            for c in columns:
                h = sh.mix(h ^ sig[:, c].astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h.view(np.int64))], names=["file_id", "key"])


def links_of(entries: DataFrame, sigs: DataFrame, most: int | None = None) -> DataFrame:
    """low, high, masked, literal: links that connect every pair that meets in a bucket of ``entries`` (file_id, key) and agrees."""
    most = most or BUCKET

    def buckets(e: DataFrame) -> DataFrame:
        # buckets of the same files count once
        b = e.groupBy("key").agg(F.count("*").alias("n"), F.min("file_id").alias("lo"), F.max("file_id").alias("hi"), F.bit_xor(F.xxhash64("file_id")).alias("x")).where("n > 1")
        return e.join(cut(b.groupBy("n", "lo", "hi", "x").agg(F.min("key").alias("key")).select("key", "n")), "key")

    held = cut(buckets(entries))
    if held.where(F.col("n") > most).limit(1).count():
        hot = held.where(F.col("n") > most).join(sigs, "file_id").select("file_id", "key", "sig")
        held = held.where(F.col("n") <= most).unionByName(buckets(cut(hot.mapInArrow(subdivide, "file_id long, key long"))))
        # what is still too large is compared block by block
        blocks = F.ceil(F.col("n") * 2 / F.lit(most))
        held = held.withColumn("j", F.explode(F.when(F.col("n") > most, F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(F.lit(0).cast("long")))))
        b = F.pmod(F.xxhash64("file_id"), blocks)
        held = held.withColumn("key", F.when(F.col("n") > most, F.xxhash64("key", F.least(b, "j"), F.greatest(b, "j"))).otherwise(F.col("key")))
    rows = held.select("file_id", "key").distinct().join(sigs, "file_id").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(link_buckets, "low long, high long, masked double, literal double").distinct()


def clusters(links: DataFrame) -> DataFrame:
    """id, label: the lowest id reachable over links (low, high); ids without links are absent."""
    edges = cut(links.select("low", "high").unionByName(links.select(F.col("high").alias("low"), F.col("low").alias("high"))).distinct())
    labels = cut(edges.groupBy(F.col("low").alias("id")).agg(F.least(F.min("high"), F.col("low")).alias("label")))
    while True:
        near = edges.join(labels, edges.high == labels.id).groupBy("low").agg(F.min("label").alias("m"))
        # also jump to the label of one's label, so that chains halve with each round
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("j"))
        new = labels.join(near, labels.id == near.low, "left").join(jump, "label", "left").select("id", F.least("label", "m", "j").alias("label"), F.col("label").alias("old"))
        new = cut(new)
        if not new.where("label != old").limit(1).count():
            return new.select("id", "label")
        labels = new.select("id", "label")


def judge(files: DataFrame, declarations: bool = True) -> DataFrame:
    """file_id, repo and one flag per kind: generated, minified, vendored, blob.

    Without ``declarations`` neither comments nor names of files and folders count: what is found then comes from
    clusters and forms alone.
    """
    rows = files.where("file_id is not null").select(F.col("file_id").cast("long"), "repo", "relative_path", F.xxhash64("content").alias("content_key"), F.col("content").alias("body"))
    seen = cut(rows.mapInArrow(read_files(declarations), OUT_DDL).dropDuplicates(["file_id"]))

    same = seen.groupBy("content_key").agg(
        F.min("file_id").alias("rep"), (F.min("repo") != F.max("repo")).alias("spans"), F.max("tokens").alias("tokens"),
        F.min("repo").alias("repo_lo"), F.max("repo").alias("repo_hi"), F.max("generated").alias("some_generated"),
    )
    same = cut(same.withColumn("spans", F.coalesce("spans", F.lit(False)) & (F.col("tokens") >= COPY_TOKENS)))
    entries = seen.join(same.select(F.col("rep").alias("file_id")), "file_id", "left_semi").select("file_id", F.explode("keys").alias("key"))
    links = cut(links_of(entries, seen.select("file_id", "sig")))
    labels = clusters(links.where(F.col("literal") >= SIMILAR))
    forms = clusters(links).withColumnRenamed("label", "form")

    known = same.join(labels, same.rep == labels.id, "left").withColumn("label", F.coalesce("label", "rep")).drop("id")
    family = known.groupBy("label").agg(
        (F.coalesce(F.min("repo_lo") != F.max("repo_hi"), F.lit(False)) & ((F.count("*") > 1) | F.max("spans"))).alias("across"),
        F.max("some_generated").alias("family_generated"),
    )
    verdict = known.join(family, "label").select("content_key", "across", "family_generated")
    # families within a repository; content without links has none
    inside = known.join(forms, known.rep == forms.id).select("content_key", "label", "form")
    inside = inside.join(seen.select("content_key", "repo", "tokens", "generated"), "content_key").where("repo is not null")
    many = F.countDistinct(F.when(F.col("tokens") >= FAMILY_TOKENS, F.col("label"))) >= FAMILY
    made = inside.groupBy("form", "repo").agg((F.max("generated") | many).alias("made")).where("made")
    made = inside.join(made, ["form", "repo"]).select("content_key", "repo", "made").distinct()
    out = seen.join(verdict, "content_key").join(made, ["content_key", "repo"], "left")
    return out.select(
        "file_id", "repo",
        (F.col("generated") | F.col("family_generated") | F.coalesce("made", F.lit(False))).alias("generated"),
        "minified",
        (F.col("vendored") | F.col("across") & ~F.col("own")).alias("vendored"),
        "blob",
    )


def found(judged: DataFrame) -> DataFrame:
    return judged.where("generated or minified or vendored or blob").select("file_id").distinct()

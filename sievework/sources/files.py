"""Source trees as DataFrames: discovery, ignore rules, explanations, lossy reading."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text as t

MAX_BYTES = 1_000_000
#: Folders that are never source (fixed values).
DEFAULT_EXCLUDES = (".git", "node_modules", "target", "build", "dist", "__pycache__", ".venv")
BINARY_EXTENSIONS = tuple(
    "png jpg jpeg gif bmp ico webp pdf zip gz tar xz bz2 7z rar jar class so dll dylib exe bin o a wasm ttf otf woff woff2 eot mp3 mp4 avi mov wav flac ogg sqlite db pyc".split()
)
IGNORE_FILES = (".sieveignore", ".ignore", ".gitignore")


@dataclass(frozen=True)
class Rule:
    pattern: str
    regex: str
    keep: bool
    source: str


def compile_rule(line: str, source: str, base: str = "") -> Rule | None:
    """One line of an ignore file as a regular expression over relative paths; None for blanks and comments."""
    text = line.rstrip("\n").rstrip()
    if not text or text.startswith("#"):
        return None
    keep = text.startswith("!")
    body = text[1:] if keep else text
    folder = body.endswith("/")
    body = body.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out += "(?:.*/)?"
            i += 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out += "/.*"
            i += 3
        elif body.startswith("**", i):
            out += ".*"
            i += 2
        elif body[i] == "*":
            out += "[^/]*"
            i += 1
        elif body[i] == "?":
            out += "[^/]"
            i += 1
        elif body[i] == "[" and "]" in body[i + 2 :]:
            end = body.index("]", i + 2)
            inner = body[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[:1] in "!^" else inner) + "]"
            i = end + 1
        else:
            out += re.escape(body[i])
            i += 1
    prefix = re.escape(base) if anchored else re.escape(base) + "(?:.*/)?"
    return Rule(text, f"^{prefix}{out}{'/.+' if folder else '(?:/.*)?'}$", keep, source)


def ignore_rules(root: str) -> list[Rule]:
    """Rules of a tree, weakest first. Our own file replaces .gitignore unless it includes it by '#include .gitignore'."""
    own = os.path.join(root, IGNORE_FILES[0])
    names = list(IGNORE_FILES)
    if os.path.exists(own):
        with open(own) as f:
            if not any(x.strip() == "#include .gitignore" for x in f):
                names.remove(".gitignore")
    rules: list[Rule] = []
    for name in reversed(names):
        for folder, _, files in os.walk(root):
            if name in files:
                base = os.path.relpath(folder, root).replace(os.sep, "/")
                with open(os.path.join(folder, name)) as f:
                    rules += [r for r in (compile_rule(x, name, "" if base == "." else base + "/") for x in f) if r]
    return rules


def ignored(path: Column, rules: list[Rule]) -> Column:
    """Whether the last rule that matches a path drops it."""
    out: Column = F.lit(False)
    for r in rules:
        out = F.when(path.rlike(r.regex), F.lit(not r.keep)).otherwise(out)
    return out


def in_default_excludes(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in DEFAULT_EXCLUDES]))


def is_binary(content: Column) -> Column:
    return F.contains(F.substring(content, 1, 8192), F.lit(bytes([0])))


TREE = "relative_path string, size long, modified timestamp, content binary"


def read_tree(spark: SparkSession, root: str, most: int = MAX_BYTES) -> DataFrame:
    """relative_path, size, modified, content of all regular files below a root; links are not followed.

    Spark's own file sources skip names that start with an underscore or a dot, which source trees
    are full of, so folders are listed and read by tasks: one row per folder of the two upper
    levels. Files over ``most`` bytes keep their size but are not read.
    """
    full = os.path.abspath(root)
    if not os.path.isdir(full):
        raise FileNotFoundError(full)
    seeds = [("", False)]
    for first in os.scandir(full):
        if first.is_dir(follow_symlinks=False):
            seeds.append((first.name, False))
            seeds += [(f"{first.name}/{x.name}", True) for x in os.scandir(first.path) if x.is_dir(follow_symlinks=False)]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for folder, deep in zip(f["folder"], f["deep"], strict=True):
                rows = []
                for base, folders, names in os.walk(os.path.join(full, folder)):
                    if not deep:
                        folders.clear()
                    for n in names:
                        p = os.path.join(base, n)
                        if os.path.islink(p) or not os.path.isfile(p):
                            continue
                        info = os.stat(p)
                        body = b""
                        if info.st_size <= most:
                            with open(p, "rb") as file:
                                body = file.read()
                        rows.append((os.path.relpath(p, full).replace(os.sep, "/"), info.st_size, pd.Timestamp(int(info.st_mtime * 1e6), unit="us", tz="UTC"), body))
                if rows:
                    yield pd.DataFrame(rows, columns=["relative_path", "size", "modified", "content"])

    listed = spark.createDataFrame(sorted(seeds), "folder string, deep boolean").repartition(max(1, min(len(seeds), spark.sparkContext.defaultParallelism * 4)))
    return listed.mapInPandas(read, TREE)


def decide(files: DataFrame, rules: list[Rule], max_bytes: int = MAX_BYTES, default_excludes: bool = True) -> DataFrame:
    """decision ('index' or 'skip') and reason for every file; the first reason in order of precedence."""
    path = F.col("relative_path")
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    by_rule = F.lit(None).cast("string")
    for r in rules:
        by_rule = F.when(path.rlike(r.regex), F.lit(None).cast("string") if r.keep else F.lit(r.source)).otherwise(by_rule)
    reason = (
        F.when(in_default_excludes(path) & F.lit(default_excludes), "default exclude")
        .when(by_rule.isNotNull(), F.concat(F.lit("ignored by "), by_rule))
        .when(path.endswith(".rst.inc") & F.lit(default_excludes), "fragment")
        .when(F.col("size") > max_bytes, "too large")
        .when(F.col("size") == 0, "empty")
        .when(extension.isin(*BINARY_EXTENSIONS), "binary extension")
        .when(is_binary(F.col("content")), "binary content")
    )
    return files.withColumn("reason", F.coalesce(reason, F.lit("indexed"))).withColumn("decision", F.when(reason.isNull(), "index").otherwise("skip"))


def discover(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, default_excludes: bool = True, use_ignore: bool = True) -> DataFrame:
    """relative_path, size, language, content (text), content_hash of the files to index."""
    rules = ignore_rules(root) if use_ignore else []
    kept = decide(read_tree(spark, root, max_bytes), rules, max_bytes, default_excludes).where("decision = 'index'")
    content = F.make_valid_utf8(F.col("content").cast("string"))
    return kept.select("relative_path", "size", "modified", t.detect_language(F.col("relative_path")).alias("language"), content.alias("content"), F.sha2("content", 256).alias("content_hash"))


def explain_path(spark: SparkSession, root: str, relative_path: str, **options) -> tuple[str, str]:
    """(decision, reason) of one path."""
    full = os.path.normpath(os.path.join(root, relative_path))
    if not full.startswith(os.path.abspath(root)) and os.path.isabs(relative_path):
        return "skip", "outside root"
    if not os.path.exists(full):
        return "skip", "missing"
    if os.path.isdir(full):
        return "skip", "directory"
    if os.path.islink(full):
        return "skip", "not a regular file"
    with open(full, "rb") as f:
        body = f.read(options.get("max_bytes", MAX_BYTES) + 1)
    row = spark.createDataFrame([(relative_path, os.path.getsize(full), bytearray(body))], "relative_path string, size long, content binary")
    r = decide(row, ignore_rules(root), **options).first()
    return r.decision, r.reason


def git_scope(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """Paths changed since a commit, or in the working tree and not tracked; deletions are left out."""
    run = lambda *a: [x for x in subprocess.run(["git", "-C", root, *a], capture_output=True, text=True, check=True).stdout.split("\0") if x]
    if since:
        paths = run("diff", "--name-only", "-z", "--diff-filter=ACMRTUXB", since)
    else:
        paths = run("diff", "--name-only", "-z", "--diff-filter=ACMRTUXB", "HEAD") + run("ls-files", "-z", "--others", "--exclude-standard")
    return spark.createDataFrame([(p,) for p in sorted(set(paths))], "relative_path string")


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation tasks from JSON files (an array or one task per file)."""
    schema = "id string, query string, category string, repo string, ground_truth array<struct<file_path: string, line_start: long, line_end: long, relevance: int>>, description string"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    filled = F.transform("ground_truth", lambda g: g.withField("relevance", F.coalesce(g["relevance"], F.lit(1))))
    return rows.withColumn("ground_truth", filled)


def sampling_estimate(files: DataFrame, picks: int = 1000) -> DataFrame:
    """One file per interval of the sorted list, and its weight: the files of the interval. The pick within an interval follows a hash of the path."""
    total = files.count()
    n = min(picks, total)
    if not n:
        return files.withColumn("weight", F.lit(0.0)).limit(0)
    from pyspark.sql import Window

    interval = F.ntile(n).over(Window.orderBy("relative_path"))
    w = Window.partitionBy("interval")
    one = files.withColumn("interval", interval).withColumn("weight", F.count("*").over(w).cast("double"))
    return one.withColumn("k", F.row_number().over(w.orderBy(F.xxhash64("relative_path"), "relative_path"))).where("k = 1").drop("k", "interval")

"""Flags files that do not parse in the language of their extension.

Parsing is local to a file: no shuffle but for repeated rows, and only results leave the workers.
``check`` looks at every file with a known extension; a file whose least repair costs nothing is
valid. The chart alone decides, in every language.

Edge cases: null content or path, or an unknown extension, is not judged; an empty file is invalid
where the language demands content (JSON, Go); repeated rows of a file are judged alike and counted
once; line ends of any kind are equal; very long files are parsed whole, in time linear in their
length for valid ones; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.syntax.parser import parser_for

EXTENSIONS = ("py", "rs", "ts", "js", "go", "java", "c", "json")
DDL = "file_id long, repo string, extension string, cost int, reason string, place int, flawed boolean"


def judge_text(extension: str, text: str) -> tuple[int, str | None, int | None]:
    """(cost, reason, place of the first edit) of a text."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if extension != "json":
        text = text.removeprefix("\ufeff")
        if text.startswith("#!") and not text.startswith("#!["):
            text = "\n" + text.partition("\n")[2]  # the line names an interpreter, it is no part of the program
    parser = parser_for(extension)
    if parser.valid(text):
        return 0, None, None
    r = parser.repair(text)
    return r.cost, r.reason, r.places[0] if r.places else len(text)


def check(files: DataFrame) -> DataFrame:
    """file_id, repo, extension, cost, reason, place, flawed: one row per file with a known extension."""
    extension = F.lower(F.regexp_extract("relative_path", r"\.([A-Za-z]+)$", 1))
    rows = files.select(F.col("file_id").cast("long").alias("file_id"), "repo", extension.alias("extension"), F.col("content").alias("body"))
    rows = rows.where(F.col("extension").isin(*EXTENSIONS) & F.col("body").isNotNull() & F.col("file_id").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [judge_text(e, t) for e, t in zip(b.column("extension").to_pylist(), b.column("body").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("file_id"), b.column("repo"), b.column("extension"), pa.array([g[0] for g in got], pa.int32()),
                    pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.int32()), pa.array([g[0] > 0 for g in got], pa.bool_()),
                ],
                names=["file_id", "repo", "extension", "cost", "reason", "place", "flawed"],
            )

    return rows.mapInArrow(run, DDL).dropDuplicates(["file_id"])


def rates(checked: DataFrame) -> DataFrame:
    """Per repository and language: files, flawed ones, rate, and the reasons."""
    flawed = F.col("flawed").cast("int")
    return checked.groupBy("repo", "extension").agg(
        F.count("*").alias("files"), F.sum(flawed).alias("flawed"), F.avg(flawed).alias("rate"),
        *[F.count_if(F.col("reason") == r).alias(r) for r in ("truncated", "conflict", "mismatch")],
    )

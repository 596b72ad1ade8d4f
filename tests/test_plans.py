"""What plans must look like, and properties of pure functions."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.functions import text as t
from sievework.operators import chunking, graph, retrieval, stats


def plan(df, mode="formatted"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


@pytest.fixture
def chunks(spark, tmp_path):
    rows = [(str(i), "r", f"src/f{i}.py", 1, 2, f"def f{i}():\n    g()", "python", "function", f"f{i}", None) for i in range(20)]
    path = str(tmp_path / "chunks")
    spark.createDataFrame(rows, chunking.CHUNKS).write.parquet(path)
    return spark.read.parquet(path)


def test_filters_reach_the_scan(chunks):
    text = plan(stats.once(chunks.where(t.glob_matches(F.col("file_path"), ["src/**"]) & (F.col("language") == "python"))).select("id"))
    assert "StringStartsWith(file_path,src/)" in text and "EqualTo(language,python)" in text
    assert "ReadSchema: struct<id:string,file_path:string,language:string>" in text


def test_columns_are_pruned(chunks):
    schema = re.search(r"ReadSchema: (.*)", plan(stats.top_directories(chunks, 3))).group(1)
    assert "content" not in schema and "TakeOrderedAndProject" in plan(stats.top_directories(chunks, 3))


def test_dead_code_is_an_anti_join(chunks):
    assert "LeftAnti" in plan(graph.dead_symbols(chunks, graph.call_edges(chunks)))


def test_group_limits_and_no_cartesian_products(chunks, spark):
    q = spark.createDataFrame([(1, "r", "f1 g")], "query_id int, repo string, query string")
    text = plan(retrieval.bm25(chunks, q, 3))
    assert "WindowGroupLimit" in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def glob(pattern, path):
    """The glob rules, spelled out by recursion."""

    def match(p, s):
        if p == "**":
            return True
        if p.startswith("**/"):
            return match(p[3:], s) or any(match(p[3:], s[i + 1 :]) for i, c in enumerate(s) if c == "/")
        if not p:
            return not s
        if p[0] == "*":
            return any(match(p[1:], s[i:]) for i in range(len(s) + 1) if "/" not in s[:i])
        return bool(s) and p[0] == s[0] and match(p[1:], s[1:])

    return match(pattern, path) or bool(pattern) and "*" not in pattern and path.startswith(pattern + "/")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "*", "**/", "/", ".", "["]), min_size=1, max_size=6), st.text(alphabet="ab/.[", max_size=7))
def test_glob_regex_follows_the_rules(parts, path):
    pattern = "".join(parts).removeprefix("./").rstrip("/")
    assert bool(re.match(t.glob_regex(pattern), path)) == glob(pattern, path)


@given(st.text(alphabet="aé\n", max_size=60), st.integers(0, 80))
def test_truncation_keeps_the_budget(text, allowed):
    out = chunking.truncate_to_budget(text, allowed)
    assert len(out.encode()) <= allowed or out == text and len(text.encode()) <= allowed
    assert text.startswith(out.removesuffix("\n[...truncated]"))


@given(st.integers(1, 2000))
def test_windows_cover_all_lines(n):
    w = chunking.windows(n)
    assert w[0][0] == 1 and w[-1][1] == n and all(b[0] == a[1] - 9 for a, b in zip(w, w[1:], strict=False))

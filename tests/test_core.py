import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from sievework.functions import text as t
from sievework.functions import values
from sievework.operators import candidates, chunking, filters, graph, incremental as inc, ranking, retrieval, stats, update
from sievework.plans import catalog
from sievework.sources import files as source
from sievework.sources import index
from sievework.streaming import watch

CHUNK = chunking.CHUNKS


def rows(df, *order):
    return sorted((tuple(r) for r in (df.select(*order) if order else df).collect()), key=repr)


def chunk(i, path="src/a.py", start=1, end=2, content="x", language="python", kind=None, name=None, part=None, repo="r"):
    return (str(i), repo, path, start, end, content, language, kind, name, part)


# ---------------------------------------------------------------- functions
@pytest.mark.parametrize(
    ("pattern", "path", "expected"),
    [
        ("*.py", "a.py", True), ("*.py", "d/a.py", False), ("**/*.py", "a.py", True), ("**/*.py", "d/e/a.py", True), ("src/**", "src/x/y", True), ("**", "any/thing", True),
        ("app/[slug]", "app/[slug]/page.ts", True), ("what?", "what?", True), ("what?", "whats", False), ("app/src", "app/src/foo.ts", True), ("app/src", "app/srcfoo", False),
        ("./app/src/", "app/src/foo.ts", True), ("app\\src", "app/src/foo.ts", True), ("a.b", "axb", False), ("{a,b}", "a", False),
    ],
)
def test_glob(spark, pattern, path, expected):
    df = spark.createDataFrame([(path,)], "file_path string")
    assert df.select(t.glob_matches(F.col("file_path"), [pattern])).first()[0] is expected


def test_identifiers(spark):
    df = spark.createDataFrame([("parseConfig XMLParser get_user_by_id simple ab_c __",)], "content string")
    assert df.select(t.split_identifiers(F.col("content"))).first()[0] == "ab by config get id parse parser user xml"


@pytest.mark.parametrize(
    ("query", "kind"),
    [("", "identifier"), ("parse", "identifier"), ("foo::bar baz", "identifier"), ("how does it parse files", "natural"), ("read file", "identifier"), ("the file of a user", "natural"), ("load big table", "natural"), ("parse_config load_user x", "identifier"), ("where?", "identifier"), ("open file?", "natural")],
)
def test_query_kind(spark, query, kind):
    assert spark.createDataFrame([(query,)], "q string").select(t.query_kind(F.col("q"))).first()[0] == kind


@pytest.mark.parametrize(
    ("path", "language", "cls"),
    [("archive/docs/hotkeys.md", "markdown", "archive"), ("src/snapshot_writer.rs", "rust", "source"), ("tests/a.py", "python", "test"), ("a/tmp/b.c", "c", "runtime"), ("examples/x.go", "go", "example"), ("pkg/Cargo.toml", "toml", "config"), ("vendor/x.c", "c", "generated"), ("x.bin", "unknown", "unknown"), ("tests/snapshots/a.txt", "unknown", "archive")],
)
def test_path_class(spark, path, language, cls):
    assert spark.createDataFrame([(path, language)], "p string, l string").select(t.path_class(F.col("p"), F.col("l"))).first()[0] == cls


def test_minified(spark):
    texts = [("a" * 1200,), ("a\nb\n",), ("\n".join(["x" * 240, "y", "z"]),), ("\n".join(["x" * 240] + ["y"] * 5),), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(texts, "c string").select(t.looks_minified(F.col("c"))).collect()]
    assert got == [True, False, True, False, False, None]


def test_truncate_to_budget():
    assert chunking.truncate_to_budget("abc", 3) == "abc"
    assert chunking.truncate_to_budget("line one\nline two\nline three", 26) == "line one\n[...truncated]"
    assert chunking.truncate_to_budget("ééé" * 10, 5) == "éé"


# ---------------------------------------------------------------- incremental
HASHES = "run_id int, attempt int, window_no int, repo string, file_path string, content_hash string, file_stamp string, recorded_at timestamp, ingested_at timestamp"
RUNS = "run_id int, attempt int, started_at timestamp, finished_at timestamp, status string"


def at(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(minutes=n)


def h(run, path, digest, n=0, attempt=1, repo="r"):
    return (run, attempt, 0, repo, path, digest, None, at(n), at(n + 1))


def run_rows(spark, statuses):
    return spark.createDataFrame([(r, a, at(0), None, s) for r, a, s in statuses], RUNS)


def test_incremental_new_changed_and_kept(spark, tmp_path):
    hashes = spark.createDataFrame(
        [
            h(1, "kept", "AA", 0), h(1, "changed", "BB", 0), h(1, "gone", "CC", 0), h(2, "changed", "XX", 5), h(3, "kept", "sha256:aa", 9), h(3, "kept", "aa", 9), h(3, "changed", "dd", 9), h(3, "changed", "bb", 8),
            h(3, "new", "ee", 9), h(3, None, "ee", 9), h(3, "no digest", None, 9), h(3, "old", "11", 9), h(1, "old", "11", 0), h(2, "old", "22", 5),
        ],
        HASHES,
    )
    runs = run_rows(spark, [(1, 1, "succeeded"), (2, 1, "failed"), (3, 1, "running")])
    path = str(tmp_path / "state")
    inc.write_state(inc.committed_state(hashes, runs, 4), path)
    pending = inc.pending_records(hashes, runs, 4)
    found = inc.changed_files(spark, pending, path)
    assert rows(found, "file_path", "digest") == [("changed", "dd"), ("new", "ee")]
    # applying twice changes nothing the second time, and nothing is skipped or repeated
    assert inc.apply_changes(spark, pending, path) > 0
    assert inc.apply_changes(spark, pending, path) == 0
    assert inc.changed_files(spark, pending, path).count() == 0
    assert rows(inc.read_state(spark, path), "file_path", "digest") == [("changed", "dd"), ("gone", "cc"), ("kept", "aa"), ("new", "ee"), ("old", "11")]


def test_incremental_recovers_from_a_failed_write(spark, tmp_path):
    hashes = spark.createDataFrame([h(1, f"d{i % 7}/f{i}", "a") for i in range(50)] + [h(2, f"d{i % 7}/f{i}", "b", 5) for i in range(20, 50)], HASHES)
    runs = run_rows(spark, [(1, 1, "succeeded"), (2, 1, "running")])
    path = str(tmp_path / "state")
    inc.write_state(inc.committed_state(hashes, runs, 4), path)
    pending = inc.pending_records(hashes, runs, 4)
    cols = list(inc.COLUMNS)
    old = rows(inc.read_state(spark, path), "file_path", "digest")

    def dies(*args):
        raise RuntimeError("killed")

    for step in ("write_partitions", "write_fingerprints", "swap_pointer"):  # killed before each step, the pointer being the last
        with pytest.MonkeyPatch.context() as m:
            m.setattr(inc, step, dies)
            with pytest.raises(RuntimeError):
                inc.apply_changes(spark, pending, path)
        assert rows(inc.read_state(spark, path), "file_path", "digest") == old
        assert inc.changed_files(spark, pending, path).count() == 30
    # killed while partitions are being written: some are there, others are not
    inc.write_partitions(pending.where("part = 0").select(*cols), path, inc.current_version(spark, path) + 1)
    assert rows(inc.read_state(spark, path), "file_path", "digest") == old
    with pytest.MonkeyPatch.context() as m:  # killed after the commit, before the old folders are deleted
        m.setattr(inc, "sweep", dies)
        with pytest.raises(RuntimeError):
            inc.apply_changes(spark, pending, path)
    assert inc.changed_files(spark, pending, path).count() == 0 and inc.apply_changes(spark, pending, path) == 0
    assert inc.read_state(spark, path).where("digest = 'b'").count() == 30
    assert inc.read_state(spark, path).count() == 50
    inc.sweep(spark, path)
    assert inc.read_state(spark, path).count() == 50
    kept = [(p, v) for p in os.listdir(f"{path}/data") if p.startswith("part=") for v in os.listdir(f"{path}/data/{p}") if v.startswith("version=")]
    assert sorted(kept) == sorted((f"part={r.part}", f"version={r.version}") for r in inc.stored_fingerprints(spark, path).collect())


def test_unchanged_partitions_are_not_read(spark, tmp_path):
    hashes = spark.createDataFrame([h(1, f"d{i}/f", "a") for i in range(40)] + [h(2, f"d{i}/f", "b" if i == 3 else "a", 5) for i in range(40)], HASHES)
    runs = run_rows(spark, [(1, 1, "succeeded"), (2, 1, "running")])
    path = str(tmp_path / "state")
    inc.write_state(inc.committed_state(hashes, runs, 16), path)
    pending = inc.pending_records(hashes, runs, 16)
    assert len(inc.changed_partitions(pending, inc.stored_fingerprints(spark, path))) == 1
    found = inc.changed_files(spark, pending, path)
    assert rows(found, "file_path") == [("d3/f",)]
    read = [f for f in found.inputFiles() if "/data/part=" in f]
    assert read and len({f.split("/part=")[1].split("/")[0] for f in read}) == 1


def test_incremental_empty_and_extra_columns(spark, tmp_path):
    empty = spark.createDataFrame([], HASHES).withColumn("part", F.lit("x")).withColumn("digest", F.lit(1))
    runs = run_rows(spark, [(1, 1, "running")])
    path = str(tmp_path / "state")
    inc.write_state(inc.committed_state(empty, runs, 4), path)
    os.makedirs(path, exist_ok=True)
    assert inc.changed_files(spark, inc.pending_records(empty, runs, 4), path).count() == 0
    one = spark.createDataFrame([h(1, "a", "q")], HASHES).withColumn("part", F.lit("x")).withColumn("best", F.lit(1))
    assert inc.changed_files(spark, inc.pending_records(one, runs, 4), path).count() == 1


# ---------------------------------------------------------------- graph and search
def test_calls_dead_code_and_enclosing(spark):
    chunks = spark.createDataFrame(
        [
            chunk(1, start=1, end=4, content="def run():\n    helper(1)\n    self.save(2)\n    if (x):", kind="function", name="run"), chunk(2, start=6, end=8, content="def helper(a):\n    return 1\n", kind="function", name="Helper"),
            chunk(3, start=10, end=12, content="def lonely():\n    raise Boom\n", kind="function", name="lonely"), chunk(4, start=1, end=20, content="class A:", kind="class", name="A"), chunk(5, path="b.py", content=None),
        ],
        CHUNK,
    )
    edges = graph.call_edges(chunks)
    assert rows(edges, "line", "callee", "qualifier", "caller") == [(2, "helper", None, "run"), (3, "save", "self", "run")]
    assert [r.symbol for r in graph.dead_symbols(chunks, edges).orderBy("line").collect()] == ["run", "lonely"]
    points = graph.matches(chunks, r"raise (\w+)").select("repo", "file_path", "line")
    assert rows(graph.enclosing(points, chunks), "line", "symbol_name") == [(11, "lonely")]


def test_structural_patterns(spark):
    content = 'x = os.environ["HOME"]\napp.get("/users", f)\nq = "select a from b"\nclass Dog extends Animal {\nprocess.env.TOKEN'
    c = spark.createDataFrame([chunk(1, content=content)], CHUNK)
    assert rows(graph.matches(c, graph.ENV_READS), "line", "g1") == [(1, "HOME"), (5, "TOKEN")]
    assert rows(graph.matches(c, graph.ROUTES, 2), "g1", "g2") == [("get", "/users")]
    assert graph.matches(c, graph.SQL_SITES).count() == 1
    assert rows(graph.type_relations(c), "owner", "target") == [("Dog", "Animal")]


def test_bm25_prefers_names_and_keeps_to_the_repository(spark):
    c = spark.createDataFrame(
        [chunk(1, content="alpha beta", name="parse_config"), chunk(2, content="parse config somewhere deep in a long text of many words"), chunk(3, content="parse", repo="other"), chunk(4, content=None)], CHUNK
    )
    q = spark.createDataFrame([(1, "r", "parse config"), (2, "r", None), (3, "none", "parse")], "query_id int, repo string, query string")
    got = retrieval.bm25(c, q, 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in got] == [(1, "1"), (1, "2")]


def test_vector_search_and_fusion(spark):
    v = spark.createDataFrame([("a", "r", [1.0, 0.0]), ("b", "r", [0.9, 0.1]), ("c", "r", [0.0, 1.0]), ("d", "r", [1.0]), ("e", "x", [1.0, 0.0])], "id string, repo string, vector array<float>")
    q = spark.createDataFrame([(1, "r", [1.0, 0.0])], "query_id int, repo string, vector array<float>")
    got = retrieval.vector_search(v, q, 2).orderBy("rank").collect()
    assert [(r.id, round(r.score, 3)) for r in got] == [("a", 1.0), ("b", 0.876)]
    lists = spark.createDataFrame([(1, "a", 1, 1.0), (1, "b", 2, 1.0), (1, "b", 1, 1.0), (1, "c", 1, 1.0)], "query_id int, id string, rank int, weight double")
    assert [r.id for r in retrieval.fuse(lists, 3, rrf_k=-1).orderBy("rank").collect()] == ["b", "a", "c"]


def test_diversify_and_coherence(spark):
    pool = spark.createDataFrame([(1, "f", "a", 1, 1.0), (1, "f", "b", 2, 0.9), (1, "g", "c", 3, 0.8)], "query_id int, file string, id string, rank int, score double")
    gained = {r.id: round(r.score, 4) for r in ranking.coherence(pool).collect()}
    assert gained == {"a": 1.4, "b": 0.9, "c": round(0.8 + 0.4 * 0.8 / 1.9, 4)}
    assert [r.id for r in ranking.diversify(pool).orderBy("rank").collect()] == ["a", "c", "b"]


def test_filters(spark):
    c = spark.createDataFrame([chunk(1, kind="Method", name="x"), chunk(2, path="dist/a.js", language="JavaScript"), chunk(3, kind=None, path="docs/x.md", language="markdown")], CHUNK)
    ids = lambda f: [r.id for r in c.where(f.condition()).orderBy("id").collect()]
    assert ids(filters.SearchFilters()) == ["1", "3"]
    assert ids(filters.SearchFilters(include_generated=True)) == ["1", "2", "3"]
    assert ids(filters.SearchFilters(symbol_type="function")) == ["1"]
    assert ids(filters.SearchFilters(scope="docs")) == ["3"]
    assert ids(filters.SearchFilters(exact_paths=())) == []
    assert ids(filters.SearchFilters(language="JAVASCRIPT", include_generated=True, globs=("dist/**",))) == ["2"]


def test_conventions_and_staleness(spark):
    c = spark.createDataFrame([chunk(1, path="a/Cargo.toml"), chunk(2, path="x/MyCargo.toml", repo="q"), chunk(3, path="web/jest.config.js", repo="q"), chunk(4, path="x.github/workflows/y", repo="q")], CHUNK)
    assert rows(stats.conventions(c)) == [("q", "JS test framework"), ("r", "Rust/Cargo project")]
    a = spark.createDataFrame([("r", "x", "1"), ("r", "y", "1"), ("r", "z", "1")], "repo string, file_path string, content_hash string")
    b = spark.createDataFrame([("r", "x", "1"), ("r", "y", "2"), ("r", "w", "1")], "repo string, file_path string, content_hash string")
    assert rows(update.staleness(a, b), "file_path", "change") == [("w", "added"), ("x", "unchanged"), ("y", "modified"), ("z", "deleted")]


# ---------------------------------------------------------------- chunking, sources, streams
def test_chunking():
    py = "import a\n\n# note\ndef f():\n    return 1\n\nclass B:\n    def g(self):\n        pass\n"
    assert [(a, b, k, n) for a, b, k, n, _ in chunking.chunk_text(py, "python", "x.py")] == [(1, 2, "block", None), (3, 5, "function", "f"), (7, 7, "class", "B"), (8, 9, "method", "g")]
    rs = "use a;\n\npub fn f(x: u8) -> u8 {\n    x\n}\n\nimpl B {\n    fn g() {}\n}\n"
    assert [(k, n) for _, _, k, n, _ in chunking.chunk_text(rs, "rust", "x.rs") if n] == [("function", "f"), ("class", "B"), ("method", "g")]
    md = "intro\n# One\ntext\n```\n# no heading\n```\n## Two\nx"
    assert [(a, n) for a, _, _, n, _ in chunking.chunk_text(md, "markdown", "d/x.md")] == [(1, "x.md"), (2, "One"), (7, "Two")]
    assert [(a, b) for a, b, *_ in chunking.chunk_text("x\n" * 120, "haskell", "x.hs")] == [(1, 50), (41, 90), (81, 120)]
    assert chunking.chunk_text("  \n", "python", "x.py") == []
    long = "def f():\n" + "    x = 1\n" * 450
    parts = chunking.chunk_text(long, "python", "x.py")
    assert all(b - a < 200 for a, b, *_ in parts) and [p for *_, p in parts] == [1, 2, 3]
    assert chunking.chunk_text("def broken(:\n  x", "python", "x.py")


def test_discovery(spark, tmp_path):
    root = tmp_path / "tree"
    for name, body in {
        "src/a.py": b"print(1)\n", "src/__init__.py": b"1", "src/b b.py": b"x = '\xff'\n", "build/x.py": b"1", "logs/l.log": b"x", "logs/keep.log": b"x", "empty.py": b"", "bin.dat": b"a\0b", "pic.png": b"x", "big.txt": b"x" * 2000, ".gitignore": b"*.log\n!keep.log\n# c\n",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
    got = {r.relative_path: r for r in source.discover(spark, str(root), max_bytes=1000).collect()}
    assert sorted(got) == [".gitignore", "logs/keep.log", "src/__init__.py", "src/a.py", "src/b b.py"]
    assert got["src/a.py"].language == "python" and "\ufffd" in got["src/b b.py"].content
    why = {p: source.explain_path(spark, str(root), p, max_bytes=1000)[1] for p in ("build/x.py", "logs/l.log", "empty.py", "bin.dat", "pic.png", "big.txt", "nope", "src", "src/a.py")}
    assert why == {"build/x.py": "default exclude", "logs/l.log": "ignored by .gitignore", "empty.py": "empty", "bin.dat": "binary content", "pic.png": "binary extension", "big.txt": "too large", "nope": "missing", "src": "directory", "src/a.py": "indexed"}


def test_publish_and_open(spark, tmp_path):
    root = str(tmp_path / "index")
    tables = {n: spark.createDataFrame([], s) for n, s in index.SCHEMAS.items()}
    first = index.publish(tables, root)
    tables["chunks"] = spark.createDataFrame([chunk(1)], CHUNK)
    assert index.publish(tables, root) != first
    assert index.open_index(spark, root)["chunks"].count() == 1
    with pytest.raises(ValueError):
        index.publish({}, root)
    with index.index_lock(root), pytest.raises(RuntimeError), index.index_lock(root):
        pass
    with pytest.raises(FileNotFoundError):
        index.open_index(spark, str(tmp_path / "none"))


def test_watch(spark, tmp_path):
    src, seen = str(tmp_path / "events"), []
    spark.createDataFrame([("r", "a", "python", "1", False, at(0)), ("r", "a", "python", "2", False, at(1)), ("r", "b", "go", "x", False, at(0))], watch.FILE_EVENTS).write.parquet(src)
    q = watch.watch(spark, src, str(tmp_path / "ckpt"), lambda df, n: seen.append(rows(df, "file_path", "content")), once=True)
    q.awaitTermination(60)
    assert seen == [[("a", "2"), ("b", "x")]]
    q = watch.watch(spark, src, str(tmp_path / "ckpt"), lambda df, n: seen.append(rows(df, "file_path")), once=True)
    q.awaitTermination(60)
    assert len(seen) == 1  # nothing new, nothing repeated


def test_embedding_reuse(spark):
    embed = retrieval.hash_embedding(8)
    texts = spark.createDataFrame([("1", "a b"), ("2", "a b"), ("3", "c")], "id string, text string")
    saved = spark.createDataFrame([("k", [1.0], "m")], "key string, vector array<float>, identity string").limit(0)
    first = update.embed_with_reuse(texts, saved, embed, "m")
    assert first.count() == 3 and first.where("key = sha2('c', 256)").count() == 1
    other = spark.createDataFrame([(first.where("id = '3'").first().key, [9.0], "m"), ("x", [1.0], "old")], "key string, vector array<float>, identity string")
    assert update.embed_with_reuse(texts, other, embed, "m").where("id = '3'").first().vector == [9.0]


def test_queries_and_sql_are_paired():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
    assert catalog.FLAGSHIP in catalog.QUERIES


def test_data_lines_comments_and_patterns():
    data = "  " + ", ".join("0x%02x" % i for i in range(20))
    text = "\n".join(["a = [", *[data] * 5, "]", data, data, "end"])
    assert chunking.collapse_data_lines(text).split("\n") == ["a = [", "[5 lines of data]", "]", data, data, "end"]
    assert chunking.mask_text("x = 1 # os.environ['A']\ny", "python") == "x = 1 " + " " * 17 + "\ny"
    assert chunking.mask_text("a(); /* b\n c */ d", "rust") == "a();     \n      d"
    assert filters.relative_pattern("/w/tree/src/**", "/w/tree/") == "src/**"
    assert filters.relative_pattern("/w/tree", "/w/tree") == "**" and filters.relative_pattern("/w/other", "/w/tree") is None and filters.relative_pattern("src", "/w") == "src"


def test_concept_files_and_seed(spark, tmp_path):
    from sievework.operators import candidates

    c = spark.createDataFrame([chunk(1, path="src/session_cache.py", name="open"), chunk(2, path="src/other.py", name="Cached"), chunk(3, path="a/b/cache.py", name="drop")], CHUNK)
    q = spark.createDataFrame([(1, "r", "session cache"), (2, "r", "Cached")], "query_id int, repo string, query string")
    assert rows(candidates.concept_files(c, q)) == [(1, "1"), (1, "3")]
    tables = {n: spark.createDataFrame([], s) for n, s in index.SCHEMAS.items()}
    tables["chunks"] = c
    index.publish(tables, str(tmp_path / "a"))
    index.seed(str(tmp_path / "a"), str(tmp_path / "b"))
    assert index.open_index(spark, str(tmp_path / "b"))["chunks"].count() == 3


def test_ranking_signals(spark):
    base = dict(repo="r", file_path="src/a.py", language="python", content="x", symbol_type="block", symbol_name=None)
    def scores(query, *changes):
        cols = ["query", *base]
        data = [(query, *{**base, **c}.values()) for c in changes]
        df = spark.createDataFrame(data, "query string, repo string, file_path string, language string, content string, symbol_type string, symbol_name string")
        assert df.columns == cols
        return [r[0] for r in df.select(ranking.prior(F.col("query")) + ranking.boosts(F.col("query"))).collect()]

    plain, test = scores("load settings", {}, {"file_path": "tests/a.py"})
    assert plain > test
    new, old, none = scores("parse v2 header", {"file_path": "src/v2/a.py"}, {"file_path": "src/v1/a.py"}, {})
    assert new > none > old
    fn, cl = scores("function that loads a file", {"symbol_type": "method"}, {"symbol_type": "class"})
    assert fn > cl
    named, other, null = scores("parse_config", {"symbol_name": "parse_config", "content": "def parse_config(): pass"}, {"symbol_name": "other"}, {"content": None})
    assert named > other and null is not None
    root, deep, code = scores("config", {"file_path": "app.toml", "language": "toml"}, {"file_path": "a/b/app.toml", "language": "toml"}, {})
    assert root > deep > code


def test_small_values(spark):
    one = spark.createDataFrame([("parseConfigs", "route", "routing", "a\nbé\nc", 6, "q", " debug ")], "name string, a string, b string, text string, at int, query string, intent string")
    got = one.select(
        values.identifier_stems(F.col("name")).alias("stems"), values.shares_stem(F.col("a"), F.col("b")).alias("stem"), values.shares_stem(F.lit("cat"), F.lit("cat")).alias("short"),
        values.line_of_byte(F.col("text"), F.col("at")).alias("line"), values.line_of_byte(F.col("text"), F.lit(99)).alias("last"), values.byte_of_line(F.col("text"), F.lit(3)).alias("byte"),
        retrieval.with_intent(F.col("query"), F.col("intent")).alias("asked"), retrieval.with_intent(F.col("query"), F.lit(" ")).alias("bare"), values.pooled(F.array(F.array(F.lit(3.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(3.0)))).alias("mean"),
    ).first()
    assert got.stems == ["parse", "config"] and got.stem and not got.short
    assert (got.line, got["last"], got.byte) == (3, 3, 6)
    assert (got.asked, got.bare) == ("intent: debug | q", "q") and [round(x, 6) for x in got["mean"]] == [0.707107, 0.707107]
    assert (candidates.raw_lexical_pool(10), candidates.raw_lexical_pool(10, True), candidates.raw_vector_pool(10, 12), candidates.rerank_depth(50)) == (20, 1010, 12, 50)


def test_ties_of_vector_search(spark):
    v = spark.createDataFrame([("r", f"c{i:02}", [1.0, 0.0] if i else [0.0, 1.0]) for i in range(40)], "repo string, id string, vector array<float>").repartition(7)
    q = spark.createDataFrame([(1, "r", [1.0, 0.0])], "query_id int, repo string, vector array<float>")
    assert [r.id for r in retrieval.vector_search(v, q, 3).orderBy("rank").collect()] == ["c01", "c02", "c03"]


def test_meaning_of_a_question(spark):
    df = spark.createDataFrame([("how do we define header parsing", "src/headers.rs", "rust", "pub fn parse_headers() {}", "parse_headers", "function"), ("how do we define header parsing", "x.rs", "rust", "let a = 1;", None, None)],
        "query string, file_path string, language string, content string, symbol_name string, symbol_type string")
    a, b = (r.m for r in df.select(ranking.meaning(F.col("query"), F.lit("natural")).alias("m")).collect())
    assert a.symbol_word == 0.5 and a.asked_definition == 0.34 and a.overlap > 0 and a.defined_early == 0.3 and a.public > 0
    assert b.symbol_word == b.overlap == b.defined_early == b.asked_definition == 0.0

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.api import Engine
from sievework.functions.render import to_json, to_markdown
from sievework.operators import filters, retrieval, search

TREE = {
    "src/config.py": "import os\n\n\ndef parse_config(path):\n    '''Read the settings.'''\n    root = os.environ['APP_ROOT']\n    return load_file(root, path)\n\n\ndef load_file(root, path):\n    return open(root + path).read()\n",
    "src/server.rs": "use crate::config;\n\npub struct Server { port: u16 }\n\nimpl Server {\n    pub fn start(&self) -> u16 {\n        listen(self.port)\n    }\n}\n\nfn listen(port: u16) -> u16 {\n    port\n}\n\nfn forgotten() {}\n",
    "src/web.js": "class Base {}\nclass Page extends Base {}\napp.get('/users', function users(req) { return render(req); });\n",
    "docs/guide.md": "# Guide\nHow to parse a config.\n\n## More\ntext\n",
    "dist/out.js": "var a=1;",
    "Cargo.toml": "[package]\nname = 'x'\n",
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    tree = tmp_path_factory.mktemp("tree")
    for name, body in TREE.items():
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_text(body)
    e = Engine(spark, str(tmp_path_factory.mktemp("index")))
    e.index(str(tree), "r")
    e.tree = tree
    return e


def test_search_finds_the_symbol_first(engine):
    rows = engine.search(["parse_config", "start server", "forgotten"], "r", 3).collect()
    first = {r.query_id: r.symbol_name for r in rows if r["rank"] == 1}
    assert first[0] == "parse_config" and first[1] in ("start", "Server") and first[2] == "forgotten"
    only = engine.search("parse config", "r", 5, filters.SearchFilters(scope="docs")).collect()
    assert only and {r.file_path for r in only} == {"docs/guide.md"}


def test_filter_first_equals_filtered_result(engine):
    chunks = engine.tables()["chunks"]
    q = engine.spark.createDataFrame([(0, "r", "parse config")], "query_id int, repo string, query string")
    inside = search.search(chunks, q, 50, F.col("language") == "python").select("id").collect()
    assert {r.id.split(":")[0] for r in inside} == {"r/src/config.py"}


def test_graph_verbs(engine):
    assert [r.caller for r in engine.references("load_file").collect()] == ["parse_config"]
    assert {r.callee for r in engine.references("parse_config", calls_of=True).collect()} >= {"load_file"}
    assert [r.symbol for r in engine.dead_code().collect()] == ["parse_config", "start", "forgotten"]
    assert [r.g1 for r in engine.structural("env").collect()] == ["APP_ROOT"]
    assert [(r.g1, r.g2) for r in engine.structural("routes").collect()] == [("get", "/users")]
    assert [r.owner for r in engine.structural("implementations", "base").collect()] == ["Page"]
    assert [r.file_path for r in engine.structural("definitions", "LISTEN").collect()] == ["src/server.rs"]
    with pytest.raises(ValueError):
        engine.structural("routes", "x")
    hit = engine.grep("open\\(", 1).first()
    assert hit.line == 11 and "def load_file" in hit.snippet


def test_overview_and_update(engine):
    o = engine.overview()
    assert {r.language for r in o["languages"].collect()} == {"python", "rust", "javascript", "markdown", "toml"}
    assert engine.health().where("total > 0").count() == 5
    assert engine.update(str(engine.tree), "r") == {"unchanged": 5}
    (engine.tree / "src/config.py").write_text("def parse_config():\n    return 1\n")
    (engine.tree / "src/new.go").write_text("package a\n\nfunc Fresh() {\n}\n")
    (engine.tree / "docs/guide.md").unlink()
    assert engine.update(str(engine.tree), "r") == {"unchanged": 3, "modified": 1, "added": 1, "deleted": 1}
    t = engine.tables()
    assert {r.symbol_name for r in t["chunks"].where("file_path like 'src/%'").collect()} >= {"Fresh", "parse_config"}
    assert t["chunks"].where("symbol_name = 'load_file' or file_path = 'docs/guide.md'").count() == 0
    assert engine.explain_path(str(engine.tree), "dist/out.js") == ("skip", "default exclude")


def test_search_tables_follow_an_update(engine):
    """After an update the stored tables are those that the new chunks give, and a search of them finds what a search of the chunks finds."""
    t = engine.tables()
    fresh = retrieval.search_tables(t["chunks"])
    for name in ("postings", "lengths"):
        cols = fresh[name].columns
        key = lambda r, cols=cols: tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in cols)
        assert sorted(map(key, t[name].collect())) == sorted(map(key, fresh[name].collect()))
    assert {r.id for r in t["vectors"].collect()} == {r.id for r in t["chunks"].collect()}
    q = engine.spark.createDataFrame([(0, "r", "fresh config")], "query_id int, repo string, query string")
    stored = retrieval.score_postings(t["postings"], t["lengths"], q, 5).collect()
    assert stored and [(r.id, round(r.score, 9)) for r in stored] == [(r.id, round(r.score, 9)) for r in retrieval.bm25(t["chunks"], q, 5).collect()]


def test_answers_of_a_model():
    assert search.query_candidates('["a b", "A B", " c "]', 5) == ["a b", "c"]
    assert search.query_candidates('{"rewrites": ["x", "y", "z"]}', 2) == ["x", "y"]
    assert search.query_candidates('Sure:\n```json\n["x"]\n```', 5) == ["x"]
    assert search.query_candidates("no list", 5) == search.query_candidates("[1, 2]", 5) == []


def test_composed_searches(engine):
    chunks = engine.tables()["chunks"]
    fused = search.multi_query(engine.spark, chunks, "r", ["parse config", " Parse  Config ", "listen"], 5).orderBy("rank").collect()
    assert len(fused) == 5 and fused[0].score >= fused[-1].score
    deep = search.deep_search(engine.spark, chunks, "r", "listen", lambda q, hints: 1 / 0, 3).collect()
    assert deep
    found = search.iterative_search(engine.spark, chunks, "r", "server", 4).orderBy("rank").collect()
    assert len({r.id for r in found}) == len(found) <= 4
    assert search.wants_rerank("how is the port chosen") and not search.wants_rerank("src/a.py") and not search.wants_rerank("Server") and search.wants_rerank("Server", intent="x")


def test_rerank_keeps_order_on_failure(spark):
    ranked = spark.createDataFrame([(1, "q", "a", 1, "short"), (1, "q", "b", 2, "a longer document"), (1, "q", "c", 3, "x")], "query_id int, query string, id string, rank int, document string")
    by = lambda f, d=20: [r.id for r in search.rerank(ranked, f, d).orderBy("rank").collect()]
    assert by(lambda q, docs: [len(x) for x in docs]) == ["b", "a", "c"]
    assert by(lambda q, docs: 1 / 0) == ["a", "b", "c"]
    assert by(lambda q, docs: [0.0]) == ["a", "b", "c"]
    assert by(lambda q, docs: [len(x) for x in docs], 1) == ["a", "b", "c"]


def test_rendering():
    rows = [{"file_path": f"f{i}", "line_start": 1, "line_end": 2, "content": "line one\n" * 20, "language": "python", "symbol_name": None, "score": 1.0} for i in range(3)]
    assert len(json.loads(to_json(rows))) == 3
    assert len(json.loads(to_json(rows, 700))) < 3
    one = json.loads(to_json(rows, 250))
    assert len(one) == 1 and one[0]["content"].endswith("[...truncated]")
    assert to_json(rows, 20) == "[]"
    shown = to_markdown(rows, 100)
    assert shown.startswith("### f0:1-2") and "[...truncated]" in shown and shown.count("line one") < 12


def test_numbered_chunks_are_fused_without_shuffling_lists(spark, monkeypatch):
    # enough equal texts that ties decide, more queries than a block holds, and a repository without queries
    words = ("read", "config", "parse", "token", "write", "page")
    texts = [" ".join(words[(i * k) % 6] for k in range(1, 4 + i % 3)) for i in range(120)]
    rows = [(f"r{i % 3}", f"r{i % 3}/f{i:03}:0", i, f"src/{words[i % 6]}_{i % 7}.py", words[i % 5], x) for i, x in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "repo string, id string, no long, file_path string, symbol_name string, content string")
    asked = ["read config", "src/parse_3.py", "how to write a page", "token", "", None, "nothing here", "parse token read"]
    q = spark.createDataFrame([(i, f"r{i % 2}" if i < 15 else None, asked[i % 8]) for i in range(16)], "query_id int, repo string, query string")
    want = {(r.query_id, r.id): (r.rank, round(r.score, 9)) for r in retrieval.hybrid(chunks, q, 12, width=F.col("query_id") + 1).collect()}

    def kept_in_arrays(*_):
        raise AssertionError("lists of all queries are gathered")

    monkeypatch.setattr(retrieval, "vector_search", kept_in_arrays)
    monkeypatch.setattr(retrieval, "FUSED_BLOCK", 3)
    monkeypatch.setattr(retrieval, "score_postings", kept_in_arrays)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = retrieval.hybrid(chunks.drop("id").withColumnRenamed("no", "id"), q, 12, width=F.col("query_id") + 1).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    ids = {r[2]: r[1] for r in rows}
    assert {(r.query_id, ids[r.id]): (r.rank, round(r.score, 9)) for r in found} == want and len(found) == len(want) > 100


def test_best_rows_hold_no_more_than_is_wanted():
    rng = np.random.default_rng(0)
    best = retrieval._Best(np.array([3, 750]))
    key, ids = rng.integers(0, 50, 600_000).astype(float), rng.permutation(600_000)
    q = rng.integers(0, 2, 600_000)
    for a in range(0, 600_000, 100_000):
        best.add(q[a : a + 100_000], key[a : a + 100_000], ids[a : a + 100_000])
        assert sum(len(x[0]) for x in best.rows) <= 350_753
    got_q, got, place = best.ranked()
    for n, most in ((0, 3), (1, 750)):
        own = np.flatnonzero(q == n)
        assert got[got_q == n].tolist() == ids[own[np.lexsort((ids[own], key[own]))]][:most].tolist()
        assert place[got_q == n].tolist() == list(range(most))

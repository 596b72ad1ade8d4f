"""Operators for training data against brute force, and on null, empty, long, tied and repeated input."""

import datetime as dt
import heapq
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.llm import handwritten, leakage, mixing, neighbours, percentiles, splitting, truncation
from sievework.llm import shingles as sh
from sievework.llm.syntax import operator as syntax
from sievework.llm.syntax.brackets import pairing
from sievework.llm.syntax.parser import parser_for
from sievework.llm.syntax.rules import Grammar


# ---------------------------------------------------------------- 1 percentiles
def test_percentiles_match_brute_force(spark):
    rng = random.Random(1)
    data = [("hot", None, rng.lognormvariate(3, 2)) for _ in range(3000)] + [("few", "d", float(v)) for v in (5, 1, 3, 3)] + [("one", "d", 7.0), (None, "d", 2.0), (None, "d", 4.0)]
    data += [("hot", None, None), ("hot", None, float("nan")), ("none", "d", None)]
    df = spark.createDataFrame(data, "v string, at string, n double").repartition(7)
    ps = (0.0, 0.25, 0.5, 0.99, 1.0)
    out = percentiles.exact_percentiles(df.withColumnsRenamed({"n": "value"}), ["v", "at"], "value", ps).collect()
    got = {(r.v, r["at"]): r for r in out}
    groups = {}
    for a, b, x in data:
        if x is not None and not math.isnan(x):
            groups.setdefault((a, b), []).append(x)
    assert set(got) == set(groups)
    for k, xs in groups.items():
        assert got[k].n == len(xs)
        for p in ps:
            assert got[k][percentiles.name_of(p)] == pytest.approx(float(np.quantile(xs, p)), rel=1e-12)


def test_percentiles_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, x double, part long, offset long")
    assert percentiles.exact_percentiles(empty, ["g"], "x", (0.5,)).collect() == []
    parts = percentiles.partial_counts(empty, ["g"], "x", 0.01)
    assert percentiles.combined_percentiles(parts, ["g"], (0.5,), 0.01).collect() == []


def test_partial_counts_combine_within_the_error(spark):
    rng = random.Random(2)
    data = [("g", d, rng.choice([-1, 1]) * rng.lognormvariate(0, 3)) for d in range(5) for _ in range(400)] + [("g", 0, 0.0), ("g", 1, float("inf")), ("g", 1, None)]
    df = spark.createDataFrame(data, "g string, day int, x double")
    error = 0.01
    days = [percentiles.partial_counts(df.where(f"day = {d}"), ["g"], "x", error) for d in range(5)]
    union = days[0]
    for d in days[1:]:
        union = union.unionByName(d)
    got = percentiles.combined_percentiles(union, ["g"], (0.1, 0.5, 0.9), error).first()
    xs = sorted(x for _, _, x in data if x is not None and math.isfinite(x))
    for p in (0.1, 0.5, 0.9):
        true = xs[math.floor(p * (len(xs) - 1))]
        assert abs(got[percentiles.name_of(p)] - true) <= error * abs(true) + 1e-9


# ---------------------------------------------------------------- 2 splitting
@given(st.lists(st.integers(0, 9), min_size=1, max_size=60), st.data())
def test_range_maximum(values, data):
    lo = data.draw(st.integers(0, len(values) - 1))
    hi = data.draw(st.integers(lo, len(values) - 1))
    best = max(range(lo, hi + 1), key=lambda i: (values[i], i))
    assert splitting.SparseMax(np.array(values)).query(lo, hi) == best


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab {};\n\té", max_size=400), st.integers(1, 12), st.integers(4, 60), st.integers(0, 5))
def test_pieces_keep_all_text_within_limits(text, lines, size, overlap):
    limits = splitting.Limits(lines=lines, bytes=size, overlap=overlap)
    pieces = splitting.split(text, limits)
    for a, b, body in pieces:
        assert len(body.encode()) <= size and b - a + 1 <= lines
    # consecutive pieces leave nothing out: put together with overlaps removed they give the text back
    joined = pieces[0][2]
    for (_, end, _), (start, _, body) in zip(pieces, pieces[1:], strict=False):
        assert start <= end + 1
        k = next(k for k in range(min(len(joined), len(body)), -1, -1) if joined.endswith(body[:k]) or k == 0)
        joined += body[k:]
    squeeze = lambda s: s.replace("\n", "")
    assert len(squeeze(joined)) <= len(squeeze(text))
    assert set(squeeze(text)) == set(squeeze("".join(p[2] for p in pieces)))


def test_cuts_lie_at_natural_boundaries_with_overlap():
    text = "\n".join(f"def f{i}():\n    a = {i}\n    b = 2\n    return a\n" for i in range(60))
    pieces = splitting.split(text, splitting.Limits(lines=50, bytes=10_000, overlap=3))
    assert len(pieces) > 3
    lines = text.split("\n")
    for (_, e, _), (s, _, body) in zip(pieces, pieces[1:], strict=False):
        assert e - s + 1 == 3 and body.split("\n")[:3] == lines[s - 1 : s + 2]
        assert lines[e - 1] == "" and lines[e].startswith("def")
    rebuilt = lines[: pieces[0][1]]
    for _, e, _ in pieces[1:]:
        rebuilt += lines[len(rebuilt) : e]
    assert rebuilt == lines[:-1]  # the final line feed starts no line


def test_one_huge_line_and_null():
    assert splitting.split(None) == []
    assert splitting.split("") == [(1, 1, "")]
    pieces = splitting.split("word " * 20_000, splitting.Limits(bytes=1000))
    assert all(len(p[2].encode()) <= 1000 for p in pieces) and all(p[2].endswith(" ") for p in pieces)
    assert splitting.split_range(1, 0, None) == []
    ranges = splitting.split_range(11, 610, None)
    assert ranges[0][0] == 11 and ranges[-1][1] == 610 and all(b - a < 200 for a, b in ranges)
    assert all(y[0] == x[1] - 9 for x, y in zip(ranges, ranges[1:], strict=False))


# ---------------------------------------------------------------- 3 similar vectors
VEC = "rowid long, database_id string, chunk_id string, vector array<float>, tombstoned boolean, body string"
MAN = "version int, database_id string, dim int, generation long"


def vectors(spark, x, db="d", start=1, dead=()):
    return [(start + i, db, "c", [float(v) for v in row], (start + i) in dead, "clash") for i, row in enumerate(x)]


def test_similar_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 32))
    near = np.concatenate([base[:60] + 0.1 * rng.standard_normal((60, 32)) for _ in range(3)])
    x = np.concatenate([base, near * rng.uniform(0.1, 9, (180, 1))])
    rows = vectors(spark, x)
    rows += [rows[0], rows[5], (9001, "d", "c", None, False, ""), (9002, "d", "c", [0.0] * 32, False, ""), (9003, "d", "c", [float("nan")] * 32, None, ""), (9004, "d", "c", [1.0], None, ""), (9005, "x", "c", [1.0] * 32, None, ""), (9006, "d", "c", rows[0][3], True, "")]
    man = spark.createDataFrame([(2, "d", 32, 1)], MAN)
    got = neighbours.top_similar(spark.createDataFrame(rows, VEC), man, 5, 0.9, recall=0.99)
    pairs = {(min(r.rowid, r.other), max(r.rowid, r.other)) for r in got.collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    true = set()
    for i in range(len(s)):
        for j in np.argsort(-s[i], kind="stable")[:5]:
            if s[i, j] >= 0.9:
                true.add((min(i, j) + 1, max(i, j) + 1))
    assert pairs <= true and len(pairs) >= 0.97 * len(true) > 100


def test_copies_of_one_vector(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([np.tile(rng.standard_normal(16), (40, 1)), rng.standard_normal((40, 16))])
    man = spark.createDataFrame([(2, "d", 16, 1)], MAN)
    got = neighbours.top_similar(spark.createDataFrame(vectors(spark, x, dead={1}), VEC), man, 5, 0.9).collect()
    assert {r.rowid for r in got} == set(range(2, 41))
    by = {}
    for r in got:
        by.setdefault(r.rowid, []).append(r.other)
    assert all(len(v) == 5 for v in by.values()) and sorted(by[2]) == [3, 4, 5, 6, 7] and sorted(by[40]) == [2, 3, 4, 5, 6]


def test_nearest_reaches_the_stated_recall(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 48))
    live = neighbours.live_vectors(spark.createDataFrame(vectors(spark, x), VEC), spark.createDataFrame([(2, "d", 48, 1)], MAN)).repartition(5)
    got = {}
    for r in neighbours.nearest(live.where("rowid % 20 = 0"), live, 5).collect():
        got.setdefault(r.rowid, set()).add(r.other)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = total = 0
    for q, found in got.items():
        s = u @ u[q - 1]
        s[q - 1] = -2
        best = set((np.argsort(-s)[:5] + 1).tolist())
        hit, total = hit + len(best & found), total + 5
    assert len(got) == 150 and hit / total >= 0.95


@pytest.mark.parametrize("dim", [48, 64, 128])
def test_codes_choose_what_is_compared(dim):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((8000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[:50]
    at, sims, compared = neighbours.search_block(q, x, 5, np.arange(50)[:, None] == np.arange(8000)[None, :])
    s = q @ x.T
    s[np.arange(50), np.arange(50)] = -2
    best = np.sort(s, axis=1)[:, -5:][:, ::-1]
    assert compared < 0.1 * s.size
    assert (np.abs(sims - best) < 1e-9).mean() >= 0.95


def test_ties_go_to_the_lower_row(spark):
    rng = np.random.default_rng(7)
    one = rng.standard_normal(16)
    x = np.concatenate([rng.standard_normal((30, 16)), np.stack([one * (1 + i) for i in range(50)])])
    man = spark.createDataFrame([(2, "d", 16, 1)], MAN)
    live = neighbours.live_vectors(spark.createDataFrame(vectors(spark, x), VEC), man).repartition(4)
    got = {}
    for r in neighbours.nearest(live.where("rowid % 20 = 0"), live, 5).orderBy("place").collect():
        got.setdefault(r.rowid, []).append(r.other)
    assert got[60] == got[80] == [31, 32, 33, 34, 35] and got[40] == [31, 32, 33, 34, 35]
    assert neighbours.search_block(x[30:31] / np.linalg.norm(one), x[30:] / np.linalg.norm(x[30:], axis=1, keepdims=True), 5)[0].tolist() == [[0, 1, 2, 3, 4]]


def test_hot_family_is_split(spark, monkeypatch):
    """A bucket that holds a family is neither compared all with all nor kept in one task; near pairs are found all the same."""
    rng = np.random.default_rng(8)
    family = rng.standard_normal(64) + 0.02 * rng.standard_normal((1000, 64))
    twins = family[:100] + 0.002 * rng.standard_normal((100, 64))
    x = np.concatenate([family, twins])
    monkeypatch.setattr(neighbours, "BLOCK_ENTRIES", 300)
    compared = []
    ok = neighbours.estimate_ok
    monkeypatch.setattr(neighbours, "estimate_ok", lambda a, b, c: compared.append(len(a)) or ok(a, b, c))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    e = np.empty(len(x), neighbours.entry(1))
    e["code"], f = neighbours.encode(u, 0)
    e["key"], e["row"], e["f"] = 7, np.arange(len(x)), np.rint(f / neighbours.F_STEP)
    neighbours.meeting_pairs(e, 0.9)
    assert sum(compared) <= len(x) * neighbours.WINDOW
    got = neighbours.top_similar(spark.createDataFrame(vectors(spark, x), VEC), spark.createDataFrame([(2, "d", 64, 1)], MAN), 5, 0.9)
    first = {r.rowid: r.other for r in got.where("place = 1").collect()}
    assert len(first) == len(x) and sum(first[i + 1] == 1001 + i for i in range(100)) >= 90


def test_families_of_equal_distances_are_whole(spark, monkeypatch):
    """All members of large buckets get their nearest, in a family whose members are all about equally far from each other, too."""
    rng = np.random.default_rng(9)
    families = [c + 0.12 * rng.standard_normal((n, 32)) for c, n in zip(rng.standard_normal((3, 32)), (900, 500, 300), strict=True)]
    x = np.concatenate([*families, rng.standard_normal((200, 32))]).astype(np.float32).astype(float)
    monkeypatch.setattr(neighbours, "HOT_CELL", 100, raising=False)
    monkeypatch.setattr(neighbours, "BLOCK_ENTRIES", 700)
    got = neighbours.top_similar(spark.createDataFrame(vectors(spark, x), VEC), spark.createDataFrame([(2, "d", 32, 1)], MAN), 5, 0.9)
    found = {(r.rowid, r.other) for r in got.collect()}
    s = x @ x.T / np.linalg.norm(x, axis=1) / np.linalg.norm(x, axis=1)[:, None]
    np.fill_diagonal(s, -2)
    true = {(i + 1, int(j) + 1) for i in range(len(s)) for j in np.argsort(-s[i], kind="stable")[:5] if s[i, j] >= 0.9}
    assert found <= true and len(found) >= 0.999 * len(true) > 8000


def test_no_vectors(spark):
    man = spark.createDataFrame([(2, "d", 16, 1)], MAN)
    assert neighbours.top_similar(spark.createDataFrame([], VEC), man, 5, 0.9).collect() == []
    live = neighbours.live_vectors(spark.createDataFrame([], VEC), man)
    assert neighbours.nearest(live, live, 5).collect() == []


# ---------------------------------------------------------------- 5 hand-written source
FILES = "file_id long, repo string, absolute_path string, relative_path string, size long, language string, content string, discovered_at timestamp, sig string"


def body(seed, lines=40):
    rng = random.Random(seed)
    w = lambda: rng.choice("alpha beta gamma delta omega sigma kappa theta lambda zeta".split()) + str(rng.randint(0, 999))
    return "\n".join(f"def {w()}(x):\n    {w()} = {w()}({rng.randint(0, 9999)}, '{w()}')\n    return {w()} + {rng.randint(0, 999)}" for _ in range(lines // 3))


def test_kinds_of_files(spark):
    lib = body(1)
    texts = {
        1: ("a", "src/x.py", body(2)), 2: ("a", "src/y.py", "# Code generated by foogen; DO NOT EDIT.\n" + body(3)), 3: ("a", "src/z.py", "# Writes the banner 'do not edit' on top of every file.\n" + body(4)),
        4: ("a", "lib/copy.py", lib), 5: ("b", "other/place.py", "# a new first line\n" + lib.replace("\n    ", "\n  ")), 6: ("c", "vendor/q/w.py", body(5)), 7: ("a", "src/vendor_api/w.py", body(6)),
        8: ("a", "data.py", "D = [\n" + ",\n".join("0x%02x" % (i % 256) for i in range(300)) + "]\n"), 9: ("a", "web/app.js", "a=b(1);" * 500), 10: ("a", "src/own.py", "# Copyright (c) 2024 the a contributors.\n" + body(7)),
        11: ("b", "src/own.py", "# Copyright (c) 2024 the a contributors.\n" + body(7)), 12: ("a", "big.json", "[" + ",".join(map(str, range(500))) + "]"), 13: ("a", "n.py", None), 14: ("a", None, ""), 15: ("a", "tab.py", 'NOTES = {\n' + "\n".join(f'  "k{i}": "some words for {i}",' for i in range(60)) + "\n}\n" + body(8)),
        16: ("a", "g.pb.go", "package a\n"), 17: ("a", "src/long.py", body(9, 3000)),
    }
    rows = [(i, r, "", p, None, None, c, dt.datetime(2025, 1, 1), "clash") for i, (r, p, c) in texts.items()]
    judged = handwritten.judge(spark.createDataFrame(rows + rows[:4], FILES).repartition(3))
    flags = {r.file_id: "".join(k[0] for k in ("generated", "minified", "vendored", "blob") if r[k]) for r in judged.collect()}
    assert flags == {1: "", 2: "g", 3: "", 4: "v", 5: "v", 6: "v", 7: "", 8: "b", 9: "m", 10: "", 11: "v", 12: "", 13: "", 14: "", 15: "", 16: "g", 17: ""}
    assert handwritten.found(handwritten.judge(spark.createDataFrame([], FILES))).collect() == []


@pytest.mark.parametrize("most", [None, 4])
def test_links_beside_the_lowest_file(spark, most):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**32, sh.BINS, dtype=np.uint32)
    rows = []
    for g in range(3):  # below SIMILAR of the lowest file and of each other's group
        other = base.copy()
        other[10 + 30 * g : 40 + 30 * g] = rng.integers(0, 2**32, 30, dtype=np.uint32)
        for k in range(4):
            near = other.copy()
            near[110 + k] += 1
            rows.append((1 + 10 * g + k, 5, sh.low_bytes(np.stack([near, near])).tobytes()))
    rows.append((0, 5, sh.low_bytes(np.stack([base, base])).tobytes()))
    df = spark.createDataFrame(rows, "file_id long, key long, sig binary").repartition(3)
    links = handwritten.links_of(df.select("file_id", "key"), df.select("file_id", "sig"), most)
    got = {r.id: r.label for r in handwritten.clusters(links).collect()}
    assert got == {i: 10 * (i // 10) + 1 for i in (1, 2, 3, 4, 11, 12, 13, 14, 21, 22, 23, 24)}


def test_markup_is_compared_and_saved_pages_are_not(spark):
    php, page = "<?php\n" + body(31, 90), "<!DOCTYPE html>\n<html>\n" + body(32, 90)
    rows = [(1, "a", "x.php", php), (2, "b", "y.php", php + "\n$z = 1;\n"), (3, "a", "x.js", page), (4, "b", "y.js", page + "\n<p>z</p>\n")]
    rows = [(i, r, "/x/" + p, p, None, None, c, None, None) for i, r, p, c in rows]
    assert {r.file_id for r in handwritten.found(handwritten.judge(spark.createDataFrame(rows, FILES))).collect()} == {1, 2}


def test_declarations_anywhere():
    code = body(1, 300)
    says = lambda text: handwritten.declared(text, "a")[:2]
    assert says(code) == (False, False)
    assert says(code + "\n# Code generated by foogen; DO NOT EDIT.\n") == (True, False)
    assert says("# line of a licence\n" * 200 + "# @generated from x.schema\n" + code) == (True, False)
    assert says("/*\n" + "a licence\n" * 600 + " * This file was generated by x\n*/\n" + code) == (True, False)
    assert says(code + "\n\n# Code generated by foogen\n\n" + code) == (True, False)
    assert says(code + "\n/*\n * @generated from x.schema\n */\n") == (True, False)
    assert says(code + "\n// Vendored from upstream\n") == (False, True)
    for mention in ('\nT = """\n\n# Code generated by foogen\n\n"""\n', "\n    # do not edit while it is open\n    x = 1\n", "\n# generated by the clock\nx = 1\n", "\nx = 1  # @generated is a word\n"):
        assert says(code + mention + code) == (False, False)


def test_families_that_declare_nothing(spark):
    def accessors(name, n):
        return "".join(f"export function get{name}{i:03}(buf) {{\n  return buf.slice({4 * i}, {4 * i + 4});\n}}\n\n" for i in range(n))

    def handler(name):  # no form recurs within a file, all recur in its fellows
        rng = random.Random(7)
        ops = "+ - * / % & | ^ < >".split()
        return "\n".join(f"let {name}{i} = {name}({rng.randint(0, 999)} {rng.choice(ops)} {rng.randint(0, 999)}) {rng.choice(ops)} {name}[{rng.randint(0, 99)}];" for i in range(40))

    table = "".join(f"{w}_{i:X} = {i}\n" for i, w in enumerate(["GLYPH_CARRY", "GLYPH_STRIP"] * 60, 465))
    short = "import {{ {0}Relay }} from './relay';\nclass {0} {{\n  constructor(raw) {{\n    this.a = raw.{0};\n    this.b = raw.{0}Item;\n    this.c = raw.{0}Part;\n    this.d = raw.{0}Rest;\n  }}\n}}\n" * 2
    rows = [(1, "a", "src/x.js", accessors("Ranker", 60)), (2, "b", "src/y.ts", accessors("Mesh", 70)), (3, "c", "src/z.py", table)]
    rows += [(10 + i, "d", f"src/h{i}.js", handler(w)) for i, w in enumerate(("alpha", "beta", "gamma"))] + [(20, "e", "src/h.js", handler("delta"))]
    rows += [(30 + i, "f", f"src/s{i}.js", short.format(w)) for i, w in enumerate(("Alpha", "Beta", "Gamma"))]
    rows = [(i, r, "/x/" + p, p, None, None, c, None, None) for i, r, p, c in rows]
    got = {r.file_id for r in handwritten.judge(spark.createDataFrame(rows, FILES)).where("generated").collect()}
    assert got == {1, 2, 3, 10, 11, 12}
    assert handwritten.found(handwritten.judge(spark.createDataFrame(rows[-4:], FILES))).collect() == []


def test_tokens_and_signatures_match_plain_python():
    import re

    texts = ["if (abc1 == 22) { x.y(z); }", "", "ünï = 5", "a b c"]
    raw = [x.encode() for x in texts]
    off = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    buf = np.frombuffer(b"".join(raw), np.uint8)
    t = sh.tokenize(buf, off)
    got = [[bytes(buf[s : s + n]).decode() for s, n, k in zip(t.start, t.length, t.text, strict=True) if k == i] for i in range(4)]
    assert got == [re.findall(r"\w+|[^\w\s]", x) for x in texts]
    assert sh.masked(t)[t.text == 3].tolist() == [1, 1, 1]
    # agreement of signatures estimates the Jaccard similarity
    rng = random.Random(1)
    a = [f"w{rng.randint(0, 10**6)}" for _ in range(600)]
    b = a[:500] + [f"v{rng.randint(0, 10**6)}" for _ in range(100)]
    raw = [" ".join(x).encode() for x in (a, b)]
    off = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    t = sh.tokenize(np.frombuffer(b"".join(raw), np.uint8), off)
    sig = sh.signatures(*sh.shingle(t.hash, t.text), 2)
    sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b)]
    assert abs((sig[0] == sig[1]).mean() - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.15


def test_cluster_labels_follow_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 60)], "low long, high long")
    got = {r.id: r.label for r in handwritten.clusters(links).collect()}
    assert all(got[i] == 1 for i in range(1, 31)) and got[60] == got[50] == 50


# ---------------------------------------------------------------- 6 syntax
VALID = {
    "py": "import a\n@d\nclass B(C, k=1):\n    '''x'''\n    async def f(self, *, y: int = 2, **kw) -> None:\n        with a as b, c:\n            z = [i for i in x if i] + {**k}[1:2, ::3]\n        try:\n            pass\n        except (E, F) as e:\n            raise G from e\n        else: return lambda q: q\n        finally:\n            x = y if z else w; del q\n",
    "json": '{"a": [1, -2.5e3, true, null, {}], "b\\n": ""}',
    "go": 'package a\n\nimport (\n\t"x"\n\ty "z"\n)\n\ntype T struct {\n\tA, B int\n\t*C\n}\n\nfunc (t *T) F(a int, b ...string) (int, error) {\n\tif x := f(); x > 0 {\n\t\treturn 1, nil\n\t} else if y {\n\t}\n\tfor i := 0; i < 3; i++ {\n\t}\n\tfor k, v := range m {\n\t}\n\tgo func() { x <- 1 }()\n\tswitch t := a.(type) {\n\tcase int, string:\n\t\tb = T{A: 1}\n\tdefault:\n\t}\n\treturn []int{1, 2}[0], nil\n}\n',
    "rs": "use a::{b, c as d};\n#[derive(Debug)]\npub struct S<T: X> { pub a: Vec<T>, b: &'static str }\nimpl<T> S<T> where T: X {\n  pub fn f(&mut self, x: Option<u8>) -> Result<(), E> {\n    let v = x.map(|y| y + 1)?;\n    if let Some(z) = v { return Err(E::new(\"q\")); } else { loop { break; } }\n    match v { Some(1..=3) | None => 1, S { a, .. } if a => { } _ => vec![1; 2], };\n    for i in 0..n { println!(\"{}\", i); }\n    Ok(())\n  }\n}\nenum Q { A, B(u8), C { x: u8 } }\n",
    "java": 'package a.b;\nimport java.util.*;\n/** d */ @X(1) public class A<T> extends B<T> implements C, D {\n  private static final int[] X = {1, 2};\n  @Override public <T> List<Map<T, int[]>> f(final T t, int... n) throws E, F {\n    for (int i = 0, j = 1; i < n; i++) { if (a) b(); else c(); }\n    for (var x : y) { try (R r = q()) { } catch (E | F e) { } finally { } }\n    int z = (int) q ? a -> b : new A<>() { void g() {} };\n    switch (x) { case 1: break; default: throw new E("("); }\n    do { x++; } while (x < 3);\n    return s::new;\n  }\n}\nenum E { A(1), B; int x; }\n',
    "js": "import a, { b as c } from 'x';\nexport default class A extends B {\n  static x = 1\n  async *f(a, { b }, ...c) { return a?.b ?? `t${c}` }\n  get y() { return this.#z; }\n}\nconst f = async (x) => ({ ...x, [k]: 1, g() {} })\nfor (const [a, b] of c) if (a) b(); else { c() }\nlabel: while (1) { switch (x) { case 1: case 2: y(); break; default: z() } }\ntry { a() } catch { b() } finally { c() }\nlet r = /[/]x/g.test(s), q = !function () {}();\n",
    "ts": "import type { A } from './a';\nexport interface B<T> extends C<T> { a?: string; readonly b: number[]; f(x: T): void; [k: string]: any }\ntype X = { [K in keyof T]?: T[K] } | 'a' | ((x: number) => void);\nexport const f = <T,>(x: T, y?: Map<string, number>): x is T => x as unknown as T;\nabstract class D<T> implements B<T> { private x: number = 1; constructor(public a: string) { super(); } get y(): T { return this.x! } }\nexport enum E { A = 1, B }\ndeclare module 'm' { export function g(x: any): void; }\n",
    "c": '#include <stdio.h>\n#define X(a) \\\n  (a + 1)\ntypedef struct node { int a; struct node *next; } node_t;\nstatic const char *names[] = { "a", "b" };\nunsigned long f(const char *s, int (*cb)(void *), ...);\nint main(int argc, char **argv) {\n  for (size_t i = 0; i < 3; i++) { if (x) goto end; else y = z ? 1 : 2; }\n  do { p->a = (int) *q++; } while (a);\n  switch (x) { case 1: break; default: return -1; }\nend:\n  printf("%d (\\n", sizeof(int));\n  return 0;\n}\nenum { A, B = 2 };\n',
}


@pytest.mark.parametrize("language", sorted(VALID))
def test_valid_files_cost_nothing(language):
    assert syntax.judge_text(language, VALID[language]) == (0, None, None)
    assert syntax.judge_text(language, VALID[language].replace("\n", "\r\n")) == (0, None, None)


@pytest.mark.parametrize("language", sorted(VALID))
def test_damaged_files_are_flagged(language):
    text = VALID[language]
    lines = text.split("\n")
    half = "\n".join(lines[: len(lines) * 2 // 3])[:-4] if language != "json" else text[:20]
    cost, reason, _ = syntax.judge_text(language, half + " (")
    assert cost > 0 and reason is not None
    if language != "json":
        merge = "\n".join(["<<<<<<< HEAD", lines[0], "=======", lines[0], ">>>>>>> other", *lines])
        assert syntax.judge_text(language, merge)[:2][1] == "conflict"
    for other in sorted(VALID):
        if other != language and (language, other) not in {("ts", "js"), ("js", "json"), ("ts", "json"), ("py", "json")}:
            assert syntax.judge_text(language, VALID[other])[0] > 0, other
    assert syntax.judge_text(language, "<!doctype html>\n<html><body>Bad gateway, it's gone</body></html>\n")[0] > 0
    assert syntax.judge_text(language, "Some words (of prose) follow here, and that's all.\n")[0] > 0


@pytest.mark.parametrize(
    ("language", "text"),
    [
        ("json", '{"a": {"b": [\n<<<<<<< x\n1,\n=======\n2,\n>>>>>>> y\n3]}}'), ("java", "class A { int f() { if (a) { b();\n=======\n c();\n>>>>>>> y\n } return 1; } }"), ("js", "f(() => { if (a) { b(1 2); } });"),
        ("go", "package a\nfunc f() {\n\tif x {\n<<<<<<< HEAD\n\t\ty()\n=======\n>>>>>>> z\n\t}\n}\n"), ("py", "x = [f(1 2)]\n"), ("c", "int f() { while (1) { if (x) { y(; } } }"), ("rs", "fn f() { loop { if x { y z; } } }"), ("ts", "class A { f() { if (a) { let b c; } } }"),
    ],
)
def test_flaws_deep_inside_are_found(language, text):
    assert syntax.judge_text(language, text)[0] > 0


def test_byte_order_marks_and_interpreter_lines():
    assert syntax.judge_text("js", "\ufeff#!/usr/bin/env node\nf();\n")[0] == 0
    assert syntax.judge_text("ts", "#!/usr/bin/env node\nlet x: number = 1;\n")[0] == 0
    assert syntax.judge_text("rs", "#![allow(a)]\nfn f() {}\n")[0] == 0
    assert syntax.judge_text("json", "\ufeff{}")[0] > 0


def test_markers_in_comments_are_no_errors():
    assert syntax.judge_text("js", "/** x\n * <<<<<<< left\n=======\n * y\n>>>>>>> right */\nf();\n")[0] == 0
    assert syntax.judge_text("py", '"""\n<<<<<<< a\n=======\n"""\n')[0] == 0


def test_least_cost_matches_brute_force():
    g = Grammar("t")
    g.declare("if", "", {"(": "x", "[": "x", "{": "x"})
    g.macros = {"E": "a ( '+' a )*"}
    rule = g.rule("if E ';' | E ( ';' E )*")
    accept = rule.accepts
    symbols = ["a", "+", ";", g.keywords["if"]]

    def brute(text):
        seen, layer, cost = {text}, {text}, 0
        while True:
            if any(accept(x) for x in layer):
                return cost
            nxt = set()
            for x in layer:
                for i in range(len(x) + 1):
                    nxt |= {x[:i] + c + x[i:] for c in symbols}
                    if i < len(x):
                        nxt |= {x[:i] + x[i + 1 :]} | {x[:i] + c + x[i + 1 :] for c in symbols}
            layer, cost = nxt - seen, cost + 1
            seen |= layer

    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice(symbols) for _ in range(rng.randint(0, 5)))
        assert rule.repair(text)[0] == brute(text), text


def test_least_cost_has_no_limit():
    """Costs of long texts that are something else, against shortest ways over (tokens read, place)."""
    g = Grammar("t")
    g.declare("if", "", {"(": "x", "[": "x", "{": "x"})
    g.macros = {"E": "a ( '+' a )*"}
    rule = g.rule("if E ';' | E ( ';' E )*")
    chart = rule.chart
    follow = [{q for q in range(len(chart.sets)) if f >> q & 1} for f in [*chart.follow, chart.first]]

    def shortest(text):
        heap, seen = [(0, 0, len(chart.sets))], set()
        while True:
            cost, i, p = heapq.heappop(heap)
            if (i, p) in seen:
                continue
            seen.add((i, p))
            if i == len(text) and p < len(chart.sets) and chart.last >> p & 1:
                return cost
            if i < len(text):
                heapq.heappush(heap, (cost + 1, i + 1, p))
            for q in follow[p]:
                heapq.heappush(heap, (cost + 1, i, q))
                if i < len(text):
                    heapq.heappush(heap, (cost + (text[i] not in chart.sets[q]), i + 1, q))

    rng = random.Random(3)
    costs = []
    for _ in range(40):
        text = "".join(rng.choice(["a", "+", ";", "?", g.keywords["if"]]) for _ in range(rng.randint(0, 60)))
        cost, places = rule.repair(text)
        assert cost == shortest(text) == len(places), text
        costs.append(cost)
    assert max(costs) > 20


def test_many_brackets_pair_at_least_cost():
    def least(text):
        n = len(text)
        best = [[0] * (n + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(i + 1, n + 1):
                ways = [best[i + 1][j] + 1]
                if text[i] in "([":
                    ways += [best[i + 1][k] + best[k + 1][j] + (text[i] + text[k] not in ("()", "[]")) for k in range(i + 1, j) if text[k] in ")]"]
                best[i][j] = min(ways)
        return best[0][n]

    assert pairing("(]" * 100) == ({2 * i + 1: 2 * i for i in range(100)}, 100)
    rng = random.Random(4)
    text = "".join(rng.choice("()[]") for _ in range(260))
    assert pairing(text)[1] == least(text)
    assert pairing(")" * 300 + "(" * 300) == ({}, 600)


def test_python_is_repaired_inside_what_stays_open():
    assert syntax.judge_text("py", "x = f(a b c")[0] == 2
    assert syntax.judge_text("py", "x = (1\ny = 2\nz = 3\n")[0] == 1
    assert syntax.judge_text("py", "x y = 1; y z = 2\n")[0] == 2
    page = "<!doctype html>\n<html><head><title>Moved</title></head>\n<body><h1>Moved</h1><p>As before, only 348 files had a frozen wave.</p></body></html>\n"
    assert syntax.judge_text("py", page)[1] == "mismatch"


def test_brackets_pair_at_least_cost():
    rng = random.Random(2)
    def brute(text):
        """Fewest insertions, deletions and replacements by a bracket of the same side, by breadth."""
        seen, layer, cost = {text}, {text}, 0
        while all(map(reduce_pairs, layer)):
            nxt = set()
            for x in layer:
                for i in range(len(x) + 1):
                    nxt |= {x[:i] + c + x[i:] for c in "()[]"}
                    if i < len(x):
                        nxt |= {x[:i] + x[i + 1 :]} | {x[:i] + c + x[i + 1 :] for c in ("([" if x[i] in "([" else ")]")}
            layer, cost = nxt - seen, cost + 1
            seen |= layer
        return cost

    def reduce_pairs(x):
        while True:
            y = x.replace("()", "").replace("[]", "")
            if y == x:
                return x
            x = y

    for _ in range(60):
        text = "".join(rng.choice("()[]") for _ in range(rng.randint(0, 5)))
        partner, cost = pairing(text)
        assert cost == brute(text), text
        assert all(text[o] in "([" and text[c] in ")]" and o < c for c, o in partner.items())


def test_python_agrees_with_its_own_parser():
    import ast

    rng = random.Random(7)
    parser = parser_for("py")
    source = VALID["py"]
    for _ in range(300):
        i = rng.randrange(len(source))
        text = source[:i] + rng.choice(["", "(", ":", "\n", "x ", "    ", ")", "="]) + source[i + rng.randint(0, 3) :]
        try:
            ast.parse(text)
            ok = True
        except (SyntaxError, ValueError):
            ok = False
        if ok:
            assert syntax.judge_text("py", text)[0] == 0
        elif parser.valid(text):
            # what the grammar leaves to later stages of the compiler
            assert any(w in text for w in ("=", "return", "del", "*"))


def test_check_rates_and_odd_rows(spark):
    rows = [(1, "r", "", "a.py", None, None, "x = (", dt.datetime(2025, 1, 1), ""), (2, "r", "", "a.PY", None, None, "x = 1", dt.datetime(2025, 1, 1), ""), (3, "r", "", "a.md", None, None, "(", dt.datetime(2025, 1, 1), ""), (4, "r", "", "b.py", None, None, None, None, ""), (5, "r", "", None, None, None, "(", None, ""), (6, None, "", "e.json", None, None, "", None, ""), (7, "r", "", "big.js", None, None, "f(1);\n" * 20000, None, "")]
    got = syntax.check(spark.createDataFrame(rows + rows[:1], FILES))
    assert sorted((r.file_id, r.flawed) for r in got.collect()) == [(1, True), (2, False), (6, True), (7, False)]
    rate = {(r.repo, r.extension): (r.files, r.flawed) for r in syntax.rates(got).collect()}
    assert rate == {("r", "py"): (2, 1), (None, "json"): (1, 1), ("r", "js"): (1, 0)}
    assert syntax.check(spark.createDataFrame([], FILES)).collect() == []


# ---------------------------------------------------------------- 7 leakage
DOCS = "doc_id long, text string, lang string, source string, n_chars long, words int"
WORDS = [f"w{i}" for i in range(60)]
ITEM = " ".join(WORDS)


def leak(text):
    m = leakage.Matcher([(1, ITEM), (2, "short"), (3, "")])
    return {x[0] for x in m.leaks(text)}


def test_leaks():
    assert leak(ITEM) == {1}
    assert leak("x > " + "\n> ".join(f"*{w.upper()}*," for w in WORDS) + " end") == {1}
    assert leak(" ".join(w if i % 7 else "other" for i, w in enumerate(WORDS))) == {1}
    assert leak(" ".join(WORDS[:31])) == {1}
    assert leak(" ".join(WORDS[:29])) == set()
    assert leak(" ".join(WORDS[:16]) + " filler here " + " ".join(WORDS[30:46])) == {1}
    assert leak(" ".join(WORDS[30:46]) + " filler here " + " ".join(WORDS[:16])) == set()
    assert leak(" ".join(reversed(WORDS))) == set()
    shuffled = WORDS[:]
    random.Random(1).shuffle(shuffled)
    assert leak(" ".join(shuffled)) == set()
    assert leak("") == set() and leak("short") == {2}


def test_leak_places_and_odd_rows(spark):
    pre = "Öh — " * 5000
    rows = [(1, pre + ITEM + ".", "en", "s", 1, 0), (2, None, None, None, None, 0), (3, "", "en", "s", 0, 0), (None, ITEM, "en", "s", 0, 0), (4, ITEM.upper(), "en", "s", 0, 0)]
    items = spark.createDataFrame([(1, "c", ITEM), (1, "c", ITEM), (9, None, None)], "item_id long, category string, text string")
    got = {r.doc_id: r for r in leakage.leaks(spark.createDataFrame(rows, DOCS), items).collect()}
    assert sorted(got) == [1, 4] and rows[0][1][got[1].start : got[1].stop] == ITEM and got[1].share == 1.0
    none = leakage.leaks(spark.createDataFrame(rows, DOCS), items.limit(0))
    assert none.collect() == []


def test_item_blocks_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(i, "c", " ".join(f"v{i}x{j}" for j in range(20))) for i in range(9)], "item_id long, category string, text string")
    docs = spark.createDataFrame([(i, " ".join(f"v{i}x{j}" for j in range(20)), "en", "s", 1, 0) for i in range(9)], DOCS)
    whole = sorted((r.doc_id, r.item_id) for r in leakage.leaks(docs, items).collect())
    monkeypatch.setattr(leakage, "ITEM_BLOCK", 200)
    assert sorted((r.doc_id, r.item_id) for r in leakage.leaks(docs, items).collect()) == whole == [(i, i) for i in range(9)]


# ---------------------------------------------------------------- 8 mixing
def test_water_fill():
    caps = {"a": 1, "b": 2, "c": 4}
    even = mixing.water_fill({"a": 1000, "b": 1000, "c": 1000}, {"a": 0.5, "b": 0.25, "c": 0.25}, caps)
    assert even == {"a": 1000, "b": 500, "c": 500}
    clamped = mixing.water_fill({"a": 1000, "b": 1000, "c": 10}, {"a": 0.2, "b": 0.4, "c": 0.4}, caps, 2000)
    assert clamped["c"] == 40 and clamped["a"] == pytest.approx(1960 / 3) and sum(clamped.values()) == pytest.approx(2000)
    assert sum(mixing.water_fill({"a": 10, "b": 10}, {"a": 1, "b": 1}, {"a": 1, "b": 1}, 1e9).values()) == 20
    assert mixing.water_fill({}, {"a": 1.0}, {"a": 1}) == {}


def test_mixture(spark):
    rng = random.Random(3)
    rows = [(i, f"text {i} " + "word " * rng.randint(1, 60), "en", ["A", "b ", "B", "c-d"][i % 4], 0, 0) for i in range(1200)]
    rows += [(5000, rows[0][1], "en", "B", 0, 0), (5001, None, "en", "A", 0, 0), (5002, "  ", "en", "A", 0, 0), (5003, "x", "en", None, 0, 0), (5004, "x", "en", "zzz", 0, 0), rows[1]]
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.3, 3), ("c_d", 0.5, 4), ("e", 0.0, 1)], "source string, target_weight double, max_repeats int")
    plan, chosen = mixing.mix(spark.createDataFrame(rows, DOCS), targets, seed=5)
    got = chosen.collect()
    assert len({r.text_id for r in got}) == len(got)
    caps = {"a": 1, "b": 3, "c_d": 4}
    assert all(1 <= r.copies <= caps[r.source] for r in got)
    report = {r.source: r for r in mixing.report(chosen, plan).collect()}
    for s, w in (("a", 0.2), ("b", 0.3), ("c_d", 0.5)):
        assert report[s].share == pytest.approx(w, abs=0.003)
    again = {(r.text_id, r.copies) for r in mixing.mix(spark.createDataFrame(rows, DOCS).repartition(5), targets, seed=5)[1].collect()}
    assert again == {(r.text_id, r.copies) for r in got}
    assert again != {(r.text_id, r.copies) for r in mixing.mix(spark.createDataFrame(rows, DOCS), targets, seed=6)[1].collect()}
    _, none = mixing.mix(spark.createDataFrame([], DOCS), targets)
    assert none.collect() == []


# ---------------------------------------------------------------- 9 truncation
@pytest.mark.parametrize(
    ("text", "form"),
    [
        ("A sentence.", "whole"), ("A sentence that sto", "title"), ("Two words. And then the", "loose"), ("", "whole"), (None, "whole"), ("   ", "whole"), ("Cut here and th...", "mark"), ("Cut here and […]", "mark"),
        ("Cut [message clipped]", "mark"), ("Done.\n\n* one item\n* two item", "list"), ("Done.\n\n# Heading", "whole"), ("Title\n=====", "whole"), ("See:\n```\nx\n``` And then the no", "loose"), ("See:\n```\nx\n``` It is done.", "whole"), ("# Heading\n\nIt is all done by now, I think. And then the no", "loose"), ("See:\n```py\nx = (1)\n```", "whole"), ("See:\n```py\nx = (1", "open"), ("Try `foo.ba", "open"),
        ("A broken byte \ufffd", "broken"), ("Text &am", "broken"), ("def f():\n    return 1\n\ndef g():\n    return f(", "open"), ("int f() {\n  return 1;\n}", "code"), ("Fix the parser", "title"), ("Done.\n\nthanks", "closing"),
        ("* item of the", "loose"), ("[10:00:00] INFO a 1\n[10:00:01] INFO b 2", "list"), ("[10:00:00] INFO a 1\n[10:00:01] INF", "loose"), ("Is it so?\n\nbob: and then", "closing"), ("He said <b>so", "open") ,
    ],
)
def test_endings(text, form):
    got = truncation.ending(text)[0]
    assert got == form or (text == "He said <b>so" and got in ("open", "loose"))


def test_recurring_fragments_are_no_signatures(spark):
    rows = [(k, f"The {k} report was read.\n\nThis text may be", "mail") for k in range(4)]
    rows += [(10 + k, f"The {k} report was read.\n\nThis tex", "mail") for k in range(4)]
    rows += [(20 + k, f"The {k} report was read.\n\nRegards Ann", "mail") for k in range(4)]
    rows += [(30, "This text may be shared.", "wiki")]
    rows += [(40 + k, f"The {k} report was read.\n\nNothing Rare", "big") for k in range(3)] + [(100 + k, f"The {k} report was sent.", "big") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id for r in truncation.judge(df).where("truncated").collect()} == {*range(4), *range(10, 14), 40, 41, 42}


def test_marks_alone_in_the_last_paragraph(spark):
    marks = ["(truncated)", "(more)", "[message clipped]", "[truncated]", "...", "…"]
    rows = [(10 * i + k, f"The {k} report was read.\n\n{m}", "mail") for i, m in enumerate(marks) for k in range(4)]
    rows += [(100 + k, f"The {k} report was read.\n\nand so on...", "mail") for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id for r in truncation.judge(df).where("truncated").collect()} == {10 * i + k for i in range(6) for k in range(4)}


def test_truncation_baselines(spark):
    rows = [(i, f"Sentence number {i} is whole.\n\nbest wishes from Kim", "en", "mail", 0, 0) for i in range(5)]
    rows += [(20, "A whole one.\n\nBut then it", "en", "mail", 0, 0), (21, None, "en", None, 0, 0), (22, "Rename parser module", "en", "log", 0, 0), (23, "The parser module is fine.", "en", "log", 0, 0), (24, "Rename parser modu", "en", "log", 0, 0), (20, "A whole one.\n\nBut then it", "en", "mail", 0, 0)]
    judged = truncation.judge(spark.createDataFrame(rows, DOCS))
    got = {r.doc_id: r.truncated for r in judged.collect()}
    assert got == {**{i: False for i in range(5)}, 20: True, 21: False, 22: False, 23: False, 24: True}
    rate = {r.source: (r.documents, r.truncated) for r in truncation.rates(judged).collect()}
    assert rate["mail"] == (7, 2) and rate[None] == (1, 0)
    assert truncation.judge(spark.createDataFrame([], DOCS)).collect() == []


def test_field_limit(spark):
    """At a field limit, a list entry shorter than its fellows was cut; a complete one ended there by chance."""
    rows = [(i, f"* red green {100 + i}\n* blue red {100 + i}\n* {'grey' if i < 9 else 'g'}" + (" red pink" if i < 3 else ""), "en", "f", 0, 0) for i in range(9)]
    rows = [(i, "x" * (60 - len(t)) + "\n" + t, *r) for i, t, *r in rows]
    rows += [(100 + i, "Short text " * (i % 5) + f"{i} here.", "en", "f", 0, 0) for i in range(30)] + [(200, "Some grey red pink words end here.", "en", "f", 0, 0)]
    judged = truncation.judge(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id for r in judged if r.truncated} == set(range(3, 9))
    assert {r.doc_id for r in judged if r.at_limit} == set(range(9))


def test_clusters_alone(spark):
    """Without declarations families and copies still count, comments and folders do not."""
    body = lambda n: "\n".join(f"def step{n}_{i}(value, other):\n    total = value * {i} + other\n    return total - {i * 7}\n" for i in range(12))
    rows = [(i, repo, f"src/a{i}.py", body("x")) for i, repo in enumerate(["one", "two", "three"])]
    rows += [(9, "one", "vendor/b.py", "# Code generated by gen; DO NOT EDIT.\nprint(1)\n")]
    df = spark.createDataFrame(rows, "file_id long, repo string, relative_path string, content string")
    got = {r.file_id: r for r in handwritten.judge(df, declarations=False).collect()}
    assert all(got[i].vendored for i in range(3))
    assert not any((got[9].generated, got[9].vendored, got[9].minified, got[9].blob))
    with_all = {r.file_id: r for r in handwritten.judge(df).collect()}
    assert with_all[9].generated and with_all[9].vendored

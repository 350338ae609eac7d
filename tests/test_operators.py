"""Relational, graph and text operators against hand-computed results and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from codequarry.operators import chunking, cochange, duplicates, evaluate, graph, history, jobs, ownership, ranking, search
from codequarry.operators.prefix import average_ranks, global_rank, hash_bucket, running_total
from codequarry.sources import git as G
from codequarry.sources import pyast
from codequarry.streaming import throttle


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def baskets(spark, spec):
    out, n = [], 0
    for times, paths in spec:
        for _ in range(times):
            out += [(f"c{n}", p) for p in paths]
            n += 1
    return spark.createDataFrame(out, "commit_id string, path string")


def test_cochange(spark):
    b = baskets(spark, [(6, ["backend/api.py", "frontend/api.ts"]), (2, ["backend/api.py"]), (5, ["src/app/models.py", "src/app/views.py"]), (5, ["src/app/views.py"]), (20, ["CHANGES.rst"]), (4, ["CHANGES.rst", "backend/api.py"])])
    nodes = spark.createDataFrame([("backend/api.py",), ("src/app/models.py",), ("src/app/views.py",)], "p string")
    edges = spark.createDataFrame([("src/app/views.py", "src/app/models.py")], "src string, dst string")
    got = rows(cochange.cochange(b, group="commit_id", item="path", nodes=nodes, edges=edges), "a", "b", "together", "count_a", "count_b", "degree", "has_edge")
    assert got[0] == ("src/app/models.py", "src/app/views.py", 5, 5, 10, 0.667, True) or got[0] == ("backend/api.py", "frontend/api.ts", 6, 12, 6, 0.667, None)
    assert set(got) == {("backend/api.py", "frontend/api.ts", 6, 12, 6, 0.667, None), ("src/app/models.py", "src/app/views.py", 5, 5, 10, 0.667, True)}
    assert got[0][2] == 6  # same degree: more joint commits first


def test_cochange_edge_cases(spark):
    empty = spark.createDataFrame([], "commit_id string, path string")
    assert rows(cochange.cochange(empty, group="commit_id", item="path"), "a") == []
    big = baskets(spark, [(10, [f"f{i}" for i in range(31)]), (4, ["rare_a", "rare_b"])])
    assert rows(cochange.cochange(big, group="commit_id", item="path"), "a") == []
    nulls = spark.createDataFrame([("c", None), (None, "p"), ("c", "q")] * 7, "commit_id string, path string")
    assert rows(cochange.cochange(nulls, group="commit_id", item="path"), "a") == []


def test_area_pairs(spark):
    b = baskets(spark, [(3, ["backend/a.py", "ml-service/b.py"]), (2, ["backend/a.py", "ml-service/c.py", "frontend/x.ts"]), (2, ["frontend/x.ts"])])
    from codequarry.functions.paths import area

    assert rows(cochange.cochange_areas(b, group="commit_id", area=area(F.col("path"))), "a", "b", "together", "degree") == [("backend", "ml-service", 5, 1.0)]


def test_ownership(spark):
    blame = spark.createDataFrame(
        [("core.py", "Alice@x.org", 60), ("core.py", "alice@home.org", 30), ("core.py", "bob@x.org", 10), ("core.py", "bot@x", 500), ("pkg/util.py", "bob@x.org", 150), ("pkg/sub/tiny.py", "bob@x.org", 20), ("only_bot.py", "bot@x", 40)], "path string, email string, lines int"
    )
    people = spark.createDataFrame([("a1", ["alice@x.org", "alice@home.org"], False), ("a2", ["bob@x.org"], False), ("a3", ["bot@x"], True)], "id string, emails array<string>, bot boolean")
    owned = ownership.owned_lines(blame, people)
    seen = spark.createDataFrame([("a1", "2025-05-01"), ("a2", "2022-01-01")], "owner string, at string")
    got = {r["path"]: r for r in ownership.ownership(owned, last_seen=seen, as_of="2025-06-01").collect()}
    assert set(got) == {"core.py", "pkg/util.py", "pkg/sub/tiny.py"}
    assert (got["core.py"]["total"], got["core.py"]["bus_factor"], got["core.py"]["flags"]) == (100, 1, ["single-owner"])
    assert [(o["owner"], o["share"]) for o in got["core.py"]["owners"]] == [("a1", 0.9), ("a2", 0.1)]
    assert got["pkg/util.py"]["flags"] == ["single-owner", "orphaned"] and got["pkg/sub/tiny.py"]["flags"] == []
    up = {r["path"]: r["total"] for r in ownership.ownership(ownership.roll_up(owned)).collect()}
    assert up == {".": 270, "pkg": 170, "pkg/sub": 20}


@pytest.mark.parametrize(("lines", "bus"), [([40, 35, 25], 2), ([50, 50], 1), ([10] * 7, 4)])
def test_bus_factor(spark, lines, bus):
    d = spark.createDataFrame([("f", f"o{i}", n) for i, n in enumerate(lines)], "path string, owner string, lines int")
    r = ownership.ownership(d).first()
    assert r["bus_factor"] == bus and r["owner_count"] == len(lines) and r["other_lines"] == sum(lines[5:])


def test_hotspots_and_reading(spark):
    d = spark.createDataFrame([("core", 200, 1200), ("busy_flat", 300, 10), ("complex_quiet", 2, 1500), ("never", 0, 10), ("flat", 5, 0)], "k string, c int, x int")
    assert [r[0] for r in rows(ranking.hotspots(d, key="k", commits="c", complexity="x"), "k")] == ["core", "busy_flat", "complex_quiet"]
    r = spark.createDataFrame([("app", 50, 1.0, 1, False), ("_priv", 50, 1.0, 1, True), ("z", 0, 0.0, 0, False)], "k string, c int, r double, f int, p boolean")
    got = ranking.reading_order(r, key="k", commits="c", reach="r", fan_in="f", private="p").collect()
    assert [(x["rank"], x["k"]) for x in sorted(got, key=lambda x: x["rank"])] == [(1, "app"), (2, "_priv"), (3, "z")]
    assert got[0]["reasons"][0] == "Changed in 50 commits"


def test_components_against_union_find(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(30)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(rows(graph.components(spark.createDataFrame(edges, "src int, dst int")), "node", "component"))
    assert got == {x: find(x) for x in parent}
    assert rows(graph.components(spark.createDataFrame([], "src int, dst int")), "node") == []


def test_pagerank(spark):
    n = spark.createDataFrame([(x,) for x in ("a", "b", "c", "core", "base", "lonely")], "node string")
    e = spark.createDataFrame([("a", "core"), ("b", "core"), ("c", "core"), ("core", "base")], "src string, dst string")
    r = dict(rows(graph.pagerank(n, e, rounds=30), "node", "rank"))
    assert abs(sum(r.values()) - 1) < 1e-9 and r["base"] > r["core"] > r["a"] == pytest.approx(r["lonely"])
    assert graph.pagerank(n.limit(0), e.limit(0)).count() == 0


def test_scc_and_layers(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("x", "y"), ("y", "x"), ("x", "d")], "src string, dst string")
    n, e = graph.build(e, spark.createDataFrame([("alone",)], "node string"))
    assert dict(rows(graph.scc(n, e), "node", "component")) == {"a": "a", "b": "a", "c": "a", "d": "d", "x": "x", "y": "x", "alone": "alone"}
    lay, cyc = graph.layers(n, e)
    assert dict(rows(lay, "node", "layer")) == {"a": 0, "b": 0, "c": 0, "d": 1, "x": 2, "y": 2, "alone": 0}
    assert [(r["component"], r["size"], len(r["edges"])) for r in cyc.collect()] == [("a", 3, 3), ("x", 2, 2)]


def test_directory_edges_skip_initialisers(spark):
    from codequarry.functions.paths import component_of

    e = spark.createDataFrame([("pkg/__init__.py", "pkg/json/tag.py"), ("pkg/json/tag.py", "pkg/globals.py")], "src string, dst string")
    assert rows(graph.directory_edges(e, component_of), "src", "dst") == [("pkg/json", "pkg")]


def test_people(spark):
    i = spark.createDataFrame(
        [("jane@a.org", "Jane Doe", ["Jane Doe"], 30, "2024-01-01"), ("JANE@b.org", " jane  DOE ", ["jane doe"], 5, "2024-02-01"), ("d1@x", "David", ["David"], 3, "2024-01-01"), ("d2@x", "David", ["David"], 2, "2024-01-01"), ("x+renovate[bot]@y", "renovate[bot]", None, 1, None), (None, "n", None, 1, None)],
        "email string, name string, names array<string>, commits int, last_commit_at string",
    )
    got = history.resolve_people(i).collect()
    by = {r["id"]: r for r in got}
    assert len(got) == 4 and by["a1"]["emails"] == ["jane@a.org", "jane@b.org"] and by["a1"]["commits"] == 35 and by["a1"]["name"] == " jane  DOE "
    assert [r["bot"] for r in sorted(got, key=lambda r: r["id"])] == [False, False, False, True]


def test_mailmap(spark):
    lines = ["Proper Name <commit@x>", "<proper@x> <old@x>", "Jane <jane@x> <j@x>", "Only Bob <bob@x> Bobby <b@x>", "# c", "<solo@x>"]
    m = history.parse_mailmap(spark.createDataFrame(list(enumerate(lines)), "ord int, value string"))
    assert m.count() == 4
    i = spark.createDataFrame([("n", "COMMIT@x"), ("o", "old@x"), ("k", "j@x"), ("bobby", "b@x"), ("else", "b@x")], "name string, email string")
    got = {(r["name"]): (r["mapped_name"], r["mapped_email"]) for r in history.apply_mailmap(i, m).collect()}
    assert got == {"n": ("Proper Name", "commit@x"), "o": ("o", "proper@x"), "k": ("Jane", "jane@x"), "bobby": ("Only Bob", "bob@x"), "else": ("else", "b@x")}


def test_near_duplicates(spark):
    a = "\n".join(f"statement number {i} of this file" for i in range(12))
    t = spark.createDataFrame([("src/hrp.py", a), ("src/core/hrp.py", a + "\nextra statement at the end"), ("src/other.py", "\n".join(f"unlike line {i} here" for i in range(20))), ("e.py", ""), ("n.py", None)], "path string, text string")
    p = duplicates.line_pairs(t, key="path", text="text")
    assert rows(p, "a", "b", "shared", "containment") == [("src/core/hrp.py", "src/hrp.py", 12, 1.0)]
    g = duplicates.duplicate_groups(p).first()
    assert g["members"] == ["src/core/hrp.py", "src/hrp.py"] and g["size"] == 2


def test_chunks(spark):
    src = "import os\n\nX = 1\n\n\ndef one():\n    return 1\n\n\ndef two():\n    return 2\n"
    t = spark.createDataFrame([("m.py", src)], "path string, text string")
    got = sorted(rows(chunking.symbol_chunks(t, pyast.symbols_of(pyast.parse_files(t))), "start_line", "end_line", "kind", "symbol"))
    assert got == [(1, 5, "module", None), (6, 7, "function", "one"), (10, 11, "function", "two")]
    w = spark.createDataFrame([("r", "x\n" * 250), ("blank", " \n\n"), ("empty", "")], "path string, text string")
    assert sorted(rows(chunking.windows(w), "start_line", "end_line")) == [(1, 100), (101, 200), (201, 250)]


def test_search_and_citations(spark):
    c = spark.createDataFrame([(i, "big.py", i * 10, i * 10 + 5, f"helper_{i}", "save session data", 0.1, False, False) for i in range(1, 7)] + [(9, "other.py", 1, 5, "x", "session", 0.9, False, False), (10, "t.py", 1, 5, "save_session", "pass", 0.0, True, False)], "id long, path string, start_line int, end_line int, symbol string, body string, file_score double, is_test boolean, is_generated boolean")
    q = "where is save_session defined"
    m = search.candidates(search.postings(c, key="id"), c, q, key="id")
    r = search.rank(m, q, penal=F.col("is_test") | F.col("is_generated"))
    got = rows(r, "path")
    assert got[0] == ("t.py",) and sum(x == ("big.py",) for x in got) <= 3
    given = spark.createDataFrame([(1, "app.py", 76, 120), (1, "cli.py", 10, 40)], "k int, path string, start_line int, end_line int")
    a = spark.createDataFrame([(1, "cli.py:10-40 app.py:95-99 app.py:900 app.py:80-400 cli.py:10-40")], "k int, a string")
    st = {(x["path"], x["start"], x["end"]): x["status"] for x in search.verify_citations(a, given, key="k", answer="a").collect()}
    assert st == {("cli.py", 10, 40): "exact", ("app.py", 95, 99): "inside", ("app.py", 900, None): "unsupported", ("app.py", 80, 400): "unsupported"}


def test_percentiles(spark):
    rk = spark.createDataFrame([("r", x, i + 1) for i, x in enumerate("abcde")] + [("s", "a", 1)], "g string, item string, rank int")
    for truth, want in (("a", 1.0), ("e", 0.0), ("c", 0.5), ("ae", 0.5), ("z", None)):
        t = spark.createDataFrame([("r", x) for x in truth], "g string, item string")
        assert dict(rows(evaluate.mean_percentile(rk, t, by=["g"], item="item"), "g", "percentile")) == {"r": want, "s": None}
    t = spark.createDataFrame([("r", "a"), ("r", "b")], "g string, item string")
    assert dict(rows(evaluate.hits_at_k(rk, t, by=["g"], item="item", k=2), "g", "hits")) == {"r": 2, "s": 0}


def test_grid_size(spark):
    v = evaluate.variants(spark)
    assert 3300 < v.count() < 3500 and v.filter("variant = 'current'").count() == 1


def test_codeowners_longest_prefix(spark):
    o = evaluate.codeowners(spark.createDataFrame([("* @org/core",), ("/src/ui/ @Ann @bob",), ("docs/*.md @w",), ("# @x",), ("setup.py @s",)], "value string"))
    d = dict(rows(o, "dir", "handles"))
    assert d["src/ui"] == ["ann", "bob"] and d["docs"] == ["w"] and d["."] in (["org/core"], ["org/core", "s"])
    dirs = spark.createDataFrame([("src/ui/x",), ("src/ui",), ("lib",), (".",)], "path string")
    got = dict(rows(evaluate.owners_of(dirs, o), "path", "dir"))
    assert got == {"src/ui/x": "src/ui", "src/ui": "src/ui", "lib": ".", ".": "."}


def test_ranks_and_totals(spark):
    rnd = random.Random(1)
    data = [("hot" if rnd.random() < 0.7 else f"k{rnd.randrange(5)}", float(rnd.randrange(20)), i) for i in range(600)] + [("k0", None, 1000)]
    d = spark.createDataFrame(data, "k string, v double, i int")
    got = {(r["k"], r["v"]): (r["rk"], r["n"]) for r in average_ranks(d, ["k"], "v", "rk", "n", parts=7).collect()}
    for key in {k for k, _, _ in data}:
        vs = sorted(v for k, v, _ in data if k == key and v is not None)
        for v in set(vs):
            first, last = vs.index(v) + 1, len(vs) - vs[::-1].index(v)
            assert got[key, v] == ((first + last) / 2, len(vs))
    b, o = hash_bucket("i", bits=4)
    rt = running_total(d.withColumn("b", b).withColumn("o", o), ["k"], "b", ["o", "i"], F.lit(1), "before").collect()
    for key in {r["k"] for r in rt}:
        assert sorted(r["before"] for r in rt if r["k"] == key) == list(range(sum(r["k"] == key for r in rt)))
    g = global_rank(d.select("i"), [F.desc("i")], "pos", parts=5).collect()
    assert [r["i"] for r in sorted(g, key=lambda r: r["pos"])] == sorted((r["i"] for r in g), reverse=True) and min(r["pos"] for r in g) == 1


def test_jobs(spark):
    c = spark.createDataFrame([("u", f"2024-01-01 10:{i:02d}:00", i) for i in range(35)] + [("v", "2024-01-01 10:00:00", 99)], "u string, t string, i int").withColumn("t", F.col("t").cast("timestamp"))
    assert jobs.rate_limit(c, caller="u", at="t", order="i").filter("not accepted").count() == 5
    assert jobs.rate_limit(c, caller="u", at="t", order="i", per_hour=0).filter("not accepted").count() == 0
    keep, last = throttle.emitted([(0, "a"), (100, "a"), (600, "a"), (650, "b"), (1200, "b")], None, 500)
    assert keep == [True, False, True, True, True] and last == (1200, "b")


def test_python_symbols():
    src = "import os, sys as s\nfrom . import a\nfrom ..b import (c,\n    d as e)\nclass P:\n    def __init__(self):\n        pass\n\n    @property\n    def total(self):\n        def inner():\n            return 1\n        return inner\nasync def fetch():\n    import x.y\n"
    im, sy, err = pyast.parse_python(src)
    assert [(i[0], i[3], i[4], i[5]) for i in im] == [(1, 0, "os", []), (1, 0, "sys", []), (2, 1, "", ["a"]), (3, 2, "b", ["c", "d"]), (15, 0, "x.y", [])]
    assert [(s[1], s[2], s[3], s[4]) for s in sy] == [("P", 5, 13, None), ("__init__", 6, 7, "P"), ("total", 10, 13, "P"), ("inner", 11, 12, "total"), ("fetch", 14, 15, None)] and err == 0
    im, sy, err = pyast.parse_python("import os\n\ndef broken(:\n    pass\nimport sys\n")
    assert err == 3 and [i[4] for i in im] == ["os", "sys"]


def test_git_history_and_blame(spark, tmp_path):
    import os
    import subprocess

    n = [0]

    def run(*a, who="alice"):
        env = os.environ | {f"GIT_{r}_{k}": v for r in ("AUTHOR", "COMMITTER") for k, v in (("NAME", who), ("EMAIL", f"{who}@X.org"), ("DATE", f"2024-01-01T{n[0]:02d}:00:00Z"))}
        subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True, env=env)

    def commit(files, who="alice"):
        for p, t in files.items():
            (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / p).write_text(t)
        run("add", "-A")
        n[0] += 1
        run("commit", "-q", "-m", "m", who=who)

    run("init", "-q", "-b", "main")
    body = "".join(f"line {i}\n" for i in range(20))
    commit({"old/core.py": body, "util.py": "a\n"})
    commit({"old/core.py": body + "more\n"}, who="bob")
    (tmp_path / "pkg").mkdir()
    run("mv", "old/core.py", "pkg/core.py")
    commit({})
    commit({"pkg/core.py": body + "more\nagain\n", "util.py": "b\n"}, who="carol")
    repo = str(tmp_path)
    c = G.read_git(spark, repo, "commits")
    assert c.count() == 4
    fl = history.follow_renames(G.read_git(spark, repo, "commit_files"), c, G.read_git(spark, repo, "renames"))
    h = {r["path"]: (r["commits"], r["authors"]) for r in history.file_history(fl, c).collect()}
    assert h == {"pkg/core.py": (4, 3), "util.py": (2, 2)}
    inv = {r["path"]: r for r in G.inventory(G.read_git(spark, repo, "blobs")).collect()}
    assert set(inv) == {"pkg/core.py", "util.py"} and inv["pkg/core.py"]["lines"] == 22 and inv["util.py"]["text"] == "b\n"
    b = G.blame(spark.createDataFrame([("pkg/core.py",), ("gone.py",)], "path string"), repo, tasks=1).collect()
    assert {(r["path"], r["email"]): r["lines"] for r in b if r["error"] is None} == {("pkg/core.py", "alice@x.org"): 20, ("pkg/core.py", "bob@x.org"): 1, ("pkg/core.py", "carol@x.org"): 1}
    assert [r["path"] for r in b if r["error"]] == ["gone.py"]
    with pytest.raises(ValueError):
        G.open_local(str(tmp_path / "pkg" / "nothing"))


def test_many_questions_rank_as_each_alone(spark, tiny):
    from pyspark.sql import functions as F

    from codequarry.operators import search
    from codequarry.plans import catalogue

    rows = [(i, "ab"[i % 2], f"d{i % 5}/f{i % 7}.py", ("load", "Box.load", "save_all", None, "where", "scan")[i % 6], 10 * i, 10 * i + 5, "where it is defined load save_all scan " * (i % 4) + "load the box " * (i % 3), (i % 10) / 10.0) for i in range(60)]
    c = spark.createDataFrame(rows, "k long, s string, path string, symbol string, start_line int, end_line int, body string, file_score double")
    names = ["load", "save_all", "scan", "where", "absent"]
    q = spark.createDataFrame([(s, f"where is {n} defined") for s in "ab" for n in names], "s string, q string")
    index = search.postings(c, key="k")
    got = {(r["s"], r["q"], r["position"]): r["k"] for r in search.rank_many(index, c, q, key="k", scope="s", question="q", shared=("where", "defined"), pool=12).collect()}
    want = {}
    for s, text in [(s, f"where is {n} defined") for s in "ab" for n in names]:
        own = c.filter(F.col("s") == s)
        one = search.rank(search.candidates(search.postings(own, key="k"), own, text, key="k", limit=12), text).collect()
        want |= {(s, text, i + 1): r["k"] for i, r in enumerate(one)}
    assert got == want and len(want) > 50
    # the query counts ranks, not document frequencies
    r = catalogue.QUERIES["agg_retrieval_recall"](spark, tiny).first()
    assert 0 < r["first"] <= r["within_8"] <= r["asked"]

"""Many repositories in one run, each by itself; and what used to stop at a bound."""

import pytest
from pyspark.sql import functions as F

from codequarry.operators import findings, graph, history, imports
from codequarry.plans import project
from codequarry.sources import files as X
from codequarry.sources import git as G

IMPORTS = "repo string, path string, ord int, line int, from_import boolean, level int, module string, names array<string>"


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_imports_stay_in_their_repository(spark):
    """``import helper`` means the repository's own module or nothing; a suffix is unique within a repository."""
    f = spark.createDataFrame([("o/a", "main.py"), ("o/b", "helper/__init__.py"), ("o/b", "main.py"), ("o/a", "x/deep/tool.py"), ("o/b", "y/deep/tool.py"), ("o/c", "main.py")], "repo string, path string")
    st = [(r, "main.py", i, i + 1, False, 0, m, []) for r in ("o/a", "o/b", "o/c") for i, m in enumerate(["helper", "deep.tool"])] + [("o/b", "helper/__init__.py", 0, 1, True, 2, "", ["main"])]
    got = imports.resolve_imports(spark.createDataFrame(st, IMPORTS), f)
    assert set(rows(got, "repo", "path", "ord", "target_path", "external")) == {
        ("o/a", "main.py", 0, None, True), ("o/a", "main.py", 1, "x/deep/tool.py", False), ("o/b", "main.py", 0, "helper/__init__.py", False), ("o/b", "main.py", 1, "y/deep/tool.py", False),
        ("o/c", "main.py", 0, None, True), ("o/c", "main.py", 1, None, True), ("o/b", "helper/__init__.py", 0, "main.py", False),
    }


def test_renames_fold_as_one_by_one(spark):
    """Chains, reuse of a name, a cycle, and equal names in two repositories, against the sequential fold."""
    events = [("r", 9, 0, "a", "b"), ("r", 7, 0, "b", "c"), ("r", 5, 0, "c", "d"), ("r", 5, 1, "x", "a"), ("r", 3, 0, "d", "a"), ("r", 2, 0, "e", "f"), ("r", 8, 0, "f", "e"), ("s", 1, 0, "a", "z"), ("s", 4, 0, "q", "a")]
    events += [("t", 100 - i, 0, f"n{i}", f"n{i + 1}") for i in range(60)]
    got = {(r["repo"], r["old"]): (r["cur"], r["from_seq"]) for r in history.rename_aliases(spark.createDataFrame(events, "repo string, seq int, ord int, old_path string, new_path string")).collect()}
    want = {}
    for repo in "rst":
        cur = {}
        for _, seq, _, old, new in sorted(e for e in events if e[0] == repo):
            cur.setdefault(old, (cur.get(new, (new, 0))[0], seq))
        want |= {(repo, k): v for k, v in cur.items()}
    assert got == want and got["t", "n0"] == ("n60", 100)


def test_ranks_of_each_repository_alone(spark):
    e = [("r", "a", "b"), ("r", "b", "c"), ("r", "c", "a"), ("r", "d", "c"), ("s", "a", "b"), ("s", "c", "b")]
    n = sorted({(r, x) for r, a, b in e for x in (a, b)} | {("s", "lonely")})
    nodes, edges = spark.createDataFrame(n, "repo string, node string"), spark.createDataFrame(e, "repo string, src string, dst string")
    for reverse in (False, True):
        both = {(r["repo"], r["node"]): r["rank"] for r in graph.pagerank(nodes, edges, rounds=12, reverse=reverse).collect()}
        for repo in "rs":
            one = dict(rows(graph.pagerank(nodes.filter(F.col("repo") == repo).drop("repo"), edges.filter(F.col("repo") == repo).drop("repo"), rounds=12, reverse=reverse), "node", "rank"))
            assert {k[1]: v for k, v in both.items() if k[0] == repo} == pytest.approx(one)


def test_findings_are_numbered_by_repository(spark):
    d = spark.createDataFrame([(f"r{i % 2}", "unreferenced-file", "info", f"t{i:03d}", 0, i) for i in range(130)] + [("r0", "import-cycle", "warn", "c", 0, 1)], "repo string, kind string, severity string, title string, o0 int, o1 int")
    d = d.select("repo", "kind", "severity", "title", F.array(F.struct(F.col("title").alias("path"))).alias("evidence"), F.struct("o0", "o1").alias("sort_key"))
    kept, omitted = findings.number([d, d.filter("title = 'c'").withColumn("title", F.lit("later"))])
    assert set(rows(omitted, "repo", "kind", "omitted")) == {("r0", "unreferenced-file", 15), ("r1", "unreferenced-file", 15)}
    ids = {(r["repo"], r["id"]): r["title"] for r in kept.collect()}
    assert ids["r0", "unreferenced-file-1"] == "t000" and ids["r1", "unreferenced-file-50"] == "t099" and ids["r0", "import-cycle-2"] == "later" and len(ids) == 102


def test_findings_of_the_project(spark, tiny):
    """Every repository has the same project, so the same findings of it; duplicates don't cross repositories."""
    from codequarry.plans import catalogue

    got = catalogue.QUERIES["union_findings"](spark, tiny).filter("title rlike 'twin_a|models.py|zapp/core|zlib9$|ledgerbox|arrange|zextra/helper'").groupBy("kind", "title").agg(F.count_distinct("repo").alias("n")).collect()
    repos = project.project(spark, tiny).select("repo").distinct().count()
    want = {"Near-duplicate files: twin_a.py and twin_b.py", "Two modules named models.py", "Import cycle between 2 directories: zapp/core, zapp/store", "No tests found for zlib9", '3 files named after "ledgerbox" in 3 areas', "2 identical copies of a function (arrange, prepare)", "Only tests import zextra/helper.py"}
    assert {r["title"] for r in got if r["n"] == repos} >= want and all(r["n"] == repos for r in got)


def test_all_kept_analyses_stay(spark, tmp_path):
    out = str(tmp_path / "chunks")
    c = spark.range(1030).select(F.concat(F.lit("k "), F.col("id").cast("string")).alias("analysis_id"), F.lit("p").alias("path"), "id")
    c.repartition(4).write.partitionBy("analysis_id").parquet(out)
    assert X.drop_expired(spark, out, c.filter("id < 1027").select("analysis_id")) == 3
    assert spark.read.parquet(out).count() == 1027


def test_summary_is_written_by_spark(spark, tmp_path):
    X.write_markdown(spark, "# t\n", str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s"), wholetext=True).first()[0].startswith("# t")


def test_history_in_slices(spark, tmp_path):
    """However the history is sliced, commits, numbers and contents are the same; environment files are measured."""
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@x", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    for i in range(7):
        (tmp_path / f"f{i}.txt").write_text(f"{i}\n" * 5)
        (tmp_path / ".env").write_text(f"A={i}\n")
        run("add", "-A")
        run("commit", "-q", "-m", f"c{i}")
    one = sorted(map(tuple, G.read_git(spark, str(tmp_path), "commit_files", slices=1).collect()))
    assert one == sorted(map(tuple, G.read_git(spark, str(tmp_path), "commit_files", slices=3).collect())) and len(one) == 14
    assert sorted(r["seq"] for r in G.read_git(spark, str(tmp_path), "commits", slices=4, maxCommits=5).collect()) == list(range(5))
    inv = {r["path"]: (r["lines"], r["text"]) for r in G.inventory(G.read_git(spark, str(tmp_path), "blobs", slices=2)).collect()}
    assert inv[".env"] == (1, "A=6\n") and inv["f3.txt"] == (5, "3\n" * 5) and len(inv) == 8


def test_a_whole_analysis(spark, tmp_path):
    """From a folder to the report: sections of a repository of two authors, with a cycle, a broken and a large file."""
    import json
    import subprocess

    from codequarry.operators.analysis import analyse

    def run(*a, who="ann"):
        subprocess.run(["git", "-C", str(tmp_path), "-c", f"user.name={who} x", "-c", f"user.email={who}@x.org", *a], check=True, capture_output=True)

    run("init", "-q", "-b", "main")
    for p, t in {**project.FILES, "zapp/broken.py": "def f(:\n", "big.txt": "x\n" * 600_000, "README.md": "# read\n", ".mailmap": "Bob Real <real@x.org> <bob@x.org>\n"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    run("add", "-A")
    run("commit", "-q", "-m", "first")
    for i in range(6):
        for p in ("zapp/core/engine.py", "zapp/store/disk.py"):
            (tmp_path / p).write_text(project.FILES[p] + f"x = {i}\n" * (i + 3))
        run("commit", "-q", "-am", f"c{i}", who="bob")
    heard = []
    a = analyse(spark, str(tmp_path), rounds=4, progress=lambda stage, share: heard.append((stage, share)))
    r = json.loads(a.report().first()["value"])
    assert heard[0] == ("inventory", 2) and heard[-1] == ("done", 100) and [s for _, s in heard] == sorted(s for _, s in heard)
    assert r["overview"]["files"] == len(project.FILES) + 4 and r["overview"]["commits"] == 7 and r["overview"]["contributors"] == 2
    assert {(e["src"], e["dst"], e["first_line"]) for e in r["edges"]} == set(project.EDGES)
    assert [(c["a"], c["b"], c["together"], c["has_edge"]) for c in r["coupling"]] == [("zapp/core/engine.py", "zapp/store/disk.py", 7, True)]
    assert {p["emails"][0]: p["commits"] for p in r["people"]} == {"ann@x.org": 1, "real@x.org": 6}
    assert {x["path"]: x["reason"] for x in r["limits"]} == {"big.txt": "larger than 1 MB", "zapp/broken.py": "parse error"}
    assert any(f["title"] == "Import cycle between 2 directories: zapp/core, zapp/store" for f in r["findings"]) and r["readingOrder"] and r["hotspots"]
    assert {c["component"]: c.get("layer") for c in r["components"]}["zapp/core"] == {c["component"]: c.get("layer") for c in r["components"]}["zapp/store"]
    assert {c["symbol"] for c in a.chunks.collect()} >= {"Item", "prepare", "arrange", "help_me"}
    with pytest.raises(ValueError):
        analyse(spark, str(tmp_path / "zapp" / "nothing"))

"""Queries that run on small literal repositories, for operators without counterpart in the tables."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from codequarry.operators import evaluate, findings, imports, jobs, overview, search
from codequarry.plans import relational, textual
from codequarry.plans.registry import Registry
from codequarry.plans.registry import values_sql as _values
from codequarry.session import ensure_checkpoint_dir, table
from codequarry.sources import files as X
from codequarry.sources import git as G

R = Registry()
IMPORTS = "path string, ord int, line int, from_import boolean, level int, module string, names array<string>"


def case(name: str, files: list[str], stmts: list[tuple], expected: list[tuple]) -> None:
    """stmts: (importer, from?, level, module, names); expected: (importer, ord, target, external, method)."""

    def fn(spark, base):  # noqa: ANN001, ANN202
        im = spark.createDataFrame([(p, i, i + 1, f, lv, m, n) for i, (p, f, lv, m, n) in enumerate(stmts)], IMPORTS)
        fl = spark.createDataFrame([(p,) for p in files], "path string")
        return imports.resolve_imports(im, fl).select("path", "ord", F.col("target_path").alias("target"), "external", "method")

    R.add(name, fn, f"SELECT path, ord, target::varchar AS target, external, method::varchar AS method FROM ({_values(expected, 'path, ord, target, external, method')})")


_PK = ["pkg/__init__.py", "pkg/json/__init__.py", "pkg/json/tag.py", "pkg/app.py", "main.py"]
case("res_from", _PK, [("main.py", True, 0, "pkg.json", ["tag", "dumps"]), ("main.py", True, 0, "pkg", ["app", "app"]), ("main.py", True, 0, "pkg.json", ["*"])],
     [("main.py", 0, "pkg/json/tag.py", False, "root"), ("main.py", 0, "pkg/json/__init__.py", False, "root"), ("main.py", 1, "pkg/app.py", False, "root"), ("main.py", 2, "pkg/json/__init__.py", False, "root")])
case("res_dedupe", _PK, [("main.py", True, 0, "pkg", ["app", "app"])], [("main.py", 0, "pkg/app.py", False, "root")])
case("distinct_imports", _PK, [("main.py", True, 0, "pkg.json", ["a", "b", "tag"])], [("main.py", 0, "pkg/json/__init__.py", False, "root"), ("main.py", 0, "pkg/json/tag.py", False, "root")])
_REL = ["pkg/__init__.py", "pkg/utils.py", "pkg/core/__init__.py", "pkg/core/hrp.py", "pkg/core/run.py", "a.py"]
case("res_relative", _REL,
     [("pkg/core/run.py", True, 1, "", ["hrp"]), ("pkg/core/run.py", True, 1, "hrp", ["allocate"]), ("pkg/core/run.py", True, 2, "", ["utils"]), ("pkg/core/run.py", True, 1, "", ["hrp", "VERSION"]), ("pkg/__init__.py", True, 1, "core", ["hrp"]), ("a.py", True, 3, "x", ["y"])],
     [("pkg/core/run.py", 0, "pkg/core/hrp.py", False, "relative"), ("pkg/core/run.py", 1, "pkg/core/hrp.py", False, "relative"), ("pkg/core/run.py", 2, "pkg/utils.py", False, "relative"), ("pkg/core/run.py", 3, "pkg/core/hrp.py", False, "relative"), ("pkg/core/run.py", 3, "pkg/core/__init__.py", False, "relative"), ("pkg/__init__.py", 4, "pkg/core/hrp.py", False, "relative"), ("a.py", 5, None, False, None)])
case("res_external", ["pkg/__init__.py", "pkg/app.py", "pkg/utils.py"], [("pkg/app.py", False, 0, "os.path", []), ("pkg/app.py", True, 0, "numpy.linalg", ["norm"]), ("pkg/app.py", False, 0, "utils", [])],
     [("pkg/app.py", 0, None, True, None), ("pkg/app.py", 1, None, True, None), ("pkg/app.py", 2, None, True, None)])
case("res_script_dir", ["backend/main.py", "backend/tmdb.py", "ml-service/serve.py", "ml-service/tmdb.py"], [("backend/main.py", False, 0, "tmdb", []), ("ml-service/serve.py", False, 0, "tmdb", [])],
     [("backend/main.py", 0, "backend/tmdb.py", False, "script-dir"), ("ml-service/serve.py", 1, "ml-service/tmdb.py", False, "script-dir")])
_SVC = [f"services/{s}/app/{f}.py" for s in "ab" for f in ("__init__", "db", "main")]
case("join_closest_root", _SVC, [("services/a/app/main.py", False, 0, "app.db", []), ("services/b/app/main.py", False, 0, "app.db", [])], [("services/a/app/main.py", 0, "services/a/app/db.py", False, "root"), ("services/b/app/main.py", 1, "services/b/app/db.py", False, "root")])
case("res_suffix", ["code/lib/ns/tools/strings.py", "code/app.py", "other/utils.py", "more/utils.py"], [("code/app.py", False, 0, "ns.tools.strings", []), ("code/app.py", False, 0, "utils", [])], [("code/app.py", 0, "code/lib/ns/tools/strings.py", False, "suffix"), ("code/app.py", 1, None, True, None)])
_SRC = ["src/flask/__init__.py", "src/flask/app.py", "src/flask/json/__init__.py", "src/flask/json/tag.py", "tests/test_app.py"]
case("join_import_resolve", _SRC, [("tests/test_app.py", False, 0, "flask", []), ("tests/test_app.py", False, 0, "flask.json.tag", []), ("tests/test_app.py", False, 0, "flask.json.missing", [])],
     [("tests/test_app.py", 0, "src/flask/__init__.py", False, "root"), ("tests/test_app.py", 1, "src/flask/json/tag.py", False, "root"), ("tests/test_app.py", 2, "src/flask/json/__init__.py", False, "root")])
case("res_module_file", ["m/__init__.py", "m.py", "n.pyi", "n.py", "x.py"], [("x.py", False, 0, "m", []), ("x.py", False, 0, "n", [])], [("x.py", 0, "m/__init__.py", False, "root"), ("x.py", 1, "n.py", False, "root")])


@R.query(_values([("",), ("services/api",), ("src",)], "root"))
def res_source_roots(spark, base):  # noqa: ANN001, ANN201
    fl = ["src/flask/__init__.py", "src/flask/app.py", "services/api/app/__init__.py", "services/api/app/main.py", "setup.py"]
    return imports.source_roots(spark.createDataFrame([(p,) for p in fl], "path string"))[1].select("root")


@R.query(_values([("main.py", "pkg/json/__init__.py", 1), ("main.py", "pkg/app.py", 3)], "src, dst, first_line"))
def win_first_import_line(spark, base):  # noqa: ANN001, ANN201
    im = spark.createDataFrame([("main.py", 0, 1, False, 0, "pkg.json", []), ("main.py", 1, 2, False, 0, "pkg.json", []), ("main.py", 2, 3, False, 0, "pkg.app", [])], IMPORTS)
    return imports.import_edges(imports.resolve_imports(im, spark.createDataFrame([(p,) for p in _PK], "path string")))


# ---- findings on a literal repository ----
FILES = "path string, language string, lines int, non_blank_lines int, is_test boolean, is_binary boolean, skip_reason string, generated_reason string"


def _file(path: str, lines: int = 40, test: bool = False, gen: str | None = None, lang: str = "python") -> tuple:
    return (path, lang, lines, lines, test, False, None, gen)


def small_repo(spark):  # noqa: ANN001, ANN201
    files = [_file("pkg/__init__.py", 1), _file("pkg/core.py"), _file("pkg/used.py", 30), _file("pkg/domain.py", 50), _file("pkg/cli.py", 20), _file("run.py", 10), _file("scripts/tool.py", 9), _file("pkg/sub/core.py", 60), _file("pyproject.toml", 5, lang="toml"), _file("tests/test_used.py", 12, True)]
    texts = [("run.py", "if __name__ == '__main__':\n    pass\n"), ("pyproject.toml", '[project.scripts]\nx = "pkg.cli:main"\n'), *((f[0], "x = 1\n") for f in files if f[0] not in ("run.py", "pyproject.toml"))]
    edges = [("pkg/core.py", "pkg/used.py", 3), ("pkg/used.py", "pkg/core.py", 4), ("tests/test_used.py", "pkg/sub/core.py", 2), ("tests/test_used.py", "pkg/used.py", 5)]
    return spark.createDataFrame(files, FILES), spark.createDataFrame(texts, "path string, text string"), spark.createDataFrame(edges, "src string, dst string, first_line int")


def _unreferenced(spark, base):  # noqa: ANN001, ANN202
    f, t, e = small_repo(spark)
    return findings.unreferenced(f, t, e, f.filter("language = 'python'").select("path"))


_UNREF = [("No static import found: pkg/domain.py",), ("Only tests import pkg/sub/core.py",)]
R.add("anti_unreferenced", lambda s, b: _unreferenced(s, b).select("title"), _values(_UNREF, "title"))
R.add("sort_unreferenced", lambda s, b: findings.number([_unreferenced(s, b)])[0].select("id", "title"), _values([("unreferenced-file-1", _UNREF[0][0]), ("unreferenced-file-2", _UNREF[1][0])], "id, title"))


@R.query(_values([("pkg/cli.py",)], "path"))
def join_config_suffix(spark, base):  # noqa: ANN001, ANN201
    from codequarry.functions import paths as P
    from codequarry.functions import text as T

    f, t, _ = small_repo(spark)
    mods = t.filter("path = 'pyproject.toml'").select(F.explode(T.config_modules(F.col("text"))).alias("m")).distinct()
    return f.select("path", F.explode(P.dotted_suffixes(F.col("path"), 1)).alias("m")).join(mods, "m", "left_semi").select("path").distinct()


@R.query(_values([("Two modules named core.py", "pkg/core.py", "pkg/sub/core.py")], "title, a, b"))
def join_same_name_nested(spark, base):  # noqa: ANN001, ANN201
    f, _, e = small_repo(spark)
    n = findings.same_name_nested(f, e, spark.createDataFrame([], "path string"))
    return n.select("title", F.col("evidence")[0]["path"].alias("a"), F.col("evidence")[1]["path"].alias("b"))


def _cycle_edges(spark):  # noqa: ANN001, ANN202
    return spark.createDataFrame([("a/x.py", "b/y.py", 1), ("b/y.py", "c/z.py", 2), ("c/z.py", "a/w.py", 3), ("d/top.py", "a/x.py", 4), ("e/p.py", "f/q.py", 5), ("f/q.py", "e/p.py", 6)], "src string, dst string, first_line int")


R.add("sort_cycles", lambda s, b: findings.number([findings.import_cycles(_cycle_edges(s))])[0].select("id", "title"), _values([("import-cycle-1", "Import cycle between 3 directories: a, b, c"), ("import-cycle-2", "Import cycle between 2 directories: e, f")], "id, title"))
R.add(
    "join_cycle_lines", lambda s, b: findings.import_cycles(_cycle_edges(s)).select(F.explode("evidence").alias("e")).select("e.path", F.col("e.start_line").alias("line"), "e.note"),
    _values([("a/x.py", 1, "imports b/y.py"), ("b/y.py", 2, "imports c/z.py"), ("c/z.py", 3, "imports a/w.py"), ("e/p.py", 5, "imports f/q.py"), ("f/q.py", 6, "imports e/p.py")], "path, line, note"),
)
_GEN = [_file("x/__pycache__/a.pyc", 0, gen="build output or cache (__pycache__/)"), _file("x/__pycache__/b.pyc", 0, gen="build output or cache (__pycache__/)"), _file("backend/.env", 1), _file(".env.example", 1), _file("static/lib.min.js", 1, gen="minified file"), _file("data/app.sqlite", 0)]
R.add(
    "sort_generated", lambda s, b: findings.number([findings.committed_generated(s.createDataFrame(_GEN, FILES))])[0].select("id", "severity", "title"),
    _values([("generated-file-committed-1", "warn", "Environment file committed: backend/.env"), ("generated-file-committed-2", "warn", "2 generated files committed (build output or cache (__pycache__/))"), ("generated-file-committed-3", "info", "Generated file committed (minified file): static/lib.min.js"), ("generated-file-committed-4", "info", "Database file committed: data/app.sqlite")], "id, severity, title"),
)

_BODY = "def {n}(a):\n    x = a + 1\n    y = x * 2\n    z = y - 3\n    w = z / 4\n    v = w ** 5\n    return v\n"


def _functions(spark, base):  # noqa: ANN001, ANN202
    from codequarry.sources import pyast as A

    t = spark.createDataFrame([("a.py", "import os\n\n" + _BODY.format(n="one")), ("b.py", "\n\n" + _BODY.format(n="two")), ("c.py", "def other():\n    return 1\n")], "path string, text string")
    f = spark.createDataFrame([_file("a.py"), _file("b.py"), _file("c.py")], FILES)
    return findings.repeated_functions(t, A.symbols_of(A.parse_files(t)), f)


R.add("sort_repeated", lambda s, b: findings.number([_functions(s, b)])[0].select("id", "title"), _values([("repeated-logic-1", "2 identical copies of a function (one, two)")], "id, title"))


@R.query(_values([("class", "Big", 1, 2), ("method", "Big.m0", 3, 35), ("method", "Big.m1", 36, 68)], "kind, symbol, start_line, end_line"))
def join_interval_methods(spark, base):  # noqa: ANN001, ANN201
    from codequarry.operators import chunking
    from codequarry.sources import pyast as A

    text = "class Big:\n    x = 1\n" + "".join(f"    def m{i}(self):\n" + "        a = 1\n" * 32 for i in range(2))
    t = spark.createDataFrame([("big.py", text)], "path string, text string")
    return chunking.symbol_chunks(t, A.symbols_of(A.parse_files(t))).select("kind", "symbol", "start_line", "end_line")


# ---- evaluation on literals ----
def _docs(spark):  # noqa: ANN001, ANN202
    f = spark.createDataFrame([(p,) for p in ("README.md", "docs/guide.md", "docs/changelog.md", "src/flask/app.py", "src/flask/cli.py", "tests/app.py", "pkg/util.py")], "path string")
    t = spark.createDataFrame([("README.md", "See ./src/flask/app.py and cli.py."), ("docs/guide.md", "Use pkg.util here; app.py is ambiguous."), ("docs/changelog.md", "src/flask/x.py")], "path string, text string")
    return f, t, spark.createDataFrame([(p,) for p in ("src/flask/app.py", "src/flask/cli.py", "tests/app.py", "pkg/util.py")], "path string")


R.add("join_mention_unique", lambda s, b: evaluate.docs_mentioned(*_docs(s)), _values([("src/flask/app.py",), ("src/flask/cli.py",), ("pkg/util.py",)], "path"))
R.add("join_dotted_unique", lambda s, b: evaluate.docs_mentioned(*_docs(s)).filter("path LIKE 'pkg/%'"), _values([("pkg/util.py",)], "path"))
R.add("eval_baselines", lambda s, b: relational._baselines(s, b).filter("rank = 1").select("ranking", "repo", "item"), f"WITH {relational._PART}, {relational._BASEL} SELECT ranking, repo, item FROM rk WHERE rank = 1")


@R.query(_values([(2, 2, 1, 2)], "covered, linked, top_1, top_3"))
def agg_ownership_eval(spark, base):  # noqa: ANN001, ANN201
    d = spark.createDataFrame([("src", ["ann"]), ("docs", ["bob"])], "path string, handles array<string>")
    o = spark.createDataFrame([("src", 1, "a1"), ("src", 2, "a2"), ("docs", 1, "a1"), ("docs", 2, "a2")], "path string, rn int, owner string")
    ln = spark.createDataFrame([("ann", "a1"), ("bob", "a2")], "handle string, id string")
    return evaluate.ownership_vs_owners(d, o, ln)


# ---- sources, sinks, control ----
def _scratch(spark, name: str) -> str:  # noqa: ANN001
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{os.getpid()}"


def _lines(spark, name: str, rows: list[str]) -> str:  # noqa: ANN001
    out = _scratch(spark, name)
    spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.mode("overwrite").text(out)
    return out


R.add("scan_repo_list", lambda s, b: X.repo_list(s, _lines(s, "repos", ["# list", "", " https://github.com/a/b ", "https://github.com/c/d"])), _values([("https://github.com/a/b",), ("https://github.com/c/d",)], "value"))
R.add("scan_features_json", lambda s, b: X.features_json(s, _lines(s, "features", ['[{"repo": "a/b", "files": [{"path": "x.py", "fanIn": 3}], "docsMentioned": ["x.py"], "newcomerFiles": []}]'])).select("repo", F.col("files")[0]["fanIn"].alias("fan_in"), F.size("docsMentioned").alias("docs")), _values([("a/b", 3, 1)], "repo, fan_in, docs"))
R.add("scan_report_json", lambda s, b: X.report_json(s, _lines(s, "report", ['{"schemaVersion":"0.1"}'])).select(F.trim(F.regexp_replace("value", "\n$", "")).alias("value")), _values([('{"schemaVersion":"0.1"}',)], "value"))


@R.query("SELECT 'a' AS id, 'DONE' AS status")
def sink_report_db(spark, base):  # noqa: ANN001, ANN201
    out = _scratch(spark, "status")
    X.append_status(spark.createDataFrame([("a", 1, "QUEUED", None), ("a", 2, "RUNNING", None), ("a", 3, "DONE", "{}")], "id string, at int, status string, report string"), out)
    return jobs.latest(spark.read.parquet(out), key="id", at="at").select("id", "status")


@R.query("SELECT p_brand AS repo, count(*) AS items FROM part GROUP BY 1")
def sink_eval_json(spark, base):  # noqa: ANN001, ANN201
    out = _scratch(spark, "eval")
    r = table(spark, base, "part").groupBy(F.col("p_brand").alias("repo")).agg(F.count(F.lit(1)).alias("items"))
    X.write_eval(r, r, out)
    return spark.read.schema("repo string, items long").json(f"{out}/results.json")


@R.query("SELECT CAST(count(*) AS varchar) AS files FROM files")
def sink_ui_download(spark, base):  # noqa: ANN001, ANN201
    out = _scratch(spark, "download")
    X.write_report(X.assemble({"overview": overview.overview(table(spark, base, "files"))}), out)
    return X.report_json(spark, out).select(F.get_json_object("value", "$.overview.files").alias("files"))


R.add("fn_db_url", lambda s, b: s.createDataFrame([(k, v) for k, v in X.database_url("postgres://u:p%40@h:6543/db?sslmode=require").items()], "k string, v string"), _values([("url", "jdbc:postgresql://h:6543/db?sslmode=require"), ("user", "u"), ("password", "p@")], "k, v"))
R.add("clamp_limit", lambda s, b: s.range(0, 130, 13).select("id", F.least(F.greatest("id", F.lit(1)), F.lit(20)).alias("n")), "SELECT i AS id, least(greatest(i, 1), 20) AS n FROM range(0, 130, 13) AS t(i)")


@R.query(_values([(2,)], "n"))
def src_clone(spark, base):  # noqa: ANN001, ANN201
    with G.clone(textual.demo_repo(spark)) as bare:
        n = G.read_git(spark, bare, "commits").count()
    return spark.createDataFrame([(n,)], "n int")


@R.query(_values([(40, True)], "n, refused"))
def src_open_local(spark, base):  # noqa: ANN001, ANN201
    try:
        G.open_local(_scratch(spark, "nothing"))
        refused = False
    except ValueError:
        refused = True
    return spark.createDataFrame([(len(G.open_local(textual.demo_repo(spark))), refused)], "n int, refused boolean")


@R.query(_values([("Nothing in this repository matched the question.", 0), ("No language model is configured; these are the matching sources.", 0), (None, 1)], "note, citations"))
def qa_answer(spark, base):  # noqa: ANN001, ANN201
    hits = spark.createDataFrame([("a.py:1-5", "a.py", 1, 5, "x = 1")], "location string, path string, start_line int, end_line int, body string")
    out = [search.answer("q", hits.limit(0)), search.answer("q", hits), search.answer("q", hits, lambda _: "see a.py:1-5")]
    return spark.createDataFrame([(o["note"], len(o["citations"])) for o in out], "note string, citations int")


@R.query(_values([(3, "ok")], "attempts, value"))
def state_retry(spark, base):  # noqa: ANN001, ANN201
    seen = []

    def call() -> str:
        seen.append(1)
        if len(seen) < 3:
            raise OSError("busy")
        return "ok"

    value = jobs.with_retries(call, pause=0)
    return spark.createDataFrame([(len(seen), value)], "attempts int, value string")

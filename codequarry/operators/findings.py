"""Rule-based findings with evidence: detectors, numbering, caps.

The tables have a column ``repo``, and every key and group begins with it: findings are those of one repository each,
however many are in a run. Where no table has it, all are of one repository and the findings don't have it either."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import paths as P
from codequarry.functions import text as T
from codequarry.operators import duplicates, graph
from codequarry.operators.imports import scoped
from codequarry.session import cut

#: Fixed order of kinds and cap of each.
KINDS = ["duplicate-module", "repeated-logic", "import-cycle", "generated-file-committed", "missing-tests", "unreferenced-file"]
CAP = 50
EVIDENCE = "struct<path:string,start_line:int,end_line:int,note:string>"


def _per_repo(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @wraps(fn)
    def run(*frames: DataFrame, **kw: object) -> DataFrame:
        out = fn(*map(scoped, frames), **kw)
        return out if any("repo" in f.columns for f in frames) else out.drop("repo")

    return run


def _ev(path: Column, start: Column | None = None, end: Column | None = None, note: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(path.alias("path"), (none if start is None else start).cast("int").alias("start_line"), (none if end is None else end).cast("int").alias("end_line"), (none if note is None else note).cast("string").alias("note"))


def _whole(path: Column, lines: Column) -> Column:
    return _ev(path, F.when(lines > 0, 1), F.when(lines > 0, lines))


def _frame(df: DataFrame, kind: str, severity: Column | str, title: Column, evidence: Column, *order: Column) -> DataFrame:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return df.select("repo", F.lit(kind).alias("kind"), sev.alias("severity"), title.alias("title"), evidence.alias("evidence"), F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))).alias("sort_key"))


def files_for_duplicates(files: DataFrame, texts: DataFrame, least: int = 10) -> DataFrame:
    f = files.filter(P.is_code(F.lower("language")) & ~F.col("is_test") & F.col("generated_reason").isNull() & ~F.col("is_binary") & F.col("skip_reason").isNull() & (F.col("non_blank_lines") >= least))
    return f.select("repo", "path").join(texts.select("repo", "path", "text"), ["repo", "path"])


@_per_repo
def near_duplicates(files: DataFrame, texts: DataFrame) -> DataFrame:
    """Groups of files that share at least ten significant lines and 80 % of the smaller one."""
    f = files_for_duplicates(files, texts).withColumn("key", F.struct("repo", "path"))
    g = duplicates.duplicate_groups(duplicates.line_pairs(f, key="key", text="text", scope="repo"))
    g = g.select(F.col("component.repo").alias("repo"), F.col("members.path").alias("members"), "size")
    nm = lambda i: P.base_name(F.col("members")[i])
    title = F.when(F.col("size") == 2, F.concat(F.lit("Near-duplicate files: "), nm(0), F.lit(" and "), nm(1))).otherwise(F.concat(F.col("size").cast("string"), F.lit(" near-duplicate files named like "), nm(0)))
    return _frame(g, KINDS[0], "warn", title, F.transform("members", lambda m: _ev(m)), F.lit(0), -F.col("size"), title)


@_per_repo
def same_name_nested(files: DataFrame, edges: DataFrame, grouped: DataFrame) -> DataFrame:
    """Python modules of one name, one directory above the other, without an import between them; pairs both of whose
    paths are in some duplicate group are left out."""
    f = files.filter((F.lower("language") == "python") & ~F.col("is_test") & F.col("generated_reason").isNull() & ~P.is_entry_point(F.col("path")))
    f = f.select("repo", "path", "lines", P.base_name(F.col("path")).alias("name"), P.dir_name(F.col("path")).alias("dir"))
    # a directory's ancestors are few: equi-join on (name, ancestor) instead of all pairs of a name
    up = F.filter(F.concat(F.array(F.lit("")), F.transform(P.ancestors(F.concat("dir", F.lit("/x"))), lambda d: F.when(d == ".", "").otherwise(d))), lambda d: d != F.col("dir"))
    low = f.select("repo", "name", F.col("path").alias("b"), F.col("lines").alias("lb"), F.explode(F.array_distinct(up)).alias("dir"))
    p = f.withColumnRenamed("path", "a").withColumnRenamed("lines", "la").join(low, ["repo", "name", "dir"])
    e = edges.select("repo", F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct()
    p = p.withColumn("x", F.least("a", "b")).withColumn("y", F.greatest("a", "b")).join(e, ["repo", "x", "y"], "left_anti")
    g = grouped.select("repo", "path").distinct()
    p = p.join(g.select("repo", F.col("path").alias("a"), F.lit(True).alias("ga")), ["repo", "a"], "left").join(g.select("repo", F.col("path").alias("b"), F.lit(True).alias("gb")), ["repo", "b"], "left").filter(F.col("ga").isNull() | F.col("gb").isNull())
    ev = F.when(F.col("a") < F.col("b"), F.array(_whole(F.col("a"), F.col("la")), _whole(F.col("b"), F.col("lb")))).otherwise(F.array(_whole(F.col("b"), F.col("lb")), _whole(F.col("a"), F.col("la"))))
    return _frame(p, KINDS[0], "info", F.concat(F.lit("Two modules named "), F.col("name")), ev, F.lit(1), F.col("name"), F.col("x"), F.col("y"))


@_per_repo
def repeated_functions(texts: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Functions with identical bodies of six or more lines in two or more files, outer ones only."""
    ok = files.filter(~F.col("is_test") & F.col("generated_reason").isNull()).select("repo", "path")
    o = duplicates.outermost(duplicates.repeated_bodies(texts, symbols.join(ok, ["repo", "path"], "left_semi")))
    g = o.groupBy("repo", "body_hash").agg(F.sort_array(F.collect_list(F.struct("path", "start_line", "end_line", "name"))).alias("occ"), F.max("body_lines").alias("n"), F.max("copies").alias("copies"))
    names = F.array_distinct(F.transform("occ", lambda x: x["name"]))
    title = F.concat(F.col("copies").cast("string"), F.lit(" identical copies of "), F.when(F.size(names) == 1, F.concat(F.lit("function "), names[0])).otherwise(F.concat(F.lit("a function ("), F.array_join(names, ", "), F.lit(")"))))
    return _frame(g, KINDS[1], "info", title, F.transform("occ", lambda x: _ev(x["path"], x["start_line"], x["end_line"])), F.lit(0), -(F.col("n") * F.col("copies")), F.col("occ")[0]["path"], F.col("occ")[0]["start_line"])


@_per_repo
def similar_names(files: DataFrame, least_files: int = 3) -> DataFrame:
    """Name stems carried by three or more files in two or more areas."""
    f = files.filter(testable() & ~F.col("is_test")).select("repo", "path", "lines", P.name_stem(F.col("path")).alias("stem"), P.area(F.col("path")).alias("area"))
    f = f.filter((F.length("stem") >= 3) & ~F.col("stem").isin(P.GENERIC_STEMS))
    n = f.groupBy("repo", "stem").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("area").alias("areas")).filter((F.col("n") >= least_files) & (F.col("areas") >= 2))
    g = f.join(n, ["repo", "stem"]).groupBy("repo", "stem").agg(F.max("n").alias("n"), F.max("areas").alias("areas"), F.sort_array(F.collect_list(_whole(F.col("path"), F.col("lines")))).alias("ev"))
    title = F.concat(F.col("n").cast("string"), F.lit(' files named after "'), F.col("stem"), F.lit('" in '), F.col("areas").cast("string"), F.lit(" areas"))
    return _frame(g, KINDS[1], "info", title, F.col("ev"), F.lit(1), -F.col("n"), F.col("stem"))


@_per_repo
def import_cycles(edges: DataFrame) -> DataFrame:
    """One finding per strongly connected group of directories, with an example import for each inner dependency."""
    d = cut(graph.directory_edges(edges, lambda c: F.when(F.instr(c, "/") > 0, P.dir_name(c)).otherwise(c)))
    node = lambda c: F.struct("repo", F.col(c).alias("dir"))
    e = d.select(node("src").alias("src"), node("dst").alias("dst"))
    comp = cut(graph.scc(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct(), e).select(F.col("node.repo").alias("repo"), F.col("node.dir").alias("node"), F.col("component.dir").alias("component")))
    inner = d.join(comp.select("repo", F.col("node").alias("src"), F.col("component").alias("c1")), ["repo", "src"]).join(comp.select("repo", F.col("node").alias("dst"), F.col("component").alias("c2")), ["repo", "dst"]).filter("c1 = c2")
    lines = edges.select("repo", F.col("src").alias("example_src"), F.col("dst").alias("example_dst"), "first_line")
    inner = inner.join(lines, ["repo", "example_src", "example_dst"], "left")
    g = inner.groupBy("repo", F.col("c1").alias("component")).agg(F.sort_array(F.collect_list(_ev(F.col("example_src"), F.col("first_line"), F.col("first_line"), F.concat(F.lit("imports "), "example_dst")))).alias("ev"))
    m = comp.groupBy("repo", "component").agg(F.sort_array(F.collect_list("node")).alias("dirs"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    j = m.join(g, ["repo", "component"])
    title = F.concat(F.lit("Import cycle between "), F.col("n").cast("string"), F.lit(" directories: "), F.array_join("dirs", ", "))
    return _frame(j, KINDS[2], "warn", title, F.col("ev"), F.lit(0), -F.col("n"), F.col("dirs")[0])


def _sample(ps: Column, n: Column, most: int = 10) -> Column:
    head = F.transform(F.slice(ps, 1, most), lambda p: _ev(p))
    return F.when(n > most, F.concat(head, F.array(_ev(F.lit(None).cast("string"), note=F.concat(F.lit("and "), (n - most).cast("string"), F.lit(" more")))))).otherwise(head)


@_per_repo
def committed_generated(files: DataFrame) -> DataFrame:
    """Environment files, generated files by reason, database files."""
    f = files.select("repo", "path", "generated_reason", P.local_file_kind(F.col("path")).alias("local"), P.is_test(F.col("path")).alias("t"))
    env = f.filter(F.col("local") == "environment file")
    e = _frame(env, KINDS[3], F.when(F.col("t"), "info").otherwise("warn"), F.concat(F.when(F.col("t"), "Environment file committed in tests: ").otherwise("Environment file committed: "), "path"), F.array(_ev(F.col("path"))), F.lit(0), F.lit(-1), F.col("path"))

    def grouped(d: DataFrame, key: str) -> DataFrame:
        # only the ten smallest paths of a reason are reported: the limit is applied before and after the shuffle
        w = Window.partitionBy("repo", key).orderBy("path")
        top = d.withColumn("rn", F.row_number().over(w)).filter("rn <= 10").groupBy("repo", key).agg(F.sort_array(F.collect_list("path")).alias("ps"))
        return d.groupBy("repo", key).agg(F.count(F.lit(1)).alias("n")).join(top, ["repo", key])

    gen = grouped(f.filter("generated_reason is not null"), "generated_reason")
    on_purpose = F.col("generated_reason").isin("marked as generated", "minified file", "source map")
    shown = F.least(F.col("n"), F.lit(11))
    g = _frame(
        gen, KINDS[3], F.when(on_purpose, "info").otherwise("warn"),
        F.when(F.col("n") == 1, F.concat(F.lit("Generated file committed ("), "generated_reason", F.lit("): "), F.col("ps")[0])).otherwise(F.concat(F.col("n").cast("string"), F.lit(" generated files committed ("), "generated_reason", F.lit(")"))),
        _sample(F.col("ps"), F.col("n")), F.when(on_purpose, 2).otherwise(1), -shown, F.col("generated_reason"),
    )
    db = grouped(f.filter(F.col("local") == "database file"), "local")
    b = _frame(db, KINDS[3], "info", F.when(F.col("n") == 1, F.concat(F.lit("Database file committed: "), F.col("ps")[0])).otherwise(F.concat(F.col("n").cast("string"), F.lit(" database files committed"))), _sample(F.col("ps"), F.col("n")), F.lit(2), -F.least(F.col("n"), F.lit(11)), F.lit("~"))
    return e.unionByName(g).unionByName(b)


def testable() -> Column:
    """Code a unit test could exercise."""
    return P.is_code(F.lower("language")) & F.col("generated_reason").isNull() & ~F.lower("language").isin("css", "html")


@_per_repo
def missing_tests(files: DataFrame, edges: DataFrame, least: int = 300) -> DataFrame:
    """Areas of 300 or more lines of code without tests inside and not imported by a test elsewhere."""
    f = files.withColumn("area", P.area(F.col("path")))
    src = f.filter(~F.col("is_test") & testable())
    total = src.groupBy("repo", "area").agg(F.sum("lines").alias("n")).filter(F.col("n") >= least).filter((F.col("area") != "(root)") & ~P.base_name(F.col("area")).isin(P.ENTRY_DIRS))
    inside = f.filter("is_test").select("repo", "area").distinct()
    tests = f.filter("is_test").select("repo", F.col("path").alias("src"))
    outside = edges.join(tests, ["repo", "src"], "left_semi").select("repo", P.area(F.col("dst")).alias("area")).distinct()
    bare = total.join(inside, ["repo", "area"], "left_anti").join(outside, ["repo", "area"], "left_anti")
    w = Window.partitionBy("repo", "area").orderBy(F.desc("lines"), "path")
    top = src.join(bare.select("repo", "area"), ["repo", "area"], "left_semi").withColumn("rn", F.row_number().over(w)).filter("rn <= 5")
    g = top.groupBy("repo", "area").agg(F.sort_array(F.collect_list(F.struct("rn", _whole(F.col("path"), F.col("lines")).alias("e")))).alias("es"), F.sum("lines").alias("shown"))
    return _frame(g, KINDS[4], "info", F.concat(F.lit("No tests found for "), "area"), F.transform("es", lambda x: x["e"]), F.lit(0), -F.col("shown"), F.col("area"))


@_per_repo
def unreferenced(files: DataFrame, texts: DataFrame, edges: DataFrame, parsed: DataFrame, group_from: int = 4) -> DataFrame:
    """Python files that no non-test file imports and that look like no entry point."""
    key = ["repo", "path"]
    f = files.filter((F.lower("language") == "python") & ~F.col("is_test") & F.col("generated_reason").isNull()).join(parsed.select(*key).distinct(), key, "left_semi")
    tests = files.filter("is_test").select("repo", F.col("path").alias("src"))
    by_code = edges.join(tests, ["repo", "src"], "left_anti").select("repo", F.col("dst").alias("path")).distinct()
    conf = texts.join(files.filter(P.base_name(F.col("path")).isin("pyproject.toml", "setup.cfg", "setup.py") & ~F.col("is_binary") & F.col("skip_reason").isNull()).select(*key), key, "left_semi")
    mods = conf.select("repo", F.explode(T.config_modules(F.col("text"))).alias("m")).distinct()
    c = f.join(by_code, key, "left_anti").filter(~P.is_entry_point(F.col("path")))
    declared = c.select(*key, F.explode(P.dotted_suffixes(F.col("path"), 1)).alias("m")).join(mods, ["repo", "m"], "left_semi").select(*key).distinct()
    guarded = texts.filter(F.col("text").rlike(T.MAIN_GUARD)).select(*key)
    c = c.join(declared, key, "left_anti").join(guarded, key, "left_anti")
    by_test = edges.groupBy("repo", F.col("dst").alias("path")).agg(F.count_distinct("src").alias("tests"))
    c = cut(c.select(*key, "lines").join(by_test, key, "left"))
    none = c.filter("tests is null")
    out = _frame(none, KINDS[5], "info", F.concat(F.lit("No static import found: "), "path"), F.array(_whole(F.col("path"), F.col("lines"))), F.lit(0), -F.col("lines"), F.col("path"))
    only = c.filter("tests is not null")
    n = only.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    many, few = only.join(n.filter(F.col("n") >= group_from), "repo"), only.join(n.filter(F.col("n") < group_from), "repo")
    # the modules that only tests import are one finding where they are many; it shows as many as a kind may have findings
    w = Window.partitionBy("repo").orderBy(F.desc("lines"), "path")
    shown = many.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= CAP).groupBy("repo").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct((-F.col("lines")).alias("o"), "path", "lines"))).alias("es"))
    grouped = _frame(shown, KINDS[5], "info", F.concat(F.col("n").cast("string"), F.lit(" modules are imported only by tests")), F.transform("es", lambda x: _whole(x["path"], x["lines"])), F.lit(1), F.lit(0), F.lit(""))
    single = _frame(few, KINDS[5], "info", F.concat(F.lit("Only tests import "), "path"), F.array(_whole(F.col("path"), F.col("lines"))), F.lit(1), -F.col("lines"), F.col("path"))
    return out.unionByName(grouped).unionByName(single)


def number(findings: list[DataFrame], cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """(findings, omitted): ids kind-1, kind-2, ... per repository and kind, at most ``cap`` each; what is over the cap is
    counted.

    Of each detector only the first ``cap`` findings of a kind are ordered, a limit applied before and after the shuffle;
    sort keys of detectors differ in type, so they are compared as ranks within their detector."""
    tops, counts = [], []
    by = ["repo", "kind"]
    many = any("repo" in d.columns for d in findings)
    for i, d in enumerate(map(scoped, findings)):
        w = Window.partitionBy(*by).orderBy("sort_key")
        tops.append(d.withColumn("part", F.col("sort_key.o0") * 0 + F.lit(i)).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= cap).drop("sort_key"))
        counts.append(d.groupBy(*by).agg(F.count(F.lit(1)).alias("n")))
    allf, total = tops[0], counts[0]
    for p, c in zip(tops[1:], counts[1:]):
        allf, total = allf.unionByName(p), total.unionByName(c)
    n = allf.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("part", "r")))
    kept = n.filter(F.col("n") <= cap).select("repo", F.concat_ws("-", "kind", "n").alias("id"), "kind", "severity", "title", "evidence", "n")
    omitted = total.groupBy(*by).agg((F.sum("n") - cap).alias("omitted")).filter("omitted > 0")
    return (kept, omitted) if many else (kept.drop("repo"), omitted.drop("repo"))

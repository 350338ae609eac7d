"""Resolution of Python imports to files, as candidate rows, an equi-join and a best pick.

A path names a file within its repository only: ``repo`` is part of every join key and group, so repositories of one run
never see each other's modules, and a module name that all of them use (``utils``, ``app``) is many small keys instead of
a hot one. Tables without the column are one repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions.paths import ancestors, dir_name, dotted_suffixes, shared_dirs
from codequarry.session import cut


def scoped(df: DataFrame) -> DataFrame:
    """The table with a column ``repo``; one that has none is one repository without a name."""
    return df.withColumn("repo", F.coalesce(F.col("repo").cast("string"), F.lit(""))) if "repo" in df.columns else df.withColumn("repo", F.lit(""))


def source_roots(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(package directories, source roots), both with repo: the root of the repository and parents of packages that are
    none."""
    f = scoped(files)
    pk = f.filter(F.col("path").rlike(r"/__init__\.pyi?$")).select("repo", dir_name(F.col("path")).alias("dir")).distinct()
    up = pk.select("repo", dir_name(F.col("dir")).alias("root")).distinct()
    roots = up.join(pk.withColumnRenamed("dir", "root"), ["repo", "root"], "left_anti").union(f.select("repo", F.lit("").alias("root"))).distinct()
    return pk, roots


def _probe(base: Column, dotted: Column) -> Column:
    """The four files a module name may be, in order of preference."""
    p = F.concat(F.when(base == "", "").otherwise(F.concat(base, F.lit("/"))), F.replace(dotted, F.lit("."), F.lit("/")))
    return F.array(F.concat(p, F.lit("/__init__.py")), F.concat(p, F.lit(".py")), F.concat(p, F.lit("/__init__.pyi")), F.concat(p, F.lit(".pyi")))


def module_index(files: DataFrame) -> DataFrame:
    """(repo, root, dotted, nth, target): every file under the name it has below each directory above it.

    nth is Python's preference: package, module, package stub, module stub. A file has one row per directory of its
    path, so looking a module up is an equi-join on its dotted name, never a trial of every root."""
    nth = F.when(F.col("path").endswith("/__init__.py"), 0).when(F.col("path").endswith("/__init__.pyi"), 2).when(F.col("path").endswith(".pyi"), 3).otherwise(1)
    up = F.transform(ancestors(F.col("path")), lambda d: F.when(d == ".", "").otherwise(d))
    below = files.filter(F.col("path").rlike(r"\.pyi?$")).select("repo", F.col("path").alias("target"), nth.alias("nth"), F.explode(up).alias("root"))
    rel = F.when(F.col("root") == "", F.col("target")).otherwise(F.substring(F.col("target"), F.length("root") + 2, F.length("target")))
    name = F.replace(F.regexp_replace(rel, r"(/__init__)?\.pyi?$", ""), F.lit("/"), F.lit("."))
    return below.select("repo", "root", name.alias("dotted"), "nth", "target").filter(~rel.rlike(r"^__init__\.pyi?$"))


def _best(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Of each question one hit: per root the first file of the preference, then most shared directories, then path."""
    per_root = hits.groupBy(*keys, "root", "via").agg(F.min_by("target", "nth").alias("target"))
    shared = shared_dirs(F.col("path"), F.col("target"))
    top = per_root.groupBy(*keys).agg(F.min(F.struct((-shared).alias("s"), "target", F.col("via").alias("method"))).alias("b"))
    return top.select(*keys, "b.target", "b.method")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """([repo,] path, ord, line, module, target_path, external, method), one row per target of a statement.

    ``imports``: [repo,] path, ord, line, from_import, level, module, names. Rules, within a repository: absolute names
    are looked up under every source root, and under the importer's directory if that is a script's; ``import a.b.c``
    falls back to its longest existing prefix; ``from m import n`` means the submodule where one exists, else the module
    once; relative imports walk up; a dotted name that matches the end of exactly one file is accepted; else it is
    external if its first part lies under no root.
    """
    many = "repo" in files.columns
    files = cut(scoped(files).select("repo", "path").filter("path is not null").distinct())
    pk, roots = source_roots(files)
    st = cut(scoped(imports).select("repo", "path", "ord", "line", "from_import", "level", F.coalesce("module", F.lit("")).alias("module"), F.coalesce("names", F.array().cast("array<string>")).alias("names")))
    key = ["repo", "path", "ord"]
    absolute = st.filter("level = 0")
    # questions: (repo, path, ord, i, prio): the lower prio that hits wins
    parts = F.split("module", r"\.")
    prefixes = absolute.filter("not from_import").select(*key, F.lit(-1).alias("i"), F.posexplode(F.reverse(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), ".")))).alias("prio", "dotted"))
    subs = absolute.filter("from_import").select(*key, "module", F.posexplode("names").alias("i", "n")).filter("n <> '*'").select(*key, "i", F.lit(0).alias("prio"), F.concat_ws(".", "module", "n").alias("dotted"))
    mods = absolute.filter("from_import").select(*key, F.lit(-1).alias("i"), F.lit(0).alias("prio"), F.col("module").alias("dotted"))
    tops = absolute.select(*key, F.lit(-2).alias("i"), F.lit(0).alias("prio"), F.substring_index("module", ".", 1).alias("dotted"))
    ask = prefixes.unionByName(subs).unionByName(mods).unionByName(tops)
    d = dir_name(F.col("path"))
    script = st.select("repo", "path").distinct().withColumn("root", d).join(pk.withColumnRenamed("dir", "root"), ["repo", "root"], "left_anti").join(roots, ["repo", "root"], "left_anti").withColumn("via", F.lit("script-dir"))
    index = cut(module_index(files))
    rooted = index.join(roots, ["repo", "root"], "left_semi").withColumn("via", F.lit("root"))
    under = ask.join(rooted, ["repo", "dotted"])
    under = under.unionByName(ask.join(script, ["repo", "path"]).join(index, ["repo", "root", "dotted"]).select(under.columns))
    hits = cut(_best(under, [*key, "i", "prio", "dotted"]))
    # plain imports: longest prefix
    plain = hits.filter("i = -1").groupBy(*key).agg(F.min_by(F.struct("dotted", "target", "method"), "prio").alias("h"))
    top_hit = hits.filter("i = -2").select(*key, F.lit(True).alias("top_known")).distinct()
    own = files.join(files.select("repo", F.concat("path", F.lit("i")).alias("path")), ["repo", "path"], "left_anti")
    suffix = own.select("repo", "path", F.explode(dotted_suffixes(F.col("path"))).alias("module")).groupBy("repo", "module").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("sfx")).filter("n = 1").drop("n")
    whole = absolute.select(*key, "line", "from_import", "module", "names").join(plain, key, "left").join(top_hit, key, "left").join(suffix, ["repo", "module"], "left")
    target = F.coalesce("h.target", "sfx")
    module = F.coalesce("h.dotted", "module")
    method = F.coalesce("h.method", F.when(F.col("sfx").isNotNull(), "suffix"))
    base = whole.select(*key, "line", "from_import", "names", module.alias("m"), target.alias("t"), (target.isNull() & F.col("top_known").isNull()).alias("ext"), method.alias("how"))
    by_name = base.filter("from_import").select("*", F.posexplode(F.when(F.size("names") > 0, F.col("names")).otherwise(F.array(F.lit("*")))).alias("i", "n")).join(
        hits.filter("i >= 0").select(*key, "i", "dotted", "target", "method"), [*key, "i"], "left"
    )
    from_rows = by_name.select(*key, "line", "i", F.coalesce("dotted", "m").alias("module"), F.coalesce("target", "t").alias("target_path"), (F.col("target").isNull() & F.col("ext")).alias("external"), F.coalesce("method", "how").alias("method"))
    plain_rows = base.filter("not from_import").select(*key, "line", F.lit(0).alias("i"), F.col("m").alias("module"), F.col("t").alias("target_path"), F.col("ext").alias("external"), F.col("how").alias("method"))
    rel = _relative(st.filter("level > 0"), files)
    every = from_rows.unionByName(plain_rows).unionByName(rel)
    w = Window.partitionBy(*key, F.coalesce("target_path", F.concat(F.lit("?"), "module"))).orderBy("i")
    out = every.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select(*key, "line", "module", "target_path", "external", "method")
    return out if many else out.drop("repo")


def _relative(st: DataFrame, files: DataFrame) -> DataFrame:
    key = ["repo", "path", "ord"]
    d = F.split(dir_name(F.col("path")), "/")
    depth = F.when(dir_name(F.col("path")) == "", 0).otherwise(F.size(d))
    up = F.col("level") - 1
    r = st.withColumn("depth", depth).withColumn("above", up > F.col("depth")).withColumn("base", F.when(up >= F.col("depth"), "").otherwise(F.array_join(F.slice(d, 1, F.greatest(F.lit(0), F.col("depth") - up)), "/"))).withColumn("dots", F.expr("repeat('.', level)"))
    r = cut(r)
    pkg = F.when(F.col("base") == "", F.array(F.lit("__init__.py"), F.lit("__init__.pyi"))).otherwise(F.array(F.concat("base", F.lit("/__init__.py")), F.concat("base", F.lit("/__init__.pyi"))))
    mod_probe = r.filter("not above").select(*key, F.posexplode(F.when(F.col("module") == "", pkg).otherwise(_probe(F.col("base"), F.col("module")))).alias("o", "target"))
    f = files.select("repo", F.col("path").alias("target"))
    mod = mod_probe.join(f, ["repo", "target"]).groupBy(*key).agg(F.min_by("target", "o").alias("mt"))
    named = r.filter("not above").select(*key, "base", "module", F.posexplode("names").alias("i", "n")).filter("n <> '*'").withColumn("dotted", F.when(F.col("module") == "", F.col("n")).otherwise(F.concat_ws(".", "module", "n")))
    sub = named.select(*key, "i", "dotted", F.posexplode(_probe(F.col("base"), F.col("dotted"))).alias("o", "target")).join(f, ["repo", "target"]).groupBy(*key, "i", "dotted").agg(F.min_by("target", "o").alias("target"))
    got = sub.groupBy(*key).agg(F.count(F.lit(1)).alias("got"))
    head = r.join(mod, key, "left").join(got, key, "left")
    module_rows = head.filter(F.col("above") | (F.size("names") == 0) | (F.coalesce("got", F.lit(0)) < F.size("names"))).select(
        *key, "line", F.lit(1_000_000).alias("i"), F.concat("dots", "module").alias("module"), F.when(~F.col("above"), F.col("mt")).alias("target_path"), F.lit(False).alias("external"), F.when(F.col("mt").isNotNull() & ~F.col("above"), "relative").alias("method")
    )
    sub_rows = sub.join(r.select(*key, "line", "dots"), key).select(*key, "line", "i", F.concat("dots", "dotted").alias("module"), F.col("target").alias("target_path"), F.lit(False).alias("external"), F.lit("relative").alias("method"))
    return module_rows.unionByName(sub_rows)


def import_edges(resolved: DataFrame) -> DataFrame:
    """([repo,] src, dst, first_line) of distinct resolved imports between different files."""
    scope = ["repo"] if "repo" in resolved.columns else []
    e = resolved.filter("target_path is not null and target_path <> path")
    return e.groupBy(*scope, F.col("path").alias("src"), F.col("target_path").alias("dst")).agg(F.min_by("line", "ord").alias("first_line"))

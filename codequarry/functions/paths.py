"""Row-level rules on repository paths, as Column expressions that stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by extension.
LANGUAGES = {
    "py": "python", "pyi": "python", "java": "java", "kt": "kotlin", "scala": "scala", "js": "javascript", "jsx": "javascript",
    "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "rb": "ruby",
    "php": "php", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp", "swift": "swift", "sh": "shell",
    "bash": "shell", "html": "html", "css": "css", "scss": "css", "sql": "sql", "md": "markdown", "rst": "restructuredtext",
    "json": "json", "yml": "yaml", "yaml": "yaml", "toml": "toml", "xml": "xml", "ipynb": "jupyter",
}
# Languages that are documentation or data.
NON_CODE = ["markdown", "restructuredtext", "json", "yaml", "toml", "xml", "jupyter"]
# Directories of caches and environments; extensions that count as build output; templates of env files.
CACHE_DIRS = ["__pycache__", "node_modules", ".pytest_cache", ".mypy_cache", ".tox", "htmlcov", ".ipynb_checkpoints", ".venv", "venv"]
BUILD_OUTPUT = ["js", "css", "html", "map", "pyc", "so", "o", "class", "jar", "whl", "gz", "zip"]
ENV_TEMPLATES = [".env.example", ".env.sample", ".env.template", ".env.dist"]
# File names and directories of entry points.
ENTRY_NAMES = ["__init__.py", "__main__.py", "setup.py", "conftest.py", "manage.py", "wsgi.py", "asgi.py"]
ENTRY_DIRS = ["scripts", "bin", "examples", "docs", "migrations", "benchmarks", "benchmark", "bench"]
# First directories whose children are areas of their own.
CONTAINERS = ["src", "lib", "libs", "packages", "services", "apps", "modules", "components"]
# Words of file names that name a role, and stems that say nothing.
ROLE_WORDS = ["service", "services", "client", "clients", "tool", "tools", "api", "helper", "helpers", "util", "utils", "wrapper", "manager", "handler", "adapter"]
GENERIC_STEMS = (
    "app main index init config settings models model views view base core types constants routes router server cli db database schemas schema "
    "setup logger logging errors exceptions middleware auth user users common shared store hooks components styles style test tests conftest requirements"
).split()


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_parts(path: Column) -> Column:
    """Directories of a path, from the root; empty for a file at the root."""
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def dir_name(path: Column, root: str = "") -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(root)


def component_of(path: Column) -> Column:
    """The directory, ``.`` at the root."""
    return dir_name(path, ".")


def language(path: Column) -> Column:
    """By the last extension, in any case; names that only start or end with a dot have none."""
    ext = F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]+)$", 1))
    return F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))[ext]


def is_code(lang: Column) -> Column:
    return lang.isNotNull() & ~F.coalesce(lang, F.lit("")).isin(NON_CODE)


def is_test(path: Column) -> Column:
    name = base_name(path)
    in_dir = F.exists(dir_parts(path), lambda d: F.lower(d).isin("test", "tests", "__tests__"))
    return in_dir | name.rlike(r"^conftest\.py$|^test_.*\.py$|_test\.py$|\.test\.|\.spec\.|_test\.go$|Tests?\.java$")


def is_private_module(path: Column) -> Column:
    return base_name(path).rlike("^_(?!_)")


def generated_reason(path: Column) -> Column:
    """Why a path looks like build output or a cache; the first directory that says so decides, then the name."""
    low = F.lower(base_name(path))
    ext = F.regexp_extract(low, r"\.([^.]*)$", 1)
    built = ext.isin(BUILD_OUTPUT)
    hits = F.filter(dir_parts(path), lambda d: d.isin(CACHE_DIRS) | d.endswith(".egg-info") | (d.isin("dist", "build") & built))
    d = F.get(hits, F.lit(0))
    return (
        F.when(d.isin("dist", "build"), F.concat(F.lit("build output ("), d, F.lit("/)")))
        .when(d.isNotNull(), F.concat(F.lit("build output or cache ("), d, F.lit("/)")))
        .when(low.rlike(r"\.py[co]$"), "compiled Python")
        .when(low.isin(".coverage", "coverage.xml"), "test coverage output")
        .when(low.rlike(r"\.min\.(js|css)$"), "minified file")
        .when(low.rlike(r"\.(js|css)\.map$"), "source map")
        .when(low.isin(".ds_store", "thumbs.db"), "operating system metadata")
        .when(low.rlike(r"^[0-9a-f]{16,}\.(json|pkl|pickle|bin|npy|npz|joblib|cache|dat)$"), "cache entry (hash-named file)")
    )


def local_file_kind(path: Column) -> Column:
    low = F.lower(base_name(path))
    return F.when(((low == ".env") | low.startswith(".env.")) & ~low.isin(ENV_TEMPLATES), "environment file").when(
        low.rlike(r"\.(sqlite3?|db)$") & (low != "thumbs.db"), "database file"
    )


def is_entry_point(path: Column) -> Column:
    return base_name(path).isin(ENTRY_NAMES) | path.rlike(r"(^|/)docs/conf\.py$") | F.arrays_overlap(dir_parts(path), F.array(*map(F.lit, ENTRY_DIRS)))


def area(path: Column) -> Column:
    """Top directory, or the top two below a container directory; ``(root)`` for files at the root."""
    p = F.split(path, "/")
    n = F.size(p)
    return F.when(n <= 1, "(root)").when((n > 2) & p[0].isin(CONTAINERS), F.concat_ws("/", p[0], p[1])).otherwise(p[0])


def ancestors(path: Column) -> Column:
    """``a/b/c.py`` -> [., a, a/b]."""
    d = dir_parts(path)
    below = F.transform(F.sequence(F.lit(1), F.greatest(F.size(d), F.lit(1))), lambda i: F.array_join(F.slice(d, 1, i), "/"))
    return F.when(F.size(d) > 0, F.concat(F.array(F.lit(".")), below)).otherwise(F.array(F.lit(".")))


def is_ancestor(up: Column, down: Column) -> Column:
    """Strictly above; the root is '' and above every other directory."""
    return (up != down) & ((up == "") | down.startswith(F.concat(up, F.lit("/"))))


def name_stem(path: Column) -> Column:
    name = base_name(path)
    stem = F.when(F.instr(name, ".") > 1, F.substring_index(name, ".", 1)).otherwise(name)
    words = F.split(F.lower(F.regexp_replace(stem, "([a-z0-9])([A-Z])", "$1_$2")), r"[_\-\s]+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(ROLE_WORDS)), "")


def dotted_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"(/__init__)?\.pyi?$", ""), "/", ".")


def dotted_suffixes(path: Column, least: int = 2) -> Column:
    """Every suffix of at least ``least`` parts of the dotted path."""
    parts = F.split(dotted_path(path), r"\.")
    n = F.size(parts)
    return F.when(n >= least, F.transform(F.sequence(F.lit(1), F.greatest(n - least + 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, n), "."))).otherwise(
        F.array().cast("array<string>")
    )


def shared_dirs(a: Column, b: Column) -> Column:
    """Number of common leading directories."""
    pairs = F.arrays_zip(dir_parts(a).alias("x"), dir_parts(b).alias("y"))
    return F.aggregate(
        pairs, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda acc, p: F.struct((acc["n"] + F.when(acc["on"] & (p["x"] == p["y"]), 1).otherwise(0)).alias("n"), (acc["on"] & F.coalesce(p["x"] == p["y"], F.lit(False))).alias("on")),
        lambda acc: acc["n"],
    )


def pattern_to_dir(pattern: Column) -> Column:
    """An ownership pattern reduced to the directory it speaks for."""
    p = F.regexp_replace(F.trim(pattern), "^/", "")
    star = F.instr(p, "*")
    head = F.when(star > 0, F.substring_index(p, "*", 1)).otherwise(p)
    globbed = F.when(F.instr(head, "/") > 0, F.regexp_replace(head, "/[^/]*$", "")).otherwise("")
    no_star = F.when(star > 0, globbed).when(F.instr(p, "?") > 0, p).otherwise(p)
    q = F.regexp_replace(no_star, "/+$", "")
    q = F.when(q.rlike(r".*\.[A-Za-z0-9]+$"), dir_name(q)).otherwise(q)
    return F.when(F.trim(pattern).isin("*", "/", "**") | (q == ""), ".").otherwise(q)


def parse_source_uri(uri: Column, allow_local: bool = True) -> Column:
    """struct(kind, owner, repo): github, local or null (rejected)."""
    u = F.trim(uri)
    rx = r"^https://github\.com/([A-Za-z0-9][A-Za-z0-9-]{0,38})/([A-Za-z0-9._-]{1,100}?)(?:\.git)?/?$"
    owner, repo = F.regexp_extract(u, rx, 1), F.regexp_extract(u, rx, 2)
    hub = (owner != "") & ~repo.isin(".", "..")
    remote = (F.instr(u, "://") > 0) | u.startswith("git@") | (owner != "")
    local = ~remote & (u != "") if allow_local else F.lit(False)
    return F.when(hub, F.struct(F.lit("github").alias("kind"), owner.alias("owner"), repo.alias("repo"))).when(
        local, F.struct(F.lit("local").alias("kind"), F.lit(None).cast("string").alias("owner"), u.alias("repo"))
    )


def source_url(base: Column, commit: Column, path: Column, start: Column, end: Column) -> Column:
    """Link to lines of a file at a commit."""
    lines = F.when(start.isNull(), "").when(end.isNull() | (end == start), F.concat(F.lit("#L"), start)).otherwise(F.concat(F.lit("#L"), start, F.lit("-L"), end))
    return F.concat(base, F.lit("/blob/"), commit, F.lit("/"), path, lines)

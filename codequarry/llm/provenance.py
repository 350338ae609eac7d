"""Generated, minified, vendored and data files: belief propagation over directory trees.

Every file gets log potentials over five labels from its name, its content and older findings; every directory from its
name. The factor between a directory and what lies in it makes neighbours agree. The graph of a repository is a tree, so
two sweeps of sum-product, up and down, give exact marginals. The messages of a directory's files are summed map-side
first, so a directory with a third of all files is one row per task before anything is shuffled; what is left is one row
per directory. Both sweeps of many repositories run in one task over arrays; a repository with more directories than a
task should hold is swept depth by depth over the whole cluster, with the same result. Texts are read where they lie and
leave only a few numbers.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.session import cut

LABELS = ["handwritten", "generated", "minified", "vendored", "blob"]
PRIOR = [0.0, -3.5, -3.5, -3.5, -3.5]

# Directory names that hold third-party code, and build output.
VENDOR_DIRS = "vendor vendored _vendor _vendored third_party third-party thirdparty 3rdparty node_modules bower_components jspm_packages extern external externals site-packages".split()
OUTPUT_DIRS = "dist build out target htmlcov coverage __pycache__ .next .nuxt _build".split()
# Extensions that build tools put out.
OUTPUT_EXT = "js mjs cjs css html map svg wasm pyc class o so dll exe jar woff woff2 gz".split()
# File names that only tools write.
GENERATED_NAME = (
    r"(^|/)(package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|pipfile\.lock|cargo\.lock|composer\.lock|gemfile\.lock|go\.sum|"
    r"(parsetab|lextab)\w*\.py|[^/]*_pb2(_grpc)?\.pyi?|[^/]*\.pb\.(go|cc|h)|[^/]*\.(pyc|pyo|class|g\.dart|designer\.cs))$"
)
MINIFIED_NAME = r"([.\-_]min\.(js|css|mjs)|[.\-]bundle\.(js|css|mjs)|\.[0-9a-f]{8,}\.(js|css|mjs)|\.chunk\.js)$"
HASHED_DATA = r"(^|/)[0-9a-f]{16,}\.(json|bin|dat|txt|csv|xml|ya?ml|parquet)$"

_MARK = re.compile(
    r"@generated\b|\bdo not (?:edit|modify|change)\b|\bauto-?generated\b|\bautomatically[ -]@?generated\b|\b(?:code|file|module|source) (?:was |is )?(?:automatically |auto-)?generated\b|"
    r"\bgenerated (?:by|from|with|using)\b|\bend of generated code\b|\bwill be (?:lost|overwritten)\b|\bmade from \S+\.\w+",
    re.I,
)
_DOC_MARK = re.compile(r"^\s*(?:(?:auto-?)?generated (?:by|from|with)\b|(?:this|the) (?:file|module|code) (?:is|was) (?:auto|generated)|do not edit\b|@generated\b)", re.I | re.M)
_HAND = re.compile(r"\bby hand\b|\bno generator\b|\bedited by\b|\bmaintained by (?:people|humans?|hand)\b|\bnot generated\b|\bplease do edit\b|\bplease edit\b|\bonce generated\b", re.I)
_LICENCE = re.compile(r"\A\s*/\*(?:!|\*[\s*]*@licen[sc]e)[^/]{0,400}?(?:\bv?\d+\.\d|\(c\)|copyright|licen[sc]e)", re.I)
_COMMENT = re.compile(r"\s*(?:#(?!!)|//|/\*|\*|<!--|--|;;|%)")
_B64 = re.compile(r"[A-Za-z0-9+/=_\-]{40,}")
_NUMBERS = re.compile(r"[\d\s.,\[\](){}xXa-fA-F+\-]")
_PB = re.compile(r"_descriptor\.FieldDescriptor|^DESCRIPTOR = _descriptor|^_lr_action|^_tabversion\s*=", re.M)


def text_evidence(text: str, ext: str) -> np.ndarray:
    """Log potentials of the content alone."""
    e = np.zeros(5)
    if not text:
        return e
    lines = text.split("\n")
    # the whole leading and trailing comment blocks; a shebang belongs to the leading one
    top = 1 if lines[0].startswith("#!") else 0
    while top < len(lines) and (not lines[top].strip() or _COMMENT.match(lines[top])):
        top += 1
    head = lines[:top]
    end = len(lines)
    while end > top and (not lines[end - 1].strip() or _COMMENT.match(lines[end - 1])):
        end -= 1
    # near the end comments count also between lines of code
    tail = [x for x in lines[max(top, min(end, len(lines) - 6)) :] if _COMMENT.match(x)]
    comments = "\n".join(head + tail)
    doc = ""
    rest = text[len("\n".join(head)) :].lstrip() if head else text.lstrip()
    if rest[:3] in ('"""', "'''"):
        doc = rest[3 : max(3, rest.find(rest[:3], 3))]
    if _HAND.search(comments):
        e[0] += 8
    elif _MARK.search(comments) or (doc and _DOC_MARK.search(doc)):
        e[1] += 13
    if _PB.search(text):
        e[1] += 13
    if _LICENCE.match(text) and len(lines) > 4:
        e[3] += 12
    n = len(text)
    sure = 12.0 * min(1.0, n / 400)  # what the characters of a short text say is worth less
    spaces = text.count(" ") + text.count("\n") + text.count("\t")
    mean = n / max(1, len([x for x in lines if x.strip()]))
    in_b64 = sum(len(x) for x in _B64.findall(text))
    digits = len(_NUMBERS.findall(text)) if ext != "json" else 0
    if in_b64 > 0.5 * n and ext not in ("md", "json", "lock"):
        e[4] += sure
    elif digits > 0.88 * n and ext not in ("csv", "md", "toml"):
        e[4] += sure
    elif ext in ("js", "mjs", "ts", "css") and mean > 250 and spaces < 0.13 * n:
        e[2] += sure
    elif ext == "json" and mean > 2_000:
        e[4] += 7
    if ext == "css" and re.search(r"url\(data:[\w/+\-]+;base64,", text) and in_b64 > 0.3 * n:
        e[4] += sure
    return e


def body_hash(text: str) -> str | None:
    """Hash of the lines that are neither blank nor comment, so that a banner or line ends make no difference."""
    body = [x.rstrip() for x in text.split("\n") if x.strip() and not _COMMENT.match(x)]
    size = sum(map(len, body))
    return hashlib.blake2b("\n".join(body).encode(), digest_size=16).hexdigest() if size >= 200 and len(body) >= 5 else None


#: log psi[label of the directory][label of what lies in it].
PSI = np.log(
    np.array(
        [
            [0.94, 0.02, 0.015, 0.01, 0.015],
            [0.08, 0.84, 0.04, 0.02, 0.02],
            [0.10, 0.05, 0.78, 0.05, 0.02],
            [0.02, 0.02, 0.04, 0.90, 0.02],
            [0.10, 0.05, 0.02, 0.02, 0.81],
        ]
    )
)


def _message(belief: Column, up: bool) -> Column:
    """Message over the factor: up to the directory, or down to what lies in it."""
    psi = F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in (PSI if up else PSI.T)))
    return F.transform(psi, lambda row: F.log(F.aggregate(F.zip_with(row, belief, lambda a, b: F.exp(a + b)), F.lit(0.0), lambda x, y: x + y)))


def _add(a: Column, b: Column, sign: int = 1) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y * sign)


def _norm(a: Column) -> Column:
    """Shifted so that the greatest entry is 0; keeps exp() within range."""
    m = F.array_max(a)
    return F.transform(a, lambda x: x - m)


def _sums(col: str) -> Column:
    return F.array(*(F.sum(F.col(col)[i]) for i in range(5)))


def _dir_words(name: str, root: bool) -> list[float]:
    """What the name of a directory says of it."""
    w = [0.0] * 5
    if not root:
        low = name.lower()
        w[1] = 0.6 if low in OUTPUT_DIRS or low.endswith(".egg-info") else 0.0
        w[3] = 4.0 if low in VENDOR_DIRS else 0.0
    return w


def _sweep(pdf: pd.DataFrame) -> pd.DataFrame:
    """Beliefs of all directories of the repositories in ``pdf``: (repo, dir, b). Up and down, one array step a depth."""
    at: dict[tuple, int] = {}
    parent, depth, names = [], [], []

    def node(repo: str | None, d: str) -> int:
        todo = []
        while (repo, d) not in at:
            todo.append(d)
            if not d:
                break
            d = d.rpartition("/")[0]
        for d in reversed(todo):
            up = at[repo, d.rpartition("/")[0]] if d else -1
            at[repo, d] = len(parent)
            parent.append(up)
            depth.append(depth[up] + 1 if d else 0)
            names.append(d.rpartition("/")[2])
        return at[repo, todo[0] if todo else d]

    repos = [None if r is None or r != r else r for r in pdf["repo"]]
    rows = [node(r, d) for r, d in zip(repos, pdf["dir"])]
    b = np.array([_dir_words(x, up < 0) for x, up in zip(names, parent)], float).reshape(-1, 5)
    np.add.at(b, rows, np.array(pdf["m"].tolist(), float).reshape(-1, 5))
    up_of, level = np.array(parent), np.array(depth)
    psi = np.exp(PSI)
    sent = np.zeros_like(b)
    top = lambda x: x - x.max(1, keepdims=True)
    by_depth = [np.flatnonzero(level == d) for d in range(int(level.max()) + 1)]
    for ids in reversed(by_depth):
        b[ids] = top(b[ids])
        sent[ids] = np.log(np.exp(b[ids]) @ psi.T)
        if up_of[ids[0]] >= 0:
            np.add.at(b, up_of[ids], sent[ids])
    for ids in by_depth[1:]:
        above = top(b[up_of[ids]] - sent[ids])
        b[ids] = top(b[ids] + np.log(np.exp(above) @ psi))
    keys = list(at)
    return pd.DataFrame({"repo": [r for r, _ in keys], "dir": [d for _, d in keys], "b": list(b)})


def _sweep_by_depth(from_files: DataFrame) -> DataFrame:
    """The same of repositories of any size: a job for each depth, up and down."""
    z = F.lit(0.0)
    deepest = from_files.agg(F.max("depth")).first()[0] or 0
    name = F.lower(F.element_at(F.split("dir", "/"), -1))
    dir_u = F.array(z, F.when(name.isin(OUTPUT_DIRS) | name.endswith(".egg-info"), 0.6).otherwise(z), z, F.when(name.isin(VENDOR_DIRS), 4.0).otherwise(z), z)
    parent = F.when(F.col("depth") > 1, F.regexp_replace("dir", "/[^/]*$", "")).otherwise("")
    ups: dict[int, DataFrame] = {}
    arriving: DataFrame | None = None
    for d in range(deepest, -1, -1):
        here = from_files.filter(F.col("depth") == d).select("repo", "dir", "m")
        if arriving is not None:
            here = here.unionByName(arriving)
        node = here.groupBy("repo", "dir").agg(_sums("m").alias("s")).withColumn("depth", F.lit(d))
        node = node.withColumn("b", _norm(_add(F.col("s"), dir_u) if d else F.col("s"))).withColumn("up", _message(F.col("b"), True)).withColumn("parent", parent)
        ups[d] = cut(node.select("repo", "dir", "depth", "parent", "b", "up"))
        arriving = ups[d].select("repo", F.col("parent").alias("dir"), F.col("up").alias("m"))
    # down: what a directory hears from above without its own words
    full = ups[0].select("repo", "dir", "b")
    levels = [full]
    for d in range(1, deepest + 1):
        above = full.select(F.col("repo").alias("r"), F.col("dir").alias("p"), F.col("b").alias("pb"))
        node = ups[d].join(above, (F.col("repo") == F.col("r")) & (F.col("parent") == F.col("p")))
        full = cut(node.select("repo", "dir", _norm(_add(F.col("b"), _message(_norm(_add(F.col("pb"), F.col("up"), -1)), False))).alias("b")))
        levels.append(full)
    every = levels[0]
    for x in levels[1:]:
        every = every.unionByName(x)
    return every


def label_files(files: DataFrame, texts: DataFrame, chunks: DataFrame | None = None, *, key: str = "file_id", repo: str = "repo", path: str = "path", text: str = "text", reason: str | None = "generated_reason", flagged: str = "is_generated", task_dirs: int = 200_000) -> DataFrame:
    """(key, repo, path, label, p_handwritten, handwritten) of every row of ``files``, also of those without a text.

    ``reason`` (an older finding) and the chunks' ``flagged`` share are weak evidence only; null counts as none. Content
    that also lies in a vendored directory of another repository counts as copied in where it has another name; under the
    name it has there it may be the original, the less likely the more repositories hold it so. Repositories of more than
    ``task_dirs`` directories are swept depth by depth. Keys must be unique; null paths count as files of the root.
    """
    ext_of = F.lower(F.regexp_extract(F.col(path), r"\.([^./]+)$", 1))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ts = [t.replace("\r\n", "\n") if t else "" for t in pdf["t"]]
            yield pd.DataFrame({"k": pdf["k"], "ev": [text_evidence(t, x).tolist() for t, x in zip(ts, pdf["x"])], "bh": [body_hash(t) for t in ts]})

    kind = files.schema[key].dataType.simpleString()
    seen = texts.select(F.col(key).alias("k"), F.col(text).alias("t"), ext_of.alias("x")).mapInPandas(read, f"k {kind}, ev array<double>, bh string")
    low = F.lower(F.coalesce(F.col("path"), F.lit("")))
    parts = F.split(low, "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    ext = F.regexp_extract(low, r"\.([^./]+)$", 1)
    is_out = F.arrays_overlap(dirs, F.array(*map(F.lit, OUTPUT_DIRS))) | F.exists(dirs, lambda d: d.endswith(".egg-info"))
    in_vendor = F.arrays_overlap(dirs, F.array(*map(F.lit, VENDOR_DIRS)))
    z = F.lit(0.0)
    old = F.lower(F.coalesce(F.col("why"), F.lit("")))
    named = F.array(
        F.when((ext == "py") & ~in_vendor & ~low.rlike(GENERATED_NAME), 0.5).otherwise(z),
        F.when(low.rlike(GENERATED_NAME), 13.0).otherwise(z) + F.when(is_out & ext.isin(OUTPUT_EXT), 10.0).otherwise(z) + F.when(old.contains("generated") | old.contains("build output"), 0.8).otherwise(z) + 0.8 * F.coalesce(F.col("flag"), z),
        F.when(low.rlike(MINIFIED_NAME), 13.0).otherwise(z) + F.when(old.contains("minified"), 0.8).otherwise(z),
        F.when(in_vendor, 10.0).otherwise(z),
        F.when(low.rlike(HASHED_DATA), 13.0).otherwise(z),
    )
    base = files.select(F.col(key).alias("k"), F.col(repo).alias("repo"), F.col(path).alias("path"), (F.col(reason) if reason else F.lit(None).cast("string")).alias("why"))
    if chunks is not None:
        share = chunks.groupBy(F.col(repo).alias("repo"), F.col(path).alias("path")).agg(F.avg(F.col(flagged).cast("double")).alias("flag"))
        base = base.join(share, ["repo", "path"], "left")
    else:
        base = base.withColumn("flag", F.lit(None).cast("double"))
    base = base.join(seen, "k", "left")
    whole = F.split(F.coalesce("path", F.lit("")), "/")
    above = F.filter(F.slice(whole, 1, F.size(whole) - 1), lambda d: d != "")
    prior = F.array(*map(F.lit, PRIOR))
    own = _add(_add(named, prior), F.coalesce("ev", F.array(*[z] * 5)))
    base = cut(base.select("k", "repo", "path", "bh", in_vendor.alias("in_vendor"), own.alias("u"), F.array_join(above, "/").alias("dir"), F.size(above).alias("depth"), F.lower(F.element_at(whole, -1)).alias("name")))
    held = base.filter("bh is not null")
    vendored = held.filter("in_vendor").groupBy("bh").agg(F.min("repo").alias("r1"), F.max("repo").alias("r2"))
    there = held.filter("in_vendor").select("bh", "name", F.lit(True).alias("same")).distinct()
    free = held.filter("NOT in_vendor").join(vendored, "bh").filter("r1 <> repo OR r2 <> repo").join(there, ["bh", "name"], "left")
    many = free.filter("same").groupBy("bh", "name").agg(F.count_distinct("repo").alias("repos"))
    # of r repositories that hold a file under its own name one at most is its home
    copied = free.join(many, ["bh", "name"], "left").select("k", F.when(F.col("same"), 4.0 * F.log(F.col("repos").cast("double"))).otherwise(12.0).alias("copied"))
    base = base.join(copied, "k", "left").withColumn("u", _add(F.col("u"), F.array(z, z, z, F.coalesce("copied", z), z)))
    base = cut(base.withColumn("m", _message(F.col("u"), True)).select("k", "repo", "path", "u", "dir", "depth", "m"))

    from_files = cut(base.groupBy("repo", "dir", "depth").agg(_sums("m").alias("m")))
    dirs_of = from_files.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("depth") + 1).alias("nodes"))
    large = cut(dirs_of.filter(F.col("nodes") > task_dirs).select("repo"))
    small = from_files.join(large, "repo", "left_anti")
    tasks = max(1, int(from_files.agg(F.sum(F.col("depth") + 1)).first()[0] or 0) // task_dirs * 2 + 1)
    every = small.groupBy(F.pmod(F.xxhash64("repo"), F.lit(tasks))).applyInPandas(_sweep, "repo string, dir string, b array<double>")
    if large.limit(1).count():
        every = every.unionByName(_sweep_by_depth(from_files.join(large, "repo", "left_semi")))
    every = every.select(F.col("repo").alias("r"), F.col("dir").alias("d"), F.col("b").alias("db"))
    out = base.join(every, (F.col("repo") == F.col("r")) & (F.col("dir") == F.col("d")), "left")
    belief = F.when(F.col("db").isNotNull(), _add(F.col("u"), _message(_norm(_add(F.col("db"), F.col("m"), -1)), False))).otherwise(F.col("u"))
    out = out.withColumn("b", _norm(belief)).withColumn("e", F.transform("b", lambda x: F.exp(x)))
    total = F.aggregate("e", z, lambda x, y: x + y)
    p = F.round(F.col("e")[0] / total, 6)
    label = F.element_at(F.array(*map(F.lit, LABELS)), F.array_position("b", F.array_max("b")).cast("int"))
    return out.select(F.col("k").alias(key), F.col("repo").alias(repo), F.col("path").alias(path), label.alias("label"), p.alias("p_handwritten"), (p >= 0.5).alias("handwritten"))

"""Evaluation of rankings against ground truth, and the search for weights."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.functions import paths as P
from codequarry.functions import text as T
from codequarry.functions.scoring import log_norm, round3
from codequarry.operators.prefix import global_rank
from codequarry.session import cut


def mean_percentile(ranking: DataFrame, truth: DataFrame, *, by: list[str], item: str, rank: str = "rank") -> DataFrame:
    """(by..., percentile): mean of 1 - (rank - 1) / (n - 1) over the items of the truth that are ranked.

    Null for fewer than two ranked items or no truth among them; 1 is the top, 0.5 is chance."""
    t = truth.select(*[c for c in by if c in truth.columns], item).distinct().withColumn("__t", F.lit(True))
    on = [c for c in (*by, item) if c in truth.columns]
    j = ranking.join(t, on, "left")
    n = ranking.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    g = j.join(n, by) if by else j.withColumn("n", ranking.agg(F.count(F.lit(1))).scalar())
    # whole numbers are summed, so the result does not depend on the order of rows
    hit = F.col("__t") & (F.col("n") >= 2)
    s = g.groupBy(*by).agg(F.sum(F.when(hit, F.col(rank) - 1)).alias("__s"), F.count_if(hit).alias("__c"), F.max("n").alias("__n"))
    return s.select(*by, F.when(F.col("__c") > 0, round3(1 - F.col("__s") / (F.col("__c") * (F.col("__n") - 1)))).alias("percentile"))


def hits_at_k(ranking: DataFrame, truth: DataFrame, *, by: list[str], item: str, rank: str = "rank", k: int = 10) -> DataFrame:
    """(by..., hits): how many of the top k are in the truth; 0 for a ranking without a hit."""
    on = [c for c in (*by, item) if c in truth.columns]
    j = ranking.join(truth.select(*on).distinct().withColumn("__t", F.lit(True)), on, "left")
    return j.groupBy(*by).agg(F.count_if((F.col(rank) <= k) & F.col("__t")).alias("hits"))


def baselines(items: DataFrame, *, by: list[str], item: str, lines: str, fan_in: str, commits: str, order: str | None = None, seed: int = 42) -> DataFrame:
    """(ranking, by..., item, rank) of the simple rankings a reading order must beat: size, fan-in, commits, random
    (a repeatable hash order), and ``order`` under the name reading-order where given. Ties by item."""
    keys = {"size": -F.col(lines), "fan-in": -F.col(fan_in), "commits": -F.col(commits), "random": F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(item).cast("string"))), 1, 13), 16, 10)}
    if order:
        keys["reading-order"] = F.col(order)
    long = items.select(*by, item, F.explode(F.array(*(F.struct(F.lit(k).alias("ranking"), v.cast("double").alias("v")) for k, v in keys.items()))).alias("x")).select(*by, item, "x.*")
    w = Window.partitionBy("ranking", *by).orderBy("v", item)
    return long.select("ranking", *by, item, F.row_number().over(w).alias("rank"))


def docs_mentioned(files: DataFrame, texts: DataFrame, rankable: DataFrame) -> DataFrame:
    """Paths of ``rankable`` that guidance documents name: by exact path, by the unique end of a path, or by a dotted
    name that belongs to exactly one file. Changelogs and API pages are no guidance."""
    guide = files.filter(F.col("path").rlike(T.DOC_FILE) & ~F.col("path").rlike(T.NOT_GUIDANCE)).select("path")
    tok = texts.join(guide, "path", "left_semi").select(T.doc_tokens(F.col("text")).alias("t"))
    said = cut(tok.select(F.explode("t.paths").alias("m")).distinct().withColumn("m", F.regexp_replace("m", r"^\./", "")))
    r = rankable.select("path").distinct()
    exact = said.join(r, F.col("m") == F.col("path")).select("path")
    rest = said.join(r, F.col("m") == F.col("path"), "left_anti")
    parts = F.split("path", "/")
    ends = r.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("m")).filter("m <> path")
    tail = rest.join(ends, "m").groupBy("m").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).filter("n = 1").select("path")
    mods = tok.select(F.explode("t.modules").alias("m")).distinct()
    dotted = r.select("path", F.explode(P.dotted_suffixes(F.col("path"))).alias("m")).groupBy("m").agg(F.count_distinct("path").alias("n"), F.min("path").alias("path")).filter("n = 1")
    return exact.union(tail).union(mods.join(dotted, "m").select("path")).distinct()


def codeowners(lines: DataFrame, line: str = "value") -> DataFrame:
    """(dir, handles) of the lines of CODEOWNERS files: pattern reduced to its directory, handles in lower case."""
    rx = r"^\s*([^#\s]+)\s+(.+?)\s*$"
    m = lines.filter(F.col(line).rlike(rx) & ~F.trim(F.col(line)).startswith("#"))
    handle = F.regexp_extract_all(F.regexp_extract(F.col(line), rx, 2), F.lit(r"@([A-Za-z0-9-]+(?:/[A-Za-z0-9-]+)?)"), F.lit(1))
    d = m.select(P.pattern_to_dir(F.regexp_extract(F.col(line), rx, 1)).alias("dir"), F.explode(F.transform(handle, F.lower)).alias("h"))
    return d.groupBy("dir").agg(F.sort_array(F.collect_set("h")).alias("handles"))


def owners_of(directories: DataFrame, owners: DataFrame, path: str = "path") -> DataFrame:
    """(path, dir, handles): for each directory the most specific entry above or at it; ``.`` covers everything."""
    up = F.concat(P.ancestors(F.concat(F.col(path), F.lit("/x"))), F.array(F.col(path)))
    j = directories.select(path, F.explode(F.array_distinct(up)).alias("dir")).join(owners, "dir")
    return j.groupBy(path).agg(F.max_by(F.struct("dir", "handles"), F.struct((F.col("dir") != ".").cast("int"), F.length("dir"))).alias("b")).select(path, "b.dir", "b.handles")


def link_handles(people: DataFrame, handles: DataFrame) -> DataFrame:
    """(handle, id): persons a handle may be, by the local part of an email, a noreply address or the flattened name."""
    flat = lambda c: F.regexp_replace(F.lower(c), "-", "")
    local = F.lower(F.substring_index("m", "@", 1))
    mails = people.select("id", F.explode("emails").alias("m"))
    keys = mails.select("id", F.explode(F.array_distinct(F.array(local, F.regexp_replace(local, "-", ""), F.when(F.col("m").endswith("users.noreply.github.com"), F.regexp_replace(local, r"^[^+]*\+", "")).otherwise(local)))).alias("k"))
    keys = keys.union(people.select("id", F.regexp_replace(F.lower(F.coalesce("name", F.lit(""))), "[^a-z0-9]", "").alias("k"))).filter("k <> ''").distinct()
    h = handles.select(F.col("handle"), F.element_at(F.split("handle", "/"), -1).alias("h"))
    h = h.select("handle", F.explode(F.array_distinct(F.array(F.lower("h"), flat(F.col("h"))))).alias("k"))
    return h.join(keys, "k").select("handle", "id").distinct()


def ownership_vs_owners(dir_owners: DataFrame, owned: DataFrame, links: DataFrame) -> DataFrame:
    """One row: covered, linked, top_1, top_3. dir_owners(path, handles); owned(path, rn, owner); links(handle, id)."""
    d = dir_owners.select("path", F.explode("handles").alias("handle")).join(links, "handle", "left")
    o = owned.filter("rn <= 3").select("path", "rn", F.col("owner").alias("id"), F.lit(True).alias("own"))
    j = d.join(o, ["path", "id"], "left").groupBy("path").agg(F.max(F.col("id").isNotNull()).alias("linked"), F.max(F.col("rn") == 1).alias("one"), F.max("own").alias("three"))
    return j.agg(F.count(F.lit(1)).alias("covered"), F.count_if("linked").alias("linked"), F.count_if("one").alias("top_1"), F.count_if("three").alias("top_3"))


#: Named formulas (centrality, reverse, fan_in, churn, size, penalty).
NAMED = {
    "current": (0.5, 0, 0.3, 0.2, 0, 0), "rounded": (0, 0.3, 0.15, 0.55, 0, 0.2), "size-only": (0, 0, 0, 0, 1, 0), "churn-only": (0, 0, 0, 1, 0, 0),
    "fan-in-only": (0, 0, 1, 0, 0, 0), "centrality-only": (1, 0, 0, 0, 0, 0), "reverse-only": (0, 1, 0, 0, 0, 0),
}


def variants(spark: SparkSession, steps: tuple[float, ...] = (0, 0.25, 0.5, 0.75, 1), reverse: tuple[float, ...] = (0, 0.25, 0.5), penalties: tuple[float, ...] = (0, 0.2)) -> DataFrame:
    """(variant, centrality, reverse, fan_in, churn, size, penalty): the named formulas and a grid normalised to sum 1,
    equal formatted names kept once."""
    out = {k: tuple(map(float, v)) for k, v in NAMED.items()}
    for c, r, f, ch, s in itertools.product(steps, reverse, steps, steps, steps):
        z = c + r + f + ch + s
        if z:
            for p in penalties:
                w = (c / z, r / z, f / z, ch / z, s / z)
                out.setdefault("c{:.2f} r{:.2f} f{:.2f} ch{:.2f} s{:.2f} p{:.1f}".format(*w, p), (*w, float(p)))
    return spark.createDataFrame([(k, *v) for k, v in out.items()], "variant string, centrality double, reverse double, fan_in double, churn double, size double, penalty double")


def feature_matrix(items: DataFrame, *, by: str, item: str, centrality: str, reverse: str, fan_in: str, churn: str, lines: str, private: str) -> DataFrame:
    """(by, item, centrality, reverse, fan_in, churn, size, private): signals normalised within each group."""
    m = items.groupBy(by).agg(*(F.max(c).alias(f"m_{n}") for n, c in (("c", centrality), ("r", reverse), ("f", fan_in), ("h", churn), ("l", lines))))
    j = items.join(m, by)
    div = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return j.select(
        by, item, div(centrality, "m_c").alias("centrality"), div(reverse, "m_r").alias("reverse"), log_norm(F.col(fan_in), F.col("m_f")).alias("fan_in"),
        log_norm(F.col(churn), F.col("m_h")).alias("churn"), log_norm(F.col(lines), F.col("m_l")).alias("size"), F.col(private).alias("private"),
    )


#: Signals of a formula in the order in which they are added.
SIGNALS = ("centrality", "reverse", "fan_in", "churn", "size")


def _before(weights: np.ndarray, signals: list[np.ndarray], private: np.ndarray, missing: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Of every row of weights: how many pairs of a hit and another row have the other row first, by score of 9 digits
    descending, then position. Missing scores come last, NaN first."""
    n, hits = len(hit), int(hit.sum())
    position = np.arange(n)
    low = (position << 1) | hit
    late = np.flatnonzero(missing)
    last = ((2**31 - 1) << 32) | low[late]
    s, x, k = np.empty(n), np.empty(n), np.empty(n, np.int64)
    out = np.empty(len(weights), np.int64)
    for v, w in enumerate(weights):
        np.multiply(signals[0], w[0], out=s)
        for c, weight in zip(signals[1:], w[1:-1]):
            np.add(s, np.multiply(c, weight, out=x), out=s)
        np.subtract(s, np.multiply(private, w[-1], out=x), out=s)
        top = max(abs(s.max()), abs(s.min()))
        if top < 2:
            # score and position in one number: the digits above, the position and whether it is a hit below
            np.multiply(s, -1e9, out=s)
            np.add(s, np.copysign(0.5, s, out=x), out=s)
            k[:] = s
            np.bitwise_or(np.left_shift(k, 32, out=k), low, out=k)
            k[late] = last
            k.sort()
            at = np.dot(np.bitwise_and(k, 1, out=k), position)
        else:
            with np.errstate(over="ignore", invalid="ignore"):
                d = s * 1e9
                d = np.where(np.abs(d) < 2**52, np.trunc(d + np.copysign(0.5, d)), d) / 1e9
            s = np.where(np.isfinite(d), d, s)
            rank = np.lexsort((-s, np.where(missing, 2, np.where(np.isnan(s), 0, 1))))
            at = np.dot(hit[rank], position)
        out[v] = at - hits * (hits - 1) // 2
    return out


def grid_search(features: DataFrame, truth: DataFrame, grid: DataFrame, *, by: str, item: str, limit: int | None = 12, chunk: int = 500_000) -> DataFrame:
    """(variant, score): mean over groups of the mean percentile of the truth. features x variants is the workload: the
    grid is a parameter table of a few thousand rows, and what is asked of a ranking is only the sum of the ranks of its
    hits, i.e. how many pairs of a hit and another row have the other row first. So the features alone are shuffled, as
    often as it takes to have work for all cores; a task scores a group by a block of formulas and sorts it. Groups with
    more than ``chunk`` hits or other rows are cut: pairs are counted between every part of the hits and of the others."""
    on = [c for c in (by, item) if c in truth.columns]
    t = truth.select(*on).distinct().withColumn("hit", F.lit(True))
    missing = F.lit(False)
    for c in SIGNALS:
        missing = missing | F.col(c).isNull()
    x = features.join(t, on, "left").filter(F.col(by).isNotNull()).select(
        by, item, F.coalesce("hit", F.lit(False)).alias("hit"), missing.alias("missing"), F.coalesce("private", F.lit(False)).alias("private"),
        *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in SIGNALS),
    )
    x = cut(x)
    parts = lambda n: F.greatest(F.ceil(n / chunk), F.lit(1)).cast("int")
    sizes = x.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits")).filter("n >= 2 AND hits > 0")
    sizes = cut(global_rank(sizes.select(by, "n", "hits", parts(F.col("n") - F.col("hits")).alias("p"), parts(F.col("hits")).alias("q")), [by], "g"))
    cells = sizes.agg(F.sum(F.col("p").cast("long") * F.col("q"))).first()[0] or 1
    rows = grid.collect()
    weights = np.array([[float(r[c]) for c in (*SIGNALS, "penalty")] for r in rows]).reshape(len(rows), -1)
    blocks = max(1, min(len(rows), -(-8 * x.sparkSession.sparkContext.defaultParallelism // cells)))
    key = ["g", "i", "j", "b"]
    at = F.pmod(F.xxhash64(item), F.when(F.col("hit"), F.col("q")).otherwise(F.col("p"))).cast("int")
    j = x.join(sizes, by).withColumn("at", at).withColumn("to", F.explode(F.sequence(F.lit(0), F.when(F.col("hit"), F.col("p")).otherwise(F.col("q")) - 1)))
    j = j.withColumn("i", F.when(F.col("hit"), F.col("to")).otherwise(F.col("at"))).withColumn("j", F.when(F.col("hit"), F.col("at")).otherwise(F.col("to")))
    j = j.select(item, "g", "i", "j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), "hit", "missing", "private", *SIGNALS)
    # numbered cells: where no group is cut, every one is a partition of its own
    number = (F.col("g") + F.col("i") * 7919 + F.col("j") * 104_729) * blocks + F.col("b")
    tasks = min(cells * blocks, 2000)
    j = j.repartitionById(tasks, F.pmod(number, F.lit(tasks)).cast("int")).sortWithinPartitions(*key, item).drop(item)
    formulas = len(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted partitions: one cell at a time, its rows in the order of items
        def done(cell: tuple, held: list[list[np.ndarray]]) -> pa.RecordBatch:
            hit, missing, private, *signals = (np.concatenate(c) for c in zip(*held))
            lo, hi = (formulas * b // blocks for b in (cell[3], cell[3] + 1))
            u = _before(weights[lo:hi], signals, private.astype(float), missing, hit.astype(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, cell[0])), pa.array(np.arange(lo, hi, dtype=np.int32)), pa.array(u)], ["g", "v", "u"])

        cell, held = None, []
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            keys = np.stack([c.astype(np.int64) for c in cols[:4]])
            starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows] if batch.num_rows else []
            for a, z in itertools.pairwise(starts):
                now = tuple(keys[:, a].tolist())
                if now != cell:
                    if held:
                        yield done(cell, held)
                    cell, held = now, []
                held.append([c[a:z] for c in cols[4:]])
        if held:
            yield done(cell, held)

    u = j.mapInArrow(count, "g long, v int, u long").groupBy("g", "v").agg(F.sum("u").alias("u"))
    rank = F.col("u") + F.expr("hits * (hits - 1) div 2")
    p = u.join(sizes.select("g", "n", "hits"), "g").select("v", round3(1 - rank / (F.col("hits") * (F.col("n") - 1))).alias("percentile"))
    per = p.groupBy("v").agg((F.floor(F.avg(F.round(F.col("percentile") * 1000).cast("long")) + 0.5) / 1000).alias("score"))
    names = F.expr(f"array({', '.join(repr(r['variant']) for r in rows)})")
    out = per.select(names[F.col("v")].alias("variant"), "score").orderBy(F.desc("score"), "variant")
    return out.limit(limit) if limit else out


def split_half(groups: DataFrame, by: str) -> DataFrame:
    """Adds ``training``: groups alternate by their position in the order of names."""
    g = global_rank(groups.select(by).distinct(), [by], "__at")
    return groups.join(g.select(by, (F.pmod(F.col("__at") - 1, F.lit(2)) == 0).alias("training")), by)


def markdown_table(rows: DataFrame, title: str) -> str:
    """A summary table as text; for reports of few rows."""
    cols = rows.columns
    out = [f"### {title}", "", "| " + " | ".join(cols) + " |", "|" + "---|" * len(cols)]
    for r in rows.toLocalIterator():
        out.append("| " + " | ".join("" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v) for v in r) + " |")
    return "\n".join(out) + "\n"


def percentile_table(values: DataFrame, *, repo: str, ranking: str, value: str) -> DataFrame:
    """One row per repository, a column per ranking, and the exact medians as a last row."""
    wide = values.groupBy(repo).pivot(ranking).agg(F.first(value))
    med = values.groupBy(ranking).agg(F.median(value).alias(value)).groupBy(F.lit("**median**").alias(repo)).pivot(ranking).agg(F.first(value))
    return wide.unionByName(med)

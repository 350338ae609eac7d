"""Near-duplicate files by shared lines, and repeated function bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions.text import body_lines, significant_lines
from codequarry.operators.graph import components
from codequarry.session import cut


def line_pairs(files: DataFrame, *, key: str, text: str, min_lines: int = 10, min_length: int = 8, common: int = 20, min_shared: int = 10, min_containment: float = 0.8, scope: str | None = None) -> DataFrame:
    """([scope,] a, b, shared, containment): files that share many significant lines, within each ``scope`` where given.

    A line held by one file or by more than ``common`` files says nothing and is left out before pairing: that is part
    of the definition, and bounds the pairs of a line. The size of a file counts all its significant lines. Files with
    fewer than ``min_lines`` are no candidates. Lines are compared by hash, pairs counted map-side.
    """
    by = [scope] if scope else []
    sig = files.select(*by, F.col(key).alias("k"), significant_lines(F.col(text), min_length).alias("ls")).filter(F.size("ls") >= min_lines)
    flat = sig.select(*by, "k", F.size("ls").alias("n"), F.explode("ls").alias("l"))
    per = flat.groupBy(*by, "l").agg(F.count(F.lit(1)).alias("df"))
    useful = per.filter(F.col("df").between(2, common)).select(*by, "l")
    held = flat.join(useful, [*by, "l"]).groupBy(*by, "l").agg(F.sort_array(F.collect_list(F.struct("k", "n"))).alias("h"))
    both = F.flatten(F.transform("h", lambda x, i: F.transform(F.slice("h", i + 2, F.size("h")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    p = held.select(*by, F.explode(both).alias("p")).groupBy(*by, F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    c = F.col("shared") / F.least("a.n", "b.n")
    return p.filter((F.col("shared") >= min_shared) & (c >= min_containment)).select(*by, F.col("a.k").alias("a"), F.col("b.k").alias("b"), "shared", c.alias("containment"))


def duplicate_groups(pairs: DataFrame) -> DataFrame:
    """(component, members, size, containment, shared): the groups that pairs connect, with their greatest values."""
    p = cut(pairs)
    comp = cut(components(p, "a", "b"))
    best = p.join(comp.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.max("containment").alias("containment"), F.max("shared").alias("shared"))
    mem = comp.groupBy("component").agg(F.sort_array(F.collect_list("node")).alias("members"), F.count(F.lit(1)).alias("size"))
    return mem.join(best, "component").orderBy(F.desc("size"), "component")


def repeated_bodies(texts: DataFrame, symbols: DataFrame, *, min_lines: int = 6) -> DataFrame:
    """([repo,] path, name, start_line, end_line, body_hash, body_lines, copies, files) of functions with the same body in
    at least two files of a repository. Bodies are stripped lines without blanks and comments, from the line after the
    definition."""
    by = ["repo"] if "repo" in symbols.columns else []
    f = symbols.filter(F.col("kind") == "function").join(texts.select(*by, "path", "text"), [*by, "path"])
    f = f.withColumn("body", body_lines(F.col("text"), F.col("start_line"), F.col("end_line"))).filter(F.size("body") >= min_lines)
    f = f.select(*by, "path", "name", "start_line", "end_line", F.sha2(F.array_join("body", "\n"), 256).alias("body_hash"), F.size("body").alias("body_lines"))
    g = f.groupBy(*by, "body_hash").agg(F.count(F.lit(1)).alias("copies"), F.count_distinct("path").alias("files")).filter("files >= 2")
    return f.join(g, [*by, "body_hash"])


def outermost(occurrences: DataFrame) -> DataFrame:
    """Drops groups all of whose occurrences lie inside ranges of an earlier group (weight descending, path, line)."""
    o = cut(occurrences)
    by = ["repo"] if "repo" in o.columns else []
    first = o.groupBy(*by, "body_hash").agg(F.min(F.struct(-(F.col("body_lines") * F.col("copies")), "path", "start_line", "body_hash")).alias("rank"))
    r = o.join(first, [*by, "body_hash"])
    big = r.select(*(F.col(c).alias("r0") for c in by), F.col("path").alias("p2"), F.col("start_line").alias("s2"), F.col("end_line").alias("e2"), F.col("rank").alias("r2"))
    same = F.col("path") == F.col("p2")
    loose = r.join(big, ((F.col("repo") == F.col("r0")) & same if by else same) & (F.col("s2") <= F.col("start_line")) & (F.col("end_line") <= F.col("e2")) & (F.col("r2") < F.col("rank")), "left_anti")
    return o.join(loose.select(*by, "body_hash").distinct(), [*by, "body_hash"], "left_semi")


def repeated_windows(texts: DataFrame, *, key: str, text: str, k: int = 3) -> DataFrame:
    """(block, files, occurrences): runs of k consecutive lines that appear in two or more texts."""
    ls = F.split(F.col(text), "\n")
    win = F.when(F.size(ls) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(ls) - (k - 1))), lambda i: F.array_join(F.slice(ls, i, k), "\n")))
    d = texts.select(F.col(key).alias("k"), F.explode(win).alias("block"))
    return d.groupBy("block").agg(F.count_distinct("k").alias("files"), F.count(F.lit(1)).alias("occurrences")).filter("files >= 2")

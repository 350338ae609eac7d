"""Co-change: which files, and which areas, change in the same commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions.scoring import degree, round3


def considered(items: DataFrame, *, group: str, item: str, max_basket: int, sizes: DataFrame | None = None, size: str | None = None) -> DataFrame:
    """Distinct (group, item) of groups with at most ``max_basket`` items; nulls are dropped.

    The size is that of ``sizes`` (the raw number of changed files, including those gone since) where given, else the
    number of distinct items; a group whose size is reported too small is out by its distinct items all the same.
    Filtering before pairing bounds the pairs of a group to max_basket^2 / 2.
    """
    d = items.select(F.col(group).alias("g"), F.col(item).alias("i")).dropna().distinct()
    small = d.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= max_basket).select("g")
    if sizes is not None:
        said = sizes.select(F.col(group).alias("g"), F.col(size).alias("n")).groupBy("g").agg(F.max("n").alias("n")).filter(F.col("n") <= max_basket).select("g")
        small = small.join(said, "g", "left_semi")
    return d.join(small, "g", "left_semi")


def pairs(d: DataFrame, least: int) -> DataFrame:
    """(a, b, together) of a distinct (g, i) table; each group is expanded by itself, counts combine map-side."""
    per = d.groupBy("g").agg(F.sort_array(F.collect_list("i")).alias("is"))
    both = F.flatten(F.transform("is", lambda x, k: F.transform(F.slice("is", k + 2, F.size("is")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return per.filter(F.size("is") > 1).select(F.explode(both).alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("together")).filter(F.col("together") >= least)


def cochange(
    items: DataFrame, *, group: str, item: str, max_basket: int = 30, min_item: int = 5, min_together: int = 5, min_degree: float = 0.3, limit: int | None = 300,
    nodes: DataFrame | None = None, edges: DataFrame | None = None, sizes: DataFrame | None = None, size: str | None = None,
) -> DataFrame:
    """(a, b, together, count_a, count_b, degree[, has_edge]): pairs of items that occur in the same groups.

    degree = together / mean of both counts, compared unrounded, reported to three places. has_edge is three-valued:
    null unless both ends are ``nodes``. Order of the top ``limit``: degree, together (descending), a, b.
    """
    d = considered(items, group=group, item=item, max_basket=max_basket, sizes=sizes, size=size)
    counts = d.groupBy("i").agg(F.count(F.lit(1)).alias("c"))
    eligible = counts.filter(F.col("c") >= min_item)
    p = pairs(d.join(eligible.select("i"), "i", "left_semi"), min_together)
    p = p.join(eligible.select(F.col("i").alias("a"), F.col("c").alias("count_a")), "a").join(eligible.select(F.col("i").alias("b"), F.col("c").alias("count_b")), "b")
    raw = degree(F.col("together"), F.col("count_a"), F.col("count_b"))
    out = p.filter(raw >= min_degree).select("a", "b", "together", "count_a", "count_b", round3(raw).alias("degree"))
    if nodes is not None:
        out = edge_flag(out, nodes, edges)
    return out.orderBy(F.desc("degree"), F.desc("together"), "a", "b").limit(limit) if limit else out


def edge_flag(p: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds has_edge: null unless both a and b are nodes, else whether an edge leads either way."""
    n = nodes.select(F.col(nodes.columns[0]).alias("node")).distinct()
    e = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().withColumn("e", F.lit(True))
    out = p.join(n.select(F.col("node").alias("a"), F.lit(True).alias("na")), "a", "left").join(n.select(F.col("node").alias("b"), F.lit(True).alias("nb")), "b", "left").join(e, ["a", "b"], "left")
    return out.withColumn("has_edge", F.when(F.col("na") & F.col("nb"), F.coalesce("e", F.lit(False)))).drop("na", "nb", "e")


def cochange_areas(items: DataFrame, *, group: str, area: str | Column, max_basket: int = 30, min_together: int = 3, limit: int | None = 50) -> DataFrame:
    """(a, b, together, count_a, count_b, degree) per area; no floor of the degree. Order: together, a, b."""
    d = items.select(F.col(group).alias("g"), (F.col(area) if isinstance(area, str) else area).alias("i")).dropna().distinct()
    small = d.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= max_basket).select("g")
    d = d.join(small, "g", "left_semi")
    counts = d.groupBy("i").agg(F.count(F.lit(1)).alias("c"))
    p = pairs(d, min_together)
    p = p.join(counts.select(F.col("i").alias("a"), F.col("c").alias("count_a")), "a").join(counts.select(F.col("i").alias("b"), F.col("c").alias("count_b")), "b")
    out = p.withColumn("degree", round3(degree(F.col("together"), F.col("count_a"), F.col("count_b"))))
    return out.orderBy(F.desc("together"), "a", "b").limit(limit) if limit else out

"""Ranks and running totals over groups of any size.

A plain window over ``partitionBy(key)`` puts a whole key into one task. Here each key is first cut into order-preserving
buckets; a window runs inside (key, bucket), and the small table of bucket totals gives each bucket its offset. No task
holds more than one bucket, so a key with a third of all rows is spread like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.session import cut


def hash_bucket(*cols: str | Column, bits: int = 8, seed: int = 0) -> tuple[Column, Column]:
    """(bucket, order) of a pseudo-random but repeatable order; bucket is monotone in order."""
    h = F.xxhash64(F.lit(seed), *cols)
    return F.shiftrightunsigned(h, 64 - bits).cast("int"), F.shiftrightunsigned(h, 1)


def running_total(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str | Column], value: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same keys that come before the row (exclusive).

    ``bucket`` must be monotone in ``order``; ``order`` must be total for a repeatable result. Null values count as 0.
    Null keys form a group of their own. An empty table stays empty.
    """
    v = F.coalesce(value, F.lit(0))
    src = df.withColumn("__v", v)
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = src.groupBy(*keys, bucket).agg(F.sum("__v").alias("__bt"))
    across = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.withColumn("__off", F.coalesce(F.sum("__bt").over(across), F.lit(0)))
    ren = {k: f"__k{i}" for i, k in enumerate([*keys, bucket])}
    offs = offs.select(*(F.col(k).alias(v) for k, v in ren.items()), "__off")
    cond = None
    for k, r in ren.items():
        c = F.col(k).eqNullSafe(F.col(r))
        cond = c if cond is None else cond & c
    return (
        src.withColumn("__in", F.sum("__v").over(inner) - F.col("__v"))
        .join(offs, cond, "left")
        .withColumn(out, F.col("__in") + F.col("__off"))
        .drop("__v", "__in", "__off", *ren.values())
    )


def value_buckets(df: DataFrame, keys: Sequence[str], value: str, out: str, parts: int = 64) -> DataFrame:
    """Adds ``out``: a bucket number monotone in ``value`` within each key, about ``parts`` of even size.

    The splits are approximate quantiles per key (an array of bounded length); they only balance, they never decide.
    """
    probs = [i / parts for i in range(1, parts)]
    q = df.groupBy(*keys).agg(F.percentile_approx(value, probs, 1000).alias("__q"))
    ren = {k: f"__k{i}" for i, k in enumerate(keys)}
    q = q.select(*(F.col(k).alias(v) for k, v in ren.items()), "__q")
    cond = None
    for k, r in ren.items():
        c = F.col(k).eqNullSafe(F.col(r))
        cond = c if cond is None else cond & c
    joined = df.join(q, cond, "left") if keys else df.withColumn("__q", q.scalar())
    return joined.withColumn(
        out, F.coalesce(F.size(F.filter("__q", lambda s: s < F.col(value))), F.lit(0))
    ).drop("__q", *ren.values())


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str, n_out: str, parts: int = 64) -> DataFrame:
    """Distinct (keys, value) with the averaged rank of its ties (1-based) and the key's row count.

    Values are counted first, so a value that fills a third of the table is one row before anything is ordered.
    Null values are left out.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    counts = cut(value_buckets(cut(counts), keys, value, "__b", parts))
    ranked = running_total(counts, keys, "__b", [value], F.col("__c"), "__before")
    ns = counts.groupBy(*keys).agg(F.sum("__c").alias(n_out))
    ren = {k: f"__n{i}" for i, k in enumerate(keys)}
    ns = ns.select(*(F.col(k).alias(v) for k, v in ren.items()), n_out)
    cond = None
    for k, r in ren.items():
        c = F.col(k).eqNullSafe(F.col(r))
        cond = c if cond is None else cond & c
    ranked = ranked.join(ns, cond, "left") if keys else ranked.withColumn(n_out, ns.scalar())
    return ranked.withColumn(out, F.col("__before") + (F.col("__c") + 1) / 2).drop("__b", "__before", "__c", *ren.values())


def global_rank(df: DataFrame, order: Sequence[str | Column], out: str, parts: int = 0) -> DataFrame:
    """Adds ``out``: the 1-based position of each row in a total order of the whole table, without a one-task window.

    Rows are range-partitioned by the order and kept; a window numbers them within their partition, and the small table
    of partition sizes gives the offsets. Equal rows get different, repeatable positions only if the order is total.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(n, *cols).withColumn("__p", F.spark_partition_id()))
    sizes = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    # one row per partition: the single-task window sees as many rows as there are partitions
    offs = sizes.withColumn("__off", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*cols))
    return placed.withColumn("__i", inside).join(F.broadcast(offs), "__p").withColumn(out, F.col("__off") + F.col("__i")).drop("__p", "__i", "__off")

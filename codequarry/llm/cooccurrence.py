"""Items that appear together: exact pair counts and lift by heavy-light decomposition.

Items held by at least ``heavy_share`` of a scope's baskets are *heavy*; there are at most max_basket / heavy_share of
them. Baskets are cut into blocks of about ``block`` baskets by hash, so one scope with a third of all rows is many
tasks. In a block the heavy items are rows of a packed bit matrix: heavy-heavy pairs are popcounts of ANDed rows, mixed
pairs probe the matrix with a light item's basket list. Light-light pairs are exploded per basket and hash-counted
with map-side combining. The three partial counts are summed and scored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.session import cut



def _one_block(pdf: pd.DataFrame) -> pd.DataFrame:
    scope = int(pdf["sid"].iloc[0])
    heavy_lists = pdf["heavy"].tolist()
    n = len(heavy_lists)
    lens = np.fromiter((len(h) for h in heavy_lists), np.int64, n)
    flat = np.concatenate([np.asarray(h, np.int64) for h in heavy_lists]) if lens.sum() else np.empty(0, np.int64)
    ids, col = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(n), lens)
    bits = np.zeros((len(ids), n), bool)
    bits[col, row] = True
    packed = np.packbits(bits, axis=1)
    pad = -packed.shape[1] % 8
    words = np.ascontiguousarray(np.pad(packed, ((0, 0), (0, pad)))).view(np.uint64)
    a_out, b_out, m_out = [], [], []
    for i in range(len(ids) - 1):
        m = np.bitwise_count(words[i + 1 :] & words[i]).sum(axis=1, dtype=np.int64)
        hit = np.flatnonzero(m)
        a_out.append(np.full(len(hit), ids[i]))
        b_out.append(ids[i + 1 + hit])
        m_out.append(m[hit])
    light_lists = pdf["light"].tolist()
    llen = np.fromiter((len(x) for x in light_lists), np.int64, n)
    if llen.sum() and len(ids):
        lflat = np.concatenate([np.asarray(x, np.int64) for x in light_lists])
        lrow = np.repeat(np.arange(n), llen)
        order = np.argsort(lflat, kind="stable")
        lflat, lrow = lflat[order], lrow[order]
        starts = np.flatnonzero(np.r_[True, lflat[1:] != lflat[:-1]])
        by_basket = np.ascontiguousarray(bits.T)
        for s, e in zip(starts, np.r_[starts[1:], len(lflat)]):
            m = by_basket[lrow[s:e]].sum(axis=0, dtype=np.int64)
            hit = np.flatnonzero(m)
            a_out.append(np.full(len(hit), lflat[s]))
            b_out.append(ids[hit])
            m_out.append(m[hit])
    if not a_out:
        return pd.DataFrame({"sid": [], "a": [], "b": [], "m": []}, dtype="int64")
    a, b = np.concatenate(a_out), np.concatenate(b_out)
    return pd.DataFrame({"sid": scope, "a": np.minimum(a, b), "b": np.maximum(a, b), "m": np.concatenate(m_out)})


def _if_small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Broadcast if it is counted to have at most ``most`` rows, else left to an ordinary join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _small_baskets(src: DataFrame, max_basket: int) -> DataFrame:
    """(scope, basket, items) of baskets with at most ``max_basket`` distinct items; repeated rows count once.

    Rows per basket are counted first, which costs a small shuffle. A basket of few rows, repeats included, can safely
    be gathered as a set: one shuffle of the rows. The others, sweeping or much repeated, are made distinct and counted
    before anything is gathered."""
    keys = ["scope", "basket"]
    crowded = cut(src.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 32 * max_basket).select(*keys))
    marked = _if_small(crowded)
    few = src.join(marked, keys, "left_anti").groupBy(*keys).agg(F.collect_set("item").alias("items")).filter(F.size("items") <= max_basket)
    d = src.join(marked, keys, "left_semi").distinct()
    fit = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") <= max_basket).select(*keys)
    rest = d.join(fit, keys).groupBy(*keys).agg(F.collect_list("item").alias("items"))
    return few.unionByName(rest)


def together(
    rows: DataFrame,
    *,
    scope: str,
    basket: str,
    item: str,
    max_basket: int = 30,
    min_together: int = 5,
    min_lift: float = 3.0,
    heavy_share: float = 0.02,
    block: int = 8192,
) -> DataFrame:
    """(scope, item_a, item_b, n, n_a, n_b, together, lift) of the pairs with enough joint baskets and enough lift.

    Null scopes, baskets and items are dropped, repeated rows count once; baskets with more than ``max_basket`` distinct
    items do not count at all (the statement of the problem); lift = together * n / (n_a * n_b). item_a < item_b.
    Other columns of ``rows`` are ignored. No rows: an empty result.

    Two exact prunings keep the counting small: an item needs ``min_together`` baskets itself, and since a pair holds
    in at most min(n_a, n_b) baskets, an item with n_a > n / min_lift cannot reach the lift with any partner.
    """
    src = rows.select(F.col(scope).alias("scope"), F.col(basket).alias("basket"), F.col(item).alias("item")).dropna()
    sized = _small_baskets(src, max_basket)
    baskets = cut(sized.select("scope", F.monotonically_increasing_id().alias("bid"), "items"))
    scopes = cut(baskets.groupBy("scope").agg(F.count(F.lit(1)).alias("n")).withColumn("sid", F.monotonically_increasing_id()))
    flat = baskets.select("scope", "bid", F.explode("items").alias("item"))
    support = flat.groupBy("scope", "item").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= min_together)
    kept = cut(
        support.join(scopes, "scope")
        .filter(F.col("c") * min_lift <= F.col("n"))
        .select("scope", "sid", "item", "c", "n", F.monotonically_increasing_id().alias("iid"), (F.col("c") >= F.col("n") * heavy_share).alias("is_heavy"))
    )
    ids = flat.join(_if_small(kept.select("scope", "item", "sid", "iid", "is_heavy", "n")), ["scope", "item"])
    per = ids.groupBy("sid", "bid").agg(
        F.first("n").alias("n"),
        F.sort_array(F.collect_list(F.when(F.col("is_heavy"), F.col("iid")))).alias("heavy"),
        F.sort_array(F.collect_list(F.when(~F.col("is_heavy"), F.col("iid")))).alias("light"),
    )
    per = cut(per.filter(F.size("heavy") + F.size("light") > 1))
    ll = per.filter(F.size("light") > 1).select(
        "sid",
        F.explode(
            F.flatten(F.transform("light", lambda x, i: F.transform(F.slice("light", i + 2, F.size("light")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
        ).alias("p"),
    )
    ll = ll.groupBy("sid", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("m"))
    nblocks = F.ceil(F.col("n") / block).cast("int")
    hb = per.filter(F.size("heavy") > 0).select("sid", F.pmod(F.xxhash64("bid"), nblocks).alias("blk"), "heavy", "light")
    dense = hb.groupBy("sid", "blk").applyInPandas(_one_block, "sid long, a long, b long, m long")
    counts = ll.unionByName(dense).groupBy("sid", "a", "b").agg(F.sum("m").alias("together")).filter(F.col("together") >= min_together)
    ia = kept.select("sid", F.col("iid").alias("a"), F.col("item").alias("ia"), F.col("c").alias("ca"))
    ib = kept.select("scope", "sid", "n", F.col("iid").alias("b"), F.col("item").alias("ib"), F.col("c").alias("cb"))
    j = counts.join(ia, ["sid", "a"]).join(ib, ["sid", "b"])
    swap = F.col("ia") > F.col("ib")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    lift: Column = F.col("together") * F.col("n") / (F.col("ca") * F.col("cb"))
    return j.filter(F.col("together") * F.col("n") >= F.col("ca") * F.col("cb") * min_lift).select(
        "scope", pick("ia", "ib").alias("item_a"), pick("ib", "ia").alias("item_b"), "n", pick("ca", "cb").alias("n_a"), pick("cb", "ca").alias("n_b"), "together", lift.alias("lift")
    )

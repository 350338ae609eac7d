"""Mixing sources to target weights by Pfair scheduling.

The tokens of each source form a line: its documents in a fixed pseudo-random order, repeated up to the allowed number of
times. The line is cut into blocks; block i of a source of weight w is released at floor(i / w) and due at ceil((i + 1)
/ w) slots. Earliest deadline first gives each slot one block, so after any slot no source is a whole block away from its
target. The number of slots follows the number of sources, a block grows with the corpus; every source has as many blocks
as its tokens fill or begin, be it a part of one; documents find their slot by the running total of tokens within their
source, which no task computes alone.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.operators.prefix import hash_bucket, running_total
from codequarry.session import cut

#: About so many documents of one source are ranked by one task.
ROWS = 200_000


def pfair_schedule(weights: dict[str, float], slots: int) -> list[tuple[str, int, int]]:
    """[(source, block, slot)] by earliest deadline first; weights sum to 1. Ties go to the larger weight, then name.

    Each source gets ceil(weight * slots) blocks, the last of which it may fill only in part: there are up to one more
    slots than asked for per source, and no source is without a block, however small its weight."""
    waiting = []  # by release time
    left = {s: math.ceil(w * slots - 1e-9) for s, w in weights.items() if w > 0}
    for s, w in weights.items():
        if w > 0:
            left[s] = max(1, left[s])
            waiting.append((0, math.ceil(1 / w - 1e-9), -w, s, 0))
    heapq.heapify(waiting)
    ready: list[tuple[int, float, str, int]] = []
    out = []
    t = -1
    while waiting or ready:
        t += 1
        while waiting and waiting[0][0] <= t:
            _, due, nw, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (due, nw, s, i))
        if not ready:
            continue
        due, nw, s, i = heapq.heappop(ready)
        out.append((s, i, t))
        w = -nw
        left[s] -= 1
        if left[s]:
            heapq.heappush(waiting, (max(t + 1, math.floor((i + 1) / w + 1e-9)), math.ceil((i + 2) / w - 1e-9), nw, s, i + 1))
    return out


def plan_quotas(available: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> tuple[dict[str, float], dict[str, float]]:
    """(tokens to take, weight) by source. The weights of sources that have no documents are shared out in proportion;
    the total is the largest at which no source must repeat more than allowed, so the shares are met exactly."""
    live = {s: w for s, (w, r) in targets.items() if w > 0 and r > 0 and available.get(s, 0) > 0}
    z = sum(live.values())
    weights = {s: w / z for s, w in live.items()} if z else {}
    most = min((available[s] * targets[s][1] / w for s, w in weights.items()), default=0.0)
    most = min(most, total) if total is not None else most
    return {s: w * most for s, w in weights.items()}, weights


def mix_sources(sizes: DataFrame, targets: DataFrame, *, key: str, source: str, size: str, share: str = "target_share", repeats: str = "max_repeats", slots: int = 8192, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(mixture, report).

    mixture(slot, position, source, key, repeat, size): slot and position order the mixture; repeat counts from 0.
    report(source, target_share, available, tokens, documents, most_repeats, share): one row for each target, also for
    those without documents. Sources are compared without case and surrounding blanks; documents of other or null
    sources, and of size 0, are not selected. Of a duplicated target row the larger share counts. ``targets`` is a
    configuration table of few rows. A source's line is taken as far as its documents fit its quota whole; if one more
    of those that may still be taken brings it nearer to the quota, the best one is added.
    """
    norm = lambda c: F.lower(F.trim(F.col(c)))
    want = {r["s"]: (float(r["w"]), int(r["r"])) for r in targets.select(norm(source).alias("s"), F.col(share).alias("w"), F.col(repeats).alias("r")).dropna().orderBy("w").collect()}
    spark = sizes.sparkSession
    goal = spark.createDataFrame([(s, w, r) for s, (w, r) in sorted(want.items())] or [], "source string, target_share double, max_repeats int")
    docs = cut(sizes.select(F.col(key).alias("k"), norm(source).alias("source"), F.col(size).cast("long").alias("n")).filter("n > 0").join(F.broadcast(goal.select("source")), "source", "left_semi"))
    have = {r["source"]: r["t"] for r in docs.groupBy("source").agg(F.sum("n").alias("t")).collect()}
    quota, weights = plan_quotas(have, want, total)
    grand = sum(quota.values())
    slots = max(slots, 8 * len(weights))
    block = max(1.0, grand / slots)
    plan = spark.createDataFrame([(s, float(q), have[s]) for s, q in quota.items()] or [], "source string, quota double, line long")
    calendar = spark.createDataFrame(pfair_schedule(weights, slots), "source string, block int, slot int")
    bits = min(24, max(4, (docs.count() // ROWS).bit_length() + 1))
    bucket, order = hash_bucket("k", bits=bits)
    placed = running_total(docs.withColumn("__b", bucket).withColumn("__o", order), ["source"], "__b", ["__o", "k", "n"], F.col("n"), "before")
    rounds = placed.join(F.broadcast(plan), "source").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("quota") / F.col("line")).cast("int") - 1))))
    at = F.col("before") + F.col("repeat") * F.col("line")
    rounds = cut(rounds.withColumn("at", at))
    chosen = rounds.filter(F.col("at") + F.col("n") <= F.col("quota"))
    # what is left of the quota, and the document that fills it best: two partial aggregates, one row per source
    used = plan.select("source").join(chosen.groupBy("source").agg(F.sum("n").alias("used")), "source", "left").fillna(0, ["used"])
    over = rounds.join(F.broadcast(used), "source").filter(F.col("at") + F.col("n") > F.col("quota"))
    gap = F.abs(F.col("n") - (F.col("quota") - F.col("used")))
    extra = over.filter(gap < F.col("quota") - F.col("used")).groupBy("source").agg(F.min(F.struct(F.round(gap, 6), "at", "k", "n", "repeat", "quota", "line", "used")).alias("x"))
    extra = extra.select("source", "x.k", "x.n", "x.quota", "x.line", "x.repeat", F.col("x.used").alias("at"))
    chosen = chosen.select("source", "k", "n", "quota", "line", "repeat", "at").unionByName(extra)
    last = F.greatest(F.lit(0), F.floor(F.col("at") / block).cast("int"))
    ends = calendar.groupBy("source").agg(F.max("block").alias("end"))
    chosen = chosen.join(F.broadcast(ends), "source").withColumn("block", F.least(last, F.col("end")))
    mixture = cut(chosen.join(F.broadcast(calendar), ["source", "block"]).select("slot", F.col("at").alias("position"), "source", F.col("k").alias(key), "repeat", F.col("n").alias("size")))
    per = mixture.groupBy("source").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("documents"), (F.max("repeat") + 1).alias("most_repeats"))
    avail = docs.groupBy("source").agg(F.sum("n").alias("available"))
    report = goal.join(avail, "source", "left").join(per, "source", "left").withColumn("all_tokens", mixture.agg(F.sum("size")).scalar())
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    report = report.select(
        "source", "target_share", zero("available").alias("available"), zero("tokens").alias("tokens"), zero("documents").alias("documents"), zero("most_repeats").alias("most_repeats"),
        F.round(zero("tokens") / F.greatest(F.lit(1), zero("all_tokens")), 6).alias("share"),
    )
    return mixture, report

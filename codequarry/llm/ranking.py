"""One ranking from several differently-scaled scores: averaged-tie percentiles, inverse normal, weighted mean."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.operators.prefix import average_ranks, running_total, value_buckets
from codequarry.session import cut

# Acklam's published rational approximation of the inverse normal distribution (relative error 1.15e-9).
A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
LOW = 0.02425


def _poly(coefs: Sequence[float], x: Column, last: float | None = None) -> Column:
    acc: Column = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc if last is None else acc * x + F.lit(last)


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution, as a column expression; null outside (0, 1)."""
    tail = lambda q: _poly(C, q) / _poly(D, q, 1.0)
    q = p - 0.5
    r = q * q
    mid = _poly(A, r) * q / _poly(B, r, 1.0)
    return (
        F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
        .when(p < LOW, tail(F.sqrt(F.log(p) * -2)))
        .when(p > 1 - LOW, -tail(F.sqrt(F.log(1 - p) * -2)))
        .otherwise(mid)
    )


def clean_score(c: Column) -> Column:
    """A score or null: NaN, negative markers such as -1, and infinities are no scores."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (d >= 0) & (d < F.lit(float("inf"))), d)


def absurd_from(items: DataFrame, scores: Iterable[str], factor: float) -> dict[str, float]:
    """By score the value above which it is absurd: ``factor`` times the median of all its positive values, so the bound
    follows the scale of the score. A score without positive values has none."""
    mid = items.agg(*(F.percentile_approx(F.when(F.col(s) > 0, F.col(s)), 0.5, 10_000).alias(s) for s in scores)).first()
    return {s: factor * mid[s] for s in scores if mid[s] is not None}


def combined_ranking(df: DataFrame, *, scope: str, key: str, scores: Mapping[str, float], version: str | None = None, absurd: float = 1e6) -> DataFrame:
    """(scope, key, <score>_z ..., combined, position): one reading order of the items of each scope.

    Of repeated rows of a (scope, key) the newest ``version`` counts; ties there, and exact copies, are settled by the
    scores themselves, so the result is repeatable. Each score becomes its empirical percentile within the scope with
    averaged ties, (rank - 0.5) / n, then a normal quantile; a missing score counts as 0, the middle. ``combined`` is
    the weighted mean, position orders it descending with the key as tie-break. As only order within a scope counts, a
    scope that reports a score in percent ranks like one that does not. Rows with a null key or scope are dropped.
    Values above ``absurd`` times the median of all positive values of their score count as missing.
    """
    cols = [F.col(s) for s in scores]
    src = df.select(F.col(scope).alias("__scope"), F.col(key).alias("__key"), *cols, *([F.col(version).alias("__v")] if version else [F.lit(0).alias("__v")])).dropna(subset=["__scope", "__key"])
    newest = src.groupBy("__scope", "__key").agg(F.max(F.struct("__v", *scores)).alias("r"))
    items = newest.select("__scope", "__key", *(clean_score(F.col(f"r.{s}")).alias(s) for s in scores))
    # one long table for all scores: their percentiles are found together, in one plan however many scores there are
    items = cut(items)
    most = absurd_from(items, scores, absurd)
    items = items.select("__scope", "__key", *(F.when(F.col(s) <= most.get(s, 0.0), F.col(s)).alias(s) for s in scores))
    total = float(sum(scores.values()))
    pairs = F.array(*(F.struct(F.lit(s).alias("s"), F.col(s).alias("v")) for s in scores))
    long = items.select("__scope", "__key", F.explode(pairs).alias("x")).select("__scope", "__key", F.col("x.s").alias("__s"), F.col("x.v").alias("__x")).filter("__x is not null")
    ranks = cut(average_ranks(long, ["__scope", "__s"], "__x", "__rk", "__n"))
    z = long.join(ranks.withColumn("__z", inverse_normal((F.col("__rk") - 0.5) / F.col("__n"))).drop("__rk", "__n"), ["__scope", "__s", "__x"])
    wide = z.groupBy("__scope", "__key").agg(*(F.max(F.when(F.col("__s") == s, F.col("__z"))).alias(f"{s}_z") for s in scores))
    out = items.select("__scope", "__key").join(wide, ["__scope", "__key"], "left").fillna(0.0, [f"{s}_z" for s in scores])
    comb = sum((F.col(f"{s}_z") * w for s, w in scores.items()), F.lit(0.0)) / total
    out = cut(out.withColumn("combined", F.round(comb, 9)).withColumn("__neg", -F.col("combined")))
    out = cut(value_buckets(out, ["__scope"], "__neg", "__b"))
    out = running_total(out, ["__scope"], "__b", ["__neg", "__key"], F.lit(1), "__before")
    return out.select(F.col("__scope").alias(scope), F.col("__key").alias(key), *(f"{s}_z" for s in scores), "combined", (F.col("__before") + 1).alias("position"))

"""Hotspots and the reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions.scoring import log_norm, reading_score, reasons, round3
from codequarry.operators.prefix import global_rank


def _with_maxima(df: DataFrame, *cols: str) -> DataFrame:
    """Adds __max_<column>: one scalar subquery whatever the table's size, no window over everything and no join."""
    m = df.agg(F.struct(*(F.max(c).alias(f"__max_{c}") for c in cols))).scalar()
    return df.withColumn("__m", m).select("*", "__m.*").drop("__m")


def hotspots(df: DataFrame, *, key: str, commits: str, complexity: str, limit: int = 50) -> DataFrame:
    """(rank, key, commits, complexity, score): log-normalised change frequency times indentation complexity.

    Files without commits are left out before the maxima are taken, those of score 0 afterwards."""
    c = df.filter(F.col(commits) > 0)
    c = _with_maxima(c, commits, complexity)
    raw = log_norm(F.col(commits), F.col(f"__max_{commits}")) * log_norm(F.col(complexity), F.col(f"__max_{complexity}"))
    top = c.withColumn("raw", raw).filter("raw > 0").select(key, commits, complexity, "raw").orderBy(F.desc("raw"), key).limit(limit)
    return top.select(F.row_number().over(Window.orderBy(F.desc("raw"), key)).alias("rank"), key, commits, complexity, round3(F.col("raw")).alias("score"))


def reading_order(df: DataFrame, *, key: str, commits: str, reach: str, fan_in: str, private: str) -> DataFrame:
    """(rank, key, score, churn, reach, fan_in, reasons); rank by the unrounded score descending, then key.

    commits and fan_in are log-normalised by their maxima, reach is divided by its maximum."""
    c = _with_maxima(df, commits, reach, fan_in)
    churn, fan = log_norm(F.col(commits), F.col(f"__max_{commits}")), log_norm(F.col(fan_in), F.col(f"__max_{fan_in}"))
    rel = F.when(F.col(f"__max_{reach}") > 0, F.col(reach) / F.col(f"__max_{reach}")).otherwise(0.0)
    s = c.select(key, churn.alias("churn_n"), rel.alias("reach_n"), fan.alias("fan_n"), F.col(private).alias("p"), F.col(commits).alias("c"), F.col(fan_in).alias("f"))
    s = s.withColumn("raw", reading_score(F.col("churn_n"), F.col("reach_n"), F.col("fan_n"), F.col("p")))
    return global_rank(s, [F.desc("raw"), key], "rank").select(
        "rank", key, round3(F.col("raw")).alias("score"),
        round3(F.col("churn_n")).alias("churn"), round3(F.col("reach_n")).alias("reach"), round3(F.col("fan_n")).alias("fan_in"),
        reasons(F.col("c"), F.col("f"), F.col("reach_n"), F.col("p")).alias("reasons"),
    )

"""Scores, rounding and display rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round3(v: Column) -> Column:
    """Three decimals, halves toward plus infinity."""
    return F.floor(v.cast("double") * 1000 + 0.5) / F.lit(1000.0)


def degree(together: Column, a: Column, b: Column) -> Column:
    """Joint occurrences against the mean of the single ones."""
    return together / ((a + b) / F.lit(2.0))


def log_norm(x: Column, most: Column) -> Column:
    return F.when(most > 0, F.log1p(x.cast("double")) / F.log1p(most.cast("double"))).otherwise(0.0)


#: Weights of the reading order.
READING_WEIGHTS = {"churn": 0.55, "reach": 0.30, "fan_in": 0.15}
PRIVATE_PENALTY = 0.20


def reading_score(churn: Column, reach: Column, fan_in: Column, private: Column) -> Column:
    w = READING_WEIGHTS
    return churn * w["churn"] + reach * w["reach"] + fan_in * w["fan_in"] - F.when(private, PRIVATE_PENALTY).otherwise(0.0)


def reasons(commits: Column, fan_in: Column, reach: Column, private: Column) -> Column:
    """Why a file is worth reading, as fixed texts with singular and plural."""
    changed = F.when(commits == 0, "No commits recorded").otherwise(F.concat(F.lit("Changed in "), commits.cast("string"), F.when(commits == 1, " commit").otherwise(" commits")))
    imported = F.when(fan_in == 0, "Not imported by other non-test files").otherwise(
        F.concat(F.lit("Imported by "), fan_in.cast("string"), F.lit(" non-test "), F.when(fan_in == 1, "file").otherwise("files"))
    )
    far = F.when(reach >= 0.5, "Pulls in much of the codebase, directly or indirectly")
    return F.array_compact(F.array(changed, imported, far, F.when(private, "Private module, ranked lower")))


def percent(v: Column) -> Column:
    return F.concat(F.format_number(v * 100, 0), F.lit("%"))


def edge_width(weight: Column) -> Column:
    return F.least(F.lit(4.0), 1 + F.log2(weight.cast("double")) / 2)

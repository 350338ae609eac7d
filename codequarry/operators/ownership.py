"""Ownership of files and directories: owners, bus factor, flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions.paths import ancestors
from codequarry.functions.scoring import round3


def owned_lines(blame: DataFrame, people: DataFrame, *, path: str = "path", email: str = "email", lines: str = "lines") -> DataFrame:
    """(path, owner, lines): lines per person; bots and unknown emails are dropped, emails compare in lower case."""
    who = people.select("id", F.explode("emails").alias("m"), F.coalesce("bot", F.lit(False)).alias("bot")).select(F.lower("m").alias("m"), "id", "bot").filter(~F.col("bot"))
    return blame.join(who, F.lower(F.col(email)) == F.col("m")).groupBy(F.col(path).alias("path"), F.col("id").alias("owner")).agg(F.sum(lines).alias("lines"))


def roll_up(owned: DataFrame) -> DataFrame:
    """Lines per (directory, owner) for every directory above a file, ``.`` included."""
    return owned.select(F.explode(ancestors(F.col("path"))).alias("path"), "owner", "lines").groupBy("path", "owner").agg(F.sum("lines").alias("lines"))


def ownership(
    owned: DataFrame, *, last_seen: DataFrame | None = None, as_of: object | None = None, active_days: int = 365, top: int = 5, flag_lines: int = 100, flag_share: float = 0.8
) -> DataFrame:
    """(path, total, owners, other_lines, owner_count, bus_factor, top_owner, top_share, top_active, flags).

    Owners are ordered by lines descending, then id; bus_factor is the smallest number of them that hold half of the
    lines. ``single-owner``: one holds half, at least ``flag_share`` (unrounded) of at least ``flag_lines`` lines;
    ``orphaned``: and was not seen within ``active_days`` before ``as_of``. The lines are summed per owner before the
    window, so a path is as many rows as it has people.
    """
    base = owned.groupBy("path", "owner").agg(F.sum("lines").alias("lines")).filter("lines > 0")
    w = Window.partitionBy("path").orderBy(F.desc("lines"), "owner")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("path")
    r = base.select("path", "owner", "lines", F.row_number().over(w).alias("rn"), F.sum("lines").over(run).alias("cum"), F.sum("lines").over(whole).alias("total"))
    if last_seen is not None:
        r = r.join(last_seen.select(F.col(last_seen.columns[0]).alias("owner"), F.col(last_seen.columns[1]).alias("seen")), "owner", "left")
    else:
        r = r.withColumn("seen", F.lit(None).cast("timestamp"))
    share = F.col("lines") / F.col("total")
    g = r.groupBy("path").agg(
        F.max("total").alias("total"),
        F.sort_array(F.collect_list(F.when(F.col("rn") <= top, F.struct("rn", F.col("owner").cast("string").alias("owner"), "lines", round3(share).alias("share"))))).alias("owners"),
        F.sum(F.when(F.col("rn") > top, F.col("lines")).otherwise(0)).alias("other_lines"),
        F.count(F.lit(1)).alias("owner_count"),
        F.min(F.when(F.col("cum") * 2 >= F.col("total"), F.col("rn"))).alias("bus_factor"),
        F.max(F.when(F.col("rn") == 1, F.col("owner"))).alias("top_owner"),
        F.max(F.when(F.col("rn") == 1, share)).alias("top_raw"),
        F.max(F.when(F.col("rn") == 1, F.col("seen"))).alias("seen"),
    )
    limit = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {active_days} DAYS")
    active = F.coalesce(F.col("seen").cast("timestamp") >= limit, F.lit(False)) if as_of is not None else F.lit(True)
    single = (F.col("total") >= flag_lines) & (F.col("bus_factor") == 1) & (F.col("top_raw") >= flag_share)
    return g.select(
        "path", "total", "owners", "other_lines", "owner_count", "bus_factor", "top_owner", round3(F.col("top_raw")).alias("top_share"), active.alias("top_active"),
        F.array_compact(F.array(F.when(single, "single-owner"), F.when(single & ~active, "orphaned"))).alias("flags"),
    )

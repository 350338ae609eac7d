"""Repository overview: totals, languages, components, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import paths as P
from codequarry.functions.scoring import round3


def overview(files: DataFrame, commits: DataFrame | None = None, people: DataFrame | None = None) -> DataFrame:
    """One row: files, code_lines, test_file_ratio (of code files, three places, null without any), contributors,
    commits, first_commit_at, last_commit_at."""
    code = P.is_code(F.lower("language")) & ~F.coalesce("is_binary", F.lit(False))
    a = files.agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.when(code, F.col("lines"))), F.lit(0)).alias("code_lines"),
        F.when(F.count_if(code) > 0, round3(F.count_if(code & F.col("is_test")) / F.count_if(code))).alias("test_file_ratio"),
    )
    if people is not None:
        a = a.withColumn("contributors", people.agg(F.count_if(~F.coalesce("bot", F.lit(False)))).scalar())
    if commits is not None:
        c = commits.agg(F.struct(F.count_distinct("commit_id").alias("commits"), F.min("ts").alias("first_commit_at"), F.max("ts").alias("last_commit_at"))).scalar()
        a = a.withColumn("__c", c).select("*", "__c.*").drop("__c")
    return a


def languages(files: DataFrame) -> DataFrame:
    """(language, files, lines) of known, non-binary languages; lines descending, then name."""
    f = files.filter(F.col("language").isNotNull() & ~F.coalesce("is_binary", F.lit(False)))
    return f.groupBy(F.lower("language").alias("language")).agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines")).orderBy(F.desc("lines"), "language")


def top_languages(langs: DataFrame, most: int = 6) -> DataFrame:
    """The first ``most`` languages and the rest as ``other``."""
    r = langs.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("lines"), "language")))
    return r.groupBy(F.when(F.col("rn") <= most, F.col("language")).otherwise("other").alias("language")).agg(F.sum("files").alias("files"), F.sum("lines").alias("lines"))


def component_table(files: DataFrame, layers: DataFrame | None = None) -> DataFrame:
    """(component, files, lines[, layer]) per directory."""
    c = files.groupBy(P.component_of(F.col("path")).alias("component")).agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"))
    return c.join(layers.select(F.col("node").alias("component"), "layer"), "component", "left") if layers is not None else c


def limits(files: DataFrame, parse_errors: DataFrame, *, overflow: DataFrame | None = None) -> DataFrame:
    """(path, reason) of everything that was skipped or failed, sorted."""
    s = files.filter("skip_reason is not null").select("path", F.col("skip_reason").alias("reason"))
    s = s.union(parse_errors.select(F.regexp_replace("path", r"^\./", "").alias("path"), F.lit("parse error").alias("reason")))
    if overflow is not None:
        s = s.union(overflow.select("path", F.lit("blame cap").alias("reason")))
    return s.distinct().orderBy("path", "reason")


def blame_candidates(files: DataFrame, commits_per_file: DataFrame, most: int = 3000) -> DataFrame:
    """(path, commits, chosen): code files, tests included, by commits descending and path; the rest is over the cap.

    The first ``most`` are found by a distributed top-k, and the flag is a semi-join against them."""
    f = files.filter(P.is_code(F.lower("language")) & ~F.col("is_binary") & F.col("skip_reason").isNull() & F.col("generated_reason").isNull())
    j = f.select("path").join(commits_per_file, "path", "left").select("path", F.coalesce("commits", F.lit(0)).alias("commits"))
    top = j.orderBy(F.desc("commits"), "path").limit(most).select("path", F.lit(True).alias("chosen"))
    return j.join(top, "path", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))

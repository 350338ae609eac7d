"""Text and JSON sources, and all sinks."""

from __future__ import annotations

import os
import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = (
    "repo string, files array<struct<path:string,centrality:double,reverseCentrality:double,fanIn:int,churn:int,lines:int,privateModule:boolean>>, "
    "docsMentioned array<string>, newcomerFiles array<string>"
)
SECTIONS = "repo overview files edges components people ownership coupling hotspots readingOrder findings limits".split()


def repo_list(spark: SparkSession, path: str) -> DataFrame:
    """(value): one repository per line, without blanks and comments."""
    return spark.read.text(path).select(F.trim("value").alias("value")).filter((F.col("value") != "") & ~F.col("value").startswith("#"))


def features_json(spark: SparkSession, path: str) -> DataFrame:
    """Typed per-repository features of the weight search."""
    return spark.read.schema(FEATURES).json(path, multiLine=True)


def report_json(spark: SparkSession, path: str, name: str | None = None, allowed: list[str] | None = None) -> DataFrame:
    """(value): stored reports verbatim; a demo name must be on the list of allowed ones."""
    if name is not None:
        if not re.fullmatch(r"[a-z0-9-]+", name) or name not in (allowed or []):
            raise ValueError(f"unknown report {name!r}")
        path = os.path.join(path, f"{name}.json")
    return spark.read.text(path, wholetext=True)


def database_url(url: str | None) -> dict[str, str]:
    """JDBC options of a postgres:// URL; nothing for others."""
    from urllib.parse import urlsplit

    if not url or not url.strip().startswith(("postgres://", "postgresql://")):
        return {}
    u = urlsplit(url.strip())
    if not u.hostname:
        return {}
    out = {"url": f"jdbc:postgresql://{u.hostname}:{u.port or 5432}{u.path or '/'}" + (f"?{u.query}" if u.query else "")}
    if u.username:
        out["user"] = unquote(u.username)
    if u.password is not None:
        out["password"] = unquote(u.password)
    return out


def chunk_table(spark: SparkSession, path: str, analysis_id: str | None = None) -> DataFrame:
    """Stored chunks; an analysis is a partition, so a filter on it reads nothing else."""
    df = spark.read.parquet(path)
    return df.filter(F.col("analysis_id") == analysis_id) if analysis_id is not None else df


def write_chunks(chunks: DataFrame, path: str, *, rows_per_file: int = 1_000_000) -> None:
    """Appends chunks, partitioned by analysis; a large analysis is several files, its rows spread by hash of the path."""
    (
        chunks.repartition("analysis_id", F.pmod(F.xxhash64("path"), F.lit(16)))
        .write.mode("append").option("maxRecordsPerFile", rows_per_file).partitionBy("analysis_id").parquet(path)
    )


def write_postings(index: DataFrame, path: str, *, parts: int = 200) -> None:
    """The inverted index, range-partitioned and sorted by term, so that a term's rows are few neighbouring row groups."""
    index.repartitionByRange(parts, "term").sortWithinPartitions("term").write.mode("overwrite").parquet(path)


def drop_expired(spark: SparkSession, path: str, keep: DataFrame, key: str = "analysis_id") -> int:
    """Deletes the partitions of analyses that are not kept; their number. The names of the partitions are compared with
    all keys of ``keep`` by a join, however many these are."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = [s.getPath().getName() for s in (fs.listStatus(root) if fs.exists(root) else [])]
    named = [(n, unquote(n.split("=", 1)[1])) for n in there if n.startswith(f"{key}=")]
    if not named:
        return 0
    parts = spark.createDataFrame(named, "name string, k string")
    gone = 0
    for r in parts.join(keep.select(F.col(key).cast("string").alias("k")), "k", "left_anti").toLocalIterator():
        fs.delete(jvm.org.apache.hadoop.fs.Path(root, r["name"]), True)
        gone += 1
    return gone


def append_status(events: DataFrame, path: str) -> None:
    """Job states are appended, never updated; the current one is the latest."""
    events.write.mode("append").parquet(path)


def assemble(sections: dict[str, DataFrame], limit_rows: int | None = None) -> DataFrame:
    """(value): one JSON document with the sections in the order given; nulls are left out.

    A section of one row under the names repo and overview is an object, others are arrays in the order of their rows'
    text. A report is for one repository; for many, write the sections as tables instead."""
    out = None
    for i, (name, df) in enumerate(sections.items()):
        d = df.limit(limit_rows) if limit_rows else df
        row = F.to_json(F.struct(*d.columns), {"ignoreNullFields": "true"})
        one = d.select(row.alias("j")).agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("j")), ","), F.lit("]")).alias("v"))
        if name in ("repo", "overview"):
            one = one.select(F.expr("substr(v, 2, length(v) - 2)").alias("v"))
        one = one.select(F.lit(i).alias("i"), F.concat(F.lit(f'"{name}":'), F.when(F.col("v") == "", "null").otherwise(F.col("v"))).alias("v"))
        out = one if out is None else out.unionByName(one)
    joined = out.agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("x"))
    return joined.select(F.concat(F.lit("{"), F.array_join(F.transform("x", lambda y: y["v"]), ","), F.lit("}")).alias("value"))


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").text(path)


def write_eval(results: DataFrame, features: DataFrame, path: str) -> None:
    """Results and features side by side."""
    results.write.mode("overwrite").json(os.path.join(path, "results.json"))
    features.write.mode("overwrite").json(os.path.join(path, "features.json"))


def write_markdown(spark: SparkSession, text: str, path: str) -> None:
    """A summary, as one text file below ``path`` on any file system that Spark knows."""
    write_report(spark.createDataFrame([(text,)], "value string"), path)

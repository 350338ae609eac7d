"""Files that do not parse, and the rates per repository and language."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm import lexers


def parse_files(df: DataFrame, *, key: str, repo: str, path: str, text: str) -> DataFrame:
    """(key, repo, path, language, parses, error_kind, error_line) of every file with a known extension.

    The extension alone names the language; other files give no row. A null text counts as empty. Files are independent,
    nothing is shuffled; the lexers of :mod:`lexers` see whole texts. error_line is 1-based, null where the file parses.
    """
    ext = F.regexp_extract(F.col(path), r"(\.(?:py|js|ts|json|toml))$", 1)
    names = F.create_map(*(F.lit(x) for kv in lexers.LANGUAGES.items() for x in kv))
    src = df.filter(ext != "").select(F.col(key).alias("k"), F.col(repo).alias("r"), F.col(path).alias("p"), names[ext].alias("language"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [lexers.check(a, b) for a, b in zip(pdf["language"], pdf["t"])]
            yield pdf[["k", "r", "p", "language"]].assign(
                parses=[x is None for x in found], error_kind=[x and x[0] for x in found], error_line=pd.array([x and x[1] for x in found], dtype="Int32")
            )

    kind = src.schema["k"].dataType.simpleString()
    out = src.mapInPandas(run, f"k {kind}, r string, p string, language string, parses boolean, error_kind string, error_line int")
    return out.select(F.col("k").alias(key), F.col("r").alias(repo), F.col("p").alias(path), "language", "parses", "error_kind", "error_line")


def parse_rates(files: DataFrame, *, repo: str) -> DataFrame:
    """(repo, language, files, failing, rate) from the rows of :func:`parse_files`."""
    return (
        files.groupBy(repo, "language")
        .agg(F.count(F.lit(1)).alias("files"), F.count_if(~F.col("parses")).alias("failing"))
        .withColumn("rate", F.round(F.col("failing") / F.col("files"), 6))
    )

"""Chunks of files for retrieval: symbols of Python files, windows of other texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions.text import split_lines
from codequarry.session import cut

MAX_LINES, SPLIT_CLASS, WINDOW, MIN_LINES = 200, 60, 100, 2


def _body(start: str, end: str) -> F.Column:
    return F.array_join(F.slice("lines", F.col(start), F.col(end) - F.col(start) + 1), "\n")


def windows(texts: DataFrame, *, key: str | list[str] = "path", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(key..., start_line, end_line, body): windows of ``size`` lines; blank ones are dropped."""
    keys = [key] if isinstance(key, str) else key
    t = texts.select(*keys, split_lines(F.col(text)).alias("lines")).filter(F.size("lines") > 0)
    w = t.select(*keys, "lines", F.explode(F.sequence(F.lit(1), F.size("lines"), F.lit(size))).alias("start_line"))
    w = w.withColumn("end_line", F.least(F.size("lines"), F.col("start_line") + (size - 1)))
    return w.select(*keys, "start_line", "end_line", _body("start_line", "end_line").alias("body")).filter(F.col("body").rlike(r"\S"))


def symbol_chunks(texts: DataFrame, symbols: DataFrame) -> DataFrame:
    """([repo,] path, start_line, end_line, kind, symbol, body) of Python files.

    Top-level symbols are chunks; a class over 60 lines is its header and its methods (every definition within its lines
    whose parent has its name); what lies between symbols is cut into module chunks of at most 200 lines, blank ones
    dropped; a chunk of one line without a symbol is dropped. symbols: path, kind, name, start_line, end_line, parent.
    """
    by = ["repo", "path"] if "repo" in symbols.columns else ["path"]
    t = texts.select(*by, split_lines(F.col("text")).alias("lines")).filter(F.size("lines") > 0)
    symbols = cut(symbols.select(*by, "kind", "name", "start_line", "end_line", "parent"))  # read by five branches
    top = symbols.filter("parent is null").select(*by, "kind", "name", "start_line", "end_line")
    w = Window.partitionBy(*by).orderBy("start_line", "end_line")
    before = F.coalesce(F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = top.withColumn("from_line", before + 1)
    gaps = spans.select(*by, F.col("from_line").alias("f"), (F.col("start_line") - 1).alias("t"))
    last = t.select(*by, F.size("lines").alias("n")).join(top.groupBy(*by).agg(F.max("end_line").alias("e")), by, "left").select(*by, (F.coalesce("e", F.lit(0)) + 1).alias("f"), F.col("n").alias("t"))
    gaps = gaps.union(last).filter("f <= t")
    gaps = gaps.select(*by, "t", F.explode(F.sequence(F.col("f"), F.col("t"), F.lit(MAX_LINES))).alias("start_line"))
    mod = gaps.select(*by, "start_line", F.least(F.col("t"), F.col("start_line") + (MAX_LINES - 1)).alias("end_line"), F.lit("module").alias("kind"), F.lit(None).cast("string").alias("symbol"))
    long = (F.col("kind") == "class") & (F.col("end_line") - F.col("start_line") + 1 > SPLIT_CLASS)
    plain = top.filter(~long).select(*by, "start_line", "end_line", "kind", F.col("name").alias("symbol"))
    cls = top.filter(long).select(*by, F.col("name").alias("c"), F.col("start_line").alias("cs"), F.col("end_line").alias("ce"))
    inner = symbols.filter("parent is not null").select(*by, F.col("parent").alias("c"), "name", "start_line", "end_line")
    meth = cls.join(inner, [*by, "c"]).filter("start_line >= cs and end_line <= ce")
    heads = cls.join(meth.groupBy(*by, "c", "cs").agg(F.min("start_line").alias("m")), [*by, "c", "cs"], "left").select(
        *by, F.col("cs").alias("start_line"), F.coalesce(F.col("m") - 1, F.least("ce", F.col("cs") + (MAX_LINES - 1))).alias("end_line"), F.lit("class").alias("kind"), F.col("c").alias("symbol")
    )
    meths = meth.select(*by, "start_line", "end_line", F.lit("method").alias("kind"), F.concat_ws(".", "c", "name").alias("symbol"))
    allc = mod.unionByName(plain).unionByName(heads).unionByName(meths).join(t, by)
    out = allc.select(*by, "start_line", "end_line", "kind", "symbol", _body("start_line", "end_line").alias("body"))
    blank = F.col("symbol").isNull() & (~F.col("body").rlike(r"\S") | (F.col("end_line") - F.col("start_line") + 1 < MIN_LINES))
    return out.filter(~blank)


def cap(chunks: DataFrame, most: int = 50_000, order: str = "path") -> DataFrame:
    """Whole files in order until the file that reaches ``most`` chunks, that file included."""
    # every file has at least one chunk: the first ``most`` files are enough to find the one that reaches the cap
    per = chunks.groupBy(order).agg(F.count(F.lit(1)).alias("n")).orderBy(order).limit(most)
    kept = per.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter(F.col("before") < most)
    return chunks.join(kept.select(order), order, "left_semi")

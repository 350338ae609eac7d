"""Row-level rules on texts, as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Markers of generators; suffixes cut by the crude stemmer, in order.
GENERATED_MARKERS = ["@generated", "DO NOT EDIT", "Code generated"]
STEM_SUFFIXES = ["ing", "ed", "es", "s"]
MAIN_GUARD = r"""__name__\s*==\s*['"]__main__['"]|['"]__main__['"]\s*==\s*__name__"""
CITATION = r"([A-Za-z0-9_./\\-]+\.[A-Za-z0-9]+):(\d+)(?:\s*[-–]\s*(\d+))?"
DOC_FILE = r"(?i)^(readme|contributing|architecture|hacking|development|design|internals)(\.(md|rst|txt))?$|^docs?/.*\.(md|rst|txt)$"
NOT_GUIDANCE = r"(?i)changelog|changes|history|news|release|upgrading|migration|api|reference|autoapi|_build|_static"
PATH_TOKEN = r"[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)*\.py\b"
MODULE_TOKEN = r"\b[a-z_][a-z0-9_]*(?:\.[a-z_][a-z0-9_]*)+\b"
CONFIG_MODULE = r"([A-Za-z_][\w.]*)\s*:\s*[A-Za-z_]\w*"
DOTTED = r"\b[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+\b"
BOT = r"(?i)\[bot]|^(dependabot|renovate|pre-commit-ci|github-actions|greenkeeper|allcontributors|snyk-bot)\b"


def _newline_lines(text: Column) -> Column:
    """Lines by ``\\n`` alone; an unterminated last line counts, an empty rest does not."""
    cut = F.split(text, "\n", -1)
    return F.when(text == "", F.array().cast("array<string>")).when(text.endswith("\n"), F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)


def line_metrics(text: Column) -> Column:
    """struct(lines, non_blank, indent_complexity): per non-blank line a quarter of its indent, tabs counting four.

    Blank means only spaces, tabs, carriage returns and form feeds; the latter two add no indent. Null stays null."""
    ls = _newline_lines(text)
    blank = lambda x: x.rlike(r"^[ \t\r\f]*$")
    lead = lambda x: F.regexp_extract(x, r"^([ \t\r\f]*)", 1)
    width = lambda x: F.length(F.replace(F.regexp_replace(lead(x), "[\r\f]", ""), F.lit("\t"), F.lit("    ")))
    solid = F.filter(ls, lambda x: ~blank(x))
    return F.struct(
        F.size(ls).alias("lines"), F.size(solid).alias("non_blank"),
        F.aggregate(solid, F.lit(0), lambda acc, x: acc + F.floor(width(x) / 4).cast("int")).alias("indent_complexity"),
    )


def generated_marker(text: Column) -> Column:
    """``marked as generated`` if one of the first five lines carries a marker."""
    head = F.substring_index(text, "\n", 5)
    hit = F.lit(False)
    for m in GENERATED_MARKERS:
        hit = hit | (F.instr(head, m) > 0)
    return F.when(hit, "marked as generated")


def looks_binary(content: Column) -> Column:
    """A NUL among the first 8,000 bytes."""
    return F.substring(content, 1, 8000).contains(F.unhex(F.lit("00")))


def split_lines(text: Column) -> Column:
    """Lines by any line end, without the empty piece after a final one."""
    cut = F.split(text, r"\R", -1)
    return F.when((F.size(cut) > 1) & (F.element_at(cut, -1) == ""), F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def significant_lines(text: Column, least: int = 8) -> Column:
    """Distinct stripped lines of at least ``least`` characters that are no comments."""
    ls = F.transform(F.split(text, r"\R"), strip)
    return F.array_distinct(F.filter(ls, lambda x: (F.length(x) >= least) & ~x.startswith("#") & ~x.startswith("//")))


def body_lines(text: Column, start: Column, end: Column) -> Column:
    """Stripped lines after line ``start`` up to ``end`` that are neither blank nor comment."""
    ls = F.split(text, r"\R", -1)
    body = F.slice(ls, start + 1, F.greatest(F.lit(0), F.least(end, F.size(ls)) - start))
    return F.filter(F.transform(body, strip), lambda x: (x != "") & ~x.startswith("#"))


def terms(question: Column) -> Column:
    return F.filter(F.split(F.lower(question), "[^a-z0-9_]+"), lambda w: F.length(w) >= 3)


def split_words(symbol: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(symbol, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+"), lambda w: w != "")


def stem(word: Column) -> Column:
    out = F.when(word.endswith("ss"), word)
    for s in STEM_SUFFIXES:
        out = out.when(word.endswith(s) & (F.length(word) > len(s) + 2), F.substring(word, F.lit(1), F.length(word) - len(s)))
    return out.otherwise(word)


def symbol_matches(symbol: Column, ts: Column) -> Column:
    low = F.lower(symbol)
    return F.coalesce(F.array_contains(ts, low) | F.array_contains(ts, F.element_at(F.split(low, r"\."), -1)), F.lit(False))


def symbol_word_matches(symbol: Column, ts: Column) -> Column:
    ws = F.transform(F.filter(split_words(symbol), lambda w: F.length(w) >= 3), stem)
    return F.coalesce(F.arrays_overlap(ws, F.transform(ts, stem)), F.lit(False))


def path_matches(path: Column, ts: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.coalesce(F.array_contains(ts, name) | F.array_contains(ts, F.substring_index(name, ".", 1)), F.lit(False))


def any_of_query(ts: Column) -> Column:
    """The sanitised OR query of a list of terms."""
    clean = F.transform(ts, lambda t: F.regexp_replace(t, "[^A-Za-z0-9_]", ""))
    return F.array_join(F.array_distinct(F.filter(clean, lambda t: t != "")), " | ")


def citations(answer: Column) -> Column:
    """array<struct(path, start, end)> of ``path:line[-line]`` mentions, distinct, in order of appearance."""
    found = F.regexp_extract_all(answer, F.lit(CITATION), F.lit(0))
    one = lambda x, i: F.regexp_extract(x, CITATION, i)
    num = lambda s: F.when(s != "", s.cast("int"))
    rows = F.transform(found, lambda x: F.struct(F.replace(one(x, 1), F.lit("\\"), F.lit("/")).alias("path"), num(one(x, 2)).alias("start"), num(one(x, 3)).alias("end")))
    return F.array_distinct(rows)


def location(path: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s:%d-%d", path, start, end)


def doc_tokens(text: Column) -> Column:
    """struct(paths, modules) that a documentation text mentions."""
    return F.struct(
        F.array_distinct(F.regexp_extract_all(text, F.lit(PATH_TOKEN), F.lit(0))).alias("paths"),
        F.array_distinct(F.regexp_extract_all(text, F.lit(MODULE_TOKEN), F.lit(0))).alias("modules"),
    )


def config_modules(text: Column) -> Column:
    """Module names in packaging files: ``x.y:z`` and dotted names."""
    return F.array_union(F.regexp_extract_all(text, F.lit(CONFIG_MODULE), F.lit(1)), F.regexp_extract_all(text, F.lit(DOTTED), F.lit(0)))


def is_bot(*values: Column) -> Column:
    hit = F.lit(False)
    for v in values:
        hit = hit | F.coalesce(v.rlike(BOT), F.lit(False))
    return hit


@F.pandas_udf(StringType())
def normalize_name(s: pd.Series) -> pd.Series:
    """Composed form, single blanks, lower case; Spark has no expression for Unicode normalisation. Null gives ''."""
    return s.map(lambda x: " ".join(unicodedata.normalize("NFC", x).split()).lower() if x else "")

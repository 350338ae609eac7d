"""Imports, symbols and the first error line of Python sources."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_IMPORT = re.compile(r"^\s*import\s+(.+)$")
_FROM = re.compile(r"^\s*from\s+(\.*)\s*([\w.]*)\s+import\s+(.+)$")
_DEF = re.compile(r"^(\s*)(?:async\s+)?(def|class)\s+(\w+)")

Import = tuple[int, str, bool, int, str, list[str]]
Symbol = tuple[str, str, int, int, str | None]


def parse_python(text: str) -> tuple[list[Import], list[Symbol], int]:
    """(imports, symbols, first error line or 0). Imports: line, text, from_import, level, module, names; symbols: kind,
    name, first line (of the statement itself, not its decorators), last line, enclosing definition.

    A file that does not parse is scanned line by line instead: statements are still found, an indented definition ends
    before the next line that is not deeper."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text.removeprefix("﻿"))
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        imports, symbols = _scan(text)
        return imports, symbols, max(1, getattr(e, "lineno", None) or 1)
    lines = text.splitlines()
    imports: list[Import] = []
    symbols: list[Symbol] = []
    stack: list[tuple[ast.AST, str | None]] = [(tree, None)]
    while stack:
        node, parent = stack.pop()
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            raw = " ".join(" ".join(lines[node.lineno - 1 : node.end_lineno]).split())
            if isinstance(node, ast.Import):
                imports += [(node.lineno, raw, False, 0, a.name, []) for a in node.names]
            else:
                imports.append((node.lineno, raw, True, node.level, node.module or "", [a.name for a in node.names]))
            continue
        inner = parent
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            symbols.append(("class" if isinstance(node, ast.ClassDef) else "function", node.name, node.lineno, node.end_lineno or node.lineno, parent))
            inner = node.name
        stack += [(c, inner) for c in ast.iter_child_nodes(node) if not isinstance(c, ast.expr)]
    return sorted(imports, key=lambda x: x[0]), sorted(symbols, key=lambda x: (x[2], -x[3])), 0


def _scan(text: str) -> tuple[list[Import], list[Symbol]]:
    lines = text.split("\n")
    imports: list[Import] = []
    symbols: list[Symbol] = []
    for i, raw in enumerate(lines, 1):
        line = raw.split("#")[0].rstrip()
        joined, j = line, i
        while "(" in joined and ")" not in joined and _FROM.match(joined) and j < len(lines):
            joined += " " + lines[j].split("#")[0].strip()
            j += 1
        if m := _FROM.match(joined):
            names = [re.split(r"\s+as\s+", n.strip())[0] for n in m.group(3).strip("() \t").split(",") if n.strip()]
            imports.append((i, " ".join(joined.split()), True, len(m.group(1)), m.group(2), names))
        elif m := _IMPORT.match(line):
            for n in m.group(1).split(","):
                imports.append((i, " ".join(line.split()), False, 0, re.split(r"\s+as\s+", n.strip())[0], []))
        elif m := _DEF.match(line):
            depth = len(m.group(1).expandtabs(8))
            end = i
            for k in range(i, len(lines)):
                if lines[k].strip():
                    if len(lines[k]) - len(lines[k].lstrip()) <= depth:
                        break
                    end = k + 1
            parent = next((n for kind, n, s, e, p in reversed(symbols) if s < i <= e), None)
            symbols.append(("class" if m.group(2) == "class" else "function", m.group(3), i, end, parent))
    return imports, symbols


PARSED = (
    "path string, first_error_line int, "
    "imports array<struct<ord:int,line:int,text:string,from_import:boolean,level:int,module:string,names:array<string>>>, "
    "symbols array<struct<ord:int,kind:string,name:string,start_line:int,end_line:int,parent:string>>"
)


def parse_files(texts: DataFrame, *, path: str = "path", text: str = "text", repo: str | None = None) -> DataFrame:
    """([repo,] path, first_error_line, imports, symbols) of every row; null texts count as empty. Files are independent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r, p, t in zip(pdf["r"], pdf["p"], pdf["t"]):
                im, sy, err = parse_python(t or "")
                rows.append((r, p, err, [dict(zip(("ord", "line", "text", "from_import", "level", "module", "names"), (i, *x))) for i, x in enumerate(im)], [dict(zip(("ord", "kind", "name", "start_line", "end_line", "parent"), (i, *x))) for i, x in enumerate(sy)]))
            yield pd.DataFrame(rows, columns=["repo", "path", "first_error_line", "imports", "symbols"])

    out = texts.select((F.col(repo) if repo else F.lit("")).cast("string").alias("r"), F.col(path).alias("p"), F.col(text).alias("t")).mapInPandas(run, "repo string, " + PARSED)
    return out if repo else out.drop("repo")


def _scope(df: DataFrame) -> list[str]:
    return ["repo", "path"] if "repo" in df.columns else ["path"]


def imports_of(parsed: DataFrame) -> DataFrame:
    return parsed.select(*_scope(parsed), F.explode("imports").alias("x")).select(*_scope(parsed), "x.*")


def symbols_of(parsed: DataFrame) -> DataFrame:
    return parsed.select(*_scope(parsed), F.explode("symbols").alias("x")).select(*_scope(parsed), "x.*")

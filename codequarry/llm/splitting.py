"""Splitting oversized items at natural boundaries by dynamic programming over boundary positions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Penalties of cutting before a line; a cut inside a line costs MID, one inside a word WORD. Fixed weights.
TOP, BLANK, SHALLOW, DEDENT, LINE, SENTENCE, MID, WORD = 0.0, 0.6, 1.0, 1.5, 3.0, 1.2, 12.0, 30.0
#: Penalty of each line that an overlap is short of: above what other cuts cost.
SHORT = 100.0
_DEF = re.compile(r"\s*(?:@|(?:async\s+)?def\s|class\s|export\s|function\b|interface\s|(?:pub\s+)?fn\s|const\s+\w+\s*=\s*(?:async\s*)?\()")
_HEAD = re.compile(r"#{1,6}\s|={3,}|-{3,}\s*$|\* |- |\d+[.)]\s")
_SENT = re.compile(r"[.!?:;][\"')\]]*\s*$")


def _cuts(body: str, kind: str, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, penalty, is line start) of every place where the body may be cut, with both ends."""
    lines = re.findall(r"[^\n]*\n|[^\n]+", body)
    prose = kind in ("text", "module") and not any(_DEF.match(x) for x in lines)
    pos, pen, start = [0], [0.0], [True]
    at, prev, prev_indent = 0, "", 0
    for i, line in enumerate(lines):
        text = line.strip()
        indent = len(line) - len(line.lstrip()) if text else prev_indent
        if i:
            if not text:
                p = LINE
            elif not prev.strip():
                p = TOP if (_HEAD.match(line) if prose else indent == 0 or _DEF.match(line)) else BLANK
            elif prose:
                p = TOP if _HEAD.match(line) else SENTENCE if _SENT.search(prev) else LINE
            elif _DEF.match(line) and not prev.lstrip().startswith("@"):
                p = SHALLOW if indent else TOP
            else:
                p = DEDENT if indent < prev_indent else LINE
            pos.append(at)
            pen.append(p)
            start.append(True)
        if len(line) > limit // 4:
            for m in re.finditer(r"[\s,;}\])]+", line):
                if m.end() < len(line) and at + m.end() - pos[-1] >= 40:
                    pos.append(at + m.end())
                    pen.append(SENTENCE + 3 if _SENT.search(line[max(0, m.start() - 1) : m.end()]) else MID)
                    start.append(False)
            known = [p for p in pos if p > at] + [at + len(line)]
            left = at
            for nxt in known:
                for x in range(left + limit // 4, nxt, limit // 4):
                    pos.append(x - (body[x - 1 : x + 1] == "\r\n"))
                    pen.append(WORD)
                    start.append(False)
                left = nxt
        at += len(line)
        prev, prev_indent = line, indent
    pos.append(len(body))
    pen.append(0.0)
    start.append(True)
    p = np.asarray(pos)
    order = np.argsort(p, kind="stable")
    return p[order], np.asarray(pen)[order], np.asarray(start)[order]


def split_points(body: str, kind: str, limit: int = 4000, overlap_lines: int = 0) -> list[tuple[int, int]]:
    """Character ranges [begin, end) of the pieces of one body; each at most ``limit`` long, together the whole body.

    Minimises the sum of cut penalties and of (1 - length / limit)^2, the imbalance. A piece begins ``overlap_lines``
    line starts before the cut that ends the piece before it; after a cut inside a line the begun line is the first of
    them. The overlap may take as much of the limit as it needs. It is shorter only where the next place to cut would be
    out of reach, or where the piece would begin no later than the one before it, at SHORT a line.
    """
    n = len(body)
    if n <= limit:
        return [(0, n)]
    pos, pen, is_line = _cuts(body, kind, limit)
    m, width = len(pos), overlap_lines + 1
    starts = pos[:-1][is_line[:-1]]
    # state (cut, lines given up): where the piece after the cut begins, and what that costs; the last option is no overlap
    begin, cost = np.full((m, width), -1), np.full((m, width), np.inf)
    begin[0, -1], cost[0, -1] = 0, 0.0
    before = np.searchsorted(starts, pos)
    begin[-1, -1], cost[-1, -1] = n, 0.0
    for i in range(1, m - 1):
        # no line before this cut fits: nothing to give up
        none = pos[i + 1] - starts[before[i] - 1] > limit
        for back in range(min(overlap_lines, before[i]), -1, -1):
            at = starts[before[i] - back] if back else pos[i]
            if not back or (at > 0 and pos[i + 1] - at <= limit):
                begin[i, overlap_lines - back], cost[i, overlap_lines - back] = at, 0.0 if none else SHORT * (overlap_lines - back)
    best, came = np.full((m, width), np.inf), np.full((m, width), -1)
    best[0, -1] = 0.0
    lo = 0
    for j in range(1, m):
        while pos[lo] + limit < pos[j]:
            lo += 1
        from_, total = begin[lo:j].ravel(), best[lo:j].ravel()
        length = pos[j] - from_
        total = total + np.where((from_ >= 0) & (length <= limit), (1 - length / limit) ** 2, np.inf)
        for c in range(width):
            if begin[j, c] >= 0:
                # pieces begin one after the other
                ok = np.where(from_ < begin[j, c], total, np.inf)
                k = int(np.argmin(ok))
                best[j, c], came[j, c] = ok[k] + pen[j] + cost[j, c], lo * width + k
    out, state = [], (m - 1) * width + int(np.argmin(best[m - 1]))
    while state >= width:
        j = state // width
        state = int(came[j, state % width])
        out.append((int(begin[state // width, state % width]), int(pos[j])))
    return out[::-1]


def _base_line(start: float, end: float, n_lines: int) -> int:
    """First line of a chunk whose own line numbers may be null, reversed or off by one: the body is the authority."""
    has_s, has_e = start == start and start is not None, end == end and end is not None
    if has_s and has_e and start > end:
        start, end = end, start
    if has_s:
        return max(1, int(start))
    return max(1, int(end) - n_lines + 1) if has_e else 1


SCHEMA = "item_id long, piece int, n_pieces int, start_line int, end_line int, n_chars int, body string"


def split_oversized(
    df: DataFrame, *, key: str, text: str, kind: str | None = None, start_line: str | None = None, end_line: str | None = None, limit: int = 4000, overlap_lines: int = 0
) -> DataFrame:
    """(item_id, piece, n_pieces, start_line, end_line, n_chars, body): the pieces of every item over ``limit`` characters.

    Items within the limit, and null texts, give no rows. Line ends count as stored; ``\\r\\n`` is one line end and never
    cut apart. Lines are numbered from start_line where given, from end_line and the number of lines where only that is
    given, else from 1. Items are independent, so nothing is shuffled; null keys are kept.
    """
    if limit < 8 or overlap_lines < 0:
        raise ValueError("limit must be at least 8 and overlap_lines not negative")
    opt = lambda c, t: (F.col(c) if c else F.lit(None)).cast(t)
    big = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), opt(kind, "string").alias("kind"), opt(start_line, "double").alias("s"), opt(end_line, "double").alias("e")).filter(
        F.char_length("t") > limit
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t, kd, s, e in zip(pdf["k"], pdf["t"], pdf["kind"], pdf["s"], pdf["e"]):
                base = _base_line(s, e, t.count("\n") + (not t.endswith("\n")))
                pieces = split_points(t, kd or "text", limit, overlap_lines)
                for i, (a, b) in enumerate(pieces):
                    first = base + t.count("\n", 0, a)
                    last = base + t.count("\n", 0, max(a, b - 1))
                    rows.append((k, i + 1, len(pieces), first, last, b - a, t[a:b]))
            yield pd.DataFrame(rows, columns=["item_id", "piece", "n_pieces", "start_line", "end_line", "n_chars", "body"])

    return big.mapInPandas(run, SCHEMA)

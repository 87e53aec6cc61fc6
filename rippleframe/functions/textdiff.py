"""Unified difference of two texts along a longest common subsequence of lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CONTEXT, MAX_CELLS = 3, 4_000_000


def _script(old: list[str], new: list[str]) -> list[tuple[str, str]]:
    """(mark, line) along the longest common subsequence; a deletion comes first where both ways are as long."""
    n, m = len(old), len(new)
    if n * m > MAX_CELLS:
        return [("-", x) for x in old] + [("+", x) for x in new]
    length = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        here, below = length[i], length[i + 1]
        for j in range(m - 1, -1, -1):
            here[j] = below[j + 1] + 1 if old[i] == new[j] else max(below[j], here[j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and old[i] == new[j]:
            out.append((" ", old[i]))
            i, j = i + 1, j + 1
        elif j == m or (i < n and length[i + 1][j] >= length[i][j + 1]):
            out.append(("-", old[i]))
            i += 1
        else:
            out.append(("+", new[j]))
            j += 1
    return out


def _lines(text: str) -> list[str]:
    """Lines between line feeds (CR LF and CR count as one); what follows the last one is a line too, empty or not."""
    return text.replace("\r\n", "\n").replace("\r", "\n").split("\n")


def unified(old: str, new: str) -> str:
    """The unified format: hunks around the changes, each with its ranges of both texts; empty for equal lines.

    A line of context is one at most CONTEXT lines from a change, so hunks whose context would meet are one.  A range is
    the hunk's first line and number of lines; an empty one names the line before it.
    """
    script = _script(_lines(old), _lines(new))
    near = bytearray(len(script))
    for k, (mark, _) in enumerate(script):
        if mark != " ":
            near[max(0, k - CONTEXT) : k + CONTEXT + 1] = b"\x01" * (min(len(script), k + CONTEXT + 1) - max(0, k - CONTEXT))
    out: list[str] = []
    seen, hunk = {"-": 0, "+": 0}, []

    def close():
        if hunk:
            ranges = []
            for side in "-+":
                n = sum(mark in (side, " ") for mark, _ in hunk)
                ranges.append(f"{side}{seen[side] - n + (n > 0)},{n}")
            out.append(f"@@ {' '.join(ranges)} @@")
            out.extend(mark + line for mark, line in hunk)
            hunk.clear()

    for k, (mark, line) in enumerate(script):
        if not near[k]:
            close()
        for side in "-+":
            seen[side] += mark in (side, " ")
        if near[k]:
            hunk.append((mark, line))
    close()
    return "\n".join(out)


def unified_diff(old, new) -> Column:
    """The unified difference of two text columns; null where either is."""

    def differ(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else unified(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return F.pandas_udf(differ, "string")(old, new)

"""Where a text holds a pattern best, with some letters wrong.

A place scores the edit distance between the pattern and what begins there, by the pattern's length, plus its distance from the
start of the text by ``REACH``; the least score wins if it is at most the threshold, of equal ones the first. Since a place
further than threshold * REACH can't win, no more of a text is looked at than such a place needs; that is the rule itself.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

REACH = 1000


def distances(text: str, pattern: str) -> list[int]:
    """For each place the least edit distance of the pattern to what ends there: columns of the table of distances as bits of one integer (G. Myers, 1999)."""
    m = len(pattern)
    where: dict[str, int] = {}
    for k, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, now, out = full, 0, m, []
    for c in text:
        same = where.get(c, 0)
        across = (((same & plus) + plus) ^ plus) | same
        down = same | minus
        up, low = minus | (full & ~(across | plus)), plus & across
        now += bool(up & top) - bool(low & top)
        up, low = up << 1 & full, low << 1 & full
        plus, minus = low | (full & ~(down | up)), up & down
        out.append(now)
    return out


def located(text: str | None, pattern: str, threshold: float) -> int | None:
    """Place of the best match, from 0; None if there is none."""
    if text is None or not pattern:
        return None
    exact = text.find(pattern)
    best = (exact / REACH, exact) if 0 <= exact <= threshold * REACH else None
    seen = text[: int(threshold * REACH) + 2 * len(pattern) + 1]
    for k, errors in enumerate(reversed(distances(seen[::-1], pattern[::-1]))):
        score = errors / len(pattern) + k / REACH
        if score <= threshold and (best is None or (score, k) < best):
            best = (score, k)
    return best[1] if best else None


def locate(pattern: str, threshold: float = 0.5) -> Callable[[Column], Column]:
    @F.pandas_udf("long")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: located(t, pattern, threshold), na_action="ignore").astype("Int64")

    return find

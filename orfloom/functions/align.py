"""Pairwise alignment scores: local with affine gaps, and longest common subsequence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALIGNMENT = T.StructType(
    [T.StructField(n, t) for n, t in (("raw_score", T.DoubleType()), ("n_matches", T.IntegerType()), ("alignment_length", T.IntegerType()), ("n_gap_opens", T.IntegerType()), ("alignment", T.StringType()), ("subject_alignment", T.StringType()))]
)


#: Cells of the tables that are filled together; one byte of memory each, and some rows of numbers.
CELLS = 1 << 22

_DIAGONAL, _UP, _LEFT, _UP_OPENS, _LEFT_OPENS = 1, 2, 3, 4, 8


def _letters(texts: list[str], fill: int) -> np.ndarray:
    out = np.full((len(texts), max(map(len, texts))), fill, np.uint32)
    for row, t in zip(out, texts):
        row[: len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _traces(a: list[str], b: list[str], match: float, mismatch: float, gap_open: float, gap_extend: float) -> tuple:
    """(best score, its row, its column, way into each cell) of all pairs at once; a row of all their tables is one array operation."""
    x, y = _letters(a, 0xFFFFFFFE), _letters(b, 0xFFFFFFFF)
    size, n, m = len(a), x.shape[1], y.shape[1]
    lengths, inside = np.array([len(t) for t in a]), np.arange(m) < np.array([len(t) for t in b])[:, None]
    way, cost = np.zeros((size, n + 1, m + 1), np.uint8), gap_extend * np.arange(m + 1)
    score, up = np.zeros((size, m + 1)), np.full((size, m + 1), -np.inf)
    top, row, column = np.zeros(size), np.zeros(size, np.int64), np.zeros(size, np.int64)
    opened, one = np.zeros((size, m + 1)), np.uint8(1)
    for i in range(1, n + 1):
        opens = score + gap_open
        up += gap_extend
        up_opens = opens >= up
        np.maximum(opens, up, out=up)
        diagonal = score[:, :-1] + np.where(y == x[:, i - 1, None], match, mismatch)
        diagonal[~inside] = -np.inf
        best = opened[:, 1:]
        np.maximum(diagonal, up[:, 1:], out=best)
        np.maximum(best, 0, out=best)
        # A gap that ends at j opens at the k < j with the largest score less what its length costs: a running maximum.
        left = np.maximum.accumulate(opened - cost, axis=1)[:, :-1]
        left += cost[:-1] + gap_open
        now = score[:, 1:]
        np.maximum(best, left, out=now)
        by_left = (now != diagonal).view(np.uint8)
        kind = one + by_left + (by_left & (now != up[:, 1:]).view(np.uint8))
        kind *= (now > 0).view(np.uint8)
        left -= score[:, :-1] + gap_open
        way[:, i, 1:] = kind | up_opens[:, 1:].view(np.uint8) << 2 | (left <= 1e-9 * (1 - gap_open)).view(np.uint8) << 3
        j = now.argmax(1)
        here = now[np.arange(size), j]
        more = (here > top) & (i <= lengths)
        top[more], row[more], column[more] = here[more], i, j[more] + 1
    return top, row, column, way


def _path(a: str, b: str, i: int, j: int, width: int, way: bytes) -> tuple:
    rows, state = [], _DIAGONAL
    while i and j:
        cell = way[i * width + j]
        if state == _DIAGONAL:
            kind = cell & 3
            if not kind:
                break
            if kind == _DIAGONAL:
                rows.append((a[i - 1], b[j - 1]))
                i, j = i - 1, j - 1
            else:
                state = kind
        elif state == _UP:
            rows.append((a[i - 1], "-"))
            state = _DIAGONAL if cell & _UP_OPENS else _UP
            i -= 1
        else:
            rows.append(("-", b[j - 1]))
            state = _DIAGONAL if cell & _LEFT_OPENS else _LEFT
            j -= 1
    rows.reverse()
    first = next((k for k, (p, q) in enumerate(rows) if p == q), len(rows))
    rows = rows[first:]  # columns before add nothing
    pairs = [p != "-" and q != "-" for p, q in rows]
    blocks = sum(p and (k == 0 or not pairs[k - 1]) for k, p in enumerate(pairs))
    return sum(p == q for p, q in rows), len(rows), blocks, "".join(p for p, _ in rows), "".join(q for _, q in rows)


def local_alignments(a: list[str], b: list[str], match: float = 1, mismatch: float = 0, gap_open: float = -11, gap_extend: float = -1) -> list[tuple]:
    """(score, matches, length, aligned blocks, gapped a, gapped b) of a best local alignment of each pair.

    Pairs of like lengths are aligned together, as many as CELLS allows; a longer
    pair is aligned alone.  Opening a gap must cost as much as extending it, or more.
    """
    out: list = [(0.0, 0, 0, 0, "", "")] * len(a)
    order = sorted((k for k in range(len(a)) if a[k] and b[k]), key=lambda k: (len(b[k]), len(a[k])))
    at = 0
    while at < len(order):
        end, n, m = at, 0, 0
        while end < len(order):
            n, m = max(n, len(a[order[end]])), max(m, len(b[order[end]]))
            if end > at and (n + 1) * (m + 1) * (end - at + 1) > CELLS:
                break
            end += 1
        part = order[at:end]
        top, row, column, way = _traces([a[k] for k in part], [b[k] for k in part], match, mismatch, gap_open, gap_extend)
        for r, k in enumerate(part):
            out[k] = (float(top[r]), *_path(a[k], b[k], int(row[r]), int(column[r]), way.shape[2], way[r].tobytes()))
        at = end
    return out


def local_alignment(a: str, b: str, match: float = 1, mismatch: float = 0, gap_open: float = -11, gap_extend: float = -1) -> tuple:
    """local_alignments of one pair."""
    return local_alignments([a], [b], match, mismatch, gap_open, gap_extend)[0]


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    s, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        u = s & where.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def align(query: Column, subject: Column, none: str = "none") -> Column:
    """Struct of ALIGNMENT for each pair; a missing subject (null or ``none``) gives zeros."""

    @F.pandas_udf(ALIGNMENT)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        # A pair that is not there is a pair without letters, so it joins no table.
        there = [bool(x) and bool(y) and y != none for x, y in zip(a, b)]
        got = local_alignments([x if t else "" for x, t in zip(a, there)], [y if t else "" for y, t in zip(b, there)])
        return pd.DataFrame(got, columns=[f.name for f in ALIGNMENT.fields])

    return run(query, subject)


def sequence_identity(a: Column, b: Column) -> Column:
    """Longest common subsequence over the shorter length: the larger of both ratios."""

    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([lcs_length(p, q) / min(len(p), len(q)) if p and q else None for p, q in zip(x, y)], dtype="float64")

    return run(a, b)

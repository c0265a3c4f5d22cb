"""Alignments of many pairs at once against the table of each pair, cell by cell."""

import random

import pytest
from pyspark.sql import functions as F

from orfloom.functions import align as m


def plain(a, b, match, mismatch, gap_open, gap_extend):
    """Best local score, cell by cell."""
    low = float("-inf")
    h, up, left = ([[x] * (len(b) + 1) for _ in range(len(a) + 1)] for x in (0.0, low, low))
    best = 0.0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            up[i][j] = max(h[i - 1][j] + gap_open, up[i - 1][j] + gap_extend)
            left[i][j] = max(h[i][j - 1] + gap_open, left[i][j - 1] + gap_extend)
            h[i][j] = max(0.0, h[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), up[i][j], left[i][j])
            best = max(best, h[i][j])
    return best


def score_of(x, y, match, mismatch, gap_open, gap_extend):
    total, gap = 0.0, None
    for p, q in zip(x, y):
        own = "a" if q == "-" else "b" if p == "-" else None
        total += (match if p == q else mismatch) if own is None else gap_extend if own == gap else gap_open
        gap = own
    return total


@pytest.mark.parametrize("how", [(1, 0, -11, -1), (2, -1, -2, -1), (1.5, -0.7, -1.3, -0.4), (3, -2, -2, -2)])
def test_alignments_against_plain_tables(monkeypatch, how):
    monkeypatch.setattr(m, "CELLS", 3000)
    r, pairs = random.Random(8), [("", "AC"), ("AC", ""), ("A", "A"), ("A", "C"), ("𝔸é", "é𝔸é")]
    for _ in range(150):
        a = "".join(r.choices("ACDE", k=r.randint(1, 40)))
        b = "".join(c for c in a if r.random() < 0.8) + "".join(r.choices("ACDE", k=r.randint(0, 15)))
        pairs.append((a, b) if r.random() < 0.5 else (b or "A", a))
    got = m.local_alignments([a for a, _ in pairs], [b for _, b in pairs], *how)
    for (a, b), (score, matches, length, blocks, x, y) in zip(pairs, got):
        assert score == pytest.approx(plain(a, b, *how))
        assert x.replace("-", "") in a and y.replace("-", "") in b and len(x) == len(y) == length
        assert matches == sum(p == q for p, q in zip(x, y)) and blocks == sum(1 for k in range(length) if "-" not in (x[k], y[k]) and (k == 0 or "-" in (x[k - 1], y[k - 1])))
        assert score_of(x, y, *how) == pytest.approx(score)
        assert m.local_alignment(a, b, *how) == (score, matches, length, blocks, x, y)


def test_missing_pairs_and_long_ones(spark):
    rows = [("MKV", "MKV"), (None, "MK"), ("MK", None), ("MK", "none"), ("", "MK"), ("MKL" * 700, "MKL" * 700)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a string, b string")
    got = {r.id: r.x for r in df.select("id", m.align(F.col("a"), F.col("b")).alias("x")).collect()}
    assert got[0].raw_score == 3 and got[0].alignment == "MKV" and got[5].n_matches == 2100 and got[5].n_gap_opens == 1
    assert all(got[i].raw_score == 0 and got[i].alignment == "" for i in range(1, 5))
    assert df.limit(0).select(m.align(F.col("a"), F.col("b")).alias("x")).collect() == []

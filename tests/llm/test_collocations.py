"""Phrase collocations against brute force: nulls, empty and long texts, ties, repeated rows, hot words, other limits."""

import collections
import random
import re

import pytest

from tests.llm.test_llm import LOWER


def brute(rows, least=10, longest=3, covered=50, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        phrases = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in phrases.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in phrases.items()):
                continue
            score, k = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def texts(seed, n):
    r = random.Random(seed)
    words = ["the", "The", "of", "é", "日本", "a-b", "x\x0by", "it's", "\x00"] + [f"w{i}" for i in range(40)]
    weights = [30, 10, 20, 5, 5, 3, 3, 3, 1] + [40 / (i + 1) for i in range(40)]
    gap = lambda: r.choice([" "] * 12 + ["  ", "\t", " \t ", ", ", ".", "\n", "\r\n"])
    rows = [("".join(w + gap() for w in r.choices(words, weights, k=r.choice([0, 1, 2, 3, 30, 80]))), r.choice(["en", "de", None, "a long language"])) for _ in range(n)]
    return rows + [(None, "en"), ("", "fr"), (" \n,", "fr"), ("the " * 5000, "en"), ("of the\tof the " * 40 + "q" * 100000, None), rows[5], rows[5]]


def frame(spark, rows):
    return spark.createDataFrame([(t, la, "x", 1, 2) for t, la in rows], "text string, lang string, phrase string, n int, rank int")


@pytest.mark.parametrize("seed,n,options", [(1, 300, {}), (2, 400, {"least": 2, "covered": 90}), (3, 300, {"least": 3, "longest": 4, "top": 7}), (4, 200, {"longest": 2})])
def test_collocations(spark, seed, n, options):
    from orfloom.llm.collocations import collocations

    rows = texts(seed, n)
    got = sorted(tuple(r) for r in collocations(frame(spark, rows).repartition(3), **options).collect())
    assert got == brute(rows, **options)


@pytest.mark.parametrize("share,block", [(10**6, 4 << 20), (1, 300), (8, 2000)])
def test_salted_pivots_small_blocks_and_shared_slots(spark, monkeypatch, share, block):
    """All words, none or some are hot pivots, pivots fill several blocks, and all words rank the same: the same phrases."""
    import orfloom.llm.collocations as m

    monkeypatch.setattr(m, "HOT_SHARE", share)
    monkeypatch.setattr(m, "BLOCK_BYTES", block)
    monkeypatch.setattr(m, "HOT_KEYS", 20)
    rows = texts(5, 200)
    real = m.word_summary
    monkeypatch.setattr(m, "word_summary", lambda words: real(words) // 10**9 + 50)
    assert sorted(tuple(r) for r in m.collocations(frame(spark, rows)).collect()) == brute(rows)


def test_empty(spark):
    from orfloom.llm.collocations import collocations

    assert collocations(frame(spark, [])).collect() == []
    assert collocations(frame(spark, [(None, None), ("one", "en")])).collect() == []


def test_large_counts(spark):
    """Products beyond 64 bits."""
    from orfloom.llm import collocations as m

    rows = spark.sql("SELECT 'en' AS lang, 'a b' AS phrase, 1 AS k, 3000000001L AS a, 3000000007L AS l, 9000000001L AS r")
    score = rows.selectExpr(f"{m.SCORE} AS s").first().s
    assert score == 10**6 * 3000000001**2 // (3000000007 * 9000000001)

"""Importance resampling against brute force: nulls, empty and long texts, ties, repeated rows, clashing names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.test_llm import LOWER, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(rows, target, buckets=10000, percent=5):
    slot = lambda f: zlib.crc32(f.encode()) % buckets
    own = [features(t) for _, t in rows]
    s = collections.Counter(slot(f) for _, fs in own for f in fs)
    t = collections.Counter(slot(f) for x in target for f in features(x)[1])
    total, wanted = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (wanted + buckets)))) for b in s}
    out = []
    for (i, _), (w, fs) in zip(rows, own):
        weight = sum(gain[slot(f)] for f in fs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for rank, x in enumerate(able[: percent * len(able) // 100], 1):
        x[4] = rank
    return sorted((tuple(x[:5]) for x in out), key=str)


def texts(seed, n):
    r = random.Random(seed)
    words = ["Über", "naïve", "a", "b2", "THE", "of", "x" * 90, "y" * 64, "z" * 63, "日本", "co-op", "it's", "I"] + [f"w{i}" for i in range(300)]
    rows = [(i, "".join(r.choice(words) + r.choice([" ", " ", "\n", ", ", "\x00", "--"]) for _ in range(r.choice([0, 1, 2, 19, 20, 21, 60, 200])))) for i in range(n)]
    extra = [(n, None), (n + 1, ""), (n + 2, " ,.\n"), (None, "the " * 30), (n + 3, "the of " * 20000), (3, rows[3][1]), (3, rows[3][1]), (n + 4, "w1 " + "q" * 200000 + " w2")]
    return rows + extra


def columns(out):
    return sorted((tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("seed,n,percent", [(1, 300, 5), (2, 40, 50), (3, 7, 100)])
def test_resample(spark, seed, n, percent):
    from orfloom.llm.resampling import resample

    rows, target = texts(seed, n), [t for _, t in texts(seed + 100, 5)]
    got = resample(frame(spark, rows).repartition(3), frame(spark, list(enumerate(target))), percent=percent)
    assert columns(got) == brute(rows, target, percent=percent)


def test_many_slices_are_split(spark, monkeypatch):
    """Slices of 2,000 bytes, two to a part: a hot bucket's lists lie in many partitions."""
    import orfloom.llm.resampling as m

    real = m._postings, m._counts
    monkeypatch.setattr(m, "SPLIT_SLICES", 2)
    monkeypatch.setattr(m, "_postings", lambda *a: _small(real[0](*a)))
    rows = texts(4, 200)
    assert columns(m.resample(frame(spark, rows), frame(spark, rows[:5]))) == brute(rows, [t for _, t in rows[:5]])


def _small(rows):
    def run(batches):
        import orfloom.llm.resampling as m

        m.SLICE_BYTES = 2000
        yield from rows(batches)
        m.SLICE_BYTES = 4 << 20

    return run


def test_empty_tables_and_ids_of_other_kinds(spark):
    from orfloom.llm.resampling import resample

    rows = texts(5, 10)
    assert resample(frame(spark, []), frame(spark, rows)).collect() == []
    assert columns(resample(frame(spark, rows), frame(spark, []))) == brute(rows, [])
    named = resample(frame(spark, rows).selectExpr("concat('d', doc_id) AS doc_id", "text", "1 AS weight", "2 AS bucket"), frame(spark, rows))
    assert sorted(r.n_features for r in named.collect()) == sorted(x[1] for x in brute(rows, []))


def test_posting_lists():
    from orfloom.llm.resampling import _pack, unpack

    r = np.random.default_rng(0)
    for _ in range(50):
        lists = [np.sort(r.integers(0, r.choice([1, 5, 254, 255, 256, 70000]) + 1, r.integers(1, 50))) for _ in range(r.integers(1, 6))]
        first = np.concatenate([[True] + [False] * (len(x) - 1) for x in lists])
        data, end = _pack(np.concatenate(lists), first)
        which, place = unpack([data[a:b].tobytes() for a, b in zip([0, *end[:-1]], end)])
        assert [place[which == k].tolist() for k in range(len(lists))] == [x.tolist() for x in lists]

"""Nearest neighbours against brute force: recall, whole results, exact scores, on tables of several kinds."""

import collections

import numpy as np
import pyarrow as pa
import pytest


def frame(spark, x):
    return spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x))}))


def truth(x, ids, queries, k):
    out = {}
    for q in queries:
        s = np.einsum("d,nd->n", x[q], x)
        s[q] = -np.inf
        out[q] = np.lexsort((ids, -s))[:k], s
    return out


def kinds():
    r = np.random.default_rng(0)
    unit = lambda x: x / np.sqrt((x * x).sum(1))[:, None]
    base = r.normal(size=(10, 64))
    noise = unit(base[r.integers(0, 10, 30_000)] + 6 * r.normal(size=(30_000, 64)))
    yield "noise", noise, 250
    # Many tight groups: neighbour lists of centroids do not lead from one to the other.
    many = unit(r.normal(size=(2000, 64)))
    yield "copies", unit(many[r.integers(0, 2000, 40_000)] + 0.04 * r.normal(size=(40_000, 64))), 400
    yield "lengths", r.normal(size=(12_000, 32)) * r.lognormal(0, 1, (12_000, 1)), 20
    one = unit(r.normal(size=(12_000, 32)))
    one[77] *= 1e5
    yield "one long", one, 20
    groups = unit(r.normal(size=(1500, 32)))
    yield "groups", unit(np.repeat(groups, 8, 0) + 0.01 * r.normal(size=(12_000, 32))), 20
    yield "few", unit(r.normal(size=(15, 8))), 1


@pytest.mark.parametrize("name", ["noise", "copies", "lengths", "one long", "groups", "few"])
def test_recall_and_whole_results(spark, name):
    from orfloom.llm.ann import nearest

    x, every = next((x, e) for n, x, e in kinds() if n == name)
    vectors, k = frame(spark, x), 20
    got = collections.defaultdict(list)
    for q in nearest(vectors, vectors.where(f"vec_id % {every} = 0"), k).orderBy("query_id", "rank").collect():
        got[q.query_id].append((q.vec_id, q.score))
    want = truth(x, np.arange(len(x)), range(0, len(x), every), k)
    assert set(got) == set(want) and all(len(v) == min(k, len(x) - 1) for v in got.values())
    hit = 0
    for q, (best, s) in want.items():
        assert all(s[i] == v for i, v in got[q]) and q not in {i for i, _ in got[q]}
        assert got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))
        hit += len({i for i, _ in got[q]} & set(best[: len(got[q])].tolist()))
    assert hit / sum(map(len, got.values())) >= 0.9


def test_odd_rows(spark):
    from orfloom.llm.ann import nearest

    r = np.random.default_rng(1)
    x = r.normal(size=(1500, 16)) * r.uniform(0.5, 2, (1500, 1))
    x[500:900] = 5 * x[500]
    rows = [(i, v.tolist(), 1.0, "x") for i, v in enumerate(x)] + [(3, x[3].tolist(), 1.0, "x")] * 3
    rows += [(i, v, 1.0, "x") for i, v in ((4000, None), (4020, [0.0] * 16), (4001, [float("nan")] * 16), (4002, [None] * 16), (4003, [1.0]), (4040, []), (None, [1.0] * 16), (4004, [float("inf")] * 16))]
    got = collections.defaultdict(list)
    for q in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double, query_id string"), k=10).orderBy("query_id", "rank").collect():
        got[q.query_id].append(q.vec_id)
    want = truth(x, np.arange(1500), range(0, 1500, 20), 10)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert got[500] == list(range(501, 511)) and got[520] == list(range(500, 510))
    assert sum(len(set(got[q]) & set(b.tolist())) for q, (b, _) in want.items()) >= 0.9 * 750
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert nearest(empty).count() == 0 and nearest(spark.createDataFrame([(20, [1.0, 2.0])], empty.schema)).count() == 0
    pair = spark.createDataFrame([(20, [1.0, 2.0]), (21, [-1.0, 1e-300])], empty.schema)
    assert [(x.query_id, x.rank, x.vec_id, x.score) for x in nearest(pair).collect()] == [(20, 1, 21, -1.0)]
    with pytest.raises(TypeError):
        nearest(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>"))


def test_lengths_far_apart():
    from orfloom.llm.ann import exponents, strata_of

    x = np.array([[3e-300, 4e-300], [3e300, 4e300], [1.0, 0.0], [0.9999999, 0.0]])
    assert exponents(x).tolist() == [-994, 999, 0, 0]
    assert strata_of({0: 500, 1: 400, -3: 1, -2: 2, 9: 1}).tolist() == [-2, 0, 1, 9]


def test_single_queries(spark):
    """Gaussian rows: 99 of 100 queries find 0.9 of their neighbours, also those that lie close to a centroid (0.3 for a hundredth of them before)."""
    from orfloom.llm.ann import nearest

    x, k = np.random.default_rng(5).normal(size=(20_000, 64)), 20
    got = collections.defaultdict(set)
    for q in nearest(frame(spark, x), k=k).collect():
        got[q.query_id].add(q.vec_id)
    want = truth(x, np.arange(len(x)), range(0, len(x), 20), k)
    share = np.array([len(got[q] & set(best.tolist())) / k for q, (best, _) in want.items()])
    assert np.quantile(share, 0.01) >= 0.9 and share.mean() >= 0.97

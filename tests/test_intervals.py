"""Interval joins: the same pairs as by comparing all, on few rows of bins."""

from orfloom.operators import overlap


def _table(spark, seed, lengths, n=300):
    rows = [(i + seed * 1000, i % 3, (i * 7919 + seed * 104729) % 200_000) for i in range(n)]
    rows = [(i, c, a, a + lengths[i % len(lengths)]) for i, c, a in rows]
    return rows, spark.createDataFrame([*rows, (-seed, 0, 5, None)], "id long, contig long, start long, stop long")


def test_bins_only_at_levels_that_the_other_side_has(spark, monkeypatch):
    left, right = (900, 300, 20_000), (10, 30_000, 700)
    (q, queries), (s, subjects) = _table(spark, 1, left), _table(spark, 2, right)
    seen, real = [], overlap._bins
    monkeypatch.setattr(overlap, "_bins", lambda *a: seen.append(real(*a)) or seen[-1])
    hits = overlap.overlap_join(queries, subjects, ["contig"])
    got = sorted((r["query_id"], r["subject_id"]) for r in hits.select("query_id", "subject_id").collect())
    assert got == sorted((x[0], y[0]) for x in q for y in s if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    # Two levels on either side: at most two bins at each, and each side's rows at most once in each of the two joins.
    assert sum(x.count() for x in seen) <= 4 * (len(q) + len(s))


def test_an_empty_side_and_one_very_long_interval(spark):
    q, queries = _table(spark, 1, (100, 5))
    s, subjects = _table(spark, 2, (1 << 40,), 2)
    hits = overlap.overlap_join(queries, subjects, ["contig"])
    assert hits.count() == sum(x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3] for x in q for y in s) > 0
    assert overlap.overlap_join(queries, subjects.where("false"), ["contig"]).count() == 0
    assert overlap.overlap_join(queries.where("false"), subjects, ["contig"], how="left").count() == 0
    assert overlap.overlap_join(queries, subjects.where("false"), ["contig"], how="left").count() == len(q) + 1

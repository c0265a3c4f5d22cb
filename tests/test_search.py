"""Sequence search and clustering against exhaustive alignment and plain greedy clustering."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from orfloom.operators import search as m


def plain(a, b):
    """Best local score by the whole table, cell by cell."""
    s, low = m.scores(), -(10**9)
    x, y = m._codes(a), m._codes(b)
    h = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    up, left = ([[low] * (len(y) + 1) for _ in range(len(x) + 1)] for _ in range(2))
    best = 0
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            up[i][j] = max(h[i - 1][j] - m.GAP_OPEN, up[i - 1][j] - m.GAP_EXTEND)
            left[i][j] = max(h[i][j - 1] - m.GAP_OPEN, left[i][j - 1] - m.GAP_EXTEND)
            h[i][j] = max(0, h[i - 1][j - 1] + int(s[x[i - 1], y[j - 1]]), up[i][j], left[i][j])
            best = max(best, h[i][j])
    return best


def mutated(r, s, share):
    """A relative of s: residues change as proteins' do, to similar ones more often, and a few come or go."""
    out, likely = [], np.exp(m.decay() * m.scores()[:20, :20] * (1 - np.eye(20)))
    for c in s:
        if r.random() < share:
            out += r.choices(m.RESIDUES, likely[m.RESIDUES.index(c)]) if c in m.RESIDUES else [c]
        elif r.random() < 0.01:
            out.append(c + "".join(r.choices(m.RESIDUES, k=r.randint(1, 6))))
        elif r.random() > 0.01:
            out.append(c)
    return "".join(out)


def protein(r, n):
    return "".join(r.choices(m.RESIDUES, k=n))


def test_scores():
    s = m.scores()
    assert (s == s.T).all() and s.mean() < 0 and abs(np.exp(m.decay() * s[:20, :20]).mean() - 1) < 1e-6
    assert sorted("".join(m.GROUPS)) == sorted(m.RESIDUES)


def test_banded_alignment_is_exact_where_the_band_holds_all():
    r = random.Random(1)
    pairs = []
    for _ in range(60):
        a = protein(r, r.randint(1, 60))
        pairs.append((a, r.choice([protein(r, r.randint(1, 60)), mutated(r, a, 0.3) or "A", a[: r.randint(1, len(a))], "XX" + a + "X", a[:10] + protein(r, 12) + a[10:]])))
    got = m.align_bands([m._codes(a) for a, _ in pairs], [m._codes(b) for _, b in pairs], np.zeros(len(pairs), np.int64), band=80)
    for (a, b), (score, q0, q1, s0, s1, same, columns, opens) in zip(pairs, got):
        assert score == plain(a, b)
        if score:  # what is reported has that score
            own = m.scores()[m._codes(a[q0 : q1 + 1])][:, m._codes(b[s0 : s1 + 1])]
            assert plain(a[q0 : q1 + 1], b[s0 : s1 + 1]) == score and own.size
            gaps = 2 * columns - (q1 - q0 + 1) - (s1 - s0 + 1)
            assert same <= columns - gaps and (opens == 0) == (gaps == 0) and opens <= gaps


def test_narrow_bands_follow_their_diagonal():
    r = random.Random(2)
    a = protein(r, 90)
    for shift in (-40, -3, 0, 5, 70):
        b = protein(r, shift) + a if shift >= 0 else a[-shift:] + protein(r, 20)
        (score, q0, q1, s0, s1, *_), = m.align_bands([m._codes(a)], [m._codes(b)], np.array([shift]), band=4)
        assert score >= plain(a[max(0, -shift) :], a[max(0, -shift) :]) and s0 - q0 == shift
    assert m.align_bands([m._codes("AAA")], [m._codes("CCC")], np.array([500]), band=4).tolist() == [[0] * 8]


def test_search_recall_against_all_alignments(spark):
    """Of all pairs of 40 bits or more, found by aligning every pair, at least 95 % are found, with the same bits."""
    r = random.Random(3)
    families = [protein(r, r.randint(60, 300)) for _ in range(12)]
    rows = [(f"s{f}_{i}", mutated(r, s, share)) for f, s in enumerate(families) for i, share in enumerate((0, 0.1, 0.3, 0.4, 0.5, 0.6))]
    rows += [(f"n{i}", protein(r, r.randint(1, 300))) for i in range(30)] + [("short", "MK"), ("odd", "XXXXBZJ" * 5), ("low", "A" * 80)]
    queries = [(f"q{f}", mutated(r, s, 0.2)) for f, s in enumerate(families)] + [("none", None), ("empty", "")]
    q, s = (spark.createDataFrame(x, "id string, seq string") for x in (queries, rows))
    got = {(x.query_id, x.subject_id): x for x in m.search(q, s, max_e_value=10).collect()}
    total = sum(len(x) for _, x in rows)
    want, log2 = {}, np.log(2)
    for a, x in queries:
        if x:
            best = m.align_bands([m._codes(x)] * len(rows), [m._codes(y) for _, y in rows], np.zeros(len(rows), np.int64), band=700)
            want |= {(a, b): (m.decay() * int(v[0]) - np.log(m.K)) / log2 for (b, _), v in zip(rows, best)}
    strong = {p for p, bits in want.items() if bits >= 40}
    assert len(strong) >= 50 and len(strong & set(got)) >= 0.95 * len(strong)
    exact = sum(abs(got[p].bit_score - want[p]) < 1e-6 for p in strong & set(got))
    assert exact >= 0.95 * len(strong & set(got))
    lengths = dict(queries)
    for (a, b), x in got.items():
        assert x.bit_score <= want[a, b] + 1e-6 and x.e_value <= 10
        assert x.e_value == pytest.approx(len(lengths[a]) * total * 2.0 ** -x.bit_score)
        assert 0 < x.query_coverage <= 1 and 0 < x.subject_coverage <= 1 and 0 < x.fraction_identical_matches <= 1
        assert 0 <= x.n_mismatches <= x.alignment_length
    from orfloom.sources import text_formats as tf

    assert m.search(q, s).schema.fieldNames() == [c.split()[0] for c in tf.MMSEQS.split(", ")]


def test_search_hot_words_and_empty_tables(spark, monkeypatch):
    """A word in every sequence is dealt to parts; the pairs are the same."""
    from orfloom.operators import relational

    r = random.Random(4)
    shared = protein(r, 30)
    df = spark.createDataFrame([(i, protein(r, 50) + shared + protein(r, 20)) for i in range(60)], "id long, seq string")
    few = df.where("id < 3")
    plain_rows = {(x.query_id, x.subject_id, round(x.bit_score, 6)) for x in m.search(few, df).collect()}
    monkeypatch.setattr(relational, "SALTS", 4)
    assert {(x.query_id, x.subject_id, round(x.bit_score, 6)) for x in m.search(few, df).collect()} == plain_rows and len(plain_rows) == 180
    assert m.search(df.where("id < 0"), df).collect() == [] and m.search(df, df.where("id < 0")).collect() == []


def test_alignments_that_cannot_cover_are_given_up():
    """With a coverage, no alignment that covers enough changes, and pairs that share a passage alone have none."""
    r = random.Random(12)
    pairs = []
    for n in range(40):
        a = protein(r, r.randint(150, 900))
        b = mutated(r, a, r.choice([0.02, 0.1, 0.3]))
        cut = r.choice([0, 0, len(a) // 7, len(a) // 5, len(a) // 4, len(a) // 2])
        pairs.append((a, b[cut:] if n % 2 else b[: len(b) - cut], -cut if n % 2 else 0))
    shared = protein(r, 60)
    passages = [(protein(r, 400) + shared + protein(r, 400), protein(r, 400) + shared + protein(r, 400), 0) for _ in range(10)]
    codes = lambda k, rows: [m._codes(x[k]) for x in rows]
    both = lambda rows, **more: m.align_bands(codes(0, rows), codes(1, rows), np.array([d for _, _, d in rows]), **more)
    plain, early = both(pairs + passages), both(pairs + passages, coverage=0.8)
    covers = [min((x[2] - x[1] + 1) / len(q), (x[4] - x[3] + 1) / len(s)) >= 0.8 for x, (q, s, _) in zip(plain, pairs + passages)]
    assert 10 < sum(covers) < 40 and (early[covers] == plain[covers]).all()
    assert all((e == p).all() or not e.any() for e, p in zip(early, plain)) and any(not e.any() for e in early)


def greedy(rows, words, k, identity, coverage):
    """Plain greedy clustering over the same signatures and the same alignments."""
    first = {}
    for i, s in rows:
        if i is not None and s:
            first[s] = min(first.get(s, i), i)
    one = sorted(((i, s) for s, i in first.items()), key=lambda x: (-len(x[1]), x[0]))
    marks = {}
    for i, s in one:
        batch = next(iter(m._signatures(k, words)([m.pa.RecordBatch.from_arrays([m.pa.array([i]), m.pa.array([s])], ["id", "seq"])])))
        marks[i] = dict(zip(batch.column("word").to_pylist(), batch.column("place").to_pylist()))
    owner, text, out = {}, dict(one), {}
    for i, s in one:
        for j in sorted({owner[w] for w in marks[i] if w in owner}, key=lambda j: (-len(text[j]), j)):
            t = text[j]
            shared = {marks[i][w] - marks[j][w] for w in marks[i] if owner.get(w) == j}
            d = m.best_diagonal(m._codes(t), m._codes(s), sorted(shared), m.MIN_UNGAPPED)
            if d is None:
                continue
            score, q0, q1, s0, s1, same, columns, _ = m.align_bands([m._codes(t)], [m._codes(s)], np.array([d]))[0]
            if score and same / columns >= identity and min((q1 - q0 + 1) / len(t), (s1 - s0 + 1) / len(s)) >= coverage:
                out[i] = j
                break
        else:
            out[i] = i
            for w in marks[i]:
                owner.setdefault(w, i)
    return sorted((out[first[s]], i) for i, s in rows if i is not None and s)




@pytest.mark.parametrize("seed,identity", [(5, 0.5), (6, 0.8)])
def test_clusters_against_plain_greedy(spark, tmp_path, seed, identity):
    r = random.Random(seed)
    families = [protein(r, r.randint(60, 200)) for _ in range(8)]
    rows = [(f"f{f}_{i}", mutated(r, s, r.choice([0, 0.02, 0.05, 0.1, 0.3]))[: r.choice([None, None, -10, -60])]) for f, s in enumerate(families) for i in range(8)]
    rows += [(f"n{i}", protein(r, 100)) for i in range(6)] + [("copy", rows[0][1]), ("a", "MK"), ("b", "MK"), ("x", None), ("y", ""), (None, "MKVL"), ("low", "A" * 90)]
    df = spark.createDataFrame(rows, "id string, seq string")
    got = m.cluster_sequences(df, min_identity=identity)
    assert sorted(map(tuple, got.collect())) == greedy(rows, 20, 8, identity, 0.8)
    from orfloom.sources import text_formats as tf

    got.coalesce(1).write.csv(str(tmp_path / "c"), sep="\t")
    back = tf.read_mmseqs_clusters(spark, str(tmp_path / "c"))
    assert back.count() == got.count() and back.agg(F.countDistinct("cluster_id")).first()[0] == got.select("cluster_rep_id").distinct().count()


def test_clusters_of_nothing(spark):
    assert m.cluster_sequences(spark.createDataFrame([], "id long, seq string")).collect() == []
    assert [tuple(x) for x in m.cluster_sequences(spark.createDataFrame([(7, "MK")], "id long, seq string")).collect()] == [(7, 7)]


def test_clusters_move_their_sequences_once(spark):
    """Representatives that wait for each other take many rounds; without broadcasts, no round shuffles the table of sequences again."""
    r = random.Random(7)
    parts = [protein(r, 1600 - 20 * i) for i in range(9)]
    rows = [(i, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:]))] + [(20 + i, protein(r, 3000)) for i in range(100)]
    rows += [(200, rows[3][1]), (201, mutated(r, rows[5][1], 0.02))]
    df = spark.createDataFrame(rows, "id long, seq string")
    # Task metrics reach the store a little after an action ends; the driver is the only executor here.
    moved = lambda: time.sleep(2) or spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for key in keys:
        spark.conf.set(key, "-1")
    try:
        before = moved()
        got = sorted(map(tuple, m.cluster_sequences(df).collect()))
        assert moved() - before < 2 * sum(len(s) for _, s in rows)
    finally:
        for key in keys:
            spark.conf.unset(key)
    assert got == greedy(rows, 20, 8, 0.5, 0.8)


def test_clusters_of_repeated_rows(spark):
    """A row that is there twice is a member twice, of the same cluster."""
    r = random.Random(8)
    a, b = protein(r, 80), protein(r, 70)
    df = spark.createDataFrame([(1, a), (1, a), (2, a), (3, b), (3, b)], "id long, seq string")
    assert sorted(map(tuple, m.cluster_sequences(df).collect())) == [(1, 1), (1, 1), (1, 2), (3, 3), (3, 3)]

"""Gene prediction: the chain against exhaustive choice, planted genes, hostile rows."""

import itertools
import random

import numpy as np

from orfloom.functions import seq
from orfloom.operators import genes as m


def test_chain_against_exhaustive_choice():
    r = random.Random(1)
    for _ in range(200):
        n, overlap = r.randint(0, 9), r.randint(0, 5)
        a = np.array([r.randint(0, 40) for _ in range(n)], np.int64)
        b = a + np.array([r.randint(overlap + 1, 20) for _ in range(n)], np.int64)
        g = np.array([float(r.randint(1, 30)) for _ in range(n)])
        fits = lambda s: all(min(b[i], b[j]) - max(a[i], a[j]) <= overlap for i, j in itertools.combinations(s, 2))  # noqa: E731, B023
        most = max(sum(g[list(s)]) for k in range(n + 1) for s in itertools.combinations(range(n), k) if fits(s))
        got = m.best_chain(a, b, g, overlap)
        assert fits(got) and sum(g[got]) == most


def planted(seed, n_genes, n_contigs=4):
    """Contigs of random bases with genes of biased codons, a purine stretch before each start."""
    r, bias = random.Random(seed), random.Random(7)
    inner = [c for c in seq.CODONS if c not in seq.STOP_CODONS[11]]
    weights = [bias.expovariate(1) ** 2 for _ in inner]
    back = str.maketrans("ACGU", "UGCA")
    contigs, truth = [], []
    for k in range(n_contigs):
        text = ""
        for _ in range(n_genes):
            text += "".join(r.choices("ACGU", k=r.randint(40, 200)))
            gene = r.choices(seq.START_CODONS, [8, 1, 1])[0] + "".join(r.choices(inner, weights, k=r.randint(60, 300))) + r.choice(seq.STOP_CODONS[11])
            lead, strand = "AGGAGGU" + "".join(r.choices("ACGU", k=6)), r.choice((1, -1))
            a = len(text) + (len(lead) if strand == 1 else 0)
            text += lead + gene if strand == 1 else (lead + gene)[::-1].translate(back)
            truth.append((f"c{k}", a + 1, a + len(gene), strand))
        contigs.append((f"c{k}", text + "".join(r.choices("ACGU", k=100))))
    return contigs, truth


def test_planted_genes(spark, monkeypatch):
    monkeypatch.setattr(m, "PACK_BASES", 30_000)
    contigs, truth = planted(3, 40)
    rows = [("g1", c, s) for c, s in contigs] + [("g2", c, s.replace("U", "T").lower()) for c, s in contigs]
    got = m.predict_genes(spark.createDataFrame(rows, "genome_id string, contig_id string, seq string")).collect()
    for g in ("g1", "g2"):
        own = [r for r in got if r.genome_id == g]
        stops = lambda rows: {(c, b if s == 1 else a, s) for c, a, b, s in rows}
        found = [(r.contig_id, r.start, r.stop, r.strand) for r in own]
        right = stops(found) & stops(truth)
        assert len(right) >= 0.97 * len(truth) and len(right) >= 0.95 * len(found)
        assert len(set(found) & set(truth)) >= 0.85 * len(truth)  # starts as well
        text = dict(contigs)
        for r in own:
            s = text[r.contig_id][r.start - 1 : r.stop]
            s = s if r.strand == 1 else s[::-1].translate(str.maketrans("ACGU", "UGCA"))
            assert s[:3] == r.start_codon and s[-3:] in seq.STOP_CODONS[11] and len(s) == 3 * (len(r.seq) + 1) and "*" not in r.seq
    assert sorted(r.gene_id for r in got if r.genome_id == "g1") == sorted(r.gene_id for r in got if r.genome_id == "g2")


def test_scores_against_plain_sums():
    r = np.random.default_rng(5)
    text = "".join(r.choice(list("ACGUN"), 900, p=[0.245, 0.245, 0.245, 0.245, 0.02]))
    c, word = m.Contig(text, 11, 30), r.normal(size=4096)
    before, codon = r.normal(size=(m.UPSTREAM, 4)), r.normal(size=3)
    number = {x: i for i, x in enumerate(a + b + d for a in "ACGU" for b in "ACGU" for d in "ACGU")}
    got = {}
    for i, s in enumerate(c.scores(word, before, codon)):
        got[c.strand[i], c.from_[i]] = s
    want = {}
    for strand, s in ((1, text), (-1, text[::-1].translate(str.maketrans("ACGU", "UGCA")))):
        for a in range(len(s) - 2):
            if s[a : a + 3] not in seq.START_CODONS:
                continue
            own = [s[k : k + 3] for k in range(a, len(s) - 2, 3)]
            end = next((k for k, x in enumerate(own) if x in seq.STOP_CODONS[11]), None)
            if end is None or 3 * (end + 1) < 30:
                continue
            total = sum(word[64 * number[x] + number[y]] for x, y in zip(own[: end - 1], own[1:end]) if x in number and y in number)
            total += sum(before[k, "ACGU".index(s[a - m.UPSTREAM + k])] for k in range(m.UPSTREAM) if a - m.UPSTREAM + k >= 0 and s[a - m.UPSTREAM + k] != "N")
            want[strand, a] = total + codon[sorted(seq.START_CODONS).index(own[0])]
    assert got.keys() == want.keys() and len(want) > 5
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_contigs_together_as_one_by_one(monkeypatch):
    """Contigs that lie in one array have the candidates, scores (to the last digit), chains and counts that each has alone."""
    r = np.random.default_rng(8)
    texts = ["".join(r.choice(list("ACGUN"), n, p=[0.248, 0.248, 0.248, 0.248, 0.008])) for n in (700, 1, 0, 901, 2, 899, 37, 1200, 0)] + ["NNN", planted(9, 3, 1)[0][0][1]]
    word, before, codon = r.normal(size=4096), r.normal(size=(m.UPSTREAM, 4)), r.normal(size=3)
    every, alone = m.Contigs(texts, 11, 30), [m.Contig(t, 11, 30) for t in texts]
    score = every.scores(word, before, codon)
    chosen = every.chain(np.arange(len(score)), score - score.min() + 1, 20)
    lead, total = every.longest(), np.zeros(4 * m.UPSTREAM + 3, np.int64)
    for k, c in enumerate(alone):
        s = c.scores(word, before, codon)
        own = np.flatnonzero(every.of == k)
        rows = lambda d, i, x: sorted((d.strand[j], d.start[j], d.stop[j], x[j], d.protein(j)) for j in i)
        assert rows(every, own, score) == rows(c, range(len(s)), s)
        assert rows(every, lead[every.of[lead] == k], score) == rows(c, c.longest(), s)
        got, want = chosen[every.of[chosen] == k], c.chain(np.arange(len(s)), s - score.min() + 1, 20)
        assert [(every.start[i], every.stop[i], every.strand[i]) for i in got] == [(c.start[i], c.stop[i], c.strand[i]) for i in want]
        total += c.start_features(np.arange(len(s)))
    assert len(score) > 20 and (total == every.start_features(np.arange(len(score)))).all()
    table, key = m.pa.table({"contig_id": [f"c{k}" for k in range(len(texts))], "seq": texts}), (m.pa.scalar("g"),)
    counts = [m._count_words(11, 60, 20)(key, table)]
    monkeypatch.setattr(m, "BATCH_BASES", 1)
    assert m._count_words(11, 60, 20)(key, table).equals(counts[0])


def test_hostile_rows(spark):
    contigs, _ = planted(4, 30, 1)
    rows = [(None, "a", "AUG"), ("g", None, "AUG"), ("g", "a", None), ("g", "b", ""), ("g", "é", "NNNé" * 50), ("h", "x", "AUGAAAUAA"), ("g", *contigs[0]), ("g", *contigs[0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "genome_id string, contig_id string, seq string, pack int, counts int")
    got = m.predict_genes(df).collect()
    assert {(r.genome_id, r.contig_id) for r in got} == {("g", "c0")} and len(got) % 2 == 0 and len(got) == 2 * len({(r.start, r.stop, r.strand) for r in got})
    assert m.predict_genes(df.limit(0)).collect() == []

"""Batches by residues: bound, order, halves, one model a worker, and the store on top of it."""

import os
import random

import pytest
from pyspark.sql import functions as F

from orfloom.functions.seq import RESIDUES
from orfloom.sources import embedder as m
from orfloom.sources.store import EMBEDDERS, EmbeddingStore, register_embedder


def test_batches_keep_the_bound_and_every_row():
    r = random.Random(3)
    for _ in range(100):
        lengths, most = [r.choice([1, 5, 30, 200, 3000]) + r.randint(0, 4) for _ in range(r.randint(0, 60))], r.choice([1, 100, 1000])
        got = list(m.batches(lengths, most))
        assert sorted(i for part in got for i in part) == list(range(len(lengths)))
        assert all(len(part) == 1 or len(part) * max(lengths[i] for i in part) <= most for part in got)
        sizes = [lengths[i] for part in got for i in part]
        assert sizes == sorted(sizes, reverse=True)
        # No two neighbouring batches would have fitted into one.
        assert all((len(a) + 1) * lengths[a[0]] > most for a in got[:-1])


def counts(limit, log):
    """A model that counts letters, holds at most limit residues, and notes its loads and batches."""

    def load():
        with open(os.path.join(log, "loads"), "a") as f:
            f.write(f"{os.getpid()}\n")

        def model(seqs):
            if len(seqs) * max(map(len, seqs)) > limit:
                raise MemoryError
            return [[float(len(s))] + [float(s.count(c)) for c in RESIDUES] for s in seqs]

        return model

    return load


def test_vectors_in_the_rows_order(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, "".join(r.choices(RESIDUES, k=r.choice([1, 7, 50, 90]))) + r.choice(["", "*"])) for i in range(400)] + [(900, None), (901, ""), (902, "**")]
    df = spark.createDataFrame(rows, "id int, seq string").repartition(8)
    embed = m.batched(counts(100, str(tmp_path)), max_residues=1000)  # batches must be halved
    got = {x.id: x.v for x in df.select("id", embed(F.col("seq")).alias("v")).collect()}
    for i, s in rows[:400]:
        assert got[i] == [float(len(s.rstrip("*")))] + [float(s.count(c)) for c in RESIDUES]
    assert got[900] is None and got[901] is None and got[902] is None
    loads = (tmp_path / "loads").read_text().split()
    assert loads and len(loads) == len(set(loads))  # once a worker
    assert df.limit(0).select(embed(F.col("seq")).alias("v")).collect() == []


def test_a_sequence_that_is_too_large_ends_the_job(spark, tmp_path):
    embed = m.batched(counts(10, str(tmp_path)))
    with pytest.raises(Exception, match="MemoryError"):
        spark.createDataFrame([("A" * 11,)], "seq string").select(embed(F.col("seq"))).collect()
    with pytest.raises(ValueError, match="0 vectors for 1"):
        m.embed_part(lambda seqs: [], ["A"], (MemoryError,))


def test_rare_letters_and_the_store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("orfloom.sources.store.EMBEDDERS", dict(EMBEDDERS))
    assert "MUZOBK*".translate(m.RARE) == "MXXXK"
    register_embedder("counts", m.batched(counts(1000, str(tmp_path)), letters=m.RARE))
    store = EmbeddingStore(spark, str(tmp_path / "store"), "counts")
    store.add(spark.createDataFrame([("p", "MKB*", "g"), ("q", "AAA", "g")], "id string, seq string, entry_name string"))
    got = store.get(spark.createDataFrame([("p", "g"), ("q", "g")], "id string, entry_name string")).collect()
    assert {x.id: x.embedding[0] for x in got} == {"p": 2.0, "q": 3.0}

"""The corpus pipeline: planted rows, odd rows, and the whole of it against brute force."""

import collections
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from tests.llm.test_line_dedup import brute
from tests.llm.test_llm import classes

W = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001/documents.parquet"


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(8)
    text = lambda: "\n".join(" ".join(f"{r.choice('abcdefgh')}x{r.randrange(10**5)}" for _ in range(15)) for _ in range(6))
    clean = [(i, text()) for i in range(30)]
    copy = (40, clean[3][1])
    near = (41, clean[4][1].replace(" ", "  ") + " more")
    shared = " ".join(f"s{i}" for i in range(50))
    passage = [(50 + i, f"{text()} {shared} {text()}") for i in range(3)]
    rows = clean + [copy, near, (60, "too short")] + passage
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    step = docs
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == docs.columns
        seen.append({x.doc_id: x.text for x in step.collect()})
    assert set(seen[0]) == {i for i, _ in rows} - {60}
    assert 40 not in seen[1] and 41 not in seen[2] and {i for i, _ in clean} <= set(seen[2])
    assert all(seen[3][i] == t for i, t in clean) and all("s10" not in seen[3][i] for i, _ in passage)
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(seen[3])


def test_pipeline_repeated_rows(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    text = lambda: "\n".join(" ".join(f"{r.choice('abcdefgh')}x{r.randrange(10**5)}" for _ in range(15)) for _ in range(6))
    one, two, three, four, five = (text() for _ in range(5))
    near = lambda t: t.replace(" ", "  ") + " more"
    rows = [(1, one)] * 3 + [(2, two), (3, near(two)), (3, three)] + [(None, four)] * 2 + [(None, near(four)), (None, five)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = collections.Counter([(1, one), (2, two), (3, three), (None, five)])
    got = collections.Counter((x.doc_id, x.text) for x in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert {n for n in got.values()} == {1} and len(got) == 5 and set(want) < set(got)
    assert (set(got) - set(want)) <= {(None, four), (None, near(four))}
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
    assert sorted((x.doc_id or 0 for x in step.collect())) == [0, 0, 1, 2, 3]
    assert collections.Counter(x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect() if x.start == 0) == {1: 1, 2: 1, 3: 1, None: 2}


def repeated_windows(texts, window=35):
    """Words that stay of each text, and whether any went."""
    words = [W.findall(t) for t in texts]
    count = collections.Counter()
    for w in words:
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        yield [x for k, x in enumerate(w) if k not in gone], bool(gone)


def by_hand(rows, kept_ids):
    """The documents that reach packing: (id, text)."""
    rows = [(i, t) for i, t in rows if i in kept_ids]
    rest = []
    for i, t, gone in brute(rows, 1, 16):
        text = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        if not gone or W.search(text):
            rest.append((i, text))
    label = {i: c for i, _, c in classes(rest, 5, 80)}
    rest = [(i, t) for i, t in rest if not W.search(t) or label[i] == i]
    out = []
    for (i, t), (left, cut) in zip(rest, repeated_windows([t for _, t in rest])):
        if not cut:
            out.append((i, t))
        elif left:
            out.append((i, " ".join(left)))
    return out


@pytest.mark.skipif(not os.path.exists(SMALL), reason="test tables are not there")
def test_whole_pipeline_against_brute_force(spark):
    import duckdb
    from tokenizers import Tokenizer

    import corpus_pipeline
    from orfloom.llm.queries import ORACLE_SQL

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}'")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({ORACLE_SQL['op5_quality_rules']}) WHERE kept").fetchall()}
    rows = con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    own = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    own.encode_special_tokens = True
    want = collections.Counter()
    for i, t in by_hand(rows, kept):
        ids = own.encode(t, add_special_tokens=False).ids + [1]
        for a in range(0, len(ids), 2048):
            piece = np.array(ids[a : a + 2048], "<u4")
            want[(i, a, len(piece), zlib.crc32(piece.tobytes()), len(ids))] += 1
    got = corpus_pipeline.run(spark, os.path.dirname(SMALL)).collect()
    assert collections.Counter((x.doc_id, x.start, x.length, x.ids_crc32, x.doc_tokens) for x in got) == want
    fill = collections.defaultdict(int)
    for x in got:
        fill[x.sequence_id] += x.length
    assert max(fill.values()) <= 2048 and len(fill) <= 1.02 * sum(fill.values()) / 2048 + 1


def test_pipeline_nulls_and_empty(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).collect() == []
    r = random.Random(10)
    text = lambda: "\n".join(" ".join(f"{r.choice('abcdefgh')}x{r.randrange(10**5)}" for _ in range(15)) for _ in range(6))
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (None, text(), None, "s", None), (3, text(), None, None, None), (4, " ".join(text() for _ in range(900)), "en", "s", 1)]
    more = spark.createDataFrame([(*x, "kept", 7) for x in rows], f"{SCHEMA}, component_id string, n_words int")
    step = more
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, "")
        assert step.columns == more.columns
    assert {(x.doc_id, x.component_id, x.n_words) for x in step.collect()} == {(None, "kept", 7), (3, "kept", 7), (4, "kept", 7)}

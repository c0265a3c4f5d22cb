"""Line dedup against brute force over runs of all lengths."""

import random
import re

import pytest

WORDY = re.compile(r"[^\x20\x09-\x0D]")
SCHEMA = "doc_id long, text string, lang string, n_removed string, seq int, doc string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", 1, "y") for i, t in rows], SCHEMA)


def brute(rows, min_lines, min_chars):
    """Removed lines by row: every run of every length is held against every earlier place."""
    texts = sorted({(i is None, i or 0, t) for i, t in rows if t is not None}, key=lambda x: (x[0], x[1], x[2]))
    places, gone = {}, {}
    for none, i, t in texts:
        own = t.split("\n")
        at = [k for k, x in enumerate(own) if WORDY.search(x)]
        size = [len(re.sub(r"[\x20\x09-\x0D]", "", own[k])) for k in at]
        gone[(none, i, t)] = set()
        for a in range(len(at)):
            for b in range(a + 1, len(at) + 1):
                if b - a >= min_lines and sum(size[a:b]) >= min_chars:
                    run = tuple(own[k] for k in at[a:b])
                    if run in places:
                        gone[(none, i, t)].update(at[a:b])
                    else:
                        places[run] = True
    return [(i, t, gone[(i is None, i or 0, t)] if t is not None else set()) for i, t in rows]


def corpus(seed):
    r = random.Random(seed)
    lines = ["a", "b", "cc", "d d", "Licensed under X.", "All rights reserved.", "one line that is long enough", "", "  ", "é\t中"]
    runs = [[r.choice(lines) for _ in range(r.choice([2, 3, 5, 9]))] for _ in range(6)]
    rows = []
    for i in range(40):
        own = []
        for _ in range(r.randrange(8)):
            own += r.choice(runs) if r.random() < 0.5 else [r.choice(lines)] if r.random() < 0.7 else [f"own {i} {r.randrange(9)}"]
        rows.append((i, "\n".join(own)))
    return rows + [(90, None), (91, ""), (92, "\n\n"), (93, "q\n" * 400), (None, rows[3][1] + "\nlast"), (3, rows[3][1]), (3, rows[3][1])]


@pytest.mark.parametrize("min_lines,min_chars,seed", [(1, 16, 1), (2, 1, 2), (3, 9, 3), (5, 1, 4)])
def test_against_every_run(spark, min_lines, min_chars, seed):
    from orfloom.llm.line_dedup import drop_repeated_lines

    rows = corpus(seed)
    want = []
    for i, t, gone in brute(rows, min_lines, min_chars):
        own = None if t is None else t.split("\n")
        want.append((i, None if t is None else "\n".join(x for k, x in enumerate(own) if k not in gone), 0 if t is None else len(own), len(gone)))
    out = drop_repeated_lines(frame(spark, rows), min_lines=min_lines, min_chars=min_chars)
    assert out.columns == ["doc_id", "text", "lang", "seq", "doc", "n_lines", "n_removed"]
    got = [(x.doc_id, x.text, x.n_lines, x.n_removed) for x in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_license_lines(spark):
    from orfloom.llm.line_dedup import drop_repeated_lines

    marks = ["Licensed under the Apache License, Version 2.0.", "All rights reserved.", "Licensed under CC BY-NC 4.0.", "Released under the MIT License."]
    rows = [(i, f"text {i} has a line of its own\n{m}\nOk.") for i, m in enumerate(marks * 3)]
    got = {x.doc_id: x.text for x in drop_repeated_lines(frame(spark, rows)).collect()}
    assert all((m in got[i]) == (i < 4) and f"text {i} " in got[i] for i, m in enumerate(marks * 3))


def test_very_long_text_and_empty(spark):
    from orfloom.llm.line_dedup import drop_repeated_lines

    rows = [(1, "\n".join(f"line number {k} of it" for k in range(30_000))), (2, "\n".join(f"line number {k} of it" for k in range(29_000))), (3, "line number 5 of it " * 40_000)]
    got = {x.doc_id: (x.n_lines, x.n_removed) for x in drop_repeated_lines(frame(spark, rows)).collect()}
    assert got == {1: (30_000, 0), 2: (29_000, 29_000), 3: (1, 0)}
    assert drop_repeated_lines(frame(spark, [])).collect() == []
    words = spark.createDataFrame([("b", "a line of some length"), ("a", "a line of some length")], "doc_id string, text string")
    assert {x.doc_id: x.n_removed for x in drop_repeated_lines(words).collect()} == {"a": 0, "b": 1}

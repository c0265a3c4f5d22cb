"""Operators of orfloom.llm against brute force, on small tables with nulls, ties, repeats and clashing names."""

import base64
import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

W = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_removed long, id string, row int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, 5, "x", 1) for i, t in rows], SCHEMA)


def near_copies(seed=1, groups=4, size=25, words=120):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, n = [], 0
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.choice([12, 40, words, 3 * words]))]
        for _ in range(size):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5, 8])):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            rows.append((n, " ".join(own)))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "one"), (n + 4, "ONE"), (None, "one"), (n + 5, "one two"), (3, rows[3][1])]


def classes(rows, k, threshold):
    sets = []
    for _, t in rows:
        w = W.findall((t or "").translate(LOWER))
        sets.append(frozenset(zip(*[w[j:] for j in range(k)])) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset())
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            o = len(sets[x] & sets[y])
            if sets[x] and sets[y] and 100 * o >= threshold * (len(sets[x]) + len(sets[y]) - o):
                group[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return sorted(((i, len(sets[x]), least.get(find(x)) if sets[x] else i) for x, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("seed,k,threshold", [(1, 3, 90), (2, 5, 80), (3, 2, 70)])
def test_ngram_join(spark, seed, k, threshold):
    from orfloom.llm.ngram_join import shingle_classes

    rows = near_copies(seed)
    got = sorted((tuple(r) for r in shingle_classes(frame(spark, rows), shingle=k, threshold=threshold).collect()), key=str)
    assert got == classes(rows, k, threshold)


def test_ngram_join_empty(spark):
    from orfloom.llm.ngram_join import shingle_classes

    assert shingle_classes(frame(spark, [])).collect() == []
    assert [tuple(r) for r in shingle_classes(frame(spark, [(1, None)])).collect()] == [(1, 0, 1)]


@pytest.mark.parametrize("window,group", [(35, 7), (5, 2), (1, 1)])
def test_substring_dedup(spark, window, group):
    from orfloom.llm.substring_dedup import cut_repeats

    r = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"u{r.randrange(10**6)}" for _ in range(r.randrange(80))) + (f"\n{passage} " if i % 3 == 0 else " ") + f"end{i}") for i in range(40)]
    rows += [(90, "a " * 50), (91, None), (92, ""), (93, "x" * 300 + " y"), (None, "b " * 36), (3, rows[3][1])]
    count = collections.Counter()
    words = [W.findall(t or "") for _, t in rows]
    for w in words:
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    want = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    got = [tuple(x) for x in cut_repeats(frame(spark, rows), window=window, group=group).select("doc_id", "n_words", "n_removed", "kept_text").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert cut_repeats(frame(spark, []), window=window, group=group).count() == 0


def test_quality_rules(spark):
    from orfloom.llm.quality_rules import apply_rules, bucket

    r = random.Random(2)
    clean = [(i, "\n".join(" ".join(f"{chr(97 + r.randrange(26))}ord{r.randrange(9999)}" for _ in range(12)) for _ in range(8))) for i in range(60)]
    junk = [(100, clean[0][1].replace(" ", "*** ")), (101, None), (102, "a b c " * 40), (103, "few words"), (104, clean[1][1].upper())]
    got = {x.doc_id: x for x in apply_rules(frame(spark, clean + junk)).collect()}
    assert all(got[i].kept for i, _ in clean) and not any(got[i].kept for i, _ in junk)
    assert got[102].n_repeat_words == 120 and got[102].base_failed and got[101].n_words == 0
    assert apply_rules(frame(spark, [])).count() == 0
    values = [0, 5, 31, 32, 33, 34, 1000, 123456789]
    b = [x[0] for x in spark.createDataFrame([(v,) for v in values], "v long").select(bucket(F.col("v"))).collect()]
    assert all(x <= v < x * (1 + 1 / 16) + 1 for v, x in zip(values, b))


def test_packing(spark):
    from tokenizers import Tokenizer

    from orfloom.llm.packing import cutting_stock, pack_documents

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["It's", "Été,", "abc...", "x1y2", "the", "ÉÀ!", "ß%%", "“q”,", "…,", "naïve."]) for _ in range(r.randrange(900)))) for i in range(60)]
    rows += [(70, None), (70, None), (None, "n"), (71, "z" * 3000), (72, "<|endoftext|> İ ΑΣ")]
    got = pack_documents(frame(spark, rows), path, capacity=256).collect()
    want = collections.Counter()
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        for a in range(0, len(ids), 256):
            want[(i, a, len(ids[a : a + 256]), zlib.crc32(np.array(ids[a : a + 256], "<u4").tobytes()), len(ids))] += 1
    assert collections.Counter((x.doc_id, x.start, x.length, x.ids_crc32, x.doc_tokens) for x in got) == want
    sequences = collections.defaultdict(list)
    for x in got:
        sequences[x.sequence_id].append((x.offset, x.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256
    assert pack_documents(frame(spark, []), path).count() == 0
    size, demand = np.array([3, 5, 7, 16]), np.array([40, 25, 31, 2])
    made = sum(a * n for a, n in cutting_stock(size, demand, 16))
    assert (made == demand).all() and all((a * size).sum() <= 16 for a, _ in cutting_stock(size, demand, 16))


def test_chat_round_trip(spark):
    from orfloom.llm.chat_format import format_conversations, read_back

    r = random.Random(3)
    rows = [(r.choice([1, 2, None]), r.choice([None, *range(600)]), r.choice(["user", "assistant", "system", None, "a>\n<b\\"]), r.choice([None, "", "</turn>\n<turn x>\n", "\\l\\", "x" * r.randint(1, 3000), "ok"]), 7, "y") for _ in range(900)]
    rows += [(5, 3, "system", "alone", 7, "y"), (6, 0, "assistant", "w" * 400_000, 7, "y")] + [(8, 4, "user", "same", 7, "y")] * 700
    schema = "conv_id long, turn long, role string, text string, window int, n_new string"
    want = {}
    for c in {x[0] for x in rows}:
        turns, loss = hashlib.sha256(), ""
        own = sorted((t is not None, t or 0, role or "", text or "") for k, t, role, text, _, _ in rows if k == c)
        for _, _, role, text in own:
            turns.update(f"{role}\n{text}\n".encode())
            loss += text if role == "assistant" else ""
        want[c] = (len(own), turns.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for blocks in (1024, 50):
        w = format_conversations(spark.createDataFrame(rows, schema), budget=300, history=80, block_turns=blocks)
        assert {x[0]: tuple(x[1:5]) for x in read_back(w).collect()} == want
    assert read_back(format_conversations(spark.createDataFrame([], schema))).count() == 0


@pytest.mark.parametrize("n,block_turns", [(8, 1024), (100, 16), (100, 7)])
def test_chat_windows_do_not_depend_on_turn_numbers(spark, n, block_turns):
    """Turns numbered by place, by 5,000, as times with gaps of their own, and below zero give the same windows."""
    from orfloom.llm.chat_format import format_conversations

    r = random.Random(n)
    texts = [("system" if k == 0 else ("user", "assistant")[k % 2], " ".join(f"w{r.randrange(50)}" for _ in range(r.choice([1, 5, 40])))) for k in range(n)]
    gaps = [r.choice([1, 2, 1000, 10**9]) for _ in range(n)]
    numbers = {"place": range(n), "by 5000": range(0, 5000 * n, 5000), "times": [sum(gaps[: k + 1]) for k in range(n)], "below": range(-3 * n, 0, 3)}
    rows = [(name, t, *texts[k]) for name, own in numbers.items() for k, t in enumerate(own)]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = collections.defaultdict(list)
    for x in format_conversations(df, budget=300, history=80, block_turns=block_turns).orderBy("conv_id", "window").collect():
        got[x.conv_id].append((x.n_new, x.n_tokens, x.text))
    assert len(got) == 4 and all(own == got["place"] for own in got.values()) and sum(x[0] for x in got["place"]) == n
    if n == 8:
        assert len(got["place"]) < 8


@pytest.mark.parametrize("block_turns", [1024, 40])
def test_chat_windows(spark, block_turns):
    from orfloom.llm.chat_format import TURN_TOKENS, format_conversations, parse_window

    r = random.Random(4)
    turns = [(0, "system", "be brief")] + [(k, ("user", "assistant")[k % 2], " ".join(f"w{k}" for _ in range(r.randrange(60)))) for k in range(1, 400)]
    df = spark.createDataFrame([(1, *t) for t in turns] + [(2, *t) for t in turns[1:]], "conv_id long, turn long, role string, text string")
    for path in (None, P.path("word_bpe_49k.json")):
        if path is None:
            size = lambda t: -(-len(t) // 4) + TURN_TOKENS
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            size = lambda t: len(own.encode(t, add_special_tokens=False).ids) + TURN_TOKENS  # noqa: B023, E731
        got = format_conversations(df, budget=400, history=100, tokenizer=path, block_turns=block_turns).orderBy("conv_id", "window").collect()
        for conv, every in ((1, turns), (2, turns[1:])):
            windows, at, filled = [x for x in got if x.conv_id == conv], 0, []
            for x in windows:
                own_turns = parse_window(x.text)
                lead = conv == 1 and at > 0
                assert not lead or own_turns[0] == ("system", "be brief")
                body = own_turns[1:] if conv == 1 else own_turns
                new = x.n_new - (conv == 1 and at == 0)
                span, past = body[len(body) - new :], body[: len(body) - new]
                start = at + (conv == 1 and at == 0)
                assert span == [t[1:] for t in every[start : start + new]] and past == [t[1:] for t in every[start - len(past) : start]]
                assert sum(size(t) for _, t in past) <= 100 and sum(size(t) for _, t in body) <= 400
                assert x.n_tokens == sum(size(t) for _, t in own_turns)
                assert [x.text[m.start : m.end] for m in x["mask"]] == [t for role, t in span if role == "assistant"]
                filled.append(sum(size(t) for _, t in body))
                at = start + new
            assert at == len(every) and (block_turns < 400 or min(filled[:-1]) > 400 - 60 * 4)


def test_html_text(spark):
    from orfloom.llm.html_text import extract_main_text, main_text

    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><header>Top</header><nav><ul><li><a>Menu</a></ul></nav><div class='cookie-notice'>We use</div>"
        "<article><h1>A &amp; B</h1><p>one<br>two <b>three<p>four&nbsp;five</p><aside>side</aside><!-- <p>no</p> --><script>var x='<p>';</script><div class=ad>Buy<p>now</div>"
        "<p>1 < 2</p><section id=comments><p>me too</section></article><footer>&copy;</footer></body></html>"
    )
    assert main_text(page) == "A & B\none two three\nfour five\n1 < 2"
    assert main_text("<div><p>a</p><div class='sidebar'>b</div>c</div>") == "a\nc"
    df = spark.createDataFrame([(1, None, page), (2, "u", None), (2, "u", "")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.url, r.n_chars) for r in extract_main_text(df).collect() if r.url) == [(2, "u", 0), (2, "u", 0)]


def test_byte_bpe(spark):
    tiktoken = pytest.importorskip("tiktoken")
    from orfloom.llm.byte_bpe import decode_ids, encode_documents

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(6)
    rows = [(i, "".join(r.choice("abthe ingon.,!?0é中\n\t😀'") for _ in range(r.randrange(300)))) for i in range(200)] + [(300, None), (301, ""), (None, "aaaa" * 500), (302, "<|endoftext|>"), (302, "<|endoftext|>")]
    got = decode_ids(encode_documents(frame(spark, rows), path, P.PATTERN), path).collect()
    want = sorted(((i, e.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=str)
    assert sorted(((x.doc_id, np.frombuffer(x.ids, "<u4").tolist(), bytes(x.decoded)) for x in got), key=str) == want


def test_classifier(spark):
    from orfloom.llm.quality_classifier import fit_grades, score_documents

    r = random.Random(7)
    mark = {0: ["vile"], 1: ["meh"], 2: ["fine"]}
    rows = [(i, " ".join([f"w{r.randrange(300)}" for _ in range(40)] + mark[i % 3] * 3)) for i in range(900)]
    labels = spark.createDataFrame([(i, i % 3) for i, _ in rows[:600]] + [(None, 1), (5000, None)], "doc_id long, grade int")
    model = fit_grades(frame(spark, rows), labels, F.col("grade"))
    got = {x.doc_id: x for x in score_documents(frame(spark, [*rows, (None, None)]), model).collect()}
    held = [i for i, _ in rows[600:]]
    assert np.mean([(got[i].p_top >= 0.5) == (i % 3 == 2) for i in held]) > 0.9
    assert np.mean([got[i].expected_grade for i in held if i % 3 == 0]) < np.mean([got[i].expected_grade for i in held if i % 3 == 1])
    assert score_documents(frame(spark, []), model).count() == 0
    # One id with several grades and texts, a bound on the labels, no labels at all, integer and text ids.
    twice = labels.unionByName(labels.withColumn("grade", F.lit(2)))
    assert np.array_equal(fit_grades(frame(spark, rows + rows), twice, F.col("grade")).weights, model.weights)
    few = fit_grades(frame(spark, rows), labels, F.col("grade"), max_labels=10)
    assert 0 < np.count_nonzero(few.weights) < np.count_nonzero(model.weights)
    none = fit_grades(frame(spark, rows), labels.where("grade > 9"), F.col("grade"))
    assert len({x.p_top for x in score_documents(frame(spark, rows[:5]), none).collect()}) == 1


def test_classifier_loss_and_scores():
    from orfloom.llm.quality_classifier import OrdinalModel, _loss, feature_slots

    r = np.random.default_rng(1)
    grade = r.integers(0, 3, 40)
    d, s = feature_slots([" ".join(f"w{k}" for k in r.integers(0, 30, 12)).encode() for _ in grade])
    used, s_ = np.unique(s, return_inverse=True)
    value, p = r.uniform(size=len(used)), np.concatenate([r.normal(size=len(used)), [-0.4, 0.2]])
    f = lambda q: _loss(q, d, s_, value, grade, 2, 3.0)
    _, slope = f(p)
    for i in [0, 5, len(used) - 1, len(used), len(used) + 1]:
        e = np.zeros(len(p))
        e[i] = 1e-6
        assert abs((f(p + e)[0] - f(p - e)[0]) / 2e-6 - slope[i]) < 1e-6
    # Each text scored by itself is the sum over its distinct features.
    model = OrdinalModel.fit(d, s, grade)
    assert (np.diff(model.thresholds) > 0).all()
    texts = [b"", b"w1 W1 w2", b"x" * 300_000, "\u00e9\u4e2d w3.".encode()]
    together = feature_slots(texts)
    for i, t in enumerate(texts):
        alone = feature_slots([t])[1]
        assert sorted(alone.tolist()) == sorted(set(together[1][together[0] == i].tolist()))


def held_out(folder, heavy=False):
    """Share kept of toxic, low and good texts in the half of the labels that the fit does not see."""
    import pyarrow.parquet as pq

    from orfloom.llm.quality_classifier import OrdinalModel, feature_slots

    texts = dict(zip(*(pq.read_table(f"{folder}/documents.parquet").column(c).to_pylist() for c in ("doc_id", "text"))))
    rows = pq.read_table(f"{folder}/labels.parquet").to_pylist()
    rated = sorted({(x["doc_id"], 0 if x["toxic"] else 1 if not x["quality"] else 2) for x in rows if texts.get(x["doc_id"])}, key=lambda x: hashlib.md5(str(x).encode()).hexdigest())
    train, test = rated[::2], rated[1::2]
    if heavy:
        toxic = [x for x in train if x[1] == 0]
        train = toxic + [x for x in train if x[1]][: 2 * len(toxic)]
    own = lambda some: feature_slots([(texts[i] or "").encode() for i, _ in some])
    d, s = own(train)
    model = OrdinalModel.fit(d, s, np.array([g for _, g in train]))
    d, s = own(test)
    kept = model.above(np.bincount(d, weights=model.weights[s], minlength=len(test)))[:, -1] >= 0.5
    return [float(np.mean([k for k, (_, g) in zip(kept, test) if g == j])) for j in range(3)]


@pytest.mark.parametrize("size,heavy", [("sf0.01", False), ("sf0.1", False), ("sf0.1", True)])
def test_classifier_held_out(size, heavy):
    folder = f"/root/testdata/{size}"
    if not os.path.exists(f"{folder}/labels.parquet"):
        pytest.skip("test tables are not there")
    toxic, low, good = held_out(folder, heavy)
    assert good >= 0.9 and toxic <= (0.4 if size == "sf0.01" else 0.1) and low < 0.75


def test_quality_rules_odd_rows(spark):
    from orfloom.llm.quality_rules import apply_rules

    r = random.Random(4)
    text = lambda: " ".join(f"{chr(97 + r.randrange(26))}ord{r.randrange(99999)}" for _ in range(90))
    rows = [(i, text(), "en" if i % 2 else None, "s") for i in range(40)] + [(7, "same row twice " * 2 + text(), None, None)] * 2 + [(90, text() + " " + " ".join(text() for _ in range(2500)), "en", None)]
    df = spark.createDataFrame([(i, t, a, b, True, 3) for i, t, a, b in rows], "doc_id long, text string, lang string, source string, kept boolean, n_words int")
    out = apply_rules(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = out.collect()
    assert sorted(((x.doc_id, x.text, x.lang, x.source) for x in got), key=str) == sorted(rows, key=str)
    assert all(x.kept and x.n_words == len(W.findall(x.text)) for x in got)
    assert apply_rules(df, columns=["doc_id"]).columns == ["doc_id", *out.columns[4:]]

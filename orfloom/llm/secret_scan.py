"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans.

Tokens are runs of ASCII letters and digits and of bytes beyond ASCII; what lies
between two of them is their *gap*.  A token is O (outside), B (begins a secret)
or I (goes on with it; never behind O).  Its features are its shape (length
with kinds of characters, shares of digits and vowels, changes between kinds),
the gaps at both sides, the words before and behind it (hashed), and the shares
of assignments, of words with digits and of long mixed words in its text.

The model is fitted here by conditional likelihood on at most SAMPLE_WINDOWS
windows of WINDOW words from about SAMPLE_DOCS texts chosen by hash, labelled by
the patterns; half of them get a made-up secret or a harmless look-alike
(``_plant``), so that it learns secrets that the patterns do not know.  A part
of the windows is held out, and B is made dearer until at most MAX_FALSE of the
held-out windows without a planted secret get a span of the model's own.

Decoding is exact: tokens that no best path can leave O at (a bound from the
transitions and the next token) cut a text into short islands, and Viterbi runs
over all islands of a chunk at once.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orfloom.llm import scratch
from orfloom.llm.textops import Words, chunks, lean, split_words

#: Texts and windows that the fit uses at most (the texts by expectation), and words of a window.
SAMPLE_DOCS, SAMPLE_WINDOWS, WINDOW = 20_000, 4_000, 40
#: Tokens of a window, passes of the fit, ridge penalty, share of held-out windows.
MAX_TOKENS, PASSES, RIDGE, HELD_OUT = 80, 50, 0.02, 0.25
#: Windows that a fit has at least.
LEAST_WINDOWS = 800
#: Share of clean held-out windows that may get a span.
MAX_FALSE = 0.001
#: Longer islands are decoded one token after the other.
LONG_ISLAND = 512
#: Kinds of spans, in their order at one start.
KINDS = ("assign", "access", "hex", "crf")

# The patterns and their least lengths.
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")
_LEAST_ASSIGN, _LEAST_ACCESS = 12, 18

_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x30:0x3A], _CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x80:] = 1, 2, 3, 4
_GAP = np.zeros(256, np.uint8)
_GAP[[0x20, 0x09]], _GAP[[*range(0x0A, 0x0E)]], _GAP[ord("=")], _GAP[ord(":")] = 1, 2, 4, 8
_GAP[[*b"\"'`"]], _GAP[[*b"+/_-.~$%!@#&*^"]] = 16, 32
_HASH = 4096
_LENGTH = np.searchsorted([4, 6, 8, 10, 13, 17, 21, 33, 49], np.arange(65), side="right")
_SIZES = [160, 60, 60, 60, 50, 64, 64, _HASH, _HASH, _HASH, _HASH, 40, 40, 40]
_OFFSET = np.concatenate([[0], np.cumsum(_SIZES)])
_NEVER = -1e4


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the patterns' matches, by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _LEAST_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _gaps(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Kinds of bytes before each token, as bits: of the first and last four bytes of the gap, and of what lies before token 0."""
    begin, stop = np.append(0, end[:-1]), start
    out = np.zeros(len(start), np.uint8)
    for k in range(4):
        at = np.flatnonzero(stop - begin > k)
        out[at] |= _GAP[raw[begin[at] + k]] | _GAP[raw[stop[at] - 1 - k]]
    return out


def features(texts: list[bytes]) -> tuple[Words, np.ndarray]:
    """Tokens of the texts, and the feature numbers of each (one column per template)."""
    w = split_words(texts, lower=True, space=_BETWEEN)
    n = len(w.hash)
    if not n:
        return w, np.zeros((0, len(_SIZES)), np.int32)
    raw = np.frombuffer(b" ".join(texts) + b" " * 16, np.uint8)
    kind = _CLASS[raw]
    total = lambda x: np.concatenate([np.zeros(1, np.int32), np.cumsum(x, dtype=np.int32)])
    inside = lambda x: (t := total(x))[w.end] - t[w.start]
    digits, lower, upper, wide = (inside(kind == k) for k in (1, 2, 3, 4))
    hexes = inside(np.isin(np.arange(256), [*b"abcdef"])[raw])
    HEXES = inside(np.isin(np.arange(256), [*b"ABCDEF"])[raw])
    vowels = inside(np.isin(np.arange(256), [*b"aeiouyAEIOUY"])[raw])
    changed = total(np.append(False, kind[1:] != kind[:-1]))
    changes = changed[w.end] - changed[w.start + 1]
    size = (w.end - w.start).astype(np.int64)
    length = _LENGTH[np.minimum(size, 64)]
    mask = (digits > 0) + 2 * (lower > 0) + 4 * (upper > 0) + 8 * (wide > 0)
    letters = lower + upper
    form = np.select(
        [digits == size, digits + hexes == size, digits + HEXES == size, (vowels == 0) & (letters > 3), (upper == size) & (digits == 0)], [1, 2, 3, 4, 5], 0
    )
    before = _gaps(raw, w.start, w.end)
    after = np.append(before[1:], np.uint8(2))
    first = np.zeros(n, bool)
    first[w.bound[:-1][w.bound[:-1] < n]] = True
    last = np.append(first[1:], True)
    before, after = np.where(first, 2, before).astype(np.int64), np.where(last, 2, after).astype(np.int64)
    slot = (w.hash >> np.uint64(52)).astype(np.int64)
    prev = np.where(first, 0, np.append(0, slot[:-1]))
    prev2 = np.where(first, 0, np.append(0, prev[:-1]))
    following = np.where(last, 0, np.append(slot[1:], 0))
    with_gap = (prev * 64 + before) * 0x9E3779B1 >> 12 & (_HASH - 1)
    text = np.repeat(np.arange(len(texts)), np.diff(w.bound))
    candidate = (size >= 8) & (digits > 0) & (letters > 0)
    share = lambda x: np.bincount(text, weights=x, minlength=len(texts)) / np.maximum(1, np.diff(w.bound))
    level = lambda x, steps: np.searchsorted(steps, share(x), side="right")[text]
    own = candidate * 1 + (mask == 7) * 2 + (mask == 6) * 4
    file = [level((after & 12) > 0, (0.001, 0.01, 0.05, 0.2)), level(digits > 0, (0.001, 0.01, 0.05, 0.2)), level(candidate, (0.0001, 0.002, 0.02, 0.1))]
    columns = [
        length * 16 + mask, length * 6 + 5 * digits // size, length * 6 + np.minimum(changes, 5), length * 6 + form, length * 5 + np.minimum(8 * vowels // np.maximum(1, letters), 4),
        before, after, prev, prev2, following, with_gap, *[f * 8 + own for f in file],
    ]
    return w, np.stack([np.asarray(c, np.int32) + np.int32(o) for c, o in zip(columns, _OFFSET)], 1)


@dataclass
class Model:
    """Weights of B and I (O has 0), transitions [from, to] of O, B, I, and what a B costs more."""

    begin: np.ndarray
    inside: np.ndarray
    trans: np.ndarray
    cost: float

    def scores(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b, i = np.full(len(f), -self.cost), np.zeros(len(f))
        for k in range(f.shape[1]):
            b += self.begin[f[:, k]]
            i += self.inside[f[:, k]]
        return b, i


def _decode_one(b: np.ndarray, i: np.ndarray, t: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """Viterbi over one island behind O; leave has what each label costs at its end."""
    t = t.tolist()
    score, back = [0.0, _NEVER, _NEVER], []
    for eb, ei in zip(b.tolist(), i.tolist()):
        new, own = [], []
        for to, e in enumerate((0.0, eb, ei)):
            best = max(range(3), key=lambda k: score[k] + t[k][to])
            own.append(best)
            new.append(score[best] + t[best][to] + e)
        score = new
        back.append(own)
    state = max(range(3), key=lambda k: score[k] + leave[k])
    out = []
    for own in reversed(back):
        out.append(state)
        state = own[state]
    return np.array(out[::-1], np.int8)


def decode(b: np.ndarray, i: np.ndarray, first: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Best labels (0, 1, 2 for O, B, I) of chains; first marks the first token of each."""
    n = len(b)
    out = np.zeros(n, np.int8)
    if not n:
        return out
    # What a path gains at least when a token becomes O (and an I behind it B).
    live = lambda x: x > _NEVER / 2
    turn = min(0.0, (t[1] - t[2]).min())
    least = []
    for label in (1, 2):
        gains = [t[p, 0] - t[p, label] + t[0, 1 if q == 2 else q] - t[label, q] + (turn if q == 2 else 0) for p in range(3) for q in range(3) if live(t[p, label]) and live(t[label, q])]
        gains += [t[p, 0] - t[p, label] for p in range(3) if live(t[p, label])]
        least.append(min(gains))
    last = np.append(first[1:], True)
    swap = np.where(last, 0, np.maximum(0, np.append(i[1:] - b[1:], 0)))
    maybe = ~((least[0] - b - swap > 1e-9) & (least[1] - i - swap > 1e-9))
    at = np.flatnonzero(maybe)
    if not len(at):
        return out
    begin = np.flatnonzero(np.append(True, (np.diff(at) > 1) | first[at[1:]]))
    size = np.diff(np.append(begin, len(at)))
    start = at[begin]
    leave = lambda end: np.where(last[end][..., None], 0.0, t[:, 0])  # noqa: E731 - a chain's end costs nothing, else O follows
    for a, m in zip(start[size > LONG_ISLAND], size[size > LONG_ISLAND]):
        out[a : a + m] = _decode_one(b[a : a + m], i[a : a + m], t, leave(a + m - 1))
    start, size = start[size <= LONG_ISLAND], size[size <= LONG_ISLAND]
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    score = np.tile([0.0, _NEVER, _NEVER], (len(start), 1))
    back = []
    for k in range(size[0] if len(size) else 0):
        m = np.searchsorted(-size, -k, side="left")  # islands that go on
        way = score[:m, :, None] + t[None]
        own = way.argmax(1)
        back.append(own.astype(np.int8))
        e = np.stack([np.zeros(m), b[start[:m] + k], i[start[:m] + k]], 1)
        score[:m] = np.take_along_axis(way, own[:, None], 1)[:, 0] + e
    state = (score + leave(start + size - 1)).argmax(1).astype(np.int8)
    for k in range(len(back) - 1, -1, -1):
        m = len(back[k])
        out[start[:m] + k] = state[:m]
        state[:m] = back[k][np.arange(m), state[:m]]
    return out


def _pick(r: random.Random, kinds: str, low: int, high: int) -> str:
    return "".join(r.choices(kinds, k=r.randint(low, high)))


_MIXED = string.ascii_letters + string.digits
#: Words that stand before planted secrets.
_NAMES = (
    "key", "auth", "credential", "client_secret", "access_key", "private_key", "passphrase", "pwd", "pass", "webhook", "signature", "session",
    "cookie", "login", "password", "token", "secret", "api_key", "apiKey", "authorization", "Passwort", "clave", "mot de passe", "contraseña",
)


def _secret(r: random.Random) -> tuple[str, str, str]:
    """(text before, made-up secret, text behind)."""
    make = [
        lambda: _pick(r, _MIXED, 16, 44), lambda: _pick(r, _MIXED + "+/", 20, 60) + r.choice(["", "=", "=="]), lambda: _pick(r, "0123456789ABCDEF", 16, 40),
        lambda: _pick(r, "0123456789abcdef", 16, 64), lambda: r.choice(["ghp_", "sk_live_", "glpat-", "AIza", "npm_", "hf_", "xoxb-"]) + _pick(r, _MIXED, 20, 40),
        lambda: ".".join(["eyJ" + _pick(r, _MIXED, 16, 30), _pick(r, _MIXED, 24, 60), _pick(r, _MIXED, 20, 43)]), lambda: "AKIA" + _pick(r, string.ascii_uppercase + string.digits, 14, 16),
    ]
    name, quote = r.choice(_NAMES), r.choice(["", "", '"', "'"])
    if r.random() < 0.2:
        return f"{name}{r.choice([' = ', ': ', '='])}{quote}", _pick(r, _MIXED, 5, 8) + r.choice("!#_-$") + _pick(r, _MIXED, 4, 8), quote
    before = r.choice([f"{name} = {quote}", f"{name}: {quote}", f"{name}={quote}", f"{name} {quote}", quote, quote, f"Bearer {quote}", f"'{name}': {quote}"])
    return before, r.choice(make)(), quote


def _harmless(r: random.Random) -> str:
    """What looks a little like a secret and is none."""
    d = lambda n: _pick(r, string.digits, n, n)
    word = lambda: _pick(r, "aeinorst", 3, 8)
    return r.choice([
        lambda: f"{d(4)}-{d(2)}-{d(2)}T{d(2)}:{d(2)}:{d(2)}", lambda: f"https://www.{word()}.com/{word()}/{word()}-{d(4)}.html", lambda: f"{word()}.{word()}@{word()}.org",
        lambda: ".".join(d(r.randint(1, 3)) for _ in range(4)), lambda: f"v{d(1)}.{d(2)}.{d(1)}", lambda: word() + word().title() + word().title(), lambda: f"+{d(2)} {d(3)} {d(7)}",
        lambda: f"{word()}_{word()}_{word()} = {d(3)}", lambda: f"/usr/{word()}/{word()}{d(1)}.{d(1)}", lambda: f"{d(1)},{d(3)},{d(3)}", lambda: f"ISBN {d(3)}-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
        lambda: f"{word()}: {word()}", lambda: f"token {word()}", lambda: f"secret: {word()}", lambda: f"password = {word()}", lambda: f"{word()}{d(2)}", lambda: word().upper() + d(3),
        lambda: f"<{word()} class=\"{word()}-{word()}\">", lambda: word().title() + "".join(word() for _ in range(4)), lambda: word().upper() + word().upper() + word().upper(),
    ])()


def _plant(r: random.Random, window: str) -> tuple[bytes, list[tuple[int, int]], bool]:
    """(window, spans of secrets in bytes, whether one was planted)."""
    spans = lambda t: [(a, e) for a, _, e in base_spans(t)]
    turn = r.random()
    if turn < 0.5:
        text = window.encode()
        return text, spans(text), False
    words = window.split(" ")
    at = r.randint(0, len(words))
    head, tail = " ".join(words[:at]), " ".join(words[at:])
    if turn < 0.7:
        text = f"{head} {_harmless(r)} {tail}".encode()
        return text, spans(text), False
    before, own, behind = _secret(r)
    first = len(f"{head} {before}".encode())
    text = f"{head} {before}{own}{behind}{r.choice(['', '', ',', '.', ';'])} {tail}".encode()
    return text, [*spans(text), (first, first + len(own))], True


def _labels(w: Words, spans: list[list[tuple[int, int]]], begins: np.ndarray) -> np.ndarray:
    """Labels of the tokens; a token of a named assignment that is not its value is O."""
    out = np.zeros(len(w.hash), np.int8)
    for d, own in enumerate(spans):
        for a, e in own:
            inside = np.flatnonzero((w.start[w.bound[d] : w.bound[d + 1]] >= a + begins[d]) & (w.end[w.bound[d] : w.bound[d + 1]] <= e + begins[d])) + w.bound[d]
            if len(inside):
                out[inside] = np.where(out[inside] > 0, out[inside], 2)
                out[inside[0]] = 1
    return out


def _value_spans(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans, with assignments cut to their values."""
    out = []
    for a, e in spans:
        m = _ASSIGN.match(text, a)
        out.append((m.start(2), e) if m and m.end() == e else (a, e))
    return out


def _likelihood(y: np.ndarray, size: np.ndarray, b: np.ndarray, i: np.ndarray, t: np.ndarray):
    """Minus the mean log likelihood of padded chains, with its gradients by scores of B, of I and by transitions."""
    m, n = y.shape
    e = np.zeros((m, n, 3))
    e[:, :, 1], e[:, :, 2] = b, i
    start = np.array([0.0, t[0, 1], _NEVER])
    add = lambda v, axis: (top := v.max(axis)) + np.log(np.exp(v - np.expand_dims(top, axis)).sum(axis))
    alpha, beta = np.empty((m, n, 3)), np.zeros((m, n, 3))
    alpha[:, 0] = start + e[:, 0]
    for k in range(1, n):
        step = add(alpha[:, k - 1, :, None] + t[None], 1) + e[:, k]
        alpha[:, k] = np.where((k < size)[:, None], step, alpha[:, k - 1])
    for k in range(n - 2, -1, -1):
        step = add(t[None] + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
        beta[:, k] = np.where((k + 1 < size)[:, None], step, 0.0)
    z = add(alpha[:, -1], 1)
    real = np.arange(n)[None] < size[:, None]
    node = np.exp(alpha + beta - z[:, None, None]) * real[:, :, None]
    edge = alpha[:, :-1, :, None] + t[None, None] + (e + beta)[:, 1:, None, :] - z[:, None, None, None]
    pairs = (np.exp(edge) * real[:, 1:, None, None]).sum((0, 1))
    pairs[0] += node[:, 0].sum(0)  # a chain begins behind O
    gold = np.take_along_axis(e, y[:, :, None].astype(np.int64), 2)[:, :, 0]
    seen = np.zeros((3, 3))
    before = np.concatenate([np.zeros((m, 1), np.int8), y[:, :-1]], 1)
    np.add.at(seen, (before[real], y[real]), 1)
    loss = z.sum() - (gold * real).sum() - (seen * np.where(t < _NEVER / 2, 0, t)).sum()
    observed = np.stack([(y == 1) & real, (y == 2) & real], 2)
    return loss / m, (node[:, :, 1:] - observed) / m, (pairs - seen) / m


def _fit(f: np.ndarray, y: np.ndarray, bound: np.ndarray) -> Model:
    """Weights by full-batch Adam steps."""
    size = np.minimum(np.diff(bound), MAX_TOKENS)
    keep = np.flatnonzero(size > 0)
    size, begin = size[keep], bound[:-1][keep]
    at = np.minimum(begin[:, None] + np.arange(size.max(initial=1)), len(f) - 1)
    real = np.arange(at.shape[1])[None] < size[:, None]
    x, labels = f[at[real]], np.where(real, y[at], 0).astype(np.int8)
    n = _OFFSET[-1]
    theta = np.concatenate([np.zeros(2 * n), [0, -1, 0, 0, -1, 0, 0, -1, 0.0]])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    free = np.ones((3, 3))
    free[0, 0] = free[0, 2] = 0  # O to O is the measure; O to I cannot be
    for step in range(1, PASSES + 1):
        b, i = np.zeros(labels.shape), np.zeros(labels.shape)
        b[real], i[real] = theta[:n][x].sum(1), theta[n : 2 * n][x].sum(1)
        t = theta[2 * n :].reshape(3, 3).copy()
        t[0, 0], t[0, 2] = 0, _NEVER
        _, node, pairs = _likelihood(labels, size, b, i, t)
        g = [np.bincount(x.ravel(), weights=np.repeat(node[:, :, k][real], x.shape[1]), minlength=n) for k in (0, 1)]
        grad = np.concatenate([*g, (pairs * free).ravel()]) + RIDGE / len(size) * theta
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta = theta - 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    t = theta[2 * n :].reshape(3, 3).copy()
    t[0, 0], t[0, 2] = 0, _NEVER
    return Model(theta[:n], theta[n : 2 * n], t, 0.0)


def prepared(windows: list[str], seed: int = 1):
    """(tokens, features, labels, whether a secret was planted, first byte of each window) of windows, some with planted strings."""
    r = random.Random(seed)
    made = [_plant(r, x) for x in windows]
    texts = [m[0] for m in made]
    w, f = features(texts)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1].astype(np.int64)
    return w, f, _labels(w, [_value_spans(t, s) for t, s, _ in made], begins), np.array([m[2] for m in made], bool), begins


def _firsts(w: Words) -> np.ndarray:
    out = np.zeros(len(w.hash), bool)
    out[w.bound[:-1][w.bound[:-1] < len(out)]] = True
    return out


def fit_model(windows: list[str], seed: int = 1) -> Model:
    """The model, with the least cost of B at which the held-out windows keep MAX_FALSE.

    Fewer than LEAST_WINDOWS windows are taken again, with other planted strings; without any, they are planted alone.
    """
    windows = windows or ["-"]
    windows = windows * max(1, -(-LEAST_WINDOWS // len(windows)))
    cut = int(len(windows) * (1 - HELD_OUT))
    w, f, y, _, _ = prepared(windows[:cut], seed)
    model = _fit(f, y, w.bound)
    w, f, y, planted, _ = prepared(windows[cut:], seed + 1)
    text = np.repeat(np.arange(len(w.bound) - 1), np.diff(w.bound))
    b, i = model.scores(f)
    for cost in np.arange(0, 12.5, 0.5):
        model.cost = float(cost)
        false = (decode(b - cost, i, _firsts(w), model.trans) > 0) & (y == 0) & ~planted[text]
        if len(np.unique(text[false])) <= MAX_FALSE * (~planted).sum():
            break
    return model


def _windows(share: float):
    """One window at a place given by the text's hash, and one around the first match of the patterns."""

    def rows(batches):
        for batch in batches:
            for t in batch.column("text").cast(pa.binary()).to_pylist():
                digest = hashlib.sha256(t).digest()
                if int.from_bytes(digest[:4], "big") >= share * (1 << 32):
                    continue
                words = t.replace(b"\n", b" \n ").split(b" ")
                ends = np.cumsum([len(x) + 1 for x in words])
                places = [int.from_bytes(digest[4:8], "big") % len(words)]
                places += [int(np.searchsorted(ends, a, side="right")) for a, _, _ in base_spans(t.replace(b"\n", b" \n "))[:1]]
                out = [b" ".join(words[max(0, p - WINDOW // 2) : p + WINDOW // 2]).replace(b" \n ", b"\n") for p in places]
                out = [x.decode("utf-8", "replace") for x in out if len(x) <= 100 * WINDOW]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out)], ["window"])

    return rows


def sample_windows(docs: DataFrame) -> list[str]:
    """At most SAMPLE_WINDOWS distinct windows of docs(text), in the order of their hashes."""
    n = docs.count()
    got = docs.mapInArrow(lean(_windows(min(1.0, SAMPLE_DOCS / max(1, n)))), "window string").distinct()
    return [r.window for r in got.orderBy(F.sha2("window", 256)).limit(SAMPLE_WINDOWS).collect()]


def model_spans(texts: list[bytes], model: Model) -> list[list[tuple[int, int]]]:
    """Byte spans that the model finds in each text, padding of base64 included."""
    w, f = features(texts)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not len(w.hash):
        return out
    label = decode(*model.scores(f), _firsts(w), model.trans)
    at = np.flatnonzero(label)
    if not len(at):
        return out
    head = np.flatnonzero(label[at] == 1)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    text = np.searchsorted(w.bound, at[head], side="right") - 1
    for d, a, z in zip(text.tolist(), at[head].tolist(), at[np.append(head[1:], len(at)) - 1].tolist()):
        first, end = int(w.start[a] - begins[d]), int(w.end[z] - begins[d])
        while texts[d][end : end + 1] == b"=":
            end += 1
        out[d].append((first, end))
    return out


def _scan(model):
    def rows(batches):
        for batch in batches:
            for first, part in chunks(batch.column("text").cast(pa.binary()).to_pylist()):
                spans = []
                for t, added in zip(part, model_spans(part, model.value)):
                    own = base_spans(t)
                    inside = lambda a, e: any(x <= a and e <= y for x, _, y in own)  # noqa: B023, E731
                    own = sorted(own + [(a, 3, e) for a, e in added if not inside(a, e)])
                    if own and not t.isascii():
                        point = np.concatenate([[0], np.cumsum((np.frombuffer(t, np.uint8) & 0xC0) != 0x80)])
                        own = [(int(point[a]), k, int(point[e])) for a, k, e in own]
                    spans.append([{"kind": KINDS[k], "start": a, "end": e} for a, k, e in own])
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, len(part)), pa.array(spans, kind)], ["id", "spans"])

    return rows


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """One row per row of docs: id_col, spans (array of kind, start, end in code points, by start, then kind).

    Kinds: ``assign``, ``access`` and ``hex`` are the patterns' matches, leftmost
    and non-overlapping each; ``crf`` are the model's spans that no pattern's
    match covers.  Without a model, one is fitted on a bounded sample of docs.

    A null or empty text has no spans; repeated rows get the same ones; a null id
    passes through; very long texts are scanned whole; an empty table gives an
    empty result; other columns are not read.
    """
    spark = docs.sparkSession
    scratch.small_batches(spark)
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    model = spark.sparkContext.broadcast(model or fit_model(sample_windows(src.select("text"))))
    kind = docs.schema[id_col].dataType.simpleString()
    return src.mapInArrow(lean(_scan(model)), f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("id", id_col)

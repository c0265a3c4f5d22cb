"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - score), thresholds ascending, one score
for all grades: the sum of a text's hashed-feature weights.  Features are the
distinct lower-cased words, the distinct word endings, and three steps each of
the share of repeated lines and of upper-case letters, hashed to 2**BITS
weights.  The fit uses a bounded sample of labelled rows (MAX_LABELS, chosen by
hash); the weights (4 MB) are broadcast and every text is scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orfloom.llm import scratch
from orfloom.llm.textops import chunks, mix, split_words, word_hashes

#: Weights, and labelled rows that the fit uses at most.
BITS, MAX_LABELS = 20, 8000
#: Ridge penalty, and the square of the standard errors at which a feature counts half.
RIDGE, DOUBT = 1.0, 9.0
#: The first slots are for features of form (endings, whole-text steps).
FORM_SLOTS = 4096

_PUNCT = np.zeros(256, np.int64)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = 1
_END = np.uint64(0xA24BAED4963EE407)


def _shape_slots(text: bytes) -> list[int]:
    """Slots of the features of a whole text: steps of repeated lines and of upper case."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 1 - len(set(lines)) / len(lines) if lines else 0
    upper = sum(map(text.count, (b"A", b"E", b"I", b"N", b"O", b"R", b"S", b"T"))) / max(1, len(text))
    return [k for k, t in enumerate((0.25, 0.5, 0.75)) if repeated >= t] + [3 + k for k, t in enumerate((0.1, 0.2, 0.3)) if upper >= t]


def feature_slots(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of each distinct feature, sorted by text."""
    w = split_words(texts, lower=True)
    n = np.diff(w.bound)
    d = np.repeat(np.arange(len(texts)), n)
    core = w.end.copy()  # without punctuation at the end
    for _ in range(4):
        core -= (core > w.start + 1) & _PUNCT[w.buf[core - 1]]
    slots = [(word_hashes(w.buf, w.start, e, k) >> np.uint64(64 - BITS)).astype(np.int64) for k, e in enumerate((core, np.minimum(core, w.start + 4), np.minimum(core, w.start + 6)))]
    ends = mix(w.buf[w.end - 1].astype(np.uint64) * _END + w.buf[np.maximum(w.end - 2, w.start)].astype(np.uint64)) >> np.uint64(64 - 11)
    shape = [_shape_slots(t) for t in texts]
    extra = np.repeat(np.arange(len(texts)), [len(s) for s in shape])
    key = np.concatenate([d, d, d, d, extra]) << BITS | np.concatenate([*slots, ends.astype(np.int64) + FORM_SLOTS // 2, np.array([x for s in shape for x in s], np.int64)])
    key = np.unique(key)
    return key >> BITS, key & ((1 << BITS) - 1)


@dataclass
class OrdinalModel:
    """Weights by slot and ascending thresholds; grades 0 .. len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, by row."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - score[:, None], -30, 30)))

    @classmethod
    def fit(cls, text: np.ndarray, slot: np.ndarray, grade: np.ndarray, rounds: int = 150, ridge: float = RIDGE) -> OrdinalModel:
        """Regularised maximum likelihood; text is sorted, one grade for each text.

        A feature's weight is its coefficient times z^2 / (z^2 + DOUBT): z is how
        many standard errors the mean grade of the texts that have it lies from
        that of all.  So what says nothing about grades, rare or common, is
        damped alike at every number of texts and every mix of grades.
        """
        n, top = len(grade), max(1, int(grade.max(initial=0)))
        used = np.flatnonzero(np.bincount(slot, minlength=1 << BITS)) if len(slot) else np.zeros(0, np.int64)
        place = np.zeros(1 << BITS, np.int32)
        place[used] = np.arange(len(used))
        slot, text = place[slot], text.astype(np.int32)
        share = [np.clip((grade <= k).mean() if n else 0.5, 0.01, 0.99) for k in range(top)]
        base = np.log(np.array(share) / (1 - np.array(share)))
        start = np.concatenate([np.zeros(len(used)), base[:1], np.log(np.maximum(np.diff(base), 0.1))])
        if n:
            count, total = np.bincount(slot, minlength=len(used)), _sums(slot, lambda a, b: grade[text[a:b]], len(used))
            far = (total / np.maximum(count, 1) - grade.mean()) * np.sqrt(count) / max(grade.std(), 1e-9)
            value = far * far / (far * far + DOUBT)
            start = _minimise(lambda p: _loss(p, text, slot, value, grade, top, ridge), start, rounds)
        else:
            value = np.zeros(0)
        weights = np.zeros(1 << BITS)
        weights[used] = start[: len(used)] * value
        first, gaps = start[len(used)], start[len(used) + 1 :]
        return cls(weights, np.concatenate([[first], first + np.cumsum(np.exp(gaps))]))


#: Entries that are summed at once: what is held besides the entries themselves does not grow with them.
STEP = 1 << 20


def _sums(at: np.ndarray, values, n: int) -> np.ndarray:
    """Sums of values(a, b), the values of entries a to b - 1, by the entries' places."""
    out = np.zeros(n)
    for a in range(0, len(at), STEP):
        out += np.bincount(at[a : a + STEP], weights=values(a, a + STEP), minlength=n)
    return out


def _loss(p: np.ndarray, text: np.ndarray, slot: np.ndarray, value: np.ndarray, grade: np.ndarray, top: int, ridge: float) -> tuple[float, np.ndarray]:
    """(negative log likelihood with ridge, its slope) in coefficients, first threshold and logs of the gaps, for a text."""
    n, k = len(grade), len(value)
    w, gaps = p[:k], np.exp(np.clip(p[k + 1 :], -20, 20))
    t = np.concatenate([[p[k]], p[k] + np.cumsum(gaps)])
    scaled = w * value
    score = _sums(text, lambda a, b: scaled[slot[a:b]], n)
    below = 1 / (1 + np.exp(np.clip(score[:, None] - t[None], -30, 30)))  # P(grade <= k)
    full = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], 1)
    row = np.arange(n)
    high, low = full[row, grade + 1], full[row, grade]
    chance = np.maximum(high - low, 1e-12)
    by_score = (1 - high - low) / n  # exact for logistic links: it never vanishes where the fit is wrong
    slope = np.zeros_like(p)
    slope[:k] = _sums(slot, lambda a, b: by_score[text[a:b]], k) * value + ridge * w / n
    lift = full[:, 1 : top + 1] * (1 - full[:, 1 : top + 1]) / chance[:, None]
    by_t = np.array([(lift[grade == j + 1, j].sum() - lift[grade == j, j].sum()) / n for j in range(top)])
    slope[k] = by_t.sum()
    for j in range(1, top):
        slope[k + j] = by_t[j:].sum() * gaps[j - 1]
    return float(-np.log(chance).mean() + ridge * (w @ w) / (2 * n)), slope


def _minimise(f, p: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with backtracking."""
    loss, g = f(p)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, kept = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ d) / (s @ y)
            kept.append(a)
            d -= a * y
        if pairs:
            d *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1])
        for (s, y), a in zip(pairs, reversed(kept)):
            d += s * (a - (y @ d) / (s @ y))
        step = 1.0 if pairs else 1 / max(np.abs(g).max(), 1.0)
        while step > 1e-10:
            q = p - step * d
            new, h = f(q)
            if np.isfinite(new) and new <= loss - 1e-4 * step * (g @ d):
                break
            step /= 2
        else:
            return p
        s, y = q - p, h - g
        if s @ y > 1e-12:
            pairs = [*pairs[1 - memory :], (s, y)]
        done = loss - new < 1e-7 * max(abs(loss), 1e-3)
        p, loss, g = q, new, h
        if done:
            return p
    return p


def fit_grades(docs: DataFrame, labels: DataFrame, grade, id_col: str = "doc_id", text_col: str = "text", max_labels: int = MAX_LABELS) -> OrdinalModel:
    """Fit on at most max_labels labelled ids, chosen by hash; grade is a column of labels, 0 the worst.

    An id with several grades counts with the lowest; of an id's texts in docs
    the first by hash counts.  Null ids, texts and grades take no part; without
    any labelled text all documents get one score.
    """
    rated = labels.select(F.col(id_col).alias("id"), grade.cast("int").alias("grade")).where("grade is not null and id is not null").groupBy("id").agg(F.min("grade").alias("grade"))
    some = rated.orderBy(F.xxhash64("id"), "id").limit(max_labels)
    both = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(some), "id")
    both = both.groupBy("id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def rows(batches):
        for batch in batches:
            for first, part in chunks(batch.column("text").cast(pa.binary()).to_pylist()):
                d, s = feature_slots(part)
                cut = np.searchsorted(d, np.arange(len(part) + 1))
                out = pa.array([s[cut[i] : cut[i + 1]].astype("<u4").tobytes() for i in range(len(part))], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, len(part)).cast(pa.string()), batch.column("grade").slice(first, len(part)), out], ["id", "grade", "slots"])

    got = both.select("id", "grade", "text").mapInArrow(rows, "id string, grade int, slots binary").collect()  # max_labels rows at most
    got.sort(key=lambda r: (str(r["id"]), bytes(r["slots"])))
    grades = np.array([r["grade"] for r in got], np.int64)
    slots = [np.frombuffer(r["slots"], "<u4").astype(np.int32) for r in got]
    del got
    text = np.repeat(np.arange(len(slots), dtype=np.int32), [len(s) for s in slots])
    return OrdinalModel.fit(text, np.concatenate(slots) if slots else np.zeros(0, np.int32), grades)


def score_documents(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, expected_grade, p_top (probability of the best grade).

    A null text is empty; a null id passes through; repeated rows repeat; an
    empty table gives an empty result; further columns are not read.
    """
    scratch.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches):
        weights, thresholds = shared.value
        own = OrdinalModel(weights, thresholds)
        for batch in batches:
            for first, part in chunks(batch.column("text").cast(pa.binary()).to_pylist()):
                d, s = feature_slots(part)
                above = own.above(np.bincount(d, weights=weights[s], minlength=len(part)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, len(part)), pa.array(above.sum(1)), pa.array(above[:, -1])], ["id", "expected_grade", "p_top"])

    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return src.mapInArrow(rows, f"id {kind}, expected_grade double, p_top double").withColumnRenamed("id", id_col)

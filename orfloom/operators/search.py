"""Protein search and clustering: seeds, double hits on a diagonal, banded gapped alignment, bit scores and e-values.

Seeds are words of k residues over an alphabet of groups of similar residues.
A query also seeds with the words that differ from its own in one group of
non-negative score.  Subjects keep the seeds that some query has (a bitmap of
fixed size) and that lie near another such seed; a pair of sequences is aligned
where two of its seeds lie on one diagonal, at most ``window`` residues apart.

Alignments run in batches: all pairs of a batch take one row of their bands at a
time, with the start, matches and columns of each cell's best alignment carried
along, so memory does not grow with the sequences.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orfloom.operators.relational import bucketed, checkpoints, salted_join

RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
#: Groups of similar residues, the alphabet of seeds.
GROUPS = ("A", "ST", "C", "DN", "EQ", "FY", "G", "H", "IV", "KR", "LM", "P", "W")
# Properties of the residues, in their order: hydropathy, volume in cubic angstroms, charge.
_HYDROPATHY = (1.8, 2.5, -3.5, -3.5, 2.8, -0.4, -3.2, 4.5, -3.9, 3.8, 1.9, -3.5, -1.6, -3.5, -4.5, -0.8, -0.7, 4.2, -0.9, -1.3)
_VOLUME = (88.6, 108.5, 111.1, 138.4, 189.9, 60.1, 153.2, 166.7, 168.6, 166.7, 162.9, 114.1, 112.7, 143.8, 173.4, 89.0, 116.1, 140.0, 227.8, 193.6)
_CHARGE = (0, 0, -1, -1, 0, 0, 0.5, 0, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0)
#: Costs of opening and of extending a gap; half the width of a band; Karlin's K.
GAP_OPEN, GAP_EXTEND, BAND, K = 11, 1, 32, 0.1
#: Bits of the bitmap of the queries' seeds (8 MB), whatever the tables.
BITMAP_BITS = 26
#: Least score of a run without gaps on the diagonal of a pair that is aligned.
MIN_UNGAPPED = 15
#: Pairs, and cells of their bands, that are aligned at once.
BATCH_PAIRS, PAIR_BYTES = 128, 32 << 20
#: Rows of a batch's bands after which pairs are given up that cannot cover.
CHECK_ROWS = 64
#: Pairs of a task.
TASK_PAIRS = 512
OTHER = len(RESIDUES)


@cache
def scores() -> np.ndarray:
    """Substitution scores of the residues (and of all others, last): 6 for equal ones, less the more their properties differ."""
    p = np.array([_HYDROPATHY, _VOLUME, _CHARGE]).T / np.array([4.5, 60.0, 1.0])
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    s = np.full((OTHER + 1, OTHER + 1), -1, np.int64)
    s[:OTHER, :OTHER] = np.maximum(np.round(2 - 2.2 * d), -4)
    s[range(OTHER), range(OTHER)] = 6
    return s


@cache
def _groups() -> tuple[np.ndarray, np.ndarray]:
    """(group of each residue, mean scores between groups)."""
    of = np.full(OTHER + 1, len(GROUPS), np.int64)
    for g, names in enumerate(GROUPS):
        of[[RESIDUES.index(c) for c in names]] = g
    own = [np.flatnonzero(of[:OTHER] == g) for g in range(len(GROUPS))]
    return of, np.array([[scores()[np.ix_(a, b)].mean() for b in own] for a in own])


@cache
def decay() -> float:
    """Karlin's lambda of the scores, for residues that are equally frequent."""
    s, low, high = scores()[:OTHER, :OTHER], 1e-3, 5.0
    while high - low > 1e-9:
        mid = (low + high) / 2
        low, high = (mid, high) if np.exp(mid * s).mean() < 1 else (low, mid)
    return low


_CODE = np.full(256, OTHER, np.uint8)
for _i, _c in enumerate(RESIDUES):
    _CODE[[ord(_c), ord(_c.lower())]] = _i


@dataclass
class Seeds:
    """Seeds of a list of sequences: sequence, place and word of each."""

    seq: np.ndarray
    place: np.ndarray
    word: np.ndarray


def seeds(seqs: list[bytes], k: int) -> Seeds:
    """All words of k residues; those with other letters are none."""
    sizes = np.fromiter((len(s) for s in seqs), np.int64, len(seqs))
    r = _groups()[0][_CODE[np.frombuffer(b"".join(seqs), np.uint8)]]
    n = max(0, len(r) - k + 1)
    word, ok = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(k):
        word = word * len(GROUPS) + r[j : j + n]
        ok &= r[j : j + n] < len(GROUPS)
    bound = np.concatenate([[0], np.cumsum(sizes)])
    seq = np.repeat(np.arange(len(seqs)), sizes)[:n]
    at = np.flatnonzero(ok & (np.arange(n) + k <= bound[1:][seq]))
    return Seeds(seq[at], at - bound[seq[at]], word[at])


def with_neighbours(s: Seeds, k: int) -> Seeds:
    """The seeds, and those of one changed group of non-negative score."""
    between, parts = _groups()[1], [(s.seq, s.place, s.word)]
    for j in range(k):
        power = len(GROUPS) ** (k - 1 - j)
        own = s.word // power % len(GROUPS)
        for g in range(len(GROUPS)):
            at = np.flatnonzero((own != g) & (between[own, g] >= 0))
            parts.append((s.seq[at], s.place[at], s.word[at] + (g - own[at]) * power))
    return Seeds(*(np.concatenate(x) for x in zip(*parts)))


def align_bands(queries: list[np.ndarray], subjects: list[np.ndarray], diagonals: np.ndarray, band: int = BAND, coverage: float = 0.0) -> np.ndarray:
    """Best local alignment of each pair within ``band`` of a diagonal (subject place less query place).

    Columns: score, first and last query and subject place (from 0, inclusive),
    matches, columns, gap openings.  A score of 0 has zeros.

    With a coverage, pairs whose best alignment covers less of either sequence
    may be left out (zeros): a pair is given up once no alignment that began early
    enough goes on, none can begin any more, and those that ended are too short.
    """
    p, w = len(queries), 2 * band + 1
    best = np.zeros((p, 8), np.int64)
    if not p:
        return best
    nq, ns = (np.array([len(x) for x in side]) for side in (queries, subjects))
    s = scores()
    # Row r of pair i is query place first[i] + r; cell c is subject place first[i] + r + diagonal - band + c.
    first = np.clip(-diagonals - band, 0, None)
    rows = np.minimum(nq, ns - diagonals + band) - first
    order = np.argsort(-rows, kind="stable")
    queries, subjects, nq, ns, first, rows, diagonals = [queries[i] for i in order], [subjects[i] for i in order], nq[order], ns[order], first[order], rows[order], diagonals[order]
    longest = max(0, int(rows[0]))
    q = np.full((p, longest + 1), OTHER, np.uint8)
    t = np.full((p, longest + w + 1), 255, np.uint8)
    for i in range(p):
        if rows[i] > 0:
            own = queries[i][first[i] : first[i] + rows[i]]
            q[i, : len(own)] = own
            a = first[i] + diagonals[i] - band
            own = subjects[i][max(0, a) : a + longest + w]
            t[i, max(0, -a) : max(0, -a) + len(own)] = own
    low = -(1 << 40)
    wide = np.full((OTHER + 1, 256), low, np.int64)
    wide[:, : OTHER + 1] = s
    h, up = np.zeros((p, w), np.int64), np.full((p, w), low, np.int64)
    info = np.zeros((5, p, w), np.int64)  # first query place, first subject place, matches, columns, openings
    up_info = np.zeros((5, p, w), np.int64)
    cells = np.arange(w)
    # Last places at which an alignment that covers enough begins, and spans that it has at least; with one place to spare for rounding.
    latest_q, latest_s, least_q, least_s = nq * (1 - coverage) + 1, ns * (1 - coverage) + 1, nq * coverage - 1, ns * coverage - 1
    for r in range(longest):
        m = int(np.searchsorted(-rows, -r, side="left"))
        if coverage and r % CHECK_ROWS == 0:
            at_q, at_s = first[:m] + r, first[:m] + r + diagonals[:m]
            over = ((at_q > latest_q[:m]) | (at_s - band > latest_s[:m])) & ((at_q < least_q[:m]) | (at_s + band < least_s[:m]))
            for i in np.flatnonzero(over):
                over[i] = not any(((x[i] > 0) & (y[0, i] <= latest_q[i]) & (y[1, i] <= latest_s[i])).any() for x, y in ((h, info), (up, up_info)))
            if 8 * over.sum() > m:
                best[order[:m][over]] = 0
                on = np.flatnonzero(~over)
                q, t, h, up, info, up_info = q[on], t[on], h[on], up[on], info[:, on], up_info[:, on]
                order, nq, ns, first, rows, diagonals, latest_q, latest_s, least_q, least_s = [x[on] for x in (order, nq, ns, first, rows, diagonals, latest_q, latest_s, least_q, least_s)]
                m = len(on)
        if not m:
            break
        a, b = q[:m, r], t[:m, r : r + w]
        # From above: a gap in the subject.
        opened, extended = h[:m, 1:] - GAP_OPEN, up[:m, 1:] - GAP_EXTEND
        new_up, new_up_info = np.full((m, w), low, np.int64), np.zeros((5, m, w), np.int64)
        open_wins = opened >= extended
        new_up[:, :-1] = np.where(open_wins, opened, extended)
        new_up_info[:, :, :-1] = np.where(open_wins, info[:, :m, 1:], up_info[:, :m, 1:])
        new_up_info[3, :, :-1] += 1
        new_up_info[4, :, :-1] += open_wins
        # Along the diagonal, from 0 where nothing came before.
        step = wide[a[:, None], b]
        diagonal = np.maximum(h[:m], 0) + step
        own = info[:, :m].copy()
        fresh = h[:m] <= 0
        place = first[:m, None] + r
        own[0] = np.where(fresh, place, own[0])
        own[1] = np.where(fresh, place + diagonals[:m, None] - band + cells, own[1])
        own[2:] = np.where(fresh, 0, own[2:])
        own[2] += a[:, None] == b
        own[3] += 1
        take = new_up > diagonal
        h0 = np.where(take, new_up, diagonal)
        own = np.where(take, new_up_info, own)
        h0 = np.where(b == 255, low, np.maximum(h0, 0))
        # From the left: the place whose score less its distance is largest.
        key = ((h0 + GAP_EXTEND * cells) << 12) + cells
        top = np.maximum.accumulate(key, 1)[:, :-1]
        source = (top & 4095).astype(np.int64)
        left = (top >> 12) - GAP_OPEN - GAP_EXTEND * cells[:-1]
        take = left > h0[:, 1:]
        take &= b[:, 1:] != 255
        if take.any():
            i, c = np.nonzero(take)
            h0[i, c + 1] = left[i, c]
            moved = own[:, i, source[i, c]]
            moved[3] += c + 1 - source[i, c]
            moved[4] += 1
            own[:, i, c + 1] = moved
        h[:m], info[:, :m], up[:m], up_info[:, :m] = h0, own, new_up, new_up_info
        at = h0.argmax(1)
        value = h0[np.arange(m), at]
        better = np.flatnonzero(value > best[order[:m], 0])
        if len(better):
            k = at[better]
            x = own[:, better, k]
            last_q = first[better] + r
            best[order[better]] = np.stack([value[better], x[0], last_q, x[1], last_q + diagonals[better] - band + k, x[2], x[3], x[4]], 1)
    return best


def ungapped(query: np.ndarray, subject: np.ndarray, diagonal: int) -> int:
    """Best score of a run without gaps on a diagonal."""
    a, b = max(0, -diagonal), min(len(query), len(subject) - diagonal)
    if a >= b:
        return 0
    total = np.cumsum(scores()[query[a:b], subject[a + diagonal : b + diagonal]])
    return int((total - np.minimum.accumulate(np.minimum(np.append(0, total[:-1]), 0))).max())


def best_diagonal(query: np.ndarray, subject: np.ndarray, diagonals: list[int], least: int) -> int | None:
    """The diagonal with the best run without gaps (the first of equal ones), if it scores ``least``."""
    best = max(((ungapped(query, subject, d), -d) for d in diagonals), default=(0, 0))
    return -best[1] if best[0] >= least else None


def _codes(s: str) -> np.ndarray:
    return _CODE[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]


_RESULT = ["score", "query_start", "query_stop", "subject_start", "subject_stop", "n_identical_matches", "alignment_length", "n_gap_open_events"]


def _align_pairs(band: int, least: int, coverage: float):
    def rows(batches):
        for batch in batches:
            left, right = batch.column("query_seq").to_pylist(), batch.column("subject_seq").to_pylist()
            found = batch.column("diagonals").to_pylist()
            best, jobs, own = np.zeros((len(left), 8), np.int64), [], (None, None)
            for i, (q, t) in enumerate(zip(left, right)):
                own = own if own[0] is q or own[0] == q else (q, _codes(q))
                d = best_diagonal(own[1], _codes(t), found[i], least)
                if d is not None:
                    jobs.append((len(q), i, d))
            jobs.sort()
            while jobs:
                size = max(1, min(BATCH_PAIRS, PAIR_BYTES // (jobs[-1][0] + 1)))
                part, jobs = jobs[-size:], jobs[:-size]
                at = [i for _, i, _ in part]
                best[at] = align_bands([_codes(left[i]) for i in at], [_codes(right[i]) for i in at], np.array([d for _, _, d in part]), band, coverage)
            keep = pa.array(np.flatnonzero(best[:, 0] > 0))
            names = [c for c in batch.schema.names if c != "diagonals"]
            columns = [*[batch.column(c) for c in names], *[pa.array(best[:, k]) for k in range(8)]]
            yield pa.RecordBatch.from_arrays([c.take(keep) for c in columns], [*names, *_RESULT])

    return rows


def aligned(pairs: DataFrame, count: int | None, band: int = BAND, min_ungapped: int = MIN_UNGAPPED, coverage: float = 0.0) -> DataFrame:
    """``count`` pairs (query_id, subject_id, query_seq, subject_seq, diagonals) with their alignment around the best diagonal.

    Pairs without a run of min_ungapped on any of their diagonals are left out, and those that cover less than coverage of either may be.  Without a count they are aligned in the partitions that they lie in.
    """
    kinds = dict(pairs.dtypes)
    names = [c for c in pairs.columns if c != "diagonals"]
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in names], *[f"{c} long" for c in _RESULT]])
    # Few bytes, much work: adaptive execution would put all pairs into one task.
    pairs = pairs if count is None else pairs.repartition(1 + count // TASK_PAIRS)
    return pairs.mapInArrow(_align_pairs(band, min_ungapped, coverage), schema)


def _rows_of(ids: pa.Array, s: Seeds) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(s.word), ids.take(pa.array(s.seq)), pa.array(s.place)], ["word", "id", "place"])


def _seqs(batch: pa.RecordBatch) -> list[bytes]:
    return [x.encode("latin-1", "replace") for x in batch.column("seq").to_pylist()]


def _parts(batch: pa.RecordBatch, most: int = 1 << 20):
    """Slices of a batch of about ``most`` residues."""
    seqs, first, held = _seqs(batch), 0, 0
    for i, s in enumerate(seqs):
        held += len(s)
        if held > most or i + 1 == len(seqs):
            yield batch.column("id").slice(first, i + 1 - first), seqs[first : i + 1]
            first, held = i + 1, 0


def _query_seeds(k: int, neighbours: bool):
    def rows(batches):
        for batch in batches:
            for ids, seqs in _parts(batch, 1 << 17):
                s = seeds(seqs, k)
                yield _rows_of(ids, with_neighbours(s, k) if neighbours else s)

    return rows


def _subject_seeds(k: int, wanted, window: int):
    def rows(batches):
        for batch in batches:
            for ids, seqs in _parts(batch):
                s = seeds(seqs, k)
                slot = _slots(s.word)
                at = np.flatnonzero(wanted.value[slot >> 3] >> (slot & 7) & 1)
                # Two seeds on one diagonal are as far apart in the subject as in the query.
                near = (np.diff(s.seq[at]) == 0) & (np.diff(s.place[at]) <= window)
                at = at[np.append(near, False)[: len(at)] | np.append(False, near)[: len(at)]]
                yield _rows_of(ids, Seeds(s.seq[at], s.place[at], s.word[at]))

    return rows


def _slots(words: np.ndarray) -> np.ndarray:
    """Bit of each word in a bitmap of 2**BITMAP_BITS; longer words may share one, which only lets more seeds through."""
    return ((words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def _bitmap(words: DataFrame) -> np.ndarray:
    """The bitmap of the words' bits."""
    size = 1 << 18

    def slots(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slots(batch.column("word").to_numpy())))], ["slot"])

    def pack(key, table):
        bits = np.zeros(size, np.uint8)
        bits[table.column("slot").to_numpy() % size] = 1
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    found = words.select("word").mapInArrow(slots, "slot long").distinct()
    parts = found.withColumn("block", F.floor(F.col("slot") / size)).groupBy("block").applyInArrow(pack, "block long, bits binary").collect()
    out = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    for r in parts:
        out[r["block"] * size // 8 : (r["block"] + 1) * size // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _sequences(df: DataFrame, id_col: str, seq_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(seq_col).alias("seq")).where("id is not null and seq is not null and seq <> ''")


def _statistics(hits: DataFrame, residues: int) -> DataFrame:
    """hits with bit score, e-value, fractions and coverages."""
    rate = decay()
    span = lambda p: (F.col(f"{p}_stop") - F.col(f"{p}_start") + 1) / F.length(f"{p}_seq")
    e_value = F.lit(K) * F.length("query_seq") * F.lit(float(residues)) * F.exp(-rate * F.col("score"))
    gaps = F.col("alignment_length") * 2 - (F.col("query_stop") - F.col("query_start") + 1) - (F.col("subject_stop") - F.col("subject_start") + 1)
    return hits.withColumns({
        "bit_score": (rate * F.col("score") - float(np.log(K))) / float(np.log(2)), "e_value": e_value,
        "fraction_identical_matches": F.try_divide(F.col("n_identical_matches").cast("double"), "alignment_length"),
        "query_coverage": span("query"), "subject_coverage": span("subject"), "n_mismatches": F.col("alignment_length") - gaps - F.col("n_identical_matches"),
    })


def candidate_pairs(queries: DataFrame, subjects: DataFrame, k: int, window: int, neighbours: bool = True) -> DataFrame:
    """(query_id, subject_id, diagonals) of the pairs with two seeds on one diagonal at most ``window`` apart; both sides have id, seq."""
    spark = queries.sparkSession
    checkpoints(spark)
    kind = lambda df: dict(df.dtypes)["id"]
    q = queries.mapInArrow(_query_seeds(k, neighbours), f"word long, id {kind(queries)}, place long")
    wanted = spark.sparkContext.broadcast(_bitmap(q))
    s = subjects.mapInArrow(_subject_seeds(k, wanted, window), f"word long, id {kind(subjects)}, place long")
    q, s = (df.select("word", F.col("id").alias(f"{side}_id"), F.col("place").alias(x)).checkpoint() for df, side, x in ((q, "query", "a"), (s, "subject", "b")))
    hits = salted_join(s, q, "word", "subject_id")
    hits = hits.select("query_id", "subject_id", "a", (F.col("b") - F.col("a")).alias("diagonal"))
    before = F.lag("a").over(Window.partitionBy("query_id", "subject_id", "diagonal").orderBy("a"))
    double = hits.withColumn("gap", F.col("a") - before).where(F.col("gap").between(1, window))
    return double.groupBy("query_id", "subject_id").agg(F.collect_set("diagonal").alias("diagonals"))


def search(
    queries: DataFrame, subjects: DataFrame | None = None, max_e_value: float = 10.0, k: int = 5, window: int = 40, band: int = BAND,
    min_ungapped: int = MIN_UNGAPPED, neighbours: bool = True, id_col: str = "id", seq_col: str = "seq",
) -> DataFrame:
    """Alignments of queries with subjects (or with themselves) of at most max_e_value: the columns of read_mmseqs.

    One row for each pair with a double hit, with the banded alignment around the
    diagonal of its best run without gaps, which must score min_ungapped; a smaller k, and seeds of neighbouring words, find
    more distant pairs and cost more.  e-values use the residues of all subjects.  Rows without an id or a sequence take no
    part; letters that are no residue score -1 and seed nothing; ids are taken
    to be unique (repeated ids give a row for each pair of rows).
    """
    if not 2 <= k <= 17:
        raise ValueError("k must be between 2 and 17")
    q = _sequences(queries, id_col, seq_col)
    s = q if subjects is None else _sequences(subjects, id_col, seq_col)
    residues = s.agg(F.sum(F.length("seq"))).first()[0] or 0
    pairs = candidate_pairs(q, s, k, window, neighbours).checkpoint()
    count = pairs.count()
    pairs = salted_join(pairs, q.select(F.col("id").alias("query_id"), F.col("seq").alias("query_seq")), "query_id", "subject_id")
    pairs = pairs.join(s.select(F.col("id").alias("subject_id"), F.col("seq").alias("subject_seq")), "subject_id")
    out = _statistics(aligned(pairs, count, band, min_ungapped), residues).where(F.col("e_value") <= max_e_value)
    return out.select(
        "query_id", "subject_id", "e_value", "bit_score", "fraction_identical_matches", "query_seq", "subject_seq", "query_coverage", "subject_coverage",
        F.col("n_mismatches").cast("int").alias("n_mismatches"), F.col("alignment_length").cast("int").alias("alignment_length"),
    )


def _signatures(k: int, words: int):
    """The ``words`` seeds of least hash of each sequence, each at its first place."""

    def rows(batches):
        for batch in batches:
            for ids, seqs in _parts(batch):
                s = seeds(seqs, k)
                h = (s.word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16)
                order = np.lexsort((s.place, h, s.seq))
                new = np.append(True, (np.diff(h[order]) != 0) | (np.diff(s.seq[order]) != 0))[: len(order)]
                order = order[new]
                begin = np.flatnonzero(np.append(True, np.diff(s.seq[order]) != 0)[: len(order)])
                rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
                at = order[rank < words]
                yield _rows_of(ids, Seeds(s.seq[at], s.place[at], s.word[at]))

    return rows


def cluster_sequences(
    df: DataFrame, min_identity: float = 0.5, min_coverage: float = 0.8, k: int = 8, words: int = 20, band: int = BAND, id_col: str = "id", seq_col: str = "seq"
) -> DataFrame:
    """(cluster_rep_id, id): each sequence with the representative that covers it, representatives with themselves.

    Sequences are taken from the longest on (then by id).  A signature word
    belongs to the first representative that has it.  A sequence becomes a
    representative if none of those that its words belong to covers it: identity
    of at least min_identity and coverage of at least min_coverage of both.
    Others go to the first one that does.  Signatures are the ``words`` seeds of
    least hash, and a word's sequences are aligned with its one owner alone, so
    the work is linear in the sequences however many share a word.

    In a round, every open sequence that is the first in all of its open words'
    groups is a representative: it is aligned with the rest of these groups, whom
    it covers leaves, and its words are closed.  A word of one sequence binds
    nobody and is left out.  Equal sequences are one from the start (the smallest
    id), by their SHA-256.  Sequences shorter than k stand alone.  Rows without an
    id or a sequence take no part; ids are taken to be unique.

    Sequences are shuffled once, into buckets by id.  In a round the
    representatives' travel to their pairs' other ends, and nothing else does but
    ids, words and places.
    """
    spark = df.sparkSession
    checkpoints(spark)
    rows = _sequences(df, id_col, seq_col)
    kind = dict(rows.dtypes)["id"]
    texts = bucketed(rows.withColumn("digest", F.unhex(F.sha2(F.col("seq").cast("binary"), 256))), "id")
    members = texts.select("id", "digest").join(texts.groupBy("digest").agg(F.min("id").alias("rep")), "digest").select("rep", "id").checkpoint()
    one = texts.join(members.where("rep = id").select("id").distinct(), "id").select(F.struct((-F.length("seq")).alias("size"), "id").alias("id"), "seq")
    marks = one.mapInArrow(_signatures(k, words), f"word long, id struct<size: int, id: {kind}>, place long")
    open_, done = marks.select("word", F.col("id.size").alias("size"), "id.id", F.col("place").cast("int").alias("place")).checkpoint(), None
    while True:
        heads = open_.groupBy("word").agg(F.min(F.struct("size", "id", "place")).alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
        # One row a word on the right: adaptive execution splits the rows of a frequent word.
        seen = open_.join(heads, "word").checkpoint()
        reps = seen.groupBy("id").agg(F.bool_and(F.col("id") == F.col("head.id")).alias("top")).where("top").select(F.col("id").alias("query_id")).checkpoint()
        if not reps.limit(1).count():  # no word is left: of two sequences with one, the first of all is always a representative
            break
        # A path within the band spans at most 2 * band more of the one than of the other: shorter sequences cannot cover.
        long_enough = 2 * band - F.col("size") >= -min_coverage * F.col("head.size")
        pairs = seen.where((F.col("id") != F.col("head.id")) & long_enough).select(F.col("head.id").alias("query_id"), F.col("id").alias("subject_id"), (F.col("place") - F.col("head.place")).cast("long").alias("diagonal"))
        pairs = pairs.join(reps, "query_id").groupBy("query_id", "subject_id").agg(F.collect_set("diagonal").alias("diagonals"))
        pairs = pairs.join(texts.select(F.col("id").alias("query_id"), F.col("seq").alias("query_seq")), "query_id")
        # By merging, so that pairs are aligned in as many tasks as there are buckets, however few they are.
        pairs = pairs.join(texts.select(F.col("id").alias("subject_id"), F.col("seq").alias("subject_seq")).hint("merge"), "subject_id")
        fit = _statistics(aligned(pairs, None, band, coverage=min_coverage), 1).where(
            (F.col("fraction_identical_matches") >= min_identity) & (F.least("query_coverage", "subject_coverage") >= min_coverage)
        )
        fit = fit.groupBy("subject_id").agg(F.min(F.struct((-F.length("query_seq")).alias("size"), F.col("query_id").alias("id"))).alias("r"))
        now = fit.select(F.col("r.id").alias("rep"), F.col("subject_id").alias("id")).checkpoint()
        done = now if done is None else done.union(now)
        gone = now.select("id").union(reps.select(F.col("query_id").alias("id")))
        left = seen.join(reps, F.col("head.id") == F.col("query_id"), "left_anti")
        open_ = left.join(gone, "id", "left_anti").select("word", "size", "id", "place").checkpoint()
    if done is None:
        return members.select(F.col("rep").alias("cluster_rep_id"), "id")
    # Who follows nobody is a representative, at whatever time its words were closed.
    out = members.join(done.select(F.col("id").alias("rep"), F.col("rep").alias("to")), "rep", "left")
    return out.select(F.coalesce("to", "rep").alias("cluster_rep_id"), "id")

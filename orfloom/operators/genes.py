"""Gene prediction: word and start statistics of each genome, and a best chain of compatible reading frames per contig."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orfloom.functions import seq
from orfloom.operators.relational import checkpoints

#: Bases that one task holds at a time; a longer contig is a pack of its own.
PACK_BASES = 4_000_000
#: Bases whose candidates are looked at together.
BATCH_BASES = 1 << 18
#: Bases before a start that its score looks at.
UPSTREAM = 18
#: Counts that a log ratio starts from, in proportion to the background.
WORD_PRIOR, START_PRIOR = 512.0, 16.0

_CODE = np.full(256, 4, np.uint8)
for _i, _pair in enumerate(("Aa", "Cc", "Gg", "TtUu")):
    _CODE[[ord(c) for c in _pair]] = _i
CODONS = [a + b + c for a in "ACGU" for b in "ACGU" for c in "ACGU"]
_STARTS = np.array([CODONS.index(c) for c in seq.START_CODONS])
_IS_START = np.append(np.isin(np.arange(64), _STARTS), False)  # -1, an unknown codon, is the last
#: Kinds of counts: words of the chosen frames, words of all frames, start features of the chosen frames, those of all starts.
WORDS, ALL_WORDS, STARTS, ALL_STARTS = range(4)
_COUNTS = "genome_id string, kind int, i int, n long"


def best_chain(start: np.ndarray, stop: np.ndarray, gain: np.ndarray, max_overlap: int, of: np.ndarray | None = None) -> np.ndarray:
    """Indices, by place, of the frames with the largest sum of gains of which no two overlap by more than max_overlap.

    Frames are half-open and longer than max_overlap, so frames that fit their
    neighbours in the chain fit all others in it.  of names the contig of each,
    where places of several contigs follow on each other: each has its own chain.
    """
    order = np.lexsort((start, stop))
    before = np.searchsorted(stop[order], start[order] + max_overlap, side="right").tolist()
    g, n = gain[order].tolist(), len(order)
    fresh = np.append(True, np.diff(of[order]) != 0)[:n].tolist() if of is not None else [True] + [False] * n
    best, taken = [0.0] * (n + 1), [False] * n
    for j in range(n):
        if fresh[j]:
            best[j] = 0.0  # sums of a contig do not depend on those before it
        with_j = best[before[j]] + g[j]
        taken[j] = with_j > best[j]
        best[j + 1] = with_j if taken[j] else best[j]
    out, j = [], n
    while j:
        if taken[j - 1]:
            out.append(order[j - 1])
            j = before[j - 1]
        else:
            j -= 1
    return np.array(out[::-1], np.int64)


def log_ratios(own: np.ndarray, background: np.ndarray, prior: float) -> np.ndarray:
    """log of the share in own over the share in background along the last axis, drawn to 0 where own has few counts."""
    share = (background + 1) / (background + 1).sum(-1, keepdims=True)
    return np.log((own + prior * share) / (own.sum(-1, keepdims=True) + prior) / share)


class Contigs:
    """Candidates of contigs: every start with the next stop in its frame, on both strands.

    The contigs lie one after another with unknown bases between them, so that
    arrays are long however short the contigs are; of is a candidate's contig.
    """

    def __init__(self, texts: list[str], table: int, min_length: int):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.off = np.cumsum(sizes + UPSTREAM) - sizes - UPSTREAM
        own = _CODE[np.frombuffer(("?" * UPSTREAM).join(texts).encode("ascii", "replace"), np.uint8)]
        other = np.where(own < 4, 3 - own, 4)[::-1].astype(np.uint8)
        self.n, self.codons, parts = len(own), {}, []
        #: First places of the contigs by strand, in the order in which they lie on it.
        self.begin = {1: self.off, -1: (self.n - self.off - sizes)[::-1]}
        ends = np.append(np.isin(CODONS, seq.STOP_CODONS[table]), False)
        self.padded = {1: np.concatenate([np.full(UPSTREAM, 4, np.uint8), own]), -1: np.concatenate([np.full(UPSTREAM, 4, np.uint8), other])}
        for strand, s in ((1, own), (-1, other)):
            # Codons by place; an unknown base, 4, makes each of its three unknown.
            every = np.full(max(self.n - 2, 0), -1, np.int16)
            if self.n > 2:
                known = (s[:-2] < 4) & (s[1:-1] < 4) & (s[2:] < 4)
                np.copyto(every, s[:-2].astype(np.int16) * 16 + s[1:-1] * np.int16(4) + s[2:], where=known)
            for f in range(3):
                k = self.codons[strand, f] = np.ascontiguousarray(every[f::3])
                stops, starts = np.flatnonzero(ends[k]), np.flatnonzero(_IS_START[k])
                at = np.searchsorted(stops, starts)
                starts, at = starts[at < len(stops)], at[at < len(stops)]
                last = stops[at]
                contig = np.searchsorted(self.begin[strand], f + 3 * starts, side="right")
                fits = (3 * (last + 1 - starts) >= min_length) & (contig == np.searchsorted(self.begin[strand], f + 3 * last, side="right"))
                starts, last, contig = starts[fits], last[fits], contig[fits] - 1
                contig = contig if strand == 1 else len(texts) - 1 - contig
                parts.append(np.stack([np.full(len(starts), strand), np.full(len(starts), f), starts, last, contig, k[starts]]))
        self.strand, self.frame, self.first, self.last, self.of, self._codon = np.concatenate(parts, 1).astype(np.int64)
        a, b = self.frame + 3 * self.first, self.frame + 3 * self.last + 3
        self.from_ = a
        # Places among all contigs, and on the candidate's own.
        self.start_at, self.stop_at = np.where(self.strand == 1, a, self.n - b), np.where(self.strand == 1, b, self.n - a)
        self.start, self.stop = self.start_at - self.off[self.of], self.stop_at - self.off[self.of]

    def words(self, strand: int, f: int) -> np.ndarray:
        """Codon with the next codon at each place but the last; -1 where a base is unknown."""
        k = self.codons[strand, f]
        return np.where((k[:-1] < 0) | (k[1:] < 0), np.int16(-1), np.int16(64) * k[:-1] + k[1:])

    def start_features(self, which: np.ndarray) -> np.ndarray:
        """Counts by place before the start and base, then by start codon."""
        out = np.zeros(4 * UPSTREAM + 3, np.int64)
        for strand in (1, -1):
            w = which[self.strand[which] == strand]
            base = self.padded[strand][self.from_[w][:, None] + np.arange(UPSTREAM)]
            place = np.broadcast_to(np.arange(UPSTREAM), base.shape)
            out[: 4 * UPSTREAM] += np.bincount((4 * place + base)[base < 4], minlength=4 * UPSTREAM)
        out[4 * UPSTREAM :] += (self.start_codon(which)[:, None] == _STARTS).sum(0)
        return out

    def start_codon(self, which: np.ndarray) -> np.ndarray:
        return self._codon[which]

    def _totals(self, word: np.ndarray, strand: int, f: int) -> np.ndarray:
        """Running sums of word over a frame, from 0 before each contig; between contigs words are unknown and count 0."""
        values = np.append(word, 0.0)[self.words(strand, f)]
        cuts = [0, *((self.begin[strand][1:] - f) // 3 - 3).tolist(), len(values)]
        total = np.zeros(len(values) + 1)
        for a, b in zip(cuts, cuts[1:]):
            np.cumsum(values[a:b], out=total[a + 1 : b + 1])
        return total

    def scores(self, word: np.ndarray, before: np.ndarray | None = None, codon: np.ndarray | None = None) -> np.ndarray:
        """Sum of the words' log ratios from the start to the stop, and of those of the start, if given."""
        out = np.zeros(len(self.first))
        for strand, f in self.codons:
            i = np.flatnonzero((self.strand == strand) & (self.frame == f))
            if len(i):
                total = self._totals(word, strand, f)
                out[i] = total[self.last[i] - 1] - total[self.first[i]]
                if before is not None:
                    base = self.padded[strand][self.from_[i][:, None] + np.arange(UPSTREAM)]
                    out[i] += np.hstack([before, np.zeros((UPSTREAM, 1))])[np.arange(UPSTREAM), base].sum(1)
                    out[i] += codon[np.searchsorted(np.sort(_STARTS), self._codon[i])]
        return out

    def longest(self) -> np.ndarray:
        """The first start of each stop."""
        key = np.stack([self.strand, self.frame, self.last])
        return np.flatnonzero(np.append(True, (np.diff(key, axis=1) != 0).any(0))[: len(self.first)])

    def chain(self, which: np.ndarray, gain: np.ndarray, max_overlap: int) -> np.ndarray:
        """Those of the candidates that are their contigs' best chains by gain, contig by contig."""
        return which[best_chain(self.start_at[which], self.stop_at[which], gain, max_overlap, self.of[which])]

    def protein(self, i: int) -> str:
        k = self.codons[self.strand[i], self.frame[i]][self.first[i] + 1 : self.last[i]]
        return "M" + _ACIDS[k].tobytes().decode()


class Contig(Contigs):
    """Candidates of one contig."""

    def __init__(self, text: str, table: int, min_length: int):
        super().__init__([text], table, min_length)


def _batches(contigs: pa.Table, table: int, min_length: int):
    """(first row, candidates) of slices of about BATCH_BASES bases."""
    texts, first, held = contigs.column("seq").to_pylist(), 0, 0
    for i, text in enumerate(texts, 1):
        held += len(text)
        if held >= BATCH_BASES or i == len(texts):
            yield first, Contigs(texts[first:i], table, min_length)
            first, held = i, 0


_ACIDS = np.frombuffer("".join([*(dict(zip(seq.CODONS, seq.AMINO_ACIDS))[c] for c in CODONS), "X"]).encode(), np.uint8)


def _dense(rows: list, kind: int, size: int) -> np.ndarray:
    out = np.zeros(size)
    for r in rows:
        if r["kind"] == kind:
            out[r["i"]] = r["n"]
    return out


def _rows(genome, kinds: dict[int, np.ndarray]) -> pa.Table:
    parts = [(k, i, n[i]) for k, n in kinds.items() for i in np.flatnonzero(n)]
    names = [genome] * len(parts)
    cols = [pa.array(names, pa.string()), pa.array([p[0] for p in parts], pa.int32()), pa.array([int(p[1]) for p in parts], pa.int32()), pa.array([int(p[2]) for p in parts], pa.int64())]
    return pa.Table.from_arrays(cols, ["genome_id", "kind", "i", "n"])


def _count_words(table: int, train_length: int, max_overlap: int):
    def run(key, contigs):
        own, every = np.zeros(4096, np.int64), np.zeros(4096, np.int64)
        for _, c in _batches(contigs, table, train_length):
            words = {at: c.words(*at) for at in c.codons}
            for w in words.values():
                every += np.bincount(w[w >= 0], minlength=4096)
            # Of frames that share bases, those that cover most of the contig teach.
            i = c.longest()
            chosen = c.chain(i, (c.stop - c.start)[i].astype(float), max_overlap)
            for (strand, f), w in words.items():
                j = chosen[(c.strand[chosen] == strand) & (c.frame[chosen] == f)]
                w = np.concatenate([w[:0], *(w[a:b] for a, b in zip(c.first[j], c.last[j] - 1))])
                own += np.bincount(w[w >= 0], minlength=4096)
        return _rows(key[0].as_py(), {WORDS: own, ALL_WORDS: every})

    return run


def _word_scores(rows: list) -> np.ndarray:
    return log_ratios(_dense(rows, WORDS, 4096), _dense(rows, ALL_WORDS, 4096), WORD_PRIOR)


def _chosen(c: Contigs, gain: np.ndarray, max_overlap: int) -> np.ndarray:
    i = np.flatnonzero(gain > 0)
    return c.chain(i, gain[i], max_overlap)


def _count_starts(table: int, min_length: int, max_overlap: int, cost: float):
    def run(key, contigs, counts):
        word, size = _word_scores(counts.column("counts")[0].as_py()), 4 * UPSTREAM + 3
        own, every = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for _, c in _batches(contigs, table, min_length):
            own += c.start_features(_chosen(c, c.scores(word) - cost, max_overlap))
            every += c.start_features(np.arange(len(c.first)))
        return _rows(key[0].as_py(), {STARTS: own, ALL_STARTS: every})

    return run


_GENES = pa.schema(
    [(n, pa.string()) for n in ("genome_id", "contig_id", "gene_id")] + [("start", pa.int64()), ("stop", pa.int64()), ("strand", pa.int32()), ("start_codon", pa.string()), ("score", pa.float64()), ("seq", pa.string())]
)


def start_scores(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Log ratios by place before the start and base, and by start codon in the order of their numbers."""
    own, every = _dense(rows, STARTS, 4 * UPSTREAM + 3), _dense(rows, ALL_STARTS, 4 * UPSTREAM + 3)
    cut = 4 * UPSTREAM
    codon = log_ratios(own[cut:], every[cut:], START_PRIOR)
    return log_ratios(own[:cut].reshape(-1, 4), every[:cut].reshape(-1, 4), START_PRIOR), codon[np.argsort(_STARTS)]


def _predict(table: int, min_length: int, max_overlap: int, cost: float):
    def run(key, contigs, counts):
        rows, out = counts.column("counts")[0].as_py(), []
        word, (before, codon) = _word_scores(rows), start_scores(rows)
        names = contigs.column("contig_id").to_pylist()
        for first, c in _batches(contigs, table, min_length):
            score, n, of = c.scores(word, before, codon), 0, -1
            for i in _chosen(c, score - cost, max_overlap):
                n, of = (n + 1 if c.of[i] == of else 1), c.of[i]
                name = names[first + of]
                out.append((key[0].as_py(), name, f"{name}_{n}", int(c.start[i]) + 1, int(c.stop[i]), int(c.strand[i]), CODONS[c._codon[i]], float(score[i]), c.protein(i)))
        return pa.Table.from_pylist([dict(zip(_GENES.names, r)) for r in out], _GENES)

    return run


def predict_genes(contigs: DataFrame, table: int = 11, min_length: int = 90, max_overlap: int = 60, train_length: int = 300, cost: float = 8.0) -> DataFrame:
    """genome_id, contig_id, gene_id, start, stop (1-based, inclusive), strand, start_codon, score and seq (protein) of the genes in contigs (genome_id, contig_id, seq).

    Each genome teaches its own statistics: words of two codons in its long open
    frames (at least train_length bases, those that cover most of a contig)
    against all six frames; then the start codons and the bases before them in
    the frames that these words choose, against all starts.  A candidate's score
    is the sum of its log ratios; a gene costs ``cost``, and a contig's genes are
    the chain with the largest sum of which no two overlap by more than
    max_overlap bases (less than min_length).  Lengths include the stop.  Only
    whole genes are found: a frame without a start or a stop on its contig is none.

    Contigs of a genome are dealt to packs of about PACK_BASES, so a large genome
    is many tasks; only counts (at most 8,342 numbers a genome) travel between
    passes.  One contig is one task's work, at about 60 bytes of memory a base;
    short ones are looked at together, about BATCH_BASES at a time.
    Rows without genome_id, contig_id or seq, and contigs that are too short,
    give nothing; unknown bases end no frame and have no score, and are X in the
    protein.  Repeated contigs are each counted and each give their genes.
    Columns beyond the three are dropped.
    """
    if not 0 <= max_overlap < min_length:
        raise ValueError("max_overlap must be less than min_length")
    checkpoints(contigs.sparkSession)
    # Written once: sizes and packs both read the contigs, and making their bases may take longer than reading them.
    own = contigs.select(F.col("genome_id").cast("string").alias("genome_id"), F.col("contig_id").cast("string").alias("contig_id"), "seq").na.drop().checkpoint()
    sizes = own.groupBy("genome_id").agg(F.ceil(F.sum(F.length("seq")) / PACK_BASES).cast("int").alias("_n")).withColumn("_n", F.greatest("_n", F.lit(1)))
    own = own.join(sizes, "genome_id").select("genome_id", F.pmod(F.xxhash64("contig_id"), F.col("_n")).cast("int").alias("pack"), "contig_id", "seq")
    # Other names than those of the contigs: both sides of a cogroup come from the same rows.
    packs = sizes.select(F.col("genome_id").alias("genome"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("part"))

    def table_of(counts: DataFrame) -> DataFrame:
        each = counts.groupBy(F.col("genome_id").alias("genome"), "kind", "i").agg(F.sum("n").alias("n"))
        return each.groupBy("genome").agg(F.collect_list(F.struct("kind", "i", "n")).alias("counts"))

    def meet(counts: DataFrame, run, schema: str) -> DataFrame:
        # Packs without contigs, or of genomes without any word, have nothing to choose from.
        guarded = lambda key, a, b: run(key, a, b) if a.num_rows and b.num_rows else _empty(schema)
        return own.groupBy("genome_id", "pack").cogroup(packs.join(counts, "genome").groupBy("genome", "part")).applyInArrow(guarded, schema)

    words = table_of(own.groupBy("genome_id", "pack").applyInArrow(_count_words(table, train_length, max_overlap), _COUNTS))
    starts = meet(words, _count_starts(table, min_length, max_overlap, cost), _COUNTS)
    genes = "genome_id string, contig_id string, gene_id string, start long, stop long, strand int, start_codon string, score double, seq string"
    both = words.join(table_of(starts).withColumnRenamed("counts", "_starts"), "genome", "left")
    both = both.select("genome", F.concat("counts", F.coalesce("_starts", F.array().cast(both.schema["counts"].dataType))).alias("counts"))
    return meet(both, _predict(table, min_length, max_overlap, cost), genes)


def _empty(schema: str) -> pa.Table:
    return _GENES.empty_table() if "gene_id" in schema else _rows("", {})

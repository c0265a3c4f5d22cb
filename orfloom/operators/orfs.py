"""Open reading frames of contigs, and sequences of hits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orfloom.functions import seq
from orfloom.operators import genes


#: Residues that a batch of frames holds at least before it is given.
BATCH_RESIDUES = 4 << 20


def _acids(table: int) -> np.ndarray:
    """Letters of the codons by their numbers; an unknown codon, -1, is the last."""
    by = {c: ("Y" if table == 14 and c == "UAA" else a) for c, a in zip(seq.CODONS, seq.AMINO_ACIDS)}
    return np.frombuffer("".join([*(by[c] for c in genes.CODONS), "X"]).encode(), np.uint8)


def _frames(min_length: int, table: int):
    acids = _acids(table)

    def of(text: str) -> list[tuple]:
        """(number, start, stop, strand, protein) of one contig's frames."""
        # Only letters beyond ASCII can change their number.
        c = genes.Contig(text if text.isascii() else text.upper(), table, 0)
        n, a, b = len(text), c.from_, c.from_ + 3 * (c.last + 1 - c.first)
        start, stop = np.where(c.strand == 1, a + 1, n - b + 1), np.where(c.strand == 1, b, n - a)
        number = np.empty(len(a), np.int64)
        number[np.lexsort((stop, start, -c.strand))] = np.arange(len(a))
        letters = {key: acids[k] for key, k in c.codons.items()}
        out = []
        for i in np.flatnonzero(b - a >= 3 * (min_length + 1)):
            body = letters[c.strand[i], c.frame[i]][c.first[i] + 1 : c.last[i]].tobytes()
            if b"*" not in body:  # a stop codon that is none of the table's stops
                out.append((int(number[i]), int(start[i]), int(stop[i]), int(c.strand[i]), "M" + body.decode()))
        return out

    def given(ids: list, rows: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)] if rows else [pa.array([], kind) for kind in kinds]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *columns], ["contig_id", "number", "start", "stop", "strand", "seq"])

    def rows(batches):
        for batch in batches:
            ids, found, held = [batch.column("contig_id")[:0]], [], 0
            for i in range(batch.num_rows):
                own = of(batch.column("seq")[i].as_py())
                ids.append(batch.column("contig_id").take(pa.array(np.full(len(own), i))))
                found += own
                held += sum(len(x[-1]) for x in own)
                if held >= BATCH_RESIDUES:
                    yield given(ids, found)
                    ids, found, held = ids[:1], [], 0
            yield given(ids, found)

    return rows


def find_orfs(contigs: DataFrame, min_length: int = 50, table: int = 11) -> DataFrame:
    """contig_id, orf_id, start, stop (1-based, inclusive), strand, seq (protein) of all valid reading frames.

    A frame that translates ends at the first stop after its start, so each
    start is paired with the next in-frame stop only.  Ids count all frames of
    a contig by strand and place, before the length filter.  Contig ids are
    unique.  A contig's frames are its own, so nothing is shuffled: a batch of
    contigs goes to a batch of frames.
    """
    own = contigs.select("contig_id", "seq").where("contig_id is not null and seq is not null")
    kind = dict(own.dtypes)["contig_id"]
    out = own.mapInArrow(_frames(min_length, table), f"contig_id {kind}, number long, start int, stop int, strand int, seq string")
    return out.select("contig_id", F.concat("contig_id", F.lit("_ORF_"), F.col("number").cast("string")).alias("orf_id"), "start", "stop", "strand", "seq")


def hit_sequences(hits: DataFrame, contigs: DataFrame, prefix: str, upstream: int = 27, keys: dict[str, str] | None = None) -> DataFrame:
    """hits with {prefix}_nt_seq and {prefix}_nt_seq_upstream (the upstream bases and the start codon).

    keys names, for each key column of contigs, the column of hits that it must
    equal; by default genome_id, if contigs has it, and contig_id.  Features that are not coding give ``none``; a start that is cut off gives ``partial``.
    """
    keys = keys or {c: c for c in ("genome_id", "contig_id") if c in contigs.columns}
    c = contigs.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.upper("seq").alias("_s"))
    out = hits.join(c, [F.col(own) == F.col(f"_key{i}") for i, own in enumerate(keys.values())], "left")
    a, b, forward = F.col(f"{prefix}_start") - 1, F.col(f"{prefix}_stop"), F.col(f"{prefix}_strand") == 1
    own = lambda x, y: F.when(forward, F.translate(seq.subsequence(F.col("_s"), x, y), "T", "U")).otherwise(seq.reverse_complement(seq.subsequence(F.col("_s"), x, y)))
    coding = F.coalesce(F.col(f"{prefix}_feature") == "CDS", F.lit(False)) if f"{prefix}_feature" in hits.columns else F.lit(True)
    cut = F.lit(False)
    if f"{prefix}_partial" in hits.columns:
        cut = F.coalesce(F.when(forward, F.substring(f"{prefix}_partial", 1, 1)).otherwise(F.substring(f"{prefix}_partial", 2, 1)) == "1", F.lit(False))
    before = F.when(forward, own(a - upstream, a + 3)).otherwise(own(b - 3, b + upstream))
    return out.withColumns(
        {f"{prefix}_nt_seq": F.when(coding, own(a, b)).otherwise("none"), f"{prefix}_nt_seq_upstream": F.when(~coding, "none").when(cut, "partial").otherwise(before)}
    ).drop(*[f"_key{i}" for i in range(len(keys))], "_s")

"""Genome comparison: predicted genes against annotated features, over all genomes at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orfloom.functions.align import align
from orfloom.operators import overlap, tophit
from orfloom.operators.orfs import hit_sequences


def compare(
    queries: DataFrame, features: DataFrame, contigs: DataFrame | None = None, keys: tuple[str, ...] = ("genome_id", "contig_id"),
    max_overlap: int = 0,
) -> DataFrame:
    """One row for each query: its best hit, alignment, sequence identity and category.

    queries: keys, id, start, stop, strand, seq.  features: keys, ord, feature,
    start, stop, strand, pseudo, codon_start, product, evidence_type, seq.
    contigs: keys, seq.  Contigs of different genomes may have one name.  One
    plan for all genomes; Python runs only for the alignment of best hits.
    """
    subjects = features.withColumn("id", F.col("ord"))
    hits = overlap.hit_columns(overlap.overlap_join(queries, subjects, list(keys)))
    own = queries.select([F.col(c).alias(f"query_{c}") for c in queries.columns])
    best = tophit.top_hits(hits, own)
    x = align(F.col("query_seq"), F.col("top_hit_seq"))
    best = best.withColumn("_x", x).select("*", "_x.*").drop("_x").withColumn("sequence_identity", F.coalesce(F.try_divide("n_matches", "alignment_length"), F.lit(0.0)))
    best = tophit.annotate(best, max_overlap)
    if contigs is not None:
        best = hit_sequences(best, contigs, "query", keys={k: f"query_{k}" for k in keys})
    return tophit.fill_sentinels(best)

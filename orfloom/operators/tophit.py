"""Best hit of each query, its category, and predicates on hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _yes(x: Column) -> Column:
    """Two-valued: what cannot be decided is false."""
    return F.coalesce(x, F.lit(False))


def is_unsupported(prefix: str = "top_hit") -> Column:
    return _yes((F.col(f"{prefix}_product") == "hypothetical protein") & (F.col(f"{prefix}_evidence_type") == "ab initio prediction"))


def top_hits(hits: DataFrame, queries: DataFrame, supported: Column | None = None, order: str = "subject_ord") -> DataFrame:
    """One row for each query (query_id): counts of its hits, and the best as top_hit_*.

    Best: in frame, then supported, then the longest overlap, then the first by
    ``order``.  Queries without a hit have counts of 0 and null top hits
    (fill_sentinels gives the textual defaults).  One aggregation, no window:
    the best row is a maximum, so it combines before the shuffle.
    """
    ok = ~is_unsupported("subject") if supported is None else _yes(supported)
    h = hits.withColumn("_ok", ok)
    own = [c for c in hits.columns if c not in queries.columns]
    key = F.struct(F.col("in_frame"), F.col("_ok"), F.col("overlap_length"), (-F.col(order)).alias("_o"))
    best = h.groupBy("query_id").agg(
        F.count("*").alias("n_hits"), F.count_if("_ok").alias("n_hits_supported"), F.count_if("same_strand").alias("n_hits_same_strand"),
        F.count_if(~F.col("same_strand")).alias("n_hits_opposite_strand"), F.count_if("in_frame").alias("n_hits_in_frame"),
        F.max_by(F.struct(*own), key).alias("_best"),
    )
    counts = ["n_hits", "n_hits_supported", "n_hits_same_strand", "n_hits_opposite_strand", "n_hits_in_frame"]
    best = best.select("query_id", *counts, *[F.col(f"_best.{c}").alias(c.replace("subject_", "top_hit_", 1) if c.startswith("subject_") else c) for c in own])
    q = queries.select("query_id", *[c for c in queries.columns if c != "query_id" and c not in best.columns])
    return q.join(best, "query_id", "left").na.fill(0, counts)


def fill_sentinels(df: DataFrame) -> DataFrame:
    """Nulls by type: text ``none``, boolean false, numbers 0."""
    value = {"string": "none", "boolean": False}
    return df.na.fill({c: value.get(t, 0) for c, t in df.dtypes if t in value or t in ("int", "bigint", "double", "float", "smallint")})


def is_pseudogene(max_overlap: int = 0, prefix: str = "top_hit") -> Column:
    return _yes(F.col(f"{prefix}_pseudo") & F.col("same_strand") & (F.col("overlap_length") >= max_overlap))


def is_match(min_identity: float = 0.8, max_overlap: int = 0, prefix: str = "top_hit") -> Column:
    p = (F.col(f"{prefix}_feature") == "CDS") & ~_yes(F.col(f"{prefix}_pseudo")) & F.col("in_frame")
    return _yes(p & (F.col("sequence_identity") > min_identity) & (F.col("overlap_length") >= max_overlap))


def is_intergenic(max_overlap: int = 0, prefix: str = "top_hit") -> Column:
    feature = F.coalesce(F.col(f"{prefix}_feature"), F.lit("none"))
    near = (feature == "none") | ((feature == "CDS") & _yes(F.col("overlap_length") < max_overlap))
    return near & ~is_match(prefix=prefix) & ~is_pseudogene(prefix=prefix)


def annotate(df: DataFrame, max_overlap: int = 0, prefix: str = "top_hit") -> DataFrame:
    """df with match, pseudogene, intergenic, conflict, and category, the first of them that holds; every row gets one."""
    match, pseudo = is_match(max_overlap=max_overlap, prefix=prefix), is_pseudogene(max_overlap, prefix)
    between = is_intergenic(max_overlap, prefix)
    category = F.when(match, "match").when(pseudo, "pseudogene").when(between, "intergenic").otherwise("conflict")
    return df.withColumns({"match": match, "pseudogene": pseudo, "intergenic": between, "conflict": ~match & ~pseudo & ~between, "category": category})


def terminal_changes(df: DataFrame, prefix: str = "top_hit", seq: str = "seq") -> DataFrame:
    """df with length, {prefix}_length (residues; a null or ``none`` sequence has 0) and exact_match, truncated, extended.

    The flags hold for matches only (column ``match``), and not for programmed frameshifts.
    """
    residues = lambda c: F.when(F.coalesce(F.col(c), F.lit("none")) == "none", 0).otherwise(F.length(c))
    hit = f"{prefix}_ribosomal_slippage"
    steady = _yes(F.col("match")) & (~_yes(F.col(hit)) if hit in df.columns else F.lit(True))
    df = df.withColumns({"length": residues(seq), f"{prefix}_length": residues(f"{prefix}_seq")})
    change = F.col(f"{prefix}_length") - F.col("length")
    return df.withColumns({"exact_match": steady & (change == 0), "truncated": steady & (change > 0), "extended": steady & (change < 0)})


def two_sided_label(real: Column, spurious: Column, real_threshold: float = 0.8, spurious_threshold: float = 0.95) -> Column:
    """real, spurious or uncertain; both thresholds are strict, and real comes first."""
    return F.when(_yes(real > real_threshold), "real").when(_yes(spurious > spurious_threshold), "spurious").otherwise("uncertain")

"""Predicates and measures on a query and its top hit: kinds of conflict, termini, shared hits, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orfloom.operators.tophit import _yes


def conflict_kinds(prefix: str = "top_hit") -> dict[str, Column]:
    """Kinds of a conflict by name; all are false where ``conflict`` is not true."""
    conflict, pseudo = _yes(F.col("conflict")), _yes(F.col(f"{prefix}_pseudo"))
    coding = _yes(F.col(f"{prefix}_feature") == "CDS")
    cds = conflict & coding & ~pseudo
    whole = _yes(F.col(f"{prefix}_overlap") == "11") | _yes(F.col("query_overlap") == "11")
    return {
        "cds_conflict": cds,
        "antiparallel_conflict": cds & _yes(F.col("overlap_type").isin("convergent", "divergent")),
        "tandem_conflict": cds & _yes(F.col("overlap_type") == "tandem"),
        "hypothetical_conflict": conflict & _yes(F.col(f"{prefix}_product") == "hypothetical protein"),
        "non_coding_conflict": conflict & (pseudo | ~coding),
        "nested_conflict": cds & whole,
    }


def annotated(matched: Column, prefix: str = "top_hit") -> Column:
    """Whether a (whole or exact) match has a named product that is known from a similar protein."""
    named = _yes(F.col(f"{prefix}_product") != "hypothetical protein") & ~_yes(F.col(f"{prefix}_pseudo"))
    return matched & named & _yes(F.col(f"{prefix}_evidence_type") == "similar to AA sequence")


def end_shifts(prefix: str = "top_hit") -> dict[str, Column]:
    """Nucleotides by which the query goes beyond the hit at its 5' and 3' end; negative where it ends before."""
    left, right = F.col(f"{prefix}_start") - F.col("query_start"), F.col("query_stop") - F.col(f"{prefix}_stop")
    ahead = F.col("query_strand") == 1
    return {"five_prime_shift": F.when(ahead, left).otherwise(right), "three_prime_shift": F.when(ahead, right).otherwise(left)}


def end_changes(prefix: str = "top_hit") -> dict[str, Column]:
    """Extension and truncation of each end, by name."""
    out = {}
    for end, shift in end_shifts(prefix).items():
        out |= {end.replace("shift", "extension"): _yes(shift > 0), end.replace("shift", "truncation"): _yes(shift < 0)}
    return out


def terminal_extension(terminus: str, prefix: str = "top_hit") -> Column:
    """Residues by which a match that is not exact goes beyond the hit at its ``n`` or ``c`` terminus, else 0."""
    shift = end_shifts(prefix)["five_prime_shift" if terminus == "n" else "three_prime_shift"]
    return F.when(_yes(F.col("match")) & ~_yes(F.col("exact_match")) & (shift > 0), shift / 3).otherwise(F.lit(0.0))


def overlap_terminus(overlap: Column, strand: Column) -> Column:
    """``n`` or ``c`` where only that terminus lies in the other interval, else null."""
    first, last = F.when(strand == 1, "n").otherwise("c"), F.when(strand == 1, "c").otherwise("n")
    return F.when(overlap == "10", first).when(overlap == "01", last)


def coding_bounds(prefix: str) -> dict[str, Column]:
    """start and stop of the whole codons: past the codon offset, without an incomplete last codon."""
    shift = F.coalesce(F.col(f"{prefix}_codon_start").cast("long"), F.lit(1)) - 1
    ahead = F.col(f"{prefix}_strand") == 1
    start, stop = F.col(f"{prefix}_start") + F.when(ahead, shift).otherwise(0), F.col(f"{prefix}_stop") - F.when(ahead, 0).otherwise(shift)
    rest = (stop - start + 1) % 3
    return {f"{prefix}_start": start + F.when(ahead, 0).otherwise(rest), f"{prefix}_stop": stop - F.when(ahead, rest).otherwise(0)}


def adjusted_overlap(overlap: Column, residues: Column) -> Column:
    """Nucleotides of an overlap that stay when so many residues go at the overlapping end."""
    return F.greatest(overlap - 3 * residues, F.lit(0))


def nested_pairs(df: DataFrame, fields: list[str]) -> DataFrame:
    """Nested CDS conflicts as parent_* (the longer one) and daughter_* columns, overlap_length and same_strand."""
    rows = df.where(conflict_kinds()["cds_conflict"] & (F.col("overlap_type") == "nested"))
    inner = F.col("query_length") < F.col("top_hit_length")
    pick = lambda a, b, f: F.when(inner, F.col(f"{a}_{f}")).otherwise(F.col(f"{b}_{f}"))
    both = [c for f in fields for c in (pick("top_hit", "query", f).alias(f"parent_{f}"), pick("query", "top_hit", f).alias(f"daughter_{f}"))]
    return rows.select("query_id", *both, "overlap_length", "same_strand")


def shared_hits(pairs: DataFrame, hits: DataFrame, min_bit_score: float = 50, min_identity: float = 0.8) -> DataFrame:
    """pairs (query_id, top_hit_id, ...) with shared_hit: the subject that both hit with the largest summed identity, or null.

    hits: id, subject_id, bit_score, percent_identity; a pair of id and subject
    counts with its best-scoring segment; ties go to the largest subject id.
    """
    good = hits.where((F.col("bit_score") > min_bit_score) & (F.col("percent_identity") > min_identity))
    best = good.groupBy("id", "subject_id").agg(F.max_by("percent_identity", F.struct("bit_score", "percent_identity")).alias("identity"))
    side = lambda name: best.select(F.col("id").alias(name), "subject_id", F.col("identity").alias(f"{name}_identity"))
    keys = pairs.select("query_id", "top_hit_id").distinct()
    both = keys.join(side("query_id"), "query_id").join(side("top_hit_id"), ["top_hit_id", "subject_id"])
    pick = F.max_by("subject_id", F.struct(F.col("query_id_identity") + F.col("top_hit_id_identity"), "subject_id"))
    return pairs.join(both.groupBy("query_id", "top_hit_id").agg(pick.alias("shared_hit")), ["query_id", "top_hit_id"], "left")


def alternate_stops(hits: DataFrame, min_identity: float = 0.8, min_length: int = 30, near: int = 3) -> DataFrame:
    """(id, stops): the whole length of each id and the shorter lengths at which its hits end.

    A hit counts that starts at an N-terminus (less than ``near`` in either
    sequence), reaches its subject's C-terminus, is identical enough and leaves
    more than ``min_length`` residues.
    """
    start = (F.col("subject_alignment_start") < near) | (F.col("query_alignment_start") < near)
    whole = (F.col("subject_length") - F.col("subject_alignment_stop") < near) & (F.col("percent_identity") > min_identity)
    stop = F.when(start & whole & (F.col("query_alignment_stop") < F.col("query_length")) & (F.col("query_alignment_stop") > min_length), F.col("query_alignment_stop"))
    return hits.groupBy("id").agg(F.concat(F.array(F.max("query_length")), F.sort_array(F.collect_set(stop), asc=False)).alias("stops"))


def keyword_category(text: Column, rules: list[tuple[str, str]], default: str = "none") -> Column:
    """The category of the first rule (pattern, category) whose pattern a text holds, in any case."""
    out = None
    for pattern, category in rules:
        hit = _yes(F.rlike(text, F.lit(f"(?i){pattern}")))
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return F.lit(default) if out is None else out.otherwise(default)


def replace_values(value: Column, table: dict[str, str]) -> Column:
    """value by a table of replacements; others stay."""
    if not table:
        return value
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value), value)


def without_genomes(df: DataFrame, ids: list[str], column: str = "genome_id") -> DataFrame:
    """df without the rows of the genomes named; null ids stay."""
    return df.where(~_yes(F.col(column).isin(list(ids)))) if ids else df


def original_values(df: DataFrame, columns: list[str], id_col: str = "id", is_original: Column | None = None) -> DataFrame:
    """df with original_* columns: those of the id's unchanged row (truncation_length 0), null without one."""
    own = (F.col("truncation_length") == 0) if is_original is None else is_original
    base = df.where(own).groupBy(id_col).agg(F.min(F.struct(*columns)).alias("_o"))
    return df.join(base, id_col, "left").select("*", *[F.col(f"_o.{c}").alias(f"original_{c}") for c in columns]).drop("_o")


def family_table(df: DataFrame, family: str = "product", label: str = "model_label", ignore_uncertain: bool = False) -> DataFrame:
    """Per family: size, singleton, n_real, n_spurious, n_uncertain, homogeneity."""
    n = {f"n_{x}": F.count_if(F.col(label) == x) for x in ("real", "spurious", "uncertain")}
    good = n["n_real"] + n["n_uncertain"] if ignore_uncertain else n["n_real"]
    return df.groupBy(family).agg(F.count("*").alias("size"), (F.count("*") == 1).alias("singleton"), *[c.alias(k) for k, c in n.items()], (good / F.count("*")).alias("homogeneity"))


def mixed_families(table: DataFrame, min_size: int = 10) -> DataFrame:
    """Families of more than min_size rows, not all real, some spurious; the largest first."""
    return table.where((F.col("size") > min_size) & (F.col("homogeneity") < 1) & (F.col("n_spurious") > 0)).orderBy(F.desc("size"), table.columns[0])


def genome_summary(df: DataFrame, flags: list[str], genome: str = "genome_id", first: tuple[str, ...] = ()) -> DataFrame:
    """Per genome and, with a null genome and ``total`` true, over all: size, n_{flag} and {flag}_share of each flag.

    ``first`` names columns that have one value in each genome (null in the total).
    """
    counts = [F.count_if(F.col(f)).alias(f"n_{f}") for f in flags]
    own = [F.when(F.grouping(genome) == 0, F.min(c)).alias(c) for c in first]
    t = df.rollup(genome).agg((F.grouping(genome) == 1).alias("total"), *own, F.count("*").alias("size"), *counts)
    return t.withColumns({f"{f}_share": F.try_divide(f"n_{f}", "size") for f in flags})


def same_label_histogram(edges: DataFrame, vertices: DataFrame, label: str = "label") -> DataFrame:
    """(label, n_same, n): how many vertices of each label have so many neighbours of their own label."""
    v = vertices.select("id", F.col(label).alias("_l"))
    e = edges.where("src <> dst").join(v.select(F.col("id").alias("dst"), F.col("_l").alias("_d")), "dst")
    n = v.join(e.select(F.col("src").alias("id"), "_d"), "id", "left").groupBy("id", "_l").agg(F.count_if(F.col("_d") == F.col("_l")).alias("n_same"))
    return n.groupBy(F.col("_l").alias("label"), "n_same").agg(F.count("*").alias("n"))


def sample_rows(df: DataFrame, n: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """n rows without replacement, the same for a seed whatever the order of rows."""
    return df.orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(n)


def concat_datasets(*dfs: DataFrame, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The ids and vectors of several datasets; what else they hold is left out."""
    out = dfs[0].select(id_col, vector_col)
    for df in dfs[1:]:
        out = out.unionByName(df.select(id_col, vector_col))
    return out


def window_counts(df: DataFrame, key: str, value: str, delta: float) -> DataFrame:
    """df with n_near: rows of its key whose value is at most delta away, itself included."""
    w = Window.partitionBy(key).orderBy(value).rangeBetween(-delta, delta)
    return df.withColumn("n_near", F.count("*").over(w))

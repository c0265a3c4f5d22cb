"""Interval overlap joins and what two overlapping intervals have to do with each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has_overlap(q0: Column, q1: Column, s0: Column, s1: Column) -> Column:
    """Bounds are inclusive: touching at one position is an overlap."""
    return (q0 <= s1) & (s0 <= q1)


def overlap_type(q0, q1, s0, s1, q_strand, s_strand) -> Column:
    inside = lambda x: (x >= s0) & (x <= s1)
    front = F.when(q_strand == 1, inside(q1)).otherwise(inside(q0))
    return (
        F.when(~has_overlap(q0, q1, s0, s1), "none")
        .when(((q0 >= s0) & (q1 <= s1)) | ((q0 <= s0) & (q1 >= s1)), "nested")
        .when(q_strand == s_strand, "tandem")
        .when(front, "convergent")
        .otherwise("divergent")
    )


def translation_start(start: Column, stop: Column, strand: Column, codon_start: Column | None = None) -> Column:
    shift = F.lit(0) if codon_start is None else F.coalesce(codon_start.cast("int"), F.lit(1)) - 1
    return F.when(strand == -1, stop - shift).otherwise(start + shift)


#: Positions in the smallest bins of the interval joins, levels of bins, and how much wider each level's are.
BIN_WIDTH, LEVELS, FACTOR = 1024, 14, 4


def _wide(level: Column, width: int) -> Column:
    """Positions in the bins of a level."""
    return F.element_at(F.array(*[F.lit(width * FACTOR**k) for k in range(LEVELS)]), level + 1)


def _own_level(start: str, stop: str, width: int) -> Column:
    """The lowest level whose bins are as wide as an interval is long, so it touches at most two of them."""
    size = F.col(stop) - F.col(start) + 1
    return F.coalesce(*[F.when(size <= width * FACTOR**k, k) for k in range(LEVELS - 1)], F.lit(LEVELS - 1))


def _bins(df: DataFrame, start: str, stop: str, width: int, up: str | None, levels: list[int] | range = range(LEVELS)) -> DataFrame:
    """df with a row for each of its bins: at its own level, or at those of ``levels`` above it ("above"), or from it on ("from").

    Rows go by levels, not by length.
    """
    own = _own_level(start, stop, width)
    if up is None:
        df = df.withColumn("_level", own)
    else:
        df = df.withColumn("_own", own)
        keep = lambda k: (k > F.col("_own")) if up == "above" else (k >= F.col("_own"))
        df = df.withColumn("_level", F.explode(F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), keep))).drop("_own")
    wide = _wide(F.col("_level"), width)
    return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / wide), F.floor(F.col(stop) / wide))))


def nested_join(left: DataFrame, right: DataFrame, a: tuple[str, str], b: tuple[str, str], on: list[Column], width: int) -> DataFrame:
    """Pairs of rows whose intervals (columns a of left, b of right) overlap and for which all of ``on`` holds.

    Of two overlapping intervals the one of the lower level meets the other in
    the bins of the other's level; a pair is kept in the first bin that both
    touch, so it is found once.  A side goes to those higher levels only that the
    other side's intervals have, which are looked up first (at most LEVELS numbers).
    """
    left, right = (df.where(F.col(x).isNotNull() & F.col(y).isNotNull()) for df, (x, y) in ((left, a), (right, b)))
    own = _own_level(*a, width), _own_level(*b, width)
    in_left, in_right = ([r[0] for r in df.select(level).distinct().collect()] for df, level in zip((left, right), own))
    low = lambda df, level, least: df.where(level >= least)
    sides = [
        (_bins(left, *a, width, "from", in_right), _bins(low(right, own[1], min(in_left, default=LEVELS)), *b, width, None)),
        (_bins(low(left, own[0], min(in_right, default=LEVELS) + 1), *a, width, None), _bins(right, *b, width, "above", in_left)),
    ]
    out = []
    for x, y in sides:
        y = y.withColumnsRenamed({"_level": "_level2", "_bin": "_bin2"})
        first = F.floor(F.greatest(a[0], b[0]) / _wide(F.col("_level"), width))
        same = (F.col("_level") == F.col("_level2")) & (F.col("_bin") == F.col("_bin2")) & (F.col("_bin") == first)
        pairs = x.join(y, [*on, same, has_overlap(F.col(a[0]), F.col(a[1]), F.col(b[0]), F.col(b[1]))])
        out.append(pairs.drop("_level", "_level2", "_bin", "_bin2"))
    return out[0].union(out[1])


def overlap_join(queries: DataFrame, subjects: DataFrame, keys: list[str], bin_width: int | None = BIN_WIDTH, how: str = "inner") -> DataFrame:
    """Pairs of rows with equal keys whose [start, stop] overlap; columns become query_* and subject_*.

    Intervals join on their keys and on nested bins, the smallest of bin_width
    positions, which splits a key with very many rows; an interval over a whole
    contig is a few rows.  Without bin_width the keys alone are the equi-join.
    Queries without a hit stay with how="left".
    """
    q = queries.select([F.col(c).alias(f"query_{c}") for c in queries.columns])
    s = subjects.select([F.col(c).alias(f"subject_{c}") for c in subjects.columns])
    on = [F.col(f"query_{k}") == F.col(f"subject_{k}") for k in keys]
    q_ends, s_ends = ("query_start", "query_stop"), ("subject_start", "subject_stop")
    if bin_width is None:
        return q.join(s, [*on, has_overlap(*map(F.col, (*q_ends, *s_ends)))], how)
    hits = nested_join(q, s, q_ends, s_ends, on, bin_width)
    if how == "inner":
        return hits
    names = [f"query_{c}" for c in queries.columns]
    rest = q.join(hits.select(*[F.col(n).alias(f"_{n}") for n in names]), [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names], "left_anti")
    return hits.unionByName(rest, allowMissingColumns=True)


def hit_columns(hits: DataFrame) -> DataFrame:
    """Lengths, strand, overlap, fractions, ends, phase and frame of each hit.

    phase is null, and in_frame false, unless the subject is a CDS that is not
    pseudo (subjects without a ``feature`` column count as CDS).
    """
    c = F.col
    q0, q1, s0, s1 = c("query_start"), c("query_stop"), c("subject_start"), c("subject_stop")
    inside = lambda x, a, b: F.when((x >= a) & (x <= b), "1").otherwise("0")
    coding = F.lit(True)
    if "subject_feature" in hits.columns:
        coding = coding & F.coalesce(c("subject_feature") == "CDS", F.lit(False))
    if "subject_pseudo" in hits.columns:
        coding = coding & ~F.coalesce(c("subject_pseudo"), F.lit(False))
    shift = c("subject_codon_start") if "subject_codon_start" in hits.columns else None
    phase = F.abs(translation_start(q0, q1, c("query_strand")) - translation_start(s0, s1, c("subject_strand"), shift)) % 3
    out = hits.withColumns(
        {
            "query_length": q1 - q0 + 1, "subject_length": s1 - s0 + 1, "same_strand": c("query_strand") == c("subject_strand"),
            "overlap_start": F.greatest(q0, s0), "overlap_stop": F.least(q1, s1), "overlap_length": F.least(q1, s1) - F.greatest(q0, s0) + 1,
            "overlap_type": overlap_type(q0, q1, s0, s1, c("query_strand"), c("subject_strand")),
            "exact_match": (q0 == s0) & (q1 == s1),
            "query_overlap": F.concat(inside(q0, s0, s1), inside(q1, s0, s1)), "subject_overlap": F.concat(inside(s0, q0, q1), inside(s1, q0, q1)),
            "phase": F.when(coding, phase).cast("int"),
        }
    )
    return out.withColumns(
        {
            "query_overlap_fraction": F.try_divide("overlap_length", "query_length"),
            "subject_overlap_fraction": F.try_divide("overlap_length", "subject_length"),
            "in_frame": F.coalesce((c("phase") == 0) & c("same_strand"), F.lit(False)),
        }
    )


def near_pairs(df: DataFrame, keys: list[str], id_col: str, max_separation: int, bin_width: int = BIN_WIDTH) -> DataFrame:
    """Ordered pairs of different rows of a key that overlap or lie less than max_separation apart.

    With their stops moved by max_separation - 1, such rows overlap, and so meet in a bin.
    """
    reach = F.greatest(F.col("stop") + max_separation - 1, "start")
    side = lambda p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns], reach.alias(f"_{p}_reach"))
    separation = F.greatest("a_start", "b_start") - F.least("a_stop", "b_stop")
    on = [*[F.col(f"a_{k}") == F.col(f"b_{k}") for k in keys], F.col(f"a_{id_col}") != F.col(f"b_{id_col}"), separation < max_separation]
    out = nested_join(side("a"), side("b"), ("a_start", "_a_reach"), ("b_start", "_b_reach"), on, bin_width).drop("_a_reach", "_b_reach")
    return out.withColumns({"separation_length": separation, "overlap_length": F.greatest(1 - separation, F.lit(0)), "phase": (F.abs(F.col("a_start") - F.col("b_start")) % 3).cast("int")})

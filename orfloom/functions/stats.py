"""Statistics: contingency tables, rank tests, regression, distributions, binned windows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chi_square(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """(statistic, dof, p_value) against the counts that the marginals give; dof is cells - 1."""
    cells = df.groupBy(rows, columns).agg(F.count("*").alias("o"))
    all_rows, all_columns = df.groupBy(rows).agg(F.count("*").alias("r")), df.groupBy(columns).agg(F.count("*").alias("c"))
    total = df.agg(F.count("*").alias("n"))
    # Categories, not rows: the product has as many rows as the table has cells.
    full = all_rows.join(all_columns).join(total).join(cells, [rows, columns], "left").na.fill(0, ["o"])
    expected = F.col("r") * F.col("c") / F.col("n")
    return _with_tail(full.agg(F.sum((F.col("o") - expected) ** 2 / expected).alias("statistic"), (F.count("*") - 1).alias("dof")))


def chi_square_fixed(df: DataFrame, category: str, frequencies: dict) -> DataFrame:
    """(statistic, dof, p_value) of a column's counts against fixed frequencies of its values, which need not sum to one.

    Values without a frequency take no part.
    """
    total = sum(frequencies.values())
    names = list(frequencies)
    share = F.create_map(*[F.lit(x) for k in names for x in (k, frequencies[k] / total)])
    counts = df.where(F.col(category).isin(names)).agg(F.count("*").alias("n"), *[F.count_if(F.col(category) == k).alias(f"c{i}") for i, k in enumerate(names)])
    off = sum((F.col(f"c{i}") - F.col("n") * F.try_element_at(share, F.lit(k))) ** 2 / (F.col("n") * F.try_element_at(share, F.lit(k))) for i, k in enumerate(names))
    return _with_tail(counts.select(F.when(F.col("n") > 0, off).alias("statistic"), F.lit(len(names) - 1).cast("long").alias("dof")))


def _with_tail(df: DataFrame) -> DataFrame:
    @F.pandas_udf("double")
    def tail(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else chi_square_tail(v, n) for v, n in zip(x, k)], dtype="float64")

    return df.withColumn("p_value", tail("statistic", "dof"))


def chi_square_tail(x: float, dof: int) -> float:
    """P(X >= x) of a chi-square variable: the upper incomplete gamma function by series or continued fraction."""
    a, z = dof / 2, x / 2
    if z <= 0 or a <= 0:
        return 1.0
    scale = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-15 * abs(total):
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - total * scale)
    b, c = z + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b or 1e-300)
        c = b + k / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, scale * h)


#: Cells that a column's values are dealt to before anything is ordered.
CELLS = 256


def value_cells(df: DataFrame, value: str) -> Column:
    """Which of about CELLS ranges with about equally many rows a number lies in: ranges come in order."""
    ends = sorted({x for x in df.approxQuantile(value, [i / CELLS for i in range(1, CELLS)], 1 / (4 * CELLS)) if x is not None})
    at = F.size(F.filter(F.array(*[F.lit(float(x)) for x in ends]), lambda x: x <= F.col(value).cast("double"))) if ends else F.lit(0)
    return at.cast("int")


def running(df: DataFrame, value: str, count: str) -> DataFrame:
    """df, one row a value, with upto: the sum of counts up to it.  Sums of ranges first, then within each range."""
    cells = df.withColumn("_cell", value_cells(df, value))
    base = cells.groupBy("_cell").agg(F.sum(count).alias("_n"))
    base = base.select("_cell", (F.sum("_n").over(Window.orderBy("_cell")) - F.col("_n")).alias("_before"))  # at most CELLS rows
    inner = Window.partitionBy("_cell").orderBy(value)
    return cells.join(F.broadcast(base), "_cell").withColumn("upto", F.col("_before") + F.sum(count).over(inner)).drop("_cell", "_before")


def mann_whitney(df: DataFrame, value: str, group: str, n_permutations: int | None = 100, id_col: str | None = None, seed: int = 42) -> DataFrame:
    """(n1, n2, u1, p_value) of group 1 against group 0, two-sided.

    p_value is the share of n_permutations shuffles of the rows whose statistic
    is at least as far from the shuffles' median; with None it is the normal
    approximation with tie and continuity corrections.  Shuffles order rows by a
    seeded hash of id_col (without one, of the rows' places, which a new reading
    may change).  Equal values are one row of counts before anything is ordered.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(group).isin(0, 1)).select(
        F.col(value).cast("double").alias("v"), (F.col(group) == 1).cast("long").alias("one"), (F.monotonically_increasing_id() if id_col is None else F.col(id_col)).alias("key")
    )
    ties = rows.groupBy("v").agg(F.count("*").alias("t"), F.sum("one").alias("t1"))
    ranked = running(ties, "v", "t").withColumn("rank", F.col("upto") - F.col("t") + (F.col("t") + 1) / 2)
    out = ranked.agg(F.sum("t1").alias("n1"), F.sum(F.col("t") - F.col("t1")).alias("n2"), F.sum(F.col("rank") * F.col("t1")).alias("r1"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("tie"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    out = out.withColumn("u1", F.col("r1") - n1 * (n1 + 1) / 2)
    if n_permutations is None:
        spread = F.sqrt(F.try_divide(n1 * n2, F.lit(12.0)) * (n + 1 - F.try_divide(F.col("tie"), n * (n - 1))))
        z = F.try_divide(F.greatest(F.abs(F.col("u1") - n1 * n2 / 2) - 0.5, F.lit(0.0)), spread)

        @F.pandas_udf("double")
        def tail(x: pd.Series) -> pd.Series:
            return pd.Series([None if pd.isna(v) else math.erfc(v / math.sqrt(2)) for v in x], dtype="float64")

        return out.select("n1", "n2", "u1", tail(z).alias("p_value"))
    size = out.select(F.col("n1").alias("_n1"))
    sums = _shuffled_sums(rows.join(ranked.select("v", "rank"), "v").select("key", "rank"), size, n_permutations, seed)
    u = F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2
    each = sums.join(F.broadcast(out)).select("n1", "n2", "u1", u.alias("u"))
    middle = each.agg(F.median("u").alias("m"))
    far = F.abs(F.col("u") - F.col("m")) >= F.abs(F.col("u1") - F.col("m"))
    return each.join(F.broadcast(middle)).groupBy("n1", "n2", "u1").agg(F.avg(far.cast("double")).alias("p_value"))


def _shuffled_sums(rows: DataFrame, size: DataFrame, n: int, seed: int) -> DataFrame:
    """(p, r): for each of n shuffles of rows (key, rank), the sum of the first _n1 ranks.

    The first rows are found by sums over 4096 ranges of the hash; only the range
    that holds the last of them is ordered.
    """
    each = rows.withColumn("p", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("h", F.xxhash64("key", "p", F.lit(seed)))
    each = each.withColumn("b", F.shiftright("h", 52))
    cells = each.groupBy("p", "b").agg(F.count("*").alias("c"), F.sum("rank").alias("s"))
    upto = F.sum("c").over(Window.partitionBy("p").orderBy("b"))
    cells = cells.withColumn("before", upto - F.col("c")).join(F.broadcast(size)).withColumn("need", F.col("_n1") - F.col("before"))
    whole = cells.where(F.col("need") >= F.col("c")).groupBy("p").agg(F.sum("s").alias("r"))
    last = cells.where((F.col("need") > 0) & (F.col("need") < F.col("c"))).select("p", "b", "need")
    place = F.row_number().over(Window.partitionBy("p").orderBy("h", "key"))
    part = each.join(F.broadcast(last), ["p", "b"]).withColumn("_k", place).where(F.col("_k") <= F.col("need")).groupBy("p").agg(F.sum("rank").alias("r"))
    return whole.union(part).groupBy("p").agg(F.sum("r").alias("r"))


def linear_fit(y: str, x: str) -> list[Column]:
    return [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.corr(y, x).alias("r")]


def partial_r2(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """R^2 of x and y after z is regressed out of both: from the three correlations."""
    xy, xz, yz = F.corr(x, y), F.corr(x, z), F.corr(y, z)
    r = df.agg(xy.alias("xy"), xz.alias("xz"), yz.alias("yz"))
    return r.select(F.try_divide(F.pow(F.col("xy") - F.col("xz") * F.col("yz"), F.lit(2)), (1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2)).alias("partial_r2"))


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """(value, ecdf) for each distinct number; ranges of values are ordered by themselves."""
    n = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    total = n.agg(F.sum("c").alias("_all"))
    return running(n, value, "c").join(F.broadcast(total)).select(value, (F.col("upto") / F.col("_all")).alias("ecdf"))


def kde(df: DataFrame, value: str, points: list[float], bandwidth: float) -> DataFrame:
    """(point, density): Gaussian kernel density of a column at the points; equal values are one row first."""
    n = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    at = n.withColumn("point", F.explode(F.array(*[F.lit(float(p)) for p in points])))
    z = (F.col("v") - F.col("point")) / bandwidth
    out = at.groupBy("point").agg(F.sum(F.col("c") * F.exp(-z * z / 2)).alias("s"), F.sum("c").alias("n"))
    return out.select("point", (F.col("s") / (F.col("n") * bandwidth * math.sqrt(2 * math.pi))).alias("density"))


def sliding_bins(df: DataFrame, value: str, start: float, stop: float, step: float, delta: float, *aggregates: Column, inclusive: bool = False) -> DataFrame:
    """Aggregates over rows with |value - center| < delta (<= with inclusive), for each grid point.

    A row is sent to the few grid points whose window can hold it: no product of grid and rows.
    """
    first = F.greatest(F.ceil((F.col(value) - delta - start) / step), F.lit(0)).cast("int")
    last = F.least(F.floor((F.col(value) + delta - start) / step), F.lit(int(round((stop - start) / step)))).cast("int")
    points = df.where(F.col(value).isNotNull()).withColumn("_a", first).withColumn("_b", last).where("_a <= _b")
    points = points.withColumn("_g", F.explode(F.sequence("_a", "_b"))).withColumn("center", F.col("_g") * F.lit(step) + F.lit(start))
    off = F.abs(F.col(value) - F.col("center"))
    return points.where(off <= delta if inclusive else off < delta).groupBy("center").agg(*aggregates)


def rate(condition: Column) -> Column:
    """Share of rows, 0 for none."""
    return F.coalesce(F.try_divide(F.count_if(condition), F.count("*")), F.lit(0.0))


def rates(df: DataFrame, parts: list[str], whole: str) -> DataFrame:
    """df with {part}_rate columns: each part over the whole, null where that is zero."""
    return df.withColumns({f"{c}_rate": F.try_divide(c, whole) for c in parts})


def standard_error(value: str) -> Column:
    return F.try_divide(F.stddev_samp(value), F.sqrt(F.count(value)))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Binary confusion counts with balanced accuracy, precision and recall (0 where undefined)."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    c = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    over = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0))
    return c.withColumns({"precision": over("tp", "fp"), "recall": over("tp", "fn")}).withColumn("balanced_accuracy", (F.col("recall") + over("tn", "fp")) / 2)


def threshold_sweep(df: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """Counts, precision and recall at each threshold: each row goes to one step, counts are then summed from above."""
    step = sum((F.col(score) > t).cast("int") for t in thresholds)
    n = df.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("p"))
    grid = df.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(sorted(thresholds))], "at int, threshold double")
    total = n.agg(F.sum("p").alias("positives"))
    got = grid.join(n, n["step"] >= grid["at"], "left").groupBy("threshold").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("predicted"), F.coalesce(F.sum("p"), F.lit(0)).alias("tp"))
    return got.join(total).select(
        "threshold", "predicted", "tp", F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide("tp", "positives"), F.lit(0.0)).alias("recall")
    )

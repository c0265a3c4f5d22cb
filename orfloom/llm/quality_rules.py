"""Quality rules with adaptive thresholds from mergeable quantile sketches.

A sketch is a histogram over logarithmic buckets of non-negative integers
(values below 32 exactly, else 16 buckets to each power of two, an error below
1/16).  Sketches merge by adding counts, so one pass gives those of each
(language, source), and their sums those of each language and of everything; a
group of fewer than ``min_group`` texts uses the next larger one.  A metric's
limits are its median plus or minus ``SPREADS`` interquartile ranges and a
slack; the texts are then joined with their group's limits.

DataFrame and SQL functions only.  A sketch has at most a few hundred rows a
metric and group; counting is partial before it shuffles, and a hot source is
one group of counts like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orfloom.llm import scratch

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Fewest words, and the largest percentage of words in repeated 3-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Interquartile ranges between the median and a limit.
SPREADS = 4
#: Texts that a group needs for limits of its own, and groups whose limits may be broadcast (about 400 bytes each).
MIN_GROUP, BROADCAST_GROUPS = 100, 50_000
#: metric: (slack, whether there is a lower limit too)
METRICS = {
    "symbols": (100, False),  # symbols in 1000 words
    "dup_lines": (300, False),  # repeated lines in 1000 lines with a word
    "repeats": (400, False),  # words in repeated windows in 1000 words
    "upper": (200, False),  # letters A-Z in 1000 characters of words
    "word_length": (150, True),  # characters in 100 words
}


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(w: Column) -> Column:
    """Words of an array that lie in a 3-word window found twice or more in it."""
    n = F.size(w)
    grams = F.transform(
        F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
    )
    again = lambda g: F.transform(F.filter(g, lambda x, k: (x.h == F.get(g, k - 1).h) | (x.h == F.get(g, k + 1).h)), lambda x: x.i)
    steps = lambda p: F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
    return _let(F.sort_array(grams), lambda g: _let(F.sort_array(again(g)), lambda p: F.aggregate(steps(p), F.lit(0), lambda a, x: a + x)))


def base_metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_text_lines, n_upper (long)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.struct("*").alias("row"), text.alias("t"))
    counts = _let(F.regexp_extract_all("t", F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    lines = _let(
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        lambda own: F.struct(F.size(own).alias("n"), F.size(F.array_distinct(own)).alias("d")),
    )
    out = out.select("row", "t", counts.alias("words"), lines.alias("own"))
    return out.select(
        "row", F.col("words.n").cast("long").alias("n_words"),
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.col("own.n") - F.col("own.d")).cast("long").alias("n_dup_lines"),
        F.col("words.r").cast("long").alias("n_repeat_words"),
        F.col("own.n").cast("long").alias("n_text_lines"),
        F.regexp_count("t", F.lit("[A-Z]")).cast("long").alias("n_upper"),
    )


def metric_columns() -> dict[str, Column]:
    per = lambda k, a, b: F.floor(F.lit(k) * F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return {
        "symbols": per(1000, "n_symbols", "n_words"),
        "dup_lines": per(1000, "n_dup_lines", "n_text_lines"),
        "repeats": per(1000, "n_repeat_words", "n_words"),
        "upper": per(1000, "n_upper", "word_chars"),
        "word_length": per(100, "word_chars", "n_words"),
    }


def bucket(v: Column) -> Column:
    """The sketch's bucket of a value, named by its least value."""
    shift = F.length(F.bin(v)) - 5
    return F.when(v < 32, v).otherwise(F.expr("1L") * F.floor(v / F.pow(F.lit(2.0), shift)) * F.pow(F.lit(2.0), shift)).cast("long")


def sketches(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, bucket, c): the quantile sketches of each group of keys."""
    long = metrics.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("bucket")) for m in METRICS])).alias("x"))
    return long.groupBy(*keys, "x.metric", "x.bucket").agg(F.count("*").alias("c"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches summed over the keys that are left out."""
    return sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("c").alias("c"))


def limits(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, n, low, high) from sketches."""
    group = Window.partitionBy(*keys, "metric")
    ranked = sketch.withColumn("upto", F.sum("c").over(group.orderBy("bucket"))).withColumn("n", F.sum("c").over(group))
    quantile = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("n"), F.col("bucket")))
    q = ranked.groupBy(*keys, "metric").agg(F.max("n").alias("n"), quantile(1).alias("q1"), quantile(2).alias("q2"), quantile(3).alias("q3"))
    slack = F.coalesce(*[F.when(F.col("metric") == m, s) for m, (s, _) in METRICS.items()])
    reach = SPREADS * (F.col("q3") - F.col("q1")) + slack
    two = F.col("metric").isin([m for m, (_, low) in METRICS.items() if low])
    return q.select(*keys, "metric", "n", F.when(two, F.col("q2") - reach).otherwise(F.lit(-1)).alias("low"), (F.col("q2") + reach).alias("high"))


def apply_rules(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_group: int = MIN_GROUP, columns: list[str] | None = None
) -> DataFrame:
    """The columns of docs (all, unless ``columns`` names some) with the base metrics, base_failed and kept.

    base_failed: fewer than MIN_WORDS words, or over MAX_REPEAT_PERCENT percent
    of the words in 3-word windows that the text repeats.  kept: not base_failed
    and every metric within its group's limits, which come from all texts that
    did not fail.  A null text is empty (and fails); null languages and sources
    form groups like any other; repeated rows count each; an empty table gives
    an empty result.  Columns of docs that are named like new ones are replaced.
    The metrics are computed once and written with the columns asked for; the
    limits are fitted on that table and joined with it.
    """
    base = base_metrics(docs, text_col)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    base = base.withColumn("base_failed", failed).withColumns(metric_columns())
    base = base.withColumn("lang_", F.col("row").getField(lang_col)).withColumn("source_", F.col("row").getField(source_col))
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    names = [c for c in columns or docs.columns if c not in (*added, "kept")]
    own = F.struct(*[F.col("row").getField(c).alias(c) for c in names]) if names else F.struct(F.lit(0))
    base = scratch.table(base.select(own.alias("row"), *added, *METRICS, "lang_", "source_"), "metrics")
    fine = sketches(base.where("not base_failed"), ["lang_", "source_"])
    wide = lambda t, keys, name: t.groupBy(*keys).agg(
        F.max("n").alias(f"{name}_n"), F.map_from_entries(F.collect_list(F.struct("metric", F.struct("low", "high")))).alias(name)
    )
    own = wide(limits(fine, ["lang_", "source_"]), ["lang_", "source_"], "own")
    per_lang = wide(limits(merged(fine, ["lang_"]), ["lang_"]), ["lang_"], "per_lang")
    every = wide(limits(merged(fine, []), []), [], "every")
    table = own.join(per_lang, own["lang_"].eqNullSafe(per_lang["lang_"])).drop(per_lang["lang_"]).join(every)
    chosen = F.when(F.col("own_n") >= min_group, F.col("own")).when(F.col("per_lang_n") >= min_group, F.col("per_lang")).otherwise(F.col("every"))
    table = scratch.table(table.select(F.col("lang_").alias("l"), F.col("source_").alias("s"), chosen.alias("limit")), "limits")
    if table.count() <= BROADCAST_GROUPS:  # then no text is shuffled, and a hot source is in no one task
        table = F.broadcast(table)
    out = base.join(table, base["lang_"].eqNullSafe(table["l"]) & base["source_"].eqNullSafe(table["s"]), "left")
    inside = F.lit(True)
    for m in METRICS:
        at = F.col("limit").getItem(m)
        inside = inside & (F.col(m) >= at["low"]) & (F.col(m) <= at["high"])
    return out.select(*[F.col("row").getField(c).alias(c) for c in names], *added, (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"))

"""Line dedup: a suffix array over line-id sequences, by distributed prefix doubling.

Texts are sequences of line ids (128 hash bits of each line that has a word).
Level j ranks the suffixes by their first 2**j lines: the distinct pairs of
level j - 1 ranks are sorted over range partitions and numbered in that order,
so ranks compare as the runs do.  Suffixes of one rank are the
longest-common-prefix interval of depth 2**j; a run of m lines, 2**j <= m <
2**(j + 1), is named by the ranks of the two runs of 2**j lines that cover it,
which gives the intervals of depth m.  The first suffix of an interval (smallest
text, then line) is the copy that stays.  What is unique leaves, so each level
works on fewer rows, and the doubling ends at the longest run that decides.

A run counts from ``min_lines`` lines and ``min_chars`` characters in words on.
Every such run is the union of its shortest counting runs from each of its lines
forwards and backwards, and whether those repeat depends on their own lines
alone; so testing the shortest ones finds the lines of all maximal repeated
runs, however long.

A rank that holds a large share of the suffixes is joined by broadcast (at most
HOT_KEYS rows), the others by shuffle.  DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orfloom.llm import scratch

WORD = r"[^\x20\x09-\x0D]"
_SPACES = " \t\n\x0b\x0c\r"
#: A repeated run counts from so many lines and characters in words on.
MIN_LINES, MIN_CHARS = 1, 16
#: Keys that are joined by broadcast: those with a share of 1 / HOT_KEYS of the rows.
HOT_KEYS = 1024


def _doc(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """What identifies and orders a text: its id (null last; as a string unless it is an integer), then its hash."""
    own = F.col(id_col)
    own = F.coalesce(own.cast("long"), F.lit(0)) if isinstance(docs.schema[id_col].dataType, T.IntegralType) else F.coalesce(own.cast("string"), F.lit(""))
    return F.struct(F.col(id_col).isNull().alias("none"), own.alias("id"), F.xxhash64(text_col).alias("h"))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shortest(sizes: Column, i: Column, n: int, least: int, chars: int, back: bool) -> Column:
    """Lines of the shortest counting run from line i (from 0) on, or up to it; null if the text ends before."""
    own = F.slice(sizes, F.greatest(i + 2 - n, F.lit(1)), F.least(i + 1, F.lit(n))) if back else F.slice(sizes, i + 1, F.lit(n))
    own = F.reverse(own) if back else own
    step = lambda a, x: F.when((a.c >= chars) & (a.n >= least), a).otherwise(F.struct((a.n + 1).alias("n"), (a.c + x).alias("c")))
    done = lambda a: F.when((a.c >= chars) & (a.n >= least), a.n)
    counted = F.aggregate(own, F.struct(F.lit(0).alias("n"), F.lit(0).alias("c")), step, done)
    return F.when(F.get(sizes, i) >= chars, F.lit(1)).otherwise(counted) if least == 1 else counted


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, seq, a, b, ahead, back, deep): the lines with a word.

    a and b are the line's id; ahead and back the lines of the shortest counting
    runs from it on and up to it; deep marks lines that runs of several lines may need.
    """
    most = max(min_lines, min_chars)
    size = lambda x: F.length(F.translate(x, _SPACES, ""))

    def each(own: Column, sizes: Column, short: Column) -> Column:
        near = lambda i: F.exists(F.slice(sizes, F.greatest(i + 2 - most, F.lit(1)), 2 * most - 1), lambda x: x < min_chars)
        run = lambda i, back: F.when(~short, F.lit(1)).otherwise(_shortest(sizes, i, most, min_lines, min_chars, back))
        return F.transform(own, lambda x, i: F.struct(
            F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), run(i, False).alias("ahead"), run(i, True).alias("back"),
            (short & (F.lit(min_lines > 1) | near(i))).alias("deep"),
        ))

    has_short = lambda sizes: F.lit(min_lines > 1) | F.exists(sizes, lambda x: x < min_chars)
    lines = _let(
        F.filter(F.split(text_col, "\n"), lambda x: x.rlike(WORD)),
        lambda own: _let(F.transform(own, size), lambda sizes: _let(has_short(sizes), lambda short: each(own, sizes, short))),
    )
    return docs.select(_doc(docs, id_col, text_col).alias("doc"), F.posexplode(lines).alias("seq", "x")).select("doc", "seq", "x.*")


def _here() -> Column:
    return F.struct("doc", "seq")


def _ranks(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, rank, first, n): ranks in the order of the keys, of those that several places share."""
    groups = rows.groupBy(*keys).agg(F.min(_here()).alias("first"), F.max(_here()).alias("last"), F.count("*").alias("n"))
    groups = groups.where("first <> last").drop("last")
    return scratch.table(groups.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()), name)


def _ranked(rows: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
    """rows with their rank and first; those without one leave."""
    total = ranks.agg(F.sum("n")).first()[0] or 0
    ranks, hot = ranks.where(F.col("n") * HOT_KEYS < total).drop("n"), F.broadcast(ranks.where(F.col("n") * HOT_KEYS >= total).drop("n"))
    return rows.join(hot, keys).unionByName(rows.join(hot, keys, "left_anti").join(ranks, keys))


def _windows(lines: DataFrame) -> DataFrame:
    """(doc, seq, n_lines): the shortest counting runs."""
    both = F.array(F.struct(F.col("seq").alias("s"), F.col("ahead").alias("n")), F.struct((F.col("seq") + 1 - F.col("back")).alias("s"), F.col("back").alias("n")))
    each = lines.where("ahead <> 1 or back <> 1 or ahead is null or back is null").select("doc", F.explode(both).alias("x"))
    return each.select("doc", F.col("x.s").alias("seq"), F.col("x.n").alias("n_lines")).where("n_lines > 1")


def repeated_runs(lines: DataFrame) -> DataFrame:
    """(doc, seq, n_lines): the maximal runs of lines that belong to later copies."""
    ranks = _ranks(lines, ["a", "b"], "ranks1")
    active = scratch.table(_ranked(lines, ranks, ["a", "b"]).select("doc", "seq", "ahead", "back", "deep", "rank", "first").distinct(), "level1")
    later = active.where((F.col("ahead") == 1) | (F.col("back") == 1)).where(_here() != F.col("first")).select("doc", "seq", F.lit(1).alias("n_lines"))
    wanted = scratch.table(_windows(active).distinct(), "windows")
    longest = wanted.agg(F.max("n_lines")).first()[0] or 1
    active, half = active.where("deep").select("doc", "seq", "rank", "first"), 1
    while 2 * half <= longest:
        ahead = Window.partitionBy("doc").orderBy("seq").rangeBetween(half, half)
        pairs = active.select("doc", "seq", F.col("rank").alias("a"), F.first("rank").over(ahead).alias("b")).where("b is not null")
        half *= 2
        ranks = _ranks(pairs, ["a", "b"], f"ranks{half}")
        active = scratch.table(_ranked(pairs, ranks, ["a", "b"]).select("doc", "seq", "rank", "first"), f"level{half}")
        own = wanted.where(F.col("n_lines").between(half, 2 * half - 1)).withColumn("end", F.col("seq") + F.col("n_lines") - half)
        own = own.join(active, ["doc", "seq"]).withColumnRenamed("rank", "a")
        later = later.union(own.where((F.col("n_lines") == half) & (_here() != F.col("first"))).select("doc", "seq", "n_lines"))
        end = active.select("doc", F.col("seq").alias("end"), F.col("rank").alias("b"))
        own = scratch.table(own.where(F.col("n_lines") > half).drop("first").join(end, ["doc", "end"]).select("doc", "seq", "n_lines", "a", "b"), f"windows{half}")
        keys = ["n_lines", "a", "b"]
        later = later.union(_ranked(own, _ranks(own, keys, f"intervals{half}"), keys).where(_here() != F.col("first")).select("doc", "seq", "n_lines"))
    lines_of = later.select("doc", F.explode(F.sequence("seq", F.col("seq") + F.col("n_lines") - 1)).alias("seq")).distinct()
    island = F.col("seq") - F.row_number().over(Window.partitionBy("doc").orderBy("seq"))
    return lines_of.withColumn("island", island).groupBy("doc", "island").agg(F.min("seq").alias("seq"), F.count("*").cast("int").alias("n_lines")).drop("island")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """All columns of docs, text without the lines of later copies, and n_lines, n_removed.

    A run of lines (of those with a word) is a later copy if the same run occurs
    earlier: in a text with a smaller id, or earlier in the same text.  Runs
    count that have ``min_lines`` lines and ``min_chars`` characters in words.
    Blank lines stay.  A null text stays null with 0 lines; a null id counts as
    the largest; ids that are not integers compare as strings; texts with one id
    come in the order of their hashes, and rows with one id and one text are one
    text, so they keep or lose the same lines.  An empty table gives an empty
    result.  Other columns pass through; those named n_lines or n_removed are
    replaced.
    """
    lines = scratch.table(line_table(docs, id_col, text_col, min_lines, min_chars), "lines")
    gone = repeated_runs(lines).groupBy("doc").agg(F.flatten(F.collect_list(F.sequence("seq", F.col("seq") + F.col("n_lines") - 1))).alias("gone"))
    out = docs.select(F.struct("*").alias("row"), _doc(docs, id_col, text_col).alias("doc")).join(gone, "doc", "left")
    text = F.col("row").getField(text_col)
    # Each value that a lambda looks into is bound by a lambda itself: computed once a text, not once a line.
    wordy = lambda own: F.filter(F.transform(own, lambda x, i: F.when(x.rlike(WORD), i)), lambda i: i.isNotNull())
    dropped = lambda own: _let(wordy(own), lambda w: F.transform("gone", lambda s: F.get(w, s)))
    kept = lambda own: _let(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), dropped(own)), lambda left: F.transform(left, lambda i: F.get(own, i)))
    new = F.when(F.col("gone").isNull(), text).otherwise(_let(F.split(text, "\n"), lambda own: F.array_join(kept(own), "\n")))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(
        *[(new if c == text_col else F.col("row").getField(c)).alias(c) for c in names],
        F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )

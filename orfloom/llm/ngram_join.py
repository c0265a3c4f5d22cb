"""N-gram Jaccard join: exact links between shingle sets, by set relations.

How it works, for "two sets link when 100 * |A & B| >= T * |A | B|":

* Equal sets are one node.  Copies never meet in pairs.
* A node's tokens are ordered by (frequency class, hash).  Its *prefix* is all
  but the last floor(S * n / 100), with S = T - (100 - T) / 2.  Two linked sets
  share at least ceil((T - S) * n / 100) prefix tokens, n the larger size: of
  the larger set's tokens at most floor(S * n / 100) lie beyond its prefix.
  Nodes with fewer prefix tokens that occur in another node's prefix have no
  links and leave (index-level skipping of whole sets).
* Of the nodes that stay, tokens that occur in one set only are counted off: a
  set with more of them than it may lack leaves.  The index prefix is the n -
  ceil(T * n / 100) + 1 rarest tokens; two linked sets share one of them.
* *Answer-level relations*: a node's reference is the set with the fewest once
  tokens in its MinHash buckets (followed to that set's own), so near copies of
  one text have one reference R.  X is kept as its difference D(X) to R, and
  |X ^ Y| = |D(X)| + |D(Y)| - 2 |D(X) & D(Y)|.  Nodes that link to R answer for
  each other; any other link within R's nodes needs common *differences*, and
  how many follows from |D| alone.  So these nodes are indexed by the rarest of
  their differences, never by what all near copies share, and most leave: what
  their differences have in common with any other node is too little.
* *Block-skip index*, for nodes of different references: posting lists hold one
  entry per (token, reference), in blocks of size classes; the join's keys skip
  blocks whose sizes differ too much, and entries whose positions together
  exceed the differences that linked sets may have: a pair is found at the first
  token that it shares.  What is left is looked up in the nodes' own entries.

Nodes and tokens are 64-bit hashes; chance of any two of a billion sets sharing
an id is about three in a hundred.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orfloom.llm import scratch
from orfloom.llm.components import components
from orfloom.llm.sketches import HEAVY_BITS, bitmap, heavy_slots, in_bitmap
from orfloom.llm.textops import chunks, lean, mix, shingle_hashes, split_words, whole_hash

#: MinHash buckets in which references are looked for.
REFERENCE_ROUNDS = 3
#: Times that a reference is replaced by its own.
REFERENCE_JUMPS = 2
#: A set that differs more from its reference (Jaccard distance) is its own.
FARTHEST = 0.75

_SALT = np.uint64(0xD6E8FEB86659FD93)


def _texts(batch: pa.RecordBatch) -> list:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _sets(texts: list, shingle: int, lower: bool, size: int = 1 << 20):
    """(first text, text of each token, token) per chunk: the sorted, distinct shingles of each text."""
    for first, part in chunks(texts, size):
        w = split_words(part, lower)
        h, ok = shingle_hashes(w, shingle)
        n = np.diff(w.bound)
        d = np.repeat(np.arange(len(part)), n)[ok]
        h = h[ok]
        short = [i for i in range(len(part)) if 0 < n[i] < shingle]
        if short:
            d = np.concatenate([d, short])
            h = np.concatenate([h, np.array([whole_hash(w.hash[w.bound[i] : w.bound[i + 1]]) for i in short], np.uint64)])
        at = np.lexsort((h, d))
        d, h = d[at], h[at]
        if len(h):
            new = np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])])
            d, h = d[new], h[new]
        yield first, len(part), d, h


def _set_ids(d: np.ndarray, h: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(size of each text's set, id of the set): a hash of the set's members in any order."""
    n = np.bincount(d, minlength=count).astype(np.int64)
    total = np.zeros(count, np.uint64)
    np.add.at(total, d, mix(h ^ _SALT))
    return n, mix(total + n.astype(np.uint64))


def prefix_lengths(n, threshold: int):
    """(tokens in the prefix, fewest prefix tokens that linked sets share) of sets of size n."""
    keep = 2 * threshold - (100 - threshold)  # 2 * S
    return n - (keep * n) // 200, np.maximum(1, -((-(2 * threshold - keep) * n) // 200))


def _index_rows(shingle: int, threshold: int, lower: bool, heavy):
    def rows(batches):
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column("id")
            for first, count, d, h in _sets(_texts(batch), shingle, lower):
                n, sid = _set_ids(d, h, count)
                at = np.lexsort((h, heavy.value[(h >> np.uint64(64 - HEAVY_BITS)).astype(np.int64)], d))
                h = h[at].view(np.int64)
                p, _ = prefix_lengths(n, threshold)
                begin = np.concatenate([[0], np.cumsum(n)])
                prefix: list = []
                for i in range(count):
                    if n[i] and int(sid[i]) not in seen:
                        if len(seen) < 200_000:
                            seen.add(int(sid[i]))
                        prefix.append(h[begin[i] : begin[i] + p[i]])
                    else:
                        prefix.append(None)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, count), pa.array(sid.view(np.int64)), pa.array(n), pa.array(prefix, pa.list_(pa.int64()))],
                    ["id", "sid", "n", "prefix"],
                )

    return rows


def _set_rows(shingle: int, lower: bool, wanted):
    """The whole sets of wanted nodes, with their MinHash keys; copies within a task once."""

    def rows(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, count, d, h in _sets(_texts(batch), shingle, lower):
                n, sid = _set_ids(d, h, count)
                begin = np.concatenate([[0], np.cumsum(n)])
                out = []
                for i in np.flatnonzero((n > 0) & in_bitmap(wanted.value, sid.view(np.int64))):
                    if int(sid[i]) in seen:
                        continue
                    if len(seen) < 200_000:
                        seen.add(int(sid[i]))
                    own = h[begin[i] : begin[i + 1]]
                    keys = [int(mix(own + np.uint64(7919 * (r + 1))).min().view(np.int64)) for r in range(REFERENCE_ROUNDS)]
                    out.append((int(sid[i : i + 1].view(np.int64)[0]), int(n[i]), own.tobytes(), keys))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary()), pa.array([x[3] for x in out], pa.list_(pa.int64()))],
                        ["sid", "n", "toks", "keys"],
                    )

    return rows


def _candidate_rows(shared, step: float):
    """(sid, need, tok): prefix tokens that may occur elsewhere, of nodes with enough of them."""

    def rows(batches):
        for batch in batches:
            prefix = batch.column("prefix")
            size = np.diff(prefix.offsets.to_numpy())
            tok = prefix.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), size)
            hit = in_bitmap(shared.value, tok.view(np.uint64))
            need = np.maximum(1, np.ceil(batch.column("n").to_numpy() * step - 1e-9)).astype(np.int64)
            hit &= (np.bincount(row[hit], minlength=batch.num_rows) >= need)[row]
            row = row[hit]
            yield pa.RecordBatch.from_arrays([batch.column("sid").take(pa.array(row)), pa.array(need[row]), pa.array(tok[hit])], ["sid", "need", "tok"])

    return rows


def _token_rows(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            raw = b"".join(batch.column("toks").slice(a, 256).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw, np.int64))], ["tok"])


def _ranked_rows(threshold: int, shared, heavy):
    """Sets with their index prefix: rarest tokens first, those that occur once counted but left out.

    A set with more such tokens than it may lack has no links and leaves.
    """

    def rows(batches):
        for batch in batches:
            keep, prefix, skipped = [], [], []
            for i, raw in enumerate(batch.column("toks").to_pylist()):
                h = np.frombuffer(raw, np.uint64)
                own = h[in_bitmap(shared.value, h)]
                lack = len(h) - -(-threshold * len(h) // 100)
                once = len(h) - len(own)
                if once > lack:
                    continue
                own = own[np.lexsort((own, heavy.value[(own >> np.uint64(64 - HEAVY_BITS)).astype(np.int64)]))][: lack + 1 - once]
                keep.append(i)
                prefix.append(own.view(np.int64))
                skipped.append(once)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in ("sid", "n", "toks", "keys")), pa.array(prefix, pa.list_(pa.int64())), pa.array(skipped, pa.int64())],
                ["sid", "n", "toks", "keys", "prefix", "skipped"],
            )

    return rows


@F.pandas_udf(T.LongType())
def _overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    """Common members of two sets, each the bytes of its sorted 64-bit tokens."""
    return pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(a, b)], dtype="int64")


def _compared(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """pairs(a, b) with linked, from the whole sets."""
    left = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("toks").alias("ta"))
    right = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("toks").alias("tb"))
    return (
        pairs.join(left, "a").join(right, "b")
        .withColumn("o", _overlap("ta", "tb"))
        .withColumn("u", F.col("na") + F.col("nb") - F.col("o"))
        .select("a", "b", (100 * F.col("o") >= threshold * F.col("u")).alias("linked"))
    )


def _difference_rows(threshold: int):
    """(sid, ref, linked, d, need, diff): how a set differs from its reference.

    A link that matters (not one between two sets that link to the reference)
    needs ``need`` differences in common, and at least one: with N the sizes'
    sum, linked sets differ in at most (100 - T) / (100 + T) * N tokens, and in
    at most (100 - T) / T * n whatever the other's size.
    """

    def rows(batches):
        low, high = 100 - threshold, 100 + threshold
        for batch in batches:
            out: list = [[], [], [], [], [], []]
            columns = (batch.column(c).to_pylist() for c in ("sid", "ref", "toks", "ref_toks"))
            for sid, ref, x, r in zip(*columns):
                x, r = np.frombuffer(x, np.int64), np.frombuffer(r, np.int64)
                diff = np.setxor1d(x, r, assume_unique=True)
                d, n = len(diff), len(x) + len(r)
                if 2 * d > FARTHEST * (n + d):
                    continue
                linked = high * d <= low * n
                need = (high * d + low * (len(r) - len(x))) // (2 * high) + 1 if linked else d - low * len(x) // threshold
                for column, value in zip(out, (sid, ref, linked, d, max(1, need), diff)):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["sid", "ref", "linked", "d", "need", "diff"])

    return rows


def _differences(sets: DataFrame, threshold: int) -> DataFrame:
    """The differences of nodes to their references; nodes that are their own reference have no row."""
    keys = sets.select("sid", F.struct("skipped", "sid").alias("me"), F.posexplode("keys").alias("r", "key"))
    low = keys.groupBy("r", "key").agg(F.min("me").alias("low"), F.count("*").alias("c")).where("c > 1").drop("c")
    refs = keys.join(low, ["r", "key"]).groupBy("sid").agg(F.min("low").alias("low")).select("sid", F.col("low.sid").alias("ref"))
    refs = scratch.table(refs.where("sid <> ref"), "references")
    for _ in range(REFERENCE_JUMPS):
        up = refs.select(F.col("sid").alias("ref"), F.col("ref").alias("up"))
        refs = refs.join(up, "ref", "left").select("sid", F.coalesce("up", "ref").alias("ref"))
    both = sets.select("sid", "toks").join(refs, "sid").join(sets.select(F.col("sid").alias("ref"), F.col("toks").alias("ref_toks")), "ref")
    return scratch.table(both.mapInArrow(_difference_rows(threshold), "sid long, ref long, linked boolean, d long, need long, diff array<long>"), "differences")


def _within(differences: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """pairs(a, b) of nodes with one reference that may link, unless both link to it, by their common differences."""
    each = differences.select("ref", "sid", "linked", "d", "need", F.explode("diff").alias("tok"))
    often = each.groupBy("ref", "tok").agg(F.count("*").alias("c"), F.min("linked").alias("all_linked")).where("c > 1 and not all_linked")
    own = each.join(often.drop("all_linked"), ["ref", "tok"]).groupBy("ref", "sid", "linked", "d", "need").agg(F.sort_array(F.collect_list(F.struct("c", "tok"))).alias("own"))
    own = own.where("size(own) >= need").join(sets.select("sid", "n"), "sid")
    own = own.withColumn("once", F.col("d") - F.size("own")).withColumn("own", F.expr("slice(own, 1, cast(size(own) - need + 1 as int))"))
    posts = own.select("ref", "sid", "linked", "d", "n", "once", F.posexplode("own").alias("k", "x"))
    posts = scratch.table(posts.select("ref", F.col("x.tok").alias("tok"), "sid", "linked", "d", "n", (F.col("once") + F.col("k")).alias("pos")), "within")
    side = lambda e: posts.select("ref", "tok", *[F.col(c).alias(f"{c}_{e}") for c in ("sid", "linked", "d", "n", "pos")])
    # Before the first common difference all differ; from there on, at most all of the shorter rest is common.
    apart = F.expr("d_a + d_b - 2 * least(d_a - pos_a, d_b - pos_b)")
    return (
        side("a").where("not linked_a").join(side("b"), ["ref", "tok"])
        .where("linked_b or sid_a < sid_b")
        .where((100 + threshold) * apart <= (100 - threshold) * (F.col("n_a") + F.col("n_b")))
        .select(F.col("sid_a").alias("a"), F.col("sid_b").alias("b"))
    )


def shingle_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: int = 80, lower: bool = True
) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id.

    Sets are the distinct shingles of ``shingle`` words of the whole text (with
    fewer words the whole sequence).  Rows link when 100 * common >= threshold *
    union.  component_id is the smallest id reachable.  Null or wordless texts
    have n_shingles 0, link with nothing and are their own component.  Repeated
    rows stay repeated; a null id counts as larger than any other.  An empty
    table gives an empty result; further columns are not read.
    """
    spark = docs.sparkSession
    scratch.small_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def hashes(batch):
        for _, _, _, h in _sets(_texts(batch), shingle, lower):
            yield h

    heavy = spark.sparkContext.broadcast(heavy_slots(src.select("text"), hashes))
    index = scratch.table(src.mapInArrow(lean(_index_rows(shingle, threshold, lower, heavy)), "id long, sid long, n long, prefix array<long>"), "sets")

    step = (100 - threshold) / 200
    first = index.where("prefix is not null").select("sid", "n", "prefix")
    shared = scratch.table(first.select(F.explode("prefix").alias("tok")).groupBy("tok").agg(F.count("*").alias("c")).where("c > 1").select("tok"), "shared")
    some = spark.sparkContext.broadcast(bitmap(shared, "tok"))
    # The bitmap keeps most tokens from travelling; the join decides.
    posts = first.mapInArrow(_candidate_rows(some, step), "sid long, need long, tok long").join(shared, "tok", "left_semi").distinct()
    posts = scratch.table(posts, "candidates")
    alive = posts.groupBy("sid", "need").agg(F.count("*").alias("c")).where("c >= need").select("sid")
    again = posts.join(alive, "sid", "left_semi")
    both = again.groupBy("tok").agg(F.count("*").alias("c")).where("c > 1").select("tok")
    alive = scratch.table(again.join(both, "tok", "left_semi").groupBy("sid", "need").agg(F.count("*").alias("c")).where("c >= need").select("sid"), "alive")
    wanted = spark.sparkContext.broadcast(bitmap(alive, "sid"))
    whole = scratch.table(src.select("text").mapInArrow(lean(_set_rows(shingle, lower, wanted)), "sid long, n long, toks binary, keys array<long>"), "tokens")
    scratch.remove(shared, posts)

    def set_hashes(batch):
        for a in range(0, batch.num_rows, 256):
            yield np.frombuffer(b"".join(batch.column("toks").slice(a, 256).to_pylist()), np.uint64)

    heavy = spark.sparkContext.broadcast(heavy_slots(whole.select("toks"), set_hashes))
    twice = whole.select("toks").mapInArrow(_token_rows, "tok long").groupBy("tok").agg(F.count("*").alias("c")).where("c > 1").select("tok")
    some = spark.sparkContext.broadcast(bitmap(twice, "tok", 27))
    ranked = whole.mapInArrow(_ranked_rows(threshold, some, heavy), "sid long, n long, toks binary, keys array<long>, prefix array<long>, skipped long")
    sets = scratch.table(ranked.dropDuplicates(["sid"]), "ranked")
    scratch.remove(whole)

    labels = _labels(sets, threshold)
    out = index.select("id", "sid", "n")
    if labels is not None:
        out = out.join(labels.withColumnRenamed("node", "sid"), "sid", "left")
    else:
        out = out.withColumn("label", F.lit(None).cast("long"))
    out = scratch.table(out.select("id", "n", F.coalesce("label", "sid").alias("c")), "classes")
    least = out.where("n > 0").groupBy("c").agg(F.min("id").alias("least"))
    full = out.where("n > 0").join(least, "c").select("id", "n", "least")
    none = out.where("n = 0").select("id", "n", F.col("id").alias("least"))
    return full.union(none).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))


def _labels(sets: DataFrame, threshold: int) -> DataFrame | None:
    """(node, label) by all links that components need, between distinct sets; None without links."""
    differences = _differences(sets, threshold)
    within = _within(differences, sets, threshold)
    star = differences.where("linked").select(F.col("sid").alias("a"), F.col("ref").alias("b"))
    nodes = sets.select("sid", "n", "prefix", "skipped").join(differences.select("sid", "ref"), "sid", "left")
    entries = nodes.select("sid", F.coalesce("ref", "sid").alias("g"), "n", "skipped", F.posexplode("prefix").alias("k", "tok"))
    entries = scratch.table(entries.select("tok", "g", "sid", "n", (F.col("k") + F.col("skipped")).alias("pos")), "entries")

    ratio = math.log(100 / threshold) * 1.0001  # sizes that may link are in the same class or the next
    size_class = lambda c: F.floor(F.log(F.col(c).cast("double")) / ratio).cast("int")
    posts = entries.groupBy("tok", "g").agg(F.min("pos").alias("plo"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    posts = posts.withColumn("k0", size_class("lo")).withColumn("k1", size_class("hi"))
    common = posts.groupBy("tok").agg(F.count("*").alias("c")).where("c > 1").select("tok")
    posts = scratch.table(posts.join(common, "tok", "left_semi"), "postings")
    left = posts.select("tok", F.col("g").alias("a"), *[F.col(c).alias(f"{c}_a") for c in ("plo", "lo", "hi", "k0")], F.explode(F.sequence("k0", "k1")).alias("k"))
    right = posts.select("tok", F.col("g").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("plo", "lo", "hi", "k0")], F.explode(F.sequence(F.col("k0") - 1, F.col("k1") + 1)).alias("k"))
    # At the first token that two sets share, all tokens before it are differences, of which linked sets have so many at most.
    groups = (
        left.join(right, ["tok", "k"])
        .where("a < b and k = greatest(k0_a, k0_b - 1)")
        .where((100 * F.col("hi_a") >= threshold * F.col("lo_b")) & (100 * F.col("hi_b") >= threshold * F.col("lo_a")))
        .where((100 + threshold) * (F.col("plo_a") + F.col("plo_b")) <= (100 - threshold) * (F.col("hi_a") + F.col("hi_b")))
        .select("tok", F.col("a").alias("ga"), F.col("b").alias("gb"))
    )
    side = lambda e: entries.select("tok", F.col("g").alias(f"g{e}"), F.col("sid").alias(e), F.col("n").alias(f"n_{e}"), F.col("pos").alias(f"pos_{e}"))
    across = (
        groups.join(side("a"), ["tok", "ga"]).join(side("b"), ["tok", "gb"])
        .where((100 * F.col("n_a") >= threshold * F.col("n_b")) & (100 * F.col("n_b") >= threshold * F.col("n_a")))
        .where((100 + threshold) * (F.col("pos_a") + F.col("pos_b")) <= (100 - threshold) * (F.col("n_a") + F.col("n_b")))
        .select("a", "b")
    )
    pairs = scratch.table(within.union(across).distinct(), "pairs")
    links = scratch.table(star.union(_compared(pairs, sets, threshold).where("linked").select("a", "b")), "found")
    if links.limit(1).count() == 0:
        return None
    return components(links)

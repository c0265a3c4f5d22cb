"""Importance resampling towards a target corpus, over bucket-partitioned inverted postings.

Features are runs of one to three words, hashed to BUCKETS buckets.  A task cuts
its texts into *slices* of a few MB and writes, for each bucket that occurs in
the slice, one posting list: the places of its texts in the slice, ascending,
each as often as the text has features there.

* Both corpora's counts are summed by bucket before they shuffle.  Then the
  posting lists go to the partition of their bucket, where the bucket's counts
  of both corpora lie and its gain is computed.  A partition holds every
  SHARDS-th bucket of at most SPLIT_SLICES slices: a bucket that holds a large
  share of all features is split by slice, and its two counts (not its lists)
  go to every part.
* A partition emits one array of contributions for each slice (SHARDS for a
  slice, however large the corpus), and the arrays are added up by slice.

Texts are read once.  A posting list is written as differences between places,
one byte each: 255 says "255 further on, no posting".
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orfloom.llm import scratch
from orfloom.llm.ranks import numbered
from orfloom.llm.textops import LONG_WORD, Words, chunks, lean, split_words

#: Buckets of features, and words of the longest feature.
BUCKETS, MAX_WORDS = 10_000, 3
#: Bytes of text in a slice, parts that the buckets are dealt to, slices whose lists one partition takes.
SLICE_BYTES, SHARDS, SPLIT_SLICES = 4 << 20, 32, 256
#: A text may be drawn from so many words on.
MIN_WORDS = 20

_OTHER = np.ones(256, bool)  # bytes between words, after A-Z became a-z
_OTHER[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _shift_tables() -> np.ndarray:
    """[n, k, b]: what byte k of a checksum, of value b, becomes when n bytes follow."""
    t = np.zeros((LONG_WORD + 2, 4, 256), np.uint32)
    for k in range(4):
        t[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, len(t)):
        t[n] = _TABLE[t[n - 1] & np.uint32(255)] ^ (t[n - 1] >> np.uint32(8))
    return t.ravel()


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & np.uint32(1), np.uint32(0xEDB88320) ^ (t >> np.uint32(1)), t >> np.uint32(1))
    return t


_TABLE = _byte_table()
_SHIFT = _shift_tables()
_ONES = np.uint32(0xFFFFFFFF)


def _followed(crc: np.ndarray, n: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Checksums of strings with checksum crc, each followed by n bytes (at most LONG_WORD + 1) with checksum tail."""
    at = n * 1024
    out = tail ^ _SHIFT[at + (crc & np.uint32(255))]
    for k in (1, 2, 3):
        out ^= _SHIFT[at + 256 * k + ((crc >> np.uint32(8 * k)) & np.uint32(255))]
    return out


def feature_checksums(w: Words, longest: int = MAX_WORDS) -> list[np.ndarray]:
    """crc32 of the runs of 1, 2, ... words that begin at each word (joined by one space), wherever they end."""
    n = (w.end - w.start).astype(np.int64)
    one = np.full(len(n), _ONES)
    todo = np.arange(len(n))
    for k in range(LONG_WORD):
        todo = todo[n[todo] > k] if k else todo
        if not len(todo):
            break
        c = one[todo]
        one[todo] = _TABLE[(c ^ w.buf[w.start[todo] + k]) & np.uint32(255)] ^ (c >> np.uint32(8))
    one ^= _ONES
    raw, long = w.buf.data, np.flatnonzero(n > LONG_WORD)
    word = lambda i: bytes(raw[w.start[i] : w.end[i]])
    for i in long:
        one[i] = zlib.crc32(word(i))
    short = np.minimum(n, LONG_WORD)
    spaced = _followed(np.full(len(n), zlib.crc32(b" "), np.uint32), short, one)
    out = [one]
    for j in range(1, min(longest, len(n))):
        prev = out[-1][: len(n) - j]
        run = _followed(prev, short[j:] + 1, spaced[j:])
        for i in long[long >= j]:
            run[i - j] = zlib.crc32(b" " + word(i), int(prev[i - j]))
        out.append(run)
    return out


def _buckets(texts: list[bytes], buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of each feature, and the words of each text."""
    w = split_words(texts, lower=True, space=_OTHER)
    words = np.diff(w.bound)
    text, left = np.repeat(np.arange(len(texts)), words), np.repeat(w.bound[1:], words) - np.arange(len(w.start))
    docs, slots = [], []
    for j, crc in enumerate(feature_checksums(w, longest) if len(w.start) else ()):
        inside = left[: len(crc)] > j
        docs.append(text[: len(crc)][inside])
        slots.append((crc[inside] % np.uint32(buckets)).astype(np.int64))
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *docs]), np.concatenate([empty, *slots]), words


def _pack(places: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, end of each list) of ascending places; first says which ones begin a list."""
    step = np.diff(places, prepend=0)
    step[first] = places[first]
    size = step // 255 + 1
    out = np.full(size.sum(), 255, np.uint8)
    end = np.cumsum(size)
    out[end - 1] = step % 255
    return out, end[np.append(np.flatnonzero(first)[1:] - 1, len(places) - 1)]


def unpack(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(list, place) of each posting of the packed lists."""
    size = np.fromiter((len(p) for p in packed), np.int64, len(packed))
    step = np.frombuffer(b"".join(packed), np.uint8)
    total = np.cumsum(step, dtype=np.int64)
    ends = np.cumsum(size)
    before = np.concatenate([[0], total[ends[:-1] - 1]]) if len(size) else ends
    which = np.repeat(np.arange(len(size)), size)
    real = step != 255
    return which[real], (total - before[which])[real]


def _postings(buckets: int, longest: int, ids: pa.DataType):
    docs_type = pa.list_(pa.struct([("id", ids), ("n_features", pa.int64()), ("n_words", pa.int64())]))
    schema = pa.schema([("slice", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64()), ("packed", pa.binary()), ("docs", docs_type)])

    def rows(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, part in chunks(batch.column("text").cast(pa.binary()).to_pylist(), SLICE_BYTES):
                text, slot, words = _buckets(part, buckets, longest)
                key = np.sort(slot * len(part) + text)
                slot, place = key // len(part), key % len(part)
                new = np.diff(slot, prepend=-1) != 0
                data, end = _pack(place, new) if len(key) else (np.zeros(0, np.uint8), np.zeros(0, np.int64))
                at = np.flatnonzero(new)
                lists = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(0, end).astype(np.int32)), pa.py_buffer(data)])
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, number)), pa.array(slot[at].astype(np.int32)), pa.array(np.diff(np.append(at, len(key)))), lists, pa.nulls(n, docs_type)], schema=schema
                )
                features = np.bincount(text, minlength=len(part))
                each = pa.StructArray.from_arrays(
                    [batch.column("id").slice(first, len(part)).cast(ids), pa.array(features), pa.array(words.astype(np.int64))], fields=list(docs_type.value_type)
                )
                docs = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), each).cast(docs_type)
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([-1], pa.int32()), pa.array([0]), pa.array([b""], pa.binary()), docs], schema=schema)
                number += 1

    return rows


def _counts(buckets: int, longest: int):
    def rows(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, part in chunks(batch.column(0).cast(pa.binary()).to_pylist(), SLICE_BYTES):
                total += np.bincount(_buckets(part, buckets, longest)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "t"])

    return rows


def _contributions(buckets: int, docs_total: int, target_total: int):
    """Rows of a partition: first the buckets' counts (slice is null), then posting lists by slice."""

    def rows(batches):
        gain, held, now = np.zeros(buckets), None, None
        for batch in batches:
            slices = batch.column("slice").fill_null(-1).to_numpy()
            bucket = batch.column("bucket").to_numpy()
            for i in np.flatnonzero(slices == -1):
                s, t = batch.column("s")[i].as_py(), batch.column("t")[i].as_py()
                ratio = (t + 1.0) * (docs_total + float(buckets)) / ((s + 1.0) * (target_total + float(buckets)))
                gain[bucket[i]] = math.floor(1000 * math.log(ratio))
            edge = np.concatenate([[0], np.flatnonzero(np.diff(slices)) + 1, [len(slices)]])
            for a, b in zip(edge[:-1], edge[1:]):
                if a == b or slices[a] == -1:
                    continue
                if slices[a] != now:
                    if now is not None:
                        yield _part(now, held)
                    now, held = slices[a], np.zeros(0)
                which, place = unpack(batch.column("packed").slice(a, b - a).to_pylist())
                own = np.bincount(place, weights=gain[bucket[a:b]][which])
                held = np.pad(held, (0, max(0, len(own) - len(held))))
                held[: len(own)] += own
        if now is not None:
            yield _part(now, held)

    return rows


def _part(number: int, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sums.astype("<i8").tobytes()], pa.binary())], ["slice", "part"])


def _add_up(batches):
    """Rows by slice: its arrays of contributions and its documents."""
    now, held, docs = None, None, None

    def done():
        each = docs.flatten()
        sums = np.zeros(len(each), np.int64)
        sums[: len(held)] = held
        return pa.RecordBatch.from_arrays([*each.flatten(), pa.array(sums)], ["id", "n_features", "n_words", "weight"])

    for batch in batches:
        for i, (number, part) in enumerate(zip(batch.column("slice").to_pylist(), batch.column("part").to_pylist())):
            if number != now:
                if now is not None:
                    yield done()
                now, held = number, np.zeros(0, np.int64)
            if part is None:
                docs = batch.column("docs").slice(i, 1)
            else:
                own = np.frombuffer(part, "<i8")
                held = np.pad(held, (0, max(0, len(own) - len(held))))
                held[: len(own)] += own
    if now is not None:
        yield done()


def document_weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, longest: int = MAX_WORDS) -> DataFrame:
    """(id, n_features, n_words, weight): one row per row of docs; weight is the sum of its features' gains.

    A bucket's gain is floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))) for
    s of S features in docs and t of T in target.
    """
    spark = docs.sparkSession
    scratch.small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    listed = f"array<struct<id:{kind},n_features:bigint,n_words:bigint>>"
    ids = src.select("id").limit(0).toArrow().schema.field("id").type
    rows = _postings(buckets, longest, ids)
    posts = scratch.table(src.mapInArrow(lean(rows), f"slice long, bucket int, n long, packed binary, docs {listed}"), "postings")
    wanted = target.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(lean(_counts(buckets, longest)), "bucket int, t long")
    own = posts.where("bucket >= 0").groupBy("bucket").agg(F.sum("n").alias("s"), F.lit(0).cast("long").alias("t"))
    both = own.unionByName(wanted.select("bucket", F.lit(0).cast("long").alias("s"), "t"))
    totals = scratch.table(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "bucket-counts")
    s, t = totals.agg(F.sum("s"), F.sum("t")).first()
    splits = 1 + posts.where("bucket = -1").count() // SPLIT_SLICES
    # A partition's counts come first (their slice is null), then its lists by slice.
    counts = totals.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))).withColumn("slice", F.lit(None).cast("long"))
    lists = posts.where("bucket >= 0").withColumn("split", F.pmod(F.hash("slice"), F.lit(splits))).select("slice", "bucket", "split", "packed")
    dealt = counts.unionByName(lists, allowMissingColumns=True).repartitionById(SHARDS * splits, (F.col("split") * SHARDS + F.col("bucket") % SHARDS).cast("int"))
    parts = dealt.select("slice", "bucket", "s", "t", "packed").sortWithinPartitions(F.asc_nulls_first("slice"))
    parts = parts.mapInArrow(lean(_contributions(buckets, s or 0, t or 0)), "slice long, part binary")
    heads = posts.where("bucket = -1").select("slice", "docs")
    by_slice = parts.unionByName(heads, allowMissingColumns=True).repartition("slice").sortWithinPartitions("slice", F.asc_nulls_first("part"))
    return by_slice.select("slice", "part", "docs").mapInArrow(lean(_add_up), f"id {kind}, n_features long, n_words long, weight long").withColumnRenamed("id", id_col)


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 5, seed: int = 42,
    min_words: int = MIN_WORDS, buckets: int = BUCKETS,
) -> DataFrame:
    """One row per row of docs: id_col, n_features, n_words, weight, score, rank.

    score is the weight (thousandths of a natural logarithm) plus a Gumbel noise
    drawn from a hash of seed and id, so that the highest scores are a sample
    without replacement, in proportion to exp(weight / 1000).  Of the N rows
    with at least min_words words, floor(percent * N / 100) are drawn; rank
    counts them by score, ties to the smaller id (null last); others have none.

    Null texts, texts without words and an empty table have no features: weight
    0.  A null id is hashed as an empty one; repeated rows are rows of their own
    with one score; other columns are not read.  An empty target gives every
    feature the gain of an unseen one.
    """
    out = document_weights(docs, target, id_col, text_col, buckets)
    own = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(own, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    fit = F.col("n_words") >= min_words
    out = out.withColumn("score", F.col("weight") + noise)
    out = numbered(out, [fit.desc(), F.desc("score"), F.asc_nulls_last(id_col)], "place", "scores")
    n = out.where(fit).count()
    drawn = fit & (F.col("place") <= percent * n // 100)
    return out.withColumn("rank", F.when(drawn, F.col("place"))).drop("place")

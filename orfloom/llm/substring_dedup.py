"""Substring dedup: windows of words that occur twice, counted in super-k-mer buckets.

A window is ``window`` consecutive words of one text.  Its *minimiser* is the
smallest of its m-word groups, rare groups first (a fixed-size summary of
frequent hash slots decides what is rare; it only sets the order).  Consecutive
windows with one minimiser are a *super-k-mer* and travel as one packed string
to the minimiser's bucket.  Equal windows have equal minimisers, so each bucket
can count its windows exactly by sorting.

* Minimisers that occur once in the corpus are counted away first, so strings
  that cannot hold a repeated window do not travel.
* Since rare groups come first, a passage that a third of all texts share has
  the same packed strings in each of them: they are pre-aggregated to one row
  with a count.  Strings that hold the passage's edge have minimisers of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orfloom.llm import scratch
from orfloom.llm.sketches import HEAVY_BITS, bitmap, heavy_slots, in_bitmap
from orfloom.llm.textops import Words, chunks, lean, mix, shingle_hashes, split_words

#: Words in a minimiser.
GROUP = 7
#: Packed bytes that a bucket task works on at once (whole buckets; one bucket may be larger).
BLOCK_BYTES = 4 << 20

_B1, _B2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _texts(batch: pa.RecordBatch, name: str = "text") -> list:
    return batch.column(name).cast(pa.binary()).to_pylist()


def _power(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def window_hashes(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each run of ``window`` word hashes."""
    out = []
    for base, g in ((_B1, h), (_B2, mix(h))):
        inverse = pow(base, -1, 1 << 64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(g * _power(base, len(g)), dtype=np.uint64)])
        out.append((total[window:] - total[:-window]) * _power(inverse, len(g) - window + 1))
    return out[0], out[1]


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    size = 1
    while size * 2 <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (width - size)], v[width - size :]) if width > size else v


def _super_kmers(w: Words, window: int, group: int, heavy: np.ndarray):
    """(text, first window's word, windows, minimiser, places of the minimiser) of a chunk's super-k-mers."""
    total, width = len(w.hash), window - group + 1
    empty = np.zeros(0, np.int64)
    if total < window:
        return empty, empty, empty, empty.astype(np.uint64), empty
    g, _ = shingle_hashes(w, group)
    g = g[: total - group + 1]
    v = (heavy[(g >> np.uint64(64 - HEAVY_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (g >> np.uint64(6))
    low = _least(v, width)
    text = np.repeat(np.arange(len(w.bound) - 1), np.diff(w.bound))[: len(low)]
    ok = np.arange(len(low)) + window <= w.bound[1:][text]
    at = np.flatnonzero(ok)
    if not len(at):
        return empty, empty, empty, empty.astype(np.uint64), empty
    new = np.concatenate([[True], (np.diff(at) != 1) | (text[at[1:]] != text[at[:-1]]) | (low[at[1:]] != low[at[:-1]])])
    first = at[new]
    count = np.diff(np.concatenate([np.flatnonzero(new), [len(at)]]))
    span = count + width - 1
    offset = np.concatenate([[0], np.cumsum(span)[:-1]])
    inside = np.arange(span.sum()) - np.repeat(offset, span) + np.repeat(first, span)
    places = np.add.reduceat((v[inside] == np.repeat(low[first], span)).astype(np.int64), offset)
    return text[first], first, count, low[first], places


def _minimisers(window, group, heavy):
    def rows(batches):
        for batch in batches:
            for _, part in chunks(_texts(batch)):
                _, _, _, v, places = _super_kmers(split_words(part), window, group, heavy.value)
                value, inverse = np.unique(v, return_inverse=True)
                times = np.bincount(inverse, weights=places, minlength=len(value)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(times)], ["v", "c"])

    return rows


def _packed(window, group, heavy, wanted):
    def rows(batches):
        for batch in batches:
            keys = batch.column("key").to_pylist()
            for first, part in chunks(_texts(batch)):
                w = split_words(part)
                text, at, count, v, _ = _super_kmers(w, window, group, heavy.value)
                keep = np.flatnonzero(in_bitmap(wanted.value, v))
                if not len(keep):
                    continue
                packed = [w.text(at[i], at[i] + count[i] + window - 1) for i in keep]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([keys[first + t] for t in text[keep]], pa.binary()),
                        pa.array((at[keep] - w.bound[:-1][text[keep]]).astype(np.int64)),
                        pa.array(v[keep].view(np.int64)),
                        pa.array([xxhash.xxh3_128_digest(p) for p in packed], pa.binary()),
                        pa.array(packed, pa.binary()),
                    ],
                    ["key", "start", "v", "name", "packed"],
                )

    return rows


def _runs(hit: np.ndarray, window: int) -> list[int]:
    """[begin, end, begin, end, ...] of the words that the hit windows cover."""
    begin, end = hit[np.concatenate([[True], np.diff(hit) > window])], hit[np.concatenate([np.diff(hit) > window, [True]])] + window
    return np.stack([begin, end], 1).ravel().tolist()


def _count_block(packed: list[bytes], times: np.ndarray, window: int):
    """(name, covered word runs) of each packed string with a window that occurs twice."""
    w = split_words(packed)
    a, b = window_hashes(w.hash, window)
    text = np.repeat(np.arange(len(packed)), np.diff(w.bound))[: len(a)]
    at = np.flatnonzero(np.arange(len(a)) + window <= w.bound[1:][text])
    a, b, text = a[at], b[at], text[at]
    order = np.lexsort((b, a))
    new = np.concatenate([[True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)])
    number = np.cumsum(new) - 1
    many = np.bincount(number, weights=times[text[order]]) > 1
    hit = np.zeros(len(at), bool)
    hit[order] = many[number]
    at, text = at[hit], text[hit]
    cut = np.flatnonzero(np.diff(text)) + 1
    names, runs = [], []
    for part in np.split(np.arange(len(at)), cut) if len(at) else []:
        t = text[part[0]]
        names.append(xxhash.xxh3_128_digest(packed[t]))
        runs.append(_runs(at[part] - w.bound[t], window))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(runs, pa.list_(pa.int64()))], ["name", "runs"])


def _count(window):
    def rows(batches):
        """Rows come sorted by minimiser; blocks end between two minimisers."""
        packed, times, size, last = [], [], 0, None
        for batch in batches:
            for v, p, c in zip(batch.column("v").to_pylist(), batch.column("packed").to_pylist(), batch.column("c").to_pylist()):
                if size > BLOCK_BYTES and v != last:
                    yield _count_block(packed, np.array(times, np.float64), window)
                    packed, times, size = [], [], 0
                packed.append(p)
                times.append(c)
                size += len(p)
                last = v
        if packed:
            yield _count_block(packed, np.array(times, np.float64), window)

    return rows


def _cut(batches):
    for batch in batches:
        runs = batch.column("runs").to_pylist()
        for first, part in chunks(_texts(batch)):
            w = split_words(part)
            words, removed, kept = np.diff(w.bound), [], []
            for i in range(len(part)):
                a, b = int(w.bound[i]), int(w.bound[i + 1])
                gone = np.zeros(b - a + 1, np.int64)
                for r in runs[first + i] or ():
                    edge = np.array(r["runs"]) + r["start"]
                    np.add.at(gone, edge[0::2], 1)
                    np.add.at(gone, edge[1::2], -1)
                keep = np.cumsum(gone)[: b - a] == 0
                removed.append(b - a - int(keep.sum()))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], keep, [0]])))
                kept.append(b" ".join(w.text(a + x, a + y) for x, y in zip(edge[0::2], edge[1::2])))
            cols = {c: batch.column(c).slice(first, len(part)) for c in batch.schema.names if c not in ("runs", "key")}
            out = [*cols.values(), pa.array(words.astype(np.int64)), pa.array(removed, pa.int64()), pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string())]
            yield pa.RecordBatch.from_arrays(out, [*cols, "n_words", "n_removed", "kept_text"])


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, group: int = GROUP) -> DataFrame:
    """One row per input row: id_col, text, n_words, n_removed, kept_text.

    Every word is removed that is covered by a window whose word sequence also
    starts anywhere else, in the same text or another; windows are judged on the
    input.  kept_text has the kept words joined by one space.  A null text has no
    words; texts shorter than a window lose nothing; repeated rows are copies of
    each other; a null id passes through; an empty table gives an empty result;
    further columns are not read.  Window equality is by 128 bits of hash within
    a minimiser's bucket.
    """
    if not 0 < group <= window:
        raise ValueError("group must be between 1 and window")
    spark = docs.sparkSession
    scratch.small_batches(spark)
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def hashes(batch):
        for _, part in chunks(_texts(batch)):
            g, ok = shingle_hashes(split_words(part), group)
            yield g[ok]

    heavy = spark.sparkContext.broadcast(heavy_slots(src.select("text"), hashes))
    again = scratch.table(
        src.select("text").mapInArrow(lean(_minimisers(window, group, heavy)), "v long, c long").groupBy("v").agg(F.sum("c").alias("c")).where("c > 1").select("v"),
        "minimisers",
    )
    wanted = spark.sparkContext.broadcast(bitmap(again, "v"))
    keyed = src.withColumn("key", F.unhex(F.md5("text")))
    strings = scratch.table(
        keyed.select("key", "text").mapInArrow(lean(_packed(window, group, heavy, wanted)), "key binary, start long, v long, name binary, packed binary"),
        "superkmers",
    )
    counted = (
        strings.groupBy("v", "packed").agg(F.count("*").alias("c"))
        .repartition("v").sortWithinPartitions("v")
        .mapInArrow(lean(_count(window)), "name binary, runs array<long>")
    )
    places = strings.select("key", "start", "name").distinct().join(counted, "name").groupBy("key").agg(F.collect_list(F.struct("start", "runs")).alias("runs"))
    out = keyed.join(scratch.table(places, "runs"), "key", "left")
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, text string, n_words long, n_removed long, kept_text string"
    return out.mapInArrow(lean(_cut), schema).withColumnRenamed("id", id_col)

"""Packing: token sequences of a fixed capacity, by column generation.

Texts become ids; each is cut every ``capacity`` ids, so at most its last piece
is shorter.  Piece lengths are counted in classes of ``capacity / CLASSES`` ids
(a table of at most CLASSES rows, whatever the corpus).  The cutting-stock
linear program over that histogram is solved by column generation: a revised
simplex holds one pattern a class, a knapsack dynamic program prices new ones.
The solution is rounded down, and the few pieces left over are packed first-fit
by decreasing class.  Pieces are ranked within their class (hash buckets with
offsets, so no task ranks a whole class) and the rank decides pattern, sequence
and slot.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orfloom.llm import scratch
from orfloom.llm.textops import Words, chunks, lean, split_words, word_hashes

#: Length classes of a sequence.
CLASSES = 128
#: Distinct words whose ids a task remembers, and slots of the table in front of them.
CACHE_UNITS, TABLE_BITS = 400_000, 19
#: Pieces that one bucket of a ranking holds, about.
BUCKET_ROWS = 20_000


_TAIL = np.zeros(256, np.int64)
_TAIL[list(b".,!?;:#$%*&|()")] = 1
_ALNUM = np.zeros(256, bool)
_ALNUM[[c for c in range(128) if chr(c).isalnum()]] = True


class WordEncoder:
    """Ids of words by a tokenizer that never joins across white space and lowers case; each distinct word is encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.clear()

    def clear(self) -> None:
        self.number: dict[int, int] = {}
        self.ids, self.sizes, self.begins = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        # A direct table in front of the dictionary: the last unit at each slot.
        self.slot_hash, self.slot_unit = np.zeros(1 << TABLE_BITS, np.uint64), np.zeros(1 << TABLE_BITS, np.int64)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each text's)."""
        if len(self.number) > CACHE_UNITS:
            self.clear()
        w = split_words(texts, lower=True)
        start, end, bound = _units(w)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        h = word_hashes(w.buf, start, end)
        slot = (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        unit = self.slot_unit[slot]
        miss = np.flatnonzero(self.slot_hash[slot] != h)
        if len(miss):
            value, first, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            at = np.fromiter((self.number.get(v, -1) for v in value.tolist()), np.int64, len(value))
            new = np.flatnonzero(at < 0)
            if len(new):
                raw = w.buf.data
                words = [bytes(raw[start[i] : end[i]]).decode("utf-8", "replace") for i in miss[first[new]]]
                got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
                at[new] = np.arange(len(self.number), len(self.number) + len(new))
                self.number.update(zip(value[new].tolist(), at[new].tolist()))
                sizes = np.fromiter(map(len, got), np.int64, len(got))
                self.begins = np.concatenate([self.begins, len(self.ids) + np.cumsum(sizes) - sizes])
                self.sizes = np.concatenate([self.sizes, sizes])
                self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum()))])
            unit[miss] = at[inverse]
            self.slot_hash[slot[miss]], self.slot_unit[slot[miss]] = h[miss], unit[miss]
        size = self.sizes[unit]
        upto = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.repeat(self.begins[unit] - upto[:-1], size) + np.arange(upto[-1])], upto[bound]


def _units(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, bound): words, with ASCII punctuation at their end cut off where that is a token of its own.

    The pattern keeps letters, digits and other signs apart, so a tail of signs
    after a letter is its own part.  Only tails of at most eight signs after an
    ASCII letter or digit or one of the letters À-ÿ are cut off.
    """
    core = w.end.copy()
    for _ in range(8):
        core -= (core > w.start) & _TAIL[w.buf[np.maximum(core, 1) - 1]]
    last, before = w.buf[np.maximum(core, 1) - 1], w.buf[np.maximum(core, 2) - 2]
    letter = _ALNUM[last] | ((before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))
    cut = (core > w.start) & (core < w.end) & letter
    core = np.where(cut, core, w.end)
    place = np.arange(len(core)) + np.concatenate([[0], np.cumsum(cut)[:-1]]) if len(core) else np.zeros(0, np.int64)
    start, end = np.zeros(len(core) + int(cut.sum()), np.int64), np.zeros(len(core) + int(cut.sum()), np.int64)
    start[place], end[place] = w.start, core
    tail = place[cut] + 1
    start[tail], end[tail] = core[cut], w.end[cut]
    return start, end, np.append(place, len(start))[w.bound]


def _pieces(path: str, end_id: int, capacity: int):
    def rows(batches):
        encoder = WordEncoder(path)
        for batch in batches:
            ids = batch.column("id")
            for first, part in chunks(batch.column("text").cast(pa.binary()).to_pylist(), 1 << 20):
                tokens, bound = encoder.encode(part)
                doc, start, length, crc, total = [], [], [], [], []
                for i in range(len(part)):
                    own = np.append(tokens[bound[i] : bound[i + 1]], np.uint32(end_id)).astype("<u4")
                    for s in range(0, len(own), capacity):
                        piece = own[s : s + capacity]
                        doc.append(first + i)
                        start.append(s)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        total.append(len(own))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(doc, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))],
                    ["id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    return rows


def _best_pattern(y: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within capacity with the largest sum of y: an unbounded knapsack."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        fit = np.flatnonzero((size <= room) & (y > 0))
        if len(fit):
            value = best[room - size[fit]] + y[fit]
            k = int(np.argmax(value))
            if value[k] > best[room] + 1e-12:
                best[room], last[room] = value[k], fit[k]
    pattern, room = np.zeros(len(size)), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
            continue
        pattern[last[room]] += 1
        room -= size[last[room]]
    return best[capacity], pattern


def cutting_stock(size: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(items of each size, times) of patterns within capacity that hold all of the demand."""
    m = len(size)
    columns = np.diag(capacity // size).astype(float)
    cost = np.ones(m)
    inverse = np.diag(1 / (capacity // size))
    # Sums instead of BLAS calls: its threads can hang in a process that has forked.
    x = (inverse * demand).sum(1)
    for _ in range(200 * m):
        y = (cost[:, None] * inverse).sum(0)
        low = int(np.argmin(y))
        if y[low] < -1e-9:  # more items of a size than there are cost nothing
            entering, price = -np.eye(m)[low], 0.0
        else:
            value, entering = _best_pattern(y, size, capacity)
            price = 1.0
            if value <= 1 + 1e-9:
                break
        d = (inverse * entering).sum(1)
        ok = d > 1e-9
        ratio = np.where(ok, x / np.where(ok, d, 1), np.inf)
        r = int(np.argmin(ratio))
        if not ok[r]:
            break
        inverse[r] /= d[r]
        rest = d.copy()
        rest[r] = 0
        inverse -= rest[:, None] * inverse[r]
        columns[:, r], cost[r] = entering, price
        x = np.maximum((inverse * demand).sum(1), 0)
    left = demand.astype(np.int64).copy()
    out = []
    for p in range(m):
        a = np.rint(columns[:, p]).astype(np.int64)
        times = int(np.floor(x[p] + 1e-6)) if cost[p] else 0
        has = a > 0
        if times and has.any():
            times = int(min(times, (left[has] // a[has]).min()))
        if times > 0:
            out.append((a, times))
            left -= a * times
    bins: list[tuple[int, np.ndarray]] = []
    while left.any():  # first-fit decreasing, many equal bins at once
        a, room = np.zeros(m, np.int64), capacity
        for i in np.argsort(-size):
            k = min(int(left[i]), room // int(size[i]))
            a[i], room = k, room - k * int(size[i])
        has = a > 0
        times = int((left[has] // a[has]).min())
        out.append((a, times))
        left -= a * times
    return out


def _slots(patterns, size):
    """Rows (class, first rank, items in a sequence, first sequence, slots before) and the number of sequences."""
    rows, used, sequence = [], np.zeros(len(size), np.int64), 0
    for a, times in patterns:
        before = 0
        for i in np.argsort(-size):
            if a[i]:
                rows.append((int(size[i]), int(used[i]), int(a[i]), sequence, before))
                used[i] += a[i] * times
                before += int(a[i])
        sequence += times
    return rows


def _assigned(rows):
    table = {}
    for c in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == c)
        table[c] = np.array(own, np.int64)

    def assign(batches):
        for batch in batches:
            c, rank = batch.column("class").to_numpy(), batch.column("rank").to_numpy()
            sequence, slot = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
            for k in np.unique(c):
                own, t = np.flatnonzero(c == k), table[int(k)]
                p = np.searchsorted(t[:, 0], rank[own], "right") - 1
                place = rank[own] - t[p, 0]
                sequence[own] = t[p, 2] + place // t[p, 1]
                slot[own] = t[p, 3] + place % t[p, 1]
            keep = [n for n in batch.schema.names if n not in ("class", "rank")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(sequence), pa.array(slot)], [*keep, "sequence_id", "slot"])

    return assign


def pack_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, classes: int = CLASSES
) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A row's ids are its whole text's by the tokenizer file, without special
    tokens, then ``end_id``; each id lies in exactly one piece.  Pieces of a
    sequence lie at gapless offsets from 0 and have at most ``capacity`` ids
    together.  A null text is empty (its piece is the end id alone); repeated
    rows are packed each; a null id passes through; an empty table gives an
    empty result; further columns are not read.  The tokenizer must lower case,
    keep letters, digits and signs apart, and not join across white space.
    """
    if capacity % classes:
        raise ValueError("classes must divide capacity")
    scratch.small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = scratch.table(
        src.mapInArrow(lean(_pieces(tokenizer_path, end_id, capacity)), f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long"), "pieces"
    )
    width = capacity // classes
    pieces = pieces.withColumn("class", F.ceil(F.col("length") / width).cast("long"))
    histogram = sorted((r["class"], r["n"]) for r in pieces.groupBy("class").agg(F.count("*").alias("n")).collect())
    size, demand = np.array([h[0] for h in histogram], np.int64), np.array([h[1] for h in histogram], np.int64)
    rows = _slots(cutting_stock(size, demand, classes), size)
    buckets = max(16, -(-int(demand.sum()) // BUCKET_ROWS))
    order = ["id", "start", "ids_crc32", "doc_tokens"]
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    first = pieces.groupBy("class", "bucket").agg(F.count("*").alias("n"))
    first = first.select("class", "bucket", (F.sum("n").over(Window.partitionBy("class").orderBy("bucket")) - F.col("n")).alias("first"))
    ranked = pieces.withColumn("k", F.row_number().over(Window.partitionBy("class", "bucket").orderBy(F.desc("length"), *order)) - 1)
    ranked = ranked.join(first, ["class", "bucket"]).select("id", "start", "length", "ids_crc32", "doc_tokens", "class", (F.col("first") + F.col("k")).alias("rank"))
    out = ranked.mapInArrow(_assigned(rows), f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("slot").withColumnRenamed("id", id_col)

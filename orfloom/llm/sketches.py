"""Summaries of a size that does not depend on the data: heavy slots and slot bitmaps.

Both only steer work (an order of tokens, what need not travel).  Results never
depend on how exact they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orfloom.llm.textops import lean

#: Slots of the frequency summary: 1 MB as one byte each, whatever the corpus.
HEAVY_BITS = 20
#: Slots of a bitmap: 8 MB as one bit each.
BITMAP_BITS = 26


def heavy_slots(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int = HEAVY_BITS) -> np.ndarray:
    """Log2 frequency class of each hash slot (0: not frequent), over the whole of df.

    A task reports the slots that are frequent within it, so a token that holds
    a fixed share of the rows is always seen; at most 2**bits rows reach the driver.
    """

    def local(batches):
        count, total = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for h in hashes(batch):
                count += np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
                total += len(h)
        slot = np.flatnonzero(count >= max(8, 4 * total / (1 << bits)))
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(count[slot])], ["slot", "n"])

    found = df.mapInArrow(lean(local), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << bits, np.uint8)
    if len(found):
        n = found["n"].to_numpy().astype(np.float64)
        out[found["slot"].to_numpy()] = 1 + np.floor(np.log2(n)).astype(np.uint8)
    return out


def slot_of(h: np.ndarray, bits: int = BITMAP_BITS) -> np.ndarray:
    return (h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def bitmap(df: DataFrame, column: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of 2**bits slots in which the slot of each long of a column is set.

    Other values may share slots: a member is always found, a non-member seldom.
    """
    block = min(16, bits)

    def slots(batches):
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(slot_of(h, bits)).astype(np.int64))], ["slot"])

    def packed(key, table):
        has = np.zeros(1 << block, bool)
        has[table.column("slot").to_numpy() & ((1 << block) - 1)] = True
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(has).tobytes()], pa.binary())})

    rows = (
        df.select(column).where(F.col(column).isNotNull()).mapInArrow(slots, "slot long").distinct()
        .withColumn("block", F.shiftright("slot", block)).groupBy("block").applyInArrow(packed, "block long, bits binary").collect()
    )
    out = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (block - 3)
    for r in rows:
        out[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = slot_of(h, int(len(bits) * 8).bit_length() - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (slot & np.uint64(7)).astype(np.uint8))) & np.uint8(1) > 0

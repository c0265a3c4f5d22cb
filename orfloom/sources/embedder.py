"""Embedders around models that take a list of sequences: batches by residues, one model a worker."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a model is not shown: the stop at a protein's end.
STOPS = str.maketrans("", "", "*")
# Models of fewer letters read U, Z and O as X and leave B out.
RARE = str.maketrans("UZO", "XXX", "*B")

#: Models of this worker, by embedder; a worker serves many tasks.
_LOADED: dict[str, Callable] = {}


def _model(key: str, load: Callable) -> Callable:
    """The worker's model; a function of the module, because a nested one travels with its own copy of _LOADED."""
    if key not in _LOADED:
        _LOADED[key] = load()
    return _LOADED[key]


def batches(lengths: list[int], max_residues: int) -> Iterator[list[int]]:
    """Rows by falling length in batches whose padded size, rows by the longest, is at most max_residues; a longer row goes alone."""
    part: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        if part and (len(part) + 1) * lengths[part[0]] > max_residues:
            yield part
            part = []
        part.append(i)
    if part:
        yield part


def embed_part(model: Callable, seqs: list[str], too_large: tuple) -> list:
    """A batch's vectors; where it is too large for the model, those of its halves."""
    try:
        out = model(seqs)
    except too_large:
        if len(seqs) == 1:
            raise
        half = len(seqs) // 2
        return embed_part(model, seqs[:half], too_large) + embed_part(model, seqs[half:], too_large)
    if len(out) != len(seqs):
        raise ValueError(f"the model gave {len(out)} vectors for {len(seqs)} sequences")
    return [np.asarray(v, np.float64) for v in out]


def batched(load: Callable[[], Callable], max_residues: int = 1000, letters: dict = STOPS, too_large: tuple = (MemoryError,)) -> Callable[[Column], Column]:
    """An embedder for register_embedder: load() gives a model, which takes a list of sequences and gives a vector for each.

    A worker loads the model once and keeps it.  Rows of an Arrow batch (at most
    spark.sql.execution.arrow.maxRecordsPerBatch) are put in order of length, the
    longest first, so that the largest batch is tried first and little is padded;
    results come back in the rows' order.  A batch that raises one of too_large is
    split in half and tried again; a sequence that is too large alone ends the job.
    letters is a table for str.translate.  Null and empty sequences, and those
    that have no letter left, give null.
    """
    key = uuid.uuid4().hex

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            model = _model(key, load)
            seqs = [s.translate(letters) if isinstance(s, str) else "" for s in part]
            out: list = [None] * len(seqs)
            rows = [i for i, s in enumerate(seqs) if s]
            for own in batches([len(seqs[i]) for i in rows], max_residues):
                at = [rows[i] for i in own]
                for i, v in zip(at, embed_part(model, [seqs[i] for i in at], too_large)):
                    out[i] = v
            yield pd.Series(out, dtype=object)

    return run

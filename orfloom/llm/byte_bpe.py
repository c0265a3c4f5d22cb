"""Byte-level BPE by merge replay over the distinct pieces of a slice of the corpus.

Texts are split by the tokenizer's pattern.  The distinct new pieces of a chunk
lie in one symbol array; an inverted index maps each merge's rank to the places
of its pair.  Ranks are applied in ascending order, each to all of its places at
once, and only the neighbours of a merge get new pairs and new index entries.
Where a merge makes a pair of a lower rank than its own (some vocabularies have
such pairs), the order of merges within the piece matters, and that piece is
done again alone, always the lowest and leftmost pair first.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orfloom.llm import scratch
from orfloom.llm.textops import chunks

#: Bytes of text whose new pieces are replayed together.
CHUNK_BYTES = 6 << 20
#: Distinct pieces that a task remembers.
CACHE_PIECES = 600_000

_NONE = np.int64(1 << 40)


class _Numbers(dict):
    """Piece -> number in order of appearance; new pieces are kept apart too."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece):
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


class MergeReplay:
    """Encoder for a table of token bytes -> rank, and a pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.bytes_of = {r: t for t, r in ranks.items()}
        key, value = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    key.append(a << 20 | b)
                    value.append(rank)
        order = np.argsort(key)
        self.key, self.value = np.array(key, np.int64)[order], np.array(value, np.int64)[order]
        self.pairs = dict(zip(key, value))
        self.clear()

    @classmethod
    def from_file(cls, path: str, pattern: str) -> MergeReplay:
        """From lines of a base64 token and its rank."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    def clear(self) -> None:
        self.number = _Numbers()
        self.ids, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or _NONE."""
        k = a << 20 | b
        at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        return np.where(self.key[at] == k, self.value[at], _NONE) if len(self.key) else np.full(len(k), _NONE)

    def _alone(self, piece: bytes) -> list[int]:
        s = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        while len(s) > 1:
            rank, i = min((self.pairs.get(s[i] << 20 | s[i + 1], _NONE), i) for i in range(len(s) - 1))
            if rank == _NONE:
                break
            s[i : i + 2] = [rank]
        return s

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of ids of each); a piece that is a token is that token."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        piece = np.repeat(np.arange(len(pieces)), size)
        tok = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(tok)
        last = np.cumsum(size) - 1
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[last] = -1
        prv[last - size + 1] = -1
        live = np.ones(n, bool)
        cur = np.full(n, _NONE)
        at = np.flatnonzero(nxt >= 0)
        cur[at] = self._rank(tok[at], tok[nxt[at]])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def put(places):
            places = places[cur[places] < _NONE]
            if not len(places):
                return
            r = cur[places]
            order = np.argsort(r, kind="stable")
            places, r = places[order], r[order]
            cut = np.flatnonzero(np.diff(r)) + 1
            for part, rank in zip(np.split(places, cut), r[np.concatenate([[0], cut])].tolist()):
                if rank in index:
                    index[rank].append(part)
                else:
                    index[rank] = [part]
                    heapq.heappush(heap, rank)

        put(at)
        odd: set[int] = set()
        while heap:
            rank = heapq.heappop(heap)
            got = index.pop(rank)
            p = got[0] if len(got) == 1 else np.unique(np.concatenate(got))
            p = p[live[p] & (cur[p] == rank)]
            if not len(p):
                continue
            if len(p) > 1 and (touch := nxt[p][:-1] == p[1:]).any():  # runs of one symbol: every second place
                keep = np.ones(len(p), bool)
                for i in np.flatnonzero(touch):
                    if keep[i]:
                        keep[i + 1] = False
                p = p[keep]
            q = nxt[p]
            live[q] = False
            cur[q] = _NONE
            tok[p] = rank
            after = nxt[q]
            nxt[p] = after
            has = after >= 0
            prv[after[has]] = p[has]
            cur[p] = _NONE
            right = p[has]
            cur[right] = self._rank(tok[right], tok[nxt[right]])
            left = prv[p]
            left = left[left >= 0]
            cur[left] = self._rank(tok[left], tok[nxt[left]])
            touched = np.unique(np.concatenate([left, right]))
            low = touched[cur[touched] < rank]
            if len(low):
                odd.update(piece[low].tolist())
            put(touched)
        count = np.bincount(piece[live], minlength=len(pieces))
        ids = tok[live]
        whole = [(i, [r]) for i, t in enumerate(pieces) if (r := self.ranks.get(t)) is not None and count[i] != 1]
        fixed = dict([(i, self._alone(pieces[i])) for i in odd] + whole)
        if fixed:
            parts = np.split(ids, np.cumsum(count)[:-1])
            for i, s in fixed.items():
                parts[i], count[i] = np.array(s, np.int64), len(s)
            ids = np.concatenate(parts)
        return ids, count

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each text's)."""
        if len(self.number) > CACHE_PIECES:
            self.clear()
        number, find = self.number, self.pattern.findall
        own, bound = [], [0]
        for t in texts:
            found = find(t)
            own.append(np.fromiter(map(number.__getitem__, found), np.int64, len(found)))
            bound.append(bound[-1] + len(found))
        if number.new:
            ids, sizes = self.replay([p.encode("utf-8") for p in number.new])
            number.new.clear()
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        own = np.concatenate(own) if own else np.zeros(0, np.int64)
        begin = np.cumsum(self.sizes) - self.sizes
        size = self.sizes[own]
        upto = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.repeat(begin[own] - upto[:-1], size) + np.arange(upto[-1])], upto[np.array(bound)]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, ids (binary: little-endian unsigned 32-bit ids of the whole text).

    The same ids as encoding each match of the pattern by always merging the
    leftmost pair of lowest rank, no special tokens.  A null text is empty and
    has no ids; repeated rows repeat; a null id passes through; an empty table
    gives an empty result; further columns are not read.
    """
    scratch.small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches):
        encoder = MergeReplay.from_file(ranks_path, pattern)
        for batch in batches:
            ids = batch.column("id")
            for first, part in chunks(batch.column("text").cast(pa.binary()).to_pylist(), CHUNK_BYTES):
                tokens, bound = encoder.encode([t.decode("utf-8") for t in part])
                tokens = tokens.astype("<u4")
                out = pa.array([tokens[bound[i] : bound[i + 1]].tobytes() for i in range(len(part))], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(part)), out], ["id", "ids"])

    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return src.mapInArrow(rows, f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with decoded (binary): the bytes of its ids; null ids give null."""

    def rows(batches):
        with open(ranks_path, "rb") as f:
            table = {int(b): base64.b64decode(a) for a, b in (line.split() for line in f if line.strip())}
        get = table.__getitem__
        for batch in batches:
            out = [None if x is None else b"".join(map(get, np.frombuffer(x, "<u4").tolist())) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(rows, f"{schema}, decoded binary")

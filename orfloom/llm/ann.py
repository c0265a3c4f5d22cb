"""Approximate nearest neighbours by balanced posting lists.

Largest inner product becomes nearest point: vectors of about one length (a
factor of two: a stratum) are divided by the stratum's bound and get one more
component that makes them unit vectors, so one very long vector does not press
all others together.  A bounded sample is clustered by hierarchical balanced
k-means; every vector goes to its nearest centroid's list and, near a boundary,
to others that are not much farther.  A query finds centroids by a best-first
walk on their neighbour graph, which each task holds in memory, and visits the
lists whose distance ratio to the first few is small (not to the nearest alone:
a query that lies on a centroid would visit no other list).

How many lists, which ratio and how wide a walk is measured, not fixed:
CALIBRATE queries are answered by brute force over all vectors, and each
stratum's limits are those that would have found TARGET of their neighbours, and
OWN of each query's own for all but a few of the queries; the
walk is widened, up to all centroids, until it finds WALK of what they give.  So recall holds on tables of
any size and kind, and it is the work that grows where vectors are hard to
tell apart.  A query whose lists hold fewer than k vectors is answered exactly.

Lists that are close together share a cell, the unit that is shuffled; large
cells are split into parts and a cell's queries into blocks, so no task holds a
hot one.  Equal vectors are one node with its k + 1 smallest ids: no others can
be among anyone's k nearest.  Scores are exact, in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orfloom.llm import scratch

#: Vectors that the centroids are fitted on, at most; the vectors to a centroid; centroids at most.
SAMPLE, PER_CENTROID, MAX_CENTROIDS = 131_072, 32, 4096
#: Lists that a vector may be in, and how much farther (distance ratio) the others may be.
REPLICAS, BOUNDARY = 4, 1.15
#: Queries that are answered by brute force to set the limits, and the share of their neighbours to be found
#: by the number of lists and by the distance ratio each; OWN of its own are found for MOST of the queries.
CALIBRATE, TARGET, OWN, MOST = 512, 0.995, 0.95, 0.99
#: Ratios are taken to the distance of this nearest centroid.
BASE = 8
#: Neighbours in the centroid graph, least width of the walk, and the share of what all centroids would find that it must.
DEGREE, BEAM, WALK = 24, 128, 0.995
#: Vectors in a cell, about, and in a part of one; queries in a block.
CELL_ROWS, PART_ROWS, BLOCK_ROWS = 8192, 16_384, 4096
#: Share of the rows from which a range of lengths is a stratum of its own.
STRATUM_SHARE = 1 / 32


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T - 0.5 * (c * c).sum(1), 1)
        n = np.bincount(near, minlength=k)
        for j in np.flatnonzero(n == 0):  # an empty cluster takes half of the largest
            big = np.flatnonzero(near == int(np.argmax(n)))
            near[big[::2]] = j
            n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = total / np.maximum(n, 1)[:, None]
    return c


def fit_centroids(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """About k centroids of about equal clusters, close ones next to each other: clusters are clustered again."""
    rng = np.random.default_rng(seed)
    k = int(np.clip(k, 1, len(x)))
    top = max(1, int(np.sqrt(k)))
    first = _kmeans(x, top, rng)
    near = np.argmax(x @ first.T - 0.5 * (first * first).sum(1), 1)
    out = []
    for j in range(top):
        own = x[near == j]
        if len(own):
            out.append(_kmeans(own, int(np.clip(round(k * len(own) / len(x)), 1, len(own))), rng))
    return np.concatenate(out)


def _graph(c: np.ndarray, degree: int) -> np.ndarray:
    out = np.zeros((len(c), min(degree, max(1, len(c) - 1))), np.int64)
    for a in range(0, len(c), 512):
        d = (c * c).sum(1)[None] - 2 * c[a : a + 512] @ c.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out[a : a + 512] = np.argsort(d, 1)[:, : out.shape[1]] if len(c) > 1 else 0
    return out


def search_graph(q: np.ndarray, c: np.ndarray, graph: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, squared distances) that best-first walks from spread starts find, nearest first."""
    k, n = len(c), len(q)
    norm = (c * c).sum(1)
    beam = min(beam, k)
    step = max(8, beam // 16)
    starts = np.unique(np.linspace(0, k - 1, min(k, max(16, beam))).astype(np.int64))
    found = np.tile(starts, (n, 1))
    dist = norm[starts][None] - 2 * q @ c[starts].T
    seen = np.zeros((n, k), bool)
    seen[:, starts] = True
    done = np.zeros((n, k), bool)
    row = np.arange(n)[:, None]
    while True:
        order = np.argsort(dist, 1)[:, :beam]
        found, dist = np.take_along_axis(found, order, 1), np.take_along_axis(dist, order, 1)
        wait = ~done[row, found] & np.isfinite(dist)
        if not wait.any():
            return found, dist + (q * q).sum(1)[:, None]
        pick = np.argsort(~wait, 1, kind="stable")[:, :step]  # the nearest that were not expanded
        at = np.take_along_axis(found, pick, 1)
        live = np.take_along_axis(wait, pick, 1)
        done[row, at] |= live
        new = graph[at].reshape(n, -1)
        ok = np.repeat(live, graph.shape[1], 1) & ~seen[row, new]
        seen[np.nonzero(ok)[0], new[ok]] = True
        new = np.sort(np.where(ok, new, k), 1)  # one entry for each centroid
        ok = new < k
        ok[:, 1:] &= new[:, 1:] != new[:, :-1]
        i, j = np.nonzero(ok)
        d = np.full(new.shape, np.inf, dist.dtype)
        at = new[i, j]
        d[i, j] = norm[at] - 2 * np.einsum("pd,pd->p", q[i], c[at])
        found, dist = np.concatenate([found, np.where(ok, new, 0)], 1), np.concatenate([dist, d], 1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def exponents(x: np.ndarray) -> np.ndarray:
    """log2 of each row's length, rounded; lengths of any size."""
    most = np.abs(x).max(1)
    return np.rint(np.log2(most) + 0.5 * np.log2(((x / most[:, None]) ** 2).sum(1))).astype(np.int64)


def strata_of(counts: dict[int, int]) -> np.ndarray:
    """Rising upper ends of the ranges of exponents: one with STRATUM_SHARE of the rows is a range of its own, those between two such are one."""
    total, ends = sum(counts.values()), []
    held = False
    for e in sorted(counts):
        big = counts[e] >= STRATUM_SHARE * total
        if big or not held:
            ends.append(e)
        else:
            ends[-1] = e
        held = not big
    return np.array(ends, np.int64)


def _direction(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]
    x = x / np.sqrt((x * x).sum(1))[:, None]
    return np.concatenate([x, np.zeros((len(x), 1))], 1).astype(np.float32)


def _base(dist: np.ndarray) -> np.ndarray:
    """The squared distance that ratios are taken to, of rows with their nearest centroids first."""
    b = min(BASE, dist.shape[1]) - 1
    near = np.where(np.isfinite(dist[:, b]), dist[:, b], dist[:, 0])
    return np.maximum(near, 1e-9)[:, None]


def _enough(x: np.ndarray, query: np.ndarray) -> float:
    """The limit that holds TARGET of all values, and OWN of each query's values for MOST of the queries."""
    each = [np.quantile(x[query == q], OWN, method="higher") for q in np.unique(query)]
    return max(np.quantile(x, TARGET, method="higher"), np.quantile(each, MOST, method="higher"))


@dataclass
class Index:
    """What each task holds: the strata, their centroids with graphs, the lists' cells, and how far queries go."""

    ends: np.ndarray  # upper exponent of each stratum
    centroids: list[np.ndarray]
    graphs: list[np.ndarray]
    offset: np.ndarray  # first list of each stratum
    cell: np.ndarray  # cell of each list
    size: np.ndarray  # rows of each list
    probes: np.ndarray  # lists that a query visits in each stratum, at most
    ratio: np.ndarray  # the distance ratio beyond which it does not
    beam: np.ndarray  # width of the walk in each stratum

    def stratum(self, x: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.ends, exponents(x)), len(self.ends) - 1)

    def unit(self, x: np.ndarray, s: int) -> np.ndarray:
        x = np.ldexp(x, -int(self.ends[s])) / np.sqrt(2.0)
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))[:, None]], 1).astype(np.float32)

    def lists_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): the posting lists of each vector."""
        rows, lists = [], []
        own = self.stratum(x)
        for s in np.unique(own):
            at = np.flatnonzero(own == s)
            c, u = self.centroids[s], self.unit(x[at], s)
            d = 2 * np.maximum(0.5 * (u * u).sum(1)[:, None] - u @ c.T + 0.5 * (c * c).sum(1), 0)
            few = min(REPLICAS, len(c))
            near = np.argpartition(d, few - 1, 1)[:, :few]
            dist = np.take_along_axis(d, near, 1)
            i, j = np.nonzero(dist <= BOUNDARY**2 * dist.min(1)[:, None] + 1e-12)
            rows.append(at[i])
            lists.append(self.offset[s] + near[i, j])
        return np.concatenate(rows), np.concatenate(lists)

    def probes_of(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): the lists that each query visits; they hold more than k vectors if there are any."""
        q = _direction(x)
        rows, lists, held = [], [], np.zeros(len(q), np.int64)
        largest = int(np.argmax([len(c) for c in self.centroids]))
        for s in sorted(range(len(self.ends)), key=lambda s: s == largest):
            c, p = self.centroids[s], int(self.probes[s])
            found, dist = search_graph(q, c, self.graphs[s], int(self.beam[s]))
            go = (np.arange(found.shape[1])[None] < p) & (dist <= self.ratio[s] ** 2 * _base(dist) + 1e-12)
            size = self.size[self.offset[s] + found]
            if s == largest:  # a vector is in REPLICAS lists at most, so these hold k + 1 different ones
                upto = held[:, None] + np.cumsum(size, 1) - size
                go |= upto < REPLICAS * (k + 1)
            go &= np.isfinite(dist)
            held += (size * go).sum(1)
            i, j = np.nonzero(go)
            rows.append(i)
            lists.append(self.offset[s] + found[i, j])
        return np.concatenate(rows), np.concatenate(lists)

    def calibrate(self, q: np.ndarray, at: np.ndarray, near: np.ndarray) -> None:
        """Set probes and ratio from queries q and their true neighbours: vector near[i] is one of query at[i]."""
        self.probes, self.ratio, self.beam = np.ones(len(self.ends), np.int64), np.ones(len(self.ends)), np.full(len(self.ends), BEAM)
        if not len(near):
            return
        d = [np.maximum(2 - 2 * _direction(q) @ c.T + ((c * c).sum(1) - 1)[None], 0) for c in self.centroids]
        rank = [np.argsort(np.argsort(x, 1, kind="stable"), 1) for x in d]
        own, (i, lists) = self.stratum(near), self.lists_of(near)
        s = own[i]
        place, ratio = np.zeros(len(i), np.int64), np.zeros(len(i))
        for t in np.unique(s):
            m = s == t
            local = lists[m] - self.offset[t]
            place[m] = rank[t][at[i[m]], local]
            base = _base(np.partition(d[t], min(BASE, d[t].shape[1]) - 1, 1))[:, 0]
            ratio[m] = np.sqrt(d[t][at[i[m]], local] / base[at[i[m]]])
        first = np.lexsort((place, i))  # the nearest of each neighbour's lists
        first = first[np.concatenate([[True], np.diff(i[first]) != 0])]
        place, ratio, s, i, lists = place[first], ratio[first], s[first], i[first], lists[first]
        for t in np.unique(s):
            self.probes[t], self.ratio[t] = (_enough(x[s == t], at[i[s == t]]) for x in (place + 1, ratio * (1 + 1e-6)))
            held = (s == t) & (place < self.probes[t])
            row, wanted, c = at[i[held]], lists[held] - self.offset[t], self.centroids[t]
            beam = max(BEAM, int(self.probes[t]))
            while beam < len(c):
                found, _ = search_graph(_direction(q), c, self.graphs[t], beam)
                visited = np.zeros((len(q), len(c)), bool)
                visited[np.arange(len(q))[:, None], found[:, : self.probes[t]]] = True
                if visited[row, wanted].mean() >= WALK:
                    break
                beam *= 2
            self.beam[t] = beam


def _by_cell(row: np.ndarray, lists: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """(row, cell, its lists there), one entry for each cell that a row touches."""
    own = cell[lists]
    order = np.lexsort((lists, own, row))
    row, lists, own = row[order], lists[order], own[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(own) != 0)])) if len(row) else np.zeros(0, np.int64)
    offsets = np.concatenate([new, [len(row)]]).astype(np.int32)
    return row[new], own[new], pa.ListArray.from_arrays(pa.array(offsets), pa.array(lists.astype(np.int32)))


def _placed(index, k: int | None):
    """Rows (cell, id, v, lists): of vectors, or of queries (k given)."""

    def rows(batches):
        own = index.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                x = _matrix(part.column("v"))
                i, cell, lists = _by_cell(*(own.lists_of(x) if k is None else own.probes_of(x, k)), own.cell)
                take = pa.array(i)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), part.column("id").take(take), part.column("v").take(take), lists], ["cell", "id", "v", "lists"])

    return rows


def _top(q: np.ndarray, qid: np.ndarray, v: np.ndarray, vid: np.ndarray, k: int, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of each query's k best, best first, ties to the smaller id.

    A matrix product finds the candidates, near ties included; their scores are
    plain sums in one order, so equal vectors get equal scores.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        s = q @ v.T
        slack = 1e-12 * np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1).max(initial=0))
    s[~np.isfinite(s)] = 0
    slack = np.where(np.isfinite(slack), slack, np.inf)
    out = qid[:, None] == vid[None]
    if seen is not None:
        out |= ~seen
    s[out] = -np.inf
    least = -np.partition(-s, k - 1, 1)[:, k - 1] - slack if s.shape[1] > k else np.full(len(q), -np.inf)
    i, j = np.nonzero((s >= least[:, None]) & ~out)
    exact = np.concatenate([np.zeros(0)] + [np.einsum("pd,pd->p", q[i[a : a + 65536]], v[j[a : a + 65536]]) for a in range(0, len(i), 65536)])
    order = np.lexsort((vid[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], exact[keep]


_FOUND = "query_id long, vec_ids array<long>, scores array<double>"


def _packed(qid: np.ndarray, i: np.ndarray, ids: np.ndarray, score: np.ndarray) -> list[pa.Array]:
    """Arrays of _FOUND from entries that are sorted by query."""
    new = np.flatnonzero(np.concatenate([[True], np.diff(i) != 0])) if len(i) else np.zeros(0, np.int64)
    offsets = pa.array(np.concatenate([new, [len(i)]]).astype(np.int32))
    return [pa.array(qid[i[new]], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(score, pa.float64()))]


def _lists_matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy())), column.flatten().to_numpy()


def _best_of_part(k: int):
    """The k best of each query of a block among the vectors of a cell's part that are in the lists it visits."""

    def best(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        parts = []
        if queries.num_rows and vectors.num_rows:
            qs, vs = queries.combine_chunks().to_batches()[0], vectors.combine_chunks().to_batches()[0]
            q, v, qid, vid = _matrix(qs.column("v")), _matrix(vs.column("v")), qs.column("id").to_numpy(), vs.column("id").to_numpy()
            names = np.unique(vs.column("lists").flatten().to_numpy())
            i, lists = _lists_matrix(vs.column("lists"))
            slot = np.arange(len(i)) - np.searchsorted(i, i)
            of = np.full((len(v), REPLICAS), len(names))  # the last column stands for no list
            of[i, slot] = np.searchsorted(names, lists)
            i, lists = _lists_matrix(qs.column("lists"))
            known = np.isin(lists, names)
            visits = np.zeros((len(q), len(names) + 1), bool)
            visits[i[known], np.searchsorted(names, lists[known])] = True
            for a in range(0, len(q), 256):
                seen = visits[a : a + 256][:, of[:, 0]]
                for r in range(1, REPLICAS):
                    seen |= visits[a : a + 256][:, of[:, r]]
                i, j, score = _top(q[a : a + 256], qid[a : a + 256], v, vid, k, seen)
                parts.append(_packed(qid[a : a + 256], i, vid[j], score))
        columns = [pa.concat_arrays(x) for x in zip(*parts)] if parts else _packed(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table(dict(zip(("query_id", "vec_ids", "scores"), columns)))

    return best


def _merged(found: DataFrame, k: int) -> DataFrame:
    each = found.select("query_id", F.explode(F.arrays_zip("vec_ids", "scores")).alias("x")).select("query_id", F.col("x.vec_ids").alias("vec_id"), F.col("x.scores").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    each = each.dropDuplicates(["query_id", "vec_id"])  # a replica's score is the same
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_nearest(nodes: DataFrame, asked: list, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) by brute force: a block of queries, (id, v) rows of bounded number, against all nodes (id, v)."""
    spark = nodes.sparkSession
    block = spark.sparkContext.broadcast((np.array([r["id"] for r in asked], np.int64), np.array([r["v"] for r in asked], np.float64)))

    def rows(batches):
        qid, q = block.value
        i, ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                vid = part.column("id").to_numpy()
                new_i, j, s = _top(q, qid, _matrix(part.column("v")), vid, k)
                i, ids, score = np.concatenate([i, new_i]), np.concatenate([ids, vid[j]]), np.concatenate([score, s])
                order = np.lexsort((ids, -score, i))
                i, ids, score = i[order], ids[order], score[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                i, ids, score = i[keep], ids[keep], score[keep]
        if len(i):
            yield pa.RecordBatch.from_arrays(_packed(qid, i, ids, score), ["query_id", "vec_ids", "scores"])

    return _merged(nodes.select("id", "v").mapInArrow(rows, _FOUND), k)


def _strata(nodes: DataFrame) -> dict[int, int]:
    """Rows by exponent: at most as many as a double has exponents."""

    def rows(batches):
        for batch in batches:
            e, n = np.unique(exponents(_matrix(batch.column("v"))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(e, pa.int64()), pa.array(n, pa.int64())], ["e", "n"])

    return {r["e"]: r["n"] for r in nodes.select("v").mapInArrow(rows, "e long, n long").groupBy("e").agg(F.sum("n").alias("n")).collect()}


def _fit(nodes: DataFrame, counts: dict[int, int], sample: int) -> Index:
    """An index without limits and list sizes, fitted on a sample of at most ``sample`` rows (by hash of the id)."""
    ends, total = strata_of(counts), sum(counts.values())
    in_stratum = [sum(n for e, n in counts.items() if np.searchsorted(ends, e) == s) for s in range(len(ends))]
    share = min(1.0, 1.2 * sample / total)
    some = nodes.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) <= F.lit(int(share * (1 << 20)))).orderBy(F.xxhash64("id"), "id").limit(sample).select("v").coalesce(1)
    blank = Index(ends, [], [], np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0))

    def fit(batches):
        x = [_matrix(b.column("v")) for b in batches]
        if not x:
            return
        x = np.concatenate(x)
        own = blank.stratum(x)
        for s in np.unique(own):
            u = blank.unit(x[own == s], s)
            c = fit_centroids(u, min(len(u) // PER_CENTROID, max(1, MAX_CENTROIDS * len(u) // len(x))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(c), s)), pa.array(np.arange(len(c))), pa.array(list(c), pa.list_(pa.float32())), pa.array(list(_graph(c, DEGREE)), pa.list_(pa.int64()))], ["s", "i", "c", "g"]
            )

    fitted = sorted(some.mapInArrow(fit, "s long, i long, c array<float>, g array<long>").collect(), key=lambda r: (r["s"], r["i"]))
    dim = len(fitted[0]["c"])
    centroids, graphs, cells, first_cell = [], [], [], 0
    for s in range(len(ends)):
        own = [r for r in fitted if r["s"] == s]
        # A stratum that the sample misses is one list.
        centroids.append(np.array([r["c"] for r in own], np.float32) if own else np.zeros((1, dim), np.float32))
        graphs.append(np.array([r["g"] for r in own], np.int64) if own else np.zeros((1, 1), np.int64))
        n, lists = -(-in_stratum[s] // CELL_ROWS), len(centroids[-1])
        cells.append(first_cell + np.arange(lists) * min(n, lists) // lists)
        first_cell = int(cells[-1][-1]) + 1
    offset = np.concatenate([[0], np.cumsum([len(c) for c in centroids])])[:-1]
    return Index(ends, centroids, graphs, offset, np.concatenate(cells), np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0))


def _calibrate(index: Index, nodes: DataFrame, asked: DataFrame, k: int) -> None:
    some = asked.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(CALIBRATE).collect()
    truth = exact_nearest(nodes, some, k).select("query_id", "vec_id").collect()
    wanted = asked.sparkSession.createDataFrame([(i,) for i in sorted({r["vec_id"] for r in truth})], "id long")
    vector = {r["id"]: r["v"] for r in nodes.join(F.broadcast(wanted), "id", "left_semi").collect()}  # at most CALIBRATE * k
    place = {r["id"]: i for i, r in enumerate(some)}
    index.calibrate(np.array([r["v"] for r in some], np.float64), np.array([place[r["query_id"]] for r in truth], np.int64), np.array([vector[r["vec_id"]] for r in truth], np.float64))


def _valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): one vector for each id, the largest in array order."""
    v = F.col(vector_col)
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    return rows.groupBy("id").agg(F.max("v").alias("v"))


def _empty(spark: SparkSession) -> DataFrame:
    fields = (("query_id", T.LongType()), ("rank", T.IntegerType()), ("vec_id", T.LongType()), ("score", T.DoubleType()))
    return spark.createDataFrame([], T.StructType([T.StructField(n, t) for n, t in fields]))


def nearest(
    vectors: DataFrame, queries: DataFrame | None = None, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest found, by inner product.

    queries defaults to the rows whose id is divisible by 20.  A query's own id
    is no candidate; ties go to the smaller id; every query gets k rows, or all
    candidates if there are fewer.  Ids are integers (another type raises
    TypeError).  Rows with a null id, a null, zero or empty vector, a null or
    non-finite component, or another length than most take no part; rows with
    one id are one candidate, the largest of their vectors in array order.
    Empty tables give an empty result; further columns are not read.  A product
    that is too large for a double counts as infinite.
    """
    spark = vectors.sparkSession
    for df in (vectors, *([] if queries is None else [queries])):
        if not isinstance(df.schema[id_col].dataType, T.IntegralType):
            raise TypeError(f"{id_col} must be an integer column")
    asked = _valid(vectors.where(F.col(id_col) % 20 == 0) if queries is None else queries, id_col, vector_col)
    rows = _valid(vectors, id_col, vector_col)
    dims = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not dims:
        return _empty(spark)
    asked = scratch.table(asked.where(F.size("v") == dims[0]["dim"]), "queries")
    copies = Window.partitionBy("v").orderBy("id")
    rows = rows.where(F.size("v") == dims[0]["dim"]).withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy")
    nodes = scratch.table(rows, "vectors")

    index = _fit(nodes, _strata(nodes), sample)
    shared = spark.sparkContext.broadcast(index)
    kind = nodes.schema["v"].dataType.simpleString()
    lists = scratch.table(nodes.mapInArrow(_placed(shared, None), f"cell long, id long, v {kind}, lists array<int>"), "lists")
    sizes = {r["l"]: r["count"] for r in lists.select(F.explode("lists").alias("l")).groupBy("l").count().collect()}  # a row for each centroid
    index.size = np.array([sizes.get(i, 0) for i in range(len(index.cell))], np.int64)
    _calibrate(index, nodes, asked, k)
    shared = spark.sparkContext.broadcast(index)
    kind = asked.schema["v"].dataType.simpleString()
    probes = scratch.table(asked.mapInArrow(_placed(shared, k), f"cell long, id long, v {kind}, lists array<int>"), "probes")

    # At most one row for each cell: how many parts it has, and its queries blocks.
    parts = lists.groupBy("cell").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    blocks = probes.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    plan = F.broadcast(parts.join(blocks, "cell"))
    spread = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = probes.join(plan, "cell").withColumn("block", spread("blocks")).select("id", "v", "lists", "cell", "block", every("parts").alias("part"))
    right = lists.join(plan, "cell").withColumn("part", spread("parts")).select("id", "v", "lists", "cell", "part", every("blocks").alias("block"))
    keys = ["cell", "part", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_best_of_part(k), _FOUND)
    found = scratch.table(_merged(found, k), "found")

    # Queries that got fewer than k: all candidates, in blocks of queries.
    short = asked.join(found.where(F.col("rank") == k).select(F.col("query_id").alias("id")), "id", "left_anti")
    n_short = short.count()
    if not n_short:
        return found
    n_blocks = -(-n_short // BLOCK_ROWS)
    short = scratch.table(short.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks))), "short")
    out = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti")
    for b in range(n_blocks):
        out = out.union(exact_nearest(nodes, short.where(F.col("block") == b).collect(), k))
    return out

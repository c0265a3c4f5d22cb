"""Bisecting 2-means that splits mixed-label clusters first, and cluster metrics."""

from __future__ import annotations

import gc
import heapq
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orfloom.operators import metric
from orfloom.operators.relational import checkpoints
from orfloom.operators.vectors import _edge_kernel, _matrix, distances, euclidean, in_blocks, knn

#: Rows of a cluster up to which one task splits it; larger ones take a pass over the rows for each round.
TASK_ROWS = 20_000
#: Rows of a larger cluster's block; bytes of vectors that are worth a task of a round, and that a task reads at most.
BLOCK_ROWS, LEAST_BYTES, TASK_BYTES = 2048, 8 << 20, 64 << 20
#: Rows beside the border of a large cluster's start (at most an eighth) that one task moves on with, and rounds that it makes with them.
BORDER_ROWS, BORDER_ROUNDS = 10_000, 64


def _assign(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(side, squared distance) of each row to the nearer of two centers."""
    d = np.stack([((x - c[k]) ** 2).sum(1) for k in (0, 1)], 1)
    side = d.argmin(1)
    return side, d[np.arange(len(x)), side]


def _sides(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of each pair of centers (t, 2, dims), 0/1 for each row as by _assign: by the sign of a matrix product, near 0 by plain differences."""
    w, mid = c[:, 1] - c[:, 0], (c[:, 0] + c[:, 1]) / 2
    f = w @ x.T - (w * mid).sum(1)[:, None]
    reach = np.sqrt((w * w).sum(1)) * (np.sqrt(x.shape[1]) * np.abs(x).max(initial=0) + np.sqrt((mid * mid).sum(1)))
    side, near = f > 0, np.abs(f) <= 1e-11 * reach[:, None]
    for t in np.flatnonzero(near.any(1)):
        side[t, near[t]] = _assign(x[near[t]], c[t])[0]
    return side


def _off(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of each pair of centers (t, 2, dims), each row's signed distance from the border between them; 0 where both are one."""
    w, mid = c[:, 1] - c[:, 0], (c[:, 0] + c[:, 1]) / 2
    size = np.sqrt((w * w).sum(1))
    return (w @ x.T - (w * mid).sum(1)[:, None]) / np.where(size > 0, size, 1)[:, None]


def _sums(x: np.ndarray, side: np.ndarray, counted: np.ndarray | bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(rows, sum of rows) of each side of each start, of the rows counted: (t, 2) and (t, 2, dims)."""
    own = np.stack([~side & counted, side & counted], 1).astype(np.float64)
    return own.sum(2), (own.reshape(2 * len(own), len(x)) @ x).reshape(*own.shape[:2], -1)


def _means(n: np.ndarray, total: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The centers of the sides; an empty side keeps its center."""
    return np.where(n[..., None] > 0, total / np.maximum(n, 1)[..., None], before)


def _costs(x: np.ndarray, side: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.array([((x - c[t][side[t].astype(np.int64)]) ** 2).sum() for t in range(len(c))])


def _best(cost: np.ndarray) -> int | None:
    """The first start of the least cost; one partition found from two starts has two sums that differ in the last digits."""
    return int(np.argmax(cost <= cost.min() * (1 + 1e-9))) if np.isfinite(cost).any() else None


def _two_means(x: np.ndarray, starts: np.ndarray, rounds: int, half: np.ndarray) -> np.ndarray:
    """0/1 for each row: the best of several 2-means runs, one from each pair of centers; half, where all rows are at one place."""
    now, side, open_ = starts.copy(), np.zeros((len(starts), len(x)), bool), np.arange(len(starts))
    for k in range(rounds):
        new = _sides(x, now[open_])
        moved = (new != side[open_]).any(1) | (k == 0)
        side[open_] = new
        open_ = open_[moved]
        if not len(open_):
            break
        now[open_] = _means(*_sums(x, new[moved]), now[open_])
    if len(open_):  # the rounds ended before they came to rest
        side[open_] = _sides(x, now[open_])
    n = side.sum(1)
    best = _best(np.where((n > 0) & (n < len(x)), _costs(x, side, now), np.inf))
    return half if best is None else side[best].astype(np.int64)


def _starts(rows: DataFrame, members: DataFrame, n_init: int, seed: int) -> dict[int, np.ndarray]:
    """n_init pairs of rows of each node, the first and last by a seeded hash: (n_init, 2, dims) by node."""
    hashes = [F.struct(F.xxhash64("id", F.lit(seed + t)), F.col("id").alias("id")) for t in range(n_init)]
    picked = members.groupBy("node").agg(F.array(*[how(h)["id"] for h in hashes for how in (F.min, F.max)]).alias("ids"))
    found = rows.join(F.broadcast(picked.select("node", F.posexplode("ids").alias("at", "id"))), "id")
    by: dict = {}
    for r in found.select("node", "at", "v").collect():  # 2 * n_init rows for each cluster that is split in a pass
        by.setdefault(r["node"], {})[r["at"]] = r["v"]
    return {n: np.array([at[i] for i in range(2 * n_init)], np.float64).reshape(n_init, 2, -1) for n, at in by.items()}


def _vectors_of(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    v = t.column("v")
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return v.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)


def _blocks(rows: DataFrame, sizes: dict[int, int], dims: int) -> DataFrame:
    """(node, ids, x): the rows of nodes in blocks, x their vectors' bytes; written once, as each round reads them."""
    spark, kinds = rows.sparkSession, dict(rows.dtypes)
    n_blocks = {n: -(-size // BLOCK_ROWS) for n, size in sizes.items()}
    plan = spark.createDataFrame(sorted(n_blocks.items()), "node long, blocks long")  # as many rows as large clusters

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids = t.column("id").combine_chunks()
        half = pa.array([t.column("half").to_numpy().astype(np.int8).tobytes()], pa.binary())
        return pa.table({"node": t.column("node")[:1], "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "x": pa.array([_vectors_of(t).tobytes()], pa.binary()), "half": half})

    size = 8 * dims * sum(sizes.values())
    tasks = max(1, min(spark.sparkContext.defaultParallelism, size // LEAST_BYTES), size // TASK_BYTES)
    dealt = rows.join(F.broadcast(plan), "node").select("id", "v", "half", "node", F.pmod(F.xxhash64("id"), "blocks").alias("block")).repartition(tasks, "node", "block")
    return dealt.groupBy("node", "block").applyInArrow(pack, f"node long, ids array<{kinds['id']}>, x binary, half binary").checkpoint()


@cache
def _keep_loaded() -> None:
    """Once in a worker: it collects garbage after each task, and going through all loaded modules takes longer than a round's sums."""
    gc.freeze()


def _matrix_of(x: bytes, dims: int, width: str) -> np.ndarray:
    return np.frombuffer(x, width).reshape(-1, dims).astype(np.float64)


@dataclass
class _Run:
    """One start of a large node: centers after ``used`` rounds and, tried beyond them, ``path``; only path[0] is sure.

    The tried ones hold if no row farther than ``margin`` from the border of ``ref`` was on
    another side at any of them but the last.  closed: the path's last centers are final.
    """

    ref: np.ndarray
    path: np.ndarray
    margin: float
    used: int
    closed: bool
    width: float = 0.0  # of the border's strip for the next rounds, of which about BORDER_ROWS rows lie within


def _on_border(run: _Run, count: np.ndarray, total: np.ndarray, x: np.ndarray, rounds: int) -> tuple[list[np.ndarray], bool]:
    """(centers after each of up to ``rounds`` rounds, whether they came to rest) with only the rows x moving; it ends where these say that others may move."""
    steps, before = [], run.path[-1]
    first = _off(x, before[None])
    for _ in range(rounds):
        if steps and np.abs(_off(x, before[None]) - first).max(initial=0) > 0.9 * run.width:
            break
        n, own = _sums(x, _sides(x, before[None]))
        after = _means(count + n[0], total + own[0], before)
        steps.append(after)
        if np.isclose(before, after, rtol=1e-9, atol=1e-12).all():
            return steps, True
        if not len(x):
            break
        before = after
    return steps, False


def _large_centers(blocks: DataFrame, starts: dict[int, np.ndarray], rounds: int, width: str) -> dict[int, np.ndarray | None]:
    """The best pair of centers of each large node: rounds of sums over all rows, for all starts at once.

    A job reads the blocks, adds up within tasks and then by start, and gives the
    driver one row a start.  Where centers move little, only rows near the border
    change sides: a start's rows in a strip around it (at most about BORDER_ROWS)
    go to one task, which makes many rounds with them and the sums of the others.  The next
    job checks at each of these rounds that all others kept their side; where one did
    not, the start goes on from there.  So the centers are those of plain rounds.
    A start whose centers stay is left out from then on.  Jobs are an RDD's, as
    planning a query takes longer than a round of 100,000 rows.
    """
    dims = next(iter(starts.values())).shape[-1]
    now = {n: c.copy() for n, c in starts.items()}
    size = {r["node"]: r["n"] for r in blocks.groupBy("node").agg(F.sum(F.size("ids")).alias("n")).collect()}
    held = blocks.select("node", "x").rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)

    def summed(own):
        """Sums in the order of their tasks, so that the last digits do not depend on which came first."""
        parts = [got for _, got in sorted(own, key=lambda x: x[0])]
        return tuple(sum(xs[1:], xs[0]) for xs in zip(*parts, strict=True))

    def costs() -> dict[int, tuple]:
        def sums(part, rows):
            _keep_loaded()
            total: dict = {}
            for n, block in rows:
                x = _matrix_of(block, dims, width)
                side = _sides(x, now[n])
                got = (side.sum(1), _costs(x, side, now[n]))
                total[n] = tuple(a + b for a, b in zip(total[n], got, strict=True)) if n in total else got
            return ((n, (part, got)) for n, got in total.items())

        return dict(held.mapPartitionsWithIndex(sums).groupByKey(min(len(now), held.getNumPartitions())).mapValues(summed).collect())

    def advance(runs: dict[int, dict[int, _Run]]) -> dict:
        """By (node, start): the first place of the path that does not hold, or None; the centers of the rounds after it, whether they rest, and the strip of BORDER_ROWS rows."""

        most = max(256, 4 * BORDER_ROWS // held.getNumPartitions())

        def sums(part, rows):
            _keep_loaded()
            total: dict = {}
            for n, block in rows:
                if n not in runs:
                    continue
                x, own = _matrix_of(block, dims, width), list(runs[n].values())
                last = np.cumsum([len(r.path) for r in own]) - 1
                side, c = _sides(x, np.concatenate([r.path for r in own])), np.stack([r.path[-1] for r in own])
                off = np.abs(_off(x, c))
                strip = off < np.array([r.width for r in own])[:, None]
                count, added = _sums(x, side[last], ~strip)
                for k, (t, r) in enumerate(runs[n].items()):
                    first = last[k] + 1 - len(r.path)
                    moved = np.zeros(len(r.path) - 1, bool)
                    if len(moved):
                        far = np.abs(_off(x, r.ref[None])[0]) >= r.margin * (1 - 1e-9)
                        moved = (side[first : last[k], far] != _sides(x[far], r.ref[None])).any(1)
                    near = [x[strip[k]].astype(width)] if strip[k].any() else []
                    if (n, t) not in total:
                        share = int(len(x) * min(0.125, BORDER_ROWS / size[n]))
                        total[n, t] = [0, 0, np.zeros_like(moved), [], np.sort(off[k])[min(share, len(x) - 1)] if share else 0.0, False]
                    old = total[n, t]
                    old[:4] = old[0] + count[k], old[1] + added[k], old[2] | moved, old[3] + near
                    if sum(map(len, old[3])) > most:  # equal rows, for instance: no more than this round's sums
                        rest = np.concatenate(old[3]).astype(np.float64)
                        ones, own_ = _sums(rest, _sides(rest, c[k][None]))
                        old[0], old[1], old[3], old[5] = old[0] + ones[0], old[1] + own_[0], [], True
            return ((at, (part, got)) for at, got in total.items())

        def gone_on(item):
            (n, t), own = item
            run, parts = runs[n][t], [got for _, got in sorted(own, key=lambda x: x[0])]
            moved = np.logical_or.reduce([p[2] for p in parts])
            if moved.any():
                return (n, t), (int(moved.argmax()), [], False, 0.0)
            near = [x for p in parts for x in p[3]]
            x = np.concatenate([np.zeros((0, dims)), *near])
            many = len(x) and not any(p[5] for p in parts)
            steps, rest = _on_border(run, sum(p[0] for p in parts), sum(p[1] for p in parts), x, min(BORDER_ROUNDS if many else 1, rounds - run.used - len(run.path)))
            return (n, t), (None, steps, rest, float(np.median([p[4] for p in parts])))

        keys = sum(len(r) for r in runs.values())
        return dict(held.mapPartitionsWithIndex(sums).groupByKey(min(keys, held.getNumPartitions())).map(gone_on).collect())

    runs = {n: {t: _Run(c[t], c[t][None], 0.0, -1, rounds < 1) for t in range(len(c))} for n, c in now.items()}
    while runs := {n: r for n, r in runs.items() if r}:
        for (n, t), (bad, steps, rest, strip) in advance(runs).items():
            run = runs[n][t]
            if bad is not None:
                runs[n][t] = _Run(run.path[bad], run.path[bad : bad + 1], 0.0, run.used + bad, False)
                continue
            at, used = run.path[-1], run.used + len(run.path)
            if run.closed or not steps or used + len(steps) >= rounds and len(steps) == 1 or rest and len(steps) == 1:
                now[n][t] = at if run.closed or not steps else steps[-1]
                del runs[n][t]
                continue
            # A strip is worth its rows if centers will not soon have moved as far.
            w = steps[-1][1] - steps[-1][0]
            pace = np.linalg.norm(steps[-1] - (steps[-2] if len(steps) > 1 else at), axis=1).sum()
            width_ = strip if np.linalg.norm(w) > 0 and strip > 2 * pace else 0.0
            runs[n][t] = _Run(at, np.stack(steps), run.width, used, rest or used + len(steps) >= rounds, width_)
    out = {}
    for n, (ones, cost) in costs().items():
        best = _best(np.where((ones > 0) & (ones < size[n]), cost, np.inf))
        out[n] = None if best is None else now[n][best]
    held.unpersist()
    return out


def _split_pass(rows: DataFrame, nodes: DataFrame, sizes: dict[int, int], first_new: int, n_init: int, rounds: int, seed: int) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """((id, node) of the members of the nodes in sizes after their splits, node -> (child 0, child 1))."""
    spark, kinds = rows.sparkSession, dict(rows.dtypes)
    members = nodes.where(F.col("node").isin(sorted(sizes))).select("id", "node")
    starts = _starts(rows, members, n_init, seed)
    children = {n: (first_new + 2 * i, first_new + 2 * i + 1) for i, n in enumerate(sorted(sizes))}
    small = {n for n in sizes if sizes[n] <= TASK_ROWS}
    shared = spark.sparkContext.broadcast(({n: starts[n] for n in small}, children))
    # Sides where all rows are at one place: below and above the middle of the node's hashes, so neither is empty.
    h = F.xxhash64("id", F.lit(seed)).cast("double")
    middle = members.groupBy("node").agg(((F.min(h) + F.max(h)) / 2).alias("middle"))
    members = members.join(F.broadcast(middle), "node").select("id", "node", (h > F.col("middle")).cast("int").alias("half"))
    rows = rows.select("id", "v").join(members, "id")
    schema = f"id {kinds['id']}, node long"

    def in_task(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        n = t.column("node")[0].as_py()
        side = _two_means(_vectors_of(t).astype(np.float64), shared.value[0][n], rounds, t.column("half").to_numpy())
        return pa.table({"id": t.column("id"), "node": np.array(shared.value[1][n])[side]})

    out = rows.where(F.col("node").isin(sorted(small))).groupBy("node").applyInArrow(in_task, schema)
    large = {n: c for n, c in starts.items() if n not in small}
    if large:
        dims, width = next(iter(large.values())).shape[-1], "f4" if kinds["v"] == "array<float>" else "f8"
        blocks = _blocks(rows.where(F.col("node").isin(sorted(large))), {n: sizes[n] for n in large}, dims)
        final = spark.sparkContext.broadcast((_large_centers(blocks, large, rounds, width), children))

        def assign(batches):
            found, names = final.value
            for batch, i in ((batch, i) for batch in batches for i in range(batch.num_rows)):
                n, ids = batch.column("node")[i].as_py(), batch.column("ids")[i].values
                x = _matrix_of(batch.column("x")[i].as_buffer(), dims, width)
                half = np.frombuffer(batch.column("half")[i].as_buffer(), np.int8).astype(np.int64)
                side = half if found[n] is None else _sides(x, found[n][None])[0].astype(np.int64)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(ids), names[n][0])), pa.array(side)], ["id", "first", "side"])

        sides = blocks.mapInArrow(assign, f"id {kinds['id']}, first long, side long")
        out = out.union(sides.select("id", (F.col("first") + F.col("side")).alias("node")))
    return out, children


def bisecting_kmeans(
    df: DataFrame, n_clusters: int, id_col: str = "id", vector_col: str = "embedding", label_col: str = "label", strategy: str = "largest_non_homogenous", seed: int = 42, n_init: int = 10, max_iter: int = 1000
) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """((id, cluster_id), split log of (step, parent, new)).

    Each step splits the largest cluster with more than one label (the largest
    of all once none is left, or with strategy="largest"); child 0 keeps the id,
    child 1 gets the next.  A split does not depend on the others, so a pass
    makes all that may be needed at once, and the steps are then read off in
    order: passes grow with the depth of the tree, not with its clusters.  Each
    is the best of n_init runs from the same starts whether one task holds the
    cluster or many do.  Ids must be unique.  Node tables are checkpointed.
    """
    spark = df.sparkSession
    checkpoints(spark)
    v = F.col(vector_col) if dict(df.dtypes)[vector_col] == "array<float>" else F.transform(vector_col, lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).alias("id"), v.alias("v"), F.col(label_col).alias("label"))
    nodes = rows.select("id", "label", F.lit(0).cast("long").alias("node")).checkpoint()
    first = nodes.agg(F.count("*").alias("n"), F.count_distinct("label").alias("l")).first()
    facts, children = {0: (first["n"], first["l"])}, {}
    log: list[tuple[int, int, int]] = []
    leaf = {0: 0}  # cluster -> node

    def rank(cluster: int) -> tuple:
        n, labels = facts[leaf[cluster]]
        return (0 if strategy != "largest_non_homogenous" or labels > 1 else 1, -n, cluster)

    waiting = [rank(0)] if first["n"] > 1 else []
    while waiting and len(log) < n_clusters - 1:
        node = leaf[waiting[0][2]]
        if node not in children:
            need = [leaf[c] for _, _, c in heapq.nsmallest(n_clusters - 1 - len(log), waiting) if leaf[c] not in children]
            moved, new = _split_pass(rows, nodes, {n: facts[n][0] for n in need}, 1 + 2 * len(children), n_init, max_iter, seed)
            children |= new
            moved = moved.withColumnRenamed("node", "_new")
            nodes = nodes.join(moved, "id", "left").select("id", "label", F.coalesce("_new", "node").alias("node")).checkpoint()
            fresh = nodes.where(F.col("node").isin([x for pair in new.values() for x in pair])).groupBy("node").agg(F.count("*").alias("n"), F.count_distinct("label").alias("l")).collect()
            facts |= {r["node"]: (r["n"], r["l"]) for r in fresh}
        cluster = heapq.heappop(waiting)[2]
        if any(n not in facts for n in children[node]):  # all rows at one place, and on one side by their hash
            continue
        step = len(log) + 1
        leaf[cluster], leaf[step] = children[node]
        log.append((step, cluster, step))
        for c in (cluster, step):
            if facts[leaf[c]][0] > 1:
                heapq.heappush(waiting, rank(c))
    # Nodes below a final cluster's node were split ahead but not used.
    final = {}
    for cluster, node in leaf.items():
        below = [node]
        while below:
            at = below.pop()
            final[at] = cluster
            below += children.get(at, ())
    table = spark.createDataFrame(sorted(final.items()), "node long, cluster_id int")  # at most a few entries for each cluster
    return nodes.join(F.broadcast(table), "node").select("id", "cluster_id"), log


def homogeneous_depth(log: list[tuple[int, int, int]], labels: dict[int, set]) -> dict[int, int]:
    """Splits above each final cluster up to the highest ancestor whose members share one label (-1: not even its own do)."""
    held = {c: set(x) for c, x in labels.items()}
    members = {c: [c] for c in labels}
    depth, out = dict.fromkeys(labels, 0), {c: 0 if len(x) == 1 else -1 for c, x in labels.items()}
    for _, parent, new in reversed(log):
        members[parent] = members.get(parent, []) + members.pop(new, [])
        held[parent] = held.get(parent, set()) | held.pop(new, set())
        for c in members[parent]:
            depth[c] += 1
            if len(held[parent]) == 1:
                out[c] = depth[c]
    return out


def centers(df: DataFrame, cluster_col: str = "cluster_id", vector_col: str = "embedding") -> DataFrame:
    """(cluster_id, center): mean vectors; sums combine before the shuffle."""
    flat = df.select(F.col(cluster_col).alias("cluster_id"), F.posexplode(vector_col).alias("d", "x"))
    mean = flat.groupBy("cluster_id", "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda x: x.m).alias("center"))


#: Rows of two blocks that are multiplied at once: their distances stay in a core's cache.
PAIR_SLICE = (256, 1024)
#: Clusters of a block up to which two blocks' distances are made once for both.
FEW_CLUSTERS = 64
#: Bytes of centers that every task may hold.
CENTER_BYTES = 64 << 20


def nearest_centers(df: DataFrame, cs: DataFrame, n: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(id, rank, cluster_id, distance): the n nearest clusters of each row, ties to the smaller cluster id.

    Centers of at most CENTER_BYTES go to every task, so rows need no shuffle;
    more are held against the rows in blocks.  Both ways give the same rows.
    """
    size = cs.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("center")), F.lit(0)).alias("d")).first()
    if 8 * size["n"] * size["d"] > CENTER_BYTES:
        kinds = dict(df.dtypes)[id_col], dict(cs.dtypes)["cluster_id"]
        rows, own = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), cs.select(F.col("cluster_id").alias("id"), F.col("center").alias("v"))
        near = in_blocks(rows, own, _edge_kernel(lambda a, b, d: _near(d, n)), f"src {kinds[0]}, dst {kinds[1]}, distance double")
        rank = F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))
        return near.withColumn("rank", rank).where(F.col("rank") <= n).select(F.col("src").alias("id"), "rank", F.col("dst").alias("cluster_id"), "distance")
    centers_ = sorted(cs.collect(), key=lambda r: r["cluster_id"])
    if not centers_:
        return df.select(F.col(id_col).alias("id"), F.lit(1).alias("rank"), F.lit(0).alias("cluster_id"), F.lit(0.0).alias("distance")).where("false")
    shared = df.sparkSession.sparkContext.broadcast((np.array([r["cluster_id"] for r in centers_]), np.array([r["center"] for r in centers_], np.float64)))

    def rows(batches):
        names, c = shared.value
        k = min(n, len(c))
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                d = distances(part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1), c)
                best = np.argsort(d, 1, kind="stable")[:, :k]
                i = np.repeat(np.arange(part.num_rows), k)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(i)), pa.array(np.tile(np.arange(1, k + 1), part.num_rows).astype(np.int32)), pa.array(names[best].ravel()), pa.array(np.take_along_axis(d, best, 1).ravel())],
                    ["id", "rank", "cluster_id", "distance"],
                )

    src = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("v is not null")
    kind = dict(cs.dtypes)["cluster_id"]
    out = src.mapInArrow(rows, f"id {dict(src.dtypes)['id']}, rank int, cluster_id {'string' if kind == 'string' else 'long'}, distance double")
    return out.withColumn("cluster_id", F.col("cluster_id").cast(kind))


def _near(d: np.ndarray, n: int) -> np.ndarray:
    least = np.partition(d, n - 1, 1)[:, n - 1] if d.shape[1] > n else np.full(len(d), np.inf)
    return d <= least[:, None] * (1 + 1e-9)


def cluster_labels(df: DataFrame, order: str, cluster_col: str = "cluster_id", label_col: str = "label") -> DataFrame:
    return df.groupBy(F.col(cluster_col).alias("cluster_id")).agg(F.min_by(label_col, order).alias("cluster_label"), F.count("*").alias("size"), F.count_distinct(label_col).alias("n_labels"))


def top_clusters_wide(near: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """One row a query: top_cluster_* and rank_i_cluster_* columns."""
    x = near.join(labels.select("cluster_id", "cluster_label"), "cluster_id")
    pick = lambda i, c: F.max(F.when(F.col("rank") == i, F.col(c)))
    cols = []
    for i in range(1, n + 1):
        p = "top" if i == 1 else f"rank_{i}"
        cols += [pick(i, "cluster_id").alias(f"{p}_cluster_id"), pick(i, "distance").alias(f"{p}_cluster_distance"), pick(i, "cluster_label").alias(f"{p}_cluster_label")]
    return x.groupBy("id").agg(*cols)


def intra_distance(df: DataFrame, cs: DataFrame | None, method: str = "center", vector_col: str = "embedding", id_col: str = "id") -> DataFrame:
    """(cluster_id, intra), 0 for singletons: the mean distance to the center, the mean of all pairs, or the largest of a pair (furthest)."""
    if method == "center":
        d = df.join(cs, "cluster_id").withColumn("_d", euclidean(vector_col, "center"))
        return d.groupBy("cluster_id").agg(F.when(F.count("*") > 1, F.avg("_d")).otherwise(F.lit(0.0)).alias("intra"))
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), "cluster_id")
    sums = _cluster_sums(rows, rows.withColumn("target", F.col("cluster_id")))
    total = F.when(F.sum("n") > 0, F.sum("total") / F.sum("n")) if method == "pairwise" else F.max("most")
    return sums.groupBy(F.col("src_cluster").alias("cluster_id")).agg(F.coalesce(total, F.lit(0.0)).alias("intra"))


def _cluster_sums(members: DataFrame, asked: DataFrame) -> DataFrame:
    """Of each asked row (id, v, cluster_id, target) and the target cluster's members: sums over their distances, itself left out.

    (id, src_cluster, target, total, n, positive, least, most); blocks of one
    cluster's members meet blocks of those that ask for it, so a large cluster is many tasks.
    """
    kinds = dict(asked.dtypes)

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        src, dst = left.column("id").to_numpy(), right.column("id").to_numpy()
        d = distances(_matrix(left.column("v")), _matrix(right.column("v")))
        i, j = np.nonzero(src[:, None] == dst[None]) if np.isin(src, dst).any() else (np.zeros(0, np.int64),) * 2
        d[i, j] = 0  # a row's distance to itself
        total, positive, most = d.sum(1), np.count_nonzero(d, 1), d.max(1)
        n = len(dst) - np.bincount(i, minlength=len(src))
        d[i, j] = np.inf
        least = d.min(1)
        return pa.table(
            {"id": left.column("id"), "src_cluster": left.column("cluster_id"), "target": left.column("target"), "total": pa.array(total, pa.float64()), "n": pa.array(n.astype(np.int64)),
             "positive": pa.array(positive.astype(np.int64)), "least": pa.array(least, pa.float64()), "most": pa.array(most, pa.float64())}
        )

    own = members.select("id", "v", F.col("cluster_id").alias("target"))
    schema = f"id {kinds['id']}, src_cluster {kinds['cluster_id']}, target {kinds['cluster_id']}, total double, n long, positive long, least double, most double"
    return in_blocks(asked, own, kernel, schema, ("target",))


def center_distances(cs: DataFrame, nearest: int | None = None) -> DataFrame:
    """(a, b, distance) between centers: of all of them, or the nearest few of each."""
    own = cs.select(F.col("cluster_id").alias("id"), F.col("center").alias("v"))
    choose = lambda a, b, d: (a[:, None] != b[None]) & (d >= 0)
    if nearest is not None:
        return knn(own, own, nearest, "id", "v", include_self=False).select(F.col("src").alias("a"), F.col("dst").alias("b"), "distance")
    kind = dict(own.dtypes)["id"]
    return in_blocks(own, own, _edge_kernel(choose), f"src {kind}, dst {kind}, distance double").select(F.col("src").alias("a"), F.col("dst").alias("b"), "distance")


def _extremes(left: pa.Table, right: pa.Table):
    """(a, b, least, most) of the distances between two blocks' rows, those of one id left out.

    Products in single precision find the pairs that may be the nearest or the
    furthest, to within their error; these are taken by plain differences.
    """
    x, y = _matrix(left.column("v")), _matrix(right.column("v"))
    src, dst = left.column("id").to_numpy(zero_copy_only=False), right.column("id").to_numpy(zero_copy_only=False)
    c, found, shared = y.mean(0), [np.inf, -np.inf], bool(np.isin(src, dst).any())
    with np.errstate(over="ignore", invalid="ignore"):
        one, two = (metric.halves(m - c)[k].astype(np.float32) for k, m in enumerate((x, y)))
        reach = np.sqrt(one[:, -2].max()) + np.sqrt(two[:, -1].max())
        error = float(reach) ** 2 * (x.shape[1] + 8) * 2.0**-22
        for i in range(0, len(x), PAIR_SLICE[0]):
            for j in range(0, len(y), PAIR_SLICE[1]):
                d = one[i : i + PAIR_SLICE[0]] @ two[j : j + PAIR_SLICE[1]].T
                other = src[i : i + PAIR_SLICE[0], None] != dst[None, j : j + PAIR_SLICE[1]] if shared else None
                if other is not None and not other.any():
                    continue
                ends = (d.min(), d.max()) if other is None else (d[other].min(), d[other].max())
                plain = not (np.isfinite(ends[0]) and np.isfinite(ends[1]) and np.isfinite(error))
                for k, sign in enumerate((1, -1)):
                    best = min(sign * float(ends[k]) + error, sign * found[k]) if not plain else 0
                    if not plain and sign * float(ends[k]) - error > best:
                        continue
                    near = np.ones(d.shape, bool) if plain else sign * d <= best + error
                    p, q = np.nonzero(near if other is None else near & other)
                    for t in range(0, len(p), 65_536):
                        z = x[i + p[t : t + 65_536]] - y[j + q[t : t + 65_536]]
                        found[k] = sign * min(sign * found[k], (sign * (z * z).sum(1)).min())
    if np.isfinite(found[1]) or found[1] > 0:
        yield pa.RecordBatch.from_arrays([left.column("a").slice(0, 1).combine_chunks(), left.column("b").slice(0, 1).combine_chunks(), pa.array([np.sqrt(found[0])]), pa.array([np.sqrt(found[1])])], ["a", "b", "least", "most"])


def inter_distances(df: DataFrame, cs: DataFrame, nearest: int | None = 19, vector_col: str = "embedding", id_col: str = "id") -> DataFrame:
    """(a, b, closest, furthest) of each cluster and its nearest clusters: distances of members; two clusters meet once, whichever is near the other."""
    checkpoints(df.sparkSession)
    pairs = center_distances(cs, nearest).select("a", "b").checkpoint()
    once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), "cluster_id").where("v is not null")
    kind = dict(rows.dtypes)["cluster_id"]
    left, right = (rows.join(once.withColumn("cluster_id", F.col(c)), "cluster_id").select("id", "v", "a", "b") for c in ("a", "b"))
    found = in_blocks(left, right, _extremes, f"a {kind}, b {kind}, least double, most double", ("a", "b"), whole=True)
    found = found.groupBy("a", "b").agg(F.min("least").alias("closest"), F.max("most").alias("furthest"))
    swapped = found.select(F.col("b").alias("a"), F.col("a").alias("b"), "closest", "furthest")
    return found.unionByName(swapped).join(pairs, ["a", "b"], "left_semi")


def inter_distance(df: DataFrame, cs: DataFrame, method: str = "center", nearest: int | None = 19, vector_col: str = "embedding", id_col: str = "id") -> DataFrame:
    """(a, b, distance) of each cluster and its nearest clusters: of the centers, or of the closest or furthest members."""
    if method == "center":
        return center_distances(cs, nearest)
    return inter_distances(df, cs, nearest, vector_col, id_col).select("a", "b", F.col("closest" if method == "closest" else "furthest").alias("distance"))


def min_inter_distance(df: DataFrame, cs: DataFrame, method: str = "center", nearest: int | None = 19, vector_col: str = "embedding") -> DataFrame:
    """(cluster_id, min_inter): the least distance of each cluster to its nearest clusters."""
    return inter_distance(df, cs, method, nearest, vector_col).groupBy(F.col("a").alias("cluster_id")).agg(F.min("distance").alias("min_inter"))


def dunn(df: DataFrame, cs: DataFrame, vector_col: str = "embedding", inter: str = "center", intra: str = "center") -> DataFrame:
    """dunn (smallest distance of clusters over largest intra) and dunn_inverse, by the methods named."""
    i = intra_distance(df, cs, intra, vector_col).agg(F.max("intra").alias("i"))
    # The two centers that are closest are each other's nearest.
    d = inter_distance(df, cs, inter, 1 if inter == "center" else None, vector_col).agg(F.min("distance").alias("d"))
    return i.join(d).select(F.try_divide("d", "i").alias("dunn"), F.try_divide("i", "d").alias("dunn_inverse"))


def davies_bouldin(df: DataFrame, cs: DataFrame, nearest: int | None = 9, vector_col: str = "embedding") -> DataFrame:
    """davies_bouldin over the nearest clusters of each (all, if None)."""
    s = intra_distance(df, cs, vector_col=vector_col)
    d = center_distances(cs, nearest).join(s.select(F.col("cluster_id").alias("a"), F.col("intra").alias("sa")), "a").join(s.select(F.col("cluster_id").alias("b"), F.col("intra").alias("sb")), "b")
    return d.groupBy("a").agg(F.max((F.col("sa") + F.col("sb")) / F.col("distance")).alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def _blocks_by_cluster(rows: DataFrame) -> tuple[DataFrame, int, int, int]:
    """(rows with their block, blocks, first block of whole clusters, rows of a block): a large cluster has blocks of its own, small ones share some."""
    sizes = rows.groupBy("cluster_id").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    each = metric.block_rows(total)
    # At most two clusters for each block's rows are large.
    large = sizes.where(F.col("n") > each // 2).withColumn("parts", F.ceil(F.col("n") / each).cast("int")).collect()
    first = np.append(0, np.cumsum([r["parts"] for r in large])).tolist()
    bins = -(-(total - sum(r["n"] for r in large)) // each)
    table = rows.sparkSession.createDataFrame([(r["cluster_id"], int(k), r["parts"]) for r, k in zip(large, first)], f"cluster_id {dict(rows.dtypes)['cluster_id']}, first int, parts int")
    own = F.coalesce(F.col("first") + F.pmod(F.xxhash64("id"), "parts"), F.lit(int(first[-1])) + F.pmod(F.xxhash64("cluster_id"), F.lit(max(bins, 1)))).cast("int")
    return rows.join(F.broadcast(table), "cluster_id", "left").select("id", "v", "cluster_id", own.alias("_own")), int(first[-1] + bins), int(first[-1]), each


def _sorted_by_cluster(part: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, pa.Array]:
    """(rows in order of their clusters, their vectors, places of their clusters, clusters)."""
    names = part.column("cluster_id").combine_chunks().dictionary_encode()
    code = names.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    part = part.take(pa.array(order))
    return part, _matrix(part.column("v")), code[order].astype(np.int64), names.dictionary


def _mean_kernel(whole_from: int, symmetric: bool):
    """A kernel of sums over the distances of a block's rows to the other block's clusters; of a pair of blocks that come once, either way."""

    def given(rows, code, names, target, total, zeros, same, sizes, whole):
        """Sums of the rows to each cluster; of whole clusters only those to the own, and the least mean of the others."""
        n = sizes[None] - same
        col = lambda c, k: c.take(pa.array(k))
        ids, src = rows.column("id").combine_chunks(), names.take(pa.array(code))

        def batch(i, k, least):
            return pa.RecordBatch.from_arrays(
                [col(ids, i), col(src, i), pa.nulls(len(i), target.type) if k is None else col(target, k), pa.array(np.zeros(len(i)) if k is None else total[i, k]), pa.array(np.zeros(len(i), np.int64) if k is None else n[i, k]),
                 pa.array(np.zeros(len(i), np.int64) if k is None else sizes[k] - zeros[i, k]), pa.array(least) if k is None else pa.nulls(len(i), pa.float64())],
                ["id", "src_cluster", "target", "total", "n", "positive", "least"],
            )

        if not whole:
            i, k = (x.ravel() for x in np.indices(total.shape))
            yield batch(i, k, None)
            return
        place = {v: k for k, v in enumerate(target.to_pylist())}
        own = np.array([place.get(v, -1) for v in names.to_pylist()], np.int64)[code]
        i = np.flatnonzero(own >= 0)
        yield batch(i, own[i], None)
        mean = np.where(n > 0, total / np.maximum(n, 1), np.inf)
        mean[i, own[i]] = np.inf
        least = mean.min(1)
        i = np.flatnonzero(np.isfinite(least))
        yield batch(i, None, least[i])

    def one_way(left, right, whole, back=None):
        (rows, x, cx, own), (others, y, cy, target) = left, right
        c, sizes = y.mean(0), np.bincount(cy, minlength=len(target))
        (one, _), (_, two) = metric.halves(x - c), metric.halves(y - c)
        src, dst = rows.column("id").to_numpy(), others.column("id").to_numpy()
        shared, (m, n) = bool(np.isin(src, dst).any()), PAIR_SLICE
        for i in range(0, len(x), m):
            total, zeros, same = np.zeros((len(x[i : i + m]), len(target))), *(np.zeros((len(x[i : i + m]), len(target)), np.int64) for _ in range(2))
            lefts = np.flatnonzero(np.append(True, np.diff(cx[i : i + m]) != 0))
            for j in range(0, len(y), n):
                starts = np.flatnonzero(np.append(True, np.diff(cy[j : j + n]) != 0))
                k = cy[j : j + n][starts]
                d = one[i : i + m] @ two[j : j + n].T
                near = float(d.min()) <= 1e-6 * (float(one[i : i + m, -2].max()) + float(two[j : j + n, -1].max()))
                if near:  # what is almost equal by plain differences
                    p, q = np.nonzero(d <= 1e-6 * (one[i : i + m, -2][:, None] + two[j : j + n, -1][None]))
                    for t in range(0, len(p), 65_536):
                        z = x[i + p[t : t + 65_536]] - y[j + q[t : t + 65_536]]
                        d[p[t : t + 65_536], q[t : t + 65_536]] = (z * z).sum(1)
                np.sqrt(d, out=d)
                if near or shared:
                    equal = src[i : i + m, None] == dst[None, j : j + n]
                    d[equal] = 0
                    for held, of_back, mask in ((zeros, 1, d == 0), (same, 2, equal)):
                        held[:, k] += np.add.reduceat(mask, starts, 1, dtype=np.int64)
                        if back is not None:
                            back[of_back][j : j + n, cx[i : i + m][lefts]] += np.add.reduceat(mask, lefts, 0, dtype=np.int64).T
                total[:, k] += d.sum(1)[:, None] if len(starts) == 1 else np.add.reduceat(d, starts, 1)
                if back is not None:
                    back[0][j : j + n, cx[i : i + m][lefts]] += d.sum(0)[:, None] if len(lefts) == 1 else np.add.reduceat(d, lefts, 0).T
            yield from given(rows.slice(i, m), cx[i : i + m], own, target, total, zeros, same, sizes, whole)

    def kernel(left: pa.Table, right: pa.Table):
        p, q = left.column("_p")[0].as_py(), left.column("_q")[0].as_py()
        a, b = _sorted_by_cluster(left), _sorted_by_cluster(right)
        if not symmetric or p == q:
            yield from one_way(a, b, q >= whole_from)
        elif len(a[3]) <= FEW_CLUSTERS:
            back = np.zeros((len(b[1]), len(a[3]))), *(np.zeros((len(b[1]), len(a[3])), np.int64) for _ in range(2))
            yield from one_way(a, b, q >= whole_from, back)
            yield from given(b[0], b[2], b[3], a[3], *back, np.bincount(a[2], minlength=len(a[3])), p >= whole_from)
        else:
            yield from one_way(a, b, q >= whole_from)
            yield from one_way(b, a, p >= whole_from)

    return kernel


def silhouettes(df: DataFrame, cs: DataFrame | None, sample: DataFrame | None = None, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster_id, silhouette) of a sample's rows (all, if None).

    a is the mean distance to the other members of the own cluster that are not
    at the same place, b the least mean distance to one of all other clusters;
    rows of singletons, and those all of whose cluster is at one place, have 0.
    Ids are taken to be unique; the centers are not needed.  Blocks of rows meet once, for the sums of both;
    of clusters that lie in one block only the least mean leaves a task.
    """
    sides = lambda t: t.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), "cluster_id").where("v is not null and id is not null and cluster_id is not null")
    dealt, blocks, whole_from, each = _blocks_by_cluster(sides(df))
    own, last = F.col("_own"), F.lit(blocks - 1)
    if sample is None:
        a = dealt.select("id", "v", "cluster_id", own.alias("_p"), F.explode(F.sequence(own, last)).alias("_q"))
        b = dealt.select("id", "v", "cluster_id", F.explode(F.sequence(F.lit(0), own)).alias("_p"), own.alias("_q"))
    else:
        some = sides(sample)
        lefts = 1 + some.count() // each
        a = some.select("*", F.pmod(F.xxhash64("id"), F.lit(lefts)).cast("int").alias("_p"), F.explode(F.sequence(F.lit(0), last)).alias("_q"))
        b = dealt.select("id", "v", "cluster_id", F.explode(F.sequence(F.lit(0), F.lit(lefts - 1))).alias("_p"), own.alias("_q"))
    kinds = dict(dealt.dtypes)
    schema = f"id {kinds['id']}, src_cluster {kinds['cluster_id']}, target {kinds['cluster_id']}, total double, n long, positive long, least double"
    sums = metric.cogroup(a, b, ["_p", "_q"], _mean_kernel(whole_from, sample is None), schema, spread=True)
    d = sums.groupBy("id", "src_cluster", "target").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.sum("positive").alias("positive"), F.min("least").alias("least"))
    own = F.col("target") == F.col("src_cluster")
    s = d.groupBy("id", F.col("src_cluster").alias("cluster_id")).agg(
        F.max(F.when(own, F.try_divide("total", "positive"))).alias("a"), F.min(F.when(F.col("target").isNull(), F.col("least")).when(~own, F.try_divide("total", "n"))).alias("b")
    )
    return s.select("id", "cluster_id", F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)).alias("silhouette"))


def silhouette(df: DataFrame, cs: DataFrame | None, sample: DataFrame | None = None, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(silhouette, n): the mean over a sample's rows."""
    return silhouettes(df, cs, sample, id_col, vector_col).agg(F.avg("silhouette").alias("silhouette"), F.count("*").alias("n"))


def cluster_silhouettes(s: DataFrame) -> DataFrame:
    """(cluster_id, silhouette_index_mean, silhouette_index_weight) from silhouettes()."""
    return s.groupBy("cluster_id").agg(F.avg("silhouette").alias("silhouette_index_mean"), F.count("*").alias("silhouette_index_weight"))

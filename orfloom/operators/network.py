"""A feed-forward classifier: ReLU layers, class weights inside the loss, Adam over synchronous mini-batches.

Rows are dealt to mini-batches by a hash of their ids and packed into blocks
that are written once.  A step is one job: tasks give the sums of the loss and
its gradients over their blocks of one mini-batch, which are added up in a tree
(what reaches the driver is one set of gradients, whatever the rows); the driver
holds the weights and Adam's state.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orfloom.operators.relational import checkpoints

#: Rows of a mini-batch, and of a block.
BATCH_ROWS, BLOCK_ROWS = 65_536, 4096
# Adam's decays and its guard against division by zero.
DECAY_1, DECAY_2, GUARD = 0.9, 0.999, 1e-8


def start(dims: list[int], seed: int) -> list[np.ndarray]:
    """Weights and offsets of each layer, uniform within 1 / sqrt(inputs)."""
    r = np.random.default_rng(seed)
    out = []
    for a, b in zip(dims, dims[1:]):
        out += [r.uniform(-1, 1, (a, b)) / np.sqrt(a), r.uniform(-1, 1, b) / np.sqrt(a)]
    return out


def outputs(params: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Class probabilities of rows."""
    for k in range(0, len(params), 2):
        x = x @ params[k] + params[k + 1]
        x = np.maximum(x, 0) if k + 2 < len(params) else x
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def loss_sums(params: list[np.ndarray], x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Sum over rows of weight[y] times cross-entropy, and its gradients."""
    layers = [x]
    for k in range(0, len(params), 2):
        z = layers[-1] @ params[k] + params[k + 1]
        layers.append(np.maximum(z, 0) if k + 2 < len(params) else z)
    z = layers.pop()
    top = z.max(1, keepdims=True)
    log_p = z - top - np.log(np.exp(z - top).sum(1, keepdims=True))
    w, rows = weights[y], np.arange(len(y))
    loss = float(-(w * log_p[rows, y]).sum())
    back = np.exp(log_p)
    back[rows, y] -= 1
    back *= w[:, None]
    grads: list[np.ndarray] = []
    for k in range(len(params) - 2, -1, -2):
        grads = [layers[k // 2].T @ back, back.sum(0), *grads]
        if k:
            back = (back @ params[k].T) * (layers[k // 2] > 0)
    return loss, grads


@dataclass
class Adam:
    """Adam's moments; step changes the parameters in place."""

    rate: float
    first: list = field(default_factory=list)
    second: list = field(default_factory=list)
    steps: int = 0

    def step(self, params: list[np.ndarray], grads: list[np.ndarray]) -> None:
        if not self.first:
            self.first, self.second = ([np.zeros_like(p) for p in params] for _ in range(2))
        self.steps += 1
        for p, g, m, v in zip(params, grads, self.first, self.second):
            m += (1 - DECAY_1) * (g - m)
            v += (1 - DECAY_2) * (g * g - v)
            p -= self.rate * (m / (1 - DECAY_1**self.steps)) / (np.sqrt(v / (1 - DECAY_2**self.steps)) + GUARD)


@dataclass
class Network:
    """Layer sizes, parameters, and the means and deviations that rows are scaled by."""

    dims: list[int]
    params: list[np.ndarray]
    mean: np.ndarray
    deviation: np.ndarray

    def save(self, spark: SparkSession, path: str) -> None:
        """One row of JSON, written by Spark."""
        parts = {"dims": self.dims, "params": [p.tolist() for p in self.params], "mean": self.mean.tolist(), "deviation": self.deviation.tolist()}
        spark.createDataFrame([(json.dumps(parts),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Network:
        parts = json.loads(spark.read.text(path, wholetext=True).first()["value"])
        return cls(parts["dims"], [np.array(p) for p in parts["params"]], np.array(parts["mean"]), np.array(parts["deviation"]))

    def predict(self, df: DataFrame, name: str = "model", vector_col: str = "embedding") -> DataFrame:
        """df with {name}_label (the smallest of equal ones) and {name}_output_i; rows without a vector get nulls."""
        held, kind = df.sparkSession.sparkContext.broadcast(self), "array<double>"

        def run(batches):
            net = held.value
            for batch in batches:
                v = batch.column("_v")
                at = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
                x = v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1) if len(at) else np.zeros((0, net.dims[0]))
                p = outputs(net.params, (x - net.mean) / net.deviation)
                out = [None] * len(v)
                for i, row in zip(at.tolist(), p.tolist()):
                    out[i] = row
                yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(out, pa.list_(pa.float64()))], ["_row", "_p"])

        src = df.select(F.struct(*df.columns).alias("_row"), F.transform(vector_col, lambda x: x.cast("double")).alias("_v"))
        out = src.mapInArrow(run, f"_row {src.schema['_row'].dataType.simpleString()}, _p {kind}")
        label = (F.array_position("_p", F.array_max("_p")) - 1).cast("int").alias(f"{name}_label")
        return out.select("_row.*", label, *[F.get("_p", F.lit(i)).alias(f"{name}_output_{i}") for i in range(self.dims[-1])])


def _scales(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each dimension (1 where it is constant)."""
    flat = rows.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    got = sorted((r["d"], r["m"], r["s"]) for r in flat.collect())  # one row a dimension
    return np.array([m for _, m, _ in got]), np.array([s if s > 0 else 1.0 for _, _, s in got])


def _blocks(rows: DataFrame, batches: int, seed: int) -> DataFrame:
    """(batch, n, x, y): packed rows, in the order of a hash of their ids."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("place", "ascending"), ("id", "ascending")])
        x = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        columns = [t.column("batch")[:1].combine_chunks(), pa.array([t.num_rows]), pa.array([x.tobytes()], pa.binary()), pa.array([t.column("y").to_numpy().astype(np.int64).tobytes()], pa.binary())]
        return pa.table(columns, ["batch", "n", "x", "y"])

    place = F.xxhash64("id", F.lit(seed))
    n = rows.count()
    parts = max(1, -(-n // batches // BLOCK_ROWS))
    dealt = rows.select("id", "v", "y", place.alias("place"), F.pmod(place, F.lit(batches)).cast("int").alias("batch"), F.pmod(F.xxhash64("id"), F.lit(parts)).alias("block"))
    return dealt.groupBy("batch", "block").applyInArrow(pack, "batch int, n long, x binary, y binary").checkpoint()


def class_weights(counts: dict[int, int], classes: int) -> np.ndarray:
    """Rows over classes times the class's rows; 0 for a class without rows."""
    total = sum(counts.values())
    return np.array([total / (counts[c] * classes) if counts.get(c) else 0.0 for c in range(classes)])


def fit_network(
    df: DataFrame, dims: list[int], vector_col: str = "embedding", label_col: str = "label", id_col: str = "id", epochs: int = 50, rate: float = 0.01,
    batch_rows: int = BATCH_ROWS, weights: list[float] | str | None = "balanced", seed: int = 42, after_epoch=None,
) -> tuple[Network, list[float]]:
    """(network after the last epoch, mean weighted loss of each epoch before its steps' changes).

    weights multiply the loss of a class's rows: ``balanced`` for inverse
    frequencies, None for 1.  after_epoch(epoch, network) is called after each
    epoch with a copy.  Labels are 0 to dims[-1] - 1; rows without an id, label
    or vector take no part; a table without rows is an error.
    """
    spark = df.sparkSession
    checkpoints(spark)
    rows = df.select(F.col(id_col).alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"), F.col(label_col).cast("long").alias("y")).where("id is not null and v is not null and y is not null")
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}  # one row a class
    if not counts or not set(counts) <= set(range(dims[-1])):
        raise ValueError(f"labels {sorted(counts)[:10]} for {dims[-1]} classes")
    w = class_weights(counts, dims[-1]) if weights == "balanced" else np.ones(dims[-1]) if weights is None else np.array(weights, float)
    mean, deviation = _scales(rows)
    n = sum(counts.values())
    batches = -(-n // batch_rows)
    blocks = _blocks(rows, batches, seed)
    held = [blocks.where(F.col("batch") == b).select("n", "x", "y").rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK) for b in range(batches)]
    params, adam, losses = start(dims, seed), Adam(rate), []

    def sums(now):
        def run(part):
            total = None
            for size, x, y in part:
                loss, grads = loss_sums(now.value, (np.frombuffer(x).reshape(size, -1) - mean) / deviation, np.frombuffer(y, np.int64), w)
                got = (size, loss, grads)
                total = got if total is None else added(total, got)
            return [] if total is None else [total]

        return run

    def added(a, b):
        return a[0] + b[0], a[1] + b[1], [x + y for x, y in zip(a[2], b[2])]

    for epoch in range(1, epochs + 1):
        loss = 0.0
        for data in held:
            now = spark.sparkContext.broadcast(params)
            parts = data.mapPartitions(sums(now))
            size, own, grads = parts.treeAggregate((0, 0.0, None), lambda a, b: b if a[2] is None else a if b[2] is None else added(a, b), lambda a, b: b if a[2] is None else a if b[2] is None else added(a, b))
            now.unpersist()
            loss += own
            if size:
                adam.step(params, [g / size for g in grads])
        losses.append(loss / n)
        if after_epoch is not None:
            after_epoch(epoch, Network(dims, [p.copy() for p in params], mean, deviation))
    for data in held:
        data.unpersist()
    return Network(dims, params, mean, deviation), losses

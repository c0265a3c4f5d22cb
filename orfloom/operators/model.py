"""Multilayer classifier on embedding columns: fit, select over splits, predict."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orfloom.functions.stats import confusion
from orfloom.operators.network import Network, fit_network
from orfloom.operators.relational import require_unique, upsert_columns
from orfloom.operators.split import cluster_stratified_split


def class_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """(label, weight): rows over classes times the class's rows."""
    n = df.groupBy(label_col).agg(F.count("*").alias("_n"))
    return n.join(n.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))).select(label_col, (F.col("_all") / (F.col("_n") * F.col("_k"))).alias("weight"))


def balanced_sample(df: DataFrame, label_col: str = "label", seed: int = 42) -> DataFrame:
    """Rows drawn with replacement so that classes have about equal weight."""
    w = class_weights(df, label_col)
    rows = df.join(w, label_col)
    times = F.floor("weight") + (F.rand(seed) < F.col("weight") - F.floor("weight")).cast("int")
    return rows.withColumn("_t", times.cast("int")).where("_t > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_t")))).drop("_i", "_t", "weight")


@dataclass
class Fitted:
    """A fitted network with its metrics on held-out rows."""

    model: Network
    metrics: dict = field(default_factory=dict)

    def __gt__(self, other: Fitted) -> bool:
        return self.metrics.get("balanced_accuracy", 0) > other.metrics.get("balanced_accuracy", 0)

    def save(self, path: str) -> None:
        self.model.save(SparkSession.getActiveSession(), path)

    @classmethod
    def load(cls, path: str) -> Fitted:
        return cls(Network.load(SparkSession.getActiveSession(), path))


def sample_coverage(df: DataFrame, sample: DataFrame, label_col: str = "label", id_col: str = "id") -> DataFrame:
    """Per label: rows, draws, and the share of the rows that a sample holds at least once."""
    n = df.groupBy(label_col).agg(F.count("*").alias("n_rows"))
    drawn = sample.groupBy(label_col).agg(F.count("*").alias("n_draws"), F.count_distinct(id_col).alias("_d"))
    return n.join(drawn, label_col, "left").select(label_col, "n_rows", F.coalesce("n_draws", F.lit(0)).alias("n_draws"), F.coalesce(F.col("_d") / F.col("n_rows"), F.lit(0.0)).alias("coverage"))


def weighted_loss(df: DataFrame, probability: str, weights: DataFrame, label_col: str = "label") -> DataFrame:
    """(loss): mean over the rows of the weighted cross-entropy of the probability of the true label."""
    x = df.join(F.broadcast(weights), label_col)
    return x.agg((-F.avg(F.col("weight") * F.log(F.greatest(F.col(probability), F.lit(1e-15))))).alias("loss"))


def fit(
    df: DataFrame, dims: list[int], vector_col: str = "embedding", label_col: str = "label", epochs: int = 50, balance: bool = True, seed: int = 42,
    validation: DataFrame | None = None, check_every: int = 10, rate: float = 0.01, id_col: str = "id",
) -> Fitted:
    """Scales (fitted on these rows) and a network of ReLU layers with the sizes dims.

    balance weights the loss of each row by its class's inverse frequency.  With
    validation rows the network is scored after every check_every epochs and
    after the last one, and the best by balanced accuracy stays; ``history`` in
    its metrics has each score, ``losses`` each epoch's mean weighted loss.
    """
    scored: list[Fitted] = []

    def check(epoch: int, net: Network) -> None:
        if validation is not None and (epoch % check_every == 0 or epoch == epochs):
            got = Fitted(net)
            got.metrics = confusion(predict(validation, got, vector_col=vector_col), label_col, "model_label").first().asDict() | {"epoch": epoch}
            scored.append(got)

    net, losses = fit_network(df, dims, vector_col, label_col, id_col, epochs, rate, weights="balanced" if balance else None, seed=seed, after_epoch=check)
    best = Fitted(net)
    for got in scored:
        best = got if not best.metrics or got > best else best
    history = [dict(got.metrics) for got in scored]
    best.metrics |= {"losses": losses} | ({"history": history} if history else {})
    return best


def predict(df: DataFrame, fitted: Fitted, name: str = "model", vector_col: str = "embedding") -> DataFrame:
    """df with {name}_label and {name}_output_i."""
    return fitted.model.predict(df, name, vector_col)


def predict_many(df: DataFrame, models: dict[str, Fitted], id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """id with {name}_label and {name}_output_i of each model; one pass over the rows."""
    out = df
    for name, fitted in models.items():
        out = predict(out, fitted, name, vector_col)
    return out.select(id_col, *[c for c in out.columns if any(c == f"{n}_label" or c.startswith(f"{n}_output_") for n in models)])


def write_predictions(stored: DataFrame, new: DataFrame, id_col: str = "id") -> DataFrame:
    """stored predictions with a model's new columns in place of its old ones; both must have the same ids, each once."""
    return upsert_columns(require_unique(stored, [id_col]), require_unique(new, [id_col]), id_col)


def fit_best(df: DataFrame, dims: list[int], n_splits: int = 1, **kwargs) -> Fitted:
    """The best of n_splits seeded cluster-stratified splits by balanced accuracy on its test rows."""
    best = None
    for i in range(n_splits):
        parts = cluster_stratified_split(df, seed=42 + i)
        got = fit(parts.where(~F.col("test")), dims, validation=parts.where("test"), **kwargs)
        best = got if best is None or got > best else best
    return best

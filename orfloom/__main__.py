"""Command line: ``python -m orfloom GROUP COMMAND ...``; tables are Parquet folders or CSV files with a header."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orfloom.operators import cluster, model, split, vectors
from orfloom.operators.relational import upsert_columns
from orfloom.sources import store, text_formats


def _table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True) if path.endswith(".csv") else spark.read.parquet(path)


def _save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def cluster_fit(spark, a) -> None:
    data = _table(spark, a.dataset_path)
    vectors.Preprocessor.fit(data, a.dims, a.feature_type).save(f"{a.output_path}/preprocessor")
    # As read back, so that rows met later are scaled and turned by the same numbers.
    kept = vectors.Preprocessor.load(spark, f"{a.output_path}/preprocessor")
    rows = kept.apply(data, a.feature_type).select("id", "label", F.col("features"))
    ids, log = cluster.bisecting_kmeans(rows, a.n_clusters, vector_col="features", strategy=a.bisecting_strategy)
    _save(rows.join(ids, "id"), f"{a.output_path}/rows")
    done = spark.read.parquet(f"{a.output_path}/rows")
    _save(cluster.centers(done, vector_col="features").join(cluster.cluster_labels(done, "id"), "cluster_id"), f"{a.output_path}/centers")
    _save(spark.createDataFrame(log, "step int, parent int, new int"), f"{a.output_path}/tree")


def cluster_predict(spark, a) -> None:
    kept = vectors.Preprocessor.load(spark, f"{a.cluster_path}/preprocessor")
    rows = kept.apply(_table(spark, a.input_path), a.feature_type)
    centers = spark.read.parquet(f"{a.cluster_path}/centers")
    near = cluster.nearest_centers(rows, centers, a.n, vector_col="features")
    _save(cluster.top_clusters_wide(near, centers, a.n), a.output_path)


def cluster_metric(spark, a) -> None:
    rows, centers = spark.read.parquet(f"{a.cluster_path}/rows"), spark.read.parquet(f"{a.cluster_path}/centers").select("cluster_id", "center")
    how = {
        "silhouette": lambda: cluster.silhouette(rows, centers, rows.orderBy(F.xxhash64("id")).limit(a.sample_size), vector_col="features"),
        "dunn": lambda: cluster.dunn(rows, centers, "features"),
        "davies-bouldin": lambda: cluster.davies_bouldin(rows, centers, vector_col="features"),
        "intra-dist": lambda: cluster.intra_distance(rows, centers, a.method, "features").agg(F.avg("intra").alias("intra")),
        "min-inter-dist": lambda: cluster.min_inter_distance(rows, centers, a.method, vector_col="features").agg(F.avg("min_inter").alias("min_inter")),
    }
    how[a.metric]().show(truncate=False)


def dataset_update(spark, a) -> None:
    new = _table(spark, a.input_path)
    columns = a.columns.split(",") if a.columns else [c for c in new.columns if c != "id"]
    _save(upsert_columns(_table(spark, a.dataset_path), new.select("id", *columns), "id"), a.output_path)


def dataset_split(spark, a) -> None:
    parts = split.cluster_stratified_split(_table(spark, a.dataset_path), a.test_size)
    _save(parts.where(~F.col("test")).drop("test"), f"{a.output_path}/train")
    _save(parts.where("test").drop("test"), f"{a.output_path}/test")


def dataset_graph(spark, a) -> None:
    rows = vectors.preprocess(_table(spark, a.dataset_path), a.dims, a.feature_type)
    edges = [vectors.knn(rows, rows, a.n_neighbors + 1, "id", "features")]
    edges += [vectors.radius_edges(rows, rows, a.radius, "id", "features")] if a.radius else []
    _save(vectors.merge_edges(*edges), a.output_path)


def _proteins(spark, paths) -> DataFrame:
    rows = text_formats.read_fasta(spark, list(paths))
    return rows.select("id", "seq", text_formats.genome_id(F.col("file_name"), "none").alias("genome_id"))


def library_add(spark, a) -> None:
    store.EmbeddingStore(spark, a.library_dir, a.feature_type, a.max_length).add(_proteins(spark, a.input_path), "genome_id")


def library_get(spark, a) -> None:
    ids = _table(spark, a.input_path)
    _save(store.EmbeddingStore(spark, a.library_dir, a.feature_type).get(ids, a.entry_name_col), a.output_path)


def embed(spark, a) -> None:
    rows = _table(spark, a.input_path)
    _save(rows.withColumn("embedding", store.EMBEDDERS[a.feature_type](F.col("seq"))), a.output_path)


def model_fit(spark, a) -> None:
    dims = [int(x) for x in a.dims.split(",")]
    model.fit_best(_table(spark, a.dataset_path), dims, a.n_splits, vector_col=a.feature_type, epochs=a.epochs).save(f"{a.output_dir}/{a.model_name}")


def model_predict(spark, a) -> None:
    models = {p.rstrip("/").rsplit("/", 1)[-1]: model.Fitted.load(p) for p in a.model_path}
    _save(model.predict_many(_table(spark, a.dataset_path), models, vector_col=a.feature_type), a.output_path)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="orfloom", description=__doc__)
    groups = top.add_subparsers(dest="group", required=True)
    made: dict = {}

    def command(group: str, name: str, run, *options):
        if group not in made:
            made[group] = groups.add_parser(group).add_subparsers(dest="command", required=True)
        p = made[group].add_parser(name)
        p.set_defaults(run=run)
        for flag, kw in options:
            p.add_argument(flag, **kw)

    need = lambda flag, **kw: (flag, {"required": True, **kw})
    may = lambda flag, default, **kw: (flag, {"default": default, **({"type": type(default)} if default is not None else {}), **kw})
    feature = may("--feature-type", "embedding")
    command("cluster", "fit", cluster_fit, need("--dataset-path"), need("--output-path"), feature, may("--n-clusters", 10_000), may("--bisecting-strategy", "largest_non_homogenous"), may("--dims", 100))
    command("cluster", "predict", cluster_predict, need("--input-path"), need("--cluster-path"), need("--output-path"), feature, may("--n", 10))
    command("cluster", "metric", cluster_metric, need("--cluster-path"), need("--metric"), may("--sample-size", 5000), may("--method", "center"))
    command("dataset", "update", dataset_update, need("--dataset-path"), need("--input-path"), need("--output-path"), may("--columns", None))
    command("dataset", "split", dataset_split, need("--dataset-path"), need("--output-path"), may("--test-size", 0.2))
    command("dataset", "graph", dataset_graph, need("--dataset-path"), need("--output-path"), feature, may("--radius", 0.0), may("--dims", 1280), may("--n-neighbors", 5))
    command("library", "add", library_add, need("--input-path", nargs="+"), need("--library-dir"), may("--feature-type", "aac"), may("--max-length", 2000))
    command("library", "get", library_get, need("--input-path"), need("--library-dir"), need("--output-path"), may("--feature-type", "aac"), may("--entry-name-col", "genome_id"))
    command("model", "fit", model_fit, need("--dataset-path"), need("--model-name"), need("--output-dir"), feature, may("--dims", "1280,1024,512,2"), may("--epochs", 50), may("--n-splits", 1))
    command("model", "predict", model_predict, need("--dataset-path"), need("--model-path", nargs="+"), need("--output-path"), feature)
    command("sequences", "embed", embed, need("--input-path"), need("--output-path"), may("--feature-type", "aac"))
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(SparkSession.builder.appName("orfloom").getOrCreate(), a)


if __name__ == "__main__":
    main()

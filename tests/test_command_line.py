"""The command line, end to end on small tables."""

import random

from orfloom.__main__ import main


def test_commands(spark, tmp_path):
    r = random.Random(2)
    at = lambda name: str(tmp_path / name)
    rows = [(i, [r.gauss(4 * (i % 3), 0.5) for _ in range(4)], int(i % 3 == 0), i % 3) for i in range(60)]
    spark.createDataFrame(rows, "id long, embedding array<double>, label int, cluster_id int").write.parquet(at("data"))
    main(["cluster", "fit", "--dataset-path", at("data"), "--output-path", at("clusters"), "--n-clusters", "3", "--dims", "2"])
    assert spark.read.parquet(at("clusters/rows")).select("cluster_id").distinct().count() == 3 and spark.read.parquet(at("clusters/tree")).count() == 2
    main(["cluster", "predict", "--input-path", at("data"), "--cluster-path", at("clusters"), "--output-path", at("near"), "--n", "2"])
    near = spark.read.parquet(at("near")).join(spark.read.parquet(at("clusters/rows")).select("id", "cluster_id"), "id")
    assert near.count() == 60 and near.where("top_cluster_id = cluster_id and rank_2_cluster_distance > top_cluster_distance").count() == 60
    # One row alone is met by the scales and components of the fit, not by its own.
    spark.read.parquet(at("data")).where("id = 7").write.parquet(at("one"))
    main(["cluster", "predict", "--input-path", at("one"), "--cluster-path", at("clusters"), "--output-path", at("near_one"), "--n", "2"])
    assert spark.read.parquet(at("near_one")).collect() == spark.read.parquet(at("near")).where("id = 7").collect()
    for metric in ("silhouette", "dunn", "davies-bouldin", "intra-dist", "min-inter-dist"):
        main(["cluster", "metric", "--cluster-path", at("clusters"), "--metric", metric])
    main(["dataset", "split", "--dataset-path", at("data"), "--output-path", at("parts")])
    assert (spark.read.parquet(at("parts/train")).count(), spark.read.parquet(at("parts/test")).count()) == (48, 12)
    main(["dataset", "graph", "--dataset-path", at("data"), "--output-path", at("graph"), "--n-neighbors", "2", "--dims", "2"])
    assert spark.read.parquet(at("graph")).where("src <> dst").count() >= 120
    spark.createDataFrame([(i, i * 2) for i in range(60)], "id long, more long").write.parquet(at("more"))
    main(["dataset", "update", "--dataset-path", at("data"), "--input-path", at("more"), "--output-path", at("updated"), "--columns", "more"])
    assert spark.read.parquet(at("updated")).where("more = 2 * id").count() == 60
    (tmp_path / "GCF_1.1_x.faa").write_text(">p1\nMKV\n>p2\nMMK*\n")
    main(["library", "add", "--input-path", at("GCF_1.1_x.faa"), "--library-dir", at("library")])
    spark.createDataFrame([("p1", "GCF_1.1")], "id string, genome_id string").write.parquet(at("ids"))
    main(["library", "get", "--input-path", at("ids"), "--library-dir", at("library"), "--output-path", at("got")])
    assert len(spark.read.parquet(at("got")).first().embedding) == 20
    main(["model", "fit", "--dataset-path", at("data"), "--model-name", "m1", "--output-dir", at("models"), "--dims", "4,3,2", "--epochs", "10"])
    main(["model", "predict", "--dataset-path", at("data"), "--model-path", at("models/m1"), "--output-path", at("predicted")])
    assert spark.read.parquet(at("predicted")).columns == ["id", "m1_label", "m1_output_0", "m1_output_1"]

"""Cluster-stratified train/test splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def test_quotas(sizes: DataFrame, test_size: float) -> DataFrame:
    """sizes (cluster, _size) of clusters of two rows or more, with _quota: test rows of each.

    The quotas' sum is exactly max(clusters, int(rows * test_size)): each cluster
    gets one, and the rest of its share rounded down; what is left goes to the
    clusters with the largest fractions (then the larger cluster, then the key),
    one more each.
    """
    key = sizes.columns[0]
    total = sizes.agg(F.count("*").alias("_k"), F.coalesce(F.sum("_size"), F.lit(0)).alias("_m"))
    want = F.greatest(F.col("_k"), F.floor(F.col("_m") * F.lit(test_size)))
    # Beyond its first row a cluster gives at most _size - 2 (one stays train): its share of what is wanted is in proportion.
    q = sizes.join(F.broadcast(total)).withColumn("_want", F.least(want, F.col("_m") - F.col("_k")))
    rest, spare = F.col("_want") - F.col("_k"), F.col("_m") - 2 * F.col("_k")
    q = q.withColumn("_share", F.coalesce(F.try_divide(rest * (F.col("_size") - 2), spare), F.lit(0.0))).withColumn("_down", F.floor("_share"))
    left = F.col("_want") - F.col("_k") - F.sum("_down").over(Window.partitionBy())
    # One row for each cluster.
    place = F.row_number().over(Window.orderBy(F.desc(F.col("_share") - F.col("_down")), F.desc("_size"), key))
    return q.withColumn("_quota", 1 + F.col("_down") + (place <= left).cast("long")).select(key, "_size", "_quota")


def cluster_stratified_split(
    df: DataFrame, test_size: float = 0.2, seed: int = 42, id_col: str = "id", cluster_col: str = "cluster_id", label_col: str = "label", n_splits: int = 1
) -> DataFrame:
    """df with ``test``; with n_splits > 1 each row once for each ``split`` (0, 1, ...), with splits of their own.

    Clusters of one row are always train.  Of the rows of other clusters
    int(rows * test_size) are test, and at least one of each cluster, spread in
    proportion to the clusters' sizes.  Members are ordered by a seeded hash.  A
    cluster with several labels is an error.
    """
    c = df.groupBy(cluster_col).agg(F.count("*").alias("_size"), F.count_distinct(label_col).alias("_l"))
    bad = c.where("_l > 1").limit(3).collect()
    if bad:
        raise ValueError(f"clusters with several labels: {[r[0] for r in bad]}")
    quota = test_quotas(c.where("_size > 1").select(cluster_col, "_size"), test_size)
    rows = df.join(quota.select(cluster_col, "_quota"), cluster_col, "left")
    if n_splits > 1:
        rows = rows.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    keys = [cluster_col, *(["split"] if n_splits > 1 else [])]
    order = F.xxhash64(id_col, F.lit(seed), *(["split"] if n_splits > 1 else []))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order, id_col))
    return rows.withColumn("test", rank <= F.coalesce("_quota", F.lit(0))).drop("_quota")

"""The tree of a bisecting run: its nodes, the ancestors of its clusters, and how far up one label goes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orfloom.operators.relational import checkpoints


def tree_nodes(log: DataFrame) -> DataFrame:
    """(cluster_id, step, node, parent) of a split log (step, parent, new): steps count from 1, cluster 0 is the root.

    Step s makes nodes 2s - 1 (what stays of the cluster that is split) and 2s
    (the new cluster); node 0 holds all rows.
    """
    both = F.explode(F.array(F.struct(F.col("parent").alias("cluster_id"), (2 * F.col("step") - 1).alias("node")), F.struct(F.col("new").alias("cluster_id"), (2 * F.col("step")).alias("node"))))
    made = log.select("step", F.col("parent").alias("split"), both.alias("x")).select("step", "split", "x.*")
    before = F.lag("node").over(Window.partitionBy("cluster_id").orderBy("step"))
    # A new cluster's parent is the node that its step split, which is the other child's.
    own = made.withColumn("before", F.when(F.col("cluster_id") == F.col("split"), F.coalesce(before, F.lit(0))))
    parent = own.where("cluster_id = split").select("step", F.col("before").alias("parent"))
    return own.drop("before", "split").join(parent, "step").select("cluster_id", "step", "node", "parent")


def cluster_ancestors(log: DataFrame) -> DataFrame:
    """(cluster_id, node, distance) of each final cluster: its own node (distance 0) and those above, up to node 0.

    A recursive query whose rounds are the tree's depth; its rows are the sum of
    the clusters' depths.  The session's limits on recursion are lifted.
    """
    spark = log.sparkSession
    for limit in ("spark.sql.cteRecursionLevelLimit", "spark.sql.cteRecursionRowLimit"):
        spark.conf.set(limit, "-1")
    checkpoints(spark)
    nodes = tree_nodes(log).checkpoint()  # each round of the recursion reads it
    leaves = nodes.groupBy("cluster_id").agg(F.max_by("node", "step").alias("node")).checkpoint()
    return spark.sql(
        """WITH RECURSIVE up(cluster_id, node, distance) AS (
             SELECT cluster_id, node, 0 FROM {leaves} UNION ALL
             SELECT up.cluster_id, t.parent, up.distance + 1 FROM up JOIN {nodes} t ON t.node = up.node)
           SELECT * FROM up""",
        leaves=leaves, nodes=nodes,
    ).checkpoint()


def _climb(rows: DataFrame) -> DataFrame:
    """rows (node, parent, lo, hi) as (node, top, distance, lo, hi): the end of each node's parents, how far it is, and the least lo and most hi below the node.

    Each round doubles a step, so rounds are the logarithm of the depth, and a round has a row for each node.
    Before round k, p is the ancestor 2**k up, and lo and hi are those of descendants less than 2**k below.
    """
    now = rows.select("node", F.col("parent").alias("p"), F.coalesce("parent", "node").alias("top"), F.col("parent").isNotNull().cast("int").alias("distance"), "lo", "hi").checkpoint()
    while now.where("p is not null").limit(1).count():
        below = now.where("p is not null").groupBy(F.col("p").alias("node")).agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi"))
        above = now.select(F.col("node").alias("p"), F.col("p").alias("_p"), F.col("top").alias("_top"), F.col("distance").alias("_d"))
        far = now.where("p is not null").join(above, "p").select("node", F.col("_p").alias("p"), F.col("_top").alias("top"), (F.col("distance") + F.col("_d")).alias("distance"), "lo", "hi")
        done = now.where("p is null").select("node", "p", "top", "distance", "lo", "hi")
        new = far.union(done).join(below, "node", "left")
        now = new.select("node", "p", "top", "distance", F.least("lo", "_lo").alias("lo"), F.greatest("hi", "_hi").alias("hi")).checkpoint()
    return now.drop("p")


def homogeneous_ancestors(log: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster_id, depth, homogeneous_depth, ancestor): splits above each cluster, and up to its highest ancestor of one label.

    labels has (cluster_id, label) of the final clusters, repeated rows allowed.
    A cluster with several labels, or none, has -1 and no ancestor.
    """
    checkpoints(log.sparkSession)
    made = tree_nodes(log).checkpoint()
    own = labels.where("label is not null").groupBy("cluster_id").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    leaves = made.groupBy("cluster_id").agg(F.max_by("node", "step").alias("node")).join(own, "cluster_id", "left").checkpoint()
    # The root is the one parent that no step made.
    root = made.select(F.col("parent").alias("node")).join(made.select("node"), "node", "left_anti").distinct()
    nodes = made.select("node", "parent").unionByName(root, allowMissingColumns=True)
    tree = _climb(nodes.join(leaves.select("node", "lo", "hi"), "node", "left"))
    # Above a labelled cluster, ancestors have one label up to some node and none beyond it.
    one = tree.where("lo = hi").select("node", "lo", "hi")
    edges = one.join(nodes, "node").join(one.select(F.col("node").alias("parent"), F.lit(True).alias("_same")), "parent", "left")
    best = _climb(edges.select("node", F.when(F.col("_same"), F.col("parent")).alias("parent"), "lo", "hi"))
    out = leaves.select("cluster_id", "node", F.coalesce(F.expr("lo = hi"), F.lit(False)).alias("own")).join(tree.select("node", F.col("distance").alias("depth")), "node")
    out = out.join(best.select("node", "top", "distance"), "node", "left")
    # A cluster without labels of its own does not count, even where its neighbours share one.
    return out.select("cluster_id", "depth", F.when(F.col("own"), F.col("distance")).otherwise(-1).alias("homogeneous_depth"), F.when(F.col("own"), F.col("top")).alias("ancestor"))

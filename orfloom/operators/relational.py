"""Relational operators with defined order, nulls and integrity checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key by a stated order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def lookup(df: DataFrame, table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left join on the first row of each key of the table (rows come in no order: values are taken by minimum)."""
    one = table.groupBy(key).agg(F.min(F.struct(*columns)).alias("_v")).select(key, *[F.col(f"_v.{c}").alias(c) for c in columns])
    return df.join(one, key, "left")


def missing_keys(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Keys of df that the table lacks: empty where integrity holds."""
    return df.select(key).distinct().join(table.select(key), key, "left_anti")


def require_keys(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """df, after a check that each key is in the table; raises KeyError otherwise."""
    bad = missing_keys(df, table, key).limit(5).collect()
    if bad:
        raise KeyError(f"{key} not found: {[r[0] for r in bad]}")
    return df


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, after a check that keys are unique."""
    if df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"{keys} are not unique")
    return df


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join after a check that the keys are unique on both sides; raises ValueError otherwise."""
    return require_unique(left, keys).join(require_unique(right, keys), keys, how)


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join after a check that the keys are unique on the right; raises ValueError otherwise."""
    return left.join(require_unique(right, keys), keys, how)


def joined_values(value: str, order: str, delimiter: str = ";"):
    """Distinct values of a group in the order in which they first come."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return F.array_join(F.array_distinct(F.transform(pairs, lambda x: x.v)), delimiter)


def upsert_columns(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """stored with new's columns added or replaced, aligned on key; both must have the same keys."""
    require_keys(stored, new, key)
    require_keys(new, stored, key)
    return stored.drop(*[c for c in new.columns if c != key]).join(new, key)


#: A key with a share of 1 / HOT_KEYS of the rows is salted, to SALTS parts.
HOT_KEYS, SALTS = 1024, 32


def salted_join(rows: DataFrame, values: DataFrame, key: str, by: str) -> DataFrame:
    """rows joined to values on key (inner); rows of a key that holds a large share of them are dealt to parts by a hash of ``by``.

    values' rows of such keys (at most HOT_KEYS of them) go to each part.
    """
    counts = rows.groupBy(key).count()
    total = rows.count()
    hot = counts.where((F.col("count") * HOT_KEYS >= total) & (F.col("count") > SALTS)).select(key).withColumn("_hot", F.lit(True))
    hot = F.broadcast(hot)
    left = rows.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0)).drop("_hot")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = values.join(hot, key, "left").withColumn("_salt", F.explode(parts)).drop("_hot")
    return left.join(right, [key, "_salt"]).drop("_salt")


def checkpoints(spark) -> None:
    """The session's checkpoint folder: spark.checkpoint.dir, which a cluster must set; a local master gets one."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints")


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """df, written into the checkpoint folder in buckets by key: joins on the key read it without a shuffle, as often as they come.

    (A checkpoint under adaptive execution does not tell how it is partitioned.)
    """
    spark = df.sparkSession
    checkpoints(spark)
    parts, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"orfloom_{uuid.uuid4().hex}"
    where = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    dealt = df.repartition(parts, key).sortWithinPartitions(key)
    dealt.write.bucketBy(parts, key).sortBy(key).option("path", where).option("compression", "zstd").format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay, with the checkpoints
    return table

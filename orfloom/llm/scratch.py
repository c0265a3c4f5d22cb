"""Intermediate tables in the folder that the cluster shares (``spark.checkpoint.dir``).

They cut lineage and survive the loss of executors.  The folder's name comes
from the session; only where it is unset and the master is local (tests) is a
local folder used.  Tables written by this process are removed when it ends.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where spark.checkpoint.dir is unset.
LOCAL_DIR = "/tmp/checkpoints"

#: Rows of an Arrow batch of whole texts; bounds what a Python worker and its JVM hold at once.
BATCH_ROWS = 2000
#: Bytes of such a batch, where texts are very long.
BATCH_BYTES = 16 << 20

_written: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
    return (spark.conf.get("spark.checkpoint.dir", None) or f"file://{LOCAL_DIR}").rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Texts are long: let this session's Arrow batches hold at most BATCH_ROWS rows and about BATCH_BYTES bytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{folder(spark)}/orfloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def remove(*dfs: DataFrame) -> None:
    """Delete the given tables' files; the tables must not be read any more."""
    gone = {f.rsplit("/", 1)[0] for df in dfs for f in df.inputFiles()}
    for spark, path in list(_written):
        if any(g.split(":", 1)[-1].lstrip("/") == path.split(":", 1)[-1].lstrip("/") for g in gone):
            _delete(spark, path)
            _written.remove((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _cleanup() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended first
            return

"""Incremental additions to the embedding store from a folder of FASTA files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orfloom.sources.store import EmbeddingStore


def stream_fasta_into(spark: SparkSession, folder: str, store: EmbeddingStore, checkpoint: str) -> StreamingQuery:
    """Start a query that adds the proteins of each new file once; ids that are stored are passed over."""
    raw = spark.readStream.option("lineSep", "\n>").text(folder).select("value", F.col("_metadata.file_name").alias("entry_name"))
    text = F.regexp_replace("value", r"^\s*>", "")
    rows = raw.where(F.trim("value") != "").select(
        F.regexp_extract(text, r"^(\S+)", 1).alias("id"), F.regexp_replace(F.regexp_replace(text, r"^[^\n]*\n?", ""), r"[\s*]", "").alias("seq"), "entry_name"
    )

    def add(batch: DataFrame, epoch: int) -> None:
        store.add(batch)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

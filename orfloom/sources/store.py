"""The embedding store: Parquet by feature type and entry, appended once per id."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orfloom.functions.seq import composition

#: Embedders by feature type: sequence column -> ARRAY<DOUBLE> column.
EMBEDDERS: dict[str, Callable] = {"aac": composition}


def register_embedder(feature_type: str, embed: Callable) -> None:
    """Add an embedder, such as a pandas UDF around a protein language model."""
    EMBEDDERS[feature_type] = embed


class EmbeddingStore:
    """A folder with partitions feature_type=.../entry_name=..."""

    def __init__(self, spark: SparkSession, path: str, feature_type: str = "aac", max_length: int = 2000):
        if feature_type not in EMBEDDERS:
            raise KeyError(f"no embedder {feature_type!r}; there are {sorted(EMBEDDERS)}")
        self.spark, self.path, self.feature_type, self.max_length = spark, path, feature_type, max_length

    def read(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path).where(F.col("feature_type") == self.feature_type)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def add(self, proteins: DataFrame, entry_col: str = "entry_name") -> None:
        """Embed and append the (id, seq, entry) rows that are shorter than max_length and not stored yet."""
        new = proteins.where(F.length("seq") < self.max_length).groupBy("id", F.col(entry_col).alias("entry_name")).agg(F.min("seq").alias("seq"))
        old = self.read()
        if old is not None:
            new = new.join(old.select("id", "entry_name"), ["id", "entry_name"], "left_anti")
        rows = new.select("id", EMBEDDERS[self.feature_type](F.col("seq")).alias("embedding"), F.lit(self.feature_type).alias("feature_type"), "entry_name")
        rows.repartition("entry_name").write.mode("append").partitionBy("feature_type", "entry_name").parquet(self.path)

    def get(self, ids: DataFrame, entry_col: str = "entry_name") -> DataFrame:
        """(id, entry_name, embedding) of ids; raises KeyError where one is missing."""
        have = self.read()
        wanted = ids.select("id", F.col(entry_col).alias("entry_name")).distinct()
        if have is None:
            raise KeyError("the store is empty")
        got = wanted.join(have.dropDuplicates(["id", "entry_name"]).select("id", "entry_name", "embedding"), ["id", "entry_name"], "left")
        bad = got.where("embedding is null").limit(5).collect()
        if bad:
            raise KeyError(f"not stored: {[r['id'] for r in bad]}")
        return got


def write_dataset(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_dataset(spark: SparkSession, path: str, attrs: list[str] | None = (), feature: str = "embedding") -> DataFrame:
    """id and the feature column with attrs (None: all columns); only those columns are read."""
    df = spark.read.parquet(path)
    return df if attrs is None else df.select("id", feature, *attrs)


def snake_case(df: DataFrame) -> DataFrame:
    return df.toDF(*[re.sub(r"\W+", "_", c.strip()).lower() for c in df.columns])


def read_genome_metadata(spark: SparkSession, genomes: str, taxonomy: str, key: str = "organism_taxonomic_id") -> DataFrame:
    """Genome rows with their taxonomy: names in snake case, the first row of each taxon."""
    g = snake_case(spark.read.csv(genomes, sep="\t", header=True))
    t = snake_case(spark.read.csv(taxonomy, sep="\t", header=True))
    t = t.withColumnRenamed(t.columns[0], key)
    return g.join(t.dropDuplicates([key]), key, "left")

"""A corpus pipeline of operators of orfloom.llm: STAGES, run() and its SQL.

Every stage takes nulls in any column, empty and very long texts, repeated rows,
ties and an empty table (which gives an empty one); columns beside doc_id, text,
lang, source and n_chars pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orfloom.llm import scratch
from orfloom.llm.line_dedup import drop_repeated_lines
from orfloom.llm.ngram_join import shingle_classes
from orfloom.llm.packing import pack_documents
from orfloom.llm.quality_rules import apply_rules
from orfloom.llm.substring_dedup import cut_repeats

_WORD = r"[^\x20\x09-\x0D]"


def _row(docs: DataFrame):
    """All columns but the text as one: operators add columns of their own, which may have names of docs'."""
    return F.struct(*[c for c in docs.columns if c != "text"]).alias("row")


def _with_text(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs from ``row``, with the text of out and its length."""
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep.

    Repeated rows count each and go or stay together; a null text is empty and
    goes; null ids, languages and sources are values like any other.
    """
    out = apply_rules(docs.select(_row(docs), "text", "lang", "source"), columns=["row", "text"]).where("kept")
    return out.select(*[(F.col(c) if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs; a document that loses its last word goes.

    Rows with one id and one text are one text: they lose the same lines, and
    none because of each other.  A null id comes last; a null text stays.
    """
    out = drop_repeated_lines(docs.select(_row(docs), "doc_id", "text")).where((F.col("n_removed") == 0) | F.col("text").rlike(_WORD))
    return _with_text(out, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of five-word-shingle sets with a similarity of 0.8 or more: the smallest id (null last), then hash of the row.

    Rows go by a hash of all their columns, not by id: repeated rows, null ids
    and one id with several texts leave one row of a group.  Wordless texts are
    in no group and stay.
    """
    key = F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns])
    keyed = docs.select(F.struct("*").alias("row"), "doc_id", "text", key.alias("_key"))
    classes = shingle_classes(keyed, id_col="_key", shingle=5, threshold=80).where("n_shingles > 0").select("_key", "component_id").distinct()
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key"))
    ids = keyed.select("_key", "doc_id").distinct()
    stay = classes.join(ids, "_key").groupBy("component_id").agg(least.alias("least")).select("least._key")
    wordless = keyed.where(~F.coalesce(F.col("text"), F.lit("")).rlike(_WORD))
    return keyed.join(stay, "_key").dropDuplicates(["_key"]).select("row.*").union(wordless.select("row.*"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated 35-word windows; a document that loses its last word goes.

    Every row is a document here, so two rows with one text lose all that they
    share; the stage before leaves no such rows.  Texts without repeats stay as
    they are (null becomes empty); others are their words that stay, joined by
    spaces.
    """
    out = cut_repeats(docs.select(_row(docs), "text"), id_col="row").where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    return _with_text(out.select("row", text.alias("text")), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, packed into sequences; a null text is empty, and repeated rows are packed each."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("packing", packing),
]

#: SQL cannot express the tokenizer; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Boilerplate by a host suffix array: what long runs of words a host's pages share.

The words of each page's visible blocks are one stream; the streams of a host
are ranked by prefix doubling (runs of 1, 2, 4, ... words, as in line dedup).
A run of ``window`` words is boilerplate if it is found on two pages of the host
or more; all words that such runs cover are removed, and the others stay.

This is the dealt method of HTML extraction on its own.  op7 does not use it:
see the README for what both find on the test pages.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orfloom.llm import scratch
from orfloom.llm.html_text import page_blocks

#: Words of a run that is boilerplate if two pages share it.
WINDOW = 8


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without a port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def shared_words(words: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, seq) of the words (host, doc, seq, word) in runs of ``window`` words that another doc of the host has too."""
    several = lambda rows, keys: rows.groupBy(*keys).agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").drop("lo", "hi")
    rank = lambda t, keys, name: scratch.table(several(t, keys).orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()), name)
    t = words.select("host", "doc", "seq", F.xxhash64("word").alias("a"), F.xxhash64(F.lit(1), "word").alias("b"))
    keys, half = ["host", "a", "b"], 1
    active = scratch.table(t.join(rank(t, keys, "host1"), keys).select("host", "doc", "seq", "rank"), "hostlevel1")
    while half < window:
        step = min(half, window - half)  # the last runs overlap
        ahead = Window.partitionBy("doc").orderBy("seq").rangeBetween(step, step)
        pairs = active.select("host", "doc", "seq", F.col("rank").alias("a"), F.first("rank").over(ahead).alias("b")).where("b is not null")
        half += step
        active = scratch.table(pairs.join(rank(pairs, keys, f"host{half}"), keys).select("host", "doc", "seq", "rank"), f"hostlevel{half}")
    return active.select("doc", F.explode(F.sequence("seq", F.col("seq") + window - 1)).alias("seq")).distinct()


def unique_text(pages: DataFrame, window: int = WINDOW, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id_col, url_col, text: the visible blocks without words that other pages of the host share.

    Null html is empty; pages without a host are one host; rows with one id, URL
    and html are one page; an empty table gives an empty result.
    """
    scratch.small_batches(pages.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def rows(batches):
        for batch in batches:
            own = [[t for _, t in page_blocks(x or "")] for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), batch.column("doc"), pa.array(own, pa.list_(pa.string()))], ["id", "url", "doc", "blocks"])

    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.xxhash64(id_col, url_col, html_col).alias("doc"), F.col(html_col).alias("html"))
    blocks = scratch.table(src.mapInArrow(rows, f"id {kinds[id_col]}, url {kinds[url_col]}, doc long, blocks array<string>"), "blocks")
    flat = blocks.select(host_of(F.col("url")).alias("host"), "doc", F.posexplode(F.split(F.array_join("blocks", " "), " ")).alias("seq", "word"))
    gone = shared_words(flat.distinct(), window).groupBy("doc").agg(F.collect_set("seq").alias("gone"))

    def kept(batches):
        for batch in batches:
            out = []
            for own, off in zip(batch.column("blocks").to_pylist(), batch.column("gone").to_pylist()):
                off, at, lines = set(off or ()), 0, []
                for block in own:
                    words = block.split(" ")
                    lines.append(" ".join(w for i, w in enumerate(words, at) if i not in off))
                    at += len(words)
                out.append("\n".join(x for x in lines if x))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(out, pa.string())], ["id", "url", "text"])

    out = blocks.join(gone, "doc", "left").select("id", "url", "blocks", "gone").mapInArrow(kept, f"id {kinds[id_col]}, url {kinds[url_col]}, text string")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})

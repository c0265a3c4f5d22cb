"""Queries over whole comparisons, sequence search and clusters, and cluster trees, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from orfloom.functions.duplex import ANTI_SD, duplex
from orfloom.operators import cluster_tree, genes, search
from orfloom.operators.orfs import find_orfs, hit_sequences
from orfloom.plans.compare import compare
from orfloom.plans.conflict_queries import QUERIES, SQL
from orfloom.plans.queries import _IV, _rna, _t, intervals, query


@query(f"""WITH {_IV}, g AS (SELECT *, in_frame AND st <> 'error' AS f, NOT (sv < 20 AND st = 'purchase') AS ok FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, ok DESC, overlap_length DESC, subject_id) AS n FROM g),
c AS (SELECT query_id, count(*) AS n_hits, count(*) FILTER (WHERE ok) AS n_hits_supported, count(*) FILTER (WHERE f) AS n_hits_in_frame FROM g GROUP BY 1)
SELECT i.user_id % 2 AS genome_id, i.event_id AS query_id, coalesce(n_hits, 0) AS n_hits, coalesce(n_hits_supported, 0) AS n_hits_supported, coalesce(n_hits_in_frame, 0) AS n_hits_in_frame,
  coalesce(r.subject_id, 0) AS top_hit_ord, CASE WHEN r.subject_id % 3 = r.query_id % 3 THEN 1.0 ELSE 0.0 END AS sequence_identity,
  CASE WHEN r.subject_id IS NULL THEN 'intergenic' WHEN f AND st <> 'view' AND r.subject_id % 3 = r.query_id % 3 THEN 'match' WHEN st = 'error' AND qs = ss THEN 'pseudogene' ELSE 'conflict' END AS category
FROM iv i LEFT JOIN r ON r.query_id = i.event_id AND r.n = 1 LEFT JOIN c ON c.query_id = i.event_id WHERE i.event_type = 'click'""")
def q101_compare_genomes(spark, d):
    """Two genomes whose contigs have the same names: overlaps, alignment of the best hits, categories."""
    own = intervals(spark, d).withColumns({
        "genome_id": F.col("contig") % 2, "contig_id": F.concat(F.lit("c"), F.floor(F.col("contig") / 2).cast("string")), "seq": F.element_at(F.array(*[F.lit(x * 8) for x in "KLM"]), (F.col("id") % 3 + 1).cast("int")),
    })
    q = own.where("event_type = 'click'").select("genome_id", "contig_id", "id", "start", "stop", "strand", "seq")
    f = own.where("event_type <> 'click'").select(
        "genome_id", "contig_id", F.col("id").alias("ord"), F.when(F.col("event_type") == "view", "gap").otherwise("CDS").alias("feature"), "start", "stop", "strand",
        (F.col("event_type") == "error").alias("pseudo"), F.lit("1").alias("codon_start"), F.when(F.col("value") < 20, "hypothetical protein").otherwise("named").alias("product"),
        F.when(F.col("event_type") == "purchase", "ab initio prediction").otherwise("none").alias("evidence_type"), "seq",
    )
    return compare(q, f).select(
        F.col("query_genome_id").alias("genome_id"), "query_id", "n_hits", "n_hits_supported", "n_hits_in_frame", F.coalesce("top_hit_ord", F.lit(0)).alias("top_hit_ord"), "sequence_identity", "category"
    )


def _proteins(spark, d, table, id_col):
    """A text's letters that are residues, as a sequence."""
    seq = F.regexp_replace(F.upper("text"), f"[^{search.RESIDUES}]", "")
    return _t(spark, d, table).select(F.col(id_col).alias("id"), seq.alias("seq"))


@query()
def q102_sequence_search(spark, d):
    """benchmark's texts searched in those of all documents."""
    out = search.search(_proteins(spark, d, "benchmark", "item_id"), _proteins(spark, d, "documents", "doc_id"), max_e_value=1e-20, k=14, min_ungapped=60, neighbours=False)
    return out.drop("query_seq", "subject_seq")


@query()
def q103_sequence_clusters(spark, d):
    return search.cluster_sequences(_proteins(spark, d, "documents", "doc_id"), k=17)


@query("""WITH RECURSIVE l AS (SELECT c_custkey + 1 AS step, (c_nationkey * 31) % (c_custkey + 1) AS parent, c_custkey + 1 AS new FROM customer),
made AS (SELECT step, parent AS split, parent AS cluster_id, 2 * step - 1 AS node FROM l UNION ALL SELECT step, parent, new, 2 * step FROM l),
b AS (SELECT *, coalesce(lag(node) OVER (PARTITION BY cluster_id ORDER BY step), 0) AS before FROM made),
nodes AS (SELECT m.*, b.before AS parent FROM made m JOIN b ON b.step = m.step AND b.cluster_id = b.split),
leaves AS (SELECT cluster_id, arg_max(node, step) AS node FROM nodes GROUP BY 1),
up(cluster_id, node, distance) AS (SELECT cluster_id, node, 0 FROM leaves UNION ALL SELECT up.cluster_id, t.parent, distance + 1 FROM up JOIN nodes t ON t.node = up.node),
labels AS (SELECT DISTINCT o_custkey AS cluster_id, o_orderstatus = 'F' AS label FROM orders WHERE o_orderkey % 5 < 2),
one AS (SELECT node FROM up JOIN labels USING (cluster_id) GROUP BY 1 HAVING min(label) = max(label)),
own AS (SELECT cluster_id FROM labels GROUP BY 1 HAVING min(label) = max(label)),
best AS (SELECT cluster_id, max(distance) AS d, arg_max(node, distance) AS n FROM up JOIN one USING (node) SEMI JOIN own USING (cluster_id) GROUP BY 1)
SELECT up.cluster_id, max(distance) AS depth, coalesce(any_value(d), -1) AS homogeneous_depth, any_value(n) AS ancestor FROM up LEFT JOIN best USING (cluster_id) GROUP BY 1""")
def q104_cluster_tree(spark, d):
    """A split log with a step for each customer, and labels from orders."""
    c, k = _t(spark, d, "customer"), F.col("c_custkey") + 1
    log = c.select(k.alias("step"), ((F.col("c_nationkey") * 31) % k).alias("parent"), k.alias("new"))
    labels = _t(spark, d, "orders").where("o_orderkey % 5 < 2").select(F.col("o_custkey").alias("cluster_id"), (F.col("o_orderstatus") == "F").alias("label"))
    return cluster_tree.homogeneous_ancestors(log, labels)


@query()
def q105_gene_prediction(spark, d):
    """The documents of a source as contigs of a genome."""
    x = _t(spark, d, "documents").select(F.coalesce("source", F.lit("none")).alias("genome_id"), F.col("doc_id").alias("contig_id"), _rna().alias("seq"))
    return genes.predict_genes(x).withColumn("doc_id", F.col("contig_id").cast("long"))


@query()
def q106_ribosome_sites(spark, d):
    """Energy of the bases before each reading frame of the documents with a ribosome's end."""
    contigs = _t(spark, d, "documents").select(F.col("doc_id").alias("contig_id"), _rna().alias("seq"))
    frames = find_orfs(contigs).select("contig_id", *[F.col(c).alias(f"orf_{c}") for c in ("start", "stop", "strand")])
    site = hit_sequences(frames, contigs, "orf").withColumn("_d", duplex(F.col("orf_nt_seq_upstream"), F.lit(ANTI_SD)))
    return site.select(F.col("contig_id").alias("doc_id"), "orf_start", "orf_stop", "orf_strand", F.col("orf_nt_seq_upstream").alias("site"), F.round("_d.mfe", 6).alias("mfe"), "_d.mfe_struct")


__all__ = ["QUERIES", "SQL"]

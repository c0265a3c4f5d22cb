"""The library's queries over the driver's tables, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orfloom.functions import seq, stats
from orfloom.functions.align import align
from orfloom.operators import cluster, overlap, predicates, relational, tophit, vectors
from orfloom.operators.orfs import find_orfs
from orfloom.operators.split import cluster_stratified_split

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: An event is an interval of its user: 600 seconds for each k of its properties.
_IV = """iv AS (SELECT event_id, user_id, event_type, value, date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', ts)) AS start,
  date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', ts)) + 600 * CAST(json_extract_string(props, '$.k') AS BIGINT) AS stop,
  CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS strand FROM events),
hit AS (SELECT q.event_id AS query_id, s.event_id AS subject_id, q.user_id, q.start AS q0, q.stop AS q1, s.start AS s0, s.stop AS s1, q.strand AS qs, s.strand AS ss,
  s.event_type AS st, s.value AS sv, least(q.stop, s.stop) - greatest(q.start, s.start) + 1 AS overlap_length,
  CASE WHEN s.event_type = 'view' THEN NULL ELSE abs(CASE WHEN q.strand = -1 THEN q.stop ELSE q.start END - CASE WHEN s.strand = -1 THEN s.stop ELSE s.start END) % 3 END AS phase
  FROM iv q JOIN iv s ON q.user_id = s.user_id AND q.start <= s.stop AND s.start <= q.stop WHERE q.event_type = 'click' AND s.event_type <> 'click'),
h AS (SELECT *, coalesce(phase = 0 AND qs = ss, false) AS in_frame FROM hit)"""


def intervals(spark: SparkSession, d: str) -> DataFrame:
    start = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    k = F.get_json_object("props", "$.k").cast("long")
    return _t(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("contig"), "event_type", "value", start.alias("start"), (start + 600 * k).alias("stop"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("strand")
    )


def interval_hits(spark: SparkSession, d: str, bin_width: int | None = 21_600) -> DataFrame:
    iv = intervals(spark, d)
    s = iv.where("event_type <> 'click'").withColumn("feature", F.when(F.col("event_type") == "view", "gap").otherwise("CDS"))
    return overlap.hit_columns(overlap.overlap_join(iv.where("event_type = 'click'"), s, ["contig"], bin_width))


_Q01 = f"""WITH {_IV} SELECT query_id, subject_id, overlap_length, qs = ss AS same_strand, q0 = s0 AND q1 = s1 AS exact_match,
  CASE WHEN (q0 >= s0 AND q1 <= s1) OR (q0 <= s0 AND q1 >= s1) THEN 'nested' WHEN qs = ss THEN 'tandem'
       WHEN (qs = 1 AND q1 BETWEEN s0 AND s1) OR (qs = -1 AND q0 BETWEEN s0 AND s1) THEN 'convergent' ELSE 'divergent' END AS overlap_type,
  (q0 BETWEEN s0 AND s1)::INT::VARCHAR || (q1 BETWEEN s0 AND s1)::INT::VARCHAR AS query_overlap,
  (s0 BETWEEN q0 AND q1)::INT::VARCHAR || (s1 BETWEEN q0 AND q1)::INT::VARCHAR AS subject_overlap,
  phase::INT AS phase, in_frame, round(overlap_length / (q1 - q0 + 1), 6) AS query_overlap_fraction FROM h"""
_HIT = ["query_id", "subject_id", "overlap_length", "same_strand", "exact_match", "overlap_type", "query_overlap", "subject_overlap", "phase", "in_frame"]


@query(_Q01)
def q01_overlap_join(spark, d):
    return interval_hits(spark, d).select(*_HIT, F.round("query_overlap_fraction", 6).alias("query_overlap_fraction"))


@query(_Q01)
def q01b_overlap_join_keys_only(spark, d):
    return interval_hits(spark, d, None).select(*_HIT, F.round("query_overlap_fraction", 6).alias("query_overlap_fraction"))


_TOP = f"""WITH {_IV}, r AS (SELECT *, sv > 10 AS ok, row_number() OVER (PARTITION BY query_id ORDER BY in_frame DESC, coalesce(sv > 10, false) DESC, overlap_length DESC, subject_id) AS n FROM h),
c AS (SELECT query_id, count(*) AS n_hits, count(*) FILTER (WHERE ok) AS n_hits_supported, count(*) FILTER (WHERE qs = ss) AS n_hits_same_strand, count(*) FILTER (WHERE in_frame) AS n_hits_in_frame FROM r GROUP BY 1)"""


def _tops(spark, d):
    hits = interval_hits(spark, d).withColumn("subject_ord", F.col("subject_id"))
    q = intervals(spark, d).where("event_type = 'click'").select(F.col("id").alias("query_id"))
    return tophit.top_hits(hits, q, F.col("subject_value") > 10)


@query(f"""{_TOP} SELECT i.event_id AS query_id, coalesce(n_hits, 0) AS n_hits, coalesce(n_hits_supported, 0) AS n_hits_supported, coalesce(n_hits_same_strand, 0) AS n_hits_same_strand,
  coalesce(n_hits_in_frame, 0) AS n_hits_in_frame, r.subject_id AS top_hit_id, r.overlap_length FROM iv i LEFT JOIN r ON r.query_id = i.event_id AND r.n = 1 LEFT JOIN c ON c.query_id = i.event_id WHERE i.event_type = 'click'""")
def q02_top_hit(spark, d):
    return _tops(spark, d).select("query_id", "n_hits", "n_hits_supported", "n_hits_same_strand", "n_hits_in_frame", "top_hit_id", "overlap_length")


@query(f"""{_TOP}, a AS (SELECT i.event_id, r.*, overlap_length / (q1 - q0 + 1) AS identity FROM iv i LEFT JOIN r ON r.query_id = i.event_id AND r.n = 1 WHERE i.event_type = 'click')
SELECT CASE WHEN coalesce(st <> 'view' AND st <> 'error' AND in_frame AND identity > 0.5, false) THEN 'match' WHEN coalesce(st = 'error' AND qs = ss, false) THEN 'pseudogene'
  WHEN st IS NULL THEN 'intergenic' ELSE 'conflict' END AS category, count(*) AS n FROM a GROUP BY 1""")
def q03_annotate_category(spark, d):
    t = _tops(spark, d).withColumn("top_hit_pseudo", F.col("top_hit_event_type") == "error").withColumn("sequence_identity", F.col("query_overlap_fraction") + 0.3)
    return tophit.annotate(t).groupBy("category").agg(F.count("*").alias("n"))


@query(f"""WITH {_IV} SELECT a.event_id AS a_id, b.event_id AS b_id, greatest(a.start, b.start) - least(a.stop, b.stop) AS separation_length,
  greatest(1 - (greatest(a.start, b.start) - least(a.stop, b.stop)), 0) AS overlap_length, (abs(a.start - b.start) % 3)::INT AS phase
FROM iv a JOIN iv b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND greatest(a.start, b.start) - least(a.stop, b.stop) < 1000 WHERE a.event_type = 'click' AND b.event_type = 'click'""")
def q04_overlap_self_join(spark, d):
    return overlap.near_pairs(intervals(spark, d).where("event_type = 'click'"), ["contig"], "id", 1000).select("a_id", "b_id", "separation_length", "overlap_length", "phase")


@query("""SELECT doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1""")
def q05_keep_first_dedup(spark, d):
    return relational.keep_first(_t(spark, d, "documents"), ["text"], "doc_id").select("doc_id", "text")


@query("""SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS discount, round(stddev_samp(l_tax), 6) AS tax_std,
  count(DISTINCT o_orderpriority) AS priorities FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def q06_group_summary_rollup(spark, d):
    x = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return x.rollup(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"), F.round(F.stddev_samp("l_tax"), 6).alias("tax_std"), F.countDistinct("o_orderpriority").alias("priorities")
    )


@query("""SELECT doc_id, true AS labelled FROM documents SEMI JOIN labels USING (doc_id) UNION ALL SELECT doc_id, false FROM documents ANTI JOIN labels USING (doc_id)""")
def q07_semi_anti(spark, d):
    docs, labels = _t(spark, d, "documents").select("doc_id"), _t(spark, d, "labels")
    return docs.join(labels, "doc_id", "left_semi").withColumn("labelled", F.lit(True)).union(docs.join(labels, "doc_id", "left_anti").withColumn("labelled", F.lit(False)))


@query("""SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic, coalesce(d.source, 'none') AS source FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality, min(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id)""")
def q08_lookup_fill(spark, d):
    x = relational.lookup(_t(spark, d, "documents").select("doc_id", "source"), _t(spark, d, "labels"), "doc_id", ["quality", "toxic"])
    return tophit.fill_sentinels(x)


@query("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1""")
def q09_pivot_crosstab(spark, d):
    x = _t(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return x.select("o_orderpriority", *[F.coalesce(F.col(c), F.lit(0)).alias(c.lower()) for c in "FOP"])


@query("""SELECT l_orderkey, count(*) AS n, count(DISTINCT l_returnflag) = 1 AS homogeneous, bool_and(l_quantity > 5) AS all_large, count(*) = 1 AS singleton, round(count(*) FILTER (WHERE l_discount > 0.05) / count(*), 6) AS discounted FROM lineitem GROUP BY 1""")
def q10_all_predicate(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), (F.countDistinct("l_returnflag") == 1).alias("homogeneous"), F.bool_and(F.col("l_quantity") > 5).alias("all_large"),
        (F.count("*") == 1).alias("singleton"), F.round(stats.rate(F.col("l_discount") > 0.05), 6).alias("discounted"),
    )


@query("""SELECT r_name, string_agg(n_name, ';' ORDER BY n_nationkey) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def q11_string_agg(spark, d):
    x = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.groupBy("r_name").agg(relational.joined_values("n_name", "n_nationkey").alias("nations"))


@query("""SELECT label, CASE WHEN c > 0.15 THEN 'real' WHEN -c > 0.1 THEN 'spurious' ELSE 'uncertain' END AS model_label, count(*) AS n FROM (SELECT label, embedding[1]::DOUBLE AS c FROM embeddings) GROUP BY 1, 2""")
def q12_threshold_labels(spark, d):
    c = F.col("embedding")[0].cast("double")
    return _t(spark, d, "embeddings").withColumn("model_label", tophit.two_sided_label(c, -c, 0.15, 0.1)).groupBy("label", "model_label").agg(F.count("*").alias("n"))


_STEPS = [0.5 + 0.02 * i for i in range(20)] + [0.98]


@query(f"""WITH x AS (SELECT quality AS y, n_chars / 4000.0 AS s FROM labels JOIN documents USING (doc_id)), t AS (SELECT unnest([{", ".join(repr(float(x)) for x in _STEPS)}]) AS threshold)
SELECT threshold, count(*) FILTER (WHERE s > threshold) AS predicted, count(*) FILTER (WHERE s > threshold AND y = 1) AS tp,
  round(coalesce(count(*) FILTER (WHERE s > threshold AND y = 1) / nullif(count(*) FILTER (WHERE s > threshold), 0), 0), 6) AS precision,
  round(count(*) FILTER (WHERE s > threshold AND y = 1) / count(*) FILTER (WHERE y = 1), 6) AS recall FROM x, t GROUP BY 1""")
def q13_threshold_sweep(spark, d):
    x = _t(spark, d, "labels").join(_t(spark, d, "documents"), "doc_id").select(F.col("quality").alias("y"), (F.col("n_chars") / 4000.0).alias("s"))
    return stats.threshold_sweep(x, "s", "y", _STEPS).withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


_GRID = "(SELECT unnest(range(0, ceil(max(n_chars) / 250.0)::BIGINT + 1)) AS g FROM documents)"


def _bins(spark, d, **how):
    docs = _t(spark, d, "documents")
    last = 250.0 * (docs.agg(F.ceil(F.max("n_chars") / 250.0).alias("g")).first()["g"] or 0)
    return stats.sliding_bins(docs, "n_chars", 0.0, last, 250.0, 500.0, F.count("*").alias("n"), F.round(F.avg(F.length("text")), 4).alias("mean"), **how)


@query(f"""SELECT g * 250.0 AS center, count(*) AS n, round(avg(length(text)), 4) AS mean FROM documents, {_GRID} WHERE abs(n_chars - g * 250.0) < 500 GROUP BY 1""")
def q14_sliding_bins(spark, d):
    return _bins(spark, d)


@query(SQL["q14_sliding_bins"].replace("< 500", "<= 500"))
def q14b_sliding_bins_inclusive(spark, d):
    return _bins(spark, d, inclusive=True)


@query("""SELECT l_quantity, round(max(c), 8) AS ecdf FROM (SELECT l_quantity, cume_dist() OVER (ORDER BY l_quantity) AS c FROM lineitem) GROUP BY 1""")
def q15_ecdf(spark, d):
    return stats.ecdf(_t(spark, d, "lineitem"), "l_quantity").withColumn("ecdf", F.round("ecdf", 8))


@query("""SELECT l_extendedprice, round(max(c), 8) AS ecdf FROM (SELECT l_extendedprice, cume_dist() OVER (ORDER BY l_extendedprice) AS c FROM lineitem) GROUP BY 1""")
def q15b_ecdf_continuous(spark, d):
    return stats.ecdf(_t(spark, d, "lineitem"), "l_extendedprice").withColumn("ecdf", F.round("ecdf", 8))


_RNA = "translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGUACGUACGUACGUACGUACGUAC')"


def _rna():
    return F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGUACGUACGUACGUACGUACGUAC")


@query(f"""SELECT doc_id, length(s) AS n, reverse(translate(s, 'ACGU', 'UGCA')) AS rc, round(len(regexp_extract_all(s, '[GC]')) / nullif(length(s), 0), 6) AS gc, length(s) - length(replace(s, 'A', '')) AS n_a FROM (SELECT doc_id, {_RNA} AS s FROM documents)""")
def q16_seq_functions(spark, d):
    x = _t(spark, d, "documents").select("doc_id", _rna().alias("s"))
    return x.select("doc_id", F.length("s").cast("long").alias("n"), seq.reverse_complement(F.col("s")).alias("rc"), F.round(seq.gc_content(F.col("s")), 6).alias("gc"), seq.residue_count(F.col("s"), "A").cast("long").alias("n_a"))


@query(f"""WITH x AS (SELECT doc_id, {_RNA} AS s FROM documents), b AS (SELECT doc_id, length(s) AS n, 1 AS strand, s FROM x UNION ALL SELECT doc_id, length(s), -1, reverse(translate(s, 'ACGU', 'UGCA')) FROM x),
c AS (SELECT doc_id, n, strand, unnest(range(0, n - 2)) AS p, s FROM b), k AS (SELECT doc_id, n, strand, p, substr(s, p + 1, 3) AS codon FROM c),
e AS (SELECT *, min(CASE WHEN codon IN ('UAA', 'UAG', 'UGA') THEN p END) OVER (PARTITION BY doc_id, strand, p % 3 ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop_at FROM k)
SELECT doc_id, strand, CASE WHEN strand = 1 THEN p + 1 ELSE n - stop_at - 2 END AS start, CASE WHEN strand = 1 THEN stop_at + 3 ELSE n - p END AS stop, ((stop_at - p) // 3)::BIGINT AS length
FROM e WHERE codon IN ('AUG', 'GUG', 'UUG') AND stop_at - p >= 150""")
def q17_codon_orfs(spark, d):
    x = find_orfs(_t(spark, d, "documents").select(F.col("doc_id").alias("contig_id"), _rna().alias("seq")))
    return x.select(F.col("contig_id").alias("doc_id"), "strand", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.length("seq").cast("long").alias("length"))


def _vectors(spark, d):
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


@query("""SELECT a.vec_id AS i, b.vec_id AS j, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id""")
def q18_pair_distance(spark, d):
    v = _vectors(spark, d)
    return vectors.pair_distances(v, v, "id", "embedding", 4)


_KNN = """e AS (SELECT a.vec_id AS src, b.vec_id AS dst, a.label AS la, b.label AS lb, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a, embeddings b),
k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS n FROM e)"""


@query(f"""WITH {_KNN} SELECT src, n::INT AS rank, dst, round(d, 4) AS distance FROM k WHERE n <= 5""")
def q19_knn_top_k(spark, d):
    v = _vectors(spark, d)
    return vectors.knn(v, v, 5, "id", "embedding").select("src", "rank", "dst", F.round("distance", 4).alias("distance"))


@query("""SELECT a.vec_id AS src, b.vec_id AS dst, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS distance FROM embeddings a, embeddings b WHERE list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= 1.2""")
def q20_radius_graph(spark, d):
    v = _vectors(spark, d)
    return vectors.radius_edges(v, v, 1.2, "id", "embedding").withColumn("distance", F.round("distance", 4))


@query(f"""WITH {_KNN}
SELECT src, count(*) AS n_neighbors, round(avg(d), 4) AS mean_distance, round(stddev_pop(d), 4) AS std_distance, min(dst) AS min_value, count(*) FILTER (WHERE la = lb) AS n_same_label, arg_min(dst, d) AS nearest_id FROM k WHERE n <= 6 AND src <> dst GROUP BY 1""")
def q21_neighbor_summary(spark, d):
    v = _vectors(spark, d)
    e = vectors.merge_edges(vectors.knn(v, v, 6, "id", "embedding"))
    s = vectors.neighbor_summary(e, v.withColumn("value", F.col("id")), "value", "label")
    return s.select("src", "n_neighbors", F.round("mean_distance", 4).alias("mean_distance"), F.round("std_distance", 4).alias("std_distance"), "min_value", "n_same_label", "nearest_id")


@query(f"""WITH {_KNN}, c AS (SELECT src, any_value(la) AS label, count(*) FILTER (WHERE la = lb AND src <> dst) AS n_same FROM k WHERE n <= 6 GROUP BY 1) SELECT label, n_same, count(*) AS n FROM c GROUP BY 1, 2""")
def q21b_same_label_histogram(spark, d):
    v = _vectors(spark, d)
    return predicates.same_label_histogram(vectors.knn(v, v, 6, "id", "embedding"), v)


_CENTERS = """x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k FROM embeddings),
m AS (SELECT label, k, avg(v) AS v FROM x GROUP BY 1, 2), c AS (SELECT label AS cluster_id, list(v ORDER BY k) AS center FROM m GROUP BY 1)"""


def _clustered(spark, d):
    return _vectors(spark, d).withColumn("cluster_id", F.col("label"))


@query(f"""WITH {_CENTERS} SELECT id, rank, cluster_id, round(distance, 4) AS distance FROM (SELECT vec_id AS id, cluster_id, list_distance(embedding::DOUBLE[], center) AS distance,
  (row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(embedding::DOUBLE[], center), cluster_id))::INT AS rank FROM embeddings, c) WHERE rank <= 3""")
def q22_centroid_predict(spark, d):
    v = _clustered(spark, d)
    return cluster.nearest_centers(v, cluster.centers(v), 3).withColumn("distance", F.round("distance", 4))


_INTRA = f"""{_CENTERS}, i AS (SELECT label AS k, CASE WHEN count(*) > 1 THEN avg(list_distance(embedding::DOUBLE[], center)) ELSE 0 END AS s FROM embeddings JOIN c ON label = cluster_id GROUP BY 1),
d AS (SELECT a.cluster_id AS a, b.cluster_id AS b, list_distance(a.center, b.center) AS d, row_number() OVER (PARTITION BY a.cluster_id ORDER BY list_distance(a.center, b.center), b.cluster_id) AS near FROM c a, c b WHERE a.cluster_id <> b.cluster_id)"""


@query(f"""WITH {_INTRA}, r AS (SELECT a, max((x.s + y.s) / d) AS r, max((x.s + y.s) / d) FILTER (WHERE near <= 3) AS r3 FROM d JOIN i x ON x.k = a JOIN i y ON y.k = b WHERE near <= 9 GROUP BY 1)
SELECT round((SELECT avg(r) FROM r), 4) AS davies_bouldin, round((SELECT avg(r3) FROM r), 4) AS davies_bouldin_3, round((SELECT min(d) FROM d) / (SELECT max(s) FROM i), 4) AS dunn, round((SELECT max(s) FROM i) / (SELECT min(d) FROM d), 4) AS dunn_inverse""")
def q23_intra_inter_metrics(spark, d):
    v = _clustered(spark, d)
    c = cluster.centers(v)
    three = cluster.davies_bouldin(v, c, 3).withColumnRenamed("davies_bouldin", "davies_bouldin_3")
    return cluster.davies_bouldin(v, c).join(three).join(cluster.dunn(v, c)).select(*[F.round(x, 4).alias(x) for x in ("davies_bouldin", "davies_bouldin_3", "dunn", "dunn_inverse")])


_MEMBERS = "p AS (SELECT a.vec_id AS i, b.vec_id AS j, a.label AS ci, b.label AS cj, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"


@query(f"""WITH {_MEMBERS} SELECT ci AS cluster_id, round(avg(d), 4) AS pairwise, round(max(d), 4) AS furthest FROM p WHERE ci = cj GROUP BY 1""")
def q23b_intra_methods(spark, d):
    v = _clustered(spark, d)
    own = lambda how: cluster.intra_distance(v, None, how).select("cluster_id", F.round("intra", 4).alias(how))
    return own("pairwise").join(own("furthest"), "cluster_id")


@query(f"""WITH {_INTRA}, {_MEMBERS} SELECT a, b, round(min(p.d), 4) AS closest, round(max(p.d), 4) AS furthest FROM p JOIN d ON a = ci AND b = cj WHERE near <= 4 GROUP BY 1, 2""")
def q23c_inter_methods(spark, d):
    v = _clustered(spark, d)
    d = cluster.inter_distances(v, cluster.centers(v), 4)
    return d.select("a", "b", *[F.round(c, 4).alias(c) for c in ("closest", "furthest")])


@query(f"""WITH {_MEMBERS}, e AS (SELECT i, ci, cj, CASE WHEN ci = cj THEN avg(d) FILTER (WHERE d > 0) ELSE avg(d) END AS m FROM p GROUP BY 1, 2, 3),
s AS (SELECT i, ci, max(m) FILTER (WHERE ci = cj) AS a, min(m) FILTER (WHERE ci <> cj) AS b FROM e GROUP BY 1, 2)
SELECT ci AS cluster_id, round(avg(coalesce((b - a) / greatest(a, b), 0)), 4) AS silhouette, count(*) AS n FROM s GROUP BY 1""")
def q24_silhouette(spark, d):
    v = _clustered(spark, d)
    s = cluster.cluster_silhouettes(cluster.silhouettes(v, None))
    return s.select("cluster_id", F.round("silhouette_index_mean", 4).alias("silhouette"), F.col("silhouette_index_weight").alias("n"))


@query(f"""WITH {_MEMBERS}, m AS (SELECT i, ci, cj, CASE WHEN ci = cj THEN avg(d) FILTER (WHERE d > 0) ELSE avg(d) END AS m FROM p GROUP BY 1, 2, 3),
s AS (SELECT i, max(m) FILTER (WHERE ci = cj) AS a, min(m) FILTER (WHERE ci <> cj) AS b FROM m GROUP BY 1)
SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 4) AS silhouette, count(*) AS n FROM s""")
def q24b_silhouette_index(spark, d):
    v = _clustered(spark, d)
    return cluster.silhouette(v, None).withColumn("silhouette", F.round("silhouette", 4))


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k FROM embeddings), s AS (SELECT k, avg(v) AS m, stddev_pop(v) AS s FROM x GROUP BY 1)
SELECT vec_id AS id, round(sum((v - m) / s), 4) AS total, round(sum(((v - m) / s) * ((v - m) / s)), 3) AS square FROM x JOIN s USING (k) GROUP BY 1""")
def q25_scaler(spark, d):
    z = vectors.scale(_vectors(spark, d), "embedding")
    fold = lambda f: F.aggregate("scaled", F.lit(0.0), f)
    return z.select("id", F.round(fold(lambda a, x: a + x), 4).alias("total"), F.round(fold(lambda a, x: a + x * x), 3).alias("square"))


#: erfc(z) by the error function's series, which is exact to eight digits up to 4; beyond, it is below 2e-8.
_ERFC = "CASE WHEN {z} > 4 THEN 0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 120), lambda n: (CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * n + 1) * ln(greatest({z}, 1e-300)) - lgamma(n + 1)) / (2 * n + 1))) END"


@query(f"""WITH x AS (SELECT n_chars::DOUBLE AS v, quality AS g FROM labels JOIN documents USING (doc_id)),
r AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS r FROM x), t AS (SELECT sum(c * c * c - c) AS tie FROM (SELECT count(*) AS c FROM x GROUP BY v)),
a AS (SELECT (count(*) FILTER (WHERE g = 1))::DOUBLE AS n1, (count(*) FILTER (WHERE g = 0))::DOUBLE AS n2, sum(r) FILTER (WHERE g = 1) AS r1 FROM r),
u AS (SELECT n1, n2, r1 - n1 * (n1 + 1) / 2 AS u1, n1 + n2 AS n, tie FROM a, t),
z AS (SELECT *, greatest(abs(u1 - n1 * n2 / 2) - 0.5, 0) / sqrt(n1 * n2 / 12 * (n + 1 - tie / (n * (n - 1)))) / sqrt(2) AS z FROM u)
SELECT n1, n2, u1, round({_ERFC.format(z="z")}, 6) AS p_value FROM z""")
def q26_mann_whitney(spark, d):
    x = _t(spark, d, "labels").join(_t(spark, d, "documents"), "doc_id")
    return stats.mann_whitney(x, "n_chars", "quality", n_permutations=None).select(F.col("n1").cast("double").alias("n1"), F.col("n2").cast("double").alias("n2"), "u1", F.round("p_value", 6).alias("p_value"))


@query()
def q26b_mann_whitney_permutations(spark, d):
    x = _t(spark, d, "labels").join(_t(spark, d, "documents"), "doc_id")
    return stats.mann_whitney(x, "n_chars", "quality", id_col="doc_id")


@query(f"""WITH t AS (SELECT (SELECT count(*) FROM orders)::DOUBLE AS n), r AS (SELECT o_orderstatus, count(*) AS r FROM orders GROUP BY 1), c AS (SELECT o_custkey % 2 AS k, count(*) AS c FROM orders GROUP BY 1),
o AS (SELECT o_orderstatus, o_custkey % 2 AS k, count(*) AS o FROM orders GROUP BY 1, 2),
x AS (SELECT sum((coalesce(o, 0) - r * c / n) ** 2 / (r * c / n)) AS x, count(*) - 1 AS dof FROM r CROSS JOIN c CROSS JOIN t LEFT JOIN o USING (o_orderstatus, k))
SELECT round(x, 4) AS statistic, dof::BIGINT AS dof, round({_ERFC.format(z="sqrt(x / 2)")} + sqrt(2 * x / pi()) * exp(-x / 2) * (1 + x / 3), 6) AS p_value FROM x""")
def q27_chi_square(spark, d):
    x = stats.chi_square(_t(spark, d, "orders").withColumn("k", F.col("o_custkey") % 2), "o_orderstatus", "k")
    return x.select(F.round("statistic", 4).alias("statistic"), "dof", F.round("p_value", 6).alias("p_value"))


@query("""WITH o AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders),
x AS (SELECT (f - 0.33 * n) ** 2 / (0.33 * n) + (o - 0.33 * n) ** 2 / (0.33 * n) + (p - 0.34 * n) ** 2 / (0.34 * n) AS x FROM o)
SELECT round(x, 4) AS statistic, 2::BIGINT AS dof, round(exp(-x / 2), 6) AS p_value FROM x""")
def q27b_chi_square_fixed(spark, d):
    x = stats.chi_square_fixed(_t(spark, d, "orders"), "o_orderstatus", {"F": 33, "O": 33, "P": 34})
    return x.select(F.round("statistic", 4).alias("statistic"), "dof", F.round("p_value", 6).alias("p_value"))


@query("""SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(corr(l_extendedprice, l_quantity), 6) AS r,
  round(stddev_samp(l_tax) / sqrt(count(l_tax)), 8) AS se FROM lineitem GROUP BY 1""")
def q28_regression(spark, d):
    x = _t(spark, d, "lineitem").groupBy("l_returnflag").agg(*stats.linear_fit("l_extendedprice", "l_quantity"), stats.standard_error("l_tax").alias("se"))
    return x.select("l_returnflag", *[F.round(c, k).alias(c) for c, k in (("slope", 4), ("intercept", 3), ("r2", 6), ("r", 6), ("se", 8))])


@query("""WITH c AS (SELECT o_custkey, count(*) AS s FROM orders GROUP BY 1), m AS (SELECT * FROM c WHERE s > 1), t AS (SELECT count(*) AS k, sum(s) AS m FROM m),
w AS (SELECT *, least(greatest(k, floor(m * 0.2)), m - k) AS want FROM t), h AS (SELECT o_custkey, s, want, k, coalesce((want - k) * (s - 2) / nullif(m - 2 * k, 0), 0) AS share FROM m, w),
f AS (SELECT *, floor(share) AS down, want - k - sum(floor(share)) OVER () AS rest FROM h),
q AS (SELECT o_custkey, (1 + down + (row_number() OVER (ORDER BY share - down DESC, s DESC, o_custkey) <= rest)::INT)::BIGINT AS n_test FROM f)
SELECT o_custkey AS cluster_id, s AS n, coalesce(n_test, 0) AS n_test FROM c LEFT JOIN q USING (o_custkey)""")
def q29_cluster_split(spark, d):
    x = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cluster_id"), F.lit(1).alias("label"))
    return cluster_stratified_split(x).groupBy("cluster_id").agg(F.count("*").alias("n"), F.count_if("test").alias("n_test"))


@query()
def q30_bisecting_kmeans(spark, d):
    return cluster.bisecting_kmeans(_vectors(spark, d), 6)[0]


@query()
def q31_mlp(spark, d):
    from orfloom.operators import model

    v = _clustered(spark, d).withColumn("label", (F.col("label") >= 5).cast("int"))
    parts = cluster_stratified_split(v)
    fitted = model.fit(parts.where("not test"), [64, 16, 2], epochs=20)
    return model.predict(parts.where("test"), fitted).select("id", "label", "model_label", F.round("model_output_1", 4).alias("model_output_1"))


@query()
def q32_local_alignment(spark, d):
    b = _t(spark, d, "benchmark").select("item_id", F.translate(F.upper("text"), " ,.", "").alias("s"))
    x = b.alias("a").join(b.alias("b"), F.col("b.item_id") == F.col("a.item_id") + 1).select(F.col("a.item_id").alias("i"), F.col("a.s").alias("q"), F.col("b.s").alias("s"))
    return x.select("i", align(F.col("q"), F.col("s")).alias("x")).select("i", "x.raw_score", "x.n_matches", "x.alignment_length")


@query(f"""WITH {_IV}, c AS (SELECT query_id, subject_id, overlap_length, t, greatest(overlap_length - t * 600, 0) AS adjusted, q1 - q0 + 1 - t * 600 AS remaining FROM h, (VALUES (0), (1), (5), (20)) v(t))
SELECT query_id, t AS truncation, subject_id, adjusted FROM (SELECT *, row_number() OVER (PARTITION BY query_id, t ORDER BY adjusted, remaining DESC, subject_id) AS n FROM c WHERE remaining > 30 OR t = 0) WHERE n = 1""")
def q33_best_configuration(spark, d):
    x = interval_hits(spark, d).withColumn("truncation", F.explode(F.array(*[F.lit(t) for t in (0, 1, 5, 20)])))
    x = x.withColumn("adjusted", F.greatest(F.col("overlap_length") - F.col("truncation") * 600, F.lit(0))).withColumn("remaining", F.col("query_length") - F.col("truncation") * 600)
    x = x.where("remaining > 30 or truncation = 0")
    return relational.keep_first(x, ["query_id", "truncation"], "adjusted", F.desc("remaining"), "subject_id").select("query_id", "truncation", "subject_id", "adjusted")


@query("""SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, len(regexp_extract_all(html, '<li>'))::BIGINT AS n_items, split_part(split_part(url, '//', 2), '/', 1) AS host FROM pages""")
def q34_html_parse(spark, d):
    return _t(spark, d, "pages").select(
        "page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_count("html", F.lit("<li>")).cast("long").alias("n_items"),
        F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"),
    )


@query("""WITH x AS (SELECT n_chars::DOUBLE AS x, length(text) - length(replace(text, ' ', '')) AS y, doc_id::DOUBLE AS z FROM documents), c AS (SELECT corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM x)
SELECT round((xy - xz * yz) ** 2 / ((1 - xz ** 2) * (1 - yz ** 2)), 6) AS partial_r2 FROM c""")
def q35_partial_correlation(spark, d):
    x = _t(spark, d, "documents").select(F.col("n_chars").alias("x"), seq.residue_count(F.col("text"), " ").alias("y"), F.col("doc_id").alias("z"))
    return stats.partial_r2(x, "x", "y", "z").withColumn("partial_r2", F.round("partial_r2", 6))


@query("""WITH x AS (SELECT quality = 1 AS y, n_chars > 1000 AS p FROM labels JOIN documents USING (doc_id)),
c AS (SELECT count(*) FILTER (WHERE y AND p) AS tp, count(*) FILTER (WHERE NOT y AND p) AS fp, count(*) FILTER (WHERE y AND NOT p) AS fn, count(*) FILTER (WHERE NOT y AND NOT p) AS tn FROM x)
SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy FROM c""")
def q36_confusion(spark, d):
    x = _t(spark, d, "labels").join(_t(spark, d, "documents"), "doc_id").withColumn("p", (F.col("n_chars") > 1000).cast("int"))
    return stats.confusion(x, "quality", "p").withColumns({c: F.round(c, 6) for c in ("precision", "recall", "balanced_accuracy")})


@query("""SELECT c_mktsegment, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM customer GROUP BY 1""")
def q37_value_shares(spark, d):
    n = _t(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("""SELECT doc_id, NULL::INT AS quality, source FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, quality, NULL FROM labels""")
def q38_union_by_name(spark, d):
    docs = _t(spark, d, "documents").where("lang = 'en'").select("doc_id", "source")
    return docs.unionByName(_t(spark, d, "labels").select("doc_id", "quality"), allowMissingColumns=True).select("doc_id", "quality", "source")


@query("""SELECT * FROM (SELECT p_partkey, p_name, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 25)""")
def q39_top_n_sort(spark, d):
    return _t(spark, d, "part").orderBy(F.desc("p_size"), "p_partkey").limit(25).select("p_partkey", "p_name", "p_size")


@query("""SELECT r_name, stat, value FROM (SELECT r_name, count(*)::DOUBLE AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1) UNPIVOT (value FOR stat IN (suppliers, balance))""")
def q40_melt(spark, d):
    x = _t(spark, d, "supplier").join(_t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    g = x.groupBy("r_name").agg(F.count("*").cast("double").alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))
    return g.unpivot("r_name", ["suppliers", "balance"], "stat", "value")

"""Queries over best hits, predictions and families, with DuckDB SQL for each: kinds of conflict, termini, shared hits, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from orfloom.functions import stats
from orfloom.operators import predicates, relational, tophit, vectors
from orfloom.plans.queries import _IV, _TOP, QUERIES, SQL, _t, _tops, _vectors, interval_hits, intervals, query

#: The best hit of each query with its category and flags.  A hit is a pseudogene if its event is an error, its
#: product is named from a value of 20 on, and residues are units of 600 seconds.
_A = f"""{_TOP[5:]}, b AS (SELECT i.event_id AS id, r.*, overlap_length / (q1 - q0 + 1) + 0.3 AS identity, (i.stop - i.start + 1) // 600 AS length, coalesce((s1 - s0 + 1) // 600, 0) AS hit_length,
  coalesce(sv < 20, false) AS hypothetical, st = 'purchase' AS alike,
  (s0 BETWEEN q0 AND q1)::INT::VARCHAR || (s1 BETWEEN q0 AND q1)::INT::VARCHAR AS hit_overlap, (q0 BETWEEN s0 AND s1)::INT::VARCHAR || (q1 BETWEEN s0 AND s1)::INT::VARCHAR AS query_overlap,
  CASE WHEN st IS NULL THEN NULL WHEN (q0 >= s0 AND q1 <= s1) OR (q0 <= s0 AND q1 >= s1) THEN 'nested' WHEN qs = ss THEN 'tandem'
       WHEN (qs = 1 AND q1 BETWEEN s0 AND s1) OR (qs = -1 AND q0 BETWEEN s0 AND s1) THEN 'convergent' ELSE 'divergent' END AS overlap_type
  FROM iv i LEFT JOIN r ON r.query_id = i.event_id AND r.n = 1 WHERE i.event_type = 'click'),
a AS (SELECT *, CASE WHEN coalesce(st <> 'view' AND st <> 'error' AND in_frame AND identity > 0.8, false) THEN 'match' WHEN coalesce(st = 'error' AND qs = ss, false) THEN 'pseudogene'
  WHEN st IS NULL THEN 'intergenic' ELSE 'conflict' END AS category, coalesce(st = 'error', false) AS pseudo, coalesce(st <> 'view', false) AS coding FROM b)"""


def _annotated(spark, d):
    t = _tops(spark, d).withColumns(
        {
            "top_hit_pseudo": F.col("top_hit_event_type") == "error", "sequence_identity": F.col("query_overlap_fraction") + 0.3,
            "top_hit_product": F.when(F.col("top_hit_value") < 20, "hypothetical protein").when(F.col("top_hit_value").isNotNull(), "named"),
            "top_hit_evidence_type": F.when(F.col("top_hit_event_type") == "purchase", "similar to AA sequence").otherwise("ab initio prediction"),
        }
    )
    own = intervals(spark, d).where("event_type = 'click'").select(F.col("id").alias("query_id"), F.expr("(stop - start + 1) div 600").cast("int").alias("_n"))
    t = t.join(own, "query_id").withColumn("seq", F.repeat(F.lit("M"), F.col("_n")))
    t = t.withColumn("top_hit_seq", F.when(F.col("top_hit_length").isNull(), "none").otherwise(F.repeat(F.lit("M"), F.expr("top_hit_length div 600").cast("int"))))
    return tophit.terminal_changes(tophit.annotate(t)).drop("_n")


@query(f"""WITH {_A} SELECT id AS query_id, category, length::BIGINT AS length, hit_length::BIGINT AS hit_length, category = 'match' AND length = hit_length AS exact_match,
  category = 'match' AND hit_length > length AS truncated, category = 'match' AND hit_length < length AS extended FROM a""")
def q41_terminal_flags(spark, d):
    x = _annotated(spark, d)
    return x.select("query_id", "category", F.col("length").cast("long").alias("length"), F.col("top_hit_length").cast("long").alias("hit_length"), "exact_match", "truncated", "extended")


_CDS = "(category = 'conflict' AND coding AND NOT pseudo)"


@query(f"""WITH {_A} SELECT id AS query_id, {_CDS} AS cds_conflict, {_CDS} AND overlap_type IN ('convergent', 'divergent') AS antiparallel_conflict, {_CDS} AND overlap_type = 'tandem' AS tandem_conflict,
  category = 'conflict' AND hypothetical AS hypothetical_conflict, category = 'conflict' AND (pseudo OR NOT coding) AS non_coding_conflict, {_CDS} AND (hit_overlap = '11' OR query_overlap = '11') AS nested_conflict
  FROM a WHERE st IS NOT NULL""")
def q42_conflict_kinds(spark, d):
    x = _annotated(spark, d).where("top_hit_id is not null")
    return x.select("query_id", *[c.alias(k) for k, c in predicates.conflict_kinds().items()])


@query(f"""WITH {_A}, f AS (SELECT *, CASE WHEN qs = 1 THEN s0 - q0 ELSE q1 - s1 END AS five, CASE WHEN qs = 1 THEN q1 - s1 ELSE s0 - q0 END AS three FROM a WHERE category = 'match')
SELECT id AS query_id, five AS five_prime_shift, three AS three_prime_shift, five > 0 AS five_prime_extension, five < 0 AS five_prime_truncation, three > 0 AS three_prime_extension, three < 0 AS three_prime_truncation,
  CASE WHEN length <> hit_length AND five > 0 THEN round(five / 3, 4) ELSE 0 END AS n_extension, CASE query_overlap WHEN '10' THEN CASE qs WHEN 1 THEN 'n' ELSE 'c' END WHEN '01' THEN CASE qs WHEN 1 THEN 'c' ELSE 'n' END END AS overlap_at,
  NOT hypothetical AND NOT pseudo AND coalesce(alike, false) AS annotated FROM f""")
def q43_end_changes(spark, d):
    x = _annotated(spark, d).where("match")
    x = x.withColumns(predicates.end_shifts()).withColumns(predicates.end_changes())
    return x.select(
        "query_id", "five_prime_shift", "three_prime_shift", "five_prime_extension", "five_prime_truncation", "three_prime_extension", "three_prime_truncation",
        F.round(predicates.terminal_extension("n"), 4).alias("n_extension"), predicates.overlap_terminus(F.col("query_overlap"), F.col("query_strand")).alias("overlap_at"), predicates.annotated(F.col("match")).alias("annotated"),
    )


@query("""WITH h AS (SELECT l_suppkey AS id, l_partkey AS subject_id, max_by(1 - l_discount, struct_pack(b := l_quantity * 4, i := 1 - l_discount)) AS identity FROM lineitem WHERE l_quantity * 4 > 50 AND 1 - l_discount > 0.95 GROUP BY 1, 2),
p AS (SELECT s_suppkey AS query_id, s_suppkey + 1 AS top_hit_id FROM supplier), j AS (SELECT query_id, top_hit_id, a.subject_id, row_number() OVER (PARTITION BY query_id ORDER BY a.identity + b.identity DESC, a.subject_id DESC) AS n
  FROM p JOIN h a ON a.id = query_id JOIN h b ON b.id = top_hit_id AND b.subject_id = a.subject_id)
SELECT p.query_id, p.top_hit_id, j.subject_id AS shared_hit FROM p LEFT JOIN j ON j.query_id = p.query_id AND n = 1""")
def q44_shared_hits(spark, d):
    hits = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("subject_id"), (F.col("l_quantity") * 4).alias("bit_score"), (1 - F.col("l_discount")).alias("percent_identity"))
    pairs = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"), (F.col("s_suppkey") + 1).alias("top_hit_id"))
    return predicates.shared_hits(pairs, hits, 50, 0.95).select("query_id", "top_hit_id", "shared_hit")


@query("""WITH h AS (SELECT l_partkey AS id, 60 AS query_length, l_quantity::INT AS stop, l_linenumber AS start, l_discount AS d, 1 - l_tax AS identity FROM lineitem)
SELECT id, '60' || coalesce(';' || string_agg(DISTINCT stop::VARCHAR, ';' ORDER BY stop::VARCHAR DESC) FILTER (WHERE start < 3 AND d < 0.03 AND identity > 0.95 AND stop < query_length AND stop > 30), '') AS stops FROM h GROUP BY 1""")
def q45_alternate_stops(spark, d):
    hits = _t(spark, d, "lineitem").select(
        F.col("l_partkey").alias("id"), F.lit(60).alias("query_length"), F.col("l_quantity").cast("int").alias("query_alignment_stop"), F.col("l_linenumber").alias("query_alignment_start"), F.lit(9).alias("subject_alignment_start"),
        (F.col("l_discount") * 100).alias("subject_length"), F.lit(0).alias("subject_alignment_stop"), (1 - F.col("l_tax")).alias("percent_identity"),
    )
    return predicates.alternate_stops(hits, 0.95).select("id", F.array_join("stops", ";").alias("stops"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(?i)gadget|RING') THEN 'small' WHEN regexp_matches(p_name, '(?i)red') THEN 'red' ELSE 'error' END AS category,
  CASE p_type WHEN 'PROMO' THEN 'offer' WHEN 'LARGE' THEN 'big' ELSE p_type END AS kind FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2')""")
def q46_keyword_category(spark, d):
    x = predicates.without_genomes(_t(spark, d, "part"), ["Brand#1", "Brand#2"], "p_brand")
    rules = [("gadget|RING", "small"), ("red", "red")]
    return x.select("p_partkey", predicates.keyword_category(F.col("p_name"), rules, "error").alias("category"), predicates.replace_values(F.col("p_type"), {"PROMO": "offer", "LARGE": "big"}).alias("kind"))


@query(f"""WITH {_A} SELECT user_id, grouping(user_id) = 1 AS total, count(*) AS size, count(*) FILTER (WHERE category = 'match') AS n_match, count(*) FILTER (WHERE category = 'conflict') AS n_conflict,
  count(*) FILTER (WHERE category = 'match' AND hit_length > length) AS n_truncated, round(count(*) FILTER (WHERE category = 'match') / count(*), 6) AS match_share
  FROM (SELECT a.* EXCLUDE (user_id), iv.user_id FROM a JOIN iv ON event_id = id) GROUP BY ROLLUP (user_id)""")
def q47_genome_summary(spark, d):
    own = _t(spark, d, "events").select(F.col("event_id").alias("query_id"), "user_id")
    x = predicates.genome_summary(_annotated(spark, d).select("query_id", "match", "conflict", "truncated").join(own, "query_id"), ["match", "conflict", "truncated"], "user_id")
    return x.select("user_id", "total", "size", "n_match", "n_conflict", "n_truncated", F.round("match_share", 6).alias("match_share"))


_LABEL = "CASE WHEN l_discount > 0.03 THEN 'real' WHEN 1 - l_tax > 0.97 THEN 'spurious' ELSE 'uncertain' END"


@query(f"""SELECT * FROM (SELECT l_partkey, count(*) AS size, count(*) = 1 AS singleton, count(*) FILTER (WHERE x = 'real') AS n_real, count(*) FILTER (WHERE x = 'spurious') AS n_spurious, count(*) FILTER (WHERE x = 'uncertain') AS n_uncertain,
  round(count(*) FILTER (WHERE x = 'real') / count(*), 6) AS homogeneity FROM (SELECT *, {_LABEL} AS x FROM lineitem) GROUP BY 1) WHERE size > 10 AND homogeneity < 1 AND n_spurious > 0""")
def q48_mixed_families(spark, d):
    x = _t(spark, d, "lineitem").withColumn("model_label", tophit.two_sided_label(F.col("l_discount"), 1 - F.col("l_tax"), 0.03, 0.97))
    return predicates.mixed_families(predicates.family_table(x, "l_partkey")).withColumn("homogeneity", F.round("homogeneity", 6))


@query("""WITH o AS (SELECT l_orderkey, min(l_quantity) AS q FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, q AS original_l_quantity, l_quantity - q AS diff FROM lineitem LEFT JOIN o USING (l_orderkey)""")
def q49_original_values(spark, d):
    x = predicates.original_values(_t(spark, d, "lineitem"), ["l_quantity"], "l_orderkey", F.col("l_linenumber") == 1)
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "original_l_quantity", (F.col("l_quantity") - F.col("original_l_quantity")).alias("diff"))


@query("""SELECT p::DOUBLE AS point, round(avg(exp(-power((o_totalprice - p) / 20000, 2) / 2)) / (20000 * sqrt(2 * pi())) * 1e6, 6) AS density FROM orders, range(0, 500001, 50000) AS r(p) GROUP BY 1""")
def q50_kde(spark, d):
    x = stats.kde(_t(spark, d, "orders"), "o_totalprice", [50_000.0 * i for i in range(11)], 20_000.0)
    return x.select("point", F.round(F.col("density") * 1e6, 6).alias("density"))


@query(SQL["q25_scaler"].replace("round(sum((v - m) / s), 4) AS total, ", ""))
def q51_pca(spark, d):
    # All components: lengths stay as they are, whatever the components' signs.
    z, _ = vectors.pca(vectors.scale(_vectors(spark, d), "embedding"), 64)
    return z.select("id", F.round(F.aggregate("reduced", F.lit(0.0), lambda a, x: a + x * x), 3).alias("square"))


@query(f"""WITH {_A}, n AS (SELECT *, length < hit_length AS inner_query FROM a WHERE {_CDS} AND overlap_type = 'nested')
SELECT id AS query_id, CASE WHEN inner_query THEN s0 ELSE q0 END AS parent_start, CASE WHEN inner_query THEN q0 ELSE s0 END AS daughter_start, overlap_length, qs = ss AS same_strand FROM n""")
def q52_nested_pairs(spark, d):
    x = _annotated(spark, d).withColumn("query_length", F.col("length"))
    return predicates.nested_pairs(x, ["start"])


@query(f"""WITH {_A} SELECT category, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 4) AS percent, count(*) FILTER (WHERE length < 50) AS n_short FROM a GROUP BY 1""")
def q53_category_shares(spark, d):
    n = _annotated(spark, d).groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("length") < 50).alias("n_short"))
    total = n.agg(F.sum("n").alias("_all"))
    return n.join(F.broadcast(total)).select("category", "n", F.round(100 * F.col("n") / F.col("_all"), 4).alias("percent"), "n_short")


@query(f"""WITH {_A}, f AS (SELECT *, CASE WHEN pseudo OR NOT coding THEN 'non_coding' WHEN qs = ss THEN 'tandem' ELSE 'antiparallel' END AS kind FROM a WHERE category = 'conflict')
SELECT kind, count(*) AS n, count(*) FILTER (WHERE overlap_length > 3600) AS n_long, count(*) FILTER (WHERE hypothetical) AS n_hypothetical FROM f GROUP BY 1""")
def q54_conflict_partition(spark, d):
    x = _annotated(spark, d).where("conflict")
    kind = F.when(F.col("top_hit_pseudo") | (F.col("top_hit_feature") != "CDS"), "non_coding").when(F.col("same_strand"), "tandem").otherwise("antiparallel")
    return x.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("overlap_length") > 3600).alias("n_long"), F.count_if(F.col("top_hit_product") == "hypothetical protein").alias("n_hypothetical"))


@query(f"""WITH {_A} SELECT st AS feature, count(*) FILTER (WHERE qs = ss) AS same_strand, count(*) FILTER (WHERE qs <> ss) AS opposite_strand FROM a WHERE category = 'conflict' GROUP BY 1""")
def q55_conflict_feature_strand(spark, d):
    x = _annotated(spark, d).where("conflict").groupBy(F.col("top_hit_event_type").alias("feature")).pivot("same_strand", [True, False]).count()
    return x.select("feature", *[F.coalesce(F.col(a), F.lit(0)).alias(b) for a, b in (("true", "same_strand"), ("false", "opposite_strand"))])


_MODEL = "CASE WHEN value > 15 THEN 'real' WHEN -value > -2 THEN 'spurious' ELSE 'uncertain' END"


def _labelled(spark, d):
    own = _t(spark, d, "events").select(F.col("event_id").alias("query_id"), tophit.two_sided_label(F.col("value"), -F.col("value"), 15, -2).alias("model_label"))
    return _annotated(spark, d).join(own, "query_id")


@query(f"""WITH {_A}, m AS (SELECT a.*, {_MODEL} AS model_label FROM a JOIN events e ON e.event_id = a.id)
SELECT category, model_label, count(*) AS n, count(*) FILTER (WHERE hypothetical AND st <> 'purchase') AS n_unsupported, round(count(*) FILTER (WHERE hypothetical AND st <> 'purchase') / count(*), 6) AS unsupported_share FROM m GROUP BY 1, 2""")
def q56_category_by_label(spark, d):
    no = tophit.is_unsupported()
    return _labelled(spark, d).groupBy("category", "model_label").agg(F.count("*").alias("n"), F.count_if(no).alias("n_unsupported"), F.round(stats.rate(no), 6).alias("unsupported_share"))


@query(f"""WITH {_A}, m AS (SELECT a.*, {_MODEL} AS model_label FROM a JOIN events e ON e.event_id = a.id)
SELECT overlap_type, model_label, hypothetical, count(*) AS n, sum(greatest(overlap_length - 3 * 100, 0))::BIGINT AS adjusted FROM m WHERE {_CDS} GROUP BY 1, 2, 3""")
def q57_conflicts_by_type_and_label(spark, d):
    x = _labelled(spark, d).where(predicates.conflict_kinds()["cds_conflict"]).withColumn("hypothetical", F.col("top_hit_product") == "hypothetical protein")
    adjusted = predicates.adjusted_overlap(F.col("overlap_length"), F.lit(100))
    return x.groupBy("overlap_type", "model_label", "hypothetical").agg(F.count("*").alias("n"), F.sum(adjusted).alias("adjusted"))


@query("""SELECT CASE WHEN y AND p THEN 'tp' WHEN y THEN 'fn' WHEN p THEN 'fp' ELSE 'tn' END AS kind, doc_id % 2 AS half, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, quality = 1 AS y, n_chars > 1000 AS p FROM labels JOIN documents USING (doc_id)) GROUP BY 1, 2""")
def q58_confusion_sets(spark, d):
    x = _t(spark, d, "labels").join(_t(spark, d, "documents"), "doc_id").withColumns({"y": F.col("quality") == 1, "p": F.col("n_chars") > 1000})
    kind = F.when(F.col("y") & F.col("p"), "tp").when(F.col("y"), "fn").when(F.col("p"), "fp").otherwise("tn")
    return x.groupBy(kind.alias("kind"), (F.col("doc_id") % 2).alias("half")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query(f"""WITH {_A}, f AS (SELECT *, (q1 - q0) - (s1 - s0) AS diff, s1 - s0 + 1 AS hit_nt FROM a WHERE category = 'match')
SELECT CASE WHEN diff > 0 THEN 'longer' WHEN diff < 0 THEN 'shorter' ELSE 'same' END AS change, count(*) AS n, round(avg((hit_nt + diff) / hit_nt), 6) AS fraction, round(stddev_samp(diff) / sqrt(count(*)), 3) AS se FROM f GROUP BY 1""")
def q59_length_changes(spark, d):
    x = _annotated(spark, d).where("match")
    hit = F.col("top_hit_stop") - F.col("top_hit_start") + 1
    x = x.withColumn("diff", (F.col("query_stop") - F.col("query_start") + 1) - hit).withColumn("fraction", (hit + F.col("diff")) / hit)
    change = F.when(F.col("diff") > 0, "longer").when(F.col("diff") < 0, "shorter").otherwise("same")
    return x.groupBy(change.alias("change")).agg(F.count("*").alias("n"), F.round(F.avg("fraction"), 6).alias("fraction"), F.round(stats.standard_error("diff"), 3).alias("se"))


@query("""SELECT o_custkey FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def q60_set_operations(spark, d):
    o = _t(spark, d, "orders")
    pick = lambda c: o.where(c).select("o_custkey")
    return pick("o_orderstatus = 'F'").intersect(pick("o_orderstatus = 'P'")).subtract(pick("o_orderpriority = '1-URGENT'"))


@query("""WITH a AS (SELECT o_custkey, max(o_totalprice) AS best, count(*) AS n FROM orders GROUP BY 1) SELECT c_custkey, c_name, coalesce(best, 0) AS best, coalesce(n, 0)::BIGINT AS n FROM customer LEFT JOIN a ON o_custkey = c_custkey""")
def q61_one_to_one_merge(spark, d):
    best = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("best"), F.count("*").alias("n"))
    x = relational.one_to_one(_t(spark, d, "customer"), best, ["c_custkey"], "left")
    return x.select("c_custkey", "c_name", F.coalesce("best", F.lit(0.0)).alias("best"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {_IV}, p AS (SELECT query_id, phase, qs = ss AS same_strand, count(*) AS n FROM h WHERE phase IS NOT NULL GROUP BY ALL) SELECT phase::INT AS phase, same_strand, sum(n)::BIGINT AS n, count(*) AS n_queries FROM p GROUP BY 1, 2""")
def q62_phase_by_direction(spark, d):
    x = interval_hits(spark, d).where("phase is not null").groupBy("query_id", "phase", "same_strand").agg(F.count("*").alias("n"))
    return x.groupBy("phase", "same_strand").agg(F.sum("n").alias("n"), F.count("*").alias("n_queries"))


@query(f"""WITH {_IV}, c AS (SELECT event_id AS id, CASE WHEN strand = 1 THEN start + event_id % 3 ELSE start END AS a, CASE WHEN strand = 1 THEN stop ELSE stop - event_id % 3 END AS b, strand FROM iv)
SELECT id, CASE WHEN strand = 1 THEN a ELSE a + (b - a + 1) % 3 END AS start, CASE WHEN strand = 1 THEN b - (b - a + 1) % 3 ELSE b END AS stop FROM c""")
def q63_coding_bounds(spark, d):
    x = intervals(spark, d).select("id", F.col("start").alias("gene_start"), F.col("stop").alias("gene_stop"), F.col("strand").alias("gene_strand"), (F.col("id") % 3 + 1).alias("gene_codon_start"))
    return x.withColumns(predicates.coding_bounds("gene")).select("id", F.col("gene_start").alias("start"), F.col("gene_stop").alias("stop"))


__all__ = ["QUERIES", "SQL"]

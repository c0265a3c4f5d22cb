"""The queries of this subpackage: op name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from orfloom.llm.ann import nearest
from orfloom.llm.byte_bpe import decode_ids, encode_documents
from orfloom.llm.chat_format import format_conversations, read_back
from orfloom.llm.collocations import collocations
from orfloom.llm.html_text import extract_main_text
from orfloom.llm.line_dedup import drop_repeated_lines
from orfloom.llm.ngram_join import shingle_classes
from orfloom.llm.packing import pack_documents
from orfloom.llm.quality_classifier import fit_grades, score_documents
from orfloom.llm.quality_rules import apply_rules
from orfloom.llm.resampling import resample
from orfloom.llm.secret_scan import find_secrets
from orfloom.llm.substring_dedup import cut_repeats


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard_join(spark, sf_dir):
    return shingle_classes(_read(spark, sf_dir, "documents"), shingle=3, threshold=90)


def op2_quality_classifier(spark, sf_dir):
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    # Grades: 0 toxic, 1 of low quality, 2 good.
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    out = score_documents(docs, fit_grades(docs, labels, grade))
    return out.withColumn("kept", F.col("p_top") >= 0.5)


def op3_line_dedup(spark, sf_dir):
    out = drop_repeated_lines(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op4_packing(spark, sf_dir):
    return pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1)


def op5_quality_rules(spark, sf_dir):
    return apply_rules(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), columns=["doc_id"])


def op6_chat_formatting(spark, sf_dir):
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "\\### Assistant: </turn> ok"
    own = spark.sql("SELECT -7L AS conv_id, t AS turn, r AS role FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)").withColumn("text", F.lit(says))
    return read_back(format_conversations(turns.unionByName(own), tokenizer=public_tokenizers.path("word_bpe_49k.json")))


def op7_html_extraction(spark, sf_dir):
    return extract_main_text(_read(spark, sf_dir, "pages"))


def op8_nearest_neighbours(spark, sf_dir):
    return nearest(_read(spark, sf_dir, "embeddings"), k=20)


def op9_substring_dedup(spark, sf_dir):
    out = cut_repeats(_read(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_byte_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = decode_ids(encode_documents(_read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    digest = lambda c: F.sha2(c, 256)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), digest("ids").alias("ids_sha256"), digest("decoded").alias("decoded_sha256"))


def op11_secret_scan(spark, sf_dir):
    out = find_secrets(_read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    base = text(F.filter("spans", lambda s: s.kind != "crf"))
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op12_phrase_collocations(spark, sf_dir):
    return collocations(_read(spark, sf_dir, "documents"), least=10, longest=3, covered=50, top=2000)


def op13_importance_resampling(spark, sf_dir):
    return resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), percent=5)


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_line_dedup": op3_line_dedup,
    "op4_packing": op4_packing,
    "op5_quality_rules": op5_quality_rules,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_html_extraction": op7_html_extraction,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_secret_scan": op11_secret_scan,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_importance_resampling": op13_importance_resampling,
}

_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL = {
    "op1_ngram_jaccard_join": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: concat_ws(' ', ws[i], ws[i+1], ws[i+2]))
                             WHEN len(ws) > 0 THEN [concat_ws(' ', len(ws)::VARCHAR, ws[1], ws[2])] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
sets AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS m FROM s GROUP BY 1),
rep AS (SELECT m, min(doc_id) AS r FROM sets GROUP BY 1),
sr AS (SELECT s.doc_id, s.g FROM s JOIN rep ON s.doc_id = rep.r),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM sr a JOIN sr b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM o JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 90 * (nx.n + ny.n - o)),
reach(x, y) AS (SELECT r, r FROM rep UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y),
c AS (SELECT x, min(y) AS c FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN sets USING (doc_id) LEFT JOIN rep USING (m) LEFT JOIN c ON c.x = rep.r
""",
    "op3_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS own, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
n AS (SELECT doc_id, line, own, length(regexp_replace(own, '[\x20\x09-\x0D]+', '', 'g')) AS c FROM l),
d AS (SELECT doc_id, list(own ORDER BY line) AS os, list(c ORDER BY line) AS cs FROM n WHERE c > 0 GROUP BY 1),
p AS (SELECT doc_id, os, cs, unnest(range(1, len(cs) + 1)) AS i FROM d),
s AS (SELECT doc_id, os, i, list_filter(range(1, 17), lambda m: i + m - 1 <= len(cs) AND list_sum(cs[i:i+m-1]) >= 16)[1] AS ahead,
  list_filter(range(1, 17), lambda m: i - m >= 0 AND list_sum(cs[i-m+1:i]) >= 16)[1] AS back FROM p),
r AS (SELECT doc_id, i AS seq, ahead AS m, array_to_string(os[i:i+ahead-1], chr(10)) AS run FROM s WHERE ahead IS NOT NULL
  UNION SELECT doc_id, i - back + 1, back, array_to_string(os[i-back+1:i], chr(10)) FROM s WHERE back IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, seq) AS k FROM r),
gone AS (SELECT DISTINCT doc_id, unnest(range(seq, seq + m)) AS seq FROM k WHERE k > 1),
w AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS seq FROM n WHERE c > 0),
g AS (SELECT doc_id, line FROM w SEMI JOIN gone USING (doc_id, seq)),
t AS (SELECT doc_id, string_agg(own, chr(10) ORDER BY line) AS kept FROM n ANTI JOIN g USING (doc_id, line) GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n_removed FROM g GROUP BY 1)
SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS text_sha256
FROM documents LEFT JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)
""",
    "op5_quality_rules": rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {_WORDS.format("text")} AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
cov AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS p FROM rep) GROUP BY 1),
b AS (SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(t, '[A-Z]')) AS n_upper,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w LEFT JOIN cov USING (doc_id)),
m AS (SELECT *, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM b),
v AS (SELECT doc_id, lang, source, base_failed, unnest(['symbols', 'dup_lines', 'repeats', 'upper', 'word_length']) AS metric,
  unnest([1000 * n_symbols // greatest(n_words, 1), 1000 * n_dup_lines // greatest(len(ls), 1), 1000 * n_repeat_words // greatest(n_words, 1),
          1000 * n_upper // greatest(word_chars, 1), 100 * word_chars // greatest(n_words, 1)]) AS v, unnest([100, 300, 400, 200, 150]) AS slack FROM m),
k AS (SELECT *, CASE WHEN v < 32 THEN v ELSE (v >> (length(bin(v)) - 5)) << (length(bin(v)) - 5) END AS bucket FROM v),
f AS (SELECT metric, slack, bucket, lang, source FROM k WHERE NOT base_failed),
lv AS (SELECT 1 AS lv, lang AS l, source AS s, * FROM f UNION ALL SELECT 2, lang, '', * FROM f UNION ALL SELECT 3, '', '', * FROM f),
q AS (SELECT lv, l, s, metric, any_value(slack) AS slack, count(*) AS n, quantile_disc(bucket, 0.25) AS q1, quantile_disc(bucket, 0.5) AS q2, quantile_disc(bucket, 0.75) AS q3 FROM lv GROUP BY ALL),
t AS (SELECT *, q2 + 4 * (q3 - q1) + slack AS high, CASE WHEN metric = 'word_length' THEN q2 - 4 * (q3 - q1) - slack ELSE -1 END AS low FROM q),
c AS (SELECT k.doc_id, bool_and(CASE WHEN a.n >= 100 THEN k.v BETWEEN a.low AND a.high WHEN b.n >= 100 THEN k.v BETWEEN b.low AND b.high ELSE k.v BETWEEN e.low AND e.high END) AS ok
  FROM k JOIN t a ON a.lv = 1 AND a.l = k.lang AND a.s = k.source AND a.metric = k.metric JOIN t b ON b.lv = 2 AND b.l = k.lang AND b.metric = k.metric
  JOIN t e ON e.lv = 3 AND e.metric = k.metric GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND coalesce(ok, false)) AS kept FROM m LEFT JOIN c USING (doc_id)
""",
    "op9_substring_dedup": rf"""
WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+34], ' ')) AS m FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM win WHERE m IN (SELECT m FROM win GROUP BY m HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM dup),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
    "op12_phrase_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, unnest([ws[i:i], CASE WHEN i < len(ws) THEN ws[i:i+1] END, CASE WHEN i + 1 < len(ws) THEN ws[i:i+2] END]) AS g FROM i),
f AS (SELECT lang, g, count(*) AS f FROM g WHERE g IS NOT NULL GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(g) = 1 GROUP BY 1),
c AS (SELECT lang, g, f AS a FROM f WHERE len(g) > 1 AND f >= 10),
k AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM c),
s AS (SELECT k.lang, k.g, k.a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * k.a * k.a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.g = k.g[1:k] JOIN f y ON y.lang = k.lang AND y.g = k.g[k+1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
o AS (SELECT lang, g, max(a) AS o FROM (SELECT lang, a, unnest([g[1:2], g[2:3]]) AS g FROM c WHERE len(g) = 3) GROUP BY ALL),
d AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM b LEFT JOIN o ON o.lang = b.lang AND o.g = b.g WHERE o.o IS NULL OR 100 * o.o < 50 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM d JOIN t USING (lang) QUALIFY rank <= 2000
""",
    # crc32 over the hex digits of a feature's bytes, low digit first; the table of 16 is the checksum's own.
    "op13_importance_resampling": r"""
WITH RECURSIVE t16 AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(16) r(i))),
w AS (SELECT doc_id, corpus, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM (SELECT doc_id, 's' AS corpus, text FROM documents UNION ALL SELECT item_id, 't', text FROM benchmark)),
p AS (SELECT doc_id, corpus, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
f AS (SELECT doc_id, corpus, unnest([ws[i], CASE WHEN i < len(ws) THEN ws[i] || ' ' || ws[i+1] END, CASE WHEN i + 1 < len(ws) THEN ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] END]) AS f FROM p),
n AS (SELECT doc_id, corpus, f, count(*) AS c FROM f WHERE f IS NOT NULL GROUP BY ALL),
d AS (SELECT f, lower(hex(encode(f))) AS h FROM (SELECT DISTINCT f FROM n)),
b AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h) + 1), lambda i: (instr('0123456789abcdef', h[CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END]) - 1)::BIGINT)),
  lambda c, x: xor(t[(xor(c, x) & 15) + 1], c >> 4)), 4294967295) % 10000 AS bucket FROM d, t16),
c AS (SELECT doc_id, corpus, bucket, sum(c)::BIGINT AS c FROM n JOIN b USING (f) GROUP BY ALL),
g AS (SELECT bucket, coalesce(sum(c) FILTER (corpus = 's'), 0)::DOUBLE AS s, coalesce(sum(c) FILTER (corpus = 't'), 0)::DOUBLE AS t FROM c GROUP BY 1),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM g) + 10000) / ((s + 1) * ((SELECT sum(t) FROM g) + 10000))))::BIGINT AS gain FROM g),
wt AS (SELECT doc_id, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight FROM c JOIN gains USING (bucket) WHERE corpus = 's' GROUP BY 1),
e AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || sha256('42:' || w.doc_id)[1:8])::BIGINT AS h
  FROM w LEFT JOIN wt USING (doc_id) WHERE corpus = 's'),
r AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS k, count(*) FILTER (n_words >= 20) OVER () AS n FROM r)
SELECT doc_id, n_features, n_words, weight, score, CASE WHEN n_words >= 20 AND k <= 5 * n // 100 THEN k END AS rank FROM k
""",
}

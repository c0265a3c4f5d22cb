"""Readers, sequence functions, overlap, top hits, clusters and splits on hand-written fixtures."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from orfloom.functions import seq, stats
from orfloom.functions.align import lcs_length, local_alignment, sequence_identity
from orfloom.operators import cluster, overlap, relational, tophit, vectors
from orfloom.operators.orfs import find_orfs
from orfloom.operators.split import cluster_stratified_split
from orfloom.sources import text_formats as tf
from orfloom.sources.store import EmbeddingStore


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_overlap_against_brute_force(spark):
    r = random.Random(1)
    rows = [(i, r.choice("AB"), s := r.randrange(500), s + r.randrange(60), r.choice([1, -1])) for i in range(120)]
    q, s = rows[:50], rows[50:]
    want = {(a[0], b[0]) for a in q for b in s if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3]}
    cols = "id long, contig string, start long, stop long, strand int"
    dq, ds = spark.createDataFrame(q, cols), spark.createDataFrame(s, cols)
    for width in (None, 1, 17, 1000):
        got = [(x.query_id, x.subject_id) for x in overlap.overlap_join(dq, ds, ["contig"], width).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    left = overlap.overlap_join(dq, ds, ["contig"], 17, "left")
    assert {x.query_id for x in left.collect()} == {a[0] for a in q}


@pytest.mark.parametrize(
    "q,s,kind",
    [((5, 9, 1), (9, 12, 1), "tandem"), ((5, 9, 1), (10, 12, 1), "none"), ((5, 9, 1), (5, 9, -1), "nested"), ((6, 8, 1), (5, 9, 1), "nested"), ((5, 9, 1), (8, 12, -1), "convergent"), ((5, 9, -1), (8, 12, 1), "divergent")],
)
def test_overlap_types(spark, q, s, kind):
    assert one(spark, overlap.overlap_type(*map(F.lit, (q[0], q[1], s[0], s[1], q[2], s[2])))) == kind


def test_top_hit_order_and_sentinels(spark):
    hits = spark.createDataFrame(
        [(1, 10, True, True, 5, "x", "exp", 1), (1, 11, True, True, 5, "y", "exp", 0), (1, 12, True, True, 9, "hypothetical protein", "ab initio prediction", 2), (1, 13, False, True, 99, "z", "exp", 3)],
        "query_id long, subject_id long, in_frame boolean, same_strand boolean, overlap_length long, subject_product string, subject_evidence_type string, subject_ord int",
    )
    got = {x.query_id: x for x in tophit.top_hits(hits, spark.createDataFrame([(1,), (2,)], "query_id long")).collect()}
    assert got[1].top_hit_id == 11 and got[1].n_hits == 4 and got[1].n_hits_supported == 3 and got[2].n_hits == 0
    filled = {x.query_id: x for x in tophit.fill_sentinels(tophit.top_hits(hits, spark.createDataFrame([(2,)], "query_id long"))).collect()}
    assert filled[2].top_hit_product == "none" and filled[2].in_frame is False


def test_thresholds_are_strict(spark):
    f = lambda a, b: one(spark, tophit.two_sided_label(F.lit(a), F.lit(b)))
    assert [f(0.8, 0.95), f(0.81, 0.99), f(0.1, 0.96)] == ["uncertain", "real", "spurious"]


def test_sequences(spark):
    assert one(spark, seq.reverse_complement(F.lit("ACGTN"))) == "NACGU"
    assert one(spark, seq.translate(F.lit("AUGGCUUAA"))) == "MA*" and one(spark, seq.cds_protein(F.lit("GUGGCUUAA"))) == "MA"
    assert one(spark, seq.cds_protein(F.lit("AUGUAAUAA"))) is None
    assert one(spark, seq.codon_positions(F.lit("AUGUGA"), ("AUG", "GUG", "UGA"))) == [0, 2, 3]
    assert one(spark, seq.gc_content(F.lit("GGCA"))) == 0.75 and one(spark, seq.gc_content(F.lit(""))) is None
    assert one(spark, seq.alternate_starts(F.lit("CCCAUGGUGCCC"))) == [0, 1, 2]
    assert one(spark, F.size(seq.point_mutations(F.lit("AC")))) == 38


def test_orfs_against_brute_force(spark):
    r = random.Random(2)
    contigs = [(f"c{i}", "".join(r.choice("ACGT") for _ in range(400))) for i in range(3)]
    table = dict(zip(seq.CODONS, seq.AMINO_ACIDS))
    want = set()
    for name, dna in contigs:
        fwd = dna.replace("T", "U")
        rev = fwd[::-1].translate(str.maketrans("ACGU", "UGCA"))
        for strand, s in ((1, fwd), (-1, rev)):
            for a, b in itertools.product(range(len(s) - 2), range(3, len(s) + 1)):
                if (b - a) % 3 or b <= a or s[a : a + 3] not in seq.START_CODONS or s[b - 3 : b] not in seq.STOP_CODONS[11]:
                    continue
                p = "".join(table[s[k : k + 3]] for k in range(a, b, 3))
                if "*" not in p[:-1] and len(p) - 1 >= 10:
                    want.add((name, a + 1 if strand == 1 else len(s) - b + 1, b if strand == 1 else len(s) - a, strand, "M" + p[1:-1]))
    got = find_orfs(spark.createDataFrame(contigs, "contig_id string, seq string"), min_length=10).collect()
    assert {(x.contig_id, x.start, x.stop, x.strand, x.seq) for x in got} == want and len(got) == len(want)


def test_alignment(spark):
    assert local_alignment("ACGT", "ACGT")[:3] == (4.0, 4, 4) and local_alignment("", "A")[0] == 0
    long = "ACDEFGHIKLMNPQRSTVWY" * 2
    assert local_alignment(long, long[:20] + "W" + long[20:])[0] == len(long) - 11
    assert lcs_length("ABCBDAB", "BDCABA") == 4
    assert one(spark, sequence_identity(F.lit("ABCD"), F.lit("ACD"))) == 1.0


def test_statistics(spark):
    assert abs(stats.chi_square_tail(3.841458820694124, 1) - 0.05) < 1e-9 and abs(stats.chi_square_tail(30.0, 10) - 0.000856641) < 1e-8
    df = spark.createDataFrame([(float(v), g) for v, g in [(1, 1), (2, 1), (2, 0), (5, 0), (7, 0)]], "v double, g int")
    x = stats.mann_whitney(df, "v", "g").first()
    assert (x.n1, x.n2, x.u1) == (2, 3, 0.5)


def test_fasta_round_trip(spark, tmp_path):
    p = tmp_path / "GCF_1.1_protein.faa"
    p.write_text(">a.1_1 # 3 # 98 # -1 # ID=1_1;partial=01;start_type=ATG;rbs_motif=None;rbs_spacer=5bp;gc_cont=0.500\nMKV\nLL*\n>b\nMM\n")
    got = {x.id: x for x in tf.read_fasta(spark, str(p), prodigal=True).collect()}
    a = got["a.1_1"]
    assert (a.seq, a.start, a.stop, a.strand, a.partial, a.rbs_motif, a.gc_content, a.contig_id) == ("MKVLL", 3, 98, -1, "01", "none", 0.5, "a") and got["b"].start is None
    tf.write_fasta(tf.read_fasta(spark, str(p)).drop("file_name"), str(tmp_path / "out"))
    assert {(x.id, x.seq) for x in tf.read_fasta(spark, str(tmp_path / "out")).collect()} == {("a.1_1", "MKVLL"), ("b", "MM")}


GENBANK = """LOCUS       NC_1 60 bp DNA
COMMENT     PGAP
FEATURES             Location/Qualifiers
     gene            1..9
                     /locus_tag="t1"
     CDS             complement(<1..9)
                     /locus_tag="t1"
                     /inference="COORDINATES: similar to AA sequence:RefSeq:WP_1"
                     /inference="ab initio prediction:X"
                     /codon_start=2
                     /transl_table=11
                     /product="a; long
                     name"
                     /translation="MK
                     V"
     tRNA            join(20..25,30..35)
                     /pseudo
ORIGIN
        1 acgtacgtac gtacgtacgt
//
"""


def test_genbank(spark, tmp_path):
    p = tmp_path / "GCF_000001.1_x.gbff"
    p.write_text(GENBANK + GENBANK.replace("NC_1", "NC_2"))
    features, contigs = tf.read_genbank(spark, str(p))
    rows = sorted(tf.best_evidence(features, ["contig_id", "ord", "start"]).where("contig_id = 'NC_1'").collect(), key=lambda x: x.start)
    assert [(x.feature, x.start, x.stop, x.strand, x.partial, x.continuous, x.pseudo) for x in rows] == [("CDS", 1, 9, -1, "10", True, False), ("tRNA", 20, 25, 1, "00", False, True), ("tRNA", 30, 35, 1, "00", False, True)]
    cds = rows[0]
    assert (cds.genome_id, cds.product, cds.seq, cds.codon_start, cds.used_pgap) == ("GCF_000001.1", "a; long name", "MKV", "2", True)
    assert (cds.evidence_category, cds.evidence_type, cds.evidence_source, cds.evidence_details) == ("COORDINATES", "similar to AA sequence", "RefSeq", "RefSeq:WP_1")
    assert rows[1].evidence_type == "none" and {(x.contig_id, x.seq) for x in contigs.collect()} == {("NC_1", "ACGTACGTACGTACGTACGT"), ("NC_2", "ACGTACGTACGTACGTACGT")}


def test_evidence_order(spark):
    """Of two neighbouring types the first one wins, whichever comes first in the file."""
    known = [t for t in tf.EVIDENCE if t not in ("experiment", "none")]
    rows = [(k, f"{b}:S:1;{a}:S:2", None) for k, (a, b) in enumerate(zip(known, known[1:]))] + [(100 + k, f"{a}:S:2;{b}:S:1", None) for k, (a, b) in enumerate(zip(known, known[1:]))]
    rows += [(200, "alignment:S:1", "EXISTENCE: seen [PMID: 12]"), (201, "unheard of:S:1", None), (202, None, None), (203, "unheard of:x;ab initio prediction:S:1", None)]
    got = {r.id: r.evidence_type for r in tf.best_evidence(spark.createDataFrame(rows, "id int, inference string, experiment string"), ["id"]).collect()}
    want = {k: a for k, a in enumerate(known[:-1])} | {100 + k: a for k, a in enumerate(known[:-1])} | {200: "experiment", 201: "none", 202: "none", 203: "ab initio prediction"}
    assert got == want


def test_compare_two_genomes_with_one_contig_name(spark):
    """Each genome's queries meet its own features and its own bases, through overlap, alignment and category."""
    from orfloom.plans.compare import compare

    q = [("g1", "c1", "p1", 4, 12, 1, "MKV"), ("g2", "c1", "p2", 4, 12, 1, "MLL"), ("g2", "c1", "p3", 200, 260, -1, "MA"), ("g1", "c2", "p4", 1, 9, -1, "MW")]
    queries = spark.createDataFrame(q, "genome_id string, contig_id string, id string, start long, stop long, strand int, seq string")
    f = [
        ("g1", "c1", 1, "CDS", 4, 12, 1, False, "1", "kinase", "profile", "MKV"), ("g2", "c1", 1, "CDS", 4, 12, -1, False, "1", "hypothetical protein", "ab initio prediction", "QQQ"),
        ("g1", "c2", 2, "CDS", 1, 9, -1, True, "1", "x", "none", "MW"), ("g1", "c1", 3, "CDS", 200, 260, -1, False, "1", "x", "none", "MA"),
    ]
    features = spark.createDataFrame(f, "genome_id string, contig_id string, ord int, feature string, start long, stop long, strand int, pseudo boolean, codon_start string, product string, evidence_type string, seq string")
    contigs = spark.createDataFrame([("g1", "c1", "AAAATGAAAGTTTAA"), ("g2", "c1", "CCCATGCTGCTGTAA"), ("g1", "c2", "TTACCACATGG")], "genome_id string, contig_id string, seq string")
    got = {r.query_id: r for r in compare(queries, features, contigs).collect()}
    assert len(got) == 4
    assert [(k, got[k].category, got[k].n_hits, got[k].query_nt_seq) for k in ("p1", "p2", "p4")] == [("p1", "match", 1, "AUGAAAGUU"), ("p2", "conflict", 1, "AUGCUGCUG"), ("p4", "pseudogene", 1, "AUGUGGUAA")]
    assert (got["p3"].category, got["p3"].n_hits, got["p3"].top_hit_product) == ("intergenic", 0, "none")
    assert (got["p1"].sequence_identity, got["p2"].sequence_identity, got["p2"].n_hits_supported) == (1.0, 0.0, 0)


def test_interpro_and_clusters(spark, tmp_path):
    (tmp_path / "i.tsv").write_text("p1\tm\t9\tPfam\tPF1\td\t1\t5\t1e-5\tT\t01-01\t-\t-\t-\t-\np1\tm\t9\tPfam\tPF2\td\t1\t5\t-\tT\t01-01\t-\t-\t-\t-\n")
    x = tf.read_interpro(spark, str(tmp_path / "i.tsv"), drop_duplicates=True, prefix="interpro_").collect()
    assert [(r.id, r.interpro_signature, r.interpro_status) for r in x] == [("p1", "PF1", True)]
    (tmp_path / "c.tsv").write_text("a\ta\na\tb\nc\tc\n")
    assert {(r.id, r.cluster_id) for r in tf.read_mmseqs_clusters(spark, str(tmp_path / "c.tsv")).collect()} == {("a", 0), ("b", 0), ("c", 1)}


def test_blast_and_uniprot(spark, tmp_path):
    hsp = '{"bit_score": 50.5, "evalue": 1e-9, "identity": 8, "positive": 9, "gaps": 0, "align_len": 10, "hit_from": 1, "hit_to": 10, "query_from": 1, "query_to": 10, "qseq": "A", "hseq": "A", "midline": "A"}'
    hit = '{"len": 12, "description": [{"id": "x", "accession": "S1", "title": "kinase [E. coli]", "taxid": 5, "sciname": "E. coli"}], "hsps": [%s]}' % hsp
    (tmp_path / "b.json").write_text('{"BlastOutput2": [{"report": {"results": {"search": {"query_title": "q1 z", "query_len": 10, "hits": [%s]}}}}]}' % hit)
    r = tf.read_blast_json(spark, str(tmp_path / "b.json")).first()
    assert (r.id, r.subject_id, r.subject_description, r.percent_identity, r.n_hits) == ("q1", "S1", "kinase", 0.9, 1)
    (tmp_path / "u.xml").write_text(
        '<uniprot><entry><accession>P1</accession><accession>P2</accession><name>N</name><protein><recommendedName><fullName>Prot</fullName></recommendedName></protein>'
        '<organism><name type="scientific">E. coli</name><dbReference type="NCBI Taxonomy" id="562"/><lineage><taxon>Bacteria</taxon><taxon>X</taxon></lineage></organism>'
        '<dbReference type="Pfam" id="PF1"><property type="entry name" value="dom"/></dbReference><proteinExistence type="predicted"/><sequence>MK\nV</sequence></entry></uniprot>'
    )
    got = {x.id: x for x in tf.read_uniprot_xml(spark, str(tmp_path / "u.xml")).collect()}
    assert set(got) == {"P1", "P2"} and (got["P1"].domain, got["P1"].product, got["P1"].pfam_id, got["P1"].pfam_description, got["P1"].seq, got["P1"].ncbi_taxonomy_id) == ("Bacteria", "Prot", "PF1", "dom", "MKV", "562")


def test_store(spark, tmp_path):
    s = EmbeddingStore(spark, str(tmp_path / "lib"))
    s.add(spark.createDataFrame([("a", "MKV", "g"), ("b", "M" * 2000, "g")], "id string, seq string, entry_name string"))
    s.add(spark.createDataFrame([("a", "MKV", "g"), ("c", "AA", "g")], "id string, seq string, entry_name string"))
    assert s.read().count() == 2 and len(s.get(spark.createDataFrame([("c", "g")], "id string, entry_name string")).first().embedding) == 20
    with pytest.raises(KeyError):
        s.get(spark.createDataFrame([("b", "g")], "id string, entry_name string"))


def test_split_and_clusters(spark):
    rows = [(i, i % 7 if i < 70 else 100 + i, (i % 7) % 2 if i < 70 else 0, [float(i % 7), float(i)]) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, cluster_id long, label int, embedding array<double>")
    got = cluster_stratified_split(df).collect()
    test = {x.id for x in got if x.test}
    assert len(got) == 80 and all(i < 70 for i in test) and {i % 7 for i in test} == set(range(7)) and abs(len(test) - 16) <= 7
    with pytest.raises(ValueError):
        cluster_stratified_split(df.withColumn("label", F.col("id").cast("int")))
    parts, log = cluster.bisecting_kmeans(df, 4)
    assert parts.count() == 80 and len(log) == 3 and parts.select("cluster_id").distinct().count() == 4


def test_relational(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 3)], "k int, v string, o int")
    assert {(r.k, r.v) for r in relational.keep_first(df, ["k"], "o").collect()} == {(1, "a"), (2, "c")}
    assert df.groupBy("k").agg(relational.joined_values("v", "o").alias("x")).where("k = 1").first().x == "a;b"
    with pytest.raises(KeyError):
        relational.require_keys(df, df.where("k = 1"), "k")
    z = vectors.scale(spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "embedding array<double>"), "embedding").collect()
    assert sorted(r.scaled for r in z) == [[-1.0, 0.0], [1.0, 0.0]]


def test_vector_queries_over_all_rows(spark, tmp_path):
    import numpy as np

    from orfloom.plans.queries import QUERIES

    r = random.Random(11)
    x = np.array([[r.gauss(i % 3, 0.4) for _ in range(4)] for i in range(61)])
    spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    x = x.astype(np.float32).astype(float)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    got = {(e.i, e.j): e.distance for e in run("q18_pair_distance")}
    assert set(got) == set(itertools.combinations(range(61), 2)) and all(abs(v - d[k]) < 1e-4 for k, v in got.items())
    assert {(e.src, e.dst) for e in run("q20_radius_graph")} == set(map(tuple, np.argwhere(d <= 1.2).tolist()))
    want = []
    for i in range(61):
        mean = [np.mean([d[i, j] for j in range(61) if j != i and j % 3 == c]) for c in range(3)]
        a, b = mean[i % 3], min(m for c, m in enumerate(mean) if c != i % 3)
        want.append((b - a) / max(a, b))
    (s,) = run("q24b_silhouette_index")
    assert s.n == 61 and abs(s.silhouette - np.mean(want)) < 1e-4
    near = {i: np.lexsort((np.arange(61), d[i]))[:5].tolist() for i in range(61)}
    assert {(e.src, e["rank"], e.dst) for e in run("q19_knn_top_k")} == {(i, k + 1, j) for i, js in near.items() for k, j in enumerate(js)}
    assert {e.src for e in run("q21_neighbor_summary")} == set(range(61))


def _silhouettes(x, label):
    """Silhouette of each row by its definition: distances over 0 to its own cluster, the least mean of all others."""
    import numpy as np

    out = []
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        own = d[(label == label[i]) & (d > 0)]
        b = min(d[label == c].mean() for c in set(label.tolist()) - {label[i]})
        out.append((b - own.mean()) / max(b, own.mean()) if len(own) else 0)
    return np.array(out)


def _embeddings(spark, path, n, clusters, seed):
    """Rows of noise, so that the cluster of least mean distance need not have one of the nearest centers; written as the table of embeddings."""
    import numpy as np

    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3)).astype(np.float32)
    label = np.arange(n) % clusters
    x[label == 0] *= 0.01  # a tight cluster amid the others
    label[0] = clusters  # a singleton
    spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label))], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return x.astype(float), label


def test_silhouettes_look_at_all_clusters(spark, tmp_path):
    from orfloom.plans.queries import QUERIES

    x, label = _embeddings(spark, tmp_path, 90, 9, 3)
    s = _silhouettes(x, label)
    got = {e.cluster_id: (e.silhouette, e.n) for e in QUERIES["q24_silhouette"](spark, str(tmp_path)).collect()}
    assert set(got) == set(range(10)) and got[9] == (0, 1)
    assert all(abs(m - s[label == c].mean()) < 1e-4 and n == (label == c).sum() for c, (m, n) in got.items())


def test_silhouette_index_looks_at_all_clusters(spark, tmp_path):
    from orfloom.plans.queries import QUERIES

    x, label = _embeddings(spark, tmp_path, 200, 40, 4)
    s = _silhouettes(x, label)
    (got,) = QUERIES["q24b_silhouette_index"](spark, str(tmp_path)).collect()
    assert got.n == 200 and abs(got.silhouette - s.mean()) < 1e-4
    df = spark.read.parquet(f"{tmp_path}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("cluster_id"))
    some = cluster.silhouettes(df, cluster.centers(df), df.where("id % 7 = 0")).collect()
    assert {e.id for e in some} == set(range(0, 200, 7)) and all(abs(e.silhouette - s[e.id]) < 1e-9 for e in some)


@pytest.mark.parametrize("scale", [1.0, 1e25])
def test_inter_distances_meet_once(spark, monkeypatch, scale):
    """Two clusters meet once for both methods; what is found is exact, for copies, far rows and sizes beyond single precision too."""
    import numpy as np

    from orfloom.operators import metric

    monkeypatch.setattr(metric, "blocks_of", lambda n: F.lit(2))
    r, met, plain = np.random.default_rng(6), spark.sparkContext.accumulator(0), metric.halves

    def counted(x):
        met.add(len(x))
        return plain(x)

    monkeypatch.setattr(metric, "halves", counted)
    x = r.normal(size=(120, 5)) * scale
    x[:40] += 100 * scale
    x[7], x[50] = x[51], x[8]  # distances of 0
    label = np.arange(120) // 40
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label))], "id long, embedding array<double>, cluster_id int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    got = {(e.a, e.b): (e.closest, e.furthest) for e in cluster.inter_distances(df, cluster.centers(df), None).collect()}
    assert set(got) == set(itertools.permutations(range(3), 2))
    for (a, b), near_far in got.items():
        own = d[label == a][:, label == b]
        assert np.allclose(near_far, (own.min(), own.max()), rtol=1e-12, atol=0)
    assert met.value <= 3 * 4 * (20 + 20) * 1.5  # three pairs of clusters, four of their blocks each


@pytest.mark.parametrize("few", [64, 0])
def test_silhouettes_meet_once(spark, monkeypatch, few):
    """Blocks of rows meet once, for large clusters (blocks of their own) and small ones (together); one way or both, the sums are those of the definition."""
    import numpy as np

    from orfloom.operators import metric

    monkeypatch.setattr(metric, "block_rows", lambda n: 30)
    monkeypatch.setattr(cluster, "FEW_CLUSTERS", few)
    monkeypatch.setattr(cluster, "PAIR_SLICE", (7, 5))
    r, met, plain = np.random.default_rng(9), spark.sparkContext.accumulator(0), cluster._mean_kernel

    def counted(*args):
        kernel = plain(*args)

        def run(left, right):
            met.add(left.num_rows * right.num_rows)
            yield from kernel(left, right)

        return run

    monkeypatch.setattr(cluster, "_mean_kernel", counted)
    label = np.array([0] * 70 + [1] * 20 + [2 + i // 3 for i in range(60)] + [99])
    x = r.normal(size=(len(label), 4)) + r.normal(size=(100, 4))[label]
    x[3], x[75], x[90:93] = x[4], x[5], x[90]  # copies within a cluster, of another's row, and a cluster at one place
    want = _silhouettes(x, label)
    df = spark.createDataFrame([(i, v.tolist(), f"c{c}") for i, (v, c) in enumerate(zip(x, label))], "id long, embedding array<double>, cluster_id string")
    got = {e.id: e.silhouette for e in cluster.silhouettes(df, None).collect()}
    assert set(got) == set(range(len(x))) and all(abs(got[i] - w) < 1e-9 for i, w in enumerate(want))
    assert len(x) ** 2 / 2 <= met.value <= 0.75 * len(x) ** 2
    some = {e.id: e.silhouette for e in cluster.silhouettes(df, None, df.where("id % 4 = 1")).collect()}
    assert set(some) == set(range(1, len(x), 4)) and all(abs(some[i] - want[i]) < 1e-9 for i in some)


def test_pair_distances_meet_once(spark, monkeypatch):
    """Blocks of one table meet once: each pair is compared once, and the rows are those of a sample's path."""
    import numpy as np

    from orfloom.operators import metric

    monkeypatch.setattr(metric, "blocks_of", lambda n: F.lit(5))
    r, met = np.random.default_rng(2), spark.sparkContext.accumulator(0)
    plain = vectors.distances

    def counted(a, b):
        met.add(len(a) * len(b))
        return plain(a, b)

    monkeypatch.setattr(vectors, "distances", counted)
    x = r.normal(size=(200, 3))
    df = spark.createDataFrame([(i - 100, v.tolist()) for i, v in enumerate(x)] + [(7, None), (None, [1.0, 2.0, 3.0])], "id long, embedding array<double>")
    got = sorted(map(tuple, vectors.pair_distances(df, df, "id", "embedding").collect()))
    assert [p[:2] for p in got] == list(itertools.combinations(range(-100, 100), 2))
    assert 200 * 199 / 2 <= met.value <= 0.75 * 200 * 200  # every block with itself in full, but any two once
    assert all(abs(d - np.sqrt(((x[i + 100] - x[j + 100]) ** 2).sum())) < 1e-9 for i, j, d in got)
    assert sorted(map(tuple, vectors.pair_distances(df, df.select("*"), "id", "embedding").collect())) == got
    names = df.withColumn("id", F.concat(F.lit("v"), F.col("id")))
    named = {(a, b): d for a, b, d in vectors.pair_distances(names, names, "id", "embedding").collect()}
    assert named == {tuple(sorted((f"v{i}", f"v{j}"))): d for i, j, d in got}
    twice = df.union(df.where("id < 0"))  # equal ids are no pair
    assert vectors.pair_distances(twice, twice, "id", "embedding").count() == vectors.pair_distances(twice, twice.select("*"), "id", "embedding").count()
    assert vectors.pair_distances(df.limit(0), df.limit(0), "id", "embedding").collect() == []
    assert vectors._rounded(np.array([0.00005, 1.00004, 2.5, np.inf]), 4).tolist() == [0.0001, 1.0, 2.5, np.inf]
    assert vectors._rounded(np.array([1.23456789]), None).tolist() == [1.23456789]


def test_long_documents_stay(spark, tmp_path):
    from orfloom.plans.queries import QUERIES

    rows = [(1, "a" * 10), (2, "b" * 2500), (3, "b" * 2500), (4, "c" * 30_010)]
    spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(x.doc_id for x in QUERIES["q05_keep_first_dedup"](spark, str(tmp_path)).collect()) == [1, 2, 4]
    n = {x.center: x.n for x in QUERIES["q14_sliding_bins"](spark, str(tmp_path)).collect()}
    assert n == {0: 1, 250: 1, 500: 1, 2250: 2, 2500: 2, 2750: 2, 29_750: 1, 30_000: 1, 30_250: 1}


def test_sequence_queries_read_documents(spark, tmp_path):
    from orfloom.plans.queries import QUERIES

    # Letters go to ACGU in turn.
    rows = [(1, "adc, " + "adc" * 20_000), (2, "dad aac"), (3, "12"), (4, "ab"), (5, "auc" + "aab" * 60 + "uae")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rna = lambda t: "".join("ACGU"[(ord(c) - 97) % 4] for c in t if c.isalpha())
    got = {x.doc_id: x for x in QUERIES["q16_seq_functions"](spark, str(tmp_path)).collect()}
    for i, t in rows:
        s = rna(t)
        gc = round(sum(c in "GC" for c in s) / len(s), 6) if s else None
        assert tuple(got[i]) == (i, len(s), s[::-1].translate(str.maketrans("ACGU", "UGCA")), gc, s.count("A"))
    stops, starts = ("UAA", "UAG", "UGA"), ("AUG", "GUG", "UUG")
    want = set()
    for i, t in rows:
        for strand, s in ((1, rna(t)), (-1, rna(t)[::-1].translate(str.maketrans("ACGU", "UGCA")))):
            for k in range(len(s) - 2):
                if s[k : k + 3] in starts:
                    end = next((e for e in range(k, len(s) - 2, 3) if s[e : e + 3] in stops), None)
                    if end is not None and end - k >= 150:
                        want.add((i, strand, k + 1 if strand == 1 else len(s) - end - 2, end + 3 if strand == 1 else len(s) - k, (end - k) // 3))
    assert {tuple(x) for x in QUERIES["q17_codon_orfs"](spark, str(tmp_path)).collect()} == want


def test_clusters_by_tasks_and_by_passes(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(c, 0.3, (30, 3)) for c in (0, 4, 9, 15)] + [np.zeros((6, 3)) + 30])
    df = spark.createDataFrame([(i, v.tolist(), int(i // 30 % 2)) for i, v in enumerate(x)], "id long, embedding array<double>, label int")

    def groups():
        parts, log = cluster.bisecting_kmeans(df, 5, n_init=3, max_iter=20)
        by = {}
        for p in parts.collect():
            by.setdefault(p.cluster_id, set()).add(p.id)
        return sorted(map(sorted, by.values())), log

    same = spark.createDataFrame([(i, [1.0, 1.0], 0) for i in range(8)], "id long, embedding array<double>, label int")
    assert cluster.bisecting_kmeans(same, 3, n_init=2)[0].select("cluster_id").distinct().count() == 3
    small = groups()
    monkeypatch.setattr(cluster, "TASK_ROWS", 2)
    assert groups() == small and [len(g) for g in small[0]] == [30, 30, 30, 30, 6]
    assert cluster.homogeneous_depth([(1, 0, 1), (2, 0, 2)], {0: {1}, 1: {2}, 2: {1}}) == {0: 1, 2: 1, 1: 0}


def test_rounds_on_the_border_are_plain_rounds(spark, monkeypatch):
    """Many rounds a job, with the rows near the border alone, give the clusters of rounds over all rows; equal rows on the border too."""
    import numpy as np

    r, sc = np.random.default_rng(12), spark.sparkContext
    noise = r.normal(size=(4000, 6)).astype(np.float32)
    copies = np.concatenate([noise[:1500], np.repeat(noise[:2] / 8, 900, 0)])

    def run(x, name):
        df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "id long, embedding array<float>, label int")
        sc.setJobGroup(name, "")
        parts = {p.id: p.cluster_id for p in cluster.bisecting_kmeans(df, 2, n_init=3)[0].collect()}
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        jobs = len(sc.statusTracker().getJobIdsForGroup(name))
        sc._jsc.sc().clearJobGroup()
        return parts, jobs

    small = [run(x, f"border-small-{k}")[0] for k, x in enumerate((noise, copies))]
    monkeypatch.setattr(cluster, "TASK_ROWS", 500)
    few = [run(x, f"border-few-{k}") for k, x in enumerate((noise, copies))]
    assert [parts for parts, _ in few] == small
    monkeypatch.setattr(cluster, "BORDER_ROUNDS", 1)
    parts, jobs = run(noise, "border-many")
    assert parts == small[0] and few[0][1] < 0.7 * jobs


def test_a_round_over_a_large_cluster_is_two_stages(spark, monkeypatch):
    import numpy as np

    x = np.random.default_rng(6).normal(size=(2000, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "id long, embedding array<float>, label int")
    sc = spark.sparkContext

    def run(rounds):
        sc.setJobGroup(f"rounds-{rounds}-{cluster.TASK_ROWS}", "")
        parts = {p.id: p.cluster_id for p in cluster.bisecting_kmeans(df, 2, n_init=3, max_iter=rounds)[0].collect()}
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        jobs = sc.statusTracker().getJobIdsForGroup(f"rounds-{rounds}-{cluster.TASK_ROWS}")
        sc._jsc.sc().clearJobGroup()
        return parts, sum(len(sc.statusTracker().getJobInfo(j).stageIds) for j in jobs)

    small = run(1000)[0]
    monkeypatch.setattr(cluster, "TASK_ROWS", 500)
    few, many = run(3)[1], run(13)[1]
    assert few < many <= few + 24  # ten rounds more, each of sums in tasks and by node
    assert run(1000)[0] == small


def test_sides_are_those_of_plain_differences():
    import numpy as np

    r = np.random.default_rng(7)
    grid = np.array(list(itertools.product(range(-3, 4), repeat=3)), float) / 10
    for x in (grid, grid + 1e6, np.full((5, 3), 0.1), r.normal(size=(300, 3)) * 1e-9 + 1):
        c = np.stack([x[r.choice(len(x), 2)] for _ in range(20)])
        want = np.array([cluster._assign(x, pair)[0] for pair in c])
        assert (cluster._sides(x, c) == want).all()


def test_many_centers_and_reduced_vectors(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(4)
    x, c = r.normal(size=(200, 6)), r.normal(size=(40, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    cs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cluster_id int, center array<double>")
    read = lambda: sorted((e.id, e["rank"], e.cluster_id, round(e.distance, 9)) for e in cluster.nearest_centers(df, cs, 3).collect())
    held = read()
    monkeypatch.setattr(cluster, "CENTER_BYTES", 1)
    assert read() == held
    d = np.sqrt(((x[:, None] - c[None]) ** 2).sum(2))
    assert [e[2] for e in held] == np.argsort(d, 1, kind="stable")[:, :3].ravel().tolist()
    z = (x - x.mean(0)) / x.std(0)
    u, s, _ = np.linalg.svd(z - z.mean(0), full_matrices=False)
    want = (u * s)[:, :2]
    got = np.array([e.features for e in vectors.preprocess(df, 2).orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)
    edges = vectors.pair_distances(df, df, "id", "embedding").select(F.col("i").alias("src"), F.col("j").alias("dst"), "distance").where("src < 30 and dst < 30")
    points, shares = vectors.matrix_components(edges)
    assert points.count() == 30 and len(shares) == 2 and shares[0] >= shares[1] > 0


def test_permutation_p_value(spark):
    import numpy as np

    r = np.random.default_rng(5)
    rows = [(i, float(round(r.normal(0.8 * (i % 2)), 1)), i % 2) for i in range(120)]
    x = stats.mann_whitney(spark.createDataFrame(rows, "id long, v double, g int"), "v", "g", id_col="id").first()
    v = np.array([a for _, a, _ in rows])
    rank = np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    assert x.u1 == rank[1::2].sum() - 60 * 61 / 2 and x.p_value < 0.05
    none = spark.createDataFrame([(i, float(i % 7), i // 7 % 2) for i in range(140)], "id long, v double, g int")
    assert stats.mann_whitney(none, "v", "g", id_col="id").first().p_value > 0.5
    sums = stats._shuffled_sums(spark.createDataFrame([(i, float(i)) for i in range(50)], "key long, rank double"), spark.createDataFrame([(20,)], "_n1 long"), 300, 1).collect()
    r = np.array([s.r for s in sums])
    assert len(r) == 300 and abs(r.mean() - 20 * 24.5) < 15 and r.min() >= 190 and r.max() <= 790


def test_split_quotas_and_many_splits(spark):
    rows = [(i, c) for i, c in enumerate([1] * 40 + [2] * 7 + [3] * 2 + [4] * 2 + [5] * 3 + list(range(10, 60)))]
    df = spark.createDataFrame([(i, c, 0) for i, c in rows], "id long, cluster_id long, label int")
    got = cluster_stratified_split(df, n_splits=3).collect()
    for k in range(3):
        test = [x for x in got if x.split == k and x.test]
        assert len(test) == 10 and {x.cluster_id for x in test} == {1, 2, 3, 4, 5}
        assert all(sum(y.cluster_id == c for y in test) < n for c, n in ((1, 40), (2, 7), (3, 2), (4, 2), (5, 3)))
    assert len(got) == 3 * len(rows) and len({frozenset(x.id for x in got if x.split == k and x.test) for k in range(3)}) > 1


def test_terminal_flags(spark):
    from orfloom.operators import predicates, tophit

    rows = [("a", True, "MKV", "MKV", False), ("b", True, "MK", "MKV", False), ("c", True, "MKV", "M", False), ("d", False, "MKV", "MKV", False), ("e", True, "MKV", "MKVL", True), ("f", False, "MKV", "none", None)]
    x = {r.id: (r.exact_match, r.truncated, r.extended, r.top_hit_length) for r in tophit.terminal_changes(spark.createDataFrame(rows, "id string, match boolean, seq string, top_hit_seq string, top_hit_ribosomal_slippage boolean")).collect()}
    assert x == {"a": (True, False, False, 3), "b": (False, True, False, 3), "c": (False, False, True, 1), "d": (False, False, False, 3), "e": (False, False, False, 4), "f": (False, False, False, 0)}
    hits = spark.createDataFrame([("q", "s1", 60.0, 0.9), ("q", "s1", 70.0, 0.85), ("q", "s2", 60.0, 0.95), ("t", "s1", 99.0, 0.99), ("t", "s2", 99.0, 0.81), ("t", "s3", 99.0, 0.99)], "id string, subject_id string, bit_score double, percent_identity double")
    pairs = spark.createDataFrame([("q", "t"), ("q", "u")], "query_id string, top_hit_id string")
    assert {r.top_hit_id: r.shared_hit for r in predicates.shared_hits(pairs, hits).collect()} == {"t": "s1", "u": None}


def test_mutations_and_potential_orfs(spark):
    assert len(one(spark, seq.mutations(F.lit("AC"), 2, "ACD"))) == 4 and {x.seq for x in one(spark, seq.mutations(F.lit("AC"), 1, "ACD"))} == {"CC", "DC", "AA", "AD"}
    assert {(x.start, x.stop) for x in one(spark, seq.potential_orfs(F.lit("AUGAAAUAAUGA")))} == {(0, 9), (0, 12)}


def test_hit_files(spark, tmp_path):
    df = spark.createDataFrame([("q1", "MKXXV", "h1", "MX"), ("q2", "MM", None, "none")], "query_id string, query_seq string, top_hit_id string, top_hit_seq string")
    tf.write_hit_fasta(df, str(tmp_path / "fa"))
    assert {(x.id, x.seq) for x in tf.read_fasta(spark, str(tmp_path / "fa")).collect()} == {("q1", "MKV"), ("h1", "MX"), ("q2", "MM")}
    (tmp_path / "a.fa").write_text(">a*b\nMK*V*\n")
    tf.without_asterisks(spark, str(tmp_path / "a.fa"), str(tmp_path / "clean"))
    assert sorted(x.value for x in spark.read.text(str(tmp_path / "clean")).collect()) == [">a*b", "MKV"]
    (tmp_path / "c.tsv").write_text("z\ta\nz\tb\nb\tc\n")
    assert {(x.id, x.cluster_id) for x in tf.read_mmseqs_clusters(spark, str(tmp_path / "c.tsv")).collect()} == {("a", 0), ("b", 0), ("c", 1)}
    (tmp_path / "t.csv").write_text("query_id,overlap_length,same_strand,top_hit_product\nx,12,True,007\n")
    x = tf.read_top_hits(spark, str(tmp_path / "t.csv")).first()
    assert (x.overlap_length, x.same_strand, x.top_hit_product) == (12, True, "007")
    (tmp_path / "f.xml").write_text(
        '<uniprot xmlns="http://x.org/u"><entry><feature type="chain" id="1" description="x"/>\n<feature type="site" evidence="1" description="cut" id="2"><location/></feature>\n'
        '<feature type="site" description="cut" id="3"/></entry><entry><feature\n  type="region"\n  description="two &amp; more"\n/><feature type="none"/></entry></uniprot>'
    )
    got = tf.read_uniprot_features(spark, str(tmp_path / "f.xml")).collect()
    assert sorted(map(tuple, got)) == [("region", "two & more"), ("site", "cut")]
    for name, rows in (("a", "z\ta\nz\tb\ny\tc\n"), ("b", "z\td\nw\te\n")):
        (tmp_path / "many").mkdir(exist_ok=True)
        (tmp_path / "many" / name).write_text(rows)
    assert {(x.id, x.cluster_id) for x in tf.read_mmseqs_clusters(spark, str(tmp_path / "many")).collect()} == {("a", 0), ("b", 0), ("c", 1), ("d", 0), ("e", 2)}


def test_model_steps(spark):
    from orfloom.operators import model

    r = random.Random(6)
    df = spark.createDataFrame([(i, i % 8, i % 2, [r.gauss(2 * (i % 2), 1) for _ in range(3)]) for i in range(160)], "id long, cluster_id long, label int, embedding array<double>")
    best = model.fit_best(df, [3, 4, 2], epochs=20, check_every=10)
    assert [h["epoch"] for h in best.metrics["history"]] == [10, 20] and best.metrics["balanced_accuracy"] == max(h["balanced_accuracy"] for h in best.metrics["history"])
    both = model.predict_many(df, {"a": best, "b": best})
    assert both.columns == ["id", "a_label", "a_output_0", "a_output_1", "b_label", "b_output_0", "b_output_1"] and both.count() == 160
    cover = {x.label: x for x in model.sample_coverage(df, model.balanced_sample(df)).collect()}
    assert set(cover) == {0, 1} and all(0 < x.coverage <= 1 for x in cover.values())
    loss = model.weighted_loss(df.withColumn("p", F.lit(0.5)), "p", model.class_weights(df)).first().loss
    assert abs(loss - 0.6931471805599453) < 1e-12


@pytest.mark.parametrize("max_iter", [1, 2, 1000])
def test_two_means_paths_agree_on_equal_rows_and_at_the_last_round(spark, monkeypatch, max_iter):
    """One task or many: the same members, where all rows are at one place, and where the rounds end before they come to rest."""
    from orfloom.operators import cluster

    r = random.Random(9)
    tables = [[(i, [1.0, 2.0], i % 2) for i in range(8)], [(i, [r.gauss(0, 1), r.gauss(0, 1)], i % 3) for i in range(120)], [(i, [float(i // 30), 0.0], i % 2) for i in range(90)]]
    for rows in tables:
        df = spark.createDataFrame(rows, "id long, embedding array<double>, label int")
        got = []
        for limit in (1000, 2):
            monkeypatch.setattr(cluster, "TASK_ROWS", limit)
            out, log = cluster.bisecting_kmeans(df, 4, max_iter=max_iter, n_init=3)
            got.append((sorted(map(tuple, out.collect())), log))
        assert got[0] == got[1]


def test_cluster_tree_by_recursive_query(spark):
    """Depths and ancestors of random split logs (deep ones too) are those of a walk over the log."""
    from orfloom.operators import cluster, cluster_tree

    r = random.Random(3)
    for n, deep in ((1, False), (30, False), (150, True)):
        log = [(s, s - 1 if deep else r.randrange(s), s) for s in range(1, n + 1)]
        labels = {c: {r.choice("ab") if not deep or c < 3 else "a"} | ({"c"} if r.random() < 0.1 else set()) for c in range(n + 1)}
        rows = [(c, x) for c, own in labels.items() for x in own]
        got = cluster_tree.homogeneous_ancestors(spark.createDataFrame(log, "step long, parent long, new long"), spark.createDataFrame(rows + rows[:2], "cluster_id long, label string")).collect()
        assert {x.cluster_id: x.homogeneous_depth for x in got} == cluster.homogeneous_depth(log, labels)
        assert all((x.ancestor is None) == (x.homogeneous_depth < 0) for x in got) and max(x.depth for x in got) == (n if deep else max(x.depth for x in got))
    none = cluster_tree.homogeneous_ancestors(spark.createDataFrame([], "step long, parent long, new long"), spark.createDataFrame([], "cluster_id long, label string"))
    assert none.collect() == []


def test_deep_tree_in_few_rounds(spark):
    """A chain of 500 splits: jobs grow with the logarithm of the depth (a job for each round of the recursion before)."""
    from orfloom.operators import cluster_tree

    n = 500
    log = spark.createDataFrame([(s, s - 1, s) for s in range(1, n + 1)], "step long, parent long, new long")
    labels = spark.createDataFrame([(c, "a" if c > 100 else "b") for c in range(n + 1)], "cluster_id long, label string")
    spark.sparkContext.setJobGroup("tree", "tree")
    got = {x.cluster_id: (x.depth, x.homogeneous_depth, x.ancestor) for x in cluster_tree.homogeneous_ancestors(log, labels).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("tree"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs < 300
    # Step s splits cluster s - 1; its node 2s holds clusters s and later.
    assert got == {c: (min(c + 1, n), 0, 2 * c + 1) if c <= 100 else (min(c + 1, n), min(c + 1, n) - 101, 202) for c in range(n + 1)}


def test_nested_bins(spark):
    """Intervals of all lengths, over bin edges and below zero: each overlapping pair once; a row of any length is a few rows."""
    from orfloom.operators import overlap

    r = random.Random(8)
    own = [(k, f"c{k % 2}", a, a + r.choice([0, 1, 9, 15, 16, 200, 5000, 10**6])) for k in range(400) for a in [r.choice([r.randint(-300, 300), r.randint(-10**5, 10**5), 16 * r.randint(-9, 9)])]]
    own += [(1000, "c0", -(10**9), 10**9), (1001, "c1", 0, 0)]
    df = spark.createDataFrame(own, "id long, contig string, start long, stop long")
    want = sorted((a[0], b[0]) for a in own for b in own if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3])
    for width in (16, 1024):
        got = sorted((x.query_id, x.subject_id) for x in overlap.overlap_join(df, df, ["contig"], width).select("query_id", "subject_id").collect())
        assert got == want
        near = sorted((x.a_id, x.b_id) for x in overlap.near_pairs(df, ["contig"], "id", 50, width).select("a_id", "b_id").collect())
        assert near == sorted((a[0], b[0]) for a in own for b in own if a[0] != b[0] and a[1] == b[1] and max(a[2], b[2]) - min(a[3], b[3]) < 50)
    one = df.where("id = 1000")
    assert overlap._bins(one, "start", "stop", 16, None).count() <= 2 and overlap._bins(df, "start", "stop", 16, "from").count() <= 2 * overlap.LEVELS * df.count()

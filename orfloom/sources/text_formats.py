"""Readers and writers of sequence, alignment and domain-hit files.

All parsing is by DataFrame expressions over split text records, so files are
read in parallel and only the chosen columns are computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Column names of the formats.
INTERPRO = "id string, md5 string, length int, analysis string, signature string, signature_description string, start int, stop int, e_value string, status string, date string, annotation string, description string, go_annotation string, pathways_annotation string"
MMSEQS = "query_id string, subject_id string, e_value double, bit_score double, fraction_identical_matches double, query_seq string, subject_seq string, query_coverage double, subject_coverage double, n_mismatches int, alignment_length int"
BLAST_HSP = {
    "bit_score": "bit_score", "evalue": "e_value", "identity": "identity", "positive": "positive", "gaps": "n_gaps", "align_len": "alignment_length",
    "hit_from": "subject_alignment_start", "hit_to": "subject_alignment_stop", "query_from": "query_alignment_start", "query_to": "query_alignment_stop",
    "qseq": "query_seq", "hseq": "subject_seq", "midline": "alignment",
}
GENOME_ID = r"GCF_\d+\.\d+"


def genome_id(path: Column, default: str | None = None) -> Column:
    """The genome accession in a path; raises where there is none and no default."""
    found = F.regexp_extract(path, f"({GENOME_ID})", 1)
    return F.when(found != "", found).otherwise(F.lit(default) if default is not None else F.raise_error(F.concat(F.lit("no genome id in "), path)).cast("string"))


def read_fasta(spark: SparkSession, path, prodigal: bool = False) -> DataFrame:
    """id, seq, description, file_name, and with prodigal the fields of its headers.

    A trailing ``*`` of a sequence is dropped; records without a header line and
    empty files give no rows.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_name").alias("file_name"))
    text = F.regexp_replace("value", r"^\s*>", "")
    head, body = F.regexp_extract(text, r"^([^\n]*)", 1), F.regexp_replace(F.regexp_replace(text, r"^[^\n]*\n?", ""), r"\s", "")
    rows = raw.where(F.trim("value") != "").select("file_name", head.alias("h"), F.regexp_replace(body, r"\*+$", "").alias("seq"))
    rows = rows.select(F.split_part(F.trim("h"), F.lit(" "), F.lit(1)).alias("id"), "seq", F.trim(F.regexp_replace(F.trim("h"), r"^\S+", "")).alias("description"), "file_name")
    if not prodigal:
        return rows
    p = r"# *(\d+) *# *(\d+) *# *(-?1) *# *ID=([^;]*);partial=([01]{2});start_type=([^;]*);rbs_motif=([^;]*);rbs_spacer=([^;]*);gc_cont=([\d.]+)"
    at = lambda i, t="string": F.nullif(F.regexp_extract("description", p, i), F.lit("")).cast(t)
    return rows.select(
        "id", "seq", F.split_part("id", F.lit("."), F.lit(1)).alias("contig_id"), at(1, "long").alias("start"), at(2, "long").alias("stop"), at(3, "int").alias("strand"), at(4).alias("ID_"),
        at(5).alias("partial"), at(6).alias("start_type"), F.when(at(7) == "None", "none").otherwise(at(7)).alias("rbs_motif"), F.when(at(8) == "None", "none").otherwise(at(8)).alias("rbs_spacer"), at(9, "double").alias("gc_content"), "file_name",
    ).withColumnRenamed("ID_", "header_id")


def write_fasta(df: DataFrame, path: str, mode: str = "overwrite", mask_unknown: bool = False) -> None:
    """One record a row of id, seq and (if there) description; mask_unknown drops runs of two or more X."""
    seq = F.regexp_replace("seq", "X{2,}", "") if mask_unknown else F.col("seq")
    words = [F.col("id")] + ([F.nullif(F.col("description"), F.lit(""))] if "description" in df.columns else [])
    df.select(F.concat(F.lit(">"), F.concat_ws(" ", *words), F.lit("\n"), seq).alias("value")).write.mode(mode).text(path)


def write_hit_fasta(df: DataFrame, path: str, query: str = "query", hit: str = "top_hit", mode: str = "overwrite") -> None:
    """Two records a row, the query and its top hit, without runs of two or more X; hits without an id or sequence are left out."""
    both = df.select(F.explode(F.array(*[F.struct(F.col(f"{p}_id").alias("id"), F.col(f"{p}_seq").alias("seq")) for p in (query, hit)])).alias("x")).select("x.*")
    write_fasta(both.where("id is not null and coalesce(seq, 'none') <> 'none'"), path, mode, mask_unknown=True)


def without_asterisks(spark: SparkSession, path, out: str, mode: str = "overwrite") -> None:
    """The text files of path with every ``*`` of their sequence lines removed, written to a new folder."""
    lines = spark.read.text(path)
    kept = F.when(F.startswith(F.col("value"), F.lit(">")), F.col("value")).otherwise(F.translate("value", "*", ""))
    lines.select(kept.alias("value")).write.mode(mode).text(out)


def _field(body: Column, key: str) -> Column:
    """All values of a /key="value" qualifier, joined by ``;``; later values have their own ``;`` as spaces."""
    found = F.regexp_extract_all(body, F.lit(rf'/{key}="([^"]*)"'), F.lit(1))
    clean = F.transform(found, lambda x, i: F.when(i == 0, F.regexp_replace(x, r"\s+", " ")).otherwise(F.translate(F.regexp_replace(x, r"\s+", " "), ";", " ")))
    return F.nullif(F.array_join(clean, ";"), F.lit(""))


QUALIFIERS = "product note locus_tag inference experiment go_function go_process protein_id".split()


def read_genbank(spark: SparkSession, path, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(features, contigs) of GenBank flat files; features have one row a segment.

    ``gene`` and ``source`` features are left out unless named in keep.
    """
    raw = spark.read.option("lineSep", "\nLOCUS").text(path).select("value", F.col("_metadata.file_path").alias("path"))
    # A file's first record keeps its LOCUS; what comes before its first FEATURES says how the file was made.
    head = raw.where(F.rlike("value", F.lit(r"^\s*LOCUS"))).groupBy("path").agg(F.bool_or(F.contains(F.split_part("value", F.lit("FEATURES"), F.lit(1)), F.lit("PGAP"))).alias("used_pgap"))
    raw = raw.join(F.broadcast(head), "path", "left").na.fill(False, ["used_pgap"])
    contig = raw.where(F.contains("value", F.lit("FEATURES"))).select(
        genome_id(F.col("path"), "none").alias("genome_id"), "used_pgap",
        F.regexp_extract(F.regexp_replace("value", r"^LOCUS", ""), r"^\s*(\S+)", 1).alias("contig_id"),
        F.regexp_extract("value", r"(?s)\nFEATURES[^\n]*\n(.*?)(?:\nORIGIN|\nCONTIG|\n//|$)", 1).alias("table"),
        F.upper(F.regexp_replace(F.regexp_extract("value", r"(?s)\nORIGIN[^\n]*\n(.*?)(?:\n//|$)", 1), r"[\s0-9]", "")).alias("seq"),
    )
    # A feature starts at column 6; its lines go on from column 22.
    parts = F.split(F.concat(F.lit("\n"), F.col("table")), r"\n {5}(?=\S)")
    f = contig.select("genome_id", "contig_id", "used_pgap", F.posexplode(parts).alias("ord", "body")).where(F.trim("body") != "")
    f = f.withColumn("feature", F.regexp_extract("body", r"^(\S+)", 1)).where(~F.col("feature").isin([x for x in ("gene", "source") if x not in keep]))
    coordinate = F.regexp_replace(F.regexp_extract("body", r"(?s)^\S+\s+(.*?)(?=\n\s+/|$)", 1), r"\s", "")
    f = f.withColumn("coordinate", coordinate)
    f = f.select(
        "*", F.rlike("body", F.lit(r"\n\s+/pseudo\b(?!gene)")).alias("pseudo"), F.contains("body", F.lit("/ribosomal_slippage")).alias("ribosomal_slippage"),
        F.nullif(F.regexp_extract("body", r"/transl_table=(\d+)", 1), F.lit("")).alias("translation_table"), F.nullif(F.regexp_extract("body", r"/codon_start=(\d)", 1), F.lit("")).alias("codon_start"),
        *[_field(F.col("body"), q).alias(q) for q in QUALIFIERS], F.regexp_replace(_field(F.col("body"), "translation"), r"\s", "").alias("seq"),
    )
    return parse_coordinates(f).drop("body", "table"), contig.select("genome_id", "contig_id", "seq")


def parse_coordinates(f: DataFrame) -> DataFrame:
    """f with a row for each segment of ``coordinate``: start, stop, strand, partial bits, continuous."""
    segments = F.split(F.regexp_replace("coordinate", r"complement|join|order|[()]", ""), ",")
    f = f.withColumn("strand", F.when(F.contains("coordinate", F.lit("complement")), -1).otherwise(1)).withColumn("continuous", ~F.rlike("coordinate", F.lit("join|order")))
    f = f.withColumn("segment", F.explode(segments)).where(F.rlike("segment", F.lit(r"\d")))
    number = lambda i: F.regexp_extract("segment", r"[<>]?(\d+)(?:\.\.[<>]?(\d+))?", i)
    first, last = number(1), F.coalesce(F.nullif(number(2), F.lit("")), number(1))
    bit = lambda c: F.when(F.contains("segment", F.lit(c)), "1").otherwise("0")
    return f.withColumns({"start": first.cast("long"), "stop": last.cast("long"), "partial": F.concat(bit("<"), bit(">"))}).drop("segment")


# Evidence types, the first ones preferred.
EVIDENCE = [
    "experiment",
    "alignment",
    "similar to sequence",
    "similar to AA sequence",
    "similar to DNA sequence",
    "similar to RNA sequence",
    "similar to RNA sequence, mRNA",
    "similar to RNA sequence, EST",
    "similar to RNA sequence, other RNA",
    "profile",
    "nucleotide motif",
    "protein motif",
    "ab initio prediction",
    "non-experimental evidence, no additional details recorded",
    "none",
]


def best_evidence(features: DataFrame, id_cols: list[str]) -> DataFrame:
    """features with the best evidence: category, type, source, details (``none`` without any)."""
    kinds = F.array(*[F.lit(x) for x in EVIDENCE])
    each = lambda c, kind: features.where(F.col(c).isNotNull()).select(*id_cols, F.posexplode(F.split(c, ";")).alias("_o", "_x"), F.lit(kind).alias("_k"))
    x = each("inference", "i").union(each("experiment", "e")).withColumn("_x", F.trim(F.regexp_replace("_x", r"\[PMID[^\]]+\]|PMID:(?:[0-9]+(?:, )?)+", "")))
    category = F.regexp_extract("_x", r"^(EXISTENCE|COORDINATES|DESCRIPTION)\s*:", 1)
    rest = F.trim(F.regexp_replace("_x", r"^(EXISTENCE|COORDINATES|DESCRIPTION)\s*:", ""))
    type_ = F.when(F.col("_k") == "e", "experiment").otherwise(F.trim(F.split_part(rest, F.lit(":"), F.lit(1))))
    tail = F.when(F.col("_k") == "e", rest).otherwise(F.trim(F.regexp_replace(rest, r"^[^:]*:?", "")))
    x = x.select(*id_cols, "_o", F.nullif(category, F.lit("")).alias("evidence_category"), type_.alias("_t"), tail.alias("_d"), rest.alias("_r"), F.col("_k"))
    known = F.array_contains(kinds, F.col("_t"))
    x = x.select(
        *id_cols, "evidence_category", F.when(known, F.col("_t")).alias("evidence_type"), F.when(known & (F.col("_k") == "i"), F.nullif(F.split_part("_d", F.lit(":"), F.lit(1)), F.lit(""))).alias("evidence_source"),
        F.when(known, F.col("_d")).otherwise(F.col("_r")).alias("evidence_details"), F.when(known, F.array_position(kinds, F.col("_t"))).otherwise(F.lit(99)).alias("_rank"), "_o",
    )
    best = x.groupBy(*id_cols).agg(F.min_by(F.struct("evidence_category", "evidence_type", "evidence_source", "evidence_details"), F.struct("_rank", "_o")).alias("_e"))
    out = features.join(best, id_cols, "left")
    return out.select("*", *[F.coalesce(F.col(f"_e.{c}"), F.lit("none")).alias(c) for c in ("evidence_category", "evidence_type", "evidence_source", "evidence_details")]).drop("_e")


def read_interpro(spark: SparkSession, path, max_e_value: float | None = None, drop_duplicates: bool = False, prefix: str = "") -> DataFrame:
    """Domain hits; ``-`` is null, status true for T; best e-value first, optionally the best of each id."""
    df = spark.read.csv(path, sep="\t", schema=INTERPRO, nullValue="-")
    df = df.withColumn("e_value", F.col("e_value").cast("double")).withColumn("status", F.col("status") == "T")
    if max_e_value is not None:
        df = df.where(F.col("e_value") < max_e_value)
    if drop_duplicates:
        w = Window.partitionBy("id").orderBy(F.asc_nulls_last("e_value"), "signature", "start", "stop")
        df = df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    df = df.orderBy(F.asc_nulls_last("e_value"), "id", "signature", "start", "stop")
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c != "id"}) if prefix else df


def read_mmseqs(spark: SparkSession, path) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=MMSEQS)


def read_mmseqs_clusters(spark: SparkSession, path) -> DataFrame:
    """cluster_rep_id, id, cluster_id: dense numbers of representatives (from 0) in order of appearance.

    Representatives are numbered within their file block, behind those of the
    blocks before (one count for each block).
    """
    df = spark.read.csv(path, sep="\t", schema="cluster_rep_id string, id string")
    place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    reps = df.withColumn("_p", place).groupBy("cluster_rep_id").agg(F.min("_p").alias("_p")).select("cluster_rep_id", "_p.*")
    before = F.sum("count").over(Window.orderBy("path", "block")) - F.col("count")
    blocks = reps.groupBy("path", "block").count().withColumn("before", before).drop("count")
    number = F.row_number().over(Window.partitionBy("path", "block").orderBy("at")) - 1 + F.col("before")
    reps = reps.join(F.broadcast(blocks), ["path", "block"]).withColumn("cluster_id", number).select("cluster_rep_id", "cluster_id")
    return df.join(reps, "cluster_rep_id")


def read_blast_json(spark: SparkSession, path) -> DataFrame:
    """One row a segment pair, first description only, with n_hits and n_subject_taxa of its query."""
    hsp = "array<struct<bit_score: double, evalue: double, identity: int, positive: int, gaps: int, align_len: int, hit_from: int, hit_to: int, query_from: int, query_to: int, qseq: string, hseq: string, midline: string>>"
    schema = f"BlastOutput2 array<struct<report: struct<results: struct<search: struct<query_title: string, query_len: int, hits: array<struct<len: int, description: array<struct<id: string, accession: string, title: string, taxid: long, sciname: string>>, hsps: {hsp}>>>>>>>"
    s = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("BlastOutput2").alias("r")).select("r.report.results.search.*")
    h = s.select(F.split_part("query_title", F.lit(" "), F.lit(1)).alias("id"), F.col("query_len").alias("query_length"), F.explode("hits").alias("h"))
    d = F.get("h.description", F.lit(0))
    h = h.select("id", "query_length", F.col("h.len").alias("subject_length"), d["accession"].alias("subject_id"), d["title"].alias("subject_description"), d["taxid"].alias("subject_taxonomy_id"), d["sciname"].alias("subject_taxon"), F.explode("h.hsps").alias("p"))
    h = h.select("*", *[F.col(f"p.{a}").alias(b) for a, b in BLAST_HSP.items()]).drop("p")
    n = h.groupBy("id").agg(F.countDistinct("subject_id").alias("n_hits"), F.countDistinct("subject_taxon").alias("n_subject_taxa"))
    clean = F.trim(F.regexp_replace("subject_description", r"\[.*\]", ""))
    return h.join(n, "id").withColumn("percent_identity", F.try_divide("positive", "alignment_length")).withColumn("subject_description", clean)


DATABASES = "Pfam InterPro NCBIfam PANTHER SUPFAM Gene3D KEGG GO AntiFam".split()


def _is_type(name: str):
    return lambda r: r._type == name


def read_uniprot_xml(spark: SparkSession, path) -> DataFrame:
    """One row an accession: name, taxonomy, product, function, existence, sequence, references of DATABASES."""
    ref = "array<struct<_type: string, _id: string, property: array<struct<_type: string, _value: string>>>>"
    schema = (
        "accession array<string>, name string, protein struct<recommendedName: struct<fullName: string>, submittedName: array<struct<fullName: string>>>, "
        "organism struct<name: array<string>, dbReference: array<struct<_type: string, _id: string>>, lineage: struct<taxon: array<string>>>, "
        f"dbReference {ref}, comment array<struct<_type: string, text: string>>, proteinExistence struct<_type: string>, sequence string, "
        "feature array<struct<_type: string, _description: string, location: struct<position: struct<_position: string>>>>"
    )
    x = spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", "true").schema(schema).load(path).select("*", F.col("_metadata.file_name").alias("file_name"))
    none = lambda c: F.coalesce(c, F.lit("none"))
    comments = lambda kind: F.nullif(F.array_join(F.transform(F.filter("comment", lambda c: c._type == kind), lambda c: c.text), ";"), F.lit(""))
    cols = [
        F.explode("accession").alias("id"), "name", none(F.get("organism.lineage.taxon", F.lit(0))).alias("domain"), none(F.array_join("organism.lineage.taxon", ";")).alias("lineage"),
        none(F.get("organism.name", F.lit(0))).alias("species"), none(F.get(F.transform(F.filter("organism.dbReference", lambda r: r._type == "NCBI Taxonomy"), lambda r: r._id), F.lit(0))).alias("ncbi_taxonomy_id"),
        none(F.coalesce("protein.recommendedName.fullName", F.get("protein.submittedName.fullName", F.lit(0)))).alias("product"), none(comments("function")).alias("function"), none(comments("PTM")).alias("post_translational_modification"),
        none(F.col("proteinExistence._type")).alias("existence"), F.regexp_replace("sequence", r"\s", "").alias("seq"), "file_name",
    ]
    refseq = F.get(F.filter("dbReference", _is_type("RefSeq")), F.lit(0))
    nucleotide = F.get(F.transform(F.filter(refseq["property"], lambda p: p._type == "nucleotide sequence ID"), lambda p: p._value), F.lit(0))
    ends = F.transform(F.filter("feature", _is_type("non-terminal residue")), lambda f: f.location.position._position)
    cols += [none(refseq["_id"]).alias("refseq_protein_id"), none(nucleotide).alias("refseq_nucleotide_id"), none(F.nullif(F.array_join(ends, ","), F.lit(""))).alias("non_terminal_residue")]
    for db in DATABASES:
        own = F.filter("dbReference", _is_type(db))
        value = lambda r: F.coalesce(F.get(F.transform(F.filter(r.property, lambda p: p._type.isin("entry name", "term", "description")), lambda p: p._value), F.lit(0)), F.lit("no description"))
        cols += [none(F.nullif(F.array_join(F.transform(own, lambda r: r._id), ";"), F.lit(""))).alias(f"{db.lower()}_id"), none(F.nullif(F.array_join(F.transform(own, value), ";"), F.lit(""))).alias(f"{db.lower()}_description")]
    return x.select(*cols)


def read_uniprot_features(spark: SparkSession, path) -> DataFrame:
    """Distinct (type, description) of the features in UniProt XML files, chains left out."""
    found = spark.read.format("xml").option("rowTag", "feature").option("ignoreNamespace", "true").schema("_type string, _description string").load(path)
    found = found.select(F.col("_type").alias("type"), F.col("_description").alias("description"))
    return found.where("type is not null and description is not null and type <> 'chain'").distinct()


def read_typed_csv(spark: SparkSession, path, types: dict[str, str], sep: str = ",") -> DataFrame:
    """A CSV file with a header: columns named in types have those types, all others are text."""
    df = spark.read.csv(path, sep=sep, header=True, escape='"')
    return df.select([F.col(f"`{c}`").cast(types.get(c, "string")).alias(c) for c in df.columns])


# Types of the columns of top-hit tables that are not text.
TOP_HIT_TYPES = {
    **{f"{p}_{c}": "long" for p in ("query", "subject", "top_hit") for c in ("start", "stop", "length")}, **{f"{p}_strand": "int" for p in ("query", "subject", "top_hit")},
    "overlap_start": "long", "overlap_stop": "long", "overlap_length": "long", "phase": "int", "same_strand": "boolean", "in_frame": "boolean", "exact_match": "boolean",
    "top_hit_pseudo": "boolean", "subject_pseudo": "boolean", "top_hit_ribosomal_slippage": "boolean", "subject_ribosomal_slippage": "boolean", "sequence_identity": "double",
    **{f"n_hits{c}": "int" for c in ("", "_supported", "_same_strand", "_opposite_strand", "_in_frame")}, "query_gc_content": "double",
}


def read_top_hits(spark: SparkSession, path) -> DataFrame:
    """A table of top hits or of all hits, typed."""
    return read_typed_csv(spark, path, TOP_HIT_TYPES)

"""Sequence functions as column expressions (JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Genetic code 11 in the order of its RNA codons (bases U, C, A, G), starts and stops.
BASES = "UCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
START_CODONS = ("AUG", "GUG", "UUG")
STOP_CODONS = {11: ("UAA", "UAG", "UGA"), 14: ("UAG",)}
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"

CODONS = [a + b + c for a in BASES for b in BASES for c in BASES]


def reverse_complement(seq: Column) -> Column:
    """Reverse complement as RNA, all ambiguity codes included."""
    return F.reverse(F.translate(F.upper(seq), "ACGTURYKMBVDH", "UGCAAYRMKVBHD"))


def subsequence(seq: Column, start: Column, stop: Column) -> Column:
    """Half-open, 0-based slice; bounds are clamped to the sequence."""
    first = F.greatest(start, F.lit(0))
    return F.substring(seq, (first + 1).cast("int"), F.greatest(stop - first, F.lit(0)).cast("int"))


def codons(seq: Column) -> Column:
    """The in-frame codons of a sequence, an incomplete last one left out."""
    # One pass: substrings by place cost the square of the length.
    return F.coalesce(F.regexp_extract_all(seq, F.lit(r"(?s).{3}"), F.lit(0)), F.array().cast("array<string>"))


def codon_positions(seq: Column, wanted: tuple[str, ...]) -> Column:
    """0-based places of codons in any frame, overlapping ones too."""
    n = F.length(seq) - 2
    return F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.substring(seq, i + 1, 3).isin(*wanted))).otherwise(F.array().cast("array<int>"))


def translate(seq: Column, table: int = 11) -> Column:
    """Amino acids of the in-frame codons, stops as ``*``, unknown codons as ``X``."""
    acids = {c: ("Y" if table == 14 and c == "UAA" else a) for c, a in zip(CODONS, AMINO_ACIDS)}
    table_map = F.create_map(*[F.lit(x) for pair in acids.items() for x in pair])
    return F.array_join(F.transform(codons(F.translate(F.upper(seq), "T", "U")), lambda c: F.coalesce(F.try_element_at(table_map, c), F.lit("X"))), "")


def is_valid_orf(start: Column, stop: Column) -> Column:
    return (start < stop) & ((stop - start) % 3 == 0)


def is_valid_cds(seq: Column, table: int = 11) -> Column:
    return (F.length(seq) % 3 == 0) & F.substring(seq, 1, 3).isin(*START_CODONS) & F.substring(seq, -3, 3).isin(*STOP_CODONS[table])


def cds_protein(seq: Column, table: int = 11) -> Column:
    """Protein of a whole CDS, first residue M; null unless start, length, last stop and no inner stop are right."""
    body = F.substring(translate(seq, table), 2, 1 << 30)
    ok = is_valid_cds(seq, table) & (F.instr(body, "*") == F.length(body))
    return F.when(ok, F.concat(F.lit("M"), F.translate(body, "*", "")))


def gc_content(seq: Column) -> Column:
    return F.try_divide(F.length(seq) - F.length(F.translate(seq, "GC", "")), F.length(seq))


def residue_count(seq: Column, residue: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(residue), F.lit("")))


def composition(seq: Column) -> Column:
    """Shares of the 20 amino acids, in the order of RESIDUES."""
    return F.array(*[F.try_divide(residue_count(seq, r), F.length(seq)).cast("double") for r in RESIDUES])


def alternate_starts(seq: Column, codon_start: Column | None = None, starts: tuple[str, ...] = ("AUG", "GUG")) -> Column:
    """Codon indices of in-frame starts after the codon offset; always with 0."""
    from_ = F.lit(1) if codon_start is None else codon_start
    own = codons(F.substring(seq, from_, F.length(seq)))
    found = F.filter(F.transform(own, lambda c, i: F.when(c.isin(*starts), i)), lambda i: i.isNotNull())
    return F.array_sort(F.array_union(F.array(F.lit(0)), found))


def point_mutations(seq: Column, letters: str = RESIDUES) -> Column:
    """All sequences that differ in one place: array of (position, residue, seq)."""
    place = F.when(F.length(seq) > 0, F.sequence(F.lit(1), F.length(seq))).otherwise(F.array().cast("array<int>"))
    one = lambda i: F.transform(F.array(*[F.lit(x) for x in letters]), lambda r: F.struct(i.alias("position"), r.alias("residue"), F.overlay(seq, r, i, F.lit(1)).alias("seq")))
    return F.filter(F.flatten(F.transform(place, one)), lambda m: m.seq != seq)


def mutations(seq: Column, n: int = 1, letters: str = RESIDUES) -> Column:
    """All sequences that differ in exactly n places: array of (place: the last one, seq).  Their number grows with the n-th power of the length."""
    out = F.array(F.struct(F.lit(0).alias("place"), seq.alias("seq")))
    for _ in range(n):
        later = lambda m: F.when(m.place < F.length(m.seq), F.sequence(m.place + 1, F.length(m.seq))).otherwise(F.array().cast("array<int>"))
        other = lambda m, i: F.filter(F.array(*[F.lit(x) for x in letters]), lambda r: r != F.substring(m.seq, i, F.lit(1)))
        out = F.flatten(F.transform(out, lambda m: F.flatten(F.transform(later(m), lambda i: F.transform(other(m, i), lambda r: F.struct(i.alias("place"), F.overlay(m.seq, r, i, F.lit(1)).alias("seq")))))))
    return out


def potential_orfs(seq: Column, table: int = 11) -> Column:
    """(start, stop) of every start codon with every later stop codon in its frame, 0-based and half-open.

    Their number grows with the square of the length; find_orfs pairs a start with its next stop only.
    """
    starts, stops = codon_positions(seq, START_CODONS), codon_positions(seq, STOP_CODONS[table])
    return F.flatten(F.transform(starts, lambda a: F.transform(F.filter(stops, lambda b: (b > a) & ((b - a) % 3 == 0)), lambda b: F.struct(a.alias("start"), (b + 3).alias("stop")))))


def pair_id(a: Column, b: Column) -> Column:
    return F.array_join(F.array_sort(F.array(a, b)), "+")


def contig_of(id_: Column) -> Column:
    return F.split_part(id_, F.lit("."), F.lit(1))

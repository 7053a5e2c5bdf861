import pytest
from pyspark.sql import functions as F

from seqmill.functions import sequence as S


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} {'string' if isinstance(v, (str, type(None))) else 'long'}" for n, v in zip(names, values)))
    return df.select(column(*[F.col(n) for n in names])).first()[0]


@pytest.mark.parametrize(
    "f, args, want",
    [
        (S.accession_of, ("QZ1.1:5-9|Aa_bb|t",), "QZ1.1"),
        (S.accession_of, ("QZ1.1 some title",), "QZ1.1"),
        (S.hit_id_accession, ("gi|1|gb|QZ1.1|",), "QZ1.1"),
        (S.hit_id_accession, ("pdb|1ABC|A",), "1ABC_A"),
        (S.combine_species, ("V. rafi var. affine",), "V. rafi"),
        (S.combine_species, ("A b subsp. c var. d",), "A b"),
        (S.combine_species, ("A b",), "A b"),
        (S.is_uncertain, ("Aa sp. 1",), True),
        (S.is_uncertain, ("Aa cf. bb",), True),
        (S.is_uncertain, ("Aa spp",), False),
        (S.length_without_wildcards, ("AANRY-C",), 4),
        (S.acgt_count, ("aCgNt-",), 4),
        (S.ungapped, ("A-C--",), "AC"),
        (S.reverse_complement, ("ACGTN-R",), "Y-NACGT"),
        (S.strip_wildcards, ("acRNg",), "ACG"),
        (S.blank_end_gaps, ("--A-C-",), "  A-C "),
        (S.infer_alphabet, ("ACGTNACGT",), "DNA"),
        (S.infer_alphabet, ("ACGUNACGU",), "RNA"),
        (S.infer_alphabet, ("MKVLWAAL",), "AA"),
        (S.underscored, ("A b",), "A_b"),
        (S.without_apostrophes, ("A 'b'",), "A b"),
        (S.combine_species, (None,), None),
    ],
)
def test_scalar(spark, f, args, want):
    assert one(spark, f, *args) == want


def test_positions(spark):
    assert [one(spark, S.aligned_position, "A-ACC-TG-G", n) for n in (0, 1, 5, 7, 8)] == [0, 1, 7, 10, None]
    assert one(spark, S.raw_position, "A-ACC-TG-G", 7) == 5
    row = spark.sql("SELECT '--AC-G-' AS s").select(*S.residue_span(F.col("s")), *S.missing_ends(F.col("s"))).first()
    assert tuple(row) == (2, 5, 2, 1)


def test_words(spark):
    assert one(spark, lambda s: S.kmers(s, 3), "ACGT") == ["ACG", "CGT"]
    assert one(spark, lambda s: S.kmers(s, 3), "AC") == []
    assert one(spark, S.kmer_index, "ACGT") == 27
    assert one(spark, S.kmer_index, "ACGN") is None
    assert one(spark, S.expand_wildcards, "ARY") == ["AAC", "AAT", "AGC", "AGT"]


def test_taxonomy(spark):
    path = lambda s: S.taxonomy_path(s)
    text = "Order|Family|Genus|Genus species"
    assert one(spark, lambda s: S.genus_of(path(s)), text) == "Genus"
    assert one(spark, lambda s: S.upper_taxon(path(s), F.lit("Genus")), text) == "Family"
    assert one(spark, lambda s: S.upper_taxon(path(s), F.lit("Order")), text) is None


def test_annotation(spark):
    ok = lambda *a: one(spark, lambda *c: S.annotation_ok(F.array(*c), ["ITS 1"], ["genome"]), *a)
    assert ok("its1 gene", None) is True
    assert ok("its1", "whole GENOME") is False
    assert ok("other", None) is False


def test_headers(spark):
    h = lambda start: one(spark, lambda a, s, q, o: S.header_of(a, s, q, F.lit(True), o, F.lit("t")), "QZ1", start, "ACGT", "Aa bb")
    assert h(-3) == "QZ1:1-4_reverse_complement|Aa_bb|t"
    assert one(spark, lambda d: S.rewrite_coordinates(d, F.lit(7), F.lit(8)), "QZ1:1-4|x 3-4") == "QZ1:7-8|x 3-4"
    assert one(spark, S.encodable, "中文 ok") is True
    assert one(spark, S.encodable, "\U0001f33f") is False

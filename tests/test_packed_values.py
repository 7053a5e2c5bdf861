import pytest
from pyspark.sql import Row

from seqmill.operators.packed_values import cross_references, lineage, persons, split_packed

values = lambda got: [v for v, _ in got]


@pytest.mark.parametrize(
    "text, want",
    [
        ("A|B|C c", ["A", "B", "C c"]),
        (" | A || B | ", ["A", "B"]),
        ("Aa;Bb, Cc > Dd/Ee", ["Aa", "Bb", "Cc", "Dd", "Ee"]),
        ('A|"B| x"|C', ["A", "B| x", "C"]),
        ("A\t'B,x'\tC", ["A", "B,x", "C"]),
        ('A|"B ""blue"" form"|C', ["A", 'B "blue" form', "C"]),
        ("A|B\\| x|C", ["A", "B| x", "C"]),
        ("A|B c; aggr.", ["A", "B c; aggr."]),
        ("A|B c hybrid A/B", ["A", "B c hybrid A/B"]),
        ("A|B c (O'Zarist), 1947", ["A", "B c (O'Zarist), 1947"]),
        ("A|B (x|y)|C", ["A", "B (x|y)", "C"]),
        ('""|A', ["A"]),
        ("A", ["A"]),
        ("|", []),
    ],
)
def test_lineage(text, want):
    assert values(lineage(text)) == want


def test_malformed_quote_is_bare_and_flagged():
    assert lineage('A|"B|C') == [("A", 0), ('"B', 1), ("C", 0)]
    assert lineage("A|B (x|C") == [("A", 0), ("B (x", 2), ("C", 0)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("taxon:1|A:2", ["taxon:1", "A:2"]),
        ("taxon:1 A:2\nB:3", ["taxon:1", "A:2", "B:3"]),
        ('taxon:1 "A:2, shelf 3"', ["taxon:1", "A:2, shelf 3"]),
        ("taxon:1, A:2\\, shelf 3,", ["taxon:1", "A:2, shelf 3"]),
        ("taxon:1; A:2; shelf 3; B:4", ["taxon:1", "A:2; shelf 3", "B:4"]),
        ('"taxon:1 ""blue"" form"|A:2', ['taxon:1 "blue" form', "A:2"]),
    ],
)
def test_cross_references(text, want):
    assert values(cross_references(text)) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("Besk,A.B., van der Dell,C. Jr. and O'Rist-Lak,D.", ["Besk,A.B.", "van der Dell,C. Jr.", "O'Rist-Lak,D."]),
        ("Besk, A. ; Dell, B.;", ["Besk, A.", "Dell, B."]),
        ("Besk AB, von Dell C", ["Besk AB", "von Dell C"]),
        ("A. B. Besk, C. Dell and D. el Rist", ["A. B. Besk", "C. Dell", "D. el Rist"]),
        ("Besk, A.\nDell, B.C.", ["Besk, A.", "Dell, B.C."]),
        ('"Besk, A." "Dell, B."', ["Besk, A.", "Dell, B."]),
        ('Besk,A., "Coast and Fen Team; second phase" & Dell,B. III', ["Besk,A.", "Coast and Fen Team; second phase", "Dell,B. III"]),
        ("and", []),
    ],
)
def test_persons(text, want):
    assert values(persons(text)) == want


def test_operator(spark):
    long = "|".join(f"Name{i}" for i in range(20_000))
    rows = [
        Row(info_id=1, taxonomy="A|B", db_xref=None, authors="unknown", value="clash", pos=7),
        Row(info_id=2, taxonomy="  ", db_xref="a:1 b:2", authors="", value=None, pos=None),
        Row(info_id=3, taxonomy=long, db_xref=None, authors=None, value=None, pos=None),
        Row(info_id=4, taxonomy="A|A", db_xref=None, authors='Dell, B.|"x', value=None, pos=None),
    ]
    df = spark.createDataFrame(rows, "info_id long, taxonomy string, db_xref string, authors string, value string, pos int")
    got = sorted(map(tuple, split_packed(df).where("info_id <> 3").collect()))
    assert got == [
        (1, "taxonomy", 1, "A", None), (1, "taxonomy", 2, "B", None), (2, "db_xref", 1, "a:1", None), (2, "db_xref", 2, "b:2", None),
        (4, "authors", 1, "Dell, B.", None), (4, "authors", 2, '"x', "open_quote"), (4, "taxonomy", 1, "A", None), (4, "taxonomy", 2, "A", None),
    ]
    assert split_packed(df).where("info_id = 3").count() == 20_000
    assert split_packed(df.limit(0)).count() == 0

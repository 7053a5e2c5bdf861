import pytest
from pyspark.sql import functions as F

from seqmill.schemas import HIT_TABLE
from seqmill.sources import alignments as A, fasta, search_xml

ROWS = [("one", "ACGT-A" * 15), ("two", "AC--GA" * 15), ("three", "ACGTTA" * 15)]


@pytest.mark.parametrize("form", A.FORMATS)
def test_formats_round_trip(form):
    text = A.write(ROWS, form)
    assert A.sniff(text) == form
    assert A.parse(text) == ROWS


def test_interleaved_phylip():
    assert A.parse(" 2 8\na  ACGT\nb  AC-T\n\nGGGG\nCCCC\n", "phylip") == [("a", "ACGTGGGG"), ("b", "AC-TCCCC")]


def test_names_and_matrix():
    assert A.safe_name("A b (c): d") == "A_b_c_d"
    assert A.safe_name("a__b") == "a__b"
    m = {(a, b): s for a, b, s in A.read_similarity_matrix("A C\nA 1 0\nC 2 1\n")}
    assert m["A", "C"] == m["C", "A"] == 1.0
    report = A.trimming_report([("x", "AC")], [True, False])
    assert report.count('class="k"') == 1


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for form in ("fasta", "clustal"):
        (tmp_path / f"in/x.{form}").write_text(A.write(ROWS, form))
    df = A.read_alignments(spark, str(tmp_path / "in"))
    assert df.count() == 6 and df.select("seq").distinct().count() == 3
    (tmp_path / "list.txt").write_text(f"{tmp_path}/in/x.fasta\n\n")
    assert A.read_file_list(spark, str(tmp_path / "list.txt")).count() == 3
    assert A.written(df, "phylip").count() == 2


def test_fasta(spark, tmp_path):
    (tmp_path / "ITS.fasta").write_text(">QZ1.1:1-6|Aa_bb|t > u\nACG\nTTT\n>QZ2 x\nA\n")
    got = sorted(map(tuple, fasta.read_fasta(spark, str(tmp_path / "ITS.fasta")).collect()))
    assert got == [("ITS", "QZ1.1", "QZ1.1:1-6|Aa_bb|t > u", "ACGTTT"), ("ITS", "QZ2", "QZ2 x", "A")]
    fasta.write_fasta(spark.createDataFrame([("h", "ACGT")], "description string, seq string"), str(tmp_path / "out"))
    assert fasta.read_fasta(spark, str(tmp_path / "out")).select("seq").collect() == [("ACGT",)]
    assert [p.split("/")[-1] for p in fasta.expand_paths([str(tmp_path), str(tmp_path / "ITS.fasta")])] == ["ITS.fasta"]


def test_tables_and_parameters(spark, tmp_path):
    df = spark.createDataFrame([("q", "s", None, None, 1, 2, 0, 1, 2, 3, 4, 0.5, 6.0)], HIT_TABLE)
    fasta.write_table(df, str(tmp_path / "t"))
    assert fasta.read_table(spark, str(tmp_path / "t"), HIT_TABLE).collect() == df.collect()
    assert fasta.read_table(spark, str(tmp_path / "t"), HIT_TABLE, ["q_start"]).columns == ["q_start"]
    fasta.write_parameters({"max_length": "800", "key_annotations": ["a", "b"]}, str(tmp_path / "p.txt"))
    assert fasta.read_parameters(spark, str(tmp_path / "p.txt")).first().parameters == {"max_length": "800", "key_annotations": "a|b"}


def test_search_xml(spark, tmp_path):
    hsp = "<Hsp><Hsp_bit-score>50.5</Hsp_bit-score><Hsp_evalue>1e-5</Hsp_evalue><Hsp_query-from>1</Hsp_query-from><Hsp_query-to>9</Hsp_query-to><Hsp_hit-from>5</Hsp_hit-from><Hsp_hit-to>13</Hsp_hit-to><Hsp_identity>9</Hsp_identity><Hsp_gaps>0</Hsp_gaps><Hsp_align-len>9</Hsp_align-len></Hsp>"
    hit = f"<Hit><Hit_id>gi|1|gb|A1.1|</Hit_id><Hit_def>first &gt;gi|2|gb|B2.1| second</Hit_def><Hit_hsps>{hsp}{hsp}</Hit_hsps></Hit>"
    (tmp_path / "r.xml").write_text(f"<BlastOutput><Iteration_hits>{hit}</Iteration_hits></BlastOutput>")
    got = search_xml.read_search_xml(spark, str(tmp_path / "r.xml"), "q")
    assert sorted(r.subject_acc for r in got.collect()) == ["A1.1", "A1.1", "B2.1", "B2.1"]
    assert got.columns == [x.split()[0] for x in HIT_TABLE.split(", ")]


def test_pages(spark):
    df = spark.createDataFrame([("RID = AB1\nRTOE = 12",), ('<p class="error"> too long </p>',), ("Message ID#24 Error: bad\n",)], "page string")
    rid, rtoe = search_xml.page_request(F.col("page"))
    got = df.select(rid, rtoe, search_xml.page_error(F.col("page"))).collect()
    assert [tuple(r) for r in got] == [("AB1", 12, None), (None, None, "too long"), (None, None, "Message ID#24 Error: bad")]


def test_settings():
    from seqmill.sources import settings

    r = settings.from_parameters({"target_region": "ITS", "key_annotations": "a| b", "max_length": "900", "unknown": "x", "word_size": ""})
    assert (r.key_annotations, r.max_length, r.word_size) == (("a", "b"), 900, 7) and settings.problems(r) == []
    bad = settings.Retrieval("", (), gap_costs="x", nucl_penalty=2)
    assert len(settings.problems(bad)) == 4
    request = settings.put_request("ACGT", r, 1000)
    assert request["HITLIST_SIZE"] == "1050" and "ENTREZ_QUERY" not in request


def test_record_writers(spark, tmp_path):
    from seqmill.sources import records

    df = spark.createDataFrame([("A1", None, "acgtn"), ("A2", "Aa", "AC")], "accession string, organism string, seq string")
    rows = {r.accession: r for r in records.seq_info_rows(df).collect()}
    assert rows["A1"].organism == rows["A2"].journal == "unknown" and rows["A1"].length == 4 and len(rows["A1"]) == 22
    records.write_checked(df, str(tmp_path / "o"), F.col("organism") == "Aa")
    got = spark.read.parquet(str(tmp_path / "o")).select("accession", F.col("is_valid").cast("string"))
    assert sorted(map(tuple, got.collect())) == [("A1", "false"), ("A2", "true")]

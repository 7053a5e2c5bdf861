import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqmill.operators import align, cluster, hits, kmer, matrix, msa, records, search, selection, trim
from seqmill.plans import alignment_queries, record_queries

HIT = "query_acc string, subject_acc string, n_identical long, alignment_length long, q_start long, q_end long, s_start long, s_end long, bit_score double"
ALN = "aln_id string, seq_id string, seq string"


def table(df):
    return sorted(map(tuple, df.collect()), key=repr)


def aln(spark, *seqs, name="a"):
    return spark.createDataFrame([(name, f"s{i}", s) for i, s in enumerate(seqs)], ALN)


@pytest.fixture
def queries(spark):
    return spark.createDataFrame([("q", 100, 0, 0), ("m", 100, 10, 10)], "id string, sequence_length long, missing_left long, missing_right long")


def test_join_grows_while_it_fits(spark, queries):
    rows = [("q", "s", 40, 40, 1, 40, 101, 140, 80.0), ("q", "s", 30, 30, 51, 80, 151, 180, 60.0), ("q", "s", 10, 10, 91, 100, 251, 260, 20.0), ("q", "s", 9, 9, 5, 13, 30, 22, 9.0)]
    got = hits.join_hits(spark.createDataFrame(rows, HIT), queries, 1000).first().asDict()
    assert (got["s_start"], got["s_end"], got["q_start"], got["q_end"], got["hits_num"], got["sum_hits_score"]) == (101, 180, 1, 80, 3, 160.0)


def test_join_on_the_minus_strand(spark, queries):
    rows = [("q", "s", 40, 40, 1, 40, 180, 141, 80.0), ("q", "s", 30, 30, 51, 80, 130, 101, 60.0)]
    df = spark.createDataFrame(rows, HIT)
    got = hits.join_hits(df, queries, 1000).first()
    assert (got.s_start, got.s_end, got.q_start, got.q_end, got.s_strand) == (180, 101, 1, 80, False)
    legacy = hits.join_hits(df, queries, 1000, legacy_negative_join=True).first()
    assert (legacy.hits_num, legacy.s_end) == (1, 141)
    fold = hits.join_hits(df, queries, 1000, legacy_negative_fold=True).first()
    assert (fold.hits_num, fold.s_end) == (2, 141)


def test_join_repeated_and_missing(spark, queries):
    row = ("q", "s", 40, 40, 1, 40, 101, 140, 80.0)
    df = spark.createDataFrame([row, row, ("q", None, *row[2:]), ("unknown", "s", *row[2:])], HIT)
    got = hits.join_hits(df, queries, 1000).collect()
    assert [(r.subject_acc, r.hits_num, r.sum_hits_alignlen) for r in got] == [("s", 2, 80)]
    assert hits.join_hits(df.limit(0), queries, 1000).count() == 0


@pytest.mark.parametrize("query, most, want", [("q", 200, (91, 190)), ("m", 101, (91, 190)), ("m", 200, (81, 200))])
def test_extension(spark, queries, query, most, want):
    one = spark.createDataFrame([(query, "s", 11, 90, 101, 180, 5.0)], "query_acc string, subject_acc string, q_start long, q_end long, s_start long, s_end long, sum_hits_score double")
    got = hits.extend_hits(one, queries, most).first()
    assert (got.s_extstart, got.s_extend) == want


def test_stop_rule():
    assert hits.should_stop([(1, 9, 200)], 100)
    assert not hits.should_stop([(1, 9, 20), (2, 1, 21)], 100)
    assert hits.should_stop([(1, 1, 20), (2, 2, 22)], 100)


def test_aliases(spark):
    df = spark.createDataFrame([("gi|1|gb|A1.1|", "first>gi|2|gb|B2.1| second>bad third", 5)], "hit_id string, hit_def string, x long")
    assert table(hits.expand_aliases(df).select("subject_acc", "hit_def", "x")) == [("A1.1", "first", 5), ("B2.1", "second", 5)]


def test_first_rows_and_queries(spark):
    df = spark.createDataFrame([("a", 2, None), ("a", 1, "x"), (None, 3, "y"), (None, 4, "z")], "k string, o long, v string")
    assert table(records.first_rows(df, ["k"], ["o"])) == [("a", 1, "x"), (None, 3, "y")]
    assert records.dedup_queries_exact([("d", "S"), ("e", "S"), ("d", "T"), ("f", "T")]) == [0, 3]
    q = spark.createDataFrame([("1", "d", "S"), ("2", "e", "S"), ("3", "d", "T"), ("4", "f", "T")], "id string, description string, sequence string")
    assert [r.id for r in records.dedup_queries(q, "id").orderBy("id").collect()] == ["1", "4"]


def test_exceptional(spark):
    recs = spark.createDataFrame([("1", "AATT-CGGAA"), ("2", "A" * 20), ("3", "A" * 20), ("4", "A" * 20)], "accession string, seq string")
    info = spark.createDataFrame([("1", "Aa bb"), ("2", "Aa sp. 1"), ("3", "Aa cc"), ("4", "Aa dd"), ("4", "Aa dd")], "accession string, organism string")
    keep = lambda **kw: [r[0] for r in records.exceptional_filter(recs, info, **kw).select("accession").orderBy("accession").collect()]
    assert keep(length_threshold=10) == ["3"]
    assert keep(length_threshold=10, ignore_gap=False) == ["1", "3"]
    assert keep(kinds=(), length_threshold=10) == ["2", "3"]


def test_search_terms():
    assert records.search_term(["A", "B"], "x[Title]") == "(A[Organism] OR B[Organism]) AND (x[Title])"
    assert records.search_term(["A"], "NOT y") == "(A[Organism]) NOT y"
    assert records.search_term(["A"]) == "(A[Organism])"


def test_ranks_over_ties(spark):
    rng = random.Random(1)
    values = [rng.choice([None, 1.0, 2.0, 2.5, 3.0]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v double").repartition(5)
    got = {r.i: r.r for r in selection.average_rank(df, "v", "r").collect()}
    import pandas as pd

    want = pd.Series(values, dtype=float).rank(ascending=False, method="average")
    assert all(got[i] is None if values[i] is None else got[i] == want[i] for i in range(60))


def test_representative_layers(spark):
    cols = "taxon_name string, id long, consensus_value double, v boolean, j boolean, date date, sum_of_rank double"
    rows = [("t", 1, 0.9, True, True, "2020-01-01", 5.0), ("t", 2, 0.95, False, False, None, 9.0), ("t", 3, 0.95, True, False, "2019-01-01", 9.0), ("t", 4, 0.95, True, False, "2020-01-01", 7.0), (None, 5, 1.0, True, True, None, 1.0)]
    df = spark.createDataFrame([(*r[:5], r[5], r[6]) for r in rows], cols.replace("date date", "date string")).withColumn("date", F.to_date("date"))
    pick = lambda **kw: [r.id for r in selection.representative_per_taxon(df, F.col("v"), F.col("j"), "id", **kw).collect()]
    assert pick() == [4]
    assert pick(consensus=False) == [1]


def test_splits(spark):
    df = spark.createDataFrame([("g", i, "A" * n) for i, n in enumerate([10, 11, 30, 31, 60])], "g string, i long, s string")
    assert [r.cluster for r in selection.length_clusters(df, "g", "s", 3).orderBy("i").collect()] == [0, 0, 1, 1, 2]
    assert [r.chunk for r in selection.chunks(df, "g", "i", 2).orderBy("i").collect()] == [0, 0, 1, 1, 2]
    assert [r.tier for r in selection.backbone_tiers(df, "g", "s", "i", 2).orderBy("i").collect()] == ["fragment", "fragment", "add", "long", "long"]
    a, b = (sorted(r.i for r in selection.sample_per_group(df, "g", "i", 3, s).collect()) for s in (1, 1))
    assert a == b and len(a) == 3


@pytest.mark.parametrize("column, want", [("AG", "R"), ("A-", "N"), ("--", "-"), ("AAG", "A"), ("ACGT", "N"), ("RA", "A"), ("U", "T"), ("RY", "N")])
def test_consensus_base(spark, column, want):
    a = aln(spark, *(f"A{c}A" for c in column))
    assert [r.consensus for r in msa.consensus_columns(a).orderBy("col").collect()][1] == want


def test_identity(spark):
    a = aln(spark, "ACGT", "ACGA")
    value = lambda **kw: msa.pairwise_identity(a, **kw).first().identity
    assert value() == 0.75
    assert value(ends="legacy") == 1.0
    assert value(percent=False) == 3.0
    assert msa.pairwise_identity(aln(spark, "AR-", "GA-")).first().identity == pytest.approx(0.25)
    assert msa.pairwise_identity(aln(spark, "A--", "--A"), ends="shared").first().identity == 0.0
    assert msa.p_distance(aln(spark, "A-C", "A-G")).first().p_distance == pytest.approx(1 / 3)


def test_islands(spark):
    rows = ["AC" + "-" * 28 + "GT"] * 4 + ["AC" + "A" * 28 + "GT"]
    a = aln(spark, *rows)
    assert table(msa.insertion_islands(a, 1, 20)) == [("a", 3, 30)]
    assert {r.seq for r in msa.remove_insertions(a, 1, 20).collect()} == {"ACGT"}
    assert msa.insertion_islands(a, 1, 29).count() == 0


def test_overlap_equals_its_definition(spark):
    rng = random.Random(2)
    seqs = ["".join(rng.choice("ACG-N") for _ in range(12)) for _ in range(6)]
    got = {r.seq_id: r.overlap for r in msa.overlap_values(aln(spark, *seqs), 0.6).collect()}
    for i, s in enumerate(seqs):
        n = 0
        for c in range(12):
            hit = sum(s[c] == t[c] or (s[c] not in "-N" and t[c] not in "-N") for j, t in enumerate(seqs) if j != i)
            n += hit >= 3
        assert got[f"s{i}"] == pytest.approx(n / 12, abs=1e-5)
    assert np.allclose(sorted(got.values()), sorted(trim.overlaps(trim.matrix(seqs), 0.6, False)), atol=1e-5)


def test_sum_of_pairs(spark):
    assert msa.sum_of_pairs(aln(spark, "AC-GT", "ACAGT", "GCAGT")).first().score == (1 - 1 - 1) + 3 + 1 + 3 + 3 - 2


def test_consistency(spark):
    rows = [("s", "x", "1", "AC-G"), ("s", "x", "2", "ACTG"), ("s", "y", "1", "AC-G"), ("s", "y", "2", "ACTG"), ("s", "z", "1", "-ACG"), ("s", "z", "2", "ACTG")]
    df = spark.createDataFrame(rows, "set_id string, aln_id string, seq_id string, seq string")
    got = {r.aln_id: r.consistency for r in msa.consistency(df).collect()}
    assert got["x"] == got["y"] > got["z"]
    assert table(msa.most_consistent(df)) == [("s", "x")]
    assert ("s", "x", "y", 4) in table(msa.shared_columns(df))


def _forms(seed, rows, n_forms, letters="ACGT", width=24):
    """Alignments of the same rows, with gaps at random places."""
    rng = random.Random(seed)
    residues = ["".join(rng.choice(letters) for _ in range(rng.randrange(width // 2, width))) for _ in range(rows)]
    out = {}
    for a in "xyz"[:n_forms]:
        out[a] = []
        for r in residues:
            at = sorted(rng.sample(range(width), len(r)))
            out[a].append("".join(r[at.index(c)] if c in at else "-" for c in range(width)))
    return out


SET = "set_id string, aln_id string, seq_id string, seq string"


@pytest.mark.parametrize("part", [1 << 21, 200])
def test_consistency_counts_meetings_instead_of_pairs(spark, monkeypatch, part):
    monkeypatch.setattr(msa, "PART", part)
    forms = _forms(11, 60, 3)
    df = spark.createDataFrame([(s, a, f"r{i}", r) for s in ("s", "t") for a, rows in forms.items() for i, r in enumerate(rows)], SET)
    meetings = msa._meetings(df).count()
    assert meetings <= 12 * df.count() * 24  # in proportion to the letters, whatever the number of rows of a set
    got = {(r.set_id, r.aln_id): r.consistency for r in msa.consistency(df).collect()}
    assert len(got) == 6
    for (_, a), v in got.items():
        assert v == pytest.approx(trim.agreement(forms[a], [r for b, r in forms.items() if b != a]).mean(), abs=1e-5)


def _identity(a, b):
    both = list(itertools.zip_longest(a or [""], b or [""], fillvalue="-"))
    n = sum(x not in "-N" or y not in "-N" for x, y in both if x or y) + sum(not x and not y for x, y in both)
    same = sum(x == y and (not x or x not in "-N") for x, y in both)
    return same / n if n else None


IDENT = ["ACGT-N", "ACGTAA", "acRT-N", "------", "NN-N--", "ACé😀--", "ACé😀-A", "AC", "-CGTAA"]


def test_determined_identity_compares_blocks(spark, monkeypatch):
    # every two rows once, however they fall into blocks, and shorter rows as if filled with gaps
    want = sorted(((f"s{i}", f"s{j}", _identity(IDENT[i], IDENT[j])) for i in range(len(IDENT)) for j in range(i + 1, len(IDENT))), key=repr)
    for block in (512, 3):
        monkeypatch.setattr(msa, "BLOCK", block)
        got = table(msa.determined_identity(aln(spark, *IDENT)).select("i", "j", "identity", "distance_pct"))
        assert [r[:3] for r in got] == want
        assert all(d is None if v is None else d == 100 - 100 * v for *_, v, d in got)
    assert np.isnan(msa.determined(["--"], ["NN", None])).all()


def test_identity_summary_writes_no_pairs(spark, monkeypatch):
    of = {i: [v for j in range(len(IDENT)) if i != j and (v := _identity(IDENT[i], IDENT[j])) is not None] for i in range(len(IDENT))}
    means, most = [sum(v) / len(v) for v in of.values() if v], [max(v) for v in of.values() if v]
    for block in (512, 3):
        monkeypatch.setattr(msa, "BLOCK", block)
        df = msa.identity_summary(aln(spark, *IDENT).unionByName(aln(spark, "AC", name="one")).unionByName(aln(spark, "-", "N", name="none")))
        got = {r.aln_id: r for r in df.collect()}
        assert set(got) == {"a", "none"} and got["none"].mean_identity is None and got["none"].mean_max_identity is None
        assert got["a"].mean_identity == pytest.approx(sum(means) / len(means), abs=1e-6)
        assert got["a"].mean_max_identity == pytest.approx(sum(most) / len(most), abs=1e-6)
    assert "MapInArrow" in df._jdf.queryExecution().optimizedPlan().toString()  # sums of blocks come out of the comparison, not pairs


def test_consistency_of_a_row_delivered_twice(spark):
    # only pairs of different rows count, each as often as it stands there
    rows = [("s", "x", "1", "AC-"), ("s", "x", "1", "AC-"), ("s", "x", "2", "AC-"), ("s", "y", "1", "AC-"), ("s", "y", "2", "-AC")]
    df = msa.consistency(spark.createDataFrame(rows, SET))
    got = {r.aln_id: r.consistency for r in df.collect()}
    assert got["x"] == pytest.approx(2 * 1 / 3, abs=1e-5) and got["y"] == 0
    assert "posexplode" not in df._jdf.queryExecution().optimizedPlan().toString()  # nor are cells joined with cells


@pytest.mark.parametrize("part", [1 << 21, 2000])
def test_consistency_counts_runs_instead_of_cells(spark, monkeypatch, part):
    monkeypatch.setattr(msa, "PART", part)
    monkeypatch.setattr(msa, "LETTERS", 700, raising=False)
    rng = random.Random(13)
    residues = ["".join(rng.choice("ACGTé😀") for _ in range(300 - rng.randrange(3))) for _ in range(40)]
    forms = {"x": [r.ljust(302, "-") for r in residues], "y": [r.rjust(302, "-") for r in residues], "z": [(r[:100] + "--" + r[100:]).ljust(302, "-") for r in residues]}
    df = spark.createDataFrame([("s", a, f"r{i}", r) for a, rows in forms.items() for i, r in enumerate(rows)], SET)
    assert msa._meetings(df).count() < 40 * 302 // 10  # two numbers a run of residues, not one a column
    for r in msa.consistency(df).collect():
        assert r.consistency == pytest.approx(trim.agreement(forms[r.aln_id], [f for b, f in forms.items() if b != r.aln_id]).mean(), abs=1e-5)


def test_consistency_of_an_only_alignment_is_none(spark):
    got = msa.consistency(spark.createDataFrame([("s", "x", "1", "AC-"), ("s", "x", "2", "ACG"), ("t", "x", "1", "AC")], SET))
    assert table(got) == [("s", "x", 0.0)]


def test_consistency_has_two_scans_in_its_plan(spark, sf):
    plan = alignment_queries.QUERIES["consistency"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 2  # the jobs, and their widths


@pytest.mark.parametrize("part", [1 << 21, 150])
def test_shared_columns_knows_columns_by_digests(spark, monkeypatch, part):
    monkeypatch.setattr(msa, "PART", part)
    forms = _forms(12, 8, 3, width=6)
    forms["y"] = [r[:2] + "--" + r[2:] for r in forms["x"]]  # the same columns, and two of gaps only
    forms["z"] = [r[:2] + "-" + r[2 : 5 + i % 2] for i, r in enumerate(forms["x"])]  # rows of unequal length
    df = spark.createDataFrame([("s", a, f"r{i}", r) for a, rows in forms.items() for i, r in enumerate(rows)], SET)
    columns = {}
    for a, rows in forms.items():
        columns[a] = [tuple((i, 0 if r[c] == "-" else c + 1 - r[: c + 1].count("-")) for i, r in enumerate(rows) if c < len(r)) for c in range(max(map(len, rows)))]
    want = [("s", a, b, n) for a, b in itertools.combinations("xyz", 2) if (n := sum(p == q for p in columns[a] for q in columns[b]))]
    assert table(msa.shared_columns(df)) == want
    parts = msa._column_digests(df).collect()
    assert all(len(r.digest) == 32 for r in parts) and (part > 150) == (len({r.part for r in parts}) == 1)


# ------------------------------------------------------------------ trimming

ROWS = ["A-CGT-A", "A-CGTTA", "A--GTTA", "A-CG--A"]


def kept(how, rows=ROWS):
    return "".join("x" if k else "." for k in trim.kept_columns(rows, how)[0])


def test_simple_cuts():
    assert kept(trim.Trim("nogaps")) == "x..x..x"
    assert kept(trim.Trim("noallgaps")) == "x.xxxxx"
    assert kept(trim.Trim("threshold", gap=0.75)) == "x.xxx.x"
    assert kept(trim.Trim("select", columns=((0, 1), (6, 6)))) == "..xxxx."
    assert trim.kept_columns(["A-C", "A-G"], trim.Trim("noallgaps"))[0].tolist() == [True, False, True]


@pytest.mark.parametrize("method", ["nogaps", "noallgaps", "gappyout", "strict", "strictplus", "automated1"])
def test_complement_covers_the_rest(method):
    rng = random.Random(7)
    rows = ["".join(rng.choice("ACGT-") for _ in range(80)) for _ in range(9)]
    a, b = kept(trim.Trim(method), rows), kept(trim.complement(trim.Trim(method)), rows)
    assert all((x == "x") != (y == "x") for x, y in zip(a, b))


def test_kept_share():
    rng = random.Random(8)
    rows = ["".join(rng.choice("ACGT--") for _ in range(100)) for _ in range(9)]
    for keep in (40, 60, 80):
        assert kept(trim.Trim("threshold", gap=0.99, keep=keep), rows).count("x") >= keep


def test_blocks_and_rescue():
    k = np.array([1, 1, 0, 1, 1, 0, 0, 1], bool)
    assert trim.runs(k) == [(0, 2), (3, 5), (7, 8)]
    assert trim.drop_short(k, 2).tolist() == [True, True, False, True, True, False, False, False]
    assert trim.rescue(np.array([1, 1, 1, 0, 1, 1, 1, 1], bool)).astype(int).tolist() == [1, 0, 1, 1, 1, 1, 1, 1]
    assert trim.rescue(np.array([1, 1, 0, 1, 1, 1], bool)).astype(int).tolist() == [1, 0, 0, 1, 0, 1]


def test_similarity():
    same = trim.similarity(trim.matrix(["AA", "AC", "AG"]), np.array([0, 0]), False)
    assert same[0] == 1 and 0 < same[1] < 1
    near = (("M", "M", 5.0), ("M", "L", 4.0), ("L", "M", 4.0), ("L", "L", 5.0), ("K", "K", 5.0))
    d = trim.distance_table(True, near)
    assert d[ord("M"), ord("M")] == 0 and d[ord("M"), ord("L")] < d[ord("M"), ord("K")]
    assert trim.distance_table(True)[ord("M"), ord("L")] == pytest.approx(2**0.5)
    assert trim.is_amino(trim.matrix(["MKVLW", "MKVLW"])) and not trim.is_amino(trim.matrix(["ACGT"]))


@pytest.mark.parametrize("bad", [dict(method="nope"), dict(method="nogaps", gap=0.5), dict(method="threshold"), dict(method="threshold", gap=2), dict(method="overlap"), dict(method="select", columns=((3, 1),))])
def test_options_that_exclude_each_other(bad):
    with pytest.raises(ValueError):
        trim.validate(trim.Trim(**bad))


def test_trim_operator(spark):
    a = aln(spark, *ROWS).unionByName(aln(spark, "A-", "--", name="b"))
    got = table(trim.trim(a, trim.Trim("noallgaps")))
    assert ("b", "s0", "A") in got and not any(r[:2] == ("b", "s1") for r in got)
    assert table(trim.column_map(a.where("aln_id = 'a'"), trim.Trim("nogaps"))) == [("a", 0, 0), ("a", 3, 1), ("a", 6, 2)]
    assert trim.trim(a.limit(0)).count() == 0


# --------------------------------------------------- words, graphs, alignment


def test_kmer_similarity(spark):
    df = spark.createDataFrame([("1", 0, 2), ("1", 1, 1), ("2", 0, 1), ("2", 1, 1), ("2", 2, 1)], "id string, kmer long, n long")
    assert table(kmer.kmer_similarity(df)) == [("1", "2", round(2 / 3, 6))]


def test_proximity_equals_all_pairs(spark):
    rng = random.Random(3)
    pts = [(rng.choice("ab"), i, rng.randrange(60), rng.randrange(60), 8.0) for i in range(80)]
    df = spark.createDataFrame(pts, "g string, i long, x long, y long, r double")
    want = sorted(((a[0], a[1], b[1]) for a in pts for b in pts if a[0] == b[0] and a[1] < b[1] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 64), key=repr)
    assert table(cluster.proximity_edges(df, "g", "i", "x", "y", "r")) == want


def test_clusters():
    assert cluster.markov_clusters(6, [(0, 1), (1, 2), (0, 2), (3, 4)]) == [0, 0, 0, 1, 1, 2]
    d = np.abs(np.subtract.outer([0.0, 0.1, 5.0, 5.1, 5.2], [0.0, 0.1, 5.0, 5.1, 5.2]))
    assert cluster.average_linkage(d, 2) == [0, 0, 1, 1, 1]
    assert cluster.distance_clusters(d) == [0, 0, 1, 1, 1]


def test_alignment_keeps_residues():
    rng = random.Random(4)
    base = "".join(rng.choice("ACGT") for _ in range(120))
    seqs = [base[:i] + base[i + 3 :] for i in (10, 40, 70)] + [base, base + "ACG"]
    rows = align.star(seqs)
    assert len({len(r) for r in rows}) == 1 and [r.replace("-", "") for r in rows] == seqs
    assert align.star([base, base]) == [base, base]
    mixed = [*seqs, base[:40], base[30:75]]
    rows = align.long_group(mixed)
    assert len({len(r) for r in rows}) == 1 and [r.replace("-", "") for r in rows] == mixed
    assert align.global_pair("", "AC") == ("--", "AC")


def test_supermatrix(spark):
    a = spark.createDataFrame([("a", "x", "ACG"), ("b", "x", "TT"), ("b", "y", "TA")], "marker string, taxon string, seq string")
    done = matrix.complete_taxa(a)
    assert ("a", "y", "---") in table(done)
    assert table(matrix.supermatrix(done)) == [("x", "ACGTT"), ("y", "---TA")]
    assert matrix.supermatrix(a).count() == 0  # other taxa in one marker
    assert table(matrix.partition_ranges(done)) == [("a", 1, 3), ("b", 4, 5)]
    assert ("a_2", 2, 3, 3) in table(matrix.codon_partitions(matrix.partition_ranges(done)))


def test_search_finds_both_strands(spark):
    rng = random.Random(5)
    s = "".join(rng.choice("ACGT") for _ in range(200))
    back = s[50:90][::-1].translate(str.maketrans("ACGT", "TGCA"))
    q = spark.createDataFrame([("q1", s[20:80]), ("q2", back)], "id string, seq string")
    subjects = spark.createDataFrame([("s", s)], "id string, seq string")
    got = {r.query_acc: (r.q_start, r.q_end, r.s_start, r.s_end, r.n_identical) for r in search.seed_hits(q, subjects).where("alignment_length > 30").collect()}
    assert got == {"q1": (1, 60, 21, 80, 60), "q2": (1, 40, 90, 51, 40)}
    want = spark.createDataFrame([("s", 90, 51)], "accession string, s_start long, s_end long")
    assert search.fetch_regions(want, subjects.withColumnRenamed("id", "accession")).first().seq == back


def test_agreement_equals_the_joined_figure(spark):
    rng = random.Random(9)
    forms = {}
    for name in "xyz":
        rows = []
        for _ in range(4):
            s = list("ACGTAC")
            for _ in range(3):
                s.insert(rng.randrange(len(s) + 1), "-")
            rows.append("".join(s))
        forms[name] = rows
    df = spark.createDataFrame([("s", a, str(i), r) for a, rows in forms.items() for i, r in enumerate(rows)], "set_id string, aln_id string, seq_id string, seq string")
    got = {r.aln_id: r.consistency for r in msa.consistency(df).collect()}
    for a, rows in forms.items():
        assert got[a] == pytest.approx(trim.agreement(rows, [r for b, r in forms.items() if b != a]).mean(), abs=1e-5)
    assert trim.trim_by_consistency(df, trim.Trim("threshold", consistency=0.9)).select("aln_id").distinct().count() <= 1


def test_large_groups_are_aligned_in_many_tasks(spark, monkeypatch):
    rng = random.Random(8)
    base = "".join(rng.choice("ACGT") for _ in range(90))

    def near():
        s = list(base)
        for _ in range(4):
            at = rng.randrange(len(s))
            s[at : at + 1] = rng.choice(["", "A", "GGT", "C"])
        return "".join(s)

    rows = [("hot", f"h{i:02}", near()) for i in range(40)] + [("hot", "h98", "ACG"), ("hot", "h99", base), ("hot", "i00", base), (None, "n", base), (None, "m", near())]
    rows += [("cold", "c1", near()), ("cold", "c2", near())]
    df = spark.createDataFrame(rows, "aln_id string, seq_id string, seq string")
    assert table(align.align(df, most=5)) == table(align.align(df))  # refused before
    monkeypatch.setattr(align, "LONG_ROWS", 8)
    df = df.unionByName(spark.createDataFrame([("hot", f"f{i}", base[i * 9 : i * 9 + 25]) for i in range(5)], df.schema))
    got = align.align(df, "long").where("aln_id = 'hot'").collect()
    want = {r.seq_id: r.seq for r in df.where("aln_id = 'hot'").collect()}
    assert {r.seq_id: r.seq.replace("-", "") for r in got} == want and len(got) == len(want) and len({len(r.seq) for r in got}) == 1


def test_records_of_all_written_forms(spark, tmp_path):
    d, path = str(tmp_path), "Eukaryota{0}Viridiplantae{0}Aa{0}Aa bb"
    forms = [("2010-01-15", "|"), ("15-JAN-2010", ";"), ("2010-01-15T10:00:00Z", ", "), ("15-JAN-2020", ";"), ("2010", ">")]
    rows = [(i, path.format(s), "Aa bb", "Notes", t, "S") for i, (t, s) in enumerate(forms)] + [(9, None, "Aa bb", "Notes", "15-JAN-2010", "S"), (10, path.format("|"), None, "Notes", None, "S")]
    spark.createDataFrame(rows, "info_id long, taxonomy string, organism string, title string, date string, site_code string").write.parquet(f"{d}/seq_info.parquet")
    spark.createDataFrame([("S", "UTC", "dmy")], "site_code string, zone_name string, date_order string").write.parquet(f"{d}/deposit_sites.parquet")
    assert sorted(r.info_id for r in record_queries.record_predicate(spark, d).collect()) == [0, 1, 2, 4]
    assert table(record_queries.lineage_ranks(spark, d)) == sorted([(i, "Aa", "Aa") for i in range(5)] + [(10, "Aa", None)], key=repr)
    assert table(record_queries.upper_taxon_sizes(spark, d)) == [("Viridiplantae", "Aa", 6)]
    assert [r.reference for r in record_queries.borrowed_reference(spark, d).collect()] == ["Aa"]


def test_query_duplicates_by_the_one_pass_rule(spark):
    rng = random.Random(12)
    for rows in ([("d1", "s1"), ("d2", "s1"), ("d2", "s3")], [(rng.choice("abcdefgh"), rng.choice(["S", "T", "U", "V", "W", "X", None])) for _ in range(40)]):
        q = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, description string, sequence string")
        assert sorted(r.id for r in records.dedup_queries(q, "id").collect()) == records.dedup_queries_exact(rows)
    assert records.dedup_queries(q.limit(0), "id").count() == 0


@pytest.mark.parametrize(
    "kept, allowed, keep, want",
    [
        ("0011000000110000", "0111100011111100", 60, "0111100011111100"),
        ("1000000000000001", "1111111111111111", 50, "1001111110000001"),
        ("0001000110000000", "1111111111110000", 70, "0111111111110000"),
        ("0000000000", "1111111111", 40, "0011110000"),
        ("1100110011001100", "1110110111011101", 80, "1110110111011100"),
        ("0110", "1110", 100, "1110"),
    ],
)
def test_refill(kept, allowed, keep, want):
    flags = lambda s: np.array([c == "1" for c in s])
    got = trim.refill(flags(kept), flags(allowed), keep)
    assert "".join("01"[int(c)] for c in got) == want

import random

from pyspark.sql import functions as F

from seqmill.operators import search
from seqmill.plans import alignment_queries, pipeline
from seqmill.schemas import HIT_TABLE
from seqmill.streaming import ingest

CONTROL = "accession string, genus string, start long, seq string"


def corpus(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("ACGT") for _ in range(160))
    near = lambda p: "".join(rng.choice("ACGT") if rng.random() < p else c for c in base)
    rows = [(f"S{i}", near(0.02 + 0.01 * (i % 4)), "ITS gene") for i in range(12)] + [("X1", "".join(rng.choice("ACGT") for _ in range(160)), "other")]
    return base, spark.createDataFrame(rows, "id string, seq string, title string")


def test_retrieval_reaches_its_end_and_resumes(spark, tmp_path):
    base, subjects = corpus(spark)
    queries = spark.createDataFrame([("Q", base[:120])], "id string, seq string")
    run = lambda: (lambda st: (st, pipeline.retrieve(st, queries, subjects, F.col("title").contains("ITS"), 100, 200)))(pipeline.Stages(spark, str(tmp_path)))
    first, got = run()
    found = sorted(r.subject_acc for r in got.collect())
    assert found == sorted(f"S{i}" for i in range(12)) and first.done[0] == "round_1"
    again, same = run()
    assert again.done == [] and sorted(r.subject_acc for r in same.collect()) == found


def test_reduction_keeps_one_per_species(spark):
    _, subjects = corpus(spark)
    recs = subjects.select(F.col("id").alias("accession"), "seq")
    n = F.substring("id", 2, 2).cast("int")
    info = subjects.select(
        F.col("id").alias("accession"),
        F.when(n % 3 == 0, "Aa bb").when(n % 3 == 1, "Aa bb var. cc").otherwise("Aa sp. 4").alias("organism"),
        F.lit(None).cast("string").alias("specimen_voucher"), F.lit("J").alias("journal"), F.lit("2020-01-01").cast("date").alias("date"),
    )
    results = subjects.select(F.col("id").alias("subject_acc"), F.lit(9.0).alias("sum_hits_score"), F.lit(1).alias("source"))
    got = pipeline.reduce_dataset(recs.where("accession <> 'X1'"), info, results).collect()
    assert [r.taxon_name for r in got] == ["Aa_bb"] and got[0].consensus_value > 0.9


def test_extension_control(spark):
    core = "ACGGTCATTGACCATGGCATCAGGATTACA"
    rows = [(f"r{i}", "G", 101, core) for i in range(6)] + [("long", "G", 71, "T" * 30 + core)]
    recs = spark.createDataFrame(rows, CONTROL)
    original = spark.createDataFrame([(r[0], 101, 130) for r in rows], "accession string, r_start long, r_end long")
    got = {r.accession: r.seq for r in pipeline.control_extension(recs, original).collect()}
    assert all(core in s for s in got.values()) and len(got) == 7


def test_stream_keeps_each_accession_once(spark, tmp_path):
    row = lambda acc, n: ("q", acc, None, None, 1, 2, 0, 1, 2, n, 4, 0.5, 6.0)
    write = lambda rows: spark.createDataFrame(rows, HIT_TABLE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go = lambda: ingest.keep_new(ingest.stream_hits(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    write([row("A", 5), row("A", 3), row("B", 1), row(None, 1)])
    go()
    write([row("A", 1), row("C", 2)])
    go()
    got = sorted((r.subject_acc, r.s_start) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("A", 3), ("B", 1), ("C", 2)]


def test_small_genera_borrow_the_alignment_of_their_largest_relative(spark):
    rng = random.Random(6)
    core, ahead, other = ("".join(rng.choice("ACGT") for _ in range(n)) for n in (30, 60, 50))
    big = [(f"g{i}", "Big", "F", 41, ahead + core) for i in range(6)] + [(f"o{i}", "Odd", "E", 81, other) for i in range(9)]
    # an end that lies far from the hit in the relatives' alignment
    few = [("s1", "Small", "F", 81, ahead[:20] + core), ("n1", None, "F", 81, ahead[:20] + core), ("t1", "Tiny", "E", 81, other)]
    recs = spark.createDataFrame(big + few, "accession string, genus string, family string, start long, seq string")
    original = spark.createDataFrame([(r[0], 101, 130) for r in big + few], "accession string, r_start long, r_end long")
    got = {r.accession: (r.start, r.seq) for r in pipeline.control_extension(recs, original, parent="family").collect()}
    assert len(got) == 18 and got["s1"] == got["n1"] == (101, core)
    assert got["t1"] == (81, other) and got["g0"] == (41, ahead + core)
    alone = recs.where("accession in ('s1', 't1')")  # no large genus
    assert {r.accession: r.seq for r in pipeline.control_extension(alone, original).collect()} == {"s1": ahead[:20] + core, "t1": other}


def test_rare_long_insertions_do_not_count_for_the_consensus(spark, tmp_path):
    rng = random.Random(7)
    a, b, ins = ("".join(rng.choice("ACGT") for _ in range(n)) for n in (50, 50, 25))
    rows = [(f"r{i}", "Aa_bb", a + (ins if i == 3 else "") + b) for i in range(4)]
    recs = spark.createDataFrame(rows, "accession string, taxon_name string, seq string")
    results = recs.select(F.col("accession").alias("subject_acc"), F.lit(9.0).alias("sum_hits_score"), F.lit(1).alias("source"))
    assert {r.consensus_value for r in pipeline.evaluate(recs, results).collect()} == {1.0}
    jobs = recs.select(F.col("taxon_name").alias("query"), F.col("accession").alias("id"), F.col("seq").alias("sequence"))
    jobs.write.parquet(str(tmp_path / "search_jobs.parquet"))
    assert [r.consensus for r in alignment_queries.consensus_per_taxon(spark, str(tmp_path)).collect()] == [a + b]


def test_new_queries_are_fit_and_of_other_sequence_clusters(spark, tmp_path):
    rng = random.Random(11)
    kinds = ["".join(rng.choice("ACGT") for _ in range(100)) for _ in range(3)]
    near = lambda s, i: s[:i] + ("A" if s[i] != "A" else "C") + s[i + 1 :]
    seqs = {f"k{k}_{i}": near(s, 10 + i) for k, s in enumerate(kinds) for i in range(3)} | {"k1_9": near(kinds[1], 40) + "ACGT"}
    bad = {"short": "ACGT" * 5, "vague": kinds[0][:50] + "N" * 50, "again": kinds[2]}
    subjects = spark.createDataFrame(list((seqs | bad).items()), "id string, seq string")
    # every hit is far from the others on its query, so all are position clusters
    hits = [("Q", name, 5.0, 100 * i + 1, 100 * i + 50, 50) for i, name in enumerate(seqs | bad)]
    new = spark.createDataFrame(hits, "query_acc string, subject_acc string, sum_hits_score double, q_start long, q_end long, sum_hits_alignlen long")
    used = spark.createDataFrame([(kinds[2],)], "sequence string")
    got = {r.id for r in pipeline.choose_queries(new, subjects, 20, used, 200).collect()}
    assert len(got) == 3 and {g[:2] for g in got} == {"k0", "k1", "k2"} and "k1_9" in got
    queries = spark.createDataFrame([("a", kinds[0]), ("b", kinds[0]), ("c", kinds[1])], "id string, seq string")
    seen = []
    find = lambda q, s: seen.append(sorted(r.id for r in q.collect())) or search.seed_hits(q, s, 11)
    pipeline.retrieve(pipeline.Stages(spark, str(tmp_path)), queries, subjects.withColumn("title", F.lit("x")), F.lit(True), 1, 200, rounds=1, search_with=find)
    assert seen == [["a", "c"]]

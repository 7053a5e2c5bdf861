"""Offline substitute for a remote similarity search, and region fetching.

Seed and extend on DataFrames: words of queries and subjects meet in an
equi-join, hits on one diagonal that overlap or touch form a run, and a run is
scored without gaps. The contract is the hit table's schema and what is done
with it, not the scores of any service.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.sequence import kmers, reverse_complement, trim_residues


def _words(df: DataFrame, k: int, prefix: str) -> DataFrame:
    return df.select(F.col("id").alias(f"{prefix}_id"), F.posexplode(kmers(F.upper("seq"), k)).alias(f"{prefix}_p", "w")).where(F.col("w").rlike("^[ACGT]+$"))


def seed_hits(queries: DataFrame, subjects: DataFrame, word_size: int = 11, reward: int = 1, penalty: int = -1, expect: float = 10.0) -> DataFrame:
    """Hit table of (id, seq) queries against (id, seq) subjects, both strands.

    A frequent word makes the join skewed; adaptive execution splits such
    partitions. A run of seeds spans from its first word to its last one; it is
    scored by comparing the two pieces letter by letter.
    """
    n = subjects.agg(F.sum(F.length("seq")).alias("db"))
    both = subjects.select("id", "seq", F.lit(True).alias("plus")).unionByName(subjects.select("id", reverse_complement(F.col("seq")).alias("seq"), F.lit(False).alias("plus")))
    sw = both.select(F.col("id").alias("s_id"), "plus", F.posexplode(kmers(F.upper("seq"), word_size)).alias("s_p", "w"))
    seeds = _words(queries, word_size, "q").join(sw, "w").withColumn("diag", F.col("s_p") - F.col("q_p"))
    w = W.partitionBy("q_id", "s_id", "plus", "diag").orderBy("q_p")
    gap = F.col("q_p") - F.coalesce(F.lag("q_p").over(w), F.col("q_p") - 10 * word_size)
    runs = seeds.withColumn("run", F.sum((gap > word_size).cast("int")).over(w)).groupBy("q_id", "s_id", "plus", "diag", "run").agg(F.min("q_p").alias("a"), (F.max("q_p") + word_size).alias("b"))
    q = queries.select(F.col("id").alias("q_id"), F.upper("seq").alias("q_seq"))
    s = both.select(F.col("id").alias("s_id"), "plus", F.upper("seq").alias("s_seq"))
    x = runs.join(q, "q_id").join(s, ["s_id", "plus"])
    length = (F.col("b") - F.col("a")).cast("int")
    piece_q = F.substring("q_seq", (F.col("a") + 1).cast("int"), length)
    piece_s = F.substring("s_seq", (F.col("a") + F.col("diag") + 1).cast("int"), length)
    same = F.aggregate(F.zip_with(F.split(piece_q, ""), F.split(piece_s, ""), lambda c, e: (c == e).cast("int")), F.lit(0), lambda t, v: t + v).cast("long")
    x = x.withColumns({"n_identical": same, "alignment_length": length.cast("long"), "n": F.length("s_seq")})
    raw = F.col("n_identical") * reward + (F.col("alignment_length") - F.col("n_identical")) * penalty
    bits = (F.lit(1.28) * raw - F.log(F.lit(0.46))) / F.log(F.lit(2.0))  # fixed values: usual constants of ungapped nucleotide search
    lo, hi = F.col("a") + F.col("diag") + 1, F.col("b") + F.col("diag")
    x = x.crossJoin(F.broadcast(n)).withColumn("bit_score", F.round(bits, 1)).withColumn("evalue", F.length("q_seq") * F.col("db") * F.pow(F.lit(2.0), -F.col("bit_score")))
    return x.where(F.col("evalue") <= expect).select(
        F.col("q_id").alias("query_acc"), F.col("s_id").alias("subject_acc"), F.concat(F.lit("lcl|"), "s_id", F.lit("|")).alias("hit_id"), F.col("s_id").alias("hit_def"),
        "n_identical", "alignment_length", F.lit(0).cast("long").alias("gap_opens"), (F.col("a") + 1).cast("long").alias("q_start"), F.col("b").cast("long").alias("q_end"),
        F.when(F.col("plus"), lo).otherwise(F.col("n") + 1 - lo).cast("long").alias("s_start"), F.when(F.col("plus"), hi).otherwise(F.col("n") + 1 - hi).cast("long").alias("s_end"),
        "evalue", "bit_score",
    )


def fetch_regions(wanted: DataFrame, records: DataFrame) -> DataFrame:
    """(accession, start, end, reverse, seq): regions of local records; the
    start is clamped to 1, and a region that runs downwards is complemented."""
    w = wanted.select("accession", F.greatest(F.least("s_start", "s_end"), F.lit(1)).alias("start"), F.greatest("s_start", "s_end").alias("end"), (F.col("s_start") > F.col("s_end")).alias("reverse"))
    x = w.join(records.select("accession", F.col("seq").alias("_whole")), "accession")
    piece = trim_residues(F.col("_whole"), F.col("start"), F.col("end"))
    x = x.withColumn("seq", F.when(F.col("reverse"), reverse_complement(piece)).otherwise(piece)).drop("_whole")
    return x.withColumn("end", F.col("start") + F.length("seq") - 1)

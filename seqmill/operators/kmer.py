"""k-mer indexes and similarities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.sequence import expand_wildcards, kmer_index, kmers
from ..runtime import spread


def kmer_counts(df: DataFrame, id_col: str, seq: str, k: int, clean: bool = True) -> DataFrame:
    """(id, kmer, n): words of the cleaned sequence, as base-4 numbers. Lower-case
    wildcards survive the cleaning and are expanded."""
    text = F.translate(seq, "RYKMSWBDHVN", "") if clean else F.col(seq)
    words = spread(df.select(F.col(id_col).alias("id"), text.alias("s"))).select("id", F.explode(kmers(F.upper("s"), k)).alias("w"))
    every = words.select("id", F.explode(F.when(F.col("w").rlike("^[ACGT]+$"), F.array("w")).otherwise(expand_wildcards(F.col("w")))).alias("w"))
    return every.select("id", kmer_index(F.col("w")).alias("kmer")).where("kmer is not null").groupBy("id", "kmer").agg(F.count(F.lit(1)).alias("n"))


def kmer_similarity(counts: DataFrame) -> DataFrame:
    """Shared words of each pair with any, over the smaller number of words.

    An equi-join on the word: pairs without a common word (similarity 0) do not
    come up, and are not emitted.
    """
    size = counts.groupBy("id").agg(F.sum("n").alias("size"))
    c = counts.join(size, "id")
    a, b = c.alias("a"), c.alias("b")
    shared = a.join(b, "kmer").where("a.id < b.id")
    value = F.sum(F.least("a.n", "b.n")) / F.least(F.min("a.size"), F.min("b.size"))
    return shared.groupBy(F.col("a.id").alias("i"), F.col("b.id").alias("j")).agg(F.round(value, 6).alias("similarity"))

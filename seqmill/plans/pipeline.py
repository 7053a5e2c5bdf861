"""Whole pipelines: iterative retrieval, extension control, data reduction."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import sequence as S
from ..operators import align, cluster, hits, msa, records, search, selection
from ..runtime import cut
from ..sources.search_xml import job_state

__all__ = ["Stages", "control_extension", "evaluate", "job_state", "reduce_dataset", "retrieve"]


@dataclass
class Stages:
    """Named stage tables in a folder. A stage that is there is read, else it is
    computed and written; so a killed run resumes, and lineage ends at a stage."""

    spark: SparkSession
    folder: str
    done: list[str] = field(default_factory=list)

    def get(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = os.path.join(self.folder, name)
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(path, "_SUCCESS"))
        fs = jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(jvm_path):
            make().write.mode("overwrite").parquet(path)
            self.done.append(name)
        return self.spark.read.parquet(path)


def retrieve(
    stages: Stages,
    queries: DataFrame,
    subjects: DataFrame,
    ok: Column,
    expected: int,
    max_length: int,
    rounds: int = 6,
    word_size: int = 11,
    n_new: int = 5,
    search_with: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Search, join, keep what is new, choose new queries, and again.

    ``queries`` and ``subjects`` are (id, seq); ``ok`` is the annotation check
    over the subject's columns. Each round is one lazy pipeline ended by a
    written stage; the driver sees only the three counters of a round. Stops
    when the total passes 1.2 * ``expected``, or after two rounds in a row with
    fewer than three good new records.
    """
    find = search_with or (lambda q, s: search.seed_hits(q, s, word_size))
    names = [c for c in subjects.columns if c not in ("id", "seq")]
    results: DataFrame | None = None
    counters: list[tuple[int, int, int]] = []
    first = records.dedup_queries(queries.select(F.col("id").alias("description"), F.col("seq").alias("sequence")).withColumn("_o", F.struct("description", "sequence")), "_o")
    first = cut(first.select(F.col("description").alias("id"), F.col("sequence").alias("seq")))
    current, used = first, first
    for n in range(1, rounds + 1):
        known = results
        q = current

        def one_round() -> DataFrame:
            info = q.select("id", F.length("seq").cast("long").alias("sequence_length"))
            best = hits.select_hits(hits.join_hits(find(q, subjects), info, max_length))
            if known is not None:
                best = hits.new_hits(best, known)
            flags = subjects.select(F.col("id").alias("subject_acc"), ok.alias("good"), *names)
            return best.join(flags, "subject_acc").withColumn("source", F.lit(n))

        new = stages.get(f"round_{n}", one_round)
        got = new.agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good")).first()
        results = new if results is None else results.unionByName(new)
        counters.append((n, got["good"], (counters[-1][2] if counters else 0) + got["n"]))
        if hits.should_stop(counters, expected) or not got["n"]:
            break
        candidates = new.where("good").join(used.select(F.col("id").alias("subject_acc")), "subject_acc", "left_anti")
        picked = stages.get(f"queries_{n + 1}", lambda c=candidates, u=used: choose_queries(c, subjects, n_new, u.select(F.col("seq").alias("sequence")), max_length))
        if picked.isEmpty():
            break
        current, used = picked, used.unionByName(picked)
    return results


def choose_queries(new: DataFrame, subjects: DataFrame, n: int, used: DataFrame, max_length: int, limit: int = 1000, seed: int = 42) -> DataFrame:
    """New queries (id, seq): the quartile band of each query's hits, a sample,
    Markov clusters of their positions, the best of each, or any one hit of a query
    that has fewer than three; of these the fit ones
    (not short, ambiguous or a sequence of ``used``), the longest of each cluster
    of their sequences, and ``n`` of those."""
    sizes = new.groupBy("query_acc").agg(F.count(F.lit(1)).alias("_n"))
    few = selection.of_group(new, sizes.where("_n < 3"), "query_acc")
    few = selection.sample_per_group(few, "query_acc", "subject_acc", 1, seed).select(F.col("subject_acc").alias("id"))
    many = selection.of_group(new, sizes.where("_n >= 3"), "query_acc").drop("_n")
    band = selection.quartile_band(many, "query_acc", "sum_hits_score")
    sample = selection.sample_per_group(band, "query_acc", "subject_acc", limit, seed)
    sample = sample.withColumn("_radius", F.greatest(0.1 * (F.col("q_end") - F.col("q_start") + 1), F.lit(1.0)))
    edges = cluster.proximity_edges(sample, "query_acc", "subject_acc", "q_start", "q_end", "_radius")
    clusters = cluster.graph_clusters(sample, edges, "query_acc", "subject_acc", limit)
    best = cluster.best_of_clusters(sample, clusters, ["query_acc", "subject_acc"]).select(F.col("subject_acc").alias("id")).union(few).distinct()
    fit = records.new_query_quality(best.join(subjects.select("id", "seq"), "id"), used, max_length).where("reason is null")
    fit = cut(fit.select(F.lit(0).alias("_g"), "id", "seq"))
    most = max(limit, fit.count())  # one graph of all queries' clusters, which are few
    longest = longest_of_clusters(fit, sequence_clusters(fit, "_g", "id", "seq", most), "_g", "id", "seq")
    return longest.orderBy(selection.hash_order("id", seed), "id").limit(n).select("id", "seq")


def sequence_clusters(seqs: DataFrame, group: str, id_col: str, seq: str, most: int = 1000) -> DataFrame:
    """(group, id, cluster): Markov clusters of close sequences. Fewer than five
    sequences of a group are each a cluster."""
    x = seqs.select(F.col(group).alias("aln_id"), F.col(id_col).alias("seq_id"), F.col(seq).alias("seq"))
    large = x.groupBy("aln_id").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 5").select("aln_id")
    aln = cut(align.align(x.join(large, "aln_id", "left_semi")))
    edges = cluster.sequence_edges(msa.p_distance(aln)).withColumnRenamed("aln_id", group)
    return cluster.graph_clusters(seqs, edges, group, id_col, most)


def longest_of_clusters(seqs: DataFrame, clusters: DataFrame, group: str, id_col: str, seq: str) -> DataFrame:
    """The sequence with the most determined bases of each cluster."""
    x = seqs.select(group, id_col, seq).join(clusters, [group, id_col])
    return records.first_rows(x, [group, "cluster"], [-S.acgt_count(F.col(seq)), F.col(id_col)])


def evaluate(recs: DataFrame, results: DataFrame, consensus: bool = True, least: int = 3) -> DataFrame:
    """Evaluation of records (accession, taxon_name, seq, ...): their score and
    round, length without wildcards, and likeness to their taxon's consensus
    (-1 where the taxon has at most ``least`` records), both without rare long
    insertions."""
    base = recs.join(results.select(F.col("subject_acc").alias("accession"), "sum_hits_score", "source"), "accession")
    base = base.withColumn("record_length", S.length_without_wildcards(F.col("seq")))
    if not consensus:
        return base.withColumn("consensus_value", F.lit(-1.0))
    large = recs.groupBy("taxon_name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).select("taxon_name")
    aln = align.align(recs.join(large, "taxon_name", "left_semi").select(F.col("taxon_name").alias("aln_id"), F.col("accession").alias("seq_id"), "seq"))
    aln = cut(msa.remove_insertions(cut(aln), 1, 20))
    con = msa.consensus_sequence(aln)
    both = aln.withColumnRenamed("seq", "a").join(con.withColumnRenamed("consensus", "b"), "aln_id")
    pairs = both.select("aln_id", F.explode(F.array(F.struct(F.col("seq_id").alias("seq_id"), F.col("a").alias("seq")), F.struct(F.concat(F.col("seq_id"), F.lit("\x1f")).alias("seq_id"), F.col("b").alias("seq")))).alias("x"), F.col("seq_id").alias("own"))
    ident = msa.pairwise_identity(pairs.select(F.concat_ws("\x1f", "aln_id", "own").alias("aln_id"), "x.seq_id", "x.seq"))
    value = ident.select(F.col("i").alias("accession"), F.col("identity").alias("consensus_value"))
    return base.join(value, "accession", "left").fillna(-1.0, subset=["consensus_value"])


def reduce_dataset(
    recs: DataFrame,
    info: DataFrame,
    results: DataFrame,
    names: DataFrame | None = None,
    consensus: bool = True,
    length_threshold: int = 0,
    has_voucher: Column | None = None,
    has_journal: Column | None = None,
    kinds: Sequence[str] = S.UNCERTAIN,
    journal_layer: bool = True,
) -> DataFrame:
    """One representative record per species.

    Names resolved and combined to species, uncertain and short records
    removed, equal (species, sequence, voucher) collapsed, then the layered
    choice. ``recs`` is (accession, seq); ``info`` has the metadata.
    """
    info = records.resolve_names(info, names) if names is not None else info
    info = records.combined_names(info.withColumn("organism", S.without_apostrophes(F.col("organism"))))
    kept = records.exceptional_filter(recs.select("accession", "seq"), info, tuple(kinds), length_threshold)
    meta = records.first_rows(info.drop("organism"), ["accession"], ["accession"])
    kept = records.remove_duplicates(kept.join(meta, "accession"), ["accession"])
    evaluated = evaluate(kept.withColumn("taxon_name", S.underscored(F.col("organism"))), results, consensus)
    ranked = selection.with_rank_sum(evaluated)
    voucher = has_voucher if has_voucher is not None else F.col("specimen_voucher").isNotNull()
    journal = has_journal if has_journal is not None else F.col("journal").isNotNull()
    return selection.representative_per_taxon(ranked, voucher, journal, "accession", consensus=consensus, journal_layer=journal_layer)


def control_extension(recs: DataFrame, original: DataFrame, genus: str = "genus", gappyness: float = 0.5, least: int = 5, parent: str | None = None) -> DataFrame:
    """Trim wrongly extended ends back to the original hit.

    ``recs``: (accession, genus, start, seq), the extended region from ``start``;
    ``original``: (accession, r_start, r_end), the hit before extension. The
    records of a genus are aligned; where the columns of an added end are more
    than ``gappyness`` gaps in the record's own row, the end is cut.

    A genus of at most ``least`` records is added to the alignment of the largest
    genus under the same ``parent`` (a column of ``recs``), else of the largest of
    all; only where no genus is large it stands alone. A record without genus is
    one by itself.
    """
    x = recs.withColumn("aln_id", F.coalesce(F.col(genus).cast("string"), F.concat(F.lit("\x1f"), "accession")))
    above = F.min(parent) if parent else F.max(F.lit(None).cast("string"))
    sizes = x.groupBy("aln_id").agg(F.count(F.lit(1)).alias("_n"), above.alias("_parent"))
    refs = selection.borrowed_reference(sizes, "_parent", "aln_id", "_n", least).select("aln_id", "_n", "reference")
    rows = cut(x.join(refs, "aln_id").select("aln_id", "_n", "reference", F.col("accession").alias("seq_id"), "seq"))
    aln = cut(align.align(rows.where(F.col("_n") > least), "long"))
    small = rows.where(F.col("_n") <= least)
    backbones = align.majority_rows(aln.join(small.select(F.col("reference").alias("aln_id")).distinct(), "aln_id", "left_semi"))
    added = align.add_groups(small, backbones)
    aln = aln.unionByName(added).withColumnRenamed("seq", "row")
    y = x.join(aln.select(F.col("seq_id").alias("accession"), "row"), "accession").join(original, "accession")
    end = F.col("start") + F.length("seq") - 1
    first, last = S.residue_span(F.col("row"))
    left, right = F.greatest(F.col("r_start") - F.col("start"), F.lit(0)), F.greatest(end - F.col("r_end"), F.lit(0))
    col_left = S.aligned_position(F.col("row"), (left + 1).cast("int")) - 1
    col_right = S.aligned_position(F.col("row"), (F.length("seq") - right).cast("int")) - 1
    gap_left = F.when(left > 0, 1 - left / (col_left - first)).otherwise(0.0)
    gap_right = F.when(right > 0, 1 - right / (last - col_right)).otherwise(0.0)
    y = y.withColumns({"cut_left": F.when(gap_left > gappyness, left).otherwise(0).cast("int"), "cut_right": F.when(gap_right > gappyness, right).otherwise(0).cast("int")})
    seq = F.substring("seq", F.col("cut_left") + 1, F.length("seq") - F.col("cut_left") - F.col("cut_right"))
    return y.select("accession", genus, (F.col("start") + F.col("cut_left")).alias("start"), seq.alias("seq"), "cut_left", "cut_right")

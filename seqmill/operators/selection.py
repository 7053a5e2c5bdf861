"""Ranks, representatives, samples and splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..runtime import broadcast_if_small, cut, is_small
from .records import first_rows


def rank_tables(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """(which, value, n, before, total): of each distinct value of each column of
    numbers its rows, those before it, and all.

    One pass for all columns and no global window: distinct values are counted,
    range-partitioned, summed within each partition, and each partition is
    shifted by the total of those before it (one number per partition).
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.col(v).cast("double").alias("value")) for i, v in enumerate(values)])).alias("x"))
    counts = long.where("x.value is not null").groupBy("x.which", "x.value").agg(F.count(F.lit(1)).alias("n"))
    parts = cut(counts.repartitionByRange("which", "value").sortWithinPartitions("which", "value")).withColumn("_p", F.spark_partition_id())
    sums = parts.groupBy("_p", "which").agg(F.sum("n").alias("_t"))
    of = W.partitionBy("which")
    sums = sums.select("_p", "which", F.coalesce(F.sum("_t").over(of.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"), F.sum("_t").over(of).alias("total"))
    inside = F.sum("n").over(W.partitionBy("_p", "which").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    # a row per partition and column, hence as small as the number of partitions
    return parts.withColumn("_b", inside).join(F.broadcast(sums), ["_p", "which"]).select("which", "value", "n", (F.col("_b") + F.col("_o")).alias("before"), "total")


def average_ranks(df: DataFrame, ranks: Mapping[str, tuple[str, bool]]) -> DataFrame:
    """Average rank of values among all rows (ties share their mean), null for a
    null: ``ranks`` has for each new column the column of numbers and whether it
    ascends. The tables of distinct values are broadcast if counted small."""
    columns = sorted({v for v, _ in ranks.values()})
    tables = cut(rank_tables(df, columns))
    small = is_small(tables)
    for name, (value, ascending) in ranks.items():
        rank = F.col("before") + (F.col("n") + 1) / F.lit(2.0)
        rank = rank if ascending else F.col("total") + 1 - rank
        one = tables.where(F.col("which") == columns.index(value)).select(F.col("value").alias("_v"), rank.alias(name))
        on = F.col(value).cast("double") == F.col("_v")
        if small:
            df = df.join(F.broadcast(one), on, "left").drop("_v")
        else:  # nulls would all meet in one task
            missing = df.where(F.col(value).isNull()).withColumn(name, F.lit(None).cast("double"))
            df = df.where(F.col(value).isNotNull()).join(one, on, "left").drop("_v").unionByName(missing)
    return df


def average_rank(df: DataFrame, value: str, name: str, ascending: bool = False) -> DataFrame:
    return average_ranks(df, {name: (value, ascending)})


def with_rank_sum(df: DataFrame) -> DataFrame:
    """Global ranks of score (desc), round (asc) and length (desc), and the sum
    of the first and last."""
    x = average_ranks(df, {"rank_sum_hits_score": ("sum_hits_score", False), "rank_source": ("source", True), "rank_record_length": ("record_length", False)})
    return x.withColumn("sum_of_rank", F.col("rank_sum_hits_score") + F.col("rank_record_length"))


def representative_ids(
    df: DataFrame, has_voucher: Column, has_journal: Column, id_col: str, taxon: str = "taxon_name", consensus: bool = True, journal_layer: bool = True
) -> DataFrame:
    """(taxon, id, sum_of_rank) of one row per taxon by layers: consensus, voucher,
    journal, latest date, rank sum, id. Each layer keeps the best or all, so the
    layers are one lexicographic order; without ``consensus`` the rank sum also
    comes first. A least-struct aggregate over the order alone, combined map-side.
    """
    value = F.when(~F.isnan("consensus_value"), F.col("consensus_value"))
    rank = F.coalesce("sum_of_rank", F.lit(float("inf")))
    order = [
        -F.coalesce(value, F.lit(-1.0)) if consensus else rank,
        ~F.coalesce(has_voucher, F.lit(False)),
        ~F.coalesce(has_journal, F.lit(False)) if journal_layer else F.lit(False),
        -F.coalesce(F.unix_date("date"), F.lit(-10_000_000)),
        rank,
    ]
    if not consensus:
        order.insert(1, -F.coalesce(value, F.lit(-1.0)))
    least = F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(id_col).alias("id"), F.col("sum_of_rank").alias("rank"))).alias("m")
    return df.where(F.col(taxon).isNotNull()).groupBy(taxon).agg(least).select(taxon, F.col("m.id").alias(id_col), F.col("m.rank").alias("sum_of_rank"))


def representative_per_taxon(df: DataFrame, has_voucher: Column, has_journal: Column, id_col: str, **how: object) -> DataFrame:
    """The rows that ``representative_ids`` names, ``id_col`` being unique."""
    ids = representative_ids(df, has_voucher, has_journal, id_col, **how).select(id_col)
    return df.join(ids, id_col, "left_semi")


def quartile_band(df: DataFrame, group: str, value: str) -> DataFrame:
    """Rows within the first and third quartile of their group, both included."""
    q = df.groupBy(group).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    return of_group(df, q, group).where(F.col(value).between(F.col("_q")[0], F.col("_q")[1])).drop("_q")


def longest_per_group(df: DataFrame, group: str, seq: str, order: str) -> DataFrame:
    """Longest sequence of each group; the first of equals."""
    return first_rows(df, [group], [-F.length(seq), F.col(order)])


def hash_order(id_col: str, seed: int = 42) -> Column:
    """A repeatable random order."""
    return F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))


def sample_per_group(df: DataFrame, group: str, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows of each group, without replacement, always the same."""
    w = W.partitionBy(group).orderBy(hash_order(id_col, seed), id_col)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def of_group(df: DataFrame, facts: DataFrame, group: str) -> DataFrame:
    """``df`` with the facts of each row's group, one row a group, null being a
    group too; broadcast if counted small, so a hot group stays spread."""
    key = facts.withColumnRenamed(group, "_group")
    return df.join(broadcast_if_small(key), F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def backbone_tiers(df: DataFrame, group: str, seq: str, order: str, n: int = 100) -> DataFrame:
    """``tier`` of each row: the ``n`` longest are ``long``; others are
    ``fragment`` below half of the n-th length, else ``add``. Equal lengths are
    told apart by ``order``, which is unique in a group."""
    key = [F.col(group).alias("_g"), F.length(seq).alias("_length"), F.col(order).alias("_order")]
    # the filter on the row number is planned as a limit per group before the shuffle
    top = df.select(*key).withColumn("_r", F.row_number().over(W.partitionBy("_g").orderBy(F.desc("_length"), "_order"))).where(F.col("_r") <= n)
    last = top.groupBy(F.col("_g").alias(group)).agg(F.max(F.struct((-F.col("_length")).alias("neg"), F.col("_order").alias("last"))).alias("_m"))
    x = of_group(df, last.select(group, (-F.col("_m.neg")).alias("_last"), F.col("_m.last").alias("_order")), group)
    n_seq = F.length(seq)
    long = (n_seq > F.col("_last")) | ((n_seq == F.col("_last")) & (F.col(order) <= F.col("_order")))
    return x.withColumn("tier", F.when(long, "long").when(n_seq < F.col("_last") / 2, "fragment").otherwise("add")).drop("_last", "_order")


def positions(df: DataFrame, group: str, order: str) -> DataFrame:
    """``_pos`` (from 0) of each row in its group and the group's size ``_n``.

    The rows are range-partitioned by group and order, numbered within each
    partition, and shifted by the group's rows in those before: a group with most
    rows is spread over many tasks.
    """
    parts = cut(df.repartitionByRange(F.col(group), F.col(order)).sortWithinPartitions(group, order)).withColumn("_p", F.spark_partition_id())
    counts = parts.groupBy("_p", F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_c"))
    of = W.partitionBy("_g")
    counts = counts.select(F.col("_p").alias("_q"), "_g", F.coalesce(F.sum("_c").over(of.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"), F.sum("_c").over(of).alias("_n"))
    inside = F.row_number().over(W.partitionBy("_p", group).orderBy(order)) - 1
    x = parts.withColumn("_i", inside).join(broadcast_if_small(counts), (F.col("_p") == F.col("_q")) & F.col(group).eqNullSafe(F.col("_g")))
    return x.withColumn("_pos", F.col("_i") + F.col("_o")).drop("_p", "_q", "_g", "_i", "_o")


def chunks(df: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """Near-equal parts of at most ``most`` rows per group, none dropped."""
    parts = F.ceil(F.col("_n") / most)
    return positions(df, group, order).withColumn("chunk", F.floor(F.col("_pos") * parts / F.col("_n")).cast("int")).drop("_n", "_pos")


def length_ratio_split(df: DataFrame, group: str, seq: str, ratio: float = 0.6) -> DataFrame:
    """``is_short``: shorter than ``ratio`` of the group's longest."""
    longest = df.groupBy(group).agg(F.max(F.length(seq)).alias("_m"))
    return of_group(df, longest, group).withColumn("is_short", F.length(seq) < ratio * F.col("_m")).drop("_m")


def length_clusters(df: DataFrame, group: str, seq: str, k: int) -> DataFrame:
    """Single-linkage clusters of lengths: cut at the k-1 widest gaps.

    Distinct lengths of a group are few, so the windows run over those.
    """
    lengths = df.select(group, F.length(seq).alias("length")).distinct()
    w = W.partitionBy(group).orderBy("length")
    gaps = lengths.withColumn("_g", F.col("length") - F.lag("length").over(w))
    gaps = gaps.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(F.desc_nulls_last("_g"), F.desc("length"))))
    starts = F.sum((F.col("_g").isNotNull() & (F.col("_r") < k)).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("length", F.length(seq)).join(gaps.withColumn("cluster", starts.cast("int")).select(group, "length", "cluster"), [group, "length"])


def cluster_means(clustered: DataFrame, group: str) -> DataFrame:
    return clustered.groupBy(group, "cluster").agg(F.round(F.avg("length"), 6).alias("mean_length"), F.count(F.lit(1)).alias("n"))


def borrowed_reference(groups: DataFrame, parent: str, name: str, size: str, least: int = 5) -> DataFrame:
    """For each group of at most ``least``: the largest group under the same
    parent, else the largest of all."""
    best = F.max_by(name, F.struct(F.col(size), F.col(name)))
    large = groups.where(F.col(size) > least)
    near = large.groupBy(parent).agg(best.alias("_near"))
    far = large.agg(best.alias("_far"))
    return groups.join(near, parent, "left").crossJoin(F.broadcast(far)).withColumn("reference", F.when(F.col(size) > least, F.col(name)).otherwise(F.coalesce("_near", "_far"))).drop("_near", "_far")

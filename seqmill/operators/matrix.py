"""Completing and concatenating markers into a supermatrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..runtime import broadcast_if_small


def combine_markers(kept: DataFrame, markers: list[str], taxon: str = "taxon_name", marker: str = "marker", value: str = "record_id") -> DataFrame:
    """One row per taxon, one column per marker, ``-`` where there is none."""
    wide = kept.groupBy(taxon).pivot(marker, markers).agg(F.min(value))
    return wide.fillna("-", subset=markers)


def marker_lengths(aln: DataFrame) -> DataFrame:
    """Length of each marker: 0 if empty, -1 if its rows differ."""
    n = F.count_distinct(F.length("seq"))
    return aln.groupBy("marker").agg(F.when(n == 1, F.max(F.length("seq"))).when(F.max(F.length("seq")).isNull(), 0).otherwise(-1).cast("long").alias("length"))


def missing_taxa(aln: DataFrame) -> DataFrame:
    """(taxon, marker) pairs that have no row.

    Markers are few (their number is bounded by the project's marker set), so
    the product is with a handful of rows.
    """
    taxa, markers = aln.select("taxon").distinct(), aln.groupBy().agg(F.array_sort(F.collect_set("marker")).alias("m"))
    have = aln.groupBy("taxon").agg(F.collect_set("marker").alias("have"))
    return taxa.join(have, "taxon").crossJoin(F.broadcast(markers)).select("taxon", F.explode(F.array_except("m", "have")).alias("marker"))


def complete_taxa(aln: DataFrame) -> DataFrame:
    """Every taxon in every marker: gaps of its length where missing, ``---``
    for a marker of mixed lengths; empty markers drop."""
    size = broadcast_if_small(marker_lengths(aln).where("length <> 0"))
    fill = F.when(F.col("length") > 0, F.repeat(F.lit("-"), F.col("length").cast("int"))).otherwise("---")
    added = missing_taxa(aln).join(size, "marker").select("marker", "taxon", fill.alias("seq"))
    return aln.join(size.select("marker"), "marker", "left_semi").select("marker", "taxon", "seq").unionByName(added)


def partition_ranges(aln: DataFrame) -> DataFrame:
    """Columns, from 1, of each marker in the concatenation, by marker name."""
    upto = F.sum("length").over(W.orderBy("marker").rowsBetween(W.unboundedPreceding, 0))  # a row per marker
    return marker_lengths(aln).where("length > 0").select("marker", (upto - F.col("length") + 1).alias("start_col"), upto.alias("end_col"))


def supermatrix(aln: DataFrame) -> DataFrame:
    """Concatenated sequence of each taxon over all markers by name.

    Markers of mixed lengths or with another set of taxa than the rest give no
    matrix (an empty result).
    """
    markers = aln.groupBy("marker").agg(F.count_distinct(F.length("seq")).alias("n_len"), F.count_distinct("taxon").alias("n_taxa"), F.count(F.lit(1)).alias("n"))
    total = aln.agg(F.count_distinct("taxon").alias("all_taxa"))
    bad = markers.crossJoin(F.broadcast(total)).where("n_len <> 1 or n_taxa <> all_taxa or n <> n_taxa").agg(F.count(F.lit(1)).alias("bad"))
    parts = F.array_sort(F.collect_list(F.struct("marker", "seq")))
    rows = aln.groupBy("taxon").agg(F.array_join(F.transform(parts, lambda x: x["seq"]), "").alias("seq"))
    return rows.crossJoin(F.broadcast(bad)).where("bad = 0").drop("bad")


def codon_partitions(ranges: DataFrame) -> DataFrame:
    """Three codon positions of each marker's range."""
    at = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("p")
    x = ranges.select("marker", "start_col", "end_col", at)
    return x.select((F.concat_ws("_", "marker", (F.col("p") + 1).cast("string"))).alias("name"), (F.col("start_col") + F.col("p")).alias("start_col"), "end_col", F.lit(3).alias("step"))

"""Record-level filters, de-duplication and lookups."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.sequence import UNCERTAIN, acgt_count, combine_species, is_uncertain
from ..runtime import cut


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each combination of ``keys`` (nulls are one group).

    A least-struct aggregate: combined map-side, so one key with most rows
    costs no task more than others, unlike a ranking window.
    """
    cols = [c for c in df.columns if c not in keys]
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    first = F.min_by(F.struct(*cols) if cols else F.lit(1), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("_first")
    out = df.groupBy(*keys).agg(first)
    return out.select(*[f"_first.{c}" if c in cols else c for c in df.columns])


def duplicated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def exceptional_filter(
    records: DataFrame, info: DataFrame, kinds: tuple[str, ...] = UNCERTAIN, length_threshold: int = 0, ignore_gap: bool = True, accession: str = "accession"
) -> DataFrame:
    """Drop records of uncertain species, short ones, and those whose accession
    does not match exactly one row of ``info``; null organisms go too."""
    single = info.where(F.col(accession).isNotNull()).groupBy(accession).agg(F.count(F.lit(1)).alias("n"), F.first("organism").alias("organism")).where("n = 1")
    seq = F.replace("seq", F.lit("-"), F.lit("")) if ignore_gap else F.col("seq")
    return (
        records.where(F.length(seq) >= length_threshold)
        .join(single.drop("n"), accession)
        .where(F.col("organism").isNotNull() & ~is_uncertain(F.col("organism"), kinds))
    )


def remove_duplicates(records: DataFrame, order: Sequence[str]) -> DataFrame:
    """First of each (organism, sequence, voucher)."""
    return first_rows(records, ["organism", "seq", "specimen_voucher"], order)


def new_query_quality(candidates: DataFrame, used: DataFrame, max_length: int, least_share: float = 0.2, least_clean: float = 0.995) -> DataFrame:
    """Candidates for new queries with ``reason``: ``short``, ``ambiguous``,
    ``duplicate`` of a used sequence, or null if fit."""
    n = acgt_count(F.col("seq"))
    used = used.select(F.col("sequence").alias("seq")).distinct().withColumn("_used", F.lit(True))
    x = candidates.join(used, "seq", "left")
    reason = (
        F.when(n < least_share * max_length, "short").when(n < least_clean * F.length("seq"), "ambiguous").when(F.col("_used"), "duplicate")
    )
    return x.withColumn("reason", reason).drop("_used")


def dedup_queries(queries: DataFrame, order: str) -> DataFrame:
    """Drop a query whose description or sequence an earlier kept one has.

    The one-pass rule of ``dedup_queries_exact`` in rounds: open rows that are
    the first by both columns are kept, all that share a column with one are
    dropped, until none is open. A round more is needed only where a dropped row
    stood before a third. Nulls are equal.
    """
    rows = cut(queries.withColumn("_n", F.monotonically_increasing_id()))
    left = rows.select("_n", "description", "sequence", F.struct(F.col(order).alias("a"), F.col("description").alias("b"), F.col("sequence").alias("c"), "_n").alias("_o"))
    kept: DataFrame | None = None
    while True:
        first = left
        for c in ("description", "sequence"):
            least = left.groupBy(F.col(c).alias("_k")).agg(F.min("_o").alias("_f"))
            first = first.join(least, F.col(c).eqNullSafe(F.col("_k"))).where(F.col("_o") == F.col("_f")).drop("_k", "_f")
        first = cut(first)
        kept = first if kept is None else kept.unionByName(first)
        for c in ("description", "sequence"):
            left = left.join(first.select(F.col(c).alias("_k")), F.col(c).eqNullSafe(F.col("_k")), "left_anti")
        left = cut(left)
        if left.isEmpty():
            return rows.join(kept.select("_n"), "_n", "left_semi").drop("_n")


def dedup_queries_exact(rows: Sequence[tuple[str, str]]) -> list[int]:
    """Indexes kept by the one-pass rule over (description, sequence)."""
    names, seqs, kept = set(), set(), []
    for i, (name, seq) in enumerate(rows):
        if name not in names and seq not in seqs:
            kept.append(i)
            names.add(name)
            seqs.add(seq)
    return kept


def resolve_names(info: DataFrame, names: DataFrame) -> DataFrame:
    """Accepted names from a table (organism, accepted); the written name is
    kept as ``organism_ori``."""
    return (
        info.join(names.dropDuplicates(["organism"]), "organism", "left")
        .withColumnRenamed("organism", "organism_ori")
        .withColumn("organism", F.coalesce("accepted", "organism_ori"))
        .drop("accepted")
    )


def combined_names(info: DataFrame, **ranks: bool) -> DataFrame:
    """Records with their organism combined to species; null organisms drop."""
    return info.where(F.col("organism").isNotNull()).withColumn("organism", combine_species(F.col("organism"), **ranks))


def search_term(organisms: Sequence[str], qualifier: str = "", since: str | None = None, until: str | None = None) -> str:
    """Text query: any of the organisms, the qualifier, a span of dates. A
    qualifier that begins with NOT or OR is appended as it is."""
    term = " OR ".join(f"{o}[Organism]" for o in organisms)
    term = f"({term})" if term else ""
    q = qualifier.strip()
    if q:
        term = f"{term} {q}" if q.upper().startswith(("NOT ", "OR ")) else (f"{term} AND ({q})" if term else f"({q})")
    if since or until:
        span = f'("{since or "1900/01/01"}"[Publication Date] : "{until or dt.date.today().isoformat()}"[Publication Date])'
        term = f"{term} AND {span}" if term else span
    return term


def record_predicate(organisms: Sequence[str] = (), pattern: str | None = None, since: str | None = None, until: str | None = None, date: Column | None = None, path: Column | None = None) -> Column:
    """The same as a filter: lineage (``path``, else ``taxonomy`` cut at its
    bars) holds one of the organisms, the title matches ``pattern``, the date lies
    within the span."""
    ok = F.lit(True)
    if organisms:
        ok = ok & F.arrays_overlap(path if path is not None else F.split("taxonomy", r"\|"), F.array(*[F.lit(o) for o in organisms]))
    if pattern:
        ok = ok & F.col("title").rlike(pattern)
    if since and date is not None:
        ok = ok & (date >= F.lit(since).cast("date"))
    if until and date is not None:
        ok = ok & (date <= F.lit(until).cast("date"))
    return ok


def marker_counts(records: DataFrame, markers: Mapping[str, str], text: str = "description") -> DataFrame:
    """Records per marker, ``markers`` being a pattern for each of a project's few
    markers: one pass over the records, each giving the markers it matches."""
    hits = F.array(*[F.when(F.col(text).rlike(p), m) for m, p in sorted(markers.items())])
    return records.select(F.explode(F.array_compact(hits)).alias("marker")).groupBy("marker").agg(F.count(F.lit(1)).alias("n_records"))


def not_yet_fetched(wanted: DataFrame, good: DataFrame, bad: DataFrame, key: str = "accession") -> DataFrame:
    return wanted.join(good.select(key), key, "left_anti").join(bad.select(key), key, "left_anti")


def longest_share(df: DataFrame, group: str, ratio: float = 0.7, seq: str = "seq") -> DataFrame:
    """Rows longer than ``ratio`` of their group's longest."""
    longest = df.groupBy(group).agg(F.max(F.length(seq)).alias("_max"))
    return df.join(longest, group).where(F.length(seq) > ratio * F.col("_max")).drop("_max")


def ranked(df: DataFrame, partition: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """First ``n`` rows per group (plans a group limit before the shuffle)."""
    w = W.partitionBy(*partition).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")

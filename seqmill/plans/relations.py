"""Relations that several queries share, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..iupac import BASES
from ..runtime import broadcast_if_small, table


#: How the rows of the test alignments differ, by the last figure of their id: the
#: same expressions in Spark and in DuckDB over ``s``, a sequence filled with gaps.
_DISTURBED = """CASE CAST(right(seq_id, 1) AS INTEGER)
  WHEN 1 THEN repeat('-', 9) || substr(s, 10)
  WHEN 2 THEN substr(s, 1, 30) || repeat('-', 24) || substr(s, 55)
  WHEN 3 THEN substr(s, 1, 14) || 'N' || substr(s, 16, 5) || 'RY' || substr(s, 23, 7) || '-' || substr(s, 31)
  WHEN 4 THEN substr(s, 1, 39) || lower(substr(s, 40, 4)) || substr(s, 44)
  WHEN 5 THEN repeat('-', 3) || substr(s, 4, 16) || '--' || substr(s, 22, 38) || 'B' || substr(s, 61)
  WHEN 6 THEN substr(s, 1, 30) || repeat('-', 24) || 'N' || substr(s, 56) ELSE s END"""


def job_alignments(spark: SparkSession, d: str, near: bool = False) -> DataFrame:
    """One alignment per query: its jobs' sequences, filled with gaps to the longest,
    with gaps at the beginning and inside, wildcards and small letters in some rows.
    ``near``: the widths are sent to the rows if they are counted few, instead of
    shuffling the rows."""
    jobs = table(spark, d, "search_jobs").where("query is not null and sequence is not null").select(F.col("query").alias("aln_id"), F.col("id").alias("seq_id"), "sequence")
    size = jobs.groupBy("aln_id").agg(F.max(F.length("sequence")).alias("w"))
    size = broadcast_if_small(size) if near else size
    whole = jobs.join(size, "aln_id").select("aln_id", "seq_id", F.rpad("sequence", F.col("w"), F.lit("-")).alias("s"))
    return whole.select("aln_id", "seq_id", F.expr(_DISTURBED).alias("seq"))


JOB_ALIGNMENTS = f"""filled AS (
  SELECT query AS aln_id, id AS seq_id, rpad(sequence, CAST(max(length(sequence)) OVER (PARTITION BY query) AS INTEGER), '-') AS s
  FROM search_jobs WHERE query IS NOT NULL AND sequence IS NOT NULL),
aln AS (SELECT aln_id, seq_id, {_DISTURBED} AS seq FROM filled)"""
CELLS = JOB_ALIGNMENTS + """,
cells AS (SELECT aln_id, seq_id, unnest(range(1, length(seq) + 1)) AS col, unnest(string_split(seq, '')) AS base FROM aln)"""
GAPS = CELLS + """,
gaps AS (SELECT aln_id, col, count(*) FILTER (base = '-') AS gaps, count(*) AS n_seqs FROM cells GROUP BY ALL)"""
PAIRS = JOB_ALIGNMENTS + """,
pairs AS (SELECT a.aln_id, a.seq_id AS i, b.seq_id AS j, a.seq AS a, b.seq AS b FROM aln a JOIN aln b ON a.aln_id = b.aln_id AND a.seq_id < b.seq_id),
pc AS (SELECT aln_id, i, j, unnest(range(1, length(a) + 1)) AS col, unnest(string_split(a, '')) AS x, unnest(string_split(b, '')) AS y FROM pairs)"""
#: Bases of the nucleotide codes, and the chance that two codes mean the same base.
CODES = "codes(code, b, t) AS (VALUES " + ", ".join(f"('{c}', '{b}', {12 // len(bases)})" for c, bases in BASES.items() for b in bases) + ")"
SCORES = CODES + """,
scores AS (SELECT a.code AS x, b.code AS y, count(*) * any_value(a.t) * any_value(b.t) / 144.0 AS score FROM codes a JOIN codes b ON a.b = b.b GROUP BY ALL)"""


def marker_alignments(spark: SparkSession, d: str) -> DataFrame:
    """(marker, taxon, seq): longest seed query of each taxon and marker, filled
    with gaps to the marker's longest."""
    q = table(spark, d, "query_info")
    x = q.select(
        "id", F.regexp_extract("description", r"(\S+), seed query$", 1).alias("marker"), F.regexp_extract("description", r"^\S+ (\S+ \S+) ", 1).alias("taxon"), "sequence"
    ).where("marker <> ''")
    best = x.groupBy("marker", "taxon").agg(F.max_by("sequence", F.struct(F.length("sequence"), F.col("id"))).alias("seq"))
    size = best.groupBy("marker").agg(F.max(F.length("seq")).alias("w"))
    return best.join(broadcast_if_small(size), "marker").select("marker", "taxon", F.rpad("seq", F.col("w"), F.lit("-")).alias("seq"))


MARKERS = r"""m0 AS (
  SELECT id, regexp_extract(description, '(\S+), seed query$', 1) AS marker, regexp_extract(description, '^\S+ (\S+ \S+) ', 1) AS taxon, sequence FROM query_info),
m1 AS (SELECT marker, taxon, arg_max(sequence, {'l': length(sequence), 'i': id}) AS seq FROM m0 WHERE marker <> '' GROUP BY ALL),
aln AS (SELECT marker, taxon, rpad(seq, CAST(max(length(seq)) OVER (PARTITION BY marker) AS INTEGER), '-') AS seq FROM m1)"""

"""Queries over alignments, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import sequence as S
from ..operators import align, msa, trim
from ..runtime import cut, table
from ..sources import alignments as A
from .relations import CELLS, CODES, GAPS, JOB_ALIGNMENTS, PAIRS, SCORES, job_alignments


def _on(f, *args: object, **kw: object):
    return lambda spark, d: f(job_alignments(spark, d), *args, **kw)


def column_gaps(spark: SparkSession, d: str) -> DataFrame:
    return msa.column_gaps(job_alignments(spark, d)).select("aln_id", "col", "gaps", "n_seqs")


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def pairwise_identity(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(msa.pairwise_identity(job_alignments(spark, d)), "identity")


def identity_of_shared_span(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(msa.pairwise_identity(job_alignments(spark, d), ends="shared"), "identity")


def p_distance(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(msa.p_distance(job_alignments(spark, d)), "p_distance")


def determined_identity(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(msa.determined_identity(job_alignments(spark, d)), "identity", "distance_pct")


def residue_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return msa.with_ordinals(job_alignments(spark, d)).where("base <> '-'").groupBy("aln_id", "seq_id").agg(F.max("ordinal").alias("n_residues"), F.sum("ordinal").alias("checksum"))


def trimmed_lengths(how: trim.Trim):
    return lambda spark, d: trim.trim(job_alignments(spark, d), how).select("aln_id", "seq_id", "seq")


def aligned_jobs(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "search_jobs").where("query is not null and sequence is not null").select(F.col("query").alias("aln_id"), F.col("id").alias("seq_id"), F.col("sequence").alias("seq"))
    aln = cut(align.align(jobs))
    width = aln.groupBy("aln_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.length("seq")).alias("n_lengths"))
    return aln.join(width, "aln_id").select("aln_id", "seq_id", F.replace("seq", F.lit("-"), F.lit("")).alias("residues"), "n", "n_lengths")


def _two_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Each job alignment in two forms: gaps at the end, and at the beginning."""
    left = F.lpad(F.replace("seq", F.lit("-"), F.lit("")), F.length("seq"), F.lit("-"))
    forms = F.array(F.struct(F.lit("right").alias("aln_id"), F.col("seq").alias("seq")), F.struct(F.lit("left").alias("aln_id"), left.alias("seq")))
    return job_alignments(spark, d, near=True).select(F.col("aln_id").alias("set_id"), "seq_id", F.inline(forms)).select("set_id", "aln_id", "seq_id", "seq")


def consensus_per_taxon(spark: SparkSession, d: str) -> DataFrame:
    """Consensus of every query with more than three jobs, after alignment and
    without rare long insertions."""
    jobs = table(spark, d, "search_jobs").where("query is not null and sequence is not null").select(F.col("query").alias("aln_id"), F.col("id").alias("seq_id"), F.col("sequence").alias("seq"))
    large = jobs.groupBy("aln_id").agg(F.count(F.lit(1)).alias("n")).where("n > 3").select("aln_id")
    aln = cut(align.align(jobs.join(large, "aln_id", "left_semi")))
    return msa.consensus_sequence(msa.remove_insertions(aln, 1, 20))


def trim_consistency(spark: SparkSession, d: str) -> DataFrame:
    return trim.trim_by_consistency(_two_alignments(spark, d), trim.Trim("threshold", consistency=0.5))


def align_rounds(spark: SparkSession, d: str) -> DataFrame:
    """The jobs of each query in three rounds, by the last figure of their id."""
    jobs = table(spark, d, "search_jobs").where("query is not null and sequence is not null").select(F.col("query").alias("aln_id"), F.col("id").alias("seq_id"), F.col("sequence").alias("seq"))
    turn = F.right("seq_id", F.lit(1)).cast("int") % 3
    aln = align.add_rounds([jobs.where(turn == k) for k in range(3)])
    width = aln.groupBy("aln_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.length("seq")).alias("n_lengths"))
    return aln.join(width, "aln_id").select("aln_id", "seq_id", F.replace("seq", F.lit("-"), F.lit("")).alias("residues"), "n", "n_lengths")


def segment_coverage(spark: SparkSession, d: str) -> DataFrame:
    return job_alignments(spark, d).select("aln_id", "seq_id", S.covers(F.col("seq"), F.lit(20), F.lit(70)).alias("covered"))


def alignment_formats(spark: SparkSession, d: str) -> DataFrame:
    """Every alignment written in every format and read again."""
    aln = job_alignments(spark, d)
    out: DataFrame | None = None
    for form in A.FORMATS:
        part = A.parsed(A.written(aln, form)).withColumn("format", F.lit(form))
        out = part if out is None else out.unionByName(part)
    return out


def gap_distribution(spark: SparkSession, d: str) -> DataFrame:
    return trim.value_distribution(column_gaps(spark, d), "gaps").select("aln_id", "gaps", "n_columns", "n_upto", "share")


QUERIES = {
    "consensus_per_taxon": consensus_per_taxon,
    "trim_consistency": trim_consistency,
    "align_rounds": align_rounds,
    "segment_coverage": segment_coverage,
    "alignment_formats": alignment_formats,
    "gap_distribution": gap_distribution,
    "check_alignment": _on(msa.check_alignment),
    "column_gaps": column_gaps,
    "gap_histogram": _on(msa.gap_histogram),
    "windowed_gaps": _on(msa.windowed_gaps, 2),
    "consensus_columns": _on(msa.consensus_columns),
    "consensus_sequence": _on(msa.consensus_sequence),
    "p_distance": p_distance,
    "pairwise_identity": pairwise_identity,
    "identity_of_shared_span": identity_of_shared_span,
    "mean_identity": _on(msa.mean_identity),
    "determined_identity": determined_identity,
    "identity_summary": _on(msa.identity_summary),
    "sum_of_pairs": _on(msa.sum_of_pairs),
    "overlap_values": _on(msa.overlap_values, 0.5),
    "common_ends": _on(msa.common_ends),
    "insertion_islands": _on(msa.insertion_islands, 1, 20),
    "remove_insertions": _on(msa.remove_insertions, 1, 20),
    "residue_ordinals": residue_ordinals,
    "column_similarity": _on(trim.column_similarity),
    "trim_nogaps": trimmed_lengths(trim.Trim("nogaps")),
    "trim_noallgaps": trimmed_lengths(trim.Trim("noallgaps")),
    "trim_gap_threshold": trimmed_lengths(trim.Trim("threshold", gap=0.7)),
    "trim_gap_keep": trimmed_lengths(trim.Trim("threshold", gap=0.9, keep=60)),
    "trim_similarity": trimmed_lengths(trim.Trim("threshold", similarity=0.5)),
    "trim_gap_similarity": trimmed_lengths(trim.Trim("threshold", gap=0.7, similarity=0.3)),
    "trim_windowed": trimmed_lengths(trim.Trim("threshold", gap=0.7, gap_window=2)),
    "trim_gappyout": trimmed_lengths(trim.Trim("gappyout")),
    "trim_strict": trimmed_lengths(trim.Trim("strict")),
    "trim_strictplus": trimmed_lengths(trim.Trim("strictplus")),
    "trim_automated1": trimmed_lengths(trim.Trim("automated1")),
    "trim_overlap": trimmed_lengths(trim.Trim("overlap", residue_overlap=0.5, sequence_overlap=60)),
    "trim_select": trimmed_lengths(trim.Trim("select", columns=((0, 4), (10, 10)))),
    "trim_complementary": trimmed_lengths(trim.Trim("nogaps", complementary=True)),
    "trim_column_map": _on(trim.column_map, trim.Trim("nogaps")),
    "align": aligned_jobs,
    "consistency": lambda spark, d: msa.consistency(_two_alignments(spark, d)),
    "most_consistent": lambda spark, d: msa.most_consistent(_two_alignments(spark, d)),
    "shared_columns": lambda spark, d: msa.shared_columns(_two_alignments(spark, d)),
}

_TRIMMED = "SELECT aln_id, seq_id, string_agg(base, '' ORDER BY col) AS seq FROM cells JOIN gaps USING (aln_id, col) WHERE {0} GROUP BY 1, 2 HAVING count(*) FILTER (base <> '-') > 0"
_VOTES = CELLS + f""", {CODES},
body AS (SELECT aln_id, seq_id, col, translate(upper(base), 'U', 'T') AS base, max(col) FILTER (base <> '-') OVER (PARTITION BY aln_id, seq_id) AS last, min(col) FILTER (base <> '-') OVER (PARTITION BY aln_id, seq_id) AS first FROM cells),
v AS (SELECT aln_id, col, coalesce(sum(codes.t) FILTER (b = 'A'), 0) AS a, coalesce(sum(codes.t) FILTER (b = 'C'), 0) AS c, coalesce(sum(codes.t) FILTER (b = 'G'), 0) AS g, coalesce(sum(codes.t) FILTER (b = 'T'), 0) AS t,
  12 * count(*) FILTER (base = '-' AND col BETWEEN first AND last) AS gap FROM body LEFT JOIN codes ON base = code GROUP BY ALL),""" + """
w AS (SELECT *, greatest(a, c, g, t, gap) AS top FROM v),
b AS (SELECT *, CASE WHEN a = top THEN 'A' ELSE '' END || CASE WHEN c = top THEN 'C' ELSE '' END || CASE WHEN g = top THEN 'G' ELSE '' END || CASE WHEN t = top THEN 'T' ELSE '' END AS s FROM w),
con AS (SELECT aln_id, col, CASE WHEN top = 0 THEN 'N' WHEN gap = top AND s <> '' THEN 'N' WHEN gap = top THEN '-' ELSE
  CASE s WHEN 'AG' THEN 'R' WHEN 'CT' THEN 'Y' WHEN 'GT' THEN 'K' WHEN 'AC' THEN 'M' WHEN 'CG' THEN 'S' WHEN 'AT' THEN 'W' WHEN 'CGT' THEN 'B' WHEN 'AGT' THEN 'D' WHEN 'ACT' THEN 'H'
  WHEN 'ACG' THEN 'V' WHEN 'ACGT' THEN 'N' ELSE s END END AS consensus FROM b)"""
_IDENT = PAIRS + f""", {SCORES},
id AS (SELECT aln_id, i, j, coalesce(sum(score) / nullif(count(*) FILTER (pc.x <> '-' OR pc.y <> '-'), 0), 0) AS v
  FROM pc LEFT JOIN scores ON scores.x = upper(pc.x) AND scores.y = upper(pc.y) GROUP BY ALL)"""
_DET = PAIRS + """,
det AS (SELECT aln_id, i, j, count(*) FILTER (x = y AND x NOT IN ('-', 'N')) / nullif(count(*) FILTER (x NOT IN ('-', 'N') OR y NOT IN ('-', 'N')), 0) AS v FROM pc GROUP BY ALL)"""
_OVERLAP = CELLS + """,
part AS (SELECT *, count(*) FILTER (base = '-') OVER w AS g, count(*) FILTER (base = 'N') OVER w AS x, count(*) OVER w AS n FROM cells WINDOW w AS (PARTITION BY aln_id, col)),
ov AS (SELECT aln_id, seq_id, count(*) FILTER (CASE base WHEN '-' THEN g - 1 WHEN 'N' THEN x - 1 ELSE n - g - x - 1 END >= ceil(0.5 * (n - 1))) / count(*) AS overlap FROM part GROUP BY 1, 2)"""
# the slope over two steps of the histogram of gaps against that two steps (at the second: one step) before
_SLOPE = GAPS + """,
hist AS (SELECT aln_id, gaps AS q, count(*) AS h, any_value(n_seqs) AS n, sum(count(*)) OVER (PARTITION BY aln_id) AS len FROM gaps GROUP BY 1, 2),
steps AS (SELECT aln_id, q, h, n, len, lag(q, 2) OVER k AS p, lag(h) OVER k AS hq, row_number() OVER k AS k FROM hist WINDOW k AS (PARTITION BY aln_id ORDER BY q)),
slopes AS (SELECT aln_id, p, k, CAST((q - p) / n AS FLOAT) / CAST((h + hq) / len AS FLOAT) AS s FROM steps WHERE p IS NOT NULL),
ratios AS (SELECT aln_id, p, s / CASE WHEN k > 4 THEN lag(s, 2) OVER z ELSE lag(s) OVER z END AS ratio FROM slopes WINDOW z AS (PARTITION BY aln_id ORDER BY k)),
slope AS (SELECT a.aln_id, coalesce(arg_max(p, {'r': ratio, 'p': -p}), 0) AS cut FROM (SELECT DISTINCT aln_id FROM gaps) a LEFT JOIN (SELECT * FROM ratios WHERE ratio IS NOT NULL) r ON a.aln_id = r.aln_id GROUP BY 1)"""
_SIMILARITY = PAIRS + """,
known AS (SELECT aln_id, i, j, col, x, y, x NOT IN ('-', 'N') AS kx, y NOT IN ('-', 'N') AS ky FROM pc),
weights AS (SELECT aln_id, i, j, CAST(CASE WHEN count(*) FILTER (kx OR ky) > 0 THEN 100 - 100 * count(*) FILTER (kx AND x = y) / count(*) FILTER (kx OR ky) ELSE 0 END AS FLOAT) AS w FROM known GROUP BY ALL),
dist AS (SELECT aln_id, col, sum(w * CASE WHEN x <> y AND contains('ACGT', x) AND contains('ACGT', y) THEN CAST(sqrt(CASE WHEN x = 'T' OR y = 'T' THEN 3.0 ELSE 2.0 END) AS FLOAT)::DOUBLE ELSE 0 END) FILTER (kx AND ky) AS num, sum(w::DOUBLE) FILTER (kx AND ky) AS den
  FROM known JOIN weights USING (aln_id, i, j) GROUP BY ALL),
cells AS (SELECT aln_id, seq_id, unnest(range(1, length(seq) + 1)) AS col, unnest(string_split(seq, '')) AS base FROM aln),
gaps AS (SELECT aln_id, col, count(*) FILTER (base = '-') AS gaps, count(*) AS n_seqs FROM cells GROUP BY ALL),
sim AS (SELECT aln_id, col, CASE WHEN CAST(gaps / n_seqs AS FLOAT) >= 0.8::FLOAT THEN 0::FLOAT ELSE CAST(least(exp(-coalesce(num / nullif(den, 0), 0)), 1) AS FLOAT) END AS similarity FROM gaps LEFT JOIN dist USING (aln_id, col))"""
# strict: below both cuts, then in order every column with three of four kept neighbours, then blocks long enough
_STRICT = _SIMILARITY + _SLOPE[len(GAPS) :] + """,
cutoff AS (SELECT aln_id, col, gaps, cut, similarity AS v FROM gaps JOIN sim USING (aln_id, col) JOIN slope USING (aln_id)),
tops AS (SELECT aln_id, v, CAST(row_number() OVER k AS FLOAT) / CAST(count(*) OVER (PARTITION BY aln_id) AS FLOAT) * 100::FLOAT AS share FROM cutoff WHERE gaps <= cut WINDOW k AS (PARTITION BY aln_id ORDER BY v DESC)),
logs AS (SELECT aln_id, coalesce(min(v) FILTER (share <= 20), 0)::DOUBLE AS hi, coalesce(min(v) FILTER (share <= 80), 0)::DOUBLE AS lo FROM tops GROUP BY 1),
lim AS (SELECT aln_id, CASE WHEN lo <= 0 THEN 0::FLOAT ELSE CAST(power(10, (log10(hi) - log10(lo)) / 10 + log10(lo)) AS FLOAT) END AS lim FROM logs),
flags AS (SELECT aln_id, list(gaps <= cut AND v >= coalesce(lim, 0) ORDER BY col) AS f, count(*) AS n FROM cutoff LEFT JOIN lim USING (aln_id) GROUP BY 1),
edges AS (SELECT aln_id, n, CASE WHEN n < 5 THEN f ELSE list_concat([f[1], f[1] AND f[3] AND f[4]], f[3:n - 2], [f[n] AND f[n - 2] AND (CASE WHEN n = 5 THEN f[1] AND f[3] AND f[4] ELSE f[n - 3] END), f[n]]) END AS f FROM flags),
saved AS (SELECT aln_id, CASE WHEN n < 5 THEN f ELSE list_concat(list_reduce(range(3, n - 1), lambda a, i: list_append(a, f[i] OR CAST(a[-2] AS INTEGER) + CAST(a[-1] AS INTEGER) + CAST(f[i + 1] AS INTEGER) + CAST(f[i + 2] AS INTEGER) >= 3), f[1:2]), f[n - 1:n]) END AS f FROM edges),
kept_cols AS (SELECT aln_id, unnest(range(1, len(f) + 1)) AS col, unnest(f) AS k FROM saved),
blocks AS (SELECT aln_id, col, col - row_number() OVER (PARTITION BY aln_id ORDER BY col) AS b, max_col FROM kept_cols JOIN (SELECT aln_id, max(col) AS max_col FROM cells GROUP BY 1) USING (aln_id) WHERE k),
sized AS (SELECT aln_id, col, count(*) OVER (PARTITION BY aln_id, b) AS size, max_col FROM blocks)"""
# gappyout or strict, by how alike the rows are
_CHOSEN = _STRICT + """,
alike AS (SELECT aln_id, i, j, coalesce(count(*) FILTER (kx AND x = y) / nullif(count(*) FILTER (kx OR ky), 0), 0) AS v FROM known GROUP BY ALL),
of_row AS (SELECT aln_id, i, sum(v) AS total, max(v) AS most FROM (SELECT aln_id, i, v FROM alike UNION ALL SELECT aln_id, j, v FROM alike) GROUP BY ALL),
of_aln AS (SELECT aln_id, sum(total) / (count(*) * (count(*) - 1)) AS mean, avg(most) AS most, count(*) AS n FROM of_row GROUP BY 1),
method AS (SELECT a.aln_id, CASE WHEN n IS NULL OR mean >= 0.55 THEN 'gappyout' WHEN mean <= 0.38 THEN 'strict' WHEN n <= 20 OR most BETWEEN 0.5 AND 0.65 THEN 'gappyout' ELSE 'strict' END AS method
  FROM (SELECT DISTINCT aln_id FROM aln) a LEFT JOIN of_aln USING (aln_id)),
chosen AS (SELECT aln_id, col FROM cutoff JOIN method USING (aln_id) WHERE method = 'gappyout' AND gaps <= cut UNION ALL SELECT aln_id, col FROM sized JOIN method USING (aln_id) WHERE method = 'strict' AND size >= 5)"""
_FORMS = JOB_ALIGNMENTS + """,
forms AS (SELECT aln_id, 'right' AS a, seq_id, seq FROM aln UNION ALL SELECT aln_id, 'left', seq_id, lpad(replace(seq, '-', ''), CAST(length(seq) AS INTEGER), '-') FROM aln),
form_cells AS (SELECT aln_id, a, seq_id, unnest(range(1, length(seq) + 1)) AS col, unnest(string_split(seq, '')) AS base FROM forms),
ords AS (SELECT aln_id, a, seq_id, col, CASE WHEN base = '-' THEN 0 ELSE sum((base <> '-')::INTEGER) OVER (PARTITION BY aln_id, a, seq_id ORDER BY col) END AS ordinal FROM form_cells)"""
_AGREED = _FORMS + """,
rp AS (SELECT x.aln_id, x.a, x.col, x.seq_id AS k, x.ordinal AS ok, y.seq_id AS m, y.ordinal AS om FROM ords x JOIN ords y ON x.aln_id = y.aln_id AND x.a = y.a AND x.col = y.col AND x.seq_id < y.seq_id WHERE x.ordinal > 0 AND y.ordinal > 0),
both_forms AS (SELECT aln_id, k, ok, m, om, count(*) AS n FROM rp GROUP BY ALL),
per_col AS (SELECT aln_id, a, col, sum(n - 1) / count(*) AS v FROM rp JOIN both_forms USING (aln_id, k, ok, m, om) GROUP BY ALL),
agreement AS (SELECT aln_id, a, sum(v) AS total, max(w) AS w FROM per_col JOIN (SELECT aln_id, max(length(seq)) AS w FROM aln GROUP BY 1) USING (aln_id) GROUP BY 1, 2)"""
_WINDOWED = GAPS + """,
n AS (SELECT aln_id, max(col) AS n FROM gaps GROUP BY 1 HAVING max(col) >= 8),
x AS (SELECT aln_id, col, n, unnest(range(col - 2, col + 3)) AS p FROM gaps JOIN n USING (aln_id)),
y AS (SELECT aln_id, col, CASE WHEN p < 1 THEN 2 - p WHEN p > n THEN 2 * n - p ELSE p END AS p FROM x),
win AS (SELECT y.aln_id, y.col, CAST(floor(sum(g.gaps) / 5 + 0.5) AS BIGINT) AS window_gaps FROM y JOIN gaps g ON g.aln_id = y.aln_id AND g.col = y.p GROUP BY ALL)"""
_ISLANDS = GAPS + """,
rare AS (SELECT aln_id, col, col - row_number() OVER (PARTITION BY aln_id ORDER BY col) AS k FROM gaps WHERE gaps >= n_seqs - 1),
isl AS (SELECT aln_id, min(col) AS first_col, max(col) AS last_col FROM rare GROUP BY aln_id, k HAVING max(col) - min(col) + 1 >= 20)"""

_ALIGNED = """SELECT query AS aln_id, id AS seq_id, sequence AS residues, count(*) OVER (PARTITION BY query) AS n, 1 AS n_lengths FROM search_jobs WHERE query IS NOT NULL AND sequence IS NOT NULL"""

SQL = {
    "check_alignment": f"""WITH {JOB_ALIGNMENTS} SELECT aln_id, count(*) AS n_seqs, count(DISTINCT length(seq)) AS n_lengths, max(length(seq)) AS max_length,
count(*) FILTER (NOT regexp_full_match(seq, '[A-Za-z-]*')) AS n_bad FROM aln GROUP BY 1""",
    "column_gaps": f"WITH {GAPS} SELECT * FROM gaps",
    "gap_histogram": f"""WITH {GAPS}, h AS (SELECT aln_id, gaps, count(*) AS n_columns FROM gaps GROUP BY ALL)
SELECT *, CAST(sum(n_columns) OVER (PARTITION BY aln_id ORDER BY gaps) AS BIGINT) AS n_upto FROM h""",
    "gap_distribution": f"""WITH {GAPS}, h AS (SELECT aln_id, gaps, count(*) AS n_columns FROM gaps GROUP BY ALL)
SELECT *, CAST(sum(n_columns) OVER (PARTITION BY aln_id ORDER BY gaps DESC) AS BIGINT) AS n_upto,
round(sum(n_columns) OVER (PARTITION BY aln_id ORDER BY gaps DESC) / sum(n_columns) OVER (PARTITION BY aln_id), 6) AS share FROM h""",
    "windowed_gaps": f"WITH {_WINDOWED} SELECT * FROM win",
    "trim_windowed": f"WITH {_WINDOWED} " + _TRIMMED.format("window_gaps <= n_seqs * (1 - 0.7::DOUBLE)").replace("JOIN gaps USING (aln_id, col)", "JOIN gaps USING (aln_id, col) JOIN win USING (aln_id, col)"),
    "trim_gap_similarity": f"WITH {_SIMILARITY} " + _TRIMMED.format("gaps <= n_seqs * (1 - 0.7::DOUBLE) AND similarity >= 0.3::FLOAT").replace("JOIN gaps USING (aln_id, col)", "JOIN gaps USING (aln_id, col) JOIN sim USING (aln_id, col)"),
    "consensus_columns": f"WITH {_VOTES} SELECT * FROM con",
    "consensus_sequence": f"""WITH {_VOTES}, one AS (SELECT aln_id, count(*) AS n, any_value(seq) AS seq FROM aln GROUP BY 1)
SELECT aln_id, CASE WHEN any_value(n) = 1 THEN any_value(seq) ELSE string_agg(consensus, '' ORDER BY col) END AS consensus FROM con JOIN one USING (aln_id) GROUP BY 1""",
    "p_distance": f"WITH {PAIRS} SELECT aln_id, i, j, round(count(*) FILTER (x <> y) / count(*), 6) AS p_distance FROM pc GROUP BY ALL",
    "pairwise_identity": f"WITH {_IDENT} SELECT aln_id, i, j, round(v, 6) AS identity FROM id",
    "identity_of_shared_span": f"""WITH {PAIRS}, {SCORES}, s AS (SELECT aln_id, i, j, greatest(min(col) FILTER (x <> '-'), min(col) FILTER (y <> '-')) AS lo, least(max(col) FILTER (x <> '-'), max(col) FILTER (y <> '-')) AS hi FROM pc GROUP BY ALL)
SELECT aln_id, i, j, round(coalesce(sum(score) / nullif(count(*) FILTER (pc.x <> '-' OR pc.y <> '-'), 0), 0), 6) AS identity FROM s LEFT JOIN pc USING (aln_id, i, j)
LEFT JOIN scores ON scores.x = upper(pc.x) AND scores.y = upper(pc.y) WHERE pc.col BETWEEN lo AND hi GROUP BY ALL""",
    "mean_identity": f"WITH {_IDENT} SELECT aln_id, round(avg(v), 6) AS mean_identity FROM id GROUP BY 1",
    "determined_identity": f"WITH {_DET} SELECT aln_id, i, j, round(v, 6) AS identity, round(100 - 100 * v, 6) AS distance_pct FROM det",
    "identity_summary": f"""WITH {_DET}, b AS (SELECT aln_id, i, v FROM det UNION ALL SELECT aln_id, j, v FROM det), r AS (SELECT aln_id, i, avg(v) AS m, max(v) AS x FROM b GROUP BY ALL)
SELECT aln_id, round(avg(m), 6) AS mean_identity, round(avg(x), 6) AS mean_max_identity FROM r GROUP BY 1""",
    "sum_of_pairs": f"""WITH {PAIRS}, {SCORES}, s AS (SELECT aln_id, sum(CASE WHEN score > 0 THEN score WHEN (upper(pc.x) IN ('C', 'T', 'Y')) = (upper(pc.y) IN ('C', 'T', 'Y')) THEN -1 ELSE -2 END) AS v
  FROM pc LEFT JOIN scores ON scores.x = upper(pc.x) AND scores.y = upper(pc.y) WHERE pc.x <> '-' AND pc.y <> '-' GROUP BY 1),
inner_part AS (SELECT aln_id, regexp_replace(seq, '^-+|-+$', '', 'g') AS t FROM aln), r AS (SELECT aln_id, len(regexp_extract_all(t, '-+')) AS runs, length(t) - length(replace(t, '-', '')) AS letters FROM inner_part),
g AS (SELECT aln_id, sum(-2.0 * runs - (letters - runs)) AS g FROM r GROUP BY 1)
SELECT aln_id, CAST(coalesce(v, 0) + g AS DOUBLE) AS score FROM g LEFT JOIN s USING (aln_id)""",
    "overlap_values": f"""WITH {_OVERLAP} SELECT aln_id, seq_id, round(overlap, 6) AS overlap FROM ov""",
    "common_ends": f"WITH {GAPS} SELECT aln_id, min(col) FILTER (gaps = 0) AS left_col, max(col) FILTER (gaps = 0) AS right_col FROM gaps GROUP BY 1",
    "insertion_islands": f"WITH {_ISLANDS} SELECT * FROM isl",
    "remove_insertions": f"""WITH {_ISLANDS}, kept AS (SELECT c.* FROM cells c WHERE NOT EXISTS (SELECT 1 FROM isl WHERE isl.aln_id = c.aln_id AND c.col BETWEEN first_col AND last_col))
SELECT a.aln_id, a.seq_id, coalesce(string_agg(base, '' ORDER BY col), '') AS seq FROM aln a LEFT JOIN kept k USING (aln_id, seq_id) GROUP BY 1, 2""",
    "residue_ordinals": f"""WITH {CELLS}, o AS (SELECT aln_id, seq_id, row_number() OVER (PARTITION BY aln_id, seq_id ORDER BY col) AS o FROM cells WHERE base <> '-')
SELECT aln_id, seq_id, max(o) AS n_residues, CAST(sum(o) AS BIGINT) AS checksum FROM o GROUP BY 1, 2""",
    "trim_nogaps": f"WITH {GAPS} " + _TRIMMED.format("gaps = 0"),
    "trim_noallgaps": f"WITH {GAPS} " + _TRIMMED.format("gaps < n_seqs"),
    "trim_gap_threshold": f"WITH {GAPS} " + _TRIMMED.format("gaps <= n_seqs * (1 - 0.7::DOUBLE)"),
    "trim_select": f"WITH {GAPS} " + _TRIMMED.format("NOT (col BETWEEN 1 AND 5 OR col = 11)"),
    "trim_complementary": f"WITH {GAPS} " + _TRIMMED.format("gaps > 0"),
    "trim_column_map": f"WITH {GAPS} SELECT aln_id, col - 1 AS old_col, row_number() OVER (PARTITION BY aln_id ORDER BY col) - 1 AS new_col FROM gaps WHERE gaps = 0",
    "trim_overlap": f"""WITH {_OVERLAP}, good AS (SELECT c.* FROM cells c JOIN ov USING (aln_id, seq_id) WHERE overlap >= 0.6::DOUBLE),
filled_cols AS (SELECT aln_id, col FROM good GROUP BY ALL HAVING count(*) FILTER (base <> '-') > 0)
SELECT aln_id, seq_id, string_agg(base, '' ORDER BY col) AS seq FROM good JOIN filled_cols USING (aln_id, col) GROUP BY 1, 2 HAVING count(*) FILTER (base <> '-') > 0""",
    "trim_gappyout": f"WITH {_SLOPE} " + _TRIMMED.format("gaps <= cut").replace("JOIN gaps USING (aln_id, col)", "JOIN gaps USING (aln_id, col) JOIN slope USING (aln_id)"),
    "trim_automated1": f"WITH {_CHOSEN} " + _TRIMMED.format("true").replace("JOIN gaps", "JOIN chosen"),
    "trim_consistency": f"""WITH {_AGREED}, best AS (SELECT f.aln_id, arg_max(f.a, {{'v': coalesce(total / ag.w, 0), 'neg': -ascii(f.a)}}) AS a FROM (SELECT DISTINCT aln_id, a FROM forms) f LEFT JOIN agreement ag ON ag.aln_id = f.aln_id AND ag.a = f.a GROUP BY 1),
fc AS (SELECT c.*, coalesce(v, 0)::FLOAT AS v FROM form_cells c JOIN best USING (aln_id, a) LEFT JOIN per_col USING (aln_id, a, col)), low AS (SELECT aln_id, count(*) FILTER (v < 0.5::FLOAT) AS n_low FROM fc GROUP BY 1)
SELECT aln_id AS set_id, a AS aln_id, seq_id, coalesce(string_agg(base, '' ORDER BY col) FILTER (v >= 0.5::FLOAT OR n_low = 0), '') AS seq FROM fc JOIN low USING (aln_id) GROUP BY 1, 2, 3""",
    "trim_strict": f"WITH {_STRICT} " + _TRIMMED.format("size >= 5").replace("JOIN gaps", "JOIN sized"),
    "trim_strictplus": f"WITH {_STRICT} " + _TRIMMED.format("size >= greatest(3, least(12, floor(max_col * 0.01 + 0.5)))").replace("JOIN gaps", "JOIN sized"),
    "column_similarity": f"WITH {_SIMILARITY} SELECT aln_id, col, round(CAST(similarity AS DOUBLE), 6) AS similarity FROM sim",
    "trim_similarity": f"WITH {_SIMILARITY} " + _TRIMMED.format("similarity >= 0.5::FLOAT").replace("JOIN gaps USING (aln_id, col)", "JOIN sim USING (aln_id, col)"),
    "consistency": f"WITH {_AGREED} SELECT aln_id AS set_id, a AS aln_id, round(total / w, 6) AS consistency FROM agreement",
    "most_consistent": f"WITH {_AGREED} SELECT aln_id AS set_id, arg_min(a, {{'v': -round(total / w, 6), 'a': a}}) AS aln_id FROM agreement GROUP BY 1",
    "shared_columns": f"""WITH {_FORMS}, h AS (SELECT aln_id, a, col, string_agg(seq_id || ':' || ordinal, ',' ORDER BY seq_id) AS h FROM ords GROUP BY ALL)
SELECT x.aln_id AS set_id, x.a AS first_aln, y.a AS second_aln, count(*) AS n_shared FROM h x JOIN h y ON x.aln_id = y.aln_id AND x.h = y.h AND x.a < y.a GROUP BY ALL""",
    "align_rounds": _ALIGNED,
    "segment_coverage": f"""WITH {JOB_ALIGNMENTS}, s AS (SELECT aln_id, seq_id, substr(seq, 21, 50) AS t FROM aln)
SELECT aln_id, seq_id, length(t) - length(replace(t, '-', '')) <= 0.2::DOUBLE * length(t) AS covered FROM s""",
    "alignment_formats": f"""WITH {JOB_ALIGNMENTS} SELECT aln_id, seq_id, upper(seq) AS seq, format FROM aln CROSS JOIN (VALUES {', '.join(f"('{f}')" for f in A.FORMATS)}) v(format)""",
    "align": _ALIGNED,
}

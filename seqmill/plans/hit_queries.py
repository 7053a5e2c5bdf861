"""Queries over search hits and rounds, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import sequence as S
from ..functions.values import accession_key, accession_key_sql
from ..operators import cluster, hits, records, selection
from ..runtime import broadcast_if_small, table
from ..sources.search_xml import job_state
from . import pipeline

MAX_LENGTH = 1200

_JOINED = f"""d AS (SELECT query_acc, subject_acc, bit_score, alignment_length, n_identical, s_start, s_end, q_start, q_end, count(*) AS n
  FROM hit_table WHERE subject_acc IS NOT NULL GROUP BY ALL),
g AS (SELECT query_acc, subject_acc, list({{'bs': bit_score, 'al': alignment_length, 's0': s_start, 's1': s_end, 'q0': q_start, 'q1': q_end, 'n': n}}
  ORDER BY bit_score DESC, alignment_length DESC, n_identical DESC, s_start, s_end, q_start, q_end) AS h FROM d GROUP BY ALL),
f AS (SELECT query_acc, subject_acc, h[1].s1 > h[1].s0 AS s_strand, h[1].q1 > h[1].q0 AS q_strand, least(1.05 * sequence_length, {float(MAX_LENGTH)}) AS allowed,
  list_filter(h, lambda x: (x.s1 > x.s0) = (h[1].s1 > h[1].s0) AND (x.q1 > x.q0) = (h[1].q1 > h[1].q0)
    AND sign(x.q0 - h[1].q0) = sign(x.q1 - h[1].q1) AND sign(x.s0 - h[1].s0) = sign(x.s1 - h[1].s1)
    AND sign(x.s0 - h[1].s0) * (CASE WHEN h[1].s1 > h[1].s0 THEN 1 ELSE -1 END) = sign(x.q0 - h[1].q0)) AS h
  FROM g JOIN query_info ON query_acc = id),
r AS (SELECT *, list_reduce(list_transform(h, lambda x: {{'lo': least(x.s0, x.s1), 'hi': greatest(x.s0, x.s1), 'q0': x.q0, 'q1': x.q1}}),
  lambda a, x: CASE WHEN greatest(a.hi, x.hi) - least(a.lo, x.lo) + 1 <= allowed THEN {{'lo': least(a.lo, x.lo), 'hi': greatest(a.hi, x.hi),
    'q0': CASE WHEN s_strand THEN (CASE WHEN x.lo < a.lo THEN x.q0 ELSE a.q0 END) ELSE (CASE WHEN x.hi > a.hi THEN x.q0 ELSE a.q0 END) END,
    'q1': CASE WHEN s_strand THEN (CASE WHEN x.hi > a.hi THEN x.q1 ELSE a.q1 END) ELSE (CASE WHEN x.lo < a.lo THEN x.q1 ELSE a.q1 END) END}} ELSE a END) AS o FROM f),
joined AS (SELECT query_acc, subject_acc, CASE WHEN s_strand THEN o.lo ELSE o.hi END AS s_start, CASE WHEN s_strand THEN o.hi ELSE o.lo END AS s_end,
  o.q0 AS q_start, o.q1 AS q_end, q_strand, s_strand, CAST(list_sum(list_transform(h, lambda x: x.n)) AS BIGINT) AS hits_num,
  CAST(list_sum(list_transform(h, lambda x: x.al * x.n)) AS BIGINT) AS sum_hits_alignlen, round(list_sum(list_transform(h, lambda x: x.bs * x.n)), 4) AS sum_hits_score FROM r)"""
_BEST = """best AS (SELECT * FROM joined QUALIFY row_number() OVER (PARTITION BY subject_acc ORDER BY sum_hits_score DESC, sum_hits_alignlen DESC, query_acc) = 1)"""

_ROUNDS = f"b AS (SELECT *, {accession_key_sql('subject_acc')} AS a FROM blast_result_long)"


def _joined(spark: SparkSession, d: str) -> DataFrame:
    return hits.join_hits(table(spark, d, "hit_table"), table(spark, d, "query_info"), MAX_LENGTH)


def _best(spark: SparkSession, d: str) -> DataFrame:
    return hits.select_hits(_joined(spark, d))


def extend_hits(spark: SparkSession, d: str) -> DataFrame:
    return hits.extend_hits(_best(spark, d), table(spark, d, "query_info"), MAX_LENGTH)


def hit_scalars(spark: SparkSession, d: str) -> DataFrame:
    h = hits.with_strands(table(spark, d, "hit_table")).withColumn("hit_len", F.abs(F.col("s_end") - F.col("s_start")) + 1)
    return h.groupBy("q_strand", "s_strand").agg(F.count(F.lit(1)).alias("n"), F.sum("hit_len").alias("sum_len"), F.max("hit_len").alias("max_len"))


def hit_accessions(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "hit_table").select(S.hit_id_accession(F.col("hit_id")).alias("acc"), "subject_acc")
    return h.groupBy("acc").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("acc") == F.col("subject_acc")).alias("n_same"))


def annotated_hits(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: joined, best per record, and passing the annotation check with
    all definitions of the record."""
    b = _best(spark, d)
    defs = table(spark, d, "hit_table").groupBy("subject_acc").agg(F.collect_set("hit_def").alias("hit_defs"))
    x = b.join(defs, "subject_acc")
    return x.where(S.annotation_ok(F.col("hit_defs"), ["ITS gene", "rbcL gene", "matK gene"], ["rubri cola"])).drop("hit_defs")


def _rounds(spark: SparkSession, d: str) -> DataFrame:
    """Results with one spelling for each record: accession without version."""
    return table(spark, d, "blast_result_long").withColumn("subject_acc", accession_key(F.col("subject_acc")))


def new_hits_per_round(spark: SparkSession, d: str) -> DataFrame:
    b = _rounds(spark, d).select("source", "subject_acc").distinct()
    out = hits.new_hits(b.where("source = 2"), b.where("source < 2"))
    return out.select("subject_acc")


def round_counters(spark: SparkSession, d: str) -> DataFrame:
    b = _rounds(spark, d)
    return hits.round_counters(b, "subject_acc", F.coalesce(F.col("sum_hits_score") > 500, F.lit(False)))


def first_round(spark: SparkSession, d: str) -> DataFrame:
    return hits.first_round(_rounds(spark, d))


def rows_per_round(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "blast_result_long").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def quartile_band(spark: SparkSession, d: str) -> DataFrame:
    return selection.quartile_band(table(spark, d, "hit_table").distinct(), "query_acc", "bit_score").groupBy("query_acc").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("bit_score"), 3).alias("total"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "query_info").select(F.col("id").alias("query_acc"), (F.col("sequence_length") * 0.1).alias("radius"))
    return _best(spark, d).join(broadcast_if_small(q), "query_acc")


def proximity_join(spark: SparkSession, d: str) -> DataFrame:
    return cluster.proximity_edges(_points(spark, d), "query_acc", "subject_acc", "q_start", "q_end", "radius")


def position_clusters(spark: SparkSession, d: str) -> DataFrame:
    p = selection.sample_per_group(selection.quartile_band(_points(spark, d), "query_acc", "sum_hits_score"), "query_acc", "subject_acc", 1000)
    edges = cluster.proximity_edges(p, "query_acc", "subject_acc", "q_start", "q_end", "radius")
    clusters = cluster.graph_clusters(p, edges, "query_acc", "subject_acc")
    return cluster.best_of_clusters(p, clusters, ["query_acc", "subject_acc"]).select("query_acc", "cluster", "subject_acc")


def sampled_hits(spark: SparkSession, d: str) -> DataFrame:
    return selection.sample_per_group(table(spark, d, "seq_info").select("site_code", "info_id"), "site_code", "info_id", 5)


def unused_queries(spark: SparkSession, d: str) -> DataFrame:
    """Candidates whose accession no query has used."""
    used = table(spark, d, "query_info").select(F.col("id").alias("query"))
    return table(spark, d, "search_jobs").where("query is not null").join(used, "query", "left_anti").select("id", "query")


def query_quality(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "search_jobs").select("id", F.col("sequence").alias("seq"))
    used = table(spark, d, "search_jobs").where("status = 'READY'").select("sequence")
    return records.new_query_quality(jobs, used, 1000).select("id", "reason")


def deduplicated_queries(spark: SparkSession, d: str) -> DataFrame:
    return records.dedup_queries(table(spark, d, "search_jobs").select("id", "description", "sequence"), "id").select("id", "description")


def sequence_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The queries of each round by their sequences: the longest of each cluster."""
    q = table(spark, d, "query_info").where("blast_round is not null and sequence is not null").select("blast_round", "id", F.col("sequence").alias("seq"))
    clusters = pipeline.sequence_clusters(q, "blast_round", "id", "seq")
    return pipeline.longest_of_clusters(q, clusters, "blast_round", "id", "seq").select("blast_round", "cluster", "id")


def job_states(spark: SparkSession, d: str) -> DataFrame:
    return job_state(table(spark, d, "search_jobs"), 1735700000.0 + 30 * 86400).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "join_hits": _joined,
    "select_hits": _best,
    "extend_hits": extend_hits,
    "annotated_hits": annotated_hits,
    "hit_scalars": hit_scalars,
    "hit_accessions": hit_accessions,
    "new_hits_per_round": new_hits_per_round,
    "round_counters": round_counters,
    "first_round": first_round,
    "rows_per_round": rows_per_round,
    "quartile_band": quartile_band,
    "proximity_join": proximity_join,
    "position_clusters": position_clusters,
    "sample_per_group": sampled_hits,
    "unused_queries": unused_queries,
    "query_quality": query_quality,
    "deduplicated_queries": deduplicated_queries,
    "sequence_clusters": sequence_clusters,
    "job_states": job_states,
}

SQL = {
    "join_hits": f"WITH {_JOINED} SELECT * FROM joined",
    "select_hits": f"WITH {_JOINED}, {_BEST} SELECT * FROM best",
    "extend_hits": f"""WITH {_JOINED}, {_BEST},
w AS (SELECT b.*, coalesce(missing_left, 0) AS extra_extension_left, coalesce(missing_right, 0) AS extra_extension_right, sequence_length AS ql,
  abs(s_end - s_start) + 1 AS hit_len, q_start - 1 AS auto_extension_left, sequence_length - q_end AS auto_extension_right FROM best b JOIN query_info ON query_acc = id),
v AS (SELECT *, {MAX_LENGTH} - hit_len AS max_extension, auto_extension_left + CASE WHEN {MAX_LENGTH} > ql THEN extra_extension_left ELSE 0 END AS wl,
  auto_extension_right + CASE WHEN {MAX_LENGTH} > ql THEN extra_extension_right ELSE 0 END AS wr FROM w),
u AS (SELECT *, CAST(CASE WHEN {MAX_LENGTH} > ql AND wl + wr > 0 AND wl + wr > max_extension THEN floor(max_extension * (wl / (wl + wr))) ELSE wl END AS BIGINT) AS extension_left,
  CAST(CASE WHEN {MAX_LENGTH} > ql AND wl + wr > 0 AND wl + wr > max_extension THEN floor(max_extension * (1 - wl / (wl + wr))) ELSE wr END AS BIGINT) AS extension_right FROM v)
SELECT * EXCLUDE (ql, wl, wr), q_start - extension_left AS q_extstart, q_end + extension_right AS q_extend,
  CASE WHEN s_end > s_start THEN s_start - extension_left ELSE s_start + extension_left END AS s_extstart,
  CASE WHEN s_end > s_start THEN s_end + extension_right ELSE s_end - extension_right END AS s_extend FROM u""",
    "annotated_hits": f"""WITH {_JOINED}, {_BEST}, h AS (SELECT subject_acc, replace(lower(hit_def), ' ', '') AS t FROM hit_table),
t AS (SELECT subject_acc FROM h GROUP BY 1 HAVING NOT coalesce(bool_or(contains(t, 'rubricola')), false) AND bool_or(contains(t, 'itsgene') OR contains(t, 'rbclgene') OR contains(t, 'matkgene')))
SELECT best.* FROM best JOIN t USING (subject_acc)""",
    "hit_scalars": """SELECT q_end - q_start > 0 AS q_strand, s_end - s_start > 0 AS s_strand, count(*) AS n, CAST(sum(abs(s_end - s_start) + 1) AS BIGINT) AS sum_len,
max(abs(s_end - s_start) + 1) AS max_len FROM hit_table GROUP BY ALL""",
    "hit_accessions": r"""WITH p AS (SELECT string_split(hit_id, '|') AS p, hit_id, subject_acc FROM hit_table),
a AS (SELECT CASE WHEN len(p) < 2 THEN hit_id WHEN length(p[-1]) BETWEEN 1 AND 2 THEN p[-2] || '_' || p[-1] ELSE p[-2] END AS acc, subject_acc FROM p)
SELECT acc, count(*) AS n, count(*) FILTER (acc = subject_acc) AS n_same FROM a GROUP BY acc""",
    "new_hits_per_round": f"""WITH {_ROUNDS} SELECT DISTINCT a AS subject_acc FROM b WHERE source = 2 AND a NOT IN (SELECT a FROM b WHERE source < 2 AND a IS NOT NULL)""",
    "round_counters": f"""WITH {_ROUNDS}, k AS (SELECT a, min({{'r': source, 'bad': NOT coalesce(sum_hits_score > 500, false)}}) AS m FROM b WHERE a IS NOT NULL GROUP BY 1)
SELECT m.r AS round, count(*) AS n_new, count(*) FILTER (NOT m.bad) AS n_good, CAST(sum(count(*)) OVER (ORDER BY m.r) AS BIGINT) AS n_total FROM k GROUP BY m.r""",
    "first_round": f"WITH {_ROUNDS} SELECT a AS subject_acc, min(source) AS first_round FROM b WHERE a IS NOT NULL GROUP BY 1",
    "rows_per_round": "SELECT source, count(*) AS n FROM blast_result_long GROUP BY 1",
    "quartile_band": """WITH h AS (SELECT DISTINCT * FROM hit_table), q AS (SELECT query_acc, quantile_cont(bit_score, 0.25) AS a, quantile_cont(bit_score, 0.75) AS b FROM h GROUP BY 1)
SELECT query_acc, count(*) AS n, round(sum(bit_score), 3) AS total FROM h JOIN q USING (query_acc) WHERE bit_score BETWEEN a AND b GROUP BY 1""",
    "proximity_join": f"""WITH {_JOINED}, {_BEST}, p AS (SELECT query_acc, subject_acc, q_start, q_end, sequence_length * 0.1::DOUBLE AS r FROM best JOIN query_info ON query_acc = id)
SELECT a.query_acc, a.subject_acc AS i, b.subject_acc AS j FROM p a JOIN p b ON a.query_acc = b.query_acc AND a.subject_acc < b.subject_acc
WHERE power(a.q_start - b.q_start, 2) + power(a.q_end - b.q_end, 2) <= power(a.r, 2)""",
    "sample_per_group": "SELECT site_code, info_id FROM seq_info QUALIFY row_number() OVER (PARTITION BY site_code ORDER BY md5(info_id || ':42'), info_id) <= 5",
    "unused_queries": "SELECT id, query FROM search_jobs WHERE query IS NOT NULL AND query NOT IN (SELECT id FROM query_info)",
    "query_quality": """SELECT id, CASE WHEN length(regexp_replace(upper(sequence), '[^ACGT]', '', 'g')) < 200 THEN 'short'
WHEN length(regexp_replace(upper(sequence), '[^ACGT]', '', 'g')) < 0.995 * length(sequence) THEN 'ambiguous'
WHEN sequence IN (SELECT sequence FROM search_jobs WHERE status = 'READY') THEN 'duplicate' END AS reason FROM search_jobs""",
    "deduplicated_queries": """WITH a AS (SELECT * FROM search_jobs QUALIFY row_number() OVER (PARTITION BY description ORDER BY id) = 1)
SELECT id, description FROM a QUALIFY row_number() OVER (PARTITION BY sequence ORDER BY id) = 1""",
    "job_states": """SELECT CASE WHEN lower(trim(status)) IN ('ready', 'done') THEN 'done' WHEN lower(trim(status)) = 'failed' THEN 'failed' WHEN rid IS NULL THEN 'new'
WHEN 1738292000.0 - time_put > 86400 THEN 'expired' ELSE 'open' END AS state, count(*) AS n FROM search_jobs GROUP BY 1""",
}

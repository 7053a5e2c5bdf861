"""Queries that write records in a file format and read them again, with the SQL
of what must come back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import sequence as S
from ..runtime import checkpoint_dir, table
from ..schemas import HIT_TABLE
from ..sources import fasta, outputs, records, search_xml


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all machines see."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid4().hex}"


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "search_jobs").where("sequence is not null")
    return jobs.select(F.concat_ws("|", F.concat("id", F.lit(":1-"), F.length("sequence").cast("string")), F.coalesce("query", F.lit("none"))).alias("description"), F.col("sequence").alias("seq"), F.coalesce("query", F.lit("none")).alias("marker"))


def fasta_records(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "fasta")
    fasta.write_fasta(_jobs(spark, d), path)
    return fasta.read_fasta(spark, path).select("record_id", "description", "seq")


def fasta_by_marker(spark: SparkSession, d: str) -> DataFrame:
    """Records of all markers in a folder each, described by their taxon."""
    path = _folder(spark, "markers")
    info = table(spark, d, "query_info").select(F.regexp_extract("description", r"(\S+), seed query$", 1).alias("marker"), F.regexp_extract("description", r"^\S+ (\S+ \S+) ", 1).alias("organism"), F.col("sequence").alias("seq")).where("marker <> ''")
    names = [r.marker for r in info.select("marker").distinct().limit(1000).collect()]  # the project's markers
    fasta.write_fasta_by(outputs.collected({m: info.where(F.col("marker") == m) for m in names}), path, "marker")
    folders = [f"{path}/marker={m}" for m in sorted(names)]
    return fasta.read_fasta(spark, folders).groupBy("description").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("seq")).alias("letters"))


def table_rows(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "table")
    fasta.write_table(table(spark, d, "hit_table").select(*[x.split()[0] for x in HIT_TABLE.split(", ")]), path)
    back = fasta.read_table(spark, path, HIT_TABLE, ["query_acc", "subject_acc", "hit_def", "bit_score", "s_start"])
    return back.groupBy("query_acc", "subject_acc").agg(F.count("hit_def").alias("n_defs"), F.round(F.sum("bit_score"), 3).alias("score"), F.sum("s_start").alias("starts"))


def search_results_xml(spark: SparkSession, d: str) -> DataFrame:
    """Hits as the XML of a search result, read into a hit table."""
    path = _folder(spark, "xml")
    h = table(spark, d, "hit_table").where("hit_def is not null and subject_acc is not null")
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), F.col(c).cast("string"), F.lit(f"</{name}>"))
    names = {"Hsp_bit-score": "bit_score", "Hsp_evalue": "evalue", "Hsp_query-from": "q_start", "Hsp_query-to": "q_end", "Hsp_hit-from": "s_start", "Hsp_hit-to": "s_end", "Hsp_identity": "n_identical", "Hsp_gaps": "gap_opens", "Hsp_align-len": "alignment_length"}
    hsp = F.concat(F.lit("<Hsp>"), *[tag(k, c) for k, c in names.items()], F.lit("</Hsp>"))
    hit = F.concat(F.lit("<Hit>"), tag("Hit_id", "hit_id"), tag("Hit_def", "hit_def"), F.lit("<Hit_hsps>"), hsp, F.lit("</Hit_hsps></Hit>"))
    # a file for each query, as its result would be stored
    whole = h.select("query_acc", hit.alias("hit")).groupBy("query_acc").agg(F.array_join(F.collect_list("hit"), "").alias("hits"))
    whole.select("query_acc", F.concat(F.lit("<Iteration_hits>"), "hits", F.lit("</Iteration_hits>")).alias("value")).write.partitionBy("query_acc").text(path)
    back = search_xml.read_search_xml(spark, f"{path}/*", "all")
    return back.groupBy("hit_def").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("bit_score"), 3).alias("score"), F.sum("s_end").alias("ends"), F.min("alignment_length").alias("least"))


def checked_records(spark: SparkSession, d: str) -> DataFrame:
    """Records split by a check into folders, read again."""
    path = _folder(spark, "checked")
    info = table(spark, d, "seq_info").select("info_id", "organism", "description")
    records.write_checked(info, path, S.annotation_ok(F.array("description"), ["ITS", "rbcL"], ["montula"]))
    return spark.read.parquet(path).groupBy((F.col("is_valid").cast("string") == "true").alias("is_valid")).agg(F.count(F.lit(1)).alias("n"), F.sum("info_id").alias("ids"))


def short_headers(spark: SparkSession, d: str) -> DataFrame:
    """Headers without their comment, and without blanks."""
    return table(spark, d, "seq_info").select("info_id", records.first_word(F.col("description")).alias("word"), records.without_blanks(F.col("description")).alias("packed"))


QUERIES = {f.__name__: f for f in (fasta_records, fasta_by_marker, table_rows, search_results_xml, checked_records, short_headers)}

SQL = {
    "fasta_records": """SELECT id AS record_id, id || ':1-' || length(sequence) || '|' || coalesce(query, 'none') AS description, sequence AS seq FROM search_jobs WHERE sequence IS NOT NULL""",
    "fasta_by_marker": r"""SELECT replace(regexp_extract(description, '^\S+ (\S+ \S+) ', 1), ' ', '_') AS description, count(*) AS n, CAST(sum(length(sequence)) AS BIGINT) AS letters
FROM query_info WHERE regexp_extract(description, '(\S+), seed query$', 1) <> '' GROUP BY 1""",
    "table_rows": "SELECT query_acc, subject_acc, count(hit_def) AS n_defs, round(sum(bit_score), 3) AS score, CAST(sum(s_start) AS BIGINT) AS starts FROM hit_table GROUP BY ALL",
    "search_results_xml": """SELECT hit_def, count(*) AS n, round(sum(bit_score), 3) AS score, CAST(sum(s_end) AS BIGINT) AS ends, min(alignment_length) AS least
FROM hit_table WHERE hit_def IS NOT NULL AND subject_acc IS NOT NULL GROUP BY 1""",
    "checked_records": """WITH t AS (SELECT info_id, replace(lower(description), ' ', '') AS t FROM seq_info)
SELECT coalesce((contains(t, 'its') OR contains(t, 'rbcl')) AND NOT contains(t, 'montula'), false) AS is_valid, count(*) AS n, CAST(sum(info_id) AS BIGINT) AS ids FROM t GROUP BY 1""",
    "short_headers": "SELECT info_id, split_part(description, ' ', 1) AS word, replace(description, ' ', '') AS packed FROM seq_info",
}

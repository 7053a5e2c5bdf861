"""Similarity-search result pages and XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.hits import expand_aliases

_HIT = (
    "Hit_id string, Hit_def string, Hit_hsps struct<Hsp: array<struct<`Hsp_identity`: long, `Hsp_align-len`: long, `Hsp_gaps`: long, `Hsp_query-from`: long, "
    "`Hsp_query-to`: long, `Hsp_hit-from`: long, `Hsp_hit-to`: long, `Hsp_evalue`: double, `Hsp_bit-score`: double>>>"
)


def read_search_xml(spark: SparkSession, path: str, query_acc: str) -> DataFrame:
    """Hit table of one query's result: a row per (definition alias, fragment)."""
    hits = spark.read.format("xml").option("rowTag", "Hit").schema(_HIT).load(path)
    x = hits.select(F.col("Hit_id").alias("hit_id"), F.col("Hit_def").alias("hit_def"), F.explode("Hit_hsps.Hsp").alias("h"))
    x = expand_aliases(x)
    names = {
        "n_identical": "Hsp_identity", "alignment_length": "Hsp_align-len", "gap_opens": "Hsp_gaps", "q_start": "Hsp_query-from", "q_end": "Hsp_query-to",
        "s_start": "Hsp_hit-from", "s_end": "Hsp_hit-to", "evalue": "Hsp_evalue", "bit_score": "Hsp_bit-score",
    }
    return x.select(F.lit(query_acc).alias("query_acc"), "subject_acc", "hit_id", "hit_def", *[F.col("h").getField(v).alias(k) for k, v in names.items()])


def page_error(page: Column) -> Column:
    """Error text of a response page in one of its known layouts, else null."""
    found = [
        F.regexp_extract(page, r'(?is)<div[^>]*class="error msInf"[^>]*>\s*(.*?)\s*(?:</div>|\n)', 1),
        F.regexp_extract(page, r'(?is)<p[^>]*class="error"[^>]*>\s*(.*?)\s*</p>', 1),
        F.regexp_extract(page, r'(?is)<ul[^>]*class="msg"[^>]*>.*?<li[^>]*class="error"[^>]*>.*?<p>\s*(.*?)\s*</p>', 1),
        F.regexp_extract(page, r"(?is)(Message ID#.*?)\s*(?:\n|<|\z)", 1),
        F.regexp_extract(page, r"(?im)^\s*Error:\s*(.*)$", 1),
    ]
    return F.coalesce(*[F.when(F.length(x) > 0, F.trim(x)) for x in found])


def page_request(page: Column) -> tuple[Column, Column]:
    """Request id and expected seconds of an accepted request, else null."""
    rid, rtoe = F.regexp_extract(page, r"RID = (\S+)", 1), F.regexp_extract(page, r"RTOE = (\d+)", 1)
    return F.when(rid != "", rid), F.when(rtoe != "", rtoe).cast("int")


def job_state(jobs: DataFrame, now: float, expiry: float = 24 * 3600.0) -> DataFrame:
    """``state`` of each job: ``done``, ``failed``, ``expired`` (to submit
    again), ``open`` or ``new``; and per row the wait before the next poll:
    20 s, 40 s with two open jobs left, 80 s with one."""
    status = F.lower(F.trim("status"))
    state = (
        F.when(status.isin("ready", "done"), "done")
        .when(status == "failed", "failed")
        .when(F.col("rid").isNull(), "new")
        .when(F.lit(now) - F.col("time_put") > expiry, "expired")
        .otherwise("open")
    )
    x = jobs.withColumn("state", state)
    left = x.agg(F.count_if(F.col("state") == "open").alias("_open"))
    wait = F.when(F.col("_open") == 1, 80).when(F.col("_open") == 2, 40).otherwise(20)
    return x.crossJoin(F.broadcast(left)).withColumn("poll_seconds", F.when(F.col("state") == "open", wait)).drop("_open")

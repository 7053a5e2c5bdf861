"""Queries of the language-model data problems, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.values import accession_key, usable
from ..runtime import table
from .bpe import encode_texts
from .leakage import leaked
from .representative import representatives
from .sentences import split_sentences
from .top_items import top_items


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "blast_result_long")
    fields = {
        "date": F.date_format("date", "yyyy-MM-dd"),
        "journal": F.when(usable(F.col("journal"), journal=True), F.col("journal")),
        "specimen_voucher": F.when(usable(F.col("specimen_voucher")), F.col("specimen_voucher")),
    }
    return representatives(rows, accession_key(F.col("subject_acc")), "eval_id", fields, "date").select("group_id", "field", "eval_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "blast_result_long")
    score = F.when(F.col("consensus_value") != -1, F.col("consensus_value"))
    return top_items(rows, "taxon_name", [score, F.col("sum_hits_score")], "eval_id", 3)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return split_sentences(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_found": p3_found,
    "p5_found": p5_found,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p8_found": p8_found,
}

_KEY = r"regexp_replace(regexp_extract(upper(subject_acc), '([^|\s]+)[|\s]*$', 1), '\.\d+$', '')"
_PLACEHOLDERS = "'', '?', '-', '--', 'unknown', 'missing', 'none', 'not applicable', 'no voucher', 'nan', 'null', 'not available', 'n/a', 'na', 'missing: not collected'"
_NOT_PUBLISHED = r"'^(unpublished|not published)( \(\d{4}\))?([;:,].*)?$|^published only in +database'"

SQL = {
    "p3_found": f"""
WITH r AS (SELECT *, {_KEY} AS k FROM blast_result_long WHERE subject_acc IS NOT NULL),
g AS (SELECT k, min(eval_id) AS group_id FROM r WHERE k <> '' GROUP BY k HAVING count(*) >= 2),
v AS (
  SELECT k, 'date' AS field, date, eval_id FROM r WHERE date IS NOT NULL
  UNION ALL SELECT k, 'journal', date, eval_id FROM r WHERE lower(trim(journal)) NOT IN ({_PLACEHOLDERS})
    AND NOT regexp_matches(lower(trim(journal)), {_NOT_PUBLISHED})
  UNION ALL SELECT k, 'specimen_voucher', date, eval_id FROM r WHERE lower(trim(specimen_voucher)) NOT IN ({_PLACEHOLDERS}))
SELECT group_id, field, eval_id FROM v JOIN g USING (k)
QUALIFY row_number() OVER (PARTITION BY group_id, field ORDER BY date DESC NULLS LAST, eval_id) = 1""",
    "p5_found": """
SELECT taxon_name, pos, eval_id FROM (
  SELECT taxon_name, eval_id, row_number() OVER (PARTITION BY taxon_name ORDER BY
    CASE WHEN isnan(consensus_value) OR consensus_value = -1 THEN NULL ELSE consensus_value END DESC NULLS LAST,
    sum_hits_score DESC NULLS LAST, eval_id) AS pos
  FROM blast_result_long WHERE taxon_name IS NOT NULL) WHERE pos <= 3""",
}

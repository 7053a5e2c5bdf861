"""Queries of the general data-processing problems, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.heavy_keys import key_figures
from ..operators.packed_values import split_packed
from ..operators.timestamps import normalise_times
from ..runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split_packed(table(spark, d, "seq_info")).select("info_id", "field", "pos", "value")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return normalise_times(table(spark, d, "seq_info"), table(spark, d, "deposit_sites"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return key_figures(table(spark, d, "blast_result_long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p2_found": p2_found, "p4_found": p4_found}

SQL = {
    "p4_found": """
SELECT taxon_name, count(*) AS n_rows, CAST(quantile_disc(record_length, 0.5) AS BIGINT) AS mid_length
FROM blast_result_long WHERE taxon_name IS NOT NULL GROUP BY taxon_name""",
}

"""FASTA, table and parameter files."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.sequence import accession_of

SUFFIXES = (".fasta", ".fas", ".fa")


def read_fasta(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(marker, record_id, description, seq): one row per record, read in
    parallel by splitting at ``>`` at the start of a line."""
    paths = [path] if isinstance(path, str) else list(path)
    raw = spark.read.option("lineSep", "\n>").text(paths).select("value", F.col("_metadata.file_name").alias("_file"))
    text = F.regexp_replace("value", r"^>", "")
    head = F.trim(F.regexp_replace(F.substring_index(text, "\n", 1), "\r", ""))
    body = F.regexp_replace(F.expr("substring(regexp_replace(value, '^>', ''), length(substring_index(regexp_replace(value, '^>', ''), '\\n', 1)) + 1)"), r"\s+", "")
    x = raw.where(F.length(F.trim("value")) > 0).select(F.regexp_replace("_file", r"\.[^.]*$", "").alias("marker"), head.alias("description"), body.alias("seq"))
    return x.select("marker", accession_of(F.col("description")).alias("record_id"), "description", "seq")


def write_fasta(df: DataFrame, path: str, description: str = "description", seq: str = "seq", mode: str = "errorifexists") -> None:
    """One text file per partition; records are two lines each."""
    df.select(F.concat(F.lit(">"), F.col(description), F.lit("\n"), F.col(seq)).alias("value")).write.mode(mode).text(path)


def write_fasta_by(df: DataFrame, path: str, by: str, description: str = "description", seq: str = "seq", mode: str = "errorifexists") -> None:
    """FASTA files in one folder per value of ``by``."""
    df.select(by, F.concat(F.lit(">"), F.col(description), F.lit("\n"), F.col(seq)).alias("value")).write.mode(mode).partitionBy(by).text(path)


def read_table(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Tab-separated with header and a fixed schema; ``columns`` prunes."""
    df = spark.read.option("sep", "\t").option("header", True).schema(schema).csv(path)
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("sep", "\t").option("header", True).csv(path)


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """(file, parameters): the key/value lines of each file as a map; blank
    lines are skipped, a later key wins."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.split("value", "\t", 2).alias("kv"), F.monotonically_increasing_id().alias("n")).where(F.length(F.trim(F.col("kv")[0])) > 0)
    last = lines.groupBy("file", F.trim(F.col("kv")[0]).alias("key")).agg(F.max_by(F.trim(F.coalesce(F.try_element_at("kv", F.lit(2)), F.lit(""))), "n").alias("value"))
    return last.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("parameters"))


def write_parameters(values: dict[str, str | Sequence[str]], path: str) -> None:
    """A small driver-side file; lists are packed with ``|``."""
    with open(path, "w", encoding="utf-8") as f:
        for k, v in values.items():
            f.write(f"{k}\t{v if isinstance(v, str) else '|'.join(v)}\n")


def expand_paths(paths: str | Sequence[str], suffixes: Sequence[str] = SUFFIXES) -> list[str]:
    """Files of a path, a folder or a list of both: each once, links dropped,
    sorted; the shortest way of writing one is kept."""
    found: dict[str, str] = {}
    for p in [paths] if isinstance(paths, str) else paths:
        names = [os.path.join(p, n) for n in sorted(os.listdir(p))] if os.path.isdir(p) else [p]
        for n in names:
            if not os.path.isfile(n) or n.endswith(".lnk") or not n.endswith(tuple(suffixes)):
                continue
            key = os.path.realpath(n)
            if key not in found or len(n) < len(found[key]):
                found[key] = n
    return sorted(found.values())

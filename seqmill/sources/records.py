"""Writers of fetched records and of partition files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import SEQ_INFO

_TEXT = [x.split()[0] for x in SEQ_INFO.split(", ") if x.split()[1] == "string"]
#: Columns of the metadata relation, in order.
COLUMNS = [x.split()[0] for x in SEQ_INFO.split(", ")]


def seq_info_rows(fetched: DataFrame) -> DataFrame:
    """The 22 metadata columns; missing texts become ``unknown`` and ``length``
    counts A, C, G and T of ``seq`` where it is there."""
    have = set(fetched.columns)
    kinds = dict(x.split() for x in SEQ_INFO.split(", "))
    out = []
    for c in COLUMNS:
        if c == "length" and "seq" in have:
            out.append(F.regexp_count(F.lower("seq"), F.lit("[acgt]")).cast("long").alias(c))
        elif c in have:
            out.append((F.coalesce(F.col(c).cast("string"), F.lit("unknown")) if c in _TEXT else F.col(c).cast(kinds[c])).alias(c))
        else:
            out.append((F.lit("unknown") if c in _TEXT else F.lit(None).cast(kinds[c])).alias(c))
    return fetched.select(*out)


def write_checked(df: DataFrame, path: str, ok: Column, mode: str = "errorifexists") -> None:
    """Good and erroneous records in folders ``is_valid=true`` and ``=false``."""
    df.withColumn("is_valid", F.coalesce(ok, F.lit(False))).write.mode(mode).partitionBy("is_valid").parquet(path)


def partition_lines(codons: DataFrame) -> DataFrame:
    """Configuration lines ``name = start-end\\3;`` of codon partitions."""
    line = F.concat(F.col("name"), F.lit(" = "), F.col("start_col").cast("string"), F.lit("-"), F.col("end_col").cast("string"), F.lit("\\"), F.col("step").cast("string"), F.lit(";"))
    return codons.select("name", line.alias("line"))


def first_word(description: Column) -> Column:
    """Header without its comment."""
    return F.substring_index(description, " ", 1)


def without_blanks(description: Column) -> Column:
    return F.replace(description, F.lit(" "), F.lit(""))

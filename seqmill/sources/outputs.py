"""Outputs of a run: backups, stages passed by a check, records by marker.

Folders are moved by the file system that holds them, so any shared one will do.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.sequence import underscored


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _move(spark: SparkSession, source: str, target: str) -> None:
    fs, a = _at(spark, source)
    _, b = _at(spark, target)
    if fs.exists(b):
        raise FileExistsError(target)
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"{source} cannot be moved to {target}")


def backup(spark: SparkSession, folder: str, names: Sequence[str]) -> str | None:
    """Moves former outputs ``names`` of ``folder`` to ``history_backup`` under the
    modification time of the first of them; its path, or None if there were none."""
    target = None
    for name in names:
        fs, p = _at(spark, f"{folder}/{name}")
        if not fs.exists(p):
            continue
        if target is None:
            at = datetime.fromtimestamp(fs.getFileStatus(p).getModificationTime() / 1000, timezone.utc)
            target = f"{folder}/history_backup/{at:%Y-%m-%d.%H.%M.%S}"
        _move(spark, f"{folder}/{name}", f"{target}/{name}")
    return target


def accept_controlled(spark: SparkSession, folder: str, controlled: str, checked: str) -> None:
    """The controlled output takes the place of the checked one, which is kept
    under ``not_controlled``. Nothing happens without a controlled one."""
    fs, new = _at(spark, f"{folder}/{controlled}")
    if not fs.exists(new):
        return
    if fs.exists(_at(spark, f"{folder}/{checked}")[1]):
        _move(spark, f"{folder}/{checked}", f"{folder}/not_controlled/{checked}")
    _move(spark, f"{folder}/{controlled}", f"{folder}/{checked}")


def collected(markers: dict[str, DataFrame], organism: str = "organism", seq: str = "seq") -> DataFrame:
    """(marker, description, seq): records of all markers, described by their taxon."""
    parts = [df.select(F.lit(m).alias("marker"), underscored(F.col(organism)).alias("description"), F.col(seq).alias("seq")) for m, df in sorted(markers.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def per_marker(records: DataFrame, markers: Sequence[str], run: Callable[[DataFrame, str], DataFrame], marker: str = "marker") -> DataFrame:
    """``run`` on the records of each of a few markers, with a marker column."""
    out: DataFrame | None = None
    for m in markers:
        part = run(records.where(F.col(marker) == m).drop(marker), m).withColumn(marker, F.lit(m))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no markers")
    return out


def write_sorted(df: DataFrame, path: str, by: Sequence[Column | str], mode: str = "errorifexists") -> None:
    """Parquet files in a global order, range-partitioned, not through one task."""
    keys = [F.col(c) if isinstance(c, str) else c for c in by]
    df.orderBy(*keys).write.mode(mode).parquet(path)

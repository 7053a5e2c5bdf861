"""Session helpers shared by all operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: A side is broadcast only below this many rows and bytes (counted, not estimated).
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazily open one parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: ``spark.checkpoint.dir`` of the session, else a
    local one, but that only where the master is local: on a cluster it would lie
    on each machine's own disk, so it is refused there."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if path is None:
        path = sc.getCheckpointDir()
    if path is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        path = tempfile.mkdtemp(prefix="seqmill-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    The plan runs once and survives the loss of executors, unlike a cache or a
    local checkpoint.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _bytes(value: Column, kind: DataType) -> Column:
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(kind, (ArrayType, MapType, StructType)):
        return F.coalesce(F.octet_length(F.to_json(value)), F.lit(0))
    return F.lit(8)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """True if ``df`` has at most ``rows`` rows of ``size`` bytes; looks at no more rows."""
    total = F.lit(0).cast("long")
    for i, f in enumerate(df.schema):
        total = total + _bytes(F.col(f"c{i}"), f.dataType)
    got = df.toDF(*[f"c{i}" for i in range(len(df.columns))]).limit(rows + 1).agg(F.count(F.lit(1)), F.sum(total)).first()
    return got[0] <= rows and (got[1] or 0) <= size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted size permits, else as it is
    (a shuffled join then)."""
    return F.broadcast(df) if is_small(df, rows) else df


_SHUFFLES = re.compile(r"\b(?:Join|Aggregate|Repartition\w*|RebalancePartitions|Window|Sort|Deduplicate|Distinct|Intersect|Except)\b")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the input has fewer splits than there are.

    So few splits mean a small input, hence the shuffle is small; a large input
    has more splits than cores and stays as it is. A plan with a shuffle of its
    own stays too: to ask for its partitions would run it.
    """
    if _SHUFFLES.search(df._jdf.queryExecution().optimizedPlan().toString()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

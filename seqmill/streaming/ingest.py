"""Incremental ingest of newly arriving hit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.hits import new_hits
from ..operators.records import first_rows
from ..schemas import HIT_TABLE


def stream_hits(spark: SparkSession, folder: str, fmt: str = "parquet", schema: str = HIT_TABLE) -> DataFrame:
    """Hit tables that arrive as files in a folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64)
    return reader.option("sep", "\t").option("header", True).csv(folder) if fmt == "tsv" else reader.format(fmt).load(folder)


def keep_new(stream: DataFrame, target: str, checkpoint: str, key: str = "subject_acc", order: tuple[str, ...] = ("query_acc", "s_start", "s_end")) -> StreamingQuery:
    """Append to ``target``, per batch, the first row of each accession that it
    does not hold yet. A batch number that was written before is written again
    to the same place, so a restart adds nothing twice."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mine = first_rows(batch.where(f"{key} is not null"), [key], list(order))
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            known = spark.read.parquet(target)
            if "batch" in known.columns:
                mine = new_hits(mine, known.where(known["batch"] != number), key)
        mine.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Counts and exact medians per key where a few keys hold most records.

Dense accumulator arrays: keys are dictionary-encoded inside each input split,
counts are scattered into arrays by ``numpy`` and the array blocks of all
splits are summed by key and block of ``WIDTH`` consecutive values. Splits are
equal shares of the input whatever the keys, and what leaves a split is bounded
by its distinct (key, value) pairs, so a key with a third of all rows costs no
task more than any other.

The median of a key is found by its blocks' totals: the block in which the
middle row falls, then the value in that block's array. No step holds a key's
rows; the longest list per key is that of its value blocks, and those are
walked in a window that spills.

Defined results: null keys give no row; rows with a null value count in
``n_rows`` but not for the middle; a key with only null values has a null
middle; of two middle values the lower is taken; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import IntegralType

#: Values per accumulator array.
WIDTH = 256
#: Rows held by a split before its accumulators are written out.
FLUSH = 1_000_000
#: Array cells held by a summing task at a time.
CELLS = 4_000_000
#: Splits whose arrays meet at once.
FAN = 1024
#: Block number of the rows without a value.
_NO_VALUE = -(2**62)


def _runs(*columns: np.ndarray) -> np.ndarray:
    change = np.ones(len(columns[0]), bool)
    if len(change):
        change[1:] = False
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values, kind))


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A split's counts: (key, block, offsets, counts), one row per array."""
    held: list[tuple] = []
    rows = 0

    def flush() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        encoded = table.column(0).combine_chunks().dictionary_encode()
        if isinstance(encoded, pa.ChunkedArray):
            encoded = encoded.combine_chunks()
        codes = encoded.indices.to_numpy().astype(np.int64)
        null = np.asarray(pc.is_null(table.column(1)))
        values = table.column(1).fill_null(0).to_numpy()
        block = np.where(null, _NO_VALUE, values // WIDTH)
        offset = np.where(null, 0, values % WIDTH)
        low, span = int(values[~null].min()) if (~null).any() else 0, 0
        if (~null).any():
            span = int(values[~null].max()) - low + 1
        size = len(encoded.dictionary) * max(span, 1)
        if size <= 4 * len(codes) and not null.any():
            dense = np.bincount(codes * span + (values - low), minlength=size)
            cell = np.flatnonzero(dense)
            counts, codes, values = dense[cell], cell // span, cell % span + low
            block, offset = values // WIDTH, values % WIDTH
        else:  # too sparse for one array: scatter-reduce over the sorted cells
            order = np.lexsort((offset, block, codes))
            codes, block, offset = codes[order], block[order], offset[order]
            at = _runs(codes, block, offset)
            counts = np.diff(np.append(at, len(codes)))
            codes, block, offset = codes[at], block[at], offset[at]
        at = _runs(codes, block)
        return pa.RecordBatch.from_arrays(
            [encoded.dictionary.take(pa.array(codes[at])), pa.array(block[at], pa.int64()), _lists(offset, at, pa.int32()), _lists(counts, at, pa.int64())],
            names=["k", "block", "offsets", "counts"],
        )

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= FLUSH:
            yield flush()
            held, rows = [], 0
    if held:
        yield flush()


def _sum(table: pa.Table) -> pa.Table:
    """One array for each (key, block); equal ones stand together."""
    table = table.combine_chunks()
    keys = table.column("k").combine_chunks().dictionary_encode()
    codes, block = keys.indices.to_numpy(), table.column("block").to_numpy()
    at = _runs(codes, block)
    group = np.zeros(len(codes), np.int64)
    group[at[1:]] = 1
    group = np.cumsum(group)
    offsets, counts = table.column("offsets").combine_chunks(), table.column("counts").combine_chunks()
    owner = np.repeat(group, np.asarray(pc.list_value_length(offsets)))
    cells, inverse = np.unique(owner * WIDTH + offsets.flatten().to_numpy(), return_inverse=True)
    sums = np.zeros(len(cells), np.int64)
    np.add.at(sums, inverse, counts.flatten().to_numpy())
    owner = cells // WIDTH
    first = _runs(owner)
    return pa.table(
        {
            "k": table.column("k").take(pa.array(at)),
            "block": table.column("block").take(pa.array(at)),
            "total": pa.array(np.add.reduceat(sums, first), pa.int64()),
            "offsets": _lists(cells % WIDTH, first, pa.int32()),
            "counts": _lists(sums, first, pa.int64()),
        }
    )


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums array blocks of equal (key, block); the input is sorted by them. A
    piece of the stream is summed at a time, and of what goes on in the next piece
    one array is carried, whatever the number of splits."""
    rest: pa.Table | None = None
    columns = ["k", "block", "offsets", "counts"]
    most = CELLS // WIDTH
    for batch in batches:
        for lo in range(0, batch.num_rows, most):
            piece = pa.Table.from_batches([batch.slice(lo, most)]).select(columns)
            summed = _sum(piece if rest is None else pa.concat_tables([rest, piece]))
            rest = summed.slice(summed.num_rows - 1).select(columns)
            yield from summed.slice(0, summed.num_rows - 1).to_batches()
    if rest is not None:
        yield from _sum(rest).to_batches()


def _add_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_add`` for the arrays of each group of splits ``s``."""

    def of_one(s: int, pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _add(pieces):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(b.num_rows, s), pa.int64()), b.column(3), b.column(4)], names=["k", "block", "s", "offsets", "counts"])

    for batch in batches:
        groups = batch.column(2).to_numpy()
        for s in np.unique(groups).tolist():
            mine = batch.filter(pa.array(groups == s))
            yield from of_one(s, iter([pa.RecordBatch.from_arrays([mine.column(i) for i in (0, 1, 3, 4)], names=["k", "block", "offsets", "counts"])]))


def key_figures(
    df: DataFrame, key: str = "taxon_name", value: str = "record_length", count_as: str = "n_rows", middle_as: str = "mid_length", fan: int = FAN
) -> DataFrame:
    """``key``, rows per key, and the lower middle of ``value`` per key. ``value``
    is a column of whole numbers."""
    if not isinstance(df.schema[value].dataType, IntegralType):
        raise TypeError(f"{value} is no column of whole numbers")
    src = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("long").alias("v"))
    kind = src.schema["k"].dataType.simpleString()
    arrays = f"k {kind}, block long, offsets array<int>, counts array<bigint>"
    summed = f"k {kind}, block long, total long, offsets array<int>, counts array<bigint>"
    blocks = src.mapInArrow(_accumulate, arrays)
    width = src.rdd.getNumPartitions()
    split = F.spark_partition_id()
    while width > fan:
        # the arrays of one key and block from very many splits meet in groups of splits first
        salted = blocks.withColumn("s", F.floor(split / fan))
        salted = salted.repartition("k", "block", "s").sortWithinPartitions("k", "block", "s").select("k", "block", "s", "offsets", "counts")
        blocks = salted.mapInArrow(_add_within, f"k {kind}, block long, s long, offsets array<int>, counts array<bigint>")
        split, width = F.col("s"), -(-width // fan)
    blocks = blocks.select("k", "block", "offsets", "counts").repartition("k", "block").sortWithinPartitions("k", "block").mapInArrow(_add, summed)
    of_key = W.partitionBy("k").orderBy("block")
    whole = of_key.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    valued = F.when(F.col("block") != _NO_VALUE, F.col("total"))
    walked = blocks.select(
        "*", F.sum(valued).over(of_key.rowsBetween(W.unboundedPreceding, 0)).alias("upto"), F.sum("total").over(whole).alias("n"), F.sum(valued).over(whole).alias("n_valued")
    )
    rank = F.floor((F.col("n_valued") + 1) / 2)
    before = F.col("upto") - F.col("total")
    hit = walked.where(((F.col("block") != _NO_VALUE) & (before < rank) & (rank <= F.col("upto"))) | F.col("n_valued").isNull())
    found = F.aggregate(
        F.arrays_zip("offsets", "counts"),
        F.struct((rank - before).cast("long").alias("left"), F.lit(-1).cast("long").alias("at")),
        lambda acc, x: F.struct(
            (acc["left"] - x["counts"]).alias("left"),
            F.when((acc["at"] < 0) & (acc["left"] <= x["counts"]), x["offsets"].cast("long")).otherwise(acc["at"]).alias("at"),
        ),
    )["at"]
    return hit.select(
        F.col("k").alias(key),
        F.col("n").cast("long").alias(count_as),
        F.when(F.col("n_valued").isNotNull(), F.col("block") * WIDTH + found).cast("long").alias(middle_as),
    )

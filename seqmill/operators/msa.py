"""Column statistics, consensus, identities and distances of alignments.

An alignment is a set of rows (aln_id, seq_id, seq) of equal length. Column
figures are counts per (alignment, column), aggregated map-side, so a large
alignment is no bottleneck. Pair figures compare packed strings: pairs come
from an equi-join on the alignment with i < j, a pair is one row, and its
letters are never exploded.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.sequence import blank_end_gaps
from ..iupac import BASES, CODE_OF, PAIR_SCORE, TWELFTHS, code_map
from ..runtime import broadcast_if_small, cut

_GAP = ord("-")
#: Letters of a part of a set of alignments, numbers that a task holds before it sums them up, and bytes of rows looked at at once.
PART = 1 << 21
MEETINGS = 500_000
LETTERS = 1 << 24
#: Rows of a block, two of which are compared at once, and columns taken at a time.
BLOCK, SLICE = 512, 2048
#: Stands for an empty sequence.
_EMPTY = "\U0010ffff"


def cells(aln: DataFrame) -> DataFrame:
    """(aln_id, seq_id, col, base), columns from 1."""
    return aln.select("aln_id", "seq_id", F.posexplode(F.split("seq", "")).alias("p", "base")).select("aln_id", "seq_id", (F.col("p") + 1).cast("long").alias("col"), "base")


def with_ordinals(aln: DataFrame) -> DataFrame:
    """Cells with the running number of their residue, 0 for a gap."""
    kinds = {f.name: f.dataType.simpleString() for f in aln.select("aln_id", "seq_id").schema}

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a running sum over a row's letters: linear, unlike a fold that builds arrays
        for batch in batches:
            found = [np.array([c != "-" for c in s], bool) for s in batch.column(2).to_pylist()]
            ordinals = [np.where(f, np.cumsum(f), 0) for f in found]
            ends = np.cumsum([0, *map(len, ordinals)])
            flat = np.concatenate(ordinals) if ordinals else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))], names=["aln_id", "seq_id", "seq", "o"])

    rows = aln.select("aln_id", "seq_id", F.col("seq").cast("string").alias("seq")).where("seq is not null")
    x = rows.mapInArrow(number, f"aln_id {kinds['aln_id']}, seq_id {kinds['seq_id']}, seq string, o array<bigint>")
    x = x.select("aln_id", "seq_id", "seq", F.posexplode("o").alias("p", "ordinal"))
    return x.select("aln_id", "seq_id", (F.col("p") + 1).cast("long").alias("col"), F.substring("seq", F.col("p") + 1, F.lit(1)).alias("base"), "ordinal")


def check_alignment(aln: DataFrame) -> DataFrame:
    """Per alignment: rows, distinct lengths (0 length: empty; more than one:
    not aligned), and rows with other than letters and punctuation."""
    return aln.groupBy("aln_id").agg(
        F.count(F.lit(1)).alias("n_seqs"),
        F.count_distinct(F.length("seq")).alias("n_lengths"),
        F.max(F.length("seq")).cast("long").alias("max_length"),
        F.count_if(~F.col("seq").rlike(r"^[\p{L}\p{P}\p{S}]*$")).alias("n_bad"),
    )


def column_gaps(aln: DataFrame) -> DataFrame:
    """Gaps, indeterminates (N or X) and rows per column."""
    return cells(aln).groupBy("aln_id", "col").agg(
        F.count_if(F.col("base") == "-").alias("gaps"), F.count_if(F.upper("base").isin("N", "X")).alias("indeterminate"), F.count(F.lit(1)).alias("n_seqs")
    )


def gap_histogram(aln: DataFrame) -> DataFrame:
    """Columns per number of gaps, with the running share of columns."""
    h = column_gaps(aln).groupBy("aln_id", "gaps").agg(F.count(F.lit(1)).alias("n_columns"))
    of = W.partitionBy("aln_id")  # a row per number of gaps, not per column
    return h.withColumn("n_upto", F.sum("n_columns").over(of.orderBy("gaps").rowsBetween(W.unboundedPreceding, 0)))


def windowed_gaps(aln: DataFrame, half: int) -> DataFrame:
    """Moving mean of the gap counts, borders mirrored, rounded half up.

    Alignments with fewer than 4 * half columns give nothing.
    """
    g = column_gaps(aln).select("aln_id", "col", "gaps")
    n = g.groupBy("aln_id").agg(F.max("col").alias("n_cols")).where(F.col("n_cols") >= 4 * half)
    g = g.join(n, "aln_id")
    # each column gives its count to all windows that see it, also mirrored at a border
    at = F.explode(F.sequence(F.col("col") - half, F.col("col") + half))
    seen = g.select("aln_id", "n_cols", "gaps", at.alias("target"))
    left = g.where((F.col("col") >= 2) & (F.col("col") <= half + 1)).select("aln_id", "n_cols", "gaps", F.explode(F.sequence(2 - F.col("col") - half, 2 - F.col("col") + half)).alias("target"))
    right = g.where((F.col("col") >= F.col("n_cols") - half) & (F.col("col") <= F.col("n_cols") - 1)).select(
        "aln_id", "n_cols", "gaps", F.explode(F.sequence(2 * F.col("n_cols") - F.col("col") - half, 2 * F.col("n_cols") - F.col("col") + half)).alias("target")
    )
    every = seen.unionByName(left).unionByName(right).where(F.col("target").between(1, F.col("n_cols")))
    return every.groupBy("aln_id", F.col("target").alias("col")).agg(F.floor(F.sum("gaps") / (2 * half + 1) + 0.5).cast("long").alias("window_gaps"))


def consensus_columns(aln: DataFrame, blank_ends: bool = True) -> DataFrame:
    """Consensus base of each column.

    Bases and the gap have votes, wildcards share theirs (in whole twelfths, so
    ties are exact). One winner: itself; several with a gap among them: N;
    several bases: their code; no votes at all: N. End gaps do not vote.
    """
    a = aln.withColumn("seq", blank_end_gaps(F.col("seq"))) if blank_ends else aln
    c = cells(a).withColumn("base", F.upper("base")).groupBy("aln_id", "col", "base").agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("base", F.translate("base", "U", "T"))
    votes = []
    for b in "ACGT":
        weight = code_map({code: TWELFTHS[code] for code, bases in BASES.items() if b in bases})
        votes.append(F.coalesce(F.sum(F.coalesce(F.try_element_at(weight, F.col("base")), F.lit(0)) * F.col("n")), F.lit(0)).alias(b))
    votes.append(F.coalesce(F.sum(F.when(F.col("base") == "-", F.lit(12) * F.col("n"))), F.lit(0)).alias("gap"))
    v = c.groupBy("aln_id", "col").agg(*votes).withColumn("top", F.greatest(*"ACGT", "gap"))
    best = F.concat(*[F.when(F.col(b) == F.col("top"), F.lit(b)).otherwise(F.lit("")) for b in "ACGT"])
    gap = F.col("gap") == F.col("top")
    base = F.when(F.col("top") == 0, "N").when(gap & (best != ""), "N").when(gap, "-").otherwise(F.try_element_at(code_map(CODE_OF), best))
    return v.select("aln_id", "col", base.alias("consensus"))


def consensus_sequence(aln: DataFrame) -> DataFrame:
    """Consensus of each alignment; of a single row its own sequence."""
    cols = consensus_columns(aln).groupBy("aln_id").agg(F.array_sort(F.collect_list(F.struct("col", "consensus"))).alias("c"))
    joined = F.array_join(F.transform("c", lambda x: x["consensus"]), "")
    single = aln.groupBy("aln_id").agg(F.count(F.lit(1)).alias("n"), F.first("seq").alias("own"))
    return cols.join(single, "aln_id").select("aln_id", F.when(F.col("n") == 1, F.col("own")).otherwise(joined).alias("consensus"))


def _tasks(df: DataFrame) -> int:
    """Partitions to ask for: a number given is kept, so that few rows are spread over all cores too."""
    session = df.sparkSession
    return max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))


def pairs(aln: DataFrame) -> DataFrame:
    """All pairs i < j of each alignment, as packed strings."""
    rows = aln.select("aln_id", "seq_id", "seq").repartition(_tasks(aln), "aln_id")
    a = rows.select("aln_id", F.col("seq_id").alias("i"), F.col("seq").alias("a"))
    b = rows.select("aln_id", F.col("seq_id").alias("j"), F.col("seq").alias("b"))
    return a.join(b, "aln_id").where("i < j")


def _zip(f) -> Column:
    return F.zip_with(F.split("a", ""), F.split("b", ""), f)


def _count(f) -> Column:
    return F.aggregate(_zip(lambda x, y: f(x, y).cast("int")), F.lit(0), lambda s, v: s + v)


def p_distance(aln: DataFrame) -> DataFrame:
    """Share of differing columns; a gap in both agrees."""
    d = _count(lambda x, y: x != y) / F.length("a")
    return pairs(aln).select("aln_id", "i", "j", F.when(F.length("a") == 0, 0.0).otherwise(d).alias("p_distance"))


def pairwise_identity(aln: DataFrame, ends: str = "full", percent: bool = True) -> DataFrame:
    """Mean equality score over columns without a double gap.

    ``ends``: ``full`` takes all columns; ``shared`` the span both cover;
    ``legacy`` the same without its last column. An empty span gives 0. An
    Arrow kernel: the scores are a table that no expression looks up fast.
    """
    p = pairs(aln).select("aln_id", "i", "j", "a", "b")
    kinds = {f.name: f.dataType.simpleString() for f in p.schema}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pair_table()
        for batch in batches:
            values = [identity(table, a, b, ends, percent) for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(values, pa.float64())], names=["aln_id", "i", "j", "identity"])

    return p.mapInArrow(measure, f"aln_id {kinds['aln_id']}, i {kinds['i']}, j {kinds['j']}, identity double")


def pair_table() -> np.ndarray:
    """Equality scores of all pairs of characters."""
    table = np.zeros((256, 256))
    for pair, score in PAIR_SCORE.items():
        table[ord(pair[0]), ord(pair[1])] = score
    for x, y in (("u", "T"), ("U", "T"), *((c.lower(), c) for c in BASES)):
        table[ord(x)] = table[ord(y)]
    for x, y in (("u", "T"), ("U", "T"), *((c.lower(), c) for c in BASES)):
        table[:, ord(x)] = table[:, ord(y)]
    return table


def identity(table: np.ndarray, a: str, b: str, ends: str = "full", percent: bool = True) -> float:
    x, y = (np.frombuffer(s.encode("ascii", "replace"), np.uint8) for s in (a, b))
    if ends != "full":
        full = [np.flatnonzero(v != _GAP) for v in (x, y)]
        if not len(full[0]) or not len(full[1]):
            return 0.0
        lo = max(full[0][0], full[1][0])
        hi = min(full[0][-1], full[1][-1]) + (1 if ends == "shared" else 0)
        x, y = x[lo:hi], y[lo:hi]
    n = int(((x != _GAP) | (y != _GAP)).sum())
    if not n:
        return 0.0
    total = float(table[x, y].sum())
    return total / n if percent else total


def mean_identity(aln: DataFrame, **how: object) -> DataFrame:
    return pairwise_identity(aln, **how).groupBy("aln_id").agg(F.round(F.avg("identity"), 6).alias("mean_identity"))


def distances(aln: DataFrame) -> DataFrame:
    return pairwise_identity(aln).select("aln_id", "i", "j", (1 - F.col("identity")).alias("distance"))


def _letters(seqs: list[str | None], width: int) -> np.ndarray:
    """One row of code points per sequence, filled with gaps; an empty sequence is one letter of its own."""
    text = "".join((s or _EMPTY).ljust(width, "-") for s in seqs)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(seqs), width)
    return codes.astype(np.uint8) if codes.max(initial=0) < 256 else codes


def determined(x: list[str | None], y: list[str | None], indet: str = "N") -> np.ndarray:
    """Equal columns among those where either row is determined, of each row of
    ``x`` with each of ``y``; NaN where there is no such column. Counts of equal
    letters are products of matrices that mark each letter's places."""
    width = max(len(s or _EMPTY) for s in (*x, *y))
    same, neither = np.zeros((len(x), len(y))), np.zeros((len(x), len(y)))
    a, b = _letters(x, width), _letters(y, width)
    for lo in range(0, width, SLICE):
        p, q = a[:, lo : lo + SLICE], b[:, lo : lo + SLICE]
        # the few letters of an alignment, and of each only the columns where both sides have it
        kinds = np.flatnonzero(np.bincount(p.ravel(), minlength=256) * np.bincount(q.ravel(), minlength=256)) if p.dtype == q.dtype == np.uint8 else np.intersect1d(p, q)
        left, right = [], []
        for k in kinds:
            if k not in (_GAP, ord(indet)):
                u, v = p == k, q == k
                at = u.any(0) & v.any(0)
                left.append(u[:, at]), right.append(v[:, at])
        if left:
            same += np.hstack(left).astype(np.float32) @ np.hstack(right).astype(np.float32).T
        u, v = ((z == _GAP) | (z == ord(indet)) for z in (p, q))
        neither += u.astype(np.float32) @ v.astype(np.float32).T
    n = width - neither
    ratio = np.divide(same, n, out=np.full(n.shape, np.nan), where=n > 0)
    ratio[[s is None for s in x]] = np.nan
    ratio[:, [s is None for s in y]] = np.nan
    return ratio


def _blocks(aln: DataFrame) -> DataFrame:
    """(aln_id, p, q, left, right, seq_id, seq): the rows of every two blocks p <= q of an
    alignment, together and one after the other; any two rows meet in one such
    place. ``left``, ``right``: the block that the row belongs to."""
    rows = aln.where("aln_id is not null and seq_id is not null").select("aln_id", "seq_id", F.col("seq").cast("string").alias("seq"))
    n = F.count(F.lit(1))
    size = rows.groupBy("aln_id").agg(F.least(n, F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(n * F.max(F.coalesce(F.length("seq"), F.lit(0))) / F.lit(PART)))).alias("_n"))
    own = F.pmod(F.xxhash64("seq_id"), F.col("_n"))
    met = rows.join(size, "aln_id").select("aln_id", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("other"), "seq_id", "seq")
    p, q = F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")
    met = met.select("aln_id", p, q, (F.col("own") <= F.col("other")).alias("left"), (F.col("own") >= F.col("other")).alias("right"), "seq_id", "seq")
    return met.repartition(_tasks(aln), "aln_id", "p", "q").sortWithinPartitions("aln_id", "p", "q")


def _compared(batches: Iterator[pa.RecordBatch], indet: str) -> Iterator[tuple]:
    """Of every two blocks: their alignment, the rows' ids in order without
    repeats (as Arrow values), places in them of the left and of the right rows,
    identities, and which of these are pairs."""

    def compared(aln_id: object, rows: list[tuple]) -> tuple:
        names = sorted({r[2] for r in rows})
        at = {x: i for i, x in enumerate(names)}
        left, right = [r for r in rows if r[0]], [r for r in rows if r[1]]
        x, y = (np.array([at[r[2]] for r in side], np.int64) for side in (left, right))
        ratio = determined([r[3] for r in left], [r[3] for r in right], indet)
        # within one block each two rows meet twice
        pairs = x[:, None] < y[None, :] if all(r[0] and r[1] for r in rows) else x[:, None] != y[None, :]
        return pa.scalar(aln_id, kinds[0]), pa.array(names, kinds[5]), x, y, ratio, pairs

    unit, rows, kinds = None, [], []
    for batch in batches:
        kinds = batch.schema.types
        for aln_id, p, q, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (aln_id, p, q) != unit:
                if any(r[0] for r in rows) and any(r[1] for r in rows):
                    yield compared(unit[0], rows)
                unit, rows = (aln_id, p, q), []
            rows.append(row)
    if any(r[0] for r in rows) and any(r[1] for r in rows):
        yield compared(unit[0], rows)


def determined_identity(aln: DataFrame, indet: str = "N") -> DataFrame:
    """Equal columns among those where either row is determined; and the
    trimmer's distance in percent."""
    rows = _blocks(aln)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for aln_id, names, x, y, ratio, pairs in _compared(batches, indet):
            for lo in range(0, len(x), step := max(1, 65_536 // len(y))):
                i, j = np.nonzero(pairs[lo : lo + step])
                v, k, m = ratio[lo + i, j], x[lo + i], y[j]
                yield pa.RecordBatch.from_arrays([pa.repeat(aln_id, len(i)), names.take(pa.array(np.minimum(k, m))), names.take(pa.array(np.maximum(k, m))), pa.array(v, mask=np.isnan(v))], names=["aln_id", "i", "j", "identity"])

    x = rows.mapInArrow(measure, f"aln_id {kinds['aln_id']}, i {kinds['seq_id']}, j {kinds['seq_id']}, identity double")
    return x.select("aln_id", "i", "j", "identity", (100 - 100 * F.col("identity")).alias("distance_pct"))


def identity_summary(aln: DataFrame) -> DataFrame:
    """Mean identity and mean of each row's greatest one. Pairs are summed up
    where they are compared, none is written."""
    rows = _blocks(aln)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for aln_id, names, x, y, ratio, pairs in _compared(batches, "N"):
            known = pairs & ~np.isnan(ratio)
            for places, axis in ((x, 1), (y, 0)):
                met = pairs.any(axis)
                n, most = known.sum(axis)[met], np.where(known, ratio, -1).max(axis, initial=-1)[met]
                arrays = [pa.repeat(aln_id, len(n)), names.take(pa.array(places[met])), pa.array(np.where(known, ratio, 0).sum(axis)[met]), pa.array(n.astype(np.int64)), pa.array(most, mask=n == 0)]
                yield pa.RecordBatch.from_arrays(arrays, names=["aln_id", "i", "total", "n", "most"])

    x = rows.mapInArrow(total, f"aln_id {kinds['aln_id']}, i {kinds['seq_id']}, total double, n long, most double")
    of = x.groupBy("aln_id", "i").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("most").alias("most"))
    mean = F.when(F.col("n") > 0, F.col("total") / F.col("n"))
    return of.groupBy("aln_id").agg(F.round(F.avg(mean), 6).alias("mean_identity"), F.round(F.avg("most"), 6).alias("mean_max_identity"))


def sum_of_pairs(aln: DataFrame, transition: float = -1.0, transversion: float = -2.0, gap_open: float = -2.0, gap_extend: float = -1.0) -> DataFrame:
    """Sum-of-pairs score: per column from its base counts, without pairs, minus
    each row's interior gap runs."""
    c = cells(aln).withColumn("base", F.translate(F.upper("base"), "U", "T")).groupBy("aln_id", "col", "base").agg(F.count(F.lit(1)).alias("n"))
    pyrimidine = F.lit("CTY")
    a, b = c.alias("a"), c.alias("b")
    both = a.join(b, ["aln_id", "col"]).where("a.base <= b.base and a.base <> '-' and b.base <> '-'")
    times = F.when(F.col("a.base") == F.col("b.base"), F.col("a.n") * (F.col("a.n") - 1) / 2).otherwise(F.col("a.n") * F.col("b.n"))
    match = F.coalesce(F.try_element_at(code_map(PAIR_SCORE), F.concat("a.base", "b.base")), F.lit(0.0))
    same_kind = F.contains(pyrimidine, F.col("a.base")) == F.contains(pyrimidine, F.col("b.base"))
    columns = both.groupBy("aln_id").agg(F.sum(times * F.when(match > 0, match).when(same_kind, transition).otherwise(transversion)).alias("columns"))
    inner = F.regexp_replace("seq", "^-+|-+$", "")
    runs = aln.select("aln_id", F.regexp_count(inner, F.lit("-+")).alias("runs"), F.regexp_count(inner, F.lit("-")).alias("letters"))
    gaps = runs.groupBy("aln_id").agg(F.sum(F.col("runs") * gap_open + (F.col("letters") - F.col("runs")) * gap_extend).alias("gaps"))
    return gaps.join(columns, "aln_id", "left").select("aln_id", (F.coalesce("columns", F.lit(0.0)) + F.col("gaps")).alias("score"))


def overlap_values(aln: DataFrame, overlap: float, indet: str = "N") -> DataFrame:
    """Share of columns in which a row has enough comparable partners, from the
    columns' counts alone."""
    c = cells(aln)
    counts = c.groupBy("aln_id", "col").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("base") == "-").alias("g"), F.count_if(F.col("base") == indet).alias("x")
    )
    partners = F.when(F.col("base") == "-", F.col("g") - 1).when(F.col("base") == indet, F.col("x") - 1).otherwise(F.col("n") - F.col("g") - F.col("x") - 1)
    need = F.ceil(F.lit(overlap) * (F.col("n") - 1))
    return c.join(counts, ["aln_id", "col"]).groupBy("aln_id", "seq_id").agg(F.round(F.count_if(partners >= need) / F.count(F.lit(1)), 6).alias("overlap"))


def common_ends(aln: DataFrame) -> DataFrame:
    """Leftmost and rightmost column without a gap, null if there is none."""
    full = F.when(F.col("gaps") == 0, F.col("col"))
    return column_gaps(aln).groupBy("aln_id").agg(F.min(full).alias("left_col"), F.max(full).alias("right_col"))


def insertion_islands(aln: DataFrame, taxa_threshold: int = 1, length_threshold: int = 20) -> DataFrame:
    """Runs of at least ``length_threshold`` columns that at most
    ``taxa_threshold`` rows fill."""
    rare = column_gaps(aln).where(F.col("gaps") >= F.col("n_seqs") - taxa_threshold)
    w = W.partitionBy("aln_id").orderBy("col")
    runs = rare.withColumn("_i", F.col("col") - F.row_number().over(w)).groupBy("aln_id", "_i").agg(F.min("col").alias("first_col"), F.max("col").alias("last_col"))
    return runs.where(F.col("last_col") - F.col("first_col") + 1 >= length_threshold).drop("_i")


def without_columns(aln: DataFrame, cut: DataFrame) -> DataFrame:
    """Rows without the column ranges (aln_id, first_col, last_col), all of them."""
    ranges = cut.groupBy("aln_id").agg(F.collect_list(F.struct("first_col", "last_col")).alias("_cut"))
    letters = F.transform(F.split("seq", ""), lambda c, i: F.struct(c.alias("c"), (i + 1).alias("i")))
    kept = F.filter(letters, lambda x: ~F.exists("_cut", lambda r: x["i"].between(r["first_col"], r["last_col"])))
    seq = F.array_join(F.transform(kept, lambda x: x["c"]), "")
    return aln.join(ranges, "aln_id", "left").withColumn("seq", F.when(F.col("_cut").isNull(), F.col("seq")).otherwise(seq)).drop("_cut")


def remove_insertions(aln: DataFrame, taxa_threshold: int = 1, length_threshold: int = 20, legacy_last_only: bool = False) -> DataFrame:
    """Cut rare long insertions out of all rows; ``legacy_last_only`` cuts only
    the last one of each alignment."""
    islands = insertion_islands(aln, taxa_threshold, length_threshold)
    if legacy_last_only:
        islands = islands.groupBy("aln_id").agg(F.max(F.struct("first_col", "last_col")).alias("m")).select("aln_id", "m.first_col", "m.last_col")
    return without_columns(aln, islands)


def _runs(seq: pa.Array) -> pa.Array:
    """Of each row its runs of residues: pairs (column of the first, from 1; length) as 32-bit numbers."""
    seq = seq.cast(pa.large_string())
    off = np.frombuffer(seq.buffers()[1], np.int64)[seq.offset : seq.offset + len(seq) + 1]
    raw = np.frombuffer(seq.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    if len(raw) and raw.max() > 127:
        begins = (raw & 0xC0) != 0x80  # a letter of several bytes is one column
        off, raw = np.concatenate([[0], np.cumsum(begins)])[off], raw[begins]
    found = raw != _GAP
    first, last = found.copy(), found.copy()
    first[1:] &= ~found[:-1]
    last[:-1] &= ~found[1:]
    edges = off[:-1][off[:-1] < off[1:]]
    first[edges] = found[edges]
    edges = off[1:][off[:-1] < off[1:]] - 1
    last[edges] = found[edges]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(off, starts, "right") - 1
    values = np.stack([starts - off[row] + 1, ends - starts], axis=1).astype(np.int32)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(seq)))]) * 8
    return pa.Array.from_buffers(pa.large_binary(), len(seq), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(values.tobytes())]).cast(pa.binary())


class _Runs:
    """Runs of rows, as ``_runs`` gives them, side by side: those of row r stand
    from ``off[r]`` to ``off[r + 1]``; ``ordinal`` is the number, from 0, of the
    residue that a run begins with, and ``n`` has the rows' residues."""

    def __init__(self, runs: pa.Array):
        runs = runs.cast(pa.large_binary())
        off = np.frombuffer(runs.buffers()[1], np.int64)[runs.offset : runs.offset + len(runs) + 1]
        pair = np.frombuffer((runs.buffers()[2] or pa.py_buffer(b"")).to_pybytes()[off[0] : off[-1]], np.int32).reshape(-1, 2).astype(np.int64)
        self.off, (self.col, self.length) = (off - off[0]) // 8, pair.T
        before = np.concatenate([[0], np.cumsum(self.length)])
        self.n = np.diff(before[self.off])
        self.ordinal = before[:-1] - np.repeat(before[self.off[:-1]], np.diff(self.off))

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the runs of some rows: which of those rows, and which run."""
        many = self.off[rows + 1] - self.off[rows]
        at = np.repeat(np.arange(len(rows)), many)
        return at, np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + self.off[rows][at]

    def stretches(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        """(which, column in x, column in y, length) of the stretches that rows ``x``
        and ``y``, one by one, both have without a gap; residue meets residue by number."""
        (px, rx), (py, ry) = self.of(x), self.of(y)
        wide = int(self.n.max(initial=0)) + 1
        kx, ky = px * wide + self.ordinal[rx], py * wide + self.ordinal[ry]
        key = np.unique(np.concatenate([kx, ky]))
        which, ordinal, n = key // wide, key % wide, np.minimum(self.n[x], self.n[y])
        end = np.minimum(np.append(key[1:], np.iinfo(np.int64).max) - which * wide, n[which])
        kept = ordinal < n[which]
        key, which, ordinal, end = key[kept], which[kept], ordinal[kept], end[kept]
        rx, ry = rx[np.searchsorted(kx, key, "right") - 1], ry[np.searchsorted(ky, key, "right") - 1]
        return which, self.col[rx] + ordinal - self.ordinal[rx], self.col[ry] + ordinal - self.ordinal[ry], end - ordinal

    def columns(self, row: int) -> np.ndarray:
        """Columns of a row's residues."""
        at = slice(self.off[row], self.off[row + 1])
        return np.repeat(self.col[at] - self.ordinal[at], self.length[at]) + np.arange(self.n[row])


def _parted(alns: DataFrame) -> DataFrame:
    """Rows by set and, where a set is large, by parts of its rows, the same in
    all alignments; ``whole``: the set has one part. Sorted, so that what
    belongs together follows one another."""
    named = alns.where("set_id is not null and aln_id is not null and seq is not null").select("set_id", "aln_id", "seq_id", F.col("seq").cast("string").alias("seq"))
    size = named.groupBy("set_id").agg(F.ceil(F.sum(F.length("seq") + F.lit(1)) / F.lit(PART)).alias("_parts"))
    part = F.pmod(F.xxhash64("seq_id"), F.col("_parts")).alias("part")
    rows = named.join(size, "set_id").select("set_id", part, (F.col("_parts") == 1).alias("whole"), "seq_id", "aln_id", "seq")
    return rows.repartition(_tasks(alns), "set_id", "part")


def _sizes(alns: DataFrame) -> DataFrame:
    """(set_id, aln_id, width, letters) of the alignments, materialised: a row each."""
    length = F.length(F.col("seq").cast("string"))
    return cut(alns.where("set_id is not null and aln_id is not null").groupBy("set_id", "aln_id").agg(F.max(length).alias("width"), F.sum(length + 1).alias("letters")))


def _meetings(alns: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(set_id, a, b, d, col, n, own): from column ``col`` of alignment ``a`` on,
    ``n`` more residues (less, if negative) stand ``d`` columns further in ``b``
    (``a`` <= ``b``), in parts that add up; so a row that has no gap on some way
    gives two numbers there, however long. ``own`` is the like for the sums of
    the squares of each row's share. A null ``b`` has the residues of the column
    themselves; what ``a`` = ``b`` has besides them comes from repeated rows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in alns.select("set_id", "aln_id", "seq_id").schema}
    named = alns.where("set_id is not null and aln_id is not null and seq_id is not null and seq is not null").select("set_id", "aln_id", "seq_id", F.col("seq").cast("string").alias("seq"))
    parts = (_sizes(alns) if sizes is None else sizes).groupBy("set_id").agg(F.ceil(F.sum("letters") / F.lit(PART)).alias("_parts"))

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # gaps are what counts here: far fewer bytes than letters are sent
        for batch in batches:
            many = max(1, LETTERS * batch.num_rows // max(1, batch.column(3).nbytes))
            for lo in range(0, batch.num_rows, many):
                x = batch.slice(lo, many)
                yield pa.RecordBatch.from_arrays([*x.columns[:3], _runs(x.column(3))], names=["set_id", "aln_id", "seq_id", "runs"])

    short = named.mapInArrow(shorten, f"set_id {kinds['set_id']}, aln_id {kinds['aln_id']}, seq_id {kinds['seq_id']}, runs binary")
    part = F.pmod(F.xxhash64("seq_id"), F.col("_parts")).alias("part")
    rows = short.join(broadcast_if_small(parts), "set_id").select("set_id", part, "seq_id", "aln_id", "runs")
    rows = rows.repartition(_tasks(alns), "set_id", "part").sortWithinPartitions("set_id", "part", "seq_id", "aln_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[tuple, int] = {}
        held: list[pa.Table] = []
        types: list[pa.DataType] = []
        names = ["at", "d", "col"]

        def add(code: np.ndarray, x: np.ndarray, y: np.ndarray | None, length: np.ndarray, n: np.ndarray, own: np.ndarray) -> None:
            d = x * 0 if y is None else y - x
            cols = [np.concatenate(v) for v in ((code, code), (d, d), (x, x + length), (n, -n), (own, -own))]
            held.append(summed([pa.table(cols, names=[*names, "n", "own"])]))

        def summed(tables: list[pa.Table]) -> pa.Table:
            t = pa.concat_tables(tables).group_by(names, use_threads=False).aggregate([("n", "sum"), ("own", "sum")])
            return t.select([*names, "n_sum", "own_sum"]).rename_columns([*names, "n", "own"])

        def codes(sets: np.ndarray, a: np.ndarray, b: np.ndarray | None, values: tuple[list, list]) -> np.ndarray:
            wide = len(values[1]) + 1
            triple, of = np.unique((sets * wide + a) * wide + (wide - 1 if b is None else b), return_inverse=True)
            known = [(values[0][k // wide // wide], values[1][k // wide % wide], None if k % wide == wide - 1 else values[1][k % wide]) for k in triple.tolist()]
            return np.array([at.setdefault(k, len(at)) for k in known], np.int64)[of]

        def repeated(rows: range, aln: np.ndarray, runs: _Runs, code: Callable[[int, int | None], int]) -> None:
            # a row that an alignment has more than once: by cells, equal copies together
            forms: dict[int, list[tuple[np.ndarray, int]]] = {}
            copies = Counter((int(aln[r]), runs.columns(r).tobytes()) for r in rows)
            for (a, cols), n in copies.items():
                forms.setdefault(a, []).append((np.frombuffer(cols, np.int64), n))
            order = list(forms)
            for i, a in enumerate(order):
                for b in (None, *order[i:]):
                    found = [(x, x, n) for x, n in forms[a]] if b is None else [(x[: len(y)], y[: len(x)], n * m) for x, n in forms[a] for y, m in forms[b]]
                    cells, of = np.unique(np.concatenate([np.stack([x, y]) for x, y, _ in found], axis=1), axis=1, return_inverse=True)
                    n = np.zeros(cells.shape[1], np.int64)
                    np.add.at(n, of.ravel(), np.concatenate([np.full(len(x), n) for x, _, n in found]))
                    one = np.ones(len(n), np.int64)
                    add(one * code(a, b), cells[0], cells[1], one, n, n * n)
                    if b is None:  # the column's residues count for a = b too, so these are taken from it
                        add(one * code(a, a), cells[0], None, one, -n, -n * n)

        def meet(t: pa.Table) -> None:
            sets, ids, alns = (t.column(c).combine_chunks() for c in (0, 2, 3))
            differs = lambda c: pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            group = np.concatenate([[0], np.cumsum(differs(sets) | differs(ids))])
            (s, a), values = zip(*((e.indices.to_numpy().astype(np.int64), e.dictionary.to_pylist()) for e in (sets.dictionary_encode(), alns.dictionary_encode())))
            runs = _Runs(t.column(4).combine_chunks())
            many = np.zeros(group[-1] + 1, bool)
            many[group[1:][(np.diff(group) == 0) & (np.diff(a) == 0)]] = True
            once = np.flatnonzero(~many[group])
            which, run = runs.of(once)
            one = np.ones(len(run), np.int64)
            add(codes(s[once], a[once], None, values)[which], runs.col[run], None, runs.length[run], one, one)
            lag = 1
            while len(x := once[once < len(group) - lag]) and len(x := x[group[x] == group[x + lag]]):
                which, here, there, length = runs.stretches(x, x + lag)
                one = np.ones(len(which), np.int64)
                add(codes(s[x], a[x], a[x + lag], values)[which], here, there, length, one, one)
                lag += 1
            for g in np.flatnonzero(many):
                rows = range(*np.searchsorted(group, [g, g + 1]).tolist())
                name = values[0][s[rows[0]]]
                repeated(rows, a, runs, lambda a, b: at.setdefault((name, values[1][a], None if b is None else values[1][b]), len(at)))

        def written() -> Iterator[pa.RecordBatch]:
            t = held[0].filter(pc.or_(pc.not_equal(held[0]["n"], 0), pc.not_equal(held[0]["own"], 0)))
            cols = [pa.array(x, kind).take(t.column("at").combine_chunks()) for x, kind in zip(zip(*at), types)]
            yield from pa.table([*cols, *t.columns[1:]], names=["set_id", "a", "b", "d", "col", "n", "own"]).to_batches(50_000)
            at.clear(), held.clear()

        def taken(t: pa.Table) -> Iterator[pa.RecordBatch]:
            meet(t)
            if sum(h.num_rows for h in held) > MEETINGS:
                held[:] = [summed(held)]
                if held[0].num_rows > MEETINGS // 2:
                    yield from written()

        rest: pa.Table | None = None
        for batch in batches:
            types = [batch.schema.field(c).type for c in (0, 3, 3)]
            t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if not t.num_rows:
                continue
            same = np.ones(t.num_rows, bool)  # the last row's others may still follow
            for c in (0, 2):
                same &= pc.equal(t.column(c), t.column(c)[-1]).to_numpy()
            end = int(np.append(np.flatnonzero(~same), -1).max()) + 1
            rest = t.slice(end)
            if end:
                yield from taken(t.slice(0, end))
        if rest is not None:
            yield from taken(rest)
        if held:
            held[:] = [summed(held)]
            yield from written()

    return rows.mapInArrow(count, f"set_id {kinds['set_id']}, a {kinds['aln_id']}, b {kinds['aln_id']}, d long, col long, n long, own long")


def consistency(alns: DataFrame) -> DataFrame:
    """Per (set_id, aln_id): columns' share of residue pairs that the set's
    other alignments align too, summed, and its mean.

    No pair is made and no cell: of the residues of a column, those that share a
    column of another alignment too are counted, and n of them are n (n - 1) / 2
    pairs; columns that follow one another with the same counts are one row.
    Alignments of one set have the same rows.
    """
    sizes = _sizes(alns)
    key = ["set_id", "a", "b", "d"]
    x = _meetings(alns, sizes).withColumn("b", F.explode(F.when(F.col("b").isNull(), F.array("b", "a")).otherwise(F.array("b"))))
    x = x.repartition(_tasks(alns), *key).groupBy(*key, "col").agg(F.sum("n").alias("n"), F.sum("own").alias("own"))
    way = W.partitionBy(*key).orderBy("col")
    x = x.select(*key, "col", F.lead("col").over(way).alias("end"), F.sum("n").over(way).alias("n"), F.sum("own").over(way).alias("own"))
    x = x.select(*key, "col", "end", F.expr("(n * n - own) div 2").alias("pairs")).where("pairs > 0")
    every, none = F.col("b").isNull(), F.lit(0).cast("long")

    def turn(a: str, at: Column, sign: int) -> Column:
        v = F.col("pairs") * sign
        return F.struct(F.col(a).alias("a"), at.alias("col"), F.when(every, v).otherwise(none).alias("n"), F.when(every, none).otherwise(v).alias("met"))

    here, there = ([turn(a, F.col("col") + d, 1), turn(a, F.col("end") + d, -1)] for a, d in (("a", none), ("b", F.col("d"))))
    turns = x.select("set_id", F.explode(F.when(F.col("a") < F.col("b"), F.array(*here, *there)).otherwise(F.array(*here))).alias("at"))
    of = turns.groupBy("set_id", "at.a", "at.col").agg(F.sum("at.n").alias("n"), F.sum("at.met").alias("met"))
    along = W.partitionBy("set_id", "a").orderBy("col")
    of = of.select("set_id", "a", (F.lead("col").over(along) - F.col("col")).alias("columns"), F.sum("n").over(along).alias("n"), F.sum("met").over(along).alias("met")).where("n > 0")
    # a set's only alignment agrees with no other: nothing is met besides its own pairs
    others = F.greatest(F.count(F.lit(1)).over(W.partitionBy("set_id")) - 1, F.lit(1)).alias("others")
    width = sizes.select("set_id", F.col("aln_id").alias("a"), "width", others)
    total = of.groupBy("set_id", "a").agg(F.sum((F.col("met") - F.col("n")) / F.col("n") * F.col("columns")).alias("total"))
    return total.join(width, ["set_id", "a"]).select("set_id", F.col("a").alias("aln_id"), F.round(F.col("total") / F.col("others") / F.col("width"), 6).alias("consistency"))


def most_consistent(alns: DataFrame) -> DataFrame:
    return consistency(alns).groupBy("set_id").agg(F.min_by("aln_id", F.struct(-F.col("consistency"), "aln_id")).alias("aln_id"))


def _column_digests(alns: DataFrame) -> DataFrame:
    """(set_id, a, part, col, digest) of the rows that reach a column, with their
    residues' numbers: equal for columns that hold the same, in any alignment."""
    kinds = {f.name: f.dataType.simpleString() for f in alns.select("set_id", "aln_id").schema}
    rows = _parted(alns).sortWithinPartitions("set_id", "aln_id", "part")

    def digests(unit: tuple, rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
        rows.sort(key=lambda r: (r[0] is not None, r[0]))
        ids = [b"-" if i is None else b"+" + str(i).encode() for i, _ in rows]
        ids = [len(i).to_bytes(4, "big") + i for i in ids]
        lengths = np.array([len(s) for _, s in rows])
        width, full = int(lengths.max(initial=0)), int(lengths.min(initial=0))
        codes = np.frombuffer("".join(s.ljust(width, "-") for _, s in rows).encode("utf-32-le"), np.uint32).reshape(len(rows), width)
        found = codes != _GAP
        ordinals = np.where(found, np.cumsum(found, axis=1, dtype=np.int32), np.int32(0))
        hi = 0
        for _, equal in groupby(ids):
            lo, hi = hi, hi + sum(1 for _ in equal)
            if hi - lo > 1:
                # a row that is there more than once: its numbers in order, of the rows that reach a column before the rest
                absent = np.arange(width) >= lengths[lo:hi, None]
                order = np.lexsort((ordinals[lo:hi], absent), axis=0)
                ordinals[lo:hi] = np.take_along_axis(ordinals[lo:hi], order, axis=0)
                lengths[lo:hi] = np.sort(lengths[lo:hi])[::-1]
        columns, all_ids, out = np.ascontiguousarray(ordinals.T), hashlib.sha256(b"".join(ids)).digest(), []
        for c in range(width):
            if c < full:
                out.append(hashlib.sha256(all_ids + columns[c].tobytes()).digest())
            else:
                there = np.flatnonzero(lengths > c)
                out.append(hashlib.sha256(hashlib.sha256(b"".join(ids[k] for k in there)).digest() + columns[c][there].tobytes()).digest())
        same = [pa.repeat(pa.scalar(v, kind), width) for v, kind in zip(unit, (*kinds[:1], kinds[4], pa.int64()))]
        return pa.RecordBatch.from_arrays([*same, pa.array(np.arange(1, width + 1)), pa.array(out, pa.binary())], names=["set_id", "a", "part", "col", "digest"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, kinds = None, [], []
        for batch in batches:
            kinds = batch.schema.types
            for s, part, _, name, a, seq in zip(*(c.to_pylist() for c in batch.columns)):
                if (s, a, part) != unit:
                    if held:
                        yield digests(unit, held, kinds)
                    unit, held = (s, a, part), []
                held.append((name, seq))
        if held:
            yield digests(unit, held, kinds)

    return rows.mapInArrow(digest, f"set_id {kinds['set_id']}, a {kinds['aln_id']}, part long, col long, digest binary")


def shared_columns(alns: DataFrame) -> DataFrame:
    """Columns (by their residues' numbers) that two alignments of a set share.

    A column is known by the SHA-256 of its rows and numbers, taken by parts of
    the rows where a set is large; no list of a column's rows is shuffled.
    """
    part = F.struct("part", F.hex("digest").alias("d"))
    cols = _column_digests(alns).groupBy("set_id", "a", "col").agg(F.to_json(F.array_sort(F.collect_list(part))).alias("h"))
    cols = cols.groupBy("set_id", "a", "h").agg(F.count(F.lit(1)).alias("n"))  # columns of gaps may be many
    x, y = cols.alias("x"), cols.alias("y")
    met = x.join(y, ["set_id", "h"]).where("x.a < y.a").groupBy("set_id", F.col("x.a").alias("first_aln"), F.col("y.a").alias("second_aln"))
    return met.agg(F.sum(F.col("x.n") * F.col("y.n")).alias("n_shared"))

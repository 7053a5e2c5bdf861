"""Multiple alignment without an external program.

Centre star: the row most alike the others by shared words is the centre, every
other row is aligned to it by exact affine global alignment, and the pairwise
alignments are merged by "once a gap, always a gap". Not bit-compatible with
any other aligner; what holds is that ungapped rows are preserved, all rows
come out equally long, and equal rows align without gaps.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import broadcast_if_small, cut
from .cluster import average_linkage
from .msa import cells
from .records import ranked

_NEG = -1e9
#: Cells of a pairwise table whose ways back are held at a time.
CELLS = 4_000_000
#: Rows of a group that one task clusters in mode ``long``.
LONG_ROWS = 2_000


def pick_centre(seqs: Sequence[str], k: int = 6) -> int:
    counts = [Counter(s[i : i + k] for i in range(len(s) - k + 1)) for s in seqs]
    whole = Counter()
    for c in counts:
        whole.update(c.keys())
    score = [sum(whole[w] - 1 for w in c) for c in counts]
    return max(range(len(seqs)), key=lambda i: (score[i], -i))


class _Rows:
    """The table of an affine global alignment, a row at a time."""

    def __init__(self, x: np.ndarray, y: np.ndarray, match: float, mismatch: float, gap_open: float, gap_extend: float, free_ends: bool):
        self.x, self.y, self.match, self.mismatch = x, y, match, mismatch
        self.open, self.extend, self.free = gap_open, gap_extend, free_ends
        self.j = np.arange(len(y) + 1)

    def first(self) -> tuple[np.ndarray, np.ndarray]:
        h = np.where(self.j > 0, -(self.open + self.extend * (self.j - 1)), 0.0)
        return h, np.full(len(self.j), _NEG)

    def next(self, i: int, h: np.ndarray, e: np.ndarray, keep: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Row ``i`` from the one before; with ``keep`` also the ways back."""
        j = self.j
        opened, extended = h - self.open, e - self.extend
        e = np.maximum(opened, extended)  # a gap in b: a letter of a alone
        diag = np.empty(len(j))
        diag[0] = _NEG
        diag[1:] = h[:-1] + np.where(self.y == self.x[i - 1], self.match, self.mismatch)
        best = np.maximum(diag, e)
        if self.free:
            best[0] = 0
        # a gap in a: a prefix maximum of best[k] - open - extend * (j - k - 1)
        lifted = best + self.extend * j
        top = np.maximum.accumulate(lifted)
        f = np.full(len(j), _NEG)
        f[1:] = top[:-1] - self.open - self.extend * (j[1:] - 1)
        if keep is not None:
            back, e_open, f_len = keep
            arg = np.maximum.accumulate(np.where(lifted == top, j, 0))
            back[:] = np.where(f > best, 2, np.where(diag >= e, 0, 1))
            back[0] = 1
            e_open[:] = opened >= extended
            f_len[1:] = j[1:] - arg[:-1]
        return np.maximum(best, f), e


def global_pair(a: str, b: str, match: float = 2, mismatch: float = -1, gap_open: float = 3, gap_extend: float = 1, free_ends: bool = False) -> tuple[str, str]:
    """Affine global alignment; rows of the table are numpy vectors. With
    ``free_ends`` end gaps of ``b`` cost nothing (a fragment).

    Of a long pair's table only every k-th row is kept, and the ways back are
    computed anew for k rows at a time: exact in bounded memory (``CELLS``).
    """
    n, m = len(a), len(b)
    if not n or not m:
        return a + "-" * m, "-" * n + b
    rows = _Rows(np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8), match, mismatch, gap_open, gap_extend, free_ends)
    step = max(1, CELLS // (m + 1), math.isqrt(n))
    state = rows.first()
    kept, last = [state], [state[0][m]]
    for i in range(1, n + 1):
        state = rows.next(i, *state)
        last.append(state[0][m])
        if i % step == 0:
            kept.append(state)
    i, k = n, m
    ra, rb = [], []
    if free_ends:
        i = int(np.argmax(last))
        ra += list(a[i:][::-1])
        rb += ["-"] * (n - i)
    base, ways = n + 1, None

    def way(i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nonlocal base, ways
        if i <= base:
            block = (i - 1) // step
            base = block * step
            count = min(step, n - base)
            ways = np.zeros((count, m + 1), np.uint8), np.zeros((count, m + 1), bool), np.zeros((count, m + 1), np.int32)
            state = kept[block]
            for r in range(count):
                state = rows.next(base + 1 + r, *state, keep=(ways[0][r], ways[1][r], ways[2][r]))
        return tuple(w[i - 1 - base] for w in ways)  # type: ignore[return-value]

    while i or k:
        if i == 0:
            ra += ["-"] * k
            rb += list(b[:k][::-1])
            break
        if k == 0:
            ra += list(a[:i][::-1])
            rb += ["-"] * i
            break
        back, _, f_len = way(i)
        if back[k] == 0:
            ra.append(a[i - 1])
            rb.append(b[k - 1])
            i, k = i - 1, k - 1
        elif back[k] == 2:
            run = max(int(f_len[k]), 1)
            ra += ["-"] * run
            rb += list(b[k - run : k][::-1])
            k -= run
        else:
            while i:
                opened = way(i)[1][k]
                ra.append(a[i - 1])
                rb.append("-")
                i -= 1
                if opened:
                    break
    return "".join(ra)[::-1], "".join(rb)[::-1]


def merge_star(centre: str, parts: Sequence[tuple[str, str]]) -> tuple[str, list[str]]:
    """Join pairwise alignments to one centre: once a gap, always a gap."""
    n = len(centre)
    room = [0] * (n + 1)  # gaps wanted before each letter of the centre
    for c, _ in parts:
        for at, run in _gap_runs(c):
            room[at] = max(room[at], run)
    whole = "".join("-" * room[i] + centre[i] for i in range(n)) + "-" * room[n]
    return whole, [_in_room(c, s, room) for c, s in parts]


def _gap_runs(c: str) -> list[tuple[int, int]]:
    """(letters before it, length) of each gap."""
    out = []
    run = at = 0
    for ch in c:
        if ch == "-":
            run += 1
        else:
            if run:
                out.append((at, run))
            run, at = 0, at + 1
    if run:
        out.append((at, run))
    return out


def _in_room(c: str, s: str, room: Sequence[int]) -> str:
    """The row ``s``, aligned to the centre as ``c``, in the merged alignment."""
    row, at, run = [], 0, []
    for x, y in zip(c, s):
        if x == "-":
            run.append(y)
        else:
            row.append("".join(run) + "-" * (room[at] - len(run)))
            row.append(y)
            run, at = [], at + 1
    row.append("".join(run) + "-" * (room[at] - len(run)))
    return "".join(row)


def star(seqs: Sequence[str]) -> list[str]:
    """Aligned rows, in the given order."""
    seqs = [s.replace("-", "") for s in seqs]
    if len(seqs) < 2 or len(set(seqs)) == 1:
        return list(seqs)
    distinct = list(dict.fromkeys(seqs))
    c = pick_centre(distinct)
    others = [s for i, s in enumerate(distinct) if i != c]
    whole, rows = merge_star(distinct[c], [global_pair(distinct[c], s) for s in others])
    row_of = dict(zip(others, rows)) | {distinct[c]: whole}
    return [row_of[s] for s in seqs]


def add_to(backbone: Sequence[str], new: Sequence[str], fragments: bool = False) -> list[str]:
    """Add rows to an alignment: each is aligned to the backbone's majority row,
    in which all-gap columns cannot occur. ``fragments``: end gaps are free."""
    if not backbone:
        return star(new)
    width = len(backbone[0])
    majority = "".join(Counter(r[i] for r in backbone if r[i] != "-").most_common(1)[0][0] if any(r[i] != "-" for r in backbone) else "N" for i in range(width))
    parts = [global_pair(majority, s.replace("-", ""), free_ends=fragments) for s in new]
    own = [(majority, r) for r in backbone]
    _, rows = merge_star(majority, [*own, *parts])
    return rows


def long_group(seqs: Sequence[str], most_clusters: int = 10, long_ratio: float = 0.7, fragment_ratio: float = 0.5) -> list[str]:
    """Long rows are aligned first, the cluster around their consensus is the
    backbone, then others and at last fragments are added."""
    bare = [s.replace("-", "") for s in seqs]
    top = max(map(len, bare), default=0)
    long = [i for i, s in enumerate(bare) if len(s) > long_ratio * top]
    rows = star([bare[i] for i in long])
    if len(long) > 3:
        m = np.array([list(r) for r in rows])
        consensus = np.array([Counter(c).most_common(1)[0][0] for c in m.T])
        m = np.vstack([m, consensus])
        d = np.array([(m != r).mean(axis=1) for r in m])
        labels = average_linkage(d, 2) if len(long) <= most_clusters else average_linkage(d, min(most_clusters, len(long) // 3))
        core = [i for i, c in zip(long, labels[:-1]) if c == labels[-1]]
        if core and len(core) < len(long):
            long, rows = core, star([bare[i] for i in core])
    done = dict(zip(long, rows))
    rest = [i for i in range(len(bare)) if i not in done]
    for fragments in (False, True):
        part = [i for i in rest if (len(bare[i]) < fragment_ratio * top) == fragments]
        if part:
            order = list(done)
            out = add_to([done[i] for i in order], [bare[i] for i in part], fragments)
            done = dict(zip([*order, *part], out))
    return [done[i] for i in range(len(bare))]


def align(df: DataFrame, mode: str = "auto", most: int = 20_000) -> DataFrame:
    """(aln_id, seq_id, seq) aligned per ``aln_id``, groups in parallel.

    A group of more than ``most`` rows, in mode ``long`` also one of more than
    ``LONG_ROWS``, is spread over many tasks. In mode ``auto`` that gives the
    same rows; in mode ``long`` the backbone is then that of a bounded sample of
    the long rows, to whose majority row all others are added.
    """
    how = {"auto": star, "long": long_group}[mode]

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("seq_id", kind="stable").copy()
        g["seq"] = how(g["seq"].tolist())
        return g

    x = df.select("aln_id", "seq_id", "seq")
    kinds = {f.name: f.dataType.simpleString() for f in x.schema}
    ddl = f"aln_id {kinds['aln_id']}, seq_id {kinds['seq_id']}, seq string"
    limit = min(most, LONG_ROWS) if mode == "long" else most
    large = cut(df.groupBy("aln_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("aln_id"))
    if large.isEmpty():
        return x.groupBy("aln_id").applyInPandas(one, ddl)
    spread_out = cut(_same(x, large, "inner").withColumn("seq", F.replace("seq", F.lit("-"), F.lit(""))))
    rest = _same(x, large, "left_anti").groupBy("aln_id").applyInPandas(one, ddl)
    return rest.unionByName(_spread_star(spread_out) if mode == "auto" else _spread_long(spread_out, LONG_ROWS // 2))


def _same(x: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    k = keys.select(F.col("aln_id").alias("_k"))
    return x.join(broadcast_if_small(k), F.col("aln_id").eqNullSafe(F.col("_k")), how).drop("_k")


def _tasks(df: DataFrame) -> int:
    s = df.sparkSession
    return max(s.sparkContext.defaultParallelism, int(s.conf.get("spark.sql.shuffle.partitions")))


def _spread_star(x: DataFrame) -> DataFrame:
    """``star`` of each group with its rows in many tasks: the same centre, the
    same pairs, and gaps merged by their maxima."""
    ids = x.groupBy("aln_id", "seq").agg(F.min("seq_id").alias("first")).withColumn("d", F.monotonically_increasing_id())
    ids = cut(ids.repartition(_tasks(x), "d"))
    n = F.length("seq") - 5
    words = ids.select("aln_id", "d", F.explode(F.array_distinct(F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substr("seq", i, F.lit(6)))))).alias("word"))
    shared = words.groupBy("aln_id", "word").agg((F.count(F.lit(1)) - 1).alias("n"))
    w, c = words.alias("w"), shared.alias("c")
    score = w.join(c, F.col("w.aln_id").eqNullSafe(F.col("c.aln_id")) & (F.col("w.word") == F.col("c.word"))).groupBy("w.d").agg(F.sum("c.n").alias("score"))
    centres = ids.join(score, "d", "left").groupBy("aln_id").agg(F.min_by("seq", F.struct(-F.coalesce("score", F.lit(0)), F.col("first"))).alias("centre"))
    rows = _merged(ids.select("aln_id", "d", "seq", F.lit("pair").alias("how")), centres)
    rows = rows.join(ids.select("d", F.col("seq").alias("bare")), "d").select(F.col("aln_id").alias("_k"), "bare", F.col("seq").alias("row"))
    both = x.join(rows, F.col("aln_id").eqNullSafe(F.col("_k")) & (F.col("seq") == F.col("bare")))
    return both.select("aln_id", "seq_id", F.col("row").alias("seq"))


def _spread_long(x: DataFrame, most: int) -> DataFrame:
    """``long_group`` of at most ``most`` of each group's long rows; all others
    are added to its majority row, fragments with free ends."""
    top = x.groupBy("aln_id").agg(F.max(F.length("seq")).alias("top")).withColumnRenamed("aln_id", "_k")
    y = x.join(broadcast_if_small(top), F.col("aln_id").eqNullSafe(F.col("_k"))).drop("_k").withColumn("d", F.monotonically_increasing_id())
    y = cut(y.repartition(_tasks(x), "d"))
    core = ranked(y.where(F.col("top") * 0.7 < F.length("seq")), ["aln_id"], [F.xxhash64("seq_id", F.lit(42)), "seq_id", "d"], most)
    core = cut(align(core.select("aln_id", F.col("d").alias("seq_id"), "seq"), "long").select("aln_id", F.col("seq_id").alias("d"), "seq"))
    centres = majority_rows(core.withColumnRenamed("d", "seq_id")).withColumnRenamed("majority", "centre")
    others = y.join(core.select("d"), "d", "left_anti").select("aln_id", "d", "seq", F.when(F.length("seq") < F.col("top") * 0.5, "fragment").otherwise("pair").alias("how"))
    rows = _merged(core.withColumn("how", F.lit("done")).unionByName(others), centres)
    return y.select("d", "seq_id").join(rows, "d").select("aln_id", "seq_id", "seq")


def _merged(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """Rows (aln_id, d, seq, how) aligned to their group's centre, (aln_id, d,
    seq): ``done`` ones are so already, a ``fragment`` has free ends."""
    kind = rows.schema["aln_id"].dataType.simpleString()
    key = centres.withColumnRenamed("aln_id", "_k")
    on = F.col("aln_id").eqNullSafe(F.col("_k"))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, seqs, hows, whole = (c.to_pylist() for c in batch.columns)
            out = [(b, s) if how == "done" or s == b else global_pair(b, s, free_ends=how == "fragment") for s, how, b in zip(seqs, hows, whole)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(v, pa.string()) for v in zip(*out))] if out else [*batch.columns[:2], pa.array([], pa.string()), pa.array([], pa.string())], names=["aln_id", "d", "c", "s"])

    def gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, at, run) for i, c in enumerate(batch.column(1).to_pylist()) for at, run in _gap_runs(c)]
            i, at, run = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i, pa.int32())), pa.array(at, pa.int64()), pa.array(run, pa.int64())], names=["aln_id", "at", "run"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c, s, wide in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                room = [0] * (len(c) - c.count("-") + 1)
                for r in wide or ():
                    room[r["at"]] = r["run"]
                out.append(_in_room(c, s, room))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.string())], names=["aln_id", "d", "seq"])

    x = rows.join(broadcast_if_small(key), on).select("aln_id", "d", "seq", "how", "centre").repartition(_tasks(rows), "d")
    pairs = cut(x.mapInArrow(pair, f"aln_id {kind}, d long, c string, s string"))
    wide = pairs.select("aln_id", "c").mapInArrow(gaps, f"aln_id {kind}, at long, run long").groupBy("aln_id", "at").agg(F.max("run").alias("run"))
    wide = wide.groupBy("aln_id").agg(F.collect_list(F.struct("at", "run")).alias("wide")).withColumnRenamed("aln_id", "_k")
    return pairs.join(broadcast_if_small(wide), on, "left").select("aln_id", "d", "c", "s", "wide").mapInArrow(place, f"aln_id {kind}, d long, seq string")


def add_rounds(rounds: Sequence[DataFrame]) -> DataFrame:
    """One alignment per ``aln_id`` of the rows (aln_id, seq_id, seq) of several
    rounds: the first is aligned, the rows of each later one are added to it, and
    groups that begin with a later round are aligned there."""
    aln = cut(align(rounds[0]))
    for new in rounds[1:]:
        known = aln.select("aln_id").distinct()
        bare = new.select("aln_id", "seq_id", F.replace("seq", F.lit("-"), F.lit("")).alias("seq"))
        fresh = align(bare.join(known, "aln_id", "left_anti"))
        added = bare.join(known, "aln_id", "left_semi").withColumn("how", F.lit("pair"))
        rows = cut(aln.withColumn("how", F.lit("done")).unionByName(added).withColumn("d", F.monotonically_increasing_id()))
        merged = _merged(rows.select("aln_id", "d", "seq", "how"), majority_rows(aln).withColumnRenamed("majority", "centre"))
        aln = cut(rows.select("d", "seq_id").join(merged, "d").select("aln_id", "seq_id", "seq").unionByName(fresh))
    return aln


def majority_rows(aln: DataFrame) -> DataFrame:
    """(aln_id, majority): the most frequent letter of each column, of equally
    frequent ones the last; N in a column of gaps."""
    c = cells(aln).groupBy("aln_id", "col", "base").agg(F.count(F.lit(1)).alias("n"))
    gap = F.col("base") == "-"
    best = F.max_by(F.when(gap, "N").otherwise(F.col("base")), F.struct(F.when(gap, 0).otherwise(F.col("n")), F.col("base"))).alias("base")
    cols = c.groupBy("aln_id", "col").agg(best).groupBy("aln_id").agg(F.array_sort(F.collect_list(F.struct("col", "base"))).alias("c"))
    return cols.select("aln_id", F.array_join(F.transform("c", lambda x: x["base"]), "").alias("majority"))


def add_groups(groups: DataFrame, backbones: DataFrame) -> DataFrame:
    """Groups (aln_id, seq_id, seq, reference), each by itself added to the
    alignment ``reference``, of which ``backbones`` has the majority row; a group
    without one is aligned alone."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("seq_id", kind="stable").copy()
        backbone = g["majority"].iloc[0]
        g["seq"] = long_group(g["seq"].tolist()) if backbone is None else add_to([backbone], g["seq"].tolist())[1:]
        return g[["aln_id", "seq_id", "seq"]]

    x = groups.join(backbones.withColumnRenamed("aln_id", "reference"), "reference", "left").select("aln_id", "seq_id", "seq", "majority")
    kinds = {f.name: f.dataType.simpleString() for f in x.schema}
    return x.groupBy("aln_id").applyInPandas(one, f"aln_id {kinds['aln_id']}, seq_id {kinds['seq_id']}, seq string")

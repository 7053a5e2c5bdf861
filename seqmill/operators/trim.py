"""Alignment trimming.

Figures per column that are mere counts come from ``msa``. Methods whose cut
depends on a whole column vector in order (slopes, blocks, refilling from the
middle) run as a kernel per alignment: its rows are gathered, and numpy decides
which columns and rows stay. Alignments are trimmed in parallel.

Cuts are decided in single precision, like the method's published program.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

_GAP = ord("-")
#: Amino-acid letters that are scored.
AMINO = "ARNDCQEGHILKMFPSTWYV"


@dataclass(frozen=True)
class Trim:
    """What to do. ``method``: one of METHODS; thresholds as on the command
    line: ``gap`` is the least share of rows without gap, ``similarity`` and
    ``consistency`` the least value, ``keep`` the least percentage of columns.
    ``scores`` is a residue matrix (``sources.alignments.read_similarity_matrix``);
    without one, letters are equal or not."""

    method: str = "automated1"
    gap: float | None = None
    similarity: float | None = None
    consistency: float | None = None
    keep: float | None = None
    residue_overlap: float | None = None
    sequence_overlap: float | None = None
    columns: tuple[tuple[int, int], ...] = ()
    complementary: bool = False
    window: int = 0
    gap_window: int | None = None
    similarity_window: int | None = None
    scores: tuple[tuple[str, str, float], ...] = ()


METHODS = ("nogaps", "noallgaps", "gappyout", "strict", "strictplus", "automated1", "threshold", "overlap", "select")


def validate(t: Trim) -> None:
    """Refuse combinations that have no meaning."""
    if t.method not in METHODS:
        raise ValueError(f"unknown method {t.method}")
    manual = [x for x in (t.gap, t.similarity, t.consistency, t.keep) if x is not None]
    if manual and t.method != "threshold":
        raise ValueError("thresholds cannot be combined with another method")
    if t.method == "threshold" and not [x for x in (t.gap, t.similarity, t.consistency) if x is not None]:
        raise ValueError("a threshold is missing")
    for name, v, top in (("gap", t.gap, 1), ("similarity", t.similarity, 1), ("consistency", t.consistency, 1), ("keep", t.keep, 100), ("residue_overlap", t.residue_overlap, 1), ("sequence_overlap", t.sequence_overlap, 100)):
        if v is not None and not 0 <= v <= top:
            raise ValueError(f"{name} must lie in 0..{top}")
    if (t.method == "overlap") != (t.residue_overlap is not None and t.sequence_overlap is not None):
        raise ValueError("overlap needs both its thresholds, and they need it")
    if (t.method == "select") != bool(t.columns):
        raise ValueError("select needs columns, and they need it")
    if any(a > b for a, b in t.columns) or list(t.columns) != sorted(t.columns):
        raise ValueError("columns must ascend")


def half_up(x: float) -> int:
    return int(x + 0.5)


def matrix(seqs: Sequence[str]) -> np.ndarray:
    if len({len(s) for s in seqs}) > 1:
        raise ValueError("rows of an alignment differ in length")
    return np.frombuffer("".join(seqs).encode("ascii", "replace"), np.uint8).reshape(len(seqs), -1) if seqs else np.zeros((0, 0), np.uint8)


def is_amino(m: np.ndarray) -> bool:
    """By majority of rows: fewer than 95 % nucleotide letters in the first 100."""
    amino = 0
    for row in m:
        head = row[row != _GAP][:100]
        if not len(head):
            continue
        dna = np.isin(head, np.frombuffer(b"AGCTN", np.uint8)).mean()
        rna = np.isin(head, np.frombuffer(b"AGCUN", np.uint8)).mean()
        amino += 1 if max(dna, rna) < 0.95 else -1
    return amino > 0


def distance_table(amino: bool, scores: Sequence[tuple[str, str, float]] = ()) -> np.ndarray:
    """Distances of letters: Euclidean between their columns of the matrix."""
    if scores:
        names = "".join(dict.fromkeys(a for a, _, _ in scores))
        value = {(a, b): v for a, b, v in scores}
        m = np.array([[value.get((a, b), 0.0) for b in names] for a in names])
    else:
        names = AMINO if amino else "ACGTU"
        m = np.eye(len(names))
        if not amino:
            m[3, 4] = m[4, 3] = 1.0
    d = np.sqrt(((m[:, None, :] - m[None, :, :]) ** 2).sum(axis=2))
    out = np.zeros((256, 256), np.float32)
    codes = np.frombuffer(names.encode(), np.uint8)
    out[np.ix_(codes, codes)] = d
    return out


def window_mean(v: np.ndarray, half: int, rounded: bool) -> np.ndarray:
    if not half:
        return v
    if half > len(v) / 4:
        raise ValueError("the window is too wide for the alignment")
    padded = np.concatenate([v[1 : half + 1][::-1], v, v[-half - 1 : -1][::-1]]).astype(np.float64)
    mean = np.convolve(padded, np.ones(2 * half + 1), "valid") / (2 * half + 1)
    return np.floor(mean + 0.5).astype(int) if rounded else mean.astype(np.float32)


def similarity(m: np.ndarray, gaps: np.ndarray, amino: bool, scores: Sequence[tuple[str, str, float]] = ()) -> np.ndarray:
    """exp(-Q) per column: Q is the mean distance of its pairs of letters,
    weighted by how unlike their rows are; 0 with 80 % gaps or more."""
    indet = ord("X" if amino else "N")
    ok = (m != _GAP) & (m != indet)
    n = len(m)
    table = distance_table(amino, scores)
    num, den = np.zeros(m.shape[1]), np.zeros(m.shape[1])
    for i in range(n - 1):
        other, both = m[i + 1 :], ok[i + 1 :] & ok[i]
        length = (ok[i + 1 :] | ok[i]).sum(axis=1)
        same = ((other == m[i]) & both).sum(axis=1)
        weight = np.where(length > 0, 100 - 100 * same / np.maximum(length, 1), 0).astype(np.float32)
        part = weight.astype(np.float64)[:, None] * both
        num += (part * table[m[i][None, :], other]).sum(axis=0)
        den += part.sum(axis=0)
    q = np.divide(num, den, out=np.zeros_like(num), where=den > 0)
    out = np.minimum(np.exp(-q), 1).astype(np.float32)
    out[(gaps / max(n, 1)).astype(np.float32) >= np.float32(0.8)] = 0
    return out


def gap_cut(gaps: np.ndarray, rows: int, threshold: float, keep: float) -> float:
    """Most gaps a column may have: by the threshold, or what keeps ``keep``
    percent of the columns (interpolated), whichever is more."""
    hist = np.bincount(gaps, minlength=rows + 1)
    want = half_up(len(gaps) * keep / 100)
    upto = np.cumsum(hist)
    i = int(np.searchsorted(upto, want))
    i = min(i, rows)
    base = i - np.float32(upto[i] - want) / hist[i] if hist[i] else 0.0
    return max(rows * threshold, float(base))


def slope_cut(gaps: np.ndarray, rows: int) -> int:
    """Gap count after which the slope over two steps grows most."""
    hist = np.bincount(gaps)
    xs = np.flatnonzero(hist)
    second: dict[int, np.float32] = {}
    best, at = np.float32(-1), 0
    for p, q, r in zip(xs, xs[1:], xs[2:]):
        s = np.float32((r - p) / rows) / np.float32((hist[r] + hist[q]) / len(gaps))
        second[r] = s
        before = second.get(p, second.get(q))
        if before is not None and s / before > best:
            best, at = s / before, int(p)
    return at


def similarity_cut(values: np.ndarray, threshold: float, keep: float) -> float:
    v = np.sort(values)
    below = v[v < np.float32(threshold)]
    cut = below[-1] if len(below) else v[0] - 1
    return float(min(cut, v[int((len(v) - 1) * (100 - keep) / 100)]))


def strict_cut(values: np.ndarray) -> float:
    """Log-interpolated between the values at 20 and 80 percent, from the top."""
    v = np.sort(values)[::-1]
    n = len(v)
    share = np.arange(1, n + 1, dtype=np.float32) / np.float32(n) * np.float32(100)
    at20, at80 = np.flatnonzero(share <= 20), np.flatnonzero(share <= 80)
    first = float(v[at20[-1]]) if len(at20) else 0.0
    last = float(v[at80[-1]]) if len(at80) else 0.0
    lo, hi = (math.log10(x) if x > 0 else -math.inf for x in (last, first))
    if math.isinf(lo):
        return 0.0
    return float(np.float32(10 ** ((hi - lo) / 10 + lo)))


def rescue(kept: np.ndarray) -> np.ndarray:
    """In order, take back a column with three of four kept neighbours; the
    second and the last but one depend on their neighbours alone."""
    k = kept.copy()
    n = len(k)
    if n < 5:
        return k
    k[1] = k[0] and k[2] and k[3]
    k[n - 2] = k[n - 1] and k[n - 3] and k[n - 4]
    for i in range(2, n - 2):
        if not k[i] and int(k[i - 2]) + k[i - 1] + k[i + 1] + k[i + 2] >= 3:
            k[i] = True
    return k


def runs(kept: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], kept.astype(np.int8), [0]))))
    return list(zip(edge[::2], edge[1::2]))


def drop_short(kept: np.ndarray, least: int) -> np.ndarray:
    out = kept.copy()
    for a, b in runs(kept):
        if b - a < least:
            out[a:b] = False
    return out


def _lead(flags: np.ndarray) -> int:
    """How many flags are set before the first that is not."""
    return len(flags) if flags.all() else int(flags.argmin())


def _grow(kept: np.ndarray, allowed: np.ndarray, size: int, most: int) -> tuple[int, int]:
    """The block at the head of ``kept``, if it has ``size`` columns, takes in up to
    ``most`` allowed ones behind it; (columns seen, columns taken)."""
    block = _lead(kept)
    open_ = _lead(~kept[block:] & allowed[block:])
    taken = min(open_, most) if block >= size else 0
    kept[block : block + taken] = True
    return block + taken + 1, taken


def refill(kept: np.ndarray, allowed: np.ndarray, keep: float) -> np.ndarray:
    """Add allowed neighbours of kept blocks until ``keep`` percent of the columns
    stay: larger blocks before smaller, and of each size from the middle outwards,
    in turn to the left and to the right."""
    k = kept.copy()
    n = len(k)
    want = half_up((keep / 100 - k.sum() / n) * n)
    sides = (k[: n // 2 + 1][::-1], allowed[: n // 2 + 1][::-1]), (k[n // 2 + 1 :], allowed[n // 2 + 1 :])
    for size in range(half_up(0.005 * n), -1, -1):
        seen = [0, 0]
        while want > 0 and (seen[0] < n // 2 or seen[1] < n - 2 - n // 2):
            for side, (part, may) in enumerate(sides):
                step, taken = _grow(part[seen[side] :], may[seen[side] :], size, max(want, 0))
                seen[side] += step
                want -= taken
    return k


def overlaps(m: np.ndarray, overlap: float, amino: bool) -> np.ndarray:
    """Share of columns in which each row has enough comparable partners."""
    indet = ord("X" if amino else "N")
    n = len(m)
    need = math.ceil(np.float32(overlap) * np.float32(n - 1))
    gap, x = (m == _GAP), (m == indet)
    g, u = gap.sum(axis=0), x.sum(axis=0)
    partners = np.where(gap, g - 1, np.where(x, u - 1, n - g - u - 1))
    return (partners >= need).mean(axis=1)


def kept_columns(seqs: Sequence[str], t: Trim, agree: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(columns, rows) that stay. ``agree``: consistency per column, if used."""
    validate(t)
    m = matrix(seqs)
    n, width = m.shape
    rows = np.ones(n, bool)
    if not n or not width:
        return np.ones(width, bool), rows
    amino = is_amino(m)
    raw = (m == _GAP).sum(axis=0)
    gaps = window_mean(raw, t.gap_window if t.gap_window is not None else t.window, True)
    sim_half = t.similarity_window if t.similarity_window is not None else t.window
    values = lambda: window_mean(similarity(m, raw, amino, t.scores), sim_half, False)
    method = t.method
    if method == "automated1":
        method = automatic(m, amino)
    if method == "nogaps":
        kept = gaps <= 0
    elif method == "noallgaps":
        kept = raw <= n - 1
    elif method == "gappyout":
        kept = gaps <= slope_cut(raw, n)
    elif method in ("strict", "strictplus"):
        cut = slope_cut(raw, n)
        v = values()
        limit = strict_cut(v[gaps <= cut]) if (gaps <= cut).any() else 0.0
        kept = rescue((gaps <= cut) & (v >= np.float32(limit)))
        least = 5 if method == "strict" else max(3, min(12, half_up(width * 0.01)))
        kept = drop_short(kept, least)
    elif method == "threshold":
        keep = t.keep or 0.0
        kept, allowed = np.ones(width, bool), np.ones(width, bool)
        if t.gap is not None:
            cut = gap_cut(gaps, n, 1 - t.gap, keep)
            kept &= gaps <= cut
            allowed &= gaps <= np.sort(gaps)[int((width - 1) * keep / 100)]
        if t.similarity is not None:
            v = values()
            kept &= v > similarity_cut(v, t.similarity, keep)
            allowed &= v >= np.sort(v)[int((width - 1) * (100 - keep) / 100)]
        if t.consistency is not None:
            v = np.zeros(width, np.float32) if agree is None else agree.astype(np.float32)
            kept &= v > similarity_cut(v, t.consistency, keep)
        kept = refill(kept, allowed, keep)
    elif method == "overlap":
        rows = overlaps(m, t.residue_overlap, amino) >= t.sequence_overlap / 100
        kept = (m[rows] != _GAP).any(axis=0) if rows.any() else np.zeros(width, bool)
    else:
        kept = np.ones(width, bool)
        for a, b in t.columns:
            if b >= width:
                raise ValueError("a column lies outside the alignment")
            kept[a : b + 1] = False
    return (~kept if t.complementary else kept), rows


def automatic(m: np.ndarray, amino: bool) -> str:
    """Method by how alike the rows are."""
    indet = ord("X" if amino else "N")
    ok = (m != _GAP) & (m != indet)
    n = len(m)
    if n < 2:
        return "gappyout"
    ident = np.zeros((n, n))
    for i in range(n):
        either = ok | ok[i]
        ident[i] = ((m == m[i]) & either).sum(axis=1) / np.maximum(either.sum(axis=1), 1)
    np.fill_diagonal(ident, 0)
    mean, most = ident.sum() / (n * (n - 1)), ident.max(axis=1).mean()
    if mean >= 0.55:
        return "gappyout"
    if mean <= 0.38:
        return "strict"
    return "gappyout" if n <= 20 or 0.5 <= most <= 0.65 else "strict"


def trim(aln: DataFrame, how: Trim = Trim()) -> DataFrame:
    """(aln_id, seq_id, seq) trimmed; rows left without a residue are dropped."""
    validate(how)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("seq_id", kind="stable")
        cols, rows = kept_columns(g["seq"].tolist(), how)
        m = matrix(g["seq"].tolist())[rows][:, cols]
        out = g.loc[rows, ["aln_id", "seq_id"]].copy()
        out["seq"] = [r.tobytes().decode("ascii") for r in m]
        return out[[bool(x.strip("-")) for x in out["seq"]]]

    kinds = {f.name: f.dataType.simpleString() for f in aln.schema}
    return aln.select("aln_id", "seq_id", "seq").groupBy("aln_id").applyInPandas(one, f"aln_id {kinds['aln_id']}, seq_id {kinds['seq_id']}, seq string")


def column_map(aln: DataFrame, how: Trim = Trim()) -> DataFrame:
    """(aln_id, old_col, new_col) of the columns that stay, from 0."""
    validate(how)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        cols, _ = kept_columns(g.sort_values("seq_id", kind="stable")["seq"].tolist(), how)
        old = np.flatnonzero(cols)
        return pd.DataFrame({"aln_id": g["aln_id"].iloc[0], "old_col": old, "new_col": np.arange(len(old))})

    kind = aln.schema["aln_id"].dataType.simpleString()
    return aln.select("aln_id", "seq_id", "seq").groupBy("aln_id").applyInPandas(one, f"aln_id {kind}, old_col long, new_col long")


def trim_by_consistency(alns: DataFrame, how: Trim) -> DataFrame:
    """Of each set of alignments of the same rows the most consistent one,
    trimmed by the consistency of its columns (``how.consistency``)."""
    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["aln_id", "seq_id"], kind="stable")
        forms = {a: x["seq"].tolist() for a, x in g.groupby("aln_id", sort=True)}
        values = {a: agreement(rows, [r for b, r in forms.items() if b != a]) for a, rows in forms.items()}
        best = max(sorted(values), key=lambda a: values[a].mean() if len(values[a]) else 0.0)
        part = g[g["aln_id"] == best]
        cols, rows = kept_columns(part["seq"].tolist(), how, values[best])
        m = matrix(part["seq"].tolist())[rows][:, cols]
        out = part.loc[rows, ["set_id", "aln_id", "seq_id"]].copy()
        out["seq"] = [r.tobytes().decode("ascii") for r in m]
        return out

    validate(how)
    kinds = {f.name: f.dataType.simpleString() for f in alns.schema}
    return (
        alns.select("set_id", "aln_id", "seq_id", "seq")
        .groupBy("set_id")
        .applyInPandas(one, f"set_id {kinds['set_id']}, aln_id {kinds['aln_id']}, seq_id {kinds['seq_id']}, seq string")
    )


def agreement(rows: Sequence[str], others: Sequence[Sequence[str]]) -> np.ndarray:
    """Per column: share of its residue pairs that other alignments align too."""

    def ordinals(seqs: Sequence[str]) -> np.ndarray:
        m = matrix(seqs) != _GAP
        return np.where(m, m.cumsum(axis=1), 0)

    mine = ordinals(rows)
    out = np.zeros(mine.shape[1])
    homes = []
    for other in others:
        o = ordinals(other)
        # home[r, n]: column of the n-th residue of row r in the other alignment
        home = np.full((len(o), o.max(initial=0) + 1), -1)
        r, c = np.nonzero(o)
        home[r, o[r, c]] = c
        homes.append(home)
    for col in range(mine.shape[1]):
        here = np.flatnonzero(mine[:, col])
        pairs = len(here) * (len(here) - 1) // 2 * len(homes)
        if pairs:
            same = 0
            for home in homes:
                _, n = np.unique(home[here, mine[here, col]], return_counts=True)
                same += int((n * (n - 1) // 2).sum())
            out[col] = same / pairs
    return out


def value_distribution(df: DataFrame, value: str) -> DataFrame:
    """Columns per value of a statistic, from the greatest, with running share."""
    h = df.groupBy("aln_id", value).agg(F.count(F.lit(1)).alias("n_columns"))
    of = W.partitionBy("aln_id")
    upto = F.sum("n_columns").over(of.orderBy(F.desc(value)).rowsBetween(W.unboundedPreceding, 0))
    return h.withColumns({"n_upto": upto, "share": F.round(upto / F.sum("n_columns").over(of), 6)})


def complement(how: Trim) -> Trim:
    return replace(how, complementary=not how.complementary)


def column_similarity(aln: DataFrame, half: int = 0, scores: Sequence[tuple[str, str, float]] = ()) -> DataFrame:
    """(aln_id, col, similarity) of every column, from 1."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        m = matrix(g.sort_values("seq_id", kind="stable")["seq"].tolist())
        raw = (m == _GAP).sum(axis=0)
        v = window_mean(similarity(m, raw, is_amino(m), scores), half, False)
        return pd.DataFrame({"aln_id": g["aln_id"].iloc[0], "col": np.arange(1, len(v) + 1), "similarity": v.astype(float).round(6)})

    kind = aln.schema["aln_id"].dataType.simpleString()
    return aln.select("aln_id", "seq_id", "seq").groupBy("aln_id").applyInPandas(one, f"aln_id {kind}, col long, similarity double")

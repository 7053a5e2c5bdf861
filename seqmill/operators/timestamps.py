"""Mixed timestamp formats and time zones to one unambiguous form.

Three stages.

1. *Interpretations.* Every value yields all readings it admits, as parallel
   arrays of a code (format, precision, rule cost) and a time. A reading that
   breaks a stated rule (the site's order of day and month, the earlier of two
   equal local times) stays possible but carries ``RULE`` cost.
2. *Viterbi.* Over each source's records in their order, the cheapest path of
   readings: rule costs plus ``SWITCH`` where the format changes and ``BACK``
   where time runs backwards. Of equal paths that with the readings listed first.
3. *Rendering.* With a time of day in UTC to the second, else at the value's
   own precision.

A reading that costs more than the cheapest of its value by over two transitions
lies on no cheapest path and is dropped at once. So a rule decides where there
is one; a value with one reading left is final where it stands, and only sources
that hold a value with several (one without a known order, say) need the path
search, all others pass through without a shuffle.

A source is cut into blocks of consecutive order numbers, so one that holds
most of the rows is spread over many tasks. A block is first reduced to a
(max 8 x 8) cost matrix from its first record's readings to its last one's;
matrices of consecutive blocks are multiplied, ``FAN`` at a time, in as many
levels as a source needs; then, from the top, the ends of each are fixed, and at
last each block finds its path between its own. No task holds more than ``FAN``
matrices or one block, and the result equals an unblocked Viterbi.

Defined results: null, blank and impossible values give no row; a value in a
zone-less form of a source without zone is read as UTC; a source without an
order of day and month gets both readings at no rule cost. Rows with equal
order numbers keep an arbitrary but fixed order (by time).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import broadcast_if_small, cut, spread

RULE, SWITCH, BACK = 100, 1, 1
#: Costs are counted in this unit; below it equal paths are told apart.
UNIT = 1 << 46
#: Rows of a block, and matrices that one task multiplies.
BLOCK, FAN = 8192, 1024
#: Readings kept of one value; the grammar cannot yield more.
MOST = 8
#: Values remembered per task.
_MEMO = 50_000

YEAR, MONTH, DAY, SECOND = range(4)
#: Offsets in minutes of zone abbreviations.
ZONES = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "EAT": 180, "MSK": 180, "IST": 330, "HKT": 480, "SGT": 480, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660,
    "ACST": 570, "ACDT": 630, "AWST": 480, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "COT": -300, "BRT": -180, "ART": -180,
}
_MONTHS = {m: i // 2 + 1 for i, m in enumerate("jan january feb february mar march apr april may may jun june jul july aug august sep september oct october nov november dec december".split())}
_MONTHS["sept"] = 9
_ROMAN = {r: i + 1 for i, r in enumerate("i ii iii iv v vi vii viii ix x xi xii".split())}

_TIME = r"(?:(?:[T ]\s*|,\s*)(?P<H>\d{1,2}):(?P<M>\d\d)(?::(?P<S>\d\d)(?:[.,]\d+)?)?\s*(?P<ap>[AaPp]\.?[Mm]\.?)?\s*(?P<z>[+-]\d\d:?(?:\d\d)?|[A-Za-z]{1,5})?\s*(?:\[[\w/+\-]+\])?)?"
_FORMS = [
    re.compile(p, re.S)
    for p in (
        rf"(?P<y>\d{{4}})(?P<p>[-/.])(?P<m>\d{{1,2}})(?P=p)(?P<d>\d{{1,2}}){_TIME}",
        rf"(?:[A-Za-z]{{3,9}},\s*)?(?P<d>\d{{1,2}})(?:st|nd|rd|th)?[-. /]\s?(?P<mon>[A-Za-z]{{1,9}})\.?[-. /,]\s?(?P<y>\d{{4}}){_TIME}",
        rf"(?P<a>\d{{1,2}})(?P<p>[/.-])(?P<b>\d{{1,2}})(?P=p)(?P<y>\d{{4}}){_TIME}",
        rf"(?:[A-Za-z]{{3,9}},\s*)?(?P<mon>[A-Za-z]{{3,9}})\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}}){_TIME}",
        r"(?P<mon>[A-Za-z]{1,9})\.?[-. /]\s?(?P<y>\d{4})",
        r"(?P<y>\d{4})[-/.](?P<m>\d{1,2})",
        r"(?P<y>\d{4})",
        r"(?P<y>\d{4})(?P<m>\d\d)(?P<d>\d\d)T?(?P<H>\d\d)(?P<M>\d\d)(?P<S>\d\d)(?:[.,]\d+)?(?P<z>Z|[+-]\d\d:?(?:\d\d)?)?",
    )
]
_DIGITS = re.compile(r"\d+")
_EPOCH_FORM, _COMPACT_FORM = 30, 31
_UTC = timezone.utc
_ZERO = datetime(1970, 1, 1)


@lru_cache(maxsize=256)
def _zone(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name) if name else None
    except Exception:
        return None


def _seconds(t: datetime) -> int:
    d = t - _ZERO
    return d.days * 86400 + d.seconds


def _dated(y: int, m: int, d: int) -> datetime | None:
    try:
        return datetime(y, m, d)
    except ValueError:
        return None


def _instants(local: datetime, mark: str | None, zone: str | None) -> list[tuple[int, int]]:
    """UTC seconds of a local time with their rule cost."""
    naive = _seconds(local)
    tz = _zone(zone)
    if mark:
        if mark[0] in "+-":
            digits = mark[1:].replace(":", "").ljust(4, "0")
            minutes = int(digits[:2]) * 60 + int(digits[2:])
            return [(naive - (minutes if mark[0] == "+" else -minutes) * 60, 0)]
        mark = mark.upper()
        if tz is not None and mark not in ("Z", "UTC", "GMT"):
            for fold in (0, 1):
                at = local.replace(tzinfo=tz, fold=fold)
                if at.tzname() == mark:
                    return [(naive - int(at.utcoffset().total_seconds()), 0)]
        return [(naive - ZONES[mark] * 60, 0)] if mark in ZONES else []
    if tz is None:
        return [(naive, 0)]
    first, second = (int(local.replace(tzinfo=tz, fold=f).utcoffset().total_seconds()) for f in (0, 1))
    # fold 0 is the earlier instant of a repeated time, and the offset before the change of a skipped one
    return [(naive - first, 0), (naive - second, RULE)] if first > second else [(naive - first, 0)]


def interpretations(text: str, order: str | None, zone: str | None) -> list[tuple[int, int, int, int]]:
    """All readings of a value: (form, precision, rule cost, UTC seconds)."""
    text = text.strip()
    out: list[tuple[int, int, int, int]] = []
    if not text:
        return out
    if _DIGITS.fullmatch(text):
        n = len(text)
        if n == 4:
            t = _dated(int(text), 1, 1)
            return [(6, YEAR, 0, _seconds(t))] if t else out
        if n in (10, 13):
            return [(_EPOCH_FORM, SECOND, 0, int(text[:10]))]
        if n == 8:
            if t := _dated(int(text[:4]), int(text[4:6]), int(text[6:])):
                out.append((_COMPACT_FORM, DAY, 0, _seconds(t)))
            a, b, y = int(text[:2]), int(text[2:4]), int(text[4:])
            if 1500 <= y <= 2100:
                for k, (d, m) in enumerate(((a, b), (b, a))):
                    if (t := _dated(y, m, d)) and (k == 0 or a != b):
                        cost = RULE * (bool(out and out[0][0] == _COMPACT_FORM) + (order is not None and order != ("dmy", "mdy")[k]))
                        out.append((_COMPACT_FORM + 1 + k, DAY, cost, _seconds(t)))
            return out
    for form, pattern in enumerate(_FORMS):
        if (m := pattern.fullmatch(text)) is None:
            continue
        g = m.groupdict()
        y = int(g["y"])
        if "a" in g:
            a, b = int(g["a"]), int(g["b"])
            days = [(0, b, a), (1, a, b)] if a != b else [(0, b, a)]
        else:
            if g.get("mon"):
                name = g["mon"].lower()
                month = _MONTHS.get(name) or (_ROMAN.get(name) if g["mon"].isupper() else None)
            else:
                month = int(g["m"]) if g.get("m") else 1
            if month is None:
                continue
            days = [(0, month, int(g["d"]) if g.get("d") else 1)]
        for k, month, day in days:
            if (t := _dated(y, month, day)) is None:
                continue
            cost = RULE if "a" in g and order is not None and order != ("dmy", "mdy")[k] else 0
            code = 10 * k + form
            if g.get("H") is None:
                precision = DAY if "a" in g or g.get("d") else MONTH if g.get("mon") or g.get("m") else YEAR
                out.append((code, precision, cost, _seconds(t)))
                continue
            h, minute, s = int(g["H"]), int(g["M"]), int(g["S"] or 0)
            if g.get("ap"):
                if not 1 <= h <= 12:
                    continue
                h = h % 12 + (12 if g["ap"][0] in "pP" else 0)
            if h == 24 and minute == s == 0:
                t, h = t + timedelta(days=1), 0
            if h > 23 or minute > 59 or s > 60:
                continue
            for at, extra in _instants(t + timedelta(hours=h, minutes=minute, seconds=s), g.get("z"), zone):
                out.append((code, SECOND, cost + extra, at))
        return out
    return out


def render(precision: int, at: int) -> str:
    t = _ZERO + timedelta(seconds=at)
    if precision == SECOND:
        return f"{t.year:04d}-{t.month:02d}-{t.day:02d}T{t.hour:02d}:{t.minute:02d}:{t.second:02d}Z"
    if precision == DAY:
        return f"{t.year:04d}-{t.month:02d}-{t.day:02d}"
    return f"{t.year:04d}-{t.month:02d}" if precision == MONTH else f"{t.year:04d}"


def _pack(form: int, precision: int, cost: int, tie: int = 0) -> int:
    return (tie << 32) | (cost << 16) | (precision << 8) | form


def _own(code: int) -> int:
    """A reading's own cost: its rule cost, and what tells equal paths apart."""
    return ((code >> 16) & 0xFFFF) * UNIT + (code >> 32)


def _tie(row: int, place: int) -> int:
    """Prefers the readings listed first; a few bits of the row keep the sums of
    different paths from being equal."""
    return place and (place << 12) | ((row * 0x9E3779B97F4A7C15 + place * 0xC2B2AE3D27D4EB4F) >> 52 & 0xFFF)


def possible(readings: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Readings that can lie on a cheapest path: any other costs more than two
    transitions could save."""
    least = min((r[2] for r in readings), default=0)
    return [r for r in readings if r[2] <= least + 2 * (SWITCH + BACK)]


def _steps(a_codes: Sequence[int], a_times: Sequence[int], b_codes: Sequence[int], b_times: Sequence[int]) -> np.ndarray:
    """Cost of going from each reading of one record to each of the next,
    with the latter's own cost."""
    out = np.empty((len(a_codes), len(b_codes)), np.int64)
    for i, (c, t) in enumerate(zip(a_codes, a_times)):
        for j, (d, u) in enumerate(zip(b_codes, b_times)):
            out[i, j] = (SWITCH * ((c & 255) != (d & 255)) + BACK * (u < t)) * UNIT + _own(d)
    return out


_FAR = np.int64(1 << 62)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of cost matrices: the cheapest way through."""
    return (a[:, :, None] + b[None, :, :]).min(axis=1)


def chain_matrix(codes: list, times: list) -> np.ndarray:
    """Least cost, in units, from each reading of the first record to each of the last."""
    first = codes[0]
    m = np.full((len(first), len(first)), _FAR // 2)
    np.fill_diagonal(m, [_own(c) for c in first])
    for i in range(1, len(codes)):
        m = np.minimum(_joined(m, _steps(codes[i - 1], times[i - 1], codes[i], times[i])), _FAR // 2)
    return m


def best_path(codes: list, times: list, start: int | None = None, end: int | None = None) -> list[int]:
    """Cheapest readings of a chain, with its ends fixed where given."""
    n = len(codes)
    cost = np.array([_own(c) for c in codes[0]], np.int64)
    if start is not None:
        cost[np.arange(len(cost)) != start] = _FAR // 2
    back: list[np.ndarray | None] = [None]
    for i in range(1, n):
        if len(codes[i]) == 1 and len(codes[i - 1]) == 1:
            back.append(None)  # one way only; the cost of a common prefix cannot matter
            continue
        total = cost[:, None] + _steps(codes[i - 1], times[i - 1], codes[i], times[i])
        back.append(total.argmin(axis=0))
        cost = total.min(axis=0)
        cost = cost - cost.min()
    j = int(cost.argmin()) if end is None else end
    path = [j]
    for i in range(n - 1, 0, -1):
        j = 0 if back[i] is None else int(back[i][j])
        path.append(j)
    return path[::-1]


class _Link:
    """Blocks of one source in their order, each a matrix between the readings of
    its ends."""

    def __init__(self, g: pd.DataFrame):
        self.g = g.sort_values("block")
        rows = list(self.g.itertuples())
        self.first = [(list(r.c0), list(r.t0)) for r in rows]
        self.last = [(list(r.c1), list(r.t1)) for r in rows]
        self.inner = [np.array(r.m, np.int64).reshape(len(r.c0), len(r.c1)) for r in rows]

    def step(self, k: int) -> np.ndarray:
        """From the end of block k - 1 to the beginning of k, whose matrix holds its
        first record's own cost."""
        own = np.array([_own(c) for c in self.first[k][0]], np.int64)
        return _steps(*self.last[k - 1], *self.first[k]) - own[None, :]

    def product(self) -> np.ndarray:
        m = self.inner[0]
        for k in range(1, len(self.inner)):
            m = _joined(_joined(m, self.step(k)), self.inner[k])
            m = m - m.min()
        return m

    def ends(self, start: int | None, end: int | None) -> tuple[list[int], list[int]]:
        """Readings at the beginning and end of each block."""
        cost = np.zeros(self.inner[0].shape[0], np.int64)
        if start is not None:
            cost[np.arange(len(cost)) != start] = _FAR // 4
        back = []
        for k, m in enumerate(self.inner):
            for part in ([self.step(k)] if k else []) + [m]:
                total = cost[:, None] + part
                back.append(total.argmin(axis=0))
                cost = total.min(axis=0) - total.min()
        j = int(cost.argmin()) if end is None else int(end)
        picks = [j]
        for b in reversed(back):
            j = int(b[j])
            picks.append(j)
        return picks[::-1][0::2], picks[::-1][1::2]


def _runs(keys: pd.DataFrame) -> list[tuple[int, int]]:
    n = len(keys)
    if not n:
        return []
    change = np.zeros(n, bool)
    change[0] = True
    for c in keys:
        v = keys[c].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    at = np.flatnonzero(change)
    return list(zip(at, np.append(at[1:], n)))


def _whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[dict, dict]]:
    """Groups of a sorted stream as (key, columns), each whole although
    batches cut them; holds one group and one batch."""
    carry: dict | None = None
    at: tuple | None = None
    for batch in batches:
        cols = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        frame = pd.DataFrame({k: cols[k] for k in keys})
        for lo, hi in _runs(frame):
            key = tuple(cols[k][lo] for k in keys)
            part = {n: v[lo:hi] for n, v in cols.items()}
            if key == at:
                for n, v in part.items():
                    carry[n].extend(v)
                continue
            if carry is not None:
                yield dict(zip(keys, at)), carry
            at, carry = key, part
    if carry is not None:
        yield dict(zip(keys, at)), carry


_KEYS = ["source", "field", "block"]
_READINGS = "field string, source string, codes array<bigint>, times array<bigint>, norm string"
_MATRIX = "field string, source string, block long, c0 array<bigint>, t0 array<bigint>, c1 array<bigint>, t1 array<bigint>, m array<bigint>"
_ENDS = "field string, source string, block long, start int, end int"


def read_times(df: DataFrame, sites: DataFrame, id_col: str, fields: Sequence[str], source_col: str) -> DataFrame:
    """Stage 1: a row per value with at least one reading; ``norm`` where only
    one is possible."""
    sites = sites.select(F.col(source_col), F.col("zone_name").alias("_zone"), F.lower("date_order").alias("_order")).dropDuplicates([source_col])
    src = df.select(F.col(id_col).cast("long").alias("_id"), F.col(source_col), *[F.col(f).cast("string").alias(f"_f{i}") for i, f in enumerate(fields)])
    src = spread(src).join(broadcast_if_small(sites), source_col, "left")
    src = src.select("_id", F.col(source_col).cast("string").alias("_source"), "_zone", "_order", *[f"_f{i}" for i in range(len(fields))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            ids, source, zone, order = (batch.column(i).to_pylist() for i in range(4))
            out: list[tuple] = []
            for k, f in enumerate(fields):
                for i, text in enumerate(batch.column(4 + k).to_pylist()):
                    if not text:
                        continue
                    key = (text, order[i], zone[i])
                    if (got := memo.get(key)) is None:
                        got = possible(interpretations(*key)[:MOST])
                        got = ([_pack(a, b, c) for a, b, c, _ in got], [t for *_, t in got], render(got[0][1], got[0][3]) if len(got) == 1 else None)
                        if len(memo) >= _MEMO:
                            memo.clear()
                        memo[key] = got
                    codes, times, norm = got
                    if norm is None and codes:
                        codes = [c | _tie(ids[i] or 0, j) << 32 for j, c in enumerate(codes)]
                    if codes:
                        out.append((ids[i], f, source[i] or "", codes, times, norm))
            if out:
                a, b, c, d, e, g = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(b), pa.array(c), pa.array(d, pa.list_(pa.int64())), pa.array(e, pa.list_(pa.int64())), pa.array(g, pa.string())],
                    names=["_id", "field", "source", "codes", "times", "norm"],
                )

    return src.mapInArrow(read, f"_id long, {_READINGS}")


def normalise_times(
    df: DataFrame,
    sites: DataFrame,
    id_col: str = "info_id",
    fields: Sequence[str] = ("date", "collection_date"),
    source_col: str = "site_code",
    block: int = BLOCK,
    fan: int = FAN,
) -> DataFrame:
    """``id_col``, ``field``, ``norm`` of every value that states a date."""
    readings = cut(read_times(df, sites, id_col, fields, source_col))
    chains = cut(readings.where("norm is null").select("source", "field").distinct())
    done = readings.select("_id", "field", "norm")
    if not chains.isEmpty():
        chains = broadcast_if_small(chains)
        done = readings.join(chains, ["source", "field"], "left_anti").select("_id", "field", "norm")
        done = done.unionByName(_searched(readings.join(chains, ["source", "field"], "left_semi"), block, fan))
    return done.select(F.col("_id").alias(id_col), "field", "norm")


def _searched(readings: DataFrame, block: int, fan: int) -> DataFrame:
    """Viterbi over the chains of ``readings``, in blocks."""
    # order numbers may be sparse: blocks are so wide that they hold ``block`` rows on average
    span = readings.groupBy("source", "field").agg(F.min("_id").alias("_lo"), F.max("_id").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    wide = F.lit(block) * F.greatest(F.lit(1), F.ceil((F.col("_hi") - F.col("_lo") + 1) / F.col("_n")))
    span = cut(span.select("source", "field", "_lo", wide.cast("long").alias("_wide")))
    number = F.when(F.col("_id").isNull(), F.lit(-1)).otherwise(F.floor((F.col("_id") - F.col("_lo")) / F.col("_wide"))).cast("long")
    readings = readings.join(broadcast_if_small(span), ["source", "field"]).select("_id", "field", "source", number.alias("block"), "codes", "times")
    parts = int(readings.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sorted_blocks(d: DataFrame) -> DataFrame:
        return d.repartition(parts, *_KEYS).sortWithinPartitions(*_KEYS, "_id", "times")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for key, g in _whole_runs(batches, _KEYS):
            m = chain_matrix(g["codes"], g["times"])
            m = m - m.min()
            rows.append((key["field"], key["source"], key["block"], g["codes"][0], g["times"][0], g["codes"][-1], g["times"][-1], m.ravel().tolist()))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), [pa.string(), pa.string(), pa.int64(), *[pa.list_(pa.int64())] * 5])],
                names=["field", "source", "block", "c0", "t0", "c1", "t1", "m"],
            )

    ends = _fixed_ends(cut(sorted_blocks(readings).mapInArrow(summarise, _MATRIX)), fan)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, g in _whole_runs(batches, _KEYS):
            # the row that fixes the ends has no codes
            at = next(i for i, c in enumerate(g["codes"]) if c is None)
            codes, times, ids = ([v for i, v in enumerate(g[c]) if i != at] for c in ("codes", "times", "_id"))
            path = best_path(codes, times, g["start"][at], g["end"][at])
            norm = [render((c[j] >> 8) & 255, t[j]) for c, t, j in zip(codes, times, path)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([key["field"]] * len(norm)), pa.array(norm)], names=["_id", "field", "norm"])

    both = readings.withColumns({"start": F.lit(None).cast("int"), "end": F.lit(None).cast("int")}).unionByName(ends, allowMissingColumns=True)
    return sorted_blocks(both).mapInArrow(resolve, "_id long, field string, norm string")


def _fixed_ends(blocks: DataFrame, fan: int) -> DataFrame:
    """(field, source, block, start, end): readings at both ends of every block."""

    def group(g: pd.DataFrame) -> pd.DataFrame:
        x = _Link(g)
        m = x.product()
        a, b = x.g.iloc[0], x.g.iloc[-1]
        return pd.DataFrame({"field": [a["field"]], "source": [a["source"]], "block": [a["above"]], "c0": [a["c0"]], "t0": [a["t0"]], "c1": [b["c1"]], "t1": [b["t1"]], "m": [m.ravel()]})

    def fix(g: pd.DataFrame) -> pd.DataFrame:
        x = _Link(g)
        a = x.g.iloc[0]
        free = pd.isna(a["start"])
        start, end = x.ends(None if free else int(a["start"]), None if free else int(a["end"]))
        return pd.DataFrame({"field": x.g["field"], "source": x.g["source"], "block": x.g["block"], "start": start, "end": end})

    most = blocks.groupBy("source", "field").count().agg(F.max("count")).first()[0] or 0
    if most <= fan:
        free = blocks.withColumns({"start": F.lit(None).cast("int"), "end": F.lit(None).cast("int")})
        return free.groupBy("source", "field").applyInPandas(fix, _ENDS)
    # a level up: the product of the matrices of ``fan`` consecutive blocks
    numbered = blocks.withColumn("above", F.floor(F.col("block") / fan).cast("long"))
    above = cut(numbered.groupBy("source", "field", "above").applyInPandas(group, _MATRIX))
    fixed = _fixed_ends(above, fan).withColumnRenamed("block", "above")
    return numbered.join(fixed, ["source", "field", "above"]).groupBy("source", "field", "above").applyInPandas(fix, _ENDS)

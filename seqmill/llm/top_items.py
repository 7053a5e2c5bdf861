"""Top N items within every group.

Every input split is sorted by group and score: a run. A run keeps at most N
items of a group, so a group with millions of items shrinks before anything is
moved. Runs are stored by bucket of groups (the files of the shuffle), and a
bucket's runs are merged by a loser tree: its root is the best item left, and
after N items of a group every run seeks straight to its next group. A merging
task holds some whole groups of its sorted stream at a time. With very many runs,
blocks of ``FAN`` runs are merged first, so that no merge is wider.

Order: each score descending with missing ones last, then the id ascending, so
ties and repeated rows always come out the same. Defined results: null groups
give none, groups of fewer than N items give all, an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

#: Runs merged at a time.
FAN = 64
#: Rows from which a merging task works off the groups it holds.
ROWS = 20_000


class LoserTree:
    """Tournament over k cursors; an inner node holds the loser of its match."""

    def __init__(self, keys: list):
        """``keys``: each cursor's current key, ``None`` when it is at its end."""
        self.k = len(keys)
        self.keys = keys
        self.nodes = [-1] * self.k
        self.winner = 0
        if self.k:
            self.winner = self._build(1)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        if x is None or y is None:
            return x is not None or (y is None and a < b)
        return x < y or (x == y and a < b)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._less(a, b) else (b, a)
        self.nodes[node] = lose
        return win

    def replay(self, cursor: int) -> None:
        """The winner's key changed: play its matches up to the root again."""
        win, node, nodes, keys = cursor, (cursor + self.k) >> 1, self.nodes, self.keys
        while node:
            other = nodes[node]
            x, y = keys[win], keys[other]
            if y is not None and (x is None or y < x or (x == y and other < win)):
                nodes[node], win = win, other
            node >>= 1
        self.winner = win

    def rebuild(self) -> None:
        if self.k:
            self.winner = self._build(1)


def merge_runs(runs: Sequence[tuple[np.ndarray, list[tuple]]], n: int) -> Iterator[tuple[int, int, int]]:
    """(run, row, position) of the first ``n`` rows of each group.

    A run is its group codes, ascending, and its keys ``(code, ...)``, ascending.
    """
    nxt = [np.append(np.searchsorted(codes, codes, "right"), len(codes)).tolist() for codes, _ in runs]
    keys = [k for _, k in runs]
    at = [0] * len(runs)
    tree = LoserTree([k[0] if k else None for k in keys])
    group, taken = None, 0
    while runs and (head := tree.keys[tree.winner]) is not None:
        if head[0] != group:
            group, taken = head[0], 0
        if taken < n:
            r = tree.winner
            taken += 1
            yield r, at[r], taken
            at[r] += 1
            tree.keys[r] = keys[r][at[r]] if at[r] < len(keys[r]) else None
            tree.replay(r)
            if taken < n:
                continue
        moved = False
        for r, k in enumerate(tree.keys):
            if k is not None and k[0] == group:  # seek to the run's next group
                at[r] = nxt[r][at[r]]
                tree.keys[r] = keys[r][at[r]] if at[r] < len(keys[r]) else None
                moved = True
        if moved:
            tree.rebuild()


def top_items(df: DataFrame, group: str, scores: Sequence[Column], id_col: str, n: int = 3, position: str = "pos", fan: int = FAN) -> DataFrame:
    """``group``, ``position`` (1..n), ``id_col``."""
    names = [f"s{i}" for i in range(len(scores))]
    cleaned = [F.when(~F.isnan(s.cast("double")), s.cast("double")).alias(c) for s, c in zip(scores, names)]
    src = df.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), *cleaned, F.col(id_col).alias("id"))
    kinds = {c: src.schema[c].dataType.simpleString() for c in ("g", "id")}
    order = ["g", *[F.col(c).desc_nulls_last() for c in names], "id"]
    ddl = f"g {kinds['g']}, {', '.join(f'{c} double' for c in names)}, id {kinds['id']}, run int"

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId()
        last, count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(0).dictionary_encode().indices.to_numpy()
            start = np.concatenate(([0], np.flatnonzero(codes[1:] != codes[:-1]) + 1))
            place = np.arange(len(codes)) - np.repeat(start, np.diff(np.append(start, len(codes))))
            if batch.column(0)[0].as_py() == last:  # the group goes on from the batch before
                end = start[1] if len(start) > 1 else len(codes)
                place[:end] += count
            last, count = batch.column(0)[-1].as_py(), int(place[-1]) + 1
            kept = pa.array(np.flatnonzero(place < n))
            yield pa.RecordBatch.from_arrays([*(c.take(kept) for c in batch.columns), pa.array(np.full(len(kept), run), pa.int32())], names=[*batch.schema.names, "run"])

    def merge(table: pa.Table, last: bool) -> pa.Table:
        """First items of each group of some whole groups, from all their runs."""
        table = table.combine_chunks()
        codes = table.column("g").combine_chunks().dictionary_encode().indices.to_numpy()  # groups ascend
        scores = [np.where(np.isnan(v), np.inf, -v) for v in (table.column(c).to_numpy().astype(float) for c in names)]
        lists = [codes.tolist(), *(s.tolist() for s in scores), table.column("id").to_pylist()]
        run = table.column("run").to_numpy()
        by_run = np.argsort(run, kind="stable")
        rows_of = np.split(by_run, np.flatnonzero(np.diff(run[by_run])) + 1)
        runs = [(codes[rows], [tuple(c[i] for c in lists) for i in rows.tolist()]) for rows in rows_of]
        picked, places = [], []
        for r, row, place in merge_runs(runs, n):
            picked.append(int(rows_of[r][row]))
            places.append(place)
        out = table.take(pa.array(picked, pa.int64()))
        if last:
            return pa.table({"g": out.column("g"), "place": pa.array(places, pa.int64()), "id": out.column("id")})
        return out.set_column(out.schema.get_field_index("run"), "run", pa.array(out.column("run").to_numpy() // fan, pa.int32()))

    def merger(last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # the stream is sorted by group and run: some whole groups are held at a
            # time, a group being at most ``fan`` runs of ``n`` items
            held: pa.Table | None = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                piece = pa.Table.from_batches([batch])
                held = piece if held is None else pa.concat_tables([held, piece])
                if held.num_rows < ROWS:
                    continue
                codes = held.column("g").combine_chunks().dictionary_encode().indices.to_numpy()
                end = int(np.searchsorted(codes, codes[-1]))  # the last group may go on
                if end:
                    yield from merge(held.slice(0, end), last).to_batches()
                    held = held.slice(end)
            if held is not None and held.num_rows:
                yield from merge(held, last).to_batches()

        return merged

    by = ["g", "run", *order[1:]]
    runs = src.sortWithinPartitions(*order).mapInArrow(runs_of, ddl)
    width = src.rdd.getNumPartitions()
    while width > fan:
        runs = runs.repartition("g", F.floor(F.col("run") / fan)).sortWithinPartitions(*by).mapInArrow(merger(False), ddl)
        width = -(-width // fan)
    done = runs.repartition("g").sortWithinPartitions(*by).mapInArrow(merger(True), f"g {kinds['g']}, place long, id {kinds['id']}")
    return done.select(F.col("g").alias(group), F.col("place").alias(position), F.col("id").alias(id_col))

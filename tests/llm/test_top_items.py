import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqmill.llm.top_items import LoserTree, merge_runs, top_items


def test_loser_tree_sorts():
    rng = random.Random(4)
    for k in range(1, 9):
        runs = [sorted((rng.randrange(20),) for _ in range(rng.randrange(0, 7))) for _ in range(k)]
        at = [0] * k
        tree = LoserTree([r[0] if r else None for r in runs])
        out = []
        while tree.keys[tree.winner] is not None:
            r = tree.winner
            out.append(runs[r][at[r]])
            at[r] += 1
            tree.keys[r] = runs[r][at[r]] if at[r] < len(runs[r]) else None
            tree.replay(r)
        assert out == sorted(x for r in runs for x in r)


def test_merge_seeks_to_the_next_group():
    rng = random.Random(6)
    runs = []
    for _ in range(5):
        keys = sorted((rng.randrange(4), rng.randrange(9)) for _ in range(30))
        runs.append((np.array([k[0] for k in keys]), keys))
    got = [(runs[r][1][i], p) for r, i, p in merge_runs(runs, 3)]
    want = []
    for g in range(4):
        best = sorted(k for _, keys in runs for k in keys if k[0] == g)[:3]
        want += [(k, p + 1) for p, k in enumerate(best)]
    assert got == want


@pytest.mark.parametrize("fan", [2, 64])
def test_against_brute_force(spark, fan):
    rng = random.Random(9)
    score = lambda: rng.choice([None, float("nan"), 0.5, 0.9, 1.0])
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), score(), score(), i, 3, "x") for i in range(400)]
    df = spark.createDataFrame(rows, "taxon string, a double, b double, id long, run int, g string").repartition(7)
    got = sorted(map(tuple, top_items(df, "taxon", [F.col("a"), F.col("b")], "id", 3, fan=fan).collect()))
    clean = lambda v: float("-inf") if v is None or v != v else v
    want = []
    for g in ("hot", "a", "b"):
        best = sorted((r for r in rows if r[0] == g), key=lambda r: (-clean(r[1]), -clean(r[2]), r[3]))[:3]
        want += [(g, p + 1, r[3]) for p, r in enumerate(best)]
    assert got == sorted(want)
    assert top_items(df.limit(0), "taxon", [F.col("a")], "id").count() == 0


def test_a_merging_task_holds_few_rows(spark, monkeypatch):
    from seqmill.llm import top_items as T

    rng = random.Random(12)
    rows = [(rng.choice(["hot", f"g{rng.randrange(300)}"]), float(rng.randrange(5)), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "taxon string, a double, id long").repartition(9)
    want = sorted(map(tuple, top_items(df, "taxon", [F.col("a")], "id").collect()))
    monkeypatch.setattr(T, "ROWS", 7)  # sent to the tasks with the closure
    assert sorted(map(tuple, top_items(df, "taxon", [F.col("a")], "id", fan=3).collect())) == want
    best = sorted((-a, i) for g, a, i in rows if g == "hot")[:3]
    assert [(p, i) for g, p, i in want if g == "hot"] == [(k + 1, i) for k, (_, i) in enumerate(best)]

import random
from statistics import median_low

import pytest

from seqmill.operators import heavy_keys


def brute(rows):
    out = {}
    for k, v in rows:
        if k is not None:
            out.setdefault(k, []).append(v)
    return sorted((k, len(v), median_low([x for x in v if x is not None]) if any(x is not None for x in v) else None) for k, v in out.items())


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    rows = [("hot", rng.randrange(-5000, 5000)) for _ in range(4000)]
    rows += [(rng.choice("abcdefgh"), rng.choice([None, rng.randrange(40), 10**12 + rng.randrange(9)])) for _ in range(500)]
    rows += [(None, 5), ("only null", None), ("one", 7), ("tie", 3), ("tie", 3)]
    df = spark.createDataFrame(rows, "taxon_name string, record_length long").repartition(5)
    assert sorted(map(tuple, heavy_keys.key_figures(df).collect())) == brute(rows)
    assert heavy_keys.key_figures(df.limit(0)).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([("x", 4, "k"), ("x", 2, "block")], "k string, block long, n string")
    assert list(map(tuple, heavy_keys.key_figures(df, "k", "block").collect())) == [("x", 2, 2)]


def test_dense_and_sparse_accumulators_agree():
    import pyarrow as pa

    keys = pa.array(["a", "b", "a", "a", "b"])
    for values in ([1, 2, 1, 300, 2], [1, 2, 1, 10**9, 2]):
        batch = pa.RecordBatch.from_arrays([keys, pa.array(values, pa.int64())], names=["k", "v"])
        got = {}
        for b in heavy_keys._accumulate(iter([batch])):
            for k, block, o, c in zip(*(x.to_pylist() for x in b.columns)):
                for x, n in zip(o, c):
                    got[k, block * heavy_keys.WIDTH + x] = n
        assert got == {("a", 1): 2, ("a", values[3]): 1, ("b", 2): 2}


def test_levels_of_splits(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "a", "b"]), rng.choice([None, rng.randrange(700)])) for _ in range(600)]
    df = spark.createDataFrame(rows, "taxon_name string, record_length int").repartition(13)
    assert sorted(map(tuple, heavy_keys.key_figures(df, fan=2).collect())) == brute(rows)


def test_one_key_in_ten_thousand_splits_takes_one_array(monkeypatch):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    n, width = 10_000, heavy_keys.WIDTH

    def batches():
        for i in range(n):
            at = np.arange(width)
            yield pa.RecordBatch.from_arrays([pa.array(["hot"]), pa.array([i // 6000], pa.int64()), pa.array([at], pa.list_(pa.int32())), pa.array([at + 1], pa.list_(pa.int64()))], names=["k", "block", "offsets", "counts"])

    before = pa.total_allocated_bytes()
    tracemalloc.start()
    got, most = [], 0
    for b in heavy_keys._add(batches()):
        got += b.to_pylist()
        most = max(most, pa.total_allocated_bytes() - before)
    assert tracemalloc.get_traced_memory()[1] < 3_000_000 and most < 3_000_000
    tracemalloc.stop()
    assert [(r["block"], r["total"], r["counts"][:2]) for r in got] == [(0, 6000 * width * (width + 1) // 2, [6000, 12000]), (1, 4000 * width * (width + 1) // 2, [4000, 8000])]


def test_only_whole_numbers(spark):
    with pytest.raises(TypeError):
        heavy_keys.key_figures(spark.createDataFrame([("a", 1.5)], "taxon_name string, record_length double"))

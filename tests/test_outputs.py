import pytest
from pyspark.sql import functions as F

from seqmill.functions import sequence as S
from seqmill.operators import align
from seqmill.sources import outputs
from seqmill import runtime


def test_backup_and_controlled_outputs(spark, tmp_path):
    d = str(tmp_path)
    assert outputs.backup(spark, d, ["kept"]) is None
    spark.range(3).write.parquet(f"{d}/kept")
    spark.range(2).write.parquet(f"{d}/filtered")
    to = outputs.backup(spark, d, ["kept", "none", "filtered"])
    assert spark.read.parquet(f"{to}/kept").count() == 3 and spark.read.parquet(f"{to}/filtered").count() == 2
    assert not (tmp_path / "kept").exists()
    outputs.accept_controlled(spark, d, "controlled", "checked")  # nothing there
    spark.range(5).write.parquet(f"{d}/checked")
    spark.range(4).write.parquet(f"{d}/controlled")
    outputs.accept_controlled(spark, d, "controlled", "checked")
    assert spark.read.parquet(f"{d}/checked").count() == 4 and spark.read.parquet(f"{d}/not_controlled/checked").count() == 5


def test_markers(spark, tmp_path):
    df = spark.createDataFrame([("ITS", "Aa bb", "AC"), ("matK", "Cc dd", "G"), ("matK", "Aa bb", "T")], "marker string, organism string, seq string")
    got = outputs.per_marker(df, ["ITS", "matK"], lambda x, m: x.agg(F.count("seq").alias("n")))
    assert sorted(map(tuple, got.collect())) == [(1, "ITS"), (2, "matK")]
    whole = outputs.collected({m: df.where(F.col("marker") == m) for m in ("ITS", "matK")})
    assert sorted(map(tuple, whole.collect())) == [("ITS", "Aa_bb", "AC"), ("matK", "Aa_bb", "T"), ("matK", "Cc_dd", "G")]
    outputs.write_sorted(df, str(tmp_path / "s"), ["organism", "seq"])
    back = spark.read.parquet(str(tmp_path / "s")).select("*", F.input_file_name().alias("_f"), F.monotonically_increasing_id().alias("_i")).orderBy("_f", "_i")
    assert [r.seq for r in back.collect()] == ["AC", "T", "G"]
    with pytest.raises(ValueError):
        outputs.per_marker(df, [], lambda x, m: x)


def test_covers(spark):
    df = spark.createDataFrame([("AC--GT",), ("------",), ("ACGTAC",), (None,)], "seq string")
    got = [r[0] for r in df.select(S.covers(F.col("seq"), F.lit(1), F.lit(5), 0.5)).collect()]
    assert got == [True, False, True, None]


def test_add_rounds(spark):
    rounds = [[("a", "1", "ACGTACGT"), ("a", "2", "ACGTCGT")], [("a", "3", "ACGTTTACGT"), ("b", "4", "GG")], [("b", "5", "GAG"), ("a", "6", "ACG")]]
    frames = [spark.createDataFrame(r, "aln_id string, seq_id string, seq string") for r in rounds]
    got = {(r.aln_id, r.seq_id): r.seq for r in align.add_rounds(frames).collect()}
    assert {k: v.replace("-", "") for k, v in got.items()} == {(a, i): s for r in rounds for a, i, s in r}
    for g in "ab":
        assert len({len(v) for (a, _), v in got.items() if a == g}) == 1


def test_broadcast_size_is_counted_in_bytes(spark):
    df = spark.createDataFrame([("x" * 1000, [1, 2])] * 20, "a string, b array<int>")
    assert runtime.is_small(df) and not runtime.is_small(df, size=10_000) and not runtime.is_small(df, rows=19)


def test_long_pairs_are_aligned_exactly(monkeypatch):
    import random

    rng = random.Random(2)
    pairs = [tuple("".join(rng.choice("ACG") for _ in range(rng.randrange(30))) for _ in range(2)) for _ in range(60)]
    want = [align.global_pair(a, b, free_ends=f) for a, b in pairs for f in (False, True)]
    monkeypatch.setattr(align, "CELLS", 20)
    assert [align.global_pair(a, b, free_ends=f) for a, b in pairs for f in (False, True)] == want

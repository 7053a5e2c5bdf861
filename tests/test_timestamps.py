import itertools
import random

import pytest

from seqmill.operators import timestamps as T

BERLIN, YORK = "Europe/Berlin", "America/New_York"


@pytest.mark.parametrize(
    "text, order, zone, want",
    [
        ("2020-01-02", "dmy", BERLIN, "2020-01-02"),
        ("02/03/2020", "dmy", BERLIN, "2020-03-02"),
        ("02/03/2020", "mdy", YORK, "2020-02-03"),
        ("31.12.2019 05:50", "dmy", "Asia/Kolkata", "2019-12-31T00:20:00Z"),
        ("18-MAR-2019", "dmy", BERLIN, "2019-03-18"),
        ("14 IX 1990", "dmy", BERLIN, "1990-09-14"),
        ("Mar-2019", "dmy", BERLIN, "2019-03"),
        ("June 27, 2019", "mdy", YORK, "2019-06-27"),
        ("2019-07", None, None, "2019-07"),
        ("1999", None, None, "1999"),
        ("20190704", None, None, "2019-07-04"),
        ("1689235791", None, None, "2023-07-13T08:09:51Z"),
        ("1621352639167", None, None, "2021-05-18T15:43:59Z"),
        ("Wed, 14 Oct 2020 15:47:59 +0300", "dmy", BERLIN, "2020-10-14T12:47:59Z"),
        ("2018-10-07T04:01:16+11:00[Australia/Sydney]", "dmy", BERLIN, "2018-10-06T17:01:16Z"),
        ("2009-03-03T03:47:17.759Z", "dmy", BERLIN, "2009-03-03T03:47:17Z"),
        ("11/3/2019 1:42 am", "mdy", YORK, "2019-11-03T05:42:00Z"),  # twice: the earlier
        ("2023-03-26 02:30:00", "dmy", BERLIN, "2023-03-26T01:30:00Z"),  # skipped: the offset before
        ("2021-10-31 02:55:48 CET", "dmy", BERLIN, "2021-10-31T01:55:48Z"),
        ("12/1/2020 12:05 AM", "mdy", "Etc/UTC", "2020-12-01T00:05:00Z"),
        ("2019-02-29", "dmy", BERLIN, None),
        ("99/99/2000", "dmy", BERLIN, None),
        ("n/a", "dmy", BERLIN, None),
        ("   ", "dmy", BERLIN, None),
    ],
)
def test_reading(text, order, zone, want):
    got = T.interpretations(text, order, zone)
    if want is None:
        assert got == []
    else:
        best = min(got, key=lambda x: x[2])
        assert T.render(best[1], best[3]) == want


def cost(codes, times, path):
    total = sum(c[j] >> 16 for c, j in zip(codes, path))
    for i in range(1, len(path)):
        a, b = codes[i - 1][path[i - 1]], codes[i][path[i]]
        total += T.SWITCH * ((a & 255) != (b & 255)) + T.BACK * (times[i][path[i]] < times[i - 1][path[i - 1]])
    return total


def chain(rng, n):
    codes, times = [], []
    for _ in range(n):
        k = rng.choice([1, 1, 2, 3])
        codes.append([rng.choice([0, 0, 100]) << 16 | rng.randrange(3) for _ in range(k)])
        times.append([rng.randrange(50) for _ in range(k)])
    return codes, times


def test_viterbi_against_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        codes, times = chain(rng, rng.randrange(1, 7))
        best = min(cost(codes, times, p) for p in itertools.product(*[range(len(c)) for c in codes]))
        assert cost(codes, times, T.best_path(codes, times)) == best
        m = T.chain_matrix(codes, times)
        assert m.min() == best * T.UNIT


def test_blocks_change_nothing(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["05/04/2019", "13/04/2019", "04/13/2019", "2019-05-04", "06/07/2019 10:00", None, "x"]), None, rng.choice(["S", "S", "U", None])) for i in range(1, 300)]
    df = spark.createDataFrame(rows, "info_id long, date string, collection_date string, site_code string")
    sites = spark.createDataFrame([("S", BERLIN, None), ("U", YORK, "mdy")], "site_code string, zone_name string, date_order string")
    run = lambda block: sorted(map(tuple, T.normalise_times(df, sites, block=block).collect()))
    whole = run(100_000)
    assert whole == run(4) == run(50)
    assert len(whole) == sum(1 for r in rows if r[1] not in (None, "x"))
    # neighbours decide where no order is known: a switch of format costs
    only = spark.createDataFrame([(1, "04/13/2019", "S"), (2, "05/06/2019", "S"), (3, "07/25/2019", "S")], "info_id long, date string, site_code string")
    assert [r.norm for r in T.normalise_times(only, sites, fields=["date"]).orderBy("info_id").collect()] == ["2019-04-13", "2019-05-06", "2019-07-25"]
    assert T.normalise_times(df.limit(0), sites).count() == 0


def unblocked(rows, order, zone):
    """Every source's path in one piece, over all readings."""
    out = []
    for source in {r[2] for r in rows}:
        mine = []
        for i, text, s in sorted(rows):
            if s == source and text and (got := T.interpretations(text, order[s], zone)):
                mine.append((i, [T._pack(a, b, c, T._tie(i, j)) for j, (a, b, c, _) in enumerate(got)], [t for *_, t in got]))
        if mine:
            ids, codes, times = zip(*mine)
            out += [(i, T.render((c[j] >> 8) & 255, t[j])) for i, c, t, j in zip(ids, codes, times, T.best_path(list(codes), list(times)))]
    return sorted(out)


@pytest.mark.parametrize("gap", [1, 10**6])
def test_levels_and_sparse_numbers_equal_one_piece(spark, gap):
    rng = random.Random(9)
    day = lambda: f"{rng.randrange(1, 13):02d}/{rng.randrange(1, 13):02d}/{rng.choice((2018, 2019))}"
    order = {"S": None, "U": "mdy", "V": None}
    rows = [(i * gap, day() if rng.random() < 0.8 else rng.choice(["2019-05-04", "05/25/2019", "25/05/2019", "11/3/2019 1:42"]), rng.choice("SSUV")) for i in range(1, 400)]
    df = spark.createDataFrame(rows, "info_id long, date string, site_code string")
    sites = spark.createDataFrame([(s, YORK, o) for s, o in order.items()], "site_code string, zone_name string, date_order string")
    want = unblocked(rows, order, YORK)
    for block, fan in ((5, 3), (1000, 1024)):
        got = T.normalise_times(df, sites, fields=["date"], block=block, fan=fan)
        assert sorted((r.info_id, r.norm) for r in got.collect()) == want


def test_neighbours_decide_where_no_order_is_known(spark):
    sites = spark.createDataFrame([("S", BERLIN, None)], "site_code string, zone_name string, date_order string")
    for sure, norm in (("25/04/2019", "2019-04-05"), ("04/25/2019", "2019-05-04")):
        df = spark.createDataFrame([(1, sure, "S"), (2, "05/04/2019", "S"), (3, sure, "S")], "info_id long, date string, site_code string")
        got = T.normalise_times(df, sites, fields=["date"]).where("info_id = 2").first().norm
        assert got == norm


def test_dropped_readings_lie_on_no_cheapest_path():
    rng = random.Random(4)
    for _ in range(200):
        whole, kept = [], []
        for i in range(rng.randrange(1, 7)):
            got = [(rng.randrange(3), 2, rng.choice([0, 0, 100, 200]), rng.randrange(50)) for _ in range(rng.choice([1, 2, 3]))]
            whole.append(got)
            kept.append(T.possible(got))
        cost_of = lambda x: T.chain_matrix([[T._pack(a, b, c) for a, b, c, _ in r] for r in x], [[t for *_, t in r] for r in x]).min()
        assert cost_of(whole) == cost_of(kept)

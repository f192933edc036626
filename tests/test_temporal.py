import datetime as dt
import random

import pytest
from helpers import rows

from logquarry.operators.temporal import asof_join, overlap_join

START = dt.datetime(2031, 3, 4)


def _moment(rng, hours=30):
    return None if rng.random() < 0.05 else START + dt.timedelta(minutes=rng.randrange(60 * hours))


def _group(rng):
    return rng.choice(["hot"] * 6 + ["a", "b", None])


@pytest.mark.parametrize("bucket", [60, 3600, 10**8])
def test_last_row_before(spark, bucket):
    rng = random.Random(bucket)
    left = [(_group(rng), _moment(rng), i, f"l{i}") for i in range(150)] + [("alone", START, 0, "l")]
    right = [(_group(rng), _moment(rng), i, f"r{i}" if i % 7 else None) for i in range(200)]
    want = []
    for g, t, i, name in left:
        before = [(u, j, v) for h, u, j, v in right if h == g and t is not None and u is not None and (u, j) < (t, i)]
        last = max(before, key=lambda x: x[:2], default=(None, None, None))
        want.append((g, t, i, name, last[0], last[2]))
    l_df = spark.createDataFrame(left, "g string, t timestamp_ntz, i long, name string").repartition(3)
    r_df = spark.createDataFrame(right, "g string, t timestamp_ntz, i long, value string").repartition(5)
    r_df = r_df.withColumn("seen", r_df["t"])
    got = asof_join(l_df, r_df, ["g"], "t", "i", ["seen", "value"], bucket)
    assert got.columns == ["g", "t", "i", "name", "seen", "value"]
    assert sorted(map(repr, rows(got))) == sorted(map(repr, want))
    assert rows(asof_join(l_df.limit(0), r_df, ["g"], "t", "i", ["value"])) == []
    assert {r[-1] for r in rows(asof_join(l_df, r_df.limit(0), ["g"], "t", "i", ["value"]))} == {None}
    with pytest.raises(ValueError, match="both sides"):
        asof_join(l_df, r_df, ["g"], "t", "i", ["i"])


@pytest.mark.parametrize("bucket", [600, 7200])
def test_overlaps(spark, bucket, capsys):
    rng = random.Random(bucket)

    def spans(n, longest):
        out = []
        for i in range(n):
            first = _moment(rng)
            length = dt.timedelta(minutes=rng.choice([0, 1, 10, 120, rng.randrange(-30, longest)]))
            out.append((_group(rng), first, first and rng.choice([first + length, first + length, None]), i))
        return out

    left, right = spans(120, 600), spans(100, 60)
    want = [
        (g, a, b, i, j) for g, a, b, i in left for h, c, d, j in right
        if g == h and None not in (a, b, c, d) and a <= b and c <= d and a <= d and c <= b
    ]
    l_df = spark.createDataFrame(left, "g string, a timestamp_ntz, b timestamp_ntz, i long").repartition(3)
    r_df = spark.createDataFrame(right, "g string, a timestamp_ntz, b timestamp_ntz, j long").repartition(2)
    got = overlap_join(l_df, r_df, ["g"], ("a", "b"), ("a", "b"), ["j"], bucket)
    assert sorted(map(repr, rows(got))) == sorted(map(repr, want)) and len(want) > 100
    got.explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert rows(overlap_join(l_df.limit(0), r_df, ["g"], ("a", "b"), ("a", "a"), ["j"])) == []

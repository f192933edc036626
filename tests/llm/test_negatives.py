import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logquarry.llm import negatives as N

SCHEMA = "vec_id long, label int, vector array<long>"


def _plain(rows, anchors, positives=5, negatives=3, low=50, high=95):
    rows = sorted({(i, x, tuple(v)) for i, x, v in rows if None not in (i, x, v) and None not in v})
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, v in rows:
        if not anchors(i):
            continue
        scored = sorted((-score(v, w), j, x) for j, x, w in rows)
        for p, j, _ in [s for s in scored if s[2] == label and s[1] != i][:positives]:
            found = [(j2, -n) for n, j2, x in scored if x != label and low * -p <= 100 * -n <= high * -p]
            out += [(i, j, r, j2, -p, n) for r, (j2, n) in enumerate(found[:negatives], 1)]
    return sorted(out)


def _got(df):
    names = "anchor_id positive_id rank negative_id positive_score negative_score".split()
    return sorted(tuple(r) for r in df.select(names).collect())


def _mine(spark, rows, parts=5, every=5, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return _got(N.hard_negatives(df, F.col("vec_id") % every == 0, **options))


def _rows(seed, count, width, spread, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(3, width))
    for i in range(count):
        yield i, int(rng.integers(labels)), [int(x) for x in np.floor(40 * (centres[rng.integers(3)] + spread * rng.normal(size=width)))]


def test_packed_vectors(spark):
    values = [0, 1, -1, 255, -256, 2**40, -(2**62)]
    df = spark.createDataFrame([(values,), ([],)], "v array<long>")
    packed = [bytes(r[0]) for r in df.select(N.pack(df, "v")).collect()]
    assert np.frombuffer(packed[0], "<i8").tolist() == values and packed[1] == b""


def test_exact_products():
    a = np.array([[2**30, 1], [-(2**30), 3]])
    assert N.inner_products(a, a).tolist() == [[2**60 + 1, 3 - 2**60], [3 - 2**60, 2**60 + 9]]
    with pytest.raises(OverflowError):
        N.inner_products(a * 4, a)


@pytest.mark.parametrize("spread", [0.2, 2.0])
def test_equals_all_pairs(spark, monkeypatch, spread):
    for name, value in (("SLICE", 64), ("MEMBERS", 7), ("SAMPLE", 150), ("CLUSTERS", 3)):
        monkeypatch.setattr(N, name, value)
    rows = list(_rows(int(spread * 10), 400, 6, spread))
    expected = _plain(rows, lambda i: i % 2 == 0)
    assert expected and _mine(spark, rows, every=2) == expected


def test_ties_copies_and_zeros(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(3), [rng.randrange(-1, 3) for _ in range(2)]) for i in range(200)]
    rows += rows[:40] + [(i, 1, [2, 2]) for i in range(300, 420)] + [(0, 2, [1, 1]), (500, 0, [0, 0]), (505, 1, [])]
    rows += [(510, 1, [2]), (515, 2, [-3, -3]), (520, 2, [-3, -3])]
    assert _mine(spark, rows) == _plain(rows, lambda i: i % 5 == 0)


def test_other_numbers(spark):
    rows = list(_rows(7, 120, 4, 0.5))
    asked = dict(positives=2, negatives=7, low=-20, high=99)
    assert _mine(spark, rows, **asked) == _plain(rows, lambda i: i % 5 == 0, **asked)


def test_nulls_and_empty_tables(spark):
    rows = [(0, 0, [9, 9]), (1, 0, [8, 8]), (2, 1, [5, 6]), (3, None, [5, 5]), (4, 1, None), (None, 1, [5, 5]), (5, 1, [5, None])]
    expected = [(0, 1, 1, 2, 144, 99)]
    assert _mine(spark, rows) == _plain(rows, lambda i: i % 5 == 0) == expected
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("x")).withColumn("cluster", F.lit("y"))
    assert _got(N.hard_negatives(df, F.col("vec_id") % 5 == 0)) == expected
    assert _mine(spark, [(1, 1, [1])]) == [] and _got(N.hard_negatives(df.limit(0), F.lit(True))) == []


def test_a_walk_stops_when_nothing_can_follow():
    walk = N.Walk(np.array([[10, 0]]), np.array([1]), np.array([0]), np.array([[-(2**62), 2**62, -(2**62)]]), True, 1)
    one = lambda v, i: (np.array([v]), np.array([1]), np.array([i]), np.array([i]))
    assert walk.feed(9.0, *one([9, 0], 3)) and walk.feed(9.0, *one([9, 0], 2)) and walk.feed(9.0, *one([8, 1], 1))
    assert not walk.feed(8.9, *one([8, 0], 0)) and walk.kept.tolist() == [[0, 90, 2, 2]]

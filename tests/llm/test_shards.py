import zlib
from collections import Counter

import numpy as np

from logquarry.llm import shards as S


def _jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_equals_the_loop():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2)
    for n in (1, 2, 7, 40, 1000):
        assert S.jump(keys.copy(), n).tolist() == [_jump(int(k), n) for k in keys]


def test_one_more_shard_takes_only_into_itself():
    keys = np.arange(20_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    before, after = S.jump(keys.copy(), 40), S.jump(keys.copy(), 41)
    moved = before != after
    assert set(after[moved]) == {40} and 300 < moved.sum() < 700
    assert max(Counter(before.tolist()).values()) < 1.2 * 500


def _check(rows, given, shards):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in given
    )
    for k in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
    of = {}
    for r in rows:
        assert 0 <= r["shard"] < shards and of.setdefault(r["doc_id"], (r["shard"], r["grown_shard"])) == (r["shard"], r["grown_shard"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], shards)


def test_rows(spark, docs, clashing):
    given = [(i, f"text {i}é" * (i % 5)) for i in range(300)] + [(5, "other"), (5, "other"), (None, None), (None, None), (7, "x" * 300_000)]
    _check(S.assign_shards(clashing(docs(given)), 40).collect(), given, 40)
    _check(S.assign_shards(docs(given, parts=1), 1).collect(), given, 1)


def test_many_copies_of_one_row(docs, monkeypatch):
    monkeypatch.setattr(S, "COPIES", 16)
    given = [(1, "same")] * 1000 + [(i, "x") for i in range(100)]
    _check(S.assign_shards(docs(given), 3).collect(), given, 3)


def test_order_of_input_does_not_matter(docs):
    given = [(i, f"t{i}") for i in range(200)]
    a, b = (sorted(map(tuple, S.assign_shards(docs(x, parts=p), 5).collect())) for x, p in ((given, 2), (given[::-1], 5)))
    assert a == b


def test_empty(docs):
    assert S.assign_shards(docs([(1, "x")]).limit(0), 40).collect() == []


def test_a_key_of_many_texts_is_spread(docs, monkeypatch):
    """One key with most of all rows: no part, and so no task, numbers more than a few of them."""
    monkeypatch.setattr(S, "GROUPS", 64)
    given = [(1, f"text {i}") for i in range(2000)] + [(i, "x") for i in range(2, 50)]
    out = S.assign_shards(docs(given), 4)
    _check(out.collect(), given, 4)
    hashed = docs(given).where("doc_id = 1").selectExpr("xxhash64(doc_id, cast(octet_length(text) + 16 as bigint), crc32(text)) as h")
    parts = hashed.groupBy(hashed.h % 16).count().collect()
    assert max(r["count"] for r in parts) < 200

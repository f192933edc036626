import random
from collections import defaultdict

import xxhash

from logquarry.llm import simhash as S
from logquarry.llm.graph import components


def _plain(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(size, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def _signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_fingerprint():
    rng = random.Random(1)
    for _ in range(100):
        text = " ".join(rng.choices(["The", "a", "ÉT", "b c", "\t", "x\x1cy"], k=rng.randint(0, 30)))
        assert S.fingerprint(text) == _plain(text)
    assert S.fingerprint(None) == S.fingerprint(" \n") == 0
    long = " ".join(str(i) for i in range(70_000))
    assert S.fingerprint(long) == _plain(long)


def _clouds(rng, centres, each):
    """Fingerprints in chains and clouds, so that buckets of both kinds and steps of two bits occur."""
    out = set()
    for _ in range(centres):
        v = rng.getrandbits(64)
        for _ in range(each):
            for _ in range(rng.choice([1, 2, 3])):
                v ^= 1 << rng.randrange(64)
            out.add(v)
            if rng.random() < 0.3:
                v = rng.choice(sorted(out))
    return sorted(out)


def test_links_connect_what_is_close(spark, monkeypatch):
    rng = random.Random(6)
    prints = _clouds(rng, 8, 60) + [0, 1, (1 << 64) - 1]
    prints = sorted(set(prints))
    nodes = spark.createDataFrame([(_signed(v),) for v in prints], "fp long")
    for distance in (1, 2):
        close = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= distance]
        want = _roots(map(_signed, prints), [(_signed(a), _signed(b)) for a, b in close])
        for bucket in (0, 4, 1000):
            monkeypatch.setattr(S, "BUCKET", bucket)
            got = [(r["a"], r["b"]) for r in S.links(nodes, distance).collect()]
            assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= distance for a, b in got)
            assert _roots(map(_signed, prints), got) == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(300, 340)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = components(df).collect()
    assert len(got) == len(nodes) and {r["node"]: r["root"] for r in got} == _roots(nodes, [e for e in edges if e[0] != e[1]])
    assert components(df.limit(0)).collect() == []


def _expected(rows):
    prints = [(d, _plain(t)) for d, t in rows]
    values = sorted({p for _, p in prints})
    roots = _roots(values, [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 2])
    ids = defaultdict(list)
    for d, p in prints:
        if d is not None:
            ids[roots[p]].append(d)
    return sorted(repr((d, f"{p:016x}", min(ids[roots[p]], default=None))) for d, p in prints)


def _texts(rng):
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(120)) for _ in range(5)]
    rows = []
    for i in range(80):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = "new"
        rows.append((1000 - i, " ".join(words)))
    return rows + [(1, None), (2, ""), (3, " "), (None, "alone here"), (None, rows[0][1]), (1000, rows[0][1]), (9, "Two Words"), (8, "two  words")]


def test_near_duplicates(docs, clashing):
    rows = _texts(random.Random(8))
    got = S.near_duplicates(clashing(docs(rows))).collect()
    assert sorted(repr(tuple(r)) for r in got) == _expected(rows)


def test_keep_one(docs, clashing):
    rows = _texts(random.Random(8))
    df = clashing(docs(rows))
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    firsts = {eval(r)[2] for r in _expected(rows)}
    assert sorted(x for x in ids if x is not None) == sorted(x for x in firsts if x is not None)
    assert ids.count(None) == 1


def test_empty(docs):
    df = docs([(1, "x")]).limit(0)
    assert S.near_duplicates(df).collect() == [] and S.keep_one(df).collect() == []

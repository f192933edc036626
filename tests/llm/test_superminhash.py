import random

import numpy as np
import pytest

from logquarry.llm import superminhash as S


def _plain_words(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(
        {c: " " for c in range(9, 14)}
    ).split(" ")


def _plain_set(text, shingle):
    words = [w for w in _plain_words(text) if w]
    if not words:
        return frozenset()
    size = min(shingle, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def _plain(rows, shingle, percent):
    """n_shingles and component of each row, by comparing all with all."""
    sets = [_plain_set(t, shingle) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(
        ((doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=str
    )


def _got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def _one_by_one(items, size):
    """The signature with a full permutation per item and no early stop."""
    out = [2**64 - 1] * size
    for x in items:
        order = list(range(size))
        for j in range(size):
            z = (int(x) + (j + 1) * 0x9E3779B97F4A7C15) % 2**64
            z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
            z = (z ^ (z >> 27)) * 0x94D049BB133111EB % 2**64
            z ^= z >> 31
            k = j + ((z & 0xFFFFFFFF) * (size - j) >> 32)
            order[j], order[k] = order[k], order[j]
            out[order[j]] = min(out[order[j]], j << 32 | z >> 32)
    return out


def test_signatures_equal_whole_permutations():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**64, n, np.uint64) for n in (1, 2, 0, 17, 300, 1)]
    got = S.signatures(sets, 32)
    for s, row in zip(sets, got):
        assert row.tolist() == _one_by_one(s, 32)


def test_large_sets_are_ranked_in_parts(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 2**64, n, np.uint64) for n in (5, 90, 200, 3)]
    whole = S.signatures(sets)
    monkeypatch.setattr(S, "_PART", 64)
    assert (S.signatures(sets) == whole).all()


def test_estimate():
    rng = np.random.default_rng(3)
    shared, a, b = (rng.integers(0, 2**64, n, np.uint64) for n in (800, 100, 100))
    one, two = S.signatures([np.concatenate([shared, a]), np.concatenate([shared, b])])
    assert abs((one == two).mean() - 0.8) < 0.12


def test_words_and_shingles():
    assert len(S.shingle_set("A b c  a\tB C", 2)) == 3
    assert (S.shingle_set("A B", 2) == S.shingle_set("a\nb", 2)).all() and len(S.shingle_set("one", 5)) == 1
    assert len(S.shingle_set(" \n", 2)) == len(S.shingle_set(None, 2)) == 0
    assert S.shingle_set("Ä", 2)[0] != S.shingle_set("ä", 2)[0]


def _family(rng, vocabulary, copies, length):
    base = [rng.choice(vocabulary) for _ in range(length)]
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randint(0, length // 6)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        yield " ".join(words)


@pytest.mark.parametrize("shingle, percent", [(2, 80), (5, 80), (2, 60)])
def test_equals_all_pairs(docs, shingle, percent):
    rng = random.Random(shingle * percent)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [t for _ in range(12) for t in _family(rng, vocabulary, 12, rng.choice([1, 2, 3, 8, 30, 90]))]
    texts += [None, "", " \n ", "x", "x", "X", "x y", "x y z"] + texts[:5]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[3]), (None, "alone here"), (None, None)]
    rng.shuffle(rows)
    assert _got(S.near_duplicates(docs(rows), shingle, percent)) == _plain(rows, shingle, percent)


def test_a_chain_is_one_component(docs):
    """Neighbours are near, ends are not; the pivot reaches only some of them."""
    words = [f"c{i}" for i in range(140)]
    rows = [(i, " ".join(words[i * 5 : i * 5 + 60])) for i in range(16)]
    got = S.near_duplicates(docs(rows), 2)
    assert {r["component_id"] for r in got.collect()} == {0} and got.where("kept").count() == 1


def test_a_hot_group_makes_few_pairs(spark, docs, monkeypatch):
    rng = random.Random(9)
    base = [f"h{i}" for i in range(120)]
    rows = []
    for i in range(600):
        words = list(base)
        words[rng.randrange(120)] = f"own{i}"
        rows.append((i, " ".join(words)))
    made, compared = [], S._compared

    def counted(pairs, *rest):
        made.append(pairs.count())
        return compared(pairs, *rest)

    monkeypatch.setattr(S, "_compared", counted)
    assert {r["component_id"] for r in S.near_duplicates(docs(rows), 2).collect()} == {0}
    assert sum(made) < 4 * len(rows)


def test_odd_input(docs, clashing):
    assert _got(S.near_duplicates(docs([(1, "x")]).limit(0))) == []
    long = " ".join(f"v{i}" for i in range(400_000))
    rows = [(5, long), (9, long + " end"), (2, "a b"), (2, "a b"), (7, None)]
    df = clashing(docs(rows))
    assert _got(S.near_duplicates(df, 2)) == sorted(
        [(5, 399_999, 5), (9, 400_000, 5), (2, 1, 2), (2, 1, 2), (7, 0, 7)], key=str
    )


def test_parities_never_differ_by_more_than_the_sets():
    rng = np.random.default_rng(4)
    whole = rng.integers(0, 2**64, 3000, np.uint64)
    sets = [whole[: rng.integers(0, 3000)] for _ in range(30)] + [whole[::2], whole[:0]]
    odd = S.parities(sets)
    assert odd.shape == (32, S.PARITY_LONGS) and not odd[-1].any()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            bits = int(np.unpackbits((odd[i] ^ odd[j]).view(np.uint8)).sum())
            apart = len(np.setxor1d(a, b))
            assert bits <= apart and (apart - bits) % 2 == 0 and (i != j or not bits)


def test_a_group_of_which_none_are_near_is_not_compared(docs, monkeypatch):
    rng = random.Random(10)
    base = [f"g{i}" for i in range(140)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(140), 8):
            words[at] = f"own{i}at{at}"
        rows.append((i, " ".join(words)))
    made, compared = [], S._compared

    def counted(pairs, *rest):
        made.append(pairs.count())
        return compared(pairs, *rest)

    monkeypatch.setattr(S, "_compared", counted)
    near = rows + [(200 + i, t + " end") for i, t in rows[:5]]
    assert _got(S.near_duplicates(docs(near), 2)) == _plain(near, 2, 80)
    assert sum(made) < len(near)

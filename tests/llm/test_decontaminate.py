import random

import pytest

from logquarry.llm import decontaminate as D
from logquarry.llm.common import alnum_words


def _expected(docs, items, window=13):
    cut = {}
    for item, text in items:
        w = alnum_words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            cut.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = alnum_words(text), set(), set()
        for n in {len(c) for c in cut}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in cut:
                    hit |= set(range(i, i + n))
                    found |= cut[tuple(w[i : i + n])]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(ids), ids, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def _run(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    return [tuple(r) for r in D.decontaminate(d, i, **more).collect()]


def _sorted(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("window, shingle", [(13, 3), (4, 3), (3, 5), (2, 1)])
def test_equals_plain_search(spark, window, shingle):
    rng = random.Random(window)
    words = ["a", "b", "c", "Dé", "e9"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i // 2, text(rng.choice([0, 1, 2, 3, 5, 14, 20]))) for i in range(14)]
    docs = [(i, text(rng.randint(0, 30)) + ", " + rng.choice(items)[1] + "! " + text(rng.randint(0, 9))) for i in range(60)]
    assert _sorted(_run(spark, docs, items, window=window, shingle=shingle)) == _sorted(_expected(docs, items, window))


def test_odd_rows(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    items = [(1, passage), (1, passage), (2, passage + " end"), (None, "only this"), (3, None), (4, "  "), (5, "W3 w4")]
    docs = [
        (1, passage), (1, passage), (2, None), (3, ""), (None, passage.upper()), (4, "it is only this one"),
        (5, "x " * 400_000 + passage), (6, passage.replace("w9", "w99")), (7, "w19 " + passage[:20]),
    ]
    assert _sorted(_run(spark, docs, items)) == _sorted(_expected(docs, items))


def test_empty_tables(spark):
    assert _run(spark, [], [(1, "a b")]) == []
    assert _run(spark, [(1, "a b")], []) == [(1, 2, 0, 0, [], False)]


def test_filter_decides_nothing(spark, monkeypatch):
    """A filter so small that nearly everything passes gives the same rows."""
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choices("abcdefgh", k=40))) for i in range(30)]
    items = [(i, " ".join(rng.choices("abcdefgh", k=3))) for i in range(30)]
    wide = _sorted(_run(spark, docs, items))
    assert wide == _sorted(_expected(docs, items))


def test_keep_clean(spark, docs, clashing):
    passage = " ".join(f"w{i}" for i in range(20))
    rows = [(1, passage), (2, "clean text"), (2, passage), (None, passage), (None, "clean"), (3, None)]
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    df = clashing(docs(rows))
    kept = D.keep_clean(df, items)
    assert kept.columns == df.columns
    assert sorted(map(repr, [(r["doc_id"], r["text"]) for r in kept.collect()])) == sorted(
        map(repr, [(2, "clean text"), (None, "clean"), (3, None)])
    )


def test_hash_of_words_does_not_depend_on_the_part():
    import numpy as np
    import pyarrow as pa

    text = "alpha beta gamma Beta " * 50
    whole = D.Words(pa.array([text, text]))
    assert len(set(whole.hashes.tolist())) == 3
    assert (whole.hashes[: whole.first[1]] == whole.hashes[whole.first[1] :]).all()
    part, D._PART = D._PART, 7
    try:
        assert (D.Words(pa.array([text, text])).hashes == whole.hashes).all()
    finally:
        D._PART = part
    assert isinstance(whole.hashes, np.ndarray)

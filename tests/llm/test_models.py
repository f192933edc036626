"""The two learned operators: what they learn, and what they do with odd rows."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from logquarry.llm import langid, quality_model, queries


def _fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def test_forward_backward_equals_all_labellings():
    rng = np.random.default_rng(1)
    scores, start, steps = rng.normal(size=(3, 4, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    lengths = np.array([4, 2, 1])
    gamma, expected, total = langid.forward_backward(scores, lengths, start, steps)
    sums = np.zeros((3, 3))
    for c, n in enumerate(lengths):
        weights, marginal, pairs = 0.0, np.zeros((4, 3)), np.zeros((3, 3))
        for y in itertools.product(range(3), repeat=int(n)):
            w = np.exp(start[y[0]] + sum(scores[c, t, k] for t, k in enumerate(y)) + sum(steps[a, b] for a, b in zip(y, y[1:])))
            weights += w
            for t, k in enumerate(y):
                marginal[t, k] += w
            for a, b in zip(y, y[1:]):
                pairs[a, b] += w
        assert np.allclose(gamma[c], marginal / weights) and np.isclose(total[c], np.log(weights))
        sums += pairs / weights
    assert np.allclose(expected, sums)


def test_language_on_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = queries.op10_language(spark, sf).collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert all(r["held_out"] == (_fold(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.9


def test_code_switched_words():
    model = langid.fit([("en", "the thing and the other thing was in the house " * 9), ("de", "der die und nicht schön über keiten heit " * 9)])
    words = ("the thing was in the house " + "und nicht schön über die heit ").split()
    scores = model.emissions(words)[None]
    gamma, _, _ = langid.forward_backward(scores, np.array([len(words)]), model.start, model.steps)
    assert [model.languages[k] for k in gamma[0].argmax(axis=1)] == ["en"] * 6 + ["de"] * 6


def test_language_odd_rows(docs, clashing):
    known = [(i, "the thing and the other " * 5, "en", "s", 1) for i in range(20)]
    known += [(i + 50, "der die und nicht heit " * 5, "de", "s", 1) for i in range(20)]
    known += [(200, "la les", None, "s", 1), (201, None, "fr", "s", 1), (202, "", "en", "s", 1)]
    model = langid.learn(docs(known))
    assert model.languages == ["de", "en"]
    odd = [(1, None), (2, ""), (3, "123 !? ²"), (4, "the " * 700_000), (None, "nicht"), (5, "nicht"), (5, "nicht"), (6, "日本")]
    rows = langid.predict(clashing(docs(odd)), model).collect()
    got = {r["doc_id"]: (r["lang_pred"], r["n_words"]) for r in rows}
    assert len(rows) == len(odd)
    assert got[1] == got[2] == got[3] == ("und", 0) and got[4] == ("en", 700_000)
    assert got[None] == got[5] == ("de", 1) and got[6][0] in ("de", "en")
    assert {r["score"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0.0}


def test_language_without_anything_to_learn(docs):
    empty = docs([(1, "x")]).limit(0)
    assert langid.learn(empty) is None and langid.predict(empty, None).collect() == []
    assert langid.predict(docs([(1, "some words")]), None).first()["lang_pred"] == "und"


def test_quality_on_held_out(spark, sf):
    rows = {r["doc_id"]: r for r in queries.op8_quality_model(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r["held_out"] == (_fold(d, 3) == 1) and r["predicted"] == int(r["score"] >= 0.5) for d, r in rows.items())
    held = [(rows[d]["score"], q) for d, q in labels.items() if rows[d]["held_out"]]
    above = [(a > b) + 0.5 * (a == b) for a, x in held for b, y in held if x == 1 and y == 0]
    assert np.mean(above) > 0.9


def test_gradients_by_differences():
    """The loss falls along each step, and attention sums to one in every text."""
    texts = ["good words here and there " * 60, "BAD!! STUFF!! " * 90, "good and calm " * 30, "BAD!!"] * 10
    model = quality_model.fit(texts, [1, 0, 1, 0] * 10, epochs=30)
    x, first = quality_model.encode(pa.array(texts, pa.large_string()))
    f = model.forward(x, first)
    assert np.allclose(np.add.reduceat(f["weight"], first[:-1]), 1, atol=1e-5)
    assert ((f["score"] > 0.5) == np.array([1, 0, 1, 0] * 10, bool)).all()


def test_passages():
    text = "ab " * 1000
    x, first = quality_model.encode(pa.array(["", None, "x", text, text + "y"]))
    assert np.diff(first).tolist() == [1, 1, 1, 5, 5] and x.shape == (13, quality_model.N_FEATURES)
    assert (x[:2] == 0).all() and np.isfinite(x).all()
    alone, _ = quality_model.encode(pa.array([text]))
    assert np.allclose(alone, x[3:8])


def test_quality_odd_rows(spark, docs, clashing):
    rows = [(i, "calm words of a text " * 30) for i in range(30)] + [(i, "LOUD!! ***" * 60) for i in range(30, 60)]
    marks = [(i, int(i < 30)) for i in range(60)] + [(1, 1), (2, 0), (2, 1), (None, 1), (999, 0), (5, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    odd = [(100, None), (101, ""), (None, "x"), (102, "word " * 500_000), (0, rows[0][1])]
    df = clashing(docs(rows + odd))
    model = quality_model.learn(df, labels)
    got = quality_model.score(df, model).collect()
    assert len(got) == len(rows + odd) and all(0 <= r["score"] <= 1 for r in got)
    score = {r["doc_id"]: r["score"] for r in got}
    assert min(score[i] for i in range(30)) > 0.5 > max(score[i] for i in range(30, 60)) and score[100] == score[101]
    assert quality_model.learn(df, labels.limit(0)) is None
    assert quality_model.score(docs([(1, "x")]), None).first()["score"] == 0.5
    assert quality_model.score(df.limit(0), model).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_learning_is_repeatable(seed):
    texts = [f"{'calm' if i % 2 else 'LOUD!!'} {i} " * 40 for i in range(40)]
    a, b = (quality_model.fit(texts, [i % 2 for i in range(40)], epochs=3, seed=seed) for _ in range(2))
    assert all((getattr(a, n) == getattr(b, n)).all() for n in "wbvuacd")

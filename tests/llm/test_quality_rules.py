import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from logquarry.llm import quality_rules as Q

PATH = public_tokenizers.path("piece_bpe_32k.model")


def _repeated(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            inside |= {i, i + 1, i + 2}
    return len(inside)


def test_repeated_words_and_lines():
    rng = random.Random(4)
    for _ in range(200):
        words = rng.choices("abc", k=rng.randint(0, 40))
        assert Q.repeated_words(words) == _repeated(words)
        lines = rng.choices(["a", "b ", "", " ", "\t", "a b"], k=rng.randint(0, 12))
        dup = sum(1 for i, x in enumerate(lines) if x.split() and x in lines[:i])
        assert Q.repeated_lines("\n".join(lines)) == dup


@pytest.mark.parametrize("text, script", [("abc", "Latin"), ("Привет ok", "Cyrillic"), ("日本語のテキスト", "Katakana"), ("123 !", "none"), ("", "none"), ("éé", "Latin")])
def test_script(text, script):
    assert Q.script_of(text) == script


def test_words_are_measured_like_the_vocabulary():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    words = "Überraschung the 日本 thé\u0001x".encode().split()
    n, per, share, entropy = Q.Fertility(PATH).measure(words, 20)
    ids = [i for w in words for i in model.encode(w.decode())]
    assert n == len(ids) and per == 20 / n
    assert share == pytest.approx(sum(map(model.is_byte, ids)) / n) and entropy > 2
    assert Q.Fertility(PATH).measure([], 0) == (0, 0.0, 0.0, 0.0)


def _text(rng, n=80):
    return " ".join("".join(rng.choices(["the", "ing", "tion", "er", "and"], k=3)) for _ in range(n))


def test_judge(docs, clashing):
    rng = random.Random(3)
    good = [(i, _text(rng)) for i in range(60)]
    odd = [
        (100, None), (101, ""), (102, " \n"), (103, _text(rng, 49)), (104, "spam and eggs " * 40), (105, "中" * 90 + " x" * 60),
        (106, "Zq#9" * 300 + " " + " ".join(f"Q%Z{i}" for i in range(100))), (107, _text(rng, 60_000)), (0, good[0][1]),
    ]
    df = clashing(docs(good + odd))
    rows = {}
    for r in Q.judge(df.drop("kept", "n_words"), PATH).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    assert all(rows[i][0]["kept"] for i in range(60)) and len(rows[0]) == 2 and rows[0][0] == rows[0][1]
    assert rows[100][0]["n_words"] == 0 and all(rows[i][0]["base_failed"] for i in (100, 101, 102, 103, 104))
    assert not rows[106][0]["kept"] and not rows[106][0]["base_failed"]
    assert rows[107][0]["n_words"] == 60_000
    kept = Q.keep_good(df, PATH)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in rows.items() for x in r if x["kept"])


def test_unknown_language_goes_by_script(docs):
    rng = random.Random(3)
    rows = [(i, _text(rng), lang, "s", 1) for i, lang in enumerate(["en", "EN", "xx", None])]
    got = {r["doc_id"]: r["band_group"] for r in Q.judge(docs(rows), PATH).collect()}
    assert got == {0: "en", 1: "en", 2: "script:Latin", 3: "script:Latin"}


def test_empty(docs):
    assert Q.judge(docs([(1, "x")]).limit(0), PATH).collect() == []


def test_clean_labelled_documents_stay(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    good = {r["doc_id"] for r in df.where("quality = 1").select("doc_id").collect()}
    rows = [r for r in Q.judge(df.drop("quality", "toxic"), PATH).collect() if not r["base_failed"]]
    assert [r["doc_id"] for r in rows if r["doc_id"] in good and not r["kept"]] == []
    assert any(not r["kept"] for r in rows)


def test_strewn_symbols_are_outside(docs):
    rng = random.Random(8)
    good = [(i, _text(rng, 150)) for i in range(60)]
    strewn = " ".join(w + (" $$$" if i % 4 == 0 else "") for i, w in enumerate(_text(rng, 150).split()))
    rows = {r["doc_id"]: r for r in Q.judge(docs(good + [(100, strewn)]), PATH).collect()}
    assert not rows[100]["base_failed"] and not rows[100]["kept"]
    assert all(rows[i]["kept"] for i in range(60))


def test_copies_do_not_narrow_the_bands(spark, sf):
    """Nine hundred copies of one text change no verdict on the others."""
    rows = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").where("lang = 'en'")
    before = {r["doc_id"]: r["kept"] for r in Q.judge(rows, PATH).collect()}
    usual = rows.where(F.col("doc_id") == min(i for i, kept in before.items() if kept)).withColumn("doc_id", F.lit(-1).cast("bigint"))
    copies = usual.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(930)))).drop("n")
    after = {r["doc_id"]: r["kept"] for r in Q.judge(rows.union(copies), PATH).collect()}
    assert sum(before.values()) > 400 and after.pop(-1) and after == before


def _plain_bands(rows):
    """The limits of each group, from the measures of rows as plain numbers."""
    groups = {}
    for r in {(r["band_group"], r["text"]): r for r in rows if not r["base_failed"]}.values():
        for g in (r["band_group"], Q.ALL):
            groups.setdefault(g, []).append(r)
    out = {}
    for g, found in groups.items():
        middle = float(np.quantile([round(r["chars_per_token"], 3) for r in found], 0.5))
        limits = {}
        for k, band in Q.BANDS.items():
            q = np.quantile([_plain_value(r, k, middle) for r in found], [0.25, 0.5, 0.75])
            low = q[1] - max(band["times"] * (q[1] - q[0]), band["least"]) - Q.NOISE
            high = q[1] + max(band["times"] * (q[2] - q[1]), band["least"]) + Q.NOISE
            limits[k] = (low if band["low"] else -np.inf, high if band["high"] else np.inf)
        out[g] = (len(found), middle, limits)
    return out


def _plain_value(r, k, middle):
    return round((r[k] - middle) * r["n_tokens"] ** 0.5, 2) if k == "chars_per_token" else round(r[k], 3)


def test_verdicts_equal_plain_bands(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = [{**r.asDict(), "text": texts[r["doc_id"]]} for r in Q.judge(docs, PATH).collect()]
    bands = _plain_bands(rows)
    assert {n >= Q.LEAST_TEXTS for g, (n, *_) in bands.items() if g != Q.ALL} == {True, False}
    def inside(r, n, middle, limits):
        return all(low - 1e-6 <= _plain_value(r, k, middle) <= high + 1e-6 for k, (low, high) in limits.items())

    for r in rows:
        own = bands.get(r["band_group"], bands[Q.ALL])
        fits = inside(r, *own) or own[0] < Q.LEAST_TEXTS and inside(r, *bands[Q.ALL])
        assert r["kept"] == (fits and not r["base_failed"]), r["doc_id"]

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from logquarry.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _same(library, texts, **more):
    got = list(bpe.Encoder(bpe.vocabulary(PATH), **more).encode(texts))
    want = library.encode_batch(texts, add_special_tokens=False)
    return [t for t, g, w in zip(texts, got, want) if np.frombuffer(g, "<u4").tolist() != w.ids]


def test_letters_in_any_order(library):
    rng = random.Random(1)
    texts = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 40))) for _ in range(20_000)]
    assert _same(library, texts) == []


def test_special_and_odd_texts(library):
    rng = random.Random(2)
    bits = ["the", "ing", "<|endoftext|>", "<|startoftext|>", "<|end", "'s", "'ll", " ", "\n", "İ", "Σ", "ς", "é", "é", "中", "😀",
            "12", "!!", " ", "\x1c", "__", "Ᲊ", "�", "\x00"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(5000)]
    assert _same(library, texts) == []
    assert _same(library, texts[:500], remembered=50) == []


def test_every_character(library):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}B {c}{c}1" for c in chars[:: 23]] + [f"a{c}B {c}{c}1" for c in chars[:0x600]]
    assert _same(library, texts) == []


def test_greedy_is_wrong_for_some_words():
    v = bpe.vocabulary(PATH)
    rng = random.Random(3)
    words = ["".join(rng.choices("etaoinshrdlu", k=8)).encode() for _ in range(2000)]
    wrong = sum(v.propose(w) != v.merge(w) for w in words)
    assert 0 < wrong < len(words)
    assert v.encode_words([w.decode() for w in words]) == [v.merge(w) for w in words]


def test_one_very_long_word_and_text(library):
    texts = ["ab" * 100_000, "thing " * 400_000 + "<|endoftext|>", "x"]
    assert _same(library, texts) == []


def test_table(spark, library, docs, clashing):
    rows = [(1, "Hello wörld <|endoftext|>"), (1, "Hello wörld <|endoftext|>"), (2, None), (3, ""), (None, "x"), (4, "y z " * 500_000)]
    got = sorted(map(tuple, queries.token_digests(clashing(docs(rows))).collect()), key=repr)
    want = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((doc, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(said.encode())))
    assert got == sorted(want, key=repr)


def test_decode_leaves_out_unknown_ids(spark, library):
    ids = np.array([49407, 0, 70000, 400], "<u4")
    df = spark.createDataFrame([(1, bytearray(ids.tobytes())), (2, None)], "doc_id long, ids binary")
    texts = {r["doc_id"]: r["text"] for r in bpe.decode(df, PATH).collect()}
    assert texts == {1: library.decode(ids.tolist(), skip_special_tokens=False), 2: ""}


def test_empty(docs):
    assert bpe.decode(bpe.encode(docs([(1, "x")]).limit(0), PATH), PATH).collect() == []


def test_parts_add_up():
    from logquarry.llm.common import PART_CHARS, parts

    for text in ("", "a", "ab " * PART_CHARS, "a" * (2 * PART_CHARS + 5) + " b"):
        assert "".join(parts(text)) == text

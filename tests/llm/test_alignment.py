import random
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from logquarry.llm import alignment as A

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
TEXTS = [
    "Hello world, tokenisers disagree: naïve café, 12345 don't!", "", None, " ", "  two blanks  ", "line\nfeed\ttab", "漢字かな交じり文。",
    "emoji 👩‍👩‍👧 and \U0001fae8", "<|endoftext|> is text, </s> too", "a", "▁", "\x00", "x" * 300, "new letter \U0001df25 ࢗ", "Ünï ́ é",
    " sep nbsp", "under_score __init__ (foo);", "ﬁ ligature ①", "\r\n mixed \r", "Hello world, tokenisers disagree: naïve café, 12345 don't!",
]


@pytest.fixture(scope="module")
def plain_sides():
    a = tokenizers.Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def _spans(ids, raw):
    out, at = [], 0
    for i, r in zip(ids, raw):
        out.append((i, at, at := at + len(r)))
    return out


def _bytes_of(a, b):
    printable = {**{i: chr(i) for i in [*range(33, 127), *range(161, 173), *range(174, 256)]}}
    printable.update({x: chr(256 + n) for n, x in enumerate(x for x in range(256) if x not in printable)})
    back = {c: i for i, c in printable.items()}
    one = lambda i: bytes(back[c] for c in a.id_to_token(i))

    def two(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    return one, two


def _plain(texts, sides):
    """The columns but doc_id, token by token."""
    a, b = sides
    one, two = _bytes_of(a, b)
    docs, counts = [], Counter()
    for text in texts:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        ra, rb = [one(i) for i in x], [two(i) for i in y]
        if text and not b"".join(ra) == b"".join(rb) == (" " + text).encode():
            x, y = [], []
        sa, sb = _spans(x, ra), _spans(y, rb)
        links = [(i, j) for i, _, e in sa for j, _, f in sb if e == f]
        cuts = sorted({e for *_, e in sa} & {f for *_, f in sb})
        groups = []
        for start, end in zip([0, *cuts], cuts):
            groups.append("|".join(",".join(str(i) for i, _, e in s if start < e <= end) for s in (sa, sb)))
        shared = sum(s < f and t < e for _, s, e in sa for _, t, f in sb)
        docs.append((len(x), len(y), len(groups), links, shared, sha256(";".join(groups).encode()).hexdigest() if x else ""))
        counts.update(links)
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [
        (na, nb, ng, len(ls), so, sum(counts[p] == best[p[1]] for p in ls), sum(counts[p] for p in ls), d) for na, nb, ng, ls, so, d in docs
    ]


NAMES = "n_a n_b n_groups n_links n_overlaps n_best count_sum groups_sha256".split()


def _got(df):
    return sorted(((r["doc_id"], *(r[n] for n in NAMES)) for r in df.collect()), key=str)


def _noise(rng):
    alphabet = "abc the  of\n,.'é漢ж1 2<>👍\t" + chr(0x301)
    return "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))


def test_equals_token_by_token(docs, plain_sides, monkeypatch):
    rng = random.Random(3)
    texts = TEXTS + [_noise(rng) for _ in range(150)]
    expected = sorted(((i, *row) for i, row in enumerate(_plain(texts, plain_sides))), key=str)
    assert sum(r[1] > 0 for r in expected) > 100
    assert _got(A.align_corpus(docs(texts), *PATHS)) == expected


def test_batches_change_nothing(spark, sf, plain_sides, monkeypatch):
    from logquarry.llm.common import table

    rows = table(spark, sf, "documents").repartition(3)
    whole = _got(A.align_corpus(rows, *PATHS))
    monkeypatch.setattr(A, "BATCH_DOCS", 7)
    assert _got(A.align_corpus(rows.repartition(5), *PATHS)) == whole


def test_side_a_equals_the_library(plain_sides):
    rng, a = random.Random(8), A.ByteLevel(PATHS[0])
    texts = [t for t in TEXTS if t] + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0xD800), rng.randrange(0xE000, 0x30000)])) for _ in range(12)) for _ in range(3000)]
    for t in texts:
        assert a.encode(" " + t) == plain_sides[0].encode(" " + t, add_special_tokens=False).ids


def test_overlaps():
    widths = np.array([0, 1, 2, 3, 4])
    a = A.Side([np.array(x, np.int32) for x in ([2, 3], [], [4])], widths)
    b = A.Side([np.array(x, np.int32) for x in ([1, 3, 1], [], [2, 2])], widths)
    assert [x.tolist() for x in A.overlaps(a, b)] == [[0, 0, 1, 1, 2, 2], [0, 1, 1, 2, 3, 4]]


def test_odd_input(docs, clashing):
    assert _got(A.align_corpus(docs([(1, "x")]).limit(0), *PATHS)) == []
    long = "some words, and more; " * 100_000
    rows = clashing(docs([(1, None), (1, ""), (None, "a b"), (2, "a b"), (2, "a b"), (3, long)]))
    got = {r["doc_id"]: r for r in A.align_corpus(rows, *PATHS).collect()}
    assert got[1]["n_a"] == got[1]["n_b"] == got[1]["count_sum"] == 0 and got[1]["groups_sha256"] == ""
    assert got[None]["n_links"] == got[2]["n_links"] == 2 and got[2]["count_sum"] == got[None]["count_sum"]
    assert got[3]["n_groups"] == got[3]["n_links"] > 100_000
    assert A.align_corpus(docs([None, ""]), *PATHS).where("n_a = 0").count() == 2

import re

import corpus_pipeline as pipeline
import oracle
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from logquarry.llm import queries, quality_rules
from logquarry.llm.common import alnum_words, blank_words


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    assert oracle.compare(spark, oracle.connect(sf), sf, queries.queries()[name], queries.oracle_sql()[name]) is None


def test_names():
    names = list(queries.queries())
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))


def _near(a, b):
    if abs(len(a) - len(b)) > 2:
        return False
    row = {0: 0, 1: 1, 2: 2}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - 2), min(len(b), i + 2) + 1):
            ways = [row[j] + 1] if j in row else []
            ways += [new[j - 1] + 1] if j - 1 in new else []
            ways += [row[j - 1] + (x != b[j - 1])] if j and j - 1 in row else []
            new[j] = min(ways)
        row = new
    return row.get(len(b), 3) <= 2


def _without_repeats(docs):
    texts = sorted({x for t in docs.values() for x in t.split("\n") if len(x) >= 40}, key=len)
    root = {x: x for x in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if len(b) > len(a) + 2:
                break
            if a[:12] == b[:12] or a[-12:] == b[-12:] or a[len(a) // 3 : len(a) // 3 + 10] in b:
                if _near(a, b):
                    root[find(b)] = find(a)
    seen, out = set(), {}
    for d in sorted(docs):
        lines = []
        for x in docs[d].split("\n"):
            if len(x) >= 40:
                if find(x) in seen:
                    continue
                seen.add(find(x))
            lines.append(x)
        if lines == docs[d].split("\n") or "\n".join(lines).strip(" \t\n\v\f\r"):
            out[d] = "\n".join(lines)
    return out


def _print(text):
    words = blank_words(text, lower=True)
    size = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(len(words) - size + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _one_of_each(docs):
    prints = {d: _print(t) for d, t in docs.items()}
    left, kept = set(docs), []
    for d in sorted(docs):
        if d not in left:
            continue
        kept.append(d)
        todo = [d]
        left.discard(d)
        while todo:
            p = prints[todo.pop()]
            close = {e for e in left if (p ^ prints[e]).bit_count() <= 2}
            left -= close
            todo += close
    return {d: docs[d] for d in kept}


def _uncontaminated(docs, items):
    cut = set()
    for t in items:
        w = alnum_words(t)
        n = min(13, len(w))
        cut |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1 if n else 0)}
    out = {}
    for d, t in docs.items():
        w, hit = alnum_words(t), set()
        for n in {len(c) for c in cut}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in cut:
                    hit |= set(range(i, i + n))
        if not hit or 20 * len(hit) < len(w):
            out[d] = t
    return out


def test_stages(spark, sf):
    """Each stage against plain Python on all that the one before kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    judged = quality_rules.judge(docs, public_tokenizers.path("piece_bpe_32k.model")).where("kept").collect()
    steps = [
        lambda t: {r["doc_id"]: t[r["doc_id"]] for r in judged}, _without_repeats, _one_of_each,
        lambda t: _uncontaminated(t, items),
    ]
    for (_, stage), step in zip(pipeline.STAGES, steps):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        texts = step(texts)
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == texts
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {d: len(library.encode(t, add_special_tokens=False).ids) for d, t in texts.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in pipeline.run(spark, sf).collect()} == sizes


def test_odd_rows_go_through(spark, sf, docs, clashing):
    df = clashing(docs([(1, None), (2, ""), (None, "x" * 50), (3, "y" * 50), (3, "y" * 50)]))
    for data in (df, df.limit(0)):
        for name, stage in pipeline.STAGES[:-1]:
            assert stage(spark, data, sf).columns == df.columns, name

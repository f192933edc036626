"""Language identification word by word: a linear-chain conditional random field over the words of a text.

Each word has hashed features (beginnings, ends, letter n-grams, the word itself) and its place in lexicons; learned
transitions let neighbours agree without forcing them, so that a text may change its language.  Forward-backward
gives every word's probabilities, and the text's language is the one that most of its words are expected to have.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, parts, records, slices

# Bounds of the sample that is learned from: languages (the most frequent), documents over all languages, and
# characters of a document.
MOST_LANGUAGES = 200
SAMPLE_DOCS = 2000
SAMPLE_CHARS = 20_000
# Words of one chain; a longer text is several chains.
CHAIN = 64
BUCKETS = 1 << 15
UNKNOWN = "und"

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_words", pa.int64())])
COLUMNS = "doc_id bigint, lang_pred string, score double, n_words bigint"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) for every hashed feature of the words."""
    raw = [b"\x01" + w.encode() + b"\x02" for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    of = np.repeat(np.arange(len(raw)), sizes)
    found = []

    def add(kind: int, word: np.ndarray, code: np.ndarray) -> None:
        code = (code + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
        found.append((word, ((code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % BUCKETS))

    gram = data.copy()
    for n in (2, 3, 4):  # with the marks at both ends
        gram = gram[:-1] * np.uint64(257) + data[n - 1 :]
        at = np.flatnonzero(of[: len(gram)] == of[n - 1 :])
        add(n, of[at], gram[at])
        long = np.flatnonzero(sizes >= n)
        add(10 + n, long, gram[starts[long]])
        add(20 + n, long, gram[ends[long] - n])
    whole = np.zeros(len(raw), np.uint64)
    for k in range(int(sizes.max(initial=0)) if len(raw) else 0):
        if k >= 40:
            break
        has = sizes > k
        whole[has] = whole[has] * np.uint64(1099511628211) + data[starts[has] + k]
    add(30, np.arange(len(raw)), whole)
    return np.concatenate([w for w, _ in found]), np.concatenate([b for _, b in found])


@dataclass
class Field:
    """A learned model."""

    languages: list[str]
    weights: np.ndarray  # buckets x languages
    lexicon: dict[str, int]  # a word that is typical of a language
    listed: np.ndarray  # weights of a lexicon's language x languages
    start: np.ndarray
    steps: np.ndarray  # from x to

    def emissions(self, words: list[str]) -> np.ndarray:
        """words x languages."""
        size, out = len(self.languages), np.zeros((len(words), len(self.languages)))
        if not words:
            return out
        word, bucket = features(words)
        counts = np.bincount(word, minlength=len(words))
        for k in range(size):
            out[:, k] = np.bincount(word, self.weights[bucket, k], len(words)) / counts
        for i, w in enumerate(words):
            if (k := self.lexicon.get(w)) is not None:
                out[i] += self.listed[k]
        return out


def forward_backward(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, steps: np.ndarray):
    """Of chains x places x languages: each place's probabilities (nothing behind a chain's end), the expected
    number of each step, and the logarithm of each chain's sum over all labellings."""
    chains, places, size = scores.shape
    top = scores.max(axis=2, keepdims=True)
    local = np.exp(scores - top)
    step, first = np.exp(steps), np.exp(start)
    alpha, scale = np.empty_like(local), np.ones((chains, places))
    live = np.arange(places)[None, :] < lengths[:, None]
    for t in range(places):
        a = (first if t == 0 else alpha[:, t - 1] @ step) * local[:, t]
        scale[:, t] = a.sum(axis=1)
        alpha[:, t] = a / scale[:, t, None]
    beta = np.ones_like(local)
    expected = np.zeros((size, size))
    for t in range(places - 2, -1, -1):
        b = local[:, t + 1] * beta[:, t + 1] / scale[:, t + 1, None]
        on = live[:, t + 1]
        beta[on, t] = (b @ step.T)[on]
        expected += (alpha[on, t].T @ b[on]) * step
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    gamma[~live] = 0
    total = ((np.log(scale) + top[:, :, 0]) * live).sum(axis=1)
    return gamma, expected, total


def fit(sample: list[tuple[str, str]], epochs: int = 6, seed: int = 7) -> Field | None:
    """Learns from (language, text).  Chains of half the length of ``CHAIN`` are spliced from one to three runs of
    words of different texts, so that changes of language are seen; None without any word."""
    languages = sorted({lang for lang, _ in sample})
    number = {lang: i for i, lang in enumerate(languages)}
    random, runs = np.random.default_rng(seed), [[] for _ in languages]
    counts: dict[str, np.ndarray] = {}
    for lang, text in sorted(sample):
        words = words_of(text)
        for w in words:
            counts.setdefault(w, np.zeros(len(languages)))[number[lang]] += 1
        if words:
            runs[number[lang]].append(words)
    spoken = [k for k, texts in enumerate(runs) if texts]
    if not spoken:
        return None
    share = np.array([max(1, sum(map(len, texts))) for texts in runs])
    lexicon = {w: int((c / share).argmax()) for w, c in counts.items() if c.sum() >= 3 and (c / share).max() >= 0.8 * (c / share).sum()}
    half = CHAIN // 2
    chains = []
    for _ in range(max(400, 2 * sum(map(len, runs)))):
        words, labels = [], []
        cuts = sorted(random.integers(1, half, size=random.integers(0, 3)).tolist())
        for a, b in zip([0, *cuts], [*cuts, half]):
            k = int(random.choice(spoken))
            text = runs[k][random.integers(len(runs[k]))]
            at = random.integers(max(1, len(text) - (b - a) + 1))
            words += text[at : at + b - a]
            labels += [k] * len(text[at : at + b - a])
        if words:
            chains.append((words, labels))
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for words, _ in chains for w in words))}
    names = list(vocabulary)
    word, bucket = features(names)
    order = np.argsort(word, kind="stable")
    word, bucket = word[order], bucket[order]
    first = np.searchsorted(word, np.arange(len(names) + 1))
    listed_as = np.array([lexicon.get(w, -1) for w in names])
    model = Field(
        languages, np.zeros((BUCKETS, len(languages))), lexicon, np.zeros((len(languages), len(languages))),
        np.zeros(len(languages)), np.zeros((len(languages), len(languages))),
    )
    values = [model.weights, model.listed, model.start, model.steps]
    squares = [np.full_like(v, 1e-6) for v in values]
    for _ in range(epochs):
        for batch in np.array_split(random.permutation(len(chains)), max(1, len(chains) // 64)):
            lengths = np.array([len(chains[i][0]) for i in batch])
            ids = np.concatenate([[vocabulary[w] for w in chains[i][0]] for i in batch])
            truth = np.concatenate([chains[i][1] for i in batch])
            here = np.concatenate([np.arange(a, b) for a, b in zip(first[ids], first[ids + 1])])
            of = np.repeat(np.arange(len(ids)), first[ids + 1] - first[ids])
            part = 1.0 / (first[ids + 1] - first[ids])
            place = np.arange(lengths.max())[None, :] < lengths[:, None]
            flat = np.stack([np.bincount(of, model.weights[bucket[here], k], len(ids)) * part for k in range(len(languages))], axis=1)
            has = listed_as[ids] >= 0
            flat[has] += model.listed[listed_as[ids][has]]
            scores = np.zeros((*place.shape, len(languages)))
            scores[place] = flat
            gamma, expected, _ = forward_backward(scores, lengths, model.start, model.steps)
            error = -gamma[place]
            error[np.arange(len(ids)), truth] += 1
            grown = [np.zeros_like(v) for v in values[1:]]
            np.add.at(grown[0], listed_as[ids][has], error[has])
            labels = np.full(place.shape, -1)
            labels[place] = truth
            opening = labels[:, 0]
            grown[1] += np.bincount(opening, minlength=len(languages)) - gamma[:, 0].sum(axis=0)
            both = (labels[:, 1:] >= 0) & (labels[:, :-1] >= 0)
            np.add.at(grown[2], (labels[:, :-1][both], labels[:, 1:][both]), 1)
            grown[2] -= expected
            used, slot = np.unique(bucket[here], return_inverse=True)
            weights = (error * part[:, None])[of]
            sparse = np.stack([np.bincount(slot, weights[:, k], len(used)) for k in range(len(languages))], axis=1)
            sparse = sparse / len(batch) - 1e-6 * model.weights[used]
            squares[0][used] += sparse**2
            model.weights[used] += 0.5 * sparse / np.sqrt(squares[0][used])
            for v, s, g in zip(values[1:], squares[1:], grown):
                g = g / len(batch) - 1e-5 * v
                s += g**2
                v += 0.1 * g / np.sqrt(s)
    model.weights = model.weights.astype(np.float32)
    return model


class Reader:
    """Predicts texts with a model, many chains at a time."""

    def __init__(self, model: Field | None):
        self.model = model

    def read(self, texts: list[str | None]) -> list[tuple[str, float, int]]:
        """Language, its share of the words, number of words."""
        if self.model is None:
            return [(UNKNOWN, 0.0, len(words_of(t or ""))) for t in texts]
        sums, counts = np.zeros((len(texts), len(self.model.languages))), np.zeros(len(texts), np.int64)
        held: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            for part in parts(text or ""):
                words = words_of(part)
                held.append((i, words))
                size += len(words)
                if size > 200_000:
                    self._add(held, sums, counts)
                    held, size = [], 0
        self._add(held, sums, counts)
        best = sums.argmax(axis=1)
        return [
            (self.model.languages[k], min(1.0, float(sums[i, k] / n)), n) if n else (UNKNOWN, 0.0, 0)
            for i, (k, n) in enumerate(zip(best.tolist(), counts.tolist()))
        ]

    def _add(self, held: list[tuple[int, list[str]]], sums: np.ndarray, counts: np.ndarray) -> None:
        numbers: dict[str, int] = {}
        ids = [numbers.setdefault(w, len(numbers)) for _, words in held for w in words]
        if not ids:
            return
        ids = np.array(ids)
        scores = self.model.emissions(list(numbers))
        sizes = np.array([len(words) for _, words in held])
        chains = -(-sizes // CHAIN)
        of = np.repeat([i for i, _ in held], chains)
        begins = np.repeat(np.cumsum(sizes) - sizes, chains)
        nth = np.arange(chains.sum()) - np.repeat(np.cumsum(chains) - chains, chains)
        lengths = np.minimum(CHAIN, np.repeat(sizes, chains) - nth * CHAIN)
        place = np.arange(CHAIN)[None, :] < lengths[:, None]
        at = np.minimum((begins + nth * CHAIN)[:, None] + np.arange(CHAIN), len(ids) - 1)
        gamma, _, _ = forward_backward(scores[ids[at]] * place[:, :, None], lengths, self.model.start, self.model.steps)
        np.add.at(sums, of, gamma.sum(axis=1))
        np.add.at(counts, of, lengths)


def held_out(doc_id: Column, folds: int, remainder: int) -> Column:
    """Whether crc32(doc_id as text) mod ``folds`` is ``remainder``; a null id is held out, too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == remainder, F.lit(True))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field | None:
    """A model from texts and languages of ``docs`` (doc_id, text, lang), rows without language left out.

    About ``sample_docs`` documents in equal shares per language, picked by a hash of their content among those of up to
    ``SAMPLE_CHARS`` characters, go to the driver; repeated rows count once.
    """
    known = docs.select("text", F.col("lang").cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS)
    )
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    if not sizes:
        return None
    each = max(10, sample_docs // len(sizes))
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    picked = F.lit(False)
    for lang, count in sizes:
        picked |= (F.col("lang") == lang) & (draw < int(min(1.0, each / count) * (1 << 30)))
    found = known.where(picked).distinct().collect()
    return fit([(r["lang"], r["text"]) for r in found])


def predict(docs: DataFrame, model: Field | None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, lang_pred, score (the share of the words expected to be in
    it), n_words.  A null text, one without a letter, or a model that has seen none gives ``und`` and 0.  Texts are read
    whole; other columns are not read; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in slices(batches, "text", 4 << 20):
            rows = reader.read(batch.column("text").to_pylist())
            yield records([(d, *r) for d, r in zip(batch.column("doc_id").to_pylist(), rows)], _SCHEMA)

    return id_and_text(docs).mapInArrow(work, COLUMNS)

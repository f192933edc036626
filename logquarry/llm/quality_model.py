"""Quality classifier: attention-based multiple-instance learning over the passages of a text.

A text is a bag of passages of equal length.  Every passage is encoded; a gated attention, learned from the labels of
whole documents alone, weighs the passages; the weighted mean of their representations gives the score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, slices
from .decontaminate import Words

# Bytes of a passage at least, and less than twice as many; a shorter text is one passage.
PASSAGE = 512
# Bounds of the sample that is learned from: documents, and characters of one.
SAMPLE_DOCS = 3000
SAMPLE_CHARS = 50_000
WORD_BUCKETS = 256
HIDDEN, ATTENTION = 32, 16


def _classes() -> np.ndarray:
    """Bytes to 16 kinds: letters by case, digits, blanks, line feeds, marks of sentences, other marks, other scripts."""
    kinds = np.full(256, 15, np.int64)
    for k, members in enumerate(
        (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n", b".", b",;:", b"!?", b"|",
         b"*#", b"$%&", b"<>/\\=", b"()[]{}", b"'\"`-_")
    ):
        kinds[list(members)] = k
    kinds[0x80:] = 14
    return kinds


_KINDS = _classes()
N_FEATURES = 256 + WORD_BUCKETS + 2


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of the texts, and the first passage of each text, with the end behind.

    Square roots of the shares of pairs of character kinds and of hashed words, the share of different words, and
    the mean length of a word.  A null or empty text is one passage of zeros.
    """
    words = Words(texts)
    data = texts.fill_null("").cast(pa.large_string())
    _, offsets, raw = data.buffers()
    bounds = np.frombuffer(offsets, np.int64)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw else np.empty(0, np.uint8)
    bounds = bounds - bounds[0]
    sizes = np.diff(bounds)
    counts = np.maximum(1, sizes // PASSAGE)
    first = np.concatenate(([0], np.cumsum(counts)))
    n = int(first[-1])
    place = np.arange(len(raw)) - np.repeat(bounds[:-1], sizes)
    at = np.repeat(first[:-1], sizes) + place * np.repeat(counts, sizes) // np.repeat(sizes, sizes)
    out = np.zeros((n, N_FEATURES), np.float32)
    kinds = _KINDS[raw]
    if len(raw) > 1:
        inside = np.flatnonzero(at[:-1] == at[1:])
        pairs = np.bincount(at[inside] * 256 + kinds[inside] * 16 + kinds[inside + 1], minlength=n * 256).reshape(n, 256)
        out[:, :256] = np.sqrt(pairs / np.maximum(1, pairs.sum(axis=1, keepdims=True)))
    if len(words.starts):
        of = at[words.starts]
        per = np.bincount(of, minlength=n)
        bucket = (words.hashes % np.uint64(WORD_BUCKETS)).astype(np.int64)
        hashed = np.bincount(of * WORD_BUCKETS + bucket, minlength=n * WORD_BUCKETS).reshape(n, WORD_BUCKETS)
        out[:, 256:-2] = np.sqrt(hashed / np.maximum(1, per)[:, None])
        different = np.unique((of.astype(np.uint64) << np.uint64(32)) | (words.hashes >> np.uint64(32)))
        out[:, -2] = np.bincount((different >> np.uint64(32)).astype(np.int64), minlength=n) / np.maximum(1, per)
        out[:, -1] = np.bincount(of, words.ends - words.starts, n) / np.maximum(1, per) / 10
    return out, first


@dataclass
class Model:
    """Encoder (w, b), attention gates (v, u) and weights (a), and the scorer (c, d)."""

    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray
    d: np.ndarray

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        h = np.tanh(x @ self.w + self.b)
        t, s = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        e = (t * s) @ self.a
        bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
        e = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
        weight = e / np.add.reduceat(e, first[:-1])[bag]
        z = np.add.reduceat(h * weight[:, None], first[:-1], axis=0)
        score = 1 / (1 + np.exp(-np.clip(z @ self.c + self.d, -30, 30)))
        return {"h": h, "t": t, "s": s, "bag": bag, "weight": weight, "z": z, "score": score}

    def score(self, texts: pa.Array) -> np.ndarray:
        """The score of each text; long ones go alone."""
        return self.forward(*encode(texts))["score"]


def fit(texts: list[str], labels: list[int], epochs: int = 60, seed: int = 11) -> Model | None:
    """Learns from whole documents and their labels by Adam on the logistic loss; None without any."""
    if not texts:
        return None
    random = np.random.default_rng(seed)
    order = sorted(range(len(texts)), key=lambda i: (texts[i], labels[i]))
    parts = [encode(pa.array([texts[i] for i in order[k : k + 100]], pa.large_string())) for k in range(0, len(order), 100)]
    x = np.concatenate([p for p, _ in parts])
    first = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(f) for _, f in parts]))))
    y = np.array([labels[i] for i in order], np.float32)
    draw = lambda *shape: (random.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
    model = Model(
        draw(N_FEATURES, HIDDEN), np.zeros(HIDDEN, np.float32), draw(HIDDEN, ATTENTION), draw(HIDDEN, ATTENTION),
        draw(ATTENTION), draw(HIDDEN), np.zeros(1, np.float32),
    )
    values = [model.w, model.b, model.v, model.u, model.a, model.c, model.d]
    means, squares = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    step = 0
    for _ in range(epochs):
        for bags in np.array_split(random.permutation(len(y)), max(1, len(y) // 128)):
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in bags])
            starts = np.concatenate(([0], np.cumsum(first[bags + 1] - first[bags])))
            part = x[rows]
            f = model.forward(part, starts)
            g = ((f["score"] - y[bags]) / len(bags)).astype(np.float32)
            dz = g[:, None] * model.c
            dweight = (f["h"] * dz[f["bag"]]).sum(axis=1)
            mean = np.add.reduceat(dweight * f["weight"], starts[:-1])[f["bag"]]
            de = f["weight"] * (dweight - mean)
            gate = de[:, None] * model.a
            dt, ds = gate * f["s"] * (1 - f["t"] ** 2), gate * f["t"] * f["s"] * (1 - f["s"])
            dh = f["weight"][:, None] * dz[f["bag"]] + dt @ model.v.T + ds @ model.u.T
            dh *= 1 - f["h"] ** 2
            grown = [
                part.T @ dh + 1e-4 * model.w, dh.sum(axis=0), f["h"].T @ dt, f["h"].T @ ds, (f["t"] * f["s"]).T @ de,
                f["z"].T @ g, g.sum(keepdims=True),
            ]
            step += 1
            for v, m, q, d in zip(values, means, squares, grown):
                m += 0.1 * (d - m)
                q += 0.001 * (d * d - q)
                v -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)
    return model


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """A model from ``labels`` (doc_id, quality) and the texts of ``docs`` (doc_id, text).

    About ``sample_docs`` labelled documents of up to ``SAMPLE_CHARS`` characters, picked by a hash of the id, go to the
    driver.  An id with several labels has their majority, 1 on a tie; one with several texts the first of them.
    Null ids, labels and texts are left out.
    """
    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality").where(
        F.col("doc_id").isNotNull() & F.col("quality").isNotNull()
    )
    marked = marked.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    limit = int(min(1.0, sample_docs / max(1, marked.count())) * (1 << 30))
    picked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < limit)
    texts = id_and_text(docs).where(F.length("text") <= SAMPLE_CHARS)
    rows = texts.join(picked, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    return fit([r["text"] for r in rows], [r["quality"] for r in rows])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, score.  Null and empty texts have one passage without
    features, and without a model every score is 0.5.  Texts are read whole; other columns are not read; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            model = shared.value
            scores = model.score(batch.column("text")) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores.astype(np.float64))], names=["doc_id", "score"]
            )

    return id_and_text(docs).mapInArrow(work, "doc_id bigint, score double")

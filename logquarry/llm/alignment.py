"""Cross-tokenizer alignment: which tokens of two vocabularies lie on the same bytes of a text.

Per batch, ``merge_asof`` finds for each token's start the last token of the other side that starts no later, which is
the one that covers it.  Of two tokens that overlap, the one that starts later starts inside the other; so both
directions together give all overlaps.  Where tokens of both sides end at the same byte, a group ends.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.session import settle

from .bpe import _byte_characters, _newer
from .common import id_and_text, slices

BATCH_DOCS = 1024  # documents that are aligned at once
BATCH_BYTES = 4 << 20  # and bytes of their texts, or one longer text
BLANK = "▁"

_DOCS = pa.schema([("batch", pa.int64()), ("doc", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                   ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_overlaps", pa.int64()), ("groups_sha256", pa.string()),
                   ("pairs", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("docs", pa.binary()), ("n", pa.int64())])))])


class ByteLevel:
    """Side A: a byte-level vocabulary from a tokenizer file.

    The ranks of the merges are the ids, as they are in such files; a file in which they are not is refused.  Texts with
    characters that Unicode has got of late are left to the tokenizers library, because libraries differ about
    whether such a one is a letter.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        to_byte = _byte_characters()
        special = {t["content"] for t in spec["added_tokens"] if t.get("special")}
        vocabulary = spec["model"]["vocab"]
        ranks = {bytes(to_byte[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        merged = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        order = [vocabulary[one + two] for one, two in merged]
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or order != sorted(order) or spec.get("normalizer"):
            raise ValueError("a byte-level vocabulary is needed, whose ids follow its merges")
        self.words = tiktoken.Encoding("words", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})
        self.whole = tokenizers.Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.whole.encode_special_tokens = True
        self.bytes = [b""] * (1 + max(ranks.values()))
        for token, i in ranks.items():
            self.bytes[i] = token
        self.widths = np.array([len(x) for x in self.bytes], np.int64)

    def encode(self, text: str) -> list[int]:
        if _newer(text):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.words.encode_ordinary(text)


# Fixed value: how byte-level vocabularies cut a text before the merges.
_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Pieces:
    """Side B: a sentencepiece vocabulary."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:-1], 16)]) if self.model.is_byte(i) else piece.replace(BLANK, " ").encode())


@lru_cache(maxsize=2)
def sides(path_a: str, path_b: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(path_a), Pieces(path_b)


class Side:
    """The tokens of the documents of a batch, one after the other: doc, id, start and end in the bytes of all texts."""

    def __init__(self, ids: list[np.ndarray], widths: np.ndarray):
        self.counts = np.array([len(x) for x in ids], np.int64)
        self.ids = np.concatenate([*ids, np.empty(0, np.int32)]).astype(np.int32)
        self.doc = np.repeat(np.arange(len(ids)), self.counts)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        self.end = np.cumsum(widths[self.ids])
        self.start = self.end - widths[self.ids]

    def groups(self, links: np.ndarray) -> np.ndarray:
        """For each token, how many links, in order, are on tokens before it."""
        steps = np.zeros(len(self.ids) + 1, np.int64)
        steps[links + 1] = 1
        return np.cumsum(steps)[:-1]


def overlaps(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all tokens of a and b that share bytes, as pairs sorted by a, then b.  Both sides have the same
    texts."""

    def covering(one: Side, two: Side) -> np.ndarray:
        """For each token of ``one``, the token of ``two`` that covers its start."""
        left = pd.DataFrame({"start": one.start, "doc": one.doc})
        right = pd.DataFrame({"start": two.start, "doc": two.doc, "other": np.arange(len(two.ids))})
        return pd.merge_asof(left, right, on="start", by="doc")["other"].to_numpy()

    if not len(a.ids):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    width = len(b.ids)
    keys = np.concatenate([np.arange(len(a.ids)) * width + covering(a, b), covering(b, a) * width + np.arange(width)])
    keys.sort(kind="stable")
    return np.divmod(keys[np.append(True, keys[1:] != keys[:-1])], width)


def _tokens(texts: list[str | None], a: ByteLevel, b: Pieces) -> tuple[list, list]:
    """Ids on both sides; none where a side does not give the text back.  Side A's tokens are cut from the bytes of the
    text, so that it does if they are as long."""
    ids_a, ids_b, none = [], [], np.empty(0, np.int32)
    for text, two in zip(texts, b.model.encode([t or "" for t in texts], num_threads=1)):
        x = y = none
        if text and (raw := b" " + text.encode()) == b"".join(map(b.bytes.__getitem__, two)):
            one = np.array(a.encode(" " + text), np.int32)
            if int(a.widths[one].sum()) == len(raw):
                x, y = one, np.array(two, np.int32)
        ids_a.append(x)
        ids_b.append(y)
    return ids_a, ids_b


class Written:
    """The ids of a vocabulary in decimal, with each of the signs that may follow."""

    def __init__(self, size: int, last: str):
        self.inner, self.last = (np.array([f"{i}{sign}" for i in range(size)], object) for sign in (",", last))


def _digests(a: Side, b: Side, group_a: np.ndarray, group_b: np.ndarray, written: tuple[Written, Written]) -> list[str]:
    """The hex digest of each document's groups, ``a1,a2|b1;a3|b2,b3``; an empty text without tokens."""
    parts = []
    for side, group, signs in ((a, group_a, written[0]), (b, group_b, written[1])):
        last = np.append(group[1:] != group[:-1], True)[: len(group)]
        parts.append(np.where(last, signs.last[side.ids], signs.inner[side.ids]))
    # By group, a before b, each in order: groups are numbered through the whole batch.
    place_a = np.arange(len(group_a)) + np.searchsorted(group_b, group_a, "left")
    place_b = np.arange(len(group_b)) + np.searchsorted(group_a, group_b, "right")
    line = np.empty(len(group_a) + len(group_b), object)
    line[place_a], line[place_b] = parts
    bounds = (a.first + b.first).tolist()
    return [
        sha256("".join(line[i:j].tolist())[:-1].encode()).hexdigest() if j > i else "" for i, j in zip(bounds, bounds[1:])
    ]


def align(texts: list[str | None], a: ByteLevel, b: Pieces, written: tuple[Written, Written], widths: tuple) -> dict:
    """Groups, overlaps and links of each text: counts and digests per text, and of all links the pairs of ids."""
    one, two = (Side(ids, w) for ids, w in zip(_tokens(texts, a, b), widths))
    over_a, over_b = overlaps(one, two)
    ends = one.end[over_a] == two.end[over_b]
    link_a, link_b = over_a[ends], over_b[ends]
    group_a, group_b = one.groups(link_a), two.groups(link_b)
    docs, count = one.doc[link_a], len(texts)
    return {
        "n_a": one.counts, "n_b": two.counts, "n_groups": np.bincount(docs, minlength=count),
        "n_links": np.bincount(docs, minlength=count), "n_overlaps": np.bincount(one.doc[over_a], minlength=count),
        "digests": _digests(one, two, group_a, group_b, written),
        "links": (one.ids[link_a], two.ids[link_b], docs),
    }


def _batches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Ids and texts of up to ``BATCH_DOCS`` documents and about ``BATCH_BYTES``."""
    docs, texts, held = [], [], 0
    for batch in slices(batches, "text", BATCH_BYTES):
        size = batch.column("text").nbytes
        if docs and (len(docs) + batch.num_rows > BATCH_DOCS or held + size > BATCH_BYTES):
            yield docs, texts
            docs, texts, held = [], [], 0
        docs += batch.column("doc_id").to_pylist()
        texts += batch.column("text").to_pylist()
        held += size
    if docs:
        yield docs, texts


def _linked(a: np.ndarray, b: np.ndarray, docs: np.ndarray) -> list[dict]:
    """For each pair of ids in the links of a batch: in which documents, how often in each, and how often in all."""
    key = (a.astype(np.int64) << 32 | b) if len(a) else np.empty(0, np.int64)
    pairs, at = np.unique(key, return_inverse=True)
    cells, n = np.unique(at.astype(np.int64) << 32 | docs, return_counts=True)
    first = np.searchsorted(cells >> 32, np.arange(len(pairs) + 1))
    packed = np.stack([(cells & 0xFFFFFFFF).astype("<u4"), n.astype("<u4")], axis=1).tobytes()
    total = np.add.reduceat(n, first[:-1]) if len(pairs) else n
    return [
        {"a": int(p >> 32), "b": int(p & 0xFFFFFFFF), "docs": packed[8 * i : 8 * j], "n": int(t)}
        for p, i, j, t in zip(pairs.tolist(), first.tolist(), first[1:].tolist(), total.tolist())
    ]


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): batch, doc (its place in the batch), doc_id, n_a, n_b, n_groups, n_links,
    n_overlaps, groups_sha256, and pairs, which the first row of a batch holds for all of it."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(path_a, path_b)
        written = Written(len(a.bytes), "|"), Written(len(b.bytes), ";")
        widths = tuple(np.array([len(x) for x in s.bytes], np.int64) for s in (a, b))
        for number, (ids, texts) in enumerate(_batches(batches)):
            found = align(texts, a, b, written, widths)
            columns = [np.full(len(ids), number), np.arange(len(ids)), ids, *(found[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")),
                       found["digests"], [_linked(*found["links"])] + [None] * (len(ids) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _DOCS)], schema=_DOCS)

    columns = "batch bigint, doc int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_overlaps bigint, " \
              "groups_sha256 string, pairs array<struct<a:int,b:int,docs:binary,n:bigint>>"
    found = id_and_text(docs).mapInArrow(work, columns)
    # Numbers of batches are those of a task.
    return found.withColumn("batch", F.spark_partition_id().cast("bigint") * (1 << 32) + F.col("batch"))


def _sums(back: DataFrame) -> DataFrame:
    """batch, doc, n_best, count_sum, from rows (batch, docs, total, best) that are sorted by batch."""

    def summed(batch: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        docs = rows.column("docs").to_pylist()
        cells = np.frombuffer(b"".join(docs), "<u4").reshape(-1, 2).astype(np.int64)
        sizes = np.array([len(d) // 8 for d in docs])
        out = np.zeros((2, int(cells[:, 0].max()) + 1), np.int64)
        for line, value in zip(out, ("best", "total")):
            np.add.at(line, cells[:, 0], cells[:, 1] * np.repeat(rows.column(value).to_numpy().astype(np.int64), sizes))
        linked = np.unique(cells[:, 0])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(linked), batch)), pa.array(linked, pa.int32()), *(pa.array(line[linked]) for line in out)],
            names=["batch", "doc", "n_best", "count_sum"],
        )

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for rows in batches:
            numbers = rows.column("batch").to_numpy()
            cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if held and numbers[i] != last:
                    yield summed(last, held)
                    held = []
                last = int(numbers[i])
                held.append(rows.slice(i, j - i))
        if held:
            yield summed(last, held)

    return back.mapInArrow(work, "batch bigint, doc int, n_best bigint, count_sum bigint")


def align_corpus(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_a, n_b (tokens), n_groups, n_links (tokens of both sides that
    end together), n_overlaps (that share bytes), n_best (links whose pair of ids is, of all links of all documents with
    its id of B, one of the most frequent), count_sum (over links: how many links of all documents have its pair of ids),
    groups_sha256.

    A null or empty text, and one that either vocabulary does not give back byte by byte with a blank before it, has
    zeros and an empty digest.  Repeated rows and null ids are rows like others; other columns are not read.  The paths
    name the vocabularies on every executor.

    Links are counted per batch of documents before they move; the counts go back to the batches, a row per pair of
    ids and batch, so a pair that is in every document costs a row per batch.
    """
    rows = settle(aligned(docs, path_a, path_b), "aligned")
    pairs = rows.where(F.col("pairs").isNotNull()).select("batch", F.explode("pairs").alias("p")).select("batch", "p.*")
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("total"))
    most = counts.groupBy("b").agg(F.max("total").alias("most"))
    ranked = counts.join(most, "b").select("a", "b", "total", (F.col("total") == F.col("most")).alias("best"))
    back = pairs.select("batch", "a", "b", "docs").join(settle(ranked, "counts"), ["a", "b"]).select("batch", "docs", "total", "best")
    sums = _sums(back.repartition("batch").sortWithinPartitions("batch"))
    out = rows.join(sums, ["batch", "doc"], "left")
    return out.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")],
        "groups_sha256",
    )

"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is a set of word shingles with their places, and counts only where all of them stand in order.  So one
shingle of it, its prefix, is enough to find it, and the rarest one finds least besides it.  Shingles are ordered
by how often they occur in all documents; document places of a prefix shingle are joined with the windows that
have it; places too near a text's start or end for the window are dropped; and the words around the rest are
compared one by one.

What goes to every task is a bit per hash value, of fixed size: it thins out document places before the join and
decides nothing.  More items fill it up, which costs speed and no result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.session import settle

from .common import ALNUM, alnum_words, fresh, id_and_text, records, slices

WINDOW = 13
SHINGLE = 3
# 2 MB in a task.
FILTER_BITS = 24

_ODD = np.uint64(0x9E3779B97F4A7C15)
_PART = 4 << 20
_TABLE = np.frombuffer(ALNUM, np.uint8)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads hash values over all 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[:1] = 1
    return np.cumprod(powers)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomials of the words' bytes, from one running sum over all of them."""
    first, n = starts[0], ends[-1] - starts[0]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data[first : ends[-1]].astype(np.uint64) + np.uint64(1)) * _powers(int(_ODD), n), out=sums[1:])
    back = _powers(pow(int(_ODD), -1, 1 << 64), n)
    return _mixed((sums[ends - first] - sums[starts - first]) * back[starts - first])


class Words:
    """The words of a column of texts: lower-cased bytes, where words start and end in them, a hash of each, and the
    first word of each text with the end behind."""

    def __init__(self, texts: pa.Array):
        texts = texts.fill_null("").cast(pa.large_string())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
        self.data = _TABLE[raw]
        bounds = offsets - offsets[0]
        inside = self.data != 0x20
        before, after = np.zeros(len(inside) + 1, bool), np.zeros(len(inside) + 1, bool)
        before[1:], after[:-1] = inside, inside
        before[bounds] = after[bounds] = False
        self.starts = np.flatnonzero(inside & ~before[:-1])
        self.ends = np.flatnonzero(inside & ~after[1:]) + 1
        self.first = np.searchsorted(self.starts, bounds)
        self.hashes = np.empty(len(self.starts), np.uint64)
        i = 0
        while i < len(self.starts):  # in parts, for a long text's sake
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + _PART, "right")))
            self.hashes[i:j] = _word_hashes(self.data, self.starts[i:j], self.ends[i:j])
            i = j

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of ``size`` words within one text, and the word each starts at."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        out = np.full(n, np.uint64(size))
        for k in range(size):
            out = _mixed((out ^ self.hashes[k : k + n]) * _ODD)
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        at = np.flatnonzero(text[:n] == text[size - 1 :])
        return out[at], at


_WINDOWS = pa.schema(
    [
        ("item_id", pa.int64()), ("window", pa.string()), ("n", pa.int32()), ("size", pa.int32()),
        ("shingles", pa.list_(pa.int64())),
    ]
)
_PLACES = pa.list_(pa.struct([("shingle", pa.int64()), ("word", pa.int64()), ("from", pa.int64()), ("around", pa.string())]))


def _windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """item_id, window (its words), n (their number), size (words in a shingle), shingles: one row per window."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text")):
                words = alnum_words(text.as_py())
                n = min(window, len(words))
                size = min(shingle, n)
                if not n:
                    continue
                hashes = Words(pa.array([text.as_py()])).shingles(size)[0].view(np.int64)
                rows = [
                    (item, b" ".join(words[i : i + n]).decode(), n, size, hashes[i : i + n - size + 1].tolist())
                    for i in range(len(words) - n + 1)
                ]
                yield records(rows, _WINDOWS)

    columns = "item_id bigint, window string, n int, size int, shingles array<bigint>"
    return items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").mapInArrow(work, columns)


def _filter(hashes: DataFrame) -> Broadcast:
    """A bit for each value of the low ``FILTER_BITS`` bits that a hash in column ``shingle`` has.  At most
    2 ** (FILTER_BITS - 6) rows reach the driver."""
    slot = F.expr(f"shingle & {(1 << FILTER_BITS) - 1}")
    rows = hashes.groupBy(F.shiftright(slot, 6).cast("int").alias("i")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shingle & 63 as int))")).alias("bits")
    )
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for i, v in rows.collect():
        bits[i] = v
    return hashes.sparkSession.sparkContext.broadcast(bits.view(np.uint8))


def _known(keep: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = (hashes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
    return (keep[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).view(bool)


def _counts(docs: DataFrame, keep: Broadcast, sizes: list[int]) -> DataFrame:
    """How often shingles that pass the filter occur in all documents: shingle, places."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            words = Words(batch.column("text"))
            found = [h[_known(keep.value, h)] for h, _ in map(words.shingles, sizes)]
            values, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], names=["shingle", "places"])

    found = docs.select("text").mapInArrow(work, "shingle bigint, places bigint")
    return found.groupBy("shingle").agg(F.sum("places").alias("places"))


def _places(docs: DataFrame, keep: Broadcast, sizes: list[int], window: int) -> DataFrame:
    """A row per document: its columns but the text, all of them bigint, n_words, and where it has shingles that pass
    the filter, with the words around."""
    ids = [c for c in docs.columns if c != "text"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            words = Words(batch.column("text"))
            places: list[list] = [[] for _ in range(batch.num_rows)]
            for size in sizes:
                hashes, at = words.shingles(size)
                known = _known(keep.value, hashes)
                hashes, at = hashes[known], at[known]
                of = np.searchsorted(words.first, at, "right") - 1
                for h, i, k in zip(hashes.view(np.int64).tolist(), at.tolist(), of.tolist()):
                    first, end = words.first[k], words.first[k + 1]
                    a, b = max(first, i - window + 1), min(end, i + window)
                    around = bytes(words.data[words.starts[a] : words.ends[b - 1]])
                    places[k].append(
                        {"shingle": h, "word": int(i - first), "from": int(a - first), "around": b" ".join(around.split()).decode()}
                    )
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, ids), pa.array(np.diff(words.first)), pa.array(places, _PLACES)],
                names=[*ids, "n_words", "places"],
            )

    columns = "n_words bigint, places array<struct<shingle:bigint,word:bigint,from:bigint,around:string>>"
    return docs.mapInArrow(work, ", ".join(f"{c} bigint" for c in ids) + ", " + columns)


def find_contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE
) -> tuple[DataFrame, DataFrame]:
    """Documents, and where they have item windows.

    The first frame has a row per row of ``docs`` (text and bigint columns): row (its number), those, n_words.  The second has
    a row per place: row, window, start (word), n (words).  A window is ``window`` consecutive words of an item, or
    the whole item if it has fewer.
    """
    cut = settle(_windows(items, window, shingle), "windows")
    windows = cut.groupBy("window").agg(F.first("n").alias("n"), F.first("size").alias("size"), F.first("shingles").alias("shingles"))
    sizes = [r["size"] for r in cut.select("size").distinct().collect()]  # 1 to ``shingle``
    if not sizes:
        sizes = [shingle]
    placed = windows.select("window", "n", "size", F.posexplode("shingles").alias("offset", "shingle"))
    counts = _counts(docs, _filter(placed), sizes)
    # A window with a shingle that no document has occurs nowhere.
    rarest = (
        placed.join(counts, "shingle", "left")
        .groupBy("window", "n")
        .agg(F.min(F.struct(F.coalesce("places", F.lit(0)).alias("places"), "shingle", "offset")).alias("prefix"))
        .where("prefix.places > 0")
        .select("window", "n", "prefix.shingle", "prefix.offset")
    )
    prefixes = settle(rarest, "prefixes")
    found = _places(docs, _filter(prefixes), sizes, window).withColumn("row", F.monotonically_increasing_id())
    found = settle(found, "places")
    start = F.col("word") - F.col("offset")
    there = F.concat_ws(" ", F.slice(F.split("around", " "), (start - F.col("from") + 1).cast("int"), F.col("n")))
    places = (
        found.select("row", "n_words", F.inline("places"))
        .join(prefixes, "shingle")
        .where((start >= 0) & (start + F.col("n") <= F.col("n_words")))
        .where(there == F.col("window"))
        .select("row", "window", start.alias("start"), "n")
    )
    return found.drop("places"), places


def _covered(ranges: str) -> str:
    """The number of words in sorted ranges (a, b) that may overlap."""
    return (
        f"aggregate({ranges}, struct(cast(0 as bigint) as n, cast(0 as bigint) as done), (s, r) -> struct("
        "s.n + greatest(r.b - greatest(r.a, s.done), cast(0 as bigint)) as n, greatest(s.done, r.b) as done), s -> s.n)"
    )


def _judged(docs: DataFrame, items: DataFrame, window: int, shingle: int, share: int) -> DataFrame:
    rows, places = find_contamination(docs, items, window, shingle)
    hits = (
        places.select("row", F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("b")).alias("r"))
        .groupBy("row")
        .agg(F.sort_array(F.collect_set("r")).alias("ranges"))
        .select("row", F.expr(_covered("ranges")).alias("n_hit"))
    )
    owners = _windows(items, window, shingle).select("window", "item_id").where("item_id is not null").distinct()
    listed = (
        places.select("row", "window").distinct().join(owners, "window")
        .groupBy("row").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    n_hit = F.coalesce("n_hit", F.lit(0))
    found = F.coalesce("items", F.array().cast("array<string>"))
    return (
        rows.join(hits, "row", "left").join(listed, "row", "left").select(
            *[c for c in docs.columns if c != "text"], "n_words", n_hit.alias("n_hit"), F.size(found).cast("bigint").alias("n_items"), found.alias("items"),
            ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
        )
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, share: int = 20
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit (words inside an occurrence of a window), n_items (items
    with occurring windows), items (their ids as strings, sorted), contaminated (any hit, and at least one word in
    ``share`` hit).

    Null and empty texts have no words and no hits; items without words have no windows; an item without id causes
    hits, but is not listed; items of one id count once.  Repeated rows give repeated rows.  Other columns are not read.
    """
    return _judged(id_and_text(docs), items, window, shingle, share)


def keep_clean(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, share: int = 20
) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    own, text_hash = fresh(docs, "own_id"), fresh(docs, "own_hash")
    keyed = id_and_text(docs).withColumn("text_hash", F.xxhash64("text"))
    judged = _judged(keyed, items, window, shingle, share)
    bad = judged.where("contaminated").select(F.col("doc_id").alias(own), F.col("text_hash").alias(text_hash)).distinct()
    same = docs["doc_id"].cast("bigint").eqNullSafe(bad[own]) & (F.xxhash64(docs["text"]) == bad[text_hash])
    return docs.join(bad, same, "left_anti")

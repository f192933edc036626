"""SimHash near duplicates: fingerprints that differ in few bits, found by blocks, and their connected components.

A fingerprint of 64 bits is cut into ``2 + distance`` blocks.  A close pair differs in at most ``distance`` of them,
so it shares two whole blocks, and every pair of blocks is a key to join on.  Equal fingerprints are one node from
the start.  A key that many different fingerprints share would pair each with each; such a bucket links them through
the points around them instead: two fingerprints are within two bits exactly if they have a point within one bit in
common, and a point has at most 65 fingerprints around it.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.session import settle

from .common import blank_words, fresh, id_and_text, in_small_batches, named
from .graph import components

SHINGLE = 3
DISTANCE = 2
SEED = 42
# Fingerprints in a bucket up to which each is compared with each.
BUCKET = 32


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is set if more than half of the shingles' hashes have it; no words give 0."""
    words = blank_words(text, lower=True)
    if not words:
        return 0
    line = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    cuts = zip(starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist())
    hashes = np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in cuts], "<u8")
    ones = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64) if len(bits) < 64 else _column_sums(bits)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def _column_sums(bits: np.ndarray) -> np.ndarray:
    """Sums of 255 rows at a time fit into bytes."""
    whole = len(bits) // 255 * 255
    sums = bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return sums + bits[whole:].sum(axis=0, dtype=np.int64)


def with_fingerprints(docs: DataFrame, name: str, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with a column more, the fingerprint of ``text`` as a signed long."""

    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return in_small_batches(docs).withColumn(name, of(F.col("text")))


def _buckets(nodes: DataFrame, distance: int) -> DataFrame:
    """fp, key, mask: one row per pair of blocks; two fingerprints with a key in common agree in ``mask``."""
    blocks = distance + 2
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    signed = [m - (1 << 64) if m >> 63 else m for m in (x | y for x, y in combinations(masks, 2))]
    return nodes.select("fp", F.explode(F.array(*[F.lit(m).cast("bigint") for m in signed])).alias("mask")).select(
        "fp", "mask", F.expr("fp & mask").alias("bits")
    )


def links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b), a < b, of the different values ``nodes.fp`` that connect all that are within ``distance`` bits.

    Each pair is close.  In buckets of up to ``BUCKET`` fingerprints all close pairs come out; in larger ones, of
    the fingerprints around a point, the pairs with the smallest, which connect the same ones.
    """
    if distance not in (1, 2):
        raise ValueError("large buckets are linked by points within one bit, which reaches two bits")
    buckets = _buckets(nodes, distance)
    sizes = buckets.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = settle(buckets.join(sizes, ["mask", "bits"]), "buckets")
    few = shared.where(f"size <= {BUCKET}").select("mask", "bits", "fp")
    close = (
        few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), ["mask", "bits"])
        .where("a < b").where(F.expr(f"bit_count(a ^ b) <= {distance}")).select("a", "b")
    )
    # Around a fingerprint: itself and every value one bit away.  For distance 1 the point itself is one of the pair.
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint") for i in range(64)])
    many = shared.where(f"size > {BUCKET}").select("fp").distinct()
    around = many.select("fp", F.explode(flips).alias("flip")).select("fp", F.expr("fp ^ flip").alias("point"))
    rings = around.groupBy("point").agg(F.sort_array(F.collect_set("fp")).alias("fps")).where("size(fps) > 1")
    if distance == 1:
        rings = rings.where("array_contains(fps, point)")
    centre = F.col("point") if distance == 1 else F.col("fps")[0]
    starred = rings.select(centre.alias("a"), F.explode("fps").alias("b")).where("a <> b")
    starred = starred.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return close.union(starred).distinct()


def _classes(printed: DataFrame, fp: str, order: list, distance: int) -> DataFrame:
    """fp, first: of each fingerprint, the smallest ``struct(*order)`` in its component."""
    nodes = settle(printed.groupBy(named(printed, fp).alias("fp")).agg(F.min(F.struct(*order)).alias("first")), "prints")
    tied = components(links(nodes, distance))
    rooted = nodes.join(tied.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return rooted.select("fp", "root").join(firsts, "root").select("fp", "first")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id (the smallest
    doc_id that close fingerprints reach; null only if all of them are null).

    Null, empty and blank texts have fingerprint zero and are linked like others; repeated rows and ids are rows like
    others; other columns are not read.
    """
    rows = settle(with_fingerprints(id_and_text(docs), "fp", shingle).select("doc_id", "fp"), "prints")
    smallest = [F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")]
    classes = _classes(rows, "fp", smallest, distance)
    return rows.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id")
    )


def keep_one(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, the one with the smallest doc_id; of rows with equal
    ids, the first as written.  A null id comes last.  All columns stay."""
    fp, row = fresh(docs, "fp"), fresh(docs, "row")
    rows = with_fingerprints(docs, fp, shingle).withColumn(row, F.monotonically_increasing_id())
    rows = settle(rows, "prints")
    order = [F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), named(rows, row).alias("row")]
    kept = _classes(rows, fp, order, distance).select(F.col("first.row").alias(row)).distinct()
    return rows.join(kept, row, "left_semi").drop(fp, row)

"""SuperMinHash near duplicates: signatures of word shingles, bands, exact checks and connected components.

Each shingle draws a permutation of the components, and in its step ``j`` offers a rank between ``j`` and ``j + 1`` to
the component that is j-th in it; a component keeps the lowest rank.  Ranks of one shingle are spread over all
components, which is why a signature varies less than one of independent hashes.  A document whose components all
hold ranks below ``j + 1`` is finished after step ``j``: later steps offer more.

Documents with equal sets are one node from the start.  Nodes with ``ROWS`` equal components in a row meet in a bucket.
A bucket is never paired with itself as a whole.  In each of a few rounds a member is held against one pivot of another
component, the one that meets most members in its buckets, and components grow by the links found.  Only members of one
bucket that are in different components after that are paired, where their known distances to a common pivot leave it open (the
Jaccard distance obeys the triangle inequality) and so do the parities of their sets, which no two near sets can differ in by more bits
than they may by shingles.  So copies of one text cost a comparison a round each, and no link between
different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.session import settle

from .common import blank_words, id_and_text, in_small_batches, parts, slices
from .graph import components

SHINGLE = 5
PERCENT = 80
COMPONENTS, ROWS = 128, 4  # two sets with a similarity of 0.8 share none of the 32 bands once in 20 million times
# Each component gives one bit.  Of sets with a similarity of 0.8 a tenth of the bits differ, six deviations are 33.
MOST_BITS = 33
# Each shingle falls on one bit of a set, which is set if an odd number does.  Of two sets no more bits differ than shingles do.
PARITY_LONGS = 32
PIVOTS = 8  # rounds with pivots, while they join components, before what is left is paired
PIVOT_SHARE = 10  # a further round follows one that left at least one in so many components fewer
FILTER_BITS = 24

_PART = 1 << 17  # shingles that are ranked at once; bounds memory only
_GOLDEN, _ONE, _TWO = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_SETS = pa.schema(
    [("doc_id", pa.int64()), ("th", pa.int64()), ("tg", pa.int64()), ("n", pa.int64()), ("h", pa.int64()), ("g", pa.int64()),
     ("bands", pa.list_(pa.int64())), ("k0", pa.int64()), ("k1", pa.int64()), ("odd", pa.list_(pa.int64()))]
)
_COLUMNS = "doc_id bigint, th bigint, tg bigint, n bigint, h bigint, g bigint, bands array<bigint>, k0 bigint, k1 bigint, odd array<bigint>"


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the splitmix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * _ONE
    x = (x ^ (x >> np.uint64(27))) * _TWO
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The different shingles of a text as sorted 64-bit hashes; of fewer words, their whole sequence; none for none."""
    hashed = [
        np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        for words in (blank_words(p, lower=True) for p in parts(text or ""))
    ]
    hashes = np.concatenate(hashed)
    size = min(shingle, len(hashes))
    if not size:
        return hashes
    count = len(hashes) - size + 1
    joined = np.full(count, size, np.uint64)
    for k in range(size):
        joined = _mix(joined * _GOLDEN + hashes[k : k + count])
    return np.unique(joined)


def signatures(sets: list[np.ndarray], size: int = COMPONENTS) -> np.ndarray:
    """A row per set: the lowest rank of each component, its whole part in the upper 32 bits.  Empty sets keep the
    highest value everywhere."""
    out = np.full((len(sets), size), ~np.uint64(0))
    first = 0
    while first < len(sets):
        last, held = first + 1, len(sets[first])
        while last < len(sets) and held + len(sets[last]) <= _PART:
            held += len(sets[last])
            last += 1
        items = np.concatenate(sets[first:last])
        owner = np.repeat(np.arange(first, last), [len(s) for s in sets[first:last]])
        for at in range(0, len(items), _PART):
            _rank(items[at : at + _PART], owner[at : at + _PART], out)
        first = last
    return out


def _rank(items: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
    """Lower the ranks of ``out`` by the permutations of the items."""
    size = out.shape[1]
    flat, order = out.reshape(-1), None
    for step in range(size):
        draw = _mix(items + np.uint64((step + 1) * int(_GOLDEN) % (1 << 64)))
        place = step + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(size - step) >> np.uint64(32)).astype(np.int64)
        if order is None:
            component = place
        else:
            here = np.arange(len(items))
            component = order[here, place].astype(np.int64)
            order[here, place] = order[here, step]
        np.minimum.at(flat, owner * size + component, np.uint64(step << 32) | draw >> np.uint64(32))
        open_ = out.max(axis=1) >= np.uint64((step + 1) << 32)
        live = open_[owner]
        if not live.any():
            return
        if order is None:
            order = np.tile(np.arange(size, dtype=np.uint16), (int(live.sum()), 1))
            order[np.arange(len(order)), place[live]] = 0
        else:
            order = order[live]
        items, owner = items[live], owner[live]


def _sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    return [shingle_set(t.as_py(), shingle) for t in texts]


def parities(sets: list[np.ndarray], longs: int = PARITY_LONGS) -> np.ndarray:
    """A row per set: for each of 64 * ``longs`` bits whether an odd number of the set's shingles falls on it."""
    out = np.empty((len(sets), longs), np.int64)
    for row, items in zip(out, sets):
        odd = np.bincount((_mix(items) % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
        row[:] = np.packbits(odd.astype(bool)).view(np.int64)
    return out


def _described(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, th and tg (for the text), n (shingles), h and g (for the set), bands, k0 and k1 (bits of the signature), odd
    (parities of the set)."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = _sets(batch.column("text"), shingle)
            ranks = signatures(sets)
            full = np.array([len(s) > 0 for s in sets], bool)
            keys = np.broadcast_to(np.arange(COMPONENTS // ROWS, dtype=np.uint64), (len(sets), COMPONENTS // ROWS))
            grouped = ranks.reshape(len(sets), -1, ROWS)
            for k in range(ROWS):
                keys = _mix(keys * _GOLDEN + grouped[:, :, k])
            bits = np.packbits((ranks & np.uint64(1)).astype(bool), axis=1).view(np.int64)
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            offsets = np.concatenate(([0], np.cumsum(full * keys.shape[1])))
            bands = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.array(keys[full].view(np.int64).ravel()), mask=pa.array(~full)
            )
            columns = [
                *(batch.column(c) for c in ("doc_id", "th", "tg")), pa.array([len(s) for s in sets], pa.int64()),
                *(pa.array(np.ascontiguousarray(digests[:, i])) for i in (0, 1)), bands,
                *(pa.array(np.ascontiguousarray(bits[:, i])) for i in (0, 1)),
                pa.ListArray.from_arrays(
                    pa.array(np.arange(len(sets) + 1) * PARITY_LONGS, pa.int32()), pa.array(parities(sets).ravel())
                ),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=_SETS)

    return docs.mapInArrow(work, _COLUMNS)


def _with_text_hash(docs: DataFrame) -> DataFrame:
    return id_and_text(docs).select("*", F.xxhash64("text").alias("th"), F.xxhash64(F.lit("second"), "text").alias("tg"))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, text of the rows ``wanted`` (id, th, tg).

    A bit per value of the low ``FILTER_BITS`` bits of ``th`` thins out the texts before they are shuffled; it is 2 MB
    whatever the table, and decides nothing.
    """
    slot = F.expr(f"th & {(1 << FILTER_BITS) - 1}")
    words = wanted.groupBy(F.shiftright(slot, 6).cast("int").alias("i")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(th & 63 as int))")).alias("bits")
    )
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for i, v in words.collect():
        bits[i] = v
    keep = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint8))

    def thin(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column("th").to_numpy().view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
            known = keep.value[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1
            yield batch.filter(pa.array(known.astype(bool)))

    found = _with_text_hash(docs).select("th", "tg", "text").mapInArrow(thin, "th bigint, tg bigint, text string")
    found = found.groupBy("th", "tg").agg(F.first("text").alias("text"))
    return found.join(wanted, ["th", "tg"]).select("id", "text")


def _compared(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """a, b, common: how many shingles the whole texts of each pair share."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            common = []
            for a, one, two in zip(batch.column("a").to_pylist(), batch.column("one"), batch.column("two")):
                if a != last:
                    last, own = a, shingle_set(one.as_py(), shingle)
                other = shingle_set(two.as_py(), shingle)
                at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                common.append(int((own[at] == other).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(common, pa.int64())], names=["a", "b", "common"]
            )

    one, two = (texts.select(F.col("id").alias(i), F.col("text").alias(t)) for i, t in (("a", "one"), ("b", "two")))
    both = pairs.select("a", "b").join(two, "b").join(one, "a")
    return in_small_batches(both.select("a", "b", "one", "two")).mapInArrow(work, "a bigint, b bigint, common bigint")


def _possible(percent: int) -> Column:
    """Whether the sizes, parities and signatures of a pair allow the similarity."""
    sizes = 100 * F.least("an", "bn") >= percent * F.greatest("an", "bn")
    bits = sum(F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in ("k0", "k1"))
    # Below 0.8 more bits may differ; each point less lets a two-hundredth of them.
    signed = bits <= MOST_BITS + max(0, PERCENT - percent) * COMPONENTS // 200
    # Shingles of one set only are at least as many as the bits that differ.
    apart = sum(F.bit_count(F.col("aodd")[i].bitwiseXOR(F.col("bodd")[i])) for i in range(PARITY_LONGS))
    return sizes & signed & ((100 + percent) * apart <= (100 - percent) * (F.col("an") + F.col("bn")))


def _side(nodes: DataFrame, x: str) -> DataFrame:
    return nodes.select(F.col("id").alias(x), *[F.col(c).alias(f"{x}{c}") for c in ("n", "k0", "k1", "odd")])


def _judged(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, known: DataFrame | None, shingle: int, percent: int) -> DataFrame:
    """a, b, common, near, far (the Jaccard distance) of the pairs (a < b) that may be near and are not known yet."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if known is not None:
        pairs = pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")
    pairs = pairs.join(_side(nodes, "b"), "b").join(_side(nodes, "a"), "a").where(_possible(percent))
    pairs = settle(pairs.select("a", "b", "an", "bn"), "pairs")
    union = F.col("an") + F.col("bn") - F.col("common")
    out = _compared(pairs, texts, shingle).join(pairs, ["a", "b"])
    return settle(
        out.select("a", "b", (100 * F.col("common") >= percent * union).alias("near"), (1 - F.col("common") / union).alias("far")),
        "compared",
    )


def links(nodes: DataFrame, docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """a, b: pairs of ``nodes`` (id, th, tg, n, bands, k0, k1, odd) whose sets are near, which connect all that are and share
    a band."""
    entries = nodes.select("id", F.posexplode("bands").alias("band", "key"))
    buckets = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = settle(entries.join(buckets, "key"), "shared")
    # The more members a node meets in its buckets, the nearer it is to the middle of a group of copies.
    met = shared.groupBy("id").agg(F.sum("size").alias("met"))
    wanted = settle(nodes.select("id", "th", "tg", "n", "bands", "k0", "k1", "odd").join(met, "id"), "wanted")
    shared = settle(shared.select("id", "band", "key").join(wanted.select("id", "met"), "id"), "shared")
    texts = settle(_texts(docs, wanted.select("id", "th", "tg")), "texts")

    known = first = _judged(_stars(_open(shared, None)), wanted, texts, None, shingle, percent)
    open_, before = _open(shared, known.where("near")), None
    for _ in range(PIVOTS):
        roots = open_.select("root").distinct().count()
        if not roots or before is not None and PIVOT_SHARE * (before - roots) < before:
            break
        before = roots
        more = _judged(_stars(open_, known), wanted, texts, known, shingle, percent)
        known = settle(known.union(more), "known")
        open_ = _open(shared, known.where("near"))
    left = _judged(_apart(open_, first, wanted, percent), wanted, texts, known, shingle, percent)
    return known.union(left).where("near").select("a", "b")


def _open(shared: DataFrame, near: DataFrame | None) -> DataFrame:
    """``shared`` (key, id, band, met) with root: the members of the buckets that lie in more than one component."""
    if near is None:
        return shared.withColumn("root", F.col("id"))
    roots = components(near.select("a", "b"))
    rooted = shared.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    several = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return settle(rooted.join(several, "key", "left_semi"), "open")


def _stars(open_: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """a, b: each member of a bucket with one pivot of another component, the one that meets most members; in the bucket
    where that is the highest, and none that is known already."""
    most = F.max(F.struct("met", "id", "root"))
    best = open_.groupBy("key").agg(most.alias("p1"))
    other = open_.join(best, "key").where(F.col("root") != F.col("p1.root")).groupBy("key").agg(most.alias("p2"))
    pivots = best.join(other, "key", "left")
    pivot = F.when(F.col("root") != F.col("p1.root"), F.col("p1")).otherwise(F.col("p2"))
    # A member meets one pivot in many buckets; it is one pair from here on.
    pairs = open_.join(pivots, "key").select("id", pivot.alias("p")).where("p is not null").distinct()
    if known is not None:
        seen = known.select(F.col("a").alias("id"), F.col("b").alias("pid")).union(known.select("b", "a"))
        pairs = pairs.withColumn("pid", F.col("p.id")).join(seen, ["id", "pid"], "left_anti")
    return pairs.groupBy("id").agg(F.max("p").alias("p")).select(F.col("p.id").alias("a"), F.col("id").alias("b"))


def _apart(open_: DataFrame, first: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """a, b: members of one bucket in different components that may be near, also by their distances to a pivot that both
    were held against; in the first band that they share."""
    seen = first.select(F.col("a").alias("one"), F.col("b").alias("two"), "far")
    seen = seen.select(F.col("one").alias("pivot"), F.col("two").alias("id"), "far").union(seen.select("two", "one", "far"))
    nearest = seen.groupBy("id").agg(F.min(F.struct("far", "pivot")).alias("to"))
    placed = open_.select("key", "band", "id", "root").join(nearest, "id", "left").join(nodes.drop("th", "tg", "met"), "id")
    one, two = (
        placed.select("key", *[F.col(c).alias(f"{x}{c}") for c in ("band", "id", "root", "to", "n", "k0", "k1", "odd", "bands")])
        for x in "ab"
    )
    reach = F.abs(F.col("ato.far") - F.col("bto.far")) <= 1 - percent / 100 + 1e-9
    reach = F.coalesce((F.col("ato.pivot") != F.col("bto.pivot")) | reach, F.lit(True))
    earlier = F.expr("exists(zip_with(slice(abands, 1, aband), slice(bbands, 1, aband), (x, y) -> x = y), z -> z)")
    apart = (F.col("aroot") < F.col("broot")) & reach & _possible(percent) & ~earlier
    return one.join(two, "key").where(apart).select(F.col("aid").alias("a"), F.col("bid").alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles (different ones), component_id (the smallest doc_id
    that near documents reach; null only if all of them are null), kept (whether that is the row's own).

    Documents are near if 100 times the shingles that they share are at least ``percent`` times those that either has.
    Shingles are known by 64-bit hashes, A-Z lower-cased.  Null, empty and blank texts have no shingles and are near
    nothing, not even each other; repeated rows and ids are rows like others; other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    described = _described(_with_text_hash(docs), shingle).withColumn("id", F.monotonically_increasing_id())
    rows = settle(described, "sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
    same = [F.first(c).alias(c) for c in ("n", "bands", "k0", "k1", "odd")]
    grouped = rows.where("n > 0").groupBy("h", "g").agg(F.min(F.struct("id", "th", "tg")).alias("own"), first, *same)
    nodes = settle(grouped.select("h", "g", "own.*", "first", "n", "bands", "k0", "k1", "odd"), "nodes")
    roots = components(links(nodes, docs, shingle, percent)).withColumnRenamed("node", "id")
    rooted = nodes.select("h", "g", "id", "first").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    rooted = settle(rooted, "rooted")
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component"))
    classes = settle(rooted.join(firsts, "root").select("h", "g", "component"), "classes")
    out = rows.select("doc_id", "n", "h", "g").join(classes, ["h", "g"], "left")
    own = F.when(F.col("n") > 0, F.col("component.doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))

"""Hard negatives by shared lists: anchors are clustered, and each cluster walks one list of candidates.

For a cluster with centre c and radius r, a candidate at the angle t from c scores at most ``|anchor| * |candidate| *
cos(max(0, t - r))`` with any of its anchors.  Candidates are sorted by ``|candidate| * cos(max(0, t - r))`` once per
cluster, and every anchor walks down that list until the bound falls below what it still needs: then nothing further
down can enter its result.

Three things keep the lists short and the tasks small.  Rows with equal label and vector are one candidate with its
smallest ids.  A bounded sample of the candidates gives each anchor a score that its result certainly reaches; the
lowest of a cluster decides which candidates reach its list at all.  And a list is dealt into slices, and a large cluster into
groups of anchors; each group walks each slice in a task of its own, and the best of all slices are merged.  The sample and
the clusters decide about speed only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.operators.ranking import top_k_per_group
from logquarry.session import settle

from .common import in_small_batches, records

CLUSTERS = 32  # at most, so that what every task knows of them is bounded
MEMBERS = 512  # anchors that walk a slice together
SLICE = 1 << 14  # candidates of a slice, about
SAMPLE = 4096  # candidates, and anchors, of the bounded samples
SLACK = 1e-6  # radians, for the rounding of angles

_FOUND = pa.schema([("ask", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("score", pa.int64()), ("cid", pa.int64())])
_FOUND_COLUMNS = "ask bigint, low bigint, high bigint, score bigint, cid bigint"
_LEAST, _MOST = -(1 << 62), 1 << 62


def _matrix(packed: list[bytes], width: int = 0) -> np.ndarray:
    """Vectors of whole numbers as rows, shorter ones filled up with zeros."""
    width = max([width, *(len(p) // 8 for p in packed)])
    return np.frombuffer(b"".join(p.ljust(8 * width, b"\0") for p in packed), "<i8").reshape(len(packed), width)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of two matrices of whole numbers."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if largest < 2**62:
        return a @ b.T
    raise OverflowError("scores beyond 64 bits")


class Walk:
    """Anchors going down a list; each wants, for some ranges of scores, the ``k`` best candidates."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, of: np.ndarray, wants: np.ndarray, same: bool, k: int):
        """``of`` gives the anchor of each of ``wants``: lowest and highest score, and one that is certainly reached."""
        self.vectors, self.labels, self.of, self.same, self.k = vectors, labels, of, same, k
        self.norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        self.high, self.floor = wants[:, 1], np.maximum(wants[:, 0], wants[:, 2])
        self.kept = np.empty((0, 4), np.int64)  # want, score, smallest id, cid

    def going(self, bound: float) -> np.ndarray:
        """The wants that a candidate with this bound may still serve."""
        reach = self.norms[self.of] * bound
        return np.flatnonzero(reach + 1e-9 * np.abs(reach) + 1e-6 >= self.floor)

    def feed(self, bound: float, vectors: np.ndarray, labels: np.ndarray, ids: np.ndarray, cids: np.ndarray) -> bool:
        """Take in the next candidates, none with a bound above ``bound``; whether any want goes on."""
        live = self.going(bound)
        if not len(live):
            return False
        asks, at = np.unique(self.of[live], return_inverse=True)
        width = max(vectors.shape[1], self.vectors.shape[1])
        fill = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
        scores = inner_products(fill(self.vectors[asks]), fill(vectors))
        fits = (self.labels[asks][:, None] == labels[None, :]) == self.same
        scores, fits = scores[at], fits[at]
        want, which = np.nonzero(fits & (scores >= self.floor[live][:, None]) & (scores <= self.high[live][:, None]))
        if len(want):
            new = np.stack([live[want], scores[want, which], ids[which], cids[which]], axis=1)
            self._keep(np.concatenate([self.kept, new]))
        return True

    def _keep(self, rows: np.ndarray) -> None:
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
        first = np.concatenate(([True], rows[1:, 0] != rows[:-1, 0]))
        start = np.flatnonzero(first)
        rank = np.arange(len(rows)) - np.repeat(start, np.diff(np.append(start, len(rows))))
        last = rows[rank == self.k - 1]
        self.floor[last[:, 0]] = np.maximum(self.floor[last[:, 0]], last[:, 1])
        self.kept = rows[rank < self.k]


def pack(vectors: DataFrame, column: str) -> Column:
    """An array of whole numbers as bytes, eight each, lowest first."""
    digits = F.transform(F.col(column), lambda x: F.lpad(F.hex(x), 16, "0"))
    swapped = F.transform(digits, lambda h: F.reverse(F.regexp_replace(h, "(.)(.)", "$2$1")))
    return F.unhex(F.array_join(swapped, ""))


def _candidates(rows: DataFrame, k: int) -> DataFrame:
    """cid, label, packed, ids (the ``k`` smallest): one row per label and vector."""
    top = top_k_per_group(rows.select("label", "packed", "vec_id"), ["label", "packed"], [F.col("vec_id")], k)
    grouped = top.groupBy("label", "packed").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return settle(grouped.withColumn("cid", F.monotonically_increasing_id()), "candidates")


def _centres(asks: DataFrame) -> np.ndarray:
    """Centres of unit length of a bounded sample of the anchors; never more than ``CLUSTERS``."""
    sample = asks.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).collect()
    points = _matrix([bytes(r["packed"]) for r in sample]).astype(np.float64)
    points = _unit(points)
    count = max(1, min(CLUSTERS, len(points) // 64))
    centres = points[np.linspace(0, len(points) - 1, count).astype(int)] if len(points) else np.zeros((1, 1))
    for _ in range(8 if len(points) else 0):
        nearest = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        moved = np.linalg.norm(sums, axis=1) > 0
        centres[moved] = _unit(sums[moved])
    return centres


def _unit(points: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(points, axis=1, keepdims=True)
    return np.divide(points, norms, out=np.zeros_like(points), where=norms > 0)


def _angles(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of vectors, and their angles to each centre; a vector of zeros is at right angles to all."""
    width = max(vectors.shape[1], centres.shape[1])
    fill = lambda m: np.pad(m.astype(np.float64), ((0, 0), (0, width - m.shape[1])))
    norms = np.linalg.norm(vectors.astype(np.float64), axis=1)
    return norms, np.arccos(np.clip(_unit(fill(vectors)) @ fill(centres).T, -1, 1))


def _clustered(asks: DataFrame, centres: np.ndarray) -> DataFrame:
    """``asks`` (cid, label, packed) with cluster and angle."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angles = _angles(_matrix(batch.column("packed").to_pylist()), centres)[1]
            nearest = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(nearest, pa.int32()), pa.array(angles[np.arange(len(nearest)), nearest])],
                names=[*batch.schema.names, "cluster", "angle"],
            )

    return asks.select("cid", "label", "packed").mapInArrow(
        work, "cid bigint, label bigint, packed binary, cluster int, angle double"
    )


def _sure(asks: DataFrame, sample: list, same: bool, k: int) -> DataFrame:
    """``asks`` with, for each want, a score that its ``k``-th best certainly reaches, from a sample of candidates."""
    vectors = _matrix([bytes(r["packed"]) for r in sample])
    labels, cids = (np.array([r[c] for r in sample], np.int64) for c in ("label", "cid"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            walk, wants = _walk(batch.to_pylist(), same, k)
            for at in range(0, len(sample), 1024):
                part = slice(at, at + 1024)
                walk.feed(np.inf, vectors[part], labels[part], cids[part], cids[part])
            floors = np.split(walk.floor, np.cumsum(wants)[:-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f.tolist() for f in floors], pa.list_(pa.int64())), pa.array(walk.norms)],
                names=[*batch.schema.names, "floors", "norm"],
            )

    columns = "cid bigint, label bigint, packed binary, cluster int, lows array<bigint>, highs array<bigint>"
    return asks.select("cid", "label", "packed", "cluster", "lows", "highs").mapInArrow(
        work, columns + ", floors array<bigint>, norm double"
    )


def _walk(asks: list[dict], same: bool, k: int) -> tuple[Walk, list[int]]:
    """Anchors ready to walk, and how many wants each has."""
    sizes = [len(a["lows"]) for a in asks]
    column = lambda name: np.fromiter(chain.from_iterable(a[name] for a in asks), np.int64, sum(sizes))
    lows = column("lows")
    wants = np.stack([lows, column("highs"), column("floors") if "floors" in asks[0] else lows], axis=1)
    labels = np.array([a["label"] for a in asks], np.int64)
    return Walk(_matrix([a["packed"] for a in asks]), labels, np.repeat(np.arange(len(asks)), sizes), wants, same, k), sizes


def _listed(candidates: DataFrame, centres: np.ndarray, radius: np.ndarray, needed: np.ndarray) -> DataFrame:
    """cluster, bound, cid, label, packed, least (id): the candidates that may reach what a cluster needs."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms, angles = _angles(_matrix(batch.column("packed").to_pylist()), centres)
            bounds = norms[:, None] * np.cos(np.maximum(0, angles - radius[None, :] - SLACK))
            row, cluster = np.nonzero(bounds + 1e-9 * np.abs(bounds) + 1e-6 >= needed[None, :])
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cluster, pa.int32()), pa.array(bounds[row, cluster]), *taken.columns],
                names=["cluster", "bound", *taken.schema.names],
            )

    found = candidates.select("cid", "label", "packed", F.col("ids")[0].alias("least"))
    return found.mapInArrow(work, "cluster int, bound double, cid bigint, label bigint, packed binary, least bigint")


def _walked(cells: DataFrame, same: bool, k: int) -> DataFrame:
    """ask, low, high, score, cid: the best candidates of each slice.  A cell's anchors come first, then its list."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, asks, wants, going, cell = None, [], [], True, None

        def results() -> Iterator[pa.RecordBatch]:
            if walk is not None and len(walk.kept):
                of = [(a["cid"], low, high) for a in asks for low, high in zip(a["lows"], a["highs"])]
                yield records([(*of[w], score, cid) for w, score, _, cid in walk.kept.tolist()], _FOUND)

        for batch in batches:
            names = zip(*(batch.column(c).to_pylist() for c in ("cluster", "team", "slice", "is_row")))
            at = 0
            for (*where, is_row), run in groupby(names):
                part = batch.slice(at, n := len(list(run)))
                at += n
                if where != cell:
                    yield from results()
                    walk, asks, going, cell = None, [], True, where
                if not is_row:
                    asks += part.to_pylist()
                    continue
                if walk is None:
                    if not asks:
                        continue
                    walk, _ = _walk(asks, same, k)
                if going:
                    numbers = (part.column(c).to_numpy(zero_copy_only=False) for c in ("label", "least", "cid"))
                    going = walk.feed(part.column("bound")[0].as_py(), _matrix(part.column("packed").to_pylist()), *numbers)
        yield from results()

    return cells.mapInArrow(work, _FOUND_COLUMNS)


def best_in_ranges(asks: DataFrame, candidates: DataFrame, centres: np.ndarray, same: bool, k: int) -> DataFrame:
    """ask, low, high, rank (from 1), vec_id, score: for each range ``lows[i]`` to ``highs[i]`` of each of ``asks``
    (cid, label, packed, cluster, angle, lows, highs) the ``k`` rows with the highest scores, ties by the smallest vec_id,
    among those with its label, or any other."""
    sample = candidates.select("cid", "label", "packed").orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).collect()
    sure = settle(in_small_batches(_sure(asks, sample, same, k)), "asks")
    # One row per cluster.  An anchor without length scores 0 with all and needs all if it wants that.
    norm, floor = F.col("norm"), F.array_min("floors")
    lowest = F.when(norm > 0, floor / norm).when(floor <= 0, F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    per_cluster = {r["cluster"]: r for r in sure.groupBy("cluster").agg(
        F.min(lowest).alias("needed"), F.count(F.lit(1)).alias("n")).collect()}
    radii = {r["cluster"]: r["r"] for r in asks.groupBy("cluster").agg(F.max("angle").alias("r")).collect()}
    column = lambda values, none: np.array([values.get(c, none) for c in range(len(centres))], np.float64)
    needed = column({c: r["needed"] for c, r in per_cluster.items()}, np.inf)
    teams = [max(1, -(-per_cluster[c]["n"] // MEMBERS)) if c in per_cluster else 1 for c in range(len(centres))]
    slices = max(1, -(-candidates.count() // SLICE))
    of_cluster = F.element_at(F.lit(teams), F.col("cluster") + 1)
    walkers = sure.select(
        "cluster", F.pmod(F.xxhash64("cid"), of_cluster).cast("int").alias("team"),
        F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(False).alias("is_row"),
        F.lit(None).cast("double").alias("bound"), "cid", "label", "packed", F.lit(None).cast("bigint").alias("least"),
        "lows", "highs", "floors",
    )
    nothing = F.lit(None).cast("array<bigint>")
    listed = _listed(candidates, centres, column(radii, 0.0), needed).select(
        "cluster", F.explode(F.sequence(F.lit(0), of_cluster - 1)).alias("team"),
        F.pmod(F.xxhash64("cid"), F.lit(slices)).cast("int").alias("slice"), F.lit(True).alias("is_row"),
        "bound", "cid", "label", "packed", "least", *[nothing.alias(c) for c in ("lows", "highs", "floors")],
    )
    cells = walkers.union(listed).repartition("cluster", "team", "slice")
    cells = cells.sortWithinPartitions("cluster", "team", "slice", "is_row", F.col("bound").desc(), "cid")
    found = _walked(cells, same, k).join(candidates.select("cid", "ids"), "cid")
    rows = found.select("ask", "low", "high", F.explode("ids").alias("vec_id"), "score")
    return top_k_per_group(rows, ["ask", "low", "high"], [F.col("score").desc(), F.col("vec_id")], k)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, label and vector (an array of whole numbers); a score is the inner product of two vectors.  The
    positives of an anchor are the ``positives`` other rows of its label with the highest scores, ties by the smallest id; its
    negatives for one of them the ``negatives`` rows of other labels with the highest scores from ``low`` to ``high`` percent of the
    positive's, ranked from 1.  All of them if there are fewer, and no row if there is none.

    Rows in which anything is null, also inside the vector, take no part.  Rows equal in all three columns count once;
    rows that share only their id are rows like others, but not positives of each other.  Shorter vectors are filled
    up with zeros.  A score beyond 62 bits raises.  Other columns are not read.
    """
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
    whole &= ~F.exists("vector", lambda x: x.isNull())
    used = rows.withColumn("_anchor", is_anchor).where(whole).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
        pack(rows, "vector").alias("packed"), F.coalesce("_anchor", F.lit(False)).alias("anchor"),
    )
    used = settle(in_small_batches(used.groupBy("vec_id", "label", "packed").agg(F.max("anchor").alias("anchor"))), "vectors")
    kept = max(positives + 1, negatives)
    candidates = _candidates(used, kept)
    anchors = used.where("anchor").join(candidates.select("cid", "label", "packed"), ["label", "packed"])
    anchors = settle(anchors.select(F.col("vec_id").alias("anchor_id"), "cid"), "anchors")
    asking = candidates.join(anchors.select("cid").distinct(), "cid", "left_semi").select("cid", "label", "packed")
    centres = _centres(asking)
    asks = settle(_clustered(asking, centres), "clustered")

    all_scores = asks.select("*", F.array(F.lit(_LEAST)).alias("lows"), F.array(F.lit(_MOST)).alias("highs"))
    near = best_in_ranges(all_scores, candidates, centres, True, positives + 1)
    near = settle(near.select("ask", "rank", "vec_id", "score"), "positives")

    lowest = F.expr(f"-((-score * {low} - pmod(-score * {low}, 100)) div 100)")  # rounded up
    highest = F.expr(f"(score * {high} - pmod(score * {high}, 100)) div 100")  # rounded down
    ranges = near.select(F.col("ask").alias("cid"), lowest.alias("low"), highest.alias("high")).where("low <= high").distinct()
    ranges = ranges.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("ranges"))
    asks = asks.join(ranges.select("cid", F.col("ranges.low").alias("lows"), F.col("ranges.high").alias("highs")), "cid")
    far = best_in_ranges(settle(asks, "wanted"), candidates, centres, False, negatives)

    # At most ``positives + 1`` ranges an anchor, and as many rows each as were asked for.
    positive = F.struct("rank", F.col("vec_id").alias("id"), "score", lowest.alias("low"), highest.alias("high"))
    of_ask = near.groupBy("ask").agg(F.sort_array(F.collect_list(positive)).alias("near"))
    mined = far.groupBy("ask").agg(
        F.collect_list(F.struct("low", "high", "rank", F.col("vec_id").alias("id"), "score")).alias("far")
    )
    both = settle(of_ask.join(mined, "ask").withColumnRenamed("ask", "cid"), "mined")
    own = anchors.join(both, "cid").select(
        "anchor_id", "far", F.explode(F.slice(F.filter("near", lambda p: p["id"] != F.col("anchor_id")), 1, positives)).alias("p")
    )
    return own.select("anchor_id", "p", F.explode("far").alias("n")).where("n.low = p.low and n.high = p.high").select(
        "anchor_id", F.col("p.id").alias("positive_id"), F.col("n.rank").cast("int").alias("rank"),
        F.col("n.id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"),
    )

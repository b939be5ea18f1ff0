"""Maximum-inner-product search by collision-counting hashing (operator 1).

Vectors are lifted by one component so that the largest inner product is the smallest distance. A hash function is a single
random projection: the vectors of a block sorted by it. Around a query's own projection a window grows step by step
(virtual rehashing: wider windows are unions of narrower ones, nothing is hashed anew), in all projections alike. A vector
collides with the query in a projection if it lies in the window, which in a sorted array is an interval of places; once it
has collided in enough of them, its inner product is computed exactly. A query is done when a vector at the distance of its
k-th best would have been found with probability FOUND: no cap on candidates or partners.

The lift makes short vectors look alike when a much longer one sets its bound. So a block is indexed in ranges of norm, each with a
bound of its own, from the longest down; a range that can't hold a better product than those found is not entered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.llm.common import shuffle_width

#: Neighbours; projections; collisions that make a candidate; window growth while too few are found; chance of finding a k-th neighbour.
NEIGHBOURS, PROJECTIONS, COLLISIONS, GROWTH, FOUND = 20, 96, 59, 1.5, 0.92
#: Vectors of a block, on average; queries that a task looks up at once.
BLOCK, QUERIES = 4096, 1024
#: Vectors whose exact inner products are held at once.
SCORED = 1 << 14


@cache
def _reach() -> float:
    """Half window over distance from which a vector at that distance is a candidate with probability FOUND."""

    def found(ratio: float) -> float:
        p = math.erf(ratio / math.sqrt(2))
        return sum(math.comb(PROJECTIONS, i) * p**i * (1 - p) ** (PROJECTIONS - i) for i in range(COLLISIONS, PROJECTIONS + 1))

    low, high = 0.1, 5.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if found(mid) >= FOUND else (mid, high)
    return high


def _plain_products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed from the first component to the last, so that equal vectors score alike wherever they stand.
    query: one for all vectors, or one for each."""
    out = np.zeros(len(vectors))
    for column, value in zip(vectors.T, query.T, strict=True):
        out += column * value
    return out


class CollisionIndex:
    """Sorted projections of a block of vectors (rows of `vectors`, of norm at most `bound`)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bound: float, seed: int = 7):
        self.ids, self.vectors, self.bound = ids, vectors, bound
        self.square = np.einsum("ij,ij->i", vectors, vectors)
        lift = np.sqrt(np.maximum(bound * bound - self.square, 0))
        self.axes = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, PROJECTIONS))
        # A projection's values stand side by side, or each look at them would copy them first.
        shadow = np.ascontiguousarray((vectors @ self.axes[:-1] + lift[:, None] * self.axes[-1]).T)
        order = np.argsort(shadow, axis=1, kind="stable")
        self.sorted = np.take_along_axis(shadow, order, 1)
        #: Place of each vector in each sorted projection.
        self.place = np.empty(order.shape, np.uint16 if len(ids) < 1 << 15 else np.uint32)
        np.put_along_axis(self.place, order, np.arange(len(ids), dtype=self.place.dtype)[None, :], 1)
        self.verified = self.asked = 0

    def _windows(self, shadows: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and projection the places where the window of `half` around the query's own projection begins and ends."""
        low, high = (np.empty(shadows.shape[::-1], self.place.dtype) for _ in range(2))
        for j, (s, x) in enumerate(zip(self.sorted, shadows.T, strict=True)):
            low[j], high[j] = s.searchsorted(x - halves, "left"), s.searchsorted(x + halves, "right")
        return np.ascontiguousarray(low.T), np.ascontiguousarray(high.T)

    def _candidates(self, low: np.ndarray, high: np.ndarray, places: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """The vectors that lie in the windows of COLLISIONS projections. places, inside: room for what is compared."""
        # Unsigned differences: places before `low` wrap round to large ones.
        np.subtract(self.place, low[:, None], out=places)
        np.less(places, (high - low)[:, None], out=inside)
        return np.flatnonzero(np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8 if PROJECTIONS < 256 else np.uint16) >= COLLISIONS)

    def _best(self, queries: np.ndarray, known: list[np.ndarray], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The k best of each query's known vectors, by exact inner products; these are summed for many queries at once."""
        ends = np.cumsum([len(x) for x in known])
        first = 0
        while first < len(known):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SCORED, side="right")))
            rows = np.concatenate(known[first:last])
            exact = _plain_products(self.vectors[rows], np.repeat(queries[first:last], [len(x) for x in known[first:last]], axis=0))
            at = 0
            for some in known[first:last]:
                score = exact[at : at + len(some)]
                at += len(some)
                best = np.lexsort((self.ids[some], -score))[:k]
                yield self.ids[some[best]], score[best]
            first = last

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (ids of its nearest, their inner products), the query's own id left out. floors: inner products that k
        vectors elsewhere have already; what is below them need not be found."""
        n, reach = len(self.ids), _reach()
        if not n or not len(ids):
            return [(self.ids[:0], np.zeros(0)) for _ in ids]
        shadows = queries @ self.axes[:-1]
        norms = np.einsum("ij,ij->i", queries, queries)
        floors = np.full(len(ids), -math.inf) if floors is None else floors
        # Among every k-th vector the nearest is about as far as the k-th of all: where the windows begin.
        near = queries @ self.vectors[:: max(1, k)].T
        near[ids[:, None] == self.ids[:: max(1, k)]] = -math.inf
        near = np.maximum(near.max(axis=1), floors)
        halves = reach * np.maximum(np.sqrt(np.maximum(norms + self.bound**2 - 2 * near, 0.0)), 1e-9 * self.bound)
        widest = np.maximum(np.abs(self.sorted[:, 0] - shadows).max(axis=1), np.abs(self.sorted[:, -1] - shadows).max(axis=1))
        room = np.empty(self.place.shape, self.place.dtype), np.empty(self.place.shape, bool)
        found, pending = [self.ids[:0]] * len(ids), np.arange(len(ids))
        while len(pending):
            again = []
            # The windows of all queries that look once more, at once.
            for i, low, high in zip(pending.tolist(), *self._windows(shadows[pending], halves[pending]), strict=True):
                norm, half = float(norms[i]), float(halves[i])
                reached = self._candidates(low, high, *room)
                known = reached = reached[self.ids[reached] != ids[i]]
                kth = -math.inf
                if len(reached) >= k:
                    score = self.vectors[reached] @ queries[i]
                    kth = float(np.partition(score, len(score) - k)[len(score) - k])
                    # What rounding could put among the k best is scored in one fixed order below.
                    known = reached[score >= kth - 1e-9 * (abs(kth) + self.bound * math.sqrt(norm))]
                best = max(kth, float(floors[i]))
                need = reach * math.sqrt(max(norm + self.bound**2 - 2 * best, 0.0)) if best > -math.inf else math.inf
                if half >= need or half >= widest[i]:
                    found[i] = known
                    self.verified, self.asked = self.verified + len(reached), self.asked + n
                else:
                    halves[i] = need if need < math.inf else half * GROWTH
                    again.append(i)
            pending = np.array(again, np.int64)
        return list(self._best(queries, found, k))


class RangedIndex:
    """A block of vectors in ranges of norm, of which each is at most half as long as the one before. Vectors whose squared norm
    overflows are always compared exactly, and so is every vector with a query of that kind."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        with np.errstate(over="ignore"):
            norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        self.all, finite = (ids, vectors), np.isfinite(norms)
        self.endless = (ids[~finite], vectors[~finite])
        self.ranges: list[tuple[float, CollisionIndex]] = []
        longest = norms[finite].max() if finite.any() else 0.0
        # A norm may underflow to 0, though no vector is zero; such vectors are one range.
        number = np.full(len(ids), -1)
        number[finite] = np.minimum(np.floor(np.log2(longest / np.maximum(norms[finite], 1e-160))), 2000) if longest else 0
        for n in np.unique(number[finite]):
            own = number == n
            bound = max(float(norms[own].max()) * (1 + 1e-12), 1e-160)
            self.ranges.append((bound, CollisionIndex(ids[own], vectors[own], bound)))

    @property
    def verified(self) -> int:
        return sum(index.verified for _, index in self.ranges)

    @property
    def asked(self) -> int:
        return sum(index.asked for _, index in self.ranges)

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (ids of its nearest, their inner products), the query's own id left out."""
        with np.errstate(over="ignore", invalid="ignore"):
            norms = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        none = (ids[:0], np.zeros(0))
        plain = np.isfinite(norms) & (not len(self.endless[0]))
        found = [none if easy else self._exact(self.endless if np.isfinite(norm) else self.all, own, query, k) for own, query, norm, easy in zip(ids.tolist(), queries, norms.tolist(), plain.tolist(), strict=True)]
        for bound, index in self.ranges:
            kth = np.array([f[1][k - 1] if len(f[1]) >= k else -np.inf for f in found])
            # Ties of the k-th are still of use, and so is what rounding may lift to it.
            asked = np.flatnonzero(np.isfinite(norms) & (norms * bound * (1 + 1e-9) >= kth))
            for i, (more, scores) in zip(asked.tolist(), index.search(ids[asked], queries[asked], k, kth[asked]) if len(asked) else [], strict=True):
                if not len(found[i][0]):
                    found[i] = more, scores
                    continue
                both, score = np.concatenate([found[i][0], more]), np.concatenate([found[i][1], scores])
                best = np.lexsort((both, -score))[:k]
                found[i] = both[best], score[best]
        return found

    @staticmethod
    def _exact(held: tuple[np.ndarray, np.ndarray], own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        ids, vectors = (x[held[0] != own] for x in held)
        with np.errstate(over="ignore", invalid="ignore"):
            score = _plain_products(vectors, query)
        best = np.lexsort((ids, -score))[:k]
        return ids[best], score[best]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)


_FOUND = "query_id long, vec_id long, score double"


def _lookup_task(width: int, k: int):
    """Rows (block, kind, id, v), sorted: a block's vectors (kind 0), then the queries (kind 1) -> the k best of each query in it."""

    def results(index: RangedIndex, ids: np.ndarray, matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(ids), QUERIES):
            own = ids[i : i + QUERIES]
            found = index.search(own, matrix[i : i + QUERIES], k)
            query = np.repeat(own, [len(f[0]) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(np.concatenate([f[0] for f in found]), pa.int64()), pa.array(np.concatenate([f[1] for f in found]), pa.float64())], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, index = None, [], None
        for batch in batches:
            numbers, kinds = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            change = np.flatnonzero(np.append(True, (numbers[1:] != numbers[:-1]) | (kinds[1:] != kinds[:-1])))
            for a, b in zip(change.tolist(), [*change[1:].tolist(), batch.num_rows], strict=True):
                if numbers[a] != block:
                    block, parts, index = numbers[a], [], None
                ids, matrix = np.asarray(batch.column(2).slice(a, b - a), np.int64), _matrix(batch.column(3).slice(a, b - a), width)
                if kinds[a] == 0:
                    parts.append((ids, matrix))
                    continue
                if index is None and parts:
                    index, parts = RangedIndex(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])), []
                if index is not None:
                    yield from results(index, ids, matrix)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k vectors of largest inner product found for each query id.

    vectors and queries: id_col, vector_col (array of numbers); an id is never its own neighbour. Ties go to the smaller id.
    Null, empty or zero vectors and those with null or non-finite components, and null ids, take no part; all others must be
    of one length (vectors of another length than the most common take no part either). Of rows that share an id the one
    with the least vector (in the order of arrays) counts, on either side, so the neighbours of a query are different ids.
    Vectors of any finite length count, also where a squared norm overflows. Empty tables give an empty result.

    Every row is indexed, once: blocks of BLOCK vectors, dealt by id, each in one task, which builds its index and then reads
    the queries as a stream. Queries are copied to every block; only the k best of a query and a block are shuffled on.
    """
    value = F.col("v")

    def usable(df: DataFrame) -> DataFrame:
        plain = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
        sound = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(value, lambda x: x != 0)
        return plain.where(F.coalesce(sound, F.lit(False)))

    base = usable(vectors)
    shape = base.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "width").first()
    if shape is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, n_blocks = shape["width"], max(1, -(-shape["n"] // BLOCK))
    one_each = lambda df: df.where(F.size("v") == width).groupBy("id").agg(F.min("v").alias("v"))
    left = one_each(base).select(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "v")
    right = one_each(usable(queries)).select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "v")
    tasks = max(n_blocks, shuffle_width(vectors.sparkSession))
    dealt = left.unionByName(right).repartition(tasks, "block").sortWithinPartitions("block", "kind", "id")
    best = dealt.mapInArrow(_lookup_task(width, k), _FOUND)
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

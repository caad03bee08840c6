"""Nearest neighbours by collision counting over query-aware projections.

Index: cells of vectors, each in blocks with the sorted projections of its vectors on every random direction, cut into 256 runs of equal length; a vector keeps
the numbers of its runs.  A query opens a window around its own projection on every direction and counts, for each vector, on how many directions its run meets
the window.  Vectors that reach the collision threshold are verified by their exact distance.  Windows grow by virtual rehashing, from one radius to the next.

A direction catches a vector at distance d with probability P(|N(0, 1)| < w / d) at least.  The half-width w belonging to a radius R is chosen so that a vector
within R reaches the threshold up to ``MISS`` standard deviations of its count.  A block is done once the k-th verified distance is within the radius, or
everything is counted; hence the result misses a neighbour only if its count is that unlucky.  The k-th distance is kept from block to block, so that only the
first and smallest block of a cell needs more than a few radii.  No cap on candidates.

A cell stands in one task, about ``CELL_BYTES`` in memory; vectors come to it in pieces of at most ``PIECE_BYTES``, then all queries, in batches of
``QUERY_BATCH``, pass by.  Nothing larger than a piece or a batch is ever one row, no index is stored, and the rows shuffled are the vectors once and the queries
once per cell.  The work is one count for each query and vector.  A cell returns k rows per query at most, which a window reduces to the k nearest.

Vectors that are null, zero or hold null or non-finite components take no part; vectors of different length never meet. A repeated query id is one query (its least
vector); repeated candidates all count. Fewer candidates than k: all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.llm.common import give_back

DIRECTIONS = 64
THRESHOLD = 0.7
MISS = 2.0
GROWTH = 1.15
BLOCK = 8_192
FIRST_BLOCK = 2_048
QUERY_BATCH = 256
CELL_BYTES = 96 << 20
PIECE_BYTES = 1 << 20
SEED = 11

#: Half-width of the windows for radius 1: where a vector at distance 1 reaches the threshold with MISS standard deviations to spare.
_REACHED = min(0.98, THRESHOLD + MISS * (THRESHOLD * (1 - THRESHOLD) / DIRECTIONS) ** 0.5)
WIDTH = NormalDist().inv_cdf((1 + _REACHED) / 2)
LEAST = int(np.ceil(THRESHOLD * DIRECTIONS))

#: Runs per direction, numbered in one byte.
RUNS = 256
#: Components up to this size are multiplied in single precision where they are given so.
SINGLE = 1e15

#: A piece of vectors (kind 0) or a batch of queries (kind 1) on its way to a cell.
ROW = "cell int, dim int, kind int, at long, ids binary, vectors binary"
FOUND = "query_id long, vec_id long, score double"


def directions(dim: int) -> np.ndarray:
    return np.random.RandomState(SEED + dim).standard_normal((dim, DIRECTIONS))


def _usable(column: str) -> Column:
    v = F.col(column)
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Ids and usable vectors of a batch by vector length."""
    vectors = batch.column("v")
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)  # a null component is NaN here
    ids, starts = batch.column("id").to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        own = flat[starts[rows][:, None] + np.arange(dim)]
        usable = np.isfinite(own).all(axis=1) & (own != 0).any(axis=1)
        if usable.any():
            yield int(dim), ids[rows[usable]], own[usable]


def _gathered(batches, limit) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Ids and vectors of one length, at most ``limit(dim)`` at a time."""
    held: dict[int, list] = {}
    for batch in batches:
        for dim, ids, vectors in _by_dim(batch) if batch.num_rows else ():
            own = held.setdefault(dim, [])
            own.append((ids, vectors))
            most = limit(dim)
            if sum(len(i) for i, _ in own) >= most:
                ids, vectors = map(np.concatenate, zip(*held.pop(dim), strict=True))
                whole = len(ids) // most * most
                for at in range(0, whole, most):
                    yield dim, ids[at:at + most], vectors[at:at + most]
                if whole < len(ids):
                    held[dim] = [(ids[whole:].copy(), vectors[whole:].copy())]
    for dim, own in held.items():
        yield dim, *map(np.concatenate, zip(*own, strict=True))


def _row(cell: int, dim: int, kind: int, at: int, ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    values = (cell, dim, kind, at, ids.astype("<i8").tobytes(), vectors.tobytes())
    return pa.record_batch([pa.array([x], t) for x, t in zip(values, kinds, strict=True)], names=[c.split()[0] for c in ROW.split(", ")])


class Block:
    """Vectors of one length with the numbers of their runs on every direction."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        n, dim = vectors.shape
        self.ids, self.vectors, self.known = ids, vectors, np.sort(ids)
        if vectors.dtype == np.float32 and np.abs(vectors).max() > SINGLE:
            self.vectors = vectors.astype("<f8")
        self.squares, projected, onto, step = np.empty(n), np.empty((DIRECTIONS, n)), directions(dim), max(1, (4 << 20) // (8 * dim))
        for at in range(0, n, step):
            some = vectors[at:at + step].astype("<f8")
            self.squares[at:at + step] = (some * some).sum(axis=1)
            projected[:, at:at + step] = (some @ onto).T
        self.spread = float(projected.std(axis=1).mean())
        self.borders = np.sort(projected, axis=1)[:, np.arange(1, RUNS) * n // RUNS]
        self.runs = np.stack([np.searchsorted(own, x, side="right").astype(np.uint8) for own, x in zip(self.borders, projected, strict=True)])
        single = self.vectors.dtype == np.float32
        #: Bounds of the rounding error of a product of two vectors, relative to their squares and absolute; squares less their share of it.
        self.slack = (dim + 8) * (2.0**-23 if single else 2.0**-52), dim * (1e-37 if single else 1e-300)
        self.least = self.squares * (1 - self.slack[0])

    def start(self, k: int) -> float:
        """First radius of queries without a bound: the k-th distance of the block's own vectors, of a few of which the nearest tenth is taken, or half the spread of
        the projections (which is about the typical distance over root two) if that is more."""
        n, kth = len(self.ids), 0.0
        if n > k:
            some = [np.partition(self.distances(self.vectors[at].astype("<f8"), np.arange(n)), k)[k] for at in range(0, n, -(-n // 32))]
            kth = float(np.quantile(some, 0.1))
        return max(1e-9, 0.5 * self.spread, kth)

    def windows(self, projected: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last run (queries x directions) that meet the windows of these radii."""
        half = (radius * WIDTH + 1e-12 * np.abs(projected).max(axis=1))[:, None]  # equal vectors may be projected a rounding apart
        low, high = projected - half, projected + half
        return tuple(np.stack([np.searchsorted(own, x, side="right") for own, x in zip(self.borders, edge.T, strict=True)], axis=1).astype(np.uint8) for edge in (low, high))

    def holds(self, ids: np.ndarray) -> np.ndarray:
        return self.known[np.minimum(np.searchsorted(self.known, ids), len(self.known) - 1)] == ids

    def distances(self, query: np.ndarray, places: np.ndarray) -> np.ndarray:
        gap = self.vectors.take(places, axis=0).astype("<f8") - query
        return np.sqrt((gap * gap).sum(axis=1))

    def within(self, query: np.ndarray, places: np.ndarray, k: int, bound: float) -> np.ndarray:
        """Those of the places that may be among the k nearest and no farther than ``bound``: all others are farther by more than rounding explains."""
        if len(places) <= k:
            return places
        # Picking a vector costs about five products; of many places the whole block is multiplied at once.
        many = 6 * len(places) > len(self.ids)
        some, own = self.vectors if many else self.vectors.take(places, axis=0), query
        if some.dtype == np.float32:
            some, own = (some, query.astype("<f4")) if np.abs(query).max() <= SINGLE else (some.astype("<f8"), query)
        square = float(query @ query)
        with np.errstate(over="ignore", invalid="ignore"):
            products, most = 2.0 * (some @ own), bound * bound
            products = products.take(places) if many else products
            if not np.isfinite(most):
                squares = self.squares.take(places) + square
                most = np.partition(squares - products + squares * self.slack[0] + self.slack[1], k - 1)[k - 1]
            return places[~(self.least.take(places) - products > most - square * (1 - self.slack[0]) + self.slack[1])]


class Nearest:
    """The k nearest so far of each query of a batch."""

    def __init__(self, queries: int, k: int):
        self.k, self.ids, self.scores = k, [np.empty(0, np.int64)] * queries, [np.empty(0)] * queries

    def bound(self, scores: np.ndarray) -> float:
        return float(scores[-1]) if len(scores) == self.k else float("inf")

    def merged(self, q: int, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, scores = np.concatenate([self.ids[q], ids]), np.concatenate([self.scores[q], scores])
        best = np.lexsort((ids, scores))[:self.k]
        return ids[best], scores[best]


def search_block(block: Block, q_ids: np.ndarray, q_vectors: np.ndarray, projected: np.ndarray, nearest: Nearest) -> None:
    """Take the block's vectors, without those of a query's own id, among the nearest of each query."""
    own, (_, n) = block.holds(q_ids), block.runs.shape
    off, hit = np.empty((DIRECTIONS, n), np.uint8), np.empty((DIRECTIONS, n), bool)
    bounds = np.array([nearest.bound(s) for s in nearest.scores])
    radius = bounds if np.isfinite(bounds).all() else np.where(np.isfinite(bounds), bounds, block.start(nearest.k))
    pending, rounds = list(range(len(q_ids))), {}
    while pending:
        first, last = block.windows(projected[pending], radius[pending])
        more = []
        for q, low, high in zip(pending, first, last, strict=True):
            everything = not radius[q] < float("inf") or (not low.any() and (high == RUNS - 1).all())
            window, found = low.tobytes() + high.tobytes(), None
            if q in rounds and rounds[q][0] == window and not everything:
                found = rounds[q][1]
            elif everything:
                places = np.arange(n)
            else:
                np.subtract(block.runs, low[:, None], out=off)  # runs before the window wrap around to large numbers
                np.less_equal(off, (high - low)[:, None], out=hit)
                places = np.flatnonzero(np.add.reduce(hit.view(np.uint8), axis=0, dtype=np.uint8) >= LEAST)
            if found is None:
                if own[q]:
                    places = places[block.ids[places] != q_ids[q]]
                places = block.within(q_vectors[q], places, nearest.k, nearest.bound(nearest.scores[q]))
                found = nearest.merged(q, block.ids[places], block.distances(q_vectors[q], places))
            bound = nearest.bound(found[1])
            if everything or bound <= radius[q]:
                nearest.ids[q], nearest.scores[q] = found
            else:
                more.append(q)
                rounds[q] = window, found
                radius[q] = min(radius[q] * GROWTH, bound)
        pending = more


class Cell:
    """Vectors of one length that stand in one task; blocks grow from FIRST_BLOCK to BLOCK."""

    def __init__(self, dim: int):
        self.dim, self.blocks, self.size, self.waiting = dim, [], FIRST_BLOCK, []

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.waiting.append((ids, vectors))
        while sum(len(i) for i, _ in self.waiting) >= self.size:
            self.close()

    def close(self) -> None:
        """Make a block of the vectors that wait, or of as many as it may hold."""
        if self.waiting:
            ids, vectors = map(np.concatenate, zip(*self.waiting, strict=True))
            self.waiting = [(ids[self.size:].copy(), vectors[self.size:].copy())] if len(ids) > self.size else []
            self.blocks.append(Block(ids[:self.size].copy(), vectors[:self.size].copy()))
            self.size = min(BLOCK, 2 * self.size)

    def search(self, q_ids: np.ndarray, q_vectors: np.ndarray, k: int) -> pa.RecordBatch:
        self.close()
        nearest, projected = Nearest(len(q_ids), k), q_vectors @ directions(self.dim)
        for block in self.blocks:
            search_block(block, q_ids, q_vectors, projected, nearest)
        columns = np.repeat(q_ids, [len(i) for i in nearest.ids]), np.concatenate(nearest.ids), np.concatenate(nearest.scores)
        return pa.record_batch([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=[c.split()[0] for c in FOUND.split(", ")])


def search(df: DataFrame, queries: DataFrame, id_column: str, vector_column: str, k: int = 10) -> DataFrame:
    """k nearest rows of ``df`` to each row of ``queries`` (same columns): query_id, rank from 1, vec_id, score (Euclidean distance)."""

    def rows(x: DataFrame, kind: str) -> DataFrame:
        return x.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast(f"array<{kind}>").alias("v")).filter("id is not null and v is not null")

    kind, item = ("float", 4) if df.schema[vector_column].dataType.simpleString() == "array<float>" else ("double", 8)
    vectors = rows(df, kind)
    n, components = vectors.agg(F.count("*"), F.coalesce(F.sum(F.size("v").cast("long")), F.lit(0))).first()
    size = components * item + n * (DIRECTIONS + 24)
    cells = max(1, -(-size // CELL_BYTES), min(df.sparkSession.sparkContext.defaultParallelism, n // 4096))
    piece = min(PIECE_BYTES, max(16 << 10, size // cells // 8))

    def pieces(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for number, (dim, ids, own) in enumerate(_gathered(batches, lambda dim: max(1, piece // (item * dim + 8)))):
            yield _row((task * 31 + number) % cells, dim, 0, (task << 32) + number, ids, own.astype(f"<f{item}"))
        give_back()

    def asked(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for number, (dim, ids, own) in enumerate(_gathered(batches, lambda _: QUERY_BATCH)):
            yield _row(0, dim, 1, (TaskContext.get().partitionId() << 32) + number, ids, own.astype("<f8"))

    def matched(batches) -> Iterator[pa.RecordBatch]:
        here, cell = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                own, dim, of_queries = (batch.column(c)[at].as_py() for c in ("cell", "dim", "kind"))
                if here != (own, dim):
                    here, cell = (own, dim), Cell(dim)
                ids = np.frombuffer(batch.column("ids")[at].as_buffer(), "<i8")
                values = np.frombuffer(batch.column("vectors")[at].as_buffer(), "<f8" if of_queries else f"<f{item}").reshape(len(ids), dim)
                if of_queries:
                    yield cell.search(ids, values, k)
                else:
                    cell.add(ids, values)
        cell = None
        give_back()

    wanted = rows(queries, "double").filter(_usable("v")).groupBy("id").agg(F.min("v").alias("v"))
    # Every cell meets every query: batches are copied to all cells and stand behind the cell's vectors.
    spread = wanted.mapInArrow(asked, ROW).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    met = vectors.mapInArrow(pieces, ROW).unionByName(spread).repartitionById(cells, "cell").sortWithinPartitions("cell", "dim", "kind", "at")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return met.mapInArrow(matched, FOUND).withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Exact integer k-means by Shallot search.

Every vector remembers its centroid, its second-nearest centroid, an upper bound on the distance to the former and a lower bound on the distance to all others.
After the centroids have moved, the bounds are widened by the moves.  A vector whose upper bound stays under its lower bound, or under half the distance from its
centroid to the next one, keeps its centroid unseen.  The others are measured against both remembered centroids and start from the closer one: its neighbours are
visited in the order of their distance from it, while they lie inside a ball of radius (distance to the start + distance to the second nearest so far).  The ball
shrinks with every better second, and no centroid outside it can be nearest or second.  Bounds are floats with slack and only ever decide what to skip; whatever is
measured is compared as an integer with ties to the smaller number, so the result is that of the plain algorithm, bit for bit.

Vectors and their memory are one Parquet table, written anew each round under the shared folder; the table before goes once it has been read.  Partial sums leave
each task as one row per centroid.  The driver holds the centroids only: k times ``dim`` integers.

Vectors that are null, have another length, or hold null or non-finite components take no part; nor do extra columns.  Repeated rows are vectors of their own, a null
id too (never a start).  Fewer vectors than k: as many centroids.  Empty table: empty result.  Scaled components from 2^27 on are worked on with Python's
integers; a squared distance beyond BIGINT is null, and so are the sums that hold it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.llm.common import discard, shared_path

#: Scaled components under this size have squared distances within 64 bits (for up to 64 components).
NARROW = 1 << 27
SLACK = 1e-12

MEMORY = "cluster int, second int, upper double, lower double"
PARTIAL = "cluster int, n long, sums array<string>"


def _roots(squared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds under and over the square roots of exact integers."""
    if squared.dtype == object:
        low = np.array([isqrt(d) for d in squared.ravel()], object).reshape(squared.shape)
        return low, low + 1
    root = np.sqrt(squared.astype(np.float64))
    return root * (1 - SLACK), root * (1 + SLACK)


def _squared(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    gap = x - centre
    return (gap * gap).sum(axis=-1)


@dataclass
class Memory:
    """What the vectors of a batch remember, one array each."""

    cluster: np.ndarray
    second: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


class Search:
    """One assignment against fixed centroids; ``moved`` are upper bounds on how far each came since the memory was written."""

    def __init__(self, centres: np.ndarray, moved: np.ndarray):
        self.centres, self.k = centres, len(centres)
        between = np.stack([_squared(centres, c) for c in centres])
        self.reach = _roots(between)[0]
        others = [[j for j in range(self.k) if j != a] for a in range(self.k)]
        self.order = [sorted(row, key=lambda j, a=a: (between[a, j], j)) for a, row in enumerate(others)]
        self.half = np.array([min(self.reach[a, row[0]], 10**300) / 2 if row else np.inf for a, row in enumerate(self.order)], np.float64)
        self.moved = moved
        self.others_moved = np.array([max((moved[j] for j in row), default=0.0) for row in others])
        self.measured = 0

    def assign(self, x: np.ndarray, m: Memory) -> None:
        if self.k == 1:
            return
        m.upper = m.upper + self.moved[m.cluster]
        m.lower = m.lower - self.others_moved[m.cluster]
        rows = np.flatnonzero(~(m.upper < np.maximum(m.lower, self.half[m.cluster])))
        own = self._measure(x, rows, m.cluster[rows])
        wide = own.dtype == object
        if not wide:
            m.upper[rows] = _roots(own)[1]
            open_ = ~(m.upper[rows] < np.maximum(m.lower[rows], self.half[m.cluster[rows]]))
            rows, own = rows[open_], own[open_]
        if not len(rows):
            return
        first, second = m.cluster[rows].copy(), m.second[rows].copy()
        other = self._measure(x, rows, second)
        swap = (other < own) | ((other == own) & (second < first))
        first[swap], second[swap] = second[swap], first[swap]
        own[swap], other[swap] = other[swap], own[swap]
        for start in np.unique(first):
            mine = np.flatnonzero(first == start)
            best, best_d, runner, runner_d = self._around(int(start), x[rows[mine]], own[mine], second[mine], other[mine])
            at = rows[mine]
            m.cluster[at], m.second[at] = best, runner
            if not wide:
                m.upper[at], m.lower[at] = _roots(best_d)[1], _roots(runner_d)[0]

    def _measure(self, x: np.ndarray, rows: np.ndarray, to: np.ndarray) -> np.ndarray:
        self.measured += len(rows)
        return _squared(x[rows], self.centres[to])

    def _around(self, start: int, x: np.ndarray, d: np.ndarray, second: np.ndarray, second_d: np.ndarray):
        """Scan the neighbours of ``start`` inside each vector's ball: nearest and second nearest with their exact distances."""
        best, best_d, runner, runner_d = np.full(len(x), start), d.copy(), second.copy(), second_d.copy()
        radius = _roots(d)[1]
        ball = radius + _roots(runner_d)[1]
        active = np.arange(len(x))
        for j in self.order[start]:
            active = active[self.reach[start, j] <= ball[active]]
            if not len(active):
                break
            unseen = active[second[active] != j]
            found = self._measure(x, unseen, np.full(len(unseen), j))
            nearer = (found < best_d[unseen]) | ((found == best_d[unseen]) & (j < best[unseen]))
            at = unseen[nearer]
            runner[at], runner_d[at] = best[at], best_d[at]
            best[at], best_d[at] = j, found[nearer]
            closer = ~nearer & (found < runner_d[unseen])
            at = unseen[closer]
            runner[at], runner_d[at] = j, found[closer]
            changed = unseen[nearer | closer]
            if len(changed):
                ball[changed] = radius[changed] + _roots(runner_d[changed])[1]
        return best, best_d, runner, runner_d


def _integers(column: pa.Array, scale: int) -> np.ndarray:
    """Scaled vectors as rows of exact integers: stored as ints if narrow, else as the unscaled doubles."""
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False)
    if pa.types.is_integer(flat.type):
        whole = values.astype(np.int64)
    else:  # a product with a power of two is exact unless it leaves the range of doubles
        whole = np.array([floor(scale * x) if abs(x) < 2.0**60 else scale * int(x) for x in values.tolist()], object)
    return whole.reshape(len(column), -1)


def _remembered(batch: pa.RecordBatch, k: int) -> Memory:
    if "cluster" in batch.schema.names:
        cluster, second, upper, lower = (batch.column(c.split()[0]).to_numpy(zero_copy_only=False).copy() for c in MEMORY.split(", "))
        return Memory(cluster.astype(np.int64), second.astype(np.int64), upper, lower)
    n = batch.num_rows
    return Memory(np.zeros(n, np.int64), np.full(n, min(1, k - 1)), np.full(n, np.inf), np.zeros(n))


def _assigned(rows: DataFrame, search: Search, scale: int, last: bool) -> DataFrame:
    """Rows with new memory; in the last assignment with exact distances instead."""

    def work(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, m = _integers(batch.column("v"), scale), _remembered(batch, search.k)
            search.assign(x, m)
            if last:
                d = [int(y) if y < 2**63 else None for y in _squared(x, search.centres[m.cluster])]
                yield pa.record_batch([batch.column("id"), pa.array(m.cluster, pa.int32()), pa.array(d, pa.int64())], names=["id", "cluster", "distance"])
            else:
                yield pa.record_batch([batch.column("id"), batch.column("v"), pa.array(m.cluster, pa.int32()), pa.array(m.second, pa.int32()), pa.array(m.upper), pa.array(m.lower)],
                                      names=["id", "v", *(c.split()[0] for c in MEMORY.split(", "))])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    made = f"id {kinds['id']}, cluster int, distance long" if last else f"id {kinds['id']}, v {kinds['v']}, {MEMORY}"
    return rows.mapInArrow(work, made)


def _updated(rows: DataFrame, centres: np.ndarray, scale: int) -> np.ndarray:
    """New centroids: exact floors of the means; one without vectors stays."""

    def partial(batches) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(centres), np.int64), np.zeros(centres.shape, object)
        for batch in batches:
            x, cluster = _integers(batch.column("v"), scale), batch.column("cluster").to_numpy(zero_copy_only=False)
            for c in np.unique(cluster):
                own = x[cluster == c]
                n[c] += len(own)
                sums[c] += own.sum(axis=0)
        held = np.flatnonzero(n)
        yield pa.record_batch([pa.array(held, pa.int32()), pa.array(n[held], pa.int64()), pa.array([[str(int(y)) for y in sums[c]] for c in held], pa.list_(pa.string()))], names=["cluster", "n", "sums"])

    def merged(table: pa.Table) -> pa.Table:
        total = [sum(map(int, column)) for column in zip(*table.column("sums").to_pylist(), strict=True)]
        return pa.table({"cluster": table.column("cluster")[:1], "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "sums": pa.array([[str(y) for y in total]], pa.list_(pa.string()))})

    new = centres.copy()
    for r in rows.select("v", "cluster").mapInArrow(partial, PARTIAL).groupBy("cluster").applyInArrow(merged, PARTIAL).collect():  # k rows at most
        new[r["cluster"]] = [int(y) // r["n"] for y in r["sums"]]
    return new


def _usable(v: Column, dim: int) -> Column:
    return v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def cluster(df: DataFrame, id_column: str, vector_column: str, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, salt: int = 1) -> tuple[DataFrame, np.ndarray]:
    """Rows (id, cluster int, distance long) of every usable vector, written, and the final centroids as exact integers.

    Components become floor(scale * x), ``scale`` a power of two and ``dim`` at most 64.  Starts are the k vectors with the least SHA-256 of ``<salt>:<id>``.
    """
    if dim > 64 or scale & (scale - 1):
        raise ValueError("at most 64 components and a power of two as scale")
    spark = df.sparkSession
    rows = df.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("v")).filter(_usable(F.col("v"), dim))
    longest = rows.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    narrow = longest is None or longest * scale < NARROW - 1
    if narrow:
        rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * float(scale)).cast("int")))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    place = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")).cast("binary"), 256)
    starts = [r["v"] for r in rows.select("v", place.alias("place")).orderBy(F.col("place").asc_nulls_last(), "v").limit(k).collect()]
    if not starts:
        return spark.createDataFrame([], f"id {kinds['id']}, cluster int, distance long"), np.empty((0, dim), np.int64)
    centres = np.concatenate([_integers(pa.array([v], pa.list_(pa.int64() if narrow else pa.float64())), scale) for v in starts])
    moved, held = np.zeros(len(centres)), None
    for turn in range(rounds + 1):
        path = shared_path(spark, "centroids")
        made = _assigned(rows, Search(centres, moved), scale, turn == rounds)
        made.write.parquet(path)
        if held is not None:
            discard(spark, held)
        rows, held = spark.read.schema(made.schema).parquet(path), path
        if turn < rounds:
            new = _updated(rows, centres, scale)
            moved = np.array([float(min(y, 10**300)) for y in _roots(_squared(new, centres))[1]])
            centres = new
    return rows, centres

"""Feasible anchor chains and monotone filling of a measure's lattice."""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

_CHAIN = "array<struct<i:int,j:bigint>>"


def _heaviest(candidates: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Best chain of (i, j, support): i rises, j - i does not fall; most support, then most members, then smaller j, then smaller i.

    Prefix maxima over j - i (a Fenwick tree) replace the pairwise search; equal predecessors keep the earliest candidate.
    """
    slots = sorted({j - i for i, j, _ in candidates})
    tree: list[tuple[int, int, int] | None] = [None] * (len(slots) + 1)
    best: list[tuple[int, int]] = []
    parent: list[int] = []
    waiting: list[int] = []
    for index, (i, j, support) in enumerate(candidates):
        if waiting and candidates[waiting[0]][0] != i:
            for w in waiting:
                slot = bisect_right(slots, candidates[w][1] - candidates[w][0])
                entry = (best[w][0], best[w][1], -w)
                while slot <= len(slots):
                    if tree[slot] is None or entry > tree[slot]:
                        tree[slot] = entry
                    slot += slot & -slot
            waiting = []
        slot, found = bisect_right(slots, j - i), None
        while slot > 0:
            if tree[slot] is not None and (found is None or tree[slot] > found):
                found = tree[slot]
            slot -= slot & -slot
        best.append((support, 1) if found is None else (found[0] + support, found[1] + 1))
        parent.append(-1 if found is None else -found[2])
        waiting.append(index)
    if not best:
        return []
    k = max(range(len(best)), key=lambda n: (*best[n], -candidates[n][1], -candidates[n][0]))
    chain = []
    while k >= 0:
        chain.append(candidates[k][:2])
        k = parent[k]
    return chain[::-1]


def _chains(candidates: pa.Array) -> pa.Array:
    """The chain of every list of candidates; columns in and out, so that a worker needs no pandas."""
    rows = candidates.flatten()
    i, j, w = (rows.field(c).to_pylist() for c in ("i", "j", "w"))
    ends, chained, start = [0], [], 0
    for size in candidates.value_lengths().to_pylist():
        stop = start + (size or 0)
        chained += _heaviest(list(zip(i[start:stop], j[start:stop], w[start:stop])))
        ends.append(len(chained))
        start = stop
    members = pa.StructArray.from_arrays([pa.array([a for a, _ in chained], pa.int32()), pa.array([b for _, b in chained], pa.int64())], names=["i", "j"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), members)


def anchor_chain(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Anchors (i, j) of each key: (0, 0) and the heaviest feasible chain of candidate positions.

    Needs i (column, from 0), j (lattice position), support, seen (order of first appearance inside a column), n (columns of the key)
    and units (lattice positions of the key).  A candidate must leave room for the columns on both sides.
    """
    i, j = F.col("i"), F.col("j")
    usable = candidates.filter((i > 0) & (j > 0) & (j >= i) & (F.col("units") - 1 - j >= F.col("n") - 1 - i))
    packed = F.struct(i.cast("int").alias("i"), F.col("seen").cast("bigint").alias("seen"), j.cast("bigint").alias("j"), F.col("support").cast("bigint").alias("w"))
    grouped = usable.groupBy(*keys).agg(F.array_sort(F.collect_list(packed)).alias("_c"))
    chained = grouped.select(*keys, F.explode(F.arrow_udf(_chains, _CHAIN)("_c")).alias("_a")).select(*keys, "_a.i", "_a.j")
    origin = candidates.select(*keys).distinct().select(*keys, F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("j"))
    return origin.unionByName(chained)


def monotone_fill(columns: DataFrame, keys: list[str], x: str = "x", index: str = "i", anchor: str = "anchor_j", units: str = "units") -> DataFrame:
    """Lattice position ``j`` of every column of a key: anchors fixed, columns between them interpolated by x and kept increasing.

    Between the anchors (i0, j0) and (i1, j1) the rounded ideal position is clamped so that every later column still has room; written
    in u = j - i that clamp is a running maximum, so one window per measure does it.
    """
    order = Window.partitionBy(*keys).orderBy(index)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    i, xc = F.col(index), F.col(x).cast("double")
    rows = columns.withColumn("_j", F.when(i == 0, F.lit(0)).otherwise(F.col(anchor)).cast("bigint"))
    point = F.when(F.col("_j").isNotNull(), F.struct(i.alias("i"), F.col("_j").alias("j"), xc.alias("x")))
    rows = rows.withColumns({
        "_prev": F.last(point, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)),
        "_last": F.last(point, ignorenulls=True).over(whole),
        "_x0": F.first(xc).over(whole), "_x9": F.last(xc).over(whole), "_n": F.count(F.lit(1)).over(whole),
    })
    rises = F.col("_j").isNotNull() & (F.col("_j") > F.col("_prev.j")) & (xc > F.col("_prev.x"))
    rows = rows.withColumn("_scale", F.when(rises, (xc - F.col("_prev.x")) / (F.col("_j") - F.col("_prev.j"))))
    every = Window.partitionBy(*keys)
    rows = rows.withColumns({
        "_nth": F.row_number().over(Window.partitionBy(*keys, F.col("_scale").isNull()).orderBy("_scale")),
        "_pairs": F.count("_scale").over(every),
    })
    spread = F.greatest(F.lit(1.0), (F.col("_x9") - F.col("_x0")) / F.greatest(F.lit(1), F.col("_n") - 1))
    upper_median = F.max(F.when(F.col("_nth") == F.floor(F.col("_pairs") / 2) + 1, F.col("_scale"))).over(every)
    rows = rows.withColumn("_median", upper_median)
    rows = rows.withColumn("px_per_unit", F.coalesce("_median", F.when(F.col("_n") > 1, spread).otherwise(F.lit(1.0))))
    left = F.col("_n") - 1 - F.col("_last.i")
    steps = F.rint((F.col("_x9") - F.col("_last.x")) / F.greatest(F.col("px_per_unit"), F.lit(1e-6))).cast("bigint")
    room = F.col("_last.j") + left
    tail = F.least(F.col(units) - 1, F.greatest(room, F.col("_last.j") + F.greatest(left, steps)))
    rows = rows.withColumn("_fixed", F.when(F.col("_j").isNull() & (i == F.col("_n") - 1), tail).otherwise(F.col("_j")))

    fixed = F.when(F.col("_fixed").isNotNull(), F.struct(i.alias("i"), F.col("_fixed").alias("j"), xc.alias("x")))
    rows = rows.withColumns({
        "_a": F.last(fixed, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "_b": F.first(fixed, ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    span = F.col("_b.j") - F.col("_a.j")
    by_x = (xc - F.col("_a.x")) / (F.col("_b.x") - F.col("_a.x"))
    by_count = (i - F.col("_a.i")) / (F.col("_b.i") - F.col("_a.i"))
    ideal = F.col("_a.j") + span * F.when(F.col("_b.x") > F.col("_a.x"), by_x).otherwise(by_count)
    between = F.col("_fixed").isNull()
    wish = F.least(F.col("_b.j") - F.col("_b.i"), F.rint(ideal).cast("bigint") - i)
    rows = rows.withColumns({"_wish": F.when(between, wish), "_gap": F.col("_a.i")})
    running = F.max("_wish").over(Window.partitionBy(*keys, "_gap").orderBy(index).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = F.when(between, i + F.greatest(F.col("_a.j") - F.col("_a.i"), running)).otherwise(F.col("_fixed"))
    return rows.withColumns({"j": filled.cast("bigint"), "is_tail_anchor": F.col("_j").isNull() & F.col("_fixed").isNotNull()}).drop(
        "_j", "_prev", "_last", "_x0", "_x9", "_n", "_scale", "_nth", "_pairs", "_median", "_fixed", "_a", "_b", "_wish", "_gap")

"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to).  A flow network routes token capacity from patterns to the quotas of
their sources: every further repetition of a pattern's tokens is an arc of its own with a higher cost, so repetition is spread before it is piled up.
The flow says how many tokens of each pattern the mix takes: whole repetitions of all its documents, and a rest.

The rest is filled first-fit in seeded order: going through the rows ordered by a hash of the seed and their identity (then by size), each one that still
fits is taken, so in the end no row left out fits the gap.  This runs in rounds: rows of at most half the gap are summed up to the first of them that no
longer fits, or the first larger row that does; either way what is left is less than half.  The choice is kept as one edge per round and pattern, so that
taking effect is a narrow expression on the documents and needs no join.  Repeated rows, of one hash and size, are taken by count: where only some of them
fit, they are written with a number each.

The driver sees one row per pattern and source of the mix, and one edge per pattern and round; it never sees other documents.  Sums over a hot pattern are spread
over hash ranges.  Null and empty texts have size 0 and are never taken; a null source is a source like any other, last in order. Documents in no source are not taken.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.llm.common import count_words, fresh, write_once

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_REPEATS = 2
RANGE_ROWS = 200_000
SEED = 17
#: Behind all places and sizes.
END = 2**63 - 1


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> dict[str | None, float]:
    """Target of each source: shares by weight, capped at ``most`` times its size, the excess shared again by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, total = {}, list(order), share * sum(sizes.values())
    while left:
        per = (total - sum(out.values())) / sum(weight[s] for s in left)
        over = [s for s in left if per * weight[s] > most * sizes[s]]
        if not over:
            out |= {s: per * weight[s] for s in left}
            break
        out |= {s: float(most * sizes[s]) for s in over}
        left = [s for s in left if s not in out]
    return {s: out[s] for s in order}


def flow(patterns: dict[str, tuple[list, int]], quotas: dict, most: int = MOST_REPEATS) -> dict[str, dict]:
    """Min-cost maximum flow: tokens that each pattern (sources, size) sends to each source's quota.

    Successive cheapest paths with potentials; the r-th repetition of a pattern costs 2r - 1 per token, the convex cost of r squared.
    """
    nodes = ["s", "t", *[("p", p) for p in patterns], *[("q", q) for q in quotas]]
    number = {n: i for i, n in enumerate(nodes)}
    to, cap, cost, out = [], [], [], [[] for _ in nodes]

    def arc(a, b, c: int, price: int) -> None:
        for x, y, room, money in ((a, b, c, price), (b, a, 0, -price)):
            out[number[x]].append(len(to))
            to.append(number[y])
            cap.append(room)
            cost.append(money)

    for p, (members, size) in patterns.items():
        for r in range(1, most + 1):
            arc("s", ("p", p), size, 2 * r - 1)
        for q in members:
            arc(("p", p), ("q", q), most * size, 0)
    for q, quota in quotas.items():
        arc(("q", q), "t", int(round(quota)), 0)
    potential = [0] * len(nodes)
    while True:
        distance, via = [None] * len(nodes), [-1] * len(nodes)
        distance[0], heap = 0, [(0, 0)]
        while heap:
            d, v = heapq.heappop(heap)
            if d > distance[v]:
                continue
            for e in out[v]:
                w = to[e]
                new = d + cost[e] + potential[v] - potential[w]
                if cap[e] > 0 and (distance[w] is None or new < distance[w]):
                    distance[w], via[w] = new, e
                    heapq.heappush(heap, (new, w))
        if distance[1] is None:
            break
        farthest = max(d for d in distance if d is not None)
        potential = [p + (farthest if d is None else d) for p, d in zip(potential, distance, strict=True)]
        path, v = [], 1
        while v:
            path.append(via[v])
            v = to[via[v] ^ 1]
        room = min(cap[e] for e in path)
        for e in path:
            cap[e] -= room
            cap[e ^ 1] += room
    name = {i: n for n, i in number.items()}
    return {p: {name[to[e]][1]: cap[e ^ 1] for e in out[number["p", p]] if to[e] > 1 and e % 2 == 0 and cap[e ^ 1]} for p in patterns}


@dataclass
class Plan:
    """What the mix takes: by pattern the whole repetitions and the edges of the rest; by source its size and target.

    An edge (place, size, most, take, rows) ends a round: rows before it, and behind the edge before, are taken up to size ``most``, of its own ``rows`` rows ``take``.
    Rows behind the last edge are not taken.
    """

    whole: dict[str, int]
    edges: dict[str, list[tuple[int, int, int, int, int]]]
    flows: dict[str, dict]
    sizes: dict
    targets: dict


def pattern_of(sources: Column) -> Column:
    """Name of a membership pattern: its distinct sources in order, as JSON. A null array is no source at all."""
    return F.coalesce(F.to_json(F.array_sort(F.array_distinct(sources))), F.lit("[]"))


def order_of(*identity: Column, seed: int = SEED) -> Column:
    """Place of a document in the seeded order: a non-negative 63-bit hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *identity), 1)


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> Plan:
    """Plan a mix for documents with columns ``pattern``, ``place`` (of the seeded order) and ``size``."""
    items = write_once(docs.groupBy("pattern", "place", "size").agg(F.count(F.lit(1)).alias("rows")), "mixing")
    found = items.groupBy("pattern").agg(F.sum(F.col("size") * F.col("rows")).alias("size"), F.count(F.lit(1)).alias("n")).collect()
    by_pattern = {r["pattern"]: (json.loads(r["pattern"]), r["size"]) for r in found}
    sizes: dict = {}
    for members, size in by_pattern.values():
        for source in members:
            sizes[source] = sizes.get(source, 0) + size
    goal = targets(sizes, weights, share, most)
    flows = flow({p: v for p, v in by_pattern.items() if v[0] and v[1]}, goal, most)
    taken = {p: sum(f.values()) for p, f in flows.items()}
    whole = {p: n // by_pattern[p][1] for p, n in taken.items()}
    rest = {p: n % by_pattern[p][1] for p, n in taken.items()}
    ranges = max(1, -(-sum(r["n"] for r in found) // RANGE_ROWS))
    return Plan(whole, _edges(items, {p: n for p, n in rest.items() if n}, ranges), flows, sizes, goal)


def _edges(items: DataFrame, rest: dict[str, int], ranges: int) -> dict[str, list[tuple[int, int, int, int, int]]]:
    """Edges of the first-fit choice that fills ``rest`` tokens of each pattern; the gap at least halves with each round."""
    out: dict[str, list] = {p: [] for p in rest}
    behind, gaps = dict.fromkeys(rest, (-1, -1)), dict(rest)
    before = Window.partitionBy("pattern").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("pattern", "part").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    while gaps:
        of = F.create_map(*[x for p, n in gaps.items() for x in (F.lit(p), F.struct(*map(F.lit, (*behind[p], n))))])[F.col("pattern")]
        left = items.filter(F.col("pattern").isin(list(gaps)) & (F.col("size") > 0)).withColumn("of", of).select(
            "*", F.col("of.col1").alias("from_place"), F.col("of.col2").alias("from_size"), F.col("of.col3").cast("long").alias("gap"))
        left = left.filter((F.col("size") <= F.col("gap")) & ((F.col("place") > F.col("from_place")) | (F.col("place") == F.col("from_place")) & (F.col("size") > F.col("from_size"))))
        small = F.col("size") * 2 <= F.col("gap")
        ranked = left.select("pattern", "place", "size", "rows", "gap", F.when(small, F.col("size") * F.col("rows")).otherwise(F.lit(0)).alias("n"), F.floor(F.col("place") / F.lit(2.0**63 / ranges)).alias("part"))
        sums = ranked.groupBy("pattern", "part").agg(F.sum("n").alias("n")).select("pattern", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
        upto = ranked.withColumn("upto", F.sum("n").over(inside)).join(sums, ["pattern", "part"]).withColumn("upto", F.col("upto") + F.col("start"))
        stop = F.when(F.col("n") > 0, F.col("upto") > F.col("gap")).otherwise(F.col("upto") + F.col("size") <= F.col("gap"))
        edge = F.min(F.when(stop, F.struct("place", "size", (F.col("upto") - F.col("n")).alias("before"), "rows"))).alias("edge")
        stops = {r["pattern"]: r["edge"] for r in upto.groupBy("pattern").agg(edge).collect()}
        for p, gap in list(gaps.items()):
            if (e := stops.get(p)) is None:
                out[p] += [(END, END, gap // 2, 0, 0)] if p in stops else []
                del gaps[p]
                continue
            take = min(e["rows"], (gap - e["before"]) // e["size"])
            out[p].append((e["place"], e["size"], gap // 2, take, e["rows"]))
            behind[p], gaps[p] = (e["place"], e["size"]), gap - e["before"] - take * e["size"]
            if not gaps[p]:
                del gaps[p]
    return out


def _edge_of(made: Plan, pattern: Column, place: Column, size: Column) -> Column:
    """The edge that decides about a row: the first one at or behind it; null without one."""
    names = ("place", "size", "most", "take", "rows")
    lists = [x for p, edges in made.edges.items() if edges for x in (F.lit(p), F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(names, e, strict=True)]) for e in edges]))]
    if not lists:
        return F.lit(None).cast("struct<" + ",".join(f"{c}:long" for c in names) + ">")
    return F.get(F.filter(F.create_map(*lists)[pattern], lambda e: (e["place"] > place) | (e["place"] == place) & (e["size"] >= size)), F.lit(0))


def copies(df: DataFrame, made: Plan, pattern: str, place: str, size: str, out: str) -> DataFrame:
    """Add ``out``: how often the mix takes each row (INT, 0 and up)."""
    whole = F.create_map(*[F.lit(x) for p, n in made.whole.items() for x in (p, n)])[F.col(pattern)] if made.whole else F.lit(None)
    edge, nth, block, start = (fresh(df, c) for c in ("_edge", "_nth", "_block", "_start"))
    own = (F.col(f"{edge}.place") == F.col(place)) & (F.col(f"{edge}.size") == F.col(size))
    extra = F.when(own, F.col(f"{edge}.take") >= F.col(f"{edge}.rows")).otherwise(F.col(size) <= F.col(f"{edge}.most"))
    every = F.when(F.col(size) > 0, F.coalesce(whole, F.lit(0)).cast("int") + F.coalesce(extra, F.lit(False)).cast("int")).otherwise(0)
    df = df.withColumn(edge, _edge_of(made, F.col(pattern), F.col(place), F.col(size)))
    columns = [c for c in df.columns if c != edge]
    if not any(0 < e[3] < e[4] for edges in made.edges.values() for e in edges):
        return df.select(*columns, every.alias(out))

    # Rows of which only some are taken are numbered in their written copy, block by block, so that no task holds all repetitions of a row.
    some = F.coalesce(own & (F.col(f"{edge}.take") > 0) & (F.col(f"{edge}.take") < F.col(f"{edge}.rows")), F.lit(False))
    apart = write_once(df.filter(some).withColumns({block: F.spark_partition_id(), nth: F.monotonically_increasing_id()}), "mixing-repeated")
    key = [pattern, place, size]
    before = Window.partitionBy(*key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = apart.groupBy(*key, block).agg(F.count(F.lit(1)).alias("n")).select(*key, block, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
    numbered = apart.withColumn(nth, F.row_number().over(Window.partitionBy(*key, block).orderBy(nth))).join(starts, [*key, block])
    taken = every + (F.col(start) + F.col(nth) <= F.col(f"{edge}.take")).cast("int")
    return df.filter(~some).select(*columns, every.alias(out)).unionByName(numbered.select(*columns, taken.alias(out)))


def mix(docs: DataFrame, sources: Column, identity: list[Column], text_column: str = "text", out: str = "copies", **settings) -> DataFrame:
    """Add ``out``: how often each document is taken. ``identity`` tells documents apart in the seeded order; all columns pass through."""
    keyed = docs.select(pattern_of(sources).alias("pattern"), order_of(*identity).alias("place"), count_words(F.col(text_column)).alias("size"))
    made = plan(keyed, **settings)
    pattern, place, size = (fresh(docs, c) for c in ("_pattern", "_place", "_size"))
    df = docs.withColumns({pattern: pattern_of(sources), place: order_of(*identity), size: count_words(F.col(text_column))})
    return copies(df, made, pattern, place, size, out).drop(pattern, place, size)


def repeated(docs: DataFrame, copies_column: str) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns."""
    nth = fresh(docs, "_nth")
    return docs.filter(F.col(copies_column) > 0).withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies_column)))).drop(nth, copies_column)

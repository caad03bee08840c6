"""Weighted hash tree: rows descend region, rack and shard levels by weighted hash draws.

At every node each child draws ``-ln(u) / weight`` with ``u`` hashed from the row's key and the child's path; the least draw wins, which
is a weighted lottery.  A row's draw for a child depends on nothing but the key, the child's path and the child's weight.  Hence a changed
weight only moves rows into or out of the subtree that changed, at each level above it, and a new region takes rows only into itself.

Native expressions throughout: placement is a fold over a few literals per row, without any shuffle.  Numbering inside a shard counts
(shard, bucket) groups first and numbers rows inside a bucket, so that no task gets a whole shard; equal rows are counted together and
spread out again afterwards, so a key that holds a third of all rows is one row while it is sorted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.llm.common import fresh, unit

#: Rows that one task numbers at a time; the number of buckets follows from it and the row count.
BUCKET_ROWS = 200_000


@dataclass(frozen=True)
class Node:
    """A subtree: leaves have a shard number and a weight, other nodes the sum of their children's weights."""

    name: str
    children: tuple["Node", ...] = ()
    shard: int = -1
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def tree(shards: int, weights: dict[int, float] | None = None, base: int = 8) -> Node:
    """Regions of two racks of two shards for the first ``base`` shards; every shard beyond them opens a region of its own.

    Growth by whole regions is what lets one more shard take rows only into itself.
    """
    leaf = lambda s: Node(f"shard{s}", shard=s, own_weight=(weights or {}).get(s, 1.0))
    regions = []
    for first in range(0, min(shards, base), 4):
        racks = [Node(f"rack{r}", tuple(leaf(s) for s in range(r, min(r + 2, shards, base)))) for r in range(first, min(first + 4, shards, base), 2)]
        regions.append(Node(f"region{first // 4}", tuple(racks)))
    regions += [Node(f"region_of{s}", (Node("rack", (leaf(s),)),)) for s in range(base, shards)]
    return Node("root", tuple(regions))


def _draw(key: Column, path: str, weight: float) -> Column:
    u = unit(F.xxhash64(F.lit(path), key))
    return -F.log(1.0 - u) / F.lit(weight)


def place(key: Column, node: Node, path: str = "") -> Column:
    """Shard number of a key. A null key is a key of its own. Children without weight get no rows; a tree without weight gives null."""
    if not node.children:
        return F.lit(node.shard)
    live = [c for c in node.children if c.weight > 0]
    if not live:
        return F.lit(None).cast("int")
    if len(live) == 1:
        return place(key, live[0], f"{path}/{live[0].name}")
    draws = [F.struct(_draw(key, f"{path}/{c.name}", c.weight).alias("draw"), F.lit(i).alias("child")) for i, c in enumerate(live)]
    winner = F.least(*draws)["child"]
    out = place(key, live[-1], f"{path}/{live[-1].name}")
    for i in range(len(live) - 2, -1, -1):
        out = F.when(winner == i, place(key, live[i], f"{path}/{live[i].name}")).otherwise(out)
    return out


def number(df: DataFrame, shard: str, order: list[str], slot: str = "slot") -> DataFrame:
    """Gapless numbers from 0 inside each shard; rows equal in all columns are interchangeable. Keeps exactly the frame's columns, plus ``slot``.

    Null shards are a group like any other. The frame is read twice (row count, rows): write it first if it is costly.
    """
    buckets = max(1, -(-df.count() // BUCKET_ROWS))
    copies, bucket, before, rank, nth = (fresh(df, s) for s in ("_copies", "_bucket", "_before", "_rank", "_nth"))
    rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(copies))
    rows = rows.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)))
    group = [F.col(shard), F.col(bucket)]
    until = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*group).agg(F.sum(copies).alias(rank)).select(*group, F.coalesce(F.sum(rank).over(until), F.lit(0)).alias(before))
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn(rank, F.coalesce(F.sum(copies).over(inside), F.lit(0)))
    right = offsets.select(F.col(shard).alias(f"{before}_shard"), F.col(bucket).alias(f"{before}_bucket"), before)
    joined = numbered.join(right, F.col(shard).eqNullSafe(F.col(f"{before}_shard")) & (F.col(bucket) == F.col(f"{before}_bucket")))
    spread = joined.withColumn(nth, F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1)))
    return spread.select(*df.columns, (F.col(before) + F.col(rank) + F.col(nth)).alias(slot))


def assign(df: DataFrame, key: str, shards: int, shard: str = "shard", weights: dict[int, float] | None = None) -> DataFrame:
    """Add the shard column; all other columns pass through (an older column of that name is replaced)."""
    return df.withColumn(shard, place(F.col(key), tree(shards, weights)))

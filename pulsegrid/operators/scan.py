"""Ordered scans (running aggregates, neighbours, numbering) that survive a hot key.

A plain window puts every row of a key into one task.  When a key is larger than ``HOT_ROWS`` the frame is range-partitioned by
(key, order) and frozen, so that each partition is a contiguous chunk of the order.  Windows then run per (key, chunk), and one small
carry row per chunk boundary links a chunk to the chunks before it.  At most one key of a partition continues from an earlier
partition, so the carry table never has more rows than there are partitions; that bound is why it may be broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from pulsegrid.session import freeze

HOT_ROWS_CONF = "spark.pulsegrid.hotKeyRows"
HOT_ROWS = 5_000_000

CHUNK = "_chunk"


@dataclass(frozen=True)
class Scan:
    keys: tuple[str, ...]
    order: tuple[str, ...]
    chunk: str | None = None

    @property
    def group(self) -> list[str]:
        return [*self.keys, self.chunk] if self.chunk else list(self.keys)

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.group).orderBy(*self.order)

    def within(self, *extra: str) -> "Scan":
        """The same order inside finer keys; chunks stay valid because a finer key only splits them."""
        return Scan((*self.keys, *extra), self.order, self.chunk)

    def running(self, df: DataFrame, exclusive: bool = False, **aggregates: tuple[str, Column]) -> DataFrame:
        """Running aggregate up to (or, exclusive, before) each row. Kinds: sum, count, max, min, last (last non-null)."""
        frame = self.window().rowsBetween(Window.unboundedPreceding, -1 if exclusive else Window.currentRow)
        local = {name: _WINDOWED[kind](value).over(frame) for name, (kind, value) in aggregates.items()}
        if self.chunk is None:
            zero = {name: F.coalesce(col, F.lit(0)) if aggregates[name][0] in ("sum", "count") else col for name, col in local.items()}
            return df.withColumns(zero)

        order = F.struct(*self.order)
        totals = df.groupBy(*self.group).agg(
            *[_total(kind, value, order).alias(f"_t_{name}") for name, (kind, value) in aggregates.items()]
        )
        before = Window.partitionBy(*self.keys).orderBy(self.chunk).rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.select(
            *self.group,
            F.row_number().over(Window.partitionBy(*self.keys).orderBy(self.chunk)).alias("_nth"),
            *[_CARRIED[kind](F.col(f"_t_{name}")).over(before).alias(f"_c_{name}") for name, (kind, _) in aggregates.items()],
        ).filter("_nth > 1").drop("_nth")
        joined = df.withColumns(local).join(F.broadcast(carried), self.group, "left")
        merged = {
            name: _MERGE[kind](F.col(f"_c_{name}"), F.col(name)) for name, (kind, _) in aggregates.items()
        }
        return joined.withColumns(merged).drop(*[f"_c_{name}" for name in aggregates])

    def neighbour(self, df: DataFrame, step: int, **values: Column) -> DataFrame:
        """Value of the previous (step=-1) or next (step=+1) row of the key; null at the ends."""
        packed = F.struct(*[value.alias(name) for name, value in values.items()])
        shifted = F.lag(packed, 1) if step < 0 else F.lead(packed, 1)
        if self.chunk is None:
            out = df.withColumn("_scan_near", shifted.over(self.window()))
            return out.withColumns({name: F.col(f"_scan_near.{name}") for name in values}).drop("_scan_near")

        order = F.struct(*self.order)
        edge = F.max_by(packed, order) if step < 0 else F.min_by(packed, order)
        across = Window.partitionBy(*self.keys).orderBy(self.chunk)
        carried = (
            df.groupBy(*self.group).agg(edge.alias("_scan_edge"))
            .select(*self.group, (F.lag("_scan_edge", 1) if step < 0 else F.lead("_scan_edge", 1)).over(across).alias("_scan_carry"))
            .filter("_scan_carry IS NOT NULL")
        )
        out = df.withColumn("_scan_near", shifted.over(self.window())).join(F.broadcast(carried), self.group, "left")
        found = F.coalesce("_scan_near", "_scan_carry")
        return out.withColumns({name: found[name] for name in values}).drop("_scan_near", "_scan_carry")

    def number(self, df: DataFrame, name: str) -> DataFrame:
        """Zero-based position of each row inside its key."""
        return self.running(df, exclusive=True, **{name: ("count", F.lit(1))})


_WINDOWED = {
    "sum": F.sum,
    "count": F.count,
    "max": F.max,
    "min": F.min,
    "last": lambda value: F.last(value, ignorenulls=True),
}
_CARRIED = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min, "last": lambda value: F.last(value, ignorenulls=True)}
_MERGE = {
    "sum": lambda carry, local: F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0)),
    "count": lambda carry, local: F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0)),
    "max": F.greatest,
    "min": F.least,
    "last": lambda carry, local: F.coalesce(local, carry),
}


def _total(kind: str, value: Column, order: Column) -> Column:
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), order))
    return _WINDOWED[kind](value)


def hot_row_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(HOT_ROWS_CONF, str(HOT_ROWS)))


def largest_key(df: DataFrame, *keys: str) -> int:
    """Rows of the biggest key: one narrow scan with map-side partial counts, one number back to the driver."""
    biggest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return int(biggest or 0)


def sized_scan(df: DataFrame, keys: list[str], order: list[str], probe: DataFrame | None = None) -> tuple[DataFrame, Scan]:
    """Pick the plain or the chunked form from the measured size of the biggest key.

    ``probe`` is any frame with the key columns whose keys are at least as big (usually the base table, where the count reads one
    column); by default the frame itself is counted.
    """
    limit = hot_row_limit(df)
    if largest_key(probe if probe is not None else df, *keys) <= limit:
        return df, Scan(tuple(keys), tuple(order))
    return chunked(df, keys, order, limit)


def carried_scan(df: DataFrame, keys: list[str], order: list[str]) -> Scan:
    """Scan over a frame that may already carry the chunk column of a (key, order) prefix of this scan."""
    return Scan(tuple(keys), tuple(order), CHUNK if CHUNK in df.columns else None)


def chunked(df: DataFrame, keys: list[str], order: list[str], rows_per_chunk: int) -> tuple[DataFrame, Scan]:
    rows = df.agg(F.count(F.lit(1))).first()[0]
    parts = max(2, -(-int(rows) * 2 // rows_per_chunk))
    ranged = df.repartitionByRange(parts, *keys, *order).withColumn(CHUNK, F.spark_partition_id())
    return freeze(ranged), Scan(tuple(keys), tuple(order), CHUNK)

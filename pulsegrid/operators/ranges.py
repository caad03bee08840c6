"""Range lookup as an equi-join over cells whose width fits the range.

A range is covered by cells of one width, a power of eight near its own length: 2 to 9 cells, or 8 to 65 for a range of ``LONG`` ticks or more, so that the points of
one long range are still spread.  A point asks once for every width that some range has, at most 21 and mostly one or two.  How many rows a range makes thus does
not depend on the tick base.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Ranges of this many ticks or more are cut finer.
LONG = 1 << 18


def cell_level(length: Column) -> Column:
    """Power of eight whose cells cover a range of this length (at least 1)."""
    level = F.call_function("div", F.length(F.bin(length.cast("bigint"))) - 1, F.lit(3)).cast("int")
    return F.when(length >= LONG, level - 1).otherwise(level)


def cell(at: Column, level: Column) -> Column:
    """Number of the cell that holds a tick, also before zero."""
    return F.call_function("shiftright", at.cast("bigint"), (level * 3).cast("int"))


def cover(ranges: DataFrame, start: str, end: str) -> DataFrame:
    """Ranges with one row per cell they touch (``_level``, ``_cell``); empty ranges have none."""
    first, last = F.col(start), F.col(end) - 1
    levelled = ranges.filter(F.col(end) > F.col(start)).withColumn("_level", cell_level(F.col(end) - F.col(start)))
    return levelled.withColumn("_cell", F.explode(F.sequence(cell(first, F.col("_level")), cell(last, F.col("_level")))))


def range_lookup(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """Join each point to the ranges of its key with ``start <= at < end``."""
    cut = cover(ranges, start, end)
    used = ranges.filter(F.col(end) > F.col(start)).select(cell_level(F.col(end) - F.col(start)).alias("level")).agg(F.collect_set("level")).scalar()
    placed = points.withColumn("_level", F.explode(used)).withColumn("_cell", cell(F.col(at), F.col("_level")))
    left, right = placed.alias("p"), cut.alias("r")
    condition: Column = F.lit(True)
    for key in [*keys, "_level", "_cell"]:
        condition = condition & (F.col(f"p.{key}") == F.col(f"r.{key}"))
    condition = condition & (F.col(f"r.{start}") <= F.col(f"p.{at}")) & (F.col(f"p.{at}") < F.col(f"r.{end}"))
    extra = [c for c in ranges.columns if c not in keys]
    return left.join(right, condition).select(*[F.col(f"p.{c}") for c in points.columns], *[F.col(f"r.{c}") for c in extra])

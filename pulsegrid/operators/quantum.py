"""Metric lattice of a measure: gcd of its durations, clamped and halved until every column has room."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions.rational import ceil_log2_ratio, gcd_of, power_of_two


#: Values that one fold takes at most.
FOLDED = 1024


def gcd_by(values: DataFrame, keys: list[str], value: str, name: str = "gcd") -> DataFrame:
    """gcd of the positive values of each key, in folds of bounded size.

    Values are cut into blocks by range, whose sets combine on the map side and hold at most ``FOLDED`` values; each block gives one partial gcd.  That is either the
    block's only value or divides a difference below ``FOLDED``; so a second cut, by ``FOLDED`` blocks each, folds at most twice as many, and the last fold sees
    one value per ``FOLDED`` squared of the value range.
    """
    level = values.filter(F.col(value) > 0).select(*keys, F.col(value).cast("bigint").alias("_v"))
    for width in (FOLDED, FOLDED * FOLDED):
        block = F.call_function("div", F.col("_v"), F.lit(width))
        level = level.groupBy(*keys, block.alias("_block")).agg(gcd_of(F.collect_set("_v")).alias("_v"))
    return level.groupBy(*keys).agg(gcd_of(F.collect_set("_v")).alias(name))


def halvings(whole: Column, ticks: Column, columns: Column) -> Column:
    """Fewest halvings k of ``ticks`` with (whole * 2^k) div ticks >= columns, that is whole * 2^k >= columns * ticks."""
    return ceil_log2_ratio(columns * ticks, whole)


def quantum_columns(gcd_ticks: Column, full: Column, tpq: Column, columns: Column) -> Column:
    """struct<base,quantum>: ticks per quarter of the lattice and lattice step in those ticks.

    The step is the gcd (half a quarter when there is none), at most a quarter, halved until the measure has a position for every
    column; a step below 1/32 quarter restarts from 1/32, which again is halved only if columns do not fit.
    """
    # Work on ticks scaled by 64, so that half a quarter and 1/32 quarter are whole for every tick base.
    scaled_full, quarter = full * 64, tpq * 64
    first = F.least(F.coalesce(gcd_ticks * 64, tpq * 32), quarter)
    k = F.when(columns > 0, halvings(scaled_full, first, columns)).otherwise(F.lit(0))
    two_k = power_of_two(k)
    floor = tpq * 2
    k_floor = F.when(columns > 0, halvings(scaled_full, floor, columns)).otherwise(F.lit(0))
    small = first < floor * two_k
    chosen_k = F.when(small, k_floor).otherwise(k)
    base = quarter * power_of_two(chosen_k)
    step = F.when(small, floor).otherwise(first)
    return F.struct(base.alias("base"), step.alias("quantum"))

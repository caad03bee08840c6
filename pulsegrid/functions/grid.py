"""Recursive metric grid as native folds: Levels of a grid position, Level of an atomic span, structure of a refined span."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pulsegrid.functions.rational import int_div, trailing_zeros

_STATE = "struct<a:bigint,len:bigint,level:int,span:int,levels:array<int>,done:boolean>"


def power_floor(base: Column, value: Column) -> Column:
    """Largest power of ``base`` not above ``value`` (value >= 1), exact below 2^53."""
    guess = F.rint(F.pow(base.cast("double"), F.floor(F.log(value.cast("double")) / F.log(base.cast("double"))))).cast("bigint")
    return F.when(guess * base <= value, guess * base).when(guess > value, int_div(guess, base)).otherwise(guess)


def grid_top(base: Column, beats: Column) -> Column:
    """End of the grid: the first boundary at or beyond the number of beats."""
    low = power_floor(base, beats)
    return F.when(low == beats, low).otherwise(low * base).cast("bigint")


def grid_position(n: Column, top: Column, base: Column) -> Column:
    """struct<levels, span>: Levels of zero-based position ``n`` and the Level of the span that starts there."""
    return F.when(base == 2, binary_position(n, top)).otherwise(folded_position(n, top, base))


def binary_position(n: Column, top: Column) -> Column:
    """Base 2 without a fold.

    Every piece of a power-of-two interval is again one, so moving into a piece strips the highest bit: the first boundary is met at the
    Level popcount(n).  With z trailing zeros the left pieces add z - 1 further Levels, and the right piece (none at the top) one.
    """
    n = n.cast("bigint")
    first = F.greatest(F.bit_count(n), F.lit(1)).cast("int")
    zeros = F.when(n == 0, 0).otherwise(trailing_zeros(n)).cast("int")
    right = (zeros >= 1).cast("int")
    more = F.greatest(zeros - 1, F.when(n < top, right).otherwise(0))
    return F.struct(F.sequence(first, first + more).alias("levels"), F.when(n < top, first + right).cast("int").alias("span"))


def folded_position(n: Column, top: Column, base: Column) -> Column:
    """Any base, one step per interval on the way down.

    The boundaries of an interval of length m are 0, 1, base, base^2, ... below m, and m.  A position that is no boundary moves into
    the piece that holds it, one Level down.  A boundary takes the Level, the next one too if the piece to its right is divisible,
    and goes on into a divisible piece on its left as that piece's end.
    """
    n, top, base = n.cast("bigint"), top.cast("bigint"), base.cast("bigint")
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def step(s: Column, _: Column) -> Column:
        x = n - s["a"]
        low = F.when(x > 0, power_floor(base, x)).otherwise(zero)
        is_boundary = (low == x) | (x == s["len"])
        piece_end = F.least(low * base, s["len"])
        right = F.when(x >= s["len"], zero).when(x == 0, one).otherwise(piece_end - x)
        left_start = F.when(x <= 1, zero).when(low == x, int_div(x, base)).otherwise(low)
        left = x - left_start
        here = F.array(s["level"])
        gained = F.when(right > 1, F.concat(here, F.array(s["level"] + 1))).otherwise(here)
        first_span = F.when(right > 0, s["level"] + F.when(right > 1, 1).otherwise(0)).otherwise(F.lit(None).cast("int"))
        descend = F.struct(
            (s["a"] + low).alias("a"), (piece_end - low).alias("len"), (s["level"] + 1).alias("level"),
            s["span"].alias("span"), s["levels"].alias("levels"), F.lit(False).alias("done"),
        )
        settle = F.struct(
            (s["a"] + left_start).alias("a"), left.alias("len"), (s["level"] + 1).alias("level"),
            F.coalesce(s["span"], first_span).alias("span"), F.concat(s["levels"], gained).alias("levels"), (left <= 1).alias("done"),
        )
        return F.when(s["done"], s).when(is_boundary, settle).otherwise(descend).cast(_STATE)

    start = F.struct(
        zero.alias("a"), top.alias("len"), F.lit(1).alias("level"), F.lit(None).cast("int").alias("span"),
        F.array().cast("array<int>").alias("levels"), F.lit(False).alias("done"),
    ).cast(_STATE)
    # Base 3 goes down twice per power; base 2 once.
    steps = F.sequence(F.lit(1), int_div(F.length(F.bin(top)) * 4, 3).cast("int") + 3)
    return F.aggregate(
        steps, start, step,
        lambda s: F.struct(F.array_sort(F.array_distinct(s["levels"])).alias("levels"), s["span"].alias("span")),
    )


def point_levels(factor: Column, k: Column) -> Column:
    """Local Levels of point k (0..factor) of a span split into ``factor`` parts."""
    one = F.array(F.lit(1))
    inner = F.when(factor - k > 1, F.array(k.cast("int"), (k + 1).cast("int"))).otherwise(F.array(k.cast("int")))
    return F.when((factor == 2) | (k == 0), one).when(k < factor, inner).otherwise(F.sequence(F.lit(1), (factor - 1).cast("int")))


def child_level(factor: Column, k: Column) -> Column:
    """Local Level of child span k (0..factor-1)."""
    return F.least(k + 1, factor - 1).cast("int")

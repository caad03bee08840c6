"""Exact time on integers: ticks per quarter, Euclid folds, text form of rationals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

RATIONAL = "struct<num:bigint,den:bigint>"

def _long(value: Column | str | int) -> Column:
    return (F.lit(value) if isinstance(value, int) else F.col(value) if isinstance(value, str) else value).cast("bigint")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def gcd(a: Column | str | int, b: Column | str | int) -> Column:
    """Greatest common divisor of two non-negative integers (gcd(0, n) = n).

    Euclid takes at most 1.45 * log2(smaller) + 2 steps, so the fold is as long as the smaller operand asks for.
    """
    start = F.struct(_long(a).alias("a"), _long(b).alias("b"))
    bits = F.length(F.bin(F.least(_long(a), _long(b))))
    return F.aggregate(
        F.sequence(F.lit(1), bits + int_div(bits, 2) + 3),
        start,
        lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b"))),
        lambda s: s["a"],
    )


def gcd_of(values: Column) -> Column:
    """gcd of an array of positive integers; null for an empty array."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, v: gcd(acc, v)))


def lcm_of(values: Column) -> Column:
    """lcm of an array of positive integers; 1 for an empty array, null beyond BIGINT."""
    return F.aggregate(
        values, F.lit(1).cast("bigint"), lambda acc, v: F.when(acc.isNotNull(), F.try_multiply(int_div(acc, gcd(acc, v)), v.cast("bigint")))
    )


def rational(num: Column | str | int, den: Column | str | int) -> Column:
    """Reduced struct<num,den>; null when the denominator is null or zero."""
    n, d = _long(num), _long(den)
    sign = F.when(d < 0, F.lit(-1)).otherwise(F.lit(1)).cast("bigint")
    return F.when(d != 0, let(gcd(F.abs(n), F.abs(d)), lambda g: F.struct((int_div(n, g) * sign).alias("num"), (int_div(d, g) * sign).alias("den"))))


def rational_text(num: Column | str | int, den: Column | str | int) -> Column:
    """``n`` for whole values, else ``n/d`` in lowest terms."""
    return let(rational(num, den), lambda r: F.when(r["den"] == 1, r["num"].cast("string")).otherwise(
        F.concat_ws("/", r["num"].cast("string"), r["den"].cast("string"))))


# Accepted spellings of a rational (integer, n/d, decimal with optional exponent).
_FRACTION_TEXT = r"^\s*([-+]?\d+)\s*(?:/\s*(\d+))?\s*$"
_DECIMAL_TEXT = r"^\s*([-+]?)(\d*)\.?(\d*)(?:[eE]([-+]?\d{1,3}))?\s*$"
MOST_PLACES = 17


def parse_rational(text: Column | str) -> Column:
    """Text to reduced struct<num,den>; null for anything malformed, with a zero denominator, or beyond BIGINT or MOST_PLACES places."""
    t = F.col(text) if isinstance(text, str) else text
    num = F.regexp_extract(t, _FRACTION_TEXT, 1).try_cast("bigint")
    den_text = F.regexp_extract(t, _FRACTION_TEXT, 2)
    den = F.when(den_text == "", F.lit(1).cast("bigint")).otherwise(den_text.try_cast("bigint"))
    whole, part = F.regexp_extract(t, _DECIMAL_TEXT, 2), F.regexp_extract(t, _DECIMAL_TEXT, 3)
    exponent = F.coalesce(F.regexp_extract(t, _DECIMAL_TEXT, 4).try_cast("int"), F.lit(0))
    places = F.length(part) - exponent
    # A negative number of places appends zeros to the digits.
    zeros = F.repeat(F.lit("0"), F.greatest(F.lit(0), F.least(F.lit(MOST_PLACES + 2), -places)))
    digits = F.concat(F.regexp_extract(t, _DECIMAL_TEXT, 1), whole, part, zeros).try_cast("bigint")
    scale = F.pow(F.lit(10.0), F.least(F.lit(MOST_PLACES), F.greatest(F.lit(0), places))).cast("bigint")
    return (
        F.when(t.rlike(_FRACTION_TEXT), F.when(num.isNotNull(), rational(num, den)))
        .when(t.rlike(_DECIMAL_TEXT) & (F.length(F.concat(whole, part)) > 0) & (places <= MOST_PLACES) & digits.isNotNull(), rational(digits, scale))
    )


def trailing_zeros(value: Column) -> Column:
    """Number of trailing zero bits of a positive integer."""
    return F.bit_count(value.bitwiseAND(-value) - 1)


def ceil_log2_ratio(whole: Column, part: Column) -> Column:
    """Smallest n >= 0 with part * 2^n >= whole, for positive integers."""
    quotient = int_div(whole + part - 1, part)
    return F.when(quotient <= 1, F.lit(0)).otherwise(F.length(F.bin(quotient - 1))).cast("int")


def power_of_two(exponent: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), exponent.cast("int"))


def int_div(a: Column, b: Column | int) -> Column:
    """Whole quotient (towards zero) of integers without a trip through double."""
    divisor = F.lit(b).cast("bigint") if isinstance(b, int) else b
    return F.call_function("div", a, divisor)

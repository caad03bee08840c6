"""Non-negative integers of any size as arrays of limbs in base 10^9, least limb first.

``times`` leaves carries inside the limbs (below 2 * 10^9 as long as factors stay below ``FACTOR_LIMIT``), so a product is one element-wise pass per factor;
``text`` settles them once at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pulsegrid.functions.rational import int_div

LIMB_DIGITS = 9
LIMB = 10**LIMB_DIGITS
FACTOR_LIMIT = LIMB // 2


def one() -> Column:
    return F.array(F.lit(1).cast("bigint"))


def times(limbs: Column, factor: Column) -> Column:
    """Product with a factor from 1 to ``FACTOR_LIMIT``.

    A limb below 2 * 10^9 gives a product below 10^18; its lower part and the upper part of the limb before it again stay below 2 * 10^9.
    """
    wide = F.transform(limbs, lambda x: x * factor)
    low = F.transform(wide, lambda x: x % LIMB)
    high = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(wide, lambda x: int_div(x, LIMB)))
    total = F.zip_with(low, high, lambda a, b: F.coalesce(a, F.lit(0).cast("bigint")) + b)
    return F.when(F.element_at(total, -1) == 0, F.slice(total, F.lit(1), F.size(total) - 1)).otherwise(total)


def product(factors: Column) -> Column:
    """Product of an array of factors, each from 1 to ``FACTOR_LIMIT``."""
    return F.aggregate(factors, one(), lambda acc, f: times(acc, f.cast("bigint")))


def settled(limbs: Column) -> Column:
    """The same number with every limb below 10^9."""
    start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(
        limbs, start,
        lambda s, x: F.struct(int_div(x + s["carry"], LIMB).alias("carry"), F.array_append(s["out"], (x + s["carry"]) % LIMB).alias("out")),
        lambda s: F.when(s["carry"] > 0, F.array_append(s["out"], s["carry"])).otherwise(s["out"]))


def text(limbs: Column) -> Column:
    """Decimal digits without leading zeros."""
    digits = F.array_join(F.reverse(F.transform(settled(limbs), lambda x: F.lpad(x.cast("string"), LIMB_DIGITS, "0"))), "")
    return F.regexp_replace(digits, "^0+(?=.)", "")

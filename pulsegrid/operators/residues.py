"""Binomial coefficients modulo any number, for arguments of any size.

A modulus is a product of prime powers q = p^e.  Modulo q the coefficient is p^c, with c the carries of k + (n - k) in base p, times a quotient of factorials from
which the multiples of p were left out; such a factorial depends on its argument modulo q alone.  So one table per prime power, built once for
all rows of that modulus, turns a coefficient into one look-up of three entries per base-p digit (for large
q a few products more), and the residues of the prime powers are put together
again by the Chinese remainder theorem.  n = 10^9 takes as many steps as it has digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions.combinatorics import lucas_mod, mod_power, pascal_mod
from pulsegrid.functions.rational import int_div, let
from pulsegrid.session import write_table

#: Entries of a table; a larger prime power keeps every so many-th factorial and multiplies the rest of the way.
ENTRIES = 4096
#: Prime powers beyond this size get no table; their coefficients come from digit products (primes) or Pascal rows.
TABLE_LIMIT = 1 << 24
#: Products of two residues stay within BIGINT below it.
MODULUS_LIMIT = 1 << 31


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def prime_powers(modulus: Column) -> Column:
    """array<struct<p,e,q>> of a number from 2 on, by trial division up to its root."""
    start = F.struct(modulus.cast("bigint").alias("rest"), F.array().cast("array<struct<p:bigint,e:int,q:bigint>>").alias("out"))
    candidates = F.sequence(_long(2), F.greatest(_long(2), F.floor(F.sqrt(modulus.cast("double"))).cast("bigint")))
    exponents = F.sequence(F.lit(1), F.lit(31))
    # A composite candidate finds its own primes gone and divides nothing.
    divisors = F.filter(candidates, lambda p: modulus % p == 0)

    def step(s: Column, p: Column) -> Column:
        divided = F.aggregate(exponents, F.struct(s["rest"].alias("rest"), F.lit(0).alias("e"), _long(1).alias("q")), lambda d, _: F.when(
            d["rest"] % p == 0, F.struct(int_div(d["rest"], p).alias("rest"), (d["e"] + 1).alias("e"), (d["q"] * p).alias("q"))).otherwise(d))
        return let(divided, lambda d: F.when(d["e"] > 0, F.struct(d["rest"].alias("rest"), F.array_append(s["out"], F.struct(p.alias("p"), d["e"].alias("e"), d["q"].alias("q"))).alias("out"))).otherwise(s))

    return F.aggregate(divisors, start, step, lambda s: F.when(s["rest"] > 1, F.array_append(s["out"], F.struct(s["rest"].alias("p"), F.lit(1).alias("e"), s["rest"].alias("q")))).otherwise(s["out"]))


def _free_product(after: Column, upto: Column, p: Column, q: Column) -> Column:
    """Product modulo q of the numbers in (after, upto] that p does not divide."""
    steps = F.sequence(after + 1, F.greatest(upto, after + 1))
    return F.when(upto > after, F.aggregate(steps, _long(1), lambda x, i: F.when(i % p == 0, x).otherwise(x * i % q))).otherwise(_long(1))


def residue_tables(moduli: DataFrame, modulus: str) -> DataFrame:
    """modulus, parts: array<struct<p, e, q, stride, lift, free>> with one row per distinct modulus from 2 to ``MODULUS_LIMIT``.

    ``free[j]`` is the product of the numbers up to j * stride that p does not divide, modulo q; ``lift`` is 1 modulo q and 0 modulo the rest of the modulus.
    """
    m = F.col("_modulus")
    usable = moduli.select(F.col(modulus).cast("bigint").alias("_modulus")).filter((m >= 2) & (m < MODULUS_LIMIT)).distinct()
    powers = usable.select("_modulus", F.explode(prime_powers(m)).alias("_part")).select("_modulus", "_part.*").withColumn("stride", int_div(F.col("q") + ENTRIES - 1, ENTRIES))
    sizes = powers.select("p", "q", "stride").distinct().filter(F.col("q") <= TABLE_LIMIT)
    steps = sizes.select("p", "q", "stride", F.explode(F.sequence(_long(1), F.greatest(_long(1), int_div(F.col("q") - 1, F.col("stride"))))).alias("j"))
    steps = steps.select("p", "q", "j", _free_product((F.col("j") - 1) * F.col("stride"), F.col("j") * F.col("stride"), F.col("p"), F.col("q")).alias("x"))
    listed = steps.groupBy("p", "q").agg(F.array_sort(F.collect_list(F.struct("j", "x"))).alias("steps"))  # at most ENTRIES
    free = listed.select("p", "q", F.aggregate("steps", F.array(_long(1)), lambda out, s: F.array_append(out, F.element_at(out, -1) * s["x"] % F.col("q"))).alias("free"))
    co = int_div(F.col("_modulus"), F.col("q"))
    inverse = mod_power(co % F.col("q"), int_div(F.col("q"), F.col("p")) * (F.col("p") - 1) - 1, F.col("q"))
    parts = powers.join(free, ["p", "q"], "left").select("_modulus", F.struct("p", "e", "q", "stride", (co * inverse % F.col("_modulus")).alias("lift"), "free").alias("part"))
    return parts.groupBy("_modulus").agg(F.collect_list("part").alias("parts")).select(F.col("_modulus").alias(modulus), "parts")


def _from_table(n: Column, k: Column, part: Column) -> Column:
    """C(n, k) modulo q for 0 <= k <= n, all digits in one pass."""
    p, q, e, stride = part["p"], part["q"], part["e"], part["stride"]

    def entry(x: Column) -> Column:
        x = x % q
        j = int_div(x, stride)
        return F.when(stride == 1, F.get(part["free"], x.cast("int"))).otherwise(F.get(part["free"], j.cast("int")) * _free_product(j * stride, x, p, q) % q)

    start = F.struct(n.alias("n"), k.alias("k"), (n - k).alias("r"), _long(1).alias("top"), _long(1).alias("low"), F.lit(0).alias("carries"), F.lit(0).alias("late"), F.lit(0).alias("carry"))

    def step(s: Column, j: Column) -> Column:
        carry = F.when(s["k"] % p + s["r"] % p + s["carry"] >= p, 1).otherwise(0)
        return F.when((s["n"] == 0) | (s["carries"] >= e), s).otherwise(F.struct(
            int_div(s["n"], p).alias("n"), int_div(s["k"], p).alias("k"), int_div(s["r"], p).alias("r"), (s["top"] * entry(s["n"]) % q).alias("top"),
            (s["low"] * entry(s["k"]) % q * entry(s["r"]) % q).alias("low"), (s["carries"] + carry).alias("carries"),
            (s["late"] + F.when(j >= e, carry).otherwise(0)).alias("late"), carry.alias("carry")))

    digits = F.sequence(F.lit(1), int_div(F.length(F.bin(n)), F.length(F.bin(p)) - 1).cast("int") + 1)

    def value(s: Column) -> Column:
        # The product of all residues prime to p is -1 modulo q, but 1 modulo 8, 16, ...; it enters once per carry from digit e on.
        sign = F.when(((p == 2) & (e >= 3)) | (s["late"] % 2 == 0), _long(1)).otherwise(q - 1)
        inverse = mod_power(s["low"], int_div(q, p) * (p - 1) - 1, q)
        power = F.aggregate(F.sequence(F.lit(1), F.greatest(s["carries"], F.lit(1))), _long(1), lambda acc, _: acc * p % q)
        return F.when(s["carries"] >= e, _long(0)).otherwise(s["top"] * inverse % q * F.when(s["carries"] > 0, power).otherwise(_long(1)) % q * sign % q)

    return let(F.aggregate(digits, start, step), value)


def residue(n: Column, k: Column, modulus: Column, parts: Column) -> Column:
    """C(n, k) modulo the number whose tables are ``parts``: 0 outside 0 <= k <= n, null without tables."""
    n, k = n.cast("bigint"), k.cast("bigint")
    of_part = lambda part: F.when(part["free"].isNotNull(), _from_table(n, k, part)).when(part["e"] == 1, lucas_mod(n, k, part["p"])).otherwise(pascal_mod(n, k, part["q"]))
    total = F.aggregate(F.transform(parts, lambda part: of_part(part) * part["lift"] % modulus), _long(0), lambda acc, x: (acc + x) % modulus)
    return F.when(parts.isNotNull() & ((k < 0) | (n < k)), _long(0)).otherwise(total)


def with_tables(rows: DataFrame, modulus: str, parts: str = "parts") -> DataFrame:
    """Rows with the tables of their modulus (null where it is below 2 or too large).

    The tables are written first: their true size then decides between broadcast and shuffle.
    """
    tables = write_table(residue_tables(rows, modulus).withColumnsRenamed({"parts": parts, modulus: "_of"}), "residue-tables")
    return rows.join(tables, F.col(modulus).cast("bigint") == F.col("_of"), "left").drop("_of")


def binomial_residues(rows: DataFrame, n: str, k: str, modulus: str, name: str = "residue") -> DataFrame:
    """Rows with C(n, k) modulo their modulus."""
    at = with_tables(rows, modulus, "_parts")
    return at.withColumn(name, residue(F.col(n), F.col(k), F.col(modulus).cast("bigint"), F.col("_parts"))).drop("_parts")

"""Metric words and binomial classes as column expressions: paths, Lucas products, boundary sequences, scale vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pulsegrid.functions import bigint
from pulsegrid.functions.meter import is_prime
from pulsegrid.functions.rational import int_div, rational


def _long(value: Column | int) -> Column:
    return F.lit(value).cast("bigint") if isinstance(value, int) else value.cast("bigint")


# -- words ----------------------------------------------------------------------------------------------------------------------


def normalized_word(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, r"\s+", ""))


def is_metric_word(word: Column) -> Column:
    return word.rlike("^[TA]*$")


def word_ones(word: Column) -> Column:
    """Number of T in a word over T and A."""
    return F.length(F.replace(word, F.lit("A"), F.lit("")))


def word_path(word: Column) -> Column:
    """Lattice path: every letter advances i, a T also advances j; origin included."""
    return F.transform(F.sequence(F.lit(0), F.length(word)), lambda i: F.struct(i.alias("i"), word_ones(F.substr(word, F.lit(1), i)).alias("j")))


def meter_word(q: Column, r: Column) -> Column:
    """r times (T followed by q-1 A); null outside q >= 1, r >= 0."""
    bar = F.concat(F.lit("T"), F.repeat(F.lit("A"), (q - 1).cast("int")))
    return F.when((q >= 1) & (r >= 0), F.repeat(bar, r.cast("int")))


# -- integers -------------------------------------------------------------------------------------------------------------------


def int_power(base: Column, exponent: Column) -> Column:
    """base^exponent on integers, exponent >= 0."""
    b, e = base.cast("bigint"), exponent.cast("int")
    return F.when(e == 0, F.lit(1).cast("bigint")).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.greatest(e, F.lit(1))), F.lit(1).cast("bigint"), lambda acc, _: acc * b))


def mod_power(base: Column, exponent: Column, modulus: Column) -> Column:
    """base^exponent mod modulus by squaring (modulus below 2^31)."""
    start = F.struct(F.lit(1).cast("bigint").alias("r"), (base % modulus).cast("bigint").alias("b"), exponent.cast("bigint").alias("e"))

    def step(s: Column, _: Column) -> Column:
        odd = s["e"] % 2 == 1
        return F.when(s["e"] == 0, s).otherwise(F.struct(
            F.when(odd, s["r"] * s["b"] % modulus).otherwise(s["r"]).alias("r"), (s["b"] * s["b"] % modulus).alias("b"), int_div(s["e"], 2).alias("e")))

    return F.aggregate(F.sequence(F.lit(1), F.length(F.bin(exponent.cast("bigint")))), start, step, lambda s: s["r"])


def digits(value: Column, base: Column) -> Column:
    """Digits of a non-negative integer, least significant first; zero is [0]."""
    v, b = value.cast("bigint"), base.cast("bigint")
    start = F.struct(v.alias("rest"), F.array().cast("array<bigint>").alias("out"))
    # A digit holds at least floor(log2(base)) bits.
    steps = F.sequence(F.lit(1), int_div(F.length(F.bin(v)), F.length(F.bin(b)) - 1).cast("int") + 1)
    return F.aggregate(
        steps, start,
        lambda s, i: F.when((s["rest"] == 0) & (i > 1), s).otherwise(
            F.struct(int_div(s["rest"], b).alias("rest"), F.array_append(s["out"], s["rest"] % b).alias("out"))),
        lambda s: s["out"],
    )


def prime_power_factors(n: Column, k: Column) -> Column:
    """Prime powers whose product is C(n, k), 0 <= k <= n: p to the number of carries of k + (n - k) in base p.  None exceeds n."""

    def exponent(p: Column) -> Column:
        start = F.struct(k.alias("k"), (n - k).alias("r"), F.lit(0).alias("carry"), F.lit(1).cast("bigint").alias("q"))
        carry = lambda s: F.when(s["k"] % p + s["r"] % p + s["carry"] >= p, 1).otherwise(0)
        steps = F.sequence(F.lit(1), int_div(F.length(F.bin(n)), F.length(F.bin(p)) - 1).cast("int") + 1)
        return F.aggregate(steps, start, lambda s, _: F.struct(
            int_div(s["k"], p).alias("k"), int_div(s["r"], p).alias("r"), carry(s).alias("carry"), (s["q"] * F.when(carry(s) == 1, p).otherwise(F.lit(1))).alias("q")), lambda s: s["q"])

    primes = F.filter(F.sequence(F.lit(2).cast("bigint"), F.greatest(n, F.lit(2)).cast("bigint")), is_prime)
    return F.filter(F.transform(primes, exponent), lambda q: q > 1)


def binomial_text(n: Column, k: Column) -> Column:
    """C(n, k) in decimal digits, exact at any size; null outside 0 <= k <= n."""
    n, k = n.cast("bigint"), k.cast("bigint")
    return F.when((k >= 0) & (k <= n), bigint.text(bigint.product(prime_power_factors(n, k))))


def small_binomial_mod(n: Column, k: Column, p: Column) -> Column:
    """C(n, k) mod prime p for 0 <= k <= n < p: numerator times the inverse of the denominator."""
    m = F.greatest(k, F.lit(1)).cast("bigint")
    one = F.lit(1).cast("bigint")
    top = F.aggregate(F.sequence(one, m), one, lambda acc, i: acc * (n - k + i) % p)
    low = F.aggregate(F.sequence(one, m), one, lambda acc, i: acc * i % p)
    return F.when(k == 0, one % p).otherwise(top * mod_power(low, p - 2, p) % p)


def lucas_mod(n: Column, k: Column, p: Column) -> Column:
    """C(n, k) mod prime p as the product over base-p digits; null when p is not prime, 0 outside 0 <= k <= n."""
    n, k, p = n.cast("bigint"), k.cast("bigint"), p.cast("bigint")
    pairs = F.zip_with(digits(F.greatest(n, F.lit(0)), p), digits(F.greatest(k, F.lit(0)), p), lambda a, b: F.struct(
        F.coalesce(a, F.lit(0)).cast("bigint").alias("n"), F.coalesce(b, F.lit(0)).cast("bigint").alias("k")))
    product = F.aggregate(
        pairs, F.lit(1).cast("bigint"),
        lambda acc, d: F.when((acc == 0) | (d["k"] > d["n"]), F.lit(0).cast("bigint")).otherwise(acc * small_binomial_mod(d["n"], d["k"], p) % p),
    )
    return F.when(~is_prime(p), F.lit(None).cast("bigint")).when((n < 0) | (k < 0) | (k > n), F.lit(0).cast("bigint")).otherwise(product)


def pascal_mod(n: Column, k: Column, p: Column) -> Column:
    """C(n, k) mod p for any p >= 2, by Pascal rows mod p (no big numbers); 0 outside 0 <= k <= n, null for p < 2."""
    n, k, p = n.cast("bigint"), k.cast("bigint"), p.cast("bigint")
    width = F.least(k, n - k)
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    first = F.transform(F.sequence(zero, F.greatest(width, zero)), lambda i: F.when(i == 0, one % p).otherwise(zero))

    def next_row(row: Column, _: Column) -> Column:
        moved = F.slice(F.concat(F.array(zero), row), F.lit(1), F.size(row))
        return F.zip_with(row, moved, lambda a, b: (a + b) % p)

    last = F.aggregate(F.sequence(one, F.greatest(n, one)), first, next_row)
    inside = (n >= 0) & (k >= 0) & (k <= n)
    return F.when(p < 2, F.lit(None).cast("bigint")).when(~inside, zero).when(width == 0, one % p).otherwise(F.element_at(last, -1))


# -- scales ---------------------------------------------------------------------------------------------------------------------


def scale_ray(p: Column, m: Column, n0: Column, k0: Column) -> Column:
    f = int_power(p, m)
    return F.when((p >= 2) & (m >= 0), F.struct((f * n0).alias("n"), (f * k0).alias("k")))


def temporal_projection(n: Column, tau_num: Column, tau_den: Column, t0_num: Column, t0_den: Column) -> Column:
    """t0 + tau*n as a reduced rational."""
    return rational(t0_num * tau_den + tau_num * n * t0_den, t0_den * tau_den)


def projected_ray_time(p: Column, m: Column, n0: Column, tau_num: Column, tau_den: Column, t0_num: Column, t0_den: Column) -> Column:
    return temporal_projection(scale_ray(p, m, n0, F.lit(0))["n"], tau_num, tau_den, t0_num, t0_den)


def boundary_term(p: Column, n: Column) -> Column:
    """1 for n = 0, else 1 + p^(n-1); null outside p >= 2, n >= 0."""
    one = F.lit(1).cast("bigint")
    return F.when((p >= 2) & (n == 0), one).when((p >= 2) & (n > 0), one + int_power(p, F.greatest(n - 1, F.lit(0))))


def boundary_sequence(p: Column, count: Column) -> Column:
    return F.when(count <= 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)).cast("int") - 1), lambda i: boundary_term(p, i)))


def boundary_sequence_by_recurrence(p: Column, count: Column) -> Column:
    """1, 2, then x -> p*x - (p-1)."""
    b, c = p.cast("bigint"), count.cast("int")
    seed = F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))
    grown = F.aggregate(
        F.sequence(F.lit(3), F.greatest(c, F.lit(3))), seed, lambda acc, _: F.array_append(acc, b * F.element_at(acc, -1) - (b - 1)))
    return F.when(p < 2, F.lit(None).cast("array<bigint>")).otherwise(F.slice(grown, F.lit(1), F.greatest(c, F.lit(0))))


def boundaries_up_to(p: Column, limit: Column) -> Column:
    """Boundary sequence up to the first term at or beyond ``limit`` (1 and 2 first); that term is null where it leaves BIGINT."""
    b, last = p.cast("bigint"), lambda acc: F.element_at(acc, -1)
    steps = F.sequence(F.lit(1), F.length(F.bin(F.greatest(limit, F.lit(2)).cast("bigint"))))
    # Terms at least double less one, so these steps suffice; none is computed beyond the limit, where large bases overflow.
    seed = F.array(F.lit(1), F.lit(2)).cast("array<bigint>")  # the cast admits nulls
    grown = F.aggregate(steps, seed, lambda acc, _: F.when(last(acc) < limit, F.array_append(acc, F.try_multiply(b, last(acc)) - (b - 1))).otherwise(acc))
    terms = F.when(p < 2, F.lit(None).cast("array<bigint>")).otherwise(grown)
    below = F.size(F.filter(terms, lambda t: t < limit))
    return F.when(limit < 1, F.array().cast("array<bigint>")).otherwise(F.slice(terms, F.lit(1), below + 1))


def next_boundary(p: Column, minimum: Column) -> Column:
    """First boundary term at or beyond ``minimum`` (at least 2)."""
    return F.element_at(boundaries_up_to(p, F.greatest(minimum, F.lit(2))), -1)


def valid_schedule(arities: Column) -> Column:
    return (F.size(arities) > 0) & F.forall(arities, is_prime)


def scale_vector(arities: Column) -> Column:
    """Running products of a schedule of prime arities; null for an invalid schedule."""
    start = F.array().cast("array<bigint>")
    grown = F.aggregate(arities, start, lambda acc, p: F.array_append(
        acc, F.when(F.size(acc) == 0, p.cast("bigint")).otherwise(F.get(acc, F.size(acc) - 1) * p)))
    return F.when(valid_schedule(arities), grown)

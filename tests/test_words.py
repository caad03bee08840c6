"""M1-M15, R1, P12 against plain arithmetic."""

import random
import time
from fractions import Fraction
from math import comb, prod

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from pulsegrid.functions import bigint, combinatorics as C
from pulsegrid.functions.meter import is_prime
from pulsegrid.operators import residues, words as W


def test_arity_grid(spark):
    rows = [(p, n, k, m, [2, 3, p]) for p in (2, 3, 4, 5, 7, 31) for n in (0, 1, 5, 12, 40) for k in (0, 1, 3, 12, 20) for m in (0, 1, 2)]
    df = spark.createDataFrame(rows, "p int, n long, k long, m int, schedule array<int>")
    for r in W.arity_grid(df.filter("p^0 > -1 and n * pow(p, m) < 3000")).collect():
        want = comb(r.n, r.k) % r.p if r.k <= r.n else 0
        prime = all(r.p % d for d in range(2, r.p))
        assert r.p_is_prime == prime
        assert r.pascal_mod == want
        assert r.lucas_mod == (want if prime else None), r
        f = r.p**r.m
        assert r.dilation_invariant == ((comb(f * r.n, f * r.k) % r.p if r.k <= r.n else 0) == want)
        assert r.boundaries == [1] + [1 + r.p**i for i in range(r.m + 1)] == r.boundaries_by_recurrence
        assert (r.ray.n, r.ray.k) == (f, 0)
        assert r.scale_vector == ([2, 6, 6 * r.p] if prime else None)


def test_binomial_digits(spark):
    pairs = [(n, k) for n in range(0, 70, 3) for k in range(0, 60, 7)] + [(200, 100), (997, 400), (3000, 1500), (4096, 1), (5, -1), (None, 1)]
    for r in spark.createDataFrame(pairs, "n long, k long").select("n", "k", C.binomial_text(F.col("n"), F.col("k")).alias("b")).collect():
        assert r.b == (str(comb(r.n, r.k)) if r.n is not None and 0 <= r.k <= r.n else None)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(1, bigint.FACTOR_LIMIT), max_size=30), min_size=20, max_size=20))
def test_big_products(spark, lists):
    """Carries stay inside the limbs whatever the factors, and are settled once at the end."""
    lists += [[bigint.FACTOR_LIMIT] * 40, [1] * 5, [], [10**8] * 9, [999_999_999 // 2] * 3]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<long>")
    for r in df.select("i", bigint.text(bigint.product(F.col("x"))).alias("t")).collect():
        assert r.t == str(prod(lists[r.i]))


def test_residues_of_any_modulus(spark):
    rng = random.Random(3)
    rows = [(n, min(n, rng.randrange(n + 2)) if rng.random() < 0.9 else n + 1, m) for m in (2, 3, 4, 6, 7, 8, 9, 12, 16, 27, 32, 36, 49, 100, 210, 360, 1024, 2310, 6561, 8191, 16384, 65536, 999_983)
            for n in (*(rng.randrange(40) for _ in range(6)), *(rng.randrange(3000) for _ in range(10)))] + [(5, 2, 1), (5, 2, 0), (5, 2, -4), (5, 2, None), (5, -1, 6), (None, 1, 6)]
    got = residues.binomial_residues(spark.createDataFrame(rows, "n long, k long, m long"), "n", "k", "m").collect()
    assert len(got) == len(rows)
    for r in got:
        want = None if r.m is None or r.m < 2 or r.n is None else comb(r.n, r.k) % r.m if 0 <= r.k <= r.n else 0
        assert r.residue == want, r


def test_residues_without_a_table(spark, monkeypatch):
    monkeypatch.setattr(residues, "TABLE_LIMIT", 10)
    rows = [(n, k, m) for n in (3, 11, 40) for k in (0, 2, 11) for m in (6, 11, 16, 99, 121)]
    for r in residues.binomial_residues(spark.createDataFrame(rows, "n long, k long, m int"), "n", "k", "m").collect():
        assert r.residue == (comb(r.n, r.k) % r.m if r.k <= r.n else 0), r


def test_residues_of_large_arguments(spark):
    """Around 10^9, against Legendre's exponents and a product over the digits of every argument."""
    rng = random.Random(9)
    rows = [(10**9 - rng.randrange(10**6), rng.randrange(10**9 - 10**7), m) for m in (12, 360, 1000, 1024, 6561) for _ in range(40)]
    rows += [(2**29 + a, 2**28 * b + c, 4) for a in range(6) for b in (0, 1) for c in range(4)]

    def free(x, p, q):  # factorial of x without multiples of p, from its full periods and the rest
        whole = pow(prod(i for i in range(1, q) if i % p), x // q, q)
        return whole * prod(i for i in range(1, x % q + 1) if i % p) % q

    def factorial(x, p, q):
        e, unit = 0, 1
        while x:
            unit = unit * free(x, p, q) % q
            x //= p
            e += x
        return e, unit

    def plain(n, k, m):
        value, base = 0, 1
        for p in (2, 3, 5):
            q = 1
            while m % (q * p) == 0:
                q *= p
            if q > 1:
                (en, un), (ek, uk), (er, ur) = (factorial(x, p, q) for x in (n, k, n - k))
                r = p ** (en - ek - er) * un * pow(uk * ur, -1, q) % q
                value += base * ((r - value) * pow(base, -1, q) % q)
                base *= q
        return value

    cache = {}
    free = lambda x, p, q, f=free: cache.setdefault((x % (2 * q), p, q), f(x % (2 * q), p, q))
    started = time.perf_counter()
    got = residues.binomial_residues(spark.createDataFrame(rows, "n long, k long, m int"), "n", "k", "m").collect()
    assert time.perf_counter() - started < 60
    for r in got:
        assert r.residue == plain(r.n, r.k, r.m), r
    assert sum(r.residue > 0 for r in got) > 20


def test_tables_are_no_larger_than_their_bound(spark, monkeypatch):
    monkeypatch.setattr(residues, "ENTRIES", 64)
    moduli = spark.createDataFrame([(4096,), (77,), (77,), (3**9,), (1,), (None,)], "m int")
    parts = {r.m: r.parts for r in residues.residue_tables(moduli, "m").collect()}
    assert set(parts) == {4096, 77, 3**9}
    for m, own in parts.items():
        assert prod(x.q for x in own) == m and sum(x.lift for x in own) % m == 1
        for x in own:
            assert len(x.free) <= 65 and x.free == [prod(i for i in range(1, j * x.stride + 1) if i % x.p) % x.q for j in range(len(x.free))]


def test_words(spark):
    df = spark.createDataFrame([(1, "t a A"), (2, "TTA"), (3, ""), (4, "TXA"), (5, "taa")], "word_id long, word string")
    rows = {r.word_id: r for r in W.word_profiles(df).collect()}
    assert rows[1].metric_word == "TAA" and [(p.i, p.j) for p in rows[1].path] == [(0, 0), (1, 1), (2, 1), (3, 1)]
    assert (rows[2].n, rows[2].k, int(rows[2].class_size), rows[2].binomial_mod, rows[2].lucas_mod) == (3, 2, 3, 1, 1)
    assert (rows[3].n, rows[3].k, int(rows[3].class_size)) == (0, 0, 1)
    assert rows[4].valid is False and rows[4].n is None
    classes = {(r.n, r.k): (r.words, r.distinct_words, int(r.class_size)) for r in W.word_classes(df).collect()}
    assert classes == {(3, 1): (2, 1, 3), (3, 2): (1, 1, 3), (0, 0): (1, 1, 1)}


def test_boundaries_and_meter_words(spark):
    df = spark.range(1, 200).select(
        "id", is_prime(F.col("id")).alias("prime"), *[C.next_boundary(F.lit(b), F.col("id")).alias(f"b{b}") for b in (2, 3)],
        C.boundaries_up_to(F.lit(3), F.col("id")).alias("upto"), C.meter_word(F.lit(3), F.col("id") % 4).alias("w"),
        C.projected_ray_time(F.lit(2), F.col("id") % 5, F.lit(1), F.lit(1), F.lit(2), F.lit(1), F.lit(3)).alias("t"),
    )
    for r in df.collect():
        assert r.prime == (r.id > 1 and all(r.id % d for d in range(2, r.id)))
        for b in (2, 3):
            want = 2
            while want < r.id:
                want = b * want - (b - 1)
            assert r[f"b{b}"] == want
        assert r.upto[-1] >= r.id and (len(r.upto) == 1 or r.upto[-2] < r.id)
        assert r.w == "TAA" * (r.id % 4)
        assert Fraction(r.t.num, r.t.den) == Fraction(1, 3) + Fraction(2 ** (r.id % 5), 2)


def test_boundaries_of_large_limits(spark):
    """Terms stop at the limit: with base 7 those beyond it left BIGINT."""
    limits = [1, 2, 3, 9_000_001, 2**40, 2**55 + 1]
    df = spark.createDataFrame([(b, n) for b in (2, 3, 5, 7) for n in limits], "b long, n long").select("b", "n", C.boundaries_up_to(F.col("b"), F.col("n")).alias("t"))
    for r in df.collect():
        want = [1] if r.n == 1 else [1, 2]
        while want[-1] < r.n:
            want.append(r.b * want[-1] - (r.b - 1))
        assert r.t == want
    beyond = spark.range(1).select(C.boundaries_up_to(F.lit(7), F.lit(2**63 - 1)).alias("t")).first().t
    assert beyond[-1] is None and beyond[-2] == 1 + 7**22
